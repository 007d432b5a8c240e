"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import phrase_mining as pm

SCHEMA = "lang string, text string, phrase string, n int, `a.b` string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(lang, text, "x", 7, "y") for lang, text in rows], SCHEMA).repartition(parts)


def by_hand(rows, min_count, max_words, top=2000, percent=100):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        rows_ = []
        for p, a in found.items():
            if any(inside(p, q) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, count=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "cc", "Dé", "é", "ñ", "x\x00y", "it's", "É", "z", "\U0001f600"]
    gaps = [" "] * 8 + ["  ", "\t", ", ", ". ", "\n", "\x0b", ";", " \t ", " "]
    made = []
    for _ in range(count):
        made.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice([3, 12])]) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))))
    return [*made, ("en", None), (None, ""), ("fr", " . "), *made[:9]]


@pytest.mark.parametrize(("seed", "shard_words", "chunk"), [(1, 1_000_000, 2_000_000), (2, 40, 30), (3, 7, 5)])
def test_phrases_by_hand(spark, seed, shard_words, chunk, monkeypatch):
    rows = texts(seed)
    if seed > 1:  # a filter that lets nearly all pass, and counts looked up by shuffles
        monkeypatch.setattr(pm, "MAX_BITS", 1 << 6)
        monkeypatch.setattr(pm, "LOOKUP_ROWS", 0)
    # One very long text, cut into many chunks, with gaps longer than a chunk.
    rows.append(("en", ("a b a b" + " " * 50 + "cc a b, ") * 80))
    for percent in (100, 60):
        got = pm.collocations(table(spark, rows), min_count=6, top=25, subsumed_percent=percent, shard_words=shard_words, chunk=chunk)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, 6, 5, 25, percent)


def test_phrases_of_other_lengths(spark):
    rows = texts(4, 40)
    for most in (2, 3):
        assert sorted(map(tuple, pm.collocations(table(spark, rows), min_count=3, max_words=most, top=None).collect())) == by_hand(rows, 3, most, None)


def test_phrases_of_little(spark):
    assert pm.collocations(table(spark, [])).collect() == []
    assert pm.collocations(table(spark, [("en", None), (None, "one two three")])).collect() == []
    hot = [("en", "same words here")] * 150  # one text a hundred times: its parts are subsumed
    assert [r.phrase for r in pm.collocations(table(spark, hot)).collect()] == ["same words here"]


def test_scores_are_exact(spark):
    cases = [(3_000_000_007, 99_999_999_999_999, 3_000_000_019, 3_000_000_007), (100, 123_456_789, 100, 100), (10**9 + 7, 10**14 + 3, 10**10 + 19, 10**12 + 39)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").select(pm.score_of(*[F.col(c) for c in "anlr"]).alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (left * right) for a, n, left, right in cases]
