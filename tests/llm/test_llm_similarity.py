"""Suffix arrays, substring dedup, near duplicates, decontamination and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelspark.llm import components, decontaminate, jaccard_join, substring_dedup
from panelspark.llm.common import stash
from panelspark.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, class_id string, key string, id int"


def table(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "c", "k", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(300):
        k, m = int(rng.integers(1, 5)), int(rng.integers(0, 4))
        parts = [rng.integers(0, k, int(rng.integers(1, 25))) for _ in range(m + 1)]
        t = np.concatenate([np.append(p + m + 1, i) for i, p in enumerate(parts)])
        data = np.concatenate([np.append(p, 255) for p in parts] + [np.zeros(8)]).astype(np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)
        order = suffix_array(t, m + 1)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert order.tolist() == want
        prefix, _ = common_prefixes(data, ends, order, t)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert prefix[b] == n
    # Recursions with few names and with many: exact by the rank of the suffix one further.
    for t in (np.arange(20000) % 3000, rng.integers(0, 4, 100_000), np.tile(rng.integers(0, 50, 7000), 5), rng.integers(0, 9000, 30_000)):
        order = suffix_array(t)
        assert sorted(order.tolist()) == list(range(len(t)))
        rank = np.full(len(t) + 1, -1)
        rank[order] = np.arange(len(t))
        one, two = order[:-1], order[1:]
        assert ((t[one] < t[two]) | ((t[one] == t[two]) & (rank[one + 1] < rank[two + 1]))).all()


def spans_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        spans = []
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for lo, hi in spans:
            kept, at = kept + b[at:lo], hi
        out.append((len(b), sum(h - l for l, h in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substrings(spark, hot):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = word(60), word(25)
    texts = [word(rng.randrange(0, 80)) + (passage[rng.randrange(30) :] if i % 3 == 0 else other) + word(rng.randrange(60)) for i in range(40)]
    texts += [None, "", "ab" * 200, "ab" * 150, "x" * 300, texts[0], texts[0], word(5), word(5000), passage, passage[:20], passage[:19]]
    ids = [*range(len(texts) - 2), None, 3]
    out = substring_dedup.dedup_substrings(table(spark, texts, ids), length=20, gram=6, shard_bytes=1500, hot_runs=hot).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == sorted(((i, *w) for i, w in zip(ids, spans_by_hand(texts, 20), strict=True)), key=str)


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.dedup_substrings(table(spark, [])).count() == 0


def test_rolling_hashes_equal_strings():
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    for gram in (1, 5, 6, 32):
        h = substring_dedup._rolling(data, gram)[: len(data) - gram + 1]
        assert len(set(h[:10].tolist())) == (10 if gram else 0) and (h[10:] == h[:-10]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def links_by_hand(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 5 * n >= 4 * len(a | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def classes_by_hand(texts, ids):
    links, out, seen = links_by_hand(texts), {}, set()
    for i in range(len(texts)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        seen |= group
        least = min((ids[x] for x in group if ids[x] is not None), default=None)
        for x in group:
            out[x] = (ids[x], least, len(links[x]))
    return sorted(out.values(), key=str)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    base = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(8)]
    texts = []
    for i in range(90):
        w = list(base[i % 8])
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0], None, "", "  ", "one two", "one  two", "one two three", " ".join(word() for _ in range(20000))]


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates(spark, near_texts, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 10**6 if block > 100 else 0)
    ids = [*range(len(near_texts) - 3), None, 0, 5]
    got = jaccard_join.near_duplicates(table(spark, near_texts, ids)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == classes_by_hand(near_texts, ids)


def test_near_duplicates_of_an_empty_table(spark):
    assert jaccard_join.near_duplicates(table(spark, [])).count() == 0


def test_one_of_each_class_stays(spark, near_texts):
    texts = [*near_texts, "alone and only here now", "alone and only here now", "no id at all in this", "no id at all in this"]
    ids = [*range(len(near_texts)), 900, 900, None, None]
    docs = table(spark, texts, ids)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    links = links_by_hand(texts)
    blank = sum(not (t or "").split() for t in texts)
    groups = len({c for _, c, _ in classes_by_hand(texts, list(range(len(texts))))})
    rows = kept.collect()
    assert len(rows) == groups and sum(not (r.text or "").split() for r in rows) == blank
    at = [texts.index(r.text) for r in rows if (r.text or "").split()]
    assert not any(b in links[a] for a in at for b in at if a != b)


def test_pruning_bound():
    assert jaccard_join.least_matches(16) <= 12 and jaccard_join.least_matches(96) > 40
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (30, jaccard_join.HASHES)).astype(np.uint8)
    b = a.copy()
    b[:, :8] = 0
    i, j = jaccard_join.survivors(a, b)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(k, k) for k in range(30)}


def test_dense_and_pairwise_verification_agree():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.1], rng.integers(0, 2**60, 10).astype(np.uint64)))) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    dense = jaccard_join.linked_pairs(sets, sets, a, b)
    few = np.concatenate([jaccard_join.linked_pairs(sets, sets, a[k : k + 50], b[k : k + 50]) for k in range(0, len(a), 50)])
    assert (dense == few).all()


def leaks_by_hand(texts, items):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = set()
    for i, item in items:
        want = Counter(grams(words(item)))
        size = sum(want.values())
        for d, t in enumerate(texts):
            g = grams(words(t))
            for s in range(len(g)):
                have = Counter(g[s : s + size])
                shared = sum((have & want).values())
                if size and shared >= 0.8 * (sum(have.values()) + size - shared):
                    out.add((d, i))
                    break
    return out


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([12, 30, 60])))) for k in range(12)] + [(20, None), (21, ""), (22, "two words"), (23, "ha " * 30)]
    items.append((30, items[0][1]))
    texts = [None, "", "Two, WORDS!", "ha " * 31, "ha " * 500]
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(k // 12):
            w[rng.randrange(len(w))] = word()
        if k % 5 == 0:
            w.insert(3, word())
        texts.append(" ".join(text(rng.randrange(30)) + w[rng.randrange(2) :] + text(rng.randrange(30))).upper() + ".")
    texts += [texts[5], items[3][1] + " " + items[4][1] + " " + items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, texts), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == leaks_by_hand(texts, items)
    left = decontaminate.drop_leaks(table(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in leaks_by_hand(texts, items)}
    assert decontaminate.leaks(table(spark, []), bench).count() == 0
    assert decontaminate.leaks(table(spark, texts), bench.limit(0)).count() == 0


def test_grids_take_every_length():
    grids = list(decontaminate.Grid.all())
    assert [g.longest for g in grids[:4]] == [12, 64, 256, 1024] and all(g.longest < 1 << (g.width - 1) for g in grids)
    for g, before in zip(grids[:6], [4, *[x.longest for x in grids]], strict=False):
        for n in range(before + 1, min(g.longest, before + 500) + 1):
            assert abs(g.words(n) - n) <= g.unit and g.words(n) % g.unit == 0


@pytest.mark.parametrize("at", [0, 1, 2])
def test_fingerprints_by_hand(spark, at):
    """Majority votes, counted one by one."""
    from pyspark.sql import functions as F

    grid = list(decontaminate.Grid.all())[at]
    grid = decontaminate.Grid(min(grid.unit, 4), grid.longest, grid.width, grid.radius)
    rng = np.random.default_rng(at)
    hashes = rng.integers(-(2**63), 2**63 - 1, 75, dtype=np.int64).tolist()
    width = 7 * grid.unit
    rows = spark.createDataFrame([(hashes,)], "w array<long>").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(70), F.lit(3))))
    rows = rows.select("start", (F.size("w") - F.col("start")).alias("left"), *grid.unit_votes("w", "start", 7))
    fp = grid.fingerprint(width, "left")
    for r in rows.select("start", fp.alias("fp"), grid.keys(F.lit(width), fp).alias("b")).collect():
        own = hashes[r.start : r.start + width]
        want = 0
        for group in range(grid.width):
            for lane in range(grid.lanes):
                votes = sum(h >> (grid.lanes * group + lane) & 1 for h in own)
                want |= (votes > len(own) // 2) << (grid.width * lane + group)
        assert r.fp == want
        size = grid.bits // decontaminate.BLOCKS
        assert sum((k & (1 << size) - 1) << size * i for i, k in enumerate(r.b)) == want and [k >> size for k in r.b] == [width * decontaminate.BLOCKS + i for i in range(decontaminate.BLOCKS)]
    n = grid.radius // decontaminate.BLOCKS
    assert len(set(grid.neighbours())) == len(grid.neighbours()) and max(bin(x).count("1") for x in grid.neighbours()) == n


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    before = {r.doc_id: r for r in docs.collect()}
    kept = stash(corpus_pipeline.quality_stage(spark, docs, sf), "t")
    assert kept.schema == docs.schema
    from panelspark.llm.quality_rules import judge

    want = {i: judge(r.text)[7] for i, r in before.items() if judge(r.text)[6]}
    got = {r.doc_id: r for r in kept.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values() if r.text != before[r.doc_id].text)
    lines = stash(corpus_pipeline.line_stage(spark, kept, sf), "t")
    assert lines.count() == kept.count() and lines.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in lines.collect()]
    near = stash(corpus_pipeline.near_duplicate_stage(spark, lines, sf), "t")
    classes = classes_by_hand([t for _, t in texts], [i for i, _ in texts])
    assert {r.doc_id for r in near.collect()} == {i for i, c, _ in classes if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in near.collect()]
    clean = corpus_pipeline.decontamination_stage(spark, near, sf)
    bad = {left[d][0] for d, _ in leaks_by_hand([t for _, t in left], items)}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in left} - bad
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {i for i, _ in left} - bad


def test_pipeline_with_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "y"), (1, None, None, None, None, "x")], "doc_id long, text string, lang string, source string, n_chars long, __clean2 string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 3
    assert corpus_pipeline.quality_stage(spark, docs, sf).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs, sf).count() == 3
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf).count() == 0


CLASHING = ("__kept", "__key", "__gone", "a.b", "doc", "kept", "KEY", "odd", "gone", "own", "digest", "known", "class", "n_lines", "words")


def test_columns_of_any_name_pass_through(spark, sf):
    from panelspark.llm import line_dedup, quality_rules

    prose = " ".join(f"Sentence{i} number{i} ends{i} here{i}." for i in range(20))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, prose), (2, prose), (3, prose + " " + item), (4, None), (4, ""), (None, prose), (None, prose)]
    docs = spark.createDataFrame([(i, t, *["v"] * len(CLASHING)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(tuple(r)[2:] == ("v",) * len(CLASHING) for r in out.collect())
    assert corpus_pipeline.packing_stage(spark, docs, sf).count() == len(rows)
    assert corpus_pipeline.decontamination_stage(spark, docs, sf).count() == len(rows) - 1
    assert corpus_pipeline.near_duplicate_stage(spark, docs, sf).count() == 4
    docs = docs.limit(5)
    dotted = docs.withColumnsRenamed({"doc_id": "the.id", "text": "the.text"})
    assert line_dedup.dedup_lines(dotted, "the.id", "the.text").count() == quality_rules.quality(dotted, "the.text").count() == 5
    assert jaccard_join.near_duplicates(dotted, "the.id", "the.text").count() == 5


def test_leaks_of_edited_copies_by_sql(spark):
    """Copies with words changed, put in and taken out, at any place of a text: items, starts and similarities as the SQL has them over all windows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [[word() for _ in range(rng.choice([8, 20, 33, 60, 110]))] for _ in range(25)]
    texts = []
    for i in range(120):
        own = list(items[i % 25])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = [word()] if rng.random() < 0.7 else []
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 40))), *own, *(word() for _ in range(rng.randint(0, 40)))]))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    got = decontaminate.leaks(table(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "item_id", "start", "similarity")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    con.register("benchmark", pa.table({"item_id": [b[0] for b in bench], "text": [b[1] for b in bench]}))
    rel = con.sql(decontaminate.SQL)
    at = [rel.columns.index(c) for c in ("doc_id", "item_id", "start", "similarity")]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted((r.doc_id, r.item_id, r.start, round(r.similarity, 6)) for r in got.collect()) == want and len(want) > 40
