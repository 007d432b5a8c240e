"""Phrase collocations from suffix automata of bounded depth.

1. Texts are cut into shards of about SHARD_WORDS words a language. A shard's
   pieces make one generalised suffix automaton of bounded depth: its states are
   the sets of end positions that substrings of up to `depth` words share, with
   their sizes (endpos counts), and each state's suffix link leads to the
   substring without its first word. A state is emitted once, by its longest
   substring and the length of its shortest; the substrings between are those
   on the way along suffix links with the same end positions.
2. Spark unfolds states into substrings and sums counts over all shards. Depth
   grows in four passes (words; pairs; three words; longer ones): what a pass cannot
   find often enough is a break in the automata of the next, since a phrase is no
   more frequent than any part of it. What is frequent travels as a Bloom filter of
   bounded size; beyond its capacity more rows shuffle and counts stay exact.
3. A phrase is subsumed by a longer one along the links of the summed counts:
   those to the phrases without the first and without the last word. Longer
   detours need no look, since counts fall at every step.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import few, read_table, sliced, stash

#: Words of a shard at least before it becomes an automaton, bytes of a text and of a shard that are taken at once.
SHARD_WORDS, CHUNK, AT_ONCE = 4_000_000, 1_000_000, 8_000_000
#: Bits of a filter at most (16 MB), and bits for each phrase in it below that.
MAX_BITS, BITS_EACH = 1 << 27, 32
#: Phrases up to which their counts are broadcast to look up the parts of cuts.
LOOKUP_ROWS = 400_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_BREAK = re.compile(rb"[ \n]")
_SEED = 42


def chunks(text: bytes, size: int = CHUNK) -> Iterator[tuple[bytes, bool]]:
    """A text folded, its words between spaces and b"\n" where pieces end (and at the end), in chunks of about `size` bytes; and whether it is at its end."""
    text = text.translate(_FOLD)
    at = 0
    while len(text) - at > size and (cut := _BREAK.search(text, at + size)):
        yield text[at : cut.start()].replace(b"\n", b" \n "), False
        at = cut.start()
    yield text[at:].replace(b"\n", b" \n ") + b" \n", True


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(bitmap.size * 64 - 1)

    def has(at: np.ndarray) -> np.ndarray:
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    return has(hashes & mask) & has((hashes >> np.uint64(32)) & mask)


def automaton(words: np.ndarray, seen: np.ndarray | None, fresh: np.ndarray, lo: int, hi: int, n_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """States of the suffix automaton of depth `hi`: for each length of their longest substring (`lo` or more) that
    length, an end position of each state, its shortest substring's length (`lo` or more) and its endpos count.

    `words` are numbers below n_words, -1 at breaks; `seen[i]` says whether the lo - 1 words that end at i may stand
    in a substring; only ends that are `fresh` count.
    """
    # Two words are joined if one of the seen substrings holds both.
    joined = np.ones(len(words), bool)
    if seen is not None and lo > 2:
        joined = np.logical_or.reduce([np.append(seen[back:], np.zeros(back, bool)) for back in range(lo - 2)])
    valid = (words >= 0) & (seen if seen is not None and lo == 2 else True)
    ends = np.flatnonzero(valid & fresh)
    state = np.full(len(words), -1, np.int64)
    state[ends] = words[ends]
    size = np.bincount(words[ends], minlength=n_words)
    first = np.zeros(n_words, np.int64)
    first[words[ends]] = ends
    shortest = np.ones(n_words, np.int64)
    for k in range(1, hi + 1):
        # The substrings of k + 1 words: their links are the substrings of k words that end at the same place.
        absorbed = np.zeros(len(size), bool)
        if k < hi:
            longer = np.zeros(len(words), bool)
            longer[1:] = valid[1:] & valid[:-1] & (joined[1:] if k == 1 else True)
            if seen is not None and k + 1 == lo - 1:
                longer &= seen
            at = np.flatnonzero(longer & fresh)
            keys, first_up, inverse, size_up = np.unique(state[at] * n_words + words[at - k], return_index=True, return_inverse=True, return_counts=True)
            link = keys // n_words
            same = size[link] == size_up
            shortest_up = np.where(same & (k >= lo), shortest[link], k + 1)
            absorbed[link[same]] = True
        if k >= lo:
            out = np.flatnonzero((size > 0) & ~absorbed)
            yield k, first[out], shortest[out], size[out]
        if k < hi:
            state = np.full(len(words), -1, np.int64)
            state[at] = inverse
            valid, size, first, shortest = longer, size_up, at[first_up], shortest_up


class _Shard:
    """Words of one language, as numbers in the order in which the shard met them."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.size = lang, {}, 0
        self.parts: list[np.ndarray] = []
        self.stale = 0

    def add(self, folded: bytes) -> None:
        """Takes words; breaks become -1."""
        coded = pc.split_pattern(pa.array([folded], pa.large_binary()), b" ").flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        number = np.array([-1 if w == b"\n" else -2 if not w else self.numbers.setdefault(w, len(self.numbers)) for w in own], np.int32)
        ids = number[coded.indices.to_numpy()]
        self.parts.append(ids[ids > -2])
        self.size += len(self.parts[-1])

    def tail(self, n: int) -> bytes:
        """The last `n` words or breaks."""
        names = list(self.numbers)
        last = np.concatenate(self.parts)[-n:] if n else []
        return b" ".join(b"\n" if i < 0 else names[i] for i in last)

    def states(self, lo: int, hi: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The automaton's states as rows (lang, phrase, shortest, n); with lo = 1 also the number of words, as phrase ""."""
        ids, names = np.concatenate(self.parts).astype(np.int64), pa.array(self.numbers, pa.binary())
        fresh = np.arange(len(ids)) >= self.stale
        seen = None
        if bitmap is not None:
            seed = xxhash.xxh64_intdigest(self.lang.encode(), _SEED)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in [*self.numbers, b"\n"]), np.uint64, len(names) + 1)
            own, h = hashes[ids], hashes[ids]
            for k in range(1, lo - 1):
                h[1:] = ((h[:-1] << np.uint64(1)) | (h[:-1] >> np.uint64(63))) ^ own[1:]
            seen = _passes(bitmap, h)

        def batch(phrases: pa.Array, shortest: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"lang": pa.array([self.lang] * len(n), pa.string()), "phrase": phrases.view(pa.string()), "shortest": pa.array(shortest, pa.int32()), "n": pa.array(n, pa.int64())})

        if lo == 1:
            yield batch(pa.array([b""], pa.binary()), np.ones(1, np.int64), np.array([int(((ids >= 0) & fresh).sum())]))
        for k, ends, shortest, n in automaton(ids, seen, fresh, lo, hi, len(names)):
            for part in range(0, len(ends), 100_000):
                rows = slice(part, part + 100_000)
                columns = [names.take(pa.array(ids[ends[rows] - back])) for back in range(k - 1, -1, -1)]
                yield batch(columns[0] if k == 1 else pc.binary_join_element_wise(*columns, b" "), shortest[rows], n[rows])


def _sharded(lo: int, hi: int, bitmap: Callable[[], np.ndarray | None], shard_words: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        held = 0

        def taken(waiting: dict[str, list[bytes]]) -> None:
            for lang, own in waiting.items():
                shards.setdefault(lang, _Shard(lang)).add(b" ".join(own))
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for shard in shards.values():
                yield from shard.states(lo, hi, bitmap())
            shards.clear()

        waiting: dict[str, list[bytes]] = defaultdict(list)
        for batch in sliced(batches, 50):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for folded, ended in chunks(text or b"", chunk):
                    waiting[lang].append(folded)
                    held += len(folded)
                    if held < min(shard_words, AT_ONCE):
                        continue
                    taken(waiting)
                    held = 0
                    if sum(x.size for x in shards.values()) >= shard_words:
                        # A text that goes on keeps the words that its next substrings start with; those are counted.
                        tail = b"" if ended else shards[lang].tail(hi - 1)
                        yield from flush()
                        if tail:
                            again = shards.setdefault(lang, _Shard(lang))
                            again.add(tail)
                            again.stale = again.size
        taken(waiting)
        yield from flush()

    return run


def phrase_counts(docs: DataFrame, lo: int, hi: int, bitmap: np.ndarray | None = None, shard_words: int = SHARD_WORDS, chunk: int = CHUNK) -> DataFrame:
    """`lang`, `phrase`, `n` of every substring of lo to hi words of `docs` (lang, text) that `bitmap` does not break; with lo = 1 phrase "" has the number of words."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    states = docs.mapInArrow(_sharded(lo, hi, lambda: sent.value, shard_words, chunk), "lang string, phrase string, shortest int, n long")
    if hi > lo:
        words = F.split("phrase", " ", -1)
        states = states.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.col("shortest"), F.size("words"))))
        states = states.select("lang", F.array_join(F.slice("words", -F.col("k"), F.col("k")), " ").alias("phrase"), "n")
    return states.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_filter(phrases: DataFrame, words: int) -> np.ndarray | None:
    """A Bloom filter of phrases of so many words, as 64-bit words; none if there are no phrases.

    Bits are set by an aggregate; at most MAX_BITS / 64 words come to the driver.
    """
    n = phrases.count()
    if not n:
        return None
    bits = min(MAX_BITS, max(1 << 12, 1 << (n * BITS_EACH - 1).bit_length()))
    part = [F.xxhash64("lang", F.split("phrase", " ", -1)[i]) for i in range(words)]
    h = reduce(lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b), part)
    at = phrases.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), by whole numbers of up to 38 digits."""
    thousand, a, n, left, right = (x.cast("decimal(38,0)") for x in (F.lit(1000), a, n, left, right))
    return F.call_function("div", thousand * a * n, left * right)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 100,
    max_words: int = 5,
    top: int | None = 2000,
    subsumed_percent: int = 100,
    shard_words: int = SHARD_WORDS,
    chunk: int = CHUNK,
) -> DataFrame:
    """`lang`, `rank` (from 1), `phrase`, `a`, `l`, `r`, `n`, `score` (long) of the `top` phrases of each language (all with None).

    Texts (null: empty) are lower-cased in A-Z and split at `[.,;:!?\\x0A-\\x0D]`
    into pieces, those into words `[^\\x20\\x09]+`; a null language is `und`. `n`
    counts all words of a language and f(phrase) all contiguous occurrences inside
    pieces, overlaps too. Phrases of 2 to `max_words` words with a = f(phrase) of
    `min_count` or more are scored by floor(1000 * a * n / (l * r)), l and r being
    the counts of the two parts at the cut that scores least (then the earliest).
    Phrases inside a longer one with 100 * f(longer) >= subsumed_percent * a go.
    Order: score, then a, descending, then phrase by UTF-8 bytes.

    Repeated rows count as often as they stand there; ids are not read and other
    columns may have any names. Texts of any length are cut into chunks whose
    substrings across the cut are counted once. An empty table, or one without a
    frequent phrase, gives an empty table. All arithmetic is exact below 38 digits.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = lambda lo, hi, bitmap: phrase_counts(rows, lo, hi, bitmap, shard_words, chunk)
    words = stash(counted(1, 1, None).filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")
    totals = words.filter(F.col("phrase") == "").select(F.col("lang").alias("of"), F.col("n").alias("words"))
    known = [words.filter(F.col("phrase") != "")]
    for lo, hi in [(2, 2), (3, min(3, max_words)), (4, max_words)]:
        bitmap = phrase_filter(known[-1], lo - 1) if lo <= max_words and hi >= lo else None
        if bitmap is None:
            break
        known.append(stash(counted(lo, hi, bitmap).filter(F.col("n") >= min_count), "phrases"))
    every = known[0]
    for more in known[1:]:
        every = every.union(more)
    phrases = every.filter(F.contains("phrase", F.lit(" "))).withColumn("w", F.split("phrase", " ", -1)).withColumn("k", F.size("w"))
    # Links to the phrases a word shorter: without the first and without the last word.
    links = phrases.filter("k > 2").select("lang", F.explode(F.array(F.slice("w", F.lit(2), F.col("k") - 1), F.slice("w", F.lit(1), F.col("k") - 1))).alias("w"), "n")
    longer = links.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("n").alias("above"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < subsumed_percent * F.col("n")))
    cut = kept.select("lang", "phrase", F.col("n").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("head"), F.array_join(F.slice("w", F.col("at") + 1, F.col("k") - F.col("at")), " ").alias("rest"))
    table = few(every, LOOKUP_ROWS)
    for part, count in (("head", "l"), ("rest", "r")):
        cut = cut.join(table.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    cut = cut.join(few(totals), F.col("lang") == F.col("of")).withColumn("score", score_of(F.col("a"), F.col("words"), F.col("l"), F.col("r")))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r", F.col("words").alias("n"))).alias("b"))
    scored = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.n").alias("n"), F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), lists AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 6) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 100),
links AS (SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM cand WHERE k > 2 UNION ALL SELECT lang, array_to_string(w[:k - 1], ' '), a FROM cand WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS above FROM links GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer g USING (lang, phrase) WHERE g.above IS NULL OR g.above < c.a),
cuts AS (SELECT *, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.n AS l, e.n AS r, t.n, cut, ((1000::HUGEINT * c.a * t.n) // (h.n::HUGEINT * e.n))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f e ON e.lang = c.lang AND e.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""
