"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

1. Blocking: a text that holds fewer of the benchmark's shingles than the item
   that needs fewest cannot match, and goes no further. This loses nothing.
2. Every item has a fingerprint, the SimHash of its pairs of words, and so have
   windows of its size that slide over the texts left, at starts and in sizes of
   whole units of a few words.
3. Multi-index: a fingerprint is cut into BLOCKS blocks. Of two that differ in
   `radius` bits or fewer, one block differs in radius / BLOCKS bits or fewer.
   Items are indexed under all such neighbours of each block, and windows are
   looked up by theirs, so none within the radius is missed.
4. What is within the radius, and shares the pairs that it must share, is verified
   exactly by the weighted similarity of the shingles, at every start near by.

A SimHash takes a majority vote of the pairs' hashes for each bit. The votes of
several bits are counted side by side in one long, and a start's units are added
up once for windows of all sizes. One changed word changes five shingles but two
pairs: that is why pairs vote, and shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import few, free_names, stash, text_key

WORDS = 5
SIMILARITY = 0.8
#: Pairs of neighbouring words vote in a SimHash: so many make a shingle.
PAIRS = WORDS - 1
BLOCKS = 4
#: Items in one pass over the documents: their index, at most 1,880 rows an item, is broadcast.
ITEMS_A_PASS = 1_000
#: Bits by which fingerprints of 56, 48 or 32 bits (by the width of a counter) of windows of SIMILARITY differ at most; README has the recall measured.
RADIUS = {8: 15, 16: 11, 32: 7}
#: Benchmark shingles up to which they are broadcast (about 100 bytes each); beyond, a shuffle join.
BROADCAST_SHINGLES = 200_000


def _pairs(own: Column) -> Column:
    """The hashes of an array of words' neighbouring pairs, in order."""
    n = F.greatest(F.size(own) - 1, F.lit(0))
    return F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


@dataclass(frozen=True)
class Grid:
    """Windows of items of up to `longest` words: they start at every `unit`-th word and are made of whole units.

    Votes are counted by `width` bits side by side in a long; the topmost counter
    stays free, so that nothing overflows.
    """

    unit: int
    longest: int
    width: int
    radius: int

    @staticmethod
    def all() -> Iterator[Grid]:
        """Units of 1, 4, 16, ... words, for items of 12, 64, 256, ... words."""
        unit = 1
        while unit < 1 << 26:
            longest = 12 if unit == 1 else 16 * unit
            width = next(w for w in RADIUS if longest < 1 << (w - 1))
            yield Grid(unit, longest, width, RADIUS[width])
            unit *= 4

    @property
    def lanes(self) -> int:
        return 64 // self.width - 1

    @property
    def bits(self) -> int:
        return self.lanes * self.width

    def words(self, n: int) -> int:
        """Words of the window for an item of `n`: the nearest number of units, of pairs of them in long windows."""
        step = self.unit if n <= 8 * self.unit else 2 * self.unit
        return max(1, (n + step // 2) // step) * step

    def ones(self) -> int:
        return sum(1 << self.width * k for k in range(self.lanes))

    def votes(self, h: str, group: int) -> str:
        """SQL of the bits of a word's hash that a group counts, one in each lane; a null has none."""
        spread = sum(1 << (self.width - 1) * k for k in range(self.lanes))
        return f"coalesce(((shiftrightunsigned({h}, {self.lanes * group}) & {(1 << self.lanes) - 1}L) * {spread}L) & {self.ones()}L, 0L)"

    def unit_votes(self, w: str, start: str, units: int) -> list[Column]:
        """Columns v<unit>_<group>: the votes of each unit of the array `w` from the word `start` on."""
        unit = lambda u, j: " + ".join(self.votes(f"get({w}, {start} + {u * self.unit + i})", j) for i in range(self.unit))
        return [F.expr(unit(u, j)).alias(f"v{u}_{j}") for u in range(units) for j in range(self.width)]

    def fingerprint(self, words: int, left: str) -> Column:
        """Of the units that make up `words` words, of which there are `left` at most: the majority of each bit's votes."""
        short = f"cast({(1 << (self.width - 1)) - 1} - shiftright(least({words}, {left}), 1) AS BIGINT) * {self.ones()}L"
        sums = [" + ".join(f"v{u}_{j}" for u in range(-(-words // self.unit))) for j in range(self.width)]
        bits = [f"shiftleft(shiftrightunsigned(({x} + {short}) & {self.ones() << (self.width - 1)}L, {self.width - 1}), {j})" for j, x in enumerate(sums)]
        return F.expr(" | ".join(bits))

    def keys(self, words: Column, fp: Column) -> Column:
        """What the index is looked up by: the window's words, a block's number and the block."""
        size = self.bits // BLOCKS
        block = lambda b: F.shiftrightunsigned(fp, b * size).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        return F.array(*[F.shiftleft(words.cast("long") * BLOCKS + b, size).bitwiseOR(block(b)) for b in range(BLOCKS)])

    def neighbours(self) -> list[int]:
        """What a block may differ in: all words of radius / BLOCKS bits or fewer."""
        return [sum(1 << i for i in c) for n in range(self.radius // BLOCKS + 1) for c in combinations(range(self.bits // BLOCKS), n)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (null: none)."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(clean, " "), lambda x: x != "")


def _grams(own: Column) -> Column:
    """The shingles of an array of words as structs, in order; with the words that lack a whole shingle at the end."""
    return F.arrays_zip(*[F.slice(own, i + 1, 2**30).alias(f"w{i}") for i in range(WORDS)])


def shingles(rows: DataFrame, keep: list[str], own: str) -> DataFrame:
    """`keep` and `sh`, the hash of each shingle of the word array `own` (the same hashes as `_hashes` has)."""
    out = rows.select(*keep, F.size(own).alias("__n"), F.posexplode(_grams(F.col(own))).alias("pos", "g"))
    out = out.filter((F.col("pos") <= F.col("__n") - WORDS) | ((F.col("pos") == 0) & (F.col("__n") > 0)))
    return out.select(*keep, F.xxhash64(*[F.col(f"g.w{i}") for i in range(WORDS)]).alias("sh"))


def _hashes(own: Column) -> Column:
    """The hashes of an array of words' shingles, in order (fewer words than a shingle has: one, padded with nulls; none: none)."""
    grams = F.transform(_grams(own), lambda g: F.xxhash64(*[g[f"w{i}"] for i in range(WORDS)]))
    return F.slice(grams, 1, F.greatest(F.size(own) - WORDS + 1, F.lit(1)))


def _apart() -> Column:
    """One row for a row. Between votes and fingerprints it keeps the optimizer from writing all votes into one expression, too long to be compiled."""
    return F.explode(F.array(F.lit(0)))


def _search(texts: DataFrame, items: DataFrame, grid: Grid, lengths: list[int]) -> DataFrame:
    """`key`, `item`, `lo`, `hi`: starts of windows near items. `texts` has key, n and w (hashes of pairs of words); `items` item, n and w; `lengths` are the items' numbers of pairs."""
    sizes: dict[int, list[int]] = {}
    for n in lengths:
        sizes.setdefault(grid.words(n), []).append(n)
    units = -(-max(*sizes, *lengths) // grid.unit)
    # The index: each item under all neighbours of its blocks. An item's own words are its window.
    own = items.select("item", "n", *grid.unit_votes("w", "0", units)).withColumn("apart", _apart())
    of = reduce(lambda other, w: F.when(F.col("n").isin(sizes[w]), F.lit(w)).otherwise(other), sizes, F.lit(0))
    own = own.select("item", of.alias("words"), grid.fingerprint(units * grid.unit, "n").alias("ifp"))
    index = own.select("item", "ifp", F.explode(grid.keys(F.col("words"), F.col("ifp"))).alias("b"))
    near = F.explode(F.array(*[F.lit(x).cast("long") for x in grid.neighbours()])).alias("x")
    index = stash(index.select("item", "ifp", "b", near).select("item", "ifp", F.col("b").bitwiseXOR(F.col("x")).alias("b")), "index")
    # The pairs an item must share: a missing shingle costs one of its distinct pairs at most.
    must = items.select("item", "n", F.array_distinct("w").alias("iw")).select("item", "iw", (F.size("iw") - F.floor((F.col("n") - PAIRS + 1) * (1 - SIMILARITY) + 1e-9)).alias("need"))
    # The windows: documents in rows of bounded length, then a row for each start.
    reach = units * grid.unit
    chunk = 3 * max(reach, 64)
    rows = texts.select("key", "n", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(chunk))).alias("from"))
    rows = rows.select("key", (F.col("n") - F.col("from")).alias("n"), "from", F.slice("w", F.col("from") + 1, F.lit(chunk + reach)).alias("w"))
    fewest = {w: max(PAIRS, math.floor(SIMILARITY * (min(ns) - PAIRS + 1)) + PAIRS - 1) for w, ns in sizes.items()}  # that a window at a text's end must have
    last = F.least(F.lit(chunk - 1), F.col("n") - min(fewest.values()))
    rows = rows.withColumn("start", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(grid.unit)))))
    rows = rows.select("key", "from", "w", "start", (F.col("n") - F.col("start")).alias("left"), *grid.unit_votes("w", "start", units)).withColumn("apart", _apart())
    rows = rows.select("key", "from", "w", "start", "left", *[grid.fingerprint(w, "left").alias(f"f{w}") for w in sorted(sizes)])
    prints = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(fewest[w]).alias("fewest"), F.col(f"f{w}").alias("fp")) for w in sorted(sizes)])
    rows = rows.select("key", "from", "w", "start", "left", F.explode(prints).alias("z")).filter(F.col("left") >= F.col("z.fewest")).select("key", "from", "w", "start", "z.words", "z.fp")
    probes = rows.select("*", F.explode(grid.keys(F.col("words"), F.col("fp"))).alias("b"))
    hits = probes.join(F.broadcast(index), "b").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= grid.radius)
    hits = hits.join(F.broadcast(must), "item")
    around = F.slice("w", F.greatest(F.col("start") - grid.unit, F.lit(0)) + 1, F.col("words") + 3 * grid.unit)
    hits = hits.filter(F.size(F.array_intersect("iw", around)) >= F.col("need"))
    at = F.col("from") + F.col("start")
    return hits.select("key", "item", F.greatest(at - grid.unit, F.lit(0)).alias("lo"), (at + grid.unit).alias("hi"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`doc_id`, `item_id`, `start` and `similarity` of each document row and item that match, see `leaked_texts`. Null ids stay."""
    best = stash(leaked_texts(docs, benchmark, text_col, item_col, item_text), "leaks")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("key"))
    return own.join(few(best), "key").select("doc_id", "item_id", "start", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without a match, whatever their ids. Columns of any name pass through."""
    (key,) = free_names(docs.columns, "key")
    gone = stash(leaked_texts(docs, benchmark, text_col, item_col, item_text).select(F.col("key").alias(key)).distinct(), "leaks")
    return docs.join(few(gone), text_key(F.col(f"`{text_col}`")) == F.col(key), "left_anti")


def leaked_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: bool = True) -> DataFrame:
    """`key` (content key of a text), `item_id`, `start` (word offset of the first best window) and `similarity`, a row for each distinct text and item that reach SIMILARITY.

    Words are lower-cased runs of letters and digits, shingles are WORDS of them.
    The similarity of a window and an item is the sum of the least over the sum of
    the greatest counts of each shingle. Null or empty texts and items match
    nothing; items shorter than a shingle match only documents of the same words. Equal items
    each match. `block` leaves out texts that share too few shingles with the whole benchmark
    to match any item; without it all windows of all texts are fingerprinted, for the same
    result. Repeated rows are one text. Extra columns are ignored, and an empty table on either side gives no rows.
    """
    own = docs.select(text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), words(F.col(f"`{item_text}`")).alias("own")).filter(F.size("own") > 0)
    items = items.select("item_id", _pairs(F.col("own")).alias("w"), _hashes(F.col("own")).alias("h"))
    items = stash(items.withColumn("n", F.size("w")).withColumn("size", F.size("h")).withColumn("item", F.monotonically_increasing_id()), "items")
    parts = items.select("item", "item_id", "size", F.explode("h").alias("sh"))
    counts = parts.groupBy("item", "sh").agg(F.count(F.lit(1)).alias("n"))
    fits = parts.count() <= BROADCAST_SHINGLES
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # one number for each length of an item

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if fits else df

    texts = own
    if block:  # A text must hold as many of the benchmark's shingles as the item that needs fewest.
        need = items.agg(F.min(F.ceil(SIMILARITY * F.col("size") - 1e-9))).first()[0] or 1
        shared = shingles(own.select("key", words(F.col("text")).alias("own")), ["key"], "own").join(small(parts.select("sh").distinct()), "sh", "left_semi")
        enough = stash(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).select("key"), "shared")
        texts = own.join(few(enough), "key", "left_semi")
    hashed = stash(texts.groupBy("key").agg(F.first("text").alias("text")).select("key", words(F.col("text")).alias("own")), "texts")
    texts = hashed.select("key", _pairs(F.col("own")).alias("w")).select("key", F.size("w").alias("n"), "w")
    found, least = [], PAIRS
    for grid in Grid.all():
        fit = [n for n in lengths if least <= n <= grid.longest]
        least = max(least, grid.longest + 1)
        group = items.filter(F.col("n").between(fit[0], fit[-1])) if fit else None
        passes = -(-group.count() // ITEMS_A_PASS) if fit else 0
        found += [_search(texts, group.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), grid, fit) for i in range(passes)]
    if lengths and lengths[0] < PAIRS:
        tiny = hashed.filter(F.size("own") < WORDS).select("key", F.explode(_hashes(F.col("own"))).alias("sh"))
        found.append(tiny.join(small(parts.join(items.filter(F.col("n") < PAIRS).select("item"), "item", "left_semi")), "sh").select("key", "item", F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    if not found:
        return own.select("key", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("similarity")).limit(0)
    hits = reduce(DataFrame.union, [x.select("key", "item", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")) for x in found])
    hits = stash(hits.groupBy("key").agg(F.collect_set(F.struct("item", "lo", "hi")).alias("windows")), "found")
    # Exact: the windows' shingles.
    read = hashed.join(hits, "key")
    every = F.array_distinct(F.flatten(F.transform("windows", lambda x: F.transform(F.sequence(x["lo"], x["hi"]), lambda s: F.struct(x["item"].alias("item"), s.alias("start"))))))
    cut = read.select("key", _hashes(F.col("own")).alias("h"), every.alias("x")).select("key", "h", F.explode("x").alias("x")).select("key", "x.item", "x.start", "h")
    cut = cut.join(small(items.select("item", "item_id", "size", F.array_distinct("h").alias("ih"))), "item").select("key", "item", "item_id", "size", "start", "ih", F.slice("h", F.col("start") + 1, F.col("size")).alias("h"))
    cut = cut.filter(F.size(F.array_intersect("ih", "h")) >= F.size("ih") - F.floor(F.col("size") * (1 - SIMILARITY) + 1e-9))
    cut = stash(cut.drop("ih"), "windows")
    have = cut.select("key", "item", "item_id", "size", "start", F.size("h").alias("all"), F.explode("h").alias("sh")).groupBy("key", "item", "item_id", "size", "start", "all", "sh").agg(F.count(F.lit(1)).alias("m"))
    both = have.join(small(counts), ["item", "sh"]).groupBy("key", "item", "item_id", "size", "start", "all").agg(F.sum(F.least("m", "n")).alias("shared"))
    # Sum of the least over sum of the greatest counts.
    both = both.withColumn("similarity", F.col("shared") / (F.col("all") + F.col("size") - F.col("shared")))
    best = both.filter(F.col("similarity") >= SIMILARITY).groupBy("key", "item", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("key", "item_id", (-F.col("best")["col2"]).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest(range(greatest(1, len(w) - {WORDS - 1}))) AS pos, unnest(list_transform(range(greatest(1, len(w) - {WORDS - 1})), lambda i: array_to_string(w[i + 1 : i + {WORDS}], ' '))) AS sh FROM d WHERE len(w) > 0),
bs AS (SELECT item_id, greatest(1, len(w) - {WORDS - 1}) AS size, unnest(list_transform(range(greatest(1, len(w) - {WORDS - 1})), lambda i: array_to_string(w[i + 1 : i + {WORDS}], ' '))) AS sh FROM b WHERE len(w) > 0),
bc AS (SELECT item_id, size, sh, count(*) AS n FROM bs GROUP BY ALL),
met AS (SELECT doc_id, item_id, size FROM (SELECT DISTINCT doc_id, item_id, size, sh, n FROM ds JOIN bc USING (sh)) GROUP BY ALL HAVING sum(n) >= {SIMILARITY} * size),
starts AS (SELECT DISTINCT doc_id, item_id, size, pos AS start FROM met JOIN ds USING (doc_id)),
win AS (SELECT doc_id, item_id, s.size, start, ds.sh, count(*) AS m FROM starts s JOIN ds USING (doc_id) WHERE ds.pos >= start AND ds.pos < start + s.size GROUP BY ALL),
sim AS (SELECT win.doc_id, win.item_id, win.start, sum(least(m, coalesce(n, 0))) AS shared, sum(m) AS tot, any_value(win.size) AS size
        FROM win LEFT JOIN bc ON bc.item_id = win.item_id AND bc.sh = win.sh GROUP BY ALL)
SELECT doc_id, item_id, arg_max(start, (shared / (tot + size - shared), -start))::BIGINT AS start, round(max(shared / (tot + size - shared)), 6) AS similarity
FROM sim WHERE shared / (tot + size - shared) >= {SIMILARITY} GROUP BY doc_id, item_id
"""
