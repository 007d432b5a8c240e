"""N-gram Jaccard join with Bayesian candidate pruning.

1. A text becomes its set of word shingles (64-bit hashes), a digest of the set
   and min-hashes. Texts of one set collapse to one representative.
2. Bands of min-hashes are the candidate search. Only buckets that two sets
   share go on. Inside a bucket, pairs are compared by growing parts of their
   signatures; a pair whose posterior probability of reaching the threshold
   falls below `tolerance` is dropped. What survives is kept as a spanning
   forest of the bucket, never as its pairs.
3. The forests' components bring related sets together. There all surviving
   pairs are verified exactly on their shingles, and links are counted.

Buckets and components of any size are cut into blocks of bounded size; a task
compares two blocks, and gives back a row for each set, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import BROADCAST_ROWS, discard, few, free_names, packed, partitions, sliced, stash
from panelspark.llm.components import components

WORDS = 5
THRESHOLD = (4, 5)  # similarity of 4 / 5 or more
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature lengths at which the posterior is looked at.
STEPS = (16, 32, 64, HASHES)
TOLERANCE = 1e-9
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1_000_000
_seed = np.random.default_rng(20240229)
_MULTIPLY = _seed.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seed.integers(0, 2**63, HASHES, dtype=np.uint64)
_ORDER = _seed.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted: hashes of `words` words in a row (runs without ASCII white space).

    A text of fewer words has one shingle, all of them; a text without words has none.
    """
    found = (text or "").encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(hashes) - width + 1
    total = np.full(n, np.uint64(width))
    for i in range(width):
        total += hashes[i : i + n] * _ORDER[i]
    return np.unique(_mix(total))


def signature(own: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        for i in range(0, HASHES, 16):
            out[i : i + 16] = np.minimum(out[i : i + 16], (part[None, :] * _MULTIPLY[i : i + 16, None] + _ADD[i : i + 16, None]).min(axis=1))
    return out


def buckets(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = _mix(mins.reshape(BANDS, ROWS))
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        total = _mix(total + rows[:, i] * _ORDER[i])
    return total


@lru_cache
def least_matches(hashes: int, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of `hashes` at which P(similarity >= threshold | matches) reaches `tolerance`.

    With a uniform prior the posterior is Beta(s + 1, m - s + 1), and its upper
    tail is a binomial sum: P(Binomial(m + 1, threshold) <= s).
    """
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for s in range(hashes + 1):
        total += math.comb(hashes + 1, s) * t**s * (1 - t) ** (hashes + 1 - s)
        if total >= tolerance:
            return s
    return hashes


def survivors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that no step prunes; signatures are a byte a hash, so chance matches only keep more."""
    n = STEPS[0]
    count = np.zeros((len(left), len(right)), np.int16)
    for k in range(n):
        count += left[:, k][:, None] == right[:, k][None, :]
    a, b = np.nonzero(count >= least_matches(n))
    found = count[a, b].astype(np.int32)
    for m in STEPS[1:]:
        for at in range(0, len(a), 1 << 18):  # in parts of bounded memory
            part = slice(at, at + (1 << 18))
            found[part] += (left[a[part], n:m] == right[b[part], n:m]).sum(axis=1, dtype=np.int32)
        keep = found >= least_matches(m)
        a, b, found, n = a[keep], b[keep], found[keep], m
    return a, b


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of `n` nodes' components: labels go down along edges until nothing moves."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: `doc_id`, `digest` of the shingle set (null: no words), `n` shingles, `sig`, `bands`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digests, sizes, sigs, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                mins = signature(own)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sigs.append((_mix(mins) & np.uint64(255)).astype(np.uint8).tobytes())
                bands.append(buckets(mins).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n", "sig", "bands"],
            )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, n long, sig binary, bands array<long>")


def _groups(key_columns: int):
    """Cuts the sorted rows of a task into its groups, as tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)]) if key_columns else None
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[:, lo])
                if key != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    return run


def _blocks(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Deals each key's rows to pairs of blocks: `lo`, `hi` and `side` (which of the two; 2: both) are added.

    `sizes` holds `key` and its number of blocks `nb`; a row goes to `nb` pairs.
    """
    one = rows.join(sizes, key)
    block = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    one = one.withColumn("__b", block).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return one.withColumn("lo", F.least("__b", "__o")).withColumn("hi", F.greatest("__b", "__o")).withColumn("side", F.when(F.col("__b") == F.col("__o"), 2).otherwise((F.col("__b") > F.col("__o")).cast("int"))).drop("__b", "__o", "nb")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the first and of the second block; one block with itself is both."""
    side = table.column("side").to_numpy()
    if (side == 2).all():
        every = np.arange(len(side))
        return every, every, True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (`u`, `v`) of forests over the pairs that share a bucket and survive pruning; `sets` has id, sig and bands."""
    rows = sets.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    sizes = stash(sizes.select("bucket", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("nb")), "buckets")
    many = rows.join(sizes.select("bucket"), "bucket", "left_semi").join(sets.select("id", "sig"), "id")
    dealt = _blocks(many, "bucket", sizes).select("bucket", "lo", "hi", "side", "id", "sig")
    width = partitions(sets.sparkSession)
    dealt = dealt.repartition(width, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        out: list[tuple[bytes, bytes]] = []
        for table in _groups(3)(batches):
            ids = table.column("id").to_pylist()
            if len(ids) < 2:
                continue
            if len(ids) == 2:  # most buckets: the same pair of sets again and again
                pair = (ids[0], ids[1]) if ids[0] < ids[1] else (ids[1], ids[0])
                if pair in done:
                    continue
                done.add(pair)
                if len(done) > 200_000:
                    done.clear()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), HASHES)
            left, right, same = _sides(table)
            a, b = survivors(sig[left], sig[right])
            a, b = left[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            label = _forest(len(ids), a, b)
            out += [(ids[i], ids[j]) for i, j in enumerate(label) if i != j]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["u", "v"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["u", "v"])

    out = stash(dealt.mapInArrow(run, "u binary, v binary").distinct(), "pairs")
    discard(sizes)
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (row of left, row of right) reach the threshold, exactly."""
    inter = np.zeros(len(a), np.int64)
    if len(a) <= 4 * (len(left) + len(right)):
        for k, (i, j) in enumerate(zip(a, b, strict=True)):
            inter[k] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:
        known, often = np.unique(np.concatenate(left if left is right else [*left, *right]), return_counts=True)
        known = known[often > 1]
        dense = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]

            def flags(sets: list[np.ndarray], part=part) -> np.ndarray:
                grid = np.zeros((len(sets), len(part)), np.float32)
                for k, own in enumerate(sets):
                    own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], side="right")]
                    grid[k, np.searchsorted(part, own[np.isin(own, part, assume_unique=True)])] = 1
                return grid

            dense += flags(left) @ flags(right).T
        inter = dense[a, b].astype(np.int64)
    union = np.array([len(x) for x in left], np.int64)[a] + np.array([len(x) for x in right], np.int64)[b] - inter
    return THRESHOLD[1] * inter >= THRESHOLD[0] * union


def verify(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """`id`, `root` and `links` of each set and block pair; `members` has comp, id, copies, sig and sh (shingle bytes)."""
    dealt = _blocks(members, "comp", sizes).select("lo", "hi", F.xxhash64("comp").alias("c"), "side", "id", "copies", "sig", "sh")
    dealt = dealt.repartition(partitions(members.sparkSession), "c", "lo", "hi").sortWithinPartitions("c", "lo", "hi").select("c", "lo", "hi", "side", "id", "copies", "sig", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(3)(batches):
            ids, copies = table.column("id").to_pylist(), table.column("copies").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), HASHES)
            sets = [np.frombuffer(x, np.uint64) for x in table.column("sh").to_pylist()]
            left, right, same = _sides(table)
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            if len(left) and len(right):
                a, b = survivors(sig[left], sig[right])
                if same:
                    a, b = a[a < b], b[a < b]
                ours = [sets[i] for i in left]
                good = linked_pairs(ours, ours if same else [sets[i] for i in right], a, b)
                a, b = left[a[good]], right[b[good]]
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                label = _forest(len(ids), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([ids[i] for i in label], pa.binary()), pa.array(links.astype(np.int64))], ["id", "root", "links"])

    return dealt.mapInArrow(run, "id binary, root binary, links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: `doc_id`, `digest`, `class_key`, `class_id` and `n_links`.

    Two rows are linked if the Jaccard similarity of their shingle sets (see
    `shingles`) is 4/5 or more. `class_id` is the least doc_id of all that links
    connect, `class_key` (null without words) tells classes apart by content; `n_links` counts the other rows a row is linked to, copies included.
    Null, empty and blank texts have no shingles and no links: each such row is
    its own class. Rows without an id take part; a class of nothing else has a
    null class_id. Repeated rows are copies of each other. Extra columns are
    ignored, and an empty table gives no rows.
    """
    base = stash(sketch(docs, id_col, text_col), "sketch")
    sets = base.filter(F.col("digest").isNotNull()).groupBy(F.col("digest").alias("id")).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands")
    )
    sets = stash(sets, "sets")
    pairs = candidates(sets)
    found = components(pairs).withColumnRenamed("root", "comp")
    discard(pairs)
    most = sets.count()
    want = stash(packed(found.join(sets.select("id", "first_id", "copies", "n", "sig"), "id").select("comp", "id", "first_id", "copies", "n", "sig"), most), "want")
    sizes = want.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    sizes = stash(packed(sizes, most), "sizes")
    shingled = _with_shingles(docs, want.drop("n"), id_col, text_col)
    linked = stash(verify(shingled, sizes), "links")
    discard(want, sizes, shingled)
    classes = components(linked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    labels = sets.select("id", "first_id", "copies").join(classes, "id", "left").join(links, "id", "left").select("id", "first_id", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    labels = stash(packed(labels, most), "labels")
    discard(sets, linked, classes)
    least = labels.groupBy("root").agg(F.min("first_id").alias("class_id"))
    labels = labels.join(least, "root").select(F.col("id").alias("digest"), F.col("root").alias("class_key"), "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    out = base.select("doc_id", "digest").join(labels, "digest", "left")
    return out.select("doc_id", "digest", "class_key", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_shingles(docs: DataFrame, want: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`want` with the shingles of its sets, read again from the text of each set's first row."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    ids = want.select(F.col("first_id").alias("i")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        own = own.join(F.broadcast(ids), F.col("d").eqNullSafe(F.col("i")), "left_semi")
    rows = own.join(want, F.col("d").eqNullSafe(F.col("first_id"))).select("comp", "id", "copies", "sig", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingles(t).tobytes() for t in batch.column(4).to_pylist()]
            keep = [i for i, x in enumerate(data) if xxhash.xxh3_128_digest(x) == batch.column(1)[i].as_py()]  # ids may repeat
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([data[i] for i in keep], pa.binary())], ["comp", "id", "copies", "sig", "sh"])

    made = rows.mapInArrow(run, "comp binary, id binary, copies long, sig binary, sh binary")
    once = stash(made, "shingles")
    again = once.groupBy("id").count().filter("count > 1").select("id")
    if again.isEmpty():
        return once
    # A set whose first id stands on several rows: one of them is enough.
    extra = once.join(again, "id", "left_semi").groupBy("id").agg(*[F.max(c).alias(c) for c in ("comp", "copies", "sig", "sh")])
    out = stash(once.join(again, "id", "left_anti").unionByName(extra.select(*once.columns)), "shingles")
    discard(once)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay if one of each class does: that of the least id.

    Rows without words all stay. Where the least id stands on several rows of a
    class, or no row of it has an id, any one of them stays. Columns of any name pass through.
    """
    labels = stash(near_duplicates(docs, id_col, text_col), "classes")
    lead = labels.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("digest").isNotNull())
    odd_id, gone_id = free_names(docs.columns, "odd", "gone")
    odd = stash(lead.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("doc_id").isNull() | (F.col("n") > 1)).select(F.col("doc_id").alias(odd_id)), "odd")
    gone = labels.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(gone_id)).distinct()
    own = F.col(f"`{id_col}`").cast("long")
    if odd.isEmpty():
        return docs.join(few(gone), own.eqNullSafe(F.col(gone_id)), "left_anti")
    gone = gone.join(odd, F.col(gone_id).eqNullSafe(F.col(odd_id)), "left_anti")
    plain = docs.join(few(gone), own.eqNullSafe(F.col(gone_id)), "left_anti").join(few(odd), own.eqNullSafe(F.col(odd_id)), "left_anti")
    whole = docs.join(few(odd), own.eqNullSafe(F.col(odd_id)), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).field(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())], ["doc", "digest"])

    rows = whole.mapInArrow(digested, T.StructType([*whole.schema.fields, T.StructField("digest", T.BinaryType())]))
    classes = lead.select(F.col("doc_id").alias("id"), F.col("digest").alias("known"), F.col("class_key").alias("class")).distinct()
    several = rows.join(classes, (F.col("digest") == F.col("known")) & F.col("doc")[id_col].cast("long").eqNullSafe(F.col("id"))).dropDuplicates(["class"])
    back = [F.col("doc")[c].alias(c) for c in docs.columns]
    return plain.unionByName(rows.filter(F.col("digest").isNull()).select(*back)).unionByName(several.select(*back))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
