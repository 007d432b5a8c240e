"""Exact substring dedup over suffix arrays of shards.

Every `length`-byte string of a text has one anchor: the `gram`-byte string in it
with the least hash (the first of those). Equal strings have equal anchors, so

1. texts are cut into runs of string starts with one anchor hash; a hash that
   occurs at one place only cannot hold a repeated string and its run is done;
2. the other runs, each with the bytes its strings cover, are dealt to shards by
   the hash: all places of a repeated string meet in one shard;
3. a shard sorts its suffixes by induced sorting and computes the permuted common
   prefixes; a start whose prefix with a neighbour reaches `length` is repeated.

Copies of whole texts are told apart from the start and only one of them takes
part. A hash at very many places is not sorted in one shard: its strings are
counted by their 128-bit digests, which splits over any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import discard, few, partitions, stash, text_key
from panelspark.llm.jaccard_join import _groups, _mix
from panelspark.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
GRAM = 32
#: Bytes of runs in a shard, about; and runs of one hash beyond which it is hot.
SHARD_BYTES = 1_000_000
HOT_RUNS = 1000
SALTS = 32
_CHUNK = 1 << 16


def _rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on (shorter at the end)."""
    total, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = 0x9E3779B97F4A7C15

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros_like(x)
        moved[: max(0, len(x) - by)] = x[by:]
        return moved

    while True:  # by the binary digits of `gram`
        if gram & width:
            out = total if out is None else out + ahead(total, done) * np.uint64(pow(0xD6E8FEB86659FD93, done, 1 << 64))
            done += width
        if done == gram:
            return _mix(out)
        total = total + ahead(total, width) * np.uint64(power)
        power = (power * power * 3 + 2) % (1 << 64)
        width *= 2


def _least_ahead(value: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each position on."""
    reach, now = 1, value

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((x[by:], np.full(min(by, len(x)), np.uint64(2**64 - 1))))

    while reach * 2 <= width:
        now = np.minimum(now, shifted(now, reach))
        reach *= 2
    return np.minimum(now, shifted(now, width - reach)) if reach < width else now


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """Runs (text, first start, last start, anchor hash, whether the hash is at two places of the run) of texts of `length` bytes or more."""
    out: list[tuple[int, int, int, int, bool]] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < _CHUNK):
            if len(texts[at]) >= length:
                group.append(at)
                size += len(texts[at])
            at += 1
        if not group:
            continue
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        bits = np.uint64(max(1, len(data) - 1).bit_length())
        hashes = _rolling(data, gram)
        place = np.arange(len(data), dtype=np.uint64)
        best = _least_ahead((hashes >> bits << bits) | place, length - gram + 1)
        anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        base = 0
        for i in group:
            own = anchor[base : base + len(texts[i]) - length + 1]
            key = hashes[own]
            cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            lasts = np.append(cuts[1:], len(own)) - 1
            many = own[cuts] != own[lasts]
            out += zip([i] * len(cuts), cuts.tolist(), lasts.tolist(), key[cuts].astype(np.int64).tolist(), many.tolist(), strict=True)
            base += len(texts[i])
    return out


def _merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that sorted starts cover, as intervals that neither touch nor overlap."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.append(0, cuts)].tolist(), (starts[np.append(cuts, len(starts)) - 1] + length).tolist(), strict=True))


def repeated_in(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the sorted starts of the `length`-byte strings that start at another place of the contexts too."""
    single = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff" + b"\0" * 8, np.uint8)
    n = len(data) - 8
    t = data[:n].astype(np.int64) + single
    t[first + sizes] = np.arange(single)
    ends = np.repeat(first + sizes, sizes + 1)
    order = suffix_array(t, single)
    prefix, phi = common_prefixes(data, ends, order, t)
    long = np.flatnonzero(prefix >= length)
    hit = np.zeros(n, bool)
    hit[long] = True
    hit[phi[long]] = True
    at = np.flatnonzero(hit)
    owner = np.searchsorted(first, at, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(single + 1))
    return [at[a:b] - f for a, b, f in zip(cuts, cuts[1:], first, strict=False)]


def _span_batch(spans: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans], pa.binary()), pa.array([s[1] for s in spans], pa.int64()), pa.array([s[2] for s in spans], pa.int64())], ["key", "lo", "hi"])


def repeated_spans(docs: DataFrame, text_col: str, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): `key` and `text` of the distinct texts that may hold repeats, and `key`, `lo`, `hi` of bytes that repeated strings cover."""
    width = partitions(docs.sparkSession)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs_of(batch.column(1).to_pylist(), length, gram)
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())],
                ["key", "s0", "s1", "hash", "many"],
            )

    source = docs.select(text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).filter(F.length("text") >= length)
    runs = stash(source.mapInArrow(anchors, "key binary, s0 long, s1 long, hash long, many boolean"), "runs")
    place = F.struct("key", "s0")
    again = runs.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("many").alias("many")).filter("a != b or many").select("hash")
    hits = stash(runs.join(again, "hash").groupBy("key", "s0", "s1").agg(F.max("hash").alias("hash")), "hits")
    hot = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_runs).select("hash", F.lit(True).alias("hot"))
    by_text = hits.join(hot, "hash", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s0", "s1", "hash", F.coalesce("hot", F.lit(False)).alias("hot")))).alias("runs"))
    by_text = stash(by_text, "by_text")
    wanted = source.join(few(by_text.select("key")), "key", "left_semi")
    texts = wanted.groupBy("key").agg(F.first("text").alias("text")).join(by_text, "key")
    texts = stash(texts, "texts")
    discard(runs, by_text)
    total = hits.agg(F.coalesce(F.sum(F.col("s1") - F.col("s0") + length), F.lit(0))).first()[0]
    shards = max(1, int(total // shard_bytes))
    exploded = texts.select("key", "text", F.explode("runs").alias("r"))
    cut = exploded.select("key", F.col("r.s0").alias("s0"), F.col("r.hash").alias("hash"), F.col("r.hot").alias("hot"), F.expr(f"substring(text, cast(r.s0 + 1 as int), cast(r.s1 - r.s0 + {length} as int))").alias("bytes"))

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(1)(batches):
            keys_, starts, contexts = table.column("key").to_pylist(), table.column("s0").to_pylist(), table.column("bytes").to_pylist()
            yield _span_batch([(k, s + lo, s + hi) for k, s, own in zip(keys_, starts, repeated_in(contexts, length), strict=True) for lo, hi in _merged(own, length)])

    dealt = cut.filter(~F.col("hot")).withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int")).select("shard", "key", "s0", "bytes")
    dealt = dealt.repartition(max(width, min(shards, 8 * width)), "shard").sortWithinPartitions("shard")
    spans = dealt.mapInArrow(sort_shard, "key binary, lo long, hi long")
    if not hot.isEmpty():
        spans = spans.union(_hot_spans(cut.filter("hot"), length))
    return texts.select("key", "text"), spans


def _hot_spans(cut: DataFrame, length: int) -> DataFrame:
    """Spans of the runs of hot hashes: each string by its digest, counted with partial sums."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                view, n = memoryview(data), len(data) - length + 1
                for at in range(0, n, 1 << 16):
                    part = range(at, min(n, at + (1 << 16)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([xxhash.xxh3_128_digest(view[i : i + length]) for i in part], pa.binary()), pa.array([key] * len(part), pa.binary()), pa.array([start + i for i in part], pa.int64())],
                        ["digest", "key", "s"],
                    )

    every = cut.select("key", "s0", "bytes").mapInArrow(strings, "digest binary, key binary, s long")
    place = F.struct("key", "s")
    again = every.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("digest")
    # A string may stand at most of the places: the join back is dealt by a salt too.
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = every.withColumn("salt", F.pmod(F.xxhash64("key", "s"), F.lit(SALTS)).cast("int"))
    return every.join(again, ["digest", "salt"], "left_semi").select("key", F.col("s").alias("lo"), (F.col("s") + length).alias("hi"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """A row for each row of `docs`: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `spans`.

    `spans` are the maximal runs [lo, hi) of bytes covered by a `length`-byte
    string that also starts anywhere else in the texts, in UTF-8 bytes; null where
    there are none, and one run where a text is removed whole as a copy. A null
    text is empty and keeps nothing. Repeated rows are copies of each other.
    Null ids stay; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    texts, spans = repeated_spans(docs, text_col, length, gram, shard_bytes, hot_runs)
    by_text = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("s"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for p in parts:
                    if merged and p["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], p["hi"])
                    else:
                        merged.append([p["lo"], p["hi"]])
                digest, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    digest.update(memoryview(data)[at:lo])
                    at = hi
                digest.update(memoryview(data)[at:])
                rows.append((sum(hi - lo for lo, hi in merged), digest.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["key", "removed", "kept", "spans"],
            )

    cleaned = texts.join(by_text, "key").select("key", "text", "s").mapInArrow(keep, "key binary, removed long, kept string, spans array<struct<lo:long,hi:long>>")
    copies = keys.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied"))
    known = cleaned.join(copies, "key", "full")
    out = keys.join(known, "key", "left")
    gone = F.coalesce("copied", F.lit(False))
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.greatest(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        F.when(gone, whole_span).otherwise(F.col("spans")).alias("spans"),
    )


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
