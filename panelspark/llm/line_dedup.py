"""Line dedup with a pair of Bloom filters.

1. Every task adds the hashes of its documents' distinct lines to two partial
   Bloom filters, "once" and "twice", cut into shards. Merging two partials ors
   both and adds `once_a & once_b` to "twice", so "twice" holds every line that
   two documents share (and a few more). Partials travel as bit positions or as
   bitmaps, whichever is smaller, and merge in a tree of bounded fan-in.
2. Only lines in the "twice" filter are suspected; just their keys shuffle, with
   map-side counts, for the exact count of documents (or the first occurrence).
3. The confirmed keys go back to the documents: broadcast while they stay under
   a checked size, else by a join on the key.

The filters have a bounded size. Beyond their capacity more lines are suspected
and shuffle; the result is exact at any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import ASCII_SPACE, partitions, sliced, stash

_STRIP = ASCII_SPACE.encode()
SHARD_BITS = 1 << 18
HASHES = 2
#: Parts that the rows of one line are dealt to in a join on lines.
SALTS = 16


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased; other bytes as they are."""
    return line.strip(_STRIP).lower()


def _lines(value: bytes | None) -> list[bytes]:
    return (value or b"").split(b"\n")


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES bit positions of each hash; both lie in the same shard."""
    shards = np.uint64(bits // SHARD_BITS)
    shard = (hashes >> np.uint64(40)) % shards
    return [shard * np.uint64(SHARD_BITS) + ((hashes >> np.uint64(20 * i)) & np.uint64(SHARD_BITS - 1)) for i in range(HASHES)]


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def _hashes(texts: pa.Array, min_chars: int) -> np.ndarray:
    """Hashes of the keys of each document, once a document."""
    out: list[int] = []
    for value in texts.cast(pa.binary()).to_pylist():
        keys = {line_key(x) for x in _lines(value)}
        out += [xxhash.xxh3_64_intdigest(k) for k in keys if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
    return np.array(out, dtype=np.uint64)


def _pack(bitmap: np.ndarray) -> bytes:
    """Sparse shards as bit positions (uint32), dense ones as the bitmap, after a tag byte."""
    if int(np.count_nonzero(bitmap)) * 8 < bitmap.size // 4:
        return b"p" + np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).astype("<u4").tobytes()
    return b"b" + bitmap.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    flags = np.zeros(SHARD_BITS, np.uint8)
    flags[np.frombuffer(data, "<u4", offset=1)] = 1
    return np.packbits(flags, bitorder="little")


def _partial_filters(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, count = np.unique(_hashes(batch.column(0), min_chars), return_counts=True)
            if not hashes.size:
                continue
            at = _positions(hashes, bits)
            again = (count > 1) | np.logical_and.reduce([_has(once, x) for x in at])
            for x in at:
                _put(twice, x[again])
                _put(once, x)
        size = SHARD_BITS // 8
        used = [i for i in range(bits // SHARD_BITS) if once[i * size : (i + 1) * size].any()]
        for i in used:
            part = slice(i * size, (i + 1) * size)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([i], pa.int32()), "once": pa.array([_pack(once[part])], pa.binary()), "twice": pa.array([_pack(twice[part])], pa.binary())}
            )

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = _unpack(rows["once"].iloc[0]), _unpack(rows["twice"].iloc[0])
    for a, b in zip(rows["once"].iloc[1:], rows["twice"].iloc[1:], strict=True):
        more = _unpack(a)
        twice |= _unpack(b) | (once & more)
        once |= more
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "once": [_pack(once)], "twice": [_pack(twice)]})


def twice_filter(docs: DataFrame, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The merged "twice" filter: `bits` / 8 bytes, whatever the size of `docs`."""
    parts = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(_partial_filters(bits, min_chars), "shard int, once binary, twice binary")
    fan = max(2, math.isqrt(partitions(docs.sparkSession)))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("once", "twice"), F.lit(fan)).cast("int"))
    merged = salted.groupBy("shard", "salt").applyInPandas(_merge, "shard int, once binary, twice binary")
    merged = merged.groupBy("shard").applyInPandas(_merge, "shard int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("shard", "twice").toLocalIterator():
        out[row.shard * (SHARD_BITS // 8) : (row.shard + 1) * (SHARD_BITS // 8)] = _unpack(bytes(row.twice))
    return out


def filter_bits(rows: int, max_bits: int, bits_per_row: int = 256) -> int:
    """A power of two of about `bits_per_row` bits a document, bounded by `max_bits`."""
    return int(min(max_bits, max(SHARD_BITS, 1 << max(0, math.ceil(math.log2(max(1, rows) * bits_per_row))))))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, max_bits: int = 1 << 27) -> DataFrame:
    """Keys found in at least `min_docs` (2 or more) rows: `key` binary, `n_docs`, `first_id` (the least id that has it)."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    rows = docs.count()
    bits = filter_bits(rows, max_bits)
    seen = spark.sparkContext.broadcast(twice_filter(docs, text_col, bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = seen.value
        for batch in sliced(batches):
            keys: list[bytes] = []
            ids: list[int | None] = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = [k for k in {line_key(x) for x in _lines(value)} if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
                keys += own
                ids += [i] * len(own)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
            keep = np.flatnonzero(np.logical_and.reduce([_has(twice, x) for x in _positions(hashes, bits)])) if keys else []
            yield pa.RecordBatch.from_pydict({"id": pa.array([ids[j] for j in keep], pa.int64()), "key": pa.array([keys[j] for j in keep], pa.binary())})

    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(suspects, "id long, key binary")
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id")).filter(F.col("n_docs") >= min_docs)


def _cleaner(table: dict | None, id_name: str, text_name: str, keep_first: bool):
    """Texts without their banned lines; the banned keys and their first ids come from `table` or from a row's second column."""

    def one(value: bytes | None, keys: dict, own) -> tuple[int, int, bytes]:
        lines = _lines(value)
        seen: set[bytes] = set()
        kept = []
        for x in lines:
            k = line_key(x)
            if k in keys:
                if not keep_first or keys[k] != own or k in seen:
                    continue
                seen.add(k)
            kept.append(x)
        return len(lines), len(lines) - len(kept), b"\n".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            docs = batch.column(0)
            texts = docs.field(text_name).cast(pa.binary()).to_pylist()
            ids = docs.field(id_name).to_pylist()
            keys = [table] * len(texts) if table is not None else [{x["key"]: x["first_id"] for x in own or ()} for own in batch.column(1).to_pylist()]
            rows = [one(*x) for x in zip(texts, keys, ids, strict=True)]
            out = [docs, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc", "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    max_bits: int = 1 << 27,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """`doc` (a struct of all columns of a row of `docs`), `n_lines`, `n_dropped` (long) and `kept`, the text without repeated lines.

    A line's key is the line stripped of ASCII white space at both ends with A-Z
    lower-cased. Keys of `min_chars` code points in `min_docs` rows or more lose
    all their lines everywhere; with `keep_first` the first line in the row of
    the least id stays. A null or empty text is one empty line and stays (its
    `kept` is empty). Rows are judged one by one, so equal rows and null or
    repeated ids are fine (a key counts once a row). Columns of any name travel
    inside `doc`. An empty table gives an empty table.
    """
    keys = stash(repeated_lines(docs, id_col, text_col, min_docs, min_chars, max_bits), "lines")
    size = keys.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0))).first()[0]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([*whole.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    if size > broadcast_bytes:
        return _with_keys(whole, keys, text_col).mapInArrow(_cleaner(None, id_col, text_col, keep_first), schema)
    banned = docs.sparkSession.sparkContext.broadcast({bytes(r.key): r.first_id for r in keys.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cleaner(banned.value, id_col, text_col, keep_first)(batches)

    return whole.mapInArrow(run, schema)


def _with_keys(whole: DataFrame, keys: DataFrame, text_name: str) -> DataFrame:
    """`doc` and `keys`, for a key table over the broadcast bound: the keys of each text meet the table and return by the text's digest.

    A line that very many texts have is dealt to SALTS parts.
    """
    text = F.coalesce(F.col("doc")[text_name], F.lit("")).cast("binary")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lines = [], []
            for value in batch.column(0).to_pylist():
                own = {k for k in map(line_key, _lines(value)) if k}
                digests += [hashlib.sha256(value).digest()] * len(own)
                lines += own
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "key": pa.array(lines, pa.binary())})

    pairs = whole.select(text.alias("t")).mapInArrow(exploded, "digest binary, key binary").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    dealt = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = pairs.join(dealt, ["key", "salt"]).groupBy("digest").agg(F.collect_set(F.struct("key", "first_id")).alias("keys"))
    return whole.withColumn("digest", F.unhex(F.sha2(text, 256))).join(hits, "digest", "left").select("doc", "keys")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), banned AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(b.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN b.k IS NULL THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN banned b USING (k) GROUP BY doc_id
"""
