"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces in one map over rows. Pieces of equal length are
interchangeable, so the whole instance is a histogram of at most `capacity`
counts: small enough for the driver at any input size. There the reduction
fixes sets of at most three items that provably dominate every alternative, and
best-fit decreasing packs the rest, both on counts. The resulting slots are a
table of runs; each piece finds its slot by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, sliced, stash

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers in each of two generations.
CACHE_WORDS = 150_000

#: Below it every letter's lower case is one letter.
_PLAIN = "\u0130"
MARKS = ".,;:!?#$%&*"

Group = tuple[list[tuple[int, int]], int]  # a bin's (length, how often), and how many such bins


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: A plain text has letters below _PLAIN only, no special token, and each full
#: stop or comma stands by itself between letters, digits or spaces.
_not_plain = re.compile(r"[.,<\x1c-\x1f\u0130-\U0010ffff](?:(?<=[^.,<])|(?<=<)(?=\|)|(?<=[.,])(?![^\W_]|[ \n]|\Z)|(?<=[.,])(?<![^\W_][.,]))")


def _byte_symbols() -> dict[int, str]:
    """The byte-level vocabulary's symbol of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordIds(dict):
    """Token ids of a word as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words, one after the other. Nor does it join a letter with
    the marks after it, and it lower-cases; so most words are known without their
    last marks or in lower case. A new lower-case word of letters goes straight to
    the tokenizer's model, anything else through all of it. A full generation of
    words becomes the old one, from which words that occur again return.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.learn(word)
        self[word] = found
        return found

    def learn(self, word: str) -> bytes:
        if word.isalpha() and max(word) < _PLAIN:
            low = word.lower()
            if low != word:
                return self[low]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.symbols)
            return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
        base = _without_marks(word)
        if base is not None:
            return self[base] + self[word[len(base) :]]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if _not_plain.search(text) is None:
            words = text.lower().replace(".", " . ").replace(",", " , ").split()
        else:
            words = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def _without_marks(word: str) -> str | None:
    """A word that ends with a plain letter and MARKS, without the marks (one token group of their own)."""
    base = word.rstrip(MARKS)
    if base and len(base) < len(word) and base[-1].isalpha() and base[-1] < _PLAIN:
        return base
    return None


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """A worker's own memory, kept from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = known.ids(text or "") + end
                for k in range(0, len(data) // 4, capacity):
                    part = data[4 * k : 4 * (k + capacity)]
                    rows.append((doc, k // capacity, k, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Group]:
    """Fix dominating sets and take them out of `counts` (index: length).

    For the largest item L with room r = capacity - L beside it: alone if nothing
    fits; with an item of exactly r; with the largest item that fits if no two
    others fit together; likewise if that item is at least as large as the best
    pair and no three others fit. In each case the set dominates all others with L.
    """
    fixed: list[Group] = []
    for size in range(capacity, 0, -1):
        while counts[size]:
            mine, room = int(counts[size]), capacity - size
            counts[size] -= 1
            small = np.flatnonzero(counts[: room + 1])
            counts[size] += 1
            if not small.size:
                n = mine
                fixed.append(([(size, 1)], n))
                counts[size] -= n
                continue
            best = int(small[-1])
            least: list[int] = []
            for s in small[:3]:
                least += [int(s)] * min(3, int(counts[s]) - (int(s) == size))
            pair = sum(least[:2]) if len(least) > 1 else capacity + 1
            triple = sum(least[:3]) if len(least) > 2 else capacity + 1
            if best != room and pair <= room and not (triple > room and best >= _best_pair(counts, small, size, room)):
                break
            n = mine // 2 if best == size else min(mine, int(counts[best]))
            fixed.append(([(size, 2)] if best == size else [(size, 1), (best, 1)], n))
            counts[size] -= n
            counts[best] -= n
    return fixed


def _best_pair(counts: np.ndarray, small: np.ndarray, size: int, room: int) -> int:
    """The largest sum of two items that fits the room."""
    most, lo, hi = 0, 0, len(small) - 1
    while lo <= hi:
        total = int(small[lo] + small[hi])
        if total > room or (lo == hi and counts[small[lo]] - (small[lo] == size) < 2):
            hi -= 1
        else:
            most, lo = max(most, total), lo + 1
    return most


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing over counts of equal lengths."""
    bins: dict[int, list[Group]] = {}
    open_at = np.zeros(capacity + 1, bool)

    def put(pattern: list[tuple[int, int]], left: int, n: int) -> None:
        if n:
            bins.setdefault(left, []).append((pattern, n))
            open_at[left] = True

    for size in range(capacity, 0, -1):
        todo = int(counts[size])
        while todo:
            fits = np.flatnonzero(open_at[size:])
            if fits.size:
                left = int(fits[0]) + size
                pattern, n = bins[left].pop()
                open_at[left] = bool(bins[left])
            else:
                left, pattern, n = capacity, [], todo
            each = left // size
            whole = min(n, todo // each)
            put([*pattern, (size, each)], left - each * size, whole)
            todo -= whole * each
            n -= whole
            if n and todo:  # the last bin gets what is left, less than `each`
                put([*pattern, (size, todo)], left - todo * size, 1)
                todo, n = 0, n - 1
            if pattern:
                put(pattern, left, n)
    return [g for groups in bins.values() for g in groups]


def slot_runs(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, how often a bin, first sequence, offset), sorted by length and rank; and the number of sequences."""
    left = counts.astype(np.int64).copy()
    groups = reduce_instance(left, capacity)
    groups += best_fit(left, capacity)
    cursor, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, n in groups:
        offset = 0
        for size, each in pattern:
            runs.append((size, int(cursor[size]), each, sequence, offset))
            cursor[size] += n * each
            offset += size * each
        sequence += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table, sequence


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece (int, from 0), start, length, ids_crc32, sequence_id, offset (long).

    A document's ids are those of its text (null: empty) and END_ID; only ids
    beyond `capacity` are cut. Every input row is packed, repeated rows and null
    ids included; ties between pieces of a length are broken by their place in
    the input. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity)
    salts = min(1024, max(16, partitions(spark)))
    made = made.withColumn("uid", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    made = stash(made, "pieces")
    counts = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in made.groupBy("length", "salt").count().toLocalIterator():  # at most capacity x salts rows
        counts[length, salt] = n
    table, _ = slot_runs(counts.sum(axis=1), capacity)
    shared = spark.sparkContext.broadcast((np.cumsum(counts, axis=1) - counts, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, runs = shared.value
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            length, salt, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = rank - 1 + first[length, salt]
            run = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            step = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 3] + step // run[:, 2]), pa.array(run[:, 4] + step % run[:, 2] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
