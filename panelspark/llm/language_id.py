"""Language identification by rank-order n-gram profiles.

Training counts the n-grams (1 to 3 characters, words padded) of every labelled
training text per language: each task adds up its own counts, Spark sums them,
and the most frequent `profile_size` n-grams of a language, in order, are its
profile. A text is compared by the out-of-place distance: its own most frequent
n-grams, in order, against each profile; an n-gram that a profile lacks costs
the most. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_SIZE = 400
#: Languages beyond this many would make the broadcast profiles large.
MAX_LANGUAGES = 2000
_BITS = np.uint64(21)
#: No letter, and not nothing: a padded pair is not a plain letter.
PAD = 1


def _letters() -> np.ndarray:
    """A flag for each code point: is it a letter?"""
    flags = np.zeros(0x110000, bool)
    flags[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return flags


class Grams:
    """N-grams of a text as integers: three code points of 21 bits, PAD for what isn't a letter."""

    def __init__(self):
        self.letters = _letters()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and how often they occur; none without a letter. Runs of other characters count as one pad."""
        code = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(self.letters[code], code, PAD).astype(np.uint64)
        code = code[np.concatenate(([True], (code[1:] != PAD) | (code[:-1] != PAD)))]
        if len(code) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        two = (code[:-1] << _BITS) | code[1:]
        three = (two[:-1] << _BITS) | code[2:]
        three = three[code[1:-1] != PAD]  # a pad only at an end
        return np.unique(np.concatenate((code[code != PAD], two, three)), return_counts=True)


def _ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram itself."""
    if grams.size > size:
        keep = counts >= np.partition(counts, -size)[-size]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", profile_size: int = PROFILE_SIZE) -> DataFrame:
    """`lang`, `gram` (long) and `rank` (from 0) of each language's profile, over all rows with a non-null language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, total = Grams(), {}
        waiting: dict[str, list] = {}

        def fold(lang: str) -> None:
            parts = waiting.pop(lang) + ([total[lang]] if lang in total else [])
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[lang] = grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = make.counts(text)
                if grams.size:
                    waiting.setdefault(lang, []).append((grams, counts))
                    if len(waiting[lang]) >= 200:
                        fold(lang)
        for lang in list(waiting):
            fold(lang)
        for lang, (grams, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * grams.size, pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = train.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    summed = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # A limit on row_number() itself lets each task drop all but its first profile_size n-grams of a language before they meet.
    first = summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= profile_size)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile_size: int = PROFILE_SIZE) -> DataFrame:
    """`id_col`, `lang_pred` and `score` for each row of `docs`.

    `lang_pred` is `und` with score 0 for a null text, a text without a letter
    and where no language was learned. Else it is the language at the least
    distance (ties: the first by name), and the score is 1 - distance / greatest
    possible distance. Rows are independent; repeated rows are repeated.
    """
    rows = profiles.orderBy("lang", "rank").limit(MAX_LANGUAGES * profile_size + 1).collect()
    if len(rows) > MAX_LANGUAGES * profile_size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r.lang for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    known = np.unique(np.array([r.gram for r in rows], np.uint64))
    table = np.full((len(known) + 1, max(1, len(langs))), profile_size, np.int64)  # the last row: n-grams in no profile
    table[np.searchsorted(known, np.array([r.gram for r in rows], np.uint64)), [at[r.lang] for r in rows]] = [r["rank"] for r in rows]
    missing = table == profile_size
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, table, missing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams_known, ranks, lacks = shared.value
        make = Grams()

        def one(text: str | None) -> tuple[str, float]:
            own = _ranked(*make.counts(text), profile_size)
            if not own.size or not names:
                return "und", 0.0
            k = np.minimum(np.searchsorted(grams_known, own), max(0, len(grams_known) - 1))
            k = np.where(grams_known[k] == own, k, len(grams_known))
            place = np.arange(own.size)[:, None]
            far = np.where(lacks[k], profile_size, np.abs(ranks[k] - place)).sum(axis=0)
            best = int(np.argmin(far))
            return names[best], float(1 - far[best] / (profile_size * own.size))

        for batch in batches:
            made = [one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs, profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
