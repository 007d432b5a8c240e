"""Line-first quality rules.

Every line is judged by itself: a line without sentence punctuation, a short
navigation or boilerplate line, and a line full of symbols fails and goes. A
document that loses too much of its text that way is rejected, as is one that
fails the base counts. Everything is a map over rows: no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import ASCII_SPACE, sliced

SYMBOLS = "#*$%&|<>"
#: A sentence ends somewhere: closing quotes and brackets may follow the mark.
TERMINAL = r"""[.!?…。！？।؟۔]["'”’»)\]]*([\x20\x09-\x0D]|$)"""
NAVIGATION = r"(?i)(^|[^a-z])(home|menu|log ?in|sign (in|up)|next page|previous page|back to top|skip to content|read more|share this|site ?map|search)([^a-z]|$)"
BOILERPLATE = r"(?i)(all rights reserved|privacy policy|terms (of (use|service)|and conditions)|cookie (policy|settings)|accept (all )?cookies|enable javascript|lorem ipsum|click here|subscribe (now|to our)|powered by|copyright \(c\))"
NAV_WORDS = 8
BOILER_WORDS = 20
SYMBOL_SHARE = 10  # a line fails if SYMBOL_SHARE * symbols > words
MIN_WORDS = 50
MAX_LOSS = 50  # per cent of the characters in words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FLAGS = ("base_failed", "kept")

_terminal, _navigation, _boilerplate = map(re.compile, (TERMINAL, NAVIGATION, BOILERPLATE))
_symbol_bytes = bytes(set(range(256)) - set(SYMBOLS.encode()))
_no_space = str.maketrans("", "", ASCII_SPACE)


def line_fails(line: str) -> bool:
    """Whether a line with a word breaks one of the line rules."""
    raw = line.encode()
    words = len(raw.split())
    if SYMBOL_SHARE * len(raw.translate(None, _symbol_bytes)) > words or not _terminal.search(line):
        return True
    return (words <= NAV_WORDS and _navigation.search(line) is not None) or (words <= BOILER_WORDS and _boilerplate.search(line) is not None)


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n + 2)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 2_000_000:  # keys of three words would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = np.zeros(n + 2, bool)
    many = np.flatnonzero(count[at] > 1)
    for k in range(3):
        hit[many + k] = True
    return int(hit.sum())


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str | None]:
    """COUNTS, FLAGS and the text without its failed lines."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, None
    raw = text.encode()
    words = raw.split()
    chars = len(text.translate(_no_space))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(ASCII_SPACE)]
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > 50 * len(words)
    verdict = {x: line_fails(x) for x in set(full)}
    lost = sum(len(x.translate(_no_space)) for x in full if verdict[x])
    clean = "\n".join(x for x in lines if not verdict.get(x, False))
    symbols = len(raw.translate(None, _symbol_bytes))
    return len(words), chars, symbols, len(full) - len(verdict), repeat, failed, not failed and 100 * lost <= MAX_LOSS * chars, clean


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`doc` (a struct of all columns of a row of `docs`) with `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words` (long), `base_failed`, `kept` (boolean) and `clean` (the text without failed lines).

    Words are runs of `[^\\x20\\x09-\\x0D]`. A null text has no words: its base
    fails and `clean` is null; an empty text likewise with `clean` empty. Lines
    without a word are neither judged nor lost. Rows are independent, so repeated
    rows, ties and null ids need no care; columns of any name travel inside `doc`.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    names = [*COUNTS, *FLAGS, "clean"]
    types = [pa.int64()] * len(COUNTS) + [pa.bool_()] * len(FLAGS) + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [judge(x) for x in batch.column(0).field(text_col).to_pylist()]
            made = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], ["doc", *names])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType()}
    return whole.mapInArrow(run, T.StructType([*whole.schema.fields, *[T.StructField(n, kinds[t]) for n, t in zip(names, types, strict=True)]]))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select(F.col("doc")["doc_id"].alias("doc_id"), *COUNTS, *FLAGS)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]'"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORD}) AS ws, string_split(t, chr(10)) AS ls FROM d),
x AS (SELECT doc_id, unnest(ws) AS wd, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, wd || chr(10) || lead(wd, 1) OVER o || chr(10) || lead(wd, 2) OVER o AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i FROM g WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, l, len(regexp_extract_all(l, {_WORD})) AS nw, length(regexp_replace(l, {_SPACE}, '', 'g')) AS ch,
             len(regexp_extract_all(l, '[#*$%&|<>]')) AS sy
      FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
v AS (SELECT doc_id, l, ch, ({SYMBOL_SHARE} * sy > nw OR NOT regexp_matches(l, {_sql(TERMINAL)})
             OR (nw <= {NAV_WORDS} AND regexp_matches(l, {_sql(NAVIGATION)})) OR (nw <= {BOILER_WORDS} AND regexp_matches(l, {_sql(BOILERPLATE)}))) AS bad
      FROM l WHERE nw > 0),
s AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN bad THEN ch ELSE 0 END) AS lost FROM v GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, {_SPACE}, '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {MAX_LOSS} * word_chars AS kept
FROM a
"""
