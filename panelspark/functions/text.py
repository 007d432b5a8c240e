"""Text, dates and durations: file names, statuses, numbers as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null (not empty) without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def file_date(name: Column) -> tuple[Column, Column]:
    """(year, day of year): from `AyyyyDDD`, else the first four digits as a year; 0 where there are none."""
    stamped = r"A(\d{4})(\d{3})"
    year = F.coalesce(extract(name, stamped), extract(name, r"(\d{4})")).cast("int")
    return F.coalesce(year, F.lit(0)), F.coalesce(extract(name, stamped, 2).cast("int"), F.lit(0))


def tile_file(name: Column) -> dict[str, Column]:
    """Parts of `product.version.AyyyyDDD.hNNvNN.stamp.ext`, all null in a name of another form."""
    ok = name.rlike(r"^[^.]+\.[^.]+\.A\d{7}\.h\d{2}v\d{2}\.\d+\.[A-Za-z0-9]+$")
    part = F.split(name, r"\.")
    pick = lambda c: F.when(ok, c.try_cast("int"))
    date, cell = F.get(part, F.lit(2)), F.get(part, F.lit(3))
    return {"year": pick(F.substring(date, 2, 4)), "day": pick(F.substring(date, 6, 3)), "h": pick(F.substring(cell, 2, 2)), "v": pick(F.substring(cell, 5, 2))}


def bounded_year(c: Column, low: int, high: int, delimited: bool = False) -> Column:
    """The first four-digit number from `low` to `high`; with `delimited` first one that stands between delimiters or ends, if there is one."""

    def first(pattern: str) -> Column:
        return F.get(F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: x.cast("int")), lambda y: y.between(low, high)), F.lit(0))

    return F.coalesce(first(r"(?<![^_./\\-])(\d{4})(?![^_./\\-])"), first(r"(\d{4})")) if delimited else first(r"(\d{4})")


def has_year(c: Column) -> Column:
    return c.rlike(r"\b(18|19|20)\d{2}\b")


def first_year(c: Column) -> Column:
    return extract(c, r"(\d{4})").cast("int")


def strip_host(path: Column) -> Column:
    """A path without `user@host:`."""
    return F.regexp_replace(path, r"^[^/@:]+@[^/:]+:", "")


def tidy(c: Column) -> Column:
    """Trimmed, single spaces; empty and NA are null."""
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.upper(out).isin("", "NA", "N/A"), out)


def written_number(c: Column) -> Column:
    """A number with a decimal comma, or in brackets for a negative one; null if it is none."""
    bare = F.regexp_replace(tidy(c), r"[()\s]", "")
    bare = F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    value = bare.try_cast("double")
    return F.when(F.trim(c).rlike(r"^\(.*\)$"), -value).otherwise(value)


def segments(c: Column) -> Column:
    """Array of (seq, date, text) of repeated `(date) text`; a text without such parts is one segment without a date."""
    parts = F.arrays_zip(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)\s*([^(]*)"), 1).alias("date"), F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)\s*([^(]*)"), 2).alias("text"))
    found = F.transform(parts, lambda x, i: F.struct((i + 1).alias("seq"), x["date"].alias("date"), tidy(x["text"]).alias("text")))
    whole = F.array(F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("date"), tidy(c).alias("text")))
    return F.when(F.size(found) > 0, found).when(tidy(c).isNotNull(), whole)


def status_category(c: Column) -> Column:
    """pending (or null, or empty), downloading, failed, completed or other; statuses are as they are written."""
    return (
        F.when(c.isNull() | c.isin("", "pending"), "pending").when(c == "DOWNLOADING", "downloading").when(c.startswith("FAILED:"), "failed").when(c == "completed", "completed").otherwise("other")
    )


def source_type(path: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The label of the first rule whose text the path holds."""
    out = None
    for needle, label in rules:
        hit = F.lower(path).contains(needle.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def token_estimate(c: Column, extra: int = 0) -> Column:
    return F.ceil(F.length(c) / 4) + extra


def day_of_year(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def fiscal_year(two_digits: Column) -> Column:
    """Above 50: 19xx, else 20xx."""
    return F.when(two_digits > 50, 1900 + two_digits).otherwise(2000 + two_digits)


def duration_seconds(c: Column) -> Column:
    """Seconds of `D-HH:MM:SS`, `HH:MM:SS` or `MM:SS`; null for anything else."""
    ok = c.rlike(r"^(\d+-)?\d+(:\d+){1,2}$")
    days = F.coalesce(extract(c, r"^(\d+)-").cast("long"), F.lit(0))
    clock = F.reverse(F.split(F.regexp_replace(c, r"^\d+-", ""), ":"))
    part = lambda i: F.coalesce(F.get(clock, F.lit(i)).cast("long"), F.lit(0))
    return F.when(ok, days * 86400 + part(2) * 3600 + part(1) * 60 + part(0))


def duration_text(seconds: Column) -> Column:
    """`D-HH:MM:SS`."""
    s = seconds.cast("long")
    return F.format_string("%d-%02d:%02d:%02d", (s / 86400).cast("long"), (s / 3600).cast("long") % 24, (s / 60).cast("long") % 60, s % 60)


def elapsed(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(end) - F.unix_timestamp(start))


def to_millis(ts: Column) -> Column:
    """A timestamp rounded to milliseconds."""
    return F.timestamp_millis(F.bround(F.unix_micros(ts) / 1000).cast("long"))


def latex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def candidate_reason(c: Column, has_truth: Column) -> Column:
    """Why a text is worth reading: a year in it, a known answer, or both; null if it is not."""
    full = tidy(c).isNotNull()
    return F.when(full & has_year(c) & has_truth, "year_and_truth").when(full & has_year(c), "year").when(full & has_truth, "truth")


def without_suffix(c: Column, suffixes: list[str]) -> Column:
    """A name without the first of the endings it has."""
    return F.regexp_replace(c, "(" + "|".join(suffixes) + ")$", "")
