"""Regression tables from fits: coefficients by model, stars, statistics; text, HTML or LaTeX."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.regression import Fit

STARS = (0.001, 0.01, 0.05)


def stars(p: float, cuts: tuple[float, float, float] = STARS) -> str:
    return "*" * sum(p < c for c in cuts)


def coefficient_rows(spark: SparkSession, fits: dict[str, Fit], labels: dict[str, str] | None = None) -> DataFrame:
    """A row for each model and coefficient, first stages included, under display labels."""
    rows = []
    for model, fit in fits.items():
        for stage, one in [("", fit), *((f"first stage {k}", v) for k, v in fit.first_stage.items())]:
            rows += [(model, stage, i, (labels or {}).get(n, n), b, s, p) for i, (n, b, s, _, p) in enumerate(one.rows())]
    return spark.createDataFrame(rows, "model string, stage string, place int, label string, estimate double, std_error double, p double")


def table(coefs: DataFrame, models: list[str], digits: int = 3, cuts: tuple[float, float, float] = STARS) -> DataFrame:
    """Labels down, models across; a cell is `estimate stars (error)`."""
    mark = F.when(F.col("p") < cuts[0], "***").when(F.col("p") < cuts[1], "**").when(F.col("p") < cuts[2], "*").otherwise("")
    cell = F.concat(F.format_number("estimate", digits), mark, F.lit(" ("), F.format_number("std_error", digits), F.lit(")"))
    wide = coefs.withColumn("cell", cell).groupBy("stage", "label").pivot("model", models).agg(F.max("cell"))
    place = coefs.groupBy("stage", "label").agg(F.min("place").alias("place"))
    return wide.join(place, ["stage", "label"]).orderBy("stage", "place").drop("place")


FORMATS: dict[str, Callable[[list[str], list[list[str]]], str]] = {}


def formatter(name: str):
    """Registers a way to print a table."""

    def add(f):
        FORMATS[name] = f
        return f

    return add


@formatter("text")
def _text(head: list[str], rows: list[list[str]]) -> str:
    width = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in [head, *rows])


@formatter("html")
def _html(head: list[str], rows: list[list[str]]) -> str:
    import html

    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line(head, "th") + "".join(line(r, "td") for r in rows) + "</table>"


@formatter("latex")
def _latex(head: list[str], rows: list[list[str]]) -> str:
    def safe(c: str) -> str:
        for ch in "&%$#_{}":
            c = c.replace(ch, "\\" + ch)
        return c

    body = [" & ".join(map(safe, r)) + r" \\" for r in [head, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{l{'c' * (len(head) - 1)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])


def render(df: DataFrame, kind: str = "text") -> str:
    """A small table as text."""
    rows = [["" if v is None else str(v) for v in r] for r in df.collect()]
    return FORMATS[kind](df.columns, rows)
