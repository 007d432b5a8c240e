"""What labels in a model sheet mean: filters, extents, settings, runtimes."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_YEAR = r"\(?\s*year\s*(>=|<=|<|>|=|==)\s*\d{4}\s*\)?"


def workbook_where(text: str) -> str:
    """Sheet syntax as SQL: `&`, `|` and `==`."""
    out = re.sub(r"\s*&+\s*", " AND ", text)
    out = re.sub(r"\s*\|+\s*", " OR ", out)
    return re.sub(r"\s*==\s*", " = ", out).strip()


def without_years(where: str) -> str:
    """A conjunction without its conditions on `year`."""
    parts = [p for p in re.split(r"(?i)\s+AND\s+", where) if not re.fullmatch(_YEAR, p.strip(), re.I)]
    return " AND ".join(p.strip() for p in parts if p.strip())


def temporal_where(label: str) -> str:
    """`1992-2013` as a condition; other labels ask for nothing."""
    m = re.fullmatch(r"\s*(\d{4})\s*[-–]\s*(\d{4})\s*", label or "")
    return f"(year >= {m[1]}) AND (year <= {m[2]})" if m else ""


def temporal_extent(where: str) -> tuple[int | None, int | None]:
    """First and last year that a condition allows: the greatest lower and the least upper bound."""
    low, high = [], []
    for op, y in re.findall(r"(?i)year\s*(>=|<=|==|=|<|>)\s*(\d{4})", where):
        y = int(y)
        if op in (">=", ">", "=", "=="):
            low.append(y + (op == ">"))
        if op in ("<=", "<", "=", "=="):
            high.append(y - (op == "<"))
    return (max(low) if low else None), (min(high) if high else None)


def conjunction(*clauses: str | None) -> str | None:
    parts = [f"({c})" for c in clauses if c and c.strip()]
    return " AND ".join(parts) or None


def isin_where(columns: dict[str, Any]) -> str:
    """`{column: value or list}` as a condition."""
    out = []
    for c, v in columns.items():
        values = v if isinstance(v, (list, tuple, set)) else [v]
        quoted = ["'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in values]
        out.append(f"{c} IN ({', '.join(quoted)})" if len(quoted) > 1 else f"{c} = {quoted[0]}")
    return " AND ".join(out)


def subset_name(name: str, known: dict[str, Any], aliases: dict[str, str], continents: dict[str, str]) -> str:
    """A known subset's name: an alias, a two-letter continent, with or without `.json`."""
    bare = re.sub(r"\.json$", "", name.strip())
    for option in (aliases.get(bare), continents.get(bare.upper()) if len(bare) == 2 else None, bare, bare.lower()):
        if option in known:
            return option
    raise KeyError(f"no subset {name}")


def coerce(text: Any) -> Any:
    """Sheet values as numbers and booleans where they look like them."""
    if not isinstance(text, str):
        return text
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "none", "nan"):
        return None
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            continue
    return text.strip()


def settings(defaults: dict[str, Any], sheet: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """Defaults, then the sheet, then what the caller says; empty values do not replace."""
    out = dict(defaults)
    for layer in (sheet, override):
        out.update({k: v for k, v in ((k, coerce(v)) for k, v in layer.items()) if v is not None})
    return out


def memory_text(text: str, share: float) -> str:
    """A share of `112GB` or the like."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([KMGT]?)i?B?\s*", text, re.I)
    if not m:
        raise ValueError(f"no memory size: {text}")
    return f"{max(1, int(float(m[1]) * share))}{m[2].upper()}B"


def memory_gb(text: str) -> float:
    """`112GB`, `1.5 TB` and the like in gigabytes; a number without a unit is none."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([KMGT])i?B\s*", text, re.I)
    if not m:
        raise ValueError(f"no memory size: {text}")
    return float(m[1]) * 1024.0 ** ("KMGT".index(m[2].upper()) - 2)


def partition_for(memory: str, explicit: str | None = None, names: tuple[str, str] = ("normal", "large"), bound: float = 256.0) -> str:
    """The queue for a job: the one asked for, else the large one from `bound` gigabytes on."""
    return explicit or names[memory_gb(memory) >= bound]


def model_order(rows: DataFrame, column: str = "order") -> DataFrame:
    """Rows whose order is a number, in that order."""
    number = F.col(column).cast("string").try_cast("double")
    return rows.filter(number.isNotNull()).orderBy(number)


def runtimes(models: DataFrame, limits: DataFrame, fallback: float) -> DataFrame:
    """Seconds a table takes: those of its models by (dataset, method), or the fallback."""
    joined = models.join(limits, ["dataset", "method"], "left")
    return joined.groupBy("table_name").agg(F.sum(F.coalesce("seconds", F.lit(fallback))).alias("seconds"), F.count(F.lit(1)).alias("n_models"))


def missing_models(models: DataFrame, results: DataFrame) -> DataFrame:
    return models.join(results.select("model_name").distinct(), "model_name", "left_anti")


def newest_results(files: DataFrame, by: list[str], stamp: str) -> DataFrame:
    """The newest file of each group; stamps sort as text."""
    return files.groupBy(*by).agg(F.max_by(F.struct(*[c for c in files.columns if c not in by]), stamp).alias("__r")).select(*by, "__r.*")


FULL_SAMPLE = "full_sample"
#: What the buckets of the development and income groupings are called in sheets.
EXTENT_BUCKETS = {
    "HDI": {"LOW": "LO", "> LOW": "ME_HI_VH", "GTLO": "ME_HI_VH", "MEDIUM": "ME", "HIGH": "HI", "V HIGH": "VH", "VERY HIGH": "VH", "V. HIGH": "VH"},
    "WB": {"LOW": "LO", "> LOW": "LM_UM_HI", "GTLO": "LM_UM_HI", "LOWER MIDDLE": "LM", "LM": "LM", "UPPER MIDDLE": "UM", "UM": "UM", "HIGH": "HI"},
}


def _blank(label: Any) -> bool:
    return label is None or label != label or str(label).strip() in ("", "nan")


def spatial_extent(label: Any, temporal: str, buckets: dict[str, dict[str, str]] = EXTENT_BUCKETS) -> str:
    """The subset that a sheet's label means: `World` or nothing is the full sample, `HDI > LOW` the bucket of the year before `temporal` (`YYYY-YYYY`) starts.

    Names of subsets stay, with `GTLO` written out; so do labels of no grouping.
    A bucket that its grouping does not have is an error.
    """
    if _blank(label):
        return FULL_SAMPLE
    raw = str(label).strip()
    if m := re.fullmatch(r"(HDI|WB)_([A-Z_]+)_(\d{4})", raw):
        return f"{m[1]}_{buckets[m[1]]['GTLO']}_{m[3]}" if m[2] == "GTLO" else raw
    words = " ".join(re.sub(r"[\[\]_]", " ", raw).split())
    if words.lower() == "world":
        return FULL_SAMPLE
    m = re.match(r"(HDI|WB)\s+(.+)", words, re.I)
    if not m:
        return raw
    found = buckets[m[1].upper()].get(m[2].upper())
    if found is None:
        raise ValueError(f"no bucket {m[2]!r} in {m[1].upper()}")
    return f"{m[1].upper()}_{found}_{int(temporal[:4]) - 1}"


def model_spec(
    model: dict[str, Any],
    effects: dict[str, tuple[str, list[str]]],
    clusters: dict[str, tuple[str, str | None]],
    sources: dict[str, tuple[str, str]],
    default_cluster: dict[str, str] | None = None,
    **labels: Any,
) -> dict[str, Any]:
    """A row of a model sheet as what `formula.fit` takes: formula, cluster, where, source, and the path of its variant.

    `effects` gives for a label its canonical name and its terms, `clusters` its
    name and column, `sources` for a resolution its table and default years;
    `default_cluster` is by resolution. `labels` (fixed_effects, clustering,
    resolution, temporal_extent, spatial_extent) go before the row's own.
    """
    of = lambda name, own=None: labels[name] if labels.get(name) is not None else model.get(own or name)
    pick = lambda table, label, what: table[label] if label in table else _no(what, label)
    fe = "0" if _blank(of("fixed_effects")) else str(of("fixed_effects")).strip()
    effect, terms = pick(effects, fe, "fixed effects")
    resolution = str(of("resolution", "data_source")).strip()
    source, years = pick(sources, resolution, "resolution")
    temporal = years if _blank(of("temporal_extent")) else str(of("temporal_extent")).strip()
    extent = spatial_extent(of("spatial_extent"), temporal)
    by = (default_cluster or {}).get(resolution) if _blank(of("clustering")) else str(of("clustering")).strip()
    cluster, column = pick(clusters, by, "clustering") if by is not None else ("", None)
    text = f"{str(model['dependent']).strip()} ~ {str(model['independent']).strip()}"
    text += f" | {' + '.join(terms)}" if terms else ""
    instruments = str(model.get("instruments", "0")).strip()
    text += f" | {instruments}" if instruments not in ("0", "nan", "", "None") else ""
    own = "" if _blank(model.get("query")) else without_years(workbook_where(str(model["query"])))
    name = str(model["model_name"]).strip()
    return {
        "model_name": name, "description": f"{model.get('section', 'Analysis')} - {model.get('subsection', name)}", "formula": text, "source": source, "cluster": column,
        "where": conjunction(temporal_where(temporal), own), "fixed_effects": effect, "clustering": cluster, "resolution": resolution, "temporal_extent": temporal, "spatial_extent": extent,
        "variant_path": [name, effect, resolution, temporal, extent, cluster],
    }


def _no(what: str, label: Any) -> Any:
    raise ValueError(f"no {what} {label!r}")
