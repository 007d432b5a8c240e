"""Model formulas: `y ~ a + b:c + log(d + 1) | fe1 + fe2^fe3 | endog ~ z1 + z2 | cluster1 + cluster2`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.absorb import absorbed_by, demean
from panelspark.operators.regression import Fit, constant_columns, fe_ols, ols, prune_singletons, tsls
from panelspark.storage import stash


@dataclass
class Formula:
    y: str
    x: list[str]
    effects: list[str] = field(default_factory=list)
    endog: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)
    cluster: list[str] = field(default_factory=list)


def _terms(part: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(part + "+"):
        depth += (ch == "(") - (ch == ")")
        if ch == "+" and depth == 0:
            out.append(part[last:i].strip())
            last = i + 1
    return [t for t in out if t and t not in ("0", "1")]


def parse(text: str) -> Formula:
    """Parts after the first are told apart by what they hold: one with `~` has instruments; before it effects, after it clusters."""
    parts = [p.strip() for p in text.split("|")]
    y, x = (s.strip() for s in parts[0].split("~", 1))
    out = Formula(y, _terms(x))
    rest = parts[1:]
    iv = next((i for i, p in enumerate(rest) if "~" in p), None)
    if iv is not None:
        endog, z = rest[iv].split("~", 1)
        out.endog, out.instruments = _terms(endog), _terms(z)
        before, after = rest[:iv], rest[iv + 1 :]
    else:
        before, after = rest[:1], rest[1:]
        after = [p for p in after if p != "0"][-1:]
    out.effects = [t for p in before for t in _terms(p)]
    out.cluster = [t for p in after for t in _terms(p)]
    return out


def term(text: str) -> Column:
    """A term as a column: names, numbers, `a:b`, `a^b` (a joint key), `log(x + c)`, `I(x**2)`, `(x == k)`."""
    if ":" in text:
        return term_product([term(t) for t in text.split(":")])
    if "^" in text:
        return F.concat_ws("_", *[F.col(t.strip()).cast("string") for t in text.split("^")])
    sql = re.sub(r"\bI\(", "(", text)
    sql = re.sub(r"\blog\(", "ln(", sql)
    sql = re.sub(r"([A-Za-z_]\w*)\s*\*\*\s*(\d+)", r"pow(\1, \2)", sql).replace("==", "=")
    out = F.expr(sql)
    return out.cast("double") if "=" in sql or "<" in sql or ">" in sql else out


def term_product(columns: list[Column]) -> Column:
    out = columns[0].cast("double")
    for c in columns[1:]:
        out = out * c.cast("double")
    return out


def model_frame(df: DataFrame, f: Formula) -> tuple[DataFrame, dict[str, str]]:
    """The model's columns under safe names, and the name of each term."""
    names: dict[str, str] = {}
    for t in dict.fromkeys([f.y, *f.x, *f.endog, *f.instruments, *f.effects, *f.cluster]):
        names[t] = t if re.fullmatch(r"\w+", t) else f"t{len(names)}"
    keys = {*f.effects, *f.cluster}
    return df.select(*[(term(t) if t in keys else term(t).cast("double")).alias(n) for t, n in names.items()]), names


def fit(df: DataFrame, formula: str, where: str | None = None, fe_method: str = "demean", se: str = "iid", drop_constants: bool = False, singletons: str | None = "iterative", **options) -> Fit:
    """Fits a formula over the complete rows that `where` keeps.

    With effects, rows that are alone in a group go first: `singletons` "iterative" until none is
    left, "one_pass" once, None not at all. `drop_constants` leaves out regressors that are constant
    on the rows that are left (within all effects' groups, where there are effects); without it
    such a regressor is an error. `se` is iid, HC1, or by the formula's clusters.
    """
    f = parse(formula)
    frame, names = model_frame(df.filter(where) if where else df, f)
    frame = frame.dropna()
    pick = lambda ts: [names[t] for t in ts]
    back = {n: t for t, n in names.items()}
    if singletons not in ("iterative", "one_pass", None):
        raise ValueError(f"no way {singletons} to prune singletons")
    if f.effects and singletons:
        frame = prune_singletons(frame, pick(f.effects), singletons == "iterative")
    if f.x and (gone := set(constant_columns(frame, pick(f.x), pick(f.effects)))):
        if not drop_constants:
            raise ValueError(f"constant regressors: {', '.join(back[n] for n in sorted(gone))}")
        f.x = [t for t in f.x if names[t] not in gone]
    if f.endog:
        absorbed = 0
        if f.effects:
            values = [n for n in dict.fromkeys(pick([f.y, *f.x, *f.endog, *f.instruments]))]
            frame = stash(demean(frame, pick(f.effects), values, **options), "swept")
            absorbed = absorbed_by(frame, pick(f.effects))
        out = tsls(frame, names[f.y], pick(f.x), pick(f.endog), pick(f.instruments), pick(f.cluster), intercept=not f.effects, absorbed=absorbed)
    elif f.effects:
        out = fe_ols(frame, names[f.y], pick(f.x), pick(f.effects), fe_method, pick(f.cluster), **options)
    else:
        out = ols(frame, names[f.y], pick(f.x), pick(f.cluster), se)
    out.names = [back.get(n, n) for n in out.names]
    return out
