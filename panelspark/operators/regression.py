"""Regression by sufficient statistics.

Raw rows never leave Spark: one aggregate gives the Gram matrix (k(k+1)/2 sums in
whole-stage codegen), clusters give k sums each, and numpy solves k-by-k systems
on the driver. Rows with a missing value in any column of a model are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.absorb import absorbed_by, by_size, demean
from panelspark.operators.stats import with_means
from panelspark.storage import discard, stash

INTERCEPT = "Intercept"


def _col(name: str, centre: dict[str, float] | None = None) -> Column:
    if name == INTERCEPT:
        return F.lit(1.0)
    mean = (centre or {}).get(name, 0.0)
    return F.col(name).cast("double") - F.lit(mean) if mean else F.col(name).cast("double")


def _means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Means to centre columns by: sums of squares of what is left do not cancel, however large the values and many the rows."""
    names = [c for c in dict.fromkeys(columns) if c != INTERCEPT]
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(names)}


def _uncentre(names: list[str], beta: np.ndarray, vcov: np.ndarray, centre: dict[str, float], y: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of columns as they are, from those of centred ones: the intercept alone moves."""
    turn = np.eye(len(names))
    turn[0, 1:] = [-centre[c] for c in names[1:]]
    out = turn @ beta
    out[0] += centre[y]
    return out, turn @ vcov @ turn.T


def gram(df: DataFrame, columns: list[str], weight: str | None = None, centre: dict[str, float] | None = None) -> tuple[np.ndarray, float]:
    """Cross products of the columns (less the means in `centre`) and the number of rows, in one aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(w * _col(columns[i], centre) * _col(columns[j], centre)).alias(f"g{i}_{j}") for i, j in pairs], F.sum(w).alias("n")).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out, float(row["n"] or 0)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function (Lentz's continued fraction)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / min(1 + num * d, -1e-300)
        c = 1 + num / c
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_pvalue(t: float, df: float) -> float:
    """Two-sided."""
    return _beta_tail(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) and df > 0 else float("nan")


def f_pvalue(f: float, d1: float, d2: float) -> float:
    return _beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if math.isfinite(f) and f >= 0 and d2 > 0 else float("nan")


@dataclass
class Fit:
    """Coefficients with their covariance and the usual statistics."""

    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: float
    df: float
    stats: dict[str, float] = field(default_factory=dict)
    first_stage: dict[str, Fit] = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0))

    def rows(self) -> list[tuple[str, float, float, float, float]]:
        """(name, estimate, standard error, t, p) of each coefficient."""
        t = np.divide(self.coef, self.se, out=np.full(len(self.coef), np.nan), where=self.se > 0)
        return [(n, float(b), float(s), float(x), t_pvalue(float(x), self.df)) for n, b, s, x in zip(self.names, self.coef, self.se, t, strict=True)]

    def top(self, n: int) -> list[tuple[str, float, float, float, float]]:
        """The `n` rows of the greatest coefficients by magnitude, without the intercept."""
        return sorted((r for r in self.rows() if r[0] != INTERCEPT), key=lambda r: -abs(r[1]))[:n]

    def joint_f(self) -> float:
        """Wald F of all coefficients but the intercept."""
        keep = [i for i, n in enumerate(self.names) if n != INTERCEPT]
        b, v = self.coef[keep], self.vcov[np.ix_(keep, keep)]
        return float(b @ np.linalg.pinv(v) @ b / max(1, len(keep)))


def compress(df: DataFrame, y: str, x: list[str], by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """One row for each combination of regressors (rounded to `digits`): `n`, `sum_y`, `sum_y2`.

    The combinations are what fits; a Gram matrix of them equals that of the raw rows.
    """
    keys = [(F.bround(c, digits) if digits is not None else F.col(c)).alias(c) for c in [*x, *by]]
    clean = df.dropna(subset=[y, *x, *by])
    return clean.select(*keys, F.col(y).cast("double").alias("__y")).groupBy(*x, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("sum_y"), F.sum(F.col("__y") * F.col("__y")).alias("sum_y2"))


def _scores(df: DataFrame, cluster: list[str], regressors: list[Column], resid: Column) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their scores, and the number of clusters: k sums a cluster, k(k+1)/2 in the end."""
    k = len(regressors)
    own = df.groupBy(*cluster).agg(*[F.sum(z * resid).alias(f"s{i}") for i, z in enumerate(regressors)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = own.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("g")).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
    return out, int(row["g"])


def _meat(df: DataFrame, se: str, cluster: list[str], regressors: list[Column], resid: Column, n: float, k: int) -> np.ndarray:
    if se == "HC1":
        pairs = [(i, j) for i in range(len(regressors)) for j in range(i, len(regressors))]
        row = df.agg(*[F.sum(regressors[i] * regressors[j] * resid * resid).alias(f"m{i}_{j}") for i, j in pairs]).first()
        out = np.zeros((len(regressors),) * 2)
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
        return out * n / (n - k)
    adjusted = lambda keys: (lambda m, g: m * (g / max(g - 1, 1)) * (n - 1) / (n - k))(*_scores(df, keys, regressors, resid))
    if len(cluster) == 1:
        return adjusted(cluster)
    if len(cluster) == 2:  # Cameron, Gelbach, Miller: both less their intersection
        return adjusted(cluster[:1]) + adjusted(cluster[1:]) - adjusted(cluster)
    raise ValueError("one or two cluster columns")


def ols(df: DataFrame, y: str, x: list[str], cluster: list[str] | None = None, se: str = "iid", intercept: bool = True, weight: str | None = None, ridge: float = 0.0, absorbed: int = 0) -> Fit:
    """Least squares. `se`: iid, HC1, or by one or two cluster columns. `absorbed` counts fixed effects taken out before.

    `weight` counts for as many rows in the sums; the robust errors weight each row's score.
    """
    cluster = cluster or []
    clean = df.dropna(subset=[*dict.fromkeys([y, *x, *cluster, *([weight] if weight else [])])])
    names = [INTERCEPT, *x] if intercept else list(x)
    centre = _means(clean, [*x, y]) if intercept and not ridge else {c: 0.0 for c in [*x, y]}
    g, n = gram(clean, [*names, y], weight, centre)
    k = len(names)
    xx, xy, yy = g[:k, :k] + ridge * np.eye(k), g[:k, k], g[k, k]
    beta = np.linalg.solve(xx, xy)
    rss = float(yy - 2 * beta @ xy + beta @ g[:k, :k] @ beta)
    df_resid = n - k - absorbed
    bread = np.linalg.inv(xx)
    if cluster or se == "HC1":
        regressors = [_col(c, centre) for c in names]
        resid = _col(y, centre) - sum((F.lit(float(b)) * z for b, z in zip(beta, regressors, strict=True)), F.lit(0.0))
        resid = resid * F.col(weight) if weight else resid
        vcov = bread @ _meat(clean, se, cluster, regressors, resid, n, k + absorbed) @ bread
    else:
        vcov = bread * rss / df_resid
    mean = g[0, k] / n if intercept else 0.0
    tss = yy - n * mean * mean
    if intercept:
        beta, vcov = _uncentre(names, beta, vcov, centre, y)
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    stats = {"rss": rss, "tss": tss, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - intercept) / df_resid, "rmse": math.sqrt(max(rss, 0) / df_resid)}
    q = k - int(intercept)
    if q and rss > 0:
        stats["f"] = ((tss - rss) / q) / (rss / df_resid)
        stats["f_pvalue"] = f_pvalue(stats["f"], q, df_resid)
    return Fit(names, beta, vcov, n, df_resid, {k: float(v) for k, v in stats.items()})


def tsls(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], cluster: list[str] | None = None, weak: float = 10.0, intercept: bool = True, absorbed: int = 0) -> Fit:
    """Two-stage least squares from one Gram matrix; first stages with the F of the instruments and a flag where it is weak.

    `absorbed` counts fixed effects taken out before; such data have no intercept.
    """
    cluster = cluster or []
    clean = df.dropna(subset=[y, *exog, *endog, *instruments, *cluster])
    w = [INTERCEPT, *exog] if intercept else list(exog)
    columns = [*w, *instruments, *endog, y]
    centre = _means(clean, columns) if intercept else {c: 0.0 for c in columns}
    g, n = gram(clean, columns, centre=centre)
    at = {c: i for i, c in enumerate(columns)}
    iz, ix, iy = [at[c] for c in [*w, *instruments]], [at[c] for c in [*w, *endog]], at[y]
    zz, zx, zy = g[np.ix_(iz, iz)], g[np.ix_(iz, ix)], g[iz, iy]
    pi = np.linalg.solve(zz, zx)  # fitted regressors = Z pi
    bread = np.linalg.inv(zx.T @ pi)
    beta = bread @ (pi.T @ zy)
    k = len(ix)
    df_resid = n - k - absorbed
    rss = float(g[iy, iy] - 2 * beta @ g[ix, iy] + beta @ g[np.ix_(ix, ix)] @ beta)
    if cluster:
        fitted = [sum((F.lit(float(pi[r, c])) * _col(columns[z], centre) for r, z in enumerate(iz)), F.lit(0.0)) for c in range(k)]
        resid = _col(y, centre) - sum((F.lit(float(b)) * _col(columns[i], centre) for b, i in zip(beta, ix, strict=True)), F.lit(0.0))
        vcov = bread @ _meat(clean, "cluster", cluster, fitted, resid, n, k + absorbed) @ bread
    else:
        vcov = bread * rss / df_resid
    names = [*w, *endog]
    if intercept:
        beta, vcov = _uncentre(names, beta, vcov, centre, y)
    fit = Fit(names, beta, vcov, n, df_resid, {"rss": rss, "rmse": math.sqrt(max(rss, 0) / df_resid)})
    for name in endog:
        e = at[name]
        coef = np.linalg.solve(zz, g[iz, e])
        full = float(g[e, e] - coef @ g[iz, e])
        few = [at[c] for c in w]
        part = np.linalg.solve(g[np.ix_(few, few)], g[few, e]) if few else np.zeros(0)
        short = float(g[e, e] - part @ g[few, e])
        d2 = n - len(iz) - absorbed
        f = ((short - full) / len(instruments)) / (full / d2)
        first, spread = coef, np.linalg.inv(zz) * full / d2
        if intercept:
            first, spread = _uncentre([*w, *instruments], first, spread, centre, name)
        fit.first_stage[name] = Fit([*w, *instruments], first, spread, n, d2, {"f": f, "f_pvalue": f_pvalue(f, len(instruments), d2), "weak": float(f < weak)})
    return fit


def prune_singletons(df: DataFrame, effects: list[str], iterative: bool = True) -> DataFrame:
    """Rows whose groups all have two rows or more; `iterative` repeats until none is left alone.

    Each round takes a row at least, so the rounds end by themselves.
    """
    before, start = None, df
    while True:
        for e in effects:
            # Groups are counted by partial aggregates: none has to meet in one task.
            alone = df.groupBy(F.col(e).alias("__alone")).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select("__alone")
            df = df.join(alone, F.col(e).eqNullSafe(F.col("__alone")), "left_anti")
        if not iterative:
            return df
        pruned = stash(df, "pruned")
        discard(start)
        df = start = pruned
        n = df.count()
        if n == before:
            return df
        before = n


def constant_columns(df: DataFrame, columns: list[str], effects: list[str] | None = None) -> list[str]:
    """Columns with one value, or with one value in each group of one of the effects."""
    found: set[str] = set()
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in columns]).first()
    found |= {c for c in columns if row[c]}
    for e in effects or []:
        if rest := [c for c in columns if c not in found]:
            own = df.groupBy(e).agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(f"__c{i}") for i, c in enumerate(rest)])
            row = own.agg(*[F.bool_and(f"__c{i}").alias(f"__c{i}") for i in range(len(rest))]).first()
            found |= {c for i, c in enumerate(rest) if row[f"__c{i}"]}
    return [c for c in columns if c in found]


def fe_ols(df: DataFrame, y: str, x: list[str], effects: list[str], method: str = "demean", cluster: list[str] | None = None, means: list[str] | None = None, **options) -> Fit:
    """OLS with fixed effects.

    `demean` takes all effects out; `mundlak` has the group means of x beside x instead;
    `mixed` has means for the effects in `means` and takes the others out of those too;
    `auto` is `mixed` with means for the effect with most groups. The estimates of `auto`
    on a balanced panel are those of `demean`, but what the means leave of that effect stays
    in the residual: cluster by it, iid errors are too large or too small.
    """
    clean = df.dropna(subset=list(dict.fromkeys([y, *x, *effects, *(cluster or [])])))
    if method not in ("demean", "mundlak", "mixed", "auto"):
        raise ValueError(f"no method {method}")
    if method == "auto":
        means = by_size(clean, effects)[:1]
    by = {"demean": [], "mundlak": effects}.get(method, means or [])
    if not set(by) <= set(effects):
        raise ValueError("means are for effects of the model")
    wide = clean.select(*dict.fromkeys([*effects, *(cluster or [])]), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *x]) if c not in (*effects, *(cluster or []))])
    extra = [f"{v}_mean_{e}" for e in by for v in x]
    for e in by:
        wide = with_means(wide, [e], {v: f"{v}_mean_{e}" for v in x})
    swept = [e for e in effects if e not in by]
    if not swept:
        return ols(wide, y, [*x, *extra], cluster)
    left = stash(demean(stash(wide, "wide") if by else wide, swept, [y, *x, *extra], **options), "swept")
    return ols(left, y, [*x, *extra], cluster, intercept=False, absorbed=absorbed_by(left, swept))


def cluster_bootstrap(df: DataFrame, y: str, x: list[str], cluster: str, draws: int, seed: int = 0) -> np.ndarray:
    """Coefficients of resampled clusters. A draw weights clusters by Poisson(1) numbers from their hash and the draw, so nothing is collected."""
    names = [INTERCEPT, *x]
    clean = df.dropna(subset=[y, *x, cluster])
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    k = len(names)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    cols = [*names, y]
    centre = _means(clean, [*x, y])
    own = clean.groupBy(cluster).agg(*[F.sum(_col(cols[i], centre) * _col(cols[j], centre)).alias(f"g{i}_{j}") for i, j in pairs])
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.pmod(F.xxhash64(cluster, "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= float(c), 1.0).otherwise(0.0) for c in cuts), F.lit(0.0))
    rows = drawn.withColumn("w", weight).groupBy("draw").agg(*[F.sum(F.col("w") * F.col(f"g{i}_{j}")).alias(f"g{i}_{j}") for i, j in pairs]).orderBy("draw").collect()
    out = []
    for r in rows:
        g = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        beta = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
        out.append(_uncentre(names, beta, np.zeros((k, k)), centre, y)[0])
    return np.array(out)


def fit_frame(spark, fit: Fit) -> DataFrame:
    """A fit's coefficients as a DataFrame."""
    return spark.createDataFrame([(n, b, s, t, p) for n, b, s, t, p in fit.rows()], "name string, estimate double, std_error double, t double, p double")
