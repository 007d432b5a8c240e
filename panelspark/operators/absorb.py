"""Fixed effects taken out of values by conjugate gradients on tables of effects.

The rows are read twice: once for the sums of each cell (a combination of groups),
once to subtract. In between, only cells and effects move. The effect with most
groups is eliminated exactly; what is left is a system in the other effects, whose
matrix is never formed: a product is two sums over the cells. No window runs over
rows or groups, and a group may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import storage
from panelspark.operators.graph import connected
from panelspark.storage import discard, stash


def _key(effect: str) -> Column:
    """A group as text; null is a group."""
    return F.coalesce(F.concat(F.lit("="), F.col(effect).cast("string")), F.lit("null"))


def by_size(df: DataFrame, effects: list[str]) -> list[str]:
    """The effects, that with most groups first."""
    sizes = df.agg(*[F.approx_count_distinct(_key(e), 0.01).alias(f"e{i}") for i, e in enumerate(effects)]).first()
    return [effects[i] for i in sorted(range(len(effects)), key=lambda i: -sizes[f"e{i}"])]


class _System:
    """The normal equations of effects: `cells` (k0, k1, ..., n, s0, s1, ...: rows and sums of the values)."""

    def __init__(self, df: DataFrame, order: list[str], values: list[str]):
        self.effects, self.values = range(len(order)), range(len(values))
        whole = df.dropna(subset=values)
        row = whole.agg(*[F.avg(F.col(v).cast("double")).alias(f"m{i}") for i, v in enumerate(values)], *[F.max(F.abs(F.col(v).cast("double"))).alias(f"x{i}") for i, v in enumerate(values)]).first()
        self.mean = [row[f"m{i}"] or 0.0 for i in self.values]
        self.largest = max([row[f"x{i}"] or 0.0 for i in self.values])
        keys = [_key(e).alias(f"k{i}") for i, e in enumerate(order)]
        self.cells = stash(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(v).cast("double") - F.lit(self.mean[i])).alias(f"s{i}") for i, v in enumerate(values)]), "cells")
        self.rest = [e for e in self.effects if e]

    def each(self, made: str, of) -> list[Column]:
        return [of(i).alias(f"{made}{i}") for i in self.values]

    def spread(self, cells: DataFrame, table: DataFrame, name: str) -> DataFrame:
        """Adds the sum over the small effects of `name` in `table` (e, k, ...) to each cell, as t0, t1, ..."""
        for e in self.rest:
            own = table.filter(F.col("e") == e).select(F.col("k").alias(f"k{e}"), *self.each(f"_{e}_", lambda i: F.col(f"{name}{i}")))
            cells = cells.join(own, f"k{e}")
        return cells.withColumns({f"t{i}": reduce(lambda a, b: a + b, [F.col(f"_{e}_{i}") for e in self.rest]) for i in self.values})

    def gathered(self, cells: DataFrame, value) -> DataFrame:
        """For each group of the small effects the sum over its cells of value(i), less n times the mean of its k0 group: e, k, n, g0, g1, ..."""
        means = cells.groupBy("k0").agg(*[(F.sum(value(i)) / F.sum("n")).alias(f"m{i}") for i in self.values])
        left = cells.join(means, "k0").select(*[f"k{e}" for e in self.rest], "n", *self.each("g", lambda i: value(i) - F.col("n") * F.col(f"m{i}")))
        to = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"k{e}").alias("k")) for e in self.rest]))
        return left.select(to.alias("to"), "n", *[f"g{i}" for i in self.values]).groupBy("to.e", "to.k").agg(F.sum("n").alias("n"), *self.each("g", lambda i: F.sum(f"g{i}")))

    def product(self, table: DataFrame, name: str) -> DataFrame:
        return self.gathered(self.spread(self.cells, table, name), lambda i: F.col("n") * F.col(f"t{i}")).drop("n")

    def residual(self, table: DataFrame) -> DataFrame:
        """What the effects x in `table` leave of each small group's sums: e, k, g0, g1, ..."""
        return self.gathered(self.spread(self.cells, table, "x"), lambda i: F.col(f"s{i}") - F.col("n") * F.col(f"t{i}")).drop("n")

    def solve(self, tolerance: float, max_rounds: int) -> DataFrame:
        """The small effects (e, k, x0, x1, ...), by conjugate gradients scaled by the groups' sizes.

        Their vectors are arrays of the driver while the small effects have few groups (checked), else tables.
        """
        start = stash(self.gathered(self.cells, lambda i: F.col(f"s{i}")), "effects")
        few = start.count() * (3 * len(self.values) + 3) <= storage.SMALL_CELLS
        return (self._by_arrays if few else self._by_tables)(start, tolerance, max_rounds)

    def _by_arrays(self, start: DataFrame, tolerance: float, max_rounds: int) -> DataFrame:
        spark, found = start.sparkSession, start.toArrow()
        keys = list(zip(found["e"].to_pylist(), found["k"].to_pylist(), strict=True))
        place = {k: i for i, k in enumerate(keys)}
        columns = lambda t: np.column_stack([t[f"g{i}"].to_numpy() for i in self.values])

        def table(v: np.ndarray, name: str) -> DataFrame:
            made = {"e": found["e"], "k": found["k"], **{f"{name}{i}": pa.array(np.ascontiguousarray(v[:, i])) for i in self.values}}
            return F.broadcast(spark.createDataFrame(pa.table(made)))

        def computed(of: DataFrame) -> np.ndarray:
            t = of.toArrow()
            out = np.zeros((len(keys), len(self.values)))
            out[[place[k] for k in zip(t["e"].to_pylist(), t["k"].to_pylist(), strict=True)]] = columns(t)
            return out

        n, r = found["n"].to_numpy().astype(float)[:, None], columns(found)
        x, p, size, rounds = np.zeros_like(r), r / n, (r * r / n).sum(axis=0), 0
        while r.size and np.abs(r / n).max() > tolerance:
            if rounds >= max_rounds:
                raise RuntimeError(_unfinished(float(np.abs(r / n).max()), tolerance, max_rounds))
            rounds += 1
            q = computed(self.product(table(p, "p"), "p"))
            curve = (p * q).sum(axis=0)
            step = np.divide(size, curve, out=np.zeros_like(size), where=curve > 0)
            x, r = x + step * p, r - step * q
            if np.abs(r / n).max() <= tolerance:
                # What rounding has left: the residual anew, and on from there if need be.
                r = computed(self.residual(table(x, "x")))
                p, size = r / n, (r * r / n).sum(axis=0)
                continue
            now = (r * r / n).sum(axis=0)
            p, size = r / n + np.divide(now, size, out=np.zeros_like(size), where=size > 0) * p, now
        return table(x, "x")

    def _by_tables(self, start: DataFrame, tolerance: float, max_rounds: int) -> DataFrame:
        def fresh(of: DataFrame) -> list[Column]:
            return ["e", "k", "n", *[f"x{i}" for i in self.values], *self.each("r", lambda i: F.col(f"g{i}")), *self.each("p", lambda i: F.col(f"g{i}") / F.col("n"))]

        def measure(of: DataFrame, r) -> tuple[list[float], float]:
            row = of.agg(*self.each("z", lambda i: F.sum(r(i) * r(i) / F.col("n"))), F.max(F.greatest(F.lit(0.0), *[F.abs(r(i)) / F.col("n") for i in self.values])).alias("left")).first()
            return [row[f"z{i}"] or 0.0 for i in self.values], row["left"] or 0.0

        state = start.withColumns({f"x{i}": F.lit(0.0) for i in self.values})
        state = stash(state.select(*fresh(state)), "effects")
        size, left = measure(state, lambda i: F.col(f"r{i}"))
        rounds = 0
        while left > tolerance:
            if rounds >= max_rounds:
                raise RuntimeError(_unfinished(left, tolerance, max_rounds))
            rounds += 1
            with_q = stash(state.join(self.product(state, "p"), ["e", "k"]), "effects")
            curve = with_q.agg(*self.each("c", lambda i: F.sum(F.col(f"p{i}") * F.col(f"g{i}")))).first()
            step = [size[i] / curve[f"c{i}"] if (curve[f"c{i}"] or 0) > 0 else 0.0 for i in self.values]
            moved = lambda i, step=step: F.col(f"r{i}") - F.lit(step[i]) * F.col(f"g{i}")
            now, left = measure(with_q, moved)
            solved = self.each("x", lambda i, step=step: F.col(f"x{i}") + F.lit(step[i]) * F.col(f"p{i}"))
            if left <= tolerance:
                state_x = stash(with_q.select("e", "k", "n", *solved), "effects")
                joined = state_x.join(self.residual(state_x), ["e", "k"])
                after = stash(joined.select(*fresh(joined)), "effects")
                now, left = measure(after, lambda i: F.col(f"r{i}"))
                discard(state_x)
            else:
                turn = [now[i] / size[i] if size[i] else 0.0 for i in self.values]
                after = stash(with_q.select("e", "k", "n", *solved, *self.each("r", moved), *self.each("p", lambda i, moved=moved, turn=turn: moved(i) / F.col("n") + F.lit(turn[i]) * F.col(f"p{i}"))), "effects")
            discard(state, with_q)
            state, size = after, now
        return state.select("e", "k", *[f"x{i}" for i in self.values])


def _unfinished(left: float, tolerance: float, rounds: int) -> str:
    return f"fixed effects: group means of {left:g} (above {tolerance:g}) after {rounds} rounds"


def demean(df: DataFrame, effects: list[str], values: list[str], tolerance: float = 1e-8, max_rounds: int = 1000) -> DataFrame:
    """`df` with all fixed effects taken out of `values` (as doubles).

    Ends when no group mean of what is left is above `tolerance` (or 1e-13 of the
    largest value, what a double holds); a RuntimeError says that `max_rounds`
    rounds of conjugate gradients did not do. Rows with a missing value do not
    count, and a missing value stays missing. Null is a group like others.
    """
    order = by_size(df, effects) if len(effects) > 1 else effects
    system = _System(df, order, values)
    tables: list[DataFrame] = []
    cells = system.cells
    taken = lambda i: F.col(f"s{i}")
    if len(order) > 1:
        small = system.solve(max(tolerance, 1e-13 * system.largest), max_rounds)
        tables = [small.filter(F.col("e") == e).select(F.col("k").alias(f"__k{e}"), *[F.col(f"x{i}").alias(f"__x{e}_{i}") for i in system.values]) for e in system.rest]
        cells = system.spread(cells, small, "x")
        taken = lambda i: F.col(f"s{i}") - F.col("n") * F.col(f"t{i}")
    large = cells.groupBy(F.col("k0").alias("__k0")).agg(*[(F.sum(taken(i)) / F.sum("n")).alias(f"__x0_{i}") for i in system.values])
    out = df
    for e, table in enumerate([stash(large, "effects"), *tables]):
        out = out.withColumn(f"__k{e}", _key(order[e])).join(table, f"__k{e}", "left")
    left = {v: F.col(v).cast("double") - F.lit(system.mean[i]) - reduce(lambda a, b: a + b, [F.col(f"__x{e}_{i}") for e in system.effects]) for i, v in enumerate(values)}
    return out.select(*[left[c].alias(c) if c in left else F.col(c) for c in df.columns])


def absorbed_by(df: DataFrame, effects: list[str]) -> int:
    """Degrees of freedom that the effects take.

    The groups of the first effect, and of each later one its groups less what an
    earlier effect already says: the connected components of the graph that joins
    the two effects' groups (the most, over the earlier effects). That is exact for
    one and two effects and for nested ones; with three or more that depend on each
    other in no pair it may count some too many.
    """
    keys = stash(df.select(*[_key(e).alias(f"k{i}") for i, e in enumerate(effects)]).distinct(), "groups")
    sizes = keys.agg(*[F.count_distinct(f"k{i}").alias(f"k{i}") for i in range(len(effects))]).first()
    total = sum(sizes)
    for b in range(1, len(effects)):
        total -= max(components(keys, f"k{a}", f"k{b}") for a in range(b))
    discard(keys)
    return total


def components(pairs: DataFrame, a: str, b: str) -> int:
    """How many parts the graph of a's and b's groups has.

    A group of `a` joins all its groups of `b` to the least of them; that leaves
    edges among the groups of `b`.
    """
    least = pairs.groupBy(F.col(a).alias("__a")).agg(F.min(b).alias("v"))
    edges = pairs.select(F.col(a).alias("__a"), F.col(b).alias("u")).distinct().join(least, "__a").select("u", "v").distinct()
    return connected(edges).select("label").distinct().count()
