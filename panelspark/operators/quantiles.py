"""Exact quantiles of groups of any size, without a buffer that holds a group.

Groups of up to BIG values are sorted by a window, which spills. A larger group is
narrowed first: a sketch of bounded size proposes a bracket around each wanted rank,
a count by partial aggregates says how many values lie below and inside, and the
side that holds the rank is kept, whatever the sketch's error. When a bracket holds
few values, they are counted by value and the rank is found among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.storage import discard, stash

#: Values of a group up to which it is sorted as a whole.
BIG = 1_000_000
#: Steps of the sketch's grid, its accuracy, and rounds of narrowing at most.
GRID, ACCURACY, ROUNDS = 500, 4000, 12


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def join_keys(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins on `by`, null keys on null keys; with no keys the one row of `right` goes to all."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = [f"__by{i}" for i in range(len(by))]
    return left.join(right.withColumnsRenamed(dict(zip(by, names, strict=True))), _same(by, names), how).drop(*names)


def _position(p: float, n: str = "n") -> Column:
    return (F.col(n) - 1) * F.lit(p)


def _between(p: float, low: Column, high: Column) -> Column:
    """The value at place p among n, between those at the ranks around it."""
    at = _position(p)
    lower, upper = F.floor(at), F.ceil(at)
    return F.when(lower == upper, low).otherwise((upper - at) * low + (at - lower) * high)


def quantiles(df: DataFrame, by: list[str], values: list[str], probs: list[float], big: int | None = None) -> DataFrame:
    """`by` and, for each value, the array of its quantiles at `probs` (linear between ranks), null where a group has none.

    Missing values do not count; NaN is the largest value. The groups are counted
    when this is called, since large ones take passes of their own.
    """
    big = BIG if big is None else big
    keys = [*by, "__i"]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])).alias("__s")).select(*by, "__s.__i", "__s.v").filter(F.col("v").isNotNull())
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = stash(sizes.filter(F.col("n") > big), "large")
    if large.isEmpty():
        found = _sorted(long, keys, probs)
        discard(large)
    else:
        rest = join_keys(long, F.broadcast(large.select(*keys)), keys, "left_anti")
        found = _sorted(rest, keys, probs).unionByName(_narrowed(long, large, keys, probs, big))
    wide = found.groupBy(*by).agg(*[F.first(F.when(F.col("__i") == i, F.col("q")), ignorenulls=True).alias(v) for i, v in enumerate(values)])
    groups = df.select(*by).distinct() if by else None
    return join_keys(groups, wide, by, "left").select(*by, *values) if by else wide


def _sorted(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys and `q`, by one sort of each group."""
    own = Window.partitionBy(*keys)
    placed = long.select(*keys, "v", (F.row_number().over(own.orderBy("v")) - 1).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    picked = [(F.max(F.when(F.col("r") == F.floor(_position(p)), F.col("v"))), F.max(F.when(F.col("r") == F.ceil(_position(p)), F.col("v")))) for p in probs]
    got = placed.groupBy(*keys).agg(F.first("n").alias("n"), *[c.alias(f"{s}{i}") for i, pair in enumerate(picked) for s, c in zip("lh", pair, strict=True)])
    return got.select(*keys, F.array(*[_between(p, F.col(f"l{i}"), F.col(f"h{i}")) for i, p in enumerate(probs)]).alias("q"))


def _narrowed(long: DataFrame, large: DataFrame, keys: list[str], probs: list[float], big: int) -> DataFrame:
    """keys and `q` of the large groups.

    A bracket is (keys, k: the place in `probs`, n, lo, hi, below, inside): of the group's n values
    `below` lie under lo and `inside` from lo to hi, and the ranks around the quantile are among these.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(_position(p)).alias("r0"), F.ceil(_position(p)).alias("r1")) for k, p in enumerate(probs)]))
    state = stash(large.select(*keys, "n", "lo", "hi", wanted.alias("w")).select(*keys, "n", "w.*", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "brackets")
    ids = [*keys, "k"]
    for _ in range(ROUNDS):
        open_ = state.filter((F.col("inside") > big) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        rows = _inside(long, open_, keys)
        grid = rows.groupBy(*ids).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
        step = F.lit(float(GRID)) / F.col("inside")
        first, last = F.floor((F.col("r0") - F.col("below")) * step - 1), F.ceil((F.col("r1") + 1 - F.col("below")) * step + 1)
        cut = join_keys(open_, grid, ids).withColumn("a", F.when(first < 0, F.col("lo")).otherwise(F.col("grid")[first.cast("int")])).withColumn("b", F.when(last > GRID, F.col("hi")).otherwise(F.col("grid")[last.cast("int")])).drop("grid")
        cut = stash(cut, "brackets")
        counts = _inside(long, cut, keys).groupBy(*ids).agg(
            F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).alias("within"),
            F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("before"), F.min(F.when(F.col("v") > F.col("b"), F.col("v"))).alias("after"),
        )
        at0, at1 = F.col("r0") - F.col("below"), F.col("r1") - F.col("below")
        # The part that holds both ranks: one of three, or a joint of two where they fall on either side of a cut.
        left, right = F.when(at0 >= F.col("under") + F.col("within"), 2).when(at0 >= F.col("under"), 1).otherwise(0), F.when(at1 >= F.col("under") + F.col("within"), 2).when(at1 >= F.col("under"), 1).otherwise(0)
        part = join_keys(cut, counts, ids).withColumns({"p": left, "s": right})
        moved = part.select(
            *keys, "n", "k", "r0", "r1",
            F.when(F.col("p") == 0, F.col("lo")).when(F.col("p") == 1, F.col("a")).otherwise(F.col("after")).alias("lo"),
            F.when(F.col("s") == 2, F.col("hi")).when(F.col("s") == 1, F.col("b")).otherwise(F.col("before")).alias("hi"),
            (F.col("below") + F.when(F.col("p") == 0, 0).when(F.col("p") == 1, F.col("under")).otherwise(F.col("under") + F.col("within"))).alias("below"),
            (F.when(F.col("s") == 2, F.col("inside")).when(F.col("s") == 1, F.col("under") + F.col("within")).otherwise(F.col("under")) - F.when(F.col("p") == 0, 0).when(F.col("p") == 1, F.col("under")).otherwise(F.col("under") + F.col("within"))).alias("inside"),
        )
        closed = state.filter((F.col("inside") <= big) | ~(F.col("lo") < F.col("hi"))).select(*moved.columns)
        before, state = state, stash(closed.unionByName(moved), "brackets")
        less = join_keys(cut.select(*ids, F.col("inside").alias("__was")), state.select(*ids, "inside"), ids).filter("inside < 0.9 * __was").isEmpty()
        discard(before, cut)
        if less:
            break  # few distinct values, each in many rows: counts by value are few
    # Counted by value, so that a value of any number of rows is one; then the ranks among the bracket's values.
    counted = _inside(long, state, keys).groupBy(*ids, "v").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy(*ids).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = join_keys(counted.withColumn("cum", running), F.broadcast(state.select(*ids, "n", "r0", "r1", "below")), ids)
    value = lambda r: F.min(F.when(F.col("cum") + F.col("below") > F.col(r), F.col("v")))
    got = ranked.groupBy(*ids).agg(F.first("n").alias("n"), value("r0").alias("l"), value("r1").alias("h"))
    one = got.withColumn("q", reduce(lambda a, k: a.when(F.col("k") == k, _between(probs[k], F.col("l"), F.col("h"))), range(1, len(probs)), F.when(F.col("k") == 0, _between(probs[0], F.col("l"), F.col("h")))))
    return one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))


def _inside(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside each bracket, with it; brackets are as few as the groups over the bound."""
    return join_keys(long, F.broadcast(brackets), keys).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def with_quantiles(aggregated: DataFrame, df: DataFrame, by: list[str], value: str | Column, names: dict[str, float], big: int | None = None) -> DataFrame:
    """`aggregated` (a row for each group of `by`) with quantiles of a value under the given names."""
    v = F.col(value) if isinstance(value, str) else value
    q = quantiles(df.select(*by, v.alias("__v")), by, ["__v"], list(names.values()), big)
    return join_keys(aggregated, q, by).select(*aggregated.columns, *[F.col("__v")[i].alias(n) for i, n in enumerate(names)])
