"""Percentiles of groups by ranks, without a buffer or task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A share (interpolated between neighbours), or the rank from 1 as a function of the number of values.
Point = float | Callable[[Column], Column]


def upper_median(total: Column) -> Column:
    """Rank of the median, of two middle values the greater."""
    return total - F.ceil(total / 2).cast("long") + 1


def tenth_from_above(total: Column) -> Column:
    """Rank of the value a tenth down the list."""
    return total - F.floor(total / 10).cast("long")


def part_of(v: Column) -> Column:
    """Part of a scale, 64 to a doubling, in the order of the values; negative ones mirror the positive, NaN comes last."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-6)) * 1e6) * 64) + 1
    return F.when(F.isnan(v), F.lit(1 << 40)).when(F.abs(v) < 1e-6, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def quantiles(rows: DataFrame, by: list[str], value: str, points: list[Point], name: str = "q", approximate: bool = False) -> DataFrame:
    """(by, name, n, mean): percentiles of ``value``, an array in the order of ``points``, with the number of values and their mean, for each group that has values.

    ``approximate`` (shares only) takes a mergeable summary of bounded size in one pass instead."""
    known = rows.where(F.col(value).isNotNull())
    if approximate:
        return known.groupBy(*by).agg(F.percentile_approx(value, F.array(*map(F.lit, points)), F.lit(10_000)).alias(name), F.count("*").alias("n"), F.avg(value).alias("mean"))
    return quantiles_of_counts(known.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), by, points, name)


def quantiles_of_counts(counts: DataFrame, by: list[str], points: list[Point], name: str = "q") -> DataFrame:
    """The same from ``counts`` (by, v, n), the number of times of each value.

    The counts of parts of the scale, some thousands a group, tell in which parts the wanted ranks lie. Only values of these parts are ranked, part by
    part: a part spans a hundredth of its values, so that a group of any size is spread, and what is sorted spills. Without
    groups (``by`` empty) there is one row, of nulls if there are no values. The counts are used twice, from one shuffle."""
    counted = counts.where(F.col("v").isNotNull()).select(*by, "v", "n").withColumn("part", part_of(F.col("v")))
    group = Window.partitionBy(*by)
    upto = F.sum("size").over(group.orderBy("part"))
    parts = counted.groupBy(*by, "part").agg(F.sum("n").alias("size"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    parts = parts.select(*by, "part", (upto - F.col("size")).alias("earlier"), upto.alias("upto"), F.sum("size").over(group).alias("total"), F.sum("sum").over(group).alias("sum"))
    total = F.col("total")
    places = [None if callable(p) else p * (total - 1) for p in points]  # from 0, with a fraction
    ranks = [r for p, x in zip(points, places, strict=True) for r in ([p(total)] * 2 if callable(p) else [F.floor(x).cast("long") + 1, F.ceil(x).cast("long") + 1])]
    inside = [(r > F.col("earlier")) & (r <= F.col("upto")) for r in ranks]
    wanted = parts.where(F.array_contains(F.array(*inside), True)).drop("upto")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    near = counted.alias("c").join(wanted.alias("w"), [*same, F.col("w.part") == F.col("c.part")]).select("c.*", "w.earlier", "w.total", "w.sum")
    ranked = near.withColumn("upto", F.col("earlier") + F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v")))
    found = [F.max(F.when((r > F.col("upto") - F.col("n")) & (r <= F.col("upto")), F.col("v"))).alias(f"v{i}") for i, r in enumerate(ranks)]
    each = ranked.groupBy(*by).agg(F.first("total").alias("total"), F.first("sum").alias("sum"), *found)

    def value(i: int) -> Column:
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        if places[i] is None:
            return low
        part = places[i] - F.floor(places[i])
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return each.select(*by, F.array(*(value(i) for i in range(len(points)))).alias(name), F.coalesce(total, F.lit(0)).alias("n"), (F.col("sum") / total).alias("mean"))


def with_quantiles(stats: DataFrame, found: DataFrame, by: list[str], name: str = "q") -> DataFrame:
    """Statistics of groups with the percentiles of those that have values; null keys are groups too."""
    if not by:
        return stats.join(F.broadcast(found.select(name)), F.lit(True), "left")  # one row each
    right = found.select(*(F.col(c).alias(f"_k_{c}") for c in by), name)
    return stats.join(right, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left").drop(*(f"_k_{c}" for c in by))
