"""Trends of series and deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(series: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """(keys, n, slope, rising, net, draw_down, fallen, spread, relative, decrease, above, min_step, max_step, span) of each series of (step, value).

    ``slope`` is the median of the slopes of all pairs of points and ``rising`` the share of positive ones among them, ``draw_down`` the
    largest fall from a running maximum, ``fallen`` the sum of the falls from point to point (``decrease``: of their rates), ``spread`` the median
    absolute deviation from the line of that slope, ``relative`` the change over 1 + the first value (null where that is 0), ``above`` the
    share of the later points above the first.  Nulls are not observed; a series of one point has no slopes and no later points (0).
    A series is one row of a short array, so its pairs are formed inside the row.
    """
    kept = series.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(step).isNotNull()).groupBy(*keys, F.col(step).cast("double").alias("t")).agg(F.max(value).alias("v"))
    rows = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    slopes = "flatten(transform(s, (a, i) -> transform(slice(s, i + 2, greatest(size(s) - i - 1, 0)), b -> (b.v - a.v) / (b.t - a.t))))"
    over = lambda what: f"if(size(s) > 1, transform(sequence(1, size(s) - 1), k -> {what}), array())"
    mid = lambda m: f"if(size({m}) = 0, 0D, ({m}[cast((size({m}) - 1) div 2 as int)] + {m}[cast(size({m}) div 2 as int)]) / 2)"
    rows = rows.withColumn("m", F.expr(f"array_sort({slopes})")).withColumn("r", F.expr(over("(s[k].v - s[k - 1].v) / (s[k].t - s[k - 1].t)"))).withColumn("w", F.expr(over("s[k].v - s[k - 1].v")))
    rows = rows.withColumn("slope", F.expr(mid("m"))).withColumn("f", F.expr("array_sort(transform(s, x -> x.v - slope * x.t))"))
    rows = rows.withColumn("base", F.expr(mid("f"))).withColumn("f", F.expr("array_sort(transform(f, x -> abs(x - base)))"))
    fall = "aggregate(s, struct(double('-Infinity') as top, 0D as fall), (acc, x) -> struct(greatest(acc.top, x.v) as top, greatest(acc.fall, greatest(acc.top, x.v) - x.v) as fall), acc -> acc.fall)"
    share = lambda of, what, n: f"if({n} <= 0, 0D, cast(size(filter({of}, x -> {what})) as double) / {n})"
    return rows.select(
        *keys, F.size("s").alias("n"), "slope", F.expr(share("m", "x > 0", "size(m)")).alias("rising"), F.expr("element_at(s, -1).v - s[0].v").alias("net"),
        F.expr(fall).alias("draw_down"), F.expr("aggregate(w, 0D, (acc, x) -> acc + greatest(-x, 0D))").alias("fallen"), F.expr(mid("f")).alias("spread"),
        F.expr("if(size(s) > 1, try_divide(element_at(s, -1).v - s[0].v, 1 + s[0].v), 0D)").alias("relative"),
        F.expr("aggregate(r, 0D, (acc, x) -> acc + greatest(-x, 0D))").alias("decrease"), F.expr(share("s", "x.v > s[0].v", "(size(s) - 1)")).alias("above"),
        F.expr("coalesce(array_min(r), 0D)").alias("min_step"), F.expr("coalesce(array_max(r), 0D)").alias("max_step"), F.expr("element_at(s, -1).t - s[0].t").alias("span"),
    )


def per_group(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each group, the same ones in every run: those with the smallest hashes of key, group and seed."""
    h = F.xxhash64(F.col(key), F.crc32(F.col(group).cast("binary")), F.lit(seed))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(h, key))).where(F.col("_r") <= n).drop("_r")
