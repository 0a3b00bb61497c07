"""Points in regions: a plane sweep over polygon edges, slab by slab."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.plans.stages import Stages


def region_edges(regions: DataFrame, keys: list[str], region: str) -> DataFrame:
    """(keys, region, y0, x0, y1, x1): the edges of all rings, from the lower to the upper end; level edges cross no level line and are left out."""
    ring = regions.select(*keys, region, F.explode("rings").alias("ring")).where(F.size("ring") >= 3)
    sides = F.transform("ring", lambda p, k: F.struct(p.alias("a"), F.element_at("ring", (k + 1) % F.size("ring") + 1).alias("b")))
    e = ring.select(*keys, region, F.explode(sides).alias("e")).select(*keys, region, "e.*")
    up = F.col("a.y") <= F.col("b.y")
    low, high = (F.when(up, F.col(p)).otherwise(F.col(q)) for p, q in (("a", "b"), ("b", "a")))
    e = e.select(*keys, region, low.alias("l"), high.alias("h"))
    return e.select(*keys, region, F.col("l.y").alias("y0"), F.col("l.x").alias("x0"), F.col("h.y").alias("y1"), F.col("h.x").alias("x1")).where("y0 < y1")


def crossed(y: np.ndarray, x: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) pairs of which an odd number of the region's edges lies right of the point.

    The sweep goes up the points in order of y; an edge is open for the points from its lower end to below its upper
    end, one run of that order.  ``edges`` has y0, x0, y1, x1, and ``which`` the region of each, in runs.
    """
    if not len(y) or not len(edges):
        return np.empty(0, dtype=int), which[:0]
    order = np.argsort(y, kind="stable")
    ys, xs = y[order], x[order]
    first, last = np.searchsorted(ys, edges[:, 0], "left"), np.searchsorted(ys, edges[:, 2], "left")
    points, found = [], []
    for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero(which[1:] != which[:-1]) + 1, len(which)])):
        left, right = edges[a:b, [1, 3]].min(), edges[a:b, [1, 3]].max()
        lo, hi = first[a:b].min(), last[a:b].max()
        inside = np.zeros(max(hi - lo, 0), dtype=bool)
        for k in range(a, b):
            run = slice(first[k], last[k])
            if run.start < run.stop:
                y0, x0, y1, x1 = edges[k]
                at = x0 + (ys[run] - y0) * ((x1 - x0) / (y1 - y0))
                inside[run.start - lo : run.stop - lo] ^= xs[run] < at
        hit = np.flatnonzero(inside & (xs[lo:hi] >= left) & (xs[lo:hi] < right)) + lo if hi > lo else np.empty(0, dtype=int)
        points.append(order[hit])
        found.append(np.full(len(hit), which[a], dtype=which.dtype))
    return np.concatenate(points), np.concatenate(found)


def points_in_regions(points: DataFrame, regions: DataFrame, keys: list[str], id_col: str, region: str, cap: int = 20_000) -> DataFrame:
    """(keys, id, region) of every point (keys, id, y, x) in a region (keys, region, rings) of the same keys.

    ``rings`` are arrays of rings of structs (y, x), closed by themselves; a point is inside where an odd number of rings surrounds it, so rings
    inside others are holes.  Lower and left borders belong to a region, upper and right ones don't, so that of regions that share
    a border one has the points on it.  Points and regions with nulls in keys, id or places take no part, nor do rings of fewer than three
    corners; repeated rows count once; empty tables give none.

    Keys with more than ``cap`` points are cut along y into slabs at quantiles of their points; an edge comes, as a halo copy, to every slab
    that it crosses, points to one.  In each slab a plane sweep over the edges in the order of y tells the parity of crossings.
    """
    stages = Stages(points.sparkSession, "regions")
    at = points.select(*keys, F.col(id_col).alias("_id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    for c in (*keys, "_id", "y", "x"):
        at = at.where(F.col(c).isNotNull())
    at, _ = stages.write(at.where(~F.isnan("y") & ~F.isnan("x")).distinct(), "points")
    given = regions.select(*keys, F.col(region).alias("_region"), "rings")
    for c in (*keys, "_region"):
        given = given.where(F.col(c).isNotNull())
    given = given.where(F.col("rings").isNotNull() & ~F.exists("rings", lambda r: r.isNull() | F.exists(r, lambda p: p.isNull() | p["y"].isNull() | p["x"].isNull() | F.isnan(p["y"]) | F.isnan(p["x"]))))
    edges, _ = stages.write(region_edges(given.distinct(), keys, "_region"), "edges")
    big = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("y", [k / 256 for k in range(1, 256)], 10_000).alias("q")).where(F.col("n") > cap)
    m = f"cast(least(256, ceil(n / {cap})) as int)"
    cuts = big.select(*keys, F.array_distinct(F.expr(f"transform(sequence(1, {m} - 1), k -> q[cast(greatest(round(k * 256.0 / {m}), 1) as int) - 1])")).alias("cuts"))
    cuts, _ = stages.write(cuts, "cuts")
    slab = lambda v: F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= v)))
    here = at.join(cuts, keys, "left").withColumn("_slab", slab(F.col("y"))).drop("cuts")
    there = edges.join(cuts, keys, "left").withColumn("_slab", F.explode(F.sequence(slab(F.col("y0")), slab(F.col("y1"))))).drop("cuts")
    schema = T.StructType([*(T.StructField(k, points.schema[k].dataType) for k in keys), T.StructField(id_col, points.schema[id_col].dataType), T.StructField(region, regions.schema[region].dataType)])

    def sweep(key: tuple, mine: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or sides.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        sides = sides.sort_values("_region", kind="stable")
        point, found = crossed(mine["y"].to_numpy(), mine["x"].to_numpy(), sides[["y0", "x0", "y1", "x1"]].to_numpy(), pd.factorize(sides["_region"])[0].astype(int))
        names = sides["_region"].drop_duplicates().to_numpy()
        given = {k: pd.Series([v] * len(point), dtype=object) for k, v in zip(keys, key)}
        return pd.DataFrame(given | {id_col: pd.Series(mine["_id"].to_numpy()[point], dtype=object), region: pd.Series(names[found], dtype=object)})

    by = [*keys, "_slab"]
    return stages.result(here.groupBy(*by).cogroup(there.groupBy(*by)).applyInPandas(sweep, schema).distinct())
