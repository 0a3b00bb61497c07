"""Points near other points: k-d splits with halo copies, local k-d trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.plans.stages import Stages

LEAF = 16


def unit_vectors(lat: str, lon: str) -> list:
    """Degrees to vectors on the unit sphere, where ``chord`` distances order as great-circle distances."""
    la, lo = F.radians(lat), F.radians(lon)
    return [(F.cos(la) * F.cos(lo)), (F.cos(la) * F.sin(lo)), F.sin(la)]


def chord(distance: float, sphere_radius: float) -> float:
    """Length of the chord under a great-circle distance, on the unit sphere."""
    return 2 * math.sin(min(distance / sphere_radius, math.pi) / 2)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A balanced k-d tree, level by level: an order of the points and, for each level, the boxes of its equal runs.

    Level d has 2**d nodes; node k holds a run of the order.  Points are padded with NaN to a power of two runs.
    """
    n = len(points)
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    width = math.ceil(n / 2**depth)
    order = np.full(width * 2**depth, -1)
    order[:n] = np.arange(n)
    padded = np.vstack([points, np.full((len(order) - n, points.shape[1]), np.inf)])
    boxes = []
    for d in range(depth + 1):
        runs = order.reshape(2**d, -1)
        at = padded[np.where(runs < 0, n if len(padded) > n else 0, runs)]
        real = np.where((runs < 0)[..., None], np.nan, at)
        with np.errstate(all="ignore"):
            empty = (runs < 0).all(axis=1)
            real[empty] = np.inf
            low, high = np.nanmin(real, axis=1), np.nanmax(real, axis=1)
        boxes.append((low, high))
        if d < depth:
            with np.errstate(invalid="ignore"):
                span = np.where(empty[:, None], 0, high - low)
            axis = np.nan_to_num(span).argmax(axis=1)
            value = np.take_along_axis(at, axis[:, None, None].repeat(runs.shape[1], 1), 2)[..., 0]
            value = np.where(runs < 0, np.inf, value)
            order = np.take_along_axis(runs, np.argsort(value, axis=1, kind="stable"), 1).reshape(-1)
    return order, boxes


def tree_pairs(points: np.ndarray, queries: np.ndarray, radius: float, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, squared distance) within the radius, both ends included.

    All queries go down the tree together; a node is left when its box is farther than the radius.
    """
    if not len(points) or not len(queries):
        return
    order, boxes = build_tree(points)
    r2 = radius * radius
    q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
    for d, (low, high) in enumerate(boxes):
        if d:
            q, node = np.repeat(q, 2), np.repeat(node * 2, 2) + np.tile([0, 1], len(node))
        gap = np.maximum(np.maximum(low[node] - queries[q], queries[q] - high[node]), 0)
        keep = (gap * gap).sum(axis=1) <= r2 * (1 + 1e-9)
        q, node = q[keep], node[keep]
    runs = order.reshape(len(boxes[-1][0]), -1)
    step = max(1, block // runs.shape[1])
    for k in range(0, len(q), step):
        p = runs[node[k : k + step]]
        qq = np.repeat(q[k : k + step], runs.shape[1])
        p = p.reshape(-1)
        qq, p = qq[p >= 0], p[p >= 0]
        diff = queries[qq] - points[p]
        d2 = diff[:, 0] * diff[:, 0]
        for c in range(1, points.shape[1]):
            d2 = d2 + diff[:, c] * diff[:, c]
        keep = d2 <= r2
        yield qq[keep], p[keep], d2[keep]


def kd_cells(stages: Stages, points: DataFrame, keys: list[str], axes: list[str], radius: float, cap: int) -> DataFrame:
    """Every point once in its home cell and once, as a halo copy, in every other cell within the radius.

    Groups of the keys with more than ``cap`` points are split along one axis after
    another into as many slabs as are needed, at quantiles of the points in
    the group's present cells.  Adds ``cell`` (string) and ``home`` (boolean).
    """
    out = points.withColumn("cell", F.lit("")).withColumn("home", F.lit(True))
    left = len(axes)
    for axis in axes:
        home = out.where("home")
        big = home.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
        slabs = F.least(F.lit(64.0), F.ceil(F.pow(F.col("n") / F.lit(float(cap)), F.lit(1.0 / left)))).cast("int")
        big, _ = stages.write(big.withColumn("m", slabs).where("m > 1"), "big")
        left -= 1
        if not big.take(1):
            continue
        quantiles = F.percentile_approx(axis, [k / 64 for k in range(1, 64)], 1000)
        # m - 1 cuts out of the 63 quantiles, each value once
        cuts = home.join(big, [*keys, "cell"]).groupBy(*keys, "cell", "m").agg(quantiles.alias("q")).select(*keys, "cell", F.array_distinct(F.expr("transform(sequence(1, m - 1), k -> q[cast(round(k * 64.0 / m) as int) - 1])")).alias("cuts"))
        cuts, _ = stages.write(cuts, "cuts")
        own = out.join(cuts, [*keys, "cell"], "left")
        slab = lambda v: F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= v)))  # noqa: B023,E731
        own = own.withColumn("_s", slab(F.col(axis)))
        own = own.withColumn("_k", F.explode(F.sequence(slab(F.col(axis) - F.lit(radius)), slab(F.col(axis) + F.lit(radius)))))
        out = own.withColumn("home", F.col("home") & (F.col("_k") == F.col("_s"))).withColumn("cell", F.when(F.col("cuts").isNull(), F.col("cell")).otherwise(F.concat("cell", F.lit("/"), "_k"))).drop("_k", "_s", "cuts")
    return out


def near_points(points: DataFrame, keys: list[str], id_col: str, axes: list[str], radius: float, cap: int = 4096, batch: int = 30_000) -> DataFrame:
    """All unordered pairs of points of the same keys at most ``radius`` apart, as (keys, node_a, node_b, distance).

    For places on a sphere take ``unit_vectors`` as axes and ``chord`` as radius.

    Keys with many points are split by ``kd_cells``; the cells are dealt by
    hash to groups of about ``batch`` points, and in each group one local k-d
    tree answers all points at once, the cells kept apart by one more axis.  A
    pair is found in the home cell of its smaller id, where the other lies as
    a point or a halo copy.  Points with a null or NaN in a key, id or axis take
    no part; an id given twice counts once (its smallest place); an empty
    table gives no pairs.
    """
    spark = points.sparkSession
    id_type = points.schema[id_col].dataType
    whole = points.select(*keys, F.col(id_col).alias("_id"), *(F.col(a).cast("double").alias(f"_a{k}") for k, a in enumerate(axes)))
    names = [f"_a{k}" for k in range(len(axes))]
    for c in (*keys, "_id", *names):
        whole = whole.where(F.col(c).isNotNull())
    for c in names:
        whole = whole.where(~F.isnan(c))
    whole = whole.groupBy(*keys, "_id").agg(F.min(F.struct(*names)).alias("_p")).select(*keys, "_id", *(F.col(f"_p.{c}").alias(c) for c in names))
    stages = Stages(spark, "near")
    whole, _ = stages.write(whole, "points")
    cells = kd_cells(stages, whole, keys, names, radius, cap)
    groups = max(1, math.ceil(whole.count() / batch))
    dealt = cells.withColumn("_c", F.xxhash64(*keys, "cell")).withColumn("_g", F.pmod("_c", F.lit(groups)).cast("int"))
    key_types = [T.StructField(k, points.schema[k].dataType) for k in keys]
    schema = T.StructType([*key_types, T.StructField("node_a", id_type), T.StructField("node_b", id_type), T.StructField("distance", T.DoubleType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf.groupby([*keys, "cell"], sort=False).ngroup().to_numpy()
        at = np.column_stack([pdf[names].to_numpy(dtype=float), cell * (4.0 * radius + 1.0)])
        home, ids = pdf["home"].to_numpy(dtype=bool), pdf["_id"].to_numpy()
        asked = np.flatnonzero(home)
        parts = []
        for q, p, d2 in tree_pairs(at, at[asked], radius):
            a = asked[q]
            keep = (ids[a] < ids[p]) & (cell[a] == cell[p])
            a, p = a[keep], p[keep]
            one = pdf[keys].iloc[a].reset_index(drop=True)
            one["node_a"], one["node_b"], one["distance"] = ids[a], ids[p], np.sqrt(d2[keep])
            parts.append(one)
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema.fields}).astype({"distance": float})

    return dealt.groupBy("_g").applyInPandas(local, schema)
