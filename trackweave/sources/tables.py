"""Readers of the tracking tables, with the rules for dirty rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a full-resolution voxel in um (z, y, x).
SCALE_ZYX = (1.625, 0.40625, 0.40625)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """The latest row of every key; equal rows count once.

    A null time is the earliest.  Of rows with the same time the one with the
    greatest values counts, so that every run takes the same one.
    """
    latest = F.max(F.struct(F.col(by), *values)).alias("_r")
    return df.groupBy(*keys).agg(latest).select(*keys, *(F.col(f"_r.{v}").alias(v) for v in values))


def current_scores(df: DataFrame, keys: list[str], by: str, value: str, within: list[str] | None = None) -> DataFrame:
    """``current_rows`` for one number: hash aggregates over one exchange by the key, or by those of its columns ``within`` which later steps group."""
    earliest = F.lit("0001-01-01").cast(df.schema[by].dataType)
    parts = df.select(*keys, F.coalesce(by, earliest).alias(by), value).repartition(*(within or keys))
    return parts.groupBy(*keys, by).agg(F.max(value).alias(value)).groupBy(*keys).agg(F.max_by(value, by).alias(value))


def known_nodes(nodes: DataFrame) -> DataFrame:
    """Every (movie, node_id) of which there is a row; rows without one of them name no node."""
    return nodes.select("movie", "node_id").where("movie is not null and node_id is not null").distinct()


def located_nodes(nodes: DataFrame) -> DataFrame:
    """Current node rows that have a frame and all coordinates, these also in um.

    A null, NaN or -1 coordinate is missing, as is a null frame.
    """
    cur = current_rows(nodes.where("movie is not null and node_id is not null"), ["movie", "node_id"], "ingested_at", ["t", "z", "y", "x"])
    for c in ("z", "y", "x"):
        cur = cur.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != -1))
    um = [(F.col(c) * F.lit(s)).alias(f"{c}_um") for c, s in zip("zyx", SCALE_ZYX)]
    return cur.where("t is not null").select("movie", "node_id", "t", "z", "y", "x", *um)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct current edges whose ends are both known nodes of the movie; p is null where it is null or NaN."""
    cur = current_scores(
        edges.where("movie is not null and source_id is not null and target_id is not null").withColumn("p", F.nanvl("p", F.lit(None).cast("float"))),
        ["movie", "source_id", "target_id"], "ingested_at", "p",
    )
    known = known_nodes(nodes)
    cur = cur.join(known.withColumnRenamed("node_id", "source_id"), ["movie", "source_id"], "left_semi")
    return cur.join(known.withColumnRenamed("node_id", "target_id"), ["movie", "target_id"], "left_semi")
