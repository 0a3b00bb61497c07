"""Row numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.plans.stages import Stages


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 0.

    The rows are range-partitioned and written in order; each part is numbered on its own and
    starts where the parts before end, so no task holds more than one part.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    table, _ = Stages(df.sparkSession, "numbered").write(parts, "parts")
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    starts = sizes.select("_part", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return table.withColumn("_r", rank).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_part", "_r", "_before")


def prefix_sums(df: DataFrame, within: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds to each row the sum of ``value`` over the rows of its group up to and with it, in the given order.

    As in ``numbered`` rows are range-partitioned, here by group and order, and each part starts with what parts before hold of
    its first group, so a group of any size is spread over as many tasks as it needs.
    """
    stages = Stages(df.sparkSession, "sums")
    by = [F.col(c) for c in within]
    table, _ = stages.write(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "parts")
    sizes = table.groupBy(*within, "_part").agg(F.sum(value).alias("_n"))
    # a row for each group and part
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*within, "_part", before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("_own", own).join(starts, [*within, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def numbered_within(df: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in its group, from 0; groups may be of any size."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), within, order, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")
