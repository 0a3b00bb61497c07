"""The top rows of every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.plans.stages import Stages


def top_n(rows: DataFrame, group: list[str], score: str, tie: str, n: int, bands: tuple[float, ...] = (0.5, 0.2), scores: DataFrame | None = None) -> DataFrame:
    """(group, tie, score) of the ``n`` rows with the highest score in each group, equal scores by the smaller ``tie``.

    ``rows`` is written once, range-partitioned into score bands at the given quantiles of the scores, or of those of
    ``scores``, a table cheaper to read; where the bands lie changes the work, never the result.
    From the top band down, each band gives at most n rows a group, cut map-side before the exchange, so a group of
    any size is never gathered; groups that higher bands filled are anti-joined away, and a group still
    open takes as many as it lacks.  Equal scores share a band, so ties are ranked exactly.

    Rows with a null group column or tie, or a null or NaN score, have no rank and are left out; a row given twice (same
    group and tie) counts once with its highest score, if the caller made it unique; an empty
    table gives none.
    """
    stages = Stages(rows.sparkSession, "topn")
    kept = rows.select(*group, tie, score).where(F.col(score).isNotNull() & F.col(tie).isNotNull() & ~F.isnan(score))
    for c in group:
        kept = kept.where(F.col(c).isNotNull())
    cuts = (rows if scores is None else scores).where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.percentile_approx(score, list(bands), 1000)).first()[0] or []
    band = F.lit(0)
    for c in sorted(set(cuts), reverse=True):
        band = band + (F.col(score) < F.lit(c).cast(rows.schema[score].dataType)).cast("int")
    table, _ = stages.write(kept.withColumn("band", band), "bands", partition_by="band")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie)))
    found: DataFrame | None = None
    for b in range(len(set(cuts)) + 1):
        best = table.where(F.col("band") == b).select(*group, tie, score).withColumn("rank", rank).where(F.col("rank") <= n)
        if found is not None:
            have = found.groupBy(*group).agg(F.count(F.lit(1)).alias("have"))
            filled, open_ = have.where(F.col("have") >= n), have.where(F.col("have") < n)
            best = best.join(filled, group, "left_anti").join(open_, group, "left").where(F.col("rank") <= n - F.coalesce("have", F.lit(0)))
        best, _ = stages.write(best.select(*group, tie, score), "best")
        found = best if found is None else found.unionByName(best)
    return stages.result(found)
