"""Ranks, gaps and normalised scores of links i -> j."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, *order) -> Window:
    return Window.partitionBy("movie", key).orderBy(*order)


def end_ranks(links: DataFrame, key: str, other: str) -> DataFrame:
    """Adds the columns of ``distance_ranks`` of one end, by one exchange."""
    w, rank = Window.partitionBy("movie", key), f"rank_{key}{other}"
    out = links.withColumn(rank, F.row_number().over(w.orderBy("d", other)) - 1)
    second = F.coalesce(F.min(F.when(F.col(rank) == 1, F.col("d"))).over(w), F.lit(15.0))
    return out.withColumns({f"ncand_{key}": F.count(F.lit(1)).over(w), f"d2_{key}": second})


def distance_ranks(links: DataFrame) -> DataFrame:
    """Adds rank_ij, rank_ji (from 0), ncand_i, ncand_j and the second smallest distances d2_i, d2_j (15 if single)."""
    return end_ranks(end_ranks(links, "i", "j"), "j", "i").select("movie", "i", "j", "d", "rank_ij", "rank_ji", "ncand_i", "ncand_j", "d2_i", "d2_j")


def evidence_columns(links: DataFrame, p: str) -> DataFrame:
    """(movie, i, j, p, rank_src, gap_src, rank_dst, gap_dst): rank from 0 and gap to the best, by source and target."""
    best = lambda key: F.max(p).over(Window.partitionBy("movie", key)) - F.col(p)
    return links.select(
        "movie", "i", "j", p, (F.row_number().over(_by("i", F.desc(p), "j")) - 1).alias("rank_src"), best("i").alias("gap_src"),
        (F.row_number().over(_by("j", F.desc(p), "i")) - 1).alias("rank_dst"), best("j").alias("gap_dst"),
    )


def top_links(links: DataFrame, key: str = "i", other: str = "j", k: int = 3) -> DataFrame:
    """(movie, key, p1..pk, c1..ck, degree): best links of a node as columns; missing ones are 0 and -1."""
    ranked = links.withColumn("r", F.row_number().over(_by(key, F.desc("p"), other)))
    degree = links.groupBy("movie", key).agg(F.count(F.lit(1)).alias("degree"))
    best = ranked.where(F.col("r") <= k)
    cols = []
    for n in range(1, k + 1):
        cols.append(F.coalesce(F.max(F.when(F.col("r") == n, F.col("p"))), F.lit(0.0)).alias(f"p{n}"))
    for n in range(1, k + 1):
        cols.append(F.coalesce(F.max(F.when(F.col("r") == n, F.col(other))), F.lit(-1)).alias(f"c{n}"))
    return best.groupBy("movie", key).agg(*cols).join(degree, ["movie", key])


def best_links(links: DataFrame) -> DataFrame:
    """The best link of every source, equal p by the smaller j."""
    return links.groupBy("movie", "i").agg(F.max(F.struct("p", (-F.col("j")).alias("_n"), "j")).alias("b")).select("movie", "i", F.col("b.j").alias("j"), F.col("b.p").alias("p"))


def mutual_best(links: DataFrame) -> DataFrame:
    """(movie, i, j) of links that are the nearest of both their ends."""
    r = distance_ranks(links)
    return r.where("rank_ij = 0 and rank_ji = 0").select("movie", "i", "j", "d")


def two_way_probabilities(links: DataFrame, logit: str, weight: float = 0.15, keep: tuple[str, ...] = ()) -> DataFrame:
    """(movie, i, j, fwd, rev, harm): softmax over the sources of a target and over the targets of a source, and their
    weighted harmonic mean, normalised by target.  ``links`` holds all pairs of the frame pair that shall count."""
    out = links
    for key in ("i", "j"):
        out = out.withColumn(f"_max_{key}", F.max(logit).over(Window.partitionBy("movie", key)))
    out = out.withColumn("_ei", F.exp(F.col(logit) - F.col("_max_i"))).withColumn("_ej", F.exp(F.col(logit) - F.col("_max_j")))
    out = out.withColumn("fwd", F.col("_ej") / F.sum("_ej").over(Window.partitionBy("movie", "j"))).withColumn("rev", F.col("_ei") / F.sum("_ei").over(Window.partitionBy("movie", "i")))
    low = F.lit(1e-8)
    out = out.withColumn("_h", 1 / ((1 - F.lit(weight)) / F.greatest("fwd", low) + F.lit(weight) / F.greatest("rev", low)))
    return out.select("movie", "i", "j", *keep, "fwd", "rev", (F.col("_h") / F.sum("_h").over(Window.partitionBy("movie", "j"))).alias("harm"))


def percent_ranks(values: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """Adds pct: place / (n - 1) in the group, ties by ``tie``; 0 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return values.withColumn("pct", (F.row_number().over(Window.partitionBy(*group).orderBy(value, tie)) - 1) / F.greatest(n - 1, F.lit(1)))


def rescued(links: DataFrame, prior: DataFrame, least_prior: float = 0.2, threshold: float = 0.3, relax: float = 0.5) -> DataFrame:
    """(movie, i, j, p, used): links that pass the threshold of their source.

    ``links`` has p and alt (null counts as 0).  Links that are not the best of a source with
    prior s >= ``least_prior`` count with max(p, alt); a link stays when that exceeds max(threshold - relax s, 0).
    The p given out is the original one.
    """
    rank = F.row_number().over(_by("i", F.desc("p"), "j"))
    rows = links.join(prior.withColumnRenamed("node_id", "i"), ["movie", "i"], "left").withColumn("s", F.coalesce("score", F.lit(0.0))).withColumn("r", rank)
    used = F.when((F.col("r") > 1) & (F.col("s") >= least_prior), F.greatest("p", F.coalesce("alt", F.lit(0.0)))).otherwise(F.col("p"))
    return rows.withColumn("used", used).where(F.col("used") > F.greatest(F.lit(threshold) - F.lit(relax) * F.col("s"), F.lit(0.0))).select("movie", "i", "j", "p", "used")


def strongest(rows: DataFrame, most: int) -> DataFrame:
    """The rows (movie, source, t, i, j, p, ...) with the ``most`` highest p of each movie, source and frame, ties by (i, j); those without a frame all stay."""
    rank = F.row_number().over(Window.partitionBy("movie", "source", "t").orderBy(F.desc("p"), "i", "j"))
    return rows.withColumn("_r", rank).where((F.col("_r") <= most) | F.col("t").isNull()).drop("_r")
