"""Readers and writers of the files that tracking tools exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBMISSION = "id long, dataset string, row_type string, node_id long, t int, z int, y int, x int, source_id long, target_id long"
HAND_LABELS = (
    "volume string, frame int, mother_z double, mother_y double, mother_x double, d1_z double, d1_y double, d1_x double, "
    "d2_z double, d2_y double, d2_x double, sister_um double, verdict int"
)
SPLITS = "name string, train array<string>, test array<string>, note string"
WINDOWS = "id string, name string, t0 int, stride int, n_frames int, origin_um array<double>, size_um double, n_nodes long, n_div long, mode string, score double"


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node rows and edge rows of result files; -1 is read as null."""
    rows = spark.read.csv(path, header=True, schema=SUBMISSION, enforceSchema=False)
    known = lambda c: F.when(F.col(c) != -1, F.col(c)).alias(c)
    nodes = rows.where("row_type = 'node'").select(F.col("dataset").alias("movie"), "node_id", *map(known, ("t", "z", "y", "x")))
    edges = rows.where("row_type = 'edge'").select(F.col("dataset").alias("movie"), "source_id", "target_id")
    return nodes, edges


def write_submission(rows: DataFrame, path: str) -> None:
    """Result rows as CSV with a header, replaced as a whole by the commit protocol."""
    rows.select("id", "dataset", "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id").write.csv(path, header=True, mode="overwrite")


def write_by_movie(rows: DataFrame, path: str) -> None:
    """A table partitioned by movie; only the partitions that the rows name are replaced."""
    rows.write.partitionBy("movie").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_hand_labels(spark: SparkSession, path: str, scale: tuple[float, float, float] = (1.625, 0.40625, 0.40625), tolerance: float = 0.3) -> DataFrame:
    """Judged divisions, one row each.

    Rows without a verdict are skipped; a division is its volume, frame, mother and unordered pair of daughters,
    and counts once.  Different verdicts on one division, or a distance of the daughters that differs by more
    than ``tolerance`` um from the noted one, stop the job.
    """
    rows = spark.read.csv(path, header=True, schema=HAND_LABELS).where("verdict is not null")
    daughter = lambda k: F.struct(*(F.col(f"d{k}_{c}").alias(c) for c in "zyx"))
    rows = rows.withColumn("pair", F.array_sort(F.array(daughter(1), daughter(2))))
    gaps = [(F.col(f"d1_{c}") - F.col(f"d2_{c}")) * s for c, s in zip("zyx", scale)]
    length = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    rows = rows.withColumn("off", F.abs(length - F.col("sister_um")))
    one = rows.groupBy("volume", "frame", "mother_z", "mother_y", "mother_x", "pair").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other"), F.max("off").alias("off"), F.min("sister_um").alias("sister_um"))
    checked = F.when(F.col("verdict") != F.col("other"), F.raise_error(F.concat(F.lit("conflicting verdicts in "), "volume"))).when(F.col("off") > tolerance, F.raise_error(F.concat(F.lit("distance is not in um in "), "volume"))).otherwise(F.col("verdict"))
    return one.select("volume", "frame", "mother_z", "mother_y", "mother_x", "pair", "sister_um", checked.alias("verdict"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(name, side, id) of plans kept as a JSON list."""
    plans = spark.read.json(path, schema=SPLITS, multiLine=True)
    sides = [plans.select("name", F.lit(s).alias("side"), F.explode(s).alias("id")) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, movie) of a JSON object of lists; other entries are ignored."""
    text = spark.read.text(path, wholetext=True)
    folds = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("fold", "movies"))
    return folds.where(F.col("movies").startswith("[")).select("fold", F.explode(F.from_json("movies", "array<string>")).alias("movie"))


def mismatched(spark: SparkSession, files: str, manifest: str) -> DataFrame:
    """(path, wanted, found) of files that do not have the SHA-256 of a manifest of ``sum  path`` lines, or are absent."""
    wanted = spark.read.text(manifest).where("trim(value) <> ''").select(F.split("value", r"\s+", 2)[0].alias("wanted"), F.regexp_extract("value", r"([^/\s]+)\s*$", 1).alias("path"))
    have = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("found"))
    return wanted.join(have, "path", "left").where(~F.col("wanted").eqNullSafe(F.col("found"))).select("path", "wanted", "found")


def parse_bands(spec: str) -> list[tuple[float, float, str, float, float, float]]:
    """Density bands written as ``lo:hi:mode:theta:r:r2;...`` with mode v, or, and."""
    out = []
    for part in filter(None, spec.split(";")):
        lo, hi, mode, theta, r, r2 = part.split(":")
        if mode not in ("v", "or", "and"):
            raise ValueError(f"unknown mode {mode!r}")
        out.append((float(lo), float(hi), mode, float(theta), float(r), float(r2)))
    return out
