"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this many rows, and more than a thousandth of all, is spread over several tasks.
HOT_ROWS = 1_000_000
#: Rows by whose keys hot ones are recognised; a hot key has a thousandth of them.
SEEN_ROWS = 200_000


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> DataFrame | None:
    """(keys, parts) of the hot keys of a written table, None if there are none.

    Which keys are found changes the plan only, never a result, so a sample tells.  A hot key has at least half
    a thousandth of the sample, so they are two thousand at most, which is few enough for a broadcast.
    """
    total = rows.count() if total is None else total
    least = max(HOT_ROWS, total // 1000)
    if total <= least:
        return None
    share = min(1.0, max(SEEN_ROWS, 1) / total)
    seen = rows if share == 1.0 else rows.sample(share, seed=1)
    found = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0.5 * share * least).select(*keys, F.ceil(F.col("n") / (share * least)).cast("int").alias("parts"))
    few = found.collect()
    return rows.sparkSession.createDataFrame(few, found.schema) if few else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner", counted: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has a row a key; a hot key's rows are dealt by the hash of column ``by`` to several tasks.

    ``counted`` is a written table with the keys of ``many``, if that isn't one itself, and ``total`` their number, if known.
    """
    hot = hot_keys(many if counted is None else counted, keys, total)
    if hot is None:
        return many.join(one, keys, how)
    few, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    a = many.join(few, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    b = one.join(few, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
