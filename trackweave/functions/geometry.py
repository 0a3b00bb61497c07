"""Column expressions on points given as three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def distance(a: str, b: str) -> Column:
    """Euclidean distance of ``z{a}, y{a}, x{a}`` and ``z{b}, y{b}, x{b}``."""
    parts = [(F.col(f"{c}{b}") - F.col(f"{c}{a}")) for c in AXES]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def cosine(u: list[Column], v: list[Column]) -> Column:
    """Cosine of two vectors given by their components; 0 where a length is (nearly) 0."""
    dot, uu, vv = (p[0] * q[0] + p[1] * q[1] + p[2] * q[2] for p, q in ((u, v), (u, u), (v, v)))
    norm = F.sqrt(uu) * F.sqrt(vv)
    return F.when(norm <= 1e-6, F.lit(0.0)).otherwise(dot / F.greatest(norm, F.lit(1e-6)))


def safe_div(a: Column, b: Column) -> Column:
    """a / max(b, 1e-6)."""
    return a / F.greatest(b, F.lit(1e-6))


def points(nodes, suffix: str, frame_shift: int = 0, keep: tuple[str, ...] = ()):
    """``movie, t, {suffix}`` and its place as ``z_{suffix} ...``; ``frame_shift`` moves t to the frame joined with."""
    t = (F.col("t") + frame_shift).cast("int").alias("t")
    place = [F.col(f"{c}_um").alias(f"{c}_{suffix}") for c in AXES]
    return nodes.select("movie", t, F.col("node_id").alias(suffix), *place, *(F.col(k).alias(f"{k}_{suffix}") for k in keep))
