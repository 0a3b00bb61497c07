"""Keyword-stuffed and link-list pages by the shapes of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.shapes import COUNTS, NO_WORD, lines, shape_kinds
from trackweave.plans.stages import Stages


def stuffed(pages: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = 0.5, least: int = 12) -> DataFrame:
    """(id) of pages of whose words at least ``share`` lie in lines of few shapes that are none of sentences: keywords, links, tags, products.

    1. Every line becomes a shape, and the lines of a page are summed by shape, which is written once (``shapes.lines``).
    2. Over the whole corpus each shape gets its statistics, and by these its kind (``shapes.shape_kinds``).
    3. The words of a page are summed by kind.  Its lines of a few words, which cannot repeat words one by one, count as
       keywords together if they have at least ``least`` words, at most half of them different and no bits of broken encoding.

    Only counts by page and shape, and the words of short lines, are exchanged.  Null, empty and wordless texts and pages without an id are no
    cases; rows of one id are one page; an empty table gives none.
    """
    stages = Stages(pages.sparkSession, "spam")
    rows, _ = stages.write(lines(pages, id_col, text), "lines")
    by_shape = rows.groupBy("id", "shape").agg(*(F.sum(c).alias(c) for c in COUNTS), F.sum(F.when(F.col("few").isNotNull(), F.col("said")).otherwise(0)).alias("in_few"))
    by_shape, _ = stages.write(by_shape, "shapes")
    kinds, _ = stages.write(shape_kinds(by_shape).select("shape", "kind"), "kinds")
    counted = by_shape.join(kinds, "shape")
    other = F.col("kind") != "sentence"
    page = counted.groupBy("id").agg(F.sum("words").alias("all"), F.sum(F.when(other, F.col("words")).otherwise(0)).alias("bad"), F.sum(F.when(other, 0).otherwise(F.col("in_few"))).alias("open"))
    # pages that short lines can still decide
    page, _ = stages.write(page.where((F.col("bad") > 0) | (F.col("open") >= least)), "pages")
    asked = page.where((F.col("open") >= least) & (F.col("bad") < share * F.col("all")) & (F.col("bad") + F.col("open") >= share * F.col("all"))).select("id")
    said = rows.where("few is not null").join(kinds.where("kind = 'sentence'"), "shape", "left_semi").join(asked, "id", "left_semi")
    each = said.select("id", F.explode(F.split("few", NO_WORD)).alias("word")).where("word <> ''").groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    few = each.groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.length("word") * F.col("n")).alias("letters"))
    few = few.where((F.col("d") <= 0.5 * F.col("n")) & (F.col("letters") >= 3 * F.col("n"))).select("id", "n")
    bad = F.col("bad") + F.coalesce("n", F.lit(0))
    found = page.join(few, "id", "left").where((bad > 0) & (bad >= share * F.col("all"))).select(F.col("id").alias(id_col))
    return stages.result(found)
