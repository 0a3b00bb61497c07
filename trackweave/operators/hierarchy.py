"""Parent-child rows to full hierarchies by heavy-path decomposition."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.skew import spread_join
from trackweave.plans.stages import Stages


def best_parents(edges: DataFrame, by: list[str], parent: str, child: str, score: str) -> DataFrame:
    """One parent for each child: the highest score, null lowest, equal scores by the smaller parent."""
    best = F.max(F.struct(F.col(score), -F.col(parent), F.col(parent).alias("_parent")))
    return edges.groupBy(*by, F.col(child).alias("node")).agg(best.alias("_b")).select(*by, "node", F.col("_b._parent").alias("parent"))


def climb(stages: Stages, links: DataFrame, by: list[str], sums: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Doubled pointers over ``(by, node, up, hops)``, one row for every node that has an ``up``.

    Gives (by, node, top, hops): the node without an ``up`` at the end of each chain and the sum of the hops to it; (by, node) of those
    that hang on a cycle; and with ``sums`` (by, node, below), how many nodes lie under each that has any.

    A round moves the pointers that have not reached a top, and looks up each node's pointer once by the node; a hot top is
    never a key of finished rows.  A pointer in round k spans 2**k links; when no pointer ends in a round, all that are left are on cycles.
    """
    spark, kind = links.sparkSession, links.schema["node"].dataType
    first = links.select(*by, "node", "up", F.col("hops").cast("long").alias("hops"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("fin"))
    rows, path, left = stages.counted(first, "still", ~F.col("fin"))
    ended, added = [path], []
    while left:
        still = rows.where("not fin")
        # every node's pointer: those of this round and those that ended before
        every = spark.read.schema(rows.schema).parquet(*ended).where("fin").unionByName(still) if len(ended) > 1 else still
        step = every.select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("fin").alias("_fin"))
        moved = spread_join(still, step, [*by, "up"], "node", "left", total=left)
        if sums:
            caps, caps_path = stages.write(still.groupBy(*by, F.col("up").alias("node")).agg(F.sum("size").alias("below")), "caps")
            added.append(caps_path)
            moved = moved.join(caps, [*by, "node"], "left").withColumn("size", F.col("size") + F.coalesce("below", F.lit(0)))
        fin = F.col("_up").isNull() | F.col("_fin")
        moved = moved.select(*by, "node", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), "size", fin.alias("fin"))
        before, (rows, path, left) = left, stages.counted(moved, "moved", ~F.col("fin"))
        ended.append(path)
        if left == before:
            break
    done = spark.read.schema(rows.schema).parquet(*ended).where("fin").select(*by, "node", F.col("up").cast(kind).alias("top"), "hops")
    if not sums:
        return done, rows.where("not fin").select(*by, "node"), None
    below = spark.read.schema(caps.schema).parquet(*added).groupBy(*by, "node").agg(F.sum("below").alias("below")) if added else links.select(*by, "node", F.lit(0).cast("long").alias("below"))
    return done, rows.where("not fin").select(*by, "node"), below


def hierarchy(parents: DataFrame, by: list[str], paths: bool = False) -> DataFrame:
    """Root, depth and, with ``paths``, path, subtree size and preorder interval of every node.

    ``parents`` has ``(by, node, parent)``, one row a node; a parent without a row is a
    root.  Rows with a null are left out; of a node with several parents the smallest counts.

    1. Doubled pointers with subtree sums (``climb``) tell what hangs on a cycle, whose root and depth are -1 and whose path, size and
       interval are null, and how large every other node's subtree is.
    2. The child with the largest subtree (then the smallest id) continues its
       parent's chain; doubled pointers along chains give every node its chain's
       head and its place in the chain.
    3. Chains form a tree at most log2(n) deep; doubling over it gives root and
       depth, and a walk down it, one level a round, the paths.
    4. Preorder: a node's heavy subtree follows it, the light ones after that in order
       of (bucket, id); the descendants of a node are those of its root with ``pre``
       in (pre, pre + size).
    """
    spark = parents.sparkSession
    stages = Stages(spark, "hierarchy")
    kind = parents.schema["node"].dataType
    given = parents.select(*by, "node", F.col("parent").cast(kind).alias("parent"))
    for c in (*by, "node", "parent"):
        given = given.where(F.col(c).isNotNull())
    given = given.groupBy(*by, "node").agg(F.min("parent").alias("parent"))
    roots = given.select(*by, F.col("parent").alias("node")).distinct().join(given, [*by, "node"], "left_anti")
    given, _ = stages.write(given, "given")
    reach, looped, below = climb(stages, given.select(*by, "node", F.col("parent").alias("up"), F.lit(1).alias("hops")), by, sums=True)
    cyclic, _ = stages.write(looped, "cyclic")
    all_ = given.select(*by, "node", "parent").unionByName(roots.select(*by, "node", F.lit(None).cast(kind).alias("parent")))
    sized = all_.join(cyclic, [*by, "node"], "left_anti").join(below, [*by, "node"], "left").select(*by, "node", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
    trees, _ = stages.write(sized, "sized")

    # chains: the heavy child of each parent continues its parent's
    heavy = trees.where("parent is not null").groupBy(*by, "parent").agg(F.max(F.struct("size", (-F.col("node")).alias("_n"), "node")).alias("_h")).select(*by, F.col("_h.node").alias("node"), F.lit(True).alias("heavy"))
    marked = trees.join(heavy, [*by, "node"], "left").select(*by, "node", "parent", "size", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    marked, marked_path = stages.write(marked, "marked")
    along, _, _ = climb(stages, marked.where("heavy").select(*by, "node", F.col("parent").alias("up"), F.lit(1).alias("hops")), by)
    heads = marked.where("not heavy").select(*by, "node", F.col("node").alias("head"), F.lit(0).cast("long").alias("place"))
    chains, _ = stages.write(along.select(*by, "node", F.col("top").alias("head"), F.col("hops").alias("place")).unionByName(heads), "chains")

    # the tree of chains: from each head to the chain of its parent
    over = chains.select(*by, F.col("node").alias("parent"), F.col("head").alias("over"), "place")
    hung = spread_join(marked.where("not heavy").select(*by, F.col("node").alias("head"), "parent"), over, [*by, "parent"], "head", "left", counted=marked.where("not heavy and parent is not null"))
    hung, _ = stages.write(hung, "hung")
    up, _, _ = climb(stages, hung.where("over is not null").select(*by, F.col("head").alias("node"), F.col("over").alias("up"), (F.col("place") + 1).alias("hops")), by)
    tree = up.select(*by, F.col("node").alias("head"), F.col("top").alias("root"), F.col("hops").alias("above"))
    tree = tree.unionByName(hung.where("over is null").select(*by, "head", F.col("head").alias("root"), F.lit(0).cast("long").alias("above")))
    tree, _ = stages.write(tree, "tree")
    placed = spread_join(chains, tree, [*by, "head"], "node").select(*by, "node", F.col("root").alias("root_id"), (F.col("above") + F.col("place")).alias("depth"), "head", "place")
    none = F.lit(-1)
    if not paths:
        return stages.result(placed.select(*by, "node", "root_id", "depth").unionByName(cyclic.select(*by, "node", none.cast(kind).alias("root_id"), none.cast("long").alias("depth"))))

    placed, _ = stages.write(placed, "placed")
    full = _paths(stages, placed, hung, by)
    pre = _preorder(stages, marked, placed, hung, by)
    out = placed.join(full, [*by, "head"]).join(pre, [*by, "node"])
    own = F.expr("concat(prefix, transform(slice(members, 1, cast(place as int) + 1), x -> x.node))")
    out = out.select(*by, "node", "root_id", "depth", own.alias("path"), "size", "pre")
    nulls = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("path", "size", "pre")]
    return stages.result(out.unionByName(cyclic.select(*by, "node", none.cast(kind).alias("root_id"), none.cast("long").alias("depth"), *nulls)))


def _paths(stages: Stages, placed: DataFrame, hung: DataFrame, by: list[str]) -> DataFrame:
    """(by, head, prefix, members): the path above each chain, and the chain in order.

    A chain is one path, so its members are as many as the tree is deep.
    """
    members = placed.groupBy(*by, "head").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("members"))
    chains, _ = stages.write(hung.select(*by, "head", "over", F.col("place").alias("hang")).join(members, [*by, "head"]), "members")
    kind = placed.schema["node"].dataType
    done, _ = stages.write(chains.where("over is null").select(*by, "head", "members", F.array().cast(f"array<{kind.simpleString()}>").alias("prefix")), "level")
    last, every = done, done
    while True:
        above = last.select(*by, F.col("head").alias("over"), F.col("members").alias("_m"), F.col("prefix").alias("_p"))
        below = chains.join(above, [*by, "over"]).select(*by, "head", "members", F.expr("concat(_p, transform(slice(_m, 1, cast(hang as int) + 1), x -> x.node))").alias("prefix"))
        last, _ = stages.write(below, "level")
        if not last.take(1):
            return every
        every = every.unionByName(last)


def _preorder(stages: Stages, marked: DataFrame, placed: DataFrame, hung: DataFrame, by: list[str], bucket: int = 10_000) -> DataFrame:
    """(by, node, size, pre): numbers in preorder within the root's tree.

    Light siblings are summed in hash buckets of about ``bucket`` first, so that a parent of millions of children is no single group.
    """
    light = marked.where("not heavy and parent is not null").select(*by, "node", "parent", "size")
    wide = light.groupBy(*by, "parent").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("parts")).where("parts > 1")
    light = spread_join(light, wide, [*by, "parent"], "node", "left", counted=light).withColumn("bucket", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).drop("parts")
    light, _ = stages.write(light, "light")
    sums = light.groupBy(*by, "parent", "bucket").agg(F.sum("size").alias("total"))
    w = Window.partitionBy(*by, "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "parent", "bucket", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("skip"))
    inner = Window.partitionBy(*by, "parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    offset = light.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, [*by, "parent", "bucket"]).select(*by, "node", (F.col("skip") + F.col("_in")).alias("offset"))
    heavy_size = marked.where("heavy").select(*by, "parent", F.col("size").alias("heavy_size"))
    # pre(head) = pre(parent) + 1 + heavy subtree of the parent + offset; along a chain each step adds one
    step = hung.where("over is not null").select(*by, "head", "over", "parent", "place").join(offset.withColumnRenamed("node", "head"), [*by, "head"]).join(heavy_size, [*by, "parent"], "left")
    step = step.select(*by, F.col("head").alias("node"), F.col("over").alias("up"), (F.col("place") + 1 + F.coalesce("heavy_size", F.lit(0)) + F.col("offset")).alias("hops"))
    links, _, _ = climb(stages, step, by)
    starts = links.select(*by, F.col("node").alias("head"), "hops").unionByName(hung.where("over is null").select(*by, "head", F.lit(0).cast("long").alias("hops")))
    starts, _ = stages.write(starts, "starts")
    at = spread_join(placed, starts, [*by, "head"], "node").select(*by, "node", (F.col("hops") + F.col("place")).alias("pre"))
    return at.join(marked.select(*by, "node", "size"), [*by, "node"])


def _block(level: int, x: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), x.alias("block"))


def descendants(tree: DataFrame, by: list[str], nodes: DataFrame, radix: int = 4) -> DataFrame:
    """(by, node, descendant) of the given nodes: those whose ``pre`` lies in the node's interval within its root's tree.

    ``tree`` is the result of ``hierarchy`` with paths.  An interval falls into aligned blocks whose lengths are powers of 2**radix, at most
    2 (2**radix - 1) of each length, and a node lies in one block of each length, so the join is one of equal blocks and no
    task meets the pairs of a whole tree.  Nodes that the tree doesn't have, and those on or below cycles, have none.
    """
    reach = tree.agg(F.max("size")).first()[0] or 1
    levels = [0]
    while 2 ** levels[-1] < reach:
        levels.append(levels[-1] + radix)
    asked = tree.join(nodes.select(*by, "node").distinct(), [*by, "node"], "left_semi").where("size > 1")
    asked = asked.select(*by, "root_id", "node", (F.col("pre") + 1).alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))
    run = lambda a, b: F.expr(f"if({a} < {b}, sequence({a}, {b} - 1), cast(array() as array<bigint>))")
    blocks, places = [], []
    for level in levels:
        small, big, times = f"{2**level}", f"{2 ** (level + radix)}", f"{2**radix}"
        lo, hi = f"(lo + {small} - 1) div {small}", f"hi div {small}"
        whole_lo, whole_hi = f"((lo + {big} - 1) div {big}) * {times}", f"(hi div {big}) * {times}"
        inner = F.when(F.expr(f"{whole_lo} < {whole_hi}"), F.concat(run(lo, whole_lo), run(whole_hi, hi))).otherwise(run(lo, hi))
        blocks.append(F.transform(inner, partial(_block, level)))
        places.append(F.struct(F.lit(level).alias("level"), F.expr(f"pre div {small}").alias("block")))
    asked = asked.select(*by, "root_id", "node", F.explode(F.concat(*blocks)).alias("b")).select(*by, "root_id", "node", "b.*")
    below = tree.where("pre is not null").select(*by, "root_id", F.col("node").alias("descendant"), F.explode(F.array(*places)).alias("b")).select(*by, "root_id", "descendant", "b.*")
    return below.join(asked, [*by, "root_id", "level", "block"]).select(*by, "node", "descendant")
