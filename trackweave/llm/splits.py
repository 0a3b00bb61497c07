"""Splits that keep related records together: components by frontier breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.numbering import prefix_sums
from trackweave.functions.skew import spread_join
from trackweave.plans.stages import Stages

#: Neighbours in one row of an adjacency list; longer lists take several rows.
LIST = 1024


def _adjacency(edges: DataFrame, salt: int) -> DataFrame:
    """(node, part, next, least): adjacency lists of at most about LIST neighbours, hash-partitioned by node and part, and the
    least hash among the neighbours."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).where("node <> to").distinct()
    parts = both.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts"))
    both = both.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("to"), F.col("parts")).cast("int"))
    return both.groupBy("node", "part").agg(F.collect_list("to").alias("next"), F.min(F.xxhash64("to", F.lit(salt))).alias("least"))


def components(edges: DataFrame, steps: int = 3, stages: Stages | None = None, depth: int = 0) -> DataFrame:
    """(node, component) of all nodes of ``edges(a, b)``; the component is one of its nodes.

    Nodes whose hash is below that of all their neighbours are seeds, so every component has some.  All seeds
    expand at once for ``steps`` rounds, one step each, a node keeping the first label that reaches it (the smallest of
    those of the same round); nodes that no seed reached by then are seeds themselves.  Where labels meet,
    the pair is kept.  The pairs of colliding labels form a graph a fraction as large, whose
    components, found alike, merge the labels; it ends when no labels meet.

    Nulls and pairs of a node with itself link nothing; an empty table has no components.
    """
    stages = stages or Stages(edges.sparkSession, "components")
    lists, _ = stages.write(_adjacency(edges.where("a is not null and b is not null"), depth), "lists")
    seeds = lists.groupBy("node").agg(F.min("least").alias("least")).where(F.xxhash64("node", F.lit(depth)) < F.col("least"))
    labels = seeds.select("node", F.struct(F.lit(0).alias("step"), F.col("node").alias("label")).alias("l"))
    for k in range(steps):
        # the frontier tells its neighbours; every labelled node keeps what it has
        own = F.array(F.struct(F.col("node").alias("node"), F.col("l.step").alias("step")))
        told = F.when(F.col("l.step") == k, F.transform("next", lambda x: F.struct(x.alias("node"), F.lit(k + 1).alias("step"))))  # noqa: B023
        none = F.array().cast("array<struct<node:%s,step:int>>" % lists.schema["node"].dataType.simpleString())
        heard = spread_join(lists, labels, ["node"], "part").select("l.label", F.explode(F.concat(own, F.coalesce(told, none))).alias("x"))
        labels = heard.groupBy("x.node").agg(F.min(F.struct("x.step", "label")).alias("l"))
    labels, _ = stages.write(lists.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("l.label", "node").alias("label")), "labels")
    # every node has its label now: labels meet along the edges whose ends have different ones
    ends = spread_join(lists, labels, ["node"], "part").select("label", F.explode("next").alias("node"))
    met = ends.join(labels.withColumnRenamed("label", "own"), "node").where("label < own").select(F.col("label").alias("a"), F.col("own").alias("b")).distinct()
    meets, _ = stages.write(met, "meets")
    if not meets.take(1):
        return labels.select("node", F.col("label").alias("component"))
    merged = components(meets, steps, stages, depth + 1).withColumnsRenamed({"node": "label"})
    return labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def windows(table: DataFrame) -> DataFrame:
    """One row a window id: recording (letters and digits in lower case), cube and first and last frame.

    ``place`` is null where the origin is absent or incomplete, or a size, frame or name is missing.
    """
    one = table.where("id is not null").groupBy("id").agg(F.max(F.struct("name", "t0", "stride", "n_frames", "origin_um", "size_um")).alias("w")).select("id", "w.*")
    o = F.col("origin_um")
    complete = (F.size(o) == 3) & ~F.exists(o, lambda v: v.isNull() | F.isnan(v)) & F.col("size_um").isNotNull()
    name = F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", ""))
    first, last = F.col("t0").cast("long"), F.col("t0") + F.col("stride").cast("long") * (F.col("n_frames") - 1)
    place = F.when(complete, F.struct(o[0].alias("z"), o[1].alias("y"), o[2].alias("x"), F.col("size_um").alias("size"), first.alias("t0"), last.alias("t1")))
    out = one.select("id", name.alias("recording"), place.alias("place"))
    ok = F.col("recording").isNotNull() & F.col("place.t0").isNotNull() & F.col("place.t1").isNotNull()
    return out.withColumn("place", F.when(ok, F.col("place")))


def overlapping(places: DataFrame) -> DataFrame:
    """(a, b) of places (id, recording, place) that share volume and a frame of one recording.

    Cubes and spans fall into classes by powers of two.  A pair is sought in the grid as wide as the larger class of its two cubes and of
    its two spans, so a single outlier widens no other's cells; it is found in the cell of the lower
    corner of what the two share.  The classes present are few, as there are no more powers of two.
    """
    log = lambda v: F.ceil(F.log2(v)).cast("int")
    places = places.withColumn("cs", log(F.greatest(F.col("place.size"), F.lit(1e-9)))).withColumn("cf", log(F.expr("cast(place.t1 - place.t0 + 1 as double)")))
    present = places.agg(F.collect_set("cs"), F.collect_set("cf")).first()
    classes = [(gs, gf) for gs in sorted(present[0]) for gf in sorted(present[1])]
    found = places.select(F.lit(0).alias("gs"), F.lit(0).alias("gf"), "*").limit(0) if not classes else places.withColumn("g", F.explode(F.array(*(F.struct(F.lit(s).alias("gs"), F.lit(f).alias("gf")) for s, f in classes)))).where("g.gs >= cs and g.gf >= cf").select("g.*", "*").drop("g")
    cells = found.withColumn("size", F.pow(F.lit(2.0), F.col("gs"))).withColumn("span", F.pow(F.lit(2.0), F.col("gf")))
    for c in "zyx":
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"place.{c}") / F.col("size")), F.floor((F.col(f"place.{c}") + F.col("place.size")) / F.col("size")))))
    cells = cells.withColumn("ct", F.explode(F.sequence(F.floor(F.col("place.t0") / F.col("span")), F.floor(F.col("place.t1") / F.col("span")))))
    grid = ["recording", "gs", "gf", "cz", "cy", "cx", "ct"]
    a, b = (cells.select(*grid, "size", "span", F.col("id").alias(k), F.col("place").alias(f"p{k}"), F.col("cs").alias(f"cs{k}"), F.col("cf").alias(f"cf{k}")) for k in "ab")
    meet = (F.col("a") < F.col("b")) & (F.greatest("csa", "csb") == F.col("gs")) & (F.greatest("cfa", "cfb") == F.col("gf"))
    for c in "zyx":
        low = F.greatest(F.col(f"pa.{c}"), F.col(f"pb.{c}"))
        meet &= (low < F.col(f"pa.{c}") + F.col("pa.size")) & (low < F.col(f"pb.{c}") + F.col("pb.size")) & (F.floor(low / F.col("size")) == F.col(f"c{c}"))
    first = F.greatest("pa.t0", "pb.t0")
    meet &= (first <= F.col("pa.t1")) & (first <= F.col("pb.t1")) & (F.floor(first / F.col("span")) == F.col("ct"))
    # the size of an exploded side is not known before it runs, so it must not be broadcast on a guess
    return a.join(b.drop("size", "span").hint("merge"), grid).where(meet).select("a", "b")


def related_windows(table: DataFrame) -> DataFrame:
    """(id, component) of every window: those that share tissue and time, directly or through others.

    Windows of the same place are one before pairs are sought.  A window without a
    complete place is related to itself only, and so is one whose cube or frame span is empty.
    """
    stages = Stages(table.sparkSession, "windows")
    all_, _ = stages.write(windows(table), "windows")
    solid = (F.col("place.size") > 0) & (F.col("place.t1") >= F.col("place.t0"))
    same = all_.where(F.col("place").isNotNull() & solid).groupBy("recording", "place").agg(F.min("id").alias("rep"))
    same, _ = stages.write(same, "places")
    pairs, _ = stages.write(overlapping(same.select(F.col("rep").alias("id"), "recording", "place")), "pairs")
    found = components(pairs).withColumnsRenamed({"node": "rep", "component": "comp"})
    return all_.join(same, ["recording", "place"], "left").join(found, "rep", "left").select("id", F.coalesce("comp", "rep", "id").alias("component"))


def listed(splits: DataFrame) -> DataFrame:
    """(split_name, side, id), distinct, of both lists of every plan; null entries name no window."""
    sides = [splits.select(F.col("name").alias("split_name"), F.lit(s).alias("side"), F.explode(s).alias("id")) for s in ("train", "test")]
    return sides[0].unionByName(sides[1]).where("id is not null and split_name is not null").distinct()


def broken_plans(splits: DataFrame, related: DataFrame) -> DataFrame:
    """(split_name, window_id) of test windows that are related to a train window of the same plan."""
    rows = listed(splits).join(related, "id")
    train = rows.where("side = 'train'").select("split_name", "component").distinct()
    return rows.where("side = 'test'").join(train, ["split_name", "component"], "left_semi").select("split_name", F.col("id").alias("window_id"))


#: The plan of windows that no plan names, neither them nor any related with them.
UNLISTED = "unlisted"


def planned(splits: DataFrame, related: DataFrame) -> DataFrame:
    """(split_name, window_id, part): the windows of every plan dealt anew in its shares, related ones together.

    A plan holds the windows it names and those related with them.  Windows of no plan form one named UNLISTED, so every window lands
    somewhere.  The plan's components follow each other in the order of their hashes; one goes to the part in whose share of
    all windows its middle falls, so shares are met up to the size of a component.  Missing shares are 0; a plan without
    any is dealt 0.8, 0.1 and 0.1.  Components are summed up in ranges, so no plan is gathered in one task.
    """
    held = listed(splits).select("split_name", "id").join(related, "id").select("split_name", "component").distinct()
    rows = related.join(held, "component", "left").select(F.coalesce("split_name", F.lit(UNLISTED)).alias("split_name"), "component", "id")
    rows, _ = Stages(related.sparkSession, "planned").write(rows, "rows")
    sizes = rows.groupBy("split_name", "component").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("split_name").agg(F.count(F.lit(1)).alias("total"))
    summed = prefix_sums(sizes, ["split_name"], [F.xxhash64("component"), F.col("component")], "n", "upto").join(total, "split_name")
    middle = (F.col("upto") - F.col("n") / 2) / F.col("total")
    share = [F.coalesce(f"{s}_share", F.lit(0.0)) for s in ("train", "valid", "test")]
    whole = share[0] + share[1] + share[2]
    plans = splits.where("name is not null").select(F.col("name").alias("split_name"), *(F.when(whole > 0, s / whole).otherwise(F.lit(d)).alias(c) for s, d, c in zip(share, (0.8, 0.1, 0.1), ("s0", "s1", "s2"))))
    plans = plans.groupBy("split_name").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    dealt = summed.withColumn("middle", middle).join(plans, "split_name", "left")
    s0, s1 = F.coalesce("s0", F.lit(0.8)), F.coalesce("s1", F.lit(0.1))
    part = F.when(F.col("middle") < s0, "train").when(F.col("middle") < s0 + s1, "validation").otherwise("test")
    return rows.join(dealt.select("split_name", "component", part.alias("part")), ["split_name", "component"]).select("split_name", F.col("id").alias("window_id"), "part")
