"""Lineage in provenance graphs: ancestors, components, resource access, shared-ancestor clusters, path weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, connected_components
from provgraph.schema import PROCESS_TYPE, RESOURCE_TYPES

from .reach import condensed, strong_components


def ancestors(pairs: DataFrame) -> DataFrame:
    """``node``, ``ancestor``: all that reach a node along the edges; a node on a cycle is its own ancestor.

    The pairs are those of strongly connected components: each round joins the newest pairs of the condensed graph with all known ones, on either side, so the
    reach doubles until nothing new comes. Rows are dealt by pair before equal ones are
    sought, since one task of the join may make most of them. Members are put in at the end, so a component of many vertices is passed through once and not once for each way.
    """
    parts = strong_components(pairs)
    known = newest = checkpointed(condensed(pairs, parts).select(F.col("dst").alias("node"), F.col("src").alias("ancestor")))
    while not newest.isEmpty():
        onward = lambda df: df.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        longer = newest.join(onward(known), "ancestor").union(known.join(onward(newest), "ancestor")).select("node", F.col("far").alias("ancestor"))
        newest = checkpointed(longer.repartition("node", "ancestor").distinct().join(known, ["node", "ancestor"], "left_anti"))
        known = checkpointed(known.union(newest))
    cyclic = parts.where("cyclic").select("root").distinct()
    reached = known.union(cyclic.select("root", "root")).toDF("root", "above")
    below, above = parts.select("node", "root"), parts.select(F.col("node").alias("ancestor"), F.col("root").alias("above"))
    return reached.join(below, "root").join(above, "above").select("node", "ancestor")


def components(pairs: DataFrame, merged: bool = False) -> DataFrame:
    """``node``, ``root`` of the undirected graph."""
    return connected_components(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), merged)


def related(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``related``: whether the two nodes ``x``, ``y`` of each asked pair lie in one component."""
    roots = components(pairs)
    both = asked.join(roots.toDF("x", "rx"), "x", "left").join(roots.toDF("y", "ry"), "y", "left")
    return both.select("x", "y", F.coalesce(F.col("rx") == F.col("ry"), F.lit(False)).alias("related"))


def resource_links(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """``resource``, ``process`` for every edge between the two, in either direction. ``types``: ``name``, ``type``."""
    src, dst = types.toDF("src", "src_type"), types.toDF("dst", "dst_type")
    typed = pairs.select("src", "dst").join(src, "src").join(dst, "dst")
    is_resource = lambda c: F.col(c).isin(*RESOURCE_TYPES)
    forward = typed.where((F.col("src_type") == PROCESS_TYPE) & is_resource("dst_type")).select(F.col("dst").alias("resource"), F.col("src").alias("process"))
    back = typed.where(is_resource("src_type") & (F.col("dst_type") == PROCESS_TYPE)).select(F.col("src").alias("resource"), F.col("dst").alias("process"))
    return forward.union(back).distinct()


def resource_access(links: DataFrame) -> DataFrame:
    """The processes of each resource."""
    return links.groupBy("resource").agg(F.sort_array(F.collect_list("process")).alias("processes"))


def resource_weights(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """``weight`` of each process at a resource: its cluster's size over the sum of all its processes' sizes."""
    sizes = checkpointed(clusters.groupBy("resource", "cluster").agg(F.count(F.lit(1)).alias("size")))
    totals = sizes.groupBy("resource").agg(F.sum(F.col("size") * F.col("size")).alias("total"))
    shares = sizes.join(totals, "resource").select("resource", "cluster", (F.col("size") / F.col("total")).alias("weight"))
    return clusters.join(shares, ["resource", "cluster"]).select("resource", "process", "weight")


def normalised(weights: DataFrame, source: str = "src", weight: str = "weight") -> DataFrame:
    """Weights over the sum of their source's weights."""
    return weights.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(source)))


def trimmed(near: DataFrame, ends: DataFrame, rounds: int = 3) -> DataFrame:
    """Neighbours without dead ends: a node with one neighbour is inside no simple path. Nodes of ``ends`` (``at``) stay."""
    for _ in range(rounds):
        lone = near.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n = 1").join(ends, "at", "left_anti").select("at")
        fewer = checkpointed(near.join(lone, "at", "left_anti").join(lone.withColumnRenamed("at", "next"), "next", "left_anti").select("at", "next", "resource"))
        if fewer.count() == near.count():
            return near
        near = fewer
    return near


def detours(tried: DataFrame, near: DataFrame, longest: int) -> DataFrame:
    """``src``, ``dst``, ``by``, ``length``: fewest vertices on a simple path by way of a vertex, up to ``longest``.

    Such a path is two paths from ``by``, one to each end, that share no vertex, so it is a flow of two units of least cost. ``tried`` has the first
    unit: ``first``, a shortest path from ``by`` to the nearer end, and ``other``, the end that is left. The second unit is a shortest path in what the first
    leaves over: a step costs 1; a step onto the first path must go back along it, which gives the steps back, and may leave it
    anywhere. Costs are improved in rounds; a round has at most two rows for each vertex and row of ``tried``.
    """
    key = ["src", "dst", "by"]
    paths = tried.select(*key, "first", "other")
    best = frontier = checkpointed(tried.select(*key, F.col("by").alias("at"), F.lit(False).alias("turned"), F.lit(0).alias("cost")))
    ended = None
    while True:
        steps = frontier.join(near.select("at", "next"), "at").join(paths, key).where("next <> by")
        steps = steps.withColumn("place", F.array_position("first", F.col("next"))).withColumn("own", F.array_position("first", F.col("at")))
        steps = steps.where("place = 0 or own = 0 or place <> own + 1")
        onto = F.expr("transform(sequence(2, cast(place as int) - 1), j -> struct(element_at(first, j) as at, true as turned, cast(cost + 1 - (place - j) as int) as cost))")
        options = F.when(F.col("place") == 0, F.array(F.struct(F.col("next").alias("at"), F.lit(False).alias("turned"), (F.col("cost") + 1).alias("cost")))).when(F.col("place") > 2, onto)
        moved = steps.select(*key, "other", F.explode(options).alias("to")).select(*key, "other", "to.*").where(F.col("cost") < longest)
        cheapest = moved.groupBy(*key, "other", "at", "turned").agg(F.min("cost").alias("cost"))
        known = best.withColumnRenamed("cost", "had")
        frontier = checkpointed(cheapest.join(known, [*key, "at", "turned"], "left").where("had is null or cost < had").select(*key, "at", "turned", "cost", (F.col("at") == F.col("other")).alias("ends")))
        found = frontier.where("ends").select(*key, "cost")
        ended = found if ended is None else ended.union(found)
        frontier = frontier.where("not ends").drop("ends")
        if frontier.isEmpty():
            break
        best = checkpointed(best.union(frontier).groupBy(*key, "at", "turned").agg(F.min("cost").alias("cost")))
    least = ended.groupBy(*key).agg(F.min("cost").alias("cost"))
    return least.join(paths, key).select(*key, (F.size("first") + F.col("cost")).alias("length")).where(F.col("length") <= longest)


def joined_by_resource(asked: DataFrame, near: DataFrame) -> DataFrame:
    """The asked pairs whose ends have a resource as a common neighbour. Each pair is opened at the end with fewer resources around it."""
    around = near.where("resource").select("at", F.col("next").alias("by"))
    numbers = checkpointed(around.groupBy("at").agg(F.count(F.lit(1)).alias("n")))
    of = lambda end: numbers.select(F.col("at").alias(end), F.col("n").alias(f"{end}_n"))
    sided = asked.join(of("src"), "src").join(of("dst"), "dst")
    less = F.col("src_n") <= F.col("dst_n")
    opened = sided.select("src", "dst", F.when(less, F.col("src")).otherwise(F.col("dst")).alias("at"), F.when(less, F.col("dst")).otherwise(F.col("src")).alias("far"))
    return opened.join(around, "at").join(around.withColumnRenamed("at", "far"), ["far", "by"], "left_semi").select("src", "dst").distinct()


def resource_path_lengths(wanted: DataFrame, pairs: DataFrame, types: DataFrame, longest: int = 11, at_once: int = 8) -> DataFrame:
    """``length`` of wanted pairs (``src``, ``dst``): fewest vertices on an undirected simple path that passes a resource.

    Pairs with a resource as a common neighbour have three vertices, and a join of the ends' neighbours finds them all; the others are searched.
    For each pair, distances from either end that avoid the other grow by one step a round, each with one shortest path; a pair and a vertex have one row
    for each end. The sum of a resource's two distances bounds its paths from below, so resources are taken in order of that sum.
    Where its two shortest paths share nothing else, the sum is its length; otherwise ``detours`` gives the exact
    one, for up to ``at_once`` resources of a pair at a time. A pair stops at the first sum that equals a length found.
    Pairs without such a path of up to ``longest`` vertices are absent, and so are pairs of a node with itself.
    """
    near = pairs.select("src", "dst").union(pairs.select("dst", "src")).where("src <> dst").distinct().toDF("at", "next")
    resources = types.where(F.col("type").isin(*RESOURCE_TYPES)).select(F.col("name").alias("next"), F.lit(True).alias("resource")).distinct()
    near = checkpointed(near.join(resources, "next", "left").select("at", "next", F.coalesce("resource", F.lit(False)).alias("resource")))
    asked = checkpointed(wanted.select("src", "dst").where("src <> dst").distinct())
    direct = checkpointed(joined_by_resource(asked, near).where(F.lit(longest >= 3)).withColumn("length", F.lit(3)))
    asked = checkpointed(asked.join(direct, ["src", "dst"], "left_anti"))
    if asked.isEmpty():
        return direct
    near = trimmed(near, checkpointed(asked.select(F.explode(F.array("src", "dst")).alias("at")).distinct()))
    key = ["src", "dst"]
    done = lengths = asked.limit(0).withColumn("length", F.lit(0))
    open_pairs = asked

    def grown(frontier: DataFrame, settled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        onward = frontier.select(*key, "at", "path").join(open_pairs, key, "left_semi").join(near, "at").where("next <> src and next <> dst")
        fresh = onward.groupBy(*key, F.col("next").alias("at")).agg(F.min(F.concat("path", F.array("next"))).alias("path"), F.first("resource").alias("resource"))
        fresh = checkpointed(fresh if settled is None else fresh.join(settled, [*key, "at"], "left_anti"))
        return fresh, fresh if settled is None else settled.union(fresh)

    start = lambda end: asked.select("src", "dst", F.col(end).alias("at"), F.array(end).alias("path"))
    (ahead, reached), (behind, reached_back) = grown(start("src"), None), grown(start("dst"), None)
    for length in range(3, longest + 1):
        if length > 3:
            (ahead, reached), (behind, reached_back) = grown(ahead, reached), grown(behind, reached_back)
        met = reached.where("resource").join(open_pairs, key, "left_semi").select(*key, "at", "path").join(reached_back.select(*key, "at", F.col("path").alias("back")), [*key, "at"])
        met = checkpointed(met.where(F.size("path") + F.size("back") - 1 == length).withColumn("simple", F.size(F.array_intersect("path", "back")) == 1))
        ready = met.where("simple").select(*key).union(lengths.where(F.col("length") <= length).select(*key)).distinct()
        done = checkpointed(done.union(ready.join(open_pairs, key, "left_semi").withColumn("length", F.lit(length))))
        open_pairs = asked.join(done, key, "left_anti")
        ahead_first = F.size("path") <= F.size("back")
        rest = met.join(open_pairs, key, "left_semi").select(*key, F.col("at").alias("by"), F.reverse(F.when(ahead_first, F.col("path")).otherwise(F.col("back"))).alias("first"), F.when(ahead_first, F.col("dst")).otherwise(F.col("src")).alias("other"))
        if not met.where("not simple").isEmpty():
            rest = checkpointed(rest.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("by")) - 1) / at_once)))
            turns = rest.agg(F.max("turn")).first()[0]
        else:
            turns = None
        for turn in range(0 if turns is None else turns + 1):
            tried = rest.where(F.col("turn") == turn).join(open_pairs, key, "left_semi")
            found = checkpointed(detours(tried, near, longest).groupBy(*key).agg(F.min("length").alias("length")))
            lengths = checkpointed(lengths.union(found))
            done = checkpointed(done.union(found.where(F.col("length") == length)))
            open_pairs = asked.join(done, key, "left_anti")
        if open_pairs.isEmpty() or (ahead.isEmpty() and behind.isEmpty()):
            break
    late = lengths.join(done, key, "left_anti").groupBy(*key).agg(F.min("length").alias("length"))
    return direct.unionByName(done).unionByName(late)


def process_weights(pairs: DataFrame, types: DataFrame, base: float = 1.0, delta: float = 5.0, longest: int = 11) -> DataFrame:
    """Weights of edges between processes, raised where a resource lies on a path between their ends, normalised per source."""
    kind = lambda end: types.toDF(end, f"{end}_type")
    between = pairs.select("src", "dst").join(kind("src"), "src").join(kind("dst"), "dst").where((F.col("src_type") == PROCESS_TYPE) & (F.col("dst_type") == PROCESS_TYPE)).select("src", "dst").distinct()
    between = checkpointed(between)
    lengths = resource_path_lengths(between, pairs, types, longest)
    raised = F.when(F.col("length").isNull(), base).otherwise(base * (1 + delta / F.col("length")))
    return normalised(between.join(lengths, ["src", "dst"], "left").withColumn("weight", raised).drop("length"))


def weight_listing(weights: DataFrame) -> DataFrame:
    """``src -> dst: weight`` lines."""
    return weights.select(F.concat(F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(": "), F.format_number("weight", 4)).alias("line"))
