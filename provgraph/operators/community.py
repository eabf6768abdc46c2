"""Communities of directed graphs: label propagation, modularity, local moving and refinement, with bounded sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, connected_components, small
from provgraph.functions import uniform


def kept(df: DataFrame) -> DataFrame:
    """``checkpointed``, and joined by a shuffle: a broadcast would send a table that grows through the driver in each round."""
    return checkpointed(df).hint("merge")


def label_propagation(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """``node``, ``label``: each round every node takes the most frequent label around it, the least on ties."""
    near = kept(pairs.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(pairs.select("dst", "src")))
    state = near.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = near.join(state.toDF("other", "label"), "other").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        state = kept(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")))
    return state


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Directed modularity of a membership (``node``, ``community``): the share of inner edges less what degrees make likely."""
    src, dst = membership.toDF("src", "a"), membership.toDF("dst", "b")
    placed = pairs.select("src", "dst").join(src.hint("merge"), "src").join(dst.hint("merge"), "dst")
    ends = F.array(F.struct(F.col("a").alias("community"), F.lit(1).alias("out"), F.lit(0).alias("into"), (F.col("a") == F.col("b")).cast("int").alias("inner")), F.struct(F.col("b").alias("community"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).alias("inner")))
    sums = placed.select(F.explode(ends).alias("x")).select("x.*").groupBy("community").agg(*(F.sum(c).alias(c) for c in ("out", "into", "inner")))
    return sums.withColumn("m", F.sum("out").over(Window.partitionBy(F.lit(0)))).agg(F.sum(F.col("inner") / F.col("m") - F.col("out") * F.col("into") / (F.col("m") * F.col("m")).cast("double")).alias("modularity"))


def linked(weights: DataFrame, parents: DataFrame, graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours inside a parent (``node``, ``other``, ``w``), and each node's weights out and in (``k_out``, ``k_in``) with the whole weight of its graph
    (``total``). ``graphs``: ``node``, ``parent``; each is a graph of its own, as a community that is split again is."""
    kin = lambda end: parents.toDF(end, f"{end}_parent")
    inside = kept(weights.join(kin("src"), "src").join(kin("dst"), "dst").where("src_parent = dst_parent").select("src", "dst", "w"))
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("w").alias("out"), F.lit(0.0).alias("into")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0.0).alias("out"), F.col("w").alias("into")))
    degrees = kept(weights.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("out").alias("k_out"), F.sum("into").alias("k_in")))
    near = kept(inside.where("src <> dst").select(F.explode(ends).alias("x")).select("x.node", "x.other", (F.col("x.out") + F.col("x.into")).alias("w")))
    graph_of = graphs.toDF("node", "graph")
    totals = weights.join(graph_of.toDF("src", "graph"), "src").groupBy("graph").agg(F.sum("w").alias("total"))
    return near, kept(degrees.join(graph_of, "node").join(small(checkpointed(totals)), "graph").drop("graph"))


def local_moving(weights: DataFrame, parents: DataFrame, rounds: int = 12, start: DataFrame | None = None) -> DataFrame:
    """``node``, ``community`` after half-rounds of moves to the neighbouring community of greatest modularity gain.

    ``weights``: ``src``, ``dst``, ``w``; ``parents``: ``node``, ``parent``; moves stay inside a parent. ``start``: the communities to begin with, else
    each node its own. In each half-round only the nodes of one parity of a hash may move, which keeps neighbours from swapping for ever.
    """
    alone = parents.select("node", F.col("node").alias("community"))
    near, degrees = linked(weights, parents, parents)
    total = F.col("total")
    state = kept(alone if start is None else start.select("node", "community"))
    still = 0
    for turn in range(rounds):
        placed = state.join(degrees, "node")
        sums = placed.groupBy("community").agg(F.sum("k_out").alias("sum_out"), F.sum("k_in").alias("sum_in"))
        links = near.join(state.toDF("other", "to"), "other").groupBy("node", "to").agg(F.sum("w").alias("links"))
        own = placed.select("node", F.col("community").alias("to"), F.lit(0.0).alias("links"))
        options = links.unionByName(own).groupBy("node", "to").agg(F.sum("links").alias("links"))
        rated = options.join(placed.hint("merge"), "node").join(sums.withColumnRenamed("community", "to").hint("merge"), "to")
        mine = F.col("to") == F.col("community")
        gain = F.col("links") / total - (F.col("k_out") * (F.col("sum_in") - F.when(mine, F.col("k_in")).otherwise(0.0)) + F.col("k_in") * (F.col("sum_out") - F.when(mine, F.col("k_out")).otherwise(0.0))) / (total * total)
        best = rated.groupBy("node").agg(F.min_by("to", F.struct(-F.round(gain, 12), ~mine, "to")).alias("to"))
        turned = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        moved = kept(state.join(best.hint("merge"), "node", "left").select("node", F.when(turned, F.coalesce("to", "community")).otherwise(F.col("community")).alias("community"), (turned & (F.coalesce("to", "community") != F.col("community"))).alias("moved")))
        count = moved.where("moved").count()
        state = moved.select("node", "community")
        still = still + 1 if count == 0 else 0
        if still == 2:
            break
    return state


def refined(weights: DataFrame, membership: DataFrame, graphs: DataFrame, rounds: int = 4) -> DataFrame:
    """``node``, ``community``: each community of ``membership`` taken apart and put together again from single nodes, inside it only.

    In a half-round the lone nodes of one parity join a neighbouring community that has the other parity's name, with a chance in proportion
    to the modularity gained, drawn by hash; what gains nothing stays apart. Only lone nodes move and only along an edge, so every
    part is connected, which communities of local moving need not be.
    """
    parents = membership.toDF("node", "parent")
    state = kept(parents.select("node", F.col("node").alias("community")))
    near, degrees = linked(weights, parents, graphs)
    total = F.col("total")
    parity = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    for turn in range(2 * rounds):
        placed = state.join(degrees, "node")
        sums = placed.groupBy("community").agg(F.sum("k_out").alias("sum_out"), F.sum("k_in").alias("sum_in"), F.count(F.lit(1)).alias("n"))
        lone = placed.join(sums.where("n = 1").select("community").hint("merge"), "community", "left_semi").where(parity(F.col("node")) == turn % 2).select("node", "k_out", "k_in", "total")
        links = near.join(lone, "node").join(state.toDF("other", "to"), "other").where((F.col("to") != F.col("node")) & (parity(F.col("to")) != turn % 2)).groupBy("node", "k_out", "k_in", "total", "to").agg(F.sum("w").alias("links"))
        rated = links.join(sums.withColumnRenamed("community", "to").hint("merge"), "to").withColumn("gain", F.col("links") / total - (F.col("k_out") * F.col("sum_in") + F.col("k_in") * F.col("sum_out")) / (total * total))
        race = -F.ln(uniform(F.concat_ws("|", "node", "to", F.lit(str(turn))))) / F.col("gain")
        drawn = kept(rated.where("gain > 1e-12").groupBy("node").agg(F.min_by("to", F.struct(race, "to")).alias("to")))
        if turn and drawn.isEmpty() and still:
            break
        still = drawn.isEmpty()
        state = kept(state.join(drawn, "node", "left").select("node", F.coalesce("to", "community").alias("community")))
    return state


def communities(pairs: DataFrame, parents: DataFrame | None = None, levels: int = 2, rounds: int = 12, refine: bool = True) -> DataFrame:
    """``node``, ``community``: local moving, refinement inside each community, contraction of the refined parts, again.

    The next level's moving begins with the communities so far, so refined parts can leave theirs, which contracting whole communities rules out (``refine=False``). Last
    each community is split into its connected parts.
    """
    edges = kept(pairs.select("src", "dst", F.lit(1.0).alias("w")))
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("node")
    parents = kept(nodes.withColumn("parent", F.lit("all")) if parents is None else parents.select("node", "parent"))
    place = parents.select("node", F.col("node").alias("part"))
    weights, kin, start = edges, parents, None
    for level in range(levels):
        moved = local_moving(weights, kin, rounds, start)
        if level == levels - 1:
            break
        parts = refined(weights, moved, kin) if refine else moved
        place = kept(place.withColumnRenamed("part", "old").join(parts.toDF("old", "part"), "old").select("node", "part"))
        one, two = parts.toDF("src", "a"), parts.toDF("dst", "b")
        weights = kept(weights.join(one, "src").join(two, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        above = parts.withColumnRenamed("community", "part")
        kin = kept(kin.join(above, "node").groupBy(F.col("part").alias("node")).agg(F.min("parent").alias("parent")))
        start = kept(moved.join(above, "node").groupBy(F.col("part").alias("node")).agg(F.min("community").alias("community")))
    place = kept(place.join(moved.toDF("part", "community"), "part").select("node", "community"))
    src, dst = place.toDF("src", "a"), place.toDF("dst", "b")
    inner = edges.join(src, "src").join(dst, "dst").where("a = b").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    roots = connected_components(inner, merged=True)
    return place.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("community"))


def bounded_communities(pairs: DataFrame, most: int = 500, depth: int = 2, least: int = 2, rounds: int = 12) -> DataFrame:
    """``node``, ``community`` (from 0, largest first): groups over ``most`` nodes are split again up to ``depth`` times,
    groups under ``least`` nodes go."""
    found = kept(communities(pairs, rounds=rounds))
    for _ in range(depth):
        sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > most).select("community")
        if large.isEmpty():
            break
        parents = kept(found.join(large, "community").select("node", F.col("community").alias("parent")))
        one, two = parents.toDF("src", "a"), parents.toDF("dst", "b")
        inner = pairs.join(one, "src").join(two, "dst").where("a = b").select("src", "dst")
        again = communities(inner, parents, rounds=rounds)
        rest = found.join(large, "community", "left_anti").select("node", "community")
        lone = parents.join(again, "node", "left_anti").select("node", F.col("node").alias("community"))
        found = kept(rest.unionByName(again).unionByName(lone))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where(F.col("n") >= least)
    numbered = sizes.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first")) - 1)
    return found.join(numbered.select("community", "number"), "community").select("node", F.col("number").cast("long").alias("community"))


def members(membership: DataFrame) -> DataFrame:
    """The members of each community, sorted."""
    return membership.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))


def community_snapshots(vertices: DataFrame, pairs: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and induced edges of each community as snapshots."""
    from .graph import induced_subgraphs

    of = membership.select(F.col("node").alias("name"), F.col("community").alias("snapshot_id"))
    return vertices.join(of, "name"), induced_subgraphs(pairs, of, "snapshot_id")
