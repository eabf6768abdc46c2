"""Who shares an ancestor, without the table of all ancestors: strongly connected components, the condensed graph, labels of its roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, connected_components

#: Roots that a label holds; a vertex below more roots has the least of them and is marked as cut.
LABEL = 16
#: Rounds of trimming before each colouring.
TRIMS = 8


def spread(start: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """All rows (``key``, ``node``) that follow from ``start`` along ``edges`` (``node``, ``next``, and ``key`` or none of it); the newest rows alone are joined.
    Rows are dealt before equal ones are sought, since one task of the join may make most of them."""
    on = ["node", *(k for k in key if k in edges.columns)]
    known = newest = checkpointed(start.select(*key, "node").distinct())
    while True:
        ahead = newest.join(edges, on).select(*key, F.col("next").alias("node")).repartition(*key, "node").distinct()
        newest = checkpointed(ahead.join(known, [*key, "node"], "left_anti"))
        if newest.isEmpty():
            return known
        known = checkpointed(known.union(newest))


def strong_components(pairs: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its strongly connected component), ``cyclic`` (it has an edge inside).

    By colours: each vertex takes the least vertex that reaches it, then those from which a colour's own vertex is reached inside the colour
    are its component. Edges between colours and at found vertices go, and so do, before each turn, vertices without an edge in or out.
    """
    every = checkpointed(pairs.select("src", "dst").distinct())
    edges, found = every.where("src <> dst"), None
    while True:
        for _ in range(TRIMS):
            inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            inner = checkpointed(inner.select("src", "dst"))
            same = inner.count() == edges.count()
            edges = inner
            if same:
                break
        if edges.isEmpty():
            break
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = changed = checkpointed(nodes.withColumn("colour", F.col("node")))
        while True:
            seen = edges.join(changed.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            changed = checkpointed(colour.join(seen, "node").where("low < colour").select("node", F.col("low").alias("colour")))
            if changed.isEmpty():
                break
            colour = checkpointed(colour.join(changed, "node", "left_anti").union(changed))
        one, two = colour.toDF("src", "a"), colour.toDF("dst", "b")
        inside = checkpointed(edges.join(one, "src").join(two, "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        back = inside.select(F.col("dst").alias("node"), F.col("src").alias("next"), "colour")
        members = spread(colour.where("node = colour"), back, ["colour"]).select("node", F.col("colour").alias("root"))
        found = members if found is None else found.union(members)
        gone = members.select("node")
        edges = checkpointed(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    nodes = every.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    placed = nodes.withColumn("root", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    loops = every.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    sized = placed.join(loops, "node", "left").groupBy("root").agg((F.count(F.lit(1)) + F.coalesce(F.max(F.col("loop").cast("int")), F.lit(0)) > 1).alias("cyclic"))
    return checkpointed(placed.join(sized, "root").select("node", "root", "cyclic"))


def condensed(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``src``, ``dst``: the edges between strongly connected components, by their roots."""
    of = parts.select("node", "root")
    return checkpointed(pairs.select("src", "dst").join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def childless_above(parts: DataFrame, dag: DataFrame) -> DataFrame:
    """Components that nothing reaches, not even they themselves: their one vertex has no ancestor. ``root``."""
    return parts.where("not cyclic").select("root").join(dag.select(F.col("dst").alias("root")).distinct(), "root", "left_anti")


def clusters_by_ancestors(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``resource``, ``process``, ``cluster``: processes of a resource joined by common ancestors, else alone; named by the least process.

    In the condensed graph, take the components of a resource's processes and all above them. Any two that an edge joins there lie above one process, so
    the connected parts of that subgraph are the clusters, and no pair of a process and an ancestor is written: rows are
    (resource, component above it) and the edges among those, without the ``leaves`` of the graph, which join nothing. A process without ancestors stays alone even where it joins others.
    """
    parts = strong_components(pairs)
    dag = condensed(pairs, parts)
    lone = childless_above(parts, dag).withColumn("lone", F.lit(True))
    placed = checkpointed(links.select("resource", "process").join(parts.select(F.col("node").alias("process"), "root"), "process", "left").withColumn("root", F.coalesce("root", "process")).join(lone, "root", "left"))
    alone, held = placed.where("lone"), placed.where("lone is null").select("resource", "process", "root")
    up = joining(held.select(F.col("root").alias("node")), dag.select(F.col("dst").alias("node"), F.col("src").alias("next")), lone.select(F.col("root").alias("next")))
    above = spread(held.select("resource", F.col("root").alias("node")), up, ["resource"])
    tag = lambda c: F.concat("resource", F.lit("|"), c)
    roots = connected_components(above.join(up, "node").select(tag(F.col("node")).alias("a"), tag(F.col("next")).alias("b")).repartition("a", "b"))
    named = held.withColumn("node", tag(F.col("root"))).join(roots.withColumnRenamed("root", "part"), "node", "left").select("resource", "process", F.coalesce("part", "node").alias("part"))
    named = checkpointed(named)
    first = named.groupBy("part").agg(F.min("process").alias("cluster"))
    return alone.select("resource", "process", F.col("process").alias("cluster")).union(named.join(first, "part").select("resource", "process", "cluster"))


def joining(starts: DataFrame, up: DataFrame, lone: DataFrame) -> DataFrame:
    """The edges ``up`` (``node``, ``next`` above it) that are above ``starts``, without leaves: vertices of ``lone``, which nothing is above, over one vertex only."""
    over = spread(starts, up, [])
    inner = checkpointed(up.join(over, "node", "left_semi").select("node", "next"))
    leaves = inner.join(lone, "next", "left_semi").groupBy("next").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("next")
    return checkpointed(inner.join(leaves, "next", "left_anti").select("node", "next"))


def root_labels(parts: DataFrame, dag: DataFrame, most: int = LABEL) -> DataFrame:
    """``node`` (a component), ``label``, ``whole``: the roots of the condensed graph above it, itself if it is one; at most ``most``, the least ones.

    Labels go down the graph, those that changed in each round. A label that was never cut is the whole set.
    """
    starts = parts.select(F.col("root").alias("node")).distinct().join(dag.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    state = changed = checkpointed(starts.select("node", F.array("node").alias("label"), F.lit(True).alias("whole")))
    while True:
        given = changed.join(dag.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "label", "whole")
        touched = given.select("node").distinct()
        rows = given.union(state.join(touched, "node", "left_semi").select("node", "label", "whole"))
        cut = rows.groupBy("node").agg(F.min("whole").alias("whole"))
        each = rows.select("node", F.explode("label").alias("r")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("r"))).where(F.col("place") <= most + 1)
        listed = each.groupBy("node").agg(F.array_sort(F.collect_list("r")).alias("label")).join(cut, "node")
        merged = listed.select("node", F.slice("label", 1, most).alias("label"), (F.col("whole") & (F.size("label") <= most)).alias("whole"))
        had = state.toDF("node", "had", "was")
        changed = checkpointed(merged.join(had, "node", "left").where("had is null or had <> label or was <> whole").select("node", "label", "whole"))
        if changed.isEmpty():
            return state
        state = checkpointed(state.join(changed, "node", "left_anti").union(changed))


def share_ancestor(asked: DataFrame, pairs: DataFrame, most: int = LABEL) -> DataFrame:
    """``x``, ``y``, ``shared`` for asked pairs of vertices: whether something reaches both.

    What reaches both lies under a root that does, so labels of roots decide: a common root, or two whole labels without one. Only pairs with a cut label and no
    common root in sight are searched upwards, each with the components above either vertex.
    """
    parts = strong_components(pairs)
    dag = condensed(pairs, parts)
    none = childless_above(parts, dag).select(F.col("root").alias("node"), F.lit(True).alias("none"))
    labels = root_labels(parts, dag, most).join(none, "node", "left").select("node", F.when(F.col("none"), F.array().cast("array<string>")).otherwise(F.col("label")).alias("label"), "whole")
    of = checkpointed(parts.select("node", F.col("root").alias("part")).join(labels.withColumnRenamed("node", "part"), "part").select("node", "part", "label", "whole"))
    side = lambda end: of.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("part", "label", "whole")))
    both = checkpointed(asked.select("x", "y").distinct().join(side("x"), "x", "left").join(side("y"), "y", "left"))
    known = F.coalesce(F.arrays_overlap("x_label", "y_label"), F.lit(False))
    settled = known | F.coalesce((F.col("x_whole") & F.col("y_whole")) | (F.size("x_label") == 0) | (F.size("y_label") == 0), F.lit(True))
    decided = both.where(settled).select("x", "y", known.alias("shared"))
    rest = checkpointed(both.where(~settled))
    if rest.isEmpty():
        return decided
    up = dag.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    begin = rest.select("x", "y", F.lit(0).alias("side"), F.col("x_part").alias("node")).union(rest.select("x", "y", F.lit(1), "y_part"))
    reached = spread(begin, up, ["x", "y", "side"])
    met = reached.groupBy("x", "y", "node").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("x", "y").distinct().withColumn("met", F.lit(True))
    return decided.union(rest.select("x", "y").join(met, ["x", "y"], "left").select("x", "y", F.coalesce("met", F.lit(False)).alias("shared")))
