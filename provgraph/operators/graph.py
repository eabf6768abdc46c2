"""Property graphs from edge tables, all snapshots at once: ``keys`` names the columns that tell snapshots apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.cluster import dense_ids, small

from .edges import ends, resolve_properties


def node_frequency(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How often each node stands at an end of a row; a self-loop counts twice."""
    keys = keys or []
    return ends(edges, *keys).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("frequency"))


def node_types(edges: DataFrame, keys: list[str] | None = None, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """Each node's type in the first row that mentions it, the actor's side first."""
    keys = keys or []
    return ends(edges, *keys, *order).groupBy(*keys, "name").agg(F.min_by("type", F.struct(*order, "side")).alias("type"))


def node_properties(edges: DataFrame, properties: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each node's distinct properties, sorted."""
    keys = keys or []
    return resolve_properties(ends(edges, *keys), properties).groupBy(*keys, "name").agg(F.sort_array(F.collect_set("property")).alias("properties"))


def vertices(edges: DataFrame, properties: DataFrame, labels: DataFrame, keys: list[str] | None = None, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """``name, type, properties, frequency, label`` per snapshot, in one aggregation over the edges' ends."""
    keys = keys or []
    both = resolve_properties(ends(edges, *keys, *order), properties)
    nodes = both.groupBy(*keys, "name").agg(
        F.min_by("type", F.struct(*order, "side")).alias("type"),
        F.sort_array(F.collect_set("property")).alias("properties"),
        F.count(F.lit(1)).alias("frequency"),
    )
    listed = labels.select(F.col("label").alias("name")).distinct().withColumn("listed", F.lit(1))
    return nodes.join(listed, "name", "left").withColumn("label", F.coalesce("listed", F.lit(0))).select(*keys, "name", "type", "properties", "frequency", "label")


def edge_actions(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One edge for each ordered pair, with its distinct actions sorted and ``type`` the first of them."""
    keys = keys or []
    return edges.groupBy(*keys, F.col("actorID").alias("src"), F.col("objectID").alias("dst")).agg(F.sort_array(F.collect_set("action")).alias("actions")).withColumn("type", F.element_at("actions", 1))


def first_action(edges: DataFrame, keys: list[str] | None = None, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """The first action of each ordered pair and its time."""
    keys = keys or []
    return edges.groupBy(*keys, F.col("actorID").alias("src"), F.col("objectID").alias("dst")).agg(F.min_by("action", F.struct(*order)).alias("type"), F.min("us").alias("us"))


def edge_per_action(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Parallel edges: one for each pair and action."""
    return edges.select(*(keys or []), F.col("actorID").alias("src"), F.col("objectID").alias("dst"), "action").distinct()


def dense_index(nodes: DataFrame, keys: list[str], name: str = "name", index: str = "idx") -> DataFrame:
    """Numbers from 0 in order of names within each snapshot.

    Nodes of all snapshots are numbered together in order, in two levels, and each snapshot's first number is taken off, so no task orders a whole snapshot.
    """
    numbered = dense_ids(nodes.select(F.struct(*keys, name).alias("at")), "at", "id").select("at.*", "id")
    if not keys:
        return numbered.select(name, F.col("id").cast("int").alias(index))
    firsts = numbered.groupBy(*keys).agg(F.min("id").alias("first"))
    return numbered.join(small(firsts), keys).select(*keys, name, (F.col("id") - F.col("first")).cast("int").alias(index))


def edge_index(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the dense numbers of both ends."""
    names = pairs.select(*keys, F.explode(F.array("src", "dst")).alias("name")).distinct()
    numbers = dense_index(names, keys)
    of = lambda end: numbers.select(*keys, F.col("name").alias(end), F.col("idx").alias(f"{end}_idx"))
    return pairs.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst"])


def induced_subgraphs(pairs: DataFrame, members: DataFrame, group: str = "community") -> DataFrame:
    """Edges whose two ends lie in one group. ``members``: ``name`` and the group's column."""
    out = members.select(F.col("name").alias("src"), group)
    into = members.select(F.col("name").alias("dst"), group)
    return pairs.join(out, "src").join(into, ["dst", group])


def dataset_counts(edges: DataFrame) -> DataFrame:
    """Rows, distinct pairs and nodes of each category."""
    pairs = edges.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("actorID", "objectID").alias("pairs"))
    nodes = ends(edges, "category").groupBy("category").agg(F.count_distinct("name").alias("nodes"))
    return pairs.join(nodes, "category")


def triples(pairs: DataFrame, nodes: DataFrame, undefined: str = "undefined_relation") -> DataFrame:
    """``h, r, t``: property text of both ends and each action between them. ``nodes``: ``name``, ``properties``."""
    text = nodes.select("name", F.array_join("properties", " ").alias("text"))
    head, tail = text.toDF("src", "h"), text.toDF("dst", "t")
    relation = F.explode(F.when(F.size("actions") > 0, F.col("actions")).otherwise(F.array(F.lit(undefined))))
    return pairs.join(head, "src").join(tail, "dst").select("h", relation.alias("r"), "t")
