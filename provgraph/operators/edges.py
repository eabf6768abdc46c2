"""Edge-table operators: joins, filters, property resolution, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOIN_KEYS = ["actorID", "objectID", "action", "timestamp"]


def join_base_with_events(base: DataFrame, events: DataFrame) -> DataFrame:
    """Base edges with the command and path of their raw events; full-row distinct."""
    return base.join(events, JOIN_KEYS).distinct()


def drop_touching(edges: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Edges none of whose columns equals a label: one anti-join per column, so no pair of tables is crossed."""
    for column in columns:
        edges = edges.join(labels.select(F.col("label").alias(column)).distinct(), column, "left_anti")
    return edges


def exact_labels(nodes: DataFrame, labels: DataFrame, node: str = "name") -> DataFrame:
    """``label`` 1 where the node is listed."""
    listed = labels.select(F.col("label").alias(node)).distinct().withColumn("listed", F.lit(1))
    return nodes.join(listed, node, "left").withColumn("label", F.coalesce("listed", F.lit(0))).drop("listed")


def substring_labels(nodes: DataFrame, labels: list[str], node: str = "name") -> DataFrame:
    """``label`` 1 where any label is contained in the node's name. The list is an argument, hence small."""
    hit = F.exists(F.array(*map(F.lit, labels)), lambda x: F.col(node).contains(x)) if labels else F.lit(False)
    return nodes.withColumn("label", hit.cast("int"))


def first_wins(properties: DataFrame) -> DataFrame:
    """One property per kind and node: that of the earliest load, the least text on ties."""
    return properties.groupBy("kind", "node_id").agg(F.min_by("property", F.struct("load_order", "property")).alias("property"))


def best_property(properties: DataFrame) -> DataFrame:
    """One property per node: netflow before file before subject."""
    rank = F.when(F.col("kind") == "netflow", 0).when(F.col("kind") == "file", 1).otherwise(2)
    return properties.groupBy("node_id").agg(F.min_by("property", F.struct(rank, "property")).alias("known"))


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """Both ends of every edge, in one pass: ``name``, ``type``, ``side`` (0 actor, 1 object), ``fallback`` and ``keep``."""
    both = F.array(
        F.struct(F.col("actorID").alias("name"), F.col("actor_type").alias("type"), F.lit(0).alias("side")),
        F.struct(F.col("objectID").alias("name"), F.col("object").alias("type"), F.lit(1).alias("side")),
    )
    fallback = F.concat_ws(" ", "exec", "action", F.nullif("path", F.lit("")))
    return edges.select(*keep, fallback.alias("fallback"), F.explode(both).alias("e")).select(*keep, "fallback", "e.*")


def resolve_properties(ends_: DataFrame, properties: DataFrame) -> DataFrame:
    """Add ``property``: the node's known one, else command, action and path of the row."""
    known = best_property(properties).withColumnRenamed("node_id", "name")
    return ends_.join(known, "name", "left").withColumn("property", F.coalesce("known", "fallback")).drop("known", "fallback")


def near_labelled_times(edges: DataFrame, marked: DataFrame, minutes: int) -> DataFrame:
    """Edges within ``minutes`` of a marked event, by merged intervals and time buckets of that width.

    ``marked`` has ``us``. Overlapping intervals are merged first, so an edge meets one interval; an interval is listed
    under every bucket it reaches, which makes the join an equi-join on the bucket.
    """
    width = minutes * 60_000_000
    near = marked.select("us").distinct()
    by_bucket = Window.partitionBy("bucket").orderBy("us")
    # an interval begins anew where the previous marked time in this or the last bucket lies more than two widths back
    buckets = near.withColumn("bucket", F.floor(F.col("us") / (2 * width)))
    spans = buckets.withColumn("gap", F.coalesce(F.col("us") - F.lag("us").over(by_bucket), F.lit(2 * width + 1)))
    starts = spans.withColumn("group", F.sum((F.col("gap") > 2 * width).cast("int")).over(by_bucket)).groupBy("bucket", "group").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    covered = starts.select((F.col("low") - width).alias("low"), (F.col("high") + width).alias("high"))
    listed = covered.withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") / (2 * width)), F.floor(F.col("high") / (2 * width)))))
    slotted = edges.withColumn("slot", F.floor(F.col("us") / (2 * width)))
    hit = (slotted.slot == listed.slot) & (slotted.us >= listed.low) & (slotted.us <= listed.high)
    return slotted.join(listed, hit, "left_semi").drop("slot")


def time_split(edges: DataFrame, marked: DataFrame, malicious_minutes: int = 10, test_minutes: int = 20) -> DataFrame:
    """``split`` of every edge: malicious near a marked event, test a little farther, else train. Needs a unique ``event_id``."""
    inner = near_labelled_times(edges, marked, malicious_minutes).select("event_id", F.lit(True).alias("inner"))
    outer = near_labelled_times(edges, marked, test_minutes).select("event_id", F.lit(True).alias("outer"))
    both = edges.join(outer, "event_id", "left").join(inner, "event_id", "left")
    return both.withColumn("split", F.when(F.col("inner"), "malicious").when(F.col("outer"), "test").otherwise("train")).drop("inner", "outer")
