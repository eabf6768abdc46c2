"""Graphs in DOT files: statements, node kinds, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node kinds that name network ends, in order of precedence before the others.
NETWORK_KINDS = ("domain_name", "IP_Address", "connection", "session")
KINDS = (*NETWORK_KINDS, "web_object", "process", "file")
#: A name in quotes, or without them up to an arrow or a bracket.
NAME = r'(?:"([^"]*)"|([^"\[\s](?:[^"\[]*?[^"\[\s])??))'


def read_statements(spark: SparkSession, base: str) -> DataFrame:
    """Statements of the ``*.dot`` files directly in ``base``: ``value``, ``graph``."""
    found = spark.read.option("lineSep", ";").option("pathGlobFilter", "*.dot").text(base)
    return found.select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.dot$", 1).alias("graph"))


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """``graph``, ``label`` from base/*/name.txt, one label on a line."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(base)
    return found.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("graph"), F.trim("value").alias("label")).where("label <> ''").distinct()


def named(pattern: str, group: int) -> Column:
    """A name that a pattern finds in quotes or, as its next group, without."""
    return F.coalesce(F.nullif(F.regexp_extract("value", pattern, group), F.lit("")), F.trim(F.regexp_extract("value", pattern, group + 1)))


def extract_nodes(statements: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Declared nodes: ``node_id``, ``kind``. A node declared in several kinds takes the first in order of precedence.
    ``by`` names columns that tell graphs apart."""
    name = named(rf"^\s*{NAME}\s*\[", 1)
    kind = F.regexp_extract("value", r'(?is)\btype\s*=\s*"?(\w+)"?', 1)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = statements.where(~F.col("value").contains("capacity=")).select(*by, name.alias("node_id"), kind.alias("kind")).where((F.col("node_id") != "") & F.col("kind").isin(*KINDS))
    return found.groupBy(*by, "node_id").agg(F.min_by("kind", order).alias("kind"))


def extract_edges(statements: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges: ``actorID``, ``objectID``, ``action``, ``timestamp`` (long)."""
    ends = rf"^\s*{NAME}\s*->\s*{NAME}\s*\["
    found = statements.where(F.col("value").contains("capacity=")).select(
        *by,
        named(ends, 1).alias("actorID"),
        named(ends, 3).alias("objectID"),
        F.regexp_extract("value", r'(?is)\btype\s*=\s*"?([^"\s,\]]+)"?', 1).alias("action"),
        F.regexp_extract("value", r"(?is)\btimestamp\s*=\s*(\d+)", 1).try_cast("bigint").alias("timestamp"),
    )
    return found.where("actorID <> '' and objectID <> ''")


def kind_type(kind) -> object:
    """Entity type of a node kind; what was not declared is a local principal."""
    return F.when(kind.isin(*NETWORK_KINDS), "NETFLOW_OBJECT").when(kind == "web_object", "NetFlowObject").when(kind == "process", "SUBJECT_PROCESS").when(kind == "file", "FILE_OBJECT_BLOCK").otherwise("PRINCIPAL_LOCAL")


def typed_edges(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with the types of both ends."""
    of = lambda end: nodes.select(*by, F.col("node_id").alias(end), F.col("kind").alias(f"{end}_kind"))
    both = edges.join(of("actorID"), [*by, "actorID"], "left").join(of("objectID"), [*by, "objectID"], "left")
    return both.select(*by, "actorID", kind_type(F.col("actorID_kind")).alias("actor_type"), "objectID", kind_type(F.col("objectID_kind")).alias("object"), "action", "timestamp")


def load_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edge table of all DOT graphs in a folder: ``scene`` is the graph's name, ``us`` the stated time, ``event_id`` a number
    drawn from the row; commands and paths are empty."""
    statements = read_statements(spark, base)
    by = ("graph",)
    edges = typed_edges(extract_edges(statements, by), extract_nodes(statements, by), by).withColumnRenamed("graph", "scene")
    more = edges.withColumn("exec", F.lit("")).withColumn("path", F.lit("")).withColumn("us", F.col("timestamp"))
    return more.withColumn("event_id", F.xxhash64(*edges.columns))
