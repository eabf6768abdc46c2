"""The star-schema tables seen as provenance data: enriched edges, property maps, labels, raw log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.schema import CDM

#: Malicious nodes of the events table.
LABELS = ("u13", "k50", "k66", "k99")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit edges with ``exec``, ``path``, ``category``, ``event_id`` and ``us`` (microseconds)."""
    k = F.col("k")
    of_k = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
        .select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actorID"),
            F.lit("SUBJECT_PROCESS").alias("actor_type"),
            F.when(k < 25, of_k("u")).otherwise(of_k("k")).alias("objectID"),
            F.when(k < 25, "SUBJECT_PROCESS").when(k < 50, "FILE_OBJECT_BLOCK").when(k < 75, "NETFLOW_OBJECT").otherwise("MemoryObject").alias("object"),
            F.concat(F.lit("EVENT_"), F.upper("event_type")).alias("action"),
            (F.col("us") * 1000).cast("string").alias("timestamp"),
            F.col("event_type").alias("exec"),
            F.when(k % 2 == 0, of_k("/k/")).otherwise("").alias("path"),
            F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "benign").otherwise("malicious").alias("category"),
            "event_id",
            "us",
        )
    )


def event_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", x) for x in LABELS], "scene string, label string")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_properties(event_edges(spark, sf_dir))


def edge_properties(edges: DataFrame) -> DataFrame:
    """Property maps of the events' nodes: ``kind``, ``node_id``, ``property``, ``load_order``."""
    nodes = edges.select("objectID", "object").distinct()
    number = F.substring("objectID", 2, 9).cast("int")
    kind = F.when(F.col("object") == "NETFLOW_OBJECT", "netflow").when(F.col("object") == "FILE_OBJECT_BLOCK", "file").when(F.col("object") == "SUBJECT_PROCESS", "subject")
    text = F.when(kind == "netflow", F.concat(F.lit("10.0.0."), number, F.lit(",80,1.1.1."), number, F.lit(",443"))).when(kind == "file", F.concat(F.lit("/data/"), number)).otherwise(F.concat(F.lit("cmd "), number, F.lit(","), number, F.lit(",null")))
    return nodes.where(kind.isNotNull() & (number % 3 != 0)).select(kind.alias("kind"), F.col("objectID").alias("node_id"), text.alias("property"), F.lit(0).alias("load_order"))


def cdm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDM18 JSON lines written from the events: node records, event records and lines that readers must skip.

    ``value``, ``file``, ``line``. Every tenth event has a second object; every seventh has neither path nor command.
    """
    q = lambda s: F.lit(s)
    e = event_edges(spark, sf_dir)
    second = F.col("event_id") % 10 == 0
    bare = F.col("event_id") % 7 == 0
    uuid = lambda c: F.concat(q(f'{{"{CDM}.UUID":"'), c, q('"}'))
    event = F.concat(
        q(f'{{"datum":{{"{CDM}.Event":{{"type":"'), F.col("action"), q('","subject":'), uuid(F.col("actorID")),
        q(',"predicateObject":'), uuid(F.col("objectID")),
        F.when(second, F.concat(q(',"predicateObject2":'), uuid(F.concat(q("second-"), F.col("objectID"))), q(',"predicateObject2Path":{"string":"/second"}'))).otherwise(""),
        q(',"timestampNanos":'), F.col("timestamp"),
        F.when(bare, "").otherwise(F.concat(q(',"properties":{"map":{"cmdLine":"'), F.col("exec"), q('"}},"predicateObjectPath":{"string":"'), F.col("path"), q('"}'))),
        q("}}}"),
    )
    props = event_properties(spark, sf_dir)
    part = lambda i: F.split("property", ",")[i]
    node = (
        F.when(F.col("kind") == "netflow", F.concat(q(f'{{"datum":{{"{CDM}.NetFlowObject":{{"uuid":"'), F.col("node_id"), q('","x":1,"localAddress":"'), part(0), q('","localPort":'), part(1), q(',"remoteAddress":"'), part(2), q('","remotePort":'), part(3), q(',"y":2}}}')))
        .when(F.col("kind") == "subject", F.concat(q(f'{{"datum":{{"{CDM}.Subject":{{"uuid":"'), F.col("node_id"), q('","cmdLine":{"string":"'), part(0), q('"},"properties":{"map":{"tgid":"'), part(1), q('"}}}}}')))
        .otherwise(F.concat(q(f'{{"datum":{{"{CDM}.FileObject":{{"uuid":"'), F.col("node_id"), q('","baseObject":{},"filename":"'), F.col("property"), q('"}}}')))
    )
    file = F.concat(q("events-"), (F.col("event_id") % 4).cast("string"), q(".json"))
    lines = e.select(event.alias("value"), file.alias("file"), F.floor(F.col("event_id") / 4).alias("line"))
    broken = e.where("event_id % 50 = 0").select(F.concat(q('{"EVENT'), F.col("action")).alias("value"), file.alias("file"), F.lit(-1).cast("long").alias("line"))
    nodes = props.select(node.alias("value"), q("nodes.json").alias("file"), F.substring("node_id", 2, 9).cast("long").alias("line"))
    return lines.unionByName(broken).unionByName(nodes)


def dot_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a DOT graph written from the events, as a reader split at semicolons gives them: ``value``."""
    q = lambda s: F.lit(s)
    e = event_edges(spark, sf_dir)
    number = F.substring("objectID", 2, 9).cast("int")
    kind = (
        F.when(F.col("object") == "SUBJECT_PROCESS", "process").when(F.col("object") == "FILE_OBJECT_BLOCK", "file").when(number % 5 == 0, "web_object")
        .when(number % 5 == 1, "domain_name").when(number % 5 == 2, "IP_Address").when(number % 5 == 3, "connection").otherwise("session")
    )
    declared = e.where((F.col("object") != "MemoryObject")).select("objectID", kind.alias("kind")).distinct()
    nodes = declared.select(F.concat(q('\n"'), F.col("objectID"), q('" [label="x",\n type="'), F.col("kind"), q('"]')).alias("value"))
    edges = e.select(F.concat(q('\n"'), F.col("actorID"), q('" -> "'), F.col("objectID"), q('" [capacity=1, key=0,\n type="'), F.lower("exec"), q('" timestamp='), F.col("event_id").cast("string"), q("]")).alias("value"))
    return nodes.union(edges)
