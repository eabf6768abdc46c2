"""CDM18 JSON logs: discovery, node and event extraction, base edge files, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provgraph.functions import ns_to_micros
from provgraph.schema import BASE_COLUMNS, BASE_EDGE, CDM, CDM_EVENT, CDM_NODE


def read_lines(spark: SparkSession, base: str, glob: str = "*.json") -> DataFrame:
    """Lines of all matching files under ``base``: ``value``, ``file``, ``block``, ``row``, ``scene``, ``category``.

    Layout: base/scene/{benign,malicious}/file; resource-fork files (``._*``) are left out. ``block`` and ``row`` give the
    order within a file.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(base)
    place = F.col("_metadata.file_path")
    return (
        found.select("value", place.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_size").alias("file_size"))
        .withColumn("scene", F.regexp_extract("file", r"([^/]+)/(benign|malicious)/[^/]+$", 1))
        .withColumn("category", F.regexp_extract("file", r"/(benign|malicious)/[^/]+$", 1))
        .where(~F.col("file").rlike(r"/\._[^/]*$"))
    )


def read_files(spark: SparkSession, base: str, glob: str = "*.json") -> DataFrame:
    """``file``, ``file_size``, ``scene``, ``category`` of the same files, without reading what is in them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    return (
        found.select(F.col("path").alias("file"), F.col("length").alias("file_size"))
        .withColumn("scene", F.regexp_extract("file", r"([^/]+)/(benign|malicious)/[^/]+$", 1))
        .withColumn("category", F.regexp_extract("file", r"/(benign|malicious)/[^/]+$", 1))
        .where(~F.col("file").rlike(r"/\._[^/]*$"))
    )


def discover(spark: SparkSession, base: str, glob: str = "*.json") -> DataFrame:
    """Files of each scene and category."""
    return read_files(spark, base, glob).where("category <> ''").select("scene", "category", "file")


def loaded_bytes(lines: DataFrame) -> DataFrame:
    """Bytes of the files (of ``read_files``, or of lines that were read), each counted once."""
    return lines.select("file", "file_size").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("loaded_bytes"))


def clean_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """Labels, one on a line: trimmed, without blanks and repeats."""
    return lines.select(F.trim(value).alias("label")).where("label <> ''").distinct()


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """``scene``, ``label`` from base/scene/malicious/*.txt; of several files the last by name counts."""
    lines = read_lines(spark, base, "*.txt").where("category = 'malicious'")
    last = lines.groupBy("scene").agg(F.max("file").alias("file"))
    return lines.join(F.broadcast(last), ["scene", "file"]).select("scene", F.trim("value").alias("label")).where("label <> ''").distinct()


def parse_base_edges(lines: DataFrame, value: str = "value") -> DataFrame:
    """Six tab-separated strings; short rows go."""
    cells = F.split(value, "\t")
    return lines.where(F.size(cells) >= len(BASE_COLUMNS)).select(*(cells[i].alias(c) for i, c in enumerate(BASE_COLUMNS)))


def read_base_edges(spark: SparkSession, path: str) -> DataFrame:
    """A base edge file, unsorted; sort where the order matters. Rows with a missing field go."""
    return spark.read.csv(path, sep="\t", schema=BASE_EDGE, mode="DROPMALFORMED", quote="").na.drop()


def extract_nodes(lines: DataFrame) -> DataFrame:
    """Properties of nodes from raw lines (``value``, ``file``, ``line``): ``kind``, ``node_id``, ``property``.

    A network end gives its two addresses and ports, a subject its command, thread group (which must come first in its map)
    and path (``null`` if absent), a file its name. A later line overrides an earlier one for the same node. Records that
    lack one of these fields, and lines that are no record, are skipped.
    """
    datum = F.from_json("value", CDM_NODE)["datum"]
    one_of = F.col("value").contains(f'"{CDM}.NetFlowObject"') | F.col("value").contains(f'"{CDM}.Subject"') | F.col("value").contains(f'"{CDM}.FileObject"')
    read = lines.where(one_of).select("file", "line", *(datum[f"{CDM}.{kind}"].alias(name) for kind, name in (("NetFlowObject", "net"), ("Subject", "sub"), ("FileObject", "fil"))))
    net, sub, fil = F.col("net"), F.col("sub"), F.col("fil")
    more = sub["properties"]["map"]
    first_is_group = F.element_at(F.map_keys(more), 1) == "tgid"
    texts = (
        ("netflow", net["uuid"], F.concat(*(x for c in ("localAddress", "localPort", "remoteAddress", "remotePort") for x in (net[c], F.lit(","))[: 1 if c == "remotePort" else 2]))),
        ("subject", sub["uuid"], F.when(first_is_group, F.concat(sub["cmdLine"]["string"], F.lit(","), more["tgid"], F.lit(","), F.coalesce(F.nullif(more["path"], F.lit("")), F.lit("null"))))),
        ("file", fil["uuid"], F.coalesce(fil["filename"], fil["baseObject"]["properties"]["map"]["filename"])),
    )
    records = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), node.alias("node_id"), text.alias("property")) for kind, node, text in texts)))
    found = read.select("file", "line", records.alias("r")).select("r.*", "file", "line").where("node_id <> '' and property is not null")
    return found.groupBy("kind", "node_id").agg(F.max_by("property", F.struct("file", "line")).alias("property"))


def read_base_folder(spark: SparkSession, base: str) -> DataFrame:
    """The base edges of all ``scene_category.txt`` files directly in ``base``, with ``scene`` and ``category``."""
    name = r"([^/]+)_(benign|malicious)\.txt$"
    lines = spark.read.option("pathGlobFilter", "*.txt").text(base).withColumn("file", F.col("_metadata.file_path")).where(F.col("file").rlike(name))
    cells = F.split("value", "\t")
    return lines.where(F.size(cells) >= len(BASE_COLUMNS)).select(*(cells[i].alias(c) for i, c in enumerate(BASE_COLUMNS)), F.regexp_extract("file", name, 1).alias("scene"), F.regexp_extract("file", name, 2).alias("category"))


def load_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edge table of a folder: base edges joined with their raw events within each scene and category.

    Besides the columns of both: ``us`` and ``event_id``, a number drawn from the row that orders rows of one time.
    """
    keys = ["scene", "category"]
    events = extract_events(read_lines(spark, base), keys)
    edges = read_base_folder(spark, base).join(events, [*keys, "actorID", "objectID", "action", "timestamp"]).distinct()
    return edges.withColumn("us", ns_to_micros(F.col("timestamp"))).withColumn("event_id", F.xxhash64(*edges.columns))


def load_properties(spark: SparkSession, base: str) -> DataFrame:
    """``kind``, ``node_id``, ``property`` of the nodes in a folder's logs."""
    lines = read_lines(spark, base)
    return extract_nodes(lines.select("value", "file", F.struct("block", "row").alias("line")))


def extract_events(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges from raw event lines: ``actorID, objectID, action, timestamp, exec, path``, all strings, and columns to keep.

    Lines without the word EVENT or without a valid event are skipped; a missing field is an empty string; a second object
    gives an edge of its own.
    """
    event = F.from_json("value", CDM_EVENT)["datum"][f"{CDM}.Event"]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    uuid = lambda c: text(F.col("e")[c][f"{CDM}.UUID"])
    edges = F.array(
        F.struct(uuid("predicateObject2").alias("objectID"), text(F.col("e")["predicateObject2Path"]["string"]).alias("path"), F.lit(True).alias("second")),
        F.struct(uuid("predicateObject").alias("objectID"), text(F.col("e")["predicateObjectPath"]["string"]).alias("path"), F.lit(False).alias("second")),
    )
    return (
        lines.where(F.col("value").contains("EVENT")).select(*(keep or []), event.alias("e")).where("e is not null")
        .select(*(keep or []), "e", F.explode(F.filter(edges, lambda x: ~x["second"] | (x["objectID"] != ""))).alias("o"))
        .select(*(keep or []), uuid("subject").alias("actorID"), "o.objectID", text(F.col("e")["type"]).alias("action"), text(F.col("e")["timestampNanos"]).alias("timestamp"), text(F.col("e")["properties"]["map"]["cmdLine"]).alias("exec"), "o.path")
    )


def first_lines(lines: DataFrame, most: int, order: tuple[str, ...] = ("line",)) -> DataFrame:
    """The first ``most`` lines of each file."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    return lines.withColumn("place", place).where(F.col("place") <= most).drop("place")
