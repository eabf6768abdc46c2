"""Schemas and fixed values of the provenance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

#: Entity types by number.
ENTITY_TYPES = ("SUBJECT_PROCESS", "MemoryObject", "FILE_OBJECT_BLOCK", "NETFLOW_OBJECT", "PRINCIPAL_REMOTE", "PRINCIPAL_LOCAL", "NetFlowObject")
#: Types that count as resources in lineage.
RESOURCE_TYPES = ("FILE_OBJECT_BLOCK", "NETFLOW_OBJECT", "NetFlowObject", "MemoryObject")
PROCESS_TYPE = "SUBJECT_PROCESS"

#: The prefix of record kinds in CDM18 JSON.
CDM = "com.bbn.tc.schema.avro.cdm18"

BASE_COLUMNS = ("actorID", "actor_type", "objectID", "object", "action", "timestamp")
BASE_EDGE = StructType([StructField(c, StringType()) for c in BASE_COLUMNS])
ENRICHED_EDGE = StructType([*BASE_EDGE.fields, StructField("exec", StringType()), StructField("path", StringType())])

_uuid = StructType([StructField(f"{CDM}.UUID", StringType())])
_text = StructType([StructField("string", StringType())])
CDM_EVENT = StructType([StructField("datum", StructType([StructField(f"{CDM}.Event", StructType([
    StructField("type", StringType()),
    StructField("subject", _uuid),
    StructField("predicateObject", _uuid),
    StructField("predicateObject2", _uuid),
    StructField("timestampNanos", LongType()),
    StructField("properties", StructType([StructField("map", MapType(StringType(), StringType()))])),
    StructField("predicateObjectPath", _text),
    StructField("predicateObject2Path", _text),
]))]))])

_map = StructType([StructField("map", MapType(StringType(), StringType()))])
CDM_NODE = StructType([StructField("datum", StructType([
    StructField(f"{CDM}.NetFlowObject", StructType([StructField(c, StringType()) for c in ("uuid", "localAddress", "localPort", "remoteAddress", "remotePort")])),
    StructField(f"{CDM}.Subject", StructType([StructField("uuid", StringType()), StructField("cmdLine", _text), StructField("properties", _map)])),
    StructField(f"{CDM}.FileObject", StructType([StructField("uuid", StringType()), StructField("filename", StringType()), StructField("baseObject", StructType([StructField("properties", _map)]))])),
]))])


def entity_types(spark: SparkSession) -> DataFrame:
    """The type lookup: ``code``, ``type``."""
    return spark.createDataFrame(list(enumerate(ENTITY_TYPES)), "code int, type string")
