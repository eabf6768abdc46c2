"""A store of snapshots that is joined without a shuffle and grows: bucketed tables, and vectors that stay when snapshots come."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, dense_ids, path_exists, small

from . import embed

#: The node by which each table goes to its bucket, beside the snapshot.
NODE = {"vertices": "name", "edges": "src"}


class SnapshotStore:
    """Vertices, edges and vectors of snapshots as Parquet under ``path``.

    Vertices are bucketed and sorted by snapshot and node, edges by snapshot and source, so a snapshot of any size is spread over the buckets and a join of
    the two on these columns, or an aggregation by them, needs no exchange. The number of buckets is fixed at the first write (about the size of the largest
    store wanted over 256 MB). A snapshot that is stored stays as it is: ``append`` takes the others, table by table, so one that was cut off is run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200) -> None:
        self.spark, self.path = spark, path
        if path_exists(spark, f"{path}/settings"):
            self.buckets = spark.read.parquet(f"{path}/settings").first().buckets
        else:
            self.buckets = buckets
            spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/settings")

    def append(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Store the snapshots (``snapshot_id``) that are not there yet, an edge table and a vertex table each with any further columns."""
        for table, rows in (("vertices", vertices), ("edges", edges)):
            self._add(table, rows)

    def _add(self, table: str, rows: DataFrame) -> None:
        keys = ["snapshot_id", NODE[table]]
        if path_exists(self.spark, f"{self.path}/{table}/_SUCCESS"):
            held = self.spark.read.parquet(f"{self.path}/{table}")
            rows = rows.join(small(checkpointed(held.select("snapshot_id").distinct())), "snapshot_id", "left_anti").select(*held.columns)
            with self._registered(table, held) as name:
                rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).mode("append").format("parquet").saveAsTable(name)
            return
        name = f"store_{uuid.uuid4().hex}"
        try:
            rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{table}").format("parquet").mode("overwrite").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _register(self, table: str, rows: DataFrame) -> str:
        """A catalogue entry that knows the buckets; the files stay when it goes."""
        name, keys = f"store_{uuid.uuid4().hex}", f"snapshot_id, {NODE[table]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        return name

    @contextmanager
    def _registered(self, table: str, rows: DataFrame) -> Iterator[str]:
        name = self._register(table, rows)
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, table: str) -> DataFrame:
        """``vertices`` or ``edges`` with their buckets, as of now; the entry lives as long as the session."""
        return self.spark.table(self._register(table, self.spark.read.parquet(f"{self.path}/{table}")))

    def keep_vectors(self, vectors: DataFrame, features: DataFrame) -> None:
        """Store trained vectors: of snapshots (``snapshot_id``, ``vec``), and of features by their text (``rsg``, ``vec``)."""
        vectors.select("snapshot_id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(f"{self.path}/vectors")
        features.select("rsg", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(f"{self.path}/features")

    def vectors(self, counts: DataFrame | None = None) -> DataFrame:
        """``snapshot_id``, ``vec`` of the stored snapshots, and of those in ``counts`` (``snapshot_id``, ``rsg``, ``cnt``) that have none yet.

        A stored vector is never changed. A new snapshot's is the weighted mean of the vectors of its features, by their text, so it needs no training and the numbers
        of a vocabulary may differ; features without a vector do not count, and a snapshot with no other has the zero vector. New vectors are stored.
        """
        held = self.spark.read.parquet(f"{self.path}/vectors")
        if counts is None:
            return held
        fresh = checkpointed(counts.join(small(held.select("snapshot_id")), "snapshot_id", "left_anti").select("snapshot_id", "rsg", "cnt"))
        if fresh.isEmpty():
            return held
        features = self.spark.read.parquet(f"{self.path}/features")
        numbered = checkpointed(dense_ids(fresh, "rsg", "rsg_id"))
        known = numbered.join(features, "rsg").select("rsg_id", "vec")
        folded = embed.fold_in(fresh.join(numbered, "rsg").withColumnRenamed("snapshot_id", "seq"), known).withColumnRenamed("seq", "snapshot_id")
        size = F.broadcast(features.select(F.size("vec").alias("size")).limit(1))
        zero = F.array_repeat(F.lit(0.0).cast("float"), F.col("size"))
        every = fresh.select("snapshot_id").distinct().join(folded, "snapshot_id", "left").crossJoin(size).select("snapshot_id", F.coalesce("vec", zero).alias("vec"))
        every.write.mode("append").parquet(f"{self.path}/vectors")
        return self.spark.read.parquet(f"{self.path}/vectors")
