"""Weisfeiler-Lehman labels that persist over snapshots, in versioned tables that a stream's batches are joined with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, path_exists, remove_paths, small
from provgraph.functions import hash60

#: Versions between two full tables; a read takes one full table and at most so many changes.
COMPACT = 16
SCHEMAS = {"near": "src string, dst string, action string", "names": "name string", "labels": "name string, label string, version int"}


def both_ways(edges: DataFrame) -> DataFrame:
    """Typed neighbours in both directions of distinct edges (``src``, ``dst``, ``action``), as ``wl.typed_neighbours`` has them; edges with a null end join nothing and go.

    Rows of both directions are the same only where an action itself begins with ``rev_``, so they are compared with those alone.
    """
    edges = edges.where("src is not null and dst is not null")
    ahead = edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), F.col("action").alias("type"))
    back = edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), F.concat(F.lit("rev_"), "action").alias("type"))
    return ahead.union(back.join(small(ahead.where(F.col("type").startswith("rev_"))), ["name", "other", "type"], "left_anti"))


def rows_of(near: DataFrame, names: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of ``near`` with a name in ``names``, and whether that is every row. ``known`` holds all names, ``names`` some of them, each once; where most are meant, rows are found by the others."""
    n, total = names.count(), known.count()
    if n == total:
        return near, True
    if 2 * n > total:
        return near.join(small(checkpointed(known.join(names, "name", "left_anti"))), "name", "left_anti"), False
    return near.join(small(names), "name", "left_semi"), False


class PersistentLabels:
    """Labels of a growing graph: a ``foreachBatch`` sink, or called once for each snapshot with ``step``.

    Each batch adds its distinct edges to those before it, which are read as typed neighbours in both directions. Then ``rounds`` synchronous rounds run: the first takes
    the ends of the batch's edges, each further one the neighbours of those before it; a new label is the hash of the
    node's label XOR the hashes of (type, neighbour's label). Labels stay for later batches. A node's first label is
    its ``label`` in ``first`` (``name``, ``label``), else its name.

    ``path`` holds, by version, only what a batch added: ``near`` (new edges), ``names`` (new ends), ``labels`` (changed ones) and ``updates`` (``round``, ``name``, ``label``).
    Every ``COMPACT`` versions the first three are written in full and older changes go. A batch reads one
    full table and the changes since, by folder, so its plan is the same size at any version, and only labels
    within ``rounds`` steps of its edges take part. A batch that runs again writes the same version from the same predecessors.
    """

    def __init__(self, path: str, rounds: int = 3, first: DataFrame | None = None) -> None:
        self.path, self.rounds, self.first = path, rounds, first

    def held(self, spark: SparkSession, table: str, version: int) -> DataFrame:
        """A table as it was after ``version``: the last full one before it and the changes up to it."""
        base = version // COMPACT * COMPACT
        folders = [f"{self.path}/{table}_full/version={base}"] + [f"{self.path}/{table}/version={v}" for v in range(base + 1, version + 1)]
        found = [f for f in folders if version >= 0 and path_exists(spark, f)]
        rows = spark.read.schema(SCHEMAS[table]).parquet(*found) if found else spark.createDataFrame([], SCHEMAS[table])
        return rows if table != "labels" else rows.groupBy("name").agg(F.max_by("label", "version").alias("label"))

    def step(self, edges: DataFrame, version: int) -> DataFrame:
        """One batch of edges (``src``, ``dst``, ``action``); returns its updates."""
        spark = edges.sparkSession
        fresh = checkpointed(edges.select("src", "dst", "action").distinct())
        ends = checkpointed(fresh.select(F.explode(F.array("src", "dst")).alias("name")).where("name is not null").distinct())
        near, known = both_ways(self.added("near", fresh, version)), self.added("names", ends, version)
        # neighbours stand in both directions, so each frontier holds the one before it; the last one's neighbours are the nodes that any round reads
        reach, seen = [ends], []
        for _ in range(self.rounds):
            rows, whole = rows_of(near, reach[-1], known)
            seen.append(rows)
            reach.append(known if whole else checkpointed(reach[-1].union(rows.select(F.col("other").alias("name"))).distinct()))
        start = reach[-1].join(self.held(spark, "labels", version - 1), "name", "left")
        if self.first is not None:
            start = start.join(self.first.select("name", F.col("label").alias("own")), "name", "left").withColumn("label", F.coalesce("label", "own"))
        state = checkpointed(start.select("name", F.coalesce("label", "name").alias("label"), F.lit(0).alias("round")))
        for r in range(1, self.rounds + 1):
            # a part of the state is short beside the rows that meet it, which need not be sorted then
            met = seen[r - 1].join(state.select(F.col("name").alias("other"), F.col("label").alias("seen")).hint("shuffle_hash"), "other")
            mixed = met.groupBy("name").agg(F.bit_xor(hash60(F.concat("type", F.lit("|"), "seen"))).alias("mix"))
            put(state.select("name", "label").join(mixed, "name").select("name", hash60(F.col("label")).bitwiseXOR(F.col("mix")).cast("string").alias("label")), f"{self.path}/updates/version={version}/round={r}")
            now = spark.read.schema("name string, label string").parquet(f"{self.path}/updates/version={version}/round={r}")
            changed = state.join(now.withColumnRenamed("label", "new"), "name", "left")
            state = changed.select("name", F.coalesce("new", "label").alias("label"), F.when(F.col("new").isNotNull(), r).otherwise(F.col("round")).alias("round"))
            state = checkpointed(state) if r < self.rounds else state
        put(state.where("round > 0").select("name", "label", F.lit(version).alias("version")), f"{self.path}/labels/version={version}")
        self.compact(spark, version)
        return self.updates(spark, version)

    def added(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        """A table with those of ``rows`` that it did not hold, which are written as its ``version``."""
        spark, path = rows.sparkSession, f"{self.path}/{table}/version={version}"
        old = self.held(spark, table, version - 1)
        put(rows.join(old, rows.columns, "left_anti"), path)
        return old.union(spark.read.schema(SCHEMAS[table]).parquet(path))

    def compact(self, spark: SparkSession, version: int) -> None:
        """Full tables at multiples of ``COMPACT``; what no run of this version or a later one reads goes."""
        if version % COMPACT:
            return
        for table in SCHEMAS:
            fresh = spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}/version={version}")
            old = self.held(spark, table, version - 1)
            full = old.union(fresh) if table != "labels" else old.join(fresh, "name", "left_anti").withColumn("version", F.lit(version)).union(fresh)
            put(full, f"{self.path}/{table}_full/version={version}")
            before = version - COMPACT
            remove_paths(spark, f"{self.path}/{table}_full/version={before - COMPACT}", *(f"{self.path}/{table}/version={v}" for v in range(before - COMPACT, before + 1)))

    def updates(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """``version``, ``round``, ``name``, ``label`` of one version or of all."""
        rows = spark.read.schema("name string, label string, version int, round int").option("basePath", f"{self.path}/updates").parquet(f"{self.path}/updates" + ("" if version is None else f"/version={version}"))
        return rows.select("version", "round", "name", "label")

    def labels(self, spark: SparkSession, version: int) -> DataFrame:
        return self.held(spark, "labels", version)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.step(batch, batch_id)


def put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
