"""Training and evaluation as jobs over a snapshot store: describe, embed, fit on benign snapshots, score the others, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import checkpointed, dense_ids, small
from .operators import detect, embed, graph, report, wl
from .operators.store import SnapshotStore
from .registry import DETECTORS, Autoregression, create

KEYS = ["snapshot_id"]


def stable_id(*parts: str) -> Column:
    """A snapshot's name in a store: category, further parts and number, which sorts as the sequence of a category does and does not change when others come."""
    *names, number = parts
    return F.concat_ws("/", "category", *names, F.lpad(F.col(number).cast("string"), 12, "0"))


def store_snapshots(store: SnapshotStore, snapshots: DataFrame, properties: DataFrame, labels: DataFrame) -> None:
    """Vertices and edges of the snapshots that the store lacks. ``snapshots``: edges with ``category``, ``snapshot_id`` and ``scene`` if there are several."""
    named = snapshots.withColumn("snapshot_id", stable_id(*[c for c in ("scene",) if c in snapshots.columns], "snapshot_id"))
    store.append(graph.vertices(named, properties, labels, KEYS), graph.edge_actions(named, KEYS))


def lacking(store: SnapshotStore, table: str, held: DataFrame | None) -> DataFrame:
    rows = store.table(table)
    return rows if held is None else rows.join(small(held.select(*KEYS)), KEYS, "left_anti")


def subgraph_counts(store: SnapshotStore, depth: int, held: DataFrame | None = None) -> DataFrame:
    """``snapshot_id``, ``rsg``, ``cnt`` of stored snapshots, without those in ``held``; a hub's neighbourhood goes by digest."""
    vertices, pairs = lacking(store, "vertices", held), lacking(store, "edges", held)
    return checkpointed(wl.rsg_counts(wl.rooted_subgraphs(vertices, pairs, KEYS, depth, hashed=True), vertices, KEYS))


def series(vectors: DataFrame, category: str) -> DataFrame:
    """The sequence of one category: ``snapshot_id``, ``seq``, ``vec``."""
    return detect.sequence(vectors.where(F.col("snapshot_id").startswith(f"{category}/")), "snapshot_id", "vec")


def train(spark: SparkSession, snapshots: DataFrame, properties: DataFrame, labels: DataFrame, path: str, *, depth: int = 2, dim: int = 256, rounds: int = 10, buckets: int = 200, detector: Autoregression | None = None) -> Autoregression:
    """Store the snapshots, learn vectors of them and of their rooted subgraphs, fit the detector on the benign ones, and save all under ``path``."""
    store = SnapshotStore(spark, f"{path}/store", buckets)
    store_snapshots(store, snapshots, properties, labels)
    counts = subgraph_counts(store, depth)
    numbers, vocabulary = checkpointed(dense_ids(counts, "snapshot_id", "seq")), checkpointed(dense_ids(counts, "rsg", "rsg_id"))
    vectors, features = embed.shared_factors(checkpointed(counts.join(small(numbers), "snapshot_id").join(vocabulary, "rsg").select("seq", "rsg_id", "cnt")), dim, rounds)
    store.keep_vectors(vectors.join(numbers, "seq"), features.join(vocabulary, "rsg_id"))
    spark.createDataFrame([(depth,)], "depth int").write.mode("overwrite").parquet(f"{path}/settings")
    detector = detector or create(DETECTORS, "autoregression", quantile=0.99)
    detector.train(checkpointed(series(store.vectors(), "benign")))
    detector.save(f"{path}/detector")
    detector.load(spark, f"{path}/detector")
    return detector


@dataclass
class Evaluation:
    """Scores (``snapshot_id``, ``seq``, ``error``, ``flag``, ``truth``, ``class``), their counts and figures, and the reports by class."""

    scored: DataFrame
    confusion: DataFrame
    metrics: DataFrame
    nodes: DataFrame
    labelled: DataFrame
    suspicious: DataFrame
    missed: DataFrame

    def write(self, path: str) -> None:
        for name in ("scored", "confusion", "metrics", "labelled", "suspicious", "missed"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        report.write_report(self.nodes, f"{path}/nodes")


def evaluate(spark: SparkSession, snapshots: DataFrame, properties: DataFrame, labels: DataFrame, path: str, category: str = "malicious", detector: str = "autoregression") -> Evaluation:
    """Score all snapshots of a category against what ``train`` left under ``path``.

    Snapshots that the store has not seen join it, and their vectors are folded in; those of others stay. Truth is whether a snapshot holds a labelled vertex.
    """
    store = SnapshotStore(spark, f"{path}/store")
    store_snapshots(store, snapshots, properties, labels)
    vectors = store.vectors(subgraph_counts(store, spark.read.parquet(f"{path}/settings").first().depth, store.vectors()))
    model = create(DETECTORS, detector)
    model.load(spark, f"{path}/detector")
    here = F.col("snapshot_id").startswith(f"{category}/")
    vertices, pairs = store.table("vertices").where(here), store.table("edges").where(here)
    predicted = model.predict(checkpointed(series(vectors, category)))
    classed = report.confusion_class(predicted.select("snapshot_id", "seq", "error", "flag").join(report.snapshot_truth(vertices, KEYS), "snapshot_id"))
    scored = checkpointed(classed)
    counted = report.confusion(scored)
    return Evaluation(
        scored, counted, report.metrics(counted), report.node_report(vertices, pairs, KEYS), report.labelled_nodes(vertices, scored, KEYS, "TP"),
        report.suspicious(vertices, scored, KEYS), report.missed(vertices, scored, KEYS),
    )
