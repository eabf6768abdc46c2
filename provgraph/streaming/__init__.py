"""Structured Streaming forms: time snapshots, node-budget snapshots, decaying histograms, scoring."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provgraph.cluster import checkpointed, remove_paths, ship_package, small
from provgraph.operators.quantiles import ACCURACY, bucket_counts, bucket_quantile, merged_counts
from provgraph.operators.snapshots import CUT_COLUMNS, CUT_SCHEMA, NodeBudget

from .labels import PersistentLabels


def stream_time_snapshots(edges: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """One row for each window and ordered pair with its distinct actions; append mode, late rows beyond the watermark go.

    ``edges``: ``ts`` (timestamp), ``src``, ``dst``, ``action``.
    """
    grouped = edges.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "src", "dst")
    return grouped.agg(F.sort_array(F.collect_set("action")).alias("actions"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "src", "dst", "actions", "n")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NodeBudgetProcessor(StatefulProcessor):
    """The live graph of one scene in keyed state: a map of nodes, a map of edges, and one row for the rest.

    Only what a batch changes is written; forgotten nodes and their edges are removed, so the state has at most ``budget * (1 + rate)`` nodes and the edges
    among them. Mentions leave with each cut and are summed by ``with_frequencies`` from the table of cuts.
    """

    def __init__(self, budget: int, rate: float) -> None:
        self.budget, self.rate = budget, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "name string", "us long, place long, touched long")
        self.edges = handle.getMapState("edges", "src string, dst string", "known boolean")
        self.rest = handle.getValueState("rest", "number long, until long, places long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        live, places = NodeBudget(self.budget, self.rate), 0
        held = {k[0]: tuple(v) for k, v in self.nodes.iterator()}
        live.seen = {name: us for name, (us, _, _) in sorted(held.items(), key=lambda x: x[1][1])}
        live.touched = {name: n for name, (_, _, n) in held.items() if n}
        linked = {tuple(k) for k in self.edges.keys()}
        for src, dst in linked:
            live.link(src, dst)
        if self.rest.exists():
            live.number, live.until, places = self.rest.get()
        out, place = [], {name: v[1] for name, v in held.items()}
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for src, dst, us in zip(batch["src"], batch["dst"], batch["us"]):
            for name in (src, dst):
                if name not in live.seen:
                    place[name] = places = places + 1
            cut = live.add(src, dst, int(us))
            if cut is not None:
                out.append((key[0], *cut))
        now = {name: (us, place[name], live.touched.get(name, 0)) for name, us in live.seen.items()}
        for name in held.keys() - now.keys():
            self.nodes.removeKey((name,))
        for name, value in now.items():
            if held.get(name) != value:
                self.nodes.updateValue((name,), value)
        edges = live.live_edges()
        for edge in linked - edges:
            self.edges.removeKey(edge)
        for edge in edges - linked:
            self.edges.updateValue(edge, (True,))
        self.rest.update((live.number, live.until, places))
        yield pd.DataFrame(out, columns=CUT_COLUMNS)

    def close(self) -> None:
        pass


def stream_node_budget(edges: DataFrame, budget: int = 300, rate: float = 0.3) -> DataFrame:
    """Node-budget cuts of a stream (``CUT_SCHEMA``; ``snapshots.with_frequencies`` makes snapshots of a table of them).

    ``edges``: ``scene``, ``src``, ``dst``, ``us``, ``event_id``; rows of a batch go in time order, and a batch's rows of one scene meet in one task, so
    the source should bound a batch. The last state is not cut, because a stream has no end. The session's state store becomes RocksDB, which maps in state need.
    """
    ship_package(edges.sparkSession)
    edges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = edges.select("scene", "src", "dst", "us", "event_id").groupBy("scene")
    return keyed.transformWithStateInPandas(NodeBudgetProcessor(budget, rate), CUT_SCHEMA, "Append", "None")


def stream_scores(vectors: DataFrame, lags: int = 12, threshold: float = 0.016, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score each new vector against the mean of the ``lags`` before it, which are kept in state for each scene.

    ``vectors``: ``scene``, ``seq``, ``vec``, and the columns ``keep``, which go along. Vectors of a batch go in order of ``seq``; missing ones count as zero.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        past = pickle.loads(state.get[0]) if state.exists else []
        errors = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for vec in rows["vec"]:
            x = np.asarray(vec, float)
            pred = np.sum(past, axis=0) / lags if past else x
            errors.append(float(((pred - x) ** 2).mean()))
            past = [*past, x][-lags:]
        state.update((pickle.dumps(past),))
        yield rows[["scene", "seq"]].assign(error=errors, flag=[int(e > threshold) for e in errors], **{c: rows[c] for c in keep})

    kept = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    keyed = vectors.select("scene", "seq", "vec", *keep).groupBy("scene")
    return keyed.applyInPandasWithState(step, f"scene string, seq long, error double, flag int{kept}", "state binary", "append", GroupStateTimeout.NoTimeout)


class BenignThreshold:
    """A ``foreachBatch`` sink that flags errors beyond the quantile of the benign errors seen before, scene by scene.

    Batches carry ``scene``, ``seq``, ``error`` and ``truth``. Bucket counts of benign errors are kept in versioned Parquet tables under ``path``, and each
    batch's rows with ``threshold`` and ``flag`` under ``path/flags``; a scene without benign errors so far has the fixed threshold. A batch that is run again
    writes the same tables from the same predecessor, so a restart changes nothing; counts before that go.
    """

    def __init__(self, path: str, share: float = 0.99, fixed: float = 0.016, accuracy: float = ACCURACY) -> None:
        self.path, self.share, self.fixed, self.accuracy = path, share, fixed, accuracy

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = checkpointed(batch.select("scene", "seq", "error", "truth"))
        fresh = bucket_counts(batch.where("truth = 0"), ["scene"], "error", self.accuracy)
        known = batch.withColumn("threshold", F.lit(None).cast("double"))
        if batch_id > 0:
            known = batch.join(small(self.threshold(spark, batch_id - 1)), "scene", "left")
            fresh = merged_counts(fresh, self.counts(spark, batch_id - 1))
        flagged = known.withColumn("threshold", F.coalesce("threshold", F.lit(self.fixed))).withColumn("flag", (F.col("error") > F.col("threshold")).cast("int"))
        flagged.write.mode("overwrite").parquet(f"{self.path}/flags/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        remove_paths(spark, f"{self.path}/version={batch_id - 2}")

    def counts(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={version}").select("scene", "bucket", "n")

    def threshold(self, spark: SparkSession, version: int) -> DataFrame:
        """``scene``, ``threshold`` from all benign errors up to a batch."""
        return bucket_quantile(self.counts(spark, version), ["scene"], self.share, self.accuracy)

    def flags(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/flags").select("scene", "seq", "error", "truth", "threshold", "flag")


class DecayingHistogram:
    """A ``foreachBatch`` sink that keeps a decayed histogram of labels in versioned Parquet tables under ``path``.

    Batches carry ``label``, ``t`` (a time in any unit); weights are kept as of the latest time seen. A batch that is run
    again writes the same version from the same predecessor, so a restart changes nothing; versions before that go.
    """

    def __init__(self, path: str, rate: float, least: float = 1e-12) -> None:
        self.path, self.rate, self.least = path, rate, least

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("label", F.col("t").cast("double").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        if batch_id > 0:
            fresh = fresh.unionByName(self.read(spark, batch_id - 1))
        now = fresh.agg(F.max("t").alias("now"))
        decayed = fresh.crossJoin(F.broadcast(now)).groupBy("label", F.col("now").alias("t")).agg(F.sum(F.col("weight") * F.exp((F.col("t") - F.col("now")) * self.rate)).alias("weight"))
        decayed.where(F.col("weight") >= self.least).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        remove_paths(spark, f"{self.path}/version={batch_id - 2}")

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={version}").select("label", "t", "weight")


class LabelHistogram:
    """A ``foreachBatch`` sink: each batch's edges renew the labels near them, and every new label counts in a decayed histogram.

    ``edges``: ``src``, ``dst``, ``action``, ``t``; a batch's labels count at its latest ``t``.
    """

    def __init__(self, labels: PersistentLabels, histogram: DecayingHistogram) -> None:
        self.labels, self.histogram = labels, histogram

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        updates = self.labels.step(batch, batch_id)
        self.histogram(updates.crossJoin(F.broadcast(batch.agg(F.max("t").alias("t")))).select("label", "t"), batch_id)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, into Parquet files under ``path``, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
