"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word: a run without ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of keys is broadcast; beyond, what it is joined with is shuffled.
BROADCAST_ROWS = 400_000

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, made: list[str]) -> list[str]:
    """The columns of ``df`` that stay beside those that an operator makes; names differ by more than case."""
    taken = {name.lower() for name in made}
    return [name for name in df.columns if name.lower() not in taken]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of a few rows, so that little of a batch stands as Python objects at a time.

    Freed memory goes back to the system, because many tasks may follow in the same Python process.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="provgraph-"), "provgraph_tasks.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "provgraph").rglob("*.py")):
                out.write(path, path.relative_to(root))
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local master uses a temporary
    folder of its own; a cluster must name one, because no other folder is known to be shared."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="provgraph-checkpoints-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A table in the shared folder, and its path. For loops: a checkpoint keeps its plan's size estimate, which joins multiply each round."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """The same without the path, for tables that stay as long as the job's folder."""
    return kept_at(df)[0]


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of a loop that no later table is computed from."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def few(df: DataFrame) -> DataFrame:
    """A table to join with, broadcast if it has been counted to be short. ``df`` must be cheap to read twice."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph given as longs ``a``, ``b``: columns ``node``, ``root`` (the least node reachable).

    Each round takes the least label among the neighbours and then follows the label's own label, so long chains
    shrink by a constant factor per round. Only nodes that have a link appear.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where("a <> b")
    both, both_at = kept_at(links.union(links.select(F.col("b"), F.col("a"))).distinct().toDF("node", "other"))
    labels, labels_at = kept_at(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked, hooked_at = kept_at(labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("low")))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))
        moved, moved_at = kept_at(hooked.join(jump, "low", "left").select("node", F.coalesce(F.least("low", "far"), "low").alias("root"), (F.col("root") != F.coalesce(F.least("low", "far"), "low")).alias("moved")))
        removed(spark, labels_at, hooked_at)
        labels, labels_at = moved.select("node", "root"), moved_at
        if moved.where("moved").isEmpty():
            removed(spark, both_at)
            return labels
