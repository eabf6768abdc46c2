"""Checkpoints in the folder that driver and executors share, and iteration built on them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``. Where that is unset, a local master uses a temporary folder of its own; a cluster must name one,
    because no other folder is known to be shared."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="provgraph-checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. (``checkpoint()`` would keep the plan's size estimate, which the
    joins of a loop multiply each round.)"""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, *old: DataFrame) -> DataFrame:
    """``checkpointed``, after which the tables ``old``, whole checkpoints that nothing else reads any more, are deleted."""
    new = checkpointed(df)
    gone = {file.rsplit("/", 1)[0] for table in old for file in table.inputFiles()}
    remove_paths(df.sparkSession, *gone)
    return new


#: Rows up to which a table is broadcast; beyond, what it is joined with is shuffled.
BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """A table to join with, broadcast if it has been counted to be short. ``df`` must be cheap to read twice."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python tasks can import it anywhere."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped:
        return
    if root.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="provgraph-"), "provgraph_library.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "provgraph").rglob("*.py")):
                out.write(path, path.relative_to(root))
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def remove_paths(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing is computed from any more; absent ones are passed over."""
    for path in paths:
        place, system = _place(spark, path)
        system.delete(place, True)


def connected_components(links: DataFrame, merged: bool = False) -> DataFrame:
    """``node``, ``root`` (the least reachable node) of an undirected graph ``a``, ``b`` of any ordered type.

    Labels take the least among the neighbours and then jump to their label's label, so rounds grow with the logarithm of a
    component's width. Nodes stand only in links; a self-link makes a lone node. ``merged``: labels are joined by a shuffle at any size, never broadcast.
    """
    joined = lambda df: df.hint("merge") if merged else df
    links = links.select("a", "b")
    both = checkpointed(links.union(links.select("b", "a")).distinct().toDF("node", "other"))
    labels = checkpointed(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(joined(labels.toDF("other", "seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = labels.join(joined(near), "node").select("node", "root", F.least("root", "seen").alias("low"))
        hooked = checkpointed(hooked)
        far = F.coalesce(F.least("low", "far"), "low")
        moved = checkpointed(hooked.join(joined(hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))), "low", "left").select("node", far.alias("root"), (F.col("root") != far).alias("moved")))
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels


#: Characters of a text by which it goes to a range; the bounds of ranges are sampled to the driver, so they must be short.
PREFIX = 200


def dense_ids(rows: DataFrame, column: str, id_col: str) -> DataFrame:
    """Number distinct values from 0 in order: sorted ranges get numbers inside and an offset each, so no task sorts all.

    Texts go to ranges by their first ``PREFIX`` characters, so that texts with the same beginning are sorted in one task.
    """
    distinct = rows.select(column).distinct()
    bound = F.substring(column, 1, PREFIX) if distinct.schema[column].dataType.typeName() == "string" else F.col(column)
    ranged = distinct.repartitionByRange(bound).select(column, F.spark_partition_id().alias("range"))
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range").select(column, (F.col("before") + F.col("inside")).cast("long").alias(id_col))
