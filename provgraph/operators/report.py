"""Evaluation reports over snapshots: truth, classes, histograms, suspicious patterns, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions import safe_ratio
from provgraph.schema import PROCESS_TYPE

from . import graph

#: Words in a process's name that make it look suspicious.
SUSPICIOUS_NAMES = "system|admin|service|daemon"


def snapshot_truth(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """1 if any vertex is labelled."""
    return vertices.groupBy(*keys).agg(F.max("label").alias("truth"))


def snapshot_summary(vertices: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes, labelled vertices and processes of each snapshot."""
    v = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vertices"), F.sum(F.col("label").cast("long")).alias("n_labelled"), F.count_if(F.col("type") == PROCESS_TYPE).alias("n_processes"))
    return v.join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges")), keys)


def type_histogram(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def malicious_ratio(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.groupBy(*keys).agg(F.avg("label").alias("ratio"))


def confusion(scored: DataFrame) -> DataFrame:
    """Counts of the four classes over ``truth`` and ``flag``."""
    case = lambda t, f: F.count_if((F.col("truth") == t) & (F.col("flag") == f))
    return scored.agg(case(1, 1).alias("tp"), case(0, 1).alias("fp"), case(0, 0).alias("tn"), case(1, 0).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(safe_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, recall and precision in percent; null where undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.try_divide(a * 100, b)
    return counts.select(rate(tp + tn, tp + fp + tn + fn).alias("accuracy_pct"), rate(tp, tp + fn).alias("recall_pct"), rate(tp, tp + fp).alias("precision_pct"))


def confusion_class(scored: DataFrame) -> DataFrame:
    """``class`` of each snapshot."""
    t, f = F.col("truth") == 1, F.col("flag") == 1
    return scored.withColumn("class", F.when(t & f, "TP").when(f, "FP").when(t, "FN").otherwise("TN"))


def top_with_rest(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group and, in ``more``, how many follow."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("place", F.row_number().over(by.orderBy(*order))).withColumn("more", F.greatest(F.count(F.lit(1)).over(by) - k, F.lit(0)))
    return ranked.where(F.col("place") <= k)


def labelled_nodes(vertices: DataFrame, classed: DataFrame, keys: list[str], wanted: str, k: int = 10) -> DataFrame:
    """First labelled nodes, most frequent first, of the snapshots of one class."""
    picked = vertices.where("label = 1").join(classed.where(F.col("class") == wanted).select(*keys), keys)
    return top_with_rest(picked.select(*keys, "name", "frequency"), keys, [F.desc("frequency"), "name"], k)


def suspicious(vertices: DataFrame, classed: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Nodes of falsely flagged snapshots that look suspicious: processes by name, network ends by type."""
    reason = F.when((F.col("type") == PROCESS_TYPE) & F.lower("name").rlike(SUSPICIOUS_NAMES), "process name").when(F.col("type").contains("NETFLOW"), "network end")
    picked = vertices.withColumn("reason", reason).where("reason is not null").join(classed.where("class = 'FP'").select(*keys), keys)
    return top_with_rest(picked.select(*keys, "name", "reason"), keys, ["name"], k)


def missed(vertices: DataFrame, classed: DataFrame, keys: list[str]) -> DataFrame:
    """Missed snapshots with their labelled vertices and the share of these in percent."""
    found = vertices.join(classed.where("class = 'FN'").select(*keys), keys)
    return found.groupBy(*keys).agg(F.sum(F.col("label").cast("long")).alias("n_labelled"), (F.avg("label") * 100).alias("ratio_pct"))


def quiet_summary(vertices: DataFrame, classed: DataFrame) -> DataFrame:
    """Number of quiet snapshots and the type histogram of the first."""
    quiet = classed.where("class = 'TN'")
    first = quiet.agg(F.count(F.lit(1)).alias("n_quiet"), F.min("snapshot_id").alias("snapshot_id"))
    return vertices.join(F.broadcast(first), "snapshot_id").groupBy("snapshot_id", "n_quiet", "type").agg(F.count(F.lit(1)).alias("n"))


def score_listing(scored: DataFrame) -> DataFrame:
    """Position, error and status of every snapshot."""
    return scored.select("seq", "error", F.when(F.col("flag") == 1, "anomalous").otherwise("normal").alias("status"))


def node_report(vertices: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A line per snapshot: totals, labelled count, type histogram, and every node with its status, by name."""
    types = type_histogram(vertices, keys).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("types"))
    status = F.when(F.col("label") == 1, "malicious").otherwise("benign")
    nodes = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", status))), ",")
    sums = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vertices"), F.sum(F.col("label").cast("long")).alias("n_labelled"), nodes.alias("nodes"))
    edges = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return sums.join(edges, keys, "left").join(types, keys).withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def write_report(report: DataFrame, path: str) -> None:
    """The report as text, one line per snapshot."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def snapshot_text(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``place``, ``value``: the lines of a text that lists every snapshot and, by name, every vertex with all its attributes."""
    attributes = [c for c in vertices.columns if c not in keys]
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.to_json(c) if vertices.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string"), F.lit("null"))) for c in attributes))
    numbered = vertices.join(graph.dense_index(vertices, keys), [*keys, "name"])
    title = F.concat(F.lit("Snapshot "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.lit(":"))
    heads = vertices.select(*keys).distinct()
    lines = numbered.select(*keys, (F.col("idx") + 1).alias("place"), F.concat(F.lit("  Vertex "), F.col("idx").cast("string"), F.lit(": "), shown).alias("value"))
    return lines.unionByName(heads.select(*keys, F.lit(0).alias("place"), title.alias("value"))).unionByName(heads.select(*keys, F.lit(2**31 - 1).alias("place"), F.lit("").alias("value")))


def write_snapshot_text(vertices: DataFrame, keys: list[str], path: str) -> None:
    """``snapshot_text`` as files whose names are in the text's order; a large snapshot goes over several."""
    lines = snapshot_text(vertices, keys).repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    lines.select("value").write.mode("overwrite").text(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """``id<TAB>text`` lines."""
    vocabulary.select(F.concat_ws("\t", "rsg_id", "rsg").alias("value")).write.mode("overwrite").text(path)


def write_snapshots(vertices: DataFrame, pairs: DataFrame, sequence: DataFrame, path: str) -> None:
    """The snapshot store: three Parquet tables, each in a folder for every category where it has that column."""
    for name, rows in (("vertices", vertices), ("edges", pairs), ("snapshot_index", sequence)):
        rows.write.mode("overwrite").partitionBy([c for c in ("category",) if c in rows.columns and len(rows.columns) > 1]).parquet(f"{path}/{name}")


def read_snapshots(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("vertices", "edges", "snapshot_index"))
