"""Cutting an edge table into snapshots: by time, by number of nodes, by a sliding node budget."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from provgraph.cluster import checkpointed, shared_folder, ship_package

from .edges import ends

FIVE_MINUTES = 300_000_000


def time_snapshots(edges: DataFrame, width_us: int = FIVE_MINUTES, keys: list[str] | None = None) -> DataFrame:
    """``snapshot_id``: half-open bins anchored at the least time (within ``keys``); rows without a time go; empty bins are absent."""
    keys = keys or []
    timed = edges.where("us is not null")
    low = timed.groupBy(*keys).agg(F.min("us").alias("low"))
    joined = timed.join(low, keys) if keys else timed.crossJoin(F.broadcast(low))
    return joined.withColumn("snapshot_id", F.floor((F.col("us") - F.col("low")) / width_us)).drop("low")


def first_seen(edges: DataFrame) -> DataFrame:
    """For each node the event that mentions it first: ``us``, ``event_id``."""
    return ends(edges, "us", "event_id").groupBy("name").agg(F.min(F.struct("us", "event_id")).alias("at")).select("name", "at.us", "at.event_id")


def count_snapshots(edges: DataFrame, budget: int, bucket_us: int = 3_600_000_000) -> DataFrame:
    """``snapshot_id``: cut whenever the running number of first-seen nodes passes a multiple of the budget.

    The running sum is taken in two levels: inside time buckets, and over the buckets' totals, which are few.
    """
    fresh = first_seen(edges).groupBy("us", "event_id").agg(F.count(F.lit(1)).alias("fresh"))
    rows = edges.join(fresh, ["us", "event_id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0))).withColumn("bucket", F.floor(F.col("us") / bucket_us))
    totals = rows.groupBy("bucket").agg(F.sum("fresh").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "before")
    inside = F.sum("fresh").over(Window.partitionBy("bucket").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumn("inside", inside).join(before, "bucket").withColumn("seen", F.col("before") + F.col("inside"))
    return seen.withColumn("snapshot_id", F.floor((F.col("seen") - 1) / budget)).drop("fresh", "bucket", "inside", "before")


def last_seen(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First and last time of each node."""
    keys = keys or []
    return ends(edges, *keys, "us").groupBy(*keys, "name").agg(F.max("us").alias("last_us"), F.min("us").alias("first_us"))


def least_recent(edges: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """The floor(rate * n) nodes of each snapshot that were seen least recently; ties by first time, then name."""
    by = Window.partitionBy(*keys)
    ranked = last_seen(edges, keys).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy("last_us", "first_us", "name")))
    return ranked.where(F.col("place") <= F.floor(F.col("n") * rate)).drop("n", "place")


def snapshot_sequence(snapshots: DataFrame, first: str = "benign") -> DataFrame:
    """``seq`` from 0 over (category, snapshot_id), one category before the others. One row per snapshot."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("category") != first, "category", "snapshot_id")
    return snapshots.select("category", "snapshot_id").distinct().withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def snapshot_bounds(sequence: DataFrame, categories: tuple[str, ...] = ("benign", "malicious")) -> DataFrame:
    """Inclusive bounds of each category in the sequence, -1 where it has none."""
    names = sequence.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = sequence.groupBy("category").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return names.join(found, "category", "left").na.fill(-1)


#: A cut as the rule makes it: the live nodes, how often each node was mentioned since the cut before, and the live edges' number.
CUT_SCHEMA = "scene string, snapshot_id long, nodes array<string>, touched array<string>, counts array<long>, n_edges long, until_us long"
CUT_COLUMNS = [field.split()[0] for field in CUT_SCHEMA.split(", ")]


class NodeBudget:
    """The live graph of one scene: cut at ``budget`` nodes, then whenever it has grown by ``rate``, after forgetting.

    Nodes that are forgotten leave nothing here: their mentions go out with the next cut. So at most ``budget * (1 + rate)`` nodes are held, those
    between two cuts, whatever the scene's length.
    """

    def __init__(self, budget: int, rate: float) -> None:
        self.budget, self.forget = budget, int(budget * rate)
        self.seen: dict[str, int] = {}
        self.touched: dict[str, int] = {}
        self.edges: dict[str, set] = {}
        self.number, self.until = 0, 0

    def add(self, src: str, dst: str, us: int) -> tuple | None:
        for node in (src, dst):
            self.seen[node] = us
            self.touched[node] = self.touched.get(node, 0) + 1
        self.link(src, dst)
        self.until = us
        live = len(self.seen)
        if not self.number and live >= self.budget:
            return self.cut()
        if self.number and live >= self.budget + self.forget:
            for node in sorted(self.seen, key=self.seen.get)[: self.forget]:
                del self.seen[node]
                for edge in self.edges.pop(node, set()):
                    for end in edge:
                        if end in self.edges:
                            self.edges[end].discard(edge)
            return self.cut()
        return None

    def link(self, src: str, dst: str) -> None:
        self.edges.setdefault(src, set()).add((src, dst))
        self.edges.setdefault(dst, set()).add((src, dst))

    def live_edges(self) -> set[tuple[str, str]]:
        return {edge for edges in self.edges.values() for edge in edges}

    def cut(self) -> tuple:
        touched = sorted(self.touched.items())
        row = self.number, sorted(self.seen), [n for n, _ in touched], [c for _, c in touched], len(self.live_edges()), self.until
        self.number, self.touched = self.number + 1, {}
        return row


#: Cuts that a task counts the mentions of.
CUTS = 5_000
#: Rows of a time chunk, in which the events of a sequence are replayed.
CHUNK = 1_000_000


def time_chunks(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """The edges with ``chunk``, ranges of (us, event_id) from 0 with about ``rows`` (``CHUNK``) each, written by chunk; and the number of chunks."""
    path, number = shared_folder(edges.sparkSession, "chunks"), max(1, -(-edges.count() // (rows or CHUNK)))
    edges.repartitionByRange(number, "us", "event_id").withColumn("chunk", F.spark_partition_id()).write.partitionBy("chunk").parquet(path)
    return edges.sparkSession.read.schema(StructType([*edges.schema, StructField("chunk", IntegerType())])).parquet(path), number


def node_budget_cuts(edges: DataFrame, budget: int = 300, rate: float = 0.3, scene: str = "scene") -> DataFrame:
    """The cuts of each scene's stream in time order (``CUT_SCHEMA``); the last state is always one.

    The rule depends on every row before it, so a scene is one sequence. It is replayed chunk by chunk, scenes side by side: a chunk meets the live graphs that the one
    before it left, so a task holds a chunk's rows of a scene and a live graph, whatever the scene's length. For one huge scene ``count_snapshots`` is faster.
    """
    import pandas as pd

    def run(key, rows, left):
        state = pickle.loads(left["state"].iloc[0]) if len(left) else NodeBudget(budget, rate)
        rows, out = rows.sort_values(["us", "event_id"]), []
        for src, dst, us in zip(rows["src"], rows["dst"], rows["us"]):
            cut = state.add(src, dst, int(us))
            if cut is not None:
                out.append((key[0], *cut, None))
        return pd.DataFrame([*out, (key[0], *[None] * (len(CUT_COLUMNS) - 1), pickle.dumps(state))], columns=[*CUT_COLUMNS, "state"], dtype=object)

    def last(batches):
        for batch in batches:
            yield pd.DataFrame([(s, *pickle.loads(x).cut()) for s, x in zip(batch["scene"], batch["state"])], columns=CUT_COLUMNS)

    spark, path = edges.sparkSession, shared_folder(edges.sparkSession, "cuts")
    ship_package(spark)
    schema = f"{CUT_SCHEMA}, state binary"
    chunked, number = time_chunks(edges.select(F.col(scene).alias("scene"), F.col("actorID").alias("src"), F.col("objectID").alias("dst"), "us", "event_id"))
    states = spark.createDataFrame([], "scene string, state binary")
    for chunk in range(number):
        rows = chunked.where(F.col("chunk") == chunk).drop("chunk")
        rows.groupBy("scene").cogroup(states.groupBy("scene")).applyInPandas(run, schema).write.parquet(f"{path}/{chunk}")
        states = spark.read.schema(schema).parquet(f"{path}/{chunk}").where("state is not null").select("scene", "state")
    cuts = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).where("state is null").select(*CUT_COLUMNS)
    return cuts.union(states.mapInPandas(last, CUT_SCHEMA))


def with_frequencies(cuts: DataFrame) -> DataFrame:
    """``scene``, ``snapshot_id``, ``nodes``, ``frequencies``, ``n_edges``, ``until_us``: mentions of each live node since the scene began.

    Cuts carry only the mentions since the cut before; a node's running sum over them is keyed by scene and node, so nodes that were forgotten
    and come back go on from their old count without anyone having held it. Cuts are dealt to tasks, ``CUTS`` to each, and their nodes are counted there. ``cuts``
    must be cheap to read twice.
    """
    spread = cuts.repartition(-(-cuts.count() // CUTS) or 1, "scene", "snapshot_id")
    row = lambda name, n, live: F.struct(name.alias("name"), n.cast("long").alias("n"), F.lit(live).alias("live"))
    rows = F.concat(F.transform("nodes", lambda x: row(x, F.lit(0), 1)), F.transform(F.arrays_zip("touched", "counts"), lambda x: row(x["touched"], x["counts"], 0)))
    each = spread.select("scene", "snapshot_id", F.explode(rows).alias("x")).groupBy("scene", "snapshot_id", F.col("x.name").alias("name")).agg(F.sum("x.n").alias("n"), F.max("x.live").alias("live"))
    upto = Window.partitionBy("scene", "name").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    running = each.withColumn("frequency", F.sum("n").over(upto)).where("live = 1")
    listed = running.groupBy("scene", "snapshot_id").agg(F.array_sort(F.collect_list(F.struct("name", "frequency"))).alias("x"))
    return cuts.select("scene", "snapshot_id", "n_edges", "until_us").join(listed, ["scene", "snapshot_id"]).select("scene", "snapshot_id", F.col("x.name").alias("nodes"), F.col("x.frequency").alias("frequencies"), "n_edges", "until_us")


def node_budget_snapshots(edges: DataFrame, budget: int = 300, rate: float = 0.3, scene: str = "scene") -> DataFrame:
    """Sliding snapshots by node budget with their nodes' frequencies; see ``node_budget_cuts``. The cuts are written once."""
    return with_frequencies(checkpointed(node_budget_cuts(edges, budget, rate, scene)))
