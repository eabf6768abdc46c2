"""Streaming queries over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, shared_folder
from provgraph.operators import graph, snapshots
from provgraph.operators.quantiles import growth
from provgraph.sources import tables
from provgraph.streaming import BenignThreshold, DecayingHistogram, LabelHistogram, run_available, stream_node_budget, stream_scores, stream_time_snapshots
from provgraph.streaming.labels import PersistentLabels

from .base import Query, over_edges
from .detection import BUCKET, SEQ, SHARE, THRESHOLD, seq
from .features import H

#: Where the events are cut into four batches (microseconds), and the rounds and decay that labels take.
CUTS = (1_704_758_400_000_000, 1_705_449_600_000_000, 1_706_054_400_000_000)
ROUNDS, RATE = 2, 1e-12


def labels_cte() -> str:
    """Batches after one another, rounds inside them: neighbours so far, the frontier's new labels, the state they leave."""
    when = " ".join(f"WHEN us < {cut} THEN {k}" for k, cut in enumerate(CUTS))
    out = [
        f"pe AS MATERIALIZED (SELECT *, CASE {when} ELSE {len(CUTS)} END AS v FROM e)",
        "pn AS MATERIALIZED (SELECT v, actorID AS name, objectID AS other, action AS type FROM pe UNION SELECT v, objectID, actorID, 'rev_' || action FROM pe)",
        "props AS MATERIALIZED (SELECT name, string_agg(DISTINCT prop, ' ' ORDER BY prop) AS own FROM ends GROUP BY name)",
        "none_yet AS (SELECT NULL::VARCHAR AS name, NULL::VARCHAR AS label WHERE false)",
    ]
    for k in range(len(CUTS) + 1):
        now = lambda r, k=k: f"s_{k}_{r}"
        before = f"s_{k - 1}_{ROUNDS}" if k else "none_yet"
        out += [
            f"n_{k} AS MATERIALIZED (SELECT DISTINCT name, other, type FROM pn WHERE v <= {k})",
            f"f_{k}_1 AS MATERIALIZED (SELECT DISTINCT name FROM pn WHERE v = {k})",
            f"{now(0)} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT name, own FROM f_{k}_1 JOIN props USING (name) WHERE name NOT IN (SELECT name FROM {before}))",
        ]
        for r in range(1, ROUNDS + 1):
            if r > 1:
                out.append(f"f_{k}_{r} AS MATERIALIZED (SELECT DISTINCT other AS name FROM n_{k} JOIN f_{k}_{r - 1} USING (name))")
            out += [
                f"""u_{k}_{r} AS MATERIALIZED (SELECT s.name, xor({H.format('s.label')}, mix)::VARCHAR AS label FROM {now(r - 1)} s JOIN (
                SELECT n.name, bit_xor({H.format("n.type || '|' || o.label")}) AS mix FROM n_{k} n JOIN f_{k}_{r} f ON f.name = n.name JOIN {now(r - 1)} o ON o.name = n.other GROUP BY n.name) m ON m.name = s.name)""",
                f"{now(r)} AS MATERIALIZED (SELECT s.name, coalesce(u.label, s.label) AS label FROM {now(r - 1)} s LEFT JOIN u_{k}_{r} u ON u.name = s.name)",
            ]
    every = " UNION ALL ".join(f"SELECT {k} AS version, {r} AS round, name, label FROM u_{k}_{r}" for k in range(len(CUTS) + 1) for r in range(1, ROUNDS + 1))
    return ", ".join([*out, f"upd AS ({every})"])


def parsed(s, d) -> DataFrame:
    """The events' edges, read once and written with the columns that batches and first labels need."""
    return checkpointed(tables.event_edges(s, d).select("actorID", "actor_type", "objectID", "object", "action", "exec", "path", "us"))


def batches(edges: DataFrame) -> list[DataFrame]:
    """The events' edges in four batches by time."""
    edges = edges.select(F.col("actorID").alias("src"), F.col("objectID").alias("dst"), "action", F.col("us").cast("double").alias("t"), "us")
    bounds = [None, *CUTS, None]
    inside = lambda low, high: (F.lit(True) if low is None else F.col("us") >= low) & (F.lit(True) if high is None else F.col("us") < high)
    return [edges.where(inside(*b)).drop("us") for b in zip(bounds, bounds[1:])]


def first_labels(edges: DataFrame) -> DataFrame:
    """Each node's first label, written, since every batch is joined with it."""
    return checkpointed(graph.node_properties(edges, tables.edge_properties(edges)).select("name", F.array_join("properties", " ").alias("label")))


def wl_persistent(s, d):
    """Labels that persist over four snapshots of the events."""
    edges = parsed(s, d)
    store = PersistentLabels(shared_folder(s, "labels"), ROUNDS, first_labels(edges))
    for version, batch in enumerate(batches(edges)):
        store.step(batch, version)
    return store.updates(s)


def stream_wl_histogram(s, d):
    """The same as a stream; every label's decayed weight at the end.

    A batch's files, as many as tasks write, come when the stream has taken those before; it goes on from its checkpoint with all of them as one micro-batch.
    """
    base = shared_folder(s, "stream")
    edges = parsed(s, d)
    parts = batches(edges)
    sink = LabelHistogram(PersistentLabels(f"{base}/labels", ROUNDS, first_labels(edges)), DecayingHistogram(f"{base}/histogram", RATE))
    for i, part in enumerate(parts):
        part.write.parquet(f"{base}/in/{i}")
        stream = s.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.histogram.read(s, len(parts) - 1).select("label", F.round("weight", 6).alias("weight"))


def stream_budget(s, d):
    """Node-budget snapshots of the events as a stream, a micro-batch for each time chunk, a scene for each category; the last state is not cut."""
    base = shared_folder(s, "stream")
    edges = tables.event_edges(s, d).select(F.col("category").alias("scene"), F.col("actorID").alias("src"), F.col("objectID").alias("dst"), "us", "event_id")
    chunked, number = snapshots.time_chunks(edges)
    for chunk in range(number):
        chunked.where(F.col("chunk") == chunk).drop("chunk").coalesce(1).write.parquet(f"{base}/in/{chunk}")
    stream = s.readStream.schema(edges.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_available(stream_node_budget(stream, 100, 0.3), f"{base}/out", f"{base}/checkpoint")
    found = snapshots.with_frequencies(s.read.schema(snapshots.CUT_SCHEMA).parquet(f"{base}/out"))
    return found.select("scene", "snapshot_id", F.size("nodes").cast("long").alias("n_nodes"), "n_edges", F.aggregate("frequencies", F.lit(0).cast("long"), lambda a, x: a + x).alias("frequency"), "until_us")


#: Embeddings as vectors of four scenes in four batches, and what each is scored against.
SCENES = f"""{SEQ}, ss AS (SELECT seq // 4 AS pos, (seq % 4)::VARCHAR AS scene, vec, (label = 0)::INT AS truth, seq * 4 // (SELECT count(*) FROM v) AS batch FROM v),
xs AS (SELECT * EXCLUDE (vec), unnest(range(len(vec)))::INT AS dim, unnest(vec) AS y FROM ss),
ps AS (SELECT *, CASE WHEN pos = 0 THEN y ELSE coalesce(sum(y) OVER (PARTITION BY scene, dim ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) / 12 END AS pred FROM xs),
es AS (SELECT scene, pos, batch, truth, avg((pred - y) * (pred - y)) AS error FROM ps GROUP BY ALL),
bs AS (SELECT scene, batch, {BUCKET} AS bucket, count(*) AS n FROM es WHERE truth = 0 GROUP BY ALL),
cs AS (SELECT scene, b.batch, bucket, sum(n) AS n FROM bs JOIN (SELECT DISTINCT batch FROM ss) b ON bs.batch < b.batch GROUP BY ALL),
ts AS (SELECT scene, batch, pow({growth()!r}::DOUBLE, min(bucket)) AS threshold FROM (
    SELECT *, sum(n) OVER (PARTITION BY scene, batch ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY scene, batch) AS total FROM cs) WHERE upto >= ceil({SHARE}::DOUBLE * total) GROUP BY ALL)"""


def stream_thresholds(s, d):
    """Vectors scored as a stream, one micro-batch a file, each error against the benign errors of the batches before it."""
    base = shared_folder(s, "stream")
    rows = checkpointed(seq(s, d).select(F.col("seq"), "vec", (F.col("label") == 0).cast("int").alias("truth")))
    rows = rows.withColumn("batch", F.floor(F.col("seq") * 4 / rows.count())).withColumn("scene", (F.col("seq") % 4).cast("string")).withColumn("seq", F.floor(F.col("seq") / 4))
    for i in range(4):
        rows.where(F.col("batch") == i).drop("batch").coalesce(1).write.parquet(f"{base}/in/{i}")
    stream = s.readStream.schema(rows.drop("batch").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sink = BenignThreshold(f"{base}/thresholds", SHARE, THRESHOLD)
    stream_scores(stream, keep=("truth",)).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.flags(s).select("scene", "seq", "truth", F.round("threshold", 9).alias("threshold"), "flag")


def stream_snapshots(s, d):
    base = shared_folder(s, "stream")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("int")
    edges = events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.when(k < 25, "u").otherwise("k"), k.cast("string")).alias("dst"), F.concat(F.lit("EVENT_"), F.upper("event_type")).alias("action"))
    run_available(stream_time_snapshots(edges), f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out").select(F.unix_micros("start").alias("start_us"), "src", "dst", F.array_join("actions", "|").alias("actions"), "n")


QUERIES: dict[str, tuple[Query, str | None]] = {
    "stream_snapshots": (stream_snapshots, over_edges("""SELECT us // 300000000 * 300000000 AS start_us, actorID AS src, objectID AS dst, string_agg(DISTINCT action, '|' ORDER BY action) AS actions, count(*) AS n
        FROM e WHERE (us // 300000000 + 1) * 300000000 <= (SELECT max(us) // 1000 * 1000 FROM e) - 600000000 GROUP BY ALL""")),
    "stream_benign_threshold": (stream_thresholds, f"""WITH {SCENES} SELECT scene, pos AS seq, truth, round(coalesce(threshold, {THRESHOLD}::DOUBLE), 9) AS threshold, (error > coalesce(threshold, {THRESHOLD}::DOUBLE))::INT AS flag
        FROM es LEFT JOIN ts USING (scene, batch)"""),
    "stream_node_budget": (stream_budget, None),
    "wl_persistent": (wl_persistent, over_edges("SELECT version, round, name, label FROM upd", labels_cte())),
    "stream_wl_histogram": (stream_wl_histogram, over_edges("""SELECT label, round(sum(exp((t - (SELECT max(us) FROM e))::DOUBLE * 1e-12)), 6) AS weight
        FROM upd JOIN (SELECT v AS version, max(us) AS t FROM pe GROUP BY v) USING (version) GROUP BY label""", labels_cte())),
}
