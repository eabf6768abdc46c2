"""Queries on forecasts, scores, reports and learned vectors."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from provgraph import jobs
from provgraph.cluster import checkpointed, dense_ids, shared_folder
from provgraph.functions import hash60
from provgraph.operators import detect, embed, graph, quantiles, report, snapshots
from provgraph.operators.store import SnapshotStore
from provgraph.sources import tables

from .base import LABELS, Query, over_edges
from .features import COUNTS, DAY_CTE, H, HASHED, counts
from .graphs import SNAP, TRIPLES, daily, triples

SEQ = "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"
CELLS = f"{SEQ}, x AS (SELECT seq, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS y FROM v)"
SCORED = f"""{CELLS}, pr AS (
  SELECT x.seq, x.dim, x.y, CASE WHEN x.seq = 0 THEN x.y ELSE coalesce(sum(p.y), 0) / 12 END AS pred
  FROM x LEFT JOIN x p ON p.dim = x.dim AND p.seq BETWEEN x.seq - 12 AND x.seq - 1 GROUP BY x.seq, x.dim, x.y
), sc AS (SELECT seq, avg((pred - y) * (pred - y)) AS error FROM pr GROUP BY seq),
scored AS (SELECT seq, error, (error > 0.0173)::INT AS flag, (label = 0)::INT AS truth FROM sc JOIN v USING (seq)),
cm AS (SELECT count(*) FILTER (truth = 1 AND flag = 1) AS tp, count(*) FILTER (truth = 0 AND flag = 1) AS fp, count(*) FILTER (truth = 0 AND flag = 0) AS tn, count(*) FILTER (truth = 1 AND flag = 0) AS fn FROM scored)"""
THRESHOLD = 0.0173

#: Logarithmic buckets of errors as SQL, and the share of benign errors that a learned threshold lets pass.
SHARE = 0.9
LOG_GROWTH = f"{math.log(quantiles.growth())!r}::DOUBLE"
BUCKET = f"ceil(ln(greatest(error, 1e-12)) / {LOG_GROWTH})::INT"

#: Five-minute snapshots with a truth from their labels and a flag from their size.
CLASSED = f"""{SNAP}, sv AS (
  SELECT snapshot_id, name, arg_min(type, (us, event_id, side)) AS type, count(*) AS frequency, (name IN (SELECT label FROM labels_))::INT AS label FROM (
    SELECT snapshot_id, actorID AS name, actor_type AS type, 0 AS side, us, event_id FROM snap UNION ALL SELECT snapshot_id, objectID, object, 1, us, event_id FROM snap) GROUP BY ALL),
tr AS (SELECT snapshot_id, max(label) AS truth FROM sv GROUP BY ALL),
sz AS (SELECT snapshot_id, (count(*) >= 3)::INT AS flag FROM snap GROUP BY ALL),
classed AS (SELECT snapshot_id, truth, flag, CASE WHEN truth = 1 AND flag = 1 THEN 'TP' WHEN flag = 1 THEN 'FP' WHEN truth = 1 THEN 'FN' ELSE 'TN' END AS class FROM tr JOIN sz USING (snapshot_id))"""


def seq(s, d):
    return detect.sequence(tables.table(s, d, "embeddings"), "vec_id", "embedding")


def scored(s, d):
    found = detect.scores(detect.mean_forecast(detect.lag_windows(seq(s, d))), THRESHOLD)
    return found.withColumn("truth", (F.col("label") == 0).cast("int"))


def benign_flags(s, d):
    """Flags beyond the quantile of all benign errors."""
    found = checkpointed(scored(s, d).select("seq", "error", "truth"))
    return found.crossJoin(F.broadcast(quantiles.benign_threshold(found, [], SHARE))).select("seq", "truth", F.round("threshold", 9).alias("threshold"), (F.col("error") > F.col("threshold")).cast("int").alias("flag"))


def lag_windows(s, d):
    w = detect.lag_windows(seq(s, d))
    first = F.aggregate(F.transform("window", lambda v: v[0]), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return w.select("seq", F.size("window").cast("long").alias("n"), F.round(first, 6).alias("total"), F.round(F.col("window")[11][0], 6).alias("last"))


def train_windows(s, d):
    w = detect.training_windows(seq(s, d))
    return w.select("seq", F.round(F.col("window")[0][0], 6).alias("first"), F.round(F.col("window")[11][0], 6).alias("last"))


def snaps(s, d):
    return snapshots.time_snapshots(tables.event_edges(s, d))


def classed(s, d):
    rows = snaps(s, d)
    v = graph.vertices(rows, tables.event_properties(s, d), tables.event_labels(s), ["snapshot_id"])
    flags = rows.groupBy("snapshot_id").agg((F.count(F.lit(1)) >= 3).cast("int").alias("flag"))
    return v, report.confusion_class(report.snapshot_truth(v, ["snapshot_id"]).join(flags, "snapshot_id"))


def named(s, d):
    """Vertices with names that the suspicious-name rule can find."""
    v, c = classed(s, d)
    return v.withColumn("name", F.when((F.col("type") == "SUBJECT_PROCESS") & (F.substring("name", 2, 9).cast("int") % 10 == 3), F.concat("name", F.lit("-Daemon"))).otherwise(F.col("name"))), c


def fp_report(s, d):
    v, c = named(s, d)
    return report.suspicious(v, c, ["snapshot_id"]).select("snapshot_id", "name", "reason", F.col("place").cast("long"), "more")


def tp_report(s, d):
    v, c = classed(s, d)
    return report.labelled_nodes(v, c, ["snapshot_id"], "TP").select("snapshot_id", "name", "frequency", F.col("place").cast("long"), "more")


def node_report(s, d):
    rows = snaps(s, d)
    v = graph.vertices(rows, tables.event_properties(s, d), tables.event_labels(s), ["snapshot_id"])
    return report.node_report(v, graph.edge_actions(rows, ["snapshot_id"]), ["snapshot_id"])


def store_roundtrip(s, d):
    """Snapshots written to a store in the warehouse or the shared folder and read back, then counted."""
    import uuid

    from provgraph.cluster import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    rows = snaps(s, d)
    v = graph.vertices(rows, tables.event_properties(s, d), tables.event_labels(s), ["snapshot_id"])
    path = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
    report.write_snapshots(v, graph.edge_actions(rows, ["snapshot_id"]), snapshots.snapshot_sequence(rows.select("category", "snapshot_id")), path)
    vertices, pairs, _ = report.read_snapshots(s, path)
    return vertices.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("frequency").alias("frequency")).join(pairs.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_edges")), "snapshot_id")


#: Snapshots before these (days since 1970, bins of five minutes) are stored first, the others come to the store.
CUT_DAY, CUT_BIN, DIM = 19738, 4320, 4


def stored_join(s, d):
    """Stored vertices joined with stored edges, bucket by bucket, after the store has grown: each source's edges and frequency."""
    rows = checkpointed(snaps(s, d))
    store = SnapshotStore(s, shared_folder(s, "store"), 8)
    for part in (rows.where(F.col("snapshot_id") < CUT_BIN), rows):
        v = graph.vertices(part, tables.event_properties(s, d), tables.event_labels(s), ["snapshot_id"])
        store.append(v, graph.edge_actions(part, ["snapshot_id"]))
    edges = store.table("edges").withColumnRenamed("src", "name")
    return edges.join(store.table("vertices"), ["snapshot_id", "name"]).groupBy("snapshot_id", "name").agg(F.count(F.lit(1)).alias("n_edges"), F.max("frequency").alias("frequency"))


def stored_vectors(s, d):
    """Vectors of days in a store: the first days' as they were kept, the later ones' folded in from vectors of features. Both are drawn by hash here."""
    bags = checkpointed(counts(s, d).withColumnRenamed("day", "snapshot_id"))
    store = SnapshotStore(s, shared_folder(s, "store"), 8)
    first = bags.where(F.col("snapshot_id") < CUT_DAY).select("snapshot_id").distinct()
    store.keep_vectors(first.withColumn("vec", embed.start_vector(F.concat(F.lit("day"), F.col("snapshot_id").cast("string")), DIM)), bags.select("rsg").distinct().withColumn("vec", embed.start_vector(F.col("rsg"), DIM)))
    return store.vectors(bags).select(F.col("snapshot_id").alias("day"), F.posexplode("vec").alias("pos", "x")).select("day", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


def snapshot_lines(s, d):
    v = graph.vertices(daily(s, d), tables.event_properties(s, d), tables.event_labels(s), ["day"])
    return report.snapshot_text(checkpointed(v), ["day"])


def trained_evaluation(s, d):
    """Day snapshots: trained on all benign days and the malicious ones up to a week, then every malicious day scored, the later ones folded in."""
    days = checkpointed(daily(s, d).withColumnRenamed("day", "snapshot_id"))
    properties, labels, path = tables.event_properties(s, d), tables.event_labels(s), shared_folder(s, "job")
    jobs.train(s, days.where((F.col("category") == "benign") | (F.col("snapshot_id") < CUT_DAY + 7)), properties, labels, path, buckets=8)
    return jobs.evaluate(s, days, properties, labels, path).scored


def als(s, d):
    """Whether each snapshot's vector lies nearer to the features that it has than to drawn ones that it lacks."""
    bags = counts(s, d)
    vocabulary = dense_ids(bags, "rsg", "rsg_id")
    rated = checkpointed(bags.join(vocabulary, "rsg").select("rsg_id", "cnt", F.col("day").alias("seq")))
    model = embed.snapshot_factors(rated, 16, 3)
    vectors = embed.snapshot_vectors(model)
    features = embed.feature_vectors(model, vocabulary).select("rsg_id", F.col("vec").alias("other"))
    product = F.aggregate(F.zip_with("vec", "other", lambda x, y: (x * y).cast("double")), F.lit(0.0).cast("double"), lambda t, x: t + x)
    mean = lambda rows, name: rows.join(vectors, "seq").join(features, "rsg_id").groupBy("seq").agg(F.avg(product).alias(name))
    both = mean(rated.select("seq", "rsg_id"), "own").join(mean(embed.negatives(rated, vocabulary, 100), "lacking"), "seq")
    return vectors.join(both, "seq").select("seq", F.size("vec").alias("dim"), (F.col("own") > F.col("lacking")).alias("own_nearer"))


def members(s, d):
    """Customers and suppliers with their nation and region: ``h``, ``n``, ``g``."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nations = tables.table(s, d, "nation").select(text("n", "n_nationkey").alias("n"), text("g", "n_regionkey").alias("g"))
    both = tables.table(s, d, "customer").select(text("c", "c_custkey").alias("h"), text("n", "c_nationkey").alias("n"))
    return both.union(tables.table(s, d, "supplier").select(text("s", "s_suppkey"), text("n", "s_nationkey"))).join(nations, "n").select("h", "n", "g"), nations


def translations(s, d, epochs=100):
    """Regions of members that training has not seen, from their nations: whether the true one is nearer than nine in ten entities, by region."""
    of, nations = members(s, d)
    asked = checkpointed(embed.triple_split(of.select("h", F.lit("in_region").alias("r"), F.col("g").alias("t"))))
    known = of.select("h", F.lit("in_nation").alias("r"), F.col("n").alias("t")).union(nations.select("n", F.lit("in_region"), "g")).union(asked.where("part = 'train'").select("h", "r", "t"))
    ranks = embed.tail_ranks(asked.where("part <> 'train'"), embed.translation_vectors(known, epochs=epochs))
    return ranks.groupBy("t").agg(F.count(F.lit(1)).alias("n"), (F.avg("share") > 0.9).alias("true_nearer"))


def word_vectors(s, d, rounds=100):
    """Whether the words of a nation's members lie nearer to the mean of its other members than to those of other nations, by nation.

    Half of the members, by hash, make their nation's mean; the other half is compared with it.
    """
    of, _ = members(s, d)
    of = checkpointed(of.withColumn("half", hash60(F.col("h")) % 2))
    found = embed.word_vectors(of.select("h", F.lit("in_nation").alias("r"), F.col("n").alias("t")), rounds=rounds)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0).cast("double"), lambda t, v: t + v)
    # a length inside ``transform`` would be computed again for each component
    unit = lambda c: F.zip_with(c, F.array_repeat(F.sqrt(dot(F.col(c), F.col(c))), F.size(c)), lambda v, length: v / length)
    placed = checkpointed(of.join(found.select(F.col("word").alias("h"), vector_to_array("vector").alias("vec")), "h").withColumn("vec", unit("vec")))

    def summed(rows, *by):
        cells = rows.select(*by, F.posexplode("vec").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
        return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("vec"))

    means = checkpointed(summed(placed.where("half = 0"), "n").withColumn("vec", unit("vec")))
    every = summed(means).select(F.col("vec").alias("every")).crossJoin(means.agg(F.count(F.lit(1)).alias("m")))
    met = placed.where("half = 1").join(means.select("n", F.col("vec").alias("mean")), "n").crossJoin(F.broadcast(every)).withColumn("own", dot("vec", "mean"))
    others = (dot("vec", "every") - F.col("own")) / (F.col("m") - 1)
    return met.groupBy("n").agg(F.count(F.lit(1)).alias("members"), (F.avg(F.col("own") - others) > 0.3).alias("own_nearer"))


MEMBERS = """WITH m AS (SELECT 'c' || c_custkey AS h, 'n' || c_nationkey AS n FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
f AS (SELECT h, n, 'g' || n_regionkey AS t FROM m JOIN nation ON n = 'n' || n_nationkey)"""


def vector_lookup(s, d):
    t = triples(s, d)
    vectors = t.select(F.lit("relation").alias("kind"), F.col("r").alias("name")).union(t.select(F.lit("entity"), "h")).union(t.where("r = 'EVENT_CLICK'").select(F.lit("entity"), "r")).distinct().withColumn("vec", F.array(F.length("name").cast("double")))
    asked = t.select(F.col("t").alias("name")).union(t.select("r")).distinct()
    return embed.lookup(asked, vectors).select("name", "kind", F.col("vec")[0].alias("x"))


def var_errors(s, d):
    """Forecast errors of the fitted autoregression."""
    windows = detect.lag_windows(seq(s, d))
    weights = detect.fit_autoregression(detect.gram(detect.lagged_values(windows)))
    return detect.scores(detect.autoregression_forecast(windows, weights)).select("seq", "error", "flag")


def joint_gram(s, d):
    """Cells of the joint forecaster's normal equations: products of hashed features, and with each dimension."""
    cells = detect.joint_gram(detect.lag_windows(seq(s, d)), size=HASHED_FEATURES).select("i", F.posexplode("values").alias("j", "value"))
    return cells.select("i", "j", F.round("value", 6).alias("value"))


def joint_forecast(s, d):
    """Errors of the joint forecaster, its ridge chosen on the last fifth of the sequence."""
    rows = seq(s, d)
    return detect.scores(detect.fit_joint(rows).forecast(detect.lag_windows(rows)), THRESHOLD).select("seq", "error", "flag")


#: Features of the joint forecaster whose cells are compared.
HASHED_FEATURES = 16
HASH = "('0x' || substr(md5(l.i || '|' || a.dim), 1, 15))::BIGINT"

DRAWN = "((" + H + " + 1)::DOUBLE / 1152921504606846976.0::DOUBLE - 0.5)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "lag_windows": (lag_windows, f"WITH {CELLS} SELECT a.seq, 12::BIGINT AS n, round(CASE WHEN a.seq = 0 THEN 12 * a.y ELSE coalesce(sum(p.y), 0) END, 6) AS total, round(CASE WHEN a.seq = 0 THEN a.y ELSE max(p.y) FILTER (p.seq = a.seq - 1) END, 6) AS last FROM x a LEFT JOIN x p ON p.dim = 0 AND p.seq BETWEEN a.seq - 12 AND a.seq - 1 WHERE a.dim = 0 GROUP BY a.seq, a.y"),
    "train_windows": (train_windows, f"WITH {CELLS} SELECT b.seq, round(a.y, 6) AS first, round(b.y, 6) AS last FROM x b JOIN x a ON a.dim = 0 AND a.seq = b.seq - 11 WHERE b.dim = 0"),
    "chrono_split": (lambda s, d: detect.chronological_split(seq(s, d)).select("seq", "vec_id", "part"), f"WITH {SEQ} SELECT seq, vec_id, CASE WHEN seq < floor(0.8::DOUBLE * (SELECT count(*) FROM v)) THEN 'train' ELSE 'validation' END AS part FROM v"),
    "var_gram": (lambda s, d: detect.gram(detect.lagged_values(detect.lag_windows(seq(s, d)))).select("dim", "i", "j", F.round("value", 6).alias("value")), f"""WITH {CELLS}, w AS (SELECT a.seq, a.dim, l.i::INT AS i, CASE WHEN a.seq = 0 THEN a.y ELSE coalesce(p.y, 0) END AS z, a.y FROM x a CROSS JOIN range(12) l(i) LEFT JOIN x p ON p.dim = a.dim AND p.seq = a.seq - 12 + l.i)
        SELECT p.dim, p.i, q.i AS j, round(sum(p.z * q.z), 6) AS value FROM w p JOIN w q ON q.dim = p.dim AND q.seq = p.seq AND q.i >= p.i GROUP BY ALL UNION ALL SELECT dim, i, 12, round(sum(z * y), 6) FROM w GROUP BY ALL"""),
    "joint_gram": (joint_gram, f"""WITH {CELLS}, w AS (
          SELECT a.seq, {HASH} % {HASHED_FEATURES} AS f, sum(CASE WHEN {HASH} // {HASHED_FEATURES} % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN a.seq = 0 THEN a.y ELSE coalesce(p.y, 0) END) AS z
          FROM x a CROSS JOIN range(12) l(i) LEFT JOIN x p ON p.dim = a.dim AND p.seq = a.seq - 12 + l.i GROUP BY ALL)
        SELECT a.f::INT AS i, b.f::INT AS j, round(sum(a.z * b.z), 6) AS value FROM w a JOIN w b USING (seq) GROUP BY ALL
        UNION ALL SELECT w.f::INT, {HASHED_FEATURES} + x.dim, round(sum(z * y), 6) FROM w JOIN x USING (seq) GROUP BY ALL"""),
    "joint_forecast": (joint_forecast, None),
    "ridge_choice": (lambda s, d: detect.choose_ridge(seq(s, d)), None),
    "forecast_error": (lambda s, d: scored(s, d).select("seq", F.round("error", 9).alias("error")), f"WITH {SCORED} SELECT seq, round(error, 9) AS error FROM scored"),
    "anomaly_flags": (lambda s, d: scored(s, d).select("seq", "flag", "truth"), f"WITH {SCORED} SELECT seq, flag, truth FROM scored"),
    "benign_quantile_flags": (benign_flags, f"""WITH {SCORED}, bk AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM scored WHERE truth = 0 GROUP BY ALL),
        th AS (SELECT pow({quantiles.growth()!r}::DOUBLE, min(bucket)) AS threshold FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM bk) WHERE upto >= ceil({SHARE}::DOUBLE * total))
        SELECT seq, truth, round(threshold, 9) AS threshold, (error > threshold)::INT AS flag FROM scored, th"""),
    "score_listing": (lambda s, d: report.score_listing(scored(s, d)).withColumn("error", F.round("error", 9)), f"WITH {SCORED} SELECT seq, round(error, 9) AS error, CASE WHEN flag = 1 THEN 'anomalous' ELSE 'normal' END AS status FROM scored"),
    "diff_vectors": (lambda s, d: detect.differences(scored(s, d)).select("seq", F.posexplode("diff").alias("dim", "v")).select("seq", "dim", F.round("v", 9).alias("diff")), f"WITH {SCORED} SELECT seq, dim, round(pred - y, 9) AS diff FROM pr JOIN scored USING (seq) WHERE flag = 1"),
    "confusion": (lambda s, d: report.confusion(scored(s, d)), f"WITH {SCORED} SELECT * FROM cm"),
    "metrics": (lambda s, d: report.metrics(report.confusion(scored(s, d))), f"WITH {SCORED} SELECT coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM cm"),
    "summary_rates": (lambda s, d: report.summary_rates(report.confusion(scored(s, d))), f"WITH {SCORED} SELECT (tp + tn)::DOUBLE * 100 / nullif(tp + fp + tn + fn, 0) AS accuracy_pct, tp::DOUBLE * 100 / nullif(tp + fn, 0) AS recall_pct, tp::DOUBLE * 100 / nullif(tp + fp, 0) AS precision_pct FROM cm"),
    "var_forecast": (var_errors, None),
    "snapshot_truth": (lambda s, d: report.snapshot_truth(classed(s, d)[0], ["snapshot_id"]), over_edges("SELECT snapshot_id, truth FROM tr", LABELS, CLASSED)),
    "type_histogram": (lambda s, d: report.type_histogram(classed(s, d)[0], ["snapshot_id"]), over_edges("SELECT snapshot_id, type, count(*) AS n FROM sv GROUP BY ALL", LABELS, CLASSED)),
    "malicious_ratio": (lambda s, d: report.malicious_ratio(classed(s, d)[0], ["snapshot_id"]), over_edges("SELECT snapshot_id, avg(label) AS ratio FROM sv GROUP BY ALL", LABELS, CLASSED)),
    "confusion_class": (lambda s, d: classed(s, d)[1].select("snapshot_id", "truth", "flag", "class"), over_edges("SELECT snapshot_id, truth, flag, class FROM classed", LABELS, CLASSED)),
    "tp_report": (tp_report, over_edges("SELECT snapshot_id, name, frequency, place, greatest(n - 10, 0) AS more FROM (SELECT snapshot_id, name, frequency, row_number() OVER (PARTITION BY snapshot_id ORDER BY frequency DESC, name) AS place, count(*) OVER (PARTITION BY snapshot_id) AS n FROM sv JOIN classed USING (snapshot_id) WHERE class = 'TP' AND label = 1) WHERE place <= 10", LABELS, CLASSED)),
    "fp_report": (fp_report, over_edges("""SELECT snapshot_id, name, reason, place, greatest(n - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY name) AS place, count(*) OVER (PARTITION BY snapshot_id) AS n FROM (
        SELECT snapshot_id, CASE WHEN type = 'SUBJECT_PROCESS' THEN name || '-Daemon' ELSE name END AS name, CASE WHEN type = 'SUBJECT_PROCESS' THEN 'process name' ELSE 'network end' END AS reason
        FROM sv JOIN classed USING (snapshot_id) WHERE class = 'FP' AND (type = 'NETFLOW_OBJECT' OR type = 'SUBJECT_PROCESS' AND CAST(substr(name, 2) AS INT) % 10 = 3))) WHERE place <= 5""", LABELS, CLASSED)),
    "fn_report": (lambda s, d: report.missed(*classed(s, d), ["snapshot_id"]), over_edges("SELECT snapshot_id, sum(label)::BIGINT AS n_labelled, avg(label) * 100 AS ratio_pct FROM sv JOIN classed USING (snapshot_id) WHERE class = 'FN' GROUP BY snapshot_id", LABELS, CLASSED)),
    "tn_summary": (lambda s, d: report.quiet_summary(*classed(s, d)), over_edges("SELECT snapshot_id, (SELECT count(*) FROM classed WHERE class = 'TN') AS n_quiet, type, count(*) AS n FROM sv WHERE snapshot_id = (SELECT min(snapshot_id) FROM classed WHERE class = 'TN') GROUP BY ALL", LABELS, CLASSED)),
    "node_report": (node_report, over_edges("""SELECT a.snapshot_id, n_vertices, n_labelled, n_edges, types, nodes FROM
        (SELECT snapshot_id, count(*) AS n_vertices, sum(label)::BIGINT AS n_labelled FROM sv GROUP BY ALL) a
        JOIN (SELECT snapshot_id, count(DISTINCT (actorID, objectID)) AS n_edges FROM snap GROUP BY ALL) b USING (snapshot_id)
        JOIN (SELECT snapshot_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS types FROM (SELECT snapshot_id, type, count(*) AS n FROM sv GROUP BY ALL) GROUP BY ALL) c USING (snapshot_id)
        JOIN (SELECT snapshot_id, string_agg(x, ',' ORDER BY x) AS nodes FROM (SELECT snapshot_id, name || ':' || CASE WHEN label = 1 THEN 'malicious' ELSE 'benign' END AS x FROM sv) GROUP BY ALL) f USING (snapshot_id)""", LABELS, CLASSED)),
    "snapshot_text": (snapshot_lines, over_edges("""SELECT day, place::INT AS place, value FROM (
        SELECT day, i + 1 AS place, '  Vertex ' || i || ': name=' || name || ', type=' || type || ', properties=' || props || ', frequency=' || n || ', label=' || (name IN (SELECT label FROM labels_))::INT AS value FROM (
            SELECT us // 86400000000 AS day, name, arg_min(type, (us, event_id, side)) AS type, to_json(list_sort(list(DISTINCT prop)))::VARCHAR AS props, count(*) AS n, row_number() OVER (PARTITION BY us // 86400000000 ORDER BY name) - 1 AS i FROM ends GROUP BY us // 86400000000, name)
        UNION ALL SELECT DISTINCT us // 86400000000, 0, 'Snapshot ' || us // 86400000000 || ':' FROM e
        UNION ALL SELECT DISTINCT us // 86400000000, 2147483647, '' FROM e)""", LABELS)),
    "trained_evaluation": (trained_evaluation, None),
    "stored_join": (stored_join, over_edges("""SELECT snapshot_id, name, n_edges, frequency FROM (SELECT snapshot_id, actorID AS name, count(DISTINCT objectID) AS n_edges FROM snap GROUP BY ALL)
        JOIN (SELECT snapshot_id, name, sum(frequency)::BIGINT AS frequency FROM sv GROUP BY ALL) USING (snapshot_id, name)""", LABELS, CLASSED)),
    "stored_vectors": (stored_vectors, over_edges(f"""SELECT day, pos::INT AS pos, round(x::FLOAT::DOUBLE, 5) AS x FROM (
        SELECT day, pos, {DRAWN.format("'day' || day || '|' || pos")} AS x FROM (SELECT DISTINCT day FROM counts WHERE day < {CUT_DAY}), range({DIM}) p(pos)
        UNION ALL SELECT day, pos, sum(ln(1 + cnt) * {DRAWN.format("rsg || '|' || pos")}::FLOAT) / sum(ln(1 + cnt)) FROM counts, range({DIM}) p(pos) WHERE day >= {CUT_DAY} GROUP BY day, pos)""", DAY_CTE, HASHED, COUNTS)),
    "snapshot_store_roundtrip": (store_roundtrip, over_edges("SELECT snapshot_id, n_vertices, frequency, n_edges FROM (SELECT snapshot_id, count(*) AS n_vertices, sum(frequency)::BIGINT AS frequency FROM sv GROUP BY ALL) JOIN (SELECT snapshot_id, count(DISTINCT (actorID, objectID)) AS n_edges FROM snap GROUP BY ALL) USING (snapshot_id)", LABELS, CLASSED)),
    "triple_split": (lambda s, d: embed.triple_split(triples(s, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n")), over_edges("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN u <= 0.8 THEN 'train' WHEN u <= 0.8::DOUBLE + 0.1::DOUBLE THEN 'test' ELSE 'validation' END AS part
        FROM (SELECT (('0x' || substr(md5(h || '|' || r || '|' || t), 1, 15))::BIGINT + 1)::DOUBLE / 1152921504606846976.0::DOUBLE AS u FROM tri)) GROUP BY part""", TRIPLES)),
    "vector_lookup": (vector_lookup, over_edges("""SELECT name, CASE WHEN name IN (SELECT h FROM tri) OR name = 'EVENT_CLICK' AND name IN (SELECT r FROM tri) THEN 'entity' WHEN name IN (SELECT r FROM tri) THEN 'relation' END AS kind,
        CASE WHEN name IN (SELECT h FROM tri) OR name IN (SELECT r FROM tri) THEN length(name)::DOUBLE END AS x FROM (SELECT t AS name FROM tri UNION SELECT r FROM tri)""", TRIPLES)),
    "snapshot_embeddings_als": (als, over_edges("SELECT DISTINCT day AS seq, 16 AS dim, true AS own_nearer FROM counts", DAY_CTE, HASHED, COUNTS)),
    "word2vec_relations": (word_vectors, MEMBERS + """ SELECT n, count(*) FILTER (half = 1) AS members, true AS own_nearer
        FROM (SELECT *, ('0x' || substr(md5(h), 1, 15))::BIGINT % 2 AS half FROM f) GROUP BY n HAVING min(half) = 0 AND max(half) = 1"""),
    "transe_vectors": (translations, MEMBERS + """ SELECT t, count(*) AS n, true AS true_nearer FROM f
        WHERE (('0x' || substr(md5(h || '|in_region|' || t), 1, 15))::BIGINT + 1)::DOUBLE / 1152921504606846976.0::DOUBLE > 0.8 GROUP BY t"""),
}
