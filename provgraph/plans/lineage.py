"""Queries on lineage and communities of the events' graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from provgraph.cluster import checkpointed
from provgraph.operators import community, graph, lineage, reach
from provgraph.sources import tables

from .base import Query, over_edges

G = "g AS (SELECT DISTINCT actorID AS src, objectID AS dst FROM e), ty AS (SELECT DISTINCT ON (name) name, type FROM ends ORDER BY name, us, event_id, side)"
UP = "up AS (SELECT dst AS node, src AS ancestor FROM g UNION SELECT g.dst, up.ancestor FROM up JOIN g ON g.src = up.node)"
LINKS = """links AS (SELECT DISTINCT dst AS resource, src AS process FROM g JOIN ty a ON a.name = src JOIN ty b ON b.name = dst WHERE a.type = 'SUBJECT_PROCESS' AND b.type <> 'SUBJECT_PROCESS')"""
CLUSTERS = """shared AS (SELECT l.resource, l.process, m.process AS mate FROM links l JOIN links m USING (resource) WHERE l.process = m.process OR EXISTS (SELECT 1 FROM up a JOIN up b USING (ancestor) WHERE a.node = l.process AND b.node = m.process)),
cl(resource, process, mate) AS (SELECT * FROM shared UNION SELECT c.resource, c.process, s.mate FROM cl c JOIN shared s ON s.resource = c.resource AND s.process = c.mate),
clusters AS (SELECT resource, process, min(mate) AS cluster FROM cl GROUP BY ALL)"""
COMP = "und AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), reach AS (SELECT a AS node, b AS other FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON u.a = r.other), comp AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node)"
PATHS = """un AS (SELECT src AS a, dst AS b FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst),
pp AS (SELECT src, dst FROM g JOIN ty a ON a.name = src JOIN ty b ON b.name = dst WHERE a.type = 'SUBJECT_PROCESS' AND b.type = 'SUBJECT_PROCESS'),
res AS (SELECT name FROM ty WHERE type <> 'SUBJECT_PROCESS'),
l3 AS (SELECT DISTINCT src, dst FROM pp JOIN un x ON x.a = src JOIN un y ON y.a = x.b AND y.b = dst WHERE src <> dst AND x.b IN (SELECT name FROM res)),
l4 AS (SELECT DISTINCT src, dst FROM (SELECT * FROM pp WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM l3)) JOIN un x ON x.a = src JOIN un y ON y.a = x.b JOIN un z ON z.a = y.b AND z.b = dst
  WHERE x.b NOT IN (src, dst) AND y.b NOT IN (src, dst) AND x.b <> y.b AND (x.b IN (SELECT name FROM res) OR y.b IN (SELECT name FROM res))),
walk(src, dst, here, seen, passed, n) AS (
  SELECT src, dst, src, [src], false, 1 FROM pp WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM l3) AND (src, dst) NOT IN (SELECT (src, dst) FROM l4)
  UNION ALL SELECT w.src, w.dst, u.b, list_append(w.seen, u.b), w.passed OR u.b IN (SELECT name FROM res), w.n + 1 FROM walk w JOIN un u ON u.a = w.here WHERE w.n < 11 AND w.here <> w.dst AND NOT list_contains(w.seen, u.b)),
lens AS (SELECT src, dst, 3 AS length FROM l3 UNION ALL SELECT src, dst, 4 FROM l4 UNION ALL SELECT src, dst, min(n) FROM walk WHERE here = dst AND passed GROUP BY ALL)"""


def lp_cte(rounds: int) -> str:
    step = lambda n: f"lp{n} AS (SELECT node, arg_min(label, (-n, label)) AS label FROM (SELECT x.node, l.label, count(*) AS n FROM adj x JOIN lp{n - 1} l ON l.node = x.other GROUP BY ALL) GROUP BY node)"
    return ", ".join(["adj AS (SELECT src AS node, dst AS other FROM g UNION ALL SELECT dst, src FROM g)", "lp0 AS (SELECT DISTINCT node, node AS label FROM adj)", *map(step, range(1, rounds + 1))])


def pairs(s, d):
    return tables.event_edges(s, d).select(F.col("actorID").alias("src"), F.col("objectID").alias("dst")).distinct()


def types(s, d):
    return graph.node_types(tables.event_edges(s, d)).select("name", "type")


def links(s, d):
    return lineage.resource_links(pairs(s, d), types(s, d))


def clusters(s, d):
    return reach.clusters_by_ancestors(links(s, d), pairs(s, d))


def rounded(df, column="weight"):
    return df.withColumn(column, F.round(column, 9))


def overlap(s, d):
    """Pairs of linked processes that share an ancestor."""
    p = pairs(s, d)
    below = p.select(F.col("dst").alias("src")).distinct()
    found = reach.share_ancestor(p.join(below, "src", "left_semi").toDF("x", "y"), p)
    return found.toDF("src", "dst", "shared")


def number_membership(s, d):
    p = pairs(s, d)
    nodes = p.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return p, nodes.select("node", (F.substring("node", 2, 9).cast("int") % 5).alias("community"))


def related(s, d):
    p = pairs(s, d)
    return lineage.related(p, p.select(F.col("src").alias("x"), F.lit("k50").alias("y")).distinct())


def bounded(s, d):
    """What holds of bounded communities: every node is in one, numbers have no gaps, each is connected, and the modularity is above that of label propagation."""
    p = checkpointed(pairs(s, d))
    found = community.kept(community.bounded_communities(p, most=120, least=1))
    one, two = found.toDF("src", "a"), found.toDF("dst", "b")
    inner = p.join(one, "src").join(two, "dst").where("a = b")
    apart = found.join(lineage.components(inner, merged=True), "node", "left").select("community", F.coalesce("root", "node").alias("root")).distinct()
    counts = found.agg(F.count_distinct("node").alias("nodes"), F.count_distinct("community").alias("n"), F.max("community").alias("last"))
    score = lambda m: community.modularity(p, m).select(F.col("modularity"))
    other = score(community.label_propagation(p, 3).withColumnRenamed("label", "community")).withColumnRenamed("modularity", "propagated")
    both = counts.crossJoin(apart.agg(F.count(F.lit(1)).alias("parts"))).crossJoin(score(found)).crossJoin(other)
    return both.select("nodes", (F.col("last") + 1 == F.col("n")).alias("numbered"), (F.col("parts") == F.col("n")).alias("connected"), (F.col("modularity") > F.col("propagated")).alias("above_propagation"))


def community_snapshots(s, d):
    """Vertices and edges of every community as a snapshot."""
    p, membership = number_membership(s, d)
    vertices, edges = community.community_snapshots(membership.select(F.col("node").alias("name")), p, membership)
    n_edges = edges.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"))
    counted = vertices.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("nodes")).join(n_edges, "snapshot_id", "left")
    return counted.select(F.col("snapshot_id").alias("community"), "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "ancestors": (lambda s, d: lineage.ancestors(pairs(s, d)), over_edges("SELECT node, ancestor FROM up", G, UP)),
    "components": (lambda s, d: lineage.components(pairs(s, d)), over_edges("SELECT node, root FROM comp", G, COMP)),
    "related_nodes": (related, over_edges("SELECT DISTINCT src AS x, 'k50' AS y, coalesce((SELECT root FROM comp WHERE node = src) = (SELECT root FROM comp WHERE node = 'k50'), false) AS related FROM g", G, COMP)),
    "resource_access": (lambda s, d: lineage.resource_access(links(s, d)).withColumn("processes", F.array_join("processes", "|")), over_edges("SELECT resource, string_agg(process, '|' ORDER BY process) AS processes FROM links GROUP BY resource", G, LINKS)),
    "shared_ancestor_clusters": (clusters, over_edges("SELECT resource, process, cluster FROM clusters", G, UP, LINKS, CLUSTERS)),
    "resource_weights": (lambda s, d: rounded(lineage.resource_weights(links(s, d), clusters(s, d))), over_edges("""SELECT resource, process, round(n::DOUBLE / sum(n) OVER (PARTITION BY resource), 9) AS weight
        FROM (SELECT resource, process, count(*) OVER (PARTITION BY resource, cluster) AS n FROM clusters)""", G, UP, LINKS, CLUSTERS)),
    "ancestor_overlap": (overlap, over_edges("SELECT src, dst, EXISTS (SELECT 1 FROM up a JOIN up b USING (ancestor) WHERE a.node = src AND b.node = dst) AS shared FROM g WHERE src IN (SELECT node FROM up) AND dst IN (SELECT node FROM up)", G, UP)),
    "resource_paths": (lambda s, d: lineage.resource_path_lengths(pairs(s, d).join(types(s, d).where("type = 'SUBJECT_PROCESS'").select(F.col("name").alias("dst")), "dst", "left_semi"), pairs(s, d), types(s, d)), over_edges("SELECT src, dst, length FROM lens", G, PATHS)),
    "process_weights": (lambda s, d: rounded(lineage.process_weights(pairs(s, d), types(s, d)).select("src", "dst", "weight")), over_edges("""SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS weight FROM (
        SELECT src, dst, CASE WHEN length IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE * (1 + 5.0::DOUBLE / length) END AS w FROM pp LEFT JOIN lens USING (src, dst))""", G, PATHS)),
    "normalised_weights": (lambda s, d: rounded(lineage.normalised(tables.event_edges(s, d).groupBy(F.col("actorID").alias("src"), F.col("objectID").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")))), over_edges("SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS weight FROM (SELECT actorID AS src, objectID AS dst, count(*)::DOUBLE AS w FROM e GROUP BY ALL)")),
    "label_propagation": (lambda s, d: community.label_propagation(pairs(s, d), 3), over_edges("SELECT node, label FROM lp3", G, lp_cte(3))),
    "community_members": (lambda s, d: community.members(community.label_propagation(pairs(s, d), 2).withColumnRenamed("label", "community")).withColumn("members", F.array_join("members", "|")), over_edges("SELECT label AS community, string_agg(node, '|' ORDER BY node) AS members FROM lp2 GROUP BY label", G, lp_cte(2))),
    "community_snapshots": (community_snapshots, over_edges("""SELECT a.community, a.nodes, coalesce(b.edges, 0) AS edges FROM (SELECT CAST(substr(n, 2) AS INT) % 5 AS community, count(*) AS nodes FROM (SELECT src AS n FROM g UNION SELECT dst FROM g) GROUP BY ALL) a
        LEFT JOIN (SELECT CAST(substr(src, 2) AS INT) % 5 AS community, count(*) AS edges FROM g WHERE CAST(substr(src, 2) AS INT) % 5 = CAST(substr(dst, 2) AS INT) % 5 GROUP BY ALL) b USING (community)""", G)),
    "modularity_score": (lambda s, d: community.modularity(*number_membership(s, d)).select(F.round("modularity", 9).alias("modularity")), over_edges("""SELECT round(sum(inner_ / m - o * i / (m * m)), 9) AS modularity FROM (
        SELECT c, sum(o)::DOUBLE AS o, sum(i)::DOUBLE AS i, sum(n)::DOUBLE AS inner_, (SELECT count(*) FROM g)::DOUBLE AS m FROM (
          SELECT CAST(substr(src, 2) AS INT) % 5 AS c, 1 AS o, 0 AS i, (CAST(substr(src, 2) AS INT) % 5 = CAST(substr(dst, 2) AS INT) % 5)::INT AS n FROM g
          UNION ALL SELECT CAST(substr(dst, 2) AS INT) % 5, 0, 1, 0 FROM g) GROUP BY c)""", G)),
    "bounded_communities": (bounded, over_edges("SELECT count(*) AS nodes, true AS numbered, true AS connected, true AS above_propagation FROM (SELECT src FROM g UNION SELECT dst FROM g)", G)),
}
