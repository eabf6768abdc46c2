"""Queries on tables with larger groups than the test data has."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from provgraph import cluster
from provgraph.operators import community, detect, embed, lineage, reach, snapshots, wl
from provgraph.plans import features, graphs, streams
from provgraph.streaming import labels


def events(folder, rows):
    """An events table of rows (user, k, minute of the day, type)."""
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-03 00:00:00' + to_minutes(?), ?, ?, 1.0, ?)", [(i, minute, user, kind, f'{{"k": {k}}}') for i, (user, k, minute, kind) in enumerate(rows)])
    db.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["rsg_hashed", "rsg_counts", "rsg_snapshot_map"])
def test_hubs_with_more_ranges_than_parts_in_a_range(spark, against_sql, tmp_path, name):
    """200 neighbours with different texts are 17 ranges of 12."""
    rows = [(100 + i, 50, i, "click") for i in range(200)] + [(100 + i, 51 + i % 40, 300 + i, f"type{i}") for i in range(200)]
    query, sql = features.QUERIES[name]
    assert against_sql(query(spark, events(tmp_path, rows)), sql, str(tmp_path)) > 0


def test_pairs_with_a_common_resource_are_not_searched(spark, monkeypatch):
    """60 processes that start one hub and share a file with it: no row for each pair and neighbour of the hub."""
    edges = [(f"P{i}", "P0") for i in range(1, 61)] + [(f"P{i}", "F0") for i in range(61)] + [("P61", "P0"), ("P61", "P62"), ("P62", "F1"), ("F1", "P0")]
    names = {n for e in edges for n in e}
    g = spark.createDataFrame(edges, "src string, dst string")
    ty = spark.createDataFrame([(n, "SUBJECT_PROCESS" if n[0] == "P" else "FILE_OBJECT_BLOCK") for n in names], "name string, type string")
    rows, plain = [], lineage.checkpointed

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "checkpointed", counted)
    found = lineage.resource_path_lengths(g.where("dst = 'P0'  and src like 'P%'"), g, ty).collect()
    assert {(r.src, r.length) for r in found} == {(f"P{i}", 3) for i in range(1, 61)} | {("P61", 4)}
    assert max(rows) <= 4 * len(edges)


def test_node_budget_in_chunks(spark, monkeypatch):
    """Several time chunks, one scene absent from some of them, give the cuts of one, and no task of the replay has more rows than a chunk."""
    rows = [("s", f"n{i * 7 % 31}", f"n{i * 5 % 13}", i, i) for i in range(90)] + [("t", f"y{i % 9}", f"y{i % 7}", 40, 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "scene string, actorID string, objectID string, us long, event_id long").repartition(3)
    whole = {str(r) for r in snapshots.node_budget_snapshots(df, 6, 0.5).collect()}
    assert len(whole) > 5
    monkeypatch.setattr(snapshots, "CHUNK", 20)
    chunked, number = snapshots.time_chunks(df)
    assert number == 6 and max(r["count"] for r in chunked.groupBy("chunk").count().collect()) <= 30
    assert {str(r) for r in snapshots.node_budget_snapshots(df, 6, 0.5).collect()} == whole


def test_text_join_by_digest(spark, small, monkeypatch):
    """Heads and tails meet as digests."""
    seen, plain = [], graphs.graph.triples

    def watched(pairs, nodes):
        seen.append(nodes.selectExpr("max(length(array_join(properties, ' ')))").first()[0])
        return plain(pairs, nodes)

    monkeypatch.setattr(graphs.graph, "triples", watched)
    assert graphs.QUERIES["triple_text_join"][0](spark, small).count() > 0
    assert seen == [64]


def test_ranges_of_long_texts_have_short_bounds(spark, monkeypatch):
    """Numbers follow the order of whole texts, whose beginnings alone are sampled for the ranges."""
    texts = [c * 300 + d for c in "ba" for d in ("z", "", "y")] + ["a", "é", "zz"]
    plans, plain = [], cluster.checkpointed
    monkeypatch.setattr(cluster, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    found = cluster.dense_ids(spark.createDataFrame([(t,) for t in texts], "rsg string"), "rsg", "id").collect()
    assert [r.rsg for r in sorted(found, key=lambda r: r.id)] == sorted(texts)
    assert f", 1, {cluster.PREFIX})" in plans[0]


def test_translations_keep_one_round(spark, monkeypatch):
    """Of all rounds' tables those of the last stay, besides the facts."""
    made, plain = [], cluster.checkpointed

    def kept(df):
        made.append(plain(df))
        return made[-1]

    for module in (cluster, embed):
        monkeypatch.setattr(module, "checkpointed", kept)
    facts = [(f"m{i}", "in", f"n{i % 6}") for i in range(60)]
    found = embed.translation_vectors(spark.createDataFrame(facts, "h string, r string, t string"), 4, 4, 0.05, block=18, visits=2)
    assert found.count() == 67
    folders = {file.rsplit("/", 1)[0] for table in made for file in table.inputFiles()}
    assert len(made) > 10 and sum(cluster.path_exists(spark, f) for f in folders) == 2


def test_ancestors_pass_a_cycle_once(spark, monkeypatch):
    """300 vertices above a ring of twelve above five: no table has a row for each way through the ring."""
    edges = [(f"u{i}", f"r{i % 12}") for i in range(300)] + [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [(f"r{i}", f"k{j}") for i in range(12) for j in range(5)]
    rows, plain = [], lineage.checkpointed

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "checkpointed", counted)
    found = {tuple(r) for r in lineage.ancestors(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert found == {(a, b) for a in [f"r{i}" for i in range(12)] + [f"k{j}" for j in range(5)] for b in [f"u{i}" for i in range(300)] + [f"r{i}" for i in range(12)]}
    assert max(rows) <= 6 * 301


@pytest.mark.parametrize("name", ["rsg_depth2", "rsg_union"])
def test_hubs_texts_are_put_together_where_they_are_read(spark, against_sql, tmp_path, monkeypatch, name):
    """What is written of 100 neighbours of two hubs does not hold the hubs' texts once for each; texts beyond a block go to several."""
    rows = [(100 + i, k, i, f"type{i % 7}") for i in range(100) for k in ((50, 51) if i % 3 else (52,))] + [(100, 60 + i, 500, "click") for i in range(5)]
    written, plain = [], features.wl.checkpointed

    def measured(df):
        out = plain(df)
        written.append(sum(len(str(r)) for r in out.collect()))
        return out

    monkeypatch.setattr(features.wl, "checkpointed", measured)
    monkeypatch.setattr(features.wl, "LONG", 200, raising=False)
    query, sql = features.QUERIES[name]
    folder = events(tmp_path, rows)
    df = query(spark, folder)
    assert against_sql(df, sql, folder) > 0
    assert max(written) < df.selectExpr("sum(length(rsg))").first()[0] / 2
    monkeypatch.setattr(features.wl, "BLOCK", 3000, raising=False)
    assert against_sql(query(spark, folder), sql, folder) > 0


def test_joint_forecaster_takes_windows_by_slices(spark, monkeypatch):
    """No more than ``SLICE`` windows become features at a time, and slices change no sum."""
    rng = np.random.default_rng(3)
    seq = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "seq long, vec array<double>").repartition(2)
    windows = detect.lag_windows(seq, lags=4)
    cells = lambda: np.array([r["values"] for r in sorted(detect.joint_gram(windows, 4, 5).collect(), key=lambda r: r.i)])
    whole = cells()
    assert whole.shape == (5, 8)
    monkeypatch.setattr(detect, "SLICE", 3)
    batch = pa.RecordBatch.from_pydict({"vec": [[1.0]] * 10})
    assert [b.num_rows for b in detect.slices(iter([batch, batch]))] == [3, 3, 3, 1] * 2
    np.testing.assert_allclose(cells(), whole)


def test_clusters_pass_leaves_once(spark, monkeypatch):
    """300 processes above one that links to 30 resources: no row for each of them and a resource; two above a second process still join it."""
    users = [f"u{i:03}" for i in range(300)]
    edges = [(u, "hub") for u in users] + [("u000", "other"), ("u001", "apart"), ("u002", "last"), ("u001", "last")]
    links = [(f"r{i:02}", p) for i in range(30) for p in ("hub", "other", "apart", "u003")] + [("r30", "apart"), ("r30", "last"), ("r30", "other"), ("r30", "u001"), ("r31", "none")]
    rows, plain = [], reach.checkpointed

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(reach, "checkpointed", counted)
    found = {tuple(r) for r in reach.clusters_by_ancestors(spark.createDataFrame(links, "resource string, process string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    joined = {(f"r{i:02}", p, c) for i in range(30) for p, c in (("hub", "apart"), ("other", "apart"), ("apart", "apart"), ("u003", "u003"))}
    assert found == joined | {("r30", "apart", "apart"), ("r30", "last", "apart"), ("r30", "other", "other"), ("r30", "u001", "u001"), ("r31", "none", "none")}
    assert max(rows) <= 2 * len(edges)


def dense_factors(counts, start, rounds):
    """Implicit ALS with a full system for each row of a table of counts."""
    x, c = start, np.log1p(counts)
    for _ in range(rounds):
        solve = lambda v, c: np.linalg.solve(v.T @ v + (v.T * c) @ v + 0.1 * (c > 0).sum() * np.eye(v.shape[1]), ((1 + c) * (c > 0)) @ v)
        y = np.array([solve(x, column) for column in c.T])
        x = np.array([solve(y, row) for row in c])
    return x, y


def test_equal_profiles_are_solved_once(spark, monkeypatch):
    """400 features in the snapshots of five profiles, and some of their own: vectors of the full systems, and no table of vectors with a row for each feature."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 3, (9, 5)) * (rng.random((9, 5)) < 0.6) + np.eye(9, 5, dtype=int)
    counts = np.hstack([kinds[:, rng.integers(0, 5, 400)], rng.integers(1, 4, (9, 8))])
    rows = [(i, j, c) for i, line in enumerate(counts.tolist()) for j, c in enumerate(line) if c]
    sizes, plain = [], embed.checkpointed

    def counted(df):
        out = plain(df)
        if "vec" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(embed, "checkpointed", counted)
    start = lambda dim: np.array([r.v for r in spark.range(9).select(embed.start_vector(embed.F.concat_ws("|", embed.F.lit("7"), embed.F.col("id").cast("string")), dim).alias("v"), "id").orderBy("id").collect()])
    for dim in (4, 16):
        first = start(dim)
        want, texts = dense_factors(counts, first / np.linalg.norm(first, axis=1, keepdims=True), 3)
        snapshots, features = embed.shared_factors(spark.createDataFrame(rows, "seq long, rsg_id long, cnt long").repartition(3), dim, 3)
        np.testing.assert_allclose(np.array([r.vec for r in snapshots.orderBy("seq").collect()]), want, atol=1e-4)
        np.testing.assert_allclose(np.array([r.vec for r in features.orderBy("rsg_id").collect()]), texts, atol=1e-4)
    assert max(sizes) <= 13


def test_communities_broadcast_no_nodes(spark, monkeypatch):
    """No table with a row for each node is broadcast in a round; what is, has a row for each graph."""
    pairs = spark.createDataFrame([(f"n{i}", f"n{i // 8 * 8 + (i + d) % 8}") for i in range(64) for d in (1, 2, 3)] + [(f"n{8 * i}", f"n{8 * i + 8}") for i in range(7)], "src string, dst string")
    plans, plain = [], cluster.checkpointed

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    for module in (community, cluster):
        monkeypatch.setattr(module, "checkpointed", planned)
    found = community.bounded_communities(pairs, most=10, depth=1, rounds=4)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 64
    held = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 20 and all("[graph#" in line for line in held), held


def test_batches_of_many_files(spark, against_sql, tmp_path, monkeypatch):
    """The events are parsed once, a batch has a file for each task that writes it, and all its files are one micro-batch."""
    rows = [(100 + i % 7, i % 60, 1440 * (i % 28) + i, f"type{i % 3}") for i in range(300)]
    parsed, folders, plain, shared, edges = [], [], streams.checkpointed, streams.shared_folder, streams.tables.event_edges
    monkeypatch.setattr(streams, "checkpointed", lambda df: plain(df.repartition(3)))
    monkeypatch.setattr(streams, "shared_folder", lambda s, name: folders.append(shared(s, name)) or folders[-1])
    monkeypatch.setattr(streams.tables, "event_edges", lambda s, d: parsed.append(d) or edges(s, d))
    query, sql = streams.QUERIES["stream_wl_histogram"]
    folder = events(tmp_path, rows)
    assert against_sql(query(spark, folder), sql, folder) > 0
    assert len(parsed) == 1
    for i in range(4):
        files = [x for x in Path(f"{folders[0].removeprefix('file:')}/in/{i}").iterdir() if x.suffix == ".parquet"]
        assert len(files) > 1 and sorted(x.name for x in Path(f"{folders[0].removeprefix('file:')}/labels/updates").iterdir()) == [f"version={v}" for v in range(4)]


def test_words_are_trained_in_parts(spark, monkeypatch):
    """Words of one group lie together whichever part has them; a task has the sentences of its part, also of a hot head and of one that stands often."""
    facts = [(f"m{i}", "in", f"n{i % 4}") for i in range(600)] + [("hot", "in", f"n{i % 4}") for i in range(64)] + [("often", "in", "n1")] * 64 + [(None, "in", "n1")]
    triples = spark.createDataFrame(facts, "h string, r string, t string")
    dealt, parts = embed.dealt_sentences(triples, 64)
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(embed.F.sum("n").alias("n")).collect()}
    assert parts == 12 and len(sizes) == 12 and sum(sizes.values()) == 728 and max(sizes.values()) <= 2 * 64
    assert dealt.where("h = 'often'").select("part").distinct().count() > 1
    found = {r.word: np.array(r.vector) for r in embed.word_vectors(triples, 12, block=364).collect()}
    assert found.keys() == {x for f in facts[:-1] for x in f}
    unit = np.array([found[f"m{i}"] / np.linalg.norm(found[f"m{i}"]) for i in range(600)])
    near, same = unit @ unit.T, np.subtract.outer(np.arange(600), np.arange(600)) % 4 == 0
    assert near[same].mean() - near[~same].mean() > 0.3


def test_words_are_written_once_a_visit(spark, monkeypatch):
    """Vectors of words of one part are written by the visit that trains them, and by nothing else."""
    triples, written, plain = spark.createDataFrame([(f"m{i}", "in", f"n{i % 4}") for i in range(120)], "h string, r string, t string"), [], cluster.checkpointed

    def noted(df):
        table = plain(df)
        if "vec" in table.columns and table.where("name like 'm%'").count():
            written.append(table.count())
        return table

    monkeypatch.setattr(cluster, "checkpointed", noted)
    monkeypatch.setattr(embed, "checkpointed", noted)
    found = embed.word_vectors(triples, 4, rounds=6, block=40, visits=3)
    assert found.count() == 125 and len(written) == 3


def test_neighbours_from_edges_kept_once(spark):
    """Both directions are made when edges are read: the same rows as distinct neighbours, also where an action is another's reverse."""
    rows = [("a", "b", "X"), ("b", "a", "rev_X"), ("b", "a", "X"), ("c", "c", "Y"), ("a", "c", "rev_rev_X"), ("c", "a", "rev_X"), ("a", "d", None), (None, "a", "X"), ("a", None, "X")]
    edges = spark.createDataFrame(rows, "src string, dst string, action string")
    want = wl.typed_neighbours(edges, []).where("name is not null and other is not null").select("name", "other", "type")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(labels.both_ways(edges)) == key(want) and want.count() == 12


def test_labels_join_no_frontier_that_is_whole(spark, tmp_path, monkeypatch):
    """Edges are stored in one direction, and where a batch's edges touch all nodes, no row is looked up in a frontier; where they touch a few, the rows are theirs."""
    kept, plain = [], labels.rows_of
    monkeypatch.setattr(labels, "rows_of", lambda near, names, known: kept.append((near, *plain(near, names, known))) or kept[-1][1:])
    store = labels.PersistentLabels(str(tmp_path / "labels"), 2)
    ring = [(f"n{i}", f"n{(i + 1) % 12}", "E") for i in range(12)]
    for version, rows in enumerate((ring, ring[:11] + [(None, "n1", "E")], ring[:1], ring[:8])):
        store.step(spark.createDataFrame(rows, "src string, dst string, action string"), version)
    assert [whole for _, _, whole in kept] == [True, True, True, True, False, False, False, False] and all(rows is near for near, rows, whole in kept if whole)
    assert sorted(r.name for r in kept[4][1].collect()) == ["n0", "n0", "n1", "n1"]
    assert sorted({r.name for r in kept[5][1].collect()}) == ["n0", "n1", "n11", "n2"]
    assert spark.read.parquet(str(tmp_path / "labels" / "near_full" / "version=0")).count() == 12
    got = {(r.version, r["round"], r.name): r.label for r in store.updates(spark).collect()}
    assert {k[2] for k in got if k[:2] == (2, 2)} == {"n0", "n1", "n11", "n2"} and len({k[2] for k in got if k[:2] == (3, 2)}) == 11


def test_persistent_edges_are_stored_once(spark, tmp_path, monkeypatch):
    """A batch that touches all nodes writes its edges in one direction, and no adjacency beside them."""
    written, plain = [], labels.checkpointed
    monkeypatch.setattr(labels, "checkpointed", lambda df: written.append(plain(df)) or written[-1])
    ring = [(f"n{i}", f"n{(i + 1) % 12}", "E") for i in range(12)]
    updates = labels.PersistentLabels(str(tmp_path / "labels"), 2).step(spark.createDataFrame(ring, "src string, dst string, action string"), 0)
    assert updates.count() == 24 and spark.read.parquet(str(tmp_path / "labels" / "near" / "version=0")).count() == 12
    assert max(table.count() for table in written) == 12
