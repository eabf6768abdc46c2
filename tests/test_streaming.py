"""Streams give what the batch operators give."""

from __future__ import annotations

import hashlib
import random

import pytest

from provgraph import streaming
from provgraph.operators import detect, quantiles, snapshots
from provgraph.streaming import labels
from provgraph.registry import EMBEDDERS, SOURCES, DotSource, create


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_node_budget(spark, tmp_path):
    """Batch and stream agree to the last column, nodes that come back among them, and the state follows the budget and not the scene."""
    rows = [("s", f"n{i * 7 % 11}", f"n{i * 5 % 13}", i, i) for i in range(60)] + [("s", f"x{i}", f"x{i // 2}", 60 + i, 60 + i) for i in range(300)] + [("s", "n1", "n2", 900, 900)]
    rows += [("t", f"y{i % 9}", f"y{i % 7}", i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "scene string, src string, dst string, us long, event_id long")
    stream = feed(spark, tmp_path / "in", [df.where("us < 30"), df.where("us >= 30 and us < 200"), df.where("us >= 200")])
    query = streaming.run_available(streaming.stream_node_budget(stream, 4, 0.5), str(tmp_path / "out"), str(tmp_path / "cp"))
    cuts = spark.read.parquet(str(tmp_path / "out"))
    got = {str(r) for r in snapshots.with_frequencies(cuts).collect()}
    batch = snapshots.node_budget_snapshots(df.withColumnRenamed("src", "actorID").withColumnRenamed("dst", "objectID"), 4, 0.5).collect()
    last = {scene: max(r.snapshot_id for r in batch if r.scene == scene) for scene in ("s", "t")}
    assert got == {str(r) for r in batch if r.snapshot_id != last[r.scene]} and len(got) > 100
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= 2 * (6 + 6 * 6 + 1)


def test_scores(spark, tmp_path):
    df = spark.createDataFrame([("s", i, [float(i % 4), 1.0]) for i in range(20)], "scene string, seq long, vec array<double>")
    stream = feed(spark, tmp_path / "in", [df.where("seq < 9"), df.where("seq >= 9")])
    streaming.run_available(streaming.stream_scores(stream, threshold=0.5), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.seq: (round(r.error, 9), r.flag) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.seq: (round(r.error, 9), r.flag) for r in detect.scores(detect.mean_forecast(detect.lag_windows(df.select("seq", "vec"))), 0.5).collect()}
    assert got == want


def test_benign_thresholds_of_batch_and_stream(spark, tmp_path):
    """The stream ends with the batch's thresholds, no further from the sorted errors than promised, and a batch that is run again changes nothing."""
    import math

    draw = random.Random(3)
    rows = [(f"s{i % 3}", i, draw.choice([0.0, 10 ** draw.uniform(-6, 4)]), int(draw.random() < 0.2)) for i in range(600)]
    rows += [("s0", 600, None, 0), ("s0", 601, float("nan"), 0), ("s0", 602, float("inf"), 0), ("bad", 603, 1.0, 1)]
    df = spark.createDataFrame(rows, "scene string, seq long, error double, truth int")
    parts = [df.where("seq < 200"), df.where("seq >= 200 and seq < 450"), df.where("seq >= 450")]
    sink = streaming.BenignThreshold(str(tmp_path / "t"), 0.9, 0.016)
    feed(spark, tmp_path / "in", parts).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {r.scene: r.threshold for r in sink.threshold(spark, 2).collect()}
    assert last == {r.scene: r.threshold for r in quantiles.benign_threshold(df, ["scene"], 0.9).collect()}

    def exact(scene, before):
        found = sorted(e for s, i, e, t in rows if s == scene and i < before and not t and e is not None and math.isfinite(e))
        return found[math.ceil(0.9 * len(found)) - 1]

    assert last.keys() == {"s0", "s1", "s2"}
    for scene, threshold in last.items():
        assert exact(scene, 999) <= threshold * (1 + 1e-9) and threshold <= exact(scene, 999) * quantiles.growth() * (1 + 1e-9)
    flags = {r.seq: r for r in sink.flags(spark).collect()}
    assert len(flags) == len(rows) and flags[603].threshold == flags[0].threshold == 0.016 and flags[603].flag == 1
    for i in (200, 449, 450, 599):
        assert exact(rows[i][0], 200 if i < 450 else 450) <= flags[i].threshold * (1 + 1e-9) and flags[i].flag == int(rows[i][2] > flags[i].threshold)
    sink(parts[2], 2)
    assert {r.scene: r.threshold for r in sink.threshold(spark, 2).collect()} == last and sink.flags(spark).count() == len(rows)
    assert quantiles.benign_threshold(df.limit(0), [], 0.9).count() == 0


def test_detector_by_quantile_saved_and_loaded(spark, tmp_path):
    from provgraph.registry import DETECTORS

    seq = spark.createDataFrame([(i, [float(i % 3), float(i * i % 7)]) for i in range(80)], "seq long, vec array<double>")
    model = create(DETECTORS, "autoregression", quantile=0.9, lags=4)
    model.train(seq)
    found = {r.seq: (r.error, r.flag) for r in model.predict(seq).collect()}
    assert 0 < sum(flag for _, flag in found.values()) <= 8
    model.save(str(tmp_path / "model"))
    again = create(DETECTORS, "autoregression")
    with pytest.raises(ValueError):
        again.predict(seq)
    again.load(spark, str(tmp_path / "model"))
    assert (again.lags, again.threshold, again.quantile) == (4, model.threshold, 0.9)
    assert {r.seq: (r.error, r.flag) for r in again.predict(seq).collect()} == found


def test_decaying_histogram(spark, tmp_path):
    import math

    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.0), ("a", 3.0)], "label string, t double")
    stream = feed(spark, tmp_path / "in", [df.where("t < 2"), df.where("t >= 2")])
    sink = streaming.DecayingHistogram(str(tmp_path / "hist"), 0.1)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.label: round(r.weight, 9) for r in sink.read(spark, 1).collect()}
    assert got == {"a": round(math.exp(-0.3) + math.exp(-0.2) + 1, 9), "b": round(math.exp(-0.2), 9)}


def test_labels_persist_over_snapshots(spark, tmp_path, monkeypatch):
    """By a replay in plain Python: neighbours add up, the frontier grows by a step a round, labels stay. Full tables are written on the way, and a
    batch's plan is as large as one a period before."""
    monkeypatch.setattr(labels, "COMPACT", 3)
    rng = random.Random(2)
    h = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    store = labels.PersistentLabels(str(tmp_path / "labels"), 2, spark.createDataFrame([("n1", "first one")], "name string, label string"))
    near, state, want, sizes = {}, {}, set(), []
    for version in range(8):
        rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("EF")) for _ in range(4)]
        ends = set()
        for a, b, t in rows:
            near.setdefault(a, set()).add((b, t))
            near.setdefault(b, set()).add((a, "rev_" + t))
            ends |= {a, b}
        for n in near:
            state.setdefault(n, "first one" if n == "n1" else n)
        frontier = ends
        for r in (1, 2):
            now = {}
            for n in frontier:
                mix = 0
                for other, t in near[n]:
                    mix ^= h(f"{t}|{state[other]}")
                now[n] = str(h(state[n]) ^ mix)
            state |= now
            want |= {(version, r, n, label) for n, label in now.items()}
            frontier = {other for n in frontier for other, _ in near[n]}
        edges = spark.createDataFrame(rows, "src string, dst string, action string")
        store.step(edges, version)
        if version in (2, 5):
            store.step(edges, version)  # run again after a failure
        sizes.append(len(store.labels(spark, version)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert {(r.version, r["round"], r.name, r.label) for r in store.updates(spark).collect()} == want
    final = {r.name: r.label for r in store.labels(spark, 7).collect()}
    assert final == {n: state[n] for n in final} and set(final) == {x[2] for x in want}
    assert sizes[4] == sizes[7] and not (tmp_path / "labels" / "labels" / "version=0").exists() and (tmp_path / "labels" / "near_full" / "version=6").exists()


def test_registry():
    assert create(SOURCES, "ATLAS", budget=7, nonsense=1) == DotSource(budget=7)
    assert create(EMBEDDERS, "Word2Vec").dim == 30
    with pytest.raises(ValueError):
        create(SOURCES, "nowhere")
