"""Cases worked by hand: the toy process graph, the node budget, windows, communities, sources."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provgraph.functions import mask_events, mask_events_in_array, mask_events_in_map
from provgraph.operators import community, detect, edges, embed, graph, lineage, reach, report, snapshots, wl
from provgraph.plans.lineage import PATHS
from provgraph.schema import entity_types
from provgraph.sources import cdm, dot

#: Processes A to F, a file G and a socket N: a chain through the file, a process that writes it alone, and a ring that closes over the socket.
SMALL_GRAPH = [("A", "B"), ("B", "G"), ("F", "G"), ("G", "C"), ("G", "D"), ("E", "D"), ("E", "C"), ("C", "N"), ("E", "N"), ("A", "N")]


@pytest.fixture(scope="module")
def toy(spark):
    pairs = spark.createDataFrame(SMALL_GRAPH, "src string, dst string")
    kinds = [(name, "SUBJECT_PROCESS") for name in "ABCDEF"] + [("N", "NETFLOW_OBJECT"), ("G", "FILE_OBJECT_BLOCK")]
    return pairs, spark.createDataFrame(kinds, "name string, type string")


def test_ancestors(toy):
    found = {}
    for r in lineage.ancestors(toy[0]).collect():
        found.setdefault(r.node, set()).add(r.ancestor)
    assert found == {"B": {"A"}, "G": set("ABF"), "C": set("ABEFG"), "D": set("ABEFG"), "N": set("ABCEFG")}


def test_ancestors_on_a_cycle(spark):
    found = {tuple(r) for r in lineage.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).collect()}
    assert found == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}


def test_resource_access_and_clusters(toy):
    links = lineage.resource_links(*toy)
    assert {r.resource: r.processes for r in lineage.resource_access(links).collect()} == {"G": ["B", "C", "D", "F"], "N": ["A", "C", "E"]}
    clusters = reach.clusters_by_ancestors(links, toy[0])
    assert {(r.resource, r.process): r.cluster for r in clusters.collect()} == {("G", "B"): "B", ("G", "C"): "B", ("G", "D"): "B", ("G", "F"): "F", ("N", "A"): "A", ("N", "C"): "C", ("N", "E"): "E"}
    weights = {(r.resource, r.process): round(r.weight, 6) for r in lineage.resource_weights(links, clusters).collect()}
    assert [weights[("G", p)] for p in "BCDF"] == [0.3, 0.3, 0.3, 0.1] and weights[("N", "A")] == 0.333333


def closure(pairs):
    up = {}
    for a, b in pairs:
        up.setdefault(b, set()).add(a)
    done = {}
    for node in {n for p in pairs for n in p}:
        seen, todo = set(), [node]
        while todo:
            for a in up.get(todo.pop(), ()):
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        done[node] = seen
    return done


def test_ancestors_shared_without_the_closure(spark):
    """Random graphs with cycles, self-loops and many roots, against sets of all ancestors; labels of two roots leave pairs to search for."""
    rng = random.Random(9)
    pairs = [(f"g{g}n{rng.randrange(16)}", f"g{g}n{rng.randrange(16)}") for g in range(4) for _ in range(14)] + [(f"r{i}", "m") for i in range(6)] + [("m", "x"), ("r5", "y"), ("r6", "y"), ("r7", "y"), ("r6", "z"), ("r8", "z"), ("r9", "z")]
    up = closure(pairs)
    g = spark.createDataFrame(pairs, "src string, dst string")
    parts = {r.node: (r.root, r.cyclic) for r in reach.strong_components(g).collect()}
    same = lambda a, b: a == b or (a in up[b] and b in up[a])
    assert parts == {n: (min(m for m in up if same(n, m)), n in up[n]) for n in up}
    names = sorted(up)
    asked = [tuple(rng.sample(names, 2)) for _ in range(150)] + [("x", "y"), ("y", "z"), ("x", "z"), ("x", "absent"), ("r0", "r0"), ("m", "r0")]
    found = {(r.x, r.y): r.shared for r in reach.share_ancestor(spark.createDataFrame(asked, "x string, y string"), g, 2).collect()}
    assert found == {(a, b): bool(up.get(a, set()) & up.get(b, set())) for a, b in asked}
    links = sorted({(f"res{i % 5}", rng.choice(names)) for i in range(60)}) + [("res0", "absent")]
    want, left = {}, {}
    for resource, p in links:
        left.setdefault(resource, []).append(p)
    for resource, processes in left.items():
        for p in processes:
            group, todo = {p}, [p]
            while todo:
                q = todo.pop()
                for other in processes:
                    if other not in group and up.get(q, set()) & up.get(other, set()):
                        group.add(other)
                        todo.append(other)
            want[resource, p] = min(group)
    assert {(r.resource, r.process): r.cluster for r in reach.clusters_by_ancestors(spark.createDataFrame(links, "resource string, process string"), g).collect()} == want


def test_process_weights(toy):
    found = {(r.src, r.dst): round(r.weight, 6) for r in lineage.process_weights(*toy).collect()}
    assert found == {("A", "B"): 1.0, ("E", "D"): 0.457627, ("E", "C"): 0.542373}
    wanted = toy[0].where("dst in ('B', 'C', 'D') and src <> 'G'")
    assert {(r.src, r.dst, r.length) for r in lineage.resource_path_lengths(wanted, *toy).collect()} == {("A", "B", 5), ("E", "D", 4), ("E", "C", 3)}


def shortest_by_resource(pairs, kinds, src, dst, longest):
    """All simple paths, one after another."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    best, stack = None, [[src]]
    while stack:
        path = stack.pop()
        for node in near.get(path[-1], ()):
            if node == dst and any(kinds[n] != "SUBJECT_PROCESS" for n in path[1:]):
                best = min(best or longest, len(path) + 1)
            elif node != dst and node not in path and len(path) + 2 <= longest:
                stack.append([*path, node])
    return best


def kinds_of(pairs):
    return {n: "SUBJECT_PROCESS" if n[0] in "PQ" else "FILE_OBJECT_BLOCK" for p in pairs for n in p}


def path_lengths(spark, pairs, wanted, longest=11, **settings):
    g, ty = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(list(kinds_of(pairs).items()), "name string, type string")
    found = lineage.resource_path_lengths(spark.createDataFrame(list(wanted), "src string, dst string"), g, ty, longest, **settings).collect()
    assert len({(r.src, r.dst) for r in found}) == len(found)
    return {(r.src, r.dst): r.length for r in found}


#: From P0 to P1 the shortest walks by way of a resource turn back at P2; a simple path must go round.
TRAPS = [("P0", "P2"), ("P2", "P1"), ("P2", "F0"), ("F0", "P3"), ("P3", "P4"), ("P4", "P1"), ("P0", "P1"), ("P2", "F1"), ("F1", "P5"), ("P5", "P2"), ("P2", "F2")]


CROSSING = [("Q0", "Q1"), ("Q0", "Q2"), ("Q2", "Q3"), ("Q3", "G0"), ("G0", "Q4"), ("Q4", "Q2"), ("Q4", "Q1"), ("Q3", "Q5"), ("Q5", "Q1"), ("Q0", "Q6"), ("Q6", "Q7"), ("Q7", "Q3")]


def test_shortest_walks_that_turn_back(spark):
    want = {("P0", "P1"): 6, ("P2", "P5"): 3, ("P1", "P4"): 5, ("P0", "P2"): 6}
    others = [(a, b) for a in ("Q0", "Q2", "Q5") for b in ("Q1", "Q4", "Q6")]
    wanted = [*want, *others]
    want |= {(a, b): n for a, b in others if (n := shortest_by_resource(CROSSING, kinds_of(CROSSING), a, b, 11))}
    assert path_lengths(spark, TRAPS + CROSSING, wanted, at_once=1) == want


def test_random_graphs_against_all_simple_paths(spark):
    """Three graphs at once, cut vertices among them; every pair of processes."""
    rng, edges, wanted = random.Random(11), [], []
    for g in range(8):
        nodes = [f"P{g}_{i}" for i in range(6)] + [f"F{g}_{i}" for i in range(2)]
        edges += [tuple(rng.sample(nodes, 2)) for _ in range(11)]
        wanted += [(a, b) for a in nodes[:6] for b in nodes[:6] if a < b]
    kinds = kinds_of(edges)
    wanted = [(a, b) for a, b in wanted if a in kinds and b in kinds]
    want = {(a, b): n for a, b in wanted if (n := shortest_by_resource(edges, kinds, a, b, 8))}
    assert len(set(want.values())) >= 4 and path_lengths(spark, edges, wanted, 8) == want


def test_dense_graph_in_bounded_rows(spark, monkeypatch):
    """200 processes, most joined to one another: no round has more rows than pairs times vertices times the two ends."""
    rng = random.Random(3)
    edges = [(f"P{i}", f"P{j}") for i in range(200) for j in range(i + 1, 200) if rng.random() < 0.6] + [("P7", "F0"), ("F0", "P8"), ("P9", "F1")]
    wanted = [(f"P{i}", f"P{i + 1}") for i in range(20, 30)]
    rows, plain = [], lineage.checkpointed

    def counted(df):
        out = plain(df)
        rows.append(out.count() if "src" in out.columns and "at" in out.columns else 0)
        return out

    monkeypatch.setattr(lineage, "checkpointed", counted)
    found = path_lengths(spark, edges, wanted)
    joined = {frozenset(e) for e in edges}
    want = {}
    for s, t in wanted:
        one = any(frozenset((a, x)) in joined and frozenset((b, y)) in joined for a, b in ((s, t), (t, s)) for x, y in (("P7", "P8"),))
        want[(s, t)] = 5 if one else 6
    assert found == want
    assert max(rows) <= len(wanted) * 202 * 2


def test_resource_paths_of_up_to_eleven_vertices(spark, against_sql, small):
    ring = [(f"P{i}", f"P{i + 1}") for i in range(9)] + [("P9", "F0"), ("P0", "F0"), ("P0", "P9")]  # eleven vertices from P0 to P1
    rng = random.Random(5)
    sparse = [(f"Q{rng.randrange(14)}", rng.choice("QG") + str(rng.randrange(14))) for _ in range(24)]
    lone = [("R0", "R1"), ("R1", "R1"), ("R1", "R2")]
    pairs = ring + sparse + lone
    kinds = {n: "SUBJECT_PROCESS" if n[0] in "PQR" else "FILE_OBJECT_BLOCK" for pair in pairs for n in pair}
    g = spark.createDataFrame(pairs, "src string, dst string")
    ty = spark.createDataFrame(list(kinds.items()), "name string, type string")
    wanted = {(a, b) for a, b in pairs if a != b and kinds[a] == kinds[b] == "SUBJECT_PROCESS"}
    for longest in (10, 11):
        want = {(a, b, n) for a, b in wanted if (n := shortest_by_resource(pairs, kinds, a, b, longest)) is not None and n <= longest}
        found = lineage.resource_path_lengths(spark.createDataFrame(list(wanted), "src string, dst string"), g, ty, longest).cache()
        assert {tuple(r) for r in found.collect()} == want
        assert (("P0", "P1", 11) in want) == (longest == 11)
    tables = "SELECT DISTINCT src, dst FROM pairs_"
    against_sql(found, f"WITH RECURSIVE g AS ({tables}), ty AS (SELECT * FROM kinds_), {PATHS} SELECT src, dst, length FROM lens", small, pairs_=g.toPandas(), kinds_=ty.toPandas())
    assert lineage.resource_path_lengths(g.limit(0), g, ty).collect() == []


def test_weight_listing(spark):
    rows = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    assert lineage.weight_listing(rows).first().line == "a -> b: 0.5000"


def replay(rows, budget, rate):
    seen, frequency, cut, out = {}, {}, False, []
    for src, dst, us in rows:
        for n in (src, dst):
            seen[n] = us
            frequency[n] = frequency.get(n, 0) + 1
        if not cut and len(seen) >= budget:
            cut = True
            out.append((sorted(seen), us, [frequency[n] for n in sorted(seen)]))
        elif cut and len(seen) >= budget + int(budget * rate):
            for n in sorted(seen, key=lambda n: seen[n])[: int(budget * rate)]:
                del seen[n]
            out.append((sorted(seen), us, [frequency[n] for n in sorted(seen)]))
    return [*out, (sorted(seen), rows[-1][2], [frequency[n] for n in sorted(seen)])]


def test_node_budget(spark):
    rows = [(f"n{i * 7 % 11}", f"n{i * 5 % 13}", i) for i in range(60)]
    df = spark.createDataFrame([("s", a, b, t, t) for a, b, t in rows], "scene string, actorID string, objectID string, us long, event_id long")
    found = sorted(snapshots.node_budget_snapshots(df, 4, 0.5).collect(), key=lambda r: r.snapshot_id)
    assert [(r.nodes, r.until_us, r.frequencies) for r in found] == replay(rows, 4, 0.5)


def test_inference_windows(spark):
    seq = spark.createDataFrame([(i, [float(i + 1)]) for i in range(5)], "seq long, vec array<double>")
    found = {r.seq: [v[0] for v in r.window] for r in detect.lag_windows(seq).collect()}
    assert found[0] == [1.0] * 12
    assert found[3] == [0.0] * 9 + [1.0, 2.0, 3.0]


def test_autoregression_learns_a_cycle(spark):
    from provgraph.registry import DETECTORS, create

    seq = spark.createDataFrame([(i, [float(i % 3), float((i + 1) % 3)]) for i in range(60)], "seq long, vec array<double>")
    model = create(DETECTORS, "Autoregression", ridge=0.01, unknown=1)
    model.train(seq)
    late = [r.error for r in model.predict(seq).collect() if r.seq > 15]
    assert max(late) < 0.01


def test_communities_of_planted_groups(spark):
    rows = [(f"{c}{i}", f"{c}{(i * 7 + j) % 12}") for c in "xy" for i in range(12) for j in range(1, 5)] + [("x0", "y0")]
    pairs = spark.createDataFrame(rows, "src string, dst string")
    found = community.bounded_communities(pairs, most=20, depth=0, rounds=8)
    groups = {r.community: r.members for r in community.members(found).collect()}
    assert all(len({m[0] for m in members}) == 1 for members in groups.values())
    assert sum(map(len, groups.values())) <= 24 and all(len(m) >= 2 for m in groups.values())
    assert community.modularity(pairs, found).first().modularity > 0.2


def test_mask(spark):
    df = spark.createDataFrame([("EVENT_READ xEVENT_A EVENTS", ["EVENT_B", "c"], {"k": "EVENT_C"})], "a string, b array<string>, c map<string,string>")
    r = df.select(mask_events(F.col("a"), "M"), mask_events_in_array(F.col("b"), "M"), mask_events_in_map(F.col("c"), "M")).first()
    assert tuple(r) == ("M xEVENT_A M", ["M", "c"], {"k": "M"})


def test_files(spark, tmp_path):
    for scene, category, name, text in [("one", "benign", "a.json", '{"EVENT bad\n{"datum":{"com.bbn.tc.schema.avro.cdm18.Event":{"type":"EVENT_X","subject":{"com.bbn.tc.schema.avro.cdm18.UUID":"A"},"predicateObject":{"com.bbn.tc.schema.avro.cdm18.UUID":"B"},"timestampNanos":5}}}\n'), ("one", "benign", "._a.json", "x\n"), ("one", "malicious", "l.txt", " u1 \n\nu2\nu1\n"), ("two", "malicious", "b.json", "y\n")]:
        folder = tmp_path / scene / category
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    base = str(tmp_path)
    assert {(r.scene, r.category, r.file.rsplit("/", 1)[1]) for r in cdm.discover(spark, base).collect()} == {("one", "benign", "a.json"), ("two", "malicious", "b.json")}
    assert {tuple(r) for r in cdm.read_labels(spark, base).collect()} == {("one", "u1"), ("one", "u2")}
    lines = cdm.read_lines(spark, base)
    assert [tuple(r) for r in cdm.extract_events(lines).collect()] == [("A", "B", "EVENT_X", "5", "", "")]
    sizes = sum(p.stat().st_size for p in tmp_path.rglob("[ab].json"))
    assert cdm.loaded_bytes(lines).first().loaded_bytes == sizes
    assert cdm.first_lines(lines, 1, ("block", "row")).count() == 2
    (tmp_path / "one_benign.txt").write_text("A\tSUBJECT_PROCESS\tB\tFILE\tEVENT_X\t5\nA\tshort\n\n")
    assert cdm.read_base_edges(spark, f"{base}/one_benign.txt").count() == 1


def test_dot_file(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph { "lost" [type="file"];\n"p" [type="process"];\n"w" [x=1,\n type="web_object"];\n"p" -> "w" [capacity=1,\n type="connect" timestamp=7];\n"p" -> "other" [capacity=1, type="read" timestamp=8];\n}')
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.txt").write_text("w\n")
    statements = dot.read_statements(spark, str(tmp_path))
    found = {tuple(r) for r in dot.typed_edges(dot.extract_edges(statements), dot.extract_nodes(statements)).collect()}
    assert found == {("p", "SUBJECT_PROCESS", "w", "NetFlowObject", "connect", 7), ("p", "SUBJECT_PROCESS", "other", "PRINCIPAL_LOCAL", "read", 8)}
    assert [tuple(r) for r in dot.read_labels(spark, str(tmp_path)).collect()] == [("g", "w")]


def test_reports_to_files(spark, tmp_path):
    report.write_report(spark.createDataFrame([(1, "a")], "snapshot_id int, nodes string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"snapshot_id":1,"nodes":"a"}'
    report.write_vocabulary(spark.createDataFrame([(0, "x")], "rsg_id long, rsg string"), str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first().value == "0\tx"


def test_empty_tables(spark):
    from provgraph.schema import BASE_EDGE

    none = spark.createDataFrame([], "actorID string, actor_type string, objectID string, object string, action string, timestamp string, exec string, path string, us long, event_id long, category string")
    assert graph.node_frequency(none).count() == 0
    assert snapshots.time_snapshots(none).count() == 0
    assert lineage.ancestors(none.select(F.col("actorID").alias("src"), F.col("objectID").alias("dst"))).count() == 0
    assert edges.drop_touching(none, spark.createDataFrame([("x",)], "label string"), ["actorID"]).count() == 0
    assert spark.createDataFrame([], BASE_EDGE).count() == 0 and entity_types(spark).count() == 7


def test_fold_in_and_negatives(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 2, 5)], "seq long, rsg_id long, cnt long")
    features = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "rsg_id long, vec array<float>")
    found = {r.seq: [round(x, 4) for x in r.vec] for r in embed.fold_in(counts, features).collect()}
    assert found[1] == [1.0, 1.0] and found[0][0] > found[0][1]
    vocabulary = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "rsg_id long, rsg string")
    bags = {(0, 0), (0, 1), (1, 2)}
    drawn = [tuple(r) for r in embed.negatives(counts, vocabulary, 5).collect()]
    assert len(drawn) == 10 and not bags & set(drawn)
    few = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "rsg_id long, rsg string")
    assert {tuple(r) for r in embed.negatives(counts.where("seq = 1"), few, 5).collect()} == {(1, i) for i in (0, 1, 3, 4, 5)}
    most = spark.createDataFrame([(7, i, 1) for i in range(97)] + [(8, 99, 1)], "seq long, rsg_id long, cnt long")
    drawn = [tuple(r) for r in embed.negatives(most, spark.createDataFrame([(i, f"r{i}") for i in range(100)], "rsg_id long, rsg string"), 20).collect()]
    assert {i for s, i in drawn if s == 7} == {97, 98, 99} and sum(s == 8 for s, _ in drawn) == 20 == len({i for s, i in drawn if s == 8})


def test_isolated_vertex_keeps_its_text(spark):
    v = spark.createDataFrame([(0, "a", ["x"]), (0, "b", ["y"]), (0, "c", ["z"])], "day int, name string, properties array<string>")
    p = spark.createDataFrame([(0, "a", "b", ["E"])], "day int, src string, dst string, actions array<string>")
    found = {(r.name, r.depth): r.rsg for r in wl.rooted_subgraphs(v, p, ["day"], 2).collect()}
    assert found[("c", 2)] == "z" and found[("a", 1)] == "x-(E:y)" and found[("a", 2)] == "x-(E:y)-(E:y-(E:x))"


def test_hubs_are_digested_in_ranges(spark):
    """No row of a hub's text holds many parts, equal parts are one, and the digest depends on the parts alone."""
    v = spark.createDataFrame([(0, f"n{i}", [f"p{i % 40}"]) for i in range(201)], "day int, name string, properties array<string>")
    edges = [(0, "n200", f"n{i}", ["E"]) for i in range(200)]
    found = [wl.rooted_subgraphs(v, spark.createDataFrame(e, "day int, src string, dst string, actions array<string>"), ["day"], 1, True, 6).where("name = 'n200' and depth = 1").first().rsg for e in (edges, edges[::-1], edges[1:])]
    assert found[0] == found[1] != found[2] and len(found[0]) == 32
    seen = spark.createDataFrame([(0, "hub", f"part{i % 700}") for i in range(1000)] + [(0, "leaf", "a"), (0, "leaf", "a"), (0, "leaf", "b")], "day int, name string, part string")
    rows = {r.name: r.parts for r in wl.joined_parts(seen, ["day"], 6).collect()}
    assert rows["leaf"] == "a*2_b" and len(rows["hub"].split("_")) <= 6 and all(len(x) == 32 for x in rows["hub"].split("_"))


def test_unquoted_dot_names(spark):
    rows = ['\\nproc_1 [x=1, type="process"]', '\\n"a b" [type=file]', '\\nproc_1 -> "a b" [capacity=1, type="read" timestamp=3]', '\\n"a b" -> other one [capacity=1, type=write timestamp=4]', 'digraph { "lost" [type="file"]']
    statements = spark.createDataFrame([(r.encode().decode("unicode_escape"),) for r in rows], "value string")
    assert {tuple(r) for r in dot.extract_nodes(statements).collect()} == {("proc_1", "process"), ("a b", "file")}
    assert {tuple(r) for r in dot.extract_edges(statements).collect()} == {("proc_1", "a b", "read", 3), ("a b", "other one", "write", 4)}


CDM = "com.bbn.tc.schema.avro.cdm18"


def test_cdm_nodes(spark):
    rows = [
        f'{{"datum":{{"{CDM}.Subject":{{"uuid":"S1","cmdLine":{{"string":"run, now"}},"properties":{{"map":{{"tgid":"7","path":"/bin/x"}}}}}}}}}}',
        f'{{"datum":{{"{CDM}.Subject":{{"uuid":"S2","cmdLine":{{"string":"c"}},"properties":{{"map":{{"other":"1","tgid":"7"}}}}}}}}}}',
        f'{{"datum":{{"{CDM}.Subject":{{"uuid":"S3","cmdLine":null,"properties":{{"map":{{"tgid":"7"}}}}}}}}}}',
        f'{{"datum":{{"{CDM}.NetFlowObject":{{"uuid":"N","localAddress":"1.1","localPort":80,"remoteAddress":"2.2","remotePort":443}}}}}}',
        f'{{"datum":{{"{CDM}.FileObject":{{"uuid":"F","baseObject":{{"properties":{{"map":{{"filename":"/etc/x"}}}}}}}}}}}}',
        f'{{"datum":{{"{CDM}.FileObject":{{"uuid":"F2","filename":"first"}}}}}}', f'{{"datum":{{"{CDM}.FileObject":{{"uuid":"F2","filename":"second"}}}}}}', "broken", None,
    ]
    lines = spark.createDataFrame([(v, "f", i) for i, v in enumerate(rows)], "value string, file string, line long")
    assert {tuple(r) for r in cdm.extract_nodes(lines).collect()} == {("subject", "S1", "run, now,7,/bin/x"), ("netflow", "N", "1.1,80,2.2,443"), ("file", "F", "/etc/x"), ("file", "F2", "second")}


def test_from_cdm_files_to_snapshots(spark, tmp_path):
    from provgraph.registry import SOURCES, create

    event = lambda a, b, us: f'{{"datum":{{"{CDM}.Event":{{"type":"EVENT_READ","subject":{{"{CDM}.UUID":"{a}"}},"predicateObject":{{"{CDM}.UUID":"{b}"}},"timestampNanos":{us}000,"predicateObjectPath":{{"string":"/p"}}}}}}}}\n'
    (tmp_path / "one" / "benign").mkdir(parents=True)
    (tmp_path / "one" / "benign" / "a.json").write_text(event("A", "B", 10) + event("A", "C", 400_000_000) + event("X", "Y", 5) + f'{{"datum":{{"{CDM}.FileObject":{{"uuid":"B","filename":"/b"}}}}}}\n')
    (tmp_path / "one_benign.txt").write_text("".join(f"A\tSUBJECT_PROCESS\t{b}\tFILE_OBJECT_BLOCK\tEVENT_READ\t{us}000\n" for b, us in (("B", 10), ("C", 400_000_000))) + "short\n\n")
    source = create(SOURCES, "cadets")
    loaded = source.load(spark, str(tmp_path))
    found = source.snapshots(loaded).orderBy("us").collect()
    assert [(r.scene, r.category, r.actorID, r.objectID, r.object, r.path, r.snapshot_id) for r in found] == [("one", "benign", "A", "B", "FILE_OBJECT_BLOCK", "/p", 0), ("one", "benign", "A", "C", "FILE_OBJECT_BLOCK", "/p", 1)]
    v = graph.vertices(source.snapshots(loaded), cdm.load_properties(spark, str(tmp_path)), spark.createDataFrame([("C",)], "label string"), ["snapshot_id"])
    assert {(r.snapshot_id, r.name, r.label): r.properties for r in v.collect()}[(0, "B", 0)] == ["/b"] and v.where("label = 1").count() == 1


def test_from_dot_files_to_snapshots(spark, tmp_path):
    from provgraph.registry import SOURCES, create

    for name, shift in (("g", 0), ("h", 100)):
        edges = "".join(f'"p{shift}" -> "f{i + shift}" [capacity=1, type="read" timestamp={i}];\n' for i in range(9))
        (tmp_path / f"{name}.dot").write_text(f'digraph {{ x [y=1];\n"p{shift}" [type="process"];\n{edges}}}')
    source = create(SOURCES, "ATLAS", budget=4, rate=0.5)
    found = source.snapshots(source.load(spark, str(tmp_path))).collect()
    assert {r.scene for r in found} == {"g", "h"} and len(found) >= 6
    assert source.load(spark, str(tmp_path)).where("actor_type = 'SUBJECT_PROCESS'").count() == 18


def test_every_node_is_reported(spark):
    v = spark.createDataFrame([(0, f"n{i:02}", "T", int(i == 3)) for i in range(25)], "s int, name string, type string, label int")
    p = spark.createDataFrame([(0, "n00", "n01")], "s int, src string, dst string")
    r = report.node_report(v, p, ["s"]).first()
    assert r.nodes.split(",") == [f"n{i:02}:" + ("malicious" if i == 3 else "benign") for i in range(25)] and r.n_labelled == 1


def test_short_sequences(spark):
    seq = spark.createDataFrame([(i, [float(i + 1)]) for i in range(5)], "seq long, vec array<double>")
    found = detect.training_windows(seq).collect()
    assert [(r.seq, [v[0] for v in r.window]) for r in found] == [(4, [1.0, 2.0, 3.0, 4.0, 5.0] + [0.0] * 7)]
    assert [(r.seq, r.window[0][0]) for r in detect.training_windows(seq, 4).orderBy("seq").collect()] == [(3, 1.0), (4, 2.0)]
    assert detect.training_windows(seq.limit(0)).count() == 0
    from provgraph.registry import DETECTORS, create

    with pytest.raises(ValueError):
        create(DETECTORS, "autoregression").train(seq)


def test_refinement_beats_local_moving(spark):
    """On this graph contracting whole communities ends at a lower modularity than contracting refined parts; parts are connected and inside theirs."""
    rng = random.Random(0)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(95)}
    g = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], "src string, dst string").coalesce(1).cache()
    plain, better = (community.modularity(g, community.communities(g, levels=3, rounds=8, refine=refine)).first()[0] for refine in (False, True))
    assert better > plain + 0.01
    groups = spark.createDataFrame([(f"v{i}", f"c{i % 3}") for i in range(60)], "node string, community string")
    groups = groups.join(g.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")
    parts = {r.node: r.community for r in community.refined(g.select("src", "dst", F.lit(1.0).alias("w")), groups, groups.select("node", F.lit("all").alias("parent"))).collect()}
    near = {}
    for a, b in pairs:
        if parts[f"v{a}"] == parts[f"v{b}"]:
            near.setdefault(f"v{a}", set()).add(f"v{b}")
            near.setdefault(f"v{b}", set()).add(f"v{a}")
    for part in set(parts.values()):
        seen, todo = {part}, [part]
        while todo:
            todo += [x for x in near.get(todo.pop(), ()) if x not in seen and not seen.add(x)]
        assert seen == {n for n, p in parts.items() if p == part} and len({int(n[1:]) % 3 for n in seen}) == 1
    assert len(set(parts.values())) < len(parts)


def test_large_communities_are_split_again(spark, monkeypatch):
    """A ring of thirty triangles: modularity joins neighbours, and a bound of five takes them apart."""
    edges = [(f"t{i:02}{a}", f"t{i:02}{b}") for i in range(30) for a, b in ("ab", "bc", "ca")] + [(f"t{i:02}a", f"t{(i + 1) % 30:02}b") for i in range(30)]
    g = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    largest, plain = [], community.communities

    def noted(*args, **settings):
        found = plain(*args, **settings)
        largest.append(found.groupBy("community").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(community, "communities", noted)
    sizes = [r["count"] for r in community.bounded_communities(g, most=5, depth=2, rounds=8).groupBy("community").count().collect()]
    assert largest[0] > 5 >= max(sizes) and sum(sizes) >= 88


def test_joint_forecaster_sees_other_dimensions(spark):
    """One series repeats another with a delay: forecasts by dimension miss it, the joint ones do not, with features of their own and with shared ones."""
    rng = random.Random(4)
    noise = [rng.gauss(0, 1) for _ in range(160)]
    seq = spark.createDataFrame([(i, [noise[i], noise[i - 1] if i else 0.0, 0.5 * noise[i - 2] if i > 1 else 0.0]) for i in range(160)], "seq long, vec array<double>").cache()
    windows = detect.lag_windows(seq, 4)
    error = lambda forecasts: forecasts.where("seq > 10").select(F.posexplode(F.zip_with("pred", "vec", lambda p, x: (p - x) * (p - x))).alias("dim", "e")).where("dim > 0").agg(F.avg("e")).first()[0]
    alone = error(detect.autoregression_forecast(windows, detect.fit_autoregression(detect.gram(detect.lagged_values(windows), 4), 1.0, 4)))
    model = detect.fit_joint(seq, lags=4)
    assert alone > 0.4 and error(model.forecast(windows)) < 0.02 and model.ridge in model.errors and set(model.errors) == {0.01, 0.1, 1.0, 10.0}
    assert error(detect.fit_joint(seq, lags=4, size=10).forecast(windows)) < alone
    with pytest.raises(ValueError):
        detect.fit_joint(seq.limit(0), lags=4)


def test_ridge_is_chosen_in_one_job(spark):
    seq = spark.createDataFrame([(i, [float(i % 3), float(i % 2)]) for i in range(60)], "seq long, vec array<double>")
    rows = detect.choose_ridge(seq, (10.0, 0.01, 100.0), 4).collect()
    assert {r.ridge for r in rows} == {0.01, 10.0, 100.0} and [r.ridge for r in rows if r.best] == [0.01] == [min(rows, key=lambda r: (r.error, r.ridge)).ridge]


def test_blocks_meet_once():
    for blocks in (1, 2, 6, 8):
        met = [frozenset((a, b)) for bucket in embed.meetings(blocks)[1:] for a in range(blocks) for b in range(a + 1, blocks) if bucket[a] == bucket[b]]
        assert len(met) == len(set(met)) == blocks * (blocks - 1) // 2


def test_queries_fail_without_training(spark, small):
    """What the two queries of learned vectors return is false where nothing was learned."""
    from provgraph.plans import detection

    assert not any(r.true_nearer for r in detection.translations(spark, small, epochs=0).collect())
    assert not any(r.own_nearer for r in detection.word_vectors(spark, small, rounds=1).collect())


def test_blocks_in_rotation_learn(spark):
    """Several blocks of entities learn what one does: members follow their group's region."""
    facts = [(f"m{i}", "in", f"n{i % 6}") for i in range(60)] + [(f"n{i}", "of", f"g{i % 2}") for i in range(6)] + [(f"m{i}", "of", f"g{i % 2}") for i in range(50)]
    v = embed.translation_vectors(spark.createDataFrame(facts, "h string, r string, t string"), 16, 60, 0.05, block=18, visits=6)
    asked = spark.createDataFrame([(f"m{i}", "of", f"g{i % 2}") for i in range(50, 60)], "h string, r string, t string")
    assert embed.tail_ranks(asked, v).agg({"share": "avg"}).first()[0] > 0.9 and v.count() == 60 + 6 + 2 + 2


def test_translations_learn(spark):
    """Head + relation comes nearer to the tail than it starts, and nearer than to other tails."""
    facts = spark.createDataFrame([(f"h{i}", "r", f"t{i}") for i in range(12)], "h string, r string, t string")

    def distances(epochs):
        v = {(r.kind, r.name): r.vec for r in embed.translation_vectors(facts, 8, epochs, 0.1).collect()}
        far = lambda i, j: sum((a + b - c) ** 2 for a, b, c in zip(v[("entity", f"h{i}")], v[("relation", "r")], v[("entity", f"t{j}")]))
        return sum(far(i, i) for i in range(12)) / 12, sum(far(i, j) for i in range(12) for j in range(12) if i != j) / 132

    before, after = distances(0), distances(8)
    assert after[0] < before[0] and after[0] < after[1]


def test_races_stop_early_and_keep_the_law(spark):
    """The sample is that of a race run to its end, of the law of the plain form, and states of parts merge."""
    h = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    u = lambda text: (h(text) + 1) / 2.0**60

    def whole_race(weights, slots):
        best = {}
        for label, weight in weights.items():
            for unit in range(int(weight * slots * 60 / sum(weights.values())) + 1):
                for i in range(1, sum(u(f"{label}|{unit}|n") > c for c in wl.POISSON) + 1):
                    slot, at = h(f"{label}|{unit}|{i}|s") % slots, (unit + u(f"{label}|{unit}|{i}")) / weight
                    best[slot] = min(best.get(slot, (at, label)), (at, label))
        return {slot: label for slot, (_, label) in best.items()}

    bags = {0: {"a": 1.0, "b": 3.0}, 1: {f"l{i}": 1.0 + i % 5 for i in range(300)}, 2: {"x": 1e-9, "y": 1e9}, 3: {"only": 0.25}}
    rows = spark.createDataFrame([(k, label, w) for k, bag in bags.items() for label, w in bag.items()] + [(1, None, 0.0), (4, "none", 0.0)], "k int, label string, cnt double")
    states = wl.raced_sketch(rows, ["k"], 64).collect()
    for k, bag in bags.items():
        assert {r.slot: r.label for r in states if r.k == k} == whole_race(bag, 64)
    assert not [r for r in states if r.k == 4]
    share = lambda found: found.where("label = 'b'").count() / 4096
    pair = rows.where("k = 0")
    assert abs(share(wl.raced_sketch(pair, ["k"], 4096)) - 0.75) < 0.025 and abs(share(wl.weighted_sketch(pair, ["k"], 4096)) - 0.75) < 0.025
    one, two = (wl.raced_sketch(rows.where(f"k = 1 and {c} cast(substr(label, 2) as int) < 100"), ["k"], 64) for c in ("", "not"))
    merged = wl.first_hits(one.unionByName(two), ["k"]).collect()
    assert {r.slot: r.label for r in merged} == whole_race(bags[1], 64)
    assert wl.raced_sketch(rows.limit(0), ["k"], 64).count() == 0 and wl.raced_series(rows.withColumnRenamed("k", "t").limit(0), "t", 0.1, 8).count() == 0


def test_race_makes_few_rows(spark):
    """Hits follow slots and labels, not their product."""
    rows = spark.range(3000).selectExpr("0 as k", "concat('l', id) as label", "1.0D as weight", "0.0D as low").withColumn("far", F.lit((5.55 + wl.AHEAD) * 256 / 3000))
    assert wl.race_events(rows, "low", "far", 256).count() < 3000 < 3000 * 256


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_store_joins_without_exchange_and_grows(spark, tmp_path):
    """A join by snapshot and node shuffles nothing, before and after new snapshots; a snapshot that is stored stays."""
    from provgraph.operators.store import SnapshotStore

    draw = random.Random(4)
    pairs = [(k, f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for k in range(6) for _ in range(60 if k else 400)]
    edges = spark.createDataFrame(sorted(set(pairs)), "snapshot_id long, src string, dst string")
    vertices = edges.select("snapshot_id", F.explode(F.array("src", "dst")).alias("name")).groupBy("snapshot_id", "name").agg(F.count(F.lit(1)).alias("frequency"))
    first = SnapshotStore(spark, str(tmp_path / "store"), 3)
    first.append(vertices.where("snapshot_id < 4"), edges.where("snapshot_id < 4"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for last in (4, 6, 6):
            store = SnapshotStore(spark, str(tmp_path / "store"), 99)
            assert store.buckets == 3
            store.append(vertices.where("snapshot_id < 6").withColumn("frequency", F.when(F.col("snapshot_id") < 4, -1).otherwise(F.col("frequency"))) if last == 6 else vertices.limit(0), edges.where(f"snapshot_id < {last}"))
            on = [F.col("v.snapshot_id") == F.col("e.snapshot_id"), F.col("v.name") == F.col("e.src")]
            joined = store.table("vertices").alias("v").join(store.table("edges").alias("e"), on)
            counted = joined.groupBy("e.snapshot_id", "e.src").agg(F.sum("v.frequency").alias("n"))
            assert exchanges(joined) == 0 and exchanges(counted) == 0
            plain = vertices.join(edges.withColumnRenamed("src", "name"), ["snapshot_id", "name"])
            assert exchanges(plain) > 0
            want = plain.where(f"snapshot_id < {last}").groupBy("snapshot_id", "name").agg(F.sum("frequency").alias("n"))
            assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_keeps_vectors_and_folds_in_new_ones(spark, tmp_path):
    from provgraph.operators.store import SnapshotStore

    store = SnapshotStore(spark, str(tmp_path / "store"), 2)
    vectors = spark.createDataFrame([(1, [9.0, 9.0]), (2, [-1.0, 0.5])], "snapshot_id long, vec array<double>")
    features = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "rsg string, vec array<double>")
    store.keep_vectors(vectors, features)
    counts = spark.createDataFrame([(1, "a", 5), (3, "a", 1), (3, "b", 3), (3, "unknown", 50), (4, "unknown", 2)], "snapshot_id long, rsg string, cnt long")
    for _ in range(2):
        again = SnapshotStore(spark, str(tmp_path / "store"))
        found = {r.snapshot_id: [round(x, 5) for x in r.vec] for r in again.vectors(counts).collect()}
        assert found == {1: [9.0, 9.0], 2: [-1.0, 0.5], 3: [0.33333, 0.66667], 4: [0.0, 0.0]}
    assert again.vectors().count() == 4


def test_snapshots_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", ["y"], None), (2, "a", ["x", "z"], 3), (1, "c", [], 1)], "snapshot_id long, name string, properties array<string>, frequency long")
    report.write_snapshot_text(rows, ["snapshot_id"], str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text == 'Snapshot 1:\n  Vertex 0: name=c, properties=[], frequency=1\n\nSnapshot 2:\n  Vertex 0: name=a, properties=["x","z"], frequency=3\n  Vertex 1: name=b, properties=["y"], frequency=null\n\n'


def test_jobs_train_and_evaluate(spark, tmp_path):
    """Quiet days repeat; a day with a labelled stranger is found, also one that training has not seen, and what was stored stays."""
    from provgraph import jobs
    from provgraph.registry import DETECTORS, create
    from provgraph.schema import PROCESS_TYPE

    def day(category, n, odd):
        rows = [(f"p{i}", f"f{i}", "EVENT_READ", f"/f{i}") for i in range(6)] + ([(f"evil{i}", "k", "EVENT_EXECUTE", "/k") for i in range(40)] if odd else [])
        return [(a, PROCESS_TYPE, b, "FILE_OBJECT_BLOCK", action, "sh", path, category, n * 100 + i, n * 100 + i, n) for i, (a, b, action, path) in enumerate(rows)]

    odd = {4, 9, 17}
    rows = [r for n in range(30) for r in day("benign", n, False)] + [r for n in range(20) for r in day("malicious", n, n in odd)]
    names = "actorID string, actor_type string, objectID string, object string, action string, exec string, path string, category string, event_id long, us long, snapshot_id long"
    edges = spark.createDataFrame(rows, names)
    properties = spark.createDataFrame([], "kind string, node_id string, property string, load_order int")
    labels = spark.createDataFrame([("evil1",)], "label string")
    seen = edges.where("category = 'benign' or snapshot_id < 12")
    model = jobs.train(spark, seen, properties, labels, str(tmp_path), depth=1, dim=8, rounds=5, buckets=2, detector=create(DETECTORS, "autoregression", quantile=1.0, ridge=0.001, lags=3))
    before = {r.snapshot_id: r.vec for r in jobs.SnapshotStore(spark, f"{tmp_path}/store").vectors().collect()}
    assert len(before) == 42
    found = jobs.evaluate(spark, edges, properties, labels, str(tmp_path))
    after = {r.snapshot_id: r.vec for r in jobs.SnapshotStore(spark, f"{tmp_path}/store").vectors().collect()}
    assert len(after) == 50 and all(after[k] == v for k, v in before.items())
    scored = {r.seq: r for r in found.scored.collect()}
    assert sorted(scored) == list(range(20)) and {n for n, r in scored.items() if r.truth} == odd
    assert all(scored[n]["class"] == "TP" for n in odd) and all(scored[n].error > model.threshold for n in odd)
    counts, figures = found.confusion.first(), found.metrics.first()
    assert (counts.tp, counts.fn) == (3, 0) and counts.tp + counts.fp + counts.tn == 20 and figures.recall == 1.0 and figures.accuracy == (counts.tp + counts.tn) / 20
    assert {r.name for r in found.labelled.collect()} == {"evil1"} and found.nodes.count() == 20 and found.missed.count() == 0
    found.write(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "scored")).count() == 20 == spark.read.text(str(tmp_path / "report" / "nodes")).count()
