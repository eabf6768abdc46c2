from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from provgraph.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])


def print_of(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows):
    prints = np.array([print_of(t) for _, t in rows], np.uint64)
    root = roots(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2)])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted(((d, format(int(prints[i]), "016x"), least.get(root[i])) for i, (d, _) in enumerate(rows)), key=repr)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in simhash.op8_simhash(spark, small).collect()), key=repr) == brute(rows)


def test_hard_rows(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (6, ""), (2, " \n"), (9, "A b"), (8, "a B"), (7, "one"), (None, base), (3, base), (3, base), *((10 + i, base.replace(f"w{i * 7} ", "changed ")) for i in range(40)), (99, "x" * 3000 + " y")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    found = sorted(((r.doc_id, format(r.fp % 2**64, "016x"), r.component_id) for r in simhash.simhash_components(df).collect()), key=repr)
    assert found == brute(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 37}\n" for i in range(5000))
    whole = simhash.fingerprint(text), simhash.distinct_shingles(text, 5).tobytes()
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert (simhash.fingerprint(text), simhash.distinct_shingles(text, 5).tobytes()) == whole


@pytest.mark.parametrize("bits, segment", [(64, 4), (32, 2), (64, 2)])
def test_close_values_share_a_cell(bits, segment):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**32, 300).astype(np.uint64) << np.uint64(bits - 32)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, bits, 300).astype(np.uint64)
    cells = [{}, {}]
    for side, v in zip(cells, (x, y)):
        for row, key in zip(*(a.tolist() for a in simhash.cell_keys(v.view(np.int64), bits, segment))):
            side.setdefault(row, set()).add(key)
    assert all(cells[0][i] & cells[1][i] for i in range(300))


@pytest.mark.parametrize("crowd", [4096, 5])
def test_near_duplicates(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(4)
    vocabulary = [f"t{i}" for i in range(900)]
    rows, number = [], 0
    for _ in range(12):
        text = list(rng.choice(vocabulary, 150))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(150))] = str(rng.choice(vocabulary))
            rows.append((number, " ".join(copy)))
            number += 1
    rows += [(number, rows[0][1]), (number, rows[0][1]), (number + 1, None), (number + 2, ""), (None, "alone here")]
    sets = [set(shingles(t, 5)) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8]
    root = roots(len(rows), linked)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d) if d is not None else None
    df = spark.createDataFrame([(d, t, *["extra"] * 4) for d, t in rows], "doc_id long, text string, node string, text_key string, __id string, row string")
    found = simhash.near_duplicates(df)
    assert found.columns == df.columns and found.where("node = 'extra' and text_key = 'extra' and __id = 'extra' and row = 'extra'").count() == found.count()
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted(least.values(), key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_crowded_cells(spark, monkeypatch):
    """Cells above the bound are split by thirds of the fingerprint and lose no link."""
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 2**62))
    prints = {centre}
    for _ in range(250):
        x = centre
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(b)
        prints.add(x - 2**64 if x >= 2**63 else x)
    prints = sorted(prints)
    values = np.array(prints, np.int64)
    want = roots(len(prints), [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(simhash.hamming(values, values[i]) <= 2)])
    monkeypatch.setattr(simhash, "CROWD", 20)
    at = {x: i for i, x in enumerate(prints)}
    links = [(at[r.a], at[r.b]) for r in simhash.link_fingerprints(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()]
    assert roots(len(prints), links) == want and len(set(want)) < len(prints) - 50


def test_groups_of_any_size_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 6)
    rng = np.random.default_rng(1)
    rows = [(i, np.unique(rng.choice(40, 4)).astype(np.uint64)) for i in range(60)] + [(60 + i, np.array([50, 51], np.uint64)) for i in range(40)]
    nodes = spark.createDataFrame([(i, bytearray(k.tobytes())) for i, k in rows], "node long, prefix binary")
    members: dict[int, set[int]] = {}
    for r in simhash.sharing_groups(nodes).collect():
        members.setdefault(r.key, set()).add(r.node)
    meet = {(a, b) for m in members.values() for a in m for b in m if a < b}
    assert {(i, j) for i, x in rows for j, y in rows if i < j and set(x.tolist()) & set(y.tolist())} == meet


def test_left_out_pairs_are_marked(spark):
    """Three alike nodes of one group: two nearest pairs and a mark; all three with ``every``; none within one part."""
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    rows = [(7, i, i, 100, bytearray(simhash.parity_sketch(s)), 7) for i, s in enumerate(sets)]
    schema = "key long, node long, part long, n long, sketch binary, name long"
    dealt = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in simhash.candidate_pairs(dealt, 0.8, False).collect()} == {(0, 1), (1, 2), (7, None)}
    assert {tuple(r) for r in simhash.candidate_pairs(dealt, 0.8, True).collect()} == {(0, 1), (1, 2), (0, 2)}
    one = spark.createDataFrame([(*r[:2], 0, *r[3:]) for r in rows[:3]], schema)
    assert simhash.candidate_pairs(one, 0.8, True).count() == 0


def test_contiguous_changes_are_found(spark):
    """Appended, truncated and header-added copies at similarity 0.8 or more, all of them."""
    rng = np.random.default_rng(9)
    vocabulary = [f"t{i}" for i in range(3000)]
    line = [f"line{i}" for i in range(20)]
    rows = []
    for i in range(60):
        text = list(rng.choice(vocabulary, int(rng.integers(60, 500)))) + line
        share = (0.05, 0.1, 0.15, 0.2, 0.24)[i % 5]
        other = list(rng.choice(vocabulary, int(share * len(text))))
        copy = (text + other, other + text, text[: len(text) - int(share * len(text) * 0.8)])[i % 3]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    sets = [set(shingles(t, 5)) for _, t in rows]
    near = [i for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 45
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_duplicates(df).collect()) == [i for i in range(len(rows)) if i % 2 == 0 or i - 1 not in near]


def test_prefixes_and_sketches():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    common = keys[::3], rng.integers(3, 90, len(keys[::3]))
    for _ in range(300):
        a = np.sort(rng.choice(keys, int(rng.integers(1, 120)), replace=False))
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() * 0.25], rng.choice(keys, int(rng.integers(0, 12)))])
        both, apart = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        if both >= 0.8 * (both + apart):
            assert len(np.intersect1d(simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)))
        x, y = (simhash.parity_sketch(s) for s in (a, b))
        x, y = simhash.folded([x, y], min(len(x), len(y)))
        assert np.bitwise_count(x ^ y).sum() <= apart
