from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from provgraph.llm import filters

SCHEMA = "doc_id long, text string, source string, part string, Fails string, digest int"


def test_against_sql(spark, small, against_sql):
    assert against_sql(filters.op11_audit(spark, small), filters.OP11_SQL, small) % 600 == 0


def hard(spark):
    long_word = "x" * 3000
    rows = [(i, " ".join(f"w{j % (3 + i)}" for j in range(45 + i)), ["a", "a", None, "é", ""][i % 5]) for i in range(30)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "", None), (None, "same text", "b"), (103, "same text", "b"), (104, "same text", "c"), (104, "same text", "c")]
    rows += [(105, f"{long_word} {long_word} {long_word}y", "a"), (106, "AB cdef é😀 " * 40, "b"), (107, "one | two", None), (108, " \t\n\x0b\x0c\r ", "b"), (109, " nbsp em", "b"), (-5, "same text", "d")]
    rows += [(110, "tie " * 65 + " ".join(f"u{i}" for i in range(35)), "t"), (111, "A" + "b" * 19, "t"), (112, "AA" + "b" * 18, "t")]
    return spark.createDataFrame([(*r, "p", "f", 1) for r in rows], SCHEMA)


def brute(rows, labels):
    """The audit straight from its definition."""
    fails = []
    for r in rows:
        text = r.text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        lower = r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in rows)
        bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), lower]
        fails.append((r.source or "", {f for f, b in zip("ABCDE", bad) if b}, *labels.get(r.doc_id, (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        rows_of = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                before = len(left)
                left = [f for f in left if letter not in f[1]]
                everyone = sum(letter in f[1] for f in mine)
                rows_of[order, step] = (letter, len(left), before - len(left), everyone - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
                removed[letter] += len(gone)
        out |= {(part, *k): (*v[1:], removed[v[0]]) for k, v in rows_of.items()}
    return out


def test_hard_rows(spark):
    docs = hard(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 1), (104, 1, 1), (None, 1, 1), (106, None, None), (103, None, 1)], "doc_id long, quality int, toxic int")
    known = {3: (True, False), 4: (False, True), 104: (True, True), 103: (False, True)}
    got = filters.interaction_audit(filters.failures(docs), labels).collect()
    want = brute(docs.collect(), known)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got} == want and len(got) == len(want)


def test_matrix(spark, monkeypatch):
    """Entries are the counts of words, under ids that the whole corpus shares, in one bucket or in many."""
    docs = hard(spark).select("doc_id", F.lit("").alias("part"), "text")
    seen = []
    for buckets in (1, 64):
        monkeypatch.setattr(filters, "BUCKETS", buckets)
        shards, dictionary = filters.document_terms(docs.repartition(3))
        word = {r.word_id: r.word for r in dictionary.collect()}
        assert len(set(word.values())) == len(word) and (buckets > 1 or [word[i] for i in range(len(word))] == sorted(word.values()))
        found = []
        for r in shards.collect():
            starts, columns, counts = (np.frombuffer(r[c], k).tolist() for c, k in (("starts", "<i8"), ("columns", "<i8"), ("counts", "<i4")))
            assert starts[-1] == len(columns) == len(counts)
            for d, (a, b) in zip(r.docs, zip(starts, starts[1:])):
                found.append((d.doc_id, sorted((word[c], n) for c, n in zip(columns[a:b], counts[a:b]))))
        seen.append(sorted(found, key=repr))
    assert seen[0] == seen[1]
    counted = []
    for r in docs.collect():
        words = [filters.dictionary_key(w).decode() for w in (r.text or "").encode().split()]
        counted.append((r.doc_id, sorted((w, words.count(w)) for w in set(words))))
    assert seen[0] == sorted(counted, key=repr)


def test_long_text(spark, monkeypatch):
    """A text of many pieces counts like a whole one, and a word is never cut."""
    monkeypatch.setattr(filters, "PIECE", 7)
    text = "  ".join(["alpha", "beta", "gammagammagamma"] * 40) + "\n"
    assert b"".join(filters.pieces(text.encode())) == text.encode()
    shard = filters.Shard()
    shard.add(1, None, text.encode())
    row = shard.row(3).to_pylist()[0]
    assert np.cumsum(filters.unpacked(row["steps"], 3)).tolist() == [0, 1, 2]
    assert dict(zip(row["words"], filters.unpacked(row["counts"], 3).tolist())) == {"alpha": 40, "beta": 40, "gammagammagamma": 40}


def test_empty(spark, small):
    docs = hard(spark)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert filters.interaction_audit(filters.failures(docs.limit(0)), labels).count() == 0
    assert filters.interaction_audit(filters.failures(docs), labels.limit(0)).count() == 600 * 7
    blank = filters.interaction_audit(filters.failures(docs.where("doc_id in (100, 101)")), labels).where("filter_order = 'ABCDE'").collect()
    assert {(r.step, r.removed, r.redundant) for r in blank} == {(1, 2, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 1)}
