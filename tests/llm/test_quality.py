from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from provgraph.llm import quality


def brute(texts, vocabulary):
    """Interpolated modified Kneser-Ney bigrams by dictionaries; words outside the vocabulary are one class."""
    frequency = collections.Counter(w for t in texts for w in t.split())
    known = set(sorted(frequency, key=lambda w: (-frequency[w], w.encode()))[:vocabulary])
    number = lambda t: ["<s>", *(w if w in known else "<other>" for w in t.split()), "</s>"]
    counts = collections.Counter(p for t in texts for p in zip(number(t), number(t)[1:]))
    before = collections.Counter(c for _, c in counts)
    upper, lower = quality.discounts(list(counts.values())), quality.discounts(list(before.values()))

    def probability(b, c):
        """Of a word of the last class: its share of the class, which also has what is left for unseen words."""
        share = quality.OPEN_WORDS if c == "<other>" else 1
        total, rest = sum(before.values()), sum(lower[min(n, 3)] for n in before.values())
        p = (before[c] - lower[min(before[c], 3)]) / total / share + rest / total / quality.OPEN_WORDS
        after = {k: n for k, n in counts.items() if k[0] == b}
        if after:
            n, total = counts[(b, c)], sum(after.values())
            p = (n - upper[min(n, 3)]) / total / share + sum(upper[min(m, 3)] for m in after.values()) / total * p
        return p

    return lambda t: -sum(math.log(probability(b, c)) for b, c in zip(number(t), number(t)[1:]))


@pytest.mark.parametrize("vocabulary, head, chunk", [(3 + 5, 3 + 2, 20), (3 + 50, 3 + 50, 1 << 20), (3 + 50, 1, 1 << 20)])
def test_against_dictionaries(spark, monkeypatch, vocabulary, head, chunk):
    """Also where pairs are looked up at once, in the shards, or both, and documents are packed in many chunks."""
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefg"), int(rng.integers(1, 12)))) for _ in range(40)] + ["y" * 100 + " a " + "y" * 100]
    asked = [*texts[:10], texts[-1], "", "a zz b", "zz zz", "c a b d e f g a", "a a", "a a"]
    model, counts = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, head)
    rows = [(bytearray(hashlib.md5(t.encode()).digest()), t) for t in asked]
    found = {bytes(r.text_key): r for r in quality.surprises(spark.createDataFrame(rows, "text_key binary, text string"), model, counts).collect()}
    want = brute(texts, vocabulary - 3)
    assert len(found) == len(set(asked))
    for key, text in rows:
        r, n = found[bytes(key)], len(text.split())
        assert r.n_words == n and abs(r.surprise - want(text)) < 0.002 * (n + 1), text


def test_unknown_words_count_against_a_text(spark):
    """Also behind one another, where training has seen rare words in a row."""
    texts = [f"the cat sat on the mat rare{i} odd{i} and the dog ran" for i in range(60)]
    model, counts = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 3 + 9, 4)
    asked = ["the cat sat on the mat and the dog ran", "qq1 qq2 qq3 qq4 qq5 qq6 qq7 qq8 qq9 qq10"]
    rows = [(bytearray(hashlib.md5(t.encode()).digest()), t) for t in asked]
    found = {bytes(r.text_key): r.surprise / r.n_words for r in quality.surprises(spark.createDataFrame(rows, "text_key binary, text string"), model, counts).collect()}
    clean, odd = (found[bytes(k)] for k, _ in rows)
    assert clean < 4 and odd > 10


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 34, n).astype(np.uint64))
        assert (quality.unpack(quality.pack(keys)) == keys).all()
        values = rng.integers(0, 1 << 16, n)
        assert (quality.unpack_any(quality.pack_any(values, "<u2"), "<u2") == values).all()
    a, b = rng.integers(0, 1 << 17, 500), rng.integers(0, 1 << 17, 500)
    x, y = quality.unmixed(quality.mixed(a, b))
    assert (x == a).all() and (y == b).all()


def test_counts_grow_with_the_trusted_text(spark):
    texts = spark.range(400).selectExpr("concat('w', id, ' v', id) as text")
    of = lambda df: quality.fit(df)[1].selectExpr("length(keys) as n").groupBy().sum("n").first()[0]
    assert of(texts) > 2.5 * of(texts.limit(100))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.op3_quality(spark, folder).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def test_hard_rows(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat again " * (1 + i % 3), "en", "p") for i in range(60)] + [(100, None, "en", "p"), (101, "", None, "p"), (None, "zq xw", "xx", "p"), (102, "zz qq", "en", "p"), (102, "zz qq", "en", "p")], "doc_id long, text string, lang string, keep string").withColumns({c: quality.F.lit("x") for c in ("mean", "__key", "__language", "__mean")})
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1), (3, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    found = quality.rate_quality(docs, labels)
    assert found.columns == ["doc_id", "lang", "n_words", "perplexity", "threshold", "keep"] and found.count() == 65
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == found.where("keep").count()
    assert all(r.keep is not None and r.threshold is not None for r in found.collect())
    assert all(r.keep and r.threshold is None for r in quality.rate_quality(docs, labels.limit(0)).collect())
    assert quality.rate_quality(docs.limit(0), labels).count() == 0


def test_language_with_few_trusted_documents(spark):
    """Its clean documents are kept, though its own quantile is that of one to five documents."""
    rng = np.random.default_rng(6)
    held = [r.id for r in spark.range(4_000).where("pmod(xxhash64('trusted', id), 5) = 0").limit(15).collect()]
    lang = {d: f"l{n}" for n, some in ((1, held[:1]), (2, held[1:3]), (3, held[3:6]), (4, held[6:10]), (5, held[10:15])) for d in some}
    text = lambda: " ".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(20, 60))))
    rows = [(i, text(), lang.get(i, "en")) for i in range(600)]
    rows += [(10_000 + 100 * n + i, text(), f"l{n}") for n in range(1, 6) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    kept = quality.rate_quality(docs, labels).where("doc_id >= 10000").groupBy("lang").agg({"keep": "count_if"}).collect()
    assert len(kept) == 5 and all(r[1] >= 51 for r in kept), kept
