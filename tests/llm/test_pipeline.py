from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from provgraph.llm import common

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch(spark, f"test-{name}")
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.count()
        if name != "pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name in ("quality", "deduplication"):
            assert docs.join(before, "doc_id", "left_anti").isEmpty() and docs.select("doc_id").distinct().count() == kept[name]
    assert kept["secrets"] == kept["deduplication"] <= kept["quality"] and kept["pieces"] == kept["mixing"]
    assert docs.where("not round_trip").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "deduplication", "secrets", "mixing", "pieces"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_input(spark, name):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, none, SMALL).count() == 0


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and columns that the stages make themselves."""
    prose = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").first().text
    parts = [c + v for c in "bdfghklmnprstvz" for v in "aeiou"]
    long = " ".join(parts[i * 7919 % 75] + parts[i * i % 71] for i in range(60_000))
    key = "token = abcdef0123456789"
    rows = [(1, prose, "en", "web"), (1, prose, "en", "web"), (2, prose, None, None), (None, prose, "en", "web"), (3, None, "en", "web"), (4, "", None, "web"), (5, " \t ", "xx", None), (None, None, None, None), (6, long, "en", "b"), (7, key, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for extra in ("size", "keep", "ids", "node", "root", "copies", "__key", "text_key"):
        docs = docs.withColumn(extra, F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    texts = lambda name, df=docs: sorted(((r.doc_id, r.text) for r in stages[name](spark, df, SMALL).collect()), key=repr)

    assert (rated := texts("quality")) and set(rated) <= set(given) and rated.count((1, prose)) == 2
    assert texts("deduplication") == sorted([(1, prose), (3, None), (6, long), (7, key)], key=repr)
    clean = texts("secrets")
    assert len(clean) == len(given) and "abcdef0123456789" not in dict(clean)[7] and (6, long) in clean and (3, None) in clean and (4, "") in clean
    mixed = texts("mixing")
    assert set(mixed) <= set(given) and mixed == texts("mixing")
    found = stages["pieces"](spark, docs, SMALL).collect()
    assert len(found) == len(given)
    assert all((r.ids is None and r.n_pieces is None) if text is None else (r.round_trip and r.n_pieces == len(r.ids)) for r, text in ((r, dict(given).get(r.doc_id)) for r in found if r.doc_id is not None))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == found[102] == found[100] == 100
    words = spark.createDataFrame([("a b\tc\n",), (None,), ("é x",)], "t string").select(common.word_count(F.col("t")).alias("n"))
    assert [r.n for r in words.collect()] == [3, 0, 1]
