from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from provgraph.llm import middle


def test_against_sql(spark, small, against_sql):
    against_sql(middle.op13_middle(spark, small), middle.OP13_SQL, small)


def hard(spark):
    texts = [None, "", "a", "ab", "😀", "é😀\n\r\n z  \x00", "has <P> inside", "<S>", "x<M>", "<P", "a<", "<S", "S>M>P>", "$1 \\ $2 {3}", "\n", "<" * 50, "a" * 1023, "b" * 1024, "c" * 1025, "😀" * 5000, "x\ny" * 40_000]
    rows = [(i * 100 + j, t, "q", "z") for i, t in enumerate(texts) for j in range(6)] + [(None, "no id at all", "q", "z"), (7, "twice", "q", "z"), (7, "twice", "q", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, N string, __form string")


def test_hard_rows(spark, small, against_sql, monkeypatch):
    df = hard(spark)
    monkeypatch.setattr(middle, "table", lambda *_: df)
    made = middle.op13_middle(spark, small)
    against_sql(made, middle.OP13_SQL, small, documents=df.select("doc_id", "text").toArrow())
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    rows = made.collect()
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and all(r.n == len(texts[r.doc_id]) for r in rows)


def test_columns_and_empty(spark):
    df = hard(spark)
    made = middle.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "__form", "n", "form", "prefix_units", "middle_units", "output"]
    assert middle.fill_in_middle(df.limit(0)).count() == 0
    assert made.where("form = 'plain' and (prefix_units is not null or output <> coalesce(text, ''))").count() == 0


@pytest.mark.parametrize("unit", [r"\S++\s*+|\s++", "..?+", r"[^\n]*+\n|[^\n]++"])
def test_other_units(spark, unit):
    """Words, pairs and lines: units are counted from the left, and all forms give the text back."""
    texts = ["one two  three\nfour ", "line\n\nline 2\nend", "😀 é " * 700, "x" * 3001, "a\n" * 2500]
    df = spark.createDataFrame([(i * 10 + j, t) for i, t in enumerate(texts) for j in range(4)], "doc_id long, text string")
    rows = middle.fill_in_middle(df, unit=unit, rate=100).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert r.back == r.text
        found, at = 0, 0
        while m := re.compile(unit, re.S).match(r.text, at):
            found, at = found + 1, m.end()
        assert r.n == found and r.prefix_units + r.middle_units <= r.n


def test_marks_are_literals(spark):
    df = spark.createDataFrame([(i, "some text, $1 and more") for i in range(20)], "doc_id long, text string")
    marks = ("$1(", "\\E[", "{x}.")
    rows = middle.fill_in_middle(df, marks=marks, rate=100).withColumn("back", middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text for r in rows) and all(all(m in r.output for m in marks) for r in rows if r.form != "plain") and any(r.form != "plain" for r in rows)
