from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from provgraph.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def test_against_sql(spark, small, against_sql):
    against_sql(mixing.op4_mix(spark, small), mixing.OP4_SQL, small)


def hard(spark, n=300):
    rows = [(i, "w " * (i % 17), ["a", "b", None, "é", "z"][i % 5] if i % 3 else "a", "x", 1) for i in range(n)]
    rows += [(None, "one two", "b", "x", 1), (7, None, "a", "x", 1), (7, None, "a", "x", 1), (8, "", None, "x", 1), (9, " \n\t", "empty", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hard_rows(spark, small, against_sql):
    df = hard(spark)
    mixed = mixing.mix_sources(df, carry=False).select("doc_id", "size", "source_size", "target", "taken")
    table = df.select("doc_id", "text", "source").toArrow()
    against_sql(mixed, mixing.OP4_SQL, small, documents=table)
    rows = mixed.collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert abs(sum(t for t, _ in by.values()) - sum(r.size for r in rows)) < 1e-6
    assert all(t <= 3 * size + 1e-9 for size, (t, _) in by.items())
    assert all(abs(t - taken) <= 4 * 16 * 3 for t, taken in by.values())


def test_copies_and_columns(spark):
    df = hard(spark)
    mixed = mixing.mix_sources(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    want = mixed.agg({"copies": "sum"}).first()[0]
    assert mixing.emit_copies(mixed, ["doc_id", "text"]).count() == want
    assert {tuple(r) for r in mixing.mix_sources(df).select("doc_id", "copies").collect()} == {tuple(r) for r in mixed.select("doc_id", "copies").collect()}


def test_names_by_case_and_even_ids(spark, monkeypatch):
    """A column that differs from a made one by case gives way; ids that are multiples of the parts are spread all the same."""
    df = hard(spark).withColumnRenamed("size", "Size").withColumn("doc_id", F.col("doc_id") * 16)
    mixed = mixing.mix_sources(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    few, monkeypatched = sorted(r.copies for r in mixed.collect()), monkeypatch.setattr(mixing, "PART_DOCS", 3)
    assert len(few) == df.count() and monkeypatched is None
    many = mixing.mix_sources(df).agg({"copies": "sum"}).first()[0]
    assert abs(many - sum(few)) <= 5


def test_empty_and_wordless(spark):
    df = hard(spark)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    blank = mixing.mix_sources(df.where("doc_id in (8, 9) and source is null or source = 'empty'")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in blank)
    assert isinstance(df.toArrow(), pa.Table)
