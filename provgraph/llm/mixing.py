"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, table, word_count, written

#: Size classes per factor e of the size; the least number of parts that each class is dealt to, so that one source's rows spread, and the
#: documents of the whole table for each part beyond.
CLASSES, PARTS, PART_DOCS = 20, 16, 1_000_000


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Give each source its share of all sizes. ``sources``: ``source_key``, ``source``, ``source_size``.

    Shares go by weight; where a share would pass ``cap`` times the source's own size it stops there, and the excess
    is shared again. That fixpoint is min(cap * size, weight * level): with sources in order of cap * size / weight,
    the level follows from running sums. This table has one row for each source, so its windows need no splitting.
    """
    everywhere = Window.partitionBy(F.lit(0))
    by_ratio = everywhere.orderBy("ratio", "place")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    big = "decimal(38,0)"
    ranked = (
        sources.withColumn("place", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("fits", F.col("most").cast(big) * F.col("open").cast(big) >= F.col("rest").cast(big) * F.col("weight").cast(big))
        .withColumn("step", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("step", "rest", "open"))).over(everywhere))
    )
    share = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.open")
    return ranked.select(
        "source_key",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("step") < F.col("level.step")), F.col("most").cast("double")).otherwise(share).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", size: Column | None = None, carry: bool = True) -> DataFrame:
    """How often the mix takes each document.

    Returns the columns of ``docs`` (with ``carry=False`` only ``doc_id``) and ``size``, ``source_size``, ``target``,
    ``copies``, ``taken``; columns of ``docs`` with one of these names give way. A document's expected number of copies is
    target / source_size. Within a source the documents stand in order of size class, part, size, doc_id; the running
    sum of expected copies starts from one offset drawn from ``seed`` and the source's name, and a document is taken
    once for each integer that its own step crosses. Order by size keeps the words taken near the target. The running
    number of a document is the count of all earlier (class, part) cells, a short table, plus its place in its own cell,
    so no task holds a source. Words are counted once, and the sizes stand in the shared folder.

    Null source: a source of its own, last in order. Null or blank text: size 0, taken 0. Null doc_id: dealt by its text, first in
    order. Repeated rows count as separate documents; of equal ids and sizes the text
    decides the order, so reruns agree. A corpus without words: all targets 0. Empty input: no rows.
    """
    made = ["size", "source_size", "target", "copies", "taken", "source_key", "cell_class", "cell_part", "earlier", "rate", "offset", "place", "cell_hash"]
    counted = size if size is not None else word_count(F.col("text"))
    kept = beside(docs, made) if carry else ["doc_id"]
    cell = ["source_key", "cell_class", "cell_part"]

    parts = max(PARTS, docs.count() // PART_DOCS)
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")), 1, 8), 16, 10).cast("long")

    def cells(columns: list[str]) -> DataFrame:
        return (
            docs.select(*columns, counted.alias("size"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("source_key"), hashed.alias("cell_hash"))
            .withColumn("cell_class", F.when(F.col("size") > 0, F.floor(F.ln("size") * CLASSES)).otherwise(-1))
            .withColumn("cell_part", F.col("cell_hash") % parts)
            .drop("cell_hash")
        )

    sized = written(cells(["doc_id"]))
    totals = sized.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = totals.groupBy("source_key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("source_key") != "null", F.expr("substring(source_key, 2)")))
    targets = source_targets(sources, weights, cap)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("source_key"))), 1, 12), 16, 10).cast("double") / float(2**48)
    running = Window.partitionBy("source_key").orderBy("cell_class", "cell_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        totals.withColumn("earlier", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .join(targets, "source_key")
        .select(*cell, "earlier", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), draw.alias("offset"))
    )
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id", *([F.xxhash64("text")] if "text" in kept else []))
    placed = (cells(kept) if carry else sized).withColumn("place", F.row_number().over(inside)).join(plan, cell)
    upto = lambda i: F.floor(F.col("offset") + F.col("rate") * i)
    number = F.col("earlier") + F.col("place")
    return placed.withColumn("copies", F.least(F.lit(cap), upto(number) - upto(number - 1)).cast("long")).select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their sizes, targets and the words that the mix takes."""
    return mix_sources(table(spark, sf_dir, "documents"), carry=False).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('=' || source, 'null') AS source_key, ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 8))::BIGINT AS part_hash
  FROM documents
), c AS (
  SELECT *, CASE WHEN size > 0 THEN floor(ln(size) * 20)::BIGINT ELSE -1 END AS cls, part_hash % (SELECT greatest(16, count(*) // 1000000) FROM documents) AS part FROM d
), s AS (
  SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY source_key
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s
), w AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS most FROM r
), q AS (
  SELECT *, most::DOUBLE / weight AS ratio FROM w
), k AS (
  SELECT *, row_number() OVER o AS step,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
  FROM q WINDOW o AS (ORDER BY ratio, place)
), l AS (
  SELECT step AS at_step, rest AS at_rest, open_weight AS at_open FROM k
  WHERE most::HUGEINT * open_weight >= rest::HUGEINT * weight ORDER BY step LIMIT 1
), t AS (
  SELECT source_key, source_size,
         CASE WHEN at_step IS NULL OR step < at_step THEN most::DOUBLE ELSE (weight * at_rest)::DOUBLE / at_open END AS target,
         ('0x' || substr(md5('mix:' || source_key), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM k LEFT JOIN l ON true
), n AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY c.source_key ORDER BY cls, part, c.size, c.doc_id NULLS FIRST) AS i
  FROM c JOIN t USING (source_key)
)
SELECT doc_id, size, source_size, target, (least(3, floor(u + rate * i) - floor(u + rate * (i - 1)))::BIGINT * size)::BIGINT AS taken FROM n
"""
