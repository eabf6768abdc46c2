"""Fill-in-the-middle: texts cut in three by one match of a pattern with counted quantifiers. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, table

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units that are counted as one block, so that counting a long text never lists all its units at once.
BLOCK = 1024


def quoted(literal: str) -> str:
    """A literal inside a replacement, where backslashes and dollar signs have a meaning."""
    return re.sub(r"([\\$])", r"\\\1", literal)


def literal(mark: str) -> str:
    """A literal inside a pattern."""
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", mark)


def unit_count(text: Column, unit: str = ".", block: int = BLOCK) -> Column:
    """Units of a text, matched one after the other from its start (``.`` is a code point, line ends too).

    ``regexp_count`` lists its matches, so whole blocks are counted first and single units only behind the last block:
    at most length / ``block`` + ``block`` matches at a time. The rest begins where a pattern that takes that number of
    blocks ends.
    """
    many = f"(?:{unit}){{{block}}}+"
    blocks = F.regexp_count(text, F.lit(rf"(?s)\G{many}"))
    rest = F.regexp_replace(text, F.concat(F.lit(rf"(?s)\A(?:{many}){{"), blocks.cast("string"), F.lit("}+")), F.lit(""))
    return (blocks * block + F.regexp_count(rest, F.lit(rf"(?s)\G(?:{unit})"))).cast("long")


def draws(seed: str, doc_id: Column, how_many: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(how_many)]


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from. Parts of a text that holds no mark cannot form one with a mark beside
    them, so the first of each mark is the one that was put there."""
    p, s, m = (literal(x) for x in marks)
    psm, spm = rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, F.lit(psm), F.lit("$1$3$2")))
        .when(form == "spm", F.regexp_replace(output, F.lit(spm), F.lit("$2$3$1")))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20, unit: str = ".", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The columns of ``docs`` and ``n``, ``form``, ``prefix_units``, ``middle_units``, ``output``.

    A text has ``n`` units (``unit`` matches one and never nothing; code points by default). Two draws from ``seed`` and ``doc_id`` cut it
    after ``a`` and after ``b`` units, the smaller first. The row's own pattern, ``unit{a}`` and ``unit{b-a}`` with possessive
    quantifiers and then the rest, matches once, and its replacement writes the three groups in their new order. ``rate`` % of the texts are cut, of
    them ``spm_rate`` % with the suffix first (``spm``, else ``psm``). No row meets another: no shuffle, and a text's work is
    in proportion to its length, however long.

    Form ``plain`` (output is the text, both unit counts null): texts that are not drawn, empty ones, and those that hold a mark already. A null
    text counts as empty. A null id draws as the empty string. Repeated rows are cut alike. Columns of ``docs`` that have
    one of the five names, in any case, give way. Empty input gives no rows.
    """
    p, s, m = (quoted(x) for x in marks)
    kept = beside(docs, ["n", "form", "prefix_units", "middle_units", "output"])
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | text.contains(mark)
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    counted = docs.select(F.struct(*kept).alias("row"), text.alias("text"), unit_count(text, unit).alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    first, second = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    cut = counted.withColumns({"a": F.least(first, second), "b": F.greatest(first, second)})
    group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*+)\z"))
    order = F.when(F.col("form") == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    plain = F.col("form") == "plain"
    return cut.select(
        "row.*",
        "n",
        "form",
        F.when(~plain, F.col("a")).alias("prefix_units"),
        F.when(~plain, F.col("b") - F.col("a")).alias("middle_units"),
        F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"),
    )


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its form, its cuts, and digests of what was written and of what is restored from that."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
