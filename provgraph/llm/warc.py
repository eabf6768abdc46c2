"""Writing and reading WARC archives with Spark's text source, so that any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch, table, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of duplicate payloads up to which their table is broadcast; beyond, the pages are shuffled by digest.
BROADCAST_ROWS = 200_000


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits hold four base32 characters."""
    out = []
    for part in range(8):
        value = F.conv(F.substring(hex40, part * 5 + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, by).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*out)


def with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``payload``, ``digest`` and ``refers_to``: of equal payloads the one with the largest page_id is the response."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    digests = pages.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = digests.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(groups.where("n > 1").select("digest", "response"))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    roles = pages.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).join(repeated, "digest", "left")
    return roles.withColumn("refers_to", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")))


def record_text(date: str) -> Column:
    """A whole record without its closing blank lines, which the writer's line separator supplies."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) as uncompressed WARC 1.1 files under ``path``.

    Payloads of at least ``min_bytes`` bytes are stored once: the row with the largest page_id is the response, the others
    are revisit records that name it and keep the HTTP head with the payload's length. Null html is an empty payload; a
    null url becomes ``urn:none``, control characters and spaces in a url become %20; a null page_id is never referred
    to unless all of its payload's ids are null; rows that repeat the largest page_id are responses all. Every record ends
    in two blank lines, which is the text writer's line separator here.
    """
    records = with_roles(pages, min_bytes).select(record_text(date).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)


def field(head: str, name: str, pattern: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}[ \t]*(?:\r\n|$)", 1)


def number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("long")


def rows_between_magic(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block`` (the start of the reader's share of the file), ``row`` (in order within it) and ``value``.

    The magic line is the reader's line separator, so a row is what stands between two occurrences; Spark splits the
    files as it likes.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def payload_in(block: Column) -> Column:
    """The bytes after the HTTP head of a record's block, both binary."""
    at = F.instr(block.cast("string"), F.lit(END))
    head_bytes = F.octet_length(F.substring(block.cast("string"), F.lit(1), at - 1))
    return F.when(at > 0, F.substring(block, head_bytes + 1 + len(END), F.octet_length(block)))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives where a record might begin, with its offset and the offset of its successor.

    Each row's text is cut and digested once; offsets are running sums of lengths inside a share of a file, after the
    sums of the shares before it, so no task holds a file.
    """
    cut = F.instr("value", END)
    parsed = (
        rows_between_magic(spark, path)
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("cut", cut)
        .withColumn("head", F.when(F.col("cut") > 0, F.substring(F.col("value"), F.lit(1), F.col("cut") - 1)))
        .withColumn("head_bytes", F.octet_length("head").cast("long"))
        .withColumn("length", number(field("head", "Content-Length", "([0-9]+)")))
        .withColumn("record_bytes", F.col("head_bytes") + 2 * len(END) + F.col("length"))
        .withColumn("whole", F.coalesce(F.col("record_bytes") == F.col("bytes"), F.lit(False)))
        .withColumn("block_bytes", F.when(F.col("cut") > 0, F.substring(F.col("value").cast("binary"), F.col("head_bytes").cast("int") + 1 + len(END), F.coalesce("length", F.lit(0)).cast("int"))))
        .withColumn("http_cut", F.instr(F.col("block_bytes").cast("string"), F.lit(END)))
        .withColumn("http", F.substring(F.col("block_bytes").cast("string"), F.lit(1), F.col("http_cut") - 1))
        .withColumn("payload", F.when(F.col("whole") & (F.col("http_cut") > 0), F.substring(F.col("block_bytes"), F.octet_length("http") + 1 + len(END), F.octet_length("block_bytes"))))
        .withColumn("hex", F.sha1("payload"))
    )
    parts = checkpointed(
        parsed.select(
            "file", "block", "row", "bytes", "whole", "record_bytes", "length",
            field("head", "WARC-Type", r"(\S+)").alias("record_type"),
            number(field("head", "WARC-Record-ID", r"<urn:page:(-?[0-9]*)>")).alias("page_id"),
            number(field("head", "WARC-Refers-To", r"<urn:page:(-?[0-9]*)>")).alias("refers_to"),
            field("head", "WARC-Payload-Digest", r"sha1:([A-Z2-7]+)").alias("said_digest"),
            number(field("http", "Content-Length", "([0-9]+)")).alias("said_bytes"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32(F.col("hex")).alias("payload_digest"),
        )
    )
    step = F.col("bytes") + F.lit(len(MAGIC))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shares = parts.groupBy("file", "block").agg(F.sum(step).alias("share")).select("file", "block", F.coalesce(F.sum("share").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    end = F.col("before") + F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    first = (F.col("before") == 0) & (F.row_number().over(inside) == 1)
    return (
        parts.join(shares, ["file", "block"])
        .withColumn("first", first)
        .withColumn("offset", end - F.col("bytes") - 2 * len(MAGIC))
        .withColumn("successor", F.col("offset") + len(MAGIC) + F.col("record_bytes"))
        .where(~F.col("first")).drop("first", "before")
    )


def reachable(found: DataFrame) -> DataFrame:
    """Keep the candidates that the chain of successors reaches from offset 0 of their file.

    Inside a reader's share, candidates whose successor is the next candidate form runs, so a chain that enters a run holds
    all that follows in it. If each file's runs follow one another from offset 0, all are reached; else pointer jumping
    over the runs doubles the jump each round until nothing new is reached.
    """
    order = Window.partitionBy("file", "block").orderBy("offset")
    linked = F.lag("successor").over(order) == F.col("offset")
    runs = found.withColumn("breaks", (~F.coalesce(linked, F.lit(False))).cast("long")).withColumn("run", F.struct("block", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
    runs = written(runs.drop("breaks"))
    tails = runs.groupBy("file", "run").agg(F.max_by("successor", "offset").alias("target"), F.min("offset").alias("head"))
    previous = F.coalesce(F.lag("target").over(Window.partitionBy("file").orderBy("head")), F.lit(-1))
    is_first = F.row_number().over(Window.partitionBy("file").orderBy("head")) == 1
    if tails.withColumn("follows", F.col("head") == F.when(is_first, F.lit(0)).otherwise(previous)).where("not follows").isEmpty():
        return runs.drop("run")
    jumps = written(tails.select("file", "run", "target").join(runs.select("file", F.col("offset").alias("target"), F.col("run").alias("next_run")), ["file", "target"]).select("file", "run", "next_run", F.col("target").alias("entry")))
    reached = written(tails.where("head = 0").select("file", "run", F.lit(0).cast("long").alias("entry")))
    count = reached.count()
    while True:
        onward = reached.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("next_run").alias("run"), "entry")
        reached = written(reached.union(onward).distinct())
        now = reached.count()
        if now == count:
            break
        count = now
        step = jumps.select("file", F.col("run").alias("next_run"), F.col("next_run").alias("far_run"), F.col("entry").alias("far_entry"))
        jumps = written(jumps.drop("entry").join(step, ["file", "next_run"]).select("file", "run", F.col("far_run").alias("next_run"), F.col("far_entry").alias("entry")))
    return runs.join(reached, ["file", "run"]).where("offset >= entry").drop("run", "entry")


def stitched(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """Length and digest of the payloads of records that are not one row: those that hold the magic line, are followed by
    something else, or are cut short. Their text is put together from the rows up to their end and cut at the stated
    length; a record that is too short for it, or states none, has nulls."""
    reached = records.select("file", "offset", F.col("offset").alias("mine"))
    marks = found.select("file", "block", "row", "offset").join(reached, ["file", "offset"], "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("file", "block").agg(F.max("mine").alias("last")).select("file", "block", F.max("last").over(earlier).alias("carried"))
    owner = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("mine", F.max("mine").over(owner)).join(carried, ["file", "block"]).withColumn("mine", F.coalesce("mine", "carried"))
    broken = records.where(~F.col("whole") & F.col("length").isNotNull()).select("file", F.col("offset").alias("mine"), "length", "successor")
    owned = owned.join(broken, ["file", "mine"]).where(F.col("offset") < F.col("successor")).select("file", "block", "row", "offset", "mine", "length")
    text = rows_between_magic(spark, path)
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
    whole = text.join(owned, ["file", "block", "row"]).groupBy("file", "mine").agg(put.alias("value"), F.first("length").alias("length"))
    rest = whole.withColumn("rest", F.expr(r"cast(substring(value, instr(value, '\r\n\r\n') + 4) as binary)"))
    cut = rest.withColumn("payload", F.when(F.octet_length("rest") >= F.col("length"), payload_in(F.substring(F.col("rest"), F.lit(1), F.col("length").cast("int")))))
    return cut.withColumn("hex", F.sha1("payload")).select("file", F.col("mine").alias("offset"), F.octet_length("payload").cast("long").alias("own_bytes"), base32(F.col("hex")).alias("own_digest"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The verified records under ``path``: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response's figures are taken from its payload; a revisit's are those of its header, which describe the full payload.
    Bytes that look like a record inside a payload are passed over, because no chain from the file's start reaches them. A
    file that does not begin with a record gives none; a record that no record follows ends its file's chain. It is itself
    kept, with null figures if the file ends before its stated length. An empty folder of archives gives no rows.
    """
    found = candidates(spark, path)
    records = reachable(found)
    broken = records.where(~F.col("whole") & (F.col("record_type") != "revisit"))
    if not broken.isEmpty():
        records = records.join(stitched(spark, path, found, records), ["file", "offset"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "own_bytes")).withColumn("payload_digest", F.coalesce("payload_digest", "own_digest"))
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records to the shared folder and read back."""
    path = scratch(spark, "op6-warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), h AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM h
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to
FROM g
"""
