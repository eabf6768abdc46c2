"""How filters act together: a sparse document-term matrix decides those on words, and every order of the filters is counted."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import ship_package, slices, table, written

#: Bounds of one shard of the matrix, and the bytes of a text that are cut into words at a time.
SHARD_ROWS, SHARD_BYTES, PIECE = 1 << 16, 32 << 20, 1 << 20
#: Words that a shard holds as Python objects at a time.
HELD_WORDS = 100_000
#: Words of more bytes stand in the dictionary by a space, which no word holds, and their SHA-256.
LONG_WORD = 64
#: The least number of buckets of the dictionary, and (shard, word) rows for each bucket beyond.
BUCKETS, BUCKET_ROWS = 64, 200_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
FILTERS = "ABCDE"

RAW = "shard long, docs array<struct<doc_id:bigint,part:string,digest:binary,c:boolean,d:boolean>>, starts binary, steps binary, counts binary, words array<string>"
SHARDS = RAW.split(", words")[0].replace("steps", "columns")
_DOC = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("c", pa.bool_()), ("d", pa.bool_())])


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes, cut at white space only."""
    start = 0
    while start < len(text):
        gap = SPACE.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed: steps and counts are mostly small."""
    return pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def unpacked(packed_numbers: bytes, how_many: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed_numbers, 4 * how_many, codec="zstd", asbytes=True), "<i4")


def dictionary_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).hexdigest().encode()


class Shard:
    """Rows of the matrix under construction: each document's different words and their counts, one document after the other."""

    def __init__(self) -> None:
        self.docs: list[dict] = []
        self.lengths: list[int] = []
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.closed: list[tuple[pa.Array, np.ndarray]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, part: str | None, text: bytes) -> None:
        points = len(text) - len(text.translate(None, bytes(range(128, 192)))) if not text.isascii() else 0
        capitals = len(text) - len(text.translate(None, UPPER))
        many = 100 * capitals > 5 * (len(text) - points)
        marked = len(text.translate(None, SYMBOLS)) < len(text)
        words: Counter[bytes] = Counter()
        for piece in pieces(text):
            words.update(piece.split())
        self.lengths.append(len(words))
        self.words += words
        self.counts += words.values()
        if len(self.words) >= HELD_WORDS:
            self.close()
        self.docs.append({"doc_id": doc_id, "part": part or "", "digest": hashlib.sha256(text).digest(), "c": many, "d": marked})
        self.bytes += len(text)

    def close(self) -> None:
        """Words so far out of Python's hands."""
        keys = [w if len(w) <= LONG_WORD else dictionary_key(w) for w in self.words]
        self.closed.append((pa.array(keys, pa.binary()), np.array(self.counts, np.int32)))
        self.words, self.counts = [], []

    def full(self) -> bool:
        return len(self.docs) >= SHARD_ROWS or self.bytes >= SHARD_BYTES

    def row(self, name: int) -> pa.RecordBatch:
        """The shard as compressed sparse rows: where each document's entries start, the steps from each entry's column to the next one's, which
        are mostly small, and the counts."""
        self.close()
        words = pa.concat_arrays([w for w, _ in self.closed]).dictionary_encode()
        starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        columns, width = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
        order = np.argsort(np.repeat(np.arange(len(self.docs)), self.lengths) * width + columns)
        steps, counts = np.diff(columns[order], prepend=0), np.concatenate([c for _, c in self.closed])[order]
        binary = [pa.array([x], pa.binary()) for x in (starts.astype("<i8").tobytes(), packed(steps), packed(counts))]
        listed = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string()))
        columns = [pa.array([name], pa.int64()), pa.array([self.docs], pa.list_(_DOC)), *binary, listed]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "docs", "starts", "steps", "counts", "words"])


def local_shards(docs: DataFrame) -> DataFrame:
    """Shards with their own column numbers and the words of these; ``docs``: ``doc_id``, ``part``, ``text``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, task = Shard(), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                shard.add(doc_id, part, text or b"")
                if shard.full():
                    yield shard.row(task << 32 | number)
                    shard, number = Shard(), number + 1
        if shard.docs:
            yield shard.row(task << 32 | number)

    return docs.select(F.col("doc_id").cast("long"), "part", "text").mapInArrow(run, RAW)


def document_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as shards of compressed sparse rows, and its dictionary (``word``, ``word_id``).

    ``docs``: ``doc_id``, ``part``, ``text``. A shard holds up to ``SHARD_ROWS`` documents or about ``SHARD_BYTES`` of text: ``docs``, ``starts``
    (64-bit), ``columns`` (64-bit word ids), ``counts`` (32-bit). Words are numbered within their shard first, so the corpus meets in the
    dictionary with each shard's distinct words, not with every word of every text. Those are dealt to buckets by hash and ranked there; a word's id is its rank
    times the number of buckets plus its bucket. One shuffle takes the words to their ids and one the ids back to their shards; a word has at most one row for each
    shard, so frequent ones make no hot bucket. Words over ``LONG_WORD`` bytes stand in the dictionary by digest.

    Null text: a row without entries. Repeated rows: a row each. A longer text is cut into words piece by piece.
    Empty input: no shards and an empty dictionary.
    """
    local = written(local_shards(docs))
    words = local.select("shard", F.posexplode("words").alias("at", "word"))
    buckets = max(BUCKETS, (local.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET_ROWS)
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("long")
    encoded = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets))).withColumn("word_id", (rank - 1) * buckets + F.col("bucket"))
    ids = encoded.groupBy("shard").agg(F.collect_list("at").alias("at"), F.collect_list("word_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            at, ids = batch.column(4)[0].values, batch.column(5)[0].values
            starts = np.frombuffer(batch.column(2)[0].as_py(), "<i8")
            steps, counts = (unpacked(batch.column(i)[0].as_py(), int(starts[-1])) for i in (3, 6))
            wide = np.zeros(0 if ids is None else len(ids), np.int64)
            if ids is not None:
                wide[at.to_numpy()] = ids.to_numpy()
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (wide[np.cumsum(steps)].astype("<i8"), counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *binary], names=["shard", "docs", "starts", "columns", "counts"])

    joined = local.drop("words").join(ids, "shard", "left").select("shard", "docs", "starts", "steps", "at", "ids", "counts")
    return joined.mapInArrow(run, SHARDS), encoded.select("word", "word_id").distinct()


def word_flags(shards: DataFrame, least_words: int = 50, least_distinct: int = 65) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` and the flags ``a``, ``b``, ``c``, ``d`` of each row of the matrix: its sum is the
    number of words, its number of entries that of distinct ones."""
    ship_package(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            starts, counts = np.frombuffer(batch.column(1)[0].as_py(), "<i8"), np.frombuffer(batch.column(2)[0].as_py(), "<i4")
            upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            words, distinct = upto[starts[1:]] - upto[starts[:-1]], np.diff(starts)
            doc = batch.column(0)[0].values
            columns = [doc.field(k) for k in range(3)] + [pa.array(words < least_words), pa.array(100 * distinct < least_distinct * words), doc.field(3), doc.field(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "a", "b", "c", "d"])

    return shards.select("docs", "starts", "counts").mapInArrow(run, "doc_id long, part string, digest binary, a boolean, b boolean, c boolean, d boolean")


def failures(docs: DataFrame, by: str = "source") -> DataFrame:
    """``doc_id``, ``part``, ``fails`` (the letters of the filters that a document fails, in order).

    A: under 50 words; B: under 65 % of the words distinct; C: over 5 % of the code points are A-Z; D: holds one of
    ``#$%&*|``; E: the text is that of a smaller ``doc_id`` of the whole table. Texts are compared by SHA-256. The copies
    of a text never meet in one task: the least id of each digest comes from partial aggregates, and a document is joined with it by digest
    and id together.

    Null text counts as empty (A fails; repeated ones fail E). A null id is no smaller than any and fails no E, and rows
    with the same id are no copies of one another. Null ``by`` is the empty string. Other columns of any name are not read. Empty input gives
    no rows.
    """
    shards, _ = document_terms(docs.select("doc_id", F.coalesce(by, F.lit("")).alias("part"), "text"))
    flags = written(word_flags(shards))
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = flags.join(first, ["digest", "doc_id"], "left").withColumn("e", F.col("first").isNull() & F.col("doc_id").isNotNull())
    return marked.select("doc_id", "part", F.concat(*(F.when(F.col(f.lower()), f).otherwise("") for f in FILTERS)).alias("fails"))


def interaction_audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order of the filters, by part; ``failed`` as from ``failures``.

    ``labels``: ``doc_id``, ``quality``, ``toxic``; a document is good or toxic if any of its labels says so. Documents are first counted by part, failed filters
    and labels, at most 128 rows for each part; orders and steps multiply only those. ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` stand for every part, order and step, zeros too.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    patterns = failed.join(known, "doc_id", "left").groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = patterns.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("earlier", F.expr("substring(filter_order, 1, step - 1)"))
    seen = own.withColumn("gone", F.expr("length(translate(earlier, fails, '')) < length(earlier)")).withColumn("failing", F.expr("contains(fails, letter)"))
    here = F.col("failing") & ~F.col("gone")
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    counted = seen.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("failing") & ~F.col("gone"), "kept"),
        total(here, "removed"),
        total(F.col("failing") & F.col("gone"), "redundant"),
        total(F.col("fails") == F.col("letter"), "unique_fails"),
        total(here & F.col("good"), "good_lost"),
        total(here & F.col("toxic"), "toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")).cast(LongType())).drop("letter")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    return interaction_audit(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), f AS (
  SELECT doc_id, part, concat(CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * list_unique(ws) < 65 * len(ws) THEN 'B' END,
         CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' END,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN first < doc_id THEN 'E' END) AS fails FROM w
), k AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), p AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN k USING (doc_id) GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), x AS (
  SELECT p.*, s.*, contains(fails, letter) AS failing, length(translate(earlier, fails, '')) < length(earlier) AS gone FROM p, s
), r AS (
  SELECT part, filter_order, step::INT AS step, letter,
         coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM r
"""
