"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of all trusted text.

The model is a table: n-grams are counted over every trusted document outside a held-out fifth, and the counts stand in
shards by a mixed number of the n-gram, as many shards as the trusted text asks for. Documents are not sent to the counts word
by word. A task takes many documents, looks up what its bounded broadcast holds (single words, and pairs of the most frequent
words, which are also the hot keys), and sends one packed row of the remaining bigrams to each shard; the shard's task joins
them with the counts and sends back sums. Weights are whole numbers of 1/1024 nat, so sums agree in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, checkpointed, few, scratch, ship_package, slices, table, written
from .simhash import pieces

#: Words that the model tells apart, most frequent first; all others are one class. Bounds what is broadcast.
VOCABULARY = 1 << 17
#: Words whose pairs are broadcast as a square of weights.
HEAD = 1 << 11
#: Trusted words for each shard of the counts, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 2_000_000, 32
#: Bigrams, and rows, that a task holds before it packs them for the shards.
CHUNK, CHUNK_ROWS = 1 << 20, 1 << 14
#: Words outside the vocabulary that its last class is spread over.
OPEN_WORDS = 1_000_000
#: Pseudo-words at the language's mean that steady the perplexity of short texts.
STEADY = 20
#: Held-out documents of a language at which its own quantile counts as much as that of all languages.
SHRINK = 100
#: Of so many trusted ids one is held out for the thresholds.
HELD_OUT = 5
#: Weights are whole numbers of this part of a nat.
STEP = 1024
START, END, OTHER = 0, 1, 2
#: Longer words stand under a digest.
LONG = 64
_BITS = 17
_MASK = (1 << 2 * _BITS) - 1
#: An odd factor: multiplication by it mixes bigrams one to one.
_MIX = 0x2545F4914F6CDD1D & _MASK


def discounts(counts: np.ndarray | list[int], of: bool = False) -> np.ndarray:
    """The three discounts of one order from its counts, or (``of``) from its counts of counts, between 0 and the count."""
    n1, n2, n3, n4 = counts if of else [(np.asarray(counts) == i).sum() for i in (1, 2, 3, 4)]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    steps = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(s, 0.05), i + 0.95) for i, s in enumerate(steps))])


def pack(ordered: np.ndarray) -> bytes:
    """Numbers in ascending order as compressed planes of the bytes of their differences."""
    steps = np.diff(ordered.astype(np.uint64), prepend=np.uint64(0))
    width = 4 if not len(steps) or int(steps.max()) < 1 << 32 else 8
    planes = steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint64), dtype=np.uint64)


def pack_any(values: np.ndarray, kind: str) -> bytes:
    """Numbers of one kind in any order as compressed planes of their bytes."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def unpack_any(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first.astype(np.uint64) << np.uint64(_BITS) | second.astype(np.uint64)) * np.uint64(_MIX)) & np.uint64(_MASK)


def unmixed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = (keys * np.uint64(pow(_MIX, -1, 1 << 2 * _BITS))) & np.uint64(_MASK)
    return (plain >> np.uint64(_BITS)).astype(np.int64), (plain & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def short(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\xff" + xxhash.xxh3_128_digest(word)


@dataclass
class Vocabulary:
    """Numbers of the words told apart; built once in each Python process that gets it."""

    words: list[bytes]
    _ids: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"words": self.words, "_ids": {}}

    def __len__(self) -> int:
        return len(self.words) + 3

    def number(self, text: str | None) -> np.ndarray:
        """START, the words' numbers, END."""
        if not self._ids:
            self._ids.update((w, i + 3) for i, w in enumerate(self.words))
        get, parts = self._ids.get, [np.array([START], np.int32)]
        for words in pieces((text or "").encode("utf-8", "surrogatepass"), 0):
            found = [get(w, OTHER) for w in words]
            if len(words) and max(map(len, words)) > LONG:
                found = [get(short(w), OTHER) if len(w) > LONG else i for w, i in zip(words, found)]
            parts.append(np.array(found, np.int32))
        return np.concatenate([*parts, np.array([END], np.int32)])


@dataclass
class Model:
    """What every task gets: weights of words and of pairs of frequent words, bounded by ``VOCABULARY`` and ``HEAD``; and the
    number of shards of the counts, which are a table."""

    vocabulary: Vocabulary
    word: np.ndarray
    context: np.ndarray
    followers: np.ndarray
    cuts: np.ndarray
    shards: int
    square: np.ndarray

    def gains(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By how much a seen bigram's surprise lies below that of its back-off, in steps."""
        total = np.maximum(self.followers[first], 1)
        rest = -(self.context[first] + self.word[second]).astype(float) / STEP
        shared = np.where(second == OTHER, OPEN_WORDS, 1)  # a word of the last class has its part of the class's probability
        seen = (counts - self.cuts[np.minimum(counts, 3)]) / total / shared + np.exp(rest)
        return np.maximum(np.rint((np.log(seen) - rest) * STEP), 0).astype(np.int64)


def grams(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of all bigrams of some texts, and the text of each."""
    every = np.concatenate(runs)
    owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    inside = owner[1:] == owner[:-1]
    return every[:-1][inside], every[1:][inside], owner[1:][inside]


def count_words(texts: DataFrame, most: int) -> tuple[Vocabulary, int]:
    """The ``most`` most frequent words, ties by their bytes, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            short_ones: Counter[bytes] = Counter()
            for w, n in seen.items():
                short_ones[short(w)] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(short_ones), pa.binary()), pa.array(list(short_ones.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for words in pieces((text or "").encode("utf-8", "surrogatepass"), 0):
                    seen.update(words)
                    if len(seen) > 500_000:
                        yield out()
        yield out()

    counted = checkpointed(texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return Vocabulary(top.column("word").to_pylist()), counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def count_bigrams(texts: DataFrame, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """Shards of bigram counts (``shard``, ``keys``, ``counts``), and of each task rows without a shard of what each word
    has: ``word``, ``after`` (occurrences as first word), ``n1``, ``n2``, ``n3`` (followers seen once, twice, more), ``before`` (distinct predecessors)."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    shift = np.uint64(2 * _BITS - (shards - 1).bit_length())

    def dealt(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(keys >> shift, np.arange(shards + 1).astype(np.uint64))
        rows = [(i, pack(keys[a:b]), pack_any(counts[a:b], "<u4")) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                first, second, _ = grams([known.value.number(text)])
                held.append(mixed(first, second))
                size += len(first)
                if size > CHUNK:
                    yield from dealt(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield from dealt(*np.unique(np.concatenate(held), return_counts=True))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(known.value)
        sums = np.zeros((5, size), np.int64)

        def close(shard: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)
            first, second = unmixed(keys)
            for row, which, weights in ((0, first, counts), (1, first, counts == 1), (2, first, counts == 2), (3, first, counts > 2), (4, second, None)):
                sums[row] += np.bincount(which, weights=weights, minlength=size).astype(np.int64)
            of = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([pack_any(counts, "<u8")], pa.binary()), pa.array([of], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.list_(pa.int64())))], names=["shard", "keys", "counts", "of", "words"])

        at, held = None, []
        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and shard != at:
                    yield close(at, held)
                    held = []
                at = shard
                held.append((unpack(keys), unpack_any(counts, "<u4")))
        if held:
            yield close(at, held)
            used = np.flatnonzero(sums.any(axis=0))
            rows = np.stack([used, *sums[:, used]], axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.list_(pa.int64())))], names=["shard", "keys", "counts", "of", "words"])

    packed = texts.select("text").mapInArrow(chunks, "shard int, keys binary, counts binary")
    return written(packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, "shard int, keys binary, counts binary, of array<long>, words array<array<long>>"))


def fit(texts: DataFrame, most_words: int = VOCABULARY, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of all ``texts`` (``text``) and its counts in shards (``shard``, ``keys``, ``counts``)."""
    if most_words > 1 << _BITS:
        raise ValueError(f"a vocabulary has at most {1 << _BITS} words")
    ship_package(texts.sparkSession)
    vocabulary, n_words = count_words(texts, most_words - 3)
    shards = max(LEAST_SHARDS, 1 << (n_words // SHARD_WORDS).bit_length())
    table_of_counts = count_bigrams(texts, vocabulary, shards)
    counts = table_of_counts.where("shard is not null").select("shard", "keys", "counts")
    one = F.explode("words").alias("w")
    by_word = table_of_counts.where("shard is null").select(one).groupBy(F.col("w")[0].alias("word")).agg(*(F.sum(F.col("w")[i + 1]).alias(f"s{i}") for i in range(5))).toArrow()
    sums = np.zeros((5, len(vocabulary)), np.int64)
    sums[:, by_word.column("word").to_numpy()] = [by_word.column(f"s{i}").to_numpy() for i in range(5)]
    of = table_of_counts.where("shard is not null").select(*(F.coalesce(F.sum(F.col("of")[i]), F.lit(0)) for i in range(4))).first()
    after, n1, n2, n3, before = sums
    cuts, lower = discounts(list(of), True), discounts(before)
    total = max(int(before.sum()), 1)
    kept = before - lower[np.minimum(before, 3)]
    rest = lower[np.minimum(before, 3)].sum() / total if before.any() else 1.0
    p = kept / total + rest / OPEN_WORDS
    p[OTHER] = (kept[OTHER] / total + rest) / OPEN_WORDS
    left = np.where(after > 0, (cuts[1] * n1 + cuts[2] * n2 + cuts[3] * n3) / np.maximum(after, 1), 1.0)
    model = Model(vocabulary, np.rint(-np.log(p) * STEP).astype(np.int64), np.rint(-np.log(np.maximum(left, 1e-9)) * STEP).astype(np.int64), after, cuts, shards, np.zeros((0, 0), np.int16))
    model.square = head_square(counts, model, min(head, len(vocabulary)))
    return model, counts


def head_square(counts: DataFrame, model: Model, head: int) -> np.ndarray:
    """Gains of the pairs of the ``head`` first words, which tasks look up without a join."""
    light = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (first, second), n = unmixed(unpack(keys)), unpack_any(packed, "<u8").astype(np.int64)
                near = np.flatnonzero((first < head) & (second < head))
                first, second = first[near], second[near]
                yield pa.RecordBatch.from_arrays([pa.array((first * head + second).astype(np.int32)), pa.array(light.value.gains(first, second, n[near]).astype(np.int16))], names=["cell", "gain"])

    found = counts.select("keys", "counts").mapInArrow(run, "cell int, gain short").toArrow()
    square = np.zeros(head * head, np.int16)
    square[found.column("cell").to_numpy()] = found.column("gain").to_numpy()
    return square.reshape(head, head)


def surprises(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``text_key``, ``surprise`` (natural log), ``n_words`` of every distinct ``text_key``. ``texts``: ``text_key``, ``text``.

    A chunk of documents is one row of what is known at once and one packed row of bigrams for each shard, named by the
    chunk's keys; an answer that lacks a shard's part is an error, not a wrong figure.
    """
    spark = texts.sparkSession
    ship_package(spark)
    known = spark.sparkContext.broadcast(model)
    shards, shift = model.shards, np.uint64(2 * _BITS - (model.shards - 1).bit_length())
    names = ["shard", "kind", "chunk", "a", "b", "c"]
    schema = "shard int, kind int, chunk long, a binary, b binary, c binary"

    def rows(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        head = len(own.square)
        keys, base, sizes, tails, owners, held = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            names_of = b"".join(keys)
            chunk = int.from_bytes(xxhash.xxh64_digest(names_of), "big", signed=True)
            tail, owner = np.concatenate(tails), np.concatenate(owners)
            order = np.argsort(tail, kind="stable")
            tail, owner = tail[order], owner[order]
            ends = np.searchsorted(tail >> shift, np.arange(shards + 1).astype(np.uint64)).tolist()
            out = [(-1 - chunk % shards, 0, chunk, names_of, pack_any(np.concatenate(base), "<i8"), pack_any(np.concatenate(sizes), "<i8"))]
            out += [(i, 1, chunk, pack(tail[a:b]), pack_any(owner[a:b], "<u2"), None) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            for x in (keys, base, sizes, tails, owners):
                x.clear()
            return rows(out)

        for batch in slices(batches):
            runs = [own.vocabulary.number(t) for t in batch.column(1).to_pylist()]
            first, second, owner = grams(runs)
            near = (first < head) & (second < head)
            weight = own.word[second] + own.context[first]
            weight[near] -= own.square[first[near], second[near]]
            base.append(np.bincount(owner, weights=weight, minlength=len(runs)).astype(np.int64))
            sizes.append(np.array([len(r) - 2 for r in runs], np.int64))
            tails.append(mixed(first[~near], second[~near]))
            owners.append(owner[~near] + len(keys))
            keys += batch.column(0).to_pylist()
            held += int((~near).sum())
            if held > CHUNK or len(keys) >= CHUNK_ROWS:
                yield close()
                held = 0
        if keys:
            yield close()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, keys, gains = known.value, None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, 64):
            out = []
            for shard, kind, chunk, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    out.append((shard, kind, chunk, a, b, c))
                    continue
                if shard != at:
                    at, keys, gains = shard, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == -1:
                    keys = unpack(a)
                    gains = own.gains(*unmixed(keys), unpack_any(b, "<u8").astype(np.int64))
                    continue
                tail, owner = unpack(a), unpack_any(b, "<u2").astype(np.int64)
                if len(keys) and len(tail):
                    spot = np.minimum(np.searchsorted(keys, tail), len(keys) - 1)
                    sums = np.bincount(owner, weights=np.where(keys[spot] == tail, gains[spot], 0)).astype(np.int64)
                else:
                    sums = np.zeros(0, np.int64)
                who = np.flatnonzero(sums)
                out.append((shard, kind, chunk, pack(who.astype(np.uint64)), pack_any(sums[who], "<i4" if sums.max(initial=0) < 1 << 31 else "<i8"), bytes([4 if sums.max(initial=0) < 1 << 31 else 8])))
            if out:
                yield rows(out)

    def answered(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_pylist()
        if kinds.count(0) < 1 or kinds.count(1) != shards * kinds.count(0):
            raise ValueError(f"chunk with {kinds.count(1)} parts of {shards} shards")
        repeats, first = kinds.count(0), kinds.index(0)
        names_of = group["a"][first].as_py()
        value, n = unpack_any(group["b"][first].as_py(), "<i8").copy(), unpack_any(group["c"][first].as_py(), "<i8")
        gained = np.zeros(len(value), np.int64)
        for kind, a, b, c in zip(kinds, group["a"].to_pylist(), group["b"].to_pylist(), group["c"].to_pylist()):
            if kind == 1:
                gained[unpack(a).astype(np.int64)] += unpack_any(b, f"<i{c[0]}")
        value -= gained // repeats
        return pa.table({"text_key": pa.array([names_of[i : i + 16] for i in range(0, len(names_of), 16)], pa.binary()), "surprise": value / STEP, "n_words": n})

    mine = counts.select("shard", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))
    met = texts.select("text_key", "text").mapInArrow(asked, schema).union(mine).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(joined, schema)
    return met.groupBy("chunk").applyInArrow(answered, "text_key binary, surprise double, n_words long").groupBy("text_key").agg(F.max("surprise").alias("surprise"), F.max("n_words").alias("n_words"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def score_table(docs: DataFrame, labels: DataFrame, quantile: float, seed: str, vocabulary: int, head: int) -> DataFrame:
    """``__row`` columns of every document without its text: its own columns, ``__key``, ``n_words``, ``perplexity``, ``threshold``, ``keep``."""
    spark = docs.sparkSession
    ship_package(spark)
    held = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(HELD_OUT)) == 0
    trusted = checkpointed(trusted_ids(labels).withColumn("held", held))
    model, counts = fit(docs.select("doc_id", "text").join(few(trusted.where("not held").select("doc_id")), "doc_id").select("text"), vocabulary, head)
    scores = surprises(docs.select(F.col("__key").alias("text_key"), "text"), model, counts)
    path = scratch(spark, "quality-scores")
    docs.drop("text").join(scores.withColumnRenamed("text_key", "__key"), "__key").write.parquet(path)
    scored = spark.read.parquet(path)

    held_out = scored.select("doc_id", "lang", "surprise", "n_words").join(few(trusted.where("held").select("doc_id")), "doc_id", "left_semi")
    rate = lambda mean: F.exp((F.col("surprise") + STEADY * mean) / (F.col("n_words") + 1 + STEADY))
    language = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")).alias("__language")
    mean = F.sum("surprise") / F.sum(F.col("n_words") + 1)
    every = held_out.agg(mean.alias("mean")).first()["mean"]
    means = checkpointed(held_out.groupBy(language).agg(mean.alias("mean")))
    above = held_out.withColumn("__language", language).join(few(means), "__language").withColumn("perplexity", rate(F.col("mean"))).withColumn("above", F.log("perplexity") - F.col("mean"))
    usual, overall = above.agg(F.percentile_approx("above", quantile, 10_000), F.percentile_approx("perplexity", quantile, 10_000)).first()
    own = above.groupBy("__language").agg(F.first("mean").alias("__mean"), F.count(F.lit(1)).alias("n"), F.percentile_approx("above", quantile, 10_000).alias("own"))
    shrunk = (F.col("n") * F.col("own") + SHRINK * F.lit(usual).cast("double")) / (F.col("n") + SHRINK)
    limits = few(checkpointed(own.select("__language", "__mean", F.exp(F.col("__mean") + shrunk).alias("threshold"))))
    result = scored.withColumn("__language", language).join(limits, "__language", "left")
    result = result.withColumn("perplexity", rate(F.coalesce("__mean", F.lit(0.0 if every is None else every)))).withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    return result.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).drop("surprise", "__mean")


MADE = ["n_words", "perplexity", "threshold", "keep", "surprise", "mean", "__key", "__language", "__mean"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*beside(docs, MADE), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__key"))


def rate_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, seed: str = "trusted", vocabulary: int = VOCABULARY, head: int = HEAD) -> DataFrame:
    """Perplexity of every document, its language's threshold, and whether it is kept.

    The model counts all documents that ``labels`` (``doc_id``, ``quality``) marks 1, but for a fifth of their ids, drawn from
    ``seed``, that is held out; the ``vocabulary`` most frequent words are told apart and all others are one class. All
    documents are scored in whole. Each held-out document takes part in its language's threshold: the ``quantile`` of their
    perplexity over the language's mean, drawn towards that of all languages as by ``SHRINK`` documents, since the quantile of
    a few is their maximum. A perplexity is the exponential of (surprise + 20 * the language's mean) / (words + 1 + 20), which
    keeps a few rare words from deciding over a short text. Returns the columns of ``docs`` without ``text``, and ``n_words``,
    ``perplexity``, ``threshold``, ``keep``; columns of those names in ``docs`` give way. Null language: a language of its own.
    Null or blank text: only the text's end is scored. A language without held-out documents takes the threshold of all;
    without any label everything is kept with a null threshold. Equal texts are scored once and repeated rows stay; empty
    input: no rows.
    """
    rated = score_table(keyed(docs), labels, quantile, seed, vocabulary, head)
    return rated.select(*beside(docs, [*MADE, "text"]), "n_words", "perplexity", "threshold", "keep")


def keep_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, seed: str = "trusted") -> DataFrame:
    """The rows of ``docs`` that ``rate_quality`` keeps, with their text, which is moved only if very many are rejected."""
    keys = keyed(docs)
    rated = score_table(keys, labels, quantile, seed, VOCABULARY, HEAD)
    rejected = few(checkpointed(rated.where("not keep").select("__key", "__language").distinct()))
    language = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    return keys.withColumn("__language", language).join(rejected, ["__key", "__language"], "left_anti").select(beside(docs, MADE))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision for every document."""
    rated = rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "lang", "n_words", "perplexity", "threshold", "keep")
