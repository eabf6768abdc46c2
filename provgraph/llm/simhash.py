"""SimHash near-duplicates by a grid join over segment popcounts.

A fingerprint's segments are mapped to their numbers of set bits. The Manhattan distance of two such points never exceeds
the Hamming distance of the fingerprints, and two lattice points at Manhattan distance 2 or less share a lattice point at
distance 1 or less from both. So every fingerprint is sent to its own cell and the cells one step away, fingerprints that
meet in a cell are the candidates, and their Hamming distance is then taken exactly.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, few, ship_package, slices, table, written

RADIUS = 2
#: Fingerprints of one cell, and members of one group of candidates, that a task compares at once; larger ones are split.
CROWD = 4096
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: One text in so many is asked which shingles are common, and how many of these are broadcast. Only speed depends on both.
ASKED, COMMON = 8, 400_000
#: Bits of a text's parity sketch for each of its shingles, and the least and largest sketch.
SKETCH_BITS, LEAST_SKETCH, LARGEST_SKETCH = 8, 512, 65_536

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COUNT = _BITS.sum(axis=1).astype(np.uint8)


def pieces(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each list begins with the last ``overlap`` words of the one before."""
    at, last = 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = last + text[at:end].split()
        at = end + 1
        yield words
        last = words[-overlap:] if overlap else []


def shingle_hashes(text: bytes, size: int) -> Iterator[list[int]]:
    """Unsigned XXH64 (seed 42) of every run of ``size`` words, joined by spaces; of all words, if they are fewer."""
    seen = False
    whole: list[bytes] = []
    for words in pieces(text, size - 1):
        whole = words
        if len(words) < size:
            continue
        seen = True
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]]
        digest = xxhash.xxh64_intdigest
        yield [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())]
    if not seen and whole:
        yield [xxhash.xxh64_intdigest(b" ".join(whole), 42)]


def majority(chunks: Iterator[bytes], width: int) -> bytes:
    """Bits that are set in over half of the ``width``-byte hashes; zero bits without hashes."""
    total, ones = 0, np.zeros((width, 8), np.int64)
    for chunk in chunks:
        columns = np.frombuffer(chunk, np.uint8).reshape(-1, width)
        total += len(columns)
        for i in range(width):
            ones[i] += np.bincount(columns[:, i], minlength=256) @ _BITS
    return np.packbits(2 * ones > total).tobytes()


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint as a signed number."""
    lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    packed = majority((np.array(h, dtype=">u8").tobytes() for h in shingle_hashes(lowered, size)), 8)
    return int.from_bytes(packed, "big", signed=True)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32)


def cell_keys(values: np.ndarray, bits: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: every value's own cell and the cells one step away along each segment's count."""
    count = bits // segment
    shifts = np.arange(count, dtype=np.uint64) * np.uint64(segment)
    parts = (values.view(np.uint64)[:, None] >> shifts) & np.uint64(2**segment - 1)
    counts = _COUNT[parts].astype(np.int64)
    steps = np.int64(segment + 1) ** np.arange(count, dtype=np.int64)
    own = counts @ steps
    rows, up = np.nonzero(counts < segment)
    rows2, down = np.nonzero(counts > 0)
    return np.r_[np.arange(len(values)), rows, rows2], np.r_[own, own[rows] + steps[up], own[rows2] - steps[down]]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the links, taken in order, that join two parts not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def close_pairs(keys: np.ndarray, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs in the same run of equal keys for which ``close(i, j)`` holds, one distance at a time."""
    at, gap = np.arange(len(keys)), 1
    while True:
        at = at[: np.searchsorted(at, len(keys) - gap)]
        at = at[keys[at] == keys[at + gap]]
        if not len(at):
            return
        fits = close(at, at + gap)
        if fits.any():
            yield at[fits], at[fits] + gap
        gap += 1


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first column, cut so that no run of equal keys is divided; lone keys are left out."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield crowded([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield crowded(held)


def crowded(columns: list[np.ndarray]) -> list[np.ndarray]:
    same = columns[0][1:] == columns[0][:-1]
    keep = np.r_[same, False] | np.r_[False, same]
    return [c[keep] for c in columns]


def in_cells(df: DataFrame) -> DataFrame:
    """Bring equal keys together, sorted."""
    return df.repartition("key").sortWithinPartitions("key")


def split_crowds(probed: DataFrame) -> DataFrame:
    """Give the members of crowded cells (``key``, ``fp``) three finer keys, by the thirds of the fingerprint.

    Fingerprints that differ in two bits agree in one of three parts, so what is close in a cell still meets.
    """
    crowds = few(checkpointed(probed.groupBy("key").count().where(F.col("count") > CROWD).select("key", F.lit(True).alias("crowd"))))
    third = lambda i: F.shiftrightunsigned("fp", 22 * i).bitwiseAND(F.lit((1 << 22) - 1))
    finer = F.array(*(F.xxhash64("key", F.lit(i), third(i)) for i in range(3)))
    return probed.join(crowds, "key", "left").select(F.explode(F.when(F.col("crowd"), finer).otherwise(F.array("key"))).alias("key"), "fp")


def link_fingerprints(prints: DataFrame, segment: int = 4) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct longs of ``prints.fp`` at Hamming distance 2 or less.

    Of links that close a ring among those a task has seen, one is left out; the components stay the same.
    """

    def probes(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = cell_keys(fp, 64, segment)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    def links(batches):
        for keys, fp in whole_runs(batches):
            for i, j in close_pairs(keys, lambda i, j: hamming(fp[i], fp[j]) <= RADIUS):
                a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
                keep = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    ship_package(prints.sparkSession)
    probed = prints.select("fp").distinct().mapInArrow(probes, "key long, fp long")
    return in_cells(split_crowds(probed)).mapInArrow(links, "a long, b long").where("a <> b").distinct()


def simhash_components(docs: DataFrame, size: int = 3, segment: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    The fingerprint is the bitwise majority of the shingles' XXH64; fingerprints at Hamming distance 2 or less are linked
    and ``component_id`` is the least doc_id that links reach. Null, empty and blank texts have fingerprint zero and link
    like any other. Equal fingerprints are one node, so copies cost one row in the join. A null doc_id keeps its row and
    never becomes a component's id unless there is no other. Repeated rows stay. Empty input: no rows. Other columns are
    ignored.
    """

    def prints(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    ship_package(docs.sparkSession)
    printed = checkpointed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fp long"))
    nodes = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(checkpointed(link_fingerprints(nodes, segment)))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    low, high = (x, y) if len(x) <= len(y) else (y, x)
    spot = np.minimum(np.searchsorted(high, low), len(high) - 1)
    both = int((high[spot] == low).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs whose sets of ``size``-word shingles have Jaccard similarity ``least`` or more. ``texts``: ``node``, ``text``."""

    def sets(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([distinct_shingles(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    def enough(batches):
        for batch in slices(batches):
            keep = [similarity(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shingles = checkpointed(texts.mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
    one, two = shingles.toDF("a", "x"), shingles.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(enough, "a long, b long")


def distinct_shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    found = [np.unique(np.array(h, dtype=np.uint64)) for h in shingle_hashes(lowered, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def prefix(found: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in an order of all shingles, rare ones first.

    Sets of similarity ``least`` share at least ``least`` of either; so of each set's last ones, fewer than that, cannot
    hold all that is shared, and the first of the shared ones stands in both prefixes. Empty sets share the key 0.
    """
    if not len(found):
        return np.zeros(1, np.uint64)
    keys, counts = common
    rank = np.zeros(len(found), np.int64)
    if len(keys):
        spot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[spot] == found, counts[spot], 0)
    return found[np.lexsort((found, rank))[: len(found) - math.ceil(least * len(found) - 1e-9) + 1]]


def parity_sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of a power of two of places, some for each shingle.

    Two sketches, the larger folded to the smaller, differ in no more bits than the sets in members.
    """
    bits = min(max(1 << (SKETCH_BITS * len(found)).bit_length(), LEAST_SKETCH), LARGEST_SKETCH)
    places = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of ``width`` bytes or a power of two times that, as rows of 64-bit numbers of the lesser width."""
    rows = []
    for s in sketches:
        x = np.frombuffer(s, np.uint64)
        while len(x) * 8 > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def common_shingles(keyed: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several of the texts asked, sorted, and in how many they stand. ``keyed``: ``text_key``, ``text``."""

    def run(batches):
        for batch in slices(batches):
            found = [distinct_shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["key"])

    asked = keyed.where(F.pmod(F.xxhash64(F.lit("asked"), "text_key"), F.lit(ASKED)) == 0).dropDuplicates(["text_key"])
    counted = asked.select("text").mapInArrow(run, "key long").groupBy("key").count().where("count >= 2")
    top = counted.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("count").to_numpy()[order]


def signature(nodes: np.ndarray) -> np.ndarray:
    """Mixed node numbers, whose sums name sets of nodes."""
    x = (nodes.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sharing_groups(nodes: DataFrame) -> DataFrame:
    """Groups (``key``, ``node``) of nodes that share a prefix shingle; equal groups of several shingles are one.

    A group's key is the sum of its nodes' mixed numbers, so groups that agree in it are put together, which loses no pair.
    A group above ``CROWD`` keeps its shingle as key, and its rows pass through without being held.
    """

    def spread(batches):
        for batch in slices(batches, 1024):
            node = batch.column(0).to_numpy()
            prefixes = batch.column(1).to_pylist()
            counts = [len(p) // 8 for p in prefixes]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(np.repeat(node, counts))], names=["key", "node"])

    def merged(keys, node):
        starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        counts = np.diff(np.r_[starts, len(keys)])
        named = np.where(counts > CROWD, keys[starts], np.add.reduceat(signature(node), starts).view(np.int64))
        first = np.zeros(len(starts), bool)
        first[np.unique(named, return_index=True)[1]] = True
        keep = np.repeat(first, counts)
        return np.repeat(named, counts)[keep], node[keep]

    def meet(batches):
        crowd, last = None, None
        for keys, node in runs_in_bounds(batches, CROWD):
            if crowd is not None and keys[0] == crowd:
                own = int(np.searchsorted(keys, crowd, side="right"))
                yield batch_of(key=keys[:own], node=node[:own])
                keys, node = keys[own:], node[own:]
            if not len(keys):
                continue
            crowd, last = None, keys[-1]
            tail = int(np.searchsorted(keys, last))
            if len(keys) - tail > CROWD:
                crowd = last
            single = crowded([keys, node])
            if len(single[0]):
                key, member = merged(*single)
                yield batch_of(key=key, node=member)

    return in_cells(nodes.select("node", "prefix").mapInArrow(spread, "key long, node long")).mapInArrow(meet, "key long, node long").distinct()


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def runs_in_bounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first column. A run of equal keys is divided only where more than ``most`` rows of it are held."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if len(held[0]) - cut > most:
            cut = len(held[0])
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def possible_pairs(n: np.ndarray, part: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of different parts whose sizes and sketches allow the similarity, and how far apart they look."""
    width = np.array([len(s) for s in sketches])
    ones, twos, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for w in np.unique(width).tolist():
        here = np.flatnonzero((width == w) | (width == 2 * w))
        here = here[np.argsort(width[here], kind="stable")]
        bits, sizes, own = folded(sketches[here].tolist(), w), n[here], part[here]
        for i in range(int((width[here] == w).sum())):
            j = i + 1 + np.flatnonzero((own[i + 1 :] != own[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= least * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9))
            if not len(j):
                continue
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            both = sizes[j] + sizes[i]
            fits = apart <= both * (1 - least) / (1 + least) + 1e-6
            ones.append(np.full(int(fits.sum()), here[i]))
            twos.append(here[j[fits]])
            far.append(apart[fits] / np.maximum(both[fits], 1))
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(far)


def candidate_pairs(dealt: DataFrame, least: float, every: bool) -> DataFrame:
    """Pairs ``a``, ``b`` of different parts that a group (``key``) allows; a null ``b`` marks the group ``a`` as not done.

    With ``every``, all of them; else of each group the nearest pairs that join what the nearer ones have not joined, and
    groups of which a pair was left out are marked. ``dealt``: ``key``, ``node``, ``part``, ``n``, ``sketch``, ``name``, where
    ``name`` is the group's name and ``key`` that of the share of it that meets here.
    """

    def links(batches):
        for keys, node, part, n, sketch, name in whole_runs(batches):
            ones, twos, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)] if len(keys) else np.zeros(1, int)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                i, j, far = possible_pairs(n[s:e], part[s:e], sketch[s:e], least)
                a, b = np.minimum(node[s:e][i], node[s:e][j]), np.maximum(node[s:e][i], node[s:e][j])
                if not every and len(a):
                    order = np.lexsort((b, a, far))
                    keep = order[forest(part[s:e][i][order], part[s:e][j][order])]
                    if len(keep) < len(a):
                        left.append(name[s])
                    a, b = a[keep], b[keep]
                ones.append(a)
                twos.append(b)
            pairs = np.unique(np.stack([np.concatenate(ones), np.concatenate(twos)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[0], np.array(left, np.int64)]), pa.array(pairs[1].tolist() + [None] * len(left), pa.int64())], names=["a", "b"])

    return in_cells(dealt).mapInArrow(links, "a long, b long").where("b is null or a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (a null one only if there is no other).

    Two texts are near-duplicates if the Jaccard similarity of their sets of ``size``-word shingles (A-Z lower-cased) is
    ``least`` or more; every link is verified on the sets themselves. Candidates come first from the SimHash grid join, and
    then, for pairs whose fingerprints lie further apart, from shared prefix shingles, which no pair at ``least`` lacks,
    whatever was changed in the text and where; sizes and parity sketches rule out most that cannot reach it. Each group of
    texts with a shared shingle first gives only the nearest pairs that join its parts, and in the end every pair that
    still lies between different parts, so the pairs of a group of copies grow with its size and not with its square.
    Groups above ``CROWD`` are dealt to blocks; the members outside the group's largest part meet every block in the end.
    Equal texts are one node from the start, empty and null texts one group.
    Returns the columns of ``docs``, whatever their names; repeated rows leave one; empty input gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    keyed = packed.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    common = spark.sparkContext.broadcast(common_shingles(keyed.select("text_key", "text"), size))

    def sets(batches):
        for batch in slices(batches):
            found = [distinct_shingles(t, size) for t in batch.column(2).to_pylist()]
            prints = [int.from_bytes(majority(iter([f.astype(">u8").tobytes()]), 8), "big", signed=True) for f in found]
            made = [pa.array([len(f) for f in found], pa.int64()), pa.array(prints, pa.int64()), pa.array([prefix(f, least, common.value).tobytes() for f in found], pa.binary()), pa.array([parity_sketch(f) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_key", "n", "fp", "prefix", "sketch"])

    coded = keyed.select(F.col("doc_id").cast("long"), "text_key", "text").mapInArrow(sets, "doc_id long, text_key binary, n long, fp long, prefix binary, sketch binary")
    once = coded.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fp", "prefix", "sketch")))
    nodes = written(once.withColumn("node", F.monotonically_increasing_id()))
    links, tried, parts = [], [], nodes.select("node", F.col("node").alias("root")).limit(0)

    def verify(pairs: DataFrame) -> None:
        """Add what holds of ``pairs``, a table in the shared folder, to the links, and the parts that they make."""
        nonlocal parts
        if pairs.isEmpty():
            return
        tried.append(pairs)
        wanted = few(checkpointed(pairs.select("a").union(pairs.select("b")).distinct().join(nodes.select(F.col("node").alias("a"), "text_key"), "a").toDF("node", "text_key")))
        found = checkpointed(verified(pairs, keyed.select("text_key", "text").join(wanted, "text_key").select("node", "text"), size, least))
        if not found.isEmpty():
            links.append(found)
            parts = connected_components(functools.reduce(DataFrame.union, links))

    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = link_fingerprints(nodes).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    verify(written(equal.union(close).distinct()))

    groups = written(sharing_groups(nodes))
    group_sizes = groups.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
    for turn in ("within", "between", "every"):
        placed = groups.join(few(parts), "node", "left").withColumn("part", F.coalesce("root", "node")).select("key", "node", "part")
        divided = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
        placed = written(placed.join(divided, "key").join(group_sizes, "key"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        if turn == "between":
            rows = placed.groupBy("key", "part").agg(F.min("node").alias("x"), F.max("node").alias("y")).select("key", "part", F.explode(F.array_distinct(F.array("x", "y"))).alias("node"))
            sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
            rows = rows.join(sizes, "key").withColumn("block", block)
        elif turn == "within":
            rows = placed.withColumn("block", block)
        else:
            largest = placed.where("blocks > 1").groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", "count").alias("largest"))
            blocks = F.when((F.col("blocks") == 1) | (F.col("part") == F.col("largest")), F.array(block)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
            rows = placed.join(largest, "key", "left").withColumn("block", F.explode(blocks))
        share = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "block"))
        dealt = rows.join(nodes.select("node", "n", "sketch"), "node").select(share.alias("key"), "node", "part", "n", "sketch", F.col("key").alias("name"))
        found = written(candidate_pairs(dealt, least, turn == "every"))
        pairs = found.where("b is not null")
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        verify(written(pairs))
        if turn == "within":
            undone = found.where("b is null").select(F.col("a").alias("key")).union(group_sizes.where("blocks > 1").select("key")).distinct()
            groups = written(groups.join(undone, "key"))
            group_sizes = groups.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
    grouped = nodes.select("node", "text_key", "doc_id").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = grouped.groupBy("root").agg(F.min_by(F.struct("text_key", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("w")).select(F.col("w.text_key").alias("text_key"), F.coalesce("w.doc_id", F.lit(-1)).alias("__id"), F.col("w.doc_id").isNull().alias("__null"))
    marked = keyed.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("__null", F.col("doc_id").isNull())
    once = F.row_number().over(Window.partitionBy("text_key", "__id", "__null").orderBy(F.lit(0)))
    return marked.join(winners, ["text_key", "__id", "__null"]).withColumn("__n", once).where("__n = 1").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component that its links reach."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
