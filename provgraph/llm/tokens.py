"""Unigram segmentation of whole texts: encoding and decoding with a max-plus scan for giant documents, and token counts.

The pieces are those of a public SentencePiece file, whose path is a parameter. Where that file holds a BPE model, its
ranks are turned to unigram log-probabilities by Zipf's law, in steps of 1/8, so that sums are exact in any order and equal
those of the library's 32-bit floats. Ties go as in the library's unigram encoder: for each end the candidate that starts
first wins, and a character that is no piece itself costs the least score minus 10 and becomes its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import beside, checkpointed, ship_package, slices, table

SPACE = "▁"
UNITS = 8
NONE = -(1 << 60)
#: Code points of a chunk; longer texts are giants. Units of text that the caches of pieces and of counts hold, and the
#: longest one held.
CHUNK, ENCODED, COUNTED, LONGEST = 65_536, 300_000, 500_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(scores: list[float]) -> list[float]:
    """Log-probabilities of ranks (minus the BPE score) by Zipf's law, rounded to eighths; scoreless pieces come last."""
    ranks = [-s if s > -1e8 else len(scores) for s in scores]
    return [-round(math.log(2 + r) * UNITS) / UNITS for r in ranks]


class Vocabulary:
    """Pieces with scores in whole steps; made on the driver, sent to the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], ids: list[int], byte_ids: list[int]) -> None:
        self.pieces, self.ids, self.byte_ids = pieces, ids, byte_ids
        self.scores = [round(s * UNITS) for s in scores]
        self.unknown = min(self.scores) - 10 * UNITS
        self.longest = max(map(len, pieces))
        self.open()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        normal = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in normal], zipf_scores([model.get_score(i) for i in normal]), normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, score in zip(self.pieces, self.scores):
            found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    def open(self) -> None:
        self.single = {p for p in self.pieces if len(p) == 1}
        self.id_of = dict(zip(self.pieces, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece goes on after a space")
        line = "" if any("\n" in p for p in self.pieces) else "\n"
        #: Units: no piece reaches over their ends, so each can be segmented by itself.
        self.unit = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.edge = re.compile(f"(?<=[^{SPACE}]){SPACE}" + ("|\n|(?<=\n)." if line else ""), re.S)
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in zip(self.pieces, self.ids)} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.encoded: dict[str, bytes] = {}
        self.counted: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pieces", "ids", "byte_ids", "scores", "unknown", "longest")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def forward(self, text: str, base: int, entry: list[int]) -> tuple[list[int], bytearray]:
        """Best scores of all ends after ``base`` and the lengths of their last pieces; ``entry[s]`` is the score at base - s."""
        size = len(text)
        best, back = [NONE] * (size + 1), bytearray(size + 1)
        for s, score in enumerate(entry):
            if base - s >= 0:
                best[base - s] = score
        at, single, unknown = base + 1, self.single, self.unknown
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            if end <= base:
                continue
            while at < end:
                if text[at - 1] not in single and best[at - 1] > NONE and best[at - 1] + unknown > best[at]:
                    best[at], back[at] = best[at - 1] + unknown, 1
                at += 1
            start = best[end - length]
            if start > NONE and start + score > best[end]:
                best[end], back[end] = start + score, length
        while at <= size:
            if text[at - 1] not in single and best[at - 1] > NONE and best[at - 1] + unknown > best[at]:
                best[at], back[at] = best[at - 1] + unknown, 1
            at += 1
        return best, back

    def ids_before(self, text: str, back: bytearray, end: int, base: int) -> list[int]:
        """Ids of the pieces that end after ``base``, followed back from ``end``."""
        cuts = []
        while end > base:
            cuts.append((end - back[end], end))
            end -= back[end]
        out: list[int] = []
        for s, e in reversed(cuts):
            found = self.id_of.get(text[s:e])
            out += [found] if found is not None else [self.byte_ids[b] for b in text[s:e].encode("utf-8", "surrogatepass")]
        return out

    def unit_ids(self, unit: str) -> bytes:
        _, back = self.forward(unit, 0, [0])
        return np.array(self.ids_before(unit, back, len(unit), 0), "<i4").tobytes()

    @cached_property
    def tables(self) -> tuple:
        """The pieces as a trie in arrays: character classes, the root's children, sorted edge keys with their ends, piece by node."""
        chars = sorted({c for p in self.pieces for c in p})
        kind = {c: i + 1 for i, c in enumerate(chars)}
        width = len(chars) + 1
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for char in piece:
                key = (node, kind[char])
                if key not in nodes:
                    nodes[key] = len(piece_at)
                    piece_at.append(-1)
                node = nodes[key]
            piece_at[node] = number
        first = np.full(width, -1, np.int64)
        keys, ends = [], []
        for (node, k), child in nodes.items():
            if node == 0:
                first[k] = child
            else:
                keys.append(node * width + k)
                ends.append(child)
        order = np.argsort(keys)
        classes = np.zeros(0x110000, np.uint16)
        classes[[ord(c) for c in chars]] = np.arange(1, width)
        return classes, width, first, np.array(keys, np.int64)[order], np.array(ends, np.int64)[order], np.array(piece_at, np.int64), np.array(self.scores, np.int64), np.array(self.ids, np.int64)

    def matches(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in many units at once: start, length, number of the piece. ``left``: characters from each place to its unit's end."""
        classes, width, first, keys, ends, piece_at, _, _ = self.tables
        kinds = classes[codes].astype(np.int64)
        at = np.arange(len(codes))
        node = first[kinds]
        found, length = [], 1
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = piece_at[node]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), piece[hit]))
            more = left[at] > length
            at, node = at[more], node[more]
            if not len(at):
                break
            key = node * width + kinds[at + length]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            node = np.where((keys[spot] == key) & (kinds[at + length] > 0), ends[spot], -1)
            length += 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def fill(self, units: list[str]) -> None:
        """Segment many units at once into the cache: one step for each place in a unit, for all units together."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(u) for u in units])
        stops = np.cumsum(sizes)
        starts = stops - sizes
        unit_of = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(codes)) - starts[unit_of]
        at, length, piece = self.matches(codes, sizes[unit_of] - place)
        alone = np.ones(len(codes), bool)
        alone[at[length == 1]] = False
        lone = np.flatnonzero(alone)
        at, length, piece = np.r_[at, lone], np.r_[length, np.ones(len(lone), int)], np.r_[piece, np.full(len(lone), -1)]
        gain = np.where(piece >= 0, self.tables[6][piece], self.unknown)
        # ends have a place of their own for each unit's start, so that a unit's last end is not the next one's start
        begin = at + unit_of[at]
        order = np.argsort(place[at], kind="stable")
        bounds = np.searchsorted(place[at][order], np.arange(int(sizes.max(initial=0)) + 1))
        best = np.full(len(codes) + len(units), NONE, np.int64)
        best[starts + np.arange(len(units))] = 0
        via = np.zeros(len(best), np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            step = order[lo:hi]
            score, end = best[begin[step]] + gain[step], begin[step] + length[step]
            better = (best[begin[step]] > NONE) & (score > best[end])
            best[end[better]], via[end[better]] = score[better], step[better]
        here, goal = stops + np.arange(len(units)), starts + np.arange(len(units))
        used = []
        while len(here):
            step = via[here]
            used.append(step)
            here = begin[step]
            going = here > goal
            here, goal = here[going], goal[going]
        path = np.concatenate(used) if used else np.zeros(0, int)
        path = path[np.argsort(begin[path])]
        ids = np.where(piece[path] >= 0, self.tables[7][piece[path]], -1).astype("<i4")
        cuts = np.searchsorted(unit_of[at[path]], np.arange(len(units) + 1)) * 4
        odd = set(unit_of[at[path[ids < 0]]].tolist())
        packed, cache = ids.tobytes(), self.encoded
        for i, (unit, lo, hi) in enumerate(zip(units, cuts[:-1].tolist(), cuts[1:].tolist())):
            cache[unit] = packed[lo:hi] if i not in odd else self.with_bytes(unit, ids[lo // 4 : hi // 4], (at[path[lo // 4 : hi // 4]] - starts[i]).tolist())

    def with_bytes(self, unit: str, ids: np.ndarray, begins: list[int]) -> bytes:
        """A unit's ids where some characters are no pieces and become their bytes."""
        out: list[int] = []
        for i, b in zip(ids.tolist(), begins):
            out += [i] if i >= 0 else [self.byte_ids[x] for x in unit[b].encode("utf-8", "surrogatepass")]
        return np.array(out, "<i4").tobytes()

    def encode_many(self, normals: list[str]) -> list[np.ndarray]:
        """Ids of several texts; the units that the cache lacks are segmented together."""
        units = [self.unit.findall(n) for n in normals]
        cache = self.encoded
        lacking = {u for us in units for u in us if u not in cache}
        if len(cache) + len(lacking) > ENCODED:
            cache.clear()
            lacking = {u for us in units for u in us}
        short = [u for u in lacking if len(u) <= LONGEST]
        for i in range(0, len(short), 20_000):
            self.fill(short[i : i + 20_000])
        return [np.frombuffer(b"".join([cache.get(u) or self.unit_ids(u) for u in us]), "<i4") for us in units]

    def encode(self, normal: str) -> np.ndarray:
        return self.encode_many([normal])[0]

    def count_unit(self, unit: str) -> tuple[int, int]:
        """Pieces and score of a unit; only as many ends are held as the longest piece has characters."""
        ring = 1 << self.longest.bit_length()
        mask = ring - 1
        score, count = [NONE] * ring, [0] * ring
        score[0] = 0
        single, unknown, at = self.single, self.unknown, 1

        def lone(at: int) -> None:
            here, before = at & mask, (at - 1) & mask
            char = unit[at - 1]
            if char not in single and score[before] + unknown > score[here]:
                score[here], count[here] = score[before] + unknown, count[before] + len(char.encode("utf-8", "surrogatepass"))

        fresh = 0
        for last, (length, gain) in self.automaton.iter(unit):
            end = last + 1
            while at < end:
                if fresh < at:
                    score[at & mask], fresh = NONE, at
                lone(at)
                at += 1
            here = end & mask
            if fresh < end:
                score[here], fresh = NONE, end
            start = (end - length) & mask
            if score[start] + gain > score[here]:
                score[here], count[here] = score[start] + gain, count[start] + 1
        while at <= len(unit):
            if fresh < at:
                score[at & mask], fresh = NONE, at
            lone(at)
            at += 1
        found = (count[len(unit) & mask], score[len(unit) & mask])
        if len(unit) <= LONGEST:
            if len(self.counted) >= COUNTED:
                self.counted.clear()
            self.counted[unit] = found
        return found

    def count(self, normal: str) -> tuple[int, int]:
        cache = self.counted
        pieces = score = 0
        for u in self.unit.findall(normal):
            n, s = cache.get(u) or self.count_unit(u)
            pieces += n
            score += s
        return pieces, score

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids))
        return (text[1:] if text.startswith(b" ") else text).decode("utf-8", "replace")

    def transfer(self, text: str, base: int) -> np.ndarray:
        """Best scores from each end at or before ``base`` to each of the last ends of ``text``: a max-plus matrix.

        Both sides hold as many ends as the longest piece has characters. No piece reaches over an edge between units,
        so between the first and the last edge one number stands for all ways.
        """
        wide, size = self.longest, len(text)
        edges = [m.start() for m in self.edge.finditer(text, max(base - 1, 0)) if m.start() >= base]
        first = edges[0] if edges else size
        out = np.full((wide, wide), NONE, np.int64)
        for s in range(min(wide, base + 1)):
            entry = [NONE] * s + [0]
            best, _ = self.forward(text[:first], base, entry)
            if not edges:
                out[s] = [best[size - t] if t <= size else NONE for t in range(wide)]
                continue
            if best[first] == NONE:
                continue
            middle = best[first] + self.count(text[first : edges[-1]])[1]
            tail = self.tail(text, edges[-1])
            out[s] = [tail[size - t - edges[-1]] + middle if size - t >= edges[-1] and tail[size - t - edges[-1]] > NONE else NONE for t in range(wide)]
        return out

    def tail(self, text: str, start: int) -> list[int]:
        return self.forward(text[start:], 0, [0])[0]


def normal(text: str) -> str:
    """The library's identity normalisation with a dummy prefix: spaces become the space sign."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matching matrices; associative."""
    out = np.full(a.shape, NONE, np.int64)
    for k in range(a.shape[-1]):
        step = a[:, :, k, None] + b[:, None, k, :]
        np.maximum(out, np.where((a[:, :, k, None] > NONE) & (b[:, None, k, :] > NONE), step, NONE), out=out)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products, in rounds that double the reach."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = combine(out[:-reach], out[reach:])
        reach *= 2
    return out


def encode_giants(rows: DataFrame, vocabulary, chunk: int) -> DataFrame:
    """``row`` and ``ids`` of the texts in ``rows`` (``row``, ``text``), whose chunks are worked on apart.

    First each chunk gives its transfer matrix; per text a scan of the matrices gives the scores that enter each chunk.
    With those each chunk tells for each of its last ends where the best way to it entered; following these few
    numbers from the text's end gives each chunk's own end, from which it is traced back by itself.
    """
    wide = vocabulary.value.longest

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normal(text)
                for i, start in enumerate(range(0, len(text), chunk)):
                    left = max(0, start - wide)
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([i], pa.int32()), pa.array([start - left], pa.int32()), pa.array([text[left : start + chunk]])], names=["row", "chunk", "base", "part"])

    def matrices(batches):
        for batch in batches:
            found = [vocabulary.value.transfer(t, b).tobytes() for t, b in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    def entries(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        stack = np.frombuffer(b"".join(rows["matrix"].to_pylist()), np.int64).reshape(-1, wide, wide)
        start = np.full(wide, NONE, np.int64)
        start[0] = 0
        vectors = [start, *scan(stack)[:-1, 0]]
        return pa.table({"row": rows["row"], "chunk": rows["chunk"], "entry": pa.array([v.tobytes() for v in vectors], pa.binary())})

    def origins(batches):
        for batch in batches:
            found = []
            for base, text, entry in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                best, back = vocabulary.value.forward(text, base, np.frombuffer(entry, np.int64).tolist())
                ways = []
                for t in range(wide):
                    end = len(text) - t
                    if end < 0 or best[end] == NONE:
                        ways.append(-1)
                        continue
                    while end > base:
                        end -= back[end]
                    ways.append(base - end)
                found.append(ways)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["row", "chunk", "ways"])

    def exits(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        at, found = 0, []
        for ways in reversed(rows["ways"].to_pylist()):
            found.append(at)
            at = ways[at]
        return pa.table({"row": rows["row"], "chunk": rows["chunk"], "exit": pa.array(found[::-1], pa.int32())})

    def trace(batches):
        for batch in batches:
            found = []
            for base, text, entry, leave in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                _, back = vocabulary.value.forward(text, base, np.frombuffer(entry, np.int64).tolist())
                found.append(vocabulary.value.ids_before(text, back, len(text) - leave, base))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["row", "chunk", "ids"])

    keys = ["row", "chunk"]
    chunks = checkpointed(rows.select("row", "text").mapInArrow(cut, "row long, chunk int, base int, part string").repartition(*keys))
    entered = checkpointed(chunks.mapInArrow(matrices, "row long, chunk int, matrix binary").groupBy("row").applyInArrow(entries, "row long, chunk int, entry binary"))
    opened = chunks.join(entered, keys).select(*keys, "base", "part", "entry")
    left = checkpointed(opened.mapInArrow(origins, "row long, chunk int, ways array<int>").groupBy("row").applyInArrow(exits, "row long, chunk int, exit int"))
    traced = opened.join(left, keys).select(*keys, "base", "part", "entry", "exit").mapInArrow(trace, "row long, chunk int, ids array<int>")
    return traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the pieces of every text in whole, and with ``check`` also ``round_trip``, whether they decode
    to the text; columns of ``docs`` with these names give way.

    Texts of up to ``chunk`` code points are encoded where they stand; longer ones are cut into chunks that are
    encoded apart with the same result (``encode_giants``). Null text: null ids; empty text: no ids; repeated rows are
    encoded each; empty input: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model or default_model()))
    kept = docs.select(beside(docs, ["ids", "round_trip"]))
    columns = kept.columns
    at = columns.index("text")
    made = ["ids", "round_trip"] if check else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = [None if t is None else ids for t, ids in zip(texts, vocabulary.value.encode_many([normal(t or "") for t in texts]))]
            new = [pa.array(found, pa.list_(pa.int32()))]
            if check:
                new.append(pa.array([t is None or vocabulary.value.decode(i.tolist()) == t for t, i in zip(texts, found)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *made])

    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), *([StructField("round_trip", BooleanType())] if check else [])])
    is_giant = F.coalesce(F.length("text") > chunk - 1, F.lit(False))
    plain = kept.where(~is_giant).mapInArrow(run, schema)
    giants = checkpointed(kept.where(is_giant).withColumn("row", F.monotonically_increasing_id())) if "row" not in columns else checkpointed(kept.where(is_giant).withColumnRenamed("row", "__row").withColumn("row", F.monotonically_increasing_id()))
    if giants.isEmpty():
        return plain
    encoded = giants.join(encode_giants(giants, vocabulary, chunk), "row").drop("row")
    if check:
        encoded = decode(encoded, model).withColumn("round_trip", F.col("decoded") == F.col("text"))
    return plain.union(encoded.withColumnRenamed("__row", "row").select(*columns, *made))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids: null. The space sign itself comes back as a space."""
    spark = encoded.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model or default_model()))
    kept = encoded.select(beside(encoded, ["decoded"]))
    at = kept.columns.index("ids")
    names = [*kept.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [None if i is None else vocabulary.value.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", kept.schema["text"].dataType if "text" in kept.columns else "string")]))


def count_tokens(docs: DataFrame, model: str | None = None, carry: bool = True) -> DataFrame:
    """``docs`` (with ``carry=False`` only ``doc_id``) with ``n_tokens`` and ``score``, without making the tokens.

    An Aho-Corasick automaton lists the pieces in a text, and dynamic programming carries the best score and its number of
    pieces; ties and unknown characters go as in ``encode``. Whole texts count, and memory does not grow with them.
    ``score`` is the log-probability. Null or empty text: 0 and 0.0. Columns of those names give way; repeated rows count
    each; empty input: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model or default_model()))
    kept = docs.select(beside(docs, ["n_tokens", "score"]) if carry else ["doc_id", "text"])
    columns = kept.columns
    at, out = columns.index("text"), columns if carry else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [vocabulary.value.count(normal(t or "")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in out), pa.array([n for n, _ in found], pa.int64()), pa.array([s / UNITS for _, s in found], pa.float64())], names=[*out, "n_tokens", "score"])

    fields = kept.select(out).schema
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long", "score double"]))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and digest of its pieces, digest of the decoded text."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, ids in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                back = vocabulary.value.decode(found.tolist())
                rows.append((len(found), hashlib.sha256(found.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
            parts = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, k) for p, k in zip(parts, (pa.int64(), pa.string(), pa.string(), pa.bool_())))], names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces and score of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), carry=False)
