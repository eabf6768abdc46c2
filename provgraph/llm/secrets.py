"""Secrets in texts: fixed patterns, and a small character convolutional network over every candidate in its context."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import beside, ship_package, slices, table

#: Fixed patterns of the base findings, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
#: What else is a candidate: a run of these characters with a digit and a letter, and a shorter or plainer one behind a name
#: that credentials go by.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
NAMED = re.compile(r"""(?ai:passphrase|credentials?|pwd|auth|bearer|private|access|client|key|pin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
#: Runs that are plainly something else, the only ones of a corpus that training takes as no secrets: addresses of mail and
#: sites, paths, dates, versions, and words.
PLAIN = re.compile(r"(?a:(?:[a-z0-9]+[.-])+(?:com|org|net|html?|txt|md|py|json)(?:/[a-z0-9._-]*)*|/?(?:[a-z]{2,12}/)+[a-z0-9._-]*|[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9TZ:.-]*|v?[0-9]+(?:\.[0-9]+)+|[A-Za-z]{2,14}(?:[-_][A-Za-z]{2,14})*[0-9]{0,3})")

#: Characters before, inside and after a candidate that the network sees.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
CLASSES = 100
EMBED, FILTERS, SPAN = 8, 24, 5
#: Bounds of the labelled sample, and the recall that the threshold must reach on held-out findings.
TRAIN_DOCS, TRAIN_FINDINGS, RECALL = 4_000, 3_000, 0.98
#: Findings made by rule that every network is trained on, whatever the corpus has.
MADE_FINDINGS = 3_000


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], f[2]))


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that no base finding overlaps, in order and each once."""
    by_end = sorted(base, key=lambda f: f[1])
    ends = [f[1] for f in by_end]
    least = [f[0] for f in by_end] + [len(text) + 1]
    for i in range(len(by_end) - 1, -1, -1):
        least[i] = min(least[i], least[i + 1])
    spans = {m.span() for m in TOKEN.finditer(text) if MIXED.match(m[0])}
    if ":" in text or "=" in text:
        spans |= {m.span(1) for m in NAMED.finditer(text)}
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if least[bisect.bisect_right(ends, start)] >= end and (not out or start >= out[-1][1]):
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> str:
    """A candidate in its context, each part filled to its length."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + INSIDE)].ljust(INSIDE, "\1") + text[end : end + AFTER].ljust(AFTER, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """A candidate's window, and for one longer than ``INSIDE`` those of overlapping parts up to its end."""
    later = [*range(start + INSIDE // 2, end - INSIDE, INSIDE // 2), end - INSIDE] if end - start > INSIDE else []
    return [window(text, start, end), *(window(text, at, at + INSIDE) for at in later)]


def encode(windows: list[str]) -> np.ndarray:
    """Character numbers: printable ASCII each its own, the fillers and all others one each."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)
    return np.where(codes < 2, codes, np.where((codes >= 32) & (codes < 127), codes - 29, 2)).astype(np.int64)


class Network:
    """Embedding, one convolution, max and mean over positions inside and outside the candidate, logistic output."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.w = {"e": r.normal(0, 0.5, (CLASSES, EMBED)), "c": r.normal(0, 0.3, (SPAN * EMBED, FILTERS)), "b": np.zeros(FILTERS), "o": r.normal(0, 0.3, 3 * FILTERS), "k": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        e = self.w["e"][x]
        n = WIDTH - SPAN + 1
        patches = np.stack([e[:, i : i + n] for i in range(SPAN)], axis=2).reshape(len(x), n, -1)
        h = np.maximum(patches @ self.w["c"] + self.w["b"], 0)
        inner = slice(BEFORE - 2, BEFORE + INSIDE - 2)
        top, mean, near = h[:, inner].argmax(axis=1), h[:, inner].mean(axis=1), h[:, : BEFORE - 2].argmax(axis=1)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        pooled = np.concatenate([h[rows, top + BEFORE - 2, cols], mean, h[rows, near, cols]], axis=1)
        return patches, h, top, near, pooled, pooled @ self.w["o"] + self.w["k"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)] or [np.zeros(0)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches, h, top, near, pooled, z = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        dp = d[:, None] * self.w["o"]
        dh = np.zeros_like(h)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        dh[rows, top + BEFORE - 2, cols] += dp[:, :FILTERS]
        dh[:, BEFORE - 2 : BEFORE + INSIDE - 2] += dp[:, None, FILTERS : 2 * FILTERS] / INSIDE
        dh[rows, near, cols] += dp[:, 2 * FILTERS :]
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        de = (dh @ self.w["c"].T).reshape(len(x), dh.shape[1], SPAN, EMBED)
        ge = np.zeros_like(self.w["e"])
        for i in range(SPAN):
            np.add.at(ge, x[:, i : i + dh.shape[1]], de[:, :, i])
        return {"e": ge, "c": patches.reshape(-1, SPAN * EMBED).T @ flat, "b": flat.sum(axis=0), "o": pooled.T @ d, "k": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 5e-3, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Scale the logits to probabilities on held-out findings, then take the highest threshold with the recall asked for."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * (((p - y) * z).mean() + 1e-3 * a), b - 0.05 * (p - y).mean()
        self.scale, self.shift = max(float(a), 1e-3), float(b)
        positive = np.sort(self.probability(x)[y == 1])
        self.threshold = float(positive[int((1 - recall) * len(positive) + 1e-9)]) if len(positive) else 0.5


LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Shapes that training never sees; only calibration and the tests do.
UNSEEN = ("dashed", "signed", "slug", "stamp")


def shapes(r: np.random.Generator) -> tuple[dict, dict]:
    """Makers of values by the name of their shape: secrets, and what is none."""
    pick = lambda s, low, high: "".join(s[i] for i in r.integers(0, len(s), int(r.integers(low, high + 1))))
    word = lambda low=2, high=9: pick("aeiou", 1, 1) + "".join(pick("bcdfglmnprst", 1, 1) + pick("aeiou", 1, 1) for _ in range(int(r.integers(low, high)) // 2 + 1))
    some = lambda n: [word() for _ in range(n)]
    secret = {
        "mixed": lambda: pick(LOW + UP + DIGITS, 16, 48),
        "hex": lambda: pick("0123456789abcdef", 20, 64),
        "base64": lambda: pick(LOW + UP + DIGITS + "+/", 22, 60) + "=" * int(r.integers(0, 3)),
        "prefixed": lambda: word()[:4] + "_" + pick(LOW + UP + DIGITS, 20, 40),
        "capitals": lambda: pick(UP + DIGITS, 16, 40),
        "password": lambda: word().capitalize() + pick(DIGITS + "=+-_.", 3, 6) + pick(UP + DIGITS, 3, 5),
        "grouped": lambda: "-".join(pick(UP + DIGITS, 4, 6) for _ in range(int(r.integers(3, 6)))),
        "uuid": lambda: "-".join(pick("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
        "underlined": lambda: "_".join(pick(LOW + DIGITS, 6, 10) for _ in range(3)),
        "dashed": lambda: "-".join(pick(LOW + DIGITS, 5, 9) for _ in range(4)),
        "signed": lambda: ".".join(pick(LOW + UP + DIGITS + "_-", 12, 30) for _ in range(3)),
    }
    other = {
        "site": lambda: ".".join([*some(2), "com"]) + "/" + word() + pick(DIGITS, 1, 2),
        "path": lambda: "/".join(some(4)) + pick(DIGITS, 1, 1),
        "compound": lambda: "".join(w.capitalize() for w in some(3)) + pick(DIGITS, 1, 2),
        "date": lambda: f"20{pick(DIGITS, 2, 2)}-{pick(DIGITS, 2, 2)}-{pick(DIGITS, 2, 2)}T{pick(DIGITS, 6, 6)}Z",
        "version": lambda: f"v{pick(DIGITS, 1, 2)}.{pick(DIGITS, 1, 2)}.{pick(DIGITS, 1, 3)}-{word()}-{word()}",
        "words": lambda: "_".join(some(3)),
        "word": lambda: word(8, 14),
        "mail": lambda: f"{word()}.{pick(DIGITS, 2, 2)}.{word()}{pick(DIGITS, 1, 1)}.example.com",
        "numbered": lambda: word() + "_" + pick(DIGITS, 4, 8) + "." + word()[:3],
        "stamped": lambda: word() + ".20" + pick(DIGITS, 6, 6) + "." + word(),
        "span": lambda: f"20{pick(DIGITS, 6, 6)}-{pick(DIGITS, 4, 8)}" + "-" + word(),
        "slug": lambda: "-".join(some(4)) + "-" + pick(DIGITS, 1, 3),
        "stamp": lambda: word() + "-20" + pick(DIGITS, 6, 6) + "-" + pick(DIGITS, 4, 4) + ".log",
    }
    return secret, other


def made_findings(count: int, seed: int = 3, unseen: bool | None = None) -> list[tuple[str, int]]:
    """Findings labelled by how they were made, whatever the fixed patterns say of them: random keys in many shapes against names,
    numbers, dates, paths and addresses. Half of either kind stand behind a credential's name, so the context alone tells nothing.
    ``unseen`` picks the shapes that training lacks, or only the others."""
    r = np.random.default_rng(seed)
    makers = [[make for name, make in kind.items() if unseen is None or (name in UNSEEN) == unseen] for kind in shapes(r)]
    word = lambda: "".join(LOW[i] for i in r.integers(0, 26, int(r.integers(2, 9))))
    out = []
    for i in range(count):
        kind = makers[i % 2]
        value = kind[int(r.integers(len(kind)))]()
        left = " ".join(word() for _ in range(4)) + " "
        if r.random() < 0.5:
            left += str(r.choice(["token", "secret", "key", "password", "auth", "file", "name", "id"])) + str(r.choice([" = ", ": ", "="]))
        text = left + value + " " + word()
        out.append((window(text, len(left), len(left) + len(value)), 1 - i % 2))
    return out


def value_start(text: str, start: int, kind: int) -> int:
    """Where the value of a base finding begins."""
    return ASSIGN.match(text, start).start(2) if kind == 0 else start


def labelled(text: str) -> list[tuple[str, int]]:
    """Findings of one text: values that the fixed patterns find are secrets, and what is plainly something else is none.
    Other candidates have no label, and training leaves them out."""
    base = base_findings(text)
    found = [(window(text, value_start(text, s, kind), e), 1) for s, e, kind in base]
    return found + [(window(text, s, e), 0) for s, e in other_candidates(text, base) if PLAIN.fullmatch(text[s:e])]


def train(findings: list[tuple[str, int]], recall: float = RECALL) -> Network:
    """Fit on four fifths of the findings and of those made by rule; calibrate on the rest and on shapes that training lacks."""
    findings = findings + made_findings(MADE_FINDINGS, unseen=False)
    held = np.array([int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 5 == 0 for w, _ in findings])
    x, y = encode([w for w, _ in findings]), np.array([v for _, v in findings], float)
    network = Network()
    network.fit(x[~held], y[~held])
    unseen = made_findings(MADE_FINDINGS // 5, seed=4, unseen=True)
    network.calibrate(np.concatenate([x[held], encode([w for w, _ in unseen])]), np.r_[y[held], [v for _, v in unseen]], recall)
    return network


def training_findings(docs: DataFrame, max_docs: int, max_findings: int, seed: str) -> list[tuple[str, int]]:
    """Labelled findings of at most ``max_docs`` documents, at most ``max_findings``, both in an order drawn from the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [f for t in batch.column(0).to_pylist() for f in labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["shown", "secret"])

    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_docs)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")
    found = texts.mapInArrow(run, "shown string, secret long").distinct()
    half = [found.where(F.col("secret") == v).orderBy(F.xxhash64(F.lit(seed), "shown"), "shown").limit(max_findings // 2).collect() for v in (1, 0)]
    return sorted((r.shown, r.secret) for rows in half for r in rows)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda f: (f[0], f[2])))


def find_secrets(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_findings: int = TRAIN_FINDINGS, recall: float = RECALL, seed: str = "findings", carry: bool = True, mark: str | None = None) -> DataFrame:
    """Secrets of every text in whole: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_doubted``.

    The network is fitted on a bounded labelled sample drawn from ``docs`` and on findings made by rule; its threshold is
    the highest that keeps ``recall`` of the held-out secrets, among them shapes that training lacks. It judges every
    candidate of every text, long ones in overlapping windows of which the highest counts; those at or above the threshold
    join the base findings as kind ``model``. Base findings are judged too, and always stay: ``n_doubted`` is the number of
    those below the threshold. ``spans`` lists
    kind:start:end in code points, end exclusive, by start and then kind. Returns the columns of ``docs`` (with
    ``carry=False`` only ``doc_id``) and the six; columns of those names in ``docs`` give way. Null text counts as empty and
    stays null; with ``mark`` each finding in ``text`` is replaced by it (overlapping ones by one); texts without findings have zero counts, the digest of the empty string and empty spans. Repeated rows
    are scanned each; empty input gives no rows.
    """
    ship_package(docs.sparkSession)
    made = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_doubted"]
    kept = docs.select(beside(docs, made) if carry else ["doc_id", "text"])
    columns = kept.columns
    at = columns.index("text")
    out_columns = columns if carry else ["doc_id"]
    network = docs.sparkSession.sparkContext.broadcast(train(training_findings(docs, max_docs, max_findings, seed), recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            net, bases, owners, shown, places = network.value, [], [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                base = base_findings(text) if text else []
                bases.append(base)
                if text:
                    judged = [(s, e, 3) for s, e in other_candidates(text, base)] + base
                    for s, e, kind in judged:
                        parts = windows(text, value_start(text, s, kind), e)
                        owners += [i] * len(parts)
                        places += [(s, e, kind)] * len(parts)
                        shown += parts
            spans = [list(b) for b in bases]
            doubted = [len(b) for b in bases]
            if shown:
                reached = np.flatnonzero(np.concatenate([net.probability(encode(shown[k : k + 4096])) for k in range(0, len(shown), 4096)]) >= net.threshold).tolist()
                for owner, place in dict.fromkeys((owners[k], places[k]) for k in reached):
                    if place[2] == 3:
                        spans[owner].append(place)
                    else:
                        doubted[owner] -= 1
            counts = [pa.array([sum(f[2] == k for f in b) for b in bases], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], pa.string())
            mine = [batch.column(columns.index(c)) for c in out_columns]
            if mark is not None:
                clean = [t if not x else replaced(t, x, mark) for t, x in zip(batch.column(at).to_pylist(), spans)]
                mine[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*mine, *counts, digest, pa.array([joined(s) for s in spans], pa.string()), pa.array(doubted, pa.int64())], names=[*out_columns, *made])

    fields = [*kept.select(out_columns).schema.fields, *(StructField(c, LongType()) for c in made[:3]), *(StructField(c, StringType()) for c in made[3:5]), StructField(made[5], LongType())]
    return kept.mapInArrow(run, StructType(fields))


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for start, end, _ in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, mark: str = "[secret]", **settings) -> DataFrame:
    """The rows of ``docs`` with every finding replaced by ``mark``."""
    return find_secrets(docs, mark=mark, **settings).select(docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"), carry=False)
