"""Personal data in texts: patterns propose spans, checksums and other validators confirm them, nearby words adjust the score."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import beside, ship_package, slices, table

#: Kinds in the order in which they are listed. The first four are found by fixed rules and always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "ssn", "local_phone")
BASE = 4

#: Fixed patterns of the base kinds. The parts that follow one another share no characters, so possessive forms match the same.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Length of an account number (IBAN) by country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22
GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27
MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
"""
IBAN_LENGTH = {entry[:2]: int(entry[2:]) for entry in IBAN_LENGTHS.split()}
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_BODY = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTH.values())}
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z/-])")
DATE = re.compile(r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-])?(?:19|20)[0-9]{2}(?:[./-][0-9]{1,2}[./-][0-9]{1,2})?")

#: Score of a validated span without any context, what words near it add or take, and the least score of an added span.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.4, "ssn": 0.4, "local_phone": 0.3}
NEAR, AGAINST, LEAST = 0.3, 0.3, 0.6
#: Code points before and after a span that are looked at.
BEFORE, AFTER = 40, 20
#: Words that make a kind likelier, and words that speak against all but mail addresses.
CONTEXT = {
    "email": "e-?mail|mail|contact|write to|correo|courriel|kontakt",
    "ip": "ip|host|server|address|client|login|adresse",
    "card": "card|credit|debit|visa|mastercard|amex|payment|tarjeta|carte|karte|kreditkarte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|móvil|handy",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta|bic|swift",
    "ssn": "ssn|social security|social|taxpayer|tax id",
}
CONTEXT |= {"short_card": CONTEXT["card"], "local_phone": CONTEXT["phone"]}
OTHERWISE = "order|invoice|isbn|version|build|serial|batch|ticket|sku|tracking|commit|part no"
WORDS_FOR = {kind: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.IGNORECASE) for kind, words in CONTEXT.items()}
WORDS_AGAINST = re.compile(rf"(?<!\w)(?:{OTHERWISE})(?!\w)", re.IGNORECASE)

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
Span = tuple[int, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the sum of digits, every second one from the right doubled, is a multiple of ten."""
    twice = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses: what stands left of each @ is walked back from it, so a long run without one costs nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield start, last
        at = text.find("@", last)


def small_parts(address: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in address.split("."))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base kinds, by kind and then start."""
    found = [(0, s, e) for s, e in emails(text)]
    found += [(1, *m.span()) for m in ADDRESS.finditer(text) if small_parts(m[0])]
    found += [(2, *m.span()) for m in NUMBER.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def other_spans(text: str) -> Iterator[Span]:
    """Validated proposals of the other kinds."""
    for m in IBAN_HEAD.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        body = IBAN_BODY[length].match(text, m.end()) if length else None
        if body and mod97((m[0] + body[0]).replace(" ", "")):
            yield 4, m.start(), body.end()
    for m in NUMBER.finditer(text):
        if 14 <= m.end() - m.start() <= 29 and re.fullmatch(r"3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}", d := digits_of(m[0])) and luhn(d):
            yield 5, *m.span()
    if "-" in text:
        for m in SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield 6, *m.span()
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(digits_of(m[0])) <= 12 and not DATE.fullmatch(m[0]):
            yield 7, *m.span()


def score(text: str, span: Span) -> float:
    """The kind's score, raised by a word for it and lowered by one against it among the code points around the span."""
    kind, start, end = span
    name = KINDS[kind]
    around = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    value = SCORES[name] + NEAR * bool(WORDS_FOR[name].search(around)) - AGAINST * bool(kind and WORDS_AGAINST.search(around))
    return round(min(max(value, 0.0), 1.0), 2)


def pii_spans(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind and then start: base ones, and others that reach ``least`` and overlap none before them."""
    base = base_spans(text)
    found = [(k, s, e, score(text, (k, s, e))) for k, s, e in base]
    by_start = sorted((s, e) for _, s, e in base)
    reach = [0, *accumulate((e for _, e in by_start), max)]
    added: list[tuple[int, int]] = []
    for k, s, e in other_spans(text):
        at = bisect.bisect_left(added, (e, 0))
        if reach[bisect.bisect_left(by_start, (e, 0))] > s or (at and added[at - 1][1] > s):
            continue
        rated = score(text, (k, s, e))
        if rated >= least:
            found.append((k, s, e, rated))
            added.insert(at, (s, e))
    return [(KINDS[k], s, e, r) for k, s, e, r in sorted(found)]


def masked(text: str, spans: list[tuple[str, int, int, float]], mark: Callable[[str], str]) -> str:
    """The text with each span replaced; spans that overlap have one mark, that of the first."""
    out, last = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= last:
            out += [text[last:start], mark(kind)]
        last = max(last, end)
    return "".join(out) + text[last:]


def find_pii(docs: DataFrame, least: float = LEAST, mask: bool = False) -> DataFrame:
    """The columns of ``docs`` and ``pii``: an array of ``kind``, ``start``, ``end`` (code points, end exclusive), ``score``.

    Patterns propose spans and validators confirm them: value ranges for addresses, Luhn for cards, mod 97 and the country's
    length for accounts, ranges of groups for social security numbers. Words within ``BEFORE`` and ``AFTER`` code points raise or lower
    a span's score. Mail addresses, IPv4 addresses, cards and international phone numbers always stay; a span of
    another kind is added if it scores ``least`` or more and overlaps none of them. Spans are in order of kind, then start.
    ``mask`` replaces each span in ``text`` by its kind in brackets.

    Every text is read in whole, in time that grows with its length. A null text counts as empty and stays null; without
    findings the array is empty. Repeated rows are read each. A column of ``docs`` named ``pii`` in any case
    gives way. Empty input gives no rows.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(beside(docs, ["pii"]))
    names = kept.columns
    at = [name.lower() for name in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            spans = [pii_spans(t, least) if t else [] for t in texts]
            columns = list(batch.columns)
            if mask:
                clean = [masked(t, x, "[{}]".format) if x else t for t, x in zip(texts, spans)]
                columns[at] = pa.array(clean, columns[at].type)
            listed = [[{"kind": k, "start": s, "end": e, "score": r} for k, s, e, r in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, _ARROW_SPANS)], names=[*names, "pii"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("pii", SPANS)]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest, spans and scores of the personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*KINDS[:BASE]))
    return found.select(
        "doc_id",
        *(of(kind) for kind in KINDS[:BASE]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
