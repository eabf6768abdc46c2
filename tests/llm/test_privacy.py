from __future__ import annotations

import hashlib
import re

import pytest

from provgraph.llm import privacy

TEXTS = [
    None, "", " ", "a@b.c", "a@b.c@d.e", "x.y%z+w@mail-1.example.com.", "@x.y a@.b a@b. a@b..c", "a@b.c_d@e.f", "aa@bb@cc.dd", "é@x.y ö.a@x.y", "1.2.3.4.5.6.7.8", "01.002.0003.255 256.1.1.1 1.1.1.256", "999.1.1.1.1",
    "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "0000000000000000 00000000000000000000", "+1 (743) 555-3824", "+1 2", "+12345678 +1234567 +", "+1" + " " * 500, "+1234567890123456",
    "+49 30 901820, +44 (0)20 7946 0958)", "a" * 5000 + "@" + "b" * 5000, "9" * 4000, "1." * 3000, "+1" + "()" * 2000 + "23456789", "a@b.c" * 50, "1.1.1.1" * 50, "+4912345678+4912345678", "😀 a@b.cd 😀 1.2.3.4", "1 " * 4000,
]


def plain(text):
    """The contract's patterns as written, failing matches dropped."""
    text = text or ""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def passes(number):
        total = 0
        for i, d in enumerate(reversed(digits(number))):
            total += d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d)
        return 16 <= len(digits(number)) <= 19 and total % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", passes),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, rule, keep in rules for m in re.finditer(rule, text) if keep(m[0])]


def test_base_spans(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS, 1)] + [(-4, TEXTS[3])], "doc_id long, text string")
    every = docs.union(hard)
    texts = {r.doc_id: r.text for r in every.collect()}
    monkeypatch.setattr(privacy, "table", lambda *_: every)
    rows = privacy.op12_pii(spark, small).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id][:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k + ":") for b in base) for k in privacy.KINDS[:4])
        spans = list(filter(None, r.spans.split(",")))
        assert [s for s in spans if s.split(":")[0] in privacy.KINDS[:4]] == base and len(r.scores.split(",")) == max(len(spans), 1)
    assert sum(bool(r.spans) for r in rows) > 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("send to my bank account DE89 3704 0044 0532 0130 00 IS MINE", "iban:24:51"),
        ("GB82WEST12345698765432", "iban:0:22"),
        ("GB82WEST12345698765431", ""),
        ("DE82WEST12345698765432", ""),
        ("batch DE89370400440532013000", ""),
        ("pay by card 3782 822463 10005 now", "short_card:12:29"),
        ("the number 3782 822463 10005 now", ""),
        ("her ssn is 078-05-1120.", "ssn:11:22"),
        ("her ssn is 666-05-1120 or 900-12-3456", ""),
        ("part 078-05-1120", ""),
        ("call (020) 7946 0958 today", "local_phone:5:20"),
        ("on 2024-03-04 they will call", ""),
        ("numbers 020 7946 0958 here", ""),
        ("tel +44 20 7946 0958", "phone:4:20"),
        ("phone of the server: 10.20.30.40", "ip:21:32"),
    ],
)
def test_other_spans(text, want):
    assert ",".join(f"{k}:{s}:{e}" for k, s, e, _ in privacy.pii_spans(text)) == want


def test_scores():
    near, far, against = (privacy.pii_spans(t)[0][3] for t in ("client address 10.1.2.3", "und 10.1.2.3 so", "version 10.1.2.3"))
    assert near > far > against
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112") and privacy.mod97("GB82WEST12345698765432")


def test_clean_texts_have_no_other_spans(spark, small):
    """In invented prose only the base kinds are found: words alone add nothing."""
    kinds = {s.kind for r in privacy.find_pii(spark.read.parquet(f"{small}/documents.parquet")).select("pii").collect() for s in r.pii}
    assert kinds and kinds <= set(privacy.KINDS[:4])


def test_long_and_many():
    text = " ".join(f"tel 020 7946 {i % 10_000:04d}, a{i}@b.cd 10.0.0.{i % 256}" for i in range(20_000))
    spans = privacy.pii_spans(text)
    assert [sum(s[0] == k for s in spans) for k in ("email", "ip", "local_phone")] == [20_000] * 3
    assert [(s[0], s[1]) for s in spans] == sorted(((s[0], s[1]) for s in spans), key=lambda x: (privacy.KINDS.index(x[0]), x[1]))


def test_masks_and_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 (743) 555-3824 😀", "x"), (2, None, None), (2, None, None), (3, "clean words", "y")], "doc_id long, text string, PII string")
    found = privacy.find_pii(df, mask=True)
    assert found.columns == ["doc_id", "text", "pii"]
    rows = sorted((tuple(r)[:2] for r in found.collect()), key=repr)
    assert rows == [(1, "mail [email] or [phone] 😀"), (2, None), (2, None), (3, "clean words")]
    assert privacy.find_pii(df.limit(0)).count() == 0
