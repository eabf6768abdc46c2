from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from provgraph.llm import chat

ROWS = [(1, 0, "user", "<|a"), (1, 1, "assistant", "<\\|x <\\\\| ünï<|im_end|>"), (1, 1, "assistant", "b"), (None, None, None, None), (None, 2, "assistant", ""), (2, 0, "a\nb\\n<|", "c\n"), (3, 0, "assistant", "日本"), (1, None, "assistant", "first"), (3, 0, "assistant", "日本")]


def test_against_sql(spark, small, against_sql):
    against_sql(chat.op9_chat(spark, small), chat.OP9_SQL, small)


def test_hard_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = {r.conv_id: r for r in chat.format_chats(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {k: chat.parse(r.formatted) for k, r in found.items()} == {
        None: [("", ""), ("assistant", "")],
        1: [("assistant", "first"), ("user", "<|a"), ("assistant", "<\\|x <\\\\| ünï<|im_end|>"), ("assistant", "b")],
        2: [("a\nb\\n<|", "c\n")],
        3: [("assistant", "日本"), ("assistant", "日本")],
    }
    loss = {k: [chat.unescape(r.formatted[s:e]) for s, e in zip(r.loss_starts, r.loss_ends)] for k, r in found.items()}
    assert loss == {None: [""], 1: ["first", "<\\|x <\\\\| ünï<|im_end|>", "b"], 2: [], 3: ["日本", "日本"]}
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\a\nim_end>start", max_size=30))
def test_escape_is_reversible(text):
    import re

    escaped = re.sub(chat.ESCAPE[0], chat.ESCAPE[1], text)
    assert chat.unescape(escaped) == text
    assert "<|" not in escaped
