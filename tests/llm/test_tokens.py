from __future__ import annotations

import random

import numpy as np
import pytest

from provgraph.llm import tokens

TEXTS = ["", "a", " ", " a  b", "a\n\nb \n c", "日本語😀x\t\n\n é", "\n", "a" * 37, "thé 😀" * 60, "ab" * 90, "   \n   x"]


@pytest.fixture(scope="module")
def library():
    """The installed library on the same pieces and scores, as a unigram model."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(tokens.default_model(), "rb").read())
    plain = [p for p in model.pieces if p.type == 1]
    for piece, score in zip(plain, tokens.zipf_scores([p.score for p in plain])):
        piece.score = score
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    return TEXTS + ["".join(random.choice("abcdeth \n日😀  ing") for _ in range(random.randint(1, 200))) for _ in range(60)]


def test_as_the_library(library, texts):
    vocabulary = tokens.Vocabulary.load(tokens.default_model())
    for text, ids in zip(texts, vocabulary.encode_many([tokens.normal(t) for t in texts])):
        assert ids.tolist() == library.encode(text)
        assert vocabulary.count(tokens.normal(text))[0] == len(ids)
        assert vocabulary.decode(ids.tolist()) == text


@pytest.mark.parametrize("chunk", [7, 16, 50, 10_000])
def test_chunks_give_the_same(spark, library, texts, chunk):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(-1, None, 1, "x"), (0, "", 1, "x")], "doc_id long, text string, row int, ids string")
    found = tokens.encode(df, chunk=chunk)
    assert found.columns == ["doc_id", "text", "row", "ids"]
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    assert all(r.ids is None if r.text is None else r.ids == library.encode(r.text) for r in rows)
    back = tokens.decode(found).collect()
    assert all(r.decoded == r.text for r in back)


def test_scan_is_a_prefix_product():
    rng = np.random.default_rng(5)
    m = rng.integers(-9, 0, (9, 4, 4)).astype(np.int64)
    m[rng.random(m.shape) < 0.3] = tokens.NONE
    want = m[0]
    for i, got in enumerate(tokens.scan(m)):
        if i:
            want = tokens.combine(want[None], m[i][None])[0]
        assert (got == want).all()


def test_counts(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.op7_token_counts(spark, small).collect()} == sizes
    pieces = tokens.op5_pieces(spark, small).collect()
    assert {r.doc_id: r.n_pieces for r in pieces} == sizes and all(r.round_trip for r in pieces)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(none).count() == 0 and tokens.count_tokens(none).count() == 0 and tokens.decode(tokens.encode(none)).count() == 0
    null = spark.createDataFrame([(1, None, 5)], "doc_id long, text string, score int")
    assert tuple(tokens.count_tokens(null).first()) == (1, None, 0, 0.0)
