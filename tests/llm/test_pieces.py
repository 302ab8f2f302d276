"""Encoding against the model's own library, and round trips."""

import public_tokenizers as P
import pytest
import sentencepiece
from emberline.llm import pieces, stage
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = P.path("piece_bpe_32k.model")
OWN = sentencepiece.SentencePieceProcessor(model_file=PATH)
V = pieces.Vocabulary.load(PATH)
E = pieces.Encoder(V)
TABLE = pieces.byte_table(V)


def ids(texts):
    flat, off = E.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.text("ab \n\t\0<0x>er thin▁é", max_size=60)), min_size=1, max_size=5))
def test_equals_the_library(texts):
    assert ids(texts) == OWN.encode([t for t in texts])
    for t, i in zip(texts, ids(texts)):
        assert pieces.decode(i, TABLE) == t.replace("▁", " ")


@pytest.mark.parametrize("text", ["", " ", "   ", "a" * 3000, " " * 500 + "x", "漢字かな交じり文" * 40, "\U0001f600́ é", "<s></s><unk><0x0A>", "Zu übergeben: 12,5 %!"])
def test_hard_texts(text):
    assert ids([text, text]) == [OWN.encode(text)] * 2


def test_documents(spark):
    docs = stage.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in pieces.encode_column(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["token_ids"] == OWN.encode(r["text"])
    null = pieces.encode_column(spark.createDataFrame([(1, None), (2, ""), (2, "x")], "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"], r["token_ids"]) for r in null if r["token_ids"] is not None) == [(2, []), (2, OWN.encode("x"))] and any(r["token_ids"] is None for r in null)
    assert pieces.encode_column(docs.limit(0), PATH).count() == 0
