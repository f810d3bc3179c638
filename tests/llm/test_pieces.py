import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    ids = LIBRARY.encode(text)
    return pieces.Encoder.of(PATH).encode(text) == (len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))


@pytest.mark.parametrize("text", ["", " ", "  ", "▁", "▁ ▁a", "a ", "a  ", " a b  c\n d", "\n", "<s> </s> <unk> <0x41>", "漢字 é\x00b", "  lead", "tab\tx", "😀 😀😀", "ﬁ ﬂ", "a▁b", "　x  y", "x" * 300 + " y"])
def test_tricky_texts(text):
    assert same(text)


@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n.é<"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert same(text)


def test_table_is_bounded():
    own = pieces.Encoder(PATH, table=10)
    for k in range(5):
        own.encode_batch([" ".join(f"w{k}{i}" for i in range(30)), "y" * 100])
    assert len(own.ids) <= 10 + 32 and all(len(c) <= pieces.LONGEST for c in own.ids)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op9_pieces(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_edge_cases(spark):
    frame = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "c", "z"), (2, "c", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in pieces.round_trip(frame, PATH, keep=True).collect()), key=str)
    assert got == sorted([(1, 0, [], ""), (None, 2, LIBRARY.encode("a b"), "a b"), (2, 1, LIBRARY.encode("c"), "c"), (2, 1, LIBRARY.encode("c"), "c")], key=str)
    assert pieces.round_trip(frame.limit(0), PATH).collect() == []
