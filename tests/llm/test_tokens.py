import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm import queries, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", "a" * 500, " " * 300, "<|endoftext|> a b<|endoftext|>c " * 30, "  x   y\n\n z'r" * 40, "it's we're " * 50, "é ü 漢字 😀 " * 60, "x" * 30 + " " * 40 + "y" * 50, "a b\x1c c  d\x85 e\xa0f" * 40]


def whole(texts):
    return [len(e.ids) for e in tokencount.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(10, 2), (64, 8), (1000, 50)])
def test_tricky_texts(chunk, overlap):
    assert tokencount.counter(PATH, chunk, overlap)(TRICKY) == whole(TRICKY)


@given(st.text(alphabet="ab'rs \n1é<|endoftext|>", max_size=200), st.integers(2, 40), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_any_chunking(text, chunk, overlap):
    assert tokencount.counter(PATH, chunk, overlap)([text]) == whole([text])


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op4_tokens(spark, d).collect()}
    counts = whole([r.text for r in docs])
    assert len(got) == len(docs)
    for r, n in zip(docs, counts):
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 1024)


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "c", 5), (3, "c", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokencount.count_tokens(frame, PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 1, 1, False), (3, 1, 1, False)], key=str)
    assert tokencount.count_tokens(frame.limit(0), PATH).collect() == []


def test_sentencepiece_models_too():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello  world ", "", "漢字 ▁ x"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokencount.counter(path)(texts) == [len(library.encode(t)) for t in texts]
