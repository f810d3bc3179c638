import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from signalloom.llm import align, common, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=B)
TRICKY = [None, "", " ", "  ", "a", " a", "a ", "a  ", "a \n", "\n", "x \n y", "▁", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字 é\x00b", "😀 😀😀", "ﬁ ﬂ é", "it's we'll 12 345", "\x1c a \x85 b  c　 d", "tab\tx\r\n y", "x" * 3000, "ab " * 5000 + "\n" * 300]


def plain(text):
    """(A ids, B ids, groups, links) by byte sets, straight from the libraries."""
    a, b = TOKENIZER.encode(" " + (text or ""), add_special_tokens=False).ids, LIBRARY.encode(text or "")
    a_bytes = [TOKENIZER.id_to_token(k) for k in a]
    alphabet = align.byte_of()
    a_bytes = [bytes(alphabet[c] for c in t) for t in a_bytes]
    b_bytes = [bytes([int(LIBRARY.id_to_piece(k)[3:5], 16)]) if LIBRARY.is_byte(k) else LIBRARY.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], [], []
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 400 else list(__import__("itertools").accumulate(map(len, parts)))
    a_ends, b_ends = ends(a_bytes), ends(b_bytes)
    cuts = sorted(set(a_ends) & set(b_ends))
    where = lambda e: next(k for k, c in enumerate(cuts) if e <= c) if len(cuts) < 500 else __import__("bisect").bisect_left(cuts, e)
    groups = [([], []) for _ in cuts]
    for k, e in zip(a, a_ends, strict=True):
        groups[where(e)][0].append(k)
    for k, e in zip(b, b_ends, strict=True):
        groups[where(e)][1].append(k)
    holder_a = [i for i, x in enumerate(a_bytes) for _ in x]
    holder_b = [i for i, x in enumerate(b_bytes) for _ in x]
    links = [(a[i], b[j]) for i, j in sorted(set(zip(holder_a, holder_b, strict=True)))]
    return a, b, groups, links


def expected(rows):
    """The definition over all rows."""
    each = [(d, *plain(t)) for d, t in rows]
    counts = Counter(p for *_, links in each for p in set(links))
    best, best_b = defaultdict(int), defaultdict(int)
    for (a, b), n in counts.items():
        best[a], best_b[b] = max(best[a], n), max(best_b[b], n)
    out = []
    for d, a, b, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] == best_b[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_byte_alphabet():
    assert set(align.byte_of()) == set(ByteLevel.alphabet()) and sorted(align.byte_of().values()) == list(range(256))
    assert [align.byte_of()[c] for c in ByteLevel(add_prefix_space=False).pre_tokenize_str(bytes(range(33)).decode())[0][0][:9]] == list(range(9))


def same(aligner, text):
    a, b, groups, links = plain(text)
    n_a, n_b, n_groups, n_links, written, codes = aligner.align([text])[0]
    assert (n_a, n_b, n_groups, n_links) == (len(a), len(b), len(groups), len(links))
    assert written.decode() == align.written(groups) and [(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()] == links


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(text):
    same(align.Aligner.of(A, B), text)


@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n\t.é'<0x>　"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    same(align.Aligner.of(A, B), text)


def test_table_is_bounded():
    own = align.Aligner(A, B, table=200)
    for k in range(6):
        own.align([" ".join(f"w{k}{i}" for i in range(30)), "y" * 150])
        same(own, f"a w{k}1 b")
    assert own.size < 200 + 400


def test_chunks_not_spelled_alone_are_judged_as_a_whole():
    own = align.Aligner(A, B)
    own.align(["ab"])
    own.spelled[0], own.facts[0, 4] = b" ab", 1  # as if its tokens hadn't spelled it, though the document's do
    same(own, "ab cd")
    own.spelled[0] = b" a"
    assert own.align(["ab cd"])[0][:4] == (0, 0, 0, 0)


def test_links_and_counts_of_all_documents(spark, monkeypatch):
    rows = list(enumerate(TRICKY)) + [(50 + k, f"the shared words {k % 3} tokenization {'of ' * (k % 4)}") for k in range(40)] + [(None, "null id"), (7, "twice"), (7, "twice")]
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, a int, block string, n_best int")
    for size in (8 << 20, 300):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        got = align.align(frame, A, B, keep=True).collect()
        assert sorted((tuple(r)[:9] for r in got), key=str) == expected(rows)
        assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(empty, A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align.align(nothing, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_align(spark, d).collect()), key=str) == expected(rows)
