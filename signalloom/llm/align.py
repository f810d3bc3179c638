"""Alignment of two tokenizers over the same texts: groups, links and how often each pair of tokens is linked.

A is a byte-level tokenizer of the tokenizers library and reads a space and the text; B is a sentencepiece model and reads
the text, to which it adds the space. Inside ``mapInPandas`` a two-pointer merge of the cumulative byte ends of both
emits the groups (cut where both have a token end) and the links (tokens whose bytes overlap). Spark then counts by
``groupBy`` in how many documents each pair is linked and joins counts and the maxima of either side back.

Merge per distinct chunk. Both tokenizers have a boundary wherever a space follows a character that isn't white space: A's
pre-tokens don't span it and no piece of B goes from another character to a marker (checked when the model is loaded). The
stretches between such places are tokenized and merged once, when a worker first sees them, and joined back by position. Many
new ones are merged together, which takes numpy's sorted union and intersection of the ends in place of two pointers.
The worker's table is emptied at ``TABLE`` characters. A document in which some chunk's tokens don't spell the chunk is
judged, and if need be merged, as a whole.

Counts by blocks. A task closes a block every ``BLOCK_BYTES`` of text and emits a row per document, in which its distinct
pairs are places in the block's sorted list of pairs, and a row (block, a, b, documents) per distinct pair of the block. So
counts are combined before they are shuffled, a pair has at most one row a block however hot it is, and what a document
holds moves in a byte or two a pair. Rows are written once before they are counted, so a block's rows agree even if tasks are run
again, and no text is encoded twice. Pairs per block are bounded by its size; one A id has as many partners as B has ids at most.

Edge cases: a text that is null, empty, or not spelled by both tokenizers (one with literal markers, say) has no tokens:
zeros and an empty string for the groups; repeated rows are documents of their own; a null id stays null; ties for a
maximum are all best; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import from_planes, planes, stored

#: Characters of distinct chunks in a worker's table, and documents handled at a time.
TABLE, SLICE = 3_000_000, 64
#: Characters of new chunks that are tokenized at once.
JOINED = 8_000
MARK = "▁"
#: From a space to the next one that follows a character that isn't white space.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in
    order from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def merge(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """(groups of A ids and B ids, links) of two tokenizations of the same bytes, by the ends of their tokens."""
    groups, links, i, j, from_a, from_b = [], [], 0, 0, 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        end, other = a_ends[i], b_ends[j]
        i += end <= other
        j += other <= end
        if end == other:
            groups.append((a[from_a:i], b[from_b:j]))
            from_a, from_b = i, j
    return groups, links


def written(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


class _Numbers(dict):
    """Chunk to number, in order of first sight; new: those not learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Aligner:
    """Both tokenizers of a worker and its table of distinct chunks."""

    _made: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def __init__(self, a_path: str, b_path: str, table: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if crossing := [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        letters = byte_of()
        names = {k: t for t, k in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = {k: bytes(letters[c] for c in t) for k, t in names.items() if all(c in letters for c in t)}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_parts = [self.a_bytes.get(k, b"") for k in range(self.a.get_vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)]) for x in (self.a_parts, self.b_bytes))
        self.decimal = [*map(str, range(max(len(self.a_parts), len(self.b_bytes))))]
        self.marker, self.table = self.b.piece_to_id(MARK), table
        self._empty()

    def _empty(self) -> None:
        self.known = _Numbers()
        self.groups: list[bytes] = []
        self.spelled: dict[int, bytes] = {}  # of chunks whose tokens don't spell them: B's bytes
        self.size, self.facts, self.starts, self.codes = 0, np.zeros((0, 5), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of texts that begin with a space, and B's ids of what follows it."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [[self.marker] if t == " " else ids for t, ids in zip(texts, b, strict=True)]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[list, list, bytes] | None:
        """(groups, links, B's bytes); groups and links are None where the tokens don't spell the text."""
        a_parts, b_parts = [self.a_bytes.get(k, b"") for k in a], [self.b_bytes[k] for k in b]
        spelled, whole = b"".join(b_parts), text.encode()
        if spelled != whole or b"".join(a_parts) != whole:
            return None, None, spelled
        return *merge(a, np.cumsum([*map(len, a_parts)]).tolist(), b, np.cumsum([*map(len, b_parts)]).tolist()), spelled

    def _learn(self) -> None:
        """Tokenizes and merges the chunks that were met for the first time: joined to texts of some thousand characters, as no
        token spans the place between two of them. Those that end in white space are taken one by one."""
        new, self.known.new = self.known.new, []
        self.added, at = [], 0
        while at < len(new):
            end, most = at, 0
            while end < len(new) and most < JOINED and not new[end][-1].isspace():
                most += len(new[end])
                end += 1
            if end == at or not self._learn_joined(new[at:end]):
                end = max(end, at + 1)
                for chunk in new[at:end]:
                    self._learn_alone(chunk)
            at = end
        if new:
            facts, codes = (np.concatenate(x) for x in zip(*self.added, strict=True))
            self.facts, self.codes = np.concatenate((self.facts, facts)), np.concatenate((self.codes, codes))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(facts[:, 3])))

    def _add(self, facts, groups: list[bytes], codes) -> None:
        self.groups += groups
        self.added.append((np.asarray(facts, np.int64).reshape(-1, 5), np.asarray(codes, np.int64)))

    def _learn_alone(self, chunk: str) -> None:
        (a,), (b,) = self.tokens([chunk])
        groups, links, spelled = self.aligned(chunk, a, b)
        bad = groups is None
        if bad:
            self.spelled[len(self.groups)] = spelled
            groups, links = [], []
        self._add([(len(a), len(b), len(groups), len(links), bad)], [written(groups).encode()], [x << 32 | y for x, y in links])
        self.size += len(chunk)

    def _learn_joined(self, chunks: list[str]) -> bool:
        """Merges the token ends of all chunks at once; False, and nothing done, if tokens don't spell them."""
        text = "".join(chunks)
        whole, ends = text.encode(), np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.a_parts.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return False
        a_ids, b_ids = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        either, both = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
        if len(np.intersect1d(both, ends)) < len(chunks):
            return False
        links = a_ids[np.searchsorted(a_ends, either)] << 32 | b_ids[np.searchsorted(b_ends, either)]
        to_a, to_b = (np.searchsorted(e, both) + 1 for e in (a_ends, b_ends))
        a_text, b_text = list(map(self.decimal.__getitem__, a)), list(map(self.decimal.__getitem__, b))
        groups = [f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *to_a[:-1].tolist()], to_a.tolist(), [0, *to_b[:-1].tolist()], to_b.tolist(), strict=True)]
        counts = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_ends, b_ends, both, either)]
        bounds = np.cumsum(counts[2]).tolist()
        self._add(np.column_stack([*counts, np.zeros(len(chunks), np.int64)]), [";".join(groups[s:e]).encode() for s, e in zip([0, *bounds[:-1]], bounds, strict=True)], links)
        self.size += len(text)
        return True

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, bytes, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups written out, code a << 32 | b of each link) of each text."""
        dealt = [CHUNK.findall(" " + t) if t and MARK not in t else [] for t in texts]
        if self.size > self.table:
            self._empty()
        numbered = [list(map(self.known.__getitem__, chunks)) for chunks in dealt]
        self._learn()
        none, out = (0, 0, 0, 0, b"", np.zeros(0, np.int64)), []
        for text, chunks, numbers in zip(texts, dealt, numbered, strict=True):
            if not numbers:
                out.append(none)
                continue
            at = np.array(numbers)
            n_a, n_b, n_groups, n_links, bad = self.facts[at].sum(0).tolist()
            if bad:
                out.append(self._whole(text, chunks, numbers) or none)
                continue
            sizes = self.facts[at, 3]
            own = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(n_links)
            out.append((n_a, n_b, n_groups, n_links, b";".join(map(self.groups.__getitem__, numbers)), self.codes[own]))
        return out

    def _whole(self, text: str, chunks: list[str], numbers: list[int]):
        """A document some chunk of which isn't spelled by its own tokens, judged as one."""
        if b"".join(self.spelled.get(k, c.encode()) for c, k in zip(chunks, numbers, strict=True)) != (" " + text).encode():
            return None
        (a,), (b,) = self.tokens([" " + text])
        groups, links, _ = self.aligned(" " + text, a, b)
        if groups is None:
            return None
        return len(a), len(b), len(groups), len(links), written(groups).encode(), np.array([x << 32 | y for x, y in links], np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
DOCUMENT = ", ".join(["doc_id string", *[f"{c} long" for c in COUNTS], "groups_sha256 string", "block long"])
ROWS = f"{DOCUMENT}, groups string, held binary, times binary, a int, b int, documents long, kind string"


class _Block:
    """Documents until the block is closed."""

    def __init__(self):
        self.rows, self.codes, self.bytes = [], [], 0

    def closed(self, number: int):
        """The rows of the block: those of its documents, and those of its distinct pairs."""
        place, met = pd.factorize(np.concatenate(self.codes))
        order = np.argsort(met)
        every, place = met[order], np.argsort(order)[place]
        document = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])
        once, times = np.unique(document * max(1, len(every)) + place, return_counts=True)
        owner, pair = np.divmod(once, max(1, len(every)))
        edges = np.searchsorted(owner, np.arange(1, len(self.codes)))
        frame = pd.DataFrame(self.rows, columns=["doc_id", *COUNTS, "groups_sha256", "groups"])
        frame["held"] = [planes(np.diff(p, prepend=0).astype(np.uint32)) for p in np.split(pair, edges)]
        frame["times"] = [planes(t.astype(np.uint32)) for t in np.split(times, edges)]
        yield frame.assign(block=number, a=None, b=None, documents=None, kind="document")
        if len(every):
            pairs = pd.DataFrame({"a": every >> 32, "b": every & 0xFFFFFFFF, "documents": np.bincount(pair, minlength=len(every))})
            yield pairs.assign(block=number, kind="pair", **dict.fromkeys(["doc_id", *COUNTS, "groups_sha256", "groups", "held", "times"]))


def link(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with what they hold, pairs of each block), both of one table written to the shared folder."""
    size = common.BLOCK_BYTES
    order = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        aligner, block, number = Aligner.of(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                ids, texts = batch["doc_id"].tolist()[k : k + SLICE], batch["text"].tolist()[k : k + SLICE]
                for name, text, (*counts, groups, codes) in zip(ids, texts, aligner.align(texts), strict=True):
                    block.rows.append((name, *counts, hashlib.sha256(groups).hexdigest() if groups else "", groups.decode() if keep else None))
                    block.codes.append(codes)
                    block.bytes += len(text or "")
                    if block.bytes >= size:
                        yield from (f[order] for f in block.closed(number))
                        block, number = _Block(), number + 1
        if block.rows:
            yield from (f[order] for f in block.closed(number))

    slim = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(slim.mapInPandas(run, ROWS), "kind")
    return rows.where("kind = 'document'").drop("a", "b", "documents", "kind"), rows.where("kind = 'pair'").select("block", "a", "b", "documents")


def counted(pairs: DataFrame) -> DataFrame:
    """(a, b, documents, best_a, best_b): in how many documents each pair is linked, and whether that is the most of its A id
    and of its B id."""
    total = pairs.groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    most = lambda side: total.groupBy(side).agg(F.max("documents").alias(f"most_{side}"))
    return total.join(most("a"), "a").join(most("b"), "b").select("a", "b", "documents", (F.col("documents") == F.col("most_a")).alias("best_a"), (F.col("documents") == F.col("most_b")).alias("best_b"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent), n_best_b
    (of its B id), count_sum (documents of its pair, over links) and groups_sha256; with keep also groups."""
    documents, pairs = link(docs, a_path, b_path, doc_id, text, keep)
    totals = stored(counted(pairs))
    answers = pairs.select(F.col("block").alias("of"), "a", "b").join(totals, ["a", "b"])
    names = ["doc_id", *COUNTS, "n_best", "n_best_b", "count_sum", "groups_sha256", *["groups"] * keep]

    def judge(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pairs["a"].to_numpy().astype(np.int64) << 32 | pairs["b"].to_numpy().astype(np.int64))
        facts = pairs[["best_a", "best_b", "documents"]].to_numpy().astype(np.int64)[order]
        sums = [from_planes(t, np.uint32).astype(np.int64) @ facts[np.cumsum(from_planes(h, np.uint32), dtype=np.int64)] for h, t in zip(own["held"], own["times"], strict=True)]
        own[["n_best", "n_best_b", "count_sum"]] = np.array(sums, np.int64).reshape(-1, 3)
        return own[names]

    schema = ", ".join(f"{n} {'string' if n in ('doc_id', 'groups_sha256', 'groups') else 'long'}" for n in names)
    found = documents.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(judge, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
