"""Repeated passages by a sparse suffix array.

Of all suffixes (one per word) only those at content-selected places are retained: the minimisers of ``ANCHOR``-word
hashes in every window of ``length`` words. Equal passages of that length select equal suffixes, so a passage repeats
only if a retained suffix does. The retained suffixes are dealt by the hash of their first ANCHOR words; hashes are sorted
and neighbours compared for equality, so suffixes that begin alike meet, but they aren't in the order of their text;
those that repeat are extended left and right: the hash of every ``length``-word window around them is sorted
and compared in turn, and windows that repeat join to maximal spans. Both rounds go through the packed key exchange of
``common``: a block sends each distinct key once, whatever the number of copies.

A word is repeated if it lies in a run of ``length`` words that at least two documents hold (a run repeated in a
single document alone doesn't count). Of the holders, the first in the order of a hash of id and text keeps it;
the spans of the others are removable. Words are runs between ASCII white space, compared as they are.

Edge cases: null, empty and short texts have no spans; repeated rows are documents of their own; ties have a total
order; an empty table gives an empty result; extra columns are kept by ``drop_repeats`` and ignored by ``spans``.
Keys are 64-bit hashes of words' 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPLY, REQUEST, answers, bucket_count, hashed_words, in_blocks, merged, replies, requests, sorted_block, whole_row, window_hashes

LENGTH, ANCHOR = 50, 8
#: Words of a block whose windows are hashed at once.
PIECE = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def minimisers(hashes: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The least hash of anchor words in each window of so many words."""
    least = window_hashes(hashes, anchor)
    width, have = length - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


class Block:
    """The windows of a block's documents: the document and the first word of each, and their retained suffixes as runs of
    windows of one document that retain the same one."""

    def __init__(self, rows: pa.Table, length: int, anchor: int):
        self.rows, self.length = sorted_block(rows), length
        self.hashes, self.lengths = hashed_words(self.rows.column("text").to_pylist(), lower=False)
        self.starts = np.cumsum(self.lengths) - self.lengths
        count = np.maximum(self.lengths - length + 1, 0)
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.at = np.arange(len(self.doc), dtype=np.int32) + np.repeat((self.starts - np.cumsum(count) + count).astype(np.int32), count)
        suffixes = self._hashed(self.at, lambda hashes: minimisers(hashes, length, anchor))
        self.run = np.flatnonzero(np.concatenate(([True], (suffixes[1:] != suffixes[:-1]) | (self.doc[1:] != self.doc[:-1]))) if len(suffixes) else np.zeros(0, bool))
        self.suffix = suffixes[self.run]

    def _hashed(self, at: np.ndarray, of) -> np.ndarray:
        """What ``of`` makes of the windows that begin at words, in ascending order; a piece of the block's words at a time."""
        out = np.empty(len(at), np.uint64)
        ends = np.searchsorted(at, np.arange(0, len(self.hashes) + PIECE, PIECE))
        for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if s < e:
                out[s:e] = of(self.hashes[k * PIECE : (k + 1) * PIECE + self.length - 1])[at[s:e] - k * PIECE]
        return out

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Hashes of chosen windows, in ascending order."""
        return self._hashed(self.at[chosen], lambda hashes: window_hashes(hashes, self.length))

    def words(self, chosen: np.ndarray) -> np.ndarray:
        """The first words of chosen windows, counted in their documents."""
        return self.at[chosen] - self.starts[self.doc[chosen]]


def _held(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whether two or more documents hold each (1 or 2)."""
    if not len(keys):
        return keys, np.zeros(0, np.uint8)
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.concatenate((start[1:], [len(keys)])) - 1
    return keys[start], (1 + (doc[start] != doc[last])).astype(np.uint8)


def _compare(key, rows):
    """Sorted keys against their neighbours. Answer: 0 held by one document, 1 repeated and first here, 2 repeated and
    first in another block."""
    got, keys, facts, blocks, sizes = merged(rows, np.uint8)
    order = np.lexsort((blocks, keys))
    sorted_keys, held = keys[order], facts[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    answer = np.zeros(len(keys), np.uint8)
    answer[order] = np.where(before, 2, np.where(after | (held > 1), 1, 0))
    return replies(got, sizes, answer)


def _exchange(docs: DataFrame, length: int, anchor: int):
    """(blocked documents, answers for their windows, number of buckets)."""
    spark = docs.sparkSession
    docs, blocks = in_blocks(docs)
    buckets = bucket_count(spark, blocks * 1.2e6)

    def ask(key, rows):
        block = Block(rows, length, anchor)
        return requests(key[0].as_py(), *_held(block.suffix, block.doc[block.run]), buckets)

    def extend(key, rows, back):
        block = Block(rows, length, anchor)
        chosen = np.flatnonzero(_repeated(block, back, buckets))
        return requests(key[0].as_py(), *_held(block.windows(chosen), block.doc[chosen]), buckets)

    slim = docs.select("_block", "_order", "doc_id", "text")
    suffixes = slim.groupBy("_block").applyInArrow(ask, REQUEST).groupBy("_bucket").applyInArrow(_compare, REPLY)
    windows = slim.groupBy("_block").cogroup(suffixes.groupBy("_block")).applyInArrow(extend, REQUEST).groupBy("_bucket").applyInArrow(_compare, REPLY)
    return docs, suffixes, windows, buckets


def _repeated(block: Block, back: pa.Table, buckets: int) -> np.ndarray:
    """Of each window, whether its retained suffix repeats."""
    keys = np.unique(block.suffix)
    flags = answers(back, keys, buckets, np.uint8)
    return np.repeat(flags[np.searchsorted(keys, block.suffix)] > 0, np.diff(block.run, append=len(block.doc))) if len(keys) else np.zeros(0, bool)


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cover(block: Block, chosen: np.ndarray, length: int) -> np.ndarray:
    """Words of the block that lie in chosen windows."""
    change = np.zeros(int(block.lengths.sum()) + 1, np.int32)
    at = block.at[chosen]
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change)[:-1] > 0


def _judged(block: Block, back: pa.Table, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that repeat, words that another document keeps)."""
    asked = np.array([r.as_py() for r in back.column("_kind")]) if back.num_rows else np.zeros(0)
    split = [back.filter(pa.array(asked == k)) for k in (0, 1)] if back.num_rows else [back, back]
    candidate = np.flatnonzero(_repeated(block, split[0], buckets))
    window = block.windows(candidate)
    keys = np.unique(window)
    if not len(keys):
        none = np.zeros(int(block.lengths.sum()), bool)
        return none, none
    flags = answers(split[1], keys, buckets, np.uint8)
    number = np.searchsorted(keys, window)
    flag = flags[number]
    owner = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, block.doc[candidate])
    away = (flag == 2) | ((flag == 1) & (block.doc[candidate] != owner[number]))
    return _cover(block, candidate[flag > 0], length), _cover(block, candidate[away], length)


def _answered(suffixes: DataFrame, windows: DataFrame) -> DataFrame:
    return suffixes.withColumn("_kind", F.lit(0)).unionByName(windows.withColumn("_kind", F.lit(1)))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per maximal repeated span: doc_id, start_word, end_word (exclusive), n_words, start_char, end_char,
    n_removable (words of it that an earlier holder keeps)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs, suffixes, windows, buckets = _exchange(docs, length, anchor)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start_word", "end_word", "n_words", "start_char", "end_char", "n_removable"))])

    def report(key, rows, back):
        block = Block(rows, length, anchor)
        repeated, away = _judged(block, back, buckets, length)
        out = []
        for k in np.unique(np.repeat(np.arange(len(block.lengths)), block.lengths)[repeated]).tolist():
            own = slice(block.starts[k], block.starts[k] + block.lengths[k])
            places = [m.span() for m in WORD.finditer(block.rows.column("text")[k].as_py())]
            name = block.rows.column("doc_id")[k].as_py()
            out += [(name, s, e, e - s, places[s][0], places[e - 1][1], int(away[own][s:e].sum())) for s, e in _runs(repeated[own])]
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    slim = docs.select("_block", "_order", "doc_id", "text")
    return slim.groupBy("_block").cogroup(_answered(suffixes, windows).groupBy("_block")).applyInArrow(report, ", ".join(f"{n} long" for n in schema.names))


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs without removable spans; n_chars follows the text if it is there. Documents of which nothing but white
    space stays go; documents without repeats stay as they are."""
    names = docs.columns
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), whole_row(docs))
    blocked, suffixes, windows, buckets = _exchange(rows, length, anchor)

    def rewrite(key, rows, back):
        rows = sorted_block(rows).combine_chunks()
        held = rows.column("row").combine_chunks().flatten()
        text_column = held[names.index(text)]
        block = Block(pa.table([rows.column("_order"), text_column], ["_order", "text"]), length, anchor)
        _, away = _judged(block, back, buckets, length)
        changed = np.unique(np.repeat(np.arange(len(block.lengths)), block.lengths)[away]).tolist()
        texts = []
        for k in changed:
            whole = text_column[k].as_py()
            places = [m.span() for m in WORD.finditer(whole)]
            kept, at = [], 0
            for s, e in _runs(away[block.starts[k] : block.starts[k] + block.lengths[k]]):
                kept.append(whole[at : places[s][0]])
                at = places[e - 1][1]
            texts.append("".join([*kept, whole[at:]]))
        if not changed:
            return pa.table(held, names)
        here = np.zeros(len(text_column), bool)
        here[changed] = True
        held[names.index(text)] = pc.replace_with_mask(text_column, pa.array(here), pa.array(texts, text_column.type))
        if n_chars in names:
            at = names.index(n_chars)
            held[at] = pc.replace_with_mask(held[at], pa.array(here), pa.array([len(t) for t in texts], held[at].type))
        here[changed] = [not t.strip() for t in texts]
        return pa.table(held, names).filter(pa.array(~here))

    slim = blocked.select("_block", "_order", "row")
    return slim.groupBy("_block").cogroup(_answered(suffixes, windows).groupBy("_block")).applyInArrow(rewrite, docs.schema)
