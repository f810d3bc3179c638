"""Substring dedup by relative Lempel-Ziv parsing: what an earlier document says already is removed.

The reference holds, for every window of ``length`` words, its first place: the smallest doc_id that has it and the first word
there. It is indexed in reference blocks (buckets of the windows' hashes), and every document is parsed against every
block of it: documents are dealt to blocks of a few MB of text, each sends its distinct windows to the reference blocks as packed
arrays, and the first places come back. The parse is greedy: a factor begins where a window has a place in the
reference and goes on as long as the next word's window has the next place; at a factor's boundary the windows that span it are
looked up by themselves, so none is missed. Factors have ``length`` words at least; those of a document with a smaller id
are duplicate spans, and their words are removed. A document's own parse is judged on the input, not on what is left of others.

Only windows that may repeat are looked up. A first exchange of the same kind sends sampled anchors only, the least hash of
``anchor`` words in each window; equal windows have equal anchors, so a window whose anchor lies in one document alone has no
place elsewhere. A block sends a key once, whatever the number of copies, so neither hot passages nor groups of copies
crowd a task, and no pair of documents is ever formed: parsing each document against the texts of all earlier ones would
be quadratic.

Words are runs between ASCII white space, as they are. Edge cases: a null text has no words; documents of fewer than
``length`` words keep all; repeated rows and rows of one id don't remove each other's words, as no id is smaller; a null id
keeps all its words and takes nobody's; an empty table gives no rows; other columns are ignored. Windows are compared by
64-bit hashes of their words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPLY, REQUEST, answers, bucket_count, in_blocks, merged, replies, requests
from .suffix import Block, _compare, _held, _repeated

LENGTH, ANCHOR = 13, 7
#: A place in the reference.
PLACE = np.dtype([("doc", np.int64), ("word", np.uint32)])
LAST = np.iinfo(np.int64).max


def _block(rows: pa.Table, length: int, anchor: int) -> tuple[Block, np.ndarray]:
    """(the block with its documents in order of id, the id of each; null ids are LAST)."""
    ids = rows.column("doc_id").fill_null(LAST).to_numpy()
    order = np.lexsort((rows.column("_order").to_numpy().view(np.uint64), ids))
    ranked = rows.take(order).drop_columns("_order").append_column("_order", pa.array(np.arange(len(order))))
    return Block(ranked, length, anchor), ids[order]


def _looked_up(block: Block, ids: np.ndarray, back: pa.Table, buckets: int) -> np.ndarray:
    """Windows that may repeat, of documents that have an id."""
    return np.flatnonzero(_repeated(block, back, buckets) & (ids[block.doc] < LAST)) if len(block.doc) else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted keys, where each is first): windows are in the order of id and word, and the sort keeps it."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else order
    return keys[order][first], order[first]


def _first_place(key, rows):
    """A reference block: the first place of each window that the blocks ask for."""
    got, keys, facts, _, sizes = merged(rows, PLACE)
    order = np.lexsort((facts["word"], facts["doc"], keys))
    begins = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    answer = np.zeros(len(keys), PLACE)
    answer[order] = facts[order][begins][np.cumsum(begins) - 1]
    return replies(got, sizes, answer)


def factors(doc: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each factor, number of its windows), from the document, first word and place of each window with a
    place, in order: a factor goes on while document, word and place do."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = (np.diff(doc) == 0) & (np.diff(word) == 1) & (np.diff(place["doc"]) == 0) & (place["word"][1:] == place["word"][:-1] + 1)
    begins = np.flatnonzero(np.concatenate(([True], ~on)))
    return begins, np.diff(np.append(begins, len(doc)))


FACTOR = pa.struct([("start_word", pa.int64()), ("n_words", pa.int64()), ("from_doc", pa.int64()), ("from_word", pa.int64())])


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space); with keep also
    kept (those words) and factors (array of start_word, n_words, from_doc, from_word: the duplicate spans)."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim, blocks = in_blocks(slim)
    buckets = bucket_count(docs.sparkSession, blocks * 1.2e6)

    def ask(key, rows):
        block, _ = _block(rows, length, anchor)
        return requests(key[0].as_py(), *_held(block.suffix, block.doc[block.run]), buckets)

    def look_up(key, rows, back):
        block, ids = _block(rows, length, anchor)
        chosen = _looked_up(block, ids, back, buckets)
        keys, first = _distinct(block.windows(chosen))
        facts = np.zeros(len(keys), PLACE)
        facts["doc"], facts["word"] = ids[block.doc[chosen[first]]], block.words(chosen[first])
        return requests(key[0].as_py(), keys, facts, buckets)

    def report(key, rows, back):
        block, ids = _block(rows, length, anchor)
        kinds = back.column("_kind").to_numpy() if back.num_rows else np.zeros(0)
        anchors, places = (back.filter(pa.array(kinds == k)) for k in (0, 1))
        chosen = _looked_up(block, ids, anchors, buckets)
        window = block.windows(chosen)
        keys = np.unique(window)
        place = answers(places, keys, buckets, PLACE)[np.searchsorted(keys, window)] if len(keys) else np.zeros(0, PLACE)
        earlier = place["doc"] < ids[block.doc[chosen]]
        chosen, place = chosen[earlier], place[earlier]
        begins, sizes = factors(block.doc[chosen], block.words(chosen), place)
        owner, start, words = block.doc[chosen[begins]], block.words(chosen[begins]), sizes + length - 1
        change = np.zeros(int(block.lengths.sum()) + 1, np.int64)
        np.add.at(change, block.starts[owner] + start, 1)
        np.add.at(change, block.starts[owner] + start + words, -1)
        gone = np.cumsum(change)[:-1] > 0
        removed = np.concatenate(([0], np.cumsum(gone)))
        removed = removed[block.starts + block.lengths] - removed[block.starts]
        kept = []
        for t, s, n, out in zip(block.rows.column("text").to_pylist(), block.starts.tolist(), block.lengths.tolist(), removed.tolist(), strict=True):
            own = (t or "").encode("utf-8", "surrogatepass").split()
            kept.append(b" ".join([w for w, g in zip(own, gone[s : s + n].tolist(), strict=True) if not g] if out else own))
        table = {"doc_id": block.rows.column("doc_id"), "n_words": pa.array(block.lengths), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if keep:
            spans = [pa.array(x.astype(np.int64)) for x in (start, words, place["doc"][begins], place["word"][begins])]
            ends = np.searchsorted(owner, np.arange(len(kept) + 1)).astype(np.int32)
            table |= {"kept": pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()), "factors": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(spans, fields=list(FACTOR)))}
        return pa.table(table)

    dealt = slim.select("_block", "_order", "doc_id", "text").groupBy("_block")
    anchors = dealt.applyInArrow(ask, REQUEST).groupBy("_bucket").applyInArrow(_compare, REPLY)
    places = dealt.cogroup(anchors.groupBy("_block")).applyInArrow(look_up, REQUEST).groupBy("_bucket").applyInArrow(_first_place, REPLY)
    back = anchors.withColumn("_kind", F.lit(0)).unionByName(places.withColumn("_kind", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, factors array<struct<start_word: long, n_words: long, from_doc: long, from_word: long>>" * keep
    return dealt.cogroup(back.groupBy("_block")).applyInArrow(report, schema)
