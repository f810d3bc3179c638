"""Stupid-backoff language-model scores, with counts of the whole corpus.

n-gram count tables are partitioned by the n-gram's hash; documents' exploded n-grams meet them through the packed
key exchange of ``common`` (a block sends every distinct n-gram once, with its count in the block, and gets the
corpus count back), and the log scores are summed per document. The tables are the corpus itself, so they grow with
it; nothing is collected.

    S(w | h) = c(h w) / c(h)          if c(h w) >= min_count
             = alpha S(w | shorter h)  otherwise;   S(w) = c(w) / N

Words are lower-cased (A-Z) runs between ASCII white space. Edge cases: null, empty and white-space texts have
n_words 0, log_score 0 and a null score; repeated rows count and score as often as they stand there; an empty table
gives no rows; extra columns are ignored. Keys are 64-bit hashes; two n-grams that share one would share a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPLY, REQUEST, answers, bucket_count, hashed_words, in_blocks, merged, mix, replies, requests, sorted_block

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2


def _grams(texts: list, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 0..order the hash of the n-gram that ends at each word, the length of texts, the word's place in its text."""
    hashes, lengths = hashed_words(texts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = [np.zeros(len(hashes), np.uint64)]
    for n in range(1, order + 1):
        head = np.concatenate((np.zeros(1, np.uint64), grams[-1][:-1])) if n > 1 else np.uint64(0)
        grams.append(mix(head * np.uint64(0x9E3779B97F4A7C15) + hashes + np.uint64(n)))
    return grams, lengths, place


def _distinct(grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([g[place >= n - 1] for n, g in enumerate(grams)]), return_counts=True)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of docs: doc_id, n_words long, log_score double (summed), score double (mean per word)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs, blocks = in_blocks(docs)
    buckets = bucket_count(spark, blocks * 1.2e6 * order)

    def ask(key, rows):
        grams, _, place = _grams(sorted_block(rows).column("text").to_pylist(), order)
        keys, counts = _distinct(grams, place)
        return requests(key[0].as_py(), keys, counts.astype(np.uint32), buckets)

    def count(key, rows):
        got, keys, facts, _, sizes = merged(rows, np.uint32)
        _, number = np.unique(keys, return_inverse=True)
        return replies(got, sizes, np.bincount(number, weights=facts).astype(np.uint64)[number])

    def total(key, rows, back):
        rows = sorted_block(rows)
        grams, lengths, place = _grams(rows.column("text").to_pylist(), order)
        keys, _ = _distinct(grams, place)
        counts = answers(back, keys, buckets, np.uint64).astype(np.float64)
        own = [counts[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] if len(keys) else np.zeros(0) for g in grams]
        value = own[1] / own[0] if len(place) else np.zeros(0)
        for n in range(2, order + 1):
            context = np.concatenate((np.ones(1), own[n - 1][:-1]))[: len(place)]
            known = (place >= n - 1) & (own[n] >= min_count)
            value = np.where(known, own[n] / np.maximum(context, 1), np.where(place >= n - 1, alpha * value, value))
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=np.log(value), minlength=len(lengths))
        mean = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(lengths), "log_score": pa.array(sums), "score": mean})

    asked = docs.groupBy("_block").applyInArrow(ask, REQUEST)
    counted = asked.groupBy("_bucket").applyInArrow(count, REPLY)
    return docs.groupBy("_block").cogroup(counted.groupBy("_block")).applyInArrow(total, "doc_id long, n_words long, log_score double, score double")
