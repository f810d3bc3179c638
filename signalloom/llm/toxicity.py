"""Toxicity by two class-conditional Kneser-Ney letter models with shared lower orders.

Words are read letter by letter between a start and an end mark; the context of a letter is the ``ORDER`` - 1 symbols
before it, or as many as the word has. c_k(g) counts the gram g in class k (toxic, ordinary), each distinct word of a
document once; a gram is kept if both classes together have it ``CUTOFF`` times (the usual pruning of such models).

    P_k(w | h) = ([hw kept] max(c_k(hw) - D_k, 0) + rest_k(h) P(w | h')) / c_k(h)    h' is h without its first symbol
    P(w | h)   = (max(N(hw) - D_m, 0) + D_m T(h) P(w | h')) / sum of N(hw) over w    the shared, lower orders

N(g) is the Kneser-Ney continuation count: the distinct symbols that stand before g in kept grams of both classes
together; T(h) counts the w that have any; rest_k(h) is what discounting and pruning leave, so that both sum to one; the
lowest order backs off to equal shares. Each order and each class has the discount n1 / (n1 + 2 n2) of its own. A context
that a class hasn't seen leaves the letter to the shared order, so a rare expression is judged by what both classes know.
Where a gram isn't kept, P(w | h') stands on both sides and the log-ratio is that of the shares left.

Every letter of the whole text is scored. An expression is a word, of a word of over ``STRETCH`` symbols each stretch of so
many (half overlapping, contexts going on across them); of scripts without spaces what follows from each character
on. Its log-likelihood ratio is normalised by its length. What sets toxic documents apart is a few expressions (the mean over
a document tells languages apart and not toxicity), but the largest ratio of a document grows with the number of its
expressions, so each of its ``TOP`` largest is held against how many of that size an ordinary document of so many
expressions has: with G(x) the share of ordinary expressions whose ratio is over x, n expressions have n G(x) over x by
chance, and the k-th largest ratio x gives the evidence max(0, log(k / (n G(x)))). G is counted over the ordinary ones of
the learning documents that the counts of that model left out, and goes on exponentially beyond its last ``LAST`` expressions,
with their mean excess. The sum becomes a score by a logistic fit on the same documents.

The models are fitted on at most ``SAMPLE`` labelled documents in expectation (by a hash of the row, texts whole);
that bound is the only one. Edge cases: null or empty texts have no evidence; conflicting labels of an id count as
toxic; null labels and ids are left out; without learning documents of both classes every score is 0; repeated rows
learn and are scored each; extra columns are ignored by ``score`` and kept by ``drop_toxic``. There is no context beyond a
word: an expression of several words, each of them ordinary, gets no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, sampled, small, whole_row

SAMPLE, ORDER, CUTOFF, TOP, STRETCH, PAD = 8_000, 8, 5, 3, 24, 4
#: Expressions from which the tail of G is taken, and the bounds and number of bins in which ratios are counted.
LAST, BINS = 200, (-8.0, 8.0, 2048)
#: Begin and end a word; no word holds them.
START, END = "\2", "\0"
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))
#: Grams in a worker's table before it is sent on, and words whose ratio a worker remembers.
HELD, KNOWN = 200_000, 100_000

#: Punctuation beyond ASCII, without the apostrophe, and runs of scripts that don't part words by spaces.
_MARKS = re.compile("[\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u2018\u201a-\u206f\u3000-\u3004\u3008-\u3020\u3030\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")


def words(text: str | None) -> set[str]:
    """Distinct words; of a run in a script without spaces, what follows from each character on, up to ORDER characters."""
    low = (text or "").lower()
    if not low.isascii():
        low = _MARKS.sub(" ", low)
        if _UNSPACED.search(low):
            low = _UNSPACED.sub(lambda m: " " + " ".join(m[0][s : s + ORDER] for s in range(len(m[0]))) + " ", low)
    return set(low.encode("utf-8", "replace").translate(_BLANK).decode().split())


def grams(word: str, order: int = ORDER) -> list[str]:
    """All grams of a word with its marks, up to ``order`` symbols."""
    whole = START + word + END
    return [whole[k : k + n] for k in range(len(whole)) for n in range(1, min(order, len(whole) - k) + 1)]


class _Ratios(dict):
    """Word to its length-normalised log-likelihood ratio."""

    def __init__(self, model: Model):
        super().__init__()
        self.of, self.rest, self.order = model.ratios, model.rests, model.order

    def steps(self, word: str) -> list[float]:
        """Toxic minus ordinary log-probability of each letter of a word and of its end."""
        whole, out = START + word + END, []
        for k in range(1, len(whole)):
            gram = whole[max(0, k - self.order + 1) : k + 1]
            x = self.of.get(gram)
            out.append(self.rest.get(gram[:-1], 0.0) if x is None else x)
        return out

    def __missing__(self, word: str) -> float:
        each = self.steps(word)
        if len(each) <= STRETCH:
            found = sum(each) / (len(each) + PAD)
        else:
            found = max(sum(part := each[s : s + STRETCH]) / (len(part) + PAD) for s in range(0, len(each), STRETCH // 2))
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found
        return found


def bin_of(x):
    low, high, n = BINS
    return np.clip((np.asarray(x) - low) / (high - low) * n, 0, n - 1).astype(np.int64)


class Chance:
    """G, from the number of ordinary expressions in each bin of ratios."""

    def __init__(self, bins: np.ndarray):
        low, high, n = BINS
        over = np.cumsum(bins[::-1])[::-1]  # expressions in a bin or above
        self.whole = math.log(max(1, over[0]))
        self.logs = np.log(np.maximum(over, 1)).tolist()
        tail = int(np.flatnonzero(over >= min(LAST, max(1, over[0])))[-1]) if over[0] else 0
        self.start = low + tail * (high - low) / n
        excess = (np.arange(n)[tail:] + 0.5) * (high - low) / n + low - self.start
        self.scale = max(1e-3, float((bins[tail:] * excess).sum() / max(1, over[tail])))
        self.at_start = self.logs[tail]

    def log_share(self, x: float) -> float:
        if x > self.start:
            return self.at_start - (x - self.start) / self.scale - self.whole
        return self.logs[int(bin_of(x))] - self.whole

    def evidence(self, largest: list[float], n: int) -> float:
        return sum(max(0.0, math.log((k + 1) / n) - self.log_share(x)) for k, x in enumerate(largest))


@dataclass
class Model:
    ratios: dict[str, float] = field(default_factory=dict)  # kept gram: log-ratio of its last symbol
    rests: dict[str, float] = field(default_factory=dict)  # context: log-ratio of the shares left for other symbols
    slope: float = 0.0
    offset: float = -50.0
    order: int = ORDER
    chance: Chance | None = None

    def largest(self):
        """texts -> (the largest ratios, number of expressions) of each, with one memory of words for all calls."""
        known = _Ratios(self)

        def run(texts):
            for text in texts:
                own = words(text)
                yield nlargest(TOP, map(known.__getitem__, own)), len(own) + sum(len(w) // (STRETCH // 2) for w in own if len(w) >= STRETCH)

        return run

    def counted(self):
        """texts -> in how many expressions of all of them a ratio falls into each bin."""
        known, bins = _Ratios(self), np.zeros(BINS[2], np.int64)

        def run(texts):
            for text in texts:
                np.add.at(bins, bin_of(np.fromiter(map(known.__getitem__, words(text)), np.float64)), 1)
            return bins

        return run

    def evidence(self):
        """texts -> the evidence of each."""
        largest, chance = self.largest(), self.chance
        return lambda texts: [chance.evidence(*x) for x in largest(texts)]

    def scorer(self):
        """texts -> scores."""
        if self.chance is None:
            return lambda texts: [1 / (1 + math.exp(-self.offset)) for _ in texts]
        evidence = self.evidence()
        return lambda texts: [1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * x + self.offset)))) for x in evidence(texts)]


COUNTS = ("t", "o", "t1", "o1")  # of all learning documents, and of those that the logistic fit leaves


def _tables(held: dict[str, list[int]], name: str) -> pa.RecordBatch:
    table = np.array(list(held.values()), np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(np.ascontiguousarray(table[:, c])) for c in range(4))], [name, *COUNTS])


def _word_counts(batches):
    """Distinct words of documents, with the number of documents of each kind that have them."""
    held = defaultdict(lambda: [0, 0, 0, 0])
    for batch in small(batches):
        for text, toxic, kept in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            at = 0 if toxic else 1
            for w in words(text):
                row = held[w]
                row[at] += 1
                row[at + 2] += kept
            if len(held) > HELD:
                yield _tables(held, "word")
                held.clear()
    if held:
        yield _tables(held, "word")


def _gram_counts(batches):
    """Grams of distinct words, with the words' counts."""
    held = defaultdict(lambda: [0, 0, 0, 0])
    for batch in batches:
        for word, *counts in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            for gram, n in Counter(grams(word)).items():
                row = held[gram]
                for c in range(4):
                    row[c] += n * counts[c]
            if len(held) > HELD:
                yield _tables(held, "gram")
                held.clear()
    if held:
        yield _tables(held, "gram")


def discount(once: float, twice: float) -> float:
    """n1 / (n1 + 2 n2), within (0, 1) where counts say nothing."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def ratios(names: list[str], toxic: np.ndarray, ordinary: np.ndarray, discounts: tuple[float, float], order: int = ORDER) -> tuple[dict[str, float], dict[str, float]]:
    """(log-ratio of each kept gram of full context, log-ratio of the shares left in each context), from the kept grams'
    counts. Every part of a kept gram is kept too."""
    import pandas as pd

    index = pd.Index(names)
    length = np.fromiter(map(len, names), np.int64, len(names))
    begins = np.fromiter((g[0] == START for g in names), bool, len(names))
    head, tail = (index.get_indexer([g[part] for g in names]) for part in (slice(0, -1), slice(1, None)))  # -1: empty
    kinds = len(np.unique([g for g in names if len(g) == 1])) or 1

    # shared orders: continuation counts, by the symbols before a gram
    met = np.bincount(tail[length > 1], minlength=len(names)).astype(np.float64)
    low = ~begins & (length < order)
    sums, types = (np.bincount(head[low] + 1, weights=x[low], minlength=len(names) + 1) for x in (met, (met > 0).astype(float)))
    shared = np.full(len(names), 1 / kinds)
    for n in range(1, order):
        at = np.flatnonzero(low & (length == n))
        d = discount((met[at] == 1).sum(), (met[at] == 2).sum())
        below = np.where(tail[at] >= 0, shared[tail[at]], 1 / kinds)
        whole = sums[head[at] + 1]
        shared[at] = np.where(whole > 0, (np.maximum(met[at] - d, 0) + d * types[head[at] + 1] * below) / np.maximum(whole, 1), below)

    # the classes' own order
    full = np.flatnonzero((length == order) | (begins & (length > 1)))
    below, context = shared[tail[full]], head[full]
    logs, rests = [], []
    for counts, d in zip((toxic, ordinary), discounts, strict=True):
        c, n = np.maximum(counts[full] - d, 0), counts.astype(np.float64)
        rest = n - np.bincount(context, weights=c, minlength=len(names))
        logs.append(np.log(np.where(n[context] > 0, (c + rest[context] * below) / np.maximum(n[context], 1), below)))
        rests.append(np.log(np.where(n > 0, rest / np.maximum(n, 1), 1.0)))
    found = {names[g]: float(x) for g, x in zip(full.tolist(), (logs[0] - logs[1]).tolist(), strict=True)}
    ends = np.unique(context)
    return found, {names[h]: float(x) for h, x in zip(ends.tolist(), (rests[0] - rests[1])[ends].tolist(), strict=True)}


def _counts(learn: DataFrame) -> DataFrame:
    """(gram, COUNTS) of the learning documents, written."""
    summed = lambda df, name: df.groupBy(name).agg(*[F.sum(c).alias(c) for c in COUNTS])
    schema = ", ".join(f"{c} long" for c in COUNTS)
    vocabulary = summed(learn.mapInArrow(_word_counts, f"word string, {schema}"), "word")
    return cut(summed(vocabulary.mapInArrow(_gram_counts, f"gram string, {schema}"), "gram"))


def _model(counts: DataFrame, t: str, o: str) -> Model:
    """The model of two of the columns, without its score."""
    full = (F.length("gram") == ORDER) | (F.col("gram").startswith(START) & (F.length("gram") > 1))
    once = counts.where(full).agg(*[F.count_if(F.col(c) == n) for c in (t, o) for n in (1, 2)]).first()
    # bounded by the sample: a gram is kept if it is in CUTOFF words of it
    got = counts.where(F.col(t) + F.col(o) >= CUTOFF).select("gram", F.col(t).cast("int"), F.col(o).cast("int")).orderBy("gram").toArrow()
    return Model(*ratios(got.column(0).to_pylist(), got.column(1).to_numpy(), got.column(2).to_numpy(), (discount(*once[:2]), discount(*once[2:]))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit by Newton steps."""
    scale = max(float(np.std(x)), 1e-9)
    z, beta, ridge = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from labelled documents that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    rate = min(1.0, sample / max(1, known.count()))
    chosen = known.where(sampled(rate, "_id"))
    kept = F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(4)) > 0
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    # at most about ``sample`` rows of 12 bytes
    learn = slim.join(F.broadcast(chosen), "_id").select("text", (F.col("_toxic") > 0).alias("toxic"), kept.alias("kept"))
    rows = learn.count()
    if rows > 2 * sample:  # ids that repeat: the bound is of rows
        learn = learn.where(sampled(sample / rows, F.monotonically_increasing_id(), "text"))
    learn = cut(learn)
    counts = _counts(learn)
    model = _model(counts, "t1", "o1")
    if not model.ratios:
        return Model()

    def run(batches, model=model):
        largest, counted, bins = model.largest(), model.counted(), None
        for batch in small(batches):
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = list(largest(texts))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64()), batch.column(1), pa.nulls(len(texts), pa.list_(pa.int64()))], ["x", "n", "y", "bins"])
            bins = counted([t for t, y in zip(texts, toxic, strict=True) if not y])
        if bins is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([bins.tolist()], pa.list_(pa.int64()))], ["x", "n", "y", "bins"])

    # bounded by the sample: a few numbers a document, and a row of bins a task
    got = learn.where("not kept").select("text", "toxic").coalesce(8).mapInArrow(run, "x array<double>, n long, y boolean, bins array<long>").collect()
    rows = [r for r in got if r.bins is None]
    y = np.array([float(r.y) for r in rows])
    if not len(y) or y.min() == y.max():
        return Model()
    chance = Chance(sum(np.array(r.bins, np.int64) for r in got if r.bins is not None))
    x = np.array([chance.evidence(r.x, r.n) for r in rows])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    del model, run  # one model at a time on the driver
    model = _model(counts, "t", "o")
    model.chance = chance
    model.slope, model.offset = _logistic(x, y)
    return model


def _scored(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score) of rows (row struct), by the struct's text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        scores = model.scorer()
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(0).field(text).to_pylist()), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    slim = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).alias("row"))
    return _scored(slim, model).select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those predicted toxic."""
    return _scored(docs.select(whole_row(docs)), model, text).where("score < 0.5").select("row.*")
