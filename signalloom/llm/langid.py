"""Language identification by nearest centroids.

A text becomes a vector of hashed byte trigrams of its lower-cased letters: log(1 + count) times inverse document
frequency, of length 1. Each language has several centroids, clustered (spherical k-means) from a bounded sample of
learning documents; clusters with a small share of a language's sample, mostly mislabelled texts, are dropped. A text
gets the language of the centroid with the largest cosine. Its distance is 1 - cosine; a text farther than all but a
small share of the sample from its centroid is marked as rejected.

The sample is bounded by ``SAMPLE`` documents a language and ``ROWS`` in all (chosen by a hash of the row, texts whole); counts and
centroids come from it. More than ``LANGUAGES`` languages are an error. Edge cases: null texts and texts without a letter are 'und' with score 0 and rejected; learning rows
without text or lang are left out; null ids are learned from; with nothing to learn from every row is 'und'; repeated rows are predicted each;
ties go to the first language in order; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, small

DIMENSIONS, SAMPLE, CENTROIDS, LEAST_SHARE, REJECTED = 4096, 1200, 4, 0.08, 0.005
#: Languages to learn at most, and rows of all their samples (16 KB each on the driver).
LANGUAGES, ROWS = 256, 12_000
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text whose trigrams are in memory at a time.
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigram_counts(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """len(texts) x dimensions counts of hashed trigrams of whole texts."""
    out = np.zeros((len(texts), dimensions), np.float32)
    held, owner, size = [], [], 0

    def add():
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
        if len(data) < 3:
            return
        who = np.repeat(np.array(owner, np.int64), [len(h) for h in held])
        code = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(12)
        blank = (data[:-2] == 32).astype(np.uint8) + (data[1:-1] == 32) + (data[2:] == 32)
        good = (who[:-2] == who[2:]) & (blank < 2)
        base = owner[0]
        flat = (who[:-2][good] - base) * dimensions + (code[good] % np.uint32(dimensions)).astype(np.int64)
        span = owner[-1] - base + 1
        out[base : base + span] += np.bincount(flat, minlength=span * dimensions).reshape(span, dimensions)

    for k, text in enumerate(texts):
        data = b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" "
        for at in range(0, max(len(data) - 2, 1), PIECE):
            part = data[at : at + PIECE + 2]
            held.append(part)
            owner.append(k)
            size += len(part)
            if size >= PIECE:
                add()
                held, owner, size = [], [], 0
    if held:
        add()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(vectors: np.ndarray, k: int, least_share: float, seed: int = 0) -> np.ndarray:
    """Spherical k-means; at least one centroid stays."""
    random = np.random.default_rng(seed)
    k = min(k, len(vectors))
    chosen = [int(random.integers(len(vectors)))]
    for _ in range(k - 1):
        far = 1 - np.max(vectors @ vectors[chosen].T, axis=1)
        far = np.maximum(far, 0) ** 2
        chosen.append(int(random.choice(len(vectors), p=far / far.sum())) if far.sum() > 0 else chosen[0])
    middle = vectors[chosen]
    for _ in range(15):
        near = np.argmax(vectors @ middle.T, axis=1)
        middle = unit(np.stack([vectors[near == c].sum(axis=0) if (near == c).any() else middle[c] for c in range(k)]))
    near = np.argmax(vectors @ middle.T, axis=1)
    share = np.bincount(near, minlength=k) / len(vectors)
    keep = share >= min(least_share, share.max())
    return middle[keep]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    matrix: np.ndarray  # centroids x dimensions
    idf: np.ndarray
    farthest: dict[str, float]  # distances beyond which a text is rejected

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return unit(np.log1p(trigram_counts(texts, len(self.idf))) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        told = [has_letter(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosine = self.vectors(texts) @ self.matrix.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        names = [self.languages[b] if t else "und" for b, t in zip(best.tolist(), told, strict=True)]
        score = [float(s) if t else 0.0 for s, t in zip(score.tolist(), told, strict=True)]
        return names, score, [not t or 1 - s > self.farthest[n] for n, s, t in zip(names, score, told, strict=True)]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS, dimensions: int = DIMENSIONS) -> Model:
    """Learns from rows with text and lang that aren't held out, of each language ``sample`` at most (in expectation)."""
    learn = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    known = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn: group them first")
    rates = {r[0]: min(1.0, sample / r[1], ROWS / len(known) / r[1]) for r in known}
    of = lambda r: F.coalesce(*[F.when(F.col("lang") == n, F.lit(x)) for n, x in r.items()], F.lit(0.0))
    chosen = learn.where(sampled(of(rates), "id", "text")) if rates else learn.limit(0)
    # rows that repeat an id and its text are chosen or left together: where they crowd, their place in the table decides too
    got = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}
    if any(n > 2 * sample for n in got.values()):
        chosen = chosen.where(sampled(of({n: min(1.0, sample / c) for n, c in got.items()}), "id", "text", F.monotonically_increasing_id()))
    chosen = chosen.select("lang", "text")

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            told = [has_letter(t) for t in texts]
            found = trigram_counts(texts, dimensions)
            rows = [(n, i := np.flatnonzero(f).astype(np.uint16), f[i]) for n, f, t in zip(batch.column(0).to_pylist(), found, told, strict=True) if t]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["lang", "at", "counts"])

    got = chosen.mapInArrow(run, "lang string, at binary, counts binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    if not got:
        return Model([], np.zeros((0, dimensions), np.float32), np.ones(dimensions, np.float32), {})
    dense = np.zeros((len(got), dimensions), np.float32)
    for row, r in zip(dense, got, strict=True):
        row[np.frombuffer(r[1], np.uint16)] = np.frombuffer(r[2], np.float32)
    idf = np.log((1 + len(got)) / (1 + (dense > 0).sum(axis=0))).astype(np.float32) + 1
    dense = unit(np.log1p(dense) * idf)
    names, matrix, farthest = [], [], {}
    lang_of = np.array([r[0] for r in got])
    for name in sorted(set(lang_of.tolist())):
        own = dense[lang_of == name]
        middle = centroids(own, k, LEAST_SHARE)
        names += [name] * len(middle)
        matrix.append(middle)
        farthest[name] = float(np.quantile(1 - np.max(own @ middle.T, axis=1), 1 - REJECTED))
    return Model(names, np.concatenate(matrix).astype(np.float32), idf, farthest)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine), rejected."""

    def run(batches):
        for batch in small(batches):
            names, scores, far = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
