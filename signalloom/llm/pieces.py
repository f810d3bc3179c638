"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model no piece crosses from a character to a white-space marker after it (checked when it is loaded), so the
marked text falls apart into chunks (a run of markers and the characters up to the next one) that are segmented
independently. Each worker keeps a table of distinct chunks: a chunk is segmented and decoded by the library once,
when first seen, and its ids are joined back by position. The table is emptied at ``TABLE`` chunks, and chunks of
over ``LONGEST`` characters aren't kept, so memory is bounded. The table lives in the worker and not in a shuffled
table of the corpus: that would move each occurrence of each word.

Edge cases: null counts as empty (no ids); a text of spaces has its markers' pieces; literal markers in a text are
white space, as in the library; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

TABLE, LONGEST = 250_000, 64
MARK = "▁"
CHUNKS = re.compile(" *[^ ]+| +$")


class Encoder:
    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, table: int = TABLE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for k in range(self.library.get_piece_size()) if re.search(f"[^{MARK}]{MARK}", p := self.library.id_to_piece(k))]
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        self.most, self.ids, self.words = table, {}, {}

    def _segment(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """Ids, joined by commas, and decoded text of marked chunks. The library adds the first marker itself."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        alone = [self.library.piece_to_id(MARK)]
        found = [alone if c == " " else f for c, f in zip(chunks, found, strict=True)]
        back = self.library.decode(found)
        return [",".join(map(str, f)) for f in found], [" " + b for b in back]

    def segments(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """For each text its chunks' ids and decoded texts, in order."""
        dealt = [CHUNKS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.ids) > self.most:
            self.ids.clear()
            self.words.clear()
        ids, words = self.ids, self.words
        new = list({c for chunks in dealt for c in chunks if c not in ids})
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            got = self._segment(part)
            ids.update(zip(part, got[0], strict=True))
            words.update(zip(part, got[1], strict=True))
        out = [([ids[c] for c in chunks], [words[c] for c in chunks]) for chunks in dealt]
        for c in new:
            if len(c) > LONGEST:
                del ids[c], words[c]
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        out = []
        for ids, words in self.segments(texts):
            joined = ",".join(ids)
            out.append((joined.count(",") + 1 if joined else 0, joined, "".join(words)[1:]))
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        return self.encode_batch([text])[0]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids array<int> and decoded."""

    def run(batches):
        encoder = Encoder.of(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [x for k in range(0, len(texts), 32) for x in encoder.encode_batch(texts[k : k + 32])] if keep else None
            digest = [(n, _sha(i), _sha(d)) for n, i, d in got] if keep else [(n, _sha(i), _sha(d)) for k in range(0, len(texts), 32) for n, i, d in encoder.encode_batch(texts[k : k + 32])]
            columns = [batch.column(0), pa.array([x[0] for x in digest], pa.int64()), pa.array([x[1] for x in digest], pa.string()), pa.array([x[2] for x in digest], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([list(map(int, x[1].split(","))) if x[1] else [] for x in got], pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
