"""Exact token counts of documents of any length.

Documents of up to ``CHUNK`` characters are encoded in batches. Longer ones are encoded as overlapping chunks with
offsets, and neighbours are spliced at a common boundary: a place in their overlap where a token ends in both and that
is proven stable. A byte-level pre-token never spans the place between a non-space character and a space, whatever
surrounds it, and merges never leave a pre-token, so both chunks' tokens on the far side of such a place are the
document's. Special strings hold no space and can't span it either. If an overlap has no such place (a long run
without space), alignment fails and the overlap is doubled, to the document's end if need be.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; a null doc_id stays null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

CHUNK, OVERLAP, LIMIT = 1 << 16, 256, 1024
STABLE = re.compile(r"(?<=\S) ")
_loaded: dict = {}


def tokenizer(path: str):
    """One tokenizer per worker and file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _splice(text: str, start: int, stop: int, left: set[int], right: set[int]) -> int | None:
    """The first stable place in text[start:stop] at which both chunks have a token boundary."""
    for m in STABLE.finditer(text, start + 1, stop):
        if m.start() in left and m.start() in right:
            return m.start()
    return None


def long_count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text. encode: the (start, end) offsets of the tokens of a text."""
    chunk, overlap = max(chunk, 2), max(overlap, 1)
    counted, begin, stop = 0, 0, min(len(text), chunk)
    tokens = encode(text[:stop])  # of text[begin:stop], with places in the whole text; begin is the start or a proven boundary
    while stop < len(text):
        wide = overlap
        while True:
            after = max(begin, stop - wide)
            far = min(len(text), after + max(chunk, 2 * wide))
            following = [(s + after, e + after) for s, e in encode(text[after:far])]
            at = _splice(text, after, stop, {e for _, e in tokens}, {s for s, _ in following})
            if at is not None:
                break
            wide *= 2
            if after == begin:  # this chunk has no stable place at all
                stop = min(len(text), stop + wide)
                tokens = [(s + begin, e + begin) for s, e in encode(text[begin:stop])]
                if stop == len(text):
                    return counted + len(tokens)
        counted += sum(e <= at for _, e in tokens)
        begin, stop, tokens = at, far, [x for x in following if x[0] >= at]
    return counted + len(tokens)


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """texts -> token counts, for a file of the tokenizers library (.json) or of sentencepiece (.model)."""
    if path.endswith(".model"):
        from .pieces import Encoder

        encoder = Encoder.of(path)
        return lambda texts: [encoder.encode(t)[0] for t in texts]
    own = tokenizer(path)

    def offsets(text: str) -> list[tuple[int, int]]:
        return own.encode(text, add_special_tokens=False).offsets

    def run(texts: list[str]) -> list[int]:
        short = [k for k, t in enumerate(texts) if len(t) <= chunk]
        out = [0] * len(texts)
        for k, e in zip(short, own.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
            out[k] = len(e)
        for k, t in enumerate(texts):
            if len(t) > chunk:
                out[k] = long_count(offsets, t, chunk, overlap)
        return out

    return run


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches):
        count = counter(path, chunk, overlap)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
