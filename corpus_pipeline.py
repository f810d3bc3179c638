"""A corpus pipeline: documents in, encoded documents out. Each stage's rows are written and read again by the next.

toxicity rejects documents, SimHash keeps one document of each group, the suffix array cuts passages that an earlier
document keeps, mixing samples documents towards tempered shares of source, language and topic, and SentencePiece
encodes what is left. All stages but the last return the columns of documents, whatever they are.

Edge cases: null and empty texts are never toxic, have equal fingerprints (one of them stays), no repeats and no
tokens, so mixing doesn't take them; null ids stay through SimHash and can be sampled; of repeated rows of an id one stays;
an empty table gives an empty result. ``ORACLE_SQL`` is None: trained models, XXH64 and the tokenizer can't be said in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import mixing, pieces, queries, simhash, suffix, toxicity
from signalloom.llm.common import stored, table

#: Share of all tokens that mixing aims at, without repeating a document.
KEEP = 0.9


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, its smallest id; null ids stay, of repeated rows of an id one does."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that another document keeps; documents of which nothing stays go."""
    return suffix.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the targets, each once at most; those without tokens go."""
    return mixing.mix(docs, keep=KEEP, repeats=False).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with its tokens; null texts are empty ones."""
    return pieces.round_trip(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", without_toxic), ("simhash", without_copies), ("suffix_array", without_repeats), ("mixing", mixed), ("sentencepiece", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between stages rows are written to the shared folder of spark.checkpoint.dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
