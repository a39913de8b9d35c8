"""Corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing. Each stage works on all that the one before it kept.

In every stage null texts count as empty ones, rows of one doc_id (or of none) are judged each by its own text unless said otherwise,
other columns than those of documents are dropped, and an empty table gives an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidebin.llm import linededup, mixing, packing, setjoin, toxicity
from tidebin.llm.common import Written, read


def _as_documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from all labels outside the held-out fold. A text without words scores the
    model's bias, which is low; repeated rows go or stay together."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.below(_as_documents(docs), model, 0.5)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the lines that many other documents hold too; null texts become empty, n_chars follows the text. Rows of
    one doc_id count as one document, and so do those of none."""
    return _as_documents(linededup.dedup_lines(_as_documents(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar to 0.8 or more, exactly one row stays: that of the smallest doc_id, a
    null one last. SimHash's trie join finds the first links; those beyond its reach come from a set join, so that none is missed.
    All texts without words are one group."""
    return setjoin.keep_one(_as_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; small sources are repeated, twice at most. A null source is one of its own."""
    return _as_documents(mixing.mix(_as_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 ids, without the ids. A text without words is its closing id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # neither a trained model nor a tokenizer can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), f"stage-{name}").df()
    return STAGES[-1][1](spark, docs, sf_dir)
