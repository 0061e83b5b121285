"""The corpus pipeline: language, near-duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, mixing, piece_codec, repeats, simhash
from tickloom.llm.common import table, written
from tickloom.llm.queries import PIECE_BPE, fold


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (und: no text or no letter) go."""
    model = langid.fit(docs, fold() != 0)
    return langid.predict(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select(
        *docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier passage go from the texts; n_chars follows."""
    return repeats.remove_repeats(docs, with_text=True).withColumn(
        "n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, checked by decoding them."""
    return piece_codec.encode_documents(docs, public_tokenizers.path(PIECE_BPE))


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("source_mix", source_mix),
          ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
