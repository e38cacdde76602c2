"""Corpus pipeline: documents to shards.

Stages, in order: toxic documents go; one document of each group of near duplicates stays; documents that
leak benchmark items go; sources are interleaved to target weights; the mixed sequence is packed into shards.
Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of docs. Mixing decides the order of the rows: it is
the order of its files' names and of the rows in them, which sharding keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import chosen_path, decontam, pfair_mix, tiered_shards, toxicity_fm
from quarrymill.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold. Null and empty texts get the score of no words; rows that repeat an id are
    judged one by one; an empty table stays empty; without labels every row stays."""
    return toxicity_fm.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates, the one with the smallest id, null last. Null and empty texts are copies of one another;
    of rows equal in id and text one stays; an empty table stays empty."""
    return chosen_path.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item. Null and empty texts hold none; rows that repeat an id are judged one by one;
    an empty table stays empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order that interleaves the sources by their target weights. A null source is one named ''; null ids and repeated rows are
    rows like others; an empty table stays empty."""
    return pfair_mix.in_order(docs)


def pack_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard that holds them and their position in it; columns of these names get _given behind them. Nulls and repeated
    rows are kept as they are; an empty table gives no rows."""
    return tiered_shards.shard(docs, in_order=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", pack_shards),
]

#: Scores of a trained model, minimum hashes and file sizes can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
