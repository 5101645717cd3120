"""A training corpus from `documents`: five stages, each one operator of sievestone.llm.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with all columns; the last gives packed
pieces. Between stages the rows are written as Parquet in the shared folder and read again.

Edge cases: null and empty texts pass toxicity, are scored for quality like any other, form one group of near
duplicates with each other, contain no benchmark item and pack as their end id. Of a group of near duplicates the
document with the smallest doc_id stays (of repeated rows with that id, one); rows with a null doc_id stay only where
nothing else of their group has an id (one of them). Extra columns are carried, whatever their names, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import contamination, packing, quality, simhash, toxicity
from sievestone.llm.common import scratch, ship, table
from sievestone.llm.queries import TOKENIZER, vocabulary_file

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers go on to other stages with what they keep, so they keep less than for packing alone
    return packing.pack(packing.pieces(docs, vocabulary_file(TOKENIZER), cache=100_000))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", one_of_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: Learned scores and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other."""
    docs = table(ship(spark), sf_dir, "documents")
    where = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs
