"""From raw documents to packed training sequences: five stages, each one of the text operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tetrad.llm.common import checkpointed, read
from tetrad.llm.fertility import keep_documents
from tetrad.llm.minhash import drop_near_duplicates
from tetrad.llm.packing import pack_documents
from tetrad.llm.queries import vocabulary
from tetrad.llm.repeats import cut_repeats
from tetrad.llm.toxicity import drop_toxic, train_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 with the model of the labelled documents; null texts stay."""
    return drop_toxic(docs, train_model(docs, read(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and lie in their script's fertility band; texts under 20 words fail."""
    return keep_documents(docs, vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that also start earlier."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths up to 2048 tokens, each a sequence."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", suffix_repeats), ("packing", packing)]

#: Vocabularies, a learned model and a graph's closure are outside SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a checkpoint after each but the last."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
