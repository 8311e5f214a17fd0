"""A corpus pipeline of five stages over `documents`: each is written and read again as the next one's documents.

Each stage takes any columns beside doc_id, text and source, whatever their names, and gives every column of the documents
that it keeps back unchanged: results stand beside the documents' columns, not among them. Rows that repeat an id, or a
whole row, are rows of their own unless a stage says otherwise; documents without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, exact_dedup, minhash, mixing, pieces, toxicity
from factloom.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels of documents outside its held-out fold.

    Null and empty texts are scored by the bias alone, repeated rows and equal texts each alike; ids may be null.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, payload=docs.columns, as_row=True).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then that of the smallest id.

    Null and blank texts are one group; of rows that share id and text one stays.
    """
    return exact_dedup.exact_groups(docs, payload=docs.columns, as_row=True).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id; null and blank texts link with nothing and
    stay, and so do rows that repeat an id and a text (the stage before leaves one of them)."""
    return minhash.near_groups(docs, payload=docs.columns, as_row=True).filter("kept").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it does not take goes. Rows that share an id are taken equally often;
    a null source is a source, and documents without words stay once where their whole source has none."""
    out, _ = mixing.mix(docs, F.array(F.col("source")), payload=docs.columns, as_row=True)
    return out.select(F.explode(F.expr("array_repeat(row, cast(copies as int))")).alias("row")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `ids` of their pieces and their number `n_pieces`, which replace columns of these names; null and 0
    of a null text, none and 0 of an empty one. Every row is coded, repeated ones too."""
    return pieces.encode(docs).withColumn("n_pieces", F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).cast("long"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: The classifier, min-max hashing, the seeded choice and the segmentation are beyond SQL; tests hold each stage against plain Python, and counts of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; what a stage wrote on its way goes as soon as its result is written."""
    scratch, before = Scratch(spark, "pipeline"), ""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = len(common.LIVE)
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        common.sweep(made)
        if before:
            scratch.drop(before)
        before = name
    return docs
