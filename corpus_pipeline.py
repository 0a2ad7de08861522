"""Corpus preparation as a chain of the training-data operators.

Each stage takes the rows that its predecessor kept and decides on them all;
``run`` writes every stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import mixing, packing, simhash, substring_dedup, toxicity
from loomspan.llm.common import held_out, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labels of rows that aren't held out, doesn't reject.

    Each row is judged by its own text; null and empty texts stay.
    """
    grammar, weights = toxicity.train(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, grammar, weights, COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, or without any id the first.

    Rows are told apart by their place, so of two texts under one id both stay
    unless they are near copies; of a repeated row one stays.
    """
    first = simhash.without_near_duplicates(docs, keep=["lang", "source", "n_chars"])
    return first.withColumnRenamed("id", "doc_id").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; those that are all repeats go.

    Rows without words stay, null texts as empty ones.
    """
    found = substring_dedup.dedup_substrings(docs, keep=["lang", "source"])
    left = found.where("n_removed = 0 OR n_removed < n_words").withColumn("n_chars", F.char_length("text").cast("long"))
    return left.withColumnRenamed("id", "doc_id").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them.

    Every row is dealt on its own, whatever its id; rows without words are
    never taken.
    """
    keyed = staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("mix_key")))
    mixed = mixing.mixed_rows(keyed, mixing.mix(keyed, id_col="mix_key"), id_col="mix_key")
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences.

    ``ids`` holds the ids, little-endian and 32 bits each; pieces of one ``row``
    come from one row of the mix, which may take a document more than once.
    """
    return packing.pack_documents(docs, keep_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores, draws and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
