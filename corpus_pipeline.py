"""A training-data pipeline: classify, deduplicate, cut repeats, mix and pack.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last
return the columns of documents; the last one returns the pieces of packed sequences.
Rows with null ids or texts pass as their operators define; a document without words
counts nothing in the mix and is not copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import Work, table
from meridian.llm.mixing import mix_sources
from meridian.llm.near_dedup import near_duplicates
from meridian.llm.packing import pack_documents
from meridian.llm.quality_classifier import classify, held_out
from meridian.llm.queries import tokenizer_path
from meridian.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below one half."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return classify(docs, labels).where("predicted = 1").select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest id stays."""
    kept = near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that an earlier document holds."""
    cut = remove_repeats(docs)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until sources have their target weights."""
    chosen = mix_sources(docs, carry=COLUMNS).where("copies > 0 and size > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises the texts and packs them into sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing_sources", mix),
    ("packing", pack),
]

#: Neither a trained classifier nor a tokenizer can be put in SQL; the tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
