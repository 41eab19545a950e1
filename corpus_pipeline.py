"""Corpus preparation in five stages, each on all that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame.  All but the last return the columns of ``documents``.  ``run`` writes each
stage's rows to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decision_list, simhash, substring, winnowing
from graphloom.llm.shared import bound_batches, new_path, read_table

#: Words of the shortest hit that is cut out of a document.
SHORTEST_LEAK = 3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = decision_list.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return decision_list.judged(docs, rules).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: that of the smallest id (null last).

    Of rows of the group that repeat this id, or of a group without any id, it is the one
    whose text has the smallest digest.
    """
    bound_batches(spark)
    return simhash.representatives(docs).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; documents of which nothing is left go.

    All else of a text stays as it is, line breaks and spacing too; texts without a repeat, and
    null texts, are not touched.
    """
    bound_batches(spark)
    out = substring.remove_repeats(docs, keep=["lang", "source", "n_chars"])
    count = F.when(F.col("n_removed") > 0, F.length("cut_text").cast("long")).otherwise(F.col("n_chars"))
    return out.where("n_removed < n_words or n_words = 0").select("doc_id", F.col("cut_text").alias("text"), "lang", "source", count.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of two or more benchmark items go; of others with a hit the hit words are cut out.

    Hits of one or two words, from items as short as that, stay: ordinary text holds them by chance.
    """
    found = winnowing.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), cut=True, shortest_cut=SHORTEST_LEAK)
    long = F.exists("hit_spans", lambda s: s.end - s.begin >= SHORTEST_LEAK)
    count = F.when(long, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(F.size("item_ids") < 2).withColumn("n_chars", count).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    bound_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The learned rules and the tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
