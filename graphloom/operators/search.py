"""Full-text and vector search.

Full text: tokens are runs of letters and digits, lower-cased after the cut.  Scores are
BM25 (k1 1.2, b 0.75), summed over the query's tokens with multiplicity; any token
matches.  With several fields each field is scored on its own and the scores are added.
Only rows that hold a query token are shuffled; counts of the corpus are two aggregates.

Vectors: exact cosine similarity in built-in array functions, best ``k`` by a bounded top-k,
ties by id.  Rows of another length, with nulls or of zero length are skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..storage import staged

K1, B = 1.2, 0.75
_CUT = "[^\\p{IsAlphabetic}\\p{Nd}\\p{Nl}\\p{No}]+"


def tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, _CUT, -1), lambda t: t != ""), lambda t: F.lower(t))


def query_tokens(spark: SparkSession, text: str) -> list[str]:
    """The tokens of a query, cut by the very expression that cuts the texts."""
    return spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]


def _is(word: str):
    return lambda x: x == F.lit(word)


def full_text(rows: DataFrame, key: str, fields: list[str], query: str, scorer: str = "bm25") -> DataFrame:
    """``(key, score)`` of the rows that hold a token of the query."""
    spark = rows.sparkSession
    wanted = Counter(query_tokens(spark, query))
    if not wanted:
        return spark.createDataFrame([], "id bigint, score double").withColumnRenamed("id", key)
    scores = []
    for f in fields:
        present = rows.where(F.col(f).isNotNull()).select(key, tokens(F.col(f)).alias("t"))
        counted = present.select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(wanted)])
        if scorer == "tf":
            part = reduce(lambda a, b: a + b, [F.col(f"f{i}") * n for i, n in enumerate(wanted.values())]).cast("double")
            scores.append(counted.select(key, part.alias("score")).where("score > 0"))
            continue
        counted = staged(counted, "counts")  # a few numbers a row: texts are cut into tokens once
        # One pass for the figures of the corpus: rows, length, and rows that hold each token.
        stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("len"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(wanted))]).first()
        n, mean = stats["n"], (stats["len"] or 0) / max(stats["n"], 1)
        part = F.lit(0.0)
        for i, times in enumerate(wanted.values()):
            df = stats[f"d{i}"] or 0
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            tf = F.col(f"f{i}").cast("double")
            part = part + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
        hit = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(wanted))])
        scores.append(counted.where(hit).select(key, part.alias("score")))
    if len(scores) == 1:
        return scores[0]
    return reduce(DataFrame.union, scores).groupBy(key).agg(F.sum("score").alias("score"))


def nearest(rows: DataFrame, key: str, field: str, k: int, vector: list[float]) -> DataFrame:
    """``(key, score)`` of the ``k`` rows of largest cosine similarity."""
    if not vector or any(x is None for x in vector):
        raise ArgumentError("the query vector has no numbers")
    norm = math.sqrt(sum(float(x) ** 2 for x in vector))
    if norm == 0:
        raise ArgumentError("the query vector has length 0")
    q = F.array(*[F.lit(float(x)) for x in vector])
    v = F.transform(F.col(field), lambda x: x.cast("double"))
    fits = F.col(field).isNotNull() & (F.size(field) == len(vector)) & ~F.exists(F.col(field), lambda x: x.isNull())
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.where(fits).select(key, fold(F.zip_with(v, q, lambda x, y: x * y)).alias("dot"), F.sqrt(fold(F.transform(v, lambda x: x * x))).alias("len"))
    scored = rows.where("len > 0").select(key, (F.col("dot") / (F.col("len") * F.lit(norm))).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)
