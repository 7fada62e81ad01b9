"""Evaluation of predicted edges and lists against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_scores(predicted: DataFrame, gold: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and F-beta over (src, dst); an empty denominator gives 1."""
    both = predicted.select("src", "dst").distinct().withColumn("p", F.lit(1)).join(gold.select("src", "dst").distinct().withColumn("g", F.lit(1)), ["src", "dst"], "full")
    n = both.agg(F.count_if((F.col("p") == 1) & (F.col("g") == 1)).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    below = beta * beta * F.col("precision") + F.col("recall")
    return n.withColumn("fbeta", F.round(F.when(below > 0, (1 + beta * beta) * F.col("precision") * F.col("recall") / below).otherwise(0.0), 6)).select(
        "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "fbeta"
    )


def recall_set(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(question, recall): share of a question's expected words that its found text holds."""
    hits = expected.join(found, "question", "left").withColumn("hit", F.coalesce(F.col("text").contains(F.col("word")), F.lit(False)))
    return hits.groupBy("question").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))
