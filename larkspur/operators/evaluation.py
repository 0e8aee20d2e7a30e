"""Ranking quality, paired tests, utility of lateral results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.search import rounded


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg, mrr, recall) at k of ranked (qid, id, rank) by qrels (qid, id, grade); relevant is grade 1 or more.

    The ideal order is cut at the number of results, so that short lists aren't punished.
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    judged = ranked.where(F.col("rank") <= k).join(qrels, ["qid", "id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    found = judged.groupBy("qid").agg(F.sum(gain(F.col("g"), F.col("rank"))).alias("dcg"), F.max(F.when(F.col("g") >= 1, 1.0 / F.col("rank"))).alias("first"), F.count_if(F.col("g") >= 1).alias("hits"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))
    ideal = qrels.withColumn("r", place).join(found.select("qid", "n"), "qid").groupBy("qid").agg(F.sum(F.when(F.col("r") <= F.col("n"), gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") >= 1).alias("relevant"))
    j = found.join(ideal, "qid", "left")
    return j.select(
        "qid",
        rounded(F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        rounded(F.coalesce("first", F.lit(0.0))).alias("mrr"),
        rounded(F.when(F.coalesce("relevant", F.lit(0)) == 0, 0.0).otherwise(F.col("hits") / F.col("relevant"))).alias("recall"),
    )


def paired_tests(df: DataFrame, before: str, after: str) -> DataFrame:
    """(n, mean, cohens_d, t, p): paired differences; p by the normal curve."""
    d = F.col(after) - F.col(before)
    s = df.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("s"))
    t = F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col("mean") / (F.col("s") / F.sqrt("n")))
    # an approximation of the normal curve's tail by Abramowitz and Stegun, 26.2.17
    x = F.abs(t)
    u = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))
    return s.select("n", "mean", F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col("mean") / F.col("s")).alias("cohens_d"), t.alias("t"), F.when(F.col("s") == 0, F.lit(1.0)).otherwise(2 * tail).alias("p"))


def lateral_utility(counts: DataFrame, by: str) -> DataFrame:
    """(utility, success, creative, advice) from counts (shown, used, liked)."""
    utility = F.col("used") / F.col("shown")
    success = F.when(F.col("used") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("liked") / F.greatest(F.col("used"), F.lit(1))))
    advice = F.when(utility < 0.05, "DISABLE").when(utility < 0.1, "TIGHTEN").otherwise("KEEP")
    return counts.select(by, F.round(utility, 6).alias("utility"), F.round(success, 6).alias("success"), F.round((1 - utility) * success, 6).alias("creative"), advice.alias("advice"))
