"""Upkeep of memory records: pruning, compaction, consolidation, strengthening, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import memory as M
from larkspur.functions import vectors as V
from larkspur.operators.memory import decay_bucket
from larkspur.operators.search import knn, rounded, small, top_k

EPISODIC, SEMANTIC = 1, 2


def prune(memories: DataFrame, now_ms: int, threshold: float = 0.05) -> DataFrame:
    """Tombstones on episodic records whose importance has decayed below the threshold."""
    worth = F.col("importance") * M.decay(M.age_bucket(F.col("ts_ms"), now_ms), M.decay_table())
    return memories.withColumn("tombstoned", F.col("tombstoned") | ((worth < threshold) & ~F.col("pinned") & (F.col("tier") == EPISODIC)))


def compact(memories: DataFrame, ratio: float = 0.30, by: str = "tier") -> DataFrame:
    """Partitions with more than this share of tombstones are rewritten without them."""
    share = memories.groupBy(by).agg(F.avg(F.col("tombstoned").cast("int")).alias("share"))
    return memories.join(small(share), by).where((F.col("share") <= ratio) | ~F.col("tombstoned")).drop("share")


def close_pairs(memories: DataFrame, cluster: str, radius: float, most: int = 20) -> DataFrame:
    """(c, a, b, ts_a, ts_b, distance) of each cluster's `most` important live episodic records within the radius."""
    top = top_k(memories.where((F.col("tier") == EPISODIC) & ~F.col("tombstoned")), most, F.desc("importance"), F.asc("id"), by=cluster)
    side = lambda x: top.select(F.col(cluster).alias("c"), F.col("id").alias(x), F.col("ts_ms").alias(f"ts_{x}"), F.col("embedding").alias(f"e_{x}"), F.col("rank").alias(f"rank_{x}"))
    pairs = side("a").join(side("b"), "c").where("rank_a < rank_b").withColumn("distance", V.distance(F.col("e_a"), F.col("e_b")))
    return pairs.where(F.col("distance") <= radius).select("c", "a", "b", "ts_a", "ts_b", "distance")


def interference(memories: DataFrame, cluster: str, radius: float = 0.12, factor: float = 0.7, most: int = 20) -> DataFrame:
    """Close records of a cluster weaken each other: the older of each pair loses importance.

    Each cluster's `most` important live episodic records take part, which bounds the pairs.
    """
    close = close_pairs(memories, cluster, radius, most)
    older = F.when((F.col("ts_a") < F.col("ts_b")) | ((F.col("ts_a") == F.col("ts_b")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    times = close.select(older.alias("id")).groupBy("id").agg(F.count("*").alias("times"))
    return memories.join(times, "id", "left").withColumn("importance", F.col("importance") * F.pow(F.lit(factor), F.coalesce("times", F.lit(0)))).drop("times")


def consolidate(memories: DataFrame, least: int = 5) -> DataFrame:
    """(centroid, n, mask, best, importance) of clusters with enough records: shared tags, most important record."""
    best = F.max_by("id", F.struct("importance", -F.col("id")))
    return memories.groupBy("centroid").agg(F.count("*").alias("n"), F.bit_and("mask").alias("mask"), best.alias("best"), F.max("importance").alias("importance")).where(F.col("n") >= least)


def promote_clusters(memories: DataFrame, least: int = 5) -> DataFrame:
    """Each cluster's best record becomes semantic; its live episodic records are marked consolidated."""
    live = (F.col("tier") == EPISODIC) & ~F.col("tombstoned")
    groups = consolidate(memories.where(live), least).select("centroid", "best")
    joined = memories.join(small(groups), "centroid", "left")
    return joined.withColumn("consolidated", live & F.col("best").isNotNull()).withColumn("tier", F.when(F.coalesce(F.col("best") == F.col("id"), F.lit(False)), F.lit(SEMANTIC)).otherwise(F.col("tier"))).drop("best")


def best_of(memories: DataFrame, by: str) -> DataFrame:
    return memories.groupBy(by).agg(F.max_by("id", F.struct("importance", -F.col("id"))).alias("best"), F.max("importance").alias("importance"))


def reinforce(memories: DataFrame, valence: Column, now_ms: int) -> DataFrame:
    """One explicit recall: valence blends, the count grows, strength gains what decay has taken."""
    kept = M.decay(decay_bucket(now_ms), M.decay_table())
    return memories.withColumn("strength", F.least(F.lit(5.0), F.col("strength") + 0.1 * (1 - kept))).withColumn("recalls", F.col("recalls") + 1).withColumn("valence", M.blend_valence(F.col("valence"), valence))


def reinforce_importance(memories: DataFrame, fused: Column, degree: Column) -> DataFrame:
    """Average with a newly fused importance; without hints 5 % for each link, 30 % at most."""
    return memories.withColumn("importance", F.when(fused.isNotNull(), (F.col("importance") + fused) / 2).otherwise(F.col("importance") * (1 + F.least(F.lit(0.3), 0.05 * degree))))


def auto_strengthen(memories: DataFrame, now_ms: int, cooldown_ms: int = 300_000) -> DataFrame:
    """An automatic recall counts once in a cooldown."""
    due = F.lit(now_ms) - F.col("last_auto") >= cooldown_ms
    return memories.withColumn("auto_recalls", F.col("auto_recalls") + due.cast("int")).withColumn("strength", F.when(due, F.least(F.lit(5.0), F.col("strength") + 0.05)).otherwise(F.col("strength")))


def flag_edits(edits: DataFrame) -> DataFrame:
    """(id, suppressed, resolved, forgotten) from edits (id, seq, type): the last of each kind counts."""
    last = lambda *kinds: F.max_by(F.when(F.col("type").isin(*kinds), F.col("type")), F.when(F.col("type").isin(*kinds), F.col("seq")))
    return edits.groupBy("id").agg(
        F.coalesce(last("SUPPRESS", "UNSUPPRESS") == "SUPPRESS", F.lit(False)).alias("suppressed"),
        F.coalesce(last("RESOLVE", "UNRESOLVE") == "RESOLVE", F.lit(False)).alias("resolved"),
        (F.count_if(F.col("type") == "FORGET") > 0).alias("forgotten"),
    )


def bulk_decay(memories: DataFrame, older_than_ms: int, factor: float) -> DataFrame:
    old = (F.col("tier") == EPISODIC) & (F.col("ts_ms") < older_than_ms)
    return memories.withColumn("importance", F.when(old, F.col("importance") * factor).otherwise(F.col("importance")))


def semantic_duplicates(new: DataFrame, stored: DataFrame, radius: float = 0.05) -> DataFrame:
    """(new_id, id, distance): the nearest other stored record of each new one within the radius; new records are
    searched in blocks of bounded size."""
    found = knn(stored.select("id", "embedding"), new.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), 2, "l2")
    near = found.where(F.col("id") != F.col("qid")).select(F.col("qid").alias("new_id"), "id", F.col("score").alias("distance"))
    return top_k(near.where(F.col("distance") <= radius), 1, F.asc("distance"), F.asc("id"), by="new_id").drop("rank")


def quota_check(rows: DataFrame, limit: int, soft: float = 0.7) -> DataFrame:
    n = F.col("n")
    counted = rows.groupBy("namespace").agg(F.count("*").alias("n"))
    return counted.withColumn("status", F.when(n > limit, "EXCEEDED").when(n > F.lit(int(limit * soft)), "WARNING").otherwise("OK"))


def reflect(memories: DataFrame, now_ms: int) -> DataFrame:
    """One cycle of upkeep: prune, compact, consolidate, interfere."""
    kept = compact(prune(memories, now_ms), 0.30)
    return interference(promote_clusters(kept), "centroid")

