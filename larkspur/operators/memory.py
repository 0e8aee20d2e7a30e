"""Memory records: current state, ranking, importance, explanations.

The state is an append-only event table folded to records; ranking is one column expression, so a recall
is filter, score, top k. `now_ms` is always a parameter.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import memory as M
from larkspur.functions import vectors as V
from larkspur.operators.search import bounded, rounded, small, top_k

TIERS = ("WORKING", "EPISODIC", "SEMANTIC", "PROCEDURAL")


@dataclass(frozen=True)
class RecallOptions:
    """What a recall asks for; defaults rank by similarity, importance and age over all live records."""

    top_k: int = 10
    alpha: float = 0.6
    beta: float = 0.4
    gamma: float = 0.3  # carried by profiles; rank fusion doesn't weigh
    min_valence: int = -128
    max_valence: int = 127
    min_importance: float = 0.0
    min_ts: int | None = None
    max_ts: int | None = None
    tag_mask: int = 0
    hyperfocus_mask: int = 0
    hyperfocus_boost: float = 1.0
    tag_boost: float = 0.3
    strictness: float = 1.0
    query_valence: int = 0
    valence_alignment: bool = False
    tiers: tuple[int, ...] | None = None
    lateral: bool = False
    similarity_only: bool = False
    graph_threshold: float = 0.40
    decay: str = "default"
    fuse: str = "rrf"


_P = dict
PROFILES: dict[str, dict] = {
    "BALANCED": _P(alpha=0.6, beta=0.4, gamma=0.3),
    "EXPLORING": _P(alpha=0.8, beta=0.2, gamma=0.1),
    "DEBUGGING": _P(alpha=0.3, beta=0.7, gamma=0.5, max_valence=-10, graph_threshold=0.20),
    "RECALLING": _P(alpha=0.4, beta=0.6, gamma=0.3, min_valence=10),
    "CRITICAL": _P(alpha=0.2, beta=0.8, gamma=0.4, graph_threshold=0.20),
    "HYPERFOCUS": _P(alpha=1.0, beta=0.0, gamma=0.2, hyperfocus_boost=1.5, graph_threshold=0.0),
    "SYSTEMATIZER": _P(alpha=0.3, beta=0.7, gamma=0.3, strictness=10.0, graph_threshold=0.30),
    "DIVERGENT": _P(alpha=0.8, beta=0.2, gamma=0.2, lateral=True, graph_threshold=0.80),
    "PARANOID_SENTINEL": _P(alpha=0.2, beta=0.8, gamma=0.5, max_valence=-1, query_valence=-128, valence_alignment=True, graph_threshold=0.20),
    "THE_EXECUTOR": _P(alpha=0.3, beta=0.7, gamma=0.4, strictness=10.0, graph_threshold=0.20),
    "HIGHLY_SENSITIVE": _P(alpha=0.7, beta=0.3, gamma=0.3, min_importance=0.01),
    "DEFAULT_MODE_NETWORK": _P(alpha=0.2, beta=0.8, gamma=0.1, tiers=(2, 3)),
}
#: First fitting profile wins.
_KEYWORDS = (
    ("CRITICAL", "data-loss outage production security urgent critical"),
    ("DEBUGGING", "broken crash timeout exception fail fix bug error"),
    ("RECALLING", "template pattern best-practice working success solution resolved"),
)


def profile(name: str, **changes) -> RecallOptions:
    return replace(RecallOptions(**PROFILES[name]), **changes)


def detect_profile(tags: Column) -> Column:
    """Name of the profile that an array of tags suggests."""
    result = F.lit("BALANCED")
    for name, words in reversed(_KEYWORDS):
        result = F.when(F.exists(tags, lambda t: F.rlike(F.lower(t), F.lit(words.replace(" ", "|")))), F.lit(name)).otherwise(result)
    return result


# --- gates -------------------------------------------------------------------------------------------


def gates(o: RecallOptions, now_ms: int) -> Column:
    """All filters on plain columns; they stand below any vector arithmetic."""
    c = ~F.col("tombstoned") & F.col("valence").between(o.min_valence, o.max_valence) & (F.col("importance") >= o.min_importance)
    if o.min_ts is not None:
        c = c & (F.col("ts_ms") >= o.min_ts)
    if o.max_ts is not None:
        c = c & (F.col("ts_ms") <= o.max_ts)
    if o.hyperfocus_mask:
        c = c & (F.col("mask").bitwiseAND(o.hyperfocus_mask) == o.hyperfocus_mask)
    elif o.tag_mask:
        c = c & (F.col("mask").bitwiseAND(o.tag_mask) != 0)
    if o.tiers is not None:
        c = c & F.col("tier").isin(*o.tiers)
    forgotten = (decay_bucket(now_ms) == M.LAST_BUCKET) & (F.col("importance") < 1) & ~F.col("pinned") & F.col("resolved")
    return c & ~forgotten


def decay_bucket(now_ms: int) -> Column:
    """Bucket after recalls; unresolved records that aren't pinned stay fresh."""
    bucket = M.auto_recalled(M.reconsolidated(M.age_bucket(F.col("ts_ms"), now_ms), F.col("recalls")), F.col("auto_recalls"))
    return F.when(~F.col("resolved") & ~F.col("pinned"), F.lit(0)).otherwise(bucket)


# --- scores ------------------------------------------------------------------------------------------


def similarity(o: RecallOptions) -> Column:
    return 1.0 / (1.0 + V.distance(F.col("embedding"), F.col("vector")) * o.strictness)


def scan_score(o: RecallOptions, now_ms: int) -> Column:
    """Fused score of the scanned tiers; the mixing weight alpha has no part in it."""
    sim = similarity(o)
    if o.similarity_only:
        return sim
    table = M.decay_table(*M.DECAY_PRESETS[o.decay])
    kept = F.lit(1.0) if o.hyperfocus_mask else M.decay(decay_bucket(now_ms), table)
    retention = F.least(F.lit(1.0), kept * M.arousal_modifier(F.col("arousal")))
    score = sim * (1 + o.beta * F.col("importance") / 10 * retention * F.pow(F.col("strength"), F.lit(0.3)))
    if o.valence_alignment:
        score = score * (1 - F.abs(F.lit(o.query_valence) - F.col("valence")) / 255)
    score = score * (1 + M.overlap_ratio(F.col("mask"), F.lit(o.tag_mask)) * o.tag_boost)
    return score * o.hyperfocus_boost if o.hyperfocus_mask else score


def semantic_score(o: RecallOptions, now_ms: int) -> Column:
    """Score of the indexed tier: weighted sum, neither gated by resolution nor by focus."""
    table = M.decay_table(*M.DECAY_PRESETS[o.decay])
    bucket = M.reconsolidated(M.age_bucket(F.col("ts_ms"), now_ms), F.col("recalls"))
    return (o.alpha * similarity(o) + o.beta * F.col("importance") * M.decay(bucket, table)) * (1 + M.overlap_ratio(F.col("mask"), F.lit(o.tag_mask)) * o.tag_boost)


def lateral_score(o: RecallOptions, now_ms: int) -> tuple[Column, Column]:
    """(applies, score) of records that are far away but share tags."""
    l2 = V.distance(F.col("embedding"), F.col("vector"))
    overlap = M.overlap_ratio(F.col("mask"), F.lit(o.tag_mask))
    table = M.decay_table(*M.DECAY_PRESETS[o.decay])
    shape = F.greatest(F.lit(0.0), 1 - 0.25 * F.pow(l2 * l2 - 2, F.lit(2.0)))
    return (l2 > 1.2) & (overlap >= 0.5), shape * overlap * (1 + F.col("importance") / 10 * M.decay(decay_bucket(now_ms), table))


def recall(memories: DataFrame, queries: DataFrame, o: RecallOptions, now_ms: int, suppressed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, similarity, aside, rank): queries (qid, vector) against all records that pass the gates."""
    live = memories.where(gates(o, now_ms))
    if suppressed is not None:
        live = live.join(suppressed.select("id"), "id", "left_anti")
    scored = live.crossJoin(bounded(queries)).select("qid", "id", rounded(scan_score(o, now_ms)).alias("score"), rounded(similarity(o)).alias("similarity"), *([c.alias(n) for c, n in zip(lateral_score(o, now_ms), ("far", "lateral_score"))] if o.lateral else []))
    if not o.lateral:
        return top_k(scored.withColumn("aside", F.lit(False)), o.top_k, F.desc("score"), F.asc("id"))
    direct = top_k(scored.where(~F.col("far")).select("qid", "id", "score", "similarity", F.lit(False).alias("aside")), o.top_k, F.desc("score"), F.asc("id"))
    aside = top_k(scored.where("far and lateral_score > 0").select("qid", "id", rounded(F.col("lateral_score")).alias("score"), "similarity", F.lit(True).alias("aside")), max(1, o.top_k // 3), F.desc("score"), F.asc("id"))
    return top_k(direct.drop("rank").unionByName(aside.drop("rank")), o.top_k, F.desc("score"), F.asc("id"))


def notify(hits: DataFrame, listeners: list[Callable[[DataFrame], None]]) -> DataFrame:
    """Hand the hits of a recall to listeners, one after the other; a listener's failure doesn't concern the others."""
    for listener in listeners:
        try:
            listener(hits)
        except Exception as e:  # a hook must not break the recall
            warnings.warn(f"recall listener failed: {e}", stacklevel=2)
    return hits


def breakdown(memories: DataFrame, queries: DataFrame, o: RecallOptions, now_ms: int) -> DataFrame:
    """Parts of every recalled record's score."""
    hits = recall(memories, queries, o, now_ms)
    table = M.decay_table(*M.DECAY_PRESETS[o.decay])
    joined = memories.join(small(hits.select("qid", "id", "score", "rank")), "id").join(small(queries), "qid")
    kept = M.decay(decay_bucket(now_ms), table)
    return joined.select(
        "qid",
        "id",
        "rank",
        rounded(similarity(o)).alias("similarity"),
        rounded(F.col("importance") * kept).alias("importance_decay"),
        rounded(M.overlap_ratio(F.col("mask"), F.lit(o.tag_mask)) * o.tag_boost).alias("tag_boost"),
        F.col("score").alias("final"),
    )


def penalties(hits: DataFrame, now_ms: int) -> DataFrame:
    """Hits (id, score, times, last_ms, recent) with habituation, inhibition of return and satiation."""
    least = F.least(M.habituation(F.greatest(F.col("times"), F.lit(1))), M.inhibition(F.lit(now_ms) - F.col("last_ms")))
    penalty = F.when(F.col("recent"), least * 0.5).otherwise(least)
    # twelve digits: products of short decimals would lie on the border of six
    return hits.withColumn("penalty", F.round(penalty, 12)).withColumn("penalized", F.round(F.col("score") * penalty, 12))


def confidence_band(hits: DataFrame) -> DataFrame:
    """(qid, band) from the first two scores of each query; hits have ranks."""
    two = hits.where("rank <= 2").groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("two"))
    ratio = F.col("one") / F.col("two")
    single = F.when(F.col("one") > 0.1, "HIGH").otherwise("MEDIUM")
    several = F.when((F.col("two") <= 0) | (ratio >= 2), "HIGH").when(ratio >= 1.2, "MEDIUM").otherwise("LOW")
    return two.select("qid", F.when(F.col("two").isNull(), single).otherwise(several).alias("band"))


def why_not(asked: DataFrame, memories: DataFrame, suppressed: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(id, reason) for asked ids; ranked holds the first max(k, 20) recalled ids with ranks."""
    flags = memories.select("id", "tombstoned")
    joined = asked.join(flags, "id", "left").join(suppressed.select("id", F.lit(True).alias("hushed")), "id", "left").join(small(ranked.where(F.col("rank") <= max(k, 20)).select("id", "rank")), "id", "left")
    reason = (
        F.when(F.col("tombstoned").isNull(), "NOT_FOUND")
        .when(F.col("tombstoned"), "TOMBSTONED")
        .when(F.col("hushed"), "SUPPRESSED")
        .when(F.col("rank") <= k, "RETURNED")
        .when(F.col("rank").isNotNull(), "OUTRANKED")
        .otherwise("FILTERED")
    )
    return joined.select("id", reason.alias("reason"))


def text_fusion(vector_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """Vector and keyword hits (qid, id, rank) fused by rank; the fused score replaces both."""
    from larkspur.operators.search import rrf

    return rrf(vector_hits.select("qid", "id", "rank").unionByName(text_hits.select("qid", "id", "rank")), k)


# --- importance --------------------------------------------------------------------------------------


def surprise(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Running z-score of `value` within `by`: population deviation of all rows so far, 0 without spread."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean, spread, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count("*").over(w)
    z = F.when((n < 2) | (spread < 1e-9), F.lit(0.0)).otherwise((F.col(value) - mean) / spread)
    return df.withColumns({"n": n, "z": z})


def introspect(hits: DataFrame, now_ms: int, by: str = "qid") -> DataFrame:
    """Averages, confidence, staleness and recalls a day of each query's hits."""
    age = (F.lit(now_ms) - F.col("ts_ms")) / float(M.DAY)
    s = hits.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("importance").alias("i"), F.avg("valence").alias("v"), F.avg(age).alias("a"), F.avg("recalls").alias("r"), F.avg((F.col("recalls") > 0).cast("double")).alias("f")
    )
    confidence = 0.4 * F.least(F.lit(1.0), F.col("n") / 20) + 0.3 * F.col("f") + 0.3 * F.least(F.lit(1.0), F.col("i") / 5)
    stale = F.when(F.col("a") < 1, 0.0).when(F.col("a") < 7, 0.2).when(F.col("a") < 30, 0.5).when(F.col("a") < 90, 0.7).otherwise(0.9)
    return s.select(
        by,
        F.col("n").alias("count"),
        rounded(F.col("i")).alias("avg_importance"),
        rounded(F.col("v")).alias("avg_valence"),
        rounded(F.col("a")).alias("avg_age_days"),
        rounded(confidence).alias("confidence"),
        stale.cast("double").alias("staleness"),
        rounded(F.when(F.col("a") > 0, F.col("r") / F.col("a")).otherwise(F.col("r"))).alias("recalls_per_day"),
    )


# --- state -------------------------------------------------------------------------------------------


def state_at(events: DataFrame, until_ms: int | None = None, most_seq: int | None = None) -> DataFrame:
    """Fold events (seq, ts_ms, type, id, importance, valence) to records as of a time.

    The last REMEMBER counts unless a FORGET follows; recalls are the REINFORCE events since, valence is
    blended by them in order; SUPPRESS, RESOLVE and PIN are flags that their opposites clear.
    A record's events are folded in one group, which is as large as the history of one record.
    """
    seen = events
    if until_ms is not None:
        seen = seen.where(F.col("ts_ms") <= until_ms)
    if most_seq is not None:
        seen = seen.where(F.col("seq") <= most_seq)
    rows = seen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "ts_ms", "importance", "valence"))).alias("e"))
    last = lambda *kinds: F.coalesce(F.array_max(F.transform(F.filter("e", lambda x: x["type"].isin(*kinds)), lambda x: x["seq"])), F.lit(-1))
    rows = rows.withColumn("born", last("REMEMBER"))
    since = F.filter("e", lambda x: (x["seq"] > F.col("born")) & (x["type"] == "REINFORCE"))
    origin = F.element_at(F.filter("e", lambda x: x["seq"] == F.col("born")), 1)
    live = rows.where((F.col("born") >= 0) & (last("FORGET") < F.col("born")))
    return live.select(
        "id",
        origin["ts_ms"].alias("ts_ms"),
        origin["importance"].alias("importance"),
        F.aggregate(since, origin["valence"].cast("int"), lambda v, x: M.blend_valence(v, x["valence"])).alias("valence"),
        F.size(since).alias("recalls"),
        (last("SUPPRESS") > last("UNSUPPRESS")).alias("suppressed"),
        (last("RESOLVE") > last("UNRESOLVE")).alias("resolved"),
    )


def merge_replicas(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Two replicas' headers (id, ts_ms, mask, importance, recalls, valence, flags) merged without conflict.

    The newer timestamp, all tags, the larger importance and count, the newer valence (the remote one in a
    tie), flags 0, 3 and 4 from either and the rest from the local one.
    """
    a, b = local.alias("a"), remote.alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    l, r = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))  # noqa: E731, E741
    sticky = 0b11001
    both = l("id").isNotNull() & r("id").isNotNull()
    flags = l("flags").bitwiseOR(r("flags").bitwiseAND(sticky))
    pick = lambda x, n: F.when(both, x).otherwise(F.coalesce(l(n), r(n)))
    return j.select(
        F.coalesce(l("id"), r("id")).alias("id"),
        F.greatest(l("ts_ms"), r("ts_ms")).alias("ts_ms"),
        pick(l("mask").bitwiseOR(r("mask")), "mask").alias("mask"),
        F.greatest(l("importance"), r("importance")).alias("importance"),
        F.greatest(l("recalls"), r("recalls")).alias("recalls"),
        pick(F.when(r("ts_ms") >= l("ts_ms"), r("valence")).otherwise(l("valence")), "valence").alias("valence"),
        pick(flags, "flags").alias("flags"),
    )
