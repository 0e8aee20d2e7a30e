"""Scalar rules of memory records: decay, arousal, activation, tags, flags, importance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000
DAY, WEEK, MONTH, YEAR = 24 * HOUR, 168 * HOUR, 720 * HOUR, 8760 * HOUR
#: Upper ends of the age buckets; what is older falls into the last one.
BUCKET_ENDS = (HOUR, 6 * HOUR, DAY, 3 * DAY, WEEK, 4 * WEEK, 3 * MONTH, 6 * MONTH, YEAR, 2 * YEAR, 5 * YEAR)
LAST_BUCKET = len(BUCKET_ENDS)
#: A middle age of each bucket: hours within the first day, then days.
_MID_HOURS = (0.5, 3.5, 15.0, *(24 * days for days in (2, 5, 17.5, 60, 135, 270, 547.5, 1277.5, 2555)))
#: Presets: (exponent, floor).
DECAY_PRESETS = {"default": (0.15, 0.10), "slow": (0.08, 0.15), "fast": (0.30, 0.05)}
AROUSAL = (1.0, 1.15, 1.35, 1.65)


def decay_table(exponent: float = 0.15, floor: float = 0.10) -> list[float]:
    """Retention of each bucket: a power law of its middle age, relative to the first."""
    return [max(floor, (mid / _MID_HOURS[0]) ** -exponent) for mid in _MID_HOURS]


def age_bucket(ts_ms: Column, now_ms: int | Column) -> Column:
    age = F.lit(now_ms) - ts_ms if isinstance(now_ms, int) else now_ms - ts_ms
    result = F.lit(LAST_BUCKET)
    for i in reversed(range(LAST_BUCKET)):
        result = F.when(age < BUCKET_ENDS[i], F.lit(i)).otherwise(result)
    return result


def reconsolidated(bucket: Column, recalls: Column) -> Column:
    """Explicit recalls halve the bucket, five times at most (a variable right shift)."""
    return F.floor(bucket / F.pow(F.lit(2.0), F.least(recalls, F.lit(5)))).cast("int")


def auto_recalled(bucket: Column, recalls: Column) -> Column:
    return F.greatest(F.lit(0), bucket - F.least(F.floor(recalls / 3).cast("int"), F.lit(2)))


def decay(bucket: Column, table: list[float]) -> Column:
    return F.element_at(F.lit(table), F.least(bucket, F.lit(LAST_BUCKET)) + 1)


def arousal_modifier(arousal: Column) -> Column:
    """arousal: 0 to 255."""
    return F.element_at(F.lit(list(AROUSAL)), F.least(F.lit(3), F.floor(arousal / 64).cast("int")) + 1)


def activation(recall_ages: Column, created_bucket: Column, table: list[float]) -> Column:
    """Base-level activation s/(s+1) over recalls' buckets and the creation's; -1 without recalls."""
    s = F.aggregate(recall_ages, F.lit(0.0), lambda a, b: a + decay(b, table)) + decay(created_bucket, table)
    return F.when(F.size(recall_ages) == 0, F.lit(-1.0)).otherwise(s / (s + 1))


def habituation(times: Column, rate: float = 0.2) -> Column:
    return 1.0 / (1.0 + (times - 1) * F.lit(rate))


def inhibition(age_ms: Column, ttl_ms: int = 300_000, floor: float = 0.1) -> Column:
    """Inhibition of return: from the floor back to 1 within the time to live."""
    return F.when(age_ms < ttl_ms, F.lit(floor) + F.lit(1 - floor) * age_ms / ttl_ms).otherwise(F.lit(1.0))


def overlap_ratio(record: Column, query: Column) -> Column:
    """Share of the query's tag bits that the record has; 1 for an empty query."""
    return F.when(query == 0, F.lit(1.0)).otherwise(F.bit_count(record.bitwiseAND(query)) / F.bit_count(query))


def blend_valence(old: Column, new: Column) -> Column:
    """0.7 old + 0.3 new, rounded half up, kept to a signed byte."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(old * F.lit(0.7) + new * F.lit(0.3) + 0.5).cast("int")))


def derived_arousal(arousal: Column, valence: Column) -> Column:
    return F.coalesce(arousal, F.least(F.lit(255), F.abs(valence) * 2))


def pack_flags(tombstoned: Column, kind: Column, consolidated: Column, pinned: Column, resolved: Column, modality: Column) -> Column:
    bit = lambda c, n: F.shiftleft(c.cast("int"), n)
    return bit(tombstoned, 0) + bit(kind, 1) + bit(consolidated, 3) + bit(pinned, 4) + bit(resolved, 5) + bit(modality, 6)


def flag(flags: Column, place: int, width: int = 1) -> Column:
    return F.shiftright(flags, place).bitwiseAND((1 << width) - 1)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def novelty_importance(z: Column, samples: Column) -> Column:
    """Importance from surprise; 1 while fewer than 20 samples are known."""
    return F.when(samples < 20, F.lit(1.0)).otherwise(0.05 + 9.95 * sigmoid(1.2 * (z - 1)))


def icnu_importance(interest: Column, challenge: Column, novelty: Column, urgency: Column, weights=(0.30, 0.10, 0.40, 0.20), steepness: float = 8.0, threshold: float = 0.2) -> Column:
    """Interest gated by novelty, challenge and urgency; a sigmoid, or linear without steepness."""
    wi, wc, _, wu = weights
    stimulus = wi * interest * novelty + wc * challenge + wu * urgency
    if steepness <= 0:
        return 0.05 + 9.95 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), stimulus))
    return 0.05 + 9.95 * sigmoid(steepness * (stimulus - threshold))


def flashbulb(z: Column, importance: Column, threshold: float = 3.0) -> tuple[Column, Column]:
    """(importance, pinned): what surprises very much is kept for good."""
    hit = z > threshold
    return F.when(hit, F.lit(10.0)).otherwise(importance), hit


def normal_cdf_p(t: float) -> float:
    return 0.5 * (1 + math.erf(t / math.sqrt(2)))
