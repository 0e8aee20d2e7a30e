"""Tables that several queries derive in the same way, and the same derivations for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import memory as M
from larkspur.functions import text as T

#: 2024-02-15, a fixed "now": after the last event.
NOW = 1_707_955_200_000
KINDS = ("click", "error", "purchase", "signup", "view")
VALENCES = {"error": -60, "view": 0, "click": 10, "signup": 25, "purchase": 40}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vectors(spark, sf_dir, *ids: int) -> DataFrame:
    """(qid, vector): the embeddings with these ids."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def memories(spark, sf_dir) -> DataFrame:
    """Memory records derived from events; several age buckets, every flag and every tier occur."""
    e = table(spark, sf_dir, "events")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("centroid"))
    n = v.count()
    i = F.col("event_id")
    millis = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    valence = F.lit(0)
    kind = F.lit(0)
    for at, name in enumerate(KINDS):
        valence = F.when(F.col("event_type") == name, F.lit(VALENCES[name])).otherwise(valence)
        kind = F.when(F.col("event_type") == name, F.lit(1 << at)).otherwise(kind)
    k = F.get_json_object("props", "$.k").cast("int")
    decade = F.floor(k / 10).cast("int")
    records = e.select(
        i.alias("id"),
        "user_id",
        "event_type",
        k.alias("k"),
        (millis - (i % 11) * (45 * M.DAY) + F.when(i % 97 == 0, F.lit(90 * M.DAY)).otherwise(F.lit(0))).alias("ts_ms"),
        valence.alias("valence"),
        ((i * 7) % 256).cast("int").alias("arousal"),
        F.least(F.lit(10.0), F.greatest(F.lit(0.05), F.col("value") / 20)).alias("importance"),
        (i % 7).cast("int").alias("recalls"),
        (i % 5).cast("int").alias("auto_recalls"),
        (F.lit(1.0) + (i % 9) * F.lit(0.5)).alias("strength"),
        (kind + F.expr("shiftleft(1, 8)") * F.pow(F.lit(2), decade).cast("int")).cast("long").alias("mask"),
        F.array("event_type", F.concat(F.lit("k"), decade.cast("string"))).alias("tags"),
        (i % 37 == 0).alias("tombstoned"),
        (i % 29 == 0).alias("pinned"),
        (i % 3 == 0).alias("resolved"),
        (i % 4).cast("int").alias("tier"),
        (i % n).alias("vec_id"),
    )
    return records.join(F.broadcast(v) if n <= 100_000 else v, "vec_id").drop("vec_id")


def _case(values: dict[str, object]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


MEM = f"""mem AS MATERIALIZED (
  SELECT event_id AS id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    epoch_us(ts) // 1000 - (event_id % 11) * {45 * M.DAY} + CASE WHEN event_id % 97 = 0 THEN {90 * M.DAY} ELSE 0 END AS ts_ms,
    {_case(VALENCES)} AS valence, CAST((event_id * 7) % 256 AS INTEGER) AS arousal,
    least(CAST(10 AS DOUBLE), greatest(CAST(0.05 AS DOUBLE), value / 20)) AS importance,
    CAST(event_id % 7 AS INTEGER) AS recalls, CAST(event_id % 5 AS INTEGER) AS auto_recalls,
    CAST(1 AS DOUBLE) + (event_id % 9) * CAST(0.5 AS DOUBLE) AS strength,
    CAST({_case({k: 1 << i for i, k in enumerate(KINDS)})} + (1 << (8 + CAST(json_extract_string(props, '$.k') AS INTEGER) // 10)) AS BIGINT) AS mask,
    [event_type, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS VARCHAR)] AS tags,
    event_id % 37 = 0 AS tombstoned, event_id % 29 = 0 AS pinned, event_id % 3 = 0 AS resolved, CAST(event_id % 4 AS INTEGER) AS tier,
    e.embedding AS embedding, e.label AS centroid
  FROM events JOIN embeddings e ON e.vec_id = event_id % (SELECT count(*) FROM embeddings)
)"""


def r6(x: str) -> str:
    """Rounded as the queries round, without a negative zero."""
    return f"(round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def dbl(x: object) -> str:
    return f"CAST({x} AS DOUBLE)"


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def l2_sql(a: str, b: str) -> str:
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def terms_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT list_contains([{stop}], t))"


def bucket_sql(ts: str = "ts_ms", now: object = NOW) -> str:
    whens = " ".join(f"WHEN {now} - {ts} < {end} THEN {i}" for i, end in enumerate(M.BUCKET_ENDS))
    return f"(CASE {whens} ELSE {M.LAST_BUCKET} END)"


def decay_bucket_sql() -> str:
    shifted = f"({bucket_sql()} >> least(recalls, 5))"
    return f"(CASE WHEN NOT resolved AND NOT pinned THEN 0 ELSE greatest(0, {shifted} - least(auto_recalls // 3, 2)) END)"


def decay_sql(bucket: str, preset: str = "default") -> str:
    values = ", ".join(dbl(repr(v)) for v in M.decay_table(*M.DECAY_PRESETS[preset]))
    return f"([{values}])[{bucket} + 1]"


AROUSAL_SQL = "([CAST(1 AS DOUBLE), CAST(1.15 AS DOUBLE), CAST(1.35 AS DOUBLE), CAST(1.65 AS DOUBLE)])[least(3, arousal // 64) + 1]"


def overlap_sql(mask: int) -> str:
    return dbl(1) if mask == 0 else f"(CAST(bit_count(mask & {mask}) AS DOUBLE) / bit_count(CAST({mask} AS BIGINT)))"
