"""Queries on memory records: gates, scores, recall, importance, state, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import memory as M
from larkspur.operators import evaluation as E
from larkspur.operators import lifecycle as L
from larkspur.operators import memory as R
from larkspur.operators import search as S
from larkspur.plans.registry import query
from larkspur.plans.tables import AROUSAL_SQL, MEM, NOW, bucket_sql, dbl, decay_bucket_sql, decay_sql, documents, l2_sql, memories, overlap_sql, query_vectors, r6, table

Q2 = "v AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id IN (0, 7))"
CLICK, ERROR = 1, 2


def gates_sql(o: R.RecallOptions) -> str:
    parts = ["NOT tombstoned", f"valence BETWEEN {o.min_valence} AND {o.max_valence}", f"importance >= {o.min_importance}"]
    if o.min_ts is not None:
        parts.append(f"ts_ms >= {o.min_ts}")
    if o.max_ts is not None:
        parts.append(f"ts_ms <= {o.max_ts}")
    if o.hyperfocus_mask:
        parts.append(f"(mask & {o.hyperfocus_mask}) = {o.hyperfocus_mask}")
    elif o.tag_mask:
        parts.append(f"(mask & {o.tag_mask}) <> 0")
    if o.tiers is not None:
        parts.append(f"tier IN ({', '.join(map(str, o.tiers))})")
    parts.append(f"NOT ({decay_bucket_sql()} = 11 AND importance < 1 AND NOT pinned AND resolved)")
    return " AND ".join(parts)


def sim_sql(o: R.RecallOptions) -> str:
    return f"(1 / (1 + {l2_sql('embedding', 'vector')} * {dbl(o.strictness)}))"


def scan_sql(o: R.RecallOptions) -> str:
    if o.similarity_only:
        return sim_sql(o)
    kept = dbl(1) if o.hyperfocus_mask else decay_sql(decay_bucket_sql(), o.decay)
    x = f"{sim_sql(o)} * (1 + {dbl(o.beta)} * importance / 10 * least({dbl(1)}, {kept} * {AROUSAL_SQL}) * pow(strength, {dbl(0.3)}))"
    if o.valence_alignment:
        x += f" * (1 - abs({o.query_valence} - valence) / {dbl(255)})"
    x += f" * (1 + {overlap_sql(o.tag_mask)} * {dbl(o.tag_boost)})"
    return x + (f" * {dbl(o.hyperfocus_boost)}" if o.hyperfocus_mask else "")


def recall_sql(o: R.RecallOptions, extra: str = "true") -> str:
    """CTEs that end with hits(qid, id, score, similarity, aside, rank)."""
    base = f"{MEM}, {Q2}, live AS (SELECT * FROM mem WHERE {gates_sql(o)} AND {extra})"
    if not o.lateral:
        return f"""{base}, s AS (SELECT qid, id, {r6(scan_sql(o))} AS score, {r6(sim_sql(o))} AS similarity, false AS aside FROM live, v),
        hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= {o.top_k})"""
    l2 = l2_sql("embedding", "vector")
    return f"""{base}, s0 AS (SELECT qid, id, {r6(scan_sql(o))} AS score, {r6(sim_sql(o))} AS similarity, {l2} > 1.2 AND {overlap_sql(o.tag_mask)} >= 0.5 AS far,
       {r6(f"greatest({dbl(0)}, 1 - {dbl(0.25)} * pow({l2} * {l2} - 2, {dbl(2)})) * {overlap_sql(o.tag_mask)} * (1 + importance / 10 * {decay_sql(decay_bucket_sql(), o.decay)})")} AS ls FROM live, v),
      a AS (SELECT qid, id, score, similarity, false AS aside FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s0 WHERE NOT far) WHERE r <= {o.top_k}),
      b AS (SELECT qid, id, ls AS score, similarity, true AS aside FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ls DESC, id) AS r FROM s0 WHERE far AND ls > 0) WHERE r <= {max(1, o.top_k // 3)}),
      hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rank <= {o.top_k})"""


def asked(spark, sf_dir):
    return query_vectors(spark, sf_dir, 0, 7)


def _recall(name: str, o: R.RecallOptions):
    @query(f"WITH {recall_sql(o)} SELECT qid, id, score, similarity, aside, rank FROM hits", name=name)
    def run(spark, sf_dir):
        return R.recall(memories(spark, sf_dir), asked(spark, sf_dir), o, NOW).select("qid", "id", "score", "similarity", "aside", "rank")


_recall("r6_fused_score", R.RecallOptions(top_k=50))
_recall("r8_similarity_only", R.RecallOptions(top_k=20, similarity_only=True))
_recall("r9_lateral", R.RecallOptions(top_k=30, lateral=True, tag_mask=CLICK | ERROR))
_recall("f9_hyperfocus", R.RecallOptions(top_k=20, hyperfocus_mask=ERROR, hyperfocus_boost=1.5))
_recall("f8_tag_gate", R.RecallOptions(top_k=20, tag_mask=CLICK | ERROR))
for _name, _values in R.PROFILES.items():
    _recall(f"r24_profile_{_name.lower()}", R.profile(_name, top_k=15, tag_mask=ERROR, hyperfocus_mask=ERROR if _name == "HYPERFOCUS" else 0))


def _gate(name: str, condition: str, column):
    @query(f"WITH {MEM} SELECT id, tier, valence FROM mem WHERE {condition}", name=name)
    def run(spark, sf_dir):
        return memories(spark, sf_dir).where(column()).select("id", "tier", "valence")


_LOW, _HIGH = NOW - 200 * M.DAY, NOW - 20 * M.DAY
_gate("f6_tombstones", "NOT tombstoned", lambda: ~F.col("tombstoned"))
_gate("f7_time_range", f"ts_ms BETWEEN {_LOW} AND {_HIGH}", lambda: F.col("ts_ms").between(_LOW, _HIGH))
_gate("f10_working_tags", f"tier = 0 AND (mask & {ERROR | 256}) = {ERROR | 256}", lambda: (F.col("tier") == 0) & (F.col("mask").bitwiseAND(ERROR | 256) == (ERROR | 256)))
_gate("f11_valence_range", "valence BETWEEN -60 AND 10", lambda: F.col("valence").between(-60, 10))
_gate("f12_importance_floor", "importance >= 1.5", lambda: F.col("importance") >= 1.5)
_gate("f13_decay_cutoff", f"NOT ({decay_bucket_sql()} = 11 AND importance < 1 AND NOT pinned AND resolved)", lambda: ~((R.decay_bucket(NOW) == M.LAST_BUCKET) & (F.col("importance") < 1) & ~F.col("pinned") & F.col("resolved")))
_gate("f14_tier_filter", "tier IN (1, 2)", lambda: F.col("tier").isin(1, 2))


@query(f"WITH {recall_sql(R.RecallOptions(top_k=20), 'id % 13 <> 0')} SELECT qid, id, score, rank FROM hits")
def f15_suppression(spark, sf_dir):
    m = memories(spark, sf_dir)
    return R.recall(m, asked(spark, sf_dir), R.RecallOptions(top_k=20), NOW, m.where("id % 13 = 0").select("id")).select("qid", "id", "score", "rank")


@query(f"WITH {MEM} SELECT id, event_type FROM mem WHERE NOT tombstoned AND list_has_all(list_transform(tags, lambda t: lower(t)), ['error', 'k3'])")
def f16_browse_by_tags(spark, sf_dir):
    wanted = F.array(F.lit("ERROR"), F.lit("K3"))
    lower = lambda a: F.transform(a, F.lower)
    return memories(spark, sf_dir).where(~F.col("tombstoned") & (F.size(F.array_except(lower(wanted), lower(F.col("tags")))) == 0)).select("id", "event_type")


@query("SELECT doc_id, left(text, 200) AS preview, lang FROM documents WHERE lang IN ('en', 'de')")
def f17_table_projection(spark, sf_dir):
    return documents(spark, sf_dir).where(F.col("lang").isin("en", "de")).select("doc_id", F.substring("text", 1, 200).alias("preview"), "lang")


# --- decay and other scalar rules ----------------------------------------------------------------------


@query(f"WITH {MEM} SELECT id, {bucket_sql()} AS bucket, ({bucket_sql()} >> least(recalls, 5)) AS recalled, {decay_bucket_sql()} AS final, {r6(decay_sql(decay_bucket_sql()))} AS decay, {r6(decay_sql(decay_bucket_sql(), 'slow'))} AS slow, {r6(decay_sql(decay_bucket_sql(), 'fast'))} AS fast, {r6(AROUSAL_SQL)} AS arousal FROM mem")
def r10_decay(spark, sf_dir):
    bucket = M.age_bucket(F.col("ts_ms"), NOW)
    of = lambda p: S.rounded(M.decay(R.decay_bucket(NOW), M.decay_table(*M.DECAY_PRESETS[p])))
    return memories(spark, sf_dir).select("id", bucket.alias("bucket"), M.reconsolidated(bucket, F.col("recalls")).alias("recalled"), R.decay_bucket(NOW).alias("final"), of("default").alias("decay"), of("slow").alias("slow"), of("fast").alias("fast"), S.rounded(M.arousal_modifier(F.col("arousal"))).alias("arousal"))


_AGES = "list_transform(range(0, least(recalls, 3)), lambda i: (i * 2 + recalls) % 12)"
_SUM = f"(coalesce(list_sum(list_transform({_AGES}, lambda b: {decay_sql('b')})), 0) + {decay_sql(bucket_sql())})"


@query(f"WITH {MEM} SELECT id, {r6(f'CASE WHEN recalls = 0 THEN -1 ELSE {_SUM} / ({_SUM} + 1) END')} AS activation FROM mem")
def r15_activation(spark, sf_dir):
    n = F.least(F.col("recalls"), F.lit(3))
    ages = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i * 2 + F.col("recalls")) % 12).cast("int"))).otherwise(F.array().cast("array<int>"))
    return memories(spark, sf_dir).select("id", S.rounded(M.activation(ages, M.age_bucket(F.col("ts_ms"), NOW), M.decay_table())).alias("activation"))


_HAB = f"({dbl(1)} / ({dbl(1)} + (greatest(recalls, 1) - 1) * {dbl(0.2)}))"
_INH = f"(CASE WHEN age < 300000 THEN {dbl(0.1)} + {dbl(0.9)} * age / 300000 ELSE {dbl(1)} END)"


@query(f"WITH {MEM}, h AS (SELECT id, importance AS score, recalls, (id * 7919) % 600000 AS age, id % 10 = 0 AS recent FROM mem), p AS (SELECT id, score, least({_HAB}, {_INH}) * CASE WHEN recent THEN {dbl(0.5)} ELSE {dbl(1)} END AS p FROM h) SELECT id, round(p, 12) AS penalty, round(score * p, 12) AS penalized FROM p")
def r18_penalties(spark, sf_dir):
    hits = memories(spark, sf_dir).select("id", F.col("importance").alias("score"), F.col("recalls").alias("times"), (F.lit(NOW) - (F.col("id") * 7919) % 600000).alias("last_ms"), (F.col("id") % 10 == 0).alias("recent"))
    return R.penalties(hits, NOW).select("id", "penalty", "penalized")


@query(f"WITH {MEM} SELECT id, {r6(_HAB)} AS habituation, {r6(_INH)} AS inhibition FROM (SELECT id, recalls, (id * 7919) % 600000 AS age FROM mem)")
def r16_habituation(spark, sf_dir):
    age = (F.col("id") * 7919) % 600000
    return memories(spark, sf_dir).select("id", S.rounded(M.habituation(F.greatest(F.col("recalls"), F.lit(1)))).alias("habituation"), S.rounded(M.inhibition(age)).alias("inhibition"))


@query(f"WITH {MEM} SELECT id, (mask & 3) <> 0 AS any_match, (mask & 258) = 258 AS all_match, {r6(overlap_sql(258))} AS overlap, CAST(bit_count(mask) AS INTEGER) AS bits, mask | 1 AS merged FROM mem")
def c15_tag_matching(spark, sf_dir):
    m = F.col("mask")
    return memories(spark, sf_dir).select("id", (m.bitwiseAND(3) != 0).alias("any_match"), (m.bitwiseAND(258) == 258).alias("all_match"), S.rounded(M.overlap_ratio(m, F.lit(258))).alias("overlap"), F.bit_count(m).alias("bits"), m.bitwiseOR(F.lit(1)).alias("merged"))


_FLAGS = "(CAST(tombstoned AS INTEGER) + (tier << 1) + (CAST(id % 5 = 0 AS INTEGER) << 3) + (CAST(pinned AS INTEGER) << 4) + (CAST(resolved AS INTEGER) << 5) + (CAST(id % 4 AS INTEGER) << 6))"


@query(f"WITH {MEM} SELECT id, f AS flags, f & 1 AS dead, (f >> 1) & 3 AS kind, (f >> 4) & 1 AS pinned, (f >> 6) & 3 AS modality FROM (SELECT id, {_FLAGS} AS f FROM mem)")
def c16_flags(spark, sf_dir):
    flags = M.pack_flags(F.col("tombstoned"), F.col("tier"), F.col("id") % 5 == 0, F.col("pinned"), F.col("resolved"), F.col("id") % 4)
    return memories(spark, sf_dir).select("id", flags.alias("flags")).select("id", "flags", M.flag(F.col("flags"), 0).alias("dead"), M.flag(F.col("flags"), 1, 2).alias("kind"), M.flag(F.col("flags"), 4).alias("pinned"), M.flag(F.col("flags"), 6, 2).alias("modality"))


@query(f"WITH {MEM}, b AS (SELECT id, greatest(-128, least(127, CAST(floor(valence * {dbl(0.7)} + (k * 3 - 150) * {dbl(0.3)} + {dbl(0.5)}) AS INTEGER))) AS blended, valence, k FROM mem) SELECT id, blended, blended > 10 AS positive, blended < -10 AS negative, coalesce(CASE WHEN k % 2 = 0 THEN k END, least(255, abs(valence) * 2)) AS arousal FROM b")
def c17_valence(spark, sf_dir):
    b = M.blend_valence(F.col("valence"), F.col("k") * 3 - 150)
    return memories(spark, sf_dir).select("id", b.alias("blended"), (b > 10).alias("positive"), (b < -10).alias("negative"), M.derived_arousal(F.when(F.col("k") % 2 == 0, F.col("k")), F.col("valence")).alias("arousal"))


@query(f"WITH {MEM} SELECT id, {r6(f'({NOW} - ts_ms) / {dbl(M.DAY)}')} AS age_days, {r6('pow(strength, 0.3::DOUBLE)')} AS strength, {r6('1 / (1 + exp(-importance))')} AS squashed FROM mem")
def c22_age_and_math(spark, sf_dir):
    return memories(spark, sf_dir).select("id", S.rounded((F.lit(NOW) - F.col("ts_ms")) / float(M.DAY)).alias("age_days"), S.rounded(F.pow("strength", F.lit(0.3))).alias("strength"), S.rounded(M.sigmoid(F.col("importance"))).alias("squashed"))


@query("SELECT event_id AS id, coalesce(json_extract_string(props, '$.modality'), 'TEXT') AS modality, json_extract_string(props, '$.k') AS k FROM events")
def c24_metadata_default(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(F.try_element_at(m, F.lit("modality")), F.lit("TEXT")).alias("modality"), F.element_at(m, "k").alias("k"))


# --- other scores --------------------------------------------------------------------------------------

_SEM = R.RecallOptions(tag_mask=ERROR)


@query(f"WITH {MEM}, {Q2}, s AS (SELECT qid, id, {r6(f'({dbl(_SEM.alpha)} * {sim_sql(_SEM)} + {dbl(_SEM.beta)} * importance * {decay_sql(f"({bucket_sql()} >> least(recalls, 5))")}) * (1 + {overlap_sql(ERROR)} * {dbl(0.3)})')} AS score FROM mem, v WHERE tier = 2 AND NOT tombstoned) SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 20")
def r7_semantic_score(spark, sf_dir):
    scored = memories(spark, sf_dir).where("tier = 2 and not tombstoned").crossJoin(S.small(asked(spark, sf_dir))).select("qid", "id", S.rounded(R.semantic_score(_SEM, NOW)).alias("score"))
    return S.top_k(scored, 20, F.desc("score"), F.asc("id"))


@query(f"WITH {recall_sql(R.RecallOptions(top_k=10, tag_mask=ERROR))} SELECT hits.qid, hits.id, rank, similarity, {r6(f'importance * {decay_sql(decay_bucket_sql())}')} AS importance_decay, {r6(f'{overlap_sql(ERROR)} * {dbl(0.3)}')} AS tag_boost, score AS final FROM hits JOIN mem USING (id)")
def r37_breakdown(spark, sf_dir):
    return R.breakdown(memories(spark, sf_dir), asked(spark, sf_dir), R.RecallOptions(top_k=10, tag_mask=ERROR), NOW)


@query(f"WITH {recall_sql(R.RecallOptions(top_k=5))}, p AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS one, max(CASE WHEN rank = 2 THEN score END) AS two FROM hits GROUP BY qid) SELECT qid, CASE WHEN two IS NULL THEN CASE WHEN one > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END WHEN two <= 0 OR one / two >= 2 THEN 'HIGH' WHEN one / two >= 1.2 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM p")
def r35_confidence_band(spark, sf_dir):
    return R.confidence_band(R.recall(memories(spark, sf_dir), asked(spark, sf_dir), R.RecallOptions(top_k=5), NOW))


_WHY = R.RecallOptions(top_k=20)


@query(f"WITH {recall_sql(_WHY, 'id % 13 <> 0')}, a AS (SELECT unnest(list_concat(range(0, 400), [-5])) AS id), h AS (SELECT id, rank FROM hits WHERE qid = 0) SELECT a.id, CASE WHEN mem.id IS NULL THEN 'NOT_FOUND' WHEN tombstoned THEN 'TOMBSTONED' WHEN a.id % 13 = 0 THEN 'SUPPRESSED' WHEN rank <= 5 THEN 'RETURNED' WHEN rank IS NOT NULL THEN 'OUTRANKED' ELSE 'FILTERED' END AS reason FROM a LEFT JOIN mem USING (id) LEFT JOIN h USING (id)")
def r36_why_not(spark, sf_dir):
    m = memories(spark, sf_dir)
    hushed = m.where("id % 13 = 0").select("id")
    ranked = R.recall(m, asked(spark, sf_dir).where("qid = 0"), _WHY, NOW, hushed)
    ids = spark.range(400).unionByName(spark.createDataFrame([(-5,)], "id long"))
    return R.why_not(ids, m, hushed, ranked, 5)


@query(f"WITH {recall_sql(R.RecallOptions(top_k=40))}, t AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY importance DESC, id) AS INTEGER) AS rank FROM mem, (SELECT qid FROM v) WHERE event_type = 'error'), f AS (SELECT qid, id, round(sum({dbl(1)} / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM hits UNION ALL SELECT qid, id, rank FROM t WHERE rank <= 40) GROUP BY qid, id) SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) WHERE rank <= 20")
def r20_text_fusion(spark, sf_dir):
    m, q = memories(spark, sf_dir), asked(spark, sf_dir)
    near = R.recall(m, q, R.RecallOptions(top_k=40), NOW)
    words = S.top_k(m.where("event_type = 'error'").crossJoin(S.small(q.select("qid"))), 40, F.desc("importance"), F.asc("id"))
    return R.text_fusion(near, words, 20)


# --- importance ----------------------------------------------------------------------------------------


@query(f"WITH w AS (SELECT event_id AS id, count(*) OVER u AS n, avg(value) OVER u AS m, stddev_pop(value) OVER u AS s, value FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), z AS (SELECT id, n, CASE WHEN n < 2 OR s < 1e-9 THEN 0 ELSE (value - m) / s END AS z FROM w) SELECT id, n, round(z, 4) + 0.0::DOUBLE AS z, round(CASE WHEN n < 20 THEN 1 ELSE {dbl(0.05)} + {dbl(9.95)} / (1 + exp(-{dbl(1.2)} * (z - 1))) END, 4) AS importance, z > 3 AS flashbulb FROM z")
def r25_surprise(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "value")
    s = R.surprise(e, "value", ["ts", "id"], ["user_id"])
    z = F.col("z")
    return s.select("id", "n", (F.round(z, 4) + F.lit(0.0)).alias("z"), F.round(M.novelty_importance(z, F.col("n")), 4).alias("importance"), M.flashbulb(z, z)[1].alias("flashbulb"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY user_id")
def a3_mean_and_deviation(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("deviation"))


_SEEN = "lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)"


@query(f"SELECT event_id AS id, (epoch_us(ts) - {_SEEN}) // 1000 AS gap_ms FROM events")
def w6_time_since_tag(spark, sf_dir):
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("u", micros).withColumn("d", F.col("u") - F.lag("u").over(w)).select(F.col("event_id").alias("id"), F.expr("d div 1000").alias("gap_ms"))


@query(f"WITH g AS (SELECT event_id AS id, value, ln(1 + coalesce((epoch_us(ts) - {_SEEN}) // 1000, 0)) AS gap, user_id, ts FROM events), w AS (SELECT id, count(*) OVER u AS n, (value - avg(value) OVER u) AS a, stddev_pop(value) OVER u AS sa, gap - avg(gap) OVER u AS b, stddev_pop(gap) OVER u AS sb FROM g WINDOW u AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)), z AS (SELECT id, n, {dbl(0.6)} * CASE WHEN n < 2 OR sa < 1e-9 THEN 0 ELSE a / sa END + {dbl(0.4)} * CASE WHEN n < 2 OR sb < 1e-9 THEN 0 ELSE b / sb END AS z FROM w) SELECT id, round(CASE WHEN n < 20 THEN 1 ELSE {dbl(0.05)} + {dbl(9.95)} / (1 + exp(-{dbl(1.2)} * (z - 1))) END, 3) AS importance FROM z")
def r26_dual_surprise(spark, sf_dir):
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    w = Window.partitionBy("event_type").orderBy("ts", "id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "ts", "value").withColumn("u", micros)
    e = e.withColumn("d", F.col("u") - F.lag("u").over(w)).withColumn("gap", F.log(1 + F.coalesce(F.expr("d div 1000"), F.lit(0))))
    spatial = R.surprise(e, "value", ["ts", "id"], ["user_id"]).withColumnRenamed("z", "za").drop("n")
    both = R.surprise(spatial, "gap", ["ts", "id"], ["user_id"])
    return both.select("id", F.round(M.novelty_importance(0.6 * F.col("za") + 0.4 * F.col("z"), F.col("n")), 3).alias("importance"))


def icnu_sql(steep: bool) -> str:
    s = f"({dbl(0.3)} * (k / {dbl(100)}) * least({dbl(1)}, importance / 10) + {dbl(0.1)} * (arousal / {dbl(255)}) + {dbl(0.2)} * (recalls / {dbl(7)}))"
    return f"{dbl(0.05)} + {dbl(9.95)} " + (f"/ (1 + exp(-{dbl(8)} * ({s} - {dbl(0.2)})))" if steep else f"* least({dbl(1)}, greatest({dbl(0)}, {s}))")


@query(f"WITH {MEM} SELECT id, {r6(icnu_sql(True))} AS importance, {r6(icnu_sql(False))} AS linear FROM mem")
def r27_icnu_importance(spark, sf_dir):
    args = (F.col("k") / 100, F.col("arousal") / 255, F.least(F.lit(1.0), F.col("importance") / 10), F.col("recalls") / 7)
    return memories(spark, sf_dir).select("id", S.rounded(M.icnu_importance(*args)).alias("importance"), S.rounded(M.icnu_importance(*args, steepness=0)).alias("linear"))


@query(f"WITH {MEM} SELECT id, {r6(f'CASE WHEN z > 3 THEN 10 ELSE greatest({icnu_sql(True)}, CASE WHEN n < 20 THEN 1 ELSE {dbl(0.05)} + {dbl(9.95)} / (1 + exp(-{dbl(1.2)} * (z - 1))) END) END')} AS estimate, z > 3 AS pinned FROM (SELECT *, (importance - 2) / 1.5::DOUBLE AS z, id % 40 AS n FROM mem)")
def r29_importance_estimate(spark, sf_dir):
    m = memories(spark, sf_dir).withColumns({"z": (F.col("importance") - 2) / 1.5, "n": F.col("id") % 40})
    icnu = M.icnu_importance(F.col("k") / 100, F.col("arousal") / 255, F.least(F.lit(1.0), F.col("importance") / 10), F.col("recalls") / 7)
    value, pinned = M.flashbulb(F.col("z"), F.greatest(icnu, M.novelty_importance(F.col("z"), F.col("n"))))
    return m.select("id", S.rounded(value).alias("estimate"), pinned.alias("pinned"))


@query(f"WITH {recall_sql(R.RecallOptions(top_k=25))}, st AS (SELECT qid, count(*) AS n, avg(importance) AS i, avg(valence) AS v, avg(({NOW} - ts_ms) / {dbl(M.DAY)}) AS a, avg(recalls) AS r, avg(CAST(recalls > 0 AS INTEGER)) AS f FROM hits JOIN mem USING (id) GROUP BY qid) SELECT qid, n AS count, {r6('i')} AS avg_importance, {r6('v')} AS avg_valence, {r6('a')} AS avg_age_days, {r6(f'{dbl(0.4)} * least({dbl(1)}, n / {dbl(20)}) + {dbl(0.3)} * f + {dbl(0.3)} * least({dbl(1)}, i / 5)')} AS confidence, CAST(CASE WHEN a < 1 THEN 0 WHEN a < 7 THEN 0.2 WHEN a < 30 THEN 0.5 WHEN a < 90 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS staleness, {r6('CASE WHEN a > 0 THEN r / a ELSE r END')} AS recalls_per_day FROM st")
def a5_introspection(spark, sf_dir):
    m = memories(spark, sf_dir)
    hits = R.recall(m, asked(spark, sf_dir), R.RecallOptions(top_k=25), NOW)
    return R.introspect(m.join(S.small(hits.select("qid", "id")), "id"), NOW)


@query(f"WITH {MEM} SELECT tier, count(*) AS n, CAST(sum(CAST(tombstoned AS INTEGER)) AS BIGINT) AS dead, {r6('avg(CAST(tombstoned AS INTEGER))')} AS ratio, {r6('avg(importance)')} AS importance FROM mem GROUP BY tier")
def a4_tier_counts(spark, sf_dir):
    dead = F.col("tombstoned").cast("int")
    return memories(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.sum(dead).alias("dead"), S.rounded(F.avg(dead)).alias("ratio"), S.rounded(F.avg("importance")).alias("importance"))


# --- evaluation ------------------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT source AS qid, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), qrels AS (SELECT source AS qid, doc_id AS id, quality * (1 + doc_id % 3) AS grade FROM labels JOIN documents USING (doc_id))"


def _ranked(spark, sf_dir):
    d = documents(spark, sf_dir)
    ranked = S.top_k(d, 1_000_000_000, F.desc("n_chars"), F.asc("doc_id"), by="source").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), "rank")
    qrels = table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), (F.col("quality") * (1 + F.col("doc_id") % 3)).alias("grade"))
    return ranked, qrels


@query(f"WITH {_RANKED}, j AS (SELECT r.qid, rank, coalesce(grade, 0) AS g FROM ranked r LEFT JOIN qrels USING (qid, id) WHERE rank <= 10), d AS (SELECT qid, sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg, max(CASE WHEN g >= 1 THEN {dbl(1)} / rank END) AS mrr, sum(CAST(g >= 1 AS INTEGER)) AS hit, count(*) AS n FROM j GROUP BY qid), i AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM qrels), t AS (SELECT i.qid, sum(CASE WHEN r <= n THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg, sum(CAST(grade >= 1 AS INTEGER)) AS rel FROM i JOIN d USING (qid) GROUP BY i.qid) SELECT d.qid, {r6('CASE WHEN coalesce(idcg, 0) = 0 THEN 0 ELSE dcg / idcg END')} AS ndcg, {r6('coalesce(mrr, 0)')} AS mrr, {r6('CASE WHEN coalesce(rel, 0) = 0 THEN 0 ELSE hit / CAST(rel AS DOUBLE) END')} AS recall FROM d LEFT JOIN t USING (qid)")
def a14_ranking_metrics(spark, sf_dir):
    return E.ranking_metrics(*_ranked(spark, sf_dir), 10)


@query(f"WITH p AS (SELECT event_id, value AS a, value * {dbl(1.02)} + (event_id % 7) - 3 AS b FROM events), s AS (SELECT count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) AS s FROM p) SELECT n, {r6('m')} AS mean, {r6('CASE WHEN s = 0 THEN 0 ELSE m / s END')} AS cohens_d, {r6('m / (s / sqrt(n))')} AS t FROM s")
def a15_paired_tests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("a"), (F.col("value") * 1.02 + F.col("event_id") % 7 - 3).alias("b"))
    return E.paired_tests(e, "a", "b").select("n", S.rounded(F.col("mean")).alias("mean"), S.rounded(F.col("cohens_d")).alias("cohens_d"), S.rounded(F.col("t")).alias("t"))


@query("WITH c AS (SELECT user_id, count(*) AS shown, sum(CAST(event_type = 'click' AS INTEGER)) AS used, sum(CAST(event_type = 'purchase' AS INTEGER)) AS liked FROM events GROUP BY user_id) SELECT user_id, round(used / CAST(shown AS DOUBLE), 6) AS utility, round(CASE WHEN used = 0 THEN 0 ELSE least(1, liked / CAST(used AS DOUBLE)) END, 6) AS success, round((1 - used / CAST(shown AS DOUBLE)) * CASE WHEN used = 0 THEN 0 ELSE least(1, liked / CAST(used AS DOUBLE)) END, 6) AS creative, CASE WHEN used / CAST(shown AS DOUBLE) < 0.05 THEN 'DISABLE' WHEN used / CAST(shown AS DOUBLE) < 0.1 THEN 'TIGHTEN' ELSE 'KEEP' END AS advice FROM c")
def a16_lateral_utility(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("shown"), F.count_if(F.col("event_type") == "click").alias("used"), F.count_if(F.col("event_type") == "purchase").alias("liked"))
    return E.lateral_utility(e, "user_id")


# --- lifecycle ------------------------------------------------------------------------------------------

_WAL = "wal AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id < 300 OR event_type = 'signup' THEN 'REMEMBER' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'FORGET' WHEN event_type = 'view' THEN 'SUPPRESS' WHEN event_type = 'purchase' THEN 'RESOLVE' ELSE 'REINFORCE' END AS type, event_id % 300 AS id, value AS importance, CAST((event_id * 31) % 256 - 128 AS INTEGER) AS valence FROM events)"


def wal(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when((i < 300) | (t == "signup"), "REMEMBER").when((t == "error") & (i % 3 == 0), "FORGET").when(t == "view", "SUPPRESS").when(t == "purchase", "RESOLVE").otherwise("REINFORCE")
    return table(spark, sf_dir, "events").select(i.alias("seq"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"), kind.alias("type"), (i % 300).alias("id"), F.col("value").alias("importance"), ((i * 31) % 256 - 128).cast("int").alias("valence"))


def state_sql(condition: str) -> str:
    return f"""WITH RECURSIVE {_WAL}, e AS (SELECT * FROM wal WHERE {condition}), b AS (SELECT id, max(CASE WHEN type = 'REMEMBER' THEN seq END) AS born, max(CASE WHEN type = 'FORGET' THEN seq END) AS gone,
      max(CASE WHEN type = 'SUPPRESS' THEN seq END) AS hushed, max(CASE WHEN type = 'RESOLVE' THEN seq END) AS solved FROM e GROUP BY id),
     o AS (SELECT b.*, w.ts_ms, w.importance, w.valence FROM b JOIN e w ON w.seq = b.born WHERE coalesce(gone, -1) < born),
     r AS (SELECT e.id, e.valence, row_number() OVER (PARTITION BY e.id ORDER BY seq) AS n FROM e JOIN o ON o.id = e.id AND e.seq > o.born WHERE type = 'REINFORCE'),
     f AS (SELECT id, 0::BIGINT AS n, valence FROM o UNION ALL SELECT f.id, f.n + 1, greatest(-128, least(127, CAST(floor(f.valence * {dbl(0.7)} + r.valence * {dbl(0.3)} + {dbl(0.5)}) AS INTEGER))) FROM f JOIN r ON r.id = f.id AND r.n = f.n + 1),
     l AS (SELECT id, max(n) AS recalls, arg_max(valence, n) AS valence FROM f GROUP BY id)
    SELECT o.id, o.ts_ms, o.importance, l.valence, CAST(l.recalls AS INTEGER) AS recalls, hushed IS NOT NULL AS suppressed, solved IS NOT NULL AS resolved FROM o JOIN l USING (id)"""


@query(state_sql("true"))
def g18_reinforced_state(spark, sf_dir):
    return R.state_at(wal(spark, sf_dir))


_MIDDLE = 1_705_363_200_000


@query(state_sql(f"ts_ms <= {_MIDDLE}"))
def g25_point_in_time(spark, sf_dir):
    return R.state_at(wal(spark, sf_dir), until_ms=_MIDDLE)


@query(f"WITH {_WAL} SELECT * FROM wal WHERE seq > 500 AND seq <= 700")
def s18_log_replay(spark, sf_dir):
    return wal(spark, sf_dir).where("seq > 500 and seq <= 700")


@query(f"WITH {MEM}, p AS (SELECT *, importance * {decay_sql(bucket_sql())} < 0.05 AND NOT pinned AND tier = 1 AS pruned FROM mem) SELECT id, pruned OR tombstoned AS tombstoned FROM p")
def g12_prune(spark, sf_dir):
    return L.prune(memories(spark, sf_dir), NOW, 0.05).select("id", "tombstoned")


@query(f"WITH {MEM}, r AS (SELECT tier, avg(CAST(tombstoned AS INTEGER)) AS ratio FROM mem GROUP BY tier) SELECT id, tier FROM mem JOIN r USING (tier) WHERE ratio <= 0.02 OR NOT tombstoned")
def g13_compact(spark, sf_dir):
    return L.compact(memories(spark, sf_dir), 0.02).select("id", "tier")


@query(f"WITH {MEM}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM mem WHERE tier = 1 AND NOT tombstoned), p AS (SELECT CASE WHEN a.ts_ms < b.ts_ms OR (a.ts_ms = b.ts_ms AND a.id < b.id) THEN a.id ELSE b.id END AS id FROM c a JOIN c b ON a.user_id = b.user_id AND a.rn < b.rn WHERE a.rn <= 20 AND b.rn <= 20 AND {l2_sql('a.embedding', 'b.embedding')} <= 1.3) SELECT mem.id, round(importance * pow(0.7::DOUBLE, coalesce(n, 0)), 9) AS importance FROM mem LEFT JOIN (SELECT id, count(*) AS n FROM p GROUP BY id) USING (id)")
def g14_interference(spark, sf_dir):
    return L.interference(memories(spark, sf_dir), "user_id", 1.3).select("id", F.round("importance", 9).alias("importance"))


@query(f"WITH {MEM} SELECT centroid, count(*) AS n, bit_and(mask) AS mask, arg_max(id, (importance, -id)) AS best, {r6('max(importance)')} AS importance FROM mem WHERE tier = 1 AND NOT tombstoned GROUP BY centroid HAVING count(*) >= 5")
def a13_consolidation(spark, sf_dir):
    return L.consolidate(memories(spark, sf_dir).where("tier = 1 and not tombstoned"), 5).select("centroid", "n", "mask", "best", S.rounded(F.col("importance")).alias("importance"))


@query(f"WITH {MEM}, g AS (SELECT centroid, arg_max(id, (importance, -id)) AS best FROM mem WHERE tier = 1 AND NOT tombstoned GROUP BY centroid HAVING count(*) >= 5) SELECT mem.id, CASE WHEN g.best IS NOT NULL THEN 2 ELSE tier END AS tier, tier = 1 AND NOT tombstoned AND mem.centroid IN (SELECT centroid FROM g) AS consolidated FROM mem LEFT JOIN g ON g.best = mem.id")
def g15_consolidate(spark, sf_dir):
    return L.promote_clusters(memories(spark, sf_dir), 5).select("id", "tier", "consolidated")


@query(f"WITH {MEM} SELECT user_id, arg_max(id, (importance, -id)) AS best, {r6('max(importance)')} AS importance FROM mem WHERE tier = 1 AND NOT tombstoned AND importance >= 1 GROUP BY user_id")
def g16_promote_best(spark, sf_dir):
    return L.best_of(memories(spark, sf_dir).where("tier = 1 and not tombstoned and importance >= 1"), "user_id").select("user_id", "best", S.rounded(F.col("importance")).alias("importance"))


@query(f"WITH {MEM}, r AS (SELECT *, {decay_sql(decay_bucket_sql())} AS d FROM mem) SELECT id, recalls + 1 AS recalls, {r6(f'least({dbl(5)}, strength + {dbl(0.1)} * (1 - d))')} AS strength, greatest(-128, least(127, CAST(floor(valence * {dbl(0.7)} + 50 * {dbl(0.3)} + {dbl(0.5)}) AS INTEGER))) AS valence FROM r")
def g18_reinforce(spark, sf_dir):
    return L.reinforce(memories(spark, sf_dir), F.lit(50), NOW).select("id", "recalls", S.rounded(F.col("strength")).alias("strength"), "valence")


@query(f"WITH {MEM} SELECT id, {r6(f'CASE WHEN k % 2 = 0 THEN (importance + {icnu_sql(True)}) / 2 ELSE importance * (1 + least({dbl(0.3)}, {dbl(0.05)} * recalls)) END')} AS importance FROM mem")
def g19_reinforce_with_hints(spark, sf_dir):
    icnu = M.icnu_importance(F.col("k") / 100, F.col("arousal") / 255, F.least(F.lit(1.0), F.col("importance") / 10), F.col("recalls") / 7)
    return L.reinforce_importance(memories(spark, sf_dir), F.when(F.col("k") % 2 == 0, icnu), F.col("recalls")).select("id", S.rounded(F.col("importance")).alias("importance"))


@query(f"WITH {MEM} SELECT id, CAST(auto_recalls + CAST((id * 7919) % 600000 >= 300000 AS INTEGER) AS INTEGER) AS auto_recalls, {r6(f'CASE WHEN (id * 7919) % 600000 >= 300000 THEN least({dbl(5)}, strength + {dbl(0.05)}) ELSE strength END')} AS strength FROM mem")
def g20_auto_strengthening(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("last_auto", F.lit(NOW) - (F.col("id") * 7919) % 600000)
    return L.auto_strengthen(m, NOW).select("id", "auto_recalls", S.rounded(F.col("strength")).alias("strength"))


_EDITS = "edits AS (SELECT event_id % 50 AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'SUPPRESS' WHEN 'error' THEN 'FORGET' WHEN 'view' THEN 'UNSUPPRESS' WHEN 'signup' THEN 'RESOLVE' ELSE 'UNRESOLVE' END AS type FROM events)"


@query(f"WITH {_EDITS}, l AS (SELECT id, arg_max(type, seq) FILTER (type IN ('SUPPRESS', 'UNSUPPRESS')) AS s, arg_max(type, seq) FILTER (type IN ('RESOLVE', 'UNRESOLVE')) AS r, count(*) FILTER (type = 'FORGET') AS f FROM edits GROUP BY id) SELECT id, coalesce(s = 'SUPPRESS', false) AS suppressed, coalesce(r = 'RESOLVE', false) AS resolved, f > 0 AS forgotten FROM l")
def g21_flag_edits(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "click", "SUPPRESS").when(t == "error", "FORGET").when(t == "view", "UNSUPPRESS").when(t == "signup", "RESOLVE").otherwise("UNRESOLVE")
    return L.flag_edits(table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("id"), F.col("event_id").alias("seq"), kind.alias("type")))


@query(f"WITH {MEM} SELECT id, {r6(f'CASE WHEN tier = 1 AND ts_ms < {_LOW} THEN importance * {dbl(0.5)} ELSE importance END')} AS importance FROM mem")
def g22_bulk_decay(spark, sf_dir):
    return L.bulk_decay(memories(spark, sf_dir), _LOW, 0.5).select("id", S.rounded(F.col("importance")).alias("importance"))


@query(f"WITH {MEM}, s AS (SELECT id, embedding FROM mem WHERE tier = 2), n AS (SELECT id AS new_id, embedding AS e FROM mem WHERE id % 50 = 0), p AS (SELECT new_id, id, {r6(l2_sql('embedding', 'e'))} AS d FROM n, s WHERE id <> new_id) SELECT new_id, id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY d, id) AS r FROM p WHERE d <= 0.05) WHERE r = 1")
def g23_semantic_duplicates(spark, sf_dir):
    m = memories(spark, sf_dir)
    return L.semantic_duplicates(m.where("id % 50 = 0"), m.where("tier = 2"), 0.05)


@query(f"WITH {MEM}, p AS (SELECT id % 500 AS g, max(ts_ms) AS ts_ms, max(importance) AS importance, bit_or(mask) AS mask FROM mem GROUP BY id % 500) SELECT g, ts_ms, {r6('importance')} AS importance, mask FROM p")
def g23_merge_duplicates(spark, sf_dir):
    m = memories(spark, sf_dir).groupBy((F.col("id") % 500).alias("g")).agg(F.max("ts_ms").alias("ts_ms"), F.max("importance").alias("importance"), F.bit_or("mask").alias("mask"))
    return m.withColumn("importance", S.rounded(F.col("importance")))


@query(f"SELECT event_id AS id, epoch_us(ts) // 1000 AS trigger_ms, CAST(10 AS DOUBLE) AS score FROM events WHERE event_type = 'signup' AND epoch_us(ts) // 1000 <= {_MIDDLE}")
def g24_due_reminders(spark, sf_dir):
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select(F.col("event_id").alias("id"), at.alias("trigger_ms"), F.lit(10.0).alias("score")).where(F.col("trigger_ms") <= _MIDDLE)


@query(f"WITH {MEM}, a AS (SELECT id, ts_ms, mask, importance, recalls, valence, CAST({_FLAGS} AS INTEGER) AS flags FROM mem WHERE id % 3 <> 0), b AS (SELECT id, ts_ms + (id % 5 - 2) * 1000 AS ts_ms, mask | 1 AS mask, importance * 0.9::DOUBLE AS importance, recalls + 1 AS recalls, -valence AS valence, CAST((id % 64) AS INTEGER) AS flags FROM mem WHERE id % 3 <> 1) SELECT coalesce(a.id, b.id) AS id, greatest(a.ts_ms, b.ts_ms) AS ts_ms, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN a.mask | b.mask ELSE coalesce(a.mask, b.mask) END AS mask, {r6('greatest(a.importance, b.importance)')} AS importance, greatest(a.recalls, b.recalls) AS recalls, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN CASE WHEN b.ts_ms >= a.ts_ms THEN b.valence ELSE a.valence END ELSE coalesce(a.valence, b.valence) END AS valence, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN a.flags | (b.flags & 25) ELSE coalesce(a.flags, b.flags) END AS flags FROM a FULL JOIN b ON a.id = b.id")
def u5_replica_merge(spark, sf_dir):
    m = memories(spark, sf_dir)
    flags = M.pack_flags(F.col("tombstoned"), F.col("tier"), F.col("id") % 5 == 0, F.col("pinned"), F.col("resolved"), F.col("id") % 4)
    a = m.where("id % 3 <> 0").select("id", "ts_ms", "mask", "importance", "recalls", "valence", flags.cast("int").alias("flags"))
    b = m.where("id % 3 <> 1").select("id", (F.col("ts_ms") + (F.col("id") % 5 - 2) * 1000).alias("ts_ms"), F.col("mask").bitwiseOR(F.lit(1)).alias("mask"), (F.col("importance") * 0.9).alias("importance"), (F.col("recalls") + 1).alias("recalls"), (-F.col("valence")).alias("valence"), (F.col("id") % 64).cast("int").alias("flags"))
    return R.merge_replicas(a, b).withColumn("importance", S.rounded(F.col("importance")))


@query(f"WITH {MEM}, a AS (SELECT id, ts_ms, mask, recalls FROM mem WHERE id % 3 <> 0), b AS (SELECT id, ts_ms + (id % 5 - 2) * 1000 AS ts_ms, mask | 1 AS mask, recalls FROM mem) SELECT a.id, b.ts_ms > a.ts_ms OR (b.mask | a.mask) <> a.mask OR b.recalls > a.recalls AS changes FROM a JOIN b USING (id)")
def u6_would_change(spark, sf_dir):
    m = memories(spark, sf_dir)
    b = m.select("id", (F.col("ts_ms") + (F.col("id") % 5 - 2) * 1000).alias("t"), F.col("mask").bitwiseOR(F.lit(1)).alias("m"), F.col("recalls").alias("r"))
    return m.where("id % 3 <> 0").join(b, "id").select("id", ((F.col("t") > F.col("ts_ms")) | (F.col("m").bitwiseOR(F.col("mask")) != F.col("mask")) | (F.col("r") > F.col("recalls"))).alias("changes"))


@query("SELECT c_nationkey AS namespace, n, CASE WHEN n > 60 THEN 'EXCEEDED' WHEN n > 42 THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)")
def a17_quota_check(spark, sf_dir):
    return L.quota_check(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("namespace")), 60, 0.7)


@query(f"WITH {MEM}, u AS (SELECT id, importance FROM mem WHERE tier = 0 UNION ALL SELECT id, importance FROM mem WHERE tier = 1 UNION ALL SELECT id, importance FROM mem WHERE tier = 1 AND k > 50) SELECT id, count(*) AS n, {r6('max(importance)')} AS best FROM u GROUP BY id")
def u1_union_of_tiers(spark, sf_dir):
    m = memories(spark, sf_dir).select("id", "importance", "tier", "k")
    u = m.where("tier = 0").unionByName(m.where("tier = 1")).unionByName(m.where("tier = 1 and k > 50"))
    return u.groupBy("id").agg(F.count("*").alias("n"), S.rounded(F.max("importance")).alias("best"))


@query(f"WITH {MEM} SELECT id FROM mem WHERE tier = 1 EXCEPT SELECT id FROM mem WHERE k % 2 = 0")
def u3_except(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.where("tier = 1").select("id").join(m.where("k % 2 = 0").select("id"), "id", "left_anti")


@query(f"WITH {MEM} SELECT user_id, bit_and(mask) AS shared, bit_or(mask) AS everything, CAST(count(*) FILTER (list_has_all(tags, ['click'])) AS BIGINT) AS clicks FROM mem GROUP BY user_id")
def u4_tag_sets(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("user_id").agg(F.bit_and("mask").alias("shared"), F.bit_or("mask").alias("everything"), F.count_if(F.size(F.array_except(F.array(F.lit("click")), "tags")) == 0).alias("clicks"))


@query(f"WITH {MEM} SELECT id, {r6('importance')} AS importance, tier FROM mem WHERE NOT tombstoned ORDER BY importance DESC, id LIMIT 25")
def t5_overview(spark, sf_dir):
    return memories(spark, sf_dir).where(~F.col("tombstoned")).orderBy(F.desc("importance"), "id").limit(25).select("id", S.rounded(F.col("importance")).alias("importance"), "tier")


@query(f"WITH {MEM} SELECT user_id, id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, id DESC) AS r FROM mem WHERE tier = 0) WHERE r <= 7")
def w7_ring_buffer(spark, sf_dir):
    return S.top_k(memories(spark, sf_dir).where("tier = 0"), 7, F.desc("ts_ms"), F.desc("id"), by="user_id").select("user_id", "id", "ts_ms")


@query("SELECT * FROM (VALUES ('BALANCED', 1), ('CRITICAL', 2), ('DEBUGGING', 3), ('RECALLING', 4), ('CRITICAL', 5)) t(profile, n)")
def r24_profile_detection(spark, sf_dir):
    rows = spark.createDataFrame([(1, ["cats"]), (2, ["Outage", "bug"]), (3, ["bugfix", "solution"]), (4, ["best-practice"]), (5, ["security"])], "n int, tags array<string>")
    return rows.select(R.detect_profile(F.col("tags")).alias("profile"), "n")


@query(f"WITH {recall_sql(R.RecallOptions(top_k=10))} SELECT qid, {r6('max(similarity)')} AS best, max(similarity) < 0.40 AS expand FROM hits GROUP BY qid")
def r21_expansion_gate(spark, sf_dir):
    hits = R.recall(memories(spark, sf_dir), asked(spark, sf_dir), R.RecallOptions(top_k=10), NOW)
    return hits.groupBy("qid").agg(S.rounded(F.max("similarity")).alias("best"), (F.max("similarity") < 0.40).alias("expand"))


@query(f"WITH {MEM}, {Q2} SELECT qid, string_agg('memory ' || CAST(id AS VARCHAR), '; ' ORDER BY importance DESC, id) AS block FROM (SELECT qid, id, importance, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, id) AS r FROM mem, v WHERE importance >= 5 AND NOT tombstoned) WHERE r <= 5 GROUP BY qid")
def r38_prompt_enrichment(spark, sf_dir):
    m = memories(spark, sf_dir).where("importance >= 5 and not tombstoned").crossJoin(S.small(asked(spark, sf_dir).select("qid")))
    top = S.top_k(m, 5, F.desc("importance"), F.asc("id"))
    return top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l")).select("qid", F.array_join(F.transform("l", lambda x: F.concat(F.lit("memory "), x["id"].cast("string"))), "; ").alias("block"))


@query(f"""WITH {MEM}, p AS (SELECT *, tombstoned OR (importance * {decay_sql(bucket_sql())} < 0.05 AND NOT pinned AND tier = 1) AS gone FROM mem), r AS (SELECT tier, avg(CAST(gone AS INTEGER)) AS ratio FROM p GROUP BY tier), k AS (SELECT p.* FROM p JOIN r USING (tier) WHERE ratio <= 0.3 OR NOT gone),
 g AS (SELECT centroid, arg_max(id, (importance, -id)) AS best FROM k WHERE tier = 1 AND NOT gone GROUP BY centroid HAVING count(*) >= 5), m AS (SELECT k.id, k.centroid, k.ts_ms, k.importance, k.embedding, k.gone, CASE WHEN g.best = k.id THEN 2 ELSE k.tier END AS tier FROM k LEFT JOIN g USING (centroid)),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY centroid ORDER BY importance DESC, id) AS rn FROM m WHERE tier = 1 AND NOT gone) WHERE rn <= 20),
 q AS (SELECT CASE WHEN a.ts_ms < b.ts_ms OR (a.ts_ms = b.ts_ms AND a.id < b.id) THEN a.id ELSE b.id END AS id FROM c a JOIN c b ON a.centroid = b.centroid AND a.rn < b.rn WHERE {l2_sql('a.embedding', 'b.embedding')} <= 0.12), n AS (SELECT id, count(*) AS times FROM q GROUP BY id)
 SELECT tier, gone AS tombstoned, count(*) AS n, {r6(f'sum(importance * pow({dbl(0.7)}, coalesce(times, 0)))')} AS importance FROM m LEFT JOIN n USING (id) GROUP BY tier, gone""")
def g17_reflect_cycle(spark, sf_dir):
    return L.reflect(memories(spark, sf_dir), NOW).groupBy("tier", "tombstoned").agg(F.count("*").alias("n"), S.rounded(F.sum("importance")).alias("importance"))

