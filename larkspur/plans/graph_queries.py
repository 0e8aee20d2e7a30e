"""Queries on sessions, chains, links, tags and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.operators import search as S
from larkspur.plans.registry import query
from larkspur.plans.tables import dbl, memories, r6, table

_GAP = 1_800_000_000


def micro_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("u", F.expr("unix_micros(cast(ts as timestamp))"))


@query(f"WITH f AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {_GAP} THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS id, user_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f")
def w2_sessions(spark, sf_dir):
    return G.sessions(micro_events(spark, sf_dir), "user_id", "u", _GAP, ["ts", "event_id"]).select(F.col("event_id").alias("id"), "user_id", "session")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w3_chain(spark, sf_dir):
    return G.chain(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")


def _follow(name: str, sign: str, forward: bool):
    @query(f"WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT a.conv_id, a.turn, CAST(abs(b.r - a.r) AS INTEGER) AS hop, b.turn AS reached FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.r {sign} a.r AND abs(b.r - a.r) <= 3", name=name)
    def run(spark, sf_dir):
        return G.follow(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "turn", 3, forward)


_follow("w4_follow_forward", ">", True)
_follow("w4_follow_backward", "<", False)


@query("SELECT user_id, max(event_id) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def g10_prune_chains(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-15 00:00:00'").groupBy("user_id").agg(F.max("event_id").alias("kept"))


@query("SELECT user_id, list(event_id ORDER BY ts DESC, event_id DESC)[1] AS one, list(event_id ORDER BY ts DESC, event_id DESC)[2] AS two, list(event_id ORDER BY ts DESC, event_id DESC)[3] AS three FROM events GROUP BY user_id")
def w9_last_three(spark, sf_dir):
    top = S.top_k(table(spark, sf_dir, "events"), 3, F.desc("ts"), F.desc("event_id"), by="user_id")
    of = lambda n: F.max(F.when(F.col("rank") == n, F.col("event_id")))
    return top.groupBy("user_id").agg(of(1).alias("one"), of(2).alias("two"), of(3).alias("three"))


_SETS = "sets AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, tag FROM (SELECT user_id, ts, event_type AS tag FROM events UNION ALL SELECT user_id, ts, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS VARCHAR) FROM events)), cut AS (SELECT user_id, day, list(tag ORDER BY tag)[1:10] AS tags FROM sets GROUP BY ALL), one AS (SELECT user_id, day, unnest(tags) AS tag FROM cut), pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM one a JOIN one b ON a.user_id = b.user_id AND a.day = b.day AND a.tag < b.tag GROUP BY ALL)"
_TOP = ", ways AS (SELECT tag_a AS src, tag_b AS dst, n AS weight FROM pairs UNION ALL SELECT tag_b, tag_a, n FROM pairs), top AS (SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INTEGER) AS rank FROM ways)"


def tag_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.concat(F.lit("k"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"))
    return e.select("user_id", F.to_date("ts").alias("day"), F.explode(F.array("event_type", k)).alias("tag"))


@query(f"WITH {_SETS} SELECT tag_a, tag_b, n FROM pairs")
def a7_coactivation(spark, sf_dir):
    return G.tag_pairs(tag_sets(spark, sf_dir), ["user_id", "day"])


@query(f"WITH {_SETS}{_TOP} SELECT src, dst, weight, rank FROM top WHERE rank <= 3")
def t6_associated_tags(spark, sf_dir):
    return G.associated(G.tag_pairs(tag_sets(spark, sf_dir), ["user_id", "day"]), 3)


@query(f"WITH {_SETS}{_TOP} SELECT dst AS tag, max(weight) AS weight FROM top WHERE rank <= 5 AND src IN ('click', 'k1') AND dst NOT IN ('click', 'k1') GROUP BY dst ORDER BY weight DESC, tag LIMIT 10")
def a6_gap_detection(spark, sf_dir):
    present = spark.createDataFrame([("click",), ("k1",)], "tag string")
    return G.gaps(present, G.tag_pairs(tag_sets(spark, sf_dir), ["user_id", "day"]))


_STEPS = "st AS (SELECT event_id % 120 AS a, lead(event_id % 120) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), su AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT a AS src, b AS dst, 1 AS w FROM st WHERE a <> b UNION ALL SELECT b, a, 1 FROM st WHERE a <> b) GROUP BY src, dst), edges AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM su) WHERE r <= 20)"


def links(spark, sf_dir):
    rows = G.chain(table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 120), "user_id", ["ts", "event_id"], "n")
    return G.strengthen(rows.where(F.col("next_id").isNotNull()).select(F.col("n").alias("a"), F.col("next_id").alias("b"), F.lit(1.0).alias("weight")))


@query(f"WITH {_STEPS} SELECT src, dst, weight FROM edges")
def g1_strengthen(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"WITH {_STEPS}, d AS (SELECT src, dst, weight * {dbl(0.9)} AS weight FROM edges) SELECT src, dst, {r6('weight')} AS weight FROM d WHERE weight >= 1.5")
def g3_decay_links(spark, sf_dir):
    return G.decay_edges(links(spark, sf_dir), 0.9, 1.5).withColumn("weight", S.rounded(F.col("weight")))


@query(f"WITH {_STEPS}, l1 AS (SELECT dst AS node, max({dbl(1)} * weight) AS act FROM edges WHERE src IN (0, 5) GROUP BY dst), l2 AS (SELECT dst AS node, max(act * weight * {dbl(0.5)}) AS act FROM l1 JOIN edges ON src = node GROUP BY dst), b AS (SELECT node, max(act) AS act FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY node) SELECT node, {r6('act')} AS activation FROM b WHERE node NOT IN (0, 5)")
def g2_spreading_activation(spark, sf_dir):
    seeds = spark.createDataFrame([(0, 1.0), (5, 1.0)], "node long, activation double")
    return G.spread(links(spark, sf_dir), seeds).withColumn("activation", S.rounded(F.col("activation")))


def timing(spark, sf_dir):
    e = micro_events(spark, sf_dir)
    rows = G.chain(e, "user_id", ["ts", "event_id"], "event_type").withColumn("gap_ms", (F.expr("lead(u) over (partition by user_id order by ts, event_id)") - F.col("u")) / 1000.0)
    return G.timing_update(rows.where("next_id is not null").select(F.col("event_id").alias("at"), F.col("event_type").alias("src"), F.col("next_id").alias("dst"), "gap_ms"), tau_ms=3_600_000.0)


_TIMES = f"n0 AS (SELECT event_id AS t, event_type AS a, lead(event_type) OVER w AS b, (lead(epoch_us(ts)) OVER w - epoch_us(ts)) / {dbl(1000)} AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n1 AS (SELECT t, a AS src, b AS dst, {dbl(0.1)} * exp(-gap / {dbl(3600000)}) AS d FROM n0 WHERE b IS NOT NULL UNION ALL SELECT t, b, a, -{dbl(0.05)} * exp(-gap / {dbl(3600000)}) FROM n0 WHERE b IS NOT NULL), n2 AS (SELECT src, dst, list(d ORDER BY t, d) AS l FROM n1 WHERE src <> dst GROUP BY src, dst)"


@query(f"WITH {_TIMES} SELECT src, dst, weight FROM (SELECT src, dst, round(list_reduce(list_prepend({dbl(0)}, l), lambda w, x: greatest({dbl(0)}, least({dbl(1)}, w + x))), 6) AS weight FROM n2) WHERE weight > 0")
def g4_timing_links(spark, sf_dir):
    return timing(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_SETS}{_TOP}, r AS (SELECT event_id AS id, event_type AS tag FROM events), l AS (SELECT dst, weight FROM ways WHERE src IN ('k1', 'k5')), b AS (SELECT id, max(weight) AS m, avg(weight) AS a FROM r JOIN l ON tag = dst GROUP BY id) SELECT id, m AS strongest, {r6('a')} AS average, {r6(f'1 + {dbl(0.3)} * m / 1000')} AS boost FROM b")
def g5_predictive_strength(spark, sf_dir):
    edges = G.both_ways(G.tag_pairs(tag_sets(spark, sf_dir), ["user_id", "day"]), "tag_a", "tag_b", "n")
    asked = spark.createDataFrame([("k1",), ("k5",)], "tag string")
    results = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tag"))
    found = G.predictive_strength(edges, asked, results)
    return found.select("id", "strongest", S.rounded(F.col("average")).alias("average"), S.rounded(1 + 0.3 * F.col("strongest") / 1000).alias("boost"))


# --- entities ------------------------------------------------------------------------------------------

_REL = "rel AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst, 'LIVES_IN' AS relation FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 'PART_OF' FROM nation UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR), 'HOSTS' FROM supplier UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'd' || CAST(o_orderkey % 50 AS VARCHAR), 'ORDERED' FROM orders), ent AS (SELECT src, dst, relation, CAST(n AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst, relation) AS r FROM (SELECT src, dst, relation, count(*) AS n FROM rel GROUP BY ALL)) WHERE r <= 32)"


def related(spark, sf_dir):
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c, n, s, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "orders"))
    rows = c.select(name("c", F.col("c_custkey")).alias("src"), name("n", F.col("c_nationkey")).alias("dst"), F.lit("LIVES_IN").alias("relation"))
    rows = rows.unionByName(n.select(name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst"), F.lit("PART_OF").alias("relation")))
    rows = rows.unionByName(s.select(name("n", F.col("s_nationkey")).alias("src"), name("s", F.col("s_suppkey")).alias("dst"), F.lit("HOSTS").alias("relation")))
    rows = rows.unionByName(o.select(name("c", F.col("o_custkey")).alias("src"), name("d", F.col("o_orderkey") % 50).alias("dst"), F.lit("ORDERED").alias("relation")))
    return G.relations(rows)


@query(f"WITH {_REL} SELECT src, dst, relation, weight FROM ent")
def g6_relations(spark, sf_dir):
    return related(spark, sf_dir)


@query(f"WITH RECURSIVE {_REL}, walk AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES ('c1'), ('c2'), ('n3')) t(s) UNION SELECT start, dst, depth + 1 FROM walk JOIN ent ON src = node WHERE depth < 3) SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node HAVING min(depth) > 0")
def g7_traverse(spark, sf_dir):
    return G.traverse(related(spark, sf_dir), spark.createDataFrame([("c1",), ("c2",), ("n3",)], "node string"), 3)


@query(f"WITH RECURSIVE {_REL}, walk AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES ('c1'), ('n3')) t(s) UNION SELECT start, dst, depth + 1 FROM walk JOIN ent ON src = node AND relation = 'PART_OF' WHERE depth < 2) SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node HAVING min(depth) > 0")
def g7_traverse_relation(spark, sf_dir):
    return G.traverse(related(spark, sf_dir), spark.createDataFrame([("c1",), ("n3",)], "node string"), 2, "PART_OF")


@query(f"WITH {_REL}, d AS (SELECT src, dst, relation, weight * {dbl(0.95)} AS weight FROM ent) SELECT src, dst, relation, {r6('weight')} AS weight FROM d WHERE weight >= 1")
def g8_decay_relations(spark, sf_dir):
    return G.decay_edges(related(spark, sf_dir), 0.95, 1.0).withColumn("weight", S.rounded(F.col("weight")))


_NAMES = "nm AS (SELECT DISTINCT lower(p_brand) AS name, 'brand' AS type FROM part UNION SELECT DISTINCT lower(n_name), 'nation' FROM nation)"


def names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("brand").alias("type"))
    return G.entities(p.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("type"))))


@query(f"WITH {_NAMES} SELECT a.type, a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance FROM nm a JOIN nm b ON a.type = b.type AND a.name < b.name AND levenshtein(a.name, b.name) <= 2")
def j12_similar_names(spark, sf_dir):
    return G.similar_names(names(spark, sf_dir))


@query(f"WITH RECURSIVE {_NAMES}, p AS (SELECT a.type, a.name AS a, b.name AS b FROM nm a JOIN nm b ON a.type = b.type AND a.name <> b.name AND levenshtein(a.name, b.name) <= 2), w AS (SELECT type, name, name AS other FROM nm UNION SELECT w.type, w.name, p.b FROM w JOIN p ON p.type = w.type AND p.a = w.other) SELECT type, name, arg_min(other, (length(other), other)) AS merged FROM w GROUP BY type, name")
def g9_merge_entities(spark, sf_dir):
    return G.merge_entities(names(spark, sf_dir))


@query(f"WITH {_STEPS}, m AS (SELECT DISTINCT event_id % 120 AS id, 'u' || CAST(user_id % 10 AS VARCHAR) AS entity FROM events) SELECT DISTINCT x.entity AS a, y.entity AS b FROM edges JOIN m x ON x.id = src JOIN m y ON y.id = dst WHERE weight >= 3 AND x.entity < y.entity")
def g11_promotion(spark, sf_dir):
    m = table(spark, sf_dir, "events").select((F.col("event_id") % 120).alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("entity")).distinct()
    return G.promote(links(spark, sf_dir), m)


_LINKS = "lk AS (SELECT event_id AS id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events)"


@query(f"WITH {_STEPS}, {_LINKS}, hits AS (SELECT event_id AS id, value / 100 AS score FROM events WHERE event_id % 50 = 0), c AS (SELECT dst AS cid, score * least(weight / 5, {dbl(1)}) * {dbl(0.3)} AS s, 'link' AS via FROM edges JOIN hits ON src = id UNION ALL SELECT next_id, score * {dbl(0.8)}, 'next' FROM lk JOIN hits USING (id) WHERE next_id IS NOT NULL UNION ALL SELECT lk.id, score * {dbl(0.7)}, 'previous' FROM lk JOIN hits ON hits.id = lk.next_id), b AS (SELECT cid, max((s, via)) AS b FROM c GROUP BY cid) SELECT cid AS id, {r6('b[1]')} AS score, b[2] AS via FROM b WHERE cid NOT IN (SELECT id FROM hits)")
def r22_graph_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hits = e.where("event_id % 50 = 0").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"))
    linked = G.chain(e, "user_id", ["ts", "event_id"], "event_id").select(F.col("event_id").alias("id"), "next_id")
    return G.expand(hits, links(spark, sf_dir), linked)


@query(f"WITH RECURSIVE {_STEPS}, walk AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES (0::BIGINT), (1::BIGINT)) t(s) UNION SELECT start, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2) SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node HAVING min(depth) > 0")
def g26_ego_graph(spark, sf_dir):
    edges = links(spark, sf_dir).withColumn("relation", F.lit("LINK"))
    return G.traverse(edges, spark.createDataFrame([(0,), (1,)], "node long"), 2)


def _pipeline_sql() -> str:
    from larkspur.operators import memory as R
    from larkspur.plans.memory_queries import recall_sql

    return f"""WITH {recall_sql(R.RecallOptions(top_k=40), 'id % 13 <> 0')}, {_STEPS}, {_LINKS},
      words AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM mem WHERE event_type = 'error' AND id % 13 <> 0) WHERE rank <= 40),
      fu AS (SELECT id, round(sum({dbl(1)} / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM hits WHERE qid = 0 UNION ALL SELECT id, rank FROM words) GROUP BY id),
      sc AS (SELECT id, round(score * ({dbl(1)} / (1 + (greatest(recalls, 1) - 1) * {dbl(0.2)})), 12) AS score FROM (SELECT * FROM fu ORDER BY score DESC, id LIMIT 20) JOIN mem USING (id)),
      c AS (SELECT dst AS cid, score * least(weight / 5, {dbl(1)}) * {dbl(0.3)} AS s, 'link' AS via FROM edges JOIN sc ON src = id UNION ALL SELECT next_id, score * {dbl(0.8)}, 'next' FROM lk JOIN sc USING (id) WHERE next_id IS NOT NULL UNION ALL SELECT lk.id, score * {dbl(0.7)}, 'previous' FROM lk JOIN sc ON sc.id = lk.next_id),
      b AS (SELECT cid, max((s, via)) AS b FROM c GROUP BY cid), more AS (SELECT cid AS id, {r6('b[1]')} AS score, b[2] AS via FROM b WHERE cid NOT IN (SELECT id FROM sc))
      SELECT id, score, via FROM (SELECT id, score, 'scan' AS via FROM sc UNION ALL SELECT * FROM more) ORDER BY score DESC, id LIMIT 10"""


@query(_pipeline_sql())
def r23_recall_pipeline(spark, sf_dir):
    """Scan, keyword fusion, suppression, penalties, graph candidates and final cut in one plan."""
    from larkspur.operators import memory as R
    from larkspur.plans.memory_queries import asked
    from larkspur.plans.tables import NOW

    m, q = memories(spark, sf_dir), asked(spark, sf_dir).where("qid = 0")
    hushed = m.where("id % 13 = 0").select("id")
    near = R.recall(m, q, R.RecallOptions(top_k=40), NOW, hushed)
    words = S.top_k(m.where("event_type = 'error' and id % 13 <> 0").crossJoin(S.small(q.select("qid"))), 40, F.desc("importance"), F.asc("id"))
    fused = R.text_fusion(near, words, 20)
    seen = fused.join(m.select("id", F.col("recalls").alias("times"), F.lit(0).cast("long").alias("last_ms"), F.lit(False).alias("recent")), "id")
    scored = R.penalties(seen, NOW).select("id", F.col("penalized").alias("score"))
    linked = G.chain(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id").select(F.col("event_id").alias("id"), "next_id")
    more = G.expand(scored, links(spark, sf_dir), linked)
    return scored.withColumn("via", F.lit("scan")).unionByName(more.select("id", "score", "via")).orderBy(F.desc("score"), "id").limit(10)

