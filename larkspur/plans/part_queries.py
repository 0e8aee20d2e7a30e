"""Queries of operators that are parts of larger ones: joins, running values, scalar rules, model boundaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import memory as M
from larkspur.functions import providers as P
from larkspur.functions import text as T
from larkspur.operators import ann
from larkspur.operators import graph as G
from larkspur.operators import lifecycle as L
from larkspur.operators import memory as R
from larkspur.operators import quantize as Q
from larkspur.operators import search as S
from larkspur.plans.graph_queries import _STEPS, _TIMES, links, timing
from larkspur.plans.memory_queries import Q2, recall_sql
from larkspur.plans.memory_queries import asked as recall_asked
from larkspur.plans.registry import query
from larkspur.plans.search_queries import bm25_sql, knn_cte, query_texts, topk_sql
from larkspur.plans.tables import AROUSAL_SQL, MEM, NOW, bucket_sql, dbl, decay_bucket_sql, decay_sql, documents, dot_sql, l2_sql, memories, query_vectors, r6, table, terms_sql, vectors
from larkspur.plans.vector_queries import NEAREST
from larkspur.plans.vector_queries import asked as vectors_asked
from larkspur.session import scratch_dir
from larkspur.sources import readers
from larkspur.sources import stores

# joins


@query(f"WITH {bm25_sql()} SELECT qid, id, term, tf, times FROM tf JOIN wanted USING (term)")
def j2_terms_with_postings(spark, sf_dir):
    wanted = query_texts(spark).select("qid", F.explode(T.standard_terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    return S.postings(documents(spark, sf_dir)).join(S.small(wanted), "term").select("qid", "id", "term", "tf", "times")


_LISTS = f"a AS ({topk_sql('bm', 20)}), b AS ({topk_sql('near', 20)})"


def two_lists(spark, sf_dir):
    words = S.bm25(documents(spark, sf_dir), query_texts(spark), 20)
    return words, S.knn(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0, 1, 2, 3), 20, "dot")


@query(f"WITH {bm25_sql()}, {knn_cte('dot', '0, 1, 2, 3')}, {_LISTS} SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS text_rank, b.rank AS vector_rank FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id")
def j3_ranked_lists(spark, sf_dir):
    words, near = two_lists(spark, sf_dir)
    return words.select("qid", "id", F.col("rank").alias("text_rank")).join(near.select("qid", "id", F.col("rank").alias("vector_rank")), ["qid", "id"], "full_outer")


@query(f"WITH {bm25_sql()}, {knn_cte('dot', '0, 1, 2, 3')}, {_LISTS} SELECT qid, id, bool_or(l = 0) AS by_text, bool_or(l = 1) AS by_vector FROM (SELECT qid, id, 0 AS l FROM a UNION ALL SELECT qid, id, 1 FROM b) GROUP BY qid, id")
def j4_union_of_hits(spark, sf_dir):
    words, near = two_lists(spark, sf_dir)
    both = words.select("qid", "id", F.lit(0).alias("l")).unionByName(near.select("qid", "id", F.lit(1).alias("l")))
    return both.groupBy("qid", "id").agg(F.bool_or(F.col("l") == 0).alias("by_text"), F.bool_or(F.col("l") == 1).alias("by_vector"))


@query(f"WITH {knn_cte('l2', '1, 2')} SELECT qid, id, score FROM near")
def j5_queries_with_all_vectors(spark, sf_dir):
    return S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 1, 2), "l2")


@query(f"WITH c AS (SELECT vec_id AS cell, embedding AS centre FROM embeddings WHERE vec_id < 8) SELECT e.vec_id AS id, CAST(arg_min(cell, {l2_sql('e.embedding', 'centre')}) AS INTEGER) AS cell FROM embeddings e, c GROUP BY e.vec_id")
def j6_nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    centres = np.array([r["embedding"] for r in v.where("id < 8").orderBy("id").collect()], dtype=np.float64)  # eight centres
    return ann.with_cell(v, centres).select("id", "cell")


@query(f"WITH {MEM} SELECT id FROM mem WHERE id NOT IN (SELECT id FROM mem WHERE k > 80)")
def j7_not_suppressed(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select("id").join(m.where("k > 80").select("id"), "id", "left_anti")


@query(f"WITH {recall_sql(R.RecallOptions(top_k=40))} SELECT qid, id FROM hits WHERE rank > 10")
def j8_not_in_results(spark, sf_dir):
    m, q = memories(spark, sf_dir), recall_asked(spark, sf_dir)
    shown = R.recall(m, q, R.RecallOptions(top_k=10), NOW).select("qid", "id")
    return R.recall(m, q, R.RecallOptions(top_k=40), NOW).select("qid", "id").join(shown, ["qid", "id"], "left_anti")


@query(f"WITH {MEM}, {Q2}, s AS (SELECT qid, id, importance, tier, {r6(l2_sql('embedding', 'vector'))} AS score FROM mem, v WHERE tier = 2 AND NOT tombstoned), h AS ({topk_sql('s', 20, 'score, id', columns='qid, id, score, importance')}) SELECT qid, id, score, rank, {r6('importance')} AS importance FROM h")
def j16_index_hits_with_records(spark, sf_dir):
    """Hits of an index over the semantic records, joined with their headers."""
    m = memories(spark, sf_dir).where("tier = 2 and not tombstoned")
    index = ann.build("cells", m.select("id", "embedding"), cells=6)
    hits = index.search(recall_asked(spark, sf_dir), 20, probes=6)
    return m.select("id", "importance").join(S.small(hits), "id").select("qid", "id", "score", "rank", S.rounded(F.col("importance")).alias("importance"))


# running values


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents")
def w1_rank_in_list(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return documents(spark, sf_dir).select("source", "doc_id", F.row_number().over(w).alias("rank"))


@query("WITH w AS (SELECT event_id AS id, count(*) OVER u AS n, value, avg(value) OVER u AS m, stddev_pop(value) OVER u AS s FROM events WINDOW u AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT id, n, round(CASE WHEN n < 2 OR s < 1e-9 THEN 0 ELSE (value - m) / s END, 4) + CAST(0 AS DOUBLE) AS z FROM w")
def w5_running_z_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "user_id", "ts", "value")
    return R.surprise(e, "value", ["ts", "id"], ["event_type", "user_id"]).select("id", "n", (F.round("z", 4) + F.lit(0.0)).alias("z"))


@query("WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens FROM conversations), s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t) SELECT conv_id, turn, used, used <= 200 AS fits FROM s")
def w8_token_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf_dir, "conversations").withColumn("used", F.sum(T.estimate_tokens(F.col("text")).cast("long")).over(w))
    return c.select("conv_id", "turn", "used", (F.col("used") <= 200).alias("fits"))


# scalar rules


@query(f"WITH {MEM} SELECT id, {r6(decay_sql(bucket_sql()))} AS kept, {r6(decay_sql(bucket_sql(), 'fast'))} AS kept_fast FROM mem")
def r11_decay_value(spark, sf_dir):
    bucket = M.age_bucket(F.col("ts_ms"), NOW)
    tables = [M.decay_table(*M.DECAY_PRESETS[p]) for p in ("default", "fast")]
    return memories(spark, sf_dir).select("id", *[S.rounded(M.decay(bucket, t)).alias(n) for t, n in zip(tables, ("kept", "kept_fast"))])


@query(f"WITH {MEM} SELECT id, {bucket_sql()} >> least(recalls, 5) AS bucket FROM mem")
def r12_reconsolidation(spark, sf_dir):
    return memories(spark, sf_dir).select("id", M.reconsolidated(M.age_bucket(F.col("ts_ms"), NOW), F.col("recalls")).alias("bucket"))


@query(f"WITH {MEM} SELECT id, {AROUSAL_SQL} AS modifier FROM mem")
def r13_arousal_modifier(spark, sf_dir):
    return memories(spark, sf_dir).select("id", M.arousal_modifier(F.col("arousal")).alias("modifier"))


@query(f"WITH {MEM} SELECT id, CAST({decay_bucket_sql()} AS INTEGER) AS bucket, NOT resolved AND NOT pinned AS open FROM mem")
def r14_unresolved_stay_fresh(spark, sf_dir):
    return memories(spark, sf_dir).select("id", R.decay_bucket(NOW).alias("bucket"), (~F.col("resolved") & ~F.col("pinned")).alias("open"))


@query(f"WITH {MEM}, a AS (SELECT id, (id * 7919) % 600000 AS age FROM mem) SELECT id, {r6(f'CASE WHEN age < 300000 THEN {dbl(0.1)} + {dbl(0.9)} * age / 300000 ELSE 1 END')} AS factor FROM a")
def r17_inhibition_of_return(spark, sf_dir):
    return memories(spark, sf_dir).select("id", S.rounded(M.inhibition((F.col("id") * 7919) % 600000)).alias("factor"))


@query(f"WITH {MEM} SELECT id, {r6('CASE WHEN importance > 8 THEN 10 ELSE importance END')} AS importance, importance > 8 AS pinned FROM mem")
def r28_flashbulb(spark, sf_dir):
    value, pinned = M.flashbulb(F.col("importance"), F.col("importance"), 8.0)
    return memories(spark, sf_dir).select("id", S.rounded(value).alias("importance"), pinned.alias("pinned"))


@query(f"WITH {MEM} SELECT id, CASE WHEN id % 3 = 0 THEN least(255, 2 * abs(valence)) ELSE arousal END AS arousal FROM mem")
def c18_derived_arousal(spark, sf_dir):
    return memories(spark, sf_dir).select("id", M.derived_arousal(F.when(F.col("id") % 3 != 0, F.col("arousal")), F.col("valence")).alias("arousal"))


@query(f"SELECT event_id AS id, {r6('exp(-value / 100)')} AS e, {r6('ln(1 + value)')} AS l, {r6('sqrt(value)')} AS s, {r6(f'pow(value, {dbl(0.3)})')} AS p, {r6('1 / (1 + exp(-(value - 50) / 10))')} AS g, {r6('least(60, greatest(20, value))')} AS c FROM events")
def c23_math(spark, sf_dir):
    x = F.col("value")
    made = {"e": F.exp(-x / 100), "l": F.log(1 + x), "s": F.sqrt(x), "p": F.pow(x, F.lit(0.3)), "g": M.sigmoid((x - 50) / 10), "c": F.least(F.lit(60.0), F.greatest(F.lit(20.0), x))}
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[S.rounded(c).alias(n) for n, c in made.items()])


@query(f"WITH {knn_cte('dot', '9')} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM near ORDER BY score DESC, id LIMIT 50")
def t2_scores_descending(spark, sf_dir):
    """Ties are ordered by id."""
    return S.knn(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 9), 50, "dot").select("id", "score", "rank")


# stores and indexes at rest


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id BETWEEN 10 AND 20")
def s3_sorted_vector_store(spark, sf_dir):
    """Vectors at rest in order of id: a look-up skips the row groups that can't hold it."""
    path = scratch_dir(spark, "sorted-vectors")
    vectors(spark, sf_dir).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(path).where(F.col("id").between(10, 20)).select("id", F.size("embedding").alias("dims"))


@query(NEAREST)
def s6_index_files(spark, sf_dir):
    """An index written, read again from its files alone, and searched."""
    path = scratch_dir(spark, "cells")
    index = ann.build("cells", vectors(spark, sf_dir), cells=8).write(path)
    again = ann.CellIndex(spark.read.parquet(path), index.centres)
    return again.search(vectors_asked(spark, sf_dir), 10, probes=8).select("qid", "id", "score", "rank")


@query("SELECT * FROM (VALUES ('/a.docx', 'docx: 4 bytes', NULL), ('/b.xls', NULL, 'RuntimeError: encrypted')) t(path, text, error)")
def s13_document_extractor(spark, sf_dir):
    def extractor(content, path):
        if path.endswith(".xls"):
            raise RuntimeError("encrypted")
        return f"{path.rsplit('.', 1)[1]}: {len(content)} bytes"

    return readers.extract_with(spark.createDataFrame([("/a.docx", bytearray(b"word")), ("/b.xls", bytearray(b""))], "path string, content binary"), extractor)


@query("SELECT n_name AS uri, length(n_name) AS bytes FROM nation WHERE n_nationkey % 5 <> 0")
def s15_asset_store(spark, sf_dir):
    """Assets stored, some deleted, the rest read back."""
    store = stores.Assets(scratch_dir(spark, "assets").removeprefix("file:"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    for r in rows:
        store.store(r.n_name, r.n_name.encode())
    for r in rows:
        if r.n_nationkey % 5 == 0:
            store.delete(r.n_name)
    return spark.createDataFrame([(r.n_name, len(store.retrieve(r.n_name))) for r in rows if store.exists(r.n_name)], "uri string, bytes long")


@query("SELECT vec_id AS id, vec_id % 2 = 0 AS cached, 4 AS tokens FROM embeddings")
def r31_token_cache(spark, sf_dir):
    """Token vectors at rest: what is cached isn't encoded again."""
    def encoder(texts):
        return [[[float(len(w))] for w in t.split()] for t in texts]

    docs = vectors(spark, sf_dir).select("id", F.concat_ws(" ", F.lit("a text of"), F.col("id").cast("string")).alias("text"))
    cache = S.TokenCache(spark, scratch_dir(spark, "tokens"), encoder)
    cache.get(docs.where("id % 2 = 0"))
    return cache.get(docs).select("id", "cached", F.size("tokens").alias("tokens"))


# rounds of an index against brute force


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true)) t(round, same)")
def v23_index_fuzz(spark, sf_dir):
    """Random additions and deletions, then a search of every kept vector: equal to exact search."""
    return ann.fuzz(vectors(spark, sf_dir), 3)


@query("SELECT * FROM (VALUES ('equal_frequency'), ('product'), ('standardised'), ('turbo')) t(strategy)")
def v22_quantization_strategies(spark, sf_dir):
    """Strategies whose decoded vectors lie nearer to the original than the mean vector does."""
    v = vectors(spark, sf_dir)
    x = Q.matrix_of(v)  # the bounded sample
    spread = ((x - x.mean(0)) ** 2).sum()
    frequent, turbo, standard, product = Q.EqualFrequency.fit(v), Q.Turbo.fit_table(v, 8), Q.Standardised.fit_table(v, 8), Q.ProductQuantizer.fit(v)
    decoded = {"equal_frequency": frequent.decode(frequent.encode(x)), "turbo": turbo.decode(*turbo.encode(x)), "standardised": standard.decode(standard.encode(x), x.shape[1]), "product": product.decode(product.encode(x))}
    return spark.createDataFrame([(n,) for n, y in sorted(decoded.items()) if ((x - y) ** 2).sum() < 0.5 * spread], "strategy string")


@query("SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) t(part)")
def v11_codebooks(spark, sf_dir):
    """Codebooks trained side by side equal those trained one by one."""
    v = vectors(spark, sf_dir)
    books = Q.ProductQuantizer.fit(v, 8, 16).books
    x = Q.matrix_of(v)
    own = lambda j: (y := x[:, 8 * j : 8 * j + 8])[np.lexsort(y.T)]
    return spark.createDataFrame([(j,) for j in range(8) if np.allclose(books[j], Q.lloyd(own(j), 16))], "part int")


# model boundaries


@query("SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS first, CAST(len(string_split(text, ' ')) AS DOUBLE) AS second FROM documents")
def p1_dense_model(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    made = P.apply_model(d, lambda texts: [[float(len(t)), float(len(t.split(" ")))] for t in texts])
    return made.select("id", F.element_at("result", 1).cast("double").alias("first"), F.element_at("result", 2).cast("double").alias("second"))


@query("SELECT doc_id AS id, len(string_split(text, ' ')) AS tokens, CAST(length(string_split(text, ' ')[1]) AS DOUBLE) AS first FROM documents")
def p3_token_model(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    made = P.apply_model(d, lambda texts: [[[float(len(w))] for w in t.split(" ")] for t in texts], "tokens")
    return made.select("id", F.size("result").cast("long").alias("tokens"), F.col("result")[0][0].cast("double").alias("first"))


@query("SELECT n_nationkey AS id, 'answer to ' || n_name AS answer FROM nation")
def p4_text_model(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    return P.apply_model(n, lambda texts: [f"answer to {t}" for t in texts], "text").select("id", F.col("result").alias("answer"))


@query(f"SELECT conv_id, turn, {terms_sql('text')} AS terms FROM conversations")
def p5_analyzer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.standard_terms(F.col("text")).alias("terms"))


@query(f"WITH {bm25_sql()}, h AS ({topk_sql('bm', 5)}), a AS (SELECT qid, id, rank AS before, CAST((id * 7) % 11 AS DOUBLE) AS rating FROM h) {topk_sql('a', 3, 'rating DESC, before, id', columns='qid, id, rating')}")
def p6_reranker(spark, sf_dir):
    """An injected reranker: rates each hit, the best three stay."""
    hits = S.bm25(documents(spark, sf_dir), query_texts(spark), 5)
    rated = hits.select("qid", "id", F.col("rank").alias("before"), ((F.col("id") * 7) % 11).cast("double").alias("rating"))
    return S.top_k(rated, 3, F.desc("rating"), F.asc("before"), F.asc("id")).select("qid", "id", "rating", "rank")


@query("SELECT event_id AS id, [event_type, 'user ' || CAST(user_id AS VARCHAR)] AS tags FROM events")
def p7_tag_extractor(spark, sf_dir):
    answer = F.concat(F.lit('Here: ["'), F.upper("event_type"), F.lit('", " user '), F.col("user_id").cast("string"), F.lit('", "'), "event_type", F.lit('"]'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.parse_tags(answer).alias("tags"))


@query("SELECT c_custkey AS id, lower(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'CONCEPT' END AS type FROM customer")
def p8_entity_extractor(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 2 == 0, F.lit(', "type": "person"')).otherwise(F.lit(""))
    answer = F.concat(F.lit('[{"name": " '), "c_name", F.lit('"'), kind, F.lit('}, {"name": ""}]'))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(P.parse_entities(answer)).alias("e"))
    return found.select("id", "e.name", "e.type")


@query("SELECT doc_id, length(text) AS n FROM documents")
def p10_ingestion_sink(spark, sf_dir):
    """Batches of a stream handed to an ingestion target, each once."""
    from larkspur.streaming import streams

    out, state = scratch_dir(spark, "sink"), scratch_dir(spark, "state")
    d = documents(spark, sf_dir)
    streams.run_available(streams.stream_table(spark, sf_dir, "documents.parquet", d.schema), lambda batch, n: batch.select("doc_id", F.length("text").cast("long").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}"), state)
    return spark.read.parquet(out).select("doc_id", "n")


@query(f"WITH {recall_sql(R.RecallOptions(top_k=10))} SELECT qid, count(*) AS n FROM hits GROUP BY qid")
def p11_recall_listener(spark, sf_dir):
    """A listener gets the hits of a recall after it; what it writes is read here."""
    path = scratch_dir(spark, "heard")
    hits = R.recall(memories(spark, sf_dir), recall_asked(spark, sf_dir), R.RecallOptions(top_k=10), NOW)
    R.notify(hits, [lambda df: df.write.parquet(path)])
    return spark.read.parquet(path).groupBy("qid").agg(F.count("*").alias("n"))


@query(f"SELECT vec_id AS id, {r6(dot_sql('embedding', 'embedding'))} AS squared FROM embeddings")
def p12_storage_adapter(spark, sf_dir):
    """A store behind two functions, save and load; here Parquet in the shared folder."""
    store = stores.Adapter(lambda df, name: df.write.parquet(f"{root}/{name}"), lambda name: spark.read.parquet(f"{root}/{name}"))
    root = scratch_dir(spark, "adapter")
    from larkspur.functions import vectors as V

    store.save(vectors(spark, sf_dir), "vectors")
    e = F.col("embedding")
    return store.load("vectors").select("id", S.rounded(V.dot(e, e)).alias("squared"))


@query("SELECT * FROM (VALUES ('progress', true), ('terminated', true)) t(event, seen)")
def x2_telemetry(spark, sf_dir):
    """Progress of a stream pushed to subscribers, one of which fails."""
    from larkspur.streaming import streams

    rows: list[dict] = []
    bus = streams.Telemetry()
    bus.subscribers += [lambda row: 1 / 0, rows.append]
    spark.streams.addListener(bus)
    try:
        streams.run_available(streams.stream_table(spark, sf_dir, "nation.parquet", table(spark, sf_dir, "nation").schema), lambda batch, n: batch.count(), scratch_dir(spark, "state"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(bus)
    events = {r["event"] for r in rows}
    return spark.createDataFrame([(e, e in events and bus.failures > 0) for e in ("progress", "terminated")], "event string, seen boolean")


@query("SELECT count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events")
def x8_checkpoints(spark, sf_dir):
    """A log and its periodic checkpoint: the state is the last checkpoint and what the log has after it."""
    log, root = table(spark, sf_dir, "events").select("event_id", "value"), scratch_dir(spark, "checkpoints")
    half = log.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    keeper = stores.Checkpoints(spark, root)
    keeper.save(log.where(F.col("event_id") <= half), half)
    base, upto = keeper.last()
    return base.unionByName(log.where(F.col("event_id") > upto)).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


# joins of graphs, sessions, replicas and logs


@query(f"WITH RECURSIVE {_STEPS}, walk AS (SELECT s AS start, s AS node, 0 AS depth FROM (SELECT DISTINCT event_id % 120 AS s FROM events WHERE event_id % 50 = 0) UNION SELECT start, dst, depth + 1 FROM walk JOIN edges ON src = node AND weight >= 2 WHERE depth < 2) SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node HAVING min(depth) > 0")
def j9_seeds_with_edges(spark, sf_dir):
    seeds = table(spark, sf_dir, "events").where("event_id % 50 = 0").select((F.col("event_id") % 120).alias("node")).distinct()
    strong = links(spark, sf_dir).where("weight >= 2").withColumn("relation", F.lit("LINK"))
    return G.traverse(strong, seeds, 2)


@query(f"WITH {_STEPS}, m AS (SELECT DISTINCT event_id % 120 AS id, event_type AS entity FROM events) SELECT x.entity AS a, y.entity AS b, count(*) AS n, sum(weight) AS weight FROM edges JOIN m x ON x.id = src JOIN m y ON y.id = dst GROUP BY ALL")
def j10_entities_over_links(spark, sf_dir):
    m = table(spark, sf_dir, "events").select((F.col("event_id") % 120).alias("id"), F.col("event_type").alias("entity")).distinct()
    both = links(spark, sf_dir).join(m.select(F.col("id").alias("src"), F.col("entity").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("entity").alias("b")), "dst")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH {MEM}, c AS (SELECT * FROM (SELECT id, user_id, embedding, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM mem WHERE tier = 1 AND NOT tombstoned) WHERE rn <= 20) SELECT a.user_id, a.id AS a, b.id AS b, {r6(l2_sql('a.embedding', 'b.embedding'))} AS distance FROM c a JOIN c b ON a.user_id = b.user_id AND a.rn < b.rn WHERE {l2_sql('a.embedding', 'b.embedding')} <= 1.2")
def j11_close_pairs_in_clusters(spark, sf_dir):
    return L.close_pairs(memories(spark, sf_dir), "user_id", 1.2, 20).select(F.col("c").alias("user_id"), "a", "b", S.rounded(F.col("distance")).alias("distance"))


@query(f"WITH s AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 50 <> 0), n AS (SELECT vec_id AS new_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT new_id, id, {r6(l2_sql('embedding', 'e'))} AS distance FROM n, s) SELECT new_id, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY distance, id) AS r FROM p WHERE distance <= 1.2) WHERE r = 1")
def j13_new_with_stored(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return L.semantic_duplicates(v.where("id % 50 = 0"), v.where("id % 50 <> 0"), 1.2)


@query("SELECT conv_id, turn, previous, length(text) - length(coalesce(before, '')) AS longer FROM (SELECT conv_id, turn, text, lag(turn) OVER w AS previous, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE previous IS NOT NULL")
def j14_previous_in_session(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    linked = G.chain(c, "conv_id", ["turn"], "turn").where("prev_id is not null")
    before = c.select("conv_id", F.col("turn").alias("prev_id"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return linked.join(before, ["conv_id", "prev_id"]).select("conv_id", "turn", F.col("prev_id").alias("previous"), (F.length("text") - F.col("n")).cast("long").alias("longer"))


@query("WITH r AS (SELECT source AS qid, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), q AS (SELECT source AS qid, doc_id AS id, quality AS grade FROM labels JOIN documents USING (doc_id)) SELECT qid, id, CAST(rank AS INTEGER) AS rank, grade FROM r LEFT JOIN q USING (qid, id) WHERE rank <= 10")
def j15_results_with_judgements(spark, sf_dir):
    d = documents(spark, sf_dir)
    ranked = S.top_k(d.select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), "n_chars"), 10, F.desc("n_chars"), F.asc("id")).select("qid", "id", "rank")
    judged = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
    return ranked.join(judged, ["qid", "id"], "left").select("qid", "id", "rank", "grade")


@query(f"WITH {MEM}, a AS (SELECT id, ts_ms FROM mem WHERE id % 3 <> 0), b AS (SELECT id, ts_ms + (id % 5 - 2) * 1000 AS ts_ms FROM mem WHERE id % 3 <> 1) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'remote only' WHEN b.id IS NULL THEN 'local only' WHEN b.ts_ms > a.ts_ms THEN 'remote newer' WHEN b.ts_ms < a.ts_ms THEN 'local newer' ELSE 'same' END AS state FROM a FULL JOIN b ON a.id = b.id")
def j17_local_with_remote(spark, sf_dir):
    m = memories(spark, sf_dir).select("id", "ts_ms")
    a = m.where("id % 3 <> 0").withColumnRenamed("ts_ms", "local")
    b = m.where("id % 3 <> 1").select("id", (F.col("ts_ms") + (F.col("id") % 5 - 2) * 1000).alias("remote"))
    newer = F.when(F.col("local").isNull(), "remote only").when(F.col("remote").isNull(), "local only").when(F.col("remote") > F.col("local"), "remote newer").when(F.col("remote") < F.col("local"), "local newer").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", newer.alias("state"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE epoch_us(ts) // 1000 <= 1705363200000) WHERE r = 1")
def j18_latest_event_until(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.expr("unix_micros(cast(ts as timestamp)) div 1000") <= 1_705_363_200_000)
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


@query(f"WITH {_TIMES}, w AS (SELECT src, dst, list_reduce(list_prepend({dbl(0)}, l), lambda w, x: greatest({dbl(0)}, least({dbl(1)}, w + x))) AS weight FROM n2) SELECT event_id AS id, {r6(f'1 + {dbl(0.3)} * coalesce(max(weight), 0)')} AS boost FROM events LEFT JOIN w ON dst = event_type AND src IN ('click', 'view') AND weight > 0 GROUP BY event_id")
def r19_predictive_boost(spark, sf_dir):
    """Results whose tags usually follow the query's tags gain by the strongest such link."""
    results = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tag"))
    asked_tags = spark.createDataFrame([("click",), ("view",)], "tag string")
    found = G.predictive_strength(timing(spark, sf_dir), asked_tags, results)
    return results.join(found, "id", "left").select("id", S.rounded(1 + 0.3 * F.coalesce("strongest", F.lit(0.0))).alias("boost"))


@query("WITH t AS (SELECT event_id % 40 AS id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_id % 40 ORDER BY ts, event_id) AS ms_before FROM events) SELECT id, count(*) AS n, CAST(count(*) FILTER (ms_before IS NULL OR ms - ms_before > 1800000) AS BIGINT) AS fresh FROM t GROUP BY id")
def x6_expiring_state(spark, sf_dir):
    """How often a key's state had expired after half an hour without events, or was new."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("id"), "ts", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("id").orderBy("ts", "event_id"))
    return e.withColumn("gap", gap).groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("gap").isNull() | (F.col("gap") > 1_800_000)).alias("fresh"))
