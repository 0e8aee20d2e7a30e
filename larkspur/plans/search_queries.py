"""Queries on keyword, vector, sparse and hybrid search, filters, sorting and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.operators import search as S
from larkspur.plans.registry import query
from larkspur.plans.tables import dbl, documents, dot_sql, l2_sql, query_vectors, r6, table, terms_sql, vectors
from larkspur.session import scratch_dir

#: Query texts: words of the synthetic languages.
TEXTS = [(0, "from heating erent rest tion"), (1, "para ciónue mente"), (2, "apache license version from"), (3, "sch von keit heit keit")]


def query_texts(spark):
    return spark.createDataFrame(TEXTS, "qid long, query string")


QUERY_SQL = "q(qid, query) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in TEXTS) + ")"
DOC_TERMS = f"d AS (SELECT doc_id AS id, source, {terms_sql('text')} AS w FROM documents)"
WANTED = f"wanted AS (SELECT qid, t AS term, count(*) AS times FROM (SELECT qid, unnest({terms_sql('query')}) AS t FROM q) GROUP BY ALL)"


def bm25_sql(partition: str = "0") -> str:
    """CTEs that end with bm(qid, id, score)."""
    return f"""{QUERY_SQL}, {DOC_TERMS}, {WANTED},
    dp AS (SELECT id, {partition} AS part, w FROM d),
    st AS (SELECT part, count(*) AS n, avg(len(w)) AS average FROM dp GROUP BY part),
    tf AS (SELECT part, id, length, term, count(*) AS tf FROM (SELECT part, id, len(w) AS length, unnest(w) AS term FROM dp) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    df AS (SELECT part, term, count(*) AS df FROM tf GROUP BY ALL),
    bm AS (SELECT qid, id, {r6("sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)))")} AS score
      FROM tf JOIN df USING (part, term) JOIN st USING (part) JOIN wanted USING (term) GROUP BY qid, id)"""


def topk_sql(source: str, k: int, order: str = "score DESC, id", by: str = "qid", columns: str = "qid, id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k}"


@query(f"WITH {DOC_TERMS} SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total_length, {r6('avg(len(w))')} AS average_length FROM d")
def a1_corpus_stats(spark, sf_dir):
    return S.corpus_stats(documents(spark, sf_dir)).withColumn("average_length", S.rounded(F.col("average_length")))


@query(f"WITH {DOC_TERMS}, p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM p GROUP BY term")
def a2_document_frequency(spark, sf_dir):
    return S.postings(documents(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query(f"WITH {bm25_sql()} {topk_sql('bm', 20)}")
def r1_bm25(spark, sf_dir):
    return S.bm25(documents(spark, sf_dir), query_texts(spark), 20)


@query(f"WITH {bm25_sql()} {topk_sql('bm', 20)}")
def r1_bm25_index(spark, sf_dir):
    """The same from postings at rest; building them is part of the query here."""
    index = S.TextIndex.build(documents(spark, sf_dir), scratch_dir(spark, "index"), 16)
    return index.search(query_texts(spark), 20)


@query(f"WITH {bm25_sql('source')} {topk_sql('bm', 20)}")
def r34_partitioned_bm25(spark, sf_dir):
    return S.bm25(documents(spark, sf_dir), query_texts(spark), 20, partition="source")


SPLADE = r"""w AS (SELECT doc_id AS id, t AS term, ln(CAST(1 AS DOUBLE) + count(*)) AS weight FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS t FROM documents) GROUP BY ALL),
 qw AS (SELECT qid, t AS term, ln(CAST(1 AS DOUBLE) + count(*)) AS q FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS t FROM q) GROUP BY ALL)"""


@query(f"WITH {QUERY_SQL}, {SPLADE}, s AS (SELECT qid, id, {r6('sum(weight * q)')} AS score FROM w JOIN qw USING (term) GROUP BY qid, id) {topk_sql('s', 20)}")
def r33_sparse_search(spark, sf_dir):
    queries = S.fallback_weights(query_texts(spark), "qid", "query").withColumnRenamed("id", "qid")
    return S.sparse_search(S.fallback_weights(documents(spark, sf_dir), "doc_id", "text"), queries, 20)


def knn_cte(metric: str, ids: str = "0, 7, 42") -> str:
    a, b = "e.embedding", "v.vector"
    norm = f"(sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"
    formula = {"dot": dot_sql(a, b), "l2": l2_sql(a, b), "cosine": f"CASE WHEN {norm} > 0 THEN {dot_sql(a, b)} / {norm} ELSE 0 END"}[metric]
    return f"v AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id IN ({ids})), near AS (SELECT qid, vec_id AS id, {r6(formula)} AS score FROM embeddings e, v)"


def _knn(metric: str):
    order = "score, id" if metric == "l2" else "score DESC, id"

    @query(f"WITH {knn_cte(metric)} {topk_sql('near', 10, order)}", name=f"v1_exact_{metric}")
    def run(spark, sf_dir):
        return S.knn(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0, 7, 42), 10, metric)


for _metric in ("dot", "l2", "cosine"):
    _knn(_metric)


@query(f"WITH {knn_cte('cosine', '3')} SELECT id, score FROM near")
def v14_batch_similarity(spark, sf_dir):
    return S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 3)).select("id", "score")


@query(f"WITH {knn_cte('dot', 'SELECT vec_id FROM embeddings')} {topk_sql('near', 5)}")
def v15_batched_search(spark, sf_dir):
    """Every vector is a query, against all vectors, in one scan."""
    v = vectors(spark, sf_dir)
    return S.knn(v, v.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), 5, "dot")


@query(f"""WITH {bm25_sql()}, {knn_cte('dot', '0, 1, 2, 3')},
 a AS ({topk_sql('bm', 50)}), b AS ({topk_sql('near', 50)}),
 f AS (SELECT qid, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, max(CASE WHEN l = 0 THEN rank END) AS bm25_rank, max(CASE WHEN l = 1 THEN rank END) AS vector_rank
   FROM (SELECT qid, id, rank, 0 AS l FROM a UNION ALL SELECT qid, id, rank, 1 AS l FROM b) GROUP BY qid, id)
 {topk_sql('f', 10, columns='qid, id, score, bm25_rank, vector_rank')}""")
def r3_hybrid(spark, sf_dir):
    """Hybrid search of four queries, text q and vector q; the library's flagship query."""
    queries = query_texts(spark).join(query_vectors(spark, sf_dir, 0, 1, 2, 3), "qid")
    return S.hybrid(documents(spark, sf_dir), vectors(spark, sf_dir), queries, 10)


@query(f"""WITH {knn_cte('dot')}, {knn_cte('l2').replace('near AS', 'near2 AS').replace('v AS', 'v2 AS').replace(', v)', ', v2 v)')},
 a AS ({topk_sql('near', 30)}), b AS ({topk_sql('near2', 30, 'score, id')}),
 f AS (SELECT qid, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM a UNION ALL SELECT qid, id, rank FROM b) GROUP BY qid, id)
 {topk_sql('f', 15)}""")
def r2_rank_fusion(spark, sf_dir):
    q, v = query_vectors(spark, sf_dir, 0, 7, 42), vectors(spark, sf_dir)
    lists = S.knn(v, q, 30, "dot").select("qid", "id", "rank").unionByName(S.knn(v, q, 30, "l2").select("qid", "id", "rank"))
    return S.rrf(lists, 15)


@query(f"""WITH {knn_cte('dot')}, s AS (SELECT *, id % 3 AS shard FROM near), t AS ({topk_sql('s', 10, by='qid, shard')}) {topk_sql('(SELECT qid, id, max(score) AS score FROM t GROUP BY qid, id)', 10)}""")
def t7_shard_merge(spark, sf_dir):
    scored = S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0, 7, 42), "dot").withColumn("shard", F.col("id") % 3)
    return S.merge_shards(S.top_k(scored, 10, F.desc("score"), F.asc("id"), by=["qid", "shard"]).select("qid", "id", "score"), 10)


@query(f"WITH {knn_cte('dot')}, u AS (SELECT qid, id, score FROM near UNION ALL SELECT qid, id, score / 2 FROM near) SELECT qid, id, max(score) AS score FROM u GROUP BY qid, id")
def a18_best_of_duplicates(spark, sf_dir):
    near = S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0, 7, 42), "dot")
    return near.unionByName(near.withColumn("score", F.col("score") / 2)).groupBy("qid", "id").agg(F.max("score").alias("score"))


@query(f"WITH {knn_cte('cosine', '0, 7, 42')}, c AS ({topk_sql('near', 30)}), {knn_cte('l2').replace('near AS', 'near2 AS').replace('v AS', 'v2 AS').replace(', v)', ', v2 v)')} {topk_sql('(SELECT near2.* FROM near2 JOIN c USING (qid, id))', 10, 'score, id')}")
def v6_rescore(spark, sf_dir):
    q, v = query_vectors(spark, sf_dir, 0, 7, 42), vectors(spark, sf_dir)
    return S.rescored(S.knn(v, q, 30, "cosine"), v, q, 10).select("qid", "id", "score", "rank")


@query(f"WITH {knn_cte('cosine', '0')} SELECT id, score FROM near WHERE score >= 0.1")
def f5_similarity_threshold(spark, sf_dir):
    return S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0)).where(F.col("score") >= 0.1).select("id", "score")


_T = ("and", ("gte", "s_acctbal", 100), ("or", ("lt", "s_nationkey", 10), ("in", "s_name", ["Supplier#000000015", "Supplier#000000020"])), ("not", ("eq", "s_nationkey", 3)))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 100 AND (s_nationkey < 10 OR s_name IN ('Supplier#000000015', 'Supplier#000000020')) AND NOT s_nationkey = 3")
def f1_metadata_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(S.metadata_filter(_T)).select("s_suppkey", "s_name")


_N = "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END"


@query(f"SELECT s_suppkey, coalesce({_N} <> 5, true) AS ne, coalesce({_N} > 5, false) AS gt, NOT coalesce({_N} > 5, false) AS not_gt, coalesce({_N} IN (1, 5), false) AS inside, NOT coalesce({_N} IN (1, 5), false) AS outside, {_N} IS NULL AS missing FROM supplier")
def f2_filter_nulls(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("n", F.expr(_N))
    f = S.metadata_filter
    return s.select("s_suppkey", f(("ne", "n", 5)).alias("ne"), f(("gt", "n", 5)).alias("gt"), f(("not", ("gt", "n", 5))).alias("not_gt"), f(("in", "n", [1, 5])).alias("inside"), f(("nin", "n", [1, 5])).alias("outside"), f(("isnull", "n")).alias("missing"))


_K = "CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 ELSE event_type > '50' END AS above, {_K} = 'click' AS same FROM events")
def f3_filter_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.col("event_type")))
    return e.select("event_id", S.metadata_filter(("gt", "m", 50)).alias("above"), S.metadata_filter(("eq", "m", "click")).alias("same"))


@query("SELECT * FROM (VALUES ('(s_acctbal >= 100 AND (s_nationkey < 10 OR s_name IN [''Supplier#000000015'', ''Supplier#000000020'']) AND NOT (s_nationkey == 3))')) t(shown)")
def f4_filter_text(spark, sf_dir):
    return spark.createDataFrame([(S.filter_text(_T),)], "shown string")


_DIRECTIVES = [("find mode:vector cats k:5 today", False), ("k:abc plain words", True), ("mode:keyword", True), ("no directives here", False), ("mode:odd k:-3 text", False), ("", True)]


@query("SELECT * FROM (VALUES (0, 'find cats today', 5, 'VECTOR'), (1, 'plain words', 10, 'HYBRID'), (2, '', 10, 'KEYWORD'), (3, 'no directives here', 10, 'KEYWORD'), (4, 'text', 10, 'KEYWORD'), (5, '', 10, 'VECTOR')) t(n, text, k, mode)")
def f18_query_directives(spark, sf_dir):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(_DIRECTIVES)], "n int, query string, has boolean")
    return rows.select("n", *[c.alias(n) for n, c in S.parse_directives(F.col("query"), F.col("has")).items()])


@query("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def t4_pagination(spark, sf_dir):
    return documents(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20).select("doc_id", "n_chars", "source")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def t1_top_k_by_group(spark, sf_dir):
    return S.top_k(documents(spark, sf_dir), 3, F.desc("n_chars"), F.asc("doc_id"), by="source").select("source", "doc_id", "n_chars")


# --- text functions ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({terms_sql('text')}) AS n_terms, array_to_string({terms_sql('text')}[1:20], ' ') AS head FROM documents")
def c1_standard_analyzer(spark, sf_dir):
    t = T.standard_terms(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).alias("n_terms"), F.array_join(F.slice(t, 1, 20), " ").alias("head"))


def stem_sql(w: str) -> str:
    whens = []
    for suffix, least, cut, shrink in T.STEM_RULES:
        c = f"left({w}, length({w}) - {cut})"
        if shrink:
            c = f"CASE WHEN length({c}) >= 2 AND right({c}, 1) = left(right({c}, 2), 1) AND right({c}, 1) NOT IN ('a','e','i','o','u') THEN left({c}, length({c}) - 1) ELSE {c} END"
        whens.append(f"WHEN ends_with({w}, '{suffix}') AND length({w}) >= {least} THEN {c}")
    return f"CASE WHEN length({w}) <= 3 THEN {w} {' '.join(whens)} ELSE {w} END"


@query(f"SELECT doc_id, array_to_string(list_transform({terms_sql('text')}, lambda w: {stem_sql('w')}), ' ') AS stems FROM documents")
def c2_stemming_analyzer(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.stemmed_terms(F.col("text")), " ").alias("stems"))


@query()
def c3_word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS short, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS INTEGER) AS tokens, ceil(length(text) / CAST(4 AS DOUBLE)) > 500 AS long FROM documents")
def c7_text_utilities(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize_whitespace(t).cast("binary")).alias("flat"), T.truncate(t, 80).alias("short"), T.estimate_tokens(t).alias("tokens"), T.exceeds_tokens(t, 500).alias("long"))


def _tags_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(T.TAG_STOP_WORDS))
    words = lambda x, n: rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '[/\\._\-:\s]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > {n} AND NOT list_contains([{stop}], w) AND NOT regexp_full_match(w, '[0-9]+'))"
    return f"""WITH a AS (SELECT doc_id, {words("regexp_replace(regexp_replace('notes/' || source || '/' || lang || '-report.md#chunk-' || CAST(doc_id AS VARCHAR), '(::chunk-[0-9]+|#chunk-[0-9]+)$', ''), '[.]md$', '')", 2)} AS p, {words("left(text, 500)", 4)} AS c FROM documents),
    path AS (SELECT doc_id, p AS raw, list_filter(p, lambda x, i: list_position(p, x) = i) AS p, c FROM a),
    kept AS (SELECT doc_id, p, list_filter(c, lambda x, i: list_position(c, x) = i AND NOT list_contains(p, x)) AS c FROM path),
    best AS (SELECT doc_id, list(w ORDER BY length(w) DESC, i) AS c FROM (SELECT doc_id, unnest(c) AS w, generate_subscripts(c, 1) AS i FROM kept) GROUP BY doc_id)
    SELECT kept.doc_id, array_to_string(list_concat(p, coalesce(best.c, []::VARCHAR[])[1:5])[1:10], ' ') AS tags FROM kept LEFT JOIN best USING (doc_id)"""


@query(_tags_sql())
def c8_content_tags(spark, sf_dir):
    d = documents(spark, sf_dir)
    name = F.concat(F.lit("notes/"), "source", F.lit("/"), "lang", F.lit("-report.md#chunk-"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.array_join(T.content_tags(name, F.col("text")), " ").alias("tags"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 6")
def c9_levenshtein(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("ka", "a"), n.toDF("kb", "b")
    d = F.levenshtein("a", "b", 6)
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).where(d >= 0).select("a", "b", d.alias("distance"))



@query(f"WITH z AS (SELECT embedding AS z FROM embeddings WHERE vec_id = 5) SELECT vec_id, {r6(dot_sql('embedding', 'z'))} AS dot, {r6(l2_sql('embedding', 'z'))} AS l2, {r6(f'{dot_sql('embedding', 'z')} / (sqrt({dot_sql('embedding', 'embedding')}) * sqrt({dot_sql('z', 'z')}))')} AS cosine FROM embeddings, z")
def c10_distances(spark, sf_dir):
    z = query_vectors(spark, sf_dir, 5)
    e, q = F.col("embedding"), F.col("vector")
    return table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(z)).select("vec_id", S.rounded(V.dot(e, q)).alias("dot"), S.rounded(V.distance(e, q)).alias("l2"), S.rounded(V.cosine(e, q)).alias("cosine"))


@query(f"SELECT vec_id, {r6('sqrt(' + dot_sql('embedding', 'embedding') + ')')} AS magnitude, {r6('CAST(embedding[1] AS DOUBLE) / sqrt(' + dot_sql('embedding', 'embedding') + ')')} AS first_unit, {r6('list_sum([CAST(x AS DOUBLE) * 2.5::DOUBLE FOR x IN embedding])')} AS scaled_sum, {r6('list_sum([CAST(x AS DOUBLE) + CAST(x AS DOUBLE) FOR x IN embedding])')} AS added_sum FROM embeddings")
def c13_vector_ops(spark, sf_dir):
    e = F.col("embedding")
    total = lambda v: S.rounded(F.aggregate(v, F.lit(0.0), lambda a, x: a + x))
    return table(spark, sf_dir, "embeddings").select("vec_id", S.rounded(V.norm(e)).alias("magnitude"), S.rounded(F.element_at(V.normalize(e), 1)).alias("first_unit"), total(V.scale(e, 2.5)).alias("scaled_sum"), total(V.add(e, e)).alias("added_sum"))


# --- contexts and reranking ---------------------------------------------------------------------------


def packed_sql(hits: str, budget: int) -> str:
    """Greedy contexts of hits(qid, id, score), by recursion over each query's documents; needs WITH RECURSIVE."""
    return f"""{hits}, ch AS (SELECT qid, id, text, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS INTEGER) AS t, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS n FROM hit JOIN documents ON doc_id = id),
     pk AS (SELECT DISTINCT qid, 0::BIGINT AS n, 0 AS used, []::VARCHAR[] AS texts, []::VARCHAR[] AS ids FROM ch
       UNION ALL SELECT pk.qid, ch.n, CASE WHEN used + t <= {budget} THEN used + t ELSE used END, CASE WHEN used + t <= {budget} THEN list_append(texts, text) ELSE texts END, CASE WHEN used + t <= {budget} THEN list_append(ids, CAST(id AS VARCHAR)) ELSE ids END FROM pk JOIN ch ON ch.qid = pk.qid AND ch.n = pk.n + 1)
    SELECT qid, used AS tokens, array_to_string(ids, ',') AS sources, array_to_string(texts, chr(10) || chr(10)) AS context FROM (SELECT *, max(n) OVER (PARTITION BY qid) AS last FROM pk) WHERE n = last"""


@query("WITH RECURSIVE " + packed_sql(f"{bm25_sql()}, hit AS ({topk_sql('bm', 20)})", 1024))
def r4_context_packing(spark, sf_dir):
    hits = S.bm25(documents(spark, sf_dir), query_texts(spark), 20)
    found = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").join(S.small(hits.select("qid", "id", "score")), "id")
    return S.pack_context(found, 1024, T.estimate_tokens(F.col("text")))


@query("WITH RECURSIVE " + packed_sql(f"""{bm25_sql()}, {knn_cte('dot', '0, 1, 2, 3')}, a AS ({topk_sql('bm', 50)}), b AS ({topk_sql('near', 50)}),
 f AS (SELECT qid, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM a UNION ALL SELECT qid, id, rank FROM b) GROUP BY qid, id), hit AS ({topk_sql('f', 5)})""", 2048))
def r5_rag(spark, sf_dir):
    queries = query_texts(spark).join(query_vectors(spark, sf_dir, 0, 1, 2, 3), "qid")
    return S.rag(documents(spark, sf_dir), vectors(spark, sf_dir), queries, 5, 2048, "hybrid", T.estimate_tokens(F.col("text")))


def token_rows(spark, sf_dir):
    """Late-interaction input: a vector's four quarters stand for token vectors."""
    e = F.col("embedding")
    return F.array(*[F.slice(e, 1 + 16 * i, 16) for i in range(4)])


def _quarters(x: str) -> str:
    return "[" + ", ".join(f"{x}[{1 + 16 * i}:{16 + 16 * i}]" for i in range(4)) + "]"


@query(f"""WITH {knn_cte('dot')}, c AS ({topk_sql('near', 20)}), p AS (SELECT c.qid, c.id, c.score, {_quarters('q.embedding')} AS qt, {_quarters('d.embedding')} AS dt FROM c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings d ON d.vec_id = c.id),
 m AS (SELECT qid, id, {r6("0.7::DOUBLE * list_sum([list_max([" + dot_sql('a', 'b') + " FOR b IN dt]) FOR a IN qt]) / 4 + 0.3::DOUBLE * score")} AS score FROM p) {topk_sql('m', 10)}""")
def r30_late_interaction(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = S.knn(v, query_vectors(spark, sf_dir, 0, 7, 42), 20, "dot")
    tokens = v.select("id", token_rows(spark, sf_dir).alias("doc_tokens"))
    asked = v.where(F.col("id").isin(0, 7, 42)).select(F.col("id").alias("qid"), token_rows(spark, sf_dir).alias("query_tokens"))
    return S.late_interaction(hits.select("qid", "id", "score").join(tokens, "id").join(F.broadcast(asked), "qid"), 10)


_ANSWERS = "(VALUES (0, 1, 3.0), (0, 2, 9.0), (0, 3, 9.5), (0, 4, 0.0), (0, 5, 7.0), (2, 1, 8.0), (2, 2, 8.0), (2, 3, 8.0)) a(qid, rank, rating)"


@query(f"WITH {bm25_sql()}, h AS ({topk_sql('bm', 5)}), x AS (SELECT h.qid, h.id, h.rank AS before, CAST(coalesce(a.rating, -1) AS DOUBLE) AS rating FROM h LEFT JOIN {_ANSWERS} USING (qid, rank)) {topk_sql('x', 5, 'rating DESC, before, id', columns='qid, id, rating, before')}")
def r32_model_rerank(spark, sf_dir):
    hits = S.bm25(documents(spark, sf_dir), query_texts(spark), 5)
    answers = spark.createDataFrame([(0, "1: 3\n2: 9\n3: 9.5\n4: 0\n5: 7"), (1, "no idea"), (2, "8\n8\n8")], "qid long, answer string")
    return S.rerank_with_model(hits, answers, 5).select("qid", "id", "rating", "before", "rank")


@query(f"WITH {bm25_sql()}, h AS ({topk_sql('bm', 10)}) SELECT qid, id, rank, lang, n_chars FROM h JOIN documents ON doc_id = id WHERE lang <> 'fr'")
def j1_hits_with_documents(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = S.bm25(d, query_texts(spark), 10)
    return d.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), "lang", "n_chars").join(S.small(hits), "id").select("qid", "id", "rank", "lang", "n_chars")


@query(f"WITH {knn_cte('dot')}, a AS ({topk_sql('near', 10)}), b AS ({topk_sql('(SELECT qid, id, score * 1.5::DOUBLE AS score FROM near WHERE id % 2 = 0)', 10)}) SELECT qid, id, {r6('max(score)')} AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, id")
def u2_union_keeping_best(spark, sf_dir):
    near = S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 0, 7, 42), "dot")
    top = lambda df: S.top_k(df, 10, F.desc("score"), F.asc("id"))
    both = top(near).unionByName(top(near.where("id % 2 = 0").withColumn("score", F.col("score") * 1.5)))
    return both.groupBy("qid", "id").agg(S.rounded(F.max("score")).alias("score"))


@query(f"WITH {knn_cte('l2', '7')} SELECT id, score FROM near ORDER BY score, id LIMIT 12")
def t3_ascending_distances(spark, sf_dir):
    return S.similarities(vectors(spark, sf_dir), query_vectors(spark, sf_dir, 7), "l2").orderBy("score", "id").limit(12).select("id", "score")
