"""Queries on readers, stores, chunkers, identifiers, model boundaries and streams."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from larkspur.functions import chunks as C
from larkspur.functions import providers as P
from larkspur.functions import text as T
from larkspur.operators import search as S
from larkspur.plans.registry import query
from larkspur.plans.tables import MEM, documents, memories, r6, table
from larkspur.sources import readers as R
from larkspur.session import scratch_dir, ship_package
from larkspur.sources import stores as K
from larkspur.streaming import streams as X


@query("SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' v2' ELSE '' END AS name FROM customer WHERE c_custkey % 10 <> 0")
def s1_document_store(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    first = c.withColumns({"version": F.lit(1), "deleted": F.lit(False)})
    second = c.where("id % 3 = 0").select("id", F.concat("name", F.lit(" v2")).alias("name"), F.lit(2).alias("version"), F.lit(False).alias("deleted"))
    gone = c.where("id % 10 = 0").select("id", "name", F.lit(3).alias("version"), F.lit(True).alias("deleted"))
    return K.latest(first.unionByName(second).unionByName(gone), "id", "version", "deleted").select("id", "name")


@query(f"SELECT vec_id AS id, len(embedding) AS dims, {r6('embedding[1]')} AS first FROM embeddings WHERE vec_id IN (0, 17, 99)")
def s2_vector_store(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(0, 17, 99)).select(F.col("vec_id").alias("id"), F.size(e).cast("long").alias("dims"), S.rounded(F.element_at(e, 1).cast("double")).alias("first"))


@query("SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings")
def s4_sharded_store(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return K.write_sharded(v, scratch_dir(spark, "shards"), 8).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_MD = r"'# Report ' || CAST(doc_id AS VARCHAR) || chr(10) || 'See [the **site**](http://x.org) and ![img](a.png) `code`.' || chr(10) || '- item one' || chr(10) || '2. item two' || chr(10) || '> quoted ~~old~~' || chr(10) || '---' || chr(10) || lang"


def markdown_rows(spark, sf_dir):
    lines = ["See [the **site**](http://x.org) and ![img](a.png) `code`.", "- item one", "2. item two", "> quoted ~~old~~", "---"]
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("# Report "), F.col("doc_id").cast("string"), F.lit("\n" + "\n".join(lines) + "\n"), "lang").alias("md"))


@query("SELECT doc_id, 'Report ' || CAST(doc_id AS VARCHAR) AS title, 'doc' AS fallback FROM documents")
def s8_title(spark, sf_dir):
    m = markdown_rows(spark, sf_dir)
    return m.select("doc_id", R.title_of(F.col("md"), F.lit("/a/doc.md")).alias("title"), R.title_of(F.lit("no heading"), F.lit("/a/doc.md")).alias("fallback"))


def html_sql(x: str) -> str:
    t = rf"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{R.BLOCKS})(?:\s[^>]*|/)?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for name, char in R.ENTITIES:
        t = f"replace({t}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


@query(f"SELECT page_id, md5({html_sql('html')}) AS text_md5, length({html_sql('html')}) AS n FROM pages")
def s9_html_reader(spark, sf_dir):
    t = R.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n"))


@query("SELECT doc_id, '# Report ' || CAST(doc_id AS VARCHAR) || chr(10) || 'See the site and img code.' || chr(10) || 'item one' || chr(10) || 'item two' || chr(10) || 'quoted old' || chr(10) || lang AS text FROM documents")
def s10_markdown_reader(spark, sf_dir):
    return markdown_rows(spark, sf_dir).select("doc_id", R.markdown_text(F.col("md")).alias("text"))


def a_pdf(lines: list[str], deflate: bool) -> bytes:
    body = ("BT /F1 12 Tf 72 720 Td " + " 0 -20 Td ".join(f"({x}) Tj" for x in lines) + " ET").encode()
    body = zlib.compress(body) if deflate else body
    return b"%%PDF-1.4\n1 0 obj <</Length %d>>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n%%EOF"


@query("SELECT * FROM (VALUES ('/a.pdf', 'one' || chr(10) || chr(10) || 'two'), ('/b.pdf', 'three (3)'), ('/c.pdf', '')) t(path, text)")
def s11_pdf_reader(spark, sf_dir):
    files = spark.createDataFrame([("/a.pdf", bytearray(a_pdf(["one", "two"], True))), ("/b.pdf", bytearray(a_pdf([r"three \(3\)"], False))), ("/c.pdf", bytearray(b"%PDF"))], "path string, content binary")
    return R.read_pdfs(files)


@query("SELECT * FROM (VALUES ('/a.html', 'HTML', 'a', 'x' || chr(10) || 'y'), ('/b.md', 'MARKDOWN', 'T', '# T' || chr(10) || 'z'), ('/c.txt', 'TEXT', 'c', 'plain'), ('/d.bin', 'UNKNOWN', 'd', NULL), ('/e.json', 'STRUCTURED', 'e', 'v')) t(path, format, title, text)")
def s12_reader_dispatch(spark, sf_dir):
    rows = [("/a.html", b"<p>x</p><p>y</p>", "html"), ("/b.md", b"# T\n- z", "md"), ("/c.txt", b"plain", "txt"), ("/d.bin", b"\x00", "bin"), ("/e.json", b'{"k": "v"}', "json")]
    return R.read_documents(spark.createDataFrame([(p, bytearray(c), e) for p, c, e in rows], "path string, content binary, extension string"))


@query()
def s7_file_discovery(spark, sf_dir):
    return R.discover(spark, sf_dir, ["parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


@query("SELECT * FROM (VALUES ('/a.png', 'caption of 3 bytes', NULL), ('/b.wav', NULL, 'ValueError: no sound')) t(path, text, error)")
def s14_injected_extractor(spark, sf_dir):
    def extractor(content, path):
        if path.endswith(".wav"):
            raise ValueError("no sound")
        return f"caption of {len(content)} bytes"

    return R.extract_with(spark.createDataFrame([("/a.png", bytearray(b"abc")), ("/b.wav", bytearray(b""))], "path string, content binary"), extractor)


@query("SELECT CAST(doc_id AS VARCHAR) || '#attachment-' || CAST(i AS VARCHAR) AS id, doc_id AS parent_id, 'u' || CAST(i AS VARCHAR) AS uri, text || CASE WHEN i = 1 THEN ' (copy)' ELSE '' END AS text FROM documents, (VALUES (0), (1)) t(i)")
def s16_attachments(spark, sf_dir):
    a = F.array(*[F.struct(F.lit(f"u{i}").alias("uri"), (F.concat("text", F.lit(" (copy)")) if i else F.col("text")).alias("text")) for i in range(2)])
    return R.expand_attachments(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), a.alias("attachments")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Tom & Co ' || event_type WHEN 1 THEN event_type || ' b' WHEN 2 THEN event_type ELSE 'plain ' || event_type END AS text FROM events")
def s17_structured_text(spark, sf_dir):
    t = F.col("event_type")
    xml = F.concat(F.lit("<a><b>Tom &amp; Co</b> <![CDATA["), t, F.lit("]]></a>"))
    json = F.concat(F.lit('{"k": "'), t, F.lit('", "n": 3, "l": ["b"]}'))
    obj = F.concat(F.lit("Thing{kind="), t, F.lit(", n=12, ok=true}"))
    raw = F.when(F.col("event_id") % 4 == 0, xml).when(F.col("event_id") % 4 == 1, json).when(F.col("event_id") % 4 == 2, obj).otherwise(F.concat(F.lit("plain "), t))
    return table(spark, sf_dir, "events").select("event_id", T.structured_text(raw).alias("text"))


@query("SELECT n_nationkey, n_name FROM nation")
def s19_snapshots(spark, sf_dir):
    store = K.Snapshots(spark, scratch_dir(spark, "snapshots"))
    store.save("team", "before", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    assert store.names("team") == ["before"]
    return store.restore("team", "before")


@query("""SELECT '{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def s20_json_export(spark, sf_dir):
    return K.to_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT * FROM (VALUES ('s1', 'a', 'b'), ('s1', 'b', 'c')) t(sessionId, id, next_id)")
def s21_graph_import(spark, sf_dir):
    folder = scratch_dir(spark, "graph")
    for name, lines in {"hebbian_edges": ['{"memoryIdA": "a", "memoryIdB": "b", "coActivationCount": 2}'], "temporal_chains": ['{"sessionId": "s1", "orderedMemoryIds": ["a", "b", "c"]}', '{"sessionId": "s2", "orderedMemoryIds": ["d"]}']}.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/{name}.jsonl")
    return K.read_graph(spark, folder)["next"]


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def s22_integrity(spark, sf_dir):
    return K.integrity(table(spark, sf_dir, "labels"), "doc_id", documents(spark, sf_dir).where("doc_id % 7 <> 0"), "doc_id").select("doc_id", "quality")


# --- chunkers and identifiers ----------------------------------------------------------------------------


def _chunker(name: str, cut, separator: str = "::chunk-"):
    @query(name=name)
    def run(spark, sf_dir):
        return C.chunk(documents(spark, sf_dir), cut, separator).select("doc_id", "chunk_id", "start_char", "end_char", "tokens")


_chunker("c4_char_chunks", C.char_chunks)
_chunker("c5_token_chunks", C.token_chunks)
_chunker("c5_token_chunks_by_suffix", lambda t: C.token_chunks(t, 64, 8), "#chunk-")
_chunker("c6_streaming_chunks", C.streaming_chunks)


def _times(a: str, b: int) -> str:
    """A product that wraps around at 64 bits."""
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


_ODD = "9223372036854775808::UBIGINT"


@query(f"""WITH {MEM}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM mem),
 h AS MATERIALIZED (SELECT tag, list_reduce(list_prepend({0xCBF29CE484222325}::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(lower(tag), '')]), lambda h, b: {_times('xor(h, b)', 0x100000001B3)}) AS a FROM t),
 h2 AS MATERIALIZED (SELECT tag, a, xor(a, {0x9E3779B97F4A7C15}::UBIGINT) AS b FROM h),
 f AS MATERIALIZED (SELECT tag, {_times('xor(a, a >> 33)', 0xFF51AFD7ED558CCD)} AS a, {_times('xor(b, b >> 33)', 0xFF51AFD7ED558CCD)} AS b FROM h2),
 g AS MATERIALIZED (SELECT tag, {_times('xor(a, a >> 33)', 0xC4CEB9FE1A85EC53)} AS a, {_times('xor(b, b >> 33)', 0xC4CEB9FE1A85EC53)} AS b FROM f),
 w AS MATERIALIZED (SELECT tag, CAST(xor(a, a >> 33) % 64 AS INTEGER) AS one, CAST((xor(b, b >> 33) | 1::UBIGINT) % 64 AS INTEGER) AS two FROM g),
 m AS MATERIALIZED (SELECT tag, bit_or(CAST(pow(CAST(2 AS DOUBLE), (one + i * two) % 64) AS UBIGINT)) AS mask FROM w, (VALUES (0), (1), (2)) n(i) GROUP BY tag),
 o AS (SELECT id, bit_or(mask) AS mask FROM (SELECT id, unnest(tags) AS tag FROM mem) JOIN m USING (tag) GROUP BY id)
 SELECT id, CAST(CASE WHEN mask >= {_ODD} THEN mask::HUGEINT - 18446744073709551616::HUGEINT ELSE mask::HUGEINT END AS BIGINT) AS mask FROM o""")
def c14_tag_masks(spark, sf_dir):
    return C.with_tag_masks(memories(spark, sf_dir))


@query(f"WITH {MEM}, v AS (SELECT id, ((ts_ms - 1577836800000) << 22) | (1 << 12) | (id & 4095) AS v FROM mem) SELECT id, array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((v >> (5 * i)) & 31 AS INTEGER) + 1, 1) FOR i IN range(12, -1, -1)], '') AS tsid FROM v")
def c19_time_sorted_ids(spark, sf_dir):
    ship_package(spark)

    @F.pandas_udf("string")
    def make(ms: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([C.time_sorted_id(a, 1, b) for a, b in zip(ms, n)])

    return memories(spark, sf_dir).select("id", make("ts_ms", "id").alias("tsid"))


@query("WITH ring AS (SELECT s AS shard, ('0x' || left(md5('shard-' || CAST(s AS VARCHAR) || '-vnode-' || CAST(r AS VARCHAR)), 16))::UBIGINT AS p FROM range(8) a(s), range(150) b(r)), d AS (SELECT doc_id, ('0x' || left(md5(CAST(doc_id AS VARCHAR)), 16))::UBIGINT AS p FROM documents) SELECT doc_id, CAST(coalesce(r.shard, (SELECT arg_min(shard, p) FROM ring)) AS INTEGER) AS shard FROM d ASOF LEFT JOIN ring r ON d.p <= r.p")
def c20_ring_shards(spark, sf_dir):
    ship_package(spark)

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(C.ring_shards(keys.tolist(), 8))

    return documents(spark, sf_dir).select("doc_id", shard(F.col("doc_id").cast("string")).alias("shard"))


@query("SELECT * FROM (VALUES (1, 'a,b c', 'ann:PERSON'), (2, 'x,y', ''), (3, 'p', 'b:CONCEPT')) t(n, tags, entities)")
def c21_model_json(spark, sf_dir):
    rows = spark.createDataFrame([(1, 'Tags: ["A", "b c", "a"]', '[{"name": " Ann ", "type": "person"}]'), (2, "x, Y", "nothing"), (3, '["p"]', '[{"name": "B"}, {"name": ""}]')], "n int, t string, e string")
    shown = F.transform(P.parse_entities(F.col("e")), lambda x: F.concat(x["name"], F.lit(":"), x["type"]))
    return rows.select("n", F.array_join(P.parse_tags(F.col("t")), ",").alias("tags"), F.array_join(shown, ",").alias("entities"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE length(text) END AS first, CASE WHEN doc_id % 5 = 0 THEN 'no result' END AS error FROM documents")
def p13_model_with_errors(spark, sf_dir):
    def model(texts):
        if any(t.startswith("!") for t in texts):
            raise ValueError("no result")
        return [[float(len(t))] for t in texts]

    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text")).alias("text"))
    return P.apply_model(d, model).select("id", F.element_at("result", 1).cast("long").alias("first"), "error")


@query("SELECT doc_id AS id, CAST(map_size AS INTEGER) AS terms FROM (SELECT doc_id, len(list_distinct(string_split(lower(coalesce(text, '')), ' '))) AS map_size FROM documents)")
def p2_sparse_model(spark, sf_dir):
    def model(texts):
        return [{w: 1.0 for w in t.lower().split(" ")} for t in texts]

    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return P.apply_model(d, model, "sparse").select("id", F.size("result").alias("terms"))


# --- streams -------------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name: str):
    return X.stream_table(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema)


@query()
def x1_stream_chunks(spark, sf_dir):
    out, state = scratch_dir(spark, "chunks"), scratch_dir(spark, "state")
    X.run_available(X.file_chunks(_stream(spark, sf_dir, "documents")), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), state)
    return spark.read.parquet(out).select("doc_id", "chunk_id", "start_char", "end_char")


@query("WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, count(*) AS n, round(sum(value), 4) AS value, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, s")
def x4_stream_sessions(spark, sf_dir):
    out, state = scratch_dir(spark, "sessions"), scratch_dir(spark, "state")
    e = _stream(spark, sf_dir, "events")
    X.run_available(X.session_counts(e), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), state, "complete")
    last = spark.read.parquet(out)
    newest = last.agg(F.max("batch")).first()[0]
    return last.where(F.col("batch") == newest).select("user_id", "n", F.round("value", 4).alias("value"), F.unix_micros("start").alias("start_us"))


@query()
def x5_stream_state(spark, sf_dir):
    out, state = scratch_dir(spark, "recalls"), scratch_dir(spark, "state")
    e = _stream(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"))
    X.run_available(X.recall_state(e), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), state)
    return spark.read.parquet(out).groupBy("id").agg(F.max("auto_recalls").alias("auto_recalls"), F.count_if("inhibited").alias("inhibited"))


@query("SELECT event_id, user_id, event_type FROM events")
def x7_log_export(spark, sf_dir):
    out, state = scratch_dir(spark, "log"), scratch_dir(spark, "state")
    X.export_log(_stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), out, state)
    return spark.read.parquet(out).drop("batch")


@query("SELECT count(*) AS n, true AS trained FROM embeddings")
def x9_train_then_flush(spark, sf_dir):
    from larkspur.operators import ann

    out, state, done = scratch_dir(spark, "index"), scratch_dir(spark, "state"), scratch_dir(spark, "waiting")
    flush = lambda centres, df: df.select(F.col("id"), F.element_at(ann.nearest_cells(F.col("embedding"), centres, 1), 1).alias("cell")).write.mode("append").parquet(out)
    sink = X.TrainThenFlush(done, 256, lambda df: ann.kmeans(df, 4), flush)
    X.run_available(_stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), sink, state)
    return spark.read.parquet(out).agg(F.count("*").alias("n"), (F.max("cell") >= 0).alias("trained"))

