"""Keyword, vector, sparse and hybrid search; every operator takes a set of queries (qid, ...)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.providers import apply_model
from larkspur.functions import vectors as V
from larkspur.operators import batched as B
from larkspur.session import scratch_dir

#: Broadcast a side of this many rows at most; beyond it the optimizer chooses.
MOST_BROADCAST = 100_000
#: Terms of queries that a document's terms are compared with in its row; more are joined.
MOST_LISTED = 1000
#: Digits that a score is rounded to before ranking, so that engines that sum in another order agree.
DIGITS = 6


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if its size, which is counted, allows it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint; a side that every row of a table meets must be a stated set of bounded size."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} rows; process larger sets in blocks")
    return F.broadcast(df)


def rounded(c: Column) -> Column:
    return F.round(c, DIGITS) + F.lit(0.0)


def top_k(df: DataFrame, k: int, *order: Column, by: str | list[str] = "qid") -> DataFrame:
    """The first k rows of each group with their rank; Spark limits groups before the shuffle."""
    keys = [by] if isinstance(by, str) else by
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


# --- keyword -----------------------------------------------------------------------------------------


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: Callable[[Column], Column] = T.standard_terms) -> DataFrame:
    """(id, term, tf, length)."""
    return counted(exploded(docs, id_col, text_col, analyzer))


def exploded(docs: DataFrame, id_col: str, text_col: str, analyzer: Callable[[Column], Column]) -> DataFrame:
    """(id, length, term) of every place of a term."""
    terms = docs.select(F.col(id_col).alias("id"), analyzer(F.col(text_col)).alias("terms"))
    return terms.select("id", F.size("terms").alias("length"), F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())


def counted(each: DataFrame, *dealt: str) -> DataFrame:
    """Postings of places of terms; rows that are dealt by these columns of the term stay where they are."""
    return each.groupBy(*dealt, "id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_stats(docs: DataFrame, text_col: str = "text", analyzer: Callable[[Column], Column] = T.standard_terms) -> DataFrame:
    """(n_docs, total_length, average_length) in one row."""
    size = F.size(analyzer(F.col(text_col)))
    return docs.agg(F.count("*").alias("n_docs"), F.sum(size).cast("long").alias("total_length"), F.avg(size).alias("average_length"))


def kept_at_rest(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder; as it is where a cluster has no such folder."""
    try:
        path = scratch_dir(df.sparkSession, "kept")
    except ValueError:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    k1: float = 1.2,
    b: float = 0.75,
    analyzer: Callable[[Column], Column] = T.standard_terms,
    partition: str | None = None,
) -> DataFrame:
    """(qid, id, score, rank) of queries (qid, query); a repeated query term counts each time.

    Terms that no query has are dropped before anything is shuffled. With `partition` statistics are those
    of each partition, and ranks are over all of them. Texts are analyzed once: lengths and the wanted terms of each
    document lie in the shared folder then, since statistics, counts and callers read them several times.
    """
    part = F.col(partition) if partition else F.lit(0)
    terms = docs.select(F.col(id_col).alias("id"), part.alias("part"), analyzer(F.col(text_col)).alias("terms"))
    wanted = queries.select("qid", F.explode(analyzer(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # one count serves both joins
    asked = F.broadcast(wanted) if few else wanted
    words = wanted.select("term").distinct()
    listed = [r.term for r in words.limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:
        kept = kept_at_rest(terms.select("id", "part", F.size("terms").alias("length"), F.filter("terms", lambda t: t.isin(listed)).alias("terms")))
        stats = kept.groupBy("part").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
        found = kept.select("id", "part", "length", F.explode("terms").alias("term"))
    else:
        stats = terms.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("average"))
        words = F.broadcast(words) if few else words
        found = terms.select("id", "part", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(words, "term", "left_semi")
    tf = found.groupBy("part", "id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("part", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    # without partitions there is one row of df a wanted term and one of stats
    one = partition is None
    scored = tf.join(F.broadcast(df) if one and few else df, ["part", "term"]).join(F.broadcast(stats) if one else stats, "part").join(asked, "term")
    total = scored.groupBy("qid", "id").agg(rounded(F.sum(weight * F.col("times"))).alias("score")).where(F.col("score") > 0)
    return top_k(total, k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


@dataclass(frozen=True)
class TextIndex:
    """Postings at rest, in one folder a term bucket, so that a search reads the buckets of its terms only."""

    spark: SparkSession
    path: str
    buckets: int
    analyzer: Callable[[Column], Column] = T.standard_terms

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", analyzer: Callable[[Column], Column] = T.standard_terms) -> TextIndex:
        """One read for the postings, one for lengths; terms of a bucket lie sorted, so files skip row groups too.

        A bucket's terms are dealt to several tasks, each with a file, so that none sorts more than memory holds. Terms
        are counted where they are dealt, so that they are shuffled once.
        """
        index = cls(docs.sparkSession, path, buckets, analyzer)
        tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = max(4, -(-2 * tasks // buckets))
        each = exploded(docs, id_col, text_col, analyzer).withColumns({"bucket": index.bucket(F.col("term")), "file": F.pmod(F.xxhash64("term", F.lit(5)), F.lit(files))})
        listed = counted(each.repartition(tasks, "bucket", "file"), "bucket", "file").drop("file")
        listed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        corpus_stats(docs, text_col, analyzer).write.mode("overwrite").parquet(f"{path}/stats")
        return index

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(qid, id, score, rank) as `bm25` gives them."""
        wanted = queries.select("qid", F.explode(self.analyzer(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        # as many rows as the index has buckets, at most
        used = [r.bucket for r in wanted.select(self.bucket(F.col("term")).alias("bucket")).distinct().collect()]
        few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # one count serves all joins
        words = F.broadcast(wanted.select("term").distinct()) if few else wanted.select("term").distinct()
        tf = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(used)).join(words, "term", "left_semi")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        stats = self.spark.read.parquet(f"{self.path}/stats").select(F.col("n_docs").alias("n"), F.col("average_length").alias("average"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
        scored = tf.join(F.broadcast(df) if few else df, "term").join(F.broadcast(wanted) if few else wanted, "term").crossJoin(F.broadcast(stats))  # stats: one row
        total = scored.groupBy("qid", "id").agg(rounded(F.sum(weight * F.col("times"))).alias("score")).where(F.col("score") > 0)
        return top_k(total, k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


def sparse_search(weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dot products over shared terms: weights (id, term, weight), queries (qid, term, weight)."""
    q = queries.select("qid", "term", F.col("weight").alias("q"))
    scored = weights.join(small(q), "term").groupBy("qid", "id").agg(rounded(F.sum(F.col("weight") * F.col("q"))).alias("score"))
    return top_k(scored.where(F.col("score") > 0), k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


def fallback_weights(docs: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """Sparse weights where no encoder is at hand: log(1 + occurrences) of lower-cased words."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least)
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.log(F.lit(1.0) + F.count("*")).alias("weight"))


# --- vectors -----------------------------------------------------------------------------------------

METRICS = {"dot": (V.dot, False), "cosine": (V.cosine, False), "l2": (V.distance, True), "l2sq": (V.squared_distance, True)}


def similarities(vectors: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """(qid, id, score) of a stated query set against all vectors (id, embedding); queries are (qid, vector)."""
    function, _ = METRICS[metric]
    return vectors.crossJoin(bounded(queries)).select("qid", "id", rounded(function(F.col("embedding"), F.col("vector"))).alias("score"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exact nearest neighbours (qid, id, score, rank): one scan for each block of queries, which every worker holds."""
    ascending = METRICS[metric][1]
    order = F.asc("score") if ascending else F.desc("score")
    found = B.scan(vectors.select("id", "embedding"), queries, k, ascending, lambda asked: (B.exact(metric), None))
    return top_k(found.select("qid", "id", rounded(F.col("score")).alias("score")), k, order, F.asc("id"))


def rescored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Second step of an approximate search: exact distances of candidates (qid, id), ascending."""
    exact = candidates.select("qid", "id").distinct().join(vectors, "id").join(small(queries), "qid")
    scored = exact.select("qid", "id", rounded(V.distance(F.col("embedding"), F.col("vector"))).alias("score"))
    return top_k(scored, k, F.asc("score"), F.asc("id"))


# --- fusion ------------------------------------------------------------------------------------------


def rrf(ranked: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, id, rank) of any number of lists."""
    fused = ranked.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return top_k(fused, k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", metric: str = "dot") -> DataFrame:
    """Keyword and vector search fused by rank; a query without text or vector uses the other side alone.

    queries: (qid, query, vector). Result: (qid, id, score, rank, bm25_rank, vector_rank).
    """
    reach = max(2 * k, 50)
    words = bm25(docs, queries.where(F.length(F.trim("query")) > 0).select("qid", "query"), reach, id_col)
    near = knn(vectors, queries.where(F.col("vector").isNotNull()).select("qid", "vector"), reach, metric)
    both = words.select("qid", "id", "rank", F.lit(0).alias("list")).unionByName(near.select("qid", "id", "rank", F.lit(1).alias("list")))
    of = lambda n: F.max(F.when(F.col("list") == n, F.col("rank")))
    fused = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), of(0).alias("bm25_rank"), of(1).alias("vector_rank"))
    return top_k(fused, k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank", "bm25_rank", "vector_rank")


def merge_shards(hits: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """Hits (qid, id, score) of several shards: the best score of each id, in the metric's direction."""
    best = F.min("score") if ascending else F.max("score")
    merged = hits.groupBy("qid", "id").agg(best.alias("score"))
    return top_k(merged, k, F.asc("score") if ascending else F.desc("score"), F.asc("id"))


# --- context packing and reranking -------------------------------------------------------------------


def pack_context(chunks: DataFrame, budget: int, tokens: Column | None = None, separator: str = "\n\n") -> DataFrame:
    """Greedy contexts of chunks (qid, id, text, score): best first, what doesn't fit is skipped.

    A query's chunks are the retrieved ones, so a group is at most as large as the search's k.
    """
    if not 256 <= budget <= 131_072:
        raise ValueError("the token budget lies between 256 and 131072")
    count = T.word_count(F.col("text")) if tokens is None else tokens
    listed = chunks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "text", count.alias("tokens")))).alias("chunks"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<string>").alias("ids"))

    def add(acc: Column, c: Column) -> Column:
        fits = acc["used"] + c["tokens"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + c["tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["texts"], F.array(c["text"]))).otherwise(acc["texts"]).alias("texts"),
            F.when(fits, F.concat(acc["ids"], F.array(c["id"].cast("string")))).otherwise(acc["ids"]).alias("ids"),
        )

    packed = listed.withColumn("p", F.aggregate("chunks", zero, add))
    return packed.select("qid", F.col("p.used").alias("tokens"), F.array_join("p.ids", ",").alias("sources"), F.array_join("p.texts", separator).alias("context"))


def rag(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, budget: int = 4096, mode: str = "vector", tokens: Column | None = None) -> DataFrame:
    """Retrieval-augmented contexts: search, join documents (missing ones drop out), pack.

    queries: (qid, query, vector); queries over 2000 characters are refused by leaving them out.
    """
    k = min(100, max(1, k))
    asked = queries.where(F.length("query") <= 2000)
    if mode == "hybrid":
        hits = hybrid(docs, vectors, asked, k)
    elif mode == "keyword":
        hits = bm25(docs, asked.select("qid", "query"), k)
    else:
        hits = knn(vectors, asked.select("qid", "vector"), k, "cosine")
    found = docs.select(F.col("doc_id").alias("id"), "text").join(small(hits.select("qid", "id", "score")), "id")
    return pack_context(found, budget, tokens)


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: the best dot product of each query token, averaged."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: V.dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(query_tokens)


def late_interaction(candidates: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """Rerank (qid, id, score, query_tokens, doc_tokens) by alpha * max_sim + (1 - alpha) * score."""
    mixed = candidates.withColumn("score", rounded(alpha * max_sim(F.col("query_tokens"), F.col("doc_tokens")) + (1 - alpha) * F.col("score")))
    return top_k(mixed, k, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


@dataclass(frozen=True)
class TokenCache:
    """Token vectors at rest by id and hash of the text; only texts that aren't there are encoded."""

    spark: SparkSession
    path: str
    encoder: Callable[[list[str]], list]

    def get(self, docs: DataFrame) -> DataFrame:
        """(id, tokens, cached) of docs (id, text); what was missing is in the cache afterwards."""
        schema = "id long, text_hash long, tokens array<array<float>>"
        wanted = docs.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
        made = sorted(self._batches())
        known = self.spark.read.schema(schema).parquet(*made) if made else self.spark.createDataFrame([], schema)
        known = known.dropDuplicates(["id", "text_hash"])
        missing = wanted.join(known.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
        encoded = apply_model(missing.select("id", "text"), self.encoder, "tokens").where("error is null").join(missing.select("id", "text_hash"), "id")
        fresh = f"{self.path}/batch-{len(made)}"
        encoded.select("id", "text_hash", F.col("result").alias("tokens")).write.parquet(fresh)
        both = known.withColumn("cached", F.lit(True)).unionByName(self.spark.read.schema(schema).parquet(fresh).withColumn("cached", F.lit(False)))
        return wanted.select("id", "text_hash").join(both, ["id", "text_hash"]).select("id", "tokens", "cached")

    def _batches(self) -> list[str]:
        """Folders of earlier calls, through the file system that the path names."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in fs.listStatus(path)] if fs.exists(path) else []


def parse_ratings(answer: Column, n: int) -> Column:
    """Ratings 0 to 10 from a model's answer, one a line; -1 where a line has no number."""
    lines = F.filter(F.split(answer, r"\n"), lambda x: F.length(F.trim(x)) > 0)
    number = lambda x: F.coalesce(F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*$", 1).try_cast("double"), F.lit(-1.0))
    return F.slice(F.transform(lines, lambda x: F.least(F.lit(10.0), number(x))), 1, n)


def rerank_with_model(candidates: DataFrame, answers: DataFrame, k: int, most: int = 20) -> DataFrame:
    """Order candidates (qid, id, rank) by ratings parsed from answers (qid, answer); a bad answer keeps the order."""
    first = candidates.where(F.col("rank") <= most)
    rated = first.join(small(answers), "qid", "left").withColumn("ratings", parse_ratings(F.col("answer"), most))
    rating = F.when(F.size("ratings") >= F.col("rank"), F.element_at("ratings", F.col("rank").cast("int"))).otherwise(F.lit(-1.0))
    scored = rated.select("qid", "id", F.coalesce(rating, F.lit(-1.0)).alias("rating"), F.col("rank").alias("before"))
    return top_k(scored, k, F.desc("rating"), F.asc("before"), F.asc("id"))


def parse_directives(query: Column, has_vector: Column) -> dict[str, Column]:
    """Directives `mode:` and `k:` inside a query text; the rest is the text."""
    modes = F.regexp_extract_all(query, F.lit(r"\bmode:(\S+)"), F.lit(1))
    ks = F.regexp_extract_all(query, F.lit(r"\bk:(\S+)"), F.lit(1))
    rest = T.normalize_whitespace(F.regexp_replace(query, r"\b(mode|k):\S+", " "))
    k = F.try_element_at(ks, F.lit(-1)).try_cast("int")
    named = F.upper(F.try_element_at(modes, F.lit(-1)))
    inferred = F.when(has_vector & (F.length(rest) > 0), "HYBRID").when(has_vector, "VECTOR").otherwise("KEYWORD")
    return {
        "text": rest,
        "k": F.when(k > 0, k).otherwise(F.lit(10)),
        "mode": F.when(named.isin("KEYWORD", "VECTOR", "HYBRID"), named).otherwise(inferred),
    }


# --- metadata filters --------------------------------------------------------------------------------

Tree = tuple


def metadata_filter(tree: Tree | None, column: Callable[[str], Column] = F.col) -> Column:
    """A filter tree as a column, in two-valued logic.

    ("and"|"or", tree, tree...), ("not", tree), ("group", tree), ("eq"|"ne"|"gt"|"gte"|"lt"|"lte", key, value),
    ("in"|"nin", key, [values]), ("isnull"|"notnull", key). Numbers compare as doubles where both are numbers,
    else as strings; a missing key makes "ne" and "nin" true and every other comparison false.
    """
    if tree is None:
        return F.lit(True)
    op, *args = tree
    if op in ("and", "or"):
        parts = [metadata_filter(a, column) for a in args]
        result = parts[0]
        for p in parts[1:]:
            result = result & p if op == "and" else result | p
        return result
    if op == "not":
        return ~metadata_filter(args[0], column)
    if op == "group":
        return metadata_filter(args[0], column)
    c = column(args[0])
    if op == "isnull":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()

    def pair(value):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            as_number = c.try_cast("double")
            return as_number, F.lit(float(value)), c.cast("string"), F.lit(str(value)), as_number.isNotNull()
        return None, None, c.cast("string"), F.lit(str(value)), F.lit(False)

    def compare(make: Callable[[Column, Column], Column], value) -> Column:
        n, nv, s, sv, numeric = pair(value)
        return make(s, sv) if n is None else F.when(numeric, make(n, nv)).otherwise(make(s, sv))

    makes = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}
    if op in makes:
        return F.coalesce(compare(makes[op], args[1]), F.lit(op == "ne"))
    if op in ("in", "nin"):
        any_of = F.lit(False)
        for value in args[1]:
            any_of = any_of | F.coalesce(compare(makes["eq"], value), F.lit(False))
        return any_of if op == "in" else ~any_of
    raise ValueError(f"unknown operation {op}")


def filter_text(tree: Tree | None) -> str:
    """A filter tree as text."""
    if tree is None:
        return ""
    op, *args = tree
    if op in ("and", "or"):
        return "(" + f" {op.upper()} ".join(filter_text(a) for a in args) + ")"
    if op == "not":
        return f"NOT ({filter_text(args[0])})"
    if op == "group":
        return f"({filter_text(args[0])})"
    if op in ("isnull", "notnull"):
        return f"{args[0]} IS {'NOT ' * (op == 'notnull')}NULL"
    signs = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "IN", "nin": "NOT IN"}
    shown = "[" + ", ".join(map(repr, args[1])) + "]" if op in ("in", "nin") else repr(args[1])
    return f"{args[0]} {signs[op]} {shown}"
