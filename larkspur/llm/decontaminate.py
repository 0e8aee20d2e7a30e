"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is WINDOW
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Finding a
window asks for all its words, so the necessary prefix of its words in order of rarity is its one rarest
word. Words are counted over the whole corpus (those that benchmark windows have); documents' words join
with windows on the rarest word; its place in the window gives the only start that can fit (positional
bound), the document's length bounds it (length bound), and the document's words there are compared with
the window's (exact containment). The comparison is part of the join, so no unverified pair is shuffled.

A word inside any occurrence of a window is hit. Null or empty texts and items have no words and no
windows. Rows with equal ids and texts have equal results, equal ids with other texts are kept apart.
Very long documents are streams of words like any other. Without benchmark rows nothing is hit.

The side with windows grows with the benchmark only; it is broadcast when it has at most MOST_BROADCAST
windows. Otherwise words are counted before they meet the windows' words, and places of words, as numbers only,
are joined by a shuffle on the rarest word's hash (AQE splits frequent ones); what fits there goes to the
documents, which are shuffled once, and is compared word by word.

Other columns of documents and benchmark take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import save_table
from larkspur.llm.urls import LOWER, UPPER

WINDOW = 10
MOST_BROADCAST = 200_000
#: What ends a word, character by character: Java tests a class of single characters with one table look-up,
#: one of ranges with a chain of comparisons (three times slower over whole texts).
_BETWEEN = "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
#: A word before A-Z are lower-cased.
WORD = f"[^{_BETWEEN}]+"


def raw_words(text: Column) -> Column:
    """Words as they are written: translating whole texts costs more than all the rest."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def words_of(text: Column) -> Column:
    return F.transform(raw_words(text), lambda w: F.translate(w, UPPER, LOWER))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (window array<string>, items array<item_id>)."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences (doc_id, text_hash, start, size, items) of windows; start counts words from 0."""
    small = lambda df, n: F.broadcast(df) if n <= MOST_BROADCAST else df
    windows = save_table(benchmark_windows(benchmark, window), "benchmark-windows")
    n = windows.count()
    # Tokens join in the lower case of all letters, which is equal wherever that of A-Z is; the comparison
    # of windows is in A-Z only. The outer explode keeps the optimizer from splitting every text twice.
    folded = windows.select("window", "items", F.transform("window", F.lower).alias("lower"))
    tokens = folded.select(F.explode("lower").alias("token")).distinct()
    seen = docs.select(F.explode_outer(raw_words(F.col("text"))).alias("word")).select(F.lower("word").alias("token"))
    if n <= MOST_BROADCAST:
        counts = seen.join(F.broadcast(tokens), "token").groupBy("token").agg(F.count("*").alias("n"))
    else:
        counts = seen.groupBy("token").agg(F.count("*").alias("n")).join(tokens, "token")
    # the rarest word of each window, the first in the alphabet and then the leftmost of equally rare ones
    placed = folded.select("window", "items", F.posexplode("lower").alias("at", "token")).join(small(counts, n), "token")
    rarest = (
        placed.groupBy("window")
        .agg(F.min(F.struct("n", "token", "at")).alias("r"), F.count("*").alias("present"), F.first("items").alias("items"))
        # a window with a word that no document has can't occur
        .where(F.col("present") == F.size("window"))
        .select(F.col("r.token").alias("token"), F.col("r.at").alias("at"), F.size("window").alias("size"), F.array_join("window", " ").alias("wanted"), F.lower(F.array_join("window", " ")).alias("wanted_lower"), "items")
    )
    words = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), raw_words(F.col("text")).alias("w"))
    if n > MOST_BROADCAST:
        return _shuffled(docs, words, rarest)
    stream = words.select("doc_id", "text_hash", "w", F.posexplode_outer("w").alias("place", "word")).withColumn("token", F.lower("word"))
    start, size = F.col("place") - F.col("at"), F.col("size")
    joined = stream.join(F.broadcast(rarest), (stream["token"] == rarest["token"]) & contained(start))
    return joined.select("doc_id", "text_hash", start.alias("start"), size.alias("size"), "items")


def contained(start: Column) -> Column:
    """Whether the words w from `start` are the window's (size, wanted, wanted_lower)."""
    size = F.col("size")
    fits = (start >= 0) & (start + size <= F.size("w"))
    there = F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, size), " ")
    return fits & (F.lower(there) == F.col("wanted_lower")) & (F.translate(there, UPPER, LOWER) == F.col("wanted"))


def _shuffled(docs: DataFrame, words: DataFrame, rarest: DataFrame) -> DataFrame:
    """Occurrences by a join of places; equal keys and hashes of other documents or words fail the comparison."""
    key = F.xxhash64("doc_id", "text").alias("key")
    stream = docs.select(key, F.posexplode_outer(raw_words(F.col("text"))).alias("place", "word")).select("key", "place", F.xxhash64(F.lower("word")).alias("token"))
    wanted = rarest.withColumn("token", F.xxhash64("token"))
    places = stream.join(wanted, "token").where(F.col("place") >= F.col("at")).select("key", (F.col("place") - F.col("at")).alias("start"), "size", "wanted", "wanted_lower", "items").distinct()
    keyed = words.select("doc_id", "text_hash", "w", key)
    joined = keyed.join(places, (keyed["key"] == places["key"]) & contained(F.col("start")))
    return joined.select("doc_id", "text_hash", "start", "size", "items")


def covered(spans: Column) -> Column:
    """Number of places in the union of sorted (start, size) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_hit, items) of every text that has a hit."""
    found = find_windows(docs, benchmark, window)
    return (
        found.groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select("doc_id", "text_hash", covered(F.array_sort("spans")).alias("n_hit"), "items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document."""
    hit = contamination(docs, benchmark, window)
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    same = every["doc_id"].eqNullSafe(hit["doc_id"]) & (every["text_hash"] == hit["text_hash"])
    return every.join(hit, same, "left").select(
        every["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(hit.schema["items"].dataType)).alias("items"),
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s.size, i, array_to_string(w[i : i + s.size - 1], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT size FROM win) s
  WHERE i + s.size - 1 <= len(w)
), hit AS (
  SELECT doc_id, i, win.size, item_id FROM dw JOIN win ON dw.size = win.size AND dw.key = win.key
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
