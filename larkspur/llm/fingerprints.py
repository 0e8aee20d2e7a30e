"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, cut again after sentence ends and, greedily from their start, at
spaces into pieces of at most 80 characters, so that a long line is not one all-or-nothing unit. Each
paragraph's 64-bit digest (salted by its occurrence, so that repeated paragraphs count) goes into one cell
of each of three parts of a table: count, XOR of digests, XOR of check sums. Tables of two versions
subtract; peeling cells that hold one digest recovers the digests that differ. When peeling stops short,
both sketches are built four times larger and it is tried again, until it succeeds. With a and b
paragraphs and d differing ones the likeness is (a+b-d)/(a+b+d), which is the Jaccard likeness of the
paragraph sets; two empty texts have likeness 1.

Null counts as empty. The next document is the next smaller doc_id (null is smaller than any; rows with
equal ids are ordered by a hash of the text, then the text); after the last comes the first. A single row
is its own next. Rows are kept one for one.

Order without one big task: quantiles of doc_id make buckets, each bucket's first row is also sent to the
bucket before it, and every bucket is sorted and streamed on its own. Rows that are equal in id and text can't
be told apart and stay in one bucket. Very long texts are taken whole; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, shard_slots

#: Cells of the fingerprint that is written out; a multiple of 3.
CELLS = 24
PIECE = 80
_SPLIT = re.compile(r"\n+|(?<=[.!?])[ \t]+")
_PIECES = re.compile(r"(?s).{1,%d}(?: |$)|.{%d}" % (PIECE - 1, PIECE))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def paragraphs(text: str) -> list[str]:
    found: list[str] = []
    for unit in _SPLIT.split(text):
        if len(unit) > PIECE:
            found += _PIECES.findall(unit)
        elif unit:
            found.append(unit)
    return found


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs; the n-th repeat of one has its own digest."""
    units = [u.encode() for u in paragraphs(text)]
    if len(set(units)) == len(units):
        return np.unique(np.array([xxhash.xxh3_64_intdigest(u) for u in units], np.uint64))
    seen: dict[bytes, int] = {}
    values = []
    for u in units:
        n = seen[u] = seen.get(u, -1) + 1
        # the number is hashed with the text: seeds of a hash of very short texts collide
        values.append(xxhash.xxh3_64_intdigest(u + b"\n%d" % n if n else u))
    return np.unique(np.array(values, np.uint64))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(mix(keys, j) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)]


def sketch(doc: np.ndarray, keys: np.ndarray, docs: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables (count, digest XOR, check XOR) of `docs` documents; doc[i] holds digest keys[i]."""
    count = np.zeros(docs * cells, np.int32)
    key, check = np.zeros(docs * cells, np.uint64), np.zeros(docs * cells, np.uint32)
    sums = mix(keys, 7).astype(np.uint32)
    for at in places(keys, cells):
        cell = doc * cells + at
        count += np.bincount(cell, minlength=docs * cells).astype(np.int32)
        np.bitwise_xor.at(key, cell, keys)
        np.bitwise_xor.at(check, cell, sums)
    return count, key, check


def subtract(a, b):
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(table, docs: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of recovered digests, whether all were recovered) of each document's difference."""
    count, key, check = (x.copy() for x in table)
    found = np.zeros(docs, np.int64)
    live = np.flatnonzero(np.abs(count) == 1)
    while len(live):
        live = live[np.abs(count[live]) == 1]
        live = live[mix(key[live], 7).astype(np.uint32) == check[live]]
        if not len(live):
            break
        doc, keys, sign = live // cells, key[live], count[live]
        order = np.lexsort((keys, doc))
        first = np.ones(len(order), bool)
        first[1:] = (doc[order][1:] != doc[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        doc, keys, sign = doc[order][first], keys[order][first], sign[order][first]
        found += np.bincount(doc, minlength=docs)
        sums = mix(keys, 7).astype(np.uint32)
        touched = []
        for at in places(keys, cells):
            cell = doc * cells + at
            np.subtract.at(count, cell, sign)
            np.bitwise_xor.at(key, cell, keys)
            np.bitwise_xor.at(check, cell, sums)
            touched.append(cell)
        live = np.unique(np.concatenate(touched))
    empty = ((count == 0) & (key == 0) & (check == 0)).reshape(docs, cells).all(axis=1)
    return found, empty


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Likeness of each pair of digest sets, by subtracting and peeling their sketches."""
    n = len(left)
    result, waiting = np.ones(n), np.arange(n)
    while len(waiting):
        again = []
        step = max(1, (1 << 20) // cells)
        for s in range(0, len(waiting), step):
            some = waiting[s : s + step]
            a, b = [left[i] for i in some], [right[i] for i in some]
            found, whole = peel(subtract(sketch(*flat(a), len(some), cells), sketch(*flat(b), len(some), cells)), len(some), cells)
            total = np.array([len(x) + len(y) for x, y in zip(a, b)])
            # a false recovery would break the parity or the bound
            whole &= (found <= total) & ((total - found) % 2 == 0)
            result[some[whole]] = np.where(total + found > 0, (total - found) / np.maximum(total + found, 1), 1.0)[whole]
            again.append(some[~whole])
        waiting, cells = np.concatenate(again), cells * 4
    return result


def fingerprint_strings(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    count, key, check = (x.reshape(len(sets), cells) for x in sketch(*flat(sets), len(sets), cells))
    return [f"{len(s)}:{base64.b64encode(c.tobytes() + k.tobytes() + h.tobytes()).decode()}" for s, c, k, h in zip(sets, count, key, check)]


def parse_fingerprint(text: str) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    size, _, table = text.partition(":")
    raw = base64.b64decode(table)
    cells = len(raw) // 16
    return int(size), (np.frombuffer(raw, np.int32, cells), np.frombuffer(raw, np.uint64, cells, 4 * cells), np.frombuffer(raw, np.uint32, cells, 12 * cells))


def with_next(df: DataFrame) -> DataFrame:
    """Rows (bucket, tail, doc_id, text): sorted by descending doc_id in each bucket; tail rows only follow.

    Buckets are numbered in that order, and each has a task of its own. An id that is several quantiles (say null,
    in a third of the rows) has buckets of its own by ranges of the text's hash.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("order_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("order_hash", F.xxhash64("text"))
    bounds = sorted(Counter(rows.select("order_id").approxQuantile("order_id", [i / parts for i in range(1, parts)], 0.1 / parts)).items())
    # by interval [bound, next bound): its smallest id, how often that is a quantile, the first bucket's number
    least, times, start = [float("-inf"), *(b for b, _ in bounds)], [1, *(t for _, t in bounds)], [0] * (len(bounds) + 1)
    for j in range(len(bounds), 0, -1):
        start[j - 1] = start[j] + 1 + times[j] * (times[j] > 1)
    rows = rows.withColumn("order_double", F.col("order_id").cast("double"))
    if bounds:
        rows = Bucketizer(splits=[*least, float("inf")], inputCol="order_double", outputCol="interval", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("interval", F.lit(0))
    of = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("interval").cast("int") + 1)
    place = F.shiftrightunsigned(F.col("order_hash").bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(2.0**53)
    own = F.when((of(times, "int") > 1) & (F.col("order_double") == of(least, "double")), 1 + F.floor(place * of(times, "int")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("bucket", of(start, "int") + own).select("bucket", "doc_id", "order_id", "order_hash", "text")
    # the first row of each bucket; there are at most twice as many buckets as shuffle partitions
    tops = rows.groupBy("bucket").agg(F.max(F.struct("order_id", F.bitwise_not("order_hash").alias("h"))).alias("k"))
    tops = tops.select("bucket", "k.order_id", F.bitwise_not("k.h").alias("order_hash")).collect()
    names = sorted(r.bucket for r in tops) or [0]
    before = {b: names[i - 1] for i, b in enumerate(names)}
    slots = dict(zip(names, shard_slots(spark, len(names))))
    # it follows the bucket before; the first of all follows the last of all
    follows = spark.createDataFrame([(*r, before[r.bucket]) for r in tops], "bucket int, order_id long, order_hash long, to_bucket int")
    tails = rows.join(F.broadcast(follows), ["bucket", "order_id", "order_hash"]).dropDuplicates(["bucket"])
    sent = rows.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("bucket", F.col("to_bucket")).drop("to_bucket").withColumn("tail", F.lit(True)))
    table = F.lit([slots.get(b, 0) for b in range(names[-1] + 1)]).cast("array<int>")
    return (
        sent.withColumn("slot", F.element_at(table, F.col("bucket") + 1))
        .repartition(len(names), "slot")
        .sortWithinPartitions("tail", F.desc("order_id"), "order_hash", "text")
        .select("bucket", "tail", "doc_id", "text")
    )


def edit(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses (see the module)."""
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, sets, nexts, next_sets = zip(*rows)
        edited = [edit(t, f) for t, f in zip(texts, nexts)]
        edited_sets = [digests(e) for e in edited]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array(fingerprint_strings(list(sets), cells)),
            pa.array(fingerprint_strings(edited_sets, cells)),
            pa.array(likeness(list(sets), edited_sets, cells)),
            pa.array(likeness(list(sets), list(next_sets), cells)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars, before = [], 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for bucket, tail, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    text = text or ""
                    own = digests(text)
                    if before is not None and before[0] == bucket and not before[1]:
                        waiting.append((*before[2:], text, own))
                        chars += len(text)
                        if chars > 4 << 20:
                            yield finish(waiting)
                            waiting, chars = [], 0
                    before = (bucket, tail, doc_id, text, own)
        if waiting:
            yield finish(waiting)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_arrow(with_next(source), run, schema)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    made = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
