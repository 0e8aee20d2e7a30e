"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams. Each word has a form (letter case, digits, its marks before and
after, whether it repeats the word before it); n-grams of one to three forms and of one to two lower-cased
words are indicators. Each indicator is scaled by its class log-count ratio, and a linear hinge-loss
(L2-regularised, class-weighted) model is fitted by dual coordinate descent. Scaled rows have length 1.
Scores are probabilities by a logistic curve fitted to margins of rows that the fit left out, each weighted
by its class's share of all taught labels over its share of the fitted rows.

The fit uses at most MOST_ROWS labelled rows (those with the smallest hashes of doc_id, half of the room
for each class); scoring covers all rows and whole texts. Labels that are null don't teach. Null or empty
text has only the indicator of the empty text and gets a score like any other. With labels of one class
only, or none, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larkspur.llm.common import map_arrow, save_table, text_chunks, texts_of, worker_cache

BITS = 18
#: Bound of the labelled rows that the fit reads.
MOST_ROWS = 6000
REMEMBERED = 400_000
_CORE = re.compile(rb"^([^0-9A-Za-z\x80-\xff]*)(.*?)([^0-9A-Za-z\x80-\xff]*)$", re.S)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def form(word: bytes) -> bytes:
    head, core, tail = _CORE.match(word).groups()
    if not core:
        kind = b"-"
    elif core.isdigit():
        kind = b"9"
    else:
        text = core.decode("utf-8", "replace")
        kind = b"x" if text.islower() else b"X" if text.isupper() and len(text) > 1 else b"T" if text[:1].isupper() and text[1:].islower() else b"m"
    return head[:3] + kind + tail[:3]


class Words(dict):
    """word -> (hash of the lower-cased word, hash of its form); emptied when full."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        value = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(form(word), seed=1))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct indicator, sorted by document."""
    words = worker_cache("quality").setdefault("quality_words", Words())
    lists = [t.split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    both = np.array([words[w] for x in lists for w in x], np.uint64).reshape(total, 2)
    doc = np.repeat(np.arange(len(texts)), sizes)
    word, shape = both[:, 0], both[:, 1].copy()
    if total > 1:
        again = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape[1:][again] ^= _K[2]
    shift = np.uint64(64 - BITS)
    parts = [(doc, (word * _K[0]) >> shift), (doc, (shape * _K[1]) >> shift)]
    if total > 1:
        same = doc[1:] == doc[:-1]
        parts.append((doc[1:][same], ((word[:-1] * _K[1] + word[1:]) * _K[0] >> shift)[same]))
        two = (shape[:-1] * _K[0] + shape[1:]) * _K[2]
        parts.append((doc[1:][same], (two >> shift)[same]))
        if total > 2:
            same = doc[2:] == doc[:-2]
            parts.append((doc[2:][same], ((two[:-1] * _K[1] + shape[2:]) * _K[0] >> shift)[same]))
    empty = np.flatnonzero(sizes == 0)
    parts.append((empty, np.zeros(len(empty), np.uint64)))
    keys = np.concatenate([d.astype(np.uint64) << np.uint64(BITS) | b for d, b in parts])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of an indicator: ratio x hinge weight, float32
    scale2: np.ndarray  # squared ratio of an indicator, float32, for the row's length
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margins(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(doc, self.scale2[bucket], n))
        return np.bincount(doc, self.weights[bucket], n) / np.maximum(length, 1e-9) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts), len(texts)) + self.offset, -30, 30)))


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Row by row, since the indicators of all rows at once would be several copies of them."""
    counts = np.ones((2, 1 << BITS))
    for i in np.flatnonzero(keep):
        counts[int(y[i] < 0), docs[i]] += 1
    p, q = counts
    return np.log((p / p.sum()) / (q / q.sum()))


class Scaled:
    """Rows (buckets, values) of length 1, made when they are asked for."""

    def __init__(self, docs: list[np.ndarray], ratio: np.ndarray):
        self.docs, self.ratio = docs, ratio
        self.length = np.array([max(float(np.sqrt(v @ v)), 1e-9) for v in (ratio[d] for d in docs)])

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i >= len(self.docs):
            raise IndexError
        return self.docs[i], self.ratio[self.docs[i]] / self.length[i]


def dual_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum of cost * hinge; rows are (buckets, values) of length 1."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        random.shuffle(order)
        most = 0.0
        for i in order:
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            now = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (now - alpha[i]) * y[i]
            if step:
                alpha[i] = now
                w[at] += step * v
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of P(1) over margins of weighted rows, by Newton steps with a small ridge."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = x @ (weight * (p - t)) + 1e-2 * np.array([a, b])
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: list[np.ndarray], y: np.ndarray, cost: float = 1.0, natural: float | None = None) -> Model:
    """docs: the indicators of each labelled row; y: +1 or -1; natural: share of +1 among all labels, if rows are a sample."""
    nothing = np.zeros(1 << BITS, np.float32)
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(nothing, nothing, 0.0, 1.0, 0.0, float((y > 0).mean()) if len(y) else 0.5)

    def train(keep: np.ndarray):
        ratio = log_count_ratio(docs, y, keep)
        rows, chosen = Scaled(docs, ratio), np.flatnonzero(keep)
        share = np.where(y > 0, (y[keep] > 0).mean(), (y[keep] < 0).mean())
        w, bias = dual_descent(Scaled([docs[i] for i in chosen], ratio), y[chosen], (cost * 0.5 / np.maximum(share, 1e-9))[chosen])
        return ratio, w, bias, rows

    fold = np.arange(len(y)) % 4 == 0
    left_out = np.zeros(0)
    if 0 < (y[fold] > 0).sum() < fold.sum() and 0 < (y[~fold] > 0).sum() < (~fold).sum():
        _, w, bias, rows = train(~fold)
        left_out = np.array([w[at] @ v + bias for at, v in (rows[i] for i in np.flatnonzero(fold))])
    ratio, w, bias, rows = train(np.ones(len(y), bool))
    sampled = float((y > 0).mean())
    natural = sampled if natural is None else natural
    weight = np.where(y > 0, natural / sampled, (1 - natural) / (1 - sampled))
    plain = 2.0, float(np.log(natural / sampled) - np.log((1 - natural) / (1 - sampled)))
    slope, offset = logistic(left_out, y[fold], weight[fold]) if len(left_out) else plain
    if slope <= 0:
        slope, offset = plain
    return Model((ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32), bias, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit on a bounded sample of rows (doc_id, text) joined with labels (doc_id, quality)."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # labels teach where a document has them, so those of absent documents take no room
    chosen = save_table(chosen.join(docs.select("doc_id"), "doc_id", "left_semi"), "taught-labels")
    number = {r.quality: r["count"] for r in chosen.groupBy("quality").count().collect()}
    natural = number.get(1, 0) / max(1, sum(number.values()))
    rank = F.xxhash64("doc_id")
    # two bounded reads of ids and labels, no texts
    picked = [r for q in (0, 1) for r in chosen.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(most_rows // 2).collect()]
    sample = spark.createDataFrame([(r.doc_id, r.quality) for r in picked], "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_chunks(batch):
                doc, bucket = features(texts_of(data, off))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["doc_id", "quality", "buckets"])

    # the sample is bounded by most_rows, so it may be broadcast and its indicators collected
    rows = map_arrow(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text"), run, "doc_id long, quality int, buckets array<int>").toArrow()
    rows = rows.combine_chunks().sort_by("doc_id")
    lists = rows["buckets"].combine_chunks()
    values, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) if len(lists) else np.zeros(1, np.int64)
    y, ids = np.where(rows["quality"].to_numpy() > 0, 1, -1), rows["doc_id"].to_pylist()
    del rows, lists
    order = np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in ids], kind="stable") if len(y) else np.zeros(0, np.int64)
    model = fit([values[offsets[i] : offsets[i + 1]] for i in order], y[order], natural=natural)
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: Model, name: str = "larkspur_score") -> DataFrame:
    """docs (doc_id, text) with the model's score; other columns are kept, but for one of the score's name."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 x 4 bytes for each of 2**BITS buckets: 2 MB
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_chunks(batch, names[at], 2 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(texts_of(data, off)))], [*names, name])

    return map_arrow(docs, run, schema)


#: Below this probability of label 1 a document is rejected.
THRESHOLD = 0.3


def held_out():
    """Rows that never teach; a row without an id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def taught(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_quality(docs.select("doc_id", "text").where(~held_out()), labels.where(~held_out()))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select("doc_id", "text"), taught(docs, labels))
    score = F.col("larkspur_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
