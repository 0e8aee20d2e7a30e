"""Vector compression: scalar, equal-frequency, rotated, standardised and product quantizers, bit packing.

Calibration is aggregation; encoding of scalar codes stays in the JVM, the rest is numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.session import ship_package

#: Vectors that a codebook is trained on at most: those with the smallest hashes of their ids.
MOST_TRAINING = 20_000
#: Vectors whose differences from all codewords are held at a time: 4 MB for parts of 8 numbers.
ENCODED = 256


def training_sample(vectors: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    return vectors.orderBy(F.xxhash64("id"), "id").limit(most)


# --- scalar codes, in the JVM ------------------------------------------------------------------------


def calibrate_scalar(vectors: DataFrame, margin: float = 0.025) -> DataFrame:
    """(dim, low, scale): each dimension's range widened on both sides, cut into 255 steps."""
    each = vectors.select(F.posexplode(V.as_doubles(F.col("embedding"))).alias("dim", "x"))
    span = F.max("x") - F.min("x")
    limits = each.groupBy("dim").agg((F.min("x") - margin * span).alias("low"), (F.max("x") + margin * span).alias("high"))
    return limits.select("dim", "low", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 255).otherwise(F.lit(1.0)).alias("scale"))


def as_arrays(calibration: DataFrame) -> DataFrame:
    """The calibration in one row (lows, scales): one entry a dimension."""
    listed = F.array_sort(F.collect_list(F.struct("dim", "low", "scale")))
    return calibration.agg(listed.alias("c")).select(F.transform("c", lambda x: x["low"]).alias("lows"), F.transform("c", lambda x: x["scale"]).alias("scales"))


def scalar_codes(v: Column, lows: Column, scales: Column) -> Column:
    steps = F.zip_with(V.subtract(v, lows), scales, lambda d, s: F.floor(d / s + 0.5))
    return F.transform(steps, lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))))


def decode_scalar(codes: Column, lows: Column, scales: Column) -> Column:
    return F.zip_with(F.zip_with(codes, scales, lambda c, s: c * s), lows, lambda x, low: x + low)


def equal_frequency(vectors: DataFrame, levels: int = 16) -> DataFrame:
    """(dim, level, upper, centre): equal shares of each dimension's sorted values."""
    from pyspark.sql import Window

    each = vectors.select("id", F.posexplode(V.as_doubles(F.col("embedding"))).alias("dim", "x"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy("x", "id")) - 1
    n = F.count("*").over(Window.partitionBy("dim"))
    level = F.floor(place * levels / n).cast("int")
    return each.withColumn("level", level).groupBy("dim", "level").agg(F.max("x").alias("upper"), F.avg("x").alias("centre"))


# --- numpy codes -------------------------------------------------------------------------------------


def with_codes(vectors: DataFrame, encode: Callable[[np.ndarray], np.ndarray], name: str = "codes") -> DataFrame:
    """vectors (id, embedding) with a binary column of codes; encode maps [n, d] to uint8 [n, c]."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                codes = np.ascontiguousarray(encode(matrix), dtype=np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "embedding", name])

    return vectors.select("id", "embedding").mapInArrow(run, f"id long, embedding array<float>, {name} binary")


def matrix_of(vectors: DataFrame, most: int = MOST_TRAINING) -> np.ndarray:
    """The bounded training sample as a matrix on the driver."""
    rows = training_sample(vectors.select("id", "embedding"), most).toArrow()
    return np.stack(rows["embedding"].combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)


class EqualFrequency:
    def __init__(self, uppers: np.ndarray, centres: np.ndarray):
        self.uppers, self.centres = uppers, centres  # [d, levels]

    @classmethod
    def fit(cls, vectors: DataFrame, levels: int = 16) -> EqualFrequency:
        rows = equal_frequency(vectors, levels).orderBy("dim", "level").collect()  # dims x levels rows
        d = max(r.dim for r in rows) + 1
        uppers, centres = np.full((d, levels), np.inf), np.zeros((d, levels))
        for r in rows:
            uppers[r.dim, r.level], centres[r.dim, r.level] = r.upper, r.centre
        return cls(uppers, centres)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):
            at = np.minimum(np.searchsorted(self.uppers[j], x[:, j]), self.uppers.shape[1] - 1)
            other = np.maximum(at - 1, 0)  # the nearer of two neighbouring centres
            codes[:, j] = np.where(np.abs(x[:, j] - self.centres[j, other]) < np.abs(x[:, j] - self.centres[j, at]), other, at)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.centres.T, codes.astype(int), 0) if codes.ndim == 1 else np.stack([self.centres[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)


def rotated_values(vectors: DataFrame, rotate: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(dim, x) of all vectors of `size` numbers after a map of matrices."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v for v in batch.column(0).to_numpy(zero_copy_only=False) if v is not None and len(v) == size]
            if rows:
                made = rotate(np.stack(rows).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(made.shape[1], dtype=np.int32), len(made))), pa.array(made.reshape(-1))], ["dim", "x"])

    return vectors.select("embedding").mapInArrow(run, "dim int, x double")


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Turbo:
    """Random rotation, then 2, 4 or 8 bits a dimension of the unit vector, with the length kept apart."""

    def __init__(self, low: np.ndarray, scale: np.ndarray, matrix: np.ndarray, bits: int):
        self.low, self.scale, self.matrix, self.bits = low, scale, matrix, bits

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = 4, seed: int = 17) -> Turbo:
        matrix = rotation(sample.shape[1], seed)
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12) @ matrix.T
        span = unit.max(0) - unit.min(0)
        low, high = unit.min(0) - 0.025 * span, unit.max(0) + 0.025 * span
        return cls(low, np.maximum((high - low) / (2**bits - 1), 1e-12), matrix, bits)

    @classmethod
    def fit_table(cls, vectors: DataFrame, bits: int = 4, seed: int = 17) -> Turbo:
        """The range of each rotated dimension over all vectors (id, embedding)."""
        first = vectors.select("embedding").where(F.col("embedding").isNotNull()).first()
        size = len(first[0]) if first else 1
        matrix = rotation(size, seed)
        each = rotated_values(vectors, lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ matrix.T, size)
        low, high = np.zeros(size), np.zeros(size)
        for r in each.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():  # one row a dimension
            low[r.dim], high[r.dim] = r.low - 0.025 * (r.high - r.low), r.high + 0.025 * (r.high - r.low)
        return cls(low, np.maximum((high - low) / (2**bits - 1), 1e-12), matrix, bits)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(norm, 1e-12)[:, None] @ self.matrix.T
        return np.clip(np.round((unit - self.low) / self.scale), 0, 2**self.bits - 1).astype(np.uint8), norm

    def decode(self, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return ((codes * self.scale + self.low) @ self.matrix) * norm[:, None]

    def inner_product(self, query: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (codes * self.scale + self.low) @ (self.matrix @ query) * norm


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, keeping lengths."""
    x, h = x.copy(), 1
    n = x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Standardised:
    """Sign flips and Hadamard rotation, standardised by trimmed moments, clamped to signed levels."""

    def __init__(self, signs, mean, scale, levels):
        self.signs, self.mean, self.scale, self.levels = signs, mean, scale, levels

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = 8, clip: float = 3.0, seed: int = 23) -> Standardised:
        dims = 1 << (sample.shape[1] - 1).bit_length()
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], dims)
        rotated = cls._rotate(sample, signs)
        low, high = np.quantile(rotated, [0.001, 0.999], axis=0)
        kept = np.where((rotated >= low) & (rotated <= high), rotated, np.nan)
        levels = 2 ** (bits - 1) - 1
        return cls(signs, np.nanmean(kept, axis=0), np.maximum(clip * np.nanstd(kept, axis=0, ddof=1) / levels, 1e-12), levels)

    @classmethod
    def fit_table(cls, vectors: DataFrame, bits: int = 8, clip: float = 3.0, seed: int = 23) -> Standardised:
        """The same moments over all vectors (id, embedding), by aggregation of each rotated dimension."""
        first = vectors.select("embedding").where(F.col("embedding").isNotNull()).first()
        size = len(first[0]) if first else 1
        dims = 1 << (size - 1).bit_length()
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], dims)
        each = rotated_values(vectors, lambda x: cls._rotate(x, signs), size)
        ends = each.groupBy("dim").agg(F.percentile_approx("x", [0.001, 0.999], 10_000).alias("ends"))
        kept = each.join(F.broadcast(ends), "dim").where(F.col("x").between(F.col("ends")[0], F.col("ends")[1]))  # one row a dimension
        rows = kept.groupBy("dim").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("deviation")).collect()
        mean, deviation, levels = np.zeros(dims), np.zeros(dims), 2 ** (bits - 1) - 1
        for r in rows:
            mean[r.dim], deviation[r.dim] = r["mean"], r.deviation
        return cls(signs, mean, np.maximum(clip * deviation / levels, 1e-12), levels)

    @staticmethod
    def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), len(signs)))
        padded[:, : x.shape[1]] = x
        return hadamard(padded * signs)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round((self._rotate(x, self.signs) - self.mean) / self.scale), -self.levels, self.levels).astype(np.int8)

    def decode(self, codes: np.ndarray, dims: int) -> np.ndarray:
        return (hadamard(codes * self.scale + self.mean) * self.signs)[:, :dims]


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """2 or 4 bit codes packed into bytes, the first code in the low bits."""
    per = 8 // bits
    padded = np.zeros((len(codes), -(-codes.shape[1] // per) * per), np.uint8)
    padded[:, : codes.shape[1]] = codes
    shaped = padded.reshape(len(codes), -1, per)
    return (shaped << (np.arange(per, dtype=np.uint8) * bits)).sum(axis=2).astype(np.uint8)


def unpack_bits(packed: np.ndarray, bits: int, dims: int) -> np.ndarray:
    per = 8 // bits
    shaped = (packed[:, :, None] >> (np.arange(per, dtype=np.uint8) * bits)) & ((1 << bits) - 1)
    return shaped.reshape(len(packed), -1)[:, :dims]


def packed_dot(a: np.ndarray, b: np.ndarray, bits: int, dims: int) -> np.ndarray:
    """Dot products of packed rows with one packed row."""
    return unpack_bits(a, bits, dims).astype(np.int64) @ unpack_bits(b[None], bits, dims)[0].astype(np.int64)


# --- product quantization ----------------------------------------------------------------------------


def lloyd(x: np.ndarray, k: int, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """k-means with careful seeding; an empty cluster keeps its centre; ends when nothing moves."""
    random = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[random.integers(0, len(x), 1)]
    nearest = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = nearest.sum()
        chosen = x[random.choice(len(x), p=nearest / total)] if total > 0 else x[random.integers(0, len(x))]
        centres = np.vstack([centres, chosen])
        nearest = np.minimum(nearest, ((x - chosen) ** 2).sum(1))
    before = None
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        if before is not None and (own == before).all():
            break
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
        before = own
    return centres


class ProductQuantizer:
    def __init__(self, books: np.ndarray):
        self.books = books  # [m, codewords, d/m]

    @classmethod
    def fit(cls, vectors: DataFrame, m: int = 8, codewords: int = 256, column: str = "embedding") -> ProductQuantizer:
        """Codebooks of the subspaces, trained side by side, each on the bounded sample."""
        spark = vectors.sparkSession
        ship_package(spark)
        sample = training_sample(vectors.select("id", F.col(column).alias("embedding")))
        d = len(sample.first()["embedding"])
        width = d // m
        parts = sample.select(F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.slice("embedding", 1 + j * width, width).alias("x")) for j in range(m)])).alias("s")).select("s.*")

        def train(key, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["x"]).astype(np.float64)
            centres = lloyd(x[np.lexsort(x.T)], codewords)
            return pd.DataFrame({"part": key[0], "word": np.arange(len(centres)), "centre": list(centres)})

        rows = parts.groupBy("part").applyInPandas(train, "part int, word int, centre array<double>").collect()  # m x codewords rows
        books = np.full((m, codewords, width), np.inf)
        for r in rows:
            books[r.part, r.word] = r.centre
        return cls(books)

    def encode(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        parts, books = x.reshape(len(x), m, width), np.where(np.isinf(self.books), 1e9, self.books)
        codes = np.empty((len(x), m), np.uint8)
        for a in range(0, len(x), ENCODED):
            for j in range(m):
                codes[a : a + ENCODED, j] = ((parts[a : a + ENCODED, j, None, :] - books[j]) ** 2).sum(2).argmin(1)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """Squared distances of a query's parts to all codewords."""
        m, _, width = self.books.shape
        return ((query.reshape(m, 1, width) - np.where(np.isinf(self.books), 1e9, self.books)) ** 2).sum(2)

    @staticmethod
    def distances(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(len(table)), codes].sum(axis=1)


STRATEGIES = {"scalar": calibrate_scalar, "equal_frequency": EqualFrequency.fit, "turbo": Turbo.fit, "standardised": Standardised.fit, "product": ProductQuantizer.fit}
