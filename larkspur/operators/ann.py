"""Approximate nearest neighbours by partitioned cells; graph indexes of one machine have no place in a scan engine.

An index is a table with a cell column: cells are files when it is written with partitionBy("cell"), and a
search reads the probed cells only. Queries are a bounded matrix in every worker (`batched`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from larkspur.functions import vectors as V
from larkspur.operators import batched as B
from larkspur.operators.quantize import ProductQuantizer, Standardised, training_sample
from larkspur.operators.search import knn, rescored, rounded, top_k
from larkspur.session import ship_package

#: Candidates of a query that are listed and rescored at most; a search that asks for more scores all vectors of its probed
#: cells exactly in the scan, which finds no less than rescoring some of them would.
MOST_REACH = 2_048


def kmeans(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> np.ndarray:
    """Centres [k, d] of a bounded sample, by the distributed k-means of Spark."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = training_sample(vectors.select("id", "embedding")).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(points)
    return np.array(model.clusterCenters())


def nearest_cells(v: Column, centres: np.ndarray, n: int) -> Column:
    """The n cells whose centres are nearest, as an array; centres are constants of the plan."""
    each = F.array(*[F.struct(V.squared_distance(v, V.array_of(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
    return F.transform(F.slice(F.array_sort(each), 1, n), lambda x: x["cell"])


def with_cell(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, embedding, cell) of vectors (id, embedding): the nearest centre by Arrow batches; others have no cell."""
    spark = vectors.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(np.asarray(centres, np.float64))  # at most 1,024 centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = B.matrix(batch.column(1), sent.value.shape[1])
            if len(rows):
                own = batch.take(pa.array(rows))
                cell = B.scores("l2sq", x, sent.value).argmin(1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32())], ["id", "embedding", "cell"])

    source = vectors.select("id", "embedding")
    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("cell", IntegerType())]))


def probed(asked: np.ndarray, centres: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """Places of the queries that probe each cell: those of the `probes` nearest centres."""
    if not len(asked):
        return {}
    if probes >= len(centres):
        return dict.fromkeys(range(len(centres)), np.arange(len(asked)))
    near = np.concatenate([np.argsort(B.scores("l2sq", asked[a : a + 4096], centres), axis=1, kind="stable")[:, :probes] for a in range(0, len(asked), 4096)])
    by = np.argsort(near, axis=None, kind="stable")
    cells, starts = np.unique(near.reshape(-1)[by], return_index=True)
    return dict(zip(cells.tolist(), np.split(by // probes, starts[1:])))


@dataclass
class CellIndex:
    """Cells by k-means; `search` scans the probed cells exactly."""

    table: DataFrame  # id, embedding, cell
    centres: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int | None = None) -> CellIndex:
        n = vectors.count()
        centres = kmeans(vectors, cells or max(2, min(1024, round(math.sqrt(n)))))
        return cls(with_cell(vectors, centres), centres)

    def write(self, path: str) -> CellIndex:
        self.table.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return CellIndex(self.table.sparkSession.read.parquet(path), self.centres)

    def add(self, vectors: DataFrame) -> CellIndex:
        """With more vectors, in the cells that there are."""
        return replace(self, table=self.table.unionByName(with_cell(vectors, self.centres)))

    def delete(self, ids: DataFrame) -> CellIndex:
        return replace(self, table=self.table.join(ids.select("id"), "id", "left_anti"))

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.95) -> int:
        """The fewest probes that reach this recall of the queries' exact neighbours; queries are a bounded sample."""
        near = knn(self.table.select("id", "embedding"), queries, k, "l2").join(self.table.select("id", "cell"), "id").join(queries.select("qid", "vector"), "qid")
        rows = near.select("cell", "vector").toArrow()  # k rows a query
        if not rows.num_rows:
            return 1
        order = np.argsort(B.scores("l2sq", B.matrix(rows["vector"])[1], self.centres), axis=1, kind="stable")
        place = np.sort((order == rows["cell"].to_numpy()[:, None]).argmax(1)) + 1
        return int(place[min(len(place) - 1, math.ceil(least * len(place)) - 1)])

    def found(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        def make(asked):
            probing = probed(asked, self.centres, probes)

            def score(batch, order, asked):
                x = B.matrix(batch.column(1))[1]
                for rows, q in B.by_cell(batch.column(2).to_numpy(), order, probing):
                    for some in B.in_steps(len(rows), len(q)):
                        yield rows, q[some], B.scores("l2", asked[q[some]], x[rows])

            # cells are folders of a written index: only those that are probed are read
            return score, sorted(probing)

        return B.scan(self.table, queries, k, True, make, ["id", "embedding", "cell"])

    def search(self, queries: DataFrame, k: int, probes: int = 10) -> DataFrame:
        found = self.found(queries, k, probes)
        return top_k(found.select("qid", "id", rounded(F.col("score")).alias("score")), k, F.asc("score"), F.asc("id"))


@dataclass
class ProductCellIndex:
    """Cells with product codes of the residuals; distances by table look-up, then exact ones for the best."""

    table: DataFrame  # id, cell, codes
    vectors: DataFrame
    cells: CellIndex
    quantizer: ProductQuantizer

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int | None = None, m: int = 8, codewords: int = 256) -> ProductCellIndex:
        index = CellIndex.fit(vectors, cells)
        centres = index.centres
        ship_package(vectors.sparkSession)

        def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = b.column(2).to_numpy()
                    rest = B.matrix(b.column(1))[1] - centres[cell]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(rest), pa.list_(pa.float64()))], ["id", "cell", "residual"])

        residual = index.table.mapInArrow(subtract, "id long, cell int, residual array<double>")
        quantizer = ProductQuantizer.fit(residual.withColumn("embedding", F.col("residual")), m, codewords, "residual")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = quantizer.encode(B.matrix(b.column(2))[1])
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "codes"])

        return cls(residual.mapInArrow(run, "id long, cell int, codes binary"), vectors, index, quantizer)

    def rough(self, queries: DataFrame, reach: int, probes: int) -> DataFrame:
        """(qid, id, score, rank): the `reach` best by codes, of the probed cells."""
        centres, quantizer = self.cells.centres, self.quantizer

        def make(asked):
            probing = probed(asked, centres, probes)

            def score(batch, order, asked):
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                cell = batch.column(1).to_numpy()
                for rows, q in B.by_cell(cell, order, probing):
                    # a code stands for centre and codewords, so its distances are products like others
                    x = centres[cell[rows[0]]] + quantizer.decode(codes[rows])
                    for some in B.in_steps(len(rows), len(q)):
                        yield rows, q[some], B.scores("l2sq", asked[q[some]], x)

            return score, sorted(probing)

        return top_k(B.scan(self.table, queries, reach, True, make, ["id", "cell", "codes"]), reach, F.asc("score"), F.asc("id"))

    def oversample_for(self, queries: DataFrame, k: int, probes: int, least: float = 0.95) -> int:
        """The least oversampling with which these probes reach this recall of the queries' exact neighbours; queries are
        a bounded sample. Where MOST_REACH candidates don't reach it, more than that: then search scans the cells."""
        near = knn(self.vectors.select("id", "embedding"), queries, k, "l2").select("qid", "id")
        places = near.join(self.rough(queries, MOST_REACH, probes).select("qid", "id", F.col("rank").alias("place")), ["qid", "id"], "left")
        # k rows a query
        place = np.sort(places.select(F.coalesce("place", F.lit(2 * MOST_REACH)).alias("place")).toArrow()["place"].to_numpy())
        return max(1, -(-int(place[max(0, math.ceil(least * len(place)) - 1)]) // k)) if len(place) else 1

    def search(self, queries: DataFrame, k: int, probes: int = 10, oversample: int = 5) -> DataFrame:
        if k * oversample > MOST_REACH:
            return self.cells.search(queries, k, probes)
        return rescored(self.rough(queries, k * oversample, probes), self.vectors, queries, k)


def coded_scores(quantizer: Standardised):
    """Distances of queries to standardised codes (id, codes)."""

    def score(batch, order, asked):
        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
        for at in range(0, len(order), B.ROWS):
            rows = order[at : at + B.ROWS]
            x = quantizer.decode(codes[rows], asked.shape[1])
            for q in B.in_steps(len(rows), len(asked)):
                yield rows, q, B.scores("l2sq", asked[q], x)

    return score


@dataclass
class StandardisedIndex:
    """Flat search over standardised codes with oversampling and exact rescoring."""

    table: DataFrame  # id, embedding, codes
    quantizer: Standardised

    @classmethod
    def fit(cls, vectors: DataFrame, bits: int = 8) -> StandardisedIndex:
        from larkspur.operators.quantize import with_codes

        quantizer = Standardised.fit_table(vectors, bits)
        return cls(with_codes(vectors, lambda x: quantizer.encode(x).view(np.uint8)), quantizer)

    def search(self, queries: DataFrame, k: int, oversample: int = 3) -> DataFrame:
        if k * oversample > MOST_REACH:
            return knn(self.table, queries, k, "l2")
        rough = B.scan(self.table, queries, k * oversample, True, lambda asked: (coded_scores(self.quantizer), None), ["id", "codes"])
        return rescored(top_k(rough, k * oversample, F.asc("score"), F.asc("id")), self.table.select("id", "embedding"), queries, k)


@dataclass
class AdaptiveIndex:
    """Cells that hold few vectors are scanned, larger ones through standardised codes: chosen by cell size when fitted."""

    flat: CellIndex
    dense: DataFrame | None  # id, embedding, codes, cell
    quantizer: Standardised | None

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int | None = None, threshold: int = 20_000) -> AdaptiveIndex:
        index = CellIndex.fit(vectors, cells)
        sizes = index.table.groupBy("cell").count()
        large = [r.cell for r in sizes.where(F.col("count") > threshold).collect()]  # one row a cell
        if not large:
            return cls(index, None, None)
        inside = index.table.where(F.col("cell").isin(large))
        quantizer = Standardised.fit_table(inside, 8)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = np.ascontiguousarray(quantizer.encode(B.matrix(b.column(1))[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], ["id", "embedding", "codes", "cell"])

        schema = inside.schema
        dense = inside.mapInArrow(run, StructType([schema["id"], schema["embedding"], StructField("codes", BinaryType()), schema["cell"]]))
        return cls(replace(index, table=index.table.where(~F.col("cell").isin(large))), dense, quantizer)

    def search(self, queries: DataFrame, k: int, probes: int = 16, oversample: int = 3) -> DataFrame:
        found = self.flat.search(queries, k, probes)
        if self.dense is None:
            return found
        if k * oversample > MOST_REACH:
            near = replace(self.flat, table=self.dense.select("id", "embedding", "cell")).search(queries, k, probes)
            return top_k(found.drop("rank").unionByName(near.drop("rank")), k, F.asc("score"), F.asc("id"))
        quantizer = self.quantizer

        def make(asked):
            probing = probed(asked, self.flat.centres, probes)

            def score(batch, order, asked):
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                for rows, q in B.by_cell(batch.column(2).to_numpy(), order, probing):
                    x = quantizer.decode(codes[rows], asked.shape[1])
                    for some in B.in_steps(len(rows), len(q)):
                        yield rows, q[some], B.scores("l2sq", asked[q[some]], x)

            return score, sorted(probing)

        rough = B.scan(self.dense, queries, k * oversample, True, make, ["id", "codes", "cell"])
        near = rescored(top_k(rough, k * oversample, F.asc("score"), F.asc("id")), self.dense.select("id", "embedding"), queries, k)
        return top_k(found.drop("rank").unionByName(near.drop("rank")), k, F.asc("score"), F.asc("id"))


def fuzz(vectors: DataFrame, rounds: int, seed: int = 0, k: int = 5) -> DataFrame:
    """(round, same): whether an index equals exact search after random additions and deletions (by a hash of id and round)."""
    spark = vectors.sparkSession
    rows = []
    for r in range(rounds):
        draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(10))
        index = CellIndex.fit(vectors.where(draw < 6), 6).add(vectors.where(draw >= 6)).delete(vectors.where(draw % 4 == 1))
        kept = vectors.where(draw % 4 != 1)
        queries = kept.where(F.col("id") % 20 == r).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
        found, true = (df.select("qid", "id", "score", "rank") for df in (index.search(queries, k, 6), knn(kept, queries, k, "l2")))
        # each side is searched once: rows that one side has more often than the other
        both = found.withColumn("n", F.lit(1)).unionByName(true.withColumn("n", F.lit(-1)))
        rows.append((r, both.groupBy("qid", "id", "score", "rank").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()))
    return spark.createDataFrame(rows, "round int, same boolean")


def recall_at(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall) of an approximate result against an exact one."""
    hit = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def split_router(vectors: DataFrame, centres: np.ndarray, spread: float = 2.0, least: int = 10, most: int = 256) -> np.ndarray:
    """Centres after one recalibration: means of their cells; a wide cell of more than `least` is split in two."""
    assigned = vectors.select("embedding", F.element_at(nearest_cells(F.col("embedding"), centres, 1), 1).alias("cell"))
    d = len(centres[0])
    stats = assigned.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(F.element_at("embedding", j + 1).cast("double")) for j in range(d)]).alias("mean"),
        F.avg(V.distance(F.col("embedding"), F.element_at(F.array(*[V.array_of(c) for c in centres]), F.col("cell") + 1))).alias("spread"),
        F.array(*[F.stddev_pop(F.element_at("embedding", j + 1).cast("double")) for j in range(d)]).alias("deviation"),
    ).collect()  # one row a cell, at most `most`
    result = {r.cell: [np.array(r.mean)] for r in stats}
    total = len(centres)
    for r in sorted(stats, key=lambda r: -r.spread):
        if r.spread > spread and r.n > least and total < most:
            half = np.array(r.deviation) / 2
            result[r.cell] = [np.array(r.mean) - half, np.array(r.mean) + half]
            total += 1
    return np.array([c for i in range(len(centres)) for c in result.get(i, [centres[i]])])


def build(kind: str, vectors: DataFrame, **options):
    """An index by name."""
    kinds = {"flat": lambda v, **o: v, "cells": CellIndex.fit, "product": ProductCellIndex.fit, "standardised": StandardisedIndex.fit, "adaptive": AdaptiveIndex.fit}
    if kind not in kinds:
        raise ValueError(f"unknown index {kind}")
    return kinds[kind](vectors, **options)


__all__ = ["AdaptiveIndex", "CellIndex", "ProductCellIndex", "StandardisedIndex", "build", "kmeans", "knn", "recall_at", "split_router"]
