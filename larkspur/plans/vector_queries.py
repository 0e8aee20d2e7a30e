"""Queries on vector compression and approximate indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import ann
from larkspur.operators import quantize as Q
from larkspur.operators import search as S
from larkspur.plans.registry import query
from larkspur.plans.tables import l2_sql, r6, vectors

#: Queries that an index's probes and oversampling are measured on at most; none of them is among the stated query set.
MOST_SAMPLED = 1000
#: The stated query set: every vector whose id is divisible by 50, against all.
CAL = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
 lim AS (SELECT dim, min(x) - CAST(0.025 AS DOUBLE) * (max(x) - min(x)) AS low, max(x) + CAST(0.025 AS DOUBLE) * (max(x) - min(x)) AS high FROM x GROUP BY dim),
 cal AS (SELECT dim, low, CASE WHEN high > low THEN (high - low) / 255 ELSE 1 END AS scale FROM lim),
 code AS (SELECT vec_id, x.dim, x, low, scale, greatest(0, least(255, CAST(floor((x - low) / scale + CAST(0.5 AS DOUBLE)) AS INTEGER))) AS c FROM x JOIN cal USING (dim))"""


REACHED = "SELECT count(*) AS n, true AS reached FROM embeddings WHERE vec_id % 50 = 0"
NEAREST = f"WITH v AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0), near AS (SELECT qid, vec_id AS id, {r6(l2_sql('e.embedding', 'v.vector'))} AS score FROM embeddings e, v) SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, id) AS INTEGER) AS rank FROM near) WHERE rank <= 10"


def asked(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


def recall_rows(spark, sf_dir, index, k: int = 10, **options):
    """(n, reached): the number of queries, and whether their mean recall against exact search is 0.9."""
    q = asked(spark, sf_dir)
    cells = index if isinstance(index, ann.CellIndex) else getattr(index, "cells", None) or getattr(index, "flat", None)
    if cells is not None and "probes" not in options:
        sample = vectors(spark, sf_dir).where(F.col("id") % 50 == 25).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
        sample = sample.orderBy(F.xxhash64("qid"), "qid").limit(MOST_SAMPLED)
        coded = isinstance(index, ann.ProductCellIndex)
        every = ann.CellIndex(ann.with_cell(vectors(spark, sf_dir), cells.centres), cells.centres)
        options["probes"] = every.probes_for(sample, k, 0.98 if coded else 0.95)
        if coded:  # codes lose the more neighbours the more vectors there are
            options["oversample"] = max(options.get("oversample", 1), index.oversample_for(sample, k, options["probes"]))
    recall = ann.recall_at(index.search(q, k, **options), S.knn(vectors(spark, sf_dir), q, k, "l2"))
    return recall.agg(F.count("*").alias("n"), (F.avg("recall") >= 0.9).alias("reached"))


def _whole(name: str, kind: str, fit: dict, **options):
    """An index that probes every cell and rescores every vector equals exact search."""

    @query(NEAREST, name=name)
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        n = v.count()
        every = {k: n if x is None else x for k, x in options.items()}
        return ann.build(kind, v, **fit).search(asked(spark, sf_dir), 10, **every).select("qid", "id", "score", "rank")


_whole("v7_cells_all_probes", "cells", {}, probes=None)
_whole("v8_product_cells_all_probes", "product", {}, probes=None, oversample=None)
_whole("v12_adaptive_cells_all_probes", "adaptive", {"threshold": 30}, probes=None, oversample=None)
_whole("s5_quantized_store_rescored", "standardised", {}, oversample=None)


@query(NEAREST)
def v2_index_contract(spark, sf_dir):
    """Fit, add, delete, search: half of the vectors are added later, strangers come and go."""
    v = vectors(spark, sf_dir)
    strangers = v.select((-1 - F.col("id")).alias("id"), "embedding")
    index = ann.build("cells", v.where("id % 2 = 0"), cells=8).add(v.where("id % 2 = 1")).add(strangers).delete(strangers.select("id"))
    return index.search(asked(spark, sf_dir), 10, probes=8).select("qid", "id", "score", "rank")


@query("SELECT kind FROM (VALUES ('adaptive'), ('cells'), ('product'), ('standardised')) t(kind)")
def v13_index_factory(spark, sf_dir):
    """Every kind that the factory knows gives k results of each query."""
    v, q = vectors(spark, sf_dir), asked(spark, sf_dir)
    made = [ann.build(kind, v).search(q, 5).groupBy("qid").count().select(F.lit(kind).alias("kind"), (F.col("count") == 5).alias("whole")) for kind in ("adaptive", "cells", "product", "standardised")]
    every = made[0]
    for other in made[1:]:
        every = every.unionByName(other)
    return every.groupBy("kind").agg(F.bool_and("whole").alias("whole")).where("whole").select("kind")


@query(f"WITH {CAL} SELECT CAST(dim AS INTEGER) AS dim, {r6('low')} AS low, {r6('scale')} AS scale FROM cal")
def a8_scalar_calibration(spark, sf_dir):
    return Q.calibrate_scalar(vectors(spark, sf_dir)).select("dim", S.rounded(F.col("low")).alias("low"), S.rounded(F.col("scale")).alias("scale"))


@query(f"WITH {CAL} SELECT vec_id AS id, CAST(sum(c) AS BIGINT) AS total, array_to_string(list(c ORDER BY dim), ',') AS codes FROM code GROUP BY vec_id")
def v17_scalar_codes(spark, sf_dir):
    v = vectors(spark, sf_dir)
    codes = Q.scalar_codes(F.col("embedding"), F.col("lows"), F.col("scales"))
    made = v.crossJoin(F.broadcast(Q.as_arrays(Q.calibrate_scalar(v)))).select("id", codes.alias("c"))
    return made.select("id", F.aggregate("c", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.array_join(F.col("c").cast("array<string>"), ",").alias("codes"))


@query(f"WITH {CAL}, r AS (SELECT vec_id, dim, c * scale + low AS y FROM code), q AS (SELECT dim, y AS q FROM r WHERE vec_id = 0) SELECT vec_id AS id, {r6('sum(y * q)')} AS dot, {r6('sqrt(sum((y - q) * (y - q)))')} AS l2, {r6('sum(y * q) / (sqrt(sum(y * y)) * sqrt(sum(q * q)))')} AS cosine FROM r JOIN q USING (dim) GROUP BY vec_id")
def c11_quantized_distances(spark, sf_dir):
    from larkspur.functions import vectors as V

    v = vectors(spark, sf_dir)
    decoded = Q.decode_scalar(Q.scalar_codes(F.col("embedding"), F.col("lows"), F.col("scales")), F.col("lows"), F.col("scales"))
    made = v.crossJoin(F.broadcast(Q.as_arrays(Q.calibrate_scalar(v)))).select("id", decoded.alias("y"))
    asked = F.broadcast(made.where("id = 0").select(F.col("y").alias("q")))
    y, q = F.col("y"), F.col("q")
    return made.crossJoin(asked).select("id", S.rounded(V.dot(y, q)).alias("dot"), S.rounded(V.distance(y, q)).alias("l2"), S.rounded(V.cosine(y, q)).alias("cosine"))


@query(f"WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), l AS (SELECT dim, x, (row_number() OVER (PARTITION BY dim ORDER BY x, vec_id) - 1) * 16 // count(*) OVER (PARTITION BY dim) AS level FROM x) SELECT CAST(dim AS INTEGER) AS dim, CAST(level AS INTEGER) AS level, {r6('max(x)')} AS upper, {r6('avg(x)')} AS centre FROM l GROUP BY dim, level")
def a9_equal_frequency(spark, sf_dir):
    return Q.equal_frequency(vectors(spark, sf_dir)).select("dim", "level", S.rounded(F.col("upper")).alias("upper"), S.rounded(F.col("centre")).alias("centre"))


@query()
def v18_equal_frequency_codes(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = Q.EqualFrequency.fit(v)
    return Q.with_codes(v, q.encode).select("id", F.hex("codes").alias("codes"))


@query()
def v19_turbo_codes(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = Q.Turbo.fit_table(v, 4)
    return Q.with_codes(v, lambda x: Q.pack_bits(q.encode(x)[0], 4)).select("id", F.length("codes").alias("bytes"), F.hex("codes").alias("codes"))


@query()
def v20_standardised_codes(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = Q.Standardised.fit_table(v, 8)
    return Q.with_codes(v, lambda x: q.encode(x).view(np.uint8)).select("id", F.hex("codes").alias("codes"))


@query()
def a10_standardised_calibration(spark, sf_dir):
    q = Q.Standardised.fit_table(vectors(spark, sf_dir), 8)
    return spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(q.mean, q.scale))], "dim int, mean double, scale double")


@query("SELECT vec_id AS id, true AS same FROM embeddings")
def v21_bit_packing(spark, sf_dir):
    """Round trip of packed 4-bit and 2-bit codes."""
    v = vectors(spark, sf_dir)

    def check(x):
        four, two = (np.abs(x * 1000).astype(np.int64) % 16).astype(np.uint8), (np.abs(x * 1000).astype(np.int64) % 4).astype(np.uint8)
        d = x.shape[1]
        same = (Q.unpack_bits(Q.pack_bits(four, 4), 4, d) == four).all(1) & (Q.unpack_bits(Q.pack_bits(two, 2), 2, d) == two).all(1)
        return same[:, None].astype(np.uint8)

    return Q.with_codes(v, check).select("id", (F.hex("codes") == "01").alias("same"))


_NIBBLE = "(CAST(floor(abs(CAST({} AS DOUBLE)) * 1000) AS BIGINT) % 16)"


@query(f"SELECT e.vec_id AS id, CAST(list_sum([{_NIBBLE.format('x')} * {_NIBBLE.format('z.embedding[i]')} FOR x, i IN e.embedding]) AS BIGINT) AS dot FROM embeddings e, embeddings z WHERE z.vec_id = 0")
def c12_packed_dot(spark, sf_dir):
    v = vectors(spark, sf_dir)
    nibbles = lambda x: (np.floor(np.abs(x) * 1000).astype(np.int64) % 16).astype(np.uint8)
    first = Q.pack_bits(nibbles(np.array([v.where("id = 0").first()["embedding"]], dtype=np.float64)), 4)[0]

    def dots(x):
        return Q.packed_dot(Q.pack_bits(nibbles(x), 4), first, 4, x.shape[1]).astype(">i8").view(np.uint8).reshape(len(x), 8)

    return Q.with_codes(v, dots).select("id", F.conv(F.hex("codes"), 16, 10).cast("long").alias("dot"))


@query()
def a11_kmeans(spark, sf_dir):
    v = vectors(spark, sf_dir)
    centres = ann.kmeans(v, 10)
    return v.select("label", F.element_at(ann.nearest_cells(F.col("embedding"), centres, 1), 1).alias("cell")).groupBy("cell", "label").count()


@query()
def a12_centroid_router(spark, sf_dir):
    v = vectors(spark, sf_dir)
    centres = ann.split_router(v, ann.kmeans(v, 4), spread=0.5)
    return v.select(F.element_at(ann.nearest_cells(F.col("embedding"), centres, 1), 1).alias("cell")).groupBy("cell").count()


@query(REACHED)
def v7_cell_index(spark, sf_dir):
    return recall_rows(spark, sf_dir, ann.build("cells", vectors(spark, sf_dir)))


@query(REACHED)
def v3_graph_substitute(spark, sf_dir):
    """In place of one-machine graph indexes: more probes, for the recall that a wide beam gives."""
    return recall_rows(spark, sf_dir, ann.build("cells", vectors(spark, sf_dir), cells=12), probes=12)


@query(REACHED)
def v8_product_cells(spark, sf_dir):
    return recall_rows(spark, sf_dir, ann.build("product", vectors(spark, sf_dir)), oversample=10)


@query(REACHED)
def v9_quantized_cells(spark, sf_dir):
    return recall_rows(spark, sf_dir, ann.build("product", vectors(spark, sf_dir), m=16), oversample=8)


@query()
def v10_product_quantizer(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return Q.with_codes(v, Q.ProductQuantizer.fit(v).encode).select("id", F.hex("codes").alias("codes"))


@query(REACHED)
def v12_adaptive_cells(spark, sf_dir):
    return recall_rows(spark, sf_dir, ann.build("adaptive", vectors(spark, sf_dir), threshold=50))


@query(REACHED)
def s5_quantized_store(spark, sf_dir):
    return recall_rows(spark, sf_dir, ann.build("standardised", vectors(spark, sf_dir)))
