"""What only larger tables show, on small ones: blocks of queries, bounded hits, calibrated oversampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.operators import ann, lifecycle
from larkspur.operators import batched as B
from larkspur.operators import quantize as Q
from larkspur.operators import search as S
from larkspur.plans.tables import vectors


def asked_of(v, every: int = 3):
    return v.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


def rows(df):
    return sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))


def test_larger_query_sets_are_searched_in_blocks(spark, data, monkeypatch):
    v = vectors(spark, data)
    whole = rows(S.knn(v, asked_of(v), 5, "dot"))
    twins = lifecycle.semantic_duplicates(v, v.withColumn("id", F.col("id") + 10_000)).count()
    monkeypatch.setattr(B.query_blocks, "__defaults__", (60,))
    monkeypatch.setattr(B.scan, "__defaults__", (None, 60))
    assert len(list(B.query_blocks(asked_of(v)))) > 1
    assert rows(S.knn(v, asked_of(v), 5, "dot")) == whole
    assert lifecycle.semantic_duplicates(v, v.withColumn("id", F.col("id") + 10_000)).count() == twins > 0


def test_a_task_keeps_k_hits_of_a_query_whatever_the_cells(spark, data):
    v = vectors(spark, data).coalesce(1)
    index = ann.CellIndex.fit(v, 20)
    found = index.found(asked_of(v, 50), 3, 20)
    assert found.count() == 3 * asked_of(v, 50).count()
    assert rows(index.search(asked_of(v), 10, 20)) == rows(S.knn(v, asked_of(v), 10, "l2"))


def test_best_equals_a_sort():
    random = np.random.default_rng(4)
    for ascending in (True, False):
        for kind in (pa.int64(), pa.string()):
            found, n, k = B.Best(7, 4, ascending), 7, 4
            found.most = 50
            every = []
            for a in range(0, 600, 60):
                x = np.round(random.standard_normal((n, 60)), 1)
                names = random.permutation(np.arange(a, a + 60))
                ids = pa.array(names).cast(kind)
                order = np.argsort(np.array(ids.to_pylist()))
                every += [(q, -x[q, i] * (-1 if ascending else 1), ids[i].as_py()) for q in range(n) for i in range(60)]
                for some in np.split(order, [3, 20]):
                    found.add(ids, some, np.arange(n), x[:, some])
            q, value, ids = found.settle()
            want = [r for i in range(n) for r in sorted(e for e in every if e[0] == i)[:k]]
            assert list(zip(q.tolist(), (value if ascending else -value).tolist(), ids.to_pylist())) == want


def test_probes_are_those_of_the_nearest_centres():
    random = np.random.default_rng(5)
    asked, centres = random.standard_normal((40, 6)), random.standard_normal((9, 6))
    near = ((asked[:, None] - centres) ** 2).sum(2).argsort(1)
    for probes in (1, 4, 9, 12):
        want = {c: [i for i in range(40) if c in near[i, :probes]] for c in range(9)}
        assert {c: sorted(q.tolist()) for c, q in ann.probed(asked, centres, probes).items()} == {c: q for c, q in want.items() if q}


def test_oversampling_reaches_its_recall(spark, data):
    """Four codes of four words lose most neighbours at the given oversampling."""
    v = vectors(spark, data)
    index, exact = ann.build("product", v, cells=4, m=4, codewords=4), S.knn(v, asked_of(v, 10), 10, "l2")
    recall = lambda oversample: ann.recall_at(index.search(asked_of(v, 10), 10, 4, oversample), exact).agg(F.avg("recall")).first()[0]
    measured = index.oversample_for(asked_of(v, 10), 10, 4)
    assert recall(1) < 0.9 <= recall(measured)
    # beyond the most candidates the cells are scanned exactly
    assert rows(index.search(asked_of(v), 10, 4, ann.MOST_REACH)) == rows(S.knn(v, asked_of(v), 10, "l2"))


def test_encoding_in_steps_changes_no_code(monkeypatch):
    random = np.random.default_rng(6)
    x, q = random.standard_normal((700, 16)), Q.ProductQuantizer(random.standard_normal((4, 256, 4)))
    once = q.encode(x)
    monkeypatch.setattr(Q, "ENCODED", 7)
    assert (q.encode(x) == once).all()


def test_texts_are_analyzed_once(spark, monkeypatch):
    """Statistics, counts and the caller's two reads of the hits take one pass over the texts."""
    docs = spark.createDataFrame([(1, "red fox red", "a"), (2, "blue fox", "a"), (3, "red sea and sand", "b"), (4, None, "b")], "doc_id long, text string, source string").repartition(1)
    queries = spark.createDataFrame([(0, "red red fox"), (1, "sand"), (2, "")], "qid long, query string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    shown = docs.withColumn("text", counted("text"))
    hits = S.bm25(shown, queries, 5)
    assert len(hits.collect()) == hits.count() == 4 and calls.value == 4
    for partition in (None, "source"):
        listed = sorted(map(tuple, S.bm25(docs, queries, 5, partition=partition).collect()))
        with monkeypatch.context() as m:
            m.setattr(S, "MOST_LISTED", 1)
            assert listed == sorted(map(tuple, S.bm25(docs, queries, 5, partition=partition).collect()))


def test_a_bucket_of_postings_is_dealt_to_several_files(spark, data, tmp_path):
    import glob

    docs, queries = spark.read.parquet(f"{data}/documents.parquet"), spark.createDataFrame([(0, "from heating erent")], "qid long, query string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = S.TextIndex.build(docs, str(tmp_path), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/postings/bucket=*/*.parquet")) > 4
    assert rows(index.search(queries, 10)) == rows(S.bm25(docs, queries, 10))
