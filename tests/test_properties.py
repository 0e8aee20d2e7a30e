"""Invariants of operators and functions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import chunks as C
from larkspur.functions import memory as M
from larkspur.operators import ann, graph
from larkspur.operators import memory as R
from larkspur.operators import quantize as Q
from larkspur.operators import search as S
from larkspur.plans.tables import NOW, memories, query_vectors, vectors

texts = st.text(alphabet="ab .!?\n\tcédx日", max_size=400)


@given(texts, st.integers(20, 80), st.integers(0, 15))
@settings(max_examples=100, deadline=None)
def test_char_chunks_cover_the_text(text, size, overlap):
    spans = C.char_chunks(text, size, overlap)
    assert all(0 < e - s <= size for s, e in spans)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)


@given(texts, st.integers(1, 12), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_token_chunks_hold_every_word_and_few_enough(text, most, overlap):
    spans = C.token_chunks(text, most, min(overlap, most - 1))
    words = [m.span() for m in C._WORD.finditer(text)]
    assert all(len(C._WORD.findall(text[s:e])) <= most for s, e in spans)
    assert all(any(s <= a and b <= e for s, e in spans) for a, b in words)


@given(texts, st.integers(10, 60))
@settings(max_examples=60, deadline=None)
def test_streaming_chunks_cover_the_text(text, size):
    spans = C.streaming_chunks(text, size, 4)
    assert "".join(text[max(s, p):e] for p, (s, e) in zip([0, *(e for _, e in spans)], spans)) == text


@given(st.lists(st.text(min_size=1, max_size=8), max_size=6))
@settings(max_examples=60, deadline=None)
def test_tag_masks_never_miss(tags):
    whole = C.tag_mask(tags)
    assert all(whole & C.tag_mask([t]) == C.tag_mask([t]) for t in tags)
    assert C.tag_mask([t.upper() for t in tags if t.isascii()]) == C.tag_mask([t.lower() for t in tags if t.isascii()])


@pytest.mark.parametrize("bits", [2, 4])
def test_bit_packing_round_trip(bits):
    codes = np.random.default_rng(1).integers(0, 2**bits, (50, 13)).astype(np.uint8)
    assert (Q.unpack_bits(Q.pack_bits(codes, bits), bits, 13) == codes).all()


def test_rotations_keep_lengths_and_codes_come_near():
    x = np.random.default_rng(2).standard_normal((200, 48))
    m = Q.rotation(48)
    assert np.allclose(m @ m.T, np.eye(48))
    turbo = Q.Turbo.fit(x, 8)
    codes, norm = turbo.encode(x)
    assert np.abs(turbo.decode(codes, norm) - x).max() < 0.1
    standard = Q.Standardised.fit(x, 8)
    assert np.linalg.norm(standard.decode(standard.encode(x), 48) - x) < 0.1 * np.linalg.norm(x)


def test_scalar_codes_err_by_half_a_step(spark, data):
    v = vectors(spark, data)
    cal = Q.as_arrays(Q.calibrate_scalar(v))
    decoded = Q.decode_scalar(Q.scalar_codes(F.col("embedding"), F.col("lows"), F.col("scales")), F.col("lows"), F.col("scales"))
    worst = F.array_max(F.zip_with(F.zip_with(decoded, F.col("embedding").cast("array<double>"), lambda a, b: F.abs(a - b)), "scales", lambda e, s: e / s))
    assert v.crossJoin(cal).agg(F.max(worst)).first()[0] <= 0.5 + 1e-6


def test_decay_never_rises_with_age(spark):
    ages = spark.range(0, 60000, 7).select((F.lit(NOW) - F.col("id") * M.HOUR).alias("ts"))
    d = [r[0] for r in ages.orderBy(F.desc("ts")).select(M.decay(M.age_bucket(F.col("ts"), NOW), M.decay_table())).collect()]
    assert all(a >= b for a, b in zip(d, d[1:])) and d[0] == 1.0 and d[-1] >= 0.1


def test_future_records_are_fresh(spark):
    row = spark.createDataFrame([(NOW + 10_000,)], "ts long").select(M.age_bucket(F.col("ts"), NOW)).first()
    assert row[0] == 0


def test_recall_respects_every_gate_and_order(spark, data):
    m, q = memories(spark, data).cache(), query_vectors(spark, data, 0)
    for name in R.PROFILES:
        o = R.profile(name, top_k=30, tag_mask=2)
        hits = R.recall(m, q, o, NOW).join(m, "id").orderBy("rank").collect()
        assert all(not h.tombstoned and o.min_valence <= h.valence <= o.max_valence and h.mask & 2 for h in hits)
        assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
        assert o.tiers is None or {h.tier for h in hits} <= set(o.tiers)


def test_merging_replicas_changes_nothing_twice(spark, data):
    m = memories(spark, data).select("id", "ts_ms", "mask", "importance", "recalls", "valence", F.lit(8).alias("flags"))
    once = R.merge_replicas(m, m)
    assert once.exceptAll(m).count() == 0 and m.exceptAll(once).count() == 0


def test_filters_have_two_values(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "m string")
    for tree in (("ne", "m", 5), ("gt", "m", 3), ("in", "m", [5, 7]), ("nin", "m", [5]), ("not", ("lt", "m", 9)), None):
        assert df.where(S.metadata_filter(tree).isNull()).count() == 0


def test_cell_index_finds_everything_with_all_probes(spark, data):
    v, q = vectors(spark, data), query_vectors(spark, data, 0, 50, 100)
    index = ann.CellIndex.fit(v, 8)
    exact = S.knn(v, q, 10, "l2")
    assert ann.recall_at(index.search(q, 10, 8), exact).agg(F.min("recall")).first()[0] == 1.0
    assert ann.recall_at(ann.StandardisedIndex.fit(v).search(q, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_components_by_stars(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert found == {n: root(n) for n in parent}


def test_ring_spreads_keys_and_moves_few():
    keys = [f"doc-{i}" for i in range(4000)]
    eight, nine = C.ring_shards(keys, 8), C.ring_shards(keys, 9)
    assert np.bincount(eight, minlength=8).min() > 250
    assert (eight != nine).mean() < 0.25


def test_ids_sort_by_time():
    made = [C.time_sorted_id(NOW + i // 3, 5, i % 3) for i in range(30)]
    assert made == sorted(made) and len(set(made)) == 30 and all(len(x) == 13 for x in made)


def test_pushdown_reaches_the_scan(spark, data):
    plan = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
