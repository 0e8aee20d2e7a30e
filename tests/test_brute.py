"""Queries that SQL can't express, against plain Python or numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from larkspur.functions import chunks as C
from larkspur.operators import ann
from larkspur.operators import quantize as Q
from larkspur.plans import registry
from larkspur.plans.tables import vectors

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def matrix(data):
    t = pq.read_table(f"{data}/embeddings.parquet").sort_by("vec_id")
    return np.stack(t["embedding"].combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)


def texts(data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_word_count_of_plain_sentences(spark, data):
    """Where a text has letters, spaces and marks at the ends of words only, words are runs of letters."""
    got = {r.doc_id: r.n_words for r in QUERIES["c3_word_count"](spark, data).collect()}
    plain = {i: t for i, t in texts(data).items() if t and re.fullmatch(r"[^\W\d_]+(?:[,;:.!?]*\s+[^\W\d_]+)*[.!?]*\s*", t)}
    assert len(got) == len(texts(data)) and len(plain) > 3
    assert {i: got[i] for i in plain} == {i: len(re.findall(r"[^\W\d_]+", t)) for i, t in plain.items()}


@pytest.mark.parametrize(("name", "separator"), [("c4_char_chunks", "::chunk-"), ("c5_token_chunks", "::chunk-"), ("c5_token_chunks_by_suffix", "#chunk-"), ("c6_streaming_chunks", "::chunk-")])
def test_chunks_cover_texts_within_their_bounds(name, separator, spark, data):
    """Chunks come in order, leave out no word, and are as long as allowed."""
    own = {}
    for r in QUERIES[name](spark, data).collect():
        own.setdefault(r.doc_id, []).append((int(r.chunk_id.rsplit(separator, 1)[1]), r.start_char, r.end_char, r.tokens))
    most = {"c4_char_chunks": 512, "c5_token_chunks": 256, "c5_token_chunks_by_suffix": 64, "c6_streaming_chunks": 1000}[name]
    for i, text in texts(data).items():
        spans = sorted(own.get(i, []))
        assert [s[0] for s in spans] == list(range(len(spans)))
        covered = np.zeros(len(text or "") + 1, bool)
        for _, a, z, tokens in spans:
            covered[a:z] = True
            assert tokens == len(re.findall(r"[^\W_]+(?:['’.,][^\W_]+)*", text[a:z]))
            assert (z - a if "char" in name or "streaming" in name else tokens) <= most
        words = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        assert all(covered[a:z].all() for a, z in words), (i, name)


def test_stream_of_files_gives_the_chunks_of_the_table(spark, data):
    got = sorted(map(tuple, QUERIES["x1_stream_chunks"](spark, data).collect()))
    want = [(i, f"{i}::chunk-{n}", a, z) for i, t in texts(data).items() for n, (a, z) in enumerate(C.streaming_chunks(t or ""))]
    assert got == sorted(want)


def test_state_by_key_equals_a_loop(spark, data):
    t = pq.read_table(f"{data}/events.parquet", columns=["event_id", "ts"])
    rows = sorted((int(x.timestamp() * 1000) if x.tzinfo else int(np.datetime64(x, "ms").astype(int)), i % 40) for i, x in zip(t["event_id"].to_pylist(), t["ts"].to_pylist()))
    state, inhibited = {}, {}
    for at, k in rows:
        n, last = state.get(k, (0, -(2**62)))
        if at - last < 300_000:
            inhibited[k] = inhibited.get(k, 0) + 1
        else:
            state[k] = (n + 1, at)
    got = {r.id: (r.auto_recalls, r.inhibited) for r in QUERIES["x5_stream_state"](spark, data).collect()}
    assert got == {k: (n, inhibited.get(k, 0)) for k, (n, _) in state.items()}


def test_clusters_are_nearest_centres(spark, data, matrix):
    v = vectors(spark, data)
    centres = ann.kmeans(v, 10)
    want = ((matrix[:, None] - centres) ** 2).sum(2).argmin(1)
    got = {r.id: r.cell for r in ann.with_cell(v, centres).collect()}
    assert [got[i] for i in range(len(matrix))] == want.tolist()
    assert sum(r["count"] for r in QUERIES["a11_kmeans"](spark, data).collect()) == len(matrix) == sum(r["count"] for r in QUERIES["a12_centroid_router"](spark, data).collect())


def decoded(rows, kind=np.uint8):
    return np.stack([np.frombuffer(bytes.fromhex(r.codes), kind) for r in sorted(rows, key=lambda r: r.id)])


def test_equal_frequency_codes_by_a_loop(spark, data, matrix):
    """The first level that reaches a value, or the one before if its centre is nearer."""
    import bisect

    q = Q.EqualFrequency.fit(vectors(spark, data))
    got = decoded(QUERIES["v18_equal_frequency_codes"](spark, data).collect())
    for i in range(0, len(matrix), 7):
        for j, x in enumerate(matrix[i]):
            at = min(bisect.bisect_left(q.uppers[j].tolist(), x), 15)
            nearer = at > 0 and abs(x - q.centres[j][at - 1]) < abs(x - q.centres[j][at])
            assert got[i, j] == at - nearer


def test_product_codes_are_nearest_words(spark, data, matrix):
    q = Q.ProductQuantizer.fit(vectors(spark, data))
    got = decoded(QUERIES["v10_product_quantizer"](spark, data).collect())
    for j in range(8):
        d = ((matrix[:, None, 8 * j : 8 * j + 8] - np.where(np.isinf(q.books[j]), 1e9, q.books[j])) ** 2).sum(2)
        assert np.allclose(d[np.arange(len(d)), got[:, j]], d.min(1))


def test_standardised_moments_and_codes(spark, data, matrix):
    q = Q.Standardised.fit_table(vectors(spark, data), 8)
    rotated = Q.hadamard(matrix * q.signs)
    rows = {r.dim: r for r in QUERIES["a10_standardised_calibration"](spark, data).collect()}
    for j in range(rotated.shape[1]):
        low, high = np.quantile(rotated[:, j], [0.001, 0.999], method="inverted_cdf")
        kept = rotated[(rotated[:, j] >= low) & (rotated[:, j] <= high), j]
        assert rows[j]["mean"] == pytest.approx(kept.mean(), abs=1e-6)
        assert rows[j].scale == pytest.approx(3 * kept.std(ddof=1) / 127, rel=1e-6)
    got = decoded(QUERIES["v20_standardised_codes"](spark, data).collect(), np.int8)
    assert (np.abs(got - np.clip(np.round((rotated - q.mean) / q.scale), -127, 127)) <= 1).all()


def test_turbo_codes_keep_directions(spark, data, matrix):
    q = Q.Turbo.fit_table(vectors(spark, data), 4)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) @ q.matrix.T
    span = unit.max(0) - unit.min(0)
    assert q.low == pytest.approx(unit.min(0) - 0.025 * span) and q.scale == pytest.approx(1.05 * span / 15)
    packed = decoded(QUERIES["v19_turbo_codes"](spark, data).collect())
    codes = Q.unpack_bits(packed, 4, matrix.shape[1])
    near = (q.decode(codes, np.ones(len(codes))) * matrix).sum(1) / np.linalg.norm(matrix, axis=1)
    assert near.mean() > 0.97


def test_discovery_lists_the_folder(spark, data):
    import os

    got = {r.name: r.bytes for r in QUERIES["s7_file_discovery"](spark, data).collect()}
    assert got == {n: os.path.getsize(f"{data}/{n}") for n in os.listdir(data) if n.endswith(".parquet")}
