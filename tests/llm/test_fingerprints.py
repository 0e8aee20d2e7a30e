from __future__ import annotations

import hashlib

import numpy as np
import pytest

from larkspur.llm import fingerprints as fp
from tests.llm import fixtures


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_peeling_recovers_any_difference():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 3, 30, 400, 3000)]
    left = [a for a in sets for _ in sets]
    right = [np.unique(np.concatenate([a[: len(a) // 2], b])) for a in sets for b in sets]
    assert fp.likeness(left, right).tolist() == pytest.approx([jaccard(a, b) for a, b in zip(left, right)])


def test_repeated_short_paragraphs_stay_distinct():
    text = "\n".join(c for c in "abcdefghij" for _ in range(700))
    d = fp.digests(text)
    assert len(d) == len(set(d.tolist())) == 7000
    assert fp.likeness([d], [d])[0] == 1.0


def test_fingerprints_subtract():
    a, b = fp.digests("One. Two. Three."), fp.digests("One. Two. Four.")
    (n, x), (m, y) = map(fp.parse_fingerprint, fp.fingerprint_strings([a, b]))
    found, whole = fp.peel(fp.subtract(x, y), 1, fp.CELLS)
    assert (n, m, found[0], whole[0]) == (3, 3, 2, True)


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(fixtures.texts())]
    folder = fixtures.tables(tmp_path, spark, rows)
    out = {r.doc_id: r for r in fp.op5_fingerprints(spark, folder).collect()}
    order = [t or "" for _, t in sorted(rows, reverse=True)]
    by_text = {}
    for k, i in enumerate(sorted(out, reverse=True)):
        t, nxt = order[k], order[(k + 1) % len(order)]
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(fp.digests(t), fp.digests(e)))
        assert r.near_next == pytest.approx(jaccard(fp.digests(t), fp.digests(nxt)))
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert e != t or r.fingerprint == r.edited_fingerprint


def test_repeated_ids_null_ids_one_row_and_no_row(spark):
    rows = fixtures.numbered(12)
    assert fp.fingerprints(fixtures.frame(spark, rows)).count() == len(rows)
    one = fp.fingerprints(fixtures.frame(spark, [(3, "abcdef")])).collect()
    assert one[0].edited == "abcdab" and one[0].near_next == 1.0
    assert fp.fingerprints(fixtures.frame(spark, [(3, "x")]).where("false")).count() == 0


def by_order(rows):
    """(id, text, next text) in descending id; ties by Spark's hash aren't known here, so ids are distinct or texts equal."""
    made = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)[::-1]
    return [(i, t, made[(k + 1) % len(made)][1]) for k, (i, t) in enumerate(made)]


@pytest.mark.parametrize("parts", ["3", "16"])
def test_order_over_buckets(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(7 * i - 300, f"text {i} " * (i % 40 + 1)) for i in range(200)] + [(None, "long " * 40_000)]
        got = {(r.doc_id, r.n_chars, r.edited) for r in fp.fingerprints(fixtures.frame(spark, rows)).collect()}
        assert got == {(None if i == -(2**63) else i, len(t), fp.edit(t, n)) for i, t, n in by_order(rows)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_id_is_split(spark):
    """A third of the rows without an id: several buckets, each row once, and the chain goes through all of them."""
    rows = [(i, f"row {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(100)]
    df = fixtures.frame(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        dealt = fp.with_next(df.select("doc_id", "text")).collect()
        own = [r for r in dealt if not r.tail]
        assert len(own) == 300 and len({r.bucket for r in own if r.doc_id is None}) >= 3
        assert len({r.bucket for r in dealt if r.tail}) == len({r.bucket for r in own})
        out = fp.fingerprints(df).collect()
        assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(i), len(t)) for i, t in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
