from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import suffix_dedup as sd
from tests.llm import fixtures


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_suffix_array_equals_sorting(letters):
    r = random.Random(letters)
    for n in [*range(1, 14), 60, 200]:
        for _ in range(60 if n < 60 else 10):
            t = [r.randint(1, letters) for _ in range(n)] * r.randint(1, 3) + [0]
            assert sd.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(texts, length=sd.LENGTH):
    seen: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = True
        spans = int((np.diff(cut.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


def edited(seed=2):
    """Passages that recur whole, cut, edited, at the ends, and periodic texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij é") for _ in range(r.randint(2, 9)))
    long = [" ".join(word() for _ in range(120)) for _ in range(4)]
    rows = [None, "", "ab" * 300, "ab" * 150, "x" * 199, "x" * 200, "y" * 199, "z" * 500]
    for _ in range(40):
        a = r.choice(long)
        i = r.randrange(len(a))
        rows.append(r.choice([a, a[i:], a[:i], a[:i] + "#" + a[i:], a[:i] + a[i + 1 :], " ".join(word() for _ in range(80)) + a[i : i + r.choice([198, 199, 200, 201, 300])] + word(), word()]))
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, hot):
    """With hot=1 every anchor with several contexts takes the way of hot ones."""
    texts = [*edited(), *(t for _, t in fixtures.numbered(40))]
    folder = fixtures.tables(tmp_path, spark, list(enumerate(texts)))
    monkeypatch.setattr(sd, "HOT", hot)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = sd.repeats(docs)
    got = {r.doc_id: r for r in sd.remove_repeats(docs, found).collect()}
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want, i
    out = {r.doc_id: tuple(r)[1:] for r in sd.op4_suffix_dedup(spark, folder).collect()} if hot > 1 else None
    assert out is None or [out[i] for i in range(len(texts))] == brute(texts)


def test_segments_of_long_texts(monkeypatch):
    b = np.frombuffer(("".join(random.Random(1).choice("abc ") for _ in range(3000))).encode(), np.uint8)
    off = np.array([0, len(b)])
    monkeypatch.setattr(sd, "SEGMENT", 500)
    _, _, lo, windows, place = sd.anchors(b, off)
    starts = np.concatenate([np.arange(a, a + w) for a, w in zip(lo, windows)])
    assert sorted(starts.tolist()) == list(range(len(b) - sd.LENGTH + 1))
    assert ((place >= lo + windows - 1) & (place + sd.ANCHOR <= lo + sd.LENGTH)).all()


def test_empty_table(spark):
    df = fixtures.frame(spark, [(1, "x")]).where("false")
    assert sd.remove_repeats(df, sd.repeats(df)).count() == 0


@pytest.mark.parametrize("shards", [8, 51])
def test_anchors_spread_over_shards(shards):
    """Anchors are minima of hashes; shards of them must not be."""
    b = np.random.default_rng(3).integers(97, 123, 2_000_000).astype(np.uint8)
    h = np.unique(sd.anchors(b, np.array([0, len(b)]))[0])
    sizes = np.bincount(sd.shard_of(h, shards), minlength=shards)
    assert sizes.max() < 2 * sizes.mean()
