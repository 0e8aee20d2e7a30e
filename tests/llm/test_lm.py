from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from larkspur.llm import ngram_lm as lm
from tests.llm import fixtures


@pytest.mark.parametrize(("n", "u"), [(0, 5), (1, 1), (10, 10), (1000, 1000), (1000, 10**6), (5000, 2**50), (100, 3), (30000, 10**12)])
def test_elias_fano_finds_what_it_holds(n, u):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, u, n).astype(np.uint64))
    ef = lm.EliasFano.build(v, u)
    assert (ef.values() == v).all()
    q = np.concatenate([v, r.integers(0, u, 300).astype(np.uint64)])
    at = {int(x): i for i, x in enumerate(v)}
    assert ef.find(q).tolist() == [at.get(int(x), -1) for x in q]


@pytest.mark.parametrize("hot", [1, 15, 16, 17, 300, 5000])
def test_search_in_a_range(hot):
    """Ranges on both sides of the width from which another search is taken; one range holds most elements."""
    r = np.random.default_rng(hot)
    sizes = np.array([0, 3, hot, 0, 0, 1, 16, 17, 2])
    size = 20_000
    v = np.concatenate([c * size + np.sort(r.choice(size, n, replace=False)) for c, n in enumerate(sizes)]).astype(np.uint64)
    ef = lm.EliasFano.build(v, len(sizes) * size)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    q = np.concatenate([v, r.integers(0, len(sizes) * size, 3000).astype(np.uint64)])
    context = (q // np.uint64(size)).astype(np.int64)
    at = {int(x): i for i, x in enumerate(v)}
    assert ef.find(q, ends[context], ends[context + 1]).tolist() == [at.get(int(x), -1) for x in q]


def test_select():
    r = np.random.default_rng(5)
    bits = np.concatenate([r.integers(0, 2**64, 500, np.uint64), r.integers(0, 2**64, 500, np.uint64) & r.integers(0, 2**64, 500, np.uint64) >> np.uint64(40), np.array([1, 2**63, 2**64 - 1], np.uint64)])
    for b in bits.tolist():
        ones = [i for i in range(64) if b >> i & 1]
        assert lm.select(np.full(len(ones), b, np.uint64), np.arange(len(ones))).tolist() == ones


def test_packing_round_trip():
    r = np.random.default_rng(1)
    k = np.unique(r.integers(0, 2**60, 5000).astype(np.uint64))
    c = r.choice([1, 2, 254, 255, 100_000], len(k))
    a, b = lm.unpack(lm.pack(k, c))
    assert (a == k).all() and (b == c).all()


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def brute(train, docs, order):
    """The same model from plain dictionaries; discounts are taken from the whole level."""
    counts = [Counter() for _ in range(order + 1)]
    for w in train:
        for k in range(1, order + 1):
            counts[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    d = [0, *(lm.discount(sum(c == 1 for c in x.values()), sum(c == 2 for c in x.values())) for x in counts[1:])]
    total, kinds = [Counter() for _ in counts], [Counter() for _ in counts]
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    out = []
    for w in docs:
        s = b = 0.0
        for j, x in enumerate(w):
            c = counts[1].get((x,), 0)
            p = (max(c - d[1], 0) / n + d[1] * v / n / (v + 1)) if n else 1 / (v + 1)
            b += math.log10((c + 1) / (n + v + 1))
            for k in range(2, order + 1):
                h = tuple(w[j - k + 1 : j])
                if j >= k - 1 and total[k][h]:
                    p = max(counts[k].get((*h, x), 0) - d[k], 0) / total[k][h] + d[k] * kinds[k][h] / total[k][h] * p
            s += math.log10(p)
        out.append((len(w), sum((x,) in counts[1] for x in w), n, b, s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model_equals_dictionaries(spark, order):
    rows = fixtures.numbered(40)
    df = fixtures.frame(spark, rows)
    got = {(r.doc_id, round(r.base_score, 6)): r for r in lm.score(df, lm.train(df, order, 1), order).collect()}
    for (i, _), want in zip(rows, brute([tokens(t) for _, t in rows], [tokens(t) for _, t in rows], order)):
        r = got[i, round(want[3], 6)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.score == pytest.approx(want[4], rel=0.02)  # codes of 256 values


@pytest.mark.parametrize("order", [3, 4])
def test_shards_agree(spark, order):
    """Scores don't depend on where levels are cut; a first word that is half of all tokens is cut too."""
    hot = [(1000 + i, " ".join(f"the w{(i * 7 + j) % 90}" for j in range(60))) for i in range(30)]
    rows = [*fixtures.numbered(40), *hot]
    df = fixtures.frame(spark, rows)
    want = sorted(w[4] for w in brute([tokens(t) for _, t in rows], [tokens(t) for _, t in rows], order))
    scores = [sorted(r.score for r in lm.score(df, lm.train(df, order, s), order).collect()) for s in (1, 7, 64)]
    assert scores[1] == pytest.approx(scores[0], rel=1e-9) and scores[2] == pytest.approx(scores[0], rel=1e-9)
    assert scores[2] == pytest.approx(want, rel=0.02)


def test_hot_first_word_is_split(spark):
    df = fixtures.frame(spark, [(i, " ".join(f"the w{i}x{j}" for j in range(100))) for i in range(40)])
    folder, _ = lm.train(df, 3, 8)
    sizes = np.diff(lm.Trie(folder, 3).bounds(3))
    assert sizes.max() < 2 * sizes.mean()


def test_pointers_give_the_children():
    r = np.random.default_rng(2)
    v = np.sort(r.integers(0, 9000, 4000).astype(np.uint64))
    ef = lm.EliasFano.build(v, 9001)
    i = r.integers(0, 4000, 500)
    assert (ef.access(i) == v[i]).all()


def test_pointers_give_the_next_too():
    v = np.sort(np.random.default_rng(3).choice([0, 1, 700, 701, 9000], 400)).astype(np.uint64)  # long runs, long gaps
    ef = lm.EliasFano.build(v, 9001)
    i = np.arange(len(v) - 1)
    own, after = ef.access(i, following=True)
    assert (own == v[:-1]).all() and (after == v[1:]).all()


ODD = ["", " ", "a", " A\tb\n", "a\x0bb\x0cc\r", "x" * 31, "x" * 32, "x" * 33, "X" * 500 + " x", "\x00 \x00\x00 \x08 \x0e\x1f", "Straße ÄÖ\u00a0ü\u2003", "e E \x1c \x85", None, "b", "bb bbbbbbbb bbbbbbbbb", "end"]


def chunk(texts):
    ((_, data, off),) = lm.text_chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))
    return data, off


def test_tokens_of_odd_texts():
    """The same texts' words and ends as splitting gives; equal hashes exactly for equal words."""
    hashes, at = lm.token_hashes(*chunk(ODD))
    want = [w for t in ODD for w in tokens(t)]
    assert np.diff(at).tolist() == [len(tokens(t)) for t in ODD] and len(hashes) == len(want)
    assert len(set(zip(hashes.tolist(), want))) == len(set(hashes.tolist())) == len(set(want))


def test_words_are_hashed_together(monkeypatch):
    """CPU seconds: no step of Python for each short word."""
    calls = []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or 7)
    lm.token_hashes(*chunk([f"w{i} v{i % 7}" for i in range(2000)] + ["y" * 40]))
    assert calls == [b"y" * 40]


def test_batches_are_scored_together(spark, monkeypatch):
    """CPU seconds: what repeats in the next small batch is searched once; scores are those of the batches alone."""
    texts = [t for _, t in fixtures.numbered(40)]
    model = lm.train(fixtures.frame(spark, fixtures.numbered(40)), 3, 4)
    monkeypatch.setattr(lm, "map_arrow", lambda df, fn, schema: fn)
    run = lm.score(fixtures.frame(spark, []), model)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    searched = []
    find = lm.EliasFano.find
    monkeypatch.setattr(lm.EliasFano, "find", lambda self, x, *more: searched.append(len(x)) or find(self, x, *more))
    alone = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    once = sum(searched)
    assert pa.Table.from_batches(run(iter([batch] * 3))).to_pylist() == alone * 3
    assert sum(searched) == 2 * once > 0
    assert sum(b.num_rows for b in lm.joined(iter([batch] * 5), batch.nbytes * 2)) == 5 * len(texts)
    assert [b.num_rows for b in lm.joined(iter([batch] * 3), 1)] == [len(texts)] * 3


def test_searches_do_not_grow_with_shards(spark, monkeypatch):
    """CPU seconds: a level is searched as a whole, not shard by shard."""
    rows = fixtures.numbered(40)
    df = fixtures.frame(spark, rows)
    models = [lm.train(df, 3, shards) for shards in (1, 64)]
    monkeypatch.setattr(lm, "map_arrow", lambda df, fn, schema: fn)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    calls, scores = [], []
    find = lm.EliasFano.find
    monkeypatch.setattr(lm.EliasFano, "find", lambda self, x, *more: calls.append(len(x)) or find(self, x, *more))
    for model in models:
        scores.append(pa.Table.from_batches(lm.score(df, model)(iter([batch])))["score"].to_pylist())
        calls.append(None)
    assert scores[0] == scores[1]
    one, many = calls[: calls.index(None)], calls[calls.index(None) + 1 : -1]
    assert one == many and len(one) == 2
    assert sorted(f for f in os.listdir(models[1][0])) == sorted(["words", *(f"{n}{k}" for k in (2, 3) for n in ("level", "sections", "bounds", "tables", "codes"))])


def test_sections_are_one_sequence(spark):
    """Pointers found across shards are those of each shard; many shards hold nothing."""
    folder, _ = lm.train(fixtures.frame(spark, fixtures.numbered(20)), 3, 40)
    for k in (2, 3):
        level = lm.Level(folder, k)
        sizes = np.diff(level.contexts)
        shard = np.repeat(np.arange(40), sizes)
        local = np.concatenate([np.arange(n) for n in sizes])
        own = [level.pointers_of(s) + level.starts[s] for s in range(40)]
        begin, end = level.children(local, shard)
        assert begin.tolist() == [x for p in own for x in p[:-1].tolist()] and end.tolist() == [x for p in own for x in p[1:].tolist()]


def test_repeated_tasks_do_no_harm(spark, monkeypatch):
    """Every task of the training runs twice, also those that join shards and remove them."""
    df = fixtures.frame(spark, fixtures.numbered(20))
    want = sorted(r.score for r in lm.score(df, lm.train(df, 3, 5)).collect())
    once = lm.map_arrow
    monkeypatch.setattr(lm, "map_arrow", lambda df, fn, schema: (once(df, fn, schema).count(), once(df, fn, schema))[1])
    model = lm.train(df, 3, 5)
    monkeypatch.undo()
    assert sorted(r.score for r in lm.score(df, model).collect()) == want


def test_query(spark, tmp_path):
    rows = fixtures.numbered()
    out = lm.op2_lm(spark, fixtures.tables(tmp_path, spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert sum(r.score for r in out if not r.held_out) > sum(r.base_score for r in out if not r.held_out)


def test_nothing_to_learn_from(spark):
    df = fixtures.frame(spark, [(1, "some words"), (2, None)])
    out = {r.doc_id: r for r in lm.score(df, lm.train(df.where("false"))).collect()}
    assert out[1].n_known == 0 and out[1].train_tokens == 0 and out[1].score == 0.0
