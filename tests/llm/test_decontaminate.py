from __future__ import annotations

import hashlib
import random
import re

import pytest

from larkspur.llm import decontaminate as dc
from tests.llm import fixtures


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for win in {tuple(b[j : j + 10]) for j in range(max(1, len(b) - 9))} if b else ():
                for j in range(len(w) - len(win) + 1):
                    if tuple(w[j : j + len(win)]) == win:
                        hit.update(range(j, j + len(win)))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def case():
    r = random.Random(6)
    pool = "alpha beta gamma delta é École Straße x1 the of".split()
    item = lambda k: " ".join(r.choice(pool) for _ in range(k))
    items = [(i, item(r.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(20, None), (21, ""), (22, "!!"), (23, item(30))]
    items.append((24, items[-1][1]))  # the same text twice
    docs = [(0, None), (1, ""), (2, "ÉCOLE école"), (3, "ecole École, STRASSE straße Straße")]
    for i in range(4, 60):
        a = r.choice(items)[1] or ""
        docs.append((i, r.choice([item(r.randrange(1, 80)), f"{item(5)} {a.upper()}! {item(5)}", f"{a}, {a} {a}", a.replace(" ", "\n-- ")])))
    return docs, items


def test_query_equals_brute_force(spark, tmp_path):
    docs, items = case()
    folder = fixtures.tables(tmp_path, spark, docs, benchmark=items)
    got = {r.doc_id: tuple(r)[1:] for r in dc.op8_decontaminate(spark, folder).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("most", [0, 10**6])
def test_joins_by_shuffle_and_by_broadcast_agree(spark, monkeypatch, most):
    docs, items = case()
    monkeypatch.setattr(dc, "MOST_BROADCAST", most)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in dc.decontaminate(d, b).collect()}
    assert got == {i: x[:3] for i, x in brute(docs, items).items()}


def test_no_benchmark_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "c d e"), (None, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in dc.decontaminate(d, empty).collect()) == [(1, 0), (2, 0), (3, 0)]
    b = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in dc.decontaminate(d, b).collect()) == [(1, 0), (2, 2), (3, 0)]
    assert dc.decontaminate(d.where("false"), b).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_very_long_texts_and_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "MOST_BROADCAST", most)
    r = random.Random(2)
    pool = [f"w{i}" for i in range(50)]
    long = " ".join(r.choice(pool) for _ in range(30_000))
    item = " ".join(words(long)[20_000:20_014])
    d = spark.createDataFrame([(1, long, 9, "q", [1]), (1, long, 9, "q", [1]), (2, item, None, None, None)], "doc_id long, text string, n int, token string, items array<int>")
    b = spark.createDataFrame([(5, item, 1), (5, item, 1), (None, item, 1)], "item_id long, text string, n int")
    want = brute([(1, long), (2, item)], [(5, item)])
    got = [(x.doc_id, x.n_words, x.n_hit) for x in dc.decontaminate(d, b).collect()]
    assert sorted(got) == [(1, *want[1][:2])] * 2 + [(2, *want[2][:2])]


def test_shuffle_carries_places_not_texts(spark, tmp_path, monkeypatch):
    """Beyond MOST_BROADCAST a document's words are not in the row of each of its words."""
    monkeypatch.setattr(dc, "MOST_BROADCAST", 0)
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = dc.find_windows(d, b)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("posexplode")
    assert "key#" in plan[:at] and not re.search(r"Generate posexplode\(w#", plan)
