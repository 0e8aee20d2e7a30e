from __future__ import annotations

import random
import zlib

import numpy as np

from larkspur.llm import quality as q
from tests.llm import fixtures


def corpus(n=400, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = [word() for _ in range(r.randint(5, 80))]
        if good:
            text = " ".join(words).capitalize() + "."
        else:
            text = r.choice([" | ".join(words), "%%% ".join(words), "!! ".join(words).upper(), " ".join([words[0]] * 30)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    out = q.op10_quality(spark, fixtures.tables(tmp_path, spark, [*rows, (5000, None), (5001, ""), (None, "x")], labels)).collect()
    assert len(out) == len(rows) + 3
    truth = {i: y for i, y, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_scores_mean_the_same_below_and_above_the_bound(spark):
    """With a bound below the class sizes the fit sees equal classes; the share of label 1 stays the natural one."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1500):  # classes that no text tells apart for sure
        good = r.random() < 0.86
        rows.append((i, "up" if good == (r.random() < 0.85) else "down"))
        labels.append((i, int(good)))
    docs, marks = fixtures.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    share = sum(y for _, y in labels) / len(labels)
    for most in (6000, 400):
        scores = [x.larkspur_score for x in q.score_quality(docs, q.fit_quality(docs, marks, most)).collect()]
        assert abs(sum(scores) / len(scores) - share) < 0.08, (most, sum(scores) / len(scores))


def test_held_out_labels_teach_nothing(spark, tmp_path):
    rows, labels = corpus(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (sorted(map(tuple, q.op10_quality(spark, fixtures.tables(tmp_path / n, spark, rows, x)).collect())) for n, x in (("a", labels), ("b", flipped)))
    assert a == b


def test_dual_descent_separates():
    rows = [(np.array([0, 2 + i % 3]), np.array([0.8, 0.6])) for i in range(20)] + [(np.array([1, 2 + i % 3]), np.array([0.8, 0.6])) for i in range(20)]
    y = np.array([1] * 20 + [-1] * 20)
    w, b = q.dual_descent(rows, y, np.ones(40))
    assert all(s * (w[at] @ v + b) > 0.5 for (at, v), s in zip(rows, y))


def test_features_are_indicators_of_the_whole_text():
    doc, bucket = q.features([b"", b"a a a b", b"a a a b a a a b"])
    pairs = list(zip(doc.tolist(), bucket.tolist()))
    assert len(pairs) == len(set(pairs)) and set(bucket[doc == 1]) <= set(bucket[doc == 2]) and (doc == 0).sum() == 1


def test_one_class_none_and_no_rows(spark):
    docs = fixtures.frame(spark, [(1, "x"), (2, "y")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert q.fit_quality(docs, labels).constant == 1.0
    none = q.fit_quality(docs, labels.where("false"))
    assert none.constant == 0.5
    scored = q.score_quality(docs, none)
    assert scored.columns == [*docs.columns, "larkspur_score"] and scored.where("false").count() == 0


def plain_model(texts, y):
    """NBSVM from dictionaries and a dense solve: string n-grams, Counter ratios, hinge dual by full passes to convergence."""
    import re
    from collections import Counter

    def grams(text):
        w = text.split()
        forms = []
        for i, x in enumerate(w):
            head, core, tail = re.match(r"^([^0-9A-Za-z\x80-￿]*)(.*?)([^0-9A-Za-z\x80-￿]*)$", x, re.S).groups()
            kind = "-" if not core else "9" if core.isdigit() else "x" if core.islower() else "X" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() and core[1:].islower() else "m"
            forms.append((head[:3] + kind + tail[:3], i > 0 and x.lower() == w[i - 1].lower()))
        low = [x.lower() for x in w]
        return {("w", a) for a in low} | {("ww", *p) for p in zip(low, low[1:])} | {("f", a) for a in forms} | {("ff", *p) for p in zip(forms, forms[1:])} | {("fff", *p) for p in zip(forms, forms[1:], forms[2:])} | ({"empty"} if not w else set())

    sets, room = [grams(t) for t in texts], 1 << q.BITS
    names = {g: i for i, g in enumerate(sorted(set().union(*sets), key=str))}

    def train(keep):
        good, bad = Counter(g for i in keep if y[i] > 0 for g in sets[i]), Counter(g for i in keep if y[i] < 0 for g in sets[i])
        total = [room + sum(c.values()) for c in (good, bad)]
        x = np.zeros((len(texts), len(names) + 1))
        for i, s in enumerate(sets):
            for g in s:
                x[i, names[g]] = np.log((1 + good[g]) / total[0]) - np.log((1 + bad[g]) / total[1])
            x[i] /= max(np.linalg.norm(x[i]), 1e-9)
        x[:, -1] = 1
        share = {1: np.mean(y[keep] > 0), -1: np.mean(y[keep] < 0)}
        cost, alpha, gram = np.array([0.5 / share[k] for k in y[keep]]), np.zeros(len(keep)), x[keep] @ x[keep].T
        for _ in range(400):
            for j in range(len(keep)):
                g = y[keep[j]] * (gram[j] @ (alpha * y[keep])) - 1
                alpha[j] = min(max(alpha[j] - g / gram[j, j], 0), cost[j])
        return x @ (x[keep].T @ (alpha * y[keep]))

    every, fold = np.arange(len(y)), np.arange(len(y)) % 4 == 0
    left_out = train(every[~fold])[fold]
    a, b, t = 1.0, 0.0, y[fold] > 0
    for _ in range(50):  # Newton steps of the logistic curve with the ridge that the docstring of logistic names
        p = 1 / (1 + np.exp(-(a * left_out + b)))
        x = np.stack([left_out, np.ones(len(p))])
        a, b = np.array([a, b]) - np.linalg.solve((x * p * (1 - p)) @ x.T + 0.01 * np.eye(2), x @ (p - t) + 0.01 * np.array([a, b]))
    return 1 / (1 + np.exp(-(a * train(every) + b)))


def test_scores_equal_a_plain_model():
    """Classes that overlap, so that scores are spread between 0 and 1."""
    r = random.Random(9)
    word = lambda: r.choice("alpha beta gamma delta epsilon Zeta ETA theta, iota. 42 x1 --".split())
    y = np.array([1 if r.random() < 0.7 else -1 for _ in range(160)])
    texts = ["" if i == 5 else " ".join(["good" if (k > 0) == (r.random() < 0.75) else "poor", *(word() for _ in range(r.randrange(1, 9)))]) for i, k in enumerate(y)]
    raw = [t.encode() for t in texts]
    docs = [q.features([t])[1] for t in raw]
    got, want = q.fit(docs, y).score(raw), plain_model(texts, y)
    assert np.abs(got - want).max() < 0.03 and want.std() > 0.1


def test_labels_of_absent_documents_take_no_room(spark):
    rows, labels = corpus(120)
    docs = fixtures.frame(spark, rows)
    absent = [(10_000 + i, i % 2, 0) for i in range(3000)]
    marks = lambda x: spark.createDataFrame([(i, k) for i, k, _ in x], "doc_id long, quality int")
    a, b = q.fit_quality(docs, marks(labels), 60), q.fit_quality(docs, marks([*labels, *absent]), 60)
    assert (a.weights == b.weights).all() and a.offset == b.offset


def test_clashing_score_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 100_000, 5.0), (None, None, None)], "doc_id long, text string, larkspur_score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = q.score_quality(docs, q.fit_quality(docs.select("doc_id", "text"), labels))
    assert out.columns == ["doc_id", "text", "larkspur_score"] and [r.larkspur_score for r in out.collect()] == [1.0, 1.0]
