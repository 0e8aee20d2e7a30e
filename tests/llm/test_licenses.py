from __future__ import annotations

import re

from larkspur.llm import licenses as li
from tests.llm import fixtures


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


ODD = ["MIT, license", "mit-license mit license", "GNU  general\npublic; LICENSE!", "xmit license", "mit licensex", "cc by cc-by ccby", "cc by" * 3, "Apache Licence", "gnu generl public license", "the mit licens", None, "", "license apache license", "日mit license"]


def test_base_places(spark, tmp_path):
    rows = [*enumerate(ODD), *((100 + i, t) for i, t in fixtures.numbered(30) if i is not None)]
    out = {}
    for r in li.op6_licenses(spark, fixtures.tables(tmp_path, spark, rows)).collect():
        out[r.doc_id] = r
    for i, t in rows:
        w, hits = words(t), []
        for n in li.BASE:
            p = n.phrase.split()
            hits += [(j, n.label) for j in range(len(w)) if w[j : j + len(p)] == p]
        r = out[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits)), t
        assert (r.first_word, r.last_word) == (min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None)), t
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_errors_are_found_and_bounded():
    s = li.Scanner(li.BASE + li.MORE)
    found = lambda t: {(h[0], h[3]) for h in s.scan(t.encode())[1]}
    assert ("apache", 1) in found("under the Apache Licence here")
    assert ("gpl", 2) in found("gnu genral publc license")
    assert not found("gnu gnral publc licens") & {("gpl", 3)}
    assert not found("an ordinary sentence about licences and mittens")
    assert ("mit", 2) in found("Permission is hereby granted, free of charg, to any persn obtaining a copy")


def test_seeds_miss_nothing():
    """Every text within the bound has an exact piece: pigeonhole."""
    import random

    r, s = random.Random(1), li.Scanner(li.BASE)
    phrase = "gnu general public license"
    for _ in range(300):
        t = list(phrase)
        for _ in range(2):
            i = r.randrange(len(t))
            if t[i] != " ":
                t[i] = r.choice("abcxyz")
        assert any(h[0] == "gpl" for h in s.scan(("x " + "".join(t) + " y").encode())[1]), "".join(t)


def test_empty_table(spark):
    assert li.license_scan(fixtures.frame(spark, [(1, "x")]).where("false")).count() == 0


def test_fuzzy_labels_equal_a_search_without_seeds():
    """Every label that the bounded-error pattern finds anywhere in the text, and no other."""
    import random

    import regex

    r, s = random.Random(4), li.Scanner(li.BASE + li.MORE)
    patterns = [(n, regex.compile(r"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(n.phrase), n.errors))) for n in li.BASE + li.MORE]
    for _ in range(120):
        parts = []
        for _ in range(3):
            t = list(r.choice(li.BASE + li.MORE).phrase)
            for _ in range(r.randrange(0, 8)):
                i = r.randrange(len(t))
                t[i] = r.choice(["", t[i] + "x", "y", t[i]]) if t[i] != " " else t[i]
            parts += ["".join(t), r.choice(["plain words", "lorem", "x1 y2 z3"])]
        flat = " ".join(words(" ".join(parts)))
        want = {n.label for n, p in patterns if p.search(flat)}
        assert {h[0] for h in s.scan(flat.encode())[1]} == want, flat


def test_very_many_notices_in_one_text():
    import time

    s, took = li.Scanner(li.BASE + li.MORE), []
    for n in (4000, 16_000):
        text = b"the mit license, or Apache Licence; " * n
        began = time.perf_counter()
        count, hits = s.scan(text)
        took.append(time.perf_counter() - began)
        assert count == 6 * n and sum(h[0] == "mit" for h in hits) >= n and sum(h[0] == "apache" for h in hits) == n
        assert hits[-1][1] >= 6 * n - 5
    assert took[1] < 8 * took[0] + 0.5


def test_extra_columns_take_no_part(spark):
    df = spark.createDataFrame([(1, "mit license", "x", 3), (1, "mit license", "x", 3), (None, None, None, None)], "doc_id long, text string, hits string, n_words int")
    assert sorted((str(r.doc_id), r.n_words, len(r.hits)) for r in li.license_scan(df).collect()) == [("1", 2, 1), ("1", 2, 1), ("None", 0, 0)]
