"""License scans by fuzzy search for short notices.

The text is reduced to its words (A-Z lower-cased, joined by single spaces). A notice of n characters may
be matched with k errors; cut into k+1 pieces, at least one piece must occur exactly (pigeonhole). One
automaton finds all pieces of all notices; around each, the regex library's bounded-error matching
verifies the notice, and spans with the fewest errors are kept. A notice must begin and end at word ends.

Null or empty text has no words and no hits. Each row is scanned as a whole, repeated rows each for
themselves; of overlapping spans of one notice the best stays (fewest errors, then leftmost). A very long text
takes time as its length and its hits. An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, text_chunks, texts_of, worker_cache

#: Every byte that is no part of a word becomes a space; A-Z become a-z.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    base: bool = False


BASE = (
    Notice("gpl", "gnu general public license", 2, True),
    Notice("apache", "apache license", 1, True),
    Notice("cc-by", "cc by", 0, True),
    Notice("mit", "mit license", 1, True),
)
#: Notices that only add labels; about one error for twelve characters.
MORE = (
    Notice("gpl", "this program is free software you can redistribute it and or modify", 5),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("apache", "licensed under the apache license version 2 0", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "mozilla public license", 1),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("all-rights-reserved", "all rights reserved", 1),
)
HITS = "array<struct<label:string,word_start:bigint,word_end:bigint,errors:int,length:int,base:boolean>>"
HIT_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("errors", pa.int32()), ("length", pa.int32()), ("base", pa.bool_())]))


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            phrase, k = notice.phrase, notice.errors
            for j in range(k + 1):
                a, b = len(phrase) * j // (k + 1), len(phrase) * (j + 1) // (k + 1)
                seeds.setdefault(phrase[a:b], []).append((number, a))
            self.patterns.append(regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(phrase.encode()), k)) if k else None)
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        """Number of words, and hits (label, first word, word after the last, errors, length, base)."""
        words = text.translate(WORD_TABLE).split()
        flat = b" ".join(words)
        tried: set[tuple[int, int]] = set()
        found: dict[tuple[int, int, int], int] = {}
        exact: set[tuple[int, int]] = set()
        for end, (length, where) in self.automaton.iter(flat.decode("latin-1")):
            for number, at in where:
                start = end + 1 - length - at
                if (number, start) in tried:
                    continue
                tried.add((number, start))
                notice = self.notices[number]
                phrase, k = notice.phrase.encode(), notice.errors
                stop = start + len(phrase)
                if start >= 0 and flat.startswith(phrase, start) and (start == 0 or flat[start - 1] == 32) and (stop == len(flat) or flat[stop] == 32):
                    found[number, start, stop] = 0
                    exact.add((number, start))
                elif k:
                    a = max(0, start - k)
                    # the window begins and ends at word ends; the pattern looks at the neighbours itself
                    if m := self.patterns[number].search(flat, a, min(len(flat), stop + k)):
                        if (m.end() == len(flat) or flat[m.end()] == 32) and (m.start() == 0 or flat[m.start() - 1] == 32):
                            found.setdefault((number, m.start(), m.end()), sum(m.fuzzy_counts))
        hits: list[tuple] = []
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) if found else np.zeros(0, np.int64)
        # starts and ends of the accepted spans of each notice, which don't overlap
        last: dict[int, tuple[list[int], list[int]]] = {}
        for (number, start, stop), errors in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            starts, stops = last.setdefault(number, ([], []))
            place = bisect.bisect_left(starts, stop)
            if place and stops[place - 1] > start:
                continue  # a better match of the same notice covers this place
            starts.insert(place, start)
            stops.insert(place, stop)
            notice = self.notices[number]
            first, after = np.searchsorted(spaces, (start, stop)).tolist()
            hits.append((notice.label, first, after + 1, errors, len(notice.phrase), notice.base and not errors))
        hits.sort(key=lambda h: (h[1], h[0], h[2], h[3]))
        return len(words), hits


def scanner(notices: tuple[Notice, ...]) -> Scanner:
    cache = worker_cache()
    key = ("licenses", tuple((n.label, n.phrase, n.errors, n.base) for n in notices))
    if key not in cache:
        cache[key] = Scanner(notices)
    return cache[key]


def license_scan(df: DataFrame, notices: tuple[Notice, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): each hit with its label, word span, errors and the notice's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(notices)
        for batch in batches:
            for part, data, off in text_chunks(batch):
                counts, hits = zip(*map(own.scan, texts_of(data, off)))
                rows = [[dict(zip(("label", "word_start", "word_end", "errors", "length", "base"), h)) for h in x] for x in hits]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(rows, HIT_TYPE)], ["doc_id", "n_words", "hits"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id long, n_words long, hits {HITS}")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    scanned = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("hits", lambda h: h["base"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["word_start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: 1 - h["errors"] / h["length"])), F.lit(0.0)).cast("double").alias("score"),
        F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["word_start"].cast("string"), h["word_end"].cast("string"), h["errors"].cast("string"))).alias("spans"),
    )
