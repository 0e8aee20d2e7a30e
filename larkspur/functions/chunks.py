"""Text chunkers over Arrow batches, and identifiers that need 64-bit wrap-around.

Sentences end at . ! ? … or their wide forms before white space, or at a blank line: a documented rule in
place of the break iterator of another platform.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import ship_package

_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n{2,}")
_WORD = re.compile(r"[^\W_]+(?:['’.,][^\W_]+)*")
SCHEMA = "doc_id long, chunk_id string, idx int, text string, start_char int, end_char int, tokens int"


def sentence_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in _SENTENCE.finditer(text) if m.end() < len(text))]


def char_chunks(text: str, size: int = 512, overlap: int = 64) -> list[tuple[int, int]]:
    """Spans of at most `size` characters that end at the last sentence start in reach; the next one begins
    at the first boundary in the last `overlap` characters."""
    if not text:
        return []
    starts, spans, at = sentence_starts(text), [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            i = bisect.bisect_right(starts, end) - 1
            if i >= 0 and starts[i] > at:
                end = starts[i]
        spans.append((at, end))
        if end >= len(text):
            break
        i = bisect.bisect_left(starts, end - overlap)
        back = starts[i] if i < len(starts) and starts[i] <= end else end
        at = back if back > at else end
    return spans


def token_chunks(text: str, most: int = 256, overlap: int = 0) -> list[tuple[int, int]]:
    """Spans of whole sentences with at most `most` words; a longer sentence is cut by words."""
    starts = sentence_starts(text)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if not words:
        return []
    begins = [w[0] for w in words]
    spans, first = [], 0
    while first < len(words):
        last = min(len(words), first + most)
        if last < len(words):
            i = bisect.bisect_right(starts, begins[last]) - 1
            cut = bisect.bisect_left(begins, starts[i])
            if cut > first:
                last = cut
        spans.append((begins[first], words[last - 1][1]))
        if last >= len(words):
            break
        first = max(last - overlap, first + 1)
    return spans


def streaming_chunks(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """Windows that break, in their last half, after a paragraph, a sentence, a line or white space; fixed overlap."""
    spans, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            half = text[at + size // 2 : end]
            for pattern in (r"\n\n", r"[.!?]\s", r"\n", r"\s"):
                found = list(re.finditer(pattern, half))
                if found:
                    end = at + size // 2 + found[-1].end()
                    break
        spans.append((at, end))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return spans


def chunk(docs: DataFrame, cut: Callable[[str], list[tuple[int, int]]], separator: str = "::chunk-") -> DataFrame:
    """Chunks of rows (doc_id, text) by a cutting function."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, e) in enumerate(cut(text or "")):
                    rows.append((doc_id, f"{doc_id}{separator}{i}", i, text[s:e], s, e, len(_WORD.findall(text[s:e]))))
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = ("doc_id", "chunk_id", "idx", "text", "start_char", "end_char", "tokens")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def _mix64(h: int) -> int:
    m = 2**64 - 1
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & m
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & m
    return h ^ (h >> 33)


def tag_mask(tags: list[str] | None, hashes: int = 3) -> int:
    """A 64-bit Bloom mask of lower-cased tags, as a signed integer."""
    mask = 0
    for tag in tags or ():
        h = 0xCBF29CE484222325
        for byte in tag.lower().encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
        one, two = _mix64(h), _mix64(h ^ 0x9E3779B97F4A7C15) | 1
        for i in range(hashes):
            mask |= 1 << ((one + i * two) % 64)
    return mask - 2**64 if mask >= 2**63 else mask


def with_tag_masks(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """(id, mask) of rows with id and an array of tags; distinct sets of a batch are hashed once."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        for b in batches:
            masks = []
            for t in b.column(1).to_pylist():
                key = tuple(t or ())
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = tag_mask(list(key))
                masks.append(known[key])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masks, pa.int64())], ["id", "mask"])

    return rows.select(F.col("id").cast("long"), tags).mapInArrow(run, "id long, mask long")


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def time_sorted_id(ms: int, node: int, sequence: int, epoch: int = 1_577_836_800_000) -> str:
    """13 characters: milliseconds since the epoch, 10 bits of node, 12 of sequence."""
    value = ((ms - epoch) << 22) | ((node & 0x3FF) << 12) | (sequence & 0xFFF)
    return "".join(_CROCKFORD[(value >> (5 * i)) & 31] for i in reversed(range(13)))


def ring_shards(keys: list[str], shards: int, replicas: int = 150) -> np.ndarray:
    """Shards by consistent hashing: first 8 bytes of MD5 on a ring of virtual nodes."""
    place = lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big")
    ring = sorted((place(f"shard-{s}-vnode-{r}"), s) for s in range(shards) for r in range(replicas))
    points = np.array([p for p, _ in ring], np.uint64)
    owners = np.array([s for _, s in ring])
    at = np.searchsorted(points, np.array([place(k) for k in keys], np.uint64))
    return owners[at % len(ring)]
