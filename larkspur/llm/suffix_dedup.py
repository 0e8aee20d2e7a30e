"""Suffix-array dedup: every byte covered by a 200-byte string that starts more than once is removed.

Suffix sorting is linear grouping construction: suffixes are grouped by their Lyndon prefixes, groups are
processed in descending order through previous-smaller pointers, and then each group's order is emitted
from the sorted smaller suffixes, without renaming or recursion (`suffix_array`).

A corpus is cut so that equal strings meet. The anchor of a 200-byte window is its leftmost 32-byte
string with the smallest hash; equal windows have equal anchors at equal places. The windows of one anchor
occurrence are a context (some 300 bytes). Three reads of the texts:

1. Contexts are counted by (hash of the anchor, hash of the context), in sorted blocks. An anchor that
   occurs once has no repeat. The others go on.
2. Their texts, each distinct one once with its multiplicity, meet by anchor: shards are dealt by a second
   mix of the anchor's hash, and a shard's contexts come sorted by anchor, so that one batch of anchors is
   held at a time. All of a batch become one string of 8-byte letters aligned to the anchors; its suffix array brings suffixes with 24
   equal letters together; the 0 to 7 bytes before and the 8 to 1 bytes after are compared exactly.
3. Windows found repeated are marked, and what they cover is cut out.

An anchor with more than HOT distinct contexts is not brought together: its windows are counted one by one
by two 64-bit hashes, which spreads them over all tasks.

Null counts as empty. Texts shorter than the window lose nothing. A repeated row is a repeat of its text,
so both lose all bytes if they have 200. Very long texts are read in segments; a window belongs to one.
Contexts are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import by_shard, map_arrow, shared_dir, text_chunks, worker_cache
from larkspur.llm.ngram_lm import map_arrays, pack, save_arrays, unpack
from larkspur.llm.ngram_lm import shard_of as range_of

LENGTH = 200
ANCHOR = 32
LETTER = 8
SEGMENT = 1 << 19
#: Distinct contexts of one anchor that are brought together.
HOT = 20_000
#: Letters that one suffix array holds; one anchor's contexts are never parted.
MOST_LETTERS = 150_000
MOST_HELD = 2_000_000
_U = np.uint64
_MULT = 6364136223846793005
_INVERSE = pow(_MULT, -1, 2**64)


# --- suffix array ------------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of integers whose last one is smaller than all others and occurs once.

    group[i] is the first place of suffix i's group, size[] the groups' sizes by first place.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    order = np.argsort(np.asarray(text), kind="stable")
    values = np.asarray(text)[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], values[1:] != values[:-1]]), np.arange(n), 0))
    groups = np.empty(n, np.int64)
    groups[order] = start
    places = np.empty(n, np.int64)
    places[order] = np.arange(n)
    group, place, sa = groups.tolist(), places.tolist(), order.tolist()
    size = np.bincount(start, minlength=n).tolist()
    previous = [-1] * n
    jump = list(range(-1, n - 1))
    end = n - 1
    while end > 0:
        first = group[sa[end]]
        members = sa[first : end + 1]
        end = first - 1
        # previous suffix of a lower group, for each member; how many members share it
        if len(members) == 1:
            i = members[0]
            j = jump[i]
            while j >= 0 and group[j] >= first:
                j = jump[j]
            previous[i] = jump[i] = j
            if j < 0:
                continue
            levels = ((j,),)
        else:
            shared: dict[int, int] = {}
            for i in members:
                j = jump[i]
                if j >= 0 and group[j] >= first:
                    path = [i]
                    while j >= 0 and group[j] >= first:
                        path.append(j)
                        j = jump[j]
                    for k in path:
                        jump[k] = j
                previous[i] = j
                if j >= 0:
                    shared[j] = shared.get(j, 0) + 1
            if not shared:
                continue
            most = max(shared.values())
            if most == 1:
                levels = (shared,)
            else:
                by = [[] for _ in range(most)]
                for j, times in shared.items():
                    by[most - times].append(j)
                levels = by
        for level in levels:  # those followed by more members first: they are larger
            if len(level) == 1:
                (j,) = level
                g = group[j]
                if size[g] > 1:
                    size[g] -= 1
                    last = g + size[g]
                    a, b = place[j], sa[last]
                    sa[a], sa[last] = b, j
                    place[b], place[j] = a, last
                    group[j] = last
                    size[last] = 1
                continue
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                moved[g] = moved.get(g, 0) + 1
                size[g] -= 1
                last = g + size[g]
                a, b = place[j], sa[last]
                sa[a], sa[last] = b, j
                place[b], place[j] = a, last
            for j in level:
                group[j] += size[group[j]]
            for g, times in moved.items():  # a group that went over as a whole keeps its place
                size[g + size[g]] = times
    # second phase: a placed suffix places those whose next smaller suffix it is
    result, free = [0] * n, list(range(n))  # free[g]: the next free place of group g
    result[0] = n - 1
    done = bytearray(n + 1)  # the last one stands for "before the text"
    done[n - 1] = done[n] = 1
    for at in range(n):
        j = result[at] - 1
        while not done[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = previous[j]
    return result


# --- anchors -----------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        p[k : k + m] = p[:m] * _U(pow(base, k, 2**64))
        k += m
    return p


def _tables():
    cache = worker_cache()
    key = ("suffix_tables", SEGMENT)
    if key not in cache:
        room = SEGMENT + LENGTH + 1
        letters = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64)
        cache[key] = letters, _powers(_MULT, room), _powers(_INVERSE, room)
    return cache[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a key. Anchors have the smallest of many hashes, so the shard is taken from a second mix."""
    return range_of(_mix(_mix(h ^ _U(0xD6E8FEB86659FD93))), shards)


def _smallest(a: np.ndarray, width: int) -> np.ndarray:
    k, m = 1, a
    while k * 2 <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (width - k)], m[width - k :]) if k < width else m


def segment_anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows, anchor place) of a segment of at least LENGTH bytes."""
    letters, up, down = _tables()
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[b] * up[:n], out=total[1:])
    h = _mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    keys = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = (_smallest(keys, LENGTH - ANCHOR + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    lo = np.concatenate([[0], change])
    windows = np.diff(np.append(lo, len(least)))
    place = least[lo]
    context = _mix((total[lo + windows + LENGTH - 1] - total[lo]) * down[lo] + windows.astype(np.uint64))
    return h[place], context, lo, windows, place


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all texts in `data`; places count in `data`. Also the text of each."""
    parts = []
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        while z - a >= LENGTH:
            stop = min(z, a + SEGMENT + LENGTH - 1)
            h, c, lo, w, p = segment_anchors(data[a:stop])
            parts.append((h, c, lo + a, w, p + a))
            a = stop - LENGTH + 1
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of one context."""
    letters, up, down = _tables()
    found = []
    for table in (letters, _mix(letters)):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * up[: len(b)], out=total[1:])
        found.append(_mix((total[LENGTH:] - total[:-LENGTH]) * down[: len(b) - LENGTH + 1]))
    return found[0], found[1]


# --- counted pairs of hashes ---------------------------------------------------------------------------


def merge_pairs(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], c[first], np.add.reduceat(n, first) if len(first) else n


def pack_pairs(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    head = pack(h, n)
    return len(head).to_bytes(8, "little") + head + c.tobytes()


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, ...]:
    size = int.from_bytes(blob[:8], "little")
    h, n = unpack(blob[8 : 8 + size])
    return h, np.frombuffer(blob, np.uint64, len(h), 8 + size), n


def find_pairs(known_h: np.ndarray, known_c: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of each (h, c) among sorted pairs, or -1."""
    a, b = np.searchsorted(known_h, h, "left"), np.searchsorted(known_h, h, "right")
    end = b.copy()
    while True:
        open_ = np.flatnonzero(a < b)
        if not len(open_):
            break
        mid = (a[open_] + b[open_]) >> 1
        less = known_c[mid] < c[open_]
        a[open_] = np.where(less, mid + 1, a[open_])
        b[open_] = np.where(less, b[open_], mid)
    hit = a < end
    result = np.full(len(h), -1, np.int64)
    at = np.flatnonzero(hit)
    result[at[known_c[a[at]] == c[at]]] = a[at[known_c[a[at]] == c[at]]]
    return result


class Known:
    """The files of one stage, mapped on first use."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.maps = folder, name, {}

    def shard(self, s: int) -> dict[str, np.ndarray] | None:
        if s not in self.maps:
            try:
                self.maps[s] = map_arrays(f"{self.folder}/{self.name}-{s}")[0]
            except FileNotFoundError:  # a shard without rows
                self.maps[s] = None
        return self.maps[s]

    def find(self, h: np.ndarray, c: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        shard, index = shard_of(h, shards), np.full(len(h), -1, np.int64)
        order = np.lexsort((h, shard))
        for group in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            own = self.shard(int(shard[group[0]]))
            if own is not None:
                index[group] = find_pairs(own["h"], own["c"], h[group], c[group])
        return shard, index


def known(folder: str, name: str) -> Known:
    cache = worker_cache()
    key = ("suffix", name)
    if key not in cache or cache[key].folder != folder:
        cache[key] = Known(folder, name)
    return cache[key]


def _count(source: DataFrame, shards: int, make) -> DataFrame:
    """(shard, block) of counted pairs; make gives (h, c) of a chunk."""

    def run(batches):
        held, n = [], 0

        def flush():
            h, c, times = merge_pairs(*(np.concatenate(x) for x in zip(*held)))
            where = shard_of(h, shards)
            order = np.argsort(where, kind="stable")  # by (shard, h, c)
            where, h, c, times = where[order], h[order], c[order], times[order]
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(h)]
            pieces = [(int(where[a]), pack_pairs(h[a:b], c[a:b], times[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.binary())], ["shard", "block"])

        for batch in batches:
            for _, data, off in text_chunks(batch):
                h, c = make(data, off)
                if len(h):
                    held.append(merge_pairs(h, c, np.ones(len(h), np.int64)))
                    n += len(held[-1][0])
                if n > MOST_HELD:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return map_arrow(source, run, "shard int, block binary")


def _merged(batches) -> tuple[np.ndarray, ...]:
    held, n = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("block")).to_pylist():
            held.append(unpack_pairs(blob))
            n += len(held[-1][0])
            if n > 2 * MOST_HELD:
                held = [merge_pairs(*(np.concatenate(x) for x in zip(*held)))]
                n = 0
    return merge_pairs(*(np.concatenate(x) for x in zip(*held)))


# --- the windows of anchors with several contexts ------------------------------------------------------


def repeated_windows(contexts: list[tuple[int, bytes, int, int]]) -> list[np.ndarray]:
    """For contexts (weight, bytes, anchor place in them, windows) of whole anchors: a mask of repeated windows each."""
    buffer, meta, letters_of = bytearray(), [], []
    pad = bytes(LETTER)
    bases, firsts, counts = [], [], []
    for weight, text, place, windows in contexts:
        first = place % LETTER  # letters begin at the anchor's alignment
        count = (len(text) - first) // LETTER
        bases.append(len(buffer) + LETTER)
        firsts.append(first)
        counts.append(count)
        buffer += pad + text + pad
        letters_of.append(np.frombuffer(text, ">u8", count, first))
    bases, firsts, counts = np.array(bases), np.array(firsts), np.array(counts)
    # one string: letters by rank from 2, 1 after each context, 0 at the end
    _, rank = np.unique(np.concatenate(letters_of), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    string = np.ones(starts[-1] + 1, np.int64)
    string[-1] = 0
    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    string[starts[owner] + inside] = rank + 2
    sa = np.array(suffix_array(string.tolist()))
    # suffixes with 24 letters of their own context; neighbours with equal ones form intervals
    need = LENGTH // LETTER - 1
    full_owner, full_inside = np.full(len(string), -1), np.zeros(len(string), np.int64)
    full_owner[starts[owner] + inside], full_inside[starts[owner] + inside] = owner, inside
    valid = full_owner[sa] >= 0
    valid &= full_inside[sa] + need <= np.where(valid, counts[np.maximum(full_owner[sa], 0)], 0)
    sa = sa[valid]
    masks = [np.zeros(c[3], bool) for c in contexts]
    if not len(sa):
        return masks
    # lengths of common prefixes matter only as "24 or more": invalid suffixes lie outside such intervals
    equal = np.ones(len(sa) - 1, bool)
    for t in range(need):
        live = np.flatnonzero(equal)
        equal[live] = string[sa[live] + t] == string[sa[live + 1] + t]
    interval = np.concatenate([[0], np.cumsum(~equal)])
    who, at8 = full_owner[sa], full_inside[sa] * LETTER + firsts[full_owner[sa]]
    weights = np.array([c[0] for c in contexts])
    windows = np.array([c[3] for c in contexts])
    some = np.bincount(interval, weights[who])[interval] >= 2
    interval, who, at8 = interval[some], who[some], at8[some]
    raw = np.frombuffer(bytes(buffer), np.uint8)
    eight = np.arange(LETTER)
    read = lambda place: raw[place[:, None] + eight].view(">u8").reshape(-1).astype(np.uint64)
    left, right = read(bases[who] + at8 - LETTER), read(bases[who] + at8 + need * LETTER)
    names, keys, owners, places = [], [], [], []
    for d in range(LETTER):  # windows that begin d bytes before the letter
        window = at8 - d
        ok = (window >= 0) & (window < windows[who])
        low = _U((1 << (8 * d)) - 1)
        names.append(interval[ok] * LETTER + d)
        keys.append((right[ok] & ~low) | (left[ok] & low))
        owners.append(who[ok])
        places.append(window[ok])
    name, key, own, place = map(np.concatenate, (names, keys, owners, places))
    order = np.lexsort((key, name))
    name, key, own, place = name[order], key[order], own[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])) if len(name) else np.zeros(0, np.int64)
    if len(first):
        total = np.repeat(np.add.reduceat(weights[own], first), np.diff(np.append(first, len(name))))
        hit = total >= 2
        offsets = np.concatenate([[0], np.cumsum(windows)])
        every = np.zeros(offsets[-1], bool)
        every[offsets[own[hit]] + place[hit]] = True
        masks = np.split(every, offsets[1:-1])
    return masks


TEXT, HOT_FLAG = 1, 2


def repeats(df: DataFrame, text_col: str = "text") -> tuple[str, int, bool]:
    """Find the repeated windows of rows (text); (folder, shards, whether there are hot anchors)."""
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_dir(spark, "suffix-dedup")
    source = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def write_known(shard, batches):
        h, c, n = _merged(batches)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(first, len(h)))
        total, several = np.repeat(np.add.reduceat(n, first), sizes), np.repeat(sizes, sizes)
        keep = total >= 2
        flag = np.where(several > HOT, HOT_FLAG, TEXT).astype(np.uint8)
        save_arrays(f"{folder}/known-{shard}", {"h": h[keep], "c": c[keep], "flag": flag[keep], "weight": np.minimum(n[keep], 2).astype(np.uint8)})
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int((flag[keep] == TEXT).sum())]), pa.array([int((flag[keep] == HOT_FLAG).sum())])], ["shard", "texts", "hot"])

    blocks = _count(source, shards, lambda data, off: anchors(data, off)[:2])
    # one row a shard
    counted = by_shard(blocks, shards, write_known, "shard int, texts long, hot long").collect()
    hot = any(r.hot for r in counted)

    def send_contexts(batches):
        seen = set()
        for batch in batches:
            for _, data, off in text_chunks(batch):
                h, c, lo, windows, place = anchors(data, off)
                files = known(folder, "known")
                shard, index = files.find(h, c, shards)
                rows = []
                for i in np.flatnonzero(index >= 0).tolist():
                    s, k = int(shard[i]), int(index[i])
                    if files.maps[s]["flag"][k] == TEXT and (s, k) not in seen:
                        seen.add((s, k))
                        a = int(lo[i])
                        rows.append((s, k, int(place[i]) - a, int(windows[i]), data[a : a + int(windows[i]) + LENGTH - 1].tobytes()))
                for j in range(0, len(rows), 4096):
                    cols = list(zip(*rows[j : j + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["shard", "index", "place", "windows", "context"])

    def sort_contexts(shard, batches):
        """Rows come by index, so by anchor: only the contexts of one suffix array are held."""
        own = known(folder, "known").shard(shard)
        n = len(own["h"])
        sizes, whole, packed = np.zeros(n, np.int64), np.zeros(n, np.uint8), []
        keys, held_rows, held = [], [], 0

        def finish():
            for k, mask in zip(keys, repeated_windows(held_rows)):
                whole[k] = mask.all()
                packed.append(np.packbits(mask) if not whole[k] else np.zeros(0, np.uint8))
                sizes[k] = len(packed[-1])

        for batch in batches:
            for k, place, windows, text in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("index", "place", "windows", "context"))):
                if keys and k == keys[-1]:  # sent by several tasks
                    continue
                if held > MOST_LETTERS and own["h"][k] != own["h"][keys[-1]]:
                    finish()
                    keys, held_rows, held = [], [], 0
                keys.append(k)
                held_rows.append((int(own["weight"][k]), text, place, windows))
                held += len(text) // LETTER
        if keys:
            finish()
        bits = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        save_arrays(f"{folder}/masks-{shard}", {"at": np.concatenate([[0], np.cumsum(sizes)]), "bits": bits, "whole": whole})
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(packed)])], ["shard", "n"])

    sent = map_arrow(source, send_contexts, "shard int, index long, place int, windows int, context binary")
    by_shard(sent, shards, sort_contexts, "shard int, n long", order="index").collect()

    if hot:

        def hot_windows(data, off):
            h, c, lo, windows, _ = anchors(data, off)
            files = known(folder, "known")
            shard, index = files.find(h, c, shards)
            found = [(np.zeros(0, np.uint64),) * 2]
            for i in np.flatnonzero(index >= 0).tolist():
                if files.maps[int(shard[i])]["flag"][index[i]] == HOT_FLAG:
                    found.append(window_hashes(data[lo[i] : lo[i] + windows[i] + LENGTH - 1]))
            return tuple(np.concatenate(x) for x in zip(*found))

        def write_hot(shard, batches):
            h, c, n = _merged(batches)
            save_arrays(f"{folder}/hot-{shard}", {"h": h[n >= 2], "c": c[n >= 2]})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

        by_shard(_count(source, shards, hot_windows), shards, write_hot, "shard int").collect()
    return folder, shards, hot


def marked(data: np.ndarray, off: np.ndarray, found: tuple[str, int, bool]) -> np.ndarray:
    """Which bytes of the texts in `data` are covered by repeated windows."""
    folder, shards, hot = found
    h, c, lo, windows, _ = anchors(data, off)
    files, masks = known(folder, "known"), known(folder, "masks")
    shard, index = files.find(h, c, shards)
    change = np.zeros(len(data) + 1, np.int32)
    hit = np.flatnonzero(index >= 0)
    flags, full = np.zeros(len(hit), np.uint8), np.zeros(len(hit), bool)
    order = np.argsort(shard[hit], kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[hit][order])) + 1) if len(hit) else []:
        s = int(shard[hit[own[0]]])
        flags[own] = files.maps[s]["flag"][index[hit[own]]]
        if (mask := masks.shard(s)) is not None:
            full[own] = (mask["whole"][index[hit[own]]] == 1) & (flags[own] == TEXT)
    np.add.at(change, lo[hit[full]], 1)
    np.add.at(change, lo[hit[full]] + windows[hit[full]] + LENGTH - 1, -1)
    for i, flag in zip(hit[~full].tolist(), flags[~full].tolist()):
        a, w = int(lo[i]), int(windows[i])
        if flag == TEXT:
            own = masks.shard(int(shard[i]))
            k = int(index[i])
            bits = np.unpackbits(own["bits"][int(own["at"][k]) : int(own["at"][k + 1])], count=w)
        else:
            bits = (known(folder, "hot").find(*window_hashes(data[a : a + w + LENGTH - 1]), shards)[1] >= 0).astype(np.uint8)
        at = np.flatnonzero(bits)
        if len(at):
            # runs of windows
            cut = np.flatnonzero(np.diff(at) > 1)
            begin, end = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            np.add.at(change, a + begin, 1)
            np.add.at(change, a + end + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(df: DataFrame, found: tuple[str, int, bool], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): byte spans (start, end) that were removed, and the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_chunks(batch):
                covered = marked(data, off, found)
                spans, kept = [], []
                for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                    own = covered[a:z]
                    edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                    kept.append(data[a:z][~own].tobytes())
                columns = [part.column(0), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = remove_repeats(docs, repeats(docs))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
