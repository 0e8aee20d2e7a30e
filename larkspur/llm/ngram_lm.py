"""LM scoring with an Elias-Fano n-gram trie.

Tokens are the text's words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and one end. The training texts'
n-grams are counted in blocks: each task sorts its own n-grams, packs them by key range, and one task a
range merges the blocks. Level 1 holds the words, sorted by 64-bit hash; the word id is the rank. Level k
holds n-grams sorted by (rank of the context in level k-1, id of the last word): children of a context lie
together, and a monotone pointer sequence says where they begin. The level's sequence context * V + word
is monotone as a whole and kept as Elias-Fano halves; a lookup takes the context's range from the pointers
and searches the word's successor inside it. Pointers are the same structure.

Levels are cut into shards at places in the order of the first two words: at equal shares of the training
tokens as the words' counts foretell them, so a frequent first word takes several shards. What a model says
doesn't depend on the cuts: discounts and tables are of a whole level, and a first word that is cut has its
children counted over all its shards. Per n-gram the trie keeps the discounted probability, per context the
share left for shorter contexts, both as codes of a level's table of 256 quantiles. Files are mapped into
memory by the tasks that score: their pages belong to the file cache, not to the worker. Shards are joined to one file
a level once they are written, which is searched as a whole: how many shards there were makes no difference to a search.

Smoothing is interpolated absolute discounting: p(w|h) = max(c(hw)-D, 0)/c(h) + D*T(h)/c(h) * p(w|h'),
with D = n1/(n1+2*n2) of each level; below words is the uniform 1/(V+1), which is what an unknown word
gets. The first words of a text have the contexts that there are; no begin marks.

Null or empty text is one end token. Repeated rows count as often as they occur. Without training rows all
words are unknown. Very long texts are counted and scored whole; other columns take no part. Two words with one 64-bit hash would count as one (chance about V^2/2^65).
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import by_shard, map_arrow, shared_dir, text_chunks, worker_cache, write_shared

ORDER = 3
END = b"\n"  # no word holds it
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
#: n-grams that a counting task holds before it packs them.
MOST_HELD = 2_000_000
#: Text bytes that are scored at a time: the more, the fewer searches for what repeats.
SCORED_BYTES = 8 << 20
#: n-grams that are searched at a time: what belongs to them stays in a core's cache.
SEARCHED = 1 << 14
#: Bytes of the longest word that is hashed together with others; masks of the first bytes of a block.
LONGEST_MIXED = 32
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


# --- Elias-Fano --------------------------------------------------------------------------------------


#: Elements of the widest range that is searched by counting zeros instead of selecting them.
NEAR = 16


#: Place of the j-th one of a byte, at byte * 8 + j.
PLACES = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    PLACES[_byte, : len(_ones)] = _ones
PLACES = PLACES.reshape(-1)
BYTES = np.uint64(0x0101010101010101)  # times a number: the number in every byte


def select(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of the left-th one (from 0) of each 64-bit word: its byte by sums over all bytes, then a table."""
    u = np.uint64
    sums = bits - ((bits >> u(1)) & (u(0x55) * BYTES))
    sums = (sums & (u(0x33) * BYTES)) + ((sums >> u(2)) & (u(0x33) * BYTES))
    sums = ((sums + (sums >> u(4))) & (u(0x0F) * BYTES)) * BYTES  # ones up to each byte
    left = left.astype(u)
    before = np.bitwise_count(((left * BYTES | u(0x80) * BYTES) - sums) & (u(0x80) * BYTES))  # bytes with as many ones or fewer
    shift = np.minimum(before.astype(u) << u(3), u(56))
    left -= ((sums << u(8)) >> shift) & u(255)
    byte = (bits >> shift) & u(255)
    return (shift + PLACES[((byte << u(3)) + left) & u(2047)]).astype(np.int64)


class EliasFano:
    """A monotone sequence of n integers below `universe`: low bits packed, high bits in unary.

    The high half is a bit vector with a one for each element, a zero for each step of the high part; zeros
    are counted at every 64th bit. The elements with high part h follow the h-th zero: selecting it gives
    their first index, the run of ones their number.

    Sequences may also lie one after another as sections (join): their bit vectors make one, whose elements and zeros are
    numbered on, and their low bits, as many as a section has, follow each other.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray | None):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self.sections(np.array([low_bits]), *np.zeros((3, 1), np.int64))
        # eight bytes from any byte on
        self.window = np.lib.stride_tricks.as_strided(low.view("<u8"), (max(0, len(low) - 7),), (1,)) if len(low) else np.zeros(1, np.uint64)

    def sections(self, low_bits: np.ndarray, index: np.ndarray, low: np.ndarray, high: np.ndarray) -> EliasFano:
        """Low bits of the sections, and their first index, byte of `low` and word of `high`."""
        self.width, self.mask = low_bits.astype(np.int64), (np.uint64(1) << low_bits.astype(np.uint64)) - np.uint64(1)
        self.low_at, self.zeros_before = 8 * low - index * low_bits, 64 * high - index
        return self

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        high_part = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[high_part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32 if size < 2**32 else np.uint64)
        # element i lies at bit i * low_bits; a few at a time, so that the bits don't take eight times the room
        packed = np.zeros(((n * low_bits + 7) // 8 + 8 + 7) // 8 * 8, np.uint8)
        for s in range(0, n if low_bits else 0, 1 << 16):
            part = values[s : s + (1 << 16)] & np.uint64((1 << low_bits) - 1)
            unpacked = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            raw = np.packbits(unpacked.reshape(-1), bitorder="little")
            packed[s * low_bits // 8 : s * low_bits // 8 + len(raw)] |= raw
        return cls(n, low_bits, packed, high, zeros)

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros}

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index and number of the elements with each high part h."""
        k = h - 1  # the zero before them has this number
        word = np.maximum(np.searchsorted(self.zeros, k.astype(np.int64), side="right") - 1, 0)
        bits = self.high[word]
        place = select(~bits, k - self.zeros[word].astype(np.int64))
        place[h == 0] = -1
        first = word * 64 + place - k
        first[h == 0] = 0
        after = ~bits >> np.minimum(place + 1, 63).astype(np.uint64)
        number = np.bitwise_count((after & (~after + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        over = np.flatnonzero((after == 0) | (place == 63))
        if len(over):  # the run goes on in the next word, or further
            following = self.high[np.minimum(word[over] + 1, len(self.high) - 1)]
            rest = ~following
            number[over] = 63 - place[over] + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
            far = over[(rest == 0) | (word[over] + 1 >= len(self.high))]
            if len(far):
                number[far] = np.where(h[far] + 1 > self.zeros[-1], self.n, self._first(np.minimum(h[far] + 1, np.int64(self.zeros[-1])))) - first[far]
        return first, number

    def _first(self, h: np.ndarray) -> np.ndarray:
        k = h - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + select(~self.high[word], k - self.zeros[word].astype(np.int64)) - k

    def low_of(self, i: np.ndarray, section: np.ndarray | int = 0) -> np.ndarray:
        bit = i * self.width[section] + self.low_at[section]
        return (self.window[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask[section]

    def access(self, i: np.ndarray, section: np.ndarray | int = 0, following: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """The elements with indices i; and the ones after them, if asked for."""
        if not hasattr(self, "ones"):
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        bits = self.high[word]
        place = select(bits, i - self.ones[word])
        width, skip = self.width[section].astype(np.uint64), i + self.zeros_before[section]
        own = ((word * 64 + place - skip).astype(np.uint64) << width) | self.low_of(i, section)
        if not following:
            return own
        # the next one of the bit vector, in this word or in a later one
        bits &= ~np.uint64(1) << place.astype(np.uint64)
        empty = np.flatnonzero(bits == 0)
        while len(empty):
            word[empty] += 1
            bits[empty] = self.high[word[empty]]
            empty = empty[bits[empty] == 0]
        place = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return own, ((word * 64 + place - skip - 1).astype(np.uint64) << width) | self.low_of(i + 1, section)

    def find_near(self, high: np.ndarray, want: np.ndarray, first: np.ndarray, last: np.ndarray, section: np.ndarray) -> np.ndarray:
        """Index from first to last of the element with each high and low half, -1 if there is none.

        Element i with high half h is the one at bit h + i, after h zeros: zeros are counted, none is selected.
        """
        result = np.full(len(high), -1, np.int64)
        open_ = np.flatnonzero(first < last)
        high, want, first, last, section = high[open_], want[open_], first[open_], last[open_], section[open_]
        while len(open_):
            mid = (first + last) >> 1
            bit = high + mid
            word, place = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
            bits, value = self.high[word], self.low_of(mid, section)
            zeros = self.zeros[word] + np.bitwise_count(~bits & (place - np.uint64(1)))
            here = (zeros == high) & ((bits & place) != 0)
            hit = here & (value == want)
            result[open_[hit]] = mid[hit]
            less = (zeros < high) | (here & (value < want))
            first, last = np.where(less, mid + 1, first), np.where(less, last, mid)
            on = ~hit & (first < last)
            open_, high, want, first, last, section = open_[on], high[on], want[on], first[on], last[on], section[on]
        return result

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, section: np.ndarray | None = None) -> np.ndarray:
        """Index of each x (uint64), -1 where the successor of x isn't x; among the indices from lo to hi, if given."""
        result = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return result
        section = np.zeros(len(x), np.int64) if section is None else section
        high, want = (x >> self.width[section].astype(np.uint64)).astype(np.int64) + self.zeros_before[section], x & self.mask[section]
        open_ = np.arange(len(x))
        if lo is not None:
            near = np.flatnonzero(hi - lo <= NEAR)
            result[near] = self.find_near(high[near], want[near], lo[near], hi[near], section[near])
            open_ = np.flatnonzero(hi - lo > NEAR)
        first, number = self.bucket(high[open_])
        last = first + number
        if lo is not None:
            first, last = np.maximum(first, lo[open_]), np.minimum(last, hi[open_])
        some = np.flatnonzero(first < last)
        open_, first, last = open_[some], first[some], last[some]
        want, section = want[open_], section[open_]
        # successor of the low half among equal high halves: their number is one on average
        while len(open_):
            mid = (first + last) >> 1
            value = self.low_of(mid, section)
            hit = value == want
            result[open_[hit]] = mid[hit]
            less = value < want
            first, last = np.where(less, mid + 1, first), np.where(less, last, mid)
            on = ~hit & (first < last)
            open_, first, last, want, section = open_[on], first[on], last[on], want[on], section[on]
        return result

    def values(self) -> np.ndarray:
        """The whole sequence (tests)."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(np.arange(self.n))


def save_arrays(path: str, arrays: dict[str, np.ndarray], **meta) -> None:
    """One file: a JSON line with places and types, then the arrays at multiples of 64 bytes."""

    def write(target: str) -> None:
        head, at = {}, 0
        for name, a in arrays.items():
            head[name] = (a.dtype.str, int(at), int(a.size))
            at += -(-a.nbytes // 64) * 64
        line = json.dumps({"arrays": head, "meta": meta}).encode()
        start = -(-(len(line) + 1) // 64) * 64
        with open(target, "wb") as f:
            f.write(line.ljust(start - 1) + b"\n")
            for name, a in arrays.items():
                f.seek(start + head[name][1])
                f.write(np.ascontiguousarray(a).tobytes())
            f.truncate(start + at)

    write_shared(path, write)


def reserve(path: str, **arrays: tuple[str, int]) -> dict[str, int]:
    """A file for arrays of these types and sizes, to be written by others; where each begins."""
    head, end = {}, 0
    for name, (kind, size) in arrays.items():
        head[name] = (kind, end, size)
        end += -(-np.dtype(kind).itemsize * size // 64) * 64
    line = json.dumps({"arrays": head, "meta": {}}).encode()
    start = -(-(len(line) + 1) // 64) * 64
    with open(path, "wb") as f:
        f.write(line.ljust(start - 1) + b"\n")
        f.truncate(start + end)
    return {name: start + at for name, (_, at, _) in head.items()}


def map_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    with open(path, "rb") as f:
        line = f.readline()
    head = json.loads(line)
    raw = np.memmap(path, np.uint8, "r") if os.path.getsize(path) > len(line) else np.zeros(len(line), np.uint8)
    found = {}
    for name, (kind, at, size) in head["arrays"].items():
        a = len(line) + at
        found[name] = np.frombuffer(raw, kind, size, a) if size else np.zeros(0, kind)
    return found, head["meta"]


# --- packing of sorted counts ------------------------------------------------------------------------


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys with counts: differences by byte planes, so that Spark's codec sees runs."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    planes = deltas.view(np.uint8).reshape(-1, 8).T
    used = max([i + 1 for i in range(8) if planes[i].any()], default=0)
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype(np.uint64)
    return np.array([len(keys), used, len(large)], np.uint32).tobytes() + planes[:used].tobytes() + small.tobytes() + large.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, used, large = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(blob, np.uint8, n * used, 12).reshape(used, n).T
    keys = np.cumsum(planes.reshape(-1).view(np.uint64), dtype=np.uint64) if n else np.zeros(0, np.uint64)
    counts = np.frombuffer(blob, np.uint8, n, 12 + n * used).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob[12 + n * used + n :], np.uint64, large).astype(np.int64)
    return keys, counts


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)


#: Steps of a power of two in the fine grid that tables are made from.
FINE = 1024


def fine(p: np.ndarray) -> np.ndarray:
    """Places of probabilities in a logarithmic grid, the same for all shards."""
    return np.minimum(np.rint(-np.log2(np.maximum(p, 2.0**-63)) * FINE), 65535).astype(np.int64)


def table_of(bins: np.ndarray, times: np.ndarray) -> np.ndarray:
    """At most 256 of the sorted occupied places of the fine grid: all of them, or quantiles."""
    if len(bins) > 256:
        total = np.cumsum(times)
        bins = np.unique(bins[np.searchsorted(total, np.linspace(0, total[-1] - 1, 256), side="right").clip(0, len(bins) - 1)])
    return bins.astype(np.int64)


def codes_of(places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The nearest entry of the table."""
    return np.searchsorted((table[1:] + table[:-1]) / 2, places).astype(np.uint8)


# --- tokens ------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in `raw`: their length, then eight bytes after eight; long words by xxhash."""
    window = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))  # eight bytes from any byte on
    hashes = mix(lengths.astype(np.uint64))
    short = np.flatnonzero(lengths <= LONGEST_MIXED)
    for j in range(0, LONGEST_MIXED, 8):
        short = short[lengths[short] > j] if j else short
        if not len(short):
            break
        block = window[starts[short] + j] & LOW_BYTES[np.minimum(lengths[short] - j, 8)]
        hashes[short] = mix(hashes[short] ^ block)
    for i in np.flatnonzero(lengths > LONGEST_MIXED).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lengths[i]])
    return hashes


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets of the texts); every text ends with the end token."""
    inside = ((data - np.uint8(9)) > 4) & (data != 32)
    fresh, last = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # no word goes on in the next text
    full = np.flatnonzero(np.diff(off))
    fresh[off[full]] = inside[off[full]]
    last[off[full + 1] - 1] = inside[off[full + 1] - 1]
    starts = np.flatnonzero(fresh)
    at = np.searchsorted(starts, off) + np.arange(len(off))
    hashes = np.full(int(at[-1]), END_HASH)
    words = np.ones(len(hashes), bool)
    words[at[1:] - 1] = False
    hashes[words] = word_hashes(data.tobytes().lower(), starts, np.flatnonzero(last) + 1 - starts)
    return hashes, at


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined while they have at most `most` bytes; a single larger one stays as it is."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that ids by shard and rank are ids by hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# --- the model ---------------------------------------------------------------------------------------


class Level:
    """Level k >= 2: the sequences and pointers of all shards, joined."""

    def __init__(self, folder: str, k: int):
        self.folder, self.k = folder, k
        a, t = map_arrays(f"{folder}/level{k}")[0], map_arrays(f"{folder}/sections{k}")[0]
        #: First index and first context of each shard, and the end; first words, of level 2.
        self.starts, self.contexts, self.low = t["starts"], t["contexts"], t["first"]
        self.keys = EliasFano(int(self.starts[-1]), 0, a["low"], a["high"], a["zeros"])
        self.keys.sections(t["low_bits"], self.starts[:-1], t["low"][:-1], t["high"][:-1])
        shards = len(self.low)
        # a shard has a pointer more than contexts
        self.first_pointer = self.contexts[:-1] + np.arange(shards)
        self.pointers = EliasFano(int(self.contexts[-1]) + shards, 0, a["p_low"], a["p_high"], None)
        self.pointers.sections(t["p_low_bits"], self.first_pointer, t["p_low"][:-1], t["p_high"][:-1])
        self.pointers.ones = a["p_ones"]
        self.places = t

    def load_codes(self) -> None:
        if not hasattr(self, "codes"):
            a = map_arrays(f"{self.folder}/codes{self.k}")[0]
            tables = map_arrays(f"{self.folder}/tables{self.k}")[0]
            self.codes, self.left_codes = a["codes"], a["left_codes"]
            self.table, self.left_table = (2.0 ** (-tables[x] / FINE) for x in ("table", "left_table"))

    def pointers_of(self, shard: int) -> np.ndarray:
        """All pointers of a shard, from 0."""
        t = self.places
        low, high = (a[int(t[n][shard]) : int(t[n][shard + 1])] for n, a in (("p_low", self.pointers.low), ("p_high", self.pointers.high)))
        return EliasFano(int(self.contexts[shard + 1] - self.contexts[shard]) + 1, int(t["p_low_bits"][shard]), low, high, None).values().astype(np.int64)

    def children(self, contexts: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and the one after the last of contexts, numbered in their shards, sorted by shard and context."""
        place = contexts + self.first_pointer[shard]
        fresh = np.concatenate([[True], place[1:] != place[:-1]])
        back, own = np.cumsum(fresh) - 1, shard[fresh]
        first, last = self.pointers.access(place[fresh], own, True)
        start = self.starts[own]
        return (first.astype(np.int64) + start)[back], (last.astype(np.int64) + start)[back]


class Trie:
    """Levels 1 to `order` of a model folder, mapped on first use."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order = folder, order
        a, meta = map_arrays(f"{folder}/words")
        self.hashes, self.cumulative = a["hashes"], a["cumulative"]
        self.total, self.size, self.shards, self.discount = meta["total"], len(self.hashes), meta["shards"], meta["discount"]
        self.levels: dict[int | tuple, Level | np.ndarray] = {}

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.cumulative[ids + 1] - self.cumulative[ids]

    def pair_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shard of the n-grams that begin with words a, b; it never falls as (a, b) grows."""
        before = self.cumulative[a]
        total = max(1, self.total)
        place = before + (self.cumulative[a + 1] - before) * (self.cumulative[b] / total)
        return np.minimum(place * (self.shards / total), self.shards - 1).astype(np.int64)

    def first_words(self, shard: int) -> tuple[int, int]:
        """A range of ids that holds all first words of a shard's n-grams."""
        if not self.size:
            return 0, 0
        step = self.total / self.shards
        low = int(np.searchsorted(self.cumulative, int(shard * step), side="left")) - 2
        high = int(np.searchsorted(self.cumulative, int((shard + 1) * step) + 1, side="right")) + 1
        return max(0, low), min(self.size, max(high, 1))

    def level(self, k: int) -> Level:
        if k not in self.levels:
            self.levels[k] = Level(self.folder, k)
        return self.levels[k]

    def size_of(self, k: int, shard: int) -> int:
        bounds = self.bounds(k)
        return int(bounds[shard + 1] - bounds[shard])

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids, -1 for unknown words, and the words' counts; each distinct word is searched once, in order."""
        own, back = np.unique(hashes, return_inverse=True)
        found, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        if self.size:
            at = np.searchsorted(self.hashes, own)
            at[at == self.size] = 0
            hit = np.flatnonzero(self.hashes[at] == own)
            found[hit], counts[hit] = at[hit], self.counts(at[hit])
        return found[back], counts[back]

    def bounds(self, k: int) -> np.ndarray:
        """First global rank of each shard at level k >= 2."""
        if ("bounds", k) not in self.levels:
            self.levels["bounds", k] = map_arrays(f"{self.folder}/bounds{k}")[0]["starts"]
        return self.levels["bounds", k]

    def lookup(self, k: int, context: np.ndarray, word: np.ndarray, score: bool) -> tuple[np.ndarray, ...]:
        """Global rank at level k of (context's global rank, word), -1 if there is none; with the discounted
        probability and the context's share for shorter contexts where `score` asks for them.

        Each distinct pair is searched once, in order, some at a time whatever their shards are.
        """
        rank, value, left = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        some = np.flatnonzero((context >= 0) & ((word >= 0) | score))
        if not len(some):
            return rank, value, left
        own_context, own_word, back = distinct_pairs(context[some], word[some] + 1, self.size + 1)
        own_word = own_word - 1
        level = self.level(k)
        found, p, rest = np.full(len(own_word), -1, np.int64), np.zeros(len(own_word)), np.ones(len(own_word))
        if k == 2:  # unknown words come with the first ones of their context
            cuts = np.searchsorted(self.pair_shard(own_context, np.maximum(own_word, 0)), np.arange(self.shards + 1))
        else:
            cuts = np.searchsorted(own_context, self.bounds(k - 1))
        before = level.low if k == 2 else self.bounds(k - 1)[:-1]
        if score:
            level.load_codes()
        shards = np.repeat(np.arange(self.shards), np.diff(cuts))
        for a in range(0, len(own_word), SEARCHED):
            shard, word_ = shards[a : a + SEARCHED], own_word[a : a + SEARCHED]
            local = own_context[a : a + SEARCHED] - before[shard]
            begin, end = level.children(local, shard)
            known = np.flatnonzero((word_ >= 0) & (begin < end))
            key = local[known].astype(np.uint64) * np.uint64(self.size) + word_[known].astype(np.uint64)
            at = level.keys.find(key, begin[known], end[known], shard[known])
            hit = at >= 0
            at, place = at[hit], a + known[hit]
            found[place] = at
            if score:
                p[place] = level.table[level.codes[at]]
                rest[a : a + SEARCHED] = level.left_table[level.left_codes[local + level.contexts[shard]]]
        rank[some] = found[back]
        if score:
            value[some], left[some] = p[back], rest[back]
        return rank, value, left

    def log_probabilities(self, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token, with its count, of texts with offsets `at`."""
        p = np.full(len(ids), 1.0 / (self.size + 1))
        if self.total:
            p *= self.discount * self.size / self.total
            p += np.maximum(counts - self.discount, 0) / self.total
        rank = ids  # global rank of the k-gram that ends at each token
        for k in range(2, self.order + 1):
            rank, value, left = self.lookup(k, preceding(rank, at, k), ids, True)
            p = left * p + value
        return np.log10(p)


def preceding(rank: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Rank of the (k-1)-gram that ends before each token, -1 where the text has none."""
    before = np.full(len(rank), -1, np.int64)
    before[1:] = rank[:-1]
    starts = at[:-1]
    for j in range(k - 1):  # the first tokens of a text have no such context
        own = starts + j
        before[own[own < at[1:]]] = -1
    return before


def distinct_pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs (a, b) with b < size, and the place of each given pair among them."""
    if not len(a) or int(a.max()) < 2**63 // max(1, size):
        own, back = np.unique(a * size + b, return_inverse=True)
        return own // size, own % size, back
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(first) - 1
    return x[first], y[first], back


def trie(folder: str, order: int) -> Trie:
    cache = worker_cache()
    key = ("trie", folder, order)
    if key not in cache:
        for old in [k for k in cache if isinstance(k, tuple) and k[0] == "trie"]:
            del cache[old]
        cache[key] = Trie(folder, order)
    return cache[key]


def _send(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks by shard of keys that are sorted by (shard, key)."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield int(shard[a]), pack(keys[a:b], counts[a:b])


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["shard", "block"])


def _merge_shard(column: str, finish):
    """A function for applyInArrow's iterator form: merges a shard's blocks batch by batch."""

    def run(shard, batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index(column)).to_pylist():
                k, c = unpack(blob)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 2 * MOST_HELD:  # merged now and then, so that repeats don't pile up
                    k, c = merge(keys, counts)
                    keys, counts, held = [k], [c], 0
        yield finish(shard, *merge(keys, counts))

    return run


def train(df: DataFrame, order: int = ORDER, shards: int | None = None) -> tuple[str, int]:
    """Train on rows (text); returns (model folder, training tokens)."""
    spark = df.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_dir(spark, "ngram-lm")
    source = df.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count_words(batches):
        keys, counts, held = [], [], 0

        def flush():
            k, c = merge(keys, counts)
            return _rows(list(_send(k, c, shard_of(k, shards))))

        for batch in batches:
            for _, data, off in text_chunks(batch):
                own, times = np.unique(token_hashes(data, off)[0], return_counts=True)
                keys.append(own)
                counts.append(times)
                held += len(own)
                if held > MOST_HELD:
                    k, c = merge(keys, counts)
                    keys[:], counts[:], held = [k], [c], len(k)
                    if held > MOST_HELD // 2:
                        yield flush()
                        keys[:], counts[:], held = [], [], 0
        yield flush()

    def write_words(shard, keys, counts):
        save_arrays(f"{folder}/words-{shard}", {"hashes": keys, "counts": counts})
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(keys), int(counts.sum()), once, twice))], ["shard", "n", "total", "once", "twice"])

    def reduce_blocks(blocks, finish, schema):
        return by_shard(blocks, shards, _merge_shard("block", finish), schema)

    stats = "shard int, n long, total long, once long, twice long"
    # one row a shard comes to the driver
    sizes = {r.shard: r for r in reduce_blocks(map_arrow(source, count_words, "shard int, block binary"), write_words, stats).collect()}
    total = sum(r.total for r in sizes.values())
    _join_words(spark, folder, shards, sizes, total)

    if order >= 2:
        _first_levels(source, folder, shards, min(order, 3))
        for k in range(2, min(order, 3) + 1):
            _join_level(spark, folder, k, shards)
    for k in range(4, order + 1):

        def count_grams(batches, k=k):
            model = trie(folder, k - 1)
            bounds, size = model.bounds(k - 1), max(1, model.size)
            held, n = [], 0

            def flush():
                """Blocks by shard; a key is relative to the shard's first context."""
                a, b, c = (np.concatenate(x) for x in zip(*held))
                x, y, back = distinct_pairs(a, b, size)
                counts = np.bincount(back, c, len(x)).astype(np.int64)
                cuts = np.searchsorted(x, bounds)
                pieces = []
                for shard in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(int(cuts[shard]), int(cuts[shard + 1]))
                    pieces.append((shard, pack((x[own] - bounds[shard]).astype(np.uint64) * np.uint64(size) + y[own].astype(np.uint64), counts[own])))
                return _rows(pieces)

            for batch in batches:
                for _, data, off in text_chunks(batch):
                    hashes, at = token_hashes(data, off)
                    ids = model.ids(hashes)[0]
                    rank = ids
                    for j in range(2, k):
                        rank = model.lookup(j, preceding(rank, at, j), ids, False)[0]
                    context = preceding(rank, at, k)
                    some = np.flatnonzero(context >= 0)
                    x, y, back = distinct_pairs(context[some], ids[some], size)
                    held.append((x, y, np.bincount(back, minlength=len(x))))
                    n += len(x)
                    if n > MOST_HELD:
                        yield flush()
                        held, n = [], 0
            if held:
                yield flush()

        def write_level(shard, keys, counts, k=k):
            model = trie(folder, k - 1)
            found = _write_level(folder, k, shard, keys, counts, model.size_of(k - 1, shard), model.size)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, *found), (pa.int32(), *[pa.int64()] * 3))], ["shard", "n", "once", "twice"])

        blocks = map_arrow(source, count_grams, "shard int, block binary")
        done = {r.shard: r for r in reduce_blocks(blocks, write_level, "shard int, n long, once long, twice long").collect()}
        model = Trie(folder, k - 1)
        for shard in set(range(shards)) - set(done):  # ranges without n-grams
            _write_level(folder, k, shard, np.zeros(0, np.uint64), np.zeros(0, np.int64), model.size_of(k - 1, shard), model.size)
        _save_bounds(folder, k, [done[s].n if s in done else 0 for s in range(shards)], sum(r.once for r in done.values()), sum(r.twice for r in done.values()))
        _join_level(spark, folder, k, shards)
    if order >= 2:
        _finish(spark, folder, shards, order)
    return folder, total


def _first_levels(source: DataFrame, folder: str, shards: int, most: int) -> None:
    """Levels 2 and, if `most` is 3, level 3 in one read: a 3-gram goes to the shard of its first two words as a pair
    of numbers (first two words, last word), and the shard that has merged its 2-grams knows their ranks."""

    def count_grams(batches):
        model = trie(folder, 1)
        size = max(1, model.size)
        held: list[tuple] = []
        n = 0

        def flush():
            """Blocks by (shard, level); first words count from the first that the shard may have."""
            a, b, c, times, level = (np.concatenate(x) for x in zip(*held))
            pieces = []
            for k in range(2, most + 1):
                own = level == k
                x, y, back = distinct_pairs(a[own], b[own], size)
                if k == 2:
                    n_own = np.bincount(back, times[own], len(x)).astype(np.int64)
                    first, hi, lo = x, y, None
                else:
                    place, z, again = distinct_pairs(back, c[own], size)
                    n_own = np.bincount(again, times[own], len(place)).astype(np.int64)
                    first, hi, lo = x[place], y[place], z
                cuts = np.searchsorted(model.pair_shard(first, hi), np.arange(shards + 1))
                for shard in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(int(cuts[shard]), int(cuts[shard + 1]))
                    keys = (first[part] - model.first_words(shard)[0]).astype(np.uint64) * np.uint64(size) + hi[part].astype(np.uint64)
                    pieces.append((shard, k, pack(keys, n_own[part]), b"" if lo is None else lo[part].astype(np.uint32 if size < 2**32 else np.uint64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.binary()), pa.array([p[3] for p in pieces], pa.binary())], ["shard", "level", "block", "last"])

        for batch in batches:
            for _, data, off in text_chunks(batch):
                hashes, at = token_hashes(data, off)
                ids = model.ids(hashes)[0]
                one = preceding(ids, at, 2)
                some = np.flatnonzero(one >= 0)
                x, y, back = distinct_pairs(one[some], ids[some], size)
                held.append((x, y, np.zeros(len(x), np.int64), np.bincount(back, minlength=len(x)), np.full(len(x), 2, np.int8)))
                n += len(x)
                if most >= 3:
                    pair = np.full(len(ids), -1, np.int64)
                    pair[some] = back  # place of the 2-gram that ends at each token
                    pair = preceding(pair, at, 3)
                    some = np.flatnonzero(pair >= 0)
                    place, z, back = distinct_pairs(pair[some], ids[some], size)
                    held.append((x[place], y[place], z, np.bincount(back, minlength=len(place)), np.full(len(place), 3, np.int8)))
                    n += len(place)
                if n > MOST_HELD:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def write_levels(shard, batches):
        model = trie(folder, 1)
        size = max(1, model.size)
        pairs, triples, n = [], [], 0
        for batch in batches:
            for k, blob, last in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("level", "block", "last"))):
                keys, counts = unpack(blob)
                if k == 2:
                    pairs.append((keys, counts))
                else:
                    triples.append((keys, np.frombuffer(last, np.uint32 if size < 2**32 else np.uint64).astype(np.uint64), counts))
                    n += len(keys)
                    if n > 2 * MOST_HELD:
                        triples, n = [_merge_triples(triples)], 0
        keys, counts = merge(*map(list, zip(*pairs))) if pairs else merge([], [])
        low, high = model.first_words(shard)
        found = [*_write_level(folder, 2, shard, keys, counts, high - low, model.size, low), 0, 0, 0]
        first = (keys // np.uint64(size)).astype(np.int64)
        # children of the shard's first and last context, which other shards may have too
        ends = [int(x) + low for x in (first[0], first[-1])] if len(first) else [-1, -1]
        found += [ends[0], int((first == first[0]).sum()) if len(first) else 0, ends[1], int((first == first[-1]).sum()) if len(first) else 0]
        if most >= 3:
            context, word, times = _merge_triples(triples)
            ranks = np.searchsorted(keys, context).astype(np.uint64)
            found[3:6] = _write_level(folder, 3, shard, ranks * np.uint64(size) + word, times, len(keys), model.size)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, *found), (pa.int32(), *[pa.int64()] * 10))], names)

    names = ["shard", "n2", "once2", "twice2", "n3", "once3", "twice3", "first", "n_first", "last", "n_last"]
    blocks = map_arrow(source, count_grams, "shard int, level int, block binary, last binary")
    # one row a shard
    done = {r.shard: r for r in by_shard(blocks, shards, write_levels, "shard int, " + ", ".join(f"{n} long" for n in names[1:])).collect()}
    words = Trie(folder, 1)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for shard in set(range(shards)) - set(done):  # ranges without n-grams
        low, high = words.first_words(shard)
        _write_level(folder, 2, shard, *none, high - low, words.size, low)
        if most >= 3:
            _write_level(folder, 3, shard, *none, 0, words.size)
    cut: dict[int, int] = {}
    for r in done.values():
        for word, n in {r.first: r.n_first, r.last: r.n_last}.items():
            if n:
                cut[word] = cut.get(word, 0) + n
    for k in range(2, most + 1):
        of = lambda name, k=k: [getattr(done[s], f"{name}{k}") if s in done else 0 for s in range(shards)]
        _save_bounds(folder, k, of("n"), sum(of("once")), sum(of("twice")), cut if k == 2 else {})


def _save_bounds(folder: str, k: int, sizes: list[int], once: int, twice: int, cut: dict[int, int] | None = None) -> None:
    """First ranks of a level's shards, its discount, and the children of contexts that are cut."""
    words = sorted(cut or {})
    arrays = {"starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "cut": np.array(words, np.int64), "children": np.array([cut[w] for w in words], np.int64)}
    save_arrays(f"{folder}/bounds{k}", arrays, discount=discount(once, twice))


def _write_level(folder: str, k: int, shard: int, keys: np.ndarray, counts: np.ndarray, contexts: int, words: int, low: int = 0) -> tuple[int, int, int]:
    """Write a shard's sequence and pointers, and its counts until the level's discount is known."""
    ef = EliasFano.build(keys, max(1, contexts * max(1, words)))
    children = np.bincount((keys // np.uint64(max(1, words))).astype(np.int64), minlength=contexts)
    pointers = EliasFano.build(np.concatenate([[0], np.cumsum(children)]).astype(np.uint64), len(keys) + 1)
    arrays = ef.parts() | {f"p_{n}": a for n, a in pointers.parts().items()}
    save_arrays(f"{folder}/level{k}-{shard}", arrays, n=len(keys), contexts=contexts, low_bits=ef.low_bits, p_low_bits=pointers.low_bits, low=low)
    save_arrays(f"{folder}/counts{k}-{shard}", {"small": np.minimum(counts, 255).astype(np.uint8), "large": counts[counts >= 255].astype(np.int64)})
    return len(keys), int((counts == 1).sum()), int((counts == 2).sum())


def _join_level(spark, folder: str, k: int, shards: int) -> None:
    """One file of a level from the shards' files, so that a search doesn't visit shard by shard.

    The file gets its size first; a task writes its shards in their places and then their own files go, so that there is no
    second copy of a level.
    """
    heads = []
    for shard in range(shards):  # a line a shard
        with open(f"{folder}/level{k}-{shard}", "rb") as f:
            heads.append(json.loads(f.readline()))
    starts = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    meta = lambda name: np.array([h["meta"][name] for h in heads], np.int64)
    table = {"starts": starts(meta("n")), "contexts": starts(meta("contexts")), "first": meta("low"), "low_bits": meta("low_bits"), "p_low_bits": meta("p_low_bits")}
    table |= {name: starts([h["arrays"][name][2] for h in heads]) for name in ("low", "high", "p_low", "p_high")}
    size = {name: int(table[name][-1]) for name in ("low", "high", "p_low", "p_high")}
    target = f"{folder}/level{k}"
    at = reserve(target, low=("|u1", size["low"]), high=("<u8", size["high"]), zeros=("<i8", size["high"] + 1), p_low=("|u1", size["p_low"]), p_high=("<u8", size["p_high"]), p_ones=("<i8", size["p_high"] + 1))

    def copy(batches):
        for batch in batches:
            done = []
            with open(target, "r+b") as f:

                def put(name, start, values):
                    f.seek(at[name] + values.itemsize * int(start))
                    f.write(values.tobytes())

                for s in batch.column(0).to_pylist():
                    source = f"{folder}/level{k}-{s}"
                    try:
                        a = map_arrays(source)[0]
                    except FileNotFoundError:  # a repeated task: it is in its place
                        continue
                    for name in size:
                        put(name, table[name][s], a[name])
                    # the last number is the next shard's first
                    put("zeros", table["high"][s], a["zeros"].astype("<i8") + (64 * table["high"][s] - table["starts"][s]))
                    put("p_ones", table["p_high"][s], 64 * np.arange(len(a["p_zeros"]), dtype="<i8") - a["p_zeros"].astype("<i8") + (table["contexts"][s] + s))
                    done.append(source)
            for source in done:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(source)
            yield batch

    map_arrow(spark.range(0, shards, 1, min(shards, 64)), copy, "id long").count()
    save_arrays(f"{folder}/sections{k}", table)


def _ratios(model: Trie, k: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the fine grid of a shard's discounted probabilities and of its contexts' shares for shorter ones."""
    folder, level = model.folder, model.level(k)
    contexts = int(level.contexts[shard + 1] - level.contexts[shard])
    bounds, meta = map_arrays(f"{folder}/bounds{k}")
    stored = map_arrays(f"{folder}/counts{k}-{shard}")[0]
    counts = stored["small"].astype(np.int64)
    counts[counts == 255] = stored["large"]
    pointers = level.pointers_of(shard)
    children = np.diff(pointers)
    context = np.repeat(np.arange(contexts), children)
    if k == 2:
        # a word is followed by another token as often as it occurs, the end by none
        words = np.arange(level.low[shard], level.low[shard] + contexts)
        sums = model.counts(words) if contexts else np.zeros(0, np.int64)
        end = int(np.searchsorted(model.hashes, END_HASH))
        sums[words == end] = 0
        at = np.searchsorted(bounds["cut"], words)
        at[at == len(bounds["cut"])] = 0
        if len(bounds["cut"]):
            children = np.where(bounds["cut"][at] == words, bounds["children"][at], children)
    else:
        total = np.concatenate([[0], np.cumsum(counts)])
        sums = total[pointers[1:]] - total[pointers[:-1]]
    d = meta["discount"]
    left = np.where(sums > 0, d * children / np.maximum(sums, 1), 1.0)
    return fine((counts - d) / np.maximum(sums[context], 1)), fine(left)


def _finish(spark, folder: str, shards: int, order: int) -> None:
    """The codes of all levels, by tables of whole levels; then the counts go."""
    every = spark.range(0, shards, 1, shards)

    def histograms(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for k in range(2, order + 1):
                    model = trie(folder, order)
                    level = model.level(k)
                    places, left = _ratios(model, k, shard)
                    if k == 2:  # a context counts in the shard that its first children are in
                        own = level.low[shard] + np.arange(len(left))
                        left = left[model.pair_shard(own, np.zeros(len(own), np.int64)) == shard] if len(own) else left
                    for kind, x in enumerate((places, left)):
                        bins, times = np.unique(x, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), 2 * k + kind)), pa.array(bins), pa.array(times)], ["kind", "bin", "n"])

    # at most 65,536 rows a kind
    found = map_arrow(every, histograms, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    for k in range(2, order + 1):
        made = {}
        for kind, name in enumerate(("table", "left_table")):
            own = found.filter(pa.compute.equal(found["kind"], 2 * k + kind)).sort_by("bin")
            made[name] = table_of(own["bin"].to_numpy(), own["n"].to_numpy()) if own.num_rows else np.zeros(1, np.int64)
        save_arrays(f"{folder}/tables{k}", made)
    own = Trie(folder, order)
    sizes = {k: (own.level(k).starts, own.level(k).contexts) for k in range(2, order + 1)}
    at = {k: reserve(f"{folder}/codes{k}", codes=("|u1", int(n[-1])), left_codes=("|u1", int(c[-1]))) for k, (n, c) in sizes.items()}

    def write(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for k in range(2, order + 1):
                    tables = map_arrays(f"{folder}/tables{k}")[0]
                    places, left = _ratios(trie(folder, order), k, shard)
                    with open(f"{folder}/codes{k}", "r+b") as f:
                        for name, x, start in zip(("codes", "left_codes"), (codes_of(places, tables["table"]), codes_of(left, tables["left_table"])), sizes[k]):
                            f.seek(at[k][name] + int(start[shard]))
                            f.write(x.tobytes())
            yield batch

    map_arrow(every, write, "id long").count()
    for k in range(2, order + 1):
        for shard in range(shards):
            os.remove(f"{folder}/counts{k}-{shard}")


def _merge_triples(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hi, lo, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(n, first)


def _join_words(spark, folder: str, shards: int, sizes: dict, total: int) -> None:
    """One file of level 1 from the shards' files: hashes, and how many tokens there are before each word.

    The file gets its size first; one task a shard writes its part in its place, again if it is repeated.
    """
    of = lambda name: [getattr(sizes[s], name) if s in sizes else 0 for s in range(shards)]
    starts, before = (np.concatenate([[0], np.cumsum(of(x))]).astype(np.int64) for x in ("n", "total"))
    n = int(starts[-1])
    places = {"hashes": ("<u8", 0, n), "cumulative": ("<i8", -(-8 * n // 64) * 64, n + 1)}
    line = json.dumps({"arrays": places, "meta": {"total": total, "shards": shards, "discount": discount(sum(of("once")), sum(of("twice")))}}).encode()
    begin = -(-(len(line) + 1) // 64) * 64
    target = f"{folder}/words"
    with open(target, "wb") as f:
        f.write(line.ljust(begin - 1) + b"\n")
        f.truncate(begin + places["cumulative"][1] + -(-8 * (n + 1) // 64) * 64)

    def copy(batches):
        for batch in batches:
            with open(target, "r+b") as f:
                for s in batch.column(0).to_pylist():
                    own = map_arrays(f"{folder}/words-{s}")[0]
                    f.seek(begin + 8 * int(starts[s]))
                    f.write(own["hashes"].tobytes())
                    f.seek(begin + places["cumulative"][1] + 8 * (int(starts[s]) + 1))
                    f.write((before[s] + np.cumsum(own["counts"])).astype("<i8").tobytes())
            yield batch

    own = [s for s in range(shards) if s in sizes]
    map_arrow(spark.range(0, shards, 1, min(shards, 64)).where(F.col("id").isin(own)) if len(own) < shards else spark.range(0, shards, 1, min(shards, 64)), copy, "id long").count()
    for s in own:
        os.remove(f"{folder}/words-{s}")


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def score(df: DataFrame, model: tuple[str, int], order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each text."""
    folder, total = model

    def run(batches):
        own = trie(folder, order)
        for batch in joined(batches, SCORED_BYTES):
            for part, data, off in text_chunks(batch, most=SCORED_BYTES):
                hashes, at = token_hashes(data, off)
                ids, counts = own.ids(hashes)
                base = np.log10((counts + 1) / (own.total + own.size + 1))
                sums = lambda x: np.add.reduceat(x, at[:-1])
                columns = [
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array(sums((ids >= 0).astype(np.int64))),
                    pa.array(np.full(part.num_rows, total, np.int64)),
                    pa.array(sums(base)),
                    pa.array(sums(own.log_probabilities(ids, counts, at))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that don't teach; a row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(True))


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
