"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so a cut between the two
bytes is certain. Fragments between certain cuts are encoded independently (each distinct fragment once,
while the bounded table of fragments holds it) and the ids are concatenated.

A cut is taken only where the pre-tokenizer sees the same context on both sides as in the whole text:
the left byte ends no white space, and an apostrophe on the right follows an ASCII letter or digit only
(a contraction is a token of its own there). The strings of special tokens hold no cut, because the pairs
inside them occur in a vocabulary token.

Null or empty text has no ids and decodes to the empty text. Rows are kept one for one, repeated rows
too; very long texts are cut into fragments like any other. Columns other than the named ones are left
out of the operators' results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, text_chunks, worker_cache

#: Fragments a worker remembers; the table is emptied when it is full.
REMEMBERED = 300_000
#: Longer fragments are not remembered.
LONGEST_REMEMBERED = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, each with its byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    for i, b in enumerate(b for b in range(256) if b not in set(kept)):
        table[chr(256 + i)] = b
    return table


class ForcedBoundaryCodec:
    """A byte-level BPE vocabulary with its table of certain cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        vocabulary: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        for added in spec.get("added_tokens", ()):
            vocabulary[added["id"]] = added["content"].encode()
        self.tokens: list[bytes] = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.cut = self.certain_cuts(vocabulary.values())
        self.known: dict[bytes, list[int]] = {}

    @staticmethod
    def certain_cuts(tokens) -> np.ndarray:
        inside = np.zeros(1 << 16, bool)
        for token in tokens:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.uint16)
                inside[(b[:-1] << 8) | b[1:]] = True
        left, right = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
        alnum = np.zeros(256, bool)
        alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        # last bytes of white space: ASCII controls and space, and those of the wider spaces in UTF-8
        space_end = np.zeros(256, bool)
        space_end[[*range(0, 33), 127, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
        lead = (right < 0x80) | (right >= 0xC0)
        whole_left = left < 0xC0
        return ~inside & lead & whole_left & ~space_end[left] & ((right != 0x27) | alnum[left])

    def fragments(self, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Fragments of all texts in a row, and the number of each text's fragments."""
        n = len(data)
        if n == 0:
            return [], np.zeros(len(off) - 1, np.int64)
        mark = np.zeros(n + 1, bool)
        mark[1:n] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        mark[off] = True
        ends = np.flatnonzero(mark)
        raw, e = data.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip(e, e[1:])], np.diff(np.searchsorted(ends, off))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts that `data` holds in a row."""
        pieces, counts = self.fragments(data, off)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for p in pieces if p not in known})
        local: dict[bytes, list[int]] = {}
        if new:
            for piece, coded in zip(new, self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)):
                (known if len(piece) <= LONGEST_REMEMBERED else local)[piece] = coded.ids
        get = known.__getitem__ if not local else lambda p: known[p] if p in known else local[p]
        coded = list(map(get, pieces))
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum()))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec(path: str) -> ForcedBoundaryCodec:
    cache = worker_cache("bpe")
    if ("codec", path) not in cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache["codec", path] = ForcedBoundaryCodec(path)
    return cache["codec", path]


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for part, data, off in text_chunks(batch, most=2 << 20):
                ids, offsets = own.encode(data, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, ids array<int>")


def decode(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            start = 0
            while start < len(lists):  # so many ids at a time
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 20), side="right")) - 1)
                text = [own.decode(values[a:b]) for a, b in zip(offsets[start:end], offsets[start + 1 : end + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists.slice(start, end - start), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])
                start = end

    filled = df.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return map_arrow(filled, run, "doc_id long, ids array<int>, decoded string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document, as digests (contract of op1)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
