from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe
from tests.llm import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_cuts_lie_in_no_token():
    codec = bpe.ForcedBoundaryCodec(PATH)
    pairs = {(a, b) for t in codec.tokens for a, b in zip(t, t[1:])}
    assert not any(codec.cut[a * 256 + b] for a, b in pairs)


def test_equals_the_library_on_odd_texts(library):
    r = random.Random(3)
    parts = [*" \n\t'sltrevmd,.!?1aZé日  |<>%&$#", "<|endoftext|>", "'s", "  ", " the", "!'s", "　"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    codec = bpe.ForcedBoundaryCodec(PATH)
    raw = [x.encode() for x in odd]
    ids, off = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, a, b, e in zip(odd, off, off[1:], library.encode_batch(odd, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, repr(text)
        assert codec.decode(ids[a:b]) == library.decode(e.ids, skip_special_tokens=False)


def test_bytes_that_are_no_text_decode_like_the_library(library):
    codec, r = bpe.ForcedBoundaryCodec(PATH), random.Random(9)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(30)]
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, tmp_path, library):
    rows = fixtures.numbered()
    folder = fixtures.tables(tmp_path, spark, rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op1_bpe(spark, folder).collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_extra_columns(spark):
    df = fixtures.frame(spark, [(1, "some text")])
    assert bpe.encode(df, PATH).columns == ["doc_id", "ids"]
    assert bpe.decode(bpe.encode(df.where("false"), PATH), PATH).count() == 0
