from __future__ import annotations

from larkspur.llm import neardup, quality
from larkspur.llm.common import worker_cache


def test_an_operator_drops_what_another_one_remembered():
    quality.features([b"some words of a text"])
    assert "quality_words" in worker_cache()
    worker_cache()["slots"] = worker_cache().get("slots", {})
    neardup.shingles(b"some words of a text")
    assert "quality_words" not in worker_cache() and {"neardup_words", "slots"} <= worker_cache().keys()
    neardup.shingles(b"other words")
    assert b"some" in worker_cache()["neardup_words"]
