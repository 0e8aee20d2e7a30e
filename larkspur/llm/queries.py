"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from larkspur.llm.bpe import op1_bpe
from larkspur.llm.decontaminate import OP8_SQL, op8_decontaminate
from larkspur.llm.fingerprints import op5_fingerprints
from larkspur.llm.licenses import op6_licenses
from larkspur.llm.neardup import op9_neardup
from larkspur.llm.ngram_lm import op2_lm
from larkspur.llm.pii import op3_pii
from larkspur.llm.quality import op10_quality
from larkspur.llm.suffix_dedup import op4_suffix_dedup
from larkspur.llm.urls import OP7_SQL, op7_urls


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_lm, op3_pii, op4_suffix_dedup, op5_fingerprints, op6_licenses, op7_urls, op8_decontaminate, op9_neardup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": OP7_SQL, "op8_decontaminate": OP8_SQL}
