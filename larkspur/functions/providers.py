"""Boundaries to models and hooks: injected callables, applied over Arrow batches with retries and error rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import ship_package

Analyzer = Callable[[Column], Column]
Reranker = Callable[[DataFrame], DataFrame]
RecallListener = Callable[[DataFrame], None]


class IngestionTarget(Protocol):
    def __call__(self, batch: DataFrame, batch_id: int) -> None: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


TYPES = {"dense": "array<float>", "sparse": "map<string,float>", "tokens": "array<array<float>>", "text": "string", "tags": "array<string>", "entities": "array<struct<name:string,type:string>>"}
_ARROW = {
    "dense": pa.list_(pa.float32()),
    "sparse": pa.map_(pa.string(), pa.float32()),
    "tokens": pa.list_(pa.list_(pa.float32())),
    "text": pa.string(),
    "tags": pa.list_(pa.string()),
    "entities": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])),
}


def apply_model(rows: DataFrame, model: Callable[[list[str]], list[Any]], kind: str = "dense", batch: int = 64, retries: int = 2) -> DataFrame:
    """(id, result, error) of rows (id, text): the model sees lists of texts; a batch that keeps failing is tried
    text by text, and a text that fails has an error instead of a result."""
    ship_package(rows.sparkSession)

    def attempt(texts: list[str]) -> list[Any] | Exception:
        failure: Exception = RuntimeError("no attempt")
        for _ in range(retries + 1):
            try:
                found = model(texts)
                if len(found) != len(texts):
                    raise ValueError("as many results as texts are needed")
                return list(found)
            except Exception as e:  # the failure becomes the row's error
                failure = e
        return failure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                ids, texts = b.column(0).slice(s, batch), [t or "" for t in b.column(1).slice(s, batch).to_pylist()]
                found, errors = attempt(texts), [None] * len(texts)
                if isinstance(found, Exception):
                    each = [attempt([t]) for t in texts]
                    errors = [str(x) if isinstance(x, Exception) else None for x in each]
                    found = [None if isinstance(x, Exception) else x[0] for x in each]
                if kind == "sparse":
                    found = [None if x is None else list(x.items()) for x in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, _ARROW[kind]), pa.array(errors, pa.string())], ["id", "result", "error"])

    return rows.select(F.col("id").cast("long"), "text").mapInArrow(run, f"id long, result {TYPES[kind]}, error string")


def parse_tags(answer: Column, most: int = 10) -> Column:
    """Tags from a model's JSON list, or from a comma-separated line."""
    listed = F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<string>"), F.split(answer, ","))
    return F.slice(F.array_distinct(F.filter(F.transform(listed, lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, most)


def parse_entities(answer: Column) -> Column:
    """Entities from a model's JSON; an answer that is no JSON gives none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<name:string,type:string>>")
    named = F.filter(found, lambda e: e["name"].isNotNull() & (F.trim(e["name"]) != ""))
    return F.coalesce(F.transform(named, lambda e: F.struct(F.lower(F.trim(e["name"])).alias("name"), F.coalesce(F.upper(e["type"]), F.lit("CONCEPT")).alias("type"))), F.array().cast("array<struct<name:string,type:string>>"))
