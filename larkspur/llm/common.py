"""What the training-data operators share: Arrow text access, bounded chunks, the shared folder."""

from __future__ import annotations

import os
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import ship_package

#: Text bytes that one step of a worker holds at a time; a single longer text is held whole.
CHUNK_BYTES = 4 << 20


def worker_cache(operator: str = "") -> dict:
    """A dictionary that lives as long as the Python worker.

    A call that names its operator drops what was kept while another one was named: the stages of a pipeline run in
    the same workers, and the tables they remember would add up.
    """
    module = sys.modules.setdefault("_larkspur_worker_cache", types.ModuleType("_larkspur_worker_cache"))
    data = module.__dict__.setdefault("data", {})
    if operator and data.get("operator") != operator:
        for key in data.keys() - {"slots", "own_checkpoint_dir"}:
            del data[key]
        data["operator"] = operator
    return data


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, as a local path that every executor sees.

    The setting is read from the session's context. Where it is unset, as in tests, a session in one process takes a
    temporary folder; a cluster is refused.
    Files that workers map into memory need a mounted file system, so another scheme is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = worker_cache().setdefault("own_checkpoint_dir", tempfile.mkdtemp(prefix="larkspur-shared-"))
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    if "://" in base:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder, not {base}")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def write_shared(path: str, writer: Callable[[str], None]) -> None:
    """Write a file under its final name only once it is whole, so a lost or repeated task does no harm."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    writer(temporary)
    os.replace(temporary, path)


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = "file://" + os.path.join(shared_dir(spark, name), "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch, where the session has Spark's default: 10,000 whole texts would be too many to hold.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def shard_slots(spark: SparkSession, shards: int) -> list[int]:
    """A number for each shard such that Spark's hash partitioning gives every shard a partition of its own.

    Hashing the shards' own numbers would put several into one task and none into others.
    """
    cache = worker_cache().setdefault("slots", {})
    if shards not in cache:
        found: dict[int, int] = {}
        first, step = 0, max(1024, 20 * shards)
        while len(found) < shards:
            n = F.col("id").cast("int")
            place = F.pmod(F.hash(n), F.lit(shards))
            # one row a shard
            for r in spark.range(first, first + step).groupBy(place.alias("p")).agg(F.min("id").alias("k")).collect():
                found.setdefault(r.p, r.k)
            first += step
        cache[shards] = [found[i] for i in range(shards)]
    return cache[shards]


def by_shard(df: DataFrame, shards: int, run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: str | None = None) -> DataFrame:
    """Apply run(shard, batches) to the rows of each shard (column shard), one shard a task.

    With `order` a shard's rows come sorted by that column; Spark sorts and spills them.
    """
    slots = shard_slots(df.sparkSession, shards)
    shard_of = {k: i for i, k in enumerate(slots)}

    def grouped(key, batches):
        yield from run(shard_of[key[0].as_py()], batches)

    # applyInArrow takes the iterator form by its annotations
    grouped.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    slotted = df.withColumn("larkspur_slot", F.element_at(F.lit(slots).cast("array<int>"), F.col("shard") + 1))
    dealt = slotted.repartition(shards, "larkspur_slot")
    if order:
        dealt = dealt.sortWithinPartitions("larkspur_slot", order)
    return dealt.groupBy("larkspur_slot").applyInArrow(grouped, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `most` text bytes (one row at least), with their bytes and offsets."""
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def texts_of(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw, o = data.tobytes(), off.tolist()
    return [raw[a:b] for a, b in zip(o, o[1:])]
