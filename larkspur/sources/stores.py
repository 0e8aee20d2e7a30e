"""Tables at rest: document and vector stores, write-ahead log, snapshots, exports, graph and benchmark imports."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last version is a deletion are gone."""
    ranked = versions.withColumn("larkspur_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    last = ranked.where("larkspur_r = 1").drop("larkspur_r")
    return last.where(~F.col(deleted)).drop(deleted) if deleted else last


def write_sharded(vectors: DataFrame, path: str, shards: int, key: str = "id") -> DataFrame:
    """Vectors in one folder a shard, so that a read of one shard reads its files only."""
    vectors.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return vectors.sparkSession.read.parquet(path)


class EventLog:
    """An append-only log of numbered events as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(self.path)

    def replay(self, after: int = -1) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("seq") > after)

    def high_water_mark(self) -> int:
        return self.replay().agg(F.max("seq")).first()[0] or -1

    def truncated(self, before: int, path: str) -> EventLog:
        """A log without the events before a number, at another place."""
        self.replay(before - 1).write.mode("overwrite").parquet(path)
        return EventLog(self.spark, path)


class Snapshots:
    """Named snapshots of a namespace's table."""

    _NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,62}")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, namespace: str, name: str) -> str:
        for part in (namespace, name):
            if not self._NAME.fullmatch(part):
                raise ValueError(f"not a name: {part!r}")
        return f"{self.root}/{namespace}/{name}"

    def save(self, namespace: str, name: str, table: DataFrame) -> None:
        table.write.mode("errorifexists").parquet(self._path(namespace, name))

    def restore(self, namespace: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(namespace, name))

    def names(self, namespace: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{namespace}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Edge tables from JSON lines: co-activations, temporal chains, entity relations."""
    links = spark.read.schema("memoryIdA string, memoryIdB string, coActivationCount int").json(f"{folder}/hebbian_edges.jsonl")
    chains = spark.read.schema("sessionId string, orderedMemoryIds array<string>").json(f"{folder}/temporal_chains.jsonl")
    steps = chains.select("sessionId", F.posexplode("orderedMemoryIds").alias("place", "id"))
    ids = F.col("orderedMemoryIds")
    pairs = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: F.struct(F.element_at(ids, i).alias("id"), F.element_at(ids, i + 1).alias("next_id")))
    nexts = chains.where(F.size(ids) > 1).select("sessionId", F.explode(pairs).alias("p")).select("sessionId", "p.id", "p.next_id")
    return {"links": links.toDF("a", "b", "weight"), "steps": steps, "next": nexts}


def integrity(rows: DataFrame, key: str, owner: DataFrame, owner_key: str) -> DataFrame:
    """Rows whose key doesn't exist in the owner's table."""
    return rows.join(owner.select(F.col(owner_key).alias(key)).distinct(), key, "left_anti")


@dataclass(frozen=True)
class Adapter:
    """A table store behind two functions: save(df, name) and load(name)."""

    save: Callable[[DataFrame, str], None]
    load: Callable[[str], DataFrame]


class Checkpoints:
    """States by the last event they hold; the newest whole one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, state: DataFrame, upto: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/upto={upto}")

    def last(self) -> tuple[DataFrame, int]:
        every = self.spark.read.parquet(self.root)
        upto = every.agg(F.max("upto")).first()[0]
        return every.where(F.col("upto") == upto).drop("upto"), upto


class Assets:
    """Bytes by name in a folder."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, uri: str) -> str:
        path = os.path.realpath(os.path.join(self.root, uri))
        if not path.startswith(os.path.realpath(self.root) + os.sep):
            raise ValueError("outside the store")
        return path

    def store(self, uri: str, content: bytes) -> str:
        path = self._path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
        return uri

    def retrieve(self, uri: str) -> bytes:
        with open(self._path(uri), "rb") as f:
            return f.read()

    def exists(self, uri: str) -> bool:
        return os.path.exists(self._path(uri))

    def delete(self, uri: str) -> None:
        os.remove(self._path(uri))
