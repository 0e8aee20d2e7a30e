"""Stores, logs, snapshots, assets and telemetry."""

from __future__ import annotations

import pytest

from larkspur.functions import providers
from larkspur.plans import registry
from larkspur.sources import readers, stores
from larkspur.streaming.streams import Telemetry


def test_log_appends_replays_and_truncates(spark, tmp_path):
    log = stores.EventLog(spark, f"{tmp_path}/log")
    log.append(spark.createDataFrame([(1, "a"), (2, "b")], "seq long, v string"))
    log.append(spark.createDataFrame([(3, "c")], "seq long, v string"))
    assert [r.v for r in log.replay(1).orderBy("seq").collect()] == ["b", "c"] and log.high_water_mark() == 3
    assert log.truncated(3, f"{tmp_path}/short").replay().count() == 1


def test_snapshots_keep_and_refuse(spark, tmp_path):
    s = stores.Snapshots(spark, str(tmp_path))
    assert s.names("team") == []
    s.save("team", "one", spark.range(3))
    assert s.names("team") == ["one"] and s.restore("team", "one").count() == 3
    with pytest.raises(ValueError):
        s.save("../x", "one", spark.range(1))


def test_assets_stay_inside(tmp_path):
    a = stores.Assets(str(tmp_path))
    a.store("x/y.bin", b"1")
    assert a.retrieve("x/y.bin") == b"1" and a.exists("x/y.bin")
    a.delete("x/y.bin")
    assert not a.exists("x/y.bin")
    with pytest.raises(ValueError):
        a.store("../../evil", b"")


def test_discovery_skips_tool_folders(spark, tmp_path):
    for name in ("a.md", "sub/b.md", ".git/c.md", "d.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# T\ntext")
    found = readers.read_documents(readers.discover(spark, str(tmp_path), ["md"])).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.md", "b.md"] and all(r.title == "T" for r in found)


def test_one_subscriber_fails_alone():
    t, seen = Telemetry(), []
    t.subscribers = [lambda row: 1 / 0, seen.append]
    t.publish({"event": "x"})
    assert seen == [{"event": "x"}] and t.failures == 1


def test_models_are_retried(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        if "bad" in texts:
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    got = {r.id: (r.result, r.error) for r in providers.apply_model(rows, model, "text", retries=1).collect()}
    assert got == {1: ("A", None), 2: (None, "bad text"), 3: ("", None)} and calls.value == 2 + 1 + 2 + 1


@pytest.fixture(scope="module")
def in_parts(spark, data, tmp_path_factory):
    """Documents and embeddings as folders of several files, as larger tables are."""
    folder = tmp_path_factory.mktemp("parts")
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{data}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["p10_ingestion_sink", "x1_stream_chunks", "x9_train_then_flush"])
def test_streams_of_tables_in_parts(name, spark, data, in_parts):
    run = registry.queries()[name]
    assert sorted(map(tuple, run(spark, in_parts).collect())) == sorted(map(tuple, run(spark, data).collect()))


def test_discovery_of_sizes_reads_no_contents(spark, data):
    plan = registry.queries()["s7_file_discovery"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "length" in plan
