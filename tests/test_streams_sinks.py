import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from depot.operators.cache import STATE_SCHEMA
from depot.operators.durable import materialize, shared_dir
from depot.operators.matrix import matrix_summary, matrix_venvs, torch_rules
from depot.sinks.log import Log
from depot.sinks.tables import (
    append_marker,
    latest_version,
    read_cache_state,
    read_pins,
    write_cache_state,
    write_matrix,
    write_pins,
    write_requirements,
)
from depot.sources import parse_markers, read_events
from depot.sources.documents import SNAPSHOT_SCHEMA
from depot.streaming.demand import demand, route_share, stream_demand, stream_top_k, window_top_k
from depot.streaming.state import (
    changes,
    latest_batch,
    latest_state,
    stream_latest,
    stream_sync,
    sync_batch,
    sync_plans,
)


def write_events(path, name, events):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        for source, url, size, time in events:
            f.write(json.dumps({"source": source, "type": "download", "data": {"url": url, "size": size}, "event_time": time}) + "\n")


SIGNED = "https://b.s3.eu.amazonaws.com/f?sig="


def test_demand_closes_windows_and_drops_late_events(spark, tmp_path, rows):
    src = str(tmp_path / "events")

    def run():
        frame = demand(read_events(spark, src, 1), "1 hour", "1 hour")
        stream_demand(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return rows(
            spark.read.parquet(str(tmp_path / "out")).select(
                F.date_format("window_start", "HH"), "source", "url", "requests", "bytes"
            )
        )

    write_events(src, "1", [
        ("local", SIGNED + "1", 5, "2024-01-01T00:10:00Z"),
        ("local", SIGNED + "2", 5, "2024-01-01T00:20:00Z"),
        ("lazy", "u", 7, "2024-01-01T00:30:00Z"),
        ("lazy", "u", 7, "2024-01-01T03:00:00Z"),
    ])
    first = [("00", "lazy", "u", 1, 7), ("00", "local", SIGNED[:-5], 2, 10)]
    assert run() == first
    # behind the watermark (02:00): dropped; the 03:00 window is closed by the next event
    write_events(src, "2", [("lazy", "u", 7, "2024-01-01T00:40:00Z"), ("lazy", "v", 1, "2024-01-01T05:30:00Z")])
    assert run() == sorted([*first, ("03", "lazy", "u", 1, 7)], key=repr)


def test_top_k_stream_equals_batch(spark, tmp_path, rows):
    src = str(tmp_path / "events")
    data = [("s", f"u{i % 5}", i, f"2024-01-01T{i % 4:02d}:{i % 60:02d}:00Z") for i in range(97)]
    write_events(src, "1", data + [("s", "end", 1, "2024-01-02T00:00:00Z")])
    frame = demand(read_events(spark, src), "1 hour", "1 hour")
    stream_top_k(frame, 2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = spark.createDataFrame(data, "source string, url string, size bigint, t string").withColumn(
        "event_time", F.col("t").cast("timestamp")
    )
    want = window_top_k(demand(batch, "1 hour", None), 2)
    got = spark.read.parquet(str(tmp_path / "out")).drop("run", "batch")
    assert rows(got, "window_start", "url", "requests", "bytes", "rank") == rows(
        want, "window_start", "url", "requests", "bytes", "rank"
    )
    assert got.count() == 8
    share = route_share(demand(batch, "1 day", None), ["s", "x"]).first()
    assert (share.requests, share.permille_s, share.permille_x) == (97, 1000, 0)


FEED = "feed_time int, rank int, url string, size bigint, etag string"


def test_sync_stream_over_feeds_and_replay(spark, tmp_path, rows):
    root = str(tmp_path)

    def arrive(*feed):
        spark.createDataFrame(list(feed), FEED).write.mode("append").parquet(f"{root}/feeds")
        stream_sync(spark.readStream.schema(FEED).parquet(f"{root}/feeds"), root, 25, f"{root}/cp").awaitTermination()

    def plan(i):
        return rows(sync_plans(spark, root, i), "action", "bytes_downloaded")

    arrive((1, 0, "a", 10, "e"), (1, 1, "b", 10, "e"), (1, 2, "c", 10, "e"))
    assert plan(0) == [("download", 10), ("download", 10)]
    # two feeds in one batch: the newest counts
    arrive((2, 0, "z", 1, "e"), (3, 0, "b", 10, "f"), (3, 1, "a", 10, "e"))
    assert plan(1) == [("keep", 0), ("replace", 10)]
    state = rows(read_cache_state(spark, root))
    # the same batch again changes nothing
    again = spark.createDataFrame([(9, 0, "q", 1, "e")], FEED)
    [run] = Log(spark, root).at(1).runs
    sync_batch(again, 1, root, 25, run=run)
    assert rows(read_cache_state(spark, root)) == state and plan(1) == [("keep", 0), ("replace", 10)]
    sync_batch(again.limit(0), 2, root, 25, run=run)
    # a late feed does not roll the cache back
    arrive((2, 0, "late", 1, "e"))
    assert rows(read_cache_state(spark, root)) == state
    # with a new checkpoint batch ids start again: what is old stays out, what is new comes in
    spark.createDataFrame([(7, 0, "new", 5, "e")], FEED).write.mode("append").parquet(f"{root}/feeds")
    stream_sync(spark.readStream.schema(FEED).parquet(f"{root}/feeds"), root, 25, f"{root}/cp2").awaitTermination()
    assert rows(read_cache_state(spark, root), "url", "size") == [("new", 5)]
    assert rows(read_cache_state(spark, root, 1)) == state
    with pytest.raises(ValueError, match="which run"):
        sync_batch(again, 0, root, 25)


def test_latest_stream_emits_changes_only(spark, tmp_path, rows):
    root, schema = str(tmp_path), "k string, n int, v string"

    def arrive(*data):
        spark.createDataFrame(list(data), schema).write.mode("append").parquet(f"{root}/rows")
        stream = spark.readStream.schema(schema).parquet(f"{root}/rows")
        stream_latest(stream, root, ["k"], ["n"], ["v"], f"{root}/cp").awaitTermination()

    arrive(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"))
    assert rows(changes(spark, root, 0)) == [("a", 2, "y"), ("b", 1, "x")]
    # a newer row with the same value, an older row, a new value and a new key
    arrive(("a", 3, "y"), ("b", 0, "old"), ("c", 1, "z"))
    assert rows(changes(spark, root, 1)) == [("c", 1, "z")]
    arrive(("b", 5, "w"))
    assert rows(changes(spark, root, 2)) == [("b", 5, "w")]
    state = [("a", 3, "y"), ("b", 5, "w"), ("c", 1, "z")]
    assert rows(latest_state(spark, root, schema, ["k"])) == state
    # a replayed batch changes nothing
    [run] = Log(spark, root).at().runs
    late = spark.createDataFrame([("a", 9, "q")], schema)
    latest_batch(late, 2, root, ["k"], ["n"], ["v"], run)
    assert rows(latest_state(spark, root, schema, ["k"])) == state
    # another run has batches of the same numbers
    latest_batch(late, 2, root, ["k"], ["n"], ["v"], "another")
    assert rows(changes(spark, root, 3)) == [("a", 9, "q")]
    # with a new checkpoint all rows come again, and none is newer
    stream = spark.readStream.schema(schema).parquet(f"{root}/rows")
    stream_latest(stream, root, ["k"], ["n"], ["v"], f"{root}/cp2").awaitTermination()
    assert rows(changes(spark, root, 4)) == []
    assert rows(latest_state(spark, root, schema, ["k"])) == [("a", 9, "q"), *state[1:]]
    assert rows(latest_state(spark, root, schema, ["k"], 2)) == state


def test_latest_batch_touches_the_buckets_of_its_keys(spark, tmp_path, rows):
    root, schema = str(tmp_path), "k long, n int, v string"
    log = Log(spark, root)

    def batch(number, data):
        df = spark.createDataFrame(data, schema)
        latest_batch(df, number, root, ["k"], ["n"], ["v"], "r", buckets=8)
        return log.at()

    before = batch(0, [(k, 0, "x") for k in range(100)])
    assert len(before.parts) == 8
    want = {k: (k, 0, "x") for k in range(100)}
    for n in range(1, 21):
        after = batch(n, [(5, n, f"v{n}"), (5, n - 1, "late")])
        changed = [b for b in after.parts if after.parts[b] != before.parts[b]]
        assert len(changed) == 1
        # nothing is written beside the row, except where folders are merged
        assert rows(changes(spark, root, n)) == [(5, n, f"v{n}")]
        assert max(map(len, after.parts.values())) <= 9
        before = after
    want[5] = (5, 20, "v20")
    assert rows(latest_state(spark, root, schema, ["k"])) == sorted(want.values(), key=repr)
    assert (20, "json") in [(int(n[:12]), n[13:]) for n in os.listdir(f"{root}/_log")]
    gone = log.vacuum(keep=2)
    assert len(gone) > 10 and rows(changes(spark, root, 19)) == [(5, 19, "v19")]
    assert rows(latest_state(spark, root, schema, ["k"])) == sorted(want.values(), key=repr)
    with pytest.raises(ValueError, match="vacuumed"):
        log.at(3)
    batch(21, [(5, 21, "w")])
    assert rows(changes(spark, root, 21)) == [(5, 21, "w")]


PINS = "snapshot int, env string, package string, raw_version string"


def test_pins_are_immutable(spark, tmp_path, rows):
    path = str(tmp_path / "pins")
    one = spark.createDataFrame([(1, "e", "a", "1"), (1, "f", "a", "1")], PINS)
    assert read_pins_or_none(spark, path) == []
    assert write_pins(one, path) == 0
    assert write_pins(one.withColumn("snapshot", F.lit(2)), path) == 1
    # one snapshot is new and one is not: neither gets in
    with pytest.raises(ValueError, match="immutable and 2 already"):
        write_pins(one.withColumn("snapshot", F.col("env").eqNullSafe("e").cast("int") + 2), path)
    assert rows(read_pins(spark, path), "snapshot", "env") == [(1, "e"), (1, "f"), (2, "e"), (2, "f")]
    assert rows(read_pins(spark, path, 0), "snapshot", "env") == [(1, "e"), (1, "f")]
    with pytest.raises(ValueError, match="no version 2"):
        read_pins(spark, path, 2)


def read_pins_or_none(spark, path):
    return read_pins(spark, path).collect()


def test_of_racing_writers_one_publishes(spark, tmp_path, rows):
    path = str(tmp_path / "pins")
    df = spark.createDataFrame([(1, "e", "a", "1")], PINS)

    def write(k):
        try:
            # two writers each of three snapshots, told apart by their version
            return write_pins(df.select(F.lit(k % 3).alias("snapshot"), "env", "package", F.lit(f"{k}").alias("raw_version")), path)
        except ValueError:
            return None

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(write, range(6)))
    assert sorted(v for v in got if v is not None) == [0, 1, 2]
    winners = sorted((k % 3, str(k)) for k, v in enumerate(got) if v is not None)
    assert rows(read_pins(spark, path), "snapshot", "raw_version") == winners
    # what the others staged is not read, and goes when it is old
    log = Log(spark, path)
    assert len(os.listdir(f"{path}/data")) == 6 and log.vacuum(keep=9) == []
    assert len(log.vacuum(keep=9, staged_since_ms=int(time.time() * 1000) + 60_000)) == 3
    assert rows(read_pins(spark, path), "snapshot", "raw_version") == winners


def test_an_entry_is_created_once(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda k: log.commit({"put": {str(k): [str(k)]}}).number, range(25)))
    assert sorted(versions) == list(range(25))
    assert sorted(log.at().parts, key=int) == [str(k) for k in range(25)]
    assert {n for n in os.listdir(f"{tmp_path}/_log") if "draft" in n} == set()
    assert [n for n in sorted(os.listdir(f"{tmp_path}/_log")) if n.endswith("checkpoint")] == [
        f"{n:012d}.checkpoint" for n in (9, 19)
    ]
    assert sorted(log.at(12).parts) == sorted(str(k) for k, v in enumerate(versions) if v <= 12)


def test_cache_state_versions(spark, tmp_path, rows):
    root = str(tmp_path / "state")
    assert latest_version(spark, root) is None and read_cache_state(spark, root).isEmpty()
    one = spark.createDataFrame([("h", "u", 1, "e")], STATE_SCHEMA)
    assert write_cache_state(one, root) == 0
    assert write_cache_state(one.withColumn("size", F.lit(2).cast("bigint")), root, after=0) == 1
    with pytest.raises(ValueError, match="came between"):
        write_cache_state(one, root, after=0)
    assert rows(read_cache_state(spark, root), "size") == [(2,)]
    assert rows(read_cache_state(spark, root, 0), "size") == [(1,)]
    assert latest_version(spark, root) == 1
    # a folder without entry is not seen
    one.write.parquet(f"{root}/data/more")
    assert rows(read_cache_state(spark, root), "size") == [(2,)]
    [old] = Log(spark, root).vacuum()
    assert old not in os.listdir(f"{root}/data") and rows(read_cache_state(spark, root), "size") == [(2,)]


def test_matrix_document_and_requirements(spark, tmp_path):
    defs = spark.createDataFrame([(1, {"12.4": "12.4.1"}, {"9": "9.1"}, {"3.9": "3.9.1"}, ["2.6.0"], [], "t")], SNAPSHOT_SCHEMA)
    rules = torch_rules(spark)
    write_matrix(matrix_summary(defs, rules), matrix_venvs(defs, rules), str(tmp_path / "m"))
    doc = json.loads(spark.read.text(str(tmp_path / "m/heads")).first().value)
    assert doc["torch_cudas"] == {"2.6.0": ["11.8", "12.4", "12.6"]}
    venvs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m/venvs")).collect()]
    assert [(v["python"], v["torch"], v["cuda"]) for v in venvs] == [("3.9", "2.6.0", c) for c in ("cpu", "12.4")]
    pins = spark.createDataFrame([("e", "b", "1"), ("e", "a", "https://h/a"), ("f", "c", "2")], "env string, package string, raw_version string")
    write_requirements(pins, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r/env=e")).collect()] == ["a @ https://h/a", "b==1"]


def test_audit_markers(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = spark.createDataFrame([(1, "3.9")], "snapshot int, python string")
    append_marker(df, path, "venv", {"python_version": F.col("python")}, keys=["snapshot"])
    append_marker(df, path, "venv", {"python_version": F.col("python")}, keys=["snapshot"])
    texts = spark.read.text(path).withColumnRenamed("value", "text")
    got = parse_markers(texts).collect()
    assert len(got) == 2 and all(r.done for r in got)
    assert got[0].attributes == {"kind": "venv", "venv.python_version": "3.9"}


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    kept = materialize(df, "ids")
    assert kept.count() == 5 and kept.inputFiles()
