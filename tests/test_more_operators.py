"""Operators of later rounds: positions, runs, maintained sets, staged hashes, tool matrix, layers."""

import pytest
from pyspark.sql import functions as F

from depot.functions.urls import normalize_url, with_normal_url
from depot.operators.cache import STATE_SCHEMA, plan_sync
from depot.operators.inventory import content_ends, content_hashes
from depot.operators.layers import missing_torch, ordered_lines
from depot.operators.matrix import latest_document, tool_matrix, torch_rules
from depot.operators.quality import build_runs, set_fingerprint, set_state, state_fingerprint, update_sets
from depot.operators.ranking import positions, version_positions
from depot.sources.documents import SNAPSHOT_SCHEMA


def test_positions_in_groups_and_by_version(spark, rows, monkeypatch):
    from depot.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_IN_ORDER", 7)
    df = spark.createDataFrame([(k % 3, 100 - k) for k in range(60)], "g int, v int").repartition(3)
    got = rows(positions(df, ["v"], ["g"]))
    for g in range(3):
        mine = sorted(v for v in range(41, 101) if (100 - v) % 3 == g)
        assert sorted((v, p) for a, v, p in got if a == g) == [(v, i) for i, v in enumerate(mine, 1)]
    texts = ["1.10", "1.9", "x", "1.9.0", "2", "1.9.0.dev1", "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.position for r in version_positions(df, "t", "t").collect()}
    assert sorted(texts, key=got.get) == ["2", "1.10", "1.9.0.dev1", "1.9.0", "1.9", "y", "x"]
    assert positions(df.limit(0), ["t"]).isEmpty()


def test_runs_end_with_a_gap(spark):
    data = [("a", 1, 0), ("a", 2, 50), ("a", 1, 109), ("a", 3, 170), ("a", 4, None), ("b", 9, 5)]
    df = spark.createDataFrame(data, "who string, snapshot int, s int")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))
    got = build_runs(df, "60 seconds", ["who"]).orderBy("who", "started").collect()
    assert [(r.who, r.duration_seconds, r.markers, r.snapshots) for r in got] == [
        ("a", 109, 3, [1, 2]), ("a", 0, 1, [3]), ("b", 0, 1, [9]),
    ]


def test_sets_follow_their_changes(spark, rows):
    schema = "g string, v string"
    before = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", None), ("d", None), ("d", "1")], schema)
    after = spark.createDataFrame([("a", "2"), ("a", "3"), ("c", None), ("d", None), ("e", "5")], schema)
    state = set_state(before, ["g"], "v")
    removed, added = before.exceptAll(after), after.exceptAll(before)
    got = state_fingerprint(update_sets(state, removed, added, ["g"], "v"), ["g"])
    assert rows(got) == rows(set_fingerprint(after, ["g"], "v"))
    same = update_sets(state, removed.limit(0), added.limit(0), ["g"], "v")
    assert rows(state_fingerprint(same, ["g"])) == rows(set_fingerprint(before, ["g"], "v"))


def test_only_candidates_are_hashed_whole(spark, rows):
    body = "x" * 100
    files = [
        ("a", "start" + body + "end"), ("b", "start" + body + "end"), ("c", "start" + body[:50] + "y" + body[51:] + "end"),
        ("alone in size", "start" + body + "end."), ("other start", "stArt" + body + "end"), ("other end", "start" + body + "eNd"),
        ("small", "s"), ("small too", "s"),
    ]
    df = spark.createDataFrame(files, "name string, text string").withColumn("size", F.length("text").cast("bigint"))
    fails = F.raise_error(F.concat(F.lit("hashed whole: "), "name")).cast("string")
    content = F.when(F.col("name").isin("a", "b", "c"), F.sha2("text", 256)).otherwise(fails)
    got = content_hashes(df, content, ["name"], 50, content_ends(F.col("text"), 8))
    assert rows(got, "name") == [("a",), ("b",), ("c",)]
    assert got.select("content_hash").distinct().count() == 2


def test_clean_plan_fetches_everything_again(spark, rows):
    old = spark.createDataFrame([("k", "u", 1, "e"), ("g", "u2", 2, "e")], STATE_SCHEMA)
    new = spark.createDataFrame([("k", "u", 1, "e"), ("n", "u3", 3, "e")], STATE_SCHEMA)
    present = spark.createDataFrame([("k", 1), ("g", 2), ("metadata.json", 9)], "name string, size bigint")
    got = rows(plan_sync(present, old, new, clean=True), "hash", "action")
    assert got == [("g", "delete"), ("k", "replace"), ("n", "download")]
    assert ("k", "keep") in rows(plan_sync(present, old, new), "hash", "action")


def test_urls_are_normalised_by_their_stems(spark, rows):
    urls = [
        "https://b.s3.eu.amazonaws.com/a/../f;p?sig=1#x", "https://b.s3.eu.amazonaws.com/a/../f;p?sig=2", "https://b.s3.eu.amazonaws.com?x",
        "https://b.s3.eu.amazonaws.com#/x?y", "https://h/f?a#b", "no url", "", None, "https://cdn-lfs.hf.co/x#?y",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = with_normal_url(df, "url", "plain")
    assert rows(got) == rows(df.withColumn("plain", normalize_url("url")))


def test_every_tool_with_every_python(spark, rows):
    tools = spark.createDataFrame(
        [(1, "0.9", "0.9"), (1, "slim", "0.9"), (1, "slim", "0.9"), (1, "slim@2", "0.9"), (2, "0.9", None)],
        "snapshot int, version string, default_version string",
    )
    pythons = spark.createDataFrame([(1, "3.8.20"), (1, "3.12.1"), (2, "3.8.1"), (3, "3.9.1")], "snapshot int, python string")
    none = spark.createDataFrame([("slim", "3.8")], "kind string, python string")
    got = rows(tool_matrix(tools, pythons, none, ["snapshot"]))
    assert got == [
        (1, "0.9", "3.12", "3.12.1", True), (1, "0.9", "3.8", "3.8.20", True), (1, "slim", "3.12", "3.12.1", False),
        (1, "slim@2", "3.12", "3.12.1", False), (2, "0.9", "3.8", "3.8.1", False),
    ]
    one = tool_matrix(tools.where("snapshot = 1").drop("snapshot"), pythons.where("snapshot = 1").drop("snapshot"), none)
    assert one.count() == 4


def test_latest_document_links_tools(spark):
    defs = spark.createDataFrame(
        [(1, {}, {}, {"3.9": "3.9.1"}, ["2.5.0"], [], "t"), (2, {}, {}, {"3.10": "3.10.1"}, ["2.6.0"], [], "t")],
        SNAPSHOT_SCHEMA,
    )
    links = spark.createDataFrame([("x", "1.0", "https://h/x")], "name string, version string, url string")
    [doc] = latest_document(defs, torch_rules(spark), links).collect()
    assert (doc.snapshot, doc.torch_versions, doc.releases) == (2, ["2.6.0"], {"x": ("1.0", "https://h/x")})


def test_lines_of_layers_keep_their_order(spark):
    schema = "env string, line_no int, text string"
    low = spark.createDataFrame([("e", 2, "c"), ("e", 1, "b"), ("f", 1, "z")], schema)
    high = spark.createDataFrame([("e", 1, "a"), ("e", 9, "d")], schema)
    got = ordered_lines([low, high]).orderBy("env", "position").collect()
    assert [(r.env, r.position, r.text) for r in got] == [("e", 1, "b"), ("e", 2, "c"), ("e", 3, "a"), ("e", 4, "d"), ("f", 1, "z")]


def test_torch_by_chance(spark, rows):
    data = [("e", "torch", None, "2.6.0"), ("f", "torch", "2.5.0", "2.6.0"), ("g", "other", None, "1"), ("h", "torch", "2.5.0", None)]
    aligned = spark.createDataFrame(data, "env string, package string, base string, user string")
    assert rows(missing_torch(aligned, "user", "base")) == [("e", "2.6.0")]


@pytest.mark.parametrize("keep", [1, 3])
def test_vacuum_keeps_what_is_read(spark, tmp_path, rows, keep):
    from depot.sinks.log import Log
    from depot.sinks.tables import read_cache_state, write_cache_state

    root = str(tmp_path / "state")
    for k in range(13):
        write_cache_state(spark.createDataFrame([(f"h{k}", "u", k, "e")], STATE_SCHEMA), root)
    assert len(Log(spark, root).vacuum(keep)) == 13 - keep
    for k in range(13 - keep, 13):
        assert rows(read_cache_state(spark, root, k), "size") == [(k,)]
    write_cache_state(spark.createDataFrame([("n", "u", 99, "e")], STATE_SCHEMA), root)
    assert rows(read_cache_state(spark, root), "size") == [(99,)]
