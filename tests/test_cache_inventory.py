import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depot.operators import ranking
from depot.operators.cache import STATE_SCHEMA, has_prefix, new_state, plan_sync, route, sync_summary, with_stat
from depot.operators.inventory import (
    duplicate_candidates,
    duplicate_content,
    links_to_make,
    orphans,
    path_size,
    usage,
)
from depot.operators.quality import (
    changed_sets,
    check,
    contiguous,
    default_in_list,
    duplicates,
    readiness,
    set_fingerprint,
)
from depot.operators.ranking import (
    beyond_newest,
    budget_prefix,
    expired,
    latest_pointer,
    pick_asset,
    running_total,
    stale,
    top_k,
    top_k_per_group,
)
from depot.plans.sync import plan_cache

FEED = "rank int, url string, size bigint, etag string"


def key(url):
    return hashlib.sha256(url.encode()).hexdigest()


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_budget_needs_sizes_and_ignores_parts(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sized = spark.range(40).selectExpr("id", "(id * 7) % 13 AS n")
        want, run = [], 0
        for r in sized.orderBy("id").collect():
            run += r.n
            if run > 120:
                break
            want.append((r.id,))
        assert rows(budget_prefix(sized, ["id"], "n", 120), "id") == sorted(want, key=repr)
        for bad in ("IF(id = 39, NULL, n)", "IF(id = 3, -1, n)"):
            with pytest.raises(ValueError, match="1 rows have no usable n"):
                budget_prefix(sized.selectExpr("id", f"{bad} AS n"), ["id"], "n", 120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_budget_stops_at_first_overflow(spark, rows):
    feed = spark.createDataFrame([(0, "a", 40, ""), (1, "b", 30, ""), (2, "c", 50, ""), (3, "d", 1, "")], FEED)
    # d would still fit, but the prefix has ended
    assert rows(budget_prefix(feed, ["rank"], "size", 100), "url") == [("a",), ("b",)]
    assert rows(budget_prefix(feed, ["rank"], "size", 70), "url") == [("a",), ("b",)]
    assert budget_prefix(feed, ["rank"], "size", 39).count() == 0
    assert budget_prefix(feed, ["rank"], "size", 121).count() == 4
    assert budget_prefix(feed.limit(0), ["rank"], "size", 1).count() == 0


@pytest.mark.parametrize("shape", ["spread", "one order value", "zeros"])
def test_running_sums_equal_global_window(spark, rows, shape):
    rng = random.Random(7)
    data = [
        (0 if shape == "one order value" else rng.randrange(40), i, 0 if shape == "zeros" else rng.randrange(9))
        for i in range(500)
    ]
    df = spark.createDataFrame(data, "a int, b int, n bigint")
    want = df.withColumn("running", F.sum("n").over(Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(running_total(df, ["a", "b"], "n"), "a", "b", "running") == rows(want, "a", "b", "running")
    for budget in (0, 1, 777, 10**6):
        got = budget_prefix(df, ["a", "b"], "n", budget)
        assert rows(got, "a", "b") == rows(want.where(F.col("running") <= budget), "a", "b")


@pytest.mark.parametrize("shape", ["spread", "one order value", "texts and nulls"])
def test_budget_is_found_in_rounds(spark, rows, monkeypatch, shape):
    rng = random.Random(11)
    for name, value in (("ROWS_IN_ORDER", 20), ("RANGES", 4), ("LOOKED_AT", 64)):
        monkeypatch.setattr(ranking, name, value)

    def first(i):
        if shape == "one order value":
            return "x"
        return rng.choice([None, "", "é", "z", "\U0001f600"]) if shape == "texts and nulls" else f"{rng.randrange(90):03d}"

    data = [(first(i), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "a string, b int, n bigint").repartition(3)
    want = df.withColumn("run", F.sum("n").over(Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    runs = [r.run for r in want.select("run").orderBy("run").collect()]
    for budget in (0, runs[1500], runs[1500] + 1, runs[-1] - 1, runs[-1]):
        got = budget_prefix(df, ["a", "b"], "n", budget)
        assert rows(got, "a", "b") == rows(want.where(F.col("run") <= budget), "a", "b")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan


def test_budget_moves_sums_only(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_IN_ORDER", 1000)
    df = spark.range(0, 200_000, 1, 4).withColumn("n", F.lit(3).cast("bigint"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("budget", "")
    try:
        assert budget_prefix(df, ["id"], "n", 300_000).count() == 100_000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("budget")) < 20


def test_running_total_of_many_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_IN_ORDER", 50)
    df = spark.range(0, 1000, 1, 3).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("n"))
    got = running_total(df, ["k"], "n").orderBy("k").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.running == total


def test_urls_meet_prefixes_of_any_length_as_one_row(spark, rows):
    rng = random.Random(3)
    prefixes = ["h/" + "a" * n for n in range(1, 500, 2)] + [f"p{k}" * k for k in range(1, 250)] + ["é", "\U0001f600x", ""]
    urls = {"".join(rng.choice("ha/p1é\U0001f600x") for _ in range(rng.randrange(1, 7))) for _ in range(300)}
    urls |= {p[: len(p) - 1] for p in prefixes if p} | {p + "b" for p in prefixes} | set(prefixes) | {"h/b", "i"}
    df = spark.createDataFrame([(u,) for u in sorted(urls)], "url string").repartition(3)
    table = spark.createDataFrame([(p,) for p in [*prefixes, prefixes[0]]], "p string")
    want = [(u, any(p and u.startswith(p) for p in prefixes)) for u in urls]
    assert rows(has_prefix(df, "url", table, "hit")) == sorted(want, key=repr)
    nulls = df.unionByName(spark.createDataFrame([(None,)], "url string"))
    assert rows(has_prefix(nulls, "url", table, "hit").where("url is null")) == [(None, False)]


def state(spark, **objects):
    return spark.createDataFrame([(h, f"u-{h}", *v) for h, v in objects.items()], STATE_SCHEMA)


def test_sync_plan_cases(spark, rows):
    old = state(spark, same=(1, "e"), newer=(1, "e"), gone=(1, "e"), nulls=(1, None), lost=(2, "e"), both_absent=(1, "e"))
    new = state(spark, same=(1, "e"), newer=(1, "f"), nulls=(1, None), lost=(2, "e"), fresh=(3, "e"), stray=(4, "e"))
    names = ["same", "newer", "gone", "nulls", "stray", "tmp-fresh", "metadata.json"]
    present = spark.createDataFrame([(n, 10) for n in names], "name string, size bigint")
    plan = plan_sync(present, old, new)
    assert rows(plan, "hash", "action", "bytes_deleted", "bytes_downloaded") == [
        ("fresh", "download", 0, 3),
        ("gone", "delete", 10, 0),
        ("lost", "download", 0, 2),
        ("newer", "replace", 10, 1),
        ("nulls", "keep", 0, 0),
        ("same", "keep", 0, 0),
        ("stray", "replace", 10, 4),
        ("tmp-fresh", "delete", 10, 0),
    ]
    assert tuple(sync_summary(plan).first()) == (2, 2, 2, 2, 40, 10)


def test_sync_plan_is_stable_once_applied(spark):
    obj = st.tuples(st.sampled_from("abcde"), st.integers(0, 2), st.sampled_from([None, "x", "y"]))
    table = st.lists(obj, max_size=5, unique_by=lambda r: r[0])

    @settings(max_examples=10, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(table, table, st.lists(st.sampled_from("abcdefg"), unique=True))
    def run(o, n, files):
        old, new = (spark.createDataFrame([(h, h, s, e) for h, s, e in t], STATE_SCHEMA) for t in (o, n))
        present = spark.createDataFrame([(f, 1) for f in files], "name string, size bigint")
        actions = {r["hash"]: r.action for r in plan_sync(present, old, new).collect()}
        od, nd = ({r[0]: r for r in t} for t in (o, n))
        for f in files:
            want = "delete" if f not in nd else "keep" if od.get(f) == nd[f] else "replace"
            assert actions.pop(f) == want
        assert actions == {h: "download" for h in nd if h not in files}
        after = spark.createDataFrame([(h, 1) for h in nd], "name string, size bigint")
        assert plan_sync(after, new, new).where("action <> 'keep'").isEmpty()

    run()


def test_plan_cache_charges_duplicates_but_stores_once(spark, rows):
    feed = spark.createDataFrame([(0, "a", 10, "1"), (1, "a", 10, "2"), (2, "b", 10, "1"), (3, "c", 10, "1")], FEED)
    empty = spark.createDataFrame([], STATE_SCHEMA)
    plan, new = plan_cache(feed, empty, spark.createDataFrame([], "name string, size bigint"), 30)
    assert rows(new, "url", "etag") == [("a", "2"), ("b", "1")]
    assert rows(plan, "hash", "action") == sorted([(key("a"), "download"), (key("b"), "download")])
    assert rows(new_state(feed), "url") == [("a",), ("b",), ("c",)]


def test_with_stat(spark, rows):
    stats = spark.createDataFrame([("a", 1, "e", 200), ("b", 2, None, 404)], "url string, size bigint, etag string, status int")
    feed = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "rank int, url string")
    assert rows(with_stat(feed, stats), "rank", "url", "size") == [(0, "a", 1)]


def test_prefixes_as_list_and_table(spark, rows):
    urls = spark.createDataFrame([("https://a/x",), ("https://ab/x",), ("s3://b",), ("",)], "url string")
    for prefixes in (["https://a/", "s3://", ""], spark.createDataFrame([("https://a/",), ("s3://",), ("",)], "p string")):
        assert rows(has_prefix(urls, "url", prefixes, "hit")) == [
            ("", False), ("https://a/x", True), ("https://ab/x", False), ("s3://b", True),
        ]
    for nothing in ([], [""], spark.createDataFrame([("",)], "p string")):
        assert has_prefix(urls, "url", nothing, "hit").where("hit").isEmpty()


def test_prefix_join_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    urls = sorted({text(rng.randrange(12)) for _ in range(200)})
    prefixes = sorted({text(rng.randrange(1, 7)) for _ in range(25)})
    df = spark.createDataFrame([(u,) for u in urls + urls[:50]], "url string")
    got = has_prefix(df, "url", spark.createDataFrame([(p,) for p in prefixes], "p string"), "hit").collect()
    assert len(got) == len(urls) + 50
    for r in got:
        assert r.hit == any(r.url.startswith(p) for p in prefixes)


def test_route(spark, rows):
    requests = spark.createDataFrame(
        [("file", False), ("dir", True), ("dir", False), ("https://p/x", False), ("other", False)],
        "url string, extract boolean",
    )
    known = spark.createDataFrame([(key("file"), False), (key("dir"), True)], "name string, is_dir boolean")
    assert rows(route(requests, known, ["https://p/"]), "url", "extract", "route") == [
        ("dir", False, "bypass"),
        ("dir", True, "local"),
        ("file", False, "local"),
        ("https://p/x", False, "bypass"),
        ("other", False, "lazy"),
    ]
    assert rows(route(requests, known, [], lazy_available=False).where("url = 'other'"), "route") == [("bypass",)]


FILES = [
    (0, "cache/a/x", 5, "A"), (0, "cache/b", 5, "A"), (1, "env/x", 5, "A"), (1, "env/y", 5, "B"),
    (1, "env/z", 3, "C"), (1, "top", 3, "C"), (1, "env/one", 9, "D"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "root int, path string, size bigint, content string")


def test_usage(files, rows):
    assert rows(usage(files, 1)) == [(".", 35, 7), ("cache", 10, 2), ("env", 22, 4)]
    assert rows(usage(files, 2)) == [(".", 35, 7), ("cache", 10, 2), ("cache/a", 5, 1), ("env", 22, 4)]
    assert rows(path_size(files, "cache")) == [(10,)]
    assert rows(path_size(files, "env/y")) == [(5,)]
    assert rows(path_size(files, "nothing")) == [(0,)]


def test_duplicates(files, rows):
    rank = ["root", "path"]
    got = duplicate_content(files, F.sha2("content", 256), rank, 1)
    assert rows(got, "size", "copies", "keeper_path", "bytes_saved") == [(3, 2, "env/z", 3), (5, 3, "cache/a/x", 10)]
    assert duplicate_content(files, F.sha2("content", 256), rank, 4).count() == 1
    links = links_to_make(files, got, F.sha2("content", 256), rank)
    assert rows(links, "path", "keeper_path") == [("cache/b", "cache/a/x"), ("env/x", "cache/a/x"), ("top", "env/z")]
    assert rows(duplicate_candidates(files, 1).groupBy("size").count()) == [(3, 2), (5, 4)]


def test_orphans(spark, rows):
    arts = spark.createDataFrame([(f"/c/{n}", n) for n in ("cuda-1", "cuda-2", "cudnn-9", "other-1")], "path string, name string")
    links = spark.createDataFrame([("g1/cuda", "/c/cuda-1"), ("g2/cuda", "/c/cuda-1")], "link string, target string")
    assert rows(orphans(arts, links, ["cuda", "cudnn"]), "name", "kind") == [("cuda-2", "cuda"), ("cudnn-9", "cudnn")]


def test_contiguous_and_duplicates(spark, rows):
    def ok(*ids, start=None):
        return contiguous(spark.createDataFrame([(i,) for i in ids], "id int"), "id", start).first().ok

    assert ok(0, 1, 2, start=0) and ok(4, 5) and ok()
    assert not ok(0, 2) and not ok(0, 1, 1) and not ok(0, 0, 2) and not ok(1, 2, start=0)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "x int, y string")
    assert rows(duplicates(df, ["x", "y"])) == [(1, "a", 2)]
    row = spark.range(1).select(default_in_list(F.lit("a"), F.array(F.lit("b"), F.lit("a"))).alias("ok")).first()
    assert row.ok


def test_set_fingerprint(spark, rows):
    def fp(*values):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v string")
        return set_fingerprint(df, ["g"], "v").first().fingerprint

    assert fp("a", "b", "c") == fp("c", "a", "b", "a")
    assert len({fp("a"), fp("b"), fp("a", "b"), fp("ab"), fp("a", "c")}) == 5
    now = spark.createDataFrame([("g", "1"), ("h", "2")], "g string, fingerprint string")
    before = spark.createDataFrame([("g", "1"), ("h", "1")], "g string, fingerprint string")
    assert rows(changed_sets(now, before, ["g"]), "g") == [("h",)]


def test_readiness_and_pointer(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00"), (3, None)], "snapshot int, t string").select(
        "snapshot", F.col("t").cast("timestamp").alias("timestamp")
    )
    row = readiness(df, 1, 2).first()
    assert (row.snapshots, row.done, row.ready, row.duration_seconds) == (2, 2, True, 3600)
    assert not readiness(df, 1, 3).first().ready
    assert latest_pointer(df, 0, 3).first().latest == 3
    assert latest_pointer(df, 0, 2).first().latest is None
    assert expired(df, 2).count() == 1


def test_retention_and_staleness(spark, rows):
    df = spark.createDataFrame([("f", i) for i in range(6)] + [("g", 1)], "fam string, id int")
    assert rows(beyond_newest(df, ["fam"], ["id"], 4)) == [("f", 0), ("f", 1)]
    marks = spark.createDataFrame([("old", "2024-01-01"), ("new", "2024-01-02"), ("ahead", "2024-01-04"), ("never", None)], "n string, m string").select(
        "n", F.col("m").cast("timestamp").alias("mtime")
    )
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert rows(stale(marks, now, 86400), "n") == [("ahead",), ("never",), ("old",)]


def test_top_k(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 9), ("a", 1), ("d", None)], "url string, size bigint")
    assert [tuple(r) for r in top_k(df, 3).collect()] == [("a", 2, 2), ("b", 2, 5), ("c", 1, 9)]
    assert [r.url for r in top_k(df, 1, by="bytes").collect()] == ["c"]
    got = top_k_per_group(df, ["url"], [F.desc("size")], 1)
    assert rows(got, "url", "size") == [("a", 1), ("b", 3), ("c", 9), ("d", None)]


def test_pick_asset_modes(spark, rows):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), ("l", 1, "z")], "k string, pos int, v string")
    pred = F.col("v") != "z"
    assert rows(pick_asset(df, ["k"], "pos", ["v"], pred, "drop")) == [("k", "y")]
    assert rows(pick_asset(df, ["k"], "pos", ["v"], pred, "null")) == [("k", "y"), ("l", None)]
    with pytest.raises(PySparkException, match="no matching asset for l"):
        pick_asset(df, ["k"], "pos", ["v"], pred).collect()


def test_contiguous_per_registry(spark, rows):
    ids = [("test", 0), ("test", 1), ("prod", 0), ("prod", 1), ("prod", 3)]
    df = spark.createDataFrame(ids, "environment string, id int")
    got = contiguous(df, "id", 0, ["environment"])
    assert rows(got, "environment", "ok") == [("prod", False), ("test", True)]
    counted = check(df, {"small": F.col("id") < 2}, ["environment"])
    assert rows(counted, "environment", "rule", "checked", "violations") == [
        ("prod", "small", 3, 1), ("test", "small", 2, 0),
    ]
