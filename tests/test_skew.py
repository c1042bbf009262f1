"""A third of all rows on one key: results stay whole and plans stay distributed."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depot.operators.cache import route
from depot.operators.diff import diff_chain, diff_snapshots, last_wins
from depot.operators.inventory import duplicate_content, links_to_make
from depot.operators.matrix import lookup_strict
from depot.operators.ranking import beyond_newest, budget_prefix, top_k_per_group

N = 6000


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return [
        (i, "hot" if i % 3 == 0 else f"k{rng.randrange(400)}", rng.randrange(2), rng.randrange(5))
        for i in range(N)
    ]


@pytest.fixture(scope="module")
def hot(spark, data):
    return spark.createDataFrame(data, "id int, k string, side int, v int").repartition(4)


def test_last_wins(hot, data):
    want = {}
    for i, k, s, v in data:
        want[k] = (i, v)
    got = {r.k: (r.id, r.v) for r in last_wins(hot, ["k"], ["id"], ["id", "v"]).collect()}
    assert got == want


def test_diff(hot, data):
    sides = defaultdict(dict)
    for i, k, s, v in data:
        sides[s][k] = v
    want = {k for k in sides[0].keys() | sides[1].keys() if sides[0].get(k) != sides[1].get(k)}
    got = diff_snapshots(hot.where("side = 0"), hot.where("side = 1"), ["k"], "v", order=["id"])
    assert {r.k for r in got.collect()} == want
    chain = diff_chain(hot, "side", ["k"], "v", order=["id"])
    assert {r.k for r in chain.collect()} == want


def test_routing_keeps_every_request(spark, hot, data):
    known = spark.createDataFrame(
        [(hashlib.sha256(b"hot").hexdigest(), False)], "name string, is_dir boolean"
    )
    prefixes = spark.createDataFrame([("k1",), ("k22",)], "p string")
    requests = hot.select("id", F.col("k").alias("url"), F.lit(False).alias("extract"))
    got = {r.id: r.route for r in route(requests, known, prefixes).collect()}
    assert len(got) == N
    for i, k, _, _ in data:
        want = "local" if k == "hot" else "bypass" if k.startswith(("k1", "k22")) else "lazy"
        assert got[i] == want


def test_lookup_and_retention(spark, hot, data):
    catalog = spark.createDataFrame([("hot", 1)], "k string, c int")
    found = lookup_strict(hot, catalog, ["k"], "report")
    assert found.where("found").count() == sum(k == "hot" for _, k, _, _ in data) and found.count() == N
    old = {r.id for r in beyond_newest(hot, ["k"], ["id"], 5).collect()}
    families = defaultdict(list)
    for i, k, _, _ in data:
        families[k].append(i)
    assert old == {i for ids in families.values() for i in sorted(ids)[:-5]}


def test_budget_with_one_hot_rank(spark, hot, data):
    feed = hot.select(F.when(F.col("k") == "hot", 5).otherwise(F.col("id") % 10).alias("rank"), "id", F.lit(3).alias("size"))
    got = {r.id for r in budget_prefix(feed, ["rank", "id"], "size", N).collect()}
    order = sorted((5 if k == "hot" else i % 10, i) for i, k, _, _ in data)
    assert got == {i for _, i in order[: N // 3]}


def test_hot_content(hot, data):
    files = hot.select("id", F.col("k").alias("text"), F.length("k").alias("size"))
    content = F.sha2("text", 256)
    groups = duplicate_content(files, content, ["id"], 1)
    by_text = defaultdict(list)
    for i, k, _, _ in data:
        by_text[k].append(i)
    assert {(r.keeper_id, r.copies) for r in groups.collect()} == {
        (min(v), len(v)) for v in by_text.values() if len(v) > 1
    }
    links = links_to_make(files, groups, content, ["id"])
    assert {(r.id, r.keeper_id) for r in links.collect()} == {
        (i, min(v)) for v in by_text.values() for i in v if i != min(v)
    }


def test_group_top_k_is_cut_before_the_shuffle(hot):
    ranked = top_k_per_group(hot, ["k"], [F.desc("id")], 2)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert ranked.where("k = 'hot'").count() == 2
