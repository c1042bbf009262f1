from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depot.operators.diff import (
    common_names,
    diff_chain,
    diff_envs,
    diff_snapshots,
    last_wins,
    names_only_in,
    union_names,
)
from depot.operators.layers import (
    align_layers,
    conflicts,
    overlay,
    overlay_excluded,
    overlay_kept,
    render_requirements,
    split_by,
)
from depot.operators.ranking import distinct_versions, latest_per_key, order_by_version
from depot.plans.fleet import release_notes, user_layer

PIN = "env string, package string, raw_version string"


def pins(spark, *rows):
    return spark.createDataFrame(list(rows), PIN)


def test_diff_snapshots(spark, rows):
    a = pins(spark, ("e", "same", "1"), ("e", "gone", "1"), ("e", "moved", "1.0"), ("only", "x", "1"), ("e", "nul", None), ("e", "both", None))
    b = pins(spark, ("e", "same", "1"), ("e", "new", "2"), ("e", "moved", "1.0.0"), ("e", "both", None))
    got = diff_snapshots(a, b, ["env", "package"], "raw_version", within=["env"])
    assert rows(got, "package", "status", "left_value", "right_value") == [
        ("gone", "only_left", "1", None),
        ("moved", "changed", "1.0", "1.0.0"),
        ("new", "only_right", None, "2"),
        ("nul", "only_left", None, None),
    ]
    assert diff_snapshots(a, b, ["env", "package"], "raw_version").count() == 5
    # the variant with an order gives the same rows
    tag = [df.withColumn("n", F.lit(1)) for df in (a, b)]
    ordered = diff_snapshots(*tag, ["env", "package"], "raw_version", order=["n"], within=["env"])
    assert rows(ordered) == rows(got)


def test_repeated_keys_last_wins(spark, rows):
    df = spark.createDataFrame([("p", 1, "b"), ("p", 2, "a"), ("q", 1, "x"), ("q", 1, "y")], "k string, n int, v string")
    assert rows(last_wins(df, ["k"], ["n"])) == [("p", 2, "a"), ("q", 1, "y")]


def test_diff_properties(spark):
    pin = st.tuples(st.sampled_from("ef"), st.sampled_from("pqr"), st.sampled_from(["1", "2"]))
    table = st.lists(pin, max_size=8, unique_by=lambda r: r[:2])

    @settings(max_examples=12, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(table, table)
    def run(x, y):
        a, b = spark.createDataFrame(x, PIN), spark.createDataFrame(y, PIN)
        keys = ["env", "package"]
        got = {tuple(r) for r in diff_snapshots(a, b, keys, "raw_version").collect()}
        left, right = {r[:2]: r[2] for r in x}, {r[:2]: r[2] for r in y}
        want = set()
        for k in left.keys() | right.keys():
            if left.get(k) != right.get(k):
                s = "changed" if k in left and k in right else "only_left" if k in left else "only_right"
                want.add((*k, s, left.get(k), right.get(k)))
        assert got == want
        flip = {"only_left": "only_right", "only_right": "only_left", "changed": "changed"}
        mirrored = {(e, p, flip[s], r, v) for e, p, s, v, r in got}
        assert {tuple(r) for r in diff_snapshots(b, a, keys, "raw_version").collect()} == mirrored
        assert diff_snapshots(a, a, keys, "raw_version").isEmpty()

    run()


def test_chain_equals_pairwise(spark, rows):
    data = [(s, e, p, f"{(s * 7 + len(e) * 3 + i) % 4}") for s in (1, 2, 3, 5) for e in ("a", "bb") for i, p in enumerate("xyz") if (s + i) % 3]
    df = spark.createDataFrame(data, "snapshot int, env string, package string, raw_version string")
    chain = diff_chain(df, "snapshot", ["env", "package"], "raw_version", within=["env"])
    want = []
    for s, after in ((1, 2), (2, 3), (3, 5)):
        a, b = df.where(f"snapshot = {s}"), df.where(f"snapshot = {after}")
        want += [(s, *r) for r in rows(diff_snapshots(a, b, ["env", "package"], "raw_version", within=["env"]))]
    assert rows(chain, "snapshot", "env", "package", "status", "left_value", "right_value") == sorted(want, key=repr)


def test_chain_with_gaps_nulls_and_repeats(spark, rows):
    """An environment that comes and goes, null ids, environments and values, keys twice; by a plain loop."""
    data = [(1, "a", "x", 1, "1"), (1, "a", "x", 2, "2"), (4, "a", "x", 1, "2"), (9, "a", "x", 1, None), (9, "a", "y", 1, None)]
    data += [(1, "b", "x", 1, "1"), (9, "b", "x", 1, "2"), (16, "b", "x", 1, "2"), (16, "b", None, 1, "3"), (25, None, "x", 1, "1")]
    data += [(None, "a", "x", 9, "9"), (1, None, "x", 1, "1"), (4, None, "x", 1, "2"), (16, "a", "x", 1, None), (16, "a", "z", 1, None)]
    df = spark.createDataFrame(data, "snapshot int, env string, package string, n int, raw_version string")
    ids = sorted({r[0] for r in data} - {None})
    for within in ([], ["env"]):
        want = []
        for s, after in zip(ids, ids[1:]):
            sides = [
                {r[1:3]: r[4] for r in sorted((r for r in data if r[0] == i), key=lambda r: r[3])} for i in (s, after)
            ]
            envs = {e for e, _ in sides[0]} & {e for e, _ in sides[1]} - {None}
            for k in {*sides[0], *sides[1]}:
                if (not within or k[0] in envs) and (k not in sides[0] or k not in sides[1] or sides[0][k] != sides[1][k]):
                    status = "only_right" if k not in sides[0] else "changed" if k in sides[1] else "only_left"
                    want.append((s, *k, status, sides[0].get(k), sides[1].get(k)))
        chain = diff_chain(df, "snapshot", ["env", "package"], "raw_version", order=["n"], within=within)
        assert rows(chain) == sorted(want, key=repr)


def test_chain_moves_a_row_once(spark):
    """Rows go to one row per snapshot and key, those to their keys; the diff itself is not shuffled."""
    df = spark.range(40000).selectExpr("id % 4 * 3 AS snapshot", "id % 10 AS env", "id % 5000 AS package", "id AS v")
    chain = diff_chain(df, "snapshot", ["env", "package"], "v", within=["env"])
    plan = chain._jdf.queryExecution().executedPlan().toString()
    moved = [line.split("Exchange hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and "SortMergeJoin" not in plan, plan


def test_env_sets(spark, rows):
    a, b = pins(spark, ("x", "p", "1"), ("y", "p", "1"), ("y", "q", "1")), pins(spark, ("y", "p", "1"), ("z", "p", "1"))
    assert rows(diff_envs(a, b)) == [("x", "removed"), ("y", "common"), ("z", "added")]
    na, nb = a.select("env"), b.select("env")
    assert rows(common_names(na, nb)) == [("y",)]
    assert rows(names_only_in(na, nb)) == [("x",)]
    assert rows(union_names(na, nb)) == [("x",), ("y",), ("z",)]


LAYERS = ["tools", "base", "user"]


def layers(spark, **packages):
    data = [("e", layer, p.replace("_", "-"), v) for p, vs in packages.items() for layer, v in zip(LAYERS, vs) if v]
    return spark.createDataFrame(data, "env string, layer string, package string, raw_version string")


def test_conflict_grades(spark, rows):
    df = layers(
        spark,
        same=("1.2.3", "1.2.4", "1.2"),
        minor=("1.2", "1.3", None),
        both=("1.2", "2.3", "1.2"),
        major_only=("1.2", None, "2.2"),
        url=("1.2", "https://h/x", None),
        urls=(None, "https://h/x", "https://h/x"),
        hf_transfer=("1.2", "2.3", None),
        single=("1.2", None, None),
    )
    got = conflicts(align_layers(df, LAYERS), LAYERS)
    assert rows(got, "package", "grade") == [("both", "error"), ("minor", "warning"), ("url", "error")]


def test_overlay_and_rendering(spark, rows):
    df = layers(
        spark,
        equal=(None, "1.0", "1.0"),
        differ=(None, "1.0", "1.1"),
        mine=(None, None, "2.0"),
        link=(None, None, "https://h/link.whl"),
        below=(None, "3.0", None),
    )
    aligned = align_layers(df, LAYERS)
    assert rows(overlay_kept(aligned, "user", "base"), "package") == [("link",), ("mine",)]
    assert rows(overlay_excluded(aligned, "user", "base"), "package") == [("differ",)]
    assert rows(overlay(aligned, "user", "base"), "package", "decision", "differs") == [
        ("differ", "excluded", True), ("equal", "excluded", False), ("link", "kept", False), ("mine", "kept", False),
    ]
    reqs = pins(spark, ("e", "a", "1.0"), ("e", "b", "https://h/b"), ("e", "/src/c.whl", "/src/c.whl"))
    assert rows(render_requirements(reqs), "requirement") == [("/src/c.whl",), ("a==1.0",), ("b @ https://h/b",)]


def test_user_layer_plan(spark, rows):
    tools = pins(spark, ("e", "a", "1.1"))
    base = pins(spark, ("e", "a", "2.2"), ("e", "b", "1.0"))
    user = pins(spark, ("e", "b", "1.1"), ("e", "c", "3"))
    report, decided, text = user_layer(tools, base, user)
    assert rows(report, "package", "grade") == [("a", "error"), ("b", "warning")]
    assert rows(decided, "package", "decision") == [("b", "excluded"), ("c", "kept")]
    assert rows(text, "requirement") == [("c==3",)]


def test_release_notes(spark, rows):
    df = pins(spark, ("e", "a", "1"), ("f", "a", "1")).withColumn("snapshot", F.lit(1)).unionByName(
        pins(spark, ("e", "a", "2"), ("g", "a", "1")).withColumn("snapshot", F.lit(2))
    )
    envs, changed = release_notes(df, 1, 2)
    assert rows(envs) == [("e", "common"), ("f", "removed"), ("g", "added")]
    assert rows(changed) == [("e", "a", "changed", "1", "2")]


def test_split_by(spark, rows):
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    known = spark.createDataFrame([("a",), ("a",)], "handler string")
    assert rows(split_by(names, known, "name")) == [("a", True), ("a", True), ("b", False)]


def test_version_orders(spark, rows):
    df = spark.createDataFrame([("3.9", "3.9.22"), ("3.9", "3.9.3"), ("3.10", "3.10.1"), ("x", "bad")], "k string, v string")
    assert rows(latest_per_key(df, ["k"], "v")) == [("3.10", "3.10.1"), ("3.9", "3.9.22"), ("x", None)]
    assert [r.v for r in order_by_version(df, "v", "k").collect()] == ["3.10.1", "3.9.22", "3.9.3", "bad"]
    assert [r.v for r in distinct_versions(df.union(df), "v").collect()] == ["3.9.3", "3.9.22", "3.10.1", "bad"]


def test_chain_over_gaps(spark, rows):
    df = spark.createDataFrame(
        [(14, "e", "a", "1"), (16, "e", "a", "2"), (17, "e", "a", "2"), (17, "e", "b", "1"), (90, "f", "a", "9")],
        "snapshot int, env string, package string, raw_version string",
    )
    chain = diff_chain(df, "snapshot", ["env", "package"], "raw_version")
    assert rows(chain, "snapshot", "package", "status") == sorted(
        [(14, "a", "changed"), (16, "b", "only_right"), (17, "a", "only_left"), (17, "b", "only_left"),
         (17, "a", "only_right")], key=repr,
    )
