import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from depot.operators.quality import duplicates
from depot.operators.ranking import pick_asset
from depot.sources import (
    cuda_catalog,
    cudnn_catalog,
    lock_rejects,
    markers_of,
    parse_feed,
    parse_lines,
    parse_locks,
    parse_manifest,
    parse_markers,
    parse_snapshots,
    parse_state,
    read_feed,
    read_lines,
    read_locks,
    read_manifest,
    read_markers,
    read_releases,
    read_snapshots,
    split_lines,
)

LOCK = """# This file was generated
--index-url https://index/simple
--extra-index-url https://other

alpha==1.2.3
    # via
    #   beta
beta @ https://host/beta.whl
gamma @ u==3.1
  delta==0.5rc1\t
alpha==1.2.4
"""


def texts(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_lock_lines(spark, rows):
    got = parse_locks(texts(spark, LOCK), ["id"])
    assert rows(got, "package", "raw_version", "version.major") == sorted(
        [
            ("alpha", "1.2.4", 1),
            ("beta", "https://host/beta.whl", None),
            ("gamma @ u", "3.1", 3),
            ("delta", "0.5rc1", 0),
        ],
        key=repr,
    )


def test_line_breaks_and_numbers(spark, rows):
    got = split_lines(texts(spark, "a\r\nb\rc\n\nd e\u0085f"))
    assert rows(got, "line_no", "line") == [
        (0, "a"), (1, "b"), (2, "c"), (3, ""), (4, "d"), (5, "e"), (6, "f"),
    ]


def test_invalid_line_fails_or_is_rejected(spark, rows):
    bad = texts(spark, "a==1\nb>=2\n")
    with pytest.raises(PySparkException, match="invalid requirement: b>=2"):
        parse_locks(bad, ["id"]).select("id").collect()
    assert rows(parse_locks(bad, ["id"], mode="reject"), "package") == [("a",)]
    assert rows(lock_rejects(bad, ["id"])) == [(1, 1, "invalid requirement: b>=2")]


# where a requirement may come from: (text, whether it is a known path once resolved against /stock)
ORIGINS = [
    ("https://files.example.net/w/kit-3.1-cp312.whl", None),
    ("https://user@files.example.net/w/kit.whl", None),
    ("hg+https://code.example.net/a/b@rel-2", None),
    ("svn+ssh://code.example.net/a/b", None),
    ("/stock/kit.tar", "/stock/kit.tar"),
    ("sub/../kit.tar", "/stock/kit.tar"),
    ("./kit.d", "/stock/kit.d"),
    ("/elsewhere/kit.tar", None),
]
# how a line names its package: bare, with extras, in another case, with a marker behind it
NAMED = ["{}", "Kit @ {}", "kit[a,b]@{}", "  KIT_x   @   {}  ", "kit @ {} ; python_version < '3.9'", "kit==1.0 # {}"]


def told(line):
    """By the rules in words: the first == parts the line, else the first @, else it must be a known path."""
    line = line.strip()
    for mark in ("==", "@"):
        if mark in line:
            name, rest = line.split(mark, 1)
            return name.strip(), rest.strip()
    known = dict(ORIGINS).get(line)
    return (known, known) if known else None


def test_requirement_forms(spark):
    lines = [form.format(text) for form in NAMED for text, _ in ORIGINS]
    paths = spark.createDataFrame([("/stock/kit.tar",), ("/stock/kit.d",)], "path string")
    table = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    cut = split_lines(table, "text")
    got = {r.id: r for r in parse_lines(cut, paths, "/stock").collect()}
    assert len(got) == len(lines)
    for k, line in enumerate(lines):
        want = told(line)
        found = (got[k].package, got[k].raw_version)
        assert found == (want or (None, None)), line
        assert (got[k].error is None) == (want is not None)


def test_lines_are_numbered_over_splits(spark, tmp_path, rows):
    texts = {
        "a": "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(3000)),
        "b": "one\r\ntwo\n\nfour",
        "c": "",
        "d": "\n" * 5000,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        got = read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        found = [(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(n, k, line) for n, t in texts.items() for k, line in enumerate(t.replace("\r\n", "\n").split("\n"))]
    want = [w for w in want if not (w[2] == "" and w[1] == texts[w[0]].count("\n"))]
    assert sorted(found) == sorted(want)


def test_long_lock_files_give_the_same_pins(spark, tmp_path, rows):
    for env in ("e", "f"):
        folder = tmp_path / "g00007"
        folder.mkdir(exist_ok=True)
        text = "".join(f"pkg{k % 50}=={k}.{env == 'e':d}\n    # via\n--opt\n" for k in range(600))
        (folder / f"{env}.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        parts = rows(read_locks(spark, str(tmp_path), long_files=True).drop("version"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts == rows(read_locks(spark, str(tmp_path)).drop("version")) and len(parts) == 100


def test_markers_of_a_table_of_files(spark, rows):
    whole, cut = '{"timestamp": "2024-01-01T00:00:00"}', '{"timestamp": "2024-01'
    files = [("/a/.done", whole), ("/a/x", "y"), ("/b/x", whole), ("/c/.done", cut), ("/d/.done", ""), ("/e/.done", None)]
    got = markers_of(spark.createDataFrame(files, "path string, text string"), ".done")
    assert rows(got, "dir", "done") == [(f"/{d}", d == "a") for d in "abcde"]


def test_read_lock_corpus(spark, tmp_path, rows):
    for snapshot, env, text in [
        (1, "python3.9-torch2.7.1-cpu", LOCK),
        (1, "python3.9-torch2.7.1-cu128", "a==1"),
        (2, "python3.9-torch2.7.1-cpu", "a==2\n# end"),
    ]:
        d = tmp_path / f"g{snapshot:05d}"
        d.mkdir(exist_ok=True)
        (d / f"{env}.txt").write_text(text)
    (tmp_path / "README.md").write_text("not a lock file")
    got = read_locks(spark, str(tmp_path))
    assert rows(got.groupBy("snapshot", "env").count()) == [
        (1, "python3.9-torch2.7.1-cpu", 4),
        (1, "python3.9-torch2.7.1-cu128", 1),
        (2, "python3.9-torch2.7.1-cpu", 1),
    ]


def test_snapshots(spark, tmp_path):
    doc = {"id": 3, "cuda": {"12.4": "12.4.1_550"}, "cudnn": {}, "python": {"3.9": "3.9.1"},
           "torch": ["2.7.1"], "pip_pkgs": ["pip"]}
    (tmp_path / "a.json").write_text(json.dumps(doc) + "\n")
    row = read_snapshots(spark, str(tmp_path)).first()
    assert row.id == 3 and row.cuda == {"12.4": "12.4.1_550"} and row.environment is None
    assert parse_snapshots(texts(spark, json.dumps(doc))).first().torch == ["2.7.1"]


def test_catalogs(spark, rows):
    urls = spark.createDataFrame(
        [("https://h/c/cuda_12.8.1_570.124.06_linux.run",), ("https://h/bad.run",)], "url string"
    )
    got = cuda_catalog(urls, mode="report")
    assert rows(got, "valid", "key", "driver_version.minor") == [
        (False, None, None),
        (True, "12.8.1_570.124.06", 124),
    ]
    with pytest.raises(PySparkException, match="invalid file name bad.run"):
        cuda_catalog(urls).collect()
    dnn = spark.createDataFrame(
        [("https://h/cudnn-linux-x86_64-8.9.7.29_cuda12-archive.tar.xz?x=1",)], "url string"
    )
    row = cudnn_catalog(dnn).first()
    assert (row.key, row.cuda_major, row.version.extra) == ("8.9.7.29-cuda12", 12, "29")


def test_markers(spark, tmp_path, rows):
    for name, text in [
        ("ok", '{"timestamp": "2024-01-01T00:00:00+00:00", "attributes": {"kind": "venv", "n": 1}}'),
        ("empty", ""),
        ("broken", '{"timestamp": "2024'),
        ("cut", '{"timestamp": "2024-01-01T00:00:00+00:00", "attributes": {'),
        ("none", '{"attributes": {}}'),
    ]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "done.json").write_text(text)
    got = read_markers(spark, str(tmp_path)).withColumn(
        "dir", F.substring_index("dir", "/", -1)
    )
    assert rows(got, "dir", "done") == [
        ("broken", False), ("cut", False), ("none", False), ("ok", True),
    ]
    assert not parse_markers(texts(spark, "")).first().done


def feed(*urls):
    key = "cache.request.resolved_url"
    return json.dumps({"data": {"results": [{"data": {key: u} if u else {"x": "y"}} for u in urls]}})


def test_feed(spark, tmp_path, rows):
    (tmp_path / "f.json").write_text(feed("u1", None, "u2", "u1"))
    assert rows(read_feed(spark, str(tmp_path)), "rank", "url") == [(0, "u1"), (2, "u2"), (3, "u1")]
    with pytest.raises(PySparkException, match="empty ranked feed"):
        parse_feed(texts(spark, feed())).collect()
    with pytest.raises(PySparkException, match="empty ranked feed"):
        parse_feed(texts(spark, "{}")).collect()


def test_manifest(spark, tmp_path, rows):
    (tmp_path / "m.txt").write_text("https://a x/1\n\n  https://b\tx/2 \n")
    assert rows(read_manifest(spark, str(tmp_path)), "url", "dest") == [
        ("https://a", "x/1"), ("https://b", "x/2"),
    ]
    again = parse_manifest(texts(spark, "a x\nb x\n"), ["id"])
    assert rows(duplicates(again, ["id", "dest"])) == [(1, "x", 2)]
    with pytest.raises(PySparkException, match="invalid manifest line"):
        parse_manifest(texts(spark, "a b c"), ["id"]).select("id").collect()
    (tmp_path / "m.txt").write_text("a x\nb x\n")
    with pytest.raises(PySparkException, match="repeated destination x"):
        read_manifest(spark, str(tmp_path)).collect()


def test_releases_and_asset_pick(spark, tmp_path):
    def assets(*names):
        return [{"name": n, "browser_download_url": f"https://h/{n}"} for n in names]

    doc = {"name": "v1", "assets": assets("a.tar.gz", "a-cp38-abi3-x.whl", "a-cp39-abi3-x.whl")}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rel = read_releases(spark, str(tmp_path))
    wheel = F.col("asset").endswith(".whl") & F.col("asset").contains("-abi3-")
    first = pick_asset(rel, ["release"], "position", ["url"])
    assert first.first().url == "https://h/a.tar.gz"
    assert pick_asset(rel, ["release"], "position", ["url"], wheel).first().url.endswith("a-cp38-abi3-x.whl")
    with pytest.raises(PySparkException, match="no matching asset for v1"):
        pick_asset(rel, ["release"], "position", ["url"], F.col("asset") == "zip").collect()


def test_state_import(spark, rows):
    text = json.dumps({"h1": {"url": "u", "size": 3, "etag": None}, "h2": {"url": "v", "size": 4, "etag": "e"}})
    assert rows(parse_state(texts(spark, text)), "hash", "url", "size", "etag") == [
        ("h1", "u", 3, None), ("h2", "v", 4, "e"),
    ]
