import hashlib
import json
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depot import functions as X
from depot.functions import fixed


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("3", (3, 0, 0, "")),
        ("2.0", (2, 0, 0, "")),
        ("2.0.0", (2, 0, 0, "")),
        ("2.4.1+cu124", (2, 4, 1, "")),
        ("2.6.0.dev20240918", (2, 6, 0, "dev20240918")),
        ("8.9.7.29", (8, 9, 7, "29")),
        ("1.0rc1", (1, 0, 0, "")),
        ("1.2.", (1, 2, 0, "")),
        ("1.2.3.", (1, 2, 3, "")),
        ("1.2.3.a|b", (1, 2, 3, "a|b")),
        ("999999999999999999.1", (999999999999999999, 1, 0, "")),
    ],
)
def test_version_parts(spark, text, parts):
    got = one(spark, X.parse_version("v"), v=text)
    assert (got.major, got.minor, got.patch, got.extra, got.repr) == (*parts, text)
    assert not got.major_long and not got.minor_long and not got.patch_long


def test_versions_of_any_length_order(spark):
    texts = ["9223372036854775806", "9223372036854775807", "9223372036854775808", "10000000000000000000",
             "2.20240101000000000001", "2.20240101000000000002", "2.00000000000000000000003",
             "3.1.123456789012345678901234567890", "3.1.99999999999999999999", "3.2"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r.v for r in df.orderBy(X.parse_version("v")).collect()]
    want = sorted(texts, key=lambda t: [int(p) for p in (t + ".0.0").split(".")[:3]])
    assert got == want
    assert one(spark, X.major_minor(X.parse_version("v")), v=texts[4]) == texts[4]


@pytest.mark.parametrize("text", ["v1.2", "=1.0", "https://x", "", " 1", None])
def test_not_a_version(spark, text):
    assert one(spark, X.parse_version("v"), v=text) is None


def test_version_order(spark):
    texts = ["2.0.0", "3.13", "2.0", "2.6.0.dev20240918", "3.9", "2.6.0", "2.6.1"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r.v for r in df.orderBy(X.parse_version("v")).collect()]
    assert got == ["2.0", "2.0.0", "2.6.0", "2.6.0.dev20240918", "2.6.1", "3.9", "3.13"]


def _normalize(url):
    """The rule written with the standard library."""
    u = urlparse(url)
    h = u.hostname
    if h is None:
        return url
    if h in fixed.PRESIGNED_HOSTS or (".s3." in h and h.endswith(".amazonaws.com")):
        return urljoin(url, u.path)
    return url


URLS = [
    "https://cdn-lfs.hf.co/repos/a/b?Expires=1&Signature=x#frag",
    "https://CDN-LFS.hf.co/repos/a;v=1/b;v=2?x",
    "https://user:pw@cas-bridge.xethub.hf.co:443/a/b?x=/../y",
    "https://bucket.s3.us-east-1.amazonaws.com/k/../z/./w?X-Amz=1",
    "https://bucket.s3.us-east-1.amazonaws.com/k/..",
    "https://bucket.s3.us-east-1.amazonaws.com/../../k",
    "https://bucket.s3.us-east-1.amazonaws.com?x=1",
    "https://bucket.s3.us-east-1.amazonaws.com/",
    "https://bucket.s3.us-east-1.amazonaws.com.evil.org/k?x=1",
    "https://s3.amazonaws.com/k?x=1",
    "https://example.com/a/../b?x=1#y",
    "not a url",
    "file:///a/b",
]


@pytest.mark.parametrize("url", URLS)
def test_normalize_url(spark, url):
    assert one(spark, X.normalize_url("u"), u=url) == _normalize(url)


def test_normalize_url_property(spark):
    segment = st.sampled_from(["a", "b.c", ".", "..", "x;y", "...", "z z"])
    urls = st.builds(
        lambda h, p, q: f"https://{h}/{'/'.join(p)}{q}",
        st.sampled_from(["cdn-lfs.hf.co", "b.s3.eu.amazonaws.com", "h.org:80"]),
        st.lists(segment, max_size=5),
        st.sampled_from(["", "?a=b", "#f", ";p=1?q"]),
    )
    seen = set()

    @settings(max_examples=300, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(urls)
    def gather(u):
        seen.add(u)

    gather()
    df = spark.createDataFrame([(u,) for u in seen], "u string")
    for r in df.select("u", X.normalize_url("u").alias("n")).collect():
        assert r.n == _normalize(r.u), r.u


def test_keys_and_fingerprints(spark):
    url = "https://cdn-lfs.hf.co/a?x=1"
    assert one(spark, X.url_key("u"), u=url) == hashlib.sha256(url.encode()).hexdigest()
    assert one(spark, X.short_key("u"), u=url) == hashlib.sha256(url.encode()).hexdigest()[:8]
    got = one(
        spark,
        X.content_fingerprint("u", F.lit(12), F.lit(None).cast("string"), F.lit("Mon")),
        u=url,
    )
    assert got == hashlib.sha256(b"https://cdn-lfs.hf.co/a|12|None|Mon").hexdigest()


def test_env_keys(spark):
    assert one(spark, X.env_key("p", "t", "c"), p="3.9", t="2.7.1", c="12.4") == "python3.9-torch2.7.1-cu124"
    parsed = one(spark, X.parse_env("e"), e="python3.13-torch2.6.0.dev20241121-cpu")
    assert tuple(parsed) == ("3.13", "2.6.0.dev20241121", "cpu")
    assert one(spark, X.parse_env("e"), e="python3.13") is None
    assert one(spark, X.snapshot_label("s"), s="19") == "g00019"
    assert one(spark, X.snapshot_label("s"), s="1234567") == "g1234567"
    assert one(spark, X.snapshot_id("s"), s="g00019") == 19
    assert one(spark, X.snapshot_id("s"), s="latest") is None
    assert one(spark, X.drop_last_part("c"), c="12.4") == "12"


def test_index_urls(spark):
    stable = one(spark, X.index_args("t", "c", False), t="2.7.1", c="12.4")
    assert stable[1] == "https://download.pytorch.org/whl/cu124" and stable[-1] == "first-index"
    nightly = one(spark, X.index_args("t", "c", True), t="2.6.1.dev20241121", c="cpu")
    assert nightly[1].endswith("/nightly/cpu") and nightly[-1] == "unsafe-first-match"
    assert one(spark, X.index_args("t", "c", True), t=None, c="cpu")[1].endswith("/whl/cpu")


def test_file_version(spark):
    assert one(spark, X.file_version("n", "kit"), n="https://h/kit-0.1.2a1-py3-none.whl") == "0.1.2a1"
    assert one(spark, X.file_version("n", "kit"), n="https://h/other-1-py3.whl") is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("https://h/x", ("url", "tool" + hashlib.sha256(b"https://h/x").hexdigest()[:8], "tool@https://h/x")),
        ("file:///lite.whl", ("url", "lite" + hashlib.sha256(b"file:///lite.whl").hexdigest()[:8], "lite@file:///lite.whl")),
        ("lite", ("alias", "litelatest", None)),
        ("lite==0.1", ("alias_pinned", "lite0.1", None)),
        ("lite>=0.1", ("unsupported", None, None)),
        ("0.9.4", ("plain", "tool0.9.4", "tool==0.9.4")),
    ],
)
def test_classify_spec(spark, text, want):
    assert tuple(one(spark, X.classify_spec("s", "tool", "lite"), s=text)) == want


def test_json_fingerprint(spark):
    doc = {"versions": ["0.1", 'a"b\\'], "default": "0.1", "pythons": ["3.9"]}
    want = hashlib.sha256(json.dumps(doc).encode()).hexdigest()
    column = X.json_fingerprint(
        [
            ("versions", F.array(F.lit("0.1"), F.lit('a"b\\')), True),
            ("default", F.lit("0.1"), False),
            ("pythons", F.array(F.lit("3.9")), True),
        ]
    )
    assert one(spark, column, x="") == want


def test_resolve_alias_and_pinned(spark):
    assert one(spark, X.resolve_alias("s", "lite", F.lit("1.2")), s="lite") == "lite==1.2"
    assert one(spark, X.resolve_alias("s", "lite", F.lit("1.2")), s="0.9") == "0.9"
    for text, ok in [("pip", True), ("a==1", True), ("a @ u", True), ("a>=1", False)]:
        assert one(spark, X.is_pinned("s"), s=text) is ok
