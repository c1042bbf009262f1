"""SimHash, language model, substrings and archives against plain loops."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from awkward_rows import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depot.llm import kneser, simhash, substrings, warc
from depot.llm.texts import spread, window_hashes


def key(rows):
    return sorted(map(str, rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_window_hashes(values, size):
    got = window_hashes(np.array(values, np.uint64), size).tolist()
    want = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(got) == len(want) and len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))
    marks = np.array([v == 1 for v in values], bool)
    covered = {j for i, m in enumerate(marks) if m for j in range(i, min(i + size, len(values)))}
    assert set(np.flatnonzero(spread(marks, size, len(values))).tolist()) == covered


# ---- SimHash -----------------------------------------------------------------------------


def fingerprint_by_hand(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, radius):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [least.get(find(i)), doc_id]
        least[find(i)] = min((x for x in ids if x is not None), default=None)
    return [(d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(rows)]


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    rows = [(i, fingerprint_by_hand(t, 3)) for i, t in AWKWARD]
    assert key(tuple(r) for r in got) == key(components_by_hand(rows, 3))
    assert simhash.near_duplicates(nothing).isEmpty()


@pytest.mark.parametrize("tile", [4, 4096])
def test_components_of_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in fps[:12]:  # chains of close ones
        for _ in range(12):
            for k in rng.integers(0, 64, rng.integers(1, 4)):
                f ^= 1 << int(k)
            fps.append(f)
    fps += [0, (1 << 64) - 1, (1 << 64) - 2, 7]
    fps = list(dict.fromkeys(fps))
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(5)
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 3)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = defaultdict(set)
    for f in signed:
        groups[found.get(f, f)].add(f)
    want = defaultdict(set)
    for (_, fp), (*_, component) in zip(rows, components_by_hand(rows, 3), strict=True):
        want[component].add(fp - (1 << 64) if fp >> 63 else fp)
    assert key(map(sorted, groups.values())) == key(map(sorted, want.values()))
    assert all(min(g) == r for r, g in groups.items() if len(g) > 1)


def test_dense_group_gives_few_links(spark):
    fps = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.links(df, 4)
    assert links.count() < 20 * len(fps)
    assert simhash.components(links).select("root").distinct().count() == 1


def test_one_of_each(spark, awkward, nothing):
    got = simhash.one_of_each(awkward)
    assert got.columns == awkward.columns
    kept = got.collect()
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(awkward).collect()}
    # ids that several groups have tell nothing of the group, so fingerprints count
    prints = [f"{simhash.fingerprint((r.text or '').encode().lower().split(), 3):016x}" for r in kept]
    assert len(set(prints)) == len(prints)
    assert len(kept) == len({f if c is None else (c, f) for (_, f), c in groups.items()})
    assert all(r["a.b"] == "x" and r.row == "x" for r in kept)
    assert simhash.one_of_each(nothing).isEmpty()


def test_one_of_each_keeps_one_row_of_a_group(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 400)) for _ in range(40)]
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    rows += [(7, texts[0])] * 30 + [(None, texts[1]), (None, "only without id"), (None, "only without id")]
    for k, t in enumerate(texts[:20]):  # one word of 400 changed, more than once in a chain
        words = t.split()
        words[5] = "other"
        rows.append((1000 + k, " ".join(words)))
        words[300] = "another"
        rows.append((50 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = [simhash.fingerprint((t or "").encode().lower().split(), 3) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):  # by all pairs
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        want[g] = min(want.get(g, math.inf), math.inf if doc_id is None else doc_id)
    got = [math.inf if r.doc_id is None else r.doc_id for r in simhash.one_of_each(df).collect()]
    assert sorted(got) == sorted(want.values()) and len(want) < 60


# ---- language model ----------------------------------------------------------------------


def scores_by_hand(rows, folds):
    end = b""
    texts = [(i, (t or "").encode().lower().split() + [end]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % folds == 0 for i, _ in texts]
    training = [w for (_, w), h in zip(texts, held, strict=True) if not h]
    c = Counter(x for w in training for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in training for p in zip([end, *w[:-1]], w, strict=True))
    total, kinds, second = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a][min(k, 3)] += 1
        second[b] += 1

    def discounts(counts):
        found = Counter(counts)
        return dict(zip((1, 2, 3), kneser._discounts([found[k] for k in (1, 2, 3, 4)]), strict=True))

    d2, d1 = discounts(pairs.values()), discounts(second.values())
    rest = sum(d1[min(k, 3)] for k in second.values()) if pairs else 1.0

    def low(b):
        return (second[b] - d1.get(min(second[b], 3), 0) + rest / (v + 1)) / max(1, len(pairs))

    def p(a, b):
        if not total[a]:
            return low(b)
        k = pairs[a, b]
        spare = sum(d2[x] * m for x, m in kinds[a].items())
        return (k - d2.get(min(k, 3), 0) + spare * low(b)) / total[a]

    assert not c or abs(sum(p(end, x) for x in c) + p(end, b"\0new") - 1) < 1e-9
    out = []
    for (i, w), h in zip(texts, held, strict=True):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip([end, *w[:-1]], w, strict=True))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_language_scores(spark, awkward, buckets, monkeypatch):
    monkeypatch.setattr(kneser, "CHUNK", 500)
    more = [(100 + i, f"Alpha beta {'gamma delta ' * (i % 4)}word{i % 6} beta") for i in range(80)]
    more += [(500 + i, "same same " * 200) for i in range(2)]  # counts of 255 and more
    df = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in kneser.language_scores(df, 3, buckets).collect()), key=str)
    want = sorted(scores_by_hand(AWKWARD + more, 3), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_language_scores_of_nothing(spark, nothing):
    assert kneser.language_scores(nothing).isEmpty()
    only_held = spark.createDataFrame([(None, "nothing was learnt")], "doc_id long, text string")
    [row] = kneser.language_scores(only_held).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 4, 0, 0)


# ---- substrings --------------------------------------------------------------------------


def kept_by_hand(rows, size):
    first = {}
    texts = [(-(1 << 63) if i is None else i, (t or "").encode().split(), i) for i, t in rows]
    for i, words, _ in texts:
        for s in range(len(words) - size + 1):
            k = tuple(words[s : s + size])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, words, doc_id in texts:
        gone = set()
        for s in range(len(words) - size + 1):
            if first[tuple(words[s : s + size])] < (i, s):
                gone |= set(range(s, s + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        yield doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()


@pytest.mark.parametrize("size, buckets, chunk", [(5, 1, 10), (8, 7, 300), (20, None, 10**6)])
def test_substrings(spark, awkward, monkeypatch, size, buckets, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    shared = [" ".join(f"s{x}" for x in rng.integers(0, 40, 60)) for _ in range(3)]
    rows = []
    for i in range(60):
        own = [f"o{x}" for x in rng.integers(0, 3000, 80)]
        own[rng.integers(0, 80) : 0] = shared[i % 3].split()[rng.integers(0, 20) : rng.integers(30, 60)]
        rows.append((i + 50, " ".join(own)))
    rows += [(200, "one two " * 700), (201, "one two " * 30), (201, "two one " * 30)]
    df = awkward.select("doc_id", "text").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    )
    got = substrings.dedup(df, size, buckets).collect()
    assert key(tuple(r) for r in got) == key(kept_by_hand(AWKWARD + rows, size))


def test_substrings_of_nothing(nothing):
    assert substrings.dedup(nothing).isEmpty()


# ---- archives ----------------------------------------------------------------------------

BODY = "<html>" + "é" * 60 + "</html>"
PAGES = [
    (5, "http://www.Example.com/b?x=1#top", BODY, "20240102030405"),
    (3, "https://example.com/a", BODY, "20240102030405"),
    (9, "https://example.com/a", BODY, "20230102030405"),
    (9, "https://example.com/a", BODY, "20230102030405"),
    (3, "https://example.com/a", BODY, "20240102030406"),
    (None, "http://a.b.c:8080", BODY, None),
    (None, None, "x" * 200, "2024"),
    (11, "not a url\r\nEvil: header", "small", "20240101000000"),
    (12, "http://[bad", "small", "20240101000000"),
    (13, "http://z.org", None, "20240101000000"),
    (14, "http://z.org", "", "20240101000000"),
    (15, "http://z.org/long", "y" * 300_000, "20240101000000"),
]


def captures_by_hand(pages):
    first = {}
    for i, _, html, _ in pages:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html, _ in pages:
        body = (html or "").encode()
        refers = first.get(body) if first.get(body) != i else None
        kind = "response" if refers is None else "revisit"
        yield i, len(body), hashlib.sha256(body).hexdigest(), kind, refers


@pytest.mark.parametrize("fan_in, rows_of_range, block", [(2, 3, 2), (128, 25_000, 512)])
def test_archives(spark, monkeypatch, fan_in, rows_of_range, block):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RANGE_ROWS", rows_of_range)
    monkeypatch.setattr(warc, "BLOCK_ROWS", block)
    more = [(100 + i, f"http://h{i % 3}.org/{i % 7}", f"page {i % 11} " * 20, f"202401{i % 28 + 1:02}") for i in range(90)]
    pages = PAGES + more
    df = spark.createDataFrame(pages, "page_id long, url string, html string, captured string")
    df = df.withColumns({c: F.lit(1) for c in ("digest", "refers_to", "file", "offset")}).repartition(6)
    manifest = warc.write_archives(df)
    index = warc.merged_index(manifest)
    entries = index.orderBy("key_range", "place").collect()
    order = [warc.order((r.url_key, r.captured, r.page_id)) for r in entries]
    assert order == sorted(order) and len(order) == len(pages)
    got = warc.read_captures(index).collect()
    assert key(tuple(r)[:5] for r in got) == key(captures_by_hand(pages))
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)


def test_three_hundred_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 16)
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    pages = [(i, f"http://h{i % 5}.org/{i * 7919 % 300}", f"page {i}", f"2024{i % 12 + 1:02}01") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, captured string")
    # a run for each of 300 parts, over two levels of groups
    pieces = df.repartitionByRange(300, "page_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = warc.write_archives(pieces)
        many = manifest.where("records > 0").count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    entries = warc.merged_index(manifest).orderBy("key_range", "place").collect()
    keys = [warc.order((r.url_key, r.captured, r.page_id)) for r in entries]
    assert many > 16 and keys == sorted(keys) and sorted(r.page_id for r in entries) == list(range(600))


def test_archives_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, captured string")
    assert warc.read_captures(warc.merged_index(warc.write_archives(empty))).isEmpty()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=7))
def test_loser_tree(lists):
    streams = [iter([(f"k{x}", "", x, k) for x in sorted(values)]) for k, values in enumerate(lists)]
    got = [e[2] for e in warc.LoserTree(streams)]
    assert got == sorted(x for values in lists for x in values)


def test_url_keys():
    assert warc.url_key("HTTP://www.Shop.example.com:8080/A?q=1#x") == "com,example,shop:8080)/a?q=1"
    assert warc.url_key("https://example.org") == "org,example)/"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_substrings_of_a_frequent_word_group(spark):
    # 600,000 different windows around one word group with the smallest hash: 32 bits of a
    # digest would take about forty for repeats, and all would meet in one bucket
    rng = np.random.default_rng(10)
    groups = [[f"g{k}_{j}".encode() for j in range(5)] for k in range(2000)]
    least = min(groups, key=lambda g: substrings.window_hashes(substrings.hashes(g), 5)[0])
    texts = []
    for _ in range(40):
        words = rng.integers(0, 1 << 40, (1000, 10))
        texts.append(b" ".join(b" ".join([*[b"u%d" % x for x in w], *least]) for w in words).decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert substrings.dedup(df, 20, 8).where("n_removed > 0").isEmpty()
    blocks = substrings.windows(texts[0].encode().split(), 20)
    assert len(np.unique(substrings.mix(blocks[1] ^ blocks[0]) % np.uint64(8))) == 8
    assert len(np.unique(blocks[0])) < len(blocks[0]) and blocks[1].dtype == np.uint64
