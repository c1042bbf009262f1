"""Range join, reversed search and hard negatives against plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F

from depot.llm import hardneg, rangejoin, search

SCHEMA = "vec_id long, embedding array<float>, label int, copies string, cell string, `a.b` string"


def frame(spark, rows, parts=3):
    full = [(i, v, label, "x", "y", "z") for i, v, label in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def clustered(seed=1, n=260, width=12):
    """Strangers, groups of copies and near copies at many distances, and what cannot link."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=width).tolist(), int(i % 4)) for i in range(n)]
    for group in range(6):
        centre = rng.normal(size=width)
        for k in range(25):
            off = rng.normal(size=width) * rng.uniform(0, 0.45)
            rows.append((n + 25 * group + k, (3.0 ** (k % 3) * (centre + off)).tolist(), k % 4))
    hot = rng.normal(size=width).tolist()
    rows += [(1000 + k, hot, 1) for k in range(60)] + [(1000, hot, 1), (None, hot, 2)]
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.0, -0.0] * 6, 1), (2003, [1.0] * 11 + [None], 1),
        (2004, [math.nan] * 12, 1), (2005, [math.inf] + [0.0] * 11, 1), (2006, [1.0, 2.0], None),
        (2007, [2.0, 4.0], 3), (2008, [-2.0, 4.0], 3), (2009, [1e30] * 12, None), (2010, [3e38] * 12, None),
        (None, None, None), (-7, [1.0, 2.0, 0.0], 0), (2011, [0.0] * 11 + [1.0], 5), (2012, [-0.0] * 11 + [2.0], 5),
    ]
    return rows


def linked(rows, least):
    """n_links and component by comparing all with all."""
    units = []
    for _, v, _ in rows:
        x = None if not v or any(c is None for c in v) else np.array(np.array(v, np.float32), np.float64)
        if x is None or not np.isfinite(x).all() or not x.any():
            units.append(None)
        else:
            x = x / np.abs(x).max()
            units.append(x / math.sqrt((x * x).sum()))
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = units[i], units[j]
            near[i, j] = i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= least
    seen, out = {}, []
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        seen.update(dict.fromkeys(group, low))
    for i, (vec_id, _, _) in enumerate(rows):
        out.append((vec_id, int(near[i].sum()), seen[i], vec_id is not None and vec_id == seen[i]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cell", "tile", "visitors"), [(2048, 4096, 65536), (20, 7, 90), (3, 2, 1000)])
def test_vectors_link_as_all_pairs_say(spark, rows, monkeypatch, cell, tile, visitors):
    for name, value in (("CELL", cell), ("TILE", tile), ("VISITORS", visitors)):
        monkeypatch.setattr(rangejoin, name, value)
    given = clustered()
    got = rangejoin.near_vectors(frame(spark, given))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(got) == linked(given, 0.9)


def test_vectors_near_the_threshold_are_decided_in_double_precision(spark, rows):
    width, given = 8, []
    for k, angle in enumerate(np.linspace(-3e-7, 3e-7, 42)):
        base = np.zeros(width)
        base[0] = 1
        other = np.zeros(width)
        other[0], other[1] = math.cos(math.acos(0.9) + angle), math.sin(math.acos(0.9) + angle)
        given += [(2 * k, base.tolist(), 0), (2 * k + 1, other.tolist(), 0)]
    df = spark.createDataFrame([(i, v) for i, v, _ in given], "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in rows(rangejoin.near_vectors(df))}
    vectors = np.array([v for _, v, _ in given])
    vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
    cosine = np.einsum("ik,jk->ij", vectors, vectors)
    sure = np.abs(cosine - 0.9).min(1) > 1e-14
    want = (cosine >= 0.9).sum(1) - 1
    assert sure.sum() > 60
    assert all(got[k] == want[k] for k in np.flatnonzero(sure).tolist())


def test_no_vectors(spark):
    assert rangejoin.near_vectors(frame(spark, []).limit(0)).isEmpty()
    only = [(1, None, 1), (2, [0.0], 1)]
    got = rangejoin.near_vectors(frame(spark, only))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- reversed search ---------------------------------------------------------------------

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return _TERM.findall((text or "").translate(_LOWER))


def ranked(docs, items, k):
    """The contract's formula, document by document."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted: dict = {}
    for item_id, text in dict.fromkeys(items):
        wanted.setdefault(item_id, Counter()).update(split(text))
    out = []
    for item_id, asked in wanted.items():
        scored = []
        for doc_id, c, n in counts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for t, times in asked.items():
                if tf := c.get(t, 0):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


ITEMS = [
    (1, "The quick FOX, the lazy dog"), (1, "word5 of line7"), (1, "word5 of line7"), (2, ""), (3, None),
    (None, "text without upper"), (4, "日本語 ü é"), (5, "nothing here that occurs zzz"), (6, "id " * 50),
]


@pytest.mark.parametrize("limits", [(400_000, 20_000), (8, 2)])
def test_search_ranks_as_the_formula_says(spark, rows, awkward, monkeypatch, limits):
    monkeypatch.setattr(search, "POSTINGS", limits[0])
    monkeypatch.setattr(search, "ITEMS", limits[1])
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"no": F.lit(1), "term": F.lit("x")})
    got = search.search(awkward, items, k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == ranked(AWKWARD, ITEMS, 4)


def test_search_of_many_documents_with_ties(spark, rows):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(900)]
    docs += [(5000 + k, "w1 w2 w3") for k in range(300)]  # a third of equal score
    items = [(k, " ".join(rng.choice(vocabulary, 5))) for k in range(30)] + [(99, "w1 w2 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = search.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == ranked(docs, items, 20)


def test_search_of_nothing(spark, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(nothing, items).isEmpty()
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.search(docs, items.limit(0)).isEmpty()
    assert search.search(docs, items.where("item_id = 3")).isEmpty()


# ---- hard negatives ----------------------------------------------------------------------


def mined(given, every=50, positives=5, negatives=3):
    ready = []
    for vec_id, v, label in given:
        if vec_id is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        whole = [math.floor(256 * float(np.float32(c))) for c in v]
        ready.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for anchor, mine, a in ready:
        if anchor % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b, strict=False)), i, label) for i, label, b in ready if i != anchor
        )
        for s, positive, _ in [t for t in scored if t[2] == mine][:positives]:
            fits = [t for t in scored if t[2] != mine and -50 * s <= -100 * t[0] <= -95 * s][:negatives]
            for rank, (score, negative, _) in enumerate(fits, 1):
                out.append((anchor, positive, rank, negative, -s, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2048, 3])
def test_negatives_are_those_of_exact_integers(spark, rows, monkeypatch, block):
    monkeypatch.setattr(hardneg, "ANCHORS", block)
    given = [r for r in clustered(3) if not (r[1] and any(c and abs(c) > 1e6 for c in r[1] if c is not None))]
    got = hardneg.hard_negatives(frame(spark, given), every=10)
    assert got.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    want = mined(given, every=10)
    assert len(want) > 100
    assert rows(got) == want


def test_negatives_of_large_components_and_long_vectors(spark, rows):
    rng = np.random.default_rng(2)
    given = [(5 * i, (rng.normal(size=5000) * 900).round().tolist(), int(i % 2)) for i in range(30)]
    assert rows(hardneg.hard_negatives(frame(spark, given))) == mined(given)


def test_scores_are_exact_up_to_the_range():
    rng = np.random.default_rng(7)
    for most, width in ((1, 1), (70_000, 64), (1 << 40, 4096), ((1 << 52) - 1, 9000)):
        side = math.isqrt(most // width) or 1
        a, b = (rng.integers(-side, side + 1, (5, width)) for _ in range(2))
        a[0], b[0], b[1] = side, side, -side
        primes = hardneg.primes_for(most, width)
        assert math.prod(primes) > 2 * most and math.prod(primes) < 1 << 62
        assert len(set(primes)) == len(primes)
        got = hardneg.Residues(a, primes).scores(hardneg.Residues(b, primes))
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_no_negatives(spark):
    assert hardneg.hard_negatives(frame(spark, []).limit(0)).isEmpty()
    assert hardneg.hard_negatives(frame(spark, [(50, [1.0], 1)])).isEmpty()
    assert hardneg.hard_negatives(frame(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).count() == 1
    with pytest.raises(ValueError, match="too large"):
        hardneg.hard_negatives(frame(spark, [(50, [1e30], 1), (51, [1.0], 1)]))
