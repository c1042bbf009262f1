"""Token files and packing against the tokenizers library and plain loops."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depot.llm.packing import Slots, pack, plan
from depot.llm.texts import WordTokenizer
from depot.llm.tokens import EliasFano, Shard, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The of and THE, of. the!! don't it's",
    None,
    "",
    "Être où ça? ¿Qué niño? Straße a² ½x ª µ",
    "日本語 text İstanbul ΣΑΣ ́a",
    "a\x1cb c\x85d\xa0e f <|endoftext|> <|ENDOFTEXT|> \x00\x7f",
    "word " * 3000,
    "12.5% #x# $$ *** <b> 3.14 'll 've",
    "The of and THE, of. the!! don't it's",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [
        e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ]


def test_tokenizer_equals_library(library):
    odd = [f"{chr(c)}b{chr(c)} {chr(c)}" for c in [*range(1, 400), 0x2028, 0x3000, 0x1F600]]
    texts = TEXTS + odd
    got = [a.tolist() for a in WordTokenizer(PATH).encode(texts)]
    assert got == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_tokenizer_equals_library_on_any_text(library, texts):
    assert [a.tolist() for a in WordTokenizer(PATH).encode(texts)] == library(texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.data())
def test_elias_fano(steps, data):
    values = np.cumsum(np.array(steps, np.int64))
    found = EliasFano.of(values)
    found = EliasFano(found.n, found.width, *found.parts())
    assert found.slice(0, len(values)).tolist() == values.tolist()
    if len(values):
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert found[i] == values[i]
        assert found.slice(i, j).tolist() == values[i:j].tolist()
        bits = 8 * sum(map(len, found.parts()[:2]))
        assert bits <= len(values) * (3 + max(0, np.log2(max(1, values[-1] / len(values))))) + 80


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("start", "length", "_rank", "part", "shard", "path")})


def test_token_files(spark, docs, library):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    manifest = write_tokens(docs, PATH, 2)
    got = sorted(
        (tuple(r) for r in read_tokens(manifest).collect()), key=lambda r: (r[1], r[2])
    )
    ids = {t: np.array([*i, 2], "<u4") for t, i in zip(TEXTS, library(TEXTS), strict=True)}
    ids |= {t: np.array([*library([t])[0], 2], "<u4") for t in ("null id", "same id")}
    assert [r[0] for r in got] == [r[0] for r in rows]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    want = sorted((r[0] is not None, r[0] or 0, len(ids[r[1]]), zlib.crc32(ids[r[1]])) for r in rows)
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == want
    for file in manifest.collect():
        shard = Shard(file.path)
        for i, doc_id in enumerate(shard.doc_ids(0, shard.n_docs)):
            assert any(r[0] == doc_id and r[2] == len(shard.document(i)) for r in got)


def test_token_files_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = read_tokens(write_tokens(empty, PATH, 2))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.isEmpty()


def test_pack(docs, library):
    size = 64
    got = [r.asDict() for r in pack(docs, PATH, 0, size).collect()]
    want = []
    for row in docs.collect():
        ids = np.array([*library([row.text])[0], 0], "<u4")
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want.append((row.doc_id, k // size, k, len(part), zlib.crc32(part)))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist()
        assert sum(p[1] for p in parts) <= size
    assert len(sequences) <= -(-sum(w[3] for w in want) // size) + 1


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=40))
def test_plan_uses_every_piece_once(counts):
    size = 60
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    planned = plan(histogram, size)
    used = np.zeros(size + 1, np.int64)
    for members, times in planned:
        assert sum(members) <= size and times > 0
        np.add.at(used, members, times)
    assert used.tolist() == histogram.tolist()
    slots = Slots(planned)
    places = set()
    for length, n in counts.items():
        at, offset = slots.of(np.full(n, length), np.arange(n))
        places |= set(zip(at.tolist(), offset.tolist(), strict=True))
    assert len(places) == sum(counts.values())
    assert slots.sequences == len({p[0] for p in places})


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 200_000).astype(int), 1, 2048)
    planned = plan(np.bincount(lengths, minlength=2049), 2048)
    assert sum(t for _, t in planned) <= 1.002 * lengths.sum() / 2048
    fitted = sum(t for m, t in planned if sum(m) == 2048)
    assert fitted > 0.9 * sum(t for _, t in planned)
