"""Interpolated modified Kneser-Ney bigram model, counted in Spark, mapped into memory by workers.

Counting goes in three rounds, each of them tasks that count their chunk of documents with
numpy and pass blocks of sorted numbers on to buckets, which add them up:

1. words: a bucket holds a range of word hashes, so that the sorted hash arrays of all
   buckets, one after the other, number the words;
2. bigrams of word numbers, to buckets by a mixed hash of the pair: sorted hash arrays with counts;
3. for each word: how often it stands first in a bigram, in how many kinds of bigrams it does
   so once, twice and more often, and in how many kinds it stands second.

Scoring maps the arrays and looks words and bigrams up by binary search, so no worker holds
the model. All counts are of the whole corpus; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.shared import create, local_copy, new_path
from depot.llm.substrings import _from_planes, _planes
from depot.llm.texts import hashes, lower_words, mix, rows
from depot.operators.durable import materialize, run_dir

#: Tokens a task holds before it passes its counts on, and tokens scored together.
CHUNK, SCORED = 1_200_000, 300_000
#: Characters of text for a bucket, at most about: a bucket's counts are held in memory.
BUCKET_CHARS = 16_000_000
#: Words are numbered in so many bits.
NUMBER_BITS = 32
#: Hash of the end of a text, which no word has for its own: the empty string is no word.
END = xxhash.xxh64_intdigest(b"")
#: Additive smoothing of the base score.
ALPHA = 0.1
#: Bigram counts from here on are kept beside the array of small counts.
MANY = 255
_STATS = [("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("second", "<u4")]


def _sequences(batches, most: int) -> Iterator[np.ndarray]:
    """Word hashes of whole texts, an end before, between and after them, a chunk at a time."""
    held, n = [np.array([END], np.uint64)], 0
    end = held[0]
    for (texts,) in rows(batches, "text"):
        for text in texts:
            held += [hashes(lower_words(text)), end]
            n += len(held[-2]) + 1
        if n >= most:
            yield np.concatenate(held)
            held, n = [end], 0
    if n:
        yield np.concatenate(held)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _block(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(map(_planes, columns))


def _unblock(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(_from_planes(raw[at : at + size], kind))
        at += size
    return out


def _deal(bucket: np.ndarray, n: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks of the columns, one row for each bucket that has something; order is kept."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(n + 1))
    some = np.flatnonzero(np.diff(cuts)).tolist()
    raw = [_block([c[by[cuts[b] : cuts[b + 1]]] for c in columns]) for b in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(raw, pa.binary())], names=["bucket", "block"]
    )


def _gathered(batches, kinds: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """All blocks of one bucket after the other, joined."""
    current, held = None, []
    for numbers, blocks in rows(batches, "bucket", "block"):
        for b, raw in zip(numbers, blocks, strict=True):
            if b != current and held:
                yield current, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            current = b
            held.append(_unblock(raw, kinds))
    if held:
        yield current, [np.concatenate(c) for c in zip(*held, strict=True)]


def _in_buckets(dealt: DataFrame, buckets: int) -> DataFrame:
    picked = dealt.select("bucket", "block")
    return picked.repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket")


def _word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal ranges of hashes: their order is that of the hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Parts:
    """Sorted arrays in files, one for each bucket, mapped when they are needed."""

    def __init__(self, paths: dict[int, str], kinds: list[str], sizes: dict[int, int]):
        self.paths, self.kinds, self.sizes, self.open = paths, kinds, sizes, {}

    def __getitem__(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self.open:
            n, at, out = self.sizes.get(bucket, 0), 0, []
            for kind in self.kinds:
                if n:
                    out.append(np.memmap(local_copy(self.paths[bucket]), kind, "r", at, (n,)))
                else:
                    out.append(np.empty(0, kind))
                at += n * np.dtype(kind).itemsize
            self.open[bucket] = out
        return self.open[bucket]


class Vocabulary:
    """Numbers of words, from 0 on in the order of their hashes; `size` for words not known."""

    def __init__(self, files: list[tuple], buckets: int):
        sizes = {b: n for b, _, n in files}
        self.parts = Parts({b: p for b, p, _ in files}, ["<u8", "<u8"], sizes)
        self.buckets = buckets
        counts = [sizes.get(b, 0) for b in range(buckets)]
        self.base = np.concatenate([[0], np.cumsum(counts)])
        self.size = int(self.base[-1])

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each of these sorted hashes."""
        number = np.full(len(h), self.size, np.int64)
        count = np.zeros(len(h), np.int64)
        bucket = _word_bucket(h, self.buckets)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            known, times = self.parts[b]
            if not len(known):
                continue
            part = h[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = known[at] == part
            where = np.flatnonzero(hit) + cuts[b]
            number[where] = at[hit] + self.base[b]
            count[where] = times[at[hit]]
        return number, count

    def numbers(self, h: np.ndarray) -> np.ndarray:
        words, back = np.unique(h, return_inverse=True)
        return self.look_up(words)[0][back]


def _write(path: str, columns: list[np.ndarray]) -> None:
    with create(path) as out:
        for c in columns:
            out.write(np.ascontiguousarray(c).tobytes())


def _count_words(docs: DataFrame, buckets: int, folder: str) -> list[tuple]:
    """(bucket, file, words, tokens) of the sorted hash arrays with counts."""

    def count(batches):
        for sequence in _sequences(batches, CHUNK):
            words, counts = np.unique(sequence[1:], return_counts=True)
            yield _deal(_word_bucket(words, buckets), buckets, [words, counts.astype("<u4")])

    dealt = materialize(docs.mapInArrow(count, "bucket int, block binary"), "word-counts")

    def add(batches):
        for b, (words, counts) in _gathered(batches, ["<u8", "<u4"]):
            words, counts = _add_up(words, counts.astype(np.uint64))
            path = new_path(folder, f"words-{b:06d}")
            _write(path, [words, counts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([path]), pa.array([len(words)]), pa.array([int(counts.sum())])],
                names=["bucket", "path", "n", "tokens"],
            )

    done = _in_buckets(dealt, buckets).mapInArrow(add, "bucket int, path string, n long, tokens long")
    return [tuple(r) for r in materialize(done, "words").orderBy("bucket").collect()]


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more from how many things were counted 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2 or not n3:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True)]


def _how_often(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, buckets: int) -> dict:
    """Counts the texts and writes the model's files; returns what finds them, a few numbers a bucket."""
    spark = docs.sparkSession
    folder = run_dir(spark, "kneser-ney")
    texts = docs.select("text")
    words = _count_words(texts, buckets, folder)
    files = [w[:3] for w in words]
    size = sum(w[2] for w in words)
    if size >= 1 << NUMBER_BITS:
        raise ValueError(f"{size} different words are more than {NUMBER_BITS} bits number")

    def pairs(batches):
        vocabulary = Vocabulary(files, buckets)
        for sequence in _sequences(batches, CHUNK):
            number = vocabulary.numbers(sequence).astype(np.uint64)
            keys, counts = np.unique((number[:-1] << np.uint64(32)) | number[1:], return_counts=True)
            yield _deal(_word_bucket(mix(keys), buckets), buckets, [keys, counts.astype("<u4")])

    dealt = materialize(texts.mapInArrow(pairs, "bucket int, block binary"), "pair-counts")
    kinds = [k for _, k in _STATS]

    def add(batches):
        names = ["bucket", "block", "own", "path", "n", "many", "seen"]
        types = [pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for b, (keys, counts) in _gathered(batches, ["<u8", "<u4"]):
            keys, counts = _add_up(keys, counts.astype(np.int64))
            mixed = mix(keys)
            order = np.argsort(mixed)
            many = np.flatnonzero(counts[order] >= MANY)
            path = new_path(folder, f"pairs-{b:06d}")
            small = np.minimum(counts[order], MANY).astype(np.uint8)
            _write(path, [mixed[order], many.astype("<u8"), counts[order][many].astype("<u8"), small])
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ids = np.union1d(first, second)
            at, at2 = np.searchsorted(ids, first), np.searchsorted(ids, second)
            n = len(ids)
            stats = [
                np.bincount(at, counts, n), np.bincount(at, counts == 1, n), np.bincount(at, counts == 2, n),
                np.bincount(at, counts >= 3, n), np.bincount(at2, minlength=n),
            ]
            columns = [ids.astype("<u4"), *[s.astype(k) for s, k in zip(stats, kinds, strict=True)]]
            out = _deal(ids * buckets // max(size, 1), buckets, columns)
            empty = [pa.nulls(out.num_rows, t) for t in types[2:]]
            yield pa.RecordBatch.from_arrays([*out.columns, *empty], names=names)
            own = [None, None, b, path, len(keys), len(many), _how_often(counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(own, types, strict=True)], names=names
            )

    added = materialize(
        _in_buckets(dealt, buckets).mapInArrow(
            add,
            "bucket int, block binary, own int, path string, n long, many long, seen array<long>",
        ),
        "pairs",
    )
    pair_files = added.where("own IS NOT NULL").select("own", "path", "n", "many", "seen").collect()

    def gather(batches):
        for b, (ids, *stats) in _gathered(batches, ["<u4", *kinds]):
            low, high = -(-b * size // buckets), -(-(b + 1) * size // buckets)
            table = np.zeros(high - low, _STATS)
            at = ids.astype(np.int64) - low
            for (name, kind), values in zip(_STATS, stats, strict=True):
                table[name] = np.bincount(at, values, high - low).astype(kind)
            path = new_path(folder, f"stats-{b:06d}")
            _write(path, [table])
            seen = _how_often(table["second"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int32()), pa.array([path]), pa.array([high - low]),
                    pa.array([seen], pa.list_(pa.int64())), pa.array([int(table["second"].sum())]),
                    pa.array([int((table["second"] >= 3).sum())]),
                ],
                names=["bucket", "path", "n", "seen", "second", "second3"],
            )

    stats_files = materialize(
        _in_buckets(added.where("bucket IS NOT NULL"), buckets).mapInArrow(
            gather, "bucket int, path string, n long, seen array<long>, second long, second3 long"
        ),
        "word-stats",
    ).collect()

    def total(found, width=4):
        return [sum(f[k] for f in found) for k in range(width)]

    seen2 = total([f.seen for f in stats_files])
    return {
        "buckets": buckets,
        "words": files,
        "tokens": sum(w[3] for w in words),
        "pairs": [(f.own, f.path, f.n, f.many) for f in pair_files],
        "stats": [(f.bucket, f.path, f.n) for f in stats_files],
        "pair_discounts": _discounts(total([f.seen for f in pair_files])),
        "word_discounts": _discounts(seen2),
        "pair_kinds": sum(f.second for f in stats_files),
        "word_kinds": [*seen2[:2], sum(f.second3 for f in stats_files)],
    }


class Model:
    """The model's files, mapped, and the probabilities they give."""

    def __init__(self, about: dict):
        self.about, self.buckets = about, about["buckets"]
        self.vocabulary = Vocabulary(about["words"], self.buckets)
        self.size = self.vocabulary.size
        self.pairs = {b: (p, n, many) for b, p, n, many in about["pairs"]}
        self.open: dict[int, tuple] = {}
        self.stats = Parts(
            {b: p for b, p, _ in about["stats"]}, [np.dtype(_STATS)], {b: n for b, _, n in about["stats"]}
        )

    def _pairs(self, b: int) -> tuple | None:
        if b not in self.open:
            if b not in self.pairs:
                return None
            path, n, many = self.pairs[b]
            path = local_copy(path)
            keys = np.memmap(path, "<u8", "r", 0, (n,))
            where, counts = np.fromfile(path, "<u8", 2 * many, offset=8 * n).reshape(2, many)
            small = np.memmap(path, "u1", "r", 8 * n + 16 * many, (n,))
            self.open[b] = keys, small, where, counts
        return self.open[b]

    def pair_counts(self, mixed: np.ndarray) -> np.ndarray:
        """Counts of bigrams by their sorted mixed hashes."""
        out = np.zeros(len(mixed), np.int64)
        cuts = np.searchsorted(_word_bucket(mixed, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            found = self._pairs(b)
            if found is None:
                continue
            keys, small, where, counts = found
            part = mixed[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            count = np.where(hit, small[at], 0).astype(np.int64)
            big = np.flatnonzero(hit & (count == MANY))
            count[big] = counts[np.searchsorted(where, at[big])]
            out[cuts[b] : cuts[b + 1]] = count
        return out

    def word_stats(self, number: np.ndarray) -> np.ndarray:
        """Rows of _STATS for sorted word numbers; zeros for the number of unknown words."""
        out = np.zeros(len(number), _STATS)
        bucket = np.where(number < self.size, number * self.buckets // max(self.size, 1), self.buckets)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            low = -(-b * self.size // self.buckets)
            out[cuts[b] : cuts[b + 1]] = self.stats[b][0][number[cuts[b] : cuts[b + 1]] - low]
        return out

    def log10(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of every token after the first."""
        words, back = np.unique(sequence, return_inverse=True)
        number, count = self.vocabulary.look_up(words)
        order = np.argsort(number, kind="stable")
        stats = np.zeros(len(words), _STATS)
        stats[order] = self.word_stats(number[order])
        d, kinds = self.about["word_discounts"], self.about["pair_kinds"]
        second = stats["second"].astype(float)
        rest = sum(x * n for x, n in zip(d, self.about["word_kinds"], strict=True)) if kinds else 1.0
        cut = np.choose(np.minimum(second, 3).astype(int), [0.0, *d])
        low = ((second - cut) + rest / (self.size + 1)) / max(kinds, 1)
        d = self.about["pair_discounts"]
        total = stats["total"].astype(float)
        spare = d[0] * stats["n1"] + d[1] * stats["n2"] + d[2] * stats["n3"]
        a, b = back[:-1], back[1:]
        known = np.flatnonzero((number[a] < self.size) & (number[b] < self.size))
        key = (number[a[known]].astype(np.uint64) << np.uint64(32)) | number[b[known]].astype(np.uint64)
        mixed, place = np.unique(mix(key), return_inverse=True)
        times = np.zeros(len(a))
        times[known] = self.pair_counts(mixed)[place]
        cut = np.choose(np.minimum(times, 3).astype(int), [0.0, *d])
        seen = total[a] > 0  # a word that stood before another one
        before = np.where(seen, total[a], 1)
        p = np.where(seen, (times - cut + spare[a] * low[b]) / before, low[b])
        return np.log10(p), count[b]


def score(docs: DataFrame, about: dict) -> DataFrame:
    """All rows: doc_id, n_tokens, n_known, base_score, score."""
    held = docs.sparkSession.sparkContext.broadcast(about)

    def run(batches):
        model = Model(held.value)
        tokens = held.value["tokens"]
        norm = tokens + ALPHA * (model.size + 1)
        waiting: list[tuple] = []
        n = 0

        def settle():
            lengths = np.array([len(h) + 1 for _, h in waiting])
            end = np.array([END], np.uint64)
            sequence = np.concatenate([end, *[x for _, h in waiting for x in (h, end)]])
            logs, counts = model.log10(sequence)
            first = np.cumsum(lengths) - lengths
            base = np.log10((counts + ALPHA) / norm)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in waiting], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), first), pa.int64()),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(logs, first)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

        for ids, texts in rows(batches, "doc_id", "text"):
            for doc_id, text in zip(ids, texts, strict=True):
                waiting.append((doc_id, hashes(lower_words(text))))
                n += len(waiting[-1][1]) + 1
            if n >= SCORED:
                yield settle()
                waiting, n = [], 0
        if waiting:
            yield settle()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def language_scores(docs: DataFrame, folds: int = 10, buckets: int | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id is divisible by `folds`, and those without id, are held
    out; the model learns from all others. Null texts have the end as their only token. With
    nothing to learn from, all words are unknown.
    """
    if buckets is None:
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(8, least, -(-chars // BUCKET_CHARS))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))
    about = train(docs.where(~held_out), buckets)
    return score(docs, about).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(about["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
