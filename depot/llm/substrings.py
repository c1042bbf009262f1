"""Substring dedup by seed and extend.

Every window of `size` words has an anchor, its winnowed word group: the one with the
smallest hash. With as many of the words next to it as any window has on one side at least,
it makes a seed; a frequent word group is many seeds. Seeds that occur once in all documents
cannot lie in a repeat, so a first pass over the texts only counts seeds, of which there are
a quarter as many as windows, and stores the repeated ones as sorted arrays in the shared
folder.

A second pass extends what lies around a repeated seed both ways to all windows that hold
it, and joins these on the seed and a 64-bit digest of what it was extended to. Those that
agree are repeats, and neighbouring ones merge into maximal ones. They are dealt by seed and
digest, so that even one seed within very many different surroundings does not meet in one
task.

Tasks first settle what repeats within their own chunk of documents; of these only the first
occurrence goes on. So a passage that a third of all documents share puts one occurrence a
chunk into a bucket, not one a document, and no pairs of documents are ever made.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.shared import create, local_copy, new_path
from depot.llm.texts import hashes, mix, rows, space_words, window_hashes
from depot.operators.durable import materialize, run_dir

#: Words of an anchor.
ANCHOR = 5
#: Windows a task holds before it passes on what it has.
CHUNK = 800_000
#: Characters of text for a bucket, at most about: a bucket is held in memory.
BUCKET_CHARS = 16_000_000
#: Stands for a null id, which is before all others.
NULL_ID = -(1 << 63)

#: Characters of text for a bucket of seeds, at most about.
SEED_CHARS = 64_000_000
#: A document with its number of windows in a bucket, and a window: 32 bits of its seed tell
#: windows apart beside the 64 of its digest.
_DOCUMENT = [("id", "<i8"), ("tie", "<i4"), ("count", "<u4")]
_WINDOW = [("start", "<u4"), ("seed", "<u4"), ("digest", "<u8")]


def sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of every `width` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = f(values[:-step], values[step:])
        have += step
    return values


def seeds(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed of every window of words with these hashes, and where its words begin.

    The seed is a hash of the anchor and the words beside it, on the side that has more.
    """
    n = len(h) - size + 1
    grams = window_hashes(h, ANCHOR)
    room = size - ANCHOR
    least = sliding(np.minimum, grams, room + 1)
    at = np.full(n, -1)  # words before the anchor; of equal groups the first counts
    for k in range(room, -1, -1):
        at[grams[k : k + n] == least] = k
    beside = (room + 1) // 2
    around = window_hashes(h, ANCHOR + beside)
    right = at <= room - beside
    place = np.arange(n) + at - np.where(right, 0, beside)
    return mix(around[place] ^ right.astype(np.uint64)), place


def windows(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed and digest of every window of a text."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = hashes(words)
    return seeds(h, size)[0], window_hashes(h, size)


def _occurrences(words: list[bytes], size: int) -> np.ndarray:
    """Seeds of a text, once for the neighbouring windows that hold the same one."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    seed, place = seeds(hashes(words), size)
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (place[1:] != place[:-1])
    return seed[new]


#: Bits of a seed that are counted; equal ones of different seeds only let more windows through.
_COUNTED = np.uint64(24)


def repeated_seeds(docs: DataFrame, size: int, buckets: int) -> list[str]:
    """Paths by bucket (empty: none) of the sorted seeds, cut to 40 bits, that occur more than once."""
    folder = run_dir(docs.sparkSession, "seeds")

    def count(batches):
        held: list[np.ndarray] = []
        n = 0

        def settle():
            found, many = np.unique(np.concatenate(held) >> _COUNTED, return_counts=True)
            bucket = (mix(found) % np.uint64(buckets)).astype(np.int64)
            out = []
            for twice in (False, True):
                some = (many > 1) == twice
                part, of = found[some], bucket[some]
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    out.append((b, twice, _planes(part[order[cuts[b] : cuts[b + 1]]])))
            kinds = (pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["bucket", "twice", "seeds"]
            )

        for (texts,) in rows(batches, "text"):
            for text in texts:
                held.append(_occurrences(space_words(text), size))
                n += len(held[-1])
            if n >= CHUNK:
                yield settle()
                held.clear()
                n = 0
        if n:
            yield settle()

    def store(batches):
        current, held = None, []

        def settle():
            found, many = np.unique(np.concatenate(held), return_counts=True)
            found = found[many > 1]
            path = new_path(folder, f"bucket-{current}")
            with create(path) as file:
                file.write(found.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([path])], names=["bucket", "path"])

        for numbers, flags, blocks in rows(batches, "bucket", "twice", "seeds"):
            for b, twice, raw in zip(numbers, flags, blocks, strict=True):
                if b != current and held:
                    yield settle()
                    held.clear()
                current = b
                some = _from_planes(raw, "<u8")
                held += [some, some] if twice else [some]
        if held:
            yield settle()

    counted = docs.select("text").mapInArrow(count, "bucket int, twice boolean, seeds binary")
    dealt = counted.repartition("bucket").sortWithinPartitions("bucket")
    paths = [""] * buckets
    # one row a bucket; only files of tasks that ended are read
    for r in dealt.mapInArrow(store, "bucket int, path string").collect():
        paths[r["bucket"]] = r["path"]
    return paths


class _Seeds:
    """The repeated seeds, mapped from the shared folder as they are looked up."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.held: dict[int, np.ndarray] = {}

    def _bucket(self, b: int) -> np.ndarray:
        if b not in self.held:
            path = local_copy(self.paths[b]) if self.paths[b] else ""
            some = path and os.path.getsize(path)
            self.held[b] = np.memmap(path, "<u8", "r") if some else np.empty(0, np.uint64)
        return self.held[b]

    def holds(self, seed: np.ndarray) -> np.ndarray:
        """Which of these seeds are repeated."""
        found, back = np.unique(seed >> _COUNTED, return_inverse=True)
        bucket = (mix(found) % np.uint64(len(self.paths))).astype(np.int64)
        out = np.zeros(len(found), bool)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(len(self.paths) + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine, known = order[cuts[b] : cuts[b + 1]], self._bucket(b)
            if len(known):
                place = np.minimum(np.searchsorted(known, found[mine]), len(known) - 1)
                out[mine] = known[place] == found[mine]
        return out[back]


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal place together: high bytes of small numbers then cost next to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _later(seed, digest, ids, start) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by content and place, and which of them (in that order) have an earlier equal."""
    order = np.lexsort((start, ids, seed, digest))
    a, d, i, s = seed[order], digest[order], ids[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (i != i[first]) | (s != s[first])


def _runs(ids: np.ndarray, ties: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """id, tie and runs (start, length) of the given windows, one row a document."""
    order = np.lexsort((start, ties, ids))
    ids, ties, start = ids[order], ties[order], start[order]
    doc = np.ones(len(ids), bool)
    doc[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    run = doc.copy()
    run[1:] |= start[1:] != start[:-1] + 1
    run_at = np.flatnonzero(run)
    both = np.empty((len(run_at), 2), "<u4")
    both[:, 0] = start[run_at]
    both[:, 1] = np.diff(np.append(run_at, len(ids)))
    doc_at = np.flatnonzero(doc)
    cuts = np.append(np.searchsorted(run_at, doc_at), len(run_at)).tolist()
    for k, (i, t) in enumerate(zip(ids[doc_at].tolist(), ties[doc_at].tolist(), strict=True)):
        yield i, t, both[cuts[k] : cuts[k + 1]].tobytes()


def _run_batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = ((0, pa.int64()), (1, pa.int32()), (2, pa.binary()))
    columns = [pa.array([f[k] for f in found], t) for k, t in kinds]
    return pa.RecordBatch.from_arrays(columns, names=["_id", "_tie", "runs"])


def _pack_bucket(seed, digest, ids, ties, start) -> bytes:
    """Windows, in order of place, as documents and the windows of these."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    at = np.flatnonzero(new)
    documents = [ids[at], ties[at], np.diff(np.append(at, len(ids)))]
    parts = zip([*documents, start, seed, digest], _DOCUMENT + _WINDOW, strict=True)
    head = np.array([len(at), len(ids)], "<u8").tobytes()
    return head + b"".join(_planes(p.astype(kind)) for p, (_, kind) in parts)


def _unpack_bucket(raw: bytes) -> tuple[np.ndarray, ...]:
    n_documents, n = np.frombuffer(raw[:16], "<u8").tolist()
    at, parts = 16, []
    for many, kinds in ((n_documents, _DOCUMENT), (n, _WINDOW)):
        for _, kind in kinds:
            size = many * np.dtype(kind).itemsize
            parts.append(_from_planes(raw[at : at + size], kind))
            at += size
    ids, ties, count, start, seed, digest = parts
    return seed, digest, np.repeat(ids, count), np.repeat(ties, count), start


def repeats(docs: DataFrame, paths: list[str], size: int, buckets: int) -> DataFrame:
    """_id, _tie and runs (start, length, as binary) of windows whose words also start earlier.

    Earlier is a smaller id, or an earlier start in a row of the same id. `_tie` tells rows
    of one id apart, by their text. `paths` are those of the repeated seeds.
    """
    names = ["bucket", "_id", "_tie", "runs", "block"]

    def extend(batches):
        known = _Seeds(paths)
        held: list[tuple] = []
        n = 0

        def settle():
            seed, digest, start = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            lengths = [len(h[2]) for h in held]
            ids = np.repeat(np.array([h[0] for h in held], np.int64), lengths)
            ties = np.repeat(np.array([h[1] for h in held], np.int32), lengths)
            again = np.flatnonzero(known.holds(seed))
            if not len(again):
                return
            seed, digest, start, ids, ties = (x[again] for x in (seed, digest, start, ids, ties))
            seed = (seed >> np.uint64(32)).astype(np.uint32)
            order, later = _later(seed, digest, ids, start)
            gone = order[later]
            out = list(_runs(ids[gone], ties[gone], start[gone]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k % buckets for k in range(len(out))], pa.int32()),
                    *_run_batch(out).columns, pa.nulls(len(out), pa.binary()),
                ],
                names=names,
            )
            left = np.sort(order[~later])
            seed, digest, ids, ties, start = (x[left] for x in (seed, digest, ids, ties, start))
            bucket = (mix(digest ^ seed) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = by[cuts[b] : cuts[b + 1]]
                raw = _pack_bucket(*(x[part] for x in (seed, digest, ids, ties, start)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                        pa.nulls(1, pa.binary()), pa.array([raw], pa.binary()),
                    ],
                    names=names,
                )

        for ids, ties, texts in rows(batches, "_id", "_tie", "text"):
            for doc_id, tie, text in zip(ids, ties, texts, strict=True):
                seed, digest = windows(space_words(text), size)
                if len(seed):
                    held.append((doc_id, tie, seed, digest, np.arange(len(seed), dtype=np.uint32)))
                    n += len(seed)
            if n >= CHUNK:
                yield from settle()
                held.clear()
                n = 0
        if held:
            yield from settle()

    schema = "bucket int, _id long, _tie int, runs binary, block binary"
    # repeats found within a chunk travel along with the blocks, so the texts are read once;
    # a task has a few buckets, one after the other
    dealt = docs.mapInArrow(extend, schema).repartition("bucket").sortWithinPartitions("bucket")

    def join(batches):
        current, held = None, []

        def settle():
            parts = [_unpack_bucket(raw) for raw in held]
            seed, digest, ids, ties, start = (np.concatenate(p) for p in zip(*parts, strict=True))
            order, later = _later(seed, digest, ids, start)
            gone = order[later]
            found = list(_runs(ids[gone], ties[gone], start[gone]))
            for at in range(0, len(found), 20_000):
                yield _run_batch(found[at : at + 20_000])

        for batch in batches:
            local = batch.filter(pa.compute.is_null(batch.column("block")))
            yield local.select(["_id", "_tie", "runs"])
            for numbers, blocks in rows(iter([batch]), "bucket", "block"):
                for b, raw in zip(numbers, blocks, strict=True):
                    if raw is None:
                        continue
                    if b != current and held:
                        yield from settle()
                        held.clear()
                    current = b
                    held.append(raw)
        if held:
            yield from settle()

    return dealt.mapInArrow(join, "_id long, _tie int, runs binary")


def dedup(docs: DataFrame, size: int = 20, buckets: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, kept.

    Removes every word that lies in a window of `size` words whose words also start earlier:
    in a document of a smaller id, or earlier in the same one. A null id is before all
    others, a null text has no words. `kept` is the kept words, joined by spaces.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    if buckets is None:
        buckets = max(
            8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS)
        )
    paths = repeated_seeds(docs, size, max(8, -(-chars // SEED_CHARS)))
    keyed = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.hash("text").alias("_tie"),
    )
    gone = repeats(keyed.select("_id", "_tie", "text"), paths, size, buckets)
    # as many runs as the document has, in a row for each task that found some
    gone = materialize(gone.groupBy("_id", "_tie").agg(F.collect_list("runs").alias("runs")), "repeats")
    joined = keyed.join(gone, ["_id", "_tie"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        for ids, texts, found in rows(batches, "doc_id", "text", "runs"):
            out = []
            for doc_id, text, runs in zip(ids, texts, found, strict=True):
                words = space_words(text)
                n = len(words)
                if runs:
                    both = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, both[:, 0], 1)
                    np.add.at(edges, both[:, 0] + both[:, 1] + size - 1, -1)
                    stay = np.cumsum(edges[:n]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                kept = b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                out.append((doc_id, n, n - len(words), digest, kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
