"""Best-fit packing by patterns: how often each combination of lengths is to be repeated.

Packing only needs the histogram of lengths, which has as many rows as a sequence has
tokens. Patterns of two or three lengths that fill a sequence are fitted to it by
non-negative least squares, their repeat counts are rounded down, and what is left is
packed best-fit on the histogram too. Pieces then find their place by their rank among
the pieces of their length; no sequence is ever built in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depot.llm.texts import rows, word_tokenizer
from depot.operators.durable import materialize

#: Three-document patterns tried for each longest member.
TRIPLES = 8
#: Steps of the least-squares fit.
STEPS = 300


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Patterns of up to three lengths that fill a sequence exactly; 0 stands for none."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    there[0] = True
    out = []
    for a in np.unique(lengths)[::-1].tolist():
        rest = size - a
        if rest > 2 * a:
            break
        b = np.arange(min(a, rest), (rest + 1) // 2 - 1, -1)  # a >= b >= c
        b = b[there[b] & there[rest - b]]
        pair = b[b == rest]  # nothing third
        triple = b[b != rest]
        if len(triple) > TRIPLES:
            triple = triple[np.linspace(0, len(triple) - 1, TRIPLES).astype(int)]
        out += [(a, x, rest - x) for x in np.concatenate([pair, triple]).tolist()]
    return np.array(out, np.int64).reshape(-1, 3)


def repeat_counts(found: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the patterns against the histogram.

    Accelerated projected gradient; every pattern has three members, so a step costs three
    look-ups a pattern. Each length weighs the same relative to its count.
    """
    n = len(histogram)
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))
    weight[0] = 0
    columns = weight[found]

    def product(x):
        return np.bincount(found.ravel(), (columns * x[:, None]).ravel(), n)

    target = weight * histogram
    v = np.ones(len(found))
    for _ in range(20):  # largest eigenvalue
        v = (columns * product(v)[found]).sum(1)
        v /= np.linalg.norm(v) or 1
    step = 1 / max(1e-12, np.linalg.norm((columns * product(v)[found]).sum(1)) * 1.05)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(STEPS):
        grad = (columns * (product(y) - target)[found]).sum(1)
        new = np.maximum(0, y - step * grad)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def _fill(left: np.ndarray, space: int) -> list[int]:
    """Lengths that fill the space as well as possible: exactly with one to three, else the longest."""
    taken: list[int] = []
    left = left.copy()
    while space > 0:
        if left[space]:
            taken.append(space)
            break
        pair = np.flatnonzero((left[1:space] > 0) & (left[space - 1 : 0 : -1] > 0)) + 1
        pair = pair[(2 * pair != space) | (left[pair] > 1)]
        if len(pair):
            taken += [int(pair[-1]), space - int(pair[-1])]
            break
        fitting = np.flatnonzero(left[1:space]) + 1
        if not len(fitting):
            break
        best = int(fitting[-1])
        for a in fitting[::-1][:48].tolist():  # three that fit exactly
            rest = space - a
            b = np.flatnonzero((left[1:rest] > 0) & (left[rest - 1 : 0 : -1] > 0)) + 1
            b = b[(b != a) & (rest - b != a) & (2 * b != rest)]
            if len(b):
                best = a
                break
        taken.append(best)
        left[best] -= 1
        space -= best
    return taken


def plan(histogram: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Patterns with repeat counts that use up the histogram (counts by length, index 0 unused)."""
    left = np.array(histogram, np.int64)
    out: list[tuple[list[int], int]] = []

    def use(members: list[int], times: int) -> None:
        if times > 0:
            np.subtract.at(left, members, times)
            out.append((members, int(times)))

    use([size], int(left[size]))
    found = patterns(np.flatnonzero(left), size) if left.any() else np.empty((0, 3), np.int64)
    if len(found):
        x = repeat_counts(found, left.astype(float))
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 1:
                break
            members = [m for m in found[k].tolist() if m]
            room = min(left[m] // members.count(m) for m in members)
            use(members, min(int(x[k]), int(room)))
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        left[longest] -= 1
        members = [longest, *_fill(left, size - longest)]
        left[longest] += 1
        use(members, min(int(left[m]) // members.count(m) for m in set(members)))


class Slots:
    """Where the piece of a length and rank goes, as runs of equal steps."""

    def __init__(self, planned: list[tuple[list[int], int]]):
        runs, sequence = [], 0
        for members, times in planned:
            offset = 0
            for m in members:
                runs.append((m, sequence, offset, times))
                offset += m
            sequence += times
        self.sequences = sequence
        table = np.array(runs, np.int64).reshape(-1, 4)
        table = table[np.argsort(table[:, 0], kind="stable")]
        before = np.cumsum(table[:, 3]) - table[:, 3]
        if len(table):
            first = np.searchsorted(table[:, 0], table[:, 0])
            before -= before[first]
        self.key = (table[:, 0] << 44) | before
        self.first, self.offset, self.before = table[:, 1], table[:, 2], before

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        return self.first[at] + rank - self.before[at], self.offset[at]


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most `size` ids: doc_id, piece, start, length, ids_crc32, _part, _rank.

    `_rank` counts the pieces of one length within one part. The rows are written to the
    shared folder, so parts and ranks stay as they are.
    """

    def cut(batches):
        tokenizer = word_tokenizer(vocabulary)
        seen = np.zeros(size + 1, np.int64)
        part = TaskContext.get().partitionId()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, ids in zip(doc_ids, tokenizer.encode(texts), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), size)):
                    piece = ids[start : start + size]
                    n = len(piece)
                    out.append((doc_id, k, start, n, zlib.crc32(piece), part, int(seen[n])))
                    seen[n] += 1
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
    return materialize(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Packs the documents' ids, each with an end id, into sequences of at most `size`.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one piece with the end id. Only documents longer than a sequence
    are cut. Extra columns are ignored.
    """
    pieces = cut_pieces(docs, vocabulary, end_id, size)
    counts = materialize(
        pieces.groupBy("_part", "length").agg((F.max("_rank") + 1).alias("n")), "piece-counts"
    )
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row.length] = row.n
    slots = Slots(plan(histogram, size))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = counts.select(
        "_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base")
    )
    ranked = pieces.join(base, ["_part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = slots.of(length, rank)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
