"""Hard-negative mining with inner products of a residue number system.

Components become integers. Their matrices are multiplied modulo a few small primes in
float32: residues are centred and a block of components is short enough for every sum to
stay below 2 ** 24, so each product is exact whatever order the library adds in. The
remainders give the exact signed score back (mixed radix digits). Primes are chosen so that
their product exceeds twice the largest possible score, which is at most the largest
squared length of a row.

Anchors are taken in blocks that are broadcast; all rows pass by a block twice, once for the
positives and once, with the windows these set, for the negatives. Tasks keep bounded heaps,
merged in Spark.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.heaps import NO_SCORE, Heaps, merge
from depot.operators.durable import materialize

#: Anchors of a block, and bytes of their components in it, at most.
ANCHORS, ANCHOR_BYTES = 2048, 32 << 20
#: Scores held at a time in a task, at most about.
SCORES = 1 << 19
#: Components multiplied at a time, and the sums float32 holds exactly.
WIDTH, EXACT = 4096, 1 << 24
#: Scores stay below, so that the range of any set of primes fits a long.
RANGE = 1 << 52
SCALE = 256


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def primes_for(most: int, width: int) -> list[int]:
    """Few primes whose product exceeds 2 * most, with exact float32 sums of `width` products."""
    largest = 2 * math.isqrt((EXACT - 1) // max(1, min(width, WIDTH))) + 1
    n = 1
    while True:
        root = max(3, int((2 * most + 2) ** (1 / n)))
        found, p, product = [], root, 1
        while len(found) < n and p <= largest:
            if _is_prime(p):
                found.append(p)
                product *= p
            p += 1
        if len(found) == n and product > 2 * most + 1:
            return found
        n += 1


class Residues:
    """Rows of integers, centred modulo each prime, as float32."""

    def __init__(self, whole: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = []
        for p in primes:
            r = np.mod(whole, p)
            r[r > p // 2] -= p
            self.parts.append(r.astype(np.float32))

    def scores(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all rows of `other`."""
        total = np.zeros((len(self.parts[0]), len(other.parts[0])), np.int64)
        radix = 1
        for p, mine, theirs in zip(self.primes, self.parts, other.parts, strict=True):
            left = np.zeros(total.shape, np.int64)
            for at in range(0, mine.shape[1], WIDTH):
                left += np.rint(mine[:, at : at + WIDTH] @ theirs[:, at : at + WIDTH].T).astype(np.int64)
            # the next digit of the mixed radix number that has all remainders so far
            digit = (left - total) % p * pow(radix, -1, p) % p
            total += digit * radix
            radix *= p
        total[total > radix // 2] -= radix
        return total


def whole_components(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, x as a double."""
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64)


def _table(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of components, shorter ones filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def usable(vectors: DataFrame, vector: str = "embedding", number: str = "vec_id") -> DataFrame:
    """vec_id, label and vec of rows that take part; every seventh id has its label moved on."""
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    wide = F.col("label").cast("decimal(20,0)")  # the largest label has a next one too
    label = F.when(F.col(number) % 7 == 0, (wide + 1) % 10).otherwise(wide)
    return vectors.where(
        F.col(number).isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & fine
    ).select(
        F.col(number).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vec")
    )


def _passing(batches, width: int, primes: list[int], at_once: int):
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            vectors = whole_components(_table(part.column("vec"), width))
            yield (
                part.column("vec_id").to_numpy(), part.column("label").to_numpy(), Residues(vectors, primes)
            )


def _emit(names: list[str], heaps: Heaps):
    group, score, ids, _ = heaps.entries()
    columns = [pa.array(group, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _positives(ready: DataFrame, block, k: int) -> DataFrame:
    """no, id, score: the `k` best rows of the anchor's label with another id, of each task."""

    def run(batches):
        ids, labels, anchors, width, primes = block.value
        heaps = Heaps(len(ids), k)
        for vec_id, label, some in _passing(batches, width, primes, max(1, SCORES // len(ids))):
            score = some.scores(anchors)
            good = (label[:, None] == labels) & (vec_id[:, None] != ids) & (score >= heaps.least)
            at, group = np.nonzero(good)
            heaps.add(group, score[at, group], vec_id[at], np.zeros(len(at), bool))
        yield _emit(["no", "id", "score"], heaps)

    return ready.mapInArrow(run, "no long, id long, score long")


def _negatives(ready: DataFrame, block, pairs, k: int) -> DataFrame:
    """pair, id, score: the `k` best rows of other labels within the pair's window, of each task."""

    def run(batches):
        ids, labels, anchors, width, primes = block.value
        # pairs of an anchor stand one below the other: row j has the j-th pair of each anchor
        number, low, high = pairs.value
        heaps = Heaps(int(number.max()) + 1, k)
        for vec_id, label, some in _passing(batches, width, primes, max(1, SCORES // len(ids))):
            score = some.scores(anchors)
            inside = (label[:, None] != labels) & (score >= low.min(0)) & (score <= high.max(0))
            row, anchor = np.nonzero(inside)
            found = score[row, anchor]
            for j in range(len(number)):
                pair = number[j, anchor]
                good = (pair >= 0) & (found >= low[j, anchor]) & (found <= high[j, anchor])
                good &= found >= heaps.least[pair]
                heaps.add(pair[good], found[good], vec_id[row[good]], np.zeros(int(good.sum()), bool))
        yield _emit(["pair", "id", "score"], heaps)

    return ready.mapInArrow(run, "pair long, id long, score long")


def _pairs(found: pa.Table, anchors: int, slots: int, low: tuple, high: tuple):
    """The pairs' numbers and score windows by slot and anchor; a missing pair is -1 and takes nothing."""
    number = np.full((slots, anchors), -1, np.int64)
    lowest = np.full((slots, anchors), np.iinfo(np.int64).max)
    highest = np.full((slots, anchors), NO_SCORE)
    no, rank, pair, score = (found.column(c).to_pylist() for c in ("no", "rank", "pair", "score"))
    for a, r, p, s in zip(no, rank, pair, score, strict=True):
        number[r - 1, a] = p
        lowest[r - 1, a] = -(-s * low[0] // low[1])
        highest[r - 1, a] = s * high[0] // high[1]
    return number, lowest, highest


def hard_negatives(
    vectors: DataFrame,
    vector: str = "embedding",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the usable rows whose vec_id is divisible by `every`. A positive is one of the
    first `positives` rows of its label with another vec_id; negatives are the first
    `negatives` rows of other labels whose score lies between `low` and `high` times the
    positive's. First means the higher score, then the smaller vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no
    part. Rows that repeat count each time, and an anchor never counts rows of its own id. A
    missing component of a shorter vector counts as zero. Components so large that a score
    would reach 2 ** 52 are an error, since the residues' range must fit a long.
    """
    spark = vectors.sparkSession
    ready = usable(vectors, vector)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.floor(SCALE * x.cast("double")), F.lit(2.0)))
    size = ready.agg(F.max(square).alias("most"), F.max(F.size("vec")).alias("width")).first()
    anchors = ready.where(F.col("vec_id") % every == 0)
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    nothing = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    if size["most"] is None:
        return nothing
    if size["most"] >= RANGE:
        raise ValueError("components are too large for exact scores")
    # doubles add up with rounding; a thousandth more is above any exact sum
    most, width = int(size["most"] * 1.001) + 1, max(1, size["width"])
    primes = primes_for(most, width)
    of_block = max(1, min(ANCHORS, ANCHOR_BYTES // (4 * width * len(primes))))
    blocks = max(1, -(-anchors.count() // of_block))
    numbered = materialize(
        anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(2 * blocks - 1))), "anchors"
    )
    parts = []
    for block in range(2 * blocks - 1):
        held = numbered.where(F.col("block") == block).toArrow()
        for at in range(0, held.num_rows, of_block):
            some = held.slice(at, of_block).combine_chunks()
            table = whole_components(_table(some.column("vec").combine_chunks(), width))
            ids = some.column("vec_id").to_numpy()
            sent = spark.sparkContext.broadcast(
                (ids, some.column("label").to_numpy(), Residues(table, primes), width, primes)
            )
            best = merge(_positives(ready, sent, positives), ["no"], positives, "id")
            best = best.withColumn("pair", F.col("no") * positives + F.col("rank") - 1)
            best = materialize(best, "positives")
            found = best.toArrow()  # at most `positives` rows for each anchor of the block
            if found.num_rows:
                windows = spark.sparkContext.broadcast(_pairs(found, len(ids), positives, low, high))
                mined = merge(_negatives(ready, sent, windows, negatives), ["pair"], negatives, "id")
                named = spark.createDataFrame(
                    pa.table({"no": pa.array(range(len(ids)), pa.int64()), "anchor_id": pa.array(ids, pa.int64())})
                )
                whose = best.join(F.broadcast(named), "no").select(
                    "pair", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
                )
                mined = mined.select(
                    "pair", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
                )
                parts.append(materialize(mined.join(F.broadcast(whose), "pair").selectExpr(*columns.split(", ")), "mined"))
                windows.destroy()
            sent.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else nothing
