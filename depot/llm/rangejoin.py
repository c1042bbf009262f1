"""Near-duplicate vectors by an exact metric range join.

Angles are a metric, so vectors linked at cosine `least` lie within the angle
acos(least). Pivots, a bounded sample of the vectors, cut the rest into cells of their nearest
pivot. By the triangle inequality a vector can have a link into another cell only if its
angle to that cell's pivot exceeds the cell's radius by no more than the range, and its own
distance to its pivot by no more than twice the range; it is sent there (of two cells, one
receives the other's boundary), and cells join independently. Large cells are cut into
tiles, and visitors of a tile are dealt over parts.

A tile multiplies in float32 with a bound on the error of that; what lies within the bound
of the threshold is multiplied again in double precision. Equal vectors are one row with a
number of copies. Tiles return numbers of links by vector and few links that connect all
that theirs connect, never the pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.simhash import _forest, _stars, components
from depot.llm.texts import rows
from depot.operators.durable import materialize

#: Vectors of a cell that are wanted, pivots at most (and bytes of them), vectors of a tile,
#: and visitors of a tile's part, about.
CELL, PIVOTS, PIVOT_BYTES, TILE, VISITORS = 2048, 4096, 32 << 20, 4096, 65_536
#: Vectors multiplied with a tile at a time.
SLICE = 1024
#: Angles are compared with so much to spare, far above the rounding of an arc cosine.
SPARE = 1e-6


def unit_rows(vectors: pa.Array, kind: str) -> list[bytes | None]:
    """Bytes of each usable vector; null for one that is null, zero, or holds a null or non-finite number."""
    out: list[bytes | None] = []
    for v in vectors:
        values = v.values if v.is_valid else None
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype(kind) + 0  # -0 becomes 0
        out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
    return out


def units(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, divided by their lengths, in double precision."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large numbers stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _read(vectors: DataFrame, vector: str, kind: str) -> DataFrame:
    """vec_id, key and vec; key is a digest of 128 bits that equal vectors share."""

    def run(batches):
        for batch in batches:
            found = unit_rows(batch.column("v"), kind)
            keys = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
                names=["vec_id", "key", "vec"],
            )

    columns = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(vector).alias("v"))
    return columns.mapInArrow(run, "vec_id long, key binary, vec binary")


def _cells(classes: DataFrame, pivots: list[bytes], kind: str) -> DataFrame:
    """cls, copies, vec and its cell: the number of the nearest pivot of the same length, with the angle.

    Vectors of a length that no pivot has form a cell of their own, numbered below zero.
    """
    sent = classes.sparkSession.sparkContext.broadcast(_by_length(pivots, kind))

    def run(batches):
        for numbers, copies, vecs in rows(batches, "cls", "copies", "vec"):
            cell, angle = np.zeros(len(vecs), np.int64), np.zeros(len(vecs))
            for length, at in _lengths(vecs):
                if length not in sent.value:
                    cell[at], angle[at] = -length, math.pi
                    continue
                which, centres = sent.value[length]
                cosine = units([vecs[k] for k in at], kind) @ centres.T
                best = cosine.argmax(1)
                cell[at] = which[best]
                angle[at] = np.arccos(np.clip(cosine[np.arange(len(at)), best], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int64()), pa.array(copies, pa.int64()),
                    pa.array(cell), pa.array(angle), pa.array(vecs, pa.binary()),
                ],
                names=["cls", "copies", "cell", "angle", "vec"],
            )

    schema = "cls long, copies long, cell long, angle double, vec binary"
    return classes.select("cls", "copies", "vec").mapInArrow(run, schema)


def _lengths(vecs: list[bytes]) -> list[tuple[int, np.ndarray]]:
    sizes = np.array([len(v) for v in vecs])
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def _by_length(pivots: list[bytes], kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {n: (at, units([pivots[k] for k in at], kind)) for n, at in _lengths(pivots)} if pivots else {}


def _owns(cell, other):
    """Which of two cells receives the other's boundary: each of them about as often."""
    return np.where((cell + other) % 2 == 0, cell < other, cell > other)


def _deal(placed: DataFrame, pivots: list[bytes], radius: dict, tiles: dict, reach: float, parts: int, kind: str):
    """Every vector as a member of its tile, in each part, and as a visitor of the tiles it can have links into."""
    known = placed.sparkSession.sparkContext.broadcast((_by_length(pivots, kind), radius, tiles))

    names = ["cell", "tile", "part", "later", "cls", "copies", "vec"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        by_length, radii, n_tiles = known.value

        def sends(numbers, cells, angles, vecs):
            """Cell, tile, part, whether as a visitor, and place in the slice."""
            cell, angle = np.array(cells, np.int64), np.array(angles)
            for k, (c, cls) in enumerate(zip(cells, numbers, strict=True)):
                mine = cls % n_tiles[c]
                for part in range(parts):
                    yield c, mine, part, False, k
                for tile in range(mine):  # of two tiles of a cell, the earlier receives the later
                    yield c, tile, (cls // 7) % parts, True, k
            for length, at in _lengths(vecs):
                if length not in by_length:
                    continue
                which, centres = by_length[length]
                to = np.arccos(np.clip(units([vecs[k] for k in at], kind) @ centres.T, -1, 1))
                reaches = to <= np.array([radii.get(int(w), -math.inf) for w in which]) + reach + SPARE
                reaches &= to <= angle[at, None] + 2 * reach + SPARE
                reaches &= _owns(which, cell[at, None])
                for row, column in zip(*map(np.ndarray.tolist, np.nonzero(reaches)), strict=True):
                    k, c = int(at[row]), int(which[column])
                    for tile in range(n_tiles[c]):
                        yield c, tile, (numbers[k] // 7) % parts, True, k

        for numbers, copies, cells, angles, vecs in rows(batches, "cls", "copies", "cell", "angle", "vec"):
            sent = sends(numbers, cells, angles, vecs)
            while some := list(islice(sent, 10_000)):
                *to, k = zip(*some, strict=True)
                columns = [*to, *([held[i] for i in k] for held in (numbers, copies, vecs))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                )

    schema = "cell long, tile long, part long, later boolean, cls long, copies long, vec binary"
    dealt = placed.mapInArrow(run, schema).repartition("cell", "tile", "part")
    return dealt.sortWithinPartitions("cell", "tile", "part", "later")


class _Tile:
    """The members of a tile, the numbers of their links so far, and what is connected already."""

    def __init__(self, least: float, kind: str):
        self.least, self.kind = least, kind
        self.ids: list[int] = []
        self.copies: list[int] = []
        self.vecs: list[bytes] = []
        self.own: np.ndarray | None = None
        self.parent: dict = {}

    def close(self, among_themselves: bool) -> list[tuple[int, int]]:
        """After the last member: links that connect what members connect."""
        self.own = units(self.vecs, self.kind)
        self.narrow = self.own.astype(np.float32).T
        self.weights = np.array(self.copies, np.int64)
        self.numbers = np.array(self.ids, np.int64)
        self.counts = np.zeros(len(self.ids), np.int64)
        self.vecs.clear()
        links = []
        for at in range(0, len(self.ids) if among_themselves else 0, SLICE):
            linked = self._near(self.own[at : at + SLICE])
            k = np.arange(len(linked))
            linked[k, at + k] = False
            self.counts[at : at + SLICE] += _weighed(linked, self.weights)
            links += self._connect(linked, self.numbers[at : at + SLICE])
        return links

    def visit(self, ids: list[int], copies: list[int], vecs: list[bytes]) -> tuple[np.ndarray, list]:
        """Number of links of each visitor, and links that connect what theirs connect."""
        linked = self._near(units(vecs, self.kind))
        if not linked.any():
            return np.zeros(len(ids), np.int64), []
        self.counts += _weighed(linked.T, np.array(copies, np.int64))
        return _weighed(linked, self.weights), self._connect(linked, np.array(ids, np.int64))

    def _near(self, some: np.ndarray) -> np.ndarray:
        # bounds the error of a float32 product of unit vectors, however it is summed up
        spare = (some.shape[1] + 4) * 1.2e-7
        cosine = some.astype(np.float32) @ self.narrow
        linked = cosine >= self.least - spare
        row, column = np.nonzero(linked & (cosine <= self.least + spare))
        for at in range(0, len(row), 4096):
            r, c = row[at : at + 4096], column[at : at + 4096]
            linked[r, c] = np.einsum("ij,ij->i", some[r], self.own[c]) >= self.least
        return linked

    def _connect(self, linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        if not linked.any():
            return []
        row, column = _stars(linked)
        return _forest(ids[row], self.numbers[column], self.parent)


def _weighed(linked: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's links."""
    rows_with = np.flatnonzero(linked.any(1))
    out = np.zeros(len(linked), np.int64)
    for k in rows_with.tolist():
        out[k] = weights[linked[k]].sum()
    return out


def _join(dealt: DataFrame, least: float, kind: str) -> DataFrame:
    """Rows (a, null, n), n links of vector a found in a tile, and rows (a, b, 0) of connecting links."""

    def batch(ids: np.ndarray, counts: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
        has = np.flatnonzero(counts)
        a = [*ids[has].tolist(), *(x for x, _ in links)]
        b = [*[None] * len(has), *(y for _, y in links)]
        n = [*counts[has].tolist(), *[0] * len(links)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    none = np.empty(0, np.int64)

    def run(batches):
        current, tile = None, _Tile(least, kind)
        held: tuple[list, list, list] = ([], [], [])

        def settle():
            if tile.own is None and tile.ids:
                yield batch(none, none, tile.close(current[2] == 0))
            if held[0] and tile.ids:  # a tile may have got no members
                counts, links = tile.visit(*held)
                yield batch(np.array(held[0], np.int64), counts, links)
            for column in held:
                column.clear()

        def finish():
            yield from settle()
            if tile.ids:
                yield batch(tile.numbers, tile.counts, [])

        columns = ("cell", "tile", "part", "later", "cls", "copies", "vec")
        for part in rows(batches, *columns):
            for cell, number, of, later, cls, copies, vec in zip(*part, strict=True):
                if (cell, number, of) != current:
                    yield from finish()
                    current, tile = (cell, number, of), _Tile(least, kind)
                if not later:
                    tile.ids.append(cls)
                    tile.copies.append(copies)
                    tile.vecs.append(vec)
                    continue
                for column, value in zip(held, (cls, copies, vec), strict=True):
                    column.append(value)
                if len(held[0]) >= SLICE:
                    yield from settle()
        yield from finish()

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least `least` (above 0).
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable over links, kept tells whether it is the row's own. A vector that is null,
    empty or zero, or holds a null or non-finite component, links with nothing; nor do vectors
    of different lengths. Rows that repeat are rows of their own, linked with each other.
    A null vec_id is never a component_id where another is there, and never kept.
    """
    element = vectors.schema[vector].dataType.elementType
    kind = "<f4" if element.typeName() == "float" else "<f8"
    read = materialize(_read(vectors, vector, kind), "vectors")
    distinct = read.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec")
    )
    classes = materialize(distinct.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    wanted = min(PIVOTS, PIVOT_BYTES // (8 * (size["bytes"] or 8)), size["n"] // CELL)
    chosen = classes.select("vec", "key").orderBy(F.xxhash64("key"), "key").limit(max(1, wanted))
    pivots = [bytes(r["vec"]) for r in chosen.collect()]
    placed = materialize(_cells(classes, pivots, kind), "vector-cells")
    # one row a pivot, and one for each length of vectors that has none
    cells = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()
    radius = {r["cell"]: r["angle"] for r in cells}
    tiles = {r["cell"]: -(-r["n"] // TILE) for r in cells}
    dealt = _deal(placed, pivots, radius, tiles, math.acos(least), -(-size["n"] // VISITORS) or 1, kind)
    found = materialize(_join(dealt, least, kind), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    rooted = components(found.where("b is not null").select("a", "b"))
    narrow = classes.select("cls", "key", "first", "copies")
    joined = narrow.join(counts, narrow.cls == counts.a, "left").join(rooted, narrow.cls == rooted.node, "left")
    joined = materialize(
        joined.select(
            "key", "first", F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        ).where("n_links > 0"),
        "linked-vectors",
    )
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "root").select("key", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return read.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
