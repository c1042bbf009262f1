"""SimHash near-duplicates by exact tiled comparison.

Equal fingerprints are one row from the start. Fingerprints are cut into tiles of equal bit
counts of their quarters (a tile key), and only tiles whose counts differ by at most the
radius in sum can hold near ones: every differing bit changes one count by one. A tile is
compared with itself and with such neighbours, as an exclusive-or table with bit counts.
Each comparison keeps the links that join something, never all pairs of a dense group.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from depot.llm.texts import field_rows, lower_words, rows, whole
from depot.operators.durable import materialize

#: Fingerprints of a tile, at most about.
TILE = 4096
#: The counts that make the tile key are of so many equal parts of the fingerprint.
PARTS = 4
SEED = 42
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the hashes of the word shingles; zero without words."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << _BITS).sum())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            found = np.array([fingerprint(lower_words(t), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _key(fp: Column) -> Column:
    """Bit counts of the parts, one byte each."""
    width = 64 // PARTS
    mask = F.lit((1 << width) - 1)
    key = F.lit(0)
    for k in range(PARTS):
        part = F.shiftrightunsigned(fp, k * width).bitwiseAND(mask)
        key = key * 256 + F.bit_count(part)
    return key.cast("long")


def _neighbours(radius: int) -> list[int]:
    """Steps from a key to the later keys within the radius."""
    steps = product(range(-radius, radius + 1), repeat=PARTS)
    near = [s for s in steps if sum(map(abs, s)) <= radius]
    return sorted(
        step for s in near if (step := sum(x * 256**k for k, x in enumerate(reversed(s)))) > 0
    )


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, parent: dict) -> list[tuple[int, int]]:
    """The links that join what `parent` (union-find by fingerprint) does not hold together yet."""

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of few links that connect all that a table of links connects."""
    left, right = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    links: tuple[list, list] = ([], [])
    for start in np.flatnonzero(near.any(1)).tolist():
        if left[start] >= 0:
            continue
        new_rows = np.array([start])
        left[start] = start
        while len(new_rows):
            block = near[new_rows][:, right < 0]
            open_columns = np.flatnonzero(right < 0)
            hit = block.any(0)
            columns = open_columns[hit]
            links[0].append(new_rows[block[:, hit].argmax(0)])
            links[1].append(columns)
            right[columns] = start
            open_rows = np.flatnonzero(left < 0)
            if not len(columns) or not len(open_rows):
                break
            block = near[open_rows][:, columns]
            hit = block.any(1)
            new_rows = open_rows[hit]
            links[0].append(new_rows)
            links[1].append(columns[block[hit].argmax(1)])
            left[new_rows] = start
    if not links[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(links[0]), np.concatenate(links[1])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all within the radius.

    `distinct` has each fingerprint once, as `fp`. Fingerprints are connected here exactly if
    a chain of fingerprints connects them in which each differs from the next in at most
    `radius` bits. A key of many fingerprints is split into tiles by hash.
    """
    keyed = distinct.select("fp", _key(F.col("fp")).alias("key"))
    # a key has PARTS counts of 0 .. 64 / PARTS, so this table has a bounded number of rows
    tiles = materialize(
        keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles"
    )
    placed = keyed.join(F.broadcast(tiles), "key").withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    )
    filled = materialize(
        placed.groupBy("key", "tile").agg(F.collect_list("fp").alias("fps")), "tile-rows"
    )
    # every tile goes to itself and to the tiles it is compared with, which come first in order
    steps = F.array(*[F.lit(s).cast("long") for s in _neighbours(radius)])
    other = tiles.select(F.col("key").alias("owner"), F.col("tiles").alias("owners"))
    neighbour = filled.select(
        F.explode(F.transform(steps, lambda s: F.col("key") - s)).alias("owner"), "key", "tile", "fps"
    ).join(F.broadcast(other), "owner")
    same = filled.join(F.broadcast(tiles), "key").select(
        F.col("key").alias("owner"), "key", "tile", "fps", F.col("tiles").alias("owners")
    )
    sent = neighbour.select("owner", "key", "tile", "fps", "owners").unionByName(same)
    sent = sent.select(
        "owner", F.explode(F.sequence(F.lit(0), F.col("owners") - 1)).alias("part"), "key", "tile", "fps"
    ).where("key != owner or tile >= part")
    mine = (F.col("key") == F.col("owner")) & (F.col("tile") == F.col("part"))
    dealt = sent.withColumn("later", (~mine).cast("int")).repartition("owner", "part")
    dealt = dealt.sortWithinPartitions("owner", "part", "later")

    def compare(batches):
        current, own, parent = None, None, {}
        for owner, part, lists in rows(batches, "owner", "part", "fps"):
            out = []
            for where, values in zip(zip(owner, part, strict=True), lists, strict=True):
                fps = np.array(values, np.int64).view(np.uint64)
                if where != current:
                    current, own, parent = where, fps, {}
                for at in range(0, len(own), 1024):
                    some = own[at : at + 1024]
                    near = np.bitwise_count(some[:, None] ^ fps[None, :]) <= radius
                    if fps is own:
                        near[np.arange(len(some)), at + np.arange(len(some))] = False
                    if near.any():
                        a, b = _stars(near)
                        out += _forest(some[a].view(np.int64), fps[b].view(np.int64), parent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return dealt.select("owner", "part", "fps").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node (as a signed long) that each linked node can reach.

    Alternates large-star and small-star steps: each node passes its smallest neighbour on,
    until nothing changes. Every step is written to the shared folder; the driver sees one
    count a round.
    """
    edges = materialize(edges.where("a != b").distinct(), "links")
    previous = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # large star: larger neighbours are linked to the smallest of the neighbourhood
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        ).where("a != b").distinct()
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m"))
        edges = materialize(
            small.where("x != m")
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "small-star",
        )
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == previous:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        previous = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing
    bits. Null ids are never chosen, except where a component has no other. Texts without
    words have the fingerprint zero and are linked like others.
    """
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(
        found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes"
    )
    rooted = components(links(classes.select("fp"), radius))
    member = classes.join(rooted, classes.fp == rooted.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    member = materialize(member, "members")
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    # only classes of linked fingerprints need their component looked up
    named = materialize(member.join(smallest, "root").select("fp", "component_id"), "components")
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Whole rows of `docs`, one of each component of :func:`near_duplicates`.

    It is the row with the smallest doc_id, null ids last; of rows that share it any one.
    Rows without words are one component.
    """
    docs = whole(docs)
    kinds = docs.schema

    def run(batches):
        for part, texts in field_rows(batches):
            found = np.array([fingerprint(lower_words(t), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(found.view(np.int64))], names=["doc", "fp"]
            )

    held = docs.mapInArrow(run, StructType([*kinds.fields, StructField("fp", LongType())]))
    # written with a number for each row, so that of equal rows one can be told from the others
    held = materialize(held.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("id"), "row")
    narrow = held.select("fp", "row", rank.alias("rank"))
    classes = materialize(narrow.groupBy("fp").agg(F.min("rank").alias("first")), "document-classes")
    rooted = components(links(classes.select("fp"), radius))
    member = classes.join(rooted, classes.fp == rooted.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    member = materialize(member, "members")
    best = member.groupBy("root").agg(F.min("first").alias("best"))
    chosen = member.join(best, "root").select("fp", F.col("best.row").alias("chosen"))
    gone = narrow.join(chosen, "fp").where("row != chosen").select("row")
    return held.join(materialize(gone, "near-copies"), "row", "left_anti").select("doc.*")
