"""Ranked lexical search in reverse: the documents pass through an index of the queries.

The items' terms make an inverted index, block by block of bounded size. A block is
broadcast, each document's counts of the index's terms are looked up in it, and the scores
update bounded heaps, one for each item of the block; the heaps of all tasks are merged in
Spark. No index of the documents is built and no text is shuffled: one pass counts terms
and writes the counts of the block's terms, a second over these counts scores them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.llm.heaps import Heaps, merge
from depot.llm.texts import plain_words, rows
from depot.operators.durable import materialize

#: Postings and items of a block, at most about; an item of over a quarter of them has its own.
POSTINGS, ITEMS = 400_000, 20_000
#: Postings that are added up at a time in a task.
AT_ONCE = 1_000_000

#: What is no letter, no digit and within ASCII; and the constants of the score.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TF_SCALE, _TF_STEP, _LENGTH_STEP, _SHARE = 1_000_000_000, 1000, 12, 25


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def item_terms(items: DataFrame, item: str = "item_id") -> DataFrame:
    """block, no, item, term, n: how often each item has each term; rows of one id are one item.

    `no` numbers the items of a block from 0. Equal rows count once.
    """
    each = items.select(F.col(item).alias("item"), "text").distinct()
    counted = each.select("item", F.explode(terms(F.col("text"))).alias("term"))
    counted = materialize(counted.groupBy("item", "term").agg(F.count("*").alias("n")), "item-terms")
    sizes = counted.groupBy("item").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("size"), F.count("*").alias("items")).first()
    blocks = max(1, -(-(total["size"] or 0) // POSTINGS), -(-total["items"] // ITEMS))
    alone = F.col("size") > POSTINGS // 4
    block = F.when(alone, blocks + F.monotonically_increasing_id()).otherwise(
        F.pmod(F.xxhash64("item"), F.lit(blocks))
    )
    placed = materialize(sizes.select("item", block.alias("block")), "item-blocks")
    return materialize(
        counted.withColumnRenamed("item", "_item")
        .join(placed, F.col("_item").eqNullSafe(F.col("item")))
        .select("block", "item", "term", "n"),
        "item-postings",
    )


class _Index:
    """Postings of a block: for term number t, entries first[t] to first[t + 1] of items and n."""

    def __init__(self, postings: pa.Table):
        names = postings.column("term").to_pylist()
        self.terms = {t.encode(): k for k, t in enumerate(sorted(set(names)))}
        kinds = postings.column("no").to_numpy()
        number = np.fromiter((self.terms[t.encode()] for t in names), np.int64, len(names))
        order = np.argsort(number, kind="stable")
        self.items = kinds[order].astype(np.int64)
        self.n = postings.column("n").to_numpy()[order].astype(np.int64)
        self.first = np.searchsorted(number[order], np.arange(len(self.terms) + 1))
        self.count = int(kinds.max()) + 1


def _number(postings: pa.Table) -> tuple[pa.Table, pa.Array]:
    """The block's postings with the number of each item, and the items in that order."""
    coded = postings.column("item").combine_chunks().dictionary_encode("encode")
    return postings.append_column("no", coded.indices), coded.dictionary


_COUNTS = "doc_id long, n long, terms binary, tf binary, seen array<int>, seen_in array<long>"


def _count(docs: DataFrame, known) -> DataFrame:
    """A row a document with a term: its length and counts of the index's terms; and rows of how many
    documents of a task have each term (`seen`, `seen_in`)."""

    def run(batches):
        index = known.value.terms
        df = np.zeros(len(index), np.int64)
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                words = plain_words(text)
                if not words:
                    continue
                found = [(index[w], c) for w, c in Counter(words).items() if w in index]
                pairs = np.array(sorted(found), np.uint32).reshape(-1, 2)
                df[pairs[:, 0]] += 1
                # bytes of equal place together: counts are small, so the rest are zeros
                planes = [np.ascontiguousarray(pairs[:, k]).view(np.uint8).reshape(-1, 4).T for k in (0, 1)]
                out.append((doc_id, len(words), *(p.tobytes() for p in planes)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                    pa.nulls(len(out), ints), pa.nulls(len(out), longs),
                ],
                names=names,
            )
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())),
                pa.array([seen.tolist()], ints), pa.array([df[seen].tolist()], longs),
            ],
            names=names,
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COUNTS)


def _numbers(planes: bytes) -> np.ndarray:
    flat = np.frombuffer(planes, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(np.uint32).astype(np.int64)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - _SHARE + (_SHARE * n * n_docs) // n_terms


def _score(counts: DataFrame, known, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """no, doc_id, score: the `k` best documents of a task for each item of the block."""

    def run(batches):
        index, w = known.value, weights.value
        sizes = np.diff(index.first)
        sizes[w == 0] = 0  # adds nothing
        heaps = Heaps(index.count, k)
        scores = np.zeros(0, np.int64)

        def settle(held):
            nonlocal scores
            n_docs_held = len(held)
            if len(scores) < n_docs_held * index.count:
                scores = np.zeros(n_docs_held * index.count, np.int64)
            mine = scores[: n_docs_held * index.count]
            mine[:] = 0
            term = np.concatenate([h[2] for h in held])
            each = np.concatenate([h[3] for h in held])
            row = np.repeat(np.arange(n_docs_held), [len(h[2]) for h in held])
            many = sizes[term]
            ends = np.cumsum(many)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.first[term] - ends + many, many)
            np.add.at(mine, np.repeat(row * index.count, many) + index.items[place],
                      np.repeat(each, many) * index.n[place])
            table = mine.reshape(n_docs_held, index.count)
            good = (table > 0) & (table >= heaps.least)
            at, group = np.nonzero(good)
            ids = np.array([h[0] or 0 for h in held], np.int64)
            null = np.array([h[0] is None for h in held])
            heaps.add(group, table[at, group], ids[at], null[at])

        held, n = [], 0
        for ids, lengths, term_planes, tf_planes in rows(batches, "doc_id", "n", "terms", "tf"):
            for doc_id, length, planes, counted in zip(ids, lengths, term_planes, tf_planes, strict=True):
                if not planes:
                    continue
                term, tf = _numbers(planes), _numbers(counted)
                m = length_part(length, n_docs, n_terms)
                each = w[term] * ((_TF_SCALE * tf) // (_TF_STEP * tf + _LENGTH_STEP * m))
                held.append((doc_id, length, term, each))
                n += int(sizes[term].sum()) + index.count
                if n >= AT_ONCE:
                    settle(held)
                    held, n = [], 0
        if held:
            settle(held)
        group, score, ids, null = heaps.entries()
        yield pa.RecordBatch.from_arrays(
            [pa.array(group, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score)],
            names=["no", "doc_id", "score"],
        )

    return counts.mapInArrow(run, "no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of each item, all if fewer score above 0.

    Every row of `docs` is a document of its own, also with a repeated id; a null id comes
    last among equal scores. Rows of `items` with one id (or none) are one item with the
    terms of all its different rows. Null and empty texts have no terms and no results. A
    text or item of any length is counted whole.
    """
    spark = docs.sparkSession
    postings = item_terms(items, item)
    kind = postings.schema["item"].dataType
    parts, statistics = [], None
    # one row a block; a block is a bounded number of postings
    for block in sorted(r["block"] for r in postings.select("block").distinct().collect()):
        held = postings.where(F.col("block") == block)
        table, order = _number(held.select("item", "term", "n").toArrow())
        known = spark.sparkContext.broadcast(_Index(table))
        counts = materialize(_count(docs, known), "term-counts")
        if statistics is None:
            statistics = counts.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        pairs = counts.where("seen is not null").select(F.explode(F.arrays_zip("seen", "seen_in")).alias("p"))
        df = pairs.groupBy("p.seen").agg(F.sum("p.seen_in").alias("df")).toArrow()
        w = np.zeros(len(known.value.terms), np.int64)
        for t, d in zip(df.column("seen").to_pylist(), df.column("df").to_pylist(), strict=True):
            w[t] = weight(d, statistics["docs"])
        weights = spark.sparkContext.broadcast(w)
        best = _score(
            counts.where("n > 0").select("doc_id", "n", "terms", "tf"),
            known, weights, statistics["docs"], statistics["terms"], k,
        )
        names = spark.createDataFrame(
            pa.table({"no": pa.array(range(len(order)), pa.int64()), "item": order})
        ).withColumn("item", F.col("item").cast(kind))
        merged = merge(best, ["no"], k, "doc_id")
        # at most the items of a block
        parts.append(materialize(merged.join(F.broadcast(names), "no"), "best-documents"))
        weights.destroy()
        known.destroy()
    if not parts:
        parts.append(
            postings.where("false").select(
                "item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")
            )
        )
    found = reduce(DataFrame.unionByName, [p.select("item", "rank", "doc_id", "score") for p in parts])
    return found.withColumnRenamed("item", item)
