"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item gives one pattern for every window of its words. The search looks at the
block of words at the end of a window: the shift table says how far the window can move if
no pattern has that block nearer to its end, so most words of a text are never looked at.
Where the shift is zero, the bucket of patterns that end with the block is compared with
the text, word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.texts import field_rows, plain_words, rows, whole
from depot.operators.durable import materialize

#: Words of a block.
BLOCK = 2
#: Patterns searched for in one pass over the documents; the tables of more would not be
#: sure to fit in a worker, so they take further passes. About 300 bytes each.
PATTERNS = 200_000


class WuManber:
    """Finds patterns of one length, in words."""

    def __init__(self, size: int, patterns: dict[tuple, dict]):
        self.size, self.patterns = size, patterns
        self.block = min(BLOCK, size)
        self.far = size - self.block + 1
        self.shift: dict[tuple, int] = {}
        # by the block at the end, then by the words at the beginning (the prefix table)
        self.bucket: dict[tuple, dict[tuple, set[tuple]]] = defaultdict(dict)
        for pattern in patterns:
            for end in range(self.block, size + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), size - end)
            ending = self.bucket[pattern[size - self.block :]]
            ending.setdefault(pattern[: self.block], set()).add(pattern)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """Start and pattern of every occurrence."""
        n, size, far, shift = len(words), self.size, self.far, self.shift.get
        pair = self.block == 2
        end = size
        while end <= n:
            block = (words[end - 2], words[end - 1]) if pair else (words[end - 1],)
            step = shift(block, far)
            if step:
                end += step
                continue
            start = end - size
            begins = self.bucket[block].get(tuple(words[start : start + self.block]))
            if begins and (found := tuple(words[start:end])) in begins:
                yield start, found
            end += 1


def item_patterns(text: str | None, window: int) -> list[tuple]:
    words = plain_words(text)
    size = min(window, len(words))
    if not size:
        return []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def _searches(benchmark: DataFrame, window: int, most: int) -> Iterator[list[WuManber]]:
    """Search tables for the benchmark, for `most` patterns at a time; a long item is cut over several."""
    sizes: dict[int, dict[tuple, dict]] = defaultdict(dict)
    held = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        for pattern in item_patterns(text, window):
            sizes[len(pattern)].setdefault(pattern, {})[item] = None
            held += 1
            if held >= most:
                yield [WuManber(k, v) for k, v in sizes.items()]
                sizes, held = defaultdict(dict), 0
    if held:
        yield [WuManber(k, v) for k, v in sizes.items()]


def search(words: list[bytes], searches: list[WuManber]) -> tuple[np.ndarray, set]:
    """Which words lie in an occurrence, and the items whose patterns occur."""
    edges, items = np.zeros(len(words) + 1, np.int64), set()
    for table in searches:
        for start, pattern in table.find(words):
            edges[start] += 1
            edges[start + table.size] -= 1
            items.update(table.patterns[pattern])
    return np.cumsum(edges[:-1]) > 0, items


def _through(docs: DataFrame, benchmark: DataFrame, window: int, most: int, step: Callable) -> DataFrame:
    """The documents after a pass for each block of patterns.

    A pass that another one follows is written and its block released, so that no task ever
    holds the tables of two blocks.
    """
    held = None
    for searches in _searches(benchmark, window, most):
        if held is not None:
            docs = materialize(docs, "searched")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(searches)
        docs = step(docs, held)
    return docs


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, patterns: int = PATTERNS
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A document word is hit if it lies in an occurrence of `window` consecutive item words, or
    of a whole shorter item. Null texts have no words; items without words never occur; rows
    with equal item ids are one item, and a null item id sorts as an empty string. The
    benchmark is read in bounded blocks, each sent to the workers for one pass.
    """
    schema = "doc_id long, text string, _hits binary, _items array<string>"

    def step(found: DataFrame, held) -> DataFrame:
        def scan(batches):
            for ids, texts, hits, items in rows(batches, "doc_id", "text", "_hits", "_items"):
                new_hits, new_items = [], []
                for text, old, known in zip(texts, hits, items, strict=True):
                    hit, more = search(plain_words(text), held.value)
                    if old:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(hit)).astype(bool)
                    new_hits.append(np.packbits(hit).tobytes() if hit.any() else None)
                    known = set(known or ()) | {"" if i is None else str(i) for i in more}
                    new_items.append(sorted(known))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(texts, pa.string()),
                        pa.array(new_hits, pa.binary()),
                        pa.array(new_items, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "_hits", "_items"],
                )

        return found.mapInArrow(scan, schema)

    start = docs.select(
        "doc_id",
        "text",
        F.lit(None).cast("binary").alias("_hits"),
        F.lit(None).cast("array<string>").alias("_items"),
    )

    def digest(batches):
        for ids, texts, hits, items in rows(batches, "doc_id", "text", "_hits", "_items"):
            n_hit = [sum(b.bit_count() for b in h or b"") for h in hits]
            lists = [i or [] for i in items]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(plain_words(t)) for t in texts], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for i in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in lists]),
                    pa.array([n > 0 for n in n_hit]),
                    pa.array(lists, pa.list_(pa.string())),
                ],
                names=DIGEST,
            )

    return _through(start, benchmark, window, patterns, step).mapInArrow(
        digest,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean, item_ids array<string>",
    )


DIGEST = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, patterns: int = PATTERNS
) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""

    def step(kept: DataFrame, held) -> DataFrame:
        def scan(batches):
            for part, texts in field_rows(batches):
                clean = [not _occurs(plain_words(t), held.value) for t in texts]
                yield part.filter(pa.array(clean, pa.bool_()))

        return kept.mapInArrow(scan, kept.schema)

    return _through(whole(docs), benchmark, window, patterns, step).select("doc.*")


def _occurs(words: list[bytes], searches: list[WuManber]) -> bool:
    return any(next(table.find(words), None) is not None for table in searches)
