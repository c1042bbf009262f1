"""Bounded best entries of many groups, kept in arrays inside a task and merged in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lower than every score.
NO_SCORE = np.iinfo(np.int64).min


class Heaps:
    """The `k` best entries of each group: higher scores first, ties by smaller id, null ids last.

    Entries are appended and cut back to `k` a group when they have become several times as
    many. `least` holds the score an entry of a group must at least have to be worth adding.
    """

    def __init__(self, groups: int, k: int):
        self.k, self.limit = k, 4 * k * max(groups, 256)
        self.least = np.full(groups, NO_SCORE, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(group):
            self.held.append((group, score, ids, null))
            self.n += len(group)
            if self.n > self.limit:
                self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        group, score, ids, null = (np.concatenate(p) for p in zip(*self.held, strict=True))
        # ~score orders descending for every long, unlike -score
        order = np.lexsort((ids, null, ~score, group))
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        places = np.arange(len(g))
        rank = places - np.maximum.accumulate(np.where(new, places, 0))
        last = order[rank == self.k - 1]
        self.least[group[last]] = score[last]
        best = order[rank < self.k]
        self.held = [(group[best], score[best], ids[best], null[best])]
        self.n = len(best)

    def entries(self) -> tuple[np.ndarray, ...]:
        """group, score, id, whether the id is null, of what is left."""
        self.cut()
        if not self.held:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        return self.held[0]


def merge(entries: DataFrame, groups: list[str], k: int, ids: str, fan_in: int = 64) -> DataFrame:
    """The `k` best of entries from many tasks, with `rank` from 1.

    Tasks' entries meet in `fan_in` parts of a group first, so a group that every task has
    entries of is not sorted in one task.
    """
    order = [F.col("score").desc(), F.col(ids).asc_nulls_last()]
    parts = entries.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    for keys in ([*groups, "_part"], groups):
        window = Window.partitionBy(*keys).orderBy(*order)
        parts = parts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return parts.drop("_part")
