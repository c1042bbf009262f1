"""Snapshot and environment diffs, last-value-wins, set operations on names.

Two tables with the same keys are compared by tagging, uniting and aggregating them:
one shuffle, combined map-side, so a key holding a third of all rows costs one row per
map task. A full outer join would need both sides sorted and cannot be split when a
key is hot.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depot.operators.durable import materialize

ONLY_LEFT, ONLY_RIGHT, CHANGED = "only_left", "only_right", "changed"


def last_wins(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the one greatest in ``order``, ties broken by the values."""
    values = [c for c in df.columns if c not in keys] if values is None else list(values)
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])
    best = df.groupBy(*keys).agg(F.max(ranked).alias("_best"))
    return best.select(*keys, *[F.col("_best").getField(c).alias(c) for c in values])


def presence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of both tables with ``in_left`` / ``in_right``."""
    left = a.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    right = b.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    seen = left.unionByName(right).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.select(
        *keys, (F.col("_l") == 1).alias("in_left"), (F.col("_r") == 1).alias("in_right")
    )


def diff_envs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("env",)) -> DataFrame:
    """Every environment of either side as ``removed``, ``added`` or ``common``."""
    status = (
        F.when(F.col("in_left") & F.col("in_right"), F.lit("common"))
        .when(F.col("in_left"), F.lit("removed"))
        .otherwise(F.lit("added"))
    )
    return presence(a, b, keys).select(*keys, status.alias("status"))


def _sides(tagged: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Fold rows tagged ``_side`` 0 / 1 into one row per key with both values."""
    if not order:
        # plain columns keep a numeric value inside hash aggregation
        def seen(i: int) -> Column:
            return F.coalesce(F.max(F.when(F.col("_side") == i, True)), F.lit(False))

        def best(i: int) -> Column:
            return F.max(F.when(F.col("_side") == i, F.col(value)))

        return tagged.groupBy(*keys).agg(
            seen(0).alias("_in_l"),
            seen(1).alias("_in_r"),
            best(0).alias("left_value"),
            best(1).alias("right_value"),
        )
    picked = F.struct(*[F.col(c) for c in order], F.col(value).alias("_value"))

    def side(i: int) -> Column:
        return F.max(F.when(F.col("_side") == i, picked))

    folded = tagged.groupBy(*keys).agg(side(0).alias("_l"), side(1).alias("_r"))
    return folded.select(
        *keys,
        F.col("_l").isNotNull().alias("_in_l"),
        F.col("_r").isNotNull().alias("_in_r"),
        F.col("_l._value").alias("left_value"),
        F.col("_r._value").alias("right_value"),
    )


def _changes(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    status = (
        F.when(~F.col("_in_r"), F.lit(ONLY_LEFT))
        .when(~F.col("_in_l"), F.lit(ONLY_RIGHT))
        .otherwise(F.lit(CHANGED))
    )
    # a missing key is a difference even when the other side's value is null
    differs = (F.col("_in_l") != F.col("_in_r")) | ~F.col("left_value").eqNullSafe(
        F.col("right_value")
    )
    return folded.where(differs).select(
        *keys, status.alias("status"), "left_value", "right_value"
    )


def diff_snapshots(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str] = (),
    within: Sequence[str] = (),
) -> DataFrame:
    """Rows that differ between two snapshots, one per key.

    ``order`` decides which row of a repeated key counts (the greatest). ``within``
    names the key columns (such as ``env``) that must occur on both sides: other
    environments are a matter for :func:`diff_envs`.
    """
    cols = list(dict.fromkeys([*keys, *order, value]))
    left = a.select(*cols, F.lit(0).alias("_side"))
    right = b.select(*cols, F.lit(1).alias("_side"))
    result = _changes(_sides(left.unionByName(right), keys, value, order), keys)
    if not within:
        return result
    common = presence(a, b, within).where("in_left AND in_right").select(*within)
    return result.join(common, list(within), "left_semi")


def diff_chain(
    df: DataFrame,
    snapshot: str,
    keys: Sequence[str],
    value: str,
    order: Sequence[str] = (),
    within: Sequence[str] = (),
) -> DataFrame:
    """Diff of every snapshot against the next one there is.

    Ids may have gaps: the place of a snapshot is that among the distinct ids. Rows cross once
    to become one row per snapshot and key, and that row once more to its key, where it meets
    the snapshots beside it; a key has at most one row a snapshot there. Environments (of
    ``within``) that a neighbouring snapshot lacks are written first: they are few as a rule,
    and a table of known size, so that the diff need not be shuffled to leave them out.
    """
    within = list(within)
    seen = materialize(
        df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_id"), *within).distinct(),
        "chain-seen",
    )
    # ids are as few as snapshots
    ids = seen.agg(F.array_sort(F.collect_set("_id"))).scalar()
    rows = _all_set(df, [snapshot, *within])
    picked = F.struct(*[F.col(c) for c in order], F.col(value).alias("_value")) if order else F.col(value)
    best = rows.groupBy(F.col(snapshot).alias("_id"), *keys).agg(F.max(picked).alias("_best"))
    last = F.col("_best._value") if order else F.col("_best")
    placed = best.select(*keys, F.array_position(ids, F.col("_id")).alias("_i"), last.alias("_value"))
    nothing = F.lit(None).cast(placed.schema["_value"].dataType)
    after = F.when(F.col("_with_next"), F.col("_next_value"))
    left = F.struct(
        F.col("_i").alias("_pair"),
        F.when(F.col("_with_next"), F.lit(CHANGED)).otherwise(F.lit(ONLY_LEFT)).alias("status"),
        F.col("_value").alias("left_value"),
        after.alias("right_value"),
    )
    right = F.struct(
        (F.col("_i") - 1).alias("_pair"),
        F.lit(ONLY_RIGHT).alias("status"),
        nothing.alias("left_value"),
        F.col("_value").alias("right_value"),
    )
    same = F.col("_with_next") & F.col("_value").eqNullSafe(F.col("_next_value"))
    entries = F.array(
        F.when((F.col("_i") < F.size(ids)) & ~same, left),
        F.when((F.col("_i") > 1) & ~F.col("_with_last"), right),
    )
    result = (
        _beside(placed, keys, "_value")
        .select(*keys, F.explode(entries).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select("_e._pair", *keys, "_e.status", "_e.left_value", "_e.right_value")
    )
    if within:
        envs = _all_set(seen, within).select(*within, F.array_position(ids, F.col("_id")).alias("_i"))
        # the last snapshot's own pair and the one before the first never come up
        alone = F.array(
            F.when(~F.col("_with_next"), F.col("_i")), F.when(~F.col("_with_last"), F.col("_i") - 1)
        )
        lacking = _beside(envs, within).select(*within, F.explode(alone).alias("_pair"))
        lacking = materialize(
            lacking.where(F.col("_pair").between(1, F.size(ids) - 1)).distinct(), "chain-lacking"
        )
        result = result.join(lacking, ["_pair", *within], "left_anti")
    return result.select(
        F.get(ids, (F.col("_pair") - 1).cast("int")).alias(snapshot),
        *keys,
        "status",
        "left_value",
        "right_value",
    )


def _all_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def _beside(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Add the ``values`` that ``by`` has at its next place, and whether it has the places beside ``_i``."""
    places = Window.partitionBy(*by).orderBy("_i")
    both = df.withColumns(
        {
            "_last": F.lag("_i").over(places),
            "_next": F.lead("_i").over(places),
            **{f"_next{v}": F.lead(v).over(places) for v in values},
        }
    )
    return both.withColumns(
        {
            "_with_last": F.coalesce(F.col("_last") == F.col("_i") - 1, F.lit(False)),
            "_with_next": F.coalesce(F.col("_next") == F.col("_i") + 1, F.lit(False)),
        }
    )


def union_names(*frames: DataFrame) -> DataFrame:
    """Distinct union of name sets."""
    return reduce(DataFrame.unionByName, frames).distinct()


def common_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return presence(a, b, a.columns).where("in_left AND in_right").select(*a.columns)


def names_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return presence(a, b, a.columns).where("in_left AND NOT in_right").select(*a.columns)
