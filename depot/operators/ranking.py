"""Orders, running sums, top-k, latest values and retention."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from depot.functions.versions import parse_version
from depot.operators.durable import materialize, small_table


def order_by_version(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Newest version first. ``ties`` also let the sort split a very common version."""
    return df.orderBy(parse_version(column).desc_nulls_last(), *ties)


def distinct_versions(df: DataFrame, column: str) -> DataFrame:
    """Distinct version texts in ascending version order."""
    return df.select(column).distinct().orderBy(parse_version(column).asc_nulls_last(), column)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Greatest version per key. Text that is no version never wins."""
    best = df.groupBy(*keys).agg(F.max(parse_version(version)).alias("_best"))
    return best.select(*keys, F.col("_best.repr").alias(version))


def latest_pointer(snapshots: DataFrame, lo: int, hi: int, column: str = "snapshot") -> DataFrame:
    """The snapshot ``latest`` points to: the newest of all, if it is in the range.

    Gives one row; ``latest`` is null when the newest snapshot was not built, since the
    pointer then stays where it was.
    """
    newest = snapshots.agg(F.max(column).alias("newest"))
    return newest.select(
        "newest", F.when(F.col("newest").between(lo, hi), F.col("newest")).alias("latest")
    )


#: Rows that a task orders at a time, at most about: of a part of a running sum, and of the
#: range a budget ends in.
ROWS_IN_ORDER = 1_000_000
#: Ranges a budget's crossing range is cut into in a round, a power of two, and rows looked at for that.
RANGES, LOOKED_AT = 64, 1024


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """Running sum of ``value`` over the whole table in a unique ``order``.

    The table is range-partitioned into parts of a bounded number of rows. They are summed
    side by side, offsets are added from one row per part, and the window runs inside a
    part: no task sees the whole table. Parts are written with their numbers because a range
    exchange that is planned twice may cut at different points.
    """
    parts = -(-df.count() // ROWS_IN_ORDER) or 1
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(max(parts, min(cores, 4 * parts)), *order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "running-total")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).collect()  # one row per part
    offsets, total = [], 0
    for row in sorted(sums, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["_sum"] or 0
    base = small_table(df.sparkSession, offsets or [(0, 0)], "_part, _offset")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn(name, F.sum(value).over(inside))
        .join(base, "_part")
        .withColumn(name, (F.col(name) + F.col("_offset")).cast("bigint"))
        .drop("_part", "_offset")
    )


def positions(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Place of every row (from 1) in a unique ``order``, in its group if there are ``groups``.

    Places come from running sums over parts, so neither the table nor a group with a third
    of its rows is ordered in one task.
    """
    full = [*groups, *[c for c in order if c not in groups]]
    counted = running_total(df.withColumn("_one", F.lit(1)), full, "_one", name).drop("_one")
    if not groups:
        return counted
    first = counted.groupBy(*groups).agg(F.min(name).alias("_first"))
    return counted.join(first, list(groups)).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def version_positions(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Rows with their place by version, newest first; text that is no version comes last."""
    keyed = materialize(df.withColumn("_v", parse_version(column)), "versions")
    placed = positions(keyed, ["_v", *ties])
    return placed.withColumn("position", F.lit(keyed.count()) + 1 - F.col("position")).drop("_v")


def budget_prefix(df: DataFrame, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows in ``order`` up to the first one that would exceed ``budget`` bytes.

    The prefix ends at the first overflow even if later rows would fit; exactly the
    budget is kept. Sizes must be there and not negative, else this is an error, and
    ``order`` must be unique.

    The end is found by weighted selection: sizes are summed by ranges of the order, and
    only the range where the sum crosses the budget is cut again, at rows of it that
    hashing picks, until few enough rows are left to be ordered. A round is one scan whose
    sums are combined map-side. The result is a filter on ``df``: nothing is sorted or
    written, and the rows beyond the prefix are never moved.
    """
    schema = StructType([StructField(c, df.schema[c].dataType) for c in order])
    kinds = [f.dataType for f in schema]
    key = F.struct(*order)

    def point(values: Sequence) -> Column:
        columns = [F.lit(v).cast(k).alias(c) for c, v, k in zip(order, values, kinds, strict=True)]
        return F.struct(*columns)

    def picked(rows: DataFrame, groups: Sequence[Column], many: int) -> list:
        """Sums of groups, each with a row of it that stands for its place in the order."""
        hashed = rows.select(F.xxhash64(*order).alias("_h"), *[c for c in dict.fromkeys([*order, size])], *groups)
        return (
            hashed.groupBy(*[c for c in hashed.columns if c.startswith("_g")], F.pmod("_h", F.lit(many)).alias("_m"))
            .agg(
                F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("sum"),
                F.count_if(F.col(size).isNull() | (F.col(size) < 0)).alias("bad"),
                F.min_by(key, F.struct("_h", *order)).alias("row"),
            )
            .collect()
        )

    inside, left = df, budget
    found = picked(df, [], LOOKED_AT)
    if bad := sum(r["bad"] for r in found):
        raise ValueError(f"{bad} rows have no usable {size}")
    if sum(r["sum"] for r in found) <= budget:
        return df
    while sum(r["n"] for r in found) > ROWS_IN_ORDER:
        before = len(found), sum(r["n"] for r in found)
        rows = _in_order(df.sparkSession, [r["row"] for r in found], schema)
        edges = [rows[k * len(rows) // RANGES] for k in range(1, RANGES)]
        edges = [e for e, last in zip(edges, [None, *edges], strict=False) if e != last]
        group = _range_number(key, [point(e) for e in edges], 0)
        by_range: dict[int, list] = {}
        for r in picked(inside, [group.alias("_g")], LOOKED_AT // RANGES):
            by_range.setdefault(r["_g"], []).append(r)
        for crossing in sorted(by_range):
            total = sum(r["sum"] for r in by_range[crossing])
            if total > left:
                break
            left -= total
        found = by_range[crossing]
        if crossing > 0:
            inside = inside.where(key >= point(edges[crossing - 1]))
        if crossing < len(edges):
            inside = inside.where(key < point(edges[crossing]))
        if before == (len(found), sum(r["n"] for r in found)):  # equal rows, against the contract
            break
    # few rows: one task orders them
    run = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    over = inside.select(*order, run.alias("_run")).where(F.col("_run") > left)
    first = over.agg(F.min(key).alias("row")).first()["row"]
    return df.where(key < point(first))


def _in_order(spark: SparkSession, rows: list, schema: StructType) -> list:
    """A few collected rows in Spark's order of them (nulls first), which Python's need not be."""
    table = spark.createDataFrame(rows, schema)
    return table.orderBy(*table.columns).collect()


def _range_number(key: Column, edges: list[Column], first: int) -> Column:
    """How many edges are at or below ``key``, by halving."""
    if not edges:
        return F.lit(first)
    half = len(edges) // 2
    return F.when(key < edges[half], _range_number(key, edges[:half], first)).otherwise(
        _range_number(key, edges[half + 1 :], first + half + 1)
    )


def top_k(
    events: DataFrame, k: int, key: str = "url", size: str = "size", by: str = "requests"
) -> DataFrame:
    """The ``k`` most requested keys with their bytes; ties go by key."""
    demand = events.groupBy(key).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    )
    return demand.orderBy(F.desc(by), key).limit(k)


def top_k_per_group(
    demand: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first ``k`` rows of every group as ``rank`` 1..k.

    The rank filter is applied inside every map task before the shuffle, so a hot
    group sends at most ``k`` rows per task.
    """
    ranked = Window.partitionBy(*groups).orderBy(*order)
    return demand.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def pick_asset(
    assets: DataFrame,
    keys: Sequence[str],
    position: str,
    asset: Sequence[str],
    predicate: Column | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """First asset per key by ``position`` among those that match ``predicate``.

    A key without a match fails the job (``error``), stays with nulls (``null``) or is
    left out (``drop``). Equal positions are decided by the asset itself.
    """
    ranked = F.struct(position, *[c for c in asset if c != position])
    first = F.min(F.when(predicate, ranked) if predicate is not None else ranked)
    best = assets.groupBy(*keys).agg(first.alias("_a"))
    if on_missing == "drop":
        best = best.where(F.col("_a").isNotNull())
    elif on_missing == "error":
        text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
        best = best.where(
            F.when(F.col("_a").isNotNull(), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("no matching asset for "), text)).cast("boolean")
            )
        )
    return best.select(*keys, *[F.col("_a").getField(c).alias(c) for c in asset])


def expired(df: DataFrame, min_id: int, column: str = "snapshot") -> DataFrame:
    """Snapshots below the lowest one to keep."""
    return df.where(F.col(column) < min_id)


def beyond_newest(df: DataFrame, family: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """Rows of every family that are older than its newest ``keep``.

    ``order`` (ascending age marks, unique per family) is cut at the ``keep``-th newest
    row, which a ranked filter finds without gathering a family; older rows then come
    from a join on the family.
    """
    newest = Window.partitionBy(*family).orderBy(*[F.desc(c) for c in order])
    edge = (
        df.select(*family, *order)
        .withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= keep)
        .groupBy(*family)
        .agg(F.min(F.struct(*order)).alias("_edge"))
    )
    return df.join(edge, list(family)).where(F.struct(*order) < F.col("_edge")).drop("_edge")


def stale(df: DataFrame, now: Column, ttl_seconds: int, mtime: str = "mtime") -> DataFrame:
    """Rows not refreshed within the interval; a mark in the future counts by distance."""
    age = F.abs(F.unix_timestamp(now) - F.unix_timestamp(F.col(mtime)))
    return df.where(F.col(mtime).isNull() | (age >= ttl_seconds))
