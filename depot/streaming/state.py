"""Incremental jobs on versioned state tables: cache sync and latest object per key."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depot.operators.cache import STATE_SCHEMA, new_state, plan_sync
from depot.operators.ranking import budget_prefix
from depot.sinks.log import Conflict, Log, Version
from depot.streaming.runs import stream_run

#: Buckets of a state by key, and folders a bucket may have before they are merged into one.
BUCKETS, FOLDERS = 16, 8


def _done(version: Version, run: str, batch_id: int) -> bool:
    """Whether the batch is in. Batch ids alone start again with every checkpoint."""
    return version.runs.get(run, -1) >= batch_id


def _follows(last: int) -> Callable[[Version], None]:
    def against(version: Version) -> None:
        if version.number != last:
            raise Conflict(f"version {version.number} came between this batch and the state it has read")

    return against


def sync_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    budget: int,
    listing: Callable[[], DataFrame] | None = None,
    run: str | None = None,
) -> None:
    """One sync run: plan against the state before this batch, store plan and state as one version.

    ``batch`` holds feeds ``(feed_time, rank, url, size, etag)``; the newest one counts, and
    only if it is newer than the feed the state was made from, so a late feed cannot roll
    the cache back. ``listing`` gives the files present, by default those of the stored
    state. A batch of the same ``run`` that was committed before changes nothing. The state
    is written once and the plan made from what was written. If another writer commits
    meanwhile, the batch fails and is tried again by its stream.
    """
    spark = batch.sparkSession
    run = run or stream_run(spark)
    log = Log(spark, root)
    last = log.at()
    if _done(last, run, batch_id):
        return
    mark = last.notes.get("mark")
    if mark is not None:
        batch = batch.where(F.col("feed_time") > F.lit(mark).cast(batch.schema["feed_time"].dataType))
    newest = batch.agg(F.max("feed_time").alias("t"), F.max("feed_time").cast("string").alias("m")).first()
    if newest["t"] is None:  # nothing new arrived: an empty feed must not empty the cache
        return
    feed = batch.where(F.col("feed_time") == F.lit(newest["t"])).select("rank", "url", "size", "etag")
    old = log.read(STATE_SCHEMA, last)
    present = listing() if listing else old.select(F.col("hash").alias("name"), "size")
    state, plan = log.new_folder(), log.new_folder()
    chosen = budget_prefix(feed, ["rank", "url"], "size", budget)
    new_state(chosen).write.parquet(log.folder(state))
    written = spark.read.schema(STATE_SCHEMA).parquet(log.folder(state))
    plan_sync(present, old, written).write.parquet(log.folder(plan))
    entry = {
        "replace_all": True,
        "put": {"all": [state]},
        "runs": {run: batch_id},
        "notes": {"mark": newest["m"], "plan folder": plan},
    }
    log.commit(entry, _follows(last.number))


def sync_plans(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The plan that led to a version of the cache state, the newest by default."""
    log = Log(spark, root)
    return spark.read.parquet(log.folder(log.at(version).notes["plan folder"]))


def stream_sync(
    feeds: DataFrame,
    root: str,
    budget: int,
    checkpoint: str,
    listing: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Run :func:`sync_batch` on every arriving feed."""
    return (
        feeds.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: sync_batch(df, i, root, budget, listing))
        .start()
    )


def latest_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    run: str | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Fold a batch into the latest row per key, and store which keys it changed.

    ``order`` decides which row is the latest; a key is changed when it is new or its
    ``values`` differ from the version before. The state is kept in ``buckets`` by a hash of
    the key (the number is fixed by the table's first batch). A batch is reduced to a row a
    key, meets only the buckets its keys fall into, and adds only its newer rows to them, as
    a folder more; a bucket of many folders is merged into one. So what a batch writes
    follows the batch, and what it reads the buckets it touches, whatever the state's size.
    """
    spark = batch.sparkSession
    run = run or stream_run(spark)
    log = Log(spark, root)
    last = log.at()
    if _done(last, run, batch_id):
        return
    buckets = int(last.notes.get("buckets", buckets))
    cols = [*keys, *order, *values]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*cols).schema)
    ranked = F.struct(*order, *values)
    best = batch.groupBy(*keys).agg(F.max(ranked).alias("_n"))
    stage = log.new_folder()
    arrived = best.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), *keys, "_n")
    arrived.write.parquet(log.folder(stage))
    arrived = spark.read.schema(arrived.schema).parquet(log.folder(stage))
    touched = sorted(str(r["_bucket"]) for r in arrived.select("_bucket").distinct().collect())
    old = log.read(schema, last, touched).select(*keys, ranked.alias("_o"))
    none = F.lit(None).cast(arrived.schema["_n"].dataType)
    folded = (
        old.select(*keys, "_o", none.alias("_n"))
        .unionByName(arrived.select(*keys, none.alias("_o"), "_n"))
        .groupBy(*keys)
        .agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    )
    newer = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.col("_n") > F.col("_o")))
    same = F.lit(True)
    for c in values:
        same = same & F.col("_o").getField(c).eqNullSafe(F.col("_n").getField(c))
    changed = F.col("_o").isNull() | ~same
    rows = folded.where(newer).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"),
        *keys,
        *[F.col("_n").getField(c).alias(c) for c in [*order, *values]],
        changed.alias("changed"),
    )
    # written once, with what changed marked: the batch's changes are these rows
    added = log.new_folder()
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(log.folder(added))
    fresh = {b: [f"{added}/_bucket={b}"] for b in log.staged(added, "_bucket")}
    full = [b for b in fresh if len(last.parts.get(b, [])) >= FOLDERS]
    entry = {
        "put": _merged(log, last, full, fresh, schema, keys, ranked) if full else {},
        "add": {b: folders for b, folders in fresh.items() if b not in full},
        "runs": {run: batch_id},
        "notes": {"changes folder": added, "buckets": str(buckets), "schema": schema},
    }
    log.commit(entry, _follows(last.number))


def _merged(
    log: Log, last: Version, full: list[str], added: dict, schema: str, keys: Sequence[str], ranked: Column
) -> dict:
    """Buckets of many folders as one folder each, the batch's own included."""
    spark = log.spark
    names = [f for b in full for f in [*last.parts[b], *added[b]]]
    rows = spark.read.schema(schema).parquet(*[log.folder(n) for n in names])
    best = rows.groupBy(*keys).agg(F.max(ranked).alias("_w"))
    buckets = F.pmod(F.xxhash64(*keys), F.lit(int(last.notes["buckets"]))).cast("int")
    stage = log.new_folder()
    whole = best.select(buckets.alias("_bucket"), *keys, "_w.*")
    whole.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(log.folder(stage))
    return {b: [f"{stage}/_bucket={b}"] for b in full}


def changes(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Keys that version ``version`` of :func:`stream_latest` changed, with their new rows."""
    log = Log(spark, root)
    notes = log.at(version).notes
    # the schema is noted, since a batch may have added no row
    rows = spark.read.schema(f"{notes['schema']}, changed boolean").parquet(log.folder(notes["changes folder"]))
    return rows.where("changed").drop("changed", "_bucket")


def latest_state(
    spark: SparkSession, root: str, schema: str, keys: Sequence[str], version: int | None = None
) -> DataFrame:
    """The latest row per key as of a version; ``schema`` names the keys, then order and values."""
    log = Log(spark, root)
    rows = log.read(schema, log.at(version))  # a key has a row in each folder that changed it
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_w"))
    return best.select(*keys, "_w.*")


def stream_latest(
    rows: DataFrame,
    root: str,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    checkpoint: str,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the latest object per key up to date from a stream."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: latest_batch(df, i, root, keys, order, values, buckets=buckets))
        .start()
    )
