"""Demand per time window, and the top of every closed window."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depot.functions import fixed
from depot.functions.urls import normalize_url
from depot.operators.ranking import top_k_per_group
from depot.sinks.log import Conflict, Log, Version
from depot.streaming.runs import stream_run


def demand(
    events: DataFrame,
    window: str = "1 day",
    delay: str | None = "1 day",
    hosts: Sequence[str] = tuple(fixed.PRESIGNED_HOSTS),
) -> DataFrame:
    """Requests and bytes per tumbling window, source and normalised URL.

    The same frame serves a stream and a batch. With ``delay``, events later than it
    are dropped and closed windows leave the state.
    """
    if delay is not None:
        events = events.withWatermark("event_time", delay)
    return (
        events.withColumn("url", normalize_url("url", hosts))
        .groupBy(F.window("event_time", window), "source", "url")
        .agg(F.count("*").alias("requests"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "source",
            "url",
            "requests",
            "bytes",
        )
    )


def route_share(demand_rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Requests of every window in total and by source, and the shares in per mille."""
    per = [
        F.coalesce(F.sum(F.when(F.col("source") == s, F.col("requests"))), F.lit(0)).alias(
            f"requests_{s}"
        )
        for s in sources
    ]
    totals = demand_rows.groupBy("window_start").agg(F.sum("requests").alias("requests"), *per)
    return totals.select(
        "*",
        *[
            F.expr(f"1000 * requests_{s} div requests").alias(f"permille_{s}") for s in sources
        ],
    )


def window_top_k(demand_rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` most requested URLs of every window, all sources together."""
    per_url = demand_rows.groupBy("window_start", "url").agg(
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes")
    )
    return top_k_per_group(
        per_url, ["window_start"], [F.desc("requests"), F.desc("bytes"), F.asc("url")], k
    )


def append_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    mode: str = "append",
) -> StreamingQuery:
    """Run a stream over what is available, one folder per stream run and micro-batch.

    A batch that is replayed overwrites its own folder, so results count once; a stream
    with a new checkpoint writes beside what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = stream_run(batch.sparkSession)
        transform(batch).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def stream_demand(demand_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows of :func:`demand`."""
    return append_batches(demand_stream, path, checkpoint)


def stream_top_k(demand_stream: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Top ``k`` of every window once it is closed.

    A window closes for all its URLs in one batch, so ranking the batch is final.
    """
    return append_batches(demand_stream, path, checkpoint, lambda df: window_top_k(df, k))


def late_batch(
    batch: DataFrame, batch_id: int, root: str, window: str, delay: str, run: str | None = None
) -> None:
    """Store the events of a batch that :func:`demand` with the same window and delay drops.

    An event is late if its window had closed before the batch came: if the window ends at
    or before the watermark, the latest time of all batches before less the delay. The
    watermark is noted in the log with the batch, so a replayed batch is judged as before
    and a new checkpoint goes on from it.
    """
    spark = batch.sparkSession
    run = run or stream_run(spark)
    log = Log(spark, root)
    last = log.at()
    if last.runs.get(run, -1) >= batch_id:
        return
    mark = last.notes.get("latest")
    none = F.lit(None).cast("timestamp")
    before = none if mark is None else F.timestamp_micros(F.lit(int(mark)))
    closed = F.window("event_time", window)["end"] <= before - F.expr(f"INTERVAL {delay}")
    stage = log.new_folder()
    batch.where(closed).write.parquet(log.folder(stage))
    newest = batch.agg(F.unix_micros(F.max("event_time")).alias("t")).first()["t"]
    latest = max((int(t) for t in (mark, newest) if t is not None), default=None)
    notes = {} if latest is None else {"latest": str(latest)}

    def against(version: Version) -> None:
        if version.number != last.number:
            raise Conflict(f"version {version.number} came between this batch and the watermark it has read")

    log.commit({"add": {"late": [stage]}, "runs": {run: batch_id}, "notes": notes}, against)


def stream_late(
    events: DataFrame, root: str, window: str, delay: str, checkpoint: str
) -> StreamingQuery:
    """Keep the late events of a stream beside the demand of the others.

    It is to take the same events in the same batches as the demand.
    """
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: late_batch(df, i, root, window, delay))
        .start()
    )


def late_events(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All late events so far."""
    return Log(spark, root).read(schema)


def watermark(spark: SparkSession, root: str, delay: str) -> Column:
    """The watermark that :func:`stream_late` has come to."""
    mark = Log(spark, root).at().notes.get("latest")
    at = F.lit(None).cast("timestamp") if mark is None else F.timestamp_micros(F.lit(int(mark)))
    return at - F.expr(f"INTERVAL {delay}")


def accounts(events: DataFrame, closed: DataFrame, late: DataFrame, window: str, mark: Column) -> DataFrame:
    """What became of all events, by source: in closed windows, in open ones, late.

    ``events`` are all, ``closed`` the demand that was given out, ``late`` what was dropped,
    ``mark`` the watermark. Open are the events of windows that end after it, none of which
    can be late. The three add up to ``events`` exactly if nothing was lost.
    """
    zero = F.lit(0).cast("bigint")

    def counted(df: DataFrame, name: str, n: Column) -> DataFrame:
        names = ("events", "closed", "open", "late")
        return df.groupBy("source").agg(n.alias("_n")).select(
            "source", *[(F.col("_n") if c == name else zero).alias(c) for c in names]
        )

    opened = F.coalesce(F.window("event_time", window)["end"] > mark, F.lit(True))
    rows = [
        counted(events, "events", F.count("*")),
        counted(events.where(opened), "open", F.count("*")),
        counted(closed, "closed", F.sum("requests")),
        counted(late, "late", F.count("*")),
    ]
    sums = [F.sum(c).alias(c) for c in ("events", "closed", "open", "late")]
    return reduce(DataFrame.unionByName, rows).groupBy("source").agg(*sums)
