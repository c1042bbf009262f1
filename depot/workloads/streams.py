"""Streaming jobs over the given tables; each runs to the end of what is available."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.operators.durable import run_dir
from depot.sources.events import flatten_events
from depot.streaming.demand import (
    accounts,
    demand,
    late_events,
    stream_demand,
    stream_late,
    stream_top_k,
    watermark,
)
from depot.streaming.state import changes, stream_latest, stream_sync, sync_plans
from depot.workloads.tables import CUT, OBJECTS_SQL, part_objects, table


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of downloads: the user's file, as large as the value in cents."""
    schema = table(spark, sf, "events").schema
    # a pattern, since a file stream takes a folder or a pattern but no single file
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return flatten_events(
        raw.select(
            F.col("event_type").alias("source"),
            F.lit("download").alias("type"),
            F.struct(
                F.concat(F.lit("https://h/u/"), "user_id").alias("url"),
                F.round(F.col("value") * 100).cast("bigint").alias("size"),
            ).alias("data"),
            F.col("ts").cast("timestamp").alias("event_time"),
        )
    )


def _local_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_demand_query(spark: SparkSession, sf: str) -> DataFrame:
    """Demand per day, source and user for the days the watermark has closed."""
    root = run_dir(spark, "stream-demand")
    rows = demand(_event_stream(spark, sf), "1 day", "1 day")
    stream_demand(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _local_time(
        spark.read.parquet(f"{root}/out").drop("run", "batch"), "window_start", "window_end"
    )


_CLOSED = "e <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
STREAM_DEMAND = f"""
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type AS source, 'https://h/u/' || user_id AS url, count(*) AS requests,
       sum(round(value * 100)::BIGINT)::BIGINT AS bytes
FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS e FROM events) WHERE {_CLOSED} GROUP BY 1, 2, 3, 4"""


def stream_top_k_query(spark: SparkSession, sf: str) -> DataFrame:
    """The three most requested users of every closed 12-hour window."""
    root = run_dir(spark, "stream-top-k")
    rows = demand(_event_stream(spark, sf), "12 hours", "1 day")
    stream_top_k(rows, 3, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _local_time(spark.read.parquet(f"{root}/out").drop("run", "batch"), "window_start")


STREAM_TOP_K = """
WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR
                  ELSE INTERVAL 0 HOUR END AS s, 'https://h/u/' || user_id AS url, value FROM events),
d AS (SELECT s AS window_start, url, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS bytes
      FROM w WHERE s + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY requests DESC, bytes DESC, url) AS rank
FROM d QUALIFY rank <= 3"""


def _feed(spark: SparkSession, sf: str, old: bool) -> DataFrame:
    return part_objects(spark, sf, old).select(
        F.lit(0 if old else 1).alias("feed_time"),
        (-F.col("requests")).alias("rank"),
        "url",
        "size",
        "etag",
    )


def stream_sync_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds arrive one after the other; the plan of the second run.

    The budget is 60 % of the second feed's bytes.
    """
    root = run_dir(spark, "stream-sync")
    later = _feed(spark, sf, old=False)
    budget = later.agg(F.sum("size").alias("s")).first()["s"] * 3 // 5
    for feed in (_feed(spark, sf, old=True), later):
        feed.write.mode("append").parquet(f"{root}/feeds")
        arriving = spark.readStream.schema(feed.schema).parquet(f"{root}/feeds")
        stream_sync(arriving, root, budget, f"{root}/checkpoint").awaitTermination()
    return sync_plans(spark, root, 1)


STREAM_SYNC = f"""
WITH {OBJECTS_SQL},
feed AS (SELECT *, sum(size) OVER (PARTITION BY old ORDER BY requests DESC, url ROWS UNBOUNDED PRECEDING) AS run
         FROM objects),
chosen AS (SELECT old, sha256(url) AS hash, url, size, etag FROM feed
           WHERE run <= (SELECT sum(size) * 3 // 5 FROM objects WHERE NOT old)),
p AS (SELECT * FROM chosen WHERE old), n AS (SELECT * FROM chosen WHERE NOT old),
plan AS (SELECT coalesce(p.hash, n.hash) AS hash,
  CASE WHEN p.hash IS NULL THEN 'download' WHEN n.hash IS NULL THEN 'delete'
       WHEN p.size = n.size AND p.etag = n.etag THEN 'keep' ELSE 'replace' END AS action,
  n.url, p.size AS psize, n.size AS nsize FROM p FULL JOIN n ON p.hash = n.hash)
SELECT hash, action, url, CASE WHEN action IN ('delete', 'replace') THEN psize ELSE 0 END AS bytes_deleted,
       CASE WHEN action IN ('download', 'replace') THEN nsize ELSE 0 END AS bytes_downloaded FROM plan"""


def stream_latest_query(spark: SparkSession, sf: str) -> DataFrame:
    """Latest supplier and flag per part from two batches; parts the second one changed."""
    root = run_dir(spark, "stream-latest")
    rows = table(spark, sf, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"
    )
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(f"{root}/rows")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{root}/rows")
        stream_latest(
            arriving,
            root,
            ["l_partkey"],
            ["l_shipdate", "l_orderkey", "l_linenumber"],
            ["l_suppkey", "l_returnflag"],
            f"{root}/checkpoint",
        ).awaitTermination()
    return changes(spark, root, 1)


STREAM_LATEST = f"""
WITH best AS (
  SELECT l_partkey, max(w) FILTER (l_shipdate < TIMESTAMP '{CUT}') AS o, max(w) FILTER (l_shipdate >= TIMESTAMP '{CUT}') AS n
  FROM (SELECT l_partkey, l_shipdate, {{'d': l_shipdate, 'o': l_orderkey, 'l': l_linenumber,
                                        's': l_suppkey, 'f': l_returnflag}} AS w FROM lineitem)
  GROUP BY l_partkey)
SELECT l_partkey, n.d AS l_shipdate, n.o AS l_orderkey, n.l AS l_linenumber, n.s AS l_suppkey, n.f AS l_returnflag
FROM best WHERE n IS NOT NULL AND (o IS NULL OR o.s IS DISTINCT FROM n.s OR o.f IS DISTINCT FROM n.f)"""


def stream_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive in three parts, a tenth of them a part late: what became of them, by type."""
    root = run_dir(spark, "stream-accounts")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("source"),
        F.concat(F.lit("u"), "user_id").alias("url"),
        F.lit(1).cast("bigint").alias("size"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
    part = F.floor((F.dayofmonth("event_time") - 1) / 11) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    for k in range(3):
        rows.where(F.least(part, F.lit(2)) == k).write.mode("append").parquet(f"{root}/events")
        for stream in ("demand", "late"):
            arriving = spark.readStream.schema(rows.schema).parquet(f"{root}/events")
            if stream == "demand":
                started = stream_demand(demand(arriving, "1 day", "1 day"), f"{root}/out", f"{root}/demand-checkpoint")
            else:
                started = stream_late(arriving, f"{root}/late", "1 day", "1 day", f"{root}/late-checkpoint")
            started.awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    closed = spark.read.schema("source string, requests bigint").parquet(f"{root}/out")
    late = late_events(spark, f"{root}/late", schema)
    return accounts(rows, closed, late, "1 day", watermark(spark, f"{root}/late", "1 day"))


STREAM_ACCOUNTS = """
WITH e AS (SELECT event_type AS source, ts, date_trunc('day', ts) + INTERVAL 1 DAY AS e,
                  least((dayofmonth(ts) - 1) // 11 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2) AS part
           FROM events),
marks AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 1 DAY AS mark
          FROM (VALUES (0), (1), (2), (3)) AS p(part)),
judged AS (SELECT source, coalesce(e.e <= m.mark, FALSE) AS late, e.e > l.mark AS open
           FROM e JOIN marks m USING (part) JOIN marks l ON l.part = 3)
SELECT source, count(*) AS events, count(*) FILTER (NOT late AND NOT open) AS closed,
       count(*) FILTER (open) AS open, count(*) FILTER (late) AS late
FROM judged GROUP BY source"""


QUERIES = {
    "stream_accounts": (stream_accounts, STREAM_ACCOUNTS),
    "stream_demand": (stream_demand_query, STREAM_DEMAND),
    "stream_top_k": (stream_top_k_query, STREAM_TOP_K),
    "stream_sync": (stream_sync_query, STREAM_SYNC),
    "stream_latest": (stream_latest_query, STREAM_LATEST),
}
