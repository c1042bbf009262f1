"""Download events as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "source string, type string, data struct<url:string,size:bigint>, event_time timestamp"
)


def flatten_events(events: DataFrame) -> DataFrame:
    """``source, url, size, event_time``; events without a time get the time of arrival."""
    return events.where("type = 'download'").select(
        "source",
        F.col("data.url").alias("url"),
        F.col("data.size").alias("size"),
        F.coalesce("event_time", F.current_timestamp()).alias("event_time"),
    )


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files (JSON lines) as they arrive in a folder."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return flatten_events(reader.json(path))
