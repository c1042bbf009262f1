"""Which run of a stream a batch belongs to."""

from pyspark.sql import SparkSession


def stream_run(spark: SparkSession) -> str:
    """Id of the stream whose batch is being handled.

    It is kept in the checkpoint: restarts keep it and a new checkpoint, whose batch ids
    start at 0 again, has another one. Outside a stream this is an error.
    """
    run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise ValueError("no stream is running: say which run the batch belongs to")
    return run
