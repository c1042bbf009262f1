"""Shared durable storage for cut lineage and job state."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or by ``spark.depot.shared.dir``.

    The second can be set in a running session. Without either this is an error whatever
    the master is, since a folder chosen here might be one that executors cannot see.
    """
    for key in ("spark.checkpoint.dir", "spark.depot.shared.dir"):
        if folder := spark.conf.get(key, None):
            return folder.rstrip("/")
    raise ValueError(
        "set spark.checkpoint.dir or spark.depot.shared.dir to a folder all executors share"
    )


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table written out in the plan, for a handful of rows the driver holds anyway.

    Its size is known to the planner, which then broadcasts it; a frame made from Python
    rows has no known size and would be joined by shuffling the other side.
    """

    def literal(v) -> str:
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(literal(x) for x in v) + ")"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows are fixed from then on: later branches see the same rows in the same
    parts even when executors are lost, and scans prune columns and row groups.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
