"""Immutable pin tables, matrix documents, markers, requirement text, versioned state."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.operators.cache import STATE_SCHEMA
from depot.operators.layers import requirement_text
from depot.sinks.log import Conflict, Log, Version


PIN_SCHEMA = "snapshot int, env string, package string, raw_version string"


def write_pins(df: DataFrame, path: str) -> int:
    """Add snapshots to a pin table as one version; a snapshot that is already there is an error.

    The rows are staged, one folder a snapshot, and published by one entry of the table's log.
    Of writers that race with the same snapshot one succeeds and the others fail whole;
    with different snapshots all succeed, one after the other. Returns the version. The
    rebalance hint writes few files per snapshot but still splits a large one over several
    tasks.
    """
    log = Log(df.sparkSession, path)
    stage = log.new_folder()
    # the files keep the snapshot, so that folders of several stages can be read at once
    staged = df.withColumn("_part", F.col("snapshot")).hint("rebalance", "_part")
    staged.write.partitionBy("_part").parquet(log.folder(stage))
    folders = {s: [f"{stage}/_part={s}"] for s in log.staged(stage, "_part")}

    def against(last: Version) -> None:
        if again := sorted(folders.keys() & last.parts.keys()):
            raise Conflict(f"snapshots are immutable and {', '.join(again)} already in the table")

    return log.commit({"put": folders}, against).number


def read_pins(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    snapshots: Sequence[int] | None = None,
    schema: str = PIN_SCHEMA,
) -> DataFrame:
    """Pins as of a version, the newest by default; of all snapshots or the given ones."""
    log = Log(spark, path)
    live = log.at(version)
    return log.read(schema, live, None if snapshots is None else [str(s) for s in snapshots])


def write_matrix(heads: DataFrame, venvs: DataFrame, path: str) -> None:
    """Matrix documents as JSON: ``heads``, one row a snapshot, and ``venvs`` in their order.

    The files of ``venvs`` follow each other in the order of snapshot and position, and a
    snapshot of any size is cut over several.
    """
    heads.write.mode("overwrite").json(f"{path}/heads")
    venvs.orderBy("snapshot", "position").write.mode("overwrite").json(f"{path}/venvs")


def marker(kind: str, attributes: dict[str, Column], at: Column | None = None) -> list[Column]:
    """Columns of an audit marker; attribute names carry the kind as prefix."""
    pairs = []
    for name, value in sorted(attributes.items()):
        pairs += [F.lit(f"{kind}.{name}"), value.cast("string")]
    return [
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.create_map(F.lit("kind"), F.lit(kind), *pairs).alias("attributes"),
    ]


def append_marker(
    df: DataFrame, path: str, kind: str, attributes: dict[str, Column], keys: Sequence[str] = (),
    at: Column | None = None,
) -> None:
    """Append one marker per row of ``df`` to the audit table."""
    df.select(*keys, *marker(kind, attributes, at)).write.mode("append").json(path)


def write_requirements(df: DataFrame, path: str, keys: Sequence[str] = ("env",)) -> None:
    """Requirement text files, one folder per key, sorted by package."""
    text = df.select(*keys, "package", requirement_text("package", "raw_version").alias("value"))
    # a range sort on key and package: an environment with very many rows is cut, in order
    ordered = text.orderBy(*keys, "package").drop("package")
    ordered.write.mode("errorifexists").partitionBy(*keys).text(path)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Newest version of a state table."""
    number = Log(spark, root).at().number
    return None if number < 0 else number


def read_version(spark: SparkSession, root: str, schema: str, number: int | None = None) -> DataFrame:
    """Rows of a version of a state table, the newest by default; no state yet is an empty table."""
    log = Log(spark, root)
    return log.read(schema, log.at(number))


def replace_state(
    df: DataFrame, root: str, entry: dict | None = None, after: int | None = None
) -> int:
    """Replace a state table by ``df`` as a new version, and return its number.

    ``entry`` has more for the log (runs, notes). With ``after`` the version must follow that
    one: if another writer came between, this is a :class:`Conflict` and nothing changes.
    """
    log = Log(df.sparkSession, root)
    stage = log.new_folder()
    df.write.parquet(log.folder(stage))

    def against(last: Version) -> None:
        if after is not None and last.number != after:
            raise Conflict(f"version {last.number} of {root} came between")

    return log.commit({**(entry or {}), "replace_all": True, "put": {"all": [stage]}}, against).number


def read_cache_state(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    return read_version(spark, root, STATE_SCHEMA, number)


def write_cache_state(df: DataFrame, root: str, after: int | None = None) -> int:
    """Replace the cache state, failed downloads included: they are retried next time."""
    return replace_state(df, root, after=after)
