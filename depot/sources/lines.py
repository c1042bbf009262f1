"""Lines of text files with their numbers, files of any size cut over many tasks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no`` (from 0) and ``line`` of all files below a path.

    Spark cuts large files into splits at byte offsets. Lines are counted per split, the
    counts of the splits before are summed for each file, and a line's number is its place
    within its split plus that sum; so no task needs a whole file, and lines are not moved.
    The place comes from ids that rise within a task by one a line. Both scans of a run cut
    the files the same way; should they not, the job fails instead of giving wrong numbers.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # one row a split
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("file").alias("_file"),
        F.col("_split").alias("_at"),
        "_n",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = (F.col("file") == F.col("_file")) & (F.col("_split") == F.col("_at"))
    place = F.col("_id") - F.col("_first")
    number = F.when(place.between(0, F.col("_n") - 1), F.col("_before") + place).otherwise(
        F.raise_error(F.concat(F.lit("splits of a file changed while reading "), F.col("file"))).cast("bigint")
    )
    return raw.join(splits, same, "left").select("file", number.alias("line_no"), "line")
