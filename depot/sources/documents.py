"""JSON documents, catalogs and manifests as typed rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.versions import parse_version
from depot.sources.lines import read_lines
from depot.sources.locks import read_texts, split_lines

SNAPSHOT_SCHEMA = (
    "id int, cuda map<string,string>, cudnn map<string,string>, python map<string,string>, "
    "torch array<string>, pip_pkgs array<string>, environment string"
)
MARKER_SCHEMA = "timestamp string, attributes map<string,string>, _broken string"
FEED_SCHEMA = "data struct<results:array<struct<data:map<string,string>>>>"
RELEASE_SCHEMA = "name string, assets array<struct<name:string,browser_download_url:string>>"
STATE_MAP_SCHEMA = "map<string,struct<url:string,size:bigint,etag:string>>"


def _fail_unless(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot definitions, one JSON object per line."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "FAILFAST").json(path)


def parse_snapshots(df: DataFrame, text: str = "text") -> DataFrame:
    """Snapshot definitions held as JSON text in a column."""
    return df.select(
        F.from_json(text, SNAPSHOT_SCHEMA, {"mode": "FAILFAST"}).alias("_s")
    ).select("_s.*")


def _catalog(urls: DataFrame, pattern: str, mode: str) -> DataFrame:
    name = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)
    rows = urls.withColumn("filename", name).withColumn("valid", F.col("filename").rlike(pattern))
    if mode == "fail":
        return _fail_unless(
            rows, F.col("valid"), F.concat(F.lit("invalid file name "), F.col("filename"))
        )
    return rows


def cuda_catalog(urls: DataFrame, mode: str = "fail") -> DataFrame:
    """Toolkit catalog from its URLs; a file name that does not parse is an error.

    ``mode='report'`` keeps such rows with ``valid`` false and null versions.
    """
    part = [F.regexp_extract("filename", fixed.CUDA_FILE_PATTERN, i) for i in (1, 2)]
    rows = _catalog(urls, fixed.CUDA_FILE_PATTERN, mode)
    return rows.select(
        *urls.columns,
        "filename",
        "valid",
        F.when(F.col("valid"), F.concat(part[0], F.lit("_"), part[1])).alias("key"),
        parse_version(part[0]).alias("version"),
        parse_version(part[1]).alias("driver_version"),
    )


def cudnn_catalog(urls: DataFrame, mode: str = "fail") -> DataFrame:
    part = [F.regexp_extract("filename", fixed.CUDNN_FILE_PATTERN, i) for i in (1, 2)]
    rows = _catalog(urls, fixed.CUDNN_FILE_PATTERN, mode)
    return rows.select(
        *urls.columns,
        "filename",
        "valid",
        F.when(F.col("valid"), F.concat(part[0], F.lit("-cuda"), part[1])).alias("key"),
        parse_version(part[0]).alias("version"),
        part[1].try_cast("int").alias("cuda_major"),
    )


def parse_markers(df: DataFrame, text: str = "text") -> DataFrame:
    """Done markers held as text: ``done`` iff the JSON has a timestamp.

    Missing, empty and broken markers are simply not done.
    """
    others = [c for c in df.columns if c != text]
    # a text cut short may still parse in part
    parsed = F.from_json(text, MARKER_SCHEMA, {"columnNameOfCorruptRecord": "_broken"})
    whole = F.when(F.col("_m._broken").isNull(), F.col("_m"))
    return df.select(*others, parsed.alias("_m")).withColumn("_m", whole).select(
        *others,
        F.col("_m.timestamp").try_cast("timestamp").alias("timestamp"),
        F.col("_m.attributes").alias("attributes"),
        F.col("_m.timestamp").isNotNull().alias("done"),
    )


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker files below a path with the directory each stands for.

    Spark does not list hidden files, so markers need a name without a leading dot; an
    empty file gives no row, which is as good as not done. Hidden markers are read as a
    table by :func:`markers_of`.
    """
    texts = read_texts(spark, path)
    placed = texts.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir"), "text")
    return parse_markers(placed)


def markers_of(listing: DataFrame, name: str, path: str = "path", text: str = "text") -> DataFrame:
    """Markers from a table of files with their texts, whatever their names are.

    ``name`` is the markers' file name (hidden ones too). Every other file of the listing
    only says that its directory is there: a directory without marker is not done.
    """
    parts = F.col(path)
    marker = F.substring_index(parts, "/", -1) == name
    placed = listing.select(
        F.regexp_replace(parts, "/[^/]*$", "").alias("dir"), F.when(marker, F.col(text)).alias("text")
    )
    return parse_markers(placed.groupBy("dir").agg(F.max("text").alias("text")))


def read_marker_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit markers of an append-only table of JSON lines, as they were appended."""
    lines = spark.read.text(path).where("value <> ''")
    return parse_markers(lines.select(F.col("value").alias("text"))).where("done").drop("done")


def parse_feed(df: DataFrame, text: str = "text", mode: str = "fail") -> DataFrame:
    """Ranked URLs of feed documents; rows without a URL are left out.

    A feed without results is an error (``mode='fail'``): taken as it is, it would
    empty the whole cache. Ranks count all result rows, so they keep the feed's order.
    """
    others = [c for c in df.columns if c != text]
    feeds = df.select(*others, F.from_json(text, FEED_SCHEMA).alias("_f"))
    # the outer form keeps Spark from repeating the JSON parse in a filter below it
    rows = feeds.select(*others, F.posexplode_outer("_f.data.results").alias("rank", "_r"))
    if mode == "fail":
        rows = _fail_unless(rows, F.col("rank").isNotNull(), F.lit("empty ranked feed"))
    return rows.select(
        *others, "rank", F.col("_r.data").getItem(fixed.FEED_URL_KEY).alias("url")
    ).where(F.col("url").isNotNull())


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed(read_texts(spark, path))


def parse_releases(df: DataFrame, text: str = "text") -> DataFrame:
    """Release documents as assets ``(release, position, asset, url)``."""
    others = [c for c in df.columns if c != text]
    docs = df.select(*others, F.from_json(text, RELEASE_SCHEMA).alias("_r"))
    rows = docs.select(
        *others,
        F.col("_r.name").alias("release"),
        F.posexplode_outer("_r.assets").alias("position", "_a"),
    )
    return rows.where(F.col("position").isNotNull()).select(
        *others,
        "release",
        "position",
        F.col("_a.name").alias("asset"),
        F.col("_a.browser_download_url").alias("url"),
    )


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    return parse_releases(read_texts(spark, path))


def _manifest_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered lines, blanks trimmed, to ``url dest`` rows; any other form is an error."""
    lines = lines.where("line <> ''")
    parts = F.split("line", r"\s+")
    lines = _fail_unless(
        lines, F.size(parts) == 2, F.concat(F.lit("invalid manifest line: "), F.col("line"))
    )
    return lines.select(
        *keys, "line_no", parts.getItem(0).alias("url"), parts.getItem(1).alias("dest")
    )


def parse_manifest(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``url dest`` lines of manifests held as texts; any other form is an error.

    Repeated destinations are found by :func:`depot.operators.quality.duplicates`.
    """
    return _manifest_rows(split_lines(df.select(*keys, text), text), keys)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, url, dest`` of manifest files; a file may be of any size."""
    lines = read_lines(spark, path)
    return _manifest_rows(lines.withColumn("line", F.btrim("line", F.lit(fixed.BLANKS))), ["file"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Downloads of manifest files; a destination repeated in a file fails the job."""
    folded = (
        read_manifest_lines(spark, path)
        .groupBy("file", "dest")
        .agg(F.max("url").alias("url"), F.count("*").alias("_n"))
    )
    return _fail_unless(
        folded, F.col("_n") == 1, F.concat(F.lit("repeated destination "), F.col("dest"))
    ).drop("_n")


def parse_state(df: DataFrame, text: str = "text") -> DataFrame:
    """Import a cache state held as one JSON map per row."""
    others = [c for c in df.columns if c != text]
    states = df.select(*others, F.from_json(text, STATE_MAP_SCHEMA).alias("_s"))
    rows = states.select(*others, F.explode_outer("_s").alias("hash", "_o"))
    return rows.where(F.col("hash").isNotNull()).select(*others, "hash", "_o.url", "_o.size", "_o.etag")
