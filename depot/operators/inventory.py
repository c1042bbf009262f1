"""File inventory: disk use, duplicate content, orphans."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.operators.durable import materialize

TOTAL = "."


def usage(files: DataFrame, depth: int = 1) -> DataFrame:
    """Bytes and files of every directory down to ``depth``, and of the whole as ``.``.

    Files are first summed by their directory at ``depth`` and only those sums are
    passed to the parents.
    """
    dirs = F.filter(
        F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda p: p != ""
    )
    leaves = (
        files.select(F.slice(dirs, 1, depth).alias("_d"), "size")
        .groupBy("_d")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    )
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size("_d")),
        lambda n: F.when(n == 0, F.lit(TOTAL)).otherwise(F.array_join(F.slice("_d", F.lit(1), n), "/")),
    )
    return (
        leaves.select(F.explode(ancestors).alias("dir"), "bytes", "files")
        .groupBy("dir")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    )


def path_size(files: DataFrame, path: str) -> DataFrame:
    """Size of a file, or of everything below a directory, as one row."""
    inside = (F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")
    return files.where(inside).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def duplicate_candidates(files: DataFrame, min_size: int = fixed.DUPLICATE_MIN_SIZE) -> DataFrame:
    """Files that share their size with another: the only ones whose content matters.

    For inventories whose hashes still have to be computed.
    """
    large = files.where(F.col("size") >= min_size)
    shared = large.groupBy("size").count().where("count > 1").select("size")
    return large.join(shared, "size", "left_semi")


def content_hashes(
    files: DataFrame,
    content: Column,
    rank: Sequence[str],
    min_size: int = fixed.DUPLICATE_MIN_SIZE,
    ends: Column | None = None,
) -> DataFrame:
    """Narrow rows (rank, size, content_hash) of files that may have a copy, in the shared folder.

    Contents are hashed in stages: files that share their size with another are looked at;
    of these ``ends``, a hash of the first and last block, is taken; and only files that
    share size and ends are hashed whole by ``content``. Without ``ends`` every file that
    shares its size is. Stages hand on sizes and hashes, never contents.
    """
    sized = duplicate_candidates(files, min_size)
    if ends is not None:
        probed = materialize(sized.select("size", ends.alias("_ends")), "content-ends")
        shared = probed.groupBy("size", "_ends").count().where("count > 1").select("size", "_ends")
        sized = sized.withColumn("_ends", ends).join(shared, ["size", "_ends"], "left_semi")
    return materialize(sized.select(*rank, "size", content.alias("content_hash")), "content-hashes")


def content_ends(content: Column, block: int = 4096) -> Column:
    """Hash of the first and the last block of a text or binary."""
    return F.xxhash64(F.substring(content, 1, block), F.substring(content, -block, block))


def duplicate_content(
    files: DataFrame,
    content: Column,
    rank: Sequence[str],
    min_size: int = fixed.DUPLICATE_MIN_SIZE,
) -> DataFrame:
    """Groups of identical files of at least ``min_size``, with keeper and saving.

    ``rank`` orders copies (search root, depth, path) and must end in the file's own
    name; the lowest is kept. One aggregate by size and content hash: a content that a
    third of all files share is one row per map task.
    """
    groups = (
        files.where(F.col("size") >= min_size)
        .groupBy("size", content.alias("content_hash"))
        .agg(F.min(F.struct(*rank)).alias("_keeper"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    return groups.select(
        "content_hash",
        "size",
        "copies",
        *[F.col("_keeper").getField(c).alias(f"keeper_{c}") for c in rank],
        (F.col("size") * (F.col("copies") - 1)).alias("bytes_saved"),
    )


def links_to_make(files: DataFrame, groups: DataFrame, content: Column, rank: Sequence[str]) -> DataFrame:
    """Every redundant copy with the keeper it can be linked to."""
    keepers = groups.select(
        "size", "content_hash", *[F.col(f"keeper_{c}").alias(f"_k_{c}") for c in rank]
    )
    joined = files.withColumn("content_hash", content).join(keepers, ["size", "content_hash"])
    same = F.struct(*rank) == F.struct(*[F.col(f"_k_{c}") for c in rank])
    return joined.where(~same).select(
        *rank, "size", *[F.col(f"_k_{c}").alias(f"keeper_{c}") for c in rank]
    )


def orphans(artifacts: DataFrame, links: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Artifacts ``(path, name)`` of the given kinds that no link resolves to.

    The kind is the name up to its first dash; other kinds are never touched.
    """
    kind = F.substring_index("name", "-", 1)
    live = links.select(F.col("target").alias("path")).distinct()
    return (
        artifacts.withColumn("kind", kind)
        .where(F.col("kind").isin(list(kinds)))
        .join(live, "path", "left_anti")
    )
