"""Lock files: requirement text to pins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.urls import resolve_dots
from depot.functions.versions import parse_version
from depot.operators.diff import last_wins
from depot.sources.lines import read_lines


def _plain(text: Column, rare: str) -> Column:
    """Whether a text is ASCII and free of the rare ASCII characters in ``rare``.

    Byte searches: a character class with this many members costs a multiple.
    """
    ok = F.octet_length(text) == F.length(text)
    for c in rare:
        if c.isascii():
            ok = ok & ~text.contains(c)
    return ok


def _strip(text: Column) -> Column:
    """Trim all blanks; plain spaces, the usual case, have a faster trim."""
    return F.when(_plain(text, fixed.RARE_BLANKS), F.trim(text)).otherwise(
        F.btrim(text, F.lit(fixed.BLANKS))
    )


def _split_once(line: Column, mark: str) -> list[Column]:
    """Both sides of the first ``mark``, blanks trimmed."""
    return [
        _strip(F.substring_index(line, mark, 1)),
        _strip(F.substr(line, F.instr(line, mark) + len(mark))),
    ]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file`` and its whole text.

    Whole files keep line numbers exact; small files share a task
    (``spark.sql.files.maxPartitionBytes``).
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Explode a text column into ``line_no`` (from 0) and ``line``, blanks trimmed.

    Plain texts, told once per text, take a plain split and a plain trim.
    """
    others = [c for c in df.columns if c != text]
    unix = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    newlines = "\n" * len(fixed.LINE_ENDS)
    plain = _plain(F.col(text), fixed.LINE_ENDS + fixed.RARE_BLANKS)
    prepared = df.select(*others, text, plain.alias("_plain")).select(
        *others,
        "_plain",
        F.when(F.col("_plain"), F.col(text))
        .otherwise(F.translate(unix, fixed.LINE_ENDS, newlines))
        .alias("_t"),
    )
    lines = prepared.select(*others, "_plain", F.posexplode(F.split("_t", "\n")).alias("line_no", "line"))
    trimmed = F.when(F.col("_plain"), F.trim("line")).otherwise(F.btrim("line", F.lit(fixed.BLANKS)))
    return lines.withColumn("line", trimmed).drop("_plain")


def parse_lines(lines: DataFrame, known_paths: DataFrame | None = None, cwd: str = "/") -> DataFrame:
    """Requirement lines to ``package, raw_version``; others get ``error``.

    Blank, ``#`` and ``--`` lines are dropped. ``==`` goes before ``@`` and the first
    one splits. A line that is one of ``known_paths`` (absolute, column ``path``) once
    resolved against ``cwd`` is a local file and its own version.
    """
    line = F.col("line")
    kept = lines.where(~((line == "") | line.startswith("#") | line.startswith("--")))
    pinned, direct = _split_once(line, "=="), _split_once(line, "@")
    is_pinned, is_direct = line.contains("=="), line.contains("@")
    if known_paths is None:
        local = F.lit(None).cast("string")
    else:
        whole = F.when(line.startswith("/"), line).otherwise(
            F.concat(F.lit(cwd.rstrip("/") + "/"), line)
        )
        absolute = F.when(~(is_pinned | is_direct), resolve_dots(whole))
        paths = known_paths.select(F.col("path").alias("_path")).distinct()
        kept = kept.withColumn("_abs", absolute).join(paths, F.col("_abs") == F.col("_path"), "left")
        local = F.col("_path")

    def choose(i: int) -> Column:
        return F.when(is_pinned, pinned[i]).when(is_direct, direct[i]).otherwise(local)

    bad = ~(is_pinned | is_direct | local.isNotNull())
    return kept.select(
        *[c for c in lines.columns if c != "line"],
        choose(0).alias("package"),
        choose(1).alias("raw_version"),
        F.when(bad, F.concat(F.lit("invalid requirement: "), line)).alias("error"),
    )


def parse_locks(
    texts: DataFrame,
    keys: list[str],
    text: str = "text",
    mode: str = "fail",
    known_paths: DataFrame | None = None,
    cwd: str = "/",
) -> DataFrame:
    """Pins of texts keyed by ``keys``: the last line of a package counts.

    ``mode='fail'`` fails the job on an invalid line; ``'reject'`` leaves it out (see
    :func:`lock_rejects` for those lines).
    """
    return _pins(split_lines(texts.select(*keys, text), text), keys, ["line_no"], mode, known_paths, cwd)


def _pins(
    lines: DataFrame, keys: list[str], order: list[str], mode: str, known_paths: DataFrame | None, cwd: str
) -> DataFrame:
    """Pins of numbered lines: the last line of a package counts."""
    rows = parse_lines(lines, known_paths, cwd)
    if mode == "fail":
        # a filter, since an unused column could be pruned away
        rows = rows.where(
            F.when(F.col("error").isNull(), F.lit(True)).otherwise(
                F.raise_error(F.col("error")).cast("boolean")
            )
        )
    elif mode == "reject":
        rows = rows.where(F.col("error").isNull())
    else:
        raise ValueError(f"unknown mode {mode}")
    pins = last_wins(rows.drop("error"), [*keys, "package"], order, ["line_no", "raw_version"])
    return pins.withColumn("version", parse_version("raw_version"))


def lock_rejects(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Invalid lines with their place and error."""
    rows = parse_lines(split_lines(texts.select(*keys, text), text))
    return rows.where(F.col("error").isNotNull()).select(*keys, "line_no", "error")


def read_locks(
    spark: SparkSession,
    path: str,
    mode: str = "fail",
    known_paths: DataFrame | None = None,
    cwd: str = "/",
    long_files: bool = False,
) -> DataFrame:
    """Pins of a corpus ``.../g<snapshot>/<env>.txt``.

    A file is one row by default, which suits many small ones. With ``long_files`` files are
    cut over tasks, and ``line_no`` counts lines that end in a newline or carriage return;
    rarer line ends inside such a line part it further without numbers of their own.
    """
    found = [F.regexp_extract("file", fixed.LOCK_PATH_PATTERN, i) for i in (1, 2)]
    keys = [found[0].cast("int").alias("snapshot"), found[1].alias("env")]
    named = F.col("file").rlike(fixed.LOCK_PATH_PATTERN)
    if long_files:
        lines = read_lines(spark, path).where(named).select(*keys, F.col("line_no").alias("_row"), "line")
        parts = split_lines(lines, "line").withColumnsRenamed({"line_no": "_part", "_row": "line_no"})
        return _pins(parts, ["snapshot", "env"], ["line_no", "_part"], mode, known_paths, cwd)
    texts = read_texts(spark, path).where(named).select(*keys, "text")
    return parse_locks(texts, ["snapshot", "env"], mode=mode, known_paths=known_paths, cwd=cwd)
