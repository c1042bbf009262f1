"""Layers of one environment: alignment, conflict grading, overlay, rendering.

Layer rows are ``(env, layer, package, raw_version)``; a package has one version per
layer (see :func:`depot.operators.diff.last_wins`).
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.versions import _col, parse_version, part_text
from depot.operators.ranking import positions


def align_layers(
    df: DataFrame,
    layers: Sequence[str],
    order: Sequence[str] = (),
    keys: Sequence[str] = ("env", "package"),
    value: str = "raw_version",
) -> DataFrame:
    """One row per (env, package) with a version column for every layer.

    A fixed list of layers turns the alignment into one aggregate over the rows. The
    greatest row in ``order`` counts where a layer repeats a package.
    """
    picked = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    folded = df.where(F.col("layer").isin(list(layers))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("layer") == name, picked)).alias(name) for name in layers]
    )
    return folded.select(*keys, *[F.col(name).getField("_v").alias(name) for name in layers])


def _distinct_parts(layers: Sequence[str], part: str) -> Column:
    """Distinct version parts over the layers; text that is no version stands for itself."""

    def one(name: str) -> Column:
        number = part_text(parse_version(name), part)
        return F.coalesce(number, F.col(name))

    return F.size(F.array_distinct(F.array_compact(F.array(*[one(n) for n in layers]))))


def conflicts(
    aligned: DataFrame,
    layers: Sequence[str],
    exclude: Sequence[str] = tuple(fixed.CONFLICT_EXCLUDED),
) -> DataFrame:
    """Packages whose layers disagree, graded ``warning`` or ``error``.

    Majors and minors are counted apart: one major with several minors is a warning,
    several of both an error, several majors with one minor is not reported.
    """
    graded = aligned.where(~F.col("package").cast("string").isin(list(exclude))).select(
        "*",
        _distinct_parts(layers, "major").alias("majors"),
        _distinct_parts(layers, "minor").alias("minors"),
    )
    grade = F.when(F.col("majors") == 1, F.lit("warning")).otherwise(F.lit("error"))
    return graded.where("majors >= 1 AND minors > 1").withColumn("grade", grade)


def overlay(aligned: DataFrame, user: str, base: str) -> DataFrame:
    """User packages against the layer below: ``kept``, ``excluded`` and whether they differ.

    ``aligned`` comes from :func:`align_layers` with both layers, so that the overlay
    costs no join. A package the base has is dropped from the user layer even when the
    versions are equal; only differing ones are worth a report.
    """
    return aligned.where(F.col(user).isNotNull()).select(
        "*",
        F.when(F.col(base).isNull(), F.lit("kept")).otherwise(F.lit("excluded")).alias("decision"),
        (F.col(base).isNotNull() & (F.col(base) != F.col(user))).alias("differs"),
    )


def overlay_kept(aligned: DataFrame, user: str, base: str) -> DataFrame:
    return overlay(aligned, user, base).where("decision = 'kept'").drop("decision", "differs")


def overlay_excluded(aligned: DataFrame, user: str, base: str) -> DataFrame:
    """Excluded packages whose versions differ (the ones to warn about)."""
    return overlay(aligned, user, base).where("differs").drop("decision", "differs")


def requirement_text(package, raw_version) -> Column:
    """A local path as it is, ``name @ url`` or ``name==version``."""
    package, raw = _col(package), _col(raw_version)
    return (
        F.when(parse_version(raw).isNotNull(), F.concat(package, F.lit("=="), raw))
        .when(package == raw, package)
        .otherwise(F.concat(package, F.lit(" @ "), raw))
    )


def render_requirements(df: DataFrame, keys: Sequence[str] = ("env",)) -> DataFrame:
    return df.select(
        *keys, "package", requirement_text("package", "raw_version").alias("requirement")
    )


def concat_layers(frames: Sequence[DataFrame]) -> DataFrame:
    """Requirement lists of several layers, lower layers first by ``layer_rank``.

    Inside a layer lines keep the columns that order them.
    """
    ranked = [f.withColumn("layer_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, ranked)


def ordered_lines(
    frames: Sequence[DataFrame], line: Sequence[str] = ("line_no",), keys: Sequence[str] = ("env",)
) -> DataFrame:
    """Lines of all layers as one list for each environment, with ``position`` from 1.

    Lower layers come first, and inside a layer lines stay in their own order.
    """
    return positions(concat_layers(frames), ["layer_rank", *line], keys)


def missing_torch(aligned: DataFrame, user: str, base: str, package: str = "torch") -> DataFrame:
    """Environments whose user layer came to need ``package`` though the layer below has none.

    The user did not ask for it, so its version was chosen by chance: ``version`` is what they
    have to ask for.
    """
    chosen = F.col(user).isNotNull() & F.col(base).isNull() & (F.col("package") == package)
    return aligned.where(chosen).select("env", F.col(user).alias("version"))


def split_by(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Every row with ``special``: whether its name has a handler in ``known``."""
    handlers = known.select(F.col(known.columns[0]).alias(name), F.lit(True).alias("_k")).distinct()
    return (
        df.join(handlers, name, "left")
        .withColumn("special", F.coalesce(F.col("_k"), F.lit(False)))
        .drop("_k")
    )
