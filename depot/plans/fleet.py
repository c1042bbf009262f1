"""Build, update and overlay plans made of the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.operators.diff import diff_envs, diff_snapshots
from depot.operators.layers import (
    align_layers,
    concat_layers,
    conflicts,
    overlay,
    render_requirements,
)
from depot.operators.matrix import active, compatible_matrix, missing, pending

LAYERS = ["tools", "base", "user"]


def pending_envs(
    defs: DataFrame, rules: DataFrame, markers: DataFrame, lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """Environments of the active snapshots that still have to be built.

    ``markers`` has ``snapshot, env, done``.
    """
    envs = compatible_matrix(active(defs, lo, hi, "id"), rules)
    return pending(envs, markers, ["snapshot", "env"])


def missing_locks(defs: DataFrame, rules: DataFrame, pins: DataFrame) -> DataFrame:
    """Allowed environments that have no lock file."""
    return missing(compatible_matrix(defs, rules), pins, ["snapshot", "env"])


def release_notes(pins: DataFrame, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """Environment changes and package changes between two snapshots of a pin table."""
    a = pins.where(F.col("snapshot") == old)
    b = pins.where(F.col("snapshot") == new)
    return (
        diff_envs(a, b),
        diff_snapshots(a, b, ["env", "package"], "raw_version", within=["env"]),
    )


def user_layer(
    tools: DataFrame, base: DataFrame, user: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conflict report, overlay decisions and requirement text of a user layer.

    Each input has ``env, package, raw_version``; user packages the base already has
    are left out of the text.
    """
    layers = [
        df.select("env", "package", "raw_version", F.lit(name).alias("layer"))
        for name, df in zip(LAYERS, (tools, base, user))
    ]
    aligned = align_layers(concat_layers(layers), LAYERS, order=["layer_rank"])
    decided = overlay(aligned, "user", "base")
    kept = decided.where("decision = 'kept'").select(
        "env", "package", F.col("user").alias("raw_version")
    )
    return conflicts(aligned, LAYERS), decided, render_requirements(kept)
