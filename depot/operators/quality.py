"""Invariants, duplicate keys, fingerprints, readiness."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.functions.envs import is_pinned


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def check(df: DataFrame, rules: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Rows checked and violated per rule (and group), from a single pass.

    A rule that gives null counts as violated.
    """
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("_n"),
        *[
            F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_v{i}")
            for i, ok in enumerate(rules.values())
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"_v{i}").alias("violations"))
            for i, name in enumerate(rules)
        ]
    )
    return counts.select(*groups, F.explode(rows).alias("_r"), F.col("_n").alias("checked")).select(
        *groups, "_r.rule", "checked", "_r.violations"
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The violating rows themselves, one per broken rule."""
    broken = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )
    return df.withColumn("rule", F.explode(broken))


def contiguous(
    df: DataFrame, column: str, start: int | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """One row (for each group) that tells whether ids run without gap or repeat (from ``start``).

    Counts decide it, so no row is ever numbered. Registries of several environments each
    have ids of their own: name their column in ``groups``.
    """
    span = df.groupBy(*groups).agg(
        F.count(column).alias("rows"),
        F.count_distinct(column).alias("ids"),
        F.min(column).alias("first_id"),
        F.max(column).alias("last_id"),
    )
    ok = (F.col("rows") == F.col("ids")) & (
        F.col("ids") == F.col("last_id") - F.col("first_id") + 1
    )
    if start is not None:
        ok = ok & (F.col("first_id") == start)
    return span.withColumn("ok", F.coalesce(ok, F.lit(True)))


def definition_rules() -> dict[str, Column]:
    """Rules every snapshot definition has to meet."""

    def full_extends_short(name: str) -> Column:
        return F.forall(
            F.map_entries(name), lambda e: e["value"].startswith(F.concat(e["key"], F.lit(".")))
        )

    return {
        "cuda_full_extends_short": full_extends_short("cuda"),
        "cudnn_full_extends_short": full_extends_short("cudnn"),
        "python_full_extends_short": full_extends_short("python"),
        "packages_pinned": F.forall("pip_pkgs", lambda p: is_pinned(p)),
        "cuda_and_cudnn_together": (F.size("cuda") == 0) == (F.size("cudnn") == 0),
    }


def default_in_list(default: Column, versions: Column) -> Column:
    """The default version is one of the installed ones."""
    return F.array_contains(versions, default)


def set_fingerprint(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Fingerprint of the distinct values of every group, whatever their order.

    Values are hashed one by one and the hashes are added up in six lanes of 28 bits,
    so a group of any size is combined map-side and never gathered.
    """
    return state_fingerprint(set_state(df, groups, value), groups)


def changed_sets(now: DataFrame, before: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Groups whose fingerprint is new or differs from the one recorded before."""
    return now.join(before.select(*groups, "fingerprint"), [*groups, "fingerprint"], "left_anti")


def readiness(
    markers: DataFrame, lo: int, hi: int, snapshot: str = "snapshot", timestamp: str = "timestamp"
) -> DataFrame:
    """Whether every active snapshot is done, and how long the run took, as one row.

    ``markers`` has one row per snapshot with a null timestamp while it is not done.
    """
    done = F.col(timestamp).isNotNull()
    return markers.where(F.col(snapshot).between(lo, hi)).agg(
        F.count("*").alias("snapshots"),
        F.count_if(done).alias("done"),
        F.coalesce(F.bool_and(done), F.lit(True)).alias("ready"),
        F.min(snapshot).alias("first_id"),
        F.max(snapshot).alias("last_id"),
        (F.unix_timestamp(F.max(timestamp)) - F.unix_timestamp(F.min(timestamp))).alias(
            "duration_seconds"
        ),
    )


def build_runs(
    markers: DataFrame, gap: str, keys: Sequence[str] = (), snapshot: str = "snapshot", timestamp: str = "timestamp"
) -> DataFrame:
    """Runs of a builder, from the markers it left: each with its ids, start, end and duration.

    Markers of one of ``keys`` belong to one run as long as the next follows within ``gap`` (just ``gap`` later, too).
    ``snapshots`` are the ids that the run marked, in order; they are ids of a registry, so
    few however many markers a run leaves. Markers without time take no part.
    """
    marked = markers.where(F.col(timestamp).isNotNull())
    runs = marked.groupBy(*keys, F.session_window(timestamp, gap)).agg(
        F.min(timestamp).alias("started"),
        F.max(timestamp).alias("ended"),
        F.count("*").alias("markers"),
        F.array_sort(F.collect_set(snapshot)).alias("snapshots"),
    )
    duration = F.unix_timestamp("ended") - F.unix_timestamp("started")
    return runs.select(
        *keys, "started", "ended", duration.alias("duration_seconds"), "markers", "snapshots"
    )


_LANES = [f"_s{i}" for i in range(6)]


def set_state(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """What :func:`set_fingerprint` adds up, before it is hashed: members and six sums a group.

    Sums can be taken further by :func:`update_sets` with only what changed.
    """
    members = df.select(*groups, F.col(value).cast("string").alias("_v")).distinct()
    return _add_members(members.withColumn("_sign", F.lit(1)), groups)


def _add_members(signed: DataFrame, groups: Sequence[str]) -> DataFrame:
    hashed = signed.withColumn("_h", F.sha2("_v", 256))
    counted = F.when(F.col("_v").isNotNull(), F.col("_sign")).otherwise(F.lit(0))
    lanes = [
        F.sum(F.conv(F.substring("_h", 1 + 7 * i, 7), 16, 10).cast("bigint") * F.col("_sign")).alias(c)
        for i, c in enumerate(_LANES)
    ]
    # rows beside members: a group with a null alone is there, with no members
    return hashed.groupBy(*groups).agg(F.sum("_sign").alias("_rows"), F.sum(counted).alias("members"), *lanes)


def update_sets(
    state: DataFrame, removed: DataFrame, added: DataFrame, groups: Sequence[str], value: str
) -> DataFrame:
    """State of the sets after ``removed`` members left and ``added`` ones came.

    Both hold distinct members, as a diff of two snapshots gives them: what left was in its
    set, and what came was not. Only they are hashed; sets and diff meet in one aggregate
    of a row a group on the side of the sets. A set that lost all its members is gone.
    """
    signed = [
        rows.select(*groups, F.col(value).cast("string").alias("_v"), F.lit(sign).alias("_sign"))
        for rows, sign in ((removed, -1), (added, 1))
    ]
    change = _add_members(signed[0].unionByName(signed[1]), groups)
    sums = [F.sum(c).alias(c) for c in ("_rows", "members", *_LANES)]
    return state.unionByName(change).groupBy(*groups).agg(*sums).where("_rows > 0")


def state_fingerprint(state: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Fingerprints of a state: the same as :func:`set_fingerprint` of the sets themselves."""
    # sums of no members are left out, whether they were never there or came back to nothing
    sums = [F.when(F.col("members") > 0, F.col(c)).cast("string") for c in _LANES]
    text = F.concat_ws("|", F.col("members").cast("string"), *sums)
    return state.select(*groups, "members", F.sha2(text, 256).alias("fingerprint"))
