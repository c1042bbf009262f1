"""Compatibility matrix: expansion, rules, expected pins, completeness.

A snapshot definition is one row ``(id, cuda, cudnn, python, torch, pip_pkgs)`` whose
maps and arrays are small; its matrix is made by exploding them, so no join or shuffle
is needed to expand snapshots, and none can mix two of them.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.envs import cuda_suffix, env_key, index_url
from depot.functions.versions import drop_last_part, major_minor, parse_version, version_literal
from depot.operators.durable import materialize, small_table


def torch_rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, fixed.TORCH_RULES, fixed.TORCH_RULES_COLUMNS)


def torch_companions(spark: SparkSession) -> DataFrame:
    return small_table(spark, fixed.TORCH_COMPANIONS, fixed.TORCH_COMPANIONS_COLUMNS)


def long_form(defs: DataFrame) -> DataFrame:
    """Definitions as rows ``(id, dimension, short, full)``."""

    def from_map(name: str) -> Column:
        return F.transform(
            F.map_entries(name),
            lambda e: F.struct(
                F.lit(name).alias("dimension"), e["key"].alias("short"), e["value"].alias("full")
            ),
        )

    def from_array(name: str) -> Column:
        return F.transform(
            F.col(name),
            lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("short"), v.alias("full")),
        )

    rows = F.concat(
        *[F.coalesce(from_map(m), F.array()) for m in ("cuda", "cudnn", "python")],
        *[F.coalesce(from_array(a), F.array()) for a in ("torch", "pip_pkgs")],
    )
    return defs.select("id", F.explode(rows).alias("_d")).select("id", "_d.*")


def active(df: DataFrame, lo: int | None = None, hi: int | None = None, column: str = "snapshot") -> DataFrame:
    """Snapshots with ``lo <= id <= hi``; prunes partitions when the table has them."""
    if lo is not None:
        df = df.where(F.col(column) >= lo)
    if hi is not None:
        df = df.where(F.col(column) <= hi)
    return df


def select_dims(
    defs: DataFrame,
    *,
    no_cuda: bool = False,
    python: str | None = None,
    torch: str | None = None,
    cuda: str | None = None,
    cudnn: str | None = None,
    single: bool = False,
) -> DataFrame:
    """Narrow definitions to CPU only, or to a single combination of the newest one.

    With ``single`` the newest snapshot counts and older ones are not looked at; the python
    key is required and must exist; torch, cuda and cudnn are optional and empty when not
    given. ``balanced`` tells whether CUDA and CuDNN are both set or both empty, as a usable
    definition must be.
    """
    empty_map = F.create_map().cast("map<string,string>")
    if single:
        if python is None:
            raise ValueError("a single environment needs a python version")
        if no_cuda:
            raise ValueError("a single environment and no_cuda exclude each other")

        # part of what raises the error too: Spark may take the picks before it takes the newest
        is_newest = F.col("id") == defs.agg(F.max("id")).scalar()

        def pick(column: str, key: str | None) -> Column:
            if key is None:
                return empty_map
            missing = F.raise_error(F.concat(F.lit(f"no {column} {key} in snapshot "), F.col("id")))
            return F.when(
                F.map_contains_key(F.col(column), F.lit(key)),
                F.map_filter(F.col(column), lambda k, _: k == key),
            ).when(is_newest, missing.cast("map<string,string>"))

        defs = defs.where(is_newest).select(
            *[c for c in defs.columns if c not in ("python", "torch", "cuda", "cudnn")],
            pick("python", python).alias("python"),
            pick("cuda", cuda).alias("cuda"),
            pick("cudnn", cudnn).alias("cudnn"),
            (F.array(F.lit(torch)) if torch else F.array().cast("array<string>")).alias("torch"),
        )
    elif no_cuda:
        defs = defs.withColumn("cuda", empty_map).withColumn("cudnn", empty_map)
    return defs.withColumn("balanced", (F.size("cuda") == 0) == (F.size("cudnn") == 0))


def _accelerators(with_cpu: bool) -> Column:
    cudas = F.map_keys("cuda")
    return F.concat(F.array(F.lit("cpu")), cudas) if with_cpu else cudas


def expand(defs: DataFrame, with_cpu: bool = True) -> DataFrame:
    """Every (python, torch, cuda) of a snapshot, unfiltered."""
    rows = defs.select(
        F.col("id").alias("snapshot"),
        F.explode(F.map_entries("python")).alias("_p"),
        "torch",
        _accelerators(with_cpu).alias("_c"),
    )
    rows = rows.select("snapshot", "_p", F.explode("torch").alias("torch"), "_c")
    return rows.select(
        "snapshot",
        F.col("_p.key").alias("python"),
        F.col("_p.value").alias("python_full"),
        "torch",
        F.explode("_c").alias("cuda"),
    )


def library_paths(defs: DataFrame) -> DataFrame:
    """(cuda, cudnn, python) combinations with the loader-cache key of each."""
    rows = defs.select(
        F.col("id").alias("snapshot"),
        F.explode(F.map_keys("cuda")).alias("cuda"),
        F.map_keys("cudnn").alias("_n"),
        F.map_keys("python").alias("_p"),
    )
    rows = rows.select("snapshot", "cuda", F.explode("_n").alias("cudnn"), "_p")
    rows = rows.select("snapshot", "cuda", "cudnn", F.explode("_p").alias("python"))
    return rows.select(
        "*",
        F.concat(
            F.lit("cuda"), "cuda", F.lit("-cudnn"), "cudnn", F.lit("-python"), "python"
        ).alias("key"),
        F.concat(F.lit("cudnn"), "cudnn", F.lit("-cuda"), drop_last_part("cuda")).alias("cudnn_dir"),
    )


def required_artifacts(defs: DataFrame) -> DataFrame:
    """Archives a snapshot needs: (snapshot, kind, key), the keys being those of the catalogs.

    Every CUDA version needs its toolkit, and every CuDNN version an archive for each major
    CUDA version of the snapshot. Made from the definition row alone.
    """
    majors = F.array_distinct(F.transform(F.map_keys("cuda"), lambda c: F.substring_index(c, ".", 1)))
    toolkits = F.transform(
        F.map_values("cuda"), lambda full: F.struct(F.lit("cuda").alias("kind"), full.alias("key"))
    )
    libraries = F.flatten(
        F.transform(
            F.map_values("cudnn"),
            lambda full: F.transform(
                majors,
                lambda m: F.struct(
                    F.lit("cudnn").alias("kind"), F.concat(full, F.lit("-cuda"), m).alias("key")
                ),
            ),
        )
    )
    rows = defs.select(
        F.col("id").alias("snapshot"), F.explode(F.array_distinct(F.concat(toolkits, libraries))).alias("_a")
    )
    return rows.select("snapshot", "_a.kind", "_a.key")


def artifact_plan(
    defs: DataFrame, cuda: DataFrame, cudnn: DataFrame, on_missing: str = "error"
) -> DataFrame:
    """Required archives with their URL; one that no catalog has is an error, or ``found`` false.

    A key that a catalog lists twice keeps the smallest URL, so rows are never multiplied.
    """

    def listed(catalog: DataFrame, kind: str) -> DataFrame:
        known = catalog.where("valid").groupBy("key").agg(F.min("url").alias("url"))
        return known.select(F.lit(kind).alias("kind"), "key", "url")

    both = listed(cuda, "cuda").unionByName(listed(cudnn, "cudnn"))
    return lookup_strict(required_artifacts(defs), both, ["kind", "key"], on_missing)


def with_rule(df: DataFrame, rules: DataFrame, version: str = "torch") -> DataFrame:
    """Add ``_lo, _hi`` (Python range as versions) and ``cudas`` of the rule for a version.

    The exact version text goes first, then its ``major.minor``; both are equality
    joins, so a rule table of any size joins by hash and a small one is broadcast by
    its measured size. Versions without a rule are dropped.
    """

    def named(suffix: str) -> DataFrame:
        return rules.select(
            F.col("version").alias(f"_k{suffix}"),
            F.struct(
                parse_version("python_min").alias("_lo"),
                parse_version("python_max").alias("_hi"),
                "cudas",
            ).alias(f"_rule{suffix}"),
        )

    minor = major_minor(parse_version(version))
    joined = (
        df.withColumn("_minor", minor)
        .join(named("x"), F.col(version) == F.col("_kx"), "left")
        .join(named("m"), F.col("_minor") == F.col("_km"), "left")
        .withColumn("_rule", F.coalesce("_rulex", "_rulem"))
        .where(F.col("_rule").isNotNull())
    )
    return joined.select(*df.columns, "_rule.*")


def compatible(matrix: DataFrame, rules: DataFrame) -> DataFrame:
    """Matrix rows (with python, torch, cuda) that their rule allows.

    Only the three decide, and a matrix holds few combinations of them: each is judged once,
    and its rows are found by an equality join. The allowed ones are written first, so that
    their size is known.
    """
    dims = ["python", "torch", "cuda"]
    judged = with_rule(matrix.select(*dims).distinct(), rules).where(
        F.array_contains(F.col("cudas"), F.col("cuda"))
        & parse_version("python").between(F.col("_lo"), F.col("_hi"))
    )
    allowed = materialize(judged.select(*dims), "allowed")
    return matrix.join(allowed, dims).select(*matrix.columns)


def compatible_matrix(
    defs: DataFrame, rules: DataFrame, with_cpu: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Allowed environments of every snapshot, with ``env`` and the definition's ``carry`` columns.

    Rules are joined per torch version, before the other dimensions are exploded, and
    the arrays are filtered first, so combinations that a rule forbids never exist.
    """
    python = F.transform(
        F.map_entries("python"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), parse_version(e["key"]).alias("v")),
    )
    dims = defs.select(
        F.col("id").alias("snapshot"),
        "torch",
        python.alias("_p"),
        _accelerators(with_cpu).alias("_c"),
        *carry,
    )
    # outer forms: a plain explode makes Spark repeat the array expression in a filter
    torches = dims.select("snapshot", F.explode_outer("torch").alias("torch"), "_p", "_c", *carry)
    ruled = with_rule(torches, rules)
    allowed_p = F.filter("_p", lambda e: e["v"].between(F.col("_lo"), F.col("_hi")))
    rows = ruled.select(
        "snapshot",
        "torch",
        F.explode_outer(allowed_p).alias("_p"),
        F.array_intersect("_c", "cudas").alias("_c"),
        *carry,
    )
    rows = rows.where(F.col("_p").isNotNull()).select(
        "snapshot",
        F.col("_p.key").alias("python"),
        F.col("_p.value").alias("python_full"),
        "torch",
        F.explode_outer("_c").alias("cuda"),
        *carry,
    )
    return rows.where(F.col("cuda").isNotNull()).withColumn(
        "env", env_key("python", "torch", "cuda")
    )


def single_environment(
    defs: DataFrame, rules: DataFrame, python: str, torch: str, cuda: str | None = None, cudnn: str | None = None
) -> DataFrame:
    """The one environment of the newest snapshot: on CUDA if that is given, else on the CPU."""
    one = select_dims(defs, single=True, python=python, torch=torch, cuda=cuda, cudnn=cudnn)
    return compatible_matrix(one.where("balanced"), rules, with_cpu=cuda is None)


@dataclass(frozen=True)
class PinRule:
    """Requirements of environments whose torch is below a version."""

    below: str
    packages: list[str] = field(default_factory=list)
    gpu_only: bool = False
    cuda_prefix: str = ""
    per_cuda: bool = False  # append -cu11 / -cu12 to every name


# before the definition's own packages, and after them
CAPS = [PinRule(fixed.NUMPY_CAP_BELOW, [fixed.NUMPY_CAP])]
RUNTIMES = [
    PinRule(fixed.CUDA_RUNTIME_BELOW, fixed.CUDA_RUNTIME_PACKAGES, gpu_only=True, per_cuda=True),
    PinRule(
        fixed.CUDA_RUNTIME_BELOW,
        fixed.CUDA_12_PACKAGES,
        gpu_only=True,
        cuda_prefix="cu12",
        per_cuda=True,
    ),
]


def _rule_packages(rule: PinRule, torch: Column, cu: Column) -> Column:
    tail = [F.lit("-"), F.substring(cu, 1, 4)] if rule.per_cuda else []
    names = F.array(*[F.concat(F.lit(p), *tail) for p in rule.packages])
    applies = torch < version_literal(rule.below)
    if rule.gpu_only:
        applies = applies & (cu != "cpu")
    if rule.cuda_prefix:
        applies = applies & cu.startswith(rule.cuda_prefix)
    return F.when(applies, names).otherwise(F.array().cast("array<string>"))


def lookup_strict(
    df: DataFrame, catalog: DataFrame, keys: Sequence[str], on_missing: str = "error"
) -> DataFrame:
    """Left join to a catalog where a missing key is an error, or a ``found`` flag.

    ``on_missing='report'`` keeps every row with ``found``; ``'error'`` fails the job
    when such a row is computed. No row is dropped silently.
    """
    hit = catalog.withColumn("_hit", F.lit(True))
    joined = df.join(hit, list(keys), "left")
    if on_missing == "report":
        return joined.withColumn("found", F.col("_hit").isNotNull()).drop("_hit")
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return joined.where(
        F.when(F.col("_hit"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("not in catalog: "), text)).cast("boolean")
        )
    ).drop("_hit")


def expected_pins(
    envs: DataFrame,
    companions: DataFrame,
    caps: Sequence[PinRule] = tuple(CAPS),
    runtimes: Sequence[PinRule] = tuple(RUNTIMES),
    on_missing: str = "error",
    keys: Sequence[str] = ("snapshot", "env"),
) -> DataFrame:
    """Requirements the rules put into an environment, in order, one row each.

    ``envs`` has python, torch, cuda and ``pip_pkgs`` (array). Thresholds are compiled
    into expressions; companions are an equality join. ``on_missing='report'`` drops
    nothing but gives an environment without companions no rows of its own, and a
    single row with null ``requirement``.
    """
    # parsed in a step of its own: the requirements refer to both many times
    rows = lookup_strict(envs, companions, ["torch"], on_missing).withColumns(
        {"_v": parse_version("torch"), "_cu": cuda_suffix("cuda")}
    )
    torch, cu = F.col("_v"), F.col("_cu")
    base = index_url("cuda", True)
    py = F.concat(F.lit("cp"), F.regexp_replace("python", r"\.", ""))

    def nightly(name: str, version: str) -> Column:
        return F.concat(
            F.lit(f"{name} @ "), base, F.lit(f"/{name}-"), F.col(version), F.lit("%2B"), cu,
            F.lit("-"), py, F.lit("-"), py, F.lit("-linux_x86_64.whl"),
        )

    def release(name: str, version: str) -> Column:
        return F.concat(F.lit(f"{name}=="), F.col(version), F.lit("+"), cu)

    named = [("torch", "torch"), ("torchaudio", "torchaudio"), ("torchvision", "torchvision")]
    heads = F.when(
        torch.getField("extra") != "", F.array(*[nightly(n, v) for n, v in named])
    ).otherwise(F.array(*[release(n, v) for n, v in named]))
    pins = F.concat(
        heads,
        *[_rule_packages(r, torch, cu) for r in caps],
        F.coalesce("pip_pkgs", F.array().cast("array<string>")),
        *[_rule_packages(r, torch, cu) for r in runtimes],
    )
    if on_missing == "report":
        pins = F.when(F.col("found"), pins)
    return rows.select(*keys, F.posexplode_outer(pins).alias("position", "requirement"))


def missing(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without an actual row; swap the arguments for the reverse."""
    have = actual.select(*keys).distinct()
    return expected.join(have, list(keys), "left_anti")


def pending(desired: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Desired work without a done marker (``done`` true), so a run can resume."""
    return missing(desired, markers.where(F.col("done")), keys)


def matrix_summary(defs: DataFrame, rules: DataFrame) -> DataFrame:
    """The head of the version matrix document: one row a snapshot, without its environments.

    Those are rows of their own (:func:`matrix_venvs`), however many there are.
    """
    torch_cudas = with_rule(
        defs.select(F.col("id").alias("snapshot"), F.explode(F.array_distinct("torch")).alias("torch")), rules
    )
    # as many entries as the definition has torch versions
    torch_cudas = torch_cudas.groupBy("snapshot").agg(
        F.map_from_entries(
            F.collect_list(F.struct("torch", F.expr("filter(cudas, c -> c <> 'cpu')").alias("c")))
        ).alias("torch_cudas")
    )
    none = F.create_map().cast("map<string,array<string>>")
    return (
        defs.select(
            F.col("id").alias("snapshot"),
            F.map_keys("cuda").alias("cuda_versions"),
            F.map_keys("cudnn").alias("cudnn_versions"),
            F.map_keys("python").alias("python_versions"),
            F.col("torch").alias("torch_versions"),
        )
        .join(torch_cudas, "snapshot", "left")
        .withColumn("torch_cudas", F.coalesce("torch_cudas", none))
    )


def matrix_venvs(defs: DataFrame, rules: DataFrame) -> DataFrame:
    """The environments of the document: snapshot, position, python, torch, cuda.

    ``position`` orders a snapshot's environments by version, newest first and CPU before
    CUDA. It is the place in the product of the definition's own sorted lists, so it needs
    no sort or window over the snapshot; combinations that rules forbid leave gaps.
    """

    def newest_first(values: Column) -> Column:
        keyed = F.transform(values, lambda v: F.struct(parse_version(v).alias("v"), v.alias("t")))
        return F.transform(F.sort_array(keyed, asc=False), lambda e: e["t"])

    carried = {
        "_ps": newest_first(F.map_keys("python")),
        "_ts": newest_first(F.array_distinct("torch")),
        "_cs": F.concat(F.array(F.lit("cpu")), newest_first(F.map_keys("cuda"))),
    }
    envs = compatible_matrix(defs.withColumns(carried), rules, carry=list(carried))

    def place(values: str, value: str) -> Column:
        return F.array_position(values, F.col(value)) - 1

    position = (place("_ps", "python") * F.size("_ts") + place("_ts", "torch")) * F.size("_cs")
    return envs.select(
        "snapshot", (position + place("_cs", "cuda")).alias("position"), "python", "torch", "cuda"
    )


def newest(df: DataFrame, column: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot."""
    return df.join(df.agg(F.max(column).alias(column)), column, "left_semi")  # one row


def latest_document(defs: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """The version matrix document of the newest snapshot alone, with links to released tools.

    ``links`` has ``name, version, url``, a row a tool; they become the map ``releases``.
    """
    # a handful of tools
    released = links.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("version", "url")))).alias("releases"))
    head = newest(matrix_summary(newest(defs, "id"), rules))
    return head.withColumn("releases", released.scalar())


def tool_matrix(tools: DataFrame, pythons: DataFrame, excluded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every tool version with every Python version: what has to be installed where.

    ``tools`` has ``version`` and ``default_version``, ``pythons`` has ``python`` (full
    versions), ``excluded`` has ``kind, python`` (major.minor): tools of a kind (the
    letters their version begins with) that do not run there. All are per ``keys``. Versions listed
    twice count once. A definition's Pythons are few, so they are carried to its tools as
    a list; nothing is crossed over definitions.
    """
    few = pythons.groupBy(*keys).agg(F.sort_array(F.collect_set("python")).alias("_pythons"))
    if not keys:
        few, tools = few.withColumn("_k", F.lit(1)), tools.withColumn("_k", F.lit(1))
    on = list(keys) or ["_k"]
    rows = tools.distinct().join(few, on).select(*on, "version", "default_version", F.explode("_pythons").alias("python_full"))
    rows = rows.select(
        *keys,
        "version",
        major_minor(parse_version("python_full")).alias("python"),
        "python_full",
        F.coalesce(F.col("version") == F.col("default_version"), F.lit(False)).alias("is_default"),
        F.regexp_extract("version", "^[A-Za-z]*", 0).alias("_kind"),
    )
    out = excluded.select(F.col("kind").alias("_kind"), "python").distinct()
    columns = [c for c in rows.columns if c != "_kind"]
    return rows.join(out, ["_kind", "python"], "left_anti").select(*columns)
