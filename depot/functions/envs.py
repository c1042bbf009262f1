"""Environment keys, snapshot labels, index URLs and source specs (no UDF)."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.urls import short_key
from depot.functions.versions import _col


def cuda_suffix(cuda) -> Column:
    """``12.4`` -> ``cu124``; ``cpu`` stays."""
    cuda = _col(cuda)
    return F.when(cuda == "cpu", cuda).otherwise(
        F.concat(F.lit("cu"), F.regexp_replace(cuda, r"\.", ""))
    )


def env_key(python, torch, cuda) -> Column:
    return F.concat(
        F.lit("python"), _col(python), F.lit("-torch"), _col(torch), F.lit("-"), cuda_suffix(cuda)
    )


def parse_env(env) -> Column:
    """``python, torch, suffix`` of an environment key; null if it is not one."""
    env = _col(env)
    part = [F.regexp_extract(env, fixed.ENV_PATTERN, i) for i in (1, 2, 3)]
    return F.when(
        env.rlike(fixed.ENV_PATTERN),
        F.struct(part[0].alias("python"), part[1].alias("torch"), part[2].alias("suffix")),
    )


def snapshot_label(snapshot) -> Column:
    """``19`` -> ``g00019``; longer ids are not cut."""
    text = _col(snapshot).cast("string")
    return F.concat(
        F.lit("g"), F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))
    )


def snapshot_id(label) -> Column:
    found = F.regexp_extract(_col(label), fixed.SNAPSHOT_LABEL_PATTERN, 1)
    return F.nullif(found, F.lit("")).cast("int")


def is_nightly(torch) -> Column:
    return F.coalesce(_col(torch).contains(".dev"), F.lit(False))


def index_url(cuda, nightly) -> Column:
    nightly = F.lit(nightly) if isinstance(nightly, bool) else nightly
    channel = F.when(nightly, F.lit("/nightly/")).otherwise(F.lit("/"))
    return F.concat(F.lit(fixed.TORCH_INDEX), channel, cuda_suffix(cuda))


def index_args(torch, cuda, user: bool) -> Column:
    """Index options of a resolver run, as an array."""
    strategy = "unsafe-first-match" if user else "first-index"
    return F.array(
        F.lit("--extra-index-url"),
        index_url(cuda, is_nightly(torch)),
        F.lit("--index-url"),
        F.lit(fixed.DEFAULT_INDEX),
        F.lit("--index-strategy"),
        F.lit(strategy),
    )


def classify_spec(spec, package: str, alias: str) -> Column:
    """How a tool version is given: URL, moving alias, pinned alias or plain version.

    Gives ``kind, name, spec``; ``kind`` is ``url``, ``alias``, ``alias_pinned``,
    ``plain`` or ``unsupported`` (text that starts with the alias but pins nothing).
    """
    s = _col(spec)
    pkg = F.when(s.contains(alias), F.lit(alias)).otherwise(F.lit(package))
    pinned = F.btrim(F.element_at(F.split(s, "=="), 2), F.lit(fixed.BLANKS))

    def made(kind, name, text):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.alias("spec"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(
            s.startswith("https://") | s.startswith("file://"),
            made("url", F.concat(pkg, short_key(s)), F.concat(pkg, F.lit("@"), s)),
        )
        .when(s == alias, made("alias", F.lit(alias + "latest"), nothing))
        .when(
            s.startswith(alias) & s.contains("=="),
            made("alias_pinned", F.concat(F.lit(alias), pinned), nothing),
        )
        .when(s.startswith(alias), made("unsupported", nothing, nothing))
        .otherwise(
            made("plain", F.concat(F.lit(package), s), F.concat(F.lit(package + "=="), s))
        )
    )


def resolve_alias(spec, alias: str, version) -> Column:
    """Replace a moving alias by the version it stands for now."""
    s = _col(spec)
    return F.when(s == alias, F.concat(F.lit(alias + "=="), _col(version))).otherwise(s)


def _json_text(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_fingerprint(fields: Sequence[tuple[str, Column, bool]]) -> Column:
    """sha256 of a JSON object written with ``", "`` and ``": "`` separators.

    ``fields`` are ``(name, column, is_list)`` in output order. Sort lists before;
    the text is order-sensitive. ASCII text only.
    """
    parts = []
    for name, col, is_list in fields:
        value = (
            F.concat(F.lit("["), F.array_join(F.transform(col, _json_text), ", "), F.lit("]"))
            if is_list
            else _json_text(col)
        )
        parts.append(F.concat(F.lit(f'"{name}": '), value))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def is_pinned(package, seed: Sequence[str] = tuple(fixed.SEED_PACKAGES)) -> Column:
    p = _col(package)
    return p.isin(list(seed)) | p.contains("==") | p.contains("@")
