"""Snapshot diffs, lock text, versions and layers over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import fixed, parse_version, snapshot_label
from depot.operators.diff import (
    common_names,
    diff_chain,
    diff_envs,
    diff_snapshots,
    last_wins,
    names_only_in,
    union_names,
)
from depot.operators.durable import run_dir
from depot.operators.layers import (
    align_layers,
    missing_torch,
    ordered_lines,
    conflicts,
    overlay_excluded,
    overlay_kept,
    render_requirements,
    split_by,
)
from depot.operators.ranking import distinct_versions, latest_per_key, version_positions
from depot.sinks.tables import read_pins, write_pins
from depot.sources.locks import parse_lines, split_lines
from depot.workloads.tables import CUT, LAYER_NAMES, LAYER_SQL, int_text, layer_rows, table


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return rows.where(early), rows.where(~early)


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shipped before the cut against those after it."""
    a, b = _halves(spark, sf)
    return diff_snapshots(a, b, ["l_orderkey", "l_linenumber"], "l_partkey", ["l_shipdate"])


SNAPSHOT_DIFF = f"""
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '{CUT}'
                             ORDER BY l_shipdate DESC, l_partkey DESC) = 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey,
       coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
       CASE WHEN b.l_orderkey IS NULL THEN 'only_left' WHEN a.l_orderkey IS NULL THEN 'only_right'
            ELSE 'changed' END AS status,
       a.l_partkey AS left_value, b.l_partkey AS right_value
FROM (SELECT * FROM r WHERE old) a FULL JOIN (SELECT * FROM r WHERE NOT old) b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
WHERE a.l_partkey IS DISTINCT FROM b.l_partkey
"""


def env_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return diff_envs(a, b, ["l_orderkey"])


ENV_DIFF = f"""
SELECT l_orderkey,
       CASE WHEN bool_or(l_shipdate < TIMESTAMP '{CUT}') AND bool_or(l_shipdate >= TIMESTAMP '{CUT}')
            THEN 'common' WHEN bool_or(l_shipdate < TIMESTAMP '{CUT}') THEN 'removed'
            ELSE 'added' END AS status
FROM lineitem GROUP BY l_orderkey
"""


def snapshot_chain_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every ship year against the next: what each supplier's parts changed to.

    Years are squared to ids, so that between two snapshots there are always gaps.
    """
    rows = table(spark, sf, "lineitem").select(
        (F.year("l_shipdate") * F.year("l_shipdate")).alias("snapshot"),
        "l_suppkey",
        "l_partkey",
        "l_shipdate",
        "l_orderkey",
        F.concat(F.col("l_linenumber"), F.lit("."), int_text("l_quantity")).alias("raw_version"),
    )
    return diff_chain(
        rows,
        "snapshot",
        ["l_suppkey", "l_partkey"],
        "raw_version",
        order=["l_shipdate", "l_orderkey"],
        within=["l_suppkey"],
    )


SNAPSHOT_CHAIN_DIFF = """
WITH r AS (
  SELECT year(l_shipdate) AS y, l_suppkey, l_partkey,
         l_linenumber || '.' || l_quantity::BIGINT AS v FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY y, l_suppkey, l_partkey
                             ORDER BY l_shipdate DESC, l_orderkey DESC, v DESC) = 1),
e AS (SELECT DISTINCT y, l_suppkey FROM r),
common AS (SELECT a.y, a.l_suppkey FROM e a JOIN e b ON b.y = a.y + 1 AND a.l_suppkey = b.l_suppkey),
a AS (SELECT r.* FROM r JOIN common USING (y, l_suppkey)),
b AS (SELECT r.y - 1 AS y, r.l_suppkey, r.l_partkey, r.v
      FROM r JOIN common c ON c.y = r.y - 1 AND c.l_suppkey = r.l_suppkey)
SELECT coalesce(a.y, b.y) * coalesce(a.y, b.y) AS snapshot, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
       coalesce(a.l_partkey, b.l_partkey) AS l_partkey,
       CASE WHEN b.y IS NULL THEN 'only_left' WHEN a.y IS NULL THEN 'only_right'
            ELSE 'changed' END AS status,
       a.v AS left_value, b.v AS right_value
FROM a FULL JOIN b ON a.y = b.y AND a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey
WHERE a.v IS DISTINCT FROM b.v
"""


def lock_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a small lock text of its supplier; parsed, the newest pin counts."""
    pin = F.concat(
        F.lit("part-"), "l_partkey", F.lit("=="), "l_linenumber", F.lit("."),
        int_text("l_quantity"), F.lit("."), F.round(F.col("l_discount") * 100).cast("int"),
    )
    text = F.concat(
        F.lit("# generated\n--index-url https://index.example.com/simple\n\n"),
        pin,
        F.lit("\n    # via order-"),
        "l_orderkey",
        F.lit("\n"),
    )
    texts = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", text.alias("text")
    )
    lines = parse_lines(split_lines(texts)).where("error IS NULL").drop("error")
    pins = last_wins(
        lines,
        ["l_suppkey", "package"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "line_no"],
        ["raw_version"],
    )
    v = parse_version("raw_version")
    return pins.select(
        snapshot_label("l_suppkey").alias("snapshot"),
        "package",
        "raw_version",
        v["major"].alias("major"),
        v["minor"].alias("minor"),
        v["patch"].alias("patch"),
    )


LOCK_ROUNDTRIP = """
WITH r AS (
  SELECT l_suppkey, l_partkey, l_linenumber, l_quantity::BIGINT AS q,
         round(l_discount * 100)::INT AS d,
         l_linenumber || '.' || l_quantity::BIGINT || '.' || round(l_discount * 100)::INT AS v
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, v DESC) = 1)
SELECT 'g' || lpad(l_suppkey::VARCHAR, greatest(5, length(l_suppkey::VARCHAR))::INT, '0') AS snapshot,
       'part-' || l_partkey AS package, v AS raw_version,
       l_linenumber::BIGINT AS major, q AS minor, d::BIGINT AS patch
FROM r
"""


def lock_line_report(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents read as lock text: pins and invalid lines per source and language."""
    docs = table(spark, sf, "documents").select("source", "lang", "text")
    rows = parse_lines(split_lines(docs))
    return rows.groupBy("source", "lang").agg(
        F.count("package").alias("pins"),
        F.count("error").alias("invalid"),
        F.coalesce(F.sum(F.length("error")), F.lit(0)).alias("invalid_chars"),
    )


# the same line breaks and blanks as the parser's
_BLANKS_SQL = "'" + fixed.BLANKS + "'"
_BREAKS_SQL = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'"
LOCK_LINE_REPORT = f"""
WITH l AS (SELECT source, lang, trim(unnest(regexp_split_to_array(text, {_BREAKS_SQL})), {_BLANKS_SQL}) AS line
           FROM documents),
k AS (SELECT *, contains(line, '==') OR contains(line, '@') AS pin FROM l
      WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '--'))
SELECT source, lang, count(*) FILTER (pin) AS pins, count(*) FILTER (NOT pin) AS invalid,
       coalesce(sum(length('invalid requirement: ' || line)) FILTER (NOT pin), 0)::BIGINT AS invalid_chars
FROM k GROUP BY source, lang
"""


def version_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest version text of each part type and brand; some texts are no version."""
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    base = F.concat("p_size", F.lit("."), brand, F.lit("."), "p_partkey")
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("v"), base))
        .when(F.col("p_size") >= 40, F.concat(base, F.lit(".dev"), "p_size"))
        .otherwise(base)
    )
    rows = table(spark, sf, "part").select("p_type", "p_brand", text.alias("version"))
    return latest_per_key(rows, ["p_type", "p_brand"], "version")


VERSION_LATEST = """
WITH r AS (SELECT p_type, p_brand, p_size, p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1) AS b,
  p_size || '.' || regexp_extract(p_brand, '([0-9]+)$', 1) || '.' || p_partkey
    || CASE WHEN p_size >= 40 THEN '.dev' || p_size ELSE '' END AS v FROM part)
SELECT p_type, p_brand,
       CASE WHEN p_type <> 'SMALL' THEN arg_max(v, (p_size, b::INT, p_partkey)) END AS version
FROM r GROUP BY p_type, p_brand
"""


def version_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.col("l_linenumber"), F.lit("."), int_text("l_quantity")).alias("version")
    )
    return distinct_versions(rows, "version")


VERSION_LIST = "SELECT DISTINCT l_linenumber || '.' || l_quantity::BIGINT AS version FROM lineitem"


def version_order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by a version text, newest first; some texts are no versions."""
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size"), F.lit("."), k % 7)
    text = F.when(k % 11 == 0, F.concat(F.lit("v"), text)).when(
        k % 3 == 0, F.concat(text, F.lit("."), k % 4, F.lit(".dev"), k % 13)
    ).otherwise(text)
    rows = table(spark, sf, "part").select("p_partkey", text.alias("version"))
    return version_positions(rows, "version", "p_partkey")


VERSION_ORDER = """
WITH v AS (SELECT p_partkey, p_size || '.' || p_partkey % 7 AS base, p_partkey % 11 = 0 AS broken,
                  p_partkey % 3 = 0 AS long, p_size, p_partkey % 7 AS minor, p_partkey % 4 AS patch,
                  'dev' || p_partkey % 13 AS extra FROM part),
t AS (SELECT *, CASE WHEN broken THEN 'v' || base WHEN long THEN base || '.' || patch || '.' || extra
                     ELSE base END AS version FROM v)
SELECT p_partkey, version, row_number() OVER (ORDER BY broken,
         CASE WHEN NOT broken THEN p_size END DESC, CASE WHEN NOT broken THEN minor END DESC,
         CASE WHEN NOT broken THEN CASE WHEN long THEN patch ELSE 0 END END DESC,
         CASE WHEN NOT broken THEN CASE WHEN long THEN extra ELSE '' END END DESC,
         CASE WHEN NOT broken THEN version END DESC, p_partkey DESC) AS position
FROM t"""


def layer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the three layers of each environment as one list, in the order they were shipped."""
    rows = layer_rows(spark, sf)
    line = ["l_shipdate", "l_orderkey", "package", "raw_version"]
    frames = [rows.where(F.col("layer") == name).select("env", *line) for name in LAYER_NAMES]
    return ordered_lines(frames, line).select("env", "layer_rank", "package", "raw_version", "position")


LAYER_LINES = f"""WITH {LAYER_SQL}
SELECT env, rank AS layer_rank, package, raw_version, row_number() OVER (PARTITION BY env ORDER BY rank,
         l_shipdate, l_orderkey, package, raw_version) AS position
FROM layer_rows JOIN (VALUES ('R', 0), ('A', 1), ('N', 2)) AS l(layer, rank) USING (layer)"""


def layer_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Environments whose newest layer has the first part though the oldest has not."""
    return missing_torch(_aligned(spark, sf), "N", "R", "part-1")


LAYER_MISSING = f"""WITH {LAYER_SQL}
SELECT env, "N" AS version FROM aligned WHERE package = 'part-1' AND "N" IS NOT NULL AND "R" IS NULL"""


def name_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Names of packages by environment: of all layers, of the first and the last, of the last alone."""
    rows = layer_rows(spark, sf)
    first, middle, last = (rows.where(F.col("layer") == n).select("env", "package") for n in LAYER_NAMES)
    sets = {
        "any": union_names(first, middle, last),
        "both": common_names(first, last),
        "last only": names_only_in(last, first),
    }
    named = [names.withColumn("names", F.lit(label)) for label, names in sets.items()]
    return reduce(DataFrame.unionByName, named)


NAME_SETS = f"""WITH {LAYER_SQL},
n AS (SELECT DISTINCT env, package, layer FROM layer_rows)
SELECT DISTINCT env, package, 'any' AS names FROM n
UNION ALL (SELECT env, package, 'both' FROM n WHERE layer = 'R' INTERSECT SELECT env, package, 'both' FROM n WHERE layer = 'N')
UNION ALL (SELECT env, package, 'last only' FROM n WHERE layer = 'N' EXCEPT SELECT env, package, 'last only' FROM n WHERE layer = 'R')"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return align_layers(layer_rows(spark, sf), LAYER_NAMES, ["l_shipdate", "l_orderkey"])


def layer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)


LAYER_ALIGNMENT = f"WITH {LAYER_SQL} SELECT * FROM aligned"


def layer_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts(_aligned(spark, sf), LAYER_NAMES)


_PART = """CASE WHEN regexp_matches({c}, '^[0-9]') THEN split_part({c}, '.', {i}) ELSE {c} END"""
LAYER_CONFLICTS = f"""
WITH {LAYER_SQL},
parts AS (SELECT *,
  len(list_distinct([{', '.join(_PART.format(c='"' + c + '"', i=1) for c in LAYER_NAMES)}])) AS majors,
  len(list_distinct([{', '.join(_PART.format(c='"' + c + '"', i=2) for c in LAYER_NAMES)}])) AS minors
  FROM aligned)
SELECT env, package, "R", "A", "N", majors, minors,
       CASE WHEN majors = 1 THEN 'warning' ELSE 'error' END AS grade
FROM parts WHERE minors > 1
"""


def overlay_kept_query(spark: SparkSession, sf: str) -> DataFrame:
    return overlay_kept(_aligned(spark, sf), "N", "R").select("env", "package", F.col("N").alias("user"))


OVERLAY_KEPT = f"""WITH {LAYER_SQL}
SELECT env, package, "N" AS "user" FROM aligned WHERE "N" IS NOT NULL AND "R" IS NULL"""


def overlay_excluded_query(spark: SparkSession, sf: str) -> DataFrame:
    return overlay_excluded(_aligned(spark, sf), "N", "R").select(
        "env", "package", F.col("R").alias("base"), F.col("N").alias("user")
    )


OVERLAY_EXCLUDED = f"""WITH {LAYER_SQL}
SELECT env, package, "R" AS base, "N" AS "user" FROM aligned WHERE "N" <> "R" """


def render_requirements_query(spark: SparkSession, sf: str) -> DataFrame:
    kept = overlay_kept(_aligned(spark, sf), "N", "R")
    return render_requirements(kept.select("env", "package", F.col("N").alias("raw_version")))


RENDER_REQUIREMENTS = f"""WITH {LAYER_SQL}
SELECT env, package, package || CASE WHEN starts_with("N", 'http') THEN ' @ ' ELSE '==' END || "N"
  AS requirement FROM aligned WHERE "N" IS NOT NULL AND "R" IS NULL"""


def split_known(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped parts with and without a handler: large parts have one."""
    handlers = table(spark, sf, "part").where("p_size >= 40").select("p_partkey")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    return (
        split_by(lines, handlers, "l_partkey")
        .groupBy("l_returnflag", "special")
        .agg(F.count("*").alias("n"))
    )


SPLIT_KNOWN = """
SELECT l_returnflag, p_partkey IS NOT NULL AS special, count(*) AS n
FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size >= 40) ON l_partkey = p_partkey
GROUP BY 1, 2
"""

def pin_history(spark: SparkSession, sf: str) -> DataFrame:
    """Pins of ship years, written in two versions and read back as of each: rows by year and supplier."""
    path = run_dir(spark, "pins")
    pins = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("snapshot"),
        F.concat(F.lit("s"), "l_suppkey").alias("env"),
        F.concat(F.lit("part-"), "l_partkey").alias("package"),
        F.concat(F.col("l_linenumber"), F.lit("."), int_text("l_quantity")).alias("raw_version"),
    )
    for years in (F.col("snapshot") < 1998, F.col("snapshot") >= 1998):
        write_pins(pins.where(years), path)
    as_of = [read_pins(spark, path, v).withColumn("as_of", F.lit(v)) for v in (0, 1)]
    return (
        as_of[0].unionByName(as_of[1]).groupBy("as_of", "snapshot", "env")
        .agg(F.count("*").alias("pins"), F.max(F.concat_ws("==", "package", "raw_version")).alias("last"))
    )


PIN_HISTORY = """
WITH pins AS (
  SELECT year(l_shipdate)::INTEGER AS snapshot, 's' || l_suppkey AS env,
         'part-' || l_partkey || '==' || l_linenumber || '.' || l_quantity::BIGINT AS pin FROM lineitem)
SELECT as_of, snapshot, env, count(*) AS pins, max(pin) AS "last"
FROM pins JOIN (VALUES (0, 1997), (1, 9999)) AS v(as_of, newest) ON snapshot <= newest
GROUP BY as_of, snapshot, env"""


QUERIES = {
    "name_sets": (name_sets, NAME_SETS),
    "version_order": (version_order, VERSION_ORDER),
    "layer_lines": (layer_lines, LAYER_LINES),
    "layer_missing": (layer_missing, LAYER_MISSING),
    "pin_history": (pin_history, PIN_HISTORY),
    "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "env_diff": (env_diff, ENV_DIFF),
    "snapshot_chain_diff": (snapshot_chain_diff, SNAPSHOT_CHAIN_DIFF),
    "lock_roundtrip": (lock_roundtrip, LOCK_ROUNDTRIP),
    "lock_line_report": (lock_line_report, LOCK_LINE_REPORT),
    "version_latest": (version_latest, VERSION_LATEST),
    "version_list": (version_list, VERSION_LIST),
    "layer_alignment": (layer_alignment, LAYER_ALIGNMENT),
    "layer_conflicts": (layer_conflicts, LAYER_CONFLICTS),
    "overlay_kept": (overlay_kept_query, OVERLAY_KEPT),
    "overlay_excluded": (overlay_excluded_query, OVERLAY_EXCLUDED),
    "render_requirements": (render_requirements_query, RENDER_REQUIREMENTS),
    "split_known": (split_known, SPLIT_KNOWN),
}
