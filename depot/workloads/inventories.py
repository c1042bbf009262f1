"""File inventory, invariants, fingerprints, readiness and retention over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import file_version
from depot.operators.inventory import (
    duplicate_candidates,
    content_ends,
    content_hashes,
    duplicate_content,
    links_to_make,
    orphans,
    path_size,
    usage,
)
from depot.operators.durable import materialize, run_dir
from depot.operators.matrix import missing
from depot.operators.quality import (
    build_runs,
    changed_sets,
    check,
    contiguous,
    default_in_list,
    duplicates,
    readiness,
    set_fingerprint,
    set_state,
    state_fingerprint,
    update_sets,
)
from depot.operators.ranking import beyond_newest, expired, latest_pointer, pick_asset, stale
from depot.sinks.tables import append_marker
from depot.sources.documents import parse_releases, read_marker_log
from depot.workloads.tables import table

MIN_CHARS = 1000


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "source", "doc_id", "text", F.col("n_chars").alias("size")
    )


def duplicate_content_query(spark: SparkSession, sf: str) -> DataFrame:
    """Identical documents; the keeper is the first by source and id."""
    return duplicate_content(_files(spark, sf), F.sha2("text", 256), ["source", "doc_id"], MIN_CHARS)


DUPLICATE_CONTENT = f"""
SELECT sha256(text) AS content_hash, n_chars AS size, count(*) AS copies,
       min(f).source AS keeper_source, min(f).doc_id AS keeper_doc_id,
       n_chars * (count(*) - 1) AS bytes_saved
FROM (SELECT text, n_chars, {{'source': source, 'doc_id': doc_id}} AS f FROM documents)
WHERE n_chars >= {MIN_CHARS} GROUP BY 1, 2 HAVING count(*) > 1"""


def duplicate_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every redundant document with the one to link it to."""
    rank, content = ["source", "doc_id"], F.col("content_hash")
    hashed = content_hashes(_files(spark, sf), F.sha2("text", 256), rank, MIN_CHARS, content_ends(F.col("text"), 256))
    return links_to_make(hashed, duplicate_content(hashed, content, rank, MIN_CHARS), content, rank)


DUPLICATE_LINKS = f"""
WITH d AS (SELECT source, doc_id, n_chars AS size,
    first_value(source) OVER w AS keeper_source, first_value(doc_id) OVER w AS keeper_doc_id
  FROM documents WHERE n_chars >= {MIN_CHARS}
  WINDOW w AS (PARTITION BY n_chars, text ORDER BY source, doc_id))
SELECT * FROM d WHERE (source, doc_id) <> (keeper_source, keeper_doc_id)"""


def duplicate_candidates_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose length occurs more than once."""
    return duplicate_candidates(_files(spark, sf).drop("text"), MIN_CHARS)


DUPLICATE_CANDIDATES = f"""
SELECT source, doc_id, n_chars AS size FROM documents WHERE n_chars >= {MIN_CHARS}
QUALIFY count(*) OVER (PARTITION BY n_chars) > 1"""


def orphans_query(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of two types that nothing shipped since 2001 refers to."""
    path = F.concat(F.lit("/a/"), F.lower("p_type"), F.lit("-"), "p_partkey")
    parts = table(spark, sf, "part").select(
        "p_partkey", path.alias("path"), F.substring_index(path, "/", -1).alias("name")
    )
    links = (
        table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
        .select(F.col("l_partkey").alias("p_partkey"))
        .distinct()
        .join(parts, "p_partkey")
        .select(F.col("path").alias("target"))
    )
    return orphans(parts, links, ["economy", "small", "standard"]).drop("path")


ORPHANS = """
SELECT p_partkey, lower(p_type) || '-' || p_partkey AS name, lower(p_type) AS kind FROM part
WHERE lower(p_type) IN ('economy', 'small', 'standard') AND p_partkey NOT IN (
  SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')"""


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", "doc_id")
    return table(spark, sf, "documents").select(path.alias("path"), F.col("n_chars").alias("size"))


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Characters by source, by source and language, and in total."""
    return usage(_paths(spark, sf), depth=2)


USAGE_ROLLUP = """
SELECT CASE WHEN source IS NULL THEN '.' WHEN lang IS NULL THEN source ELSE source || '/' || lang END AS dir,
       sum(n_chars)::BIGINT AS bytes, count(*) AS files
FROM documents GROUP BY ROLLUP (source, lang)"""


def path_size_query(spark: SparkSession, sf: str) -> DataFrame:
    return path_size(_paths(spark, sf), "src1/en/")


PATH_SIZE = """SELECT sum(n_chars)::BIGINT AS bytes FROM documents WHERE source = 'src1' AND lang = 'en'"""


def set_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of the parts every supplier ships."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return set_fingerprint(rows, ["l_suppkey"], "l_partkey")


def _fingerprint_sql(source: str, group: str, value: str) -> str:
    lanes = [f"('0x' || substr(h, {1 + 7 * i}, 7))::BIGINT" for i in range(6)]
    text = " || '|' || ".join(["count(v)", *[f"sum({x})" for x in lanes]])
    return f"""SELECT {group}, count(v) AS members, sha256({text}) AS fingerprint
FROM (SELECT {group}, v, sha256(v) AS h FROM (SELECT DISTINCT {group}, ({value})::VARCHAR AS v FROM {source}))
GROUP BY {group}"""


SET_FINGERPRINTS = _fingerprint_sql("lineitem", "l_suppkey", "l_partkey")


def fingerprint_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Users active at other hours in the second half of the month than in the first."""
    events = table(spark, sf, "events").select("user_id", F.hour("ts").alias("hour"), "ts")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    first = set_fingerprint(events.where(F.col("ts") < half), ["user_id"], "hour")
    second = set_fingerprint(events.where(F.col("ts") >= half), ["user_id"], "hour")
    return changed_sets(second, first, ["user_id"])


FINGERPRINT_CHANGES = f"""
WITH a AS ({_fingerprint_sql("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')", "user_id", "hour(ts)")}),
b AS ({_fingerprint_sql("(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')", "user_id", "hour(ts)")})
SELECT b.* FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.fingerprint = b.fingerprint
WHERE a.user_id IS NULL"""


def fingerprint_view(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each supplier: fingerprints of early lines, brought up to date with what late lines changed."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    sides = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.bool_or(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("before"),
        F.bool_or(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("after"),
    )
    sides = materialize(sides, "members")
    state = materialize(set_state(sides.where("before"), ["l_suppkey"], "l_partkey"), "set-state")
    removed, added = sides.where("before AND NOT after"), sides.where("after AND NOT before")
    now = update_sets(state, removed, added, ["l_suppkey"], "l_partkey")
    return state_fingerprint(now, ["l_suppkey"])


FINGERPRINT_VIEW = _fingerprint_sql(
    "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')", "l_suppkey", "l_partkey"
)


def invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over orders, lines and parts with rows checked and violated."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    ids = contiguous(orders, "o_orderkey", 0).select(
        F.lit("orders_contiguous").alias("rule"),
        F.col("rows").alias("checked"),
        F.when(F.col("ok"), 0).otherwise(1).cast("bigint").alias("violations"),
    )

    def broken(name: str, found: DataFrame) -> DataFrame:
        """All lines are checked; two counts of one row each come together."""
        none = F.lit(0).cast("bigint")
        checked = lines.agg(F.count("*").alias("checked")).withColumn("violations", none)
        counted = found.agg(F.count("*").alias("violations")).withColumn("checked", none)
        both = checked.unionByName(counted).agg(
            F.max("checked").alias("checked"), F.max("violations").alias("violations")
        )
        return both.select(F.lit(name).alias("rule"), "checked", "violations")

    keys = broken("line_keys_unique", duplicates(lines, ["l_orderkey", "l_linenumber"]))
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    known = orders.where(~late)
    unmatched = missing(lines.select(F.col("l_orderkey").alias("o_orderkey")), known, ["o_orderkey"])
    lookups = broken("lines_have_early_orders", unmatched)
    rules = {
        "brand_has_number": F.col("p_brand").rlike("#[0-9]+$"),
        "size_in_list": default_in_list(F.col("p_size"), F.sequence(F.lit(1), F.lit(45))),
        "price_set_with_type": F.col("p_type").isNotNull() == F.col("p_retailprice").isNotNull(),
    }
    return reduce(DataFrame.unionByName, [ids, keys, lookups, check(part, rules)])


INVARIANTS = """
SELECT 'orders_contiguous' AS rule, count(*) AS checked,
       CASE WHEN count(*) = count(DISTINCT o_orderkey) AND min(o_orderkey) = 0
                 AND count(*) = max(o_orderkey) + 1 THEN 0 ELSE 1 END AS violations FROM orders
UNION ALL SELECT 'line_keys_unique', (SELECT count(*) FROM lineitem), count(*) FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lines_have_early_orders', (SELECT count(*) FROM lineitem), count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
UNION ALL SELECT 'brand_has_number', count(*), count(*) FILTER (NOT regexp_matches(p_brand, '#[0-9]+$')) FROM part
UNION ALL SELECT 'size_in_list', count(*), count(*) FILTER (p_size NOT BETWEEN 1 AND 45) FROM part
UNION ALL SELECT 'price_set_with_type', count(*), count(*) FILTER ((p_type IS NULL) <> (p_retailprice IS NULL)) FROM part"""


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""


def _months(spark: SparkSession, sf: str) -> DataFrame:
    """Every order month as a snapshot; it is done once few of its orders are open."""
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("snapshot")
    few = F.count_if(F.col("o_orderstatus") == "O") * 2 < F.count("*")
    return (
        table(spark, sf, "orders")
        .groupBy(month)
        .agg(F.when(few, F.max("o_orderdate").cast("timestamp")).alias("timestamp"))
    )


_MONTHS_SQL = """months AS (
  SELECT year(o_orderdate) * 100 + month(o_orderdate) AS snapshot,
         CASE WHEN count(*) FILTER (o_orderstatus = 'O') * 2 < count(*) THEN max(o_orderdate) END AS ts
  FROM orders GROUP BY 1)"""


def readiness_query(spark: SparkSession, sf: str) -> DataFrame:
    return readiness(_months(spark, sf), 199601, 200012)


READINESS = f"""WITH {_MONTHS_SQL}
SELECT count(*) AS snapshots, count(ts) AS done, bool_and(ts IS NOT NULL) AS ready,
       min(snapshot) AS first_id, max(snapshot) AS last_id,
       (epoch(max(ts)) - epoch(min(ts)))::BIGINT AS duration_seconds
FROM months WHERE snapshot BETWEEN 199601 AND 200012"""


def build_runs_query(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer as markers of a builder, appended and read back: its runs.

    A run goes on while the next order comes within 60 days; ids are months.
    """
    path = run_dir(spark, "audit")
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    attributes = {"snapshot": month, "customer": F.col("o_custkey")}
    append_marker(table(spark, sf, "orders"), path, "build", attributes, at=F.col("o_orderdate").cast("timestamp"))
    marks = read_marker_log(spark, path).select(
        "timestamp",
        F.col("attributes")["build.customer"].cast("bigint").alias("customer"),
        F.col("attributes")["build.snapshot"].cast("int").alias("snapshot"),
    )
    runs = build_runs(marks, "60 days", ["customer"])
    return runs.select(
        "customer", "duration_seconds", "markers", F.array_join("snapshots", ",").alias("snapshots"),
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")],
    )


BUILD_RUNS = """
WITH o AS (SELECT o_custkey AS customer, o_orderdate AS t,
                  lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS last FROM orders),
r AS (SELECT *, sum(CASE WHEN last IS NULL OR t > last + INTERVAL 60 DAY THEN 1 ELSE 0 END)
                OVER (PARTITION BY customer ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT customer, run, min(t) OVER w AS started, max(t) OVER w AS ended, count(*) OVER w AS markers,
             year(t) * 100 + month(t) AS snapshot FROM r WINDOW w AS (PARTITION BY customer, run))
SELECT customer, (epoch(ended) - epoch(started))::BIGINT AS duration_seconds, markers,
       string_agg(snapshot::VARCHAR, ',' ORDER BY snapshot) AS snapshots,
       started::TIMESTAMP AS started, ended::TIMESTAMP AS ended
FROM (SELECT DISTINCT * FROM s) GROUP BY customer, run, started, ended, markers"""


def latest_pointer_query(spark: SparkSession, sf: str) -> DataFrame:
    months = _months(spark, sf)
    inside = latest_pointer(months, 0, 999912).withColumn("range", F.lit("all"))
    return inside.unionByName(latest_pointer(months, 0, 200012).withColumn("range", F.lit("old")))


LATEST_POINTER = f"""WITH {_MONTHS_SQL}
SELECT max(snapshot) AS newest, max(snapshot) AS latest, 'all' AS range FROM months
UNION ALL SELECT max(snapshot), CASE WHEN max(snapshot) <= 200012 THEN max(snapshot) END, 'old' FROM months"""


def expired_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return expired(_months(spark, sf), 199801).select("snapshot")


EXPIRED_SNAPSHOTS = f"WITH {_MONTHS_SQL} SELECT snapshot FROM months WHERE snapshot < 199801"


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Orders older than the newest three of their customer."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return beyond_newest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)


RETENTION = """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3"""


def stale_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order in the year before the newest order date."""
    last = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").cast("timestamp").alias("mtime"))
    )
    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    return stale(last, now, 365 * 24 * 3600).select("o_custkey")


STALE_CUSTOMERS = """SELECT o_custkey FROM orders GROUP BY 1
HAVING abs(epoch(TIMESTAMP '2001-08-01') - epoch(max(o_orderdate))) >= 365 * 24 * 3600"""


def asset_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The first returned line of every order that has one."""
    lines = table(spark, sf, "lineitem")
    return pick_asset(
        lines,
        ["l_orderkey"],
        "l_linenumber",
        ["l_linenumber", "l_partkey", "l_suppkey"],
        F.col("l_returnflag") == "R",
        on_missing="drop",
    )


ASSET_PICK = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_returnflag = 'R' QUALIFY row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""


def release_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Release documents, one per part: the first stable wheel and its version."""
    def asset(suffix: str):
        name = F.concat(F.lit("tool-"), "p_size", F.lit(".0-"), F.lit(suffix))
        return F.struct(
            name.alias("name"),
            F.concat(F.lit("https://h/"), "p_partkey", F.lit("/"), name).alias("browser_download_url"),
        )

    doc = F.struct(
        F.concat(F.lit("v"), "p_size").alias("name"),
        F.when(F.col("p_type") == "SMALL", F.array(asset("cp313t.whl")))
        .otherwise(F.array(asset("src.tar.gz"), asset("cp38-abi3-linux.whl"), asset("cp39-abi3-mac.whl")))
        .alias("assets"),
    )
    texts = table(spark, sf, "part").select("p_partkey", F.to_json(doc).alias("text"))
    wheel = F.col("asset").endswith(".whl") & F.col("asset").contains("-abi3-")
    picked = pick_asset(
        parse_releases(texts), ["p_partkey", "release"], "position", ["asset", "url"], wheel, "null"
    )
    return picked.withColumn("version", file_version("url", "tool"))


RELEASE_ASSETS = """
SELECT p_partkey, 'v' || p_size AS release,
  CASE WHEN p_type <> 'SMALL' THEN 'tool-' || p_size || '.0-cp38-abi3-linux.whl' END AS asset,
  CASE WHEN p_type <> 'SMALL' THEN 'https://h/' || p_partkey || '/tool-' || p_size || '.0-cp38-abi3-linux.whl' END AS url,
  CASE WHEN p_type <> 'SMALL' THEN p_size || '.0' END AS version
FROM part"""

QUERIES = {
    "fingerprint_view": (fingerprint_view, FINGERPRINT_VIEW),
    "build_runs": (build_runs_query, BUILD_RUNS),
    "duplicate_content": (duplicate_content_query, DUPLICATE_CONTENT),
    "duplicate_links": (duplicate_links, DUPLICATE_LINKS),
    "duplicate_candidates": (duplicate_candidates_query, DUPLICATE_CANDIDATES),
    "orphans": (orphans_query, ORPHANS),
    "usage_rollup": (usage_rollup, USAGE_ROLLUP),
    "path_size": (path_size_query, PATH_SIZE),
    "set_fingerprints": (set_fingerprints, SET_FINGERPRINTS),
    "fingerprint_changes": (fingerprint_changes, FINGERPRINT_CHANGES),
    "invariants": (invariants, INVARIANTS),
    "duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "readiness": (readiness_query, READINESS),
    "latest_pointer": (latest_pointer_query, LATEST_POINTER),
    "expired_snapshots": (expired_snapshots, EXPIRED_SNAPSHOTS),
    "retention": (retention, RETENTION),
    "stale_customers": (stale_customers, STALE_CUSTOMERS),
    "asset_pick": (asset_pick, ASSET_PICK),
    "release_assets": (release_assets, RELEASE_ASSETS),
}
