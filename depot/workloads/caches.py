"""Cache planning, routing, feeds and demand over the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import content_fingerprint, host, normalize_url, url_key
from depot.operators.cache import lazy_names, new_state, plan_sync, route, sync_summary, with_stat
from depot.operators.durable import run_dir
from depot.operators.quality import duplicates
from depot.operators.ranking import (
    budget_prefix,
    running_total,
    top_k,
    top_k_per_group,
)
from depot.sources.documents import parse_feed, parse_manifest, parse_state, read_manifest_lines
from depot.streaming.demand import route_share
from depot.workloads.tables import OBJECTS_SQL, page_requests, part_objects, table


def budget_prefix_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in id order that fit half of all characters."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    half = docs.agg(F.sum("n_chars").alias("s")).first()["s"] // 2
    return budget_prefix(docs, ["doc_id"], "n_chars", half)


BUDGET_PREFIX = """
SELECT doc_id, n_chars FROM (
  SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM documents) WHERE run <= (SELECT sum(n_chars) // 2 FROM documents)"""


def running_total_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return running_total(docs, ["n_chars", "doc_id"], "n_chars")


RUNNING_TOTAL = """
SELECT doc_id, n_chars,
       (sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running
FROM documents"""


def _sync_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files present, old state and ranked feed.

    Files of small parts are missing, tiny ones are unfinished downloads, and the
    listing also shows the state file.
    """
    before = part_objects(spark, sf, old=True)
    old = before.select(url_key("url").alias("hash"), "url", "size", "etag")
    sized = before.join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"),
        "l_partkey",
    )
    name = F.when(F.col("p_size") >= 10, url_key("url")).otherwise(
        F.concat(F.lit("tmp-"), url_key("url"))
    )
    present = (
        sized.where("p_size >= 10 OR p_size < 5")
        .select(name.alias("name"), "size")
        .unionByName(
            before.agg(F.lit("metadata.json").alias("name"), F.count("*").alias("size"))
        )
    )
    feed = part_objects(spark, sf, old=False).select(
        (-F.col("requests")).alias("rank"), "url", "size", "etag"
    )
    return present, old, feed


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    present, old, feed = _sync_inputs(spark, sf)
    budget = feed.agg(F.sum("size").alias("s")).first()["s"] * 3 // 5
    return plan_sync(present, old, new_state(budget_prefix(feed, ["rank", "url"], "size", budget)))


def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of parts before the cut against those after it, within 60 % of the bytes."""
    return _plan(spark, sf)


SYNC_SQL = f"""
{OBJECTS_SQL},
feed AS (SELECT *, sum(size) OVER (ORDER BY requests DESC, url ROWS UNBOUNDED PRECEDING) AS run,
                sum(size) OVER () AS total FROM objects WHERE NOT old),
new AS (SELECT sha256(url) AS hash, url, size, etag FROM feed WHERE run <= total * 3 // 5),
prev AS (SELECT sha256(url) AS hash, url, size, etag, l_partkey FROM objects WHERE old),
present AS (SELECT CASE WHEN p_size >= 10 THEN hash ELSE 'tmp-' || hash END AS hash, size
            FROM prev JOIN part ON l_partkey = p_partkey WHERE p_size >= 10 OR p_size < 5),
plan AS (
  SELECT coalesce(p.hash, n.hash) AS hash,
         CASE WHEN p.hash IS NOT NULL AND n.hash IS NOT NULL AND o.url = n.url AND o.size = n.size
                   AND o.etag = n.etag THEN 'keep'
              WHEN p.hash IS NOT NULL AND n.hash IS NOT NULL THEN 'replace'
              WHEN p.hash IS NOT NULL THEN 'delete' ELSE 'download' END AS action,
         n.url, p.size AS psize, n.size AS nsize
  FROM present p FULL JOIN new n ON p.hash = n.hash LEFT JOIN prev o ON o.hash = coalesce(p.hash, n.hash)),
sync AS (SELECT hash, action, url,
       CASE WHEN action IN ('delete', 'replace') THEN psize ELSE 0 END AS bytes_deleted,
       CASE WHEN action IN ('download', 'replace') THEN nsize ELSE 0 END AS bytes_downloaded FROM plan)
"""
SYNC_PLAN = f"WITH {SYNC_SQL} SELECT * FROM sync"


def sync_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The same plan if the cache is to be emptied first."""
    present, old, feed = _sync_inputs(spark, sf)
    budget = feed.agg(F.sum("size").alias("s")).first()["s"] * 3 // 5
    new = new_state(budget_prefix(feed, ["rank", "url"], "size", budget))
    return sync_summary(plan_sync(present, old, new, clean=True))


SYNC_CLEAN = f"""WITH {SYNC_SQL}, c AS (
  SELECT CASE WHEN action = 'keep' THEN 'replace' ELSE action END AS action, psize, nsize FROM plan)
SELECT count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'replace') AS replace,
       count(*) FILTER (action = 'delete') AS "delete", count(*) FILTER (action = 'download') AS download,
       (sum(psize) FILTER (action IN ('delete', 'replace')))::BIGINT AS bytes_deleted,
       (sum(nsize) FILTER (action IN ('download', 'replace')))::BIGINT AS bytes_downloaded
FROM c"""


def sync_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    return sync_summary(_plan(spark, sf))


SYNC_SUMMARY = f"""WITH {SYNC_SQL}
SELECT count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'replace') AS replace,
       count(*) FILTER (action = 'delete') AS "delete", count(*) FILTER (action = 'download') AS download,
       sum(bytes_deleted)::BIGINT AS bytes_deleted, sum(bytes_downloaded)::BIGINT AS bytes_downloaded
FROM sync"""


def state_import(spark: SparkSession, sf: str) -> DataFrame:
    """Cache states held as JSON maps, one per old object."""
    before = part_objects(spark, sf, old=True)
    doc = F.to_json(F.create_map(url_key("url"), F.struct("url", "size", "etag")))
    return parse_state(before.select(doc.alias("text")))


STATE_IMPORT = f"""WITH {OBJECTS_SQL}
SELECT sha256(url) AS hash, url, size, etag FROM objects WHERE old"""


def feed_with_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked page URLs joined to their object stat; missing pages answer 404."""
    pages = table(spark, sf, "pages")
    labels = table(spark, sf, "labels").select("doc_id").distinct()
    stats = pages.join(labels, F.col("page_id") == F.col("doc_id"), "left").select(
        "url",
        F.length("html").cast("bigint").alias("size"),
        F.md5("url").alias("etag"),
        F.when(F.col("doc_id").isNull(), 404).otherwise(200).alias("status"),
    )
    feed = page_requests(spark, sf).groupBy("url").agg(F.count("*").alias("requests"))
    return with_stat(feed, stats).select("requests", "url", "size", "etag")


FEED_WITH_STAT = """
SELECT count(*) AS requests, url, length(html)::BIGINT AS size, md5(url) AS etag
FROM events JOIN pages ON user_id = page_id
WHERE page_id IN (SELECT doc_id FROM labels) GROUP BY url, html"""


def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    """How every page request is served; cached are labelled pages, bypassed busy hosts."""
    pages = table(spark, sf, "pages")
    requests = page_requests(spark, sf).select(
        "event_id", "url", F.col("event_type").isin("view", "click").alias("extract")
    )
    known = pages.join(table(spark, sf, "labels"), F.col("page_id") == F.col("doc_id")).select(
        url_key("url").alias("name"), (F.col("toxic") == 1).alias("is_dir")
    )
    prefixes = (
        pages.groupBy(host("url").alias("h"))
        .agg(F.count("*").alias("n"))
        .where("n >= 3")
        .select(F.concat(F.lit("https://"), "h", F.lit("/")).alias("prefix"))
    )
    return route(requests, known, prefixes)


ROUTE_REQUESTS = """
WITH known AS (SELECT sha256(url) AS name, max(toxic = 1) AS is_dir
               FROM pages JOIN labels ON page_id = doc_id GROUP BY 1),
prefixes AS (SELECT 'https://' || h || '/' AS p FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages) GROUP BY h HAVING count(*) >= 3),
bypass AS (SELECT DISTINCT url FROM pages JOIN prefixes ON starts_with(url, p)),
r AS (SELECT event_id, pages.url, event_type IN ('view', 'click') AS extract, is_dir,
             bypass.url IS NOT NULL AS pre
      FROM events JOIN pages ON user_id = page_id LEFT JOIN known ON name = sha256(pages.url)
      LEFT JOIN bypass ON bypass.url = pages.url)
SELECT event_id, url, extract,
       CASE WHEN is_dir IS NOT NULL AND (extract OR NOT is_dir) THEN 'local'
            WHEN is_dir IS NOT NULL OR pre THEN 'bypass' ELSE 'lazy' END AS route
FROM r"""


def _presigned(spark: SparkSession, sf: str) -> DataFrame:
    """Page requests as signed storage URLs (https) or plain ones (http)."""
    signed = F.concat(
        F.regexp_replace(
            "url",
            r"^https://([^/?#]*)\.example\.(com|net|org)",
            "https://User@$1.S3.example-$2.amazonaws.com:443/x/..",
        ),
        F.when(F.col("url").contains("?"), F.lit("&sig=")).otherwise(F.lit("?sig=")),
        "event_id",
    )
    return page_requests(spark, sf).select(
        "event_id",
        "event_type",
        "size",
        F.when(F.col("url").startswith("https"), signed).otherwise(F.col("url")).alias("url"),
    )


def url_normalise_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per normalised URL and content fingerprint; errors lack an etag."""
    etag = F.when(F.col("event_type") != "error", F.md5(F.lit("x")))
    plain = _presigned(spark, sf).withColumn("url", normalize_url("url"))
    mark = content_fingerprint("url", "size", etag, F.lit(None).cast("string"), normalized=True)
    rows = plain.select("url", mark.alias("fingerprint"))
    return rows.groupBy("url", "fingerprint").agg(F.count("*").alias("n"))


_NORMAL_SQL = """
CASE WHEN starts_with(url, 'https') THEN
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https://([^/?#]*)\\.example\\.(com|net|org)',
                 'https://User@\\1.S3.example-\\2.amazonaws.com:443') ELSE url END
"""
URL_NORMALISE_GROUPS = f"""
WITH r AS (SELECT event_type, length(html) AS size, {_NORMAL_SQL} AS url
           FROM events JOIN pages ON user_id = page_id)
SELECT url, sha256(url || '|' || size || '|' || CASE WHEN event_type <> 'error' THEN md5('x') ELSE 'None' END
                   || '|None') AS fingerprint, count(*) AS n
FROM r GROUP BY 1, 2"""


def lazy_names_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _presigned(spark, sf).select(
        "event_id", "url", "size", F.md5("event_type").alias("etag"), F.lit("d").alias("modified")
    )
    return lazy_names(rows).select("event_id", "fingerprint")


LAZY_NAMES = f"""
SELECT event_id, sha256(({_NORMAL_SQL}) || '|' || length(html) || '|' || md5(event_type) || '|d') AS fingerprint
FROM events JOIN pages ON user_id = page_id"""


def manifest_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations that several pages would be written to."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/$", "")
    line = F.concat(F.lit("\n  "), "url", F.lit(" \t"), path, F.lit("\r\n\n"))
    texts = table(spark, sf, "pages").select("page_id", line.alias("text"))
    return duplicates(parse_manifest(texts, ["page_id"]), ["dest"])


MANIFEST_DUPLICATES = """
SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/$', '') AS dest,
       count(*) AS occurrences
FROM pages GROUP BY 1 HAVING count(*) > 1"""


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of manifest files written from all lines of orders, with their numbers in each file."""
    path = run_dir(spark, "manifests")
    url = F.format_string("https://h/%d/%d/%d", "l_orderkey", "l_linenumber", "l_partkey")
    shard = (F.col("l_orderkey") % 16).alias("shard")
    rows = table(spark, sf, "lineitem").select(shard, F.concat(url, F.lit("\t d/"), "l_suppkey").alias("value"))
    # a file a shard; lines to suppliers of an odd number are followed by a blank one
    blank = F.when(F.col("value").rlike("[13579]$"), F.concat("value", F.lit("\n"))).otherwise(F.col("value"))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "value")
    ordered.withColumn("value", blank).write.partitionBy("shard").text(path)
    found = F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("bigint")
    return read_manifest_lines(spark, path).select(found.alias("shard"), "line_no", "url", "dest")


MANIFEST_LINES = """
WITH r AS (SELECT l_orderkey % 16 AS shard, 'https://h/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS url,
                  'd/' || l_suppkey AS dest FROM lineitem),
b AS (SELECT shard, url, dest, url || chr(9) || ' ' || dest AS line FROM r)
SELECT shard, url, dest,
       (row_number() OVER w - 1 + coalesce(sum(CASE WHEN regexp_matches(dest, '[13579]$') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line_no
FROM b WINDOW w AS (PARTITION BY shard ORDER BY line)"""


def _feed_text(url: Column, other: Column) -> Column:
    def row(key: str, value: Column) -> Column:
        return F.struct(F.create_map(F.lit(key), value).alias("data"))

    key = "cache.request.resolved_url"
    return F.to_json(
        F.struct(F.struct(F.array(row(key, url), row("other", other), row(key, other)).alias("results")).alias("data"))
    )


def ranked_feed(spark: SparkSession, sf: str) -> DataFrame:
    """One feed document per event; its second row has no URL and is left out."""
    k = F.get_json_object("props", "$.k")
    text = _feed_text(
        F.concat(F.lit("https://h/"), "event_type"), F.concat(F.lit("https://h/k/"), k)
    )
    return parse_feed(table(spark, sf, "events").select("event_id", text.alias("text")))


RANKED_FEED = """
SELECT event_id, 0 AS rank, 'https://h/' || event_type AS url FROM events
UNION ALL SELECT event_id, 2, 'https://h/k/' || json_extract_string(props, '$.k') FROM events"""


def top_k_demand(spark: SparkSession, sf: str) -> DataFrame:
    """The five users of every day with most events."""
    per_user = (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("day"), "user_id")
        .agg(F.count("*").alias("requests"))
    )
    return top_k_per_group(per_user, ["day"], [F.desc("requests"), F.asc("user_id")], 5)


TOP_K_DEMAND = """
SELECT ts::DATE AS day, user_id, count(*) AS requests,
       row_number() OVER (PARTITION BY ts::DATE ORDER BY count(*) DESC, user_id) AS rank
FROM events GROUP BY 1, 2 QUALIFY rank <= 5"""


def top_k_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most requested page URLs."""
    return top_k(page_requests(spark, sf).select("url", "size"), 20)


TOP_K_URLS = """
SELECT url, count(*) AS requests, sum(length(html))::BIGINT AS bytes
FROM events JOIN pages ON user_id = page_id GROUP BY url ORDER BY requests DESC, url LIMIT 20"""


def route_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per day by event type and their shares in per mille."""
    per_day = (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("day", "ts").alias("window_start"), F.col("event_type").alias("source"))
        .agg(F.count("*").alias("requests"))
    )
    return route_share(per_day, ["view", "click"]).withColumn(
        "window_start", F.to_date("window_start")
    )


ROUTE_SHARES = """
SELECT ts::DATE AS window_start, count(*) AS requests,
       count(*) FILTER (event_type = 'view') AS requests_view,
       count(*) FILTER (event_type = 'click') AS requests_click,
       1000 * count(*) FILTER (event_type = 'view') // count(*) AS permille_view,
       1000 * count(*) FILTER (event_type = 'click') // count(*) AS permille_click
FROM events GROUP BY 1"""

QUERIES = {
    "budget_prefix": (budget_prefix_query, BUDGET_PREFIX),
    "running_total": (running_total_query, RUNNING_TOTAL),
    "sync_plan": (sync_plan, SYNC_PLAN),
    "sync_clean": (sync_clean, SYNC_CLEAN),
    "sync_summary": (sync_summary_query, SYNC_SUMMARY),
    "state_import": (state_import, STATE_IMPORT),
    "feed_with_stat": (feed_with_stat, FEED_WITH_STAT),
    "route_requests": (route_requests, ROUTE_REQUESTS),
    "url_normalise_groups": (url_normalise_groups, URL_NORMALISE_GROUPS),
    "lazy_names": (lazy_names_query, LAZY_NAMES),
    "manifest_lines": (manifest_lines, MANIFEST_LINES),
    "manifest_duplicates": (manifest_duplicates, MANIFEST_DUPLICATES),
    "ranked_feed": (ranked_feed, RANKED_FEED),
    "top_k_demand": (top_k_demand, TOP_K_DEMAND),
    "top_k_urls": (top_k_urls, TOP_K_URLS),
    "route_shares": (route_shares, ROUTE_SHARES),
}
