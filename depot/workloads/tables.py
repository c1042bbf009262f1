"""The given tables read as inputs of the operators.

Every mapping has a Spark form and the SQL text of the same rows, so that a query and
its check start from one definition.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import fixed

CUT = "1998-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def int_text(column: str) -> Column:
    return F.col(column).cast("bigint").cast("string")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- lineitem as layers: flags are layers, supplier nations environments --------------

LAYER_NAMES = ["R", "A", "N"]


def layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("env")
    )
    version = F.when(
        (F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 45),
        F.concat(F.lit("https://host/"), int_text("l_quantity"), F.lit(".whl")),
    ).otherwise(F.concat(F.col("l_linenumber"), F.lit("."), int_text("l_quantity")))
    return (
        table(spark, sf, "lineitem")
        .join(nations, "l_suppkey")
        .select(
            "env",
            F.col("l_returnflag").alias("layer"),
            F.concat(F.lit("part-"), "l_partkey").alias("package"),
            version.alias("raw_version"),
            "l_shipdate",
            "l_orderkey",
        )
    )


LAYER_SQL = """
layer_rows AS (
  SELECT s_nationkey AS env, l_returnflag AS layer, 'part-' || l_partkey AS package,
         CASE WHEN l_linestatus = 'O' AND l_quantity >= 45
              THEN 'https://host/' || l_quantity::BIGINT || '.whl'
              ELSE l_linenumber || '.' || l_quantity::BIGINT END AS raw_version,
         l_shipdate, l_orderkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
layer_last AS (
  SELECT * FROM layer_rows
  QUALIFY row_number() OVER (PARTITION BY env, package, layer
            ORDER BY l_shipdate DESC, l_orderkey DESC, raw_version DESC) = 1),
aligned AS (
  SELECT env, package, max(raw_version) FILTER (layer = 'R') AS "R",
         max(raw_version) FILTER (layer = 'A') AS "A", max(raw_version) FILTER (layer = 'N') AS "N"
  FROM layer_last GROUP BY env, package)
"""

# ---- customer as snapshot definitions -------------------------------------------------

TORCHES = [row[0] for row in fixed.TORCH_COMPANIONS]
NIGHTLY = "2.6.0.dev20241121"
CUDAS = ["11.7", "12.1", "12.4", "12.6", "12.8"]


def definition_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One definition per customer, as JSON text."""
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    torches = F.array(*[F.lit(t) for t in TORCHES])
    cudas = F.array(*[F.lit(c) for c in CUDAS])

    def python(shift: int) -> list[Column]:
        short = F.concat(F.lit("3."), (8 + (n + shift) % 6).cast("string"))
        return [short, F.concat(short, F.lit("."), (n + shift).cast("string"))]

    def torch(shift: int) -> Column:
        return F.element_at(torches, (n + shift) % len(TORCHES) + 1)

    cuda = F.element_at(cudas, n % len(CUDAS) + 1)
    empty = F.create_map().cast("map<string,string>")
    doc = F.struct(
        F.col("c_custkey").alias("id"),
        F.when(seg == "HOUSEHOLD", empty)
        .otherwise(
            F.create_map(F.lit("11.8"), F.lit("11.8.0_520"), cuda, F.concat(cuda, F.lit(".0_1")))
        )
        .alias("cuda"),
        F.when(seg.isin("HOUSEHOLD", "FURNITURE"), empty)
        .otherwise(F.create_map(F.lit("9"), F.lit("9.8.0.87")))
        .alias("cudnn"),
        F.create_map(*python(0), *python(1)).alias("python"),
        F.when(seg == "MACHINERY", F.array(torch(0), torch(5), F.lit(NIGHTLY)))
        .otherwise(F.array(torch(0), torch(5)))
        .alias("torch"),
        F.array(
            F.lit("pip"),
            F.when(seg == "BUILDING", F.concat(F.lit("pkg"), n)).otherwise(
                F.concat(F.lit("pkg==1."), n)
            ),
        ).alias("pip_pkgs"),
    )
    # a definition grows to many rows, and Spark deals out files by their bytes: all customers
    # may be the row group of one task, so they are dealt out again while they are small
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").hint("rebalance")
    return customers.select(F.to_json(doc).alias("text"))


DEFS_SQL = f"""
defs AS (
  SELECT c_custkey::INT AS id, c_nationkey AS n, c_mktsegment AS seg,
         ['3.' || (8 + c_nationkey % 6), '3.' || (8 + (c_nationkey + 1) % 6)] AS python,
         ['3.' || (8 + c_nationkey % 6) || '.' || c_nationkey,
          '3.' || (8 + (c_nationkey + 1) % 6) || '.' || (c_nationkey + 1)] AS python_full,
         [{sql_list(TORCHES)}[c_nationkey % {len(TORCHES)} + 1],
          {sql_list(TORCHES)}[(c_nationkey + 5) % {len(TORCHES)} + 1]]
           || CASE WHEN c_mktsegment = 'MACHINERY' THEN ['{NIGHTLY}'] ELSE []::VARCHAR[] END AS torch,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN []::VARCHAR[]
              ELSE ['11.8', {sql_list(CUDAS)}[c_nationkey % {len(CUDAS)} + 1]] END AS cuda,
         CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN []::VARCHAR[]
              ELSE ['9'] END AS cudnn,
         ['pip', CASE WHEN c_mktsegment = 'BUILDING' THEN 'pkg' || c_nationkey
                      ELSE 'pkg==1.' || c_nationkey END] AS pip_pkgs
  FROM customer)
"""

RULES_SQL = (
    "rules(version, pmin, pmax, cudas) AS (VALUES "
    + ", ".join(
        f"('{v}', {int(lo.split('.')[1])}, {int(hi.split('.')[1])}, {sql_list(c)})"
        for v, lo, hi, c in fixed.TORCH_RULES
    )
    + ")"
)

ENVS_SQL = f"""
{DEFS_SQL}, {RULES_SQL},
torches AS (SELECT id, n, seg, pip_pkgs, python, cuda, unnest(torch) AS torch FROM defs),
pythons AS (SELECT id, torch, pip_pkgs, cuda, unnest(python) AS python FROM torches),
cudas AS (SELECT id AS snapshot, torch, pip_pkgs, python, unnest(['cpu'] || cuda) AS cuda FROM pythons),
envs AS (
  SELECT snapshot, python, torch, cuda, pip_pkgs,
         CASE WHEN cuda = 'cpu' THEN 'cpu' ELSE 'cu' || replace(cuda, '.', '') END AS cu,
         'python' || python || '-torch' || torch || '-' ||
         CASE WHEN cuda = 'cpu' THEN 'cpu' ELSE 'cu' || replace(cuda, '.', '') END AS env
  FROM cudas JOIN rules
    ON version = split_part(torch, '.', 1) || '.' || split_part(torch, '.', 2)
  WHERE split_part(python, '.', 2)::INT BETWEEN pmin AND pmax AND list_contains(cudas, cuda))
"""

# orders as the environments that really exist
ORDER_ENV_SQL = f"""
order_envs AS (
  SELECT o_custkey::INT AS snapshot, o_orderstatus,
         'python3.' || (8 + o_orderkey % 6) || '-torch' ||
         {sql_list(TORCHES)}[(o_orderkey % {len(TORCHES)} + 1)::INT] || '-' ||
         CASE o_orderpriority WHEN '1-URGENT' THEN 'cu118' WHEN '2-HIGH' THEN 'cu124'
              ELSE 'cpu' END AS env
  FROM orders)
"""


def order_envs(spark: SparkSession, sf: str) -> DataFrame:
    torches = F.array(*[F.lit(t) for t in TORCHES])
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("int").alias("snapshot"),
        "o_orderstatus",
        F.concat(
            F.lit("python3."),
            8 + F.col("o_orderkey") % 6,
            F.lit("-torch"),
            F.element_at(torches, (F.col("o_orderkey") % len(TORCHES) + 1).cast("int")),
            F.lit("-"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "cu118")
            .when(F.col("o_orderpriority") == "2-HIGH", "cu124")
            .otherwise("cpu"),
        ).alias("env"),
    )


# ---- events as requests for pages ------------------------------------------------------


def page_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event requests the page of its user."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("size"))
    return table(spark, sf, "events").join(pages, F.col("user_id") == F.col("page_id"))


# ---- lineitem as cache objects ---------------------------------------------------------


def part_objects(spark: SparkSession, sf: str, old: bool) -> DataFrame:
    """Objects (one per part) as they were before the cut, or as they are after it."""
    side = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return (
        table(spark, sf, "lineitem")
        .where(side if old else ~side)
        .groupBy("l_partkey")
        .agg(
            F.max(F.col("l_quantity").cast("bigint")).alias("size"),
            F.max("l_returnflag").alias("_flag"),
            F.count("*").alias("requests"),
        )
        .select(
            "l_partkey",
            F.concat(F.lit("https://cdn.example.com/parts/"), "l_partkey").alias("url"),
            "size",
            F.md5("_flag").alias("etag"),
            "requests",
        )
    )


OBJECTS_SQL = f"""
objects AS (
  SELECT l_partkey, l_shipdate < TIMESTAMP '{CUT}' AS old,
         'https://cdn.example.com/parts/' || l_partkey AS url,
         max(l_quantity::BIGINT) AS size, md5(max(l_returnflag)) AS etag, count(*) AS requests
  FROM lineitem GROUP BY 1, 2, 3)
"""
