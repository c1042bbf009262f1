"""Compatibility matrices, expected pins, completeness and definition checks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.functions import (
    fixed,
    classify_spec,
    index_args,
    index_url,
    is_nightly,
    json_fingerprint,
    parse_env,
    resolve_alias,
)
from depot.operators.matrix import (
    active,
    artifact_plan,
    compatible,
    compatible_matrix,
    expand,
    expected_pins,
    latest_document,
    library_paths,
    long_form,
    lookup_strict,
    matrix_summary,
    matrix_venvs,
    missing,
    newest,
    pending,
    select_dims,
    single_environment,
    tool_matrix,
    torch_companions,
    torch_rules,
)
from depot.operators.durable import small_table
from depot.operators.quality import check, definition_rules, violations
from depot.sources.documents import cuda_catalog, cudnn_catalog, markers_of, parse_markers, parse_snapshots
from depot.workloads.tables import (
    CUDAS,
    DEFS_SQL,
    ENVS_SQL,
    NIGHTLY,
    ORDER_ENV_SQL,
    definition_texts,
    order_envs,
    sql_list,
    table,
)


def _defs(spark: SparkSession, sf: str) -> DataFrame:
    return parse_snapshots(definition_texts(spark, sf))


def compat_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped combinations of every supplier that rules made from the parts allow."""
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    minor = F.concat("p_size", F.lit("."), brand)
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_type", minor.alias("minor"), F.length("p_name").alias("len")
    )
    exact = F.concat("minor", F.lit("."), "len")
    matrix = (
        table(spark, sf, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_suppkey").alias("snapshot"),
            F.concat(F.lit("3."), F.col("l_linenumber")).alias("python"),
            exact.alias("torch"),
            F.when(F.col("l_returnflag") == "N", "cpu")
            .when(F.col("l_returnflag") == "A", "11.8")
            .otherwise("12.4")
            .alias("cuda"),
        )
        .distinct()
    )
    some = F.when(F.count("*") % 2 == 0, F.array(F.lit("cpu"), F.lit("12.4"))).otherwise(
        F.array(F.lit("cpu"), F.lit("11.8"))
    )
    rules = (
        parts.where("p_type = 'ECONOMY'")
        .groupBy(F.col("minor").alias("version"))
        .agg(
            F.concat(F.lit("3."), 1 + F.min("p_partkey") % 3).alias("python_min"),
            F.concat(F.lit("3."), 4 + F.max("p_partkey") % 4).alias("python_max"),
            some.alias("cudas"),
        )
        .unionByName(
            parts.where("p_type = 'SMALL'")
            .select(exact.alias("version"))
            .distinct()
            .select(
                "version",
                F.lit("3.2").alias("python_min"),
                F.lit("3.6").alias("python_max"),
                F.array(F.lit("cpu"), F.lit("11.8"), F.lit("12.4")).alias("cudas"),
            )
        )
    )
    return compatible(matrix, rules)


COMPAT_MATRIX = """
WITH p AS (SELECT p_partkey, p_type, p_size || '.' || regexp_extract(p_brand, '([0-9]+)$', 1) AS minor,
                  length(p_name) AS len FROM part),
m AS (SELECT DISTINCT l_suppkey AS snapshot, l_linenumber AS py, '3.' || l_linenumber AS python,
        minor, minor || '.' || len AS torch,
        CASE l_returnflag WHEN 'N' THEN 'cpu' WHEN 'A' THEN '11.8' ELSE '12.4' END AS cuda
      FROM lineitem JOIN p ON l_partkey = p_partkey),
mr AS (SELECT minor AS version, 1 + min(p_partkey) % 3 AS lo, 4 + max(p_partkey) % 4 AS hi,
         CASE WHEN count(*) % 2 = 0 THEN ['cpu', '12.4'] ELSE ['cpu', '11.8'] END AS cudas
       FROM p WHERE p_type = 'ECONOMY' GROUP BY minor),
xr AS (SELECT DISTINCT minor || '.' || len AS version FROM p WHERE p_type = 'SMALL')
SELECT snapshot, python, torch, cuda
FROM m LEFT JOIN xr ON xr.version = m.torch LEFT JOIN mr ON mr.version = m.minor
WHERE CASE WHEN xr.version IS NOT NULL THEN py BETWEEN 2 AND 6
           ELSE py BETWEEN lo AND hi AND list_contains(cudas, cuda) END
"""


def definition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed environments of one definition per customer, under the torch rules."""
    return compatible_matrix(_defs(spark, sf), torch_rules(spark)).select(
        "snapshot", "python", "torch", "cuda", "env"
    )


DEFINITION_MATRIX = f"WITH {ENVS_SQL} SELECT snapshot, python, torch, cuda, env FROM envs"


def definition_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the unfiltered matrix of active definitions by torch and accelerator."""
    rows = expand(active(_defs(spark, sf), 10, None, "id"))
    # the least text of a group cannot be kept in a hash aggregation, which would then sort the
    # whole matrix: equal rows are counted first, and the least is taken of what differs
    each = rows.groupBy("torch", "cuda", "python_full").agg(F.count("*").alias("n"))
    return each.groupBy("torch", "cuda").agg(
        F.sum("n").alias("n"), F.min("python_full").alias("first_python")
    )


DEFINITION_EXPAND = f"""WITH {DEFS_SQL},
t AS (SELECT id, unnest(torch) AS torch, cuda, python_full FROM defs WHERE id >= 10),
p AS (SELECT torch, cuda, unnest(python_full) AS python_full FROM t),
c AS (SELECT torch, python_full, unnest(['cpu'] || cuda) AS cuda FROM p)
SELECT torch, cuda, count(*) AS n, min(python_full) AS first_python FROM c GROUP BY torch, cuda"""


def definition_long(spark: SparkSession, sf: str) -> DataFrame:
    return long_form(_defs(spark, sf)).groupBy("dimension", "short", "full").agg(
        F.count("*").alias("snapshots")
    )


DEFINITION_LONG = f"""WITH {DEFS_SQL},
l AS (SELECT 'python' AS dimension, unnest(python) AS short, unnest(python_full) AS "full" FROM defs
  UNION ALL SELECT 'cuda', c, CASE WHEN c = '11.8' THEN '11.8.0_520' ELSE c || '.0_1' END
            FROM (SELECT unnest(cuda) AS c FROM defs)
  UNION ALL SELECT 'cudnn', unnest(cudnn), '9.8.0.87' FROM defs
  UNION ALL SELECT 'torch', t, t FROM (SELECT unnest(torch) AS t FROM defs)
  UNION ALL SELECT 'pip_pkgs', p, p FROM (SELECT unnest(pip_pkgs) AS p FROM defs))
SELECT dimension, short, "full", count(*) AS snapshots FROM l GROUP BY 1, 2, 3"""


def definition_cpu_only(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix of CPU nodes, with and without balanced definitions."""
    cpu = select_dims(_defs(spark, sf), no_cuda=True)
    rows = expand(cpu.where("balanced"))
    return rows.groupBy("python", "torch", "cuda").agg(F.count("*").alias("n"))


DEFINITION_CPU_ONLY = f"""WITH {DEFS_SQL},
t AS (SELECT unnest(torch) AS torch, python FROM defs), p AS (SELECT torch, unnest(python) AS python FROM t)
SELECT python, torch, 'cpu' AS cuda, count(*) AS n FROM p GROUP BY python, torch"""


def loader_caches(spark: SparkSession, sf: str) -> DataFrame:
    return library_paths(_defs(spark, sf)).groupBy("key", "cudnn_dir").agg(F.count("*").alias("n"))


LOADER_CACHES = f"""WITH {DEFS_SQL},
c AS (SELECT unnest(cuda) AS cuda, cudnn, python FROM defs),
n AS (SELECT cuda, unnest(cudnn) AS cudnn, python FROM c),
p AS (SELECT cuda, cudnn, unnest(python) AS python FROM n)
SELECT 'cuda' || cuda || '-cudnn' || cudnn || '-python' || python AS key,
       'cudnn' || cudnn || '-cuda' || split_part(cuda, '.', 1) AS cudnn_dir, count(*) AS n
FROM p GROUP BY 1, 2"""


def expected_pins_query(spark: SparkSession, sf: str) -> DataFrame:
    """Requirements of every allowed environment; nightlies have no companions."""
    envs = compatible_matrix(_defs(spark, sf), torch_rules(spark), carry=["pip_pkgs"])
    return expected_pins(envs, torch_companions(spark), on_missing="report")


_RUNTIMES = sql_list(fixed.CUDA_RUNTIME_PACKAGES)
EXPECTED_PINS = f"""
WITH {ENVS_SQL},
deps(torch, audio, vision) AS (VALUES {', '.join(str(r) for r in fixed.TORCH_COMPANIONS)}),
v AS (SELECT snapshot, env, envs.torch, cu, pip_pkgs, audio, vision,
             split_part(envs.torch, '.', 1)::INT * 1000 + split_part(envs.torch, '.', 2)::INT AS mm
      FROM envs LEFT JOIN deps ON envs.torch = deps.torch),
l AS (SELECT snapshot, env, CASE WHEN audio IS NULL THEN [NULL] ELSE
  ['torch==' || torch || '+' || cu, 'torchaudio==' || audio || '+' || cu,
   'torchvision==' || vision || '+' || cu]
  || CASE WHEN mm < 2006 THEN ['numpy<2.0.0'] ELSE []::VARCHAR[] END || pip_pkgs
  || CASE WHEN mm < 2002 AND cu <> 'cpu'
          THEN list_transform({_RUNTIMES}, lambda x: x || '-' || substr(cu, 1, 4)) ELSE []::VARCHAR[] END
  || CASE WHEN mm < 2002 AND starts_with(cu, 'cu12') THEN ['nvidia-nvjitlink-' || substr(cu, 1, 4)]
          ELSE []::VARCHAR[] END END AS pins FROM v),
u AS (SELECT snapshot, env, unnest(pins) AS requirement, generate_subscripts(pins, 1) - 1 AS i FROM l)
SELECT snapshot, env, CASE WHEN requirement IS NOT NULL THEN i::INT END AS position, requirement FROM u
"""


def missing_envs(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed environments that no order stands for."""
    envs = compatible_matrix(_defs(spark, sf), torch_rules(spark)).select("snapshot", "env")
    return missing(envs, order_envs(spark, sf), ["snapshot", "env"])


MISSING_ENVS = f"""WITH {ENVS_SQL}, {ORDER_ENV_SQL}
SELECT snapshot, env FROM envs e
WHERE NOT EXISTS (SELECT 1 FROM order_envs o WHERE o.snapshot = e.snapshot AND o.env = e.env)"""


def unexpected_envs(spark: SparkSession, sf: str) -> DataFrame:
    """The reverse: environments of orders that no definition allows."""
    envs = compatible_matrix(_defs(spark, sf), torch_rules(spark)).select("snapshot", "env")
    found = order_envs(spark, sf).select("snapshot", "env").distinct()
    return missing(found, envs, ["snapshot", "env"])


UNEXPECTED_ENVS = f"""WITH {ENVS_SQL}, {ORDER_ENV_SQL}
SELECT DISTINCT snapshot, env FROM order_envs o
WHERE NOT EXISTS (SELECT 1 FROM envs e WHERE o.snapshot = e.snapshot AND o.env = e.env)"""


def pending_envs_query(spark: SparkSession, sf: str) -> DataFrame:
    """Work left to do: markers are JSON texts, some without timestamp or broken."""
    orders = order_envs(spark, sf)
    text = (
        F.when(F.col("o_orderstatus") == "F", F.lit('{"timestamp": "2024-01-01T00:00:00Z"}'))
        .when(F.col("o_orderstatus") == "O", F.lit('{"attributes": {"kind": "env"}}'))
        .otherwise(F.lit('{"timestamp": '))
    )
    markers = parse_markers(orders.select("snapshot", "env", text.alias("text")))
    envs = compatible_matrix(_defs(spark, sf), torch_rules(spark)).select("snapshot", "env")
    return pending(envs, markers, ["snapshot", "env"])


PENDING_ENVS = f"""WITH {ENVS_SQL}, {ORDER_ENV_SQL}
SELECT snapshot, env FROM envs e WHERE NOT EXISTS (
  SELECT 1 FROM order_envs o WHERE o.snapshot = e.snapshot AND o.env = e.env AND o_orderstatus = 'F')"""


def matrix_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    """The head of the version matrix document of every definition, nested lists as text."""
    docs = matrix_summary(_defs(spark, sf), torch_rules(spark))

    def text(column: str) -> Column:
        return F.array_join(column, ",").alias(column)

    cudas = F.array_sort(
        F.transform(
            F.map_entries("torch_cudas"),
            lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "/")),
        )
    )
    return docs.select(
        "snapshot",
        text("cuda_versions"),
        text("cudnn_versions"),
        text("python_versions"),
        text("torch_versions"),
        F.array_join(cudas, ",").alias("torch_cudas"),
    )


MATRIX_SUMMARY = f"""
WITH {ENVS_SQL},
tc AS (SELECT id, torch, array_to_string(list_filter(cudas, lambda c: c <> 'cpu'), '/') AS t
       FROM (SELECT id, unnest(torch) AS torch FROM defs) JOIN rules
         ON version = split_part(torch, '.', 1) || '.' || split_part(torch, '.', 2)),
tt AS (SELECT id, string_agg(torch || ':' || t, ',' ORDER BY torch || ':' || t) AS torch_cudas
       FROM tc GROUP BY id)
SELECT d.id AS snapshot, array_to_string(cuda, ',') AS cuda_versions,
       array_to_string(cudnn, ',') AS cudnn_versions, array_to_string(python, ',') AS python_versions,
       array_to_string(torch, ',') AS torch_versions,
       coalesce(torch_cudas, '') AS torch_cudas
FROM defs d LEFT JOIN tt ON tt.id = d.id
"""


def matrix_venvs_query(spark: SparkSession, sf: str) -> DataFrame:
    """The environments of every document with their place in its order."""
    return matrix_venvs(_defs(spark, sf), torch_rules(spark))


MATRIX_VENVS = f"""
WITH {ENVS_SQL},
p AS (SELECT id, python, row_number() OVER (PARTITION BY id ORDER BY split_part(python, '.', 2)::INT DESC) - 1 AS i
      FROM (SELECT id, unnest(python) AS python FROM defs)),
t AS (SELECT id, torch, n, row_number() OVER (PARTITION BY id ORDER BY split_part(torch, '.', 2)::INT DESC,
             split_part(torch, '.', 3)::INT DESC, split_part(torch, '.', 4) DESC) - 1 AS i
      FROM (SELECT id, unnest(torch) AS torch, len(torch) AS n FROM defs)),
c AS (SELECT id, cuda, n, row_number() OVER (PARTITION BY id ORDER BY cuda = 'cpu' DESC,
             CASE WHEN cuda <> 'cpu' THEN cuda::DOUBLE END DESC) - 1 AS i
      FROM (SELECT id, unnest(['cpu'] || cuda) AS cuda, len(cuda) + 1 AS n FROM defs))
SELECT snapshot, ((p.i * t.n + t.i) * c.n + c.i)::BIGINT AS position, e.python, e.torch, e.cuda
FROM envs e JOIN p ON p.id = snapshot AND p.python = e.python
     JOIN t ON t.id = snapshot AND t.torch = e.torch JOIN c ON c.id = snapshot AND c.cuda = e.cuda
"""


def _faulty_defs(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of two registries; some full versions do not go on from their short ones."""

    def spoilt(column: str, every: int) -> Column:
        changed = F.transform_values(column, lambda k, v: F.concat(F.lit("0."), v))
        return F.when(F.col("id") % every == 0, changed).otherwise(F.col(column))

    kinds = {"cuda": 5, "cudnn": 6, "python": 7}
    defs = _defs(spark, sf).withColumns({c: spoilt(c, n) for c, n in kinds.items()})
    return defs.withColumn("environment", F.when(F.col("id") % 10 == 3, "test").otherwise("prod"))


_FAULTY_SQL = f"""{DEFS_SQL},
faulty AS (
  SELECT id, CASE WHEN id % 10 = 3 THEN 'test' ELSE 'prod' END AS environment,
         [id % 5 = 0 AND len(cuda) > 0, id % 6 = 0 AND len(cudnn) > 0, id % 7 = 0,
          seg = 'BUILDING', (len(cuda) = 0) <> (len(cudnn) = 0)] AS broken FROM defs),
each AS (
  SELECT id, environment, unnest(broken) AS broken, unnest(['cuda_full_extends_short',
    'cudnn_full_extends_short', 'python_full_extends_short', 'packages_pinned',
    'cuda_and_cudnn_together']) AS rule FROM faulty)"""


def definition_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rules by registry, every one of them broken somewhere."""
    return check(_faulty_defs(spark, sf), definition_rules(), ["environment"])


DEFINITION_CHECKS = f"""WITH {_FAULTY_SQL}
SELECT environment, rule, count(*) AS checked, count(*) FILTER (broken) AS violations
FROM each GROUP BY environment, rule"""


def definition_violations(spark: SparkSession, sf: str) -> DataFrame:
    return violations(_faulty_defs(spark, sf), definition_rules()).select("environment", "id", "rule")


DEFINITION_VIOLATIONS = f"""WITH {_FAULTY_SQL} SELECT environment, id, rule FROM each WHERE broken"""


def definition_single(spark: SparkSession, sf: str) -> DataFrame:
    """One environment of the newest definition: its first Python and Torch, on CPU and on its first CUDA."""
    defs = _defs(spark, sf)
    row = newest(defs, "id").select(
        F.map_keys("python")[0].alias("python"), F.col("torch")[0].alias("torch"),
        F.map_keys("cuda").alias("cuda"), F.map_keys("cudnn").alias("cudnn"),
    ).first()
    found = single_environment(defs, torch_rules(spark), row.python, row.torch)
    for cuda in row.cuda[:1]:
        cudnn = row.cudnn[0] if row.cudnn else None
        one = single_environment(defs, torch_rules(spark), row.python, row.torch, cuda, cudnn)
        found = found.unionByName(one)
    return found.select("snapshot", "python", "torch", "cuda", "env")


DEFINITION_SINGLE = f"""WITH {ENVS_SQL}
SELECT e.snapshot, e.python, e.torch, e.cuda, e.env
FROM envs e JOIN (SELECT * FROM defs WHERE id = (SELECT max(id) FROM defs)) d ON e.snapshot = d.id
WHERE e.python = d.python[1] AND e.torch = d.torch[1] AND (e.cuda = 'cpu' OR (e.cuda = d.cuda[1] AND len(d.cudnn) > 0))"""


def latest_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The document of the newest definition, with links to the newest file of two makers' parts."""
    maker = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    parts = table(spark, sf, "part").where(maker.isin(11, 22)).select(
        F.concat(F.lit("tool"), maker).alias("name"), F.col("p_partkey").alias("n")
    )
    links = parts.groupBy("name").agg(F.max("n").alias("n")).select(
        "name", F.concat(F.lit("1."), "n").alias("version"), F.concat(F.lit("https://h/"), "name", F.lit("/"), "n").alias("url")
    )
    doc = latest_document(_defs(spark, sf), torch_rules(spark), links)
    pair = F.transform(
        F.map_entries("releases"), lambda e: F.concat_ws(" ", e["key"], e["value"]["version"], e["value"]["url"])
    )
    return doc.select(
        "snapshot",
        F.array_join("python_versions", ",").alias("python_versions"),
        F.array_join("torch_versions", ",").alias("torch_versions"),
        F.array_join(F.array_sort(pair), ";").alias("releases"),
    )


LATEST_MATRIX = f"""WITH {DEFS_SQL},
links AS (SELECT 'tool' || m AS name, max(p_partkey) AS n
          FROM (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS m FROM part)
          WHERE m IN (11, 22) GROUP BY 1)
SELECT id AS snapshot, array_to_string(python, ',') AS python_versions,
       array_to_string(torch, ',') AS torch_versions,
       coalesce((SELECT string_agg(name || ' 1.' || n || ' https://h/' || name || '/' || n, ';' ORDER BY name)
                 FROM links), '') AS releases
FROM defs WHERE id = (SELECT max(id) FROM defs)"""


def tool_matrix_query(spark: SparkSession, sf: str) -> DataFrame:
    """Tool versions of every definition with its Pythons; one kind does not run on 3.8."""
    defs = _defs(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_nationkey").alias("n")), "id"
    )
    own = F.concat(F.lit("0.14."), F.col("n") % 5)
    tools = defs.select(
        F.col("id").alias("snapshot"),
        F.explode(F.array(F.lit("slim"), own, F.concat(F.lit("slim@1."), F.col("n") % 3), own)).alias("version"),
        F.when(F.col("n") % 2 == 0, own).otherwise(F.lit("slim")).alias("default_version"),
    )
    pythons = defs.select(F.col("id").alias("snapshot"), F.explode(F.map_values("python")).alias("python"))
    excluded = small_table(spark, [("slim", "3.8")], "kind, python")
    return tool_matrix(tools, pythons, excluded, ["snapshot"])


TOOL_MATRIX = f"""WITH {DEFS_SQL},
t AS (SELECT id AS snapshot, n, unnest(['slim', '0.14.' || n % 5, 'slim@1.' || n % 3]) AS version FROM defs),
p AS (SELECT id AS snapshot, unnest(python) AS python, unnest(python_full) AS python_full FROM defs)
SELECT snapshot, version, python, python_full,
       version = CASE WHEN n % 2 = 0 THEN '0.14.' || n % 5 ELSE 'slim' END AS is_default
FROM t JOIN p USING (snapshot) WHERE NOT (starts_with(version, 'slim') AND python = '3.8')"""


def marker_directories(spark: SparkSession, sf: str) -> DataFrame:
    """Directories of customers from a table of files; those with a whole hidden marker are done."""
    orders = table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 4 == 0, ".done").otherwise(F.concat(F.lit("f"), "o_orderkey"))
    text = F.concat(
        F.lit('{"timestamp": "'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.col("o_orderstatus") == "F", '"}').otherwise('"'),
    )
    path = F.concat(F.lit("/m/"), "o_custkey", F.lit("/"), name)
    found = markers_of(orders.select(path.alias("path"), text.alias("text")), ".done")
    return found.select("dir", "done", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


MARKER_DIRECTORIES = """
WITH f AS (SELECT '/m/' || o_custkey AS dir, o_orderkey % 4 = 0 AS marker, o_orderdate AS t,
                  '{"timestamp": "' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
                    || CASE WHEN o_orderstatus = 'F' THEN '"}' ELSE '"' END AS text, o_orderstatus = 'F' AS sound
           FROM orders),
m AS (SELECT dir, arg_max(sound, text) FILTER (marker) AS sound, arg_max(t, text) FILTER (marker) AS t FROM f GROUP BY dir)
SELECT dir, coalesce(sound, FALSE) AS done, CASE WHEN sound THEN t::TIMESTAMP END AS timestamp FROM m"""


def env_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Environment keys taken apart again, with index options."""
    rows = compatible_matrix(_defs(spark, sf), torch_rules(spark)).withColumn("k", parse_env("env"))
    return rows.groupBy(
        F.col("k.python").alias("python"),
        F.col("k.torch").alias("torch"),
        F.col("k.suffix").alias("suffix"),
        index_url("cuda", is_nightly("torch")).alias("index_url"),
        F.array_join(index_args("torch", "cuda", True), " ").alias("args"),
    ).agg(F.count("*").alias("n"))


ENV_INDEXES = f"""WITH {ENVS_SQL},
u AS (SELECT python, torch, cu AS suffix, '{fixed.TORCH_INDEX}' ||
        CASE WHEN contains(torch, '.dev') THEN '/nightly/' ELSE '/' END || cu AS index_url FROM envs)
SELECT python, torch, suffix, index_url, '--extra-index-url ' || index_url ||
  ' --index-url {fixed.DEFAULT_INDEX} --index-strategy unsafe-first-match' AS args, count(*) AS n
FROM u GROUP BY 1, 2, 3, 4, 5"""


def config_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of the tool configuration of every definition."""
    rows = _defs(spark, sf)
    versions = F.array_sort(
        F.array_distinct(F.transform("torch", lambda t: resolve_alias(t, NIGHTLY, F.lit("9.9"))))
    )
    return rows.select(
        "id",
        json_fingerprint(
            [
                ("versions", versions, True),
                ("default_version", F.get("torch", F.lit(0)), False),
                ("python_versions", F.array_sort(F.map_values("python")), True),
            ]
        ).alias("fingerprint"),
    )


CONFIG_FINGERPRINTS = f"""WITH {DEFS_SQL},
j AS (SELECT id, torch[1] AS first, list_sort(list_distinct(list_transform(torch,
        lambda t: CASE WHEN t = '{NIGHTLY}' THEN '{NIGHTLY}==9.9' ELSE t END))) AS v,
      list_sort(python_full) AS p FROM defs)
SELECT id, sha256('{{"versions": ["' || array_to_string(v, '", "') || '"], "default_version": "' || first ||
  '", "python_versions": ["' || array_to_string(p, '", "') || '"]}}') AS fingerprint FROM j"""


def artifact_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Artifact URLs of all parts read as a toolkit catalog; some names are bad."""
    part = table(spark, sf, "part")
    name = F.concat(
        F.when(F.col("p_type") == "SMALL", F.lit("kit_")).otherwise(F.lit("cuda_")),
        "p_size", F.lit("."), "p_partkey", F.lit("_"), F.col("p_size") + 400, F.lit(".86.10_linux.run"),
    )
    urls = part.select("p_partkey", F.concat(F.lit("https://dl.example.com/a/"), name, F.lit("?x=/1")).alias("url"))
    rows = cuda_catalog(urls, mode="report")
    return rows.select(
        "p_partkey",
        "valid",
        "key",
        F.col("version.minor").alias("minor"),
        F.col("driver_version.major").alias("driver_major"),
    )


ARTIFACT_CATALOG = """
SELECT p_partkey, p_type <> 'SMALL' AS valid,
       CASE WHEN p_type <> 'SMALL' THEN p_size || '.' || p_partkey || '_' || (p_size + 400) || '.86.10' END AS key,
       CASE WHEN p_type <> 'SMALL' THEN p_partkey END AS minor,
       CASE WHEN p_type <> 'SMALL' THEN p_size + 400 END::BIGINT AS driver_major
FROM part"""


def artifact_plan_query(spark: SparkSession, sf: str) -> DataFrame:
    """Archives every definition needs, against catalogs that lack CUDA 12.8 and CuDNN for CUDA 11."""
    part = table(spark, sf, "part").where("p_partkey % 5 < 4")
    version = F.element_at(F.array(*[F.lit(c) for c in CUDAS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    base = F.concat(F.lit("https://dl.example.com/"), F.col("p_size"), F.lit("/"))
    toolkit = F.when(F.col("p_type") == "SMALL", "cuda_11.8.0_520_linux.run").otherwise(
        F.concat(F.lit("cuda_"), version, F.lit(".0_1_linux.run"))
    )
    library = F.lit("cudnn-linux-x86_64-9.8.0.87_cuda12-archive.tar.xz")
    cuda = cuda_catalog(part.select(F.concat(base, toolkit).alias("url")))
    cudnn = cudnn_catalog(part.where("p_size < 3").select(F.concat(base, library).alias("url")))
    return artifact_plan(_defs(spark, sf), cuda, cudnn, on_missing="report")


ARTIFACT_PLAN = f"""
WITH {DEFS_SQL},
parts AS (SELECT *, 'https://dl.example.com/' || p_size || '/' AS base FROM part WHERE p_partkey % 5 < 4),
listed AS (
  SELECT 'cuda' AS kind, CASE WHEN p_type = 'SMALL' THEN '11.8.0_520'
           ELSE {sql_list(CUDAS)}[(p_partkey % 5 + 1)::INT] || '.0_1' END AS key,
         base || 'cuda_' || CASE WHEN p_type = 'SMALL' THEN '11.8.0_520'
           ELSE {sql_list(CUDAS)}[(p_partkey % 5 + 1)::INT] || '.0_1' END || '_linux.run' AS url FROM parts
  UNION ALL SELECT 'cudnn', '9.8.0.87-cuda12', base || 'cudnn-linux-x86_64-9.8.0.87_cuda12-archive.tar.xz'
  FROM parts WHERE p_size < 3),
catalog AS (SELECT kind, key, min(url) AS url FROM listed GROUP BY 1, 2),
c AS (SELECT id, cudnn, unnest(cuda) AS cuda FROM defs),
needed AS (
  SELECT DISTINCT id AS snapshot, 'cuda' AS kind, CASE WHEN cuda = '11.8' THEN '11.8.0_520' ELSE cuda || '.0_1' END AS key
  FROM c
  UNION SELECT id, 'cudnn', '9.8.0.87-cuda' || split_part(cuda, '.', 1) FROM c WHERE len(cudnn) > 0)
SELECT snapshot, kind, key, url, url IS NOT NULL AS found FROM needed LEFT JOIN catalog USING (kind, key)"""


def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every shipped line against a catalog without large parts: hits and misses by flag."""
    catalog = table(spark, sf, "part").where("p_size < 40").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand"
    )
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    rows = lookup_strict(lines, catalog, ["l_partkey"], on_missing="report")
    return rows.groupBy("l_returnflag", "found").agg(
        F.count("*").alias("n"), F.count("p_brand").alias("with_brand")
    )


CATALOG_LOOKUP = """
SELECT l_returnflag, p_partkey IS NOT NULL AS found, count(*) AS n, count(p_brand) AS with_brand
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey GROUP BY 1, 2"""


def source_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Tool specs in all their forms, one per part."""
    part = table(spark, sf, "part")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("https://h/tool-"), "p_partkey"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("file:///lite-tool-"), "p_partkey"))
        .when(F.col("p_size") < 10, F.lit("lite"))
        .when(F.col("p_size") < 20, F.concat(F.lit("lite== 1."), "p_size"))
        .when(F.col("p_size") < 25, F.lit("lite>1"))
        .otherwise(F.concat(F.lit("0."), "p_size"))
    )
    rows = part.select("p_partkey", classify_spec(text, "tool", "lite").alias("s"))
    return rows.select("p_partkey", "s.kind", "s.name", "s.spec")


SOURCE_SPECS = """
WITH t AS (SELECT p_partkey, p_size, CASE WHEN p_type = 'ECONOMY' THEN 'https://h/tool-' || p_partkey
    WHEN p_type = 'SMALL' THEN 'file:///lite-tool-' || p_partkey WHEN p_size < 10 THEN 'lite'
    WHEN p_size < 20 THEN 'lite== 1.' || p_size WHEN p_size < 25 THEN 'lite>1' ELSE '0.' || p_size END AS s
  FROM part),
k AS (SELECT *, CASE WHEN starts_with(s, 'https://') OR starts_with(s, 'file://') THEN 'url'
    WHEN s = 'lite' THEN 'alias' WHEN starts_with(s, 'lite') AND contains(s, '==') THEN 'alias_pinned'
    WHEN starts_with(s, 'lite') THEN 'unsupported' ELSE 'plain' END AS kind,
    CASE WHEN contains(s, 'lite') THEN 'lite' ELSE 'tool' END AS pkg FROM t)
SELECT p_partkey, kind,
  CASE kind WHEN 'url' THEN pkg || substr(sha256(s), 1, 8) WHEN 'alias' THEN 'litelatest'
       WHEN 'alias_pinned' THEN 'lite1.' || p_size WHEN 'plain' THEN 'tool' || s END AS name,
  CASE kind WHEN 'url' THEN pkg || '@' || s WHEN 'plain' THEN 'tool==' || s END AS spec
FROM k"""

QUERIES = {
    "definition_single": (definition_single, DEFINITION_SINGLE),
    "latest_matrix": (latest_matrix, LATEST_MATRIX),
    "tool_matrix": (tool_matrix_query, TOOL_MATRIX),
    "marker_directories": (marker_directories, MARKER_DIRECTORIES),
    "compat_matrix": (compat_matrix, COMPAT_MATRIX),
    "definition_matrix": (definition_matrix, DEFINITION_MATRIX),
    "definition_expand": (definition_expand, DEFINITION_EXPAND),
    "definition_long": (definition_long, DEFINITION_LONG),
    "definition_cpu_only": (definition_cpu_only, DEFINITION_CPU_ONLY),
    "loader_caches": (loader_caches, LOADER_CACHES),
    "expected_pins": (expected_pins_query, EXPECTED_PINS),
    "missing_envs": (missing_envs, MISSING_ENVS),
    "unexpected_envs": (unexpected_envs, UNEXPECTED_ENVS),
    "pending_envs": (pending_envs_query, PENDING_ENVS),
    "matrix_summary": (matrix_summary_query, MATRIX_SUMMARY),
    "matrix_venvs": (matrix_venvs_query, MATRIX_VENVS),
    "definition_checks": (definition_checks, DEFINITION_CHECKS),
    "definition_violations": (definition_violations, DEFINITION_VIOLATIONS),
    "env_indexes": (env_indexes, ENV_INDEXES),
    "config_fingerprints": (config_fingerprints, CONFIG_FINGERPRINTS),
    "artifact_catalog": (artifact_catalog, ARTIFACT_CATALOG),
    "artifact_plan": (artifact_plan_query, ARTIFACT_PLAN),
    "catalog_lookup": (catalog_lookup, CATALOG_LOOKUP),
    "source_specs": (source_specs, SOURCE_SPECS),
}
