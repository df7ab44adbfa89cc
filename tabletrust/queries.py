"""Registered queries of the library's own operators, each with its DuckDB SQL where SQL can express it.

The given tables hold no flaws, so checks and treatments run on views of them that plant flaws; the views are one SQL
text that both engines read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.functions import text
from tabletrust.functions.text import to_long
from tabletrust.operators import discover, enrich, lines, plans, profile, rubric, status, treat
from tabletrust.plans import charts, logs, shapes, stats
from tabletrust.sources import files, folders, publish, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Flaws planted in orders.
DIRTY = """SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS customer_id,
 CASE WHEN o_orderkey % 29 = 0 THEN 'TBD' WHEN o_orderkey % 31 = 0 THEN '9999' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 7 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 = 0 THEN '$' ELSE '' END || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS amount,
 CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '1' ELSE '0' END AS is_active,
 CASE WHEN o_orderkey % 17 = 0 THEN '1234' ELSE '02134' END AS zip,
 CASE WHEN o_orderkey % 5 = 0 THEN '1.234,56' ELSE '1,234.56' END AS local_price,
 CASE WHEN o_orderkey % 19 = 0 THEN '19.989999999999998' ELSE '19.99' END AS noise,
 CASE WHEN o_orderkey % 23 = 0 THEN '=SUM(A1:A2)' WHEN o_orderkey % 37 = 0 THEN '#DIV/0!' ELSE 'ok' END AS formula,
 CASE o_orderkey % 3 WHEN 0 THEN 'red,blue' WHEN 1 THEN 'red;blue' ELSE 'red|blue' END AS tags,
 CASE WHEN o_orderkey % 2 = 0 THEN '2021-03-0' || CAST(1 + o_orderkey % 9 AS STRING) ELSE '03/2' || CAST(o_orderkey % 9 AS STRING) || '/2021' END AS due_date,
 CASE WHEN o_orderkey % 41 = 0 THEN '2021-03-05 10:30' ELSE '2021-03-05' END AS ship_date,
 CASE WHEN o_orderkey % 43 = 0 THEN '-5' ELSE CAST(o_orderkey % 50 AS STRING) END AS quantity,
 CASE WHEN o_orderkey % 47 = 0 THEN '1850-01-01' WHEN o_orderkey % 53 = 0 THEN '2090-01-01' ELSE '2020-05-05' END AS start_date,
 CASE WHEN o_orderkey % 10 = 0 THEN 'n' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey % 100 AS STRING) END AS score,
 CASE WHEN o_orderkey % 59 = 0 THEN CAST(o_custkey + 1000000000 AS STRING) ELSE CAST(o_orderkey AS STRING) END AS parent_id,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 97 END AS points,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'gold' WHEN o_orderkey % 3 = 0 THEN 'silver' ELSE 'gold' END AS tier
 FROM orders"""
#: Job postings made of customers.
JOBS = """SELECT c_custkey AS job_id,
 CASE c_custkey % 4 WHEN 0 THEN '$10 to $25 million' WHEN 1 THEN '50K-75K' WHEN 2 THEN '100+' ELSE 'Less than $1 million' END AS salary,
 CASE c_custkey % 3 WHEN 0 THEN '51 to 200 employees' WHEN 1 THEN '10000+ employees' ELSE '1 to 50 employees' END AS size,
 CASE c_custkey % 5 WHEN 0 THEN 'Senior Data Scientist' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Junior Analyst' WHEN 3 THEN 'VP of Sales' ELSE 'Baker' END AS title,
 CASE c_custkey % 3 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Boston, MA' ELSE 'Remote' END AS location,
 CASE c_custkey % 2 WHEN 0 THEN 'Dallas, TX' ELSE 'Salem, MA' END AS headquarters,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '-1' ELSE CAST(1950 + c_custkey % 60 AS STRING) END AS founded,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Python and Spark on AWS' ELSE 'Excel, Big Data' END AS description,
 'group ' || CAST(c_custkey % 57 AS STRING) AS industry, c_mktsegment AS segment, c_nationkey AS nation FROM customer"""
#: Runs of the analyst made of conversations.
RUNS = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'sql_analyst' WHEN turn % 3 = 0 THEN 'other' ELSE 'visualize' END AS route,
 CASE WHEN conv_id % 3 = 0 THEN 'Heat causes growth. 12 underlying rows were included in this ranking. A one-way ANOVA on x' WHEN conv_id % 3 = 1 THEN 'Demand drives growth due to joy. This result is grouped by month' ELSE 'Plain' END AS answer,
 'WITH base AS (SELECT o_custkey, avg(o_totalprice) AS mean_price FROM orders WHERE o_orderstatus = ''F'' AND o_comment IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) >= ' || CAST(5 + conv_id % 3 AS STRING) || ') SELECT * FROM base ORDER BY mean_price DESC LIMIT 10' AS sql,
 'question ' || CAST(conv_id % 20 AS STRING) AS question FROM conversations"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table = sql.rsplit("FROM ", 1)[1].strip()
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}") if sql.endswith(f"FROM {table}") and sql.count(f"FROM {table}") == 1 else sql.rsplit("FROM ", 1)[0] + "FROM {source}", source=read(spark, sf_dir, table))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def with_dirty(body: str) -> str:
    return f"WITH dirty AS ({DIRTY}) {body}"


def with_jobs(body: str) -> str:
    return f"WITH jobs AS ({JOBS}) {body}"


# --- rubric checks: one planted column each -------------------------------------------------------------------

def _check(name: str, column: str, affected: str, total: str = "count({c})", table: str = "dirty") -> None:
    a, t = affected.format(c=column), total.format(c=column)
    sql = with_dirty(f"SELECT '{column}' AS \"column\", CAST({a} AS BIGINT) AS affected, CAST({t} AS BIGINT) AS total, round(({a}) / ({t}), 6) AS fraction FROM {table}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rubric.issues(dirty(spark, sf_dir).select(column), "orders")
        return found.where(F.col("category") == name).select("column", "affected", "total", "fraction")

    register(name, sql)(run)


_check("missing", "customer_id", "count(*) - count({c})", "count(*)")
_check("numeric_as_text", "score", "count({c}) - count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]+$'))")
_check("mixed_date_formats", "due_date", "count({c})")
_check("whitespace_noise", "priority", "count(*) FILTER (WHERE {c} <> trim({c}))")
_check("negative_values", "quantity", "count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) < 0)")
_check("out_of_range_dates", "start_date", "count(*) FILTER (WHERE {c} < '1900' OR {c} > '2028')")
_check("placeholder_tokens", "status", "count(*) FILTER (WHERE lower({c}) IN ('tbd', '9999'))")
_check("boolean_families", "is_active", "count({c})")
_check("lost_leading_zeros", "zip", "count(*) FILTER (WHERE length({c}) = 4)")
_check("currency_units", "amount", "count(*) FILTER (WHERE {c} LIKE '$%')")
_check("locale_mix", "local_price", "count({c})")
_check("float_noise", "noise", "count(*) FILTER (WHERE regexp_matches({c}, '\\.\\d*(0{{5,}}|9{{5,}})\\d?$'))")
_check("spreadsheet_formula", "formula", "count(*) FILTER (WHERE {c} LIKE '=SUM(%')")
_check("spreadsheet_error", "formula", "count(*) FILTER (WHERE {c} = '#DIV/0!')")
_check("delimiter_mix", "tags", "count({c})")
_check("granularity_mix", "ship_date", "count(*) FILTER (WHERE {c} LIKE '%:%')")
_check("duplicate_keys", "customer_id", "count({c}) - count(DISTINCT {c})")
_check("categorical_variants", "priority", "count(DISTINCT {c}) - count(DISTINCT lower(trim({c})))", "count(DISTINCT {c})")


@register("prose_noise", "SELECT 'text' AS \"column\", count(*) FILTER (WHERE text LIKE '%' || chr(10) || '%') AS affected, count(text) AS total, round(count(*) FILTER (WHERE text LIKE '%' || chr(10) || '%') / count(text), 6) AS fraction FROM documents")
def _(spark, sf_dir):
    return rubric.issues(read(spark, sf_dir, "documents").select("text")).where("category = 'prose_noise'").select("column", "affected", "total", "fraction")


@register("duplicate_rows", "SELECT sum(c - 1)::BIGINT AS affected, sum(c)::BIGINT AS total FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type)")
def _(spark, sf_dir):
    return rubric.duplicate_rows(read(spark, sf_dir, "events").select("user_id", "event_type")).select("affected", "total")


@register("dangling_refs", with_dirty("SELECT 'parent_id' AS \"column\", count(*) FILTER (WHERE parent_id NOT IN (SELECT CAST(id AS VARCHAR) FROM dirty)) AS affected, count(parent_id) AS total FROM dirty"))
def _(spark, sf_dir):
    return rubric.dangling_refs(dirty(spark, sf_dir).select("id", "parent_id")).select("column", "affected", "total")


_PLACEHOLDER = "count(*) FILTER (WHERE lower(CAST({c} AS VARCHAR)) IN ('9999', '999', '-1', 'tbd', 'unknown', 'missing', 'xxx', 'n/a', 'na', 'null', 'none'))"
#: Every issue of the planted table: category, column, cells affected.
_ALL = [
    ("boolean_families", "is_active", "count({c})"), ("categorical_variants", "priority", "count(DISTINCT {c}) - count(DISTINCT lower(trim({c})))"), ("currency_units", "amount", "count(*) FILTER (WHERE {c} LIKE '$%')"),
    ("dangling_refs", "parent_id", "count(*) FILTER (WHERE {c} NOT IN (SELECT CAST(id AS VARCHAR) FROM dirty))"), ("delimiter_mix", "tags", "count({c})"),
    *(("duplicate_keys", c, "count({c}) - count(DISTINCT {c})") for c in ("id", "customer_id", "parent_id")), ("float_noise", "noise", "count(*) FILTER (WHERE length({c}) > 10)"), ("granularity_mix", "ship_date", "count(*) FILTER (WHERE {c} LIKE '%:%')"),
    ("locale_mix", "local_price", "count({c})"), ("lost_leading_zeros", "zip", "count(*) FILTER (WHERE length({c}) = 4)"), *(("missing", c, "CASE WHEN count({c}) < 0.95 * count(*) THEN count(*) - count({c}) ELSE 0 END") for c in ("customer_id", "points", "tier", "status")),
    ("mixed_date_formats", "due_date", "count({c})"), ("negative_values", "quantity", "count(*) FILTER (WHERE {c} LIKE '-%')"), ("numeric_as_text", "amount", "count(*) FILTER (WHERE {c} LIKE '$%')"), ("numeric_as_text", "score", "count(*) FILTER (WHERE {c} LIKE 'n%')"),
    ("out_of_range_dates", "start_date", "count(*) FILTER (WHERE {c} < '1900' OR {c} > '2028')"), *(("placeholder_tokens", c, _PLACEHOLDER) for c in ("id", "customer_id", "status", "priority", "amount", "quantity", "score", "parent_id", "points", "tier")),
    ("spreadsheet_error", "formula", "count(*) FILTER (WHERE {c} = '#DIV/0!')"), ("spreadsheet_formula", "formula", "count(*) FILTER (WHERE {c} LIKE '=SUM(%')"), ("whitespace_noise", "priority", "count(*) FILTER (WHERE {c} <> trim({c}))"),
]
_FAILS = "('dangling_refs', 'duplicate_keys', 'locale_mix', 'lost_leading_zeros', 'mixed_date_formats', 'negative_values', 'numeric_as_text', 'out_of_range_dates', 'placeholder_tokens', 'spreadsheet_error', 'spreadsheet_formula')"
_EVERY = "SELECT category, \"column\", affected, CASE WHEN category IN " + _FAILS + " THEN 'fail' ELSE 'warn' END AS severity FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS category, '{c}' AS \"column\", CAST({e.format(c=c)} AS BIGINT) AS affected FROM dirty" for k, c, e in _ALL) + ") WHERE affected > 0"


@register("rubric_all", with_dirty(_EVERY))
def _(spark, sf_dir):
    return rubric.with_severity(rubric.issues(dirty(spark, sf_dir), "orders")).select("category", "column", "affected", "severity")


@register("control_characters", "SELECT 'name' AS \"column\", count(*) FILTER (WHERE o_orderkey % 7 = 0) AS affected, count(*) AS total FROM orders")
def _(spark, sf_dir):
    named = read(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN concat('a', char(7), o_orderkey) ELSE 'a' END AS name")
    return rubric.issues(named).where("category = 'control_characters'").select("column", "affected", "total")


@register("row_index_columns", "SELECT 'row_id' AS \"column\" WHERE (SELECT count(DISTINCT event_id) >= 0.9 * count(*) FROM events)")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("index"), "event_id")
    return spark.createDataFrame([(c,) for c in rubric.row_index_columns(events, "event_id")], "column string")


@register("value_type", with_dirty("SELECT * FROM (SELECT 'amount' AS \"column\", CASE WHEN avg(CASE WHEN regexp_matches(amount, '^[0-9]+$') THEN 1 ELSE 0 END) >= 0.8 THEN 'numeric' ELSE 'text' END AS value_type FROM dirty UNION ALL SELECT 'status', 'text' UNION ALL SELECT 'score', CASE WHEN avg(CASE WHEN regexp_matches(score, '^[0-9]+$') THEN 1 ELSE 0 END) >= 0.8 THEN 'numeric' ELSE 'text' END FROM dirty)"))
def _(spark, sf_dir):
    return rubric.value_types(to_long(dirty(spark, sf_dir), "orders", ["amount", "status", "score"])).select("column", "value_type")


@register("sequential_id", "SELECT 'o_orderkey' AS \"column\", count(*) AS n, TRUE AS sequential FROM orders UNION ALL SELECT 'o_custkey', count(*), FALSE FROM orders")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("line", F.col("o_orderkey"))
    return rubric.sequential_ids(orders, ["o_orderkey", "o_custkey"], "line").select("column", "n", "sequential")


@register("failing_columns", with_dirty(f"SELECT DISTINCT \"column\" FROM ({_EVERY}) WHERE severity = 'fail' AND \"column\" IN ('score', 'quantity', 'tags')"))
def _(spark, sf_dir):
    return rubric.failing_columns(rubric.issues(dirty(spark, sf_dir).select("score", "quantity", "tags"), "orders")).select("column")


# --- discovery -------------------------------------------------------------------------------------------------

@register("verify_pattern", with_jobs("SELECT 'location' AS \"column\", count(*) FILTER (WHERE regexp_matches(location, ', [A-Z]{2}$')) AS matched, count(location) AS n, round(count(*) FILTER (WHERE regexp_matches(location, ', [A-Z]{2}$')) / count(location), 6) AS fraction, count(*) FILTER (WHERE regexp_matches(location, ', [A-Z]{2}$')) / count(location) >= 0.6 AS verified FROM jobs"))
def _(spark, sf_dir):
    tested = spark.createDataFrame([("location", ", [A-Z]{2}$", 0.6)], "column string, pattern string, threshold double")
    return discover.verify_patterns(to_long(view(spark, sf_dir, JOBS), "jobs", ["location"]), tested).select("column", "matched", "n", "fraction", "verified")


@register("duplicate_column", "SELECT 'a' AS a, 'b' AS b, count(*) AS n, round(avg(CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END), 6) AS fraction, avg(CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END) >= 0.95 AS duplicate FROM orders WHERE o_orderkey % 9 <> 0")
def _(spark, sf_dir):
    two = read(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS a", "CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS b")
    return discover.verify_pairs(two, [("a", "b")])


_PAIRED = {c: c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")} | {"l_quantity": "CAST(l_quantity AS BIGINT)", "order_part_key": "l_orderkey + l_partkey"}
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({e} AS VARCHAR) AS x FROM lineitem" for c, e in _PAIRED.items())


@register("column_pairs", f"""WITH v AS (SELECT DISTINCT c, x FROM ({_CELLS}) WHERE x IS NOT NULL), n AS (SELECT c, count(*) AS n FROM v GROUP BY c),
 w AS (SELECT c, n, list_distinct(regexp_extract_all(c, '[a-z]+')) AS words FROM n), m AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2)
 SELECT p.c AS a, q.c AS b, round(coalesce(k, 0) / least(p.n, q.n), 6) AS "values", round(len(list_intersect(p.words, q.words)) / len(list_distinct(list_concat(p.words, q.words))) + coalesce(k, 0) / least(p.n, q.n), 6) AS score
 FROM w p JOIN w q ON p.c < q.c LEFT JOIN m ON m.a = p.c AND m.b = q.c ORDER BY score DESC, 1, 2 LIMIT 10""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in _PAIRED.items()))
    return discover.column_pairs(rows).select("a", "b", F.round("values", 6).alias("values"), "score")


@register("inspect_values", "SELECT value, 'rare' AS how FROM (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS c FROM orders GROUP BY 1 ORDER BY c, value LIMIT 20)")
def _(spark, sf_dir):
    return discover.inspect_values(read(spark, sf_dir, "orders"), "o_custkey").where("how = 'rare'")


# --- treatments ------------------------------------------------------------------------------------------------

def _treated(name: str, column: str, made, expected: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dirty(spark, sf_dir).select("id", made(F.col(column)).alias("value"))

    register(name, with_dirty(f"SELECT id, {expected} AS value FROM dirty"))(run)


_treated("null_placeholders", "status", treat.null_placeholders, "CASE WHEN lower(status) IN ('tbd', '9999') THEN NULL ELSE status END")
_treated("strip_currency", "amount", treat.strip_currency, "CAST(replace(amount, '$', '') AS DOUBLE)")
_treated("unify_booleans", "is_active", treat.unify_booleans, "is_active IN ('Y', '1')")
_treated("pad_zeros", "zip", lambda c: treat.pad_zeros(c, 5), "lpad(zip, 5, '0')")
_treated("unify_locale", "local_price", treat.unify_locale, "CAST(1234.56 AS DOUBLE)")
_treated("null_sheet_artifacts", "formula", treat.null_sheet_artifacts, "CASE WHEN formula = 'ok' THEN formula END")
_treated("trim_values", "priority", treat.strip, "trim(priority)")
_treated("round_noise", "noise", treat.round_noise, "CAST(19.99 AS DOUBLE)")
_treated("unify_delimiters", "tags", treat.unify_delimiters, "'red,blue'")
_treated("iso_dates", "due_date", treat.iso_date, "CASE WHEN due_date LIKE '2021%' THEN due_date ELSE '2021-' || substr(due_date, 1, 2) || '-' || substr(due_date, 4, 2) END")
_treated("unify_granularity", "ship_date", treat.unify_granularity, "CAST(ship_date AS TIMESTAMP)")
_treated("null_impossible", "quantity", lambda c: treat.null_where(c, c.try_cast("int") < 0), "CASE WHEN quantity <> '-5' THEN quantity END")


@register("fill_median", with_dirty("SELECT id, COALESCE(points, CAST((SELECT median(points) FROM dirty) AS BIGINT)) AS points FROM dirty"))
def _(spark, sf_dir):
    return treat.fill_median(dirty(spark, sf_dir).select("id", "points"), "points")


@register("fill_mode_or_unknown", with_dirty("SELECT id, COALESCE(tier, 'gold') AS tier FROM dirty"))
def _(spark, sf_dir):
    return treat.fill_mode_or_unknown(dirty(spark, sf_dir).select("id", "tier"), "tier")


@register("flag_missing", with_dirty("SELECT id, customer_id, customer_id IS NULL AS customer_id_missing FROM dirty"))
def _(spark, sf_dir):
    return treat.high_missing(dirty(spark, sf_dir).select("id", "customer_id"), "customer_id", "flag")


@register("dedupe_first", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def _(spark, sf_dir):
    return treat.dedupe_first(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@register("canonical_categories", with_dirty("SELECT id, CASE WHEN (SELECT count(*) FILTER (WHERE priority LIKE ' %') * 2 > count(*) FROM dirty) THEN lower(trim(priority)) ELSE upper(trim(priority)) END AS priority FROM dirty"))
def _(spark, sf_dir):
    return treat.canonical_categories(dirty(spark, sf_dir).select("id", "priority"), "priority")


@register("clean_prose", "SELECT doc_id, regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS text FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", treat.clean_prose(F.col("text")).alias("text"))


@register("composite_split", with_jobs("SELECT job_id, CASE WHEN location LIKE '%, __' THEN split_part(location, ', ', 1) END AS city, CASE WHEN location LIKE '%, __' THEN split_part(location, ', ', 2) END AS state FROM jobs"))
def _(spark, sf_dir):
    return treat.composite_split(view(spark, sf_dir, JOBS).select("job_id", "location"), "location", "^(.*), ([A-Z]{2})$", ("city", "state"))


@register("treatment_signatures", "SELECT * FROM (VALUES ('negative_values', 'quantity', 'numeric'), ('numeric_as_text', 'score', 'numeric'), ('delimiter_mix', 'tags', 'text')) t(kind, cols, value_type)")
def _(spark, sf_dir):
    df = dirty(spark, sf_dir).select("quantity", "score", "tags")
    made = treat.signatures(rubric.issues(df, "orders"), rubric.value_types(to_long(df, "orders")))
    return made.select("signature.kind", F.array_join("columns", ",").alias("cols"), "signature.value_type")


@register("quality_status", with_dirty(f"SELECT 'orders' AS \"table\", CASE WHEN bool_or(severity = 'fail') THEN 'fail' ELSE 'warn' END AS status, count(*) + (SELECT CASE WHEN count(*) > count(DISTINCT (tags, quantity)) THEN 1 ELSE 0 END FROM dirty) AS n_issues FROM ({_EVERY}) WHERE \"column\" IN ('tags', 'quantity')"))
def _(spark, sf_dir):
    return treat.quality_status(rubric.issues(dirty(spark, sf_dir).select("tags", "quantity"), "orders")).select("table", "status", F.size("issues").cast("long").alias("n_issues"))


#: The planted table as it must be once it is clean.
_CLEAN = """SELECT CASE WHEN id NOT IN (999, 9999) THEN id END AS id, CASE WHEN customer_id NOT IN ('999', '9999') THEN customer_id END AS customer_id,
 CASE WHEN status NOT IN ('TBD', '9999') THEN status END AS status, upper(trim(priority)) AS priority, CAST(replace(amount, '$', '') AS DOUBLE) AS amount,
 is_active IN ('Y', '1') AS is_active, lpad(zip, 5, '0') AS zip, CAST(1234.56 AS DOUBLE) AS local_price, CAST(19.99 AS DOUBLE) AS noise, CASE WHEN formula = 'ok' THEN formula END AS formula,
 'red,blue' AS tags, CASE WHEN due_date LIKE '2021%' THEN due_date ELSE '2021-' || substr(due_date, 1, 2) || '-' || substr(due_date, 4, 2) END AS due_date,
 CAST(ship_date AS TIMESTAMP) AS ship_date, CASE WHEN quantity <> '-5' THEN quantity END AS quantity, CASE WHEN start_date BETWEEN '1900' AND '2028' THEN start_date END AS start_date,
 CASE WHEN score NOT LIKE 'n%' THEN CAST(replace(score, 'n', '') AS DOUBLE) END AS score, CASE WHEN parent_id NOT IN ('999', '9999') THEN parent_id END AS parent_id,
 COALESCE(points, CAST((SELECT median(points) FROM dirty) AS BIGINT)) AS points, COALESCE(tier, 'gold') AS tier FROM dirty"""


def _still(category: str, column: str, affected: str, state: str = "left", limit: str = "0") -> str:
    return f"SELECT '{state}' AS state, '{category}' AS category, '{column}' AS \"column\", CAST({affected} AS BIGINT) AS affected FROM clean HAVING {affected} > {limit}"


_RECHECK = " UNION ALL ".join([
    *(_still("missing", c, f"count(*) FILTER (WHERE {c} IS NULL)", state, "0.05 * count(*)") for c, state in (("customer_id", "left"), ("formula", "new"), ("score", "new"), ("status", "new"))),
    *(_still("duplicate_keys", c, f"count({c}) - count(DISTINCT {c})") for c in ("customer_id", "parent_id")),
    "SELECT 'left', 'dangling_refs', 'parent_id', count(*) FROM clean WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT CAST(id AS VARCHAR) FROM clean WHERE id IS NOT NULL) HAVING count(*) > 0",
])


@register("recheck", with_dirty(f"SELECT * FROM (WITH clean AS ({_CLEAN}) {_RECHECK})"))
def _(spark, sf_dir):
    made = treat.clean(dirty(spark, sf_dir), "orders")
    left, new = (x.select(F.lit(state).alias("state"), "category", "column", "affected") for state, x in (("left", made.unresolved), ("new", made.introduced)))
    return left.unionByName(new)


@register("clean_table", with_dirty(_CLEAN))
def _(spark, sf_dir):
    return treat.clean(dirty(spark, sf_dir), "orders").table.withColumn("id", F.col("id").cast("long"))


@register("cleaning_log", with_dirty("SELECT 'orders' AS table_name, count(*) AS row_count_before, count(*) AS row_count_after, 'kept' AS row_check, 'fail' AS status, 'missing:formula, missing:score, missing:status' AS introduced, 'dangling_refs:parent_id, duplicate_keys:customer_id' || CASE WHEN count(parent_id) > count(DISTINCT parent_id) THEN ', duplicate_keys:parent_id' ELSE '' END || ', missing:customer_id' AS unresolved FROM dirty"))
def _(spark, sf_dir):
    log = treat.clean(dirty(spark, sf_dir), "orders").log
    return log.select("table_name", "row_count_before", "row_count_after", "row_check", "status", F.array_join("issues_introduced", ", ").alias("introduced"), F.array_join("issues_unresolved", ", ").alias("unresolved"))


@register("repair_header", "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 NOT IN (3, 4)")
def _(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").selectExpr("CASE o_orderkey % 10 WHEN 3 THEN 'Order Key' WHEN 4 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS `Order Key`", "CASE o_orderkey % 10 WHEN 3 THEN 'STATUS' WHEN 4 THEN NULL ELSE o_orderstatus END AS STATUS")
    return treat.repair_header(raw)


# --- enrichment ------------------------------------------------------------------------------------------------

@register("range_detect", with_jobs("SELECT 'salary' AS \"column\", count(*) AS matched, count(*) AS n, 1.0::DOUBLE AS fraction FROM jobs"))
def _(spark, sf_dir):
    return enrich.range_columns(to_long(view(spark, sf_dir, JOBS), "jobs", ["salary", "title"])).select("column", "matched", "n", "fraction")


@register("range_decompose", with_jobs("SELECT job_id, CASE job_id % 4 WHEN 0 THEN 1e7 WHEN 1 THEN 5e4 WHEN 2 THEN 100.0 END::DOUBLE AS salary_min, CASE job_id % 4 WHEN 0 THEN 2.5e7 WHEN 1 THEN 7.5e4 WHEN 3 THEN 1e6 END::DOUBLE AS salary_max, CASE job_id % 4 WHEN 0 THEN 1.75e7 WHEN 1 THEN 6.25e4 END::DOUBLE AS salary_avg FROM jobs"))
def _(spark, sf_dir):
    return enrich.decompose_range(view(spark, sf_dir, JOBS).select("job_id", "salary"), "salary").drop("salary")


@register("label_detect", with_jobs("SELECT 'size' AS \"column\", count(*) AS matched, count(*) AS n FROM jobs"))
def _(spark, sf_dir):
    return enrich.label_columns(to_long(view(spark, sf_dir, JOBS), "jobs", ["size", "title"])).select("column", "matched", "n")


@register("label_simplify", with_jobs("SELECT job_id, CASE job_id % 3 WHEN 0 THEN '51-200' WHEN 1 THEN '10000+' ELSE '1-50' END AS size FROM jobs"))
def _(spark, sf_dir):
    return enrich.simplify_labels(view(spark, sf_dir, JOBS).select("job_id", "size"), "size")[0]


@register("cardinality_candidates", with_jobs(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(*) AS rows, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM jobs ORDER BY v LIMIT 10)) AS samples FROM jobs HAVING count(DISTINCT {c}) >= 15 AND count(DISTINCT {c}) / count(*) BETWEEN 0.03 AND 0.9" for c in ("industry", "founders", "segment"))).replace("AS industry, c_mktsegment", "AS industry, 'team ' || CAST(c_custkey // 5 AS STRING) AS founders, c_mktsegment"))
def _(spark, sf_dir):
    jobs = view(spark, sf_dir, JOBS).withColumn("founders", F.concat(F.lit("team "), F.expr("job_id div 5")))
    found = enrich.cardinality_candidates(to_long(jobs, "jobs", ["industry", "founders", "job_id", "segment"]))
    return found.select("column", "distinct", "rows", F.array_join("samples", ",").alias("samples"))


@register("apply_mapping", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'industry' WHEN 'MACHINERY' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'home' END AS sector FROM customer")
def _(spark, sf_dir):
    mapping = spark.createDataFrame([("BUILDING", "industry"), ("MACHINERY", "industry"), ("HOUSEHOLD", "home")], "raw_value string, group string")
    return enrich.apply_mapping(read(spark, sf_dir, "customer"), "c_mktsegment", mapping, "sector").select("c_custkey", "sector")


@register("unmapped_values", "SELECT DISTINCT c_mktsegment AS raw_value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def _(spark, sf_dir):
    mapping = spark.createDataFrame([("BUILDING", "industry"), ("MACHINERY", "industry"), ("HOUSEHOLD", "home")], "raw_value string, group string")
    return enrich.unmapped(read(spark, sf_dir, "customer"), "c_mktsegment", mapping)


@register("mapping_diff", "WITH a AS (SELECT DISTINCT p_brand AS r, 'g' || CAST(length(p_brand) AS VARCHAR) AS g FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_brand AS r, CASE WHEN p_brand LIKE '%1' THEN 'new' ELSE 'g' || CAST(length(p_brand) AS VARCHAR) END AS g FROM part WHERE p_size >= 10) SELECT COALESCE(a.r, b.r) AS raw_value, a.g AS old_group, b.g AS new_group, CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.r = b.r WHERE a.g IS DISTINCT FROM b.g OR a.r IS NULL OR b.r IS NULL")
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    plain = F.concat(F.lit("g"), F.length("p_brand").cast("string"))
    old = part.where("p_size < 25").select(F.col("p_brand").alias("raw_value"), plain.alias("group")).distinct()
    new = part.where("p_size >= 10").select(F.col("p_brand").alias("raw_value"), F.when(F.col("p_brand").endswith("1"), "new").otherwise(plain).alias("group")).distinct()
    return enrich.mapping_diff(old, new)


@register("title_category", with_jobs("SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Analyst' ELSE 'Other' END AS category FROM jobs"))
def _(spark, sf_dir):
    return view(spark, sf_dir, JOBS).select("job_id", enrich.title_category(F.col("title")).alias("category"))


@register("age_from_year", with_jobs("SELECT job_id, CASE WHEN CAST(founded AS INTEGER) > 0 THEN 2026 - CAST(founded AS INTEGER) END AS age FROM jobs"))
def _(spark, sf_dir):
    return view(spark, sf_dir, JOBS).select("job_id", enrich.age_from_year(F.col("founded"), 2026).alias("age"))


@register("same_state", with_jobs("SELECT job_id, CASE WHEN location LIKE '%, __' THEN right(location, 2) = right(headquarters, 2) END AS same FROM jobs"))
def _(spark, sf_dir):
    return view(spark, sf_dir, JOBS).select("job_id", enrich.same_state(F.col("location"), F.col("headquarters")).alias("same"))


@register("keyword_flags", with_jobs("SELECT job_id, " + ", ".join(f"COALESCE(contains(lower(description), '{w}'), FALSE) AS has_{w.replace(' ', '_')}" for w in enrich.SKILLS) + " FROM jobs"))
def _(spark, sf_dir):
    return view(spark, sf_dir, JOBS).select("job_id", *(c.alias(n) for n, c in enrich.keyword_flags(F.col("description")).items()))


_LEVELS = "CASE p_partkey % 7 WHEN 0 THEN 'Data Analyst II' WHEN 1 THEN 'Sr Data Scientist' WHEN 2 THEN 'Analyst, Israel' WHEN 3 THEN 'Associate' WHEN 4 THEN 'Director' WHEN 5 THEN 'Jr. Engineer' ELSE 'Baker I ' END"


@register("seniority", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Senior' WHEN 3 THEN 'Junior' WHEN 5 THEN 'Junior' WHEN 6 THEN 'Junior' ELSE 'Not specified' END AS level FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LEVELS} AS title").select("p_partkey", enrich.seniority(F.col("title")).alias("level"))


@register("transformation_candidates", with_jobs("SELECT kind, cols FROM (SELECT 'range_decomposition' AS kind, 'salary' AS cols, TRUE AS ok FROM jobs UNION ALL SELECT 'range_decomposition', 'size', count(*) FILTER (WHERE regexp_matches(size, '\\d+ to \\d+|\\d+\\+')) >= 0.8 * count(*) FROM jobs UNION ALL SELECT 'label_simplification', 'size', count(*) FILTER (WHERE size LIKE '% employees') >= 0.8 * count(*) FROM jobs UNION ALL SELECT 'categorical_consolidation', 'industry', count(DISTINCT industry) >= 15 AND count(DISTINCT industry) / count(*) BETWEEN 0.03 AND 0.9 FROM jobs UNION ALL SELECT 'categorical_consolidation', 'founded', FALSE FROM jobs UNION ALL SELECT 'job_title_categorization', 'title', count(title) > 0 FROM jobs UNION ALL SELECT 'company_age', 'founded', count(TRY_CAST(founded AS INTEGER)) > 0 FROM jobs UNION ALL SELECT 'same_state_flag', 'location,headquarters', TRUE FROM jobs UNION ALL SELECT 'skill_keywords', 'description', bool_or(contains(lower(description), 'python') OR contains(lower(description), 'excel')) FROM jobs UNION ALL SELECT 'seniority_flag', 'title', bool_or(contains(lower(title), 'senior') OR contains(lower(title), 'junior')) FROM jobs) WHERE ok GROUP BY ALL"))
def _(spark, sf_dir):
    return enrich.candidates(view(spark, sf_dir, JOBS).drop("nation"), "jobs").select("kind", F.array_join("columns", ",").alias("cols"))


_MAPPING = "SELECT DISTINCT p_brand AS raw_value, 'g' || CAST(length(p_brand) AS STRING) AS \"group\" FROM part WHERE p_partkey % 10 <> 0"


@register("mapping_complete", f"SELECT NOT EXISTS (SELECT p_brand FROM part WHERE p_brand NOT IN (SELECT raw_value FROM ({_MAPPING}))) AS complete")
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    mapping = part.where("p_partkey % 10 <> 0").select(F.col("p_brand").alias("raw_value"), F.concat(F.lit("g"), F.length("p_brand")).alias("group")).distinct()
    return spark.createDataFrame([(enrich.mapping_complete(part, "p_brand", mapping),)], "complete boolean")


@register("latest_mapping", "SELECT DISTINCT p_brand AS raw_value, max(p_size % 4) OVER () AS version FROM part QUALIFY p_size % 4 = max(p_size % 4) OVER ()")
def _(spark, sf_dir):
    versions = read(spark, sf_dir, "part").select(F.lit("brand").alias("base_name"), F.col("p_brand").alias("raw_value"), (F.col("p_size") % 4).alias("version")).distinct()
    return enrich.latest_mapping(versions, "brand").select("raw_value", "version")


@register("undecided", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment > 'C' AND c_custkey % 3 <> 0")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    found = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("table"))
    statuses = _statuses(spark, sf_dir).withColumn("source_folder", F.lit("f"))
    return enrich.undecided(found, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("candidate_id")), statuses).select("id")


@register("surfaced", "SELECT r_name AS \"table\", 'average by ' || lower(r_name) AS question FROM region")
def _(spark, sf_dir):
    regions = read(spark, sf_dir, "region")
    found = regions.select(F.col("r_name").alias("table"), F.array(F.lower("r_name")).alias("columns"), F.array(F.lit("nowhere")).alias("tags"))
    return enrich.surfaced(found, regions.select(F.concat(F.lit("average by "), F.lower("r_name")).alias("question"))).select("table", "question")


# --- profiles, keys, joins -------------------------------------------------------------------------------------

def _num(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS \"distinct\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS avg, round(stddev_samp({c}), 4) AS stddev FROM {t}"


@register("profile_numeric", " UNION ALL ".join(_num("lineitem", c) for c in ("l_quantity", "l_discount", "l_linenumber")))
def _(spark, sf_dir):
    return profile.numeric_profile(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@register("profile_categorical", "WITH v AS (SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS rank, count(*) OVER (PARTITION BY \"column\") AS \"distinct\", sum(count) OVER (PARTITION BY \"column\")::BIGINT AS rows FROM v) SELECT \"column\", CAST(rank AS INTEGER) AS rank, value, count, \"distinct\", rows, 0::BIGINT AS nulls, FALSE AS high_cardinality FROM r WHERE rank <= 5")
def _(spark, sf_dir):
    return profile.categorical_profile(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


KEYED = ["customer", "orders", "nation", "supplier", "part", "lineitem", "region"]
_KEYS = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("region", "r_regionkey")]
_FANOUT = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{c[2:]}' AS name, count({c}) AS total, count(DISTINCT {c}) AS d FROM {t}" for t, c in _KEYS) + ")"


def _fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fanout({t: read(spark, sf_dir, t) for t in KEYED}, r"(_id|key)$", True)


@register("fanout_status", _FANOUT + " SELECT t AS \"table\", c AS \"column\", name, total, d AS \"distinct\", CASE WHEN total = d THEN 'likely_pk' ELSE 'likely_fk' END AS role, total <> d AS has_fanout FROM f")
def _(spark, sf_dir):
    return _fanout(spark, sf_dir)


@register("fanout_warnings", _FANOUT + " SELECT a.t AS \"table\", a.c AS \"column\", b.t AS key_table, round(a.total / a.d, 4) AS rows_per_key FROM f a JOIN f b ON a.name = b.name AND a.t <> b.t WHERE a.total <> a.d AND b.total = b.d")
def _(spark, sf_dir):
    return profile.fanout_warnings(_fanout(spark, sf_dir))


@register("join_advisory", _FANOUT + " SELECT a.t AS fk_table, a.c AS fk_column, b.t AS pk_table, b.c AS pk_column, a.total <> a.d AS has_fanout, CASE WHEN a.t = 'orders' THEN 'declared' ELSE 'inferred' END AS certainty FROM f a JOIN f b ON a.name = b.name AND a.t <> b.t WHERE a.total <> a.d AND b.total = b.d")
def _(spark, sf_dir):
    declared = spark.createDataFrame([("orders", "o_custkey", "customer", "c_custkey")], "fk_table string, fk_column string, pk_table string, pk_column string")
    return profile.join_advisory(_fanout(spark, sf_dir), declared)


@register("data_dictionary", _FANOUT + " SELECT t AS \"table\", c AS \"column\", CASE WHEN total = d THEN 'likely_pk' ELSE 'likely_fk' END AS role, total <> d AS has_fanout, c = 'c_nationkey' AS derived FROM f WHERE t = 'customer' UNION ALL SELECT 'customer', v, NULL, NULL, FALSE FROM (VALUES ('c_name'), ('c_acctbal'), ('c_mktsegment')) x(v)")
def _(spark, sf_dir):
    derived = spark.createDataFrame([("customer", "c_nationkey")], "table string, column string")
    return profile.data_dictionary({"customer": read(spark, sf_dir, "customer")}, _fanout(spark, sf_dir), derived).select("table", "column", "role", "has_fanout", "derived")


@register("table_metadata", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in KEYED))
def _(spark, sf_dir):
    return profile.table_metadata({t: read(spark, sf_dir, t) for t in KEYED}).select("table", "rows")


@register("profile_table", "SELECT 0 AS pos, 'o_orderkey' AS \"column\", 'numeric' AS kind, count(*) AS rows, 0::BIGINT AS nulls, count(DISTINCT o_orderkey) AS \"distinct\", max(o_orderkey)::DOUBLE AS max, NULL AS top FROM orders UNION ALL SELECT 1, 'status', 'categorical', count(*), count(*) FILTER (WHERE o_orderkey % 9 = 0), count(DISTINCT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END), NULL, (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1)) FROM orders")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status")
    top = F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"])), ",")
    return profile.profile_table(orders).select("pos", "column", "kind", "rows", "nulls", "distinct", "max", top.alias("top"))


@register("fanout_incremental", """SELECT 'orders' AS "table", 'o_custkey' AS "column", count(*) AS total, count(DISTINCT o_custkey) AS "distinct", 'stored' AS source FROM orders WHERE o_orderkey % 5 <> 1
 UNION ALL SELECT 'customer', 'c_custkey', count(*), count(DISTINCT c_custkey), 'live' FROM customer""")
def _(spark, sf_dir):
    root, orders = f"{publish.shared_folder(spark)}/keys-{uuid.uuid4().hex}", read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counts = lambda rows: profile.key_counts({"orders": rows.select("o_custkey")}, "custkey$")
    store.publish(counts(orders.where("o_orderkey % 5 > 0")), root, profile.KEY, 8)
    profile.add_counts(root, counts(orders.where("o_orderkey % 5 = 0")), counts(orders.where("o_orderkey % 5 = 1")))
    tables = {"orders": orders.select("o_custkey"), "customer": read(spark, sf_dir, "customer").select("c_custkey")}
    return profile.fanout_kept(root, tables, "custkey$").select("table", "column", "total", "distinct", "source")


@register("uncovered", "SELECT * FROM (VALUES ('orders'), ('customer')) t(\"table\") WHERE \"table\" NOT IN (SELECT CASE WHEN count(*) > 0 THEN 'customer' END FROM customer)")
def _(spark, sf_dir):
    stored = read(spark, sf_dir, "customer").select(F.lit("customer").alias("table"))
    return profile.uncovered(["orders", "customer"], stored, spark)


@register("table_warnings", f"SELECT c_mktsegment AS table_name, w.warning FROM (SELECT c_mktsegment, CASE WHEN c_mktsegment < 'C' THEN 'fail' WHEN c_mktsegment < 'I' THEN 'warn' ELSE 'pass' END AS status, count(*) AS n FROM customer GROUP BY 1) CROSS JOIN (VALUES ('unresolved fail issues'), ('source changed'), ('never checked')) w(warning) WHERE (w.warning = 'unresolved fail issues' AND status = 'fail') OR (w.warning = 'source changed' AND n % 2 = 0) OR (w.warning = 'never checked' AND status = 'pass')")
def _(spark, sf_dir):
    s = _statuses(spark, sf_dir)
    fresh = s.select("table_name", F.when(F.col("n") % 2 == 0, "changed").otherwise("unchanged").alias("state"))
    return status.warnings(s.select("table_name"), s.where("status <> 'pass'").select("table_name", "status"), fresh)


@register("audit_history", "SELECT ts, CASE WHEN event_id % 2 = 0 THEN 'cleaning' ELSE 'decision' END AS event, event_type AS what FROM events WHERE user_id % 3 = 1")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("table_name", F.concat(F.lit("T"), F.col("user_id") % 3))
    cleaning = e.where("event_id % 2 = 0").select("ts", F.array(F.struct("table_name", F.col("event_type").alias("status"))).alias("files"))
    return status.audit_history(cleaning, e.where("event_id % 2 <> 0").select("ts", "table_name", F.col("event_type").alias("response")), "t1").select("ts", "event", "what")


@register("invalidate", "SELECT n_nationkey FROM nation WHERE n_name <> 'n7' AND n_nationkey % 5 <> 2 OR n_nationkey % 5 = 3")
def _(spark, sf_dir):
    # Rows without a table name stay.
    rows = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE WHEN n_nationkey % 5 = 2 THEN 'gone' WHEN n_nationkey % 5 <> 3 THEN n_name END AS table_name")
    return publish.invalidate(rows, "gone").select("n_nationkey")


@register("publish_and_rollback", "SELECT 'first' AS generation, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'second', count(*) FROM orders UNION ALL SELECT 'rolled back', count(*) FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, sf_dir):
    orders, table, seen = read(spark, sf_dir, "orders").select("o_orderkey"), f"published_{uuid.uuid4().hex[:8]}", []
    publish.publish(orders.where("o_orderkey % 2 = 0"), table)
    seen.append(("first", spark.table(table).count()))
    publish.publish(orders, table)
    seen.append(("second", spark.table(table).count()))
    publish.rollback(spark, table)
    seen.append(("rolled back", spark.table(table).count()))
    for name in (table, f"{table}_previous"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame(seen, "generation string, n long")


def _file(df: DataFrame, name: str, **options) -> str:
    """The rows as CSV files with headers in the folder that all share."""
    path = f"{publish.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(header=True, **options).csv(path)
    return path


_CSV = "SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'a, \"b\"' WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_orderstatus END AS note, CAST(o_totalprice AS STRING) AS price FROM orders"


@register("csv_audit", f"SELECT id, CASE WHEN note <> 'N/A' THEN note END AS note FROM ({_CSV})")
def _(spark, sf_dir):
    return files.read_csv_audit(spark, _file(view(spark, sf_dir, _CSV), "audit", escape='"')).select("id", "note")


@register("csv_typed", f"SELECT CAST(id AS BIGINT) AS id, note, round(CAST(price AS DOUBLE), 2) AS price FROM ({_CSV})")
def _(spark, sf_dir):
    return files.load_csv(spark, _file(view(spark, sf_dir, _CSV), "typed", escape='"')).withColumn("price", F.round("price", 2))


#: Lines of planted files by order key: one for each flaw, one with a quoted line end, the others plain.
_LINES = """CASE WHEN o_orderkey % 83 = 0 THEN 'id,na#me' WHEN o_orderkey % 89 = 0 THEN concat(o_orderkey, ',a"b') WHEN o_orderkey % 97 = 0 THEN concat(o_orderkey, ',a,b')
 WHEN o_orderkey % 79 = 0 THEN concat(o_orderkey, ',bad \ufffd') WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey, ',"two', chr(10), 'lines, \"\"said\"\"\"') ELSE concat(o_orderkey, ',a') END"""
_FLAWED = "o_orderkey % 83 <> 0 AND o_orderkey % 89 <> 0"


def _shared(spark: SparkSession, name: str) -> str:
    return f"{publish.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("json_lines", "SELECT event_id, event_type, value FROM events WHERE event_id % 9 <> 0")
def _(spark, sf_dir):
    path, events = _shared(spark, "jsonl"), read(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    events.select(F.when(F.col("event_id") % 9 == 0, F.lit('{"event_id": ')).otherwise(good).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double")


@register("json_table", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    path = _shared(spark, "json")
    rows = read(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))  # five regions
    rows.write.text(path)
    return files.read_json(spark, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


def _by_nation(spark: SparkSession, sf_dir: str, columns: list[str], only: int | None = None) -> DataFrame:
    """Customers, each nation's in one partition and in order, so that a nation is written as one file."""
    rows = read(spark, sf_dir, "customer").where(F.lit(True) if only is None else F.col("c_nationkey") % 3 == only)
    return rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").selectExpr("c_nationkey AS n", *columns)


@register("folder_manifest", """SELECT n, 'csv' AS kind, 'id,code' AS "shape", octet_length(encode(t)) AS bytes, sha256(t) AS checksum FROM
 (SELECT c_nationkey AS n, concat('id,code', chr(10), string_agg(concat(c_custkey, ',', c_nationkey), chr(10) ORDER BY c_custkey), chr(10)) AS t FROM customer GROUP BY 1)""")
def _(spark, sf_dir):
    path = _shared(spark, "folder")
    _by_nation(spark, sf_dir, ["c_custkey AS id", "c_nationkey AS code"]).write.option("header", True).partitionBy("n").csv(path)
    return folders.manifest(spark, path).select(F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("int").alias("n"), "kind", "shape", "bytes", "checksum")


@register("folder_tables", """SELECT CASE c_nationkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'csv quoted' ELSE 'jsonl' END AS kind, c_nationkey AS n, count(*) AS "rows", sum(c_custkey) AS ids,
 max(CASE WHEN c_nationkey % 3 = 1 THEN concat('two', chr(10), 'lines, "', c_custkey, '"') ELSE c_mktsegment END) AS label FROM customer GROUP BY 1, 2""")
def _(spark, sf_dir):
    path = _shared(spark, "mixed")
    writer = lambda df: df.write.option("header", True).option("escape", '"').partitionBy("n")
    writer(_by_nation(spark, sf_dir, ["c_custkey AS id", "c_mktsegment AS label"], 0)).csv(f"{path}/plain")
    writer(_by_nation(spark, sf_dir, ["c_custkey AS number", """concat('two', chr(10), 'lines, "', c_custkey, '"') AS text"""], 1)).csv(f"{path}/quoted")
    writer(_by_nation(spark, sf_dir, ["c_custkey AS id", "c_mktsegment AS label"], 2)).json(f"{path}/json")
    found, _ = folders.tables(publish.stored(folders.manifest(spark, path), "manifest"))
    parts = []
    for name, df in found.items():
        kind = "csv quoted" if "number" in df.columns else name.split("_")[0]
        parts.append(df.toDF(*("id" if c == "number" else "label" if c == "text" else c for c in df.columns)).select(F.lit(kind).alias("kind"), F.col("id").cast("long"), "label", F.regexp_extract("_path", "/n=([0-9]+)/", 1).cast("int").alias("n")))
    return files.union_tables(parts).groupBy("kind", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.max("label").alias("label"))


@register("log_append", "SELECT event_type, count(*) + count(*) FILTER (WHERE event_id % 2 = 0) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    path, events = _shared(spark, "log"), read(spark, sf_dir, "events").select("event_id", "event_type")
    publish.append_log(events, path)
    publish.append_log(events.where("event_id % 2 = 0"), path)
    return files.read_jsonl(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("csv_export", "SELECT c_mktsegment AS \"C Mktsegment\", round(avg(c_acctbal), 2) AS \"Avg Balance\" FROM customer GROUP BY 1")
def _(spark, sf_dir):
    path = _shared(spark, "export")
    publish.export_csv(read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("avg_balance")), path)
    return files.read_csv_audit(spark, path).withColumn("Avg Balance", F.col("`Avg Balance`").cast("double"))


@register("capped_result", "SELECT * FROM (SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 200) UNION ALL SELECT n_nationkey, false FROM nation")
def _(spark, sf_dir):
    out = None
    for df in (read(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey"), read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS o_orderkey")):
        rows, more = publish.capped(df)
        made = rows.withColumn("truncated", F.lit(more))
        out = made if out is None else out.unionByName(made)
    return out


@register("saved_metric", "SELECT o_orderpriority, round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS spend FROM orders GROUP BY 1")
def _(spark, sf_dir):
    kept = spark.createDataFrame([status.parse_metric("define metric Spend as sum(o_totalprice) / count(DISTINCT o_custkey) -- per customer"), ("old", "count(*)", "")], "metric_name string, fragment string, description string")
    kept, there = publish.delete_metric(kept, "old")
    row = kept.first()
    made = status.apply_metric(read(spark, sf_dir, "orders"), ["o_orderpriority"], row.metric_name, row.fragment)
    return made.withColumn("spend", F.round("spend", 4)).where(F.lit(there))


@register("generation_columns", "SELECT 'o_comment_part' AS gone, 'first_word,second_word' AS added, count(*) AS n FROM orders")
def _(spark, sf_dir):
    before = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("o_comment_part"))
    after = treat.composite_split(before, "o_comment_part", r"^(\S+) (.*)$", ("first_word", "second_word"))
    root = _shared(spark, "generations")
    store.publish(before, root)
    store.publish(after, root)
    gone, added = profile.column_diff(store.read(spark, root, "before").columns, store.read(spark, root).columns)
    fits = enrich.shape_ok(["o_orderkey"], after.columns, ["first_word", "second_word"])
    return store.read(spark, root).where(F.lit(fits)).agg(F.lit(",".join(gone)).alias("gone"), F.lit(",".join(added)).alias("added"), F.count(F.lit(1)).alias("n"))


@register("query_notes", f"SELECT conv_id, turn, 'orders' AS table_name, 'never checked' AS warning FROM ({RUNS})")
def _(spark, sf_dir):
    log = view(spark, sf_dir, RUNS).withColumn("run", F.struct("conv_id", "turn"))
    touched = logs.tables_touched(log, spark.createDataFrame([("orders",), ("part",)], "table string"), "run").select(F.col("run").alias("query_id"), F.col("table").alias("table_name"))
    notes = spark.createDataFrame([("orders", "never checked"), ("part", "stale")], "table_name string, warning string")
    return stats.relevant_notes(notes, touched).select("query_id.conv_id", "query_id.turn", "table_name", "warning")


@register("eligible_columns", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("tbd", F.when(F.col("o_orderkey") % 9 == 0, "TBD").otherwise("x"))
    flagged = [r["column"] for r in rubric.failing_columns(rubric.issues(orders.select("tbd", "o_orderpriority"), "orders")).collect()]
    group = discover.eligible_columns(["tbd", "o_orderpriority"], flagged, [], [])
    made = shapes.rank_groups(orders, group, {"price": "o_totalprice"})
    counts, means = stats.count_columns(made.columns), stats.mean_columns(made.columns)
    return made.select(*group, *counts, *(F.round(c, 4).alias(c) for c in means))


@register("csv_line_issues", f"SELECT 'ragged_rows' AS category, count(*) FILTER (WHERE o_orderkey % 97 = 0 AND {_FLAWED}) AS affected FROM orders UNION ALL SELECT 'unmatched_quote', count(*) FILTER (WHERE o_orderkey % 89 = 0 AND o_orderkey % 83 <> 0) FROM orders UNION ALL SELECT 'repeated_header', count(*) FILTER (WHERE o_orderkey % 83 = 0) FROM orders UNION ALL SELECT 'encoding', count(*) FILTER (WHERE o_orderkey % 79 = 0 AND o_orderkey % 97 <> 0 AND {_FLAWED}) FROM orders UNION ALL SELECT 'trailing_empty', 2 UNION ALL SELECT 'header_special', 1 UNION ALL SELECT 'header_issues', 1 UNION ALL SELECT 'bom', 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("1 AS part", "o_orderkey AS k", f"{_LINES} AS value")
    marked = spark.createDataFrame([(0, 0, "\ufeffid,na#me"), (2, 0, ",,"), (2, 1, " ")], "part int, k long, value string")
    path = f"{publish.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    # One file, as its header is its first line; it is read in splits.
    marked.unionByName(rows).repartition(1).sortWithinPartitions("part", "k").select("value").write.text(path)
    found = lines.line_issues(spark, path).unionByName(lines.bom(spark, path))
    return found.groupBy("category").agg(F.sum("affected").alias("affected"))


@register("file_lines", "SELECT count(*) + 1 AS n, sum(length(CAST(o_orderkey AS VARCHAR)) + 2) + 6 AS chars, count(*) * (count(*) + 1) // 2 AS places FROM orders")
def _(spark, sf_dir):
    path = _file(read(spark, sf_dir, "orders").select("o_orderkey", F.lit("a").alias("b")).coalesce(1).toDF("k", "flag"), "numbered")
    return lines.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("chars"), F.sum("line_no").alias("places"))


@register("json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return logs.json_fields(read(spark, sf_dir, "events"), "props", {"k": "bigint"}).select("event_id", "k")


@register("text_helpers", "SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS plain, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE AS alike FROM part")
def _(spark, sf_dir):
    alike = text.jaccard(F.array(F.lower("p_type")), F.array(F.lit("economy")))
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_brand")).alias("slug"), text.normalised(F.col("p_brand")).alias("plain"), alike.alias("alike"))


@register("rank_two_metrics", with_dirty("SELECT is_active, count(*) AS n, round(avg(points), 4) AS avg_points, round(stddev_samp(points), 4) AS stddev_points, round(avg(CAST(customer_id AS DOUBLE)), 4) AS avg_customer, round(stddev_samp(CAST(customer_id AS DOUBLE)), 4) AS stddev_customer FROM dirty WHERE points IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"))
def _(spark, sf_dir):
    rows = dirty(spark, sf_dir).withColumn("customer", F.col("customer_id").cast("double"))
    return shapes.rank_groups(rows, ["is_active"], {"points": "points", "customer": "customer"})


@register("chart_shape", "SELECT CASE WHEN count(DISTINCT c_mktsegment) > 5 THEN 'bar' ELSE 'pie' END AS pie, CASE WHEN count(DISTINCT c_nationkey) > 5 THEN 'bar' ELSE 'pie' END AS wide_pie, 'c_mktsegment' AS category, 'total' AS measure FROM customer")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    grouped = c.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("total"))
    wide = c.groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.sum("c_acctbal").alias("total"))
    return spark.createDataFrame([(charts.validate_shape(grouped, "pie")[0], charts.validate_shape(wide, "pie")[0], *charts.fallback_columns(grouped))], "pie string, wide_pie string, category string, measure string")


@register("step_checklist", "SELECT conv_id, turn, role AS step, CASE WHEN turn % 3 = 0 THEN 'skipped' WHEN turn % 2 = 0 THEN 'done' ELSE 'failed' END AS outcome FROM conversations")
def _(spark, sf_dir):
    log = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.array(F.struct(F.col("role").alias("name"), (F.col("turn") % 2 == 0).alias("ok"), (F.col("turn") % 3 == 0).alias("skipped"))).alias("steps"))
    return logs.step_checklist(log, "key").select("key.conv_id", "key.turn", "step", "outcome")


@register("ingestion_registry", "SELECT user_id AS url, min(ts) AS first_fetched_at, max(ts) AS last_fetched_at, count(*) AS fetch_count FROM events GROUP BY user_id")
def _(spark, sf_dir):
    attempts = read(spark, sf_dir, "events").select(F.col("user_id").alias("url"), "ts", F.col("event_type").alias("status"), F.col("props").alias("error"), F.lit("f").alias("folder"))
    return publish.ingestion_registry(attempts).select("url", "first_fetched_at", "last_fetched_at", "fetch_count")


@register("latest_per_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return publish.latest(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@register("upsert", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS v FROM orders")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey k", "1 v")
    return publish.upsert(rows, rows.where("k % 10 = 0").withColumn("v", F.lit(2)), ["k"], "v")


@register("store_change", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS v FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, sf_dir):
    rows, root = read(spark, sf_dir, "orders").selectExpr("o_orderkey k", "1 v"), f"{publish.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store.publish(rows, root, ["k"], 16)
    store.change(spark, root, upserts=rows.where("k % 10 = 0").withColumn("v", F.lit(2)))
    store.change(spark, root, deletes=rows.where("k % 7 = 0"))
    return store.read(spark, root)


@register("store_rollback", "SELECT 'now' AS generation, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n FROM orders UNION ALL SELECT 'before', count(*) FROM orders")
def _(spark, sf_dir):
    rows, root = read(spark, sf_dir, "orders").select("o_orderkey"), f"{publish.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store.publish(rows.where("o_orderkey % 2 = 0"), root)
    store.publish(rows, root)
    store.rollback(spark, root)
    return store.read(spark, root).agg(F.count(F.lit(1)).alias("n")).select(F.lit("now").alias("generation"), "n").unionByName(store.read(spark, root, "before").agg(F.count(F.lit(1)).alias("n")).select(F.lit("before").alias("generation"), "n"))


@register("plan_replay", with_dirty(f"SELECT id, status, tags, amount, quantity FROM ({_CLEAN})"))
def _(spark, sf_dir):
    df, root = dirty(spark, sf_dir).select("id", "status", "tags", "amount", "quantity"), f"{publish.shared_folder(spark)}/plans-{uuid.uuid4().hex}"
    plans.remember(spark, root, plans.plans_of(df, rubric.issues(df, "orders"), "orders"))
    return plans.replay(spark, root, df, "orders").table.withColumn("id", F.col("id").cast("long"))


_STATUS = "SELECT c_mktsegment AS table_name, CASE WHEN c_mktsegment < 'C' THEN 'fail' WHEN c_mktsegment < 'I' THEN 'warn' ELSE 'pass' END AS status, count(*) AS n FROM customer GROUP BY c_mktsegment"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_mktsegment")
    level = F.when(name < "C", "fail").when(name < "I", "warn").otherwise("pass")
    return read(spark, sf_dir, "customer").groupBy(name.alias("table_name")).agg(F.first(level).alias("status"), F.count(F.lit(1)).alias("n"))


@register("dq_backlog", f"SELECT table_name, status FROM ({_STATUS}) WHERE status <> 'pass'")
def _(spark, sf_dir):
    return status.backlog(_statuses(spark, sf_dir).withColumn("issues", F.array(F.lit("x")))).select("table_name", "status")


@register("freshness", f"SELECT table_name, CASE WHEN n % 3 = 0 THEN 'source_missing' WHEN status = 'pass' THEN 'no_baseline' WHEN n % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM ({_STATUS})")
def _(spark, sf_dir):
    s = _statuses(spark, sf_dir)
    stored = s.withColumn("checksum", F.when(F.col("status") != "pass", F.lit("a")))
    return status.freshness(stored, s.where("n % 3 <> 0").withColumn("checksum", F.when(F.col("n") % 2 == 0, "b").otherwise("a")))


# --- query shapes, charts, statistics --------------------------------------------------------------------------

_RANKED = "SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price, round(stddev_samp(o_totalprice), 4) AS stddev_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) >= 5"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@register("rank_groups_min_n", _RANKED)
def _(spark, sf_dir):
    return shapes.rank_groups(_priced(spark, sf_dir), ["c_mktsegment"], {"price": "o_totalprice"})


@register("anova_segments", f"WITH g AS ({_RANKED}), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * avg_price) AS s, sum(n * avg_price * avg_price) AS q, sum((n - 1) * stddev_price * stddev_price) AS w FROM g) SELECT k, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM s")
def _(spark, sf_dir):
    ranked = shapes.rank_groups(_priced(spark, sf_dir), ["c_mktsegment"], {"price": "o_totalprice"})
    return stats.anova(ranked, "avg_price", "stddev_price", "n").withColumn("f", F.round("f", 5)).drop("p")


_MODES = "SELECT o_orderkey % 3 AS part, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1"


# With three groups the tail of F is a power.
@register("anova_p", f"WITH g AS ({_MODES}), a AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS n FROM g), f AS (SELECT any_value(a.n) - 3 AS d, (sum(g.n * (m - grand) ** 2) / 2) / (sum((g.n - 1) * s * s) / (any_value(a.n) - 3)) AS f FROM g, a) SELECT round(f, 5) AS f, CAST(d AS BIGINT) AS df_within, round(pow(1 + 2 * f / d, -d / 2), 6) AS p FROM f")
def _(spark, sf_dir):
    parts = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 3).alias("part")).agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return stats.anova(parts, "m", "s", "n").select(F.round("f", 5).alias("f"), "df_within", F.round("p", 6).alias("p"))


@register("outlier_groups", "WITH g AS (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT round(max(v), 2) AS max, round(median(v), 2) AS median, count(v) AS groups, count(v) >= 3 AND median(v) > 0 AND max(v) > 3 * median(v) AS flagged FROM g")
def _(spark, sf_dir):
    groups = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v"))
    return stats.outlier_sensitivity(groups, "v").withColumns({"max": F.round("max", 2), "median": F.round("median", 2)})


@register("group_imbalance", "WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT max(n) AS largest, min(n) AS smallest, max(n) / min(n) >= 10 AS flagged FROM g")
def _(spark, sf_dir):
    return stats.size_imbalance(read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), "n")


@register("disclosure", with_dirty("SELECT 5 AS min_n, 'points' AS ranked_by, count(*) - count(points) AS null_rows, 0::BIGINT AS small_groups FROM dirty"))
def _(spark, sf_dir):
    return shapes.disclosure(dirty(spark, sf_dir), ["is_active"], {"points": "points"}).drop("time_frame")


@register("causal_rewrite", f"WITH runs AS ({RUNS}) SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Heat is associated with growth. 12 underlying rows were included in this ranking. A one-way ANOVA on x' WHEN 1 THEN 'Demand drives growth alongside joy. This result is grouped by month' || chr(10) || chr(10) || 'Note: this result shows a statistical association only — the data cannot establish that one variable caused another.' ELSE 'Plain' END AS answer FROM runs")
def _(spark, sf_dir):
    return view(spark, sf_dir, RUNS).select("conv_id", "turn", stats.causal_rewrite(F.col("answer")).alias("answer"))


@register("first_seen", "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1 ORDER BY 2 LIMIT 12")
def _(spark, sf_dir):
    return stats.first_seen(read(spark, sf_dir, "events"), "event_type", "event_id")


@register("preaggregate_join", "SELECT o_orderkey, o_totalprice, t.qty FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) t ON o_orderkey = l_orderkey")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return shapes.preaggregate_join(orders, lines, "k", [F.sum("l_quantity").alias("qty")]).withColumnRenamed("k", "o_orderkey")


@register("two_stage_topk", "SELECT * FROM (SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def _(spark, sf_dir):
    return shapes.two_stage_topk(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", 25, "o_custkey", "o_orderkey")


@register("bin_case", "SELECT CASE WHEN l_quantity < 10 THEN '< 10' WHEN l_quantity < 25 THEN '10 - 25' ELSE '>= 25' END AS bucket, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return shapes.bin_case(read(spark, sf_dir, "lineitem"), "l_quantity", [10, 25])


@register("pivot_sum", "SELECT o_orderpriority, " + ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return shapes.pivot_sum(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@register("unpivot_metrics", "SELECT s_suppkey, 'nation' AS metric, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def _(spark, sf_dir):
    wide = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return shapes.unpivot_metrics(wide, ["s_suppkey"], ["nation", "balance"])


@register("per_unit", "SELECT l_returnflag, round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS per_unit, count(DISTINCT l_orderkey) AS units FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return shapes.per_unit(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_orderkey")


@register("date_window", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(year FROM o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1, 2")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
    return orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register("distinct_disclosed", "SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    return shapes.distinct_disclosed(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("set_ops", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    customer, supplier, orders = (read(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    keys, used = customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey"))
    ops = {"union": customer.select("c_nationkey").union(supplier.select("s_nationkey")).distinct(), "intersect": keys.intersect(used), "except": keys.subtract(used)}
    made = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in ops.items()]
    return files.union_tables(made)


@register("filters_and_semi_joins", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name ILIKE 'customer%' AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey NOT IN (1, 2) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").ilike("customer%") & F.col("c_acctbal").between(0, 5000) & ~F.col("c_nationkey").isin(1, 2))
    return c.join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@register("three_way_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf_dir):
    joined = _priced(spark, sf_dir).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("rate_metric", "SELECT l_shipdate::DATE AS day, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def _(spark, sf_dir):
    return shapes.rate(read(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")), "day", F.col("l_returnflag") == "R")


@register("cte_composition", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1), cut AS (SELECT avg(t) AS m FROM big) SELECT o_custkey, round(t, 2) AS t FROM big, cut WHERE t > m")
def _(spark, sf_dir):
    sql = "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY 1), cut AS (SELECT avg(t) AS m FROM big) SELECT o_custkey, round(t, 2) AS t FROM big, cut WHERE t > m"
    return spark.sql(sql, orders=read(spark, sf_dir, "orders"))


@register("line_month", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return charts.line(read(spark, sf_dir, "orders"), "o_orderdate", "month", "o_totalprice")


@register("bar_topn", "SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    return charts.bar(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 10)


@register("scatter_groups", "SELECT l_suppkey, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return charts.scatter(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_discount")


@register("pie_other", "WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS category, abs(sum(c_acctbal)) AS value FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS k FROM s) SELECT CASE WHEN k < 5 THEN category ELSE 'Other' END AS category, round(sum(value), 2) AS value FROM r GROUP BY 1")
def _(spark, sf_dir):
    return charts.pie(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")


@register("histogram", "WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / w), 19)::BIGINT AS bin, lo, w FROM orders, s) SELECT bin, round(any_value(lo + bin * w), 4) AS low, count(*) AS n FROM b GROUP BY 1")
def _(spark, sf_dir):
    return charts.histogram(read(spark, sf_dir, "orders"), "o_totalprice")


@register("box_summary", "WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) SELECT o_orderpriority, min(o_totalprice) AS low, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3, max(o_totalprice) AS high FROM orders JOIN q ON p = o_orderpriority WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1")
def _(spark, sf_dir):
    return charts.box(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@register("stacked_grid", "WITH c AS (SELECT c_nationkey, c_mktsegment, round(sum(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END), 2) AS value FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1, 2) SELECT a.c_nationkey, b.c_mktsegment, c.value, c.c_nationkey IS NULL AS is_missing, c.c_nationkey IS NOT NULL AND c.value IS NULL AS is_null FROM (SELECT DISTINCT c_nationkey FROM c) a CROSS JOIN (SELECT DISTINCT c_mktsegment FROM c) b LEFT JOIN c ON c.c_nationkey = a.c_nationkey AND c.c_mktsegment = b.c_mktsegment")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").withColumn("v", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    return charts.stacked(rows, "c_nationkey", "c_mktsegment", "v")


@register("treemap_share", "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS value, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    return charts.treemap(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@register("quadrant", "SELECT p_partkey, p_size < (SELECT median(p_size) FROM part) AND p_retailprice > (SELECT median(p_retailprice) FROM part) AS opportunity FROM part")
def _(spark, sf_dir):
    return charts.quadrant(read(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", "opportunity")


# --- run logs --------------------------------------------------------------------------------------------------

@register("rule_fire_rates", f"WITH r AS (SELECT * FROM ({RUNS}) WHERE route <> 'other'), c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {' OR '.join(f"contains(answer, '{p}')" for p in ps)}) AS fired, count(*) AS runs FROM r" for k, ps in logs.DETECTORS.items()) + ") SELECT rule, fired, runs, round(fired / runs, 6) AS rate FROM c")
def _(spark, sf_dir):
    return logs.rule_fire_rates(view(spark, sf_dir, RUNS))


@register("compare_runs", f"WITH r AS (SELECT question, sql, answer, row_number() OVER (PARTITION BY question ORDER BY conv_id * 1000 + turn DESC) AS k FROM ({RUNS})) SELECT a.question, a.sql <> b.sql AS sql_changed, a.answer <> b.answer AS answer_changed FROM r a JOIN r b USING (question) WHERE a.k = 1 AND b.k = 2")
def _(spark, sf_dir):
    log = view(spark, sf_dir, RUNS).withColumns({"ts": F.expr("conv_id * 1000 + turn"), "columns": F.array(F.lit("a")), "rows": F.array("answer")})
    return logs.compare_runs(log).select("question", "sql_changed", "answer_changed")


#: Logged SQL of six kinds: text, WITH names, computed columns, GROUP BY lists, HAVING count, ORDER BY lists with limits.
LOGGED = [
    ("WITH base AS (SELECT o_custkey, avg(o_totalprice) AS mean_price FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING COUNT(*) >= 5) SELECT * FROM base ORDER BY mean_price DESC LIMIT 10",
     "base", "mean_price=avg(o_totalprice)", "o_custkey", 5, "mean_price DESC:10"),
    ("WITH a AS (SELECT x, sum(y) AS total FROM t GROUP BY x ORDER BY total DESC LIMIT 5), b(p, q) AS (SELECT x, count(*) AS n FROM u GROUP BY x, date_trunc('month', z)) SELECT a.x AS x, total / n AS ratio, upper(a.x) AS name FROM a JOIN b ON a.x = b.p ORDER BY ratio DESC, a.x",
     "a,b", "total=sum(y)|n=count(*)|ratio=total / n|name=upper(a.x)", "x|x, date_trunc('month', z)", None, "total DESC:5|ratio DESC, a.x:"),
    ("SELECT EXTRACT(YEAR FROM ts) AS year, avg(v) AS mean, 'from, (x) limit 3' AS note FROM t GROUP BY EXTRACT(YEAR FROM ts) HAVING sum(v) > 1 AND COUNT(*) >= 7 ORDER BY avg(v) DESC LIMIT 10",
     "", "year=EXTRACT(YEAR FROM ts)|mean=avg(v)|note='from, (x) limit 3'", "EXTRACT(YEAR FROM ts)", 7, "avg(v) DESC:10"),
    ("SELECT k, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS r, CASE WHEN v > 1 THEN 'a' ELSE 'b' END AS kind, v AS plain FROM (SELECT k, max(w) AS v FROM t GROUP BY k LIMIT 9) s -- ORDER BY nothing",
     "", "r=row_number() OVER (PARTITION BY k ORDER BY v DESC)|kind=CASE WHEN v > 1 THEN 'a' ELSE 'b' END|v=max(w)", "k", None, ""),
    ("SELECT a, count(*) AS n FROM t GROUP BY a UNION ALL SELECT b, -count(*) AS n FROM u GROUP BY b, c HAVING count(*) > 3 ORDER BY 1",
     "", "n=count(*)", "a|b, c", 3, "1:"),
    ("DELETE everything", "", "", "", None, ""),
]


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the texts of LOGGED, one a conversation's turn."""
    kinds = F.array(*(F.lit(x[0]) for x in LOGGED))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(kinds, ((F.col("conv_id") + F.col("turn")) % len(LOGGED)).cast("int")).alias("sql"))


def _expected(columns: dict[str, int]) -> str:
    rows = ", ".join(f"({k}, {', '.join(_quoted(x[i]) for i in columns.values())})" for k, x in enumerate(LOGGED))
    return f"SELECT conv_id, turn, {', '.join(columns)} FROM conversations JOIN (VALUES {rows}) e(k, {', '.join(columns)}) ON (conv_id + turn) % {len(LOGGED)} = k"


@register("sql_shape_extract", _expected({"ctes": 1, "grouping_lists": 3, "having_min": 4, "rankings": 5}))
def _(spark, sf_dir):
    made = logs.shapes(logged(spark, sf_dir))
    lists = F.array_join(F.transform("grouping", lambda g: F.array_join(g, ", ")), "|")
    stages = F.array_join(F.transform("rankings", lambda r: F.concat(r["order_by"], F.lit(":"), F.coalesce(r["limit"].cast("string"), F.lit("")))), "|")
    return made.select("conv_id", "turn", F.array_join("ctes", ",").alias("ctes"), lists.alias("grouping_lists"), "having_min", stages.alias("rankings"))


@register("sql_scope", f"SELECT conv_id, turn, 'o_orderstatus' AS filters, 'o_comment' AS not_null FROM ({RUNS})")
def _(spark, sf_dir):
    return logs.shapes(view(spark, sf_dir, RUNS)).select("conv_id", "turn", *(F.array_join(c, ",").alias(c) for c in ("filters", "not_null")))


@register("computed_columns", f"SELECT conv_id, turn, split_part(c, '=', 1) AS alias, substr(c, instr(c, '=') + 1) AS expression FROM (SELECT conv_id, turn, unnest(string_split(computed, '|')) AS c FROM ({_expected({'computed': 2})}) WHERE computed <> '')")
def _(spark, sf_dir):
    log = logged(spark, sf_dir).withColumn("run", F.struct("conv_id", "turn"))
    return logs.computed_columns(log, "run").select("run.conv_id", "run.turn", "alias", "expression")


@register("tables_touched", f"SELECT conv_id, 'orders' AS \"table\" FROM ({RUNS})")
def _(spark, sf_dir):
    return logs.tables_touched(view(spark, sf_dir, RUNS), spark.createDataFrame([("orders",), ("part",)], "table string"), "conv_id")


@register("min_sample_violations", f"SELECT conv_id, turn FROM ({RUNS}) WHERE conv_id % 4 = 0 AND turn % 2 = 0")
def _(spark, sf_dir):
    log = view(spark, sf_dir, RUNS).withColumn("question", F.when(F.col("turn") % 2 == 0, "highest average").otherwise("list all"))
    log = log.withColumn("sql", F.when(F.col("conv_id") % 4 == 0, "SELECT o_custkey, avg(o_totalprice) FROM orders GROUP BY o_custkey").otherwise(F.col("sql")))
    return logs.min_sample_violations(log).select("conv_id", "turn")


@register("latest_run", f"SELECT 'question 3' AS question, max(conv_id * 1000 + turn) AS ts FROM ({RUNS}) WHERE question = 'question 3' HAVING count(*) > 0")
def _(spark, sf_dir):
    return logs.latest_run(view(spark, sf_dir, RUNS).withColumn("ts", F.expr("conv_id * 1000 + turn")), "question 3").select("question", "ts")


@register("html_largest_table", "SELECT page_id, r AS row_no, CAST(page_id AS VARCHAR) || '|' || CASE r WHEN 0 THEN 'a & b' ELSE split_part(url, '/', 3) END AS cells FROM pages, (VALUES (0), (1)) v(r) WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 0, 'small' FROM pages WHERE page_id % 3 = 0")
def _(spark, sf_dir):
    small, large = "'<p>x<table><tr><td>small</td></tr></table>'", "'<table><tr><th>', page_id, '<th>a &amp; b</tr><tr><td>', page_id, '</td><td>', split_part(url, '/', 3), '</td></tr></table>'"
    pages = read(spark, sf_dir, "pages").selectExpr("page_id", f"CASE WHEN page_id % 3 = 0 THEN {small} ELSE concat({small}, {large}) END AS html")
    return files.largest_tables(pages).select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


@register("infer_types", with_dirty("SELECT * FROM (VALUES ('id', 'bigint'), ('status', 'string'), ('quantity', 'bigint'), ('noise', 'double'), ('score', 'string')) t(\"column\", type)"))
def _(spark, sf_dir):
    df = dirty(spark, sf_dir).select(*(F.col(c).cast("string").alias(c) for c in ("id", "status", "quantity", "noise", "score")))
    return spark.createDataFrame(list(files.infer_types(df).items()), "column string, type string")


