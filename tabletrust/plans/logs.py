"""Analytics on run logs: rules that fired, runs compared, shapes of logged queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.plans.clauses import shape_of

# Phrases of an answer by the rule that writes them; any one of a rule's phrases shows that it fired.
DETECTORS = {
    "minimum_sample": ["underlying rows were included in this ranking"],
    "combined_ranking": ["This result is ranked primarily by"],
    "null_exclusion": ["is missing (NULL) were excluded from this result"],
    "time_frame": ["This result covers the period from", "This result is filtered to the period from", "This result is filtered to data around", "This result is grouped by"],
    "outlier": ["substantially higher than the typical group"],
    "imbalance": ["comparing averages across groups this unevenly sized may underweight"],
    "causal": ["this result shows a statistical association only"],
    "distinct": ["Duplicate rows were removed from this result (SELECT DISTINCT was used)"],
    "significance": ["A one-way ANOVA on"],
}


def json_fields(log: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Adds fields of a column of JSON texts, by name and type; null where a text is no JSON or lacks the field."""
    parsed = F.from_json(F.col(column), ", ".join(f"`{f}` {kind}" for f, kind in fields.items()))
    return log.withColumns({f: parsed[f] for f in fields})


def rule_fire_rates(log: DataFrame) -> DataFrame:
    """rule, fired, runs, rate over eligible runs. log: route, answer."""
    runs = log.where(F.col("route").isin("sql_analyst", "visualize"))
    counts = runs.agg(F.count(F.lit(1)).alias("runs"), *(F.count_if(reduce(lambda a, b: a | b, [F.contains("answer", F.lit(p)) for p in ps])).alias(k) for k, ps in DETECTORS.items()))
    return counts.unpivot(["runs"], list(DETECTORS), "rule", "fired").select("rule", "fired", "runs", F.when(F.col("runs") > 0, F.round(F.col("fired") / F.col("runs"), 6)).alias("rate"))


def compare_runs(log: DataFrame) -> DataFrame:
    """For each question with two runs or more: what changed between the latest two. log: question, ts, sql, columns, rows
    (array of strings), answer. Rows are compared as a set; without any SQL there is nothing to compare."""
    ranked = log.withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("ts")))).where("r <= 2")
    two = ranked.groupBy("question").agg(F.max_by(F.struct("sql", "columns", "rows", "answer"), "ts").alias("b"), F.min_by(F.struct("sql", "columns", "rows", "answer"), "ts").alias("a"), F.count(F.lit(1)).alias("n")).where("n = 2 and (a.sql is not null or b.sql is not null)")
    same = (F.size(F.array_except("a.rows", "b.rows")) == 0) & (F.size(F.array_except("b.rows", "a.rows")) == 0)
    return two.select("question", (~F.col("a.sql").eqNullSafe(F.col("b.sql"))).alias("sql_changed"), (~F.col("a.columns").eqNullSafe(F.col("b.columns"))).alias("columns_changed"), F.size("a.rows").alias("rows_before"), F.size("b.rows").alias("rows_after"), same.alias("rows_identical"), (F.col("a.answer") != F.col("b.answer")).alias("answer_changed"))


def runs_of(log: DataFrame, question: str) -> DataFrame:
    return log.where(F.col("question") == question).orderBy("ts")


def latest_run(log: DataFrame, question: str) -> DataFrame:
    return log.where(F.col("question") == question).groupBy("question").agg(F.max_by(F.struct("ts", "sql", "answer"), "ts").alias("r")).select("question", "r.*")


def cte_names(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ctes, the names that WITH queries define."""
    return log.withColumn("ctes", shape_of(F.col(sql))["ctes"])


def computed_columns(log: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """key, alias, expression of the named expressions of every select list, the first of each alias; bare columns aren't computed."""
    return log.select(key, F.explode(shape_of(F.col(sql))["computed"]).alias("c")).select(key, "c.alias", "c.expression")


def shapes(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ctes, grouping (a list for each GROUP BY), having_min, rankings (order_by and limit), computed, filters, not_null
    columns, time frame. A null text has empty lists."""
    q = F.col(sql)
    filters = [r"(?i)(\w+)\s+ilike\s+'[^']*'", r"(?i)(\w+)\s+like\s+'[^']*'", r"(\w+)\s*=\s*'[^']*'", r"(?i)(\w+)\s+in\s*\("]
    window = F.coalesce(*(F.nullif(F.regexp_extract(q, p, 0), F.lit("")) for p in (r"(?i)\w+\s+between\s+'[^']+'\s+and\s+'[^']+'", r"(?i)extract\(year from \w+\)\s*=\s*\d{4}", r"\w+\s*>=\s*'\d{4}-\d{2}-\d{2}'")))
    found = log.withColumn("_shape", shape_of(q)).withColumns({
        "filters": F.array_distinct(F.concat(*(F.regexp_extract_all(F.regexp_replace(q, r"(?i)\w+\s+not\s+in\s*\([^)]*\)", ""), F.lit(p), F.lit(1)) for p in filters))),
        "not_null": F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?i)(\w+)\s+is\s+not\s+null"), F.lit(1))), "frame": window,
    })
    return found.withColumns({c: F.col(f"_shape.{c}") for c in ("ctes", "grouping", "having_min", "rankings", "computed")}).drop("_shape")


def min_sample_violations(log: DataFrame, sql: str = "sql", question: str = "question") -> DataFrame:
    """Runs that rank averages or rates of groups without a minimum sample."""
    q, ask = F.lower(sql), F.lower(question)
    ranks = ask.rlike("highest|lowest|top|best|worst|rank|most|least")
    averaged = q.rlike(r"avg\s*\(|/\s*(count|sum)\s*\(|(count|sum)\s*\([^)]*\)\s*(::\w+)?\s*/")
    return log.where(ranks & q.rlike("group\\s+by") & averaged & ~q.rlike(r"having\s+count"))


def tables_touched(log: DataFrame, catalog: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """key, table: names of the catalogue (a small table) that a query holds as whole words."""
    words = log.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit(r"(\w+)"), F.lit(1)))).alias("table"))
    return words.join(F.broadcast(catalog.select(F.lower("table").alias("table")).distinct()), "table")


def step_checklist(log: DataFrame, key: str) -> DataFrame:
    """key, step, outcome of each run's steps. log: key, steps array<struct<name, ok boolean, skipped boolean>>."""
    s = log.select(key, F.explode("steps").alias("s"))
    return s.select(key, F.col("s.name").alias("step"), F.when(F.col("s.skipped"), "skipped").when(F.col("s.ok"), "done").otherwise("failed").alias("outcome"))
