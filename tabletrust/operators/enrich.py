"""Opt-in derived columns; originals stay unless a function says so."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.functions.text import hinted, is_number, to_long

MONEY = r"[$€£]?\s*(\d[\d,]*\.?\d*)\s*(k|m|mm|b|bn|million|billion|thousand)?"
CLOSED = rf"(?i)^\s*{MONEY}\s*(?:-|–|to)\s*{MONEY}\b.*$"
OPEN_MIN = rf"(?i)^\s*{MONEY}\s*\+.*$"
OPEN_MAX = rf"(?i)^\s*(?:less than|under)\s+{MONEY}\b.*$"
OPEN_MIN_WORD = rf"(?i)^\s*{MONEY}\s*\+\s*(k|m|mm|b|bn|million|billion|thousand)\b.*$"
LABEL = r"^\d[\d,]*\+?\s*(to\s+\d[\d,]*\s*)?\s*[A-Za-z]+$"
# Fixed values.
SKILLS = ["python", "excel", "hadoop", "spark", "aws", "tableau", "big data"]
# Fixed values, as substrings of the lower-case title: "sr " and " i " with their blanks.
SENIOR = ["senior", "sr.", "sr ", "lead", "principal", "staff", "ii", "iii"]
JUNIOR = ["junior", "jr.", "jr ", "entry", "associate", " i ", "intern"]
TITLES = [("data scientist", "Data Scientist"), ("data engineer", "Data Engineer"), ("machine learning|ml engineer", "Machine Learning Engineer"), ("analyst", "Analyst"), ("manager|director|head", "Management"), ("engineer|developer", "Engineer")]

#: Distinct values of a column, and bounds of their share of its rows, for which its values are worth grouping.
LEAST, LOW, HIGH = 15, 0.03, 0.9


def is_range(c: Column) -> Column:
    return c.rlike(CLOSED) | c.rlike(OPEN_MIN) | c.rlike(OPEN_MAX)


def _share(long: DataFrame, condition: Column, limit: float) -> DataFrame:
    stats = long.where("value is not null").groupBy("table", "column").agg(F.count_if(condition).alias("matched"), F.count(F.lit(1)).alias("n"), F.min("value").alias("example"))
    return stats.withColumn("fraction", F.round(F.col("matched") / F.col("n"), 6)).where(F.col("fraction") >= limit)


def range_columns(long: DataFrame) -> DataFrame:
    return _share(long, is_range(F.col("value")), 0.8)


def label_columns(long: DataFrame) -> DataFrame:
    return _share(long, F.col("value").rlike(LABEL), 0.8)


def _scale(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w.isin("k", "thousand"), 1e3).when(w.isin("m", "mm", "million"), 1e6).when(w.isin("b", "bn", "billion"), 1e9).otherwise(1.0)


def decompose_range(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_min, _max, _avg in one unit. An open side is null, and so is the average; other texts give nulls.

    In a pair only one of whose sides has a scale on the right ("$1 to $2 billion"), it holds for both.
    """
    c = F.col(column)
    n = lambda p, i: F.replace(F.regexp_extract(c, p, i), F.lit(","), F.lit("")).try_cast("double")
    word = lambda p, i: F.regexp_extract(c, p, i)
    left_word = F.when(word(CLOSED, 2) == "", word(CLOSED, 4)).otherwise(word(CLOSED, 2))
    plus_word = F.when(word(OPEN_MIN, 2) != "", word(OPEN_MIN, 2)).otherwise(word(OPEN_MIN_WORD, 3))
    low = F.when(c.rlike(CLOSED), n(CLOSED, 1) * _scale(left_word)).when(c.rlike(OPEN_MIN), n(OPEN_MIN, 1) * _scale(plus_word))
    high = F.when(c.rlike(CLOSED), n(CLOSED, 3) * _scale(word(CLOSED, 4))).when(c.rlike(OPEN_MAX), n(OPEN_MAX, 1) * _scale(word(OPEN_MAX, 2)))
    return df.withColumns({f"{column}_min": low, f"{column}_max": high}).withColumn(f"{column}_avg", (F.col(f"{column}_min") + F.col(f"{column}_max")) / 2)


def simplify_label(c: Column) -> Column:
    """51 to 200 employees -> 51-200."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^(\d[\d,]*\+?)\s*to\s*(\d[\d,]*)\s+[A-Za-z]+$", "$1-$2"), r"^(\d[\d,]*\+?)\s+[A-Za-z]+$", "$1")


def simplify_labels(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """The table with short labels, and whether the result is sound: no two values merged, at most 20 % still long."""
    made = df.withColumn("_new", simplify_label(F.col(column)))
    r = made.agg(F.count_distinct(column).alias("a"), F.count_distinct("_new").alias("b"), F.avg(F.col("_new").rlike(LABEL).cast("int")).alias("long")).first()
    return made.withColumn(column, F.col("_new")).drop("_new"), r.a == r.b and (r.long or 0) <= 0.2


def _values(long: DataFrame) -> DataFrame:
    return long.groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("c"))


def _repeating(values: DataFrame, least: int, low: float, high: float) -> DataFrame:
    """table, column, distinct, rows, fraction of the text columns with many but repeating values. values: counts of all cells."""
    known, number = F.col("value").isNotNull(), is_number(F.col("value"))
    counts = {"distinct": F.count_if(known), "rows": F.sum("c"), "n": F.sum(F.when(known, F.col("c"))), "numeric": F.sum(F.when(number, F.col("c")).otherwise(0))}
    stats = values.groupBy("table", "column").agg(*(c.alias(k) for k, c in counts.items()))
    share = F.col("distinct") / F.col("rows")
    return stats.where((F.col("distinct") >= least) & share.between(low, high) & (F.col("numeric") < 0.8 * F.col("n"))).select("table", "column", "distinct", "rows", F.round(share, 6).alias("fraction"))


def cardinality_candidates(long: DataFrame, least: int = LEAST, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Text columns with many but repeating values, with ten sorted sample values. Only their own values are ranked."""
    values = _values(long)
    found = _repeating(values, least, low, high)
    own = values.where("value is not null").join(F.broadcast(found.select("table", "column")), ["table", "column"], "left_semi")  # at most one row a column
    first = F.row_number().over(Window.partitionBy("table", "column").orderBy("value"))
    samples = own.withColumn("_r", first).where("_r <= 10").groupBy("table", "column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return found.join(samples, ["table", "column"]).select("table", "column", "distinct", "rows", "fraction", "samples")


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Adds the group of each raw value; null where there is none. mapping: raw_value, group (a small table of distinct raw values)."""
    m = mapping.select(F.col("raw_value").alias("_raw"), F.col("group").alias(out))
    return df.join(m, F.col(column) == F.col("_raw"), "left").drop("_raw")


def unmapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    return df.select(F.col(column).alias("raw_value")).where("raw_value is not null").distinct().join(mapping, "raw_value", "left_anti")


def mapping_complete(df: DataFrame, column: str, mapping: DataFrame) -> bool:
    """Whether the mapping covers exactly the values that occur."""
    values = df.select(F.col(column).alias("raw_value")).where("raw_value is not null").distinct()
    return unmapped(df, column, mapping).isEmpty() and mapping.join(values, "raw_value", "left_anti").isEmpty()


def title_category(c: Column, rules: list[tuple[str, str]] = TITLES) -> Column:
    """First rule that a title matches; Other for none; null for null."""
    return F.when(c.isNotNull(), F.coalesce(*(F.when(F.lower(c).rlike(p), name) for p, name in rules), F.lit("Other")))


def age_from_year(c: Column, as_of_year: int, missing: int | None = None) -> Column:
    """Years since; missing and placeholder years become `missing`."""
    year = c.cast("string").try_cast("int")
    return F.when(year > 0, F.lit(as_of_year) - year).otherwise(F.lit(missing).cast("int"))


def same_state(a: Column, b: Column) -> Column:
    state = lambda c: F.nullif(F.regexp_extract(c, r", ([A-Z]{2})$", 1), F.lit(""))
    return state(a) == state(b)


def keyword_flags(c: Column, words: list[str] = SKILLS) -> dict[str, Column]:
    return {f"has_{w.replace(' ', '_')}": F.coalesce(F.lower(c).contains(w), F.lit(False)) for w in words}


def seniority(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return F.when(any_of(SENIOR), "Senior").when(any_of(JUNIOR), "Junior").otherwise("Not specified")


# Words in a column's name that tell what it holds.
TITLE_HINTS = ["job title", "title", "position", "role"]
FOUNDED_HINTS = ["founded", "founding year", "year founded"]
HEADQUARTERS_HINTS = ["headquarters", "hq"]
LOCATION_HINTS = ["location", "city"]
DESCRIPTION_HINTS = ["description", "summary", "responsibilities"]
TAGS = {"title": ["job", "role", "seniority"], "founded": ["age", "company"], "location": ["location", "state"], "description": ["skill"], "salary": ["salary", "pay"], "size": ["size", "employees"]}


def feature_candidates(df: DataFrame) -> list[tuple[str, list[str]]]:
    """(kind, columns) of the derivations whose columns are there, by their names, and whose values show the signal that the
    derivation needs, all read in one pass."""
    first = lambda words, without=(): next((c for c in hinted(df.columns, words) if c not in hinted(df.columns, list(without))), None)
    title, founded, text = first(TITLE_HINTS), first(FOUNDED_HINTS), first(DESCRIPTION_HINTS)
    state, home = first(LOCATION_HINTS, HEADQUARTERS_HINTS), first(HEADQUARTERS_HINTS)
    value = lambda c: F.lower(F.col(f"`{c}`").cast("string"))
    signals: list[tuple[str, list[str], Column]] = []
    if title:
        signals.append(("job_title_categorization", [title], value(title).isNotNull()))
    if founded:
        signals.append(("company_age", [founded], is_number(value(founded))))
    if state and home:
        signals.append(("same_state_flag", [state, home], F.lit(True)))
    if text:
        signals.append(("skill_keywords", [text], reduce(lambda a, b: a | b, [value(text).contains(w) for w in SKILLS])))
    if title:
        signals.append(("seniority_flag", [title], reduce(lambda a, b: a | b, [value(title).contains(w) for w in SENIOR + JUNIOR])))
    if not signals:
        return []
    shown = df.agg(*(F.coalesce(F.bool_or(s), F.lit(k == "same_state_flag")).alias(k) for k, _, s in signals)).first()
    return [(k, columns) for k, columns, _ in signals if shown[k]]


def candidate_id(table: str, kind: str, columns: list[str]) -> str:
    return sha256("|".join([table, kind, *sorted(columns)]).encode()).hexdigest()[:16]


def candidates(df: DataFrame, table: str) -> DataFrame:
    """id, table, kind, columns, tags of everything that could be derived from a table."""
    long = to_long(df, table)
    # At most one row a column. Only names are read: the least text, as an example, would take a sort of all cells.
    names = lambda made: [r["column"] for r in made.select("column").collect()]
    found = [("range_decomposition", [c]) for c in names(range_columns(long))]
    found += [("label_simplification", [c]) for c in names(label_columns(long))]
    found += [("categorical_consolidation", [c]) for c in names(_repeating(_values(long), LEAST, LOW, HIGH))]
    found += feature_candidates(df)
    rows = [(candidate_id(table, k, cs), table, k, cs, sorted({t for c in cs for w, ts in TAGS.items() if w in c.lower() for t in ts})) for k, cs in found]
    return df.sparkSession.createDataFrame(rows, "id string, table string, kind string, columns array<string>, tags array<string>")


def surfaced(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates that a question names by a column or a tag. questions: question (few)."""
    q = F.lower(F.col("question"))
    plain = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    hit = F.exists("columns", lambda c: q.contains(plain(c)) | plain(c).contains(q)) | F.exists("tags", lambda t: q.contains(t))
    return candidates.join(F.broadcast(questions), hit)


def undecided(candidates: DataFrame, decisions: DataFrame, statuses: DataFrame) -> DataFrame:
    """Candidates without a decision, of tables whose status isn't fail and whose source is known."""
    sound = statuses.where("status <> 'fail' and source_folder is not null").select(F.col("table_name").alias("table"))
    return candidates.join(sound, "table", "left_semi").join(decisions.select(F.col("candidate_id").alias("id")), "id", "left_anti")


def shape_ok(before: list[str], after: list[str], expected: list[str]) -> bool:
    """Exactly the expected columns are new, and none is gone."""
    return set(before) <= set(after) and set(after) - set(before) == set(expected)


def next_version(mappings: DataFrame, base: str) -> int:
    r = mappings.where(F.col("base_name") == base).agg(F.max("version").alias("v")).first()
    return (r.v or 0) + 1


def latest_mapping(mappings: DataFrame, base: str) -> DataFrame:
    own = mappings.where(F.col("base_name") == base)
    return own.join(own.agg(F.max("version").alias("version")), "version", "left_semi")


def mapping_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """raw_value, old_group, new_group, change (added, removed, changed); equal ones are left out."""
    a, b = old.select("raw_value", F.col("group").alias("old_group"), F.lit(True).alias("_a")), new.select("raw_value", F.col("group").alias("new_group"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_group").eqNullSafe(F.col("new_group")), "changed")
    return a.join(b, "raw_value", "full_outer").withColumn("change", change).where("change is not null").select("raw_value", "old_group", "new_group", "change")
