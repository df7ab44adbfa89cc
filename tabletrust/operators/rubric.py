"""The quality rubric on column values: one pass over melted cells, equal ones counted first, for all count-type checks of all columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.functions import hints
from tabletrust.functions.text import date_format, has_hint, hinted, is_number, number, strip, timestamp, to_long


def _sum(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def is_list(value: Column, delimiter: str) -> Column:
    """Two or more parts of 1 to 30 word characters, blanks or hyphens."""
    parts = F.split(value, f"[{delimiter}]")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: F.trim(p).rlike(r"^[\w \-]{1,30}$"))


#: Characters beyond which a cell is counted by a hash of its text.
LONG = 64

#: Yes-or-no facts of a value, each a bit of `flags`.
FLAGS = [
    "numeric", "dates", "padded", "noisy_prose", "negative", "odd_years", "currency", "units", "locale_us", "locale_eu", "float_noise", "formulas", "sheet_errors", "control",
    *(f"lists_{i}" for i in range(len(hints.DELIMITERS))), "with_time",
]


#: Tokens that a value may show, each a bit of `marks`.
MARKS = [("format", f) for f in hints.DATE_FORMATS] + [("placeholder", t) for t in hints.PLACEHOLDERS] + [("boolean", t) for t in hints.TRUE_TOKENS + hints.FALSE_TOKENS] + [("symbol", t) for t in "$€£¥"]


def _mark(kind: str, token: Column) -> Column:
    """The bit of a token of one kind; 0 for none."""
    first, names = next(i for i, m in enumerate(MARKS) if m[0] == kind), [t for k, t in MARKS if k == kind]
    at = F.array_position(F.array(*map(F.lit, names)), token).cast("int")
    return F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at + (first - 1))).otherwise(F.lit(0).cast("long"))


def _marked(kind: str) -> Column:
    """Whether a value shows a token of one kind."""
    return F.col("marks").bitwiseAND(F.lit(sum(1 << i for i, m in enumerate(MARKS) if m[0] == kind))) != 0


def _tokens(kind: str) -> Column:
    """The tokens of one kind that `marks` holds, sorted."""
    return F.array_compact(F.array(*(F.when(F.col("marks").bitwiseAND(F.lit(1 << i)) != 0, t) for t, i in sorted((t, i) for i, (k, t) in enumerate(MARKS) if k == kind))))


def _facts(df: DataFrame, value: str, as_of_year: int) -> DataFrame:
    """Adds what the checks need to know of a text: folded (hash of the trimmed lower case), marks (tokens that it shows), flags.
    Values of digits alone, as most keys are, are numbers without any other fact; no pattern is tried on them."""
    v, bare, low, ts, num = (F.col(c) for c in (value, "_bare", "_low", "_ts", "_num"))
    tokens = hints.TRUE_TOKENS + hints.FALSE_TOKENS
    conditions = [
        num.isNotNull(), ts.isNotNull(), v != bare, v.rlike(hints.BULLETS) | v.contains("\n"), num < 0, (F.year(ts) < 1900) | (F.year(ts) > as_of_year + 1), v.rlike(hints.CURRENCY), F.lower(v).rlike(hints.UNIT),
        bare.rlike(hints.LOCALE_US), bare.rlike(hints.LOCALE_EU), num.isNotNull() & bare.rlike(hints.FLOAT_NOISE), v.rlike(hints.FORMULA), bare.isin(hints.SHEET_ERRORS), v.rlike(hints.CONTROL),
        *(is_list(v, d) for d in hints.DELIMITERS), ts.isNotNull() & v.rlike(hints.TIME_OF_DAY),
    ]
    digits = F.coalesce(v.rlike(r"^[0-9]+\z"), F.lit(False))
    flags = reduce(Column.bitwiseOR, [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(conditions)])
    dated = F.when(bare.rlike(r"^\d{1,4}[-/]\d{1,2}[-/]\d"), bare)
    numeric = F.when(bare.rlike(hints.NUMBER), bare.try_cast("double"))
    read = df.withColumn("_bare", F.when(digits, v).otherwise(strip(v))).withColumns({"_low": F.lower("_bare"), "_ts": timestamp(dated), "_num": numeric})
    symbol = F.when(v.rlike(hints.CURRENCY), F.regexp_extract(v, "([$€£¥])", 1))
    plain, other = [_mark("placeholder", low), _mark("boolean", F.when(low.isin(tokens), low))], [_mark("format", date_format(dated)), _mark("symbol", symbol)]
    marks = reduce(Column.bitwiseOR, plain).bitwiseOR(F.when(digits, F.lit(0).cast("long")).otherwise(reduce(Column.bitwiseOR, other)))
    return read.withColumns({
        "folded": F.when(v.isNotNull(), F.xxhash64("_low")), "marks": F.when(v.isNotNull(), marks), "flags": F.when(digits, F.lit(1).cast("long")).when(v.isNotNull(), flags),
    }).drop("_bare", "_low", "_ts", "_num")


def distinct_cells(long: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Each distinct cell of a column with its number of rows (c), length, and facts.

    Cells of up to LONG characters are counted by their text and looked at once each. Longer ones never travel: their facts are read
    where they lie, and they are counted by two 64-bit hashes, so a column of prose shuffles a few numbers a cell.
    """
    size = F.length("value")
    told = long.select("table", "column", F.when(size <= LONG, F.col("value")).alias("short"), F.when(size > LONG, F.col("value")).alias("long"), size.alias("length"))
    made = ["folded", "marks", "flags"]
    marks = [F.when(F.col("long").isNotNull(), F.xxhash64(F.lit(i), "long")).alias(f"h{i}") for i in (1, 2)]
    read = _facts(told, "long", as_of_year).select("table", "column", "short", "length", *marks, *(F.col(c).alias(f"long_{c}") for c in made))
    cells = read.groupBy(*read.columns).agg(F.count(F.lit(1)).alias("c"))
    both = {c: F.coalesce(f"long_{c}", c) if c == "folded" else F.coalesce(f"long_{c}", c, F.lit(0).cast("long")) for c in made}
    return _facts(cells, "short", as_of_year).withColumns(both).select("table", "column", "c", "length", *made)


def cell_stats(long: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Counts per table and column; every count-type check reads only these."""
    c, known = F.col("c"), F.col("length").isNotNull()
    times = lambda condition: F.coalesce(F.sum(F.when(condition, c)), F.lit(0))
    cells = distinct_cells(long, as_of_year)
    counted = cells.groupBy("table", "column").agg(
        F.sum("c").alias("rows"), times(known).alias("n"), (F.sum(F.col("length") * c) / times(known)).alias("mean_length"), F.count("length").alias("distinct"), F.bit_or("marks").alias("marks"),
        times(_marked("placeholder")).alias("placeholders"), times(_marked("boolean")).alias("booleans"),
        *(times(F.col("flags").bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(FLAGS)),
    )
    # Spellings are counted on their own: beside the sums above, every one of them would carry all sums through a shuffle.
    spellings = cells.groupBy("table", "column", "folded").agg(F.sum("c").alias("c")).groupBy("table", "column").agg(F.count("folded").alias("distinct_normal"))
    named = {"formats": "format", "placeholder_tokens": "placeholder", "boolean_tokens": "boolean", "symbols": "symbol"}
    return counted.withColumns({name: _tokens(kind) for name, kind in named.items()}).drop("marks").join(F.broadcast(spellings), ["table", "column"])  # a row a column


Check = tuple[str, Column, Column, Column, dict[str, Column]]


def count_checks() -> list[Check]:
    """Category, condition, cells affected, cells in all, and details of the checks that cell_stats suffices for."""
    c = F.col
    n, name, share = c("n"), c("column"), lambda x: F.col(x) / F.greatest(F.col("n"), F.lit(1))
    lists = [c(f"lists_{i}") for i in range(len(hints.DELIMITERS))]
    kinds, listed = reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in lists]), reduce(lambda a, b: a + b, lists)
    families = reduce(lambda a, b: a + b, [F.arrays_overlap("boolean_tokens", F.array(*map(F.lit, f))).cast("int") for f in hints.BOOLEAN_FAMILIES])
    date_like = has_hint(name, hints.DATE_HINTS)
    return [
        ("missing", (c("rows") - n) / c("rows") > hints.MISSING_LIMIT, c("rows") - n, c("rows"), {}),
        ("numeric_as_text", (share("numeric") >= hints.NUMERIC_AS_TEXT) & (c("numeric") < n), n - c("numeric"), n, {}),
        ("mixed_date_formats", (share("dates") >= hints.DATE_SHARE) & (F.size("formats") > 1), c("dates"), n, {"formats": F.array_join("formats", ", ")}),
        ("whitespace_noise", c("padded") > 0, c("padded"), n, {}),
        ("prose_noise", (c("mean_length") > hints.PROSE_LENGTH) & (c("noisy_prose") > 0), c("noisy_prose"), n, {}),
        ("negative_values", has_hint(name, hints.NUMERIC_HINTS) & (c("negative") > 0), c("negative"), n, {}),
        ("out_of_range_dates", date_like & (c("odd_years") > 0), c("odd_years"), n, {}),
        ("placeholder_tokens", (c("placeholders") > 0) & (share("placeholders") < hints.PLACEHOLDER_LIMIT), c("placeholders"), n, {"tokens": F.array_join("placeholder_tokens", ", ")}),
        ("boolean_families", (c("booleans") == n) & (n > 0) & F.size("boolean_tokens").between(2, 4) & (families > 1), n, n, {"tokens": F.array_join("boolean_tokens", ", ")}),
        ("currency_units", c("currency") + c("units") > 0, c("currency") + c("units"), n, {"symbols": F.array_join("symbols", "")}),
        ("locale_mix", (c("locale_us") > 0) & (c("locale_eu") > 0), c("locale_us") + c("locale_eu"), n, {}),
        ("float_noise", c("float_noise") > 0, c("float_noise"), n, {}),
        ("spreadsheet_formula", c("formulas") > 0, c("formulas"), n, {}),
        ("spreadsheet_error", c("sheet_errors") > 0, c("sheet_errors"), n, {}),
        ("control_characters", c("control") > 0, c("control"), n, {}),
        ("delimiter_mix", kinds > 1, listed, n, {}),
        ("granularity_mix", date_like & (c("dates") >= 2) & (c("with_time") > 0) & (c("with_time") < c("dates")), c("with_time"), c("dates"), {}),
        ("duplicate_keys", has_hint(name, hints.ID_HINTS) & (n > c("distinct")), n - c("distinct"), n, {}),
        ("categorical_variants", (c("distinct") > c("distinct_normal")) & (c("distinct_normal") / c("rows") <= hints.CATEGORY_RATIO), c("distinct") - c("distinct_normal"), c("distinct"), {}),
    ]


def _issue_struct(category: str, affected: Column, total: Column, detail: dict[str, Column]) -> Column:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(category).alias("category"), F.lit(hints.SEVERITY[category]).alias("severity"), affected.cast("long").alias("affected"), total.cast("long").alias("total"), F.when(total > 0, F.round(affected / total, 6)).alias("fraction"), made.alias("detail"))


def _rows(found: DataFrame) -> DataFrame:
    return found.select("table", "_i.category", "_i.severity", "column", "_i.affected", "_i.total", "_i.fraction", "_i.detail")


def _issue(stats: DataFrame, category: str, when: Column, affected: Column, total: Column, detail: dict[str, Column] | None = None) -> DataFrame:
    return _rows(stats.where(when).withColumn("_i", _issue_struct(category, affected, total, detail or {})))


def count_issues(stats: DataFrame) -> DataFrame:
    """All count-type issues, as one projection of cell_stats."""
    found = F.array_compact(F.array(*(F.when(when, _issue_struct(category, affected, total, detail)) for category, when, affected, total, detail in count_checks())))
    return _rows(stats.select("table", "column", F.explode(found).alias("_i")))


def lost_leading_zeros(long: DataFrame) -> DataFrame:
    """In columns named like postal codes, digit strings one shorter than the most frequent length (the smallest of equals)."""
    digits = long.where(has_hint(F.col("column"), hints.ZIP_HINTS)).withColumn("v", strip(F.col("value"))).where("v rlike '^[0-9]+$'")
    lengths = digits.groupBy("table", "column", F.length("v").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    mode = lengths.groupBy("table", "column").agg(F.max_by("len", F.struct("c", -F.col("len"))).alias("mode"), F.sum("c").alias("n"))
    short = mode.join(lengths, ["table", "column"]).where("len = mode - 1")
    return _issue(short, "lost_leading_zeros", F.col("c") > 0, F.col("c"), F.col("n"), {"length": F.col("mode")})


def duplicate_rows(df: DataFrame, table: str = "t", ignore: list[str] = ()) -> DataFrame:
    """Rows beyond the first of each group of equal rows; row-index columns are ignored. Nulls are equal.

    Rows are told apart by two 64-bit hashes of all their values, so no text is a grouping key, however long it is.
    """
    # Nulls leave a hash as it is, so a mark says which values are null.
    cols = [x for c in df.columns if c not in ignore for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    marked = df.select(F.xxhash64(F.lit(1), *cols).alias("_h1"), F.xxhash64(F.lit(2), *cols).alias("_h2"))
    groups = marked.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c")).agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    return _issue(groups.select(F.lit(table).alias("table"), F.lit(None).cast("string").alias("column"), "extra", "n"), "duplicate_rows", F.col("extra") > 0, F.col("extra"), F.col("n"))


def dangling_refs(df: DataFrame, table: str = "t", parent: str = "id") -> DataFrame:
    """Non-null values of columns ending in id that the table's id column doesn't hold."""
    refs = [c for c in df.columns if c.lower().endswith("id") and c != parent]
    if parent not in df.columns or not refs:
        return _issue(to_long(df.limit(0), table).withColumns({"a": F.lit(0), "n": F.lit(0)}), "dangling_refs", F.lit(False), F.col("a"), F.col("n"))
    child = to_long(df, table, refs).where("value is not null").groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("c"))
    known = df.select(F.col(parent).cast("string").alias("value")).where("value is not null").distinct().withColumn("known", F.lit(1))
    found = child.join(known, "value", "left").groupBy("table", "column").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("c"))), F.lit(0)).alias("a"))
    return _issue(found, "dangling_refs", F.col("a") > 0, F.col("a"), F.col("n"))


def sequential_ids(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """column, n, covered (share of 0..n-1 or 1..n that occurs), monotonic (strictly, in file order), sequential.

    order: the line number. Ranges of lines are read side by side and their ends compared, without a global sort.
    """
    long = to_long(df, "t", columns, [order]).withColumn("v", number(F.col("value")))
    whole = long.groupBy("column").agg(F.count("value").alias("n"), _sum(F.col("v").isNotNull()).alias("numeric"))
    width = F.greatest(F.lit(1), F.col("n"))
    marked = long.where("v is not null").join(F.broadcast(whole), "column")
    spread = marked.groupBy("column").agg(
        F.count_distinct(F.when(F.col("v").between(0, F.col("n") - 1) & (F.col("v") == F.floor("v")), F.col("v"))).alias("from0"),
        F.count_distinct(F.when(F.col("v").between(1, F.col("n")) & (F.col("v") == F.floor("v")), F.col("v"))).alias("from1"),
    )

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = {}
        for frame in frames:
            for column, part in frame.groupby("column"):
                part = part.sort_values("_at")
                diff = part["v"].diff().dropna()
                row = [part["_at"].iloc[0], part["v"].iloc[0], part["v"].iloc[-1], bool((diff > 0).all()), bool((diff < 0).all())]
                seen.setdefault(column, []).append(row)
        rows = []
        for column, parts in seen.items():
            parts.sort(key=lambda r: r[0])
            up = all(r[3] for r in parts) and all(a[2] < b[1] for a, b in zip(parts, parts[1:], strict=False))
            down = all(r[4] for r in parts) and all(a[2] > b[1] for a, b in zip(parts, parts[1:], strict=False))
            rows.append((column, parts[0][0], parts[0][1], parts[-1][2], up, down))
        yield pd.DataFrame(rows, columns=["column", "at", "first", "last", "up", "down"])

    ranged = marked.select("column", F.col(order).cast("long").alias("_at"), "v").repartitionByRange("_at").sortWithinPartitions("_at")
    parts = ranged.mapInPandas(ends, "column string, at long, first double, last double, up boolean, down boolean")
    by = Window.partitionBy("column").orderBy("at")  # over one row per range
    joined = parts.withColumns({"before": F.lag("last").over(by)}).groupBy("column").agg(
        F.every(F.col("up") & F.coalesce(F.col("before") < F.col("first"), F.lit(True))).alias("up"), F.every(F.col("down") & F.coalesce(F.col("before") > F.col("first"), F.lit(True))).alias("down"))
    out = whole.join(spread, "column", "left").join(joined, "column", "left")
    covered = F.coalesce(F.greatest("from0", "from1") / width, F.lit(0.0))
    monotonic = F.coalesce(F.col("up") | F.col("down"), F.lit(False))
    return out.select("column", "n", F.round(covered, 6).alias("covered"), monotonic.alias("monotonic"), ((F.col("numeric") == F.col("n")) & (F.col("n") > 0) & (monotonic | (covered >= 0.9))).alias("sequential"))


def row_index_columns(df: DataFrame, order: str) -> list[str]:
    """Columns named like a row index whose values are sequential."""
    named = [c for c in df.columns if c.lower() in hints.ROW_INDEX_NAMES or c.lower().startswith("unnamed:")]
    return [r["column"] for r in sequential_ids(df, named, order).where("sequential").collect()] if named else []


def value_types(long: DataFrame, share: float = 0.8) -> DataFrame:
    """numeric if that share of a column's non-blank values are numbers, else text."""
    stats = long.groupBy("table", "column").agg(_sum(strip(F.col("value")) != "").alias("n"), _sum(is_number(F.col("value"))).alias("numeric"))
    return stats.select("table", "column", F.when((F.col("n") > 0) & (F.col("numeric") / F.col("n") >= share), "numeric").otherwise("text").alias("value_type"))


def issues(df: DataFrame, table: str = "t", as_of_year: int = 2026, ignore: list[str] = (), lines: DataFrame | None = None) -> DataFrame:
    """Every issue of a table's values, as rows of hints.ISSUES, and of its file's lines, if given (lines.line_issues).

    One pass counts all cells; postal columns, equal rows and references have a pass of their own where a table has them.
    """
    columns = [c for c in df.columns if c not in ignore]
    found = [count_issues(cell_stats(to_long(df, table, columns), as_of_year)), duplicate_rows(df, table, list(ignore))]
    if postal := hinted(columns, hints.ZIP_HINTS):
        found.append(lost_leading_zeros(to_long(df, table, postal)))
    if "id" in columns and any(c.lower().endswith("id") and c != "id" for c in columns):
        found.append(dangling_refs(df.select(*columns), table))
    if lines is not None:
        blank = F.create_map().cast("map<string,string>")
        found.append(lines.select(F.lit(table).alias("table"), "category", "severity", "column", "affected", "total", F.when(F.col("total") > 0, F.round(F.col("affected") / F.col("total"), 6)).alias("fraction"), blank.alias("detail")))
    return reduce(DataFrame.unionByName, found)


def with_severity(found: DataFrame) -> DataFrame:
    """Severity by category; unknown categories only warn."""
    table = F.create_map(*(F.lit(x) for pair in hints.SEVERITY.items() for x in pair))
    return found.withColumn("severity", F.coalesce(F.try_element_at(table, F.col("category")), F.lit(hints.WARN)))


def failing_columns(found: DataFrame) -> DataFrame:
    return found.where((F.col("severity") == hints.FAIL) & F.col("column").isNotNull()).select("table", "column").distinct()
