"""Flawed and clean pairs, treatments that are stable, files, publishing, and statistics."""

import csv
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletrust.functions.text import sanitized, to_long
from tabletrust.operators import discover, enrich, lines, plans, profile, rubric, status, treat
from tabletrust.plans import charts, clauses, logs, ranks, shapes, stats
from tabletrust.sources import files, folders, publish, store

PAIRS = {
    "placeholder_tokens": ("status", ["9999", "TBD", "a", "b", "c", "d", "e", "f", "g", "h"], ["a", "b", "c"]),
    "boolean_families": ("is_active", ["Y", "N", "1", "0", "Y"], ["Y", "N", "Y"]),
    "lost_leading_zeros": ("zip_code", ["02134", "2134", "10001", "94103", "60601"], ["02134", "10001"]),
    "currency_units": ("price", ["$50.00", "45.00", "1.00"], ["50.00", "45.00"]),
    "locale_mix": ("amount", ["1,234.56", "1.234,56"], ["1,234.56", "2,345.67"]),
    "float_noise": ("value", ["19.989999999999998", "5.5"], ["19.99", "5.5"]),
    "control_characters": ("name", ["a\x00b", "c"], ["ab", "c"]),
    "spreadsheet_formula": ("f", ["=SUM(A1:A2)", "x"], ["x", "y"]),
    "spreadsheet_error": ("f", ["#DIV/0!", "x"], ["x", "y"]),
    "delimiter_mix": ("tags", ["a,b", "a;b", "a|b"], ["a,b", "c,d"]),
    "granularity_mix": ("event_date", ["2021-01-01", "2021-01-02", "2021-01-03 10:30"], ["2021-01-01", "2021-01-02"]),
    "whitespace_noise": ("notes", [" a", "b"], ["a", "b"]),
    "negative_values": ("amount", ["-15", "3"], ["999999", "3"]),
    "out_of_range_dates": ("start_date", ["1850-01-01", "2020-01-01"], ["2019-01-01", "2020-01-01"]),
    "duplicate_keys": ("order_id", ["1", "1", "2"], ["1", "2", "3"]),
    "categorical_variants": ("city", ["NYC", "nyc", "NYC", "LA", "la", "LA"], ["NYC", "NYC", "LA", "LA"]),
    "numeric_as_text": ("v", ["1", "2", "3", "4", "x"], ["1", "2", "3", "4", "5"]),
    "missing": ("v", ["1", None, "3"], ["1", "2", "3"]),
    "mixed_date_formats": ("d", ["2021-01-01", "02/03/2021"], ["2021-01-01", "2021-02-03"]),
}


@pytest.mark.parametrize("category", PAIRS)
def test_flawed_and_clean(spark, category):
    column, flawed, clean = PAIRS[category]
    for values, fires in ((flawed, True), (clean, False)):
        df = spark.createDataFrame([(v,) for v in values], f"{column} string")
        assert (rubric.issues(df).where(F.col("category") == category).count() > 0) is fires


@pytest.mark.parametrize("category", sorted(set(treat.COLUMN_TREATMENTS) & set(PAIRS) - {"boolean_families", "numeric_as_text"}))
def test_treatment_clears_the_issue_and_is_stable(spark, category):
    column, flawed, _ = PAIRS[category]
    df = spark.createDataFrame([(v,) for v in flawed], f"{column} string")
    once = treat.apply_plan(df, [(category, column)])
    assert rubric.issues(once).where(F.col("category") == category).count() == 0
    if dict(once.dtypes)[column] == "string":
        assert treat.apply_plan(once, [(category, column)]).collect() == once.collect()


def test_order_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(PAIRS["placeholder_tokens"][1])], "id string, status string")
    plain = lambda d: sorted(map(str, rubric.issues(d).drop("detail").collect()))
    assert plain(df) == plain(df.repartition(7).orderBy(F.desc("id")).select("status", "id"))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, amount string")
    assert rubric.issues(empty).count() == 0
    assert treat.clean(empty, "t")[0].count() == 0
    assert enrich.candidates(empty, "t").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2\n3,z,extra\n4,N/A\n')
    rows = files.read_csv_audit(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "x, y"), ("2", None), ("4", None)]
    assert sanitized(["A b", "a_b", "1x", ""]) == ["a_b", "a_b_2", "_1x", "col"]
    (tmp_path / "n.csv").write_text("Id,Share\n1,0.5\n2,\n")
    assert files.load_csv(spark, str(tmp_path / "n.csv")).dtypes == [("id", "bigint"), ("share", "double")]


def test_encodings_and_quoted_line_ends(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,Müller\n2,Ñandú\n".encode("latin-1"))
    assert [r.name for r in files.read_csv_audit(spark, str(tmp_path / "latin.csv")).orderBy("id").collect()] == ["Müller", "Ñandú"]
    (tmp_path / "lines.csv").write_text('id,name\n1,"two\nlines, ""quoted"""\n2,b\n')
    assert files.has_quoted_line_ends(spark, str(tmp_path / "lines.csv")) and not files.has_quoted_line_ends(spark, str(tmp_path / "latin.csv"))
    assert [r.name for r in files.read_csv_audit(spark, str(tmp_path / "lines.csv")).orderBy("id").collect()] == ['two\nlines, "quoted"', "b"]


def test_line_checks(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b'\xef\xbb\xbfid, Name ,na#me\n1,"x,y\n2,b,c\n' + b"id, Name ,na#me\n" + b"\xff,b,c\n3,b\n,,\n")
    got = lines.line_issues(spark, str(tmp_path / "bad.csv"))
    assert {r.category for r in got.collect()} == {"encoding", "unmatched_quote", "repeated_header", "ragged_rows", "trailing_empty", "header_issues", "header_special"}
    assert lines.bom(spark, str(tmp_path / "bad.csv")).count() == 1


def test_line_checks_do_not_depend_on_splits(spark, tmp_path):
    """Small splits, with quoted line ends over their borders and a quote that never closes, against a scan of the whole file."""
    r = random.Random(4)
    rows = ["id,name,note"]
    for k in range(400):
        rows.append(r.choice([f"{k},a,b", f'{k},"x, y",b', f'{k},"two\nlines","a ""b"""', f'{k},"{"many\n" * r.randrange(9)}",z', f"{k},a", f'{k},a"b,c', "id,name,note", "", f"{k},a,b,c"]))
    rows += [f'{9000},"never closed,b', "1,2,3", "1,2", "4,5,6,7", ",,", " "]
    (tmp_path / "split.csv").write_text("\n".join(rows) + "\n")
    want = Counter({"repeated_header": rows[1:].count("id,name,note"), "trailing_empty": 2, "encoding": 0})
    for row in rows[1:-6]:
        fields = next(csv.reader([row])) if "\n" not in row else [0, 0, 0]
        if row.count('"') % 2:
            want["unmatched_quote"] += 1
        elif row and len(fields) != 3:
            want["ragged_rows"] += 1
    want["unmatched_quote"] += 1
    want["ragged_rows"] += 2
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for part in ("128m", "700", "97"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        try:
            raw = lines.raw_lines(spark, str(tmp_path))
            assert part == "128m" or raw.select("start").distinct().count() >= 8
            got = {x.category: x.affected for x in lines.line_issues(spark, str(tmp_path)).collect()}
            numbered = sorted((x.line_no, bytes(x.value)) for x in lines.read_lines(spark, str(tmp_path)).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert numbered == list(enumerate("\n".join(rows).encode().split(b"\n")))


def test_quantiles_equal_sorting(spark):
    r = random.Random(6)
    rows = [(g, v) for g in (None, "a", "b", "c") for v in [r.choice([None, 1.5, r.gauss(0, 9), float(r.randrange(5))]) for _ in range({None: 30, "a": 700, "b": 1, "c": 2}[g])]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], shares) for g in (None, "a", "b", "c") if any(h == g and v is not None for h, v in rows)}
    got = {x.g: x.q for x in ranks.quantiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    assert ranks.quantiles(df, [], "v", [0.5]).first().q == [np.quantile([v for _, v in rows if v is not None], 0.5)]
    assert ranks.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_clean_makes_up_nothing_and_tells_what_it_makes(spark):
    rows = [(k, None if k % 9 == 0 else str(k % 40), None if k % 10 == 0 else str(k % 7), f"${k}" if k % 4 == 0 else str(k), "TBD" if k % 8 == 0 else "ok", "x") for k in range(200)] + [(200, "1", "1", "1", "ok", "x")] * 1
    made = treat.clean(spark.createDataFrame(rows, "line long, customer_id string, grade string, amount string, state string, index string"), "t")
    got = {r.line: r for r in made.table.collect()}
    assert got[9].customer_id is None and "Unknown" not in {v for r in got.values() for v in r}
    assert got[0].grade == "3" and got[4].amount == 4.0 and got[8].state is None
    new = {(r.category, r["column"]) for r in made.introduced.collect()}
    assert new == {("missing", "state")} and made.log.first().issues_introduced == ["missing:state"]
    assert not {(r.category, r["column"]) for r in made.introduced.collect()} & {(r.category, r["column"]) for r in made.issues.collect()}


def test_sql_scan():
    names = clauses.scan("WITH a AS (SELECT 1), \"b c\"(x) AS MATERIALIZED (SELECT 2) SELECT (SELECT max(y) FROM t ORDER BY z LIMIT 1) AS m FROM a")[1]
    assert names == ["a", "b c"]
    got = clauses.shape("select a as b, f(x) as c /* as d, */, 'it''s, from' || g as e from t where x in (select y from u group by y, h(y, 1)) group by all order by c; select 1+1 as c")
    assert [c["alias"] for c in got["computed"]] == ["c"] and got["grouping"] == [["y", "h(y, 1)"], ["all"]] and got["rankings"] == [{"order_by": "c", "limit": None}]
    for odd in (None, "", ")))((", "select", "'open", "with as (", "order by"):
        assert clauses.shape(odd)["computed"] == []


def test_store_pointer_and_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    store.publish(spark.range(100).selectExpr("id AS k", "1 AS v"), root, ["k"], 8)
    state = store._pointer(spark, root, 0)["now"]
    assert store.change(spark, root, upserts=spark.createDataFrame([(5, 2)], "k long, v int")) == 1
    now = store._pointer(spark, root, 1)["now"]
    assert len({b for b in now["at"] if now["at"][b] != state["at"][b]}) == 1  # a change of one row writes one bucket
    got = {r.k: r.v for r in store.read(spark, root).collect()}
    assert len(got) == 100 and got[5] == 2 and sum(got.values()) == 101
    assert store.read(spark, root, "before").where("v = 2").isEmpty()
    assert store.change(spark, root, deletes=spark.createDataFrame([(5,), (6,)], "k long")) in (1, 2) and store.read(spark, root).count() == 98
    assert store.rollback(spark, root) and store.read(spark, root).count() == 100
    assert store.rollback(spark, root) and store.read(spark, root).count() == 98
    with pytest.raises(RuntimeError, match="another writer"):
        store._point(spark, root, 0, now, None)
    with pytest.raises(Exception):
        store.publish(spark.range(3).select((F.lit(1) / F.raise_error(F.lit("broken"))).alias("k")), root)
    assert store.read(spark, root).count() == 98  # a failed build changes nothing


def test_plans_are_replayed_checked_and_dropped(spark, tmp_path):
    root = f"file://{tmp_path}/plans"
    kind = "line long, state string, tags string, price string"
    rows = [(k, "TBD" if k % 9 == 0 else "ok", ["a,b", "a;b", "a|b"][k % 3], f"${k}" if k % 4 == 0 else str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, kind)
    assert plans.replay(spark, root, df, "t").used == []
    plans.remember(spark, root, plans.plans_of(df, rubric.issues(df, "t"), "t"))
    plans.remember(spark, root, plans.plans_of(df, rubric.issues(df, "t"), "t").withColumn("table", F.lit("other")))
    kept = store.read(spark, root).where("table = 't'").count()
    fresh = spark.createDataFrame([(k, "TBD", "x;y", "$7") if k == 3 else r for k, r in enumerate(rows)], kind)
    made = plans.replay(spark, root, fresh, "t")
    row = made.table.where("line = 3").first()
    assert row.state is None and row.tags == "x,y" and row.price == 7.0 and len(made.used) == kept and made.dropped == []
    made = plans.replay(spark, root, fresh.drop("tags"), "t")  # a plan without its column goes
    assert len(made.dropped) == 1 and store.read(spark, root).where("table = 't'").count() == kept - 1
    plans.forget(spark, root, "t")
    assert store.read(spark, root).select("table").distinct().collect() == [("other",)]


def test_publish_and_rollback(spark):
    publish.publish(spark.range(3), "pub_t")
    publish.publish(spark.range(5), "pub_t")
    assert spark.table("pub_t").count() == 5 and publish.rollback(spark, "pub_t")
    assert spark.table("pub_t").count() == 3 and publish.rollback(spark, "pub_t") and spark.table("pub_t").count() == 5
    assert publish.capped(spark.range(201))[1] and not publish.capped(spark.range(200))[1]
    assert not publish.rollback(spark, "nothing_here")
    spark.sql("ALTER TABLE pub_t RENAME TO pub_t_gone")  # a swap broke off: there is a previous table only
    assert publish.repair(spark, "pub_t") and spark.table("pub_t").count() == 3 and not publish.repair(spark, "pub_t")
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "table_name string")
    assert publish.invalidate(rows, "a").count() == 2


def test_statistics(spark):
    assert abs(stats.f_tail(3, 2, 147) - 0.0528450) < 1e-6
    groups = spark.createDataFrame([("a", 4.5, 0.2, 50), ("b", 3.0, 0.2, 50), ("c", 3.8, 0.2, 50)], "g string, m double, s double, n long")
    assert stats.anova_p(groups, "m", "s", "n")[1] < 1e-9
    close = spark.createDataFrame([("a", 3.51, 2.5, 20), ("b", 3.49, 2.5, 20)], "g string, m double, s double, n long")
    assert stats.anova_p(close, "m", "s", "n")[1] > 0.9
    assert stats.anova_p(close.limit(1), "m", "s", "n") is None
    assert stats.mean_columns(["avg_price", "n"]) == ["avg_price"] and stats.count_columns(["avg_price", "n", "sample_size", "num_rows", "rows"]) == ["n", "sample_size", "num_rows"]


def test_charts(spark):
    many = spark.createDataFrame([(str(i), i) for i in range(8)], "c string, v long")
    assert charts.validate_shape(many, "pie")[0] == "bar" and charts.validate_shape(many, "histogram")[0] == "bar"
    assert charts.fallback_columns(many) == ("c", "v") and charts.pie(many, "c", "v").count() == 5


def test_profile_and_mappings(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, None)], "id int, rating double")
    r = profile.numeric_profile(df, ["rating"]).first()
    assert (r.avg, r.null_rate, r.distinct) == (25.0, 0.2, 4)
    m = spark.createDataFrame([("a", "x")], "raw_value string, group string")
    t = spark.createDataFrame([("a",), ("b",)], "v string")
    assert not enrich.mapping_complete(t, "v", m) and enrich.mapping_complete(t.where("v = 'a'"), "v", m)
    assert enrich.shape_ok(["a"], ["a", "b"], ["b"]) and not enrich.shape_ok(["a"], ["b"], ["b"])
    pairs = discover.column_pairs(spark.createDataFrame([("1", "1"), ("2", "2")], "city string, city_name string"))
    assert pairs.first()["values"] == 1.0


def test_treatment_rules(spark):
    low = spark.createDataFrame([(float(i),) if i % 7 else (None,) for i in range(1, 21)], "v double")
    assert treat.fill_median(low, "v").where("v is null").count() == 0
    high = spark.createDataFrame([(1.0,), (None,), (None,)], "v double")
    assert treat.fill_median(high, "v").where("v is null").count() == 2
    assert treat.row_check(10, 9, True) == "changed" and treat.row_check(10, 5, False) == "lost_rows" and treat.row_check(10, 10, True) == "kept"
    head = spark.createDataFrame([("id", "n"), ("1", "x"), (None, None)], "id string, n string")
    assert treat.repair_header(head).count() == 1


def test_median_and_mode(spark):
    import statistics

    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 4.0, 4.0, 2.0, None], [float(i * 7 % 101) for i in range(300)]):
        known = [v for v in values if v is not None]
        assert treat.median(spark.createDataFrame([(v,) for v in values], "v double"), "v") == statistics.median(known)
    assert treat.median(spark.createDataFrame([(None,)], "v double"), "v") is None
    tied = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [(None,)], "v string")
    assert treat.fill_mode_or_unknown(tied, "v").groupBy("v").count().where("v = 'b'").first()["count"] == 6


def test_clean_fills_pads_splits_and_logs(spark):
    rows = [(i, None if i == 3 else float(i), None if i == 4 else "gold", "2134" if i == 5 else "02134", "Austin, TX") for i in range(15)]
    made = treat.clean(spark.createDataFrame(rows, "line long, points double, tier string, zip string, place string"), "t", composites={"place": ("^(.*), ([A-Z]{2})$", ("city", "state"))})
    assert made.table.where("points is null or tier is null or zip <> '02134' or city <> 'Austin' or state <> 'TX'").count() == 0
    log = made.log.first()
    assert (log.row_count_before, log.row_count_after, log.row_check) == (15, 15, "kept") and "lost_leading_zeros:zip" in log.issues_resolved


def test_features_need_a_signal(spark):
    plain = spark.createDataFrame([("Baker", "long ago", "we bake")], "job_title string, founded string, description string")
    assert [k for k, _ in enrich.feature_candidates(plain)] == ["job_title_categorization"]
    full = spark.createDataFrame([("Sr Baker", "1990", "python", "Austin, TX", "Salem, MA")], "role string, year_founded string, summary string, city string, hq string")
    assert dict(enrich.feature_candidates(full)) == {"job_title_categorization": ["role"], "company_age": ["year_founded"], "same_state_flag": ["city", "hq"], "skill_keywords": ["summary"], "seniority_flag": ["role"]}


def test_status_and_logs(spark):
    assert status.parse_metric("define metric ltv as sum(x) -- value") == ("ltv", "sum(x)", "value") and status.parse_metric("hello") is None
    got = status.apply_metric(spark.range(4).withColumn("g", F.col("id") % 2), ["g"], "total", "sum(id)")
    assert {(r.g, r.total) for r in got.collect()} == {(0, 2), (1, 4)}
    log = spark.createDataFrame([("top", "SELECT a, avg(b) AS m, round(x, 2) AS r FROM t GROUP BY a")], "question string, sql string")
    assert logs.min_sample_violations(log).count() == 1
    assert {r.alias for r in logs.computed_columns(log, "question").collect()} == {"m", "r"}
    assert shapes.rank_groups(spark.range(3).withColumn("g", F.lit("a")), ["g"], {"v": "id"}).count() == 0


def test_long_form(spark):
    assert to_long(spark.createDataFrame([(1, "a")], "x int, `y z` string")).count() == 2


def test_long_cells_are_counted_by_hash(spark, monkeypatch):
    texts = [None, "", "x", "  x ", "X", "TBD", "$5", "1,234.56", "2021-03-05", "2021-03-05 10:30", "1850-01-01", "-3", "=SUM(A1)", "y", "0", "a,b", "a;b", "19.989999999999998", "5 kg", "\x01"]
    texts += [(t or "") + " " * 80 for t in texts] + ["word • " * 40, "Word • " * 40, "word • " * 40, "long\nline " * 30]
    df = spark.createDataFrame([(t, t) for t in texts * 2], "v string, start_date string")
    ours = rubric.cell_stats(rubric.to_long(df)).orderBy("column").collect()
    for limit in (0, 3, 10_000):
        monkeypatch.setattr(rubric, "LONG", limit)
        assert rubric.cell_stats(rubric.to_long(df)).orderBy("column").collect() == ours
    first = ours[1].asDict()
    known = [t for t in texts if t is not None]
    assert first["distinct"] == len(set(known)) and first["distinct_normal"] == len({t.strip().lower() for t in known})
    assert first["rows"] == 2 * len(texts) and first["n"] == 2 * len(known) and first["placeholders"] == 4 and first["noisy_prose"] == 8 and first["negative"] == 4


def test_equal_rows_by_hash_keep_nulls_apart(spark):
    rows = [(None, "a"), ("a", None), (None, None), (None, None), ("a", ""), ("", "a"), ("t" * 9000, "b"), ("t" * 9000, "b"), ("t" * 9000, "c")]
    r = rubric.duplicate_rows(spark.createDataFrame(rows, "x string, y string")).first()
    assert (r.affected, r.total) == (2, 9)
    assert rubric.duplicate_rows(spark.createDataFrame([], "x string")).count() == 0


def test_column_pairs_by_signatures(spark):
    df = spark.range(30_000).selectExpr("id", "id % 10 AS few", "id + 10000 AS shifted", "concat('k', id) AS other", "id * 3 AS third", "CAST(NULL AS STRING) AS none", "if(id % 3 = 0, NULL, id) AS `holes in`")
    want = {}
    values = {c: {str(r[0]) for r in df.select(f"`{c}`").distinct().collect() if r[0] is not None} for c in df.columns}
    for (a, b), n in discover.name_similarity(df.columns).items():
        least = min(len(values[a]), len(values[b]))
        want[tuple(sorted((a, b)))] = round(n + (len(values[a] & values[b]) / least if least else 0.0), 6)
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]
    for sample in (64, 4096, 1 << 20):
        assert [((r.a, r.b), r.score) for r in discover.column_pairs(df, 10, sample).collect()] == best
    low, sizes, whole = discover.signatures(df, df.columns, 1000)
    assert whole == {1} and set(sizes) == {0, 1, 2, 3, 4, 6} and 800 < low.where("column = 0").count() < 1200
    assert discover.column_pairs(df.limit(0)).count() == 10 and discover.column_pairs(df.select("id")).count() == 0


def test_folder_of_many_shapes(spark, tmp_path):
    place = tmp_path / "in put" / "deep"
    place.mkdir(parents=True)
    for i in range(40):
        (place / f"a{i}.csv").write_text(f'id,name\n{i},"x, {i}"\n')
    (place / "quoted.txt").write_text('id,name\n90,"two\nlines"\n91,"a ""b"""\n')
    (place / "latin.csv").write_bytes("id,name\n92,Zoë\n".encode("latin-1"))
    (place / "bom.csv").write_bytes("\ufeffid,name\n93,é\n".encode())
    (place / "other.csv").write_text("_path,v,v\n1,2,3\n")
    (place / "one.dat").write_text('{"k": 1, "l": [1, 2]}\n{"k": 2, "l": []}\nbroken\n')
    (place / "list.json").write_text('[\n {"k": 3},\n {"k": 4}\n]')
    (place / "p.html").write_text("<html><table><tr><td>a</td></tr></table><table><tr><td>b</td><td>c</td></tr></table>")
    big = b"id,name\n" + b'7,"' + b"y" * (folders.CHUNK * 2) + b'"\n'
    (place / "big.csv").write_bytes(big)
    (place / "x.bin").write_bytes(b"PK\0\1")
    (place / "empty.csv").write_text("")
    (place / "bad.json").write_text("[1, 2")
    (place / "_hidden.csv").write_text("a\n")
    listed = publish.stored(folders.manifest(spark, str(tmp_path / "in put")), "manifest")
    rows = {r.path.rsplit("/", 1)[1]: r for r in listed.collect()}
    assert len(rows) == 50 and {n for n, r in rows.items() if r.error} == {"x.bin", "bad.json"}
    assert rows["big.csv"].checksum == hashlib.sha256(big).hexdigest() and rows["big.csv"].bytes == len(big)
    assert rows["quoted.txt"].quoted_ends and not rows["big.csv"].quoted_ends and not rows["a3.csv"].quoted_ends
    assert rows["latin.csv"].encoding == "ISO-8859-1" and rows["bom.csv"].encoding == "UTF-8"
    found, errors = folders.tables(listed)
    assert sorted(n.split("_")[0] for n in found) == ["csv", "csv", "html", "json", "jsonl"] and errors.count() == 2
    kinds = {n: df for n, df in found.items()}
    people = next(df for df in kinds.values() if df.columns[:2] == ["id", "name"])
    got = {(int(r.id), r["name"]) for r in people.collect()}
    assert got == {(i, f"x, {i}") for i in range(40)} | {(90, "two\nlines"), (91, 'a "b"'), (92, "Zoë"), (93, "é"), (7, "y" * (folders.CHUNK * 2))}
    assert people.where("endswith(_path, 'a3.csv')").count() == 1
    assert sorted(r.k for n, df in kinds.items() if n.startswith("json") for r in df.select("k").collect()) == [1, 2, 3, 4]
    assert next(df for n, df in kinds.items() if n.startswith("html")).first().cells == ["b", "c"]
    done = folders.convert(found, str(tmp_path / "out"))
    assert all(done.values()) and not any(folders.convert(found, str(tmp_path / "out")).values())
    name = next(n for n, df in found.items() if df is people)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out" / name))
    assert {(int(r.id), r["name"]) for r in back.collect()} == got
    assert {len(r.checksum) for r in folders.checksums(spark, str(place)).collect()} == {64}


def test_key_counts_follow_changes(spark, tmp_path):
    root, make = str(tmp_path / "keys"), lambda xs: spark.createDataFrame([(x,) for x in xs], "a_id string")
    rows = ["1", "1", "2", None, "3"]
    store.publish(profile.key_counts({"t": make(rows)}), root, profile.KEY, 16)
    assert profile.add_counts(root, profile.key_counts({"t": make(["9"])})) == 1
    profile.add_counts(root, removed=profile.key_counts({"t": make(["1", "3"])}))
    tables = {"t": make(["never read"]), "u": make(["5", "5"]), "none": spark.range(1).toDF("x")}
    got = {r["table"]: (r.total, r["distinct"], r.role, r.source) for r in profile.fanout_kept(root, tables).collect()}
    assert got == {"t": (3, 3, "likely_pk", "stored"), "u": (2, 1, "likely_fk", "live")}


def test_amounts_that_look_like_placeholders_stay(spark):
    rows = [(i, "$50" if i % 5 == 0 else "9999" if i == 7 else "tbd" if i == 8 else str(100 + i), "9999" if i == 3 else "ok") for i in range(40)]
    df = spark.createDataFrame(rows, "n int, amount string, status string")
    made = {r.n: (r.amount, r.status) for r in treat.clean(df, "t").table.collect()}
    assert made[7] == (9999.0, "ok") and made[8][0] is None and made[3] == (103.0, None)
    plan = [("currency_units", "amount"), ("placeholder_tokens", "amount")]
    for order in (plan, plan[::-1]):
        assert float(treat.apply_plan(df, order).where("n = 7").first().amount) == 9999.0


def test_cell_stats_carry_no_sets(spark):
    df = spark.createDataFrame([("2021-01-02", "$5"), ("01/02/2021", "TBD"), ("9999", "Y"), ("2021-01-02T10:30:05", "1")], "a string, b string")
    made = rubric.cell_stats(to_long(df))
    assert "ObjectHashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    r = {x["column"]: x for x in made.collect()}
    assert r["a"].formats == ["MM/dd/yyyy", "yyyy-MM-dd"] and r["a"].placeholder_tokens == ["9999"] and r["a"].dates == 3 and r["a"].distinct_normal == 4
    assert r["b"].symbols == ["$"] and r["b"].boolean_tokens == ["1", "y"] and r["b"].placeholder_tokens == ["tbd"]


def test_marks_of_files_too_large_to_read_whole(spark, tmp_path):
    for name, head in (("a", b"\xef\xbb\xbfid,x\n"), ("b", b"id,x\n"), ("c", b"")):
        (tmp_path / f"{name}.csv").write_bytes(head)
    with open(tmp_path / "a.csv", "r+b") as f:
        f.truncate((1 << 31) + 10)  # a sparse file
    assert [r.table.rsplit("/", 1)[1] for r in lines.bom(spark, str(tmp_path)).collect()] == ["a.csv"]


def test_marks_in_stores_that_only_spark_reads(spark, tmp_path):
    """Files of any size and packed ones, where Arrow has no file system."""
    mark = b"\xef\xbb\xbf"
    for name, head in (("large.csv", mark + b"id,x\n"), ("plain.csv", b"id,x\n" + mark), ("a b.csv", mark), ("short.csv", mark[:2]), ("empty.csv", b""), ("gz.csv.gz", gzip.compress(mark + b"id\n")), ("plain.csv.gz", gzip.compress(b"id\n")), ("zip.csv.deflate", zlib.compress(mark + b"id\n")), ("plain.csv.deflate", zlib.compress(b"id\n"))):
        (tmp_path / name).write_bytes(head)
    with open(tmp_path / "large.csv", "r+b") as f:
        f.truncate((1 << 31) + 10)  # a sparse file
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.marks.link./in", f"file://{tmp_path}")
    for place in ("viewfs://marks/in", str(tmp_path)):
        assert sorted(r.table.rsplit("/", 1)[1] for r in lines.bom(spark, place).collect()) == ["a b.csv", "gz.csv.gz", "large.csv", "zip.csv.deflate"]


def test_candidates_are_found_without_sorting_cells(spark, monkeypatch):
    rows = [(i, "1 to 5" if i % 5 else None, f"{i % 3} to 9 employees", f"v{i % 20}" if i % 7 else None, None, str(i % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, pay string, size string, kind string, none string, digits string")
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    made = enrich.candidates(df, "t")
    assert len(plans) == 3 and not any("Sort" in p for p in plans)
    assert {(r.kind, *r.columns) for r in made.collect()} == {("range_decomposition", "pay"), ("range_decomposition", "size"), ("label_simplification", "size"), ("categorical_consolidation", "kind")}
    found = enrich.cardinality_candidates(to_long(df, "t")).collect()
    values = sorted({r[3] for r in rows if r[3]})
    assert [tuple(r) for r in found] == [("t", "kind", len(values), 200, round(len(values) / 200, 6), values[:10])]
    assert {r.column: (r.matched, r.n, r.example) for r in enrich.label_columns(to_long(df, "t")).collect()} == {"size": (200, 200, "0 to 9 employees")}
