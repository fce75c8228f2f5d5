"""Hand-worked cases: null semantics of the transform operators, pipelines, pairing, reconciliation, quality, graphs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import dates, numbers, text
from lodestream.operators import anomaly, business, graph, intervals, quality, reconcile, similarity, transform
from lodestream.operators.derive import translate
from lodestream.operators.transform import execute
from lodestream.plans.pipeline import Pipeline


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- transform --------------------------------------------------------------------------------------------------------


def test_join_matches_null_keys_and_renames_clashes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    out = execute("join", a, {"left_key": "k", "right": "b", "join_type": "outer"}, {"b": b})
    assert out.columns == ["k", "v", "v_right"]
    assert rows(out) == sorted([(1, "x", "p"), (None, "y", "q"), (3, None, "r")], key=repr)
    with pytest.raises(ValueError):
        execute("join", a, {"left_key": "k"}, {})
    with pytest.raises(ValueError):
        execute("no_such", a)


@pytest.mark.parametrize(
    ("operator", "value", "kept"),
    [("equals", 1.0, [1]), ("not_equals", 1.0, [2, 3, 4]), ("greater_than", 1.0, [2]), ("less_equal", 1.0, [1]), ("is_null", None, [3, 4]), ("not_null", None, [1, 2]), ("in_list", [2.0, 9.0], [2]), ("in_list", 2.0, []), ("contains", "1", [1])],
)
def test_predicates_on_nulls(spark, operator, value, kept):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, float("nan"))], "id int, v double")
    out = execute("filter", df, {"conditions": [{"column": "v", "operator": operator, "value": value}]})
    assert sorted(r["id"] for r in out.collect()) == kept


def test_aggregate_drops_null_keys_and_sums_nothing_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5)], "k string, v int")
    out = execute("aggregate", df, {"group_by": ["k"], "aggregations": [{"column": "v", "function": "sum"}, {"column": "v", "function": "avg"}, {"column": "gone", "function": "sum"}]})
    assert rows(out) == [("a", 0, None)] and out.columns == ["k", "v_sum", "v_avg"]


def test_clean_sort_select_unpivot_union(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b"), (None, "c")], "k int, v string")
    assert rows(execute("clean", df, {"remove_duplicates": True, "fill_null_value": {"v": "?"}})) == sorted([(1, "?"), (2, "b"), (None, "c")], key=repr)
    down = execute("sort", df, {"sort_by": [{"column": "k", "ascending": False}]}).collect()
    assert [r["k"] for r in down] == [2, 1, 1, None]
    assert [r["k"] for r in execute("sort", df, {"sort_by": [{"column": "k"}]}).collect()] == [1, 1, 2, None]
    assert execute("select", df, {"columns": ["nothing"]}).columns == []
    assert rows(execute("unpivot", df.where("k = 2"), {"id_vars": []})) == [("k", "2"), ("v", "b")]
    other = spark.createDataFrame([(9, True)], "k int, w boolean")
    assert (9, None, True) in rows(execute("union", df, {"inputs": ["o", "absent"]}, {"o": other}))


def test_field_variances_and_their_severity(spark):
    kind = "e string, hours double, pay double"
    mine = spark.createDataFrame([("a", 160.0, 1000.0), ("b", 160.0, 1000.0), ("c", None, 0.0), ("d", 8.0, None), ("e", 1.0, 1.0)], kind)
    theirs = spark.createDataFrame([("a", 162.0, 1001.0), ("b", 170.0, 1200.0), ("c", 5.0, 50.0), ("d", None, None), ("z", 1.0, 1.0)], kind)
    out = reconcile.field_variances(mine, theirs, ["e"], {"hours": "hours", "pay": "currency"})
    assert rows(out) == [
        ("b", "hours", 160.0, 170.0, 10.0, 6.25, "warning"), ("b", "pay", 1000.0, 1200.0, 200.0, 20.0, "critical"), ("c", "hours", None, 5.0, None, None, "warning"),
        ("c", "pay", 0.0, 50.0, 50.0, 100.0, "critical"), ("d", "hours", 8.0, None, None, None, "info"),
    ]
    assert rows(reconcile.variance_counts(out)) == [("hours", 3, 0, 2, 1), ("pay", 2, 2, 0, 0)]


def test_units_by_any_name(spark):
    df = spark.createDataFrame([(32.0, "°F", "celsius"), (1.0, "Bar G", "kpa"), (760.0, "torr", "MMHG"), (1.0, "m3 / hr", "LPM"), (1.0, "kg/h", "m3/h"), (1.0, None, "m")], "v double, a string, b string")
    got = [r[0] for r in df.select(business.converted(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert [None if x is None else round(x, 6) for x in got] == [0.0, 100.0, 760.0, 16.666667, None, None]


def test_no_filter_can_fail(spark):
    df = spark.createDataFrame([(1, "a(b"), (None, None), (2**62, "(?P<x>a)")], "i long, s string")
    kept = lambda **c: execute("filter", df, {"conditions": [c]}).count()
    for pattern in ("(", "(?P<x>a)", "[", "*", "a{2,1}", "\\"):
        assert kept(column="s", operator="iregex", value=pattern) == 0
        assert business.matched_filters(df, [{"column": "s", "op": "regex", "value": pattern}]).count() == 0
    assert kept(column="s", operator="iregex", value="A\\(") == 1 and kept(column="i", operator="iregex", value="^1$") == 1
    for huge in (10**25, 10**45, 10**400):
        assert kept(column="i", operator="less_than", value=huge) == 2 and kept(column="i", operator="greater_than", value=-huge) == 2
        assert kept(column="i", operator="equals", value=huge) == 0 and kept(column="i", operator="in_list", value=[1, huge]) == 1


def test_pivot_fills_and_sample_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4)], "i string, c string, v int")
    assert rows(execute("pivot", df, {"index": ["i"], "columns": "c", "values": "v"})) == [("a", 1, 2), ("b", 3, 0)]
    many = spark.range(1000)
    a, b = (rows(execute("sample", many.repartition(n), {"sample_size": 37})) for n in (2, 5))
    assert a == b and len(a) == 37
    assert execute("sample", many, {"sample_fraction": 0.25}).count() == 250 and execute("sample", many, {}).count() == 100


def test_derived_expressions(spark):
    df = spark.createDataFrame([(4.0, 0.0, "q")], "a double, `b c` double, s string")
    out = execute("derive", df, {"new_columns": [{"name": "r", "expression": "a / `b c`", "data_type": "float"}, {"name": "n", "expression": "a ** 2 + 1", "data_type": "int"}, {"name": "t", "expression": "n > 3 and s == 'q'", "data_type": "bool"}, {"name": "w", "expression": "1 < a <= 4", "data_type": "none"}]})
    assert tuple(out.first())[3:] == (None, 17, True, True)
    for bad in ("a.__class__", "__import__('os')", "(select 1)", "gone + 1", "a if a else 1", "[a]"):
        with pytest.raises(ValueError):
            translate(bad, ["a"])


def test_pipeline_order_and_faults(spark):
    src = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    steps = [
        {"id": "two", "operation_type": "select", "config": {"columns": ["a"]}, "input_source": "one", "sequence_order": 1},
        {"id": "one", "operation_type": "filter", "config": {"conditions": [{"column": "a", "operator": "greater_than", "value": 1}]}, "input_source": "src", "sequence_order": 2},
    ]
    frames = Pipeline(steps).outputs({"src": src})
    assert rows(frames["two"]) == [(3,)] and Pipeline(steps[1:]).preview({"src": src}) == {"columns": ["a", "b"], "rows": [[3, 4]]}
    with pytest.raises(ValueError, match="circle"):
        Pipeline([{**steps[0], "input_source": "one"}, {**steps[1], "input_source": "two"}])
    with pytest.raises(ValueError, match="unknown"):
        Pipeline([{"id": "x", "operation_type": "nope"}])


# --- attendance -------------------------------------------------------------------------------------------------------

DAY = [
    ("a", [("IN", 9, 0), ("OUT", 12, 0), ("IN", 13, 0), ("OUT", 18, 0)], 8.0, 2, False),
    ("b", [("IN", 9, 0), ("IN", 9, 5), ("OUT", 12, 0)], 3.0, 1, False),
    ("c", [("OUT", 8, 0), ("IN", 9, 0), ("OUT", 10, 30)], 1.5, 1, False),
    ("d", [("IN", 9, 0), ("OUT", 12, 0), ("OUT", 12, 10)], 3.0, 1, False),
    ("e", [("IN", 9, 0), ("OUT", 12, 0), ("IN", 13, 0)], 3.0, 1, True),
]


def test_paired_hours(spark):
    events = [(p, k, dt.datetime(2024, 1, 8, h, m)) for p, punches, *_ in DAY for k, h, m in punches] + [("a", "BREAK", dt.datetime(2024, 1, 8, 10, 0))]
    df = spark.createDataFrame(events, "person string, kind string, t timestamp")
    out = {r["person"]: r for r in intervals.paired_hours(df, ["person"], "t", "kind").collect()}
    for p, _, hours, n, is_open in DAY:
        assert (out[p]["paired_hours"], out[p]["paired_segments"], out[p]["open_shift"]) == (hours, n, is_open), p
    capped = intervals.paired_hours(df.where("person = 'e'"), ["person"], "t", "kind", now=F.lit("2024-01-08 20:00:00").cast("timestamp"), open_cap_hours=4.0).first()
    assert capped["paired_hours"] == 7.0
    summary = {r["person"]: r for r in intervals.daily_summary(df, "person", "t", "kind").collect()}
    assert summary["a"]["is_full_day"] and not summary["a"]["is_late"] and summary["d"]["elapsed_hours"] == 3.17


def test_calendar_functions(spark):
    day = lambda s: F.lit(s).cast("date")
    out = spark.range(1).select(
        dates.weekdays(day("2024-01-05"), day("2024-01-08")).alias("a"), dates.weekdays(day("2024-01-06"), day("2024-01-07")).alias("b"), dates.weekdays(day("2024-01-09"), day("2024-01-08")).alias("c"), dates.weekdays_after(day("2024-01-05"), day("2024-01-08")).alias("d"),
        dates.clock(F.lit(34_259.9)).alias("e"), *[c.cast("string").alias(n) for c, n in zip(dates.period_bounds(day("2024-05-17"), "quarter"), "fg")],
    ).first()
    assert tuple(out) == (2, 0, 0, 1, "09:30", "2024-04-01", "2024-06-30")


# --- text and numbers -------------------------------------------------------------------------------------------------


def test_parsers_and_keys(spark):
    out = spark.range(1).select(
        text.parse_amount(F.lit("1.234,56")).alias("a"), text.parse_amount(F.lit("$1,234.56")).alias("b"), text.parse_amount(F.lit("1,234")).alias("c"), text.parse_size(F.lit('1 1/2"')).alias("d"), text.parse_size(F.lit("3/4")).alias("e"), text.parse_percent(F.lit(" 42.5% ")).alias("f"), text.parse_percent(F.lit("n/a")).alias("g"),
        text.code_key(F.lit(" ab1 "), 6).alias("h"), text.full_name(F.lit(" A "), F.lit(None).cast("string"), F.lit("x@y")).alias("i"), text.email_domain(F.lit("Me@Some.ORG")).alias("j"), text.levenshtein_ratio(F.lit(""), F.lit(None).cast("string")).alias("k"), text.text_similarity(F.lit("red bolt"), F.lit("red bolt m8")).alias("l"),
        text.matching_blocks_ratio(F.lit("abcd"), F.lit("bcde")).alias("m"), text.classify_prefix(F.lit("/process-data/x"), [("/process-data", "p"), ("/pro", "q")], "o").alias("n"),
    ).first()
    assert tuple(out) == (1234.56, 1234.56, 1234.0, 1.5, 0.75, 42.5, None, "000AB1", "A", "some.org", 1.0, 70.0, 0.75, "p")


def test_ratios_and_ladders(spark):
    out = spark.range(1).select(numbers.ratio(F.lit(1), F.lit(0)).alias("a"), numbers.ratio(F.lit(1), F.lit(0), empty=100.0).alias("b"), numbers.ladder(F.lit(80), [(80, "A"), (60, "B")], "D").alias("c"), numbers.ladder(F.lit(80), [(80, "A"), (60, "B")], "D", strict=True).alias("d"), numbers.log_mean_difference(F.lit(90.0), F.lit(60.0), F.lit(20.0), F.lit(40.0)).alias("e")).first()
    assert tuple(out) == (0.0, 100.0, "A", "B", 44.81)


# --- reconciliation, quality, anomalies, graphs -----------------------------------------------------------------------


def test_best_fuzzy_match_of_repeated_blank_and_missing_texts(spark):
    a = spark.createDataFrame([(1, "Pump A ", "x"), (2, "pump a", "x"), (3, None, "x"), (4, "pump a", "y"), (5, "valve", None), (6, "pump", "x")], "i int, n string, k string")
    b = spark.createDataFrame([(9, "pump b", "x"), (8, "PUMP B", "x"), (7, " ", "x"), (6, "pump abcdefgh", "y"), (5, "valve", None)], "j int, m string, l string")
    found = rows(similarity.best_matches(a, b, "i", "j", "n", "m", block=(F.col("k"), F.col("l"))))
    assert found == [(1, 8, 0.8333), (2, 8, 0.8333), (3, 7, 1.0)]


def test_greedy_pairs_and_fuzzy_dedup(spark):
    a = spark.createDataFrame([(1, "pump alpha"), (2, "pump alpho")], "id int, n string")
    b = spark.createDataFrame([(7, "pump alpha"), (8, "pump alphx")], "q int, m string")
    found = rows(similarity.greedy_pairs(a, b, "id", "q", "n", "m", (F.lit("k"), F.lit("k"))))
    assert [(i, j) for i, j, _ in found] == [(1, 7), (2, 8)]
    rich = spark.createDataFrame([(1, "centrifugal pump", 1), (2, "centrifugal pumps", 5), (3, "valve", 1), (4, "Valve", 0)], "id int, n string, r int")
    assert sorted(r["id"] for r in similarity.fuzzy_dedup(rich, "id", F.lower("n"), "n", F.lit(1), F.col("r")).collect()) == [2, 3]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "A1", 5, 9), (2, "bad", 50, 9), (3, None, None, 1), (4, " ", 7, 3)], "id int, code string, lo int, hi int")
    found = rows(quality.findings(df, "id", [quality.required("code"), quality.pattern("code", r"^\s*$|^[A-Z]\d$"), quality.ordered("lo", "hi")]))
    assert [(i, rule) for i, rule, *_ in found] == [(2, "order"), (2, "pattern"), (3, "required"), (4, "order"), (4, "required")]
    plan = quality.backfill_plan(spark.createDataFrame([("Steel",), ("steel",), ("Steel",), ("brass",), (None,)], "m string"), ["m"]).first()
    assert (plan["value"], plan["fillable_rows"]) == ("Steel", 1)


def test_anomalies_need_ten_points(spark):
    df = spark.createDataFrame([("a", i, 1.0 + i % 2) for i in range(20)] + [("a", 20, 90.0), ("b", 1, 5.0), ("b", 2, 500.0)], "k string, i int, v double")
    assert [(r["k"], r["i"]) for r in anomaly.statistical(df, ["k"], "v").where("is_anomaly").collect()] == [("a", 20)]


def test_graphs(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "id int")
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (2, 9)], "src int, dst int")
    assert rows(graph.isolated(v, e)) == [(5,)] and len(rows(graph.valid_edges(v, e))) == 5
    assert dict(rows(graph.layers(v, e))) == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: 0}
    assert [i for _, i in rows(graph.reachable(e, v.where("id = 3")))] == [3, 4]
    a = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i)) for i in range(3)], "id int, finish date")
    out = {r["id"]: (r["reach"].day, r["is_critical"]) for r in graph.total_float(a, e.where("dst < 3 and src < 3")).collect()}
    assert out == {0: (3, True), 1: (3, True), 2: (3, True)}


def test_richest_record_ladders_and_usage(spark):
    df = spark.createDataFrame([(1, " a1 ", 3, None, 5), (2, "A1", 3, 0.2, 9), (3, "A1", 3, 0.2, 2), (4, " ", 9, 1.0, 1), (5, None, 9, 1.0, 1)], "id int, code string, parts int, sure double, page int")
    got = business.keep_richest(df, F.trim("code"), ["parts", "sure"], "id", "page").select("key", "id", "first_page", "last_page", "merged")
    assert rows(got) == [("A1", 2, 2, 9, 3)]
    limits = spark.createDataFrame([(1, 1.0, None, 3.0), (2, 5.0, 4.0, 3.0)], "id int, ll double, l double, h double")
    assert [(i, c) for i, _, c, _ in rows(quality.findings(limits, "id", quality.rising("ll", "l", "h")))] == [(2, "l<=h"), (2, "ll<=l")]
    nested = spark.createDataFrame([(1, 0.0, 9.0, 1.0, 8.0), (2, 2.0, 3.0, 1.0, None)], "id int, a double, b double, c double, d double")
    assert [(i, rule) for i, rule, *_ in rows(quality.findings(nested, "id", quality.inside("a", "b", "c", "d")))] == [(1, "above"), (1, "below")]
    used = spark.createDataFrame([("x", 1, True), ("x", None, False), ("y", None, None)], "f string, u int, ok boolean")
    assert rows(business.feature_usage(used, ["f"], "u", F.col("ok"))) == [("x", 2, 1, 2.0, 50.0, "stable"), ("y", 1, 0, 0.0, 0.0, "stable")]


MIXED = "n bigint, x double, t string, b boolean, d date, w timestamp_ntz"
VALUES = [7, 7.0, "7", "abc", True, None, ["7", 7, None], "2024-05-01"]


def plain_predicate(name, cell, kind, value):
    """What a predicate means, in plain Python."""
    import datetime

    null = cell is None or (isinstance(cell, float) and math.isnan(cell))

    def fits(v):
        if isinstance(v, bool) or kind == "b":
            return isinstance(v, bool) and kind == "b"
        if isinstance(v, str) and kind in "dw":
            try:
                datetime.datetime.fromisoformat(v)
            except ValueError:
                return False
            return True
        return isinstance(v, str) if kind == "t" else isinstance(v, (int, float)) and kind in "nx"

    def same(v):
        if isinstance(v, str) and kind in "dw":
            at = datetime.datetime.fromisoformat(v)
            return at.date() if kind == "d" else at
        return v

    if name == "in_list":
        return not null and isinstance(value, list) and any(fits(v) and cell == same(v) for v in value)
    ok = not null and fits(value)
    if name in ("equals", "not_equals"):
        return (ok and cell == same(value)) == (name == "equals")
    tests = {"greater_than": lambda: cell > same(value), "greater_equal": lambda: cell >= same(value), "less_than": lambda: cell < same(value), "less_equal": lambda: cell <= same(value)}
    return ok and tests[name]()


@pytest.mark.parametrize("kind", "nxtbdw")
def test_comparisons_never_fail_and_are_false_for_other_types(spark, kind):
    import datetime

    day = datetime.date(2024, 5, 1)
    rows = [(7, 7.0, "7", True, day, datetime.datetime(2024, 5, 1)), (8, float("nan"), "abc", False, datetime.date(2023, 1, 1), datetime.datetime(2025, 1, 1, 3)), (None,) * 6]
    df = spark.createDataFrame(rows, MIXED)
    at = [c.split()[0] for c in MIXED.split(", ")].index(kind)
    names = ["equals", "not_equals", "greater_than", "greater_equal", "less_than", "less_equal", "in_list"]
    cases = [(n, v) for n in names for v in VALUES]
    columns = [transform.PREDICATES[n](F.col(kind), df.schema[kind].dataType, v).alias(f"c{i}") for i, (n, v) in enumerate(cases)]
    for row, found in zip(rows, df.select(*columns).collect()):
        for (name, value), got in zip(cases, found):
            assert got == plain_predicate(name, row[at], kind, value), (name, row[at], value)


def test_derive_casts_numbers_directly_and_text_by_parsing(spark):
    df = spark.createDataFrame([(7.9, "12.7", "x", 0), (-7.9, "5", "true", 3), (float("nan"), None, None, None)], "x double, t string, u string, n int")
    columns = [{"name": f"{c}_{k}", "expression": c, "data_type": k} for c in "xtun" for k in ("int", "float", "bool")]
    out = [r.asDict() for r in transform.execute("derive", df, {"new_columns": columns}).collect()]
    assert [r["x_int"] for r in out] == [7, -7, None] and [r["t_int"] for r in out] == [12, 5, None] and [r["u_float"] for r in out] == [None] * 3
    assert [r["n_bool"] for r in out] == [False, True, None] and [r["u_bool"] for r in out] == [None, True, None] and [r["n_float"] for r in out] == [0.0, 3.0, None]


def test_large_samples_are_exact_and_the_same_each_time(spark, monkeypatch):
    monkeypatch.setattr(transform, "TOP_ROWS", 10)
    df = spark.range(5000).withColumn("t", (F.col("id") % 7).cast("string")).repartition(5)
    for config in ({"sample_size": 1234}, {"sample_fraction": 0.2468}):
        one = sorted(r["id"] for r in transform.execute("sample", df, config).collect())
        again = sorted(r["id"] for r in transform.execute("sample", df.repartition(3), config).collect())
        assert one == again and len(one) == 1234 == len(set(one))
    assert transform.execute("sample", df, {"sample_size": 99_999}).count() == 5000


def test_places_among_all_and_scaling(spark):
    from lodestream.operators import analytics

    df = spark.createDataFrame([(i, float((i * 37) % 101), "ab"[i % 2]) for i in range(300)], "id int, v double, g string").repartition(4)
    placed = {r["id"]: r["place"] for r in analytics.placed(df, [F.desc("v"), F.col("id")], "place").collect()}
    order = sorted(range(300), key=lambda i: (-((i * 37) % 101), i))
    assert placed == {i: n + 1 for n, i in enumerate(order)}
    even = analytics.min_max(df.withColumn("same", F.lit(3)), {"s": F.col("v"), "e": F.col("same")}, ["g"], invert=["s"]).collect()
    assert {r["e"] for r in even} == {50.0} and min(r["s"] for r in even) == 0.0 and max(r["s"] for r in even) == 100.0 and len(even) == 300
