"""The library's queries over the test tables, each beside SQL that gives the same rows.

``events`` stands for request logs and punches (``click`` in, ``purchase`` out), ``orders`` and ``lineitem`` for deals and
invoices, the others for dimensions and catalogues. "Now" is the parameter ``NOW``, never the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import dates, numbers, text
from lodestream.operators import analytics, anomaly, business, graph, intervals, quality, reconcile, scoring, similarity, vectors
from lodestream.operators.transform import execute
from lodestream.plans.pipeline import Pipeline
from lodestream.sources import readers, sinks
from lodestream.sources.readers import table
from lodestream.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-01-25 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def r(c, n: int = 4):
    return F.round(c, n)


# --- transform operators ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def t_join_inner(s, d):
    out = execute("join", table(s, d, "orders"), {"left_key": "o_custkey", "right_key": "c_custkey", "right": "c"}, {"c": table(s, d, "customer")})
    return out.select("o_orderkey", "o_totalprice", "c_custkey", "c_name")


@query("""SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey""")
def t_join_left(s, d):
    rich = table(s, d, "supplier").where("s_acctbal > 5000")
    return execute("join", table(s, d, "nation"), {"left_key": "n_nationkey", "right_key": "s_nationkey", "right": "s", "join_type": "left"}, {"s": rich}).select("n_nationkey", "n_name", "s_suppkey")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS n, b.n AS n_right FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def t_join_outer(s, d):
    side = lambda kept: table(s, d, "orders").where(kept).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return execute("join", side("o_orderstatus = 'P'"), {"left_key": "o_custkey", "right": "b", "join_type": "outer"}, {"b": side("o_totalprice > 400000")})


@query("""SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'bolt') AND p_size >= 5 AND p_size < 45 AND p_brand <> 'Brand#1' AND p_type IN ('ECONOMY', 'SMALL')""")
def t_filter_and(s, d):
    conditions = [
        {"column": "p_name", "operator": "contains", "value": "RED"}, {"column": "p_name", "operator": "not_contains", "value": "bolt"},
        {"column": "p_size", "operator": "greater_equal", "value": 5}, {"column": "p_size", "operator": "less_than", "value": 45},
        {"column": "p_brand", "operator": "not_equals", "value": "Brand#1"}, {"column": "p_type", "operator": "in_list", "value": ["ECONOMY", "SMALL"]},
        {"column": "no_such", "operator": "equals", "value": 1}, {"column": "p_size", "operator": "no_such", "value": 1},
    ]
    return execute("filter", table(s, d, "part"), {"conditions": conditions}).select("p_partkey", "p_name", "p_brand", "p_size")


@query("""SELECT p_partkey, p_name, p_size FROM part
WHERE starts_with(lower(p_name), 'blue') OR ends_with(lower(p_name), 'gear') OR p_size = 7 OR p_size > 48 OR p_retailprice <= 905 OR p_name IS NULL""")
def t_filter_or(s, d):
    conditions = [
        {"column": "p_name", "operator": "starts_with", "value": "Blue"}, {"column": "p_name", "operator": "ends_with", "value": "GEAR"},
        {"column": "p_size", "operator": "equals", "value": 7}, {"column": "p_size", "operator": "greater_than", "value": 48},
        {"column": "p_retailprice", "operator": "less_equal", "value": 905}, {"column": "p_name", "operator": "is_null"},
    ]
    return execute("filter", table(s, d, "part"), {"conditions": conditions, "logic": "or"}).select("p_partkey", "p_name", "p_size")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_q, round(avg(l_extendedprice), 4) AS avg_p, count(l_orderkey) AS n, min(l_discount) AS lo, max(l_discount) AS hi,
round(median(l_quantity), 4) AS med, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS v, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""")
def t_aggregate(s, d):
    spec = [("l_quantity", "sum", "sum_q"), ("l_extendedprice", "avg", "avg_p"), ("l_orderkey", "count", "n"), ("l_discount", "min", "lo"), ("l_discount", "max", "hi"), ("l_quantity", "median", "med"), ("l_quantity", "std", "sd"), ("l_quantity", "var", "v"), ("l_suppkey", "nunique", "suppliers")]
    out = execute("aggregate", table(s, d, "lineitem"), {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": [dict(zip(("column", "function", "output_name"), x)) for x in spec]})
    return out.withColumns({c: r(F.col(c)) for c in ("sum_q", "avg_p", "med", "sd", "v")})


@query("SELECT DISTINCT c_nationkey, coalesce(nullif(c_mktsegment, ''), 'none') AS c_mktsegment FROM customer")
def t_clean(s, d):
    df = table(s, d, "customer").select("c_nationkey", F.nullif("c_mktsegment", F.lit("")).alias("c_mktsegment"))
    return execute("clean", df, {"remove_duplicates": True, "drop_null_rows": True, "null_columns": ["c_nationkey"], "fill_null_value": {"c_mktsegment": "none"}})


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(trunc(l_quantity * 2) AS BIGINT) AS twice, (l_discount > 0.05 AND NOT l_tax = 0) AS flagged FROM lineitem""")
def t_derive(s, d):
    columns = [
        {"name": "net", "expression": "l_extendedprice * (1 - l_discount)", "data_type": "float"},
        {"name": "twice", "expression": "`l_quantity` * 2", "data_type": "int"},
        {"name": "flagged", "expression": "l_discount > 0.05 and not l_tax == 0", "data_type": "bool"},
    ]
    return execute("derive", table(s, d, "lineitem"), {"new_columns": columns}).select("l_orderkey", "l_linenumber", r(F.col("net")).alias("net"), "twice", "flagged")


@query("""SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS "F", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS "O",
round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS "P" FROM orders GROUP BY 1""")
def t_pivot(s, d):
    out = execute("pivot", table(s, d, "orders"), {"index": ["o_orderpriority"], "columns": "o_orderstatus", "values": "o_totalprice", "pivot_values": ["F", "O", "P"]})
    return out.withColumns({c: r(F.col(c), 2) for c in "FOP"})


@query("""SELECT s_suppkey, 'nation' AS variable, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT s_suppkey, 'name', s_name FROM supplier""")
def t_unpivot(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return execute("unpivot", df, {"id_vars": ["s_suppkey"]})


@query("""SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""")
def t_union_rename_select(s, d):
    c = execute("rename", table(s, d, "customer"), {"column_mapping": {"c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment", "nothing": "x"}})
    c = execute("select", c, {"columns": ["nation", "balance", "segment", "nothing"]})
    p = table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return execute("union", c, {"inputs": ["p", "absent"]}, {"p": p})


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def t_sort(s, d):
    df = execute("sort", table(s, d, "customer"), {"sort_by": [{"column": "c_acctbal", "ascending": False}, {"column": "c_custkey"}]})
    return df.select("c_custkey", "c_acctbal")


SAMPLE_KEY = "md5('42|' || o_orderkey || '|' || o_custkey || '|' || o_orderstatus)"


@query(f"SELECT o_orderkey FROM orders ORDER BY {SAMPLE_KEY} LIMIT 500")
def t_sample(s, d):
    return execute("sample", table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), {"sample_size": 500}).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {SAMPLE_KEY}) AS n, count(*) OVER () AS c FROM orders) WHERE n <= round(c * 0.3)")
def t_sample_fraction(s, d):
    return execute("sample", table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), {"sample_fraction": 0.3}).select("o_orderkey")


@query("""SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC""")
def t_pipeline(s, d):
    steps = [
        {"id": "open", "operation_type": "filter", "input_source": "orders", "sequence_order": 1, "config": {"conditions": [{"column": "o_orderstatus", "operator": "not_equals", "value": "P"}, {"column": "o_totalprice", "operator": "greater_than", "value": 1000}]}},
        {"id": "named", "operation_type": "join", "input_source": "open", "sequence_order": 2, "config": {"left_key": "o_custkey", "right_key": "c_custkey", "right_input": "customer"}},
        {"id": "summed", "operation_type": "aggregate", "sequence_order": 3, "config": {"group_by": ["c_mktsegment"], "aggregations": [{"column": "o_orderkey", "function": "count", "output_name": "orders"}, {"column": "o_totalprice", "function": "sum", "output_name": "total"}]}},
        {"id": "sorted", "operation_type": "sort", "sequence_order": 4, "config": {"sort_by": [{"column": "total", "ascending": False}]}},
    ]
    return Pipeline(steps).run({"orders": table(s, d, "orders"), "customer": table(s, d, "customer")}).withColumn("total", r(F.col("total"), 2))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(ts AS DATE) AS bucket, count(*) AS requests, count(DISTINCT user_id) AS users, (sum(CAST(round(value * 100) AS BIGINT)) * 200 + count(value)) // (2 * count(value)) / 10000 AS mean_value, count(*) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1""")
def usage_trend(s, d):
    # Values have two decimals: as decimals their mean rounds alike whatever the order of the rows.
    return analytics.bucketed(table(s, d, "events"), "ts", "day", {"requests": F.count("*"), "users": F.count_distinct("user_id"), "mean_value": r(F.avg(F.col("value").cast("decimal(12,2)"))).cast("double"), "good": F.count_if(F.col("event_type") != "error")})


def _period(period: str, start: str, label: str) -> None:
    def run(s, d):
        return analytics.bucketed(table(s, d, "events"), "ts", period, {"n": F.count("*"), "total": r(F.sum("value"), 2)}, "label")

    run.__name__ = f"usage_by_{period}"
    query(f"SELECT {start} AS bucket, count(*) AS n, round(sum(value), 2) AS total, {label} AS label FROM (SELECT *, {start} AS b FROM events) GROUP BY bucket, label")(run)


_period("hour", "date_trunc('hour', ts)", "strftime(b, '%d %b %H:%M')")
_period("week", "CAST(date_trunc('week', ts) AS DATE)", "'W/C ' || strftime(b, '%d %b %Y')")
_period("month", "CAST(date_trunc('month', ts) AS DATE)", "strftime(b, '%b %Y')")
_period("quarter", "CAST(date_trunc('quarter', ts) AS DATE)", "'Q' || quarter(b) || ' ' || year(b)")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) FILTER (value > 50) AS big_users, round(avg(value) FILTER (value < 50), 4) AS low_mean, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1""")
def filtered_distinct(s, d):
    out = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users"), r(F.avg(F.when(F.col("value") < 50, F.col("value")))).alias("low_mean"))
    return out.withColumn("pct", r(numbers.ratio(F.col("n"), F.sum("n").over(W.partitionBy()), 100.0), 2))


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM (SELECT o_orderpriority, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct FROM c) WHERE o_orderpriority <> '5-LOW'""")
def share_of_total(s, d):
    return analytics.share_of_total(table(s, d, "orders"), ["o_orderpriority"], F.col("o_orderpriority") == "5-LOW")


@query("""WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT day, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (day)""")
def gap_filled(s, d):
    counted = table(s, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return analytics.gap_filled(counted, "day", F.lit("2023-12-28"), F.lit("2024-02-03"), {"n": 0})


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 1""")
def peak_day(s, d):
    return analytics.peak_bucket(table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "day", "n")


@query("""SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5""")
def having(s, d):
    return table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).where("errors >= 5")


@query("""SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def listed_names(s, d):
    joined = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM m)
SELECT event_type, count(*) AS members, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 2) AS total, string_agg(user_id || ':' || n, ',' ORDER BY place) FILTER (place <= 3) AS leaders FROM p GROUP BY 1""")
def two_level_rollup(s, d):
    out = analytics.two_level_rollup(table(s, d, "events"), "event_type", "user_id", {"n": F.count("*"), "total": r(F.sum("value"), 2)})
    named = F.array_join(F.transform("leaders", lambda x: F.concat_ws(":", x["member"].cast("string"), x["value"].cast("string"))), ",")
    return out.select("event_type", "members", "n", r(F.col("total"), 2).alias("total"), named.alias("leaders"))


@query("""WITH x AS (SELECT p_brand, lower(p_type) AS f, p_type, count(*) AS n FROM part GROUP BY ALL), y AS (SELECT p_brand, f, sum(n) AS n, min(p_type) AS value FROM x GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS k, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM y) SELECT p_brand, value, CAST(n AS BIGINT) AS n, round(share, 4) AS share FROM z WHERE k = 1""")
def modal_type(s, d):
    return analytics.modal_value(table(s, d, "part"), ["p_brand"], "p_type")


@query("""SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def co_occurrence(s, d):
    return analytics.co_occurrence(table(s, d, "part"), "p_brand", "p_type", 20)


@query("""SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY last_seen DESC, user_id LIMIT 10""")
def recent_users(s, d):
    return analytics.recent_unique(table(s, d, "events"), "user_id", "ts", 10)


@query("""SELECT round(avg(l_extendedprice / nullif(l_quantity, 0)), 4) AS mean_of_ratios, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio_of_sums, max(l_orderkey) + 1 AS next_key, count(DISTINCT l_returnflag) AS flags FROM lineitem""")
def global_aggregates(s, d):
    return table(s, d, "lineitem").agg(r(F.avg(F.try_divide("l_extendedprice", "l_quantity"))).alias("mean_of_ratios"), r(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ratio_of_sums"), (F.max("l_orderkey") + 1).alias("next_key"), analytics.count_distinct_with_null(F.col("l_returnflag")).alias("flags"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def subtotals(s, d):
    joined = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_key, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS mean_k FROM events""")
def json_path(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").agg(F.count(k).alias("with_key"), r(F.avg(k.try_cast("double"))).alias("mean_k"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS won, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / greatest(count(*) FILTER (o_orderstatus IN ('F', 'P')), 1), 2) AS win_rate,
round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS pipeline_value FROM orders""")
def sales_kpis(s, d):
    status = F.col("o_orderstatus")
    return table(s, d, "orders").agg(F.count_if(status == "F").alias("won"), r(numbers.ratio(F.count_if(status == "F"), F.greatest(F.count_if(status.isin("F", "P")), F.lit(1)), 100.0), 2).alias("win_rate"), r(F.sum(F.when(status == "O", F.col("o_totalprice"))), 2).alias("pipeline_value"))


@query("""SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^(www|m)\\.', '') AS domain, count(*) AS pages, CAST(round(avg(length(html))) AS BIGINT) AS mean_length FROM pages GROUP BY 1""")
def company_rollup(s, d):
    domain = F.regexp_replace(F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1)), r"^(www|m)\.", "")
    return table(s, d, "pages").groupBy(domain.alias("domain")).agg(F.count("*").alias("pages"), F.round(F.avg(F.length("html"))).cast("long").alias("mean_length"))


# --- joins and sets ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def dormant_customers(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderdate >= timestamp_ntz'2000-01-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def big_customers(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(clicks, 0) AS clicks, coalesce(errors, 0) AS errors FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_counts(s, d):
    e = table(s, d, "events")
    return analytics.full_outer_counts(e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks")), e.where("event_type = 'error' and value > 60").groupBy("user_id").agg(F.count("*").alias("errors")), ["user_id"], ["clicks"], ["errors"])


@query("""WITH s AS (SELECT lower(trim(s_name)) AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1), t AS (SELECT CAST(s_nationkey AS VARCHAR) AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(s.v, t.v) AS s_suppkey, CASE WHEN s.v IS NOT NULL THEN 'name' WHEN t.v IS NOT NULL THEN 'nation' END AS matched_by
FROM customer LEFT JOIN s ON replace(lower(c_name), 'customer', 'supplier') = s.k LEFT JOIN t ON CAST(c_nationkey AS VARCHAR) = t.k""")
def coalesced_key_join(s, d):
    keys = [
        (F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")), text.email_key(F.col("s_name")), "name"),
        (F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"), "nation"),
    ]
    return analytics.coalesced_join(table(s, d, "customer"), table(s, d, "supplier"), keys, ["s_suppkey"]).select("c_custkey", "s_suppkey", "matched_by")


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', greatest(a, DATE '1998-03-01'), least(b, DATE '1998-03-31')) + 1 AS overlap_days,
CAST(round(CAST(l_quantity * (date_diff('day', greatest(a, DATE '1998-03-01'), least(b, DATE '1998-03-31')) + 1) / (date_diff('day', a, b) + 1) AS DECIMAL(30, 10)), 2) AS DOUBLE) AS prorated
FROM (SELECT *, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS b FROM lineitem) WHERE a <= DATE '1998-03-31' AND b >= DATE '1998-03-01'""")
def interval_overlap(s, d):
    rows = table(s, d, "lineitem").withColumn("a", F.to_date("l_shipdate")).withColumn("b", F.date_add("a", F.col("l_quantity").cast("int")))
    return analytics.overlap_prorated(rows, "a", "b", F.lit("1998-03-01").cast("date"), F.lit("1998-03-31").cast("date"), F.col("l_quantity")).select("l_orderkey", "l_linenumber", "overlap_days", "prorated")


@query("""WITH base AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2), over_ AS (SELECT user_id, CAST(ts AS DATE) AS day, round(max(value), 2) AS o FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT user_id, day, coalesce(o, v) AS v FROM base FULL JOIN over_ USING (user_id, day)""")
def overlaid_values(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return analytics.overlaid(e.where("event_type = 'view'").groupBy("user_id", "day").agg(r(F.sum("value"), 2).alias("v")), e.where("event_type = 'signup'").groupBy("user_id", "day").agg(r(F.max("value"), 2).alias("v")), ["user_id", "day"], "v")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_order(s, d):
    return analytics.latest_per_key(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k FROM orders) WHERE k = 1""")
def latest_with_ties(s, d):
    return analytics.greatest_with_ties(table(s, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25)
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(s, d):
    a = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "left")).unionByName(count(a.union(b).distinct(), "any"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def paged(s, d):
    return analytics.page(table(s, d, "customer"), [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 3, 50).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')")
def searched(s, d):
    return analytics.search(table(s, d, "part"), ["p_name", "p_brand"], "ReD").select("p_partkey")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def visible_to_team(s, d):
    team = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    return analytics.visible_rows(table(s, d, "events"), "team", "", "user_id", team).select("event_id")


NAMES_SQL = "n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)"


def names(s, d):
    """Each distinct part name with its smallest id: texts meet as classes, and their rows join back."""
    return table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))


@query(f"""WITH {NAMES_SQL}, t AS (SELECT k, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM n), z AS (SELECT a.k AS k, b.k AS q, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.k <> b.k GROUP BY 1, 2)
SELECT p_partkey, q, shared FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, q) AS place FROM z) m JOIN n USING (k) JOIN part USING (p_name) WHERE place = 1""")
def token_overlap(s, d):
    a, b = names(s, d), names(s, d).select(F.col("k").alias("q"), F.col("p_name").alias("other"))
    found = analytics.shared_tokens(a, b, "k", "q", text.name_tokens(F.col("p_name")), text.name_tokens(F.col("other")), least=1, same_ids=False)
    return table(s, d, "part").join(a, "p_name").join(found, "k").select("p_partkey", "q", "shared")


# --- windows ----------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM t) WHERE n >= 60""")
def rank_then_filter(s, d):
    counted = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return analytics.ranked_then_filtered(counted, [F.desc("n"), F.col("user_id")], F.col("n") >= 60)


@query("""SELECT s_suppkey, round(coalesce((s_acctbal - min(s_acctbal) OVER ()) / nullif(max(s_acctbal) OVER () - min(s_acctbal) OVER (), 0) * 100, 50), 4) AS score FROM supplier""")
def min_max_scaled(s, d):
    return analytics.min_max(table(s, d, "supplier"), {"score": F.col("s_acctbal")}).select("s_suppkey", r(F.col("score")).alias("score"))


@query("""WITH m AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) - sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS delta FROM events GROUP BY 1, 2)
SELECT user_id, week, round(sum(delta) OVER (PARTITION BY user_id ORDER BY week ROWS UNBOUNDED PRECEDING) + 10, 2) AS balance FROM m""")
def running_balance(s, d):
    value = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))
    weekly = table(s, d, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(r(value("purchase") - value("error"), 2).alias("delta"))
    return analytics.running_balance(weekly, ["user_id"], "week", F.col("delta"), F.lit(10)).select("user_id", "week", "balance")


@query("""WITH m AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT day, round(avg(n) OVER (ORDER BY day ROWS 6 PRECEDING), 4) AS mean_7, round(avg(n) OVER (ORDER BY day ROWS 29 PRECEDING), 4) AS mean_30, round(stddev_pop(n) OVER (ORDER BY day ROWS 29 PRECEDING), 4) AS volatility FROM m""")
def trailing_means(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return analytics.trailing(daily, [], "day", "n").select("day", *[r(F.col(c)).alias(c) for c in ("mean_7", "mean_30", "volatility")])


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN k > 1 AND role IS DISTINCT FROM pr THEN 'role' END, CASE WHEN k > 1 AND long IS DISTINCT FROM pl THEN 'long' END) AS changed
FROM (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS pr, lag(long) OVER w AS pl FROM (SELECT *, length(text) > 200 AS long FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def row_changes(s, d):
    rows = table(s, d, "conversations").withColumn("long", F.length("text") > 200)
    return analytics.changes(rows, ["conv_id"], ["turn"], ["role", "long"]).select("conv_id", "turn", F.array_join("changed", ",").alias("changed"))


# --- attendance -------------------------------------------------------------------------------------------------------

PUNCHES_SQL = "p AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'IN' WHEN 'purchase' THEN 'OUT' END AS kind, CAST(ts AS DATE) AS date FROM events WHERE event_type IN ('click', 'purchase'))"
PAIRED_SQL = f"""{PUNCHES_SQL}, c AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, date ORDER BY ts, event_id) AS b FROM p), k AS (SELECT * FROM c WHERE coalesce(b <> kind, kind = 'IN')),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, date ORDER BY ts, event_id) AS e FROM k),
h AS (SELECT user_id, date, round(coalesce(sum(greatest(0, round((epoch_us(e) - epoch_us(ts)) / 3600000000, 2))), 0), 2) AS paired_hours, count(e) AS paired_segments, bool_or(e IS NULL) AS open_shift FROM n WHERE kind = 'IN' GROUP BY 1, 2),
q AS (SELECT user_id, date, count(*) FILTER (kind = 'IN') AS punches_in, count(*) FILTER (kind = 'OUT') AS punches_out, min(ts) FILTER (kind = 'IN') AS first_in, max(ts) FILTER (kind = 'OUT') AS last_out FROM p GROUP BY 1, 2),
days AS (SELECT user_id, date, coalesce(paired_hours, 0) AS paired_hours, coalesce(paired_segments, 0) AS paired_segments, coalesce(open_shift, false) AS open_shift, punches_in, punches_out,
greatest(0, round(coalesce((epoch_us(last_out) - epoch_us(first_in)) / 3600000000, 0), 2)) AS elapsed_hours, coalesce(epoch(first_in) % 86400 - (epoch(first_in) % 1) > 33300, false) AS is_late, coalesce(paired_hours, 0) >= 8 AS is_full_day, first_in FROM q LEFT JOIN h USING (user_id, date))"""


def punches(s, d):
    kind = F.when(F.col("event_type") == "click", "IN").when(F.col("event_type") == "purchase", "OUT")
    return table(s, d, "events").withColumn("kind", kind).where("kind is not null").select("user_id", "ts", "event_id", "kind")


def day_summaries(s, d):
    return intervals.daily_summary(punches(s, d), "user_id", "ts", "kind", "event_id")


@query(f"WITH {PAIRED_SQL} SELECT user_id, date, paired_hours, paired_segments, open_shift, punches_in, punches_out, elapsed_hours, is_late, is_full_day FROM days")
def attendance_days(s, d):
    return day_summaries(s, d).select("user_id", "date", "paired_hours", "paired_segments", "open_shift", "punches_in", "punches_out", "elapsed_hours", "is_late", "is_full_day")


@query(f"""WITH {PAIRED_SQL} SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, round(sum(paired_hours), 2) AS total_hours, CAST(round(CAST(avg(paired_hours) FILTER (paired_hours > 0) AS DECIMAL(30, 10)), 2) AS DOUBLE) AS mean_hours,
count(*) FILTER (is_late) AS late_days, count(*) FILTER (is_full_day) AS full_days FROM days GROUP BY 1, 2""")
def attendance_months(s, d):
    return intervals.monthly_report(day_summaries(s, d), "user_id").drop("detail", "mean_first_in")


@query(f"""WITH {PUNCHES_SQL}, w AS (SELECT * FROM p WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 20 HOUR AND ts <= TIMESTAMP '{NOW}')
SELECT user_id, CASE WHEN arg_max(kind, (ts, event_id)) = 'IN' THEN 'present' ELSE 'left' END AS status, max(ts) AS since FROM w GROUP BY 1""")
def live_status(s, d):
    return intervals.live_status(punches(s, d), "user_id", "ts", "kind", "event_id", now()).drop("is_late")


@query(f"""WITH {PAIRED_SQL} SELECT user_id, round(sum(paired_hours) FILTER (day(date) = 1), 2) AS d01, round(sum(paired_hours) FILTER (day(date) = 15), 2) AS d15, round(sum(paired_hours), 2) AS total FROM days WHERE date_trunc('month', date) = DATE '2024-01-01' GROUP BY 1""")
def attendance_pivot(s, d):
    return intervals.day_pivot(day_summaries(s, d), "user_id", F.lit("2024-01-01").cast("date")).select("user_id", "d01", "d15", "total")


@query(f"""WITH {PAIRED_SQL}, o AS (SELECT lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') AS code, date, max(paired_hours) AS hours FROM days GROUP BY 1, 2) SELECT code, count(*) AS days, round(sum(hours), 2) AS total_hours, round(avg(hours), 2) AS mean_hours FROM o GROUP BY 1""")
def merged_codes(s, d):
    code = text.code_key((F.col("user_id") % 10).cast("string"), 6)
    return intervals.merged_codes(day_summaries(s, d), code).drop("detail")


@query(f"""WITH {PUNCHES_SQL}, b AS (SELECT DISTINCT user_id, date FROM p WHERE ts >= TIMESTAMP '2024-01-25 00:00:00') SELECT p.user_id, p.event_id FROM p JOIN b USING (user_id, date)""")
def touched_days(s, d):
    p = punches(s, d)
    return intervals.touched_days(p, p.where("ts >= timestamp_ntz'2024-01-25 00:00:00'"), "user_id", "ts").select("user_id", "event_id")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 10 AS b FROM orders), x AS (SELECT o_custkey, o_orderkey, CAST(unnest(generate_series(greatest(a, DATE '1997-05-01'), least(b, DATE '1997-05-31'), INTERVAL 1 DAY)) AS DATE) AS date FROM q WHERE a <= DATE '1997-05-31' AND b >= DATE '1997-05-01')
SELECT o_custkey, date, max(o_orderkey) AS o_orderkey FROM x WHERE isodow(date) < 6 GROUP BY 1, 2""")
def leave_calendar(s, d):
    q = table(s, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 10).alias("b"))
    return intervals.leave_calendar(q, "o_custkey", "a", "b", F.lit("1997-05-01").cast("date"), "o_orderkey").select("o_custkey", "date", "o_orderkey")


@query("""SELECT o_orderkey, CAST((SELECT count(*) FROM range(0, 40) t(i) WHERE CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) <= CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AND isodow(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) < 6) AS INTEGER) AS days FROM orders""")
def weekdays(s, d):
    a = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", dates.weekdays(a, F.date_add(a, (F.col("o_orderkey") % 30).cast("int"))).cast("int").alias("days"))


# --- reconciliation ---------------------------------------------------------------------------------------------------

NEW_SQL = "n AS (SELECT c_name, CASE WHEN c_acctbal > 9000 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT s_name, 'NEW', s_nationkey, s_suppkey FROM supplier)"
DIFF_SQL = f"""{NEW_SQL}, a AS (SELECT upper(trim(c_name)) AS key, arg_max(c_mktsegment, c_custkey) AS b, arg_max(c_nationkey, c_custkey) AS z FROM customer GROUP BY 1), c AS (SELECT upper(trim(c_name)) AS key, arg_max(c_mktsegment, c_custkey) AS b, arg_max(c_nationkey, c_custkey) AS z FROM n GROUP BY 1)"""


def new_customers(s, d):
    """The customer list of a later day: some are gone, some changed, and all suppliers have come in."""
    c = table(s, d, "customer").where("c_acctbal >= 0")
    changed = F.when(F.col("c_acctbal") > 9000, "REVIEW").otherwise(F.col("c_mktsegment"))
    came = table(s, d, "supplier").select(F.col("s_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("c_custkey"))
    return c.select("c_name", changed.alias("c_mktsegment"), "c_nationkey", "c_custkey").unionByName(came)


@query(f"""WITH {DIFF_SQL} SELECT coalesce(a.key, c.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' WHEN a.b IS DISTINCT FROM c.b OR a.z IS DISTINCT FROM c.z THEN 'modified' ELSE 'unchanged' END AS status,
CASE WHEN a.key IS NULL OR c.key IS NULL THEN '' ELSE concat_ws(';', CASE WHEN a.b IS DISTINCT FROM c.b THEN 'c_mktsegment:' || a.b || '>' || c.b END, CASE WHEN a.z IS DISTINCT FROM c.z THEN 'c_nationkey:' || a.z || '>' || c.z END) END AS changes FROM a FULL JOIN c ON a.key = c.key""")
def keyed_diff(s, d):
    out = reconcile.keyed_diff(table(s, d, "customer"), new_customers(s, d), "c_name", ["c_mktsegment", "c_nationkey"], "c_custkey")
    shown = F.array_join(F.transform("changes", lambda x: F.concat(x["field"], F.lit(":"), x["old"], F.lit(">"), x["new"])), ";")
    return out.select("key", "status", shown.alias("changes"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation), b AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS pos FROM nation)
SELECT n_regionkey, pos, a.n_name AS n_name_a, b.n_name AS n_name_b FROM a JOIN b USING (n_regionkey, pos) WHERE a.n_name <> b.n_name""")
def positional_diff(s, d):
    n = table(s, d, "nation")
    return reconcile.positional_diff(n, n, "n_nationkey", "n_name", ["n_name"], "n_regionkey")


@query(f"""WITH {NEW_SQL}, a AS (SELECT regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key, arg_min(c_mktsegment, c_custkey) AS t FROM customer GROUP BY 1), b AS (SELECT regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key, arg_min(c_mktsegment, c_custkey) AS t FROM n GROUP BY 1),
z AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' WHEN a.t = b.t THEN 'matched' ELSE 'mismatch' END AS status,
CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN round(1 - levenshtein(lower(a.t), lower(b.t)) / greatest(length(a.t), length(b.t)), 4) END AS similarity FROM a FULL JOIN b ON a.key = b.key)
SELECT *, CASE WHEN status = 'missing' THEN 'high' WHEN status = 'extra' OR (status = 'mismatch' AND similarity < 0.5) THEN 'medium' WHEN status = 'mismatch' THEN 'low' ELSE 'none' END AS severity FROM z""")
def compared_lists(s, d):
    return reconcile.compare_lists(table(s, d, "customer"), new_customers(s, d), text.tag_key(F.col("c_name")), {"c_mktsegment": 1.0}, "c_custkey")


@query("""WITH a AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q, round(sum(l_tax), 2) AS t FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q, round(sum(l_tax), 2) AS t FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN b.l_orderkey IS NULL THEN 'mine_only' WHEN a.l_orderkey IS NULL THEN 'theirs_only' WHEN abs(round(a.q - b.q, 2)) > 0.01 OR abs(round(a.t - b.t, 2)) > 0.01 THEN 'variance' ELSE 'match' END AS status,
round(coalesce(a.q, 0) - coalesce(b.q, 0), 2) AS q_gap FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey""")
def reconciled_amounts(s, d):
    total = lambda df: df.groupBy("l_orderkey").agg(r(F.sum("l_quantity"), 2).alias("q"), r(F.sum("l_tax"), 2).alias("t"))
    li = table(s, d, "lineitem")
    return reconcile.reconcile_amounts(total(li.where("l_linenumber <= 4")), total(li.where("l_linenumber >= 2")), ["l_orderkey"], ["q", "t"]).select("l_orderkey", "status", "q_gap")


@query("""WITH a AS (SELECT o_orderpriority, sum(o_totalprice) AS x FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT o_orderpriority, sum(o_totalprice) AS y FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
SELECT o_orderpriority, round(x, 2) AS base, round(y, 2) AS compare, round(y - x, 2) AS variance, round((y - x) * 100 / x, 2) AS variance_pct, CASE WHEN round((y - x) * 100 / x, 2) > 5 THEN 'over' WHEN round((y - x) * 100 / x, 2) < -5 THEN 'under' ELSE 'on_track' END AS bucket FROM a JOIN b USING (o_orderpriority)""")
def budget_variance(s, d):
    o = table(s, d, "orders")
    return reconcile.budget_variance(o.where(F.year("o_orderdate") == 1997), o.where(F.year("o_orderdate") == 1998), ["o_orderpriority"], "o_totalprice")


def catalogue(s, d):
    """Each name of each block (type or brand) once, with its smallest id, and the same names as another hand spells them."""
    part = table(s, d, "part")

    def sides(block: str):
        a = part.groupBy(block, "p_name").agg(F.min("p_partkey").alias("k"))
        return a, a.select(F.col("k").alias("q"), F.translate("p_name", "i", "e").alias("n"), F.col(block).alias("b"))

    return part, sides


@query("""WITH n AS (SELECT p_type, p_name, min(p_partkey) AS k FROM part GROUP BY 1, 2),
z AS (SELECT a.k AS k, b.k AS right_id, 1 - levenshtein(lower(trim(a.p_name)), lower(trim(translate(b.p_name, 'i', 'e')))) / greatest(length(trim(a.p_name)), length(trim(b.p_name))) AS score FROM n a JOIN n b USING (p_type)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, right_id) AS place FROM z WHERE score >= 0.8) WHERE place = 1)
SELECT p_partkey, right_id, round(score, 4) AS score FROM part JOIN n USING (p_type, p_name) JOIN m USING (k)""")
def fuzzy_match(s, d):
    part, sides = catalogue(s, d)
    a, b = sides("p_type")
    found = similarity.best_matches(a, b, "k", "q", "p_name", "n", block=(F.col("p_type"), F.col("b")))
    return part.join(a, ["p_type", "p_name"]).join(found, F.col("k") == F.col("left_id")).select("p_partkey", "right_id", "score")


@query()
def greedy_pairs(s, d):
    _, sides = catalogue(s, d)
    a, b = sides("p_brand")
    return similarity.greedy_pairs(a, b, "k", "q", "p_name", "n", (F.col("p_brand"), F.col("b")), 0.6)


@query()
def fuzzy_dedup(s, d):
    return similarity.fuzzy_dedup(table(s, d, "part"), "p_partkey", F.concat_ws("|", text.name_key(F.col("p_name")), "p_brand"), "p_name", F.col("p_brand"), F.col("p_size")).select("p_partkey", "p_name", "p_brand")


@query("""WITH c AS (SELECT c_custkey, lower(trim(c_name)) AS n, CAST(c_nationkey AS VARCHAR) AS k FROM customer), s AS (SELECT s_suppkey, replace(lower(s_name), 'supplier', 'customer') AS n, CAST(s_nationkey AS VARCHAR) AS k FROM supplier),
a AS (SELECT c_custkey AS left_id, min(s_suppkey) AS right_id, 'name' AS matched_by FROM c JOIN s USING (n) GROUP BY 1), b AS (SELECT c_custkey AS left_id, min(s_suppkey) AS right_id, 'nation' AS matched_by FROM c JOIN s USING (k) WHERE c_custkey NOT IN (SELECT left_id FROM a) GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def cascade_match(s, d):
    exact = [("name", F.lower(F.trim("c_name")), F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer"))), ("nation", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"))]
    return reconcile.cascade_match(table(s, d, "customer"), table(s, d, "supplier"), "c_custkey", "s_suppkey", exact)


@query("""SELECT a.turn, a.conv_id, CASE WHEN trim(a.role) = '' THEN 0 ELSE round(greatest(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), CASE WHEN contains(p, q) OR contains(q, p) THEN 0.7 ELSE 0 END) * 100, 2) END AS similarity
FROM (SELECT a.*, lower(trim(a.text)) AS p, lower(trim(b.text)) AS q, list_filter(list_distinct(regexp_split_to_array(lower(trim(a.text)), '\\s+')), lambda w: w <> '') AS x, list_filter(list_distinct(regexp_split_to_array(lower(trim(b.text)), '\\s+')), lambda w: w <> '') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE lower(trim(a.text)) <> lower(trim(b.text)) AND trim(a.text) <> '' AND trim(b.text) <> '') a""")
def text_similarity(s, d):
    c = table(s, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    pairs = c.join(b, ["conv_id", "turn"]).where("lower(trim(text)) != lower(trim(other)) and trim(text) != '' and trim(other) != ''")
    return pairs.select("turn", "conv_id", text.text_similarity(F.col("text"), F.col("other")).alias("similarity"))


# --- quality ----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, round(((CASE WHEN trim(text) = '' THEN 0 ELSE 3 END) + (CASE WHEN lang = 'es' THEN 0 ELSE 2 END) + (CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 1 END)) / 6.0, 4) AS completeness FROM documents""")
def row_completeness(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), F.when(~F.col("source").isin("src1", "src2"), F.col("source")).otherwise("N/A").alias("source"))
    return quality.row_completeness(docs, {"text": 3, "lang": 2, "source": 1}).select("doc_id", "completeness")


@query("""SELECT 'lang' AS column, CAST(2.0 AS DOUBLE) AS weight, count(*) FILTER (lang <> 'es') AS filled, count(*) AS total, round(count(*) FILTER (lang <> 'es') / count(*), 4) AS pct FROM documents
UNION ALL SELECT 'source', CAST(1.0 AS DOUBLE), count(source), count(*), round(count(source) / count(*), 4) FROM documents""")
def column_completeness(s, d):
    docs = table(s, d, "documents").select(F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), "source")
    return quality.column_completeness(docs, {"lang": 2, "source": 1})


def rules():
    return [quality.pattern("p_brand", r"^Brand#\d$"), quality.within("p_size", 1, 45), quality.required("p_name"), quality.ordered("p_size", "p_retailprice")]


@query("""SELECT p_partkey, 'pattern' AS rule, 'p_brand' AS column, 'warning' AS severity FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$') UNION ALL SELECT p_partkey, 'range', 'p_size', 'error' FROM part WHERE p_size NOT BETWEEN 1 AND 45""")
def rule_findings(s, d):
    return quality.findings(table(s, d, "part"), "p_partkey", rules())


@query("""SELECT 'pattern:p_brand' AS rule, count(*) FILTER (NOT regexp_matches(p_brand, '^Brand#[0-9]$')) AS broken, round(100.0 * count(*) FILTER (regexp_matches(p_brand, '^Brand#[0-9]$')) / count(*), 2) AS good_pct FROM part
UNION ALL SELECT 'range:p_size', count(*) FILTER (p_size NOT BETWEEN 1 AND 45), round(100.0 * count(*) FILTER (p_size BETWEEN 1 AND 45) / count(*), 2) FROM part
UNION ALL SELECT 'required:p_name', 0, 100.0 UNION ALL SELECT 'order:p_size<=p_retailprice', 0, 100.0""")
def rule_summary(s, d):
    return quality.rule_summary(table(s, d, "part"), rules())


@query("""SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def conflicting_values(s, d):
    return quality.conflicting_values(table(s, d, "part"), "p_name", "p_brand").select("p_name", "n_values")


@query("""SELECT p_partkey, round(((CASE WHEN regexp_matches(p_name, 'red') THEN least(b + 0.1, 1) ELSE greatest(b - 0.1, 0) END) + (CASE WHEN regexp_matches(p_type, '^E') THEN least(b + 0.1, 1) ELSE greatest(b - 0.1, 0) END)) / 2, 4) AS confidence
FROM (SELECT *, CASE p_brand WHEN 'Brand#1' THEN 0.9 WHEN 'Brand#2' THEN 0.7 ELSE 0.5 END AS b FROM part)""")
def cell_confidence(s, d):
    return quality.confidence(table(s, d, "part"), "p_partkey", {"p_name": "red", "p_type": "^E"}, "p_brand", {"Brand#1": 0.9, "Brand#2": 0.7})


# --- anomalies and vectors --------------------------------------------------------------------------------------------

STATS_SQL = "st AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sp, stddev_samp(value) AS ss, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"


@query(f"WITH {STATS_SQL} SELECT event_type, n, round(m, 4) AS mean, round(ss, 4) AS std, round(q1, 4) AS q25, round(q2, 4) AS median, round(q3, 4) AS q75 FROM st")
def series_statistics(s, d):
    return anomaly.statistics(table(s, d, "events"), ["event_type"], "value").select("event_type", "n", *[r(F.col(c)).alias(c) for c in ("mean", "std", "q25", "median", "q75")])


@query(f"""WITH {STATS_SQL} SELECT event_id, round(abs(value - m) / sp, 4) AS z_score, (abs(value - m) / sp > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS is_anomaly FROM events JOIN st USING (event_type)""")
def statistical_anomalies(s, d):
    return anomaly.statistical(table(s, d, "events"), ["event_type"], "value").select("event_id", r(F.col("z_score")).alias("z_score"), "is_anomaly")


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), l AS (SELECT user_id, list(value ORDER BY k DESC) AS a FROM v WHERE k <= 30 GROUP BY 1 HAVING count(*) >= 7), m AS (SELECT user_id, a[-1] AS last, list_avg(a[-7:]) - list_avg(a) AS trend FROM l)
SELECT user_id, CAST(i AS INTEGER) AS step, round(last + trend * i, 3) AS predicted FROM m, range(1, 31) t(i)""")
def forecasts(s, d):
    return anomaly.forecast(table(s, d, "events"), ["user_id"], "event_id", "value").select("user_id", "step", r(F.col("predicted"), 3).alias("predicted"))


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), w AS (SELECT user_id, 11 - k AS i, value FROM v WHERE k <= 10), t AS (SELECT * FROM (VALUES ('spike', [0,0,0,10,0,0,0,0,0,0]), ('drop', [10,10,10,0,10,10,10,10,10,10]), ('increasing', [1,2,3,4,5,6,7,8,9,10])) x(name, a)),
c AS (SELECT user_id, name, corr(value, a[i]) AS s FROM w, t GROUP BY 1, 2 HAVING count(*) = 10) SELECT user_id, CASE WHEN max(s) > 0 THEN arg_max(name, s) END AS pattern, round(greatest(max(s), 0), 3) AS similarity, max(s) >= 0.85 AS detected FROM c GROUP BY 1""")
def pattern_matches(s, d):
    return anomaly.patterns(table(s, d, "events"), ["user_id"], "event_id", "value").select("user_id", "pattern", r(F.col("similarity"), 3).alias("similarity"), "detected")


@query("""SELECT s_suppkey, 's_acctbal' AS metric, round(s_acctbal, 4) AS value, round(m, 4) AS mean FROM supplier, (SELECT avg(s_acctbal) AS m FROM supplier) WHERE s_acctbal > m * 1.5""")
def cohort_outliers(s, d):
    return anomaly.cohort_outliers(table(s, d, "supplier"), "s_suppkey", {"s_acctbal": 1.5})


QUERY_VECTOR = [((i * 37) % 17 - 8) / 8 for i in range(64)]


@query(f"""SELECT vec_id, round(s, 5) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10""")
def vector_top_k(s, d):
    return vectors.top_k(table(s, d, "embeddings"), "embedding", "vec_id", QUERY_VECTOR, 10).withColumn("similarity", r(F.col("similarity"), 5))


# --- graphs -----------------------------------------------------------------------------------------------------------

EDGES_SQL = """v AS (SELECT 'r' || r_regionkey AS id, DATE '1990-01-01' AS finish FROM region UNION ALL SELECT 'n' || n_nationkey, DATE '1990-01-01' FROM nation UNION ALL SELECT 'c' || c_custkey, DATE '1990-01-01' FROM customer UNION ALL SELECT 'o' || o_orderkey, CAST(o_orderdate AS DATE) FROM orders),
e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def _id(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def edges(s, d):
    """Region to nation, nation to customer and supplier, customer to large order; suppliers are no vertices."""
    link = lambda df, a, x, b, y: df.select(_id(a, x).alias("src"), _id(b, y).alias("dst"))
    large = table(s, d, "orders").where("o_totalprice > 250000")
    return (
        link(table(s, d, "nation"), "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(link(table(s, d, "customer").where("c_acctbal > 0"), "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(link(large, "c", "o_custkey", "o", "o_orderkey"))
        .unionByName(link(table(s, d, "supplier"), "n", "s_nationkey", "s", "s_suppkey"))
    )


def vertices(s, d):
    """Regions, nations, customers and orders, with the day on which an order is finished."""
    early = F.lit("1990-01-01").cast("date").alias("finish")
    out = table(s, d, "orders").select(_id("o", "o_orderkey").alias("id"), F.to_date("o_orderdate").alias("finish"))
    for name, kind, key in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey")):
        out = out.unionByName(table(s, d, name).select(_id(kind, key).alias("id"), early))
    return out


@query(f"WITH {EDGES_SQL} SELECT id FROM v WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def isolated_nodes(s, d):
    return graph.isolated(vertices(s, d), edges(s, d)).select("id")


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def valid_edges(s, d):
    return graph.valid_edges(vertices(s, d), edges(s, d)).select("src", "dst")


@query(f"""WITH RECURSIVE {EDGES_SQL}, t(origin, id) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT origin, dst FROM t JOIN e ON id = src) SELECT origin, id FROM t""")
def reachability(s, d):
    return graph.reachable(edges(s, d), table(s, d, "region").select(_id("r", "r_regionkey").alias("id")))


@query(f"""WITH RECURSIVE {EDGES_SQL}, f AS (SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT id FROM v)), t(id, layer) AS (SELECT id, 0 FROM v UNION SELECT dst, layer + 1 FROM t JOIN f ON id = src) SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM t GROUP BY 1""")
def topological_layers(s, d):
    return graph.layers(vertices(s, d), edges(s, d))


@query(f"""WITH RECURSIVE {EDGES_SQL}, t(id, r) AS (SELECT id, id FROM v UNION SELECT t.id, dst FROM t JOIN e ON r = src) SELECT t.id AS id, max(finish) AS reach FROM t JOIN v ON r = v.id GROUP BY 1""")
def latest_finish(s, d):
    v = vertices(s, d)
    return graph.total_float(v, edges(s, d).join(v.select(F.col("id").alias("dst")), "dst", "left_semi")).select("id", "reach")


# --- scores and formulas ----------------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT c_custkey, c_acctbal, c_mktsegment, sum(o_totalprice) AS v, date_diff('day', DATE '2001-08-01', CAST(max(o_orderdate) AS DATE) + 90) AS dd FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
y AS (SELECT c_custkey, (CASE WHEN c_acctbal > 1000 THEN 100 WHEN c_acctbal > 500 THEN 80 WHEN c_acctbal > 100 THEN 60 ELSE 40 END) * 0.25 + (CASE WHEN c_mktsegment = 'MACHINERY' THEN 100 ELSE 60 END) * 0.20 + (CASE WHEN v > 1000000 THEN 100 WHEN v > 500000 THEN 80 WHEN v > 100000 THEN 60 ELSE 40 END) * 0.25 + (CASE WHEN dd < 30 THEN 100 WHEN dd < 90 THEN 75 ELSE 50 END) * 0.15 + 50 * 0.15 AS t FROM x)
SELECT c_custkey, CAST(round(t, 1) AS DOUBLE) AS score, CASE WHEN t >= 80 THEN 'A' WHEN t >= 60 THEN 'B' WHEN t >= 40 THEN 'C' ELSE 'D' END AS grade FROM y""")
def lead_scores(s, d):
    x = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_acctbal", "c_mktsegment").agg(F.sum("o_totalprice").alias("v"), F.datediff(F.date_add(F.to_date(F.max("o_orderdate")), 90), F.lit("2001-08-01").cast("date")).alias("dd"))
    score, grade = scoring.lead_score(F.col("c_acctbal"), F.col("c_mktsegment") == "MACHINERY", F.col("v"), F.col("dd"), F.lit("user"))
    return x.select("c_custkey", score.alias("score"), grade.alias("grade"))


@query("""WITH x AS (SELECT c_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01') AS dd, count(*) FILTER (o_orderstatus = 'O') AS active, CAST(c_custkey % 100 AS DOUBLE) AS h FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
y AS (SELECT c_custkey, least(((CASE WHEN dd > 90 THEN 0.30 * least(dd / 180, 1) ELSE 0 END) + (CASE WHEN h < 40 THEN 0.25 * (1 - h / 100) ELSE 0 END) + (CASE WHEN active = 0 THEN 0.2 ELSE 0 END)) * 100, 100) AS t FROM x) SELECT c_custkey, CASE WHEN t > 70 THEN 'high' WHEN t > 40 THEN 'medium' ELSE 'low' END AS level FROM y""")
def churn_levels(s, d):
    x = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.datediff(F.lit("2001-08-01").cast("date"), F.to_date(F.max("o_orderdate"))).alias("dd"), F.count_if(F.col("o_orderstatus") == "O").alias("active"))
    _, level = scoring.churn_risk(F.col("dd"), (F.col("c_custkey") % 100).cast("double"), F.col("active"))
    return x.select("c_custkey", level.alias("level"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 75 WHEN 'O' THEN 25 ELSE 50 END AS b, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age, o_orderkey % 100 AS h, o_orderkey % 6 AS act, o_orderkey % 12 AS q FROM orders)
SELECT o_orderkey, CAST(greatest(0, least(100, b + (CASE WHEN age > 180 THEN -20 WHEN age > 90 THEN -10 ELSE 0 END) + (CASE WHEN h > 70 THEN 10 WHEN h < 40 THEN -15 ELSE 0 END) + (CASE WHEN act > 3 THEN 15 WHEN act = 0 THEN -20 ELSE 0 END) + (CASE WHEN q < 7 THEN 10 ELSE 0 END))) AS INTEGER) AS probability FROM x""")
def win_probabilities(s, d):
    k = F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") == "F", "negotiation").when(F.col("o_orderstatus") == "O", "qualified").otherwise("proposal")
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", scoring.win_probability(stage, age, k % 100, k % 6, k % 12).alias("probability"))


@query("""WITH u AS (SELECT user_id, count(*) AS a, count(DISTINCT event_type) AS f, CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS m, count(*) FILTER (event_type = 'view') AS q, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 2) AS g FROM events GROUP BY 1),
n AS (SELECT *, round(coalesce((a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0) * 100, 50), 2) AS p1, round(coalesce((f - min(f) OVER ()) / nullif(max(f) OVER () - min(f) OVER (), 0) * 100, 50), 2) AS p2, round(coalesce((m - min(m) OVER ()) / nullif(max(m) OVER () - min(m) OVER (), 0) * 100, 50), 2) AS p3, round(coalesce((q - min(q) OVER ()) / nullif(max(q) OVER () - min(q) OVER (), 0) * 100, 50), 2) AS p4 FROM u),
z AS (SELECT user_id, q, f, CAST(round(CAST(0.20 * p1 + 0.15 * p2 + 0.10 * p3 + 0.25 * p4 + 0.15 * p1 + 0.15 * g AS DECIMAL(30, 10)), 2) AS DOUBLE) AS score FROM n) SELECT user_id, score, CASE WHEN score >= 90 THEN 'diamond' WHEN score >= 75 THEN 'platinum' WHEN score >= 60 THEN 'gold' WHEN score >= 40 THEN 'silver' WHEN score >= 20 THEN 'bronze' ELSE 'rookie' END AS tier, CAST(row_number() OVER (ORDER BY score DESC, q DESC, f DESC, user_id) AS INTEGER) AS place FROM z""")
def champion_scores(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("actions"), F.count_distinct("event_type").alias("features"), F.count_distinct(F.to_date("ts")).cast("double").alias("minutes"), F.count_if(F.col("event_type") == "view").alias("ai_requests"), F.lit(0.0).alias("ai_cost"), (F.count_if(F.col("event_type") != "error") * 100.0 / F.count("*")).alias("success_rate"))
    return scoring.champion_scores(u, "user_id").select("user_id", "score", "tier", "place")


@query(f"""WITH l AS (SELECT c_custkey, max(ts) AS t FROM customer LEFT JOIN events ON c_custkey = user_id AND event_type = 'signup' AND ts < TIMESTAMP '{NOW}' GROUP BY 1) SELECT c_custkey, CASE WHEN t IS NULL THEN 'inactive' WHEN date_diff('day', CAST(t AS DATE), DATE '2024-01-25') <= 7 THEN 'active' WHEN date_diff('day', CAST(t AS DATE), DATE '2024-01-25') <= 30 THEN 'recent' ELSE 'dormant' END AS status FROM l""")
def user_status(s, d):
    last = table(s, d, "events").where((F.col("event_type") == "signup") & (F.col("ts") < now())).groupBy("user_id").agg(F.max("ts").alias("t"))
    return table(s, d, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", scoring.user_status(F.to_date("t"), F.to_date(now())).alias("status"))


@query("""WITH x AS (SELECT p_partkey, p_size * 4.403 * sqrt((p_retailprice / 1000) / (2.5 * 14.504)) AS cv, p_retailprice * 9.81 * p_size * 12 / (0.75 * 3600) AS power, p_size * 4.18 * 25 / 3600 AS duty, (p_size / 10 * 500 / 2) / (138 * 0.85 - (p_size / 10) * 0.6) + 3 AS wall FROM part)
SELECT p_partkey, CAST(round(CAST(cv AS DECIMAL(30, 10)), 2) AS DOUBLE) AS cv, CAST(round(CAST(power AS DECIMAL(30, 10)), 2) AS DOUBLE) AS power, CAST(round(CAST(duty AS DECIMAL(30, 10)), 2) AS DOUBLE) AS duty, CAST(round(CAST(wall AS DECIMAL(30, 10)), 2) AS DOUBLE) AS wall FROM x""")
def engineering(s, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(s, d, "part").select(
        "p_partkey", numbers.valve_cv(size, price, F.lit(2.5)).alias("cv"), numbers.pump_power(size, F.lit(12.0), F.lit(0.75), price).alias("power"), numbers.heat_duty(size, F.lit(4.18), F.lit(20.0), F.lit(45.0)).alias("duty"), numbers.wall_thickness(F.lit(500.0), size, F.lit(138.0), F.lit(0.85), F.lit(3.0)).alias("wall")
    )


@query("""SELECT event_id, substr(sha256(concat_ws('|', user_id, event_type, event_id)), 1, 32) AS key FROM events""")
def event_keys(s, d):
    return table(s, d, "events").select("event_id", text.event_key(F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")).alias("key"))


@query("""SELECT p_partkey, 'small' AS ladder, x AS size FROM part, (VALUES (10), (20), (30), (40), (50)) t(x) WHERE x <= p_size AND p_type = 'SMALL' UNION ALL SELECT p_partkey, 'own', p_size FROM part WHERE p_type = 'SMALL'""")
def size_ladder(s, d):
    p = table(s, d, "part").where("p_type = 'SMALL'")
    steps = F.filter(F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50)]), lambda x: x <= F.col("p_size"))
    return p.select("p_partkey", F.lit("small").alias("ladder"), F.explode(steps).alias("size")).unionByName(p.select("p_partkey", F.lit("own").alias("ladder"), F.col("p_size").alias("size")))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark) GROUP BY 1 ORDER BY n DESC, word LIMIT 25""")
def keyword_frequency(s, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")))
    return table(s, d, "benchmark").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


# --- business records -------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS amount, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0)
SELECT k, coalesce(a.amount, b.amount) AS amount, b.n AS n, c.segment AS segment, concat_ws(',', CASE WHEN a.amount IS NOT NULL THEN 'final' END, CASE WHEN b.n IS NOT NULL THEN 'pending' END, CASE WHEN c.segment IS NOT NULL THEN 'master' END) AS sources FROM a FULL JOIN b USING (k) LEFT JOIN c USING (k)""")
def three_source_merge(s, d):
    total = lambda status: table(s, d, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k"))
    amount = r(F.sum("o_totalprice"), 2).alias("amount")
    master = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    out = business.merged_sources({"final": total("F").agg(amount), "pending": total("P").agg(amount, F.count("*").alias("n")), "master": master}, "k", overlays=["master"])
    return out.withColumn("sources", F.array_join("sources", ","))


@query("""WITH c AS (SELECT p_brand, CAST(z AS DOUBLE) AS z, min(p_partkey) AS m FROM (SELECT p_brand, p_partkey, unnest([p_size, p_size + 25]) AS z FROM part WHERE p_type = 'SMALL') GROUP BY 1, 2)
SELECT p_partkey, m AS matched_p_partkey FROM part LEFT JOIN c ON part.p_brand = c.p_brand AND p_size = z""")
def catalogue_lookup(s, d):
    p = table(s, d, "part")
    catalogue = p.where("p_type = 'SMALL'").withColumn("other", F.col("p_size") + 25)
    return business.catalogue_match(p.select("p_partkey", "p_brand", "p_size"), catalogue, ["p_brand"], "p_size", ["p_size", "other"], ["p_partkey"], ["p_partkey"]).select("p_partkey", "matched_p_partkey")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(text), '([A-Z]+)', 1))) AS code FROM documents), c AS (SELECT unnest(['LICENSE', 'RELEASED', 'UNDER', 'MOLLY', 'THATTHE']) AS code) SELECT doc_id, code FROM w JOIN c USING (code)""")
def documents_naming_codes(s, d):
    codes = s.createDataFrame([("License",), ("released",), ("UNDER",), ("molly",), ("thatthe",)], "c string")
    return business.rows_naming_codes(table(s, d, "documents").select("doc_id", "text"), "text", codes, "c", "([A-Z]+)").select("doc_id", "code")


@query("""SELECT o_orderkey AS id, o_orderkey // 2 AS owner FROM orders WHERE o_orderkey // 2 <> o_orderkey AND o_orderkey // 2 IN (SELECT o_orderkey FROM orders)""")
def order_references(s, d):
    name = lambda c: F.concat(F.lit("ORD-"), c.cast("string"))
    notes = table(s, d, "orders").select("o_orderkey", name(F.col("o_orderkey")).alias("tag"), F.concat(name(F.col("o_orderkey")), F.lit(" replaces "), name(F.floor(F.col("o_orderkey") / 2))).alias("note"))
    return business.back_references(notes, "o_orderkey", "note", "tag", r"(ORD-\d+)").select("id", "owner")


@query("""SELECT event_id FROM events a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 24 HOUR)""")
def fresh_alerts(s, d):
    errors = table(s, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return business.without_recent(errors, errors, ["user_id"], "ts", 24).select("event_id")


@query("""SELECT 'event_type' AS dimension, event_type AS value, count(*) AS calls, round(sum(value) * 0.033, 2) AS cost FROM events GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*), round(sum(value) * 0.033, 2) FROM events GROUP BY 2""")
def cost_breakdown(s, d):
    return business.by_each(table(s, d, "events").withColumn("hour", F.hour("ts")), ["event_type", "hour"], {"calls": F.count("*"), "cost": r(F.sum("value") * 0.033, 2)})


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (i = 1) AS step_1, max(o_orderkey) FILTER (i = 2) AS step_2, max(o_orderkey) FILTER (i = 3) AS step_3, max(o_orderkey) FILTER (i = 4) AS step_4, max(o_orderkey) FILTER (i = 5) AS step_5, max(o_orderkey) FILTER (i = 6) AS step_6, count(*) AS steps, arg_max(o_orderkey, i) AS last FROM n GROUP BY 1""")
def document_register(s, d):
    return business.register(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""SELECT coalesce(o_orderpriority, 'TOTAL') AS o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 2) AS hours, count(*) AS tasks FROM orders GROUP BY ROLLUP (orders.o_orderpriority)""")
def manhours(s, d):
    return business.with_total(table(s, d, "orders"), "o_orderpriority", {"hours": r(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 2), "tasks": F.count("*")})


@query("""WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal * 100 AS b FROM customer)
SELECT k, round(b, 2) AS budget, round(coalesce(x, 0), 2) AS spent, round(b - coalesce(x, 0), 2) AS remaining, CASE WHEN coalesce(x, 0) = 0 THEN 0.0 ELSE coalesce(round(x * 100.0 / nullif(b, 0), 2), 0) END AS used_pct, coalesce(x, 0) > b AS over FROM c LEFT JOIN s USING (k)""")
def budget_utilisation(s, d):
    budget = table(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 100).alias("b"))
    spent = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return business.utilisation(budget, spent, ["k"], "b", "o_totalprice")


@query("""WITH x AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 5 AS b FROM orders), g AS (SELECT *, date_diff('day', b, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, b)) AS gap FROM x)
SELECT o_custkey, count(*) AS done, round(avg(gap), 2) AS mean_gap, CASE WHEN avg(gap) IS NOT NULL THEN max(b) + CAST(ceil(round(greatest(15 - count(*), 0) * greatest(avg(gap), 0), 6)) AS INTEGER) END AS expected FROM g GROUP BY 1""")
def completion_dates(s, d):
    chain = table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 5).alias("b"))
    return business.completion_forecast(chain, ["o_custkey"], "a", "b", 15)


@query("""SELECT service, round(sum(p_retailprice), 2) AS revenue, count(*) AS rows FROM (SELECT unnest(string_split(p_name, ' ')) AS service, p_retailprice FROM part) GROUP BY 1""")
def service_revenue(s, d):
    return business.exploded_revenue(table(s, d, "part").withColumn("words", F.split("p_name", " ")), "words", F.col("p_retailprice"))


@query("""WITH x AS (SELECT o_orderpriority AS k, sum(o_totalprice) FILTER (o_orderstatus = 'F') / 12 AS h, sum(o_totalprice) FILTER (o_orderstatus = 'O') / 12 AS p FROM orders GROUP BY 1) SELECT k, round(h * 0.3 + p * 0.7, 2) AS forecast, round((h * 0.3 + p * 0.7) * 0.75, 2) AS low, round((h * 0.3 + p * 0.7) * 1.25, 2) AS high FROM x""")
def sales_forecasts(s, d):
    part = lambda status: F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))) / 12
    x = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(part("F").alias("h"), part("O").alias("p"))
    middle, low, high = business.sales_forecast(F.col("h"), F.col("p"))
    return x.select("k", middle.alias("forecast"), low.alias("low"), high.alias("high"))


@query("""WITH n AS (SELECT conv_id AS block, lower(trim(text)) AS t, min(turn) AS id, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2),
w AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(t, '\\s+')), lambda x: x <> '') AS ws FROM n),
z AS (SELECT a.block, a.id AS left_id, b.id AS right_id, round(greatest(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), CASE WHEN contains(a.t, b.t) OR contains(b.t, a.t) THEN 0.7 ELSE 0 END) * 100, 2) AS similarity FROM w a JOIN w b ON a.block = b.block AND a.id < b.id)
SELECT block, left_id, right_id, similarity, 'modified' AS link FROM z WHERE similarity >= 6 UNION ALL SELECT block, id, id, 100.0, 'identical' FROM n WHERE n > 1""")
def comment_links(s, d):
    return business.linked_texts(table(s, d, "conversations"), "turn", "text", "conv_id", 6.0)


@query("""WITH m AS (SELECT p_brand, list_sort(list(p_size))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM part GROUP BY 1) SELECT p_partkey, median FROM part JOIN m USING (p_brand) WHERE abs(p_size - median) > 22""")
def median_outliers(s, d):
    return business.upper_median_outliers(table(s, d, "part"), ["p_brand"], "p_size", 22).select("p_partkey", "median")


@query(f"""WITH {NEW_SQL}, a AS (SELECT c_name AS k, arg_min(c_mktsegment, c_custkey) AS t FROM customer GROUP BY 1), b AS (SELECT c_name AS k, arg_min(c_mktsegment, c_custkey) AS t FROM n GROUP BY 1), x AS (SELECT a.t AS p, b.t AS q FROM a FULL JOIN b USING (k))
SELECT count(*) FILTER (p = q) AS matched, count(*) FILTER (p <> q) AS mismatch, count(*) FILTER (q IS NULL) AS missing, count(*) FILTER (p IS NULL) AS extra, round(100.0 * count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) / count(*) FILTER (p IS NOT NULL), 2) AS coverage_pct FROM x""")
def tag_coverage(s, d):
    return business.coverage(reconcile.compare_lists(table(s, d, "customer"), new_customers(s, d), text.tag_key(F.col("c_name")), {"c_mktsegment": 1.0}, "c_custkey"))


@query("""WITH h AS (SELECT p_name, list(DISTINCT p_type) AS h FROM part GROUP BY 1) SELECT p_name, array_to_string(list_sort(list_filter(['ECONOMY', 'LARGE', 'SMALL', 'TINY'], lambda x: NOT list_contains(h, x))), ',') AS missing, array_to_string(list_sort(list_filter(h, lambda x: NOT list_contains(['ECONOMY', 'LARGE', 'SMALL', 'TINY'], x))), ',') AS unexpected FROM h""")
def type_gaps(s, d):
    out = business.list_gaps(table(s, d, "part"), "p_name", "p_type", ["ECONOMY", "LARGE", "SMALL", "TINY"])
    return out.select("p_name", *[F.array_join(c, ",").alias(c) for c in ("missing", "unexpected")])


@query("""SELECT c_custkey FROM customer WHERE regexp_matches(lower(c_name), '0[0-4]$') AND lower(c_mktsegment) = 'building' AND starts_with(lower(c_name), 'cust')""")
def filter_list(s, d):
    filters = [{"column": "c_name", "op": "regex", "value": "0[0-4]$"}, {"column": "c_mktsegment", "op": "equals", "value": "Building"}, {"column": "c_name", "op": "starts_with", "value": "CUST"}]
    return business.matched_filters(table(s, d, "customer"), filters).select("c_custkey")


@query("""WITH z AS (SELECT s_suppkey, c_custkey, round(least(0.45 + CASE WHEN abs(c_acctbal - s_acctbal) < 100 THEN 0.35 WHEN abs(c_acctbal - s_acctbal) < 1000 THEN 0.2 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1 ELSE 0 END, 0.99), 4) AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS place FROM z) WHERE place <= 8""")
def recommendations(s, d):
    a = table(s, d, "supplier").withColumn("nation", F.col("s_nationkey"))
    b = table(s, d, "customer").withColumns({"nation": F.col("c_nationkey"), "building": F.col("c_mktsegment") == "BUILDING"})
    gap = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    likeness = F.when(gap < 100, 0.9).when(gap < 1000, 0.6).otherwise(0.0)
    score = scoring.recommendation_score(F.lit(True), likeness, F.col("building"), F.lit(100))
    return business.recommended_by_gap(a, b, "nation", "s_suppkey", "c_custkey", "s_acctbal", "c_acctbal", ["building"], [100, 1000], score)


@query("""SELECT p_partkey, round(p_size * 6894.757293168 / 1e5, 6) AS bar, round((p_size + 459.67) * 5 / 9 - 273.15, 6) AS celsius, CAST(NULL AS DOUBLE) AS wrong, CAST(NULL AS DOUBLE) AS unknown, round(p_size * 133.322 / 1e3, 6) AS kilopascal FROM part""")
def unit_conversions(s, d):
    v = F.col("p_size").cast("double")
    to = lambda a, b: F.round(business.converted(v, F.lit(a), F.lit(b)), 6)
    return table(s, d, "part").select("p_partkey", to("psi", "bar").alias("bar"), to("F", "C").alias("celsius"), to("psi", "m").alias("wrong"), to("furlong", "m").alias("unknown"), to(" TORR", "kpa").alias("kilopascal"))


@query("""WITH x AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer), y AS (SELECT *, sign(cents) * ((abs(cents) * 6 + 26) // 52) AS cut FROM x) SELECT c_custkey, cut / 100 AS deduction, (cents - cut) / 100 AS net FROM y""")
def payroll_lines(s, d):
    gross = numbers.gross_pay(F.col("c_acctbal"))
    cut = F.round(gross * 3 / 26, 2).cast("decimal(18,2)")
    return table(s, d, "customer").select("c_custkey", cut.cast("double").alias("deduction"), (gross - cut).cast("double").alias("net"))


@query(f"""WITH {PAIRED_SQL} SELECT user_id, round(sum(paired_hours) FILTER (month(date) = 1), 2) AS m01, round(sum(paired_hours) FILTER (month(date) = 2), 2) AS m02 FROM days WHERE year(date) = 2024 GROUP BY 1""")
def attendance_year(s, d):
    return intervals.month_pivot(day_summaries(s, d), "user_id", 2024).select("user_id", "m01", "m02")


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL (i * 5) MINUTE AS start FROM events, range(0, 3) t(i)) SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2""")
def sliding_windows(s, d):
    return jobs.sliding(table(s, d, "events"), "ts", "15 minutes", "5 minutes", {"n": F.count("*"), "total": r(F.sum("value"), 2)}, keys=["event_type"]).drop("end")


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1) SELECT user_id, least(100, n * 2) AS engagement, round(f / n, 4) AS risk FROM u""")
def engagement(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"))
    score, risk = scoring.engagement(F.col("n"), F.col("f"))
    return u.select("user_id", score.alias("engagement"), risk.alias("risk"))


@query("""WITH x AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS v FROM customer UNION ALL SELECT 'c_name', CASE WHEN c_acctbal > 0 THEN 'Known' END FROM customer), n AS (SELECT "column", v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS share, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k FROM n),
b AS (SELECT "column", count(*) FILTER (v IS NULL) AS fillable_rows FROM x GROUP BY 1) SELECT "column", v AS value, n, round(share, 4) AS share, fillable_rows FROM m JOIN b USING ("column") WHERE k = 1 AND share >= 0.6 AND fillable_rows > 0""")
def backfill_suggestions(s, d):
    rows = table(s, d, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") > 0, "Known").alias("c_name"))
    return quality.backfill_plan(rows, ["c_mktsegment", "c_name"])


@query(f"""SELECT max(ts) AS newest, round((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts)))) / 60, 2) AS age_minutes, (epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts)))) / 60 > 60 AS stale FROM events WHERE ts <= TIMESTAMP '{NOW}'""")
def sync_freshness(s, d):
    return jobs.freshness(table(s, d, "events").where(F.col("ts") <= now()), "ts", now(), 60)


# --- upserts and streams ----------------------------------------------------------------------------------------------


@query("""WITH cur AS (SELECT event_id, user_id, value FROM events WHERE event_type <> 'signup'), b AS (SELECT event_id, max(user_id + 1) AS user_id, max(value + 1) AS value FROM events WHERE value > 50 GROUP BY 1) SELECT * FROM cur WHERE event_id NOT IN (SELECT event_id FROM b) UNION ALL SELECT * FROM b""")
def upserted(s, d):
    e = table(s, d, "events")
    batch = e.where("value > 50").select("event_id", (F.col("user_id") + 1).alias("user_id"), (F.col("value") + 1).alias("value"))
    return sinks.upserted(e.where("event_type != 'signup'").select("event_id", "user_id", "value"), batch, ["event_id"], [F.desc("value")])


@query("""WITH b AS (SELECT event_id // 2 AS k, value FROM events), c AS (SELECT event_id AS k FROM events WHERE event_type = 'click') SELECT count(DISTINCT k) FILTER (value >= 5 AND k NOT IN (FROM c)) AS inserted, count(DISTINCT k) FILTER (value >= 5 AND k IN (FROM c)) AS updated,
count(*) FILTER (value >= 5) - count(DISTINCT k) FILTER (value >= 5) AS skipped, count(*) FILTER (NOT value >= 5) AS errors FROM b""")
def upsert_counts(s, d):
    e = table(s, d, "events")
    batch = e.select(F.floor(F.col("event_id") / 2).alias("k"), "value")
    return sinks.upsert_counts(e.where("event_type = 'click'").select(F.col("event_id").alias("k")), batch, ["k"], F.col("value") >= 5)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def hourly_windows(s, d):
    return jobs.tumbling(table(s, d, "events"), "ts", "1 hour", {"n": F.count("*"), "total": r(F.sum("value"), 2)}, keys=["event_type"]).drop("end")


@query("""WITH w AS (SELECT user_id, ts, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (i) HOUR AS start FROM events, range(0, 6) t(i) WHERE event_type = 'error') SELECT start, user_id, count(*) AS failures FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def failure_bursts(s, d):
    return jobs.bursts(table(s, d, "events"), ["user_id"], "ts", F.col("event_type") == "error", 2, "6 hours", "1 hour").select("start", "user_id", "failures")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM h GROUP BY user_id, k""")
def user_sessions(s, d):
    return jobs.sessions(table(s, d, "events"), "user_id", "ts", "6 hours").drop("end")


@query(f"""SELECT count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS events_hour, count(DISTINCT user_id) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS users_hour, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND event_type = 'error') AS failed_hour,
count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS events_day, count(DISTINCT user_id) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS users_day, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND event_type = 'error') AS failed_day FROM events WHERE ts <= TIMESTAMP '{NOW}'""")
def kpi_snapshot(s, d):
    return jobs.kpi_snapshot(table(s, d, "events"), "ts", now(), {"hour": 60, "day": 1440}, "user_id", F.col("event_type") == "error")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR")
def incremental_pull(s, d):
    return readers.incremental(table(s, d, "events"), "ts", now()).select("event_id")


@query("""SELECT user_id AS person, ts AS event_time, 'IN' AS event_type FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts + INTERVAL 2 HOUR, 'OUT' FROM events WHERE event_type = 'click'""")
def two_column_source(s, d):
    rows = table(s, d, "events").where("event_type = 'click'").withColumn("out", F.expr("ts + interval 2 hours"))
    return readers.two_column_view(rows, "user_id", "ts", "out", {})


# --- usage by feature, richest records, ladders of limits ---------------------------------------------------------------


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS uses, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 2) AS uses_a_user, round(count(*) FILTER (value < 90) * 100.0 / count(*), 2) AS success_rate, CASE WHEN count(*) > 10 THEN 'growing' ELSE 'stable' END AS trend FROM events GROUP BY 1, 2""")
def feature_usage(s, d):
    return business.feature_usage(table(s, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", F.col("value") < 90)


@query("""WITH x AS (SELECT upper(trim(p_name)) AS key, p_partkey, p_size, p_retailprice, row_number() OVER (PARTITION BY upper(trim(p_name)) ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS k FROM part WHERE trim(p_name) <> '')
SELECT key, max(p_partkey) FILTER (k = 1) AS p_partkey, max(p_size) FILTER (k = 1) AS p_size, round(max(p_retailprice) FILTER (k = 1), 2) AS p_retailprice, min(p_partkey) AS first_page, max(p_partkey) AS last_page, count(*) AS merged FROM x GROUP BY 1""")
def richest_parts(s, d):
    parts = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    return business.keep_richest(parts, F.trim("p_name"), ["p_size", "p_retailprice"], "p_partkey", "p_partkey").withColumn("p_retailprice", r(F.col("p_retailprice"), 2)).drop("p_name")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_discount * 100 AS ll, l_tax * 100 AS l, l_quantity AS h, l_extendedprice / 1000 AS hh, CAST(l_linenumber AS DOUBLE) AS lo, l_quantity * 2 AS hi FROM lineitem)
SELECT line, 'order' AS rule, 'll<=l' AS "column", 'error' AS severity FROM x WHERE ll > l UNION ALL SELECT line, 'order', 'l<=h', 'error' FROM x WHERE l > h UNION ALL SELECT line, 'order', 'h<=hh', 'error' FROM x WHERE h > hh
UNION ALL SELECT line, 'order', 'll<=hh', 'error' FROM x WHERE ll > hh UNION ALL SELECT line, 'order', 'lo<=hi', 'error' FROM x WHERE lo > hi UNION ALL SELECT line, 'below', 'll>=lo', 'warning' FROM x WHERE ll < lo UNION ALL SELECT line, 'above', 'hh<=hi', 'warning' FROM x WHERE hh > hi""")
def limit_findings(s, d):
    x = table(s, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as line", "l_discount * 100 as ll", "l_tax * 100 as l", "l_quantity as h", "l_extendedprice / 1000 as hh", "cast(l_linenumber as double) as lo", "l_quantity * 2 as hi")
    return quality.findings(x, "line", [*quality.rising("ll", "l", "h", "hh"), *quality.inside("ll", "hh", "lo", "hi")])


@query("""WITH f AS (SELECT user_id, min(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS sec FROM events GROUP BY user_id, CAST(ts AS DATE)), m AS (SELECT user_id, CAST(floor(avg(sec)) AS BIGINT) AS sec FROM f GROUP BY 1) SELECT user_id, printf('%02d:%02d', sec // 3600, sec % 3600 // 60) AS mean_first FROM m""")
def mean_clock(s, d):
    first = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(dates.second_of_day(F.col("ts"))).alias("sec"))
    return first.groupBy("user_id").agg(dates.clock(F.avg("sec")).alias("mean_first"))


@query("""WITH x AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn > 2) AS c, count(*) FILTER (role = 'user') AS u, avg(length(text)) AS m FROM conversations GROUP BY 1)
SELECT conv_id, round(least(100, CASE WHEN n > 50 THEN 30 WHEN n > 20 THEN 20 WHEN n > 10 THEN 10 ELSE 0 END + c / n * 25 + u / n * 25 + CASE WHEN m > 200 THEN 20 WHEN m > 100 THEN 10 ELSE 0 END), 2) AS complexity FROM x""")
def conversation_complexity(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("turn") > 2).alias("c"), F.count_if(F.col("role") == "user").alias("u"), F.avg(F.length("text")).alias("m"))
    return x.select("conv_id", scoring.complexity(F.col("n"), F.col("c"), F.col("u"), F.col("m")).alias("complexity"))
