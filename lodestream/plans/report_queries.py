"""Further queries over the test tables, each beside SQL that gives the same rows: reports, visibility, periods, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import reports
from lodestream.operators.transform import execute
from lodestream.plans.queries import NOW, now, query, r
from lodestream.sources.readers import table


def half_up(c, n=2):
    return F.round(c.cast("decimal(30,10)"), n).cast("double")


ACTIONS_SQL = """a AS (SELECT user_id, event_type AS feature, substr(event_type, 1, 1) AS module, event_type <> 'error' AS success, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, event_type = 'view' AS ai, value / 100 AS cost FROM events)"""
REPORT_SQL = """count(*) AS total_actions, count(*) FILTER (ai) AS total_ai_requests, round(coalesce(sum(cost) FILTER (ai), 0), 4) AS total_ai_cost_usd, count(DISTINCT feature) AS distinct_features,
count(DISTINCT module) AS distinct_modules, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_rate_pct, CAST(floor(sum(duration_ms) / 60000) AS BIGINT) AS session_minutes"""


def actions(s, d):
    kind = F.col("event_type")
    return table(s, d, "events").select(
        "user_id", kind.alias("feature"), F.substring(kind, 1, 1).alias("module"), (kind != "error").alias("success"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), (kind == "view").alias("ai"), (F.col("value") / 100).alias("cost")
    )


def reported(s, d, *by):
    out = reports.report(actions(s, d), list(reports.metrics()), by)
    return out.withColumns({c: r(F.col(c)) for c in ("total_ai_cost_usd", "success_rate_pct")})


@query(f"WITH {ACTIONS_SQL} SELECT {REPORT_SQL} FROM a")
def summary_report(s, d):
    return reported(s, d)


@query(f"WITH {ACTIONS_SQL} SELECT user_id, {REPORT_SQL} FROM a GROUP BY 1")
def user_report(s, d):
    return reported(s, d, "user_id")


@query(f"WITH {ACTIONS_SQL} SELECT module, feature, {REPORT_SQL} FROM a GROUP BY 1, 2")
def feature_report(s, d):
    return reported(s, d, "module", "feature")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status FROM events) SELECT event_id, status, status < 400 AS success FROM l""")
def request_log(s, d):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 201).otherwise(200)
    return table(s, d, "events").select("event_id", status.alias("status")).withColumn("success", F.col("status") < 400)


@query("""SELECT p_partkey, p_size, p_name FROM part WHERE p_size = 7 OR lower(p_name) = 'red bolt' OR regexp_matches(p_name, '(?i)^blue.*ring$')""")
def t_filter_mixed_types(s, d):
    conditions = [
        {"column": "p_size", "operator": "equals", "value": 7}, {"column": "p_name", "operator": "iexact", "value": "RED Bolt"}, {"column": "p_name", "operator": "iregex", "value": "^BLUE.*ring$"},
        {"column": "p_name", "operator": "equals", "value": 7}, {"column": "p_size", "operator": "equals", "value": "abc"}, {"column": "p_name", "operator": "in_list", "value": [1, 2]},
        {"column": "p_size", "operator": "greater_than", "value": "x"},
    ]
    return execute("filter", table(s, d, "part"), {"conditions": conditions, "logic": "or"}).select("p_partkey", "p_size", "p_name")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'""")
def not_deleted_orders(s, d):
    return reports.not_deleted(table(s, d, "orders"), F.col("o_orderstatus") == "P").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)""")
def owned_or_joined(s, d):
    return reports.owned_or_joined(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_custkey") == 7, F.col("l_suppkey") == 7).select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def value_list(s, d):
    return reports.values_of(table(s, d, "part"), "p_type")


@query("""SELECT n_name, coalesce(string_agg(DISTINCT s_name, ',' ORDER BY s_name), '') AS suppliers, count(DISTINCT s_name) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def nested_suppliers(s, d):
    out = reports.nested(table(s, d, "nation"), table(s, d, "supplier"), "n_nationkey", "s_nationkey", ["s_name"], "suppliers")
    return out.select("n_name", F.array_join(F.transform("suppliers", lambda x: x["s_name"]), ",").alias("suppliers"), F.size("suppliers").cast("long").alias("n"))


CHAIN = """SELECT r_name, n_name, count(*) AS items, count(DISTINCT p_brand) AS brands, count(s_name) AS named, round(sum(l_extendedprice), 2) AS total
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY r_name, n_name"""


@query(CHAIN)
def joined_chain(s, d):
    names = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")
    sql = CHAIN
    for name in names:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return s.sql(sql, **{name: table(s, d, name) for name in names})


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 1 THEN l_suppkey END AS l_suppkey FROM lineitem), k AS (SELECT l_partkey, min(l_suppkey) AS m FROM x GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(l_suppkey, m) AS l_suppkey FROM x LEFT JOIN k USING (l_partkey)""")
def backfilled_keys(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("l_suppkey"))
    return reports.backfilled(x, x, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def above_mean(s, d):
    return s.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", orders=table(s, d, "orders"))


@query("""WITH v AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) SELECT c_mktsegment, y, count(*) AS customers, round(sum(total), 2) AS total FROM v JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def viewed_totals(s, d):
    v = s.sql("SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1, 2", orders=table(s, d, "orders"))
    return s.sql("SELECT c_mktsegment, CAST(y AS BIGINT) AS y, count(*) AS customers, round(sum(total), 2) AS total FROM {v} JOIN {customer} ON c_custkey = o_custkey GROUP BY 1, 2", v=v, customer=table(s, d, "customer"))


@query("""WITH u AS (SELECT event_type, user_id, CAST(round(CAST(avg(value) AS DECIMAL(30, 10)), 1) AS DOUBLE) AS m, count(*) AS n, sum(value) AS t FROM events GROUP BY 1, 2) SELECT event_type, round(sum(m * n) / sum(n), 4) AS weighted_mean, round(sum(t) / sum(n), 4) AS exact_mean FROM u GROUP BY 1""")
def weighted_means(s, d):
    u = table(s, d, "events").groupBy("event_type", "user_id").agg(half_up(F.avg("value"), 1).alias("m"), F.count("*").alias("n"), F.sum("value").alias("t"))
    return u.groupBy("event_type").agg(r(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted_mean"), r(F.sum("t") / F.sum("n")).alias("exact_mean"))


@query("""WITH u AS (SELECT CAST(o_orderdate AS DATE) AS day, 'order' AS kind FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 'item' FROM lineitem) SELECT day, count(*) AS n, count(*) FILTER (kind = 'order') AS orders, count(*) FILTER (kind = 'item') AS items FROM u GROUP BY 1""")
def two_sources_per_day(s, d):
    side = lambda name, c, kind: table(s, d, name).select(F.to_date(c).alias("day"), F.lit(kind).alias("kind"))
    both = side("orders", "o_orderdate", "order").unionByName(side("lineitem", "l_shipdate", "item"))
    return both.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "order").alias("orders"), F.count_if(F.col("kind") == "item").alias("items"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_overall(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("""WITH x AS (SELECT event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM x GROUP BY 1""")
def sliced_then_counted(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("""SELECT user_id, max(event_type) AS largest_kind, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_kind FROM events GROUP BY 1""")
def last_kinds(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("event_type").alias("largest_kind"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))


def day_series_sql(last: str) -> str:
    return f"""SELECT CAST(g AS DATE) AS day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = CAST(g AS DATE)) AS n FROM generate_series(DATE '2024-01-11', DATE '{last}', INTERVAL 1 DAY) t(g)"""


@query(day_series_sql("2024-01-24"))
def daily_series(s, d):
    return reports.trailing_days(table(s, d, "events"), F.to_date("ts"), F.lit("2024-01-25").cast("date"), 14)


@query(day_series_sql("2024-01-25"))
def daily_series_with_today(s, d):
    return reports.trailing_days(table(s, d, "events"), F.to_date("ts"), F.lit("2024-01-25").cast("date"), 14, include_today=True)


@query("""WITH i AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) SELECT o_custkey, round(sum(o_totalprice), 2) AS total, CAST(coalesce(sum(items), 0) AS BIGINT) AS items FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1""")
def parent_totals(s, d):
    items = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    joined = table(s, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


@query("""WITH u AS (SELECT c_mktsegment, user_id, count(DISTINCT event_type) AS kinds FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2), t AS (SELECT c_mktsegment, count(DISTINCT event_type) AS all_kinds FROM events JOIN customer ON c_custkey = user_id GROUP BY 1)
SELECT c_mktsegment, max(kinds) AS most_of_a_user, max(all_kinds) AS all_kinds FROM u JOIN t USING (c_mktsegment) GROUP BY 1""")
def department_kinds(s, d):
    e = table(s, d, "events").join(table(s, d, "customer"), F.col("c_custkey") == F.col("user_id")).select("c_mktsegment", "user_id", "event_type").distinct()
    most = e.groupBy("c_mktsegment", "user_id").agg(F.count("*").alias("kinds")).groupBy("c_mktsegment").agg(F.max("kinds").alias("most_of_a_user"))
    return most.join(e.groupBy("c_mktsegment").agg(F.count_distinct("event_type").alias("all_kinds")), "c_mktsegment")


MONTHS = """m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"""


def month_totals(s, d):
    return table(s, d, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {MONTHS} SELECT a.o_custkey, a.month, a.total, coalesce(b.total, 0) AS previous_total FROM m a LEFT JOIN m b ON a.o_custkey = b.o_custkey AND a.month = b.month + INTERVAL 1 MONTH""")
def carried_forward(s, d):
    return reports.with_previous(month_totals(s, d), ["o_custkey"], "month", ["total"])


SLIPS = """e AS (SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(20, 6)) AS earned, CAST(count(*) AS DECIMAL(20, 6)) AS hours FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1998-05-01' GROUP BY 1),
a AS (SELECT c_custkey AS o_custkey, CAST(sum(c_acctbal / 10) AS DECIMAL(20, 6)) AS adjusted FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1),
c AS (SELECT o_custkey, CAST(sum(o_totalprice * 0.01) AS DECIMAL(20, 6)) AS carried FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1998-04-01' GROUP BY 1),
j AS (SELECT o_custkey, round(coalesce(hours, 0), 2) AS hours, round(coalesce(earned, 0), 2) AS earned, round(coalesce(adjusted, 0), 2) AS adjusted, round(coalesce(carried, 0), 2) AS carried FROM e FULL JOIN a USING (o_custkey) FULL JOIN c USING (o_custkey)),
g AS (SELECT *, earned + adjusted + carried AS gross FROM j), s AS (SELECT *, round(CAST(gross AS DECIMAL(24, 2)) * 10 / CAST(100 AS DECIMAL(5, 0)), 2) AS d0 FROM g),
slips AS (SELECT o_custkey, CAST(hours AS DOUBLE) AS hours, CAST(earned AS DOUBLE) AS earned, CAST(adjusted AS DOUBLE) AS adjusted, CAST(carried AS DOUBLE) AS carried, CAST(gross AS DOUBLE) AS gross, CAST(round(CAST(gross AS DECIMAL(24, 3)) * CAST(0.1 AS DECIMAL(2, 1)), 2) AS DOUBLE) AS deductions,
CAST(gross - round(CAST(gross AS DECIMAL(24, 3)) * CAST(0.1 AS DECIMAL(2, 1)), 2) AS DOUBLE) AS net FROM g)"""


def slips_of(s, d):
    month = lambda m: F.trunc("o_orderdate", "month") == F.lit(m).cast("date")
    orders = table(s, d, "orders")
    earned = orders.where(month("1998-05-01")).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("earned"), F.count("*").alias("hours"))
    adjusted = table(s, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 10).alias("amount"))
    carried = orders.where(month("1998-04-01")).select("o_custkey", (F.col("o_totalprice") * 0.01).alias("amount"))
    return reports.month_run(earned, adjusted, carried, "o_custkey")


@query(f"WITH {SLIPS} SELECT * FROM slips")
def month_run(s, d):
    out = slips_of(s, d)
    return out.select("o_custkey", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]])


@query(f"WITH {SLIPS} SELECT round(sum(gross), 2) AS total_gross, round(sum(deductions), 2) AS total_deductions, round(sum(net), 2) AS total_net, round(sum(hours), 2) AS total_hours, count(*) AS employees FROM slips")
def month_totals_row(s, d):
    out = reports.run_totals(slips_of(s, d))
    return out.select(*[F.round(F.col(c).cast("double"), 2).alias(c) for c in out.columns[:-1]], "employees")


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 45 AS audit, o_orderkey % 9 AS co, o_orderkey % 5 AS cc, o_orderkey % 7 AS oo, o_orderkey % 3 AS oc, (o_orderkey % 20) / 10.0 AS used, o_totalprice AS cost, o_orderkey % 101 AS kpi, o_orderkey % 97 AS done,
CASE WHEN o_orderstatus = 'P' THEN 30 WHEN o_orderstatus = 'O' THEN 0 ELSE 100 END AS plan, o_orderkey % 31 AS cd, o_orderkey % 62 AS od FROM orders)
SELECT o_orderkey, round(least(least(audit / 30, 1) * 15 + co / (co + cc + 1) * 20 + oo / (oo + oc + 1) * 10 + greatest(used - 1, 0) * 15 + least(cost / 100000, 1) * 15 + greatest(100 - kpi, 0) * 0.1 + CASE WHEN done < 90 THEN (1 - done / 100) * 2.5 ELSE 0 END + (1 - plan / 100) * 5 + least(cd / 30, 1) * 3 + least(od / 30, 1) * 2, 100), 4) AS risk FROM f""")
def project_risk(s, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "Pending").when(F.col("o_orderstatus") == "F", "rev 2")
    features = {
        "audit_delay_days": k % 45, "cars_open_ratio": reports.open_share(k % 9, k % 5), "obs_open_ratio": reports.open_share(k % 7, k % 3), "manhour_utilization": (k % 20) / 10, "quality_cost": F.col("o_totalprice"),
        "kpi_achievement": k % 101, "completion": k % 97, "quality_plan": reports.plan_score(status), "cars_delayed_days": k % 31, "obs_delayed_days": k % 62,
    }
    return table(s, d, "orders").select("o_orderkey", r(reports.project_risk(features)).alias("risk"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 40 - 3 AS float_days, o_orderkey % 19 AS days, o_orderkey % 11 = 0 AS milestone, coalesce(sf, 0) AS sf, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 7) AS sf FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
c AS (SELECT count(*) FILTER (float_days < 0) AS c1, count(*) FILTER (float_days > 21) AS c2, count(*) FILTER (NOT milestone AND days > 15) AS c3, CAST(sum(sf) AS BIGINT) AS c4, count(*) FILTER (n = 0 AND id > (SELECT min(id) FROM a)) AS c5, count(*) FILTER (milestone) AS c6 FROM a)
SELECT 'negative_float' AS rule, CASE WHEN c1 > 0 THEN 'critical' ELSE 'pass' END AS severity, c1 AS n FROM c UNION ALL SELECT 'max_total_float', CASE WHEN c2 > 0 THEN 'warning' ELSE 'pass' END, c2 FROM c UNION ALL SELECT 'level4_duration', CASE WHEN c3 > 0 THEN 'warning' ELSE 'pass' END, c3 FROM c
UNION ALL SELECT 'start_to_finish_links', CASE WHEN c4 > 0 THEN 'critical' ELSE 'pass' END, c4 FROM c UNION ALL SELECT 'missing_predecessors', CASE WHEN c5 > 0 THEN 'warning' ELSE 'pass' END, c5 FROM c UNION ALL SELECT 'milestones_present', CASE WHEN c6 = 0 THEN 'critical' ELSE 'pass' END, c6 FROM c""")
def schedule_rules(s, d):
    links = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") == 7, "SF").otherwise("FS")).alias("links"))
    k = F.col("o_orderkey")
    acts = table(s, d, "orders").join(links, k == F.col("l_orderkey"), "left").select(
        k.alias("id"), (k % 40 - 3).alias("float_days"), (k % 19).alias("duration_days"), (k % 11 == 0).alias("is_milestone"), F.coalesce("links", F.array().cast("array<string>")).alias("links")
    )
    return reports.schedule_rules(acts)


@query("""SELECT p_partkey, replace(p_name, ' ', '') AS sheet, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_partkey % 3 = 2 THEN 'n/a' ELSE CAST(p_size * 10 AS VARCHAR) END AS pressure FROM part""")
def normalised_parts(s, d):
    size = F.concat(F.when(F.col("p_partkey") % 2 == 0, "DN ").otherwise(""), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 1, '.0"').otherwise(""))
    kind = F.col("p_partkey") % 3
    rating = (F.col("p_size") * 10).cast("string")
    pressure = F.when(kind == 0, F.concat(rating, F.lit("#"))).when(kind == 1, F.concat(F.lit("PN"), rating, F.lit(" lbs"))).otherwise(" n/a ")
    return table(s, d, "part").select("p_partkey", reports.sheet_name(F.col("p_name")).alias("sheet"), reports.plain_size(size).alias("size"), reports.plain_pressure(pressure).alias("pressure"))


AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120 Safari/537 Edg/120", "Edge", "Windows", "desktop"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X) AppleWebKit Version/17 Safari/605", "Safari", "macOS", "desktop"),
    ("Mozilla/5.0 (Linux; Android 14) AppleWebKit Chrome/120 Mobile Safari/537", "Chrome", "Android", "mobile"),
    ("Mozilla/5.0 (iPad; CPU OS 17) AppleWebKit Version/17 Safari/605", "Safari", "iOS", "tablet"),
    ("curl/8.5", "Other", "Other", "desktop"),
]


@query("SELECT event_id, [" + ", ".join(f"'{a[1]}'" for a in AGENTS) + "][event_id % 5 + 1] AS browser, [" + ", ".join(f"'{a[2]}'" for a in AGENTS) + "][event_id % 5 + 1] AS system, [" + ", ".join(f"'{a[3]}'" for a in AGENTS) + "][event_id % 5 + 1] AS device FROM events")
def parsed_agents(s, d):
    agent = F.element_at(F.array(*[F.lit(a[0]) for a in AGENTS]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events").select("event_id", *[c.alias(k) for k, c in reports.agent_parts(agent).items()])


@query(f"""WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 24 HOUR THEN ts END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), l AS (SELECT user_id, max(begins) AS begun FROM b GROUP BY 1)
SELECT user_id, begun, max(ts) AS last_seen, count(*) AS activities, max(ts) + INTERVAL 24 HOUR >= TIMESTAMP '{NOW}' AS open FROM events JOIN l USING (user_id) WHERE ts >= begun GROUP BY 1, 2""")
def session_states(s, d):
    return reports.session_states(table(s, d, "events").select("user_id", "ts"), "user_id", "ts", now())
