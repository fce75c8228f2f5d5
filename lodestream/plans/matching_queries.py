"""Queries of similarity joins, greedy choices, circles, revisions and refreshed views, each beside SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import graph, quantiles, reconcile, revisions, similarity
from lodestream.plans.queries import catalogue, query, r
from lodestream.sources.parted import shared_folder
from lodestream.sources.readers import table
from lodestream.sources.views import View

RATIO_SQL = "1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t))"


# --- similarity joins ---------------------------------------------------------------------------------------------------


@query(f"""WITH u AS (SELECT lower(trim(url)) AS t, min(page_id) AS i FROM pages GROUP BY 1) SELECT x.i AS page_id, y.i AS other_id, round({RATIO_SQL}, 4) AS score FROM u x JOIN u y ON x.i < y.i WHERE {RATIO_SQL} >= 0.9""")
def similar_urls(s, d):
    """All pairs of addresses that nearly agree, without a block key."""
    urls = table(s, d, "pages").groupBy(F.lower(F.trim("url")).alias("text")).agg(F.min("page_id").alias("id"))
    return similarity.similar_pairs(urls, None, 0.9).select(F.col("a").alias("page_id"), F.col("b").alias("other_id"), r(F.col("score")).alias("score"))


@query("""WITH w AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda e: e <> '')) AS t FROM pages)
SELECT x.page_id AS page_id, y.page_id AS other_id, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 4) AS score FROM w x JOIN w y ON x.page_id < y.page_id
WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.7""")
def urls_of_like_words(s, d):
    urls = table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    return similarity.similar_pairs(urls, None, 0.7, "words").select(F.col("a").alias("page_id"), F.col("b").alias("other_id"), r(F.col("score")).alias("score"))


SPELT_SQL = "a AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY 1, 2), b AS (SELECT k AS q, p_brand, translate(p_name, 'i', 'e') AS n FROM a)"


@query(f"""WITH RECURSIVE {SPELT_SQL},
z AS (SELECT p_brand, k, q, p_name, n, 1 - levenshtein(p_name, n) / greatest(length(p_name), length(n)) AS score FROM a JOIN b USING (p_brand)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name, n, k, q) AS i FROM z WHERE score >= 0.6),
g(p_brand, i, ua, ub, hit) AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM o
UNION ALL SELECT g.p_brand, o.i, CASE WHEN list_contains(ua, k) OR list_contains(ub, q) THEN ua ELSE list_append(ua, k) END, CASE WHEN list_contains(ua, k) OR list_contains(ub, q) THEN ub ELSE list_append(ub, q) END,
NOT (list_contains(ua, k) OR list_contains(ub, q)) FROM g JOIN o ON o.p_brand = g.p_brand AND o.i = g.i + 1)
SELECT k AS left_id, q AS right_id, round(score, 4) AS score FROM g JOIN o USING (p_brand, i) WHERE hit""")
def greedy_pairs_by_edits(s, d):
    """One-to-one pairs of a brand's names, the best remaining pair first."""
    _, sides = catalogue(s, d)
    a, b = sides("p_brand")
    return similarity.greedy_pairs(a, b, "k", "q", "p_name", "n", (F.col("p_brand"), F.col("b")), 0.6, "edits")


@query(f"""WITH RECURSIVE u AS (SELECT url AS t, first(page_id ORDER BY length(html) DESC, page_id) AS i, max(length(html)) AS rich FROM pages GROUP BY 1),
o AS MATERIALIZED (SELECT t, i, row_number() OVER (ORDER BY rich DESC, i) AS k FROM u), near AS MATERIALIZED (SELECT y.k AS k, list(x.k) AS ns FROM o x JOIN o y ON x.k < y.k WHERE {RATIO_SQL} >= 0.9 GROUP BY 1),
g(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT g.k + 1, CASE WHEN list_has_any(kept, coalesce(ns, CAST([] AS BIGINT[]))) THEN kept ELSE list_append(kept, g.k + 1) END FROM g LEFT JOIN near ON near.k = g.k + 1 WHERE g.k < (SELECT max(k) FROM o))
SELECT i AS page_id FROM o WHERE list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), k)""")
def richest_urls(s, d):
    """Of pages with equal and then with nearly equal addresses, the one with the most content, from the richest down."""
    pages = table(s, d, "pages")
    return similarity.fuzzy_dedup(pages, "page_id", F.col("url"), "url", None, F.length("html"), 0.9, "edits").select("page_id")


COMMENT_KEY_SQL = """k0 AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^[.,!?;:\\-]+|[.,!?;:\\-]+$', '', 'g') AS t FROM documents WHERE length(trim(text)) >= 5),
k AS (SELECT doc_id, t FROM k0 WHERE length(t) >= 5)"""


@query(f"""WITH RECURSIVE {COMMENT_KEY_SQL}, u AS (SELECT t, min(doc_id) AS i FROM k GROUP BY 1), o AS MATERIALIZED (SELECT i, left(t, 150) AS h, least(length(t), 150) AS n, row_number() OVER (ORDER BY i) AS k FROM u),
c AS (SELECT k, n, unnest(range(1, n + 1)) AS p, unnest(list_transform(range(1, n + 1), lambda e: substr(h, e, 1))) AS ch FROM o),
m AS (SELECT y.k AS k, x.k AS x, count(*) AS same, max(greatest(x.n, y.n)) AS longer FROM c x JOIN c y ON x.p = y.p AND x.ch = y.ch AND x.k < y.k GROUP BY 1, 2),
near AS MATERIALIZED (SELECT k, list(x) AS ns FROM m WHERE (longer - same) * 10 <= longer GROUP BY 1),
g(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT g.k + 1, CASE WHEN list_has_any(kept, coalesce(ns, CAST([] AS BIGINT[]))) THEN kept ELSE list_append(kept, g.k + 1) END FROM g LEFT JOIN near ON near.k = g.k + 1 WHERE g.k < (SELECT max(k) FROM o))
SELECT i AS doc_id FROM o WHERE list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), k)""")
def distinct_comments(s, d):
    """Documents read as comments, in order: what a reader would keep who drops all that opens like one kept before."""
    return similarity.distinct_comments(table(s, d, "documents"), "doc_id", "text", F.col("doc_id")).select("doc_id")


@query(f"""WITH {SPELT_SQL}, l AS (SELECT p_partkey AS left_id, p_name AS t, lower(trim(p_name)) AS f FROM part), b2 AS (SELECT q, n AS t, lower(trim(n)) AS f FROM b),
e AS (SELECT left_id, min(q) AS right_id, 'name' AS matched_by FROM l JOIN b2 ON l.t = b2.t GROUP BY 1),
wl AS (SELECT DISTINCT f, list_distinct(regexp_split_to_array(f, '[^a-z0-9]+')) AS w FROM l WHERE left_id NOT IN (SELECT left_id FROM e)), wb AS (SELECT f, min(q) AS q, list_distinct(regexp_split_to_array(f, '[^a-z0-9]+')) AS w FROM b2 GROUP BY 1),
zw AS (SELECT wl.f AS f, q, len(list_intersect(wl.w, wb.w)) / len(list_distinct(list_concat(wl.w, wb.w))) AS score FROM wl, wb), mw AS (SELECT f, q, score FROM zw WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY f ORDER BY score DESC, q) = 1),
w AS (SELECT left_id, q AS right_id, 'words:' || printf('%.2f', score) AS matched_by FROM l JOIN mw USING (f) WHERE left_id NOT IN (SELECT left_id FROM e)),
zt AS (SELECT x.f AS f, q, 1 - levenshtein(x.f, y.f) / greatest(length(x.f), length(y.f)) AS score FROM wl x, wb y WHERE x.f NOT IN (SELECT f FROM mw)), mt AS (SELECT f, q, score FROM zt WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY f ORDER BY score DESC, q) = 1),
t AS (SELECT left_id, q AS right_id, 'text:' || printf('%.2f', score) AS matched_by FROM l JOIN mt USING (f) WHERE left_id NOT IN (SELECT left_id FROM e))
SELECT * FROM e UNION ALL SELECT * FROM w UNION ALL SELECT * FROM t""")
def cascade_of_texts(s, d):
    """Part names against another hand's: equal, then by common words, then by the whole text."""
    part, sides = catalogue(s, d)
    _, theirs = sides("p_brand")
    exact = [("name", F.col("p_name"), F.col("n"))]
    return reconcile.cascade_match(part, theirs, "p_partkey", "q", exact, ("p_name", "n"), 0.3, 0.7, "edits")


VARIED_SQL = """a AS (SELECT l_orderkey, CAST(CAST(sum(l_quantity) AS DECIMAL(20, 6)) AS DECIMAL(20, 6)) AS h, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 6))) AS DECIMAL(20, 6)) AS p FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1),
b AS (SELECT l_orderkey, CASE WHEN count(*) > 3 THEN CAST(sum(l_quantity) AS DECIMAL(20, 6)) END AS h, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 6))) AS DECIMAL(20, 6)) AS p FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, 'hours' AS field, a.h AS x, b.h AS y FROM a JOIN b USING (l_orderkey) UNION ALL SELECT l_orderkey, 'pay', a.p, b.p FROM a JOIN b USING (l_orderkey)),
d AS (SELECT *, round(y - x, 2) AS diff, CAST(round(abs(round(y - x, 2)) * 100 / abs(CASE WHEN x <> 0 THEN x WHEN y <> 0 THEN y ELSE 1 END), 2) AS DOUBLE) AS pct FROM f),
v AS (SELECT l_orderkey, field, CAST(x AS DOUBLE) AS mine, CAST(y AS DOUBLE) AS theirs, CAST(diff AS DOUBLE) AS diff, pct, CASE WHEN y IS NULL THEN 'info' WHEN x IS NULL THEN 'warning' WHEN pct >= 10 THEN 'critical' WHEN pct >= 2 THEN 'warning' ELSE 'info' END AS severity FROM d
WHERE NOT coalesce(CASE WHEN field = 'hours' THEN abs(diff) <= 2 ELSE abs(diff) <= 1 AND pct <= 0.5 END, false))"""


def varied(s, d):
    """Orders without their seventh line, against whole ones that lack the quantity where they are short."""
    amount = lambda c: F.col(c).cast("decimal(20,6)")
    sums = lambda df, h: df.groupBy("l_orderkey").agg(h.alias("hours"), F.sum(amount("l_extendedprice")).alias("pay"))
    li = table(s, d, "lineitem")
    mine, theirs = sums(li.where("l_linenumber <= 6"), F.sum(amount("l_quantity"))), sums(li, F.when(F.count("*") > 3, F.sum(amount("l_quantity"))))
    return reconcile.field_variances(mine, theirs, ["l_orderkey"], {"hours": "hours", "pay": "currency"})


@query(f"WITH {VARIED_SQL} SELECT l_orderkey, field, mine, theirs, diff, severity FROM v")
def field_variances(s, d):
    return varied(s, d).drop("pct")


@query(f"WITH {VARIED_SQL} SELECT field, count(*) AS variances, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM v GROUP BY 1")
def variance_counts(s, d):
    return reconcile.variance_counts(varied(s, d))


# --- circles ------------------------------------------------------------------------------------------------------------

TRADE_SQL = """f AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2),
t(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM t JOIN e ON b = src),
root AS (SELECT x.a AS id, min(x.b) AS root FROM t x JOIN t y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(*) > 1),
i AS (SELECT src, dst FROM e JOIN root p ON p.id = src JOIN root q ON q.id = dst WHERE p.root = q.root AND src <> dst),
step(id, n) AS (SELECT DISTINCT root, 0 FROM root UNION SELECT dst, n + 1 FROM step JOIN i ON id = src WHERE n < 30),
away AS (SELECT id, min(n) AS n FROM step GROUP BY 1),
closing AS (SELECT src, dst FROM i JOIN away p ON p.id = src JOIN away q ON q.id = dst WHERE q.n < p.n OR (q.n = p.n AND dst < src) UNION ALL SELECT src, dst FROM e WHERE src = dst)"""


def trade(s, d):
    """From each nation to the two that supply it most."""
    li, o, c, p = (table(s, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    flows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_suppkey") == F.col("s_suppkey"))
    counted = flows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return counted.withColumn("_k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("_k <= 2").select("src", "dst")


@query(f"WITH RECURSIVE {TRADE_SQL} SELECT id, root FROM root")
def trade_circles(s, d):
    return graph.circles(trade(s, d))


@query(f"WITH RECURSIVE {TRADE_SQL} SELECT src, dst FROM closing")
def closing_edges(s, d):
    return graph.closing_edges(trade(s, d))


@query(f"""WITH RECURSIVE {TRADE_SQL}, rest AS (SELECT src, dst FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM closing)),
long(id, layer) AS (SELECT n_nationkey, 0 FROM nation UNION SELECT dst, layer + 1 FROM long JOIN rest ON id = src) SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM long GROUP BY 1""")
def layers_without_circles(s, d):
    return graph.layers(table(s, d, "nation").select(F.col("n_nationkey").alias("id")), trade(s, d), open_circles=True)


# --- revisions ----------------------------------------------------------------------------------------------------------

REVISED_SQL = """v AS (SELECT conv_id, turn, role, text, CASE WHEN turn < 2 THEN chr(CAST(65 + turn AS INTEGER)) WHEN turn % 5 = 4 THEN CAST(turn AS VARCHAR) || 'a' ELSE CAST(turn * 4 AS VARCHAR) END AS rev FROM conversations),
k AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(upper(text), '[,\\s;/]+'), lambda e: e <> '')) AS tags, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn < 2 THEN 0 WHEN turn % 5 = 4 THEN 2 ELSE 1 END, CASE WHEN turn < 2 OR turn % 5 <> 4 THEN turn END, upper(rev), turn) AS place FROM v),
l AS (SELECT *, lag(tags) OVER w AS old, lag(role) OVER w AS was FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
c AS (SELECT *, CASE WHEN old IS NULL THEN 0 ELSE len(list_filter(tags, lambda e: NOT list_contains(old, e))) END AS added, CASE WHEN old IS NULL THEN 0 ELSE len(list_filter(old, lambda e: NOT list_contains(tags, e))) END AS removed FROM l)"""


@query(f"""WITH {REVISED_SQL} SELECT CAST(conv_id AS VARCHAR) AS document, rev AS revision, CAST(place AS INTEGER) AS place, CAST(len(tags) AS INTEGER) AS tag_count, CAST(added AS INTEGER) AS n_added, CAST(removed AS INTEGER) AS n_removed,
concat_ws('; ', CASE WHEN added > 0 THEN '+' || added || CASE WHEN added = 1 THEN ' new tag' ELSE ' new tags' END END, CASE WHEN removed > 0 THEN '-' || removed || ' removed' END, CASE WHEN was <> role THEN 'status ' || was || ' → ' || role END, CASE WHEN was IS NOT NULL AND was <> role THEN 'title updated' END) AS summary FROM c""")
def revision_changes(s, d):
    """Turns of a conversation as revisions A, B, then numbers, then mixed names, whose order sorting by text gets wrong."""
    turn = F.col("turn")
    name = F.when(turn < 2, F.chr((turn + 65).cast("long"))).when(turn % 5 == 4, F.concat(turn.cast("string"), F.lit("a"))).otherwise((turn * 4).cast("string"))
    docs = table(s, d, "conversations").withColumn("rev", name)
    out = revisions.revision_timeline(docs, "conv_id", "rev", ["text"], "role", "role", "turn")
    return out.select("document", "revision", "place", "tag_count", F.size("added_tags").alias("n_added"), F.size("removed_tags").alias("n_removed"), "summary")


# --- quantiles and views ------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def price_quantiles(s, d):
    """Exact quantiles by distributed selection: with this limit no buffer holds more than 500 values, at any size of the table."""
    out = quantiles.exact_quantiles(table(s, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), [0.05, 0.5, 0.99], ["p05", "p50", "p99"], limit=500)
    return out.select("l_returnflag", *[r(F.col(c)).alias(c) for c in ("p05", "p50", "p99")])


@query("""WITH n AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_custkey, 'P', o_totalprice * 2 FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most FROM n GROUP BY 1, 2""")
def refreshed_view(s, d):
    """A view of all orders, refreshed after low ones were deleted and urgent ones were entered twice as dear."""
    orders = table(s, d, "orders")
    columns = ["o_custkey", "o_orderstatus", "o_totalprice"]
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.lit("P").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    low, kept = orders.where("o_orderpriority = '5-LOW'").select(*columns), orders.where("o_orderpriority <> '5-LOW'").select(*columns)
    measures = {"total": ("sum", "o_totalprice"), "mean": ("avg", "o_totalprice"), "least": ("min", "o_totalprice"), "most": ("max", "o_totalprice")}
    view = View(f"{shared_folder(s)}/lodestream-view-{uuid.uuid4().hex}", ["o_custkey", "o_orderstatus"], measures)
    view.create(orders.select(*columns))
    view.refresh(urgent, low, kept.unionByName(urgent))
    return view.read(s, orders.select(*columns)).select("o_custkey", "o_orderstatus", "rows", *[r(F.col(c), 6 if c == "mean" else 2).alias(c) for c in measures])
