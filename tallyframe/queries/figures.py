"""Consistency checks bound to revenue facts of nations and years."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe import prose
from tallyframe.functions import labels
from tallyframe.operators import consistency, joins, slides
from tallyframe.queries.binding import registry

QUERIES, SQL, query = registry()

FACTS = """facts AS (SELECT s_nationkey AS n, year(l_shipdate) AS y, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) / 1000000, 1) AS DOUBLE) AS rev,
CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) / 1000000, 2) AS DOUBLE) AS cost, count(*) AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""
#: Two statements of each fact; some of the second ones are off by 1, by a factor of 1000, or undated.
STATED = f"""{FACTS}, stated AS (
SELECT 2 * (n * 10000 + y) AS ord, n, 'A' || n AS place, 'FY' || y AS period, rev AS value FROM facts
UNION ALL SELECT 2 * (n * 10000 + y) + 1, n, 'B' || n, CASE WHEN (n + y) % 11 = 0 THEN NULL ELSE 'FY' || y END, CASE WHEN (n + y) % 5 = 0 THEN rev * 1000 WHEN (n + y) % 7 = 0 THEN rev + 1 ELSE rev END FROM facts)"""


def facts(t):
    price, off = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    mm = lambda x, d: F.round(F.sum(x) / 1000000, d).cast("double")
    return rows.groupBy(F.col("s_nationkey").alias("n"), F.year("l_shipdate").alias("y")).agg(mm(price * (1 - off), 1).alias("rev"), mm(price * off, 2).alias("cost"), F.count(F.lit(1)).alias("c"))


def stated(t):
    f = facts(t)
    ord_ = 2 * (F.col("n").cast("long") * 10000 + F.col("y"))
    fy = F.concat(F.lit("FY"), F.col("y").cast("string"))
    odd = lambda k: (F.col("n") + F.col("y")) % k == 0
    one = f.select(ord_.alias("ord"), "n", F.concat(F.lit("A"), F.col("n").cast("string")).alias("place"), fy.alias("period"), F.col("rev").alias("value"))
    two = f.select((ord_ + 1).alias("ord"), "n", F.concat(F.lit("B"), F.col("n").cast("string")).alias("place"), F.when(~odd(11), fy).alias("period"), F.when(odd(5), F.col("rev") * 1000).when(odd(7), F.col("rev") + 1).otherwise(F.col("rev")).alias("value"))
    both = one.unionByName(two)
    null = F.lit(None).cast("string")
    return both.select("ord", F.lit("d").alias("deck"), "place", F.col("ord").cast("string").alias("addr"), F.lit("table").alias("source"), F.lit("revenue").alias("metric"), F.col("n").cast("string").alias("scope"), "period", F.lit("level").alias("kind"), "value", F.lit(1).alias("decimals"), null.alias("quantity"), null.alias("scale"), null.alias("currency"), F.col("n").alias("slide"))


@query(f"WITH {STATED} SELECT a.ord AS one, b.ord AS other FROM stated a JOIN stated b ON a.n = b.n AND a.ord < b.ord AND (a.period IS NULL OR b.period IS NULL OR a.period = b.period)")
def tieout_pairs(t):
    return consistency.comparable_pairs(stated(t)).select(F.col("a.ord").alias("one"), F.col("b.ord").alias("other"))


@query(f"WITH {STATED} SELECT CAST(n AS VARCHAR) AS scope, count(*) AS figures, list(ord ORDER BY ord) AS ords FROM stated GROUP BY 1")
def tieout_groups(t):
    return stated(t).groupBy("scope").agg(F.count(F.lit(1)).alias("figures"), F.array_sort(F.collect_list("ord")).alias("ords"))


DATED = f"""{STATED}, d AS (SELECT * FROM stated WHERE period IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY n, period ORDER BY ord) AS r, first_value(value) OVER (PARTITION BY n, period ORDER BY ord) AS base, first_value(ord) OVER (PARTITION BY n, period ORDER BY ord) AS base_ord FROM d),
x AS (SELECT *, CASE WHEN least(abs(value), abs(base)) > 0 THEN greatest(abs(value), abs(base)) / least(abs(value), abs(base)) END AS q FROM b WHERE r > 1 AND round(value, 6) <> round(base, 6)),
k AS (SELECT *, coalesce(abs(q - 1000) / 1000 <= 0.02 OR abs(q - 100) / 100 <= 0.02, false) AS scale FROM x)"""


@query(f"WITH {DATED} SELECT CAST(n AS VARCHAR) AS scope, base_ord, ord FROM k WHERE NOT scale")
def co001_contradiction(t):
    return consistency.disagreements(stated(t).where("period IS NOT NULL"), False).select("scope", "base_ord", "ord")


@query(f"WITH {DATED} SELECT CAST(n AS VARCHAR) AS scope, base_ord, ord FROM k WHERE scale")
def co002_scale(t):
    return consistency.disagreements(stated(t).where("period IS NOT NULL"), True).select("scope", "base_ord", "ord")


MARGIN = f"""{FACTS}, m AS (SELECT n, y, rev, cost, CASE WHEN (n + y) % 6 = 0 THEN round(cost / rev * 100, 1) + 2 ELSE round(cost / rev * 100, 1) END AS stated FROM facts WHERE rev > 0)"""


@query(f"""WITH {MARGIN}, b AS (SELECT n, y, stated, CASE WHEN y % 9 = 5 THEN NULL ELSE rev END AS rev, cost FROM m),
k AS (SELECT *, cost / rev * 100 AS computed, 100 * (0.005 / abs(rev) + abs(cost) * 0.05 / (rev * rev)) + 0.05 AS bound FROM b)
SELECT n * 10000 + y AS ord, CASE WHEN rev IS NULL THEN 'unchecked' WHEN abs(computed - stated) <= bound THEN 'tied' ELSE 'finding' END AS outcome, CASE WHEN rev IS NULL THEN 'none' END AS reason, round(computed, 4) AS computed FROM k""")
def co004_margin(t):
    """Margin = cost over revenue in percent; some are stated 2 points off, one year's revenue is not stated at all."""
    f = facts(t).where("rev > 0")
    null = F.lit(None).cast("string")
    true = F.round(F.col("cost") / F.col("rev") * 100, 1)
    base = f.select("n", "y", "rev", "cost", F.when((F.col("n") + F.col("y")) % 6 == 0, true + 2).otherwise(true).alias("stated"))
    rows = base.select("n", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(d).alias("decimals"), F.lit(k).alias("kind"), F.lit(q).alias("quantity")) for i, (m, c, d, k, q) in enumerate((("margin", "stated", 1, "ratio", "%"), ("cost", "cost", 2, "level", None), ("revenue", "rev", 1, "level", None)))])).alias("f"))
    figures = rows.select((F.col("n").cast("long") * 10000 + F.col("y")).alias("ord"), F.lit("d").alias("deck"), F.concat(F.lit("T"), F.col("n").cast("string")).alias("place"), F.col("n").alias("slide"), F.col("n").cast("string").alias("scope"), F.col("y").cast("string").alias("period"), "f.metric", "f.value", "f.decimals", "f.kind", "f.quantity", null.alias("currency"))
    figures = figures.where("NOT (metric = 'revenue' AND int(period) % 9 = 5)")
    return consistency.margins(figures, "margin", ["cost"], ["revenue"]).select("ord", "outcome", "reason", F.round("computed", 4).alias("computed"))


@query(f"""WITH {FACTS}, g AS (SELECT a.n, a.y AS first, b.y AS last, a.rev AS s, b.rev AS e, CASE WHEN (a.n + a.y) % 3 = 0 THEN 4.0 ELSE round((power(b.rev / a.rev, 1.0 / (b.y - a.y)) - 1) * 100, 1) END AS stated FROM facts a JOIN facts b ON a.n = b.n AND b.y = a.y + 2 WHERE a.rev > 0 AND b.rev > 0)
SELECT n * 10000 + first AS id, CASE WHEN abs((power(e / s, 1.0 / (last - first)) - 1) * 100 - stated) <= 0.5 THEN 'tied' ELSE 'finding' END AS outcome, round((power(e / s, 1.0 / (last - first)) - 1) * 100, 3) AS computed FROM g""")
def co006_growth(t):
    f = facts(t)
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("b.y") == F.col("a.y") + 2)).where("a.rev > 0 AND b.rev > 0")
    rate = F.round((F.pow(F.col("b.rev") / F.col("a.rev"), F.lit(0.5)) - 1) * 100, 1)
    said = pairs.select((F.col("a.n").cast("long") * 10000 + F.col("a.y")).alias("id"), F.col("a.n").alias("scope"), F.col("a.y").alias("first"), F.col("b.y").alias("last"), F.when((F.col("a.n") + F.col("a.y")) % 3 == 0, 4.0).otherwise(rate).alias("value"))
    return consistency.growth(said, f.select(F.col("n").alias("scope"), F.col("y").alias("year"), F.col("rev").alias("value"))).select("id", "outcome", F.round("computed", 3).alias("computed"))


LINES = """lines AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem),
tot AS (SELECT k, max(r) + 1 AS r, sum(v) + CASE WHEN k % 12 = 0 THEN 5 ELSE 0 END AS v, count(*) AS n, sum(v) AS exact FROM lines GROUP BY k)"""


@query(f"WITH {LINES} SELECT k, CAST(r AS INTEGER) AS \"row\", CASE WHEN n >= 2 AND abs(CAST(v AS DOUBLE) - CAST(exact AS DOUBLE)) <= 0.005 * (n + 1) THEN 'tied' WHEN n >= 3 THEN 'finding' ELSE 'nothing' END AS outcome, CAST(CASE WHEN n >= 3 THEN n ELSE 0 END AS INTEGER) AS addends FROM tot")
def co003_total(t):
    """The lines of every order and a total below them, the total 5 too high where 12 divides the key."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("row"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    tot = lines.groupBy("k").agg((F.max("row") + 1).alias("row"), (F.sum("v") + F.when(F.col("k") % 12 == 0, 5).otherwise(0)).alias("v"))
    cells = lines.withColumn("is_total", F.lit(False)).unionByName(tot.withColumn("is_total", F.lit(True)))
    return consistency.totals(cells.select("k", "row", "is_total", F.col("v").cast("double").alias("value"), F.lit(2).alias("decimals")), ["k"], "row")


@query(f"""WITH {FACTS}, g AS (SELECT n, min(y) AS lo, max(y) AS hi, count(*) AS c FROM facts GROUP BY 1), s AS (SELECT f.n, sum(f.rev) FILTER (f.y > lo AND f.y < hi) AS s, sum(f.rev) FILTER (f.y = lo) AS o, max(g.c) - 2 AS ns, max(lo) AS lo FROM facts f JOIN g USING (n) GROUP BY 1)
SELECT n, CASE WHEN ns < 2 THEN 'nothing' WHEN n % 4 = 1 THEN 'finding' ELSE 'tied' END AS outcome, round(o + s, 3) AS carried FROM s""")
def co007_bridge(t):
    """Opening, steps and closing of each nation; every fourth closing is 9 off."""
    ends = Window.partitionBy("n")
    f = facts(t).withColumn("lo", F.min("y").over(ends)).withColumn("hi", F.max("y").over(ends))
    kept = f.where("y < hi").select("n", "y", F.when(F.col("y") == F.col("lo"), "opening").otherwise("step").alias("role"), F.col("rev").alias("value"))
    closing = kept.groupBy("n").agg((F.sum("value") + F.when(F.col("n") % 4 == 1, 9.0).otherwise(0.0)).alias("value")).select("n", F.lit(9999).alias("y"), F.lit("closing").alias("role"), "value")
    steps = kept.unionByName(closing).withColumn("decimals", F.lit(1))
    return consistency.bridges(steps, ["n"], "y").select("n", "outcome", F.round("carried", 3).alias("carried"))


@query(f"""WITH {FACTS} SELECT n, y, 'USDm' AS one, CASE WHEN n % 3 = 0 THEN 'USDbn' ELSE 'EURm' END AS other FROM facts WHERE n % 3 <> 1 AND NOT (n % 3 = 2 AND n % 2 = 0)""")
def co008_unit_drift(t):
    """Every fact stated in USDm and again in another unit. Of even nations the deck states the conversion to EUR."""
    f = facts(t)
    c, null = F.col, F.lit(None).cast("string")
    k = c("n") % 3
    currency, scale = F.when(k == 2, "EUR").otherwise("USD"), F.when(k == 0, "bn").otherwise("m")
    value = lambda s: F.when(s == "bn", c("rev") / 1000).otherwise(c("rev"))
    say = lambda nth, cur, s: f.select((2 * (c("n").cast("long") * 10000 + c("y")) + nth).alias("ord"), "n", "y", c("n").cast("string").alias("deck"), F.lit("revenue").alias("metric"), F.lit("").alias("scope"), F.lit("level").alias("kind"), null.alias("quantity"), c("y").cast("string").alias("period"), value(s).alias("value"), s.alias("scale"), cur.alias("currency"))
    figures = say(0, F.lit("USD"), F.lit("m")).unionByName(say(1, currency, scale))
    amount = lambda cur: F.struct(F.lit(cur).alias("currency"), F.lit("m").alias("scale"), (c("rev") * 1000000.0).alias("amount"))
    told = f.where("n % 3 = 2 AND n % 2 = 0").select(c("n").cast("string").alias("deck"), amount("EUR").alias("one"), amount("USD").alias("other"))
    unit = lambda s: F.concat(f"{s}.currency", f"{s}.scale")
    return consistency.unit_drift(figures, told).join(figures.select("ord", "n", "y"), "ord").select("n", "y", unit("first").alias("one"), unit("stated").alias("other"))


@query(f"""WITH {STATED}, d AS (SELECT *, make_date(2025, 1 + CAST(ord % 3 AS INTEGER), 1) AS d FROM stated WHERE n % 4 <> 0), f AS (SELECT *, first_value(d) OVER (PARTITION BY n, period ORDER BY ord) AS first FROM d)
SELECT ord, CAST(d AS VARCHAR) AS date, CAST(first AS VARCHAR) AS first FROM f WHERE d <> first""")
def co009_asof(t):
    """The statements of a fact as at another date than its first one; slides without a date are left out."""
    dated = stated(t).withColumn("date", F.when(F.col("slide") % 4 != 0, F.make_date(F.lit(2025), (1 + F.col("ord") % 3).cast("int"), F.lit(1)).cast("string")))
    return consistency.date_drift(dated)


CUR = "c AS (SELECT o_orderkey AS k, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'USD' END AS currency FROM orders)"


@query(f"""WITH {CUR}, n AS (SELECT o_custkey, currency, count(*) AS n FROM c WHERE currency IS NOT NULL GROUP BY 1, 2), m AS (SELECT o_custkey, min_by(currency, (-n, currency)) AS modal FROM n GROUP BY 1)
SELECT k, modal FROM c LEFT JOIN m USING (o_custkey) WHERE modal IS NULL OR currency IS NULL OR currency = modal""")
def modal_currency(t):
    k = F.col("o_orderkey") % 5
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.when(k == 1, "EUR").when(k == 2, "GBP").when(k > 2, "USD").alias("currency"))
    return joins.modal_currency(rows, ["o_custkey"]).select("k", "modal")


KIND = "f AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'level' END AS kind FROM events)"


@query(f"WITH {KIND} SELECT a.event_id, count(*) AS others FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id WHERE a.kind IS NULL GROUP BY 1")
def unread_kind(t):
    """Events as figures of their user; those of unknown kind that had counterparts."""
    c, null = F.col, F.lit(None).cast("string")
    f = t.events.where("user_id IS NOT NULL AND event_type IS NOT NULL").select("event_id", c("user_id").cast("string").alias("deck"), c("event_type").alias("metric"), F.lit("").alias("scope"), null.alias("quantity"), null.alias("period"), c("event_id").cast("string").alias("place"), F.when(c("event_id") % 7 != 0, "level").alias("kind"))
    return consistency.unread(f).select("event_id", "others")


@query(f"""WITH {STATED}, k AS (SELECT *, CASE WHEN ord % 3 = 0 THEN NULL ELSE 'level' END AS kind FROM stated)
SELECT a.ord, count(*) AS others FROM k a JOIN k b ON a.n = b.n AND a.place <> b.place AND (a.period IS NULL OR b.period IS NULL OR a.period = b.period) WHERE a.kind IS NULL GROUP BY 1""")
def unread_figures(t):
    """Statements of unknown kind, dated and undated, with how many at other places could have contradicted them."""
    return consistency.unread(stated(t).withColumn("kind", F.when(F.col("ord") % 3 != 0, F.col("kind")))).select("ord", "others")


@query("""WITH f AS (SELECT user_id, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN NULL WHEN user_id % 3 = 1 OR event_type < 'm' THEN 'level' ELSE 'count' END AS kind FROM events) SELECT user_id, max(kind) AS kind FROM f GROUP BY 1 HAVING count(DISTINCT coalesce(kind, '?')) = 1 AND max(kind) IS NOT NULL""")
def grounded_kind(t):
    """The kind of a metric where all its figures have that one; an unknown kind counts as another."""
    kind = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 2 == 0), None).when((F.col("user_id") % 3 == 1) | (F.col("event_type") < "m"), "level").otherwise("count")
    return consistency.grounded_kinds(t.events.select("user_id", kind.alias("kind")), ["user_id"])


@query("""WITH l AS (SELECT DISTINCT lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS metric FROM part) SELECT metric, CAST(row_number() OVER (ORDER BY length(metric) DESC, metric) AS INTEGER) AS position FROM l WHERE length(metric) > 2""")
def vocabulary(t):
    """Distinct specific labels, longest first."""
    words = t.part.select(labels.normalise_label(F.col("p_type")).alias("metric"))
    return labels.longest_first(labels.vocabulary(words, [], "metric"), [], "metric")


@query("""SELECT source, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'table' AS source, o_totalprice AS value FROM orders UNION ALL SELECT 'chart', value FROM events UNION ALL SELECT 'text', c_acctbal FROM customer) GROUP BY 1""")
def figures_union(t):
    rows = t.orders.select(F.lit("table").alias("source"), F.col("o_totalprice").alias("value")).unionByName(t.events.select(F.lit("chart").alias("source"), "value")).unionByName(t.customer.select(F.lit("text").alias("source"), F.col("c_acctbal").alias("value")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS one, CASE WHEN l_orderkey % 9 = 0 THEN q + 1 WHEN l_orderkey % 13 = 0 THEN NULL ELSE q END AS other FROM l WHERE l_orderkey % 9 = 0 OR l_orderkey % 13 = 0""")
def positional_diff(t):
    """A cache against its source, position by position."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    k = F.col("l_orderkey")
    changed = F.when(k % 9 == 0, F.col("l_quantity") + 1).when(k % 13 == 0, None).otherwise(F.col("l_quantity"))
    dup = t.lineitem.groupBy(*keys).agg(F.max("l_quantity").alias("l_quantity"))
    return joins.positional_differences(dup.select(*keys, F.col("l_quantity").alias("v")), dup.select(*keys, changed.alias("v")), keys, "v", 1e-9)


@query("""SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) GROUP BY 1""")
def orphan_fk(t):
    parts = t.orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(parts, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


ARCH = """m AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, CAST(floor(o_totalprice / 400) AS BIGINT) AS chars, o_orderkey % 9 AS leaves,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Agenda' WHEN '2-HIGH' THEN 'Part ' || (o_orderkey % 5) WHEN '3-MEDIUM' THEN 'Appendix B' ELSE o_orderpriority END AS title, o_orderstatus = 'F' AS has_table, o_orderkey % 7 = 0 AS has_chart, (o_orderkey % 100) / 100.0 AS share,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Section Header' WHEN o_orderkey % 13 = 0 THEN 'Cover' ELSE 'Content' END AS layout FROM orders),
c AS (SELECT *, CASE WHEN leaves = 0 THEN 'unknown' WHEN chars = 0 AND NOT has_table AND NOT has_chart THEN 'unknown'
  WHEN title = 'Agenda' THEN CASE WHEN chars <= 900 THEN 'agenda' ELSE 'content' END
  WHEN title = 'Appendix B' AND chars <= 200 AND NOT has_table AND NOT has_chart THEN 'appendix_divider'
  WHEN i = 1 AND (layout = 'Cover' OR chars <= 600) THEN 'title'
  WHEN chars <= 400 AND title LIKE 'Part %' THEN 'section_divider'
  WHEN layout = 'Section Header' AND chars <= 600 THEN 'section_divider'
  WHEN has_table AND share >= 0.3 THEN 'table_heavy' WHEN has_chart AND share >= 0.25 THEN 'chart_heavy'
  WHEN chars > 200 AND leaves >= 2 THEN 'content' ELSE 'unknown' END AS kind FROM m),
l AS (SELECT *, lag(kind) OVER (PARTITION BY o_custkey ORDER BY i) AS before FROM c),
a AS (SELECT o_custkey, i, chars, CASE WHEN kind = 'unknown' AND leaves > 0 AND chars > 200 AND before IN ('section_divider', 'appendix_divider') THEN 'content' ELSE kind END AS archetype FROM l)"""


def _archetypes(t):
    """Orders as slides of a customer's deck, measured by their own columns and classified by the library's cascade."""
    c, k = F.col, F.col("o_orderkey")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    title = F.when(c("o_orderpriority") == "1-URGENT", "Agenda").when(c("o_orderpriority") == "2-HIGH", F.concat(F.lit("Part "), (k % 5).cast("string"))).when(c("o_orderpriority") == "3-MEDIUM", "Appendix B").otherwise(c("o_orderpriority"))
    layout = F.when(k % 11 == 0, "Section Header").when(k % 13 == 0, "Cover").otherwise("Content")
    none = F.array().cast("array<string>")
    measured = t.orders.select(
        c("o_custkey").alias("deck_id"), at.alias("slide_index"), F.floor(c("o_totalprice") / 400).cast("long").alias("chars"), (k % 9).alias("leaf_count"), title.alias("title"), (c("o_orderstatus") == "F").alias("has_table"), (k % 7 == 0).alias("has_chart"),
        ((k % 100) / 100.0).alias("table_share"), ((k % 100) / 100.0).alias("chart_share"), layout.alias("layout_name"), F.lit("").alias("layout_type"), F.lit(False).alias("has_picture"), F.lit(0.0).alias("table_text"), F.lit(0.0).alias("largest_share"), F.lit("").alias("largest"),
        F.lit(False).alias("has_large"), F.lit(1).alias("texts"), F.lit("").alias("kicker"), F.lit(None).cast("double").alias("body_pt"), none.alias("signature"),
    )
    return slides.classify(measured)


@query(f"WITH {ARCH} SELECT archetype, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM a GROUP BY 1")
def archetype_case(t):
    return _archetypes(t).groupBy("archetype").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@query(f"WITH {ARCH} SELECT o_custkey, CAST(i AS INTEGER) AS i, archetype FROM a")
def lag_cascade(t):
    """Every slide with its kind; the one predicate that reads the slide before runs over the first pass's result."""
    return _archetypes(t).select(F.col("deck_id").alias("o_custkey"), F.col("slide_index").cast("int").alias("i"), "archetype")


@query("""WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, CAST(floor(o_totalprice / 1000) AS BIGINT) AS v, CAST(o_custkey % 90 AS BIGINT) AS p FROM orders),
r AS (
  SELECT k, 0 AS nth, 'revenue' AS metric, '' AS scope, 'FY' || y AS period, 'level' AS kind, CAST(v AS DOUBLE) AS value, NULL AS quantity, 'm' AS scale, 'USD' AS currency FROM o WHERE k % 4 = 0
  UNION ALL SELECT k, 1, 'revenue', '', 'FY' || (y - 1), 'level', CAST(v + p AS DOUBLE), NULL, 'm', 'USD' FROM o WHERE k % 4 = 0
  UNION ALL SELECT k, 0, 'ebitda margin', '', 'FY' || y, 'share', p + 0.5, '%', NULL, NULL FROM o WHERE k % 4 = 1
  UNION ALL SELECT k, 0, 'revenue', '', NULL, NULL, CAST(p AS DOUBLE), '%', NULL, NULL FROM o WHERE k % 4 = 2
  UNION ALL SELECT k, 0, 'revenue', 'cloud', 'FY' || y, 'change', CAST(p AS DOUBLE), '%', NULL, NULL FROM o WHERE k % 4 = 3)
SELECT k, CAST(nth AS INTEGER) AS nth, metric, scope, period, kind, value, quantity, scale, currency FROM r""")
def prose_figures(t):
    """Sentences made of an order's year and amounts, read back: bound, carried, shared and scoped numbers."""
    k, y, text = F.col("o_orderkey"), F.year("o_orderdate"), lambda c: c.cast("string")
    v, p = F.floor(F.col("o_totalprice") / 1000).cast("long"), F.col("o_custkey") % 90
    fy = lambda x: F.concat(F.lit("FY"), text(x))
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("Revenue of $"), text(v), F.lit("m in "), fy(y), F.lit(", up from $"), text(v + p), F.lit("m in "), fy(y - 1), F.lit(".")))
        .when(k % 4 == 1, F.concat(F.lit("The EBITDA margin was "), text(p), F.lit(".5% in "), fy(y), F.lit(".")))
        .when(k % 4 == 2, F.concat(text(p), F.lit("% of revenue is recurring.")))
        .otherwise(F.concat(F.lit("Cloud revenue rose by "), text(p), F.lit("% in "), fy(y), F.lit(" and 12 people left.")))
    )
    paragraphs = t.orders.select(text(F.col("o_custkey")).alias("deck"), F.lit(1).alias("slide"), k.cast("int").alias("uid"), F.lit(0).alias("para"), said.alias("text"))
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(kind).cast("string").alias("kind")) for m, kind in (("revenue", None), ("ebitda margin", "share"), ("cloud", None))])).alias("v")
    vocabulary = t.orders.select(text(F.col("o_custkey")).alias("deck")).distinct().select("deck", names).select("deck", "v.*")
    found = prose.prose_figures(paragraphs, vocabulary)
    return found.select(F.col("uid").cast("long").alias("k"), "nth", "metric", "scope", "period", "kind", "value", "quantity", "scale", "currency")
