"""Statistics operators over parts, customers, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe import streaming
from tallyframe.operators import joins, placement, stats
from tallyframe.queries.binding import registry

QUERIES, SQL, query = registry()

FOLD = """
pre AS (SELECT p_brand, p_retailprice AS v, CAST(sum(p_size) AS DOUBLE) AS w, count(*) AS n FROM part GROUP BY 1, 2),
items AS (SELECT p_brand, list({'v': v, 'w': w} ORDER BY v) AS l FROM pre GROUP BY 1),
folded AS (SELECT p_brand, list_reduce([{'w': 0.0::DOUBLE, 'vw': 0.0::DOUBLE, 'opens': []::DOUBLE[], 'v': 0.0::DOUBLE, 'x': 0.0::DOUBLE}] || list_transform(l, lambda i: {'w': 0.0::DOUBLE, 'vw': 0.0::DOUBLE, 'opens': []::DOUBLE[], 'v': i.v, 'x': i.w}),
  lambda a, i: CASE WHEN len(a.opens) > 0 AND abs(i.v - a.vw / greatest(a.w, 1e-12)) <= 2.0
    THEN {'w': a.w + i.x, 'vw': a.vw + i.v * i.x, 'opens': a.opens, 'v': i.v, 'x': i.x}
    ELSE {'w': i.x, 'vw': i.v * i.x, 'opens': list_append(a.opens, i.v), 'v': i.v, 'x': i.x} END).opens AS opens FROM items),
members AS (SELECT p_brand, v, w, n, len(list_filter(opens, lambda o: o <= v)) AS cluster FROM pre JOIN folded USING (p_brand))
"""


@query(f"""WITH {FOLD}
SELECT p_brand, CAST(cluster AS INTEGER) AS cluster, round(sum(v * w) / sum(w) + 1e-9, 4) AS centre, min_by(v, (-w, v)) AS mode, round(max(v) - min(v), 4) AS spread, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS support
FROM members GROUP BY 1, 2""")
def cluster_1d(t):
    clusters = stats.cluster_stats(stats.cluster_1d(t.part, ["p_brand"], "p_retailprice", "p_size", 2.0), ["p_brand"])
    return clusters.select("p_brand", F.col("cluster").cast("int").alias("cluster"), F.round(F.col("centre") + 1e-9, 4).alias("centre"), "mode", F.round("spread", 4).alias("spread"), F.col("weight").cast("long").alias("weight"), F.col("support").cast("long").alias("support"))


DOM = "WITH c AS (SELECT c_nationkey, c_mktsegment AS value, count(*) AS weight FROM customer GROUP BY 1, 2)"


def _segments(t):
    return stats.dominance(t.customer, ["c_nationkey"], "c_mktsegment", F.lit(1))


@query(f"""{DOM} SELECT c_nationkey, value, CAST(weight AS BIGINT) AS weight, round(weight / sum(weight) OVER (PARTITION BY c_nationkey), 6) AS share,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, value) AS INTEGER) AS "rank" FROM c""")
def dominance_cat(t):
    return _segments(t).select("c_nationkey", "value", F.col("weight").cast("long").alias("weight"), F.round("share", 6).alias("share"), "rank")


@query(f"""{DOM}, s AS (SELECT c_nationkey, weight / sum(weight) OVER (PARTITION BY c_nationkey) AS p FROM c)
SELECT c_nationkey, round(-sum(p * log2(p)), 4) AS entropy FROM s GROUP BY 1""")
def entropy(t):
    return stats.entropy(_segments(t), ["c_nationkey"]).select("c_nationkey", F.round("entropy", 4).alias("entropy"))


CLASSIFY = """
c AS (SELECT o_custkey AS k, o_orderstatus AS value, count(*) AS weight FROM orders GROUP BY 1, 2),
s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY k) AS p, row_number() OVER (PARTITION BY k ORDER BY weight DESC, value) AS r FROM c),
g AS (SELECT k, count(*) AS n, CAST(sum(weight) AS BIGINT) AS support, max(p) AS top_share, min_by(value, r) AS top, count(*) FILTER (p >= 0.15) AS modes, -sum(p * log2(p)) AS h FROM s GROUP BY 1),
k AS (SELECT *, CASE WHEN support < 3 THEN 'variable' WHEN n = 1 THEN 'invariant' WHEN top_share >= 0.85 THEN 'dominant' WHEN modes BETWEEN 2 AND 3 AND h <= 1.6 THEN 'multimodal' ELSE 'variable' END AS class FROM g)
"""


def _statuses(t):
    return stats.classify(stats.dominance(t.orders, ["o_custkey"], "o_orderstatus", F.lit(1)), ["o_custkey"], stats.SUPPORT["deck"])


@query(f"WITH {CLASSIFY} SELECT k AS o_custkey, class, CASE WHEN class <> 'variable' THEN top END AS value, support, round(top_share, 6) AS top_share, round(h, 4) AS entropy FROM k")
def classify_obs(t):
    return _statuses(t).select("o_custkey", "class", "value", F.col("support").cast("long").alias("support"), F.round("top_share", 6).alias("top_share"), F.round("entropy", 4).alias("entropy"))


@query(f"""WITH {CLASSIFY}, j AS (SELECT c_nationkey, k.* FROM k JOIN customer ON c_custkey = k.k)
SELECT c_nationkey, bool_and(class IN ('invariant', 'dominant') OR support = 0) AND count(*) FILTER (class IN ('invariant', 'dominant')) >= 2 AND count(DISTINCT CASE WHEN class IN ('invariant', 'dominant') THEN top END) >= 2 AS explained FROM j GROUP BY 1""")
def explain_by_group(t):
    joined = _statuses(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return stats.explained_by(joined, ["c_nationkey"])


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.05), 4) AS p5, floor(quantile_cont(p_retailprice, 0.05) / 2) * 2 AS margin FROM part GROUP BY 1""")
def percentile_margin(t):
    p5 = F.percentile("p_retailprice", F.lit(0.05))
    return t.part.groupBy("p_brand").agg(F.round(p5, 4).alias("p5"), (F.floor(p5 / 2) * 2).cast("double").alias("margin"))


@query("""WITH s AS (SELECT c_nationkey, CAST(max(CAST(c_acctbal AS DECIMAL(12,2))) - min(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(14,1)) AS spread FROM customer GROUP BY 1)
SELECT c_nationkey, CAST(round_even(CAST(least(greatest(spread * 1.5, 2.0), 16000.0) AS DOUBLE), 2) AS DOUBLE) AS tolerance FROM s""")
def derive_tol(t):
    spread = (F.max("c_acctbal") - F.min("c_acctbal")).alias("spread")
    rows = t.customer.groupBy("c_nationkey").agg(spread)
    return rows.select("c_nationkey", stats.tolerance(F.col("spread").cast("decimal(14,2)").cast("decimal(14,1)").cast("double"), 2.0, ceiling=16000.0).alias("tolerance"))


COVER = """WITH b AS (SELECT p_brand, greatest(0.0, p_retailprice - 4.0) AS lo, least(2100.0, p_retailprice + 4.0) AS hi FROM part),
r AS (SELECT p_brand, lo, hi, max(hi) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)"""


@query(f"{COVER} SELECT p_brand, round(least(1.0, sum(greatest(0.0, hi - greatest(lo, coalesce(reach, lo)))) / 2100.0), 6) AS covered FROM r GROUP BY 1")
def coverage_share(t):
    return stats.coverage(t.part, ["p_brand"], "p_retailprice", 4.0, 2100.0).select("p_brand", F.round("covered", 6).alias("covered"))


@query("""WITH l AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2),
u AS (SELECT unnest(range(1, 7)) AS step),
k AS (SELECT p_brand, step, count(*) FILTER (n >= step) AS lines, least(1.0, count(*) FILTER (n >= step) * 0.5 / 50) AS covered FROM l CROSS JOIN u GROUP BY 1, 2)
SELECT p_brand, CAST(min(step) AS INTEGER) AS step, CAST(min_by(lines, step) AS BIGINT) AS lines FROM k WHERE covered <= 0.25 GROUP BY 1""")
def grid_derive(t):
    """Support needed for a grid line is raised step by step until the lines cover at most a quarter of the canvas."""
    lines = t.part.groupBy("p_brand", "p_size").count()
    return stats.needed_support(lines, ["p_brand"], "count", 6, 0.5, 50, 0.25)


@query("""WITH v AS (SELECT c_nationkey, c_custkey, mode_value FROM (SELECT o_custkey AS c_custkey, min_by(o_orderpriority, (-n, o_orderpriority)) AS mode_value FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) JOIN customer USING (c_custkey)),
w AS (SELECT c_nationkey, mode_value, count(*) AS votes FROM v GROUP BY 1, 2)
SELECT c_nationkey, min_by(mode_value, (-votes, mode_value)) AS winner, CAST(max(votes) AS BIGINT) AS votes, CAST(sum(votes) AS BIGINT) AS voters FROM w GROUP BY 1""")
def two_stage_vote(t):
    """Each customer votes once with its commonest priority; a nation's votes are then counted."""
    own = stats.dominance(t.orders, ["o_custkey"], "o_orderpriority", F.lit(1)).where("rank = 1").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return stats.dominance(own, ["c_nationkey"], "value", F.lit(1)).groupBy("c_nationkey").agg(F.min_by("value", "rank").alias("winner"), F.max("weight").alias("votes"), F.sum("weight").alias("voters"))


@query("""WITH w AS (SELECT c_nationkey, c_mktsegment, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(12,2))) AS DOUBLE) AS w FROM customer GROUP BY 1, 2),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY c_nationkey) AS share FROM w)
SELECT c_nationkey, list(c_mktsegment ORDER BY c_mktsegment) AS allowed FROM s WHERE share >= 0.15 GROUP BY 1""")
def share_allowlist(t):
    weight = F.sum(F.abs(F.col("c_acctbal").cast("decimal(12,2)"))).cast("double")
    shares = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(weight.alias("w"))
    shares = shares.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("c_nationkey")))
    return shares.where("share >= 0.15").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("allowed"))


@query("""WITH n AS (SELECT count(DISTINCT source) AS total FROM documents), l AS (SELECT lower(trim(unnest(string_split(text, chr(10))))) AS line, source FROM documents)
SELECT line, count(DISTINCT source) AS sources FROM l, n WHERE line <> '' GROUP BY line, total HAVING count(DISTINCT source) >= 0.6 * total""")
def recurring_lines(t):
    """Lines that stand in documents of at least 60 % of the sources."""
    lines = t.documents.select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", F.lower(F.trim("line")).alias("line")).where("line <> ''").distinct()
    total = t.documents.agg(F.count_distinct("source").alias("total"))
    counted = lines.groupBy("line").agg(F.count("source").alias("sources"))
    return counted.join(F.broadcast(total)).where("sources >= 0.6 * total").select("line", "sources")


@query("""WITH m AS (SELECT event_type, user_id, event_id, floor(CAST(value AS DECIMAL(18,4)) * 16) / 16 AS v FROM events),
g AS (SELECT *, CAST(lead(v) OVER (PARTITION BY event_type, user_id ORDER BY v, event_id) - v - 0.125 AS DOUBLE) AS gap FROM m)
SELECT event_type, user_id, count(gap) AS gaps, round(stddev_samp(gap), 3) AS stdev FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND min(gap) >= -0.5 AND stddev_samp(gap) > 1.0""")
def lo008_gutters(t):
    """Events as boxes an eighth wide that stand at their value (in sixteenths): lines of three or more whose gaps vary by more than 1."""
    boxes = t.events.select("event_type", "user_id", F.col("event_id").alias("uid"), (F.floor(F.col("value").cast("decimal(18,4)") * 16) / 16).cast("double").alias("left"), F.lit(0.125).alias("width"))
    line = ["event_type", "user_id"]
    found = placement.spreads(placement.gaps(boxes, line, "left", "width"), line, 0.5).where("spread > 1.0")
    return found.select(*line, (F.col("n") - 1).alias("gaps"), F.round("spread", 3).alias("stdev"))


@query("""WITH o AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, ts FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM o WHERE value <= before)
SELECT user_id, event_id FROM b WHERE r = 1""")
def br007_sequence(t):
    """The first row of a sequence that does not rise above the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    falls = t.events.withColumn("before", F.lag("value").over(order)).where("value <= before")
    return falls.withColumn("r", F.row_number().over(order)).where("r = 1").select("user_id", "event_id")


@query("""WITH l AS (SELECT CAST(p_size * 40 AS DOUBLE) AS line, p_size AS no FROM part GROUP BY 1, 2), d AS (SELECT p_partkey, p_retailprice, line, abs(p_retailprice - line) AS delta FROM part, l),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY delta, line) AS r, count(*) FILTER (delta <= 4.0) OVER (PARTITION BY p_partkey) AS near FROM d)
SELECT p_partkey, line, round(delta, 4) AS delta FROM n WHERE r = 1 AND near = 1 AND delta BETWEEN 0.5 AND 4.0""")
def near_miss_grid(t):
    """Parts whose price misses the nearest price line by .5 to 4, with no second line as near."""
    lines = t.part.select((F.col("p_size") * 40.0).alias("at"), F.lit(1).alias("axis")).distinct()
    rows = t.part.select("p_partkey", "p_retailprice", F.lit(1).alias("axis"))
    near = joins.nearest(rows, ["axis"], lines, "p_retailprice", "at", 0.5, 4.0)
    one = near.groupBy("p_partkey").agg(F.min_by("line", F.struct("delta", "line")).alias("line"), F.min("delta").alias("delta"), F.count(F.lit(1)).alias("near"))
    return one.where("near = 1 AND delta BETWEEN 0.5 AND 4.0").select("p_partkey", "line", F.round("delta", 4).alias("delta"))


BOX = "SELECT p_brand, p_partkey, CAST(p_size * 10 AS DOUBLE) AS \"left\", CAST(p_partkey % 97 AS DOUBLE) AS top, 12.0 + p_partkey % 5 AS width, 10.0 + p_partkey % 7 AS height FROM part"


@query(f"""WITH b AS ({BOX}), p AS (SELECT x.p_brand, x.p_partkey AS one, y.p_partkey AS other,
greatest(0.0, least(x."left" + x.width, y."left" + y.width) - greatest(x."left", y."left")) * greatest(0.0, least(x.top + x.height, y.top + y.height) - greatest(x.top, y.top)) AS area, least(x.width * x.height, y.width * y.height) AS smaller
FROM b x JOIN b y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey) SELECT p_brand, one, other, CAST(area AS DOUBLE) AS area FROM p WHERE area / smaller > 0.05""")
def rect_overlap(t):
    k = F.col("p_partkey")
    boxes = t.part.select("p_brand", "p_partkey", (F.col("p_size") * 10).cast("double").alias("left"), (k % 97).cast("double").alias("top"), (k % 5 + 12.0).alias("width"), (k % 7 + 10.0).alias("height"))
    return joins.rect_overlaps(boxes, ["p_brand"], "p_partkey", 0.05)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS d FROM embeddings),
c AS (SELECT label AS l, d, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
s AS (SELECT vec_id, l, sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)) AS dist FROM e JOIN c USING (d) GROUP BY 1, 2)
SELECT vec_id, min_by(l, (round(dist, 9), l)) AS nearest FROM s GROUP BY 1""")
def nearest_centroid(t):
    """Each vector's nearest label mean."""
    return stats.nearest_mean(t.embeddings, "vec_id", "label", "embedding")


@query("""SELECT o.o_orderkey, max_by(e.event_id, (e.ts, e.event_id)) AS event_id FROM orders o JOIN events e ON e.user_id = o.o_custkey % 1000 AND CAST(e.event_id AS BIGINT) <= o.o_orderkey GROUP BY 1""")
def asof_event(t):
    """For each order the last event of its user among those that come before it."""
    e = t.events.select(F.col("user_id").cast("long").alias("user"), F.col("event_id").cast("long").alias("key"), F.struct("ts", "event_id").alias("event"))
    o = t.orders.select((F.col("o_custkey") % 1000).cast("long").alias("user"), F.col("o_orderkey").cast("long").alias("key"))
    return joins.last_before(o, e, ["user"], "key", "event").groupBy(F.col("key").alias("o_orderkey")).agg(F.max("event")["event_id"].alias("event_id"))


@query("""WITH a AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part)
SELECT x.p_partkey, min_by(y.p_partkey, (x.p_size - y.p_size, y.p_partkey)) AS caption FROM a x JOIN a y ON x.p_brand = y.p_brand AND y.p_size < x.p_size AND y.p_size >= x.p_size - 6 AND y.p_partkey % 10 = 0 GROUP BY 1""")
def asof_nearest_above(t):
    """The nearest caption above each box: same column, within reach, ties to the smaller key."""
    return joins.nearest_above(t.part, t.part.where("p_partkey % 10 = 0"), ["p_brand"], "p_partkey", "p_size", 6)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, coalesce(NULLIF(l_tax, 0), NULLIF(l_discount, 0), l_quantity) AS value, CASE WHEN NULLIF(l_tax, 0) IS NOT NULL THEN 'run' WHEN NULLIF(l_discount, 0) IS NOT NULL THEN 'layout' ELSE 'theme' END AS source FROM lineitem)
SELECT source, count(*) AS n, round(sum(value), 2) AS total FROM o GROUP BY 1""")
def inherit_coalesce(t):
    """First value that is set along a chain of sources, with the source that won."""
    found = joins.first_by_precedence(("run", F.nullif(F.col("l_tax"), F.lit(0.0))), ("layout", F.nullif(F.col("l_discount"), F.lit(0.0))), ("theme", F.col("l_quantity")))
    return t.lineitem.select(found.alias("f")).groupBy(F.col("f.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f.value"), 2).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 2 HOUR) AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    """Runs of a user's events without a pause of two hours, as the stream of them would keep."""
    found = streaming.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "2 hours")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")
