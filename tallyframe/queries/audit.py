"""Audit plumbing, redaction and learning steps bound to orders, parts, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import geometry
from tallyframe.learn import corpus
from tallyframe.operators import extent, joins, linkage, redaction, stats
from tallyframe.plans import audit
from tallyframe.queries.binding import registry

QUERIES, SQL, query = registry()

#: Orders as findings: rule by order key, slide by customer, severity by priority, confidence by status.
FOUND = """f AS (SELECT o_orderkey AS id, 'R' || o_orderkey % 7 AS rule, o_custkey % 200 AS slide, 'S' || o_orderkey % 13 AS shape, ['blocker','major','minor','info'][1 + o_orderkey % 4] AS severity,
CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN 'semantic' ELSE 'layout' END AS category, 'm' || o_orderkey AS message FROM orders)"""


def found(t):
    k = F.col("o_orderkey")
    tag = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    severity = F.get(F.array(*[F.lit(s) for s in audit.SEVERITIES]), (k % 4).cast("int"))
    confidence = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return t.orders.select(k.alias("id"), tag("R", 7).alias("rule"), (F.col("o_custkey") % 200).alias("slide"), tag("S", 13).alias("shape"), severity.alias("severity"), confidence.alias("confidence"), F.when(k % 9 == 0, "semantic").otherwise("layout").alias("category"), F.concat(F.lit("m"), k.cast("string")).alias("message"))


@query(f"WITH {FOUND} SELECT slide, count(*) AS failing FROM f WHERE severity IN ('blocker', 'major') AND confidence IN ('high', 'medium') AND category <> 'semantic' GROUP BY 1")
def gate_exceeds(t):
    return audit.exceeds(found(t), "major", "medium", ("semantic",)).groupBy("slide").agg(F.count(F.lit(1)).alias("failing"))


SUPP = "s AS (SELECT 'R' || p_partkey % 7 AS rule, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 200 END AS slide, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'S' || p_partkey % 13 END AS shape FROM part WHERE p_partkey % 40 = 7)"


@query(f"WITH {FOUND}, {SUPP} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rule = f.rule AND (s.slide IS NULL OR s.slide = f.slide) AND (s.shape = '' OR s.shape = f.shape))")
def suppress_anti(t):
    k = F.col("p_partkey")
    rows = t.part.where("p_partkey % 40 = 7").select(F.concat(F.lit("R"), (k % 7).cast("string")).alias("rule"), F.when(k % 3 != 0, k % 200).alias("slide"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("S"), (k % 13).cast("string"))).alias("shape"))
    return joins.unsuppressed(found(t), rows).select("id")


@query("""SELECT 'R' || p_size % 7 AS rule, p_size % 11 AS slide, CAST(sum(p_partkey % 3 + 1) AS BIGINT) AS count, list_sort(list_distinct(list('n' || p_partkey % 4))) AS notes FROM part GROUP BY 1, 2""")
def suppress_merge(t):
    rows = t.part.select(F.concat(F.lit("R"), (F.col("p_size") % 7).cast("string")).alias("rule"), (F.col("p_size") % 11).alias("slide"), F.lit("").alias("shape"), (F.col("p_partkey") % 3 + 1).alias("count"), F.concat(F.lit("n"), (F.col("p_partkey") % 4).cast("string")).alias("note"))
    return audit.merge_suppressions(rows).select("rule", "slide", "count", "notes")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), d AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT l_orderkey FROM l LEFT JOIN d ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(*) = count(s_suppkey)""")
def intended_division(t):
    """Clustered findings are covered only if every line is declared."""
    declared = t.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.fully_declared(t.lineitem, declared, "l_orderkey", "l_suppkey")


RANK = "list_position(['blocker','major','minor','info'], severity)"


@query(f"WITH {FOUND} SELECT slide, rule, min_by(message, id) AS message, ['blocker','major','minor','info'][min({RANK})] AS severity, count(*) - 1 AS more FROM f GROUP BY 1, 2")
def cluster_findings(t):
    return audit.cluster_findings(found(t), ["slide", "rule"], F.col("id"))


@query(f"WITH {FOUND} "
       "SELECT k.slide, s.severity, count(f.id) AS n FROM (SELECT DISTINCT slide FROM f UNION ALL SELECT NULL) k CROSS JOIN (SELECT unnest(['blocker','major','minor','info']) AS severity) s LEFT JOIN f ON f.severity = s.severity AND (k.slide IS NULL OR f.slide = k.slide) GROUP BY 1, 2")
def audit_summary(t):
    """Findings by severity, of the whole audit (slide null) and of each slide; zeros included."""
    f = found(t)
    every = audit.summary(f, t.spark).select(F.lit(None).cast("long").alias("slide"), "severity", F.col("n").cast("long").alias("n"))
    of = lambda s: F.count(F.when(F.col("severity") == s, 1))
    slides = f.groupBy("slide").agg(F.array(*[F.struct(F.lit(s).alias("severity"), of(s).alias("n")) for s in audit.SEVERITIES]).alias("counts"))
    return every.unionByName(slides.select("slide", F.inline("counts")))


DELTA = "b AS (SELECT 'K' || o_orderkey % 997 AS key FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT 'K' || o_orderkey % 997 AS key FROM orders WHERE o_orderkey % 4 <> 0)"


@query(f"""WITH {DELTA} SELECT change, key, count(*) AS n FROM (SELECT 'fixed' AS change, key FROM (FROM b EXCEPT ALL FROM a) UNION ALL SELECT 'new', key FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'remaining', key FROM (FROM a INTERSECT ALL FROM b)) GROUP BY 1, 2""")
def audit_delta(t):
    key = F.concat(F.lit("K"), (F.col("o_orderkey") % 997).cast("string")).alias("key")
    before, after = t.orders.where("o_orderkey % 3 <> 0").select(key), t.orders.where("o_orderkey % 4 <> 0").select(key)
    return audit.delta(before, after).groupBy("change", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FOUND} SELECT rule || ':' || shape AS action, min({RANK}) AS worst, count(*) AS findings, list_sort(list_distinct(list(slide))) AS slides FROM f GROUP BY 1")
def actions(t):
    """Findings as decisions: one row for each remedy."""
    return audit.actions(found(t), F.concat_ws(":", "rule", "shape"))


@query(f"WITH {FOUND}, q AS (SELECT rule, shape, {RANK} AS band, count(*) AS impact FROM f GROUP BY 1, 2, 3) SELECT rule, shape, band, impact FROM q ORDER BY band, impact DESC, rule, shape LIMIT 12")
def topk_questions(t):
    return audit.questions(found(t), ["rule", "shape"], 12)


@query("""WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c) SELECT source, w, n FROM r WHERE r <= 5""")
def topk_per_group(t):
    words = t.documents.select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w")).groupBy("source", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return audit.top_per_group(words, ["source"], [F.desc("n"), F.col("w")], 5)


@query("""WITH f AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000), s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%')
SELECT count(*) FILTER (f.k IS NOT NULL AND s.k IS NOT NULL) AS caught, count(*) FILTER (f.k IS NULL) AS missed, count(*) FILTER (s.k IS NULL) AS false_positives FROM f FULL JOIN s ON f.k = s.k""")
def precision_recall(t):
    key = F.col("o_orderkey").alias("k")
    return audit.scored(t.orders.where("o_totalprice > 200000").select(key), t.orders.where("o_orderpriority LIKE '1%'").select(key), "k")


@query("""SELECT p_partkey, 'LO-003|' || p_brand || '|' || format('{:.1f}', round_even(p_retailprice * 2, 0) / 2) || '|' || format('{:.1f}', round_even(p_size * 0.5, 0) / 2) AS signature FROM part""")
def signature(t):
    return t.part.select("p_partkey", audit.signature(F.lit("LO-003"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size") * 0.25).alias("signature"))


@query("""WITH a AS (SELECT source, doc_id // 1024 AS b, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY ALL),
c AS (SELECT source, b // 1024 AS b, sha256(string_agg(CAST(b AS VARCHAR) || ':' || d, chr(10) ORDER BY b)) AS d FROM a GROUP BY source, b // 1024),
e AS (SELECT source, b // 1024 AS b, sha256(string_agg(CAST(b AS VARCHAR) || ':' || d, chr(10) ORDER BY b)) AS d FROM c GROUP BY source, b // 1024)
SELECT source, sha256(string_agg(CAST(b AS VARCHAR) || ':' || d, chr(10) ORDER BY b)) AS digest FROM e GROUP BY 1""")
def digest(t):
    return audit.digest_tree(t.documents.select("source", F.col("doc_id").alias("position"), F.sha2("text", 256).alias("digest")), ["source"])


@query("""SELECT conv_id, turn, role, length(text) AS characters, sha256(text) AS digest, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS record FROM conversations""")
def outbound_log(t):
    """What would leave, recorded without its text."""
    return audit.outbound_log(t.conversations, "conv_id", ["turn", "role"], "text")


@query("""WITH a AS (SELECT DISTINCT p_brand AS term FROM part), b AS (SELECT DISTINCT c_mktsegment AS term FROM customer), c AS (SELECT n_name AS term FROM nation UNION ALL SELECT p_brand FROM part WHERE p_partkey % 2 = 0)
SELECT term, CAST(min(source) AS INTEGER) AS source FROM (SELECT term, 0 AS source FROM a UNION ALL SELECT term, 1 FROM b UNION ALL SELECT term, 2 FROM c) GROUP BY 1""")
def terms_assemble(t):
    brands = t.part.select(F.col("p_brand").alias("term"))
    return redaction.assemble_terms(brands, t.customer.select(F.col("c_mktsegment").alias("term")), t.nation.select(F.col("n_name").alias("term")).unionByName(brands))


NAMES = "n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) ELSE split_part(p_type, ' ', 1) END AS name FROM part)"


def _names(t):
    words = F.split("p_type", " ")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit("")))).otherwise(F.get(words, F.lit(0)))
    return t.part.select(name.alias("name")).distinct()


@query(f"WITH {NAMES}, m AS (SELECT a.name, min_by(b.name, (-length(b.name), b.name)) AS long FROM n a JOIN n b ON b.name <> a.name AND starts_with(b.name, a.name || ' ') GROUP BY 1) SELECT n.name, coalesce(m.long, n.name) AS merged FROM n LEFT JOIN m USING (name)")
def name_merge(t):
    return redaction.merge_names(_names(t), "name")


@query(f"WITH {NAMES} SELECT a.name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.name <> a.name AND starts_with(b.name, a.name || ' '))")
def term_subsume(t):
    """Terms that do not only occur at the head of longer ones."""
    return redaction.merge_names(_names(t), "name").where("name = merged").select("name")


EMAIL = r"[A-Za-z0-9._%+\-'']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS term FROM documents")
def pii_detect(t):
    return t.documents.select("doc_id", F.explode(redaction.detect(F.col("text"), ("email",))).alias("s")).select("doc_id", F.col("s.text").alias("term"))


@query(f"""WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS term FROM documents) SELECT term, split_part(term, '@', 1) AS short FROM e""")
def redact_terms(t):
    terms = t.documents.select(F.explode(redaction.detect(F.col("text"), ("email",))).alias("s")).select(F.col("s.text").alias("term")).distinct()
    return terms.select("term", F.substring_index("term", "@", 1).alias("short"))


REWRITE = f"""r AS (SELECT doc_id, list_reduce([text] || list_transform(range(1, len(u) + 1), lambda i: u[i] || chr(1) || i), lambda acc, x: replace(acc, split_part(x, chr(1), 1), '[EMAIL_' || split_part(x, chr(1), 2) || ']')) AS text
FROM (SELECT doc_id, text, list_transform(list_sort(list_distinct(list_transform(m, lambda x: [list_position(m, x)]))), lambda p: m[p[1]]) AS u FROM (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS m FROM documents)))"""


@query()
def pii_kinds(t):
    """Everything that any detector finds in any document, with its place."""
    spans = t.documents.select("doc_id", F.explode(redaction.detect(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.kind", F.col("s.start").alias("first"), F.col("s.end").alias("past"), F.col("s.text").alias("term"))


@query()
def redact_documents(t):
    """Every document as a payload of its own, without what any detector finds in it."""
    texts = t.documents.select(F.col("doc_id").alias("payload"), F.lit(0).alias("part"), "text")
    return redaction.redact(texts).texts.select(F.col("payload").alias("doc_id"), "text")


def _rewritten(t):
    return t.documents.select("doc_id", redaction.rewrite(F.col("text"), redaction.detect(F.col("text"), ("email",))).alias("text"))


@query(f"WITH {REWRITE} SELECT doc_id, md5(text) AS digest FROM r")
def redact_rewrite(t):
    return _rewritten(t).select("doc_id", F.md5("text").alias("digest"))


@query(f"WITH {REWRITE} SELECT doc_id, CAST(length(text) - length(replace(text, '@', '')) AS BIGINT) AS at_signs, CAST(len(regexp_extract_all(text, '\\d{{9,}}')) AS BIGINT) AS digit_runs FROM r")
def residuals(t):
    r = _rewritten(t).select("doc_id", redaction.residue(F.col("text")).alias("r"))
    return r.select("doc_id", F.col("r.at_signs").cast("long").alias("at_signs"), F.col("r.digit_runs").cast("long").alias("digit_runs"))


@query(f"WITH {REWRITE} SELECT count(*) AS documents, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]+\\.[A-Za-z]')) AS leaks FROM r")
def redact_verify(t):
    """An own pattern, not the one that redacted, finds nothing left."""
    r = _rewritten(t)
    return r.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9]+\.[A-Za-z]"), 1)).alias("leaks"))


@query("""SELECT conv_id, turn, role, md5(text) AS digest FROM conversations""")
def redact_visible(t):
    hidden = F.concat(F.substring("text", 1, 3), F.lit("­​"), F.expr("substring(text, 4)"), F.lit("﻿"))
    return t.conversations.select("conv_id", "turn", "role", F.md5(redaction.visible(hidden)).alias("digest"))


SPANS = """l AS (SELECT user_id, list({'s': CAST(event_id % 50 AS INTEGER), 'e': CAST(event_id % 50 + 1 + event_id % 9 AS INTEGER)} ORDER BY event_id % 50, -(event_id % 9)) AS l FROM events GROUP BY 1)"""


@query(f"""WITH {SPANS}, r AS (SELECT user_id, list_reduce([{{'k': []::STRUCT(s INTEGER, e INTEGER)[], 'x': {{'s': 0, 'e': 0}}}}] || list_transform(l, lambda i: {{'k': []::STRUCT(s INTEGER, e INTEGER)[], 'x': i}}),
 lambda a, i: CASE WHEN len(a.k) = 0 OR i.x.s >= a.k[-1].e THEN {{'k': list_append(a.k, i.x), 'x': i.x}} WHEN i.x.e > a.k[-1].e AND i.x.s <= a.k[-1].s THEN {{'k': list_append(a.k[:-2], i.x), 'x': i.x}} ELSE a END).k AS k FROM l)
SELECT user_id, len(k) AS spans, CAST(list_sum(list_transform(k, lambda x: x.e - x.s)) AS BIGINT) AS covered FROM r""")
def span_resolve(t):
    k = F.col("event_id")
    spans = t.events.groupBy("user_id").agg(F.collect_list(F.struct((k % 50).cast("int").alias("start"), (k % 50 + 1 + k % 9).cast("int").alias("end"))).alias("s")).select("user_id", redaction.resolve(F.col("s")).alias("kept"))
    return spans.select("user_id", F.size("kept").cast("long").alias("spans"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("covered"))


_SOURCES = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS source"


@query(f"""
WITH s AS (SELECT p_brand AS path, {_SOURCES}, max(p_size) AS v FROM part GROUP BY 1, 2),
m AS (SELECT path, max(v) AS top, max(v) FILTER (source = '') AS base FROM s GROUP BY path),
j AS (SELECT m.path, m.top, m.base, min(s.source) FILTER (s.v = m.top) AS since, bool_or(s.source <> '' AND s.v IS DISTINCT FROM m.base) AS differs FROM m JOIN s USING (path) GROUP BY ALL)
SELECT path, CAST(CASE WHEN path LIKE '%5' THEN base ELSE top END AS DOUBLE) AS value,
       CASE WHEN path LIKE '%5' THEN CASE WHEN differs THEN 'locked' ELSE 'neutral' END WHEN since <> '' THEN 'widened' ELSE 'neutral' END AS change
FROM j""")
def profile_merge(t):
    """One number a path from three sources: the largest stays, locked paths keep what the first source says."""
    source = F.get(F.array(F.lit(""), F.lit("a"), F.lit("b")), (F.col("p_partkey") % 3).cast("int"))
    rows = t.part.groupBy(source.alias("source"), F.col("p_brand").alias("path")).agg(F.max("p_size").cast("double").alias("number")).withColumn("rule", F.lit("most")).withColumn("value", F.lit(None).cast("string"))
    kept, changes = corpus.fold(rows, F.col("path").endswith("5"))
    return changes.join(kept.select("path", F.col("number").alias("value")), "path", "left").select("path", "value", "change")


@query("""
WITH r AS (
  SELECT CAST(p_partkey % 5 AS VARCHAR) AS source, 'union.' || p_brand AS path, 'union' AS rule, p_type AS value FROM part
  UNION ALL SELECT CAST(p_partkey % 2 AS VARCHAR), 'common.' || p_brand, 'common', split_part(p_name, ' ', 1) FROM part
  UNION ALL SELECT CAST(p_partkey % 5 AS VARCHAR), 'agree.' || p_brand || '.' || p_type, 'agree', split_part(p_name, ' ', 2) FROM part WHERE p_size > 45
  UNION ALL SELECT CAST(p_partkey % 5 AS VARCHAR), 'first.' || p_brand || '.' || p_type, 'first', min(p_name) FROM part GROUP BY 1, 2
),
v AS (SELECT path, rule, value, count(DISTINCT source) AS n, min(source) AS since FROM r GROUP BY ALL),
p AS (SELECT path, count(DISTINCT source) AS sources, min(source) AS first, count(DISTINCT value) AS kinds FROM r GROUP BY 1)
SELECT path, value, since FROM v JOIN p USING (path)
WHERE CASE rule WHEN 'union' THEN true WHEN 'common' THEN n = sources WHEN 'agree' THEN kinds = 1 ELSE since = first END""")
def profile_fold(t):
    """What several sources state, folded by area: all of it, what all share, what they agree on, what came first."""
    key, brand, word = F.col("p_partkey"), F.col("p_brand"), lambda k: F.coalesce(F.get(F.split("p_name", " "), F.lit(k)), F.lit(""))
    row = lambda df, n, rule, path, value: df.select((key % n).cast("string").alias("source"), F.concat_ws(".", F.lit(rule), *path).alias("path"), F.lit(rule).alias("rule"), value.alias("value"))
    typed = [brand, F.col("p_type")]
    first = t.part.groupBy((key % 5).alias("p_partkey"), "p_brand", "p_type").agg(F.min("p_name").alias("p_name"))
    rows = row(t.part, 5, "union", [brand], F.col("p_type")).unionByName(row(t.part, 2, "common", [brand], word(0)))
    rows = rows.unionByName(row(t.part.where("p_size > 45"), 5, "agree", typed, word(1))).unionByName(row(first, 5, "first", typed, F.col("p_name")))
    return corpus.fold(rows.withColumn("number", F.lit(None).cast("double")))[0].select("path", "value", "since")


def _weights(t):
    hex_ = F.lpad(F.hex((F.col("p_size") * 333333 % 16777216).cast("long")), 6, "0")
    w = t.part.groupBy(hex_.alias("hex")).agg(F.count(F.lit(1)).alias("weight")).withColumn("lab", geometry.to_lab(F.col("hex")))
    return w.select(F.lit("deck").alias("deck"), "hex", "weight", "lab.l", "lab.a", "lab.b")


@query()
def palette_greedy(t):
    return stats.palette_greedy(_weights(t), ["deck"], 12.0).select("hex", "weight", "head")


@query()
def palette_tol(t):
    """Half the least distance of two palette heads, between 2 and 6, raised to admit every colour that a head stands for."""
    return stats.palette_tolerance(stats.palette_greedy(_weights(t), ["deck"], 3.0), ["deck"]).select("tolerance")


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part),
r AS (SELECT p_partkey, list_reduce([{'n': 1, 'x': 0, 'w': ''}] || list_transform(w, lambda i: {'n': 0, 'x': 0, 'w': i}), lambda a, i: CASE WHEN a.x = 0 THEN {'n': a.n, 'x': CAST(length(i.w) AS INTEGER), 'w': ''} WHEN a.x + 1 + length(i.w) <= 14 THEN {'n': a.n, 'x': CAST(a.x + 1 + length(i.w) AS INTEGER), 'w': ''} ELSE {'n': a.n + 1, 'x': CAST(length(i.w) AS INTEGER), 'w': ''} END).n AS lines FROM w)
SELECT p_partkey, CAST(lines AS INTEGER) AS lines FROM r""")
def greedy_wrap(t):
    """Lines that a text takes when words go on while they fit in 14 characters."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return t.part.select("p_partkey", extent.wrapped_lines(F.transform(words, lambda w: F.length(w).cast("double")), 1, 14).cast("int").alias("lines"))


_TEXT = "p_name || ' ' || p_type || ' ' || p_brand"


@query(f"""
WITH words AS (SELECT p_partkey, 8 + p_size % 5 AS size, 40 + p_size AS room, p_size % 2 = 0 AS known, string_split({_TEXT}, ' ') AS w FROM part),
wide AS (
  SELECT p_partkey, size, room, known,
         [CAST(size AS DOUBLE) * CASE WHEN known THEN list_sum([CASE WHEN ascii(c) BETWEEN 97 AND 122 THEN 0.25::DOUBLE + (ascii(c) - 97) * 0.01::DOUBLE ELSE 1.15::DOUBLE END FOR c IN string_split(i, '')]) ELSE length(i) * 1.15::DOUBLE END FOR i IN w] AS ws
  FROM words
),
folded AS (
  SELECT *, list_reduce([{{'n': 0::BIGINT, 'x': 0::DOUBLE, 'w': 0::DOUBLE}}] || [{{'n': 0::BIGINT, 'x': 0::DOUBLE, 'w': i}} FOR i IN ws], lambda a, i:
    CASE WHEN i.w > room THEN {{'n': a.n + (a.x > 0)::BIGINT + ceil(i.w / room)::BIGINT, 'x': 0::DOUBLE, 'w': 0::DOUBLE}}
         WHEN a.x > 0 AND a.x + size * 1.15::DOUBLE + i.w <= room THEN {{'n': a.n, 'x': a.x + size * 1.15::DOUBLE + i.w, 'w': 0::DOUBLE}}
         ELSE {{'n': a.n + 1, 'x': i.w, 'w': 0::DOUBLE}} END).n AS lines
  FROM wide
)
SELECT p_partkey, lines, round(list_sum(ws), 6) AS width, round(lines * size * 1.5::DOUBLE, 6) AS height FROM folded""")
def ink_fold(t):
    """Lines, letters' width and height of a text in a narrow frame: true advances for half the rows' small letters, else bounds."""
    small = "abcdefghijklmnopqrstuvwxyz"
    face = F.create_map(*[x for k, c in enumerate(small) for x in (F.lit(c), F.lit(0.25 + k * 0.01))])
    size, room = (8 + F.col("p_size") % 5).cast("double"), (40 + F.col("p_size")).cast("double")
    advances = F.when(F.col("p_size") % 2 == 0, face)
    rows = t.part.select("p_partkey", size.alias("size"), room.alias("room"), F.transform(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "), lambda w: extent.advance(w, size, advances)).alias("widths"))
    rows = rows.withColumn("lines", extent.wrapped_lines(F.col("widths"), F.col("size") * extent.MAX_ADVANCE_EM, F.col("room")))
    total = F.aggregate("widths", F.lit(0.0), lambda a, w: a + w)
    return rows.select("p_partkey", "lines", F.round(total, 6).alias("width"), F.round(F.col("lines") * F.col("size") * extent.MAX_LINE_EM, 6).alias("height"))


_BOXES = "SELECT p_brand AS slide, p_partkey AS id, CAST(p_partkey * 37 % 400 AS DOUBLE) AS x, CAST(p_partkey * 53 % 300 AS DOUBLE) AS y, CAST(4 + p_size AS DOUBLE) AS w, CAST(2 + p_partkey % 7 AS DOUBLE) AS h FROM part"


@query(f"""
WITH RECURSIVE b AS ({_BOXES}),
near AS (
  SELECT p.slide, p.id AS a, q.id AS b FROM b p JOIN b q ON p.slide = q.slide AND p.id <> q.id
  WHERE greatest(p.x - q.x - q.w, q.x - p.x - p.w) <= greatest(p.h, q.h) AND greatest(p.y - q.y - q.h, q.y - p.y - p.h) <= greatest(p.h, q.h)
),
reach AS (SELECT slide, id, id AS node FROM b UNION SELECT r.slide, r.id, n.b FROM reach r JOIN near n ON n.slide = r.slide AND n.a = r.node),
tied AS (SELECT slide, id, min(node) AS label FROM reach GROUP BY 1, 2)
SELECT b.slide, t.label, count(*) AS members, min(x) AS left_pt, min(y) AS top_pt, max(x + w) - min(x) AS width_pt, max(y + h) - min(y) AS height_pt
FROM b JOIN tied t ON t.slide = b.slide AND t.id = b.id GROUP BY 1, 2""")
def linkage_groups(t):
    """Boxes of a brand's parts that sit together, each group with the box around it."""
    k = F.col("p_partkey")
    boxes = t.part.select(F.col("p_brand").alias("slide"), k.alias("id"), (k * 37 % 400).cast("double").alias("left_pt"), (k * 53 % 300).cast("double").alias("top_pt"), (4 + F.col("p_size")).cast("double").alias("width_pt"), (2 + k % 7).cast("double").alias("height_pt"))
    return linkage.groups(boxes, ["slide"], "id")
