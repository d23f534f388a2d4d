"""Text, number, label and period functions over rendered figures and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import learn
from tallyframe.functions import geometry, labels, numbers, periods, text
from tallyframe.operators import terms
from tallyframe.queries.binding import registry

QUERIES, SQL, query = registry()

#: Eight spellings of an order's price, by its key.
RENDERED_SQL = """
SELECT o_orderkey AS k, CASE o_orderkey % 8
 WHEN 0 THEN CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) WHEN 1 THEN format('{:,.2f}', o_totalprice) WHEN 2 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
 WHEN 3 THEN 'US$' || format('{:,.2f}', o_totalprice) || 'm' WHEN 4 THEN '-' || CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) || '%' WHEN 5 THEN 'n.a.'
 WHEN 6 THEN '(' || CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) ELSE CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) || 'x*' END AS cell, CAST(o_totalprice::DECIMAL(18,2) AS DOUBLE) AS price FROM orders"""


def rendered(t):
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    comma = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    k = F.col("o_orderkey") % 8
    forms = [plain, comma, F.concat(F.lit("("), comma, F.lit(")")), F.concat(F.lit("US$"), comma, F.lit("m")), F.concat(F.lit("-"), plain, F.lit("%")), F.lit("n.a."), F.concat(F.lit("("), plain)]
    cell = F.when(k == 7, F.concat(plain, F.lit("x*")))
    for i, f in enumerate(forms):
        cell = cell.when(k == i, f)
    return t.orders.select(F.col("o_orderkey").alias("k"), cell.alias("cell"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"))


@query(f"""WITH r AS ({RENDERED_SQL}) SELECT k, CASE k % 8 WHEN 2 THEN -price WHEN 4 THEN -price ELSE price END AS value, 2 AS decimals,
CASE WHEN k % 8 IN (1, 2, 3) AND price >= 1000 THEN ',' END AS separator, CASE k % 8 WHEN 2 THEN 'parentheses' WHEN 4 THEN 'minus' END AS negative_style,
CASE WHEN k % 8 = 3 THEN 'US$' END AS currency, CASE k % 8 WHEN 3 THEN 'm' WHEN 4 THEN '%' END AS suffix FROM r WHERE k % 8 NOT IN (5, 6, 7)""")
def parse_number(t):
    return rendered(t).select("k", numbers.parse_number(F.col("cell")).alias("r")).where("r IS NOT NULL").select("k", "r.*")


@query(f"""WITH r AS ({RENDERED_SQL}) SELECT k, CASE WHEN k % 8 IN (2, 4) THEN -price ELSE price END AS value, CASE k % 8 WHEN 7 THEN 'x' WHEN 3 THEN 'm' WHEN 4 THEN '%' END AS suffix FROM r WHERE k % 8 NOT IN (5, 6)""")
def footnote_strip(t):
    return rendered(t).select("k", numbers.read_cell(F.col("cell")).alias("r")).where("r IS NOT NULL").select("k", "r.value", "r.suffix")


@query(f"WITH r AS ({RENDERED_SQL}) SELECT k, cell AS written FROM r WHERE k % 8 NOT IN (5, 6, 7)")
def restate(t):
    """A parsed figure written again from its parts reads as it did."""
    r = rendered(t).select("k", numbers.parse_number(F.col("cell")).alias("r")).where("r IS NOT NULL")
    return r.select("k", numbers.restate(F.col("r.value"), F.col("r.decimals"), F.col("r.separator"), F.col("r.negative_style"), F.col("r.currency"), F.col("r.suffix")).alias("written"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS b FROM orders)
SELECT k, ['$' || a || 'm', b || '%'] AS found FROM o""")
def prose_numbers(t):
    """Figures of a sentence; the bare year is none, the bracket does not make one negative."""
    a, b = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 90 + 10).cast("string")
    sentence = F.concat(F.lit("In 2024 revenue was ($"), a, F.lit("m), up "), b, F.lit("% on the year."))
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.prose_numbers(sentence).alias("found"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '%' END AS quantity, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'bn' ELSE 'm' END AS scale, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency FROM orders""")
def unit_inherit(t):
    cell = F.when(F.col("o_orderkey") % 3 == 0, "12.5%").when(F.col("o_orderkey") % 3 == 1, "€1.2bn").otherwise("1,250")
    own = numbers.unit_of(numbers.parse_number(cell))
    caption = labels.stated_unit(F.lit("Figures in US$ millions"))
    other = F.struct(F.lit(None).cast("string").alias("quantity"), caption["scale"].alias("scale"), caption["currency"].alias("currency"))
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.inherit_unit(own, other).alias("u")).select("k", "u.*")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN ['US$'] WHEN 1 THEN ['£', '€'] WHEN 2 THEN [] ELSE ['USD'] END AS markers FROM orders""")
def currency_tokens(t):
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "paid US$12m").when(k == 1, "from £3.5m to € 4m").when(k == 2, "in $ terms").otherwise("USD 9")
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.currency_tokens(said).alias("markers"))


PERIOD_FORMS = (
    ("'FY' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || 'A'", "'FY' || y || 'A'", lambda y, yy: F.concat(F.lit("FY"), yy, F.lit("A"))),
    ("'Q3 ' || y", "'Q3-' || y", lambda y, yy: F.concat(F.lit("Q3 "), y)),
    ("'H1 ' || yy", "'H1-' || y", lambda y, yy: F.concat(F.lit("H1 "), yy)),
    ("'LTM Sep-' || yy", "'LTM-SEP-' || y", lambda y, yy: F.concat(F.lit("LTM Sep-"), yy)),
    ("'9M ' || y", "'9M-' || y", lambda y, yy: F.concat(F.lit("9M "), y)),
    ("y || ' Budget'", "'FY' || y || 'B'", lambda y, yy: F.concat(y, F.lit(" Budget"))),
    ("'Revenue CAGR 2020A-' || y || 'E'", "'FY2020A..FY' || y || 'E'", lambda y, yy: F.concat(F.lit("Revenue CAGR 2020A-"), y, F.lit("E"))),
    ("'CY' || y", "'CY' || y", lambda y, yy: F.concat(F.lit("CY"), y)),
    ("'no period'", "NULL", lambda y, yy: F.lit("no period")),
)
PERIOD_CASE = " ".join(f"WHEN {i} THEN {want}" for i, (_, want, _) in enumerate(PERIOD_FORMS))


@query(f"WITH o AS (SELECT o_orderkey AS k, CAST(2021 + o_orderkey % 10 AS VARCHAR) AS y FROM orders) SELECT k, CASE k % 9 {PERIOD_CASE} END AS period FROM o")
def parse_period(t):
    y = (F.lit(2021) + F.col("o_orderkey") % 10).cast("string")
    k = F.col("o_orderkey") % 9
    label = F.when(F.lit(False), "")
    for i, (_, _, form) in enumerate(PERIOD_FORMS):
        label = label.when(k == i, form(y, F.right(y, F.lit(2))))
    return t.orders.select(F.col("o_orderkey").alias("k"), label.alias("label")).select("k", periods.parse_period("label").alias("period"))


LABELS = (
    ("EBITDA (1)", "ebitda", None), ("EV ($m)", "ev", None), ("Revenue growth %", "revenue growth %", "change"), ("Gross  Margin*", "gross margin", "ratio"), ("Revenue CAGR", "revenue cagr", "rate"),
    ("% of revenue", "% of revenue", "share"), ("$ in millions", "", None), ("Number of sites:", "number of sites", "count"), ("Cost per site", "cost per site", "rate"), ("EV / EBITDA", "ev ebitda", "ratio"),
)


def _label(t):
    k = F.col("o_orderkey") % len(LABELS)
    label = F.when(F.lit(False), "")
    for i, (raw, _, _) in enumerate(LABELS):
        label = label.when(k == i, raw)
    return t.orders.select(F.col("o_orderkey").alias("k"), label.alias("label"))


def _case(column: int) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE o_orderkey % {len(LABELS)} " + " ".join(f"WHEN {i} THEN {quoted(x[column])}" for i, x in enumerate(LABELS)) + " END"


@query(f"SELECT o_orderkey AS k, {_case(1)} AS folded FROM orders")
def label_norm(t):
    return _label(t).select("k", labels.normalise_label(F.col("label")).alias("folded"))


@query(f"SELECT o_orderkey AS k, {_case(2)} AS kind FROM orders")
def label_kind(t):
    return _label(t).select("k", labels.label_kind(F.col("label")).alias("kind"))


@query(f"WITH l AS (SELECT {_case(1)} AS label FROM orders) SELECT label, count(*) AS n FROM l WHERE length(label) > 2 AND label NOT IN ('total', 'sum', 'value', 'amount', 'figure', 'metric', 'item', 'description', 'note', 'notes', 'n a', 'other', 'various') GROUP BY 1")
def specific_labels(t):
    folded = _label(t).select(labels.normalise_label(F.col("label")).alias("label"))
    return folded.where(labels.is_specific(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT role, sum(length(text) - length(replace(text, '"', ''))) AS straight, sum(length(text) - length(replace(replace(text, '“', ''), '”', ''))) AS curly FROM
(SELECT role, CASE WHEN (conv_id + turn) % 2 = 0 THEN '"' || replace(text, '"', '') || '"' ELSE '“' || replace(text, '"', '') || '”' END AS text FROM (SELECT role, conv_id, turn, replace(replace(replace(replace(text, chr(39), ''), '‘', ''), '’', ''), '“', '') AS text FROM conversations)) GROUP BY 1""")
def ty001_quotes(t):
    bare = F.translate("text", "'‘’“\"", "")
    quoted = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.concat(F.lit('x"'), bare, F.lit('x"'))).otherwise(F.concat(F.lit("“"), bare, F.lit("”")))
    census = t.conversations.select("role", text.quote_census(quoted).alias("q"))
    return census.groupBy("role").agg(F.sum("q.straight").alias("straight"), F.sum("q.curly").alias("curly"))


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'double space' WHEN 1 THEN 'trailing whitespace' WHEN 2 THEN 'space before punctuation' WHEN 3 THEN 'space after an opening bracket' ELSE 'space before a closing bracket' END AS defect FROM part)
SELECT defect, count(*) AS n FROM r GROUP BY 1""")
def ty002_whitespace(t):
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("a  "), F.col("p_name"))).when(k == 1, F.concat(F.trim("p_name"), F.lit(" "))).when(k == 2, "one , two").when(k == 3, "( one)").otherwise("(one )")
    found = t.part.select(F.explode(text.whitespace_defects(line)).alias("defect", "n"))
    return found.groupBy("defect").agg(F.sum("n").alias("n"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'sentence' ELSE 'upper' END AS style, count(*) AS n FROM part GROUP BY 1""")
def ty004_case(t):
    k = F.col("p_partkey") % 3
    heading = F.when(k == 0, "Revenue Growth Has Slowed").when(k == 1, "Revenue growth has slowed in EMEA").otherwise("REVENUE GROWTH HAS SLOWED")
    return t.part.select(text.capitalisation(heading).alias("style")).groupBy("style").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN ends LIKE '%...' THEN 'none' WHEN ends LIKE '%.' THEN 'period' WHEN ends LIKE '%;' THEN 'semicolon' ELSE 'none' END AS terminal, count(*) AS n FROM (SELECT regexp_replace(text, '\\s+$', '') AS ends FROM documents) GROUP BY 1""")
def ty003_terminal(t):
    return t.documents.select(text.terminal(F.col("text")).alias("terminal")).groupBy("terminal").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, CASE k % 4 WHEN 0 THEN ['%Y-%m-%d'] WHEN 1 THEN CASE WHEN day(d) <= 12 THEN ['%d/%m/%Y', '%m/%d/%Y'] ELSE ['%d/%m/%Y'] END WHEN 2 THEN ['%d-%b-%y'] ELSE ['%b %d, %Y'] END AS formats FROM o""")
def ty008_dates(t):
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd-MMM-yy")).otherwise(F.date_format(d, "MMM d, yyyy"))
    first = F.element_at(text.date_candidates(F.concat(F.lit("As at "), said, F.lit("."))), 1)
    return t.orders.select(F.col("o_orderkey").alias("k"), text.date_formats(first).alias("formats"))


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders)
SELECT o_custkey, CASE WHEN count(*) FILTER (day(d) > 12) > 0 THEN '%d/%m/%Y' END AS convention FROM o GROUP BY 1""")
def date_convention(t):
    """The one all-numeric order that a body of dates proves."""
    said = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")
    return learn.date_conventions(t.orders.select("o_custkey", text.date_formats(said).alias("f")), ["o_custkey"])


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''’&.\\-]*')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''’&.\\-]*'), 1) AS i FROM documents),
n AS (SELECT w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS gram FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i))
SELECT gram, count(*) AS n FROM n WHERE gram IS NOT NULL GROUP BY 1""")
def ngram_windows(t):
    """Every three-word window of all documents, with its count."""
    grams = t.documents.select(F.explode(text.word_windows(F.col("text"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN replace(p_brand, '#', '.') ELSE lower(p_brand) END AS form FROM part),
c AS (SELECT trim(regexp_replace(regexp_replace(lower(form), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key, form, count(*) AS n FROM f GROUP BY 1, 2)
SELECT key, min_by(form, (-n, form)) AS canonical, count(*) - 1 AS variants, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""")
def canon_groups(t):
    k = F.col("p_partkey") % 4
    form = F.when(k == 0, F.col("p_brand")).when(k == 1, F.upper("p_brand")).when(k == 2, F.replace("p_brand", F.lit("#"), F.lit("."))).otherwise(F.lower("p_brand"))
    counted = t.part.select(form.alias("form")).groupBy(text.canon_key(F.col("form")).alias("key"), "form").count()
    return counted.groupBy("key").agg(F.min_by("form", F.struct(-F.col("count"), F.col("form"))).alias("canonical"), (F.count(F.lit(1)) - 1).alias("variants"), F.sum("count").alias("total"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*')) AS w FROM documents), s AS (SELECT doc_id, lower(w) AS w FROM w WHERE length(w) >= 3 AND NOT (w = upper(w) AND length(w) <= 5)),
d AS (SELECT w FROM s GROUP BY w HAVING count(*) >= 3) SELECT doc_id, count(*) AS unknown FROM s WHERE w NOT IN (SELECT w FROM d) GROUP BY 1""")
def spelling_unknown(t):
    """Words in no dictionary; here the dictionary is what the corpus writes at least three times."""
    words = t.documents.select("doc_id", F.explode(text.spell_tokens(F.col("text"))).alias("w")).select("doc_id", F.lower("w").alias("w"))
    known = words.groupBy("w").count().where("count >= 3").select("w")
    return words.join(known, "w", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unknown"))


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'TBD' WHEN 1 THEN '[ ]' WHEN 2 THEN 'PLACEHOLDER' END AS marker FROM part) SELECT marker, count(*) AS n FROM r WHERE marker IS NOT NULL GROUP BY 1""")
def hy001_markers(t):
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, "value is tbd here").when(k == 1, "tick [ ] box").when(k == 2, "a Placeholder.").otherwise("nothing tbdx")
    rows = t.part.select(line.alias("line"))
    hits = F.array_compact(F.array(*[F.when(text.matches_marker(F.col("line"), m), F.lit(m)) for m in text.MARKERS]))
    return rows.select(F.explode(hits).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, p_size * 914400 / 12700.0 AS pt, CAST(round(p_size * 72.5 * 12700) AS BIGINT) AS emu, round(p_size * 72 * 2.54 / 72, 6) AS cm, CAST((p_size * 5400000 / 60000.0) % 360 AS DOUBLE) AS degrees FROM part""")
def unit_convert(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", geometry.emu_to_pt(s * 914400).cast("double").alias("pt"), geometry.pt_to_emu(s * 72.5).alias("emu"), F.round(geometry.pt_to_cm(s * 72.0), 6).alias("cm"), geometry.angle_to_degrees(s.cast("double") * 5400000).alias("degrees"))


@query("""WITH b AS (SELECT p_partkey, 10.0 AS l, 20.0 AS t, 1.0 + p_size AS w, 30.0 AS h, radians(p_partkey % 360) AS a FROM part), r AS (SELECT *, w * abs(cos(a)) + h * abs(sin(a)) AS rw, w * abs(sin(a)) + h * abs(cos(a)) AS rh FROM b)
SELECT p_partkey, round(l + (w - rw) / 2, 4) AS "left", round(t + (h - rh) / 2, 4) AS top, round(rw, 4) AS width, round(rh, 4) AS height FROM r""")
def rotated_bbox(t):
    box = geometry.rotated_box(F.lit(10.0), F.lit(20.0), F.col("p_size") + 1.0, F.lit(30.0), (F.col("p_partkey") % 360).cast("double"))
    r = t.part.select("p_partkey", box.alias("b"))
    return r.select("p_partkey", *[F.round(f"b.{c}", 4).alias(c) for c in ("left", "top", "width", "height")])


LAB = """k AS (SELECT DISTINCT p_size AS s, lpad(hex(p_size * 333333 % 16777216), 6, '0') AS hex FROM part), c AS (SELECT s, hex, [CAST('0x' || hex[1:2] AS INTEGER) / 255.0::DOUBLE, CAST('0x' || hex[3:4] AS INTEGER) / 255.0::DOUBLE, CAST('0x' || hex[5:6] AS INTEGER) / 255.0::DOUBLE] AS v FROM k),
n AS (SELECT s, hex, list_transform(v, lambda c: CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE power((c + 0.055) / 1.055, 2.4) END) AS v FROM c),
x AS (SELECT s, hex, (v[1] * 0.4124564 + v[2] * 0.3575761 + v[3] * 0.1804375) / 0.95047 AS x, v[1] * 0.2126729 + v[2] * 0.7151522 + v[3] * 0.0721750 AS y, (v[1] * 0.0193339 + v[2] * 0.1191920 + v[3] * 0.9503041) / 1.08883 AS z FROM n),
f AS (SELECT s, hex, list_transform([x, y, z], lambda t: CASE WHEN t > 216.0 / 24389 THEN cbrt(t) ELSE (t * (24389.0 / 27) + 16) / 116 END) AS f FROM x), lab AS (SELECT s, hex, 116 * f[2] - 16 AS l, 500 * (f[1] - f[2]) AS a, 200 * (f[2] - f[3]) AS b FROM f)"""


def _colours(t):
    hex_ = F.lpad(F.hex((F.col("p_size") * 333333 % 16777216).cast("long")), 6, "0")
    return t.part.select(F.col("p_size").alias("s"), hex_.alias("hex")).distinct().withColumn("lab", geometry.to_lab(F.col("hex")))


@query(f"WITH {LAB} SELECT p.s AS one, q.s AS other, round(sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), 3) AS delta FROM lab p JOIN lab q ON q.s = p.s + 1")
def delta_e(t):
    c = _colours(t)
    p, q = c.alias("p"), c.alias("q")
    return p.join(q, F.col("q.s") == F.col("p.s") + 1).select(F.col("p.s").alias("one"), F.col("q.s").alias("other"), F.round(geometry.delta_e(F.col("p.lab"), F.col("q.lab")), 3).alias("delta"))


@query("""WITH c AS (SELECT DISTINCT p_size AS s, CAST(p_size * 5 AS DOUBLE) / 255 AS v FROM part), l AS (SELECT s, CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE power((v + 0.055) / 1.055, 2.4) END AS v FROM c), m AS (SELECT s, v * 0.6 + 0.4 AS ti, v * 0.6 AS sh FROM l)
SELECT s, round(CASE WHEN ti <= 0.0031308 THEN ti * 12.92 ELSE power(ti, 1 / 2.4) * 1.055 - 0.055 END, 6) AS tinted, round(CASE WHEN sh <= 0.0031308 THEN sh * 12.92 ELSE power(sh, 1 / 2.4) * 1.055 - 0.055 END, 6) AS shaded FROM m""")
def tint_shade(t):
    v = F.col("s") * 5 / F.lit(255.0)
    return t.part.select(F.col("p_size").alias("s")).distinct().select("s", F.round(geometry.tint(v, F.lit(0.6)), 6).alias("tinted"), F.round(geometry.shade(v, F.lit(0.6)), 6).alias("shaded"))


_FORMS = "unnest(regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{N}]*(?: \\p{Lu}[\\p{L}\\p{N}]*)*'))"


@query(f"""WITH f AS (SELECT {_FORMS} AS form FROM documents),
c AS (SELECT trim(regexp_replace(regexp_replace(translate(lower(form), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key, form, count(*) AS n
  FROM f WHERE len(string_split(form, ' ')) <= 6 GROUP BY ALL),
g AS (SELECT key, min_by(form, (-n, encode(form))) AS term, CAST(sum(n) AS BIGINT) AS n, count(*) - 1 AS variants, count(DISTINCT lower(form)) = 1 AS only_case FROM c WHERE key <> '' GROUP BY key HAVING sum(n) >= 3),
inner_ AS (
  SELECT array_to_string(w[i:i + k - 1], ' ') AS key, max(n) AS longer FROM (SELECT string_split(key, ' ') AS w, n FROM g) x, unnest(range(1, len(w))) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) GROUP BY 1
)
SELECT g.key, term, n, variants, only_case FROM g LEFT JOIN inner_ USING (key) WHERE longer IS NULL OR longer < n""")
def term_mining(t):
    """Capitalised phrases of all documents, one row for each way of writing, without those that stand only inside longer ones."""
    found = terms.canon(t.documents, [], least_words=1)
    return found.select("key", "term", "n", F.size("variants").cast("long").alias("variants"), "only_case")
