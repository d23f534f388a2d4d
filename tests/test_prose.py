"""Figures of running text, kinds of slides, and reports."""

import json

from decks import deck, table, text
from test_decks import CLEAN, PNL, TITLE, read

from tallyframe import figures, prose
from tallyframe.operators import slides
from tallyframe.rules import engine, reports

VOCABULARY = {"revenue": None, "ebitda": None, "ebitda margin": "share", "ev/ebitda": "ratio", "tier 1 capital": None}


SENTENCES = [
    ("Revenue of $1,935m in FY25A, up from $1,352m in FY23A.", [("revenue", "FY2025A", "level", 1935.0), ("revenue", "FY2023A", "level", 1352.0)]),
    ("An enterprise value of $4,180m implies 8.7x LTM EBITDA.", [("ebitda", "LTM", "ratio", 8.7)]),
    ("EBITDA margin of 24.8% in FY25A", [("ebitda margin", "FY2025A", "share", 24.8)]),
    ("64% of revenue is recurring", [("revenue", None, None, 64.0)]),
    ("Revenue grew by 9% in FY25A", [("revenue", "FY2025A", "change", 9.0)]),
    ("Costs were 12% lower", []),
    ("Multiples of 8.0x - 9.5x EBITDA", []),
    ("EBITDA was 480 and costs 12 people 1,000", [("ebitda", None, None, 480.0), ("ebitda", None, None, 12.0), ("ebitda", None, None, 1000.0)]),
    ("", []),
    (None, []),
    ("EV/EBITDA of 8.7x", [("ev/ebitda", None, "ratio", 8.7)]),
    ("12% of group revenue comes from a revenue of 30", [("revenue", None, None, 30.0)]),
    ("A 9% CAGR p.a. in revenue", []),
    ("Revenue at a 9% CAGR", [("revenue", None, "rate", 9.0)]),
    ("Revenue: (1,200)k in FY24", [("revenue", "FY2024", None, 1200.0)]),
    ("Revenue was -5 in FY24. EBITDA was £7m, in Q3 2024", [("revenue", "FY2024", None, -5.0), ("ebitda", "Q3-2024", "level", 7.0)]),
    ("Revenue in 2024 of 2024", []),
    ("The tier 1 capital is 7", [("tier 1 capital", None, None, 7.0)]),
    ("Growth was strong; revenue is 5", [("revenue", None, None, 5.0)]),
    ("Revenue moved from 5 to 9", []),
    ("Prerevenue of 5, revenues of 6", []),
    ("Revenue\u0001 \u00a0of \t 8x, a rise", [("revenue", None, "ratio", 8.0)]),
    ("Revenue " + "of " * 3000 + "7", [("revenue", None, None, 7.0)]),
]


def test_sentences(spark):
    said = [(str(k), 1, 1, 0, text) for k, (text, _) in enumerate(SENTENCES)]
    known = [(str(k), *named) for k in range(len(SENTENCES)) for named in VOCABULARY.items()]
    paragraphs = spark.createDataFrame(said * 2, "deck string, slide int, uid int, para int, text string")
    got = prose.prose_figures(paragraphs, spark.createDataFrame([*known, ("0", None, None), ("0", "", None)], "deck string, metric string, kind string")).collect()
    for k, (text, want) in enumerate(SENTENCES):
        rows = sorted((r for r in got if r.deck == str(k)), key=lambda r: r.nth)
        assert [(r.metric, r.period, r.kind, r.value) for r in rows] == want, text
        assert [r.nth for r in rows] == list(range(len(rows))) and all((r.kind is None) == (r.unread is not None) for r in rows)


def test_labels_side_by_side_and_no_rows(spark):
    paragraphs = spark.createDataFrame([("d", 1, 1, 0, "Cloud revenue of 7, and revenue 9.50%\nCloud: the 3"), ("e", 1, 1, 0, "revenue 7")], "deck string, slide int, uid int, para int, text string")
    known = spark.createDataFrame([("d", "revenue", None), ("d", "cloud", "level")], "deck string, metric string, kind string")
    rows = sorted(prose.prose_figures(paragraphs, known).collect(), key=lambda r: r.nth)
    assert [(r.deck, r.metric, r.scope, r.kind, r.value, r.decimals, r.quantity, r.raw) for r in rows] == [("d", "revenue", "cloud", None, 7.0, 0, None, "7"), ("d", "revenue", "", None, 9.5, 2, "%", "9.50%"), ("d", "cloud", "", "level", 3.0, 0, None, "3")]
    assert prose.prose_figures(paragraphs.limit(0), known).count() == 0 and prose.prose_figures(paragraphs, known.limit(0)).count() == 0


def test_text_joins_the_index_and_contradicts(spark):
    said = lambda n: text(5, "Q", f"Revenue of ${n}m in FY25A was a record.", (60, 400, 300, 40))
    for n, bad in (("1,935", False), ("1,936", True)):
        t = read(spark, deck([table(3, PNL), text(2, "T", "Costs have fallen again", None, TITLE) + said(n)]))
        rows = figures.index_of(t).where("source = 'text'").collect()
        assert [(r.metric, r.period, r.kind, r.value, r.slide) for r in rows] == [("revenue", "FY2025A", "level", float(n.replace(",", "")), 2)]
        result, _ = engine.check(t, {}, include=["CO-001"])
        assert (result.where("outcome = 'finding'").count() > 0) == bad


def test_archetypes(spark):
    cover = text(2, "T", "Project Falcon", (100, 200, 700, 80), run='sz="4000"')
    divider = text(2, "K", "SECTION 03", (100, 100, 200, 30)) + text(3, "H", "Financial performance", (100, 220, 700, 60), run='sz="3000"')
    dense = text(2, "T", "What happened", None, TITLE) + text(4, "B", "word " * 100, (60, 100, 800, 300), run='sz="1400"')
    agenda = text(2, "T", "Agenda", None, TITLE) + text(4, "B", "one two three", (60, 100, 800, 300))
    numbers = text(2, "T", "Numbers", None, TITLE) + table(3, PNL, (50, 100, 860, 400))
    t = read(spark, deck([cover, agenda, divider, dense, numbers, text(2, "T", "Disclaimer", None, TITLE), ""]))
    got = {r.slide_index: r.archetype for r in slides.archetypes(t).collect()}
    assert got == {1: "title", 2: "agenda", 3: "section_divider", 4: "content", 5: "table_heavy", 6: "disclaimer", 7: "unknown"}
    assert {r.archetype: r.slides for r in slides.slides_by_archetype(t).collect()}["content"] == [4]
    assert slides.learnable_slides(t).count() == 6
    assert {r.slide_index: r.title for r in slides.titles(t).collect()}[4] == "What happened"
    assert slides.content_box(t).where("slide_index = 5").first().right == 920.0
    assert {r.uid for r in slides.spills(t).collect()} == set()
    assert slides.edges(t).where("slide_index = 2").count() == 12


def test_furniture_boxes_and_fonts(spark):
    card = lambda k: text(7, "Card", f"card {k}", (100.1 * 1 + 0.1 * (k % 2), 200, 100, 50))
    foot = text(8, "Foot", "page", (800, 500, 50, 20), '<p:ph type="sldNum" idx="9"/>')
    t = read(spark, deck([CLEAN[1] + card(k) + foot for k in range(4)]))
    assert {r.slides for r in slides.repeated_boxes(t).where("left_pt IS NULL OR slides >= 4").collect()} == {4} if "left_pt" in slides.repeated_boxes(t).columns else slides.repeated_boxes(t).count() >= 4
    assert {(r.name, r.slides) for r in slides.recurring_elements(t).collect()} >= {("Card", 4)}
    assert slides.furniture(t).count() == 4 and slides.content_shapes(t).where("name = 'Foot'").count() == 0
    assert {r.font for r in slides.fonts_used(t).collect()} == {"Calibri"}
    assert slides.placeholder_signature(t).first().signature == ["sldNum", "title"]


def test_acceptance_intent_and_isolation(spark):
    t = read(spark, deck([CLEAN[0], CLEAN[1] + text(5, "Q", "two  spaces", (60, 300, 300, 40))], core="<dc:creator>Jane</dc:creator>"))
    result, _ = engine.check(t, {}, ["TY-002", "HY-004"])
    assert result.where("outcome = 'finding'").count() == 2
    accepted = spark.createDataFrame([("TY-002", 2, "Q")], "rule string, slide int, shape string")
    covered, _ = engine.check(t, {}, ["TY-002", "HY-004"], accepted=accepted)
    assert {(r.rule, r.outcome) for r in covered.collect()} == {("TY-002", "excused"), ("HY-004", "finding")}
    declared = result.where("rule = 'HY-004'").select("signature")
    meant, _ = engine.check(t, {}, ["TY-002", "HY-004"], intended=declared)
    assert {(r.rule, r.outcome) for r in meant.collect()} == {("TY-002", "finding"), ("HY-004", "excused")}
    only, _ = engine.check(t, {}, ["TY-002", "HY-004"], severity="blocker")
    assert {r.severity for r in only.where("outcome = 'finding'").collect()} <= {"blocker"}
    broken = {"layout": {"safe_margin_pt": {"not": "a number"}}}
    rest, skipped = engine.check(t, broken, ["LO-002", "TY-002"])
    assert dict(skipped)["LO-002"].startswith("failed") and rest.count() == 1
    assert engine.check(t, {}, ["LO-002"])[0].count() == 0


def test_reports(spark):
    t = read(spark, deck([CLEAN[0], CLEAN[1] + text(5, "Q", "two  spaces &amp; more", (60, 300, 300, 40))], core="<dc:creator>Jane</dc:creator>"))
    result, _ = engine.check(t, {}, ["TY-002", "HY-004"])
    rows = [json.loads(r.report) for r in reports.json_rows(result).collect()]
    assert {r["type"] for r in rows} == {"outcome", "summary"} and all(r["schema_version"] == 1 for r in rows)
    head = next(r for r in rows if r["type"] == "summary")
    assert head["verdict"] in ("do not send", "review first", "send") and sum(head[s] for s in ("blocker", "major", "minor", "info")) == 2
    assert "slide 2" in reports.console(result, "d0") and "document" in reports.console(result, "d0")
    assert reports.page(result, "d0").count("<tr class=") == 2 and "no findings" == reports.console(result, "other")
    assert engine.located(result, t).where("rule = 'TY-002'").first().shape == "Q"
    assert {"id", "needs", "default"} <= set(engine.rules()[0])
