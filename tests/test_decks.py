"""The presentation source and the rules: silent on a clean deck, one seeded defect each, refusals told apart."""

import pytest
from decks import box, deck, table, text

from tallyframe.rules import catalogue, engine
from tallyframe.sources.pptx import tables_of

TITLE = '<p:ph type="title"/>'
ROWS = [["$ in millions", "FY24A", "FY25A"], ["North", "10", "20"], ["South", "11", "21"], ["West", "12", "22"], ["Total", "33", "63"]]
CLEAN = [text(2, "T", "Revenue growth has slowed", None, TITLE) + table(3, ROWS), text(2, "T", "Costs have fallen again", None, TITLE) + text(4, "Body", "A plain body text.", (60, 200, 300, 60))]
PROFILE = {"slide": {"width_pt": 960, "height_pt": 540}, "fonts": {"allowed": ["Calibri", "Georgia"], "roles": {"title": [24, 32], "body": [10, 20], "table": [8, 14]}}, "brand": {"palette_hex": ["336699", "000000"]}, "layout": {"safe_margin_pt": 10.0, "title_box": [40, 20, 880, 60]}, "typography": {"quotes": "curly", "bullet_terminal": "none", "title_case": "sentence", "date_format": "%d-%b-%y", "currency_literals": ["$"], "canon_terms": {"North America": []}}, "footer": {}}


def read(spark, *files):
    return tables_of(spark.createDataFrame([(f"d{k}", f) for k, f in enumerate(files)], "deck_id string, content binary"))


def found(spark, content, outcome="finding", profile=PROFILE, **options):
    result, _ = engine.check(read(spark, content), profile, **options)
    return {(r.rule, r.slide_index) for r in result.where(f"outcome = '{outcome}'").collect()}


def test_source(spark):
    group = '<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="G"/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="1270000" y="0"/><a:ext cx="2540000" cy="2540000"/><a:chOff x="0" y="0"/><a:chExt cx="1270000" cy="1270000"/></a:xfrm></p:grpSpPr>' + text(10, "In", "inside", (10, 10, 20, 20)) + "</p:grpSp>"
    picture = f'<p:pic><p:nvPicPr><p:cNvPr id="11" name="Pic"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="i"/></p:blipFill><p:spPr>{box(0, 0, 40, 20)}</p:spPr></p:pic>'
    t = read(spark, deck([CLEAN[0] + group + picture, CLEAN[1]], {2}, {1: "say this"}), b"not a zip")
    decks = {r.deck_id: r for r in t["decks"].collect()}
    assert decks["d0"].width_pt == 960 and decks["d0"].minor_font == "Calibri" and decks["d1"].error and decks["d1"].slide_count is None
    shapes = {r.name: r for r in t["shapes"].where("slide_index = 1").collect()}
    assert (shapes["T"].left_pt, shapes["T"].geometry_from) == (40.0, "layout")
    assert (shapes["In"].left_pt, shapes["In"].width_pt, shapes["In"].parent_uid) == (120.0, 40.0, shapes["G"].uid)
    assert shapes["Pic"].image_width == 40 and not shapes["G"].is_leaf
    run = t["runs"].where("text LIKE 'Revenue%'").first()
    assert (run.size_pt, run.size_from, run.font, run.font_from) == (28.0, "layout", "Calibri", "theme")
    assert [r.text for r in t["table_cells"].where("row = 4").orderBy("col").collect()] == ["Total", "33", "63"]
    assert {(r.slide_index, r.is_hidden, r.notes) for r in t["slides"].collect()} == {(1, False, "say this"), (2, True, "")}


def test_clean_deck_is_silent(spark):
    assert found(spark, deck(CLEAN)) == set()


SEEDS = [
    ("CO-003", 1, [text(2, "T", "Revenue growth has slowed", None, TITLE) + table(3, [*ROWS[:-1], ["Total", "33", "99"]]), CLEAN[1]], {}),
    ("TY-001", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "a 'quoted' word", (60, 300, 300, 40))], {}),
    ("TY-002", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "two  spaces", (60, 300, 300, 40))], {}),
    ("TY-003", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "one\ntwo.", (60, 300, 300, 40), bullet=True)], {}),
    ("TY-004", 2, [CLEAN[1], text(2, "T", "Revenue Growth Has Slowed", None, TITLE) + text(4, "Body", "word " * 60, (60, 200, 300, 60))], {}),
    ("TY-005", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "in north america now", (60, 300, 300, 40))], {}),
    ("TY-006", 1, [text(2, "T", "Revenue growth has slowed", None, TITLE) + table(3, [*ROWS[:2], ["South", "11.5", "21"]]), CLEAN[1]], {}),
    ("TY-007", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "paid £5", (60, 300, 300, 40))], {}),
    ("TY-008", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "as at 2025-06-30", (60, 300, 300, 40))], {}),
    ("HY-001", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "value tbd", (60, 300, 300, 40))], {}),
    ("HY-002", 1, CLEAN, {"notes": {1: "secret"}}),
    ("HY-003", 0, CLEAN, {"hidden": {2}}),
    ("HY-004", 0, CLEAN, {"core": "<dc:creator>Jane</dc:creator>"}),
    ("HY-006", 2, [CLEAN[0], CLEAN[1] + text(5, "E", "", (60, 300, 300, 40), '<p:ph type="body" idx="7"/>')], {}),
    ("LO-001", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "falls off", (900, 300, 100, 40))], {}),
    ("LO-002", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "too far left", (1, 300, 100, 40))], {}),
    ("LO-004", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "over it", (60, 210, 300, 40))], {}),
    ("LO-007", 2, [CLEAN[0], CLEAN[1] + text(5, "Q", "huge", (60, 300, 300, 40), run='sz="4000"')], {}),
    ("BR-008", 2, [CLEAN[0], text(2, "T", "Costs have fallen again", (60, 20, 880, 60), TITLE)], {}),
]


@pytest.mark.parametrize(("rule", "slide", "slides", "options"), SEEDS, ids=[s[0] for s in SEEDS])
def test_seeded_defect(spark, rule, slide, slides, options):
    assert (rule, slide) in found(spark, deck(slides, **options), include=[rule])


def test_refusals(spark):
    prose = deck([text(2, "T", "Revenue growth has slowed", None, TITLE) + table(3, [*ROWS[:2], ["South", "see note", "21"], *ROWS[3:]]), CLEAN[1]])
    assert ("CO-003", 1) in found(spark, prose, "unchecked", include=["CO-003"]) and ("CO-003", 1) not in found(spark, prose, include=["CO-003"])
    short = deck([CLEAN[1], text(2, "T", "Short", None, TITLE) + text(4, "Body", "word " * 60, (60, 200, 300, 60))])
    assert ("TY-004", 2) in found(spark, short, "unchecked", include=["TY-*"])


def test_selection_and_skips(spark):
    _, skipped = engine.check(read(spark, deck(CLEAN)), {})
    assert ("BR-009", "slide.width_pt") in skipped and "HY-001" not in dict(skipped)
    assert [r.id for r in engine.select_rules(["CH-*"], ["CH-00[1-4]"])] == ["CH-005", "CH-006"]
    assert engine.exit_status(engine.check(read(spark, deck(CLEAN)), PROFILE, ["HY-00[1-5]"])[0]) == 0
    assert engine.exit_status(engine.check(read(spark, deck(CLEAN, core="<dc:creator>J</dc:creator>")), PROFILE, ["HY-00[1-5]"])[0]) == 1


def test_no_blocker_below_high_confidence():
    assert not [r.id for r in catalogue.RULES.values() if r.severity == "blocker" and r.confidence != "high"]


def test_learn_then_check_is_silent_and_merge(spark):
    from tallyframe import learn

    slides = [text(2, "T", f"Revenue growth has slowed {k}", None, TITLE) + text(4, "Body", "A “quoted” text.", (60, 200, 300, 60)) for k in ("again", "here", "now")]
    tables = read(spark, deck(slides))
    profile, _ = learn.learn(tables, "d0")
    assert profile["typography"]["title_case"] == "sentence" and profile["typography"]["quotes"] == "curly" and profile["fonts"]["allowed"] == ["Calibri"]
    result, _ = engine.check(tables, profile, ["TY-001", "TY-004", "BR-005", "BR-009", "LO-002"])
    assert result.where("outcome = 'finding'").count() == 0
    other = {"typography": {"quotes": "straight"}, "fonts": {"allowed": ["Arial"]}, "layout": {"safe_margin_pt": 2.0}, "footer": {}}
    merged, changes = learn.merge(profile, other, locked=("layout",))
    assert "quotes" not in merged["typography"] and merged["fonts"]["allowed"] == ["Calibri", "Arial"]
    assert ("layout.safe_margin_pt", "locked") in changes and ("typography.quotes", "retired") in changes


def test_fix_plan_and_stream(spark, tmp_path):
    from tallyframe import fix, streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pptx").write_bytes(deck(CLEAN, core="<dc:creator>Jane</dc:creator>"))
    plans = []
    query = streaming.watch(spark, str(tmp_path / "in"), {}, lambda r, n: plans.extend(fix.plan_fixes(r).collect()), str(tmp_path / "ck"), ["HY-004", "HY-002"])
    query.awaitTermination(120)
    assert [(p.operation, p.payload, p.slides) for p in plans] == [("drop property", "Jane", [0])]


PNL = [["$ in millions", "FY23A", "FY24A", "FY25A"], ["Revenue", "1,352", "1,624", "1,935"], ["Gross profit", "744", "901", "1,084"], ["EBITDA", "312", "389", "480*"], ["EBITDA margin", "23.1%", "24.0%", "24.8%"]]
CAGR = [["Metric", "Value"], ["Revenue CAGR FY23A-FY25A", "19.6%"]]


def tie_out(spark, rules, pnl=PNL, second=None, cagr=CAGR, outcome="finding"):
    # A rate and its series stand in tables of their own; the second table states facts again.
    slides = [table(3, pnl) + table(4, cagr, (500, 120, 300, 60)), table(3, second or pnl[:3])]
    return found(spark, deck(slides), outcome, {}, include=rules)


def put(row, col, value, base=PNL):
    return [[value if (r, c) == (row, col) else x for c, x in enumerate(line)] for r, line in enumerate(base)]


def test_figures_that_tie_are_silent(spark):
    assert tie_out(spark, ["CO-00[12468]"]) == set()


@pytest.mark.parametrize(
    ("rule", "options"),
    [
        ("CO-004", {"pnl": put(4, 3, "26.8%")}),
        ("CO-001", {"second": put(1, 3, "1,936", PNL[:3])}),
        ("CO-002", {"second": put(1, 3, "1,935,000", PNL[:3])}),
        ("CO-008", {"second": put(0, 0, "US$ billions", PNL[:2])}),
    ],
)
def test_seeded_figure(spark, rule, options):
    assert rule in {r for r, _ in tie_out(spark, [rule], **options)}
