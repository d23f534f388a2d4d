"""Evidence that a place is meant, the rules that read it, and what a deck states as converted or sets apart on purpose."""

from decks import deck, table, text
from test_decks import CLEAN, PNL, found, put, read

from tallyframe.functions import text as words
from tallyframe.operators import placement

GRID = {"layout": {"grid": {"columns": [40, 300, 600], "rows": [100, 250]}, "safe_margin_pt": 10.0}}
LOOSE = lambda x, k=5, y=330: text(k, f"L{k}", "loose", (x, y, 97, 31))


def misses(spark, *slides):
    return {s for _, s in found(spark, deck(list(slides)), profile=GRID, include=["LO-003"])}


def test_near_misses(spark):
    # Off by two points; on the line; out of reach; off in its right edge; its right edge on a line; off a row line.
    assert misses(spark, LOOSE(42), LOOSE(40), LOOSE(48), LOOSE(205), text(5, "A", "on", (303, 330, 297, 31)), LOOSE(150, y=102)) == {1, 4, 6}


def test_meant_places(spark):
    thrice = [LOOSE(42, 5, 330) for _ in range(3)]
    assert misses(spark, *thrice) == set()
    shared = LOOSE(42, 5, 300) + text(6, "B", "b", (42, 350, 61, 33)) + text(7, "C", "c", (42, 400, 71, 35))
    run = "".join(text(k, f"R{k}", "r", (42 + 90 * k, 420, 70, 30)) for k in range(4))
    assert misses(spark, shared, run) == set()
    t = read(spark, deck([shared, run, LOOSE(42), *thrice]))
    rows = {(r.slide_index, r.axis, r.evidence) for r in placement.evidence(t, {"x": [40], "y": []}).collect()}
    assert {(1, "x", "aligned"), (2, "x", "spaced"), (4, "both", "repeated")} <= rows and not [r for r in rows if r[0] == 3 and r[2] in ("aligned", "spaced")]


def test_columns_of_equals(spark):
    stack = lambda *ys: "".join(text(10 + k, f"S{k}", "card", (100, y, 80, 40)) for k, y in enumerate(ys))
    content = deck([stack(100, 200, 300), stack(100, 200, 312), stack(100, 120, 300)])
    assert found(spark, content, profile={"layout": {"gutter_stdev_pt": 1.0}}, include=["LO-008"]) == {("LO-008", 2)}


def test_bleeds_and_margins(spark):
    bleed = text(9, "Device", "", (-40, 100, 200, 200)) + CLEAN[1]
    assert found(spark, deck([bleed]), include=["LO-001"]) == set() and found(spark, deck([bleed]), "excused", include=["LO-001"]) == {("LO-001", 1)}
    near = text(9, "Tag", "tag", (1, 300, 60, 20))
    assert found(spark, deck([near] * 3), include=["LO-002"]) == set() and len(found(spark, deck([near] * 3), "excused", include=["LO-002"])) == 3
    assert found(spark, deck([near]), include=["LO-002"]) == {("LO-002", 1)}


def test_stated_conversions(spark):
    pounds = [["£ in millions", "FY25A"], ["Revenue", "1,510"]]
    slides = lambda said: [table(3, PNL[:2]), table(3, pounds) + text(4, "N", said, (50, 400, 400, 30))]
    assert {s for _, s in found(spark, deck(slides("Revenue is told in pounds.")), profile={}, include=["CO-008"])} == {2}
    assert found(spark, deck(slides("That is £1,510m ($1,935m).")), profile={}, include=["CO-008"]) == set()
    assert {s for _, s in found(spark, deck(slides("That is £1,410m ($1,935m).")), profile={}, include=["CO-008"])} == {2}
    assert found(spark, deck([table(3, PNL[:2]), table(3, put(0, 0, "in millions", PNL[:2]))]), profile={}, include=["CO-008"]) == set()


def test_spacing_on_purpose(spark):
    said = ["1.   First", "one  |  two", "iv)  Fourth", "two  spaces", "a |  b  c", "x  ", None, ""]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, v string")
    got = {r.k: r.d for r in rows.select("k", words.whitespace_defects(words.without_set_spacing(rows.v)).alias("d")).collect()}
    assert [bool(got[k]) for k in range(len(said))] == [False, False, False, True, True, True, False, False]
    assert found(spark, deck([CLEAN[1] + text(5, "Q", "1.   First  |  here", (60, 300, 300, 40))]), include=["TY-002"]) == set()


def test_rules_by_kind_of_slide(spark):
    cover, body = text(2, "T", "Project review", (100, 200, 400, 60), '<p:ph type="ctrTitle"/>'), CLEAN[1] + text(5, "More", "word " * 60, (60, 300, 300, 60))
    content = deck([cover, body, body + text(6, "F", "Strictly  PRIVATE", (60, 500, 300, 20))])
    logo = lambda kinds: {"brand": {"logo": {"sha1": ["0" * 40], **({"archetypes": kinds} if kinds is not None else {})}}}
    assert {s for _, s in found(spark, content, profile=logo(None), include=["BR-001"])} == {1, 2, 3}
    assert {s for _, s in found(spark, content, profile=logo({"title": None, "content": [1, 1, 5, 5]}), include=["BR-001"])} == {2, 3}
    assert {s for _, s in found(spark, content, "unchecked", logo({"content": [1, 1, 5, 5]}), include=["BR-001"])} == {1}
    line = {"footer": {"boilerplate": ["strictly private"]}}
    assert {s for _, s in found(spark, content, profile=line, include=["BR-010"])} == {1, 2}
    assert {s for _, s in found(spark, content, profile={"footer": {"boilerplate": ["strictly private"], "archetypes": ["content"]}}, include=["BR-010"])} == {2}
