"""Rules over rows, bridges, dates, recurring elements and spelling; profiles as files; small functions."""

import pytest
from decks import deck, table, text
from pyspark.sql import functions as F
from test_decks import CLEAN, PNL, TITLE, found, read

from tallyframe.functions import geometry, periods
from tallyframe.functions import text as words
from tallyframe.learn import store
from tallyframe.rules import engine

BRIDGE = [["$m", "FY25A"], ["Opening cash", "100"], ["Operations", "30"], ["Investment", "(20)"], ["Closing cash", "110"]]
DATED = [["$m", "Value"], ["EBITDA FY24A", "100"], ["Volume", "30"], ["Price", "(20)"], ["EBITDA FY25A", "110"]]


def put(rows, r, c, value):
    return [[value if (i, j) == (r, c) else x for j, x in enumerate(line)] for i, line in enumerate(rows)]


@pytest.mark.parametrize(("rows", "want"), [(BRIDGE, None), (DATED, None), (put(BRIDGE, 4, 1, "113"), "finding"), (put(DATED, 4, 1, "119"), "finding"), (put(BRIDGE, 4, 0, "Other"), "unchecked"), (PNL, None)])
def test_bridges(spark, rows, want):
    content = deck([table(3, rows)])
    got = {o for o in ("finding", "unchecked") if found(spark, content, o, {}, include=["CO-007"])}
    assert got == ({want} if want else set())


def test_as_of_dates(spark):
    slide = lambda d: table(3, PNL) + text(4, "N", f"Figures as at {d}.", (50, 400, 300, 30))
    assert not found(spark, deck([slide("30-Jun-25"), slide("30-Jun-25")]), profile={}, include=["CO-009"])
    assert {s for _, s in found(spark, deck([slide("30-Jun-25"), slide("31-Dec-25")]), profile={}, include=["CO-009"])} == {2}


def test_rows_and_recurring_elements(spark):
    cards = lambda *xs: "".join(text(10 + k, f"C{k}", "card", (x, 200, 80, 40)) for k, x in enumerate(xs))
    profile = {"layout": {"gutter_stdev_pt": 1.0, "recurring": [{"kind": "text", "name": "Tag", "left": 800.0, "top": 20.0}]}}
    tag = lambda x: text(20, "Tag", "tag", (x, 20, 60, 20))
    content = deck([cards(100, 200, 300) + tag(800), cards(100, 200, 310) + tag(810), cards(100, 200, 230)])
    assert found(spark, content, profile=profile, include=["LO-008"]) == {("LO-008", 2)}
    assert found(spark, content, profile=profile, include=["LO-005"]) == {("LO-005", 2)}


def test_spelling(spark):
    t = read(spark, deck([CLEAN[1] + text(5, "Q", "Teh quick board's xyzzy", (60, 300, 300, 40))]))
    assert dict(engine.check(t, {}, ["TY-009"])[1])["TY-009"].startswith("failed")
    t["dictionary"] = spark.createDataFrame([(w,) for w in "costs have fallen again plain body text quick board".split()], "word string")
    rows = engine.check(t, {"typography": {"canon_terms": {"Xyzzy": []}}}, ["TY-009"])[0].collect()
    assert [(r.rule, r.message) for r in rows] == [("TY-009", "in no dictionary: teh")]
    assert engine.check(t, {}, ["TY-*"])[0].where("rule = 'TY-009'").count() == 0


def test_profiles_as_files():
    profile = {"typography": {"quotes": "curly", "canon_terms": {"North # America": []}}, "layout": {}, "locks": ["fonts"], "provenance": {"typography.quotes": "invariant over 9", "typography": "learned"}}
    again = store.parse(store.emit(profile))
    assert {k: v for k, v in again.items() if k != "provenance"} == {k: v for k, v in profile.items() if k != "provenance"} and again["provenance"] == {"typography.quotes": "invariant over 9"}
    rows = {path: (value, why) for path, value, why in store.show(profile)}
    assert rows["typography.quotes"][1] == "invariant over 9" and rows["typography.canon_terms"][1] == "learned"
    assert store.lock(store.lock(profile, "fonts.allowed"), "layout")["locks"] == ["fonts", "layout"] and store.lock({"locks": ["a.b"]}, "a")["locks"] == ["a"]
    with pytest.raises(ValueError):
        store.parse("  stray: 1")


def test_profile_of_several_decks(spark):
    t = read(spark, deck([CLEAN[1]] * 3), deck([CLEAN[1]] * 3))
    profile, _ = store.learn_from_decks(t, ["d0", "d1"])
    assert profile["fonts"]["allowed"] == ["Calibri", "Georgia"] or "Calibri" in profile["fonts"]["allowed"]
    assert store.review_reference(t, profile, ["BR-005", "BR-009", "LO-002"]).count() == 0


def test_small_functions(spark):
    row = spark.createDataFrame([("Gill Sans Light Italic", "in FY25A and Q1 2026", "Dear [NAME_1], [NAME_10]", {"[NAME_1]": "Ann", "[NAME_10]": "Bob"})], "face string, said string, text string, terms map<string,string>")
    got = row.select(words.font_base_name(F.col("face")).alias("face"), periods.period_spans("said").alias("spans"), words.restored(F.col("text"), F.col("terms")).alias("text"), geometry.approx_equal(F.lit(1.0), F.lit(1.2), 0.25).alias("near"), geometry.approx_equal(F.lit(None).cast("double"), F.lit(1.2), 0.25).alias("never")).first()
    assert got.face == "gill sans" and got.text == "Dear Ann, Bob" and got.near and not got.never
    assert [(s.start, s.end) for s in got.spans] == [(3, 8), (13, 20)] and [s.period for s in got.spans][0] == "FY2025A"
