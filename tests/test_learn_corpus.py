"""Learning from many decks in one plan: what each states, how it folds, locks, and silence on the decks learned from."""

import pytest
from decks import deck, text
from test_decks import TITLE, read

from tallyframe.learn import corpus, store
from tallyframe.rules import engine


def page(k, total, quote="“quoted”", colour="336699"):
    fill = f"<a:solidFill><a:srgbClr val='{colour}'/></a:solidFill></p:spPr>"
    return (
        text(2, "T", f"Revenue growth has slowed {'again here now once more'.split()[k % 5]}", None, TITLE) + text(4, "Body", f"A {quote} text.", (60, 200, 300, 60))
        + text(5, "Card", "", (60, 300, 200, 60)).replace("</p:spPr>", fill) + text(8, "Foot", "Strictly private", (60, 500, 200, 20)) + text(9, "No", f"Page {k + 1} of {total}", (800, 500, 100, 20))
    )


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, deck([page(k, 4) for k in range(4)]), deck([page(k, 4, "'quoted'", "AA3311") for k in range(4)]))


def test_profile_of_two_decks(spark, tables):
    profile, changes = corpus.learn_corpus(tables)
    assert profile["fonts"]["allowed"] == ["Calibri"] and profile["slide"] == {"width_pt": 960.0, "height_pt": 540.0}
    assert profile["footer"]["page_number"] == "Page {n} of 4" and "strictly private" in profile["footer"]["boilerplate"]
    assert profile["brand"]["palette_hex"] == ["336699", "AA3311"] and "logo" not in profile["brand"]
    assert {60.0, 260.0, 360.0} <= set(profile["layout"]["grid"]["columns"]) and {200.0, 500.0} <= set(profile["layout"]["grid"]["rows"])
    assert "quotes" not in profile["typography"] and profile["typography"]["title_case"] == "sentence"
    told = {r.path: r.change for r in changes.collect()}
    assert told["typography.quotes"] == "retired" and told["brand.palette_hex"] == "widened" and told["typography.title_case"] == "widened"
    rules = ["BR-004", "BR-005", "BR-006", "BR-007", "BR-009", "BR-010", "TY-004", "LO-002"]
    assert engine.check(tables, profile, rules)[0].where("outcome = 'finding'").count() == 0


def test_locks_and_base(spark, tables):
    base = {"typography": {"quotes": "straight", "title_case": "sentence"}, "brand": {"palette_hex": ["000000"]}, "fonts": {"allowed": ["Arial"]}, "locks": ["typography.quotes", "brand"]}
    profile, changes = store.learn_from_decks(tables, ["d0"], base)
    assert profile["typography"]["quotes"] == "straight" and profile["brand"] == {"palette_hex": ["000000"]}
    assert profile["fonts"]["allowed"] == ["Arial", "Calibri"]
    assert ("typography.quotes", "locked") in changes and ("fonts.allowed", "widened") in changes and "typography.title_case" not in dict(changes)


def test_fold_rules(spark):
    rows = [("", "a", "union", "x", None), ("d1", "a", "union", "y", None), ("d2", "a", "union", "x", None), ("d1", "b", "common", "p", None), ("d2", "b", "common", "p", None), ("d2", "b", "common", "q", None)]
    rows += [("d1", "c", "agree", "m", None), ("d2", "c", "agree", "m", None), ("d1", "d", "agree", "m", None), ("d2", "d", "agree", "n", None), ("d1", "e", "first", None, 960.0), ("d2", "e", "first", None, 720.0)]
    rows += [("", "f", "least", None, 4.0), ("d1", "f", "least", None, 6.0), ("d1", "g.h", "union", "z", None), ("", "i", "agree", "m", None)]
    kept, changes = corpus.fold(spark.createDataFrame(rows, corpus.ROWS), ("g",))
    got = {(r.path, r.value, r.number) for r in kept.collect()}
    assert got == {("a", "x", None), ("a", "y", None), ("b", "p", None), ("c", "m", None), ("e", None, 960.0), ("f", None, 4.0), ("i", "m", None)}
    assert {r.path: r.change for r in changes.collect()} == {"a": "widened", "b": "narrowed", "c": "widened", "d": "retired", "e": "conflict", "f": "neutral", "g.h": "locked", "i": "neutral"}
    nothing, none = corpus.fold(spark.createDataFrame([], corpus.ROWS))
    assert nothing.count() == 0 and none.count() == 0 and corpus.as_profile(nothing) == {}


def test_page_numbers_by_pattern(spark):
    good = [text(9, "No", f"{12 - 1} | Page {k + 3}", (800, 500, 100, 20)) for k in range(4)]
    odd = [text(9, "No", f"Page {x}", (800, 500, 100, 20)) for x in (1, 5, 9, 2)]
    t = read(spark, deck(good), deck(odd))
    assert {(r.deck_id, r.pattern) for r in corpus.page_numbers(t).collect()} == {("d0", "11 | Page {n}")}
    t = read(spark, deck([text(9, "No", f"Page {k} of 9", (800, 500, 100, 20)) for k in (1, 2, 2)] + [text(9, "No", "Sheet 4 of 9", (800, 500, 100, 20))]))
    result = engine.check(t, {"footer": {"page_number": "Page {n} of 4"}}, ["BR-006", "BR-007"])[0].where("outcome = 'finding'")
    assert {(r.rule, r.slide_index) for r in result.collect()} == {("BR-006", 4), ("BR-007", 3)}
