"""Declared intent covers one finding and not its neighbours; what redaction writes on the way tells nothing."""

import os

from decks import deck, text
from test_decks import CLEAN, read

from tallyframe import storage
from tallyframe.operators import redaction
from tallyframe.rules import engine

GRID = {"layout": {"grid": {"columns": [40, 300], "rows": []}}}


def open_places(result):
    return sorted((r.slide_index, r.uid) for r in result.where("outcome = 'finding'").collect())


def test_one_of_two_shapes_is_declared(spark):
    # both miss a line by two points
    t = read(spark, deck([text(5, "A", "one", (42, 330, 97, 31)) + text(6, "B", "two", (42, 400, 57, 37)), text(5, "A", "one", (42, 330, 97, 31)), CLEAN[1]]))
    result = storage.written(engine.check(t, GRID, include=["LO-003"])[0], "test")
    both = open_places(result)
    assert len(both) == 3
    declared = result.where("slide_index = 1").orderBy("uid").limit(1).select("signature")
    after = storage.written(engine.check(t, GRID, include=["LO-003"], intended=declared)[0], "test")
    # the same shape at the same place on the next slide is the same statement; the other shape is not
    assert open_places(after) == [both[1]]
    assert {r.outcome for r in after.where("slide_index = 2").collect()} == {"excused"}


def test_the_slide_is_no_part_of_a_signature(spark):
    rows = spark.createDataFrame([("R", "5", "4 (slide 3)", 1.0, "m"), ("R", "5", "4 (slide 9)", 1.2, "m"), ("R", "5", "4", 1.5, "m"), ("R", None, None, None, "on slides 4 and 9"), ("R", None, None, None, "on slides 1")], "rule string, measured string, expected string, at double, message string")
    from tallyframe.plans import audit

    got = [r.s for r in rows.select(audit.stated(rows.rule, rows.measured, rows.expected, [rows["at"]], rows.message).alias("s")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4] and len(set(got)) == 3


def scratch(spark):
    base = storage.shared_folder(spark).removeprefix("file://")
    return [os.path.join(d, f) for d, _, names in os.walk(base) for f in names if "/redacted-" in d]


def test_nothing_that_identifies_is_left_on_disk(spark):
    texts = spark.createDataFrame([("p", 1, "Write to jane.doe@acme.com or Mr John Smith of Acme Capital."), ("p", 2, None)], "payload string, part int, text string")
    before = set(scratch(spark))
    out = redaction.redact(texts)
    assert {r.part: r.text is None for r in out.texts.collect()} == {1: False, 2: True}
    assert "jane.doe@acme.com" in {r.term for r in out.terms.collect()}
    new = [f for f in scratch(spark) if f not in before]
    assert new
    for f in new:
        content = open(f, "rb").read().lower()
        assert b"jane" not in content and b"acme" not in content and b"smith" not in content
    out.close()
    assert not [f for f in scratch(spark) if f not in before]
