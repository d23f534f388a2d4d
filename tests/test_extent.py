"""Ink boxes, overflow, and marks that plot a value: layout against plain Python, and decks with seeded shapes."""

import math
import random

from decks import deck, table, text
from pyspark.sql import functions as F
from test_decks import CLEAN, found, read

from tallyframe.operators import extent, placement
from tallyframe.rules import engine

FACES = "font string, bold boolean, advances map<string,double>, line_em double"
CALIBRI = {c: 0.5 for c in "abcdefghijklmnopqrstuvwxyz ."}


def plain_lines(widths, space, room):
    if room <= 0:
        return 1
    lines, x = 0, 0.0
    for w in widths:
        if w > room:
            lines, x = lines + (x > 0) + math.ceil(w / room), 0.0
        elif x > 0 and x + space + w <= room:
            x += space + w
        else:
            lines, x = lines + 1, w
    return max(lines, 1)


def test_fold_against_plain_python(spark):
    rnd = random.Random(1)
    cases = [([round(rnd.uniform(1, 60), 2) for _ in range(rnd.randint(0, 12))], 3.0, rnd.choice([0.0, 20.0, 50.0, 200.0])) for _ in range(300)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, widths array<double>, space double, room double")
    got = {r.k: r.n for r in rows.select("k", extent.wrapped_lines(F.col("widths"), F.col("space"), F.col("room")).alias("n")).collect()}
    assert got == {k: plain_lines(*c) for k, c in enumerate(cases)}


def body(**stated):
    return " ".join(f'{k}="{v}"' for k, v in stated.items())


def frame(id_, name, said, at, size=10, align=None, **stated):
    made = text(id_, name, said, at, run=f'sz="{size * 100}"').replace("<a:bodyPr/>", f"<a:bodyPr {body(**stated)}/>")
    return made.replace("<a:p><a:r>", f'<a:p><a:pPr algn="{align}"/><a:r>') if align else made


def boxes(spark, slide, faces=None):
    t = read(spark, deck([slide]))
    names = {r.uid: r.name for r in t["shapes"].collect()}
    given = spark.createDataFrame(faces, FACES) if faces else None
    return {names[r.uid]: r for r in extent.ink_boxes(t, given).collect()}


def test_boxes_by_side_and_anchor(spark):
    at = (100, 100, 400, 200)
    slide = frame(3, "L", "wordmark", at) + frame(4, "C", "wordmark", at, align="ctr", anchor="ctr") + frame(5, "R", "wordmark", at, align="r", anchor="b") + frame(6, "J", "wordmark", at, align="just") + frame(7, "F", "wordmark", at).replace("</p:spPr>", "<a:solidFill><a:srgbClr val='FF0000'/></a:solidFill></p:spPr>")
    got = boxes(spark, slide)
    width, height = 8 * 10 * 1.15, 15.0
    near = lambda r, *want: all(abs(a - b) < 1e-6 for a, b in zip((r.left, r.top, r.width, r.height), want, strict=True))
    assert near(got["L"], 107.2, 103.6, width, height) and near(got["C"], 107.2 + (385.6 - width) / 2, 103.6 + (192.8 - height) / 2, width, height)
    assert near(got["R"], 107.2 + 385.6 - width, 103.6 + 192.8 - height, width, height) and near(got["J"], 107.2, 103.6, 385.6, height) and near(got["F"], *at)
    assert not got["L"].measured and got["F"].measured and not got["F"].narrowed_x
    measured = boxes(spark, slide, [("calibri", False, CALIBRI, 1.2)])
    assert near(measured["L"], 107.2, 103.6, 40.0, 12.0) and measured["L"].measured


def test_breaks_columns_and_insets(spark):
    at = (0, 100, 100, 300)
    said = "aaaa bbbb cccc"  # 46 points a word in 85.6: three lines
    broken = frame(3, "B", "aa", at).replace("<a:t>aa</a:t></a:r>", '<a:t>aa</a:t></a:r><a:br/><a:br/><a:r><a:rPr sz="1000"/><a:t>bb</a:t></a:r>')
    slide = broken + frame(4, "W", said, at) + frame(5, "N", said, at, wrap="none") + frame(6, "K", said, at, numCol=2, spcCol=0) + frame(7, "I", said, at, lIns=0, rIns=0, tIns=0)
    t = read(spark, deck([slide]))
    names = {r.uid: r.name for r in t["shapes"].collect()}
    got = {names[r.uid]: r for r in extent.laid_out(t).collect()}
    assert {k: r.lines for k, r in got.items()} == {"B": 3, "W": 3, "N": 1, "K": 6, "I": 3}
    assert got["N"].ink_x > got["N"].room_x and got["I"].room_x == 100.0 and got["K"].ink_x == got["K"].room_x


def test_overlap_of_ink_not_of_frames(spark):
    far = CLEAN[1] + frame(8, "A", "short", (400, 300, 400, 100)) + frame(9, "B", "short", (400, 360, 400, 100))
    assert found(spark, deck([far]), include=["LO-004"]) == set()
    near = CLEAN[1] + frame(8, "A", "short", (400, 300, 400, 100)) + frame(9, "B", "short", (400, 305, 400, 100))
    t = read(spark, deck([near]))
    (row,) = engine.check(t, {}, include=["LO-004"])[0].where("outcome = 'finding'").collect()
    assert row.confidence == "medium" and row.message == "text over A"
    t["faces"] = spark.createDataFrame([("calibri", False, CALIBRI, 1.2)], FACES)
    assert [r.confidence for r in engine.check(t, {}, include=["LO-004"])[0].where("outcome = 'finding'").collect()] == ["high"]


def test_overflow_needs_measures(spark):
    long = frame(5, "Q", "some words that go on and on", (60, 300, 80, 30))
    t = read(spark, deck([CLEAN[0] + long, CLEAN[1] + frame(5, "Q", "short", (60, 300, 80, 30)) + table(6, [["a", "b"]])]))
    assert not [r for r in engine.check(t, {}, include=["LO-*"])[0].collect() if r.rule == "LO-006"]  # off unless named
    run = lambda: {(r.slide_index, r.outcome, r.message) for r in engine.check(t, {}, include=["LO-006"])[0].collect()}
    assert {r[1] for r in run()} == {"unchecked"}
    t["faces"] = spark.createDataFrame([("calibri", False, CALIBRI, 1.2)], FACES)
    assert {r for r in run() if r[1] == "finding"} == {(1, "finding", "the text needs 3 lines, more than its shape holds")}
    t["faces"] = spark.createDataFrame([("calibri", False, CALIBRI | {"w": 0.1, "o": 0.1, "n": 0.1}, 0.5)], FACES)
    assert not [r for r in run() if r[1] == "finding"]


GRID = {"layout": {"grid": {"columns": [100, 400], "rows": []}}}


def bars(*spans):
    return "".join(text(20 + k, f"Bar{k}", "", (left, 120 + 40 * k, width, 20)) for k, (left, width) in enumerate(spans))


def marked(spark, slide):
    t = read(spark, deck([slide]))
    names = {r.uid: r.name for r in t["shapes"].collect()}
    return {(names[r.uid], r.axis) for r in placement.data_marks(t, 0.5).collect()}


def test_bars_and_points_plot_values(spark):
    field = bars((103, 150), (151, 190), (217, 90), (288, 130))
    labels = "".join(text(40 + k, f"Label{k}", f"Method {k}", (20, 120 + 40 * k, 60, 20)) for k in range(4))
    assert marked(spark, field + labels) == {(f"Bar{k}", "x") for k in range(4)}
    assert found(spark, deck([field + labels]), profile=GRID, include=["LO-003"]) == set()
    dots = "".join(text(20 + k, f"Dot{k}", "", (x, y, 12, 12)) for k, (x, y) in enumerate([(103, 140), (250, 205), (330, 171), (181, 302), (397, 260)]))
    assert marked(spark, dots) == {(f"Dot{k}", a) for k in range(5) for a in "xy"}
    assert found(spark, deck([dots]), profile=GRID, include=["LO-003"]) == set()


def test_cards_and_panels_plot_nothing(spark):
    cards = "".join(text(20 + k, f"Card{k}", "card", (103, 120 + 75 * k, 200, 60)) for k in range(5))
    assert marked(spark, cards) == set()
    row = "".join(text(20 + k, f"Card{k}", "card", (60 + 220 * k, 200, 200, 60)) for k in range(4))
    assert marked(spark, row) == set()
    panels = "".join(text(20 + k, f"P{k}", "", (x, 20 + 3 * k, w, 400)) for k, (x, w) in enumerate([(10, 100), (200, 150), (500, 250)]))
    assert marked(spark, panels) == set()
    assert marked(spark, bars((103, 150), (151, 190))) == set()  # two make no series
    assert found(spark, deck([cards.replace("Card0", "Lone")]), profile=GRID, include=["LO-003"]) == set()  # five share a line of their own
    assert found(spark, deck([text(20, "One", "card", (103, 120, 200, 60))]), profile=GRID, include=["LO-003"]) == {("LO-003", 1)}
