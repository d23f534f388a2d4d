"""Single linkage against brute force, and marks drawn from a badge and a wordmark."""

import random

import pytest
from decks import box, deck, text
from test_decks import CLEAN, read

from tallyframe import learn
from tallyframe.operators import cells, linkage, slides


def plain_groups(rows):
    tied = {r[:2]: r[1] for r in rows}
    near = lambda p, q: all(max(p[i] - q[i] - q[i + 2], q[i] - p[i] - p[i + 2]) <= max(p[5], q[5]) for i in (2, 3))
    changed = True
    while changed:
        changed = False
        for p in rows:
            for q in rows:
                if p[0] == q[0] and near(p, q) and tied[p[:2]] < tied[q[:2]]:
                    tied[q[:2]] = tied[p[:2]]
                    changed = True
    return tied


def test_components_of_boxes_against_brute_force(spark):
    rnd = random.Random(7)
    # a long chain, boxes over many cells, boxes of no size, and boxes at negative places
    rows = [("chain", k, k * 11.0, 3.0, 9.0, 2.0) for k in range(60)]
    rows += [(s, k, rnd.uniform(-50, 500), rnd.uniform(-50, 300), rnd.choice([0.0, 5.0, 200.0]), rnd.choice([0.0, 2.0, 9.0])) for s in ("a", "b") for k in range(70)]
    df = spark.createDataFrame(rows, "slide string, id long, left_pt double, top_pt double, width_pt double, height_pt double")
    pairs = linkage.sits_with(df, ["slide"], "id")
    assert pairs.count() == pairs.distinct().count()
    got = {(r.slide, r.id): r.label for r in linkage.components(df, pairs, ["slide"]).collect()}
    want = plain_groups(rows)
    assert got == want and {want["chain", k] for k in range(60)} == {0} and len(set(want.values())) > 10
    none = df.where("false")
    assert linkage.groups(none, ["slide"], "id").count() == 0


def test_crowds_make_no_pairs(spark, monkeypatch):
    # 1,200 boxes in a heap and a heap of points: all pairs of them would be 1.4 million rows
    rnd = random.Random(3)
    rows = [("heap", k, rnd.uniform(0, 30), rnd.uniform(0, 10), rnd.uniform(20, 40), rnd.uniform(8, 12)) for k in range(1200)]
    rows += [("points", k, 7.0, 7.0, 0.0, 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "slide string, id long, left_pt double, top_pt double, width_pt double, height_pt double")
    sizes, written = [], linkage.written

    def counted(table, label):
        out = written(table, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(linkage, "written", counted)
    got = {(r.slide, r.label, r.members) for r in linkage.groups(df, ["slide"], "id").collect()}
    assert got == {("heap", 0, 1200), ("points", 0, 300)} and max(sizes) <= 20 * len(rows)


@pytest.mark.parametrize("limit", [0, 1 << 17])
def test_ties_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(linkage, "LOCAL", limit)
    monkeypatch.setattr(cells, "BLOCK", 5)
    rnd = random.Random(11)
    # small clusters that share the cells of a few large boxes, boxes of no size or of a negative one, one box far larger than all
    rows = [("small", k, 40.0 * rnd.randrange(6) + rnd.uniform(0, 9), 30.0 * rnd.randrange(4) + rnd.uniform(0, 5), rnd.uniform(0, 3), rnd.choice([0.0, 0.5, 2.0])) for k in range(240)]
    rows += [("small", 1000 + k, 600.0 + k, 700.0, 300.0, 200.0) for k in range(3)]
    rows += [("sizes", k, rnd.uniform(-90, 90), rnd.uniform(-90, 90), rnd.choice([-4.0, 0.0, 3.0, 30.0]), rnd.choice([-3.0, 0.0, 1.0, 6.0])) for k in range(120)]
    rows += [("wide", k, 5e3 * k, 100.0 * k, 2.0, 2.0) for k in range(30)] + [("wide", 99, 2e4, -50.0, 1e5, 700.0)]
    rows += [("twice", k, x, 0.0, 2.0, 2.0) for k, x in ((5, 0.0), (5, 500.0), (6, 501.0), (4, 3.0), (5, 1000.0), (3, 1001.0), (9, 800.0))]
    want = plain_groups(rows)
    assert len({(s, label) for (s, _), label in want.items() if s == "small"}) > 20
    shape = "slide string, id long, left_pt double, top_pt double, width_pt double, height_pt double"
    rows += [("none", 1, None, 1.0, 1.0, 1.0), ("none", 2, 1.0, 1.0, 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0, 1.0)]
    want |= {("none", 1): 1, ("none", 2): 2}
    named = {}
    for r in linkage.tied(spark.createDataFrame(rows, shape), ["slide"], "id").collect():
        named.setdefault((r.slide, r.tie), set()).add(r.id)
    apart = {}
    for (slide, k), label in want.items():
        apart.setdefault((slide, label), set()).add(k)
    assert sorted((s, sorted(x)) for (s, _), x in named.items()) == sorted((s, sorted(x)) for (s, _), x in apart.items())


def mark(x, y):
    """A badge with a monogram on it and a wordmark beside it."""
    return text(30, "Badge", "", (x, y, 24, 24)) + text(31, "Mono", "VC", (x + 2, y + 2, 20, 20)) + text(32, "Word", "Vantara Capital", (x + 30, y + 2, 90, 20))


FOOT = text(40, "Foot", "Strictly private", (60, 510, 200, 12))


def test_drawn_marks(spark):
    panel = text(41, "Panel", "", (40, 300, 500, 235))  # lies under the footer and dwarfs it
    t = read(spark, deck([CLEAN[1] + mark(800, 10) + FOOT + panel, CLEAN[1] + mark(800, 10) + mark(100, 400) + FOOT]))
    repeated = learn.boilerplate(t)
    assert {r.line for r in repeated.collect()} >= {"strictly private", "vantara capital"}
    names = spark.createDataFrame([("d0", "vc"), ("d0", "vantara capital"), ("d0", "strictly private")], "deck_id string, line string")
    lines = linkage.lockup_lines(t, names)
    assert {r.line for r in lines.collect()} == {"vc", "vantara capital"}
    found = sorted((r.slide_index, r.left_pt, r.top_pt, r.width_pt, r.height_pt) for r in linkage.logo_marks(t, None, lines).collect())
    assert found == [(1, 800.0, 10.0, 120.0, 24.0), (2, 100.0, 400.0, 120.0, 24.0), (2, 800.0, 10.0, 120.0, 24.0)]


def picture(at, name="Logo", id_=50):
    return f'<p:pic><p:nvPicPr><p:cNvPr id="{id_}" name="{name}"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="i"/></p:blipFill><p:spPr>{box(*at)}</p:spPr></p:pic>'


def test_variants_fill_the_slot(spark):
    t = read(spark, deck([picture((800, 10, 80, 40)), picture((801, 11, 80, 40)), picture((300, 10, 80, 40))]))
    shapes = t["shapes"]
    from pyspark.sql import functions as F

    t["shapes"] = shapes.withColumn("image_sha1", F.concat(F.lit("h"), F.col("slide_index").cast("string")))
    known = spark.createDataFrame([("d0", "h1")], "deck_id string, image_sha1 string")
    assert [r.image_sha1 for r in linkage.logo_variants(t, known).collect()] == ["h2"]
    marks = linkage.logo_marks(t, known)
    assert [(r.slide_index, r.left_pt, r.drawn) for r in marks.collect()] == [(1, 800.0, False)]
    assert slides.logo_hashes(t).count() == 0
