"""Statements of one fact against plain Python, and what decks leave unchecked; vocabularies, palettes and nearest means."""

import random

from decks import deck, table, text
from pyspark.sql import functions as F
from test_decks import PNL, found

from tallyframe import learn
from tallyframe.functions import geometry, labels
from tallyframe.functions import text as words
from tallyframe.operators import consistency, stats

FACT = "ord int, deck string, metric string, scope string, quantity string, period string, place string, kind string"


def test_unread_against_plain_pairs(spark):
    rng = random.Random(3)
    some = lambda *v: rng.choice(v)
    rows = [(i, some("d", "e"), some("m", "n"), some("", None), some(None, "%"), some("p", "q", None), some("a", "b", "c"), some("level", None)) for i in range(150)] + [(900, "f", "m", "", None, None, "a", None)]
    want = {}
    for x in rows:
        n = sum(1 for y in rows if x[1:5] == y[1:5] and x[6] != y[6] and (x[5] is None or y[5] is None or x[5] == y[5]))
        if x[7] is None and n:
            want[x[0]] = n
    f = spark.createDataFrame(rows, FACT)
    assert {r.ord: r.others for r in consistency.unread(f).collect()} == want and 900 not in want
    assert consistency.unread(f.limit(0)).count() == 0 and consistency.unread(f.where("kind = 'level'")).count() == 0


def test_drift_from_the_first_statement(spark):
    rows = [(3, "d", "m", None, None, None, "a", "level", "30-jun"), (1, "d", "m", None, None, None, "b", "level", "31-dec"), (2, "d", "m", None, None, None, "c", "level", "31-dec"), (4, "d", "m", None, None, "p", "c", "level", "30-jun"), (0, "d", "m", None, None, None, "c", None, "1-jan"), (5, "d", "m", None, None, None, "c", "level", None)]
    got = consistency.date_drift(spark.createDataFrame(rows, FACT + ", date string")).collect()
    assert [(r.ord, r.date, r.first) for r in got] == [(3, "30-jun", "31-dec")]


def test_longest_first_against_sorting(spark):
    rows = [(k, w) for k in ("a", "b") for w in "net revenue,ebitda,ebit,capex,cash,fte,net debt".split(",")][:-2]
    got = labels.longest_first(spark.createDataFrame(rows, "k string, w string"), ["k"], "w").collect()
    for k in "ab":
        assert [r.w for r in sorted((r for r in got if r.k == k), key=lambda r: r.position)] == sorted((w for x, w in rows if x == k), key=lambda w: (-len(w), w))
        assert sorted(r.position for r in got if r.k == k) == list(range(1, sum(r.k == k for r in got) + 1))


def test_date_conventions(spark):
    rows = [("a", "03/04/2025"), ("a", "25/04/2025"), ("b", "03/04/2025"), ("c", "25/04/2025"), ("c", "04/25/2025"), ("d", "2025-04-25")]
    dates = spark.createDataFrame(rows, "deck_id string, said string").withColumn("f", words.date_formats(F.col("said")))
    assert {r.deck_id: r.convention for r in learn.date_conventions(dates, ["deck_id"]).collect()} == {"a": "%d/%m/%Y", "b": None, "c": None, "d": None}


def test_palette_tolerance_against_all_pairs(spark):
    rng = random.Random(5)
    decks = {"one": ["336699"], "far": ["000000", "FFFFFF"], "wide": ["336699", "34689A", "FF0000"], "many": [f"{rng.randrange(256):02X}{rng.randrange(256):02X}{rng.randrange(256):02X}" for _ in range(40)]}
    rows = spark.createDataFrame([(d, h, 100 - i) for d, hs in decks.items() for i, h in enumerate(hs)], "deck string, hex string, weight int").withColumn("lab", geometry.to_lab(F.col("hex")))
    members = stats.palette_greedy(rows.select("deck", "hex", "weight", "lab.*"), ["deck"], 3.0)
    lab = {(r.deck, r.hex): (r.lab.l, r.lab.a, r.lab.b) for r in rows.collect()}
    apart = lambda d, x, y: sum((p - q) ** 2 for p, q in zip(lab[d, x], lab[d, y], strict=True)) ** 0.5
    want = {}
    for d in decks:
        mine = [r for r in members.collect() if r.deck == d]
        heads = sorted({r["head"] for r in mine})
        admits = round(max(apart(d, r.hex, r["head"]) for r in mine) + 0.1, 2)
        half = max(2.0, min([6.0, *(apart(d, x, y) / 2 for x in heads for y in heads if x < y)]))
        want[d] = round(max(2.0, admits) if len(heads) < 2 else min(admits, 6.0) if admits > half else half, 2)
    assert {r.deck: r.tolerance for r in stats.palette_tolerance(members, ["deck"]).collect()} == want
    assert want["one"] == 2.0 and want["far"] == 6.0


def test_nearest_mean_in_blocks(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 9 == 0 else f"l{i % 23}", None if i == 5 else [rng.random() for _ in range(4)]) for i in range(120)]
    by = {}
    for _, label, v in rows:
        if label and v:
            by.setdefault(label, []).append(v)
    means = {label: [sum(x) / len(vs) for x in zip(*vs, strict=True)] for label, vs in by.items()}
    far = lambda v, m: round(sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), 9)
    want = {i: min((far(v, m), label) for label, m in means.items())[1] for i, _, v in rows if v}
    df = spark.createDataFrame(rows, "id int, label string, v array<double>")
    for block in (1, 4, 256):
        assert {r.id: r.nearest for r in stats.nearest_mean(df, "id", "label", "v", block).collect()} == want
    assert stats.nearest_mean(df.limit(0), "id", "label", "v").count() == 0


def test_statements_of_unknown_kind_are_unchecked(spark):
    said = text(5, "Q", "Cloud revenue was 7% and rose in FY25A.", (60, 400, 300, 40))
    twice = deck([table(3, PNL) + said, said.replace("7%", "8%")])
    assert found(spark, twice, profile={}, include=["CO-001"]) == set()
    assert found(spark, deck([table(3, PNL) + said]), "unchecked", profile={}, include=["CO-001"]) == set()
    assert {s for _, s in found(spark, twice, "unchecked", profile={}, include=["CO-001"])} == {1, 2}
