"""Joins by place against brute force, and how they are dealt out."""

import math
import random
import re

import pytest

from tallyframe.operators import cells, joins

BOX = "slide string, id long, left double, top double, width double, height double"


def plain_overlaps(rows, share):
    found = set()
    for s, i, *p in rows:
        for t, j, *q in rows:
            if s is not None and s == t and i < j and None not in (*p, *q):
                span = lambda k: max(0.0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]))  # noqa: E731, B023
                area, smaller = span(0) * span(1), min(p[2] * p[3], q[2] * q[3])
                if smaller > 0 and area / smaller > share:
                    found.add((s, i, j, area))
    return found


@pytest.mark.parametrize("share", [0.0, 0.05, 0.6])
def test_overlaps_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(cells, "BLOCK", 4)
    rnd = random.Random(5)
    size = lambda: rnd.choice([-3.0, 0.0, 2.0, 8.0, 40.0])
    rows = [("many", k, rnd.uniform(-90, 90), rnd.uniform(-90, 90), size(), size()) for k in range(150)]
    rows += [("grid", k, 10.0 * (k % 5), 1.0 * (k % 7), 12.0 + k % 3, 4.0) for k in range(90)]
    rows += [("same", k, 1.0, 1.0, 3.0, 3.0) for k in range(25)] + [("touch", k, 4.0 * k, 0.0, 4.0, 4.0) for k in range(9)]
    rows += [("wide", k, 1e4 * k, 1e3 * k, 2.0, 2.0) for k in range(20)] + [("wide", 99, -1.0, -1.0, 1e6, 1e6)]
    rows += [("none", 1, None, 1.0, 1.0, 1.0), ("none", 2, 1.0, 1.0, 1.0, None), ("none", 3, 1.0, 1.0, 1.0, 1.0), (None, 4, 1.0, 1.0, 1.0, 1.0)]
    got = joins.rect_overlaps(spark.createDataFrame(rows, BOX), ["slide"], "id", share).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_overlaps(rows, share)


def test_overlaps_are_dealt_by_cell(spark, monkeypatch):
    # 1,000 boxes in a row, of which neighbours alone overlap, and 200 in one place: no task gets a group, or a crowd
    monkeypatch.setattr(cells, "BLOCK", 50)
    rows = [("row", k, 9.0 * k, 0.0, 10.0, 5.0) for k in range(1000)] + [("heap", k, 0.0, 0.0, 10.0, 5.0) for k in range(200)]
    found = joins.rect_overlaps(spark.createDataFrame(rows, BOX), ["slide"], "id", 0.05)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[slide#\d+, cx#\d+L?, cy#\d+L?, __block#\d+L?\]", plan) and "BroadcastNestedLoopJoin" not in plan
    assert found.count() == 999 + 200 * 199 // 2


def plain_above(boxes, captions, reach):
    best = {}
    for g, i, at in boxes:
        for h, j, above in captions:
            if g is not None and g == h and None not in (at, above) and 0 < at - above <= reach:
                best[i] = min(best.get(i, (at - above, j)), (at - above, j))
    return {i: j for i, (_, j) in best.items()}


@pytest.mark.parametrize("reach", [0.1, 1, 6, 250.0])
def test_captions_against_brute_force(spark, reach):
    rnd = random.Random(9)
    places = [0.0, 0.1, 0.2, 0.6, 0.7, 0.8, 1e300, -1e300, math.inf, -math.inf, math.nan, None]
    rows = [(rnd.choice(["a", "b", None]), k, rnd.choice([rnd.uniform(-20, 20), float(rnd.randrange(-20, 20)), rnd.choice(places)])) for k in range(500)]
    rows += [("a", k % 40, rnd.uniform(0, 9)) for k in range(60)]  # ids of several places
    df = spark.createDataFrame(rows, "g string, id long, at double")
    got = joins.nearest_above(df, df.where("id % 4 = 0"), ["g"], "id", "at", reach).collect()
    want = plain_above(rows, [r for r in rows if r[1] % 4 == 0], reach)
    assert len(got) == len(want) and {r.id: r.caption for r in got} == want


def test_captions_make_no_pairs(spark):
    # 200 captions of equal height above each of 1,000 boxes: a row for each box goes to the last exchange, not for each pair
    rows = [("a", k, 5) for k in range(200)] + [("a", k, 8) for k in range(1000, 2000)]
    df = spark.createDataFrame(rows, "g string, id long, at int")
    found = joins.nearest_above(df, df.where("id < 200"), ["g"], "id", "at", 6)
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1000, 2000)}
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    assert made == [1000]
