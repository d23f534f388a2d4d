"""Warehouse queries over their whole tables, against plain Python: no part of a table may be left out."""

import re
from collections import Counter, defaultdict

from tallyframe import queries as warehouse
from tallyframe.queries import typography
from tallyframe.queries.binding import Tables


def run(spark, path, name):
    return warehouse.queries()[name](spark, str(path)).collect()


def test_every_order_is_totalled(spark, data):
    lines = defaultdict(int)
    for r in Tables(spark, data).lineitem.select("l_orderkey").collect():
        lines[r.l_orderkey] += 1
    want = set()
    for k, n in lines.items():
        tied = n >= 2 and (k % 12 != 0 or 5 <= 0.005 * (n + 1))
        want.add((k, n + 1, "tied" if tied else "finding" if n >= 3 else "nothing", n if n >= 3 else 0))
    assert {k % 4 for k in lines} == {0, 1, 2, 3}
    got = [(r.k, r.row, r.outcome, r.addends) for r in run(spark, data, "co003_total")]
    assert len(got) == len(want) and set(got) == want


def test_every_number_is_restated_as_written(spark, data):
    cells = typography.rendered(Tables(spark, data)).collect()
    want = {r.k: r.cell for r in cells if r.k % 8 <= 4}
    assert {k % 8 for k in want} == {0, 1, 2, 3, 4}
    got = run(spark, data, "restate")
    assert len(got) == len(want) and {r.k: r.written for r in got} == want


def test_summary_counts_every_finding(spark, data):
    severities = ("blocker", "major", "minor", "info")
    want = {(None, s): 0 for s in severities}
    for r in Tables(spark, data).orders.select("o_orderkey", "o_custkey").collect():
        slide, severity = r.o_custkey % 200, severities[r.o_orderkey % 4]
        for s in severities:
            want.setdefault((slide, s), 0)
        want[slide, severity] += 1
        want[None, severity] += 1
    got = run(spark, data, "audit_summary")
    assert len(got) == len(want) and {(r.slide, r.severity): r.n for r in got} == want


def test_the_nearest_event_of_any_residue(spark, data):
    t = Tables(spark, data)
    events = defaultdict(list)
    for r in t.events.select("user_id", "event_id", "ts").collect():
        events[r.user_id].append((r.ts, r.event_id))
    want = {}
    for r in t.orders.select("o_orderkey", "o_custkey").collect():
        earlier = [x for x in events[r.o_custkey % 1000] if x[1] <= r.o_orderkey]
        if earlier:
            want[r.o_orderkey] = max(earlier)[1]
    assert any(k % 3 != v % 3 for k, v in want.items())
    got = run(spark, data, "asof_event")
    assert len(got) == len(want) and {r.o_orderkey: r.event_id for r in got} == want


def test_windows_of_all_languages_and_counts(spark, tmp_path):
    rows = [(1, "the cat sat. the cat", "en"), (2, "the cat sat. the cat", "fr"), (3, "ein Hund lief", "de"), (4, "two words", "en"), (5, None, "es"), (6, "", "en"), (7, "a-b c'd e&f g", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for _, said, _ in rows:
        words = re.findall(r"[A-Za-z0-9][A-Za-z0-9'’&.\-]*", said or "")
        want.update(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
    got = run(spark, tmp_path, "ngram_windows")
    assert len(got) == len(want) == 6 and {r.gram: r.n for r in got} == want
