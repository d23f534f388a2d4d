"""Scalar functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels, numbers, periods, text
from tallyframe.operators import redaction, stats

NUMBERS = [
    ("1,908", (1908.0, 0, ",", None, None, None)), ("(42)", (-42.0, 0, None, "parentheses", None, None)), ("−3.5%", (-3.5, 1, None, "minus", None, "%")), ("US$1,935m", (1935.0, 0, ",", None, "US$", "m")),
    ("12.4x", (12.4, 1, None, None, None, "x")), ("(12", None), ("n.a.", None), ("480*", None), ("", None), (None, None), ("1 234.50", (1234.5, 2, " ", None, None, None)),
]
PERIODS = [
    ("FY24A", "FY2024A"), ("2025E", "FY2025E"), ("Q1 2026", "Q1-2026"), ("1Q24", "Q1-2024"), ("H1 24", "H1-2024"), ("9M 2025", "9M-2025"), ("LTM Sep-25", "LTM-SEP-2025"), ("CY2024", "CY2024"),
    ("2025 Budget", "FY2025B"), ("FY23A-FY25A", "FY2023A..FY2025A"), ("no period", None), ("$9m 2025", "FY2025"), (None, None), ("LTM", "LTM"),
]


def column(spark, values, f, dtype="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {dtype}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "k").orderBy("k").select("x").collect()]


def test_numbers(spark):
    got = column(spark, [t for t, _ in NUMBERS], numbers.parse_number)
    assert [None if g is None else tuple(g) for g in got] == [w for _, w in NUMBERS]


def test_footnotes(spark):
    got = column(spark, ["480*", "$480m(1)", "58.1 (a)", "(5)", "(1,234)"], numbers.read_cell)
    assert [g.value for g in got] == [480.0, 480.0, 58.1, -5.0, -1234.0]


@pytest.mark.parametrize(("label", "want"), PERIODS)
def test_periods(label, want):
    assert periods.period_of(label) == want


def test_period_column(spark):
    assert column(spark, [p for p, _ in PERIODS], periods.parse_period) == [w for _, w in PERIODS]


def test_labels(spark):
    got = column(spark, ["EBITDA(1)", "EV ($m)", "$ in millions", "Top 10", "FY24"], labels.normalise_label)
    assert got == ["ebitda", "ev", "", "top 10", "fy24"]
    assert column(spark, ["total", "total 2023a-2027e", "total addressable market"], labels.is_total) == [True, True, False]
    assert column(spark, ["revenue cagr", "cagr", "revenue"], labels.base_metric) == ["revenue", None, None]


def test_text(spark):
    assert column(spark, ["Growth", "The Growth Of Sales", "Revenue has slowed again", "ALL CAPS HERE"], text.capitalisation) == [None, "title", "sentence", "upper"]
    assert column(spark, ["a...", "a.", "a;", "", "a?"], text.terminal) == ["none", "period", "semicolon", "none", "none"]
    assert column(spark, ["30-Jun-25", "05/06/2026", "13/06/2026", "31/02/2026"], text.date_formats) == [["%d-%b-%y"], ["%d/%m/%Y", "%m/%d/%Y"], ["%d/%m/%Y"], []]
    assert column(spark, ["a  b ,c ", "clean"], text.whitespace_defects) == [{"double space": 1, "trailing whitespace": 1, "space before punctuation": 1}, {}]


def test_detectors(spark):
    found = column(spark, ["mail j.doe@corp.com or NYSE: MRDN, Project Falcon by Mr Jan van Dijk at 12 High Street, SW1A 1AA"], redaction.detect)[0]
    assert {(s.kind, s.text) for s in found} >= {("email", "j.doe@corp.com"), ("ticker", "MRDN"), ("codename", "Falcon"), ("person", "Jan van Dijk"), ("address", "12 High Street"), ("postcode", "SW1A 1AA")}


def test_classes(spark):
    def of(values, required=3):
        rows = spark.createDataFrame([("k", v) for v in values], "k string, v string")
        return stats.classify(stats.dominance(rows, ["k"], "v", F.lit(1)), ["k"], required).first()

    assert of(["a"] * 3)["class"] == "invariant"
    assert of(["a"] * 17 + ["b"] * 3)["class"] == "dominant"
    assert of(["a", "b"] * 4)["class"] == "multimodal"
    assert of(list("abcdefghijkl"))["class"] == "variable"
    assert of(["a", "a"])["class"] == "variable"


def test_clusters(spark):
    rows = spark.createDataFrame([("k", v, 1.0) for v in (871.9, 872.1, 840.0, 840.0, 900.0)], "k string, v double, w double")
    got = stats.cluster_stats(stats.cluster_1d(rows, ["k"], "v", "w", 2.0), ["k"]).orderBy("cluster").collect()
    assert [(r.mode, r.support) for r in got] == [(840.0, 2), (871.9, 2), (900.0, 1)]
