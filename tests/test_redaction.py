"""Detectors one kind at a time, and redaction of whole payloads: what is caught, what is left alone, and the way back."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import identifying, redaction

CAUGHT = [
    ("email", "mail j.okafor@meridian.com now", "j.okafor@meridian.com"),
    ("email", "write to a@b.io.", "a@b.io"),
    ("url", "see www.example.com/deals.", "www.example.com/deals"),
    ("url", "see https://dealroom.example.com/atlas?id=4 for it", "https://dealroom.example.com/atlas?id=4"),
    ("url", "hosted at meridiancapital.com", "meridiancapital.com"),
    ("path", "in C:\\deals\\model.xlsx today", "C:\\deals\\model.xlsx"),
    ("path", "in /Users/jane/model.xlsx", "/Users/jane/model.xlsx"),
    ("phone", "call +44 20 7123 4567.", "+44 20 7123 4567"),
    ("phone", "desk 020 7946 0102, ext 4", "020 7946 0102"),
    ("phone", "ring (0207) 946 0102", "(0207) 946 0102"),
    ("ticker", "listed (NYSE: MRDN) since", "MRDN"),
    ("handle", "ask @deal_team", "@deal_team"),
    ("company", "acquired by Rossi & Figli S.p.A. in 2024", "Rossi & Figli S.p.A"),
    ("company", "Bank of the West Holdings filed", "Bank of the West Holdings"),
    ("company", "by the CFO of Meridian Capital Partners LLP", "Meridian Capital Partners LLP"),
    ("company", "London EC2M 2PF\nThe Meridian Group", "Meridian Group"),
    ("codename", "codename Blue Ridge", "Blue Ridge"),
    ("person", "Jane Okafor, CFO", "Jane Okafor"),
    ("person", "CFO, Jane Okafor", "Jane Okafor"),
    ("person", "Managing Director Ade Balogun", "Ade Balogun"),
    ("person", "by Mr. Jan van Dijk at noon", "Jan van Dijk"),
    ("person", "it is sound, Jane Okafor said", "Jane Okafor"),
    ("address", "at 12 High Street, London", "12 High Street"),
    ("postcode", "London SW1A 1AA", "SW1A 1AA"),
]
FIGURES = ["revenue of 12 345 678 in the period", "revenue of 1,908,000 thousand", "1.908.000 in continental format", "the range is 240 000 to 360 000", "Analysis as at 14-September-2026. Capital in US$ millions.", "", " ... @ "]


@pytest.mark.parametrize(("kind", "text", "want"), CAUGHT)
def test_caught(kind, text, want):
    found = identifying.spans_of(text, (kind,))
    assert [s["text"] for s in found] == [want] and text[found[0]["start"] : found[0]["end"]] == want


@pytest.mark.parametrize("text", FIGURES)
def test_figures_are_left_alone(text):
    assert identifying.spans_of(text, tuple(identifying.DETECTORS)) == []


def test_long_texts_take_linear_time():
    assert len(identifying.spans_of("Jane Okafor, CFO of Meridian Group, +44 20 7123 4567, a@b.io; " * 20000, tuple(identifying.DETECTORS))) == 80000
    for run in ("@" * 300000, "a" * 300000, "1 " * 150000, "A " * 150000):
        identifying.spans_of(run, tuple(identifying.DETECTORS))


TEXTS = [
    ("x", 1, "Meridian Capital Partners LLP met Vantara Holdings. Jane Okafor, CFO, wrote to j@m.com"),
    ("x", 2, "okafor and MERIDIAN  Capital\nPartners agreed; VANTARA HOLDINGS did not; j@m.com"),
    ("x", 3, None),
    ("y", 1, "Vantara Holdings revenue of 1,908.0 at a 15.6% margin; Okaforite"),
]


def payloads(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "payload string, part int, text string")


def test_payloads(spark):
    listed = spark.createDataFrame([("x", "term", "agreed")], "payload string, kind string, term string")
    out = redaction.redact(payloads(spark), listed)
    got = {(r.payload, r.part): r.text for r in out.texts.collect()}
    assert got == {
        ("x", 1): "[COMPANY_1] met [COMPANY_2]. [PERSON_1], CFO, wrote to [EMAIL_1]",
        ("x", 2): "[PERSON_1] and [COMPANY_1] [TERM_1]; [COMPANY_2] did not; [EMAIL_1]",
        ("x", 3): None,
        ("y", 1): "[COMPANY_1] revenue of 1,908.0 at a 15.6% margin; Okaforite",
    }
    assert redaction.verify(out.texts, out.terms).count() == 0
    leaks = redaction.verify(payloads(spark), out.terms).collect()
    assert {(r.payload, r.part, r.term) for r in leaks} >= {("x", 2, "Vantara Holdings"), ("x", 1, "Jane Okafor"), ("y", 1, "Vantara Holdings")}
    back = redaction.restore(out.texts.where("part = 1"), out.terms).select("payload", "text").collect()
    assert dict(back) == {"x": TEXTS[0][2], "y": TEXTS[3][2]}
    assert redaction.restore(spark.createDataFrame([("x", "[COMPANY_9] and [COMPANY_2]")], "payload string, text string"), out.terms).first().text == "[COMPANY_9] and Vantara Holdings"
    assert {r.placeholder: r.occurrences for r in out.terms.where("payload = 'x'").collect()} == {"[COMPANY_1]": 2, "[COMPANY_2]": 2, "[PERSON_1]": 2, "[EMAIL_1]": 2, "[TERM_1]": 1}


def test_allowed_empty_and_hidden(spark):
    allowed = spark.createDataFrame([("vantara holdings",)], "term string")
    assert "Vantara" in {r.part: r.text for r in redaction.redact(payloads(spark), allowed=allowed).texts.where("payload = 'x'").collect()}[1]
    assert redaction.redact(payloads(spark, [])).texts.count() == 0
    hidden = payloads(spark, [("x", 1, "Project At\u00adlas is Atlas")])
    assert redaction.redact(hidden).texts.first().text == "Project [CODENAME_1] is [CODENAME_1]"


def test_residue_and_gate(spark):
    ordinary = spark.createDataFrame([("we",), ("rate",), ("highly",)], "word string")
    texts = spark.createDataFrame([("x", "We rate Halvorsen highly: Section IV, [COMPANY_1]"), ("y", "We rate it")], "payload string, text string")
    odd = redaction.unusual_words(texts, ordinary)
    assert {(r.payload, r.word) for r in odd.collect()} == {("x", "Halvorsen"), ("x", "Section")}
    r = texts.select(redaction.residue(F.lit("ref 4471209835512 and 1,908,000, a@b, www.x.y")).alias("r")).first().r
    assert (r.at_signs, r.urls, r.digit_runs) == (1, 1, 1)
    sent = lambda leaks, approved: {r.payload for r in redaction.may_leave(spark.createDataFrame([("x", "d1"), ("y", "d2")], "payload string, digest string"), spark.createDataFrame(leaks, "payload string"), odd, spark.createDataFrame(approved, "payload string, digest string")).collect()}
    assert sent([], []) == {"y"} and sent([], [("x", "d0")]) == {"y"} and sent([], [("x", "d1")]) == {"x", "y"} and sent([("x",)], [("x", "d1")]) == {"y"}
