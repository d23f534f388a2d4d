"""Corrections in files, diagram labels, and a reviewer's replies."""

import zipfile

from decks import box, deck, table, text
from pyspark.sql import functions as F
from test_decks import CLEAN, found, read

from tallyframe.fix import write
from tallyframe.operators import responses
from tallyframe.rules import engine
from tallyframe.sources.pptx import read_decks


def files(spark, **named):
    return spark.createDataFrame([(f"/in/{k}.pptx", v) for k, v in named.items()], "deck_id string, content binary")


def test_fixed_and_read_again(spark, tmp_path):
    from tallyframe.sources.pptx import tables_of

    bad = deck([CLEAN[0], CLEAN[1] + text(5, "Q", "in north america, and north america", (60, 300, 300, 40)) + table(6, [["north america", "1"]], (60, 400, 300, 60))])
    given = files(spark, a=bad, b=deck(CLEAN), c=b"no zip")
    rule = {"typography": {"canon_terms": {"North America": []}}}
    t = tables_of(given)
    assert engine.check(t, rule, ["TY-005"])[0].where("outcome = 'finding'").count() > 0
    edits = write.edits_for(t, "north america", "North America")
    assert edits.count() == 3
    broken = edits.limit(1).withColumn("deck_id", F.lit("/in/c.pptx"))
    done = {r.deck_id: (r.edits, r.state) for r in write.write(given, edits.unionByName(broken), f"file://{tmp_path}/out").collect()}
    assert done == {"/in/a.pptx": (3, "written"), "/in/c.pptx": (1, "refused")}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.pptx"]
    after = read_decks(spark, str(tmp_path / "out"))
    assert engine.check(after, rule, ["TY-005"])[0].where("outcome = 'finding'").count() == 0
    assert {r.text for r in after["runs"].where("text LIKE '%America%'").collect()} == {"in North America, and North America", "North America"}
    # what no edit names is the same, byte by byte
    before, now = zipfile.ZipFile(__import__("io").BytesIO(bad)), zipfile.ZipFile(tmp_path / "out" / "a.pptx")
    assert before.namelist() == now.namelist() and [n for n in before.namelist() if before.read(n) != now.read(n)] == ["ppt/slides/slide2.xml"]


def test_a_stale_span_refuses_the_deck():
    content = deck([CLEAN[1] + text(5, "Q", "one two", (60, 300, 300, 40))])
    span = lambda start, stop, old, new, **more: {"slide_index": 1, "uid": 3, "row": None, "col": None, "para": 0, "run": 0, "start": start, "stop": stop, "old": old, "new": new} | more
    done, why = write.corrected(content, [span(0, 3, "one", "ONE & <1>"), span(4, 7, "two", "2")])
    assert why is None and "ONE &amp; &lt;1&gt; 2" in zipfile.ZipFile(__import__("io").BytesIO(done)).read("ppt/slides/slide1.xml").decode()
    for stale in (span(0, 3, "uno", "x"), span(0, 3, "one", "x", uid=9), span(0, 3, "one", "x", para=4), span(0, 3, "one", "x", slide_index=5), span(0, 3, "one", "x", row=0, col=0)):
        assert write.corrected(content, [span(4, 7, "two", "2"), stale])[0] is None


def test_declarations_that_only_values_use_are_kept():
    raw = b'<p:sld xmlns:p="urn:p" xmlns:mc="urn:mc" xmlns:p14="urn:14" mc:Ignorable="p14"><p:x/></p:sld>'
    from xml.etree import ElementTree as ET

    out = write._serialised(raw, ET.fromstring(raw))
    assert b'xmlns:p14="urn:14"' in out and b'mc:Ignorable="p14"' in out and ET.fromstring(out).tag == "{urn:p}sld"


def with_diagram(content: bytes, said: list[tuple[str, str, str, int]]) -> bytes:
    """A deck with a diagram on its first slide: (id, text, id of the point above, order)."""
    import io

    old, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    a, d = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/diagram"
    points = '<dgm:pt modelId="0" type="doc"/>' + "".join(f'<dgm:pt modelId="{k}"><dgm:t><a:bodyPr/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></dgm:t></dgm:pt>' for k, t, _, _ in said)
    lines = "".join(f'<dgm:cxn modelId="c{k}" srcId="{up}" destId="{k}" srcOrd="{n}"/>' for k, _, up, n in said) + '<dgm:cxn modelId="p" type="presOf" srcId="1" destId="0"/>'
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="70" name="Chart of steps"/><p:nvPr/></p:nvGraphicFramePr>{box(50, 120, 400, 200).replace("a:xfrm", "p:xfrm")}<a:graphic><a:graphicData><dgm:relIds xmlns:dgm="{d}" r:dm="dm1"/></a:graphicData></a:graphic></p:graphicFrame>'
    with zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            data = old.read(n).decode("utf-8", "surrogateescape")
            if n == "ppt/slides/slide1.xml":
                data = data.replace("</p:spTree>", frame + "</p:spTree>")
            if n == "ppt/slides/_rels/slide1.xml.rels":
                data = data.replace("</Relationships>", '<Relationship Id="dm1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/diagramData" Target="../diagrams/data1.xml"/></Relationships>')
            z.writestr(n, data.encode("utf-8", "surrogateescape"))
        z.writestr("ppt/diagrams/data1.xml", f'<dgm:dataModel xmlns:dgm="{d}" xmlns:a="{a}"><dgm:ptLst>{points}</dgm:ptLst><dgm:cxnLst>{lines}</dgm:cxnLst></dgm:dataModel>')
    return out.getvalue()


def test_labels_of_diagrams(spark):
    content = with_diagram(deck(CLEAN), [("2", "Second step", "0", 1), ("1", "First step", "0", 0), ("3", "value tbd", "1", 0), ("4", "Loose", "9", 0)])
    t = read(spark, content)
    assert [(r.para, r.level, r.text) for r in t["paragraphs"].join(t["shapes"].where("kind = 'diagram'").select("deck_id", "slide_index", "uid"), ["deck_id", "slide_index", "uid"]).orderBy("para").collect()] == [(0, 0, "First step"), (1, 1, "value tbd"), (2, 0, "Second step"), (3, 0, "Loose")]
    assert ("HY-001", 1) in found(spark, content, profile={}, include=["HY-001"])


def test_replies(spark):
    texts = spark.createDataFrame([("p", 1, "Revenue grew  to\n$1,935m in FY25."), ("p", 2, "We expect revenue of $1,900m."), ("q", 1, "Nothing else.")], "payload string, part int, text string")
    entry = '{"quote": "%s", "other": %s, "explanation": "%s"}'
    good, far = entry % ("Revenue grew to $1,935m", '"revenue of $1,900m"', "They differ."), entry % ("Nothing else", "null", "In the other payload.")
    bad = [entry % ("", "null", "x"), far, entry % ("Revenue grew", '"no such text"', "x"), entry % ("Revenue grew", "null", " "), entry % ("$$", "null", "x")]
    replies = [("p", "```json\n{\"findings\": [%s]}\n```" % ", ".join([good, *bad, good])), ("q", '{"findings": []}'), ("r", "I see none."), ("s", '{"other": 1}'), ("t", '{"findings": "x"}'), ("u", None)]
    out = responses.review(spark.createDataFrame(replies, "payload string, reply string"), texts)
    assert [(r.payload, r.place, r.part, r.other_part) for r in out.found.collect()] == [("p", 0, 1, 2)]
    told = sorted((r.payload, -1 if r.place is None else r.place, r.reason) for r in out.rejected.collect())
    assert told == [("p", 1, "no quote"), ("p", 2, "quote not in the payload"), ("p", 3, "other side not in the payload"), ("p", 4, "no explanation"), ("p", 5, "quote not in the payload"), ("r", -1, "no JSON"), ("s", -1, "no list of findings"), ("t", -1, "no list of findings"), ("u", -1, "no JSON")]
