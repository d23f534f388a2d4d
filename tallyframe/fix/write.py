"""Corrections written into decks: text spans that are checked before they are replaced, in a new file that a rename commits.

edits: (deck_id, slide_index, uid, row, col, para, run, start, stop, old, new): in a run of a shape's text, or of a
table's cell, the characters from start to stop must be `old`. A deck in which any span has other characters, or lies
elsewhere, is refused whole: no file is half corrected. Decks are rewritten where they lie, one task a deck; only
the slides that an edit names are written anew, all other parts are copied byte by byte.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.pptx import NS, A, P, Package

FIELDS = ("slide_index", "uid", "row", "col", "para", "run", "start", "stop", "old", "new")
SHAPES = ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")


def _shapes(tree: ET.Element) -> Iterator[ET.Element]:
    """Shapes in the order in which the source numbers them."""
    for node in tree:
        if node.tag.removeprefix(P) in SHAPES:
            yield node
            if node.tag == P + "grpSp":
                yield from _shapes(node)


def _run(root: ET.Element, e: dict) -> ET.Element | None:
    """The run that an edit names, or None."""
    tree = root.find("p:cSld/p:spTree", NS)
    shape = next((x for k, x in enumerate(_shapes(tree), 1) if k == e["uid"]), None) if tree is not None else None
    if shape is None:
        return None
    body = shape.find("p:txBody", NS)
    if e["row"] is not None:
        rows = shape.findall("a:graphic/a:graphicData/a:tbl/a:tr", NS)
        cells = rows[e["row"]].findall("a:tc", NS) if e["row"] < len(rows) else []
        body = cells[e["col"]].find("a:txBody", NS) if e["col"] < len(cells) else None
    pars = body.findall("a:p", NS) if body is not None else []
    runs = [x for x in pars[e["para"]] if x.tag in (A + "r", A + "fld", A + "br")] if e["para"] < len(pars) else []
    return runs[e["run"]] if e["run"] < len(runs) and runs[e["run"]].tag != A + "br" else None


def _serialised(data: bytes, root: ET.Element) -> bytes:
    """XML with the prefixes of the file it was read from; declarations that only attribute values use are kept too."""
    spaces = dict(x for _, x in ET.iterparse(io.BytesIO(data), events=("start-ns",)))
    for prefix, uri in spaces.items():
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    out = ET.tostring(root, encoding="unicode", default_namespace=None)
    head, rest = out[: out.index(">")], out[out.index(">") :]
    missing = "".join(f' xmlns:{p}="{u}"' for p, u in spaces.items() if p and f"xmlns:{p}=" not in head)
    tail = "/" if head.endswith("/") else ""
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + head.removesuffix("/") + missing + tail + rest).encode()


def corrected(content: bytes, edits: list[dict]) -> tuple[bytes | None, str | None]:
    """(new file, None), or (None, why it is refused)."""
    package = Package(content)
    main = package.related("", "officeDocument")
    rels, shown = package.rels(main), [x.get("{%s}id" % NS["r"]) for x in package.xml(main).iterfind("p:sldIdLst/p:sldId", NS)]
    changed: dict[str, ET.Element] = {}
    # from the end of each run to its beginning, so that earlier places stay what they are
    for e in sorted(edits, key=lambda e: (e["slide_index"], e["uid"], e["row"] or 0, e["col"] or 0, e["para"], e["run"], -e["start"])):
        where = f"slide {e['slide_index']}, shape {e['uid']}"
        if not 1 <= e["slide_index"] <= len(shown):
            return None, f"no {where}"
        part = rels[shown[e["slide_index"] - 1]][1]
        root = changed.setdefault(part, ET.fromstring(package.zip.read(part)))
        run = _run(root, e)
        letters = run.find("a:t", NS) if run is not None else None
        said = (letters.text or "") if letters is not None else None
        if said is None or said[e["start"] : e["stop"]] != e["old"]:
            return None, f"{where}: the text is no longer what the correction was made for"
        letters.text = said[: e["start"]] + e["new"] + said[e["stop"] :]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in package.zip.infolist():
            data = package.zip.read(item.filename)
            z.writestr(item, _serialised(data, changed[item.filename]) if item.filename in changed else data)
    return out.getvalue(), None


def _put(folder: str, name: str, content: bytes) -> None:
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/.{name}.part") as f:
        f.write(content)
    system.move(f"{base}/.{name}.part", f"{base}/{name}")


def write(decks: DataFrame, edits: DataFrame, folder: str) -> DataFrame:
    """decks (deck_id, content) with their edits applied, as files in `folder` (a URI all executors reach) named after the
    deck. Result: deck_id, edits, state (`written` or `refused`), reason; a task that is run again writes the same file."""
    mine = edits.groupBy("deck_id").agg(F.to_json(F.collect_list(F.struct(*FIELDS)), {"ignoreNullFields": "false"}).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for deck_id, content, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = json.loads(told)
                try:
                    done, why = corrected(content, wanted)
                except (zipfile.BadZipFile, ET.ParseError, KeyError, AttributeError) as error:  # no deck, or a damaged one
                    done, why = None, f"unreadable: {type(error).__name__}"
                if done is not None:
                    _put(folder, deck_id.rsplit("/", 1)[-1], done)
                rows.append((deck_id, len(wanted), "refused" if done is None else "written", why))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.string())], names=["deck_id", "edits", "state", "reason"])

    return decks.select("deck_id", "content").join(mine, "deck_id").mapInArrow(run, "deck_id string, edits long, state string, reason string")


def edits_for(tables: dict[str, DataFrame], old: str, new: str) -> DataFrame:
    """An edit for every occurrence of `old` within a run, in frames and cells."""
    said = tables["runs"].where(F.contains("text", F.lit(old)))
    ends = F.split("text", re.escape(old), -1)
    spots = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.aggregate(F.slice("ends", F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x)) + (k - 1) * len(old))
    rows = said.withColumn("ends", ends).select("deck_id", "slide_index", "uid", "row", "col", "para", "run", F.explode(spots).alias("start"))
    return rows.select("*", (F.col("start") + len(old)).alias("stop"), F.lit(old).alias("old"), F.lit(new).alias("new"))
