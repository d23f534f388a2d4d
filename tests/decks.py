"""Small presentation files written by zip, for the source and rule tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS = f'xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{R}"'
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def png(w: int, h: int) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * ((w + 1) * h))) + chunk(b"IEND", b"")


def rels(items: list[tuple[str, str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, k, t in items)
    return f'<Relationships xmlns="{REL}">{rows}</Relationships>'


def box(x, y, w, h) -> str:
    return f'<a:xfrm><a:off x="{int(x * 12700)}" y="{int(y * 12700)}"/><a:ext cx="{int(w * 12700)}" cy="{int(h * 12700)}"/></a:xfrm>'


def text(id_, name, said, at=(50, 50, 200, 40), ph="", run="", bullet=False) -> str:
    pars = "".join(f"<a:p>{'<a:pPr><a:buChar char=' + chr(34) + '-' + chr(34) + '/></a:pPr>' if bullet else ''}<a:r><a:rPr {run}/><a:t>{line}</a:t></a:r></a:p>" for line in said.split("\n"))
    geometry = f"<p:spPr>{box(*at)}</p:spPr>" if at else "<p:spPr/>"
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{id_}" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{geometry}<p:txBody><a:bodyPr/>{pars}</p:txBody></p:sp>'


def table(id_, rows, at=(50, 120, 400, 200)) -> str:
    cell = lambda c: f"<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>"
    body = "".join(f"<a:tr>{''.join(map(cell, r))}</a:tr>" for r in rows)
    x = box(*at).replace("a:xfrm", "p:xfrm")
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{id_}" name="Table"/><p:nvPr/></p:nvGraphicFramePr>{x}<a:graphic><a:graphicData><a:tbl>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def deck(slides: list[str], hidden: set[int] = frozenset(), notes: dict[int, str] | None = None, core: str = "") -> bytes:
    """A deck with one layout whose title sits at (40, 20, 880, 60) in 28pt."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", rels([("r1", "officeDocument", "ppt/presentation.xml")]))
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{960 * 12700}" cy="{540 * 12700}"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels([(f"s{k}", "slide", f"slides/slide{k + 1}.xml") for k in range(len(slides))]))
        title = '<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/><p:cNvSpPr/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr>' + box(40, 20, 880, 60) + '</p:spPr><p:txBody><a:bodyPr/><a:lstStyle><a:lvl1pPr><a:defRPr sz="2800"/></a:lvl1pPr></a:lstStyle><a:p/></p:txBody></p:sp>'
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'<p:sldLayout {NS} type="obj"><p:cSld name="Content"><p:spTree>{title}</p:spTree></p:cSld></p:sldLayout>')
        z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", rels([("m", "slideMaster", "../slideMasters/slideMaster1.xml")]))
        z.writestr("ppt/slideMasters/slideMaster1.xml", f'<p:sldMaster {NS}><p:cSld><p:spTree/></p:cSld><p:clrMap accent1="accent1"/></p:sldMaster>')
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", rels([("t", "theme", "../theme/theme1.xml")]))
        z.writestr("ppt/theme/theme1.xml", f'<a:theme xmlns:a="{A}"><a:themeElements><a:clrScheme><a:accent1><a:srgbClr val="336699"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Georgia"/></a:majorFont><a:minorFont><a:latin typeface="Calibri"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>')
        z.writestr("ppt/media/image1.png", png(40, 20))
        if core:
            z.writestr("docProps/core.xml", f'<c:coreProperties xmlns:c="x" xmlns:dc="y">{core}</c:coreProperties>')
        for k, shapes in enumerate(slides, 1):
            show = ' show="0"' if k in hidden else ""
            z.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {NS}{show}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
            links = [("l", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("i", "image", "../media/image1.png")]
            if notes and k in notes:
                links.append(("n", "notesSlide", f"../notesSlides/n{k}.xml"))
                z.writestr(f"ppt/notesSlides/n{k}.xml", f'<p:notes {NS}><p:cSld><p:spTree>{text(2, "Notes", notes[k], ph="<p:ph type=" + chr(34) + "body" + chr(34) + "/>")}</p:spTree></p:cSld></p:notes>')
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", rels(links))
    return out.getvalue()
