"""Presentation files as tables: one task reads whole files, zip and XML only, and emits rows of every table.

A file that cannot be read gives one `decks` row with its error and nothing else, so a bad file never stops a run.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import TABLES
from tallyframe.storage import shared_folder

NS = {
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "c": "http://schemas.openxmlformats.org/drawingml/2006/chart",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dgm": "http://schemas.openxmlformats.org/drawingml/2006/diagram",
    "pr": "http://schemas.openxmlformats.org/package/2006/relationships",
}
A, P, R, C = (f"{{{NS[k]}}}" for k in "aprc")
EMU = 12700.0


class Package:
    """Parts of a zip, their relationships, and parsed XML kept for the time of one deck."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.parsed: dict[str, ET.Element | None] = {}

    def xml(self, part: str | None) -> ET.Element | None:
        if part not in self.parsed:
            self.parsed[part] = ET.fromstring(self.zip.read(part)) if part in self.names else None
        return self.parsed[part]

    def rels(self, part: str) -> dict[str, tuple[str, str, str]]:
        """Relationship id to (type, resolved target, mode)."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", name + ".rels"))
        out = {}
        for rel in root if root is not None else ():
            target, mode = rel.get("Target", ""), rel.get("TargetMode", "Internal")
            if mode == "Internal":
                target = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
            out[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], target, mode)
        return out

    def related(self, part: str, kind: str) -> str | None:
        return next((t for k, t, m in self.rels(part).values() if k == kind and m == "Internal"), None)


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Pixels of a PNG or JPEG, nothing for other formats."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None, None


class Styles:
    """Where a slide's text and colours come from when a run does not say: layout, master, presentation, theme."""

    def __init__(self, package: Package, slide: str, presentation: str) -> None:
        self.layout = package.related(slide, "slideLayout")
        self.master = package.related(self.layout, "slideMaster") if self.layout else None
        theme = package.related(self.master, "theme") if self.master else None
        self.layout_xml, self.master_xml = package.xml(self.layout), package.xml(self.master)
        self.theme = package.xml(theme)
        root = package.xml(presentation)
        self.defaults = root.find("p:defaultTextStyle", NS) if root is not None else None
        mapping = self.master_xml.find("p:clrMap", NS) if self.master_xml is not None else None
        self.color_map = dict(mapping.attrib) if mapping is not None else {}

    def font(self, face: str | None) -> str | None:
        """A theme reference such as +mn-lt becomes the theme's face."""
        if face and face.startswith("+") and self.theme is not None:
            group = "majorFont" if face.startswith("+mj") else "minorFont"
            latin = self.theme.find(f".//a:{group}/a:latin", NS)
            return latin.get("typeface") if latin is not None else None
        return face

    def color(self, node: ET.Element | None) -> str | None:
        """RRGGBB of a solidFill-like node, luminance changes applied."""
        if node is None:
            return None
        inner = next((x for x in node if x.tag in (A + "srgbClr", A + "schemeClr", A + "sysClr")), None)
        if inner is None:
            return None
        if inner.tag == A + "schemeClr":
            name = self.color_map.get(inner.get("val"), inner.get("val"))
            found = self.theme.find(f".//a:clrScheme/a:{name}", NS) if self.theme is not None else None
            value = next((x.get("lastClr") or x.get("val") for x in found), None) if found is not None else None
        else:
            value = inner.get("lastClr") or inner.get("val")
        if not value or not re.fullmatch("[0-9A-Fa-f]{6}", value):
            return None
        return transformed(value.upper(), [(x.tag.removeprefix(A), int(x.get("val", "0")) / 100000) for x in inner])

    def placeholder(self, root: ET.Element | None, kind: str | None, idx: str | None) -> ET.Element | None:
        """The layout's or master's shape for a placeholder: by idx, else by type (a title serves a centred one)."""
        if root is None or kind is None:
            return None
        same = {"ctrTitle": "title", "subTitle": "body", "obj": "body"}
        by_type = None
        for sp in root.iter(P + "sp"):
            ph = sp.find("p:nvSpPr/p:nvPr/p:ph", NS)
            if ph is None:
                continue
            if idx is not None and ph.get("idx") == idx:
                return sp
            own = ph.get("type", "obj")
            if by_type is None and same.get(own, own) == same.get(kind, kind):
                by_type = sp
        return by_type

    def sources(self, kind: str | None, idx: str | None, shape: ET.Element, level: int) -> list[tuple[str, ET.Element]]:
        """(name, defRPr) from the nearest to the farthest source."""
        tag = f"a:lvl{level + 1}pPr/a:defRPr"
        out = []
        for name, sp in (("shape", shape), ("layout", self.placeholder(self.layout_xml, kind, idx)), ("master", self.placeholder(self.master_xml, kind, None))):
            found = sp.find(f"p:txBody/a:lstStyle/{tag}", NS) if sp is not None else None
            if found is not None:
                out.append((name, found))
        if self.master_xml is not None:
            group = "titleStyle" if kind in ("title", "ctrTitle") else "bodyStyle" if kind in ("body", "obj", "subTitle") else "otherStyle"
            found = self.master_xml.find(f"p:txStyles/p:{group}/{tag}", NS)
            if found is not None:
                out.append(("master text style", found))
        if self.defaults is not None and (found := self.defaults.find(tag, NS)) is not None:
            out.append(("presentation", found))
        return out


def transformed(hex_: str, steps: list[tuple[str, float]]) -> str:
    """DrawingML changes of a colour: luminance and saturation in HLS, tint and shade in linear light."""
    import colorsys

    rgb = [int(hex_[k : k + 2], 16) / 255 for k in (0, 2, 4)]
    for name, v in steps:
        if name in ("lumMod", "lumOff", "satMod"):
            h, light, s = colorsys.rgb_to_hls(*rgb)
            light = light * v if name == "lumMod" else light + v if name == "lumOff" else light
            s = s * v if name == "satMod" else s
            rgb = list(colorsys.hls_to_rgb(h, min(1, max(0, light)), min(1, max(0, s))))
        elif name in ("tint", "shade"):
            lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
            lin = [c * v + (1 - v if name == "tint" else 0) for c in lin]
            rgb = [c * 12.92 if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055 for c in lin]
        elif name == "alpha":
            rgb = [c * v + 1 - v for c in rgb]
    return "".join(f"{min(255, max(0, round(c * 255))):02X}" for c in rgb)


class Deck:
    """Rows of one deck by table."""

    def __init__(self, deck_id: str, data: bytes) -> None:
        self.id, self.rows = deck_id, []
        self.package = Package(data)
        self.presentation = self.package.related("", "officeDocument") or "ppt/presentation.xml"
        root = self.package.xml(self.presentation)
        if root is None:
            raise ValueError("no presentation part")
        size = root.find("p:sldSz", NS)
        rels = self.package.rels(self.presentation)
        slides = [rels[x.get(R + "id")][1] for x in root.iterfind("p:sldIdLst/p:sldId", NS) if x.get(R + "id") in rels]
        fonts = [None, None]
        for k, part in enumerate(slides, 1):
            styles = Styles(self.package, part, self.presentation)
            fonts = fonts if fonts[0] else [styles.font("+mj-lt"), styles.font("+mn-lt")]
            self.slide(k, part, styles)
        self.package_rows(root)
        self.add("decks", width_pt=int(size.get("cx")) / EMU if size is not None else None, height_pt=int(size.get("cy")) / EMU if size is not None else None, slide_count=len(slides), major_font=fonts[0], minor_font=fonts[1])

    def add(self, table: str, **row) -> None:
        self.rows.append((table, json.dumps({"deck_id": self.id, **{k: v for k, v in row.items() if v is not None and v == v}})))

    def slide(self, index: int, part: str, styles: Styles) -> None:
        root = self.package.xml(part)
        if root is None:
            return
        notes_part = self.package.related(part, "notesSlide")
        notes = self.package.xml(notes_part) if notes_part else None
        said = []
        for sp in notes.iter(P + "sp") if notes is not None else ():
            ph = sp.find("p:nvSpPr/p:nvPr/p:ph", NS)
            if ph is not None and ph.get("type") == "body":
                said += ["".join(t.text or "" for t in par.iter(A + "t")) for par in sp.iter(A + "p")]
        layout = styles.layout_xml
        name = layout.find("p:cSld", NS).get("name") if layout is not None and layout.find("p:cSld", NS) is not None else None
        self.add("slides", slide_index=index, layout_name=name, layout_type=layout.get("type") if layout is not None else None, notes="\n".join(said), is_hidden=root.get("show") == "0")
        self.uid, self.z = 0, 0
        tree = root.find("p:cSld/p:spTree", NS)
        if tree is not None:
            self.walk(tree, index, part, styles, None, (1.0, 1.0, 0.0, 0.0))

    def walk(self, tree: ET.Element, index: int, part: str, styles: Styles, parent: int | None, frame: tuple[float, float, float, float]) -> None:
        for node in tree:
            kind = node.tag.removeprefix(P)
            if kind not in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp"):
                continue
            self.uid += 1
            self.z += 1
            uid = self.uid
            props = next((x for x in node if x.tag.startswith(P + "nv")), None)
            c = props.find("p:cNvPr", NS) if props is not None else None
            ph = props.find("p:nvPr/p:ph", NS) if props is not None else None
            ph_type, ph_idx = (ph.get("type", "obj"), ph.get("idx")) if ph is not None else (None, None)
            xfrm, origin = self.xfrm(node), "slide"
            for name, root in (("layout", styles.layout_xml), ("master", styles.master_xml)):
                if xfrm is None and ph is not None:
                    inherited = styles.placeholder(root, ph_type, ph_idx if name == "layout" else None)
                    xfrm, origin = (self.xfrm(inherited), name) if inherited is not None else (None, name)
            box = self.box(xfrm, frame)
            sp_pr = node.find("p:spPr", NS)
            fill = styles.color(sp_pr.find("a:solidFill", NS)) if sp_pr is not None else None
            line = styles.color(sp_pr.find("a:ln/a:solidFill", NS)) if sp_pr is not None else None
            row = {"slide_index": index, "uid": uid, "shape_id": int(c.get("id", "0")) if c is not None else None, "parent_uid": parent, "is_leaf": kind != "grpSp", "name": c.get("name") if c is not None else None, "z_order": self.z, "placeholder_type": ph_type, "placeholder_idx": int(ph_idx) if ph_idx else None, "geometry_from": origin, "fill_hex": fill, "line_hex": line, **box}
            row["kind"] = {"sp": "text" if node.find("p:txBody", NS) is not None else "shape", "pic": "picture", "grpSp": "group", "cxnSp": "connector"}.get(kind, "frame")
            if kind == "pic":
                blip = node.find("p:blipFill/a:blip", NS)
                target = self.package.rels(part).get(blip.get(R + "embed"), (None, None, None))[1] if blip is not None else None
                if target in self.package.names:
                    data = self.package.zip.read(target)
                    w, h = image_size(data)
                    row |= {"image_sha1": hashlib.sha1(data).hexdigest(), "image_width": w, "image_height": h}
            if kind == "graphicFrame":
                data = node.find("a:graphic/a:graphicData", NS)
                table = data.find("a:tbl", NS) if data is not None else None
                chart = data.find("c:chart", NS) if data is not None else None
                if table is not None:
                    row["kind"] = "table"
                    self.table(table, index, uid, styles)
                elif data is not None and (ids := data.find("dgm:relIds", NS)) is not None:
                    row["kind"] = "diagram"
                    labels = self.diagram(self.package.rels(part).get(ids.get(R + "dm"), (None, None, None))[1])
                    row["text"] = self.text(labels, index, uid, None, None, styles, None, None, node)
                elif chart is not None:
                    row["kind"] = "chart"
                    self.chart(self.package.rels(part).get(chart.get(R + "id"), (None, None, None))[1], index, uid)
            body = node.find("p:txBody", NS)
            if body is not None:
                row["text"] = self.text(body, index, uid, None, None, styles, ph_type, ph_idx, node)
                row |= self.frame([x.find("p:txBody/a:bodyPr", NS) for x in (node, *(styles.placeholder(r, ph_type, i) for r, i in ((styles.layout_xml, ph_idx), (styles.master_xml, None)))) if x is not None])
            row["painted"] = self.painted(node, sp_pr)
            self.add("shapes", **row)
            if kind == "grpSp":
                self.walk(node, index, part, styles, uid, self.compose(node, frame))

    @staticmethod
    def painted(node: ET.Element, props: ET.Element | None) -> bool:
        """Whether a fill or an outline is drawn, by the shape itself or by a style that it does not undo."""
        fills = ("solidFill", "gradFill", "blipFill", "pattFill", "grpFill")
        shown = False
        for path, reference in (("", "fillRef"), ("a:ln", "lnRef")):
            own = props if not path or props is None else props.find(path, NS)
            if own is not None and any(own.find(f"a:{f}", NS) is not None for f in fills):
                shown = True
            elif own is None or own.find("a:noFill", NS) is None:
                style = node.find(f"p:style/a:{reference}", NS)
                shown |= style is not None and style.get("idx", "0") != "0"
        return shown

    @staticmethod
    def frame(bodies: list[ET.Element | None]) -> dict:
        """Insets, anchor, wrapping, columns and autofit of a text frame; what a body does not state comes from the next."""
        bodies = [b for b in bodies if b is not None]
        stated = lambda name: next((b.get(name) for b in bodies if b.get(name) is not None), None)
        points = lambda name: int(v) / EMU if (v := stated(name)) else None
        fit = next((x for b in bodies for x in b if x.tag.endswith("utofit") or x.tag.endswith("utoFit")), None)
        scale = fit.get("fontScale") if fit is not None else None
        return {
            "inset_left_pt": points("lIns"), "inset_top_pt": points("tIns"), "inset_right_pt": points("rIns"), "inset_bottom_pt": points("bIns"), "anchor": stated("anchor"), "wraps": None if stated("wrap") is None else stated("wrap") != "none",
            "text_columns": int(stated("numCol")) if stated("numCol") else None, "column_gap_pt": points("spcCol"), "autofit": fit.tag.removeprefix(A) if fit is not None else None, "font_scale": int(scale.rstrip("%")) / (100 if scale.endswith("%") else 100000) if scale else None,
        }

    @staticmethod
    def setting(props: ET.Element | None) -> dict:
        """Alignment, indents and spacing that a paragraph states."""
        if props is None:
            return {}
        points = lambda name: int(props.get(name)) / EMU if props.get(name) else None
        value = lambda tag, kind: float(x.get("val").rstrip("%")) if (x := props.find(f"a:{tag}/a:{kind}", NS)) is not None else None
        parts = lambda tag: (value(tag, "spcPct"), value(tag, "spcPts"))
        (line, line_pts), (before, before_pts), (after, after_pts) = parts("lnSpc"), parts("spcBef"), parts("spcAft")
        return {
            "alignment": props.get("algn"), "margin_right_pt": points("marR"), "indent_pt": points("indent"), "spacing_share": line / 100000 if line else None, "spacing_pt": line_pts / 100 if line_pts else None,
            "space_pt": ((before_pts or 0) + (after_pts or 0)) / 100, "space_share": ((before or 0) + (after or 0)) / 100000,
        }

    @staticmethod
    def xfrm(node: ET.Element) -> ET.Element | None:
        for path in ("p:spPr/a:xfrm", "p:grpSpPr/a:xfrm", "p:xfrm"):
            if (x := node.find(path, NS)) is not None and x.find("a:off", NS) is not None:
                return x
        return None

    @staticmethod
    def box(x: ET.Element | None, frame: tuple[float, float, float, float]) -> dict:
        if x is None:
            return {}
        sx, sy, dx, dy = frame
        off, ext = x.find("a:off", NS), x.find("a:ext", NS)
        w, h = (int(ext.get("cx")), int(ext.get("cy"))) if ext is not None else (0, 0)
        return {"left_pt": (int(off.get("x")) * sx + dx) / EMU, "top_pt": (int(off.get("y")) * sy + dy) / EMU, "width_pt": w * sx / EMU, "height_pt": h * sy / EMU, "rotation": int(x.get("rot", "0")) / 60000}

    @staticmethod
    def compose(group: ET.Element, frame: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
        """Scale and offset that take the children of a group to slide coordinates."""
        x = group.find("p:grpSpPr/a:xfrm", NS)
        if x is None or x.find("a:chExt", NS) is None:
            return frame
        num = lambda tag, k: int(x.find(f"a:{tag}", NS).get(k))
        sx = num("ext", "cx") / num("chExt", "cx") if num("chExt", "cx") else 1.0
        sy = num("ext", "cy") / num("chExt", "cy") if num("chExt", "cy") else 1.0
        fx, fy, dx, dy = frame
        return fx * sx, fy * sy, dx + fx * (num("off", "x") - num("chOff", "x") * sx), dy + fy * (num("off", "y") - num("chOff", "y") * sy)

    def text(self, body: ET.Element, index: int, uid: int, row: int | None, col: int | None, styles: Styles, kind: str | None, idx: str | None, shape: ET.Element) -> str:
        lines = []
        for k, par in enumerate(body.iterfind("a:p", NS)):
            props = par.find("a:pPr", NS)
            level = int(props.get("lvl", "0")) if props is not None else 0
            bullet = props is not None and any(props.find(f"a:{b}", NS) is not None for b in ("buChar", "buAutoNum"))
            margin = props.get("marL") if props is not None else None
            said = []
            for j, run in enumerate(x for x in par if x.tag in (A + "r", A + "fld", A + "br")):
                text = "\n" if run.tag == A + "br" else "".join(t.text or "" for t in run.iterfind("a:t", NS))
                said.append(text)
                own = run.find("a:rPr", NS)
                chain = ([("run", own)] if own is not None else []) + styles.sources(kind, idx, shape, level)
                font = next(((n, styles.font(x.find("a:latin", NS).get("typeface"))) for n, x in chain if x.find("a:latin", NS) is not None), ("theme", styles.font("+mn-lt")))
                size = next(((n, int(x.get("sz")) / 100) for n, x in chain if x.get("sz")), (None, None))
                color = next(((n, v) for n, x in chain if (v := styles.color(x.find("a:solidFill", NS)))), (None, None))
                link = own.find("a:hlinkClick", NS) if own is not None else None
                self.add("runs", slide_index=index, uid=uid, row=row, col=col, para=k, run=j, text=text, font=font[1], font_from=font[0], size_pt=size[1], size_from=size[0], color_hex=color[1], color_from=color[0], bold=any(x.get("b") == "1" for _, x in chain[:1]), hyperlink=link.get(R + "id") if link is not None else None)
            lines.append("".join(said))
            self.add("paragraphs", slide_index=index, uid=uid, row=row, col=col, para=k, level=level, bulleted=bullet, margin_left_pt=int(margin) / EMU if margin else None, text=lines[-1], **self.setting(props))
        return "\n".join(lines)

    def table(self, table: ET.Element, index: int, uid: int, styles: Styles) -> None:
        for r, tr in enumerate(table.iterfind("a:tr", NS)):
            for c, tc in enumerate(tr.iterfind("a:tc", NS)):
                body = tc.find("a:txBody", NS)
                text = self.text(body, index, uid, r, c, styles, None, None, tc) if body is not None else ""
                self.add("table_cells", slide_index=index, uid=uid, row=r, col=c, text=text, is_merge_continuation=tc.get("hMerge") == "1" or tc.get("vMerge") == "1")

    def diagram(self, part: str | None) -> ET.Element:
        """The labels of a diagram's points as one text body, in the order in which its connections lead from the document
        point down; a label's level is its depth. Points that nothing leads to come last."""
        root, body = self.package.xml(part), ET.Element("body")
        points = {x.get("modelId"): x for x in root.iterfind("dgm:ptLst/dgm:pt", NS)} if root is not None else {}
        below: dict[str | None, list[tuple[int, str | None]]] = {}
        for x in root.iterfind("dgm:cxnLst/dgm:cxn", NS) if root is not None else ():
            if x.get("type", "parOf") == "parOf":
                below.setdefault(x.get("srcId"), []).append((int(x.get("srcOrd", "0")), x.get("destId")))
        seen: set[str | None] = set()
        tops = [k for k, x in points.items() if x.get("type") == "doc"] + [k for k, x in points.items() if x.get("type", "node") in ("node", "asst")]
        for top in tops:
            open_: list[tuple[str | None, int]] = [(top, 0)]
            while open_:
                name, depth = open_.pop()
                if name in seen or name not in points:
                    continue
                seen.add(name)
                for par in points[name].iterfind("dgm:t/a:p", NS):
                    said = ET.fromstring(ET.tostring(par))
                    props = said.find("a:pPr", NS)
                    if props is None:
                        props = ET.Element(A + "pPr")
                        said.insert(0, props)
                    props.set("lvl", str(max(depth - 1, 0)))
                    body.append(said)
                open_ += [(k, depth + 1) for _, k in sorted(below.get(name, ()), key=lambda c: c[0], reverse=True)]
        return body

    def chart(self, part: str | None, index: int, uid: int) -> None:
        root = self.package.xml(part)
        if root is None:
            return
        plot = root.find("c:chart/c:plotArea", NS)
        kinds = [x for x in plot if x.tag.endswith("Chart")] if plot is not None else []
        words = lambda node: "".join(t.text or "" for t in node.iter(A + "t")) if node is not None else None
        value_axis = plot.find("c:valAx/c:scaling", NS) if plot is not None else None
        bound = lambda tag: float(x.get("val")) if value_axis is not None and (x := value_axis.find(f"c:{tag}", NS)) is not None else None
        formats = [x.get("formatCode") for x in root.iter(C + "numFmt") if x.get("formatCode")]
        self.add("charts", slide_index=index, uid=uid, chart_type=kinds[0].tag.removeprefix(C).removesuffix("Chart") if kinds else None, title=words(root.find("c:chart/c:title", NS)) or None, axis_titles=[w for x in root.iter() if x.tag in (C + "catAx", C + "valAx") and (w := words(x.find("c:title", NS)))], has_legend=root.find("c:chart/c:legend", NS) is not None, shows_labels=any(x.get("val") == "1" for x in root.iter(C + "showVal")), label_formats=formats, axis_min=bound("min"), axis_max=bound("max"))
        book = self.workbook(part)
        n = 0
        for kind in kinds:
            for ser in kind.iterfind("c:ser", NS):
                name = "".join(x.text or "" for x in ser.findall("c:tx//c:v", NS)) or None
                points = lambda path: {int(pt.get("idx")): pt.findtext("c:v", None, NS) for pt in ser.findall(f"{path}//c:pt", NS)}  # noqa: B023, E731
                cats, vals = points("c:cat"), points("c:val")
                count = max([int(x.get("val")) for x in ser.findall("c:val//c:ptCount", NS)] + [k + 1 for k in vals] + [0])
                ref = ser.findtext("c:val//c:f", None, NS)
                cells, note = book(ref)
                fill = ser.find("c:spPr/a:solidFill/a:srgbClr", NS)
                for k in range(count):
                    v = vals.get(k)
                    number = float(v) if v not in (None, "") and re.fullmatch(r"-?[\d.]+(?:[eE][+-]?\d+)?", v) else None
                    self.add("chart_points", slide_index=index, uid=uid, series=n, series_name=name, point=k, category=cats.get(k), value=number, workbook_ref=ref, workbook_value=cells[k] if cells and k < len(cells) else None, workbook_note=note, fill_hex=fill.get("val") if fill is not None else None)
                n += 1

    def workbook(self, chart: str):
        """Reader of one-area ranges of the chart's embedded workbook: (values or None, why not)."""
        part = self.package.related(chart, "package")
        book = Package(self.package.zip.read(part)) if part in self.package.names else None

        def read(ref: str | None) -> tuple[list[float | None] | None, str | None]:
            m = re.fullmatch(r"'?([^'!]+)'?!\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", ref or "")
            if book is None:
                return None, "no embedded workbook"
            if m is None:
                return None, "not one area"
            root = book.xml("xl/workbook.xml")
            rid = next((s.get(R + "id") for s in root.iter(f"{{{NS['s']}}}sheet") if s.get("name") == m[1]), None)
            sheet = book.xml(book.rels("xl/workbook.xml").get(rid, (None, None, None))[1])
            if sheet is None:
                return None, "no such sheet"
            found = {c.get("r"): c.findtext("s:v", None, NS) for c in sheet.iter(f"{{{NS['s']}}}c") if c.get("t") in (None, "n")}
            number = lambda letters: sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters)))

            def letters(n: int) -> str:
                out = ""
                while n:
                    n, rest = divmod(n - 1, 26)
                    out = chr(65 + rest) + out
                return out

            cells = [f"{letters(c)}{r}" for r in range(int(m[3]), int(m[5] or m[3]) + 1) for c in range(number(m[2]), number(m[4] or m[2]) + 1)]
            return [float(found[c]) if found.get(c) else None for c in cells], None

        return read

    def package_rows(self, root: ET.Element) -> None:
        for part in ("docProps/core.xml", "docProps/app.xml"):
            props = self.package.xml(part)
            for node in props if props is not None else ():
                if node.text and node.text.strip():
                    self.add("pkg_props", part=part.removeprefix("docProps/").removesuffix(".xml"), name=node.tag.rpartition("}")[2], value=node.text.strip())
        for name in sorted(self.package.names):
            if name.endswith(".rels"):
                source = posixpath.normpath(posixpath.join(posixpath.dirname(posixpath.dirname(name)), posixpath.basename(name).removesuffix(".rels")))
                source = "" if source == "." else source
                for rid, (kind, target, mode) in self.package.rels(source).items():
                    self.add("pkg_rels", source=source, rel_id=rid, type=kind, target=target, mode=mode, resolved=target if mode == "Internal" else None, exists=mode != "Internal" or target in self.package.names)
            elif re.match(r"ppt/media/", name):
                data = self.package.zip.read(name)
                w, h = image_size(data)
                self.add("pkg_media", part=name, sha1=hashlib.sha1(data).hexdigest(), width=w, height=h)
            elif re.match(r"ppt/comments/.*\.xml$", name):
                comments = self.package.xml(name)
                authors = [x.get("authorId", "") for x in comments.iter() if x.tag.endswith("}cm")]
                for author in sorted(set(authors)):
                    self.add("pkg_comments", part=name, author=author, count=authors.count(author))
        for font in root.iterfind("p:embeddedFontLst/p:embeddedFont/p:font", NS):
            self.add("pkg_fonts", typeface=font.get("typeface"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows = Deck(path, content).rows
            except Exception as error:  # any damage to a file is that file's result
                rows = [("decks", json.dumps({"deck_id": path, "error": f"{type(error).__name__}: {error}"}))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([r for _, r in rows])], names=["table", "row"])


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """files: (deck_id, content). Every table of schemas.TABLES; files are parsed once, their rows written by kind of table."""
    spark = files.sparkSession
    path = f"{shared_folder(spark)}/decks-{uuid.uuid4().hex}"
    files.select("deck_id", "content").mapInArrow(_parse, "table string, row string").write.partitionBy("table").parquet(path)
    rows = spark.read.schema("row string, table string").parquet(path)
    return {name: rows.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in TABLES.items()}


def read_decks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All .pptx files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    return tables_of(files.select(F.col("path").alias("deck_id"), "content"))
