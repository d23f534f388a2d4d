"""Brand, layout, typography, hygiene, chart and consistency rules.

Every rule is a query over the tables of `schemas.TABLES`. Profile values reach a query as literals: a profile holds a
deck's house style and is small by nature.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import figures
from tallyframe.functions import geometry, labels, numbers, periods, text
from tallyframe.operators import consistency, extent, linkage, placement, slides, stats
from tallyframe.rules.engine import KEYS, RULES, lookup, outcomes, rule

# Limits and lists of the rules.
OFF_CANVAS_PT, MIN_DPI, UNITS = 0.5, 150.0, r"(?i)[$£€¥%]|\b(?:usd|eur|gbp|chf|jpy|millions?|billions?|thousands?|mm|bn|bps?|x|p\.a\.|units?|years?|months?|days?|people|ftes?)\b"
STANDARD_FONTS = ("arial", "calibri", "cambria", "candara", "consolas", "constantia", "corbel", "courier new", "georgia", "helvetica", "segoe ui", "symbol", "tahoma", "times new roman", "trebuchet ms", "verdana", "wingdings")
IDENTIFYING = ("creator", "lastModifiedBy", "Manager", "Company", "keywords", "category", "subject", "description")
BARS = ("bar", "bar3D")
POSITION_PT, GRID_PT, NEAR_MISS_PT, GUTTER_PT, SPELLING_SHOWN = 2.0, 0.5, 4.0, 1.0, 5
OPENING = r"^(opening|beginning|starting|brought forward|balance brought forward)\b"
CLOSING = r"^(closing|ending|carried forward|balance carried forward)\b"
AS_AT = r"(?i)\bas\s+(?:at|of)\s+([^.;,()]{6,24})"


def _literal(spark_array: list) -> F.Column:
    return F.array(*[F.lit(x) for x in spark_array])


def _leaves(t: dict[str, DataFrame]) -> DataFrame:
    return t["shapes"].where("is_leaf")


def _placed(t: dict[str, DataFrame]) -> DataFrame:
    return _leaves(t).where("width_pt > 0 AND height_pt > 0").join(t["decks"].select("deck_id", F.col("width_pt").alias("w"), F.col("height_pt").alias("h")), "deck_id")


def _passages(t: dict[str, DataFrame]) -> DataFrame:
    """All text by slide: frames and cells by paragraph, chart titles."""
    return t["paragraphs"].select(*KEYS, "text").unionByName(t["charts"].where("title IS NOT NULL").select(*KEYS, F.col("title").alias("text")))


def _title(t: dict[str, DataFrame]) -> DataFrame:
    return _leaves(t).where("placeholder_type IN ('title', 'ctrTitle') AND text <> ''")


# ---------------------------------------------------------------- brand


def _marks(t, p):
    """The logos that a profile knows by picture (sha1) or as drawn marks (lines)."""
    known, lines = lookup(p, "brand.logo.sha1"), lookup(p, "brand.logo.lines")
    images = t["shapes"].where(F.col("image_sha1").isin(*(known or []))).select("deck_id", "image_sha1")
    drawn = t["decks"].select("deck_id", F.explode(_literal(lines)).alias("line")) if lines else None
    return linkage.logo_marks(t, images, drawn)


@rule("BR-001", "blocker", needs=("brand.logo",))
def logo_missing(t, p):
    """logo.archetypes, where stated: {kind of slide: box, or none where it carries no logo}; other kinds are not checked."""
    marks = _marks(t, p).select("deck_id", "slide_index").distinct()
    bare = t["slides"].join(marks, ["deck_id", "slide_index"], "left_anti")
    known = lookup(p, "brand.logo.archetypes")
    if known is None:
        return outcomes(bare, "no approved logo on the slide")
    kind = F.col("archetype")
    out = F.when(~kind.isin(*known), "unchecked").when(kind.isin(*[k for k, box in known.items() if box]), "finding")
    rows = bare.join(slides.archetypes(t).select("deck_id", "slide_index", "archetype"), ["deck_id", "slide_index"]).withColumn("o", out).where("o IS NOT NULL")
    return outcomes(rows, F.when(F.col("o") == "finding", "no approved logo on the slide").otherwise(F.concat_ws(" ", F.lit("no logo is known for slides of kind"), "archetype")), None, None, F.col("o"))


def _logos(t, p):
    left, top, width, height = lookup(p, "brand.logo.box")
    logos = _marks(t, p)
    off = F.greatest(F.abs(F.col("left_pt") - left), F.abs(F.col("top_pt") - top))
    size = F.greatest(F.abs(F.col("width_pt") / width - 1), F.abs(F.col("height_pt") / height - 1))
    return logos.withColumn("off", off).withColumn("size", size)


@rule("BR-002", "major", needs=("brand.logo.box",))
def logo_position(t, p):
    """A slide is clear if any copy is in place; else the nearest copy is reported."""
    tol = lookup(p, "brand.logo.tolerance_pt") or 2.0
    near = _logos(t, p).groupBy("deck_id", "slide_index").agg(F.min("off").alias("off"), F.min_by("uid", F.struct("off", "uid")).alias("uid"))
    return outcomes(near.where(F.col("off") > tol), "logo out of place", F.round("off", 2), f"within {tol}pt")


@rule("BR-003", "major", needs=("brand.logo.box",))
def logo_size(t, p):
    near = _logos(t, p).groupBy("deck_id", "slide_index").agg(F.min("size").alias("size"), F.min_by("uid", F.struct("size", "uid")).alias("uid"))
    return outcomes(near.where("size > 0.03"), "logo of another size", F.round("size", 3), "within 3%")


def _off_palette(colours: DataFrame, p: dict, keys: list[str]) -> DataFrame:
    palette, tol = [h.upper().lstrip("#") for h in lookup(p, "brand.palette_hex")], lookup(p, "brand.palette_tolerance") or 3.0
    lab = geometry.to_lab(F.col("hex"))
    near = F.array_min(F.array(*[geometry.delta_e(F.col("lab"), geometry.to_lab(F.lit(h))) for h in palette]))
    return colours.where("hex RLIKE '^[0-9A-F]{6}$'").groupBy(*keys, "hex").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid")).withColumn("lab", lab).withColumn("far", near).where(F.col("far") > tol)


@rule("BR-004", "major", needs=("brand.palette_hex",))
def off_palette(t, p):
    use = lambda df, c: df.where(F.col(c).isNotNull()).select(*KEYS, F.upper(c).alias("hex"))
    uses = use(t["shapes"], "fill_hex").unionByName(use(t["shapes"], "line_hex")).unionByName(use(t["runs"].where("trim(text) <> ''"), "color_hex"))
    return outcomes(_off_palette(uses, p, ["deck_id", "slide_index"]), F.concat_ws(" ", F.lit("colour off the palette:"), "hex"), F.round("far", 1), "a palette colour")


@rule("BR-005", "blocker", needs=("fonts.allowed",))
def unapproved_typeface(t, p):
    allowed = [f.lower() for f in lookup(p, "fonts.allowed")]
    used = t["runs"].where("trim(text) <> '' AND font IS NOT NULL").where(~F.lower("font").isin(*allowed))
    return outcomes(used.groupBy("deck_id", "slide_index", "font").agg(F.min("uid").alias("uid")), F.concat_ws(" ", F.lit("typeface not approved:"), "font"), F.col("font"))


def _page_numbers(t, p):
    """Page numbers: where the profile has learned a pattern such as `Page {n}`, texts that follow it, else what stands in
    the placeholder for them."""
    pattern = lookup(p, "footer.page_number")
    if isinstance(pattern, str) and "{n}" in pattern:
        # each other number of the pattern may be another one in this deck
        fixed = [re.sub(r"\d+", r"\\d+", re.escape(x)) for x in pattern.split("{n}", 1)]
        number = F.regexp_extract(F.trim("text"), f"^{fixed[0]}(\\d+){fixed[1]}$", 1)
        return _leaves(t).where("text IS NOT NULL").withColumn("number", number.try_cast("int")).where("number IS NOT NULL")
    digits = F.regexp_extract("text", r"(\d+)", 1).try_cast("int")
    return _leaves(t).where("placeholder_type = 'sldNum'").withColumn("number", digits)


@rule("BR-006", "major", needs=("footer.page_number",))
def page_number(t, p):
    on = t["slides"].select("deck_id", "slide_index").join(_page_numbers(t, p).where("number IS NOT NULL").select("deck_id", "slide_index").distinct(), ["deck_id", "slide_index"], "left_anti")
    return outcomes(on, "no page number")


@rule("BR-007", "major", needs=("footer.page_number",))
def page_sequence(t, p):
    order = Window.partitionBy("deck_id").orderBy("slide_index", "uid")
    falls = _page_numbers(t, p).where("number IS NOT NULL").withColumn("before", F.lag("number").over(order)).where("number <= before")
    first = falls.withColumn("r", F.row_number().over(order)).where("r = 1")
    return outcomes(first, "page numbers do not ascend", F.col("number"), F.concat(F.lit("over "), F.col("before").cast("string")))


@rule("BR-008", "minor", needs=("layout.title_box",))
def title_geometry(t, p):
    left, top, width, height = lookup(p, "layout.title_box")
    tol = lookup(p, "layout.title_geometry_tolerance_pt") or 2.0
    worst = F.greatest(*[F.abs(F.col(c) - v) for c, v in (("left_pt", left), ("top_pt", top), ("width_pt", width), ("height_pt", height))])
    return outcomes(_title(t).withColumn("off", worst).where(F.col("off") > tol), "title moved or resized", F.round("off", 2), f"within {tol}pt")


@rule("BR-009", "blocker", needs=("slide.width_pt", "slide.height_pt"))
def slide_dimensions(t, p):
    w, h = lookup(p, "slide.width_pt"), lookup(p, "slide.height_pt")
    off = t["decks"].where("error IS NULL").where((F.abs(F.col("width_pt") - w) > 0.5) | (F.abs(F.col("height_pt") - h) > 0.5))
    return outcomes(off, "slides of another size", F.concat_ws(" x ", F.col("width_pt").cast("string"), F.col("height_pt").cast("string")), f"{w} x {h}")


@rule("BR-010", "major", needs=("footer.boilerplate",))
def boilerplate(t, p):
    """footer.archetypes, where stated: the kinds of slides that must carry the lines. Case and white space do not matter,
    and a line must stand within one shape."""
    on = t["slides"].select("deck_id", "slide_index")
    if lookup(p, "footer.archetypes"):
        on = slides.archetypes(t).where(F.col("archetype").isin(*lookup(p, "footer.archetypes"))).select("deck_id", "slide_index")
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    wanted = on.withColumn("wanted", F.explode(_literal(lookup(p, "footer.boilerplate"))))
    said = t["shapes"].where("text <> ''").groupBy("deck_id", "slide_index").agg(F.concat_ws("\n", F.collect_list(fold("text"))).alias("said"))
    missing = wanted.join(said, ["deck_id", "slide_index"], "left").where(~F.contains(F.coalesce("said", F.lit("")), fold("wanted")))
    return outcomes(missing, F.concat_ws(" ", F.lit("required line missing:"), "wanted"), None, F.col("wanted"))


@rule("BR-011", "major", needs=("brand.palette_hex",))
def series_off_palette(t, p):
    fills = t["chart_points"].where("fill_hex IS NOT NULL").select(*KEYS, "series", F.upper("fill_hex").alias("hex")).distinct()
    return outcomes(_off_palette(fills, p, ["deck_id", "slide_index"]), F.concat_ws(" ", F.lit("series off the palette:"), "hex"), F.round("far", 1))


# ---------------------------------------------------------------- layout


def _excused(s: DataFrame, found: DataFrame, *kinds: str) -> DataFrame:
    """s with `meant`: the first evidence of these kinds for the shape, null where there is none."""
    mine = found.where(F.col("evidence").isin(*kinds)).groupBy(*KEYS).agg(F.min("evidence").alias("meant"))
    return s.join(mine, KEYS, "left")


def _intent(t, p) -> DataFrame:
    """The evidence that a profile's grid and tolerances give; tables hold one profile's at a time."""
    grid = lookup(p, "layout.grid") or {}
    lines = {"x": grid.get("columns") or [], "y": grid.get("rows") or []}
    return placement.evidence(t, lines, grid.get("tolerance_pt") or GRID_PT, lookup(p, "layout.position_tolerance_pt") or POSITION_PT, lookup(p, "layout.gutter_stdev_pt") or GUTTER_PT)


@rule("LO-001", "blocker")
def off_canvas(t, p):
    """A decoration that bleeds over the edge behind the content is excused, and so is a shape without text or picture."""
    s = _placed(t).withColumn("out", F.greatest(-F.col("left_pt"), -F.col("top_pt"), F.col("left_pt") + F.col("width_pt") - F.col("w"), F.col("top_pt") + F.col("height_pt") - F.col("h"))).where(F.col("out") > OFF_CANVAS_PT)
    bleed = (F.coalesce("text", F.lit("")) == "") & (F.col("kind") != "picture")
    decor = placement.decorations(t).withColumn("decor", F.lit(True))
    out = F.when(bleed | F.col("decor"), "excused").otherwise("finding")
    return outcomes(s.join(decor, KEYS, "left").withColumn("o", out), "reaches over the slide's edge", F.round("out", 2), f"{OFF_CANVAS_PT}pt at most", F.col("o"))


@rule("LO-002", "minor", needs=("layout.safe_margin_pt",))
def margin_intrusion(t, p):
    """Furniture, and a box that stands there on three slides, is meant: excused."""
    m = lookup(p, "layout.safe_margin_pt")
    inside = F.greatest(m - F.col("left_pt"), m - F.col("top_pt"), F.col("left_pt") + F.col("width_pt") - (F.col("w") - m), F.col("top_pt") + F.col("height_pt") - (F.col("h") - m))
    on_slide = "left_pt >= -0.5 AND top_pt >= -0.5 AND left_pt + width_pt <= w + 0.5 AND top_pt + height_pt <= h + 0.5 AND width_pt * height_pt < 0.8 * w * h"
    s = _placed(t).where("text <> '' AND coalesce(placeholder_type, '') NOT IN ('sldNum', 'ftr', 'dt')").where(on_slide).withColumn("into", inside).where("into > 2")
    s = _excused(s, placement.settled(t), "furniture", "repeated")
    return outcomes(s, F.concat_ws(": ", F.lit("text inside the margin"), "meant"), F.round("into", 2), f"{m}pt margin", F.when(F.col("meant").isNull(), "finding").otherwise("excused"))


@rule("LO-003", "minor", needs=("layout.grid",))
def near_miss(t, p):
    """grid: {columns, rows}. An edge or middle that misses its nearest line by .5 to 4 points, with no second line as near
    and nothing that says its place on that axis is meant; of each shape and axis the closest."""
    grid = lookup(p, "layout.grid")
    least, most = grid.get("tolerance_pt") or GRID_PT, grid.get("near_miss_pt") or NEAR_MISS_PT
    e = slides.edges(t).join(_placed(t).select(*KEYS), KEYS, "left_semi").withColumn("all", placement.distances({"x": grid.get("columns") or [], "y": grid.get("rows") or []}))
    e = e.withColumn("d", F.array_min("all")).where((F.col("d") >= least) & (F.col("d") <= most) & (F.size(F.filter("all", lambda x: x <= most)) == 1))
    both = F.explode(F.when(F.col("axis") == "both", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array("axis")))
    meant = _intent(t, p).withColumn("axis", both).select(*KEYS, "axis").distinct()
    best = e.join(meant, [*KEYS, "axis"], "left_anti").groupBy(*KEYS, "axis").agg(F.min_by("edge", F.struct("d", "edge")).alias("edge"), F.min("d").alias("d"))
    return outcomes(best, F.concat_ws(" ", F.lit("just misses a grid line:"), "edge"), F.round("d", 2), "on the line")


@rule("LO-004", "major")
def text_overlap(t, p):
    """Overlap of ink, not of frames; of two boxes that are bounds and no measures, with medium confidence."""
    share = lookup(p, "layout.overlap_area_share") or 0.05
    ink = extent.ink_boxes(t, t.get("faces")).where("width >= 3 AND height >= 3")
    s = slides.content_shapes(t).where("text <> '' AND kind = 'text'").select(*KEYS, "name", "z_order").join(ink, KEYS)
    a, b = s.alias("a"), s.alias("b")
    c = lambda q: tuple(F.col(f"{q}.{x}") for x in ("left", "top", "width", "height"))
    area = geometry.overlap_area(c("a"), c("b")) / F.least(F.col("a.width") * F.col("a.height"), F.col("b.width") * F.col("b.height"))
    pairs = a.join(b, (F.col("a.deck_id") == F.col("b.deck_id")) & (F.col("a.slide_index") == F.col("b.slide_index")) & (F.col("a.z_order") < F.col("b.z_order")) & (area > share))
    sure = F.when(F.col("a.measured") & F.col("b.measured"), "high").otherwise("medium")
    return outcomes(pairs.select(*[F.col(f"b.{k}").alias(k) for k in KEYS], area.alias("share"), F.col("a.name").alias("under"), sure.alias("sure")), F.concat_ws(" ", F.lit("text over"), "under"), F.round("share", 3), f"{share} at most", confidence=F.col("sure"))


@rule("LO-006", "major", "low", default=False)
def text_overflow(t, p):
    """Measured text that is higher than its frame. Off unless named: a frame that grows with its text, and kerning, mislead it.
    What has a face without known advances, and the text of tables and charts, stays unchecked."""
    s = extent.overflowing(t, t.get("faces"))
    out = F.when(F.col("state") == "over", "finding").otherwise("unchecked")
    said = F.when(F.col("state") == "over", F.format_string("the text needs %d lines, more than its shape holds", "lines")).when(F.col("state") == "no room", "the insets leave no room").otherwise("no face or size to measure with")
    found = outcomes(s.where("state <> 'fits'"), said, F.round("ink_y", 1), F.round("room_y", 1), out)
    framed = _leaves(t).where("kind IN ('table', 'chart')")
    return found.unionByName(outcomes(framed, "text of tables and charts is laid out otherwise", outcome="unchecked"))


@rule("LO-007", "major", needs=("fonts.roles",))
def font_band(t, p):
    """roles: {role: [smallest, largest]}; a run's role is its placeholder, `table` or `body`."""
    role = F.when(F.col("row").isNotNull(), "table").when(F.col("placeholder_type").isin("title", "ctrTitle"), "title").when(F.col("placeholder_type").isin("ftr", "sldNum", "dt"), "footer").otherwise("body")
    runs = t["runs"].where("trim(text) <> '' AND size_pt IS NOT NULL").join(t["shapes"].select(*KEYS, "placeholder_type"), KEYS).withColumn("role", role)
    bands = F.create_map(*[x for k, (lo, hi) in lookup(p, "fonts.roles").items() for x in (F.lit(k), F.array(F.lit(float(lo)), F.lit(float(hi))))])
    grouped = runs.groupBy("deck_id", "slide_index", "role", F.round("size_pt", 2).alias("size")).agg(F.min("uid").alias("uid")).withColumn("band", F.try_element_at(bands, F.col("role")))
    out = F.when(F.col("band").isNull(), "unchecked").when((F.col("size") < F.get("band", F.lit(0))) | (F.col("size") > F.get("band", F.lit(1))), "finding")
    return outcomes(grouped.withColumn("o", out).where("o IS NOT NULL"), F.concat_ws(" ", F.lit("font size for"), "role"), F.col("size"), F.concat_ws(" to ", "band"), F.col("o"))


@rule("LO-005", "minor", needs=("layout.recurring",))
def displaced(t, p):
    """recurring: [{kind, name, left, top}]; an element of that kind and name that stands elsewhere."""
    within = lookup(p, "layout.position_tolerance_pt") or POSITION_PT
    known = F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["name"]).alias("name"), F.lit(float(r["left"])).alias("left"), F.lit(float(r["top"])).alias("top")) for r in lookup(p, "layout.recurring")])
    mine = F.filter(known, lambda k: (k["kind"] == F.col("kind")) & (k["name"] == F.col("name")))
    s = _placed(t).withColumn("home", F.try_element_at(mine, F.lit(1))).where("home IS NOT NULL")
    off = F.greatest(F.abs(F.col("left_pt") - F.col("home.left")), F.abs(F.col("top_pt") - F.col("home.top")))
    return outcomes(s.withColumn("off", off).where(F.col("off") > within), F.concat_ws(" ", F.lit("recurring element displaced:"), "name"), F.round("off", 2), f"{within}pt at most")


@rule("LO-008", "minor", needs=("layout.gutter_stdev_pt",))
def gutters(t, p):
    """Rows and columns of three or more siblings of one size whose gaps vary. Shapes that overlap by more than the
    tolerance make no row."""
    limit, within = lookup(p, "layout.gutter_stdev_pt"), lookup(p, "layout.position_tolerance_pt") or POSITION_PT
    bad = placement.runs(t, "x", within).unionByName(placement.runs(t, "y", within)).where(F.col("spread") > limit)
    return outcomes(bad, "uneven gaps in a row of equals", F.round("spread", 2), f"{limit}pt at most")


@rule("LO-009", "minor")
def bullet_indent(t, p):
    """Explicit indents of one frame and level in more than one 1pt cluster: those off the best-supported one."""
    rows = t["paragraphs"].where("margin_left_pt IS NOT NULL").withColumn("one", F.lit(1))
    keys = [*KEYS, "level"]
    members = stats.cluster_1d(rows, keys, "margin_left_pt", "one", 1.0)
    clusters = stats.cluster_stats(members, keys)
    w = Window.partitionBy(*keys)
    ranked = clusters.withColumn("n", F.sum("support").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("support"), "centre"))).withColumn("mode1", F.first("mode").over(w.orderBy(F.desc("support"), "centre")))
    return outcomes(ranked.where("n >= 3 AND r > 1"), "bullet indent differs from its list", F.round("mode", 2), F.round("mode1", 2))


# ---------------------------------------------------------------- typography


@rule("TY-001", "minor", needs=("typography.quotes",))
def quote_style(t, p):
    want = lookup(p, "typography.quotes")
    wrong = "straight" if want == "curly" else "curly"
    counted = _passages(t).select("deck_id", "slide_index", text.quote_census(F.col("text"))[wrong].alias("n")).groupBy("deck_id", "slide_index").agg(F.sum("n").alias("n"))
    return outcomes(counted.where("n > 0"), f"{wrong} quotes", F.col("n"), want)


@rule("TY-002", "minor")
def whitespace(t, p):
    found = _passages(t).select(*KEYS, F.explode(text.whitespace_defects(text.without_set_spacing(F.col("text")))).alias("kind", "n"))
    return outcomes(found.groupBy(*KEYS, "kind").agg(F.sum("n").alias("n")), F.col("kind"), F.col("n"), "0")


@rule("TY-003", "minor", needs=("typography.bullet_terminal",))
def bullet_terminal(t, p):
    want = lookup(p, "typography.bullet_terminal")
    rows = t["paragraphs"].where("bulleted AND trim(text) <> ''").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(text.terminal(F.col("text")) != want, 1)).alias("off"))
    out = F.when(F.col("off") == F.col("n"), "unchecked").otherwise("finding")
    return outcomes(rows.where("off > 0").withColumn("o", out), "bullets end differently", F.col("off"), want, F.col("o"))


@rule("TY-004", "minor", needs=("typography.title_case",))
def title_case(t, p):
    want = lookup(p, "typography.title_case")
    content = slides.archetypes(t).where(F.col("archetype").isin(*slides.CONTENT)).select("deck_id", "slide_index")
    rows = _title(t).join(content, ["deck_id", "slide_index"]).withColumn("style", text.capitalisation(F.col("text"))).where(~F.col("style").eqNullSafe(F.lit(want)))
    return outcomes(rows, "title capitalisation", F.col("style"), want, F.when(F.col("style").isNull(), "unchecked").otherwise("finding"))


@rule("TY-005", "major", needs=("typography.canon_terms",))
def canonical_terms(t, p):
    """canon_terms: {canonical: [accepted forms]}; other spellings of the same key are reported."""
    terms = lookup(p, "typography.canon_terms")
    rows = []
    for canonical, accepted in terms.items():
        n = len(canonical.split())
        form = _passages(t).select(*KEYS, F.explode(text.word_windows(F.col("text"), n)).alias("form")).select(*KEYS, F.regexp_replace("form", r"[.,;:!?)\]'\"’”]+$", "").alias("form"))
        bad = form.where((text.canon_key(F.col("form")) == text.canon_key(F.lit(canonical))) & ~F.col("form").isin(canonical, *accepted))
        rows.append(outcomes(bad.groupBy("deck_id", "slide_index", "form").agg(F.min("uid").alias("uid")), F.concat_ws(" ", F.lit("spelling of a house term:"), "form"), F.col("form"), canonical))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@rule("TY-006", "minor")
def column_format(t, p):
    """Within a column and suffix: decimals, separators of figures from 1000, and negative style must not mix."""
    cells = t["table_cells"].where("row > 0 AND col > 0 AND NOT is_merge_continuation").select(*KEYS, "col", numbers.parse_number(F.col("text")).alias("r")).where("r IS NOT NULL")
    big = F.when(F.abs("r.value") >= 1000, F.coalesce("r.separator", F.lit("none")))
    g = cells.groupBy(*KEYS, "col", F.coalesce("r.suffix", F.lit("")).alias("suffix")).agg(F.count_distinct("r.decimals").alias("d"), F.count_distinct(big).alias("s"), F.count_distinct("r.negative_style").alias("m"))
    what = F.concat_ws(", ", F.when(F.col("d") > 1, "decimals"), F.when(F.col("s") > 1, "separators"), F.when(F.col("m") > 1, "negatives"))
    return outcomes(g.where("d > 1 OR s > 1 OR m > 1"), F.concat_ws(" ", F.lit("mixed in one column:"), what), F.col("col"))


@rule("TY-007", "minor", needs=("typography.currency_literals",))
def currency_notation(t, p):
    house = lookup(p, "typography.currency_literals")
    marks = _passages(t).select(*KEYS, F.explode(numbers.currency_tokens(F.col("text"))).alias("mark")).where(~F.col("mark").isin(*house))
    return outcomes(marks.groupBy("deck_id", "slide_index", "mark").agg(F.min("uid").alias("uid")), F.concat_ws(" ", F.lit("currency written as"), "mark"), F.col("mark"), ", ".join(house))


@rule("TY-008", "minor", needs=("typography.date_format",))
def date_format(t, p):
    want = lookup(p, "typography.date_format")
    dates = _passages(t).select(*KEYS, F.explode(text.date_candidates(F.col("text"))).alias("date")).withColumn("f", text.date_formats(F.col("date")))
    return outcomes(dates.where((F.size("f") > 0) & ~F.array_contains("f", want)), F.concat_ws(" ", F.lit("date format of"), "date"), F.col("date"), want)


@rule("TY-009", "minor", default=False)
def spelling(t, p):
    """Words in no dictionary. The dictionary is a table `dictionary` (word) beside the deck's own; house terms are known."""
    terms = [w.lower() for phrase in lookup(p, "typography.canon_terms") or {} for w in phrase.split()]
    own = slides.furniture(t)
    words = _passages(t).join(own, KEYS, "left_anti").select(*KEYS, F.explode(text.spell_tokens(F.col("text"))).alias("word")).select(*KEYS, F.lower("word").alias("word")).distinct()
    known = t["dictionary"].select(F.lower("word").alias("word")).distinct()
    unknown = words.where(~F.regexp_replace("word", "['’]s?$", "").isin(*terms)).join(known, "word", "left_anti")
    unknown = unknown.withColumn("stem", F.regexp_replace("word", "['’]s?$", "")).join(known.withColumnRenamed("word", "stem"), "stem", "left_anti")
    g = unknown.groupBy(*KEYS).agg(F.array_sort(F.collect_set("word")).alias("words"))
    more = F.when(F.size("words") > SPELLING_SHOWN, F.concat(F.lit(" and "), (F.size("words") - SPELLING_SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return outcomes(g, F.concat(F.lit("in no dictionary: "), F.array_join(F.slice("words", 1, SPELLING_SHOWN), ", "), more), F.size("words"))


# ---------------------------------------------------------------- hygiene


@rule("HY-001", "blocker")
def placeholder_markers(t, p):
    markers = lookup(p, "hygiene.placeholder_markers") or list(text.MARKERS)
    said = _passages(t).select("deck_id", "slide_index", "text").unionByName(t["slides"].where("notes <> ''").select("deck_id", "slide_index", F.col("notes").alias("text")))
    hits = said.select("deck_id", "slide_index", F.explode(F.array_compact(F.array(*[F.when(text.matches_marker(F.col("text"), m), F.lit(m)) for m in markers]))).alias("marker"))
    found = hits.groupBy("deck_id", "slide_index").agg(F.array_sort(F.collect_set("marker")).alias("m"))
    return outcomes(found, "placeholder text left", F.concat_ws(", ", "m"))


@rule("HY-002", "major")
def speaker_notes(t, p):
    return outcomes(t["slides"].where("trim(notes) <> ''"), "speaker notes", F.length("notes"), "none")


@rule("HY-003", "major")
def hidden_slides(t, p):
    hidden = t["slides"].where("is_hidden").groupBy("deck_id").agg(F.array_sort(F.collect_list("slide_index")).alias("s"))
    return outcomes(hidden, "hidden slides", F.concat_ws(", ", F.col("s").cast("array<string>")))


@rule("HY-004", "blocker")
def metadata(t, p):
    allowed = [x.strip().lower() for x in lookup(p, "hygiene.allowed_metadata") or []]
    props = t["pkg_props"].where(F.col("name").isin(*IDENTIFYING))
    return outcomes(props.where(~F.lower(F.trim("value")).isin(*allowed)) if allowed else props, F.concat_ws(" ", F.lit("document property"), "name"), F.col("value"))


@rule("HY-005", "blocker")
def comments(t, p):
    c = t["pkg_comments"].groupBy("deck_id").agg(F.sum("count").alias("n"), F.count_distinct("author").alias("a"))
    return outcomes(c, "review comments", F.col("n"), "none")


@rule("HY-006", "major")
def empty_placeholder(t, p):
    visible = t["slides"].where("NOT is_hidden").select("deck_id", "slide_index")
    empty = _leaves(t).where("placeholder_type IS NOT NULL AND placeholder_type NOT IN ('dt', 'ftr', 'sldNum') AND kind IN ('text', 'shape') AND trim(coalesce(text, '')) = ''")
    return outcomes(empty.join(visible, ["deck_id", "slide_index"]), "empty placeholder", F.col("placeholder_type"))


@rule("HY-007", "blocker")
def external_relationships(t, p):
    r = t["pkg_rels"]
    local = (F.col("mode") == "External") & (F.col("target").rlike(r"(?i)^file:|^[a-z]:[\\/]|^\\\\") | ~F.col("type").isin("hyperlink"))
    index = F.regexp_extract("source", r"slides/slide(\d+)\.xml$", 1).try_cast("int")
    what = F.when(local, "link to a local or linked file").otherwise("broken internal link")
    return outcomes(r.where(local | ~F.col("exists")).withColumn("slide_index", F.coalesce(index, F.lit(0))), what, F.col("target"))


@rule("HY-008", "major")
def image_resolution(t, p):
    floor = lookup(p, "hygiene.min_image_dpi") or MIN_DPI
    dpi = F.least(F.col("image_width") / (F.col("width_pt") / 72), F.col("image_height") / (F.col("height_pt") / 72))
    pics = t["shapes"].where("kind = 'picture' AND image_sha1 IS NOT NULL").withColumn("dpi", F.when(F.col("width_pt") > 0, dpi))
    return outcomes(pics.where(F.col("dpi").isNull() | (F.col("dpi") < floor)), "image resolution", F.round("dpi", 1), f"{floor} dpi", F.when(F.col("dpi").isNull(), "unchecked").otherwise("finding"))


@rule("HY-009", "minor", "medium")
def non_standard_font(t, p):
    known = [*STANDARD_FONTS, *[f.lower() for f in lookup(p, "hygiene.extra_fonts") or []]]
    embedded = t["pkg_fonts"].select("deck_id", F.lower("typeface").alias("face")).distinct()
    base = F.lower(F.regexp_replace("font", r"(?i)\s+(?:light|medium|semibold|bold|black|thin|book|regular)$", ""))
    used = t["runs"].where("trim(text) <> '' AND font IS NOT NULL").withColumn("face", base).where(~F.col("face").isin(*known))
    return outcomes(used.join(embedded, ["deck_id", "face"], "left_anti").groupBy("deck_id", "font").agg(F.min("slide_index").alias("slide_index"), F.min_by("uid", "slide_index").alias("uid")), F.concat_ws(" ", F.lit("font neither standard nor embedded:"), "font"), F.col("font"))


# ---------------------------------------------------------------- charts


@rule("CH-001", "major")
def chart_not_identified(t, p):
    headed = _title(t).select("deck_id", "slide_index").distinct()
    bare = t["charts"].where("coalesce(title, '') = ''").join(headed, ["deck_id", "slide_index"], "left_anti")
    return outcomes(bare, "chart without title, caption or headline")


@rule("CH-002", "major", "medium")
def chart_units(t, p):
    said = _passages(t).where(F.col("text").rlike(UNITS)).select("deck_id", "slide_index").distinct()
    own = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.concat_ws(" ", "axis_titles"), F.concat_ws(" ", "label_formats"))
    return outcomes(t["charts"].where(~own.rlike(UNITS)).join(said, ["deck_id", "slide_index"], "left_anti"), "chart states no unit")


@rule("CH-003", "major")
def truncated_baseline(t, p):
    bars = t["charts"].where(F.col("chart_type").isin(*BARS)).where("axis_min IS NULL OR axis_min <> 0")
    return outcomes(bars, "bars do not start at zero", F.col("axis_min"), "0", F.when(F.col("axis_min").isNull(), "unchecked").otherwise("finding"))


@rule("CH-004", "major")
def series_unnamed(t, p):
    many = t["chart_points"].groupBy(*KEYS).agg(F.count_distinct("series").alias("n")).where("n >= 2")
    return outcomes(t["charts"].where("NOT has_legend AND NOT shows_labels").join(many, KEYS), "series cannot be told apart", F.col("n"))


@rule("CH-005", "minor")
def label_precision(t, p):
    f = t["charts"].select(*KEYS, F.explode("label_formats").alias("f")).where("f <> 'General' AND f RLIKE '0'")
    g = f.groupBy(*KEYS, F.col("f").contains("%").alias("percent")).agg(F.count_distinct(F.length(F.regexp_extract("f", r"\.(0+)", 1))).alias("d"))
    return outcomes(g.where("d > 1"), "label decimals differ within a chart", F.col("d"), "1")


@rule("CH-006", "major")
def stale_cache(t, p):
    """The drawn value against the workbook behind it; points beyond the shorter side are not compared."""
    pts = t["chart_points"].where("workbook_ref IS NOT NULL")
    a, b = F.col("value"), F.col("workbook_value")
    near = F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * 1e-9
    g = pts.groupBy(*KEYS).agg(F.count(F.when(F.col("workbook_note").isNull() & b.isNotNull() & (a.isNull() | near), 1)).alias("off"), F.max("workbook_note").alias("note"))
    return outcomes(g.where("off > 0 OR note IS NOT NULL"), F.when(F.col("off") > 0, "chart differs from its workbook").otherwise(F.col("note")), F.col("off"), "0", F.when(F.col("off") > 0, "finding").otherwise("unchecked"))


# ---------------------------------------------------------------- consistency


@rule("CO-003", "major", "medium")
def totals(t, p):
    cells = t["table_cells"].where("row > 0 AND NOT is_merge_continuation")
    head = cells.where("col = 0").select(*KEYS, "row", labels.is_total(labels.normalise_label(F.col("text"))).alias("is_total"))
    body = cells.where("col > 0").join(head, [*KEYS, "row"]).where(~numbers.is_placeholder(F.col("text"))).withColumn("r", numbers.read_cell(F.col("text")))
    column = Window.partitionBy(*KEYS, "col")
    sound = body.withColumn("bad", F.max(F.col("r").isNull().cast("int")).over(column)).withColumn("units", F.size(F.collect_set(F.coalesce("r.suffix", F.lit(""))).over(column)))
    has_total = sound.withColumn("any", F.max(F.col("is_total").cast("int")).over(column)).where("any = 1")
    refused = has_total.where("bad = 1 OR units > 1").select(*KEYS, "col").distinct()
    fine = has_total.where("bad = 0 AND units = 1 AND coalesce(r.suffix, '') NOT IN ('%', 'x')").select(*KEYS, "col", "row", "is_total", F.col("r.value").alias("value"), F.col("r.decimals").alias("decimals"))
    checked = consistency.totals(fine, [*KEYS, "col"], "row").where("outcome = 'finding'")
    return outcomes(checked, "total does not sum its column", F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"))).unionByName(outcomes(refused, "column cannot be added up", F.col("col"), None, "unchecked"))


# Labels of results and of what they are computed from.
REVENUE, EBITDA, EV = ["revenue", "sales", "turnover", "net sales", "total revenue"], ["ebitda", "adjusted ebitda", "adj. ebitda"], ["enterprise value", "ev", "tev", "implied enterprise value"]
MARGINS = (
    (["margin", "ebitda margin", "ebitda margin %"], EBITDA, REVENUE),
    (["gross margin"], ["gross profit"], REVENUE),
    (["operating margin", "ebit margin"], ["ebit", "operating profit", "operating income"], REVENUE),
    (["net margin", "net income margin"], ["net income", "net profit", "profit after tax"], REVENUE),
)
MULTIPLES = (
    (["multiple", "ev/ebitda", "ev / ebitda", "ev ebitda", "ev/ebitda multiple"], EV, EBITDA),
    (["ev/revenue", "ev / revenue", "ev/sales", "ev sales", "ev revenue"], EV, REVENUE[:4]),
    (["p/e", "pe", "p / e", "price earnings", "p/e multiple", "p e"], ["market capitalisation", "market capitalization", "market cap", "equity value"], ["net income", "net profit", "earnings", "profit after tax"]),
)


def _at(figures_: DataFrame, found: DataFrame) -> DataFrame:
    """found (ord, ...) with where its figure stands."""
    return found.join(figures_.select("ord", F.col("deck").alias("deck_id"), F.col("slide").alias("slide_index"), "uid", "raw", "metric", "period"), "ord")


def _said(t, scale):
    f = figures.index_of(t)
    pairs = consistency.disagreements(f, scale).select("base_ord", "ord").join(f.select(F.col("ord").alias("base_ord"), F.col("raw").alias("base")), "base_ord")
    return _at(f, pairs)


@rule("CO-001", "major", "medium")
def contradiction(t, p):
    """Figures that disagree; those whose kind is not known and that others could have contradicted are unchecked."""
    f = figures.index_of(t)
    found = outcomes(_said(t, False), F.concat_ws(" ", F.lit("stated two ways:"), "metric", "period"), F.col("raw"), F.col("base"))
    unread = _at(f, consistency.unread(f).select("ord", "others"))
    return found.unionByName(outcomes(unread, F.concat_ws(" ", F.lit("kind not known, statements not compared:"), "metric", F.col("others").cast("string")), F.col("raw"), None, "unchecked"))


@rule("CO-002", "major", "medium")
def scale_mismatch(t, p):
    return outcomes(_said(t, True), F.concat_ws(" ", F.lit("off by a factor:"), "metric", "period"), F.col("raw"), F.col("base"))


def _ratios(t, derivations, quantity, percentage):
    f = figures.index_of(t)
    right = f.where((F.coalesce("quantity", F.lit("")) == quantity) | (F.col("kind") == "level"))
    out = consistency.ratios(right, derivations, percentage).where("outcome <> 'tied'")
    rows = _at(f, out).where(~F.col("metric").isin(*labels.STATISTICS))
    return outcomes(rows, F.concat_ws(" ", F.lit("does not follow from its inputs:"), "metric", "period", "reason"), F.col("raw"), F.round("computed", 3), F.col("outcome"))


@rule("CO-004", "major")
def margin(t, p):
    return _ratios(t, MARGINS, "%", True)


@rule("CO-005", "major")
def multiple(t, p):
    return _ratios(t, MULTIPLES, "x", False)


@rule("CO-006", "major", "medium")
def growth(t, p):
    """A rate over a range of periods against its series; a single period is not checked."""
    f = figures.index_of(t)
    ends = periods.endpoints(F.col("period"))
    said = f.where("quantity = '%'").withColumn("base", labels.base_metric(F.col("metric"))).where("base IS NOT NULL").withColumn("e", ends).where("e IS NOT NULL")
    level = f.where("kind = 'level' AND quantity IS NULL AND period IS NOT NULL").groupBy("deck", "metric", "scope", "period").agg(F.count_distinct(F.round("value", 6)).alias("n"), F.min("value").alias("value")).where("n = 1")
    key = lambda d, m, s: F.concat_ws("|", d, m, s)
    stated = said.select(F.col("ord").alias("id"), key("deck", "base", "scope").alias("scope"), F.col("e.first").alias("p1"), F.col("e.last").alias("p2"), "value")
    series = level.select(key("deck", "metric", "scope").alias("scope"), "period", "value")
    a, b = series.alias("a"), series.alias("b")
    both = stated.alias("s").join(a, (F.col("s.scope") == F.col("a.scope")) & (F.col("s.p1") == F.col("a.period")), "left").join(b, (F.col("s.scope") == F.col("b.scope")) & (F.col("s.p2") == F.col("b.period")), "left")
    years = periods.year_of(F.col("s.p2")) - periods.year_of(F.col("s.p1"))
    defined = F.coalesce((F.col("a.value") > 0) & (F.col("b.value") > 0) & (years > 0), F.lit(False))
    computed = F.when(defined, (F.pow(F.col("b.value") / F.col("a.value"), F.lit(1.0) / years) - 1) * 100)
    out = F.when(~defined, "unchecked").when(F.abs(computed - F.col("s.value")) <= consistency.GROWTH_TOLERANCE, "tied").otherwise("finding")
    rows = _at(f, both.select(F.col("s.id").alias("ord"), out.alias("o"), computed.alias("computed")).where("o <> 'tied'"))
    return outcomes(rows, F.concat_ws(" ", F.lit("growth does not match its series:"), "metric", "period"), F.col("raw"), F.round("computed", 1), F.col("o"))


@rule("CO-007", "major")
def bridge(t, p):
    """A column whose ends are named as opening and closing, or are one metric at two periods around undated steps."""
    cells = t["table_cells"].where("row > 0 AND NOT is_merge_continuation")
    head = cells.where("col = 0").select(*KEYS, "row", labels.normalise_label(F.col("text")).alias("label"), periods.split_period("text").alias("s"))
    whole = Window.partitionBy(*KEYS)
    head = head.withColumn("metric", labels.normalise_label(F.col("s.label"))).withColumn("first", F.min("row").over(whole)).withColumn("last", F.max("row").over(whole))
    at = lambda end, c: F.max(F.when(F.col("row") == F.col(end), F.col(c))).over(whole)
    dated = F.count(F.when(F.col("s.period").isNotNull(), 1)).over(whole)
    head = head.withColumn("dated", dated).withColumn("same", (at("first", "metric") == at("last", "metric")) & (at("first", "s.period") != at("last", "s.period")))
    by_period = F.coalesce(F.col("same") & (F.col("dated") == 2), F.lit(False))
    role = F.when(F.col("label").rlike(OPENING) | by_period & (F.col("row") == F.col("first")), "opening").when(F.col("label").rlike(CLOSING) | by_period & (F.col("row") == F.col("last")), "closing").otherwise("step")
    body = cells.where("col > 0").join(head.select(*KEYS, "row", role.alias("role")), [*KEYS, "row"]).withColumn("r", numbers.read_cell(F.col("text")))
    column = Window.partitionBy(*KEYS, "col")
    body = body.withColumn("ends", F.count(F.when(F.col("role") != "step", 1)).over(column)).where("ends > 0")
    unread = body.where("r IS NULL").select(*KEYS, "col").distinct()
    steps = body.join(unread, [*KEYS, "col"], "left_anti").select(*KEYS, "col", "row", "role", F.col("r.value").alias("value"), F.col("r.decimals").alias("decimals"))
    found = consistency.bridges(steps, [*KEYS, "col"], "row").where("outcome IN ('finding', 'unchecked')")
    return outcomes(found, "bridge does not carry to its closing", F.round("carried", 3), None, F.col("outcome"))


def _as_at(t):
    """The one date as at which a slide states its figures; slides with several different dates have none."""
    said = _passages(t).select("deck_id", "slide_index", F.trim(F.regexp_extract("text", AS_AT, 1)).alias("said")).where("said <> ''")
    read = said.select("deck_id", "slide_index", F.lower(F.try_element_at(text.date_candidates(F.col("said")), F.lit(1))).alias("date")).where("date IS NOT NULL")
    return read.groupBy("deck_id", "slide_index").agg(F.count_distinct("date").alias("n"), F.min("date").alias("date")).where("n = 1").select(F.col("deck_id").alias("deck"), F.col("slide_index").alias("slide"), "date")


@rule("CO-009", "minor", "medium")
def as_of_drift(t, p):
    """One fact on slides that state different dates: every later date is told against the first."""
    f = figures.index_of(t).join(_as_at(t), ["deck", "slide"])
    rows = consistency.date_drift(f)
    return outcomes(_at(figures.index_of(t), rows), F.concat_ws(" ", F.lit("as-of dates differ for"), "metric", "period"), F.col("date"), F.col("first"))


@rule("CO-008", "minor", "medium")
def unit_drift(t, p):
    """One fact under two stated currencies or scales, unless the deck states both amounts side by side."""
    f = figures.index_of(t)
    rows = consistency.unit_drift(f, figures.conversions(_passages(t)))
    unit = lambda c: F.concat_ws(" ", f"{c}.currency", f"{c}.scale")
    return outcomes(_at(f, rows.select("ord", unit("stated").alias("stated"), unit("first").alias("first"))), F.concat_ws(" ", F.lit("unit drifts:"), "metric", "period"), F.col("stated"), F.col("first"))


__all__ = ["RULES"]
