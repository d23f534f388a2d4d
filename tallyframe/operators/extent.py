"""Where a shape's ink lands: a box that holds its text for certain, laid out from its runs.

A text frame is usually larger than its text. The layout here sets each paragraph's words into lines and adds the lines
up, with a letter's true advance where a table of faces knows it and a bound that no letter passes where it does not. A
mixture of both is still a bound, so a box may turn out too large and never too small. `measured` says that no bound
was needed.

faces: (font string in lower case, bold boolean, advances map<string, double>, line_em double), advances in ems by letter;
`sources.fonts.read_faces` makes it from font files. Words become rows (a word may run over several runs), each
paragraph's widths are folded into lines by a column function, and shapes are sums over paragraphs: one plan for all decks.

Cases: rotated, painted (filled or outlined) and empty shapes, tables, charts and pictures keep their frame; null
sizes count as ASSUMED_PT; a forced break opens a line; a word wider than its line takes as many as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import slides

SLIDE, SHAPE = slides.SLIDE, slides.SHAPE

# Bounds on a letter's advance and a line's height in ems, the size of a run that states none, stored insets.
MAX_ADVANCE_EM, MAX_LINE_EM, ASSUMED_PT = 1.15, 1.5, 54.0
INSET_X_PT, INSET_Y_PT = 7.2, 3.6
SPREAD = ("just", "justLow", "dist", "thaiDist")
FRAMED = ("group", "picture", "table", "chart", "diagram", "frame", "connector")


def advance(said: Column, size: Column, advances: Column | None = None) -> Column:
    """Width of a text in points: letters that `advances` (a map in ems) does not know count as the widest there are."""
    if advances is None:
        return F.length(said) * size * MAX_ADVANCE_EM
    em = lambda c: F.coalesce(F.try_element_at(advances, c), F.lit(MAX_ADVANCE_EM))
    known = F.aggregate(F.filter(F.split(said, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + em(c))
    return size * F.when(advances.isNull(), F.length(said) * MAX_ADVANCE_EM).otherwise(known)


def wrapped_lines(widths: Column, space: Column | float, available: Column | float) -> Column:
    """Lines that words of these widths take, set one after the other while they fit; at least one."""
    space, available = (x if isinstance(x, Column) else F.lit(float(x)) for x in (space, available))
    state = lambda n, x: F.struct(n.cast("long").alias("n"), x.cast("double").alias("x"))

    def step(acc: Column, w: Column) -> Column:
        open_ = acc["x"] > 0
        wide = state(acc["n"] + open_.cast("long") + F.ceil(w / available), F.lit(0.0))
        return F.when(w > available, wide).when(open_ & (acc["x"] + space + w <= available), state(acc["n"], acc["x"] + space + w)).otherwise(state(acc["n"] + 1, w))

    folded = F.aggregate(widths, state(F.lit(0), F.lit(0.0)), step, lambda acc: F.greatest(acc["n"], F.lit(1).cast("long")))
    return F.when(available > 0, folded).otherwise(1)


def _sized(t: dict[str, DataFrame], faces: DataFrame | None) -> DataFrame:
    """Runs of text frames with size, advances and line_em, and `line`: how many forced breaks stand before."""
    scale = t["shapes"].select(*SHAPE, "font_scale")
    size = F.when(F.col("size_pt") > 0, F.col("size_pt")).otherwise(ASSUMED_PT) * F.coalesce("font_scale", F.lit(1.0))
    r = t["runs"].where("row IS NULL").join(scale, SHAPE).withColumn("size", size).withColumn("stated", F.coalesce(F.col("size_pt") > 0, F.lit(False)))
    if faces is None:
        r = r.withColumn("advances", F.lit(None).cast("map<string,double>")).withColumn("line_em", F.lit(None).cast("double"))
    else:
        known = faces.select(F.col("font").alias("face"), F.col("bold").alias("face_bold"), "advances", "line_em")
        r = r.join(known, (F.lower("font") == F.col("face")) & (F.coalesce("bold", F.lit(False)) == F.col("face_bold")), "left")
    par = Window.partitionBy(*SHAPE, "para").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("line", F.sum((F.col("text") == "\n").cast("int")).over(par))


def words(runs: DataFrame) -> DataFrame:
    """SHAPE, para, line, word, width of each word, whatever runs it spans."""
    pieces = F.split("text", r"\s+")
    before = Window.partitionBy(*SHAPE, "para").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    split = runs.withColumn("pieces", pieces).withColumn("first", F.coalesce(F.sum(F.size("pieces") - 1).over(before), F.lit(0)))
    rows = split.select(*SHAPE, "para", "line", "first", "size", "advances", F.posexplode("pieces").alias("at", "piece")).where("piece <> ''")
    return rows.groupBy(*SHAPE, "para", "line", (F.col("first") + F.col("at")).alias("word")).agg(F.sum(advance(F.col("piece"), F.col("size"), F.col("advances"))).alias("width"))


def _known(said: Column, advances: Column) -> Column:
    letters = F.filter(F.split(said, ""), lambda c: (c != "") & (c != "\n"))
    return F.coalesce(F.forall(letters, lambda c: F.map_contains_key(advances, c)), F.lit(False)) | (F.size(letters) == 0)


def laid_out(t: dict[str, DataFrame], faces: DataFrame | None = None) -> DataFrame:
    """SHAPE with the room inside the insets (room_x, room_y), what the text needs of it (ink_x, ink_y), lines, sides (alignments),
    and measured: whether every letter's face was known. Only text frames with text and an area."""
    inset = lambda side, usual: F.coalesce(f"inset_{side}_pt", F.lit(usual))
    room_x = F.col("width_pt") - inset("left", INSET_X_PT) - inset("right", INSET_X_PT)
    room_y = F.col("height_pt") - inset("top", INSET_Y_PT) - inset("bottom", INSET_Y_PT)
    frames = t["shapes"].where("is_leaf AND width_pt > 0 AND height_pt > 0 AND trim(coalesce(text, '')) <> ''").where(~F.col("kind").isin(*FRAMED))
    frames = frames.select(*SHAPE, room_x.alias("room_x"), room_y.alias("room_y"), F.coalesce("wraps", F.lit(True)).alias("wraps"), F.greatest(F.coalesce("text_columns", F.lit(1)), F.lit(1)).alias("columns"), F.coalesce("column_gap_pt", F.lit(0.0)).alias("gap"))
    runs = _sized(t, faces)
    key = [*SHAPE, "para"]
    each = runs.groupBy(*key, "line").agg(
        F.sum(advance(F.col("text"), F.col("size"), F.col("advances"))).alias("whole"),
        F.max(F.col("size") * F.coalesce("line_em", F.lit(MAX_LINE_EM))).alias("height"),
        F.max(F.col("size") * F.coalesce(F.try_element_at("advances", F.lit(" ")), F.lit(MAX_ADVANCE_EM))).alias("space"),
        F.min(F.col("stated") & F.col("line_em").isNotNull() & _known(F.col("text"), F.col("advances"))).alias("measured"),
    )
    set_ = words(runs).groupBy(*key, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "width"))), lambda x: x["width"]).alias("widths"))
    par = t["paragraphs"].where("row IS NULL AND trim(text) <> ''").select(*key, "alignment", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("margin_left_pt", "margin_right_pt", "indent_pt", "spacing_share", "spacing_pt", "space_pt", "space_share")])
    column = F.when(F.col("columns") > 1, F.greatest((F.col("room_x") - (F.col("columns") - 1) * F.col("gap")) / F.col("columns"), F.lit(0.0))).otherwise(F.col("room_x"))
    given = frames.join(par, SHAPE).withColumn("indent", F.col("margin_left_pt") + F.col("margin_right_pt") + F.greatest("indent_pt", F.lit(0.0)))
    given = given.withColumn("available", F.greatest(column - F.col("indent"), F.lit(0.0)))
    # a paragraph is as high a line, and as wide a space, as its largest run
    whole = Window.partitionBy(*key)
    each = each.join(set_, [*key, "line"], "left").withColumn("height", F.max("height").over(whole)).withColumn("space", F.max("space").over(whole))
    lines = given.join(each, key)
    count = F.when(F.col("wraps"), wrapped_lines(F.coalesce("widths", F.array().cast("array<double>")), F.col("space"), F.col("available"))).otherwise(1)
    needs = F.col("whole") + F.col("indent")
    wide = F.when(~F.col("wraps"), needs).when(F.col("columns") > 1, F.col("room_x")).otherwise(F.least(needs, F.col("room_x")))
    height = F.greatest(F.col("height"), F.col("height") * F.col("spacing_share"), F.col("spacing_pt"))
    once = F.when(F.col("line") == 0, F.col("space_pt") + F.col("space_share") * F.col("height")).otherwise(0.0)
    lines = lines.withColumn("n", count).withColumn("high", F.col("n") * height + once).withColumn("wide", wide)
    return lines.groupBy(*SHAPE).agg(F.first("room_x").alias("room_x"), F.first("room_y").alias("room_y"), F.max("wide").alias("ink_x"), F.sum("high").alias("ink_y"), F.sum("n").alias("lines"), F.collect_set(F.coalesce("alignment", F.lit("l"))).alias("sides"), F.min("measured").alias("measured"))


def ink_boxes(t: dict[str, DataFrame], faces: DataFrame | None = None) -> DataFrame:
    """For each leaf with an area: left, top, width, height of its ink, narrowed_x, narrowed_y, and measured.

    Where a bound reaches the frame, the frame stands on that axis. Frames are those of the file, without the insets; a
    turned shape's is the box around it as turned.
    """
    own = ~F.coalesce("painted", F.lit(False)) & F.col("fill_hex").isNull() & F.col("line_hex").isNull() & (F.coalesce("rotation", F.lit(0.0)) == 0)
    s = slides.leaves(t).where("width_pt > 0 AND height_pt > 0").join(laid_out(t, faces), SHAPE, "left").withColumn("own", own & F.col("ink_x").isNotNull() & (F.col("room_x") > 0) & (F.col("room_y") > 0))
    thin_x, thin_y = (F.coalesce(F.col("own") & (F.col(f"ink_{a}") < F.col(f"room_{a}")), F.lit(False)) for a in "xy")
    one_side = (F.size("sides") == 1) & ~F.arrays_overlap("sides", F.array(*map(F.lit, SPREAD)))
    s = s.withColumn("tight_x", thin_x).withColumn("tight_y", thin_y).withColumn("side", F.when(one_side, F.element_at("sides", 1)))
    inner = F.col("tight_x") | F.col("tight_y")
    in_left, in_top = F.col("left_pt") + F.coalesce("inset_left_pt", F.lit(INSET_X_PT)), F.col("top_pt") + F.coalesce("inset_top_pt", F.lit(INSET_Y_PT))
    placed = F.col("tight_x") & F.col("side").isNotNull()
    spare_x, spare_y = F.col("room_x") - F.col("ink_x"), F.col("room_y") - F.col("ink_y")
    left = in_left + F.when(placed & (F.col("side") == "ctr"), spare_x / 2).when(placed & (F.col("side") == "r"), spare_x).otherwise(0.0)
    top = in_top + F.when(F.col("tight_y") & (F.col("anchor") == "ctr"), spare_y / 2).when(F.col("tight_y") & (F.col("anchor") == "b"), spare_y).otherwise(0.0)
    turn = F.radians(F.coalesce("rotation", F.lit(0.0)))
    around = lambda a, b: F.abs(F.col(a) * F.cos(turn)) + F.abs(F.col(b) * F.sin(turn))
    full_w, full_h = around("width_pt", "height_pt"), around("height_pt", "width_pt")
    frame = {"left": F.col("left_pt") + (F.col("width_pt") - full_w) / 2, "top": F.col("top_pt") + (F.col("height_pt") - full_h) / 2, "width": full_w, "height": full_h}
    ink = {"left": left, "top": top, "width": F.when(placed, F.col("ink_x")).otherwise(F.col("room_x")), "height": F.when(F.col("tight_y"), F.col("ink_y")).otherwise(F.col("room_y"))}
    boxes = [F.when(inner, ink[c]).otherwise(frame[c]).alias(c) for c in ("left", "top", "width", "height")]
    return s.select(*SHAPE, *boxes, F.col("tight_x").alias("narrowed_x"), F.col("tight_y").alias("narrowed_y"), F.coalesce(F.when(F.col("own"), F.col("measured")), F.lit(True)).alias("measured"))


def overflowing(t: dict[str, DataFrame], faces: DataFrame | None = None, within: float = 0.5) -> DataFrame:
    """SHAPE, lines, ink_y, room_y and state of each text frame: `over` where measured text is higher than the room inside the
    insets by more than `within` points, `unmeasured` where a face or size is not known, `no room`, else `fits`."""
    state = F.when((F.col("room_x") <= 0) | (F.col("room_y") <= 0), "no room").when(~F.col("measured"), "unmeasured").when(F.col("ink_y") - F.col("room_y") > within, "over").otherwise("fits")
    return laid_out(t, faces).select(*SHAPE, "lines", "ink_y", "room_y", state.alias("state"))
