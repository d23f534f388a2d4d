"""Why a shape stands where it does: evidence from the deck that a position is meant, gathered once for the layout rules.

Every piece of evidence is a row (deck_id, slide_index, uid, axis, evidence); an axis of `both` settles x and y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import slides, stats

SLIDE, SHAPE = slides.SLIDE, slides.SHAPE

# How much of a decoration lies on and off the canvas; shapes that make a line or a run; slides that make a habit.
ON_CANVAS, OFF_CANVAS, SHARED, RUN, HABIT = 0.15, 0.02, 3, 3, 3
SERIES, SERIES_PT, SERIES_SHARE = 3, 0.5, 0.5  # shapes that make a series, agreement in thickness, most thickness on the canvas
LEADS = {"x": ("left_pt", "width_pt", "top_pt"), "y": ("top_pt", "height_pt", "left_pt")}


def decorations(t: dict[str, DataFrame]) -> DataFrame:
    """Shapes without text, in the back half of their slide, that lie partly on and partly off the canvas."""
    deck = t["decks"].select("deck_id", F.col("width_pt").alias("w"), F.col("height_pt").alias("h"))
    back = F.row_number().over(Window.partitionBy(*SLIDE).orderBy("z_order", "uid")) <= F.count(F.lit(1)).over(Window.partitionBy(*SLIDE)) / 2
    s = slides.leaves(t).withColumn("back", back).where("back AND width_pt > 0 AND height_pt > 0 AND trim(coalesce(text, '')) = ''").join(deck, "deck_id")
    inside = lambda at, size, edge: F.greatest(F.lit(0.0), F.least(F.col(at) + F.col(size), F.col(edge)) - F.greatest(F.col(at), F.lit(0.0)))
    share = inside("left_pt", "width_pt", "w") * inside("top_pt", "height_pt", "h") / (F.col("width_pt") * F.col("height_pt"))
    return s.withColumn("share", share).where((F.col("share") >= ON_CANVAS) & (1 - F.col("share") >= OFF_CANVAS)).select(*SHAPE)


def rows_of_equals(t: dict[str, DataFrame], axis: str, within: float) -> DataFrame:
    """Shapes in rows (axis x) or columns (y) of siblings of one kind and size, with the gap to the next one in `gap`."""
    lead, length, across = LEADS[axis]
    key = [*SLIDE, "parent", "kind", "w", "h"]
    s = slides.content_shapes(t).withColumn("one", F.lit(1)).withColumn("parent", F.coalesce("parent_uid", F.lit(-1))).withColumn("w", F.round("width_pt")).withColumn("h", F.round("height_pt"))
    lines = stats.cluster_1d(s, key, across, "one", within).select(*key, F.col("value").alias(across), "cluster")
    met = gaps(s.join(lines, [*key, across]), [*key, "cluster"], lead, length).withColumn("line", F.concat_ws("|", F.lit(axis), "parent", "kind", "w", "h", "cluster"))
    return met.select(*SHAPE, "line", "gap")


def gaps(boxes: DataFrame, line: list[str], lead: str, length: str) -> DataFrame:
    """boxes with `gap`, the distance from a box's end to the start of the next one of its line; null behind the last."""
    behind = F.lead(lead).over(Window.partitionBy(*line).orderBy(lead, "uid"))
    return boxes.withColumn("gap", behind - F.col(lead) - F.col(length))


def spreads(gapped: DataFrame, line: list[str], within: float) -> DataFrame:
    """line, n, spread, uid of lines of three or more boxes that do not overlap by more than `within`; spread is the sample
    deviation of the gaps, uid the least."""
    g = gapped.groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.stddev_samp("gap").alias("spread"), F.min("uid").alias("uid"))
    return g.where((F.col("n") >= RUN) & (F.col("least") >= -within)).drop("least")


def runs(t: dict[str, DataFrame], axis: str, within: float) -> DataFrame:
    """deck_id, slide_index, line, n, spread, uid of rows of three or more that do not overlap; spread is that of the gaps."""
    return spreads(rows_of_equals(t, axis, within), [*SLIDE, "line"], within)


def spaced(t: dict[str, DataFrame], within: float, limit: float) -> DataFrame:
    """Members of evenly spaced rows and columns: their run's pitch places them on its axis."""
    out = None
    for axis in LEADS:
        even = runs(t, axis, within).where(F.col("spread") <= limit).select(*SLIDE, "line")
        part = rows_of_equals(t, axis, within).join(even, [*SLIDE, "line"]).select(*SHAPE, F.lit(axis).alias("axis"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def distances(lines: dict[str, list]) -> Column:
    """How far the row's edge (axis, at) is from each line of its axis; lines: {"x": columns, "y": rows}."""
    of = lambda axis: F.array(*[F.abs(F.col("at") - float(x)) for x in lines.get(axis) or ()]).cast("array<double>")
    return F.when(F.col("axis") == "x", of("x")).otherwise(of("y"))


def aligned(t: dict[str, DataFrame], lines: dict[str, list], within: float) -> DataFrame:
    """Shapes with an edge on a line of the grid, or on one that three edges of their slide share."""
    e = slides.edges(t).join(slides.content_shapes(t).select(*SHAPE), SHAPE, "left_semi").withColumn("one", F.lit(1))
    on_grid = e.where(F.coalesce(F.array_min(distances(lines)) <= within, F.lit(False))).select(*SHAPE, "axis")
    key = [*SLIDE, "axis"]
    members = stats.cluster_1d(e, key, "at", "one", within)
    shared = members.withColumn("support", F.sum("weight").over(Window.partitionBy(*key, "cluster"))).where(F.col("support") >= SHARED).select(*key, F.col("value").alias("at")).distinct()
    return on_grid.unionByName(e.join(shared, [*key, "at"]).select(*SHAPE, "axis")).distinct()


def _clustered(df: DataFrame, keys: list[str], value: str, within: float, name: str) -> DataFrame:
    """df with the cluster of a value within its keys, as `name`, how many rows it holds, and its mean.

    The keys hold a slide, so its shapes are folded as one sorted list; no join of the table with itself is planned.
    """
    rest = [c for c in df.columns if c not in keys]
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.struct(*rest).alias("row")))).alias("items"))
    first = lambda x: F.struct(F.lit(1).cast("long").alias("n"), x["v"].alias("sum"), F.array(x["v"]).alias("opens"))

    def step(acc: Column, x: Column) -> Column:
        joins = F.abs(x["v"] - acc["sum"] / acc["n"]) <= within
        grown = F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + x["v"]).alias("sum"), acc["opens"].alias("opens"))
        opened = F.struct(F.lit(1).cast("long").alias("n"), x["v"].alias("sum"), F.array_append(acc["opens"], x["v"]).alias("opens"))
        # equal values are never parted
        return F.when(joins | (x["v"] == F.element_at(acc["opens"], -1)), grown).otherwise(opened)

    opens = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), first(F.element_at("items", 1)), step, lambda acc: acc["opens"])
    number = lambda v: F.size(F.filter("opens", lambda o: o <= v))
    rows = items.withColumn("opens", opens).select(*keys, "opens", F.explode("items").alias("i")).select(*keys, "i.row.*", number(F.col("i.v")).alias(name))
    whole = Window.partitionBy(*keys, name)
    return rows.withColumn(f"{name}_held", F.count(F.lit(1)).over(whole)).withColumn(f"{name}_centre", F.avg(value).over(whole))


def data_marks(t: dict[str, DataFrame], within: float) -> DataFrame:
    """SHAPE, axis of shapes whose place or length is a value: hand-drawn bars and points.

    Of a slide's shapes of one thickness, those that share their leading edge with two others are laid out; what remains,
    three at least, is plotted if its lengths differ (bars) or if no three of it share an edge on either axis (points).
    Shapes as thick as half the canvas are panels.
    """
    deck = t["decks"].select("deck_id", F.col("width_pt").alias("canvas_w"), F.col("height_pt").alias("canvas_h"))
    shapes_ = slides.content_shapes(t).join(decorations(t), SHAPE, "left_anti").join(deck, "deck_id").select(*SHAPE, "left_pt", "top_pt", "width_pt", "height_pt", "canvas_w", "canvas_h")
    out = None
    for axis, (lead, length, _) in LEADS.items():
        thick, canvas = ("height_pt", "canvas_h") if axis == "x" else ("width_pt", "canvas_w")
        sized = _clustered(shapes_, SLIDE, thick, SERIES_PT, "series").where((F.col("series_held") >= SERIES) & (F.col("series_centre") < F.col(canvas) * SERIES_SHARE))
        key = [*SLIDE, "series"]
        loose = _clustered(sized, key, lead, within, "edge").where(F.col("edge_held") < SERIES).drop("edge", "edge_held", "edge_centre")
        for c, name in (("left_pt", "at_x"), ("top_pt", "at_y"), (length, "long")):
            loose = _clustered(loose, key, c, within, name)
        whole = Window.partitionBy(*key)
        varied = F.max("long").over(whole) > F.min("long").over(whole)
        scattered = (F.max("at_x_held").over(whole) < SERIES) & (F.max("at_y_held").over(whole) < SERIES)
        part = loose.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("plotted", varied | scattered).where((F.col("n") >= SERIES) & F.col("plotted")).select(*SHAPE, F.lit(axis).alias("axis"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def settled(t: dict[str, DataFrame]) -> DataFrame:
    """Evidence that settles both axes and needs no profile: furniture, decorative, repeated."""
    as_ = lambda df, name: df.select(*SHAPE, F.lit("both").alias("axis"), F.lit(name).alias("evidence"))
    return as_(slides.furniture(t), "furniture").unionByName(as_(decorations(t), "decorative")).unionByName(as_(slides.repeated_boxes(t, HABIT), "repeated"))


def evidence(t: dict[str, DataFrame], lines: dict[str, list] | None = None, within: float = 0.5, position: float = 2.0, gutter: float = 1.0) -> DataFrame:
    """All evidence for the shapes of all decks: what `settled` finds, and by axis `spaced`, `aligned` and `data_mark`."""
    out = settled(t)
    for df, name in ((spaced(t, position, gutter), "spaced"), (aligned(t, lines or {}, within), "aligned"), (data_marks(t, within), "data_mark")):
        out = out.unionByName(df.select(*SHAPE, "axis", F.lit(name).alias("evidence")))
    return out
