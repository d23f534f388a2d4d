"""Single linkage: boxes that sit together, connected components, and marks drawn from several shapes.

Boxes meet by an equi-join on the cells of a grid, so only neighbours are compared; a pair that shares several cells
counts in the first of them alone. Components are found by taking the least label among neighbours and following labels
of labels, which halves the way at each step; every step is a written table. At most LOCAL nodes are one task's bounded work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import cells, slides
from tallyframe.storage import release, written

SLIDE, SHAPE = slides.SLIDE, slides.SHAPE
SIDES = ("left_pt", "top_pt", "width_pt", "height_pt")

# Reach of a piece in its own heights, size and slack of a plate behind a text, how near a logo's usual place a variant stands.
GAP_HEIGHTS, PLATE_RATIO, PLATE_PT, SLOT_PT = 1.0, 4.0, 2.0, 2.0
CELL_PT = 72.0
# Parts of a cell on each axis, and the most nodes that one task joins.
PARTS, LOCAL = 4, 1 << 17


def _cells(df: DataFrame, reach: Column) -> DataFrame:
    """df with the grid cells (cx, cy) that its box, grown by reach, touches, and the first of them."""
    low = lambda at: F.floor((F.col(at) - reach) / CELL_PT).cast("int")
    high = lambda at, size: F.floor((F.col(at) + F.col(size) + reach) / CELL_PT).cast("int")
    spread = df.withColumn("x0", low("left_pt")).withColumn("y0", low("top_pt")).withColumn("x1", high("left_pt", "width_pt")).withColumn("y1", high("top_pt", "height_pt"))
    return spread.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))


def sits_with(boxes: DataFrame, keys: list[str], id_: str, gap_heights: float = GAP_HEIGHTS) -> DataFrame:
    """keys, a, b of the boxes (keys, id_, left_pt, top_pt, width_pt, height_pt) of one key whose gaps on both axes are at most
    gap_heights times the taller one's height. The taller box (ties: the smaller id) reaches out to the other."""
    b = boxes.select(*keys, F.col(id_).alias("id"), *SIDES).where("width_pt IS NOT NULL AND left_pt IS NOT NULL AND height_pt IS NOT NULL AND top_pt IS NOT NULL")
    reach, none = F.col("height_pt") * gap_heights, F.lit(0.0)
    tall, other = _cells(b, reach).alias("t"), _cells(b, none).alias("o")
    same = (F.col("t.cx") == F.col("o.cx")) & (F.col("t.cy") == F.col("o.cy"))
    for k in keys:
        same &= F.col(f"t.{k}") == F.col(f"o.{k}")
    first = (F.col("t.cx") == F.greatest("t.x0", "o.x0")) & (F.col("t.cy") == F.greatest("t.y0", "o.y0"))
    reaching = (F.col("t.height_pt") > F.col("o.height_pt")) | ((F.col("t.height_pt") == F.col("o.height_pt")) & (F.col("t.id") < F.col("o.id")))
    far = F.col("t.height_pt") * gap_heights
    apart = lambda at, size: F.greatest(F.col(f"t.{at}") - F.col(f"o.{at}") - F.col(f"o.{size}"), F.col(f"o.{at}") - F.col(f"t.{at}") - F.col(f"t.{size}"))
    near = (apart("left_pt", "width_pt") <= far) & (apart("top_pt", "height_pt") <= far)
    return tall.join(other, same & first & reaching & near).select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.id").alias("a"), F.col("o.id").alias("b"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keys, id, label of the nodes of all edges (keys, a, b)."""
    up: dict[tuple, tuple] = {}

    def top(node: tuple) -> tuple:
        while (above := up.setdefault(node, node)) != node:
            up[node] = node = up[above]
        return node

    names = kinds = None
    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types[:-1]
        for *key, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x, y = top((*key, a)), top((*key, b))
            up[max(x, y)] = min(x, y)
    if up:
        rows = [(*node, top(node)[-1]) for node in up]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, kinds[-1]], strict=True)], names=[*names[:-2], "id", "label"])


def components(nodes: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, label: label is the smallest id that pairs (keys, a, b) tie to a node (keys, id); a lone node is its own."""
    both = pairs.select(*keys, "a", "b").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "pairs")
    if edges.select(*keys, "a").distinct().count() <= LOCAL:
        kinds = edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("label")).schema
        # first what each slice ties, a row for each of its nodes
        least = written(edges.where("a > b").mapInArrow(_united, kinds).repartition(1).mapInArrow(_united, kinds), "united")
        release(edges)
        return nodes.select(*keys, "id").distinct().join(least, [*keys, "id"], "left").withColumn("label", F.coalesce("label", "id"))
    labels = written(nodes.select(*keys, "id").distinct().withColumn("label", F.col("id")).withColumn("moved", F.lit(True)), "labels")
    while True:
        given = labels.select(*keys, F.col("id").alias("b"), F.col("label").alias("offered"))
        least = edges.join(given, [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("offered").alias("offered"))
        met = labels.join(least, [*keys, "id"], "left").select(*keys, "id", "label", F.least("label", F.coalesce("offered", "label")).alias("next"))
        met = written(met, "labels")
        onward = met.select(*keys, F.col("id").alias("next"), F.col("next").alias("further"))
        jumped = met.join(onward, [*keys, "next"], "left").select(*keys, "id", F.least("next", F.coalesce("further", "next")).alias("label"), (F.least("next", F.coalesce("further", "next")) < F.col("label")).alias("moved"))
        last, labels = labels, written(jumped, "labels")
        release(last, met)
        if labels.where("moved").isEmpty():
            release(edges)
            return labels.select(*keys, "id", "label")


def _near(p: str, q: str, gap_heights: float) -> Column:
    """What sits_with asks of two boxes."""
    c = F.col
    apart = lambda at, size: F.greatest(c(f"{p}.{at}") - c(f"{q}.{at}") - c(f"{q}.{size}"), c(f"{q}.{at}") - c(f"{p}.{at}") - c(f"{p}.{size}"))
    far = F.greatest(c(f"{p}.height_pt"), c(f"{q}.height_pt")) * gap_heights
    return (apart("left_pt", "width_pt") <= far) & (apart("top_pt", "height_pt") <= far)


def tied(boxes: DataFrame, keys: list[str], id_: str, gap_heights: float = GAP_HEIGHTS) -> DataFrame:
    """keys, id, SIDES, tie of the boxes: those of one key that single linkage ties together, and no others, have the same tie.

    Two boxes that sit together touch a common cell. The tallest of the boxes that begin in one part of a cell is their hub: each
    box is held against its hub, and hubs against hubs, of which a cell has few however crowded it is. Then all that is still
    apart is compared, in cells that hold several ties: the boxes outside the cell's main tie with all others. Groups that
    share a crowded cell and stay apart do cost all their pairs.
    """
    b = boxes.select(*keys, F.col(id_).alias("id"), *SIDES)
    for k in (*keys, "id"):
        b = b.where(F.col(k).isNotNull())
    reach, placed = F.col("height_pt") * gap_heights, (F.col("left_pt") + F.col("top_pt") + F.col("width_pt") + F.col("height_pt")).isNotNull()
    ends = lambda at, size: (F.col(at), F.col(at) + F.col(size), F.col(at) - reach, F.col(at) + F.col(size) + reach)
    axes = ends("left_pt", "width_pt"), ends("top_pt", "height_pt")
    b = cells.spanned(b, keys, *[F.when(placed, end(*axis)) for axis in axes for end in (F.least, F.greatest)])
    cell, part = [*keys, "cx", "cy"], [*keys, "px", "py"]
    dealt = b.withColumn("px", F.floor(F.col("left_pt") / F.col("cell_w") * PARTS)).withColumn("py", F.floor(F.col("top_pt") / F.col("cell_h") * PARTS))
    hubs = dealt.where("x0 IS NOT NULL").groupBy(*part).agg(F.max(F.struct("height_pt", "width_pt", "id", "left_pt", "top_pt", *cells.SPAN)).alias("hub")).select(*part, "hub.*")
    hubs = written(hubs, "hubs")
    held = dealt.alias("b").join(hubs.select(*part, F.col("id").alias("hub"), *SIDES).alias("h"), part, "left")
    node = F.when(_near("b", "h", gap_heights), F.col("hub")).otherwise(F.col("b.id"))
    held = written(held.select(*[F.col(f"b.{c}").alias(c) for c in b.columns], node.alias("node"), F.col("b.id").eqNullSafe(F.col("hub")).alias("is_hub")), "held")
    there = cells.touched(hubs.select(*keys, "id", *SIDES, *cells.SPAN))
    # a pair that shares several cells counts in the first of them alone
    first = (F.col("m.cx") == F.greatest("m.x0", "f.x0")) & (F.col("m.cy") == F.greatest("m.y0", "f.y0"))
    links = cells.met(there, there, cell, first & (F.col("m.id") < F.col("f.id")) & _near("m", "f", gap_heights))
    links = links.select(*[F.col(f"m.{k}") for k in keys], F.col("m.id").alias("a"), F.col("f.id").alias("b"))
    # rows of one id are one node
    several = held.groupBy(*keys, "id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    links = links.unionByName(held.join(several, [*keys, "id"]).where("node <> a").select(*keys, "a", F.col("node").alias("b")))
    label = components(held.select(*keys, F.col("node").alias("id")), links, keys).withColumnRenamed("id", "node")
    known = written(held.join(label, [*keys, "node"]).select(*b.columns, "is_hub", F.col("label").alias("tie")), "tied")
    release(hubs, held, b)
    # what is still apart
    sizes = cells.touched(known).groupBy(*cell, "tie").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_hub").alias("hubs"))
    mixed = sizes.groupBy(*cell).agg(F.count(F.lit(1)).alias("ties"), F.bool_and("hubs").alias("hubs"), F.max_by("tie", "n").alias("main")).where("ties > 1 AND NOT hubs")
    mixed = written(mixed.select(*cell, "main"), "mixed")
    if mixed.isEmpty():
        release(mixed)
        return known.select(*keys, "id", *SIDES, "tie")
    apart = cells.touched(known).join(mixed, cell).select(*cell, *SIDES, "is_hub", "tie", "main")
    one, other = F.col("m.tie"), F.col("f.tie")
    across = cells.met(apart.drop("main"), apart.where("tie <> main").drop("main"), cell, (one != other) & ~(F.col("m.is_hub") & F.col("f.is_hub")) & _near("m", "f", gap_heights))
    across = written(across.select(*[F.col(f"m.{k}") for k in keys], F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct(), "across")
    release(mixed)
    last = components(known.select(*keys, F.col("tie").alias("id")), across, keys).select(*keys, F.col("id").alias("tie"), "label")
    release(across)
    return known.join(last, [*keys, "tie"]).select(*keys, "id", *SIDES, F.col("label").alias("tie"))


def groups(boxes: DataFrame, keys: list[str], id_: str, gap_heights: float = GAP_HEIGHTS) -> DataFrame:
    """keys, label (the smallest id), members and the box around each group of boxes that single linkage ties together."""
    right, bottom = F.max(F.col("left_pt") + F.col("width_pt")), F.max(F.col("top_pt") + F.col("height_pt"))
    box = tied(boxes, keys, id_, gap_heights).groupBy(*keys, "tie").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("members"), F.min("left_pt").alias("left_pt"), F.min("top_pt").alias("top_pt"), right.alias("right"), bottom.alias("bottom"))
    return box.select(*keys, "label", "members", "left_pt", "top_pt", (F.col("right") - F.col("left_pt")).alias("width_pt"), (F.col("bottom") - F.col("top_pt")).alias("height_pt"))


# ------------------------------------------------------------------------------------------------------------ drawn marks


def _line(said: Column) -> Column:
    return F.lower(text.strip(F.regexp_replace(said, r"\s+", " ")))


def plates(t: dict[str, DataFrame], held: DataFrame) -> DataFrame:
    """Drawn shapes that stand behind one of the texts `held` (SHAPE) and are of its order of size: the badge of a mark.

    A shape's slide holds few of both, so they meet by slide.
    """
    placed = slides.leaves(t).where("width_pt > 0 AND height_pt > 0")
    bare = placed.where("trim(coalesce(text, '')) = '' AND image_sha1 IS NULL AND kind NOT IN ('picture', 'table', 'chart')").select(*SHAPE, *SIDES).alias("p")
    inner = placed.join(held.select(*SHAPE), SHAPE, "left_semi").select(*SHAPE, *SIDES).alias("h")
    c = F.col
    inside = (c("p.left_pt") <= c("h.left_pt") + PLATE_PT) & (c("p.top_pt") <= c("h.top_pt") + PLATE_PT)
    for at, size in (("left_pt", "width_pt"), ("top_pt", "height_pt")):
        inside &= c(f"p.{at}") + c(f"p.{size}") >= c(f"h.{at}") + c(f"h.{size}") - PLATE_PT
    small = c("p.width_pt") * c("p.height_pt") <= PLATE_RATIO * c("h.width_pt") * c("h.height_pt")
    on = (c("p.deck_id") == c("h.deck_id")) & (c("p.slide_index") == c("h.slide_index")) & inside & small
    return bare.join(inner, on, "left_semi").select(*SHAPE)


def _pieces(t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
    """SHAPE, box, line (null for plates): the texts that `lines` (deck_id, line) lists, and the plates behind them."""
    said = slides.leaves(t).where("width_pt > 0 AND height_pt > 0 AND trim(coalesce(text, '')) <> ''").withColumn("line", _line(F.col("text")))
    known = said.join(lines.select("deck_id", "line").distinct(), ["deck_id", "line"]).select(*SHAPE, *SIDES, "line")
    behind = slides.leaves(t).join(plates(t, known), SHAPE, "left_semi").select(*SHAPE, *SIDES, F.lit(None).cast("string").alias("line"))
    return written(known.unionByName(behind), "pieces")


def lockup_lines(t: dict[str, DataFrame], repeated: DataFrame) -> DataFrame:
    """deck_id, line: those of the repeated lines (deck_id, line) that belong to a drawn mark, as they sit with a plate.

    A line without a plate near it is no mark: nothing tells it from a footer.
    """
    pieces = _pieces(t, repeated)
    tied = pieces.join(components(pieces.select(*SLIDE, F.col("uid").alias("id")), sits_with(pieces, SLIDE, "uid"), SLIDE).withColumnRenamed("id", "uid"), SHAPE)
    badged = tied.where("line IS NULL").select(*SLIDE, "label").distinct()
    return tied.where("line IS NOT NULL").join(badged, [*SLIDE, "label"], "left_semi").select("deck_id", "line").distinct()


def logo_marks(t: dict[str, DataFrame], images: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """SHAPE, box and drawn of every logo: pictures by hash (deck_id, image_sha1), and drawn marks by their lines (deck_id, line).

    A drawn mark is the box around the pieces that sit together, told by its first piece; a slide may carry it twice.
    """
    out = None
    if images is not None:
        out = t["shapes"].join(images.select("deck_id", "image_sha1").distinct(), ["deck_id", "image_sha1"], "left_semi").select(*SHAPE, *SIDES, F.lit(False).alias("drawn"))
    if lines is not None:
        drawn = groups(_pieces(t, lines), SLIDE, "uid").select(*SLIDE, F.col("label").alias("uid"), *SIDES, F.lit(True).alias("drawn"))
        out = drawn if out is None else out.unionByName(drawn)
    return out


def logo_variants(t: dict[str, DataFrame], images: DataFrame, within: float = SLOT_PT) -> DataFrame:
    """deck_id, image_sha1 of pictures that stand, in place and size, where a known logo stands on another slide."""
    shown = t["shapes"].where("image_sha1 IS NOT NULL AND left_pt IS NOT NULL")
    known = images.select("deck_id", "image_sha1").distinct()
    # a box is found in the cell of its corner or in one beside it
    corner = lambda at: F.floor(F.col(at) / (2 * within)).cast("int")
    slots = shown.join(known, ["deck_id", "image_sha1"], "left_semi").select("deck_id", *SIDES, corner("left_pt").alias("cx"), corner("top_pt").alias("cy")).distinct().alias("s")
    others = shown.join(known, ["deck_id", "image_sha1"], "left_anti").select("deck_id", "image_sha1", *SIDES)
    beside = lambda at: F.explode(F.sequence(corner(at) - 1, corner(at) + 1))
    others = others.withColumn("cx", beside("left_pt")).withColumn("cy", beside("top_pt")).alias("o")
    on = (F.col("s.deck_id") == F.col("o.deck_id")) & (F.col("s.cx") == F.col("o.cx")) & (F.col("s.cy") == F.col("o.cy"))
    for c in SIDES:
        on &= F.abs(F.col(f"s.{c}") - F.col(f"o.{c}")) <= within
    return others.join(slots, on, "left_semi").select("deck_id", "image_sha1").distinct()
