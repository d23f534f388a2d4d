"""Joins of the consistency checks: nearest lines, rectangles, tiers, wildcards, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.geometry import overlap_area
from tallyframe.operators import cells
from tallyframe.storage import written


def nearest(df: DataFrame, keys: list[str], lines: DataFrame, value: str, line: str, low: float, high: float) -> DataFrame:
    """Rows of df whose value misses its nearest line by low to high, with that line; ambiguous rows are left out.

    Lines are binned by `high`, so this is an equi-join of each value with three bins and never compares all pairs.
    """
    bins = lines.select(*keys, F.col(line).alias("line"), F.explode(F.array(*[F.floor(F.col(line) / high) + k for k in (-1, 0, 1)])).alias("__bin"))
    near = df.withColumn("__bin", F.floor(F.col(value) / high)).join(bins, [*keys, "__bin"]).withColumn("delta", F.abs(F.col(value) - F.col("line"))).where(F.col("delta") <= high)
    return near


def rect_overlaps(boxes: DataFrame, group: list[str], id_: str, share: float) -> DataFrame:
    """Pairs of boxes (left, top, width, height) of a group whose common area is over a share (0 or more) of the smaller one.

    A pair meets in one cell of a grid: in the column where the box further right begins (of equal ones that of the larger
    id), in the first row that both touch.
    """
    sides = [F.col(c) for c in ("left", "top", "width", "height")]
    left, top, width, height = sides
    some = boxes.select(*group, id_, *sides).where((width > 0) & (height > 0) & ~F.isnan(left) & ~F.isnan(top))
    some = cells.spanned(some, group, left, left + width, top, top + height, columns=2).drop("cell_w", "cell_h")
    rows = some.withColumn("cy", F.explode(F.sequence("y0", "y1")))
    first, later = (rows.withColumn("cx", c).drop("x0", "x1", "y1") for c in (F.explode(F.sequence("x0", "x1")), F.col("x0")))
    m, f = F.col(f"m.{id_}"), F.col(f"f.{id_}")
    behind = (F.col("m.left") < F.col("f.left")) & (m != f) | (F.col("m.left") == F.col("f.left")) & (m < f)
    # The residual names both axes, so boxes that are apart leave the join at once.
    on = (F.col("f.cy") == F.greatest("m.y0", "f.y0")) & behind & (F.col("f.left") < F.col("m.left") + F.col("m.width"))
    on &= (F.col("m.top") < F.col("f.top") + F.col("f.height")) & (F.col("f.top") < F.col("m.top") + F.col("m.height"))
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("left", "top", "width", "height"))
    area = overlap_area(box("m"), box("f"))
    smaller = F.least(F.col("m.width") * F.col("m.height"), F.col("f.width") * F.col("f.height"))
    pairs = cells.met(first, later, [*group, "cx", "cy"], on).withColumn("__area", area).withColumn("__smaller", smaller)
    return pairs.where((F.col("__smaller") > 0) & (F.col("__area") / F.col("__smaller") > share)).select(*[F.col(f"m.{g}") for g in group], F.least(m, f).alias("one"), F.greatest(m, f).alias("other"), F.col("__area").alias("area"))


def tiered_lookup(probes: DataFrame, candidates: DataFrame, on: Column, tier: Column, probe_id: str, value: str) -> DataFrame:
    """For each probe the one value of its nearest non-empty tier, or a reason.

    probe_id, value, reason: `none` without candidates, `several` where the tier holds different values.
    """
    met = probes.alias("p").join(candidates.alias("c"), on, "left").select("p.*", F.col(f"c.{value}").alias("__value"), tier.alias("__tier"))
    first = F.min(F.when(F.col("__value").isNotNull(), F.col("__tier"))).over(Window.partitionBy(probe_id))
    near = met.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("__tier") == F.col("__first")))
    grouped = near.groupBy(probe_id).agg(F.count_distinct(F.round("__value", 6)).alias("n"), F.min("__value").alias("v"))
    return grouped.select(probe_id, F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several").alias("reason"))


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings that no suppression covers: the rule equal, slide and shape equal or null in the suppression."""
    f, s = findings.alias("f"), suppressions.alias("s")
    on = (F.col("f.rule") == F.col("s.rule")) & (F.col("s.slide").isNull() | (F.col("s.slide") == F.col("f.slide"))) & (F.coalesce(F.col("s.shape"), F.lit("")).isin("") | (F.col("s.shape") == F.col("f.shape")))
    return f.join(s, on, "left_anti")


def fully_declared(lines: DataFrame, declared: DataFrame, finding: str, line: str) -> DataFrame:
    """Relational division: findings all of whose lines are declared."""
    known = declared.select(F.col(line)).distinct().withColumn("__known", F.lit(1))
    return lines.select(finding, line).distinct().join(known, line, "left").groupBy(finding).agg(F.count(F.lit(1)).alias("n"), F.count("__known").alias("k")).where("n = k").select(finding)


def positional_differences(one: DataFrame, other: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Positions present on both sides whose values differ; two nulls agree, a null and a value do not."""
    a, b = F.col("a." + value), F.col("b." + value)
    differ = (a.isNull() != b.isNull()) | (F.abs(a - b) > tolerance)
    return one.alias("a").join(other.alias("b"), keys).where(differ).select(*keys, a.alias("one"), b.alias("other"))


def modal_currency(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the currency most often stated for their keys (ties: first by name), and rows that state none."""
    counted = df.where("currency IS NOT NULL").groupBy(*keys, "currency").count()
    modal = counted.groupBy(*keys).agg(F.min_by("currency", F.struct(-F.col("count"), F.col("currency"))).alias("modal"))
    return df.join(modal, keys, "left").where("modal IS NULL OR currency IS NULL OR currency = modal")


def first_by_precedence(*sources: tuple[str, Column]) -> Column:
    """struct(value, source): the first value that is not null, and where it came from."""
    value = F.coalesce(*[c for _, c in sources])
    label = F.when(F.lit(False), "")
    for name, c in sources:
        label = label.when(c.isNotNull(), name)
    return F.struct(value.alias("value"), label.alias("source"))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns where all keys are equal; a null key equals a null key."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def last_before(probes: DataFrame, events: DataFrame, keys: list[str], position: str, event: str) -> DataFrame:
    """probes with `event`: the greatest event (any type that sorts) of equal keys whose position is not behind the probe's.

    One window over both sides, so no pair is formed however many events precede. Rows with a null key or position meet
    nothing; probes without an event are left out.
    """
    whole = F.struct(*[F.col(c) for c in probes.columns])
    left = probes.select(*keys, position, whole.alias("__probe"))
    kinds = left.schema["__probe"].dataType, events.schema[event].dataType
    both = events.select(*keys, position, F.lit(None).cast(kinds[0]).alias("__probe"), event).unionByName(left.withColumn(event, F.lit(None).cast(kinds[1])))
    for c in (*keys, position):
        both = both.where(F.col(c).isNotNull())
    before = Window.partitionBy(*keys).orderBy(position).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(event, F.max(event).over(before)).where(F.col("__probe").isNotNull() & F.col(event).isNotNull()).select("__probe.*", event)


def nearest_above(boxes: DataFrame, captions: DataFrame, keys: list[str], id_: str, at: str, reach: float) -> DataFrame:
    """id_, caption: for each box the caption of equal keys that lies above it by at most `reach`, nearest first, then the
    smaller id. A place has one caption, the smallest, and all boxes of a place have the same: places alone are compared, in
    bins of that height, each place with the last caption before it, so no pair is formed however many captions are in reach."""
    placed = lambda df: df.where(F.col(at).isNotNull() & ~F.isnan(at)).withColumn("__bin", F.floor(F.col(at) / reach))
    place = [*keys, "__bin", F.col(at).alias("__at")]
    none = F.lit(None).cast(captions.schema[id_].dataType)
    first = placed(captions).groupBy(*place).agg(F.min(id_).alias("__caption")).where("__caption IS NOT NULL")
    # what a bin ends with lies before all places of the next; the one after that is for quotients that are rounded
    last = first.groupBy(*keys, "__bin").agg(F.max(F.struct("__at", "__caption")).alias("last"))
    carried = last.select(*keys, F.explode(F.array(*[F.try_add(F.col("__bin"), F.lit(k)) for k in (1, 2)])).alias("__bin"), "last.*")
    asked = placed(boxes).select(*place).distinct().withColumn("__caption", none)
    before = Window.partitionBy(*keys, "__bin").orderBy("__at", F.col("__caption").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caption = F.when(F.col("__caption").isNotNull(), F.struct(F.col("__at").alias("above"), F.col("__caption").alias("caption")))
    met = asked.unionByName(first).unionByName(carried).withColumn("met", F.last(caption, True).over(before)).where("__caption IS NULL")
    met = met.select(*keys, "__at", F.col("met.caption").alias("caption"), (F.col("__at") - F.col("met.above")).alias("apart")).where((F.col("apart") > 0) & (F.col("apart") <= reach))
    # a table of its own, as what Spark guesses of its size would deal out all boxes to meet a few places
    met = written(met, "captions")
    found = boxes.select(*keys, id_, F.col(at).alias("__at")).join(met, [*keys, "__at"])
    return found.groupBy(id_).agg(F.min_by("caption", F.struct("apart", "caption")).alias("caption"))
