"""The figure index: every number of tables, charts and text as a fact with metric, scope, period, kind and unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import prose
from tallyframe.functions import labels, numbers, periods
from tallyframe.operators import consistency
from tallyframe.storage import written

PLACE = ["deck_id", "slide_index", "uid"]


def _ord(*parts: str) -> Column:
    """A text that sorts as deck, slide, shape and address do."""
    return F.concat_ws("|", F.col("deck_id"), *[F.lpad(F.col(p).cast("string"), 6, "0") for p in parts])


def _figure(df: DataFrame, source: str, row: str, col: str) -> DataFrame:
    return df.select(
        _ord("slide_index", "uid", row, col).alias("ord"), F.col("deck_id").alias("deck"), F.concat_ws("|", F.col("slide_index").cast("string"), F.col("uid").cast("string")).alias("place"),
        F.concat_ws(",", F.col(row).cast("string"), F.col(col).cast("string")).alias("addr"), F.col("slide_index").alias("slide"), "uid", F.lit(source).alias("source"), "metric", "scope", "period", "kind",
        F.col("r.value").alias("value"), F.col("r.decimals").alias("decimals"), "unit.quantity", "unit.scale", "unit.currency", "raw",
    )


AMOUNT = rf"(?:{numbers.CURRENCY})\s?[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:mm|m|bn|k)?"


def conversions(passages: DataFrame) -> DataFrame:
    """deck, one, other: amounts that a text states as equal, the second in brackets behind the first."""
    pair = rf"(?i)({AMOUNT})\s*\(\s*({AMOUNT})\s*\)"
    side = lambda k: F.regexp_extract_all("text", F.lit(pair), F.lit(k))
    said = passages.select("deck_id", F.explode(F.arrays_zip(side(1).alias("a"), side(2).alias("b"))).alias("p"))
    read = said.select("deck_id", numbers.parse_number(F.col("p.a")).alias("a"), numbers.parse_number(F.col("p.b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")

    def stated(c: str) -> Column:
        unit = numbers.unit_of(F.col(c))
        return F.struct(unit["currency"].alias("currency"), unit["scale"].alias("scale"), (F.col(f"{c}.value") * F.coalesce(numbers.scale_factor(unit["scale"]), F.lit(1.0))).alias("amount"))

    return read.select(F.col("deck_id").alias("deck"), stated("a").alias("one"), stated("b").alias("other"))


def table_figures(t: dict[str, DataFrame]) -> DataFrame:
    """Cells of tables. Columns are the period axis only if every value column is dated; else rows if all are; else a
    row names the scope and the column the metric. A corner cell states the unit of what lies below."""
    cells = t["table_cells"].where("NOT is_merge_continuation")
    named = lambda df, c: df.withColumn(c, periods.split_period("text")).withColumn(f"{c}_text", F.col("text")).drop("text")
    heads = named(cells.where("row = 0 AND col > 0").select(*PLACE, "col", "text"), "head")
    sides = named(cells.where("col = 0 AND row > 0").select(*PLACE, "row", "text"), "side")
    corner = cells.where("row = 0 AND col = 0").select(*PLACE, labels.stated_unit(F.col("text")).alias("corner"))
    whole = Window.partitionBy(*PLACE)
    heads = heads.withColumn("by_column", F.min(F.col("head.period").isNotNull().cast("int")).over(whole))
    sides = sides.withColumn("by_row", F.min(F.col("side.period").isNotNull().cast("int")).over(whole))
    body = cells.where("row > 0 AND col > 0").withColumn("r", numbers.read_cell(F.col("text"))).where("r IS NOT NULL")
    body = body.join(heads, [*PLACE, "col"]).join(sides, [*PLACE, "row"]).join(corner, PLACE, "left")
    head, side = labels.normalise_label(F.col("head.label")), labels.normalise_label(F.col("side.label"))
    by_column, by_row = F.col("by_column") == 1, F.col("by_row") == 1
    other = F.struct(F.lit(None).cast("string").alias("quantity"), F.col("corner.scale").alias("scale"), F.col("corner.currency").alias("currency"))
    column_unit = labels.stated_unit(F.col("head_text"))
    own = numbers.unit_of(F.col("r"))
    closer = numbers.inherit_unit(own, F.struct(F.lit(None).cast("string").alias("quantity"), column_unit["scale"].alias("scale"), column_unit["currency"].alias("currency")))
    rows = body.withColumn("unit", numbers.inherit_unit(closer, other)).select(
        *PLACE, "row", "col", "r", "unit", F.col("text").alias("raw"),
        F.when(by_column, side).otherwise(head).alias("metric"),
        F.when(by_column | by_row, "").otherwise(side).alias("scope"),
        F.when(by_column, F.coalesce("side.period", "head.period")).when(by_row, F.col("side.period")).otherwise(F.coalesce("side.period", "head.period")).alias("period"),
        labels.cell_kind(F.col("side_text"), F.col("head_text"), F.col("unit.quantity")).alias("kind"),
    )
    return _figure(rows, "table", "row", "col")


def chart_figures(t: dict[str, DataFrame]) -> DataFrame:
    """Points of charts: the series names the metric, the category the period; axis titles state the unit."""
    unit = labels.stated_unit(F.concat_ws(" ", "axis_titles"))
    axes = t["charts"].select(*PLACE, F.struct(F.lit(None).cast("string").alias("quantity"), unit["scale"].alias("scale"), unit["currency"].alias("currency")).alias("unit"))
    points = t["chart_points"].where("value IS NOT NULL").join(axes, PLACE).withColumn("c", periods.split_period("category"))
    plain = F.regexp_replace(F.col("value").cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    reading = F.struct(F.col("value"), F.length(F.regexp_extract(plain, r"\.(\d+)$", 1)).alias("decimals"))
    rows = points.withColumn("r", reading).select(*PLACE, "series", "point", "r", "unit", plain.alias("raw"), labels.normalise_label(F.col("series_name")).alias("metric"), F.when(F.col("c.period").isNull(), F.col("c.label")).otherwise("").alias("scope"), F.col("c.period").alias("period"), F.coalesce(labels.label_kind(F.col("series_name")), F.lit("level")).alias("kind"))
    return _figure(rows, "chart", "series", "point")


def text_figures(t: dict[str, DataFrame], stated: DataFrame) -> DataFrame:
    """Numbers of running text, bound to the metrics of `stated` figures; a percentage takes the one kind they ground it in."""
    paragraphs = t["paragraphs"].where("row IS NULL").select(F.col("deck_id").alias("deck"), F.col("slide_index").alias("slide"), "uid", "para", "text")
    known = labels.vocabulary(stated, ["deck"], "metric")
    found = prose.prose_figures(paragraphs, known.withColumn("kind", labels.label_kind(F.col("metric"))))
    grounded = consistency.grounded_kinds(stated.where("quantity IS NOT NULL AND kind IS NOT NULL"), ["deck", "metric", "quantity"]).withColumnRenamed("kind", "ground")
    rows = found.join(grounded, ["deck", "metric", "quantity"], "left").withColumn("kind", F.coalesce("kind", "ground"))
    place = F.concat_ws("|", F.col("slide").cast("string"), F.col("uid").cast("string"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    return rows.select(
        F.concat_ws("|", "deck", *map(number, ("slide", "uid", "para", "nth"))).alias("ord"), "deck", place.alias("place"), F.concat_ws(",", F.col("para").cast("string"), F.col("nth").cast("string")).alias("addr"), "slide", "uid", F.lit("text").alias("source"),
        "metric", "scope", "period", "kind", "value", "decimals", "quantity", "scale", "currency", "raw",
    )


def build_index(t: dict[str, DataFrame]) -> DataFrame:
    """All figures with a specific metric: of tables, charts and running text."""
    stated = table_figures(t).unionByName(chart_figures(t)).where(labels.is_specific(F.col("metric")))
    stated = written(stated, "stated")
    return stated.unionByName(text_figures(t, stated))


def index_of(t: dict[str, DataFrame]) -> DataFrame:
    """The index of a set of tables, written once for all rules that read it."""
    if "figures" not in t:
        t["figures"] = written(build_index(t), "figures")
    return t["figures"]
