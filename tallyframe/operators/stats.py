"""House-style statistics: one-dimensional clusters, dominance, entropy, classification, tolerances, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import geometry

# Thresholds of the classification.
DOMINANT, MODE, MAX_MODES, MAX_ENTROPY = 0.85, 0.15, 3, 1.6
TOLERANCE_LEAST, TOLERANCE_MOST = 2.0, 6.0
SUPPORT = {"deck": 3, "archetype": 2, "table": 2, "structural": 1}


def cluster_1d(df: DataFrame, keys: list[str], value: str, weight: str, tolerance: float) -> DataFrame:
    """Each distinct value of a key with the number of its cluster: keys, value, weight, support, cluster.

    In order of value, a value joins the current cluster if it is within the tolerance of that cluster's weighted
    mean, else it opens the next. Equal values always share a cluster, so they are added up before the fold, which
    then holds a key's distinct values and is the only step that needs them in order.
    """
    pre = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.sum(weight).cast("double").alias("weight"), F.count(F.lit(1)).alias("support"))
    folded = pre.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "weight", "support"))).alias("items"))
    start = lambda x: F.struct(x["weight"].alias("w"), (x["value"] * x["weight"]).alias("vw"), F.array(x["value"]).alias("opens"))

    def step(acc: Column, x: Column) -> Column:
        near = F.abs(x["value"] - acc["vw"] / F.greatest(acc["w"], F.lit(1e-12))) <= tolerance
        grown = F.struct((acc["w"] + x["weight"]).alias("w"), (acc["vw"] + x["value"] * x["weight"]).alias("vw"), acc["opens"].alias("opens"))
        opened = F.struct(x["weight"].alias("w"), (x["value"] * x["weight"]).alias("vw"), F.array_append(acc["opens"], x["value"]).alias("opens"))
        return F.when(near, grown).otherwise(opened)

    first = F.element_at("items", 1)
    opens = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start(first), step, lambda acc: acc["opens"])
    rows = folded.withColumn("opens", opens).select(*keys, "opens", F.explode("items").alias("i"))
    return rows.select(*keys, "i.value", "i.weight", "i.support", F.size(F.filter("opens", lambda o: o <= F.col("i.value"))).alias("cluster"))


def cluster_stats(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cluster, centre, mode (most weight, then smallest), low, high, spread, weight, support."""
    return members.groupBy(*keys, "cluster").agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("centre"),
        F.min_by("value", F.struct(-F.col("weight"), F.col("value"))).alias("mode"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.sum("weight").alias("weight"),
        F.sum("support").alias("support"),
    )


def ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, weight, support, share, rank of counted values: by falling weight, then value."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("weight"), "value")
    return counted.withColumn("share", F.col("weight") / F.sum("weight").over(whole)).withColumn("rank", F.row_number().over(order))


def dominance(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """As ranked, over rows that are counted here."""
    return ranked(df.groupBy(*keys, F.col(value).alias("value")).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("support")), keys)


def entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entropy in bits, from rows with a share."""
    return df.groupBy(*keys).agg(F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log2("share")).otherwise(0.0)).alias("entropy"))


def classify(shares: DataFrame, keys: list[str], required: Column | int, spread: Column | None = None) -> DataFrame:
    """keys, class, value, allowed, support, top_share, entropy (and spread) from dominance or cluster shares.

    INVARIANT for one value, DOMINANT from a share of .85, MULTIMODAL for two or three modes of .15 and at most 1.6 bits,
    else VARIABLE; too little support is VARIABLE whatever the values.
    """
    mode = F.when(F.col("share") >= MODE, F.struct("rank", "value"))
    summary = shares.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("support").alias("support"),
        F.max("share").alias("top_share"),
        F.min_by("value", "rank").alias("top"),
        F.transform(F.array_sort(F.collect_list(mode)), lambda m: m["value"]).alias("modes"),
        F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log2("share")).otherwise(0.0)).alias("entropy"),
    )
    required = F.lit(required) if isinstance(required, int) else required
    kind = (
        F.when(F.col("support") < required, "variable")
        .when(F.col("distinct") == 1, "invariant")
        .when(F.col("top_share") >= DOMINANT, "dominant")
        .when(F.size("modes").between(2, MAX_MODES) & (F.col("entropy") <= MAX_ENTROPY), "multimodal")
        .otherwise("variable")
    )
    out = summary.withColumn("class", kind)
    allowed = F.when(F.col("class").isin("invariant", "dominant"), F.array("top")).when(F.col("class") == "multimodal", F.col("modes"))
    return out.select(*keys, "class", F.when(F.col("class") != "variable", F.col("top")).alias("value"), allowed.alias("allowed"), "support", "distinct", "top_share", "entropy")


def explained_by(classified: DataFrame, keys: list[str]) -> DataFrame:
    """keys, explained: every group with support has one value, and there are at least two different ones."""
    single = F.col("class").isin("invariant", "dominant")
    return classified.groupBy(*keys).agg((F.bool_and(single | (F.col("support") == 0)) & (F.count(F.when(single, 1)) >= 2) & (F.count_distinct(F.when(single, F.col("value"))) >= 2)).alias("explained"))


def tolerance(spread: Column, floor: float, factor: float = 1.5, ceiling: float | None = None) -> Column:
    value = F.greatest(spread * factor, F.lit(floor))
    return F.bround(value if ceiling is None else F.least(value, F.lit(ceiling)), 2)


def coverage(df: DataFrame, keys: list[str], line: str, half_width: float, extent: float) -> DataFrame:
    """keys, covered: share of [0, extent] that lies within half_width of a line. Overlapping bands count once."""
    bands = df.select(*keys, F.greatest(F.lit(0.0), F.col(line) - half_width).alias("lo"), F.least(F.lit(extent), F.col(line) + half_width).alias("hi"))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = bands.withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    added = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce("reach", F.col("lo"))))
    return reach.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(added) / extent).alias("covered"))


def needed_support(lines: DataFrame, keys: list[str], support: str, steps: int, width: float, extent: Column | float, most: float) -> DataFrame:
    """keys, step, lines: the least support, up to `steps`, at which a key's lines, each `width` wide, cover at most the share
    `most` of the extent, and how many lines are left then. A key that no step brings so low does not appear."""
    whole = extent if isinstance(extent, Column) else F.lit(float(extent))
    tried = lines.withColumn("extent", whole).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    left = tried.groupBy(*keys, "step").agg(F.count(F.when(F.col(support) >= F.col("step"), 1)).alias("lines"), F.max("extent").alias("extent"))
    passing = left.where(F.least(F.lit(1.0), F.col("lines") * width / F.col("extent")) <= most)
    return passing.groupBy(*keys).agg(F.min("step").alias("step"), F.min_by("lines", "step").alias("lines"))


def palette_greedy(df: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """df: keys, hex, weight, l, a, b. Heaviest first, a colour joins the first cluster whose head is within the radius.

    Returns keys, hex, weight, head. A key holds distinct colours, at most 2 ** 24.
    """
    items = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("neg"), "hex", "l", "a", "b"))), lambda x: x).alias("items"))
    far = lambda p, q: F.sqrt((p["l"] - q["l"]) * (p["l"] - q["l"]) + (p["a"] - q["a"]) * (p["a"] - q["a"]) + (p["b"] - q["b"]) * (p["b"] - q["b"]))
    empty = F.expr("cast(array() as array<struct<hex:string,l:double,a:double,b:double>>)")

    def step(heads: Column, x: Column) -> Column:
        own = F.struct(x["hex"].alias("hex"), x["l"].alias("l"), x["a"].alias("a"), x["b"].alias("b"))
        return F.when(F.exists(heads, lambda h: far(h, x) <= radius), heads).otherwise(F.array_append(heads, own))

    rows = items.withColumn("heads", F.aggregate("items", empty, step)).select(*keys, "heads", F.explode("items").alias("i"))
    head = F.element_at(F.filter("heads", lambda h: far(h, F.col("i")) <= radius), 1)
    return rows.select(*keys, "i.hex", (-F.col("i.neg")).alias("weight"), head["hex"].alias("head"))


def palette_tolerance(members: DataFrame, keys: list[str]) -> DataFrame:
    """members: keys, hex, head (see palette_greedy). Returns keys, tolerance: half the least distance of two heads, between
    2 and 6, raised to what admits every member of a cluster, but with two heads or more never over 6.

    Only pairs nearer than 12 can set it, so heads meet those of their own and the adjoining cells of a grid of that width:
    an equi-join, not all pairs.
    """
    lab = lambda c, to: geometry.to_lab(F.col(c)).alias(to)
    away = members.select(*keys, "hex", "head", lab("hex", "own"), lab("head", "of"))
    reach = away.groupBy(*keys).agg(F.max(geometry.delta_e(F.col("own"), F.col("of"))).alias("radius"), F.count_distinct("head").alias("heads"))
    cell = lambda c: F.floor(F.col(f"lab.{c}") / (2 * TOLERANCE_MOST))
    at = members.select(*keys, "head").distinct().withColumn("lab", geometry.to_lab(F.col("head"))).select(*keys, "head", "lab", *[cell(c).alias(f"c{c}") for c in "lab"])
    near = at.select(*keys, F.col("head").alias("head2"), F.col("lab").alias("lab2"), *[F.col(f"c{c}") for c in "lab"])
    for c in "lab":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + k for k in (-1, 0, 1)])))
    met = at.join(near, [*keys, "cl", "ca", "cb"]).where("head < head2")
    least = met.groupBy(*keys).agg((F.min(geometry.delta_e(F.col("lab"), F.col("lab2"))) / 2).alias("half"))
    half = F.greatest(F.lit(TOLERANCE_LEAST), F.least(F.coalesce("half", F.lit(TOLERANCE_MOST)), F.lit(TOLERANCE_MOST)))
    admits = F.round(F.col("radius") + 0.1, 2)
    several = F.when(admits > half, F.least(admits, F.lit(TOLERANCE_MOST))).otherwise(half)
    one = F.greatest(F.lit(TOLERANCE_LEAST), admits)
    return reach.join(least, keys, "left").select(*keys, F.round(F.when(F.col("heads") < 2, one).otherwise(several), 2).alias("tolerance"))


def nearest_mean(rows: DataFrame, id_: str, label: str, vector: str, block: int = 256) -> DataFrame:
    """id_, nearest: the label whose mean vector is nearest to each row's, to nine places; ties to the smaller label.

    Means are dealt to blocks of about `block` by the labels' hash and every vector visits each block once, by an equi-join
    on the block, so no task and no broadcast holds more than a block, however many labels there are. Rows with a null
    label make no mean; rows with a null vector and tables without any label give no rows.
    """
    flat = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("d", "x"))
    means = flat.groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    blocks = rows.where(F.col(label).isNotNull()).agg(F.greatest(F.ceil(F.approx_count_distinct(label) / block), F.lit(1)).cast("int").alias("blocks"))
    n = blocks.first()["blocks"]
    dealt = means.select(F.pmod(F.xxhash64(label), F.lit(n)).cast("int").alias("__block"), F.struct(F.col(label).alias("label"), "mean").alias("m"))
    dealt = dealt.groupBy("__block").agg(F.collect_list("m").alias("means"))
    asked = rows.where(F.col(vector).isNotNull()).select(id_, F.col(vector).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__block"))
    far = lambda c: F.aggregate(F.zip_with("__v", c["mean"], lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.transform("means", lambda c: F.struct(F.round(far(c), 9).alias("dist"), c["label"].alias("label"))))
    return asked.join(dealt, "__block").groupBy(id_).agg(F.min(best)["label"].alias("nearest"))
