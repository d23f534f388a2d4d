"""Checks between figures. A figure row has deck, place, addr, source, metric, scope, period, kind, value, decimals,
quantity, scale, currency; place names the shape, `ord` its order in the deck."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbers import half_unit, scale_factor
from tallyframe.functions.periods import periods_agree
from tallyframe.operators.joins import modal_currency, same, tiered_lookup

KEYS = ["deck", "metric", "scope", "quantity", "kind"]
FACT = ["deck", "metric", "scope", "quantity"]
SCALE_STEPS = (1000.0, 100.0)
SCALE_TOLERANCE = 0.02
GROWTH_TOLERANCE = 0.5


def comparable_pairs(figures: DataFrame) -> DataFrame:
    """Pairs (a, b) of figures that claim one fact, as a.* and b.* structs with the confidence they allow.

    Equal keys, kind known, another place or address, periods that may be the same, currencies not known to differ; text
    needs a period on one side, a chart on both rules the same.
    """
    a, b = figures.where("kind IS NOT NULL").alias("a"), figures.where("kind IS NOT NULL").alias("b")
    c = lambda p, n: F.col(f"{p}.{n}")
    on = c("a", "ord") < c("b", "ord")
    for k in KEYS:
        on &= c("a", k).eqNullSafe(c("b", k)) if k in ("quantity", "scope") else c("a", k) == c("b", k)
    on &= ((c("a", "place") != c("b", "place")) | (c("a", "addr") != c("b", "addr"))) & periods_agree(c("a", "period"), c("b", "period"))
    on &= c("a", "currency").isNull() | c("b", "currency").isNull() | (c("a", "currency") == c("b", "currency"))
    loose = F.array_contains(F.array(c("a", "source"), c("b", "source")), "text")
    dated = c("a", "period").isNotNull() | c("b", "period").isNotNull()
    plotted = F.array_contains(F.array(c("a", "source"), c("b", "source")), "chart")
    pairs = a.join(b, on & (~(loose | plotted) | dated))
    return pairs.select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"), F.when(loose, "medium").otherwise("high").alias("confidence"))


def canonical(value: Column, scale: Column) -> Column:
    return value * scale_factor(scale)


def compared(a: Column, b: Column) -> tuple[Column, Column]:
    """Both values in full where both scales are known, else both as written; to six places."""
    x, y = canonical(a["value"], a["scale"]), canonical(b["value"], b["scale"])
    both = x.isNotNull() & y.isNotNull()
    return F.round(F.when(both, x).otherwise(a["value"]), 6), F.round(F.when(both, y).otherwise(b["value"]), 6)


def is_scale_of(x: Column, y: Column) -> Column:
    """A clean factor of 1000 or 100 apart, to 2 %."""
    low, high = F.least(F.abs(x), F.abs(y)), F.greatest(F.abs(x), F.abs(y))
    ratio = high / F.nullif(low, F.lit(0.0))
    hit = F.lit(False)
    for step in SCALE_STEPS:
        hit |= F.coalesce(F.abs(ratio - step) / step <= SCALE_TOLERANCE, F.lit(False))
    return hit


def disagreements(figures: DataFrame, scale: bool) -> DataFrame:
    """deck, metric, scope, kind, base_ord, ord: later figures that differ from the earliest statement not yet weighed.

    One row for each differing value of a baseline. Which figure is a baseline depends on the ones before it, so a
    group (one fact of one deck) is folded in order.
    """
    id_type = figures.schema["ord"].dataType.simpleString()
    schema = f"deck string, metric string, scope string, kind string, base_ord {id_type}, ord {id_type}"
    steps, tol = SCALE_STEPS, SCALE_TOLERANCE

    def factor(x: float, y: float) -> bool:
        low, high = sorted((abs(x), abs(y)))
        return low > 0 and any(abs(high / low - s) / s <= tol for s in steps)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ord").to_dict("records")
        out, weighed = [], set()
        if len({r["place"] for r in rows}) < 2:
            rows = []
        for i, base in enumerate(rows):
            if i in weighed:
                continue
            seen = set()
            for j in range(i + 1, len(rows)):
                other = rows[j]
                known = lambda r, k: r[k] is not None and r[k] == r[k]
                if base["place"] == other["place"] and base["addr"] == other["addr"]:
                    continue
                if any(known(base, k) and known(other, k) and base[k] != other[k] for k in ("period", "currency")):
                    continue
                if {"text", "chart"} & {base["source"], other["source"]} and not (known(base, "period") or known(other, "period")):
                    continue
                weighed.add(j)
                if base["place"] == other["place"]:
                    continue
                full = known(base, "full") and known(other, "full")
                x, y = (round(r["full" if full else "value"], 6) for r in (base, other))
                if x == y or y in seen or factor(x, y) is not scale:
                    continue
                seen.add(y)
                out.append((base["deck"], base["metric"], base["scope"], base["kind"], base["ord"], other["ord"]))
        return pd.DataFrame(out, columns=["deck", "metric", "scope", "kind", "base_ord", "ord"])

    ready = figures.where("kind IS NOT NULL").withColumn("full", canonical(F.col("value"), F.col("scale")))
    return ready.groupBy(*KEYS).applyInPandas(fold, schema)


def ratio_bound(num: Column, num_decimals: Column, den: Column, den_decimals: Column, stated_decimals: Column, percentage: bool) -> Column:
    """How far a correctly rounded ratio can be from the one recomputed from rounded inputs."""
    spread = half_unit(num_decimals) / F.abs(den) + F.abs(num) * half_unit(den_decimals) / (den * den)
    return spread * (100.0 if percentage else 1.0) + half_unit(stated_decimals)


def _derivation(metric: Column, names: list[list[str] | str]) -> Column:
    """Places in `names` of the lists that hold the metric."""
    listed = [[n] if isinstance(n, str) else list(n) for n in names]
    return F.array_compact(F.array(*[F.when(metric.isin(*n), k) for k, n in enumerate(listed)]))


def ratios(figures: DataFrame, derivations: tuple, percentage: bool = True) -> DataFrame:
    """ord, outcome (tied, finding, unchecked), reason, computed for every stated ratio.

    derivations: (names of the result, of its numerator, of its denominator), all looked up in one pass. Inputs are levels
    of the same deck, scope and period in the deck's usual currency; the nearest tier (shape, slide, deck) must hold one
    value.
    """
    which = lambda side: F.explode(_derivation(F.col("metric"), [d[side] for d in derivations])).alias("derivation")
    stated = figures.select("deck", "scope", "period", "place", "slide", "ord", F.col("value").alias("stated"), F.col("decimals").alias("stated_decimals"), which(0))
    stated = stated.withColumn("probe", F.concat_ws("|", "ord", "derivation"))
    levels = figures.where("kind = 'level' AND quantity IS NULL")
    keys = ["deck", "scope", "period", "derivation"]
    same = lambda x, y: (F.col(f"{x}.deck") == F.col(f"{y}.deck")) & (F.col(f"{x}.derivation") == F.col(f"{y}.derivation")) & F.col(f"{x}.scope").eqNullSafe(F.col(f"{y}.scope")) & F.col(f"{x}.period").eqNullSafe(F.col(f"{y}.period"))
    out = stated
    for k, side in ((1, "num"), (2, "den")):
        rows = modal_currency(levels.select("deck", "scope", "period", "place", "slide", "currency", "value", "decimals", which(k)), keys)
        tier = F.when(F.col("p.place") == F.col("c.place"), 1).when(F.col("p.slide") == F.col("c.slide"), 2).otherwise(3)
        found = tiered_lookup(stated, rows.withColumn("packed", F.col("value")), same("p", "c"), tier, "probe", "packed").select("probe", F.col("value").alias(side), F.col("reason").alias(f"{side}_reason"))
        places = rows.groupBy(*keys).agg(F.max("decimals").alias(f"{side}_decimals"))
        met = out.join(found, "probe", "left").alias("o").join(places.alias("d"), same("o", "d"), "left")
        out = met.select("o.*", f"d.{side}_decimals")
    computed = F.col("num") / F.nullif(F.col("den"), F.lit(0.0)) * (100.0 if percentage else 1.0)
    bound = ratio_bound(F.col("num"), F.col("num_decimals"), F.nullif(F.col("den"), F.lit(0.0)), F.col("den_decimals"), F.col("stated_decimals"), percentage)
    reason = F.coalesce(F.col("num_reason"), F.col("den_reason"), F.when(F.col("den") == 0, "zero"))
    outcome = F.when(reason.isNotNull(), "unchecked").when(F.abs(computed - F.col("stated")) <= bound, "tied").otherwise("finding")
    return out.select("ord", outcome.alias("outcome"), reason.alias("reason"), F.when(reason.isNull(), computed).alias("computed"))


def margins(figures: DataFrame, result: str | list[str], numerator: list[str], denominator: list[str], percentage: bool = True) -> DataFrame:
    """`ratios` of a single derivation."""
    return ratios(figures, ((result, numerator, denominator),), percentage)


def totals(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """cells: keys, row, is_total, value, decimals. keys, row, outcome for each total row.

    A total is right if any of four readings adds up within rounding: the block since the total before, all lines
    above, all lines, all subtotals above. It is accused only if some reading has three addends; the longest one tells.
    """
    order = Window.partitionBy(*keys).orderBy(row)
    above, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    line = lambda c: F.when(~F.col("is_total"), c)
    sub = lambda c: F.when(F.col("is_total"), c)
    v, h, one = F.col("value"), half_unit(F.col("decimals")), F.lit(1)
    block = Window.partitionBy(*keys, "__block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("__block", F.count(sub(one)).over(above))
    frames = {"block": (block, line), "above": (above, line), "all": (whole, line), "subs": (above, sub)}
    for name, (frame, pick) in frames.items():
        rows = rows.withColumn(f"{name}_sum", F.coalesce(F.sum(pick(v)).over(frame), F.lit(0.0))).withColumn(f"{name}_n", F.count(pick(one)).over(frame)).withColumn(f"{name}_tol", F.coalesce(F.sum(pick(h)).over(frame), F.lit(0.0)) + h)
    right, best = F.lit(False), F.lit(0)
    for name in frames:
        right |= (F.col(f"{name}_n") >= 2) & (F.abs(F.col(f"{name}_sum") - v) <= F.col(f"{name}_tol"))
        best = F.greatest(best, F.when(F.col(f"{name}_n") >= 3, F.col(f"{name}_n")).otherwise(0))
    outcome = F.when(right, "tied").when(best >= 3, "finding").otherwise("nothing")
    return rows.where("is_total").select(*keys, row, outcome.alias("outcome"), best.cast("int").alias("addends"))


def growth(stated: DataFrame, series: DataFrame) -> DataFrame:
    """stated: id, scope, first, last, value (percent); series: scope, year, value. id, outcome, computed."""
    s, a, b = stated.alias("s"), series.alias("a"), series.alias("b")
    both = s.join(a, (F.col("s.scope") == F.col("a.scope")) & (F.col("s.first") == F.col("a.year")), "left").join(b, (F.col("s.scope") == F.col("b.scope")) & (F.col("s.last") == F.col("b.year")), "left")
    start, end, years = F.col("a.value"), F.col("b.value"), F.col("s.last") - F.col("s.first")
    defined = (start > 0) & (end > 0) & (years > 0)
    computed = F.when(defined, (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)
    outcome = F.when(~F.coalesce(defined, F.lit(False)), "unchecked").when(F.abs(computed - F.col("s.value")) <= GROWTH_TOLERANCE, "tied").otherwise("finding")
    return both.select("s.id", outcome.alias("outcome"), computed.alias("computed"))


def bridges(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """steps: keys, order, role (opening, step, closing), value, decimals. keys, outcome, carried.

    Two steps at least; a bridge with one end only is unchecked.
    """
    part = lambda role, c: F.sum(F.when(F.col("role") == role, c))
    n = lambda role: F.count(F.when(F.col("role") == role, 1))
    g = steps.groupBy(*keys).agg(part("opening", F.col("value")).alias("o"), part("step", F.col("value")).alias("s"), part("closing", F.col("value")).alias("c"), n("opening").alias("no"), n("step").alias("ns"), n("closing").alias("nc"), F.sum(half_unit(F.col("decimals"))).alias("tol"))
    outcome = F.when((F.col("no") != 1) | (F.col("nc") != 1), "unchecked").when(F.col("ns") < 2, "nothing").when(F.abs(F.col("o") + F.col("s") - F.col("c")) <= F.col("tol"), "tied").otherwise("finding")
    return g.select(*keys, outcome.alias("outcome"), (F.col("o") + F.col("s")).alias("carried"))


def _agreeing(figures: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, period, `name`: how many figures of equal keys have a period that agrees. Only counts are joined."""
    by_period = figures.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n"))
    whole = by_period.groupBy(*keys).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("period").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
    met = F.when(F.col("period").isNull(), F.col("all")).otherwise(F.col("n") + F.col("undated"))
    return same(by_period, whole, keys).select(*keys, "period", met.alias(name))


def unread(figures: DataFrame) -> DataFrame:
    """Figures of unknown kind that would have been weighed against others, with the number of `others`: those of the same
    metric, scope and quantity at another place whose period agrees. Counted as all of the fact less those of the place, so
    no figure meets another. Nulls equal nulls; a figure stated once does not appear."""
    unknown = figures.where("kind IS NULL")
    fact = same(unknown, _agreeing(figures, FACT, "all_met"), [*FACT, "period"])
    here = same(fact, _agreeing(figures, [*FACT, "place"], "met_here"), [*FACT, "place", "period"])
    return here.withColumn("others", F.col("all_met") - F.col("met_here")).drop("all_met", "met_here").where("others > 0")


def against_first(figures: DataFrame, keys: list[str], stated: str) -> DataFrame:
    """figures with `first`, what `stated` is in the earliest (least ord) figure of equal keys. One row a key is joined."""
    first = figures.groupBy(*keys).agg(F.min_by(stated, "ord").alias("first"))
    return same(figures, first, keys)


def date_drift(figures: DataFrame) -> DataFrame:
    """ord, date, first: statements of a fact as at another date than its earliest statement; `date` is that of the slide."""
    dated = figures.where("kind IS NOT NULL AND date IS NOT NULL")
    return against_first(dated, [*KEYS, "period"], "date").where("date <> first").select("ord", "date", "first")


def pair_key(one: str, other: str) -> Column:
    """One key for two stated amounts, in either order: their currencies and their amounts to six places."""
    key = lambda c: F.concat_ws(" ", F.coalesce(f"{c}.currency", F.lit("?")), F.format_string("%.6e", F.col(f"{c}.amount")))
    return F.array_join(F.array_sort(F.array(key(one), key(other))), " = ")


def unit_drift(figures: DataFrame, conversions: DataFrame) -> DataFrame:
    """ord, stated, first (currency, scale, amount): dated figures whose currency or scale, both known, is not that of the
    fact's earliest statement. conversions (deck, one, other): amounts told as equal in a deck; such pairs are no drift."""
    f = figures.where("(scale IS NOT NULL OR currency IS NOT NULL) AND period IS NOT NULL")
    f = f.withColumn("stated", F.struct("currency", "scale", (F.col("value") * F.coalesce(scale_factor(F.col("scale")), F.lit(1.0))).alias("amount")))
    rows = against_first(f, ["deck", "metric", "scope", "kind", "period"], "stated").where("stated.currency <> first.currency OR stated.scale <> first.scale")
    told = conversions.select("deck", pair_key("one", "other").alias("pair")).distinct()
    return rows.withColumn("pair", pair_key("first", "stated")).join(told, ["deck", "pair"], "left_anti").select("ord", "stated", "first")


def grounded_kinds(figures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind: the kind that all figures of the keys have; an unknown kind counts as another."""
    counted = figures.groupBy(*keys).agg(F.count_distinct(F.coalesce("kind", F.lit("?"))).alias("kinds"), F.max("kind").alias("kind"))
    return counted.where("kinds = 1 AND kind IS NOT NULL").drop("kinds")
