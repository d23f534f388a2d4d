"""House style from decks: observations, classification, profile; and the merge of two profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import stats

PALETTE_RADIUS, MIN_FONT_SHARE, RECURRING_SHARE = 3.0, 0.01, 0.6


def observations(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, slide_index, key, value, weight: what each deck shows of its conventions."""
    row = lambda df, key, value, weight=None: df.select("deck_id", "slide_index", F.lit(key).alias("key"), value.cast("string").alias("value"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    titles = t["shapes"].where("placeholder_type IN ('title', 'ctrTitle') AND text <> ''")
    quotes = t["paragraphs"].select("deck_id", "slide_index", text.quote_census(F.col("text")).alias("q"))
    either = quotes.where("q.curly + q.straight > 0")
    dates = t["paragraphs"].select("deck_id", "slide_index", F.explode(text.date_candidates(F.col("text"))).alias("d")).withColumn("f", text.date_formats(F.col("d")))
    dates = dates.where("size(f) > 0").join(date_conventions(dates, ["deck_id"]), "deck_id", "left")
    read_as = F.when(F.size("f") == 1, F.element_at("f", 1)).when(F.array_contains("f", F.col("convention")), F.col("convention"))
    runs = t["runs"].where("trim(text) <> ''")
    frames = [
        row(titles, "title_case", text.capitalisation(F.col("text"))),
        row(either, "quotes", F.when(F.col("q.curly") >= F.col("q.straight"), "curly").otherwise("straight"), F.col("q.curly") + F.col("q.straight")),
        row(t["paragraphs"].where("bulleted AND trim(text) <> ''"), "bullet_terminal", text.terminal(F.col("text"))),
        row(dates, "date_format", read_as),
        row(runs.where("font IS NOT NULL"), "font", F.col("font"), F.length("text")),
        row(runs.where("size_pt IS NOT NULL"), "font_size", F.round("size_pt", 2), F.length("text")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where("value IS NOT NULL")


def date_conventions(dates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, convention: the one all-numeric order of day and month that a body of dates proves. dates has `f`, the formats
    that read each; a date that only one format reads is proof. Null where nothing or more than one order is proven."""
    only = F.element_at("f", 1)
    proof = F.when((F.size("f") == 1) & only.rlike("[/.]"), only)
    proven = dates.groupBy(*keys).agg(F.count_distinct(proof).alias("orders"), F.min(proof).alias("order"))
    return proven.select(*keys, F.when(F.col("orders") == 1, F.col("order")).alias("convention"))


def classify(obs: DataFrame) -> DataFrame:
    """One classification for each (deck_id, key)."""
    keys = ["deck_id", "key"]
    return stats.classify(stats.dominance(obs, keys, "value", F.col("weight")), keys, stats.SUPPORT["deck"])


def allowed_fonts(obs: DataFrame) -> DataFrame:
    """deck_id, allowed: faces with at least 1 % of a deck's characters."""
    shares = stats.dominance(obs.where("key = 'font'"), ["deck_id"], "value", F.col("weight"))
    return shares.where(F.col("share") >= MIN_FONT_SHARE).groupBy("deck_id").agg(F.array_sort(F.collect_set("value")).alias("allowed"))


def safe_margins(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, margin: the 5th percentile of the distance of text to the nearest edge, rounded down to 2pt."""
    s = t["shapes"].where("is_leaf AND text <> '' AND width_pt > 0").join(t["decks"].select("deck_id", F.col("width_pt").alias("w"), F.col("height_pt").alias("h")), "deck_id")
    edge = F.least(F.col("left_pt"), F.col("top_pt"), F.col("w") - F.col("left_pt") - F.col("width_pt"), F.col("h") - F.col("top_pt") - F.col("height_pt"))
    return s.groupBy("deck_id").agg((F.floor(F.greatest(F.percentile(edge, F.lit(0.05)), F.lit(0.0)) / 2) * 2).alias("margin"))


def boilerplate(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, line: texts that stand on at least 60 % of a deck's slides."""
    lines = t["shapes"].where("trim(text) <> '' AND length(text) > 3").select("deck_id", "slide_index", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("line")).distinct()
    counted = lines.groupBy("deck_id", "line").agg(F.count(F.lit(1)).alias("n")).join(t["decks"].select("deck_id", "slide_count"), "deck_id")
    return counted.where((F.col("n") >= F.col("slide_count") * RECURRING_SHARE) & (F.col("slide_count") >= 2)).select("deck_id", "line")


def learn(t: dict[str, DataFrame], deck_id: str) -> tuple[dict, list[tuple[str, str]]]:
    """(profile of one deck, [(key, why not learned)]). What reaches the driver is one row a convention."""
    obs = observations(t).where(F.col("deck_id") == deck_id)
    profile: dict = {"typography": {}, "fonts": {}, "slide": {}, "layout": {}, "footer": {}, "provenance": {}}
    unlearned = []
    for r in classify(obs).collect():
        if r["key"] in ("font", "font_size"):
            continue
        if r["class"] in ("invariant", "dominant"):
            profile["typography"][r["key"]] = r["value"]
            profile["provenance"][f"typography.{r['key']}"] = f"{r['class']} over {r['support']} observations"
        else:
            unlearned.append((r["key"], r["class"]))
    fonts = allowed_fonts(obs).first()
    profile["fonts"]["allowed"] = fonts.allowed if fonts else []
    size = t["decks"].where(F.col("deck_id") == deck_id).first()
    if size is not None and size.width_pt:
        profile["slide"] = {"width_pt": size.width_pt, "height_pt": size.height_pt}
    margin = safe_margins(t).where(F.col("deck_id") == deck_id).first()
    if margin is not None:
        profile["layout"]["safe_margin_pt"] = float(margin.margin)
    profile["footer"]["boilerplate"] = sorted(r.line for r in boilerplate(t).where(F.col("deck_id") == deck_id).collect())
    return profile, unlearned


def merge(base: dict, added: dict, locked: tuple[str, ...] = ()) -> tuple[dict, list[tuple[str, str]]]:
    """(merged profile, [(path, change)]). Lists widen, margins take the smaller value, boilerplate intersects, conventions
    that disagree are retired, another slide size is a conflict and stays, locked paths never change."""
    out, changes = {k: dict(v) for k, v in base.items()}, []

    def put(path: str, value, change: str) -> None:
        area, key = path.split(".", 1)
        old = out.setdefault(area, {}).get(key)
        if value == old:
            return
        if any(path == x or path.startswith(f"{x}.") for x in locked):
            changes.append((path, "locked"))
            return
        if value is None:
            out[area].pop(key, None)
        else:
            out[area][key] = value
        changes.append((path, change))

    fonts = base.get("fonts", {}).get("allowed", [])
    put("fonts.allowed", fonts + [f for f in added.get("fonts", {}).get("allowed", []) if f not in fonts], "widened")
    margins = [p["layout"]["safe_margin_pt"] for p in (base, added) if p.get("layout", {}).get("safe_margin_pt") is not None]
    if margins:
        put("layout.safe_margin_pt", min(margins), "widened")
    if base.get("footer", {}).get("boilerplate") and "footer" in added:
        put("footer.boilerplate", [x for x in base["footer"]["boilerplate"] if x in added["footer"].get("boilerplate", [])], "widened")
    for key, value in added.get("typography", {}).items():
        own = base.get("typography", {}).get(key)
        put(f"typography.{key}", value if own in (None, value) else None, "narrowed" if own is None else "retired")
    if added.get("slide") and base.get("slide") and added["slide"] != base["slide"]:
        changes.append(("slide", "conflict"))
    return out, changes


def weaker(a: Column, b: Column) -> Column:
    """The less sure of two confidences."""
    order = F.create_map(*[x for k, v in (("high", 0), ("medium", 1), ("low", 2)) for x in (F.lit(k), F.lit(v))])
    return F.when(F.try_element_at(order, a) >= F.try_element_at(order, b), a).otherwise(b)
