"""House style of many reference decks in one plan: profile rows, and their fold into one profile.

A profile row is (source, path, rule, value, number): what one deck states of one path. Sources are folded in their order
as text; BASE, which sorts before all, is the profile that is already there. The rule says how an area folds:

    union   what any source states, in order of first appearance      common  what all sources that state the path state
    agree   the value if all agree, else the path is retired          first   the first value; another is a conflict
    least, most   the smallest or largest number

A locked path keeps what BASE says of it, nothing included. All folds are aggregates over (path, value), so a path that
every deck of a large corpus states is counted before the shuffle and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import learn as one
from tallyframe.functions import geometry
from tallyframe.operators import linkage, slides, stats

BASE = ""
ROWS = "source string, path string, rule string, value string, number double"

# Least support of a grid line and of a page number, widest share of the canvas that grid lines may cover, longest page number.
LINE_SUPPORT, LINE_STEPS, LINE_PT, LINE_COVER = 3, 6, 0.5, 0.25
PAGE_SHARE, PAGE_SLIDES, PAGE_CHARS = 0.6, 3, 40
NUMBER = "{n}"


def _row(df: DataFrame, path: Column | str, rule: str, value: Column | None = None, number: Column | None = None) -> DataFrame:
    path = F.lit(path) if isinstance(path, str) else path
    none = F.lit(None)
    return df.select(F.col("deck_id").alias("source"), path.alias("path"), F.lit(rule).alias("rule"), (none if value is None else value).cast("string").alias("value"), (none if number is None else number).cast("double").alias("number"))


def colours(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, hex, weight, head: the colours that a deck's fills, outlines and letters use, each with the commoner one within
    PALETTE_RADIUS that stands for it."""
    use = lambda df, c: df.where(F.col(c).isNotNull()).select("deck_id", F.upper(c).alias("hex"))
    used = use(t["shapes"], "fill_hex").unionByName(use(t["shapes"], "line_hex")).unionByName(use(t["runs"].where("trim(text) <> ''"), "color_hex"))
    weighed = used.groupBy("deck_id", "hex").agg(F.count(F.lit(1)).alias("weight")).withColumn("lab", geometry.to_lab(F.col("hex"))).select("deck_id", "hex", "weight", "lab.l", "lab.a", "lab.b")
    return stats.palette_greedy(weighed, ["deck_id"], one.PALETTE_RADIUS)


def palettes(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, hex: the colours of a deck that stand for themselves."""
    return colours(t).where("hex = head").select("deck_id", "hex")


def grid_lines(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, axis, at: positions that shapes' edges share on several slides. The support a line needs is raised until the
    lines of an axis cover no more than LINE_COVER of the canvas; an axis that stays covered has none."""
    deck = t["decks"].select("deck_id", F.col("width_pt").alias("w"), F.col("height_pt").alias("h"))
    content = slides.content_shapes(t).select(*slides.SHAPE)
    e = slides.edges(t).where("edge NOT IN ('centre', 'middle')").join(content, slides.SHAPE, "left_semi")
    seen = e.groupBy("deck_id", "axis", F.round("at", 1).alias("at")).agg(F.count_distinct("slide_index").cast("double").alias("n"))
    members = stats.cluster_1d(seen, ["deck_id", "axis"], "at", "n", LINE_PT)
    lines = stats.cluster_stats(members, ["deck_id", "axis"]).where(F.col("weight") >= LINE_SUPPORT).join(deck, "deck_id")
    lines = lines.select("deck_id", "axis", F.col("mode").alias("at"), (F.col("weight") - LINE_SUPPORT + 1).alias("count"), F.when(F.col("axis") == "x", F.col("w")).otherwise(F.col("h")).alias("extent"))
    need = stats.needed_support(lines, ["deck_id", "axis"], "count", LINE_STEPS, 2 * LINE_PT, F.col("extent"), LINE_COVER)
    return lines.join(need.select("deck_id", "axis", "step"), ["deck_id", "axis"]).where(F.col("count") >= F.col("step")).select("deck_id", "axis", "at")


def page_numbers(t: dict[str, DataFrame]) -> DataFrame:
    """deck_id, pattern: the short text that says the slide's number on most slides, with NUMBER in that number's place.

    Each number of a text is tried; its distance from the slide's index must be the same all over the deck.
    """
    said = slides.leaves(t).where((F.length("text") <= PAGE_CHARS) & F.col("text").rlike(r"\d")).select("deck_id", "slide_index", F.trim("text").alias("text"))
    digits, gaps = F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), F.split("text", r"\d+", -1)
    tried = said.select("deck_id", "slide_index", digits.alias("d"), gaps.alias("g")).select("deck_id", "slide_index", "d", "g", F.posexplode("d").alias("k", "number"))
    # only the tried number changes from slide to slide; the others stay as they are
    marks = F.transform("d", lambda x, i: F.when(i == F.col("k"), F.lit(NUMBER)).otherwise(x))
    pattern = F.array_join(F.zip_with("g", marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    offset = F.col("number").try_cast("int") - F.col("slide_index")
    found = tried.select("deck_id", "slide_index", pattern.alias("pattern"), offset.alias("offset")).where("offset IS NOT NULL")
    counted = found.groupBy("deck_id", "pattern", "offset").agg(F.count_distinct("slide_index").alias("n")).join(t["decks"].select("deck_id", "slide_count"), "deck_id")
    good = counted.where((F.col("n") >= PAGE_SLIDES) & (F.col("n") >= F.col("slide_count") * PAGE_SHARE))
    return good.groupBy("deck_id").agg(F.max_by("pattern", F.struct("n", -F.length("pattern"), "pattern")).alias("pattern"))


def profile_rows(t: dict[str, DataFrame]) -> DataFrame:
    """What every deck states of its house style."""
    obs = one.observations(t)
    settled = one.classify(obs).where("class IN ('invariant', 'dominant') AND key NOT IN ('font', 'font_size')")
    fonts = one.allowed_fonts(obs).select("deck_id", F.explode("allowed").alias("font"))
    lines = one.boilerplate(t)
    logos = slides.logo_hashes(t).select("deck_id", "image_sha1")
    grid = grid_lines(t)
    used = colours(t)
    axis = F.when(F.col("axis") == "x", "layout.grid.columns").otherwise("layout.grid.rows")
    sized = t["decks"].where("width_pt > 0")
    frames = [
        _row(settled, F.concat(F.lit("typography."), F.col("key")), "agree", F.col("value")),
        _row(fonts, "fonts.allowed", "union", F.col("font")),
        _row(sized, "slide.width_pt", "first", None, F.col("width_pt")),
        _row(sized, "slide.height_pt", "first", None, F.col("height_pt")),
        _row(one.safe_margins(t), "layout.safe_margin_pt", "least", None, F.col("margin")),
        _row(lines, "footer.boilerplate", "common", F.col("line")),
        _row(page_numbers(t), "footer.page_number", "agree", F.col("pattern")),
        _row(used.where("hex = head"), "brand.palette_hex", "union", F.col("hex")),
        _row(stats.palette_tolerance(used, ["deck_id"]), "brand.palette_tolerance", "most", None, F.col("tolerance")),
        _row(logos.unionByName(linkage.logo_variants(t, logos)).distinct(), "brand.logo.sha1", "union", F.col("image_sha1")),
        _row(linkage.lockup_lines(t, lines), "brand.logo.lines", "union", F.col("line")),
        _row(grid, axis, "union", None, F.col("at")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fold(rows: DataFrame, locked: Column | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept: path, rule, value, number, since; changes: path, rule, sources, change) of profile rows.

    locked: paths, with all below them, or a condition on `path`. change is `locked` where a source differs from a locked
    BASE, `widened`, `narrowed`, `retired`, `conflict`, or `neutral`.
    """
    if not isinstance(locked, Column):
        held = F.lit(False)
        for x in locked:
            held |= (F.col("path") == x) | F.startswith(F.col("path"), F.lit(f"{x}."))
        locked = held
    values = rows.groupBy("path", "rule", "value", "number").agg(F.count_distinct("source").alias("n"), F.min("source").alias("since"), F.max("source").alias("until"))
    per = rows.groupBy("path", "rule").agg(F.count_distinct("source").alias("sources"), F.min("source").alias("first"), F.count_distinct(F.struct("value", "number")).alias("kinds"), F.min("number").alias("lowest"), F.max("number").alias("highest"))
    met = values.join(per, ["path", "rule"]).withColumn("is_locked", locked)
    by_rule = {"union": F.lit(True), "common": F.col("n") == F.col("sources"), "agree": F.col("kinds") == 1, "first": F.col("since") == F.col("first"), "least": F.col("number") == F.col("lowest"), "most": F.col("number") == F.col("highest")}
    stays = F.lit(False)
    for name, condition in by_rule.items():
        stays = F.when(F.col("rule") == name, condition).otherwise(stays)
    met = met.withColumn("stays", F.coalesce(F.when(F.col("is_locked"), F.col("since") == BASE).otherwise(stays), F.lit(False)))
    kept = met.where("stays").select("path", "rule", "value", "number", "since")
    new = F.max((F.col("stays") & (F.col("since") != F.col("first"))) | (F.col("first") != BASE))
    summed = met.groupBy("path", "rule").agg(F.first("sources").alias("sources"), F.first("is_locked").alias("is_locked"), F.max(F.col("since") != BASE).alias("differs"), F.first("kinds").alias("kinds"), new.alias("grown"), F.min("stays").alias("all"))
    change = (
        F.when(F.col("is_locked"), F.when(F.col("differs"), "locked").otherwise("neutral"))
        .when((F.col("rule") == "agree") & (F.col("kinds") > 1), "retired")
        .when((F.col("rule") == "first") & (F.col("kinds") > 1), "conflict")
        .when((F.col("rule") == "common") & ~F.col("all"), "narrowed")
        .when(F.col("grown"), "widened")
        .otherwise("neutral")
    )
    return kept, summed.select("path", "rule", "sources", change.alias("change"))


def stated_rows(profile: dict, spark) -> DataFrame:
    """The rows of a profile that is already there, with source BASE. A profile is small by nature."""
    rules = {"fonts.allowed": "union", "layout.safe_margin_pt": "least", "footer.boilerplate": "common", "footer.page_number": "agree", "brand.palette_hex": "union", "brand.palette_tolerance": "most", "brand.logo.sha1": "union", "brand.logo.lines": "union", "layout.grid.columns": "union", "layout.grid.rows": "union", "slide.width_pt": "first", "slide.height_pt": "first"}
    rows = []

    def walk(path: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{path}.{k}" if path else k, v)
            return
        rule = rules.get(path) or ("agree" if path.startswith("typography.") and not isinstance(value, list) else None)
        for x in (value if isinstance(value, list) else [value]) if rule else ():
            number = float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
            rows.append((BASE, path, rule, None if number is not None or x is None else str(x), number))

    walk("", profile)
    return spark.createDataFrame(rows, ROWS)


def as_profile(kept: DataFrame) -> dict:
    """Folded rows as a nested profile: lists by first source and value. What reaches the driver is one profile."""
    out: dict = {}
    for r in sorted(kept.collect(), key=lambda r: (r.path, r.since, r.value or "", r.number or 0.0)):
        *areas, key = r.path.split(".")
        place = out
        for a in areas:
            place = place.setdefault(a, {})
        value = r.value if r.number is None else r.number
        if r.rule in ("union", "common"):
            place.setdefault(key, []).append(value)
        else:
            place[key] = value
    return out


def learn_corpus(t: dict[str, DataFrame], base: dict | None = None, locks: tuple[str, ...] = ()) -> tuple[dict, DataFrame]:
    """(profile, changes by path) of all decks, folded onto `base`; base's own locks hold too. One plan, whatever the number of decks."""
    rows = profile_rows(t)
    if base:
        rows = rows.unionByName(stated_rows(base, rows.sparkSession))
    kept, changes = fold(rows, (*locks, *(base or {}).get("locks", ())))
    return as_profile(kept), changes
