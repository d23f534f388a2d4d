"""Audit plumbing: gates, clustering, order, suppression, deltas between two audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities and confidences from worst to mildest.
SEVERITIES = ("blocker", "major", "minor", "info")
CONFIDENCES = ("high", "medium", "low")


def rank(column: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), column)


def exceeds(findings: DataFrame, fail_on: str = "blocker", confidence: str = "medium", gated: tuple[str, ...] = ()) -> DataFrame:
    """Findings that fail the gate: as severe as fail_on, as sure as confidence, not of a category that never gates."""
    severe = rank(F.col("severity"), SEVERITIES) <= SEVERITIES.index(fail_on) + 1
    sure = rank(F.col("confidence"), CONFIDENCES) <= CONFIDENCES.index(confidence) + 1
    free = ~F.col("category").isin(*gated) if gated else F.lit(True)
    return findings.where(severe & sure & free)


def cluster_findings(findings: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One finding for each slide and rule: the first one's message, the worst severity, how many more."""
    worst = F.min(rank(F.col("severity"), SEVERITIES))
    names = F.array(*[F.lit(x) for x in SEVERITIES])
    return findings.groupBy(*keys).agg(F.min_by("message", order).alias("message"), F.get(names, worst - 1).alias("severity"), (F.count(F.lit(1)) - 1).alias("more"))


def summary(findings: DataFrame, spark) -> DataFrame:
    """severity, n: every severity, zeros included."""
    base = spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "position int, severity string")
    return base.join(findings.groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (fixed, new, remaining), key, n: multiset differences and intersection of finding keys."""
    fixed = before.exceptAll(after).withColumn("change", F.lit("fixed"))
    new = after.exceptAll(before).withColumn("change", F.lit("new"))
    remaining = before.intersectAll(after).withColumn("change", F.lit("remaining"))
    return fixed.unionByName(new).unionByName(remaining)


def half_point(at: Column) -> Column:
    """A place to half a point, halves to even, as text; null stays null."""
    return F.when(at.isNotNull(), F.format_string("%.1f", F.bround(at * 2) / 2))


def signature(rule: Column, shape: Column, left: Column, top: Column) -> Column:
    """An identity without the slide; boxes to half a point."""
    return F.concat_ws("|", rule, shape, half_point(left), half_point(top))


def stated(rule: Column, measured: Column, expected: Column, box: list[Column], message: Column) -> Column:
    """What a finding is about, without its slide: what was measured, what was expected and the box; the message where a
    finding has none of the three."""
    bare = lambda c: F.regexp_replace(c, r"(?i)\s*\(?\bslides?\s+\d+(?:\s*(?:,|and)\s*\d+)*\)?", "")
    parts = F.concat_ws("|", bare(measured), bare(expected), *map(half_point, box))
    return F.sha2(F.concat_ws("|", rule, F.when(parts == "", bare(message)).otherwise(parts)), 256)


def merge_suppressions(rows: DataFrame) -> DataFrame:
    """Repeated acceptances of one (rule, slide, shape) added up, their notes kept once each."""
    return rows.groupBy("rule", "slide", "shape").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("note")).alias("notes"))


def verdict(blockers: Column, majors: Column) -> Column:
    return F.when(blockers > 0, "do not send").when(majors > 0, "review first").otherwise("send")


def digest_tree(rows: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """keys, digest: one digest over a payload's digests (position, digest), in order of their positions.

    Positions are folded by blocks of `width`, and those again, three times before the last fold: no task gathers more
    than `width` rows of a payload while it has fewer than width to the fourth positions, each taken once.
    """

    def fold(df: DataFrame, by: list) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "digest"))), lambda s: F.concat_ws(":", s["position"].cast("string"), s["digest"]))
        return df.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))

    for _ in range(3):
        rows = fold(rows.withColumn("block", F.floor(F.col("position") / width).cast("long")), [*keys, "block"]).withColumnRenamed("block", "position")
    return fold(rows, keys)


def actions(findings: DataFrame, by: Column) -> DataFrame:
    """Findings as decisions, one row for each remedy `by`: action, worst, findings, slides; `in_order` sorts them."""
    worst = F.min(rank(F.col("severity"), SEVERITIES)).cast("int")
    return findings.groupBy(by.alias("action")).agg(worst.alias("worst"), F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("slide")).alias("slides"))


def in_order(decisions: DataFrame) -> DataFrame:
    """Worst first, then those that settle most findings, then by name."""
    return decisions.orderBy("worst", F.desc("findings"), "action")


def questions(findings: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, band, impact: the `most` open questions to ask first, by severity and by how many findings an answer settles."""
    asked = findings.groupBy(*keys, rank(F.col("severity"), SEVERITIES).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("impact"))
    return asked.orderBy("band", F.desc("impact"), *keys).limit(most)


def top_per_group(counted: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; the ranking window keeps no more than those of a partition before its shuffle."""
    return counted.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__nth") <= most).drop("__nth")


def scored(found: DataFrame, seeded: DataFrame, key: str) -> DataFrame:
    """caught, missed, false_positives of found keys against the seeded ones."""
    both = found.select(key, F.lit(1).alias("__f")).join(seeded.select(key, F.lit(1).alias("__s")), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    f, s = F.col("__f").isNotNull(), F.col("__s").isNotNull()
    return both.agg(n(f & s).alias("caught"), n(~f).alias("missed"), n(~s).alias("false_positives"))


def outbound_log(parts: DataFrame, payload: str, order: list[str], text: str) -> DataFrame:
    """What would leave, recorded without its text: its length and digest, and its place in the payload."""
    n = F.row_number().over(Window.partitionBy(payload).orderBy(*order, text))
    return parts.select(payload, *order, F.length(text).cast("long").alias("characters"), F.sha2(text, 256).alias("digest"), n.alias("record"))
