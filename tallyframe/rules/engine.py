"""Rule registry and the check: select, gate by what a rule needs, run, keep what was not checked apart."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import joins
from tallyframe.plans import audit
from tallyframe.schemas import OUTCOMES
from tallyframe.storage import written

KEYS = ["deck_id", "slide_index", "uid"]


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    confidence: str
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] = ()
    default: bool = True


RULES: dict[str, Rule] = {}


def rule(id_: str, severity: str, confidence: str = "high", needs: tuple[str, ...] = (), default: bool = True) -> Callable:
    """Register a function of (tables, profile) that returns outcome rows."""
    category = {"BR": "brand", "LO": "layout", "TY": "typography", "HY": "hygiene", "CH": "chart", "CO": "consistency"}[id_[:2]]

    def add(f: Callable) -> Callable:
        RULES[id_] = Rule(id_, category, severity, confidence, f, needs, default)
        return f

    return add


def outcomes(df: DataFrame, message: Column | str, measured: Column | None = None, expected: Column | str | None = None, outcome: Column | str = "finding", confidence: Column | None = None) -> DataFrame:
    """df's keys (deck-level rows have slide 0) with what was found; confidence only where it differs from the rule's."""
    have = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(0 if c == "slide_index" else None).cast(t)
    text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string") if isinstance(x, Column) else F.lit(x)
    return df.select(F.col("deck_id"), have("slide_index", "int").alias("slide_index"), have("uid", "int").alias("uid"), text(outcome).alias("outcome"), text(message).alias("message"), text(measured).alias("measured"), text(expected).alias("expected"), text(confidence).alias("sure"))


def lookup(profile: dict, path: str):
    for part in path.split("."):
        profile = profile.get(part) if isinstance(profile, dict) else None
    return profile


def select_rules(include: list[str] | None = None, exclude: list[str] | None = None, disabled: list[str] | None = None) -> list[Rule]:
    """By glob, in order of id. A rule that is off by default runs only if named exactly."""
    out = []
    for id_, r in sorted(RULES.items()):
        named = include is None or any(fnmatch.fnmatch(id_, g) for g in include)
        if named and (r.default or id_ in (include or ())) and id_ not in (disabled or ()) and not any(fnmatch.fnmatch(id_, g) for g in exclude or ()):
            out.append(r)
    return out


def check(
    tables: dict[str, DataFrame], profile: dict | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
    accepted: DataFrame | None = None, intended: DataFrame | None = None, severity: str | None = None,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(outcome rows of all rules that could run, [(rule, missing input or error)] of those that could not).

    accepted: (rule, slide, shape) rows, null or empty for any; what they cover becomes `excused`. intended: declared
    (signature) rows; a finding whose signature is declared becomes `excused` too. severity: the least severe findings
    to keep. A rule that cannot be planned is reported by name and stops no other.
    """
    profile = profile or {}
    frames, skipped = [], []
    for r in select_rules(include, exclude, lookup(profile, "rules.disabled")):
        missing = [n for n in r.needs if lookup(profile, n) in (None, [], {})]
        if missing:
            skipped.append((r.id, missing[0]))
            continue
        stated = (lookup(profile, "rules.severity") or {}).get(r.id, r.severity)
        tag = {"rule": r.id, "category": r.category, "severity": stated}
        try:
            sure = F.coalesce(F.col("sure"), F.lit(r.confidence)).alias("confidence")
            frames.append(r.run(tables, profile).select(*[F.lit(v).alias(k) for k, v in tag.items()], sure, "outcome", *KEYS, "message", "measured", "expected"))
        except (PySparkException, AttributeError, KeyError, TypeError, ValueError) as error:  # a profile or table that the rule cannot read
            skipped.append((r.id, f"failed: {type(error).__name__}"))
    if not frames:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], OUTCOMES), skipped
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    result = signed(result, tables)
    if accepted is not None or intended is not None:
        result = written(result, "outcomes")  # read several times below; all rules run once
    if accepted is not None:
        result = excuse_accepted(result, tables, accepted)
    if intended is not None:
        result = excuse_declared(result, intended)
    if severity is not None:
        result = result.where((F.col("outcome") != "finding") | (audit.rank(F.col("severity"), audit.SEVERITIES) <= audit.SEVERITIES.index(severity) + 1))
    return result, skipped


def signed(result: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """result with `signature`. A figure is told by what is said of it and not by the box its table stands in."""
    sides = ("left_pt", "top_pt", "width_pt", "height_pt")
    boxes = tables["shapes"].select(*KEYS, *[F.col(c).alias(f"box_{c}") for c in sides])
    placed = [F.when(F.col("category") != "consistency", F.col(f"box_{c}")) for c in sides]
    named = [F.when(F.col("category") == "consistency", F.col("message"))]
    what = audit.stated(F.concat_ws("|", F.col("rule"), *named), F.col("measured"), F.col("expected"), placed, F.col("message"))
    return result.join(boxes, KEYS, "left").withColumn("signature", what).select(*result.columns, "signature")


def excuse_accepted(result: DataFrame, tables: dict[str, DataFrame], accepted: DataFrame) -> DataFrame:
    """Findings that an acceptance covers become `excused`."""
    names = tables["shapes"].select(*KEYS, F.col("name").alias("shape"))
    open_ = result.where("outcome = 'finding'").join(names, KEYS, "left").withColumn("slide", F.col("slide_index"))
    left = joins.unsuppressed(open_, accepted)
    covered = open_.exceptAll(left).withColumn("outcome", F.lit("excused"))
    return result.where("outcome <> 'finding'").unionByName(left.unionByName(covered).select(*result.columns))


def excuse_declared(result: DataFrame, intended: DataFrame) -> DataFrame:
    """A finding is excused only if every one of its lines is declared; a finding here has the one line of its signature."""
    found = result.where("outcome = 'finding'").select("signature").distinct()
    whole = joins.fully_declared(found.withColumn("finding", F.col("signature")), intended, "finding", "signature").select(F.col("finding").alias("signature"), F.lit(1).alias("declared"))
    return result.join(whole, "signature", "left").withColumn("outcome", F.when((F.col("outcome") == "finding") & (F.col("declared") == 1), "excused").otherwise(F.col("outcome"))).select(*result.columns)


def rules(tables_of_rules: dict[str, Rule] | None = None) -> list[dict]:
    """The catalogue as rows: id, category, severity, confidence, whether it runs by default, what it needs."""
    listed = RULES if tables_of_rules is None else tables_of_rules
    return [{"id": r.id, "category": r.category, "severity": r.severity, "confidence": r.confidence, "default": r.default, "needs": list(r.needs)} for _, r in sorted(listed.items())]


def located(result: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Outcome rows with the name and box of the shape they speak of; slide and deck rows keep nulls."""
    shapes = tables["shapes"].select(*KEYS, F.col("name").alias("shape"), *[F.col(f"{c}_pt").alias(c) for c in ("left", "top", "width", "height")])
    return result.join(shapes, KEYS, "left")


def exit_status(result: DataFrame, fail_on: str = "blocker", confidence: str = "medium") -> int:
    """1 if the gate is exceeded, else 0."""
    return int(not audit.exceeds(result.where("outcome = 'finding'"), fail_on, confidence).isEmpty())


def report(result: DataFrame) -> DataFrame:
    """Findings in reading order: deck, slide, severity, rule."""
    return result.where("outcome = 'finding'").orderBy("deck_id", "slide_index", audit.rank(F.col("severity"), audit.SEVERITIES), "rule", "uid", "message")
