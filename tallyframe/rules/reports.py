"""Reports of a check: rows for JSON, an HTML page and text for one deck. Only a report of one deck reaches the driver."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans import audit

VERSION = 1
MOST = 10_000  # findings of one deck that a page or a text lists; what is beyond is counted in the page


def condensed(result: DataFrame) -> DataFrame:
    """What could not be checked, by deck, rule and reason, with how often."""
    return result.where("outcome = 'unchecked'").groupBy("deck_id", "rule", F.col("message").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("slide_index")).alias("slides"))


def _order() -> list[Column]:
    return [F.col("slide_index"), audit.rank(F.col("severity"), audit.SEVERITIES), F.col("rule"), F.col("uid"), F.col("message")]


def json_rows(result: DataFrame) -> DataFrame:
    """deck_id, report: one JSON object a finding, unchecked reason or excuse, and one for the deck's counts. For df.write.text."""
    fields = ["deck_id", "slide_index", "uid", "rule", "category", "severity", "confidence", "outcome", "message", "measured", "expected", "signature"]
    rows = result.select("deck_id", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit("outcome").alias("type"), *fields)).alias("report"))
    n = lambda s: F.count(F.when((F.col("outcome") == "finding") & (F.col("severity") == s), 1)).alias(s)
    other = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    counts = result.groupBy("deck_id").agg(*map(n, audit.SEVERITIES), other("unchecked"), other("excused"))
    counts = counts.withColumn("verdict", audit.verdict(F.col("blocker"), F.col("major")))
    heads = counts.select("deck_id", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit("summary").alias("type"), *[c for c in counts.columns])).alias("report"))
    return rows.unionByName(heads)


def console(result: DataFrame, deck_id: str) -> str:
    """One deck's findings as text, a stanza for each slide."""
    found = result.where((F.col("deck_id") == deck_id) & (F.col("outcome") == "finding")).orderBy(*_order()).limit(MOST).collect()
    lines, slide = [], None
    for r in found:
        if r.slide_index != slide:
            slide = r.slide_index
            lines += ["", f"slide {slide}" if slide else "document"]
        told = f" ({r.measured}; expected {r.expected})" if r.measured and r.expected else f" ({r.measured})" if r.measured else ""
        lines.append(f"  {r.severity:<8} {r.rule}  {r.message}{told}")
    for r in condensed(result.where(F.col("deck_id") == deck_id)).orderBy("rule", "reason").limit(MOST).collect():
        lines.append(f"not checked: {r.rule} {r.reason} ({r.n})")
    return "\n".join(lines).strip() or "no findings"


def page(result: DataFrame, deck_id: str) -> str:
    """One deck's findings as an HTML page without scripts; all text is escaped."""
    mine = result.where(F.col("deck_id") == deck_id)
    found = mine.where("outcome = 'finding'").orderBy(*_order()).limit(MOST).collect()
    total = mine.where("outcome = 'finding'").count()
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    rows = "".join(f'<tr class="{html.escape(r.severity)}">' + "".join(map(cell, (r.slide_index or "", r.severity, r.rule, r.message, r.measured, r.expected))) + "</tr>" for r in found)
    open_ = "".join(f"<li>{html.escape(f'{r.rule}: {r.reason} ({r.n})')}</li>" for r in condensed(mine).orderBy("rule", "reason").limit(MOST).collect())
    head = "".join(f"<th>{x}</th>" for x in ("Slide", "Severity", "Rule", "Finding", "Measured", "Expected"))
    title = html.escape(deck_id)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>{total} findings</p><table><tr>{head}</tr>{rows}</table><h2>Not checked</h2><ul>{open_}</ul></body></html>'
