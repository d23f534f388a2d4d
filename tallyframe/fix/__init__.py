"""Fix plan: findings grouped into decisions. Writing files is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans import audit

# Which rules a machine may put right, and how. Two stated figures are never among them.
OPERATIONS = {"BR-004": "recolour", "BR-011": "recolour", "BR-005": "retype", "HY-002": "drop notes", "HY-004": "drop property", "HY-005": "drop comments", "TY-001": "requote", "TY-002": "respace", "TY-005": "rename", "CO-003": "restate", "CO-004": "restate", "CO-005": "restate", "CO-006": "restate", "CO-007": "restate"}


def operation(rule: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    return F.try_element_at(known, rule)


def plan_fixes(result: DataFrame) -> DataFrame:
    """One row for each (deck, operation, payload): its slides, findings, worst severity. Rules with one remedy share a row."""
    fixes = result.where("outcome = 'finding'").withColumn("operation", operation(F.col("rule"))).where("operation IS NOT NULL")
    worst = F.min(audit.rank(F.col("severity"), audit.SEVERITIES))
    names = F.array(*[F.lit(x) for x in audit.SEVERITIES])
    return fixes.groupBy("deck_id", "operation", F.coalesce("measured", F.lit("")).alias("payload"), F.coalesce("expected", F.lit("")).alias("replacement")).agg(F.array_sort(F.collect_set("slide_index")).alias("slides"), F.count(F.lit(1)).alias("findings"), F.get(names, worst - 1).alias("severity"))
