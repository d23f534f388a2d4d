"""A reviewer's replies: read by schema, each quote located in the payload that was sent, what cannot be used kept with its reason.

Cases: a reply that is null, no JSON, or without a list of findings is one rejected row; fences around the JSON are taken
off; findings that repeat word for word count once; white space does not tell quotes apart; an empty list is a valid answer.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "findings array<struct<quote: string, other: string, other_slide: int, explanation: string>>"


class Reviewed(NamedTuple):
    found: DataFrame  # payload, place (of the reply), quote, part, other, other_part, explanation
    rejected: DataFrame  # payload, place, reason, quote


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def located(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (payload, id, quote) with the first part (payload, part, text) that holds the quote; null where none does.

    A quote meets only parts that hold its longest word, so this is an equi-join before it is a search.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    longest = F.try_element_at(F.array_sort(F.transform(tokens("quote"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), F.lit(-1))["w"]
    asked = quotes.select("payload", "id", _flat(F.col("quote")).alias("quote")).withColumn("word", longest).where("word IS NOT NULL")
    said = texts.select("payload", "part", _flat(F.col("text")).alias("text"))
    words = said.select("payload", "part", "text", F.explode(F.array_distinct(tokens("text"))).alias("word"))
    hits = asked.join(words, ["payload", "word"]).where(F.contains("text", "quote")).groupBy("payload", "id").agg(F.min("part").alias("part"))
    return quotes.join(hits, ["payload", "id"], "left")


def review(replies: DataFrame, texts: DataFrame) -> Reviewed:
    """replies (payload, reply), texts (payload, part, text) as they were sent."""
    bare = F.regexp_replace(F.trim("reply"), r"^```[a-zA-Z]*\s*|\s*```$", "")
    read = replies.select("payload", F.from_json(bare, REPLY).alias("r"), F.get_json_object(bare, "$.findings").alias("listed"), F.get_json_object(bare, "$").alias("whole"))
    reason = F.when(F.col("whole").isNull(), "no JSON").when(F.col("listed").isNull() | ~F.startswith(F.col("listed"), F.lit("[")), "no list of findings").when(F.col("r.findings").isNull(), "findings of another form")
    told = read.withColumn("reason", reason)
    unread = told.where("reason IS NOT NULL").select("payload", F.lit(None).cast("int").alias("place"), "reason", F.lit(None).cast("string").alias("quote"))
    entries = told.where("reason IS NULL").select("payload", F.posexplode("r.findings").alias("place", "f")).select("payload", "place", "f.*")
    same = ["payload", "quote", "other", "other_slide", "explanation"]
    once = entries.groupBy(*same).agg(F.min("place").alias("place"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    once = once.withColumn("id", F.col("place")).withColumn("other", F.when(~blank("other"), F.col("other")))
    mine = located(once.where(~blank("quote")).select("payload", "id", "quote"), texts).select("payload", "id", "part")
    theirs = located(once.where("other IS NOT NULL").select("payload", "id", F.col("other").alias("quote")), texts).select("payload", "id", F.col("part").alias("other_part"))
    met = once.join(mine, ["payload", "id"], "left").join(theirs, ["payload", "id"], "left")
    wrong = F.when(blank("quote"), "no quote").when(F.col("part").isNull(), "quote not in the payload").when(F.col("other").isNotNull() & F.col("other_part").isNull(), "other side not in the payload").when(blank("explanation"), "no explanation")
    judged = met.withColumn("reason", wrong)
    found = judged.where("reason IS NULL").select("payload", "place", "quote", "part", "other", "other_part", "explanation")
    return Reviewed(found, unread.unionByName(judged.where("reason IS NOT NULL").select("payload", "place", "reason", "quote")))
