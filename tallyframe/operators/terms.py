"""Term mining: the names and phrases a house writes, how it spells each, and which stand only inside longer ones.

A phrase is a maximal run of capitalised words with one blank between them. Spellings that agree but for case,
punctuation, accents and spacing share a key, and a key's commonest spelling is its term. Containment of one term in
another is an equi-join: each term offers its shorter runs of words, so no two terms are compared that share nothing.

Cases: null and empty texts have no phrases; runs of more than MOST_WORDS words are headings and no terms; equally common
spellings go to the first in code-point order; a phrase that is all of common words is dropped only where a list of them
is given; keys may be empty (a corpus as a whole) or name a deck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text

# How often a phrase must occur, and its longest.
LEAST, MOST_WORDS = 3, 6
RUN = r"\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)"


def runs(said: Column, least_words: int = 2) -> Column:
    """The capitalised runs of a text that have at least so many words, as they stand."""
    repeat = "*" if least_words < 2 else "{" + str(least_words - 1) + ",}"
    return F.regexp_extract_all(said, F.lit(RUN + repeat), F.lit(0))


def phrases(texts: DataFrame, keys: list[str], text_col: str = "text", slide_col: str | None = None, least_words: int = 2) -> DataFrame:
    """keys, key, form, n, places (slides, or rows where no slide is named): every spelling of every phrase."""
    place = F.col(slide_col) if slide_col else F.monotonically_increasing_id()
    found = texts.select(*keys, place.alias("place"), F.explode(runs(F.col(text_col), least_words)).alias("form")).where(F.size(F.split("form", " ")) <= MOST_WORDS)
    # first by place, so that a phrase which one place repeats is counted before it is shuffled by its form
    by_place = found.groupBy(*keys, "form", "place").agg(F.count(F.lit(1)).alias("n"))
    counted = by_place.groupBy(*keys, "form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
    return counted.withColumn("key", text.canon_key(F.col("form"))).where("key <> ''").select(*keys, "key", "form", "n", "places")


def groups(found: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """keys, key, term, n, forms, variants (the other spellings, sorted), only_case: whether they differ in case alone.

    A key that occurs fewer than `least` times in all is left out.
    """
    by = [*keys, "key"]
    order = F.struct(-F.col("n"), F.col("form"))
    each = found.groupBy(*by).agg(F.sum("n").alias("n"), F.min_by("form", order).alias("term"), F.array_sort(F.collect_set("form")).alias("spelt"), F.count_distinct(F.lower("form")).alias("cased"))
    frequent = each.where(F.col("n") >= least)
    return frequent.select(*by, "term", "n", F.size("spelt").alias("forms"), F.array_remove("spelt", F.col("term")).alias("variants"), (F.col("cased") == 1).alias("only_case"))


def _inner_runs(words: Column) -> Column:
    """All contiguous runs of a list of words that are shorter than it."""
    n = F.size(words)
    lengths = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    per = F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.array_distinct(F.flatten(per))


def drop_subsumed(terms: DataFrame, keys: list[str]) -> DataFrame:
    """terms (keys, key, n) without those whose every occurrence a longer term accounts for: one that contains the words as a
    run, wherever it stands, and occurs at least as often."""
    offered = terms.select(*keys, F.explode(_inner_runs(F.split("key", " "))).alias("key"), F.col("n").alias("longer_n"))
    best = offered.groupBy(*keys, "key").agg(F.max("longer_n").alias("longer_n"))
    return terms.join(best, [*keys, "key"], "left").where("longer_n IS NULL OR longer_n < n").drop("longer_n")


def distinctive(terms: DataFrame, ordinary: DataFrame) -> DataFrame:
    """terms that hold at least one word which the dictionary `ordinary` (word, lower case) does not."""
    words = terms.select("key", F.explode(F.split("key", " ")).alias("word")).distinct()
    rare = words.join(ordinary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").select("key").distinct()
    return terms.join(rare, "key", "left_semi")


def client_words(found: DataFrame, ordinary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word: words of the phrases of three letters or more, not all capitals, that the dictionary does not hold."""
    words = found.select(*keys, F.explode(F.split("form", " ")).alias("word")).where((F.length("word") >= 3) & (F.col("word") != F.upper("word"))).distinct()
    return words.withColumn("low", F.lower("word")).join(ordinary.select(F.lower("word").alias("low")).distinct(), "low", "left_anti").select(*keys, "word")


def with_answers(terms: DataFrame, answers: DataFrame) -> DataFrame:
    """terms with the spelling that an answer (key, term) settles; the spelling it replaces becomes a variant."""
    settled = answers.select("key", F.col("term").alias("answer"))
    met = terms.join(settled, "key", "left")
    changed = F.col("answer").isNotNull() & (F.col("answer") != F.col("term"))
    variants = F.when(changed, F.array_sort(F.array_distinct(F.array_remove(F.array_append("variants", F.col("term")), F.col("answer"))))).otherwise(F.col("variants"))
    return met.withColumn("variants", variants).withColumn("term", F.coalesce("answer", "term")).drop("answer").select(*terms.columns)


def canon(texts: DataFrame, keys: list[str], text_col: str = "text", slide_col: str | None = None, ordinary: DataFrame | None = None, least: int = LEAST, least_words: int = 2) -> DataFrame:
    """The terms of texts: phrases, grouped, distinctive ones only where a dictionary is given, those inside longer ones dropped."""
    found = groups(phrases(texts, keys, text_col, slide_col, least_words), keys, least)
    return drop_subsumed(distinctive(found, ordinary) if ordinary is not None else found, keys)
