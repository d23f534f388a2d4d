"""Figures stated in running text, bound to the metrics that the deck's own tables and charts use.

A number of a sentence is a fact only where a known metric stands right beside it, or where an earlier number of the
sentence is bound and this one has its unit ("up from $1,352m"). It takes the period nearest to it, and the kind of claim
that the words within reach make. Anything else is left out.

Words are rows. A text's words meet the first words of the deck's labels in an equi-join, and the texts that hold a
label are cut into tokens with places. Running counts of the tokens that separate, and the last label, period and bound
number before a token (after it: the same over descending places), then say what stands beside what. All of it is keyed
by text and sentence; only the scan for periods leaves the JVM.

Cases: texts and labels that are null or empty give nothing; rows repeated in place and text count once; labels that
overlap are taken longest first, then leftmost; numbers within a label, bare years and both ends of a range are no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import numbers, periods

# Words that say what a figure claims, how far they may stand from it, and what may stand between it and its metric.
CHANGE = "up down grew grow grows growing growth rose rise rises rising fell fall falls falling increase increased increases increasing decrease decreased decreases decline declined declines declining improvement improved improving expansion expanded contraction contracted uplift higher lower by yoy y/y year-on-year change changed".split()
RATE = "cagr p.a. pa annually annualised annualized per".split()
STATE = "to from reached reaching totalled totaled totalling totaling amounted".split()
CLAUSE_END = "in for during between on at over versus vs vs. against than compared and while whereas but which with".split()
CONNECTING = "of was were is are at to the a an in for from on by up down reached grew rose fell stood totalled totaled amounted approximately circa c. about around some broadly".split()
RANGE = "- – — to through and".split()
REACH = 4

LIGHT = [",", ":", "=", "(", ")"]  # separate nothing
BREAKS = [",", ";", ":", "(", ")"]  # end the reach of a word
MARK = "\u0001"  # encloses the name of a period in a marked sentence
DOTTED = sorted({w for w in CHANGE + RATE + STATE + CLAUSE_END + CONNECTING if w.endswith(".")})
WORD = "|".join([rf"(?:{'|'.join(w.replace('.', '[.]') for w in DOTTED)})(?!\w)", r"[\p{L}_][\p{L}\p{N}_]*(?:[./-][\p{L}][\p{L}\p{N}_]*)*", r"[\p{L}\p{N}_]+"])
TOKEN = rf"(?s)(?:{MARK}[^{MARK}]*{MARK}|{numbers.PROSE_NUMBER}|{WORD}|.)\s?"
SENTENCE = r"\n+|(?<=[.!?])\s+(?![\p{Ll}\p{N}])"

PLACE = ["deck", "slide", "uid", "para"]
TEXT = [*PLACE, "body"]
MENTION = "struct<start:int,size:int,metric:string,kind:string>"


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, rf"(?U)[\s{MARK}]+", " ")))


def _tokens(folded: Column) -> Column:
    """Tokens that cover a folded text, each with the space behind it."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def _words(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.trim(t))


def _first_words(text: Column) -> Column:
    return F.filter(F.split(_folded(text), r"(?U)\W+"), lambda w: w != "")


def _marked(folded: Column, spans: Column) -> Column:
    """A sentence with each period's text replaced by its name between marks."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(folded, a["at"] + 1, x["start"] - a["at"]), F.lit(MARK), x["period"], F.lit(MARK)).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(folded, a["at"] + 1, F.length(folded))))


def _mentions(words: Column, known: Column) -> Column:
    """Where known labels stand among words, without overlaps: the longest first, then the leftmost."""

    def places(label: Column) -> Column:
        n = F.size(label["words"])
        here = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n) == label["words"])
        return F.transform(here, lambda i: F.struct((-F.length(label["metric"])).alias("rank"), (i - 1).alias("start"), n.alias("size"), label["metric"].alias("metric"), label["kind"].alias("kind")))

    clash = lambda m: lambda x: (x["start"] < m["start"] + m["size"]) & (m["start"] < x["start"] + x["size"])
    take = lambda taken, m: F.when(F.exists(taken, clash(m)), taken).otherwise(F.concat(taken, F.array(m.dropFields("rank"))))
    return F.aggregate(F.array_sort(F.flatten(F.transform(known, places))), F.array().cast(f"array<{MENTION}>"), take)


def tokens_of(paragraphs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row for each token of a text that may hold a label: TEXT, sent, at, token, mention (of the label it lies in)."""
    named = vocabulary.select("deck", _folded(F.col("metric")).alias("metric"), "kind").distinct()
    named = named.withColumn("words", _words(_tokens(F.col("metric")))).withColumn("word", F.get(_first_words(F.col("metric")), F.lit(0))).where("word IS NOT NULL")
    texts = paragraphs.where("text rlike '[0-9]'").select(*PLACE, F.xxhash64("text").alias("body"), "text")
    texts = texts.groupBy(*TEXT).agg(F.first("text").alias("text"))
    said = texts.select(*TEXT, F.explode(F.array_distinct(_first_words(F.col("text")))).alias("word"))
    known = said.join(named, ["deck", "word"]).groupBy(*TEXT).agg(F.collect_set(F.struct("words", "metric", "kind")).alias("known"))
    sentences = texts.join(known, TEXT).select(*TEXT, "known", F.posexplode(F.split("text", SENTENCE)).alias("sent", "sentence")).withColumn("sentence", _folded(F.col("sentence"))).where("sentence rlike '[0-9]'")
    marked = sentences.withColumn("spans", periods.period_spans("sentence")).withColumn("tokens", _tokens(_marked(F.col("sentence"), F.col("spans"))))
    marked = marked.withColumn("words", _words(F.col("tokens"))).withColumn("mentions", _mentions(F.col("words"), F.col("known")))
    within = lambda i: lambda m: (m["start"] <= i) & (i < m["start"] + m["size"])
    placed = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.get(F.filter("mentions", within(i)), F.lit(0)).alias("mention")))
    # An outer explode: of an inner one Spark infers a filter, and pushing it down computes tokens and mentions twice.
    rows = marked.select(*TEXT, "sent", F.posexplode_outer(F.when(F.size("mentions") > 0, placed)).alias("at", "t")).where("t IS NOT NULL")
    return rows.select(*TEXT, "sent", "at", "t.*")


def _read(tokens: DataFrame) -> DataFrame:
    """tokens with word, period (name), number (value, decimals and unit, of tokens that are figures) and whether each separates."""
    word = F.trim("token")
    part = lambda k: F.regexp_extract(word, numbers.PROSE_NUMBER, k)
    period = F.when(word.startswith(MARK), F.replace(word, F.lit(MARK), F.lit("")))
    figure = word.rlike(rf"^(?:{numbers.PROSE_NUMBER})$") & ~word.rlike(numbers.YEAR) & F.col("mention").isNull()
    size = F.concat_ws(".", F.replace(part(4), F.lit(","), F.lit("")), F.when(part(5) != "", part(5))).cast("double")
    negative = (part(3) != "") & ((part(1) == "") | (part(7) == ""))
    unit = numbers.unit_of(F.struct(part(6).alias("suffix"), part(2).alias("currency")))
    number = F.when(figure, F.struct(F.when(negative, -size).otherwise(size).alias("value"), F.length(part(5)).alias("decimals"), unit["quantity"].alias("quantity"), unit["scale"].alias("scale"), unit["currency"].alias("currency")))
    light = F.col("mention").isNull() & (period.isNotNull() | word.isin(*CONNECTING, *LIGHT))
    return tokens.withColumn("word", word).withColumn("period", period).withColumn("number", number).withColumn("bars", F.when(light, 0).otherwise(1))


def _placed(read: DataFrame) -> DataFrame:
    """For each token: what has passed before it (`passed` separating tokens, `start` characters), the labels and periods
    on either side, the words within reach, and whether it is an end of a range.

    A label is read at its last word. Nothing separates two places where `passed` is the same.
    """
    sentence = [*TEXT, "sent"]
    forth, back = Window.partitionBy(*sentence).orderBy("at"), Window.partitionBy(*sentence).orderBy(F.desc("at"))
    earlier, later = forth.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda what, over: F.last(what, ignorenulls=True).over(over)
    rows = read.withColumn("passed", F.coalesce(F.sum("bars").over(earlier), F.lit(0))).withColumn("start", F.coalesce(F.sum(F.length("token")).over(earlier), F.lit(0)))
    ends = F.col("at") == F.col("mention.start") + F.col("mention.size") - 1
    rows = rows.withColumn("label", F.when(ends, F.struct("mention.metric", "mention.kind", F.col("mention.start").alias("at"), (F.col("passed") - F.col("mention.size") + 1).alias("opens"), (F.col("passed") + 1).alias("closes"))))
    outer = seen(F.col("label"), earlier)
    rows = rows.withColumn("outer", outer).withColumn("label", F.when(F.col("label").isNotNull(), F.struct("label.*", F.when(F.col("outer.closes") == F.col("label.opens"), F.col("outer.metric")).otherwise("").alias("scope"))))
    time = F.when(F.col("period").isNotNull(), F.struct("period", "start", (F.col("start") + F.length("word")).alias("end")))
    sign = F.struct("word", (F.col("number").isNotNull() | F.col("period").rlike("[0-9]") | F.col("word").isin(*BREAKS) | F.col("word").rlike(r"^\p{N}")).alias("breaks"), F.col("word").rlike(rf"^[\p{{L}}_{MARK}]").alias("speaks"))
    reach = 3 * REACH
    a_range = lambda over: F.lead("word", 1).over(over).isin(*RANGE) & F.lead("number.quantity", 2).over(over).eqNullSafe(F.col("number.quantity")) & F.lead("number.value", 2).over(over).isNotNull()
    return (
        rows.withColumn("time", time)
        .withColumn("sign", sign)
        .select(
            *sentence, "at", "word", "start", "passed", "number",
            seen(F.col("label"), earlier).alias("left"), seen(F.col("time"), earlier).alias("past"), F.collect_list("sign").over(forth.rowsBetween(-reach, -1)).alias("behind"), a_range(forth).alias("opens_range"),
            seen(F.col("label"), later).alias("right"), seen(F.col("time"), later).alias("next"), F.collect_list("sign").over(back.rowsBetween(-reach, -1)).alias("ahead"), a_range(back).alias("closes_range"),
        )
    )


def _within_reach(near: str, stops: list[str]) -> Column:
    """Of words next to a number, nearest first, those before the first that ends the reach."""
    stop = F.array_position(F.transform(near, lambda s: s["breaks"] | s["word"].isin(*stops)), True).cast("int")
    return F.transform(F.slice(near, F.lit(1), F.when(stop > 0, stop - 1).otherwise(REACH)), lambda s: s["word"])


def _with_kind(bound: DataFrame) -> DataFrame:
    """bound with claim, or the reason why there is none: a rate word in reach; "of" after a percentage (a share, unless
    the whole is the metric itself: then the part is not named); a change word in reach; the label's kind; the unit."""
    nearest = lambda signs: F.slice(F.filter(F.reverse(signs), lambda s: s["speaks"] | s["breaks"]), 1, REACH)
    rows = bound.withColumn("behind", nearest("behind")).withColumn("ahead", nearest("ahead"))
    rows = rows.withColumn("beside", F.concat(_within_reach("behind", STATE), _within_reach("ahead", CLAUSE_END)))
    says = lambda words: F.arrays_overlap("beside", F.array(*map(F.lit, words)))
    shared = (F.col("number.quantity") == "%") & (F.get("ahead", F.lit(0))["word"] == "of")
    unnamed = (F.col("right.at") == F.col("at") + 2) & (F.col("right.metric") == F.col("bound.metric"))
    unit = F.when(F.col("number.quantity") == "x", "ratio").when(F.col("number.quantity").isNull() & F.col("number.currency").isNotNull(), "level")
    rows = rows.withColumn("part", F.when(shared, F.when(unnamed, "unnamed").otherwise("named")))
    claim = F.when(says(RATE), "rate").when(F.col("part") == "unnamed", F.lit(None)).when(F.col("part") == "named", "share").when(says(CHANGE), "change").otherwise(F.coalesce("bound.kind", unit))
    rows = rows.withColumn("claim", claim)
    return rows.withColumn("reason", F.when(F.col("claim").isNull(), F.when(F.col("part") == "unnamed", "a share of its base that does not say which part").otherwise("nothing around it says what it claims")))


def prose_figures(paragraphs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """paragraphs: deck, slide, uid, para, text; vocabulary: deck, metric, kind. One row for each number that is bound.

    Of two labels side by side, the one beside the number is the metric and the one before it the scope.
    """
    figures = _placed(_read(tokens_of(paragraphs, vocabulary))).where("number IS NOT NULL AND NOT coalesce(opens_range, false) AND NOT coalesce(closes_range, false)")
    beside = lambda c: F.struct(f"{c}.metric", f"{c}.scope", f"{c}.kind")
    direct = F.when(F.col("left.closes") == F.col("passed"), beside("left")).when(F.col("right.opens") == F.col("passed") + 1, beside("right"))
    alike = Window.partitionBy(*TEXT, "sent", "number.quantity", "number.scale").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    bound = figures.withColumn("direct", direct).withColumn("bound", F.last("direct", ignorenulls=True).over(alike)).where("bound IS NOT NULL")
    since, until = F.col("start") - F.col("past.end"), F.col("next.start") - F.col("start") - F.length("word")
    nth = F.row_number().over(Window.partitionBy(*TEXT).orderBy("sent", "at")) - 1
    return _with_kind(bound).select(
        *PLACE, nth.alias("nth"), "bound.metric", "bound.scope", F.when(since > until, F.col("next.period")).otherwise(F.coalesce("past.period", "next.period")).alias("period"),
        F.col("claim").alias("kind"), "number.*", F.col("word").alias("raw"), F.col("reason").alias("unread"),
    )
