"""Redaction: detect, resolve overlaps, rewrite with stable placeholders, scan for residue, verify, restore.

A payload is what leaves together (a deck, a request); its texts are its parts. Detected names are looked for again
everywhere in their payload, where they stand bare, by a join on their first word, so a text only meets terms of its own
payload whose first word it holds.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import identifying
from tallyframe.storage import release, sealed

INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
PLACEHOLDER = r"\[[A-Z]+_[0-9]+\]"
WORD = r"[\p{L}\p{N}]+"


def visible(text: Column) -> Column:
    """Without soft hyphens and zero-width characters, which would hide a name from every pattern."""
    return F.translate(text, INVISIBLE, "")


def detect(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """array of (kind, start, end, text) of all detectors' matches, overlaps included; null counts as empty."""
    wanted = tuple(k for k in identifying.DETECTORS if kinds is None or k in kinds)

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([identifying.spans_of(x or "", wanted) for x in texts.to_pylist()], SPANS_ARROW)

    return F.arrow_udf(find, SPANS)(text)


def resolve(spans: Column) -> Column:
    """Spans with start and end, without overlaps: by start and falling length; a span that starts before the reach goes,
    unless it begins with the last kept one and reaches further. A dropped span does not extend the reach."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        fits = (F.size(kept) == 0) | (s["start"] >= last["end"])
        swap = (s["end"] > last["end"]) & (s["start"] <= last["start"])
        return F.when(fits, F.array_append(kept, s)).when(swap, F.array_append(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), s)).otherwise(kept)

    return F.aggregate(ordered, F.filter(spans, lambda s: F.lit(False)), step)


def _filled(text: str | None, spans: list[dict] | None, put: list[str]) -> str | None:
    """text with the spans, in order and without overlaps, replaced by what is put for each."""
    if text is None:
        return None
    pieces, at = [], 0
    for s, p in zip(spans or (), put, strict=True):
        pieces += text[at : s["start"]], p
        at = s["end"]
    return "".join(pieces) + text[at:]


def put(text: Column, spans: Column) -> Column:
    """text with every span's stretch replaced by its `put`; spans in order and without overlaps."""

    def fill(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.array([_filled(x, found, [s["put"] for s in found or ()]) for x, found in zip(texts.to_pylist(), spans_.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(fill, "string")(text, spans)


def rewrite(text: Column, spans: Column) -> Column:
    """Each span replaced by [KIND_n], n by first appearance among the distinct terms of its kind in this text."""

    def fill(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        out = []
        for x, found in zip(texts.to_pylist(), spans_.to_pylist(), strict=True):
            numbers: dict[str, dict[str, int]] = {}
            put_ = []
            for s in found or ():
                mine = numbers.setdefault(s["kind"], {})
                put_.append(f"[{s['kind'].upper()}_{mine.setdefault(s['text'], len(mine) + 1)}]")
            out.append(_filled(x, found, put_))
        return pa.array(out, pa.string())

    return F.arrow_udf(fill, "string")(text, resolve(spans))


def residue(text: Column) -> Column:
    """struct of what still looks identifying: at-signs, URLs and runs of nine or more digits."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(count("@").alias("at_signs"), count(r"(?i)https?://|www\.").alias("urls"), count(r"\d{9,}").alias("digit_runs"))


def unusual_words(texts: DataFrame, ordinary: DataFrame) -> DataFrame:
    """payload, word, n: capitalised words of the texts (payload, text) that `ordinary` (word, lower case) does not hold.

    Placeholders, one-letter words and Roman numerals are none; the dictionary is joined, not collected.
    """
    bare = F.regexp_replace("text", PLACEHOLDER, " ")
    words = texts.select("payload", F.explode(F.regexp_extract_all(bare, F.lit(r"\p{Lu}\p{L}*\p{Ll}\p{L}*"), F.lit(0))).alias("word")).groupBy("payload", "word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("low", F.lower("word")).join(ordinary.select(F.lower("word").alias("low")).distinct(), "low", "left_anti").select("payload", "word", "n")


def merge_names(names: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, name, merged: the longest other name of the same keys that begins with this one as whole words, else itself.

    Each name offers its word prefixes, so this is an equi-join and not a comparison of all pairs.
    """
    words, on = F.split(F.col(name), " "), [*keys, name]
    prefixes = names.select(*keys, F.col(name).alias("long"), F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias(name))
    best = prefixes.where(F.col(name) != F.col("long")).groupBy(*on).agg(F.min_by("long", F.struct(-F.length("long"), F.col("long"))).alias("long"))
    return names.join(best, on, "left").select(*on, F.coalesce("long", F.col(name)).alias("merged"))


def assemble_terms(*sources: DataFrame) -> DataFrame:
    """term, source: ordered union, the first source that has a term wins."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("term", F.lit(k).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("term IS NOT NULL").groupBy("term").agg(F.min("source").alias("source"))


def short_forms(terms: DataFrame) -> DataFrame:
    """terms (payload, kind, term) with form: the term itself, a person's last word, a company of three words or more
    without its last one."""
    words = F.split("term", r"\s+")
    surname = F.when((F.col("kind") == "person") & (F.size(words) > 1) & (F.length(F.element_at(words, -1)) >= 3), F.element_at(words, -1))
    head = F.when((F.col("kind") == "company") & (F.size(words) > 2), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return terms.select("payload", "kind", "term", F.explode(F.array_compact(F.array(F.col("term"), surname, head))).alias("form")).distinct()


def occurrences(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """payload, part, spans: where the forms (payload, kind, term, form) stand as whole words, in either case, with any white
    space between their words. A form without a letter or digit is found nowhere."""
    first = F.regexp_extract(F.lower("form"), WORD, 0)
    keyed = forms.withColumn("first", first).where("first <> ''")
    words = texts.select("payload", "part", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("first"))
    near = words.join(keyed, ["payload", "first"]).groupBy("payload", "part").agg(F.collect_set(F.struct("kind", "term", "form")).alias("forms"))

    def find(texts_: pa.Array, forms_: pa.Array) -> pa.Array:
        out = []
        for x, wanted in zip(texts_.to_pylist(), forms_.to_pylist(), strict=True):
            longest = sorted(wanted, key=lambda f: (-len(f["form"]), f["form"], f["kind"], f["term"]))
            any_of = "|".join(r"\s+".join(map(re.escape, f["form"].split())) for f in longest)
            mine = {" ".join(f["form"].lower().split()): f for f in reversed(longest)}
            hits = re.finditer(rf"(?<!\w)(?:{any_of})(?!\w)", x or "", re.IGNORECASE)
            spans = ((m, mine.get(" ".join(m.group().lower().split()))) for m in hits)
            out.append([{"kind": f["kind"], "start": m.start(), "end": m.end(), "text": f["term"]} for m, f in spans if f])
        return pa.array(out, SPANS_ARROW)

    return texts.join(near, ["payload", "part"]).select("payload", "part", F.arrow_udf(find, SPANS)(F.col("text"), F.col("forms")).alias("spans"))


class Redacted(NamedTuple):
    texts: DataFrame  # payload, part, text
    terms: DataFrame  # payload, placeholder, kind, term, occurrences; never leaves
    scratch: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Delete what was written on the way. texts and terms can't be read after it."""
        release(*self.scratch)


def redact(texts: DataFrame, listed: DataFrame | None = None, allowed: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> Redacted:
    """texts (payload, part, text; part unique in its payload) without what identifies.

    listed (payload, kind, term) is replaced too; allowed (term) is left alone. Case tells no terms apart: the first
    spelling in the payload is the one that is kept for `restore`. Placeholders are numbered by
    kind and first appearance in their payload; a name that begins a longer one of its kind shares its placeholder. Null
    texts stay null; an empty table gives empty ones. What is found is written encrypted before the later steps read it, and deleted by `close`.
    """
    seen = texts.select("payload", "part", visible(F.col("text")).alias("text"))
    found = seen.select("payload", "part", F.explode(detect(F.col("text"), kinds)).alias("s")).select("payload", "s.kind", F.regexp_replace("s.text", r"\s+", " ").alias("spelling"), F.struct("part", F.col("s.start").alias("start")).alias("at"))
    found = found.withColumn("term", F.lower("spelling")).groupBy("payload", "kind", "term").agg(F.min_by("spelling", "at").alias("spelling"))
    if allowed is not None:
        found = found.join(allowed.select(F.lower("term").alias("term")).distinct(), "term", "left_anti").select("payload", "kind", "term", "spelling")
    if listed is not None:
        theirs = listed.where("trim(term) <> ''").select("payload", "kind", F.lower("term").alias("term"), F.col("term").alias("spelling"))
        found = found.unionByName(theirs).groupBy("payload", "kind", "term").agg(F.min("spelling").alias("spelling"))
    found = sealed(found, "redacted-terms")
    full = merge_names(found, "term", ("payload", "kind"))
    hits = sealed(occurrences(seen, short_forms(found)), "redacted-spans")
    kept = hits.select("payload", "part", F.explode(resolve(F.col("spans"))).alias("s")).select("payload", "part", "s.kind", "s.start", "s.end", F.col("s.text").alias("term"))
    kept = kept.join(full, ["payload", "kind", "term"])
    order = Window.partitionBy("payload", "kind").orderBy("first", "merged")
    numbered = kept.groupBy("payload", "kind", "merged").agg(F.min(F.struct("part", "start")).alias("first"), F.count(F.lit(1)).alias("occurrences"))
    numbered = numbered.withColumn("placeholder", F.concat(F.lit("["), F.upper("kind"), F.lit("_"), F.row_number().over(order).cast("string"), F.lit("]")))
    spans = kept.join(numbered.select("payload", "kind", "merged", "placeholder"), ["payload", "kind", "merged"]).groupBy("payload", "part").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("put")))).alias("spans"))
    out = seen.join(spans, ["payload", "part"], "left").select("payload", "part", put(F.col("text"), F.col("spans")).alias("text"))
    spelt = found.select("payload", "kind", F.col("term").alias("merged"), "spelling")
    return Redacted(out, numbered.join(spelt, ["payload", "kind", "merged"]).select("payload", "placeholder", "kind", F.col("spelling").alias("term"), "occurrences"), (found, hits))


def verify(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """payload, part, term that still stand in the texts, read with means of its own: both sides as lower-case words between
    blanks, and no detector, no visible form and no span of the redaction."""
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    sought = terms.select("payload", "term", flat("term").alias("flat")).where("trim(flat) <> ''").withColumn("word", F.element_at(F.split(F.trim("flat"), " "), -1))
    shown = texts.select("payload", "part", flat("text").alias("said"))
    words = shown.select("payload", "part", "said", F.explode(F.array_distinct(F.split(F.trim("said"), " "))).alias("word"))
    return words.join(sought, ["payload", "word"]).where(F.contains("said", "flat")).select("payload", "part", "term").distinct()


def restore(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """answers (payload, text) with the placeholders of their payload replaced by the terms; unknown ones stay."""
    known = terms.groupBy("payload").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "term"))).alias("known"))
    gaps, marks = F.split("text", PLACEHOLDER, -1), F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))
    said = F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(F.try_element_at(F.col("known"), m), m, F.lit(""))))
    return answers.join(known, "payload", "left").withColumn("text", F.array_join(said, "")).drop("known")


def may_leave(payloads: DataFrame, leaks: DataFrame, residues: DataFrame, approved: DataFrame) -> DataFrame:
    """payloads (payload, digest) that may be sent: no leak, and no residue unless exactly this digest was approved."""
    clean = payloads.join(leaks.select("payload").distinct(), "payload", "left_anti")
    doubtful = residues.select("payload").distinct().withColumn("doubtful", F.lit(True))
    agreed = approved.select("payload", "digest").distinct().withColumn("agreed", F.lit(True))
    return clean.join(doubtful, "payload", "left").join(agreed, ["payload", "digest"], "left").where("doubtful IS NULL OR agreed").select("payload", "digest")
