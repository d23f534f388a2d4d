"""Reporting periods in labels: one Arrow UDF, since each pattern must see what the earlier ones left."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The spellings of periods and the letters and words of their basis.
BASIS = {"a": "A", "e": "E", "f": "E", "b": "B", "p": "P", "pf": "PF"}
BASIS_WORDS = {"budget": "B", "bud": "B", "plan": "B", "forecast": "E", "fcst": "E", "estimate": "E", "estimated": "E", "actual": "A", "actuals": "A"}
WINDOWS = ("lfy", "ltm", "mtd", "nfy", "ntm", "qtd", "run rate", "run-rate", "ttm", "ytd")
Y = r"(?:19|20)\d{2}"
WORD = "|".join(sorted(BASIS_WORDS, key=len, reverse=True))
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _year(y: str) -> str:
    return y if len(y) == 4 else "20" + y


#: In order of priority. Named groups give the parts of the canonical spelling.
RULES = [
    (rf"\b(?P<w>ltm|ntm|ttm|ytd|mtd|qtd)\s*(?:to\s+)?(?P<m>{MONTHS})[a-z]*\.?[\s\-'/]*(?P<y>{Y}|\d{{2}})\b", lambda g: f"{g['w'].upper()}-{g['m'].upper()}-{_year(g['y'])}"),
    (rf"\b(?P<w>{'|'.join(WINDOWS)})\b", lambda g: g["w"].replace(" ", "-").upper()),
    (rf"(?<![\w$£€.,])(?P<n>1[01]|[1-9])m\s?(?:fy\s?)?(?P<y>{Y}|\d{{2}})\b", lambda g: f"{g['n']}M-{_year(g['y'])}"),
    (rf"\bcy\s?(?P<y>{Y}|\d{{2}})\s?(?P<b>[aefbp]|pf)?\b", lambda g: f"CY{_year(g['y'])}{BASIS.get(g['b'] or '', '')}"),
    (rf"\b(?:fy\s?)?(?P<y>{Y}|(?<=fy)\d{{2}}|(?<=fy )\d{{2}})\s+(?P<b>{WORD})\b", lambda g: f"FY{_year(g['y'])}{BASIS_WORDS[g['b']]}"),
    (rf"\b(?P<b>{WORD})\s+(?:fy\s?)?(?P<y>{Y})\b", lambda g: f"FY{g['y']}{BASIS_WORDS[g['b']]}"),
    (rf"\bq(?P<n>[1-4])\s?(?P<y>{Y}|\d{{2}})\b", lambda g: f"Q{g['n']}-{_year(g['y'])}"),
    (rf"\b(?P<n>[1-4])q\s?(?P<y>{Y}|\d{{2}})\b", lambda g: f"Q{g['n']}-{_year(g['y'])}"),
    (rf"\bh(?P<n>[12])\s?(?P<y>{Y}|\d{{2}})\b", lambda g: f"H{g['n']}-{_year(g['y'])}"),
    (rf"\bfy\s?(?P<y>{Y}|\d{{2}})\s?(?P<b>[aefbp]|pf)?\b", lambda g: f"FY{_year(g['y'])}{BASIS.get(g['b'] or '', '')}"),
    (rf"\b(?P<y>{Y})\s?(?P<b>[aefbp]|pf)?\b", lambda g: f"FY{g['y']}{BASIS.get(g['b'] or '', '')}"),
]
COMPILED = [(re.compile(p), render) for p, render in RULES]
WINDOW_NAMES = {w.replace(" ", "-").upper() for w in WINDOWS}


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], str]:
    """Spans (start, end, period) in order over the folded text, and that text with the spans blanked."""
    left = " ".join((text or "").split()).lower()
    spans = []
    for pattern, render in COMPILED:
        for m in list(pattern.finditer(left)):
            spans.append((m.start(), m.end(), render(m.groupdict())))
        left = pattern.sub(lambda m: " " * len(m.group()), left)
    return sorted(spans), left


def period_of(text: str | None) -> str | None:
    """None for none, the one period, WINDOW-anchor for a relative window, or first..last."""
    names = list(dict.fromkeys(p for _, _, p in scan(text)[0]))
    if len(names) < 2:
        return names[0] if names else None
    return "-".join(names) if names[0] in WINDOW_NAMES else f"{names[0]}..{names[-1]}"


@pandas_udf(T.StringType())
def parse_period(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        known: dict = {t: period_of(t) for t in texts.unique()}
        yield texts.map(known).astype(object).where(lambda s: s.notna(), None)


@pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("period", T.StringType())]))
def split_period(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What a label measures, with its periods taken out, and when."""
    for texts in batches:
        rows = {t: (" ".join(scan(t)[1].split()).strip(" :.-"), period_of(t)) for t in texts.unique()}
        yield pd.DataFrame([rows[t] for t in texts], columns=["label", "period"])


def periods_agree(a: Column, b: Column) -> Column:
    """An unknown period agrees with any."""
    return a.isNull() | b.isNull() | (a == b)


def year_of(period: Column) -> Column:
    return F.regexp_extract(period, r"(\d{4})", 1).try_cast("int")


def endpoints(period: Column) -> Column:
    """struct(first, last) of a range, null for anything else."""
    return F.when(period.contains(".."), F.struct(F.substring_index(period, "..", 1).alias("first"), F.substring_index(period, "..", -1).alias("last")))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("period", T.StringType())]))


@pandas_udf(SPANS)
def period_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Where each period stands in a text whose white space is single: array of (start, end, period) in order."""
    for texts in batches:
        known = {t: [{"start": s, "end": e, "period": p} for s, e, p in scan(t)[0]] for t in texts.unique()}
        yield texts.map(known)
