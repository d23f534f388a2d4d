"""Reading and writing displayed numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a displayed number.
CURRENCY = r"US\$|U\.S\.\$|USD|EUR|GBP|JPY|CHF|\$|£|€|¥"
SUFFIX = r"%|x|bp|bps|p\.a\.|m|bn|k|mm"
NUMBER = rf"(?i)^(\()?\s*({CURRENCY})?\s*([-−])?\s*(\d{{1,3}}(?:[, \x{{00a0}}]\d{{3}})*|\d+)(?:\.(\d+))?\s*({SUFFIX})?\s*(\))?$"
PLACEHOLDERS = ("n.a.", "n/a", "na", "nm", "n.m.", "nil", "-", "–", "—", "tbd", "", "--")
SCALES = {"k": 1e3, "m": 1e6, "mm": 1e6, "bn": 1e9}
QUANTITIES = ("%", "x", "bp", "bps", "p.a.")
FOLDED_CURRENCY = {"US$": "USD", "U.S.$": "USD", "$": "USD", "USD": "USD", "£": "GBP", "GBP": "GBP", "€": "EUR", "EUR": "EUR", "¥": "JPY", "JPY": "JPY", "CNY": "CNY"}
VALUE_FOOTNOTE = r"(?i)(?<=\S)[\s\x{00a0}]*(?:[*†‡§¶]+|[(\[](?:\d{1,2}|[a-e])[)\]])$"
CURRENCY_BEFORE_FIGURE = r"(?i)(US\$|U\.S\.\$|USD|EUR|GBP|JPY|\$|£|€|¥)\s?(?=[\d.])"
PROSE_NUMBER = rf"(?i)(?<![\w.,$£€¥])(\()?({CURRENCY})?\s?([-−])?(\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.(\d+))?\s?(%|x|bps|bp|p\.a\.|mm|m|bn|k)?(?![\w])(\))?"
YEAR = r"^(?:19|20)\d{2}$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _null(text: Column) -> Column:
    return F.when(text != "", text)


def parse_number(text: Column) -> Column:
    """struct(value, decimals, separator, negative_style, currency, suffix), null where the text is no number.

    One bracket without the other is a defect of the cell and no number.
    """
    t = strip(text)
    g = lambda k: F.regexp_extract(t, NUMBER, k)
    digits = F.regexp_replace(g(4), "[, \\x{00a0}]", "")
    magnitude = F.concat(digits, F.lit("."), F.when(g(5) == "", "0").otherwise(g(5))).try_cast("double")
    both, some = (g(1) != "") & (g(7) != ""), (g(1) != "") | (g(7) != "")
    style = F.when(both, "parentheses").when(g(3) != "", "minus")
    separator = F.when(g(4).contains(","), ",").when(g(4).contains(" "), " ").when(g(4).contains(" "), " ")
    good = t.rlike(NUMBER) & (both | (g(3) != "") | ~some)
    return F.when(
        good,
        F.struct(
            F.when(style.isNotNull(), -magnitude).otherwise(magnitude).alias("value"),
            F.length(g(5)).alias("decimals"),
            separator.alias("separator"),
            style.alias("negative_style"),
            _null(g(2)).alias("currency"),
            _null(g(6)).alias("suffix"),
        ),
    )


def strip_value_footnote(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), VALUE_FOOTNOTE, ""))


def read_cell(text: Column) -> Column:
    """A cell's number, with or without a footnote marker behind it."""
    return F.coalesce(parse_number(text), parse_number(strip_value_footnote(text)))


def is_placeholder(text: Column) -> Column:
    return F.lower(strip(text)).isin(*PLACEHOLDERS)


def prose_numbers(text: Column) -> Column:
    """All displayed numbers in running text. Bracketed ones are positive; bare years are left out."""
    found = F.regexp_extract_all(text, F.lit(PROSE_NUMBER), F.lit(0))
    cleaned = F.transform(found, lambda m: strip(F.regexp_replace(m, r"[()]", "")))
    return F.filter(cleaned, lambda m: ~m.rlike(YEAR))


def restate(value: Column, decimals: Column, separator: Column, negative_style: Column, currency: Column, suffix: Column) -> Column:
    """The value written with another figure's decimals, separator, currency, suffix and, where negative, its style."""
    plain = F.round(F.abs(value) * F.pow(F.lit(10.0), decimals)).cast("decimal(38,0)").cast("string")
    padded = F.lpad(plain, F.greatest(F.length(plain), decimals + 1), "0")
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    part = F.when(decimals > 0, F.concat(F.lit("."), F.right(padded, decimals))).otherwise("")
    grouped = F.reverse(F.regexp_replace(F.reverse(whole), r"(\d{3})(?=\d)", "$1,"))
    whole = F.when(separator.isNull(), whole).otherwise(F.replace(grouped, F.lit(","), F.coalesce(separator, F.lit(","))))
    body = F.concat(F.coalesce(currency, F.lit("")), whole, part, F.coalesce(suffix, F.lit("")))
    return F.when(value >= 0, body).when(negative_style == "parentheses", F.concat(F.lit("("), body, F.lit(")"))).otherwise(F.concat(F.lit("-"), body))


def fold_currency(token: Column) -> Column:
    key = F.upper(F.replace(token, F.lit(" "), F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in FOLDED_CURRENCY.items() for x in kv])
    return F.when(token.isNotNull() & (token != ""), F.coalesce(F.try_element_at(known, key), key))


def unit_of(reading: Column) -> Column:
    """struct(quantity, scale, currency) that a figure states about itself."""
    suffix = F.lower(reading["suffix"])
    scale = F.when(suffix == "mm", "m").when(suffix.isin("k", "m", "bn"), suffix)
    return F.struct(F.when(suffix.isin(*QUANTITIES), suffix).alias("quantity"), scale.alias("scale"), fold_currency(reading["currency"]).alias("currency"))


def inherit_unit(own: Column, other: Column) -> Column:
    """The figure's unit first; a figure with a quantity of its own takes neither scale nor currency."""
    filled = F.struct(other["quantity"].alias("quantity"), F.coalesce(own["scale"], other["scale"]).alias("scale"), F.coalesce(own["currency"], other["currency"]).alias("currency"))
    return F.when(own["quantity"].isNotNull(), own).otherwise(filled)


def scale_factor(scale: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), scale)


def currency_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CURRENCY_BEFORE_FIGURE), F.lit(1))


def half_unit(decimals: Column) -> Column:
    """Half a unit in the last displayed place."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals)
