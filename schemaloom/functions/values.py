"""Tests of cell values, on text; and the logical types that follow from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.functions.names import BOOLEAN, CATEGORY, CURRENCY, IDENTIFIER, MEASURE, STATUS, TEMPORAL, UNIT, has_any

#: Grammars of numbers and dates.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
AMOUNT = r"^[+-]?\d+(\.\d+)?$"
TIMESTAMPS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "HH:mm", "HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy")
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")
TRUTHS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f")
ISO_CURRENCIES = ("USD", "EUR", "GBP", "BRL", "CAD", "AUD", "JPY", "INR")
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
#: Sample values that units and currencies are looked for in; most values of a domain; share of values that may differ in a category.
FEW, DOMAIN, SPREAD = 20, 12, 0.4


def shapes_of(form: str) -> list[str]:
    """The shapes of the texts that a format is for: digits as 9, other signs as they are; a zone is Z or an offset."""
    plain = re.sub("[yMdHms]", "9", form.replace("'", ""))
    return [plain.replace("XXX", zone) for zone in ("Z", "+99:99", "-99:99")] if "XXX" in plain else [plain]


def parses(c: Column, formats: tuple[str, ...]) -> Column:
    """Whether a text is a time in one of the formats.

    A text's shape says which formats may read it, and only these are tried. All are tried on texts of other shapes, if they
    have a sign that no number has (formats also read years of more digits, after a sign).
    """
    by_shape: dict[str, list[str]] = {}
    for form in formats:
        for shape in shapes_of(form):
            by_shape.setdefault(shape, []).append(form)
    reads = lambda forms: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms]).isNotNull()
    shape, out = F.translate(c, "012345678", "999999999"), None
    for forms in dict.fromkeys(map(tuple, by_shape.values())):
        test = shape.isin(*[x for x, f in by_shape.items() if tuple(f) == forms])
        out = F.when(test, reads(forms)) if out is None else out.when(test, reads(forms))
    return out.when(c.rlike(r".[-/:]|^[-+]\d{8,}$"), reads(formats)).otherwise(False)


def is_number(c: Column) -> Column:
    """Also with exponent, but no digit groups."""
    return c.rlike(NUMBER)


def is_amount(c: Column) -> Column:
    """Digits with commas between and a currency sign before, no exponent."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"^[\$€£¥]\s*", "").rlike(AMOUNT)


def is_truth(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUTHS)


def is_date(c: Column) -> Column:
    """ISO 8601 (compact dates and Z too) or one of the common orders."""
    return parses(F.trim(c), DATES)


def begins_as_date(c: Column) -> Column:
    return F.trim(c).rlike(r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})")


def logical_type(words: Column, declared: Column, role: Column, is_pk: Column, is_fk: Column, truths: Column, dates: Column, numbers: Column, categorical: Column) -> Column:
    """identifier, boolean, datetime, date, currency, ratio, number, categorical or text; the first rule that holds decides.

    truths, dates, numbers: shares of the sample's values; categorical: whether they look like a category.
    """
    kind = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    money, part = has_any(words, CURRENCY), has_any(words, ("percent", "pct", "ratio"))
    numeric = kind.rlike("int|float|double|decimal|numeric|number") | (numbers >= 0.9)
    return (
        F.when(is_pk | is_fk | F.coalesce(role, F.lit("")).isin("identifier", "foreign_identifier") | has_any(words, IDENTIFIER), "identifier")
        .when(kind.contains("bool") | (truths >= 0.9) | (truths >= 0.6) & has_any(words, BOOLEAN), "boolean")
        .when(has_any(words, ("timestamp", "datetime")) | kind.rlike("timestamp|datetime"), "datetime")
        .when(has_any(words, TEMPORAL) | kind.contains("date") | (dates >= 0.9), "date")
        .when(numeric & money, "currency")
        .when(numeric & part, "ratio")
        .when(numeric, "number")
        .when((numbers >= 0.65) & has_any(words, MEASURE), F.when(money, "currency").otherwise("number"))
        .when(has_any(words, STATUS) | has_any(words, CATEGORY) | categorical, "categorical")
        .otherwise("text")
    )


def normalization(logical: Column, words: Column, domain: Column) -> Column:
    """How values of a logical type are brought to one form."""
    direct = {"identifier": "id_normalized", "boolean": "boolean_cast", "date": "date_iso", "datetime": "datetime_iso", "currency": "currency_amount", "number": "decimal_number", "ratio": "decimal_number", "categorical": "enum_casefold"}
    known = F.create_map(*[F.lit(x) for pair in direct.items() for x in pair])
    return F.coalesce(F.try_element_at(known, logical), F.when(F.size(domain) > 0, "enum_casefold").when(has_any(words, IDENTIFIER), "id_normalized").otherwise("text_trim"))


def semantic_role(words: Column, logical: Column) -> Column:
    return (
        F.when((logical == "identifier") | has_any(words, IDENTIFIER), "identifier")
        .when(logical.isin("date", "datetime") | has_any(words, TEMPORAL), "temporal")
        .when(has_any(words, STATUS), "status")
        .when(has_any(words, CATEGORY), "category")
        .when(logical.isin("number", "currency", "ratio") | has_any(words, MEASURE), "measure")
        .otherwise("descriptor")
    )


def unit(words: Column, samples: Column) -> Column:
    """The first token that is a unit, else the first unit that stands alone in a sample value."""
    named = F.get(F.filter(words, lambda w: w.isin(*UNIT)), 0)
    found = F.transform(F.slice(samples, 1, FEW), lambda v: F.lower(F.regexp_extract(v, r"(?i)\b(kg|g|lb|m|cm|mm|km|ms|s|%)\b", 1)))
    return F.coalesce(named, F.get(F.filter(found, lambda v: v != ""), 0))


def currency(words: Column, samples: Column) -> Column:
    """The ISO code by a token, else by a sign or a code in a sample value; none if a token says only currency."""
    named = F.get(F.filter(F.transform(words, F.upper), lambda w: w.isin(*ISO_CURRENCIES)), 0)
    by_value = lambda v: F.coalesce(*[F.when(F.contains(v, F.lit(s)), iso) for s, iso in SYMBOLS.items()], *[F.when(F.contains(F.upper(v), F.lit(iso)), iso) for iso in ISO_CURRENCIES])
    found = F.get(F.filter(F.transform(F.slice(samples, 1, FEW), by_value), lambda v: v.isNotNull()), 0)
    return F.coalesce(named, F.when(~F.array_contains(words, "currency"), found))


def confidence(logical: Column, declared: Column, sampled: Column, role: Column, domain: Column, support: Column) -> Column:
    """Points for what is known of an attribute, 0.99 at most; support: the greatest share of values of one kind."""
    points = lambda when, value: F.when(when, value).otherwise(0.0)
    total = F.lit(0.45) + points(F.coalesce(declared, F.lit("")) != "", 0.12) + points(sampled, 0.12) + points(F.coalesce(role, F.lit("")) != "", 0.08) + points(F.size(domain) > 0, 0.05)
    return F.least(F.lit(0.99), total + points(logical != "text", 0.06) + F.least(F.lit(0.12), support * 0.12))
