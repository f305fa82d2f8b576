"""Tax identifiers as column expressions: normal forms, validity, check digit, choice and repair.

Only the search through a repair's variants is Python, in Arrow batches.
"""

from __future__ import annotations

import re
from calendar import monthrange
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from . import text as T


def _numbers_at(c: Column) -> tuple[Column, Column]:
    """Position (from 1) of the six digits, and whether the length has them."""
    return F.when(F.length(c) == 12, F.lit(4)).otherwise(F.lit(5)), F.length(c).isin(12, 13)


def ocr_normal(c: Column, bad: str = V.OCR_DIGITS_FROM, good: str = V.OCR_DIGITS_TO) -> Column:
    """Letters, digits, Ñ and & in upper case; in the six date places letters that OCR mistakes for digits are digits.

    Lower-case letters other than a to z do not count towards the length, as they go before it is taken.
    """
    source = F.coalesce(c, F.lit(""))
    raw = F.regexp_replace(source, "[^A-Za-z0-9Ñ&]", "")
    start, fits = _numbers_at(raw)
    head, digits, tail = raw.substr(F.lit(1), start - 1), raw.substr(start, F.lit(6)), raw.substr(start + 6, F.lit(4))
    return F.when(fits, F.upper(F.concat(head, F.translate(digits, bad, good), tail))).otherwise(F.regexp_replace(F.upper(source), "[^A-Z0-9Ñ&]", ""))


def match_key(c: Column) -> Column:
    """Upper-case ASCII letters and digits only, the form that joins compare; empty for null."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def canonical(c: Column) -> Column:
    """The match key; nine digits are split in two and seven; null if nothing is left."""
    key = match_key(c)
    return F.when(key.rlike(r"^\d{9}$"), F.concat(key.substr(1, 2), F.lit("-"), key.substr(3, 7))).when(key != "", key)


def date_is_real(c: Column) -> Column:
    """Whether the six digits are a day of 1930 to 2029."""
    up = F.upper(F.coalesce(c, F.lit("")))
    start, fits = _numbers_at(up)
    part = up.substr(start, F.lit(6))
    year = part.substr(1, 2).try_cast("int")
    day = F.try_make_timestamp(
        F.when(year >= 30, 1900 + year).otherwise(2000 + year), part.substr(3, 2).try_cast("int"), part.substr(5, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
    )
    return fits & part.rlike(r"^\d{6}$") & day.isNotNull()


def acceptable(c: Column) -> Column:
    """Shape and date are right."""
    return F.upper(F.coalesce(c, F.lit(""))).rlike(r"^[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{2,3}$") & date_is_real(c)


def check_digit_is_right(c: Column) -> Column:
    """Whether the last character is the weighted sum of the others modulo eleven."""
    up = F.upper(F.coalesce(c, F.lit("")))
    n = F.length(up)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    values = F.transform(places, lambda i: F.instr(F.lit(V.TAX_ALPHABET), up.substr(i, F.lit(1))) - 1)
    first_weight = F.when(n == 13, 13).otherwise(12)
    total = F.aggregate(F.arrays_zip(places.alias("p"), values.alias("v")), F.lit(0), lambda s, x: s + x["v"] * (first_weight - x["p"] + 1))
    rest = 11 - total % 11
    digit = F.when(rest == 11, F.lit("0")).when(rest == 10, F.lit("A")).otherwise(rest.cast("string"))
    return n.isin(12, 13) & F.forall(values, lambda v: v >= 0) & (up.substr(n, F.lit(1)) == digit)


def best_of(candidates: Column) -> Column:
    """Of an array in order of trust: the first with a right check digit, else the first acceptable, else the first at all."""
    clean = F.filter(F.transform(candidates, lambda x: ocr_normal(x)), lambda x: x != "")
    good = F.filter(clean, acceptable)
    return F.coalesce(F.get(F.filter(good, check_digit_is_right), F.lit(0)), F.get(good, F.lit(0)), F.get(clean, F.lit(0)))


def person_prefix(name: Column) -> Column:
    """The four letters a person's name leads to; null for companies and fewer than three words."""
    plain = T.fold_spanish(F.upper(F.coalesce(name, F.lit(""))))
    words = F.filter(F.split(plain, "[^A-Z]+"), lambda w: w != "")
    n = F.size(words)
    father, mother = F.get(words, n - 2), F.get(words, n - 1)
    given = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    own = F.coalesce(F.get(F.filter(given, lambda w: ~w.isin(*V.SKIPPED_GIVEN_NAMES)), F.lit(0)), F.get(given, F.lit(0)))
    vowel = F.regexp_extract(father.substr(F.lit(2), F.length(father)), "[AEIOU]", 0)
    prefix = F.concat(father.substr(1, 1), F.when(vowel == "", F.lit("X")).otherwise(vowel), mother.substr(1, 1), own.substr(1, 1))
    company = plain.rlike(r"(?i)\bS\.?\s*A\.?\s*(DE\s+C\.?\s*V\.?)?\b|\bLLC\b|\bINC\b|\bLTD\b|\bCOMPANY\b")
    return F.when(~company & (n >= 3), prefix)


def repaired(raw: Column, name: Column) -> Column:
    """A person's identifier from what OCR left of it: prefix by name, date digits, and of all tails that OCR may
    have misread one with a right check digit, the one with fewest changes, the first of equals."""
    scope = F.upper(T.fold_spanish(F.coalesce(raw, F.lit(""))))
    labelled = F.regexp_extract(scope, r"(?U)\bRFC\b[^\n]{0,80}", 0)
    scope = F.regexp_replace(F.when(labelled != "", labelled).otherwise(scope), r"(?U)[^A-Z0-9Ñ&\)\(\s]", " ")
    shape = r"(?U)([0-9OISBGZD]{6})([A-Z0-9\)\(\s]{2,8})"
    date = F.translate(F.regexp_extract(scope, shape, 1), V.OCR_DIGITS_FROM, V.OCR_DIGITS_TO)
    seen = F.regexp_replace(F.regexp_extract(scope, shape, 2), r"[^A-Z0-9\)\(]", "").substr(1, 3)
    date = F.when(date.rlike(r"^\d{6}$") & (F.length(seen) == 3), date)

    @F.pandas_udf("string")
    def best(prefixes: pd.Series, dates: pd.Series, tails: pd.Series) -> pd.Series:
        return pd.Series([_best_tail(p, d, t) for p, d, t in zip(prefixes, dates, tails)], dtype=object)

    return best(person_prefix(name), date, seen)


def _best_tail(prefix: str | None, date: str | None, seen: str | None) -> str | None:
    """The repaired identifier with the fewest changes to the three characters seen, the first of equals."""
    if not prefix or not date or not seen:
        return None
    options = sorted(product(*(V.TAIL_CONFUSIONS.get(c, c) for c in seen)), key=lambda tail: sum(map(str.__ne__, tail, seen)))
    return next((whole for tail in options if _checks_out(whole := prefix + date + "".join(tail))), None)


def _checks_out(token: str) -> bool:
    """Shape, date and check digit of a person's identifier."""
    if not re.fullmatch("[A-ZÑ&]{4}[0-9]{6}[A-Z0-9]{3}", token):
        return False
    yy, month, day = (int(token[i : i + 2]) for i in (4, 6, 8))
    if month not in range(1, 13) or day not in range(1, monthrange(1900 + yy if yy >= 30 else 2000 + yy, month)[1] + 1):
        return False
    weighted = sum(V.TAX_ALPHABET.index(c) * w for c, w in zip(token, range(13, 1, -1)))
    return token[-1] == {11: "0", 10: "A"}.get(rest := 11 - weighted % 11, str(rest))


def hint_in(text: Column) -> Column:
    """The first acceptable identifier in an OCR line, all separators gone first; a narrower table of confusions holds."""
    glued = ocr_normal(text, V.OCR_HINT_FROM, V.OCR_HINT_TO)
    found = F.regexp_extract_all(glued, F.lit(r"([A-ZÑ&]{3,4}[0-9OISBGZD]{6}[A-Z0-9]{2,3})"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: ocr_normal(x, V.OCR_HINT_FROM, V.OCR_HINT_TO)), acceptable), F.lit(0))
