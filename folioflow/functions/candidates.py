"""Candidate generation for fields in free text: plain Python over fixed patterns, called by Arrow batches.

These functions only say what a text offers and where. Which candidate wins is decided by column
expressions in :mod:`folioflow.functions.fields`.
"""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache
from typing import NamedTuple

from .. import values as V

_FOLD = str.maketrans(V.ACCENTED, V.PLAIN)
_DIGITS = str.maketrans("OoIlS", "00115")


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def repair_mojibake(text: str) -> str:
    for bad, good in V.MOJIBAKE:
        text = text.replace(bad, good)
    return text


class Candidate(NamedTuple):
    value: str
    base: int
    position: int
    ordinal: int
    context: str


# tax identifiers


def _tax_normal(token: str) -> str:
    """As :func:`folioflow.functions.taxid.ocr_normal`."""
    raw = re.sub("[^A-Za-z0-9Ñ&]", "", token)
    if len(raw) not in (12, 13):
        return re.sub("[^A-Z0-9Ñ&]", "", token.upper())
    k = len(raw) - 9
    return (raw[:k] + raw[k : k + 6].translate(str.maketrans(V.OCR_DIGITS_FROM, V.OCR_DIGITS_TO)) + raw[k + 6 :]).upper()


def _tax_date_is_real(token: str) -> bool:
    if len(token) not in (12, 13) or not (part := token[len(token) - 9 : len(token) - 3]).isdigit():
        return False
    yy = int(part[:2])
    return _day(1900 + yy if yy >= 30 else 2000 + yy, int(part[2:4]), int(part[4:])) is not None


def _tax_matches(scope: str):
    """(value, start, end) of both shapes in a scope."""
    for m in _compiled(V.TAX_PLAIN).finditer(scope):
        yield _tax_normal(m[1]), m.start(1), m.end(1), 0
    for m in _compiled(V.TAX_GROUPED).finditer(scope):
        yield _tax_normal("".join(m.groups())), m.start(1), m.end(4), 3


def tax_candidates(text: str) -> list[Candidate]:
    """Identifiers with a real date, each line read together with the next; lines with a CURP open no scope."""
    whole = repair_mojibake(text).upper().replace("_", " ")
    lines, out, at = whole.splitlines(), [], 0
    for line, following in zip(lines, [*lines[1:], None]):
        if "CURP" not in line:
            base = 70 if _compiled(V.TAX_LABEL).search(line) else 35
            scope = line if following is None else f"{line} {following}"
            for value, s, e, malus in _tax_matches(scope):
                if value not in V.IGNORED_TAX_IDS and _tax_date_is_real(value):
                    context = whole[max(0, at + s - 90) : at + e + 90]
                    out.append(Candidate(value, base - malus, at + s, len(out), context))
        at += len(line) + 1
    return out


def tax_fallback(text: str) -> str | None:
    """Without candidates: a labelled line in a supplier's block, else a foreign identifier."""
    source = repair_mojibake(text)
    lines = source.upper().replace("_", " ").splitlines()
    for i, line in enumerate(lines):
        block = "\n".join(lines[max(0, i - 2) : i + 3])
        if _compiled(V.TAX_LABEL).search(line) and _compiled(V.TAX_BLOCK).search(block):
            found = next((v for v, *_ in _tax_matches(line) if v not in V.IGNORED_TAX_IDS), None)
            if found is not None:
                return found
    for pattern in (V.FOREIGN_LABELLED, V.FOREIGN_IN_CONTEXT):
        if (m := _compiled(pattern).search(source)) and len(digits := re.sub(r"\D", "", m[1])) == 9:
            return f"{digits[:2]}-{digits[2:]}"
    return None


# dates


def _day(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _number(raw: str) -> int | None:
    raw = raw.translate(_DIGITS)
    try:
        return int(raw)
    except ValueError:
        return None


def near(a: str, b: str) -> bool:
    """At most one character differs, is missing or is added."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b


def month_of(raw: str) -> int | None:
    """Number of a Spanish month: whole, abbreviated, cut short or run on, or an abbreviation with one slip."""
    key = re.sub("[^a-z]", "", raw.strip().lower().translate(_FOLD))
    if len(key) < 3:
        return None
    if (exact := V.MONTHS.get(key) or V.MONTH_ABBREVIATIONS.get(key)) is not None:
        return exact
    tests = (
        *((n, name.startswith(key) or key.startswith(name)) for name, n in V.MONTHS.items()),
        *((n, a.startswith(key) or (key.startswith(a) and len(key) <= len(a) + 1)) for a, n in V.MONTH_ABBREVIATIONS.items()),
        *((n, len(key) <= 4 and near(key, a)) for a, n in V.MONTH_ABBREVIATIONS.items()),
    )
    return next((n for n, fits in tests if fits), None)


def year_of(raw: str) -> int | None:
    """A year of two or four digits, or of two halves with marks between that give 2000 to 2100."""
    raw = raw.translate(_DIGITS)
    if m := re.fullmatch(r"\s*([0-9]{2})\s*[^0-9]+\s*([0-9]{2})\s*", raw):
        year = int(m[1] + m[2])
        return year if 2000 <= year <= 2100 else None
    digits = re.sub(r"\D", "", raw)
    if len(digits) == 2:
        return int(digits) + (1900 if int(digits) >= 30 else 2000)
    return int(digits) if len(digits) == 4 else None


def _numeric(value: str) -> date | None:
    parts = re.split(r"[/.\-]", value)
    if len(parts[0]) == 4:
        return _day(*map(int, parts))
    d, m, y = map(int, parts)
    if len(parts[2]) == 2:  # the POSIX pivot, unlike that of written-out dates
        y += 1900 if y >= 69 else 2000
    return _day(y, m, d)


def _textual(kind: str, first: str, second: str, third: str) -> date | None:
    if kind == "month_first":
        first, second = second, first
    day = _number(first)
    month = _number(second) if kind.endswith("number") else month_of(second)
    year = _number(third) if kind.startswith("strict") else year_of(third)
    return _day(year, month, day) if day is not None and month and year is not None else None


def date_candidates(text: str) -> list[Candidate]:
    """All dates that the shapes read, each with the text around it in folded lower case."""
    source, out = repair_mojibake(text).replace("_", ""), []

    def put(found: date | None, base: int, start: int, end: int) -> None:
        if found is not None:
            around = source[max(0, start - 160) : end + 160].lower().translate(_FOLD)
            out.append(Candidate(found.isoformat(), base, start, len(out), around))

    for pattern in V.NUMERIC_DATES:
        for m in _compiled(pattern).finditer(source):
            put(_numeric(m[1]), 2, m.start(1), m.end(1))
    for kind, base, pattern in V.TEXTUAL_DATES:
        for m in _compiled(pattern).finditer(source):
            if not _compiled(V.SPLIT_YEAR_TAIL).match(source[m.end(3) : m.end(3) + 12]):
                put(_textual(kind, *m.groups()), base, m.start(), m.end())
    kind, base, pattern = V.NOISY_DATE
    for m in _compiled(pattern).finditer(source):
        put(_textual(kind, *m.groups()), base, m.start(), m.end())
    return out


# supplier names


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def join_fragments(name: str) -> str:
    """Words that OCR has split are joined again, up to ten letters; names of companies stay."""
    name = _spaced(name.replace("?", " ")).strip(V.NAME_EDGES)
    if not name or _compiled(V.LEGAL_FORM).search(name):
        return name
    before = None
    while name != before:
        before = name
        name = re.sub(r"\b([A-Z][a-z]{2,4})\s+([a-z]{1,4})\b", lambda m: m[0] if len(m[1] + m[2]) > 10 else m[1] + m[2], name)
    return _spaced(name)


def company_name(raw: str) -> str:
    """A name without what stands before and after it in running text; cut after the legal form."""
    name = re.sub(r"(?i)^y\s+", "", _spaced(raw).strip(V.NAME_QUOTES)).strip(V.NAME_QUOTES)
    for cut in V.NAME_CUTS:
        name = _compiled(cut).sub("", name).strip(V.NAME_EDGES)
    name = join_fragments(name)
    end = _compiled(V.COMPANY_END).search(name)
    return end[1].strip(V.NAME_EDGES) if end else name


def looks_like_name(name: str) -> bool:
    clean = _spaced(name).strip(V.NAME_EDGES)
    if len(clean) < 4 or _compiled(V.NAME_BLOCKED).search(clean) or _compiled(V.NAME_PLACEHOLDER).search(clean):
        return False
    return any(map(str.isalpha, clean)) and (bool(_compiled(V.LEGAL_FORM).search(clean)) or len(clean.split()) >= 2)


def supplier_candidates(text: str):
    """Raw names in order of trust: labelled lines, contexts, lines that tell of an agreement."""
    cleaned = repair_mojibake(text)
    folded = cleaned.translate(_FOLD)
    for source in dict.fromkeys((cleaned, folded)):
        for m in _compiled(V.NAME_LINE).finditer(source):
            yield m[1]
    for pattern in V.NAME_CONTEXTS:
        if m := _compiled(pattern).search(folded):
            yield m[1]
    for line in folded.splitlines():
        if " ACUERDO CON " in (line := line.strip(V.NAME_EDGES)).upper():
            yield line


def supplier_name(text: str) -> str | None:
    names = map(company_name, supplier_candidates(text))
    return next((n for n in names if n and looks_like_name(n)), None)


def match_name(raw: str | None) -> str:
    """The form in which supplier names are joined: cleaned, without marks, upper case, no noise around."""
    import unicodedata

    if not raw:
        return ""
    bare = "".join(c for c in unicodedata.normalize("NFD", company_name(raw)) if not unicodedata.combining(c)).upper()
    name = _spaced(re.sub(r"[_\.\,\;\:\-\(\)\[\]\{\}/\\\|]+", " ", bare))
    for pattern in (*V.MATCH_LEADING, *V.MATCH_TRAILING):
        name = _compiled(pattern).sub("", name).strip()
    return _spaced(name)


def core_name(name: str) -> str:
    words = name.split()
    return " ".join([w for w in words if w not in V.LEGAL_TOKENS] or words)


# similarity


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    if not a and not b:
        return 1.0
    # a bit of ``rows`` for each place of ``a``; those cleared at the end count the longest common subsequence
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for y in b:
        met = rows & places.get(y, 0)
        rows = (rows + met | rows - met) & full
    return 2.0 * (len(a) - rows.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio of common words, and common words with each side's rest; 1 if one side adds nothing, 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join([both, *sorted(s)]).strip() for s in (x - y, y - x))
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0, 0.0)))


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """The weighted score of two names; 0 as soon as what is known rules out ``least``."""
    if not a or not b:
        return 0.0
    parts = {"ratio": 1.0, "token_sort": 1.0, "token_set": 1.0, "contains": float(a in b or b in a), "same_first": float(a.split()[:1] == b.split()[:1])}
    for name, part in (("ratio", ratio), ("token_sort", token_sort), ("token_set", token_set)):
        parts[name] = part(a, b)
        if sum(V.SIMILARITY[k] * v for k, v in parts.items()) < least - 1e-9:
            return 0.0
    return sum(V.SIMILARITY[k] * v for k, v in parts.items())


def overlap(a: str, b: str) -> float:
    """Share of common words among all."""
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0
