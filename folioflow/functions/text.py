"""Text functions as column expressions; nothing here leaves the JVM.

Java's classes are ASCII unless asked otherwise, so patterns say ``(?U)`` where Unicode counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V

A_TO_Z, Z_TO_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Latin letters with marks and what remains of them without, made from Unicode's own decompositions.
_FOLD = {}


def _fold_table() -> tuple[str, str]:
    import unicodedata

    if not _FOLD:
        for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
            bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
            if len(bare) == 1 and bare != chr(code):
                _FOLD[chr(code)] = bare
    return "".join(_FOLD), "".join(_FOLD.values())


def repair_mojibake(c: Column) -> Column:
    """Six doubly encoded sequences to plain letters."""
    for bad, good in V.MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def fold_spanish(c: Column) -> Column:
    return F.translate(c, V.ACCENTED, V.PLAIN)


def fold_latin(c: Column) -> Column:
    """Every Latin letter without its marks, and no combining marks."""
    bad, good = _fold_table()
    return F.regexp_replace(F.translate(c, bad, good), r"\p{Mn}", "")


def spaced(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def type_form(c: Column) -> Column:
    """The form in which document-type terms are looked for."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(fold_spanish(repair_mojibake(c))), r"(?U)[^a-z0-9\s/&\-_]", " "), r"(?U)\s+", " "))


def evaluation_form(c: Column) -> Column:
    """The form in which expected and extracted values are compared; null counts as empty."""
    folded = F.lower(fold_latin(F.translate(F.coalesce(c, F.lit("")), V.EVAL_ACCENTED, V.EVAL_PLAIN)))
    return spaced(F.regexp_replace(folded, r"(?U)[^a-z0-9\s]", " "))


def ocr_digits(c: Column) -> Column:
    return F.translate(c, "OoIlS", "00115")


def extension(c: Column) -> Column:
    """What follows the last dot of a path, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.btrim(F.coalesce(c, F.lit(""))), r"(?s)\.([^.]*)$", 1))


def header_form(name: str) -> str:
    return "".join(ch for ch in (name or "").strip().lower() if ch.isascii() and ch.isalnum())


def find_header(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column whose header is an alias, else the first that contains one; aliases in order of preference."""
    forms = {header_form(c): c for c in columns}
    exact = [forms[a] for a in aliases if a in forms]
    near = [c for form, c in forms.items() if any(a in form for a in aliases)]
    return (exact + near + [None])[0]


def letter_share(c: Column) -> Column:
    """Letters among all characters but space, tab and line feed; 0 where there are none."""
    solid = F.translate(c, " \t\n", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"\P{L}", "")) / F.length(solid)).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    """Runs of at least three Latin letters."""
    return F.regexp_count(c, F.lit("[A-Za-zÀ-ɏ]{3,}"))


def page_is_digital(c: Column) -> Column:
    return (F.length(c) >= V.PAGE_MIN_CHARS) & (letter_share(c) >= V.PAGE_MIN_RATIO) & (word_count(c) >= V.PAGE_MIN_WORDS)


def ocr_score(c: Column) -> Column:
    """How much a text looks like a page read the right way up, truncated to an integer; 0 for null and empty."""
    low = F.lower(c)
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k) for k in V.OCR_KEYWORDS), F.lit(0.0))
    solid = F.greatest(F.length(F.regexp_replace(c, r"(?U)\s", "")), F.lit(1))
    letters, alnum = F.length(F.regexp_replace(c, r"\P{L}", "")), F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    score = hits * 120 + letters / solid * 40 + alnum / solid * 20 - F.regexp_count(c, F.lit("[A-Z0-9]{10,}")) * 10
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(score.cast("int"))


def is_date_anchor(c: Column) -> Column:
    """Whether an OCR token is the label of a date."""
    clean = F.regexp_replace(F.upper(fold_spanish(F.coalesce(c, F.lit("")))), "[^A-Z]", "")
    return clean.startswith("FECH") | clean.isin("FECMA", "FECNA")


def hyperlink(c: Column) -> Column:
    """A spreadsheet formula that links to a path; empty for null and empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit('=HYPERLINK("'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('")')))


def whole_id(c: Column) -> Column:
    """An id from what may be a number or its text: whole numbers only, else null."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def clock(seconds: Column) -> Column:
    """Whole seconds as MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    short = F.format_string("%02d:%02d", (s / 60).cast("bigint"), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint"), s % 60))


def progress(done: Column, total: Column) -> Column:
    """Share done, from 0 to 1; 0 without a total."""
    return F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def rendered_row(cells: Column) -> Column:
    """Cells of a spreadsheet row, cleaned, without empty ones, joined by bars."""
    clean = F.transform(cells, lambda x: spaced(F.replace(F.coalesce(x, F.lit("")), F.lit("\x00"), F.lit(" "))))
    return F.array_join(F.filter(clean, lambda x: x != ""), " | ")


def rendered_table(rows: Column) -> Column:
    """A table of a page as text: a marker, then rows with their empty cells; all-empty rows are left out."""
    clean = F.transform(rows, lambda row: F.transform(row, lambda x: spaced(F.coalesce(x, F.lit("")))))
    kept = F.filter(clean, lambda row: F.exists(row, lambda x: x != ""))
    lines = F.array_join(F.transform(kept, lambda row: F.array_join(row, " | ")), "\n")
    return F.when(F.size(kept) > 0, F.concat(F.lit("[TABLE]\n"), lines)).otherwise(F.lit(""))


def mime_type(path: Column) -> Column:
    """Media type by extension, ``application/octet-stream`` if unknown."""
    import mimetypes

    known = {e: mimetypes.types_map.get(f".{e}") or mimetypes.common_types.get(f".{e}") for e in V.SUPPORTED_TYPES}
    table = F.create_map(*(F.lit(x) for pair in known.items() if pair[1] for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def sampled_pages(pages: Column, most: int = V.SAMPLED_PAGES) -> Column:
    """Which pages are looked at: all of a few, else the first, the last and some evenly between."""
    between = [F.floor(pages * k / (most - 1)).cast("int") for k in range(1, most - 1)]
    spread = F.slice(F.array_sort(F.array_distinct(F.array(F.lit(0), (pages - 1).cast("int"), *between))), 1, most)
    few = F.when(pages > 0, F.sequence(F.lit(0), pages.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(pages <= most, few).otherwise(spread)
