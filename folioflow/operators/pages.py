"""Pages, OCR tokens and spreadsheet cells: routes, texts and values by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import taxid
from ..functions import text as T


def page_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """``file_id, text``: the pages that are not empty, in order."""
    own = pages.where(F.coalesce("page_text", F.lit("")) != "").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "page_text"))).alias("p"))
    return own.select("file_id", F.array_join(F.col("p.page_text"), separator).alias("text"))


def page_routes(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``file_id, source_type, route`` of ``files (file_id, file_path, n_pages)`` by kind and, for PDF, by sampled pages.

    Only the sampled pages of PDF files are looked at: the sample is a join key, so a page source can prune the rest.
    """
    kinds = files.withColumn("source_type", T.extension(F.col("file_path")))
    wanted = kinds.where(F.col("source_type").isin(*V.PDF_TYPES)).select("file_id", F.explode(T.sampled_pages(F.col("n_pages"))).alias("page_index"))
    text = F.coalesce("page_text", F.lit(""))
    seen = wanted.join(pages, ["file_id", "page_index"], "left").groupBy("file_id").agg(
        F.avg(T.page_is_digital(text).cast("int")).alias("share"),
        # the texts that are not empty, joined by line feeds
        (F.sum(F.length(text)) + F.greatest(F.count_if(text != "") - 1, F.lit(0))).alias("chars"),
    )
    digital = F.coalesce((F.col("share") >= V.DIGITAL_SHARE) & (F.col("chars") >= V.DIGITAL_MIN_CHARS), F.lit(False))
    route = (
        F.when(F.col("source_type").isin(*V.PDF_TYPES), F.when(digital, "digital_pdf").otherwise("ocr_image"))
        .when(F.col("source_type").isin(*V.IMAGE_TYPES), "ocr_image")
        .when(F.col("source_type").isin(*V.STRUCTURED_TYPES), "structured_document")
        .otherwise("unknown")
    )
    return kinds.join(seen, "file_id", "left").select("file_id", "source_type", route.alias("route"))


def right_of_anchor(tokens: DataFrame, anchors: DataFrame, least_overlap: float, most: int) -> DataFrame:
    """``file_id, page, anchor, line``: up to ``most`` tokens right of each anchor on its line, left to right.

    Tokens ``(file_id, page, ord, text, left, top, width, height)`` share a line with an anchor, one of them
    by ``ord``, if they overlap vertically by that share of the lower one's height. Pages bound the join.
    """
    a = anchors.select("file_id", "page", F.col("ord").alias("anchor"), (F.col("left") + F.col("width")).alias("edge"), F.col("top").alias("a_top"), F.col("height").alias("a_height"))
    word = F.btrim("text")
    overlap = F.greatest(F.lit(0), F.least(F.col("a_top") + F.col("a_height"), F.col("top") + F.col("height")) - F.greatest("a_top", "top"))
    on_line = (F.col("left") > F.col("edge")) & (overlap / F.greatest(F.lit(1), F.least("a_height", "height")) >= least_overlap)
    pairs = tokens.where(F.coalesce(word, F.lit("")) != "").join(a, ["file_id", "page"]).where(on_line)
    line = F.slice(F.array_sort(F.collect_list(F.struct("left", "ord", word.alias("w")))), 1, most)
    return pairs.groupBy("file_id", "page", "anchor").agg(line.alias("x")).select("file_id", "page", "anchor", F.array_join(F.col("x.w"), " ").alias("line"))


def tax_id_by_layout(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    return right_of_anchor(tokens, anchors, 0.45, 6).withColumn("rfc_hint", taxid.hint_in(F.col("line")))


def sheet_form(c: Column) -> Column:
    upper = T.fold_latin(F.upper(T.spaced(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(" ")))))
    return F.btrim(F.regexp_replace(F.regexp_replace(upper, "[^A-Z0-9&]+", " "), " +", " "))


def sheet_label(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in V.SHEET_LABELS.items() for x in pair))
    return F.try_element_at(table, sheet_form(c))


def is_sheet_value(c: Column) -> Column:
    clean, form = T.spaced(F.coalesce(c, F.lit(""))), sheet_form(c)
    return (
        (F.length(clean) >= 4)
        & (form != "")
        & ~form.isin(*V.SHEET_LABELS, *V.SHEET_NOISE)
        & ~clean.rlike(r"(?U)^[\d\s\-/.,$%]+$")
        & (F.length(F.regexp_replace(clean, r"\P{L}", "")) >= 3)
    )


def sheet_hints(cells: DataFrame) -> DataFrame:
    """``file_id, sheet, hint`` of ``cells (file_id, sheet, r, c, value)``: each label with the first value around it.

    Twelve places around a label are tried in order; an equi join finds them all at once.
    """
    labels = cells.withColumn("label", sheet_label(F.col("value"))).where("label IS NOT NULL")
    places = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(V.SHEET_OFFSETS)))
    tried = labels.select("file_id", "sheet", F.col("r").alias("lr"), F.col("c").alias("lc"), "label", F.explode(places).alias("p")).withColumns({"r": F.col("lr") + F.col("p.dr"), "c": F.col("lc") + F.col("p.dc")})
    near = tried.join(cells.where(is_sheet_value(F.col("value"))).select("file_id", "sheet", "r", "c", T.spaced(F.col("value")).alias("found")), ["file_id", "sheet", "r", "c"])
    first = near.groupBy("file_id", "sheet", "lr", "lc", "label").agg(F.min_by("found", "p.rank").alias("found"))
    hint = F.concat_ws(": ", "label", "found")
    return first.groupBy("file_id", "sheet", hint.alias("hint")).agg(F.min(F.struct("lr", "lc")).alias("at"))


def workbook_text(cells: DataFrame) -> DataFrame:
    """``file_id, text``: for each sheet its name, its hints, then its rows; ``cells`` also have ``sheet_ord``."""
    rows = cells.groupBy("file_id", "sheet", "sheet_ord", "r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("value", F.lit("")).alias("v")))).alias("x"))
    rows = rows.select("file_id", "sheet_ord", F.lit(2).alias("part"), F.struct(F.col("r").alias("a"), F.lit(0).alias("b")).alias("at"), T.rendered_row(F.col("x.v")).alias("line"))
    sheets = cells.select("file_id", "sheet", "sheet_ord").distinct()
    heads = sheets.select("file_id", "sheet_ord", F.lit(0).alias("part"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("at"), F.concat(F.lit("Hoja: "), "sheet").alias("line"))
    hints = sheet_hints(cells).join(sheets, ["file_id", "sheet"]).select("file_id", "sheet_ord", F.lit(1).alias("part"), F.struct(F.col("at.lr").alias("a"), F.col("at.lc").alias("b")).alias("at"), F.col("hint").alias("line"))
    lines = heads.unionByName(hints).unionByName(rows).where("line <> ''")
    joined = lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_ord", "part", "at", "line"))).alias("x"))
    return joined.select("file_id", F.array_join(F.col("x.line"), "\n").alias("text"))


def best_rotation(pages: DataFrame, angles: tuple[int, ...] = (0, 180, 90, 270)) -> DataFrame:
    """``file_id, page, angle, text`` of ``pages (file_id, page, angle, text)``: the best OCR score, the first angle of equals."""
    rank = sum((F.when(F.col("angle") == a, k).otherwise(0) for k, a in enumerate(angles)), F.lit(0))
    best = F.max_by(F.struct("angle", "text"), F.struct(T.ocr_score(F.coalesce("text", F.lit(""))), -rank))
    return pages.groupBy("file_id", "page").agg(best.alias("b")).select("file_id", "page", "b.*")


def _has_month(c: Column) -> Column:
    return c.rlike("|".join(V.MONTHS))


def date_hints(text: Column) -> Column:
    """Phrases of an OCR text that may hold its date, in order, each once: those of a date's shape, then lines with a month, a year and a day."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "áéíóúñ", "aeioun")
    trimmed = lambda c: F.btrim(T.spaced(c), F.lit(V.DATE_HINT_EDGES))
    found = [F.regexp_extract_all(low, F.lit("(?sU)" + p.replace("MONTHS", "|".join(V.MONTHS))), F.lit(1)) for p in V.DATE_HINTS]
    phrases = F.filter(F.transform(F.concat(*found), trimmed), lambda x: F.char_length(x) >= V.DATE_HINT_MIN)
    year = lambda c: c.rlike(V.DATE_HINT_YEAR)
    anchored = lambda c: F.contains(c, F.lit(V.DATE_HINT_ANCHOR)) & (_has_month(c) | year(c))
    lines = F.transform(F.split(low, "\r\n|[\n\r\x0b\f\x1c-\x1e\u0085\u2028\u2029]"), T.spaced)
    dated = F.filter(lines, lambda c: (_has_month(c) & year(c) & c.rlike("(?U)" + V.DATE_HINT_DAY)) | anchored(c))
    return F.array_distinct(F.concat(phrases, F.transform(dated, trimmed)))


def footer_hints(readings: Column) -> Column:
    """The first two date hints of a footer's OCR readings (an array of texts in order of trial), a line each.

    Readings after the first that has a month and a year in one hint, or with which two hints are found, are not looked at.
    """
    strong = lambda hints: F.exists(hints, lambda h: _has_month(h) & h.rlike(V.DATE_HINT_YEAR))
    start = F.struct(F.array().cast("array<string>").alias("hints"), F.lit(False).alias("done"))

    def step(state: Column, hints: Column) -> Column:
        both = F.concat(state["hints"], hints)
        return F.when(state["done"], state).otherwise(F.struct(both.alias("hints"), (strong(hints) | (F.size(both) >= V.DATE_HINTS_KEPT)).alias("done")))

    read = F.transform(F.coalesce(readings, F.array().cast("array<string>")), date_hints)
    return F.array_join(F.slice(F.array_distinct(F.aggregate(read, start, step)["hints"]), 1, V.DATE_HINTS_KEPT), "\n")
