"""Fields from text: Arrow functions offer candidates, column expressions choose among them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from . import candidates as C
from . import text as T

CANDIDATES = "array<struct<value:string,base:int,position:int,ordinal:int,context:string>>"


def _by_text(function, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t) if isinstance(t, str) and t else None)

    return run


def _rows(function):
    return lambda text: [c._asdict() for c in function(text)]


def tax_id(text: Column) -> Column:
    """The best identifier: the label and words around count, then the place; without one the fallbacks."""
    offered = _by_text(_rows(C.tax_candidates), CANDIDATES)(text)

    def score(c):
        about = c["context"]
        return (
            c["base"]
            + F.when(about.contains("RFC") | about.contains("REGISTRO FEDERAL DE CONTRIBUYENTES"), 25).otherwise(0)
            + F.when(about.contains("PROVEEDOR"), 30).otherwise(0)
            - F.when(about.contains("EL CLIENTE") | about.contains("OXXO"), 20).otherwise(0)
        )

    ranked = F.transform(offered, lambda c: F.struct((-score(c)).alias("s"), c["position"].alias("p"), c["ordinal"].alias("o"), c["value"].alias("value")))
    return F.coalesce(F.array_min(ranked)["value"], F.when(F.coalesce(F.size(offered), F.lit(0)) == 0, _by_text(C.tax_fallback, "string")(text)))


def document_date(text: Column, document_type: Column | None = None) -> Column:
    """The best date from 2000 on outside of legal contexts, as an ISO string."""
    offered = _by_text(_rows(C.date_candidates), CANDIDATES)(text)
    signed = F.coalesce(T.type_form(document_type).isin(*V.SIGNATURE_TYPES), F.lit(False)) if document_type is not None else F.lit(False)
    legal = r"(?U)\b(" + "|".join(V.LEGAL_CONTEXT) + r")\b"
    usable = F.filter(offered, lambda c: (c["value"] >= V.DATE_FLOOR) & ~c["context"].rlike(legal))

    def score(c):
        about = c["context"]
        has = lambda *terms: F.when(T_any(about, terms), 1).otherwise(0)
        hits = sum((has(t) for t in V.SIGNATURE_TERMS), F.lit(0))
        return (
            c["base"]
            + 8 * has("siendo el dia")
            + 6 * has("fecha del documento", "fecha de documento", "fecha de emision")
            + 12 * has("fecha de entrega")
            + 3 * has("anexo al convenio")
            + 2 * has("fecha")
            + F.least(F.lit(18), 5 * hits)
            + F.when(signed & (hits > 0), 8).otherwise(0)
        )

    ranked = F.transform(usable, lambda c: F.struct((-score(c)).alias("s"), c["position"].alias("p"), c["ordinal"].alias("o"), c["value"].alias("value")))
    return F.array_min(ranked)["value"]


def T_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def supplier_name(text: Column) -> Column:
    return _by_text(C.supplier_name, "string")(text)


def company_name(raw: Column) -> Column:
    return _by_text(C.company_name, "string")(raw)


def match_name(raw: Column) -> Column:
    """Empty for null."""
    return F.coalesce(_by_text(C.match_name, "string")(raw), F.lit(""))


def core_name(name: Column) -> Column:
    """A match name without legal words, or whole if it has no others."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.isin(*V.LEGAL_TOKENS))
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(words), " ")


def month_number(raw: Column) -> Column:
    return _by_text(C.month_of, "int")(raw)


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Scores below ``least`` may be 0."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([C.similarity(p, q, least) if isinstance(p, str) and isinstance(q, str) else 0.0 for p, q in zip(x, y)])

    return run(a, b)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard share of words, native; 0 where one has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def tax_id_in_document(text_id: Column, raw: Column, name: Column, hint: Column) -> Column:
    """What a document's identifier is, given that of its text, its raw text, its supplier and an OCR hint.

    Only where there is a hint does a repaired identifier compete; order of trust is text, repaired, hint.
    """
    from . import taxid

    repair = F.when(text_id.isNull() & name.isNotNull(), F.coalesce(taxid.repaired(raw, name), taxid.repaired(hint, name)))
    return F.when(hint.isNotNull() & (hint != ""), taxid.best_of(F.filter(F.array(text_id, repair, hint), lambda x: x.isNotNull()))).otherwise(text_id)
