"""The type of a document by weighted terms, as one native expression over the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from . import text as T


def _has_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def rule_score(form: Column, first_page: Column, first_lines: Column, some, every, never) -> Column:
    """Score of one rule on a text in type form; null where a gate fails."""
    gate = F.lit(True)
    if some:
        gate = gate & _has_any(form, some)
    for t in every:
        gate = gate & form.contains(t)
    if never:
        gate = gate & ~_has_any(form, never)
    lead = some or every
    score = F.lit(10 + 10 * len(every)) + sum((F.when(form.contains(t), 8).otherwise(0) for t in some), F.lit(0))
    score = score + F.when(_has_any(first_page, lead), 35).otherwise(0) + F.when(_has_any(first_lines, lead), 15).otherwise(0)
    return F.when(gate, score)


def document_type(text: Column, rules=V.DOCUMENT_TYPES, default: str = V.DEFAULT_TYPE) -> Column:
    """The best rule's name, the first of equals; the default if none fits; null if nothing is left of the text."""
    form = T.type_form(F.coalesce(text, F.lit("")))

    def best(x: Column) -> Column:
        parts = (x["form"], x["page"], x["lines"])
        ranked = [F.struct(rule_score(*parts, *rule[1:]).alias("score"), F.lit(-k).alias("rank"), F.lit(rule[0]).alias("name")) for k, rule in enumerate(rules)]
        name = F.array_max(F.filter(F.array(*ranked), lambda r: r["score"].isNotNull()))["name"]
        return F.when(x["form"] != "", F.coalesce(name, F.lit(default)))

    # bound by lambdas, as each rule would else compute the form anew for each of its terms
    forms = F.transform(F.array(form), lambda f: F.struct(f.alias("form"), f.substr(1, V.FIRST_PAGE).alias("page"), f.substr(1, V.FIRST_LINES).alias("lines")))
    return F.transform(forms, best)[0]


def rules_table(spark, rules=V.DOCUMENT_TYPES):
    """The rules as rows, for joins."""
    return spark.createDataFrame([(k, n, list(a), list(e), list(x)) for k, (n, a, e, x) in enumerate(rules)], "rank int, name string, any_terms array<string>, all_terms array<string>, none_terms array<string>")


def types_by_join(docs, rules, default: str = V.DEFAULT_TYPE):
    """``id, tipo_documento`` for ``docs (id, text)`` with rules that come as a table: a theta join and an argmax.

    The rules are a small table by nature; Spark broadcasts them if they are, and else it still joins right.
    """
    forms = docs.select("id", T.type_form(F.coalesce("text", F.lit(""))).alias("form"))
    form = F.col("form")
    some, every, never = F.col("any_terms"), F.col("all_terms"), F.col("none_terms")
    fits = (
        ((F.size(some) == 0) | F.exists(some, lambda t: form.contains(t)))
        & F.forall(every, lambda t: form.contains(t))
        & ~F.exists(never, lambda t: form.contains(t))
        & (form != "")
    )
    lead = F.when(F.size(some) > 0, some).otherwise(every)
    score = (
        10
        + 10 * F.size(every)
        + 8 * F.size(F.filter(some, lambda t: form.contains(t)))
        + F.when(F.exists(lead, lambda t: form.substr(1, V.FIRST_PAGE).contains(t)), 35).otherwise(0)
        + F.when(F.exists(lead, lambda t: form.substr(1, V.FIRST_LINES).contains(t)), 15).otherwise(0)
    )
    best = forms.join(rules, fits, "left").groupBy("id").agg(F.max(F.when(F.col("name").isNotNull(), F.struct(score.alias("s"), (-F.col("rank")).alias("r"), "name"))).alias("best"), F.max("form").alias("form"))
    return best.select("id", F.when(F.col("form") != "", F.coalesce("best.name", F.lit(default))).alias("tipo_documento"))
