"""Literal cases of the field functions, run through Spark."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import candidates as C
from folioflow.functions import doctype, fields, nearest, quality, taxid
from folioflow.functions import text as T


def values(spark, expression, cases, kind="string"):
    rows = spark.createDataFrame(list(enumerate(cases)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, expression, table, kind="string"):
    got = values(spark, expression, [x for x, _ in table], kind)
    assert [(x, y) for (x, _), y in zip(table, got)] == table


def test_tax_ids(spark):
    far = " texto" * 40
    check(
        spark,
        fields.tax_id,
        [
            ("El proveedor con RFC GARC850101AB3 firmo el contrato", "GARC850101AB3"),
            ("Tax ID: 12-1234567", "12-1234567"),
            ("US FEDERAL TAX ID 123456789", "12-3456789"),
            ("EL CLIENTE RFC CCO8605231N4\nEL PROVEEDOR RFC GARC850101AB3", "GARC850101AB3"),
            (f"EL CLIENTE RFC ABCD900101XY1{far}\n{far}\nEL PROVEEDOR RFC GARC850101AB3", "GARC850101AB3"),
            ("ABCD850101AB1 sin etiqueta\ny mas\nRFC: XYZA900515MN2", "XYZA900515MN2"),
            ("RFC: GARC 85 01 01 AB3", "GARC850101AB3"),
            ("RFC: AGD-811217-HS7", "AGD811217HS7"),
            ("CURP: GARC850101HDFRRL09", None),
            ("RFC: GARC859901AB3", None),
            ("RFC: CCO8605231N4", None),
            ("NOMBRE DEL PROVEEDOR: Juan\nRFC: BAAV7822025P7\nDOMICILIO FISCAL", "BAAV7822025P7"),
            ("", None),
            (None, None),
        ],
    )


def test_dates(spark):
    check(
        spark,
        fields.document_date,
        [
            *((x, "2024-01-15") for x in ("Fecha 2024-01-15", "Fecha 15/01/2024", "15-01-2024", "15.01.2024", "15 de enero de 2024")),
            ("Fecha de emision: 2024-03-01" + " x" * 200 + " 15/06/2023", "2024-03-01"),
            ("01/06/1980", None),
            ("15 de sept de 2024", "2024-09-15"),
            ("15 de 06 del 2024", "2024-06-15"),
            ("Agosto 26, 2016", "2016-08-26"),
            ("Fecha de Entrega: 24/May/14", "2014-05-24"),
            ("Fecha de Entrega: [24 MOy1 14 ]", "2014-05-24"),
            ("28 de febrero de 20/22", "2022-02-28"),
            ("segun la ley de 15/01/2024", None),
            ("15/01/69 y 1/1/05", "2005-01-01"),
            ("", None),
            (None, None),
        ],
    )
    check(spark, fields.month_number, [("sept", 9), ("oct", 10), ("MOy", 5), ("junto", None), ("ab", None), ("mayoreo", 5)])


def test_one_edit_is_levenshtein(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("aemy") for _ in range(rng.randrange(5))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (F.levenshtein("a", "b") <= 1).alias("near"))
    assert all(C.near(r.a, r.b) == r.near for r in df.collect())


def test_types(spark):
    check(
        spark,
        doctype.document_type,
        [
            ("Contrato de comida rápida", "Comida Rapida"),
            ("CARTA SOPORTE de costos", "Carta Soporte Costos"),
            ("carta soporte costo y descuento", "Carta Soporte Descuentos"),
            ("carta anexo convenio entrega en cedis", "Carta Anexo a Convenio Entrega a Cedis"),
            ("texto cualquiera", "Documentos Varios"),
            ("!!!", None),
            ("", None),
            (None, None),
        ],
    )


def test_names(spark):
    check(
        spark,
        fields.supplier_name,
        [
            ("PROVEEDOR: Comercial Norte SA de CV", "Comercial Norte SA de CV"),
            ("EMISOR: Juan Perez Lopez", "Juan Perez Lopez"),
            ("RAZON SOCIAL: Lacteos del Sur, S.A. de C.V.", "Lacteos del Sur, S.A. de C.V"),
            ("PROVEEDOR Grupo Uno SA", "Grupo Uno SA"),
            ("Razón Social: Feli pe Garcia Lopez", "Felipe Garcia Lopez"),
            ("PROVEEDOR: NOMBRE DEL PROVEEDOR", None),
            ("PROVEEDOR: AB", None),
            ("PROVEEDOR: CADENA COMERCIAL OXXO SA DE CV", None),
            ("confirma su acuerdo con Pan Dulce SA de CV a quien en lo sucesivo se le denominara", "Pan Dulce SA de CV"),
            (None, None),
        ],
    )
    check(spark, fields.match_name, [("y  Grupo Catana, S.A. de C.V. con RFC X", "GRUPO CATANA S A DE C V"), (None, ""), ("proveedor: Leche Ñandú", "PROVEEDOR LECHE NANDU"), ("acuerdo con Leche Ñandú", "LECHE NANDU")])
    check(spark, fields.core_name, [("GRUPO CATANA SA DE CV", "GRUPO CATANA"), ("SA DE CV", "SA DE CV"), ("", "")])


def test_tax_id_functions(spark):
    check(spark, taxid.ocr_normal, [("garc-8SOIOI-ab3", "GARC850101AB3"), ("AGD8II2l7HS7", "AGD811217HS7"), ("ñABC850101XY1", "ABC850101XY1"), ("ñx", "ÑX"), (None, "")])
    check(spark, taxid.canonical, [("12 3456789", "12-3456789"), (" agd-811217hs7 ", "AGD811217HS7"), (" - ", None), (None, None)])
    check(spark, taxid.acceptable, [("GARC850101AB3", True), ("GARC850230AB3", False), ("ABC850101AB", False), ("", False), (None, False)])
    check(spark, taxid.check_digit_is_right, [("VESF940524LT8", True), ("VESF940524LT9", False), ("x", False), (None, False)])
    check(spark, taxid.person_prefix, [("Felipe Velazquez Solis", "VESF"), ("JOSE Felipe Velázquez Solís", "VESF"), ("Uno Dos", None), ("Grupo Uno SA de CV", None), (None, None)])
    check(spark, lambda c: taxid.repaired(c, F.lit("Felipe Velazquez Solis")), [("RFC VESE9405249TB", "VESF940524LT8"), ("RFC: VESF940524LT8", "VESF940524LT8"), ("RFC VESE 940524 1T8", "VESF940524LT8"), ("nada", None), (None, None)])
    check(spark, taxid.best_of, [(["", "zz", "GARC850101AB3", "VESF940524LT8"], "VESF940524LT8"), (["zz", "GARC850101AB3"], "GARC850101AB3"), (["zz"], "ZZ"), ([], None)], "array<string>")
    check(spark, taxid.hint_in, [("RFC ABCD850101XY1", None), ("ABCD 85O1O1 XY1", "ABCD850101XY1"), (None, None)])


def test_quality(spark):
    good = ("GARC850101AB3", "2024-01-15", "Comida Rapida", "Uno Dos SA")
    cases = [
        (good, 100, "verde", []),
        ((None,) * 4, 0, "rojo", ["missing_rfc", "missing_fecha_documento", "missing_tipo_documento", "missing_nombre_proveedor"]),
        (("12-1234567", *good[1:]), 96, "verde", []),
        (("GARC851301AB3", *good[1:]), 82, "amarillo", ["invalid_rfc_date"]),
        (("mal", *good[1:]), 76, "amarillo", ["invalid_rfc_format"]),
        ((good[0], "2090-01-01", *good[2:]), 79, "amarillo", ["fecha_future"]),
        ((good[0], "2024-02-30", *good[2:]), 76, "amarillo", ["invalid_fecha_value"]),
        ((*good[:2], "Documentos Varios", "ab"), 74, "amarillo", ["tipo_documento_fallback", "nombre_proveedor_too_short"]),
    ]
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string")
    got = rows.select("i", quality.scored(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 2024).alias("q")).orderBy("i").collect()
    assert [(r.q.score, r.q.traffic_light, r.q.reasons) for r in got] == [c[1:] for c in cases]


def test_forms(spark):
    check(spark, T.extension, [("SCAN.PDF", "pdf"), ("none", ""), ("", ""), (None, "")])
    check(spark, T.hyperlink, [('C:\\a "B"\\c', '=HYPERLINK("C:\\a ""B""\\c")'), ("", ""), (None, "")])
    check(spark, T.letter_share, [("abc", 1.0), ("  \n", 0.0), ("ab12", 0.5)])
    check(spark, T.word_count, [("the quick brown fox jumps over the lazy dog", 9), ("a bc", 0), ("123", 0), ("abc123", 1)])
    check(spark, T.ocr_score, [("", 0), (None, 0)])
    check(spark, T.is_date_anchor, [("Fecha:", True), ("FECMA", True), ("fec", False), (None, False)])
    check(spark, T.whole_id, [("7", 7), ("7.0", 7), ("7.5", None), ("x", None), (None, None)])
    check(spark, T.clock, [(61, "01:01"), (3600, "01:00:00"), (-5, "00:00")], "int")
    check(spark, T.sampled_pages, [(0, []), (3, [0, 1, 2]), (6, [0, 1, 3, 4, 5]), (100, [0, 25, 50, 75, 99])], "int")
    check(spark, T.repair_mojibake, [("raz" + "ÃƒÂ³" + "n", "razon")])
    check(spark, T.evaluation_form, [("Convenio  LOGÍSTICO.", "convenio logistico"), (None, "")])
    assert T.find_header(["Vendor Name", "RFC"], ("vendorname",)) == "Vendor Name" and T.find_header(["x"], ("rfc",)) is None


@pytest.mark.parametrize("a, b, least, most", [("abc", "abc", 1, 1), ("", "abc", 0, 0), ("GRUPO NORTE", "GRUPO NORTF", 0.7, 0.99), ("UNO DOS", "DOS UNO", 0.6, 0.95), ("X", "QQQ ZZZ", 0, 0.1)])
def test_similarity(a, b, least, most):
    assert least - 1e-9 <= C.similarity(a, b) <= most + 1e-9


def test_token_ratios():
    assert C.ratio("abcd", "abxd") == 0.75 and C.token_sort("b a", "a b") == 1.0
    assert C.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0 and C.token_set("a", "") == 0.0


def test_nearest_equals_comparison_with_all_and_makes_few(monkeypatch):
    rng, places = random.Random(3), ("MONTERREY", "GUADALUPE", "HIDALGO", "ZARAGOZA", "GRUPO")
    listed = sorted({f"GRUPO {rng.choice(places)} {''.join(rng.choices('QWERTY', k=rng.randint(1, 5)))}{rng.choice(['', ' GRUPO'])}" for _ in range(1500)})
    names, made, plain = nearest.Names(listed), [], C.similarity
    monkeypatch.setattr(nearest, "similarity", lambda *a: made.append(a) or plain(*a))
    asked = [x[:-1] for x in listed[::25]] + [x[:8] + "X" + x[9:] for x in listed[::25]] + [x + " GRUPO QW" for x in listed[::50]] + ["GRUPO", "GRUPO Z"]
    asked = [x.strip() for x in asked if x.strip() not in names.all]
    for name in asked:
        scores = {x: plain(name, x) for x in listed}
        high = max(scores.values())
        found = [hit for hit in names.nearest(name, 0.82) if hit[1] >= 0.82]
        assert sorted(found) == sorted((x, s) for x, s in scores.items() if s == high and high >= 0.82)
    assert len(made) < len(asked) * len(listed) / 20 and nearest.Names([]).nearest("GRUPO", 0.82) == []
