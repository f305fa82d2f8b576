"""Errors, edges, sources, sinks and the stream."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow import values as V
from folioflow.functions import candidates as C
from folioflow.functions import fields
from folioflow.operators import batches as B
from folioflow.operators import control, pages, process, vendors
from folioflow.sources import files
from folioflow.streaming import incoming


def test_batch_errors(spark):
    assert B.check_batch_key("BATCH-20240101-120000-abc123")
    with pytest.raises(ValueError):
        B.check_batch_key("BATCH-1")
    b = spark.createDataFrame([(1, "k", "pending", None)], "id int, batch_key string, status string, created_at timestamp")
    d = spark.createDataFrame([], "id int, batch_id int, status string")
    for bad in ({"sort_by": "x"}, {"status": "partial"}, {"limit": -1}, {"offset": -1}):
        with pytest.raises(ValueError):
            B.list_batches(b, d, **bad)
    page, total = B.list_batches(b, d)
    assert [(r.id, r.total_documents) for r in page.collect()] == [(1, 0)] and total.first().total == 1


@pytest.mark.parametrize("statuses, want", [([], "failed"), (["processed"] * 2, "completed"), (["failed"], "failed"), (["processed", "failed"], "partial"), (["processed", "failed", "pending"], "partial"), (["processing", "failed"], "processing"), (["pending", "processed"], "pending"), (["failed", "pending"], "pending")])
def test_batch_status(spark, statuses, want):
    b = spark.createDataFrame([(1,)], "id int")
    d = spark.createDataFrame([(i, 1, s) for i, s in enumerate(statuses)], "id int, batch_id int, status string")
    assert [r.status for r in B.batch_status(b, d).collect()] == [want]


MANIFEST = "ordinal int, Concatenado string, Name string, Extension string, `Attributes.Size` string, `Size KB` string, Bandera string"


def test_manifest_and_pairing(spark):
    with pytest.raises(ValueError, match="Bandera"):
        control.normal_manifest(spark.createDataFrame([(0, "x")], "ordinal int, Name string"), "ordinal")
    rows = [(0, "c", " Archivo.PDF ", ".PDF", "100", "0.1", "Procesar"), (1, "c", "archivo.pdf", "pdf", "100.9", None, "procesar"), (2, "c", "otro.exe", "exe", "x", "y", "procesar"), (3, "c", None, "pdf", None, None, "no")]
    m = control.normal_manifest(spark.createDataFrame(rows, MANIFEST), "ordinal")
    assert [(r.manifest_row, r.control_key, r.is_supported) for r in m.orderBy("manifest_row").collect()] == [(2, "archivo.pdf|100|0", True), (3, "archivo.pdf|100|1", True), (4, "otro.exe|-1|0", False), (5, "|-1|0", True)]
    index = control.numbered(spark.createDataFrame([("archivo.pdf", 100, "/b"), ("archivo.pdf", 100, "/a")], "match_name string, match_size long, source_path string"), "source_path")
    p = control.paired(m, index).orderBy("manifest_row").collect()
    assert [(r.source_path, r.tracking_status) for r in p] == [("/a", "pending"), ("/b", "pending"), (None, "missing_source"), (None, "missing_source")]


def test_prepared_needs_equal_numbers(spark):
    own = spark.createDataFrame([("a", "pending")], "control_key string, tracking_status string")
    saved = spark.createDataFrame([], "ordinal int, document_id long, stored_filename string, saved_path string")
    with pytest.raises(ValueError):
        control.prepared(own, own.withColumn("ordinal", F.lit(1)), saved, "B", "now")


def test_vendor_lists(spark):
    with pytest.raises(ValueError):
        vendors.prepared(spark.createDataFrame([(1, "x")], "ordinal int, other string"), "ordinal")
    raw = spark.createDataFrame([(1, "Grupo Uno SA de CV", "abc850101xy1"), (2, "GRUPO UNO, SA de CV", "ABC850101XY1"), (3, "nan", ""), (4, None, None)], "ordinal int, `Razon Social` string, RFC string")
    got = vendors.prepared(raw, "ordinal")
    assert [(r.id, r.rfc, r.vendor_name_core) for r in got.collect()] == [(1, "ABC850101XY1", "GRUPO UNO")]
    assert vendors.load_counts(raw, got).first().asDict() == {"rows_read": 4, "rows_inserted": 1, "rows_skipped": 3}


def test_match_equals_comparison_with_all(spark):
    """Grams and length bounds lose no supplier that comparing a name with all of them finds."""
    rng = random.Random(5)
    words = ["NORTE", "NORTES", "GRUPO", "SUR", "ALIMENTOS", "LECHE", "ANDES", "BODEGA", "X", "INDUSTRIAS"]
    listed = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)}
    listed = {n: i for i, n in enumerate(sorted(listed))}

    def bent(name):
        kind, at = rng.randint(0, 5), rng.randrange(len(name))
        return [name[1:], name[:-1], "Q" + name, "EL " + name, name[:at] + "W" + name[at + 1 :], "ZZ" + name + "S"][kind]

    names = sorted({bent(rng.choice(sorted(listed))).strip() for _ in range(400)} - {""})
    v = vendors.prepared(spark.createDataFrame([(i, n, None) for n, i in listed.items()], "ordinal int, proveedor string, rfc string"), "ordinal")
    asked = spark.createDataFrame(list(enumerate(names)), "key int, name string")
    matched = vendors.matched_by_name(asked, v)
    got = {r.key: (r.vendor_id, r.score) for r in matched.where("strategy = 'fuzzy_core_name'").collect()}
    exact = {r.key for r in matched.where("strategy <> 'fuzzy_core_name'").collect()}
    cores = {r.id: r.vendor_name_core for r in v.collect()}
    forms = asked.select("key", fields.core_name(fields.match_name(F.col("name"))).alias("core")).collect()
    firsts = {c.split()[0] for c in cores.values()}
    expected, far = {}, 0
    for key, core in forms:
        if key in exact or not core:
            continue
        word = core.split()[0]
        scores = [(C.similarity(core, c), -i) for i, c in cores.items() if c.split()[0] == word or word not in firsts]
        score, i = max(scores)
        if score >= (V.SHORT_NAME_MIN if len(core.split()) <= 2 else V.LONG_NAME_MIN):
            expected[key] = (-i, round(score, 4))
            far += word not in firsts
    assert got.keys() == expected.keys() and far >= 10 and len(expected) - far >= 10
    assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1.1e-4 for k in got)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_match_takes_the_form_of_each_different_name_once(spark, monkeypatch):
    v = vendors.settled(vendors.prepared(spark.createDataFrame([(1, "Grupo Norte SA", None)], "ordinal int, proveedor string, rfc string"), "ordinal"))
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts.str.upper()

    monkeypatch.setattr(fields, "match_name", counted)
    asked = spark.range(900).selectExpr("id AS key", "element_at(array('Grupo Norte', 'grupo norte', 'Nada De Nada'), CAST(id % 3 AS INT) + 1) AS name")
    assert {r.key for r in vendors.matched_by_name(asked, v).collect()} == {k for k in range(900) if k % 3 < 2} and 0 < read.value <= 6


def test_match_stops_at_exact_hits_without_identifier(spark):
    v = vendors.prepared(spark.createDataFrame([(1, "Grupo Norte SA", None), (2, "Alimentos Industriales Norta SA", "ABC850101XY1")], "ordinal int, proveedor string, rfc string"), "ordinal")
    asked = spark.createDataFrame([(1, "grupo norte"), (2, "Alimentos Industriales Nortz"), (3, None), (4, "")], "key int, name string")
    got = {r.key: (r.vendor_id, r.strategy) for r in vendors.matched_by_name(asked, v).collect()}
    assert got[1] == (1, "exact_core_name") and got[2][1] == "fuzzy_core_name" and set(got) == {1, 2}
    docs = spark.createDataFrame([(1, None, "grupo norte"), (2, "abc850101xy1", None), (3, "x", "y"), (4, None, None)], "id int, rfc string, nombre_proveedor string")
    filled = {r.id: (r.rfc, r.nombre_proveedor) for r in vendors.filled(docs, v).collect()}
    assert filled == {1: (None, "grupo norte"), 2: ("ABC850101XY1", "Alimentos Industriales Norta SA"), 3: ("X", "y"), 4: (None, None)}


def test_paths(spark):
    v = vendors.prepared(spark.createDataFrame([(1, "Lacteos Bravo SA de CV", "ABC850101XY1")], "ordinal int, proveedor string, rfc string"), "ordinal")
    paths = spark.createDataFrame([(1, r"C:\Contratos\Lacteos Bravo (2)\x.pdf"), (2, "/data/RFC ABC850101XY1/otro.pdf"), (3, "/data/incoming/12345.pdf"), (4, None), (5, "")], "key int, path string")
    got = {r.key: (r.rfc, r.strategy) for r in vendors.from_paths(paths, v).collect()}
    assert got == {1: ("ABC850101XY1", "path_name:exact_core_name"), 2: ("ABC850101XY1", "path_rfc")}


def test_paths_read_each_different_segment_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts.map(lambda t: "ABC850101XY1" if "RFC" in t else None)

    monkeypatch.setattr(fields, "tax_id", counted)
    v = vendors.prepared(spark.createDataFrame([(1, "Lacteos Bravo SA de CV", "ABC850101XY1")], "ordinal int, proveedor string, rfc string"), "ordinal")
    where = ["'/data/RFC x/Lacteos Bravo/0001.pdf'", "'/data/Lacteos Bravo/Otro Nombre/0001.pdf'", "'/data/2024/0001.pdf'"]
    paths = spark.range(600).selectExpr("id AS key", f"element_at(array({', '.join(where)}), CAST(id % 3 AS INT) + 1) AS path")
    got = {r.key: (r.rfc, r.candidate, r.strategy) for r in vendors.from_paths(paths, v).collect()}
    assert got == {k: ("ABC850101XY1", "ABC850101XY1", "path_rfc") if k % 3 == 0 else ("ABC850101XY1", "Lacteos Bravo", "path_name:exact_core_name") for k in range(600) if k % 3 < 2}
    assert 0 < read.value <= 12


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, body in (("a/X.PDF", b"1234"), ("a/b/x.pdf", b"5678"), ("a/n", b"0")):
        (tmp_path / name).write_bytes(body)
    got = sorted((r.match_name, r.match_size, r.source_folder, r.source_extension, r.match_seq) for r in files.walk(spark, str(tmp_path)).collect())
    assert got == [("n", 1, "a", "", 0), ("x.pdf", 4, "a", "pdf", 0), ("x.pdf", 4, "b", "pdf", 1)]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error_category for r in files.texts(read).collect()}
    assert errors["n"] == "unsupported_type" and errors["X.PDF"] in ("extraction_empty", "processing_error")
    assert files.table_or_none(spark, str(tmp_path / "none")) is None


def test_replace_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    files.write_csv(spark.range(2), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_newest_and_truth(spark, tmp_path):
    f = spark.createDataFrame([("/x/a.xlsx", 5), ("/x/Vendor Master BD.xlsx", 1), ("/x/b.xlsx", 9)], "path string, modificationTime int")
    assert files.newest(f).first().path == "/x/Vendor Master BD.xlsx"
    assert files.newest(f.where("path not like '%Master%'")).first().path == "/x/b.xlsx"
    (tmp_path / "t.csv").write_text("doc_id,filename,source_type,is_scanned,tipo_documento_expected,rfc_expected,nombre_proveedor_expected,fecha_documento_expected,fecha_documento_iso,split,notes\n1,a.pdf,pdf,true,T,R,N,F,2024-01-01,train,\n")
    assert files.truth(spark, str(tmp_path / "t.csv")).first().is_scanned is True


def test_rules_from_a_file(tmp_path):
    assert files.rules()[1] == "Documentos Varios"


def test_empty_pages(spark):
    f = spark.createDataFrame([("a", "a.pdf", 0), ("b", "b", 0), ("c", "c.msg", 3)], "file_id string, file_path string, n_pages int")
    p = spark.createDataFrame([], "file_id string, page_index int, page_text string")
    assert {r.file_id: r.route for r in pages.page_routes(f, p).collect()} == {"a": "ocr_image", "b": "unknown", "c": "structured_document"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": i, "raw_text": f"PROVEEDOR: Grupo {c} SA\nRFC: ABC850101XY1", "file_path": "/x", "file_hash": h, "arrived": "2024-01-01T00:00:00"} for i, (c, h) in enumerate([("Uno", "a"), ("Dos", "b"), ("Uno", "a")])]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    v = vendors.prepared(spark.createDataFrame([(1, "Grupo Uno SA", "ABC850101XY1")], "ordinal int, proveedor string, rfc string"), "ordinal")
    query = incoming.run(incoming.incoming(spark, str(tmp_path / "in")), lambda df: process.processed(df, v, 2024), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.rfc for r in got) == ["ABC850101XY1"] * 2 and all(r.status == "processed" for r in got)


def test_report_kpis_fall_back(spark):
    rows = [(1, 4, None, None, None, 1, None), (2, 4, 2.5, 80.0, 1.25, 1, 99.0), (3, None, None, None, None, None, None), (4, 0, 1.0, 0.0, 0.0, 0, None)]
    made = spark.createDataFrame(rows, "batch_id int, total_documents long, processing_seconds double, average_quality double, total_size_mb double, processed long, processed_pct double")
    got = {r.batch_id: tuple(r)[1:] for r in B.kpis(made).collect()}
    assert got == {1: (0.0, 4, 0.0, 25.0, 0.0), 2: (2.5, 4, 80.0, 99.0, 1.25), 3: (0.0, 0, 0.0, 0.0, 0.0), 4: (1.0, 0, 0.0, 0.0, 0.0)}


def test_stored_paths(spark):
    rows = [(1, "k", "7", " a "), (2, "k", "7.0", "b"), (3, "k", "x", "c"), (4, "k", "8", None), (5, "other", "7", "d"), (6, None, "9", "e")]
    table = spark.createDataFrame(rows, "o int, batch_key string, batch_document_id string, source_path string")
    assert [tuple(r) for r in control.stored_paths(table, "o", "k").collect()] == [("k", 7, "b")]
    assert control.stored_paths(table, "o").count() == 2
    assert control.stored_paths(table.drop("source_path"), "o", "k").collect() == []


def test_health(spark, tmp_path):
    report = files.health(spark, str(tmp_path / "incoming")).first()
    assert report.checks["database"] and report.checks["upload_dir_writable"] and (tmp_path / "incoming").is_dir()
    assert (report.status == "ok") == all(report.checks.values())
    (tmp_path / "file").write_text("")
    assert files.health(spark, str(tmp_path / "file" / "below")).first().status == "degraded"
