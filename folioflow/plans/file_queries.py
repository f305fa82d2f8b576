"""Queries that write files to the shared folder and read them back: workbooks, word-processor documents, stored suppliers, date hints."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import pages as P
from ..operators import vendors as S
from ..session import shared_folder
from ..sources import files, office
from .control_queries import _MANIFEST, _manifest
from .registry import register
from .standins import table
from .vendor_queries import _VENDORS, _raw


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}/{name}"


def _written(spark, name: str, **sheets):
    path = _place(spark, name)
    office.write_workbook(sheets, path)
    return path


@register("src04_manifest_workbook", f"WITH {_MANIFEST} SELECT manifest_row, is_supported, flag AS bandera_source, match_seq, match_name || '|' || match_size || '|' || match_seq AS control_key FROM n")
def manifest_workbook(spark, sf_dir):
    path = _written(spark, "manifest.xlsx", Hoja1=_manifest(spark, sf_dir).orderBy("ordinal").drop("ordinal"))
    return C.normal_manifest(office.read_workbook(spark, path, None), "ordinal").select("manifest_row", "is_supported", "bandera_source", "match_seq", "control_key")


@register("src05_snk05_vendor_workbook", f"WITH {_VENDORS} SELECT core AS vendor_name_core, rfc, count(*) AS copies FROM v, (SELECT unnest([1, 2])) GROUP BY ALL")
def vendor_workbook(spark, sf_dir):
    """A list loaded from a workbook, stored in place of what was there, and then added once more."""
    path = _written(spark, "list.xlsx", Hoja=_raw(spark, sf_dir).orderBy("ordinal").drop("ordinal"))
    loaded, stored = S.prepared(office.read_workbook(spark, path, None), "ordinal"), _place(spark, "suppliers")
    files.store_suppliers(loaded.limit(0), stored)
    files.store_suppliers(loaded, stored)
    files.store_suppliers(loaded, stored, replace=False)
    return spark.read.parquet(stored).groupBy("vendor_name_core", "rfc").agg(F.count("*").alias("copies"))


@register("snk06_bootstrap", "SELECT unnest(['file_not_found', 'loaded', 'already_loaded']) AS outcome, unnest([0, count(*), count(*)]) AS suppliers FROM supplier")
def bootstrap(spark, sf_dir):
    stored = _place(spark, "suppliers")
    loaded = S.prepared(_raw(spark, sf_dir), "ordinal")
    seen = []
    for load in (lambda: None, lambda: loaded, lambda: loaded.limit(0)):
        outcome = files.bootstrap(spark, stored, load)
        found = files.table_or_none(spark, stored)
        seen.append((outcome, 0 if found is None else found.count()))
    return spark.createDataFrame(seen, "outcome string, suppliers long")


@register("snk02_snk03_workbook_sheets", "SELECT n_nationkey, n_name, CAST(n_regionkey * 0.5 AS DOUBLE) AS half, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def workbook_sheets(spark, sf_dir):
    """Two sheets written to one workbook and read back, numbers and texts as they were."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_regionkey") * 0.5).alias("half"), F.lit(None).cast("string").alias("none"))
    path = _written(spark, "two.xlsx", control=nation, batch_summary=table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    one, two = office.read_workbook(spark, path, 0), office.read_workbook(spark, path, 1).drop("ordinal")
    both = one.join(two, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").cast("int"), "n_name", F.col("half").cast("double"), F.col("n_regionkey").cast("int"), "r_name")


@register("src17_src22_workbook_file", "SELECT 'Hoja: N' || chr(10) || string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS text, NULL AS error_category FROM nation")
def workbook_file(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey").collect()
    path = _place(spark, "text.xlsx")
    body = office.workbook_bytes({"N": ([], [tuple(r) for r in rows])})
    spark.createDataFrame([(path, bytearray(body))], "path string, content binary").write.parquet(path + ".parquet")
    return files.texts(spark.read.parquet(path + ".parquet")).select("text", "error_category")


@register("src19_document_file", "SELECT 'Convenio ' || n_name || chr(10) || 'Clave | ' || n_nationkey || chr(10) || 'pie de ' || n_name AS text FROM nation")
def document_file(spark, sf_dir):
    """A word-processor document for each nation: a paragraph, a table row and a footer."""
    name = office.WORD[1:-1]

    def document(nation: str, key: int) -> bytes:
        part = lambda inside, tag: f'<w:{tag} xmlns:w="{name}">{inside}</w:{tag}>'
        line = lambda words: f"<w:p><w:r><w:t>{words}</w:t></w:r></w:p>"
        row = "".join(f"<w:tc>{line(x)}</w:tc>" for x in ("Clave", " ", key))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            book.writestr("word/document.xml", part(f"<w:body>{line(f'Convenio  {nation}')}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body>", "document"))
            book.writestr("word/footer1.xml", part(line(f"pie de {nation}"), "ftr"))
        return out.getvalue()

    rows = [(f"/x/{r.n_nationkey}.docx", bytearray(document(r.n_name, r.n_nationkey))) for r in table(spark, sf_dir, "nation").collect()]
    return files.texts(spark.createDataFrame(rows, "path string, content binary")).where("error_category IS NULL").select("text")


_HINTED = """
WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 28 + 1 AS VARCHAR) AS d, ['enero','mayo','diciembre'][o_orderkey % 3 + 1] AS m, CAST(1995 + o_orderkey % 30 AS VARCHAR) AS y, o_orderkey % 4 AS c FROM orders)
SELECT o_orderkey, CASE c WHEN 0 THEN d || ' de ' || m || ' de ' || y WHEN 1 THEN m || ' ' || d || ', ' || y WHEN 2 THEN '' ELSE 'siendo el dia ' || d || ' de ' || m || ' de ' || y || chr(10) || d || ' de ' || m || ' de ' || y END AS hints FROM k
"""


@register("txt18_srt07_date_hints", _HINTED)
def hints(spark, sf_dir):
    """Footers with a date in a phrase, in a line, in none, and in an anchored phrase; a reading after a strong one says something else."""
    key = F.col("o_orderkey")
    d, y = (key % 28 + 1).cast("string"), (F.lit(1995) + key % 30).cast("string")
    m = F.element_at(F.array(F.lit("Enero"), F.lit("MAYO"), F.lit("diciembre")), (key % 3 + 1).cast("int"))
    phrase = F.concat(d, F.lit("  de\n"), m, F.lit(" de "), y)
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("firman\n"), phrase, F.lit(".")))
        .when(key % 4 == 1, F.concat(F.lit("x\r\n "), m, F.lit("  "), d, F.lit(", "), y, F.lit(" .\ny")))
        .when(key % 4 == 2, F.concat(F.lit("siendo el dia "), d))
        .otherwise(F.concat(F.lit("SIENDO EL DÍA "), d, F.lit(" de "), m, F.lit(" de "), y))
    )
    later = F.when(key % 4 == 2, "nada").otherwise("1 de enero de 1999")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.footer_hints(F.array(F.lit("ruido"), text, later)).alias("hints"))
