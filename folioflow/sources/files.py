"""Files and tables as sources and sinks.

Walks read metadata only; contents are read where a text is asked for. Adapters to libraries that may be
missing say so in an error column, not by an exception.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..operators import pages
from . import office

TRUTH = "doc_id string, filename string, source_type string, is_scanned boolean, tipo_documento_expected string, rfc_expected string, nombre_proveedor_expected string, fecha_documento_expected string, fecha_documento_iso string, split string, notes string"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``match_name, match_size, source_path, source_folder, source_extension, match_seq`` of all files below a folder.

    Empty files are not among them, as Spark's reader leaves them out.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")  # contents are pruned
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = meta.select(
        F.lower(F.btrim(F.regexp_extract(path, r"([^/]*)$", 1))).alias("match_name"),
        F.col("length").alias("match_size"),
        path.alias("source_path"),
        F.regexp_extract(path, r"([^/]*)/[^/]*$", 1).alias("source_folder"),
        T.extension(F.regexp_extract(path, r"([^/]*)$", 1)).alias("source_extension"),
    )
    return rows.withColumn("match_seq", F.row_number().over(Window.partitionBy("match_name", "match_size").orderBy("source_path")) - 1)


def newest(files: DataFrame, preferred: tuple[str, ...] = ("Vendor Master BD.xlsx",)) -> DataFrame:
    """``path``: a preferred name, else the workbook changed last, of ``files (path, modificationTime)``."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    books = files.where(F.lower(name).endswith(".xlsx"))
    return books.agg(F.max_by("path", F.struct(name.isin(*preferred), "modificationTime", "path")).alias("path"))


def path_list(spark: SparkSession, text: str) -> DataFrame:
    """``path`` for each line of a pasted list: quotes and blanks trimmed, the first of each without regard to case."""
    lines = spark.createDataFrame([(text or "",)], "t string").select(F.posexplode(F.split("t", r"\r\n|\r|\n")).alias("pos", "line"))
    rows = lines.select("pos", F.btrim(F.btrim(F.btrim("line"), F.lit("\"'"))).alias("path")).where("path <> ''")
    return rows.groupBy(F.lower("path").alias("k")).agg(F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos")).orderBy("pos").select("path")


def find_by_name(index: DataFrame, names: DataFrame) -> DataFrame:
    """``filename, source_path``: the first file of each name."""
    first = index.groupBy("match_name").agg(F.min("source_path").alias("source_path"))
    return names.join(first, F.lower("filename") == F.col("match_name"), "left").select("filename", "source_path")


def truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRUTH)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def rules(path: str | None = None) -> tuple[tuple, str]:
    """Document-type rules from a YAML file, if there is one and a parser for it; else the built-in ones."""
    if path and find_spec("yaml"):
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        if data.get("rules"):
            kinds = ("any_terms", "all_terms", "none_terms")
            return tuple((r["name"], *(tuple(r.get(k, ())) for k in kinds)) for r in data["rules"]), data.get("default_type", V.DEFAULT_TYPE)
    return V.DOCUMENT_TYPES, V.DEFAULT_TYPE


# sinks


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside its place and swap: what is read may be what is replaced, and a failure leaves the old one."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.old"))
    fs = here.getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.staged")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(staged, here)
    fs.delete(old, True)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True)


def store_suppliers(loaded: DataFrame, path: str, replace: bool = True) -> None:
    """Suppliers to their stored table: all of it is replaced in one step, or rows are added to it."""
    old = None if replace else table_or_none(loaded.sparkSession, path)
    replace_table(loaded if old is None else old.unionByName(loaded.select(*old.columns)), path)


def bootstrap(spark: SparkSession, path: str, load: Callable[[], DataFrame | None]) -> str:
    """Load suppliers where the stored table is missing or empty: ``loaded``, ``already_loaded`` or ``file_not_found``."""
    old = table_or_none(spark, path)
    if old is not None and not old.isEmpty():
        return "already_loaded"
    found = load()
    if found is None:
        return "file_not_found"
    store_suppliers(found, path)
    return "loaded"


# texts of files

#: What an adapter needs, by kind of file.
NEEDS = {"docx": "zipfile", "pdf": "pdfplumber", "xls": "xlrd", "xlsb": "pyxlsb", "msg": "extract_msg", **dict.fromkeys(V.IMAGE_TYPES, "pytesseract")}
#: Kinds whose texts are plans over their cells.
BOOKS = ("xlsx", "xlsm")
_ADAPTERS: dict[str, Callable[[bytes], str]] = {}


def adapter(*kinds: str):
    """Decorator: file a function from bytes to text for kinds of files."""

    def put(function):
        _ADAPTERS.update(dict.fromkeys(kinds, function))
        return function

    return put


@adapter("docx")
def _docx(raw: bytes) -> str:
    return "\n".join(office.document_lines(raw))


@adapter("pdf")
def _pdf(raw: bytes) -> str:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return "\n".join(t for p in pdf.pages if (t := p.extract_text() or ""))


def texts(files: DataFrame) -> DataFrame:
    """``path, text, error_category`` of ``files (path, content)``; a kind without adapter or library has an error, not a text.

    Workbooks are rendered from their cells; one without any, as a broken one, has an error.
    """
    is_book = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*BOOKS)
    books = files.where(is_book)
    rendered = pages.workbook_text(office.cells(books)).select(F.col("file_id").alias("path"), "text")
    of_books = books.select("path").join(rendered, "path", "left").select("path", "text", F.when(F.col("text").isNull(), "extraction_empty").alias("error_category"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                text, error = None, None
                if kind not in V.SUPPORTED_TYPES:
                    error = "unsupported_type"
                elif kind not in _ADAPTERS or not find_spec(NEEDS.get(kind, "no adapter")):
                    error = "extraction_empty"
                else:
                    try:
                        text = _ADAPTERS[kind](bytes(content)) or None
                        error = None if text else "extraction_empty"
                    except Exception:  # a broken file is a row with an error
                        error = "processing_error"
                out.append((path, text, error))
            yield pd.DataFrame(out, columns=["path", "text", "error_category"])

    others = files.where(~F.coalesce(is_book, F.lit(False))).select("path", "content").mapInPandas(run, "path string, text string, error_category string")
    return others.unionByName(of_books)


#: Checks of a report and the modules each needs.
PACKAGES = {
    "pytesseract_package": ("pytesseract",), "pypdfium2_package": ("pypdfium2",), "python_docx_package": ("docx",), "extract_msg_package": ("extract_msg",),
    "xlrd_package": ("xlrd",), "pyxlsb_package": ("pyxlsb",), "pywin32_package": ("pythoncom", "win32com"),
}


def health(spark: SparkSession, incoming: str, app_name: str = "folioflow", version: str = "") -> DataFrame:
    """One row ``app_name, version, status, timestamp, checks``; the status is ``ok`` if every check holds, else ``degraded``.

    The folder for incoming files is the driver's and is made if it is missing.
    """
    try:
        database = spark.range(1).count() == 1
    except Exception:  # whatever ails the session is what the report is about
        database = False
    try:
        os.makedirs(incoming, exist_ok=True)
        writable = os.access(incoming, os.W_OK)
    except OSError:
        writable = False
    checks = {"database": database, "tesseract": shutil.which("tesseract") is not None, "upload_dir_writable": writable}
    checks |= {name: all(find_spec(m) is not None for m in modules) for name, modules in PACKAGES.items()}
    row = (app_name, version, "ok" if all(checks.values()) else "degraded", checks)
    made = spark.createDataFrame([row], "app_name string, version string, status string, checks map<string,boolean>")
    return made.select("app_name", "version", "status", F.current_timestamp().alias("timestamp"), "checks")
