"""JSON lines, page-text files, PDF pages and session files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import SESSION


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a missing path is empty, a bad line raises unless strict is off."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes every field, nulls too; returns the number of rows."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
    return df.count()


def page_file_name(page_number: Column) -> Column:
    return F.format_string("p%02d.txt", page_number)


def split_page_name(name: Column) -> Column:
    """``<paper>_<page>.txt`` at the last underscore: struct of paper and two-digit page; null where it is not such a name."""
    stem = F.regexp_extract(name, r"^(.*)_([0-9]+)\.txt$", 1)
    number = F.regexp_extract(name, r"^(.*)_([0-9]+)\.txt$", 2)
    return F.when(number != "", F.struct(stem.alias("paper"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number).alias("page")))


def read_page_texts(spark: SparkSession, root: str) -> DataFrame:
    """paper, page_number, full_text of ``<root>/<paper>/pNN.txt``; a page that is only a line break is empty, files without content are passed over."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "p*.txt").text(root, wholetext=True)
    path = F.input_file_name()
    return pages.select(F.regexp_extract(path, r"([^/]+)/p[0-9]+\.txt$", 1).alias("paper"), F.regexp_extract(path, r"/p([0-9]+)\.txt$", 1).cast("int").alias("page_number"), F.when(F.col("value") == "\n", "").otherwise(F.col("value")).alias("full_text"))


def write_page_texts(pages: DataFrame, root: str) -> int:
    """full_text of (paper, page_number, full_text) as ``<root>/<paper>/pNN.txt``, a file for each page; returns how many.

    Executors write the files through Arrow's file system of root (a path or a URI that it knows); a task that runs again
    writes the same pages over.  An empty page is written as a line break, as readers pass over files without content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for f in frames:
            for paper, page, text in zip(f.paper, f.page, f.text):
                folder = f"{base.rstrip('/')}/{paper}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{page}") as out:
                    out.write(text.encode() or b"\n")
            yield pd.DataFrame({"n": [len(f)]})

    rows = pages.select("paper", page_file_name(F.col("page_number")).alias("page"), F.coalesce("full_text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def reshape_metadata(rows: DataFrame, top: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows with the columns of top as they are and those of fields in a struct metadata; what a row lacks is null."""
    value = lambda c: (F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(c)
    return rows.select(*map(value, top), F.struct(*map(value, fields)).alias("metadata"))


def strip_metadata(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Only the columns of kept, those that are there."""
    return rows.select(*(F.col(f"`{c}`") for c in kept if c in rows.columns))


def rename_key(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumnRenamed(old, new)


def read_pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """source_path, page_number, full_text of PDF files; extract turns a file into its pages' texts ("" for an empty page)."""
    if extract is None:
        try:
            import io

            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs the pypdf package or an extract function") from e

        def extract(data: bytes) -> list[str]:
            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f.path, f.content):
                try:
                    rows += [(path, i, t) for i, t in enumerate(extract(bytes(data)), 1)]
                except FileNotFoundError:
                    raise
                except Exception as e:
                    raise ValueError(f"{path} cannot be read as PDF: {e}") from e
            yield pd.DataFrame(rows, columns=["source_path", "page_number", "full_text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_path string, page_number int, full_text string")


def load_session(spark: SparkSession, path: str) -> DataFrame:
    """The session's one row; a missing or broken file is the empty session."""
    empty = spark.createDataFrame([("", [], [], [], 0, None)], SESSION)
    if not exists(spark, path):
        return empty
    rows = spark.read.schema(SESSION).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("query is not null").limit(1)
    return rows if rows.count() else empty


def save_session(session: DataFrame, path: str) -> None:
    session.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
