"""Page texts as a data source: ``spark.read.format("page_texts")`` and ``df.write.format("page_texts")``.

Files are ``<root>/<paper>/pNN.txt``.  The reader makes a partition of every few files.  A writing task puts
its files into a folder of its own under ``<root>/_writing-<job>``; the commit of the job moves them
into place, and an abort removes that folder, so a job that fails leaves nothing.  A task that runs
again has a folder of its own too; only those of tasks that were committed are moved.  An empty page is written
as a line break and read as empty.  root is a path or a URI that Arrow's file systems know."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "paper string, page_number int, full_text string"
_NAME = re.compile(r"([^/]+)/p([0-9]+)\.txt$")


def _store(root: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Done(WriterCommitMessage):
    folder: str
    n: int


class Reader(DataSourceReader):
    def __init__(self, root: str, files: int):
        self.root, self.files = root, files

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.root)
        paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and _NAME.search(f.path) and "/_writing-" not in f.path)
        return [Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        store, _ = _store(self.root)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                text = f.read().decode()
            paper, number = _NAME.search(path).groups()
            yield paper, int(number), "" if text == "\n" else text


class Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, f"_writing-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, base = _store(self.root)
        folder, made, n = f"{base}/{self.job}/{uuid.uuid4().hex[:12]}", set(), 0
        for r in rows:
            if r.paper is None or r.page_number is None or "/" in r.paper:
                raise ValueError(f"page {r.page_number} of paper {r.paper!r} has no file name")
            if r.paper not in made:
                store.create_dir(f"{folder}/{r.paper}", recursive=True)
                made.add(r.paper)
            with store.open_output_stream(f"{folder}/{r.paper}/p{r.page_number:02d}.txt") as out:
                out.write((r.full_text or "").encode() or b"\n")
            n += 1
        return Done(folder, n)

    def commit(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.root)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.type == fs.FileType.Directory and not f.base_name.startswith("_writing-"):
                    store.delete_dir(f.path)
        for folder in (m.folder for m in messages if m and m.n):
            for paper in store.get_file_info(fs.FileSelector(folder)):
                store.create_dir(f"{base}/{paper.base_name}", recursive=True)
                for page in store.get_file_info(fs.FileSelector(paper.path)):
                    store.move(page.path, f"{base}/{paper.base_name}/{page.base_name}")
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.root)
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class PageTexts(DataSource):
    """Options: path; files, how many a partition reads at most (64)."""

    @classmethod
    def name(cls) -> str:
        return "page_texts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("files", 64)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageTexts)


def read_pages(spark: SparkSession, root: str, files: int = 64) -> DataFrame:
    register(spark)
    return spark.read.format("page_texts").option("files", files).load(root)


def write_pages(pages: DataFrame, root: str, overwrite: bool = False) -> None:
    register(pages.sparkSession)
    rows = pages.selectExpr("cast(paper as string) paper", "cast(page_number as int) page_number", "cast(full_text as string) full_text")
    rows.write.format("page_texts").mode("overwrite" if overwrite else "append").save(root)
