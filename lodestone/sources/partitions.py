"""Replacing some partitions of a table without ever being without them.

New files are written beside the old ones, in ``<root>/_staged/<id>``; a plan of the switch is
written last, and only then are old partitions removed and new ones moved into their place.
A job that ends before the plan is written leaves the table as it was; one that ends after it
leaves a switch that ``recover`` finishes, as often as it takes.  Partitions that are not
replaced are not touched, and files that are added are moved in by the same kind of plan.  One job at a
time may change a table.  Readers skip names that begin with an underscore."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

STAGED, PLAN = "_staged", "_PLAN"


class Folder:
    """What is needed of the file system that a path lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{self.root}: {old} was not moved to {new}")

    def write_text(self, name: str, text: str) -> None:
        """Under another name first, so that the file is there whole or not at all."""
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(f"{name}.new", name)

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def stage(rows: DataFrame, root: str, by: list[str], options: Mapping[str, str] | None = None) -> str:
    """Writes rows, as they are dealt and sorted, beside the table; returns the stage's name."""
    name = f"{STAGED}/{uuid.uuid4().hex[:12]}"
    rows.write.option("maxRecordsPerFile", 0).options(**(options or {})).partitionBy(*by).parquet(f"{root.rstrip('/')}/{name}")
    return name


def switch(spark: SparkSession, root: str, staged: str, touched: Iterable[str]) -> None:
    """touched: names of first-level partitions (``day=19723``) that the stage replaces; those it has no rows of go."""
    folder = Folder(spark, root)
    new = [n for n in folder.names(staged) if "=" in n]
    plan = [f"replace {n}" for n in new] + [f"drop {n}" for n in sorted(set(touched) - set(new))]
    folder.write_text(f"{staged}/{PLAN}", "\n".join(plan))
    finish(folder, staged)


def add(spark: SparkSession, root: str, staged: str) -> None:
    """Moves the stage's files into their partitions beside those that are there."""
    folder = Folder(spark, root)
    folder.write_text(f"{staged}/{PLAN}", "\n".join(f"add {n}" for n in folder.names(staged) if "=" in n))
    finish(folder, staged)


def finish(folder: Folder, staged: str) -> None:
    """Does what a plan says; what is done already stays done."""
    for line in filter(None, folder.read_text(f"{staged}/{PLAN}").split("\n")):
        what, name = line.split(" ", 1)
        if what == "drop":
            folder.delete(name)
        elif what == "add":
            folder.fs.mkdirs(folder.path(name))
            for file in folder.names(f"{staged}/{name}"):
                folder.move(f"{staged}/{name}/{file}", f"{name}/{file}")
        elif folder.exists(f"{staged}/{name}"):
            folder.delete(name)
            folder.move(f"{staged}/{name}", name)
    folder.delete(staged)
    if not folder.names(STAGED):
        folder.delete(STAGED)


def recover(spark: SparkSession, root: str, drop: bool = True) -> int:
    """Finishes switches that were planned and, if drop, removes stages that were not; returns how many were finished."""
    folder, done = Folder(spark, root), 0
    for name in folder.names(STAGED):
        if folder.exists(f"{STAGED}/{name}/{PLAN}"):
            finish(folder, f"{STAGED}/{name}")
            done += 1
        elif drop:
            folder.delete(f"{STAGED}/{name}")
    if drop and folder.exists(STAGED) and not folder.names(STAGED):
        folder.delete(STAGED)
    return done
