"""Cleaned files on disk, through a data source writer that commits or leaves nothing.

`table.write.format("cleaned_files").option("path", folder).mode("append").save()` takes rows
`(path, text)` and writes `folder/<path>`. A task attempt writes below a staging folder of its
own. Only when all tasks have ended does the commit move the files of the attempts that Spark
chose to their places; a rename shows a file whole or not at all. Files of lost or repeated
attempts stay in the staging folder and go with it, and so does everything if the job fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from veilscan.sources.sinks import cleaned, cleaned_path

STAGING = ".staging-"
MOVERS = 16  # renames under way at a time
MANIFEST = "list-of-files"
DELETIONS = 20


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt wrote, and how many files."""

    attempt: str
    n_files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder = folder.rstrip("/")
        self.overwrite = overwrite
        self.staging = f"{self.folder}/{STAGING}{uuid.uuid4().hex}"

    def begun(self) -> FileWriter:
        """Make the staging folder; tasks only write where it is, so none outlives an abort."""
        system, staging = _located(self.staging)
        system.create_dir(staging, recursive=True)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        system, top = _located(f"{self.staging}/{attempt}")
        made, names = set(), set()

        def make_dirs(place: str) -> None:
            """The folders from the attempt's own down to a place, one after the other."""
            if place in made:
                return
            if place != top:
                make_dirs(place.rpartition("/")[0])
            system.create_dir(place, recursive=False)
            made.add(place)

        make_dirs(top)
        for batch in iterator:
            for name, text in zip(batch.column("path"), batch.column("text")):
                name = checked_name(name.as_py())
                make_dirs(f"{top}/files/{name}".rpartition("/")[0])
                with system.open_output_stream(f"{top}/files/{name}") as file:
                    file.write((text.as_py() or "").encode("utf-8"))
                names.add(name)
        with system.open_output_stream(f"{top}/{MANIFEST}") as file:
            file.write("\n".join(sorted(names)).encode())
        return Staged(attempt, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of the chosen attempts to their places; two of one name are an error."""
        system, top = _located(self.folder)
        _, staging = _located(self.staging)
        chosen = [m for m in messages if m is not None and m.n_files]

        def listed(message: Staged) -> list[str]:
            with system.open_input_file(f"{staging}/{message.attempt}/{MANIFEST}") as file:
                return file.read().decode().split("\n")

        taken: set[str] = set()
        made: set[str] = set()
        try:
            for message in chosen:
                names = listed(message)
                twice = taken.intersection(names)
                if twice:
                    raise ValueError(f"two rows for {min(twice)}")
                taken.update(names)
            if not self.overwrite:
                with ThreadPoolExecutor(MOVERS) as pool:
                    kinds = pool.map(lambda n: system.get_file_info(f"{top}/{n}").type, sorted(taken))
                there = [n for n, kind in zip(sorted(taken), kinds) if kind != fs.FileType.NotFound]
                if there:
                    raise ValueError(f"{there[0]} is there already")
            for name in taken:
                parent = f"{top}/{name}".rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
            with ThreadPoolExecutor(MOVERS) as pool:
                for message in chosen:
                    source = f"{staging}/{message.attempt}/files"
                    list(pool.map(lambda n, s=source: system.move(f"{s}/{n}", f"{top}/{n}"), listed(message)))
        finally:
            self._forget()

    def abort(self, messages: list[Staged | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        """Delete the staging folder, again where a task that is being killed wrote meanwhile."""
        system, staging = _located(self.staging)
        for _ in range(DELETIONS):
            if system.get_file_info(staging).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(staging)
            except OSError:
                time.sleep(0.1)


def checked_name(name: str | None) -> str:
    """A path that stays below the folder; anything else is an error."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") or "\n" in p or p.startswith(STAGING) for p in parts):
        raise ValueError(f"not a path below the folder: {name!r}")
    return name


class CleanedFiles(DataSource):
    """`path` is the folder; `overwrite` true lets files replace those of their name."""

    @classmethod
    def name(cls) -> str:
        return "cleaned_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema] != ["path", "text"]:
            raise ValueError("rows of path and text are needed")
        replace = self.options.get("overwrite", "false").lower() == "true"
        return FileWriter(self.options["path"], replace).begun()


def write_cleaned_files(
    sources: DataFrame, folder: str, path: str = "path", text: str = "text", overwrite: bool = False
) -> None:
    """Write `<stem>.cleaned<suffix>` below `folder` for each source with something to remove.

    Paths are relative, and kept. Sources without invisible characters, or without text, give
    no file.
    """
    spark: SparkSession = sources.sparkSession
    spark.dataSource.register(CleanedFiles)
    rows = cleaned(sources, text, path).select(
        cleaned_path(F.col(path)).alias("path"), F.col("cleaned").alias("text")
    )
    writer = rows.write.format("cleaned_files").mode("append").option("path", folder)
    writer.option("overwrite", str(overwrite)).save()
