"""Writers for findings, reports and cleaned texts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.charclass import clean_text, is_suspicious
from veilscan.session import shared_folder


def stage(table: DataFrame, scratch: str | None = None) -> DataFrame:
    """Write a table to the shared scratch folder, or to one that is named, and read it back.

    Used where a result feeds several outputs: the texts are scanned once, and a lost executor
    costs a re-read of the table instead of a rescan.
    """
    spark = table.sparkSession
    folder = f"{scratch or shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return spark.read.schema(table.schema).parquet(folder)


def stage_bucketed(table: DataFrame, *keys: str, buckets: int) -> DataFrame:
    """Like `stage`, in buckets by the keys, sorted inside: joins on just these keys need no exchange.

    The table is moved once, when it is written, into one file a bucket; every later join with
    a table of as many buckets reads the files side by side.
    """
    spark = table.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (
        table.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    return spark.table(name)


def write_findings(findings: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Findings as Parquet, one folder per severity; needs no shuffle."""
    findings.write.mode(mode).partitionBy("severity").parquet(folder)


def cleaned_path(path: Column) -> Column:
    """`name.cleaned.ext` beside `name.ext`."""
    return F.regexp_replace(path, r"([^/]+?)(\.[^./]+)?$", "$1.cleaned$2")


def cleaned(sources: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Cleaned texts of the rows that had something to remove, and how much."""
    kept = list(keys) or [c for c in sources.columns if c != text]
    body = F.col(text)
    return (
        sources.where(is_suspicious(body))
        .select(*kept, body.alias("_before"), clean_text(body).alias("cleaned"))
        .select(
            *kept,
            "cleaned",
            (F.length("_before") - F.length("cleaned")).alias("removed"),
        )
    )


def write_cleaned(
    sources: DataFrame, folder: str, path: str = "path", mode: str = "errorifexists"
) -> None:
    """Cleaned texts as a table `(path, cleaned, removed)` with the new file names."""
    table = cleaned(sources, "text", path)
    table.withColumn(path, cleaned_path(F.col(path))).write.mode(mode).parquet(folder)


def write_text_report(report: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """A report whose rows are ordered text blocks, as plain text files in that order."""
    report.select("value").write.mode(mode).text(folder)


BLOCK = 4 << 10  # on disk


class Spent:
    """The files of a tree that is no longer needed, for the tasks that write the next one.

    A file system without a journal may look at every file deleted in the last minutes before it
    makes a new one. So new files are made of spent ones of up to a block, which are overwritten
    under their new names. Each task has its share of them, and leaves none.
    """

    def __init__(self, top: str, written: DataFrame, tasks: int):
        self.top = top
        lists = sorted(written.inputFiles())
        self.lists = [lists[k::tasks] for k in range(tasks)]

    def files(self, task: int) -> Iterator[str]:
        """Spent files of up to a block; longer ones are deleted."""
        _, top = fs.FileSystem.from_uri(self.top) if _is_uri(self.top) else (None, self.top)
        tables = []
        for name in self.lists[task] if task < len(self.lists) else []:
            system, place = fs.FileSystem.from_uri(name)
            table = pq.read_table(place, filesystem=system)
            longer = [x > BLOCK for x in table["n_bytes"].to_pylist()]
            for path in table["path"].filter(pa.array(longer, pa.bool_())):
                _unlink(f"{top}/{path.as_py()}")
            tables.append(table["path"].filter(pa.array([not x for x in longer], pa.bool_())))
        for paths in tables:
            for path in paths:
                yield f"{top}/{path.as_py()}"


def _is_uri(folder: str) -> bool:
    return "://" in folder or folder.startswith("file:")


def _unlink(place: str) -> None:
    with suppress(FileNotFoundError):
        os.unlink(place)


def _open_file(place: str, spent: Iterator[str]) -> int:
    """Open a local file to be overwritten, made of a spent one if there is one.

    The spent name goes before the names of the file are counted: whatever attempts of a task
    meet or broke off, a file that has another name is not written, but replaced by one of its own.
    """
    old = next(spent, None)
    if old is not None:
        with suppress(OSError):  # gone, or the new name is there, or there are no links
            os.link(old, place)
        _unlink(old)
    while True:
        file = os.open(place, os.O_WRONLY | os.O_CREAT | os.O_CLOEXEC, 0o666)
        if os.fstat(file).st_nlink == 1:
            return file
        os.close(file)
        _unlink(place)


def write_files(
    texts: DataFrame,
    folder: str,
    path: str = "path",
    text: str = "text",
    scratch: str | None = None,
    spent: Spent | None = None,
) -> DataFrame:
    """Texts as files below `folder`, written by the tasks; returns the stored list of files.

    A task that runs again writes the same files again. NULL texts become empty files. The list
    `(path, n_bytes)` is stored in `scratch`, or in the shared scratch folder. On a local disk
    `spent` files are made use of; none of them is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder) if _is_uri(folder) else (fs.LocalFileSystem(), folder)
        local = isinstance(system, fs.LocalFileSystem)
        old = spent.files(TaskContext.get().partitionId()) if spent and local else iter(())
        made = set()
        for batch in batches:
            sizes = []
            for name, value in zip(batch.column(0), batch.column(1)):
                place = f"{top}/{name.as_py()}"
                parent = place.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = (value.as_py() or "").encode()
                sizes.append(len(data))
                with os.fdopen(_open_file(place, old), "wb") if local else system.open_output_stream(place) as file:
                    file.write(data)
                    if local:
                        file.truncate()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "n_bytes"])
        for rest in old:
            _unlink(rest)

    return stage(texts.select(path, text).mapInArrow(run, "path string, n_bytes bigint"), scratch)
