"""The same scan over a stream of texts: row-local, hence no state and no watermark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilscan.functions.stego import DEFAULT_MARKS, MarkStyle
from veilscan.plans.reports import corpus_report, file_report
from veilscan.plans.scan import Detector, explode_findings, scan
from veilscan.session import shared_folder


def stream_texts(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet"
) -> DataFrame:
    """New Parquet files of a folder, as they arrive, whether a table is a file or a folder of files.

    The path is a pattern even if it names one table: a stream takes a plain path for a folder.
    """
    if not re.search(r"[\[{*?]", pattern):
        pattern = f"{pattern[:-1]}[{pattern[-1]}]"
    return spark.readStream.schema(schema).parquet(f"{folder}/{pattern}")


def stream_findings(
    texts: DataFrame,
    text: str = "text",
    marks: MarkStyle = DEFAULT_MARKS,
    detectors: dict[str, Detector] | None = None,
    python_code: bool = True,
) -> DataFrame:
    """Findings of a stream of texts; append mode, each text scanned once."""
    options = {"marks": marks, "detectors": detectors, "python_code": python_code}
    return explode_findings(scan(texts, text, **options))


def stream_corpus(
    texts: DataFrame,
    text: str = "text",
    marks: MarkStyle = DEFAULT_MARKS,
    detectors: dict[str, Detector] | None = None,
    python_code: bool = True,
) -> DataFrame:
    """Running corpus counters of a stream; complete mode, one row of state."""
    options = {"marks": marks, "detectors": detectors, "python_code": python_code}
    return corpus_report(file_report(scan(texts, text, **options)))


def write_counters(
    counters: DataFrame, folder: str, name: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Replace the counters in `folder` after every batch until the input is used up."""
    place = checkpoint or f"{shared_folder(counters.sparkSession)}/streams/{name}"

    def replace(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(folder)

    return (
        counters.writeStream.queryName(name)
        .outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
    )


def write_stream(
    findings: DataFrame, folder: str, name: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Append findings to Parquet until the input is used up; restarts where it stopped."""
    spark = findings.sparkSession
    place = checkpoint or f"{shared_folder(spark)}/streams/{name}"
    return (
        findings.writeStream.queryName(name)
        .outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
    )
