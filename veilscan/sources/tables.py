"""Any table with a text column as a source of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(table: DataFrame, text: str, *keys: str, path: str | None = None) -> DataFrame:
    """Only the key columns and the text, so that a columnar scan reads nothing else.

    `path` is an SQL expression that names a row for the reports.
    """
    named = [F.expr(path).alias("path")] if path else []
    return table.select(*keys, *named, F.col(text).alias("text"), F.lit("utf-8").alias("encoding"))
