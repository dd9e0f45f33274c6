"""Detectors that may fail on a text without taking anything else with them.

A detector is an expression, and an expression that raises ends the job: a plugged-in detector
that casts, divides or calls Python on a text it does not expect. Isolated, it loses its own
findings on that text only, and leaves a `detector_error` finding in their place.

An expression is isolated by `try_to_binary`, the general one of Spark's try functions: it gives
NULL for whatever exception its argument raises. The argument is the findings as JSON, so the
detector is evaluated once, inside. A function in Python is isolated by its own handler, which
also knows the reason. Errors that end the JVM's task, such as a stack that overflows in a
regular expression, are beyond both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from veilscan.model import EXTRA_FIELDS, FINDINGS_TYPE, SEVERITY_RANK, finding

ERROR_KIND = "detector_error"
FAILED = "failed"  # the reason, where the JVM does not tell it

_FLAT = ["kind", "severity", "title_key", "line", "column", "detail", "rec_key"]


def failure(reason: Column | str) -> Column:
    """The finding that stands for a detector that failed."""
    detail = reason if isinstance(reason, Column) else F.lit(reason)
    return finding(ERROR_KIND, "info", f"finding.{ERROR_KIND}", detail=detail)


def isolated(name: str, found: Column, text: Column) -> Column:
    """The findings of a detector, or one failure where its expression raises.

    A NULL text, or a detector that answers NULL, has no findings.
    """
    none = F.expr(f"CAST(array() AS {FINDINGS_TYPE})")
    held = F.try_to_binary(F.to_json(F.coalesce(found, none)), F.lit("utf-8")).cast("string")
    failed = F.array(failure(f"{name}: {FAILED}"))
    read = F.when(held == "[]", none).otherwise(F.from_json(held, FINDINGS_TYPE))
    return F.when(text.isNull(), none).otherwise(F.coalesce(read, failed))


def _row(found: dict) -> dict:
    """A finding as the typed row; fields that no finding has are an error."""
    extra = found.get("extra") or {}
    odd = (found.keys() - {*_FLAT, "extra"}) | (extra.keys() - EXTRA_FIELDS.keys())
    if odd:
        raise ValueError(f"unknown fields: {', '.join(sorted(odd))}")
    row = {name: found.get(name) for name in _FLAT}
    row["severity_rank"] = SEVERITY_RANK[row["severity"]]
    row["detail"] = row["detail"] or ""
    return row | {"extra": {name: extra.get(name) for name in EXTRA_FIELDS}}


def python_detector(name: str, function: Callable[[str], Iterable[dict]]) -> Callable[[Column], Column]:
    """A detector from a function of one text that gives findings as dictionaries.

    A dictionary has `kind`, `severity` and `title_key`, and may have `line`, `column`,
    `detail`, `rec_key` and `extra`. Whatever the function raises on a text, and a finding that
    does not fit the row type, is a failure on that text, with its reason.
    """
    arrow = to_arrow_type(StructType.fromDDL(f"f {FINDINGS_TYPE}")[0].dataType)

    def read(text: str | None) -> list[dict]:
        if text is None:
            return []
        try:
            rows = [_row(found) for found in function(text)]
            pa.array([rows], arrow)
            return rows
        except Exception as error:
            reason = f"{name}: {type(error).__name__}: {error}".encode("utf-8", "replace").decode()
            return [_row({"kind": ERROR_KIND, "severity": "info", "title_key": f"finding.{ERROR_KIND}", "detail": reason})]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([read(t.as_py()) for t in texts], arrow)

    return F.arrow_udf(run, FINDINGS_TYPE)


def failures(findings: DataFrame, *keys: str) -> DataFrame:
    """`(keys, detector, reason)` of the failures in a findings table: what to look at again."""
    parts = F.split("detail", ": ", 2)
    return findings.where(F.col("kind") == ERROR_KIND).select(
        *keys, F.get(parts, F.lit(0)).alias("failed"), F.get(parts, F.lit(1)).alias("reason")
    )
