"""Row types shared by every detector: severities, findings and report rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and their ranks.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

THREAT_RANK = SEVERITY_RANK["high"]
NOTE_RANK = SEVERITY_RANK["low"]

# `extra` is one typed struct with a nullable field per fact a detector may add, so that a
# Parquet reader can prune to the single field a query needs.
EXTRA_FIELDS = {
    "codepoint": "int",
    "category": "string",
    "count": "int",
    "categories": "array<string>",
    "codepoints": "array<int>",
    "lines": "array<int>",
    "scheme": "string",
    "length": "int",
    "magic": "string",
    "domain": "string",
    "date": "string",
    "checksum": "string",
    "valid_checksum": "boolean",
    "word": "string",
    "scripts": "array<string>",
    "secret_type": "string",
    "key": "string",
    "encoding": "string",
    "decoded": "string",
    "name": "string",
    "value": "string",
    "call": "string",
    "module": "string",
    "payload": "string",
    "comment": "string",
    "snippet": "string",
    "labels": "array<string>",
}

_EMPTY_EXTRA = ",".join(f"'{k}', CAST(NULL AS {v})" for k, v in EXTRA_FIELDS.items())
EXTRA_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in EXTRA_FIELDS.items()) + ">"

# What a detector emits; `scan` adds (detector, seq) to make the emit order explicit.
FINDING_TYPE = (
    "struct<kind:string,severity:string,severity_rank:tinyint,title_key:string,"
    f"line:int,column:int,detail:string,rec_key:string,extra:{EXTRA_TYPE}>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


_RANKS = "map(" + ", ".join(f"'{k}', {v}Y" for k, v in SEVERITY_RANK.items()) + ")"
_NAMES = "array(" + ", ".join(f"'{k}'" for k in SEVERITY_RANK) + ")"


def severity_rank(severity: Column) -> Column:
    """Rank of a severity name; severities compare by rank, never as strings."""
    return F.try_element_at(F.expr(_RANKS), severity)


def severity_name(rank: Column) -> Column:
    """Severity name of a rank (`info` when there is none)."""
    return F.coalesce(F.get(F.expr(_NAMES), rank.cast("int")), F.lit("info"))


def status_of(max_rank: Column) -> Column:
    """Traffic light: red from `high`, yellow from `low`; info-only counts as green."""
    return (
        F.when(max_rank >= THREAT_RANK, "red").when(max_rank >= NOTE_RANK, "yellow").otherwise("green")
    )


def _typed(value: Column | str | int | None, kind: str) -> Column:
    """A column of the given type; columns are taken to have it, plain values become literals."""
    if isinstance(value, Column):
        return value
    literal = "NULL" if value is None else f"'{value}'"
    return F.expr(f"CAST({literal} AS {kind})")


def finding(
    kind: Column | str,
    severity: Column | str,
    title_key: Column | str,
    *,
    line: Column | None = None,
    column: Column | None = None,
    detail: Column | str = "",
    rec_key: Column | str | None = None,
    **extra: Column | str,
) -> Column:
    """One finding struct; `extra` keywords fill the matching field of the typed struct."""
    details = F.expr(f"named_struct({_EMPTY_EXTRA})")
    for name, value in extra.items():
        details = details.withField(name, _typed(value, EXTRA_FIELDS[name]))
    rank = SEVERITY_RANK[severity] if isinstance(severity, str) else severity_rank(severity)
    return F.struct(
        _typed(kind, "string").alias("kind"),
        _typed(severity, "string").alias("severity"),
        _typed(rank, "tinyint").alias("severity_rank"),
        _typed(title_key, "string").alias("title_key"),
        _typed(line, "int").alias("line"),
        _typed(column, "int").alias("column"),
        _typed(detail, "string").alias("detail"),
        _typed(rec_key, "string").alias("rec_key"),
        details.alias("extra"),
    )


def no_findings() -> Column:
    """An empty, correctly typed findings array."""
    return F.expr(f"CAST(array() AS {FINDINGS_TYPE})")
