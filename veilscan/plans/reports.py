"""Per-source and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.model import THREAT_RANK, severity_name, status_of

MARK_KIND = "author_mark"


def with_report(scanned: DataFrame) -> DataFrame:
    """Add the counters, worst severity and traffic light of every source; no shuffle."""
    found = F.col("findings")
    ranks = F.transform(found, lambda f: f.severity_rank)
    top = F.coalesce(F.array_max(ranks), F.lit(0)).cast("int")
    counted = scanned.select(
        "*",
        F.size(found).alias("n_findings"),
        F.size(F.filter(ranks, lambda r: r >= THREAT_RANK)).alias("threats"),
        F.size(F.filter(found, lambda f: f.kind == MARK_KIND)).alias("author_marks"),
        top.alias("max_rank"),
    )
    return counted.select(
        "*",
        severity_name(F.col("max_rank")).alias("max_severity"),
        status_of(F.col("max_rank")).alias("status"),
    )


def file_report(scanned: DataFrame) -> DataFrame:
    """One row per source, without its findings."""
    return with_report(scanned).drop("findings")


def _aggregates() -> list[Column]:
    rank = F.col("severity_rank")
    return [
        F.count(rank).cast("int").alias("n_findings"),
        F.count_if(rank >= THREAT_RANK).cast("int").alias("threats"),
        F.count_if(F.col("kind") == MARK_KIND).cast("int").alias("author_marks"),
        F.coalesce(F.max(rank), F.lit(0)).cast("int").alias("max_rank"),
    ]


def file_report_of_findings(sources: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """The same report from a stored findings table; sources without findings are kept.

    Findings are reduced to one row per source, with partial sums, before they meet the
    sources, so neither the texts nor the details are shuffled.
    """
    sums = findings.groupBy(*keys).agg(*_aggregates())
    joined = sources.select(*keys).join(sums, list(keys), "left").fillna(
        0, ["n_findings", "threats", "author_marks", "max_rank"]
    )
    return joined.select(
        "*",
        severity_name(F.col("max_rank")).alias("max_severity"),
        status_of(F.col("max_rank")).alias("status"),
    )


def corpus_report(reports: DataFrame) -> DataFrame:
    """The counters of a whole corpus as one row, from per-source reports."""
    return reports.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("n_findings") > 0).alias("files_with_issues"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_findings"),
        F.coalesce(F.sum("threats"), F.lit(0)).alias("threats"),
        F.coalesce(F.sum("author_marks"), F.lit(0)).alias("author_marks"),
    ).withColumn("has_threats", F.col("threats") > 0)


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Number of findings per kind and severity."""
    return findings.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def drill_down(findings: DataFrame, path: str = "path", depth: int = 2) -> DataFrame:
    """Findings by folder, kind and severity, at every level of detail, in one result.

    `(level, folder, kind, severity, level_of, n, threats, max_rank)`: a row for each folder of
    the first `depth` levels, and for the whole (level 0, folder NULL), each by kind and
    severity, by one of them, and by neither. `level_of` is the grouping id: bit 1 is set where
    all kinds are summed, bit 0 where all severities are. A NULL kind or path counts as one of
    its own. Files that lie higher than a level stand under their own folder there.

    Findings are counted once by their finest group; the levels add up those counts.
    """
    parts = F.split(path, "/")
    folders = [
        F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.least(F.size(parts) - 1, F.lit(i)))), "/")
        for i in range(1, depth + 1)
    ]
    names = [f"_folder{i}" for i in range(1, depth + 1)]
    rank = F.col("severity_rank")
    finest = findings.groupBy(
        *[f.alias(n) for f, n in zip(folders, names)], "kind", "severity"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(rank >= THREAT_RANK).alias("threats"),
        F.max(rank).alias("max_rank"),
    )
    kind, severity = F.col("kind"), F.col("severity")
    columns = [F.col(n) for n in names]
    sets = [
        columns[:level] + extra
        for level in range(depth + 1)
        for extra in ([kind, severity], [kind], [severity], [])
    ]
    sums = finest.groupingSets(sets, *columns, kind, severity).agg(
        F.sum("n").alias("n"),
        F.sum("threats").alias("threats"),
        F.max("max_rank").cast("int").alias("max_rank"),
        F.grouping_id().alias("_id"),
    )
    # In the grouping id the folders stand before kind and severity, the first one highest.
    summed = F.bit_count(F.shiftright("_id", 2)).cast("int")
    level = F.lit(depth) - summed
    return sums.select(
        level.alias("level"),
        F.get(F.array(*columns), level - 1).alias("folder"),
        "kind",
        "severity",
        (F.col("_id") % 4).cast("int").alias("level_of"),
        "n",
        "threats",
        "max_rank",
    )


def flagged(reports: DataFrame) -> DataFrame:
    """Sources with at least one finding, of any severity."""
    return reports.where(F.col("n_findings") > 0)


def clean(reports: DataFrame) -> DataFrame:
    """Sources without any finding."""
    return reports.where(F.col("n_findings") == 0)


def by_severity(reports: DataFrame, path: str = "path") -> DataFrame:
    """Report order: worst source first, then by path."""
    return reports.orderBy(F.desc("max_rank"), path)
