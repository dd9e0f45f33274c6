"""Queries and SQL of what is built around a scan: isolation, pattern tables, counters, files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import (
    ALL,
    CALL_FACTS,
    CATEGORY,
    CHARS,
    CODE_REPORT,
    HIDDEN_ROWS,
    LINES,
    REPORT,
    RUNS,
    UNICODE,
    flat,
    mask,
    on_code,
    on_docs,
)
from checks.planted import CODE_TEXT, TREE_KEPT, TREE_PATH, table
from checks.queries import FLAT, REPORT as REPORTED, _streamed_code, code, conversations, dealt, docs, pages
from veilscan.model import finding
from veilscan.operators.facts_table import register_facts
from veilscan.operators.patterns import pattern_detector
from veilscan.operators.unicode import carrier_findings, char_findings
from veilscan.plans import progress, reports
from veilscan.plans.isolate import failures, python_detector
from veilscan.plans.scan import detector_findings, explode_findings, scan, text_detectors, unsuppressed
from veilscan.session import shared_folder
from veilscan.sources import tree_source
from veilscan.sources.cleaned_files import write_cleaned_files
from veilscan.sources.decode import decode_sources
from veilscan.sources.sinks import stage, stage_bucketed, write_findings
from veilscan.sources.slices import in_slices
from veilscan.streaming.live import write_stream


# Detectors that fail on some texts: a division by zero, and a function that gives up.
def ratio_findings(text):
    ratio = F.lit(1000) / (F.length(text) % 7)
    return F.array(finding("ratio", "low", "finding.ratio", detail=F.floor(ratio).cast("string")))


def count_digits(text: str) -> list[dict]:
    digits = sum(c in "0123456789" for c in text[:400])
    if not digits:
        raise ValueError("no digit at the start")
    return [{"kind": "digits", "severity": "info", "title_key": "finding.digits", "line": 1, "detail": str(digits)}]


def _fragile(spark, folder):
    plugged = {"ratio": ratio_findings, "digits": python_detector("digits", count_digits)}
    return scan(docs(spark, folder), detectors=text_detectors() | plugged, python_code=False)


def isolated_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Five detectors of the library beside two that fail on some texts."""
    found = explode_findings(_fragile(spark, folder), "doc_id")
    return found.select("doc_id", "detector", "kind", "severity", "line", "detail")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Which detector failed on which text."""
    return failures(explode_findings(_fragile(spark, folder), "doc_id"), "doc_id")


_NAME = "n_name || cast(i as {0})"
_SEVERITIES = ["info", "low", "medium", "high", "critical"]


def many_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """200 patterns, eight for each nation: three letters of a digest, and five more digits."""
    rows = table(spark, folder, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    literal = F.expr(f"substring(md5({_NAME.format('string')}), 1, 3)")
    return rows.select(
        F.expr("n_name || '_' || cast(i as string)").alias("name"),
        F.concat(literal, F.lit("[0-9a-f]{5}")).alias("pattern"),
        F.element_at(F.array(*map(F.lit, _SEVERITIES)), F.col("i") % 5 + 1).alias("severity"),
        literal.alias("literal"),
    )


def pattern_table_findings(spark: SparkSession, folder: str) -> DataFrame:
    detect = pattern_detector(many_patterns(spark, folder))
    found = detector_findings(docs(spark, folder), "doc_id", detect(F.col("text")))
    return found.select("doc_id", *FLAT, F.col("extra.secret_type").alias("x_secret_type"))


def _one_row(spark: SparkSession, totals: dict[str, int]) -> DataFrame:
    values = [totals[c] for c in progress.COUNTERS]
    schema = ", ".join(f"{c} long" for c in progress.COUNTERS) + ", has_threats boolean"
    return spark.createDataFrame([(*values, totals["threats"] > 0)], schema)


def observed_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the corpus from the very pass that writes the findings."""
    watched, watch = progress.observed(scan(docs(spark, folder), python_code=False))
    out = f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}"
    write_findings(explode_findings(watched, "doc_id"), out)
    return _one_row(spark, watch.get)


def stream_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Counters from the progress reports of a stream that writes findings."""
    name = f"watched-{uuid.uuid4().hex}"
    listener = progress.CounterListener(name)
    spark.streams.addListener(listener)
    try:
        watched = progress.observed_stream(scan(_streamed_code(spark, folder)), name)
        found = explode_findings(watched, "o_orderkey").select("o_orderkey", "kind", "severity", "line")
        write_stream(found, f"{shared_folder(spark)}/{name}", name).awaitTermination()
        return _one_row(spark, listener.wait())
    finally:
        spark.streams.removeListener(listener)


# A folder for every document, one or two levels deep.
FOLDER_PATH = (
    "'d' || cast(doc_id % 5 as {0}) || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '/e' || cast(doc_id % 3 as {0}) END "
    "|| '/' || cast(doc_id as {0}) || '.txt'"
)


def folder_drill_down(spark: SparkSession, folder: str) -> DataFrame:
    placed = docs(spark, folder).withColumn("path", F.expr(FOLDER_PATH.format("string")))
    return reports.drill_down(explode_findings(scan(placed, python_code=False), "path"), "path", 2)


def cleaned_files(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned pages as files on disk, read back."""
    out = f"{shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    path = F.expr("'p' || cast(page_id % 7 as string) || '/' || cast(page_id as string) || '.html'")
    write_cleaned_files(pages(spark, folder).withColumn("path", path), out)
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    below = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return held.select(below.alias("path"), F.col("length").alias("n_bytes"), F.md5("content").alias("digest"))


BUCKETS = 16


def stored_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """Suppression between stored findings tables in buckets; the join moves nothing."""
    body = F.col("text")
    found = stage(docs(spark, folder).select(
        "doc_id", char_findings(body).alias("chars"), carrier_findings(body).alias("hidden")
    ))
    chars, hidden = (
        stage_bucketed(detector_findings(found, "doc_id", F.col(c)), "doc_id", "line", buckets=BUCKETS)
        for c in ("chars", "hidden")
    )
    return unsuppressed(chars, hidden, "doc_id").select("doc_id", *FLAT)


def facts_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Watched calls counted in SQL alone, by the table function."""
    register_facts(spark)
    view = f"programs_{uuid.uuid4().hex}"
    code(spark, folder).createOrReplaceTempView(view)
    return spark.sql(
        f"SELECT f.label, f.bare, f.shell, count(*) AS n FROM {view}, LATERAL python_facts(text) f "
        "WHERE f.fact = 'call' GROUP BY ALL"
    )


# The tree of `source_tree_report`, seen through a filter on the path that prunes its folders.
KEPT_BRANCH = 3


def _programs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.expr(TREE_PATH).alias("path"), F.expr(CODE_TEXT).alias("text")
    )


def _below(top: str) -> Column:
    return F.expr(f"substring(path, {len(top) + 2})")


def source_tree_format(spark: SparkSession, folder: str) -> DataFrame:
    """One branch of a tree through the data source, from files to report."""
    tree_source.register(spark)
    out = f"{shared_folder(spark)}/tree-read-{uuid.uuid4().hex}"

    def store(top: str, _: str) -> None:
        held = spark.read.format("source_tree").load(top)
        branch = held.where(F.col("path").startswith(f"{top}/p{KEPT_BRANCH}/"))
        branch.select(_below(top).alias("path"), "content", "error").write.mode("append").parquet(out)

    in_slices(_programs(spark, folder), store)
    report = reports.file_report(scan(decode_sources(spark.read.parquet(out))))
    return report.select("path", "encoding", "error", *REPORTED)


def source_tree_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a tree through a stream that is stopped and started again.

    One stream for all slices: it goes on behind the files of those that are gone.
    """
    tree_source.register(spark)
    out, state = (f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("tree-out", "tree-state"))

    def deliver(top: str, _: str) -> None:
        for _ in range(2):
            arriving = spark.readStream.format("source_tree").load(top)
            rows = arriving.select(_below(top).alias("path"), "size", F.md5("content").alias("digest"))
            query = rows.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
            query.trigger(availableNow=True).start().awaitTermination()

    in_slices(_programs(spark, folder), deliver)
    return spark.read.parquet(out).select("path", F.col("size").alias("n_bytes"), "digest")


# A program for every document: a statement for each of its words.
DERIVED_WORDS = "regexp_extract_all(text, '[a-z]{{2,20}}'{0})"  # to be formatted


def derived_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Code findings of programs made of the documents' words."""

    def statement(word, i):
        return (
            F.when(i % 25 == 4, "import pickle")
            .when(i % 5 == 0, F.concat(F.lit("w_"), word, F.lit(" = "), i.cast("string")))
            .when(i % 5 == 1, F.concat(F.lit("requests.w_"), word, F.lit("(u)")))
            .when(i % 5 == 2, F.concat(F.lit("os.system(w_"), word, F.lit(")")))
            .when(i % 5 == 3, F.concat(F.lit("eval(w_"), word, F.lit(")")))
            .otherwise(F.concat(F.lit("import w_"), word))
        )

    words = F.expr(DERIVED_WORDS.format(", 0"))
    source = docs_as_given(spark, folder).select(
        "doc_id", F.array_join(F.transform(words, statement), "\n").alias("text")
    )
    found = explode_findings(scan(source, detectors={}), "doc_id")
    return found.select("doc_id", "seq", "kind", "severity", "title_key", "line", "detail")


def docs_as_given(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents"))


def _without_message(found: DataFrame, *keys: str) -> DataFrame:
    """Parser messages differ between Python versions, so they are blanked."""
    detail = F.when(F.col("kind") != "parse_error", F.col("detail")).alias("detail")
    return found.select(*keys, "detector", "kind", "severity", "line", "column", detail)


def six(source, *keys):
    """A query that runs all six detectors over texts of a table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _without_message(explode_findings(scan(source(spark, folder)), *keys), *keys)

    return run


def registry():
    return {
        "isolated_scan": isolated_scan,
        "quarantine": quarantine,
        "pattern_table_findings": pattern_table_findings,
        "observed_counters": observed_counters,
        "stream_observed": stream_observed,
        "folder_drill_down": folder_drill_down,
        "cleaned_files": cleaned_files,
        "derived_programs": derived_programs,
        "stored_suppression": stored_suppression,
        "facts_in_sql": facts_in_sql,
        "source_tree_format": source_tree_format,
        "source_tree_stream": source_tree_stream,
        "document_six": six(docs, "doc_id"),
        "page_six": six(pages, "page_id"),
        "conversation_six": six(conversations, "conv_id", "turn"),
    }


_FIRST = "substr(text, 1, 400)"
_DIGITS = f"length(regexp_replace({_FIRST}, '[^0-9]', '', 'g'))"
FRAGILE = f"""fragile AS (
 SELECT id, 5::TINYINT AS detector, CASE WHEN n = 0 THEN 'detector_error' ELSE 'ratio' END AS kind,
  CASE WHEN n = 0 THEN 'info' ELSE 'low' END AS severity, NULL::INTEGER AS line,
  CASE WHEN n = 0 THEN 'ratio: failed' ELSE (1000 // n)::VARCHAR END AS detail
  FROM (SELECT id, length(text) % 7 AS n FROM planted)
 UNION ALL
 SELECT id, 6::TINYINT, CASE WHEN n = 0 THEN 'detector_error' ELSE 'digits' END, 'info', CASE WHEN n > 0 THEN 1 END,
  CASE WHEN n = 0 THEN 'digits: ValueError: no digit at the start' ELSE n::VARCHAR END
  FROM (SELECT id, {_DIGITS} AS n FROM planted WHERE text IS NOT NULL))"""

PATTERNS = f"""patterns AS (
 SELECT n_name || '_' || i AS name, substr(md5({_NAME.format('VARCHAR')}), 1, 3) AS literal,
  {_SEVERITIES}[(i % 5) + 1] AS severity
 FROM nation, (SELECT unnest(generate_series(0, 7))::INTEGER AS i)),
 hits AS (SELECT id, line, name, severity, unnest(regexp_extract_all(s, literal || '[0-9a-f]{{5}}')) AS m
  FROM lines JOIN patterns ON contains(s, literal))"""

COUNTS = """SELECT count(*) AS files_scanned, count(*) FILTER (n_findings > 0) AS files_with_issues,
 coalesce(sum(n_findings), 0)::BIGINT AS total_findings, coalesce(sum(threats), 0)::BIGINT AS threats,
 coalesce(sum(author_marks), 0)::BIGINT AS author_marks, coalesce(sum(threats), 0) > 0 AS has_threats"""

_SETS = ", ".join(
    f"({', '.join(folders + extra)})"
    for folders in ([], ["f1"], ["f1", "f2"])
    for extra in (["kind", "severity"], ["kind"], ["severity"], [])
)
DRILL = f"""placed AS (SELECT *, string_split({FOLDER_PATH.format('VARCHAR').replace('doc_id', 'id')}, '/') AS parts FROM ranked),
 foldered AS (SELECT *, parts[1] AS f1, array_to_string(parts[1:least(2, len(parts) - 1)], '/') AS f2 FROM placed),
 sums AS (SELECT f1, f2, kind, severity, grouping(f1) AS g1, grouping(f2) AS g2, grouping(kind) AS gk, grouping(severity) AS gs,
  count(*)::BIGINT AS n, count(*) FILTER (rank >= 3)::BIGINT AS threats, max(rank)::INTEGER AS max_rank
  FROM foldered GROUP BY GROUPING SETS ({_SETS}))"""


def _shown(items: str, most: int) -> str:
    return f"array_to_string({items}[1:{most}], ', ') || CASE WHEN len({items}) > {most} THEN ' …' ELSE '' END"


_STEPS = "list_filter(range(len(w)), lambda i: i % 5 = {0} AND i % 25 <> 4)"
# What the statements of a program must give, without a look at the program.
DERIVED = f"""WITH words AS (SELECT doc_id, {DERIVED_WORDS.format('')} AS w FROM documents),
 steps AS (SELECT doc_id, w, {_STEPS.format(1)} AS calls, {_STEPS.format(2)} AS shells, {_STEPS.format(3)} AS evals FROM words),
 made AS (SELECT *, list_sort(list_distinct(list_transform(calls, lambda i: 'requests.w_' || w[i + 1]))) AS labels,
  list_transform(calls, lambda i: i + 1) AS call_lines, list_transform(shells, lambda i: i + 1) AS shell_lines FROM steps),
 found AS (
  SELECT doc_id, 1 AS part, 'dangerous_exec' AS kind, 'high' AS severity, 'finding.exec_dynamic' AS title_key,
   i + 1 AS line, 'eval(w_' || w[i + 1] || ')' AS detail FROM (SELECT doc_id, w, unnest(evals) AS i FROM made)
  UNION ALL SELECT doc_id, 2, 'sensitive_import', 'info', 'finding.sensitive_import', 5, 'pickle' FROM made WHERE len(w) > 4
  UNION ALL SELECT doc_id, 3, 'network_call', 'info', 'finding.network_calls', call_lines[1],
   '×' || len(calls) || ' · ' || {_shown('labels', 6)} || ' · @ ' || {_shown('call_lines', 10)} FROM made WHERE len(calls) > 0
  UNION ALL SELECT doc_id, 4, 'shell_exec', 'medium', 'finding.shell_execs', shell_lines[1],
   '×' || len(shells) || ' · os.system(...) · @ ' || {_shown('shell_lines', 10)} FROM made WHERE len(shells) > 0)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, line) - 1)::INTEGER AS seq, kind, severity, title_key,
  line::INTEGER AS line, detail FROM found"""


def statements() -> dict[str, str]:
    detail = mask("m")
    return {
        "isolated_scan": on_docs(
            "SELECT id AS doc_id, detector::TINYINT AS detector, kind, severity, line, detail FROM ranked"
            " UNION ALL SELECT id, detector, kind, severity, line, detail FROM fragile", *ALL, FRAGILE,
        ),
        "quarantine": on_docs(
            "SELECT id AS doc_id, split_part(detail, ': ', 1) AS failed, substr(detail, position(': ' IN detail) + 2) AS reason"
            " FROM fragile WHERE kind = 'detector_error'", FRAGILE,
        ),
        "pattern_table_findings": on_docs(
            f"""SELECT id AS doc_id, 'secret' AS kind, severity, 'secret.' || name AS title_key, line, NULL::INTEGER AS "column",
 {detail} AS detail, 'rec.secret' AS rec_key, name AS x_secret_type FROM hits""", LINES, PATTERNS,
        ),
        "observed_counters": on_docs(f"{COUNTS} FROM lit", *ALL, REPORT),
        "stream_observed": on_code(f"{COUNTS} FROM code_report", CODE_REPORT),
        "folder_drill_down": on_docs(
            """SELECT (2 - g1 - g2)::INTEGER AS level, CASE 2 - g1 - g2 WHEN 1 THEN f1 WHEN 2 THEN f2 END AS folder,
 kind, severity, (2 * gk + gs)::INTEGER AS level_of, n, threats, max_rank FROM sums""", *ALL, DRILL,
        ),
        "cleaned_files": on_docs(
            f"""SELECT 'p' || (id % 7) || '/' || id || '.cleaned.html' AS path, strlen(body)::BIGINT AS n_bytes, md5(body) AS digest FROM
 (SELECT id, array_to_string(kept, '') AS body, len(kept) < length(text) AS changed FROM
 (SELECT id, text, list_filter(string_split(text, ''), lambda c: {CATEGORY.replace('cp ', 'unicode(c) ')} IS NULL) AS kept FROM planted))
 WHERE changed""", table="pages",
        ),
        "derived_programs": DERIVED,
        "stored_suppression": on_docs(
            flat("kept", "kind", "severity", "title_key", "rec_key", "col"), LINES, CHARS, RUNS, HIDDEN_ROWS, UNICODE
        ),
        "facts_in_sql": on_code(CALL_FACTS),
        "source_tree_format": on_code(
            f"""SELECT {TREE_PATH} AS path, 'utf-8' AS encoding, NULL::VARCHAR AS error, {', '.join(REPORTED)}
 FROM code_lit WHERE {TREE_KEPT} AND o_orderkey % 7 = {KEPT_BRANCH}""", CODE_REPORT,
        ),
        "source_tree_stream": f"""SELECT {TREE_PATH} AS path, strlen(text)::BIGINT AS n_bytes, md5(text) AS digest
 FROM (SELECT *, {CODE_TEXT} AS text FROM orders) WHERE {TREE_KEPT}""",
    }
