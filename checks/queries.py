"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.planted import CODE_TEXT, PLANTED_TEXT, SECRET_NAMES, TREE_PATH, planted, py_sources, table
from veilscan.functions.charclass import (
    char_name,
    classify,
    clean_text,
    codepoint_dim,
    is_suspicious,
    removed_chars,
)
from veilscan.functions.messages import format_message, localize, message
from veilscan.functions.stego import (
    V2_ALPHABET,
    build_mark,
    decode_carrier,
    decode_scheme,
    encode_mark,
    parse_mark,
)
from veilscan.functions.text import mask_secret, shannon_entropy
from veilscan.model import THREAT_RANK
from veilscan.operators.encoded import encoded_findings
from veilscan.operators.homoglyph import homoglyph_findings, neutralise_escapes
from veilscan.operators.pycode import (
    code_facts,
    error_findings,
    exec_findings,
    import_findings,
    network_findings,
    shell_findings,
)
from veilscan.operators.secrets import generic_findings, secret_findings, token_findings
from veilscan.operators.unicode import carrier_findings, char_findings, unicode_findings
from veilscan.operators.watermark import comment_findings, dunder_findings, may_have_marked_comment
from veilscan.plans import render, reports
from veilscan.plans.scan import detector_findings, explode_findings, scan
from veilscan.session import shared_folder
from veilscan.sources.decode import decode_sources
from veilscan.sources.sinks import cleaned, cleaned_path, stage, write_findings
from veilscan.sources.slices import in_slices
from veilscan.sources.tables import texts
from veilscan.sources.tree import in_ignored_dir, is_python_path, read_tree
from veilscan.streaming.live import (
    stream_corpus,
    stream_findings,
    stream_texts,
    write_counters,
    write_stream,
)

FLAT = ["kind", "severity", "title_key", "line", "column", "detail", "rec_key"]


def dealt(texts: DataFrame) -> DataFrame:
    """Texts in as many partitions as the caller names in `veilscan.input.partitions`.

    For tables of a single file, which Spark reads in one task; unset, nothing is moved.
    """
    partitions = texts.sparkSession.conf.get("veilscan.input.partitions", None)
    return texts.repartition(int(partitions)) if partitions else texts


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(planted(spark, folder))


def code(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(py_sources(spark, folder))


def detector(source, key: str, detect, *extra: str):
    """A query that lists the findings of one detector."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = detector_findings(source(spark, folder), key, detect(F.col("text")))
        named = [F.col(f"extra.{name}").alias(f"x_{name}") for name in extra]
        return found.select(key, *FLAT, *named)

    return run


def char_class_counts(spark, folder):
    found = docs(spark, folder).where(is_suspicious(F.col("text")))
    return (
        found.select(F.explode(classify(F.col("text"))).alias("c"))
        .groupBy("c.category", "c.severity")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c.cp").alias("n_codepoints"))
    )


def codepoint_names(spark, folder):
    """Names by joining the dimension, after the characters are reduced to distinct ones."""
    found = docs(spark, folder).where(is_suspicious(F.col("text")))
    counted = found.select(F.explode(classify(F.col("text"))).alias("c")).groupBy("c.cp").count()
    named = counted.join(F.broadcast(codepoint_dim(spark)), "cp", "left")
    return named.select(
        "cp",
        F.coalesce("name", F.lit("UNNAMED")).alias("name"),
        char_name(F.col("cp")).alias("label"),
        F.col("count").alias("n"),
    )


def cleaned_texts(spark, folder):
    return docs(spark, folder).select(
        "doc_id",
        F.md5(clean_text(F.col("text")).cast("binary")).alias("digest"),
        removed_chars(F.col("text")).alias("removed"),
    )


def cleaned_sink(spark, folder):
    message_text = format_message(
        message("msg.cleaned", "en"), count=F.col("removed"), path=cleaned_path(F.col("path"))
    )
    return cleaned(docs(spark, folder), "text", "doc_id", "path").select(
        "doc_id",
        cleaned_path(F.col("path")).alias("path"),
        "removed",
        F.length("cleaned").alias("size"),
        message_text.alias("note"),
    )


def suppressed_as_join(spark, folder):
    """Suppression as an anti-join of two findings tables, for findings that are stored."""
    body = F.col("text")
    found = docs(spark, folder).select(
        "doc_id", char_findings(body).alias("chars"), carrier_findings(body).alias("hidden")
    )
    found = stage(found)
    chars = detector_findings(found, "doc_id", F.col("chars"))
    hidden = detector_findings(found, "doc_id", F.col("hidden"))
    return chars.join(hidden, ["doc_id", "line"], "left_anti").select("doc_id", *FLAT)


def emoji_rollup(spark, folder):
    found = detector_findings(docs(spark, folder), "doc_id", unicode_findings(F.col("text")))
    return found.where(F.col("kind") == "unicode_emoji_selector").select(
        "doc_id", "line", "column", "detail", F.col("extra.count").alias("n")
    )


def customers(spark, folder):
    domain = F.expr("lower(replace(c_name, '#', '-')) || '.test'")
    # Rows are small and their marks are dear, and the table may come in a few large row groups.
    spread = table(spark, folder, "customer").repartition(4 * spark.sparkContext.defaultParallelism)
    return spread.select(
        "c_custkey", domain.alias("domain"), F.expr("'2026-01-' || lpad(cast(c_nationkey + 1 as string), 2, '0')").alias("date")
    )


def mark_build(spark, folder):
    return customers(spark, folder).select(
        "c_custkey", build_mark(F.col("domain"), F.col("date")).alias("mark")
    )


def mark_encode(spark, folder):
    return mark_build(spark, folder).select("c_custkey", encode_mark(F.col("mark")).alias("hidden"))


def mark_round_trip(spark, folder):
    found = mark_build(spark, folder).select(
        "c_custkey", decode_carrier(encode_mark(F.col("mark"))).alias("d")
    )
    return found.select("c_custkey", "d", parse_mark(F.col("d.payload")).alias("m")).select(
        "c_custkey", "d.payload", "d.scheme", "m.domain", "m.date", "m.valid_checksum"
    )


def scheme_round_trip(spark, folder):
    """Single-scheme decoding of stamped part names."""
    stamped = encode_mark(F.col("p_name"))
    return table(spark, folder, "part").select(
        "p_partkey",
        decode_scheme(stamped, F.lit(V2_ALPHABET), F.lit(3)).alias("decoded"),
        F.length(stamped).alias("symbols"),
    )


def entropy(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.round(shannon_entropy(F.col("p_name")), 6).alias("entropy"),
        mask_secret(F.col("p_name")).alias("masked"),
    )


def escape_neutral(spark, folder):
    lines = docs(spark, folder).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    )
    changed = lines.where(F.col("line").contains("\\"))
    return changed.select(
        "doc_id", "at", neutralise_escapes(F.col("line")).alias("neutral")
    )


def facts_of(spark, folder, *keep):
    body = F.col("text")
    facts = code_facts(body, may_have_marked_comment(body)).alias("facts")
    return code(spark, folder).select("o_orderkey", *keep, facts)


def code_rule(rule, *extra):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = detector_findings(
            facts_of(spark, folder), "o_orderkey", rule(F.col("facts"))
        )
        named = [F.col(f"extra.{name}").alias(f"x_{name}") for name in extra]
        return found.select("o_orderkey", *FLAT, *named)

    return run


def call_facts(spark, folder):
    calls = facts_of(spark, folder).select("o_orderkey", F.explode("facts.calls").alias("c"))
    return calls.groupBy("c.label", "c.bare", "c.shell").agg(F.count(F.lit(1)).alias("n"))


def parse_errors(spark, folder):
    found = detector_findings(
        facts_of(spark, folder), "o_orderkey", error_findings(F.col("facts"))
    )
    return found.select("o_orderkey", "kind", "severity", "title_key", "line", "rec_key")


def scanned_docs(spark, folder):
    """The text detectors only: whether prose parses as Python is not part of these checks."""
    return scan(docs(spark, folder), python_code=False)


def scanned_code(spark, folder):
    return scan(code(spark, folder))


def findings_all(spark, folder):
    return explode_findings(scanned_docs(spark, folder), "doc_id").select(
        "doc_id", "detector", *FLAT
    )


def findings_ordered(spark, folder):
    placed = scanned_docs(spark, folder).select(
        "doc_id", F.posexplode_outer("findings").alias("at", "f")
    )
    return placed.where(F.col("f.kind").isNotNull()).select(
        "doc_id", "at", "f.detector", "f.seq", "f.severity", "f.line", "f.detail"
    )


def code_findings_all(spark, folder):
    found = explode_findings(scanned_code(spark, folder), "o_orderkey")
    return found.select(
        "o_orderkey", "kind", "severity", "line", "column",
        F.when(F.col("kind") != "parse_error", F.col("detail")).alias("detail"),
    )


REPORT = ["n_findings", "threats", "author_marks", "max_severity", "status"]


def file_report(spark, folder):
    return reports.file_report(scanned_docs(spark, folder)).select("doc_id", *REPORT)


def file_report_of_findings(spark, folder):
    source = docs(spark, folder).select("doc_id")
    found = explode_findings(scanned_docs(spark, folder), "doc_id")
    return reports.file_report_of_findings(source, found, "doc_id").select("doc_id", *REPORT)


def code_report(spark, folder):
    return reports.file_report(scanned_code(spark, folder)).select("o_orderkey", *REPORT)


def traffic_light(spark, folder):
    return (
        reports.file_report(scanned_docs(spark, folder))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def corpus_report(spark, folder):
    return reports.corpus_report(reports.file_report(scanned_docs(spark, folder)))


def severity_histogram(spark, folder):
    return reports.severity_histogram(explode_findings(scanned_docs(spark, folder), "doc_id"))


def threat_findings(spark, folder):
    found = explode_findings(scanned_docs(spark, folder), "doc_id")
    return found.where(F.col("severity_rank") >= THREAT_RANK).select(
        "doc_id", "kind", "severity", "line", "detail"
    )


def flagged_docs(spark, folder):
    return reports.flagged(reports.file_report(scanned_docs(spark, folder))).select("doc_id")


def clean_docs(spark, folder):
    return reports.clean(reports.file_report(scanned_docs(spark, folder))).select("doc_id")


def messages_lookup(spark, folder):
    found = explode_findings(scanned_docs(spark, folder), "doc_id")
    counted = found.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"))
    return localize(counted, "en").select("title_key", "title", "n")


def _placed(report: DataFrame) -> DataFrame:
    return report.select("part", "max_rank", "path", "value")


def text_report(spark, folder):
    """Full text report of the Python sources; the scan is stored once and read twice."""
    scanned = stage(scanned_code(spark, folder).select("path", "encoding", "findings"))
    return _placed(render.text_report(_without_messages(scanned), "en"))


def console_report(spark, folder):
    scanned = stage(scanned_code(spark, folder).select("path", "encoding", "findings"))
    return _placed(render.console_listing(_without_messages(scanned), "ru"))


def html_report(spark, folder):
    scanned = stage(scanned_code(spark, folder).select("path", "encoding", "findings"))
    return render.html_cards(_without_messages(scanned), "en")


def _without_messages(scanned: DataFrame) -> DataFrame:
    """Parser messages differ between Python versions, so the checks blank them."""
    blank = F.transform(
        "findings",
        lambda f: F.when(f.kind == "parse_error", f.withField("detail", F.lit(""))).otherwise(f),
    )
    return scanned.withColumn("findings", blank)


def raw_bytes() -> Column:
    """Documents as bytes in one of four encodings; an odd length rules UTF-16 out."""
    odd = "CASE WHEN length(text) % 2 = 0 THEN text || '.' ELSE text END"
    return F.expr(
        "CASE WHEN doc_id % 4 = 1 THEN concat(X'EFBBBF', encode(text, 'UTF-8')) "
        "WHEN doc_id % 4 = 2 THEN encode(text, 'UTF-16') "
        f"WHEN doc_id % 4 = 3 AND NOT text rlike '[^\\\\x00-\\\\xFF]' THEN encode({odd}, 'ISO-8859-1') "
        "ELSE encode(text, 'UTF-8') END"
    )


def decoded_sources(spark, folder):
    raw = table(spark, folder, "documents").select("doc_id", raw_bytes().alias("content"))
    return decode_sources(raw).select(
        "doc_id", "encoding", F.length("text").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


def tree_paths(spark, folder):
    """Path rules over paths derived from the documents."""
    path = F.expr(
        "source || '/' || CASE doc_id % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'pkg/venv/' "
        "WHEN 2 THEN 'building/' ELSE '' END || cast(doc_id as string) || "
        "CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.PYW' WHEN 2 THEN '.pyc' ELSE '/a.py' END"
    )
    paths = table(spark, folder, "documents").select("doc_id", path.alias("path"))
    kept = is_python_path(F.col("path")) & ~in_ignored_dir(F.col("path"))
    return paths.where(kept)


def source_tree_report(spark, folder):
    """Files to report: programs written as a tree, listed, read, decoded and scanned."""
    programs = table(spark, folder, "orders").select(
        F.expr(TREE_PATH).alias("path"), F.expr(CODE_TEXT).alias("text")
    )
    out = f"{shared_folder(spark)}/tree-read-{uuid.uuid4().hex}"

    def store(top, scratch):
        below = F.expr(f"substring(path, {len(top) + 2})")
        held = read_tree(spark, top, scratch=scratch)
        held.select(below.alias("path"), "content", "error").write.mode("append").parquet(out)

    in_slices(programs, store)
    report = reports.file_report(scan(decode_sources(spark.read.parquet(out))))
    return report.select("path", "encoding", "error", *REPORT)


def conversations(spark, folder):
    return dealt(planted(spark, folder, "conversations")).select(
        F.expr("doc_id div 1000").alias("conv_id"), F.expr("doc_id % 1000").alias("turn"), "text"
    )


def pages(spark, folder):
    return dealt(planted(spark, folder, "pages")).select(F.col("doc_id").alias("page_id"), "text")


def conversation_findings(spark, folder):
    source = conversations(spark, folder)
    found = explode_findings(scan(texts(source, "text", "conv_id", "turn"), python_code=False))
    return found.select("conv_id", "turn", "kind", "severity", "line", "detail")


def scanned_pages(spark, folder):
    return scan(texts(pages(spark, folder), "text", "page_id"), python_code=False)


def page_findings(spark, folder):
    found = explode_findings(scanned_pages(spark, folder), "page_id")
    return found.select("page_id", "kind", "severity", "line", "detail")


def page_report(spark, folder):
    return reports.file_report(scanned_pages(spark, folder)).select("page_id", *REPORT)


def _streamed_docs(spark, folder):
    arriving = stream_texts(spark, folder, "doc_id bigint, text string", "documents.parquet")
    return arriving.select("doc_id", F.expr(PLANTED_TEXT).alias("text"))


def stream_scan(spark, folder):
    """All findings through a streaming query into Parquet, read back."""
    name = f"scan-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}"
    found = stream_findings(_streamed_docs(spark, folder), python_code=False)
    write_stream(found.select("doc_id", *FLAT), out, name).awaitTermination()
    return spark.read.parquet(out)


def _streamed_code(spark, folder):
    arriving = stream_texts(spark, folder, "o_orderkey bigint", "orders.parquet")
    return arriving.select("o_orderkey", F.expr(CODE_TEXT).alias("text"))


def stream_code_scan(spark, folder):
    """All six detectors over a stream of programs, into Parquet and read back."""
    name = f"code-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}"
    found = stream_findings(_streamed_code(spark, folder))
    columns = ["o_orderkey", "detector", "kind", "severity", "line", "column"]
    write_stream(found.select(*columns), out, name).awaitTermination()
    return spark.read.parquet(out)


def stream_counters(spark, folder):
    """Running corpus counters of a stream of programs, as they stand after its last batch."""
    name = f"counters-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}"
    write_counters(stream_corpus(_streamed_code(spark, folder)), out, name).awaitTermination()
    return spark.read.parquet(out)


def stored_findings(spark, folder):
    """The findings sink: written by severity, all of it read back."""
    out = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    write_findings(explode_findings(scanned_docs(spark, folder), "doc_id"), out)
    return spark.read.parquet(out).select("doc_id", "severity", "kind", "line", "detail")


def registry():
    found = {
        "char_class_counts": char_class_counts,
        "char_runs": detector(docs, "doc_id", char_findings, "count"),
        "codepoint_names": codepoint_names,
        "clean_text": cleaned_texts,
        "cleaned_sink": cleaned_sink,
        "emoji_rollup": emoji_rollup,
        "unicode_findings": detector(docs, "doc_id", unicode_findings),
        "line_suppression": suppressed_as_join,
        "mark_build": mark_build,
        "mark_encode": mark_encode,
        "mark_round_trip": mark_round_trip,
        "scheme_round_trip": scheme_round_trip,
        "hidden_payloads": detector(
            docs, "doc_id", carrier_findings, "scheme", "length", "domain", "date", "checksum", "valid_checksum"
        ),
        "homoglyphs": detector(docs, "doc_id", homoglyph_findings, "word"),
        "escape_neutral": escape_neutral,
        "secrets_all": detector(docs, "doc_id", secret_findings, "secret_type"),
        "secrets_generic": detector(docs, "doc_id", generic_findings, "key"),
        "entropy": entropy,
        "encoded_base64": detector(docs, "doc_id", lambda t: encoded_findings(t, "base64"), "decoded"),
        "encoded_hex": detector(docs, "doc_id", lambda t: encoded_findings(t, "hex"), "decoded"),
        "dunder_watermarks": detector(docs, "doc_id", dunder_findings, "name", "value"),
        "comment_watermarks": code_rule(lambda f: comment_findings(f.comments)),
        "dangerous_exec": code_rule(exec_findings, "call"),
        "sensitive_imports": code_rule(import_findings, "module"),
        "network_calls": code_rule(network_findings, "count"),
        "shell_execs": code_rule(shell_findings, "count"),
        "parse_errors": parse_errors,
        "call_facts": call_facts,
        "findings_all": findings_all,
        "findings_ordered": findings_ordered,
        "code_findings_all": code_findings_all,
        "file_report": file_report,
        "file_report_of_findings": file_report_of_findings,
        "code_report": code_report,
        "traffic_light": traffic_light,
        "corpus_report": corpus_report,
        "severity_histogram": severity_histogram,
        "threat_findings": threat_findings,
        "flagged_docs": flagged_docs,
        "clean_docs": clean_docs,
        "messages_lookup": messages_lookup,
        "text_report": text_report,
        "console_report": console_report,
        "html_report": html_report,
        "decoded_sources": decoded_sources,
        "tree_paths": tree_paths,
        "conversation_findings": conversation_findings,
        "page_findings": page_findings,
        "page_report": page_report,
        "stored_findings": stored_findings,
        "stream_scan": stream_scan,
        "stream_code_scan": stream_code_scan,
        "stream_counters": stream_counters,
        "source_tree_report": source_tree_report,
    }
    for name in SECRET_NAMES:
        found[f"secrets_{name}"] = detector(docs, "doc_id", lambda t, n=name: token_findings(t, n))
    return found
