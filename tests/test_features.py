"""Isolated detectors, pattern tables, counters of running scans, cleaned files, listing errors."""

import ast
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import WriterCommitMessage

from checks import features, queries
from checks.planted import PLANTED_TEXT
from veilscan.functions.matching import newline_count
from veilscan.model import finding
from veilscan.operators import facts_table, pycode
from veilscan.operators.patterns import PatternTable, pattern_detector, required_literal
from veilscan.operators.secrets import SECRET_PATTERNS, token_findings
from veilscan.plans import progress
from veilscan.plans.isolate import failures, isolated, python_detector
from veilscan.plans.reports import corpus_report, drill_down, file_report
from veilscan.plans.scan import detector_findings, explode_findings, scan, text_detectors
from veilscan.sources import cleaned_files, tree
from veilscan.sources.decode import decode_sources
from veilscan.sources.sinks import write_findings


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string").repartition(2)


def number(text):
    return F.array(finding("number", "low", "finding.number", detail=(text.cast("int") + 1).cast("string")))


def test_a_failing_expression_loses_itself_only(spark):
    def other(text):
        return F.array(finding("size", "info", "finding.size", detail=F.length(text).cast("string")))

    found = scan(texts(spark, "41", "x", None, ""), detectors={"number": number, "size": other}, python_code=False)
    rows = explode_findings(found).collect()
    assert sorted((r.id, r.detector, r.kind, r.detail) for r in rows) == [
        (0, 0, "number", "42"), (0, 1, "size", "2"),
        (1, 0, "detector_error", "number: failed"), (1, 1, "size", "1"),
        (3, 0, "detector_error", "number: failed"), (3, 1, "size", "0"),
    ]
    left = failures(explode_findings(found), "id").collect()
    assert sorted(map(tuple, left)) == [(1, "number", "failed"), (3, "number", "failed")]


@pytest.mark.parametrize("how", ["cast(id as string)", "raise_error('no')", "cast(text as int)", "1 div 0",
                                 "element_at(array('a'), id + 5)", "to_date(text)", "cast(null as string)"])
def test_whatever_an_expression_raises_is_caught(spark, how):
    part = F.array(finding("k", "info", "t", detail=F.expr(f"coalesce(cast({how} as string), 'none')")))
    rows = texts(spark, "a", "b").select("id", F.explode(isolated("mine", part, F.col("text"))).alias("f")).collect()
    fine = how.startswith("cast(id") or "null" in how
    assert {r.f.kind for r in rows} == {"k" if fine else "detector_error"} and len(rows) == 2


def test_isolation_changes_no_finding(spark):
    sources = features.docs(spark, "/root/testdata/sf0.001")
    plain = explode_findings(scan(sources, python_code=False), "doc_id")
    apart = explode_findings(scan(sources, python_code=False, isolate=list(text_detectors())), "doc_id")
    assert plain.count() == apart.count() > 200
    assert plain.exceptAll(apart).isEmpty()


def test_python_detectors(spark):
    def strict(text):
        if text == "bad row":
            return [{"kind": "k", "severity": "low", "title_key": "t", "line": "not a number"}]
        if text == "bad field":
            return [{"kind": "k", "severity": "low", "title_key": "t", "colour": 1}]
        if text == "bad severity":
            return [{"kind": "k", "severity": "worse", "title_key": "t"}]
        if "\ud800" in repr(text) or text == "boom":
            raise RuntimeError("boom: \ud800")
        return [{"kind": "k", "severity": "high", "title_key": "t", "extra": {"lines": [1, 2]}}] * len(text)

    values = ["bad row", "bad field", "bad severity", "boom", "ok", "", None]
    found = scan(texts(spark, *values), detectors={"strict": python_detector("strict", strict)}, python_code=False)
    rows = sorted(explode_findings(found).collect(), key=lambda r: (r.id, r.seq))
    assert [(r.id, r.kind, r.detector) for r in rows] == [
        *[(i, "detector_error", 0) for i in range(4)], (4, "k", 0), (4, "k", 0),
    ]
    assert rows[3].detail == "strict: RuntimeError: boom: ?"
    assert rows[4].severity_rank == 3 and rows[4].extra.lines == [1, 2]
    assert all(r.detail.startswith("strict: ") for r in rows[:4])


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        (r"AKIA[0-9A-Z]{16}", "AKIA"), (r"(?<![A-Z])abcd(?:ef)?gh", "abcd"), (r"abc?de", "ab"), (r"abc+de", "abc"),
        (r"ab{0,2}xyz", "xyz"), (r"ab{2}z", "ab"), (r"abc|def", None), (r"(?:abc|def)ghi", "ghi"), (r"(?i)abcd", None),
        (r"[abc]xx[^]]yyy", "yyy"), (r"\p{Nd}{8}:token", ":token"), (r"a.b.c", "a"), (r"\bword\b", "word"),
        (r"ab*", "a"), (r"[a-z]+", None), (r"k_live_[0-9]{3,}?end", "k_live_"), (r"\Qa.b\E", None), (r"[[ab]c]dd", "dd"),
    ],
)
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


def plain_loop(rows, pattern_rows):
    """Every pattern on every line of every text."""
    import re

    return sorted(
        (i, line, name, m.group())
        for i, text in rows
        for name, pattern, _ in pattern_rows
        for line, s in enumerate((text or "").split("\n"), 1)
        for m in re.finditer(pattern, s)
        if m.group()
    )


@pytest.mark.parametrize("seed", range(3))
def test_pattern_table_equals_the_plain_loop(spark, seed):
    made = random.Random(seed)
    words = ["ab", "abc", "abcd", "bc", "cab", "dab", "ca b", "a.b", "(x", "é", "ab|c", "]z"]
    import re

    rows = []
    for i in range(60):
        word = made.choice(words) + made.choice(["", "a", "b", "cd"])
        rows.append((f"n{i:02d}", re.escape(word) + made.choice(["", "[a-d]", "[0-9]?", "b*"]), "low"))
    rows += [("zz1", "a|b", "info"), ("zz2", "[cd]{2}", "high"), ("zz3", "x*", "low")]
    values = ["".join(made.choice("abcd \n.(x|]z0é") for _ in range(made.randint(0, 200))) for _ in range(40)]
    table = spark.createDataFrame(rows, "name string, pattern string, severity string").repartition(3)
    detect = pattern_detector(table)
    source = texts(spark, *values, None)
    found = source.select("id", F.explode(detect(F.col("text"))).alias("f")).select("id", "f.*").collect()
    expected = plain_loop(enumerate(values), rows)
    assert len(found) == len(expected)
    assert sorted((r.id, r.line, r.extra.secret_type) for r in found) == sorted(x[:3] for x in expected)


def test_pattern_table_of_the_known_shapes(spark):
    source = features.docs(spark, "/root/testdata/sf0.001")
    mine = detector_findings(source, "doc_id", PatternTable.of_secrets().findings(F.col("text")))
    known = detector_findings(source, "doc_id", token_findings(F.col("text")))
    assert known.count() > 5
    assert mine.drop("seq").exceptAll(known.drop("seq")).isEmpty() and mine.count() == known.count()
    assert all(required_literal(pattern) for _, pattern, _ in SECRET_PATTERNS)


def test_pattern_tables_that_are_refused(spark):
    schema = "name string, pattern string, severity string"
    for row in [("a", None, "low"), ("a", "", "low"), ("a", "x", "loud"), (None, "x", "low")]:
        with pytest.raises(ValueError):
            PatternTable.of(spark.createDataFrame([row], schema))
    none = PatternTable.of(spark.createDataFrame([], schema))
    assert texts(spark, "a").select(F.size(none.findings(F.col("text"))).alias("n")).first().n == 0


def test_200_patterns_cost_less_than_twice_nine(spark):
    """Both tables on the same texts, which hold next to nothing of either; best of three runs."""
    made = random.Random(1)
    words = ["".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 9))) for _ in range(3000)]
    values = [" ".join(made.choice(words) for _ in range(400)) for _ in range(1500)]
    source = texts(spark, *values).persist()
    source.count()
    many = [(f"p{i:03d}", f"{i:03d}key_[0-9a-f]{{8}}", "low") for i in range(191)]
    schema = "name string, pattern string, severity string"
    nine = [(n, p, s) for n, p, s in SECRET_PATTERNS]
    times = {}
    for name, rows in (("nine", nine), ("many", nine + many)):
        detect = pattern_detector(spark.createDataFrame(rows, schema))
        plan = source.select(F.size(detect(F.col("text"))).alias("n")).agg(F.sum("n"))
        plan.collect()
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            plan.collect()
            runs.append(time.perf_counter() - start)
        times[name] = min(runs)
    source.unpersist()
    print(times)
    assert times["many"] < 2 * times["nine"] + 0.2, times


def test_counters_come_with_the_write(spark, tmp_path):
    scanned = scan(features.docs(spark, "/root/testdata/sf0.001"), python_code=False)
    watched, watch = progress.observed(scanned)
    write_findings(explode_findings(watched, "doc_id"), str(tmp_path / "out"))
    expected = corpus_report(file_report(scanned)).first().asDict()
    assert watch.get == {c: expected[c] for c in progress.COUNTERS}
    none, empty = progress.observed(scanned.limit(0))
    none.write.format("noop").mode("overwrite").save()
    assert empty.get == dict.fromkeys(progress.COUNTERS, 0)


def test_stream_counters_and_callback(spark, tmp_path):
    folder = tmp_path / "in"
    for part, values in enumerate((["a​b", "clean"], ["password = 'hunter2hunter2'"], ["x"])):
        spark.createDataFrame([(v,) for v in values], "text string").coalesce(1).write.mode("append").parquet(str(folder))
    told = []
    listener = progress.CounterListener("mine", lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        arriving = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        watched = progress.observed_stream(scan(arriving, python_code=False), "mine")
        query = watched.select(F.size("findings").alias("n")).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "state")
        ).trigger(availableNow=True).start()
        query.awaitTermination()
        totals = listener.wait()
    finally:
        spark.streams.removeListener(listener)
    assert totals["files_scanned"] == 4 and totals["files_with_issues"] == 2
    assert [t[0] for t in told] == list(range(1, len(told) + 1)) and len(told) >= 2
    assert told[-1][1] == 4 and told[-1][2] == totals


def test_progress_of_an_action(spark):
    told = []

    def action():
        spark.range(0, 8, 1, 8).select(F.expr("java_method('java.lang.Thread', 'sleep', 200L)")).write.format(
            "noop"
        ).mode("overwrite").save()

    progress.run_with_progress(spark, action, lambda *x: told.append(x))
    assert told[-1] == (8, 8) and told == sorted(told)
    with pytest.raises(ZeroDivisionError):
        progress.run_with_progress(spark, lambda: 1 // 0, lambda *x: None)


def test_drill_down_adds_up(spark):
    rows = [("a/b/1", "k", "low", 1), ("a/b/2", "k", "high", 3), ("a/3", None, "low", 1), ("4", "m", "info", 0), (None, "m", "info", 0)]
    found = spark.createDataFrame(rows, "path string, kind string, severity string, severity_rank int")
    got = {(r.level, r.folder, r.kind, r.severity, r.level_of): (r.n, r.threats, r.max_rank)
           for r in drill_down(found).collect()}
    assert got[0, None, None, None, 3] == (5, 1, 3)
    assert got[0, None, "k", None, 1] == (2, 1, 3) and got[0, None, None, "low", 2] == (2, 0, 1)
    assert got[1, "a", None, None, 3] == (3, 1, 3) and got[1, "", None, None, 3] == (1, 0, 0)
    assert got[2, "a/b", "k", "high", 0] == (1, 1, 3) and got[2, "a", None, None, 3] == (1, 0, 1)
    assert got[1, "a", None, "low", 0] == (1, 0, 1)  # a kind that is null
    assert drill_down(found.limit(0)).count() in (0, 1)
    with_depth = drill_down(found, depth=3).where("level = 3 and level_of = 3").collect()
    assert {(r.folder, r.n) for r in with_depth} == {("a/b", 2), ("a", 1), ("", 1), (None, 1)}


DIRTY = [("a/x.py", "one​"), ("a/b/y.tar.py", "‮two⁦"), ("z", "﻿z"), ("clean.py", "clean"), ("n.py", None)]


def files_below(folder):
    return {
        os.path.relpath(os.path.join(top, name), folder): open(os.path.join(top, name), encoding="utf-8").read()
        for top, _, names in os.walk(folder)
        for name in names
    }


def test_cleaned_files(spark, tmp_path):
    source = spark.createDataFrame(DIRTY, "path string, text string").repartition(3)
    cleaned_files.write_cleaned_files(source, str(tmp_path))
    expected = {"a/x.cleaned.py": "one", "a/b/y.tar.cleaned.py": "two", "z.cleaned": "z"}
    assert files_below(tmp_path) == expected
    with pytest.raises(Exception, match="is there already"):
        cleaned_files.write_cleaned_files(source, str(tmp_path))
    changed = source.withColumn("text", F.concat("text", F.lit("!")))
    cleaned_files.write_cleaned_files(changed, str(tmp_path), overwrite=True)
    assert files_below(tmp_path) == {k: v + "!" for k, v in expected.items()}


@pytest.mark.parametrize("name", ["../out", "/abs", "a//b", "", None, "a/../../b"])
def test_no_file_of_a_failed_job_stays(spark, tmp_path, name):
    source = spark.createDataFrame(DIRTY, "path string, text string").repartition(3)
    bad = spark.createDataFrame([(name, "x")], "path string, text string")
    spark.dataSource.register(cleaned_files.CleanedFiles)
    with pytest.raises(Exception, match="not a path"):
        source.unionByName(bad).write.format("cleaned_files").mode("append").option("path", str(tmp_path)).save()
    assert files_below(tmp_path) == {} and os.listdir(tmp_path) == []
    twice = source.select(F.lit("same").alias("path"), "text")
    with pytest.raises(Exception, match="two rows|same"):
        twice.write.format("cleaned_files").mode("append").option("path", str(tmp_path)).save()
    assert files_below(tmp_path) == {}


class Lost(WriterCommitMessage):
    pass


def test_files_of_a_lost_attempt_do_not_stay(tmp_path, monkeypatch):
    """Two attempts of one task, of which the first was lost halfway: only the second counts."""
    writer = cleaned_files.FileWriter(str(tmp_path), False).begun()

    class Context:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Context.attempt += 1
            return Context.attempt

    monkeypatch.setattr(cleaned_files.TaskContext, "get", staticmethod(lambda: Context()))

    def batches(lost):
        yield pa.RecordBatch.from_pydict({"path": ["half.py"] if lost else ["a.py"], "text": ["half" if lost else "whole"]})
        if lost:
            raise RuntimeError("executor lost")
        yield pa.RecordBatch.from_pydict({"path": ["b/c.py"], "text": [None]})

    with pytest.raises(RuntimeError):
        writer.write(batches(True))
    message = writer.write(batches(False))
    writer.commit([message, None])
    assert files_below(tmp_path) == {"a.py": "whole", "b/c.py": ""}
    assert sorted(os.listdir(tmp_path)) == ["a.py", "b"]


def test_listing_errors_are_rows_or_task_failures(spark, tmp_path, monkeypatch):
    for name in ("kept.py", "closed/hidden.py", "open/seen.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1")

    class Refusing(tree.fs.LocalFileSystem):
        pass

    def entries(error):
        def info(self, what):
            if isinstance(what, tree.fs.FileSelector) and what.base_dir.endswith("closed"):
                raise error
            return tree.fs.LocalFileSystem.get_file_info(self, what)

        Refusing.get_file_info = info
        return list(tree._entries(f"{tmp_path}/closed"))

    monkeypatch.setattr(tree, "opened", lambda path: (Refusing(), path))
    assert entries(PermissionError(13, "denied")) == [(f"{tmp_path}/closed", 0, False, "list_error: [Errno 13] denied")]
    assert entries(FileNotFoundError(2, "gone"))[0][3] == "list_error: [Errno 2] gone"
    with pytest.raises(OSError, match="throttled"):
        entries(OSError(5, "throttled"))
    monkeypatch.undo()
    rows = decode_sources(tree.read_tree(spark, str(tmp_path))).collect()
    assert {(os.path.basename(r.path), r.error) for r in rows} == {("kept.py", None), ("hidden.py", None), ("seen.py", None)}


def test_a_listing_error_is_in_the_report(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("x = 1")
    held = spark.createDataFrame(
        [(f"{tmp_path}/a.py", 5, None), (f"{tmp_path}/closed", 0, "list_error: denied")],
        "path string, size bigint, error string",
    )
    monkeypatch.setattr(tree, "list_tree", lambda *_: held)
    rows = decode_sources(tree.read_tree(spark, str(tmp_path))).collect()
    assert sorted((os.path.basename(r.path), r.text, r.error) for r in rows) == [
        ("a.py", "x = 1", None), ("closed", None, "list_error: denied"),
    ]


@pytest.mark.parametrize("name", ["document_six", "page_six", "conversation_six"])
def test_six_detectors_on_every_table(spark, tables, name):
    """The five text detectors are compared by SQL; here what the sixth adds, text by text."""
    source = {"document_six": (features.docs, ["doc_id"]), "page_six": (features.pages, ["page_id"]),
              "conversation_six": (features.conversations, ["conv_id", "turn"])}[name]
    rows = features.registry()[name](spark, tables).collect()
    errors = {tuple(r[k] for k in source[1]): r.line for r in rows if r.kind == "parse_error"}
    expected = {}
    for r in source[0](spark, tables).collect():
        try:
            ast.parse(r.text or "")
        except SyntaxError as error:
            expected[tuple(r[k] for k in source[1])] = error.lineno
        except ValueError:
            pass
    assert errors == expected and expected
    five = explode_findings(scan(source[0](spark, tables), python_code=False)).count()
    sixth = [r for r in rows if r.detector == 5 or (r.detector == 4 and r.kind == "watermark" and r.detail.startswith("#"))]
    assert len(rows) == five + len(sixth)


def test_bucketed_findings_join_in_place(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = features.stored_suppression(spark, tables)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        from checks.queries import suppressed_as_join

        assert found.exceptAll(suppressed_as_join(spark, tables)).isEmpty() and found.count() > 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_of_a_table_in_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(48)], "doc_id bigint, text string")
    for name in ("documents.parquet", "other.parquet"):
        rows.repartition(3).write.parquet(f"{tmp_path}/{name}")
    planted = rows.select("doc_id", F.expr(PLANTED_TEXT).alias("text"))
    expected = explode_findings(scan(planted, python_code=False)).count()
    assert queries.stream_scan(spark, str(tmp_path)).count() == expected > 0


def test_facts_without_a_needless_look(monkeypatch):
    def forbidden(*_):
        raise AssertionError("tokenized or unparsed for nothing")

    monkeypatch.setattr(pycode, "_comments", forbidden)
    monkeypatch.setattr(pycode.ast, "unparse", forbidden)
    rows = list(facts_table.fact_rows("import pickle\neval(x, y)\ncompile()"))
    assert [(r[0], r[1], r[9] if r[0] == "import" else r[8]) for r in rows][:2] == [("call", 2, False), ("call", 3, False)]
    assert [r[9] for r in rows] == ["eval(x, y)", "compile()", None] and rows[2][3] == "pickle"
