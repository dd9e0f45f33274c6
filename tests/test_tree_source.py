"""The tree of source files as a data source and as a stream, and facts as a table function."""

import os

import pytest
from pyspark.sql import functions as F

from checks import features
from veilscan.operators.facts_table import register_facts
from veilscan.sources import tree_source
from veilscan.sources.tree import read_tree

FILES = ["a.py", "b/__init__.py", "b/c/d.PYW", "b/build/no.py", "b/e.txt", ".git/f.py", "g.h.py", "x.py.d/i.py", "...py"]


@pytest.fixture
def folder(spark, tmp_path):
    tree_source.register(spark)
    for i, name in enumerate(FILES):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"x = {i}\n" * (i + 1))
    os.symlink(tmp_path / "b", tmp_path / "linked")
    return str(tmp_path)


def test_same_rows_as_the_listing_by_tasks(spark, folder):
    mine = spark.read.format("source_tree").load(folder)
    assert mine.columns == ["path", "size", "modified", "content", "error"]
    rows = {(r.path, bytes(r.content), r.error) for r in mine.collect()}
    assert rows == {(r.path, bytes(r.content), r.error) for r in read_tree(spark, folder).collect()} and len(rows) == 5
    assert all(r.size == len(r.content) and r.modified > 0 for r in mine.collect())
    one = spark.read.format("source_tree").load(f"{folder}/a.py").collect()
    assert [r.path for r in one] == [f"{folder}/a.py"]


def test_partitions_by_bytes(spark, folder):
    assert spark.read.format("source_tree").option("partitionBytes", 1).load(folder).rdd.getNumPartitions() == 5
    assert spark.read.format("source_tree").load(folder).rdd.getNumPartitions() == 1
    empty = os.path.join(folder, "b", "build")
    assert spark.read.format("source_tree").load(empty).count() == 0


@pytest.mark.parametrize(
    ("condition", "names"),
    [
        (lambda p, top: p.startswith(f"{top}/b/"), {"b/__init__.py", "b/c/d.PYW"}),
        (lambda p, top: p == f"{top}/b/c/d.PYW", {"b/c/d.PYW"}),
        (lambda p, top: p.isin(f"{top}/a.py", f"{top}/nowhere.py", f"{top}/b/__init__.py"), {"a.py", "b/__init__.py"}),
        (lambda p, top: p.startswith(f"{top}/b") & p.endswith(".PYW"), {"b/c/d.PYW"}),
        (lambda p, top: (p == f"{top}/a.py") & (p == f"{top}/g.h.py"), set()),
    ],
)
def test_path_filters(spark, folder, condition, names):
    found = spark.read.format("source_tree").load(folder).where(condition(F.col("path"), folder))
    assert {os.path.relpath(r.path, folder) for r in found.collect()} == names


def test_filters_prune_folders(folder, monkeypatch):
    entered = []
    plain = tree_source._dated
    monkeypatch.setattr(tree_source, "_dated", lambda path: entered.append(path) or plain(path))
    reader = tree_source.TreeReader(folder, 1 << 20)
    wanted = tree_source.StringStartsWith(("path",), f"{folder}/b/c/")
    other = tree_source.EqualTo(("size",), 3)
    assert list(reader.pushFilters([wanted, other])) == [other]
    files = [f.path for p in reader.partitions() for f in p.files]
    assert files == [f"{folder}/b/c/d.PYW"] and entered == [folder, f"{folder}/b", f"{folder}/b/c"]


def test_the_plan_shows_the_scan_of_one_branch(spark, folder):
    held = spark.read.format("source_tree").load(folder).where(F.col("path").startswith(f"{folder}/b/"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "source_tree" in plan and " Filter " not in plan  # applied by the source


def test_stream_reads_no_file_twice(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp("s") / x) for x in ("out", "state"))

    def run():
        arriving = spark.readStream.format("source_tree").load(folder).select("path", "size")
        query = arriving.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.relpath(r.path, folder) for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 5 and run() == first
    later = os.path.join(folder, "b", "later.py")
    with open(later, "w") as file:
        file.write("y = 1")
    newest = max(os.stat(os.path.join(top, n)).st_mtime_ns for top, _, names in os.walk(folder) for n in names)
    os.utime(later, ns=(newest + 10**9, newest + 10**9))
    assert run() == sorted([*first, "b/later.py"])
    os.remove(later)  # the offset goes back with the newest file, and nothing comes again
    assert run() == sorted([*first, "b/later.py"])


def test_errors_are_rows(spark, folder, monkeypatch):
    found = [tree_source.Found(f"{folder}/gone.py", 1, 1), tree_source.Found(f"{folder}/closed", 0, 0, "list_error: no")]
    rows = [b.to_pylist()[0] for b in tree_source.read_files(tree_source.Files(found))]
    assert rows[0]["error"].startswith("read_error: ") and rows[1]["error"] == "list_error: no"
    assert rows[0]["content"] is None and rows[1]["content"] is None
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("source_tree").load(f"{folder}/nowhere").count()


def test_facts_from_sql(spark):
    register_facts(spark)
    texts = ["import os, pickle\nos.system(c)\n# author: me", "eval(x)", "x = (", None, "", "a\0b"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("programs_here")
    rows = spark.sql("SELECT id, f.* FROM programs_here, LATERAL python_facts(text) f").collect()
    assert sorted((r.id, r.fact, r.line, r.label or r.root) for r in rows if r.fact not in ("failure", "syntax_error")) == [
        (0, "call", 2, "os.system"), (0, "comment", 3, None), (0, "import", 1, "pickle"), (1, "call", 1, "eval"),
    ]
    assert {r.id for r in rows if r.fact in ("failure", "syntax_error")} == {2, 5}
    outer = spark.sql("SELECT id, f.fact FROM programs_here LEFT JOIN LATERAL python_facts(text) f ON true WHERE f.fact IS NULL")
    assert {r.id for r in outer.collect()} == {3, 4}


def test_facts_are_those_of_the_detectors(spark):
    found = features.facts_in_sql(spark, "/root/testdata/sf0.001")
    assert found.where("label = 'requests.get'").first().n > 0
