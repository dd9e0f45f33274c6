"""Facts of many long texts: a worker holds those of a few texts at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from veilscan.operators import pycode
from veilscan.operators.pycode import code_facts, text_facts

LONG = "\n".join(f"eval(a{i})\nrequests.get(a{i})" for i in range(500))
TEXTS = [LONG, None, "", "import os  # note", "x = (", "eval(a)"] * 60


def test_pieces_hold_facts_of_few_texts():
    batch = pa.array(TEXTS, pa.string()), pa.array([True] * len(TEXTS))
    tracemalloc.start()
    n_rows, n_calls = 0, 0
    for piece in pycode._facts(iter([batch, batch])):
        n_rows += len(piece)
        n_calls += len(piece.field("calls").flatten())
        del piece
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (n_rows, n_calls) == (2 * len(TEXTS), 2 * 60 * 1001)
    assert most < 15e6  # all facts at once take 50 MB and more


def test_every_row_keeps_its_facts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: r.facts for r in found.select("id", code_facts(F.col("text")).alias("facts")).collect()}
    assert len(got) == len(TEXTS) and all((got[i] is None) == (t is None) for i, t in rows)
    for i, text in rows:
        if text is not None:
            wanted = text_facts(text, True)
            assert [c.line for c in got[i].calls or []] == [c["line"] for c in wanted["calls"]]
            assert [c.text for c in got[i].comments or []] == [c["text"] for c in wanted["comments"]]
            assert got[i].syntax_error == wanted.get("syntax_error")
