"""Facts about Python texts as a table function, for use from SQL.

    SELECT path, f.line, f.label FROM sources, LATERAL python_facts(text) f WHERE f.fact = 'call'
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veilscan.operators.pycode import text_facts

FACT_COLUMNS = (
    "fact string, line int, name string, root string, label string, bare boolean, "
    "nonliteral boolean, decoder boolean, shell boolean, detail string"
)


def fact_rows(text: str | None) -> Iterator[tuple]:
    """Rows of `FACT_COLUMNS`: calls, imports, comments, then what kept a text from being read."""
    if text is None:
        return
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = text_facts(text, True)
    for call in found["calls"]:
        names = ("line", "name", "root", "label", "bare", "nonliteral", "decoder", "shell", "snippet")
        yield ("call", *map(call.get, names))
    rest = [("import", x["line"], x["root"], None) for x in found["imports"]]
    rest += [("comment", x["line"], None, x["text"]) for x in found["comments"]]
    if found.get("syntax_error") is not None:
        rest.append(("syntax_error", found["syntax_line"], None, found["syntax_error"]))
    if found.get("failure") is not None:
        rest.append(("failure", None, None, found["failure"]))
    for fact, line, root, detail in rest:
        yield (fact, line, None, root, None, None, None, None, None, detail)


class PythonFacts:
    """A row for each fact of a text; none for NULL, and one for a text that does not parse."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from fact_rows(text)


def register_facts(spark: SparkSession, name: str = "python_facts") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, udtf(PythonFacts, returnType=FACT_COLUMNS))
