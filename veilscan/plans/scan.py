"""The one-pass scan: a table of texts in, the same rows with an ordered findings array out.

The scan is row-local. A source row is read once, its text never enters a shuffle, and every
rule runs where the row is, so the work grows with the data and with nothing else. Grouping
starts only after the texts are gone.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.stego import DEFAULT_MARKS, MarkStyle
from veilscan.operators.encoded import encoded_findings
from veilscan.operators.homoglyph import homoglyph_findings
from veilscan.operators.pycode import code_facts, code_findings
from veilscan.operators.secrets import secret_findings
from veilscan.operators.unicode import unicode_findings
from veilscan.operators.watermark import (
    comment_findings,
    dunder_findings,
    may_have_marked_comment,
)
from veilscan.model import no_findings
from veilscan.plans.isolate import isolated

Detector = Callable[[Column], Column]


def text_detectors(marks: MarkStyle = DEFAULT_MARKS) -> dict[str, Detector]:
    """Detectors on the text alone, in report order; add an entry to plug in your own."""
    return {
        "unicode": lambda text: unicode_findings(text, marks),
        "homoglyph": homoglyph_findings,
        "secret": secret_findings,
        "encoded": encoded_findings,
        "watermark": dunder_findings,
    }


def _numbered(parts: list[Column]) -> Column:
    """Detector outputs as one array whose elements carry their place in the emit order."""

    def numbered(number: int, part: Column) -> Column:
        return F.transform(
            part,
            lambda f, i: F.struct(
                F.lit(number).cast("tinyint").alias("detector"),
                i.cast("int").alias("seq"),
                f.alias("f"),
            ),
        )

    return F.concat(*[numbered(number, part) for number, part in enumerate(parts)])


def _ordered(numbered: Column) -> Column:
    """Most severe first, then by line, otherwise in emit order."""
    keyed = F.transform(
        numbered,
        lambda x: F.struct(
            (-x.f.severity_rank).alias("a"),
            F.coalesce(x.f.line, F.lit(0)).alias("b"),
            x.detector.alias("detector"),
            x.seq.alias("seq"),
            x.f.alias("f"),
        ),
    )
    names = ["kind", "severity", "severity_rank", "title_key", "line", "column", "detail",
             "rec_key", "extra"]
    return F.transform(
        F.array_sort(keyed),
        lambda x: F.struct(
            x.detector.alias("detector"),
            x.seq.alias("seq"),
            *[x.f.getField(name).alias(name) for name in names],
        ),
    )


def scan(
    sources: DataFrame,
    text: str = "text",
    *,
    marks: MarkStyle = DEFAULT_MARKS,
    detectors: dict[str, Detector] | None = None,
    python_code: bool = True,
    keep_text: bool = False,
    isolate: Collection[str] | None = None,
) -> DataFrame:
    """Add the ordered `findings` array to every row; the text itself is dropped by default.

    A NULL text (an unreadable source) has no findings. Works on batch and streaming tables.
    The detectors named by `isolate` may fail on a text and leave a `detector_error` there; by
    default all but the detectors of this library, whose expressions raise on no text.
    """
    body = F.col(text)
    own = text_detectors(marks)
    chosen = own if detectors is None else detectors
    apart = chosen.keys() - own.keys() if isolate is None else set(isolate)
    staged = sources
    parts = [
        isolated(name, detect(body), body) if name in apart else detect(body)
        for name, detect in chosen.items()
    ]
    if python_code:
        staged = sources.withColumn("_facts", code_facts(body, may_have_marked_comment(body)))
        comments = comment_findings(F.col("_facts.comments"))
        if "watermark" in chosen:
            at = list(chosen).index("watermark")
            parts[at] = F.concat(parts[at], comments)
        parts.append(code_findings(F.col("_facts")))
    found = F.coalesce(
        F.when(body.isNotNull(), _ordered(_numbered(parts))),
        _ordered(_numbered([no_findings()])),
    )
    kept = [c for c in sources.columns if keep_text or c != text]
    return staged.select(*kept, found.alias("findings"))


def explode_findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per finding: the given key columns (default: all others) and its fields."""
    kept = list(keys) or [c for c in scanned.columns if c != "findings"]
    # explode_outer, because Spark would add a size filter to explode and push it below the
    # projection that computes the array, which then would be computed twice.
    return (
        scanned.select(*kept, F.explode_outer("findings").alias("_f"))
        .where(F.col("_f.kind").isNotNull())
        .select(*kept, "_f.*")
    )


def detector_findings(sources: DataFrame, key: str | list[str], found: Column) -> DataFrame:
    """One row per finding of a single detector expression, numbered in emit order."""
    keys = [key] if isinstance(key, str) else key
    return (
        sources.select(*keys, found.alias("findings"))
        .select(*keys, F.posexplode_outer("findings").alias("seq", "_f"))
        .where(F.col("_f.kind").isNotNull())
        .select(*keys, "seq", "_f.*")
    )


def unsuppressed(chars: DataFrame, hidden: DataFrame, *keys: str) -> DataFrame:
    """Character findings on lines without a decoded payload, of two findings tables.

    Stored in the same number of buckets by the keys and `line`, they are joined in place.
    """
    return chars.join(hidden, [*keys, "line"], "left_anti")


def ordered_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """Global report order of a findings table; only for a listing, not for the sink."""
    return findings.orderBy(
        *keys, F.desc("severity_rank"), F.coalesce("line", F.lit(0)), "detector", "seq"
    )
