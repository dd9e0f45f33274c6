"""Reports as text and HTML: one block per source, built from its findings array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.messages import DEFAULT_LANGUAGE, message
from veilscan.plans.reports import corpus_report, with_report

# Icons and colours.
SEVERITY_ICON = {"critical": "🚨", "high": "⚠️", "medium": "⚠️", "low": "📌", "info": "📝"}
KIND_ICON = {"author_mark": "👤", "secret": "🔑"}
STATUS_ICON = {"green": "✅", "yellow": "⚠️", "red": "🚨"}
SEVERITY_COLOR = {
    "critical": "#f85149",
    "high": "#ff7b54",
    "medium": "#d29922",
    "low": "#58a6ff",
    "info": "#8b949e",
}
STATUS_COLOR = {"green": "#3fb950", "yellow": "#d29922", "red": "#f85149"}
BAR = "=" * 60


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def finding_icon(finding: Column) -> Column:
    """Icon of a finding: by kind for marks and secrets, else by severity."""
    return F.coalesce(
        _lookup(finding.kind, KIND_ICON), _lookup(finding.severity, SEVERITY_ICON), F.lit("•")
    )


def location(finding: Column) -> Column:
    """`line:column`, `line`, or empty when there is no line; a column of 0 does not show."""
    column = F.when(finding.column > 0, F.concat(F.lit(":"), finding.column.cast("string")))
    return F.when(finding.line.isNull(), "").otherwise(
        F.concat(finding.line.cast("string"), F.coalesce(column, F.lit("")))
    )


def escape_html(text: Column) -> Column:
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, text)


def _has(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _lines(findings: Column, lang: str, icon: bool) -> Column:
    """Text lines of a findings array; the console listing has no icons or advice."""

    def entry(f: Column) -> Column:
        place = F.when(_has(location(f)), F.concat(F.lit("  ("), location(f), F.lit(")")))
        head = F.concat(
            F.lit("    "),
            F.concat(finding_icon(f), F.lit(" ")) if icon else F.lit(""),
            F.lit("["),
            message(F.concat(F.lit("sev."), f.severity), lang),
            F.lit("] "),
            message(f.title_key, lang),
            F.coalesce(place, F.lit("")),
        )
        arrow = "        → " if icon else "        -> "
        detail = F.when(_has(f.detail), F.concat(F.lit(arrow), f.detail))
        advice = F.when(_has(f.rec_key), F.concat(F.lit("        ⚑ "), message(f.rec_key, lang)))
        return F.concat_ws("\n", head, detail, advice if icon else F.lit(None).cast("string"))

    return F.transform(findings, entry)


def _source_head(icon: Column, lang: str) -> Column:
    return F.concat(
        icon, F.lit(" "), F.col("path"), F.lit("  ("), message("ui.encoding", lang),
        F.lit(": "), F.col("encoding"), F.lit(")"),
    )


def text_block(lang: str = DEFAULT_LANGUAGE) -> Column:
    """Report block of a source; ends with a newline, which leaves a blank line after it."""
    body = F.when(
        F.size("findings") > 0, F.array_join(_lines(F.col("findings"), lang, True), "\n")
    ).otherwise(F.concat(F.lit("    ✅ "), message("ui.no_findings", lang)))
    return F.concat(_source_head(_lookup(F.col("status"), STATUS_ICON), lang), F.lit("\n"), body, F.lit("\n"))


def console_block(lang: str = DEFAULT_LANGUAGE) -> Column:
    """Console block of a source: a bullet, findings without icons or advice."""
    body = F.when(
        F.size("findings") > 0, F.array_join(_lines(F.col("findings"), lang, False), "\n")
    ).otherwise(F.concat(F.lit("    ✓ "), message("ui.no_findings", lang)))
    return F.concat(F.lit("\n"), _source_head(F.lit("●"), lang), F.lit("\n"), body)


def html_card(lang: str = DEFAULT_LANGUAGE) -> Column:
    """HTML fragment of a source; red ones are open."""

    def row(f: Column) -> Column:
        severity = escape_html(message(F.concat(F.lit("sev."), f.severity), lang))
        color = F.coalesce(_lookup(f.severity, SEVERITY_COLOR), F.lit(SEVERITY_COLOR["info"]))
        place = F.when(
            _has(location(f)), F.concat(F.lit(' <span class="rloc">· '), location(f), F.lit("</span>"))
        )
        detail = F.when(
            _has(f.detail), F.concat(F.lit('<div class="rdetail">'), escape_html(f.detail), F.lit("</div>"))
        )
        advice = F.when(
            _has(f.rec_key),
            F.concat(F.lit('<div class="rrec">⚑ '), escape_html(message(f.rec_key, lang)), F.lit("</div>")),
        )
        return F.concat(
            F.lit('<div class="row"><span class="badge" style="color:'), color, F.lit('">'),
            severity, F.lit('</span><div><div class="rtitle">'),
            escape_html(message(f.title_key, lang)), F.coalesce(place, F.lit("")), F.lit("</div>"),
            F.coalesce(detail, F.lit("")), F.coalesce(advice, F.lit("")), F.lit("</div></div>"),
        )

    some = F.size("findings") > 0
    status = F.col("status")
    body = F.when(
        some,
        F.concat(
            F.lit('<div class="findings">'),
            F.array_join(F.transform("findings", row), "\n"),
            F.lit("</div>"),
        ),
    ).otherwise(
        F.concat(F.lit('<div class="ok">✅ '), escape_html(message("ui.no_findings", lang)), F.lit("</div>"))
    )
    return F.concat(
        F.lit('<details class="file '), status, F.lit('"'),
        F.when(some & (status == "red"), " open").otherwise(""),
        F.lit('><summary><span class="dot" style="background:'), _lookup(status, STATUS_COLOR),
        F.lit('"></span><span class="path">'), escape_html(F.col("path")),
        F.lit('</span><span class="meta">'), message("ui.encoding", lang), F.lit(": "),
        escape_html(F.col("encoding")), F.lit("</span></summary>"), body, F.lit("</details>"),
    )


def _footer(lang: str, counters: list[tuple[str, str]]) -> Column:
    rows = [
        F.concat(F.lit("  "), message(key, lang), F.lit(": "), F.col(column).cast("string"))
        for key, column in counters
    ]
    return F.concat_ws("\n", F.lit(BAR), *rows, F.lit(BAR))


def _listing(scanned: DataFrame, block: Column, head: str, foot: Column) -> DataFrame:
    """Header, blocks in report order and footer as rows `(part, max_rank, path, value)`.

    Blocks are rendered behind the sort, whose sampling would otherwise render them once more.
    """
    reports = with_report(scanned)
    blocks = reports.select(F.lit(1).alias("part"), "max_rank", "path", "encoding", "status", "findings")
    edge = [F.lit(0).alias("max_rank"), F.lit("").alias("path")]
    top = scanned.sparkSession.range(1).select(F.lit(0).alias("part"), *edge, F.lit(head).alias("value"))
    bottom = corpus_report(reports).select(F.lit(2).alias("part"), *edge, foot.alias("value"))
    rows = top.unionByName(blocks, allowMissingColumns=True).unionByName(bottom, allowMissingColumns=True)
    value = F.when(F.col("part") == 1, block).otherwise(F.col("value"))
    return rows.orderBy("part", F.desc("max_rank"), "path").select("part", "max_rank", "path", value.alias("value"))


def _title(title: str, lang: str) -> list[str]:
    from veilscan.functions.messages import MESSAGES

    tagline = MESSAGES.get(lang, MESSAGES[DEFAULT_LANGUAGE])["app.tagline"]
    return [BAR, f"  {title.upper()} — {tagline}", BAR]


def text_report(
    scanned: DataFrame, lang: str = DEFAULT_LANGUAGE, title: str = "veilscan"
) -> DataFrame:
    """The whole text report as ordered rows.

    The footer needs the counters of all sources, so pass a stored scan (see `sinks.stage`);
    otherwise the texts are scanned twice.
    """
    counters = [
        ("ui.files_scanned", "files_scanned"),
        ("ui.threats", "threats"),
        ("ui.marks", "author_marks"),
        ("ui.issues", "files_with_issues"),
    ]
    head = "\n".join([*_title(title, lang), ""])
    return _listing(scanned, text_block(lang), head, _footer(lang, counters))


def console_listing(
    scanned: DataFrame, lang: str = DEFAULT_LANGUAGE, title: str = "veilscan"
) -> DataFrame:
    """The console listing as ordered rows; pass a stored scan, as for `text_report`."""
    counters = [
        ("ui.files_scanned", "files_scanned"),
        ("ui.threats", "threats"),
        ("ui.marks", "author_marks"),
    ]
    foot = F.concat(F.lit("\n"), _footer(lang, counters))
    return _listing(scanned, console_block(lang), "\n".join(_title(title, lang)), foot)


def html_cards(scanned: DataFrame, lang: str = DEFAULT_LANGUAGE) -> DataFrame:
    """One HTML fragment per source, in report order; rendered behind the sort."""
    ordered = with_report(scanned).orderBy(F.desc("max_rank"), "path")
    return ordered.select("path", "max_rank", html_card(lang).alias("value"))
