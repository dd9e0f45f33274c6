"""Invisible characters, hidden payloads and author marks.

Everything happens inside one row: suspicious lines are found by one regular expression, runs
and carriers are matched per line (neither can span a newline), and the per-text rules work on
the resulting arrays. No shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.charclass import (
    SUSPICIOUS,
    SUSPICIOUS_RUN,
    char_class,
    char_name,
    class_category,
    class_rank,
    is_suspicious,
)
from veilscan.functions.matching import first_of, let, lines_matching, located
from veilscan.functions.stego import (
    DEFAULT_MARKS,
    MarkStyle,
    carriers,
    decode_carrier,
    parse_mark,
)
from veilscan.model import finding, no_findings, severity_name

EMOJI_KIND = "unicode_emoji_selector"
NAMES_SHOWN = 6
LINES_SHOWN = 10
PAYLOAD_SHOWN = 200


def _run_finding(line: Column, column: Column, run: Column) -> Column:
    # A run's severity, categories and names depend on its distinct characters only.
    size = F.length(run)

    def describe(cps: Column, classes: Column) -> Column:
        single = size == 1
        category = class_category(F.get(classes, F.lit(0)))
        names = F.array_join(
            F.transform(F.slice(cps, 1, NAMES_SHOWN), char_name), ", "
        )
        return finding(
            F.concat(F.lit("unicode_"), F.when(single, category).otherwise("run")),
            severity_name(F.array_max(F.transform(classes, class_rank))),
            F.concat(F.lit("finding."), F.when(single, category).otherwise("invisible_run")),
            line=line,
            column=column,
            detail=F.when(single, names).otherwise(
                F.concat(
                    F.lit("×"),
                    size.cast("string"),
                    F.lit(" · "),
                    names,
                    F.when(F.size(cps) > NAMES_SHOWN, " …").otherwise(""),
                )
            ),
            rec_key=F.when(single & (category == "emoji_selector"), "rec.emoji").otherwise(
                "rec.invisible"
            ),
            codepoint=F.when(single, F.ascii(run)),
            category=F.when(single, category),
            count=F.when(~single, size),
            categories=F.when(
                ~single, F.array_sort(F.array_distinct(F.transform(classes, class_category)))
            ),
            codepoints=F.when(~single, cps),
        )

    return let(
        F.array_sort(F.transform(F.array_distinct(F.split(run, "")), F.ascii)),
        lambda cps: let(F.transform(cps, char_class), lambda classes: describe(cps, classes)),
    )


def line_char_findings(line: Column, text: Column) -> Column:
    """One finding per run of suspicious characters on a line."""
    return F.transform(
        located(text, SUSPICIOUS_RUN, F.length), lambda x: _run_finding(line, x["at"], x.m)
    )


def line_carrier_findings(line: Column, text: Column, marks: MarkStyle) -> Column:
    """One finding per carrier on a line that decodes to something readable."""

    def describe(hit: Column) -> Column:
        hidden = finding(
            "hidden_string",
            "high",
            "finding.hidden_string",
            line=line,
            detail=F.left(hit.payload, F.lit(PAYLOAD_SHOWN)),
            rec_key="rec.hidden_string",
            scheme=hit.scheme,
            length=F.length(hit.payload),
            payload=hit.payload,
        )

        def mark_finding(mark: Column) -> Column:
            own = mark.domain == marks.domain
            return finding(
                "author_mark",
                F.when(own & mark.valid_checksum, "info").otherwise("medium"),
                "finding.author_mark",
                line=line,
                detail=hit.payload,
                rec_key=F.when(~own, "rec.foreign_mark"),
                scheme=hit.scheme,
                magic=mark.magic,
                domain=mark.domain,
                date=mark.date,
                checksum=mark.checksum,
                valid_checksum=mark.valid_checksum,
            )

        return let(
            parse_mark(hit.payload, marks),
            lambda mark: F.when(mark.isNotNull(), mark_finding(mark)).otherwise(hidden),
        )

    decoded = F.filter(
        F.transform(carriers(text), lambda c: decode_carrier(c, marks)), lambda d: d.isNotNull()
    )
    return F.transform(decoded, describe)


def roll_up_emoji(findings: Column) -> Column:
    """Fold several single emoji selectors of a text into one closing finding."""

    def folded(emoji: Column) -> Column:
        lines = F.array_sort(F.array_distinct(F.transform(emoji, lambda f: f.line)))
        summary = let(
            lines,
            lambda ls: finding(
                EMOJI_KIND,
                "info",
                "finding.emoji_selector",
                line=F.get(ls, F.lit(0)),
                detail=F.concat(
                    F.lit("×"),
                    F.size(emoji).cast("string"),
                    F.lit(" · U+FE0F · @ "),
                    first_of(ls, LINES_SHOWN),
                ),
                rec_key="rec.emoji",
                count=F.size(emoji),
                lines=ls,
            ),
        )
        rest = F.filter(findings, lambda f: f.kind != EMOJI_KIND)
        return F.when(F.size(emoji) <= 1, findings).otherwise(F.concat(rest, F.array(summary)))

    return let(F.filter(findings, lambda f: f.kind == EMOJI_KIND), folded)


def char_findings(text: Column) -> Column:
    """All character findings, before suppression and roll-up."""
    found = F.flatten(
        F.transform(
            lines_matching(text, SUSPICIOUS), lambda row: line_char_findings(row.line, row.s)
        )
    )
    return F.when(is_suspicious(text), found).otherwise(no_findings())


def carrier_findings(text: Column, marks: MarkStyle = DEFAULT_MARKS) -> Column:
    """Decoded marks and hidden strings."""
    found = F.flatten(
        F.transform(
            lines_matching(text, SUSPICIOUS),
            lambda row: line_carrier_findings(row.line, row.s, marks),
        )
    )
    return F.when(is_suspicious(text), found).otherwise(no_findings())


def unicode_findings(text: Column, marks: MarkStyle = DEFAULT_MARKS) -> Column:
    """Character findings and decoded payloads of a text.

    A line with a decoded payload reports the payload only: its character findings are dropped.
    """
    per_line = F.transform(
        lines_matching(text, SUSPICIOUS),
        lambda row: let(
            line_carrier_findings(row.line, row.s, marks),
            lambda hidden: F.struct(
                hidden.alias("hidden"),
                F.when(F.size(hidden) > 0, no_findings())
                .otherwise(line_char_findings(row.line, row.s))
                .alias("chars"),
            ),
        ),
    )
    found = let(
        per_line,
        lambda rows: F.concat(
            F.flatten(F.transform(rows, lambda r: r.chars)),
            F.flatten(F.transform(rows, lambda r: r.hidden)),
        ),
    )
    return F.when(is_suspicious(text), let(found, roll_up_emoji)).otherwise(no_findings())
