"""Classic watermarks: author dunders and telling comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.charclass import clean_text
from veilscan.functions.matching import SPACE, SPACE_CHARS, let, located, newline_count
from veilscan.model import finding, no_findings

# Dunder names and comment keywords.
DUNDERS = ["__author__", "__copyright__", "__credits__", "__maintainer__"]
COMMENT_KEYWORDS = [
    "created by", "author:", "copyright", "©", "(c)", "written by",
    "автор", "разработал", "watermark", "fingerprint",
]
COMMENT_SHOWN = 160

_ASSIGNED = rf"({'|'.join(DUNDERS)}){SPACE}*={SPACE}*['\"]([^'\"\n]+)['\"]"
# The white space in front of a dunder must contain a line start. Taking the whole run, from
# its first character, visits each run once however many blank lines it has.
_INLINE_SPACE = rf"[{SPACE_CHARS}&&[^\n]]"
DUNDER = (
    rf"(?:\A{SPACE}*+|(?<!{SPACE}){_INLINE_SPACE}*+\n{SPACE}*+){_ASSIGNED}"
)


def dunder_findings(text: Column) -> Column:
    """Author dunders; the line is the first line start of the white space in front."""
    # A match at the very start of the text begins on its first line, any other one on the
    # line after the newline that opens its white space.
    def first_line(x: Column) -> Column:
        at_start = (x.i == 0) & text.startswith(x.m)
        return F.when(at_start, 1).otherwise(x["at"] + 1)

    found = F.transform(
        located(text, DUNDER, newline_count),
        lambda x: finding(
            "watermark",
            "info",
            "finding.watermark_dunder",
            line=first_line(x),
            detail=F.concat(
                F.regexp_extract(x.m, _ASSIGNED, 1),
                F.lit(" = "),
                F.regexp_extract(x.m, _ASSIGNED, 2),
            ),
            name=F.regexp_extract(x.m, _ASSIGNED, 1),
            value=F.regexp_extract(x.m, _ASSIGNED, 2),
        ),
    )
    named = reduce(lambda a, b: a | b, [text.contains(d) for d in DUNDERS])
    return F.when(named, found).otherwise(no_findings())


def has_keyword(text: Column) -> Column:
    """True when the lower-cased text contains one of the comment keywords."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(k) for k in COMMENT_KEYWORDS])


def may_have_marked_comment(text: Column) -> Column:
    """Cheap necessary condition for `comment_findings`, used to skip tokenizing."""
    return text.contains("#") & has_keyword(text)


def comment_findings(comments: Column) -> Column:
    """Findings for the comments (`array<struct<line, text>>`) that hold a keyword."""
    marked = F.filter(comments, lambda c: has_keyword(c.text))

    def described(line: Column, comment: Column) -> Column:
        return finding(
            "watermark",
            "info",
            "finding.watermark_comment",
            line=line,
            detail=F.left(comment, F.lit(COMMENT_SHOWN)),
            comment=comment,
        )

    return F.transform(
        marked,
        lambda c: let(
            F.regexp_replace(clean_text(c.text), f"^{SPACE}+|{SPACE}+$", ""),
            lambda comment: described(c.line, comment),
        ),
    )
