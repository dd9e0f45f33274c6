"""Scalar text measures used by several detectors."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.matching import let


@cache
def unprintable_class() -> str:
    """A regex class of what Python calls not printable, but for tab and newline.

    The ranges come from Python's tables, since the JVM's own may be of an older Unicode
    version. The two parts let ASCII characters pass without a look at the ranges above.
    """
    ranges, start = [], None
    for code in range(0x80, 0x110001):
        hidden = code < 0x110000 and not chr(code).isprintable()
        if hidden and start is None:
            start = code
        elif not hidden and start is not None:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{code - 1:X}}}")
            start = None
    return rf"[\x00-\x08\x0B-\x1F\x7F]|[\x{{80}}-\x{{10FFFF}}&&[{''.join(ranges)}]]"


def printable_ratio(text: Column) -> Column:
    """Share of printable characters; 0 for the empty string."""
    bad = F.length(text) - F.length(F.regexp_replace(text, unprintable_class(), ""))
    return F.when(F.length(text) > 0, (F.length(text) - bad) / F.length(text)).otherwise(F.lit(0.0))


def shannon_entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    size = F.length(value).cast("double")

    def bits(ch: Column) -> Column:
        count = (F.octet_length(value) - F.octet_length(F.replace(value, ch, F.lit("")))) / F.octet_length(ch)
        return let(count / size, lambda p: p * F.log2(p))

    total = F.aggregate(
        F.array_distinct(F.split(value, "")), F.lit(0.0), lambda acc, ch: acc - bits(ch)
    )
    return F.when(F.length(value) > 0, total).otherwise(F.lit(0.0))


def mask_secret(value: Column, head: int = 6, tail: int = 4) -> Column:
    """Hide the middle of a secret; short ones keep only their first two characters."""
    return F.when(
        F.length(value) <= head + tail, F.concat(F.left(value, F.lit(2)), F.lit("***"))
    ).otherwise(
        F.concat(F.left(value, F.lit(head)), F.lit("…"), F.right(value, F.lit(tail)))
    )


def bytes_to_text(data: Column) -> Column:
    """Strict UTF-8 text of a binary value, NULL when it is not valid UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def bytes_to_text_lenient(data: Column) -> Column:
    """Strict UTF-8 text if possible, otherwise the text without the undecodable bytes.

    Spark replaces bad bytes by U+FFFD; characters that really are U+FFFD are escaped before
    and restored after, so that only the replacements are dropped.
    """

    def swap(text: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    raw = data.cast("string")
    repaired = F.make_valid_utf8(swap(raw, ("~", "~0"), ("\ufffd", "~1")))
    kept = swap(repaired, ("\ufffd", ""), ("~1", "\ufffd"), ("~0", "~"))
    return F.coalesce(F.try_validate_utf8(raw), F.when(F.length(kept) > 0, kept))
