"""Regular-expression matches with exact positions, built from Spark functions only.

Spark has no function that returns match offsets in code points. `located` derives them from
`regexp_extract_all` (the matches) and `split` (the texts between them): the position of a
match is the sum of the sizes of all pieces in front of it. These running sums go over blocks
of matches, blocks of blocks, and the few sums of those, so memory grows with the matches and
time with the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32  # sizes that are added up one by one
LEVELS = 2  # of blocks, before the sums of blocks are added up one by one

# The characters that count as white space and as word characters in the
# patterns, spelled out because Java's own \s, \w and \b mean something else.
SPACE_CHARS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD_START = f"(?<![{WORD_CHARS}])"  # a word boundary in front of a word character
WORD_END = f"(?![{WORD_CHARS}])"  # a word boundary behind a word character
BOUNDARY = (
    f"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def numbered_lines(text: Column) -> Column:
    """`array<struct<line, s>>`; lines end at a newline only and count from 1."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda s, i: F.struct((i + 1).alias("line"), s.alias("s")),
    )


def lines_matching(text: Column, *patterns: str) -> Column:
    """Numbered lines that contain a match of every pattern; put the cheapest first."""

    def every(row: Column) -> Column:
        return reduce(lambda a, b: a & b, [row.s.rlike(p) for p in patterns])

    return F.filter(numbered_lines(text), every)


def matches(text: Column, pattern: str) -> Column:
    """All matches of `pattern`, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda total, size: total + size)


def _running(sizes: Column) -> Column:
    """Running sums, each added up from the start."""
    return F.transform(sizes, lambda _, i: _total(F.slice(sizes, F.lit(1), i + 1)))


def running_sums(sizes: Column, levels: int = LEVELS) -> Column:
    """Running sums of an array of integers."""
    if not levels:
        return let(sizes, _running)
    starts = F.sequence(F.lit(1), F.size(sizes), F.lit(BLOCK))

    def after(blocks: Column) -> Column:
        totals = F.transform(blocks, _total)
        return let(
            running_sums(totals, levels - 1),
            lambda upto: F.flatten(
                F.transform(
                    blocks,
                    lambda block, i: let(
                        F.get(upto, i) - _total(block),
                        lambda before: F.transform(_running(block), lambda x: x + before),
                    ),
                )
            ),
        )

    blocks = F.transform(starts, lambda start: F.slice(sizes, start, F.lit(BLOCK)))
    return F.when(F.size(sizes) > 0, let(blocks, after)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, units: Callable[[Column], Column]) -> Column:
    """`array<struct<i, at, m>>`: match number, 1-based position in `units`, matched text.

    `units` counts the units in a piece of text: `F.length` gives character positions,
    `newline_count` gives line numbers. `pattern` must not match the empty string.
    """

    def positions(found: Column, gaps: Column) -> Column:
        # In front of match i: the gap before it, and the match and the gaps before that.
        sizes = F.transform(
            found,
            lambda _, i: units(F.get(gaps, i))
            + F.when(i > 0, units(F.get(found, i - 1))).otherwise(F.lit(0)),
        )
        return let(
            sizes,
            lambda pieces: let(
                running_sums(pieces),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        i.cast("int").alias("i"), (F.get(before, i) + 1).alias("at"), m.alias("m")
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<i:int,at:int,m:string>>")
    return let(
        matches(text, pattern),
        lambda found: F.when(
            F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: positions(found, gaps))
        ).otherwise(none),
    )


def matches_by_line(lines: Column, pattern: str) -> Column:
    """`array<struct<line, m>>` in numbered lines, for a pattern that cannot span a newline."""
    return F.flatten(
        F.transform(
            F.filter(lines, lambda row: row.s.rlike(pattern)),
            lambda row: F.transform(
                matches(row.s, pattern), lambda m: F.struct(row.line.alias("line"), m.alias("m"))
            ),
        )
    )


def first_of(items: Column, limit: int, separator: str = ", ") -> Column:
    """The first `limit` items joined, with an ellipsis when there are more."""
    shown = F.array_join(F.transform(F.slice(items, 1, limit), lambda x: x.cast("string")), separator)
    return F.concat(shown, F.when(F.size(items) > limit, " …").otherwise(""))
