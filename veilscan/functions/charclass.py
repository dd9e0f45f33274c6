"""Suspicious code points: classes, Java regex classes, names and text cleaning."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.matching import let, matches
from veilscan.model import SEVERITY_RANK

# Fixed values: (category, severity, inclusive code point ranges); the first match wins.
CHAR_CLASSES = [
    ("zero_width", "medium", [(0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF)]),
    ("bidi", "high", [(0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)]),
    ("tag", "critical", [(0xE0000, 0xE007F)]),
    ("emoji_selector", "info", [(0xFE0E, 0xFE0F)]),
    ("variation_selector", "low", [(0xFE00, 0xFE0D)]),
    ("variation_selector", "high", [(0xE0100, 0xE01EF)]),
    ("pua", "high", [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]),
    (
        "invisible_format",
        "medium",
        [
            (0x00AD, 0x00AD),  # soft hyphen
            (0x034F, 0x034F),  # combining grapheme joiner
            (0x115F, 0x1160),  # hangul choseong and jungseong fillers
            (0x17B4, 0x17B5),  # khmer inherent vowels
            (0x180E, 0x180E),  # mongolian vowel separator
            (0x2028, 0x2029),  # line and paragraph separators
            (0x3164, 0x3164),  # hangul filler
            (0xFFA0, 0xFFA0),  # halfwidth hangul filler
        ],
    ),
    ("control", "medium", [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F)]),
]

# Code points that can carry a hidden payload.
CARRIER_RANGES = [
    (0x200B, 0x200D),
    (0x2060, 0x2064),
    (0xFEFF, 0xFEFF),
    (0xFE00, 0xFE0F),
    (0xE0000, 0xE007F),
    (0xE0100, 0xE01EF),
]


def regex_ranges(ranges: list[tuple[int, int]]) -> str:
    """Body of a Java character class covering the given code point ranges."""
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges
    )


def fast_class(ranges: list[tuple[int, int]]) -> str:
    """A Java character class that rejects ordinary text after one or two comparisons.

    A plain union tests every range for every ordinary character. Here plain ASCII is ruled
    out first, then the ranges are tested only inside their own block.
    """
    cuts = [0x0, 0x100, 0x2000, 0x2100, 0xE000, 0x110000]
    blocks = []
    for lo, hi in zip(cuts, cuts[1:]):
        inside = [(max(a, lo), min(b, hi - 1)) for a, b in ranges if a < hi and b >= lo]
        if inside:
            blocks.append(f"[\\x{{{lo:X}}}-\\x{{{hi - 1:X}}}&&[{regex_ranges(inside)}]]")
    # The negation needs its own brackets: in front of `&&` it would negate the intersection.
    return f"[[^\\t\\n\\r -~]&&[{''.join(blocks)}]]"


ALL_RANGES = sorted(r for _, _, ranges in CHAR_CLASSES for r in ranges)
SUSPICIOUS = fast_class(ALL_RANGES)
SUSPICIOUS_RUN = SUSPICIOUS + "+"
CARRIER = fast_class(CARRIER_RANGES)

# Code points that have a Unicode name; everything else prints as UNNAMED.
NAMED_CODEPOINTS = {
    cp: unicodedata.name(chr(cp))
    for lo, hi in ALL_RANGES
    if hi - lo < 0x1000  # private-use planes have no names
    for cp in range(lo, hi + 1)
    if unicodedata.name(chr(cp), None)
}
_NAMES = ";".join(name for _, name in sorted(NAMED_CODEPOINTS.items()))


def _range_table(ranges: list[tuple[int, int, int]]) -> str:
    """SQL of an array literal of ranges `(first, last, number)`."""
    rows = [f"struct({a} AS first, {b} AS last, {n} AS number)" for a, b, n in ranges]
    return f"array({', '.join(rows)})"


def _name_stretches() -> list[tuple[int, int, int]]:
    """Contiguous stretches of named code points: first, last, place of the first name."""
    stretches: list[tuple[int, int, int]] = []
    for place, cp in enumerate(sorted(NAMED_CODEPOINTS)):
        if stretches and stretches[-1][1] == cp - 1:
            first, _, start = stretches[-1]
            stretches[-1] = (first, cp, start)
        else:
            stretches.append((cp, cp, place))
    return stretches


_CLASS_TABLE = _range_table(
    [(a, b, number) for number, (_, _, ranges) in enumerate(CHAR_CLASSES) for a, b in ranges]
)
_NAME_TABLE = _range_table(_name_stretches())
_CATEGORIES = "array(" + ", ".join(f"'{category}'" for category, _, _ in CHAR_CLASSES) + ")"
_SEVERITIES = "array(" + ", ".join(f"'{severity}'" for _, severity, _ in CHAR_CLASSES) + ")"
_RANKS = "array(" + ", ".join(str(SEVERITY_RANK[s]) for _, s, _ in CHAR_CLASSES) + ")"


def _stretch(cp: Column, table: str) -> Column:
    """Row of a range table a code point falls into, NULL when there is none."""
    return F.get(F.filter(F.expr(table), lambda r: cp.between(r.first, r.last)), F.lit(0))


def char_class(cp: Column) -> Column:
    """Position in `CHAR_CLASSES` of a code point, NULL when it is an ordinary character."""
    return _stretch(cp, _CLASS_TABLE).number


def class_category(number: Column) -> Column:
    """Category of a character class."""
    return F.get(F.expr(_CATEGORIES), number)


def class_severity(number: Column) -> Column:
    """Severity of a character class."""
    return F.get(F.expr(_SEVERITIES), number)


def class_rank(number: Column) -> Column:
    """Severity rank of a character class."""
    return F.get(F.expr(_RANKS), number)


def classify(text: Column) -> Column:
    """Suspicious characters of a text as `array<struct<char, cp, category, severity>>`."""
    classed = F.transform(
        matches(text, SUSPICIOUS),
        lambda ch: F.struct(ch.alias("char"), F.ascii(ch).alias("cp"), char_class(F.ascii(ch)).alias("n")),
    )
    return F.transform(
        classed,
        lambda c: F.struct(
            c.char.alias("char"),
            c.cp.alias("cp"),
            class_category(c.n).alias("category"),
            class_severity(c.n).alias("severity"),
        ),
    )


def is_suspicious(text: Column) -> Column:
    """True when the text holds at least one suspicious character."""
    return text.rlike(SUSPICIOUS)


def char_name(cp: Column) -> Column:
    """`U+XXXX NAME`, with UNNAMED where Unicode defines no name."""

    def name(stretch: Column) -> Column:
        # Splitting a literal is folded into an array literal when Spark optimizes the plan.
        names = F.split(F.lit(_NAMES), ";")
        return F.coalesce(F.get(names, cp - stretch.first + stretch.number), F.lit("UNNAMED"))

    return F.format_string("U+%04X %s", cp, let(_stretch(cp, _NAME_TABLE), name))


def codepoint_dim(spark: SparkSession) -> DataFrame:
    """Names as a table `(cp, name)`; 385 rows, so always safe to broadcast."""
    return spark.createDataFrame(sorted(NAMED_CODEPOINTS.items()), "cp int, name string")


def clean_text(text: Column) -> Column:
    """The text without any suspicious character; tab, newline and carriage return stay."""
    cleaned = F.regexp_replace(text, SUSPICIOUS_RUN, "")
    return F.when(is_suspicious(text), cleaned).otherwise(text)


def removed_chars(text: Column) -> Column:
    """How many characters `clean_text` takes out."""
    return F.length(text) - F.length(clean_text(text))
