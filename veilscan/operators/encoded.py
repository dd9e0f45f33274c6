"""Base64 and hex literals that decode to readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.matching import (
    BOUNDARY,
    WORD_END,
    WORD_START,
    lines_matching,
    matches_by_line,
)
from veilscan.functions.text import bytes_to_text, printable_ratio
from veilscan.model import finding, no_findings

# Token shapes, and what a decoded text must reach to count as readable.
BASE64 = f"{BOUNDARY}[A-Za-z0-9+/]{{20,}}={{0,2}}{BOUNDARY}"
HEX = f"{WORD_START}[0-9a-fA-F]{{32,}}{WORD_END}"
MIN_PRINTABLE = 0.85
MIN_DECODED = 3
DETAIL_SHOWN = 160

# Any match of either shape contains such a run. The look-behind (a run's first character
# does not follow a lower-case letter) and the look-ahead only skip hopeless positions.
_LONG_RUN = "(?<![a-z])(?=[^ ]{20})[a-zA-Z/-9+]{20}"


def decode_base64(token: Column) -> Column:
    """UTF-8 text of a base64 token, NULL unless its length is a multiple of four."""
    data = F.when(F.length(token) % 4 == 0, F.try_to_binary(token, F.lit("base64")))
    return bytes_to_text(data)


def decode_hex(token: Column) -> Column:
    """UTF-8 text of a hex token, NULL unless it has whole bytes."""
    return bytes_to_text(F.when(F.length(token) % 2 == 0, F.unhex(token)))


def encoded_findings(text: Column, *encodings: str) -> Column:
    """Readable base64 literals, then readable hex literals (or only the named encoding)."""
    shapes = {"base64": (BASE64, decode_base64), "hex": (HEX, decode_hex)}

    def decoded(encoding: str) -> Column:
        pattern, decode = shapes[encoding]
        return F.transform(
            matches_by_line(lines_matching(text, _LONG_RUN), pattern),
            lambda x: F.struct(
                x.line.alias("line"), F.lit(encoding).alias("encoding"), decode(x.m).alias("decoded")
            ),
        )

    readable = F.filter(
        F.concat(*[decoded(name) for name in shapes if not encodings or name in encodings]),
        lambda x: (F.length(x.decoded) >= MIN_DECODED)
        & (printable_ratio(x.decoded) >= MIN_PRINTABLE),
    )
    found = F.transform(
        readable,
        lambda x: finding(
            "encoded_string",
            "low",
            "finding.encoded_string",
            line=x.line,
            detail=F.concat(
                F.lit("["), x.encoding, F.lit("] → "), F.left(x.decoded, F.lit(DETAIL_SHOWN))
            ),
            rec_key="rec.encoded_string",
            encoding=x.encoding,
            decoded=x.decoded,
        ),
    )
    return F.when(text.rlike(_LONG_RUN), found).otherwise(no_findings())
