"""Hidden payloads in invisible characters: decode, encode, build and verify marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.charclass import CARRIER
from veilscan.functions.matching import let, matches
from veilscan.functions.text import bytes_to_text_lenient, printable_ratio

# The canonical eight-symbol alphabet and the decoding schemes in order.
V2_ALPHABET = "\u200b\u200c\u200d\u2060\u2062\u2063\u2064\ufeff"
SCHEMES = [
    ("v2_octal", V2_ALPHABET),
    ("binary_zwsp", "\u200b\u200c"),
    ("binary_agent", "\u200c\u2063"),
    ("quaternary", "\u200b\u200c\u200d\u2060"),
    ("hex16", V2_ALPHABET + "\u2061\u200e\u200f\u202f\u2066\u2067\u2068\u2069"),
]
# Shortest carrier worth decoding, and the printable share a payload must exceed.
MIN_CARRIER = 8
MIN_PRINTABLE = 0.8

LONG_CARRIER = f"{CARRIER}{{{MIN_CARRIER},}}"


@dataclass(frozen=True)
class MarkStyle:
    """Whose author marks are "own": the magic word of the format and the owner's domain."""

    magic: str = "SHASH"  # fixed value: first field of the mark format
    domain: str = "example.org"


DEFAULT_MARKS = MarkStyle()


def carriers(text: Column) -> Column:
    """Maximal runs of payload-capable characters, at least `MIN_CARRIER` long."""
    return matches(text, LONG_CARRIER)


# The schemes as an array literal `(scheme, alphabet, width)`; width is bits per symbol.
_SCHEME_TABLE = "array({})".format(
    ", ".join(
        f"struct('{name}' AS scheme, '{alphabet}' AS alphabet, "
        f"{len(alphabet).bit_length() - 1} AS width)"
        for name, alphabet in SCHEMES
    )
)


def decode_scheme(carrier: Column, alphabet: Column, width: Column) -> Column:
    """Payload of a carrier under one power-of-two alphabet, NULL when there is none.

    Characters outside the alphabet are skipped and the bits of an incomplete byte dropped.
    """
    places = F.transform(F.split(carrier, ""), lambda ch: F.instr(alphabet, ch))
    bits = F.transform(
        F.filter(places, lambda at: at > 0),
        lambda at: F.lpad(F.bin((at - 1).cast("long")), width, F.lit("0")),
    )
    octets = matches(F.array_join(bits, ""), "[01]{8}")
    hexes = F.transform(octets, lambda b: F.lpad(F.conv(b, 2, 16), F.lit(2), F.lit("0")))
    return let(
        F.unhex(F.array_join(hexes, "")),
        lambda data: F.when(F.octet_length(data) > 0, bytes_to_text_lenient(data)),
    )


def decode_carrier(carrier: Column, marks: MarkStyle = DEFAULT_MARKS) -> Column:
    """Best readable decoding as `struct<payload, scheme>`, NULL when no scheme is readable.

    A payload that starts with the magic word wins in scheme order, else the longest payload
    (the earlier scheme on a tie).
    """
    kind = "struct<payload:string,scheme:string,magic:boolean>"

    def better(best: Column, scheme: Column, payload: Column) -> Column:
        magic = payload.startswith(marks.magic)
        longer = best.isNull() | (F.length(payload) > F.length(best.payload))
        found = F.struct(payload.alias("payload"), scheme.alias("scheme"), magic.alias("magic"))
        readable = printable_ratio(payload) > MIN_PRINTABLE
        return F.when(readable & (magic | longer), found).otherwise(best)

    # The carrier is worked out once, and schemes behind a payload with the magic word never.
    return let(
        carrier,
        lambda given: F.aggregate(
            F.expr(_SCHEME_TABLE),
            F.lit(None).cast(kind),
            lambda best, s: F.when(best.magic, best).otherwise(
                let(decode_scheme(given, s.alphabet, s.width), lambda p: better(best, s.scheme, p))
            ),
            lambda best: F.when(best.isNotNull(), F.struct(best.payload.alias("payload"), best.scheme.alias("scheme"))),
        ),
    )


def mark_checksum(base: Column) -> Column:
    """CRC-32 of a mark's first three fields, eight upper-case hex digits."""
    return F.lpad(F.hex(F.crc32(base.cast("binary"))), F.lit(8), F.lit("0"))


def build_mark(domain: Column, date: Column, marks: MarkStyle = DEFAULT_MARKS) -> Column:
    """Mark text `magic|domain|date|checksum`."""
    base = F.concat_ws("|", F.lit(marks.magic), domain, date)
    return F.concat_ws("|", base, mark_checksum(base))


def encode_mark(payload: Column) -> Column:
    """Invisible form of a payload: its UTF-8 bits, zero-padded to threes, in the alphabet."""
    octets = matches(F.hex(payload.cast("binary")), "[0-9A-F]{2}")
    bits = F.array_join(
        F.transform(octets, lambda h: F.lpad(F.conv(h, 16, 2), F.lit(8), F.lit("0"))), ""
    )
    triples = matches(F.concat(bits, F.lit("00")), "[01]{3}")  # 00: pads, never adds a symbol
    return F.array_join(
        F.transform(
            triples,
            lambda t: F.substring(F.lit(V2_ALPHABET), F.conv(t, 2, 10).cast("int") + 1, F.lit(1)),
        ),
        "",
    )


def parse_mark(payload: Column, marks: MarkStyle = DEFAULT_MARKS) -> Column:
    """`struct<magic, domain, date, checksum, valid_checksum>`, NULL when not a mark."""

    def fields(p: Column) -> Column:
        base = F.array_join(F.slice(p, 1, 3), "|")
        parsed = F.struct(
            F.get(p, F.lit(0)).alias("magic"),
            F.get(p, F.lit(1)).alias("domain"),
            F.get(p, F.lit(2)).alias("date"),
            F.get(p, F.lit(3)).alias("checksum"),
            (mark_checksum(base) == F.upper(F.get(p, F.lit(3)))).alias("valid_checksum"),
        )
        return F.when((F.size(p) == 4) & (F.get(p, F.lit(0)) == marks.magic), parsed)

    return let(F.split(payload, r"\|", -1), fields)
