"""Functions against plain Python on many inputs."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.planted import ALPHABET, OWN_MARK, invisible
from veilscan.functions import charclass, matching, stego
from veilscan.functions.messages import format_message, localize, message
from veilscan.functions.text import bytes_to_text, bytes_to_text_lenient, mask_secret, printable_ratio, shannon_entropy
from veilscan.operators.homoglyph import homoglyph_findings, neutralise_escapes
from veilscan.operators.secrets import generic_severity
from veilscan.sources.tree import is_python_path


def column(spark, values, kind, expression):
    """Results of an expression over values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").repartition(4)
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


RANGES = [
    ("zero_width", "medium", "200B-200D 2060-2064 FEFF"),
    ("bidi", "high", "200E-200F 061C 202A-202E 2066-2069"),
    ("tag", "critical", "E0000-E007F"),
    ("emoji_selector", "info", "FE0E-FE0F"),
    ("variation_selector", "low", "FE00-FE0D"),
    ("variation_selector", "high", "E0100-E01EF"),
    ("pua", "high", "E000-F8FF F0000-FFFFD 100000-10FFFD"),
    ("invisible_format", "medium", "00AD 034F 115F 1160 17B4 17B5 180E 2028 2029 3164 FFA0"),
    ("control", "medium", "00-08 0B 0C 0E-1F 7F-9F"),
]


def expected_class(cp):
    for category, severity, spans in RANGES:
        for span in spans.split():
            lo, _, hi = span.partition("-")
            if int(lo, 16) <= cp <= int(hi or lo, 16):
                return category, severity
    return None


def test_character_classes_at_every_edge(spark):
    edges = {int(end, 16) + d for _, _, spans in RANGES for span in spans.split() for end in span.split("-") for d in (-1, 0, 1)}
    points = [cp for cp in sorted(edges | set(range(0x3000))) if 0 <= cp <= 0x10FFFF and not 0xD800 <= cp <= 0xDFFF]
    chars = [chr(cp) for cp in points]
    got = column(spark, chars, "string", lambda x: F.get(charclass.classify(x), F.lit(0)))
    assert [g and (g.category, g.severity) for g in got] == [expected_class(cp) for cp in points]
    hit = column(spark, chars, "string", charclass.is_suspicious)
    assert hit == [expected_class(cp) is not None for cp in points]
    names = column(spark, chars, "string", lambda x: charclass.char_name(F.ascii(x)))
    assert all(
        name == f"U+{cp:04X} {unicodedata.name(chr(cp), 'UNNAMED')}" for cp, name in zip(points, names) if expected_class(cp)
    )


def test_names_table(spark):
    dim = {r.cp: r.name for r in charclass.codepoint_dim(spark).collect()}
    assert len(dim) == 385 and dim[0xFEFF] == "ZERO WIDTH NO-BREAK SPACE" and 0xE000 not in dim


def test_clean_text(spark):
    texts = ["a​b️\u0007\t\r\n", "plain", "", "\U000e0041" * 3, "❤️‍\U0001f525"]
    assert column(spark, texts, "string", charclass.clean_text) == ["ab\t\r\n", "plain", "", "", "❤\U0001f525"]
    assert column(spark, texts, "string", charclass.removed_chars) == [3, 0, 0, 3, 2]


@pytest.mark.parametrize("block", [2, matching.BLOCK])
def test_positions_of_matches(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(7)
    pieces = ["a", "ab", "\n", "​", "\U0001f600", " ", "é", "x1", "​​"]
    texts = ["", "\n", "ab"] + ["".join(rng.choices(pieces, k=rng.randint(1, 120))) for _ in range(60)]
    for pattern in ["​+", "a[b\n]", "[\U0001f600x]\n?"]:
        by_char = column(spark, texts, "string", lambda x: matching.located(x, pattern, F.length))
        by_line = column(spark, texts, "string", lambda x: matching.located(x, pattern, matching.newline_count))
        for text, chars, lines in zip(texts, by_char, by_line):
            found = list(re.finditer(pattern, text))
            assert [(c["i"], c["at"], c["m"]) for c in chars] == [(i, m.start() + 1, m.group()) for i, m in enumerate(found)]
            assert [c["at"] for c in lines] == [text.count("\n", 0, m.start()) + 1 for m in found]


def test_positions_in_a_long_line(spark):
    text = "ab " * 700_000 + "p\u0430y " + "x" * 100_000
    at = column(spark, [text], "string", lambda x: matching.located(x, "b ", F.length).getField("at"))[0]
    assert at == list(range(2, 2_100_000, 3))
    found = column(spark, [text], "string", homoglyph_findings)[0]
    assert [(f.line, f.column, f.extra.word) for f in found] == [(1, 2_100_001, "p\u0430y")]


def test_entropy_and_mask(spark):
    values = ["", "a", "aabb", "abcdefgh", "🙂🙂a", "0123456789", "01234567890"]
    for value, got in zip(values, column(spark, values, "string", shannon_entropy)):
        n = len(value)
        assert got == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(value).values()), abs=1e-12)
    assert column(spark, values, "string", mask_secret)[-2:] == ["01***", "012345…7890"]


def test_generic_severity(spark):
    values = ["your_key_here_1", "CHANGEME", "a...b", "<Your name>", "abcdefghijkl", "aaaaaaaaaaaa", "abcdefghijk"]
    assert column(spark, values, "string", generic_severity) == ["low"] * 4 + ["high", "medium", "medium"]


def test_printable_ratio(spark):
    texts = ["", "abc", "a\u0007", "\t\n ", " a", "​", "é😀 "]
    want = [sum(c.isprintable() or c in " \t\n" for c in t) / len(t) if t else 0.0 for t in texts]
    assert column(spark, texts, "string", printable_ratio) == want


def test_bytes_to_text(spark):
    rng = random.Random(3)
    good = ["é", "�", "~", "~1", "a", "😀", "​"]
    parts = [g.encode() for g in good] + [b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80", b"\xc0\x80", b"\xf5"]
    blobs = [b"".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(400)]

    def strict(data):
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    blobs = [bytearray(b) for b in blobs]
    assert column(spark, blobs, "binary", bytes_to_text) == [strict(b) for b in blobs]
    assert column(spark, blobs, "binary", bytes_to_text_lenient) == [strict(b) or b.decode(errors="ignore") or None for b in blobs]


def decode_in_python(carrier):
    """The decoding rules once more, on Python integers."""
    tables = {
        "v2_octal": ALPHABET,
        "binary_zwsp": "​‌",
        "binary_agent": "‌⁣",
        "quaternary": "​‌‍⁠",
        "hex16": ALPHABET + "⁡",
    }
    options = []
    for name, table in tables.items():
        width = {8: 3, 2: 1, 4: 2, 9: 4}[len(table)]
        bits = "".join(f"{table.index(c):0{width}b}" for c in carrier if c in table)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8))
        text = data.decode(errors="ignore")
        if text and sum(c.isprintable() or c in " \t\n" for c in text) / len(text) > 0.8:
            options.append((text, name))
    magic = [o for o in options if o[0].startswith("SHASH")]
    return (magic or sorted(options, key=lambda o: -len(o[0])) or [None])[0]


def test_decoding_follows_the_rules(spark):
    rng = random.Random(11)
    words = ["hello world", "hi there", OWN_MARK, "a", "SHASH", "пароль", "x" * 40]
    words += ["".join(rng.choices("abcdefghij ", k=rng.randint(3, 30))) for _ in range(80)]
    carriers = [invisible(w) for w in words]
    carriers += ["".join(rng.choices(ALPHABET + "⁡️", k=rng.randint(8, 60))) for _ in range(40)]
    carriers += ["".join(rng.choices("​‌", k=64)) for _ in range(10)]
    got = column(spark, carriers, "string", stego.decode_carrier)
    assert [g and (g.payload, g.scheme) for g in got] == [decode_in_python(c) for c in carriers]
    assert (got[0].scheme, got[1].scheme, len(got[1].payload)) == ("v2_octal", "hex16", 11)


def test_marks(spark):
    texts = [OWN_MARK, "SHASH|a|b", "SHASH|a|b|c|d", "shash|a|b|c", "SHASH|||00000000", ""]
    got = column(spark, texts, "string", stego.parse_mark)
    assert got[0].valid_checksum and [g is None for g in got] == [False, True, True, True, False, True]
    assert not got[4].valid_checksum
    built = column(spark, ["2026-06-18"], "string", lambda d: stego.build_mark(F.lit("example.org"), d))
    assert built == [OWN_MARK]
    texts = ["", "a", "ab", "abc", "пароль 😀"]
    assert column(spark, texts, "string", stego.encode_mark) == [invisible(t) if t else "" for t in texts]


def test_escapes_keep_their_length(spark):
    texts = ["a\\n\\t", "\\101x\\7", "\\x41\\xZ", "\\u0416\\U0001F600", "\\N{DASH}é", "\\", "\\\\n", "plain"]
    pattern = r"\\[0-7]{1,3}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\N\{[^}]*\}|\\."
    want = [re.sub(pattern, lambda m: " " * len(m.group()), t) for t in texts]
    assert column(spark, texts, "string", neutralise_escapes) == want


def test_messages(spark):
    keys = ["sev.high", "no.such.key"]
    assert column(spark, keys, "string", lambda k: message(k, "en")) == ["high", "no.such.key"]
    assert column(spark, keys, "string", lambda k: message(k, "de")) == ["высокая", "no.such.key"]
    rows = localize(spark.createDataFrame([(k,) for k in keys], "title_key string"), "en").orderBy("title").collect()
    assert [r.title for r in rows] == ["high", "no.such.key"]
    templates = ["{count} of {path}", "{count} {year}", "plain"]
    got = column(spark, templates, "string", lambda t: format_message(t, count=F.lit(3), path=F.lit("x")))
    assert got == ["3 of x", "{count} {year}", "plain"]


def test_printable_of_all_code_points(spark):
    codes = spark.range(0x110000).where("id < 55296 or id > 57343")
    one = codes.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = one.where(printable_ratio(F.col("c")) == 1.0).select("id").collect()
    tolerated = {9, 10}
    expected = {i for i in range(0x110000) if chr(i).isprintable() or i in tolerated}
    assert {r.id for r in found} == expected


def test_python_path_names(spark):
    names = {"a.py": 1, "a.PYW": 1, "d/__init__.py": 1, ".h.py": 1, ".py": 0, "..py": 0, "d/...py": 0, "a.py\n": 0, "a.pyc": 0}
    rows = spark.createDataFrame(list(names.items()), "name string, wanted int")
    assert all(r.p == bool(r.wanted) for r in rows.select("wanted", is_python_path(F.col("name")).alias("p")).collect())


def test_first_magic_payload_wins_and_marks_are_spread(spark, tmp_path):
    shorter = invisible(OWN_MARK)
    texts = [shorter, invisible("hello there, a longer text than that"), "\u200b" * 9, None]
    got = column(spark, texts, "string", stego.decode_carrier)
    assert [g and (g.payload, g.scheme) for g in got[:2]] == [(OWN_MARK, "v2_octal"), ("hello there, a longer text than that", "v2_octal")]
    assert got[3] is None
    rows = spark.range(50).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name", "id % 25 AS c_nationkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    trip = queries.mark_round_trip(spark, str(tmp_path))
    assert trip.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert trip.where("valid_checksum AND scheme = 'v2_octal'").count() == 50
