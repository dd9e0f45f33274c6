"""Inputs of the checked queries, derived from the given tables.

The natural texts hold almost nothing a detector could find, so every document gets a suffix
chosen by its id. The recipes are SQL expressions that mean the same to Spark and to DuckDB;
both sides evaluate them over the whole table.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"
BS = "chr(92)"

ALPHABET = "\u200b\u200c\u200d\u2060\u2062\u2063\u2064\ufeff"


def invisible(payload: str) -> str:
    """A payload in the invisible alphabet, worked out here independently of the library."""
    number = int.from_bytes(payload.encode(), "big")
    size = len(payload.encode()) * 8
    pad = -size % 3
    digits = f"{number << pad:0{(size + pad) // 3}o}"
    return "".join(ALPHABET[int(d)] for d in digits)


def mark(domain: str, date: str = "2026-06-18", valid: bool = True) -> str:
    base = f"SHASH|{domain}|{date}"
    checksum = zlib.crc32(base.encode()) ^ (0 if valid else 1)
    return f"{base}|{checksum:08X}"


OWN_MARK = mark("example.org")
FOREIGN_MARK = mark("example.net")
BROKEN_MARK = mark("example.org", valid=False)
HIDDEN = "hello world"

_DIGEST = "md5(cast(doc_id as string))"
_UPPER = f"upper({_DIGEST})"

# One value per token shape, filled from the document's digest so that no real credential
# appears. Order as in SECRET_NAMES.
SECRET_NAMES = [
    "aws_key", "telegram_token", "stripe_live", "github_token", "github_pat",
    "google_api", "slack_token", "private_key", "jwt",
]
SECRET_VALUES = {
    "aws_key": f"'AKIA' || substr({_UPPER}, 1, 16)",
    "telegram_token": f"'123456789' || ':' || {_DIGEST} || 'abc'",
    "stripe_live": f"'sk_live_' || substr({_DIGEST}, 1, 24)",
    "github_token": f"'ghp_' || {_DIGEST} || 'AbCd'",
    "github_pat": f"'github_pat_' || {_DIGEST} || '_' || {_DIGEST}",
    "google_api": f"'AIza' || {_DIGEST} || 'x-Y'",
    "slack_token": f"'xoxb-' || substr({_DIGEST}, 1, 12) || '-' || substr({_DIGEST}, 13, 12)",
    "private_key": "'-----BEGIN RSA ' || 'PRIVATE KEY-----'",
    "jwt": f"'eyJ' || substr({_DIGEST}, 1, 8) || '.eyJ' || substr({_DIGEST}, 9, 8) || '.' || {_DIGEST}",
}
SECRET_TURN = "cast(floor(doc_id / 24) as bigint) % 9"

_SECRET_CASE = " ".join(f"WHEN {i} THEN {SECRET_VALUES[n]}" for i, n in enumerate(SECRET_NAMES))

SUFFIXES = {
    0: "'a zero' || '\u200b' || 'width'",
    1: "'abc ' || '\u202e' || 'cba ' || '\u2067'",
    2: "'tag ' || '\U000e0041'",
    3: "'one emoji ⬇' || '\ufe0f'",
    4: "'selector ' || '\ufe01'",
    5: "'selector ' || '\U000e0101'",
    6: "'private ' || '\ue001' || ' and ' || '\U00100001'",
    7: "'soft' || '\u00ad' || 'hyphen ' || '\u2028' || ' end'",
    8: "'bell ' || '\u0007' || ' nel ' || '\u0085'",
    9: "'\U0001f600' || '\u200b' || '\u202e' || '\ufe0f' || '\U000e0041' || '\u200c' || '\u00ad' || '\u180e' || '\u200b'",
    10: f"repeat('⬇' || '\ufe0f' || ' down' || {NL}, cast(2 + doc_id % 11 as int))",
    11: f"'ok ' || '{invisible(OWN_MARK)}'",
    12: f"'ok ' || {NL} || '{invisible(FOREIGN_MARK)}' || ' tail'",
    13: f"'{invisible(BROKEN_MARK)}' || ' tail'",
    14: f"'x' || '{invisible(HIDDEN)}' || 'y'",
    15: f"'{invisible(OWN_MARK)}' || ' ' || '\u202e' || {NL} || '\u202e'",
    16: "'pаypal and αβc plus \U0001f600 bоρd'",
    17: f"{BS} || 'nпривет ' || {BS} || 'x41мир ' || {BS} || 'tpаy'",
    18: f"'value ' || (CASE {SECRET_TURN} {_SECRET_CASE} END) || ' end'",
    19: f"'password = \"changeme_now\"' || {NL} || 'api_key: ''' || {_DIGEST} || '''' || {NL}"
    f" || 'token = \"not a secret\"' || {NL} || 'DB_PASSWORD = \"hunter2hunter2\"' || {NL}"
    f" || 'secret' || {NL} || ' =' || {NL} || '  \"aaaaaaab\"' || {NL} || 'x-token=''abcdef'''",
    20: f"'p = \"aGVsbG8gd29ybGQhISEh\"' || {NL} || 'q = \"aGVsbG8gd29ybGQhISE=\"' || {NL}"
    f" || 'r = ' || {_DIGEST} || {_DIGEST}",
    21: f"'h = 68656c6c6f20776f726c6420676f6f6420' || '64617921' || {NL} || 'm = ' || {_DIGEST}",
    22: f"'x = 1' || {NL} || {NL} || {NL} || '  __author__ = \"me\"' || {NL} || '__credits__=''you''' || {NL}"
    f" || 'y = __maintainer__ = \"no\"'",
    23: "'nothing here'",
}

PLANTED_TEXT = (
    f"text || {NL} || CASE doc_id % 24 "
    + " ".join(f"WHEN {k} THEN {v}" for k, v in SUFFIXES.items())
    + " END"
)
# Line of the first character of the suffix.
SUFFIX_LINE = f"length(text) - length(replace(text, {NL}, '')) + 2"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The other tables of texts under the names the recipe uses.
SOURCES = {
    "documents": "SELECT doc_id, text FROM documents",
    "conversations": "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations",
    "pages": "SELECT page_id AS doc_id, html AS text FROM pages",
}


def planted(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """`(doc_id, path, encoding, text)`: every text of a table with its suffix."""
    columns = SOURCES[name].removeprefix("SELECT ").removesuffix(f" FROM {name}").split(", ")
    return (
        table(spark, folder, name)
        .select(*[F.expr(c) for c in columns])
        .select(
            "doc_id",
            F.expr("'docs/' || cast(doc_id as string) || '.txt'").alias("path"),
            F.lit("utf-8").alias("encoding"),
            F.expr(PLANTED_TEXT).alias("text"),
        )
    )


_KEY = "cast(o_orderkey as string)"
CODE = {
    0: f"'x = ' || {_KEY} || {NL} || 'print(x)'",
    1: f"'import requests, os' || {NL} || 'from urllib.parse import quote' || {NL} || 'import requests'"
    f" || {NL} || 'from . import socket' || {NL} || 'from .pickle import y' || {NL}",
    2: f"'requests.get(u)' || {NL} || 'd.get(k)' || {NL} || 'os.environ.get(k)' || {NL}"
    f" || 'urllib.request.urlopen(u)' || {NL} || 'foo().create_connection(a)' || {NL}",
    3: f"'os.system(c)' || {NL} || 'subprocess.run(c, shell=True)' || {NL} || 'subprocess.run(c)' || {NL}"
    f" || 'os.path.popen(1)' || {NL} || 'x.call(a, shell=0)' || {NL} || 'y()(1).check_call(a, shell=1)'",
    4: f"'exec(base64.b64decode(s))' || {NL} || 'if x:' || {NL} || '    eval(b.decode())'",
    5: f"'eval(x + ' || {_KEY} || ')'",
    6: f"'eval(\"1\")' || {NL} || 're.compile(p)' || {NL} || 'obj.eval(x)' || {NL} || 'compile()'"
    f" || {NL} || '__import__(\"os\")'",
    7: f"'x = (' || {_KEY}",
    8: f"'x = 1  # Author: No. ' || {_KEY} || {NL} || '# nothing' || {NL} || '# (c) 2020' || {NL}"
    f" || 's = \"# copyright\"'",
    9: f"'__author__ = \"n\"' || {NL} || '# created' || '\u200b' || ' by x' || {NL}"
    f" || '# written by ' || '\u200b' || 'me  '",
    10: f"repeat('requests.get(u)' || {NL}, 12) || 'http.a()' || {NL} || 'http.b()' || {NL}"
    f" || 'http.c()' || {NL} || 'http.d()' || {NL} || 'http.e()' || {NL} || 'http.f()'",
    11: f"'# author: lost' || {NL} || 'x = (' || {_KEY}",
}
CODE_TEXT = (
    "CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, v in CODE.items()) + " END"
)


def py_sources(spark: SparkSession, folder: str) -> DataFrame:
    """`(o_orderkey, path, encoding, text)`: one small Python source per order."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr(f"'src/' || {_KEY} || '.py'").alias("path"),
        F.lit("utf-8").alias("encoding"),
        F.expr(CODE_TEXT).alias("text"),
    )


# Where the program of an order lies in a tree: names that are kept, and ones that are not.
TREE_PATH = (
    f"'p' || cast(o_orderkey % 7 as string) || '/' || CASE o_orderkey % 9 WHEN 0 THEN 'd' || {_KEY} || '/__init__.py' "
    f"WHEN 1 THEN {_KEY} || '.h.py' WHEN 2 THEN {_KEY} || '.PYW' WHEN 3 THEN 'build/' || {_KEY} || '.py' "
    f"WHEN 4 THEN {_KEY} || '.txt' WHEN 5 THEN 'building/x.py.d/' || {_KEY} || '.py' "
    f"WHEN 6 THEN 'a/.git/b/' || {_KEY} || '.py' ELSE '_' || {_KEY} || '.py' END"
)
TREE_KEPT = "o_orderkey % 9 NOT IN (3, 4, 6)"
