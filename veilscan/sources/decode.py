"""From raw bytes to text: the encoding chain.

Valid UTF-8 (with or without a byte order mark) is decoded by Spark itself. Only the rest goes
to an Arrow UDF, which tries the remaining encodings with Python's strict codecs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Encodings tried, in this order, on bytes that are not valid UTF-8.
FALLBACK_ENCODINGS = ["utf-16", "cp1251", "latin-1"]
UTF8_MARK = b"\xef\xbb\xbf"

_DECODED = pa.struct([("text", pa.string()), ("encoding", pa.string())])


def _strictly(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _fallback(contents: pa.Array) -> pa.Array:
    def decode(data: bytes | None) -> dict | None:
        if data is None:
            return None
        tried = ((_strictly(data, encoding), encoding) for encoding in FALLBACK_ENCODINGS)
        text, encoding = next(pair for pair in tried if pair[0] is not None)
        return {"text": text, "encoding": encoding}

    return pa.array([decode(c.as_py()) for c in contents], type=_DECODED)


def _utf8(content: Column) -> Column:
    return F.try_validate_utf8(content.cast("string"))


def decode_sources(raw: DataFrame, content: str = "content") -> DataFrame:
    """Replace the binary column by `text` and `encoding`; NULL bytes give `?` and no text."""
    body = F.col(content)
    marked = F.coalesce(F.substring(body, 1, 3) == F.lit(bytearray(UTF8_MARK)), F.lit(False))
    rest = F.expr(f"substring(`{content}`, 4)")
    fallback = F.arrow_udf(_fallback, "struct<text:string,encoding:string>")
    others = [c for c in raw.columns if c != content]
    return (
        raw.withColumn("_utf8", F.when(marked, _utf8(rest)).otherwise(_utf8(body)))
        .withColumn("_other", fallback(F.when(F.col("_utf8").isNull(), body)))
        .select(
            *others,
            F.when(body.isNull(), "?")
            .when(F.col("_utf8").isNull(), F.col("_other.encoding"))
            .when(marked, "utf-8-sig")
            .otherwise("utf-8")
            .alias("encoding"),
            F.coalesce("_utf8", "_other.text").alias("text"),
        )
    )
