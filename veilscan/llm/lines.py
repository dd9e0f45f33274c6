"""Line deduplication over a whole corpus, with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; a hash that enough documents
hold loses its lines everywhere but in the smallest document that holds it. Only 16-byte hashes,
ids and positions are shuffled for that. A line that a third of all documents share is counted
per (hash, document) first and then per hash, so no task sees more than partial counts of it;
the shared hashes are stored before lines are joined to them, so that adaptive execution can
split the lines of such a hash over many tasks. A document is put together again from the
positions that it keeps, in a time that grows with its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.matching import let
from veilscan.llm.rows import column, fresh, stored

# Stripped from both ends of a line (fixed values): space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Both branches give the same; the first is far cheaper where all characters are ASCII.
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hash(key: Column) -> Column:
    """16 bytes of MD5; never null, so that joins add no filter that hashes once more."""
    return F.coalesce(F.unhex(F.md5(key.cast("binary"))), F.lit(b""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    """Tells the texts of rows that repeat an id apart."""
    return _hash(F.coalesce(text, F.lit("")))


def lost_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """`(id, digest, at)`: a row for each position, from 0, that a text has to give up."""
    # The digest comes before the lines are exploded, or it would be taken once for each of them.
    held = (
        docs.select(
            column(key).alias("id"),
            _digest(column(text)).alias("digest"),
            _lines(column(text)).alias("lines"),
        )
        .select("id", "digest", F.posexplode("lines").alias("at", "line"))
        .where(F.length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
        .select("id", "digest", "at", _hash(line_key(F.col("line"))).alias("hash"))
    )
    shared = (
        held.select("id", "hash")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select(F.col("hash").alias("shared_hash"), "keeper")
    )
    shared = stored(shared, "shared-lines")
    return (
        held.join(shared, F.col("hash") == F.col("shared_hash"))
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .select("id", "digest", "at")
    )


def repeated_lines(docs: DataFrame, **options: object) -> DataFrame:
    """`(id, digest, at)`: the positions, ascending, that a text has to give up; a row a text.

    A group is one text, so it is as large as that text at most. Rows that repeat an id and a
    text share it. Stored, so that the join of the texts to it may be split as well.
    """
    positions = F.array_sort(F.collect_set("at")).alias("at")
    return stored(lost_lines(docs, **options).groupBy("id", "digest").agg(positions), "lost-lines")


def _without(lines: Column, gone: Column) -> Column:
    """An array without the entries at some positions; the positions are told apart by hashing."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(kept, lambda i: F.get(lines, i))


def drop_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """The rows of `docs` with repeated lines taken out of their texts.

    All columns stay; `n_lines` (before) and `n_dropped` are added under names that the caller
    may choose. Lines end at \\n. Lines whose key has fewer than `min_chars` code points stay.
    A line that is in at least `min_docs` documents stays only in the smallest id that holds
    it, with all its repeats there.

    Null and empty texts are one empty line and become ''. Rows with the same id are one
    document; rows without an id are together one document, and never the smallest beside
    others. An empty table gives an empty table.
    """
    given, told, lost = fresh(docs, "_given"), fresh(docs, "_told"), fresh(docs, "_lost")
    options = {"key": key, "text": text, "min_chars": min_chars, "min_docs": min_docs}
    gone = repeated_lines(docs, **options).select(
        F.col("id").alias(given), F.col("digest").alias(told), F.col("at").alias(lost)
    )
    body = column(text)
    same = column(key).eqNullSafe(column(given)) & (_digest(body) == column(told))
    joined = docs.join(gone, same, "left")
    kept = let(
        _lines(body), lambda lines: F.array_join(_without(lines, column(lost)), "\n")
    )
    whole = F.when(column(lost).isNull(), F.coalesce(body, F.lit(""))).otherwise(kept)
    columns = [whole.alias(c) if c == text else column(c) for c in docs.columns]
    return joined.select(
        *columns,
        F.size(_lines(body)).cast("long").alias(n_lines),
        F.when(column(lost).isNull(), 0).otherwise(F.size(column(lost))).cast("long").alias(n_dropped),
    )
