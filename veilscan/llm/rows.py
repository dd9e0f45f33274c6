"""Helpers shared by the operators: row functions over texts and stored tables."""

from __future__ import annotations

import string
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilscan.session import shared_folder

# What ends a word; the same six characters in every operator (fixed values).
WORD = r"[^\x20\x09-\x0D]+"


ENTRY_CHARS = 8  # what an entry of a cache counts beside its word

# Everything that some pattern or library takes for white space, without the space itself
# (fixed values).
OTHER_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
)

SIGNS = string.punctuation  # no letters, digits or white space in any pattern
LAST_LATIN = "\u024f"


def byte_signs() -> dict[int, str]:
    """The sign of every byte in byte-level vocabularies, as a table for `str.translate`."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_SIGNS = byte_signs()


def latin_letters(word: str) -> str | None:
    """A word of Latin letters alone as byte-level vocabularies write it; None for others.

    Patterns that split at what is no letter leave such a word whole.
    """
    if not word.isalpha():
        return None
    if word.isascii():
        return word
    return word.encode().decode("latin-1").translate(BYTE_SIGNS) if max(word) <= LAST_LATIN else None


def words_apart(text: str) -> bool:
    """Whether every space of a text stands between two characters that are not white space.

    Then each begins a new piece for tokenizers that put a space in front of a word, whatever
    else the text holds, and words can be encoded apart. Such texts also begin and end with a
    character that is not white space.
    """
    if not text or text[0] == " " or text[-1] == " " or "  " in text or text[-1] in OTHER_BLANKS:
        return False
    return not any(
        c in text and (c + " " in text or " " + c in text) for c in OTHER_BLANKS
    )


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder name below the shared scratch folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(table: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive an executor, and gives the optimizer the size.
    """
    folder = new_folder(table.sparkSession, purpose)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def per_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for all tasks it runs.

    Functions, and with them the globals of their modules, may reach a worker anew with each
    task; vocabularies and the caches beside them should not.
    """
    kept = sys.modules.setdefault("_veilscan_worker", types.ModuleType("_veilscan_worker"))
    if name not in kept.__dict__:
        kept.__dict__[name] = make()
    return kept.__dict__[name]


class Cache:
    """Values by word, within a bound on characters.

    Most words of a corpus come once in what a worker reads. With `twice`, a word is noted in
    a table by hash when it comes first, and takes room here when it comes again.
    """

    def __init__(self, most_chars: int, twice: bool = True):
        self.most_chars = most_chars
        self.twice = twice
        self.clear()

    def clear(self) -> None:
        self.values: dict[str, bytes] = {}
        self.chars = 0
        self._seen = bytearray(1 << 22 if self.twice else 0)

    def offer(self, word: str, value: bytes) -> None:
        """Keep a value, or only note its word."""
        place = hash(word) & 0x3FFFFF
        if not self.twice or self._seen[place]:
            if self.chars > self.most_chars:
                self.clear()
            self.values[word] = value
            self.chars += len(word) + ENTRY_CHARS
        else:
            self._seen[place] = 1


def fresh(frame: DataFrame, name: str) -> str:
    """`name`, or a longer form of it that no column of the frame has."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(
    frame: DataFrame,
    keys: Sequence[str],
    text: str,
    make: Callable[[], Callable[[str | None], tuple]],
    fields: str,
) -> DataFrame:
    """The key columns of every row beside what a function returns for its text.

    `make` runs once in each task and returns the function, so that vocabularies are loaded
    and caches are filled there. Rows are independent: nothing is shuffled, and a batch of
    results is all that a task holds.
    """
    source = frame.select(*[column(k) for k in keys], column(text))
    added = StructType.fromDDL(fields)
    schema = StructType([source.schema[k] for k in keys] + added.fields)
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(len(keys))
            found = zip(*[function(value.as_py()) for value in texts])
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(list(values)) for values in found], [*keys, *names]
            )

    return source.mapInArrow(run, schema)
