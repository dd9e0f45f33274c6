"""Fill-in-middle examples, cut at token boundaries that a compressed set answers for.

The boundaries of a text, the offsets behind its tokens, go to a set of containers by their
upper 16 bits. A container keeps the lower 16 bits in the smallest of three forms: sorted array,
bitmap, or runs. `select(k)` finds the container by the cumulative cardinalities and the
boundary inside it by a rule of its form, so both cuts of a text come from one structure that
takes little room for prose (arrays), for scripts whose every character is a token (runs), and
for what lies between (bitmaps).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.rows import column, fresh

CONTAINER_BITS = 16
SPAN = 1 << CONTAINER_BITS
BLOCK_CHARS = 1 << 20  # code points that are looked at together

# The sentinels of the output, and the shares of its forms in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"

_CUTS = "n long, form string, prefix_chars long, middle_chars long"


class ArrayContainer:
    """Sorted lower halves; position k is the k-th boundary."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)
        self.n_bytes = self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])


class RunContainer:
    """First value and length of every run, with the number of values before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = (np.cumsum(lengths) - lengths).astype(np.uint16)
        self.n_bytes = 2 * self.starts.nbytes

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BitmapContainer:
    """A bit for every lower half; words are ranked, bits are counted inside one word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.n_bytes = self.words.nbytes

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(upto, k, side="right"))
        rest = k - (int(upto[word - 1]) if word else 0)
        value = int(self.words[word])
        for _ in range(rest):
            value &= value - 1  # drop the lowest bit
        return 64 * word + (value & -value).bit_length() - 1


def container(low: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest form of sorted lower halves."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(low), SPAN // 8):
        return RunContainer(low[first], np.diff(first, append=len(low)))
    return ArrayContainer(low) if 2 * len(low) <= SPAN // 8 else BitmapContainer(low)


class BoundarySet:
    """A growing set of ascending offsets with a select function."""

    def __init__(self):
        self.keys: list[int] = []
        self.containers: list[ArrayContainer | RunContainer | BitmapContainer] = []
        self.upto: list[int] = []  # cumulative cardinalities
        self._open: list[np.ndarray] = []  # of the last key, which may still grow
        self._key = -1

    def add(self, offsets: np.ndarray) -> None:
        """Add offsets that are larger than all before them."""
        if not len(offsets):
            return
        keys = offsets >> CONTAINER_BITS
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(offsets, cuts):
            key = int(part[0]) >> CONTAINER_BITS
            if key != self._key:
                self.close()
                self._key = key
            self._open.append(part & (SPAN - 1))

    def close(self) -> None:
        """Seal the last container."""
        if self._open:
            low = np.concatenate(self._open)
            self._open = []
            self.keys.append(self._key)
            self.containers.append(container(low))
            self.upto.append((self.upto[-1] if self.upto else 0) + len(low))

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        local = k - (self.upto[at - 1] if at else 0)
        return (self.keys[at] << CONTAINER_BITS) + self.containers[at].select(local)

    @property
    def n_bytes(self) -> int:
        return sum(c.n_bytes for c in self.containers)


def boundaries(text: str) -> BoundarySet:
    """Offsets behind the tokens of a text: runs of ASCII letters, and single other characters."""
    found = BoundarySet()
    for start in range(0, len(text), BLOCK_CHARS):
        # One character more, to see whether a run of letters goes on behind the block.
        piece = text[start : start + BLOCK_CHARS + 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = ((codes | 0x20) - np.uint32(ord("a"))) < 26
        inside = letters[:-1] & letters[1:]
        ends = ~inside if len(piece) > BLOCK_CHARS else np.append(~inside, True)
        found.add(np.flatnonzero(ends) + (start + 1))
    found.close()
    return found


def draws(key: object, seed: str = SEED) -> list[int]:
    """Four numbers of a document, from the digest of the seed and its id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cuts(text: str, key: object, seed: str = SEED) -> tuple[int, str, int | None, int | None]:
    """Number of tokens, form, and the lengths of prefix and middle (None if plain)."""
    tokens = boundaries(text)
    n = len(tokens)
    h1, h2, h3, h4 = draws(key, seed)
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, end = (tokens.select(k - 1) if k else 0 for k in (first, second))
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", begin, end - begin


def _cut(seed: str):
    schema = pa.struct(
        [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    )

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            found = [cuts(t.as_py() or "", k.as_py(), seed) for k, t in zip(keys, texts)]
            columns = list(zip(*found)) if found else [()] * 4
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema)
            )

    return F.arrow_udf(run, _CUTS)


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED
) -> DataFrame:
    """`(key, n, form, prefix_chars, middle_chars, output)`, a row for every row of `docs`.

    A null text counts as empty; empty texts and texts that hold a sentinel stay as they are
    (`plain`). A null id draws by the seed alone, and rows that repeat an id and a text get the
    same example. Other columns are neither read nor returned. An empty table gives an empty
    table. Texts of any length are cut whole; only the cuts come from Python, the output is put
    together by Spark. Rows are independent, so nothing is shuffled.
    """
    cut = fresh(docs.select(column(key)), "_cut")
    body = F.coalesce(column(text), F.lit("")).alias("_text")
    source = docs.select(column(key).alias("_key"), body)
    found = source.withColumn(cut, _cut(seed)("_key", "_text")).select("_key", "_text", f"{cut}.*")
    begin, size = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix = F.substring("_text", F.lit(1), begin)
    middle = F.substring("_text", begin + 1, size)
    suffix = F.expr("substring(_text, cast(prefix_chars + middle_chars as int) + 1)")
    output = (
        F.when(F.col("form") == "plain", F.col("_text"))
        .when(
            F.col("form") == "psm",
            F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle),
        )
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return found.select(
        F.col("_key").alias(key), "n", "form", "prefix_chars", "middle_chars", output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; sentinels stand only where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first, middle, second))
        .otherwise(F.concat(second, middle, first))
    )
