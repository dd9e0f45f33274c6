"""Compression bands: zstandard ratios of whole documents and of fixed chunks.

A ratio is compressed bytes by raw bytes. Repetitive text falls below the band of its length,
random or encoded bytes rise above it. Short texts compress worse, so every length has limits
of its own. The upper limits lie between the largest ratios measured of texts in some 200
languages (message catalogues, lists of names among them) and the least of random bytes as
base64 or as alphanumeric words: at 4,096 bytes 0.65 and 0.73, at 2,048 bytes 0.71 and 0.74.
At 1,024 bytes lists of Chinese names reach 0.83 and base64 has 0.80: from there to 1,535 bytes
only base64 is above the limit, with the densest such lists; shorter texts cannot be told apart.
Hexadecimal digits (0.52) and encoded lines scattered in prose compress like prose.

These fixed limits know no corpus, so they are wide. Inside them, the corpus sets a band of its
own for every length class, half an octave of bytes, and every share of non-ASCII bytes: the
median ratio of its documents, and so many robust deviations on both sides. Both come from exact
histograms over all documents that pass the other rules.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.rows import column, map_texts, stored

SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
WIDE = bytes(range(128, 256))


@dataclass(frozen=True)
class Bands:
    """Limits by length; a text of at least `from_bytes[i]` bytes has `low[i]` and `high[i]`."""

    from_bytes: tuple[int, ...] = (0, 128, 512, 1024, 1536, 2048, 4096, 8192, 32768)
    low: tuple[float, ...] = (0.40, 0.35, 0.30, 0.30, 0.30, 0.27, 0.27, 0.24, 0.20)
    high: tuple[float, ...] = (2.00, 1.00, 0.85, 0.78, 0.74, 0.73, 0.69, 0.65, 0.62)
    chunk_bytes: int = 4096
    chunk_low: float = 0.22
    chunk_high: float = 0.69
    least_chunk_bytes: int = 512  # a shorter rest belongs to the chunk before it
    most_bad_chunks: float = 0.2
    level: int = 3
    per_octave: int = 2  # length classes
    wide_shares: tuple[float, ...] = (0.02, 0.15, 0.4)  # of non-ASCII bytes, between classes
    most_spread: float = 4.5  # robust standard deviations from the median of a class
    least_spread: float = 0.01  # of the median, that a deviation is at least
    least_documents: int = 100  # a smaller class has no band of its own

    def place(self, size: int, n_wide: int) -> int:
        """The class of a text with so many bytes and non-ASCII bytes; at most some hundreds."""
        octave = int(np.log2(size) * self.per_octave) if size else 0
        share = bisect_right(self.wide_shares, n_wide / size) if size else 0
        return octave * (len(self.wide_shares) + 1) + share

    def limits(self, size: int) -> tuple[float, float]:
        band = bisect_right(self.from_bytes, size) - 1
        return self.low[band], self.high[band]


DEFAULT_BANDS = Bands()

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, "
    "n_low_chunks long, n_high_chunks long, band long"
)
BINS = 2000  # of a histogram, for each unit of the ratio


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that are found more than once, each word once."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window = ids[:count]
    for shift in range(1, width):
        # Renumbering keeps the keys below count * count, far from overflow.
        pair = window * len(numbers) + ids[shift : shift + count]
        window = np.unique(pair, return_inverse=True)[1] if shift < width - 1 else pair
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(width):
        covered[shift : shift + count] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(BLANK_BYTES):
            seen.add(line)
    return repeats


def judge(bands: Bands = DEFAULT_BANDS):
    """A function from a text to the values of `FIELDS`; `kept` is by the fixed limits alone."""
    compressor = zstandard.ZstdCompressor(level=bands.level)

    def chunk_counts(data: bytes) -> tuple[int, int, int]:
        """Of texts from one chunk on; a rest is the last chunk, with the limits of its length."""
        low = high = total = start = 0
        while start < len(data) and len(data) >= bands.chunk_bytes:
            end = start + bands.chunk_bytes
            if len(data) - end < bands.least_chunk_bytes:
                end = len(data)
            piece = data[start:end]
            least, most = bands.chunk_low, bands.chunk_high
            if len(piece) < bands.chunk_bytes:
                least, most = bands.limits(len(piece))
            ratio = len(compressor.compress(piece)) / len(piece)
            total += 1
            low += ratio < least
            high += ratio > most
            start = end
        return total, low, high

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        words = data.split()
        n_words = len(words)
        blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
        repeats = repeated_words(words)
        base_failed = n_words < 50 or 100 * repeats > 50 * n_words
        ratio = len(compressor.compress(data)) / len(data) if data else None
        chunks, low, high = chunk_counts(data)
        kept = False
        if not base_failed:
            least, most = bands.limits(len(data))
            kept = least <= ratio <= most and low + high <= bands.most_bad_chunks * chunks
        return (
            n_words, len(text or "") - blanks, symbols, repeated_lines(data), repeats,
            base_failed, kept, len(data), ratio, chunks, low, high,
            bands.place(len(data), len(data) - len(data.translate(None, WIDE))),
        )

    return one


def _median(histogram: DataFrame, value: str) -> DataFrame:
    """`(band, n, median)` of exact counts: the lower median of every band."""
    order = Window.partitionBy("band").orderBy(value)
    summed = histogram.select(
        "band", value, F.sum("count").over(order).alias("upto"),
        F.sum("count").over(Window.partitionBy("band")).alias("n"),
    )
    return summed.where(F.col("upto") * 2 >= F.col("n")).groupBy("band").agg(
        F.first("n").alias("n"), F.min(value).alias("median")
    )


def corpus_bands(measured: DataFrame, bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """`(band, least_bin, most_bin)`: the ratios, in bins, that the corpus has in every class.

    A band has as many rows in its histogram as there are bins of ratios, so nothing here grows
    with the corpus but the counts.
    """
    counted = measured.where("kept").groupBy("band", ratio_bin(F.col("ratio")).alias("bin")).count()
    counted = stored(counted, "ratio-histogram")
    middle = _median(counted, "bin")
    far = counted.join(middle.select("band", "median"), "band").groupBy(
        "band", F.abs(F.col("bin") - F.col("median")).alias("far")
    ).agg(F.sum("count").alias("count"))
    spread = F.greatest(
        F.lit(1.4826) * F.col("away"), F.lit(bands.least_spread) * F.col("median")
    ) * F.lit(bands.most_spread)
    away = _median(far, "far").select("band", F.col("median").alias("away"))
    return middle.where(F.col("n") >= bands.least_documents).join(away, "band").select(
        "band", (F.col("median") - spread).alias("least_bin"), (F.col("median") + spread).alias("most_bin")
    )


def ratio_bin(ratio: Column) -> Column:
    return F.floor(ratio * BINS)


def compression_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = DEFAULT_BANDS
) -> DataFrame:
    """One row per row of `docs`: its id, the base counts, the ratios and the verdict.

    `base_failed` holds for fewer than 50 words, or if more than half of the words lie in
    three-word windows that the text repeats. `kept` asks for the base rules, a ratio of the
    whole text within the fixed limits of its length, no more than `most_bad_chunks` of its
    chunks outside their limits, and a ratio within the band that the corpus has for its class
    (`band`, see `Bands.place`). Classes with few documents have fixed limits only. Every byte
    is in a chunk, but a text shorter than a chunk has none.

    Null and empty texts have no words, no ratio, and fail. Ids are passed through, null or
    repeated as they are; equal texts get equal verdicts, and reruns agree. An empty table gives
    an empty table. The work on a text grows in proportion to its length times its logarithm;
    texts are read once, and only their measures are stored.
    """
    measured = stored(map_texts(docs, [key], text, lambda: judge(bands), FIELDS), "ratios")
    own = corpus_bands(measured, bands).withColumnRenamed("band", "_band")
    place = ratio_bin(F.col("ratio"))
    usual = F.col("_band").isNull() | place.between(F.col("least_bin"), F.col("most_bin"))
    joined = measured.join(F.broadcast(own), F.col("band") == F.col("_band"), "left")
    names = [key, *(f.split()[0] for f in FIELDS.split(", "))]
    return joined.select(
        *[(F.col("kept") & usual).alias(n) if n == "kept" else column(n) for n in names]
    )
