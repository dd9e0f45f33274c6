"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds the ids of a run of documents, one after another, at two bytes an id where the
vocabulary allows it. Behind them stand two Elias-Fano sequences: the ids of the documents and
the boundaries between them. Each takes about two bits and the logarithm of the mean gap per
document, and gives any entry by a select on its upper bits, so a reader finds a document
without a table of 64-bit offsets.

Documents are range-partitioned by id, every partition writes one file, and the files follow
each other in ascending order. A task writes under a name of its own and reports it; a file of
a lost attempt is in no manifest and is never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm.rows import (
    LAST_LATIN,
    OTHER_BLANKS,
    SIGNS,
    Cache,
    column,
    latin_letters,
    per_worker,
    words_apart,
)

MAGIC = b"EFTOKEN1"
SAMPLE = 256
BLOCK_IDS = 1 << 20  # ids that a reader holds at a time
CACHED_CHARS = 16_000_000  # of the words that a worker remembers
SPACE_SIGN = "\u0120"  # how byte-level vocabularies write a space
TWO_BLANKS = re.compile(f"[{OTHER_BLANKS}]{{2}}")
# The step before the model that leaves a space and the letters behind it whole (fixed values).
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SEQUENCE = "<QqBQQ"
TRAILER = "<QQQB8s"


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    size: int
    base: int
    low_bits: int
    low: np.ndarray  # packed lower bits
    high: np.ndarray  # words of the unary coded upper parts
    samples: np.ndarray  # word of every SAMPLE-th set bit, and the set bits before that word

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            none = np.zeros(0, np.uint8)
            return cls(0, 0, 0, none, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint32))
        base = int(values[0])
        gaps = values.astype(np.uint64) - np.uint64(base % (1 << 64))
        low_bits = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        places = (gaps >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) >> 6) + 1, np.uint64)
        bits = np.uint64(1) << (places & 63).astype(np.uint64)
        np.bitwise_or.at(high, places >> 6, bits)
        lower = np.zeros((n, low_bits), np.uint8)
        for bit in range(low_bits):
            lower[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
        low = np.packbits(lower, bitorder="little")
        return cls(n, base, low_bits, low, high, cls._sampled(high, n))

    @staticmethod
    def _sampled(high: np.ndarray, n: int) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        words = np.searchsorted(before, np.arange(0, n, SAMPLE), side="right") - 1
        return np.stack([words, before[words]], axis=1).astype(np.uint32)

    def select(self, rank: int) -> int:
        """Place of the set bit with this rank, from 0."""
        word, seen = map(int, self.samples[rank // SAMPLE])
        while True:
            bits = int(self.high[word])
            here = bits.bit_count()
            if seen + here > rank:
                for _ in range(rank - seen):
                    bits &= bits - 1
                return word * 64 + (bits & -bits).bit_length() - 1
            seen += here
            word += 1

    def __getitem__(self, index: int) -> int:
        start = index * self.low_bits
        end = start + self.low_bits
        window = int.from_bytes(self.low[start >> 3 : (end + 7) >> 3].tobytes(), "little")
        low = window >> (start & 7) & ((1 << self.low_bits) - 1)
        return self.base + (self.select(index) - index << self.low_bits | low)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        if not self.size:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        upper = (places[: self.size] - np.arange(self.size)).astype(np.uint64)
        bits = np.unpackbits(self.low, count=self.size * self.low_bits, bitorder="little")
        lower = bits.reshape(self.size, self.low_bits)
        gaps = upper << np.uint64(self.low_bits)
        for bit in range(self.low_bits):
            gaps |= lower[:, bit].astype(np.uint64) << np.uint64(bit)
        return (gaps + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack(SEQUENCE, self.size, self.base, self.low_bits, len(self.low), len(self.high))
        high = self.high.astype("<u8").tobytes()
        return head + self.low.tobytes() + high + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, bytes]:
        """A sequence, and what stands behind it."""
        n, base, low_bits, n_low, n_high = struct.unpack_from(SEQUENCE, data)
        at = struct.calcsize(SEQUENCE)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + n_low)
        at += n_low + 8 * n_high
        rows = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", 2 * rows, at).reshape(rows, 2)
        return cls(n, base, low_bits, low, high, samples), data[at + 8 * rows :]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there, in any scheme that pyarrow knows."""
    return fs.FileSystem.from_uri(folder)


class TokenFile:
    """Reader of one file."""

    def __init__(self, folder: str, name: str):
        system, path = _opened(folder)
        self._file = system.open_input_file(f"{path}/{name}")
        end = self._file.size()
        last = struct.calcsize(TRAILER)
        tail = self._file.read_at(last, end - last)
        footer, self.n_docs, self.n_unnamed, self.width, magic = struct.unpack(TRAILER, tail)
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        data = self._file.read_at(footer, end - last - footer)
        self.names, rest = EliasFano.from_bytes(data)
        self.bounds, _ = EliasFano.from_bytes(rest)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids between two offsets."""
        data = self._file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, index: int) -> np.ndarray:
        """The ids of a document by its place in the file, found by select."""
        return self.ids(self.bounds[index], self.bounds[index + 1])

    def key(self, index: int) -> int | None:
        """The id of a document; the first `n_unnamed` have none."""
        return None if index < self.n_unnamed else self.names[index - self.n_unnamed]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, start, length and checksum of every document, a bounded block at a time."""
        bounds = self.bounds.values()
        keys = [None] * self.n_unnamed + self.names.values().tolist()
        first = 0
        while first < self.n_docs:
            last = int(np.searchsorted(bounds, bounds[first] + BLOCK_IDS, side="right")) - 1
            last = min(max(last, first + 1), self.n_docs)
            start = int(bounds[first])
            if last == first + 1:
                yield keys[first], start, int(bounds[last]) - start, self._checksum(start, int(bounds[last]))
            else:
                data = self.ids(start, int(bounds[last])).astype("<u4").tobytes()
                for i in range(first, last):
                    a, b = int(bounds[i]) - start, int(bounds[i + 1]) - start
                    yield keys[i], start + a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b])
            first = last

    def _checksum(self, start: int, end: int) -> int:
        crc = 0
        for at in range(start, end, BLOCK_IDS):
            crc = zlib.crc32(self.ids(at, min(at + BLOCK_IDS, end)).astype("<u4").tobytes(), crc)
        return crc


class TokenFileWriter:
    """Writer of one file; holds an id and a length per document, and streams the token ids."""

    def __init__(self, folder: str, name: str, width: int):
        self.name, self.width = name, width
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        self._file = system.open_output_stream(f"{path}/{name}")
        self.lengths: list[int] = []
        self.keys: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if key is not None:
            self.keys.append(key)
        self.lengths.append(len(ids))
        self._file.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> int:
        bounds = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        names = EliasFano.of(np.array(self.keys, np.int64))
        footer = names.to_bytes() + EliasFano.of(bounds).to_bytes()
        unnamed = len(self.lengths) - len(self.keys)
        self._file.write(footer)
        self._file.write(
            struct.pack(TRAILER, len(footer), len(self.lengths), unnamed, self.width, MAGIC)
        )
        self._file.close()
        return int(bounds[-1])


class LibraryEncoder:
    """Ids of texts as the tokenizers library gives them, words seen before looked up.

    The vocabulary splits before every space that stands alone, so where no two blanks meet
    the library may encode the words of a text one by one, or new ones in any order, beside
    each other. A token that begins with a space then begins a word. Where the steps before the
    model are known, words of Latin letters go to the library's model at once, and a line end that
    stands alone is a piece of its own.
    """

    def __init__(self, path: str):
        # One thread a task; Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [spec.get(x) for x in ("normalizer", "truncation", "padding", "pre_tokenizer")]
        self._usual = steps == [None, None, None, PRE_TOKENIZER]
        self._merge = self._library.model.tokenize
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self.n_ids = self._library.get_vocab_size(with_added_tokens=True)
        self._begins = np.zeros(self.n_ids, bool)
        for token, number in self._library.get_vocab(with_added_tokens=True).items():
            self._begins[number] = token.startswith(SPACE_SIGN)
        self._words = Cache(CACHED_CHARS)
        self._starts = Cache(CACHED_CHARS // 10)

    def _plain(self, text: str) -> np.ndarray:
        found = self._library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def _merged(self, word: str) -> bytes:
        """Ids of a word that the steps before the model leave whole."""
        ids = [token.id for token in self._merge(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters behind a space; None for others."""
        letters = latin_letters(word) if self._usual else None
        if letters is None:
            return None
        ids = self._words.values.get(word)
        if ids is None:
            ids = self._merged(SPACE_SIGN + letters)
            self._words.offer(word, ids)
        return ids

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each behind a space, from one call of the library."""
        if not words:
            return {}
        ids = self._plain(" " + " ".join(words))
        starts = np.flatnonzero(self._begins[ids]).tolist()
        if len(starts) != len(words):  # not a vocabulary whose tokens begin with the space
            return {word: self._plain(" " + word).tobytes() for word in words}
        data = ids.tobytes()
        ends = [*starts[1:], len(ids)]
        return {w: data[4 * a : 4 * b] for w, a, b in zip(words, starts, ends)}

    def _lines(self, word: str) -> list[str]:
        """What stands between the line ends of a word, if each is a piece of its own."""
        if "\n" not in word or not self._usual or TWO_BLANKS.search(word) or "\n" in (word[0], word[-1]):
            return [word]
        return word.split("\n")

    @staticmethod
    def _bare(word: str) -> str:
        """A word without its last signs, if they are a piece of their own."""
        # A sign behind a letter begins one, the same after any word.
        bare = word.rstrip(SIGNS)
        return bare if bare[-1:].isalpha() and bare[-1] <= LAST_LATIN else word

    def _found(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered, each behind a space."""
        known, offer = self._words.values.get, self._words.offer
        lines = {word: self._lines(word) for word in words if "\n" in word}
        plain = words.difference(lines).union(parts[0] for parts in lines.values())
        bare = {word: self._bare(word) for word in plain}
        found, others = {}, []
        for word in set(bare.values()):
            ids = self._letters(word) or known(word)
            if ids is None:
                others.append(word)
            else:
                found[word] = ids
        learned = self._learn(others)
        found.update(learned)
        for word, start in bare.items():
            if word != start:
                found[word] = ids = found[start] + self._alone(word[len(start) :])
                offer(word, ids)
        for word, ids in learned.items():
            offer(word, ids)
        for word, (first, *others) in lines.items():
            parts = [found[first]]
            for part in others:
                parts += self._alone("\n"), self._start(part)
            found[word] = b"".join(parts)
        return found

    def _alone(self, start: str) -> bytes:
        """Ids of a word without a space in front, or of signs."""
        ids = self._starts.values.get(start)
        if ids is None:
            letters = latin_letters(start) if self._usual else None
            ids = self._plain(start).tobytes() if letters is None else self._merged(letters)
            self._starts.offer(start, ids)
        return ids

    def _start(self, word: str) -> bytes:
        """Ids of a word without a space in front and with signs behind it."""
        bare = self._bare(word)
        return self._alone(word) if bare == word else self._alone(bare) + self._alone(word[len(bare) :])

    def encode(self, text: str) -> np.ndarray:
        if not words_apart(text) or any(s in text for s in self._special):
            return self._plain(text)
        first, *words = text.split(" ")
        parts = list(map(self._words.values.get, words))
        if None in parts:
            places = []
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = part = self._letters(words[i])
                    if part is None:
                        places.append(i)
            found = self._found({words[i] for i in places})
            for i in places:
                parts[i] = found[words[i]]
        return np.frombuffer(self._alone(first) + b"".join(parts), "<u4")


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of all texts below `folder`, in ascending order of the documents' ids.

    `path` is a file of the tokenizers library. Every document ends with `end_id`. An id takes
    two bytes, or four if the vocabulary is larger. Null texts are empty and have the end id alone. Documents without an id come first;
    documents with the same id stand side by side, in the order of a hash of their texts, and
    each is a document. Other columns are not read. An empty table gives no file.
    """
    width = 2 if max(LibraryEncoder(path).n_ids, end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    encoder = per_worker(f"library {path}", lambda: LibraryEncoder(path))
                    shard = TaskContext.get().partitionId()
                    file = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
                    writer = TokenFileWriter(folder, file, width)
                ids = encoder.encode(value.as_py() or "")
                writer.add(name.as_py(), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [writer.name], "n_docs": [len(writer.lengths)], "n_ids": [n]},
                schema=pa.schema(
                    [("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
                ),
            )

    rows = docs.select(column(key).cast("long").alias("key"), column(text).alias("text"))
    placed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = placed.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    schema = "shard int, file string, n_docs long, n_ids long"
    written = ordered.select("key", "text").mapInArrow(run, schema)
    written.write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """`(key, start, n_tokens, ids_crc32)` of every document, read back from the files.

    `start` counts the ids of all documents before. The files are known from the manifest and
    are read in parallel, a file a row; only the manifest's counts are summed in one place.
    """
    manifest = spark.read.schema("shard int, file string, n_docs long, n_ids long").parquet(
        f"{folder}/manifest"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(
        "shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with TokenFile(folder, name) as file:
                    rows = file.documents()
                    while part := [r for _, r in zip(range(50_000), rows)]:
                        keys, starts, lengths, checks = zip(*part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, pa.int64()),
                                pa.array([start + s for s in starts], pa.int64()),
                                pa.array(lengths, pa.int64()),
                                pa.array(checks, pa.int64()),
                            ],
                            [key, "start", "n_tokens", "ids_crc32"],
                        )

    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long"
    files = max(1, manifest.count())
    return placed.repartitionByRange(files, "shard").mapInArrow(run, schema)
