"""Byte-level BPE encoding and decoding, with a segment tree for the merges.

The bytes of a piece are the leaves of a segment tree. A leaf holds the rank of the pair that
begins at its byte, while a token begins there; a node holds the smallest rank below it, the
leftmost of equal ones. The root names the next merge. A merge changes three leaves at most:
the merged token's own pair, the pair of its left neighbour, and the start that is gone. Each
costs a walk to the root, so a piece of n bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import numpy as np
import regex
from pyspark.sql import DataFrame

from veilscan.llm.rows import Cache, map_texts, per_worker, words_apart

CACHED_CHARS = 10_000_000  # of the words, and of the pieces, that a worker remembers

NOTHING = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a `.tiktoken` file: a token in base64 and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class BytePairs:
    """Merges of byte pairs by rank; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self._base = max(self.tokens) + 1
        self._pairs: dict[int, int] = {}

    def _pair(self, left: int, right: int) -> int:
        """Rank of two neighbouring tokens, or NOTHING; remembered in `_pairs`."""
        rank = self.ranks.get(self.tokens[left] + self.tokens[right], NOTHING)
        if len(self._pairs) >= 600_000:
            self._pairs.clear()
        self._pairs[left * self._base + right] = rank
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [self.single[b] for b in piece]
        pair, known, base = self._pair, self._pairs.get, self._base
        single = self.single
        ids = [single[b] for b in piece]
        depth = (n - 1).bit_length()
        size, mask = 1 << depth, (1 << depth) - 1
        # A node is rank << depth | place, so that the smaller node is the leftmost of the
        # smallest rank.
        tree = [NOTHING] * (2 * size)
        for i in range(n - 1):
            left, right = ids[i], ids[i + 1]
            rank = known(left * base + right) or pair(left, right)
            if rank < NOTHING:
                tree[size + i] = rank << depth | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        if tree[1] == NOTHING:
            return ids
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))

        while (root := tree[1]) != NOTHING:
            place = root & mask
            ids[place] = merged = root >> depth
            gone = following[place]
            following[place] = after = following[gone]
            ids[gone] = -1
            changed = [(gone, NOTHING)]
            value = NOTHING
            if after < n:
                previous[after] = place
                right = ids[after]
                rank = known(merged * base + right) or pair(merged, right)
                if rank < NOTHING:
                    value = rank << depth | place
            changed.append((place, value))
            before = previous[place]
            if before >= 0:
                left = ids[before]
                rank = known(left * base + merged) or pair(left, merged)
                changed.append((before, rank << depth | before if rank < NOTHING else NOTHING))
            for leaf, value in changed:
                node = size + leaf
                if tree[node] == value:
                    continue
                tree[node] = value
                # Walk up until a node keeps its value.
                while node > 1:
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [i for i in ids if i >= 0]


class Encoder:
    """Texts to ids by a pattern for the pieces and ranks for the merges, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached_chars: int = CACHED_CHARS):
        self.pairs = BytePairs(ranks)
        self._split = regex.compile(pattern).findall
        self._words = Cache(cached_chars)
        self._pieces = Cache(cached_chars, twice=False)

    def _ids(self, text: str) -> bytes:
        out = []
        known = self._pieces.values.get
        for piece in self._split(text):
            ids = known(piece)
            if ids is None:
                numbers = self.pairs.encode_piece(piece.encode())
                ids = struct.pack(f"<{len(numbers)}I", *numbers)
                self._pieces.offer(piece, ids)
                known = self._pieces.values.get
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where every space stands alone it begins a piece, so words can be encoded one by one,
        and those seen before are looked up.
        """
        if not words_apart(text):
            return self._ids(text)
        first, *words = text.split(" ")
        parts = list(map(self._words.values.get, words))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = ids = self._ids(" " + words[i])
                    self._words.offer(words[i], ids)
        return self._ids(first) + b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.pairs.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str, cached_chars: int = CACHED_CHARS) -> Encoder:
    """The encoder of a rank file and a pattern, one in a worker."""
    name = f"ranks {path} {pattern} {cached_chars}"
    return per_worker(name, lambda: Encoder(read_ranks(path), pattern, cached_chars))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
    cached_chars: int = CACHED_CHARS,
) -> DataFrame:
    """`(key, ids, decoded)`: the ids of every text as an array, and the bytes they decode to.

    `cached_chars` bounds what a worker remembers; it changes the time, never the result.

    Null texts are empty: no ids, no bytes. Keys are passed through, null or repeated as they
    are; other columns are not read. An empty table gives an empty table. Texts of any length
    are encoded whole.
    """

    def make():
        coder = encoder(path, pattern, cached_chars)

        def one(value: str | None) -> tuple:
            ids = coder.encode(value or "")
            return np.frombuffer(ids, "<u4").astype(np.int32), coder.decode(ids)

        return one

    return map_texts(docs, [key], text, make, "ids array<int>, decoded binary")


def encoding_digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Like `encode_documents`, with digests in place of the ids and the bytes."""

    def make():
        coder = encoder(path, pattern)

        def one(value: str | None) -> tuple:
            ids = coder.encode(value or "")
            return (
                len(ids) // 4,
                hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(coder.decode(ids)).hexdigest(),
            )

        return one

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, [key], text, make, fields)
