"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts as one
state with a loop for every symbol. Each merge of `a` and `b` to `w` then adds its gadget: the
target of the arcs `a` is split, and the new state keeps all arcs but `b`, so that `a b` can no
longer be read; wherever `a b` could be read, an arc `w` now leads to the target of `b`.

All arcs of a label share their target at any time, and a gadget changes one arc of one label's
target. So a state is a label and the number of gadgets applied so far, a split takes no copy,
and an arc is there if the gadgets that it was copied through left it: the arcs `w` are copies
of the arcs `a`, and the target of `w` is a copy of the target of `b`, as they stood when `w`
was made. The table of transitions is filled from this when an entry is first used.

Of a word, every prefix has one sequence that the automaton reads at most, so a position has one
live state. The characters drive it through a trie of the labels: from a position, the labels
that begin there and that the table allows lead to the positions behind them, until one of them
is the end of the word.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from veilscan.llm.rows import LAST_LATIN, SIGNS, Cache, column, latin_letters, per_worker

CACHED_CHARS = 10_000_000  # of the words that a worker remembers
TABLE_ENTRIES = 2_000_000  # of the table of transitions that a worker keeps
BATCH_BYTES = 8 << 20  # of results that are passed on together
NEVER = 1 << 30
START = -1  # before the first label of a word
# Steps of the library that texts of common characters need not be given to (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BLANKS = "\t\n\x0b\x0c\r\x85\xa0"  # white space of the library up to LAST_LATIN, without the space
# Other than Latin letters, signs, quotes and dashes, which composing leaves as they are.
CHANGING = re.compile(f"[^\0-{LAST_LATIN}\u2010-\u2027]")


class TokenAutomaton:
    """States and arcs by label; a label is the number of a symbol or of a merged token."""

    def __init__(self, n_labels: int):
        self.n_labels = n_labels
        self._born = [-1] * n_labels  # the gadget that made a label; -1 for symbols
        self._parts = [(-1, -1)] * n_labels
        self._closed: dict[int, int] = {}  # (a, b) as one number: the gadget that took b from a
        self.table: dict[int, bool] = {}  # what `allows` found, by both labels as one number
        self._gadgets = 0

    def add_gadget(self, a: int, b: int, w: int) -> bool:
        """Apply the merge of `a` and `b` to `w`; False if `a b` can be read nowhere."""
        if self._born[w] >= 0:
            raise ValueError("a token that two merges make")
        step = self._gadgets
        self._gadgets += 1
        if not self._arc(a, b, step):
            return False
        self._born[w] = step
        self._parts[w] = (a, b)
        self._closed[a * self.n_labels + b] = step
        return True

    def _arc(self, u: int, t: int, step: int) -> bool:
        """Whether arc `t` leaves the target of `u` before gadget number `step`."""
        born, parts = self._born, self._parts
        while True:
            if self._closed.get(u * self.n_labels + t, NEVER) < step:
                return False
            if born[u] < 0 and born[t] < 0:
                return True
            if born[u] > born[t]:
                step, u = born[u], parts[u][1]
            else:
                # The target of `a` in the middle of `a a` had lost `a` when `aa` was made.
                step = born[t] + (parts[t] == (u, u))
                t = parts[t][0]

    def allows(self, u: int, t: int) -> bool:
        """Whether label `t` may follow label `u`, all gadgets applied."""
        entry = u * self.n_labels + t
        found = self.table.get(entry)
        if found is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            found = self.table[entry] = self._arc(u, t, NEVER)
        return found


class WordCoder:
    """Words to ids through the automaton of a vocabulary with word-end symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.labels = {i: token for token, i in vocabulary.items()}
        self.automaton = TokenAutomaton(max(self.labels, default=-1) + 1)
        merges = list(merges)
        made = {a + b for a, b in merges}
        usable = {token for token in vocabulary if token not in made}
        idle: set[str] = set()  # tokens that no sequence ever holds
        for a, b in merges:
            if any(part not in usable and part not in idle for part in (a, b)):
                raise ValueError("a merge of tokens that are not made yet")
            live = a in usable and b in usable
            numbers = vocabulary[a], vocabulary[b], vocabulary[a + b]
            (usable if live and self.automaton.add_gadget(*numbers) else idle).add(a + b)
        # A node: nodes by character, and the labels with their lengths on the way to it.
        self._root: tuple[dict, list] = ({}, [])
        self._closing = {t[: len(t) - len(suffix)]: vocabulary[t] for t in usable if t.endswith(suffix)}
        inside = [t for t in usable if t and not (suffix and t.endswith(suffix))]
        for token in sorted(inside, key=len):
            node = self._root
            for ch in token:
                # Short tokens come first, so what lies before a new node is complete.
                node = node[0].get(ch) or node[0].setdefault(ch, ({}, node[1][:]))
            node[1].append((vocabulary[token], len(token)))
        self._longest = max(map(len, inside), default=0)
        self._longest_closing = max(map(len, self._closing), default=0)

    def encode(self, word: str) -> list[int]:
        """Ids of one word, which must not be empty.

        A position is reached by one sequence at most, so the walk, long labels first, comes to
        each position once, whatever it has to take back.
        """
        whole = self._closing.get(word)
        if whole is not None:
            return [whole]
        closing, allows = self._closing.get, self.automaton.allows
        root, longest, last = self._root, self._longest, len(word) - 1
        may_close = len(word) - self._longest_closing
        known, n_labels = self.automaton.table.get, self.automaton.n_labels
        ids: list[int] = []
        left: list[tuple[int, list, int]] = []  # where a label was taken, and how many are untried
        i, before = 0, START
        while True:
            if i >= may_close:
                t = closing(word[i:])
                if t is not None and (i == 0 or allows(before, t)):
                    ids.append(t)
                    return ids
            below, options = root
            for ch in word[i : min(i + longest, last)]:
                node = below.get(ch)
                if node is None:
                    break
                below, options = node
            untried = len(options)
            while True:
                if not untried:
                    if not ids:
                        raise ValueError("a word with a character that the vocabulary does not have")
                    ids.pop()
                    before = ids[-1] if ids else START
                    i, options, untried = left.pop()
                    continue
                untried -= 1
                t, size = options[untried]
                if before == START:
                    break
                allowed = known(before * n_labels + t)
                if allowed or allowed is None and allows(before, t):
                    break
            left.append((i, options, untried))
            ids.append(t)
            before = t
            i += size


class Coder:
    """Texts to ids and back, by a tokenizer file of the tokenizers library.

    The library normalises texts and splits them into words; truncation, padding and tokens
    added around a text are not used. Special tokens are recognised in texts.
    """

    def __init__(self, path: str, cached_chars: int = CACHED_CHARS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        unusual = ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "unk_token")
        added = spec["added_tokens"]
        if model["type"] != "BPE" or any(model.get(x) for x in unusual) or spec["decoder"]:
            raise ValueError("a BPE model without fallbacks and without a decoder is needed")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens with conditions are not supported")
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.words = WordCoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self._special = {t["content"]: t["id"] for t in added}
        self.labels = self.words.labels | {i: token for token, i in self._special.items()}
        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self._usual = (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        longest_first = sorted(map(re.escape, self._special), key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(longest_first) + ")") if added else None
        self._known = Cache(cached_chars, twice=False)

    def _chunks(self, text: str) -> list[str]:
        """The normalised text, split at spaces."""
        if not self._usual or not text.isascii() and CHANGING.search(text):
            return self._normalize(text).split(" ")
        text = text.lower()
        for blank in BLANKS:
            if blank in text:
                text = text.replace(blank, " ")
        return text.split(" ")

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces."""
        ids = self._known.values.get(chunk)
        if ids is not None:
            return ids
        word = latin_letters(chunk) if self._usual else None
        if word is not None:
            found = self.words.encode(word)
        else:
            bare = chunk.rstrip(SIGNS) if self._usual else chunk
            if bare != chunk and bare[-1:].isalpha() and bare[-1] <= LAST_LATIN:
                # A sign behind a letter begins a piece of its own, the same after any word.
                ids = self._chunk(bare) + self._chunk(chunk[len(bare) :])
                self._known.offer(chunk, ids)
                return ids
            found = [i for piece, _ in self._split(chunk) for i in self.words.encode(piece)]
        ids = struct.pack(f"<{len(found)}I", *found)
        self._known.offer(chunk, ids)
        return ids

    def _plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens; no word holds a space."""
        chunks = self._chunks(text)
        parts = list(map(self._known.values.get, chunks))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self._chunk(chunks[i])
        return parts

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self._marks.split(text) if self._marks and self._marks.search(text) else [text]
        out = []
        for part in parts:
            if part in self._special:
                out.append(np.array([self._special[part]], "<u4").tobytes())
            elif part:
                out.extend(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs that ids name, with a space between them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, cached_chars: int = CACHED_CHARS) -> Coder:
    """The coder of a tokenizer file, one in a worker."""
    return per_worker(f"automaton {path} {cached_chars}", lambda: Coder(path, cached_chars))


def _results(keys: list[pa.Array], ids: list[bytes], decoded: list[str], names: list[str]) -> pa.RecordBatch:
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
    numbers = pa.ListArray.from_arrays(pa.array(places), flat)
    return pa.RecordBatch.from_arrays([*keys, numbers, pa.array(decoded, pa.string())], names)


def encode_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", cached_chars: int = CACHED_CHARS
) -> DataFrame:
    """`(key, ids, decoded)`: the ids of every text, and the text that the ids decode to.

    Null texts are empty: no ids, an empty text. Keys are passed through, null or repeated as
    they are; other columns are not read. An empty table gives an empty table. Texts of any
    length are encoded whole. `cached_chars` changes the time, never the result. Rows are
    independent, so nothing is shuffled; results leave a task in batches of some bytes.
    """
    source = docs.select(column(key), column(text))
    schema = StructType([source.schema[0], *StructType.fromDDL("ids array<int>, decoded string").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path, cached_chars)
        for batch in batches:
            ids, decoded, begin, held = [], [], 0, 0
            for i, value in enumerate(batch.column(1)):
                ids.append(words.encode(value.as_py() or ""))
                decoded.append(words.decode(ids[-1]))
                held += len(ids[-1]) + len(decoded[-1])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    keys = [batch.column(0).slice(begin, len(ids))]
                    yield _results(keys, ids, decoded, names)
                    ids, decoded, begin, held = [], [], i + 1, 0

    return source.mapInArrow(run, schema)
