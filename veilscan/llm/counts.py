"""Token counts by a deterministic transducer compiled from a merge vocabulary.

The tokens of a prefix determine those of the next one: the last token of a longer prefix
begins where some earlier prefix ends, and it is the one token that may follow that prefix's
last token, where "may follow" means that the two, put together, are encoded as the two. A
state therefore holds, for every place from which a token can still grow to the present one,
the node of the vocabulary trie reached from it, the last token before it, and how many tokens
there were. These are finitely many; they are compiled when first needed. A transition reads
one character and carries the number of tokens it emits, which is negative where characters
join tokens that were counted apart.

Chunks of a text become maps from the state before to the state after and a count, and the
maps of all chunks are composed in pairs, one after the other in the task that holds the text:
a serial reduction, without results for prefixes. A map is constant behind the first
place where no token can cross, so it is kept as the characters up to there, and the state and
count behind.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from veilscan.llm.rows import map_texts, per_worker

SPACE = "▁"
CHUNK_CHARS = 1 << 16
MOST_STATES = 250_000  # kept at a time in a worker
CACHED_WORDS = 800_000
CACHED_CHARS = 48

START = 0
UNKNOWN = ""

_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_CROSSING = re.compile(f"(?<=[^{SPACE}]){SPACE}")


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to a state: read `head`, then, if `state` is set, be there.

    `count` is the number of tokens emitted behind the head. The state is kept by its content,
    since its number is lost when the compiled states are forgotten.
    """

    head: str
    state: tuple | None = None
    count: int = 0


class Transducer:
    """Merges by score, leftmost first among equals, over the characters of a text."""

    def __init__(self, scores: dict[str, float], prefix: bool = True, byte_fallback: bool = True):
        self.scores = scores
        self.prefix = prefix
        self.byte_fallback = byte_fallback
        self.longest = max(map(len, scores))
        # Whether a space sign always begins a token, whatever stands before it.
        self.splits = not any(_CROSSING.search(piece) for piece in scores)
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for piece in scores:
            node = 0
            for c in piece:
                child = self.trie[node].get(c)
                if child is None:
                    child = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                node = child
            self.piece[node] = piece
        self._follows: dict[tuple[str, str], bool] = {}
        self._words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, UNKNOWN, 0),)
        self._states: list[tuple] = [start]
        self._numbers: dict[tuple, int] = {start: START}
        self._next: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, as the vocabulary defines it."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether `right` can be the token after `left`."""
        if left is UNKNOWN:
            return True
        key = (left, right)
        found = self._follows.get(key)
        if found is None:
            if len(self._follows) >= 600_000:
                self._follows.clear()
            found = self._follows[key] = self.merged(left + right) == [left, right]
        return found

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state by a character: the next state and the emitted tokens."""
        live = self._states[state]
        grown = []
        token, emitted = None, 0
        for node, last, count in live:
            child = self.trie[node].get(c)
            if child is None:
                continue
            piece = self.piece[child]
            if token is None and piece is not None and self.follows(last, piece):
                token, emitted = piece, count + 1
            if self.trie[child]:
                grown.append((child, last, count))
        if token is None:
            # A character of no piece: its bytes, or one unknown token.
            token, grown = UNKNOWN, []
            emitted = len(c.encode()) if self.byte_fallback else 1
        following = tuple((node, last, count - emitted) for node, last, count in grown)
        number = self._number((*following, (0, token, 0)))
        self._next[state][c] = number, emitted
        return number, emitted

    def _number(self, state: tuple) -> int:
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._next.append({})
        return number

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after a text, and the tokens emitted on the way."""
        following = self._next
        total = 0
        for c in text:
            step = following[state].get(c)
            if step is None:
                step = self._compile(state, c)
            state, emitted = step
            total += emitted
        return state, total

    def word(self, segment: str) -> int:
        """Tokens of a segment whose ends no token crosses."""
        count = self._words.get(segment)
        if count is None:
            if len(self._states) >= MOST_STATES:
                self._forget()
            count = self.run(START, segment)[1]
            if len(segment) <= CACHED_CHARS:
                if len(self._words) >= CACHED_WORDS:
                    self._words.clear()
                self._words[segment] = count
        return count

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk of text with space signs."""
        first = _CROSSING.search(chunk) if self.splits else None
        if first is None:
            return ChunkMap(chunk)
        head, rest = chunk[: first.start()], chunk[first.start() :]
        if SPACE + SPACE in rest:
            segments = _SEGMENT.findall(rest)
        else:
            segments = [SPACE + word for word in rest.split(SPACE)[1:]]
        known = self._words.get
        count = 0
        for segment in segments[:-1]:
            found = known(segment)
            count += self.word(segment) if found is None else found
        state, emitted = self.run(START, segments[-1])
        return ChunkMap(head, self._states[state], count + emitted)

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        if left.state is None:
            return ChunkMap(left.head + right.head, right.state, right.count)
        state, emitted = self.run(self._number(left.state), right.head)
        count = left.count + emitted
        if right.state is None:
            return ChunkMap(left.head, self._states[state], count)
        return ChunkMap(left.head, right.state, count + right.count)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        written = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        maps = [
            self.chunk_map(written[i : i + chunk_chars])
            for i in range(0, len(written), chunk_chars)
        ]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        whole = maps[0]
        return self.run(START, whole.head)[1] + whole.count


def compile_model(path: str) -> Transducer:
    """The transducer of a SentencePiece BPE model that leaves texts as they are."""
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    rules, trained = model.normalizer_spec, model.trainer_spec
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = (
        trained.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        and not rules.precompiled_charsmap
        and not rules.remove_extra_whitespaces
        and rules.escape_whitespaces
        and not trained.treat_whitespace_as_suffix
        and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
    )
    if not plain:
        raise ValueError(f"{path}: not a BPE model without normalisation")
    scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    return Transducer(scores, rules.add_dummy_prefix, trained.byte_fallback)


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: its id, bytes, tokens, and whether those exceed `limit`.

    Null and empty texts have no bytes and no tokens. Ids are passed through, null or repeated
    as they are; other columns are not read. An empty table gives an empty table. Texts are
    counted whole.
    """

    def make() -> Callable[[str | None], tuple]:
        transducer = per_worker(f"pieces {path}", lambda: compile_model(path))

        def one(value: str | None) -> tuple:
            tokens = transducer.count(value or "")
            return len((value or "").encode()), tokens, tokens > limit

        return one

    return map_texts(docs, [key], text, make, "n_bytes long, n_tokens long, over_limit boolean")
