"""Token files, byte-level BPE and transducer counts against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, normalizers

from helpers import empty, odd, odd_rows
from veilscan.llm import bpe, counts, rows, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def fuzz(n, seed=1):
    made = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " a", "the", "ing", "é", "'s", "'LL", "1", "23", "!",
             "​", "漢", "🙂", "\x00", "ſ", "▁", "<s>", "<0x0A>", "##", "\r", "Ġ", "﻿", "<|endoftext|>"]
    return ["".join(made.choice(parts) for _ in range(made.randint(0, 12))) for _ in range(n)]


TEXTS = [r[1] or "" for r in odd_rows()] + fuzz(3000)


@pytest.mark.parametrize("n", [1, 2, 7, 256, 257, 3000])
@pytest.mark.parametrize("spread", [0, 1, 50, 10**6, 2**60])
def test_elias_fano(n, spread):
    made = random.Random(n)
    for base in (0, -(2**62), 12345):
        values = np.sort(np.array([base + made.randint(0, spread) for _ in range(n)], np.int64))
        sequence, rest = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes() + b"rest")
        assert rest == b"rest"
        assert (sequence.values() == values).all()
        for i in {0, n - 1, *(made.randrange(n) for _ in range(20))}:
            assert sequence[i] == values[i]


def test_boundaries_take_near_minimal_space():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(token_files.EliasFano.of(bounds).to_bytes()) * 8 < 100_000 * (2 + 11 + 1)


def test_library_ids_by_words():
    library = Tokenizer.from_file(LIBRARY)
    coder = token_files.LibraryEncoder(LIBRARY)
    coder._words.most_chars = 2000  # forget often
    for text in TEXTS * 2:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    folder = rows.new_folder(spark, "tokens")
    token_files.write_token_files(odd(spark), folder, LIBRARY, 2)
    found = token_files.read_token_files(spark, folder).collect()
    library = Tokenizer.from_file(LIBRARY)

    def ids(text):
        return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")

    assert len(found) == len(odd_rows())
    by_start = sorted(found, key=lambda r: r.start)
    names = [r.doc_id for r in by_start]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    ends = 0
    for r in by_start:
        assert r.start == ends
        ends += r.n_tokens
    expected = sorted((str(r[0]), len(i := ids(r[1])), zlib.crc32(i.tobytes())) for r in odd_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == expected


def test_random_access(spark):
    folder = rows.new_folder(spark, "tokens")
    token_files.write_token_files(odd(spark).where("doc_id > 15"), folder, LIBRARY, 2)
    coder = token_files.LibraryEncoder(LIBRARY)
    texts = {r[0]: r[1] for r in odd_rows()}
    for row in spark.read.parquet(f"{folder}/manifest").collect():
        with token_files.TokenFile(folder, row.file) as file:
            for i in range(file.n_docs):
                assert file.document(i).tolist() == [*coder.encode(texts[file.key(i)]).tolist(), 2]


def test_no_documents(spark):
    folder = rows.new_folder(spark, "tokens")
    token_files.write_token_files(empty(spark), folder, LIBRARY, 2)
    assert token_files.read_token_files(spark, folder).count() == 0
    assert bpe.encoding_digests(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    assert counts.token_counts(empty(spark), PIECES).count() == 0


def test_segment_tree_merges():
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN, cached_chars=2000)
    for text in TEXTS * 2:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_ties_go_left():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256}
    assert bpe.BytePairs(ranks).encode_piece(b"aaaaa") == [256, 256, 97]


def test_long_piece_is_fast():
    coder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    text = "xyzzyq" * 50_000
    assert coder.decode(coder.encode(text)) == text.encode()


def test_encoded_documents(spark):
    found = bpe.encoding_digests(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    ids = bpe.encode_documents(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows())
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in found) == expected
    assert sorted((str(r.doc_id), hashlib.sha256(r.decoded).hexdigest()) for r in ids) == expected
    assert sorted(r.n_tokens for r in found) == sorted(len(r.ids) for r in ids)


@pytest.mark.parametrize("chunk", [1 << 16, 1, 7])
def test_transducer_counts(chunk):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    transducer = counts.compile_model(PIECES)
    texts = [t for t in TEXTS if chunk > 100 or len(t) < 500]
    for text in texts:
        assert transducer.count(text, chunk) == len(library.encode(text))


def test_forgetful_transducer(monkeypatch):
    monkeypatch.setattr(counts, "MOST_STATES", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    transducer = counts.compile_model(PIECES)
    for text in TEXTS[:400]:
        assert transducer.count(text, 11) == len(library.encode(text))


def test_counted_documents(spark):
    found = counts.token_counts(odd(spark), PIECES, limit=100).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = []
    for r in odd_rows():
        n = len(library.encode(r[1] or ""))
        expected.append((str(r[0]), len((r[1] or "").encode()), n, n > 100))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(expected)


def test_words_and_lines_as_the_library_takes_them():
    """Every common character and white space, alone, in a word, before signs and beside a line end."""
    mine = token_files.LibraryEncoder(LIBRARY)
    library = Tokenizer.from_file(LIBRARY)
    common = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2030), 0x250, 0x301, 0x3000, 0x4E00, 0xFEFF]]
    forms = ["a Ab{0}cD", "a x.\n{0}y", "a {0}\nY'{0}s.", "a x{0}\n\ny {0}.,", "a \n{0} b", "a b\n{0}\n'll,\nI''s b{0}"]
    texts = [form.format(c) for c in common for form in forms]
    for text in texts * 2:
        expected = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == expected, repr(text)


def test_words_and_line_starts_of_letters_go_to_the_model_at_once(monkeypatch):
    mine, given = token_files.LibraryEncoder(LIBRARY), []
    taken = mine._plain
    monkeypatch.setattr(mine, "_plain", lambda text: given.append(text) or taken(text))
    made = random.Random(7)
    words = ["".join(made.choices("etaoinshrdluéüñ", k=made.randint(2, 12))) for _ in range(2000)]
    text = "".join(word + made.choice([" ", ", ", ".\n", "*** "]) for word in words) + "end"
    expected = Tokenizer.from_file(LIBRARY).encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == expected
    assert set(given) <= {",", ".", "***", "\n"}


def test_another_splitting_is_left_to_the_library(tmp_path):
    library = Tokenizer.from_file(LIBRARY)
    library.normalizer = normalizers.Lowercase()
    library.save(str(tmp_path / "other.json"))
    mine = token_files.LibraryEncoder(str(tmp_path / "other.json"))
    text = "Some Words, and\nOther Words"
    assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
