"""The token automaton against the gadgets written out, and against the public library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers

from helpers import empty, odd, odd_rows
from test_tokens import fuzz
from veilscan.llm import automaton

PATH = public_tokenizers.path("word_bpe_49k.json")


def written_out(symbols, merges):
    """States and arcs of the literal construction: a dictionary of arcs for every state."""
    arcs = [{s: 0 for s in symbols}]
    for a, b in merges:
        w = a + b
        split = {}
        for q in range(len(arcs)):
            p = arcs[q].get(a)
            if p is None or b not in arcs[p]:
                continue
            if p not in split:
                split[p] = len(arcs) + len(split)
        behind = {p: arcs[p][b] for p in split}
        old = len(arcs)
        for p in split:
            arcs.append({t: r for t, r in arcs[p].items() if t != b})
        for q in range(len(arcs)):
            p = arcs[q].get(a)
            if p in split and p < old:
                arcs[q][w] = behind[p]
                arcs[q][a] = split[p]
    return arcs


@pytest.mark.parametrize("seed", range(40))
def test_same_arcs_as_the_construction_written_out(seed):
    made = random.Random(seed)
    symbols = list("abc"[: made.randint(1, 3)])
    tokens, merges = list(symbols), []
    for _ in range(made.randint(1, 12)):
        a, b = made.choice(tokens), made.choice(tokens)
        if a + b not in tokens and len(a + b) <= 8:
            merges.append((a, b))
            tokens.append(a + b)
    arcs = written_out(symbols, merges)
    numbers = {t: i for i, t in enumerate(tokens)}
    mine = automaton.TokenAutomaton(len(tokens))
    usable = set(symbols)
    kept = [(a, b) for a, b in merges]
    for a, b in kept:
        if a in usable and b in usable and mine.add_gadget(numbers[a], numbers[b], numbers[a + b]):
            usable.add(a + b)
    for u in usable:
        for t in usable:
            if u in arcs[0]:
                assert mine.allows(numbers[u], numbers[t]) == (t in arcs[arcs[0][u]]), (merges, u, t)


def merged(word, merges):
    """Merges applied one after the other, each from the left."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(40))
def test_words_of_small_alphabets(seed):
    made = random.Random(seed)
    tokens, merges = list("ab"), []
    for _ in range(15):
        a, b = made.choice(tokens), made.choice(tokens)
        if a + b not in tokens and len(a + b) <= 10:
            merges.append((a, b))
            tokens.append(a + b)
    vocabulary = {t: i for i, t in enumerate(tokens)}
    words = automaton.WordCoder(vocabulary, merges, "")
    for _ in range(60):
        word = "".join(made.choice("aab") for _ in range(made.randint(1, 30)))
        assert [tokens[i] for i in words.encode(word)] == merged(word, merges)


def library_rows(texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    coded = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(ids, library.decode(ids, skip_special_tokens=False)) for ids in coded]


EXTRA = ["a" * 3000, "l" * 7 + "L" * 8, "ΑΣ ΣΑΣ. ΟΔΟΣ", "İI ſ K", "é é ẛ̣", "don't WE'LL 'S", "x<|endoftext|>y",
         "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", " <|endoftext|> ", "12３½", " a　b​c", "🙂🙂👍🏽", "\x00"]


def test_same_ids_as_the_library():
    mine = automaton.Coder(PATH, cached_chars=2000)
    texts = [r[1] or "" for r in odd_rows()] + fuzz(3000) + EXTRA
    for text, (ids, decoded) in zip(texts, library_rows(texts)):
        found = mine.encode(text)
        assert list(memoryview(found).cast("I")) == ids, text[:80]
        assert mine.decode(found) == decoded


def test_random_words_and_a_small_table(monkeypatch):
    monkeypatch.setattr(automaton, "TABLE_ENTRIES", 50)
    mine, made = automaton.Coder(PATH), random.Random(5)
    texts = ["".join(made.choice("etaoinshrdlu") for _ in range(made.randint(1, 40))) for _ in range(2000)]
    for text, (ids, _) in zip(texts, library_rows(texts)):
        assert list(memoryview(mine.encode(text)).cast("I")) == ids


def test_documents(spark, monkeypatch):
    rows = odd_rows()
    found = automaton.encode_documents(odd(spark), PATH).collect()
    expected = [(r[0], *pair) for r, pair in zip(rows, library_rows([r[1] for r in rows]))]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert automaton.encode_documents(empty(spark), PATH).count() == 0


def test_common_characters_as_the_library_takes_them():
    """Every character that does without the library's steps, alone, in a word and between words."""
    mine = automaton.Coder(PATH)
    common = [*map(chr, range(0x250)), *map(chr, [*range(0x2010, 0x2028), 0x250, 0x301, 0x2000, 0x3000, 0xFB01])]
    texts = [form.format(c) for c in common for form in ("{0}", "Ab{0}cD", "e{0} x", "x {0}.;{0}, y{0}'s", "{0}{0} I{0}E,")]
    texts += ["".join(pair) for pair in zip(common, reversed(common))]
    for text, (ids, _) in zip(texts, library_rows(texts)):
        assert list(memoryview(mine.encode(text)).cast("I")) == ids, repr(text)


def test_words_of_letters_are_not_given_to_the_library(monkeypatch):
    mine, given = automaton.Coder(PATH), []
    for step in ("_split", "_normalize"):
        taken = getattr(mine, step)
        monkeypatch.setattr(mine, step, lambda part, taken=taken: given.append(part) or taken(part))
    made = random.Random(6)
    words = ["".join(made.choices("etaoinshrdluéüñ", k=made.randint(2, 12))) for _ in range(2000)]
    text = " ".join(word.title() + made.choice(["", ",", "."]) for word in words)
    [(ids, _)] = library_rows([text])
    assert list(memoryview(mine.encode(text)).cast("I")) == ids
    assert set(given) <= {",", "."}


def test_another_normalizer_is_left_to_the_library(tmp_path):
    library = Tokenizer.from_file(PATH)
    library.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    library.save(str(tmp_path / "other.json"))
    mine = automaton.Coder(str(tmp_path / "other.json"))
    for text in ["Cr\u00e8me Br\u00fbl\u00e9e, e\u0301.", "plain Words"]:
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(mine.encode(text)).cast("I")) == expected
