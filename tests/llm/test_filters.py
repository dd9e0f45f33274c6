"""Compression bands and language identification."""

import base64
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
import zstandard

from helpers import LONG, empty, odd, odd_rows
from veilscan.llm import compression, langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base counts, by plain definition."""
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    repeats = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed


def test_base_counts(spark):
    found = compression.compression_rules(odd(spark)).collect()
    mine = sorted(
        (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in found
    )
    assert mine == sorted((str(r[0]), *base(r[1])) for r in odd_rows())
    assert all(not r.kept for r in found if r.base_failed)
    assert compression.compression_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("words", [60, 600, 6000])
def test_bands(words):
    made = random.Random(words)
    names = ["".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 8))) for _ in range(2000)]
    judge = compression.judge()
    prose = " ".join(made.choice(names) for _ in range(words))
    noise = " ".join("".join(chr(made.randint(0x21, 0x2FFFF - 0x800)) for _ in range(9)).encode(
        "utf-8", "ignore").decode() for _ in range(words))
    block = " ".join(made.choice(names) for _ in range(30))
    repeats = " ".join(f"{i} {block}" if i % 9 else block for i in range(words // 3))
    assert judge(prose)[6]
    assert words < 600 or not judge(noise)[6]  # short texts have wide bands
    assert not judge(repeats)[6]


@pytest.mark.parametrize("noise", ["base64", "words"])
def test_encoded_passages(noise):
    made = random.Random(8)
    names = ["".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 8))) for _ in range(2000)]
    letters = string.ascii_letters + string.digits

    def prose(size):
        return " ".join(made.choice(names) for _ in range(size // 3))[:size]

    def dense(size):
        if noise == "base64":
            return base64.encodebytes(made.randbytes(size)).decode()[:size]
        return " ".join("".join(made.choices(letters, k=made.randint(4, 10))) for _ in range(size // 4))[:size]

    judge = compression.judge()
    for size in (5000, 12_000, 100_000):
        assert judge(prose(size))[6]
    for share in (30, 60, 80):
        part = share * 1000
        assert not judge(prose(100_000 - part) + "\n" + dense(part))[6]
        assert not judge(prose(10_000) + "\n" + dense(part) + "\n" + prose(90_000 - part))[6]
    assert not judge(prose(8192) + dense(4000))[6]  # in the rest behind the last whole chunk
    coded = base64.b64encode(made.randbytes(1200)).decode()
    short = " ".join(coded[i : i + 20] for i in range(0, 1600, 20))
    assert len(short) == 1679 and not judge(short)[6]
    assert judge(prose(8192 + 511))[9] == 2 and judge(prose(8192 + 512))[9] == 3
    assert judge(prose(4095))[9] == 0


def plain_verdicts(rows, bands=compression.DEFAULT_BANDS):
    """The verdict of every text, written out from the definition."""
    judged = []
    for key, text in rows:
        data = (text or "").encode()
        failed = base(text)[5]
        ratio = len(zstandard.compress(data, bands.level)) / len(data) if data else None
        pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) >= 4096 else []
        if len(pieces) > 1 and len(pieces[-1]) < 512:
            pieces[-2:] = [pieces[-2] + pieces[-1]]
        bad = 0
        for piece in pieces:
            found = len(zstandard.compress(piece, bands.level)) / len(piece)
            low, high = (bands.chunk_low, bands.chunk_high) if len(piece) >= 4096 else bands.limits(len(piece))
            bad += not low <= found <= high
        fixed = False
        if not failed:
            low, high = bands.limits(len(data))
            fixed = low <= ratio <= high and bad <= 0.2 * len(pieces)
        wide = sum(b > 127 for b in data) / max(len(data), 1)
        place = (int(math.log2(len(data)) * 2) if data else 0, sum(wide >= x for x in bands.wide_shares))
        judged.append((key, failed, fixed, ratio, place))
    classes = defaultdict(list)
    for _, _, fixed, ratio, place in judged:
        if fixed:
            classes[place].append(math.floor(ratio * 2000))
    limits = {}
    for place, bins in classes.items():
        if len(bins) >= bands.least_documents:
            middle = sorted(bins)[(len(bins) - 1) // 2]
            away = sorted(abs(b - middle) for b in bins)[(len(bins) - 1) // 2]
            spread = 4.5 * max(1.4826 * away, 0.01 * middle)
            limits[place] = (middle - spread, middle + spread)
    return {
        key: (failed, fixed and (place not in limits or limits[place][0] <= math.floor(ratio * 2000) <= limits[place][1]))
        for key, failed, fixed, ratio, place in judged
    }


def planted_corpus():
    """Prose of two scripts and many lengths; every twentieth text is junk that passes the other rules."""
    made = random.Random(11)
    words = ["".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 8))) for _ in range(3000)]
    wide = ["".join(made.choice("абвгдежзийклмноп") for _ in range(made.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(1600):
        pool = wide if i % 4 == 0 else words
        # Half the words out of a few, in a random order: no window repeats much, the ratio falls.
        junk = [word + "***" for word in pool[:120]] if i % 20 == 3 else None
        n = made.randint(200, 280) if junk else made.randint(300, 420)  # as many bytes
        rows.append((i, " ".join(made.choice(junk or pool) for _ in range(n))))
    return rows


def test_verdicts_by_definition(spark):
    rows = planted_corpus()
    source = odd(spark, [(i, text, "", "", 0, 0, 0, "") for i, text in rows])
    found = {r.doc_id: (r.base_failed, r.kept) for r in compression.compression_rules(source).collect()}
    assert found == plain_verdicts(rows)
    junk = {i for i, _ in rows if i % 20 == 3}
    passed = {i for i, (failed, _) in found.items() if not failed}
    kept = {i for i, (_, keeps) in found.items() if keeps}
    assert len(junk & passed) > 50 and not junk & kept  # the bands decide
    assert len(kept) > 0.99 * (len(rows) - len(junk))
    judge = compression.judge()
    assert all(judge(text)[6] for i, text in rows if i in junk & passed)  # the fixed limits alone do not


def test_repeated_windows_by_definition():
    made = random.Random(5)
    for _ in range(300):
        words = [made.choice([b"a", b"b", b"c"]) for _ in range(made.randint(0, 30))]
        text = b" ".join(words).decode()
        assert compression.repeated_words(words) == base(text)[4]


def corpus(spark):
    made = random.Random(0)
    parts = {"en": ["th", "ing", "er", "wh", "ou"], "de": ["sch", "ung", "ein", "ü", "pf"], "fr": ["eau", "ai", "é", "qu", "ois"]}
    rows = []
    for i in range(600):
        lang = made.choice(sorted(parts))
        words = ["".join(made.choice(parts[lang]) for _ in range(3)) for _ in range(made.randint(5, 80))]
        rows.append((i, " ".join(words), lang if i % 7 else None, lang, 0, 0, 0, ""))
    return rows


def test_language_accuracy(spark):
    rows = corpus(spark)
    docs = odd(spark, rows)
    model = langid.fit(docs)
    found, added = langid.identify(docs, model)
    answers = {r[0]: r[3] for r in rows}
    done = found.select("doc_id", f"{added}.*", langid.is_held_out(found.doc_id).alias("held")).collect()
    held = [r for r in done if r.held]
    assert len(held) > 50
    assert sum(r.lang_pred == answers[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in done)
    assert langid.accepted(docs).count() >= 0.97 * len(rows)
    again = langid.fit(docs.repartition(7))
    assert (again.table == model.table).all() and again.threshold == model.threshold


def test_language_of_odd_texts(spark):
    model = langid.fit(odd(spark, corpus(spark)))
    found, added = langid.identify(odd(spark), model)
    assert found.count() == len(odd_rows())
    for r in found.select("doc_id", "text", f"{added}.*").collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if not letters:
            assert r.score == 0 and not r.accepted
    assert langid.accepted(empty(spark)).count() == 0
    assert langid.fit(empty(spark)).predict("hello") == ("und", 0.0, False)


def test_blocks_do_not_change_the_subwords(monkeypatch):
    whole = langid.bag(LONG[:5000])
    monkeypatch.setattr(langid, "BLOCK_CHARS", 17)
    assert (langid.bag(LONG[:5000]) == whole).all()
