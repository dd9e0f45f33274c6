"""Fill-in-middle against a plain regular expression, and its boundary sets against arrays."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import empty, odd, odd_rows
from veilscan.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(key, text):
    """The contract, word for word."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (key, n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if h4 % 100 < 20:
        return (key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def as_text(rows):
    return sorted(map(repr, rows))


def test_odd_rows(spark):
    rows = odd_rows() + [
        (200 + i, text, "en", "a", 0, 7, 1, "kept")
        for i, text in enumerate(["has <P> inside", "<S>", "a<M>b", "<p> <s>", "\r\n\x00漢字🙂é"] * 9)
    ]
    made = fim.fill_in_middle(odd(spark, rows))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = made.select("*", fim.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert as_text(tuple(r)[:6] for r in found) == as_text(plainly(r[0], r[1]) for r in rows)
    assert sorted(r.again for r in found) == sorted(r[1] or "" for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_names(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    named = spark.createDataFrame([(1, "a b", 3, "x")], "_cut long, output string, n int, form string")
    found = fim.fill_in_middle(named, "_cut", "output").collect()
    assert [tuple(r) for r in found] == [plainly(1, "a b")]


@pytest.mark.parametrize("seed", range(6))
def test_select_in_every_form(seed, monkeypatch):
    made = random.Random(seed)
    # Single letters between words, so that the share of boundaries differs by stretch.
    words = [lambda: "a" * made.randint(5, 60) + " ", lambda: "漢", lambda: "ab", lambda: "a-" * 9]
    text = "".join(
        "".join(made.choice(words[: made.randint(1, 4)])() for _ in range(made.randint(1, 9000)))
        for _ in range(7)
    )
    monkeypatch.setattr(fim, "BLOCK_CHARS", made.choice([1, 7, 1000, 65536, 1 << 20]) if seed else 3)
    text = text[: 200_000 if fim.BLOCK_CHARS > 100 else 5000]
    expected = np.cumsum([len(t) for t in TOKEN.findall(text)])
    found = fim.boundaries(text)
    assert len(found) == len(expected)
    for k in {0, len(expected) - 1, *(made.randrange(len(expected)) for _ in range(300))}:
        assert found.select(k) == expected[k]


def test_the_smallest_form_is_taken():
    made = np.random.default_rng(0)
    sparse = np.sort(made.choice(fim.SPAN, 3000, replace=False))
    dense = np.sort(made.choice(fim.SPAN, 30_000, replace=False))
    forms = {fim.ArrayContainer: sparse, fim.BitmapContainer: dense, fim.RunContainer: np.arange(fim.SPAN)}
    for form, low in forms.items():
        held = fim.container(low)
        assert type(held) is form and held.n_bytes <= min(2 * len(low), fim.SPAN // 8)
        assert all(held.select(k) == low[k] for k in range(0, len(low), 7))
        assert held.select(len(low) - 1) == low[-1]


def test_a_very_long_text(spark):
    text = ("word! " * 400_000) + "漢" * 300_000
    rows = [(i, text, "en", "a", 0, 7, 1, "kept") for i in range(3)]
    found = fim.fill_in_middle(odd(spark, rows)).collect()
    assert as_text(map(tuple, found)) == as_text(plainly(r[0], r[1]) for r in rows)
