"""Tables with everything that may go wrong in one: nulls, repeats, long texts, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, `_mix` string"

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def odd_rows():
    made = random.Random(3)
    letters = "abcdefgh ABé漢🙂\n\t  .,!#|'0123​\x85"
    rows = [
        (1, "The same line here\nAnd another line\n  the SAME line here \nx", "en", "b"),
        (2, "the same line here\nsomething else entirely", "en", "a"),
        (3, None, None, None),
        (4, "", "de", "a"),
        (5, "   \n \t ", "de", "a"),
        (6, "word", "en", None),
        (7, "two words", "en", "b"),
        (8, LONG, "en", "b"),
        (9, LONG, "en", "b"),
        (10, LONG + " more", None, "c"),
        (2, "the same line here\nsomething else entirely", "en", "a"),
        (None, "the same line here\nno id", "en", "a"),
        (None, None, None, None),
        (-5, "a" * 50_000, "fr", "c"),
        (11, "<|endoftext|> and <s> and ▁ and  two  spaces ", "fr", "é"),
    ]
    for i in range(20, 60):
        text = "".join(made.choice(letters) for _ in range(made.randint(0, 200)))
        rows.append((i, text, made.choice(["en", "de", None]), made.choice(["a", "b", "c"])))
    return [(*r, 0, 7, 1, "kept") for r in rows]


def odd(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
