"""Language identification by averaged hashed subword embeddings and a linear softmax.

Letters of a text, in lower case, form words with a blank on both sides; the runs of two to
four characters inside a word are its subwords. Each is hashed to a row of an embedding table.
A document is the mean of its rows, and a linear softmax turns the mean into a language. Both
tables are trained together by stochastic gradient descent in numpy, on a bounded sample of
the labelled documents. Since all is linear up to the softmax, prediction uses one table of
scores per hash and language.

A part of the sample is kept back: it sets the temperature that makes scores probabilities,
and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.rows import column, fresh, per_worker

UNDETERMINED = "und"
BUCKET_BITS = 15
LENGTHS = (2, 3, 4)
BLOCK_CHARS = 1 << 18  # characters hashed at a time
SAMPLE_ROWS = 600  # of each language, at most, that a model is trained on
SAMPLE_BUCKETS = 4096  # most frequent subwords kept of a sampled document
DIM = 16
EPOCHS = 6
RATE = 0.5
KEPT_BACK = 5  # every fifth sampled document calibrates
REJECTED_SHARE = 0.001  # of the calibration documents
MOST_REJECTION = 0.5  # no prediction with a higher score is rejected

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def letter_table() -> np.ndarray:
    """For every code point: the code point itself for letters, a blank for all others."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code
    return table


def letters(text: str) -> np.ndarray:
    """Code points of the letters in lower case, words between single blanks; empty if none."""
    table = per_worker("letters", letter_table)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[32], table[codes], [32]]).astype(np.uint32)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def subwords(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the subwords, a bounded block of characters at a time."""
    widest = max(LENGTHS)
    for start in range(0, len(codes), BLOCK_CHARS):
        block = codes[start : start + BLOCK_CHARS + widest - 1]
        inner = block != 32
        for width in LENGTHS:
            count = min(len(block) - width + 1, BLOCK_CHARS)
            if count < 1:
                continue
            mixed = np.zeros(count, np.uint32)
            for i in range(width):
                mixed = (mixed ^ block[i : i + count]) * np.uint32(_MULTIPLIERS[i])
                mixed ^= mixed >> np.uint32(15)
            whole = np.ones(count, bool)
            for i in range(1, width - 1):
                whole &= inner[i : i + count]
            yield (mixed[whole] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def bag(text: str) -> np.ndarray:
    """Counts of all buckets; zeros if the text has no letters."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for hashes in subwords(letters(text)):
        counts += np.bincount(hashes, minlength=len(counts))
    return counts


@dataclass(frozen=True)
class Model:
    """Scores per bucket and language, and what makes them probabilities."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Probability of every language; None without letters, or without languages."""
        if not self.languages:
            return None
        total, n = np.zeros(len(self.languages)), 0
        for hashes in subwords(letters(text or "")):
            total += self.table[hashes].sum(axis=0, dtype=np.float64)
            n += len(hashes)
        return _softmax((total / n + self.bias) / self.temperature) if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the score is high enough."""
        found = self.probabilities(text)
        if found is None:
            return UNDETERMINED, 0.0, False
        best = int(found.argmax())
        score = float(min(1.0, found[best]))
        return self.languages[best], score, score >= self.threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> pd.DataFrame:
    """`(lang, buckets, counts)`: about `rows` labelled documents of each language.

    A language's documents are taken by a hash of id and text, by a share of all that makes
    `rows` expected; the counts come from the whole table first. A document comes to the
    driver as its most frequent subwords, so the sample's size does not grow with the input.
    """
    labelled = docs.select(
        column(key).alias("key"), column(text).alias("text"), column(lang).alias("lang")
    ).where("lang is not null and text is not null")
    labelled = labelled.where(~is_held_out(F.col("key")))
    counted = labelled.groupBy("lang").count().collect()
    share = F.lit(0.0)
    for found in counted:
        share = F.when(F.col("lang") == found["lang"], min(1.0, rows / found["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for language, value in zip(batch["lang"], batch["text"]):
                counts = bag(value)
                top = np.sort(np.argsort(-counts, kind="stable")[:SAMPLE_BUCKETS])
                top = top[counts[top] > 0]
                if len(top):
                    out.append((language, top.astype("<u4").tobytes(), counts[top].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "buckets", "counts"])

    schema = "lang string, buckets binary, counts binary"
    picked = labelled.where(drawn < share).select("lang", "text")
    found = picked.mapInPandas(bags, schema).toPandas()
    # An order of its own, so that training does not depend on how the rows arrive.
    return found.sort_values(["buckets", "counts", "lang"], ignore_index=True)


def train(sample: pd.DataFrame, seed: int = 0) -> Model:
    """A model of a sample. Without any labelled document it predicts nothing."""
    languages = tuple(sorted(set(sample["lang"])))
    size = 1 << BUCKET_BITS
    if not languages:
        return Model((), np.zeros((size, 0), np.float32), np.zeros(0))
    answers = np.array([languages.index(x) for x in sample["lang"]])
    documents = []
    for buckets, counts in zip(sample["buckets"], sample["counts"]):
        weights = np.frombuffer(counts, "<u4").astype(np.float64)
        documents.append((np.frombuffer(buckets, "<u4").astype(np.int64), weights / weights.sum()))
    random = np.random.default_rng(seed)
    order = random.permutation(len(documents))
    kept_back = order[:: KEPT_BACK] if len(order) >= 10 * KEPT_BACK else order[:0]
    learned = np.setdiff1d(order, kept_back)
    embedding = random.normal(0, 0.1, (size, DIM))
    weights = random.normal(0, 0.1, (DIM, len(languages)))
    bias = np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(learned):
            buckets, shares = documents[i]
            mean = shares @ embedding[buckets]
            error = _softmax(mean @ weights + bias)
            error[answers[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # The mean spreads a step thinly over many rows: scale it back to their number.
            embedding[buckets] -= rate * np.outer(shares * len(buckets) ** 0.5, back)
    table = embedding @ weights
    raw = [shares @ table[buckets] + bias for buckets, shares in (documents[i] for i in kept_back)]
    temperature, threshold = _calibrated(raw, answers[kept_back])
    return Model(languages, table.astype(np.float32), bias, temperature, threshold)


def _calibrated(raw: list[np.ndarray], answers: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the score that nearly all right answers reach."""
    if not raw:
        return 1.0, 0.0

    def loss(temperature: float) -> float:
        found = [max(_softmax(x / temperature)[a], 1e-12) for x, a in zip(raw, answers)]
        return -float(np.mean(np.log(found)))

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    right = [_softmax(x / temperature)[a] for x, a in zip(raw, answers) if x.argmax() == a]
    threshold = float(np.quantile(right, REJECTED_SHARE)) if right else 0.0
    return float(temperature), min(threshold, MOST_REJECTION)


def predicted(model: Model, text: Column) -> Column:
    """A struct of language, score and acceptance for a text."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(value) for value in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "accepted"])

    return run(text)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model trained on the documents of `docs` that are labelled and not held out."""
    return train(training_sample(docs, key, text, lang))


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """The rows of `docs` with one more column, and its name.

    The column is a struct of `lang_pred`, `score` (0 to 1) and `accepted`. A null text, or
    one without letters, is `und` with score 0 and is not accepted; so is every text where
    there was nothing to learn from. Equal texts get equal answers. An empty table gives an
    empty table. Whole texts are read, a block of characters at a time.
    """
    added = fresh(docs, "_language")
    return docs.withColumn(added, predicted(model, column(text))), added


def accepted(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is predicted with a score that is not rejected."""
    found, added = identify(docs, fit(docs, key, text, lang), text)
    return found.where(column(added).getField("accepted")).select(*[column(c) for c in docs.columns])
