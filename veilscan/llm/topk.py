"""Exact top-k by inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into segments; each has a mean and a deviation. For two vectors q and x,

    |q - x|^2 >= sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

which, with the exact norms, bounds the inner product from above. Finer cuts give closer
bounds, so candidates are tested with few segments first and with more where they survive; the
integer inner product is computed for the survivors alone. A candidate is given up only if its
bound lies below the k-th best exact score found so far, so the result is exact.

Vectors are packed into blocks of rows. The queries, a stated set, meet all candidates block
by block; a task keeps the k best of each query it has seen and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.rows import column, stored

SCALE = 1024
LEVELS = (1, 4, 16)
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
KEPT_BLOCKS = 64  # query blocks whose best a task holds before it writes them out
EXACT_DOUBLE = 2.0**52  # integers below are exact in doubles
LONGEST = 2**63 - 1
OPEN_LENGTHS = 16  # blocks of different lengths that a task fills at a time


def takes_part(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows `(row, name, vector)` as blocks of at most `size` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            numbers, names, parts = held.pop(dim)
            whole = np.floor(SCALE * np.array(parts, np.float64).reshape(len(names), dim))
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "rows": [np.array(numbers, "<i8").tobytes()],
                    "names": [np.array(names, "<i8").tobytes()],
                    "data": [whole.astype("<f8").tobytes()],
                }
            )

        for batch in batches:
            vectors = batch.column(2)
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, (number, name) in enumerate(keys):
                vector = vectors[i].values.to_numpy(zero_copy_only=False)
                block = held.setdefault(len(vector), ([], [], []))
                for part, value in zip(block, (number, name, vector)):
                    part.append(value)
                if len(block[0]) == size:
                    yield packed(len(vector))
                elif len(held) > OPEN_LENGTHS:
                    yield packed(next(iter(held)))
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, "dim int, rows binary, names binary, data binary")


class Statistics:
    """Segment means and deviations of a block, scaled so that distances are plain."""

    def __init__(self, vectors: np.ndarray):
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.levels = []
        dim = vectors.shape[1]
        for parts in LEVELS:
            edges = np.unique(np.linspace(0, dim, min(parts, max(dim, 1)) + 1).astype(int))
            pieces = [vectors[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
            roots = [np.sqrt(p.shape[1]) for p in pieces]
            means = [p.mean(axis=1) * r for p, r in zip(pieces, roots)]
            deviations = [p.std(axis=1) * r for p, r in zip(pieces, roots)]
            both = np.stack(means + deviations, axis=1) if pieces else np.zeros((len(vectors), 0))
            self.levels.append((both, np.einsum("ij,ij->i", both, both)))


def scores_above(
    query: np.ndarray, its: Statistics, row: int, vectors: np.ndarray, theirs: Statistics, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose exact score with a query may be at least `least`, and the scores."""
    alive = np.arange(len(vectors))
    if np.isfinite(least):
        for (mine, my_square), (stats, squares) in zip(its.levels, theirs.levels):
            near = stats[alive] @ mine[row]
            distance = squares[alive] + my_square[row] - 2 * near  # lower bound of |q - x|^2
            bound = (its.norms[row] + theirs.norms[alive] - distance) / 2
            slack = 1e-9 * (its.norms[row] + theirs.norms[alive]) + 1e-6  # rounding of the bound
            alive = alive[bound + slack >= least]
            if not len(alive):
                break
    return alive, exact_scores(query, vectors[alive])


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; sums beyond the long range stay at its ends."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    largest = np.abs(query).max() * np.abs(vectors).max() * vectors.shape[1]
    if largest < EXACT_DOUBLE:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(a * int(b) for a, b in zip(whole, v)) for v in vectors]
    return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in sums], np.int64)


class Best:
    """The k best candidates of the queries of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.statistics = Statistics(vectors)
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none) for _ in ids]

    def meet(self, rows: np.ndarray, names: np.ndarray, vectors: np.ndarray, stats: Statistics) -> None:
        for i, own in enumerate(self.ids):
            scores, old_names, old_rows = self.found[i]
            full = len(scores) >= self.k
            least = float(scores[-1]) if full else -np.inf
            alive, exact = scores_above(self.vectors[i], self.statistics, i, vectors, stats, least)
            use = rows[alive] != own
            if full:
                use &= exact >= scores[-1]
            if not use.any():
                continue
            alive, exact = alive[use], exact[use]
            scores = np.concatenate([scores, exact])
            old_names = np.concatenate([old_names, names[alive]])
            old_rows = np.concatenate([old_rows, rows[alive]])
            # ~ turns the order of all longs around, without the overflow of a minus sign.
            order = np.lexsort((old_rows, old_names, ~scores))[: self.k]
            self.found[i] = scores[order], old_names[order], old_rows[order]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each task, from pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, Best]] = {}
        # Pairs come with one side fixed over many rows: its statistics are made once.
        last: tuple[bytes, Statistics] | None = None

        def written(best: tuple[np.ndarray, Best]) -> pa.RecordBatch:
            names, kept = best
            counts = [len(scores) for scores, _, _ in kept.found]
            columns = [
                np.repeat(kept.ids, counts),
                np.repeat(names, counts),
                *[np.concatenate(part) for part in zip(*kept.found)],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["query_row", "query_id", "score", "vec_id", "vec_row"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["q_dim"] != r["dim"]:
                    continue
                dim = r["dim"]
                rows, names = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["names"], "<i8")
                vectors = np.frombuffer(r["data"], "<f8").reshape(len(rows), dim)
                if last is None or last[0] != r["rows"]:
                    last = r["rows"], Statistics(vectors)
                if r["q_rows"] not in held:
                    if len(held) >= KEPT_BLOCKS:
                        yield written(held.pop(next(iter(held))))
                    ids = np.frombuffer(r["q_rows"], "<i8")
                    asked = np.frombuffer(r["q_data"], "<f8").reshape(len(ids), dim)
                    held[r["q_rows"]] = np.frombuffer(r["q_names"], "<i8"), Best(ids, asked, k)
                held[r["q_rows"]][1].meet(rows, names, vectors, last[1])
        for best in held.values():
            yield written(best)

    schema = "query_row long, query_id long, score long, vec_id long, vec_row long"
    return pairs.mapInArrow(run, schema)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best other rows of every query row.

    Components count as floor(1024 * x), x as a double; the score is their inner product. Ties
    go to the smaller id. Rows without an id, with a null vector, or with a component that is
    null or not finite take no part. A vector meets those of its own length; empty vectors
    score 0 with each other. Rows that repeat an id are rows of their own: a query row meets
    them all but itself. Scores beyond the long range count as its ends. An empty table, or one
    without queries, gives an empty table.
    """
    usable = (
        vectors.select(
            column(key).cast("long").alias("name"),
            column(vector).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .where(F.col("name").isNotNull() & takes_part(F.col("vector")))
        .withColumn("row", F.monotonically_increasing_id())
    )
    usable = stored(usable, "vectors")
    parts = ["row", "name", "vector"]
    queries = stored(_blocks(usable.where("asks").select(parts), QUERY_BLOCK), "query-blocks")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    candidates = stored(_blocks(usable.select(parts), CANDIDATE_BLOCK), "vector-blocks")
    # Blocks against blocks: a block is one row, and the queries are a stated share of the rows.
    found = _search(candidates.crossJoin(queries), k)
    by_query = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
