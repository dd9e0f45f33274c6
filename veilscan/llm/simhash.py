"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Equal fingerprints are one. The distinct ones are dealt into cells by the population counts
of their four 16-bit quarters, and cells into tiles of bounded size. The counts of two
fingerprints differ by no more, summed over the quarters, than the fingerprints differ in
bits, so a tile is compared only with tiles of cells within the radius: by exclusive-or and
bit counts in numpy. A pair of tiles gives a spanning forest of its links rather than the
links, which keeps every connection and no more rows than the tiles have fingerprints.
Components grow over the forests by turns of large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.rows import column, fresh, stored

RADIUS = 3
WIDTH = 3  # words of a shingle
SEED = 42
TILE = 4096
ROWS_AT_ONCE = 256  # of a tile against a whole other one
HASHES_AT_ONCE = 1 << 16
QUARTERS = 4
QUARTER_BITS = 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and the six blanks
    n = max(1, len(words) - WIDTH + 1) if words else 0
    if not n:
        return 0
    if n == 1:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i : n + i] for i in range(WIDTH)]))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, n, HASHES_AT_ONCE):
        count = min(HASHES_AT_ONCE, n - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(count)), "<u8", count)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > n, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long of the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint_of(value) for value in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return run(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _quarter_counts(value: Column) -> list[Column]:
    mask = (1 << QUARTER_BITS) - 1
    return [
        F.bit_count(F.shiftrightunsigned(value, QUARTER_BITS * i).bitwiseAND(F.lit(mask).cast("long")))
        for i in range(QUARTERS)
    ]


def _tiles(distinct: DataFrame) -> DataFrame:
    """`(cell, part, prints)`: tiles of about TILE fingerprints with equal quarter counts.

    The number of cells is bounded by the possible counts, 17 to the fourth. A large cell is
    dealt into parts by a hash.
    """
    base = QUARTER_BITS + 1
    cell = F.lit(0)
    for count in _quarter_counts(F.col("print")):
        cell = cell * base + count
    placed = distinct.select("print", cell.cast("int").alias("cell"))
    sizes = stored(placed.groupBy("cell").count(), "cells")
    parts = F.ceil(F.col("count") / TILE)
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("print"), parts).cast("int"))
    tiles = dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list("print")).alias("prints"))
    return stored(tiles, "tiles")


def _nearby(radius: int) -> list[tuple[int, ...]]:
    """Steps between cells that hold fingerprints within the radius; one of each pair of signs."""
    steps = product(range(-radius, radius + 1), repeat=QUARTERS)
    return sorted(s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS)


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """All pairs of tiles whose population counts allow links, each once, a tile with itself too."""
    base = QUARTER_BITS + 1
    counts = [F.expr(f"cell div {base ** (QUARTERS - 1 - i)} % {base}") for i in range(QUARTERS)]
    targets = []
    for step in _nearby(radius):
        moved = [c + s for c, s in zip(counts, step) if s]
        shift = sum(s * base ** (QUARTERS - 1 - i) for i, s in enumerate(step))
        inside = F.lit(True)
        for m in moved:
            inside = inside & (m >= 0) & (m < base)
        targets.append(F.when(inside, F.col("cell") + shift))
    reached = F.filter(F.array(*targets), lambda c: c.isNotNull())
    there = tiles.select(F.col("cell").alias("to_cell")).distinct()
    sent = (
        tiles.select("cell", "part", "prints", F.explode(reached).alias("to_cell"))
        .join(there, "to_cell")
        .select(
            F.col("cell").alias("from_cell"), F.col("part").alias("from_part"),
            F.col("prints").alias("mine"), "to_cell",
        )
    )
    met = sent.join(tiles, F.col("to_cell") == F.col("cell"))
    once = (F.col("from_cell") != F.col("cell")) | (F.col("from_part") <= F.col("part"))
    return met.where(once).select("mine", F.col("prints").alias("theirs"))


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the ends of all edges, in place."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            next_parent = parent[parent]
            if (next_parent == parent).all():
                break
            parent[:] = next_parent


def forest(mine: np.ndarray, theirs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root) pairs, of the links between two sets."""
    both, place = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
    parent = np.arange(len(both))
    for start in range(0, len(mine), ROWS_AT_ONCE):
        rows = mine[start : start + ROWS_AT_ONCE]
        apart = np.bitwise_count(rows[:, None] ^ theirs[None, :])
        a, b = np.nonzero(apart <= radius)
        if len(a):
            _roots(parent, place[a + start], place[b + len(mine)])
    linked = np.flatnonzero(parent != np.arange(len(both)))
    return both[linked], both[parent[linked]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`(a, b)`: links between the fingerprints of a column `print` that connect all near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("mine", "theirs"):
                lists = batch.column(name)
                values = lists.values.to_numpy().view(np.uint64)
                sides.append((lists.offsets.to_numpy(), values))
            found = []
            for i in range(batch.num_rows):
                pair = [values[offsets[i] : offsets[i + 1]] for offsets, values in sides]
                edges = forest(*pair, radius)
                if len(edges[0]):
                    found.append(edges)
            if found:
                a, b = (np.concatenate(part).view(np.int64) for part in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    pairs = _tile_pairs(_tiles(distinct), radius)
    return pairs.mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation; the smallest neighbour of each node becomes the hub of others.

    The smallest neighbours are stored before the join, so that both of its sides are plain
    exchanges that Spark can split where one node has very many links.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    if large:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                 F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        near = edges.select(ends.alias("e")).select("e.u", "e.v")
    else:
        near = edges.select(high.alias("u"), low.alias("v"))
    hubs = near.groupBy("u").agg(F.min("v").alias("hub"))
    hubs = hubs.select(F.col("u").alias("of"), F.least("u", "hub").alias("hub"))
    hubs = stored(hubs, "hubs")
    met = near.join(hubs, F.col("u") == F.col("of"))
    if large:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("hub").alias("b"))
    else:
        own = hubs.select(F.col("of").alias("a"), F.col("hub").alias("b"))
        moved = met.select(F.col("v").alias("a"), F.col("hub").alias("b")).union(own)
    return stored(moved.where("a <> b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` of all nodes with an edge `(a, b)`; roots are their components' smallest."""
    current = stored(edges.where("a <> b").distinct(), "links")
    before = None
    while True:
        current = _star(_star(current, large=True), large=False)
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(members.select(F.col("root").alias("node"), "root").distinct())


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """The rows of `prints` with `component` and `root`: least `key` and least `print` reachable."""
    nodes = prints.groupBy("print").agg(F.min("key").alias("first"))
    nodes = stored(nodes, "distinct-prints")
    found = stored(components(links(nodes.select("print"), radius)), "components")
    least = (
        found.join(nodes, F.col("node") == F.col("print"))
        .groupBy("root")
        .agg(F.min("first").alias("least"))
    )
    least = stored(least.withColumnRenamed("root", "least_root"), "least")
    rooted = nodes.join(found, F.col("print") == F.col("node"), "left").join(
        least, F.col("root") == F.col("least_root"), "left"
    )
    named = stored(
        rooted.select(
            F.col("print").alias("its_print"),
            F.coalesce("least", "first").alias("component"),
            F.coalesce("root", "print").alias("root"),
        ),
        "named-prints",
    )
    return prints.join(named, F.col("print") == F.col("its_print")).drop("its_print")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """`(key, print, component, root)` per row of `docs`: fingerprint, smallest id reachable, and
    the smallest fingerprint reachable, which numbers the groups whatever ids their rows have.

    A-Z are lower-cased, words are runs without the six ASCII blanks, and a shingle is three
    words with a space between; repeats count. A bit is set if it is in more than half of the
    64-bit hashes. Fingerprints link at `radius` or fewer different bits, and links connect.

    Texts of one or two words are one shingle. Null texts and texts without words have
    fingerprint 0 and link like all others. Rows that repeat an id keep their own fingerprints.
    A row without an id belongs to its component; a component of such rows alone has no id.
    An empty table gives an empty table.
    """
    prints = docs.select(column(key).alias("key"), fingerprint(column(text)).alias("print"))
    found = _grouped(stored(prints, "prints"), radius)
    return found.select(F.col("key").alias(key), "print", "component", "root")


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group, one row with its smallest id.

    Of a group's rows with this id, or of a group of rows without ids, the text with the
    smallest SHA-256 stays, a null text last. Rows are met again by id and text: equal texts
    are always of one group, so no group takes a row of another one that repeats its id.
    """
    digest = F.sha2(column(text).cast("binary"), 256)
    prints = docs.select(
        column(key).alias("key"), fingerprint(column(text)).alias("print"), digest.alias("digest")
    )
    found = _grouped(stored(prints, "prints"), radius)
    kept_key, kept_digest = fresh(docs, "_keeper"), fresh(docs, "_kept")
    keepers = (
        found.where(F.col("key").eqNullSafe(F.col("component")))
        .groupBy("root")
        .agg(F.min("key").alias(kept_key), F.min("digest").alias(kept_digest))
        .drop("root")
    )
    keepers = stored(keepers, "keepers")
    same = column(key).eqNullSafe(column(kept_key)) & digest.eqNullSafe(column(kept_digest))
    joined = docs.join(keepers, same).dropDuplicates([kept_key, kept_digest])
    return joined.select(*[column(c) for c in docs.columns])
