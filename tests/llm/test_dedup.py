"""Line deduplication and SimHash groups against brute force."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helpers import empty, odd, odd_rows
from veilscan.llm import lines, simhash

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def deduped(rows):
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        kept = []
        for line in parts:
            held = holders.get(key(line), ())
            smallest = min((d for d in held if d is not None), default=None)
            if len(held) < 2 or smallest == doc:
                kept.append(line)
        out.append((str(doc), len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    found = lines.drop_repeated_lines(odd(spark))
    assert set(odd(spark).columns) < set(found.columns)
    mine = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in found.collect())
    assert mine == deduped(odd_rows())
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_shared_lines(spark):
    made = random.Random(2)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "", "ÄÖ line with umlauts", "äö line with umlauts"]
    rows = [(i, "\n".join(made.choice(pool) for _ in range(made.randint(0, 8))), "", "", 0, 0, 0, "") for i in range(80)]
    mine = lines.drop_repeated_lines(odd(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in mine) == deduped(rows)


def test_many_lines_in_linear_time(spark):
    """Two copies of very many lines, with lines of their own in between; twice as many take about twice as long."""
    times = []
    for n in (100_000, 200_000, 400_000):
        shared = [f"shared line number {i}" for i in range(n)]
        own = [x for i, line in enumerate(shared) for x in ((line, f"own line number {i}") if i % 3 == 0 else (line,))]
        rows = [(1, "\n".join(shared), "", "", 0, 0, 0, ""), (2, "\n".join(own), "", "", 0, 0, 0, "")]
        start = time.perf_counter()
        found = {r.doc_id: r for r in lines.drop_repeated_lines(odd(spark, rows)).collect()}
        times.append(time.perf_counter() - start)
        assert found[2].text == "\n".join(x for x in own if x.startswith("own")) and found[2].n_dropped == n
        assert found[1].text == rows[0][1] and found[1].n_dropped == 0
    assert times[2] < 3 * times[1] + 2, times


def test_a_line_of_every_document_is_split(spark):
    """The lines of a hot hash may go to several tasks: both sides of the join are plain exchanges."""
    rows = [(i, f"the very same line\nown {i % 7} of a document", "", "", 0, 0, 0, "") for i in range(3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        docs = odd(spark, rows).repartition(8)
        held = lines.drop_repeated_lines(docs)
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in held.collect()) == deduped(rows)
        found = lines.lost_lines(docs)
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in BLANKS else c for c in words).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """Smallest id reachable by links of 3 bits or fewer, by comparing everything."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        least[root(i)].append(doc)
    return [min((d for d in least[root(i)] if d is not None), default=None) for i in range(len(prints))]


def test_groups(spark):
    base = [r for r in odd_rows()]
    words = [f"w{i}" for i in range(400)]
    made = random.Random(4)
    for g in range(6):
        text = [made.choice(words) for _ in range(300)]
        for k in range(5):
            copy = list(text)
            copy[made.randrange(300)] = "changed" if k else copy[0]
            base.append((1000 + 10 * g + k, " ".join(copy), "", "", 0, 0, 0, ""))
    found = simhash.near_duplicates(odd(spark, base)).collect()
    prints = [(r[0], plain_print(r[1])) for r in base]
    expected = sorted(zip(map(str, (p[0] for p in prints)), (p[1] for p in prints), map(str, grouped(prints))))
    mine = sorted((str(r.doc_id), r["print"] % 2**64, str(r.component)) for r in found)
    assert mine == expected
    kept = simhash.one_of_each(odd(spark, base))
    assert kept.columns == odd(spark).columns
    names = [str(r.doc_id) for r in kept.collect()]
    assert sorted(names) == sorted({str(c) for c in grouped(prints)})


def test_groups_without_own_ids(spark):
    """Each group keeps one row of its own, if ids are null or stand on unrelated texts."""
    made = random.Random(9)
    texts = [" ".join(f"t{i}x{made.randrange(500)}" for _ in range(80)) for i in range(8)]
    ids = [
        (None, 0), (None, 1), (None, 2), (None, 2),  # groups without any id
        (70, 3), (None, 3),  # a copy without an id
        (5, 4), (5, 5), (9, 5), (5, 5),  # an id on two unrelated texts, the smallest of both
        (6, 6), (5, 6), (6, 7),  # an id that one group keeps and another one drops
    ]
    rows = [(i, texts[t], "", "", 0, 0, 0, "") for i, t in ids] + [(8, None, "", "", 0, 0, 0, "")]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(odd(spark, rows)).collect()]
    names = [None, None, None, 70, 5, 5, 5, 6]
    assert sorted(kept, key=str) == sorted([*zip(names, texts), (8, None)], key=str)
    assert len({r.root for r in simhash.near_duplicates(odd(spark, rows)).collect()}) == 9


def test_dense_chains(spark):
    """Chains of fingerprints, a few bits apart, across cells and tiles."""
    made = random.Random(6)
    prints = set()
    for _ in range(12):
        at = made.getrandbits(64)
        for _ in range(60):
            for _ in range(made.choice([1, 2, 3, 4])):
                at ^= 1 << made.randrange(64)
            prints.add(at)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    for tile in (simhash.TILE, 3):
        simhash.TILE, before = tile, simhash.TILE
        try:
            found = simhash.components(simhash.links(frame)).collect()
        finally:
            simhash.TILE = before
        mine = defaultdict(set)
        for r in found:
            mine[r.root].add(r.node % 2**64)
        expected = defaultdict(set)
        for p, first in zip(prints, grouped([(i, p) for i, p in enumerate(prints)])):
            expected[first].add(p)
        assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in expected.values() if len(x) > 1}


def test_forest_is_small():
    made = np.random.default_rng(1)
    near = np.unique(np.uint64(0) ^ (np.uint64(1) << made.integers(0, 64, 500).astype(np.uint64)))
    members, roots = simhash.forest(near, near)
    assert len(members) == len(near) - 1 and len(set(roots.tolist())) == 1


def test_no_rows(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_hex(spark):
    row = spark.range(1).select(simhash.as_hex(F.lit(-1)).alias("a"), simhash.as_hex(F.lit(255)).alias("b")).first()
    assert (row.a, row.b) == ("f" * 16, "0" * 14 + "ff")
    assert hashlib.md5(b"").digest_size == 16
