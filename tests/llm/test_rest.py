"""Mixing, archives, top-k search and the pipeline."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from helpers import empty, odd, odd_rows
from veilscan.llm import archive, mixing, rows, topk


def targets(sizes, weights=(5, 2, 1)):
    """Round by round: give shares, cut what is above three times the size, share the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        found = {s: 3 * sizes[s] if s in capped else weight[s] * left / total for s in order}
        above = {s for s in order if found[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return found
        capped |= above


def test_targets_and_near_quotas(spark):
    made = random.Random(8)
    data = []
    for i in range(3000):
        source = made.choice(["a"] * 20 + ["b", "c", "d", None])
        data.append((i, "w " * made.randint(0, 60), "", source, 0, 0, 0, ""))
    planned, added = mixing.planned_draws(odd(spark, data))
    found = planned.select("doc_id", "source", f"{added}.*").collect()
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(r[1].split())
    expected = targets(sizes)
    taken = Counter()
    for r in found:
        assert math.isclose(r.target, expected[r.source], rel_tol=1e-12)
        assert r.source_size == sizes[r.source] and len(r.draws) <= 3
        taken[r.source] += r.size * len(r.draws)
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 31
    shards = Counter(d.shard for r in found for d in r.draws)
    assert set(shards) == set(range(mixing.SHARDS))
    again, name = mixing.planned_draws(odd(spark, data).repartition(5))
    assert sorted((r.doc_id, str(r[name].draws)) for r in again.collect()) == sorted(
        (r.doc_id, str(r.draws)) for r in found
    )


def test_quotas_of_shards_are_exact(spark):
    plans = spark.createDataFrame([("a", 700), ("b", 3), (None, 256), ("z", 0)], "source string, blocks long")
    for shards in (1, 3, 16):
        found = {r.r_source: r.runs for r in mixing._shard_runs(plans, shards, 1).collect()}
        for source, blocks in (("a", 700), ("b", 3), (None, 256), ("z", 0)):
            assert len(found[source]) == shards + 1
            assert found[source][0] == 0 and found[source][-1] == blocks
            assert found[source] == sorted(found[source])
        sizes = [sum(r[i + 1] - r[i] for r in found.values()) for i in range(shards)]
        assert max(sizes) - min(sizes) <= math.ceil(math.log2(max(2, shards)))


def test_hypergeometric_distribution(spark):
    draws = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    long = lambda x: F.lit(x).cast("long")
    found = Counter(
        r.k for r in draws.select(mixing.hypergeometric(long(7), long(13), long(8), F.col("u")).alias("k")).collect()
    )
    for k in range(8):
        share = math.comb(7, k) * math.comb(13, 8 - k) / math.comb(20, 8)
        assert abs(found[k] / 4000 - share) < 0.001


def test_mix_of_odd_rows(spark):
    planned, added = mixing.planned_draws(odd(spark))
    assert planned.count() == len(odd_rows())
    mixed = mixing.mix(odd(spark))
    assert mixed.columns == odd(spark).columns
    wanted = planned.select(F.sum(F.size(f"{added}.draws"))).first()[0]
    assert mixed.count() == wanted
    folder = rows.new_folder(spark, "mix")
    mixing.write_mix(odd(spark), folder)
    assert spark.read.parquet(folder).count() == wanted
    assert mixing.mix(empty(spark)).count() == 0


PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3\r\nX-Bad: 1", "same"), (9, None, "same"), (4, "u", None),
    (2, "u", ""), (7, "u", "é" * 3000), (8, "u", "é" * 3000), (3, "again", "same"), (None, "n", "same"),
    (None, "n", "alone"), (-1, "u", "other"),
]


def pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("x"))


def test_archive(spark):
    folder = rows.new_folder(spark, "archive")
    archive.write_archive(pages(spark), folder)
    firsts = defaultdict(list)
    for page, _, html in PAGES:
        firsts[html or ""].append(page)
    expected = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p in firsts[html or ""] if p is not None), default=None)
        response = page == first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((page, len(data), digest, "response" if response else "revisit", None if response else first))
    found = archive.read_archive(spark, folder)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert archive.read_payloads(spark, folder).count() == len(firsts)
    whole = archive.read_records(spark, folder).collect()
    assert len(whole) == len(PAGES)
    for r in whole:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert "X-Bad" not in fields and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(fields["Content-Length"])
        if fields["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(rest[:-4]).digest()).decode()
            assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"


def test_archive_limits(spark):
    folder = rows.new_folder(spark, "archive")
    archive.write_archive(pages(spark), folder, least_bytes=100)
    kinds = {(r.page_id, r.record_type) for r in archive.read_archive(spark, folder).collect()}
    assert (9, "response") in kinds and (8, "revisit") in kinds
    folder = rows.new_folder(spark, "archive")
    archive.write_archive(pages(spark, []), folder)
    assert archive.read_archive(spark, folder).count() == 0


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score long, rank int").repartition(3)


def test_top_k(spark):
    made = np.random.default_rng(3)
    data = [(i, [float(x) for x in made.normal(0, 0.2, 20)], 0, 0) for i in range(400)]
    data += [(1000 + i, data[100][1], 0, 0) for i in range(30)]  # ties
    data += [(2000, None, 0, 0), (2100, [1.0, None], 0, 0), (2200, [float("nan")] * 20, 0, 0),
             (2300, [float("inf")] * 20, 0, 0), (2400, [], 0, 0), (2401, [], 0, 0), (2500, [0.5, 0.25], 0, 0),
             (2600, [0.1, -3.0], 0, 0), (None, [1.0] * 20, 0, 0), (2700, [3e38] * 20, 0, 0),
             (100, data[100][1], 0, 0)]
    whole = []
    for i, (name, v, *_) in enumerate(data):
        if name is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            whole.append((i, name, [math.floor(1024 * float(np.float32(x))) for x in v]))
    expected = []
    for i, name, v in whole:
        if name % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), n, j) for j, n, w in whole if j != i and len(w) == len(v)]
        scores = [(max(-(2**63), min(2**63 - 1, s)), n, j) for s, n, j in scores]
        for rank, (s, n, _) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:10], 1):
            expected.append((name, rank, n, s))
    found = topk.nearest(vectors(spark, data), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    nothing = topk.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0)
    assert nothing.count() == 0


def test_bounds_are_never_too_low():
    made = np.random.default_rng(5)
    block = np.floor(made.normal(0, 300, (200, 37)))
    stats = topk.Statistics(block)
    exact = topk.exact_scores(block[0], block)
    for least in np.quantile(exact, [0.1, 0.5, 0.95, 1.0]):
        alive, scores = topk.scores_above(block[0], stats, 0, block, stats, least)
        assert set(np.flatnonzero(exact >= least)) <= set(alive.tolist())
        assert (scores == exact[alive]).all()


def test_pipeline(spark, tables):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "source_mix", "byte_bpe",
    ]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = rows.stored(stage(spark, seen, tables), name)
        assert seen.columns == columns
    done = corpus_pipeline.run(spark, tables)
    left = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in done.collect()} == left
    assert done.count() == seen.count()
    assert all(r.n_tokens == len(r.ids) for r in done.collect())
