"""Mixing sources to target weights, with DataFrame functions only.

Every source is a permutation of its documents: a digest of the document is its place. The
permutation is cut into blocks of equal digest ranges. A source whose target is r times its
size gives floor(r) whole passes over its blocks and, in one more pass, the blocks of the
remaining quota. The block quotas of all sources are divided among the output shards by a
multivariate-hypergeometric splitting tree: the root holds all quotas, every node draws what
its left half gets, exactly as if the blocks had been shuffled, and the leaves are the shards.
A shard then takes its run of each source's blocks, disjoint from all others, and orders its
documents by a digest of its own.

Texts are read once for their sizes and are never shuffled. What decides about a document is
one small row of its source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.rows import WORD, column, fresh, stored

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCKS = 256  # of a source in one pass
FINER = 1024  # parts of the block in which a quota ends
SHARDS = 16
PLACE_DIGITS = 15  # hexadecimal digits of a place: 60 bits
PLACES = 16**PLACE_DIGITS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, text: Column) -> Column:
    """Where a document stands in the permutation of its source: 0 to 2**60 - 1."""
    named = F.concat_ws("|", key.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, PLACE_DIGITS), 16, 10).cast("long")


def _draw(seed: Column) -> Column:
    """A uniform number in [0, 1) from a digest."""
    digits = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 12), 16, 10).cast("double")
    return digits / F.lit(float(16**12))


def _log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, for small k."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(
        steps,
        F.lit(0.0),
        lambda total, i: total + F.log((n - k + i).cast("double") / i.cast("double")),
    )


def hypergeometric(marked: Column, others: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` items without replacement are marked, by inverting the distribution."""
    zero = F.lit(0).cast("long")
    least = F.greatest(zero, drawn - others)
    most = F.least(marked, drawn)
    start = F.exp(
        _log_choose(marked, least)
        + _log_choose(others, drawn - least)
        - _log_choose(marked + others, drawn)
    )
    state = F.struct(least.alias("k"), start.alias("p"), start.alias("upto"))

    def step(s: Column, k: Column) -> Column:
        factor = ((marked - k) * (drawn - k)).cast("double") / (
            (k + 1) * (others - drawn + k + 1)
        ).cast("double")
        p = s.p * factor
        return F.when(uniform < s.upto, s).otherwise(
            F.struct((k + 1).alias("k"), p.alias("p"), (s.upto + p).alias("upto"))
        )

    steps = F.when(most > least, F.sequence(least, most - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(steps, state, step, lambda s: F.least(s.k, most))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_passes: int = MOST_PASSES
) -> DataFrame:
    """`(source, source_size, target)` of `(source, size)` rows.

    Sources in order of their code points, null last, get the weights in turn and share the
    sum of all sizes. No target is above `most_passes` times its source's size; what is cut
    goes to the others by weight. The recipe is one row of all sources, so their number has
    to fit there; the rows of a source may be any number.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    sources = F.sort_array(
        F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "size"))
    )
    pattern = F.array(*[F.lit(w).cast("long") for w in weights])
    recipe = totals.agg(sources.alias("all")).select(
        F.transform(
            "all",
            lambda s, i: F.struct(
                s["source"].alias("source"),
                s["size"].alias("size"),
                F.element_at(pattern, (i % len(weights)) + 1).alias("weight"),
            ),
        ).alias("all")
    )
    # Those that reach their limit first are settled first; each leaves its rest to the others.
    by_limit = F.array_sort(
        "all",
        lambda a, b: F.when(a["size"] * b["weight"] < b["size"] * a["weight"], -1)
        .when(a["size"] * b["weight"] > b["size"] * a["weight"], 1)
        .otherwise(0),
    )
    start = F.struct(
        F.aggregate("all", F.lit(0).cast("long"), lambda t, s: t + s["size"]).alias("words"),
        F.aggregate("all", F.lit(0).cast("long"), lambda t, s: t + s["weight"]).alias("weights"),
    )

    def settle(state: Column, s: Column) -> Column:
        limit = s["size"] * most_passes
        above = (limit * state.weights) < (s["weight"] * state.words)
        return F.when(
            above,
            F.struct(
                (state.words - limit).alias("words"),
                (state.weights - s["weight"]).alias("weights"),
            ),
        ).otherwise(state)

    left = recipe.select("all", F.aggregate(by_limit, start, settle).alias("left"))
    share = (F.col("s.weight") * F.col("left.words")).cast("double") / F.col("left.weights")
    limit = (F.col("s.size") * most_passes).cast("double")
    return left.select(F.explode("all").alias("s"), "left").select(
        "s.source",
        F.col("s.size").alias("source_size"),
        F.when(F.col("s.size") == 0, 0.0).otherwise(F.least(share, limit)).alias("target"),
    )


def _cut(sizes: DataFrame, quotas: DataFrame) -> DataFrame:
    """`(source, cut)`: the places below `cut` hold the words of the quota, as near as can be.

    The place is narrowed down from block sums to sums of parts of one block, then to the
    documents of one part. Running sums go over the blocks, parts or documents of one source
    only, at most a few thousand rows each.
    """
    width = PLACES // BLOCKS
    finer = width // FINER
    placed = sizes.where("place is not null").select(
        "source", "size", "place", F.expr(f"place div {width}").alias("block")
    )
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("size"))
    runs = F.sort_array(F.collect_list(F.struct("block", "size")))

    def last_fit(found: str, quota: str, name: str) -> Column:
        """The first entry that does not fit in the quota, and what is left for it."""
        start = F.struct(
            F.col(quota).alias("left"), F.lit(None).cast("long").alias("at")
        )

        def step(state: Column, x: Column) -> Column:
            fits = state["at"].isNull() & (x["size"] <= state["left"])
            return (
                F.when(state["at"].isNotNull(), state)
                .when(fits, F.struct((state["left"] - x["size"]).alias("left"), state["at"].alias("at")))
                .otherwise(F.struct(state["left"].alias("left"), x[name].alias("at")))
            )

        return F.aggregate(found, start, step)

    by_block = (
        sums.groupBy("source")
        .agg(runs.alias("runs"))
        .join(quotas, F.col("source").eqNullSafe(F.col("q_source")))
        .select("source", last_fit("runs", "quota", "block").alias("s"))
        .select(
            F.col("source").alias("b_source"),
            F.col("s.left").alias("left"),
            F.coalesce("s.at", F.lit(BLOCKS).cast("long")).alias("b_block"),
        )
    )
    by_block = stored(by_block, "mix-blocks")
    inside = placed.join(
        by_block,
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")),
    )
    part = F.expr(f"place div {finer}")
    parts = inside.withColumn("part", part).groupBy("source", "b_block", "left", "part").agg(
        F.sum("size").alias("size")
    )
    by_part = (
        parts.groupBy("source", "b_block", "left")
        .agg(F.sort_array(F.collect_list(F.struct("part", "size"))).alias("runs"))
        .select("source", "b_block", last_fit("runs", "left", "part").alias("s"))
        .select(
            F.col("source").alias("p_source"), F.col("s.left").alias("p_left"), F.col("s.at").alias("p_part")
        )
    )
    by_part = stored(by_part, "mix-parts")
    last = inside.withColumn("part", part).join(
        by_part, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))
    )
    # Documents at one place are one entry; the nearer side of the entry that crosses is taken.
    at_place = last.groupBy("source", "p_left", "place").agg(F.sum("size").alias("size"))
    near = (
        at_place.groupBy("source", "p_left")
        .agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("runs"))
        .select("source", "p_left", "runs", last_fit("runs", "p_left", "place").alias("s"))
    )
    crossing = F.aggregate(
        "runs",
        F.lit(0).cast("long"),
        lambda t, x: F.when(x["place"] == F.col("s.at"), x["size"]).otherwise(t),
    )
    near = near.select(
        F.col("source").alias("n_source"),
        (F.col("s.at") + F.when(F.col("s.left") * 2 >= crossing, 1).otherwise(0)).alias("n_cut"),
    )
    return (
        by_block.join(near, F.col("b_source").eqNullSafe(F.col("n_source")), "left")
        .select(
            F.col("b_source").alias("c_source"),
            F.coalesce("n_cut", F.col("b_block") * width).alias("cut"),
        )
    )


def _shard_runs(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """`(source, runs)`: running block quotas of the shards, from the splitting tree."""
    root = plans.agg(
        F.sort_array(F.collect_list(F.struct("source", "blocks"))).alias("all")
    ).select(
        F.transform("all", lambda s: s["source"]).alias("sources"),
        F.transform("all", lambda s: s["blocks"]).alias("quotas"),
        F.lit(0).alias("first"),
        F.lit(shards).alias("width"),
    )
    node = root
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda t, q: t + q)
    while_wider = (shards - 1).bit_length()
    for _ in range(while_wider):
        half = F.expr("width div 2")
        node = node.withColumn("half", half).withColumn("total", total)
        node = node.withColumn("drawn", F.expr("total * half div width"))
        state = F.struct(
            F.col("total").alias("population"),
            F.col("drawn").alias("drawn"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def step(s: Column, entry: Column) -> Column:
            others = s.population - entry["quota"]
            uniform = _draw(
                F.concat_ws("|", F.lit(seed), F.col("first"), F.col("width"), entry["i"])
            )
            got = hypergeometric(entry["quota"], others, s.drawn, uniform)
            return F.struct(
                others.alias("population"),
                (s.drawn - got).alias("drawn"),
                F.concat(s.left, F.array(got)).alias("left"),
            )

        entries = F.transform(
            "quotas", lambda q, i: F.struct(q.alias("quota"), i.alias("i"))
        )
        left = F.aggregate(entries, state, step, lambda s: s.left)
        node = node.withColumn("left", left)
        right = F.zip_with("quotas", "left", lambda q, a: q - a)
        children = F.array(
            F.struct(
                F.col("left").alias("quotas"), F.col("first").alias("first"), F.col("half").alias("width")
            ),
            F.struct(
                right.alias("quotas"),
                (F.col("first") + F.col("half")).alias("first"),
                (F.col("width") - F.col("half")).alias("width"),
            ),
        )
        node = (
            node.select("sources", F.explode(children).alias("child"))
            .select("sources", "child.quotas", "child.first", "child.width")
            .where("width > 0")
        )
    leaves = node.select("first", F.explode(F.arrays_zip("sources", "quotas")).alias("z"))
    ordered = leaves.groupBy(F.col("z.sources").alias("r_source")).agg(
        F.sort_array(F.collect_list(F.struct("first", F.col("z.quotas").alias("quota")))).alias("q")
    )
    running = F.aggregate(
        "q",
        F.array(F.lit(0).cast("long")),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["quota"])),
    )
    return ordered.select("r_source", running.alias("runs"))


def recipe(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_passes: int = MOST_PASSES,
    shards: int = SHARDS,
    seed: int = 0,
) -> DataFrame:
    """One row a source: size, target, whole passes, the cut of the last one, runs of shards."""
    targets = stored(source_targets(sizes, weights, most_passes), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    passes = F.least(F.coalesce(ratio, F.lit(0)), F.lit(most_passes)).cast("long")
    rest = F.floor(F.col("target") - passes * F.col("source_size")).cast("long")
    planned = targets.select("source", "source_size", "target", passes.alias("passes"), rest.alias("quota"))
    cuts = _cut(sizes, planned.select(F.col("source").alias("q_source"), "quota"))
    cut = F.coalesce("cut", F.lit(0).cast("long"))
    last_blocks = F.expr(f"(cut_at + {PLACES // BLOCKS - 1}) div {PLACES // BLOCKS}")
    planned = (
        planned.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .withColumn("cut_at", F.when(F.col("passes") >= most_passes, 0).otherwise(cut))
        .select(
            "source", "source_size", "target", "passes", "cut_at",
            (F.col("passes") * BLOCKS + last_blocks).alias("blocks"),
        )
    )
    planned = stored(planned, "mix-plans")
    runs = _shard_runs(planned, shards, seed)
    whole = planned.join(runs, F.col("source").eqNullSafe(F.col("r_source")), "left")
    return stored(whole.drop("r_source", "blocks"), "mix-recipe")


def _draws(seed: int) -> Column:
    """The draws of a document: pass and shard, from its place and its source's recipe."""
    passes = F.col("_r.passes") + F.when(F.col("_place") < F.col("_r.cut_at"), 1).otherwise(0)
    block = F.expr(f"_place div {PLACES // BLOCKS}")

    def draw(number: Column) -> Column:
        # Whole passes turn the blocks by a step of their own; the last one keeps their order.
        turned = F.when(
            number < F.col("_r.passes"),
            (block * (2 * seed + 5) + number * 97 + seed) % BLOCKS,
        ).otherwise(block)
        entry = number * BLOCKS + turned
        shard = F.aggregate(
            F.slice("_r.runs", 2, F.size("_r.runs")),
            F.lit(0),
            lambda n, upto: n + F.when(upto <= entry, 1).otherwise(0),
        )
        return F.struct(number.cast("int").alias("pass"), shard.alias("shard"))

    numbers = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1))
    return F.coalesce(
        F.transform(numbers, draw), F.array().cast("array<struct<pass:int,shard:int>>")
    )


def planned_draws(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_passes: int = MOST_PASSES,
    shards: int = SHARDS,
    seed: int = 0,
    keep: bool = True,
) -> tuple[DataFrame, str]:
    """The rows of `docs` with one more column, and its name.

    The column is a struct of `size`, `source_size`, `target` and `draws`, an array with the
    pass and the shard of every copy that the mix takes of the document. With `keep` false the
    rows are the key and that column, made from the stored sizes without reading texts again.

    Words of a null text: 0. A null source is a source of its own, the last. Rows alike in id
    and text share a place, so the mix takes all of them or none in a pass; rows without an id
    are placed by their texts. Documents without words may be drawn and count nothing. An
    empty table gives an empty table.
    """
    narrow = stored(
        docs.select(
            column(key).alias("key"),
            column(source).alias("source"),
            n_words(column(text)).alias("size"),
            place(column(key), column(text)).alias("place"),
        ),
        "mix-sizes",
    )
    plan = recipe(narrow, weights, most_passes, shards, seed)
    plan = plan.select(F.col("source").alias("_source"), F.struct(*plan.columns).alias("_r"))
    added = fresh(docs, "_mix")
    if keep:
        rows = docs.select(
            F.struct(*[column(c) for c in docs.columns]).alias("_row"),
            column(source).alias("_of"),
            n_words(column(text)).alias("_size"),
            place(column(key), column(text)).alias("_place"),
        )
        out = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    else:
        rows = narrow.select(
            "key", F.col("source").alias("_of"), F.col("size").alias("_size"), F.col("place").alias("_place")
        )
        out = [F.col("key").alias(key)]
    mixed = F.struct(
        F.col("_size").alias("size"),
        F.col("_r.source_size").alias("source_size"),
        F.col("_r.target").alias("target"),
        _draws(seed).alias("draws"),
    )
    joined = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source")))
    return joined.select(*out, mixed.alias(added)), added


def mix(docs: DataFrame, *, seed: int = 0, **options: object) -> DataFrame:
    """The mixed corpus: a row of `docs` for every copy drawn, with the columns of `docs`."""
    planned, added = planned_draws(docs, seed=seed, **options)
    copy = fresh(planned, "_copy")
    drawn = planned.withColumn(copy, F.explode(column(added).getField("draws")))
    return drawn.select(*[column(c) for c in docs.columns])


def write_mix(docs: DataFrame, folder: str, *, seed: int = 0, shards: int = SHARDS, **options: object) -> None:
    """The mixed corpus as Parquet, one folder a shard, shuffled inside each shard."""
    planned, added = planned_draws(docs, seed=seed, shards=shards, **options)
    copy, order = fresh(planned, "_copy"), fresh(planned, "_order")
    drawn = planned.withColumn(copy, F.explode(column(added).getField("draws")))
    first = docs.columns[0]
    digest = F.xxhash64(F.lit(seed), column(copy).getField("pass"), *[column(c) for c in docs.columns])
    (
        drawn.withColumn(order, digest)
        .withColumn("shard", column(copy).getField("shard"))
        .repartition("shard", F.pmod(column(order), F.lit(8)))
        .sortWithinPartitions("shard", order, column(first))
        .select(*[column(c) for c in docs.columns if c != "shard"], "shard")
        .write.partitionBy("shard")
        .parquet(folder)
    )
