"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents in hashed order, more blocks the larger it is, so that a block is a small
part of a shard. The source's target says how many draws of its blocks the mix takes: whole passes over permuted
blocks, then the part of one more pass that stays under the target and the one block that fits the rest best.
The draws are split among the output shards down a binary tree: each node gives its left half a
multivariate-hypergeometric share of what it holds, so every shard is a uniform sample and every draw is used exactly
once. Sources are split in groups of bounded size, each by a tree of its own; every node is seeded by its place, so
runs of shards are planned apart. Sources, blocks and draws are tables throughout; nothing of them comes to the driver but sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, erase, free_name, table, written

WEIGHTS, MOST_PASSES, SEED = (5, 2, 1), 3, 20250101
WORDS_PER_SHARD = 4_000_000
#: A source has at least so many blocks, and more where they would hold over 1 / BLOCKS_PER_SHARD of a shard's words.
BLOCKS, BLOCKS_PER_SHARD = 4096, 64
#: Permuted blocks are summed in runs of about so many; sources of one tree; shards planned by one call.
RUN, GROUP, SHARDS_A_CALL = 4096, 1024, 256
#: Sources and the plan, a row for each block drawn: up to so many (counted) rows are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 500_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with source_no, from 0 by code point, null last: places in a sorted table, counted by partition."""
    order = sources.orderBy(F.col("source").isNull(), "source").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    order = written(order, "mix-order")
    parts = order.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from_"))
    # a row for each partition
    before = parts.selectExpr("part", "from_", "sum(n) OVER (ORDER BY part) - n AS before")
    return order.join(F.broadcast(before), "part").selectExpr("source", "source_size", "before + at - from_ AS source_no")


def water_level(sizes: DataFrame, most: int = MOST_PASSES) -> tuple[int, int]:
    """(words, weight) whose ratio times a source's weight is its target, of (source_size, weight), unless that is above ``most`` times its size.

    Each round closes the sources that their share overfills and reshares the rest; a round is one aggregate, and only its sums come
    to the driver. The level never falls, so what is closed stays closed.
    """
    first = sizes.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    total, weight = int(first[0] or 0), int(first[1] or 0)
    level = (total, weight)
    while level[1]:
        full = _full(level, most)
        got = sizes.filter("source_size > 0").agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - most * int(got[0] or 0), int(got[1] or 0))
        if now == level or not now[1]:
            break
        level = now
    return level


def _full(level: tuple[int, int], most: int) -> Column:
    return F.expr(f"cast(source_size AS decimal(20,0)) * {most * level[1]} < cast(weight AS decimal(9,0)) * {level[0]}")


def shard_shares(quota: np.ndarray, low: int, high: int, shards: int, seed: int = SEED, group: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first draw, number of draws) of each source for the shards in [low, high): their paths from the root of the splitting tree."""
    total, held = int(quota.sum()), [(0, shards, 1, np.zeros_like(quota), quota.copy())]
    while held:
        a, b, node, first, own = held.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, own
            continue
        mid = (a + b) // 2
        takes = mid * total // shards - a * total // shards
        left = np.random.default_rng((seed, group, node)).multivariate_hypergeometric(own, takes, method="marginals")
        held.append((mid, b, 2 * node + 1, first + left, own - left))
        held.append((a, mid, 2 * node, first, left))


def shard_share(quota: np.ndarray, shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, number of draws) of each source in one shard."""
    return next(shard_shares(quota, shard, shard + 1, shards, seed))[1:]


def _drawn(blocks: DataFrame, sources: DataFrame, most: int, seed: int) -> DataFrame:
    """(source_no, block, pass, draw): draws are numbered from 0 in each source, in the order in which the mix takes them."""
    passes = F.expr(f"explode(sequence(0, least({most} - 1, cast(floor(target / source_size) AS int))))").alias("pass")
    spread = (
        blocks.join(sources.drop("source"), "source_no").filter("source_size > 0")
        .select("source_no", "block", "words", "source_size", "target", "n_blocks", passes)
        .withColumn("u", F.shiftrightunsigned(F.xxhash64("block", "source_no", "pass", F.lit(seed)), 1))
        # by order of u, in runs of about RUN blocks
        .withColumn("runs", F.expr(f"cast(ceil(n_blocks / {RUN}) AS int)"))
        .withColumn("run", F.expr("least(runs - 1, cast(u / 9223372036854775808D * runs AS int))"))
    )
    spread = written(spread.select("source_no", "pass", "run", "u", "block", "words", "source_size", "target"), "mix-spread")
    runs = spread.groupBy("source_no", "pass", "run").agg(F.sum("words").alias("run_words"), F.count(F.lit(1)).alias("run_n"))
    over = "OVER (PARTITION BY source_no, pass ORDER BY run)"
    runs = runs.selectExpr("source_no", "pass", "run", f"sum(run_words) {over} - run_words AS words_before", f"sum(run_n) {over} - run_n AS n_before", "sum(run_n) OVER (PARTITION BY source_no, pass) AS of")
    runs = written(runs, "mix-runs")
    inner = "OVER (PARTITION BY source_no, pass, run ORDER BY u, block)"
    placed = spread.selectExpr("*", f"row_number() {inner} - 1 AS at_run", f"sum(words) {inner} AS through_run").join(runs, ["source_no", "pass", "run"])
    placed = placed.selectExpr("source_no", "pass", "block", "words", "source_size", "target", "of", "n_before + at_run AS at", "pass * source_size + words_before + through_run AS through")
    placed = written(placed.withColumn("inside", F.expr("through <= target")), "mix-placed")
    # of the blocks beyond the target, the one that fits the gap best closes it
    ends = written(placed.groupBy("source_no", "pass").agg(
        F.expr("first(target) - max(IF(inside, through, pass * source_size)) AS gap"), F.expr("count_if(inside) AS n")
    ), "mix-ends")
    last = placed.filter("NOT inside").join(ends, ["source_no", "pass"]).groupBy("source_no", "pass").agg(F.expr("min(struct(abs(words - gap) AS off, block AS block)) AS last"))
    ends = written(ends.join(last, ["source_no", "pass"], "left"), "mix-ends")
    drawn = (
        placed.join(ends, ["source_no", "pass"])
        .filter("inside OR (block = last.block AND last.off < gap)")
        .selectExpr("source_no", "block", "pass", "pass * of + IF(inside, at, n) AS draw")
    )
    drawn = written(drawn, "mix-draws")
    erase(spread, runs, placed)
    return drawn


def _owners(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, draw): who gets which draw."""
    quotas = drawn.groupBy("source_no").count().groupBy(F.expr(f"source_no div {GROUP}").alias("g"))
    quotas = quotas.agg(F.sort_array(F.collect_list(F.struct("source_no", "count"))).alias("own"))
    calls = quotas.select("g", "own", F.explode(F.expr(f"sequence(0L, {shards}L - 1, {SHARDS_A_CALL}L)")).alias("low")).repartition("g", "low")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, own, low in zip(batch["g"], batch["own"], batch["low"], strict=True):
                number = np.array([x["source_no"] for x in own], dtype=np.int64)
                quota = np.array([x["count"] for x in own], dtype=np.int64)
                for shard, first, n in shard_shares(quota, int(low), min(int(low) + SHARDS_A_CALL, shards), shards, seed, int(g)):
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"source_no": number[some], "shard": shard, "first": first[some], "number": n[some]})

    shares = calls.mapInPandas(split, "source_no long, shard long, first long, number long")
    return shares.selectExpr("source_no", "shard", "explode(sequence(first, first + number - 1)) AS draw")


def place(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    most: int = MOST_PASSES,
    seed: int = SEED,
    words_per_shard: int = WORDS_PER_SHARD,
    out: str = "mix",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """docs with struct ``out``: size, source_size, target, placements array<struct<pass, shard, place>>.

    The mix takes a document once for each placement, ``place`` orders a shard. Sources by code point, null last,
    take the weights in turn; there may be any number of them. A null text has size 0, a very long one is one document
    of its block and is counted whole. Documents equal in doc_id and text share a block, and a place too, where equal rows
    are interchangeable; a source without words has target 0 and no placements; an empty table stays empty. Columns of
    docs stay; one named as ``out`` is replaced. Reruns agree, whatever the partitions.
    """
    size, key, block, held, own = (free_name(docs, n) for n in ("size", "hash", "block", "info", "plan"))
    hashed = F.xxhash64("doc_id", "text", F.lit(seed)) if "doc_id" in docs.columns else F.xxhash64("text", F.lit(seed))
    marked = docs.withColumns({size: n_words(F.col("text")), key: hashed})
    sized = written(marked.select("source", F.col(key).alias("h"), F.col(size).alias("words")), "mix-sizes")
    numbered = _numbered(sized.groupBy("source").agg(F.sum("words").alias("source_size")))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sizes = written(numbered.withColumn("weight", turn), "mix-numbered")
    level = water_level(sizes, most)
    share = F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1] or 1))
    target = F.when(F.col("source_size") == 0, 0.0).when(_full(level, most), most * F.col("source_size")).otherwise(share).cast("double")
    n_blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("source_size") * BLOCKS_PER_SHARD / words_per_shard)).cast("long")
    sources = written(sizes.select("source", "source_no", "source_size", target.alias("target"), n_blocks.alias("n_blocks")), "mix-sources")
    sums = sources.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    shards, near = max(1, -(-int(sums[0] or 0) // words_per_shard)), sums[1] <= broadcast_rows
    known = F.broadcast(sources) if near else sources
    blocks = (
        sized.join(known, sized["source"].eqNullSafe(sources["source"]))
        .select("source_no", F.pmod("h", "n_blocks").alias("block"), "words").groupBy("source_no", "block").agg(F.sum("words").alias("words"))
    )
    blocks = written(blocks, "mix-blocks")
    erase(sized, sizes)
    drawn = _drawn(blocks, sources, most, seed)
    plan = drawn.join(_owners(drawn, shards, seed), ["source_no", "draw"]).groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    plan = written(plan, "mix-plan")
    erase(blocks, drawn)
    info = sources.select(F.struct("*").alias(held))
    marked = marked.join(F.broadcast(info) if near else info, F.col("source").eqNullSafe(F.col(f"{held}.source")))
    marked = marked.withColumn(block, F.pmod(F.col(key), F.col(f"{held}.n_blocks")))
    slots = plan.select(F.struct("*").alias(own))
    slots = F.broadcast(slots) if plan.count() <= broadcast_rows else slots
    joined = marked.join(slots, (F.col(f"{held}.source_no") == F.col(f"{own}.source_no")) & (F.col(block) == F.col(f"{own}.block")), "left")
    same = F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns])
    spots = F.transform(
        F.coalesce(F.col(f"{own}.draws"), F.array().cast("array<struct<pass:int,shard:bigint>>")),
        lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(same, d["pass"], F.lit(seed)).alias("place")),
    )
    mix = F.struct(F.col(size).alias("size"), F.col(f"{held}.source_size").alias("source_size"), F.col(f"{held}.target").alias("target"), spots.alias("placements"))
    return joined.withColumn(out, mix).drop(size, key, block, held, own)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each placement, a partition for each run of shards, shuffled within each shard."""
    mix, spot = free_name(docs, "mix"), free_name(docs, "spot")
    placed = place(docs, out=mix, **options)
    rows = placed.select(*docs.columns, F.explode(F.col(f"{mix}.placements")).alias(spot))
    return rows.repartition(f"{spot}.shard").sortWithinPartitions(f"{spot}.shard", f"{spot}.place").drop(spot)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what the mix takes of every document."""
    docs = place(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.size("mix.placements")).alias("taken"))
