"""SimHash near-duplicates by multi-index hashing.

The 64 bits of every distinct fingerprint are cut into five blocks, and it is stored under each two of them. Of five blocks
fingerprints that differ in at most three bits share two, so they meet under one of ten keys, where the whole
distance is verified. Links join fingerprints, never documents: copies share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import UPPER, erase, free_name, table, written

SHINGLE, BITS, SEED = 3, 3, 42
#: Blocks of bits, of which two make a key; a key under which more than CROWD fingerprints are stored is divided further.
BLOCKS, CROWD = 5, 64
ROWS_A_FILE = 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it; repeats count, no words give zero."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    parts = [w.encode() for w in words]
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(parts) - shingle + 1)
    stops = ends[min(shingle, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist(), strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> Column:
    """A column of fingerprints as signed longs; a null text has no words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return of(F.coalesce(F.col(text), F.lit("")))


def _cells(width: int, rest: Column, key: Column) -> Column:
    """array<struct<key, rest>> for each two of the BLOCKS blocks of ``width`` open bits: a hash of key and both, and the bits still open.

    A hash that different blocks share only brings fingerprints together that are then held against each other and differ.
    """
    size = -(-width // BLOCKS)
    blocks = [F.shiftrightunsigned(rest, size * k).bitwiseAND(F.lit((1 << size) - 1)) for k in range(BLOCKS)]
    out = []
    for n, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        others = [F.shiftleft(b, size * at) for at, b in enumerate(blocks[k] for k in range(BLOCKS) if k not in (i, j))]
        left = others[0].bitwiseOR(others[1]).bitwiseOR(others[2])
        out.append(F.struct(F.xxhash64(key, F.lit(n), blocks[i], blocks[j]).alias("key"), left.alias("rest")))
    return F.array(*out)


def links(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``f`` in marks that differ in at most ``bits`` bits (up to 3).

    The first round stores each fingerprint under ten keys of 25 or 26 bits. Keys under which more than CROWD fingerprints are
    stored go to another round, where the key is kept and the other bits, 39, 24, 15 and 9 of them, are cut again. What is left to
    one key then differs in 6 bits only, so no key ever holds more than 64 fingerprints. A row between tasks is two longs.
    """
    if not 0 <= bits <= BLOCKS - 2:
        raise ValueError("two of five blocks are alike at distances up to 3")
    spots, found, width = marks.select("f", F.lit(0).cast("long").alias("key"), F.col("f").alias("rest")), None, 64
    while spots is not None:
        cells = spots.select("f", F.inline(_cells(width, F.col("rest"), F.col("key"))))
        left = 3 * -(-width // BLOCKS)
        small, spots, width = cells.select("key", "f"), None, left
        if 1 << left > CROWD:
            crowds = written(cells.groupBy("key").count().filter(F.col("count") > CROWD).select("key"), "simhash-crowds")
            if not crowds.isEmpty():
                small = small.join(crowds, "key", "left_anti")
                spots = written(cells.join(crowds, "key", "left_semi").select("f", "key", "rest"), "simhash-spots")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
        pairs = small.withColumnRenamed("f", "a").join(small.withColumnRenamed("f", "b"), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _files(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable along the edges (a, b), for every node with an edge.

    Large-star and small-star rounds: each node's larger, then smaller neighbours are hung on the smallest, until the
    edges are stars. Each step is written to the shared folder, in files of about ROWS_A_FILE rows: rounds never
    add edges, so the number before a round says how many files it needs. The least neighbours are tables of their own,
    so that both sides of each join are plain exchanges and a hub's edges are split over tasks.
    """
    edges = written(edges.filter("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "stars")
    rows, before = edges.count(), None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = written(_files(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), rows), "star-roots")
        large = written(_files(both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct(), rows), "stars")
        lower = written(_files(large.groupBy("u").agg(F.min("v").alias("m")), rows), "star-roots")
        small = large.join(lower, "u").filter("v != m").selectExpr("v AS u", "m AS v")
        hung = written(_files(small.unionByName(lower.selectExpr("u", "m AS v")).filter("u != v").distinct(), rows), "stars")
        erase(edges, least, large, lower)
        edges, now = hung, hung.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            out = edges.selectExpr("u AS node", "v AS root")
            out.path_written = edges.path_written
            return out
        rows, before = now[0], now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, text: str = "text") -> DataFrame:
    """docs without the text, with struct ``near``: fingerprint (signed long), component_id.

    component_id is the smallest doc_id reachable over links, its own included; null where no document of the group
    has an id. A null text, an empty one and one of white space have fingerprint zero and are linked like any other.
    A very long text is read whole, its hashes are counted in runs. Repeated rows get equal results and ties need no
    order, as only the smallest id counts; an empty table stays empty. Columns of docs stay; one named ``near`` is replaced.
    """
    mark = free_name(docs, "mark")
    marked = written(docs.withColumn(mark, fingerprints(docs, text, shingle)).drop(text, "near"), "simhash-marks")
    marks = marked.groupBy(F.col(mark).alias("f")).agg(F.min("doc_id").alias("least_id"))
    stars = components(links(marks.select("f"), bits))
    rooted = written(marks.join(stars, F.col("f") == F.col("node"), "left").select("f", "least_id", F.coalesce("root", "f").alias("root")), "simhash-roots")
    # Tables of their own, so that both sides of the joins are plain exchanges and a hot root or fingerprint is split.
    ids = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-ids")
    near = written(rooted.join(ids, "root").select(F.struct(F.col("f").alias("fingerprint"), "component_id").alias("near")), "simhash-near")
    erase(stars, rooted, ids)
    return marked.join(near, F.col(mark) == F.col("near.fingerprint")).drop(mark)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id, of equal ids one chosen by hash.

    Documents without an id stand behind all others; of equal rows one stays. An empty table stays empty.
    """
    # 128 bits stand for a row.
    key = F.struct(F.xxhash64(*docs.columns).alias("x"), F.xxhash64(F.lit(1), *docs.columns).alias("y"))
    rows = near_duplicates(docs.select("doc_id", "text", key.alias("key")), shingle, bits)
    # Groups without any id are told apart by fingerprint.
    first = rows.groupBy("near.component_id", F.when(F.col("near.component_id").isNull(), F.col("near.fingerprint")).alias("f")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("row")
    )
    kept = first.select(F.col("row.key").alias("kept"))
    own = free_name(docs, "key")
    return docs.withColumn(own, key).join(kept, F.col(own) == F.col("kept"), "left_semi").dropDuplicates([own]).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    docs = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("near.fingerprint"), 16, "0")).alias("fingerprint"), "near.component_id")
