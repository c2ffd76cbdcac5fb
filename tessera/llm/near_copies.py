"""Near copies by word shingles: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides. SimHash look-ups (``simhash.links``) meet sets whose fingerprints differ in three bits
at most. Sets of a similarity of 0.8 can differ in more bits than look-ups can enumerate, so a prefix filter finds the
rest: shingles have one order over the corpus, and two sets of that similarity share one of their first
n - ceil(0.8 n) + 1. Every candidate pair is held against its whole sets, so no pair is missed and none is taken on
trust. The order is from rare to common, by how many documents hold a shingle, then by hash: passages that many
documents share come last and bring no candidates together. Which shingles count as common decides about speed alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import UPPER, erase, free_name, written
from tessera.llm.simhash import components, links, majority

SHINGLE, SEED = 5, 42
#: How many documents hold a common shingle, and how many common ones, the commonest first, are shipped to tasks (9 bytes each).
COMMON, MOST_COMMON = 16, 2_000_000
#: Sets before it under its shingles that a set is compared with in the first pass: those of most shared shingles.
BESIDE = 6
#: Numbers of 64 bits in a set's sketch.
SKETCH = 16
#: Shingles counted in one group, and hashed before they are counted in a task.
COUNTED, HELD = 1_000_000, 2_000_000
#: Up to so many (counted) keys of sets to compare are broadcast to where the texts are; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of all runs of five words; of fewer words, of all of them; no words, none."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    run = min(SHINGLE, len(each))
    last = len(each) - run + 1
    out = np.zeros(last, dtype=np.uint64)
    for k in range(run):
        out = out * _STEP + each[k : k + last]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


class Common(NamedTuple):
    """Common shingles by sorted key (the first bits of the hash and its last 32), each with four times the logarithm of its count."""

    keys: np.ndarray
    classes: np.ndarray
    bits: int

    def classes_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.uint8)
        key = keys_of(hashes, self.bits)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.classes[at], 0)


def keys_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    high = hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)
    return high << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def prefix(own: np.ndarray, common: Common) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a sorted set, the commoner shingles behind the rarer ones."""
    n = len(own)
    if not n:
        return own
    return own[np.argsort(common.classes_of(own), kind="stable")][: n - (4 * n + 4) // 5 + 1]


def bitmap(own: np.ndarray) -> bytes:
    """A set's hashes as bits, one bit a hash or up to two: enough to tell most pairs apart without their sets."""
    bits = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    out = np.zeros(bits, dtype=bool)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH numbers whose bits say whether an odd number of a set's hashes falls to them: two sets' sketches differ in no more bits than the sets do in hashes."""
    odd = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def may_be_alike(p: bytes, q: bytes, n: int, m: int) -> bool:
    """False only where sets of n and m hashes with these bitmaps can't have a similarity of 0.8: bits that differ stand for hashes that only one has."""
    a, b = np.frombuffer(p, dtype=np.uint8), np.frombuffer(q, dtype=np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(np.bitwise_or.reduce(a.reshape(-1, size)) ^ np.bitwise_or.reduce(b.reshape(-1, size))).sum())
    return n + m >= 9 * differ


def common_shingles(docs: DataFrame) -> Common:
    """What stands in COMMON or more of all documents.

    Tasks count their own shingles first, 8 bytes a distinct one, so a very common one reaches its group once a task and
    run; groups are ranges of hashes, as many as keep one to about COUNTED shingles. A key has 32 bits and those of its
    range: one in some thousands is shared by two shingles, which moves them in the order and loses nothing.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, (chars // 6 // COUNTED).bit_length())

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        keys, number = np.unique(keys_of(np.concatenate(held), bits), return_counts=True)
        r = (keys >> np.uint64(32)).astype(np.int64)
        ends = np.flatnonzero(np.diff(r, append=-1)) + 1
        begins = np.concatenate(([0], ends[:-1]))
        parts = [(r[a], keys[a:b].astype("<u4").tobytes(), number[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
        return pd.DataFrame(parts, columns=["r", "keys", "number"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(shingles(text))
                size += len(held[-1])
                if size > HELD:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, dtype="<u4") for x in part["keys"]])
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], np.concatenate([np.frombuffer(x, dtype="<u4") for x in part["number"]])[order].astype(np.int64)
        begins = np.flatnonzero(np.diff(keys, prepend=np.uint32(~keys[0]))) if len(keys) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(number, begins) if len(begins) else number
        often = total >= COMMON
        return pd.DataFrame({"key": (int(part["r"].iloc[0]) << 32) + keys[begins][often].astype(np.int64), "n": total[often]})

    parts = docs.filter("text IS NOT NULL").select("text").mapInPandas(cut, "r long, keys binary, number binary")
    rows = parts.groupBy("r").applyInPandas(count, "key long, n long").orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas().sort_values("key")
    return Common(rows["key"].to_numpy(np.uint64), (4 * np.log2(np.maximum(1, rows["n"].to_numpy(np.float64)))).astype(np.uint8), bits)


def _marked(docs: DataFrame, common: Common) -> DataFrame:
    """(doc_id, x, y, node, n, f, bitmap, sketch, prefix) of docs (doc_id, x, y, text): node stands for a set, n is its size, f its SimHash."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t or "") for t in batch["text"]]
            out = batch[["doc_id", "x", "y"]].copy()
            out["node"] = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            out["n"] = [len(s) for s in sets]
            out["f"] = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            out["bitmap"] = [bitmap(s) for s in sets]
            out["sketch"] = [sketch(s) for s in sets]
            out["prefix"] = [prefix(s, shipped.value).view(np.int64) for s in sets]
            yield out

    return docs.mapInPandas(
        lambda batches: cut(b.astype({"doc_id": "Int64"}) for b in batches), "doc_id long, x long, y long, node long, n int, f long, bitmap binary, sketch array<long>, prefix array<long>"
    )


def _alike(pairs: DataFrame, sets: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more, from sets (node, x, y, n, bitmap) and texts (x, y, text).

    Bitmaps part most pairs; what they can't part is compared hash by hash, with the texts read again for those alone.
    """

    @F.pandas_udf("boolean")
    def close(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(*x) for x in zip(p, q, n.tolist(), m.tolist(), strict=True)], dtype=bool)

    @F.pandas_udf("binary")
    def body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t or "").tobytes() for t in batch], dtype=object)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> bool:
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            return 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q))

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype=bool)

    signs = sets.select("node", "n", "bitmap")
    met = pairs.join(signs.toDF("a", "n", "p"), "a").join(signs.toDF("b", "m", "q"), "b")
    met = written(met.filter("5 * least(n, m) >= 4 * greatest(n, m)").filter(close("p", "q", "n", "m")).select("a", "b"), "near-close")
    asked = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = written(sets.select("node", "x", "y").join(asked, "node"), "near-asked")
    keys = F.broadcast(asked) if asked.count() <= most else asked
    bodies = written(texts.join(keys, ["x", "y"]).select("node", "text").dropDuplicates(["node"]).select("node", body("text").alias("body")), "near-sets")
    both = met.join(bodies.toDF("a", "p"), "a").join(bodies.toDF("b", "q"), "b")
    edges = written(both.filter(alike("p", "q")).select("a", "b"), "near-edges")
    erase(met, asked, bodies)
    return edges


def _looked_up(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that SimHash look-ups meet: sets of one fingerprint with the least of them, and the least ones of linked fingerprints; and the table they are read from."""
    least = written(sets.groupBy("f").agg(F.min("node").alias("rep")), "near-fingerprints")
    same = sets.select("node", "f").join(least, "f").filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    linked = links(least.select("f"))
    reps = linked.join(least.toDF("a", "ra"), "a").join(least.toDF("b", "rb"), "b").selectExpr("least(ra, rb) AS a", "greatest(ra, rb) AS b")
    return same.unionByName(reps), least


def _stars(sets: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(node, root) of all sets that are linked.

    First every set is compared with what its fingerprint's look-up meets and with a few of those that stand before it
    under its shingles, by size; what is then joined is not compared again, so that large groups of near copies need no square of
    comparisons. Then all the others are that meet under a shingle and whose sketches do not part them there.
    """
    posted = sets.select("node", "n", F.posexplode("prefix").alias("at", "h"))
    order = Window.partitionBy("h").orderBy("n", "node")
    near = posted.select("h", "node", "n", "at", F.lag("node").over(order).alias("prev"), F.lag("n").over(order).alias("prev_n"), F.lead("node").over(order).alias("next"))
    meets = written(near.filter("prev IS NOT NULL OR next IS NOT NULL").drop("next"), "near-meets")
    # The nearest of them are enough to begin with: what they leave apart is compared below.
    beside = meets.filter("prev IS NOT NULL AND 5 * least(n, prev_n) >= 4 * greatest(n, prev_n)").groupBy("node", "prev").count()
    beside = beside.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "prev")), asc=False), 1, BESIDE).alias("some"))
    beside = beside.select("node", F.explode("some.prev").alias("prev")).selectExpr("least(node, prev) AS a", "greatest(node, prev) AS b")
    looked_up, least = _looked_up(sets)
    tried = written(beside.unionByName(looked_up).distinct(), "near-pairs")
    edges = _alike(tried, sets, texts, most)
    stars = components(edges)
    rooted = written(meets.join(stars, "node", "left").select("h", "node", "n", "at", F.coalesce("root", "node").alias("root")), "near-rooted")
    mixed = written(rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h"), "near-mixed")
    signs = [F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]
    open_ = written(rooted.join(mixed, "h").join(sets.select("node", *signs), "node"), "near-open")
    erase(meets, rooted, mixed, least)
    # Under the first shingle that two sets share, what stands before it in either is in one alone: that leaves few enough to be alike at most places.
    fits = F.expr("9 * least(l.n - l.at, r.n - r.at) >= 4 * (l.n + r.n)")
    # Sets of that similarity differ in a ninth of their hashes at most, and so do their sketches: the join itself parts all others.
    close = F.expr(f"9 * ({' + '.join(f'bit_count(l.s{k} ^ r.s{k})' for k in range(SKETCH))}) <= l.n + r.n")
    across = open_.alias("l").join(open_.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("l.root") < F.col("r.root")) & fits & close)
    rest = across.selectExpr("least(l.node, r.node) AS a", "greatest(l.node, r.node) AS b").distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = _alike(rest, sets, texts, most)
    erase(open_, tried, rest)
    return stars if more.isEmpty() else components(edges.unionByName(more))


def one_of_each(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without all but one document of each group of linked texts: the smallest doc_id stays, of equal ids one chosen by hash.

    Documents without an id stand behind all others; of equal rows one stays. Texts without words, null ones too, are
    one group. Very long texts take part whole. An empty table stays empty; docs' columns are returned, whatever their
    names.
    """
    # 128 bits stand for a row.
    x, y = F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), x.alias("x"), y.alias("y"), "text")
    marked = written(_marked(keyed, common_shingles(docs)), "near-marks")
    one = {c: F.first(c).alias(c) for c in ("n", "f", "bitmap", "sketch", "prefix")}
    sets = marked.groupBy("node").agg(F.min(F.struct("x", "y")).alias("row"), *one.values()).select("node", "row.x", "row.y", *one)
    sets = written(sets, "near-nodes")
    keys = written(marked.select("doc_id", "x", "y", "node"), "near-keys")
    erase(marked)
    stars = _stars(sets, keyed.select("x", "y", "text"), broadcast_rows)
    rooted = keys.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "x", "y")).alias("row"))
    kept = first.select(F.struct("row.x", "row.y").alias("kept"))
    own = free_name(docs, "key")
    key = F.struct(x.alias("x"), y.alias("y"))
    return docs.withColumn(own, key).join(kept, F.col(own) == F.col("kept"), "left_semi").dropDuplicates([own]).drop(own)
