"""Packing along a space-filling curve: documents that are alike come to stand in the same sequences.

Each document's token ids are hashed into a vector, damped, scaled to length one and projected to a few dimensions.
Over the whole corpus each dimension is centred and spread, its cell numbers give a place on a Hilbert curve, and the
documents are sorted by ranges along it. Their ids, one behind the other, are then cut into sequences: full ones, and
what is left at the very end into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranked_words import RankedEncoder
from tessera.llm.shared import erase, table, written

CAPACITY, END = 4096, 2
#: Buckets of the hashed vectors; dimensions of the curve and bits of each, together at most 62.
BUCKETS, DIMS, BITS = 256, 4, 15
#: Projected values are whole numbers of this unit, so that their sums don't depend on an order.
UNIT = 2**20
SEED = 20240613
ENCODED = "row long, doc_id long, n long, tie long, ids binary, " + ", ".join(f"p{k} long" for k in range(DIMS))
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _hashed(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token id, and the projection of buckets to dimensions."""
    mixed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    projection = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)) / np.sqrt(BUCKETS)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, np.where(mixed >> np.uint64(63), 1.0, -1.0), projection


def projected(ids: list[np.ndarray], hashed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Document by dimension, in units: signed counts of buckets, square roots of them, length one, projected. No ids: zeros."""
    bucket, sign, projection = hashed
    vectors = np.stack([np.bincount(bucket[x], weights=sign[x], minlength=BUCKETS) for x in ids]) if ids else np.zeros((0, BUCKETS))
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.rint(UNIT * (vectors / np.where(length > 0, length, 1)) @ projection).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points whose coordinates have ``bits`` bits each.

    Coordinates become the curve's transposed index in place: from the high bit down, a set bit inverts the lower bits
    of the first coordinate and a clear one exchanges them with its own; Gray decoding follows, then bits are woven.
    """
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for k in range(n):
            on = (x[k] & level) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        level >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, level = np.zeros_like(x[0]), top
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> bit) & 1)
    return key


def _encode(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """ENCODED: a row a document; ids are little-endian, of two bytes where the vocabulary allows it."""
    vocabulary = _vocabulary(tokenizer, end)
    kind = _kind(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, hashed = RankedEncoder.of(tokenizer), _hashed(vocabulary)
        for batch in batches:
            batch = batch.astype({"doc_id": "Int64"})
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [np.frombuffer(x, dtype="<u4") for x in encoder.ids(part["text"].tolist())]
                places = projected(ids, hashed)
                yield pd.DataFrame({
                    "row": part["row"].to_numpy(), "doc_id": part["doc_id"].array, "n": [len(x) + 1 for x in ids], "tie": part["tie"].to_numpy(),
                    "ids": [np.append(x, np.uint32(end)).astype(kind).tobytes() for x in ids], **{f"p{k}": places[:, k] for k in range(DIMS)},
                })
        encoder.forget()

    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return written(source.mapInPandas(encode, ENCODED), "curve-ids")


def _vocabulary(tokenizer: str, end: int) -> int:
    """One more than the largest id."""
    with open(tokenizer, encoding="utf-8") as f:
        made = json.load(f)
    return 1 + max([end, *made["model"]["vocab"].values(), *(t["id"] for t in made["added_tokens"])])


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 2**16 else "<u4"


def _curve(encoded: DataFrame) -> Column:
    """The place of a row of ENCODED on the curve: each dimension centred, spread by its deviation and cut into cells through a logistic curve."""
    wide = [F.col(f"p{k}").cast("decimal(20,0)") for k in range(DIMS)]
    sums = encoded.agg(F.count(F.lit(1)).alias("n"), *(F.sum(w).alias(f"s{k}") for k, w in enumerate(wide)), *(F.sum((w * w).cast("decimal(38,0)")).alias(f"q{k}") for k, w in enumerate(wide))).first()
    n = max(1, sums["n"])
    mean = np.array([int(sums[f"s{k}"] or 0) / n for k in range(DIMS)])
    spread = np.sqrt([max(0, int(sums[f"q{k}"] or 0) * n - int(sums[f"s{k}"] or 0) ** 2) / n**2 for k in range(DIMS)])

    @F.pandas_udf("long")
    def key(*places: pd.Series) -> pd.Series:
        points = np.stack([p.to_numpy(np.float64) for p in places], axis=1)
        z = (points - mean) / np.where(spread > 0, spread, 1)
        cells = np.minimum((2**BITS / (1 + np.exp(-1.7 * np.clip(z, -30, 30)))).astype(np.int64), 2**BITS - 1)
        return pd.Series(hilbert_keys(cells, BITS))

    return key(*(f"p{k}" for k in range(DIMS)))


def _starts(encoded: DataFrame) -> tuple[DataFrame, int]:
    """(row, at): how many ids stand before each document along the curve; and all ids there are.

    Documents are sorted by key, id, length and a hash of the text, so that a crowded place of the curve is spread over
    tasks too. Only numbers are sorted; a range's total is a number for each range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            yield pd.DataFrame({"row": batch["row"], "part": batch["part"], "local": total + np.cumsum(n) - n, "n": n})
            total += int(n.sum())

    order = ("key", "doc_id", "n", "tie", "row")
    small = written(encoded.select(_curve(encoded).alias("key"), "doc_id", "n", "tie", "row"), "curve-keys")
    ranged = small.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.spark_partition_id().alias("part"), "n")
    local = written(ranged.mapInPandas(run, "row long, part int, local long, n long"), "curve-local")
    erase(small)
    # A row for each range, of which there are as many as shuffle partitions.
    totals = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    offsets = encoded.sparkSession.createDataFrame(before, "part int, before long")
    starts = local.join(F.broadcast(offsets), "part").select("row", (F.col("local") + F.col("before")).alias("at"))
    return starts, total


def ends_of(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where the sequences behind the last full one end: the powers of two that make up what is left, the larger first."""
    left, at = total % capacity, total - total % capacity
    return [at := at + (1 << bit) for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset.

    docs needs doc_id and text, other columns are not read. A null or empty text is the single id ``end``. Every row is
    packed, repeated rows and null ids too; equal texts have one place on the curve, where ids decide. A document is cut
    where a sequence is full, a very long one as often as need be. All sequences but the last few hold ``capacity``
    ids; those hold powers of two. An empty table gives no pieces.
    """
    encoded = _encode(docs, tokenizer, end)
    starts, total = _starts(encoded)
    kind = _kind(_vocabulary(tokenizer, end))
    full = total // capacity
    last = np.array([full * capacity, *ends_of(total, capacity)], dtype=np.int64)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, start, length, data, tokens, sequence, offset = [], [], [], [], [], [], []
            for k, (at, raw) in enumerate(zip(batch["at"].tolist(), batch["ids"])):
                ids = np.frombuffer(raw, dtype=kind).astype("<u4")
                begin = 0
                while begin < len(ids):
                    place = at + begin
                    if place < full * capacity:
                        number = place // capacity
                        base, stop = number * capacity, (number + 1) * capacity
                    else:
                        slot = int(np.searchsorted(last, place, side="right"))
                        number, base, stop = full + slot - 1, int(last[slot - 1]), int(last[slot])
                    part = ids[begin : begin + stop - place]
                    doc.append(k)
                    start.append(begin)
                    length.append(len(part))
                    data.append(part.tobytes())
                    tokens.append(len(ids))
                    sequence.append(number)
                    offset.append(place - base)
                    begin += len(part)
            own = batch["doc_id"].astype("Int64")
            yield pd.DataFrame({"doc_id": own.iloc[doc].array, "start": start, "length": length, "ids": data, "doc_tokens": tokens, "sequence_id": sequence, "offset": offset})

    return encoded.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", "at", "ids").mapInPandas(cut, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all documents packed along the curve."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
