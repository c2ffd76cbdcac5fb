"""Best-fit packing by length histogram: plan over counts, then give each piece its slot by rank within its length.

Pieces are tokenised and cut where the documents are; only their lengths are counted. The plan is made over the
histogram, at most one entry a length, and says for each length which ranks go to which sequences and offsets.
Then every piece takes the slot of its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import partitions, table, written
from tessera.llm.tokenizing import PieceEncoder

CAPACITY, END = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: ids of the text, then ``end``, cut into pieces of ``capacity``; only longer documents are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, step = PieceEncoder.of(tokenizer), 4 * capacity
        for batch in batches:
            doc, piece, start, length, crc, own = [], [], [], [], [], batch["doc_id"]
            for k, ids in enumerate(encoder.ids(batch["text"].tolist())):
                ids += end.to_bytes(4, "little")
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    doc.append(k)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": own.iloc[doc].to_numpy(), "piece": piece, "start": start, "length": length, "ids_crc32": crc})
        encoder.forget()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ids above 2^53 and null ids keep exact values: they travel as pandas' nullable integers.
    return texts.mapInPandas(lambda batches: cut(b.astype({"doc_id": "Int64"}) for b in batches), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over counts: rows (length, rank, count, each, sequence, offset).

    Pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go ``each`` to a sequence, from ``sequence``
    on, behind ``offset``. Sequences with one filling are one group: the fullest group with room takes as many pieces
    a sequence as fit, and splits where the pieces run out. So the work and the plan depend on the number of lengths,
    at most ``capacity``, and not on the number of pieces.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted, distinct
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, number of sequences)
    used = 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            each = room // length
            full, rest = min(number, left // each), 0
            if full:
                rows.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < number and left:
                rest = left
                rows.append((length, rank, rest, rest, first + full, capacity - room))
                rank, left = rank + rest, 0
                put(room - rest * length, first + full, 1)
                full += 1
            put(room, first + full, number - full)
    return pd.DataFrame(rows, columns=["length", "rank", "count", "each", "sequence", "offset"], dtype=np.int64)


def with_ranks(pieces: DataFrame) -> DataFrame:
    """pieces with ``rank``, from 0 without gaps within each length.

    A length may hold most of the rows, so each length is dealt over as many salts as there are shuffle partitions;
    a piece's rank is its place within length and salt behind the counts of the smaller salts.
    """
    salt, local, before = "salt", "local", "before"
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(partitions(pieces.sparkSession))))
    order = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "start", "ids_crc32")
    counts = salted.groupBy("length", salt).count()
    offsets = counts.select(
        "length", salt,
        (F.sum("count").over(Window.partitionBy("length").orderBy(salt)) - F.col("count")).alias(before),
    )
    ranked = salted.withColumn(local, F.row_number().over(order) - 1)
    return ranked.join(offsets, ["length", salt]).withColumn("rank", F.col(local) + F.col(before)).drop(salt, local, before)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text, other columns are not read. A null or empty text is the single id ``end``. Every row
    is packed, repeated rows and null ids too; pieces of equal length are interchangeable, their order by id is what
    decides. An empty table gives no pieces.
    """
    pieces = written(cut_pieces(docs, tokenizer, capacity, end), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    key = (plan["length"].to_numpy() << 44) + plan["rank"].to_numpy()
    by_key = np.argsort(key)
    shipped = docs.sparkSession.sparkContext.broadcast((key[by_key], plan.iloc[by_key].reset_index(drop=True)))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = shipped.value
        row = rows.iloc[np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1]
        within = rank.to_numpy() - row["rank"].to_numpy()
        each = row["each"].to_numpy()
        return pd.DataFrame({
            "sequence_id": row["sequence"].to_numpy() + within // each,
            "offset": row["offset"].to_numpy() + within % each * length.to_numpy(),
        })

    placed = with_ranks(pieces).withColumn("slot", slot("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents packed."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
