"""Substring dedup by hashing lines and the sentences in them.

Every text is cut into units: lines, and within a line the stretches up to a sentence end, and runs of short lines. The
digests of the normalised units are grouped over the whole corpus; the first occurrence by document and place stays,
all others are removed, and their offsets in the original text are kept. Every line is a unit, however short; a short
one on its own is boilerplate only where it stands often enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import erase, free_name, table, written

#: A stretch of fewer words ends no unit: the next sentence goes with it, and the next short line.
MIN_WORDS = 6
#: A line of fewer words than that repeats by chance ("and.", "of the"); its repeats go where it stands so often in the corpus.
SHORT_REPEATS = 3
_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE_END = re.compile(r"(?<![.!?])[.!?]++[\"'”’)\]]*+\s++|(?<![。！？])[。！？]++[\"'”’)」』]*+\s*+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNITS = "k1 long, k2 long, start int, stop int, d1 long, d2 long, short boolean"


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, stop, normalised) of the units of at least min_words words, by start.

    A unit ends with its line, or behind the first sentence end at which it has min_words words; where it begins
    depends on the sentences just before alone, so a passage has the same units wherever it stands. Of lines that are
    shorter, each begins a unit that takes as many of the short lines right behind it as it needs; those overlap.
    Two characters of a script without spaces count as a word.
    """
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None

    def size(part: str) -> int:
        return len(part.split()) + (len(_UNSPACED.findall(part)) // 2 if unspaced else 0)

    short: list[tuple[int, int, int]] = []
    for line in _LINE.finditer(text):
        at, end = line.span()
        if at == end:
            continue
        n = size(text[at:end])
        if n < min_words:
            if n:
                short.append((at, end, n))
            continue
        yield from _windows(text, short, min_words)
        short = []
        begin = last = at
        for mark in _SENTENCE_END.finditer(text, at, end):
            long_enough, last = size(text[last : mark.end()]) >= min_words, mark.end()
            if long_enough:
                yield begin, last, " ".join(text[begin:last].split()).lower()
                begin = last
        if size(text[begin:end]) >= min_words:
            yield begin, end, " ".join(text[begin:end].split()).lower()
    yield from _windows(text, short, min_words)


def _windows(text: str, short: list[tuple[int, int, int]], min_words: int) -> Iterator[tuple[int, int, str]]:
    """From each of the lines (start, stop, words) on, the fewest with min_words words together."""
    k = held = 0
    for start, _, n in short:
        while held < min_words and k < len(short):
            held += short[k][2]
            k += 1
        if held < min_words:
            return
        stop = short[k - 1][1]
        yield start, stop, " ".join(text[start:stop].split()).lower()
        held -= n


def short_lines(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, stop, normalised) of the lines of fewer than min_words words, blank ones aside, by start."""
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None
    for line in _LINE.finditer(text):
        words = line[0].split()
        if words and len(words) + (len(_UNSPACED.findall(line[0])) // 2 if unspaced else 0) < min_words:
            yield *line.span(), " ".join(words).lower()


def unit_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a unit of docs (k1, k2, text): its document's key, its span, its digest of 128 bits, whether it is a short line."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        names = ["k1", "k2", "start", "stop", "d1", "d2", "short"]
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, text in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["text"].tolist(), strict=True):
                for short, found in ((False, units(text, min_words)), (True, short_lines(text, min_words))):
                    for start, stop, unit in found:
                        digest = xxhash.xxh3_128_intdigest(unit.encode())
                        rows.append((k1, k2, start, stop, signed(digest >> 64), signed(digest & ((1 << 64) - 1)), short))
                        if len(rows) > 100_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(cut, UNITS)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """text without the sorted spans, which may overlap."""

    def cut(t: str | None, own) -> str | None:
        if t is None or own is None or not len(own):
            return t
        out, at = [], 0
        for s in own:
            out.append(t[at : s["start"]])
            at = max(at, s["stop"])
        return "".join([*out, t[at:]])

    return pd.Series([cut(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, short_repeats: int = SHORT_REPEATS, out: str = "dedup") -> DataFrame:
    """docs with struct ``out``: text (what stays), removed array<struct<start, stop, doc_id>>.

    Offsets are code points of the original text, spans of short lines may overlap; doc_id says where the first
    occurrence is. Occurrences are ranked by doc_id, documents without one last, then by a hash of the row, then by
    place; so repeats inside one document go too. Units are compared lower-cased with white space collapsed. Units of
    min_words words or more go from their second occurrence on; a line of fewer words on its own does so if the corpus has it
    short_repeats times or more. A null text stays null, an empty one has no units; very long texts are cut whole, their
    units are rows of their own. Rows equal in doc_id and text are one document and get equal results. An empty table
    stays empty. Columns of docs stay; one named as ``out`` is replaced.
    """
    k1, k2, own = (free_name(docs, n) for n in ("k1", "k2", "spans"))
    of1, of2 = free_name(docs, "of1"), free_name(docs, "of2")
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit(1), "text", "doc_id")})
    cells = unit_rows(keyed.filter("text IS NOT NULL").select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text"), min_words)
    cells = written(cells, "units")
    # A digest on its own is no repeat; the documents' order is needed for the others only.
    # Digests are tables of their own, so that both sides of each join are plain exchanges and a hot digest is split.
    often = F.count(F.lit(1)) >= F.when(F.first("short"), short_repeats).otherwise(2)
    firsts = written(cells.groupBy("d1", "d2", "short").agg(often.alias("often")).filter("often").select("d1", "d2", "short"), "repeat-digests")
    repeated = written(cells.join(firsts, ["d1", "d2", "short"]), "repeats")
    erase(cells, firsts)
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    owners = repeated.select("k1", "k2").distinct()
    known = written(owners.join(ids, ["k1", "k2"]).distinct(), "repeat-owners")
    ranked = repeated.join(known, ["k1", "k2"]).withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "start"))
    first = written(ranked.groupBy("d1", "d2", "short").agg(F.min("rank").alias("first")), "repeat-firsts")
    later = ranked.join(first, ["d1", "d2", "short"]).filter("rank != first").select("k1", "k2", F.struct("start", "stop", F.col("first.doc_id").alias("doc_id")).alias("span"))
    spans = later.distinct().groupBy(F.col("k1").alias(of1), F.col("k2").alias(of2)).agg(F.sort_array(F.collect_list("span")).alias(own))
    joined = keyed.join(spans, (F.col(k1) == F.col(of1)) & (F.col(k2) == F.col(of2)), "left")
    none = F.array().cast("array<struct<start:int,stop:int,doc_id:bigint>>")
    removed = F.coalesce(own, none)
    return joined.withColumn(out, F.struct(_without(F.col("text"), removed).alias("text"), removed.alias("removed"))).drop(k1, k2, of1, of2, own)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document with what stays of its text and what was removed from it."""
    docs = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce((F.length("text") - F.length("dedup.text")).cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", F.col("dedup.text").alias("text"), "dedup.removed", F.size("dedup.removed").alias("n_removed"), removed.alias("chars_removed"))
