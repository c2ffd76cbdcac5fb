"""Hybrid retrieval over batches of queries: lexical, exact and vector lists, fusion, diversification.

Every operator maps a table of queries and the corpus to candidates (query_id, doc_id, scores); a query is never
answered by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import compact, tokens, whole
from tessera.functions.vector import as_double, usable
from tessera.sources.tables import spread, stored

RRF_K = 50
#: Tables of queries and of their words up to so many (counted) rows ride along in every task; beyond it they are shuffled or taken in blocks.
BROADCAST_QUERIES = 10_000
#: Scores of texts and queries that a task holds at once; a task's memory follows from it.
CELLS = 500_000


def small(queries: DataFrame, n: int) -> DataFrame:
    """queries with a broadcast hint where their counted number allows it."""
    return F.broadcast(queries) if n <= BROADCAST_QUERIES else queries


def query_tokens(queries: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    return queries.select(key, F.explode(tokens(F.col(text))).alias("token"))


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """queries in parts of about BROADCAST_QUERIES, which are small enough to be shipped to tasks."""
    n = max(1, -(-queries.count() // BROADCAST_QUERIES))
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else queries for k in range(n)]


def question_index(corpus: DataFrame, words: Sequence[str]) -> DataFrame:
    """(doc_id, n_tokens, held): of every text the places in ``words`` of the words that it holds, as a table.

    The corpus is cut into tokens once; what no query asks for is gone before anything is written. Tokens stay Arrow
    buffers in a task: as Python strings those of a batch took most of its memory.
    """
    shipped = corpus.sparkSession.sparkContext.broadcast(list(words))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shipped.value, pa.string())
        for batch in batches:
            listed = batch.column("tokens")
            ends, own = listed.offsets.to_numpy(), listed.flatten()
            place = pc.index_in(own, value_set=asked.cast(own.type))
            before = np.concatenate(([0], np.cumsum(place.is_valid().to_numpy(zero_copy_only=False))))
            held = pa.ListArray.from_arrays(pa.array(before[ends - ends[0]], pa.int32()), place.drop_null())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int32()), held], ["doc_id", "n_tokens", "held"])

    listed = spread(corpus.filter("doc_id IS NOT NULL").select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("tokens"))
    kind = corpus.schema["doc_id"].dataType.simpleString()
    return stored(listed.mapInArrow(kept, f"doc_id {kind}, n_tokens int, held array<int>"), "question-index")


def lexical(corpus: DataFrame, queries: DataFrame, k: int = 24) -> DataFrame:
    """The k best texts of each query by TF-IDF: the sum of idf over shared tokens, each over the text's tokens.

    The queries, in parts of bounded size, go to the texts as lists of (query, idf) by token; a task adds up what each of its
    texts scores for all queries and passes on the k best of each query, so no pair of query and text is shuffled that
    can't be among them. Texts without id take no part. The lists are a table: however often a plan reads them, the texts are passed once.
    """
    n, found = corpus.count(), None
    kinds = [corpus.select("doc_id").schema[0], queries.select("query_id").schema[0]]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType()), T.StructField("n_matched", T.LongType())])
    for block in _blocks(queries):
        asked = query_tokens(block).distinct().toPandas()
        words, ids = sorted(set(asked["token"])), asked["query_id"].drop_duplicates().tolist()
        index = question_index(corpus, words)
        df = np.zeros(len(words), dtype=np.int64)
        for r in index.select(F.explode("held").alias("w")).groupBy("w").count().collect():
            df[r["w"]] = r["count"]
        place, who = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
        word, query = asked["token"].map(place).to_numpy(np.int64), asked["query_id"].map(who).to_numpy(np.int64)
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(words) + 1))
        shipped = corpus.sparkSession.sparkContext.broadcast((ids, ends, query[order], np.log((n + 1) / (df + 1))[word[order]] + 1))

        def score(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, ends, query, weight = shipped.value
            rows = max(1, CELLS // max(1, len(ids)))
            for batch in batches:
                for at in range(0, len(batch), rows):
                    part = batch.iloc[at : at + rows]
                    sums, met = np.zeros((len(part), len(ids))), np.zeros((len(part), len(ids)), dtype=np.int64)
                    for r, (size, held) in enumerate(zip(part["n_tokens"], part["held"], strict=True)):
                        if len(held):
                            spot = np.concatenate([np.arange(ends[w], ends[w + 1]) for w in held])
                            sums[r] = np.bincount(query[spot], weight[spot], len(ids)) / size
                            met[r] = np.bincount(query[spot], minlength=len(ids))
                    q, d = np.nonzero(met.T)
                    points, doc = np.round(sums[d, q], 9), part["doc_id"].to_numpy()[d]
                    best = np.lexsort((np.unique(doc, return_inverse=True)[1], -points, q))
                    best = best[np.arange(len(best)) - np.searchsorted(q[best], q[best]) < k]
                    yield pd.DataFrame({"doc_id": doc[best], "query_id": [ids[i] for i in q[best]], "score": points[best], "n_matched": met[d, q][best]})

        part = index.mapInPandas(score, schema)
        found = part if found is None else found.unionByName(part)
    return stored(ranked(found.select("query_id", "doc_id", "score", "n_matched"), k, "score"), "lexical-lists")


def ranked(scored: DataFrame, k: int, *by: str, per: Sequence[str] = ("query_id",)) -> DataFrame:
    """scored with ``rank``, the k best of each group; ties to the smaller doc_id."""
    order = Window.partitionBy(*per).orderBy(*[F.desc(c) for c in by], "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(corpus: DataFrame, queries: DataFrame, k: int = 24, shortest: int = 2) -> DataFrame:
    """Texts that contain a query's whole wording, white space and signs aside: 28 points, 12 more in the same spelling.

    Every wording of at least ``shortest`` characters is looked for at every place of every text: the wordings of up to BROADCAST_QUERIES queries
    form one automaton that passes over a compact text once. Larger batches of queries are taken in blocks. The lists are a table.
    """
    asked = queries.select("query_id", "question", compact(F.col("question")).alias("wanted")).filter(F.length("wanted") >= shortest)
    kind = corpus.select("doc_id").schema.fields + asked.select("query_id").schema.fields
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kind] + [T.StructField("score", T.DoubleType())])
    texts, found = spread(corpus.select("doc_id", "text")).select("doc_id", "text", compact(F.col("text")).alias("compact")), None
    for block in _blocks(asked):
        rows = block.collect()

        def search(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            words = ahocorasick.Automaton()
            for n, r in enumerate(rows):
                words.add_word(r["wanted"], [*words.get(r["wanted"], []), n])
            if rows:
                words.make_automaton()
            for batch in batches:
                out = []
                for doc, text, low in zip(batch["doc_id"], batch["text"], batch["compact"], strict=True):
                    met = {n for _, held in words.iter(low) for n in held} if rows else ()
                    out += [(doc, rows[n]["query_id"], 40.0 if rows[n]["question"] in (text or "") else 28.0) for n in met]
                yield pd.DataFrame(out, columns=["doc_id", "query_id", "score"])

        part = texts.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return stored(ranked(found.select("query_id", "doc_id", "score"), k, "score"), "exact-lists")


def vector(corpus: DataFrame, queries: DataFrame, k: int = 48) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest positive cosines of each query vector, itself excepted; ties to the smaller doc_id.

    Queries go to the corpus in blocks as matrices, one for each length of vectors. A task multiplies its rows with a
    matrix, keeps of each query the k best so far and drops what is below the last of them at once, so that it passes on k rows
    a query at most. Vectors that are null, empty, zero or hold a null or non-finite entry take no part, nor do rows without id.
    """
    def scaled(df: DataFrame, key: str) -> DataFrame:
        return df.filter(usable(F.col("embedding")) & F.col(key).isNotNull()).select(key, as_double(F.col("embedding")).alias("v"))

    kinds = [queries.select("query_id").schema.fields[0], corpus.select("doc_id").schema.fields[0]]
    schema, found = T.StructType([*kinds, T.StructField("score", T.DoubleType())]), None
    for block in _blocks(queries):
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        rows = scaled(block, "query_id").collect()
        for size in {len(r["v"]) for r in rows}:
            own = [r for r in rows if len(r["v"]) == size]
            by_size[size] = ([r["query_id"] for r in own], _unit(np.array([r["v"] for r in own])))
        shipped = corpus.sparkSession.sparkContext.broadcast(by_size)

        def score(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                sizes = batch["v"].map(len).to_numpy()
                for size, (ids, matrix) in shipped.value.items():
                    part = batch[sizes == size]
                    step = max(1, CELLS // len(ids))
                    for at in range(0, len(part), step):
                        some = part.iloc[at : at + step]
                        docs, points = some["doc_id"].to_numpy(), np.round(_unit(np.stack(some["v"].to_numpy())) @ matrix.T, 12)  # equal vectors have equal scores
                        q, d, s = best.get(size, (np.zeros(0, dtype=np.int64), docs[:0], np.zeros(0)))
                        number = np.bincount(q, minlength=len(ids))
                        floor = np.where(number >= k, np.append(s, 0.0)[np.cumsum(number) - 1], 0.0)
                        r, c = np.nonzero((points > 0) & (points >= floor) & (docs[:, None] != np.array(ids, dtype=object)[None, :]))
                        q, d, s = np.concatenate((q, c)), np.concatenate((d, docs[r])), np.concatenate((s, points[r, c]))
                        order = np.lexsort((np.unique(d, return_inverse=True)[1], -s, q))
                        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
                        best[size] = q[order], d[order], s[order]
            for size, (q, d, s) in best.items():
                yield pd.DataFrame({"query_id": [shipped.value[size][0][i] for i in q], "doc_id": d, "score": s})

        part = spread(scaled(corpus, "doc_id")).mapInPandas(score, schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, "score")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def fused(lists: dict[str, DataFrame], k: int = 24, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (rrf_k + rank) over the lists, with each list's score kept."""
    parts = [df.select("query_id", "doc_id", F.lit(name).alias("list"), "score", "rank") for name, df in lists.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    scores = [F.max(F.when(F.col("list") == name, F.col("score"))).alias(f"{name}_score") for name in lists]
    one = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    return ranked(union.groupBy("query_id", "doc_id").agg(F.round(F.sum(one), 9).alias("fused"), F.count(F.lit(1)).alias("n_lists"), *scores), k, "fused")


def capped(candidates: DataFrame, group: str, most: int, defer: bool) -> DataFrame:
    """At most ``most`` candidates of a group in a query's list; the others are dropped, or put behind the rest (defer)."""
    place = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    marked = candidates.withColumn("deferred", place > most)
    if not defer:
        return marked.filter(~F.col("deferred")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("deferred")
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("deferred", "rank")))


def confidence(score: Column) -> Column:
    return F.when(score >= 72, "high").when(score >= 42, "medium").when(score >= 25, "low").otherwise("none")


def contains_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: whole(text).contains(t))
