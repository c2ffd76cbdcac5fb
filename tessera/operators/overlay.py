"""Search over a corpus and what has changed since it was indexed: documents put in place of others, added or taken away.

The base keeps its token index. A change is a row (doc_id, text, seq); a null text takes the document away, of several rows
the last counts. Document frequencies follow from the base's by the changed documents alone: what their old texts
held goes, what their new texts hold comes. So a batch of changes costs what it touches, and lists equal those of an
index built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import idf, postings
from tessera.operators.manifest import latest
from tessera.operators.retrieval import query_tokens, ranked
from tessera.sources.snapshots import Snapshots
from tessera.sources.tables import stored

UNIT = 1e17


def current(changes: DataFrame) -> DataFrame:
    """(doc_id, text): of each changed document its last row; changes without id don't count."""
    return latest(changes.filter("doc_id IS NOT NULL"), "doc_id", "seq").select("doc_id", "text")


def overlaid(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base (doc_id, text) with delta (``current``) laid over it."""
    return base.select("doc_id", "text").join(delta.select("doc_id"), "doc_id", "left_anti").unionByName(delta.filter("text IS NOT NULL").select("doc_id", "text"))


def added(delta: DataFrame) -> DataFrame:
    """The postings of delta's own texts."""
    return postings(delta.filter("text IS NOT NULL"), "doc_id", "text")


def frequency_change(posted: DataFrame, delta: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """(token, change): what delta does to the document frequencies of posted, the base's postings (doc_id, token, n_tokens); new: ``added``, where it is there already."""
    gone = posted.join(delta.select("doc_id"), "doc_id", "left_semi").select("token", F.lit(-1).alias("d"))
    new = (added(delta) if new is None else new).select("token", F.lit(1).alias("d"))
    return gone.unionByName(new).groupBy("token").agg(F.sum("d").alias("change")).filter("change <> 0")


def frequencies(df: DataFrame, change: DataFrame) -> DataFrame:
    """(token, df) after a change; tokens that no document holds any more are gone."""
    both = df.join(change, "token", "full_outer").select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("change", F.lit(0))).cast("long").alias("df"))
    return both.filter("df > 0")


def posted_after(posted: DataFrame, delta: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The postings after a change."""
    return posted.join(delta.select("doc_id"), "doc_id", "left_anti").unionByName(added(delta) if new is None else new)


def asked_for(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings, or frequencies, of tokens that a query holds."""
    return posted.join(query_tokens(queries).select("token").distinct(), "token", "left_semi")


def search(posted: DataFrame, df: DataFrame, n: int, queries: DataFrame, k: int = 24) -> DataFrame:
    """The k best texts of each query by TF-IDF, from postings, frequencies and the number of texts: ``retrieval.lexical``'s lists.

    Only tokens that a query holds are looked at. A text's postings meet the weighted questions in one task, which ranks its texts
    for each query before anything else is shuffled. Scores add up as whole numbers of 1e-17, so their order doesn't matter;
    a text's score is at most the largest idf, which keeps sums within a long.
    """
    weighted = query_tokens(queries).distinct().join(df, "token").select("token", "query_id", idf(F.col("df"), F.lit(n)).alias("weight"))
    asked = stored(weighted, "overlay-questions")
    own = asked_for(posted, queries).repartition("doc_id")
    score = F.sum((F.col("weight") / F.col("n_tokens") * UNIT + 0.5).cast("long")) / UNIT
    met = own.join(asked, "token").groupBy("query_id", "doc_id").agg(score.alias("s"), F.count(F.lit(1)).alias("n_matched"))
    return ranked(met.select("query_id", "doc_id", F.round("s", 9).alias("score"), "n_matched"), k, "score")


class OverlayIndex:
    """A token index that follows a stream of changes: postings and frequencies as versioned tables, changed where a batch touches them.

    ``apply`` is a foreachBatch function. The batch's number is kept with each table's rows of state, so a batch that is
    run again after a failure changes nothing twice: frequencies are set to values that follow from the postings of
    the version before, never added to in place.
    """

    POSTED = "doc_id long, token string, n_tokens int"
    FREQUENCIES = "token string, df long"

    def __init__(self, spark, folder: str) -> None:
        kind = lambda ddl: spark.createDataFrame([], ddl).schema
        self.spark = spark
        self.posted = Snapshots(spark, f"{folder}/posted", kind(self.POSTED), "doc_id")
        self.df = Snapshots(spark, f"{folder}/frequencies", kind(self.FREQUENCIES), "token")
        self.done = Snapshots(spark, f"{folder}/done", kind("batch long, posted long, df long, n long"), "batch", 1)

    def state(self) -> tuple[int, int, int, int]:
        """(last batch, version of postings, version of frequencies, number of documents) of what is whole."""
        row = self.done.read().orderBy(F.desc("batch")).first()
        return tuple(row) if row else (-1, 0, 0, 0)

    def _read(self, table: Snapshots, version: int) -> DataFrame:
        return table.read(version) if version else self.spark.createDataFrame([], table.schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        last, posted_at, df_at, n = self.state()
        if batch <= last:
            return
        delta = current(changes)
        posted, df = self._read(self.posted, posted_at), self._read(self.df, df_at)
        change = frequency_change(posted, delta)
        touched = change.join(df, "token", "left").select("token", (F.coalesce("df", F.lit(0)) + F.col("change")).cast("long").alias("df"))
        held = posted.join(delta.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct().count()
        new = postings(delta.filter("text IS NOT NULL"), "doc_id", "text").withColumn("n_tokens", F.col("n_tokens").cast("int"))
        added = new.select("doc_id").distinct().count()
        df_next = self.df.change(touched.filter("df > 0"), touched.filter("df <= 0")) if df_at == (self.df.versions() or [0])[-1] else self._again(self.df, df_at, touched.filter("df > 0"), touched)
        posted_next = self.posted.change(new, delta) if posted_at == (self.posted.versions() or [0])[-1] else self._again(self.posted, posted_at, new, delta)
        row = self.spark.createDataFrame([(batch, posted_next, df_next, n - held + added)], self.done.schema)
        self.done.change(row)

    def _again(self, table: Snapshots, version: int, rows: DataFrame, keys: DataFrame) -> int:
        """After a failure between two tables: the change on the version that counts, as a whole new version."""
        return table.write(self._read(table, version).join(keys.select(table.key).distinct(), table.key, "left_anti").unionByName(rows.select(*table.schema.names)))

    def search(self, queries: DataFrame, k: int = 24) -> DataFrame:
        _, posted_at, df_at, n = self.state()
        return search(self._read(self.posted, posted_at), self._read(self.df, df_at), n, queries, k)
