"""Reports on an index: coverage, chunk policies, sections and their windows, issues by code, path and type, missing vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import whole

# --- fixed values: chunk sizes in characters ----------------------------------------------------
OVERSIZED_CHUNK, SHORT_CHUNK = 2400, 32
# ------------------------------------------------------------------------------------------------


def share(part: Column, of: Column, digits: int = 4) -> Column:
    """part / of, rounded; 0 where there is nothing to divide by."""
    return F.when(of > 0, F.round(part / of, digits)).otherwise(0.0)


def counted(rows: DataFrame, per: str, name: str, n: str = "n") -> DataFrame:
    """(per, by_<name>, n): "name=number" pairs of each group, sorted by name. Rows are counted before names meet in one row."""
    by = rows.groupBy(per, name).agg(F.count(F.lit(1)).alias(n))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(name, n))), lambda s: F.concat_ws("=", s[name], s[n].cast("string")))
    return by.groupBy(per).agg(F.array_join(pairs, ",").alias(f"by_{name}"), F.sum(n).alias(n))


def coverage(entries: DataFrame, embedded: str = "n_embedded", chunks: str = "n_chunks") -> DataFrame:
    """One row: embedded chunks, chunks, and their ratio; zeros for an empty table."""
    sums = entries.agg(F.coalesce(F.sum(embedded), F.lit(0)).alias(embedded), F.coalesce(F.sum(chunks), F.lit(0)).alias(chunks))
    return sums.withColumn("ratio", share(F.col(embedded), F.col(chunks)))


def index_row(entries: DataFrame, storage: str = "parquet") -> DataFrame:
    """The row that describes an index: files, chunks, embedded chunks, files by mode, and where it is kept."""
    modes = [F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in ("integrated", "evaluation")]
    return entries.agg(F.count(F.lit(1)).alias("n_files"), *modes, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_chunks", "n_embedded")]).withColumn("storage", F.lit(storage))


def domain_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(column, place, n) for every member of a fixed domain in its order, zeros included; members are few and given."""
    names = rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(domain)], f"place int, {column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, column, "left").select(column, "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def label_value(labels: Column, prefix: str, default: str) -> Column:
    """What follows ``prefix`` in the first label that begins with it."""
    held = F.try_element_at(F.filter(labels, lambda x: x.startswith(prefix)), F.lit(1))
    return F.coalesce(F.substring(held, len(prefix) + 1, 1 << 30), F.lit(default))


def is_protected(labels: Column, group: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda x: x.startswith("chunk-protected:")), F.lit(False)) | (whole(group) != "")


def is_checklist(labels: Column, flag: Column) -> Column:
    return F.coalesce(F.array_contains(labels, "chunk-protected:checklist"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def policy_report(chunks: DataFrame, text: str = "text") -> DataFrame:
    """A row a chunk policy: chunks, protected, checklists, oversized, short ones that nothing protects, and boundary reasons.

    chunks has labels, list_group, checklist and a text; chunks without a policy are "unclassified".
    """
    t = whole(F.col(text))
    safe = is_protected(F.col("labels"), F.col("list_group"))
    bare = F.length(F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")))
    rows = chunks.select(
        label_value(F.col("labels"), "chunk-policy:", "unclassified").alias("policy"), label_value(F.col("labels"), "chunk-boundary:", "unknown").alias("reason"), safe.alias("n_protected"),
        is_checklist(F.col("labels"), F.col("checklist")).alias("n_checklist"), (F.length(t) > OVERSIZED_CHUNK).alias("n_oversized"), ((bare > 0) & (bare < SHORT_CHUNK) & ~safe).alias("n_short"),
    )
    flags = ("n_protected", "n_checklist", "n_oversized", "n_short")
    by = rows.groupBy("policy", "reason").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f) for f in flags])
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda s: F.concat_ws("=", s["reason"], s["n"].cast("string")))
    return by.groupBy("policy").agg(F.sum("n").alias("n_chunks"), *[F.sum(f).alias(f) for f in flags], F.array_join(reasons, ",").alias("reasons"))


def parents(chunks: DataFrame, doc: str = "doc_id", section: str = "section", index: str = "window_index") -> DataFrame:
    """(doc, section, n, first, last, n_expandable, n_neighbours) of sections: distinct windows, those with a neighbour, and their neighbours."""
    rows = chunks.select(doc, section, index).dropna().distinct()
    w = Window.partitionBy(doc, section).orderBy(index)
    near = rows.select(doc, section, index, F.coalesce((F.col(index) - F.lag(index).over(w) == 1).cast("int"), F.lit(0)).alias("p"), F.coalesce((F.lead(index).over(w) - F.col(index) == 1).cast("int"), F.lit(0)).alias("x"))
    return near.groupBy(doc, section).agg(
        F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"), F.sum(F.greatest("p", "x")).alias("n_expandable"), F.sum(F.col("p") + F.col("x")).alias("n_neighbours")
    )


def parent_summary(sections: DataFrame) -> DataFrame:
    return sections.agg(
        F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("n") > 1).alias("n_multi"), F.count_if(F.col("n") == 1).alias("n_isolated"), F.coalesce(F.round(F.sum("n") / F.count(F.lit(1)), 1), F.lit(0.0)).alias("mean_chunks"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most_chunks"), F.coalesce(F.sum("n_expandable"), F.lit(0)).alias("n_expandable"), F.coalesce(F.sum("n_neighbours"), F.lit(0)).alias("n_neighbours"),
    )


def largest_parents(sections: DataFrame, most: int = 10, doc: str = "doc_id", section: str = "section") -> DataFrame:
    """The sections of the most windows, a report's top list."""
    return sections.orderBy(F.desc("n"), doc, section).limit(most).select(doc, section, "n", "first", "last")


def type_report(entries: DataFrame, issues: DataFrame, kind: str = "source_type", doc: str = "doc_id") -> DataFrame:
    """A row a type: documents, chunks, embedded chunks, ratios, issues and issues by code.

    Issues are joined to their documents' types once; a document without issues counts for its type all the same.
    """
    of = counted(issues.join(entries.select(doc, kind), doc), kind, "code", "n_issues")
    by = entries.groupBy(kind).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_embedded").alias("n_embedded"))
    return by.join(of, kind, "left").select(
        kind, "n_documents", "n_chunks", "n_embedded", share(F.col("n_embedded"), F.col("n_chunks")).alias("coverage"), share(F.col("n_chunks"), F.col("n_documents")).alias("mean_chunks"),
        F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("by_code", F.lit("")).alias("by_code"),
    )


def missing_vectors(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, n_chunks, n_embedded, n_missing, reasons, retry) from chunks with embedded and reason: which documents are to be embedded again."""
    lost = chunks.filter(~F.coalesce("embedded", F.lit(False))).select(doc, F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")).alias("reason"))
    by = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("embedded").alias("n_embedded"))
    return by.join(counted(lost, doc, "reason", "n_lost"), doc, "left").select(
        doc, "n_chunks", "n_embedded", (F.col("n_chunks") - F.col("n_embedded")).alias("n_missing"), F.coalesce("by_reason", F.lit("")).alias("reasons"), (F.col("n_chunks") > F.col("n_embedded")).alias("retry")
    )


def log_summary(log: DataFrame, signals: str = "signals") -> DataFrame:
    """(signal, n) of a log's review signals, with all rows under "total" and those with any signal under "review"."""
    names = F.concat(F.array(F.lit("total")), F.when(F.size(signals) > 0, F.array(F.lit("review"))).otherwise(F.array().cast("array<string>")), F.coalesce(signals, F.array().cast("array<string>")))
    return log.select(F.explode(names).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
