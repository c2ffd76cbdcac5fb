"""Other names of documents: candidates from names, titles, headings, questions and test cases, each once a document with its best source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.automaton import occurrences
from tessera.functions.text import BLANKS, as_sql, lowered, title_key, whole

# --- fixed values: scores, words and patterns that decide results -------------------------------
SOURCE_SCORES = {"benchmark-question": 1.0, "heading": 0.9, "qa-question": 0.85, "benchmark-expected-doc": 0.8, "document-title": 0.75, "file-title": 0.7}
TITLE_NOISE = ("붙임", "첨부", "게시용", "최종게시용", "최종", "업로드본", "정리본", "전문", "개정", "일부", "관련", "안내")
CLEANING = (
    (r"(?i)\.(md|txt)$", ""), ("_+", " "), ("[“”\"'`]", ""), (r"^\s*(?:[-*•‣▪▫■□]+|[0-9]{1,2}[.)]|[①-⑳])\s*", ""), (r"^\s*\((?:붙임|첨부)\)\s*", ""), (r"^\s*(?:붙임|첨부)\s*[0-9]*[_\-\s]*", ""), (r"(?i)\bENC\b", ""), (r"\s+", " "),
)
COMPACT = r"[\s　._\-()\[\]{}<>「」『』,;:'\"\\/|·ㆍ¸]+"
FRAGMENT_CUT = r"[\s_()\[\],·ㆍ¸]+"
QUESTION = r"(?i)^\s*(?:질문|문|q)\s*[:.)：-]?\s*(.+\?)?\s*(.*)$"
SHORTEST, LONGEST, MOST_WORDS = 3, 90, 12
# ------------------------------------------------------------------------------------------------


def clean_alias(text: Column) -> Column:
    out = whole(text)
    for pattern, by in CLEANING:
        out = F.regexp_replace(out, as_sql(pattern), by)
    return F.btrim(out, F.lit(BLANKS))


def compact_alias(text: Column) -> Column:
    return lowered(F.regexp_replace(text, as_sql(COMPACT), ""))


def is_useful(alias: Column, dense: Column | None = None) -> Column:
    """Long enough, not a number, year or address, not a sentence; ``dense`` is the alias's compact form, where it is there already."""
    dense = compact_alias(alias) if dense is None else dense
    return (F.length(dense) >= SHORTEST) & ~dense.rlike(as_sql("^[0-9]+$")) & ~dense.rlike(as_sql("^20[0-9]{2}년?$")) & ~alias.rlike("(?iu)https?://") & (F.length(alias) <= LONGEST) & (F.size(F.split(alias, as_sql(r"\s+"))) <= MOST_WORDS)


def questions_in(text: Column) -> Column:
    """The questions of lines that begin as one, as they stand: candidates are cleaned once, where all sources meet; a second cleaning takes off one more number in front."""
    question = as_sql(QUESTION)
    lines = F.filter(F.split(whole(text), "\n", -1), lambda x: x.rlike(question))
    asked = F.transform(lines, lambda x: F.concat_ws(" ", F.nullif(F.regexp_extract(x, question, 1), F.lit("")), F.nullif(F.regexp_extract(x, question, 2), F.lit(""))))
    return F.filter(asked, lambda q: q != "")


def title_fragments(title: Column) -> Column:
    """The parts of a clean title that can stand for it: useful ones that aren't noise, of four characters or two of Hangul."""
    parts = F.transform(F.split(title, as_sql(FRAGMENT_CUT), -1), clean_alias)
    return F.filter(parts, lambda p: is_useful(p) & ~p.isin(*TITLE_NOISE) & ((F.length(p) >= 4) | p.rlike("[가-힣]{2,}")))


def expected_documents(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, doc_id): the document that a case expects: the first, by id, whose title holds the expected name or is held by it.

    Names meet titles by two automata, one over each side, so no case meets all documents. An empty name or title fits nothing.
    """
    wanted = cases.select("case_id", title_key(F.col("expected")).alias("key")).filter("key <> ''")
    titles = files.select("doc_id", title_key(F.col("name")).alias("title")).filter("title <> '' AND doc_id IS NOT NULL")
    inside = occurrences(titles, wanted.select(F.col("key").alias("expression")), "doc_id", "title", whole=False).join(wanted.withColumnRenamed("key", "expression"), "expression").select("case_id", "doc_id")
    around = occurrences(wanted, titles.select(F.col("title").alias("expression")), "case_id", "key", whole=False).join(titles.withColumnRenamed("title", "expression"), "expression").select("case_id", "doc_id")
    return inside.unionByName(around).groupBy("case_id").agg(F.min("doc_id").alias("doc_id"))


def candidates(files: DataFrame, chunks: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical, alias, key, source, score, evidence): every other name of a document once, with its best source; ties to the first in order.

    files are (doc_id, name, path), chunks (doc_id, chunk_id, title, section_title, section_path, text), cases (case_id, expected,
    question). Documents are told apart by id; chunks of others, and rows without id, don't count.
    """
    own = files.filter("doc_id IS NOT NULL").select("doc_id", clean_alias(F.col("name")).alias("canonical"), F.col("name").alias("file_name"), "path")
    row = lambda alias, source, evidence: F.struct(alias.alias("alias"), F.lit(source).alias("source"), evidence.cast("string").alias("evidence"))
    c = F.col
    # cleaned before they are rows: a filter on the rows reads the alias, where it would clean a projected one once for each test
    plain = lambda parts: F.transform(parts, lambda x: F.struct(clean_alias(x["alias"]).alias("alias"), x["source"].alias("source"), x["evidence"].alias("evidence")))
    listed = lambda parts: F.posexplode_outer(F.transform(plain(parts), lambda x: x.withField("key", compact_alias(x["alias"])))).alias("k", "c")
    title = F.concat(F.lit("title-fragment:"), c("canonical"))
    of_files = own.select("doc_id", F.lit(0).alias("part"), F.lit("").alias("order"), listed(F.concat(F.array(row(c("file_name"), "file-title", c("path"))), F.transform(title_fragments(c("canonical")), lambda p: row(p, "heading", title)))))
    many = lambda values, source: F.transform(values, lambda v: row(v, source, c("chunk_id")))
    trail = F.coalesce(F.slice("section_path", 2, 1_000_000), F.array().cast("array<string>"))
    told = F.concat(F.array(row(c("title"), "document-title", c("chunk_id")), row(c("section_title"), "heading", c("chunk_id"))), many(trail, "heading"), many(questions_in(c("text")), "qa-question"))
    of_chunks = chunks.select("doc_id", F.lit(1).alias("part"), c("chunk_id").cast("string").alias("order"), listed(told)).join(own.select("doc_id"), "doc_id", "left_semi")
    rows = of_files.unionByName(of_chunks)
    if cases is not None:
        met = cases.join(expected_documents(cases, files), "case_id")
        rows = rows.unionByName(met.select("doc_id", F.lit(2).alias("part"), c("case_id").cast("string").alias("order"), listed(F.array(row(c("expected"), "benchmark-expected-doc", c("case_id")), row(c("question"), "benchmark-question", c("case_id"))))))
    score = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv]), c("source"))
    clean = rows.select("doc_id", F.struct("part", "order", "k").alias("turn"), "c.alias", "c.key", "c.source", "c.evidence").filter(is_useful(c("alias"), c("key"))).withColumn("score", score)
    best = clean.groupBy("doc_id", "key").agg(F.min(F.struct((-c("score")).alias("minus"), "turn", "alias", "source", "evidence")).alias("b"))
    return best.join(own.select("doc_id", "canonical"), "doc_id").select("doc_id", "canonical", "b.alias", "key", "b.source", (-c("b.minus")).alias("score"), "b.evidence")


def report(found: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, canonical, n, aliases): a document's number of candidates and its best few, for curators."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "source", "alias"))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "alias"))))
    return found.withColumn("place", place).groupBy("doc_id", "canonical").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["alias"]), "|").alias("aliases"))


def source_counts(found: DataFrame) -> DataFrame:
    """(source, n, n_documents)."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))
