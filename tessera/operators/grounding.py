"""Whether a list's evidence carries an answer: how far a question's lists reach, grounding and focus gates, why candidates were left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import asks_for_procedure, procedure_evidence
from tessera.functions.text import whole
from tessera.operators.context import ENTITY_ANCHORS, in_sequence

# --- fixed values: cues, limits and thresholds that decide results ------------------------------
CHECKLIST_CUES = ("해야할", "해야하는", "해야되는", "할일", "체크리스트", "무엇", "뭐", "안내", "설명", "교육", "업무", "절차")
OPERATIONAL_CUES = ("입소", "신규", "초기", "준비", "수급자", "보호자", "직원", "평가", "오면", "왔을때", "처음")
EVENT_CUES = ("오면", "올때", "왔을때", "받으면", "시작", "입소", "퇴소", "발생", "발견", "등록")
TASK_CUES = ("업무", "절차", "순서", "할일", "해야할", "해야하는", "해야되는")
#: enumerating, checklist and other questions: fused and evidence rows, candidates and clusters of a document, forced chunks.
PROFILES = {"enumeration": (48, 28, 5, 5, 4), "checklist": (24, 22, 4, 3, 0), "plain": (24, 18, 2, 2, 0)}
EXACT_GROUND, CROSS_EXACT, CROSS_DOCUMENTS, PROCEDURE_EXACT, PROCEDURE_CHUNKS, PROCEDURE_TERMS = 40.0, 25.0, 2, 10.0, 2, 3
FOCUS_HEAD = 10
# ------------------------------------------------------------------------------------------------


def _any(dense: Column, words: tuple) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: dense.contains(w))


def expansion_profile(question: Column, anchors: dict | None = None) -> Column:
    """struct(kind, fused_top_k, evidence_top_k, per_document, per_cluster, forced) of a question.

    Enumerating questions name an entity, an event and a task; checklist questions have a cue of asking and one of work.
    """
    dense = F.lower(F.regexp_replace(whole(question), r"\s+", ""))
    names = tuple(dict.fromkeys("".join(s.split()).lower() for synonyms in (ENTITY_ANCHORS if anchors is None else anchors).values() for s in synonyms))
    lists = _any(dense, names) & _any(dense, EVENT_CUES) & _any(dense, TASK_CUES)
    kind = F.when(lists, "enumeration").when(_any(dense, CHECKLIST_CUES) & _any(dense, OPERATIONAL_CUES), "checklist").otherwise("plain")
    fields = ("fused_top_k", "evidence_top_k", "per_document", "per_cluster", "forced")
    of = lambda k: F.element_at(F.create_map(*[x for name, values in PROFILES.items() for x in (F.lit(name), F.lit(values[k]))]), kind).alias(fields[k])
    return F.struct(kind.alias("kind"), *[of(k) for k in range(len(fields))])


def focus_matches(text: Column, focus: Column) -> Column:
    low = F.lower(whole(text))
    return F.filter(focus, lambda t: (t != "") & low.contains(F.lower(t)))


def grounding(evidence: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, exact, sequential, cross_document, procedure, passed): what grounds each question's evidence; no evidence, no ground.

    evidence is (query_id, chunk_id, exact_score, lexical_score), chunks give doc_id, section_id, window_index, article_no,
    search_text and text, asked question, article_asked and focus. Procedure terms of a list are a fixed small set, counted over its chunks.
    """
    met = evidence.join(chunks.select("chunk_id", "doc_id", "article_no", "search_text", "text"), "chunk_id").join(asked.select("query_id", "question", "article_asked", "focus"), "query_id")
    exact, lexical = F.coalesce("exact_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))
    focused = F.size(focus_matches(F.col("search_text"), F.col("focus"))) > 0
    terms = procedure_evidence(F.concat_ws(" ", "search_text", "text"))
    met = met.withColumns({
        "is_exact": (exact >= EXACT_GROUND) | F.coalesce((F.col("article_no") == F.col("article_asked")), F.lit(False)), "counts": focused | (exact >= CROSS_EXACT) | (lexical > 0), "terms": terms,
        "is_step": (F.size(terms) >= 2) | focused | (lexical > 0) | (exact >= PROCEDURE_EXACT), "procedural": asks_for_procedure(F.col("question")),
    })
    sums = met.groupBy("query_id").agg(
        F.max("is_exact").alias("exact"), (F.countDistinct(F.when(F.col("counts"), F.col("doc_id"))) >= CROSS_DOCUMENTS).alias("cross_document"),
        (F.max("procedural") & (F.count_if("is_step") >= PROCEDURE_CHUNKS) & (F.size(F.array_distinct(F.flatten(F.collect_set("terms")))) >= PROCEDURE_TERMS)).alias("procedure"),
    )
    runs = in_sequence(evidence, chunks).select("query_id", "sequential")
    out = asked.select("query_id").join(sums, "query_id", "left").join(runs, "query_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("exact", "sequential", "cross_document", "procedure")})
    return out.select("query_id", "exact", "sequential", "cross_document", "procedure", (F.col("exact") | F.col("sequential") | F.col("cross_document") | F.col("procedure")).alias("passed"))


def focus_gate(candidates: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, n_focus, n_matched, needed, passed, confidence): whether a list's head holds enough of the question's focus terms; where not, its confidence goes down.

    asked has question, focus and confidence. Procedure questions need one term and keep a medium confidence. Questions without
    focus terms, and lists without candidates, pass.
    """
    head = candidates.filter(F.col("rank") <= FOCUS_HEAD).join(chunks.select("chunk_id", "search_text"), "chunk_id").join(asked.select("query_id", "focus"), "query_id")
    held = head.select("query_id", focus_matches(F.col("search_text"), F.col("focus")).alias("m")).groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("m")))).alias("n_matched"), F.count(F.lit(1)).alias("n"))
    out = asked.select("query_id", "question", "confidence", F.size("focus").alias("n_focus")).join(held, "query_id", "left")
    relaxed = asks_for_procedure(F.col("question"))
    needed = F.when(relaxed, 1).otherwise(F.least(F.when(F.col("n_focus") >= 3, 2).otherwise(1), F.col("n_focus")))
    out = out.withColumns({"n_matched": F.coalesce("n_matched", F.lit(0)), "needed": needed})
    passed = (F.col("n_focus") == 0) | F.col("n").isNull() | (F.col("n_matched") >= F.col("needed"))
    lower = F.when(relaxed & (F.col("confidence") == "medium"), "medium").when(F.col("confidence") == "high", "medium").when(F.col("confidence") == "medium", "low").otherwise(F.col("confidence"))
    return out.select("query_id", "n_focus", "n_matched", "needed", passed.alias("passed"), F.when(passed, F.col("confidence")).otherwise(lower).alias("confidence"))


def candidate_diagnostics(candidates: DataFrame, evidence: DataFrame, chunks: DataFrame, asked: DataFrame, generic: tuple = ()) -> DataFrame:
    """candidates (query_id, chunk_id, rank, score, vector_score) with selected, n_focus and reasons: why each that is no evidence was left out.

    Clusters are sections. A window beside a selected one is not called non-adjacent.
    """
    told = chunks.select("chunk_id", "doc_id", "section_id", "window_index", "search_text")
    own = evidence.select("query_id", "chunk_id", "score").join(told.drop("search_text"), "chunk_id")
    docs = own.groupBy("query_id", "doc_id").agg(F.lit(True).alias("doc_in"))
    sections = own.groupBy("query_id", "doc_id", "section_id").agg(F.collect_set("window_index").alias("windows"))
    least = own.groupBy("query_id").agg(F.min("score").alias("least"))
    met = candidates.join(told, "chunk_id").join(asked.select("query_id", "focus"), "query_id", "left").join(evidence.select("query_id", "chunk_id", F.lit(True).alias("selected")), ["query_id", "chunk_id"], "left")
    met = met.join(docs, ["query_id", "doc_id"], "left").join(sections, ["query_id", "doc_id", "section_id"], "left").join(least, "query_id", "left")
    concrete = F.filter(focus_matches(F.col("search_text"), F.coalesce("focus", F.array().cast("array<string>"))), lambda t: ~t.isin(*generic) if generic else F.lit(True))
    near = F.exists(F.coalesce("windows", F.array().cast("array<int>")), lambda w: F.abs(w - F.col("window_index")) <= 1)
    reasons = F.array_compact(F.array(
        F.when(F.size(concrete) == 0, "generic-only-match"), F.when(F.coalesce("doc_in", F.lit(False)) & F.col("windows").isNull(), "document-cluster-limit"), F.when(F.col("windows").isNotNull() & ~near, "non-adjacent-window-in-selected-cluster"),
        F.when(F.col("score") < F.coalesce("least", F.lit(float("inf"))), "lower-rerank-score-than-selected-evidence"), F.when(F.coalesce("vector_score", F.lit(0.0)) <= 0, "no-vector-signal"),
    ))
    chosen = F.coalesce("selected", F.lit(False))
    return met.select("query_id", "chunk_id", "rank", chosen.alias("selected"), F.size(concrete).alias("n_focus"), F.when(chosen, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def reason_counts(diagnostics: DataFrame) -> DataFrame:
    """(reason, n, n_queries): how often each reason was given."""
    return diagnostics.select("query_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"))
