"""Points for candidates from names, articles, aliases, laws, headings, roles and classes of questions; reranking by their sum.

All of it is column arithmetic on candidate rows (question and chunk side by side), so nothing is shuffled but the final ranking
of each question's list. A null field scores nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import compound_variants
from tessera.functions.text import article_no, compact, tokens, whole

# --- fixed values: points, weights and words -----------------------------------------------------
LEGAL = ("law", "ordinance", "rule", "notice")
NOISE = (
    "문서를찾아줘", "문서찾아줘", "문서를보여줘", "문서보여줘", "문서를", "문서", "우선근거로잡아줘", "우선", "먼저", "찾아줘", "보여줘", "기준으로설명해줘", "설명해줘", "근거를찾아줘", "근거", "확인하나요", "확인",
)
GENERIC = (
    "장기요양", "장기요양기관", "요양기관", "기관", "급여", "제공", "기준", "방법", "운영", "업무", "평가", "문서", "자료", "안내", "지침", "이용", "가능", "관련", "요양", "시설", "내용", "대상", "질문", "사용", "비용",
    "청구", "청구할", "수있나요", "있나요", "되나요", "하나요", "알려줘", "알려주세요", "설명해줘", "설명해주세요", "설명해", "대해", "조사", "조사에", "찾아줘", "찾아주세요", "어떤", "누가", "언제", "어떻게", "어떡해",
    "뭐", "뭘", "뭐야", "뭐예요", "무엇", "무엇인가", "무슨", "뜻", "정의", "개념", "설명", "이게", "이거", "이렇게", "해", "하면", "해도", "해야", "돼", "되", "되나", "준비해", "필요해", "챙겨", "챙겨야", "준비물", "체크리스트",
)
CUES = {
    "asks_checklist": "(체크리스트|지침|교육|안내|확인|기한|이내|업무|절차|방법)", "asks_document": "(문서|매뉴얼|사례집|가이드|바로알기|어디서|찾아줘|찾아|봐야|확인)",
    "asks_comparison": "(개정|전후|비교표)", "asks_workflow": "(업무|처리|흐름|바로알기|확인)",
}
WORKFLOW_TITLE = "(업무|처리|흐름|바로알기|매뉴얼)"
INTENTS = {"legal-exact": (LEGAL, 8), "manual-qna": (("manual", "qa", "guide", "wiki"), 8), "synthesis": (("comparison", "qa", "manual", "notice"), 4)}
WEIGHTS = ("legal", "evaluation_primary", "evaluation_support", "manual", "qa", "guide", "mismatch", "scope", "comparison", "document_lookup")
PRIORITIES = {
    "legal_judgment": (24, 8, 3, 4, 7, 6, 12, 16, 4, 8),
    "evaluation_readiness": (6, 22, 14, 10, 5, 4, 10, 18, 6, 8),
    "operational_workflow": (5, 10, 8, 16, 8, 10, 10, 18, 5, 8),
    "document_lookup": (8, 8, 5, 8, 6, 6, 8, 14, 6, 18),
    "comparison_definition": (7, 8, 6, 12, 6, 6, 8, 14, 16, 8),
}
# -------------------------------------------------------------------------------------------------


def points(*pairs: tuple[Column, float | Column]) -> Column:
    """The sum of the points whose tests hold."""
    total = F.lit(0.0)
    for test, n in pairs:
        total = total + F.when(test, n).otherwise(0.0)
    return total


def question_context(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with what scoring asks of them: compact wording, the wording without request phrases, article, month, tokens, focus terms, cues."""
    q, probe = F.col(question), compact(F.col(question))
    for phrase in NOISE:
        probe = F.replace(probe, F.lit(phrase), F.lit(""))
    date = F.regexp_extract(whole(q), r"20[0-9]{2}[.\-/][0-9]{1,2}(?:[.\-/][0-9]{1,2})?", 0)
    focus = F.array_except(F.array_distinct(F.concat("tokens", compound_variants(q))), F.array(*[F.lit(g) for g in GENERIC]))
    out = questions.withColumns({"wanted": compact(q), "probe": probe, "article_asked": article_no(q), "month_asked": F.substring(F.regexp_replace(date, "[^0-9]", ""), 1, 6), "tokens": tokens(q)})
    return out.withColumns({"focus": focus, **{name: F.coalesce(q.rlike(p), F.lit(False)) for name, p in CUES.items()}})


def chunk_context(chunks: DataFrame, title: str = "title", name: str = "name", section: str = "section") -> DataFrame:
    """chunks with their compact names."""
    return chunks.withColumns({"title_compact": compact(F.col(title)), "name_compact": compact(F.col(name)), "section_compact": compact(F.col(section))})


def alias_points(aliases: Column, title: Column, section: Column) -> Column:
    """30 for each alias of two compact characters or more that the title holds, else 18 where the section does."""
    def one(total: Column, a: Column) -> Column:
        return total + F.when(F.length(compact(a)) < 2, 0.0).when(title.contains(compact(a)), 30.0).when(section.contains(compact(a)), 18.0).otherwise(0.0)

    return F.coalesce(F.aggregate(aliases, F.lit(0.0), one), F.lit(0.0))


def law_points(laws: Column) -> Column:
    """38 or 20 for the law's name in title or section, 52 or 22 for its article, 8 for the clause, 6 for the item.

    ``laws``: array of struct<name, article, clause, item> of a question.
    """
    def one(total: Column, law: Column) -> Column:
        name = F.lower(F.regexp_replace(law["name"], r"\s+", ""))
        return total + (
            F.when(name == "", 0.0).when(F.col("title_compact").contains(name), 38.0).when(F.col("section_compact").contains(name), 20.0).otherwise(0.0)
            + F.when(law["article"] == F.col("article_no"), 52.0).when((law["article"] != "") & F.col("search_text").contains(law["article"]), 22.0).otherwise(0.0)
            + points((F.col("text").contains(F.concat(F.lit("제"), law["clause"], F.lit("항"))), 8.0), (F.col("text").contains(F.concat(F.lit("제"), law["item"], F.lit("호"))), 6.0))
        )

    return F.coalesce(F.aggregate(laws, F.lit(0.0), one), F.lit(0.0))


def intent_points(intent: Column, kind: Column) -> Column:
    return points(*[((intent == name) & kind.isin(*kinds), float(n)) for name, (kinds, n) in INTENTS.items()])


def meets_probe() -> Column:
    """Whether the wording without request phrases and a document's title or file name hold one another."""
    probe = F.col("probe")
    meets = lambda n: n.contains(probe) | ((F.length(n) >= 4) & probe.contains(n))
    return (F.length(probe) >= 4) & (meets(F.col("title_compact")) | meets(F.col("name_compact")))


def exact_points() -> Column:
    """Points of a candidate row for its names: the question's wording, article, tokens, aliases, laws, kind of source, mode and month."""
    c, title, section = F.col, F.col("title_compact"), F.col("section_compact")
    of_tokens = F.aggregate(
        F.filter(F.transform("tokens", lambda t: compact(t)), lambda t: t != ""), F.lit(0.0),
        lambda s, t: s + F.when(title.contains(t), 6.0).otherwise(0.0) + F.when(section.contains(t), 4.0).otherwise(0.0),
    )
    article = F.when(c("article_asked") == c("article_no"), 40.0).when(c("search_text").contains(c("article_asked")), 18.0).otherwise(0.0)
    month = (c("month_asked") != "") & (c("month_asked") == F.substring(F.replace(c("effective_date"), F.lit("-"), F.lit("")), 1, 6))
    plain = points(
        ((F.length("wanted") >= 4) & title.contains(c("wanted")), 28.0), (meets_probe(), 34.0),
        ((c("mode") == "evaluation") & (c("doc_mode") == "evaluation"), 6.0), (month, 10.0),
    )
    return plain + article + F.coalesce(of_tokens, F.lit(0.0)) + alias_points(c("aliases"), title, section) + law_points(c("laws")) + intent_points(c("intent"), c("source_type"))


def heading_points(focus: Column, headings: Column, text: Column, checklist: Column) -> Column:
    """8 for each of the first twelve focus terms in the headings, else 2 in the text; 10 for a wanted list; 48 at most."""
    one = lambda s, t: s + F.when(headings.contains(F.lower(t)), 8.0).when(text.contains(F.lower(t)), 2.0).otherwise(0.0)
    total = F.aggregate(F.slice(focus, 1, 12), F.lit(0.0), one) + points((checklist, 10.0))
    return F.when(F.size(focus) > 0, F.least(total, F.lit(48.0))).otherwise(0.0)


def names_document() -> Column:
    """Whether the question names the document: its title holds the wording, or the wording without request phrases fits."""
    return ((F.length("wanted") >= 4) & F.col("title_compact").contains(F.col("wanted"))) | meets_probe()


def lookup_points() -> Column:
    """Points of manuals, guides, answers and comparisons where the question looks for a document and two focus terms stand in the text."""
    c, kind = F.col, F.col("source_type")
    book = kind.isin("guide", "manual")
    works = book & c("asks_workflow") & F.concat_ws(" ", whole(c("title")), whole(c("section"))).rlike(WORKFLOW_TITLE)
    of_intent = c("intent").isin("manual-qna", "synthesis") & (intent_points(c("intent"), kind) > 0)
    listed = F.coalesce(c("has_list"), F.lit(False)) & c("asks_checklist")
    n = F.size(F.filter("focus", lambda t: F.lower(whole(c("search_text"))).contains(F.lower(t))))
    open_ = (c("source_role") == "support_reference") & kind.isin("manual", "guide", "qa", "comparison") & c("asks_document") & ((c("mode") != "evaluation") | ((kind == "comparison") & c("asks_comparison")))
    signal = F.coalesce(names_document(), F.lit(False)) | F.coalesce(of_intent, F.lit(False)) | listed | works
    total = 48.0 + F.least(F.lit(36.0), 6.0 * n) + points((names_document(), 28.0), (book, 24.0), (works, 64.0), (kind.isin("qa", "comparison"), 12.0))
    return F.when(open_ & signal & (n >= 2), total).otherwise(0.0)


def authority_points(as_of_year: int) -> Column:
    """Points for a document's role, names and age; the year is given, so that reruns agree."""
    names = F.lower(F.concat_ws(" ", whole(F.col("title")), whole(F.col("name")), whole(F.col("section"))))
    role, path = F.col("source_role"), whole(F.col("path"))
    dated = F.concat_ws(" ", "title", "name", "effective_date")
    year = F.regexp_extract(dated, r"\b(20[0-9]{2})\b", 1).try_cast("int")
    first = role == "primary_evaluation"
    return points(
        (first, 28.0), (role == "support_reference", 8.0), (role == "routing_summary", -32.0), (names.contains("평가매뉴얼"), 20.0), (first & path.contains("/knowledge/eval/") & names.contains("평가매뉴얼"), 90.0),
        (first & path.contains("/knowledge/evaluation/"), -72.0), (names.rlike("q&a|qa|질의응답"), -10.0), (names.contains("사례집"), -6.0), (names.rlike("직원교육|직원인권|인권보호") & ~first, -12.0),
        (year.isNotNull(), F.greatest(F.lit(-10.0), F.lit(8.0) - 2 * F.greatest(F.lit(0), F.lit(as_of_year) - year))),
    )


def priority_points(priority: Column, linked: Column) -> Column:
    """Points of a candidate's kind and role under the class of its question; ``linked``: does the question touch on evaluation."""
    kind, role, in_evaluation = F.col("source_type"), F.col("source_role"), F.col("doc_mode") == "evaluation"
    legal, first, support = kind.isin(*LEGAL), F.coalesce(role == "primary_evaluation", F.lit(False)), (role == "support_reference") & in_evaluation
    linked = F.coalesce(linked, F.lit(False))
    out = F
    for name, numbers in PRIORITIES.items():
        w = dict(zip(WEIGHTS, map(float, numbers), strict=True))
        tests = {
            "legal_judgment": (
                (legal, w["legal"]), (~legal & first, -0.75 * w["evaluation_primary"]), (kind == "manual", -0.5 * w["manual"]), (support, -0.5 * w["evaluation_support"]), (kind == "qa", -w["qa"]),
                (kind.isin("guide", "wiki"), -w["guide"]),
            ),
            "evaluation_readiness": ((first, w["evaluation_primary"]), (support, w["evaluation_support"]), (kind == "manual", 0.45 * w["manual"]), (legal, 0.35 * w["legal"])),
            "operational_workflow": (
                (kind == "manual", w["manual"]), (kind.isin("guide", "wiki"), w["guide"]), (kind == "qa", 0.8 * w["qa"]), (first & linked, 0.65 * w["evaluation_primary"]), (first & ~linked, 0.5 * w["manual"]),
                (support & linked, 0.75 * w["evaluation_support"]),
            ),
            "document_lookup": (
                (F.col("exact_score") >= 18, w["document_lookup"]), (whole(F.col("article_no")) != "", 0.35 * w["document_lookup"]), (first, 0.35 * w["evaluation_primary"]), (kind == "manual", 0.4 * w["manual"]),
                (legal, 0.4 * w["legal"]),
            ),
            "comparison_definition": ((kind == "comparison", w["comparison"]), (kind == "manual", 0.85 * w["manual"]), (kind == "qa", 0.55 * w["qa"]), (legal, 0.45 * w["legal"])),
        }[name]
        out = out.when(priority == name, points(*tests))
    return out.otherwise(0.0)


def is_thin(kind: Column, role: Column, text: Column) -> Column:
    """An evaluation page with fewer than 24 characters of its own."""
    own = F.regexp_replace(F.regexp_replace(whole(text), r"해당\s*없음", ""), r"[\s#*_`>|:.\-()\[\]{}]", "")
    return (kind == "evaluation") & (role == "primary_evaluation") & (F.length(own) < 24)


def rule_points(as_of_year: int) -> Column:
    """What intent, mode, class and thinness add to a candidate."""
    c = F.col
    kind, intent, mode, own = c("source_type"), c("intent"), c("mode"), c("doc_mode")
    authority = authority_points(as_of_year)
    capped = F.when(c("priority") == "legal_judgment", F.least(authority, F.lit(8.0))).when(c("priority") == "evaluation_readiness", authority).otherwise(F.least(authority, F.lit(24.0)))
    exact_law = intent == "legal-exact"
    return capped + points(
        (exact_law & (whole(c("article_no")) != ""), 10.0), (exact_law & kind.isin(*LEGAL), 8.0), ((intent == "manual-qna") & (kind == "qa"), 8.0), ((intent == "manual-qna") & kind.isin("manual", "guide", "wiki"), 5.0),
        ((intent == "synthesis") & (kind == "comparison"), 6.0), ((mode == "evaluation") & (own == "evaluation"), 6.0), (is_thin(kind, c("source_role"), c("text")), -96.0),
        ((mode == "integrated") & exact_law & (own == "integrated"), 12.0), ((mode == "integrated") & exact_law & (own == "evaluation"), -8.0), ((F.size("laws") > 0) & kind.isin(*LEGAL), 12.0),
    )


def reranked(candidates: DataFrame, k: int = 24, as_of_year: int = 2025, boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, exact_score, heading_score, rerank_score, rank): each list by 100 fused + 1.8 exact + 15 lexical + 30 vector and all points.

    candidates are rows of question_context and chunk_context joined, with fused, lexical_score and vector_score (null: 0).
    ``boosts``: (doc_id, boost) from a graph or from scopes. Ties go to the smaller doc_id.
    """
    c = F.col
    rows = candidates.withColumn("exact_score", exact_points())
    heading = heading_points(c("focus"), F.lower(F.concat_ws(" ", whole(c("title")), whole(c("section")))), F.lower(whole(c("search_text"))), c("asks_checklist") & F.coalesce(c("has_list"), F.lit(False)))
    rows = rows.withColumn("heading_score", F.when(c("priority") == "legal_judgment", F.least(heading, F.lit(8.0))).otherwise(heading))
    rows = rows.join(boosts, "doc_id", "left") if boosts is not None else rows.withColumn("boost", F.lit(0.0))
    zero = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    total = 100 * zero("fused") + 1.8 * c("exact_score") + 15 * zero("lexical_score") + 30 * zero("vector_score") + zero("boost") + c("heading_score") + lookup_points() + rule_points(as_of_year) + priority_points(c("priority"), c("linked"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id"))
    return rows.select("query_id", "doc_id", "exact_score", "heading_score", F.round(total, 6).alias("rerank_score")).withColumn("rank", place).filter(c("rank") <= k)


def drift_guarded(ranked: DataFrame, most: float = 96.0, least: float = 18.0) -> DataFrame:
    """Lists in which the best exact candidate is lifted by 18 to 96 points towards the top, where another document leads; ranked anew.

    Rows have query_id, doc_id, exact_score, rerank_score, rank. Only questions with a positive exact score change.
    """
    per = Window.partitionBy("query_id")
    best = F.row_number().over(per.orderBy(F.desc("exact_score"), "doc_id")) == 1
    marked = ranked.withColumn("_best", best & (F.col("exact_score") > 0) & (F.col("rank") > 1)).withColumn("_gap", F.max("rerank_score").over(per) - F.col("rerank_score") + 1)
    lifted = F.col("rerank_score") + F.when(F.col("_best"), F.least(F.lit(most), F.greatest(F.lit(least), F.col("_gap")))).otherwise(0.0)
    out = marked.withColumn("rerank_score", F.round(lifted, 6)).withColumn("guarded", F.col("_best")).drop("_best", "_gap")
    return out.withColumn("rank", F.row_number().over(per.orderBy(F.desc("rerank_score"), "doc_id")))
