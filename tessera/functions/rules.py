"""Rules over names, questions and lines: column expressions around fixed word lists and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import whole

# --- fixed values: word lists and patterns that decide results ----------------------------------
COMPOUNDS = {
    "신규수급자": ("신규수급자", "신규 수급자", "신규", "수급자", "신규대상자", "신규 대상자", "입소자", "신규입소자"),
    "신규입소자": ("신규입소자", "신규 입소자", "신규", "입소자", "수급자", "신규수급자"),
    "급여제공계획": ("급여제공계획", "급여 제공 계획", "급여계획", "서비스계획", "제공계획", "계획수립"),
    "급여제공계획서": ("급여제공계획서", "급여제공계획", "급여 제공 계획서", "제공계획서", "계획서"),
    "욕구사정": ("욕구사정", "욕구 사정", "사정", "초기사정", "초기 사정", "평가"),
    "초기상담": ("초기상담", "초기 상담", "상담", "입소상담", "보호자상담"),
    "장기요양계약": ("장기요양계약", "장기요양 계약", "계약", "계약체결", "이용계약"),
    "비상연락망": ("비상연락망", "비상 연락망", "연락망", "보호자 연락처", "응급연락처"),
}
PROCEDURE = ("업무", "절차", "단계", "순서", "방법", "체크리스트", "해야", "해야할", "해야하는", "할일", "할 일", "준비", "진행", "작성", "수립", "체결", "안내")
PROCEDURE_EVIDENCE = (
    "초기", "상담", "욕구", "사정", "급여제공계획", "급여 제공 계획", "계획", "계약", "동의", "기록", "안내", "점검", "평가", "보호자", "비상연락망", "교육", "제공", "작성", "수립", "체결",
)
QUALIFIERS = {
    "temporal": (r"[0-9]+\s*(?:일|주|개월|년)\s*이내", r"급여제공\s*시작일", "토요일|공휴일", "매(?:일|주|월|분기|년)", r"연\s*[0-9]+\s*회", r"(?:월|주|분기)\s*[0-9]+\s*회\s*이상"),
    "population": (r"신규\s*수급자", r"모든\s*수급자", r"전체\s*수급자", r"보호자\s*포함", r"수급자\s*\(보호자\)", r"야간\s*근무", r"전\s*직원", "퇴소|입소"),
    "exception": ("^다만", "단,", "예외", "단서", "제외"),
    "numeric": (r"[0-9]+\s*(?:가지|회|명|일|주|개월)",),
}
INJECTION = (
    r"(?i)ignore\s+(?:all|previous|prior)\s+instructions", r"(?i)system\s+prompt", r"(?i)developer\s+message", r"(?i)reveal\s+.*prompt", r"(?i)api\s*key", "비밀", r"시스템\s*프롬프트", r"이전\s*지시",
)
#: The first whose words the lower-case name holds.
SOURCE_TYPES = (
    ("law", ("법(", "법률")), ("ordinance", ("시행령",)), ("rule", ("시행규칙", "부령")), ("notice", ("고시",)), ("comparison", ("비교표", "개정전후")),
    ("qa", ("q&a", "qa", "faq", "질의응답", "사례집")), ("guide", ("안내", "바로알기", "총정리", "사업안내")), ("wiki", ("index", "정리본", "위키")),
)
MANUAL, EVALUATION_MANUAL, DUTIES = ("매뉴얼", "운영지침"), "평가매뉴얼", "업무의 이해"
LEGAL_TYPES, SUPPORT_TYPES = ("law", "ordinance", "rule", "notice"), ("law", "ordinance", "rule", "notice", "manual", "guide", "qa", "comparison")
LEGAL_TITLE, EVALUATION_TITLE = "법률?|시행령|시행규칙|고시|별표|별지", "평가매뉴얼|평가기준|평가방법"
DATE, YEAR_MONTH = r"\((20[0-9]{2})([0-9]{2})([0-9]{2})\)", r"\((20[0-9]{2})\.([0-9]{1,2})\.?\)"
READY = 0.9
# ------------------------------------------------------------------------------------------------


def _squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(whole(text), r"\s+", ""))


def _holds(text: Column, term: str) -> Column:
    return _squeezed(text).contains("".join(term.split()).lower())


def _listed(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The words whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(test, word) for test, word in pairs])) if pairs else F.array().cast("array<string>")


def compound_variants(text: Column) -> Column:
    """All variants of each compound that the text holds itself or in a variant, white space aside; distinct, in order."""
    groups = []
    for compound, variants in COMPOUNDS.items():
        test = _holds(text, compound)
        for v in variants:
            test = test | _holds(text, v)
        groups.append(F.when(test, F.array(*map(F.lit, variants))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*groups))


def asks_for_procedure(text: Column) -> Column:
    return F.size(_listed([(_holds(text, t), t) for t in PROCEDURE])) > 0


def procedure_evidence(text: Column) -> Column:
    return _listed([(_holds(text, t), t) for t in PROCEDURE_EVIDENCE])


def qualifiers(text: Column) -> Column:
    """The kinds of qualification that a line makes: temporal, population, exception, numeric."""
    return _listed([(whole(text).rlike("|".join(f"(?:{p})" for p in patterns)), kind) for kind, patterns in QUALIFIERS.items()])


def qualifier_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, line_no, line): a row for each line and each kind of qualification in it."""
    lines = texts.select(key, F.posexplode(F.split(whole(F.col(text)), "\n", -1)).alias("line_no", "line"))
    return lines.select(key, F.explode(qualifiers(F.col("line"))).alias("kind"), "line_no", "line")


def injection_signal(text: Column) -> Column:
    """Whether a question tries to overrule instructions or to read out secrets."""
    out = F.lit(False)
    for p in INJECTION:
        out = out | whole(text).rlike(p)
    return out


def law_text(text: Column) -> Column:
    """Spaces and dashes unified, ``제 3 조`` joined to ``제3조`` (so 항, 호, 목), no blanks inside brackets."""
    out = F.regexp_replace(F.regexp_replace(whole(text), r"[\u00a0\u2002\u2003\u2009]", " "), r"[\u2010\u2011\u2012\u2013\u2014\u2015]", "-")
    for pattern, by in ((r"\s*-\s*", "-"), (r"\s+", " "), (r"제\s+([0-9]+)\s+([조항호목])", "제$1$2"), (r"\(\s+", "("), (r"\s+\)", ")")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def date_in_name(name: Column) -> Column:
    """``(20240131)`` or ``(2024.1.)`` in a file name as an ISO date; null where there is none."""
    day, month = F.regexp_extract(whole(name), DATE, 0) != "", F.regexp_extract(whole(name), YEAR_MONTH, 0) != ""
    part = lambda p, k: F.regexp_extract(whole(name), p, k)
    return F.when(day, F.concat_ws("-", part(DATE, 1), part(DATE, 2), part(DATE, 3))).when(
        month, F.concat_ws("-", part(YEAR_MONTH, 1), F.lpad(part(YEAR_MONTH, 2), 2, "0"), F.lit("01"))
    )


def posix(path: Column) -> Column:
    return F.replace(whole(path), F.lit("\\"), F.lit("/"))


def source_type(name: Column, path: Column) -> Column:
    low, at = F.lower(whole(name)), posix(path)
    out = F
    for kind, words in SOURCE_TYPES:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = out.when(test, kind)
    out = out.when(at.contains("/knowledge/evaluation/"), "evaluation").when(at.contains("/knowledge/eval/") & low.contains(EVALUATION_MANUAL), "evaluation")
    return out.when(low.contains(MANUAL[0]) | low.contains(MANUAL[1]), "manual").otherwise("other")


def path_mode(path: Column) -> Column:
    return F.when(posix(path).rlike("/knowledge/(eval|evaluation)/"), "evaluation").otherwise("integrated")


def document_group(name: Column, kind: Column) -> Column:
    same = ("qa", "manual", "comparison", "wiki", "guide", "evaluation")
    return F.when(kind.isin(*LEGAL_TYPES), "legal").when(kind.isin(*same), kind).when(F.lower(whole(name)).contains("평가"), "evaluation").otherwise("general")


def source_role(name: Column, path: Column, mode: Column, kind: Column) -> Column:
    """routing_summary, primary_evaluation, support_reference or general."""
    at, title = posix(path), F.regexp_replace(whole(name), r"(?i)\.(md|txt)$", "")
    in_eval = F.when(kind.isin("evaluation", "manual") & title.contains(EVALUATION_MANUAL), "primary_evaluation")
    in_eval = in_eval.when(kind.isin("evaluation", "manual", "other") & title.contains(DUTIES), "support_reference")
    in_eval = in_eval.when(kind.isin("qa", "guide", "comparison"), "support_reference").otherwise("primary_evaluation")
    pages = F.when(at.endswith("/index.md"), "routing_summary").otherwise("primary_evaluation")
    return (
        F.when(at.contains("/knowledge/evaluation/"), pages).when(at.contains("/knowledge/eval/"), in_eval)
        .when(kind.isin(*SUPPORT_TYPES), "support_reference").when(mode == "evaluation", "primary_evaluation").otherwise("general")
    )


def chunk_policy(title: Column, name: Column, path: Column, kind: Column, group: Column) -> Column:
    """law, evaluation, qa, comparison, manual or general: how a document is cut."""
    probe = F.concat_ws(" ", whole(title), whole(name), whole(path))
    return (
        F.when(kind.isin(*LEGAL_TYPES) | probe.rlike(LEGAL_TITLE), "law")
        .when((kind == "evaluation") | (group == "evaluation") | probe.rlike(EVALUATION_TITLE), "evaluation")
        .when(kind.isin("qa", "comparison"), kind).when(kind.isin("manual", "guide"), "manual").otherwise("general")
    )


def metadata(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """files with mode, source_type, document_group, source_role, chunk_policy, effective_date and title, from name and path alone."""
    n, p = F.col(name), F.col(path)
    title = F.regexp_replace(whole(n), r"(?i)\.(md|txt)$", "")
    out = files.withColumn("title", title).withColumn("mode", path_mode(p)).withColumn("source_type", source_type(n, p))
    out = out.withColumn("document_group", document_group(n, F.col("source_type")))
    return out.withColumn("source_role", source_role(n, p, F.col("mode"), F.col("source_type"))).withColumn(
        "chunk_policy", chunk_policy(F.col("title"), n, p, F.col("source_type"), F.col("document_group"))
    ).withColumn("effective_date", date_in_name(n))


def citation_label(title: Column, article: Column, path: Column, window: Column, date: Column, precise: bool = False) -> Column:
    """Title, article, section path and date with bars between; of a window after the first its number, unless precise.

    A precise label begins with the file's name and leaves out an article that the path names.
    """
    inner = F.filter(path, lambda p, k: ~((k == 0) & (p == title))) if not precise else F.filter(path, lambda p, k: ~((k == 0) & p.isin("")))
    article_ = F.when(~F.array_contains(inner, article), article) if precise else article
    number = F.lit(None).cast("string") if precise else F.when(window > 0, F.concat(F.lit("window "), (window + 1).cast("string")))
    return F.concat_ws(" | ", title, F.nullif(article_, F.lit("")), F.nullif(F.array_join(inner, " > "), F.lit("")), number, F.nullif(date, F.lit("")))


def agent_decision(confidence: Column, n_evidence: Column, clarify: Column | None = None) -> Column:
    out = F.when(clarify, "clarify") if clarify is not None else F
    return out.when((F.coalesce(n_evidence, F.lit(0)) <= 0) | (confidence == "low"), "abstain").otherwise("answer")


def readiness(n_embedded: Column, n: Column, ready: float = READY) -> Column:
    """lexical_only without vectors, hybrid_ready from a share of ``ready`` on, else hybrid_partial."""
    return F.when(n_embedded <= 0, "lexical_only").when(n_embedded / F.nullif(n, F.lit(0)) >= ready, "hybrid_ready").otherwise("hybrid_partial")


def citation_warning(n_citations: Column, n_evidence: Column) -> Column:
    return F.when((n_citations == 0) | (n_evidence == 0), "warning").otherwise("info")


def in_scope(chunks: DataFrame, mode: str, allowed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Chunks of the allowed documents where such are given; else all, in evaluation mode those of that mode."""
    if allowed is not None:
        return chunks.join(allowed.select(key).distinct(), key, "left_semi")
    return chunks.filter(F.col("mode") == "evaluation") if mode == "evaluation" else chunks
