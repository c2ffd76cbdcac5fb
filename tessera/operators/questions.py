"""What questions ask: their type and intent, laws and articles they name, terms of a lexicon, slots, relations, risk, search variants.

A batch of questions is a table. Rules are column expressions; what a question holds of a lexicon of any size comes from one
automaton over the lexicon's table. A question's slots, entities and terms are rows with a turn, which says their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.automaton import occurrences
from tessera.functions.rules import asks_for_procedure, compound_variants, law_text
from tessera.functions.text import tokens, whole

# --- fixed values: word lists, patterns and weights that decide results -------------------------
#: (expression, canonical, entity type, slot, confidence, status)
LEXICON = (
    ("요양원", "노인요양시설", "institution", "institution_type", 0.98, "promoted"),
    ("시설급여", "시설급여", "benefit", "benefit_type", 0.96, "promoted"),
    ("주야간보호", "주야간보호", "service", "service_scope", 0.98, "promoted"),
    ("데이케어", "주야간보호", "service", "service_scope", 0.92, "promoted"),
    ("방문요양", "방문요양", "service", "service_scope", 0.98, "promoted"),
    ("방문목욕", "방문목욕", "service", "service_scope", 0.96, "promoted"),
    ("방문간호", "방문간호", "service", "service_scope", 0.96, "promoted"),
    ("복지용구", "복지용구", "service", "service_scope", 0.95, "promoted"),
    ("1등급", "장기요양 1등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("2등급", "장기요양 2등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("3등급", "장기요양 3등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("4등급", "장기요양 4등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("5등급", "장기요양 5등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("인지지원등급", "인지지원등급", "grade", "recipient_grade", 0.99, "promoted"),
    ("본인부담금", "본인부담금", "cost_item", "cost_topic", 0.97, "promoted"),
    ("감경", "본인부담금 감경", "exception", "exception_context", 0.94, "promoted"),
    ("가산", "가산", "cost_item", "cost_topic", 0.9, "validated"),
    ("의사소견서", "의사소견서", "form", "document_type", 0.98, "promoted"),
    ("급여제공계획서", "급여제공계획서", "document", "document_type", 0.97, "promoted"),
    ("케어플랜", "급여제공계획서", "document", "document_type", 0.9, "validated"),
    ("요양보호사", "요양보호사", "actor", "actor_role", 0.99, "promoted"),
    ("사회복지사", "사회복지사", "actor", "actor_role", 0.99, "promoted"),
    ("시설장", "시설장", "actor", "actor_role", 0.98, "promoted"),
    ("평가", "평가", "quality_indicator", "time_scope", 0.86, "validated"),
    ("입소 초기", "입소 초기", "workflow", "time_scope", 0.88, "validated"),
)
#: (law, its other names, laws that may be meant too)
LAW_ALIASES = (
    ("노인장기요양보험법", ("장기요양보험법", "장기요양법", "노인장기요양법"), ("노인장기요양보험법 시행령", "노인장기요양보험법 시행규칙")),
    ("노인장기요양보험법 시행령", ("장기요양보험법 시행령", "장기요양법 시행령"), ()),
    ("노인장기요양보험법 시행규칙", ("장기요양보험법 시행규칙", "장기요양법 시행규칙"), ()),
    ("장기요양급여 제공기준 및 급여비용 산정방법 등에 관한 고시", ("장기요양급여 고시", "급여비용 고시", "급여제공기준 고시"), ()),
    ("노인복지법", ("노복법",), ()),
    ("의료급여법", ("의료급여",), ()),
)
FOOD = r"기피\s*식품|기피식품|식품\s*선호|식품선호|선호도\s*조사|식사\s*만족|식사만족|희망\s*식사|희망식사|대체\s*식품|대체식품|대체\s*식단|대체식단|욕구\s*사정|욕구사정|식사\s*\(?간식\)?|식사간식|급식|식단표|영양사"
QUERY_TYPES = (
    ("comparison", r"차이|비교|구분|(?i:\bvs\b)"),
    ("checklist", r"체크리스트|뭐\s*준비|무엇\s*준비|확인사항|챙겨"),
    ("procedure", r"어떻게|절차|방법|순서|진행|신청|제출"),
    ("requirement", r"가능|될까|되나|돼|수\s*있|해도|필수|해야|의무|대상|조건"),
    ("scope", r"얼마|금액|범위|기간|언제까지"),
    ("consequence", r"위반|제재|처분|벌점"),
    ("exemption", r"예외|감경|면제|제외"),
    ("definition", r"뭐야|무엇|정의|개념|뜻|설명|이란"),
)
EXPANSIONS = (
    (("기피식품", "식품선호", "식품선호도", "선호도 조사", "식사만족도", "식사 만족도"), ("기피식품", "식사만족도", "식사 만족도", "희망 식사", "대체식품", "대체 식품", "욕구사정", "식사간식")),
    (("뭐야", "무엇", "정의", "개념", "뜻"), ("정의", "개념", "무엇인가")),
    (("뭐 준비", "무엇 준비", "챙겨"), ("체크리스트", "확인사항", "준비서류")),
    (("어떻게", "방법", "절차"), ("절차", "방법", "순서")),
    (("가능", "될까", "되나", "돼", "수 있어", "해도", "대상"), ("가능 여부", "해도 되는지", "적용 조건")),
    (("본인부담", "비용", "금액"), ("본인부담금", "급여비용", "산정기준")),
    (("예외", "감경", "면제"), ("예외", "단서", "제외 기준")),
    (("인력현황", "직원현황", "인력배치"), ("인력기준", "인력배치기준", "직원배치기준", "인력신고 현황")),
)
INTENT_RELATIONS = {
    "eligibility": ("eligible-for", "not-eligible-for", "requires", "limited-by"),
    "compliance": ("applies-to", "requires", "limited-by", "conflicts-with"),
    "cost": ("has-cost", "limited-by", "exception-of"),
    "document": ("uses-document", "requires"),
    "workflow": ("follows-step", "uses-document", "requires"),
    "comparison": ("same-as", "conflicts-with", "belongs-to"),
    "definition": ("same-as", "belongs-to"),
    "exception": ("exception-of", "limited-by", "not-applies-to"),
    "sanction": ("conflicts-with", "applies-to", "limited-by"),
}
RELATION_TERMS = {
    "alias-of": ("동의어", "같은 용어"),
    "requires": ("필요 서류", "요건", "필수"),
    "eligible-for": ("대상", "가능 여부", "적용 조건"),
    "not-eligible-for": ("제외", "불가", "제한"),
    "applies-to": ("적용 대상", "해당 기준"),
    "not-applies-to": ("비적용", "예외 적용 제외"),
    "belongs-to": ("분류", "소속"),
    "uses-document": ("서류", "문서", "작성"),
    "has-cost": ("본인부담금", "비용", "산정"),
    "limited-by": ("제한", "조건", "상한"),
    "exception-of": ("예외", "단서", "감경"),
    "conflicts-with": ("충돌", "주의", "제재"),
    "evidenced-by": ("근거", "증빙"),
    "follows-step": ("절차", "순서", "진행"),
    "same-as": ("동일", "같은 개념"),
}
STOP_TOKENS = ("알려줘", "알려주세요", "설명", "설명해줘", "설명해주세요", "질문", "문의", "뭐야", "뭔가요", "무엇", "이게", "이건", "그게", "그건", "어떻게", "해도", "될까", "가능", "준비", "확인", "해주세요")
EXPLAINS, DEFINES = r"설명|이란\s*(뭐|무엇|어떤)|뭔가요|의미가|뜻이", "뭐야|무엇|정의|개념|뜻|설명|이란|뭔가요|의미"
RECIPIENT = r"신규\s*수급자|새\s*수급자|수급자|어르신|보호자"
ONBOARDING = (r"신규|새\s*수급자|입소\s*초기|계약\s*초기|급여\s*제공\s*시작|처음|오면|왔을\s*때|처음\s*오", "신규수급자|입소초기|계약초기|급여제공시작|오면|왔을때|처음")
WORK = (r"해야\s*할|해야하는|해야\s*되는|할\s*일|업무|절차|체크리스트|준비|챙겨|무엇|뭐", "해야할|해야하는|해야되는|할일")
LOOKUP = r"((어느|어떤|해당|관련)\s*(문서|서류|자료|양식|서식))|((문서|서류|자료|양식|서식).*(찾|보여|알려|확인|다운로드|첨부))|((찾|보여|알려|확인).*(문서|서류|자료|양식|서식))"
ELIGIBILITY = r"누가|대상자?|자격|해당자|신청\s*자격|이용\s*대상|수급자\s*(대상|자격|조건|가능)|가능한\s*사람"
COMPLIANCE = r"기준|별표|인력기준|시설기준|배치기준|운영기준|필수|의무|언제까지|기한|통보|평가예정통보|안내해야|어느\s*별표"
WORKFLOW = r"작성|수립|절차|순서|진행|신고|업무|할\s*일|체크리스트"
INTENT_CUES = (("예외|감경|면제|제외|단서", "exception"), ("본인부담|비용|금액|수가|본인부담금", "cost"), ("제재|처분|위반|벌점", "sanction"), (ELIGIBILITY, "eligibility"), (COMPLIANCE, "compliance"), (LOOKUP, "document"), (WORKFLOW, "workflow"))
TYPE_INTENTS = {"comparison": "comparison", "definition": "definition", "procedure": "workflow", "checklist": "workflow", "exemption": "exception", "consequence": "sanction", "scope": "cost"}
LAW_NAME = "(법|시행령|시행규칙|고시|규정|지침)$"
LAW_REFERENCE = r"^(.*?)(제\s*[0-9]+\s*조(?:의\s*[0-9]+)?)(?:\s*(제\s*[0-9]+\s*항))?(?:\s*(제\s*[0-9]+\s*호))?(?:\s*(제\s*[0-9]+\s*목))?$"
#: (pattern, slot, value, canonical, confidence, entity type, status); grades come from the question itself.
HEURISTICS = (
    ("입소|요양원", "institution_type", "요양원", "노인요양시설", 0.88, "institution", "promoted"), ("입소|요양원", "benefit_type", "입소", "시설급여", 0.78, "benefit", "validated"),
    ("주야간|데이케어|주간보호", "service_scope", "주야간보호", "주야간보호", 0.9, "service", "promoted"), ("방문요양", "service_scope", "방문요양", "방문요양", 0.9, "service", "promoted"),
    ("본인부담|비용|금액", "cost_topic", "비용", "본인부담금", 0.82, "cost_item", "validated"), ("감경|예외|면제|제외", "exception_context", "예외", "예외", 0.84, "exception", "validated"),
    ("의사소견서|급여제공계획서|케어플랜|서식|서류", "document_type", "서류", "서류", 0.7, "document", "validated"),
)
GRADES = "[1-5]등급|인지지원등급"
SLOT_RELATIONS = (
    (("cost_topic",), "has-cost", 1.15), (("document_type",), "uses-document", 1.05), (("exception_context",), "exception-of", 1.15), (("service_scope", "institution_type"), "applies-to", 1.05), (("recipient_grade",), "eligible-for", 1.08),
)
PRIMARY_WEIGHT, SECONDARY_WEIGHT, MOST_TERMS = 1.2, 0.9, 24
CRITICAL = {
    "eligibility": ("service_scope", "institution_type", "recipient_grade"), "compliance": ("service_scope", "institution_type"), "cost": ("service_scope", "recipient_grade"),
    "document": ("service_scope", "document_type"), "workflow": ("service_scope",), "exception": ("exception_context", "service_scope"),
}
ASSUMPTIONS = (
    "질문의 적용 범위를 노인요양시설/시설급여 맥락으로 우선 해석했습니다.", "문서 질문은 공식 서식 또는 운영상 필수 문서 기준으로 우선 해석했습니다.",
    "등급 정보가 없어서 일반적인 장기요양 수급자 기준으로 조건을 안내해야 할 수 있습니다.",
)
ASPECTS = ("체크리스트", "기한 며칠 이내", "필수 교육 안내 지침", "기록 서류 작성", "법적 근거")
# ------------------------------------------------------------------------------------------------
MARKS = r"[()\[\]{}'\"`’‘“”.,/\\\-_:;!?\s]"


def alias_key(text: Column) -> Column:
    """Lower case, without signs and white space."""
    return F.regexp_replace(F.lower(whole(text)), MARKS, "")


def _key(text: str) -> str:
    import re

    return re.sub(MARKS, "", text.lower())


def asks_of_food(q: Column) -> Column:
    return q.rlike(FOOD)


def asks_of_onboarding(q: Column) -> Column:
    """Whether a question is about what is to be done for a new recipient."""
    dense = F.regexp_replace(q, r"\s+", "")
    work = q.rlike(WORK[0]) | dense.rlike(WORK[1])
    return q.rlike(RECIPIENT) & (q.rlike(ONBOARDING[0]) | dense.rlike(ONBOARDING[1])) & work


def query_type(q: Column) -> Column:
    out = F.when(asks_of_food(q), F.when(q.rlike(EXPLAINS), "definition").otherwise("checklist")).when(asks_of_onboarding(q), "checklist")
    for kind, pattern in QUERY_TYPES:
        out = out.when(q.rlike(pattern), kind)
    return out.otherwise("application")


def primary_intent(q: Column, kind: Column) -> Column:
    out = F.when((kind == "definition") & q.rlike(DEFINES), "definition").when(asks_of_onboarding(q), "workflow").when(asks_of_food(q), F.when(q.rlike(EXPLAINS), "definition").otherwise("workflow"))
    for pattern, intent in INTENT_CUES:
        out = out.when(q.rlike(pattern), intent)
    for name, intent in TYPE_INTENTS.items():
        out = out.when(kind == name, intent)
    return out.otherwise("compliance")


def expansions(q: Column) -> Column:
    """The words of each group of which the question holds a trigger, distinct, in order."""
    low, groups = F.lower(q), []
    for triggers, words in EXPANSIONS:
        test = F.lit(False)
        for t in triggers:
            test = test | low.contains(t.lower())
        groups.append(F.when(test, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*groups))


def laws_named(q: Column) -> Column:
    """Each law of which the question holds a name, with the first name that it holds and the laws that may be meant too."""
    dense, out = alias_key(q), []
    for law, names, others in LAW_ALIASES:
        first = F.coalesce(*[F.when(dense.contains(_key(n)), F.lit(n)) for n in (law, *names)])
        out.append(F.when(first.isNotNull(), F.struct(F.lit(law).alias("canonical"), first.alias("alias"), (F.array(*map(F.lit, others)) if others else F.array().cast("array<string>")).alias("alternatives"))))
    return F.array_compact(F.array(*out))


def law_reference(q: Column) -> Column:
    """The law, article (and as jo its six digits), clause, item and sub-item of a question that is nothing but such a reference; null for others.

    q is ``rules.law_text``. The name must end like a law's or be a known name, which gives the law.
    """
    name, key = law_text(F.regexp_extract(q, LAW_REFERENCE, 1)), alias_key(law_text(F.regexp_extract(q, LAW_REFERENCE, 1)))
    said = lambda pairs: F.element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]), key)
    known = said({_key(n): law for law, names, _ in LAW_ALIASES for n in (law, *names)})
    alias = said({_key(n): n for _, names, _ in LAW_ALIASES for n in names})
    article = F.regexp_replace(F.regexp_extract(q, LAW_REFERENCE, 2), r"\s+", "")
    number = lambda group, unit: F.nullif(F.regexp_extract(F.regexp_extract(q, LAW_REFERENCE, group), f"제([0-9]+){unit}", 1), F.lit(""))
    jo = F.concat(F.lpad(F.regexp_extract(article, "제([0-9]+)조", 1), 4, "0"), F.lpad(F.regexp_extract(article, "조의([0-9]+)", 1), 2, "0"))
    is_law = (article != "") & (name.rlike(LAW_NAME) | known.isNotNull())
    return F.when(is_law, F.struct(F.coalesce(known, name).alias("law"), article.alias("article"), jo.alias("jo"), number(3, "항").alias("clause"), number(4, "호").alias("item"), number(5, "목").alias("sub_item"), alias.alias("alias")))


def lexicon_table(spark, rows: tuple = LEXICON) -> DataFrame:
    """(place, expression, canonical, entity_type, slot, confidence, status) of a list made by hand; others come from ``sources.tables.lexicon``."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, expression string, canonical string, entity_type string, slot string, confidence double, status string")


def lexicon_hits(questions: DataFrame, lexicon: DataFrame, text: str = "normal") -> DataFrame:
    """(query_id, turn, entry's columns): the lexicon's entries whose expression a question holds, signs and white space aside; surest first.

    Entries are found by one automaton over the lexicon; entries of equal expression all count. An empty expression is held nowhere.
    """
    keyed = lexicon.withColumn("key", alias_key(F.col("expression")))
    found = occurrences(questions.select("query_id", alias_key(F.col(text)).alias("dense")), keyed.select(F.col("key").alias("expression")), "query_id", "dense", whole=False)
    met = found.withColumnRenamed("expression", "key").distinct().join(keyed, "key")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("confidence", F.lit(0.75))), "place"))
    return met.withColumn("turn", turn).drop("key")


def understood(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with normal, query_type, intent, expansions, laws, reference."""
    out = questions.withColumn("normal", law_text(F.trim(whole(F.col(question)))))
    out = out.withColumn("query_type", query_type(F.col("normal")))
    return out.withColumns({"intent": primary_intent(F.col("normal"), F.col("query_type")), "expansions": expansions(F.col("normal")), "laws": laws_named(F.col("normal")), "reference": law_reference(F.col("normal"))})


def slots(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, slot, slot_place, place, value, canonical, confidence, entity_type, status, source): what a question says of each slot, each canonical once.

    The lexicon's hits come first, in their order, then grades that the question writes and the cues that it holds.
    """
    own = hits.filter("slot IS NOT NULL").select("query_id", F.col("turn").cast("int").alias("turn"), "slot", F.col("expression").alias("value"), "canonical", F.coalesce("confidence", F.lit(0.75)).alias("confidence"), "entity_type", F.expr("CASE WHEN status <> 'rejected' THEN status END").alias("status"), F.lit("lexicon").alias("source"))
    grade = lambda g, k: F.struct((F.lit(100_000) + k).alias("turn"), F.lit("recipient_grade").alias("slot"), g.alias("value"), F.when(g == "인지지원등급", g).otherwise(F.concat(F.lit("장기요양 "), g)).alias("canonical"), F.lit(0.92).alias("confidence"), F.lit("grade").alias("entity_type"), F.lit("validated").alias("status"))
    fixed = [F.when(F.col("normal").rlike(p), F.struct(F.lit(200_000 + k).alias("turn"), F.lit(slot).alias("slot"), F.lit(value).alias("value"), F.lit(canonical).alias("canonical"), F.lit(sure).alias("confidence"), F.lit(kind).alias("entity_type"), F.lit(status).alias("status"))) for k, (p, slot, value, canonical, sure, kind, status) in enumerate(HEURISTICS)]
    guesses = F.concat(F.transform(F.regexp_extract_all("normal", F.lit(GRADES), F.lit(0)), grade), F.array_compact(F.array(*fixed)))
    rows = own.unionByName(asked.select("query_id", F.explode(guesses).alias("g")).select("query_id", "g.*", F.lit("heuristic").alias("source")))
    first = F.row_number().over(Window.partitionBy("query_id", "slot", "canonical").orderBy("turn"))
    kept = rows.withColumn("first", first).filter("first = 1").withColumn("opened", F.min("turn").over(Window.partitionBy("query_id", "slot")))
    kept = kept.withColumns({"slot_place": F.dense_rank().over(Window.partitionBy("query_id").orderBy("opened")), "place": F.row_number().over(Window.partitionBy("query_id", "slot").orderBy("turn"))})
    return kept.select("query_id", "slot", "slot_place", "place", "value", "canonical", "confidence", "entity_type", "status", "source")


def relation_requests(frames: DataFrame) -> DataFrame:
    """(query_id, place, relation, weight, source): relations that a frame's intents and slots ask for, each once, by the first that asks."""
    of = lambda intent, weight: F.transform(F.coalesce(F.element_at(F.create_map(*[x for k, v in INTENT_RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), intent), F.array().cast("array<string>")), lambda r: F.struct(r.alias("relation"), F.lit(weight).alias("weight"), F.lit("intent").alias("source")))
    by_slot = []
    for names, relation, weight in SLOT_RELATIONS:
        test = F.lit(False)
        for n in names:
            test = test | F.array_contains("slots", n)
        by_slot.append(F.when(test, F.struct(F.lit(relation).alias("relation"), F.lit(weight).alias("weight"), F.lit("slot").alias("source"))))
    all_ = F.concat(of(F.col("intent"), PRIMARY_WEIGHT), F.flatten(F.transform("secondary", lambda i: of(i, SECONDARY_WEIGHT))), F.array_compact(F.array(*by_slot)))
    rows = frames.select("query_id", F.posexplode(all_).alias("place", "r")).select("query_id", "place", "r.*")
    first = F.row_number().over(Window.partitionBy("query_id", "relation").orderBy("place"))
    return rows.withColumn("first", first).filter("first = 1").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).select("query_id", "place", "relation", "weight", "source")


def frames(asked: DataFrame, hits: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """asked with secondary, slots, missing (critical slots without a value), assumptions and risk."""
    hinted = hits.groupBy("query_id").agg(F.collect_set("slot").alias("hinted"))
    held = slot_rows.groupBy("query_id").agg(F.array_sort(F.collect_set("slot")).alias("slots"), F.max(F.when((F.col("slot") == "institution_type") & (F.col("place") == 1), F.col("canonical"))).alias("institution"))
    out = asked.join(hinted, "query_id", "left").join(held, "query_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"hinted": F.coalesce("hinted", none), "slots": F.coalesce("slots", none)})
    secondary = F.array_compact(F.array(
        F.when(F.col("query_type").isin("checklist", "procedure"), "workflow"), F.when(F.array_contains("hinted", "cost_topic"), "cost"), F.when(F.array_contains("hinted", "document_type"), "document"), F.when(F.col("query_type") == "comparison", "comparison"),
    ))
    critical = F.coalesce(F.element_at(F.create_map(*[x for k, v in CRITICAL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("intent")), none)
    has = lambda s: F.array_contains("slots", s)
    assumed = F.array_compact(F.array(
        F.when(has("institution_type") & ~has("service_scope") & (F.col("institution") == "노인요양시설"), ASSUMPTIONS[0]), F.when(has("document_type") & F.col("normal").rlike("서류|양식|문서"), ASSUMPTIONS[1]),
        F.when(~has("recipient_grade") & F.col("normal").rlike("(수급자|어르신|보호자|입소)") & (F.col("intent") == "eligibility"), ASSUMPTIONS[2]),
    ))
    out = out.withColumns({"secondary": F.filter(F.array_distinct(secondary), lambda i: i != F.col("intent")), "missing": F.array_except(critical, "slots"), "assumptions": assumed})
    return out.withColumn("risk", risk(F.col("missing"), F.col("assumptions"))).drop("hinted", "institution")


def risk(missing: Column, assumptions: Column) -> Column:
    return F.when(F.size(missing) >= 2, "high").when((F.size(missing) == 1) | (F.size(assumptions) > 0), "medium").otherwise("low")


def entities(asked: DataFrame, hits: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """(query_id, place, entity_type, canonical, label, confidence, source): what a question names, each entity once, surest first."""
    row = lambda df, turn, label, canonical, kind, sure, source: df.select("query_id", turn.cast("int").alias("turn"), label.alias("label"), canonical.alias("canonical"), kind.alias("entity_type"), sure.cast("double").alias("confidence"), source.alias("source"))
    c = F.col
    rows = row(hits, c("turn"), c("expression"), c("canonical"), c("entity_type"), F.coalesce("confidence", F.lit(0.75)), F.lit("lexicon"))
    rows = rows.unionByName(row(slot_rows, F.lit(100_000) + 1000 * c("slot_place") + c("place"), c("value"), c("canonical"), F.coalesce("entity_type", F.lit("concept")), c("confidence"), c("source")))
    named = asked.select("query_id", F.posexplode("laws").alias("k", "law"))
    rows = rows.unionByName(row(named, F.lit(200_000) + c("k"), c("law.alias"), c("law.canonical"), F.lit("law"), F.lit(0.95), F.lit("query")))
    rows = rows.unionByName(row(asked.filter("reference IS NOT NULL"), F.lit(300_000), c("normal"), F.concat_ws(" ", c("reference.law"), c("reference.article")), F.lit("law"), F.lit(0.98), F.lit("query")))
    best = F.row_number().over(Window.partitionBy("query_id", "entity_type", alias_key(c("canonical"))).orderBy(F.desc("confidence"), "turn"))
    first = F.min("turn").over(Window.partitionBy("query_id", "entity_type", alias_key(c("canonical"))))
    kept = rows.withColumns({"first": first, "best": best}).filter("best = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "first", "canonical"))
    return kept.select("query_id", place.alias("place"), "entity_type", "canonical", "label", "confidence", "source")


def variants(asked: DataFrame, entity_rows: DataFrame, slot_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, terms, variants): the canonical terms of a question, of entities, slots, its own tokens and expansions, and all wordings to search for."""
    none = F.array().cast("array<string>")
    ordered = lambda df, order, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "canonical"))), lambda x: x["canonical"]).alias(name))
    terms_of = F.create_map(*[x for r, words in RELATION_TERMS.items() for x in (F.lit(r), F.array(*map(F.lit, words)))])
    related = requests.withColumn("words", F.element_at(terms_of, F.col("relation"))).groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: F.coalesce(x["words"], none))).alias("related"))
    out = asked.join(ordered(entity_rows, ["place"], "named"), "query_id", "left").join(ordered(slot_rows, ["slot_place", "place"], "said"), "query_id", "left").join(related, "query_id", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("named", "said", "related")})
    own = F.filter(tokens(F.col("normal")), lambda t: ~t.isin(*STOP_TOKENS))
    out = out.withColumn("terms", F.slice(F.filter(F.array_distinct(F.concat("named", "said", own, "expansions")), lambda t: t != ""), 1, MOST_TERMS))
    r = lambda *parts: F.concat_ws(" ", *parts)
    law, article = F.col("reference.law"), F.col("reference.article")
    laws = F.when(law.isNotNull(), F.array_compact(F.array(law, r(law, article), F.when(F.col("reference.clause").isNotNull(), r(law, article, F.concat(F.lit("제"), F.col("reference.clause"), F.lit("항")))), F.when(F.col("reference.item").isNotNull(), r(law, article, F.concat(F.lit("제"), F.col("reference.item"), F.lit("호"))))))).otherwise(none)
    aliases = F.flatten(F.transform("laws", lambda x: F.concat(F.array(x["canonical"]), x["alternatives"])))
    all_ = F.concat(F.array("normal"), aliases, laws, "expansions", "terms", "related", "said")
    return out.select("query_id", "terms", F.filter(F.array_distinct(all_), lambda t: t != "").alias("variants"))


def aspect_questions(q: Column) -> Column:
    """A procedure question with each aspect behind it, and with its compounds in front; none for others."""
    made = F.concat(F.array(*[F.concat_ws(" ", q, F.lit(a)) for a in ASPECTS]), F.transform(F.slice(compound_variants(q), 1, 6), lambda t: F.concat_ws(" ", t, q)))
    return F.when(asks_for_procedure(q), F.array_distinct(made)).otherwise(F.array().cast("array<string>"))
