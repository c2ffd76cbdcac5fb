"""What questions ask: benchmark texts behind phrases in Korean, terms of the tables' own words in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import automaton as A
from tessera.operators import questions as U
from tessera.plans import retrieval_queries as Q
from tessera.sources.tables import table

PHRASES = (
    "방문요양 3등급 본인부담금은 얼마", "장기요양법 제 12 조의2 제3항", "신규 수급자 오면 해야 할 일", "요양원 인력기준 의무", "케어플랜 서류 작성 절차", "주야간보호 vs 방문요양 차이", "노복법 제35조", "감경 예외 조건 1등급 2등급",
    "기피식품이란 뭔가요", "급여비용 고시 제4조 제2호", "데이케어 신청 자격 누가", "의사소견서 문서 찾아줘", "위반 처분", "욕구사정 체크리스트", "뭐야", "시설장 평가 입소 초기",
)
#: References stand alone; other phrases are followed by the question's own words.
_ASKED = f"CASE query_id % {len(PHRASES)} " + " ".join(f"WHEN {k} THEN " + (f"'{p}'" if "조" in p and "조건" not in p else f"concat('{p} ', substr(question, 1, 40))") for k, p in enumerate(PHRASES)) + " END"
#: Expressions of texts' own words, some inside others; a canonical group for each first letter.
_EXPRESSIONS = "SELECT DISTINCT unnest([substr(text, 1, 5), substr(text, 1, 8), substr(text, 4, 4), substr(text, 11, 6)]) AS expression FROM benchmark"


def asked(spark, sf):
    return U.understood(Q._questions(spark, sf).selectExpr("query_id", f"{_ASKED} AS question"))


def _frames(spark, sf):
    own = asked(spark, sf)
    hits = U.lexicon_hits(own, U.lexicon_table(spark))
    slots = U.slots(own, hits)
    return own, hits, slots, U.frames(own, hits, slots)


def question_types(spark, sf):
    return asked(spark, sf).select("query_id", "normal", "query_type", "intent", F.array_join("expansions", "|").alias("expansions"), F.array_join(F.transform("laws", lambda x: F.concat_ws("=", x["alias"], x["canonical"])), "|").alias("laws"))


def law_references(spark, sf):
    return asked(spark, sf).filter("reference IS NOT NULL").select("query_id", "reference.*")


def question_slots(spark, sf):
    return _frames(spark, sf)[2].drop("slot_place")


def question_frames(spark, sf):
    f = _frames(spark, sf)[3]
    return f.select("query_id", "intent", F.array_join("secondary", "|").alias("secondary"), F.array_join("slots", "|").alias("slots"), F.array_join("missing", "|").alias("missing"), F.size("assumptions").alias("n_assumptions"), "risk")


def question_relations(spark, sf):
    return U.relation_requests(_frames(spark, sf)[3])


def question_entities(spark, sf):
    own, hits, slots, _ = _frames(spark, sf)
    return U.entities(own, hits, slots)


def question_variants(spark, sf):
    """Terms and search wordings of each question (tokens of Hangul are beyond the SQL, so there is none)."""
    own, hits, slots, frames = _frames(spark, sf)
    out = U.variants(own, U.entities(own, hits, slots), slots, U.relation_requests(frames))
    return out.select("query_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"), F.size("variants").alias("n_variants"))


def _expressions(spark, sf):
    parts = [F.substring("text", 1, 5), F.substring("text", 1, 8), F.substring("text", 4, 4), F.substring("text", 11, 6)]
    return table(spark, sf, "benchmark").select(F.explode(F.array(*parts)).alias("expression")).distinct()


def expression_places(spark, sf):
    """The first place of every expression in every document that holds it."""
    found = A.occurrences(table(spark, sf, "documents"), _expressions(spark, sf))
    return found.groupBy("doc_id", "expression").agg(F.min("start").alias("first"))


def expression_groups(spark, sf):
    """Expressions that a scan of each document takes, leftmost and longest, and their numbers by canonical group."""
    taken = A.leftmost_longest(A.occurrences(table(spark, sf, "documents"), _expressions(spark, sf)))
    return taken.groupBy("doc_id", F.substring("expression", 1, 1).alias("canonical")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("expression")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (question_types, law_references, question_slots, question_frames, question_relations, question_entities, question_variants, expression_places, expression_groups)}

def _key(text: str) -> str:
    marks = U.MARKS.replace("'", "''")
    return f"regexp_replace(lower({text}), '{marks}', '', 'g')"


def _law_text(text: str) -> str:
    for pattern, by in ((r"\s*-\s*", "-"), (r"\s+", " "), (r"제\s+([0-9]+)\s+([조항호목])", r"제\1\2"), (r"\(\s+", "("), (r"\s+\)", ")")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim({text})"


def _cases(pairs, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in pairs) + f" ELSE {last} END"


def _has(pattern: str, column: str = "normal") -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_FOOD, _EXPLAINS = _has(U.FOOD), _has(U.EXPLAINS)
_DENSE = "regexp_replace(normal, '\\s+', '', 'g')"
_NEW = f"({_has(U.RECIPIENT)} AND ({_has(U.ONBOARDING[0])} OR {_has(U.ONBOARDING[1], _DENSE)}) AND ({_has(U.WORK[0])} OR {_has(U.WORK[1], _DENSE)}))"
_TYPE = _cases([(f"{_FOOD} AND {_EXPLAINS}", "'definition'"), (f"{_FOOD} OR {_NEW}", "'checklist'"), *((_has(p), f"'{k}'") for k, p in U.QUERY_TYPES)], "'application'")
_INTENT = _cases(
    [(f"query_type = 'definition' AND {_has(U.DEFINES)}", "'definition'"), (_NEW, "'workflow'"), (f"{_FOOD} AND {_EXPLAINS}", "'definition'"), (_FOOD, "'workflow'"), *((_has(p), f"'{i}'") for p, i in U.INTENT_CUES), *((f"query_type = '{t}'", f"'{i}'") for t, i in U.TYPE_INTENTS.items())], "'compliance'",
)
_EXPANDED = " || ".join(f"CASE WHEN {' OR '.join(f'contains(lower(normal), {chr(39)}{t}{chr(39)})' for t in triggers)} THEN {_list(words)} ELSE CAST([] AS VARCHAR[]) END" for triggers, words in U.EXPANSIONS)
_LAWS = ", ".join("CASE " + " ".join(f"WHEN contains(dense, '{U._key(n)}') THEN '{n}={law}'" for n in (law, *names)) + " END" for law, names, _ in U.LAW_ALIASES)
_UNDERSTOOD = f"""
a0 AS (SELECT item_id AS query_id, text AS question FROM benchmark), a1 AS (SELECT query_id, {_ASKED} AS question FROM a0), a2 AS (SELECT query_id, {_law_text("question")} AS normal FROM a1),
a3 AS (SELECT *, {_key("normal")} AS dense, {_TYPE} AS query_type FROM a2), asked AS (SELECT *, {_INTENT} AS intent FROM a3)"""
_REFERENCE = f"""{_UNDERSTOOD},
r0 AS (SELECT query_id, normal, {_law_text(f"regexp_extract(normal, '{U.LAW_REFERENCE}', 1)")} AS name, regexp_replace(regexp_extract(normal, '{U.LAW_REFERENCE}', 2), '\\s+', '', 'g') AS article, regexp_extract(normal, '{U.LAW_REFERENCE}', 3) AS c, regexp_extract(normal, '{U.LAW_REFERENCE}', 4) AS i, regexp_extract(normal, '{U.LAW_REFERENCE}', 5) AS s FROM asked),
r1 AS (SELECT *, {_key("name")} AS k FROM r0 WHERE article <> ''),
refs AS (SELECT query_id, normal, coalesce(known, name) AS law, article, lpad(regexp_extract(article, '제([0-9]+)조', 1), 4, '0') || lpad(regexp_extract(article, '조의([0-9]+)', 1), 2, '0') AS jo, nullif(regexp_extract(c, '[0-9]+'), '') AS clause, nullif(regexp_extract(i, '[0-9]+'), '') AS item, nullif(regexp_extract(s, '[0-9]+'), '') AS sub_item, alias
  FROM (SELECT *, {_cases([(f"k IN ({', '.join(repr(U._key(n)) for n in (law, *names))})", f"'{law}'") for law, names, _ in U.LAW_ALIASES], "NULL")} AS known, {_cases([(f"k = '{U._key(n)}'", f"'{n}'") for _, names, _ in U.LAW_ALIASES for n in names], "NULL")} AS alias FROM r1) WHERE known IS NOT NULL OR regexp_matches(name, '{U.LAW_NAME}'))"""
_LEXICON = ", ".join(f"({k}, '{e}', '{c}', '{t}', '{s}', {n}::DOUBLE, '{st}')" for k, (e, c, t, s, n, st) in enumerate(U.LEXICON))
_GUESSED = " UNION ALL ".join(f"SELECT query_id, {200_000 + k}, '{slot}', '{value}', '{canonical}', {sure}::DOUBLE, '{kind}', '{status}', 'heuristic' FROM asked WHERE {_has(p)}" for k, (p, slot, value, canonical, sure, kind, status) in enumerate(U.HEURISTICS))
_SLOTS = f"""{_REFERENCE},
lexicon AS (SELECT * FROM (VALUES {_LEXICON}) t(place, expression, canonical, entity_type, slot, confidence, status)),
hits AS (SELECT query_id, lexicon.*, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, place) AS turn FROM asked JOIN lexicon ON contains(dense, {_key("expression")})),
grades AS (SELECT query_id, unnest(regexp_extract_all(normal, '{U.GRADES}')) AS g, generate_subscripts(regexp_extract_all(normal, '{U.GRADES}'), 1) - 1 AS k FROM asked),
s0 AS (SELECT query_id, turn, slot, expression AS value, canonical, confidence, entity_type, status, 'lexicon' AS source FROM hits
  UNION ALL SELECT query_id, 100000 + k, 'recipient_grade', g, CASE WHEN g = '인지지원등급' THEN g ELSE '장기요양 ' || g END, 0.92, 'grade', 'validated', 'heuristic' FROM grades UNION ALL {_GUESSED}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, slot, canonical ORDER BY turn) AS first FROM s0 QUALIFY first = 1),
s2 AS (SELECT *, min(turn) OVER (PARTITION BY query_id, slot) AS opened FROM s1),
slots AS (SELECT query_id, slot, dense_rank() OVER (PARTITION BY query_id ORDER BY opened) AS slot_place, row_number() OVER (PARTITION BY query_id, slot ORDER BY turn)::INTEGER AS place, value, canonical, confidence, entity_type, status, source FROM s2)"""
_CRITICAL = _cases([(f"intent = '{i}'", _list(s)) for i, s in U.CRITICAL.items()], "CAST([] AS VARCHAR[])")
_FRAMES = f"""{_SLOTS},
held AS (SELECT query_id, list_sort(list_distinct(list(slot))) AS slots, max(canonical) FILTER (slot = 'institution_type' AND place = 1) AS institution FROM slots GROUP BY query_id), hinted AS (SELECT query_id, list(slot) AS hinted FROM hits GROUP BY query_id),
f0 AS (SELECT asked.*, coalesce(slots, []) AS slots, institution, coalesce(hinted, []) AS hinted FROM asked LEFT JOIN held USING (query_id) LEFT JOIN hinted USING (query_id)),
frames AS (SELECT *, list_filter([CASE WHEN query_type IN ('checklist', 'procedure') THEN 'workflow' END, CASE WHEN list_contains(hinted, 'cost_topic') THEN 'cost' END, CASE WHEN list_contains(hinted, 'document_type') THEN 'document' END, CASE WHEN query_type = 'comparison' THEN 'comparison' END], lambda x: x IS NOT NULL AND x <> intent) AS secondary,
  list_filter({_CRITICAL}, lambda x: NOT list_contains(slots, x)) AS missing,
  (list_contains(slots, 'institution_type') AND NOT list_contains(slots, 'service_scope') AND coalesce(institution, '') = '노인요양시설')::INTEGER + (list_contains(slots, 'document_type') AND {_has("서류|양식|문서")})::INTEGER + (NOT list_contains(slots, 'recipient_grade') AND {_has("(수급자|어르신|보호자|입소)")} AND intent = 'eligibility')::INTEGER AS n_assumptions FROM f0)"""
_OF = "CASE " + " ".join(f"WHEN {{0}} = '{i}' THEN {_list(r)}" for i, r in U.INTENT_RELATIONS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_BY_SLOT = " UNION ALL ".join(f"SELECT query_id, {1000 + k}, '{relation}', {weight}::DOUBLE, 'slot' FROM frames WHERE {' OR '.join(f'list_contains(slots, {chr(39)}{s}{chr(39)})' for s in names)}" for k, (names, relation, weight) in enumerate(U.SLOT_RELATIONS))
SQL = {
    "question_types": f"WITH {_UNDERSTOOD} SELECT query_id, normal, query_type, intent, array_to_string(list_filter({_EXPANDED}, lambda x, k: list_position({_EXPANDED}, x) = k), '|') AS expansions, array_to_string(list_filter([{_LAWS}], lambda x: x IS NOT NULL), '|') AS laws FROM asked",
    "law_references": f"WITH {_REFERENCE} SELECT query_id, law, article, jo, clause, item, sub_item, alias FROM refs",
    "question_slots": f"WITH {_SLOTS} SELECT * EXCLUDE (slot_place) FROM slots",
    "question_frames": f"WITH {_FRAMES} SELECT query_id, intent, array_to_string(secondary, '|') AS secondary, array_to_string(slots, '|') AS slots, array_to_string(missing, '|') AS missing, n_assumptions, CASE WHEN len(missing) >= 2 THEN 'high' WHEN len(missing) = 1 OR n_assumptions > 0 THEN 'medium' ELSE 'low' END AS risk FROM frames",
    "question_relations": f"""WITH {_FRAMES},
intents AS (SELECT query_id, 0 AS k, intent AS i FROM frames UNION ALL SELECT query_id, generate_subscripts(secondary, 1), unnest(secondary) FROM frames),
r AS (SELECT query_id, 100 * k + generate_subscripts({_OF.format("i")}, 1) AS turn, unnest({_OF.format("i")}) AS relation, CASE WHEN k = 0 THEN 1.2 ELSE 0.9 END::DOUBLE AS weight, 'intent' AS source FROM intents UNION ALL {_BY_SLOT}),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, relation ORDER BY turn) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn)::INTEGER AS place, relation, weight, source FROM one""",
    "question_entities": f"""WITH {_SLOTS},
named AS (SELECT query_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS k FROM (SELECT query_id, list_filter([{_LAWS}], lambda x: x IS NOT NULL) AS l FROM asked)),
e0 AS (SELECT query_id, turn, expression AS label, canonical, entity_type, confidence, 'lexicon' AS source FROM hits UNION ALL SELECT query_id, 100000 + 1000 * slot_place + place, value, canonical, coalesce(entity_type, 'concept'), confidence, source FROM slots
  UNION ALL SELECT query_id, 200000 + k, string_split(l, '=')[1], string_split(l, '=')[2], 'law', 0.95, 'query' FROM named UNION ALL SELECT query_id, 300000, normal, law || ' ' || article, 'law', 0.98, 'query' FROM refs),
e1 AS (SELECT *, {_key("canonical")} AS k FROM e0), e2 AS (SELECT *, min(turn) OVER (PARTITION BY query_id, entity_type, k) AS first FROM e1 QUALIFY row_number() OVER (PARTITION BY query_id, entity_type, k ORDER BY confidence DESC, turn) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, first, canonical)::INTEGER AS place, entity_type, canonical, label, confidence, source FROM e2""",
    "expression_places": f"WITH x AS ({_EXPRESSIONS}) SELECT doc_id, expression, (strpos(text, expression) - 1)::INTEGER AS first FROM documents JOIN x ON expression <> '' AND contains(text, expression)",
    "expression_groups": f"""WITH x AS ({_EXPRESSIONS}), w AS (SELECT string_agg(regexp_escape(expression), '|' ORDER BY length(expression) DESC, expression) AS w FROM x WHERE expression <> ''),
t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), w)) AS e FROM documents, w)
SELECT doc_id, substr(e, 1, 1) AS canonical, count(*) AS n, sum(length(e))::BIGINT AS n_chars FROM t GROUP BY ALL""",
}
