"""Questions, expressions, the ontology and claims: literal cases and brute force."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import automaton as A
from tessera.functions.text import compact
from tessera.operators import claims as C
from tessera.operators import ontology as O
from tessera.operators import questions as U


def asked(spark, *questions):
    return U.understood(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"))


def framed(spark, *questions):
    own = asked(spark, *questions)
    hits = U.lexicon_hits(own, U.lexicon_table(spark))
    slots = U.slots(own, hits)
    frames = U.frames(own, hits, slots)
    return own, hits, slots, frames, U.relation_requests(frames)


def test_types_and_intents(spark):
    cases = {
        "방문요양 본인부담금은 얼마": ("scope", "cost"), "신규 수급자가 오면 해야 할 일": ("checklist", "workflow"), "급여와 비용의 차이": ("comparison", "cost"), "기피식품이란 뭔가요": ("definition", "definition"), "기피식품 조사": ("checklist", "workflow"),
        "인력기준은": ("application", "compliance"), "신청 자격은 누가": ("procedure", "eligibility"), "위반하면": ("consequence", "sanction"), "면제": ("exemption", "exception"), "어떤 서식": ("application", "document"), "뭐야": ("definition", "definition"),
        "진행": ("procedure", "workflow"), "": ("application", "compliance"), "hello VS world": ("comparison", "comparison"),
    }
    got = {r["question"]: (r["query_type"], r["intent"]) for r in asked(spark, *cases, None).collect()}
    assert got == cases | {None: ("application", "compliance")}


def test_law_references(spark):
    cases = {
        "장기요양법 제 12 조의2 제 3 항": ("노인장기요양보험법", "제12조의2", "001202", "3", None, None, "장기요양법"), "노복법 제35조 제2호 제1목": ("노인복지법", "제35조", "003500", None, "2", "1", "노복법"),
        "아무개법 제1조": ("아무개법", "제1조", "000100", None, None, None, None), "아무말 제1조": None, "노인복지법": None, "노인복지법 제35조 알려줘": None,
        "( 급여비용 고시 ) 제4조": ("장기요양급여 제공기준 및 급여비용 산정방법 등에 관한 고시", "제4조", "000400", None, None, None, "급여비용 고시"),
    }
    assert {r["question"]: tuple(r["reference"]) if r["reference"] else None for r in asked(spark, *cases).collect()} == cases
    laws = asked(spark, "장기요양법 시행령과 노복법의 차이").first()["laws"]
    assert [(x["canonical"], x["alias"]) for x in laws] == [("노인장기요양보험법", "장기요양법"), ("노인장기요양보험법 시행령", "장기요양법 시행령"), ("노인복지법", "노복법")]
    assert laws[0]["alternatives"] == ["노인장기요양보험법 시행령", "노인장기요양보험법 시행규칙"]


def test_frames(spark):
    own, hits, slots, frames, requests = framed(spark, "방문요양 3등급 본인부담금 감경", "요양원 서류 절차", "의무")
    rows = {(r["query_id"], r["slot"], r["place"]): (r["canonical"], r["source"]) for r in slots.collect()}
    assert rows[0, "recipient_grade", 1] == ("장기요양 3등급", "lexicon") and (0, "recipient_grade", 2) not in rows
    assert rows[0, "exception_context", 1] == ("본인부담금 감경", "lexicon") and rows[0, "exception_context", 2] == ("예외", "heuristic")
    assert rows[1, "benefit_type", 1] == ("시설급여", "heuristic")
    got = {r["query_id"]: r for r in frames.collect()}
    assert (got[0]["intent"], got[0]["missing"], got[0]["risk"]) == ("exception", [], "low")
    assert got[1]["secondary"] == [] and got[1]["intent"] == "workflow" and got[1]["missing"] == ["service_scope"] and got[1]["assumptions"] == list(U.ASSUMPTIONS[:2]) and got[1]["risk"] == "medium"
    assert got[2]["missing"] == ["service_scope", "institution_type"] and got[2]["risk"] == "high"
    wanted = [(r["relation"], r["weight"]) for r in requests.filter("query_id = 0").orderBy("place").collect()]
    assert wanted == [("exception-of", 1.2), ("limited-by", 1.2), ("not-applies-to", 1.2), ("has-cost", 0.9), ("applies-to", 1.05), ("eligible-for", 1.08)]
    terms = U.variants(own, U.entities(own, hits, slots), slots, requests).filter("query_id = 0").first()
    assert terms["terms"][:4] == ["장기요양 3등급", "방문요양", "본인부담금", "본인부담금 감경"] and len(terms["terms"]) <= 24 and "예외" in terms["variants"]
    assert U.lexicon_hits(asked(spark, ""), U.lexicon_table(spark)).count() == 0
    made = asked(spark, "급여 작성 방법", "그냥").select("query_id", U.aspect_questions(F.col("question")).alias("a")).orderBy("query_id").collect()
    assert made[0]["a"][0] == "급여 작성 방법 체크리스트" and made[1]["a"] == []


def test_expressions_against_a_scan(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 5))) for _ in range(40)})
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "expression string")
    places = sorted((k, w, m.start(), m.start() + len(w)) for k, t in enumerate(texts) for w in words for m in re.finditer(f"(?={re.escape(w)})", t or ""))
    for block in (A.BLOCK_EXPRESSIONS, 7):  # one automaton, and several
        found = A.occurrences(docs, table, block=block)
        assert sorted(map(tuple, found.collect())) == places
    pattern = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))))
    scan = sorted((k, m.group(), m.start(), m.end()) for k, t in enumerate(texts) for m in pattern.finditer(t or ""))
    assert sorted(map(tuple, A.leftmost_longest(found).collect())) == scan
    assert A.occurrences(docs, table.limit(0)).count() == 0 and A.leftmost_longest(A.occurrences(docs.limit(0), table)).count() == 0


def test_labels_and_concepts(spark):
    cases = {"2-1) **인력 기준**.md": "인력 기준", "- 서류 | ": "서류", "제 3 조 목적": "목적", "## `급여` <br/> 계획;": "급여 계획", "(붙임) 1.2 평가 방법:": "평가 방법", "": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", O.clean_label(F.col("raw")).alias("label"), O.is_concept(O.clean_label(F.col("raw"))).alias("ok")).collect()
    assert {r["raw"]: r["label"] for r in rows} == cases
    assert {r["label"] for r in rows if r["ok"]} == {"인력 기준", "서류", "급여 계획", "평가 방법"}
    chunks = spark.createDataFrame([
        (1, 0, "급여 계획.md", "급여계획", "1. 인력 기준", "x\n- 급여계획\n* 본인부담 감경 서류\n판단 기준"), (1, 1, "급여 계획.md", "급여계획", "인력기준", "- 판단 기준\n- 주야간보호"), (2, 0, None, None, None, None), (None, 0, "평가", "평가", "평가", "평가"),
    ], "doc_id long, chunk_index int, title string, name string, section_title string, text string")
    got = O.concept_candidates(chunks).orderBy("place").collect()
    assert [(r["doc_id"], r["label"], r["source"], r["confidence"]) for r in got] == [(1, "급여 계획", "document-title", 0.82), (1, "인력 기준", "section-title", 0.72), (1, "본인부담 감경 서류", "document-text", 0.74), (1, "주야간보호", "document-text", 0.74)]
    said = O.concept_relations(O.concept_candidates(chunks), O.document_words(chunks)).collect()
    assert {(r["key"], r["relation"], r["target"]) for r in said} >= {("인력기준", "same-as", "직원배치기준"), ("인력기준", "applies-to", "주야간보호기관"), ("본인부담감경서류", "has-cost", "장기요양급여"), ("본인부담감경서류", "uses-document", "본인부담 감경 서류")}


def test_merging_takes_any_order(spark):
    rows = [(k, "x", f"L{k}" if k % 2 else None, ("candidate", "validated", "rejected", "candidate", "promoted")[k % 5], 0.1 * (k % 7), None if k < 3 else f"t{k}", f"s{k}", None) for k in range(20)]
    kind = "turn int, key string, label string, status string, confidence double, entity_type string, source string, status_reason string"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert tuple(O.merged_concepts(spark.createDataFrame(rows, kind).repartition(4)).first()) == ("x", "L1", "validated", 0.6, "t3", "s0", None, 20)


def test_clean_labels_stay_in_the_manifest(spark):
    kind = "doc_id long, place int, key string, label string, source string, confidence double"
    found = spark.createDataFrame([(20, 1, "급여계획", "### 급여 계획", "document-text", 0.74), (30, 1, "급여계획", "급여 계획", "section-title", 0.72)], kind)
    known = found.filter("doc_id = 20").selectExpr("label", "'promoted' AS status", "0.9D AS confidence", "'actor' AS entity_type", "'curated' AS source", "CAST(NULL AS STRING) AS status_reason")
    assert tuple(O.manifest(found, known, cleaned=True).first()) == ("급여계획", "### 급여 계획", "promoted", 0.9, "actor", "curated", None, 3)
    assert O.manifest(found, known).first()["label"] == "급여 계획"


def test_lookup_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3))))
    wordings = [(q, " ".join(word() for _ in range(rng.choice((0, 2, 9, 30))))) for q in range(15) for _ in range(2)] + [(3, "ab, cab ab"), (4, None), (5, "뭐야 12 34")]
    named = sorted({(f"e{rng.randrange(150)}", " ".join(word() for _ in range(rng.choice((1, 1, 2, 3, 5)))), rng.choice(("title", "name")), rng.choice((0.74, 1.15, 1.4, 0.0))) for _ in range(900)} | {("e0", "ab cab", "x", 1.0), ("e1", "뭐야 12", "x", 1.0), ("e2", "가 나", "x", 1.0)})
    asked = spark.createDataFrame(wordings, "query_id long, text string")
    table = spark.createDataFrame(named, "entity_id string, alias string, alias_type string, weight double").withColumn("key", compact(F.col("alias"))).repartition(3)
    a = [tuple(r) for r in asked.select("query_id", compact(F.col("text")), O.significant(F.col("text"))).filter("query_id >= 0").collect()]
    b = [tuple(r) for r in table.select("entity_id", "key", "alias", "weight", O.significant(F.col("alias"))).collect()]
    best = {}
    for q, dense, toks in a:
        for e, key, alias, w, own in b:
            n, least = len(set(toks) & set(own)), min(len(toks), len(own))
            points = ([12 * w] if dense and key == dense else []) + ([6 * w] if len(key) >= 3 and key in dense else []) + ([(4 + n * 2 + n / least * 4) * w] if dense and n >= 2 and n / least >= 0.45 else [])
            for p in points:
                best[q, e] = min(best.get((q, e), (1, "")), (-round(p, 9), alias))
    want = set()
    for q in {q for q, _ in best}:
        rows = sorted((minus, e, alias) for (k, e), (minus, alias) in best.items() if k == q)
        want |= {(q, e, -minus, alias, k + 1) for k, (minus, e, alias) in enumerate(rows[: O.HITS])}
    for block in (2000, 7):
        assert {tuple(r) for r in O.lookup(asked, table, block=block).select("query_id", "entity_id", "score", "alias", "rank").collect()} == want
    assert len({q for q, *_ in want}) > 8
    assert O.lookup(asked.limit(0), table).count() == 0 and O.lookup(asked, table.limit(0)).count() == 0


def test_expansion_stops_at_candidates_and_splits_hubs(spark):
    names = [("document:d1", "document", None), ("concept:hub", "concept", "validated"), ("concept:maybe", "concept", "candidate"), ("concept:far", "concept", None), *((f"concept:n{k}", "concept", None) for k in range(300))]
    edges = [("document:d1", "concept:hub", "r", 1.0), ("document:d1", "concept:maybe", "r", 1.0), ("concept:maybe", "concept:far", "r", 1.0), *(("concept:hub", f"concept:n{k}", "q", 0.1) for k in range(300))]
    bound = [("document:d1", 1), ("concept:hub", 2), ("concept:maybe", 3), ("concept:far", 4), *((f"concept:n{k}", 100 + k) for k in range(300))]
    tables = {"entities": spark.createDataFrame(names, "entity_id string, entity_type string, status string"), "edges": spark.createDataFrame(edges, "src string, dst string, relation string, weight double"), "bindings": spark.createDataFrame(bound, "entity_id string, doc_id long")}
    hits = spark.createDataFrame([(7, "concept:maybe", 5.0)], "query_id long, entity_id string, score double")
    anchors = spark.createDataFrame([(7, 1)], "query_id long, doc_id long")
    results = []
    for most in (O.HUB_EDGES, 10):
        got = {r["doc_id"]: r["boost"] for r in O.expand(hits, anchors, tables, 2, hub_edges=most).collect()}
        assert got[3] == 5.0 + 6.0 and got[2] == 6.0 and 4 not in got and got[100] == 2.0 and got[1] == 3.0 and len(got) == 303
        results.append(got)
    assert results[0] == results[1]
    edges_, hubs = O.dealt(tables["edges"], 10)
    assert {(r["node"], r["salts"]) for r in hubs.collect()} == {("concept:hub", 31)} and edges_.filter("node = 'concept:hub'").groupBy("salt").count().agg(F.max("count")).first()[0] < 40


def test_expansion_reads_what_it_starts_from_once(spark):
    from tessera.operators import ontology as O

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    nodes = ["document:a", "concept:x", "concept:y"]
    tables = {
        "entities": spark.createDataFrame([(e, e.split(":")[0], None) for e in nodes], "entity_id string, entity_type string, status string"),
        "bindings": spark.createDataFrame([(e, k) for k, e in enumerate(nodes)], "entity_id string, doc_id long"),
        "edges": spark.createDataFrame([(a, b, "r", 1.0) for a, b in zip(nodes, nodes[1:], strict=False)], "src string, dst string, relation string, weight double"),
    }
    anchors = spark.createDataFrame([(7, 0)], "query_id long, doc_id long").mapInPandas(counted, "query_id long, doc_id long")
    got = O.expand(spark.createDataFrame([], "query_id long, entity_id string, score double"), anchors, tables, depth=3)
    assert {tuple(r) for r in got.collect()} == {(7, 0, 3.0), (7, 1, 9.0), (7, 2, 3.0)} and read.value == 1


def test_claim_support_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    chunks = [(k, *(" ".join(word() for _ in range(n)) for n in (2, 2, 1, 8, 5, 12)), rng.choice(("law", "manual")), rng.choice(("evaluation", "integrated")), rng.choice(("primary_evaluation", "general")), rng.choice((None, "제1조"))) for k in range(60)]
    claims = [(q, "claim-main", rng.choice(("cost", "workflow", "compliance", "document", "assumption")), [*(word() for _ in range(5)), f"{word()} {word()}", "기준"], [rng.choice(C.ALL_BUCKETS)], []) for q in range(25)]
    frame = spark.createDataFrame(chunks, "chunk_id long, title string, section_title string, labels string, search_text string, text_preview string, text string, source_type string, mode string, source_role string, article_no string")
    table = spark.createDataFrame(claims, "query_id long, claim_id string, claim_type string, anchors array<string>, hints array<string>, scopes array<string>")
    some = [(q, k) for q in range(25) for k in range(60) if (q + k) % 3]
    evidence = spark.createDataFrame(some, "query_id long, chunk_id long")
    for allowed in (None, set(some)):
        expected = set()
        for q, _, kind, anchors, hints, _ in claims:
            found = []
            for c in chunks if kind != "assumption" else []:
                if allowed is not None and (q, c[0]) not in allowed:
                    continue
                best = {a: max([w for (_, w), f in zip(C.FIELDS, c[1:7]) if a in f] + [round(w - 0.4, 9) for (_, w), f in zip(C.FIELDS, c[1:7]) if a.replace(" ", "") in f.replace(" ", "")], default=0) for a in dict.fromkeys(anchors)}
                met = {a: w for a, w in best.items() if w}
                bucket = "legal" if c[7] == "law" else "evaluation" if c[8] == "evaluation" or c[9] == "primary_evaluation" else "practical"
                score = sum(met.values()) + 1.2 * (bucket in hints) + 1.8 * (bucket == "legal" and kind == "cost") + (2.2 * (c[9] == "primary_evaluation") + 1.4 * (bucket == "evaluation")) * (kind == "workflow") + 1.4 * (bucket == "legal" and kind == "compliance") + 0.8 * (kind == "document" and c[10] is not None)
                if sum(a != "기준" for a in met) >= 1:
                    found.append((-round(score, 6), c[0], len(met)))
            full = sorted(f for f in found if -f[0] >= 5.2 and f[2] >= 2)[:4]
            part = sorted(f for f in found if -f[0] >= 3.2)[:3]
            expected |= {(q, k, -s, "supported") for s, k, _ in full} or {(q, k, -s, "partial") for s, k, _ in part}
        got = C.claim_support(table, frame, None if allowed is None else evidence)
        assert {(r["query_id"], r["chunk_id"], r["score"], r["verdict"]) for r in got.collect()} == expected and len(expected) > 30
    status = {r["query_id"]: r["status"] for r in C.claim_coverage(table, got).collect()}
    assert len(status) == 25 and all(status[q] == "partial" for q, _, kind, *_ in claims if kind == "assumption")


def test_retrieval_issues(spark):
    own, hits, slots, frames, requests = framed(spark, "방문요양 3등급 본인부담금 비용", "요양원 인력기준 의무", "신규 수급자 오면 해야 할 일")
    terms = U.variants(own, U.entities(own, hits, slots), slots, requests)
    claims = C.claim_plan(frames, slots, terms, requests)
    plan = {r["query_id"]: r for r in claims.filter("claim_id = 'claim-main'").collect()}
    assert plan[0]["claim_type"] == "cost" and plan[0]["predicate"] == "has-cost" and plan[0]["scopes"] == ["home-visit-care"] and "고시" in plan[0]["anchors"] and plan[0]["hints"] == ["legal"]
    kind = "chunk_id string, title string, section_title string, labels string, search_text string, text_preview string, text string, source_type string, mode string, source_role string, article_no string"
    chunks = spark.createDataFrame([
        ("a", "방문요양 고시", "본인부담금", "", "방문요양 3등급 본인부담금", "", "급여비용", "law", "integrated", "general", "제1조"), ("b", "주야간보호", "x", "", "주야간보호 안내", "", "", "manual", "integrated", "general", None),
        ("c", "데이케어", "x", "", "y", "", "", "manual", "integrated", "general", None), ("e", "무관", "x", "", "y", "", "", "evaluation", "evaluation", "primary_evaluation", None),
    ], kind)
    evidence = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "e"), (1, "e")], "query_id long, chunk_id string")
    support = C.claim_support(claims, chunks, evidence)
    rules = spark.createDataFrame([("r", ["compliance", "cost"], ["service_scope"], {"legal": 2, "evaluation": 1}, ["has-cost"])], "rule_id string, intents array<string>, slots array<string>, buckets map<string,int>, relations array<string>")
    found = {(r["query_id"], r["code"], r["severity"], r["subject"]) for r in C.retrieval_issues(frames, claims, C.claim_coverage(claims, support), support, evidence, chunks, rules, requests).collect()}
    assert found == {
        (0, "insufficient-evidence-composition", "block", "r:legal"), (0, "insufficient-evidence-composition", "warning", "r:evaluation"), (0, "mixed-service-scope", "warning", "2"),
        (1, "unsupported-claim", "warning", "claim-main"), (1, "insufficient-evidence-composition", "info", "r:service_scope"), (1, "unsupported-claim", "warning", "r:has-cost"), (2, "unsupported-claim", "info", "claim-main"),
    }
    counts = {r["query_id"]: (r["n"], r["legal"], r["evaluation"], r["practical"]) for r in C.evidence_counts(evidence, chunks).collect()}
    assert counts == {0: (3, 1, 0, 2), 1: (1, 0, 1, 0)}


def test_retrieval_issues_read_whole_texts(spark, monkeypatch):
    from tessera.plans import claim_queries as P

    kind = "chunk_id string, title string, section_title string, labels string, search_text string, text_preview string, text string, source_type string, mode string, source_role string, article_no string"
    chunks = spark.createDataFrame([("b", "x", "x", "", "beginning", "beginning", "beginning " * 300 + "주야간보호", "manual", "integrated", "general", None), ("c", "x", "x", "", "beginning", "", None, "manual", "integrated", "general", None)], kind)
    assert {r["chunk_id"]: r["held"] for r in chunks.select("chunk_id", C.held_scopes().alias("held")).collect()} == {"b": ["day-night-care"], "c": []}
    own, hits, slots, frames, requests = framed(spark, "방문요양 3등급 본인부담금 비용")
    claims = C.claim_plan(frames, slots, U.variants(own, U.entities(own, hits, slots), slots, requests), requests)
    evidence = spark.createDataFrame([(0, "b"), (0, "c")], "query_id long, chunk_id string")
    support = C.claim_support(claims, chunks, evidence)
    rules = spark.createDataFrame([], "rule_id string, intents array<string>, slots array<string>, buckets map<string,int>, relations array<string>")
    found = {(r["query_id"], r["code"], r["subject"]) for r in C.retrieval_issues(frames, claims, C.claim_coverage(claims, support), support, evidence, chunks, rules, requests).collect()}
    assert (0, "mixed-service-scope", "1") in found
    # the query hands on every window of its documents, with all of its text
    passed = []
    monkeypatch.setattr(P.C, "retrieval_issues", lambda frames, claims, coverage, support, evidence, chunks, rules, requests: passed.append((evidence, chunks)) or frames)
    P.retrieval_issues(spark, "/root/testdata/sf0.01")
    evidence, chunks = passed[0]
    assert evidence.groupBy("query_id").count().count() > 1 and evidence.join(chunks, "chunk_id").filter("window_index >= 3").count() > 0
    assert chunks.filter("NOT search_text <=> text").count() == 0 and chunks.filter("length(search_text) > 600").count() > 0


def test_numbers_and_citations(spark):
    answers = spark.createDataFrame([(1, "1,234원 15% 3.5 15"), (2, "none"), (3, None), (4, "7")], "answer_id long, text string")
    cited = spark.createDataFrame([(1, "1234 and 15%"), (1, "3,5"), (4, "77 17"), (9, "7")], "answer_id long, text string")
    assert {tuple(r) for r in C.cited_numbers(answers, cited).collect()} == {(1, "1234", True), (1, "15%", True), (1, "3.5", True), (1, "15", False), (4, "7", False)}
    citations = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, "a", 0)], "answer_id long, chunk_id string, place int")
    loose = C.loose_citations(citations, spark.createDataFrame([(1, "a"), (1, "a")], "answer_id long, chunk_id string"))
    assert {tuple(r) for r in loose.collect()} == {(1, "b", 1, "not-in-evidence"), (1, "a", 2, "repeated"), (2, "a", 0, "not-in-evidence")}


def test_claims_in_blocks_and_small_batches(spark):
    """Many chunks of equal score, dealt over blocks of claims, tasks and batches: the same few are best."""
    chunks = spark.range(400).selectExpr(
        "id AS chunk_id", "CASE WHEN id % 3 = 0 THEN 'alpha beta' ELSE 'gamma' END AS title", "concat('sect ', id % 7) AS section_title", "'' AS labels", "CASE WHEN id % 5 = 0 THEN 'beta-alpha' END AS search_text", "'gam ma' AS text_preview",
        "'x' AS text", "CASE WHEN id % 4 = 0 THEN 'law' WHEN id % 4 = 1 THEN 'manual' END AS source_type", "'integrated' AS mode", "CASE WHEN id % 6 = 0 THEN 'primary_evaluation' END AS source_role", "CASE WHEN id % 2 = 0 THEN '제1조' END AS article_no",
    ).repartition(5)
    said = [["alpha", "beta"], ["alpha!", "alpha", "sect 3"], ["gamma"], ["nowhere"], [], None, ["기준", "gamma"]]
    claims = spark.createDataFrame([(q, "m", kind, a, ["legal"] if q % 2 else None, None) for q, (kind, a) in enumerate((k, a) for k in ("cost", "document") for a in said)], "query_id long, claim_id string, claim_type string, anchors array<string>, hints array<string>, scopes array<string>")
    found = []
    for block, rows in ((C.BLOCK_CLAIMS, 10_000), (3, 16)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found.append(sorted(map(tuple, C.claim_support(claims, chunks, block=block).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    best = {(r[0], r[2], r[3]) for r in found[0]}
    assert {x for x in best if x[0] == 0} == {(0, k, 8.2) for k in (0, 12, 24, 36)} and {x for x in best if x[0] == 7} == {(7, k, 8.4) for k in (0, 12, 24, 36)} and not [x for x in best if x[0] in (3, 4, 5)]


def test_alias_candidates(spark):
    from tessera.operators import aliases

    cases = {"(붙임) 2_노인 복지 안내.md": ("노인 복지 안내", False), "붙임 3_평가 기준": ("평가 기준", True), "- a_b `c`": ("a b c", True), "12": ("12", False), "2024년": ("2024년", False), "http://x.y": ("http://x.y", True), None: ("", False)}
    got = {r["raw"]: (r["a"], r["ok"]) for r in spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", aliases.clean_alias(F.col("raw")).alias("a"), aliases.is_useful(aliases.clean_alias(F.col("raw"))).alias("ok")).collect()}
    assert got["붙임 3_평가 기준"] == ("평가 기준", True) and got["12"][1] is False and got["2024년"][1] is False and got["http://x.y"][1] is False and got[None] == ("", False) and got["- a_b `c`"] == ("a b c", True)
    files = spark.createDataFrame([(1, "노인 평가기준 (개정).md", "/k/1"), (2, "안내서.md", "/k/2"), (None, "lost.md", "/k/3")], "doc_id long, name string, path string")
    chunks = spark.createDataFrame([(1, "c1", "노인 평가기준", "제1장 총칙", ["노인", "1) 방법 총정리"], "질문: 무엇인가요? 예\nx\nQ. second one"), (9, "c9", "foreign title", "foreign", None, None)], "doc_id long, chunk_id string, title string, section_title string, section_path array<string>, text string")
    asked = spark.createDataFrame([("k1", "평가기준", "노인 평가기준은?"), ("k2", "안내서.md의 부록", "부록은 어디"), ("k3", "없는 문서", "?")], "case_id string, expected string, question string")
    assert {tuple(r) for r in aliases.expected_documents(asked, files).collect()} == {("k1", 1), ("k2", 2)}
    found = {(r["doc_id"], r["alias"]): (r["source"], r["score"]) for r in aliases.candidates(files, chunks, asked).collect()}
    assert found[1, "노인 평가기준은?"] == ("benchmark-question", 1.0) and found[1, "평가기준"] == ("heading", 0.9) and found[1, "방법 총정리"] == ("heading", 0.9) and found[1, "무엇인가요? 예"] == ("qa-question", 0.85)
    assert found[1, "second one"][0] == "qa-question" and found[2, "안내서"][0] == "heading" and not {k for k in found if k[0] not in (1, 2)} and (1, "개정") not in found


def test_alias_questions_are_cleaned_once(spark):
    from tessera.operators import aliases

    files = spark.createDataFrame([(1, "안내서.md", "/k/1")], "doc_id long, name string, path string")
    chunks = spark.createDataFrame([(1, "c1", "안내서", "", None, "Q: 12.7.6.143 Aton total?\nQ: \nq. 3) 4) rest of it?")], "doc_id long, chunk_id string, title string, section_title string, section_path array<string>, text string")
    found = {(r["alias"], r["key"]) for r in aliases.candidates(files, chunks).filter("source = 'qa-question'").collect()}
    assert found == {("7.6.143 Aton total?", "76143atontotal?"), ("4) rest of it?", "4restofit?")}


def test_alias_patterns_read_as_sql_does(spark):
    import duckdb

    from tessera.functions.text import title_key
    from tessera.operators import aliases
    from tessera.plans import alias_queries as Q

    raws = [
        "on les oipa éenc", "encé reste", "Enc x", "x enc_", "\u00a0wide\u3000", "a\u000bb c", "name.md\u2028", "name.md\r", "ΟΔΟΣ ΟΔΟΣ", "İSTANBUL.MD", "123\u2028", "2024\u0085", "1 2 3 4 5 6 7 8 9 0 1 2\u000b3", "httpſ://x", "q: wha\u2028t? so", "Q: a\r\nQ: b.md\r", "질문：é? x", "ab", "",
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    alias = aliases.clean_alias(F.col("raw"))
    asked = F.transform(aliases.questions_in(F.col("raw")), aliases.clean_alias)
    got = [tuple(r) for r in rows.select("id", alias.alias("a"), aliases.compact_alias(alias).alias("k"), aliases.is_useful(alias).alias("ok"), title_key(F.col("raw")).alias("t"), F.array_join(asked, "|").alias("q")).orderBy("id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE rows_ (id INT, raw VARCHAR)")
    con.executemany("INSERT INTO rows_ VALUES (?, ?)", list(enumerate(raws)))
    question = f"concat_ws(' ', nullif(regexp_extract(l, '{aliases.QUESTION}', 1), ''), nullif(regexp_extract(l, '{aliases.QUESTION}', 2), ''))"
    asked = f"array_to_string(list_transform(list_filter(list_transform(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '{aliases.QUESTION}')), lambda l: {question}), lambda l: l <> ''), lambda l: {Q._clean('l')}), '|')"
    want = con.execute(f"SELECT id, a, k, {Q._USEFUL.format('a', 'k')}, {Q._KEY.format('raw')}, {asked} FROM (SELECT *, {Q._DENSE.format('a')} AS k FROM (SELECT *, {Q._clean('raw')} AS a FROM rows_)) ORDER BY id").fetchall()
    assert got == want
    assert [r[1] for r in got[:5]] == ["on les oipa é", "é reste", "x", "x", "wide"] and got[8][2] == "οδοσοδοσ"


def test_profiles_and_gates(spark):
    from tessera.operators import grounding as G

    cases = {"신규 수급자 등록 업무": ("enumeration", 48, 28, 5, 5, 4), "보호자 안내": ("checklist", 24, 22, 4, 3, 0), "비용": ("plain", 24, 18, 2, 2, 0), None: ("plain", 24, 18, 2, 2, 0)}
    got = spark.createDataFrame([(k,) for k in cases], "q string").select("q", G.expansion_profile(F.col("q")).alias("p")).collect()
    assert {r["q"]: tuple(r["p"]) for r in got} == cases
    chunks = spark.createDataFrame([
        (1, 10, 100, 0, "제3조", "alpha 상담", "계획 계약"), (2, 10, 100, 1, None, "beta", "욕구사정 평가"), (3, 20, 200, 5, None, "gamma", "x"), (4, 10, 100, 7, None, "alpha", "x"), (5, 10, 101, 0, None, "delta", "x"),
    ], "chunk_id long, doc_id long, section_id long, window_index int, article_no string, search_text string, text string")
    kind = "query_id long, chunk_id long, rank int, score double, exact_score double, lexical_score double, vector_score double"
    evidence = spark.createDataFrame([(1, 1, 1, 9.0, 0.0, 0.0, 1.0), (1, 2, 2, 8.0, 0.0, 0.0, 1.0), (2, 3, 1, 9.0, 45.0, None, None), (3, 3, 1, 5.0, 0.0, 0.0, 0.0)], kind)
    asked = spark.createDataFrame([(1, "절차 안내", "제3조", ["alpha", "none", "zero"], "high"), (2, "x", None, ["nothing"], "medium"), (3, "x", None, ["nothing"], "medium"), (4, "x", None, [], "high")], "query_id long, question string, article_asked string, focus array<string>, confidence string")
    gates = {r["query_id"]: tuple(r)[1:] for r in G.grounding(evidence, chunks, asked).collect()}
    assert gates == {1: (True, True, False, True, True), 2: (True, False, False, False, True), 3: (False, False, False, False, False), 4: (False, False, False, False, False)}
    focus = {r["query_id"]: tuple(r)[1:] for r in G.focus_gate(evidence, chunks, asked).collect()}
    assert focus == {1: (3, 1, 1, True, "high"), 2: (1, 0, 1, False, "low"), 3: (1, 0, 1, False, "low"), 4: (0, 0, 0, True, "high")}
    more = spark.createDataFrame([(1, 1, 1, 9.0, 0.0, 0.0, 1.0), (1, 4, 3, 7.0, 0.0, 0.0, None), (1, 5, 4, 6.0, 0.0, 0.0, 1.0), (1, 3, 5, 8.5, 0.0, 0.0, 1.0)], kind)
    said = {r["chunk_id"]: (r["selected"], r["reasons"]) for r in G.candidate_diagnostics(more, evidence, chunks, asked, ("none",)).collect()}
    assert said == {
        1: (True, []), 3: (False, ["generic-only-match"]), 4: (False, ["non-adjacent-window-in-selected-cluster", "lower-rerank-score-than-selected-evidence", "no-vector-signal"]),
        5: (False, ["generic-only-match", "document-cluster-limit", "lower-rerank-score-than-selected-evidence"]),
    }
    assert G.reason_counts(G.candidate_diagnostics(more, evidence, chunks, asked)).count() == 5


def test_places_leave_a_task_in_pieces(spark):
    taken = []
    parts = A.pieces((taken.append(k) or (k, "w") for k in range(7)), ["doc_id", "expression"], 3)
    assert len(next(parts)) == 3 and len(taken) == 3  # no more rows are made than go out
    assert [len(p) for p in parts] == [3, 1] and list(A.pieces(iter(()), ["a"])) == []
    n = A.ROWS_AT_ONCE + 5
    texts = spark.createDataFrame([(1, "ab" * n), (2, None), (3, "b")], "doc_id long, text string")
    found = A.occurrences(texts, spark.createDataFrame([("a",), ("ab",)], "expression string"))
    got = {(r["doc_id"], r["expression"], r["n"], r["first"], r["last"]) for r in found.groupBy("doc_id", "expression").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("stop").alias("last")).collect()}
    assert got == {(1, "a", n, 0, 2 * n - 1), (1, "ab", n, 0, 2 * n)}
