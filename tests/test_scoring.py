"""Points of candidates, traces and index reports on literal rows."""

from pyspark.sql import functions as F

from tessera.operators import quality, scoring, traces

ASKED = "question string, intent string, mode string, priority string, linked boolean, aliases array<string>, laws array<struct<name:string,article:string,clause:string,item:string>>, query_id int"
CHUNK = "doc_id int, title string, name string, section string, article_no string, search_text string, text string, source_type string, source_role string, doc_mode string, effective_date string, path string, has_list boolean"


def candidate(spark, asked, *chunks):
    q = scoring.question_context(spark.createDataFrame([(*asked, 1)], ASKED))
    rows = scoring.chunk_context(spark.createDataFrame(list(chunks), CHUNK))
    return rows.withColumn("query_id", F.lit(1)).join(q, "query_id").withColumns({"fused": F.lit(0.0), "lexical_score": F.lit(None).cast("double"), "vector_score": F.lit(None).cast("double"), "exact_score": scoring.exact_points()})


def test_exact_points(spark):
    law = ("노인복지법 제3조 2024.01.05", "legal-exact", "evaluation", "legal_judgment", False, ["노인복지", "x"], [("노인 복지법", "제3조", "2", "")])
    fits = (1, "노인복지법", "노인복지법.md", "제3조 정의", "제3조", "제3조 본문", "제2항 내용", "law", "general", "evaluation", "2024-01-01", "/k", False)
    bare = (2, None, None, None, None, None, None, None, None, None, None, None, None)
    got = dict(candidate(spark, law, fits, bare).select("doc_id", "exact_score").collect())
    # name 34, article 40, tokens 6 (title) + 4 (section), alias 30, law 38 + 52 + 8, kind 8, mode 6, month 10
    assert got == {1: 34 + 40 + 6 + 4 + 30 + 38 + 52 + 8 + 8 + 6 + 10, 2: 0}


def test_heading_lookup_and_priority(spark):
    asked = ("방문요양 낙상 매뉴얼 문서 확인", "manual-qna", "integrated", "operational_workflow", True, None, None)
    book = (1, "방문요양 매뉴얼", "방문요양 매뉴얼.md", "낙상", None, "방문요양 낙상 예방", "t" * 30, "manual", "support_reference", "integrated", None, "/k", True)
    other = (2, "x", "x.md", "y", None, "방문요양", "t" * 30, "evaluation", "primary_evaluation", "evaluation", None, "/k", False)
    rows = candidate(spark, asked, book, other)
    terms = rows.select("focus").first()[0]
    assert "낙상" in terms and "문서" not in terms
    points = dict(rows.select("doc_id", scoring.lookup_points()).collect())
    assert points[2] == 0 and points[1] >= 48 + 12 + 24 + 64
    assert dict(rows.select("doc_id", scoring.priority_points(F.col("priority"), F.col("linked"))).collect()) == {1: 16.0, 2: 6.5}
    assert dict(rows.select("doc_id", scoring.authority_points(2025)).collect()) == {1: 8.0, 2: 28.0}
    head = rows.select("doc_id", scoring.heading_points(F.array(F.lit("낙상"), F.lit("없음")), F.col("section"), F.col("search_text"), F.col("has_list"))).collect()
    assert dict(head) == {1: 18.0, 2: 0.0}
    boosts = spark.createDataFrame([(2, 1000.0)], "doc_id int, boost double")
    best = scoring.reranked(rows, boosts=boosts)
    assert [(r["doc_id"], r["rank"]) for r in best.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert scoring.reranked(rows.filter("false")).count() == 0


def test_drift_guard(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 100.0, 1), (1, 2, 50.0, 60.0, 2), (2, 3, 0.0, 9.0, 1), (3, 4, 5.0, 500.0, 1), (3, 5, 9.0, 1.0, 2)], "query_id int, doc_id int, exact_score double, rerank_score double, rank int")
    got = {(r["query_id"], r["doc_id"]): (r["rank"], r["rerank_score"], r["guarded"]) for r in scoring.drift_guarded(rows).collect()}
    assert got == {(1, 2): (1, 101.0, True), (1, 1): (2, 100.0, False), (2, 3): (1, 9.0, False), (3, 4): (1, 500.0, False), (3, 5): (2, 97.0, True)}


def test_traces(spark):
    kind = "case_id int, latency map<string,double>, stages array<struct<stage:string,n:long,notes:array<string>>>, trace array<struct<step:string,detail:string>>, windows array<struct<relation:string,selected:boolean,section:string>>"
    store = "a: dbLexical=1ms, vector = 2ms,corpus=3,total=6ms,dbLexicalCandidates=7,vectorCandidates=1,dbLexical=9ms;:x=1;b:vector=1"
    rows = spark.createDataFrame(
        [(1, {"hydeMs": 2.0, "retrievalMs": 2.0}, None, [("search-store-latency", store), ("sub-search-latency", "t=1ms,t=2.5ms, u=xms"), ("search-memo", "hits=1 misses=2"), ("search-memo", "Hits=3 misses=1 size=4"), (None, None)], []),
         (2, None, None, None, None), (3, {}, [], [], [("next", None, ""), ("next", True, "s")])], kind,
    )
    assert [tuple(r) for r in traces.stage_rows(rows, "search-store-latency", traces.STORE).drop("at", "pos").collect()] == [(1, "a", 9.0, 2.0, 3.0, 6.0, 7.0, 1.0)]
    assert [tuple(r) for r in traces.step_latencies(rows, "sub-search-latency").collect()] == [(1, "t", 2.5)]
    assert [tuple(r) for r in traces.counters(rows, "search-memo").collect()] == [(1, 3, 1, 4)]
    assert [tuple(r) for r in traces.window_cases(rows).collect()] == [(3, 2, 0, 0, 2, 1, 1, 2)]
    assert [tuple(r[0]) for r in rows.orderBy("case_id").select(traces.dominant(F.col("latency"))).collect()] == [("hydeMs", 2.0), ("totalMs", 0.0), ("totalMs", 0.0)]
    empty = rows.filter("false")
    assert traces.counter_summary(traces.counters(empty, "search-memo")).first()["hit_rate"] == 0 and traces.window_summary(traces.window_cases(empty)).first()["cases"] == 0
    assert traces.authority_cases(rows.withColumn("expected", F.lit("b guide")).withColumn("titles", F.lit(None).cast("array<string>"))).select("found_at").distinct().collect()[0][0] == "missing"


def test_index_reports(spark):
    chunks = spark.createDataFrame([(["chunk-policy:qa", "chunk-boundary:h"], None, None, "  x "), (["chunk-policy:qa"], "g", True, "y"), (None, None, None, None)], "labels array<string>, list_group string, checklist boolean, text string")
    got = sorted(map(tuple, quality.policy_report(chunks).collect()))
    assert got == [("qa", 2, 1, 1, 0, 1, "h=1,unknown=1"), ("unclassified", 1, 0, 0, 0, 0, "unknown=1")]
    windows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "a", 1), (1, "a", 3), (1, "b", 7), (None, "b", 1)], "doc_id int, section string, window_index int")
    assert sorted(map(tuple, quality.parents(windows).collect())) == [(1, "a", 3, 0, 3, 2, 2), (1, "b", 1, 7, 7, 0, 0)]
    none = quality.coverage(spark.createDataFrame([], "n_embedded long, n_chunks long")).first()
    assert tuple(none) == (0, 0, 0.0)
