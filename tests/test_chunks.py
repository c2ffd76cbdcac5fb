"""Chunks, their windows and what lists gain from their surroundings, against rules written down here."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import chunks as C
from tessera.operators import context as X


def made(spark, texts, name="guide.md"):
    rows = [(i, t, n, f"/knowledge/{n}") for i, (t, n) in enumerate((t, name) if isinstance(t, str) or t is None else t for t in texts)]
    return R.metadata(spark.createDataFrame(rows, "doc_id long, text string, name string, path string"))


def block(text, start=0, **more):
    return {"text": text, "span_start": start, "span_end": start + len(text), "protected": False, "checklist": False, "list_group_id": None, **more}


def test_heading_trail(spark):
    text = "intro\n# A\na\n## B\nb\n### C\nc\n## D\nd\n제3조(목적)\nlaw\n# E\n1. one\n2. two\n\n3. lonely heading\nrest"
    rows = C.section_rows(made(spark, [text, None, "", " \n\t", "plain"])).orderBy("doc_id", "section_no").collect()
    assert [(r["doc_id"], r["section_title"], r["section_path"], r["reason"]) for r in rows] == [
        (0, "guide", ["guide"], "document-root"), (0, "A", ["guide", "A"], "markdown-heading"), (0, "B", ["guide", "A", "B"], "markdown-heading"),
        (0, "C", ["guide", "A", "B", "C"], "markdown-heading"), (0, "D", ["guide", "A", "D"], "markdown-heading"), (0, "제3조(목적)", ["guide", "A", "D", "제3조(목적)"], "law-heading"),
        (0, "E", ["guide", "E"], "markdown-heading"), (0, "3. lonely heading", ["guide", "E", "3. lonely heading"], "numbered-subheading"), (4, "guide", ["guide"], "document-root"),
    ]
    assert rows[5]["article_no"] == "제3조" and rows[6]["content"] == "# E\n1. one\n2. two" and (rows[6]["line_start"], rows[6]["line_end"]) == (12, 15)


def test_answers_stay_with_questions_in_question_files_alone(spark):
    text = "질문 1\nwhat\n답변 1\nthis\n답변 2\nand that\n사례 1\ncase\n답변 3\nown"
    titles = lambda name: [r["section_title"] for r in C.section_rows(made(spark, [text], name)).orderBy("section_no").collect()]
    assert titles("faq.md") == ["질문 1", "사례 1", "답변 3"]
    assert titles("guide.md") == ["질문 1", "답변 1", "답변 2", "사례 1", "답변 3"]


def test_blocks_and_spans(spark):
    text = "# H\n\npara  one\nline\n\n\n\n- a\n- b\n \n| x | y |\n| 1 | 2 |\n\n  tail 확인  "
    row = C.section_blocks(C.section_lines(made(spark, [text]))).collect()[0]
    got = [(b["text"], row["content"][b["span_start"] : b["span_end"]], b["protected"], b["checklist"]) for b in row["blocks"]]
    assert got == [
        ("# H", "# H", False, False), ("para one\nline", "para one\nline", False, False), ("- a\n- b", "- a\n- b", True, True), ("| x | y |\n| 1 | 2 |", "| x | y |\n| 1 | 2 |", True, True), ("tail 확인", "tail 확인", False, True),
    ]
    law = C.section_blocks(C.section_lines(made(spark, ["제1조 a\nx\n\ny\n[별표 1]\nz"]))).orderBy("section_no").collect()
    assert [[b["text"] for b in r["blocks"]] for r in law] == [["제1조 a\nx\n\ny"], ["[별표 1]\nz"]]


def test_windows_overlap_and_fill():
    windows = list(C.windows_of([block("a" * 500, 0), block("b" * 500, 502), block("c" * 100, 1004), block("d" * 500, 1106), block("e" * 700, 1608)]))
    assert [w[1] for w in windows] == ["\n\n".join(("a" * 500, "b" * 500, "c" * 100)), "\n\n".join(("b" * 500, "c" * 100, "d" * 500)), "\n\n".join(("d" * 500, "e" * 700))]
    assert [(w[0], w[2], w[3]) for w in windows] == [(0, 0, 1104), (1, 502, 1606), (2, 1106, 2308)]
    wide = list(C.windows_of([block("a" * 1000), block("b" * 1000, checklist=True), block("c" * 500)]))
    assert [len(w[1]) for w in wide] == [2002, 1502] and [w[5] for w in wide] == [True, True]
    lists = list(C.windows_of([block("a", protected=True, list_group_id="x"), block("b", protected=True, list_group_id="y"), block("c", protected=True, list_group_id="x")]))
    assert len(lists) == 1 and len(lists[0][4]) == 40
    assert not list(C.windows_of([]))


def test_oversized_blocks_keep_qualifications():
    plain = [w[1] for w in C.windows_of([block("x" * 3000)])]
    assert [len(p) for p in plain] == [1200, 2402, 2042]  # the last piece before is taken over whole
    text = "y" * 2300 + " 단, 3일 이내 " + "z" * 300 + "\n\n" + "w" * 900
    first = next(C._pieces(block(text, protected=True, checklist=True)))
    assert first["text"].endswith("z" * 300) and first["span_end"] == text.index("w")
    rest = next(C._pieces(block("y" * 2300 + " 단, 3일 이내 " + "z" * 3000, protected=True, checklist=True)))
    assert rest["span_end"] == 3000
    assert next(C._pieces(block("y" * 1150 + " 단, 3일 이내 " + "z" * 3000)))["span_end"] == 1200


def test_long_sections_take_linear_time():
    def seconds(n):
        blocks = [block("w " * (5 + k % 40), k) for k in range(n)]
        began = time.perf_counter()
        assert sum(1 for _ in C.windows_of([*blocks, block("word " * (n * 10), 0)])) > n // 40
        return time.perf_counter() - began

    seconds(2_000)
    assert seconds(40_000) < 20 * max(seconds(8_000), 0.02)  # five times the text


def test_chunk_rows_of_odd_files(spark):
    files = made(spark, [None, "", "text", ("제2조 x\n" + "y " * 900, "고시 제9조.md"), "text"])
    rows = C.chunk_rows(files.withColumn("section_no", F.lit("clash")).withColumn("line", F.lit("clash"))).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"]) for r in rows] == [(2, 0), (3, 0), (3, 1), (4, 0)]
    assert rows[1]["article_no"] == "제2조" and rows[2]["text"].startswith("제2조 x\n") and "chunk-policy:law" in rows[1]["matched_labels"]
    assert len({r["chunk_id"] for r in rows}) == 4 and rows[0]["embedding_input"] == "[문서: guide]\n[섹션: guide]\n[경로: guide]\n\nguide\ntext"
    assert C.chunk_rows(files.limit(0)).count() == 0
    counts = {r["doc_id"]: (r["n_chunks"], r["n_sections"]) for r in C.document_rows(files, C.chunk_rows(files)).collect()}
    assert counts == {0: (0, 0), 1: (0, 0), 2: (1, 1), 3: (2, 1), 4: (1, 1)}
    context = C.evidence_context(C.chunk_rows(files).filter("doc_id = 3").withColumn("q", F.lit(1)).withColumn("label", F.lit("L")), "q", "chunk_index").first()
    assert context["n"] == 2 and context["context"].count("\n\n---\n\n") == 1 and "Article: 제2조" in context["context"]


def test_lines_are_cut_once_and_short_sections_need_no_fold(spark):
    rng = random.Random(3)
    signs = ("a", "단, 3일 이내", "\u00a0", " \u3000", "\t", "- x", "- y", "| a |", "", "", "\r", "# h", "제1조 z", "w" * 700, "v " * 900, "\ufeff")
    files = made(spark, ["\n".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(40)])
    plan = C.chunk_rows(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and plan.count("collect_list(") == 1
    sections = C.section_blocks(C.section_lines(files))
    expected = {(r["doc_id"], r["section_no"], *w[:1], *w[2:], w[1] in r["content"] or None) for r in sections.collect() for w in C.windows_of(b.asDict() for b in r["blocks"])}
    rows = C.section_windows(sections.withColumn("section_title", F.lit(""))).join(sections.select("doc_id", "section_no", "content"), ["doc_id", "section_no"]).collect()
    got = {(r["doc_id"], r["section_no"], r["window_index"], r["span_start"], r["span_end"], r["list_group_id"], r["contains_checklist"], r["text"] in r["content"] or None) for r in rows}
    assert got == expected and len(got) == len(rows) and {w for _, _, w, *_ in got} > {0, 1}


def random_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(d * 100 + w, d, d * 10 + w // 4, w, "x" * rng.choice((10, 300, 690, 900, 1500)) + rng.choice(("alpha", "beta", "gamma", "alphabeta", "")), rng.choice([*X.ROLE_POINTS, "general"]), [rng.choice(X.LABEL_POINTS)[0]], f"t{d % 4}", None if w % 2 else f"a{w % 3}", f"s{w // 4}") for d in range(12) for w in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, section_id long, window_index int, text string, source_role string, matched_labels array<string>, title string, article_no string, section_title string")
    lists = []
    for q in range(25):
        some = rng.sample(rows, 30)
        lists += [(q, r[0], k + 1, float(60 - 2 * k if rng.random() < 0.8 else 40)) for k, r in enumerate(some)]
    return rows, chunks, lists, spark.createDataFrame(lists, "query_id long, chunk_id long, rank int, score double")


def test_small_to_big_against_a_loop(spark):
    rows, chunks, lists, candidates = random_lists(spark, 5)
    by_id = {r[0]: r for r in rows}
    got = X.small_to_big(candidates.filter("rank <= 12"), chunks, role_chars={"routing_summary": 2900}).orderBy("query_id", "place").collect()
    expected = []
    for q in range(25):
        evidence = [(c, s) for qq, c, k, s in lists if qq == q and k <= 12]
        ids, seen, found = {c for c, _ in evidence}, set(), []
        for k, (c, s) in enumerate(evidence):
            mine = sorted((r for r in rows if r[2] == by_id[c][2]), key=lambda r: r[3])
            at = mine.index(by_id[c])
            for relation, n in ((0, at - 1), (1, at + 1)):
                if 0 <= n < len(mine) and mine[n][0] not in ids | seen:
                    seen.add(mine[n][0])
                    points = sum(X.ROLE_POINTS.get(r[5], 10) for r in (mine[n], by_id[c])) + dict(X.LABEL_POINTS)[mine[n][6][0]] + s / 10
                    found.append((-round(points, 9), k, relation, mine[n]))
        n = used = 0
        budget = 2900 if any(by_id[c][5] == "routing_summary" for c in ids) else 2400
        for place, (*_, r) in enumerate(sorted(found, key=lambda f: f[:3]), 1):
            size = len(r[4]) if len(r[4]) <= 700 else 703
            verdict = "skipped-chunks" if n >= 6 else "skipped-chars" if used + size > budget else "included"
            if verdict == "included":
                n, used = n + 1, used + size
            expected.append((q, place, r[0], verdict))
    assert [(r["query_id"], r["place"], r["chunk_id"], r["verdict"]) for r in got] == expected
    assert {v for *_, v in expected} == {"included", "skipped-chars", "skipped-chunks"}


def test_entity_coverage_against_a_loop(spark):
    rows, chunks, lists, candidates = random_lists(spark, 6)
    by_id = {r[0]: r for r in rows}
    anchors = {"A": ("alpha",), "B": ("beta", "alpha beta"), "C": ("gamma", "never")}
    questions = [(q, ("ALPHA beta", "be ta", "none of these", "gamma or alphabeta", None)[q % 5]) for q in range(25)]
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = X.with_entities(candidates.filter("rank <= 8"), candidates, chunks, asked, X.anchor_table(spark, anchors)).collect()
    points = lambda text, a: sum(len(s.replace(" ", "")) for s in anchors[a] if s.replace(" ", "") in text)
    key = lambda c: (by_id[c][7], by_id[c][8] or by_id[c][9])
    expected = set()
    for q, question in questions:
        dense = (question or "").replace(" ", "").lower()
        wanted = [a for a in anchors if points(dense, a)]
        own = [(c, k, s) for qq, c, k, s in lists if qq == q]
        held, inds, forced = {c for c, k, _ in own if k <= 8}, {key(c) for c, k, _ in own if k <= 8}, 0
        for c, k, _ in own:
            if k <= 8:
                expected.add((q, c, next((a for a in wanted if points(by_id[c][4], a)), None), False))
        for a in wanted:
            for c, k, _ in sorted((x for x in own if points(by_id[x[0]][4], a)), key=lambda x: (-points(by_id[x[0]][4], a), -x[2], x[1])):
                if forced < 4 and c not in held and key(c) not in inds:
                    held.add(c)
                    inds.add(key(c))
                    forced += 1
                    expected.add((q, c, a, True))
    assert {(r["query_id"], r["chunk_id"], r["anchor_id"], r["forced"]) for r in got} == expected and len(got) == len(expected)
    assert sum(f for *_, f in expected) > 20


def test_lists_of_one_length_stay(spark):
    _, chunks, _, candidates = random_lists(spark, 7)
    grouped = chunks.withColumn("list_group_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("g"), "doc_id")))
    got = X.with_list_groups(candidates.filter("rank <= 10"), candidates, grouped, 12)
    assert {r["n"] for r in got.groupBy("query_id").agg(F.max("rank").alias("n")).collect()} <= {10, 11, 12}
    same = X.with_list_groups(candidates.filter("rank <= 10"), candidates, grouped.withColumn("list_group_id", F.lit(None).cast("string")), 10)
    assert same.filter("expanded").count() == 0 and same.count() == 250
    assert X.small_to_big(candidates.limit(0), chunks).count() == 0 and X.in_sequence(candidates.limit(0), chunks).count() == 0
