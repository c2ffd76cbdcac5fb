"""Operators on literal rows."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text, vector
from tessera.operators import graph, manifest, reports, retrieval, sections
from tessera.sources import sinks, tables
from tessera.streaming import ingest


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("Call 010-1234-5678 or a@b.co, id 900101-1234567",), ("제 3 조의 2 본문",), (None,), ("a" * 130,)], "t string")
    got = df.select(text.masked(F.col("t"), ids_first=True), text.article_no(F.col("t")), F.length(text.preview(F.col("t")))).collect()
    assert got[0][0] == "Call [REDACTED_PHONE] or [REDACTED_EMAIL], id [REDACTED_ID]"
    assert [r[1] for r in got] == [None, "제3조의2", None, None] and [r[2] for r in got][2:] == [0, 120]
    follow = spark.createDataFrame([("And that?",), ("A question that stands for itself and is long",)], "t string").select(text.is_follow_up(F.col("t")))
    assert [r[0] for r in follow.collect()] == [True, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]


def test_sections_and_packing(spark):
    doc = "intro\n# One\nbody\n\n## Two\n\n# Three\nlast"
    df = spark.createDataFrame([(1, doc), (2, None), (3, "")], "doc_id long, text string")
    got = sections.sections(df).orderBy("doc_id", "section_no").collect()
    assert [(r["doc_id"], r["title"], r["start_line"], r["n_lines"]) for r in got] == [(1, "intro", 0, 1), (1, "One", 1, 3), (1, "Two", 4, 2), (1, "Three", 6, 2)]
    long = spark.createDataFrame([(1, "\n".join(["x" * 500] * 5 + ["y" * 3000, "z"]))], "doc_id long, text string")
    expected, size = [], 0
    for block in ["x" * 500] * 5 + ["y" * 3000, "z"]:
        if expected and size + 1 + len(block) <= sections.WINDOW:
            expected[-1], size = expected[-1] + 1, size + 1 + len(block)
        else:
            expected.append(1)
            size = len(block)
    assert [r["n_blocks"] for r in sections.packed(long).orderBy("chunk_index").collect()] == expected
    w = sections.neighbours(sections.windows(long)).orderBy("window_index").collect()
    assert w[0]["previous"] is None and w[0]["next"] == 1 and w[-1]["next"] is None and w[1]["span_start"] == 1080
    assert "".join(r["content"][: 1080 if r["next"] is not None else None] for r in w) == "\n".join(["x" * 500] * 5 + ["y" * 3000, "z"])


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbbbb"), (1, 3, "c")], "query_id int, rank int, content string")
    assert [r["rank"] for r in sections.char_budget(df, 9).collect()] == [1]


def test_caps_drop_or_defer(spark):
    df = spark.createDataFrame([(1, k, g) for k, g in enumerate("aabab", 1)], "query_id int, rank int, g string")
    assert values(retrieval.capped(df, "g", 1, defer=False).select("rank", "g")) == [(1, "a"), (2, "b")]
    deferred = retrieval.capped(df, "g", 2, defer=True).orderBy("rank").collect()
    assert [(r["g"], r["deferred"]) for r in deferred] == [("a", False), ("a", False), ("b", False), ("b", False), ("a", True)]


def test_fusion_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 11, 0.9, 1)], "query_id int, doc_id int, score double, rank int")
    got = retrieval.fused({"a": a, "b": b}).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [11, 10] and abs(got[0]["fused"] - (1 / 52 + 1 / 51)) < 1e-8 and got[1]["b_score"] is None


def test_vectors_in_salted_parts_equal_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "doc_id long, embedding array<double>")
    asked = rows.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    one = values(retrieval.vector(rows, asked, 5))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 1)
    assert values(retrieval.vector(rows, asked, 5)) == one and len(one) == 30


def test_manifest_diff_and_upsert(spark):
    schema = "path string, content_hash string, size long, chunk_count long"
    disk = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "3", 1, 1)], schema)
    index = spark.createDataFrame([("a", "1", 1, 1), ("b", "9", 1, 1), ("d", "4", 1, 1)], schema)
    assert values(manifest.diff(disk, index)) == [("b", "stale"), ("c", "missing"), ("d", "orphaned")]
    assert values(manifest.upserted(index, disk.filter("path = 'b'"), "path").select("path", "content_hash")) == [("a", "1"), ("b", "2"), ("d", "4")]
    assert values(manifest.latest(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, n int, v string"), "k", "n")) == [(1, 2, "y")]


def test_issues(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, " "), (4, "a\x00b"), (5, "x" * 5000)], "doc_id long, text string")
    assert values(manifest.issues(df, sections.sections(df)).select("code", "doc_id")) == [
        ("duplicate-content", 1), ("duplicate-content", 2), ("empty-document", 3), ("nul-stripped", 4), ("oversized-section", 5),
    ]


def test_nearest_rank_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3)] + [(None,)], "value double")
    got = reports.latency(df, "value").first()
    assert (got["n"], got["mean"], got["p50"], got["p95"], got["largest"]) == (5, 3.0, 3.0, 5.0, 5.0)


def test_graph_expansion_adds_on_every_edge(spark):
    links = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 0.1), ("a", "c", "r", 1.0)], "src string, dst string, relation string, weight double")
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    got = {r["entity_id"]: (r["hops"], r["boost"]) for r in graph.expand(seeds, links, 2).collect()}
    # hop 1: b 3, c 3; hop 2: from b to a 3 and c 2, from c to a 3 and b 2
    assert got == {"a": (0, 6.0), "b": (1, 5.0), "c": (1, 5.0)}


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "evaluation").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, body in (("a.md", b"one\x00two"), ("evaluation/b.txt", b"x"), (".hidden/c.md", b"y"), ("d.json", b"{}")):
        (tmp_path / name).write_bytes(body)
    got = tables.knowledge_files(spark, str(tmp_path)).select("name", "content", "nul_stripped", "mode")
    assert values(got) == [("a.md", "onetwo", True, "integrated"), ("b.txt", "x", False, "evaluation")]


def test_tolerant_parsers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([('["a","b"]', "[1,2.5]", "3"), ("a > b", "no", "x"), (None, None, None)], "s string, e string, n string")
    got = df.select(tables.string_array(F.col("s")), tables.embedding(F.col("e")), tables.number(F.col("n"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["a", "b"], []] and [r[2] for r in got] == [3.0, 0.0, 0.0]
    assert got[0][1] == [1.0, 2.5] and not got[1][1]
    chunks = spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [1.0]), ("h3", None)], "chunk_hash string, embedding array<double>")
    sinks.write_embedding_cache(chunks, f"{tmp_path}/cache", 2)
    back = sinks.restored(chunks.withColumn("embedding", F.lit(None).cast("array<double>")), spark.read.parquet(f"{tmp_path}/cache"))
    assert values(back.select("chunk_hash", F.size(F.coalesce("embedding", F.array().cast("array<double>"))))) == [("h1", 2), ("h2", 0), ("h3", 0)]
    sinks.write_upsert(chunks.select("chunk_hash"), chunks.select("chunk_hash").limit(1), "chunk_hash", f"{tmp_path}/up")
    assert spark.read.parquet(f"{tmp_path}/up").count() == 3


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame([(1, "x" * 2000), (2, "y")], schema).write.parquet(f"{tmp_path}/in")
    ingest.chunk_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    ingest.chunk_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    at = datetime.datetime(2024, 1, 1, 0, 10)
    events = spark.createDataFrame([(at, "a", 1.0), (at, "a", 2.0)], "ts timestamp, event_type string, value double")
    got = ingest.windowed_log(events).collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0)]


def test_snapshots_keep_the_version_before(spark, tmp_path):
    from tessera.sources.snapshots import Snapshots

    schema = spark.createDataFrame([], "k long, v string").schema
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    held = lambda t, version=None: sorted(map(tuple, t.read(version).collect()), key=repr)
    t = Snapshots(spark, str(tmp_path / "t"), schema, "k", 8)
    assert held(t) == [] and t.change(rows()) == 0
    assert t.write(rows(*((k, f"v{k}") for k in range(50)), (None, "none"))) == 1
    before = t._listed(1)
    assert t.change(rows((3, "new"), (3, "twice"), (77, "added")), rows((4, None), (99, None))) == 2
    after = t._listed(2)
    touched = {b for b in before if before[b] != after.get(b)}
    assert 1 <= len(touched) <= 5 and all(before[b] == after[b] for b in set(before) - touched)  # other buckets keep their files
    now = held(t)
    assert (3, "new") in now and (3, "twice") in now and (4, "v4") not in now and (77, "added") in now and len(now) == 52 and (None, "none") in now
    assert (4, "v4") in held(t, 1) and len(held(t, 1)) == 51
    # a writer that dies between its files and the list leaves no version
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    for write in (lambda: t.change(rows((1, "lost"))), lambda: t.write(rows())):
        try:
            write()
        except OSError:
            pass
    t._publish = publish
    assert held(t) == now and t.versions() == [1, 2]
    assert t.update(spark.createDataFrame([(1, "set"), (1000, "nowhere")], "k long, v string")) == 3 and (1, "set") in held(t) and len(held(t)) == 52
    try:
        t._publish({}, 3)
        raise AssertionError("a version was published twice")
    except ValueError:
        pass


def test_overlay_equals_a_rebuilt_index_after_each_batch(spark, tmp_path):
    import random

    from tessera.operators import overlay, retrieval

    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(("red", "blue", "green", "grey", "gold", "pink", "teal")) for _ in range(rng.randint(1, 6)))
    asked = spark.createDataFrame([(1, "red gold"), (2, "teal pink blue"), (3, "nothing"), (4, "")], "query_id long, question string")
    index, docs = overlay.OverlayIndex(spark, str(tmp_path / "index")), {}
    for batch in range(4):
        changes = [(k, None if rng.random() < 0.3 else text(), s) for s, k in enumerate(rng.choices(range(12), k=8))] + [(None, "red", 0)]
        docs |= {k: t for k, t, _ in changes if k is not None}
        frame = spark.createDataFrame(changes, "doc_id long, text string, seq int")
        if batch == 2:  # dies between the two tables, and runs again
            change, index.posted.change = index.posted.change, lambda *a: (_ for _ in ()).throw(OSError("lost"))
            try:
                index.apply(frame, batch)
            except OSError:
                pass
            index.posted.change = change
        index.apply(frame, batch)
        index.apply(frame, batch)  # a batch that comes twice counts once
        live = spark.createDataFrame([(k, t) for k, t in docs.items() if t is not None], "doc_id long, text string")
        got = {tuple(r) for r in index.search(asked).select("query_id", "doc_id", "score", "n_matched", "rank").collect()}
        assert got == {tuple(r) for r in retrieval.lexical(live, asked).select("query_id", "doc_id", "score", "n_matched", "rank").collect()} and got


def test_ranks_of_a_crowded_group(spark):
    import math
    import random

    from tessera.operators import reports

    rng = random.Random(1)
    rows = [("hot", float(rng.randint(0, 4000))) for _ in range(6000)] + [("b", 1.0), ("b", 2.0), (None, 5.0), ("c", None)]
    log = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in reports.latency(log, "v", "g").collect()}
    for g in ("hot", "b", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert (got[g]["n"], got[g]["p50"], got[g]["p95"], got[g]["largest"]) == (len(own), own[math.ceil(len(own) * 0.5) - 1], own[math.ceil(len(own) * 0.95) - 1], own[-1])
    assert len(got) == 3 and reports.latency(log.limit(0), "v").first()["n"] == 0
    assert "percentile" not in reports.latency(log, "v", "g")._jdf.queryExecution().toString()


def test_vector_lists_in_small_steps(spark, monkeypatch):

    rows = [(k, [float((k * 7 + d * 3) % 11 - 5) for d in range(4)]) for k in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = corpus.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieval.vector(corpus, asked, k=5).collect()))
    monkeypatch.setattr(retrieval, "CELLS", 18)  # three texts at once
    assert len(want) == 30 and sorted(map(tuple, retrieval.vector(corpus, asked, k=5).collect())) == want


def test_lists_pass_the_texts_once(spark, monkeypatch):
    from tessera.plans import rule_queries

    folder, made, own = "/root/testdata/sf0.001", [], retrieval.question_index
    monkeypatch.setattr(retrieval, "question_index", lambda *a: made.append(1) or own(*a))
    out = rule_queries.miss_classes(spark, folder)
    assert len(made) == 1 and "MapInPandas" not in out._jdf.queryExecution().toString()


def test_overlay_search_shuffles_no_pairs_of_query_and_text(spark):
    import re

    from tessera.operators import index, overlay, retrieval

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 2 + k % 9))) for k in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5 none w1"), (3, "")], "query_id long, question string")
    posted = index.postings(docs, "doc_id", "text")
    got = overlay.search(posted, index.document_frequency(posted), 60, asked)
    assert not re.search(r"hashpartitioning\(query_id#\w+, doc_id#", got._jdf.queryExecution().executedPlan().toString())
    columns = ("query_id", "doc_id", "score", "n_matched", "rank")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, retrieval.lexical(docs, asked).select(*columns).collect()))
