"""The pipeline's stages against brute force on planted cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(("ba", "ko", "ri", "ten", "mu", "sel")) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    words = lambda n: " ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) + "." for _ in range(n // 9))
    clean = [(i, words(180), "en", f"s{i % 4}", 0) for i in range(60)]
    passage = words(90)
    copies = [(100 + i, clean[i][1], "en", "s1", 0) for i in range(5)]
    repeats = [(200 + i, f"{words(90)} {passage} {words(90)}", "en", "s2", 0) for i in range(4)]
    junk = [(300 + i, " ".join(f"{rng.choice(vocabulary)}%%% ***" for _ in range(90)), "en", "s3", 0) for i in range(12)]
    bad = [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "short text", "en", "s0", 0), (403, "same " * 200, "en", None, 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(clean + copies + repeats + junk + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    kept = {r["doc_id"] for r in seen["quality_rules"]}
    assert kept == set(range(60)) | set(range(100, 105)) | set(range(200, 204))
    assert {r["doc_id"] for r in seen["simhash_near_dedup"]} == set(range(60)) | set(range(200, 204))
    texts = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    before = {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"]}
    assert all(texts[i] == before[i] for i in range(60)) and texts[200] == before[200]
    for i in (201, 202, 203):
        assert len(before[i]) - len(texts[i]) > 0.7 * len(passage)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"])
    draws = collections.Counter(r["doc_id"] for r in seen["source_mixing"])
    assert set(draws) <= set(texts) and max(draws.values()) <= 3
    pieces = collections.Counter(r["doc_id"] for r in seen["best_fit_packing"])
    assert pieces == draws
    docs.unpersist()


def test_run_and_empty(spark, folder, tmp_path):
    path, _ = folder
    one = corpus_pipeline.run(spark, path).groupBy("doc_id", "length", "ids_crc32").count().collect()
    two = corpus_pipeline.run(spark, path).groupBy("doc_id", "length", "ids_crc32").count().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_the_names_of_helpers_stay(spark, folder):
    path, _ = folder
    names = ("quality", "dedup", "mix", "near", "key", "size", "block", "hash", "plan", "info", "words", "tokens", "ratio", "got", "spans", "k1", "spot")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) > 50 and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
