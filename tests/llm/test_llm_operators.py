"""Every operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import html_blocks, html_extraction, license_scans, mixing, packing, quality_rules, simhash, substring_dedup, token_counts, topk_search, url_filters
from tessera.llm.shared import shared_path
from tessera.llm.tokenizing import PieceEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(("river", "silt", "delta", "tide", "Bank", "größe", "niño", "mouth", "cc", "by")) + str(rng.randint(0, 400)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    passage = " ".join(sentence(rng, 15) for _ in range(5))
    texts += [texts[0], texts[0], texts[1] + " more", f"{texts[2]} stop {passage} {texts[3]}", f"{texts[4]}\n{passage}", passage]
    texts += [None, "", "  \n\t ", LONG, "one", "<|endoftext|> x", "a\x1cb\x85c\u00a0d", "All rights reserved. CC-BY 4.0\nAll rights reserved.", "%%% *** ###\n%%% *** ###\n" * 40]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 1) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[5], None, None, None), (None, None, None, None, None), (5000, texts[6], "x", "src0", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_html_blocks_and_tree(spark):
    model = html_extraction.train(spark)
    rows_ = html_extraction.labelled(spark).collect()
    tree = html_extraction.Tree(model)
    x = np.array([r["features"].toArray() for r in rows_])
    assert (tree.is_main(x) == np.array([model.predict(r["features"]) > 0.5 for r in rows_])).all()
    assert (tree.is_main(x) == np.array([r["label"] > 0.5 for r in rows_])).mean() > 0.97
    # held out, page by page in five folds
    hits, pages = [], html_extraction.PAGES
    for fold in range(5):
        held = html_extraction.Tree(html_extraction.train(spark, [p for i, p in enumerate(pages) if i % 5 != fold]))
        for page, letters in pages[fold::5]:
            hits += (held.is_main(np.array(html_blocks.features(html_blocks.blocks(page)))) == np.array([x == "y" for x in letters])).tolist()
    assert np.mean(hits) > 0.95
    body = " ".join(["word"] * 40)
    cases = {
        f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>{body} x &lt; y&nbsp;z</p><p>a\n b<br>c</article><footer>{body}</footer>":
            f"A & B\n\n{body} x < y z\n\na b c",
        f"<article><p>{body}</p><!-- <p>gone</p> --></article><section class='comments'><p>{body}</p></section>": body,
        "": "", "   ": "", "<script>only()": "", "<p": "", f"<p>{body}": body, f"<p title=\"a > b\">{body}</p>": body,
    }
    table = [(i, f"u{i}", h, "clash") for i, h in enumerate([*cases, None])]
    got = html_extraction.extract(spark.createDataFrame(table, "page_id int, url string, html string, main string"), model=model).collect()
    text = {r["page_id"]: r["main"]["text"] for r in got}
    assert [text[i] for i in range(len(cases))] == list(cases.values())
    assert text[len(cases)] == ""
    assert html_extraction.extract(spark.createDataFrame([], "html string"), model=model).count() == 0
    assert len(html_blocks.blocks("<div>" * 50_000 + "x")) == 1


def test_substring_dedup(spark, rows, docs, empty):
    got = substring_dedup.dedup(docs.withColumn("dedup", F.lit(1)).withColumn("k1", F.lit(2))).collect()
    assert len(got) == len(rows)
    order = sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    often = collections.Counter(unit for key in order for *_, unit in substring_dedup.short_lines(key[1]))
    seen, expected = {}, {}
    for key in order:
        cut = []
        found = [(s, e, u, False) for s, e, u in substring_dedup.units(key[1])]
        found += [(s, e, u, True) for s, e, u in substring_dedup.short_lines(key[1]) if often[u] >= substring_dedup.SHORT_REPEATS]
        for start, stop, unit, short in found:
            if (unit, short) in seen:
                cut.append((start, stop, seen[unit, short]))
            else:
                seen[unit, short] = key[0]
        expected[key] = sorted(cut)
    for r in got:
        cut = expected.get((r["doc_id"], r["text"]), [])
        assert [tuple(s) for s in r["dedup"]["removed"]] == cut
        if r["text"] is None:
            assert r["dedup"]["text"] is None
        else:
            kept, at = "", 0
            for start, stop, _ in cut:
                kept, at = kept + r["text"][at:start], max(at, stop)
            assert r["dedup"]["text"] == kept + r["text"][at:]
    assert sum(bool(r["dedup"]["removed"]) for r in got) >= 6
    assert substring_dedup.dedup(empty).count() == 0
    assert not list(substring_dedup.units("." * 200_000)) and len(list(substring_dedup.units("a " * 200_000))) == 1


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in rng.permutation(700)]
    vectors += [vectors[0], (800, None), (801, [1.0, None]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (804, []), (805, [1.0, 2.0]), (None, [1.0] * 6), (900, [1e12, -1e12] * 3), (920, [1e9] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = df.select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    got = collections.defaultdict(list)
    for r in topk_search.top_k(q, q.filter("vec_id % 20 = 0"), k=7, block_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i in (i for i in ok if i % 20 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(ok[i], v))), j) for j, v in ok.items() if j != i)[:7]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i
    none = q.filter("false")
    assert topk_search.top_k(none, none).count() == 0
    few = topk_search.top_k(q.filter("vec_id < 3"), q.filter("vec_id = 0"), k=20).count()
    assert few == 2
    # blocks under the kth score are left out
    blocks = [(np.arange(8) + 8 * b, m := np.full((8, 2), 50 - b), m.max(axis=0), m.min(axis=0)) for b in range(20)]
    assert topk_search.search_cell(np.array([-1]), np.array([[3, 4]]), blocks, 4)[3] == 1


def test_packing(spark, rows, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, expected, total = Tokenizer.from_file(path), collections.Counter(), 0
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            expected[r[0], at // 256, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = packing.pack(docs.withColumn("salt", F.lit(1)), path, capacity=256).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-total // 256) + 3
    assert packing.pack(empty, path).count() == 0


def test_packing_plan_matches_single_piece_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 300))]
        plan = packing.plan_slots(collections.Counter(lengths), 50)
        fill = collections.Counter()
        for r in plan.itertuples():
            for k in range(r.count):
                fill[r.sequence + k // r.each] += r.length
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= x]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= x
            else:
                rooms.append(50 - x)
        assert max(fill.values()) <= 50 and len(fill) <= len(rooms) + 1 and sum(fill.values()) == sum(lengths)


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    prints, root = sorted(set(prints)), {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in prints}


def test_simhash(spark, rows, docs, empty):
    prints = {(r[0], r[1]): fingerprint(r[1]) for r in rows}
    root = groups(prints.values())
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    got = simhash.near_duplicates(docs.withColumn("mark", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        f = prints[r["doc_id"], r["mark"]]
        assert r["near"]["fingerprint"] % 2**64 == f and r["near"]["component_id"] == least.get(root[f])
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(root.values())) and {r["doc_id"] for r in kept} >= set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_links_in_crowds(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(50)}
    centre = rng.getrandbits(64)
    for _ in range(900):  # many under one half, quarter and eighth
        f = centre
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randint(0, 15)
        prints.add(f)
    prints = sorted(prints)
    signed = [(f - 2**64 if f >> 63 else f,) for f in prints]
    got = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame(signed, "f long")).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)


def test_simhash_rows_between_tasks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(50)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), 3)) for b in base]
    marks = spark.createDataFrame([((f ^ 1 << 63) - (1 << 63),) for f in prints], "f long")
    cells = marks.select("f", F.inline(simhash._cells(64, F.col("f"), F.lit(0).cast("long")))).collect()
    assert len(cells) == 10 * len(prints)
    keys = {f: {r["key"] for r in cells if r["f"] % 2**64 == f} for f in prints}
    assert all(keys[a] & keys[b] for a, b in zip(prints[:50], prints[50:], strict=True))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[99] == 98


def test_license_scans(spark, rows, docs, empty):
    texts = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "SPDX-License-Identifier: MIT": "mit", "see https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
        "under the GNU Lesser General Public License version 2.1 only": "gpl,lgpl-2.1", "nothing here": "", "MITigate summit": "",
        "CC BY-NC-ND 4.0 and CC BY 3.0": "cc-by,cc-by-3.0,cc-by-nc-nd-4.0", "Tous droits réservés": "reserved",
    }
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in license_scans.scan(table).collect():
        found = {x["label"] for x in r["licenses"]["detections"]} | {x["label"] for x in r["licenses"]["base"]}
        assert ",".join(sorted(found)) == texts[r["text"]], r
        for x in r["licenses"]["detections"]:
            assert r["text"][x["start"] : x["stop"]].strip() == r["text"][x["start"] : x["stop"]] != ""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in license_scans.scan(docs.withColumn("low", F.lit(1)).withColumn("licenses", F.lit(2))).collect():
        words = word.findall((r["text"] or "").translate(LOWER))
        want = sorted((i, label) for phrase, label in license_scans.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert (r["licenses"]["n_words"], sorted(map(tuple, r["licenses"]["base"]))) == (len(words), want)
    assert license_scans.scan(empty).count() == 0
    # each rule is reached through its keywords
    for label, _, keywords, pattern in license_scans.RULES:
        assert keywords == keywords.lower() and pattern and label


def test_mixing(spark, rows, docs, empty):
    got = mixing.place(docs.withColumn("size", F.lit("clash")), words_per_shard=5000).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(by.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * by[s]}
        target |= {s: 3.0 * by[s] for s in full} if full else share
        left -= sum(3 * by[s] for s in full)
        open_ = open_ - full if full else set()
    taken = collections.Counter()
    for r in got:
        mix = r["mix"]
        assert mix["size"] == size(r["text"]) and mix["source_size"] == by[r["source"]] and abs(mix["target"] - target[r["source"]]) < 1e-6
        assert len(mix["placements"]) <= 3
        taken[r["source"]] += mix["size"] * len(mix["placements"])
    again = mixing.place(docs.repartition(3), words_per_shard=5000).collect()
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]), [tuple(p) for p in r["mix"]["placements"]])
    assert sorted(map(key, got)) == sorted(map(key, again))
    shuffled = mixing.place(docs, words_per_shard=5000, broadcast_rows=0).collect()  # nothing small enough to broadcast
    assert sorted(map(key, got)) == sorted(map(key, shuffled))
    assert mixing.place(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(len(r["mix"]["placements"]) for r in got)


def test_mixing_comes_near_and_tree_uses_every_draw_once(spark):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, "w " * rng.randint(1, 60), f"s{i % 4}") for i in range(1600)], "doc_id long, text string, source string")
    got = mixing.place(table, words_per_shard=4000).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["mix"]["size"] * len(r["mix"]["placements"])
        target[r["source"]] = r["mix"]["target"]
    assert all(abs(taken[s] - t) <= 0.002 * t for s, t in target.items())
    quota, shards = np.array([50, 7, 0, 400]), 9
    parts = [mixing.shard_share(quota, s, shards) for s in range(shards)]
    assert (sum(p[1] for p in parts) == quota).all()
    for k in range(len(quota)):
        ranges = sorted((int(f[k]), int(f[k] + n[k])) for f, n in parts if n[k])
        assert not ranges or (ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])))
    sizes = [int(p[1].sum()) for p in parts]
    assert max(sizes) - min(sizes) <= 1


def test_mixing_of_many_sources_and_large_ones(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "RUN", 4)
    monkeypatch.setattr(mixing, "SHARDS_A_CALL", 3)
    table = spark.createDataFrame([(i, "w " * (1 + i % 23), f"site{i % 41 if i % 3 else 0}") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.place(table, words_per_shard=1500).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["mix"]["size"]
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    level, open_, left = 0.0, set(names), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        left, open_ = left - sum(3 * sizes[s] for s in full), open_ - full
    taken, target, shard = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["mix"]["size"] * len(r["mix"]["placements"])
        target[r["source"]] = r["mix"]["target"]
        assert len({p["pass"] for p in r["mix"]["placements"]}) == len(r["mix"]["placements"]) <= 3
        for p in r["mix"]["placements"]:
            shard[p["shard"]] += r["mix"]["size"]
    assert all(abs(target[s] - min(3 * sizes[s], level * weight[s])) < 1e-6 for s in names)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 23 for s in names)
    assert len(shard) == -(-sum(sizes.values()) // 1500) and max(shard.values()) < 4 * 1500
    # a block of a large source is a part of a shard
    assert len({tuple(map(tuple, r["mix"]["placements"])) for r in got if r["source"] == "site0"}) > 100


def test_quality_rules(spark, rows, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(40)] + [(None, 1, 0), (7, 1, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs.withColumn("quality", F.lit("x")).withColumn("ratio", F.lit(1)), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        words = WORD.findall(text)
        counts, covered = collections.Counter(zip(words, words[1:], words[2:])), set()
        for i in range(len(words) - 2):
            if counts[tuple(words[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (q["n_dup_lines"], q["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert q["base_failed"] == failed and q["kept"] == (not failed and q["score"] >= quality_rules.THRESHOLD)
    # the ratio of both multinomials, recomputed
    trusted = {r["doc_id"] for r in quality_rules.trusted_ids(labels).collect()}
    ratio = quality_rules.fit(docs, quality_rules.trusted_ids(labels), 256).first()["ratio"]
    raw, good = np.zeros(256), np.zeros(256)
    spread = docs.select("doc_id", quality_rules.token_hashes(F.col("text")).alias("tokens")).select("doc_id", quality_rules.grams("tokens", 256).alias("b"))
    for r in spread.collect():
        np.add.at(raw, r["b"], 1)
        if r["doc_id"] in trusted:
            np.add.at(good, r["b"], 1)
    assert np.allclose(np.array(ratio) / quality_rules.UNIT, np.log((good + 5) / (raw * good.sum() / raw.sum() + 5)), atol=1e-9)
    # more ratios than stand in a row are a table, with the same scores
    other = quality_rules.judge(docs, labels, buckets=256, max_in_row=128, out="text2").collect()
    same = quality_rules.judge(docs, labels, buckets=256, out="text2").collect()
    assert sorted(map(repr, other)) == sorted(map(repr, same)) and len({r["text2"]["score"] for r in same}) > 20
    assert quality_rules.n_buckets(docs) == quality_rules.MIN_BUCKETS == quality_rules.n_buckets(empty)
    assert quality_rules.n_buckets(spark.range(3).selectExpr("repeat('ab', 300000000) AS text").limit(0)) == quality_rules.MIN_BUCKETS
    assert quality_rules.judge(empty, labels).count() == 0
    assert {r["quality"]["score"] for r in quality_rules.judge(docs, labels.filter("false")).collect()} == {0.0}
    assert not quality_rules.judge(docs, labels).filter("quality.kept").select("doc_id").isEmpty()


def test_token_counts_and_cache(spark, rows, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, cache = Tokenizer.from_file(path), shared_path(spark, "test-cache")
    half = docs.filter("doc_id < 30")
    token_counts.count_tokens(half, cache, path).collect()
    before = spark.read.parquet(cache).count()
    assert before == half.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = token_counts.count_tokens(docs.withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x")), cache, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.count_tokens(empty, cache, path).count() == 0
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(docs.filter("doc_id = 1"), cache, other).first()["n_tokens"] > 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    path = public_tokenizers.path(name)
    rng, tok = random.Random(6), Tokenizer.from_file(path)
    signs = list("aB  \n\t's.,-<|1½é中あ한") + ["\x1c", "\x85", "\u00a0", "\u200b", "\u3000", "\u0301", "Σ", "İ", "\ufb01", "😀", "<|endoftext|>", "\ue000", "\uefab", "\x0b"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a  ", "x  <|endoftext|>  y", "w" * 5000]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert PieceEncoder.of(path).ids(texts) == want


def test_url_filters(spark):
    urls = [
        "https://A.Example.ORG/es/x", "https://example.org/en/12?x", "http://foo.com/fr/", "http://foo.com/de/1", "http://foo.com/en/", "//no", None, "", "x://", "http://com/de/", "http://notexample.org/es/",
        "http://cheap-pills.example.net/a", "http://ok.net/x.org/y", "http://ok.net/a/ads/b", "http://é.net/ü" + "x" * 3000, "http://q.org?u=://z/es/", "http://q.org#a", "HTTP://M.FOO.COM/fr/ü?x",
    ]
    table = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(urls + urls[:2])], "page_id int, url string, url_verdict string, hit int")
    got = {r["page_id"]: r["url_verdict"] for r in url_filters.judge_urls(table).collect()}
    for i, url in enumerate(urls + urls[:2]):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOWER), m[2]
        fits = [r for r in url_filters.HOST_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        blocked = [g for g in url_filters.BLOCK_GLOBS if re.match(url_filters._regex(g), host + path, re.S)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1] + best[2])
        assert got[i]["verdict"] == (best[0] if best else "block" if blocked else "allow")
        assert got[i]["block_glob"] == (blocked[0] if blocked else None)
    assert url_filters.judge_urls(table.filter("false")).count() == 0


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/c") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    hits = url_filters.Automaton.compiled(globs).matches(urls)
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            assert hits[i, k] == bool(re.match(url_filters._regex(g), u, re.S)), (g, u)
