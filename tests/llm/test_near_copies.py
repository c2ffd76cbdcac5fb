"""The pipeline's near copies against brute force over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return [rng.choice(("ba", "ko", "ri", "ten", "Mu", "sel")) + rng.choice(("a", "o", "u")) + str(rng.randint(0, 60)) for _ in range(n)]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if r == old else r for r in root]
    return {rows[min(k for k in range(len(rows)) if root[k] == r)][0] for r in set(root)}


def test_edited_copies_go(spark):
    rng = random.Random(9)
    boiler = words_of(rng, 30)
    texts = []
    for k in range(25):
        base = words_of(rng, 60 + 9 * k) + (boiler if k % 2 else [])
        texts.append(" ".join(base))
        for _ in range(k % 5):  # edited copies on both sides of the limit
            edited = list(base)
            for _ in range(rng.randint(1, 6)):
                edited[rng.randrange(len(edited))] = "changed"
            texts.append(" ".join(edited))
    chain = words_of(rng, 200)
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 50, 12)]
    texts += [texts[3], texts[3].upper(), "a b", "a b", "a c", "", None, " \n"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = brute_force(rows)
    docs = spark.createDataFrame([*rows, rows[4], (None, texts[5], None, None, None)], SCHEMA).repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) < len(rows) - 15
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("false"), "").count() == 0


def test_common_shingles_go_behind_and_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    boiler = " ".join(words_of(rng, 40))
    rows = [(i, boiler + " " + " ".join(words_of(rng, 12 + i % 9)), "en", "s", 1) for i in range(40)]
    monkeypatch.setattr(near_copies, "COMMON", 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    common = near_copies.common_shingles(docs.repartition(3))
    counts = {}
    for r in rows:
        for h in near_copies.shingles(r[1]).tolist():
            counts[h] = counts.get(h, 0) + 1
    want = sorted(int(near_copies.keys_of(np.array([h], dtype=np.uint64), common.bits)[0]) for h, n in counts.items() if n >= 3)
    assert common.keys.tolist() == want and len(want) == 36 and set(common.classes.tolist()) == {21}
    own = near_copies.shingles(rows[0][1])
    first = near_copies.prefix(own, common)
    assert len(first) == len(own) - -(-4 * len(own) // 5) + 1 and not common.classes_of(first).any()
    for bits in (0, 3, 20):  # whatever the number of groups
        monkeypatch.setattr(near_copies, "COUNTED", max(1, sum(len(r[1]) for r in rows) // 6 >> bits))
        monkeypatch.setattr(near_copies, "HELD", 100)
        assert len(near_copies.common_shingles(docs).keys) == 36
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == brute_force(rows)


def test_texts_of_one_template(spark):
    """Texts that share most of their words: some are alike, most are not, and the join itself parts them."""
    rng = random.Random(3)
    template = [f"t{k}" for k in range(80)]
    rows = []
    for i in range(240):
        words = template.copy()
        for k in rng.sample(range(80), 8):
            words[k] = f"v{k}_{rng.randint(0, 3)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == brute_force(rows)


def test_sketches_never_part_alike_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        two = np.unique(np.concatenate((one[rng.random(len(one)) > 0.1 * rng.random()], rng.integers(0, 2**63, int(0.1 * n * rng.random()), dtype=np.uint64))))
        differ = len(np.setxor1d(one, two))
        assert int(np.bitwise_count((near_copies.sketch(one) ^ near_copies.sketch(two)).view(np.uint64)).sum()) <= differ
