"""Whitening, token alignment and curve packing against brute force; nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import curve_packing, token_alignment, whitening
from tessera.llm.ranked_words import RankedEncoder, word_ranks

BYTE, WORDS, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    return df.select("vec_id", "label", whitening.quantised(F.col("embedding")).alias("x"))


def check_whitening(rows, got, model):
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    full = [(i, np.pad(x, (0, width - len(x)))) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in full}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    k = min(4, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    assert len(got) == k * len(kept)
    assert model.n == n and model.sums == sums.tolist()
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    expected = collections.Counter((i, int(((n * x - sums) ** 2).sum())) for i, x in full)
    for j in range(k):
        own = by[j + 1]
        assert collections.Counter((r["vec_id"], r["deviation"]) for r in own) == expected
        assert {r["n"] for r in own} == {n}
        assert all(abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in own)
        alone = (j == 0 or values[j - 1] > values[j] * 1.0001) and (j + 1 == len(values) or values[j] > values[j + 1] * 1.0001)
        v = model.components[:, j]
        assert abs(np.linalg.norm(v) - 1) < 1e-12
        assert np.abs(centred.T @ (centred @ v) / n - values[j] * v).max() <= 1e-12 * values[0]
        if alone:
            sign = np.sign(v @ turned[:, j])
            want = sorted((i, sign * float((x - sums / n) @ turned[:, j]) / np.sqrt(values[j])) for i, x in full if i is not None)
            mine = sorted((r["vec_id"], r["whitened"]) for r in own if r["vec_id"] is not None)
            assert [a for a, _ in want] == [a for a, _ in mine]
            assert max(abs(a - b) for (_, a), (_, b) in zip(want, mine, strict=True)) < 1e-8


@pytest.mark.parametrize("kind", ["plain", "flat", "narrow", "one", "equal"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "plain":
        data = rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12) + 1
    elif kind == "flat":  # equal variances: corners of a cube and nothing else
        data = np.array(np.meshgrid(*[[-1.0, 1.0]] * 5)).reshape(5, -1).T
    elif kind == "narrow":  # two directions only
        data = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 9))
        data = np.round(data * 256) / 256
        data = np.stack([data[:, 0], data[:, 1], data[:, 0] + data[:, 1], data[:, 0] - data[:, 1]], axis=1)
    elif kind == "one":
        data = np.array([[1.5, 2.0, 3.0]])
    else:
        data = np.ones((5, 3))
    rows = [(i, [float(c) for c in np.float32(v)], "clash") for i, v in enumerate(data)]
    rows += [rows[0], rows[0], (None, rows[-1][1], None), (900, None, "x"), (901, [float("nan"), *rows[0][1][1:]], "x"), (902, [None, *rows[0][1][1:]], "x"), (903, [float("inf"), *rows[0][1][1:]], "x")]
    df = vectors(spark, rows).repartition(3)
    model = whitening.fit(df)
    check_whitening(rows, whitening.whiten(df, model).collect(), model)


def test_whitening_odd_tables(spark):
    empty = vectors(spark, [])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, None)]), None).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    short = [(1, [1.0, 2.0], "a"), (2, [3.0], "a"), (3, [3.0, 0.0], "a"), (4, [], "a"), (5, [0.5, -2.0], "b")]
    df = vectors(spark, short)
    model = whitening.fit(df)
    check_whitening(short, whitening.whiten(df, model).collect(), model)
    big = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>").select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(big, whitening.fit(big)).collect()}
    assert got[1] == got[2] == 2**63 - 1 and got[3] == 1  # the ends of a long add up to -1


def test_bidiagonal_steps_stop_early(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 40)) * (0.3 ** np.arange(40)) * 50
    rows = [(i, [float(c) for c in v], "") for i, v in enumerate(np.float32(data))]
    model = whitening.fit(vectors(spark, rows))
    assert model.steps < 30
    check_whitening(rows, whitening.whiten(vectors(spark, rows), model).collect(), model)


def brute_alignment(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    signs = token_alignment.byte_of_sign()
    out, seen = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            out.append(([], [], [], ""))
            continue
        owner = [k for k, raw in enumerate(raw_b) for _ in raw]
        links, at = [], 0
        for k, raw in enumerate(raw_a):
            links += [(ids_a[k], ids_b[j]) for j in sorted(set(owner[at : at + len(raw)]))]
            at += len(raw)
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
        groups, begin = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            one = ",".join(str(i) for i, e in zip(ids_a, ends_a) if begin < e <= end)
            groups.append(one + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if begin < e <= end))
            begin = end
        out.append((ids_a, ids_b, links, ";".join(groups)))
        seen.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return [
        (len(ia), len(ib), len(g.split(";")) if g else 0, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for ia, ib, links, g in out
    ]


ODD = [
    None, "", " ", "  lead  two   three    ", "a\nb\r\n c\t\td", "<|endoftext|> x</s><s>", "naïve café 東京 　wide \xa0no-break", "\U0001f600\U0001f601 smile", "a▁b", "▁", "é́ é",
    "\x00nul\x1c\x85", "function(){\r\n  return;\r\n}\r\n\r\n", "don't we'll  I'm ''s", "word" * 2000, "x " * 3000, "\n\n\n", "\r", "tab\tsep, dots... (paren); \"q\"", "12345 67 8,900.00 € £", "нет ไทย עברית", "﻿bom  private",
]


def test_alignment(spark):
    rng = random.Random(3)
    signs = "ab e\t\n\r .,;'\"(){}　\xa0é東\U0001f600▁09"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    texts += [texts[-1], texts[-1], texts[5]]
    expected = collections.Counter((i, *row) for i, row in enumerate(brute_alignment(texts)))
    docs = spark.createDataFrame([(i, t, i, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row long, pairs string").repartition(4)
    for most in (token_alignment.BROADCAST_PAIRS, 0):
        got = token_alignment.align_corpus(docs, BYTE, PIECE, most)
        got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
        assert collections.Counter(tuple(r) for r in got.collect()) == expected
    assert sum(n for (_, n, *_), _ in expected.items()) > 5000
    assert token_alignment.align_corpus(docs.limit(0), BYTE, PIECE).count() == 0


def test_alignment_in_parts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "GROUP_CHARS", 50)
    encoder = token_alignment.BothEncoder(BYTE, PIECE)
    texts = [t for t in ODD if t is not None] + [" ".join(f"part{k % 7} of, it" for k in range(300)), "bad ▁ " * 40]
    parts = token_alignment.align_texts(encoder, texts)
    for row, want in zip(parts, brute_alignment(texts), strict=True):
        assert row[:4] == want[:4] and row[4] == want[6] and int(row[6].sum()) == want[3]


def test_alignment_without_known_chunks(spark):
    encoder = token_alignment.BothEncoder(BYTE, PIECE)
    texts = [t for t in ODD if t]
    chunks = token_alignment.align_texts(encoder, texts)
    encoder.chunk = None
    for one, two in zip(chunks, token_alignment.align_texts(encoder, texts), strict=True):
        assert one[:5] == two[:5] and one[5].tolist() == two[5].tolist() and one[6].tolist() == two[6].tolist()


def test_words_by_rank():
    rng, tokenizer, encoder = random.Random(1), Tokenizer.from_file(WORDS), RankedEncoder(WORDS)
    assert encoder.core is not None and RankedEncoder(BYTE).core is None
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxzéàüñßøÉÀŒİıſ") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    words += ["".join(rng.choice("!#$%&*()-_=+[]{};:,.<>/?|'a1") for _ in range(rng.randint(1, 6))) for _ in range(5_000)]
    words += [w[:-4] for w in tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isalpha()]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)] + ["", " ", "東京 naïve", "x" * 5000]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.ids(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    made = json.loads(open(WORDS, encoding="utf-8").read())
    made["model"]["merges"].reverse()
    assert word_ranks(made) is None


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_walks_to_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    keys = curve_packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, curve_packing.END]


def test_curve_packing(spark):
    rng = random.Random(8)
    topics = [[f"{a}{b}" for a in head for b in ("ing", "er", "tion", "al", "ous")] for head in (("sail", "ship", "port", "wind"), ("cell", "gene", "acid", "lipid"), ("law", "court", "judge", "plea"))]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randint(60, 200)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, " "), (None, "no id"), (503, "long word " * 9000), (504, "<|endoftext|> in text"), rows[4], rows[4]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, ids string").repartition(5)
    tokenizer = Tokenizer.from_file(WORDS)
    got = curve_packing.pack(docs, WORDS, capacity=1024).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"]
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    copies = collections.Counter(i for i, _ in rows)
    for i, text in rows:
        want = brute_ids(tokenizer, text)
        pieces = by_doc[i]
        assert sum(len(p) for _, p, _ in pieces) == copies[i] * len(want) and {n for *_, n in pieces} == {len(want)}
        assert all(want[s : s + len(p)] == p for s, p, _ in pieces)
        assert collections.Counter(k for s, p, _ in pieces for k in range(s, s + len(p))) == dict.fromkeys(range(len(want)), copies[i])
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    total = sum(copies[i] * 0 + len(brute_ids(tokenizer, t)) for i, t in rows)
    assert sum(lengths) == total and lengths.count(1024) == total // 1024
    assert sorted(x for x in lengths if x != 1024) == [1 << b for b in range(10) if (total % 1024) >> b & 1]
    # neighbours on the curve are of one topic: a sequence's largest topic has most of it
    pure = [collections.Counter(d % 3 for _, _, d in p if d is not None and d < 300).most_common(1)[0][1] / len(p) for p in by_sequence.values() if all(d is not None and d < 300 for *_, d in p)]
    assert np.mean(pure) > 0.75
    again = curve_packing.pack(docs.repartition(2), WORDS, capacity=1024).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert curve_packing.pack(docs.limit(0), WORDS).count() == 0
    assert curve_packing.pack(docs.filter("doc_id = 500"), WORDS).count() == 1


def test_queries_of_the_round(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert whitening.query(spark, sf).count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    aligned = token_alignment.query(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert [tuple(r)[1:] for r in sorted(aligned)] == [w[:6] + (w[6],) for w in brute_alignment([texts[i] for i in sorted(texts)])]
    packed = curve_packing.query(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.agg(F.sum("length")).first()[0] == sum(len(brute_ids(Tokenizer.from_file(WORDS), t)) for t in texts.values())
