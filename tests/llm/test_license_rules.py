"""Every alternative of every licence pattern as a text."""

import re
from itertools import product

from tessera.llm import license_rules, license_scans


def variants(items):
    """All texts that a parsed pattern of literals, classes, branches and optional parts fits."""
    parts = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg])
        elif name == "MAX_REPEAT":
            assert arg[:2] == (0, 1)
            parts.append(["", *variants(arg[2])])
        elif name == "SUBPATTERN":
            parts.append(variants(arg[3]))
        else:
            assert name == "BRANCH"
            parts.append([x for branch in arg[1] for x in variants(branch)])
    return ["".join(p) for p in product(*parts)]


def test_every_alternative_is_found(spark):
    texts = set()
    for _, _, _, pattern in license_rules.RULES:
        if license_rules.UP_TO not in pattern:
            texts |= set(variants(re._parser.parse(pattern)))
    table = spark.createDataFrame([(t,) for t in sorted(texts)], "text string").repartition(4)
    missed = []
    for r in license_scans.scan(table).collect():
        found = r["licenses"]["detections"]
        if not any(x["start"] == 0 and x["stop"] == len(r["text"]) for x in found):
            missed.append(r["text"])
    assert not missed and len(texts) > 400


def test_names_and_wrapped_clauses(spark):
    clause = "Neither the name of {} nor the names of its\ncontributors may be used to endorse or promote products\n derived from this software without"
    cases = {
        "the Open Game License": {"game-ogl"}, "a Responsible AI License": {"rail"}, "GPLv 3": {"gpl-3.0"}, "LGPLv 2.1": {"lgpl-2.1"}, "AGPLv 3": {"agpl-3.0"}, "MPLv 2.0": {"mpl-2.0"},
        clause.format("the Institute"): {"bsd-3-clause"}, clause.format("Long Holder, Inc. and " * 40): {"bsd-3-clause"},
        f"neither the name of it\nMIT License\n{clause.format('X')}": {"mit", "bsd-3-clause"}, "neither the name of the endorse " * 2000: set(),
        "neither the name of x may be used to endorse or promote products": set(),
    }
    table = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in license_scans.scan(table).collect():
        assert {x["label"] for x in r["licenses"]["detections"]} == cases[r["text"]], r["text"][:80]


def test_suppression_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.llm.license_rules import HINT, LINK, NAME, TAG, TEXT
    from tessera.llm.license_scans import surviving

    rng = random.Random(2)
    cases = []
    for n in (0, 1, 2, 7, 60, 300):
        rows = []
        for _ in range(n):
            start, k = rng.randrange(4 * n), rng.randrange(200)
            rows.append((-rng.choice((TAG, TEXT, NAME, LINK, HINT)) * 1000 + k, k, "x", 0.5, start, start + rng.randint(1, 12)))
        cases.append((n, sorted(set(rows))))
    kind = "n int, found array<struct<rank:int,rule:int,label:string,sure:double,start:int,stop:int>>"
    got = {r["n"]: [tuple(x) for x in r["kept"]] for r in spark.createDataFrame(cases, kind).select("n", surviving("found").alias("kept")).collect()}

    def inside(x, y):
        if not (y[4] <= x[4] and x[5] <= y[5]) or x == y:
            return False
        if x[0] // 1000 == y[0] // 1000:
            return y[5] - y[4] > x[5] - x[4] or y[0] < x[0]
        return y[0] < x[0]

    for n, rows in cases:
        assert sorted(got[n]) == sorted(x for x in rows if not any(inside(x, y) for y in rows)), n


def test_signed_years_and_many_matches(spark):
    texts = ["©2019 Someone", "© 2019", "(©) 1999", "©2x19", "mit license, " * 3000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["label"], x["start"], x["stop"]) for x in r["licenses"]["detections"]] for r in license_scans.scan(docs).collect()}
    assert got[0] == [("copyright", 0, 5)] and got[1] == [("copyright", 0, 6)] and got[3] == []
    assert len(got[4]) == 3000 and sorted(got[4]) == [("mit", 13 * k, 13 * k + 11) for k in range(3000)]
