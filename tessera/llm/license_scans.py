"""Licence scans: ordered signature rules behind a keyword prefilter, with overlap suppression.

DataFrame functions only. A text that holds none of the keywords costs one pass; otherwise the rules whose keyword
occurs give intervals of the text, and an interval that lies inside one of higher rank is suppressed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_rules import HINT, LINK, NAME, RULES, SIGN, TAG, TEXT, regex, required
from tessera.llm.shared import ascii_lower, free_name, table, with_struct

SCAN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The best first; a rule's rank is below -1000 times the next one's.
PRIORITIES = (TAG, TEXT, NAME, LINK, HINT)
#: How sure a detection of each kind is.
SURE = {TAG: 1.0, TEXT: 0.95, NAME: 0.9, LINK: 0.85, HINT: 0.3}


#: Powers of two up to the largest array.
_STEPS = f"array({', '.join(str(1 << k) for k in range(31))})"


def _running(values: str, join: str) -> str:
    """The running results of ``join`` over an array: v is a value and w the one of some places before, or null.

    Each round joins in what stands twice as far back, so n values take n log n steps and no array is grown.
    """
    step = join.replace("{w}", "get(s, i - p)")
    return f"aggregate(array({values}), {values}, (none, a) -> aggregate(filter({_STEPS}, p -> p < size(a)), a, (s, p) -> transform(s, (v, i) -> {step})))"


def _intervals(text: str, pattern: str) -> str:
    """array<struct<start, stop>>: all matches, as offsets in code points.

    The texts between the matches come from split and the matches from regexp_extract_all; a match ends behind
    all texts and matches up to it.
    """
    sums = _running("transform(x, m -> m.b + m.m)", "v + coalesce({w}, 0)")
    return f"""aggregate(
      array(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (b, m) -> struct(length(b) AS b, length(m) AS m))),
      cast(array() AS array<struct<start:int,stop:int>>),
      (none, pairs) -> aggregate(array(filter(pairs, y -> y.m IS NOT NULL)), none, (none2, x) ->
        CASE WHEN size(x) = 0 THEN none2 ELSE zip_with(x, {sums}, (y, at) -> struct(at - y.m AS start, at AS stop)) END))"""


def detections(low: str, words: str, rules: Sequence[tuple[str, int, str, str]] = RULES) -> Column:
    """array<struct<rank, rule, label, sure, start, stop>> of all rules, over the lower-cased text and its words.

    The keywords that the text holds as words select the rules; most texts hold none and are done. A rule is tried if the text has
    all the words that its pattern needs.
    """
    quoted = lambda x: "r'" + x.replace("'", "\\x27") + "'"
    words_of = lambda p: f"array({', '.join(map(repr, required(p)))})" if required(p) else "cast(array() AS array<string>)"
    table_ = ", ".join(
        f"named_struct('rank', {-priority * 1000 + k}, 'rule', {k}, 'label', '{label}', 'sure', {SURE[priority]}D, "
        f"'keywords', array({', '.join(map(repr, keywords.split('|')))}), 'required', {words_of(pattern)}, 'pattern', {quoted(regex(pattern))})"
        for k, (label, priority, keywords, pattern) in enumerate(rules)
    )
    keywords = ", ".join(map(repr, sorted({x for r in rules for x in r[2].split("|")} - {SIGN})))
    others = ", ".join(map(repr, sorted({x for r in rules for x in required(r[3])} | {""})))
    return F.expr(f"""flatten(aggregate(array(concat(array_intersect({words}, array({keywords})), IF(contains({low}, '{SIGN}'), array('{SIGN}'), cast(array() AS array<string>)))),
      cast(array() AS array<array<struct<rank:int,rule:int,label:string,sure:double,start:int,stop:int>>>),
      (none, held) -> CASE WHEN size(held) = 0 THEN none ELSE aggregate(array(array_intersect({words}, array({others}))), none, (none2, also) -> transform(
        filter(array({table_}), r -> arrays_overlap(r.keywords, held) AND size(array_except(r.required, also)) = 0),
        r -> transform({_intervals(low, 'r.pattern')},
          x -> struct(r.rank AS rank, r.rule AS rule, r.label AS label, r.sure AS sure, x.start AS start, x.stop AS stop)))) END))""")


def surviving(found: str) -> Column:
    """Without each detection that lies inside another of better rank, or inside a longer one of equal priority.

    By start, then the longest, then the best rank, everything that can hold an interval stands before it: it goes if
    something of its priority or a better one has reached its stop. n detections take n log n steps.
    """
    reached = {p: _running(f"transform(o, x -> IF(x.rank < {-p * 1000 + 1000}, x.stop, -1))", "greatest(v, {w})") for p in PRIORITIES}
    before = " ".join(f"WHEN x.rank < {-p * 1000 + 1000} THEN get(held.p{p}, i - 1)" for p in PRIORITIES)
    levels = ", ".join(f"{r} AS p{p}" for p, r in reached.items())
    order = f"transform(array_sort(transform({found}, x -> struct(x.start AS start, -x.stop AS back, x.rank AS rank, x AS x))), y -> y.x)"
    return F.expr(f"""CASE WHEN size({found}) < 2 THEN {found} ELSE aggregate(array({order}), {found}, (none, o) ->
      aggregate(array(struct({levels})), o, (none2, held) -> filter(o, (x, i) -> NOT coalesce(CASE {before} END >= x.stop, false)))) END""")


def base_places(words: str) -> Column:
    """array<struct<at, label>>: the word numbers at which a base phrase stands, phrase after phrase."""
    parts = []
    for phrase, label in PHRASES:
        w = phrase.split(" ")
        test = " AND ".join(f"{words}[i + {k}] = '{x}'" for k, x in enumerate(w))
        parts.append(
            f"CASE WHEN size({words}) >= {len(w)} AND array_contains({words}, '{w[0]}') THEN transform("
            f"filter(sequence(0, size({words}) - {len(w)}), i -> {test}), i -> struct(cast(i AS bigint) AS at, '{label}' AS label)) "
            "ELSE cast(array() AS array<struct<at:bigint,label:string>>) END"
        )
    return F.expr(f"concat({', '.join(parts)})")


def scan(docs: DataFrame, text: str = "text", rules: Sequence[tuple[str, int, str, str]] = RULES) -> DataFrame:
    """docs with struct ``licenses``: n_words, base array<struct<at, label>>, detections array<struct<label, sure, start, stop>>.

    Offsets of detections are code points of the whole text, ``at`` numbers words from 0. A null or empty text has
    no words and no detections. Equal rows get equal results; ties between rules of one priority go to the longer
    match, then to the earlier rule. A very long text is scanned whole, in steps that grow with its matches times their
    logarithm. An empty table stays empty. Columns of docs stay; one named ``licenses`` is replaced.
    """
    low, words, found = (free_name(docs, n) for n in ("low", "words", "found"))
    ready = docs.withColumn(low, ascii_lower(F.coalesce(F.col(text), F.lit("")))).withColumn(
        words, F.regexp_extract_all(low, F.lit(SCAN_WORD), F.lit(0))
    )
    kept = F.transform(surviving(found), lambda x: F.struct(x["label"], x["sure"], x["start"], x["stop"]))
    whole = F.struct(F.size(words).cast("long").alias("n_words"), base_places(words).alias("base"), F.array_sort(kept).alias("detections"))
    return with_struct(ready.withColumn(found, detections(low, words, rules)), "licenses", whole).drop(low, words, found)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document scanned. score: the surest detection, 0.5 for a base place alone, else 0."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, own = F.col("licenses.base"), F.col("licenses.detections")
    return docs.select(
        "doc_id",
        "licenses.n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["at"]).alias("first_word"),
        F.array_max(base["at"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base["label"], own["label"])), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(own["sure"]), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
