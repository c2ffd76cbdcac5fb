"""Summaries of retrieval trials, read from their traces: latencies by stage, counters, candidate pools, windows, drift.

A case is a row of (case_id, latency map<string,double>, stages array<struct<stage,n,notes>>, trace array<struct<step,detail>>,
windows array<struct<relation,selected,section>>). Null or empty traces give no rows; a part that lacks a required number
is left out; of repeated names in a case the last counts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.reports import exact_sum, latency

# --- fixed values: names in traces ---------------------------------------------------------------
LATENCY_KEYS = ("queryNormalizationMs", "queryEmbeddingMs", "cacheLookupMs", "hydeMs", "retrievalSetupMs", "retrievalMs", "fallbackMs", "planningMs", "answerMs", "totalMs")
STORE = {"dbLexical": "db_lexical_ms", "vector": "vector_ms", "corpus": "corpus_ms", "total": "total_ms", "dbLexicalCandidates": "db_lexical_candidates", "vectorCandidates": "vector_candidates"}
PHASES = {"phaseLexicalPool": "lexical_pool_ms", "phaseExact": "exact_ms", "phaseLexical": "lexical_ms", "phaseVector": "vector_ms", "phaseFusion": "fusion_ms", "phaseEvidence": "evidence_ms", "phaseTotal": "total_ms"}
PHASES_OR_ZERO = {
    "phaseFusionRrf": "fusion_rrf_ms", "phaseFusionRerank": "fusion_rerank_ms", "phaseFusionEntity": "fusion_entity_ms", "phaseFusionMerge": "fusion_merge_ms", "phaseFusionDiversify": "fusion_diversify_ms",
    "phaseExactInput": "exact_input_chunks", "phaseExactScored": "exact_scored_chunks", "phaseExactCandidates": "exact_candidates", "phaseLexicalInput": "lexical_input_chunks", "phaseLexicalCandidates": "lexical_candidates",
}
# -------------------------------------------------------------------------------------------------


def field(part: Column, key: str) -> Column:
    """The last value of ``key`` in a list like "a=1, b=2"; null where it has none."""
    held = F.filter(F.transform(F.split(part, ","), lambda e: F.trim(e)), lambda e: e.rlike(f"^{re.escape(key)}\\s*="))
    return F.trim(F.regexp_replace(F.try_element_at(held, F.lit(-1)), "^[^=]+=", ""))


def number(part: Column, key: str) -> Column:
    """The value as a number, without the unit ms or %; null for anything else."""
    bare = F.regexp_replace(field(part, key), "(?i)(ms|%)$", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def details(cases: DataFrame, step: str) -> DataFrame:
    """(case_id, at, detail) of a step, in the order of the trace."""
    return cases.select("case_id", F.posexplode(F.filter("trace", lambda t: t["step"] == step)).alias("at", "t")).select("case_id", "at", F.col("t.detail").alias("detail"))


def step_latencies(cases: DataFrame, step: str) -> DataFrame:
    """(case_id, name, ms) of "name=12.5ms" lists."""
    parts = details(cases, step).select("case_id", "at", F.posexplode(F.split("detail", ",")).alias("pos", "p"))
    found = parts.select("case_id", "at", "pos", F.regexp_extract(F.trim("p"), r"(?i)^([a-z0-9_.-]+)=([0-9]+(?:\.[0-9]+)?)ms$", 1).alias("name"), F.regexp_extract("p", "=([0-9.]+)", 1).try_cast("double").alias("ms"))
    last = found.filter("name <> ''").groupBy("case_id", "name").agg(F.max(F.struct("at", "pos", "ms")).alias("l"))
    return last.select("case_id", "name", F.col("l.ms").alias("ms"))


def stage_rows(cases: DataFrame, step: str, required: Mapping[str, str], or_zero: Mapping[str, str] | None = None) -> DataFrame:
    """(case_id, at, pos, stage, ...): a row for each "stage:a=1,b=2" part of a step that has all required numbers; the others are 0 where they lack."""
    parts = details(cases, step).select("case_id", "at", F.posexplode(F.split("detail", ";")).alias("pos", "p")).withColumn("p", F.trim("p"))
    parts = parts.filter(F.instr("p", ":") > 1).select("case_id", "at", "pos", F.trim(F.substring_index("p", ":", 1)).alias("stage"), F.regexp_replace("p", "^[^:]*:", "").alias("p"))
    wanted = [number(F.col("p"), k).alias(name) for k, name in required.items()]
    rest = [F.coalesce(number(F.col("p"), k), F.lit(0.0)).alias(name) for k, name in (or_zero or {}).items()]
    return parts.select("case_id", "at", "pos", "stage", *wanted, *rest).dropna(subset=list(required.values()))


def expansions(cases: DataFrame) -> DataFrame:
    """(case_id, stage, seeds, hits, boosts, entries, elapsed_ms) of graph expansions."""
    parts = details(cases, "ontology-expansion").select("case_id", F.explode(F.split("detail", ";")).alias("p"))
    keys = {"seeds": "seeds", "hits": "hits", "boosts": "boosts", "trace": "entries", "elapsed": "elapsed_ms"}
    rows = parts.select("case_id", field(F.col("p"), "stage").alias("stage"), *[number(F.col("p"), k).alias(n) for k, n in keys.items()])
    return rows.filter("stage <> ''").dropna(subset=list(keys.values()))


def summary(rows: DataFrame, value: str, *per: str) -> DataFrame:
    """Number, mean, nearest-rank percentiles and maximum of each group, to one digit."""
    found = latency(rows, value, *per)
    return found.select(*per, "n", *[F.round(c, 1).alias(c) for c in ("mean", "p50", "p95", "largest")])


def slowest(rows: DataFrame, value: str, per: str, most: int = 5) -> DataFrame:
    """(per, slow_ids): the cases of the largest values of each group, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(value), "case_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "case_id"))), lambda s: s["case_id"].cast("string"))
    return rows.select(per, "case_id", value, place.alias("place")).filter(F.col("place") <= most).groupBy(per).agg(F.array_join(ids, ",").alias("slow_ids"))


def by_stage(rows: DataFrame, value: str, averaged: list[str], per: str = "stage") -> DataFrame:
    """The summary of ``value`` by stage, the means of other numbers, and the slowest cases."""
    out = summary(rows, value, per).join(slowest(rows, value, per), per)
    if not averaged:
        return out
    return out.join(rows.groupBy(per).agg(*[F.round(exact_sum(c) / F.count(F.lit(1)), 1).alias(f"mean_{c}") for c in averaged]), per)


def key_latencies(cases: DataFrame) -> DataFrame:
    """The summary of each latency key; keys that no case has don't occur."""
    rows = cases.select("case_id", F.explode("latency").alias("key", "ms")).filter(F.col("key").isin(*LATENCY_KEYS))
    return summary(rows, "ms", "key")


def dominant(latencies: Column) -> Column:
    """struct(key, ms) of the largest latency but the total, first key on ties; the total where all are 0 or lack."""
    parts = F.array(*[F.struct(F.coalesce(latencies[k], F.lit(0.0)).alias("ms"), F.lit(-i).alias("o"), F.lit(k).alias("key")) for i, k in enumerate(LATENCY_KEYS[:-1])])
    best = F.array_max(parts)
    total = F.coalesce(latencies["totalMs"], F.lit(0.0))
    return F.when(best["ms"] > 0, F.struct(best["key"].alias("key"), F.round(best["ms"], 1).alias("ms"))).otherwise(F.struct(F.lit("totalMs").alias("key"), F.round(total, 1).alias("ms")))


def output_counts(cases: DataFrame) -> DataFrame:
    """(stage, mean_outputs, most_outputs) over all cases."""
    rows = cases.select(F.explode("stages").alias("s")).select("s.stage", "s.n").filter("n IS NOT NULL")
    return rows.groupBy("stage").agg(F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("mean_outputs"), F.max("n").alias("most_outputs"))


def counters(cases: DataFrame, step: str) -> DataFrame:
    """(case_id, hits, misses, size) of a cache: sums and the largest size of the case's entries that give all three."""
    at = lambda key: F.regexp_extract("detail", rf"(?i)\b{key}=([0-9]+)", 1).try_cast("long").alias(key)
    rows = details(cases, step).select("case_id", at("hits"), at("misses"), at("size")).dropna()
    return rows.groupBy("case_id").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.max("size").alias("size"))


def counter_summary(rows: DataFrame) -> DataFrame:
    """One row: totals, cases, cases with a hit, and the hit rate to four digits."""
    hits, misses = F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("misses"), F.lit(0))
    rate = F.coalesce(F.round(F.try_divide(hits, hits + misses), 4), F.lit(0.0))
    return rows.agg(hits.alias("hits"), misses.alias("misses"), F.count(F.lit(1)).alias("cases"), F.count_if(F.col("hits") > 0).alias("cases_with_hits"), rate.alias("hit_rate"))


def pool_reuse(cases: DataFrame) -> DataFrame:
    """(case_id, target, previous, lexical, overlap, coverage, sources, guard_pool, guard_result): reuse joined with its guard, if any."""
    d = F.col("detail")
    keys = {"previous": "previous", "targetLexical": "lexical", "overlap": "overlap", "coverage": "coverage"}
    sources = F.size(F.filter(F.split(F.coalesce(field(d, "stages"), F.lit("")), r"\|"), lambda s: s != "")).alias("sources")
    reuse = details(cases, "lexical-pool-reuse").select("case_id", field(d, "target").alias("target"), *[number(d, k).alias(n) for k, n in keys.items()], sources)
    guard = details(cases, "lexical-pool-reuse-guard").select("case_id", "at", field(d, "target").alias("target"), number(d, "pool").alias("guard_pool"), F.nullif(field(d, "result"), F.lit("")).alias("guard_result"))
    last = guard.filter("target <> ''").groupBy("case_id", "target").agg(F.max(F.struct("at", "guard_pool", "guard_result")).alias("g")).select("case_id", "target", "g.guard_pool", "g.guard_result")
    return reuse.filter("target <> ''").dropna(subset=list(keys.values())).withColumn("coverage", F.round("coverage", 1)).join(last, ["case_id", "target"], "left")


def pool_summary(rows: DataFrame) -> DataFrame:
    """(guard_result, n, mean_coverage, least_coverage, n_full, n_partial) by guard result, and of all rows under 'all'."""
    both = rows.select("coverage", F.explode(F.array(F.lit("all"), F.coalesce("guard_result", F.lit("none")))).alias("guard_result"))
    return both.groupBy("guard_result").agg(
        F.count(F.lit(1)).alias("n"), F.round(exact_sum("coverage") / F.count(F.lit(1)), 1).alias("mean_coverage"), F.min("coverage").alias("least_coverage"),
        F.count_if(F.col("coverage") >= 100).alias("n_full"), F.count_if(F.col("coverage") < 100).alias("n_partial"),
    )


def window_cases(cases: DataFrame) -> DataFrame:
    """The windows of each case that has any: by relation, chosen as evidence, and their sections."""
    held = lambda test: F.size(F.filter("windows", test)).cast("long")
    of = lambda relation: lambda w: w["relation"] == relation
    rows = cases.filter(F.size("windows") > 0).select(
        "case_id", F.size("windows").cast("long").alias("n_windows"), *[held(of(r)).alias(f"n_{r}") for r in ("current", "previous", "next")],
        held(lambda w: w["selected"]).alias("n_selected"), F.size(F.array_compact(F.array_distinct(F.transform("windows", lambda w: F.nullif(w["section"], F.lit("")))))).cast("long").alias("n_sections"),
    )
    return rows.withColumn("n_expansion", F.col("n_previous") + F.col("n_next"))


def window_summary(rows: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_windows", "n_current", "n_previous", "n_next", "n_selected", "n_expansion")]
    return rows.agg(F.count(F.lit(1)).alias("cases"), *sums, F.coalesce(F.round(F.avg("n_expansion"), 1), F.lit(0.0)).alias("mean_expansion"))


def context_cases(cases: DataFrame) -> DataFrame:
    """(case_id, candidates, included, skipped, skipped_chunks, skipped_chars, chars) of each case's first context entry."""
    d = F.col("detail")
    keys = {"candidates": "candidates", "included": "included", "skipped": "skipped", "chars": "chars"}
    rest = {"skippedByMaxChunks": "skipped_chunks", "skippedByMaxChars": "skipped_chars"}
    rows = details(cases, "small-to-big-context").filter("at = 0").select("case_id", *[number(d, k).alias(n) for k, n in keys.items()], *[F.coalesce(number(d, k), F.lit(0.0)).alias(n) for k, n in rest.items()])
    return rows.dropna(subset=list(keys.values()))


def context_summary(rows: DataFrame) -> DataFrame:
    names = ("candidates", "included", "skipped", "skipped_chunks", "skipped_chars", "chars")
    rate = F.coalesce(F.round(F.try_divide(F.sum("included"), F.sum("candidates")), 4), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names], rate.alias("inclusion_rate"))


def first_of_case(rows: DataFrame) -> DataFrame:
    """The first row of each case in the order of its trace."""
    rest = [c for c in rows.columns if c not in ("case_id", "at", "pos")]
    return rows.groupBy("case_id").agg(F.min(F.struct("at", "pos", *rest)).alias("f")).select("case_id", *[f"f.{c}" for c in rest])


def reranked_paths(cases: DataFrame, stage: str = "integrated-reranked") -> DataFrame:
    """(case_id, sub_search_ms, store_ms, ...phases): the first phase entry of a stage; its sub-search time, or the store's, or the phase's own."""
    phase = first_of_case(stage_rows(cases, "search-store-latency", PHASES, PHASES_OR_ZERO).filter(F.col("stage") == stage))
    store = first_of_case(stage_rows(cases, "search-store-latency", STORE).filter(F.col("stage") == stage)).select("case_id", F.col("total_ms").alias("store_ms"))
    sub = step_latencies(cases, "sub-search-latency").filter(F.col("name") == stage).select("case_id", "ms")
    joined = phase.join(store, "case_id", "left").join(sub, "case_id", "left")
    return joined.select("case_id", F.round(F.coalesce("ms", "store_ms", "total_ms"), 1).alias("sub_search_ms"), F.coalesce("store_ms", F.lit(0.0)).alias("store_ms"), *[c for c in phase.columns if c not in ("case_id", "stage")])


def validation_latencies(cases: DataFrame) -> DataFrame:
    """(case_id, validation_ms, retrieval_ms, share, n_evidence) of the cases that time their validation."""
    own = step_latencies(cases, "retrieval-phase-timing").filter("name = 'semantic-validation'").select("case_id", F.col("ms").alias("validation_ms"))
    gate = F.try_element_at(F.filter("stages", lambda s: s["stage"] == "answer_evidence_gate"), F.lit(1))["n"]
    of = cases.select("case_id", F.round(F.coalesce(F.col("latency")["retrievalMs"], F.lit(0.0)), 1).alias("retrieval_ms"), F.coalesce(gate, F.lit(0)).alias("n_evidence"))
    share = F.when(F.col("retrieval_ms") > 0, F.round(F.col("validation_ms") / F.col("retrieval_ms"), 4)).otherwise(0.0)
    return own.join(of, "case_id").select("case_id", "validation_ms", "retrieval_ms", share.alias("share"), "n_evidence")


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def names_expected(title: Column, expected: Column) -> Column:
    """Whether a title holds the expected name, or all its words of two characters or more, signs aside."""
    words = F.filter(F.transform(F.split(expected, r"[^\p{L}\p{N}]+"), bare_name), lambda w: F.length(w) >= 2)
    all_words = (F.size(words) > 0) & F.forall(words, lambda w: bare_name(title).contains(w))
    return F.coalesce((bare_name(expected) != "") & (bare_name(title).contains(bare_name(expected)) | all_words), F.lit(False))


def note(stages: Column, stage: str, key: str) -> Column:
    """The value of the first "key=value" note of a stage; null where it has none."""
    of = F.try_element_at(F.filter(stages, lambda s: s["stage"] == stage), F.lit(1))["notes"]
    return F.substring(F.try_element_at(F.filter(of, lambda n: n.startswith(f"{key}=")), F.lit(1)), len(key) + 2, 1 << 30)


def authority_cases(cases: DataFrame, expected: str = "expected", titles: str = "titles") -> DataFrame:
    """(case_id, found_at, drift, visible): the first stage whose best document is the expected one, and whether the fusion lost it."""
    is_it = lambda title: names_expected(title, F.col(expected))
    lexical, exact, fused = (is_it(note(F.col("stages"), s, k)) for s, k in (("lexical_candidates", "top"), ("fusion", "exact-top"), ("fusion", "fusion-top")))
    visible = F.coalesce(F.exists(titles, is_it), F.lit(False))
    found = F.when(lexical, "lexical-top").when(exact, "exact-top").when(fused, "fusion-top").when(visible, "visible-top5").otherwise("missing")
    return cases.filter(F.col(expected) != "").select("case_id", found.alias("found_at"), ((lexical | exact) & ~fused).alias("drift"), visible.alias("visible"))
