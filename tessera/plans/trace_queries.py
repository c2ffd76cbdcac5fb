"""Trial reports: traces are written as text from events, read again and summed up; the SQL works on the numbers themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import traces as T
from tessera.sources.tables import table

#: c and k are the whole numbers of an event that the texts carry.
_STORE = (
    "event_type || ':dbLexical=' || k || 'ms,vector=' || c % 50 || 'ms,corpus=' || c % 30 || 'ms,total=' || (k + c % 80) || 'ms,dbLexicalCandidates=' || k || ',vectorCandidates=' || c % 10"
    " || ',phaseLexicalPool=' || c % 7 || 'ms,phaseExact=' || c % 11 || 'ms,phaseLexical=' || c % 13 || 'ms,phaseVector=' || c % 17 || 'ms,phaseFusion=' || c % 19 || 'ms,phaseEvidence=' || c % 23"
    " || 'ms,phaseTotal=' || c % 400 || 'ms,phaseExactInput=' || k || ' ; lost:dbLexical=1ms ; no stage'"
)
_CASES = f"""
SELECT event_id AS case_id, event_type, c, k,
  map('totalMs', CAST(c AS DOUBLE), 'retrievalMs', CAST(c % 300 AS DOUBLE), 'hydeMs', CAST(k AS DOUBLE), 'unknown', 1D) AS latency,
  array(named_struct('stage', 'lexical_candidates', 'n', k, 'notes', array('x', 'top=The ' || event_type || '-guide')),
        named_struct('stage', 'fusion', 'n', c % 25, 'notes', array('exact-top=other', 'fusion-top=' || IF(k % 2 = 0, upper(event_type) || ' Guide 2', 'other'))),
        named_struct('stage', 'answer_evidence_gate', 'n', c % 6, 'notes', CAST(NULL AS ARRAY<STRING>))) AS stages,
  array_compact(array(
    named_struct('step', 'sub-search-latency', 'detail', 'title=' || c % 97 || 'ms, body=' || k || '.5ms, broken'),
    IF(k % 3 = 0, named_struct('step', 'sub-search-latency', 'detail', 'title=' || c % 89 || 'ms'), NULL),
    named_struct('step', 'search-store-latency', 'detail', {_STORE}),
    named_struct('step', 'search-memo', 'detail', IF(k % 5 = 0, 'hits=none', 'hits=' || k || ' misses=' || c % 20 || ' size=' || c % 64)),
    named_struct('step', 'lexical-pool-reuse', 'detail', 'target=' || event_type || ',previous=' || k || ',targetLexical=' || c % 40 || ',overlap=' || c % 30 || ',coverage=' || c % 101 || '%,stages=a||b'),
    IF(k % 2 = 0, named_struct('step', 'lexical-pool-reuse-guard', 'detail', 'target=' || event_type || ', pool=' || k || ', result=' || IF(k % 4 = 0, 'pass', 'hold')), NULL),
    named_struct('step', 'small-to-big-context', 'detail', 'candidates=' || (k + 1) || ',included=' || c % 9 || IF(k % 7 = 0, '', ',skipped=' || c % 4) || ',chars=' || c % 5000 || ',skippedByMaxChars=' || c % 3),
    named_struct('step', 'ontology-expansion', 'detail', 'stage=' || event_type || ',seeds=' || k || ',hits=' || c % 12 || ',boosts=' || c % 5 || ',trace=' || k || ',elapsed=' || c % 300 || 'ms;stage=lost,seeds=1'),
    named_struct('step', 'retrieval-phase-timing', 'detail', IF(k % 2 = 0, 'semantic-validation=' || c % 60 || 'ms, ', '') || 'fusion=3ms'))) AS trace,
  transform(sequence(1, CAST(k % 4 AS INT) + 1), i -> named_struct('relation', element_at(array('current', 'previous', 'next'), CAST((i + c) % 3 AS INT) + 1), 'selected', i = 1, 'section', 's' || i % 2)) AS windows,
  event_type || ' guide' AS expected, array('nothing', IF(k % 3 = 0, 'guide: ' || event_type, 'none')) AS titles
FROM (SELECT event_id, event_type, CAST(coalesce(round(value * 100), 0) AS BIGINT) AS c, CAST(coalesce(regexp_extract(props, '[0-9]+', 0), '0') AS BIGINT) AS k FROM {{events}})"""


def _cases(spark, sf):
    return spark.sql(_CASES, events=table(spark, sf, "events"))


def trial_key_latencies(spark, sf):
    return T.key_latencies(_cases(spark, sf))


def trial_dominant_latency(spark, sf):
    return _cases(spark, sf).select("case_id", T.dominant(F.col("latency")).alias("d")).select("case_id", "d.key", "d.ms")


def trial_output_counts(spark, sf):
    return T.output_counts(_cases(spark, sf))


def trial_sub_searches(spark, sf):
    return T.by_stage(T.step_latencies(_cases(spark, sf), "sub-search-latency"), "ms", [], "name")


def trial_store_latencies(spark, sf):
    return T.by_stage(T.stage_rows(_cases(spark, sf), "search-store-latency", T.STORE), "total_ms", ["db_lexical_ms", "vector_ms", "corpus_ms", "db_lexical_candidates", "vector_candidates"])


def trial_phase_latencies(spark, sf):
    rows = T.stage_rows(_cases(spark, sf), "search-store-latency", T.PHASES, T.PHASES_OR_ZERO)
    return T.by_stage(rows, "total_ms", ["lexical_pool_ms", "exact_ms", "evidence_ms", "fusion_rrf_ms", "exact_input_chunks"])


def trial_memo(spark, sf):
    return T.counter_summary(T.counters(_cases(spark, sf), "search-memo"))


def trial_pool_reuse(spark, sf):
    return T.pool_reuse(_cases(spark, sf))


def trial_pool_summary(spark, sf):
    return T.pool_summary(T.pool_reuse(_cases(spark, sf)))


def trial_windows(spark, sf):
    return T.window_cases(_cases(spark, sf))


def trial_window_summary(spark, sf):
    return T.window_summary(T.window_cases(_cases(spark, sf)))


def trial_context(spark, sf):
    return T.context_summary(T.context_cases(_cases(spark, sf)))


def trial_expansions(spark, sf):
    return T.expansions(_cases(spark, sf))


def trial_reranked_paths(spark, sf):
    return T.reranked_paths(_cases(spark, sf), "purchase").select("case_id", "sub_search_ms", "store_ms", "total_ms", "fusion_ms", "exact_input_chunks", "lexical_candidates")


def trial_validation(spark, sf):
    return T.validation_latencies(_cases(spark, sf))


def trial_validation_summary(spark, sf):
    return T.summary(T.validation_latencies(_cases(spark, sf)), "validation_ms")


def trial_authority(spark, sf):
    return T.authority_cases(_cases(spark, sf))


def trial_authority_summary(spark, sf):
    return T.authority_cases(_cases(spark, sf)).groupBy("found_at").agg(F.count(F.lit(1)).alias("n"), F.count_if("drift").alias("n_drift"), F.count_if(~F.col("visible")).alias("n_missed"))


QUERIES = {f.__name__: f for f in (
    trial_key_latencies, trial_dominant_latency, trial_output_counts, trial_sub_searches, trial_store_latencies, trial_phase_latencies, trial_memo, trial_pool_reuse, trial_pool_summary,
    trial_windows, trial_window_summary, trial_context, trial_expansions, trial_reranked_paths, trial_validation, trial_validation_summary, trial_authority, trial_authority_summary,
)}

_E = "e AS (SELECT event_id AS case_id, event_type, coalesce(round(value * 100), 0)::BIGINT AS c, coalesce(nullif(regexp_extract(props, '[0-9]+'), ''), '0')::BIGINT AS k FROM events)"


def _summary(value: str, source: str, per: str) -> str:
    of = f"{per}, " if per else ""
    return f"SELECT {of}count(*) AS n, round(sum({value})::DOUBLE / count(*), 1) AS mean, quantile_disc({value}, 0.5)::DOUBLE AS p50, quantile_disc({value}, 0.95)::DOUBLE AS p95, max({value})::DOUBLE AS largest FROM {source}" + (f" GROUP BY {per}" if per else "")


def _by_stage(value: str, source: str, per: str, means: list[tuple[str, str]] | None = None) -> str:
    averaged = "".join(f", m.mean_{n}" for n, _ in means or [])
    mean = f", m AS (SELECT {per}, {', '.join(f'round(sum({x})::DOUBLE / count(*), 1) AS mean_{n}' for n, x in means)} FROM {source} GROUP BY {per})" if means else ""
    return f"""s AS ({_summary(value, source, per)}), r AS (SELECT {per}, case_id, row_number() OVER (PARTITION BY {per} ORDER BY {value} DESC, case_id) AS p FROM {source}),
t AS (SELECT {per}, string_agg(case_id::VARCHAR, ',' ORDER BY p) AS slow_ids FROM r WHERE p <= 5 GROUP BY {per}){mean}
SELECT s.*, t.slow_ids{averaged} FROM s JOIN t USING ({per})""" + (f" JOIN m USING ({per})" if means else "")


_W = "w AS (SELECT case_id, i, ['current', 'previous', 'next'][((i + c) % 3)::INTEGER + 1] AS relation FROM (SELECT case_id, c, unnest(range(1, k % 4 + 2)) AS i FROM e))"
_WC = "wc AS (SELECT case_id, count(*) AS n_windows, count(*) FILTER (relation = 'current') AS n_current, count(*) FILTER (relation = 'previous') AS n_previous, count(*) FILTER (relation = 'next') AS n_next, count(*) FILTER (i = 1) AS n_selected, count(DISTINCT i % 2) AS n_sections, count(*) FILTER (relation <> 'current') AS n_expansion FROM w GROUP BY case_id)"
_P = """p AS (SELECT case_id, event_type AS target, k::DOUBLE AS previous, (c % 40)::DOUBLE AS lexical, (c % 30)::DOUBLE AS overlap, (c % 101)::DOUBLE AS coverage, 2 AS sources,
  CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS guard_pool, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'pass' ELSE 'hold' END END AS guard_result FROM e)"""
_V = """v AS (SELECT case_id, (c % 60)::DOUBLE AS validation_ms, (c % 300)::DOUBLE AS retrieval_ms, CASE WHEN c % 300 > 0 THEN round((c % 60)::DOUBLE / (c % 300), 4) ELSE 0 END AS share, c % 6 AS n_evidence FROM e WHERE k % 2 = 0)"""
_A = "a AS (SELECT case_id, 'lexical-top' AS found_at, k % 2 <> 0 AS drift, k % 3 = 0 AS visible FROM e)"
SQL = {
    "trial_key_latencies": f"WITH {_E}, l AS (SELECT 'totalMs' AS key, c AS ms FROM e UNION ALL SELECT 'retrievalMs', c % 300 FROM e UNION ALL SELECT 'hydeMs', k FROM e) {_summary('ms', 'l', 'key')}",
    "trial_dominant_latency": f"WITH {_E} SELECT case_id, CASE WHEN greatest(k, c % 300) = 0 THEN 'totalMs' WHEN k >= c % 300 THEN 'hydeMs' ELSE 'retrievalMs' END AS key, CASE WHEN greatest(k, c % 300) = 0 THEN c ELSE greatest(k, c % 300) END::DOUBLE AS ms FROM e",
    "trial_output_counts": f"WITH {_E}, o AS (SELECT 'lexical_candidates' AS stage, k AS n FROM e UNION ALL SELECT 'fusion', c % 25 FROM e UNION ALL SELECT 'answer_evidence_gate', c % 6 FROM e) SELECT stage, round(sum(n)::DOUBLE / count(*), 1) AS mean_outputs, max(n) AS most_outputs FROM o GROUP BY stage",
    "trial_sub_searches": f"WITH {_E}, x AS (SELECT case_id, 'title' AS name, (CASE WHEN k % 3 = 0 THEN c % 89 ELSE c % 97 END)::DECIMAL(18, 6) AS ms FROM e UNION ALL SELECT case_id, 'body', k + 0.5 FROM e), {_by_stage('ms', 'x', 'name')}",
    "trial_store_latencies": f"WITH {_E}, x AS (SELECT *, event_type AS stage, k + c % 80 AS total_ms FROM e), {_by_stage('total_ms', 'x', 'stage', [('db_lexical_ms', 'k'), ('vector_ms', 'c % 50'), ('corpus_ms', 'c % 30'), ('db_lexical_candidates', 'k'), ('vector_candidates', 'c % 10')])}",
    "trial_phase_latencies": f"WITH {_E}, x AS (SELECT *, event_type AS stage, c % 400 AS total_ms FROM e), {_by_stage('total_ms', 'x', 'stage', [('lexical_pool_ms', 'c % 7'), ('exact_ms', 'c % 11'), ('evidence_ms', 'c % 23'), ('fusion_rrf_ms', '0'), ('exact_input_chunks', 'k')])}",
    "trial_memo": f"WITH {_E} SELECT sum(k)::BIGINT AS hits, sum(c % 20)::BIGINT AS misses, count(*) AS cases, count(*) FILTER (k > 0) AS cases_with_hits, round(sum(k)::DOUBLE / (sum(k) + sum(c % 20)), 4) AS hit_rate FROM e WHERE k % 5 <> 0",
    "trial_pool_reuse": f"WITH {_E}, {_P} SELECT * FROM p",
    "trial_pool_summary": f"WITH {_E}, {_P}, u AS (SELECT 'all' AS guard_result, coverage FROM p UNION ALL SELECT coalesce(guard_result, 'none'), coverage FROM p) SELECT guard_result, count(*) AS n, round(sum(coverage) / count(*), 1) AS mean_coverage, min(coverage) AS least_coverage, count(*) FILTER (coverage >= 100) AS n_full, count(*) FILTER (coverage < 100) AS n_partial FROM u GROUP BY guard_result",
    "trial_windows": f"WITH {_E}, {_W}, {_WC} SELECT * FROM wc",
    "trial_window_summary": f"WITH {_E}, {_W}, {_WC} SELECT count(*) AS cases, sum(n_windows)::BIGINT AS n_windows, sum(n_current)::BIGINT AS n_current, sum(n_previous)::BIGINT AS n_previous, sum(n_next)::BIGINT AS n_next, sum(n_selected)::BIGINT AS n_selected, sum(n_expansion)::BIGINT AS n_expansion, round(sum(n_expansion)::DOUBLE / count(*), 1) AS mean_expansion FROM wc",
    "trial_context": f"WITH {_E} SELECT count(*) AS cases, sum(k + 1)::DOUBLE AS candidates, sum(c % 9)::DOUBLE AS included, sum(c % 4)::DOUBLE AS skipped, 0.0::DOUBLE AS skipped_chunks, sum(c % 3)::DOUBLE AS skipped_chars, sum(c % 5000)::DOUBLE AS chars, round(sum(c % 9)::DOUBLE / sum(k + 1), 4) AS inclusion_rate FROM e WHERE k % 7 <> 0",
    "trial_expansions": f"WITH {_E} SELECT case_id, event_type AS stage, k::DOUBLE AS seeds, (c % 12)::DOUBLE AS hits, (c % 5)::DOUBLE AS boosts, k::DOUBLE AS entries, (c % 300)::DOUBLE AS elapsed_ms FROM e",
    "trial_reranked_paths": f"WITH {_E} SELECT case_id, (k + c % 80)::DOUBLE AS sub_search_ms, (k + c % 80)::DOUBLE AS store_ms, (c % 400)::DOUBLE AS total_ms, (c % 19)::DOUBLE AS fusion_ms, k::DOUBLE AS exact_input_chunks, 0.0::DOUBLE AS lexical_candidates FROM e WHERE event_type = 'purchase'",
    "trial_validation": f"WITH {_E}, {_V} SELECT * FROM v",
    "trial_validation_summary": f"WITH {_E}, {_V} {_summary('validation_ms', 'v', '')}",
    "trial_authority": f"WITH {_E}, {_A} SELECT * FROM a",
    "trial_authority_summary": f"WITH {_E}, {_A} SELECT found_at, count(*) AS n, count(*) FILTER (drift) AS n_drift, count(*) FILTER (NOT visible) AS n_missed FROM a GROUP BY found_at",
}
