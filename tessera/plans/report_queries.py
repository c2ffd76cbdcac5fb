"""Reports over events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import is_follow_up
from tessera.operators import reports as R
from tessera.sources.tables import table


def event_latency(spark, sf):
    return R.latency(table(spark, sf, "events"), "value", "event_type")


def event_latency_total(spark, sf):
    return R.latency(table(spark, sf, "events"), "value")


def operational_log(spark, sf):
    return R.log_groups(table(spark, sf, "events"))


def cold_and_warm(spark, sf):
    return R.cold_warm(table(spark, sf, "events"))


def quality_rates(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return R.rates(rows, ["quality", "toxic"], "source")


def language_counts(spark, sf):
    """Documents of every language and source that occur, zeros included."""
    docs = table(spark, sf, "documents").select("lang", "source")
    counts = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs, sources = docs.select("lang").distinct(), docs.select("source").distinct()
    filled = langs.withColumn("one", F.lit(1)).join(sources.agg(F.collect_set("source").alias("all")).withColumn("one", F.lit(1)), "one").select("lang", F.explode("all").alias("source"))
    return filled.join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def signal_histogram(spark, sf):
    """Events by type and hour of the day, with each type's share of the hour."""
    by = table(spark, sf, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("hour")), 6))


def latest_user_turns(spark, sf):
    """The last user turn of each conversation, the one before, and both joined where the last leans on it."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"), F.slice(F.sort_array(F.collect_list("turn"), asc=False), 2, 1).alias("before"))
    before = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("previous"))
    joined = last.select("conv_id", "last.*", F.get("before", F.lit(0)).alias("b")).join(before, (F.col("conv_id") == F.col("c")) & (F.col("b") == F.col("t")), "left")
    follows = is_follow_up(F.col("text")) & F.col("previous").isNotNull()
    query = F.when(follows, F.concat_ws(" ", "previous", "text")).otherwise(F.col("text"))
    return joined.select("conv_id", "turn", follows.alias("follow_up"), F.md5(query).alias("query_md5"))


def conversation_context(spark, sf):
    """The turns of each conversation that fit a budget of 4000 characters, read from the end."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    used = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("used", used).filter("used <= 4000")


def slowest_events(spark, sf):
    """The ten largest values, a report's top list."""
    return table(spark, sf, "events").filter("value IS NOT NULL").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (event_latency, event_latency_total, operational_log, cold_and_warm, quality_rates, language_counts, signal_histogram, latest_user_turns, conversation_context, slowest_events)}

_LAT = "count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE / count(*) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest FROM events WHERE value IS NOT NULL"
SQL = {
    "event_latency": f"SELECT event_type, {_LAT} GROUP BY event_type",
    "event_latency_total": f"SELECT {_LAT}",
    "operational_log": """
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type, count(*) AS k FROM t GROUP BY user_id),
g AS (SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS latest_type, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean_value FROM events GROUP BY user_id)
SELECT user_id, n_events, first_ts, last_ts, latest_type, mean_value, by_type, CASE WHEN n_events >= 3 AND k >= 3 THEN 'review' ELSE 'keep' END AS decision FROM g JOIN l USING (user_id)""",
    "cold_and_warm": """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
a AS (SELECT user_id, max(value) FILTER (i = 1) AS cold, (sum(value::DECIMAL(18,6)) FILTER (i > 1))::DOUBLE / count(*) FILTER (i > 1) AS warm FROM n GROUP BY user_id)
SELECT user_id, cold, warm, CASE WHEN warm <> 0 THEN cold / warm END AS speedup FROM a WHERE warm IS NOT NULL""",
    "quality_rates": "SELECT source, count(*) AS n, avg(coalesce(quality, 0)::DOUBLE) AS quality_rate, avg(coalesce(toxic, 0)::DOUBLE) AS toxic_rate FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "language_counts": """
SELECT l.lang, s.source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s
LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source GROUP BY ALL""",
    "signal_histogram": "WITH b AS (SELECT hour(ts)::INTEGER AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT hour, event_type, n, round(n / sum(n) OVER (PARTITION BY hour), 6) AS share FROM b",
    "latest_user_turns": r"""
WITH u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
f AS (SELECT *, (length(trim(coalesce(text, ''))) <= 18 OR regexp_matches(lower(trim(coalesce(text, ''))), '^(그|이|저|그럼|그러면|and|then|it|that|this)(\s|$)')) AND previous IS NOT NULL AS follow_up FROM u WHERE r = 1)
SELECT conv_id, turn, follow_up, md5(CASE WHEN follow_up THEN concat_ws(' ', previous, text) ELSE text END) AS query_md5 FROM f""",
    "conversation_context": """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations)
SELECT * FROM t WHERE used <= 4000""",
    "slowest_events": "SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 10",
}
