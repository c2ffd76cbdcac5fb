"""Reports over logs and corpora: nearest-rank latencies, hit rates, histograms, log groups, cold against warm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import stored


def exact_sum(value: str | Column) -> Column:
    """A sum that no order of rows changes: decimals of six places, then a double."""
    col = F.col(value) if isinstance(value, str) else value
    return F.sum(col.cast("decimal(18,6)")).cast("double")


def counted_ranks(rows: DataFrame, value: str, *per: str) -> DataFrame:
    """(per, value, c, upto, total): each distinct value of a group, how often it stands there, how many rows are up to it, and in the group.

    Values are counted before they are shuffled and dealt out by ranges of (group, value), so that a group of many values
    fills many tasks. Running numbers are local to a range; what stands before it in its group comes from one row a range.
    """
    key = F.struct(*per, F.lit(0).alias("_")).alias("key")
    counts = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
    dealt = stored(counts.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "counted-values")
    parts = dealt.groupBy("key", "part").agg(F.sum("c").alias("m"))
    group = Window.partitionBy("key")
    before = F.coalesce(F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select("key", "part", before.alias("before"), F.sum("m").over(group).alias("total"))
    local = F.sum("c").over(Window.partitionBy("key", "part").orderBy("value"))
    return dealt.withColumn("local", local).join(parts, ["key", "part"]).select("key", "value", "c", (F.col("before") + F.col("local")).alias("upto"), "total")


def latency(log: DataFrame, value: str, *per: str) -> DataFrame:
    """Number, mean, median, 95th percentile and maximum of each group; a percentile is the value at place ceil(n p). Without groups and without values one row of nulls and 0."""
    ranks = counted_ranks(log, value, *per)
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p).cast("decimal(6,4)")), F.col("value")))
    total = F.sum(F.col("value").cast("decimal(18,6)") * F.col("c")).cast("double")
    out = (ranks.groupBy("key") if per else ranks.groupBy()).agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("n"), total.alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("largest"))
    return out.select(*[F.col(f"key.{c}").alias(c) for c in per], "n", F.try_divide("total", "n").alias("mean"), "p50", "p95", "largest")


def rates(rows: DataFrame, flags: list[str], *per: str) -> DataFrame:
    """The share of rows for which each flag holds; null flags count as false."""
    return rows.groupBy(*per).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}_rate") for f in flags])


def log_groups(log: DataFrame) -> DataFrame:
    """One row a user: events, first and last time, the latest event, mean value, numbers by type and what to do.

    Numbers by type are counted first, so a user with many events sends one row a type; the latest event is the one
    with the greatest (ts, event_id).
    """
    by_type = log.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max(F.struct("ts", "event_id", "event_type")).alias("latest"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"), F.count("value").alias("n_values"),
    )
    counted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda e: F.concat_ws("=", e["event_type"], e["n"].cast("string"))), ",")
    whole = by_type.groupBy("user_id").agg(
        F.sum("n").alias("n_events"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), F.max("latest").alias("latest"),
        F.try_divide(F.sum("total").cast("double"), F.sum("n_values")).alias("mean_value"), counted.alias("by_type"), F.count(F.lit(1)).alias("n_types"),
    )
    return whole.select("user_id", "n_events", "first_ts", "last_ts", F.col("latest.event_type").alias("latest_type"), "mean_value", "by_type", F.when((F.col("n_events") >= 3) & (F.col("n_types") >= 3), "review").otherwise("keep").alias("decision"))


def cold_warm(log: DataFrame) -> DataFrame:
    """Per user the first value, the mean of the later ones, and the speedup of the means."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = log.filter("value IS NOT NULL").select("user_id", "value", F.row_number().over(w).alias("i"))
    agg = numbered.groupBy("user_id").agg(F.max(F.when(F.col("i") == 1, F.col("value"))).alias("cold"), F.try_divide(exact_sum(F.when(F.col("i") > 1, F.col("value"))), F.count(F.when(F.col("i") > 1, 1))).alias("warm"))
    return agg.filter("warm IS NOT NULL").select("user_id", "cold", "warm", F.try_divide("cold", "warm").alias("speedup"))


def with_zeros(counts: DataFrame, domain: DataFrame, key: str, value: str) -> DataFrame:
    """Counts for every member of a small fixed domain, 0 where there are none."""
    return domain.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0).cast("long")).alias(value))
