"""Gates and classifications over evaluation tables: one row in, one verdict out, or a table of rules against a row of metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the thresholds of the regression gate.
MINIMA = {"top3_hits": 26.0, "top5_hits": 26.0, "validation_signal_pass_rate": 1.0, "validation_signal_checks": 3.0, "claim_coverage_pass_rate": 1.0, "claim_coverage_checks": 3.0}
MAXIMA = {"retrieval_average_ms": 120.0, "retrieval_p95_ms": 250.0, "case_p95_ms": 750.0}


def failures(metrics: DataFrame, minima: Mapping[str, float] = MINIMA, maxima: Mapping[str, float] = MAXIMA) -> DataFrame:
    """metrics with ``failures``: a message for each value below its minimum or above its maximum; a null counts as 0."""
    def value(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)

    below = [F.when(value(n) < m, F.concat(F.lit(f"{n}: "), value(n).cast("string"), F.lit(f" < {m}"))) for n, m in minima.items()]
    above = [F.when(value(n) > m, F.concat(F.lit(f"{n}: "), value(n).cast("string"), F.lit(f" > {m}"))) for n, m in maxima.items()]
    out = metrics.withColumn("failures", F.array_compact(F.array(*below, *above)))
    return out.withColumn("passed", F.size("failures") == 0)


def miss_class(top3: Column, top5: Column, abstained: Column, confidence: Column, expected_in_evidence: Column) -> Column:
    """Why a case was missed: by design, by order, by fusion, or because the candidate was never found."""
    return (
        F.when(abstained & (confidence == "low") & ~top5, "accepted-abstain-negative-case")
        .when(~top3 & top5, "top3-rerank-priority-miss")
        .when(~top5 & expected_in_evidence, "evidence-visible-fusion-miss")
        .otherwise("candidate-recall-miss")
    )


def review_signals(confidence: Column, n_issues: Column, n_unsupported: Column, fallback: Column, rank_gap: Column, mode: Column) -> Column:
    """The names of what in a logged query calls for a review, in a fixed order."""
    candidate = (mode == "evaluation") & (rank_gap | (n_issues > 0) | (n_unsupported > 0))
    pairs = (
        ("low_confidence", confidence == "low"), ("validation_issue", n_issues > 0), ("unsupported_claim", n_unsupported > 0),
        ("fallback_used", fallback), ("rank_evidence_gap", rank_gap), ("residual_ranking_candidate", candidate),
    )
    return F.array_compact(F.array(*[F.when(test, name) for name, test in pairs]))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to three digits; 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(0.0)


def latest(entries: DataFrame, most: int, *order: Column, per: str | None = None) -> DataFrame:
    """The ``most`` newest rows of a log (of each group, if given), newest first in ``place``.

    Without a group the rows are cut to ``most`` in every partition before they meet.
    """
    if per is None:
        cut = entries.orderBy(*order).limit(most)
        return cut.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("place") <= most)


def best_of_each(lists: DataFrame, score: str, *key: str) -> DataFrame:
    """Of candidates that several searches found, the row of the largest score; ties to the smallest of the other columns."""
    rest = [c for c in lists.columns if c not in (score, *key)]
    best = lists.groupBy(*key).agg(F.min(F.struct((-F.col(score)).alias("s"), *rest)).alias("b"))
    return best.select(*key, (-F.col("b.s")).alias(score), *[F.col(f"b.{c}").alias(c) for c in rest])


def boost_sums(maps: DataFrame, key: str, boost: str) -> DataFrame:
    """Boost maps of several origins, (key, boost) rows each, added up."""
    return maps.groupBy(key).agg(F.sum(boost).alias(boost))


def list_overlap(left: DataFrame, right: DataFrame, per: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(per, n_left, n_right, n_both, coverage): how far two candidate lists of each query agree; coverage is of the left."""
    both = left.select(per, item, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(per, item, F.lit(0).alias("l"), F.lit(1).alias("r")))
    held = both.groupBy(per, item).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    sums = held.groupBy(per).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("n_both"))
    return sums.withColumn("coverage", ratio(F.col("n_both"), F.col("n_left")))


def first_of_each(ranked: DataFrame, item: str, per: str = "query_id") -> DataFrame:
    """The best-ranked row of each item in a query's list, ranked anew."""
    own = F.row_number().over(Window.partitionBy(per, item).orderBy("rank"))
    first = ranked.withColumn("_own", own).filter("_own = 1").drop("_own")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy("rank")))
