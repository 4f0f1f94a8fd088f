"""Latency and threshold reports over a request log, and statement statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.operators.ordered import exact_quantiles
from stocklens.operators.ranking import top_by

QUANTILES = {"med": 0.5, "p90": 0.9, "p95": 0.95}

# Greatest allowed p95 per profile in ms and greatest allowed failure rate.
P95_LIMITS = {
    "oltp_read": 10000.0,
    "oltp_insert": 10000.0,
    "oltp_update": 10000.0,
    "olap_revenue": 30000.0,
    "olap_turnover": 30000.0,
    "log_insert": 10000.0,
}
FAILURE_LIMIT = 0.05
EXPECTED_STATUS = {
    "oltp_read": 200,
    "oltp_insert": 201,
    "oltp_update": 200,
    "olap_revenue": 200,
    "olap_turnover": 200,
    "log_insert": 201,
}


def latency_report(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, rate and exact latency figures per profile. Durations are summed as decimals."""
    by = ["profile"] if by is None else by
    exact = F.col("duration_ms").cast("decimal(18,6)")
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    figures = requests.groupBy(*by).agg(
        F.count("duration_ms").alias("requests"),
        (F.sum(exact).cast("double") / F.count("duration_ms")).alias("avg"),
        F.min("duration_ms").alias("min"),
        F.max("duration_ms").alias("max"),
        F.try_divide(F.count("duration_ms").cast("double"), span).alias("per_second"),
    )
    quantiles = exact_quantiles(requests, by, "duration_ms", QUANTILES)
    if not by:
        return figures.crossJoin(F.broadcast(quantiles))
    return figures.join(quantiles, by)


def threshold_verdicts(
    requests: DataFrame, p95_limits: dict[str, float] | None = None, failure_limit: float = FAILURE_LIMIT
) -> DataFrame:
    """Each threshold with the measured value and whether it holds.

    A profile without requests has no verdict.
    """
    limits = P95_LIMITS if p95_limits is None else p95_limits
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    p95 = exact_quantiles(requests, ["profile"], "duration_ms", {"measured": 0.95})
    per_profile = (
        p95.withColumn("allowed", limit[F.col("profile")])
        .where("allowed IS NOT NULL")
        .select(F.concat(F.lit("p95 "), F.col("profile")).alias("threshold"), "measured", "allowed")
    )
    failures = requests.agg(
        F.try_divide(F.count_if("failed").cast("double"), F.count(F.lit(1)).cast("double")).alias("measured")
    ).select(F.lit("failure rate").alias("threshold"), "measured", F.lit(failure_limit).alias("allowed"))
    return per_profile.unionByName(failures).withColumn("passed", F.col("measured") < F.col("allowed"))


def check_counts(requests: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Requests with and without the expected status, per check name."""
    expected = EXPECTED_STATUS if expected is None else expected
    status = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])[F.col("profile")]
    name = F.concat(F.regexp_replace("profile", "_", " "), F.lit(" status is "), status.cast("string"))
    rows = requests.withColumn("_expected", status).where("_expected IS NOT NULL")
    good = F.col("status") == F.col("_expected")
    return rows.groupBy(name.alias("check_name")).agg(
        F.count_if(good).alias("passes"), F.count_if(~good).alias("fails")
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """p95 per profile of two latency reports, and the change in percent."""
    a = before.select("profile", F.col("p95").alias("p95_before"))
    b = after.select("profile", F.col("p95").alias("p95_after"))
    change = F.try_divide((F.col("p95_after") - F.col("p95_before")) * 100, F.col("p95_before"))
    return a.join(b, "profile").withColumn("change_percent", change)


def slowest_statements(statements: DataFrame, n: int = 500) -> DataFrame:
    """Statements with the greatest mean time, for export."""
    return top_by(statements, [F.desc("mean_exec_time"), F.asc("query")], n)
