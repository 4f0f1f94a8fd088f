"""Reports over metric samples ``(metric, labels, ts, value)``.

Instant reports look at the newest sample of each series. Rates are defined
without extrapolation to the window edges: the increase of a window is the sum
of the steps between neighbouring samples that end in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.labels import label, label_is, label_like, label_unlike, series_key
from stocklens.functions.scalars import clamp_min, instant, seconds_since
from stocklens.operators.latest import latest_per_key
from stocklens.operators.ordered import previous_value
from stocklens.operators.ranking import top_by

# Metric names and label patterns of the reports.
BLOCKS_HIT = "pg_stat_database_blks_hit"
BLOCKS_READ = "pg_stat_database_blks_read"
COMMITS = "pg_stat_database_xact_commit"
ROLLBACKS = "pg_stat_database_xact_rollback"
STATEMENT_SECONDS = "pg_stat_statements_seconds_total"
STATEMENT_CALLS = "pg_stat_statements_calls_total"
CONNECTIONS = "pg_stat_activity_count"
BACKENDS = "pg_stat_database_numbackends"
DATABASE_SIZE = "pg_database_size_bytes"
EXPORTER_UP = "pg_up"
LAST_SUCCESS = "backup_last_success_timestamp_seconds"
LAST_SIZE = "backup_last_size_bytes"
FREE_CAPACITY = "minio_cluster_capacity_usable_free_bytes"
TEMPLATE_DATABASES = "template[01]"
SUCCESS_LABELS = ["db", "bucket", "instance", "job"]
CLUSTER_GAUGES = {
    # report name: (metric, label, value, aggregate)
    "primaries": ("patroni_primary", None, None, "sum"),
    "replicas": ("patroni_replica", None, None, "sum"),
    "members_with_leader": ("etcd_server_has_leader", None, None, "sum"),
    "members_up": ("up", "job", "etcd", "sum"),
    "proxy_backends_up": ("haproxy_server_up", "backend", "patroni_primary", "sum"),
    "database_up": ("pg_up", None, None, "max"),
}
CLUSTER_MEMBERS = [
    "patroni_primary",
    "patroni_replica",
    "etcd_server_has_leader",
    "up",
    "pg_up",
    "haproxy_server_up",
    "pg_replication_lag_seconds",
]

AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}


def select_series(samples: DataFrame, metric: str, where: Column | None = None) -> DataFrame:
    rows = samples.where(F.col("metric") == metric)
    return rows if where is None else rows.where(where)


def newest_samples(samples: DataFrame, as_of: object | None = None) -> DataFrame:
    """The newest sample of every series, not later than ``as_of``."""
    rows = samples if as_of is None else samples.where(F.col("ts") <= instant(as_of))
    keyed = rows.withColumn("series", series_key(F.col("labels")))
    return latest_per_key(keyed, ["metric", "series"], ["ts", "value"])


def gauge(
    samples: DataFrame,
    metric: str,
    how: str,
    by: list[str] | None = None,
    where: Column | None = None,
    as_of: object | None = None,
) -> DataFrame:
    """``how`` over the newest values of a metric, per label in ``by``."""
    now = newest_samples(select_series(samples, metric, where), as_of)
    groups = [label(F.col("labels"), name).alias(name) for name in by or []]
    return now.groupBy(*groups).agg(AGGREGATES[how]("value").alias("value"))


def label_values(samples: DataFrame, metric: str, name: str) -> DataFrame:
    """Distinct values of a label, for choosing one."""
    rows = select_series(samples, metric).where(F.col("labels")[name].isNotNull())
    return rows.select(F.col("labels")[name].alias(name)).distinct()


def counter_rates(samples: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Increase per second of every counter series and window.

    A value below its predecessor means the counter restarted; the increase is
    then the value itself. The predecessor is looked up window by window, so a
    long series is never sorted in one task.
    """
    start = F.floor(F.unix_seconds("ts") / window_seconds) * window_seconds
    rows = samples.select("metric", series_key(F.col("labels")).alias("series"), "ts", "value")
    rows = rows.withColumn("window_start", start.cast("bigint"))
    steps = previous_value(
        rows,
        keys=["metric", "series"],
        order="ts",
        value="value",
        chunk=F.col("window_start"),
        name="before",
    )
    increase = F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    return (
        steps.where("before IS NOT NULL")
        .groupBy("metric", "series", "window_start")
        .agg((F.sum(increase) / window_seconds).alias("rate"))
        .select("metric", F.map_from_entries("series").alias("labels"), "window_start", "rate")
    )


def hit_ratio(
    samples: DataFrame, window_seconds: int = 300, hit: str = BLOCKS_HIT, read: str = BLOCKS_READ, by: str = "datname"
) -> DataFrame:
    """Share of cache hits per window and label; NULL where nothing was read."""
    rates = counter_rates(samples.where(F.col("metric").isin(hit, read)), window_seconds)
    hits = F.sum(F.when(F.col("metric") == hit, F.col("rate")).otherwise(0.0))
    return (
        rates.groupBy(label(F.col("labels"), by).alias(by), "window_start")
        .agg(hits.alias("_hit"), F.sum("rate").alias("_all"))
        .select(by, "window_start", F.try_divide("_hit", F.col("_all")).alias("hit_ratio"))
    )


def transactions_per_second(samples: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Commits plus rollbacks per second of each series that has both, without template databases."""
    rows = samples.where(label_unlike(F.col("labels"), "datname", TEMPLATE_DATABASES))
    return added_rates(rows, COMMITS, ROLLBACKS, window_seconds)


def added_rates(samples: DataFrame, first: str, second: str, window_seconds: int = 300) -> DataFrame:
    """Sum of two counters' rates where all labels match."""
    rates = counter_rates(samples.where(F.col("metric").isin(first, second)), window_seconds)
    keyed = rates.select("metric", series_key(F.col("labels")).alias("series"), "window_start", "rate")
    pair = ["series", "window_start"]
    both = keyed.groupBy(*pair).agg(
        F.sum("rate").alias("rate"), F.count_distinct("metric").alias("_metrics")
    )
    return both.where("_metrics = 2").select(
        F.map_from_entries("series").alias("labels"), "window_start", "rate"
    )


def matched(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left samples with a matching right one, on all labels or those named: ``left and right``."""

    def key(df: DataFrame) -> Column:
        if on is None:
            return series_key(F.col("labels"))
        return F.array(*[label(F.col("labels"), name) for name in on])

    wanted = right.select(key(right).alias("_key")).distinct()
    return left.withColumn("_key", key(left)).join(wanted, "_key", "left_semi").drop("_key")


def top_mean_time(
    samples: DataFrame,
    datname: str | None = None,
    n: int = 5,
    seconds: str = STATEMENT_SECONDS,
    calls: str = STATEMENT_CALLS,
    as_of: object | None = None,
) -> DataFrame:
    """The ``n`` statements with the greatest mean time in milliseconds."""
    where = None if datname is None else label_is(F.col("labels"), "datname", datname)
    spent = newest_samples(select_series(samples, seconds, where), as_of)
    called = newest_samples(select_series(samples, calls, where), as_of)
    mean = F.col("_seconds") / clamp_min(F.col("_calls"), 1.0) * 1000
    both = spent.select("series", F.col("value").alias("_seconds")).join(
        called.select("series", F.col("value").alias("_calls")), "series"
    )
    ranked = both.select("series", mean.alias("mean_ms"))
    best = top_by(ranked, [F.desc("mean_ms"), F.asc("series")], n)
    return best.select(F.map_from_entries("series").alias("labels"), "mean_ms")


def staleness(
    samples: DataFrame, as_of: object, metric: str = LAST_SUCCESS, on: list[str] | None = None
) -> DataFrame:
    """Seconds since the time a metric holds, for series whose value is positive."""
    now = newest_samples(select_series(samples, metric), as_of)
    there = matched(now, now.where("value > 0"), SUCCESS_LABELS if on is None else on)
    return there.select("labels", seconds_since(F.col("value"), as_of).alias("seconds_since_success"))


def connections_by_state(samples: DataFrame, datname: str | None = None, as_of: object | None = None) -> DataFrame:
    """Active and idle connections and their total."""
    where = label_like(F.col("labels"), "state", "active|idle")
    if datname is not None:
        where = where & label_is(F.col("labels"), "datname", datname)
    states = gauge(samples, CONNECTIONS, "sum", ["state"], where, as_of)
    total = states.agg(F.sum("value").alias("value")).select(F.lit("total").alias("state"), "value")
    return states.unionByName(total)


def database_overview(samples: DataFrame, as_of: object | None = None) -> DataFrame:
    """Exporter state, total database size and connections per database."""
    real = label_unlike(F.col("labels"), "datname", TEMPLATE_DATABASES)
    up = gauge(samples, EXPORTER_UP, "max", as_of=as_of)
    size = gauge(samples, DATABASE_SIZE, "sum", where=real, as_of=as_of)
    used = gauge(samples, BACKENDS, "sum", ["datname"], real, as_of)
    return (
        up.select(F.lit("up").alias("report"), F.lit("").alias("datname"), "value")
        .unionByName(size.select(F.lit("size_bytes").alias("report"), F.lit("").alias("datname"), "value"))
        .unionByName(used.select(F.lit("connections").alias("report"), "datname", "value"))
    )


def backup_overview(samples: DataFrame, as_of: object | None = None) -> DataFrame:
    """Storage and exporter state, free capacity and last backup size."""
    jobs = [("storage_up", "minio"), ("exporter_up", "backup_exporter")]
    parts = [
        gauge(samples, "up", "max", where=label_is(F.col("labels"), "job", job), as_of=as_of).select(
            F.lit(name).alias("report"), "value"
        )
        for name, job in jobs
    ]
    free = gauge(samples, FREE_CAPACITY, "sum", as_of=as_of)
    size = newest_samples(select_series(samples, LAST_SIZE), as_of)
    parts.append(free.select(F.lit("free_bytes").alias("report"), "value"))
    parts.append(size.select(F.lit("last_size_bytes").alias("report"), "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cluster_counts(samples: DataFrame, as_of: object | None = None) -> DataFrame:
    """One value per cluster gauge, from one pass over the newest samples."""
    now = newest_samples(samples.where(F.col("metric").isin([g[0] for g in CLUSTER_GAUGES.values()])), as_of)
    columns = []
    for name, (metric, key, value, how) in CLUSTER_GAUGES.items():
        chosen = F.col("metric") == metric
        if key is not None:
            chosen = chosen & label_is(F.col("labels"), key, value)
        columns.append(AGGREGATES[how](F.when(chosen, F.col("value"))).alias(name))
    return now.agg(*columns)


def member_states(samples: DataFrame, as_of: object | None = None) -> DataFrame:
    """Newest value of each cluster gauge per member."""
    now = newest_samples(samples.where(F.col("metric").isin(CLUSTER_MEMBERS)), as_of)
    return now.select("metric", "labels", "value")
