import datetime

import pytest
from pyspark.sql import functions as F

from stocklens.functions.labels import label_is, label_like, label_unlike
from stocklens.plans import latency, metrics
from stocklens.schemas import REQUESTS, SAMPLES
from stocklens.sources.tables import load_samples


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


@pytest.fixture
def samples(spark):
    def build(*rows):
        return spark.createDataFrame([(m, labels, at(s), float(v)) for m, labels, s, v in rows], SAMPLES)

    return build


A, B = {"datname": "a", "instance": "1"}, {"datname": "template1", "instance": "1"}


def test_label_matches(samples):
    df = samples(("m", A, 0, 1), ("m", B, 0, 1), ("m", {}, 0, 1))
    labels = F.col("labels")
    assert df.where(label_is(labels, "datname", "a")).count() == 1
    assert df.where(label_like(labels, "datname", "template[01]|a")).count() == 2
    assert df.where(label_like(labels, "datname", "template")).count() == 0  # the whole value has to match
    assert df.where(label_unlike(labels, "datname", "template[01]")).count() == 2  # no label matches too
    assert df.where(label_like(labels, "datname", "")).count() == 1


def test_rates_with_a_restart_and_across_windows(samples):
    df = samples(*[("c", A, s, v) for s, v in [(0, 100), (100, 160), (299, 220), (310, 250), (400, 10), (950, 40)]])
    found = {r.window_start - 1_704_067_200: r.rate * 300 for r in metrics.counter_rates(df).collect()}
    assert found == pytest.approx({0: 120.0, 300: 40.0, 900: 30.0})


def test_a_single_sample_has_no_rate(samples):
    assert metrics.counter_rates(samples(("c", A, 0, 5))).count() == 0


def test_hit_ratio(samples):
    hit, read = metrics.BLOCKS_HIT, metrics.BLOCKS_READ
    df = samples((hit, A, 0, 0), (hit, A, 60, 90), (read, A, 0, 0), (read, A, 60, 10), (hit, B, 0, 7), (hit, B, 60, 7))
    found = {r.datname: r.hit_ratio for r in metrics.hit_ratio(df).collect()}
    assert found["a"] == pytest.approx(0.9) and found["template1"] is None


def test_transactions_need_both_counters(samples):
    c, r = metrics.COMMITS, metrics.ROLLBACKS
    lone = {"datname": "x", "instance": "1"}
    df = samples(*[(m, l, s, s) for m in (c, r) for l in (A, B) for s in (0, 60)], (c, lone, 0, 0), (c, lone, 60, 60))
    found = metrics.transactions_per_second(df).collect()
    assert [(row.labels["datname"], row.rate) for row in found] == [("a", pytest.approx(120 / 300))]


def test_gauges_use_the_newest_sample(samples):
    c = metrics.CONNECTIONS
    rows = [(c, {"datname": "a", "state": s}, t, v) for s, t, v in [("active", 0, 9), ("active", 60, 2), ("idle", 0, 3), ("idle in transaction", 0, 50)]]
    df = samples(*rows, (c, {"datname": "b", "state": "idle"}, 0, 1))
    assert {r.state: r.value for r in metrics.connections_by_state(df).collect()} == {"active": 2, "idle": 4, "total": 6}
    assert {r.state: r.value for r in metrics.connections_by_state(df, "a", at(30)).collect()} == {
        "active": 9,
        "idle": 3,
        "total": 12,
    }
    assert {r.datname for r in metrics.label_values(df, c, "datname").collect()} == {"a", "b"}


def test_label_order_does_not_split_a_series(samples):
    df = samples(("g", {"x": "1", "y": "2"}, 0, 5), ("g", {"y": "2", "x": "1"}, 60, 7))
    assert metrics.gauge(df, "g", "sum").first().value == 7


def test_top_mean_time(samples):
    rows = []
    for i in range(8):
        rows += [(metrics.STATEMENT_SECONDS, {"datname": "a", "q": str(i)}, 0, i), (metrics.STATEMENT_CALLS, {"datname": "a", "q": str(i)}, 0, i % 3)]
    found = metrics.top_mean_time(samples(*rows), "a").collect()
    assert [(r.labels["q"], r.mean_ms) for r in found] == [
        ("7", 7000.0),
        ("6", 6000.0),
        ("4", 4000.0),
        ("3", 3000.0),
        ("5", 2500.0),
    ]


def test_staleness_skips_jobs_without_success(samples):
    m = metrics.LAST_SUCCESS
    base = 1_704_067_200
    df = samples((m, {"db": "a"}, 0, base), (m, {"db": "b"}, 0, 0), (m, {"db": "c"}, 0, base), (m, {"db": "c"}, 60, 0))
    found = metrics.staleness(df, at(90)).collect()
    assert [(r.labels["db"], r.seconds_since_success) for r in found] == [("a", 90.0)]


def test_overviews(samples):
    df = samples(
        ("pg_up", A, 0, 1),
        ("pg_up", {"instance": "2"}, 0, 0),
        (metrics.DATABASE_SIZE, A, 0, 100),
        (metrics.DATABASE_SIZE, B, 0, 1),
        (metrics.BACKENDS, A, 0, 4),
        (metrics.BACKENDS, B, 0, 4),
        ("up", {"job": "minio"}, 0, 1),
        ("up", {"job": "etcd", "instance": "1"}, 0, 1),
        ("up", {"job": "etcd", "instance": "2"}, 0, 1),
        (metrics.FREE_CAPACITY, A, 0, 9),
        (metrics.LAST_SIZE, A, 0, 3),
        ("patroni_primary", A, 0, 1),
        ("haproxy_server_up", {"backend": "other"}, 0, 1),
    )
    overview = {(r.report, r.datname): r.value for r in metrics.database_overview(df).collect()}
    assert overview == {("up", ""): 1, ("size_bytes", ""): 100, ("connections", "a"): 4}
    backup = {r.report: r.value for r in metrics.backup_overview(df).collect()}
    assert backup == {"storage_up": 1, "exporter_up": None, "free_bytes": 9, "last_size_bytes": 3}
    counts = metrics.cluster_counts(df).first()
    assert (counts.primaries, counts.members_up, counts.database_up, counts.proxy_backends_up) == (1, 2, 1, None)
    assert metrics.member_states(df).count() == 7


def test_samples_from_files(samples, spark, tmp_path):
    samples(("m", A, 0, 1)).write.parquet(str(tmp_path / "s"))
    assert load_samples(spark, str(tmp_path / "s")).first().labels == A


@pytest.fixture
def log(spark):
    def build(*rows):
        return spark.createDataFrame([(at(s), p, float(d), st, st >= 400) for s, p, d, st in rows], REQUESTS)

    return build


def test_latency_report(log):
    df = log(*[(i, "oltp_read", i, 200) for i in range(0, 101)])
    row = latency.latency_report(df).first()
    assert (row.requests, row.avg, row.min, row.max, row.med, row.p90, row.p95) == (101, 50, 0, 100, 50, 90, 95)
    assert row.per_second == pytest.approx(1.01)
    whole = latency.latency_report(df, by=[]).first()
    assert (whole.requests, whole.p95) == (101, 95)


def test_thresholds(log):
    good = log((0, "oltp_read", 9999.9, 200), (1, "olap_revenue", 29_999, 200))
    assert {r.threshold: r.passed for r in latency.threshold_verdicts(good).collect()} == {
        "p95 oltp_read": True,
        "p95 olap_revenue": True,
        "failure rate": True,
    }
    bad = log((0, "oltp_read", 10_000, 500), (0, "unknown", 1e9, 200))
    assert {r.threshold: r.passed for r in latency.threshold_verdicts(bad).collect()} == {
        "p95 oltp_read": False,
        "failure rate": False,
    }


def test_checks_and_comparison(log):
    df = log((0, "oltp_insert", 1, 201), (0, "oltp_insert", 1, 500), (0, "other", 1, 200))
    assert [tuple(r) for r in latency.check_counts(df).collect()] == [("oltp insert status is 201", 1, 1)]
    before = latency.latency_report(log((0, "a", 10, 200), (0, "b", 10, 200)))
    after = latency.latency_report(log((0, "a", 15, 200), (0, "c", 10, 200)))
    assert [tuple(r) for r in latency.compare_runs(before, after).collect()] == [("a", 10.0, 15.0, 50.0)]


def test_slowest_statements(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("query"), F.col("id").cast("double").alias("mean_exec_time"))
    found = latency.slowest_statements(df)
    assert found.count() == 500 and found.first().query == "599"
