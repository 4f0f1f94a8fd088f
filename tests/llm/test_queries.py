"""The registered queries against their SQL, on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import connect, spark_rows, sql_rows

from stocklens.llm.queries import ORACLE, QUERIES

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, database, name):
    ours, theirs = spark_rows(QUERIES[name](spark, folder)), sql_rows(database, ORACLE[name])
    assert ours == theirs
    assert ours[1]


def test_quality_plan_has_no_python(spark, folder):
    plan = QUERIES["op10_quality_cascade"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_base_scores(spark, folder, small):
    texts = {r.doc_id: r.text for r in small.collect()}

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [""]

    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op3_pitman_yor_scores"](spark, folder).collect()
    assert len(rows) == len(texts)
    held = [0.0, 0.0]
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0


def test_base_secrets(spark, folder, small):
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for r in QUERIES["op5_credential_formats"](spark, folder).collect():
        text, found = texts[r.doc_id], []
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(kind for _, _, kind, _ in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_languages_are_told(spark, folder, small):
    truth = {r.doc_id: r.lang for r in small.collect()}
    rows = [r for r in QUERIES["op8_language_subwords"](spark, folder).collect() if truth[r.doc_id] and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_toxic_scores_order_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxic_lexicon"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    bad = [r.score for r in rows if labels[r.doc_id]]
    good = [r.score for r in rows if not labels[r.doc_id]]
    pairs = [(x > y) + 0.5 * (x == y) for x in bad for y in good]
    assert sum(pairs) / len(pairs) > 0.75
    assert sum(r.predicted for r in rows if not labels[r.doc_id]) <= 0.05 * len(good)
