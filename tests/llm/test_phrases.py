"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from stocklens.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(docs, kept, least, longest=4, share=80):
    counts = defaultdict(Counter)
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p in f if len(p) > 1 and f[p] >= least]
        covered = set()
        for q in candidates:
            for m in range(2, len(q)):
                covered |= {q[i : i + m] for i in range(len(q) - m + 1) if 100 * f[q] >= share * f[q[i : i + m]]}
        best = []
        for p in candidates:
            if p not in covered:
                cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:kept], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def made_up(rng, number):
    words = [f"w{i}" for i in range(40)] + ["É", "été"]
    fixed = [rng.sample(words, rng.randrange(2, 7)) for _ in range(12)]
    docs = []
    for _ in range(number):
        text = []
        for _ in range(rng.randrange(1, 12)):
            text += rng.choice(fixed) if rng.random() < 0.5 else rng.choices(words, k=rng.randrange(1, 5))
            text += rng.choice([[], [], ["."], ["\n"], ["\t"], [";", "A"]])
        docs.append((rng.choice(["en", "en", "en", "fr", None]), " ".join(text)))
    return docs


def table(spark, docs):
    rows = [(i, t, lang, "x", "y", 1) for i, (lang, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, w1 string, phrase string, a int")


@pytest.mark.parametrize(("kept", "least", "longest"), [(2000, 3, 4), (7, 3, 4), (15, 8, 5)])
def test_collocations_equal_plain_counts(spark, monkeypatch, kept, least, longest):
    """With thresholds from few pairs, so that several waves are needed, and with none."""
    monkeypatch.setattr(phrases, "FIRST_WAVE", 1)
    monkeypatch.setattr(phrases, "WAVE_GROWTH", 2)
    docs = made_up(random.Random(kept), 160)
    found = phrases.collocations(table(spark, docs), kept, least, longest)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == plain(docs, kept, least, longest)


def test_crowded_filters_change_nothing(spark, monkeypatch):
    """A filter that lets nearly everything through costs counts, not results."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 15)
    docs = made_up(random.Random(3), 100)
    found = phrases.collocations(table(spark, docs), 9, 2)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == plain(docs, 9, 2)


def test_odd_texts(spark):
    long = "One two three. " * 40_000 + "z" * 300_000
    docs = [("en", None), ("en", ""), (None, "a b, a b"), ("und", "A b"), ("fr", ". ; \n"), ("de", long), ("de", long), ("", "a b a b a b")]
    found = phrases.collocations(table(spark, docs), 2000, 3)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == plain(docs, 2000, 3)
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [("en", None)])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**16 + 1, 10**16 + 3, 3 * 10**16 + 7), (9 * 10**18, 9 * 10**18, 9 * 10**18)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases.ratio(df.a, df.l, df.r)).collect()]
    assert got == [2_000_000 * a // (x + y) for a, x, y in rows]
