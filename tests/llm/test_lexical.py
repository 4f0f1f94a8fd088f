"""Ranked search against a plain evaluation, and the mined sharing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stocklens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs = len(counts)
    all_terms = sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_shared_sums_equal_plain_sums(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(lexical, "RUN", [4, 64][seed % 2])
    items = [sorted(set(rng.integers(0, 40, rng.integers(1, 30)).tolist())) for _ in range(20)]
    items += [items[0], items[1], list(range(40))]
    term = np.array([t for own in items for t in own])
    item = np.array([i for i, own in enumerate(items) for _ in own])
    sharing = lexical.mined(term, item, len(items))
    values = rng.integers(0, 1000, (40, 7))
    atoms = np.zeros((sharing.atoms, 7), np.int64)
    np.add.at(atoms, sharing.atom, values)
    assert (sharing.sums(atoms) == [values[own].sum(axis=0) for own in items]).all()
    added = sharing.size - sharing.atoms + len(sharing.nodes)
    assert added < 0.8 * len(term)


@pytest.mark.parametrize("block_chars", [10**6, 5000])
def test_search_equals_plain_search(spark, documents, block_chars):
    rng = random.Random(block_chars)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "x9", "_", "#"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)]
    docs += [(300, docs[0][1]), (7, docs[3][1]), (None, docs[5][1]), (301, None), (302, " -_- "), (303, ""), (304, "W1 " * 50_000)]
    items = [(j, ", ".join(rng.choices(words, k=rng.randrange(1, 25))).upper()) for j in range(25)]
    items += [(25, None), (26, "!"), (27, "nowhere"), (None, docs[8][1]), (28, "w1_w2-W2"), (29, docs[9][1] * 300)]
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id bigint, text string, rank int, doc_id string")
    found = lexical.search(documents(docs, "score string, rank string, item_id string"), table, 10, block_chars)
    assert rows_of(found) == plain_search(docs, items)


def test_repeated_item_ids_are_ranked_apart(spark, documents):
    table = spark.createDataFrame([(1, "a"), (1, "b")], "item_id bigint, text string")
    docs = [(1, "a"), (2, "b"), (3, "c d"), (4, "c e"), (5, "d d")]
    assert rows_of(lexical.search(documents(docs), table)) == plain_search(docs, [(1, "a"), (1, "b")])


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(documents([(1, "a")]), none).collect() == []
    assert lexical.search(documents([]), one).collect() == []
    assert lexical.search(documents([(1, None)]), one).collect() == []
