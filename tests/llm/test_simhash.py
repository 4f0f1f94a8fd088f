"""SimHash fingerprints and groups against brute force."""

import itertools
import random
import re

import pytest
import xxhash
from test_groups import closure

from stocklens.llm import simhash
from stocklens.llm.queries import QUERIES


def plain_print(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
    shingles = [words[i : i + width] for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Components of (doc_id, fingerprint) pairs by comparing all with all."""
    values = sorted({p for _, p in prints})
    links = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    root = closure(values, links)
    least = {}
    for i, p in prints:
        least[root[p]] = min(i, least.get(root[p], i))
    return sorted((i, p, least[root[p]]) for i, p in prints)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_hides_every_choice_of_bits(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    choices = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), 3) for _ in range(4000))
    for chosen in choices:
        assert any(not any(mask >> i & 1 for i in chosen) for mask in masks)


@pytest.mark.parametrize("compared", [0, 4, 100])
def test_links_equal_all_pairs(spark, compared):
    """Also with every bucket cut into cells, and for clusters that overlap."""
    rng = random.Random(compared)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            prints.add(base ^ sum(1 << i for i in set(rng.choices(range(64), k=rng.randrange(5)))))
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, 3, 1 << 63, (1 << 64) - 1}
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint bigint")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_prints(table, compared=compared).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in links)
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2]
    assert closure(prints, links) == closure(prints, pairs)


def test_query_equals_brute_force(spark, folder, small):
    texts = [(r.doc_id, r.text) for r in small.collect()]
    expected = plain_groups([(i, plain_print(t)) for i, t in texts])
    rows = QUERIES["op11_simhash_near_duplicates"](spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == [
        (i, f"{p:016x}", c) for i, p, c in expected
    ]


def test_odd_rows(documents):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(120_000))
    rows = [(4, None), (3, ""), (9, " \t\n"), (5, "One two"), (6, "one  TWO"), (7, "É x\x0by z"), (8, long), (2, long + " End")]
    rows += [(5, "other text of this id"), (None, "one two"), (None, "alone for itself here"), (1, "b" * 300_000)]
    found = simhash.near_duplicates(documents(rows, "fingerprint string, component_id string, n_shingles string")).collect()
    assert len(found) == len(rows)
    by_text = {(i, plain_print(t) - (plain_print(t) >> 63 << 64)) for i, t in rows}
    assert {(r.doc_id, r.fingerprint) for r in found} == by_text
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    assert groups[4, 0] == groups[3, 0] == groups[9, 0] == 3
    assert groups[5, 1] == groups[6, 1] == groups[None, 1] == 5
    assert groups[8, 119_998] == groups[2, 119_999] == 2
    assert groups[5, 3] == 5 and groups[None, 2] is None


def test_one_group_of_many_near_copies(spark, documents):
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    expected = plain_groups([(i, plain_print(t)) for i, t in rows])
    found = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found) == expected


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
