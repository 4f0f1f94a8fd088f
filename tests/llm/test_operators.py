"""Row-wise and bounded-model operators on small fixtures, with odd rows."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from stocklens.llm import chat, credentials, decontaminate, language, packing, pitman_yor, quality_rules, toxicity
from stocklens.llm.arrays import hash_spans, utf8, word_spans

ODD = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "word " * 20_000), (4, "é" * 50_000)]


def test_hashes_do_not_depend_on_their_place():
    texts = ["Ab cd", "", "xx ab  CD", "y" * 600_000, "ab"]
    data, places = utf8(pa.array(texts))
    starts, ends, counts = word_spans(data, places)
    assert counts.tolist() == [2, 0, 3, 1, 1]
    hashes = hash_spans(data, starts, ends)
    assert hashes[0] == hashes[3] == hashes[6] and hashes[1] == hashes[4]
    assert len(set(hashes.tolist())) == 4


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_borders_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randrange(1, 15) for _ in range(30)]
        histogram = {n: lengths.count(n) for n in lengths}
        for k in (1, 2, 3):
            edges = packing.borders(histogram, k)
            distinct = sorted(histogram)
            every = itertools.combinations(distinct[:-1], min(k, len(distinct)) - 1)
            assert len(edges) <= k
            assert padding(lengths, edges) == min(padding(lengths, [*some, distinct[-1]]) for some in every)
    assert packing.borders({}, 4) == []


def test_every_token_is_packed_once(spark, small, documents):
    rows = packing.packed(small, max_tokens=100, buckets=4, budget=300).collect()
    expected = {r.doc_id: len((r.text or "").split()) + 1 for r in small.collect()}
    got, batches = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
        assert r.n_tokens <= r.bucket <= 100
    for doc, parts in got.items():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] == expected[doc]
    assert set(got) == set(expected)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(300 // bucket, 1)
        if (bucket, batch + 1) in batches:
            assert len(slots) == max(300 // bucket, 1)
    assert sorted(r.n_tokens for r in packing.packed(documents(ODD), max_tokens=15_000).collect()) == [1, 1, 1, 1, 2, 5001, 15_000]
    assert packing.packed(documents([])).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\\e<|", "\\b\\", "", None, "é\n<<SYS>>", "[INST"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(None, None, None, "x"), (2, 0, "assistant", "y")]
    table = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, ids string")
    formatted = chat.formatted(table)
    codec = chat.Codec.of(chat.read_ranks(spark, chat.RANKS))
    for r in formatted.collect():
        assert sum(i >= codec.reserved for i in r.ids) == 3 + r.first
        assert len(r.mask) == len(r.ids)
    for text in odd:
        escaped = chat.escape(text or "")
        assert chat.unescape(escaped) == (text or "")
        assert not any(c in escaped for c in (*chat.RESERVED, "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert found[1].loss_chars == sum(len(t or "") for t in odd[1::2])
    assert {c: r.n_turns for c, r in found.items()} == {1: 7, 2: 1, None: 1}
    assert chat.read_back(chat.formatted(table.limit(0))).count() == 0


def test_seating_of_many_customers():
    rng = np.random.default_rng(1)
    tables = pitman_yor.seat(np.full(2000, 50), np.full(2000, 1.0), 0.0, rng)
    # A Chinese restaurant of strength 1 has as many tables as the harmonic number says.
    assert abs(tables.mean() - sum(1 / i for i in range(1, 51))) < 0.2
    assert pitman_yor.seat(np.array([0, 1, 10**7]), np.ones(3), 0.5, rng).tolist()[:2] == [0, 1]


def test_byte_model_is_a_distribution():
    words = ["the", "then", "a", "été"]
    data, starts, ends = pitman_yor.spans_of(pa.array(words))
    context, symbol, word = pitman_yor.contexts(data, starts, ends)
    dishes, customers = np.unique(context * pitman_yor.SYMBOLS + symbol, return_counts=True)
    model = pitman_yor.Restaurants(dishes, customers, np.random.default_rng(1))
    for _ in range(3):
        model.sweep()
        for level in model.predictive():
            assert np.allclose(level.sum(axis=1), 1, atol=1e-4)
    assert np.bincount(word).tolist() == [4, 5, 2, 6]


def test_scores_of_odd_rows(spark, documents):
    docs = documents([*ODD, (7, "a b a"), (8, "A b")])
    learned = docs.selectExpr("*", "doc_id = 7 AS learned")
    rows = pitman_yor.score(learned).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 1, 1, 2, 3, 4, 20_001]
    assert {r.train_tokens for r in rows} == {4}
    assert {r.n_known for r in rows if r.doc_id == 8} == {3}
    assert all(r.score < 0 for r in rows)
    assert len(pitman_yor.score(docs.selectExpr("*", "false AS learned")).collect()) == len(rows)
    assert pitman_yor.score(learned.limit(0)).count() == 0


def test_context_classes_come_from_all_learned_texts(spark):
    # One text is long, and the frequent words of the last ones are in no others.
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "Cat"], k=4)) for _ in range(2100)] + ["dog Bird " * 3000, "dog " * 9000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    keys, times = pitman_yor.frequent_words(docs)
    near = pitman_yor.neighbours(docs, keys)
    words = ["the", "of", "cat", "dog", "bird"]
    data, starts, ends = pitman_yor.spans_of(pa.array(words))
    place = dict(zip(words, np.searchsorted(keys, hash_spans(data, starts, ends).view(np.int64)).tolist(), strict=True))
    lower = [t.lower().split() for t in texts]
    assert {w: int(times[place[w]]) for w in words} == {w: sum(t.count(w) for t in lower) for w in words}
    expected = np.zeros((5, 5))
    for t in lower:
        for gap in (1, 2):
            for one, other in zip(t[gap:], t, strict=False):
                expected[place[one], place[other]] += 1
    assert (near == expected).all() and len(keys) == 5


def test_words_are_told_by_the_word_in_front(spark, documents):
    # Each word has one that follows it; which words there are and how often does not tell the two last texts apart.
    rng = random.Random(4)
    following = {i: (i * 7 + 3) % 41 for i in range(41)}

    def walk(at, n=30):
        words = [at]
        while len(words) < n:
            words.append(following[words[-1]])
        return words

    texts = [" ".join(f"w{i}" for i in walk(rng.randrange(41))) for _ in range(150)]
    held = walk(5)
    texts += [" ".join(f"w{i}" for i in held), " ".join(f"w{i}" for i in rng.sample(held, len(held)))]
    rows = pitman_yor.score(documents(list(enumerate(texts))).selectExpr("*", "doc_id < 150 AS learned")).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[150] - scores[151] > 20


def test_words_in_front_are_counted_in_all_learned_texts(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["the", "of", "cat", "dog"] + [f"rare{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, [60, 40, 20, 10] + [1] * 300, k=rng.randrange(40))) for _ in range(300)]
    rows = [(i, i, t, i % 5 > 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, mark bigint, text string, learned boolean").repartition(3)
    monkeypatch.setattr(pitman_yor, "CLASSED_WORDS", 4)
    learned = [t for _, _, t, known in rows if known]
    frequent, times = pitman_yor.frequent_words(docs.where("learned"))
    classes = pitman_yor.Classes.of(frequent, times, np.ones((4, 4)), 1)
    tokens = pitman_yor.Tokens(pa.array(learned), classes)
    pairs = collections.Counter(zip(tokens.before.tolist(), tokens.context.tolist(), tokens.keys.tolist(), strict=True))
    contexts = collections.Counter((key, u) for _, u, key in pairs)
    for parts in (1, 5):
        found = pitman_yor.followed(docs, spark.sparkContext.broadcast(classes), parts)
        assert {(r.key, r.context): r.n for r in found.where("context >= 0").collect()} == contexts
        leaves = pitman_yor.Leaves.of(found)
        ends = [*frequent.tolist(), int(tokens.keys[-1])]
        for place, before in enumerate(ends):
            for u in range(pitman_yor.CLASSES):
                own = [n for (b, v, _), n in pairs.items() if (b, v) == (before, u)]
                at = place * pitman_yor.CLASSES + u
                assert (leaves.customers[at], leaves.tables[at]) == (sum(own), len(own))
        once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
        assert leaves.discount == once / (once + 2 * twice)


def test_formats_are_inferred():
    rng = random.Random(1)
    values = {"access": ["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(100)]}
    words = ["".join(rng.choices(["the", "er", "ing", "tion", "re", "an"], k=7)) for _ in range(300)]
    formats = credentials.infer(values, words)
    assert len(formats.automata) == 1 and len(formats.automata[0][0].states) < 20
    new = ["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(50)]
    assert sum(formats.scored(v) > 0 for v in new) >= 45
    assert not any(formats.scored("".join(rng.choices(["the", "er", "tion"], k=7))) > 0 for _ in range(100))


def test_credentials_among_ordinary_words_do_not_shut_out_their_format():
    rng = random.Random(2)
    new = lambda: "".join(rng.choices("0123456789abcdef", k=32))
    words = ["".join(rng.choices(["the", "er", "ing", "tion", "re", "an"], k=7)) for _ in range(300)]
    hidden = [new() for _ in range(4)]
    formats = credentials.infer({"hex": [new() for _ in range(100)]}, words + hidden)
    assert sum(formats.scored(v) > 0 for v in hidden) >= 3 and not any(formats.scored(w) > 0 for w in words)
    with pytest.warns(UserWarning, match="no format for 'assign'"):
        assert not credentials.infer({"assign": words[:100]}, words).automata


def test_secret_spans_of_odd_rows(documents):
    rows = [(9, "é token = \"abcdef123\" token: token: abcdef AKIA" + "Q" * 16 + " " + "0af" * 8)]
    found = credentials.secrets(documents([*ODD, *rows])).collect()
    spans = {r.doc_id: credentials.joined([(s.kind, s.start, s.end) for s in r.spans]) for r in found}
    assert spans[9] == "assign:2:20,access:43:63,hex:64:88"
    assert all(not s for doc, s in spans.items() if doc != 9) and len(found) == len(ODD) + 1
    assert credentials.secrets(documents([])).count() == 0


def test_formats_find_short_dotted_and_long_strings(documents):
    rng = random.Random(4)
    new = lambda n: "".join(rng.choices("bcdfghkmpqrvwxz23456789", k=n))
    prose = lambda: " ".join(rng.choice(["nothing", "another", "letters", "reasons", "station", "however"]) for _ in range(60))
    rows = [(i, f"{prose()} token: {new(rng.randrange(8, 30))}.{new(rng.randrange(3, 30))} {prose()}") for i in range(60)]
    hidden = {100: f"{new(4)}.{new(4)}", 101: f"{new(20)}.{new(30)}.{new(20)}", 102: f"{new(150)}.{new(150)}", 103: new(9)}
    rows += [(i, f"{prose()} {value}. {prose()}") for i, value in hidden.items()] + [(200, prose())]
    text = dict(rows)
    for r in credentials.secrets(documents(rows)).collect():
        found = [text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "format"]
        assert found == ([hidden[r.doc_id]] if r.doc_id in hidden else [])


def test_lexicon_finds_disguised_words():
    bad = [f"some text with idiot and more {i}" for i in range(30)]
    good = [f"some text with nothing and more {i} trash can" for i in range(60)]
    model = toxicity.fit(bad, good, 1 / 3)
    automaton = model.automaton()
    plain = toxicity.hits(toxicity.fold("you idiot!"), automaton)
    assert plain > 0
    for hidden in ("you 1d10t!", "you іdіоt", "you IDIOT"):
        assert toxicity.hits(toxicity.fold(hidden), automaton) == plain
    assert toxicity.hits(toxicity.fold("idiotic? no: the trash can"), toxicity.Model({" trash ": 2.0}, np.zeros(3)).automaton()) == 0


def test_toxicity_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1)], "doc_id bigint, toxic int")
    rows = toxicity.detect(documents(ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.detect(documents([]), labels.limit(0)).count() == 0


def test_language_of_odd_rows(documents):
    docs = documents([*ODD, (8, "123 !?")])
    rows = language.identify(docs, docs.limit(0)).select("row.doc_id", "lang_pred", "rejected").collect()
    assert {r.lang_pred for r in rows} == {"und"} and all(r.rejected for r in rows)
    model = language.fit([("le chat est la", "fr"), ("the cat is there", "en")] * 10)
    told = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).select("row.doc_id", "lang_pred").collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= told
    assert {lang for doc, lang in told if doc in (None, 4)} <= {"fr", "en"}


def passages(texts, items, window):
    def words(text):
        return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").lower()).split()

    out = {}
    phrases = [(name, p) for name, t in items for w in [words(t)] for i in range(max(len(w) - window, 0) + 1) if (p := w[i : i + window])]
    for doc, text in texts:
        w, hit, names = words(text), set(), set()
        for name, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    names.add(str(name) if name is not None else "null")
        out[doc] = (len(w), sorted(hit), sorted(names))
    return out


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_passages_equal_brute_force(spark, documents, block_chars):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["ab", "Cd,", "e-f", "ü", "g"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 9]))) for i in range(12)] + [(None, "zz yy"), (3, None), (5, "zz yy")]
    docs = [(i, text(rng.randrange(60))) for i in range(20)] + [(50, None), (51, ""), (52, "x ZZ, yy zz yy")]
    docs.append((53, (text(30) + " ") * 300))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.marked(documents(docs), table, 4, block_chars).collect()
    expected = passages(docs, items, 4)
    for r in found:
        hit = [k for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for k in range(a, b)]
        assert (r.n_words, hit, r["items"]) == expected[r.row.doc_id]
    assert decontaminate.marked(documents(docs), table.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(documents([]), table).count() == 0


def test_passages_are_cut(spark, documents):
    items = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    docs = documents([(1, "One, two -- Three! four"), (2, None), (3, "two"), (None, "two three")])
    found = decontaminate.without_passages(docs, items)
    assert found.columns == docs.columns
    assert {(r.doc_id, r.text) for r in found.collect()} == {(1, "One, ! four"), (2, None), (3, "two"), (None, "")}


def test_quality_of_odd_rows(documents):
    words = "these are some words of a clean text that nobody should ever reject since it has no flaw at all"
    rows = quality_rules.quality(documents([*ODD, (8, words + " and more"), (9, "% " * 40), (10, (words + "\n") * 3)])).collect()
    kept = {(r.doc_id, r.kept, r.n_repeat_words) for r in rows}
    assert (8, True, 0) in kept and (9, False, 40) in kept and (10, False, 60) in kept
    assert len(rows) == len(ODD) + 3 and quality_rules.quality(documents([])).count() == 0
