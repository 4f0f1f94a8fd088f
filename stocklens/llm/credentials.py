"""Secrets in texts: fixed patterns, and formats inferred from what the patterns find."""

from __future__ import annotations

import hashlib
import math
import re
import warnings
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.shared import discard, prepare, written

# The patterns, in the order of their kinds, and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED = 6
KINDS = ("assign", "access", "hex", "format")
# Texts without any of these words in lower case have no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Strings that could be credentials of an inferred format: of the symbols and the least length that a labelled value has.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{ASSIGNED},}}")
SAMPLE_VALUES = 400
LONGEST = 200  # of longer credentials the beginning is learned, without an end
CONFIDENCE = 0.01
# Strings apart from the patterns are ordinary ones, but so many of them, as a share or at least in number, can be
# credentials themselves: a format's least score is not put above those.
SECRET_SHARE = 0.001
SECRET_STRINGS = 5
EDGE = "\n"  # the end of a string where symbols are counted
SHORT_STRING = 64  # scores of strings up to this length are remembered

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within each kind.

    A run of letters is only a match if it is long enough; for ``access`` and
    ``hex`` a run is taken whole, so the length can be part of the pattern.
    """
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def others(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Places of the strings apart from ``spans`` that could be credentials of an inferred format."""
    at = 0
    for begin, end in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, max(at, begin)):
            # Dots inside are part of a string, those behind it end a sentence.
            value = m[0].rstrip(".")
            if len(value) >= ASSIGNED:
                yield m.start(), m.start() + len(value)
        at = max(at, end)


def remembered(score: Callable[[str], float]) -> Callable[[str], float]:
    """The same function, which does not work out again what it has told of a frequent short string."""
    short = lru_cache(1 << 16)(score)
    return lambda value: short(value) if len(value) <= SHORT_STRING else score(value)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@dataclass
class State:
    """How many strings came by and ended here, and with which symbol how many went on, and where to."""

    passed: int = 0
    ended: int = 0
    went: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton from sample strings: a prefix tree whose compatible states are merged."""

    def __init__(self, values: list[str]):
        self.states = [State()]
        for value in values:
            at = 0
            for symbol in value[:LONGEST]:
                state = self.states[at]
                state.passed += 1
                state.went[symbol] = state.went.get(symbol, 0) + 1
                if symbol not in state.to:
                    state.to[symbol] = len(self.states)
                    self.states.append(State())
                at = state.to[symbol]
            self.states[at].passed += 1
            self.states[at].ended += len(value) <= LONGEST
        self._merge()

    def _near(self, times_a: int, all_a: int, times_b: int, all_b: int) -> bool:
        """Whether two shares can be of one probability (Hoeffding bound)."""
        bound = math.sqrt(0.5 * math.log(2 / CONFIDENCE)) * (1 / math.sqrt(all_a) + 1 / math.sqrt(all_b))
        return abs(times_a / all_a - times_b / all_b) < bound

    def _compatible(self, a: int, b: int) -> bool:
        work = [(a, b)]
        seen = set()
        while work:
            pair = work.pop()
            if pair in seen:
                continue
            seen.add(pair)
            x, y = self.states[pair[0]], self.states[pair[1]]
            if not self._near(x.ended, x.passed, y.ended, y.passed):
                return False
            for symbol in {*x.went, *y.went}:
                if not self._near(x.went.get(symbol, 0), x.passed, y.went.get(symbol, 0), y.passed):
                    return False
                if symbol in x.to and symbol in y.to:
                    work.append((x.to[symbol], y.to[symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        work = [(a, b)]
        while work:
            into, tree = work.pop()
            x, y = self.states[into], self.states[tree]
            x.passed += y.passed
            x.ended += y.ended
            for symbol, times in y.went.items():
                x.went[symbol] = x.went.get(symbol, 0) + times
                if symbol in x.to:
                    work.append((x.to[symbol], y.to[symbol]))
                else:
                    x.to[symbol] = y.to[symbol]

    def _merge(self) -> None:
        """Red-blue order: settled states in turn, each neighbour merged into the first one it fits or settled too."""
        red = [0]
        settled = {0}
        frontier = deque((0, s) for s in sorted(self.states[0].to))
        while frontier:
            source, symbol = frontier.popleft()
            blue = self.states[source].to.get(symbol)
            if blue is None or blue in settled:
                continue
            fits = next((r for r in red if self._compatible(r, blue)), None)
            if fits is None:
                red.append(blue)
                settled.add(blue)
                frontier.extend((blue, s) for s in sorted(self.states[blue].to))
            else:
                self.states[source].to[symbol] = fits
                self._fold(fits, blue)
                # Folding can give settled states new neighbours.
                frontier.extend((r, s) for r in red for s in sorted(self.states[r].to) if self.states[r].to[s] not in settled)
        place = {old: new for new, old in enumerate(red)}
        self.states = [self.states[r] for r in red]
        for state in self.states:
            state.to = {s: place[t] for s, t in state.to.items()}
        # What a symbol that a state has not seen falls back on: its share in all states, and where it mostly leads.
        self.shares: Counter = Counter()
        usual: dict[str, Counter] = {}
        for state in self.states:
            self.shares.update(state.went)
            for symbol, target in state.to.items():
                usual.setdefault(symbol, Counter())[target] += state.went[symbol]
        self.usual = {symbol: max(targets, key=lambda t: (targets[t], -t)) for symbol, targets in usual.items()}
        self.symbols = sum(self.shares.values())

    def log_likelihood(self, value: str) -> float:
        """Natural logarithm of the probability of the string; a state's own shares are smoothed by those of all."""
        total, at = 0.0, 0
        for symbol in value:
            state = self.states[at]
            share = (self.shares[symbol] + 0.01) / (self.symbols + 1.0)
            total += math.log((state.went.get(symbol, 0) + share) / (state.passed + 1.0))
            at = state.to.get(symbol, self.usual.get(symbol, at))
        state = self.states[at]
        return total + math.log((state.ended + 0.01) / (state.passed + 1.0))


def sort_of(value: str) -> str:
    """Words and numbers are told apart, since a number has nothing but symbols that are rare in words."""
    return "a" if any(c.isalpha() for c in value) else "0"


class Ordinary:
    """How likely a string is as an ordinary one, from the symbols of words and those of numbers (:func:`symbol_counts`).

    Symbols count by themselves: were their order learned, the few credentials
    among the strings would soon be the measure of what is ordinary.
    """

    def __init__(self, counts: dict[str, int]):
        totals, strings = Counter(), Counter()
        for key, times in counts.items():
            totals[key[0]] += times
            strings[key[0]] += times if key[1] == EDGE else 0
        self.sorts = {s: math.log((strings[s] + 1) / (strings.total() + 2)) for s in "a0"}
        self.other = {s: math.log(1 / (totals[s] + 100)) for s in "a0"}
        self.symbols = {key: math.log((times + 1) / (totals[key[0]] + 100)) for key, times in counts.items()}

    def log_likelihood(self, value: str) -> float:
        """Natural logarithm of the probability of the string."""
        sort = sort_of(value)
        symbols, other = self.symbols, self.other[sort]
        return self.sorts[sort] + symbols.get(sort + EDGE, other) + sum(symbols.get(sort + c, other) for c in value)


@dataclass
class Format:
    """An automaton of a kind and the gains of credentials that it has not learned, in order."""

    kind: str
    automaton: Automaton
    gains: list[float]

    def gain(self, value: str, plain: float) -> float:
        """How much likelier the string is as a credential than as an ordinary one (``plain``), per symbol."""
        return (self.automaton.log_likelihood(value) - plain) / len(value)


@dataclass
class Formats:
    """Automata with the score from which a string counts, and how likely ordinary strings are."""

    automata: list[tuple[Automaton, float]]
    ordinary: Ordinary

    def scored(self, value: str) -> float:
        """The greatest gain over an ordinary word, per symbol, among the formats that accept it; or minus infinity."""
        best, plain = -math.inf, self.ordinary.log_likelihood(value)
        for automaton, least in self.automata:
            gain = (automaton.log_likelihood(value) - plain) / len(value)
            if gain >= least:
                best = max(best, gain)
        return best


def symbol_counts(words: dict[str, int]) -> Counter:
    """How often words and numbers have each symbol, and end, in the strings, which occur so many times."""
    counts: Counter = Counter()
    for word, times in words.items():
        sort = sort_of(word)
        for symbol in [*word, EDGE]:
            counts[sort + symbol] += times
    return counts


def learned(values: dict[str, list[str]], ordinary: Ordinary) -> list[Format]:
    """An automaton for each kind from three quarters of its values; the others tell what gains to expect."""
    found = []
    for kind in sorted(values):
        own = sorted(set(values[kind]))
        if len(own) >= 5:
            one = Format(kind, Automaton([v for i, v in enumerate(own) if i % 4]), [])
            one.gains = sorted(one.gain(v, ordinary.log_likelihood(v)) for v in own[::4])
            found.append(one)
    return found


def steps(found: list[Format], ordinary: Ordinary) -> Callable[[str], tuple[int, ...]]:
    """The gain of a string by each format in whole hundredths, rounded up."""

    def of(value: str) -> tuple[int, ...]:
        plain = ordinary.log_likelihood(value)
        return tuple(math.ceil(100 * one.gain(value, plain)) for one in found)

    return of


def limited(found: list[Format], ordinary: Ordinary, background: list[dict[int, int]]) -> Formats:
    """The formats with their least scores; ``background`` counts the gains of ordinary strings by each format.

    Each format's least score keeps 99 of 100 credentials that its automaton has
    not learned, is above the ordinary strings but for those that may be
    credentials themselves, and asks for a gain at all. A format whose typical
    values do not reach it looks like ordinary strings; it is left out with a warning.
    """
    formats = Formats([], ordinary)
    for one, counts in zip(found, background, strict=True):
        left = max(SECRET_STRINGS, int(SECRET_SHARE * sum(counts.values())))
        false = -math.inf
        for step in sorted(counts, reverse=True):
            left -= counts[step]
            if left < 0:
                false = step / 100
                break
        least = max(one.gains[len(one.gains) // 100], false, 0.2)
        usual = one.gains[len(one.gains) // 2]
        if least <= usual:
            formats.automata.append((one.automaton, least))
        else:
            warnings.warn(
                f"no format for {one.kind!r} credentials: half of them gain {usual:.2f} at most, {least:.2f} is asked for",
                stacklevel=2,
            )
    return formats


def infer(values: dict[str, list[str]], words: list[str]) -> Formats:
    """Formats of the labelled credentials (by kind), told from ordinary ``words``; see :func:`limited`."""
    ordinary = Ordinary(symbol_counts(Counter(words)))
    found = learned(values, ordinary)
    of = steps(found, ordinary)
    gains = [of(w) for w in words]
    return limited(found, ordinary, [Counter(g[i] for g in gains) for i in range(len(found))])


def labelled(docs: DataFrame) -> tuple[dict[str, list[str]], dict[str, int]]:
    """A bounded sample of distinct credentials by kind, in the order of a hash, and the symbols of all other strings."""

    def run(batches):
        for batch in batches:
            values, words = set(), Counter()
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                for kind, start, end in spans:
                    value = ASSIGN.match(text[start:end])[2] if kind == "assign" else text[start:end]
                    values.add((kind, value[: LONGEST + 1]))
                words.update(text[a:b] for a, b in others(text, spans))
            rows = [(k, v, 0) for k, v in values] + [("symbol", c, n) for c, n in symbol_counts(words).items()]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "value", "times"])

    found = docs.select(F.col("text").cast("string").alias("text"))
    found = found.mapInArrow(run, "kind string, value string, times bigint")
    found = written(found.groupBy("kind", "value").agg(F.sum("times").alias("times")), "credentials")
    out: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_VALUES)
        out[kind] = [r.value for r in rows.select("value").collect()]
    symbols = {r.value: r.times for r in found.where("kind = 'symbol'").collect()}
    discard(found)
    return out, symbols


def background(docs: DataFrame, found: list[Format], ordinary: Ordinary) -> list[dict[int, int]]:
    """For each format how many of the strings apart from the patterns have which gain, over all rows."""
    sent = docs.sparkSession.sparkContext.broadcast((found, ordinary))

    def run(batches):
        of = remembered(steps(*sent.value))
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                text = text or ""
                for a, b in others(text, base_spans(text)):
                    counts.update(enumerate(of(text[a:b])))
            which, step = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (which, step, list(counts.values()))], names=["format", "step", "times"]
            )

    out: list[dict[int, int]] = [{} for _ in found]
    if found:
        rows = docs.select(F.col("text").cast("string").alias("text"))
        rows = rows.mapInArrow(run, "format bigint, step bigint, times bigint")
        for r in rows.groupBy("format", "step").agg(F.sum("times").alias("times")).collect():
            out[r["format"]][r.step] = r.times
    return out


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """``doc_id``, ``spans`` (kind, start, end; by start, then kind) of each row of ``docs`` (``doc_id``, ``text``).

    All spans of the fixed patterns, and as ``format`` every candidate string
    apart from them that a format accepts. Places are characters, the end is
    exclusive. Null and empty texts have no spans; rows are scanned one by one.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(formats)

    def run(batches):
        known = sent.value
        scored = remembered(known.scored)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                if known.automata:
                    spans += [("format", a, b) for a, b in others(text, spans) if scored(text[a:b]) > 0]
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(None).cast(kind).alias("spans")).schema)


def secrets(docs: DataFrame) -> DataFrame:
    """:func:`scan` of ``docs`` with formats inferred from a bounded sample of what the patterns find in it.

    What they are told from, symbols and gains of the strings apart from the
    patterns, is counted over all rows.
    """
    prepare(docs.sparkSession)
    values, symbols = labelled(docs)
    ordinary = Ordinary(symbols)
    found = learned(values, ordinary)
    return scan(docs, limited(found, ordinary, background(docs, found, ordinary)))


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(ordered(spans)).encode()).hexdigest()
