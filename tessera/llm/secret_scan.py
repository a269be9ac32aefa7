"""Secrets by pattern, and by formats inferred from the credentials that patterns find.

Three patterns give the base spans.  The values they find are labelled credentials; for each kind
a prefix tree over character classes is built and states with statistically compatible futures are
merged into a probabilistic automaton.  Merging has two phases.  States of equal depth come first,
from the root down: their visits add up, and a state knows its position.  States of different
depths are merged afterwards, and only on evidence: both were visited ``VISITS`` times, and ends,
classes and the mean length of what remains agree, in all states reachable alike (Hoeffding bound,
recursively).  So a format of fixed length keeps it, one of many lengths becomes a loop.

Every other run of token characters is a candidate, of any length: what remains of a run beside a
base span too.  It is added as a span of kind "format" if some automaton makes it ``ODDS`` times
likelier than a character model of ordinary runs, its end included.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, slices

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run begins at its first digit, so shorter ones need no match
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Labelled values of each kind, and ordinary runs, that the models are fitted on: those whose hashes are lowest.
LABELLED, ORDINARY = 500, 5_000
#: Characters of one kind's values at most; a value that doesn't fit beside those before it is left out of the fit.
LETTERS = 100_000
ALPHA, VISITS, DEVIATIONS = 0.01, 20, 3.3
#: How many times likelier than an ordinary run a run must be under a format.
ODDS = 1e9
_FLOOR = 1e-4


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the base patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of each run of token characters, without what base spans cover of it."""
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        k = at
        while k < len(base) and base[k][0] < end:
            if start < base[k][0]:
                yield start, base[k][0]
            start = max(start, base[k][2])
            k += 1
        if start < end:
            yield start, end


def _runs(text: str, base: list[tuple[int, int, int, str]]) -> set[str]:
    return {text[s:e] for s, e in candidates(text, base)} if base else set(_RUN.findall(text))


_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
_CLASS_OF = {c: k for k, chars in enumerate(_CLASSES) for c in chars}


@dataclass
class _State:
    """Visits, how many of them end here, where each class leads, characters seen on the way out,
    and the sums of the lengths that remain and of their squares."""

    n: int = 0
    ends: int = 0
    to: dict[int, int] = field(default_factory=dict)
    seen: Counter = field(default_factory=Counter)
    chars: Counter = field(default_factory=Counter)
    left: int = 0
    left2: int = 0

    def add(self, other: _State) -> None:
        self.n, self.ends, self.left, self.left2 = self.n + other.n, self.ends + other.ends, self.left + other.left, self.left2 + other.left2
        self.seen.update(other.seen)
        self.chars.update(other.chars)


class Automaton:
    """A probabilistic automaton inferred from strings by state merging."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.states = [_State()]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for v in values:
            at = 0
            for i, c in enumerate(v):
                k = _CLASS_OF[c]
                s = self.states[at]
                self._visit(s, len(v) - i)
                s.seen[k] += 1
                s.chars[c] += 1
                if k not in s.to:
                    s.to[k] = len(self.states)
                    self.states.append(_State())
                at = s.to[k]
            self._visit(self.states[at], 0)
            self.states[at].ends += 1
        self._merge_depths()
        self._merge_futures()

    @staticmethod
    def _visit(s: _State, left: int) -> None:
        s.n, s.left, s.left2 = s.n + 1, s.left + left, s.left2 + left * left

    def _differ(self, s: _State, t: _State) -> bool:
        """Whether ends or classes differ by more than chance allows."""
        bound = self._bound * (1 / math.sqrt(s.n) + 1 / math.sqrt(t.n))
        return abs(s.ends / s.n - t.ends / t.n) >= bound or any(abs(s.seen[k] / s.n - t.seen[k] / t.n) >= bound for k in s.seen.keys() | t.seen.keys())

    @staticmethod
    def _lengths_differ(s: _State, t: _State) -> bool:
        a, b = s.left / s.n, t.left / t.n
        spread = max(0.0, s.left2 / s.n - a * a) / s.n + max(0.0, t.left2 / t.n - b * b) / t.n
        return abs(a - b) > DEVIATIONS * math.sqrt(spread) + 1e-9

    # -- states of one depth --------------------------------------------------------------------

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            s, t = (self.states[x] for x in todo.pop())
            if self._differ(s, t):
                return False
            todo += [(s.to[k], t.to[k]) for k in s.to.keys() & t.to.keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to that under ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            s, t = self.states[a], self.states[b]
            s.add(t)
            for k, child in t.to.items():
                if k in s.to:
                    todo.append((s.to[k], child))
                else:
                    s.to[k] = child

    def _merge_depths(self) -> None:
        layer = [0]
        while layer:
            edges = sorted(((a, k) for a in layer for k in self.states[a].to), key=lambda e: (-self.states[self.states[e[0]].to[e[1]]].n, e))
            layer = []
            for a, k in edges:
                b = self.states[a].to[k]
                match = next((r for r in layer if self._alike(r, b)), None)
                if match is None:
                    layer.append(b)
                else:
                    self._fold(match, b)
                    self.states[a].to[k] = match

    # -- states of different depths -------------------------------------------------------------

    def _find(self, a: int) -> int:
        while self._into[a] != a:
            self._into[a] = a = self._into[self._into[a]]
        return a

    def _next(self, a: int) -> dict[int, int]:
        return {k: self._find(x) for k, x in self.states[a].to.items()}

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if a == b or pair in seen:
                continue
            seen.add(pair)
            s, t = self.states[a], self.states[b]
            if min(s.n, t.n) >= VISITS and (self._lengths_differ(s, t) or self._differ(s, t)):
                return False
            x, y = self._next(a), self._next(b)
            todo += [(x[k], y[k]) for k in x.keys() & y.keys()]
        return True

    def _unite(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b:
                continue
            a, b = min(a, b), max(a, b)
            self._into[b] = a
            s, t = self.states[a], self.states[b]
            s.add(t)
            for k, child in t.to.items():
                if k in s.to:
                    todo.append((s.to[k], child))
                else:
                    s.to[k] = child

    def _merge_futures(self) -> None:
        self._into = list(range(len(self.states)))
        kept, todo, at = [], [0], 0
        while at < len(todo):
            b = todo[at]
            at += 1
            if self._find(b) != b or b in kept:
                continue
            enough = self.states[b].n >= VISITS
            match = next((r for r in kept if enough and self._find(r) == r and self.states[r].n >= VISITS and self._compatible(r, b)), None)
            if match is None:
                kept.append(b)
                todo += [x for _, x in sorted(self._next(b).items())]
            else:
                self._unite(match, b)
                todo += [x for _, x in sorted(self._next(self._find(match)).items())]
        number = {a: i for i, a in enumerate(dict.fromkeys(map(self._find, [0, *todo])))}
        for a in list(number):  # and what is only reached through states that were merged
            stack = [a]
            while stack:
                for x in self._next(stack.pop()).values():
                    if x not in number:
                        number[x] = len(number)
                        stack.append(x)
        for a in number:
            self.states[a].to = {k: number[x] for k, x in sorted(self._next(a).items())}
        self.states = [self.states[a] for a in number]

    def score(self, value: str, least: float = -math.inf) -> float:
        """Log-likelihood of the characters and of the end after them; minus infinity if below ``least``.

        A class that a state never saw is very unlikely, and the most usual one is taken to its place.
        """
        at, total = 0, 0.0
        for c in value:
            if total < least:
                return -math.inf
            s, k = self.states[at], _CLASS_OF[c]
            m, size = s.seen[k], len(_CLASSES[k])
            if m:
                total += math.log(m / s.n * (s.chars[c] + 1) / (m + size))
                at = s.to[k]
            else:
                total += math.log(_FLOOR / size)
                at = s.to[max(s.to, key=lambda x: (s.seen[x], -x))] if s.to else at
        s = self.states[at]
        total += math.log(max(_FLOOR, s.ends / s.n if s.n else 0.0))
        return total if total >= least else -math.inf


    def most(self, c: str) -> float:
        """The highest log-likelihood that any state gives to the character."""
        k = _CLASS_OF[c]
        size = len(_CLASSES[k])
        return max(math.log(s.seen[k] / s.n * (s.chars[c] + 1) / (s.seen[k] + size)) if s.seen[k] else math.log(_FLOOR / size) for s in self.states)


class Ordinary:
    """Character pairs of ordinary runs, start and end included; every run weighs the same.

    A pair that is rare backs off to its second character and to the pair of their classes.
    """

    def __init__(self, runs: list[str]) -> None:
        signs, sort = ["", *_CLASS_OF], {"": -1} | _CLASS_OF
        size = {-1: 1} | {k: len(chars) for k, chars in enumerate(_CLASSES)}
        pairs, classes, before, one = (defaultdict(float) for _ in range(4))
        for v in runs:
            for pair in pairwise(["", *v, ""]):
                pairs[pair] += 8 / (len(v) + 1)
        for (a, b), n in pairs.items():
            before[a] += n
            one[b] += n
            classes[sort[a], sort[b]] += n
        whole = sum(one.values())
        total = {k: sum(classes[k, x] + 1 for x in size) for k in size}
        self.logs = {}
        for a in signs:
            for b in signs:
                single = (one[b] + 0.5) / (whole + 0.5 * len(signs))
                rare = (single + (classes[sort[a], sort[b]] + 1) / total[sort[a]] / size[sort[b]]) / 2
                self.logs[a, b] = math.log((pairs.get((a, b), 0.0) + 4 * rare) / (before[a] + 4))

    def score(self, value: str) -> float:
        return sum(map(self.logs.__getitem__, pairwise(["", *value, ""])))


class Formats:
    """Automata of the labelled kinds and a model of ordinary runs."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]) -> None:
        self.plain = Ordinary(ordinary)
        self.kinds = [Automaton(values) for values in labelled.values() if values]
        # what a character after another one can gain at most, in any state; code 0 is the start
        self._code = np.zeros(256, np.uint8)
        signs = ["", *_CLASS_OF]
        for i, c in enumerate(signs[1:], 1):
            self._code[ord(c)] = i
        best = [max((a.most(c) for a in self.kinds), default=-math.inf) if c else 0.0 for c in signs]
        logs = np.array([[self.plain.logs[a, b] for b in signs] for a in signs])
        self._most = np.array(best)[None, :] - logs

    def likely(self, value: str) -> bool:
        least = self.plain.score(value) + math.log(ODDS)
        return any(a.score(value, least) >= least for a in self.kinds)

    def hits(self, runs: set[str]) -> set[str]:
        """The likely ones of many runs.  Nearly all others are ruled out by what they can gain at most."""
        if not runs or not self.kinds:
            return set()
        values = list(runs)
        codes = self._code[np.frombuffer("".join(values).encode(), np.uint8)]
        ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
        starts = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[0], codes[:-1]])
        before[starts] = 0
        most = np.add.reduceat(self._most[before, codes], starts) + self._most[codes[ends - 1], 0]
        return {values[i] for i in np.flatnonzero(most >= math.log(ODDS) - 1e-6) if self.likely(values[i])}

    def all_spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """``(start, kind number, end)`` of all spans of each text, base and added, in order."""
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        runs = [_runs(t, base) for t, base in zip(texts, bases, strict=True)]
        hits, out = self.hits(set().union(*runs)), []
        for t, base, mine in zip(texts, bases, runs, strict=True):
            found = [(s, k, e) for s, k, e, _ in base]
            if not hits.isdisjoint(mine):
                found = sorted(found + [(s, 3, e) for s, e in candidates(t, base) if t[s:e] in hits])
            out.append(found)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return self.all_spans([text])[0]


class _Lowest:
    """The ``n`` values of lowest hash among those offered."""

    def __init__(self, n: int) -> None:
        self.n, self.ranks, self.bar = n, {}, 1 << 64

    def offer(self, value: str) -> None:
        if value not in self.ranks and (rank := xxhash.xxh64_intdigest(value)) < self.bar:
            self.ranks[value] = rank
            if len(self.ranks) >= 2 * self.n + 1_000:
                self.ranks = dict(sorted(self.ranks.items(), key=lambda x: (x[1], x[0]))[: self.n])
                self.bar = max(self.ranks.values())

    def rows(self, kind: str) -> list[tuple[str, str, int]]:
        return [(kind, v, r - (1 << 63)) for v, r in sorted(self.ranks.items(), key=lambda x: (x[1], x[0]))[: self.n]]


def train(docs: DataFrame, text: str = "text") -> Formats:
    """Infer formats from the credentials in all documents.

    Every text is scanned whole.  Of the distinct labelled values the ``LABELLED`` of each kind and
    of ordinary runs the ``ORDINARY`` with the smallest hash are used, as far as ``LETTERS`` allows;
    each task keeps no more than that.  Null and empty texts teach nothing; without labelled values
    there are no formats.
    """
    sizes = dict.fromkeys(KINDS[:3], LABELLED) | {"ordinary": ORDINARY}

    def run(batches):
        lowest = {k: _Lowest(n) for k, n in sizes.items()}
        for b in slices(batches):
            ordinary: set[str] = set()
            for t in b.column(0).to_pylist():
                base = base_spans(t or "")
                for _, k, _, v in base:
                    if len(v) <= LETTERS:
                        lowest[KINDS[k]].offer(v)
                ordinary |= _runs(t or "", base)
            for v in ordinary:
                if len(v) <= LETTERS:
                    lowest["ordinary"].offer(v)
        rows = [r for k, x in lowest.items() for r in x.rows(k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "value", "rank"])

    found = docs.select(text).mapInArrow(run, "kind string, value string, rank long").distinct()
    found = Scratch(docs.sparkSession, "secrets").save(found, "labelled")

    def pick(kind: str) -> list[str]:
        out, room = [], LETTERS
        for r in found.where(F.col("kind") == kind).orderBy("rank", "value").limit(sizes[kind]).collect():
            if len(r.value) <= room:
                out.append(r.value)
                room -= len(r.value)
        return out

    return Formats({k: pick(k) for k in KINDS[:3]}, pick("ordinary"))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def annotate(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    A null text is empty; without any span ``spans`` is empty and ``base_sha256`` that of "".
    Texts of any length are scanned whole.  Repeated rows (and ids) stay, each with its own spans;
    a null id stays null; extra columns are ignored, whatever their names.  Without labelled values
    nothing is added; no rows give no rows.
    """
    model = formats or train(docs, text)

    def run(batches):
        for b in slices(batches):
            out = []
            for spans in model.all_spans(b.column(1).to_pylist()):
                base = [s for s in spans if s[1] < 3]
                n = Counter(k for _, k, _ in base)
                out.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    chosen = docs.select(F.col(id_col), F.col(text))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, formats: Formats | None = None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents, all of them, with every span replaced by ``mark``; overlapping spans are one.

    A null text stays null and an empty one empty; repeated rows and extra columns stay as they are.
    """
    model, at, names = formats or train(docs, text), docs.columns.index(text), docs.columns

    def clean(t: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return t
        out, end = [], 0
        for s, _, e in spans:
            if s >= end:
                out += [t[end:s], mark]
            end = max(end, e)
        return "".join([*out, t[end:]])

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            cleaned = pa.array(map(clean, texts, model.all_spans(texts)), pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if i == at else c for i, c in enumerate(b.columns)], names)

    return docs.mapInArrow(run, docs.schema)
