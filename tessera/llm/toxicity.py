"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a model of three orders: word pairs, words, and the first ``STEM``
letters of words, each with shared counts of both classes beside its own.  A term keeps the part
of its count in a class that exceeds a discount; what is discounted is the weight of the backoff,
which spreads it over the shared probabilities of that order, times what the lower order says of
the class:

    P(w | u, class) = kept(u, w) + backoff(u) * shared(w | u) * P(w | class) / shared(w)

and so on down to the stems.  So an expression that is rare in a class has its shared backoff
count, weighed by the class's backoff, and every term counts, seen once or often.  Counts are of
documents (a term's contexts), so one document's repeats weigh once.

The discount isn't one constant: it is the count that the shared counts lead one to expect, plus
``NOISE`` of its standard deviations, plus ``DISCOUNT``.  Under a constant discount the accidents
of rare words drown what tells the classes apart (the README has the figures of that form).

A text's score is the difference of its log-likelihoods, divided by its words, through a logistic
curve fitted on documents that had no part in the counts (two folds, each scored by the other).
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.scratch import Scratch, slices, unused

#: Labelled documents the models are fitted on at most: those whose id hashes lowest.
LABELLED = 20_000
NOISE, DISCOUNT, STEM = 3.0, 0.75, 4
THRESHOLD = 0.3
#: Orders: stems, words, pairs (whose context is the word before; the first word of a text has none).
ORDERS = (0, 1, 2)
#: Words whose evidence a worker remembers.
MEMO = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms(found: list[str]) -> set[tuple[int, str, str]]:
    """``(order, context, term)`` of a document's words, each once."""
    out = {(1, "", w) for w in found}
    out |= {(0, "", w[:STEM]) for w in found}
    return out | {(2, u, w) for u, w in pairwise(["", *found])}


class _Memo(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        if len(self) > MEMO:
            self.clear()
        found = self[key] = self.make(key)
        return found


class Model:
    """The evidence of stems, words and pairs, and the logistic curve (slope, intercept)."""

    def __init__(self, kept: dict[tuple[int, str, str], tuple[float, float, float]]) -> None:
        """``kept``: of each term that keeps something its shared probability and what the ordinary
        and the toxic class keep."""
        self.slope, self.intercept = 0.0, -30.0
        self.kept = kept
        self.backoff: dict[tuple[int, str], list[float]] = {}
        for (order, context, _), (_, *own) in kept.items():
            weights = self.backoff.setdefault((order, context), [1.0, 1.0])
            for y in (0, 1):
                weights[y] -= own[y]
        # what a context adds to any word, but for the pairs it keeps, and what those add beyond that
        self._after = {u: math.log(toxic / ordinary) for (order, u), (ordinary, toxic) in self.backoff.items() if order == 2}
        self._pairs = {}
        for order, u, w in kept:
            if order == 2:
                ordinary, toxic = self._ratio(2, u, w, self._classes(w))
                self._pairs[u, w] = math.log(toxic / ordinary) - self._alone(w) - self._after[u]
        self._set = frozenset(self._pairs)
        self._both = _Memo(lambda w: self._alone(w) + self._after.get(w, 0.0))

    def _ratio(self, order: int, context: str, term: str, lower: tuple[float, float]) -> tuple[float, float]:
        """P(term | context, class) over its shared probability, for both classes."""
        weights = self.backoff.get((order, context), (1.0, 1.0))
        shared, *own = self.kept.get((order, context, term), (1.0, 0.0, 0.0))
        return own[0] / shared + weights[0] * lower[0], own[1] / shared + weights[1] * lower[1]

    def _classes(self, w: str) -> tuple[float, float]:
        return self._ratio(1, "", w, self._ratio(0, "", w[:STEM], (1.0, 1.0)))

    def _alone(self, w: str) -> float:
        """Evidence of a word by itself."""
        ordinary, toxic = self._classes(w)
        return math.log(toxic / ordinary)

    def evidence(self, text: str | None) -> float:
        """Toxic less ordinary log-likelihood, a word."""
        found = words(text)
        if not found:
            return 0.0
        total = sum(map(self._both.__getitem__, found)) + self._after.get("", 0.0) - self._after.get(found[-1], 0.0)
        if not self._set.isdisjoint(pairwise(["", *found])):
            total += sum(self._pairs[p] for p in pairwise(["", *found]) if p in self._set)
        return total / len(found)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(min(700.0, -(self.slope * self.evidence(text) + self.intercept))))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit the curve by Newton steps with a little ridge; one class alone leaves its share."""
        if len(y) == 0:
            return
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.slope, self.intercept = 0.0, math.log(share / (1 - share))
        scale = x.std()
        if not 0 < y.sum() < len(y) or scale == 0:
            return
        z, beta = np.stack([x / scale, np.ones(len(x))], 1), np.array([0.0, self.intercept])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
            ridge = np.diag([1e-2, 1e-6])
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.intercept = float(beta[0] / scale), float(beta[1])


def learns(id_col: str):
    """Rows the model may learn labels from: crc32 of the id, as text, modulo 4 isn't 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


_COUNTS = ("a0", "a1", "b0", "b1")
#: The counts of the ordinary and of the toxic class in fold 0, fold 1 and both.
_MODELS = (("{0}a0", "{0}a1"), ("{0}b0", "{0}b1"), ("({0}a0 + {0}b0)", "({0}a1 + {0}b1)"))


def _excess(k: int) -> Column:
    """Shared probability of a term in its context and what each class keeps in model ``k``, in the
    columns ``_COUNTS`` of the term and the same of the context behind ``all_``."""
    counts, whole = ([F.expr(c.format(p)).cast("double") for c in _MODELS[k]] for p in ("", "all_"))
    shared = F.try_divide(counts[0] + counts[1], whole[0] + whole[1])
    own = []
    for c, n in zip(counts, whole, strict=True):
        expected = n * shared
        left = c - expected - NOISE * F.sqrt(expected) - DISCOUNT
        own.append(F.coalesce(F.greatest(F.try_divide(left, n), F.lit(0.0)), F.lit(0.0)))
    return F.struct(F.coalesce(shared, F.lit(0.0)).alias("shared"), own[0].alias("own0"), own[1].alias("own1"))


def _kept(counts: DataFrame) -> DataFrame:
    """``(ord, context, term, m0, m1, m2)`` of the terms of which some class keeps a part in some model.

    ``counts`` is a written table of all terms.  Stems and words have one context each, whose totals
    are two rows; the contexts of pairs are joined.
    """
    sums = [F.sum(c).alias(f"all_{c}") for c in _COUNTS]
    pairs, rest = counts.where("ord = 2"), counts.where("ord < 2")
    total = pairs.groupBy(F.col("context").alias("all_context")).agg(*sums)
    pairs = pairs.join(total.hint("merge"), pairs["context"] == total["all_context"])
    rest = rest.join(F.broadcast(rest.groupBy(F.col("ord").alias("all_ord")).agg(*sums)), F.col("ord") == F.col("all_ord"))
    chosen = [d.select("ord", "context", "term", *(_excess(k).alias(f"m{k}") for k in range(3))) for d in (pairs, rest)]
    return chosen[0].unionByName(chosen[1]).where(" OR ".join(f"m{k}.own{y} > 0" for k in range(3) for y in (0, 1)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on ``docs`` with ``labels(id, label)``; rows without id or label teach nothing, and a
    document with several labels is toxic if one of them is."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(learns(id_col))
    one = usable.groupBy(F.col(id_col).alias("l_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("l_id"), "l_id").limit(LABELLED)  # LABELLED rows of two numbers
    texts = docs.select(F.col(id_col).alias("l_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "l_id")
    sample = scratch.save(texts.select("text", "y", F.pmod(F.xxhash64("l_id"), F.lit(2)).cast("int").alias("fold")), "sample")

    def count(batches):
        for b in slices(batches, 1_000):
            n: dict[tuple, list[int]] = {}
            for t, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for term in terms(words(t)):
                    n.setdefault(term, [0, 0, 0, 0])[2 * fold + y] += 1
            columns = [*([k[i] for k in n] for i in range(3)), *([v[i] for v in n.values()] for i in range(4))]
            kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ord", "context", "term", "a0", "a1", "b0", "b1"])

    counted = sample.mapInArrow(count, "ord int, context string, term string, a0 long, a1 long, b0 long, b1 long")
    kept = _kept(scratch.save(counted.groupBy("ord", "context", "term").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "counts"))
    rows = scratch.save(kept, "kept").toArrow().to_pylist()  # terms that tell the classes of LABELLED documents apart

    def model(fold: int) -> Model:
        return Model({(r["ord"], r["context"], r["term"]): (r[f"m{fold}"]["shared"], r[f"m{fold}"]["own0"], r[f"m{fold}"]["own1"]) for r in rows if r[f"m{fold}"]["own0"] or r[f"m{fold}"]["own1"]})

    halves = [model(0), model(1)]

    def held(batches):
        for b in slices(batches):
            rows = [(halves[1 - fold].evidence(t), float(y)) for t, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)], ["x", "y"])

    points = sample.mapInArrow(held, "x double, y double").toArrow()  # LABELLED rows of two numbers
    whole = model(2)
    whole.calibrate(points["x"].to_numpy(), points["y"].to_numpy())
    return whole


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) beside them, under a name no column has."""
    (name,) = unused(docs, "score")
    at, names = docs.columns.index(text), [*docs.columns, name]

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(model.score, b.column(at).to_pylist()), pa.float64())], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def annotate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``.

    Null, empty and wordless texts have the score of no evidence; a text of any length is scored
    whole.  Without any label, or without documents to learn from, the score is about zero
    everywhere.  A null id is held out of nothing and teaches nothing.  Repeated rows stay, each
    with the same score; extra columns are ignored, whatever their names; no rows give no rows.
    """
    model = fit(docs, labels, id_col, text)
    scored = score(docs.select(F.col(id_col), F.col(text)), model, text)
    return scored.select(id_col, F.coalesce(~learns(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with.

    A null or empty text has no evidence against it and stays unless most labelled documents are
    toxic; repeated rows stay or go together; extra columns (one named ``score`` too) stay.
    """
    model = fit(docs, labels, id_col, text)
    scored = score(docs, model, text)
    return scored.where(F.col(scored.columns[-1]) < THRESHOLD).select(*docs.columns)

