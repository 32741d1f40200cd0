"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the distinct lower-cased words of a text, stripped of the punctuation around them, and the
beginnings of its longer words: one for a beginning that is there, one for a beginning that several
different words share (insults are built from few stems). Over the
training sample Spark counts how many toxic and other documents hold each word; the words that tell most
(by the log-likelihood ratio of their two-by-two table) become features. Grades are ordered: 0 for
documents labelled clean; labels have no degrees, so toxic documents are graded 1, 2, ... by cross-fitting: each one by
the evidence of its words as counted in the folds that it isn't in. One weight
per word is shared by all thresholds: P(grade >= j) = sigmoid(w x - t_j) with t_1 < t_2 < ...; the severity
of a text is its expected grade, the sum of these probabilities.

The fit takes at most ``SAMPLE`` labelled documents, those with the smallest hash of doc_id; every text is
scored as a whole.

Defined results: a null or empty text has no features and gets the severity of the thresholds alone; rows
of labels without a document, or with a null label, teach nothing; repeated rows are scored each. A table
without labels of both kinds scores every text 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, carry, discard, fresh_name, materialize

SAMPLE = 40_000
FEATURES = 4096
GRADES = 4
REJECT_AT = 0.5
FOLDS = 5
TELLING = 20.0  # the least log-likelihood ratio of a feature; by chance one word in 100,000 has it
STEM = 5  # letters of a beginning
TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def text_features(text: str | None) -> set[str]:
    """The words of a text, ^beginning of its longer words, and ^^beginning where two words or more share it."""
    if not text:
        return set()
    words = set(TOKEN.findall(text.lower()))
    stems = [w[:STEM] for w in words if len(w) > STEM]
    once = set(stems)
    if len(stems) > len(once):
        words.update("^^" + s for s, n in Counter(stems).items() if n > 1)
    words.update(map("^".__add__, once))
    return words


@dataclass
class OrdinalModel:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... of each text."""
        score = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if own := [self.words[w] for w in text_features(text) if w in self.words]:
                score[i] = self.weights[own].sum()
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, features: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean log-likelihood; rows hold the features of each document."""
    levels = int(grades.max())
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights = np.zeros(features)
    share = np.array([np.clip((grades >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, levels + 1)])
    cuts = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))  # thresholds: the first, then positive gaps
    theta = np.concatenate([weights, cuts[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(len(rows))
    for step in range(1, steps + 1):
        weights, first, gap = theta[:features], theta[features], np.exp(theta[features + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gap)])
        score = np.bincount(owner, weights[flat], len(rows))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -60, 60)))  # P(grade >= j)
        upper = np.hstack([np.ones((len(rows), 1)), above])
        lower = np.hstack([above, np.zeros((len(rows), 1))])
        p = np.maximum(upper[at, grades] - lower[at, grades], 1e-9)
        slope = np.hstack([np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))])
        by_score = (slope[at, grades] - slope[at, grades + 1]) / p / len(rows)
        by_cut = np.zeros(levels)
        for j in range(levels):
            by_cut[j] = (-slope[at, j + 1] * (grades == j + 1) + slope[at, j + 1] * (grades == j)) @ (1 / p) / len(rows)
        grad = np.concatenate([np.bincount(flat, by_score[owner], features) - l2 * weights, [by_cut.sum()], [by_cut[i + 1 :].sum() * gap[i] for i in range(levels - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gap = np.exp(theta[features + 1 :])
    return theta[:features], theta[features] + np.concatenate([[0], np.cumsum(gap)])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic, words) of the training sample."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels without a document take no places
    chosen = F.broadcast(bounded_sample(own, sample))  # ``sample`` small rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"words": [sorted(text_features(t)) for t in batch["text"]]})

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    return carry(rows.select("doc_id", "toxic", fold, "text"), ["doc_id", "toxic", "fold"], ["text"], "words array<string>", run)


def _ratio(n: Column, toxic: Column, share: float) -> Column:
    """The log-likelihood ratio of a word that n documents hold, of which some are toxic, against the share of all."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (part(toxic, n * share) + part(n - toxic, n * (1 - share)))


def _telling(rows: DataFrame, features: int, share: float) -> DataFrame:
    """(word, n, bad, ns, bads) of the words that tell most: in how many documents, and toxic ones, they are, in all and by fold."""
    by_fold = [F.sum(F.when(F.col("fold") == k, x).otherwise(0)) for x in (F.lit(1), F.col("toxic")) for k in range(FOLDS)]
    held = rows.select("toxic", "fold", F.explode("words").alias("word")).groupBy("word")
    held = held.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"), F.array(*by_fold[:FOLDS]).alias("ns"), F.array(*by_fold[FOLDS:]).alias("bads"))
    telling = F.round(_ratio(F.col("n").cast("double"), F.col("bad").cast("double"), share), 6)
    return held.where("n >= 5").withColumn("telling", telling).where(F.col("telling") >= TELLING).orderBy(F.desc("telling"), "word").limit(features)


def cross_fitted_grades(rows: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, ns: np.ndarray, bads: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean documents; toxic ones by their evidence, the sum of their words' log-odds as counted in the other folds:
    of ``grades`` - 1 equal parts of the toxic documents, the strongest get the highest grade. Words are rows of ns and bads (by fold)."""
    evidence = np.zeros(len(rows))
    for k in range(ns.shape[1]):
        n, bad = ns.sum(axis=1) - ns[:, k], bads.sum(axis=1) - bads[:, k]
        odds = np.log((bad + 0.5) / (n - bad + 0.5))
        inside = fold == k
        odds -= np.log((toxic[~inside].sum() + 0.5) / ((1 - toxic[~inside]).sum() + 0.5))
        for i in np.flatnonzero(inside):
            evidence[i] = odds[rows[i]].sum()
    of_toxic = evidence[toxic == 1]
    cuts = np.quantile(of_toxic, np.arange(1, grades - 1) / (grades - 1)) if len(of_toxic) else np.empty(0)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, "left"), 0).astype(np.int64)


def _numbered(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """(doc_id, toxic, fold, features): words as numbers."""
    shipped = rows.sparkSession.sparkContext.broadcast(words)  # FEATURES words at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"features": [sorted(shipped.value[w] for w in own if w in shipped.value) for own in batch["words"]]})

    return carry(rows, ["doc_id", "toxic", "fold"], ["words"], "features array<int>", run)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES) -> OrdinalModel | None:
    """The model learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; leave out what is held out)."""
    rows = materialize(_labelled(docs, labels, sample), "toxicity-labelled")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if not 0 < total["bad"] < total["n"]:
        discard(rows)
        return None
    chosen = _telling(rows, features, total["bad"] / total["n"]).collect()
    words = {r["word"]: i for i, r in enumerate(chosen)}
    learned = bounded_sample(_numbered(rows, words), sample).select("toxic", "fold", "features").toPandas()
    discard(rows)
    found = [np.asarray(x, np.int64) for x in learned["features"]]
    ns, bads = (np.array([r[c] for r in chosen], float).reshape(len(chosen), FOLDS) for c in ("ns", "bads"))
    grade = cross_fitted_grades(found, learned["toxic"].to_numpy(), learned["fold"].to_numpy(), ns, bads, grades)
    weights, thresholds = fit_cumulative_link(found, grade, len(words))
    return OrdinalModel(words, weights, thresholds)


def _above(docs: DataFrame, carried: list[str], model: OrdinalModel | None, name: str) -> DataFrame:
    """``carried`` columns of ``docs`` and, as the array ``name``, P(grade >= j) for j = 1, 2, ...; of one zero without a model."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = shipped.value.probabilities(batch["text"].tolist()) if shipped.value else np.zeros((len(batch), 1))
            yield pd.DataFrame({name: list(above)})

    return carry(docs, carried, ["text"], f"`{name}` array<double>", run)


def score(docs: DataFrame, model: OrdinalModel | None, held_out: Column | None = None, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, held_out, severity (expected grade), score (probability of any toxic grade), grade (likeliest), toxic."""
    rows = docs.select("doc_id", (held_out if held_out is not None else F.lit(False)).alias("held_out"), "text")
    above = _above(rows, ["doc_id", "held_out"], model, "above")
    upper, lower = F.concat(F.array(F.lit(1.0)), "above"), F.concat("above", F.array(F.lit(0.0)))
    each = F.zip_with(upper, lower, lambda a, b: a - b)
    return above.select(
        "doc_id",
        "held_out",
        F.aggregate("above", F.lit(0.0), lambda a, b: a + b).alias("severity"),
        F.col("above")[0].alias("score"),
        (F.array_position(each, F.array_max(each)) - 1).cast("int").alias("grade"),
        (F.col("above")[0] >= reject_at).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, model: OrdinalModel | None, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    if model is None:
        return docs
    name = fresh_name(docs, "above")
    return _above(docs, docs.columns, model, name).where(F.col(name)[0] < reject_at).drop(name)
