"""Quality classifier: a generalised additive model with pairwise interactions.

Surface features of the whole text are cut into bins at quantiles of the training sample. Boosting goes
round the features in a cycle; in each turn a shallow tree over the bins of one feature is fitted to the
gradient of the log-loss and added, shrunk, to that feature's lookup table. Then the pairs that explain
most of what is left get tables of their own, boosted in the same way over coarser bins. A text's score is
the sigmoid of an intercept and one table entry per feature and pair: additions of whole columns.

The fit takes at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id; every text is
scored as a whole.

Defined results: null and empty texts have all features 0 and get the score that these bins give; labels
without a document or with a null grade teach nothing; of labels repeated for one doc_id the largest
counts; without labels of both kinds the score is the share of label 1 (0.5 without any); repeated rows are
each scored; columns other than doc_id and text (doc_id and the label in ``labels``) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, carry

SAMPLE = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAF_ROWS, RIDGE = 0.1, 20, 1.0
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "blanks", "symbols", "bars", "shouts",
    "full_stops", "not_ascii", "short_words", "distinct_words", "distinct_lines", "line_length", "marked_words", "title_words",
)

UPPER, LOWER, DIGIT, BLANK, STOP, BAR, SHOUT, SYMBOL, OTHER = range(9)
_KIND = np.full(256, SYMBOL, np.uint8)
_KIND[0x80:] = OTHER
for _kind, _bytes in ((UPPER, range(65, 91)), (LOWER, range(97, 123)), (DIGIT, range(48, 58)), (BLANK, b" \t\n\v\f\r"), (STOP, b".,;:'\"-"), (BAR, b"|"), (SHOUT, b"!?")):
    _KIND[list(_bytes)] = _kind


def text_features(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    n = len(raw)
    of = np.bincount(kinds, minlength=9) / n
    letters = max(of[UPPER] + of[LOWER] + of[OTHER], 1e-9)
    blank = np.concatenate([[True], kinds == BLANK, [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, length = edges[::2], edges[1::2] - edges[::2]
    words = max(len(length), 1)
    lines = raw.split(b"\n")
    ends = kinds[first + length - 1] if len(length) else kinds[:0]
    starts = kinds[first] if len(length) else kinds[:0]
    return [
        np.log1p(n), np.log1p(len(length)), length.sum() / words, np.log1p(length.max(initial=0)), of[UPPER] / letters, of[DIGIT], of[BLANK], of[SYMBOL], of[BAR], of[SHOUT],
        of[STOP], of[OTHER], (length <= 3).sum() / words, len(set(raw.split())) / words, len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.isin(ends, (SYMBOL, BAR, SHOUT)).sum() / words, (starts == UPPER).sum() / words,
    ]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature's bins
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, COARSE, COARSE)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            bins = self.bins(x)
            for f, table in enumerate(self.tables):
                total += table[bins[:, f]]
            coarse = bins * COARSE // BINS
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _cut(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered histogram; (0, 0) if there is none."""
    g, h, n = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1], np.cumsum(rows)[:-1]
    all_g, all_h, all_n = gradient.sum(), weight.sum(), rows.sum()
    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(n < LEAF_ROWS) | (all_n - n < LEAF_ROWS)] = 0
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-12 else (0.0, 0)


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values by bin of a tree over an ordered histogram: the leaf that gains most is cut next."""
    parts = [(0, len(rows))]
    while len(parts) < leaves:
        found = [(*_cut(gradient[a:b], weight[a:b], rows[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(rows))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + RIDGE)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree over a two-dimensional histogram: one cut by one axis, then one of each side by the other."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(gradient))
    for turned in (False, True):
        g, h, n = (x.T if turned else x for x in (gradient, weight, rows))
        for at in range(1, len(g)):
            out, gain = np.zeros_like(g), 0.0
            for part in (slice(0, at), slice(at, None)):
                own = [x[part].sum(axis=0) for x in (g, h, n)]
                more, where = _cut(*own)
                gain += more
                for side in (slice(0, where), slice(where, None)):
                    out[part, side] = own[0][side].sum() / (own[1][side].sum() + RIDGE)
            if gain > best[0]:
                best = gain, (out.T if turned else out)
    return best


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of features ``x`` (rows x features) and labels ``y`` 0/1."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        return AdditiveModel(float(np.log(share / (1 - share))))
    share = y.mean()
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, np.zeros((x.shape[1], BINS)))
    bins = model.bins(x)
    rows = [np.bincount(b, minlength=BINS) for b in bins.T]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, own in enumerate(bins.T):
            g, h = slopes()
            step = RATE * _tree(np.bincount(own, g, BINS), np.bincount(own, h, BINS), rows[f])
            model.tables[f] += step
            total += step[own]
    coarse = bins * COARSE // BINS
    cells = {(i, j): coarse[:, i] * COARSE + coarse[:, j] for i in range(x.shape[1]) for j in range(i)}

    def histogram(cell: np.ndarray, values: np.ndarray | None) -> np.ndarray:
        return np.bincount(cell, values, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slopes()
    gains = sorted(((_pair_tree(histogram(c, g), histogram(c, h), histogram(c, None))[0], p) for p, c in cells.items()), reverse=True)
    model.pairs = [p for gain, p in gains[:PAIRS] if gain > 0]
    model.pair_tables = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(histogram(cells[pair], g), histogram(cells[pair], h), histogram(cells[pair], None))[1]
            model.pair_tables[k] += step
            total += step.ravel()[cells[pair]]
    return model


def features(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the columns ``others`` and x (the features) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [text_features(t) for t in batch["text"]]})

    return carry(docs, ["doc_id", *others], ["text"], "x array<double>", run)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Learn from ``labels`` (doc_id and ``label`` 0/1; leave out what is held out) and the texts of ``docs``."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels without a document take no places
    chosen = F.broadcast(bounded_sample(own, sample))  # ``sample`` small rows at most
    rows = features(docs.select("doc_id", "text").join(chosen, "doc_id"), "label")
    found = bounded_sample(rows, sample).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit_additive(x, found["label"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, held_out: Column | None = None, keep_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted (1 from ``keep_at``) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some tables of BINS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = shipped.value.scores(np.array([text_features(t) for t in batch["text"]], float).reshape(len(batch), len(FEATURES)))
            yield pd.DataFrame({"score": got, "predicted": (got >= keep_at).astype(np.int32)})

    rows = docs.select("doc_id", (held_out if held_out is not None else F.lit(False)).alias("held_out"), "text")
    return carry(rows, ["doc_id", "held_out"], ["text"], "score double, predicted int", run)
