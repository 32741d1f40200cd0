"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character n-grams (three bytes of lower-cased UTF-8, runs of
anything but letters folded to one space), learnt by counting over every labelled document. A document's
n-grams are drawn from a mixture of languages. Expectation-maximisation estimates the proportions; the set
of languages is the one with the largest likelihood less ``PENALTY`` * log(n) / 2 for each language beyond
the first. It is searched backwards: from all languages, the one with the least proportion is given up as
long as that improves the penalised likelihood. Where even all languages together can't outweigh the
penalty of a second one, the best single language is taken at once. The likelihood is tempered to one
n-gram in ``EVERY``, since neighbouring n-grams overlap.

Only counts are gathered: languages x ``FEATURES`` numbers at most, whatever the size of the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no languages; so is every
text when nothing was learnt; a null language teaches nothing; of languages with the same proportion the
first by name is predicted; repeated rows each count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carry

FEATURES = 1 << 15
PENALTY = 2.0
#: Languages at most, whose counts the driver holds; more are an error.
MOST_LANGUAGES = 256
EVERY = 3.0
ROUNDS = 12
CHARS = 1_000_000  # of text that a worker handles at a time
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def grams(text: str) -> np.ndarray:
    """Features of all n-grams of the text, in order."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    raw = raw[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(raw) < 3:
        return np.empty(0, np.int64)
    x = raw.astype(np.uint32)
    key = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - 15)).astype(np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # features x languages


def learn(docs: DataFrame, lang: str = "lang") -> LanguageModel:
    """Count n-grams by language over all rows of ``docs`` (text and ``lang``)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["lang"], batch["text"], strict=True):
                if name not in counts:
                    counts[name] = np.zeros(FEATURES, np.int64)
                counts[name] += np.bincount(grams(text), minlength=FEATURES)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "feature": at, "n": own[at]})

    found = rows.mapInPandas(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = found.toPandas()  # languages x FEATURES rows at most
    names = sorted(table["lang"].unique())
    counts = np.full((FEATURES, len(names)), 0.1)
    at = {x: i for i, x in enumerate(names)}
    counts[table["feature"].to_numpy(int), table["lang"].map(at).to_numpy(int)] += table["n"].to_numpy(float)
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)) if names else np.empty((FEATURES, 0)))


def mixtures(model: LanguageModel, rows: list[np.ndarray]) -> np.ndarray:
    """Proportions of every language in each document, 0 for those outside its set; rows hold n-gram features (not empty)."""
    parts = [np.unique(r, return_counts=True) for r in rows]
    sizes = np.array([len(f) for f, _ in parts])
    starts = np.cumsum(sizes) - sizes
    flat, weight = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts]) / EVERY
    logs = model.logs[flat]
    docs, k = len(rows), len(model.names)
    single = np.add.reduceat(logs * weight[:, None], starts, axis=0)
    best = single.argmax(axis=1)
    out = np.zeros((docs, k))
    out[np.arange(docs), best] = 1.0
    if k == 1:
        return out
    n = np.add.reduceat(weight, starts)
    penalty = PENALTY * np.log(np.maximum(n, 2.0)) / 2
    highest = logs.max(axis=1)
    shares = np.exp(logs - highest[:, None])
    base = np.add.reduceat(weight * highest, starts)

    def fitted(chosen: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after expectation-maximisation and log-likelihoods of the chosen documents; 0 stays 0."""
        at = np.concatenate([np.arange(s, s + z) for s, z in zip(starts[chosen], sizes[chosen], strict=True)])
        owner, own, w = np.repeat(np.arange(len(chosen)), sizes[chosen]), shares[at], weight[at]
        cut = np.cumsum(sizes[chosen]) - sizes[chosen]
        pi = start
        for _ in range(ROUNDS):
            joint = own * pi[owner]
            joint *= (w / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            pi = np.add.reduceat(joint, cut, axis=0)
            pi /= pi.sum(axis=1, keepdims=True)
        mixed = np.maximum((own * pi[owner]).sum(axis=1), 1e-300)
        return pi, np.add.reduceat(w * np.log(mixed), cut) + base[chosen]

    everything = np.arange(docs)
    full, likelihood = fitted(everything, np.full((docs, k), 1 / k))
    open_ = np.flatnonzero(likelihood - single[everything, best] > penalty)
    pi, value = full[open_], likelihood[open_] - penalty[open_] * (k - 1)
    while len(open_):
        held = pi > 0
        least = np.where(held, pi, np.inf).argmin(axis=1)
        fewer = pi.copy()
        fewer[np.arange(len(open_)), least] = 0.0
        size = held.sum(axis=1)
        alone = size <= 2  # what is left is one language
        fewer /= np.maximum(fewer.sum(axis=1, keepdims=True), 1e-300)
        lone = np.flatnonzero(fewer.sum(axis=1) <= 0)
        fewer[lone, best[open_[lone]]] = 1.0
        after, reached = fitted(open_, fewer)
        reached = np.where(alone, single[open_, after.argmax(axis=1)], reached) - penalty[open_] * (size - 2)
        better = (reached >= value) & (size > 1)
        out[open_[~better]] = pi[~better]
        done = better & alone  # one language is left: the best single one
        open_, pi, value = open_[better & ~done], after[better & ~done], reached[better & ~done]
    return out


def identify(docs: DataFrame, model: LanguageModel, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), languages and proportions of the set, by proportion."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x FEATURES numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(shipped.value.names, object)
        for batch in batches:
            texts = [t if t is not None and LETTER.search(t) else "" for t in batch["text"]]
            found: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(texts)
            at = 0
            while at < len(texts) and len(names):
                some, held = [], 0
                while at < len(texts) and held < CHARS:
                    if texts[at] and len(own := grams(texts[at])):
                        some.append((at, own))
                    held += len(texts[at])
                    at += 1
                if not some:
                    continue
                for (i, _), pi in zip(some, mixtures(shipped.value, [g for _, g in some]), strict=True):
                    order = np.argsort(-pi, kind="stable")[: (pi > 0).sum()]
                    found[i] = (names[order[0]], min(1.0, float(pi[order[0]])), names[order].tolist(), pi[order].tolist())
            yield pd.DataFrame(found, columns=["lang_pred", "score", "languages", "proportions"])

    rows = docs.select("doc_id", (held_out if held_out is not None else F.lit(False)).alias("held_out"), "text")
    return carry(rows, ["doc_id", "held_out"], ["text"], "lang_pred string, score double, languages array<string>, proportions array<double>", run)
