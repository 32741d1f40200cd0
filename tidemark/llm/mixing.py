"""Mixing by soft membership, in DataFrame operations only.

A naive Bayes classifier over words, learnt from all rows of a labelled table, gives every document a
posterior over domains; it is tempered to ``EVIDENCE`` words, since those of one text are not independent.
Words are known by a hash into ``BUCKETS`` numbers; in scripts written without blanks every character is a
word. The numbers are taken once from every text and written as a table, from which all passes read. Each document then gets a rate r >= 0 (r >= 1 where no document may be lost) such that the expected tokens of every domain,
sum(tokens * posterior * rate), come near their targets. The rates start at 1 and follow the projected
gradient of the squared error. Its steps are scaled by the inverse of the weighted Gram matrix of the
posteriors of documents whose rate is above its bound; where such a step doesn't help, the plain gradient is taken. A step is one vector with a number per domain, so a rate
is an expression of the document's own columns: every pass is one aggregation with one row per task, and
no table of rates is joined.

Defined results: null and empty texts have no tokens and the labelled table's domain shares as posterior;
a null domain teaches nothing; without any labelled row there are no domains and every rate is 1;
a domain whose target can't be met (no document may belong to it) comes as near as it can; repeated rows
each count. Columns of ``docs`` other than doc_id and text are only passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, fresh_name, materialize, whole_text
from tidemark.operators.ordered import running

#: Words are hashed into so many numbers; by domain each has a weight.
BUCKETS = 4096
#: A character of a script written without blanks between words.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\x{20000}-\x{3FFFF}]"
EVIDENCE = 60.0
STEPS = 25
#: Domains at most, as each pair of them is summed; more are an error.
MOST_DOMAINS = 64
#: Row numbers of one partition, as a block of :func:`running`.
PARTITION = (1 << 33) / 1e6


def split_words(lower: Column) -> Column:
    """Words of the lower-cased text."""
    spaced = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, UNSPACED, " $0 ")).otherwise(lower)
    bare = F.btrim(spaced, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass
class Domains:
    """Names, prior logarithms and, by domain and bucket, logarithms of the buckets' shares."""

    names: list[str]
    prior: list[float]
    shares: list[list[float]]

    def posteriors(self, rows: DataFrame, row: str, words: str) -> DataFrame:
        """Columns of ``rows`` but for the buckets ``words``, and p, the domains' posteriors; ``row`` is another number in each row."""
        others = [c for c in rows.columns if c != words]
        assert row in others
        # a row for each bucket, joined: as literals the weights would be in every plan that the driver makes, prints and keeps
        weights = pa.table({"_w": pa.array(range(BUCKETS), pa.int32()), "_s": pa.array(np.array(self.shares).T.tolist(), pa.list_(pa.float64()))})
        each = rows.select(*others, F.explode_outer(words).alias("_w")).join(F.broadcast(rows.sparkSession.createDataFrame(weights)), "_w", "left")
        dots = [F.coalesce(F.sum(F.col("_s")[k]), F.lit(0.0)).alias(f"_d{k}") for k in range(len(self.names))]
        g = each.groupBy(*others).agg(F.count("_w").alias("_n"), *dots)
        temper = F.when(F.col("_n") > EVIDENCE, EVIDENCE / F.col("_n")).otherwise(F.lit(1.0))
        g = g.withColumn("_l", F.array(*(F.lit(p) + temper * F.col(f"_d{k}") for k, p in enumerate(self.prior))))
        g = g.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
        return g.select(*others, F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def measured(docs: DataFrame, domain: str, row: str | None = None) -> DataFrame:
    """row (a number, from the column ``row`` if one is named), doc_id, domain (as text), n_tokens and words (their buckets) of every document, written as a table."""
    text = whole_text()
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", F.col(domain).cast("string").alias("domain"), text.alias("text"), F.lower(text).alias("lower"))
    rows = rows.withColumn("words", split_words(F.col("lower")))
    # where no character is a word of its own, words are tokens
    n = F.when(F.col("lower").rlike(UNSPACED), token_count(F.col("text"))).otherwise(F.size("words").cast("long"))
    return materialize(rows.select("row", "doc_id", "domain", n.alias("n_tokens"), word_buckets(F.col("words")).alias("words")), "mixing-words")


def learn_domains(labelled: DataFrame) -> Domains:
    """Shares of the buckets in each domain over all rows of the labelled table, as :func:`measured` gives it."""
    known = labelled.where(F.col("domain").isNotNull())
    found = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    place = {r["domain"]: i for i, r in enumerate(found)}
    counts = np.full((len(found), BUCKETS), 0.5)
    each = known.select("domain", F.explode("words").alias("bucket")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    for r in each.toLocalIterator():  # BUCKETS rows a domain at most
        counts[place[r["domain"]], r["bucket"]] += r["n"]
    n = np.array([r["n"] for r in found], float)
    return Domains([r["domain"] for r in found], np.log(n / n.sum()).tolist(), np.log(counts / counts.sum(axis=1, keepdims=True)).round(6).tolist())


def soft_members(rows: DataFrame, domains: Domains) -> DataFrame:
    """row, doc_id, n_tokens and p (the domains' posteriors) of every document that :func:`measured` gives, written as a table."""
    kept = rows.select("row", "doc_id", "n_tokens", "words")
    found = domains.posteriors(kept, "row", "words") if domains.names else kept.drop("words").withColumn("p", F.array().cast("array<double>"))
    return materialize(found, "mixing-posteriors")


@dataclass
class Mix:
    domains: Domains
    targets: list[float]
    steps: list[list[float]]
    totals: list[float]
    least: float = 0.0

    def rate(self, posterior: Column) -> Column:
        return rate_after(self.steps, posterior, self.least)


def rate_after(steps: list[list[float]], posterior: Column, least: float = 0.0) -> Column:
    """The rate after some steps: each one takes posterior * step off, not below ``least``."""
    rate = F.lit(1.0)
    for step in steps:
        change = sum((posterior[k] * F.lit(g) for k, g in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(least), rate - change)
    return rate


def _state(soft: DataFrame, steps: list[list[float]], size: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the present rates, and the Gram matrix of documents with a rate above ``least`` (of all before the first step)."""
    p, t = F.col("p"), F.col("tokens").cast("double")
    rated = soft.withColumn("rate", rate_after(steps, p, least))
    on = F.when(F.col("rate") > least, t).otherwise(0.0) if steps else t
    totals = [F.sum(t * F.col("rate") * p[i]).alias(f"t{i}") for i in range(size)]
    gram = [F.sum(on * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    row = rated.agg(*totals, *gram).first()
    g = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return np.array([row[f"t{i}"] or 0.0 for i in range(size)]), g


def tempered_targets(totals: np.ndarray, power: float) -> np.ndarray:
    """Targets in proportion to totals ** power, as large as is needed to take no domain's tokens away."""
    weights = np.where(totals > 0, np.maximum(totals, 1e-12) ** power, 0.0)
    weights = weights / max(weights.sum(), 1e-12)
    return weights * max((totals[weights > 0] / weights[weights > 0]).tolist(), default=0.0)


def fit(soft: DataFrame, domains: Domains, weights: dict[str, float] | None = None, power: float | None = None, max_steps: int = STEPS, tolerance: float = 1e-6) -> Mix:
    """Rates that bring the expected tokens of the domains to their targets; ``soft`` as :func:`soft_members` gives it.

    ``weights``: share of each domain in today's total (equal ones if none are given). ``power``: instead,
    shares in proportion to today's expected tokens to this power, of a total that takes nothing away; no rate
    is below 1 then, and a domain that overlaps with raised ones may end above its target.
    """
    size = len(domains.names)
    if not size:
        return Mix(domains, [], [], [])
    soft = soft.select(F.col("n_tokens").alias("tokens"), "p")
    steps: list[list[float]] = []
    least = 0.0 if power is None else 1.0
    totals, gram = _state(soft, steps, size, least)
    bound = max(np.trace(gram), 1e-12)  # of the whole Gram matrix' eigenvalues
    if power is not None:
        targets = tempered_targets(totals, power)
    else:
        shares = np.array([(weights or {}).get(d, 0.0) if weights else 1.0 for d in domains.names])
        targets = totals.sum() * shares / max(shares.sum(), 1e-12)
    error = lambda x: float(((x - targets) ** 2).sum())
    scale, plain = 1.0, False
    for _ in range(max_steps):
        if np.abs(totals - targets).max() <= tolerance * max(targets.max(), 1.0) or scale < 1e-3:
            break
        ridge = np.eye(size) * max(np.trace(gram), 1e-12) * 1e-9
        step = ((totals - targets) / bound if plain else scale * np.linalg.solve(gram + ridge, totals - targets)).tolist()
        after, gram_after = _state(soft, [*steps, step], size, least)
        if error(after) < error(totals) * (1 - tolerance if plain else 1):
            steps, totals, gram, scale, plain = [*steps, step], after, gram_after, min(1.0, 2 * scale), False
        elif plain:
            break
        else:
            scale /= 2
            plain = scale < 0.2
    return Mix(domains, targets.tolist(), steps, totals.tolist(), least)


def rates(soft: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate of every document that :func:`soft_members` gives."""
    if not mix.domains.names:
        return soft.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.col("p").alias("posterior"), F.lit(1.0).alias("rate"))
    names = F.array(*map(F.lit, mix.domains.names))
    likeliest = names[(F.array_position("p", F.array_max("p")) - 1).cast("int")]
    return soft.select("doc_id", "n_tokens", likeliest.alias("domain"), F.col("p").alias("posterior"), mix.rate(F.col("p")).alias("rate"))


def mixed(docs: DataFrame, domain: str, weights: dict[str, float] | None = None, power: float | None = None) -> DataFrame:
    """``docs`` mixed to the targets of :func:`fit`: each row as often as its rate says, the whole part, and once more where a draw is below the rest.

    The draw is a hash of id and text and, of rows that share both, of their place among them: so each row has its own, and a rerun gives the same.
    """
    row, rate, copies, draw = (fresh_name(docs, f"mixing_{x}") for x in ("row", "rate", "copies", "draw"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-rows")
    words = measured(rows, domain, row)
    domains = learn_domains(words)
    soft = soft_members(words, domains)
    discard(words)
    mix = fit(soft, domains, weights, power)
    columns = [f"`{c}`" for c in docs.columns]
    if not domains.names:
        return rows.select(*columns)
    rated = soft.select(F.col("row").alias(row), F.round(mix.rate(F.col("p")), 9).alias(rate))  # a sum of doubles may end just below a whole number
    same = rows.select(F.col(row).alias("row"), F.xxhash64("doc_id", "text").alias("same"))
    drawn = running(same, ["same"], ["row"], {"nth": F.lit(1)}, PARTITION)  # a row repeated very often is ranked in many tasks
    chance = F.pmod(F.xxhash64("same", "nth", F.lit("mix")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    rated = rated.join(drawn.select(F.col("row").alias(row), chance.alias(draw)), row)
    often = (F.floor(rate) + F.when(F.col(draw) < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    return rows.join(rated, row).select(*columns, F.explode(F.array_repeat(F.lit(0), often)).alias(copies)).select(*columns)
