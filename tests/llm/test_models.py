"""Quality, toxicity, languages, language model and mixing: plain versions, held-out accuracy and odd rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DE, EN, FR, prose
from tidemark.llm import gam, langid, mixing, ngram_trie, toxicity
from tidemark.llm.common import held_out


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        text, good, bad = prose(rng, EN, rng.randrange(30, 90)), 1, 0
        if i % 4 == 0:
            text, good = " ".join(w.upper() + rng.choice(["###", "!!", " |"]) for w in text.split()), 0
        if i % 5 == 0:
            text, bad = text + " you utter " + rng.choice(["moronic", "moronish", "scum"]) + " fool", 1
        rows.append((i, text))
        labels.append((i, good, bad))
    labels += [(1, None, None), (9999, 1, 1), (None, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    held = held_out(4, 2)
    got = gam.score(docs, gam.fit(docs, labels.where(~held)), held).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out")
    right = got.where("predicted = quality").count()
    assert right >= 0.97 * got.count() > 0
    assert got.where("score < 0 OR score > 1").count() == 0


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature alone tells
    model = gam.fit_additive(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95 and (1, 0) in model.pairs


def test_quality_of_odd_rows_and_without_labels(documents, nothing, labelled):
    docs, labels = labelled
    got = gam.score(documents, gam.fit(docs, labels))
    assert got.count() == documents.count() and got.where("score IS NULL").count() == 0
    model = gam.fit(docs, labels.where("quality = 1"))
    assert gam.score(docs, model).agg(F.min("score")).first()[0] > 0.9
    assert gam.score(docs, gam.fit(nothing, labels)).agg(F.max("score")).first()[0] == 0.5
    assert gam.score(nothing, model).count() == 0


def test_toxicity(labelled, documents, nothing):
    docs, labels = labelled
    held = held_out(4, 2)
    model = toxicity.fit(docs, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "says").join(labels.where("toxic IS NOT NULL"), "doc_id").where(held)
    assert rows.where("says = (toxic = 1)").count() >= 0.97 * rows.count() > 0
    kept = toxicity.drop_toxic(documents, model)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert toxicity.score(documents, model).where("severity IS NULL").count() == 0
    assert toxicity.fit(nothing, labels) is None and toxicity.score(docs, None).where("toxic").count() == 0


def test_cumulative_link_shares_weights_over_ordered_thresholds():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(3000)]
    force = np.array([2.0, 1.0, 0.0, 0.0, -1.0, 0.5])
    latent = np.array([force[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = np.digitize(latent, [0.5, 2.0])
    weights, cuts = toxicity.fit_cumulative_link(rows, grades, 6)
    assert np.abs(weights - force).max() < 0.35 and np.abs(cuts - [0.5, 2.0]).max() < 0.25


def test_languages(spark, documents, nothing):
    rng = random.Random(3)
    rows = [(i, prose(rng, w, 40), n) for i in range(120) for n, w in [(("en", EN), ("de", DE), ("fr", FR))[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = held_out(3, 1)
    model = langid.learn(docs.where(~held))
    got = langid.identify(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() == got.count() > 0
    mixed = spark.createDataFrame([(1, prose(rng, EN, 80) + " " + prose(rng, FR, 80)), (2, prose(rng, DE, 150)), (3, None), (4, "12 + 34 !?")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(mixed, model).collect()}
    assert set(found[1]["languages"]) == {"en", "fr"} and abs(found[1]["proportions"][0] - 0.5) < 0.2
    assert found[2]["languages"] == ["de"] and found[2]["score"] == 1.0
    assert [found[i]["lang_pred"] for i in (3, 4)] == ["und", "und"]
    assert langid.identify(documents, model).count() == documents.count()
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}


def plain_scores(train, texts, least=2):
    """n_known, base and score of each text by dictionaries, with the same quantisation."""
    end, c1, c2, c3, in2, in3 = b" ", Counter(), Counter(), Counter(), Counter(), Counter()
    for t in train:
        s = [end, *t, end]
        c1.update(s[1:])
        for a, b in zip(s, s[1:], strict=False):
            c2[a, b] += 1
            in2[a] += 1
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            c3[a, b, c] += 1
            in3[a, b] += 1
    n, v, d = sum(c1.values()), len(c1), ngram_trie.DISCOUNT
    left2, left3 = defaultdict(float), defaultdict(float)
    for (a, b), k in c2.items():
        if k >= least:
            left2[a] += (k - d) / in2[a]
    for (a, b, c), k in c3.items():
        if k >= least and c2[a, b] >= least:
            left3[a, b] += (k - d) / in3[a, b]
    byte = lambda p: 10 ** (-round(-25.5 * max(math.log10(p), -10.0)) / 25.5)
    out = []
    for t in texts:
        s, base, score, known = [end, *t, end], 0.0, 0.0, 0
        for i in range(1, len(s)):
            w, p = s[i], (c1[s[i]] + 0.1) / (n + 0.1 * (v + 1))
            base, known = base + math.log10(p), known + (c1[w] > 0)
            for context, counts, total, left, kept in ([((s[i - 1],), c2, in2.get(s[i - 1], 0), left2, True)] + ([((s[i - 2], s[i - 1]), c3, in3.get((s[i - 2], s[i - 1]), 0), left3, c2[s[i - 2], s[i - 1]] >= least)] if i > 1 else [])):
                if not kept:
                    continue
                k = counts[(*context, w)]
                key = context if len(context) > 1 else context[0]
                p = (byte((k - d) / total) if k >= least else 0.0) + (byte(max(1 - left[key], 1e-10)) if key in left else 1.0) * p
            score += math.log10(min(p, 1.0))
        out.append((len(t) + 1, known, base, score))
    return n, out


@pytest.mark.parametrize(("block", "portion", "least"), [(2_000_000, 1_000_000, 2), (150, 400, 2), (2_000_000, 1_000_000, 1), (150, 400, 1)])
def test_trie_scores_against_dictionaries(documents, monkeypatch, block, portion, least):
    monkeypatch.setattr(ngram_trie, "BLOCK", block)
    monkeypatch.setattr(ngram_trie, "PORTION", portion)
    monkeypatch.setattr(ngram_trie, "WORDS_BLOCK", 50)
    held = held_out(10, 0)
    rows = documents.select("doc_id", "text", held.alias("held")).collect()
    words = lambda t: (t or "").encode().lower().split()
    n, want = plain_scores([words(r["text"]) for r in rows if not r["held"]], [words(r["text"]) for r in rows], least)
    got = ngram_trie.learn_and_score(documents, held, least).collect()
    assert {r["train_tokens"] for r in got} == {n}
    a = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    b = sorted((x[0], x[1], round(x[2], 6), round(x[3], 6)) for x in want)
    assert np.allclose(np.array(a), np.array(b), atol=2e-6)
    apart = ngram_trie.score(documents, ngram_trie.learn(documents.where(~held), least)).collect()
    assert np.allclose(np.array(sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in apart)), np.array(a))


def test_trie_without_training_text(nothing, documents):
    got = ngram_trie.score(documents, ngram_trie.learn(nothing))
    assert got.agg(F.max(F.abs("score"))).first()[0] == 0 and got.count() == documents.count()
    assert ngram_trie.learn_and_score(documents, F.lit(True)).agg(F.max(F.abs("score"))).first()[0] == 0
    assert ngram_trie.learn_and_score(nothing, F.lit(True)).count() == 0


def test_elias_fano_runs(tmp_path):
    rng = np.random.default_rng(1)
    for keys in (np.unique(rng.integers(0, 1 << 62, 9000)), np.unique(np.concatenate([rng.integers(0, 1 << 40, 500), (5 << 38) + np.arange(6000)])), np.array([7]), np.arange(5000)):
        row = ngram_trie._level_row(0, keys.astype(np.int64), np.arange(len(keys)) % 300, [], np.zeros(0)).iloc[0]
        folder = tmp_path / str(len(keys))
        folder.mkdir()
        for name in ("value", "large_at", "large", *ngram_trie.ARRAYS):
            (folder / name).write_bytes(row[name])
        level = ngram_trie.Level(str(folder))
        assert (level.find(keys) == np.arange(len(keys))).all() and (level.counts(np.arange(len(keys))) == np.arange(len(keys)) % 300).all()
        assert (level.find(np.setdiff1d(keys + 1, keys)) == -1).all()


def softly(docs, domain="lang", learnt=None):
    """Posteriors of all documents and the domains."""
    rows = mixing.measured(docs, domain)
    domains = learnt or mixing.learn_domains(rows)
    return mixing.soft_members(rows, domains), domains


def test_mixing_meets_targets(spark, documents, nothing):
    rng = random.Random(9)
    rows = [(i, prose(rng, w, 60), n) for i in range(90) for n, w in [(("en", EN), ("en", EN), ("de", DE), ("fr", FR))[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    soft, domains = softly(docs)
    mix = mixing.fit(soft, domains, {"en": 1.0, "de": 2.0, "fr": 1.0})
    assert np.allclose(mix.totals, mix.targets, rtol=1e-4)
    got = mixing.rates(soft, mix)
    assert got.where("rate < 0").count() == 0
    sums = got.select(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[k]).alias(str(k)) for k in range(3))).first()
    assert np.allclose(list(sums), mix.targets, rtol=1e-4)
    assert mixing.mixed(docs, "lang", power=0.5).select("doc_id").distinct().count() == 90  # no document is taken away
    odd, domains = softly(documents)
    assert mixing.rates(odd, mixing.fit(odd, domains, power=0.7)).count() == documents.count() and mixing.mixed(documents, "lang", power=0.7).columns == documents.columns
    empty, domains = softly(nothing)
    assert mixing.rates(empty, mixing.fit(empty, domains)).count() == 0


def test_plans_do_not_hold_the_weights_of_the_domains(spark):
    """Two domains' weights are 8192 numbers; the driver's plans stay small whatever they are."""
    rows = [(i, prose(random.Random(i), EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(40)]
    measured = mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang")
    found = mixing.learn_domains(measured).posteriors(measured.select("row", "words"), "row", "words")
    assert len(found._jdf.queryExecution().toString()) < 50_000
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in found.collect())


def test_rows_come_as_often_as_their_rates_say(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, w, 50), n) for i in range(200) for n, w in [(("en", EN), ("en", EN), ("en", EN), ("fr", FR))[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    soft, domains = softly(docs)
    rates = {r["doc_id"]: r["rate"] for r in mixing.rates(soft, mixing.fit(soft, domains, {"en": 1.0, "fr": 1.2})).collect()}
    often = Counter(r["doc_id"] for r in mixing.mixed(docs, "lang", {"en": 1.0, "fr": 1.2}).collect())
    assert all(math.floor(rate + 1e-6) <= often[i] <= math.ceil(rate - 1e-6) for i, rate in rates.items())
    assert abs(sum(often.values()) - sum(rates.values())) < 40 and len({often[i] for i in rates}) > 2


def test_mixing_by_power_takes_no_document_away(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, EN + DE if i % 3 else EN, 40), "mixed" if i % 3 else ("en" if i % 2 else "en2")) for i in range(400)]  # domains overlap
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    soft, domains = softly(docs)
    mix = mixing.fit(soft, domains, power=0.3)
    got = mixing.rates(soft, mix)
    assert got.where("rate < 1").count() == 0 and got.where("rate > 1.01").count() > 0
    assert {r["doc_id"] for r in mixing.mixed(docs, "lang", power=0.3).select("doc_id").collect()} == set(range(400))
    # the totals that fit has counted are those of the rates
    size = len(mix.targets)
    sums = got.select(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[k]).alias(str(k)) for k in range(size))).first()
    before = got.select(*(F.sum(F.col("n_tokens") * F.col("posterior")[k]).alias(str(k)) for k in range(size))).first()
    assert np.allclose(list(sums), mix.totals, rtol=1e-6)
    gap = lambda x: ((np.array(list(x)) - mix.targets) ** 2).sum()
    assert gap(sums) < gap(before)


RU = "и в не на что он как это по но они мы все она так его было только быть есть".split()
UK = "і в не на що він як це по але вони ми всі вона так його було тільки бути є".split()


@pytest.mark.parametrize("domains", [{"en": EN, "ru": RU, "uk": UK}, {"zh": list("的一是不了人我在有他这中大来上"), "ja": list("のにはをたがでてとしれさある日本"), "en": EN}, {"news": EN[:12] + ["minister", "election"], "code": EN[:12] + ["return", "import"]}])
def test_mixing_tells_any_domains_apart(spark, domains):
    """Other scripts, scripts without blanks, and domains of one language: what is learnt from some rows holds for others."""
    rng = random.Random(3)
    unspaced = ("zh", "ja")
    rows = [(i, ("" if n in unspaced else " ").join(rng.choice(w) for _ in range(60)), n) for i in range(150) for n, w in [list(domains.items())[i % len(domains)]]]
    docs = mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang")
    learnt = mixing.learn_domains(docs.where("doc_id % 4 < 2"))
    soft = mixing.soft_members(docs, learnt)
    got = mixing.rates(soft.where("doc_id % 4 >= 2"), mixing.fit(soft, learnt)).select("doc_id", "domain").collect()
    assert got and all(r["domain"] == rows[r["doc_id"]][2] for r in got)


def test_mixing_against_a_plain_solver(spark):
    """Overlapping domains and targets that some rates at zero must meet: as near as long projected-gradient descent comes."""
    rng = random.Random(6)
    shared = EN[:10]
    rows = [(i, prose(rng, shared + (EN[10:] if n == "a" else DE if n == "b" else FR), rng.randrange(5, 60)), n) for i in range(120) for n in ["aab"[i % 3] if i % 5 else "c"]]
    soft, domains = softly(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for weights in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.02, "b": 0.03, "c": 0.95}):
        mix = mixing.fit(soft, domains, weights, max_steps=60)
        got = mixing.rates(soft, mix).collect()
        p, t = np.array([r["posterior"] for r in got]), np.array([float(r["n_tokens"]) for r in got])
        a = (p * t[:, None]).T
        rate, step = np.ones(len(t)), 1 / np.linalg.norm(a @ a.T, 2)
        for _ in range(20_000):
            rate = np.maximum(0, rate - step * a.T @ (a @ rate - mix.targets))
        least = np.linalg.norm(a @ rate - mix.targets)
        mine = np.linalg.norm(a @ np.array([r["rate"] for r in got]) - mix.targets)
        assert min(r["rate"] for r in got) >= 0 and mine <= least + 0.01 * sum(mix.targets)


def test_too_many_domains_are_an_error(spark, monkeypatch):
    docs = mixing.measured(spark.createDataFrame([(i, "a b", str(i)) for i in range(4)], "doc_id long, text string, lang string"), "lang")
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    with pytest.raises(ValueError, match="more than 3 domains"):
        mixing.learn_domains(docs)


def plain_likelihood(model, features, chosen):
    """Penalised log-likelihood of the best proportions of some languages, by long expectation-maximisation."""
    values, counts = np.unique(features, return_counts=True)
    w, shares = counts / langid.EVERY, np.exp(model.logs[values][:, chosen])
    pi = np.full(len(chosen), 1 / len(chosen))
    for _ in range(3000):
        joint = shares * pi
        joint *= (w / joint.sum(axis=1))[:, None]
        pi = joint.sum(axis=0) / w.sum()
    return float(w @ np.log(shares @ pi)) - langid.PENALTY * math.log(max(w.sum(), 2.0)) / 2 * (len(chosen) - 1), pi


def test_language_sets_against_all_subsets(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, w, 40), n) for i in range(60) for n, w in [(("en", EN), ("de", DE), ("fr", FR))[i % 3]]], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    texts = [" ".join(prose(rng, w, n) for w, n in zip(rng.sample([EN, DE, FR], k), rng.sample([15, 40, 90], k), strict=True)) for k in (1, 1, 2, 2, 2, 3, 3, 3)]
    for text in texts:
        own = langid.grams(text)
        subsets = [list(c) for k in (1, 2, 3) for c in itertools.combinations(range(3), k)]
        best = max(subsets, key=lambda c: plain_likelihood(model, own, c)[0])
        got = langid.mixtures(model, [own])[0]
        kept = np.flatnonzero(got > 0).tolist()
        assert plain_likelihood(model, own, kept)[0] >= plain_likelihood(model, own, best)[0] - 1.0
        assert np.abs(got[kept] - plain_likelihood(model, own, kept)[1]).max() < 0.05


def test_equal_languages_tie_to_the_first_name(spark):
    docs = spark.createDataFrame([(i, "same words in both", n) for i, n in enumerate(["zz", "aa"])], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert {r["lang_pred"] for r in got} == {"aa"}


def test_gradient_of_the_ordinal_fit_vanishes():
    """The weights and thresholds found are a stationary point of the penalised log-likelihood, by finite differences."""
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(800)]
    latent = np.array([(r * 0.7 - 1).sum() for r in rows]) + rng.logistic(size=800)
    grades = np.digitize(latent, [-0.5, 1.0, 2.0])
    l2 = 1e-4
    weights, cuts = toxicity.fit_cumulative_link(rows, grades, 5, steps=3000, rate=0.03, l2=l2)

    def value(theta):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            above = [1.0, *(1 / (1 + math.exp(-(theta[:5][r].sum() - c))) for c in theta[5:]), 0.0]
            total += math.log(above[g] - above[g + 1])
        return total / len(rows) - l2 / 2 * (theta[:5] ** 2).sum()

    theta = np.concatenate([weights, cuts])
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-4
        assert abs(value(theta + step) - value(theta - step)) / 2e-4 < 2e-3


def test_grades_come_from_the_other_folds():
    """A word that only the document's own fold has seen gives it no evidence."""
    rows = [np.array([0]), np.array([0, 1]), np.array([2]), np.array([0]), np.array([], int)]
    toxic, fold = np.array([1, 1, 1, 1, 0]), np.array([0, 1, 2, 1, 0])
    ns = np.array([[1.0, 2, 0], [0, 1, 0], [0, 0, 1]])
    got = toxicity.cross_fitted_grades(rows, toxic, fold, ns, ns, 4)
    assert got[4] == 0 and (got[:4] >= 1).all() and got.max() <= 3
    swapped = toxicity.cross_fitted_grades(rows, toxic, fold, ns, ns * np.array([1, 1, 0]), 4)
    assert swapped[2] == got[2]  # document 2's own fold doesn't count for it


def plain_scores_of(model, x):
    out = []
    for row in x:
        total, bins = model.intercept, []
        for f, edges in enumerate(model.edges):
            bins.append(sum(row[f] >= e for e in edges))
            total += model.tables[f][bins[-1]]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bins[i] * gam.COARSE // gam.BINS][bins[j] * gam.COARSE // gam.BINS]
        out.append(1 / (1 + math.exp(-total)))
    return out


def test_quality_scores_and_cuts_against_plain_loops():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = gam.fit_additive(x, y)
    assert np.allclose(model.scores(x[:80]), plain_scores_of(model, x[:80]))
    for _ in range(20):  # the best cut of a histogram by trying all of them
        n = rng.integers(0, 60, 12).astype(float)
        g, h = rng.normal(size=12) * n, rng.random(12) * n
        best = (0.0, 0)
        for at in range(1, 12):
            if n[:at].sum() >= gam.LEAF_ROWS and n[at:].sum() >= gam.LEAF_ROWS:
                gain = sum(a.sum() ** 2 / (b.sum() + gam.RIDGE) for a, b in ((g[:at], h[:at]), (g[at:], h[at:]))) - g.sum() ** 2 / (h.sum() + gam.RIDGE)
                if gain > best[0] + 1e-12:
                    best = (gain, at)
        got = gam._cut(g, h, n)
        assert got[1] == best[1] and abs(got[0] - best[0]) < 1e-9
