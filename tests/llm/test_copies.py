"""Exact deduplication and the n-gram join against plain versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, ngram_join
from tidemark.llm.components import components
from tidemark.llm.shingles import text_bytes, word_hashes


def key(x):
    return -1 if x is None else x


def test_copy_groups(documents):
    groups = defaultdict(list)
    for r in documents.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    got = exact_dedup.copy_groups(documents).collect()
    assert len(got) == documents.count()
    digest = {hashlib.sha256(t.encode()).hexdigest(): (max(ids, key=key), len(ids)) for t, ids in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == digest[r["text_sha256"]] and r["kept"] == (r["doc_id"] == r["keep_id"])


def test_texts_that_share_a_digest_are_told_apart(documents):
    same = lambda text: F.lit("one digest for all").cast("binary")
    a = sorted((tuple(r) for r in exact_dedup.copy_groups(documents).collect()), key=str)
    assert a == sorted((tuple(r) for r in exact_dedup.copy_groups(documents, same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_drop_copies_keeps_one_whole_row(documents):
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    rows = kept.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in documents.collect()})
    whole = {tuple(r) for r in documents.collect()}
    assert all(tuple(r) in whole for r in rows)


def plain_components(rows):
    """component of each (doc_id, text) by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        both = len(x & y)
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)]


def matches_all_pairs(docs):
    """Components are those of all pairs of rows, whatever their ids."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.link_documents(docs).collect()
    return sorted(map(tuple, got), key=str) == sorted(plain_components(rows), key=str)


def test_join_against_all_pairs(documents):
    assert matches_all_pairs(documents)


def test_rows_without_id_and_with_one_id_link_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in (0, 59)]
    z = " ".join(f"z{i}" for i in range(40))
    big = (1 << 60) + 1
    rows = [(1, " ".join(words)), (1, z), (None, near[0]), (2, z + " end"), (big, near[1]), (None, "alone without id in this table"), (None, z + " end more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert matches_all_pairs(docs)
    kept = {(r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs).collect()}
    assert kept == {rows[0], rows[1], rows[5]}
    bridge = spark.createDataFrame([(10, near[0]), (None, " ".join(words)), (5, near[1])], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.link_documents(bridge).collect()} == {5}


def test_one_row_of_a_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(3, base), (3, base), (3, near), (4, base), (None, near), (7, ""), (7, ""), (None, None), (8, " ")]
    kept = sorted(map(tuple, ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert len(kept) == 5 and kept[0][0] == 3 and kept[0][1] in (base, near) and sorted(kept[1:], key=str) == sorted(rows[5:], key=str)
    no_ids = [(None, base), (None, near), (None, base)]
    assert ngram_join.keep_first(spark.createDataFrame(no_ids, "doc_id long, text string")).count() == 1


def test_crafted_words_are_told_apart(spark):
    def thue_morse(n):
        return "".join("ab"[bin(i).count("1") % 2] for i in range(n))

    turn = str.maketrans("ab", "ba")
    words = [w for n in (8, 64, 256, 512, 1024, 4096) for w in (thue_morse(n), thue_morse(n).translate(turn))]
    raw = np.frombuffer("\n".join(words).encode(), np.uint8)
    assert len(set(word_hashes(raw, np.zeros(1, np.int64))[0].tolist())) == len(words)
    assert matches_all_pairs(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"))


def test_word_hashes_follow_words_not_places():
    texts = ["The  cat\tsat", "the", "", " CAT ", "sat" * 300, "x" + "é" * 9, "éX", "a\u00a0b"]
    raw, edges = text_bytes(pa.array([*texts, None]))
    whole, first = word_hashes(raw, edges[:-1])
    spelt = [w for t in texts for w in t.encode().lower().split()]
    assert len(whole) == len(spelt) == len(first)
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip(spelt, whole.tolist(), strict=True)) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("frequent", [False, True])
def test_a_large_group_of_near_copies_beside_boilerplate(spark, monkeypatch, frequent):
    """A group whose members are near, or just not near, one another, and others that share a passage with all of them."""
    if frequent:  # all shingles of the group are among those that aren't counted
        monkeypatch.setattr(ngram_join, "OFTEN", 20)
        monkeypatch.setattr(ngram_join, "PORTION", 20_000)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(90)] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(50)]
    rows += [(1000 + i, " ".join([*passage, *(f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(4, 14)))])) for i in range(300)]
    assert matches_all_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_pairs_whose_first_shingles_tell_them_apart_are_not_compared(spark, monkeypatch):
    """Texts of different groups that share their rarest passage and nothing else: none is compared by its whole set, and no link is lost."""
    rows = []
    for g in range(12):  # each passage is in two texts, all else of a group in three
        words = [f"g{g}w{i}" for i in range(90)]
        passage = [f"p{g // 2}x{i}" for i in range(5)]
        rows += [(3 * g, " ".join(words + passage)), (3 * g + 1, " ".join(words)), (3 * g + 2, " ".join([*words, "end"]))]
    compared, lost, held = [], [], []
    linked, promising, find_roots = ngram_join.linked, ngram_join.promising, ngram_join.find_roots

    def spied(pairs, first):
        kept = promising(pairs, first)
        compared.append((pairs.count(), kept.count()))
        lost.append(linked(pairs, held[0]).exceptAll(linked(kept, held[0])).count())
        return kept

    monkeypatch.setattr(ngram_join, "find_roots", lambda lists, first, sets: held.append(sets) or find_roots(lists, first, sets))
    monkeypatch.setattr(ngram_join, "promising", spied)
    assert matches_all_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    met, kept = map(sum, zip(*compared, strict=True))
    assert sum(lost) == 0 and met - kept >= 6


def test_a_text_of_some_megabytes(spark):
    rng = random.Random(1)
    words = [f"q{rng.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1000], *("tail" for _ in range(1000))])), (3, "y" * 2_000_000), (4, "Y" * 2_000_000), (5, "y" * 1_999_999)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_chains_of_near_copies_are_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):  # neighbours are near, the ends of the chain aren't
        rows.append((1000 - i, " ".join(words)))
        words = words[1:] + [f"x{i}"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.link_documents(docs).collect()) == sorted(plain_components(rows))


def test_links_at_the_threshold(spark):
    rows = []
    for changed in range(14):
        words = [f"c{changed}w{i}" for i in range(104)]  # 100 shingles
        rows += [(2 * changed, " ".join(words)), (2 * changed + 1, " ".join(words[changed:] + [f"c{changed}y{i}" for i in range(changed)]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for changed in range(14):
        assert (got[2 * changed + 1] == 2 * changed) == (100 * (100 - changed) >= 80 * (100 + changed))


def test_components_of_a_ring_and_a_star(spark):
    edges = [(i, (i + 1) % 50) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 50)) and all(got[i] == 100 for i in range(101, 160)) and 200 not in got


def test_no_documents(nothing):
    assert exact_dedup.copy_groups(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0
    assert ngram_join.link_documents(nothing).count() == 0 and ngram_join.keep_first(nothing).count() == 0
