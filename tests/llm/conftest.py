import random

import pytest

EN = "the of and to in is that for it with as on by at from this which were are been have other time".split()
DE = "der die und das ist nicht mit dem ein auf für von sich werden über nach zwischen größe schön".split()
FR = "le la les des est que qui dans une pour par sur avec élève où être même très après français".split()


def prose(rng, words, n):
    made = [rng.choice(words) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n)]
    return " ".join(made).capitalize() + "."


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that tend to break things: null, empty, blank, long, with marks of all kinds."""
    return [None, "", " ", "\n\t ", "x", "word " * 3000, "a" * 5000, "naïve café — 日本語 emoji 🎉 don't <|endoftext|> 12,345", "é́     end", "Tab\tand\x0bfeed\x0c", "ΑΣ Σ ΣΑ", "\x00\x01", "<|endoftext|><|startoftext|> <|endof"]


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    """Documents with copies, near copies, shared passages, odd texts, nulls, repeated rows and clashing columns."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang, words = rng.choice([("en", EN), ("de", DE), ("fr", FR)])
        rows.append((i, prose(rng, words, rng.randrange(20, 120)), lang))
    for i in range(120, 150):
        rows.append((i, rows[rng.randrange(10)][1], "en"))  # exact copies
    for i in range(150, 180):
        w = rows[rng.randrange(40)][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "fr"))
    rows += [(200 + i, t, None) for i, t in enumerate(odd_texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en"), (None, None, None)]
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, node string, n int").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
