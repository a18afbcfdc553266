"""Removed words against a count of all windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesseraql.llm import substrings


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def run(spark, docs, window=35, parts=5):
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n_words string").repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, window=window).collect()), key=str)


@pytest.mark.parametrize("seed, window", [(1, 35), (2, 35), (3, 8), (4, 2), (5, 1)])
def test_planted_repeats(spark, seed, window):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmn") for _ in range(400)]
    docs = []
    for n in range(160):
        kind = rng.random()
        if kind < 0.3:
            w = [rng.choice("ab") if rng.random() < 0.3 else "a" for _ in range(rng.randint(0, 120))]
        elif kind < 0.6:
            a = rng.randint(0, 300)
            w = [str(rng.random()) for _ in range(rng.randint(0, 9))] + base[a : a + rng.randint(30, 90)] + [f"z{n}"] * rng.randint(0, 50) + base[50 : 50 + rng.randint(0, 60)]
        elif kind < 0.8:
            w = ["x", "y"] * rng.randint(0, 60) + ["p", "q", "r"] * rng.randint(0, 30)
        else:
            w = ["w"] * rng.randint(0, 80)
        docs.append((n, " \n".join(w) if rng.random() < 0.95 else None))
    docs += docs[:3] + [(0, "same id, other text")]
    assert run(spark, docs, window) == brute(docs, window)


def test_exact_borders(spark):
    long = [f"u{n}" for n in range(200)]
    shared = [f"s{n}" for n in range(35)]
    docs = [(1, " ".join(long[:50] + shared + long[50:80])), (2, " ".join(long[100:120] + shared + ["end"])), (3, " ".join(shared[:34] + ["other"])), (4, "short"), (5, "")]
    got = run(spark, docs)
    assert got == brute(docs, 35)
    assert [r[2] for r in got] == [35, 35, 0, 0, 0]


def test_one_long_text_and_no_text(spark):
    docs = [(1, " ".join(["loop", "of", "words"] * 8000)), (2, "y " * 100)]
    assert run(spark, docs) == brute(docs, 35)
    assert run(spark, []) == []


def test_missing_and_odd_ids(spark):
    """Rows without ids are told apart by their texts, however many there are."""
    shared = " ".join(f"s{n}" for n in range(40))
    texts = [f"only {n} " + " ".join(f"t{n}.{k}" for k in range(36)) for n in range(1500)] + [shared, shared + " more", "x " + shared]
    got = sorted((r.n_removed, r.n_words) for r in substrings.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 38)] * 1500 + [(40, 40), (40, 41), (40, 41)]
    named = spark.createDataFrame([("a", shared), (None, shared), ("b", "none")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_removed) for r in substrings.remove_repeats(named).collect()) == [("", 40), ("a", 40), ("b", 0)]


def test_texts_with_one_short_hash_keep_their_own_words(spark):
    """Different texts whose 32-bit hashes are equal, all without an id."""
    df = spark.range(400_000).selectExpr("concat('k', id, ' ', repeat(concat('w', id, ' '), 3)) as text")
    clash = [r.texts for r in df.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()]
    assert clash
    rows = []
    for a, b in clash:
        rows += [a, b, b]  # b repeats as a whole, a does not
    out = substrings.remove_repeats(spark.createDataFrame([(None, t) for t in rows], "doc_id long, text string"), window=4).collect()
    first = {a for a, _ in clash}
    assert all(r.n_removed == (0 if r.text in first else 4) for r in out)
