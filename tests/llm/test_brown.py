"""Counts and base scores against plain Python; the model is a probability and beats the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesseraql.llm import brown

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [None]


@pytest.fixture(scope="module")
def scored(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, brown.op7_language_model(spark, SF).collect()


def test_counts_and_base(scored):
    docs, rows = scored
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(t for i, text in docs.items() if not held[i] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)


def test_held_out_texts_score_better_than_the_base(scored):
    _, rows = scored
    held = [r for r in rows if r.held_out]
    per = lambda f: sum(f(r) for r in held) / sum(r.n_tokens for r in held)
    assert per(lambda r: r.score) > per(lambda r: r.base_score) + 0.6
    assert all(r.score < 0 and r.perplexity > 1 for r in rows)


def test_words_own_classes_beat_their_suffix_groups(spark, scored, monkeypatch):
    """Held-out perplexity against the model in which all but the commonest words keep the class of their suffix group."""
    _, rows = scored
    monkeypatch.setattr(brown, "MOVE", 1e9)
    held = brown.remainder("doc_id", 7) == 2
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, words = brown.train(docs.where(~held).select("text"))
    plain = {r.doc_id: r.score for r in brown.score(docs, model, words).collect()}
    mine = [r for r in rows if r.held_out]
    tokens_ = sum(r.n_tokens for r in mine)
    assert sum(r.score - plain[r.doc_id] for r in mine) / tokens_ > 0.03


def frame(spark, texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")


def test_probabilities_add_up(spark):
    texts = ["the cat sat", "the dog sat", "a cat ran off", "The dog", "rare words stand here once", None, ""]
    df = frame(spark, texts)
    model, words = brown.train(df.select("text"), classes=4, rounds=2)
    known = sorted({w for t in texts for w in tokens(t) if w is not None})
    for before in ("", "the", "cat"):
        # every unit after this word
        units = model.units
        first = units.end if not before else int(units.of(np.array([next(iter_names(before))], np.uint64), np.array([shape_of(before)]))[0])
        row = 10 ** model.step[model.of[first]]
        share = np.zeros(units.count)
        np.add.at(share, np.arange(units.count), row[model.of] * 10**model.emit)
        assert math.isclose(share.sum(), 1.0, rel_tol=1e-9)
        # within a group: seen words and the unseen one
        inside = 10 ** (-model.within) * (10**model.unseen + np.bincount([shape_of(w.decode()) for w in known if not is_unit(model, w.decode())], [counts(texts)[w] for w in known if not is_unit(model, w.decode())], brown.SHAPES))
        assert np.allclose(inside, 1.0)


def iter_names(word):
    for _, _, names, _, _ in brown._tokens(pa.array([word])):
        yield names[0]


def shape_of(word):
    for _, _, _, shapes, _ in brown._tokens(pa.array([word])):
        return int(shapes[0])


def is_unit(model, word):
    return bool(np.isin(next(iter_names(word)), model.units.words))


def counts(texts):
    return Counter(w for t in texts for w in tokens(t) if w is not None)


def test_rare_words_are_joined(spark, monkeypatch):
    texts = ["alpha beta gamma alpha", "alpha delta", "zeta", None, "Alpha  beta\tnever seen"]
    df = frame(spark, texts)
    model, words = brown.train(df.select("text"), classes=3, rounds=1)
    want = sorted(map(tuple, brown.score(df, model, words).collect()))
    monkeypatch.setattr(brown, "DICTIONARY", 4)  # most words now come through the join
    monkeypatch.setattr(brown, "WORD_UNITS", 4)
    small, table = brown.train(df.select("text"), classes=3, rounds=1)
    assert len(small.words) < len(model.words)
    got = sorted(map(tuple, brown.score(df, small, table).collect()))
    for a, b in zip(want, got):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    # the same texts cut off from the dictionary alone score the same
    monkeypatch.setattr(brown, "DICTIONARY", 1 << 21)
    full, table = brown.train(df.select("text"), classes=3, rounds=1)
    assert [round(r[6], 9) for r in sorted(map(tuple, brown.score(df, full, table).collect()))] == [round(r[6], 9) for r in got]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "x " * 20_000)], "doc_id long, text string")
    model, words = brown.train(df.select("text"), classes=3, rounds=1)
    rows = brown.score(df, model, words).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (1, 3), (1, 3), (2, 20_001)]
    none, empty = brown.train(df.select("text").limit(0), classes=3, rounds=1)
    assert all(math.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in brown.score(df, none, empty).collect())
    assert brown.score(df.limit(0), model, words).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    units, classes = 12, 3
    truth = np.arange(units) % classes
    big = rng.poisson(0.3 + 20 * (truth[:, None] == (truth[None, :] + 1) % classes)).astype(float)

    def value(of):
        n = np.zeros((of.max() + 1,) * 2)
        np.add.at(n, (np.repeat(of, units), np.tile(of, units)), big.reshape(-1))
        x = lambda m: (m * np.log(np.maximum(m, 1))).sum()
        return x(n) - x(n.sum(0)) - x(n.sum(1))

    of = np.array([n if n < classes else classes for n in range(units)])
    values = []
    for _ in range(6):
        of = brown.exchange(of, big, classes)
        values.append(value(of))
    assert values == sorted(values) and values[-1] >= value(truth) - 1e-6
    # no single move is better once a round moves none
    assert (brown.exchange(of, big, classes) == of).all()
    for w in range(units):
        assert max(value(np.where(np.arange(units) == w, c, of)) for c in range(classes)) <= values[-1] + 1e-6


def test_every_training_word_is_placed_by_its_own_neighbours(spark, monkeypatch):
    """Words with one ending get apart when their neighbours differ; scores are those of the classes, however words are looked up."""
    monkeypatch.setattr(brown, "WORD_UNITS", 5)
    texts = [f"the {w}king {v}" for w in ("bla", "cla") for v in ("ran", "sat") for _ in range(30)] + [f"{v} {w}king the" for w in ("dra", "fra") for v in ("ran", "sat") for _ in range(30)]
    texts += [t for v in ("ran", "sat") for t in (f"the big {v}", f"{v} old the") for _ in range(100)]
    texts += ["the blaking draking claking the", "unseenking claking blaking ran", None]
    df = frame(spark, texts)
    for words_broadcast in (1 << 21, 16):
        monkeypatch.setattr(brown, "DICTIONARY", words_broadcast)
        model, table = brown.train(df.select("text"), classes=5, rounds=3)
        klass = {r.word: r.klass for r in table.collect()}
        count = Counter(w for t in texts for w in tokens(t))
        number = lambda w: int(next(iter_names(w.decode())).view(np.int64))
        unit = {w: w is None or is_unit(model, w.decode()) for w in count}
        assert not unit[b"blaking"] and len(klass) == sum(not u for u in unit.values())
        of = {w: int(model.of[model.units.end if w is None else model.units.of(np.array([next(iter_names(w.decode()))]), np.array([0]))[0]]) if unit[w] else klass[number(w)] for w in count}
        assert of[b"blaking"] == of[b"claking"] != of[b"draking"] == of[b"fraking"]
        pairs, held = np.zeros((5, 5)), np.zeros(5)
        for t in texts:
            run = [of[w] for w in tokens(t)]
            np.add.at(pairs, ([of[None], *run[:-1]], run), 1)
            np.add.at(held, run, 1)
        once = np.zeros(brown.SHAPES)
        for w, n in count.items():
            if n == 1 and not unit[w]:
                once[shape_of(w.decode())] += 1
        groups = model.of[len(model.units.words) :]
        norm = held + np.bincount(groups, once, 5) + brown.DELTA * np.bincount(model.of, minlength=5)
        share = (pairs.sum(0) + 1) / (pairs.sum(0) + 1).sum()
        step = (pairs + brown.ALPHA * share) / (pairs.sum(1, keepdims=True) + brown.ALPHA)
        for r in brown.score(frame(spark, [*texts, "the newking ran oldking otherking"]), model, table).collect():
            want, last = 0.0, of[None]
            for w in tokens([*texts, "the newking ran oldking otherking"][r.doc_id]):
                s = None if w in of else shape_of(w.decode())
                c = of[w] if s is None else int(groups[s])
                n = once[s] + brown.DELTA if s is not None else count[w] + (brown.DELTA if unit[w] else 0)
                want, last = want + math.log10(step[last, c] * n / norm[c]), c
            assert math.isclose(r.score, want, rel_tol=1e-9)


def test_assign_takes_the_class_of_the_greatest_likelihood():
    rng = np.random.default_rng(3)
    words, classes = 14, 4
    big = rng.poisson(0.8, (words, words)).astype(float)
    of = rng.integers(0, classes, words)

    def value(of):
        n = np.zeros((classes, classes))
        np.add.at(n, (np.repeat(of, words), np.tile(of, words)), big.reshape(-1))
        x = lambda m: (m * np.log(np.maximum(m, 1))).sum()
        return n, x(n) - x(n.sum(0)) - x(n.sum(1))

    left, right = (np.array([np.bincount(of, m[w], classes) for w in range(words)]) for m in (big.T, big))
    got = brown.assign(value(of)[0], of, left, right, np.diag(big).copy())
    for w in range(words):
        tries = [value(np.where(np.arange(words) == w, c, of))[1] for c in range(classes)]
        assert math.isclose(tries[got[w]], max(tries), rel_tol=1e-9)
