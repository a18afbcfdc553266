"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tesseraql.llm import simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("many", [simhash.MANY, 1])
def test_links_of_planted_fingerprints(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)  # short and wide segments
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:120]:  # chains and clusters at all distances
        for _ in range(rng.randint(1, 4)):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(np.uint64(f).view(np.int64).item(),) for f in fps], "fp long")
    index = {np.uint64(f).view(np.int64).item(): n for n, f in enumerate(fps)}
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in simhash.links(df).collect():
        assert (index[a] != index[b]) and bin(fps[index[a]] ^ fps[index[b]]).count("1") <= 4
        x, y = sorted((root(index[a]), root(index[b])))
        label[y] = x
    want = brute_components(range(len(fps)), fps)
    assert [root(n) for n in range(len(fps))] == want


def test_a_dense_group_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base = random.Random(1).getrandbits(64)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(40, 64)})
    df = spark.createDataFrame([(np.uint64(f).view(np.int64).item(),) for f in fps], "fp long")
    from tesseraql.llm.components import components

    roots = components(simhash.links(df)).collect()
    assert len(roots) == len(fps) and len({r.root for r in roots}) == 1


def test_documents(spark):
    rng = random.Random(7)
    words = ["w%d" % n for n in range(60)]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 60, 300])))) for n in range(120)]
    rows += [(200 + n, t + (" extra" if n % 2 else "")) for n, (_, t) in enumerate(rows[:40])]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One Two"), (304, "one\ttwo"), (303, "One Two"), (305, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, fp long").repartition(5)
    got = {}
    for r in simhash.near_duplicates(df).collect():
        got.setdefault(r.doc_id, set()).add((np.int64(r.fp).view(np.uint64).item(), r.component_id))
    ids = [i for i, _ in rows]
    fps = [brute_fingerprint(t) for _, t in rows]
    for i, f, c in zip(ids, fps, brute_components(ids, fps)):
        assert got[i] == {(f, c)}


def test_one_of_each(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, None), (8, ""), (7, "quite another text of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [3, 7, 8]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "other words here too")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
