"""Measurements against plain Python; policies and ablations against row-by-row evaluation."""

import random
import re
from collections import Counter

from tesseraql.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "é " * 60, "x\nx\n\n x\nx", "| a | b |\n" * 30, "ab " * 30_000, "A B C A B C\x1cD"]
    for _ in range(150):
        out.append("".join(rng.choice(["a ", "b ", "Ab\n", "é# ", "\n", "\t", "$$ ", "中 ", "!! "]) for _ in range(rng.randint(0, 200))))
    return out


def test_measurements_and_base(spark):
    rows = texts()
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(rows)], "doc_id long, text string, n_words int").repartition(3)
    ledger = {r.doc_id: r for r in Q.ledger(df).collect()}
    for n, t in enumerate(rows):
        r, e = ledger[n], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, t
        assert bool(r.failed & 1) == (e[0] < 50)
        assert bool(r.failed & 2) == (100 * e[4] > 50 * e[0])
    assert Q.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts() + texts()[:20])], "doc_id long, text string")
    rows = Q.ledger(df)
    bits = [r.failed for r in rows.collect()]
    for version, rules in Q.POLICIES.items():
        mask = Q.mask(rules)
        assert rows.where(Q.kept(version)).count() == sum(not b & mask for b in bits)
        got = {r.rule: (r.failing, r.alone) for r in Q.ablations(rows, version).collect()}
        assert got == {r: (sum(bool(b & Q.mask((r,))) for b in bits), sum(b & mask == Q.mask((r,)) for b in bits)) for r in rules}


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.op9_quality(spark, sf).join(labels.groupBy("doc_id").max("quality").toDF("doc_id", "quality"), "doc_id").collect()
    assert docs.count() == 1000
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_policies_over_a_stored_ledger(spark, tmp_path):
    """Later policies and ablations read the ledger, not the texts."""
    texts = ["word " * 10, " ".join(f"w{n}" for n in range(80)), "| a " * 60, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = Q.store(df, f"file://{tmp_path}/ledger")
    assert "text" not in kept.columns
    want = {r.doc_id: r.failed for r in Q.ledger(df).collect()}
    assert {r.doc_id: r.failed for r in kept.collect()} == want
    for version in Q.POLICIES:
        passing = {r.doc_id for r in kept.where(Q.kept(version)).collect()}
        assert passing == {i for i, bits in want.items() if not bits & Q.mask(Q.POLICIES[version])} and 1 in passing
    alone = {r.rule: (r.failing, r.alone) for r in Q.ablations(kept).collect()}
    assert alone["few_words"][0] == 2
