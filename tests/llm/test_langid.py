"""Phrase counts against a direct search; accuracy on held-out rows."""

import pytest

from tesseraql.llm import langid

SF = "/root/testdata/sf0.01"


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_side_by_side_and_alone():
    samples = {"x": "the cat sat on the mat with a hat", "y": "der hund lag auf der matte mit hut", "z": "le chat était là"}
    parser = langid.CrossParser(samples)
    texts = ["the hat sat", "auf der matte", "qqq", "là", "a" * 300, "the mat with the cat on it " * 9] * 20
    coded = [parser.codes(t) for t in texts]
    want = [[phrases(langid.symbols(t), samples[k]) for k in parser.langs] for t in texts]
    assert parser.phrases(coded).tolist() == want  # many texts: side by side, the longest alone at the end
    assert [parser.phrases([c])[0].tolist() for c in coded[:6]] == want[:6]
    assert parser.predict(["the cat", None, "", "123 !", "der hund"])[0] == ["x", "und", "und", "und", "y"]


@pytest.mark.parametrize("piece", [1, 2, 5, 37])
def test_pieces_are_stitched_exactly(monkeypatch, piece):
    import random

    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(piece)
    letters = "abcd "
    samples = {k: "".join(rng.choice(letters) for _ in range(80)) for k in "xyz"}
    parser = langid.CrossParser(samples)
    texts = ["".join(rng.choice(letters + "q") for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["", "a", "q" * 30]
    want = [[phrases(langid.symbols(t), samples[k]) for k in parser.langs] for t in texts]
    assert parser.phrases([parser.codes(t) for t in texts]).tolist() == want


def test_learning_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    parser = langid.learn(empty)
    assert parser.predict(["abc"]) == (["und"], [0.0])
    df = spark.createDataFrame([(1, "abc abc", "a"), (2, None, "a"), (3, "xyz xyz", None), (4, "!!", "b"), (5, "klm klm", "c"), (5, "klm klm", "c")], "doc_id long, text string, lang string")
    parser = langid.learn(df)
    assert parser.langs == ["a", "c"]
    named = df.withColumnRenamed("lang", "lang_pred")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(named, parser).collect()}
    assert got == {(1, "a"), (2, "und"), (3, "a"), (4, "und"), (5, "c")}


@pytest.mark.parametrize("floor", [0.97])
def test_held_out_accuracy(spark, floor):
    rows = langid.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > floor
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_table_follows_the_text_not_the_alphabet():
    """Many letters and many languages: the size is that of the transitions."""
    import random

    rng = random.Random(4)
    wide = {f"z{k}": "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(9000)) for k in range(3)}
    parser = langid.CrossParser(wide)
    assert len(parser.code) > 5500 and parser.table.nbytes < 3 * 9000 * 3 * 8 * 2
    texts = [wide["z1"][500:560], "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(50)), "abc"]
    want = [[phrases(langid.symbols(t), wide[k]) for k in parser.langs] for t in texts]
    assert parser.phrases([parser.codes(t) for t in texts]).tolist() == want
    many = {f"l{k:02}": "".join(rng.choice("abcdefgh ") + chr(97 + k % 26) for _ in range(400)) for k in range(50)}
    parser = langid.CrossParser(many)
    texts = [many["l07"][100:160], "qrs tuv"]
    want = [[phrases(langid.symbols(t), many[k]) for k in parser.langs] for t in texts]
    assert parser.phrases([parser.codes(t) for t in texts]).tolist() == want


def test_a_long_text_gives_no_more_than_its_share(spark):
    rows = [(n, " ".join(f"w{n}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(40)), "a") for n in range(60)] + [(99, "zzz " * 50_000, "a"), (100, "other", "b"), (None, "third", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    real, langid.CrossParser = langid.CrossParser, lambda samples: seen.update(samples)
    try:
        langid.learn(df, sample_symbols=3000, sample_docs=30)
    finally:
        langid.CrossParser = real
    assert set(seen) == {"a", "b", "c"} and seen["b"] == "other"
    assert 2900 < len(seen["a"]) < 3100 and seen["a"].count("zzz") <= 60
