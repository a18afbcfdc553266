"""Hits against the edit distance to every stretch of a text."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tesseraql.llm.decontaminate import Block, contaminated, masks, myers, normal


def least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60))
def test_myers(pattern, text):
    assert myers(masks(pattern), len(pattern), text)[0] == least(pattern, text)


def test_search_finds_all_within_budget_and_no_more():
    rng = random.Random(2)
    hits = 0
    for _ in range(500):
        letters = rng.choice(["ab ", "abcdefgh "])
        items = [(i, normal("".join(rng.choice(letters) for _ in range(rng.randint(1, 90))))) for i in range(4)]
        doc = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 10)):
            k, way = rng.randint(0, len(t)), rng.random()
            if way < 0.3 and k < len(t):
                t[k] = rng.choice(letters)
            elif way < 0.6:
                t.insert(k, rng.choice(letters))
            elif k < len(t):
                del t[k]
        at = rng.randint(0, len(doc))
        doc = normal(doc[:at] + "".join(t) + doc[at:])
        found = Block(items, 0.1).search(doc)
        for n, (_, text) in enumerate([x for x in items if x[1]]):
            d = least(text, doc)
            inside = d <= int(0.1 * len(text))
            hits += inside
            assert inside == (n in found) and (not inside or found[n][0] == d)
    assert hits > 200


def test_frames_and_blocks(spark):
    items = [(n, f"item number {n} asks about the {'abcdefghij'[n] * 9} of the world and its history") for n in range(10)] + [(50, None), (51, "")]
    docs = [(1, "Before. ITEM number 3 asks, about the ddddddddd of the world and its history! After"), (2, "item number 4 asks abuot the eeeeeeeee of a world and its history"), (3, "nothing here"), (4, None), (5, ""), (5, "item number 7 asks"), (None, items[9][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, n) for i, t in docs for n, x in items if x and least(normal(x), normal(t)) <= int(0.1 * len(normal(x)))}
    for chars in (4_000_000, 200):  # one block, and several
        got = {(r.doc_id, r.item_id) for r in contaminated(d, b, block_chars=chars).collect()}
        assert got == want and (1, 3) in got and (None, 9) in got
    assert contaminated(d, b.limit(0)).count() == 0 and contaminated(d.limit(0), b).count() == 0
