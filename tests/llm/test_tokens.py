"""Shared tokenising against plain Python."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseraql.llm.tokens import Words, text_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\x1c é中😀")), max_size=30)), max_size=8), st.integers(1, 40))
def test_words(texts, limit):
    column = pa.array(texts, pa.string())
    found, names = {}, {}
    for row, end, raw, offs in text_chunks(column, limit):
        w = Words(raw, offs)
        h, low = w.hashes(), w.hashes(lower=True)
        for d in range(end - row):
            a, b = w.first[d], w.first[d + 1]
            found[row + d] = [bytes(raw[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
            for word, x, y in zip(found[row + d], h[a:b].tolist(), low[a:b].tolist()):
                assert names.setdefault(word, x) == x
                assert names.setdefault(("low", re.sub("[A-Z]", lambda m: m[0].lower(), word)), y) == y
    assert [found.get(n, []) for n in range(len(texts))] == [WORD.findall(t or "") for t in texts]
    plain = [v for k, v in names.items() if isinstance(k, str)]
    assert len(set(plain)) == len(plain)


def test_sliced_and_large_columns():
    column = pa.array(["a b", None, "c", ""], pa.large_string()).slice(1)
    (row, end, raw, offs), = text_chunks(column)
    assert (row, end, bytes(raw), offs.tolist()) == (0, 3, b"c", [0, 0, 1, 1])
