"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of a word is the only token sequence whose tokens are each their own
encoding and whose neighbours are compatible (the pair is the encoding of its own text), and
each prefix of such a sequence is the encoding of that prefix.  So for every prefix one last
token is stored: among the vocabulary entries that end there (an Aho-Corasick automaton over the
vocabulary, whose suffix links are those of a suffix automaton of it, yields them), the one compatible with the last token of the prefix before it.  Following the
stored tokens back from the end gives the ids.  No merge loop runs over the word.

A worker remembers the ids of at most MEMO short words (those met lately) and, in a table of
PAIRS places that each hold the pair met last, which pairs are compatible: some 20 MB in all.

Cases: null text is encoded as an empty text; an empty text has no ids and decodes to ''; texts and words
of any length are encoded whole.
Repeated rows give repeated results; an empty table gives an empty one; an input column with
the name of a result column is replaced.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .frames import adding, table, tidied, without
from .tokens import plain

#: Words that a worker remembers, and the longest of them.
MEMO, KEPT = 1 << 17, 32
#: Places for pairs of tokens, a power of two.
PAIRS = 1 << 19
_SPREAD = 0x9E3779B1
_END = ""
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OTHER = re.compile("[^\0-\u024f]")


def _below(kind: str) -> str:
    """The characters up to U+024F of a class, for a class of re."""
    return re.escape("".join(c for c in map(chr, range(0x250)) if regex.match(kind, c)))


#: _PATTERN for such characters; its first three kinds begin with other characters, so their order is free.
_LATIN = re.compile(f"[{_below(r'\p{L}')}]+|[{_below(r'\p{N}')}]|'(?:[stmd]|re|ve|ll)|[^{_below(r'\s')}{_below(r'\p{L}')}{_below(r'\p{N}')}]+")


class _Memo:
    """The ids of words met lately: when half of MEMO words are new, those not met since the last time go."""

    def __init__(self) -> None:
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def keep(self, word: str, ids: tuple[int, ...]) -> Callable:
        if len(self.new) >= MEMO // 2:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return self.new.get


class PrefixBPE:
    """Encoder for a tokenizer file of a BPE model with an end-of-word suffix and no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] or spec["post_processor"] or model["dropout"] or model["unk_token"]:
            raise ValueError(f"{path}: not a plain BPE with an end-of-word suffix")
        lib = Tokenizer.from_file(path)
        self._normalize, self._split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = k
            if both not in self.made:
                self.made[both], self.parts[both] = k, (left, right)
            self.rank.setdefault((left, right), k)
        self._auto = ahocorasick.Automaton()
        self._own: dict[int, bool] = {}
        self._fits = array("Q", b"\xff" * 8 * PAIRS)  # what compatible() said last at each place: (left << 32 | right) << 1 | answer
        for text, i in vocab.items():
            if not self.own(i):  # it never stands in an encoding
                continue
            key = text[: -len(suffix)] + _END if text.endswith(suffix) else text
            self._auto.add_word(key, (i, len(key)))
        self._auto.make_automaton()
        from_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in from_bytes]
        self._char = {**{b: chr(b) for b in from_bytes}, **{b: chr(256 + n) for n, b in enumerate(spare)}}
        pattern = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        #: Whether the tokenizer has the rules that _LATIN stands for.
        self.plain_rules = pattern == [_PATTERN] and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self._latin_memo, self._memo = _Memo(), _Memo()

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined text is these two tokens.

        The merges that made them are undone latest first.  A pair that faces across the border
        at some moment and could merge before the merge undone last would have merged there.
        """
        place, pair = left * _SPREAD + right & PAIRS - 1, left << 32 | right
        rank, made, parts = self.rank, self.made, self.parts
        before = float("inf")  # merges across the border with a lower time would have come first
        answer = True
        while True:
            k = rank.get((left, right))
            if k is not None and k < before:
                answer = False
                break
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:  # a merge on the left was last; one across of the same rank would stand to its right
                before, left = a, parts[left][1]
            else:  # on the right: one across of the same rank would have come first, from left to right
                before, right = b + 0.5, parts[right][0]
        self._fits[place] = pair << 1 | answer
        return answer

    def own(self, token: int) -> bool:
        """Whether the token is the encoding of its own text."""
        known = self._own.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = self._own[token] = pair is None or self.own(pair[0]) and self.own(pair[1]) and self._alone(token, pair)
        return known

    def _alone(self, token: int, pair: tuple[int, int]) -> bool:
        rank, (left, right), before = self.rank, pair, self.made[token]
        made, parts = self.made, self.parts
        while True:  # as in compatible(), from the moment before the token's own merge
            k = rank.get((left, right))
            if k is not None and k < before:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = min(before, a), parts[left][1]
            else:
                before, right = min(before, b + 0.5), parts[right][0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word (in byte characters), by its prefixes."""
        n = len(word)
        last: list[int] = [-1] * (n + 2)
        size = [0] * (n + 2)
        last[0] = -2
        fits = self._fits
        for end, (token, length) in self._auto.iter(word + _END):
            end += 1
            if last[end] != -1:
                continue
            before = last[end - length]
            if before == -1:
                continue
            if before >= 0:
                known = fits[before * _SPREAD + token & PAIRS - 1]
                if not (known & 1 if known >> 1 == before << 32 | token else self.compatible(before, token)):
                    continue
            last[end], size[end] = token, length
        at, ids = n + 1, []
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding of {word!r}")
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def _ids(self, pieces: list[str], memo: _Memo, in_bytes: bool) -> list[int]:
        ids: list[int] = []
        known = memo.new.get
        for w in pieces:
            found = known(w)
            if found is None:
                found = memo.old.get(w) or self.word(w if in_bytes else "".join(map(self._char.__getitem__, w.encode())))
                if len(w) <= KEPT:
                    known = memo.keep(w, found)
            ids += found
        return ids

    def _unspaced(self, text: str) -> list[int]:
        """Ids of a text without ASCII white space, by the tokenizer's own rules."""
        ids: list[int] = []
        for part in self._specials.split(text) if self._specials and "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._ids([w for w, _ in self._split(self._normalize(part))], self._memo, True)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text.  No rule of the tokenizer looks past ASCII white space, so texts are taken apart there.

        For composed Latin letters the general rules come down to one pattern over the text in lower case.
        """
        low = text.lower()
        if self.plain_rules and "<|" not in text and not _OTHER.search(low):  # some lower-case forms are further up
            return self._ids(_LATIN.findall(low), self._latin_memo, False)
        out: list[int] = []
        for raw in text.encode().split():  # bytes.split: exactly the ASCII white space
            out += self._unspaced(raw.decode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as a tokenizer without a decoder does; unknown ids vanish."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@functools.cache
def encoder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the ids of each whole text and the text these ids decode to.

    path: the tokenizer file, present on every executor (default: the public one installed there).
    """
    keep = without(df, ids, decoded)
    schema = adding(keep, (ids, T.ArrayType(T.IntegerType(), False)), (decoded, T.StringType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_path())
        for batch in batches:
            texts = plain(batch.column(batch.schema.get_field_index(text)))
            for at in range(0, len(texts), 256):  # small parts: memory follows a few texts
                coded = [bpe.encode(x.as_py()) for x in texts.slice(at, 256)]
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(coded, pa.list_(pa.int32())), pa.array(map(bpe.decode, coded), pa.string())], names=names)

    return keep.mapInArrow(tidied(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode_decode(docs))


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode()'s rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_bpe": op8_bpe}
