"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as lower-case letters and digits with single blanks for anything else.  An item
of n symbols may appear in a document with up to k = budget * n edits.  It is cut into k + 1
pieces, so at least one stands there unchanged; one automaton over the pieces of all items finds
these hits in one pass.  A hit is verified up a binary tree over the pieces: a node of p pieces
has p - 1 edits, and if a node keeps within them so does one of its halves; so every occurrence
has a piece from which all nodes up to the whole item keep within theirs.  Nodes are verified by
Myers' bit-parallel distance.

Items come in blocks of bounded size, each broadcast and held against all documents.

Cases: null and empty items and documents have no hits; items under 1 / budget symbols must
appear unchanged; equal items each get their rows, repeated documents too; of several places with
one distance the first found counts; texts of any length are searched whole; ids may be null or of
any type, and other columns, whatever their names, are left out; empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import table, tidied

BUDGET = 0.1
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000

_GAPS = regex.compile(r"[^\p{L}\p{N}]+")
Node = tuple[int, int, int]  # start and end in the item, edits allowed


def normal(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to a stretch of the text, and the first end of such a stretch."""
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score, best, end = full, 0, size, size, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(d | up)), up & d
        if score < best:
            best, end = score, at
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for n, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << n
    return out


class Item:
    """An item's pieces, each with the nodes above it from the least to the whole."""

    def __init__(self, item_id: int, text: str, budget: float):
        self.id, self.text, n = item_id, text, len(text)
        self.edits = int(budget * n)
        count = self.edits + 1
        cut = [n * j // count for j in range(count + 1)]
        self.pieces: list[tuple[str, int, list[Node]]] = [("", 0, [])] * count

        def grow(lo: int, hi: int, above: list[Node]) -> None:
            if hi - lo == 1:
                self.pieces[lo] = (text[cut[lo] : cut[hi]], cut[lo], above[::-1])
                return
            here = [*above, (cut[lo], cut[hi], hi - lo - 1)]
            half = (hi - lo) // 2
            half += half % 2 if hi - lo > 2 else 0  # pairs of pieces wherever possible
            grow(lo, lo + half, here)
            grow(lo + half, hi, here)

        grow(0, count, [])
        self._masks: dict[tuple[int, int], dict[str, int]] = {}

    def node(self, start: int, end: int) -> dict[str, int]:
        if (start, end) not in self._masks:
            self._masks[start, end] = masks(self.text[start:end])
        return self._masks[start, end]

    def verify(self, piece: int, text: str, at: int) -> tuple[int, int] | None:
        """Distance and end in the text of an occurrence of the whole item around a hit of the piece, or None."""
        _, offset, nodes = self.pieces[piece]
        if nodes and nodes[0][2] == 1 and not self._near(piece, nodes[0], text, at):
            return None
        best, end = 0, at + len(self.text)
        for start, stop, edits in nodes:
            first = max(0, at - (offset - start) - edits)
            best, last = myers(self.node(start, stop), stop - start, text[first : at + stop - offset + edits])
            if best > edits:
                return None
            end = first + last
        return best, end

    def _near(self, piece: int, node: Node, text: str, at: int) -> bool:
        """A quick necessary test of a pair: of the other piece's halves one stands unchanged, moved by at most 1."""
        own, offset, _ = self.pieces[piece]
        start, stop, _ = node
        if offset == start:
            other, e = self.text[start + len(own) : stop], at + len(own)
            h = len(other) // 2
            near, far = other[:h], other[h:]
            return text.startswith(near, e) or any(text.startswith(far, e + h + d) for d in (-1, 0, 1))
        other = self.text[start:offset]
        h = len(other) // 2
        far, near = other[:h], other[h:]
        s = at - len(near)
        if s >= 0 and text.startswith(near, s):
            return True
        return any(s - h + d >= 0 and text.startswith(far, s - h + d) for d in (-1, 0, 1)) or at < len(other) + 1


class Block:
    """An automaton over the pieces of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], budget: float):
        self.items = [Item(i, t, budget) for i, t in rows if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for k, (piece, _, _) in enumerate(item.pieces):
                where.setdefault(piece, []).append((n, k))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()
        self.empty = not where

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """Least distance of each item that the normal text contains, with the end of that place."""
        found: dict[int, tuple[int, int]] = {}
        if self.empty or not text:
            return found
        for last, (length, places) in self.auto.iter(text):
            for n, k in places:
                known = found.get(n)
                if known is None or known[0]:
                    hit = self.items[n].verify(k, text, last + 1 - length)
                    if hit and (known is None or hit < known):
                        found[n] = hit
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, found_text): a row for each document and item it contains.

    distance is the least number of edits; found_text the stretch of the normalised document up to
    where that match ends, as long as the item.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], items.schema["item_id"]]).add("distance", T.IntegerType()).add("item_chars", T.IntegerType()).add("found_text", T.StringType())
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], normal(r["text"])) for r in part.collect()], budget))
        found = source.mapInArrow(tidied(_search(shared, to_arrow_type(items.schema["item_id"].dataType))), schema)
        out = found if out is None else out.union(found)
    return out


class Items:
    """The items of a block; a worker builds their automaton once and lets go of it with the broadcast."""

    def __init__(self, rows: list[tuple], budget: float):
        self.rows, self.budget = rows, budget

    @functools.cached_property
    def block(self) -> Block:
        return Block(self.rows, self.budget)


def _search(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value.block
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1)):
                t = normal(text.as_py())
                for n, (distance, end) in block.search(t).items():
                    size = len(block.items[n].text)
                    rows.append((at, block.items[n].id, distance, size, t[max(0, end - size) : end]))
            at, *rest = zip(*rows) if rows else ((),) * 5
            columns = [pa.array(x, k) for x, k in zip(rest, (kind, pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", "item_id", "distance", "item_chars", "found_text"])

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance", "item_chars", "found_text")


QUERIES = {"op2_decontamination": op2_decontamination}
