"""Removal of long repeated passages by recompression.

Words are named by 64-bit hashes.  A first round names runs of an equal word; every further round
puts symbols in two classes by their names and names each neighbouring pair of a left-class and a
right-class symbol.  Names depend only on what they stand for, so they are global without a
dictionary, and equal passages get equal symbols but for a few at each border: a symbol at the
left border is uncertain only if it is right-class (it may have merged with what stands before
it), one at the right border only if it is left-class.

So every window of ``window`` words has an interior of high-level symbols that depends on its own
words alone.  Its longest such symbol is its anchor.  Consecutive windows with one anchor are a
chunk.  Spark counts the anchors' names:

* a name that occurs once has no repeated window (equal windows have equal anchors, so this is exact);
* a name of which all occurrences stand in equal chunks has only repeated windows; chunks of one name are
  verified by a 64-bit hash of all their words, of another kind than names, and their number;
* for the windows of other names, 128-bit hashes of their words are counted.

A passage is wrongly taken for a repeat only if such hashes of different words are equal: for p pairs of
chunks that share a name and w open windows the odds are about p / 2^64 + w * w / 2^129, which is under one
in a million for 10^13 pairs and 10^16 windows.  No repeat is ever missed.

Words of windows counted twice or more go.  All counts are partial sums before any shuffle, and
joins are on names, window hashes or rows, so a passage that many rows share is no hot task.

Cases: null text has no words; a text shorter than the window keeps all; a passage that repeats in
one text counts; repeated rows count as copies of each other; empty tables give empty results;
input columns with the name of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import adding, table, tidied, without
from .scratch import drop, stored
from .tokens import Words, mix, stream, text_chunks

WINDOW = 35
#: Rounds of pairing after the round of runs, and the earlier round that serves a window without an interior there.
ROUNDS, EARLIER = 6, 3
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Spans:
    """Hashes of stretches of words, from prefix sums modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 3
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, names: np.ndarray):
        n = len(names)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * _powers(self.BASE, max(n, 1))[:n], dtype=np.uint64)])
        self.back = _powers(self.INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least key in each [lo, hi), the first of equals; no range is empty."""
    span = hi - lo
    levels, tables = int(span.max()).bit_length(), [np.arange(len(key))]
    for k in range(1, levels):
        prev, half = tables[-1], 1 << k - 1
        a, b = prev[:-half], prev[half:]
        tables.append(np.where(key[b] < key[a], b, a))
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in range(levels):
        at = np.flatnonzero(level == k)
        a, b = tables[k][lo[at]], tables[k][hi[at] - (1 << k)]
        out[at] = np.where(key[b] < key[a], b, a)
    return out


class Parse:
    """Windows of a chunk of texts with their anchors.

    at: first word of each window; name: its anchor's name; rank, head, tail: the chunk of windows it
    belongs to, that chunk's first word and the word after its last; document: of each window.
    """

    def __init__(self, words: Words, window: int):
        self.words, self.names, self.window = words, words.hashes(), window
        n, first = len(words), words.first
        document = words.documents()
        size = np.diff(first)
        at = np.flatnonzero(np.arange(n) + window <= first[document + 1]) if n else np.zeros(0, np.int64)
        self.at, self.document, self.size = at, document[at] if n else document, size
        self.spans = _Spans(self.names)
        if not len(at):
            self.name, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.head = self.tail = self.chunk_document = np.zeros(0, np.int64)
            return
        name, place = self._anchors(document)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.document[1:] != self.document[:-1])
        self.rank = np.cumsum(new) - 1  # of all chunks
        self.name = name
        self.heads = np.flatnonzero(new)
        self.head = at[self.heads]
        self.tail = at[np.append(self.heads[1:], len(at)) - 1] + window
        self.chunk_document = self.document[self.heads]

    def _anchors(self, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name of each window's anchor, and a number that tells anchors at different places apart."""
        names, n, at = self.names, len(self.names), self.at
        same = np.zeros(n, bool)
        same[1:] = (names[1:] == names[:-1]) & (document[1:] == document[:-1])
        pos = np.flatnonzero(~same)
        count = np.diff(np.append(pos, n))
        sym = np.where(count > 1, mix(names[pos] ^ count.astype(np.uint64) * U(0xD6E8FEB86659FD93)), names[pos])
        # of every place between words: where the certain symbols to its right begin, to its left end
        run = np.cumsum(~same) - 1
        left, right = np.append(np.append(pos, n)[run + 1], n), np.concatenate([[0], pos[run]])
        lo, hi = left[at], right[at + self.window]
        found = np.full(len(at), -1, np.int64)
        name = np.zeros(len(at), np.uint64)
        earlier = None
        for r in range(1, ROUNDS + 1):
            klass = (mix(sym + U(r)) & U(1)).astype(bool)  # left-class
            ends = np.append(pos[1:], n)
            step = np.arange(n + 1)
            step[pos] = np.where(klass, pos, ends)
            lo = step[lo]
            step = np.arange(n + 1)
            step[ends] = np.where(klass, pos, ends)
            hi = step[hi]
            pair = np.zeros(len(pos), bool)
            pair[:-1] = klass[:-1] & ~klass[1:] & (document[pos[1:]] == document[pos[:-1]])
            tail = np.zeros(len(pos), bool)
            tail[1:] = pair[:-1]
            merged = sym.copy()
            k = np.flatnonzero(pair)
            merged[k] = mix(sym[k] * U(0xC2B2AE3D27D4EB4F) + mix(sym[k + 1] + U(r << 8)))
            sym, pos = merged[~tail], pos[~tail]
            if r == EARLIER:
                earlier = sym, pos, lo, hi
        for level, (s, p, a, b) in ((ROUNDS, (sym, pos, lo, hi)), (EARLIER, earlier)):
            todo = np.flatnonzero((found < 0) & (a < b))
            if not len(todo):
                continue
            index = np.full(n + 1, len(p), np.int64)
            index[p] = np.arange(len(p))
            length = np.diff(np.append(p, n))
            key = (U(255) - np.minimum(length, 255).astype(np.uint64)) << U(56) | s >> U(8)
            best = _least(key, index[a[todo]], index[b[todo]])
            name[todo] = mix(s[best] + U(level))
            found[todo] = p[best] * 4 + (0 if level == ROUNDS else 1)
        todo = np.flatnonzero(found < 0)  # runs from border to border: the window is its own anchor
        name[todo] = self.spans.of(at[todo], at[todo] + self.window)
        found[todo] = at[todo] * 4 + 2
        return name, found


def parses(column: pa.Array, window: int) -> Iterator[tuple[int, int, Parse]]:
    for row, end, raw, offs in text_chunks(column):
        yield row, end, Parse(Words(raw, offs), window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _chunks(window: int):
    """Of each chunk of windows: its anchor's name, a hash of all its words and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, salt = batch.column(0), batch.column(1)
            for row, _, p in parses(batch.column(2), window):
                if not len(p.at):
                    continue
                d = p.chunk_document
                before = np.searchsorted(d, np.arange(len(p.size) + 1))
                rank = np.arange(len(d)) - before[d]
                take = pa.array(d + row)
                yield pa.RecordBatch.from_arrays([_signed(p.name[p.heads]), _signed(p.spans.of(p.head, p.tail)), key.take(take), salt.take(take), pa.array(rank.astype(np.int32))], names=["name", "words", "key", "salt", "rank"])

    return run


def _flags(column: pa.Array, row: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists."""
    part = column.slice(row, end - row)
    size = np.asarray(part.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(end - row), size), np.asarray(part.flatten())


def _open_windows(window: int):
    """Hashes of the windows of names that are neither single nor settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, salt, text, shared = (batch.column(k) for k in range(4))
            for row, end, p in parses(text, window):
                which, flag = _flags(shared, row, end)
                which, flag = which[flag % 2 == 0], flag[flag % 2 == 0] // 2
                if not len(which):
                    continue
                is_open = np.zeros(len(p.head), bool)
                is_open[np.searchsorted(p.chunk_document, which) + flag] = True
                w = np.flatnonzero(is_open[p.rank])
                at, d = p.at[w], p.document[w]
                take = pa.array(d + row)
                other = _Spans(mix(p.names ^ stream(7, 1)[0]))
                yield pa.RecordBatch.from_arrays([_signed(p.spans.of(at, at + window)), _signed(other.of(at, at + window)), key.take(take), salt.take(take), pa.array((at - p.words.first[d]).astype(np.int32))], names=["h1", "h2", "key", "salt", "at"])

    return run


def _covered(names: list[str], column: str, window: int):
    """Adds the words that stay and how many there were and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, shared, at = (batch.column(batch.schema.get_field_index(c)) for c in (column, "__shared", "__at"))
            kept, total, gone = [], [], []
            for row, end, p in parses(text, window):
                cover = np.zeros(len(p.names) + 1, np.int64)
                which, flag = _flags(shared, row, end)
                which, flag = which[flag % 2 == 1], flag[flag % 2 == 1] // 2
                chunk = np.searchsorted(p.chunk_document, which) + flag
                np.add.at(cover, p.head[chunk], 1)
                np.add.at(cover, p.tail[chunk], -1)
                which, place = _flags(at, row, end)
                start = p.words.first[which] + place
                np.add.at(cover, start, 1)
                np.add.at(cover, start + window, -1)
                out = np.cumsum(cover[:-1]) > 0
                starts, ends, first, raw = p.words.starts, p.words.ends, p.words.first, p.words.raw.tobytes()
                sums = np.concatenate([[0], np.cumsum(out)])
                for d in range(end - row):
                    a, b = int(first[d]), int(first[d + 1])
                    stay = a + np.flatnonzero(~out[a:b])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode("utf-8"))
                    total.append(b - a)
                    gone.append(int(sums[b] - sums[a]))
            keep = [batch.column(k) for k, c in enumerate(batch.schema.names) if not c.startswith("__")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, kept: str = "kept", n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """The frame with the words that stay (joined by one space), the number of words and of those removed.

    Windows are judged on the input.  A row is known by 128 bits of its id, whatever its type or if it is null,
    and its text, so ids may repeat or be missing; rows that are equal in both are one row with one result.
    """
    base = without(df, kept, n_words, n_removed, "__key", "__salt", "__shared", "__at")
    named = F.concat_ws(":", F.col(doc_id).isNotNull().cast("string"), F.col(doc_id).cast("string"))
    docs = base.withColumns({"__key": F.xxhash64(named, text), "__salt": F.xxhash64(text, F.lit("second"), named)})
    mine = ["__key", "__salt"]
    chunks = stored(docs.select("__key", "__salt", text).mapInArrow(tidied(_chunks(window)), "name long, words long, key long, salt long, rank int"), "substring-chunks")
    names = chunks.groupBy("name").agg(F.count("*").alias("n"), F.min("words").alias("a"), F.max("words").alias("b")).where("n > 1").select("name", F.when(F.col("a") == F.col("b"), 1).otherwise(0).alias("settled"))
    # a table of its own: joined straight to its source, the names would be dealt as the counts were, and
    # a name in a large part of the rows could not be split
    names = stored(names, "substring-names")
    flagged = chunks.join(names, "name").groupBy(F.col("key").alias("__key"), F.col("salt").alias("__salt")).agg(F.collect_set((F.col("rank") * 2 + F.col("settled")).cast("int")).alias("__shared"))
    flagged = stored(flagged, "substring-shared")  # read twice below
    drop(chunks)
    drop(names)
    joined = docs.join(flagged, mine, "left")
    windows = stored(joined.where("__shared is not null").select("__key", "__salt", text, "__shared").mapInArrow(tidied(_open_windows(window)), "h1 long, h2 long, key long, salt long, at int"), "substring-windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    twice = stored(twice, "substring-twice")  # as above
    hits = windows.join(twice, ["h1", "h2"]).groupBy(F.col("key").alias("__key"), F.col("salt").alias("__salt")).agg(F.collect_set("at").alias("__at"))
    schema = adding(base, (kept, T.StringType()), (n_words, T.LongType()), (n_removed, T.LongType()))
    final = docs.join(flagged, mine, "left").join(hits, mine, "left").drop(*mine)
    return final.mapInArrow(tidied(_covered(schema.names, text, window)), schema)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents
), windows AS (
  SELECT r, k, array_to_string(w[k : k + 34], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY x) AS n FROM windows) WHERE n > 1
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d
), marked AS (
  SELECT r, word, k, max(hit) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN (SELECT r, k, k AS hit FROM twice) USING (r, k)
), sums AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (r)
"""
QUERIES = {"op5_substrings": op5_substrings}
ORACLE_SQL = {"op5_substrings": _ORACLE}
