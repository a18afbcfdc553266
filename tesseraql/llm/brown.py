"""Language-model scoring by Brown class-based bigrams.

A text is lower-cased words and one end token.  Its probability is the product over tokens of
P(class | class of the token before) * P(word | class); before the first token stands an end.
Every training word has a class of its own, in two steps:

Exchange clustering assigns units to classes.  A unit is one of the WORD_UNITS commonest words, the end,
or one of SHAPES groups of all other words by their last three bytes.  Spark counts the unit bigrams of the
whole corpus; their matrix, of fixed size, comes to the driver in parts.  From the most frequent units as
classes of their own, each round moves every unit to the class that raises the likelihood of the class
bigrams most, by exact differences: all profiles follow every move.  It ends when a round moves none.

Placement then takes every other training word out of its group and puts it into the class that raises
that likelihood most, by exact differences with all other words left where they are, if the likelihood
pays for naming the class (MOVE; a word seen once tells too little).  Spark sums each
word's neighbours by class (at most two numbers a class), so this has no bound on words.  Neighbours
outside the frequent words count by the classes of their groups here.  Class bigrams are then
counted anew from all training texts, by the words' own classes.

Groups stand for unseen words only: one event each, with the count of the group's words seen once
(Good-Turing).  So all probabilities add up to 1.

Counts and classes of words that are at least one in DICTIONARY of all tokens, at most DICTIONARY words,
are broadcast; rarer words in texts are joined with the table of words.

Cases: null and empty texts are one end token; repeated rows get equal results; with no training
texts all counts are 0 and scores stay finite; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table, tidied
from .langid import remainder
from .scratch import drop, stored
from .tokens import LOWER, Words, mix, text_chunks

WORD_UNITS, SHAPES, DICTIONARY = 1 << 11, 1 << 10, 1 << 21
#: Rounds of exchange at most.
CLASSES, ROUNDS = 64, 8
#: What naming a word's class costs, in logarithms of the number of classes: the likelihood must pay for it.
MOVE = 1.0
#: Unit bigrams fetched at a time.
FETCHED = 1 << 20
#: Pseudo-counts of the class transitions and of units in their classes.
ALPHA, DELTA = 5.0, 0.5
END = np.uint64(0xE0D0F0C0B0A09080)
HIGH = np.uint64(48)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, hashes of tokens with ends, shapes, first token of each row) by chunk."""
    for row, end, raw, offs in text_chunks(column):
        words = Words(raw, offs)
        n, docs = len(words), end - row
        at = np.arange(n) + words.documents()
        names, shapes = np.full(n + docs, END, np.uint64), np.zeros(n + docs, np.int64)
        names[at] = words.hashes(lower=True)
        code, size = np.zeros(n, np.uint64), words.ends - words.starts
        for k in (1, 2, 3):
            code = code << np.uint64(8) | np.where(size >= k, LOWER[raw[np.maximum(words.ends - k, 0)]], 0).astype(np.uint64) if n else code
        shapes[at] = (mix(code) % np.uint64(SHAPES)).astype(np.int64)
        yield row, end, names, shapes, words.first[:-1] + np.arange(docs)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return key, total, back


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, groups = [], [], []
        for _, _, names, shapes, _ in _tokens(batch.column(0)):
            key, first, n = np.unique(names, return_index=True, return_counts=True)
            keys.append(key), counts.append(n), groups.append(shapes[first])
        if keys:
            key, total, back = _summed(keys, counts)
            shape = np.zeros(len(key), np.int64)
            shape[back] = np.concatenate(groups)
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(shape.astype(np.int32)), pa.array(total)], names=["word", "shape", "n"])


def _sorted(words: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(words)
    return words[order], *(v[order] for v in values)


def _find(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in a sorted array, and whether they stand there."""
    if not len(known):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return at, known[at] == words


class Units:
    """Units: frequent words in the order of their hashes, then shape groups.  The end token is a word unit."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.count = len(words) + SHAPES
        self.end = int(np.searchsorted(self.words, END))
        # the first unit of each value of the highest 16 bits; few values have two
        self.first = np.minimum(np.searchsorted(self.words, np.arange(1 << 16, dtype=np.uint64) << HIGH), len(words) - 1)
        self.crowded = np.bincount((self.words >> HIGH).astype(np.int64), minlength=1 << 16) > 1

    def of(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        high = words >> HIGH
        at = self.first[high]
        more = np.flatnonzero(self.crowded[high])
        at[more] = _find(self.words, words[more])[0]
        return np.where(self.words[at] == words, at, len(self.words) + shapes)


def _bigrams(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        for batch in batches:
            keys, counts = [], []
            for _, _, names, shapes, _ in _tokens(batch.column(0)):
                now = u.of(names, shapes)
                key, n = np.unique(np.append(u.end, now[:-1]) * u.count + now, return_counts=True)
                keys.append(key), counts.append(n)
            if keys:
                key, total, _ = _summed(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(of: np.ndarray, big: np.ndarray, classes: int) -> np.ndarray:
    """One round: each unit, the frequent first, goes to the class with the greatest likelihood.

    big: the bigrams of units.  A unit whose class is ``classes`` has none yet.
    """
    of = of.copy()
    member = np.zeros((len(of), classes + 1))
    member[np.arange(len(of)), of] = 1
    left, right = big.T @ member, big @ member  # of each unit by class of the neighbour; they follow every move
    n = member.T @ right
    row, col = n.sum(axis=1), n.sum(axis=0)
    total = left.sum(axis=1)
    for w in np.argsort(-total, kind="stable"):
        if not total[w] and not right[w].any():
            continue
        a, s, lw, rw = int(of[w]), float(big[w, w]), left[w].copy(), right[w].copy()
        n[:, a] -= lw
        n[a, :] -= rw
        n[a, a] += s
        row[a] -= rw.sum()
        col[a] -= lw.sum()
        lw[a] -= s
        rw[a] -= s
        ls, rs = lw.sum() + s, rw.sum() + s
        c = slice(0, classes)
        gain = (_xlogx(n[:, c] + lw[:, None]) - _xlogx(n[:, c])).sum(axis=0) + (_xlogx(n[c, :] + rw[None, :]) - _xlogx(n[c, :])).sum(axis=1)
        d = np.arange(classes)
        x, y, z = n[d, d], lw[c], rw[c]
        gain += _xlogx(x + y + z + s) - _xlogx(x + y) - _xlogx(x + z) + _xlogx(x)
        gain -= _xlogx(row[c] + rs) - _xlogx(row[c]) + _xlogx(col[c] + ls) - _xlogx(col[c])
        k = int(gain.argmax())
        if a < classes and gain[a] >= gain[k] - 1e-9:
            k = int(a)
        of[w] = k
        n[:, k] += lw
        n[k, :] += rw
        n[k, k] += s
        row[k] += rs
        col[k] += ls
        if k != a:
            for side, counts in ((left, big[w]), (right, big[:, w])):
                side[:, a] -= counts
                side[:, k] += counts
    return of


def _neighbours(shared):
    """(word, around, n) of words outside the units; around holds the word's shape, the class before, the class
    after and whether the word stands before itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = shared.value
        wide = int(of.max()) + 1
        for batch in batches:
            parts, size = [], 0
            for _, end, names, shapes, _ in _tokens(batch.column(0)):
                unit = units.of(names, shapes)
                klass = of[unit]
                # the end token is a unit, so each of these has a token after it
                i = np.flatnonzero(unit >= len(units.words))
                before = np.append(of[units.end], klass[:-1])[i]
                around = ((shapes[i] * wide + before) * wide + klass[i + 1]) * 2 + (names[i] == names[i + 1])
                parts.append((names[i], around))
                size += len(i)
                if size > 400_000 or end == len(batch):
                    word, around, n = _entries(*map(np.concatenate, zip(*parts)), wide)
                    parts, size = [], 0
                    yield pa.RecordBatch.from_arrays([_signed(word), pa.array(around), pa.array(n)], names=["word", "around", "n"])

    return run


def _entries(names: np.ndarray, around: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    word, back = np.unique(names, return_inverse=True)
    kinds = SHAPES * wide * wide * 2
    key, n = np.unique(back * kinds + around, return_counts=True)
    return word[key // kinds], key % kinds, n


def assign(n: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, cost: float = 0.0) -> np.ndarray:
    """The class in which each word makes the likelihood greatest, all other words left where they are.

    n: class bigrams with each word in its home class; left, right: its bigrams by class of the neighbour,
    own: with itself (a part of both).  cost: by how much the logarithm must rise for a word to leave home.
    """
    b = np.arange(len(home))
    lw, rw = left.copy(), right.copy()
    lw[b, home] -= own
    rw[b, home] -= own
    gain = np.zeros(left.shape)
    for m, mine, full, other in ((n, lw, left, right), (n.T, rw, right, left)):
        w, j = np.nonzero(mine)
        if not len(w):
            continue
        x = m[j].astype(np.float64)
        x[np.arange(len(w)), home[w]] -= full[w, j]
        at = np.flatnonzero(j == home[w])
        x[at] -= other[w[at]]
        x[at, home[w[at]]] += own[w[at]]
        np.maximum(x, 0, out=x)
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[new]] += np.add.reduceat(_xlogx(x + mine[w, j][:, None]) - _xlogx(x), new, axis=0)
    x = np.tile(np.diag(n).astype(np.float64), (len(home), 1))
    x[b, home] = np.maximum(0, x[b, home] - left[b, home] - right[b, home] + own)
    gain += _xlogx(x + lw + rw + own[:, None]) - _xlogx(x + lw) - _xlogx(x + rw) + _xlogx(x)
    for sums, size in ((n.sum(axis=1), right.sum(axis=1)), (n.sum(axis=0), left.sum(axis=1))):
        x = np.tile(sums.astype(np.float64), (len(home), 1))
        x[b, home] = np.maximum(0, x[b, home] - size)
        gain -= _xlogx(x + size[:, None]) - _xlogx(x)
    best = gain.argmax(axis=1)
    return np.where(gain[b, home] >= gain[b, best] - cost - 1e-9, home, best)


def _placed(shared):
    """(word, shape, n, klass) from the rows of _neighbours in the order of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, homes, move = shared.value
        wide, kept = len(n), None
        for batch in chain(batches, (None,)):
            rows = kept
            if batch is not None:
                rows = [np.asarray(c) for c in batch.columns]
                rows = rows if kept is None else [np.append(a, c) for a, c in zip(kept, rows)]
                if not len(rows[0]):
                    continue
                # the last word may go on in the next batch
                end = int(np.searchsorted(rows[0], rows[0][-1]))
                kept, rows = [r[end:] for r in rows], [r[:end] for r in rows]
            if rows is None or not len(rows[0]):
                continue
            word, first, back = np.unique(rows[0], return_index=True, return_inverse=True)
            around, times = rows[1], rows[2].astype(np.float64)
            profile = lambda x: np.bincount(back * wide + x, times, len(word) * wide).reshape(-1, wide)
            left, right = profile(around // (2 * wide) % wide), profile(around // 2 % wide)
            own = np.bincount(back, times * (around % 2), len(word))
            shape = around[first] // (2 * wide * wide)
            klass = assign(n, homes[shape], left, right, own, move * np.log(wide))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(shape.astype(np.int32)), pa.array(left.sum(axis=1).astype(np.int64)), pa.array(klass.astype(np.int32))], names=["word", "shape", "n", "klass"])

    return run


class Lexicon:
    """Classes of units, and counts and classes of the words that are broadcast; units are among these."""

    def __init__(self, units: Units, of: np.ndarray, words: np.ndarray, counts: np.ndarray, klass: np.ndarray):
        self.units, self.of = units, of
        absent = np.setdiff1d(units.words, words)
        unit = np.searchsorted(units.words, absent)
        words, counts, klass = np.append(words, absent), np.append(counts, np.zeros(len(absent), np.int64)), np.append(klass, of[unit])
        self.words, self.counts, self.klass = _sorted(words, counts, klass)
        # of each unit, and -1 of each group; a rarer word has the last of the classes
        self.place = np.append(np.searchsorted(self.words, units.words), np.full(SHAPES, -1))
        self.classes = np.append(self.klass, -1)

    def look(self, names: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place of each token's word here (-1: a rarer word), its class and that of the token before (-1: as above)."""
        place = self.place[self.units.of(names, shapes)]
        i = np.flatnonzero(place < 0)
        word, back = np.unique(names[i], return_inverse=True)
        at, known = _find(self.words, word)
        place[i] = np.where(known, at, -1)[back]
        klass = self.classes[place]
        return place, klass, np.append(self.of[self.units.end], klass[:-1])


class ClassModel:
    """What scoring needs, all of bounded size: logarithms to base 10 and the dictionary of counts and classes.

    class_tokens: tokens of each class by the words' own classes.
    """

    def __init__(self, lexicon: Lexicon, class_pairs: np.ndarray, class_tokens: np.ndarray, unit_tokens: np.ndarray, total: int, distinct: int):
        self.lexicon, self.units, self.of, self.words, self.total, self.distinct = lexicon, lexicon.units, lexicon.of, lexicon.words, total, distinct
        after = class_pairs.sum(axis=0)
        share = (after + 1) / (after + 1).sum()
        self.step = np.log10((class_pairs + ALPHA * share) / (class_pairs.sum(axis=1, keepdims=True) + ALPHA))
        size = np.bincount(self.of, minlength=len(after))
        groups = len(self.units.words)
        tokens = class_tokens + np.bincount(self.of[groups:], unit_tokens[groups:], len(after))
        self.norm = np.log10(tokens + DELTA * size)
        self.emit = np.log10(unit_tokens + DELTA) - self.norm[self.of]
        # a group is one event, an unseen word: nothing is shared out within it
        self.within = self.unseen = np.zeros(SHAPES)
        # of each word of the lexicon, and 0 for a rarer one
        count, unit = lexicon.counts, lexicon.place[:groups]
        emit = np.log10(np.maximum(count, 1)) - self.norm[lexicon.klass]
        emit[unit] = self.emit[:groups]
        self.word_emit, self.word_base, self.word_known = np.append(emit, 0.0), np.append(np.log10(count + 1.0), 0.0), np.append(count > 0, False).astype(np.int64)

    def local(self, names: np.ndarray, shapes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """By text: known tokens, base and score without what the rarer words add; and these words (token places), with all tokens' classes and those before."""
        place, klass, before = self.lexicon.look(names, shapes)
        score = np.where((klass >= 0) & (before >= 0), self.step[before, klass], 0.0) + self.word_emit[place]
        base = self.word_base[place] - np.log10(self.total + self.distinct + 1.0)
        per = lambda x: np.add.reduceat(x, starts)
        return per(self.word_known[place]), per(base), per(score), np.flatnonzero(klass < 0), klass, before


def train(texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """The model of a frame with one text column, and the table (word, shape, n, klass) of all its words but the units."""
    none = F.lit(0).cast("long")
    model, words, gathered = _train(texts.select(none.alias("doc_id"), F.lit(False).alias("held_out"), none.alias("salt"), F.col(texts.columns[0]).alias("text")), classes, rounds)
    drop(gathered)
    return model, words


def _train(rows: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame, DataFrame]:
    """As train(), from rows (doc_id, held_out, salt, text) that are not held out, with what _gathered() found in all rows."""
    texts = rows.where(~F.col("held_out")).select("text")
    spark = texts.sparkSession
    sc = spark.sparkContext
    counted = texts.mapInArrow(tidied(_vocabulary), "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    counted = stored(counted, "brown-words")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END.view(np.int64))
    fetch = lambda df: [np.asarray(c) for c in df.toArrow().combine_chunks().columns]
    words = counted.where(F.col("word") != end)
    unit_words, unit_counts = fetch(words.orderBy(F.desc("n"), "word").limit(WORD_UNITS).select("word", "n"))
    rest = words.where(F.lit(False))
    if len(unit_words) == WORD_UNITS:
        last, least = int(unit_words[-1]), int(unit_counts[-1])
        rest = words.where((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > last))
    ends = fetch(counted.where(F.col("word") == end).select("word", "n"))
    unit_words, unit_counts = np.append(unit_words, ends[0]).astype(np.int64).view(np.uint64), np.append(unit_counts, ends[1]).astype(np.int64)
    units = Units(np.unique(np.append(unit_words, END)))
    unit_tokens = np.zeros(units.count)
    unit_tokens[np.searchsorted(units.words, unit_words)] = unit_counts
    once = np.zeros(units.count)
    for r in rest.groupBy("shape").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).collect():
        unit_tokens[len(units.words) + r["shape"]], once[len(units.words) + r["shape"]] = r["n"], r["once"]
    drop(counted)
    shared = sc.broadcast(units)
    pairs = stored(texts.mapInArrow(tidied(_bigrams(shared)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "brown-pairs")
    big = np.zeros((units.count, units.count))
    parts = max(1, -(-pairs.count() // FETCHED))
    for part in range(parts):
        pair, n = fetch(pairs.where(F.pmod("pair", F.lit(parts)) == part))
        big.reshape(-1)[pair] = n
    drop(pairs)
    order = np.argsort(-unit_tokens, kind="stable")
    of = np.full(units.count, classes)
    of[order[:classes]] = np.arange(min(classes, units.count))
    for _ in range(rounds):
        before, of = of, exchange(of, big, classes)
        if (of == before).all():
            break
    of = np.where(of >= classes, np.arange(units.count) % classes, of)  # units without any bigram
    wide = int(of.max()) + 1
    member = np.eye(wide)[of]
    between = member.T @ (big @ member)
    del big, member
    entries = texts.mapInArrow(tidied(_neighbours(sc.broadcast((units, of)))), "word long, around long, n long")
    entries = entries.repartition("word").sortWithinPartitions("word")
    words = stored(entries.mapInArrow(tidied(_placed(sc.broadcast((between, of[len(units.words) :], MOVE)))), "word long, shape int, n long, klass int"), "brown-classes")
    word, count, klass = fetch(words.where(F.col("n") * DICTIONARY >= total).select("word", "n", "klass"))
    unit_class = of[np.searchsorted(units.words, unit_words)]
    lexicon = Lexicon(units, of, np.append(word.view(np.uint64), unit_words), np.append(count, unit_counts).astype(np.int64), np.append(klass, unit_class).astype(np.int64))
    class_tokens = np.bincount(unit_class, unit_counts, wide)
    for r in words.groupBy("klass").agg(F.sum("n").alias("n")).collect():
        class_tokens[r["klass"]] += r["n"]
    gathered = _gathered(rows, sc.broadcast(lexicon), words, total)
    class_pairs = np.zeros((wide, wide))
    mine = gathered.where(~F.col("held_out"))
    ends_ = F.array(
        F.when(~F.col("rare") & (F.col("before") >= 0), F.struct("before", F.col("after").alias("k"))),
        F.when(F.col("rare") & (F.col("before") >= 0), F.struct("before", F.col("klass").alias("k"))),
        F.when(F.col("rare"), F.struct(F.col("klass").alias("before"), F.when(F.col("after") >= 0, F.col("after")).otherwise(F.col("next_class")).alias("k"))),
    )
    counted = mine.select(F.explode(F.array_compact(ends_)).alias("e"), "times").groupBy("e.before", "e.k").agg(F.sum("times").alias("n"))
    a, b, n = fetch(counted.select("before", "k", "n"))
    class_pairs[a, b] = n
    unit_tokens[len(units.words) :] = once[len(units.words) :]
    return ClassModel(lexicon, class_pairs, class_tokens, unit_tokens, total, distinct), words, gathered


_ROW = "doc_id {}, held_out boolean, salt long, rows long, n_tokens long, n_known long, base double, score double"


def _local(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for row, end, names, shapes, starts in _tokens(batch.column(3)):
                known, base, score, *_ = m.local(names, shapes, starts)
                size = np.diff(np.append(starts, len(names)))
                keys = [batch.column(k).slice(row, end - row) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.ones(end - row, np.int64)), pa.array(size), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "salt", "rows", "n_tokens", "n_known", "base", "score"])

    return run


_RARE = ["doc_id", "held_out", "salt", "word", "shape", "before", "after", "next", "next_shape", "times"]


def _rare(lexicon):
    """The rarer words of each row with the classes around them, or the next word if that is rarer too; and, without
    a word, the class pairs of rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        wide = int(lex.of.max()) + 1
        small = lambda x: pa.array(x.astype(np.int32))
        for batch in batches:
            pairs = np.zeros(wide * wide, np.int64)
            held = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for row, end, names, shapes, starts in _tokens(batch.column(3)):
                _, klass, before = lex.look(names, shapes)
                size = np.diff(np.append(starts, len(names)))
                both = (klass >= 0) & (before >= 0) & ~np.repeat(held[row:end], size)
                pairs += np.bincount(before[both] * wide + klass[both], minlength=wide * wide)
                at = np.flatnonzero(klass < 0)
                if not len(at):
                    continue
                doc = np.searchsorted(starts, at, "right") - 1
                right = klass[at + 1]
                following = np.where(right < 0, names[at + 1], np.uint64(0))
                facts = (names[at], before[at], right, following, doc)
                # equal facts stand beside each other, for they have equal sums; whether they are equal is seen from themselves
                order = np.argsort(sum(mix(f.astype(np.uint64) + np.uint64(k << 56)) for k, f in enumerate(facts)), kind="stable")
                at, doc, right = at[order], doc[order], right[order]
                new = np.flatnonzero(np.append(True, np.any([f[order][1:] != f[order][:-1] for f in facts], axis=0)))
                times = np.diff(np.append(new, len(at)))
                take = pa.array(doc[new] + row)
                at, right = at[new], right[new]
                keys = [batch.column(k).take(take) for k in range(3)]
                following = pa.array(names[at + 1].view(np.int64), mask=right >= 0)
                yield pa.RecordBatch.from_arrays([*keys, _signed(names[at]), small(shapes[at]), small(before[at]), small(right), following, small(shapes[at + 1]), pa.array(times)], names=_RARE)
            at = np.flatnonzero(pairs)
            none = lambda kind: pa.nulls(len(at), kind)
            keys = [none(batch.column(0).type), pa.array(np.zeros(len(at), bool)), none(pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys, none(pa.int64()), none(pa.int32()), small(at // wide), small(at % wide), none(pa.int64()), none(pa.int32()), pa.array(pairs[at])], names=_RARE)

    return run


def _gathered(rows: DataFrame, lexicon, words: DataFrame, total: int) -> DataFrame:
    """What _rare() finds, with the count and class of each rarer word and the class of a rarer next one; words that
    the training texts lack have those of their groups."""
    lex = lexicon.value
    kind = rows.schema["doc_id"].dataType.simpleString()
    of = F.from_json(F.lit(json.dumps(lex.of[len(lex.units.words) :].tolist())), "array<int>")
    rare = rows.mapInArrow(tidied(_rare(lexicon)), f"doc_id {kind}, held_out boolean, salt long, word long, shape int, before int, after int, next long, next_shape int, times long")
    rarer = words.where(F.col("n") * DICTIONARY < total).select(F.col("word").alias("key"), "n", "klass")
    # rows without a word, or without a rarer word next, are spread over the joins by numbers of their own
    found = rare.withColumn("rare", F.col("word").isNotNull()).withColumn("key", F.coalesce("word", F.xxhash64("before", "after", "times")))
    found = found.join(rarer, "key", "left").withColumn("klass", F.coalesce("klass", F.element_at(of, F.col("shape") + 1))).drop("key")
    found = found.withColumn("key", F.coalesce("next", F.xxhash64("doc_id", "salt", "word", "before", "after")))
    found = found.join(rarer.select("key", F.col("klass").alias("next_class")), "key", "left").withColumn("next_class", F.coalesce("next_class", F.element_at(of, F.col("next_shape") + 1)))
    return stored(found.select("doc_id", "held_out", "salt", "rare", "shape", "before", "after", "times", "n", "klass", "next_class"), "brown-gathered")


def _rows(df: DataFrame, doc_id: str, text: str, held_out) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.xxhash64(text).alias("salt"), F.col(text).alias("text"))


def score(df: DataFrame, model: ClassModel, words: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row.

    A row is known by its id and a hash of its text; equal rows are folded and told apart again at the end.
    """
    rows = _rows(df, doc_id, text, held_out)
    return _scored(rows, model, _gathered(rows, df.sparkSession.sparkContext.broadcast(model.lexicon), words, model.total))


def train_and_score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """score() of all rows by the model of those that are not held out; their rarer words are looked up once for both."""
    rows = _rows(df, doc_id, text, held_out)
    model, _, gathered = _train(rows)
    return _scored(rows, model, gathered)


def _scored(rows: DataFrame, model: ClassModel, gathered: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    local = rows.mapInArrow(tidied(_local(shared)), _ROW.format(kind))
    listed = lambda x: F.from_json(F.lit(json.dumps(x.reshape(-1).tolist())), "array<double>")
    groups = len(model.units.words)
    wide, step, norm, unseen = len(model.step), listed(model.step), listed(model.norm), listed(model.emit[groups:])
    stepped = lambda a, b: F.element_at(step, F.col(a) * wide + F.col(b) + 1)
    counted = gathered.where("rare")
    n = F.coalesce("n", F.lit(0))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    emit = F.when(n > 0, F.log10(n.cast("double")) - F.element_at(norm, F.col("klass") + 1)).otherwise(F.element_at(unseen, F.col("shape") + 1))
    around = F.when(F.col("before") >= 0, stepped("before", "klass")).otherwise(none) + F.when(F.col("after") >= 0, stepped("klass", "after")).otherwise(stepped("klass", "next_class"))
    added = counted.select("doc_id", "held_out", "salt", zero.alias("rows"), zero.alias("n_tokens"), F.when(n > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"), (F.col("times") * F.log10(n + 1.0)).alias("base"), (F.col("times") * (emit + around)).alias("score"))
    sums = local.union(added).groupBy("doc_id", "held_out", "salt").agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "score")))
    each = sums.select("doc_id", "held_out", (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"))
    return each.drop("copy").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), held_out=remainder("doc_id", 7) == 2)


QUERIES = {"op7_language_model": op7_language_model}
