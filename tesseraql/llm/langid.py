"""Language identification by cross-parsing.

Per language a suffix automaton of a bounded sample of labelled text is built (SAMPLE_SYMBOLS symbols, so
the model grows with the number of languages only, by some 1.5 MB each).  A text is cut
greedily into phrases, each the longest match in that automaton from where the last one ended
(a letter that the sample lacks is a phrase of its own).  The fewer phrases, the lower the
cross entropy; the language that needs fewest phrases per symbol wins, ties by language name.

Symbols: the text's letters, lower-cased, with every stretch of other characters as one blank.
Cases: a null text or one without a letter is ``und`` with score 0; without any labelled
training text every text is ``und``.  Empty tables give empty results, repeated rows repeated
results; an input column with the name of a result column is replaced.  Long texts are parsed
whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import adding, table, tidied, without

#: Symbols of training text for each language, and documents that share them evenly.
SAMPLE_SYMBOLS = 60_000
SAMPLE_DOCS = 150
#: Texts with at most so many symbols in all are parsed side by side.
SIDE_BY_SIDE = 1_000_000
#: Longest piece of a text that is parsed in one go.
PIECE = 2048
_LOW = (1 << 32) - 1
_GAPS = regex.compile(r"\P{L}+")


def symbols(text: str) -> str:
    """Letters in lower case, anything else as single blanks."""
    return _GAPS.sub(" ", text.lower()).strip()


class _Automaton:
    """Suffix automaton: state 0 accepts exactly the substrings of the text it was fed."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step = step


def _packed(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, list[int]]:
    """The sparse rows laid over each other in one table, and where each of them begins.

    rows: next row by symbol.  The entry of row r and symbol c stands at begin[r] + c and holds
    begin[r] << 32 | begin[next]; no two rows begin at one place, so an entry of another row is told
    apart.  Full rows come first, and rows of one symbol fill the holes.
    """
    used, begins = bytearray(width + 1), bytearray(width + 1)
    begin, at = [0] * len(rows), 0

    def room(upto: int) -> None:
        if upto >= len(used):
            more = upto + len(used)
            used.extend(bytes(more))
            begins.extend(bytes(more))

    for r in sorted((r for r, row in enumerate(rows) if len(row) > 1), key=lambda r: -len(rows[r])):
        row, b, tries = rows[r], at, 0
        while True:
            room(b + width)
            if not begins[b] and not any(used[b + c] for c in row):
                break
            b += 1
            tries += 1
        if tries > 8:  # little room below
            at = max(at, b - 64)
        begin[r], begins[b] = b, 1
        for c in row:
            used[b + c] = 1
    p = 0
    for r, row in enumerate(rows):
        if len(row) < 2:
            c = next(iter(row), 0)  # a row without entries only needs a beginning of its own
            while True:
                room(p + width)
                if p >= c and not begins[p - c] and not used[p]:
                    break
                p += 1
            begin[r], begins[p - c] = p - c, 1
            used[p] = bool(row)
            p += 1
    table = np.full(len(used), -1, np.int64)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.array(begin, np.int64)
    owner = np.repeat(start, size)
    symbol = np.fromiter((c for row in rows for c in row), np.int64, int(size.sum()))
    to = np.fromiter((n for row in rows for n in row.values()), np.int64, int(size.sum()))
    table[owner + symbol] = owner << 32 | start[to]
    return table[: int(start.max()) + width + 1], begin


class CrossParser:
    """One table of transitions for the automata of all languages, as sparse rows laid over each other.

    A state is the place where its row begins: table[state + symbol] holds state << 32 | next state, or
    something else if there is no such transition.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s})
        self.code = {c: n + 1 for n, c in enumerate(letters)}  # 0: a symbol that no sample has
        rows: list[dict[int, int]] = []
        first = []
        for lang in self.langs:
            base = len(rows)
            first.append(base)
            rows += [{self.code[c]: to + base for c, to in s.items()} for s in _Automaton(samples[lang]).step]
        self.table, begin = _packed(rows, len(letters) + 1) if rows else (np.zeros(0, np.int64), [])
        self.roots = np.array([begin[n] for n in first], np.int64)
        self._known = np.zeros(256, np.int32)
        for c, n in self.code.items():
            self._put(ord(c), n)

    def _put(self, point: int, n: int) -> None:
        if point >= len(self._known):
            self._known = np.concatenate([self._known, np.zeros(point + 256 - len(self._known), np.int32)])
        self._known[point] = n

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(symbols(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(points < len(self._known), self._known[np.minimum(points, len(self._known) - 1)], 0).astype(np.int32)

    def _next(self, state: int, symbol: int) -> int:
        entry = self.table.item(state + symbol)
        return entry & _LOW if entry >> 32 == state else -1

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text for each language.

        Long texts are cut into pieces that are parsed side by side as if each began a phrase.  A
        piece is then entered once more in the state its predecessor really ended in, and followed
        until both parses are in one state; from there on they are the same.
        """
        pieces, owner = [], []
        for k, t in enumerate(texts):
            for at in range(0, max(1, len(t)), PIECE):
                pieces.append(t[at : at + PIECE])
                owner.append(k)
        count, state = self._parse(pieces)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(out, np.array(owner, np.int64), count)
        last = {}
        for n, k in enumerate(owner):
            last[k] = n
            if n and owner[n - 1] == k:
                symbols_ = pieces[n].tolist()
                for lang, root in enumerate(self.roots.tolist()):
                    entered = int(state[n - 1, lang])
                    if entered != root:
                        more, end, met = self._follow(symbols_, entered, root)
                        out[k, lang] += more
                        if not met:
                            state[n, lang] = end
        for k, n in last.items():
            out[k] += state[n] != self.roots
        return out

    def _follow(self, piece: list[int], real: int, root: int) -> tuple[int, int, bool]:
        """Phrases that the real parse of a piece ends more than one from the root, its state, and whether the two met."""
        other, more, step = root, 0, self._next
        for c in piece:
            to = step(real, c)
            if to < 0:
                more += real != root
                to = step(root, c)
                if to < 0:
                    more += 1
                    to = root
            real = to
            to = step(other, c)
            if to < 0:
                more -= other != root
                to = step(root, c)
                if to < 0:
                    more -= 1
                    to = root
            other = to
            if real == other:
                return more, real, True
        return more, real, False

    def _parse(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that ended and the state at the end, of each text for each language, side by side."""
        langs, size = len(self.langs), np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.concatenate([texts[k] for k in order]).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
        start = np.cumsum(size) - size
        roots = self.roots
        state, count = np.repeat(roots[:, None], len(texts), axis=1), np.zeros((langs, len(texts)), np.int64)
        table, alive = self.table, len(texts)
        for at in range(int(size[0]) if len(texts) else 0):
            while size[alive - 1] <= at:
                alive -= 1
            c = flat[start[:alive] + at]
            now = state[:, :alive]
            entry = table.take(now + c)
            to = entry & _LOW
            lang, text = np.nonzero(entry >> 32 != now)
            if len(lang):  # a phrase ends before this symbol, and the next one begins with it
                root = roots[lang]
                again = table.take(root + c[text])
                lone = again >> 32 != root
                again &= _LOW
                count[lang, text] += (now[lang, text] != root).astype(np.int64) + lone
                to[lang, text] = np.where(lone, root, again)
            state[:, :alive] = to
        counts, ends = np.empty((len(texts), langs), np.int64), np.empty((len(texts), langs), np.int64)
        counts[order], ends[order] = count.T, state.T
        return counts, ends

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        todo, codes, total = [], [], 0

        def settle() -> None:
            counts = self.phrases(codes)
            for k, n, c in zip(todo, counts, codes):
                best = int(np.argmin(n))
                rest = np.delete(n, best)
                lang[k] = self.langs[best]
                score[k] = float(rest.min() / (rest.min() + n[best])) if len(rest) else 1.0

        for k, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                todo.append(k)
                codes.append(self.codes(text))
                total += len(codes[-1])
                if total > SIDE_BY_SIDE:
                    settle()
                    todo, codes, total = [], [], 0
        if todo:
            settle()
        return lang, score


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_symbols: int = SAMPLE_SYMBOLS, sample_docs: int = SAMPLE_DOCS) -> CrossParser:
    """Fit on a bounded sample: for each language about 2 * sample_docs rows, those whose text hashes lowest.

    Of each a stretch from a place that its hash names comes to the driver.  In the order of the hashes
    each gives an equal share of sample_symbols; what short texts leave, the others fill.
    """
    h = F.expr(f"xxhash64(`{text}`, 6)")
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), h.alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return CrossParser({})
    facts = {k: {"share": min(1.0, 2.0 * sample_docs / n), "size": 4 * -(-sample_symbols // min(n, sample_docs))} for k, n in counts.items()}
    fact = F.element_at(F.from_json(F.lit(json.dumps(facts)), "map<string,struct<share:double,size:int>>"), F.col("lang"))
    # the hash as a number from 0 to 1, against the share of this language's rows that is wanted
    picked = rows.withColumn("fact", fact).where(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 <= F.col("fact.share"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - F.col("fact.size"), F.lit(0)) + 1).cast("int") + 1
    picked = picked.select("lang", "h", F.substring("text", begin, F.col("fact.size")).alias("text"))
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies of a text count once, here and in the shares
    found: dict[str, list[str]] = {name: [] for name in counts}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], r["text"])):
        found[r["lang"]].append(symbols(r["text"]))
    samples = {}
    for name, texts in found.items():
        share, taken, size = -(-sample_symbols // min(max(1, len(texts)), sample_docs)), [], 0
        for rest in (False, True):
            for t in texts:
                part = (t[share:] if rest else t[:share])[: max(0, sample_symbols - size)]
                if part:
                    taken.append(part)
                    size += len(part)
        if taken:
            samples[name] = " ".join(taken)
    return CrossParser(samples)


def identify(df: DataFrame, parser: CrossParser, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The frame with the predicted language and a score from 0.5 (a tie) to 1; (``und``, 0) as said above.

    The parser is broadcast: its size is bounded by the sample for each language.
    """
    keep = without(df, lang_pred, score)
    schema = adding(keep, (lang_pred, T.StringType()), (score, T.DoubleType()))
    names, shared = schema.names, df.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
            while at < len(column):  # parts of a bounded number of bytes
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 3_000_000, "right")))
                lang, sure = shared.value.predict(column.slice(at, end - at).to_pylist())
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=names)
                at = end

    return keep.mapInArrow(tidied(run), schema)


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % by


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = learn(docs.where(remainder("doc_id", 3) != 1))
    mine = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return identify(mine, parser).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
