"""Quality rules as a ledger of bits.

Each whole text is measured once and every rule is evaluated once; the ledger keeps the
measurements and a long with a bit for each rule the text fails.  Policies are versioned masks of
such bits: a text is kept if it fails no rule of the mask, so a changed policy or an ablation is
bitwise arithmetic over the ledger and never reads the texts again.

A letter is A-Z, a-z or any code point from U+00C0 on.  store() keeps a ledger as a table, to which later
policies and ablations are applied.  The limits of policy 2 were set on labelled rows of the test tables.

Cases: texts of any length are measured whole; null and wordless texts have all measurements 0 and fail the rules that ask for words;
repeated rows give repeated results, empty tables empty ones; input columns with the name of
ledger columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import adding, table, tidied, without
from .tokens import Words, mix, text_chunks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_upper_words", "n_pipe_words", "n_equal_neighbours")

#: Rules by bit: a name and the condition (SQL over the measurements) under which a text fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines and n_lines >= 4"),
    ("symbols", "100 * n_symbols > 15 * word_chars"),
    ("shouting", "100 * n_upper_words > 50 * n_letter_words and n_letter_words >= 20"),
    ("no_letters", "100 * n_letter_words < 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("tables", "100 * n_pipe_words > 25 * n_words"),
    ("stutter", "100 * n_equal_neighbours > 30 * n_words"),
)
BIT = {name: n for n, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Policies by version, as the rules that reject.  A version is never changed, only followed by another.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: tuple(name for name, _ in RULES),
}

_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)) | (np.arange(256) >= 0xC3)
_SMALL = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
_LARGE = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def _per(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def _measure(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    words = Words(raw, offs)
    n, first, document = len(words), words.first, words.documents()
    names = words.hashes()
    in_word = np.zeros((3, n), bool)
    if n:
        cover = np.stack([words.starts, words.ends], axis=1).reshape(-1)
        for k, table_ in enumerate((_LETTER, _SMALL, _LARGE)):
            in_word[k] = np.diff(np.concatenate([[0], np.cumsum(table_[raw])])[cover])[::2] > 0
    repeat, equal = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        equal[1:] = (names[1:] == names[:-1]) & (document[1:] == document[:-1])
    if n > 2:
        at = np.flatnonzero(document[2:] == document[:-2])
        a, b, c = names[at], names[at + 1], names[at + 2]
        window = mix(mix(mix(a) + b) + c) ^ mix(document[at].astype(np.uint64))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = at[twice]
        repeat[hit] = repeat[hit + 1] = repeat[hit + 2] = True
    lines, again = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
    data = raw.tobytes()
    for d in np.flatnonzero(np.diff(first)):
        full = [x for x in data[offs[d] : offs[d + 1]].split(b"\n") if x and not x.isspace()]
        lines[d], again[d] = len(full), len(full) - len(set(full))
    pipe = np.zeros(n, bool)
    if n:
        pipe = (words.ends - words.starts == 1) & (raw[words.starts] == ord("|"))
    return [
        np.diff(first),
        _per(words.inside & ~_CONTINUED[raw], offs),
        _per(_SYMBOL[raw], offs),
        lines,
        again,
        _per(repeat, first),
        _per(in_word[0], first),
        _per(in_word[2] & ~in_word[1], first),
        _per(pipe, first),
        _per(equal, first),
    ]


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the MEASURES of each whole text and ``failed``, a bit for each of the RULES."""
    keep = without(df, *MEASURES, "failed")
    schema = adding(keep, *((m, T.LongType()) for m in MEASURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for row, end, raw, offs in text_chunks(column):
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m.astype(np.int64)) for m in _measure(raw, offs))], names=schema.names)

    failed = F.lit(0).cast("long")
    for n, (_, condition) in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << n)).otherwise(F.lit(0)).cast("long"))
    return keep.mapInArrow(tidied(run), schema).withColumn("failed", failed)


def store(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The ledger, without the texts, written under a path and read from there."""
    rows = without(ledger(df, text), text)
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << BIT[r] for r in rules)


def kept(version: int = max(POLICIES), failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failed).bitwiseAND(mask(POLICIES[version])) == 0


def ablations(rows: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """(rule, failing, alone): rows that fail each rule of a policy, and those that only this rule rejects.

    Patterns of bits are counted first; there are at most 2 to the number of rules.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(mask(POLICIES[version])).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in POLICIES[version]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(mask(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept().alias("kept"), "failed")


_ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d
), windows AS (
  SELECT r, k, word || chr(1) || lead(word, 1) OVER o || chr(1) || lead(word, 2) OVER o AS x FROM words WINDOW o AS (PARTITION BY r ORDER BY k)
), twice AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, x) AS n FROM windows WHERE x IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT k + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS again
  FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), kinds AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS chars,
         count(*) FILTER (WHERE regexp_matches(word, '[A-Za-z\x{C0}-\x{10FFFF}]')) AS letters,
         count(*) FILTER (WHERE regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS uppers,
         count(*) FILTER (WHERE word = '|') AS pipes, count(*) FILTER (WHERE word = before) AS equal
  FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY k) AS before FROM words) GROUP BY r
), m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(chars, 0) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(letters, 0) AS n_letter_words, coalesce(uppers, 0) AS n_upper_words, coalesce(pipes, 0) AS n_pipe_words, coalesce(equal, 0) AS n_equal_neighbours
  FROM d LEFT JOIN kinds USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered c USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (failed = 0) AS kept, CAST(failed AS BIGINT) AS failed
FROM (SELECT *, {bits} AS failed FROM m)
"""
QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL = {"op9_quality": _ORACLE.replace("{bits}", " + ".join(f"CASE WHEN {condition} THEN {1 << n} ELSE 0 END" for n, (_, condition) in enumerate(RULES)))}
