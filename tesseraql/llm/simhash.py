"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into segments, and each enters a table under its value in every
segment and looks up the Hamming ball of some radius around it; complete distances are then verified.
Two fingerprints that differ in at most four bits are within the radius in at least one segment, since
the radii plus one add up to over four: 1 + 1 + 0 in segments of 22, 22 and 20 bits, or, from
MANY distinct fingerprints on, where so short segments would be full, 2 + 1 in two of 32 bits.  Of two
values that differ, the lesser looks up the greater, so half a ball is enough.

Exact copies are folded to distinct fingerprints first.  Rows that meet under a key are compared
in numpy, and only links of a spanning forest leave a group, never all its pairs.  A key under
which many rows meet is dealt out as pairs of blocks of rows, so no task holds an unbounded group.

Cases: null and wordless texts have fingerprint 0 and are linked like any other; a text of one to
three words is one shingle; repeated rows are copies; an empty table gives an empty result; null
ids take part, and the least of a component is its least non-null id; input columns with the name
of result columns are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import adding, table, tidied, without
from .scratch import drop, stored
from .tokens import LOWER

WIDTH, DISTANCE = 4, 4
#: First bit and bits of each segment, and the radius of the ball looked up in it.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Distinct fingerprints from which segments are wide: some 30 then meet by chance under a short segment's value.
MANY = 1 << 25
#: Rows that one task compares with each other under one key are at most twice this.
BLOCK = 512
#: A key with more rows than BLOCK * BLOCKS has blocks of more rows instead of more blocks.
BLOCKS = 64

_LOWER = bytes(LOWER)
_SPREAD = np.zeros((256, 8), np.uint8)
for _b in range(8):
    _SPREAD[:, _b] = np.arange(256) >> _b & 1
_SPREAD = _SPREAD.reshape(-1).view(np.uint64)
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """64 bits; a bit is set if over half the word shingles' XXH64 (seed 42) have it."""
    words = text.translate(_LOWER).split()  # bytes.split: exactly the ASCII white space
    n = len(words) - WIDTH + 1
    if not words:
        return 0
    one, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return h64(one, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:n].tolist()
    hashes = np.array([h64(one[a:b], 42) for a, b in zip(starts, ends[WIDTH - 1 :].tolist())], np.uint64)
    bits = _SPREAD[hashes.view(np.uint8)].reshape(n, 8)  # one byte for each bit
    sums = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(_WEIGHT[2 * sums > n].sum())


def fingerprints(df: DataFrame, text: str = "text", fp: str = "fp") -> DataFrame:
    """The frame with each whole text's fingerprint as a signed long."""
    keep = without(df, fp)
    schema = adding(keep, (fp, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.binary())
            found = np.array([fingerprint(x.as_py()) for x in column], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return keep.mapInArrow(tidied(run), schema)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints under DISTANCE."""
    links, rest = [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, 4_000_000 // len(rest))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(part[:, None] ^ rest[None, :]) <= DISTANCE
            hit = near.any(axis=0)
            if hit.any():
                links += zip(part[near[:, hit].argmax(axis=0)].tolist(), rest[hit].tolist())
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return links


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (k, i, j, fp) that come sorted by (k, i, j): a spanning forest of each group."""
    def settle(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        at = np.concatenate([[0], new, [len(fps)]])
        size = np.diff(at)
        two = at[:-1][size == 2]
        a, b = fps[two], fps[two + 1]
        near = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        links = [*zip(a[near].tolist(), b[near].tolist())]
        for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            links += _forest(np.unique(fps[s : s + n]))
        out = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])

    keys, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        k = np.stack([np.asarray(batch.column(n), np.int64) for n in range(3)], axis=1)
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, np.asarray(batch.column(3), np.int64).view(np.uint64)])
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(new):  # the last group may go on in the next batch
            cut = int(new[-1]) + 1
            yield settle(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(fps):
        yield settle(keys, fps)


def _greater(value: Column, bits: int, radius: int, tag: int) -> Column:
    """The values within the radius that are greater, each with a tag."""
    masks = [sum(1 << b for b in flips) for r in range(1, radius + 1) for flips in combinations(range(bits), r)]
    ball = F.transform(F.from_json(F.lit(json.dumps(masks)), "array<bigint>"), lambda m: value.bitwiseXOR(m))
    return F.transform(F.filter(ball, lambda x: x > value), lambda x: x.bitwiseOR(tag))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column fp) at DISTANCE or less to connect
    everything that all such links connect."""
    entries, probes = [], []
    for n, (first, bits, radius) in enumerate(SEGMENTS if distinct.count() < MANY else WIDE_SEGMENTS):
        value = F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
        entries.append(value.bitwiseOR(n << 32))
        if radius:
            probes.append(_greater(value, bits, radius, n << 32))
    places = distinct.select("fp", F.explode(F.array(*entries)).alias("k"))
    asked = distinct.select("fp", F.explode(F.concat(*probes)).alias("k"))
    found = asked.join(places.select("k").distinct(), "k", "left_semi")
    rows = stored(places.select("k", "fp").union(found.select("k", "fp")), "simhash-keys")
    # a table of its own, so that the join deals both sides anew and Spark can split a key with very many rows
    sizes = stored(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    n = F.col("n")
    sized = rows.join(sizes, "k").select("k", "fp", F.when(n > BLOCK, F.least(F.ceil(n / BLOCK), F.lit(BLOCKS))).otherwise(1).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks").cast("long"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    dealt = sized.select("k", "fp", "blocks", own.cast("int").alias("own")).select("k", "fp", F.explode(pairs).alias("p")).select("k", F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"), "fp")
    meeting = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    out = stored(meeting.mapInArrow(tidied(_met), "a long, b long"), "simhash-links")
    drop(rows, sizes)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with ``fp`` (signed long), ``text_hash`` (XXH64 of the text) and ``component_id``, the least id its links reach."""
    marked = fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")))
    rows = stored(marked.select("doc_id", "text_hash", "fp"), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(distinct.select("fp"))
    joined = components(found)
    drop(found)
    of = distinct.join(joined, distinct.fp == joined.node).select("fp", "root", "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = of.join(least, "root").where("component_id is not null and (least is null or component_id <> least)").select("fp", "component_id")
    named = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = stored(named, "simhash-named")  # dealt anew for the join, so that a fingerprint with many rows can be split
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the frame that stay: of each component the one with the least id (of equal ids the least text
    hash; of rows that repeat both, one)."""
    marked = near_duplicates(df, doc_id, text)
    first = F.min(F.struct("doc_id", "text_hash", "fp"))
    chosen = marked.where("component_id is null or doc_id = component_id").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("of")).agg(first.alias("r"))
    times = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__times")).where("__times > 1")
    keys = chosen.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"))
    again = times.select(F.col("doc_id").alias("__id2"), F.col("text_hash").alias("__hash2"))
    keyed = df.withColumn("__text_hash", F.xxhash64(text))
    id_ = F.col(doc_id)
    stay = keyed.join(keys, id_.eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    same = id_.eqNullSafe(F.col("__id2")) & (F.col("__text_hash") == F.col("__hash2"))
    single = stay.join(again, same, "left_anti")
    repeated = stay.join(again, same, "left_semi").dropDuplicates([doc_id, "__text_hash"])
    return single.union(repeated).drop("__text_hash")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
