"""Balance, gapless places, versions, growth, and what moves."""

import random
import zlib
from collections import Counter

from tesseraql.llm import sharding as S


def test_law_of_bytes(spark, tmp_path):
    rng = random.Random(6)
    rows = [(n, "é" * rng.randint(0, 400)) for n in range(3000)] + [(5, None), (None, "x"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, size int, vslot string").repartition(6)
    store = f"file://{tmp_path}/map"
    got = S.shard(df, store=store).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1 if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.map_version == 1
    assert sorted(by) == list(range(8))
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    loads = [sum(r.size for r in v) for v in by.values()]
    assert max(loads) - min(loads) <= 0.01 * min(loads)
    now, first = S.SlotMap.load(spark, store), S.SlotMap.load(spark, store, 0)
    assert (now.version, first.version) == (1, 0) and first == S.SlotMap.first()
    assert now.edited == tuple(n for n, (a, b) in enumerate(zip(first.owner, now.owner)) if a != b)
    assert {(r.vslot, r.shard) for r in got} <= set(enumerate(now.owner))


def test_rebalancing_and_growth():
    rng = random.Random(1)
    for _ in range(20):
        weight = [rng.randint(0, 9 ** rng.randint(1, 4)) for _ in range(512)]
        before = S.SlotMap.first(8, 512)
        after = before.rebalanced(weight)
        loads = after.loads(weight)
        assert max(loads) - min(loads) <= max(1, min(max(before.loads(weight)) - min(before.loads(weight)), 0.01 * sum(weight)))
        assert len(after.edited) < 256
        more = after.grown(weight)
        assert more.shards == 9 and more.version == 2
        assert all(more.owner[n] == 8 for n in more.edited) and more.edited
        assert max(more.loads(weight)) <= max(loads)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.shard(df).count() == 0


def test_one_text_holds_most_bytes(spark):
    df = spark.createDataFrame([(0, "x" * 100_000)] + [(n, "y") for n in range(1, 100)], "doc_id long, text string")
    rows = S.shard(df).collect()
    assert len(rows) == 100 and {r.shard for r in rows} == set(range(8))


def test_copies_of_one_row_are_spread(spark, monkeypatch):
    """Nine rows in ten are one record: shards stay within one part in a hundred."""
    monkeypatch.setattr(S, "COPIES", 500)
    one = "the very same text of some length " * 3
    rows = [(7, one)] * 18_000 + [(None, None)] * 400 + [(n, f"text {n} " * 4) for n in range(1600)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    loads = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 8 and max(loads) - min(loads) <= 0.01 * min(loads)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(Counter(r.vslot for r in got).values()) < 60


def test_the_stored_map_is_edited(spark, tmp_path):
    """A later run starts from the newest version and moves few records; without need it edits nothing."""
    store = f"file://{tmp_path}/map"
    rng = random.Random(2)
    rows = [(n, "x" * rng.randint(1, 300)) for n in range(4000)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    first = {r.doc_id: r.shard for r in S.shard(frame(rows), store=store).collect()}
    again = S.shard(frame(rows), store=store).collect()
    assert {r.doc_id: r.shard for r in again} == first and {r.map_version for r in again} == {1}
    more = rows + [(n, "y" * rng.randint(1, 300)) for n in range(4000, 4400)]
    later = S.shard(frame(more), store=store).collect()
    assert {r.map_version for r in later} == {2}
    moved = sum(first[r.doc_id] != r.shard for r in later if r.doc_id in first)
    assert moved < 0.1 * len(rows)
    assert S.SlotMap.load(spark, store).version == 2 and S.SlotMap.load(spark, store, 1).version == 1
