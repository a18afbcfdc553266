"""Sharding over fixed virtual slots.

Every record is hashed into one of SLOTS virtual slots, for good.  Records that are equal in all
columns are counted first and numbered, and the number is hashed too, so copies spread over the slots
and no slot is as heavy as a repeated record.  Bytes and rows are summed for each slot; a versioned map
says which shard owns a slot.  Version 0 deals slots round; a rebalancing starts from the newest stored
version, edits as few entries as it needs and makes the next version, or none if nothing is to be
edited, so only the records of edited slots move.  A record's place in its shard is the number of rows
in its shard's earlier slots plus its rank in its own slot: no window ever spans a shard.

Only the sums of the slots, a fixed number, come to the driver.  Everything else is DataFrame
functions.

Cases: a null text has size 1 and the checksum of an empty text; a null id is hashed as null; copies of
a record are interchangeable; a text heavier than a shard's share fills its shard alone, as far as it
can; texts of any length are measured whole; columns named as result columns are replaced; an empty
table gives an empty result and leaves the map as it is.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import table, without
from .scratch import folder, stored

SLOTS, SHARDS = 4096, 8
#: Copies of one record that one row stands for while they are dealt.
COPIES = 4096


@dataclasses.dataclass(frozen=True)
class SlotMap:
    """Owner of each slot; every edit makes a further version."""

    shards: int
    owner: tuple[int, ...]
    version: int = 0
    edited: tuple[int, ...] = ()

    @staticmethod
    def first(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return SlotMap(shards, tuple(s % shards for s in range(slots)))

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, w in zip(self.owner, weight):
            out[s] += w
        return out

    def next(self, owner: list[int], shards: int) -> SlotMap:
        edited = tuple(n for n, (a, b) in enumerate(zip(self.owner, owner)) if a != b)
        return dataclasses.replace(self, shards=shards, owner=tuple(owner), version=self.version + 1, edited=edited)

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """Moves or swaps slots between the fullest and the emptiest shard while that narrows their gap.

        Every step lowers the sum of the loads' squares, so it ends.  Without an edit the version stays.
        """
        owner, load = list(self.owner), self.loads(weight)
        while True:
            full, low = max(range(self.shards), key=lambda s: load[s]), min(range(self.shards), key=lambda s: load[s])
            gap = load[full] - load[low]
            theirs = sorted((weight[n], n) for n, s in enumerate(owner) if s == low)
            best = (gap, -1, -1)  # what is left of the gap, the slot given, the slot taken
            for n, s in enumerate(owner):
                if s != full or not weight[n]:
                    continue
                best = min(best, (abs(gap - 2 * weight[n]), n, -1))
                at = bisect.bisect_left(theirs, (weight[n] - gap // 2, -1))
                for w, other in theirs[max(0, at - 1) : at + 1]:
                    best = min(best, (abs(gap - 2 * (weight[n] - w)), n, other))
            if best[1] < 0 or best[0] >= gap:
                break
            given, taken = best[1], best[2]
            owner[given] = low
            moved = weight[given]
            if taken >= 0:
                owner[taken] = full
                moved -= weight[taken]
            load[full] -= moved
            load[low] += moved
            if best[0] <= 1 and max(load) - min(load) <= 1:
                break
        return self.next(owner, self.shards) if tuple(owner) != self.owner else self

    def grown(self, weight: list[int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards until it has its share; no other slot moves."""
        owner, load = list(self.owner), [*self.loads(weight), 0]
        share = sum(weight) / (self.shards + 1)
        for n in sorted(range(len(owner)), key=lambda n: (-weight[n], n)):
            source = owner[n]
            if load[-1] + weight[n] <= share and load[source] - weight[n] >= min(share, load[source] * 0.5):
                load[source] -= weight[n]
                load[-1] += weight[n]
                owner[n] = self.shards
        return self.next(owner, self.shards + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard, edited)."""
        rows = F.from_json(F.lit(json.dumps(self.owner)), "array<int>")
        edits = F.from_json(F.lit(json.dumps(self.edited)), "array<int>")
        return spark.range(1).select(F.posexplode(rows).alias("vslot", "shard")).select(F.lit(self.version).alias("version"), "vslot", "shard", F.array_contains(edits, F.col("vslot")).alias("edited"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={self.version}")

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS"))
        return bool(found)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The newest stored version, or the one asked for."""
        all_ = spark.read.parquet(path)
        version = all_.agg(F.max("version")).first()[0] if version is None else version
        rows = all_.where(F.col("version") == version).select("vslot", "shard", "edited").orderBy("vslot").collect()
        return SlotMap(max(r["shard"] for r in rows) + 1, tuple(r["shard"] for r in rows), version, tuple(r["vslot"] for r in rows if r["edited"]))


def records(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """The frame without the texts, with size, text_crc32 and the virtual slot of each record.

    Equal records are counted first and numbered.  A row stands for COPIES of them at most before they
    are dealt, and rows that stand for many go to tasks of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    facts = {"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body), "__hash": F.xxhash64(text, F.col(text).isNull())}
    sized = without(without(df, "size", "text_crc32", "vslot", "slot", "shard", "law", "map_version", "__hash", "__n", "__from", "__copy").withColumns(facts), text)
    counted = stored(sized.groupBy(*(F.col(f"`{c}`") for c in sized.columns)).agg(F.count("*").alias("__n")), "shard-records")
    few = counted.where(F.col("__n") <= COPIES).withColumn("__from", F.lit(0).cast("long"))
    many = counted.where(F.col("__n") > COPIES).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("__hash", "__from")
    each = few.unionByName(many).withColumn("__copy", F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col("__n")) - 1)))
    slot = F.pmod(F.xxhash64(doc_id, "__hash", "__copy"), F.lit(slots)).cast("int")
    return each.withColumn("vslot", slot).drop("__n", "__from")


def slot_sums(sized: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot."""
    size, rows = [0] * slots, [0] * slots
    for r in sized.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return size, rows


def shard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """The records (without their texts) with shard, their place in it (slot), virtual slot and map version.

    store: the folder of a versioned map, whose newest version is edited and which gets the next one.
    slot_map: the map to edit where nothing is stored (default: the first one for SHARDS shards).
    """
    spark = df.sparkSession
    known = bool(store) and SlotMap.stored(spark, store)
    slot_map = SlotMap.load(spark, store) if known else slot_map or SlotMap.first()
    slots = len(slot_map.owner)
    sized = records(df, doc_id, text, slots)
    size, rows = slot_sums(sized, slots)
    now = slot_map.rebalanced(size)
    if store:
        if not known:
            slot_map.save(spark, store)
        if now.version != slot_map.version:
            now.save(spark, store)
    before, seen = [], [0] * now.shards
    for owner, n in zip(now.owner, rows):
        before.append(seen[owner])
        seen[owner] += n
    of = lambda values: F.element_at(F.from_json(F.lit(json.dumps(values)), "array<long>"), F.col("vslot") + 1)
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(doc_id, "text_crc32", "size", "__hash", "__copy"))
    out = sized.withColumn("rank", rank)
    return out.withColumns({"law": F.lit("bytes"), "shard": of(now.owner).cast("int"), "slot": of(before) + F.col("rank") - 1, "map_version": F.lit(now.version)}).drop("rank", "__hash", "__copy")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of a table is kept under its path, so a later run over the grown table edits it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    out = shard(docs, store=f"{folder(spark).rstrip('/')}/slot-map-{kept}")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


QUERIES = {"op10_sharding": op10_sharding}
