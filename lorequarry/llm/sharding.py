"""Sharding over fixed virtual slots with a versioned slot-to-shard map, in DataFrame operations only."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Virtual slots; fixed for a corpus, so that a record never changes its slot.
SLOTS = 4096
#: A group of equal texts is kept in one slot up to one part in so many of a shard's share.
WHOLE = 4


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. Edits give a new map with the next version."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1

    @staticmethod
    def balanced(sizes: list[int], shards: int) -> SlotMap:
        """Largest slot first, each to the shard that holds least (ties: the lower shard)."""
        heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
        for v in sorted(range(len(sizes)), key=lambda v: (-sizes[v], v)):
            held, s = heapq.heappop(heap)
            out[v] = s
            heapq.heappush(heap, (held + sizes[v], s))
        return SlotMap(shards, tuple(out))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for v, s in enumerate(self.shard_of):
            out[s] += sizes[v]
        return out

    def rebalanced(self, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
        """As few slot moves as a greedy edit finds: from the fullest shard to the emptiest while that narrows their gap beyond the tolerance."""
        held, shard_of = self.loads(sizes), list(self.shard_of)
        slots: list[list[int]] = [[] for _ in range(self.shards)]
        for v, s in enumerate(shard_of):
            slots[s].append(v)
        mean = sum(held) / max(1, self.shards)
        for _ in range(len(sizes)):
            hi, lo = max(range(self.shards), key=lambda s: (held[s], -s)), min(range(self.shards), key=lambda s: (held[s], s))
            gap = held[hi] - held[lo]
            fits = [v for v in slots[hi] if 0 < sizes[v] < gap]
            if gap <= tolerance * mean or not fits:
                break
            v = min(fits, key=lambda v: (abs(gap / 2 - sizes[v]), v))
            slots[hi].remove(v)
            slots[lo].append(v)
            held[hi], held[lo], shard_of[v] = held[hi] - sizes[v], held[lo] + sizes[v], lo
        return replace(self, shard_of=tuple(shard_of), version=self.version + 1)

    def grown(self, sizes: list[int]) -> SlotMap:
        """One more shard, which takes slots of the fullest shards until it holds its share; nothing else moves."""
        held, shard_of, new = [*self.loads(sizes), 0], list(self.shard_of), self.shards
        share = sum(sizes) / (self.shards + 1)
        for v in sorted(range(len(sizes)), key=lambda v: (-sizes[v], v)):
            s = shard_of[v]
            if sizes[v] and held[s] - sizes[v] >= share * 0.995 and held[new] + sizes[v] <= share * 1.005:
                shard_of[v], held[s], held[new] = new, held[s] - sizes[v], held[new] + sizes[v]
        return SlotMap(new + 1, tuple(shard_of), self.version + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table (one JSON file a version)."""
        row = json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of})
        spark.range(1, numPartitions=1).select(F.lit(row).alias("value")).write.mode("overwrite").text(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or else the latest version."""
        rows = [json.loads(r["value"]) for r in spark.read.text(path).select("value").collect() if r["value"]]  # one row a version
        row = max((r for r in rows if version in (None, r["version"])), key=lambda r: r["version"])
        return SlotMap(row["shards"], tuple(row["shard_of"]), row["version"])

    def column(self, vslot: Column, values: list[int] | None = None) -> Column:
        """The slot's shard (or its entry of values) by a constant array, folded once."""
        return F.get(F.split(F.lit(",".join(map(str, values or self.shard_of))), ",").cast("array<bigint>"), vslot)


def measured(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 and vslot, its virtual slot.

    The slot follows from the text alone, so equal texts lie together. Only a group of equal texts with more bytes than one part
    in WHOLE of a shard's share is split, as no map could balance it: its rows are spread over all slots by their id. There are
    fewer than WHOLE * shards such groups, so they may be named in the plan.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"))
    groups = rows.groupBy("th").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = [r["th"] for r in groups.where((F.col("bytes") > total / (WHOLE * shards)) & (F.col("n") > 1)).select("th").collect()] if total else []
    hashed = F.xxhash64("th")
    spread = F.when(F.col("th").isin(large), F.xxhash64("th", "doc_id")).otherwise(hashed) if large else hashed
    return rows.select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot: pre-aggregated, and never more than slots rows at the driver."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["vslot"]], counts[r["vslot"]] = r["b"], r["n"]
    return sizes, counts


def place(rows: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """measured() rows with shard and slot, the row's place in its shard, gapless from 0.

    A place is the rows of the shard's earlier virtual slots plus the row's number in its own virtual slot, so no shard is
    ever gathered: a task holds some virtual slots' ids and sizes.
    """
    from pyspark.sql import Window

    base, used = [0] * len(counts), [0] * slot_map.shards
    for v, s in enumerate(slot_map.shard_of):
        base[v], used[s] = used[s], used[s] + counts[v]
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    v = F.col("vslot")
    return rows.withColumn("shard", slot_map.column(v).cast("int")).withColumn("slot", slot_map.column(v, base) + F.row_number().over(order) - 1)


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), vslot and map_version.

    Records hash into fixed virtual slots, equal texts into one (see measured() for groups that are too large for that); bytes per slot decide the map from slots to shards, so that shards hold nearly
    equal bytes (a single row is never split: one that is larger than a shard's share fills its shard alone). With map_path,
    an existing map is edited where slot sizes have changed, and the new version is stored beside the old ones.

    Null texts have 8 bytes; null ids hash as such; repeated rows are placed each; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = measured(docs, shards, slots=slots)
    sizes, counts = slot_sizes(rows, slots)
    found = SlotMap.balanced(sizes, shards)
    if map_path:
        try:
            old = SlotMap.load(spark, map_path)
        except Exception as e:  # no map yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old and old.shards == shards and len(old.shard_of) == slots:
            found = old.rebalanced(sizes)
        elif old:
            found = replace(found, version=old.version + 1)
        found.save(spark, map_path)
    out = place(rows, found, counts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(found.version).alias("map_version"))
