"""Sharding through fixed virtual slots and a versioned map from slots to shards.

Records are hashed into a fixed number of slots, by key, text and a number among equal ones, so
that the rows of a frequent key or text spread. Bytes and rows are summed per slot, and a map
from slots to shards is edited, slot by slot, until the shards hold nearly equal bytes. The map
is a table of (version, slot, shard); every edit is a new version, so old placements stay known.

Defined results: a null text has no bytes; a null key is a key of its own, whose rows spread like
others; repeated rows are separate records; an empty table leaves an even map and no rows;
other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketwise.llm.numbering import numbered
from basketwise.session import materialise

SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot belongs to."""

    version: int
    shard_of: tuple[int, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, or the newest. A map has as many rows as there are slots, whatever the data."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, tuple(r["shard"] for r in rows))


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(0, tuple(slot % shards for slot in range(slots)))


def _move(loads: dict[int, int], shard_of: list[int], held: dict[int, set[int]], heavy: int, light: int, totals) -> bool:
    """Moves the slot, or swaps the pair of slots, that best closes the gap of two shards."""
    gap = totals[heavy] - totals[light]
    best, way = gap, None
    for s in held[heavy]:
        left = abs(gap - 2 * loads[s])
        if left < best:
            best, way = left, (s, None)
    if best * 50 > gap:
        lights = sorted((loads[t], t) for t in held[light])
        for s in held[heavy]:
            want = loads[s] - gap / 2
            for size, t in lights[max(0, _place(lights, want) - 1) : _place(lights, want) + 1]:
                left = abs(gap - 2 * (loads[s] - size))
                if left < best:
                    best, way = left, (s, t)
    if way is None:
        return False
    for s, a, b in ((way[0], heavy, light), (way[1], light, heavy)):
        if s is not None:
            held[a].remove(s)
            held[b].add(s)
            totals[a] -= loads[s]
            totals[b] += loads[s]
            shard_of[s] = b
    return True


def _place(ordered: list[tuple[int, int]], size: float) -> int:
    import bisect

    return bisect.bisect(ordered, (size, -1))


def rebalance(current: SlotMap, loads: dict[int, int], shards: int, near: float = 0.001) -> SlotMap:
    """Edits the map until no shard is over `near` of the mean apart, or no move or swap helps."""
    shard_of = list(current.shard_of)
    loads = {slot: loads.get(slot, 0) for slot in range(len(shard_of))}
    held = {k: set() for k in range(shards)}
    for slot, shard in enumerate(shard_of):
        held[shard].add(slot)
    totals = {k: sum(loads[s] for s in held[k]) for k in held}
    mean = sum(totals.values()) / shards
    for _ in range(20 * len(shard_of)):
        order = sorted(totals, key=totals.get)
        if totals[order[-1]] - totals[order[0]] <= near * mean:
            break
        far = order[0] if totals[order[-1]] - mean < mean - totals[order[0]] else order[-1]
        others = order[::-1] if far == order[0] else order
        pairs = ((k, far) if far == order[0] else (far, k) for k in others if k != far)
        if not any(totals[h] > totals[w] and _move(loads, shard_of, held, h, w, totals) for h, w in pairs):
            break
    return SlotMap(current.version + 1, tuple(shard_of))


def grow(current: SlotMap, loads: dict[int, int], shards: int) -> SlotMap:
    """A map with one more shard; slots move only into the new one, largest gain first."""
    shard_of, new = list(current.shard_of), shards
    totals = {k: 0 for k in range(shards + 1)}
    for slot, shard in enumerate(shard_of):
        totals[shard] += loads.get(slot, 0)
    target = sum(totals.values()) / (shards + 1)
    for slot in sorted(range(len(shard_of)), key=lambda s: (-loads.get(s, 0), s)):
        shard, size = shard_of[slot], loads.get(slot, 0)
        if totals[shard] - size >= 0.995 * target and totals[new] + size <= 1.005 * target:
            totals[shard] -= size
            totals[new] += size
            shard_of[slot] = new
    return SlotMap(current.version + 1, tuple(shard_of))


def records(rows: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, vslot) of every row. A record is known by its key, its text and its number among equal ones."""
    content = F.coalesce(F.col(text), F.lit(""))
    sized = rows.select(
        F.col(key),
        (F.octet_length(content).cast("long") + OVERHEAD).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key), F.col(text)).alias("content"),
    )
    vslot = F.pmod(F.xxhash64("content", "index"), F.lit(slots)).cast("int")
    return materialise(numbered(sized, "content").select(F.col(key), "size", "text_crc32", vslot.alias("vslot")), "records")


def slot_loads(sized: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot; at most as many as there are slots."""
    sums = sized.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return {r["vslot"]: (r["size"], r["n"]) for r in sums.collect()}


def place(sized: DataFrame, shard_map: SlotMap, loads: dict[int, tuple[int, int]], key: str) -> DataFrame:
    """Adds shard and slot, the place in the shard: gapless from 0, slot by slot, by key within a slot.

    A task orders the rows of some slots; where each slot starts in its shard follows from the counts.
    """
    start, ahead = [], {}
    for vslot, shard in enumerate(shard_map.shard_of):
        start.append((vslot, shard, ahead.get(shard, 0)))
        ahead[shard] = ahead.get(shard, 0) + loads.get(vslot, (0, 0))[1]
    starts = sized.sparkSession.createDataFrame(start, "vslot int, shard int, ahead long")
    by_slot = Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")
    ranked = sized.withColumn("place", F.row_number().over(by_slot) - 1)
    # As many rows as there are slots, whatever the data.
    return ranked.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("ahead") + F.col("place"))


def shard(rows: DataFrame, key: str, text: str, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Places all rows: (key, size, text_crc32, shard, slot, vslot). The map's versions go to `map_path`."""
    spark = rows.sparkSession
    sized = records(rows, key, text, slots)
    loads = slot_loads(sized)
    even_map(shards, slots).save(spark, map_path)
    rebalance(load_map(spark, map_path), {s: b for s, (b, _) in loads.items()}, shards).save(spark, map_path)
    return place(sized, load_map(spark, map_path), loads, key).select(
        key, "size", "text_crc32", "shard", "slot", F.col("vslot").alias("virtual_slot")
    )
