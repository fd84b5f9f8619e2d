"""Sharding by fixed virtual slots, in DataFrame operations only on the rows."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, scratch_path

SLOTS = 4096
SHARDS = 16
#: A slot with more rows than this many times the mean is ordered in several parts.
PART_FACTOR = 8


@dataclass(frozen=True)
class Part:
    """A virtual slot, or a piece of a hot one, and where its rows go.

    A crowded slot is divided by a hash of the text into ``subs``. A text in very many copies has a
    slot of its own, which is divided by a hash of the id into ``parts``.
    """

    vslot: int
    sub: int
    subs: int
    part: int
    parts: int
    rows: int
    bytes: int
    shard: int = -1

    @property
    def place(self) -> tuple[int, int, int]:
        return self.vslot, self.sub, self.part


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map; its size depends on the number of slots, not on the data."""

    version: int
    shards: int
    entries: tuple[Part, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for e in self.entries:
            out[e.shard] += e.bytes
        return out


def plan(parts: list[Part], shards: int) -> SlotMap:
    """Version 1: largest first, each to the lightest shard.

    No text is in two subs, and all parts of a hot text stay together, so equal texts share a shard.
    Only where a hot text alone outweighs a fair share do its parts go to different shards.
    """
    total = sum(p.bytes for p in parts)
    weight: dict[tuple[int, int], int] = {}
    for p in parts:
        weight[p.vslot, p.sub] = weight.get((p.vslot, p.sub), 0) + p.bytes
    units: dict[tuple[int, int, int], list[Part]] = {}
    for p in parts:
        alone = weight[p.vslot, p.sub] * shards > total
        units.setdefault((p.vslot, p.sub, p.part if alone else -1), []).append(p)
    heap = [(0, s) for s in range(shards)]
    done = []
    for _, unit in sorted(units.items(), key=lambda kv: (-sum(p.bytes for p in kv[1]), kv[0])):
        load, shard = heapq.heappop(heap)
        done += [replace(p, shard=shard) for p in unit]
        heapq.heappush(heap, (load + sum(p.bytes for p in unit), shard))
    return SlotMap(1, shards, tuple(sorted(done, key=lambda p: p.place)))


def grow(old: SlotMap, shards: int) -> SlotMap:
    """The next version with more shards: entries move only into the new shards, none between old ones.

    Parts of one sub that share a shard move together.
    """
    if shards < old.shards:
        raise ValueError("grow() cannot remove shards")
    entries = {e.place: e for e in old.entries}
    load = old.loads() + [0] * (shards - old.shards)
    fair = sum(load) / shards
    together: dict[tuple[int, int, int], list[Part]] = {}
    for e in old.entries:
        together.setdefault((e.vslot, e.sub, e.shard), []).append(e)
    held: dict[int, list[tuple[int, tuple, list[Part]]]] = {}
    split = Counter(key[:2] for key in together)
    for key, unit in together.items():
        for own in [[e] for e in unit] if split[key[:2]] > 1 else [unit]:
            held.setdefault(key[2], []).append((sum(e.bytes for e in own), own[0].place, own))
    for units in held.values():
        units.sort(key=lambda u: u[:2])
    for new in range(old.shards, shards):
        while load[new] < fair:
            giver = max(range(old.shards), key=lambda s: (load[s], -s))
            room = min(fair - load[new], load[giver] - fair)
            fit = [u for u in held.get(giver, []) if u[0] <= room]
            if not fit:
                break
            held[giver].remove(fit[-1])
            for e in fit[-1][2]:
                entries[e.place] = replace(e, shard=new)
            load[giver] -= fit[-1][0]
            load[new] += fit[-1][0]
    return SlotMap(old.version + 1, shards, tuple(entries[k] for k in sorted(entries)))


COLUMNS = ("vslot", "sub", "subs", "part", "parts", "rows", "bytes", "shard")
MAP = "version int, shards int, vslot int, sub int, subs int, part int, parts int, rows long, bytes long, shard int"


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append one version to the table of maps at ``path``, partitioned by version."""
    rows = [(slot_map.version, slot_map.shards, *(getattr(e, c) for c in COLUMNS)) for e in slot_map.entries]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.schema(MAP).parquet(path).where(F.col("version") == version).orderBy("vslot", "sub", "part").collect()
    return SlotMap(version, rows[0]["shards"] if rows else 0, tuple(Part(*(r[c] for c in COLUMNS)) for r in rows))


def rebalance(spark: SparkSession, path: str, version: int, shards: int) -> SlotMap:
    """Edit a stored version of the map for more shards and store the next one beside it."""
    new = grow(load_map(spark, path, version), shards)
    save_map(spark, new, path)
    return new


def _sub_of(subs):
    return F.pmod(F.xxhash64(F.col("h"), F.lit("sub")), subs).cast("int")


def _part_of(parts):
    return F.pmod(F.xxhash64(F.col("id"), F.lit("part")), parts).cast("int")


def hot_texts(rows: DataFrame, slots: int) -> tuple[int, list[tuple[int, int]]]:
    """(mean rows of a slot, hot texts): the hash of each text with over PART_FACTOR times that mean, and a slot
    of its own, numbered from ``slots`` on.

    Only rows of crowded slots are counted by text. The driver gets at most ``slots`` counts and at
    most ``slots / PART_FACTOR`` texts.
    """
    per = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).collect()
    mean = max(1, math.ceil(sum(r["n"] for r in per) / slots))
    crowded = [(r["vslot"],) for r in per if r["n"] > PART_FACTOR * mean]
    if not crowded:
        return mean, []
    own = rows.join(F.broadcast(rows.sparkSession.createDataFrame(crowded, "vslot int")), "vslot")
    texts = own.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_FACTOR * mean).orderBy("h").collect()
    return mean, [(r["h"], slots + i) for i, r in enumerate(texts)]


def measure(rows: DataFrame, slots: int, mean: int) -> list[Part]:
    """Bytes and rows per slot. Hot texts' own slots are divided by a hash of the id, other crowded slots by a
    hash of the text; the pieces are counted again. The driver gets at most ``slots`` counts and
    ``slots / PART_FACTOR`` more, and those of about as many pieces."""
    totals = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")]
    per = rows.groupBy("vslot").agg(*totals).collect()
    pieces = {r["vslot"]: max(1, r["n"] // (PART_FACTOR * mean)) for r in per}
    out = [Part(r["vslot"], 0, 1, 0, 1, r["n"], r["b"]) for r in per if pieces[r["vslot"]] == 1]
    wide = [(v, n) for v, n in pieces.items() if n > 1]
    if wide:
        own = rows.join(F.broadcast(rows.sparkSession.createDataFrame(wide, "vslot int, pieces int")), "vslot")
        piece = F.when(F.col("vslot") < slots, _sub_of(F.col("pieces"))).otherwise(_part_of(F.col("pieces")))
        for r in own.groupBy("vslot", "pieces", piece.alias("piece")).agg(*totals).collect():
            place = (r["piece"], r["pieces"], 0, 1) if r["vslot"] < slots else (0, 1, r["piece"], r["pieces"])
            out.append(Part(r["vslot"], *place, r["n"], r["b"]))
    return sorted(out, key=lambda p: p.place)


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    slots: int = SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_path: str | None = None,
    next_shards: int | None = None,
) -> DataFrame:
    """Deal rows into ``shards`` shards of near-equal bytes.

    A row's virtual slot is a hash of its text, one of ``slots``, so equal texts share a slot.
    Bytes per slot are aggregated, and a map assigns each slot to a shard (``plan``); it is stored at
    ``map_path``, and ``rebalance`` edits it into the next version, for ``next_shards`` shards (one
    more by default). The text is read once; what is shuffled is the id and four numbers. A text in
    far more copies than a slot has rows on average gets a slot of its own, divided by a hash of the
    id, so no task orders more than a small part of a hot group; the other texts of its slot stay
    where they are. Equal texts share a shard unless they outweigh one.

    Columns: id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot
    (the row's place in its shard, gapless from 0), grown_shard (null under this law),
    virtual_slot, map_version, next_shard (the row's shard under the map's next version).

    Defined cases: a null text has size 1 and the CRC of the empty string; repeated rows and
    ties each get their own place; null ids are placed like others; an empty table gives no
    rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
        ),
        "shard-rows",
    )
    map_path = map_path or scratch_path(spark, "slot-map")
    mean, hot = hot_texts(rows, slots)
    hot = F.broadcast(spark.createDataFrame(hot, "h long, own int"))
    rows = rows.join(hot, "h", "left").withColumn("vslot", F.coalesce("own", "vslot")).drop("own")
    slot_map = plan(measure(rows, slots, mean), shards)
    save_map(spark, slot_map, map_path)
    later = {e.place: e.shard for e in rebalance(spark, map_path, slot_map.version, next_shards or shards + 1).entries}
    table: dict[int, list[list]] = {}
    first = [0] * shards
    for e in slot_map.entries:
        subs = table.setdefault(e.vslot, [[] for _ in range(e.subs)])
        subs[e.sub] = subs[e.sub] or [None] * e.parts
        subs[e.sub][e.part] = (e.shard, first[e.shard], later[e.place])
        first[e.shard] += e.rows
    places = spark.createDataFrame(
        list(table.items()), "vslot int, places array<array<struct<shard: int, first: long, later: int>>>"
    )
    at = F.element_at("own", F.col("part") + 1)
    order = Window.partitionBy("vslot", "sub", "part").orderBy("id", "crc", "size")
    return (
        rows.join(F.broadcast(places), "vslot")
        .withColumn("sub", _sub_of(F.size("places")))
        .withColumn("own", F.element_at("places", F.col("sub") + 1))
        .withColumn("part", _part_of(F.size("own")))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            at["shard"].alias("shard"),
            (at["first"] + F.row_number().over(order) - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("vslot").alias("virtual_slot"),
            F.lit(slot_map.version).alias("map_version"),
            at["later"].alias("next_shard"),
        )
    )
