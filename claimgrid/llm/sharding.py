"""Fixed virtual slots: records hash into slots, a versioned map sends slots to shards.

A record's virtual slot depends on its id (and, where ids are missing or repeated, on its text)
and never changes. Bytes are summed per slot; the map is drawn up from those sums, heaviest slot
first onto the lightest shard, and later versions edit single entries. Only the slot table, whose
length is the fixed number of slots, reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgrid.llm.common import stored

N_SLOTS = 8192
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, n_rows long, first_position long"


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """First 28 bits of the MD5 of the key, modulo the number of slots."""
    return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % n_slots).cast("int")


def record_key(doc_id: Column, crc: Column, size: Column) -> Column:
    """Id and content: rows that share an id, or have none, still spread over the slots by their texts."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), crc.cast("string"), size.cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus 8, CRC-32 of the text and virtual slot, without the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    key = record_key(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    return rows.withColumn("vslot", virtual_slot(key))


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) for every slot in use; at most as many rows as there are slots."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return [tuple(r) for r in sums.orderBy("vslot").collect()]


def draw_up(sums: list[tuple[int, int, int]], n_shards: int, version: int = 1) -> list[tuple]:
    """Map rows: heaviest slot first, each onto the shard that is lightest so far."""
    heap = [(0, shard) for shard in range(n_shards)]
    shard_of = {}
    for vslot, size, _ in sorted(sums, key=lambda s: (-s[1], s[0])):
        load, shard = heapq.heappop(heap)
        shard_of[vslot] = shard
        heapq.heappush(heap, (load + size, shard))
    return _numbered(sums, shard_of, version)


def _numbered(sums: list[tuple[int, int, int]], shard_of: dict[int, int], version: int) -> list[tuple]:
    """Each slot's first row position in its shard is the sum of the slots before it."""
    filled: dict[int, int] = {}
    out = []
    for vslot, size, n in sorted(sums):
        shard = shard_of[vslot]
        out.append((version, vslot, shard, size, n, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + n
    return out


def rebalanced(entries: list[tuple], sums: list[tuple[int, int, int]], n_shards: int) -> list[tuple]:
    """The next version: new slots join the lightest shard, then single slots move from the
    heaviest to the lightest shard for as long as a move narrows their gap. All else stays."""
    size_of = {vslot: size for vslot, size, _ in sums}
    shard_of = {e[1]: e[2] for e in entries if e[1] in size_of and e[2] < n_shards}
    load = [0] * n_shards
    for vslot, shard in shard_of.items():
        load[shard] += size_of[vslot]
    for vslot in sorted(size_of.keys() - shard_of.keys(), key=lambda s: (-size_of[s], s)):
        shard_of[vslot] = load.index(min(load))
        load[shard_of[vslot]] += size_of[vslot]
    while True:
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        fits = [(abs(gap - 2 * size_of[v]), v) for v, s in shard_of.items() if s == high and 0 < size_of[v] < gap]
        if not fits:
            break
        moved = min(fits)[1]
        shard_of[moved] = low
        load[high] -= size_of[moved]
        load[low] += size_of[moved]
    version = max((e[0] for e in entries), default=0) + 1
    return _numbered(sums, shard_of, version)


def save_map(spark: SparkSession, entries: list[tuple], folder: str) -> None:
    """One Parquet part per version; old versions stay readable."""
    version = entries[0][0] if entries else 1
    spark.createDataFrame(entries, MAP_SCHEMA).coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> list[tuple]:
    """The map of a version, at most one entry per virtual slot."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}").orderBy("vslot")
    return [(version, *r[1:]) for r in rows.collect()]


def placed(rows: DataFrame, entries: list[tuple]) -> DataFrame:
    """Rows with shard and gapless position, by the map and a row number inside each virtual slot."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(e[1], e[2], e[5]) for e in entries], "vslot int, shard int, first_position long")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    # One entry per virtual slot: N_SLOTS rows of three numbers at most.
    return ranked.join(F.broadcast(table), "vslot").withColumn("slot", F.col("first_position") + F.col("__rank"))


def assign_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Every row of ``docs`` with its shard under the law of equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot (position in the shard, gapless from 0),
    grown_shard (null) and vslot. Null texts are empty, null ids are placed by content, repeated
    rows get positions of their own, an empty table gives no rows, and other columns of ``docs``
    are ignored whatever their names.
    """
    rows = stored(sized(docs))
    entries = draw_up(slot_sums(rows), n_shards)
    return placed(rows, entries).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
