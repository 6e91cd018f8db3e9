"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed into thousands of slots, bytes are added up per slot, and a versioned map says which shard each
slot is in. Rebalancing edits that map: slots that a shard holds beyond its fair share move, largest first, each to
the shard that has least. What is per slot has `SLOTS` rows, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 8
#: Rows that are equal in id, text and size up to which they share a virtual slot; more are spread over all slots.
COPIES = 64


def with_virtual_slot(rows: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """Adds virtual_slot to `rows` (row: a number of its own for each; id, text_crc32, size): a hash of the record.

    A record that occurs more than `copies` times has a slot for each remainder of its row numbers instead. Its rows are
    equal, so it doesn't matter which of them is where.
    """
    record = ["id", "text_crc32", "size"]
    often = rows.groupBy(*record).agg(F.count("*").alias("n")).where(F.col("n") > copies).select(*(F.col(c).alias(f"of_{c}") for c in record))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in record]
    part = F.when(F.col("of_size").isNotNull(), F.pmod("row", F.lit(slots)))
    return (rows.join(often, same, "left").withColumn("virtual_slot", F.pmod(F.xxhash64(*record, part), F.lit(slots)).cast("int"))
            .drop(*(f"of_{c}" for c in record)))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0 of a map (version, virtual_slot, shard): slots in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Adds a version to the maps kept in `folder`; a version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """That version of the map kept in `folder`."""
    return (spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")
            .select(F.lit(version).alias("version"), "virtual_slot", "shard"))


def slot_loads(rows: DataFrame, size_col: str = "size") -> DataFrame:
    """Bytes and rows per virtual slot that has any."""
    return rows.groupBy("virtual_slot").agg(F.sum(size_col).alias("bytes"), F.count("*").alias("rows"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of `slot_map`, in which the shards 0 to `shards` - 1 hold nearly equal bytes.

    A shard keeps its largest slots as far as they fit its fair share; the others, and those of shards that are no
    more, move. Ties go by slot and to the lowest shard. Both inputs have a row for each slot at most.
    """
    load = slot_map.join(loads, "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    share = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    load = (load.withColumns({"held": F.sum("bytes").over(share), "total": F.sum("bytes").over(W.partitionBy(F.lit(0)))})
            .withColumn("stays", (F.col("shard") < shards) & (F.col("held") * shards <= F.col("total"))))
    # One row with an array of at most `slots` entries.
    plan = load.agg(F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")))).alias("moving"),
                    F.array(*(F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long") for s in range(shards))).alias("held"))
    moved = plan.select(F.expr(
        """explode(aggregate(moving, struct(held as held, cast(array() as array<struct<virtual_slot:int,target:int>>) as moves),
           (a, m) -> struct(
             transform(a.held, (h, i) -> if(i = array_position(a.held, array_min(a.held)) - 1, h - m.minus, h)) as held,
             concat(a.moves, array(struct(m.virtual_slot as virtual_slot, cast(array_position(a.held, array_min(a.held)) - 1 as int) as target))) as moves),
           a -> a.moves)) as move"""))
    moved = moved.select("move.virtual_slot", "move.target")
    return (load.join(moved, "virtual_slot", "left")
            .select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("target", "shard").cast("int").alias("shard")))


def place(rows: DataFrame, slot_map: DataFrame, loads: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with virtual_slot) with their shard, map_version, and slot: the row's place in its shard, gapless from 0.

    Places are numbered within a virtual slot, by `order`, and shifted by what the shard's earlier slots hold: no
    window spans a shard.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    known = (slot_map.join(loads.select("virtual_slot", F.col("rows").alias("slot_rows")), "virtual_slot")
             .select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base")))
    place_in_slot = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    return rows.withColumn("place", place_in_slot).join(F.broadcast(known), "virtual_slot").withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("base", "place")


def shard_documents(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, size, text_crc32, shard, slot, virtual_slot, map_version) per row of `docs`; sizes of shards near equal.

    size: UTF-8 bytes of the text (null: none) plus 1. Records are hashed by id, text and size, a null id like any other
    value, so that no repeated id or text makes a large slot; rows that are equal in all three are spread if they are
    many, and told apart by their place. Versions 0 and 1 of the map are kept in `folder`, which must hold
    none yet. An empty table gives an empty result; other columns are ignored.
    """
    from .common import written

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
                   .withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows = written(with_virtual_slot(rows, slots), "slots")
    loads = written(slot_loads(rows), "loads")
    save_map(first_map(spark, shards, slots), folder)
    save_map(rebalance(load_map(spark, folder, 0), loads, shards), folder)
    return place(rows, load_map(spark, folder, 1), loads, ["id", "text_crc32", "size", "row"]).drop("row").withColumnRenamed("id", id_col)
