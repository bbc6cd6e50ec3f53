"""Contiguous shards of near-equal bytes, from global prefix sums.

Only (id, size, digest) rows move. They are range-partitioned by id; a partition's total is one row, the totals'
running sum places each partition, and a running sum inside each partition places each row. A row goes to the shard
in whose equal share of all bytes its middle byte falls. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.staging import partitions, staged


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs`` into ``shards`` runs of consecutive ids with sizes as equal as whole documents allow.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1). Returns id, size, text_crc32, law ('bytes'), shard,
    slot (from 0 without gaps in each shard), grown_shard (null under this law). Empty table: no rows. Null ids come
    first. Repeated rows each take their own slot; ties are ordered by size and digest, then are interchangeable.
    A text larger than a share leaves later shards with less or nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = ["id", "size", "text_crc32"]
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    # The partition of each row must not change when tasks run again, so the ranged rows are written once.
    ranged = staged(rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per document
    whole = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("to_here", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
        .join(F.broadcast(starts), "part")
        .select(
            *order,
            (F.col("rows_before") + F.col("nth") - 1).alias("row"),
            F.expr(f"cast(((2 * (bytes_before + to_here) - size) * {shards}) div (2 * total) as int)").alias("shard"),
        )
    )
    # Where each shard starts: one row per partition and shard at most, then one per shard.
    first = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("shard_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
