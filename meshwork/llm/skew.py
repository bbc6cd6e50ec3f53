"""Joins to a table of groups, of which some may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.staging import partitions


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row per key: its columns and ``found`` (whether it has the key).

    ``weight`` is the number of rows of a group and ``total`` that of all. Groups over a fourth of an even share of a
    partition, of which there are at most four a partition, are broadcast, and their rows stay where they are. So do
    rows with a null key, which have no group: for the shuffle they get keys of their own.
    """
    limit = total / (4 * partitions(rows.sparkSession))
    columns = [c for c in groups.columns if c not in keys and c != weight]
    value = F.struct(*columns, F.lit(True).alias("found"))
    large = groups.where(F.col(weight) > limit).select(*keys, value.alias("large"))
    small = groups.where(F.col(weight) <= limit).select(*[F.col(k).alias(f"small_{k}") for k in keys], F.lit(0).alias("small_salt"), value.alias("small"))
    placed = rows.join(F.broadcast(large), keys, "left")
    apart = F.col("large").isNotNull() | F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)
    placed = placed.withColumn("apart", F.when(apart, F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_003)) + 1).otherwise(0).cast("int"))
    match = [F.when(F.col("apart") == 0, F.col(k)) == F.col(f"small_{k}") for k in keys]
    joined = placed.join(small, [F.col("apart") == F.col("small_salt"), *match], "left")
    found = F.coalesce("large", "small")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in columns], F.coalesce(found["found"], F.lit(False)).alias("found"))
