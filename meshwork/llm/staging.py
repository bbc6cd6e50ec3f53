"""Tables written to the folder that the whole cluster shares.

A staged table cuts lineage: a lost executor costs a re-read, not a recomputation of everything before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.sources.sinks import checkpointed as staged
from meshwork.sources.sinks import partitions, shared_folder

__all__ = ["partitions", "shared_folder", "staged", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
