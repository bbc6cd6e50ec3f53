"""Sinks with fixed formats, read-back, tables in the cluster's shared folder and small reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a table of places is sent to where it is looked up (some 60 MB).
FEW = 1 << 20
#: Tables written since ``alone`` or ``lasting`` began, the innermost last.
_written: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, which only a single machine may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshwork-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives back its shuffle files at its end: else they stay until the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(frame: DataFrame, name: str = "table") -> DataFrame:
    """``frame`` as a Parquet table in the shared folder, read back: its lineage is cut, and a lost executor costs a re-read.
    Shuffles that made it are removed, as nothing reads them again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        frame.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    if _written:
        _written[-1].append(table)
    return table


@contextmanager
def lasting() -> Iterator[None]:
    """Tables written inside stay, also where this is inside ``alone``."""
    _written.append([])
    try:
        yield
    finally:
        _written.pop()


def alone(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """What ``make`` returns as a table; all other tables that it writes on the way are given back."""
    used: list[DataFrame] = []
    _written.append(used)
    try:
        made = make()
    finally:
        _written.pop()
    table = checkpointed(made, name)
    given_back(*used)
    return table


def sent(frame: DataFrame) -> DataFrame:
    """``frame`` to be broadcast if it has few rows."""
    return F.broadcast(frame) if frame.count() <= FEW else frame


def given_back(*tables: DataFrame) -> None:
    """The files of tables of ``checkpointed`` that nothing reads any more are removed: each is overwritten by an empty table."""
    for table in tables:
        empty = table.sparkSession.createDataFrame([], table.schema)
        for path in sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()}):
            empty.write.mode("overwrite").parquet(path)
        for used in _written:
            used[:] = [t for t in used if t is not table]


def bucketed(frame: DataFrame, column: str, name: str = "table") -> DataFrame:
    """``frame`` as a table in the shared folder, in a bucket a partition by ``column``: joins on it don't shuffle its rows again."""
    spark = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = partitions(spark)
    frame.repartition(n, column).write.bucketBy(n, column).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def formatted(frame: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Columns as text in printf formats, others as they are."""
    return frame.withColumns({c: F.format_string(f, F.col(c)) for c, f in formats.items()})


def write_csv(frame: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    formatted(frame, formats or {}).write.mode("overwrite").option("header", True).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """All chunks below a folder with the given columns; a column that they lack is null."""
    found = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(folder)
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).alias(c) for c in columns])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a JSON document of lists."""
    found = spark.read.option("multiLine", True).json(path)
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("names")) for c in found.columns]
    return found.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", F.explode("p.names").alias("value"))


def markdown(frame: DataFrame) -> DataFrame:
    """Rows of a GFM table; null is empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns]
    return frame.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def document(limit: int = 10_000, **parts: DataFrame) -> DataFrame:
    """One row of JSON text that holds result tables as arrays; a table of more than ``limit`` rows is an error."""
    out = None
    for name, frame in parts.items():
        if (n := frame.limit(limit + 1).count()) > limit:
            raise ValueError(f"{name} has more than {limit} rows ({n}); write it as a table")
        one = frame.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*frame.columns)))).alias(name))
        out = one if out is None else out.join(one)
    return out


def picked(frame: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; one that ``frame`` lacks is null."""
    return frame.select(*[F.col(f"`{c}`") if c in frame.columns else F.lit(None).cast("string").alias(c) for c in names])


def leaves(document: DataFrame, column: str) -> DataFrame:
    """(path, value) of the members of a JSON object: two levels, deeper ones as JSON text."""
    top = document.select(F.explode(F.from_json(column, "map<string,string>")).alias("a", "v"))
    inner = F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), "map<string,string>")
    return top.select("a", "v", F.explode_outer(inner).alias("b", "w")).select(F.concat_ws(".", "a", "b").alias("path"), F.coalesce("w", "v").alias("value"))


def differences(one: DataFrame, two: DataFrame, relative: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """Paths whose values differ between two (path, value) tables: missing on a side, or not close as numbers or equal as text."""
    both = one.select("path", F.col("value").alias("here")).join(two.select("path", F.col("value").alias("there")), "path", "full_outer")
    x, y = F.expr("try_cast(here as double)"), F.expr("try_cast(there as double)")
    near = F.abs(x - y) <= F.greatest(relative * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
    return both.where(F.col("here").isNull() | F.col("there").isNull() | ~F.coalesce(near, F.col("here") == F.col("there")))
