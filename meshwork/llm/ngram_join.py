"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix with itself.

Rows of the matrix are distinct shingle sets (documents with equal sets are one row). Columns are ordered from rare
to common, by a fixed-size count sketch of the whole corpus and then by hash. Two sets of Jaccard ``num/den`` share a
column among the first n - ceil(n num/den) + 1 of either, so only that block of columns is multiplied first: it gives
candidate pairs and accumulates their overlaps, and a pair is discarded when its size or the most it can still share
is too small. The rest of the product is done for surviving pairs only.

Pairs inside a group of near copies would be quadratic, so the first round pairs each row with the most central row
of each column; after it, only pairs in different components are left, and the second round takes all of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.components import components
from meshwork.llm.skew import with_groups
from meshwork.llm.staging import partitions, staged
from meshwork.llm.text_arrays import U64, WORD_LOWER, mix, shingle_sets

#: Counters of the column sketch and of one row in which they travel; slots of the filter of rows with candidates.
SKETCH, BLOCK, SLOTS = 1 << 20, 1 << 14, 1 << 24


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64), pa.int64())


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-n * num // den) + 1 if n else 0


def _summaries(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, f1, f2) of each text's set, and rows of the task's column counts (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "f1", "f2", "block", "counts"]
        sketch, kind = np.zeros(SKETCH, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            out = np.zeros((3, batch.num_rows), np.int64)
            waiting: list[np.ndarray] = []
            held = 0
            with np.errstate(over="ignore"):
                for i, found in enumerate(shingle_sets(batch.column(1), size)):
                    hashed = mix(found)
                    out[:, i] = len(found), hashed.sum(dtype=U64).astype(np.int64), np.bitwise_xor.reduce(mix(hashed ^ U64(len(found)))).astype(np.int64)
                    waiting.append(found)
                    held += len(found)
                    if held > SKETCH:
                        sketch += np.bincount((np.concatenate(waiting) >> U64(44)).astype(np.int64), minlength=SKETCH)
                        waiting, held = [], 0
            if held:
                sketch += np.bincount((np.concatenate(waiting) >> U64(44)).astype(np.int64), minlength=SKETCH)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if kind is not None:
            rows = [(k, sketch[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(SKETCH // BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), kind), *(pa.nulls(len(rows), pa.int64()) for _ in range(3)), pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                names=names,
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, block int, counts binary")


def _sketch(summaries: DataFrame) -> np.ndarray:
    """The corpus's column counts: SKETCH numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    blocks = summaries.where("block is not null").select("block", "counts").repartition(partitions(summaries.sparkSession), "block")
    whole = np.zeros(SKETCH, np.int64)
    for row in blocks.mapInArrow(add, "block int, counts binary").collect():
        whole[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return whole


def _prefixes(docs: DataFrame, size: int, num: int, den: int, sketch) -> DataFrame:
    """(id, n, heart, columns): each set's rarest columns, in the common order, as many as a partner can't avoid.

    ``heart`` is the mean count of the set's columns: the original of many edited copies has more than they."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = sketch.value
        for batch in batches:
            sizes, hearts, parts = [], [], []
            for found in shingle_sets(batch.column(1), size):
                loads = load[(found >> U64(44)).astype(np.int64)]
                order = np.argsort(loads, kind="stable")
                sizes.append(len(found))
                hearts.append(int(loads.sum()) // max(len(found), 1))
                parts.append(found[order[: prefix_length(len(found), num, den)]].astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(ends), _ints(np.concatenate(parts) if parts else np.empty(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hearts, pa.int64()), columns], names=["id", "n", "heart", "columns"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, heart long, columns array<long>")


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(id, grams): packed sets of the ids in ``wanted``, and of some others: wanted ids mark a bitmap of fixed size."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    words = wanted.select(slot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))
    bitmap = np.zeros(SLOTS // 64, np.int64)
    for row in words.collect():  # SLOTS / 64 rows at most
        bitmap[row["w"]] = row["bits"]
    marked = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marked.value[slots >> 6] >> (slots & 63)) & 1 == 1))
            found = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "grams"])

    return docs.withColumn("slot", slot).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, grams binary")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of which the whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                at = np.searchsorted(two, one)
                shared = int((two[np.minimum(at, len(two) - 1)] == one).sum())
                linked.append(den * shared >= num * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = sets.schema["id"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def similar(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (of the text's set) and component_id, the smallest id reachable by
    links of Jaccard similarity ``num / den`` or more between sets of ``size``-word shingles, itself included.

    Letters A-Z are lower-cased. A text with fewer words than ``size`` has its whole sequence as one shingle; a null
    or empty text, or one without words, has no shingle and links with nothing. Equal sets always link. Rows that
    share an id are one document. A row with a null id gets the component of its text's group, null if all are null.
    Empty table: no rows. Other columns are ignored. Shingles are compared by 64-bit hash.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    summaries = staged(_summaries(docs, size), "ngram-summaries")
    sketch = spark.sparkContext.broadcast(_sketch(summaries))
    rows = summaries.where("block is null").select("id", "n", "f1", "f2")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = classes.where("rep is not null").select(F.col("rep").alias("id"))

    entries = (
        _prefixes(docs, size, num, den, sketch)
        .where("n > 0")
        .join(reps, "id", "left_semi")
        .select("id", "n", "heart", F.posexplode("columns").alias("place", "gram"))
        .select("gram", "id", "heart", F.expr("shiftleft(n, 32) | place").alias("at"))
    )
    # The most central row of each column; a column of very many rows is broadcast to them instead of gathering them.
    columns = entries.groupBy("gram").agg(F.count("*").alias("m"), F.min(F.struct((-F.col("heart")).alias("less"), "id", "at")).alias("first"), F.min("id").alias("low"), F.max("id").alias("high"))
    columns = staged(columns.where("low != high").drop("low", "high"), "ngram-columns")
    total = columns.agg(F.sum("m")).first()[0] or 0
    shared = staged(with_groups(entries.select("gram", "id", "at"), columns, ["gram"], "m", total).where("found").drop("found"), "ngram-shared")
    sized = lambda x, y: f"{den} * least({x}, {y}) >= {num} * greatest({x}, {y})"
    n_of = lambda x: f"shiftright({x}, 32)"

    # From a shared column on, two sets share at most what is left of either.
    reaching = lambda x, y: f"{den + num} * least({n_of(x)} - ({x} & 4294967295L), {n_of(y)} - ({y} & 4294967295L)) >= {num} * ({n_of(x)} + {n_of(y)})"

    stars = shared.where("id != first.id").where(sized(n_of("at"), n_of("first.at"))).where(reaching("at", "first.at"))
    stars = stars.select(F.least("id", "first.id").alias("a"), F.greatest("id", "first.id").alias("b")).distinct()
    stars = staged(stars, "ngram-stars")
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = staged(_links(stars, staged(_sets(docs, size, ids(stars)), "ngram-sets"), num, den), "ngram-links")
    found = components(links)

    # Second round: columns whose rows are still in several components; every pair has a row outside the column's largest one.
    placed = shared.drop("first").join(found, shared["id"] == found["node"], "left").select("gram", "id", "at", F.coalesce("component", "id").alias("c"))
    tally = placed.groupBy("gram", "c").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"))
    mixed = staged(placed.join(tally.where("parts > 1"), "gram").drop("parts"), "ngram-mixed")
    x = mixed.select("gram", *[F.col(k).alias(f"x_{k}") for k in ("id", "at", "c")], (F.col("c") != F.col("main")).alias("x_apart"))
    y = mixed.where("c != main").select("gram", *[F.col(k).alias(f"y_{k}") for k in ("id", "at", "c")])
    met = x.join(y, "gram").where("x_c != y_c and (not x_apart or x_id < y_id)").where(sized(n_of("x_at"), n_of("y_at"))).where(reaching("x_at", "y_at"))
    turned = F.col("x_id") < F.col("y_id")
    overlap = (
        met.select(
            F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"),
            F.when(turned, F.col("x_at")).otherwise(F.col("y_at")).alias("at_a"), F.when(turned, F.col("y_at")).otherwise(F.col("x_at")).alias("at_b"),
        )
        .groupBy("a", "b")  # a column out of reach comes after all that are within, so none before the last is missing
        .agg(F.count("*").alias("sum"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    )
    rest = lambda at: f"(shiftright({at}, 32) - 1 - ({at} & 4294967295L))"
    most = f"(sum + least({rest('at_a')}, {rest('at_b')}))"
    open_pairs = overlap.where(f"{den + num} * {most} >= {num} * (shiftright(at_a, 32) + shiftright(at_b, 32))")
    open_pairs = staged(open_pairs.select("a", "b").join(stars, ["a", "b"], "left_anti"), "ngram-open")
    more = _links(open_pairs, staged(_sets(docs, size, ids(open_pairs)), "ngram-sets"), num, den)
    # Links of the first round are now its components' stars: the second adds few.
    found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    grouped = classes.join(found, classes["rep"] == found["node"], "left").select("n", "f1", "f2", "weight", F.coalesce("component", "rep").alias("group"))
    grouped = staged(grouped, "ngram-groups").withColumnsRenamed({"n": "k", "f1": "k1", "f2": "k2"})
    rows = rows.select("id", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(k) for c, k in (("n", "k"), ("f1", "k1"), ("f2", "k2"))])  # no set, no group
    total = grouped.agg(F.sum("weight")).first()[0] or 0
    return with_groups(rows, grouped, ["k", "k1", "k2"], "weight", total).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("group", "id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Texts without a shingle (null, empty, no words) link with nothing and stay, as do rows with a null id; rows that
    share an id are one document and stay or go together, repeats of one text once. An empty table has no rows; all columns
    stay, whatever their names.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    later = similar(docs, **options).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("later_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("digest"))
    rest = rows.join(later, rows["id"] == later["later_id"], "left_anti")
    known = rest.where("id is not null").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return known.select("row.*").unionByName(rest.where("id is null").select("row.*"))


#: DuckDB SQL for shingles of 4 words and 85 of 100.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end sh from w),
g as (select doc_id, len(sh) n, unnest(sh) gram from s),
p as (select a.doc_id a, b.doc_id b from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r as (select doc_id a, doc_id b from s union select r.a, e.b from r join e on r.b = e.a)
select s.doc_id, cast(len(sh) as bigint) n_shingles, m component_id from s join (select a, min(b) m from r group by a) on a = s.doc_id"""
