"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its DESCRIBED nearest reference points (pivots) in the order of nearness. Pivots are a sample
of the vectors of its length that grows with the square root of the table, thinned so that no two are close as long as
DESCRIBED remain. The inverted list of a pivot holds the vectors that have it among their LISTED nearest ones. In a
list, the pivots that two descriptions share are counted; pairs that share SHARED (or all, if fewer exist) are
candidates, and these are verified by cosine in double precision. A pair in several lists is taken in one of them.

Long lists are cut into blocks by hash and blocks meet in pairs, so no task holds a whole list. Blocks return link
counts and a spanning forest instead of pairs: their rows follow the vectors, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.components import components
from meshwork.llm.skew import with_groups
from meshwork.llm.staging import partitions, staged

#: Least and most pivots of a length, the cosine from which two of them count as one.
FEWEST, MOST, APART = 256, 16384, 0.7
#: Pivots of a description, nearest ones whose lists hold the vector, pivots that candidates share.
DESCRIBED, LISTED, SHARED = 12, 5, 3
#: Rows of a block of a list, rows of a block that are compared with another block at once.
BLOCK, TILE = 4096, 1024


def usable(vector: str) -> Column:
    """Not null, with a component that isn't zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pivots(vectors: DataFrame, most: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each vector length the number of its first pivot and its pivots: of a sample of twice the square root of its
    vectors (FEWEST to ``most``) those that are spread out, and others where fewer than DESCRIBED are."""
    sizes = {r["length"]: r["n"] for r in vectors.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).collect()}
    found: dict[int, tuple[int, np.ndarray]] = {}
    begin = 0
    for width, n in sorted(sizes.items()):
        wanted = min(max(FEWEST, 2 * math.isqrt(n)), most)
        rows = vectors.where(F.size("v") == width).select("v", F.xxhash64("id", F.lit(11)).alias("h"), "id").orderBy("h", "id").limit(wanted).select("v").collect()
        chosen: list[np.ndarray] = []
        close: list[np.ndarray] = []
        points = np.empty((len(rows), width))
        for x in _unit(np.array([r["v"] for r in rows], np.float64)):
            if (points[: len(chosen)] @ x < APART).all():
                points[len(chosen)] = x
                chosen.append(x)
            else:
                close.append(x)
        chosen += close[: max(DESCRIBED - len(chosen), 0)]
        found[width] = begin, np.array(chosen)
        begin += len(chosen)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _described(vectors: DataFrame, pivots) -> DataFrame:
    """(id, weight, v, p): p are the nearest pivots of the vector's length, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                first, points = pivots.value[width]
                m = min(DESCRIBED, len(points))
                some = batch.filter(pa.array(lengths == width))
                x = _unit(some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
                near = first + np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :m].astype(np.int32)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(offsets, pa.array(near.ravel().astype(np.int32)))], names=["id", "weight", "v", "p"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, weight long, v array<{_element(vectors)}>, p array<int>")


def _element(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.elementType.simpleString()


def _candidates(p: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether rows ``one`` and ``two`` share enough pivots: counted for all pairs as a product of incidence matrices."""
    _, at, n = np.unique(p[np.concatenate([one, two])], return_inverse=True, return_counts=True)
    places = np.cumsum(n > 1) - 1  # a pivot of one row is shared with none
    at = at.reshape(-1, p.shape[1])
    sides = np.zeros((len(at), int((n > 1).sum()) + 1), np.float32)
    np.put_along_axis(sides, np.where(n[at] > 1, places[at], sides.shape[1] - 1), 1, axis=1)
    sides[:, -1] = 0
    return sides[: len(one)] @ sides[len(one) :].T >= min(SHARED, p.shape[1])


def _meet(ids: np.ndarray, weights: np.ndarray, x: np.ndarray, p: np.ndarray, side: np.ndarray, key: int, least: float, counts: dict, edges: list) -> None:
    """Link the two sides of a block pair (side 2: one block with itself) in the list of pivot ``key``."""
    ones, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    total = np.zeros(len(ids))
    root = np.arange(len(ids))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for tile in range(0, len(ones), TILE):
        one = ones[tile : tile + TILE]
        a, b = np.nonzero(_candidates(p, one, two))
        a, b = one[a], two[b]
        keep = a < b if (side == 2).all() else a != b
        a, b = a[keep], b[keep]
        for begin in range(0, len(a), 1 << 17):
            i, j = a[begin : begin + (1 << 17)], b[begin : begin + (1 << 17)]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= least
            i, j = i[near], j[near]
            # The least pivot that is listed on both sides has the pair.
            q, r = p[i, :LISTED], p[j, :LISTED]
            own = np.where((q[:, :, None] == r[:, None, :]).any(axis=2), q, np.iinfo(np.int32).max).min(axis=1) == key
            i, j = i[own], j[own]
            total += np.bincount(i, weights[j], minlength=len(ids)) + np.bincount(j, weights[i], minlength=len(ids))
            for m, n in zip(i.tolist(), j.tolist(), strict=True):
                m, n = find(m), find(n)
                if m != n:
                    root[max(m, n)] = min(m, n)
                    edges.append((ids[m], ids[n]))
    for i in np.flatnonzero(total):
        counts[ids[i]] = counts.get(ids[i], 0) + int(total[i])


def _linked(lists: DataFrame, least: float) -> DataFrame:
    """From rows sorted by (k, g1, g2): (id, n) partial counts and (id, other) edges of the forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kind = None

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            # Pivots are numbered by vector length, so rows of a length follow each other.
            lengths = pc.list_value_length(table.column(6)).to_numpy()
            cuts = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
            for begin, end in zip(cuts, cuts[1:]):
                yield from flush_length(table.slice(begin, end - begin))

        def flush_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
            side = table.column(3).to_numpy()
            ids = np.array(table.column(4).to_pylist(), object)
            weights = table.column(5).to_numpy().astype(np.float64)
            v, p = (table.column(i).combine_chunks() for i in (6, 7))
            v, p = ((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in (v, p))
            x = _unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
            p = p.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            counts: dict = {}
            edges: list = []
            for begin, end in zip(cuts, cuts[1:]):
                if end - begin > 1:
                    g = slice(begin, end)
                    _meet(ids[g], weights[g], x[g], p[g], side[g], keys[begin, 0], least, counts, edges)
            out = [(i, n, None) for i, n in counts.items()] + [(i, 0, j) for i, j in edges]
            if out:
                i, n, j = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, kind), pa.array(n, pa.int64()), pa.array(j, kind)], names=["id", "n", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(4).type
            table = pa.Table.from_batches([*held, batch])
            keys = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if not len(changes):
                held = table.to_batches()
                continue
            yield from flush(table.slice(0, changes[-1] + 1))
            held = table.slice(changes[-1] + 1).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    kind = lists.schema["id"].dataType.simpleString()
    return lists.mapInArrow(run, f"id {kind}, n long, other {kind}")


def near_vectors(vectors: DataFrame, least: float = 0.9, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors linked directly), component_id (smallest id reachable by
    links, itself included), kept (the id is its component's).

    Found links have cosine ``least`` or more; equal vectors always link. A pair is missed if no pivot is among the
    LISTED nearest of both or if they share too few; in a table with LISTED pivots or fewer all pairs are compared. Vectors
    that are null, zero, or hold null or non-finite components link with nothing; others link with those of their own
    length, each of which has its own sample, at most ``most`` vectors, in the driver. Rows that share an id and a vector
    are other vectors to each other. A null id has its group's component. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("ok", usable("v"))
    rows = rows.withColumns({h: F.when(F.col("ok"), F.xxhash64(F.lit(seed), "v")) for h, seed in (("h1", 1), ("h2", 2))})
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min_by("v", F.struct("id")).alias("v"))
    classes = staged(classes, "pivot-classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("id"), "weight", "v")
    pivots = spark.sparkContext.broadcast(_pivots(reps, most))

    lists = _described(reps, pivots).withColumn("k", F.explode(F.slice("p", 1, LISTED)))
    sizes = lists.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)").alias("blocks"))  # a row per pivot
    lists = lists.join(F.broadcast(sizes), "k").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1)
    lists = lists.select("k", F.least("block", "with").alias("g1"), F.greatest("block", "with").alias("g2"), side.alias("side"), "id", "weight", "v", "p")
    # A block meets itself in its own group; in a group of two blocks each row is on its side.
    lists = lists.repartition(partitions(spark), "k", "g1", "g2").sortWithinPartitions("k", "g1", "g2")
    linked = staged(_linked(lists, least), "pivot-links")

    counts = linked.where("other is null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(linked.where("other is not null"), "id", "other").withColumnRenamed("node", "rep")
    found = classes.select("h1", "h2", "rep", "weight").join(counts, "rep", "left").join(groups, "rep", "left")
    found = staged(found.select("h1", "h2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")), "pivot-groups")
    total = found.agg(F.sum("weight")).first()[0] or 0
    component = F.coalesce("group", "id")
    return with_groups(rows.select("id", "h1", "h2"), found, ["h1", "h2"], "weight", total).select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
