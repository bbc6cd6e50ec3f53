"""Hard-negative mining over one-dimensional distance keys.

Vectors of integers get one more component, sqrt(M^2 - |x|^2) with the greatest length M, and queries get 0: then a
higher inner product is a smaller distance. Each vector goes to its nearest pivot and is stored by (pivot, distance to
it), in pages of PAGE vectors; the pivots are PIVOTS sampled vectors of a length. A vector at distance d of a query has
a key within d of the query's own distance to that pivot. So a search scans the pages whose key intervals lie within a
radius that grows from round to round, and ends when the radius reaches the distance of its worst result: no page
further off can hold a better one. Results are exact.

Queries travel in blocks of BLOCK. A page is in one task once for each SHARE blocks that it meets, and blocks stream past it,
so memory is that of a page and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.packing import packed, unpacked
from meshwork.llm.staging import partitions, staged

PIVOTS, PAGE, BLOCK, SHARE = 64, 4096, 256, 256
#: Radii of the rounds as parts of M; no key is more than 2 M from another.
RADII = (0.0, 0.25, 2.1)
#: Squared lengths from here on would not fit a long as a score.
LONGEST = 4e18


def quantized(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = 256) -> DataFrame:
    """(key, id, label, q, norm): rows that take part, once each, with whole components floor(scale * x).

    Rows with a null id, label, vector or component, with a component that isn't finite, or with a squared length of
    LONGEST or more take no part. ``label`` becomes a 64-bit hash. Rows alike in id, label and vector are one; ``key``
    tells others apart that share an id.
    """
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("l"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and l is not null and x is not null").where(fine)
    rows = rows.withColumn("x", F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("double")))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    rows = rows.withColumn("norm", norm).where(F.col("norm") < LONGEST)
    rows = rows.select("id", F.xxhash64("l").alias("label"), F.transform(x, lambda v: v.cast("long")).alias("q"), "norm")
    return rows.withColumn("key", F.xxhash64("id", "label", "q")).dropDuplicates(["id", "label", "key"]).select("key", "id", "label", "q", "norm")


class _Space:
    """Pivots and greatest length of the vectors of one number of components; ``first`` numbers its pivots."""

    def __init__(self, first: int, points: np.ndarray, square: float):
        self.first, self.points, self.square = first, points, square
        self.extra = np.sqrt(np.maximum(square - (points**2).sum(axis=1), 0))

    def distances(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """From each row to each pivot; stored vectors have their last component, queries have 0 there."""
        norms = (x**2).sum(axis=1)
        dots = x @ self.points.T
        if stored:
            return np.sqrt(np.maximum(2 * self.square - 2 * (dots + np.sqrt(np.maximum(self.square - norms, 0))[:, None] * self.extra), 0))
        return np.sqrt(np.maximum(norms[:, None] + self.square - 2 * dots, 0))


def _spaces(rows: DataFrame) -> dict[int, _Space]:
    found: dict[int, _Space] = {}
    begin = 0
    for r in rows.groupBy(F.size("q").alias("width")).agg(F.max("norm").alias("m")).orderBy("width").collect():  # a row per length
        points = rows.where(F.size("q") == r["width"]).select("q", F.xxhash64("key", F.lit(7)).alias("h"), "key").orderBy("h", "key").limit(PIVOTS).collect()
        found[r["width"]] = _Space(begin, np.array([p["q"] for p in points], np.float64).reshape(len(points), r["width"]), r["m"])
        begin += len(points)
    return found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _keyed(rows: DataFrame, spaces, stored: bool) -> DataFrame:
    """``rows`` with pivot (the nearest), dist to it and, for queries, dists to all pivots of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                space, some = spaces.value[width], batch.filter(pa.array(lengths == width))
                d = space.distances(_matrix(some.column("q"), width).astype(np.float64), stored)
                near = d.argmin(axis=1)
                added = [pa.array((space.first + near).astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                names = ["pivot", "dist"]
                if not stored:
                    added.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel())))
                    names.append("dists")
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*some.schema.names, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + ", pivot int, dist double" + ("" if stored else ", dists array<double>"))


def _runs(batches: Iterator[pa.RecordBatch], group: str, most: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``group``, at most ``most`` at a time."""
    held: list[pa.RecordBatch] = []
    rows, kind = 0, None
    for batch in batches:
        kinds = batch.column(group).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        for begin, end in zip(cuts, cuts[1:]):
            while begin < end:
                if held and (kinds[begin] != kind or rows == most):
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                kind, take = kinds[begin], min(end - begin, most - rows)
                held.append(batch.slice(begin, take))
                rows, begin = rows + take, begin + take
    if held:
        yield pa.Table.from_batches(held)


def _pages(rows: DataFrame, spaces) -> DataFrame:
    """(page, pivot, low, high, body): stored vectors in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "pivot", PAGE):
            ids, keys, labels, dist = (t.column(c).to_numpy() for c in ("id", "key", "label", "dist"))
            q = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            body = packed(ids, keys, labels, q.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), t.column("pivot").slice(0, 1).combine_chunks(), pa.array([dist[0]]), pa.array([dist[-1]]), pa.array([body])], names=["page", "pivot", "low", "high", "body"])

    ordered = _keyed(rows, spaces, True).repartitionByRange(partitions(rows.sparkSession), "pivot", "dist", "key").sortWithinPartitions("pivot", "dist", "key")
    return staged(ordered.mapInArrow(run, "page long, pivot int, low double, high double, body binary"), "key-pages")


def _blocks(open_: DataFrame) -> DataFrame:
    """(block, first, near, far, reach, body): queries that are near each other; near and far bound their distances to
    each pivot, ``reach`` their radii. ``body`` has keys, labels, radii, distances, vectors and limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "width", BLOCK):
            keys, labels, radius = (t.column(c).to_numpy() for c in ("key", "label", "radius"))
            dists = _matrix(t.column("dists").combine_chunks(), len(t.column("dists")[0]))
            lists = t.column("limits").combine_chunks()
            of = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))
            each = [lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            q = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            body = packed(keys, labels, radius, dists.ravel(), q, of.astype(np.int64), *each)
            as_list = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(keys[0])]), t.column("first").slice(0, 1).combine_chunks(), as_list(dists.min(axis=0)), as_list(dists.max(axis=0)), pa.array([float(radius.max())]), pa.array([body])],
                names=["block", "first", "near", "far", "reach", "body"],
            )

    columns = ["width", "first", "key", "label", "q", "dists", "radius", "limits"]
    ordered = open_.repartitionByRange(partitions(open_.sparkSession), "width", "pivot", "dist", "key").sortWithinPartitions("width", "pivot", "dist", "key").select(*columns)
    return staged(ordered.mapInArrow(run, "block long, first int, near array<double>, far array<double>, reach double, body binary"), "key-blocks")


def _best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k fitting columns of each row: higher scores, then smaller ids and keys."""
    low = np.iinfo(np.int64).min
    masked = np.where(fits, scores, low)
    if masked.shape[1] > k:
        least = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        fits = fits & (masked >= least[:, None])
    a, b = np.nonzero(fits)
    order = np.lexsort((keys[b], ids[b], -scores[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k]


def _scan(units: DataFrame, spaces, before: float, same: bool, k: int) -> DataFrame:
    """(key, t, score, id, other): for each search t of a query the best k rows of each page that is new in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("kind", "pivot", "low", "high", "body")}
                arrays = unpacked(row["body"])
                if row["kind"].as_py() == 0:
                    ids, keys, labels, q = arrays
                    page = ids, keys, labels, q.reshape(len(ids), -1)
                    pivot, low, high = (row[c].as_py() for c in ("pivot", "low", "high"))
                    space = next(s for s in spaces.value.values() if s.first <= pivot < s.first + len(s.points))
                    continue
                ids, keys, labels, x = page
                own, kinds, radius, dists, q, of, t, least, most = arrays
                d = dists.reshape(len(own), -1)[:, pivot - space.first]
                gap = np.maximum(np.maximum(d - high, low - d), 0)
                new = (gap > before) & (gap <= radius)
                if not new.any():
                    continue
                q = q.reshape(len(own), -1)
                exact = np.float64 if space.square < 2.0**52 else np.int64
                scores = (q.astype(exact) @ x.astype(exact).T).astype(np.int64)
                fits = new[:, None] & ((kinds[:, None] == labels) == same) & (own[:, None] != keys)
                for slot in np.unique(t):
                    at = np.flatnonzero(t == slot)
                    rows = of[at]
                    s = scores[rows]
                    a, b = _best(s, fits[rows] & (s >= least[at][:, None]) & (s <= most[at][:, None]), ids, keys, k)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(own[rows[a]]), pa.array(np.full(len(a), slot, np.int64)), pa.array(s[a, b]), pa.array(ids[b]), pa.array(keys[b])], names=["key", "t", "score", "id", "other"])

    return units.mapInArrow(run, "key long, t long, score long, id long, other long")


def _search(pages: DataFrame, queries: DataFrame, spaces, same: bool, k: int) -> DataFrame:
    """(key, t, found): for each search (key, t) the first k rows of ``pages`` whose label is the query's (``same``) or isn't,
    and whose score is from ``low`` to ``high``; ``found`` lists (down, id, other) with ``down`` = -score, in order.

    ``queries`` has key, label, q, norm, pivot, dist, dists, width, first, square and the searches ``limits`` (t, low, high).
    """
    schema = "key long, t long, found array<struct<down:bigint,id:bigint,other:bigint>>"
    found = queries.sparkSession.createDataFrame([], schema)
    meta = pages.select("page", "pivot", "low", "high")
    before = -1.0
    greatest = max((s.square for s in spaces.value.values()), default=0.0) ** 0.5
    for part in RADII:
        radius = part * greatest
        # A search that has its k rows needs none below the worst of them, and no page beyond its distance.
        state = found.select("key", "t", F.when(F.size("found") >= k, -F.element_at("found", -1)["down"]).alias("worst"))
        each = queries.select("key", "norm", "square", F.explode("limits").alias("s")).select("key", "norm", "square", "s.*").join(state, ["key", "t"], "left")
        each = each.withColumn("low", F.greatest("low", F.coalesce("worst", "low")))
        reach = F.sqrt(F.greatest(F.col("norm") + F.col("square") - 2.0 * F.col("low").cast("double"), F.lit(0.0))) + F.sqrt("square") * 1e-6
        each = each.withColumn("reach", reach).where(F.col("reach") > before)
        searches = each.groupBy("key").agg(F.collect_list(F.struct("t", "low", "high")).alias("limits"), F.max("reach").alias("reach"))  # at most k searches a query
        open_ = queries.drop("limits").join(searches, "key").withColumn("radius", F.least(F.lit(radius), F.col("reach")))
        blocks = _blocks(open_)
        if not (n := blocks.count()):
            break
        sides = blocks.select("block", "first", "reach", F.posexplode(F.arrays_zip("near", "far")).alias("i", "d")).select("block", (F.col("first") + F.col("i")).alias("pivot"), "reach", "d.near", "d.far")
        gap = lambda d: f"greatest({d} - high, low - {d}, 0)"
        met = sides.join(meta, "pivot").where(f"greatest(near - high, low - far, 0) <= reach and greatest({gap('near')}, {gap('far')}) > {before}")
        share = F.pmod(F.xxhash64("block"), F.lit(n // SHARE + 1)).cast("int").alias("share")
        pairs = staged(met.select("page", "pivot", "low", "high", "block", share), "key-pairs")
        one = pairs.select("page", "pivot", "low", "high", "share").distinct().join(pages.select("page", "body"), "page").select("page", "share", F.lit(0).alias("kind"), "pivot", "low", "high", "body")
        two = pairs.join(blocks.select("block", "body"), "block").select("page", "share", F.lit(1).alias("kind"), "pivot", "low", "high", "body")
        units = one.unionByName(two).repartition(partitions(queries.sparkSession), "page", "share").sortWithinPartitions("page", "share", "kind")
        rows = _scan(units, spaces, before, same, k).select("key", "t", F.struct((-F.col("score")).alias("down"), "id", "other").alias("row"))
        rows = rows.unionByName(found.select("key", "t", F.explode("found").alias("row")))
        found = staged(rows.groupBy("key", "t").agg(F.slice(F.sort_array(F.collect_list("row")), 1, k).alias("found")), "key-found")  # k of each page met
        before = radius
    return found


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``quantized``.

    A row's score is its inner product with the anchor; higher scores come first, then smaller ids. An anchor's positives
    are its first ``positives`` other rows of its label (all, if fewer); each has the first ``negatives`` rows of another
    label (all, if fewer) with ``num`` * positive_score <= ``den`` * negative_score <= ``den`` * positive_score, ranked from 1.
    Rows with vectors of other lengths are neither. A positive without such rows, and one of a score below 0, gives no
    row. Ties are settled by id, then by key. No anchors or an empty table: no rows.
    """
    spark = rows.sparkSession
    rows = staged(rows, "key-rows")
    spaces = spark.sparkContext.broadcast(_spaces(rows))
    pages = _pages(rows, spaces)
    sizes = spark.createDataFrame([(w, s.first, float(s.square)) for w, s in spaces.value.items()], "width int, first int, square double")  # a row per length
    lone = F.array(F.struct(F.lit(0).cast("long").alias("t"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    queries = _keyed(rows.where(anchors), spaces, False).withColumn("width", F.size("q")).join(F.broadcast(sizes), "width").withColumn("limits", lone)
    queries = staged(queries, "key-queries")
    near = _search(pages, queries, spaces, True, positives).select("key", F.posexplode("found").alias("t", "p")).select("key", F.col("t").cast("long").alias("t"), (-F.col("p.down")).alias("score"), F.col("p.id").alias("positive_id"))
    near = staged(near.where("score >= 0"), "key-positives")
    limits = near.groupBy("key").agg(F.collect_list(F.struct("t", F.ceil(F.col("score").cast("decimal(38,0)") * num / den).cast("long").alias("low"), F.col("score").alias("high"))).alias("limits"))
    found = _search(pages, queries.drop("limits").join(limits, "key"), spaces, False, negatives)
    out = found.select("key", "t", F.posexplode("found").alias("place", "n")).join(near, ["key", "t"]).join(queries.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("n.down")).alias("negative_score"))


#: DuckDB SQL for anchors of every hundredth id, with the labels of every seventh id moved on by one.
ORACLE = """
with r as (select distinct vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id aid, a.l = b.l same, b.id, list_inner_product(a.q, b.q)::bigint s from r a join r b on a.id <> b.id and len(a.q) = len(b.q) where a.id % 100 = 0),
p as (select aid, id pid, s ps from s where same qualify row_number() over (partition by aid order by s desc, id) <= 5),
n as (select p.aid, pid, ps, s.id nid, s.s ns, row_number() over (partition by p.aid, pid order by s.s desc, s.id) k from p join s on s.aid = p.aid and not same and 80 * ps <= 100 * s.s and 100 * s.s <= 100 * ps)
select aid anchor_id, pid positive_id, k::int "rank", nid negative_id, ps positive_score, ns negative_score from n where k <= 5"""
