"""Ordered analytics: concentration curves, quantile bins, prefix rules, ranks, look-ups.

Running sums over a whole table go through ``running``: ranges of the order are summed apart and placed by the totals
before them, so no task holds the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.sources.sinks import checkpointed, partitions


def running(frame: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """``frame`` with nth (from 1), upto (running sum of ``value``), rows and total, in the given order.

    Rows are range-partitioned by the whole order, as many ranges as the session has partitions, and written once; each
    range is summed in its own window. A name in the order is a column of ``frame``, which is not written a second time.
    """
    made = {f"_o{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    keys = [c if isinstance(c, str) else f"_o{i}" for i, c in enumerate(order)]
    ranged = frame.withColumns(made).repartitionByRange(partitions(frame.sparkSession), *keys).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged, "ranges")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    every = Window.partitionBy()
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_n").over(every).alias("rows"), F.sum("_s").over(every).alias("total"))
    inside = Window.partitionBy("_range").orderBy(*keys)
    placed = ranged.withColumns({"_i": F.row_number().over(inside), "_u": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(F.broadcast(starts), "_range").withColumns({"nth": F.col("_n0") + F.col("_i"), "upto": F.col("_s0") + F.col("_u")})
    return placed.drop("_range", "_i", "_u", "_n0", "_s0", *made)


def _ranged(frame: DataFrame, value: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Counts m of the distinct values of each group in ranges of the whole order, and (*by, _range, _before, n): how many
    rows of the group are in the ranges before, and in all. Null values are left out."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    ranged = checkpointed(counts.repartitionByRange(partitions(frame.sparkSession), *by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_range").agg(F.sum("m").alias("_s"))
    group = Window.partitionBy(*by)  # a row per range and group in it
    before = F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, totals.select(*by, "_range", before.alias("_before"), F.col("_s"), F.sum("_s").over(group).alias("n"))


def _met(ranged: DataFrame, starts: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(*by, value, m, upto, n) of the ranges in ``starts``; ``upto`` counts the rows of the group up to the value."""
    there = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_there"), "_before", "n")
    on = [F.col("_range") == F.col("_there"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(there, on).select(*by, value, "m", (F.col("_before") + F.sum("m").over(inside)).alias("upto"), "n")


def cumulative(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, value, m, upto, n): for each distinct value of a group its rows, the group's rows up to it, and all of them.

    A group may hold any part of the rows: its values are dealt to ranges, and equal values are one row before that.
    """
    ranged, starts = _ranged(frame, value, by)
    return _met(ranged, starts, value, by)


def quantiles(frame: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """(*by, one column a fraction): exact quantiles by linear interpolation, null values left out.

    Wanted places are looked up in the counts by range, and only the ranges that hold one are sorted. Without ``by``
    there is one row, of nulls where there is no value.
    """
    ranged, starts = _ranged(frame, value, by)
    places = {name: q * (F.col("n") - 1) for name, q in fractions.items()}
    wanted = F.array(*[f(at).cast("long") for at in places.values() for f in (F.floor, F.ceil)])
    holds = F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s")))
    met = _met(ranged, checkpointed(starts.where(holds), "wanted"), value, by)
    at = lambda r: F.max(F.when((r >= F.col("upto") - F.col("m")) & (r < F.col("upto")), F.col(value)))
    ends = [c for i, p in enumerate(places.values()) for c in (at(F.floor(p)).alias(f"_low{i}"), at(F.ceil(p)).alias(f"_high{i}"), F.max(p - F.floor(p)).alias(f"_part{i}"))]
    found = met.groupBy(*by).agg(*ends)  # two rows a fraction and group
    between = lambda i: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
    return found.select(*by, *[between(i).cast("double").alias(name) for i, name in enumerate(fractions)])


def selected_quantiles(frame: DataFrame, value: str, fractions: dict[str, float], *by: str, cells: int = 4096) -> DataFrame:
    """As ``quantiles``, for rows of a table, few groups and very many different values: ``frame`` is read three times, and only
    rows in cells that hold a wanted place are shuffled.

    Cells have equal widths from the least to the greatest value of a group; where that is no width (infinite values, NaN), the group
    is one cell. Tables with a row per group, and per group and wanted place, are broadcast.
    """
    some = frame.where(F.col(value).isNotNull())
    named = lambda t: t.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    spans = checkpointed(some.groupBy(*by).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high")), "spans")
    width, v = F.col("_high") - F.col("_low"), F.col(value).cast("double")
    cell = F.when((width > 0) & (width < F.lit(float("inf"))), F.floor((v - F.col("_low")) / width * cells)).otherwise(0).cast("long")
    placed = some.join(F.broadcast(named(spans)), same or None).select(*by, value, cell.alias("_cell"))
    counts = placed.groupBy(*by, "_cell").agg(F.count("*").alias("_m"))
    group = Window.partitionBy(*by)  # a row per cell
    before = F.coalesce(F.sum("_m").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_cell", "_m", before.alias("_before"), F.sum("_m").over(group).alias("_n"))
    places = {name: q * (F.col("_n") - 1) for name, q in fractions.items()}
    wanted = F.array(*[f(at).cast("long") for at in places.values() for f in (F.floor, F.ceil)])
    holding = checkpointed(counts.where(F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))), "cells")
    meet = lambda rows: rows.join(F.broadcast(named(holding).withColumnRenamed("_cell", "_of_cell")), [*same, F.col("_cell") == F.col("_of_cell")])
    ran = meet(cumulative(meet(placed).select(*by, "_cell", value), value, *by, "_cell"))
    upto = F.col("_before") + F.col("upto")
    at = lambda r: F.max(F.when((r >= upto - F.col("m")) & (r < upto), F.col(value)))
    ends = [c for i, p in enumerate(places.values()) for c in (at(F.floor(p)).alias(f"_low{i}"), at(F.ceil(p)).alias(f"_high{i}"), F.max(p - F.floor(p)).alias(f"_part{i}"))]
    between = lambda i: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
    return ran.groupBy(*by).agg(*ends).select(*by, *[between(i).cast("double").alias(name) for i, name in enumerate(fractions)])


def with_quantiles(sums: DataFrame, frame: DataFrame, value: str, fractions: dict[str, float], *by: str, made: Callable[..., DataFrame] = quantiles) -> DataFrame:
    """``sums``, which has a row per group ``by``, beside the quantiles of ``value`` in ``frame``, ``made`` by one of the two above."""
    q = made(frame, value, fractions, *by)
    if not by:
        return sums.join(q)
    q = q.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return sums.join(q, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], "left").drop(*[f"_by_{c}" for c in by])


def with_micro(edges: DataFrame) -> DataFrame:
    """Lengths in whole millionths as ``micro``."""
    return edges.withColumn("micro", F.round(F.col("length") * 1_000_000).cast("long"))


def longest_first(edges: DataFrame) -> DataFrame:
    """src, dst, micro in the order of falling length, as ``running``."""
    return running(with_micro(edges).select("src", "dst", "micro"), "micro", -F.col("micro"), "src", "dst")


def lorenz(edges: DataFrame, points: int = 400) -> DataFrame:
    """Cumulative share of length, shortest first, at about ``points`` even places."""
    ran = running(with_micro(edges).select("src", "dst", "micro"), "micro", "micro", "src", "dst")
    step = F.greatest(F.lit(1), F.floor(F.col("rows") / points))
    return ran.where(((F.col("nth") - 1) % step == 0) | (F.col("nth") == F.col("rows"))).select("nth", (F.col("nth") / F.col("rows")).alias("edge_share"), (F.col("upto") / F.col("total")).alias("wire_share"))


def gini(edges: DataFrame) -> DataFrame:
    """1 - (2 / n) (sum C - (C_1 + C_n) / 2) over cumulative ascending shares C; there is no leading (0, 0)."""
    ran = running(with_micro(edges).select("src", "dst", "micro"), "micro", "micro", "src", "dst")
    sums = ran.agg(F.sum(F.col("upto").cast("decimal(38,0)")).cast("double").alias("s"), F.min("upto").alias("c1"), F.max("total").alias("t"), F.max("rows").alias("n"))
    return sums.select("n", (1 - 2 / F.col("n") * (F.col("s") / F.col("t") - (F.col("c1") / F.col("t") + 1) / 2)).alias("gini"))


def top_shares(edges: DataFrame, shares: list[float]) -> DataFrame:
    """Share of the wire in the longest share of edges, read at place max(0, int(share n) - 1)."""
    ran = longest_first(edges).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    at = F.greatest(F.lit(1), F.floor(F.col("share") * F.col("rows")))
    return ran.where(F.col("nth") == at).select("share", "nth", (F.col("upto") / F.col("total")).alias("wire_share"))


def quantile_bins(frame: DataFrame, value: str, bins: int) -> DataFrame:
    """``frame`` with ``bin``: e_b <= value < e_b+1 for the linear quantile edges e, the last closed; equal values share a bin."""
    edges = quantiles(frame, value, {f"_e{k}": k / bins for k in range(1, bins)})
    at = sum((F.when(F.col(f"_e{k}") <= F.col(value), 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    return frame.join(F.broadcast(edges)).withColumn("bin", at).drop(*[f"_e{k}" for k in range(1, bins)])  # one row


def decile_table(edges: DataFrame, bins: int = 10) -> DataFrame:
    """Per length decile: edges, range, wire, weight, weight per wire, and that relative to the whole."""
    binned = checkpointed(with_micro(quantile_bins(edges, "length", bins)).select("bin", "length", "micro", "weight"), "binned")
    per = binned.groupBy("bin").agg(F.count("*").alias("edges"), F.min("length").alias("shortest"), F.max("length").alias("longest"), (F.sum("micro") / 1_000_000).alias("wire"), F.sum("weight").alias("weight"))
    per = with_quantiles(per, binned, "weight", {"median_weight": 0.5}, "bin")
    whole = per.agg((F.sum("weight") / F.sum("wire")).alias("expected"))
    density = F.col("weight") / F.col("wire")
    return per.join(F.broadcast(whole)).select("bin", "edges", "shortest", "longest", "wire", "weight", "median_weight", density.alias("density"), (density / F.col("expected")).alias("ratio"))


def binned_medians(frame: DataFrame, value: str, other: str, bins: int = 10) -> DataFrame:
    kept = frame.where(F.col(value).isNotNull() & F.col(other).isNotNull())
    binned = checkpointed(quantile_bins(kept, value, bins).select("bin", F.col(value).alias("value"), F.col(other).alias("other")), "binned")
    per = with_quantiles(binned.groupBy("bin").agg(F.count("*").alias("n")), binned, "value", {"median_value": 0.5}, "bin")
    return with_quantiles(per, binned, "other", {"median_other": 0.5}, "bin")


def take_until(ran: DataFrame, target: str) -> DataFrame:
    """Rows of ``running`` while the sum is at most the target, and one more if it brings the sum strictly closer.

    ``target`` is an expression in the same units; ties of distance keep the shorter prefix.
    """
    t = F.expr(target)
    own = F.coalesce(F.col("upto") - F.col("micro"), F.lit(0))
    return ran.where((F.col("upto") <= t) | ((own <= t) & (F.col("upto") > t) & (F.abs(F.col("upto") - t) < F.abs(t - own))))


def cut_counts(ran: DataFrame, shares: list[float]) -> DataFrame:
    """Fewest leading rows that reach each share of the total; 0 for 0, all at most."""
    s = ran.withColumn("share", F.explode(F.array(*[F.lit(x) for x in shares])))
    return s.groupBy("share").agg(F.when(F.col("share") <= 0, 0).otherwise(F.coalesce(F.min(F.when(F.col("upto") >= F.col("share") * F.col("total"), F.col("nth"))), F.max("rows"))).alias("cut"))


def level_crossing(curve: DataFrame, level: float) -> DataFrame:
    """Where a curve (name, wire_removed, value) first falls through a level, by linear interpolation; no crossing gives no row."""
    w = Window.partitionBy("name").orderBy("wire_removed")
    pairs = curve.withColumns({"next_wire": F.lead("wire_removed").over(w), "next_value": F.lead("value").over(w)})
    hit = pairs.where((F.col("next_value") <= level) & (F.col("value") >= level))
    x = F.when(F.col("value") == F.col("next_value"), F.col("wire_removed")).otherwise(F.col("wire_removed") + (F.col("value") - level) / (F.col("value") - F.col("next_value")) * (F.col("next_wire") - F.col("wire_removed")))
    return hit.withColumn("x", x).groupBy("name").agg(F.min_by("x", "wire_removed").alias("wire_at_level"))


def baseline_share(curve: DataFrame) -> DataFrame:
    """Each value relative to its curve's first."""
    w = Window.partitionBy("name").orderBy("wire_removed")
    return curve.withColumn("share", F.col("value") / F.first("value").over(w))


def pooled(curves: DataFrame) -> DataFrame:
    """Pointwise mean and sample deviation over repeats."""
    return curves.groupBy("name", "wire_removed").agg(F.count("*").alias("repeats"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def rank_among(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Rank (number greater, plus 1) and share of peers that are less, from the counts of distinct values; rows with a null
    value have none."""
    ran = cumulative(frame, value, *by).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_value"), "m", "upto", "n")
    on = [F.col(value) == F.col("_value"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    share = F.coalesce((F.col("upto") - F.col("m")) / F.nullif(F.col("n") - 1, F.lit(0)), F.when(F.col("n") == 1, 0.0))
    return frame.join(ran, on, "left").withColumns({"rank": F.col("n") - F.col("upto") + 1, "share_below": share}).drop("_value", "m", "upto", "n", *[f"_by_{c}" for c in by])


def average_ranks(frame: DataFrame, *values: str) -> DataFrame:
    """``frame`` with rank_<value>: places from 1, ties sharing their mean. Distinct values are ranked, from their counts."""
    for v in values:
        counts = checkpointed(frame.groupBy(v).agg(F.count("*").alias("_m")))
        ran = running(counts, "_m", F.col(v))
        frame = frame.join(ran.select(v, (F.col("upto") - (F.col("_m") - 1) / 2).alias(f"rank_{v}")), v)
    return frame


def suggestions(nodes: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Names that begin with the typed text (shortest, then by name) before names that hold it (by place, length, name)."""
    name, t = F.lower("node"), typed.lower()
    at = F.instr(name, t)
    return nodes.select("node").where(at > 0).withColumns({"place": at, "size": F.length("node")}).orderBy("place", "size", "node").limit(limit).select("node", "place")


def resolved(nodes: DataFrame, asked: str) -> DataFrame:
    """The node with that id, whatever the case and separators, else the first node of that type."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    want = "".join(ch for ch in asked.lower() if ch.isascii() and ch.isalnum())
    hits = nodes.select("node", F.when(plain(F.col("node")) == want, 0).when(plain(F.col("cell_type")) == want, 1).alias("how")).where("how is not null")
    return hits.orderBy("how", "node").limit(1).select("node", "how")


def filtered(table: DataFrame, direction: str | None, text: str, sort: str, descending: bool = True) -> DataFrame:
    """Rows of a direction whose node holds the text, sorted by a column, then by name."""
    kept = table.where(F.lower("node").contains(text.lower()))
    kept = kept if direction is None else kept.where(F.col("role") == direction)
    return kept.orderBy(F.desc(sort) if descending else F.asc(sort), "node")


def nearest_index(frame: DataFrame, value: str, target: float) -> DataFrame:
    """The row nearest to a value; the first of ties."""
    return frame.agg(F.min_by(value, F.struct(F.abs(F.col(value) - target), F.col(value))).alias("nearest"))
