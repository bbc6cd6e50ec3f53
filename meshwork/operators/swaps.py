"""Greedy position swaps: nodes of a group exchange places as long as that shortens the graph's edges.

One swap after another is a chain of steps; here a round proposes disjoint pairs of nodes, takes those that lower the total
length, and of these only such that no edge joins two of them. Then no accepted swap changes what another one was
measured by, so the changes add up, and the running cost is the cost. Lengths are whole millionths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.expressions import distance, draw
from meshwork.sources.sinks import bucketed, checkpointed

#: Nodes of a range in which a round looks for partners.
PAIRED = 4096


def _micro(length: Column) -> Column:
    return F.round(length * 1_000_000).cast("long")


def _proposals(places: DataFrame, group: str, seed: int, turn: int, ranges: int) -> DataFrame:
    """(node, partner, a_x to a_z, to_x to to_z, swap): disjoint pairs of movable nodes of a group, neighbours in a random order that is
    cut into ranges; a swap is named by its smaller node."""
    drawn = places.where("movable").withColumn("u", draw(seed, turn, F.col("node"))).withColumn("bucket", F.floor(F.col("u") * ranges))
    order = Window.partitionBy(group, "bucket").orderBy("u", "node")  # about PAIRED nodes
    numbered = drawn.withColumn("i", F.row_number().over(order) - 1)
    pair = Window.partitionBy(group, "bucket", F.expr("i div 2")).orderBy("i")
    other = lambda c: F.coalesce(F.lead(c).over(pair), F.lag(c).over(pair))
    both = numbered.select("node", other("node").alias("partner"), *[F.col(k).alias(f"a_{k}") for k in "xyz"], *[other(k).alias(f"to_{k}") for k in "xyz"]).where("partner is not null")
    return both.withColumn("swap", F.least("node", "partner"))


def greedy_swaps(edges: DataFrame, nodes: DataFrame, group: str, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(places, trajectory) after ``rounds`` rounds of swaps.

    ``edges`` has src, dst, an edge each; ``nodes`` has node (unique), x, y, z, ``group`` and movable. Edges of nodes without a
    place, and loops, don't count. ``places`` is (node, x, y, z, group, movable); ``trajectory`` has a row a round, and one for
    the beginning: round, proposed, improving, accepted, cost, reduction (share of the first cost). A node with a null group or
    place, or that isn't movable, keeps its place.
    """
    spark = nodes.sparkSession
    places = checkpointed(nodes.select("node", "x", "y", "z", group, (F.coalesce("movable", F.lit(False)) & F.col(group).isNotNull() & F.col("x").isNotNull()).alias("movable")), "places")
    at = lambda frame, name, prefix: frame.select(F.col("node").alias(name), *[F.col(k).alias(f"{prefix}{k}") for k in "xyz"])
    kept = checkpointed(edges.where("src != dst").join(places.where("x is not null").select(F.col("node").alias("src")), "src", "left_semi").join(places.where("x is not null").select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "kept")
    # Only movable nodes change lengths. An end that stays has the same place in all rounds, so it is looked up once; both tables
    # lie in buckets by the end that a round looks up, and rounds shuffle nodes, not edges.
    both = kept.select("src", "dst").unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).toDF("node", "other")
    both = both.join(places.where("movable").select("node"), "node", "left_semi").join(places.select(F.col("node").alias("other"), F.col("movable").alias("moves"), *[F.col(k).alias(f"b_{k}") for k in "xyz"]), "other")
    both = checkpointed(both, "incident")
    still = bucketed(both.where("not moves").select("node", "b_x", "b_y", "b_z"), "node", "still")
    loose = bucketed(both.where("moves").select("node", "other"), "other", "loose")
    placed = lambda p: kept.join(at(p, "src", "a_"), "src").join(at(p, "dst", "b_"), "dst").agg(F.coalesce(F.sum(_micro(distance("a_", "b_"))), F.lit(0)).alias("c")).first()["c"]
    cost = start = placed(places)
    ranges = max(1, -(-places.where("movable").count() // PAIRED))
    steps = [(0, 0, 0, 0, cost)]
    for turn in range(1, rounds + 1):
        moved = checkpointed(_proposals(places, group, seed, turn, ranges), "proposals")
        # Edges of a moved node: its length before and after; an edge between the two partners keeps its length.
        near = still.join(moved, "node").select("swap", *[f"{p}{k}" for p in ("a_", "to_", "b_") for k in "xyz"])
        near = near.unionByName(loose.join(at(places, "other", "b_"), "other").join(moved, "node").where("other != partner").select(*near.columns))
        change = near.groupBy("swap").agg(F.sum(_micro(distance("to_", "b_")) - _micro(distance("a_", "b_"))).alias("change"))
        better = checkpointed(change.where("change < 0").withColumn("u", draw(seed, "rank", turn, F.col("swap"))), "better")
        named = moved.join(better, "swap").select("node", "swap", "u")
        # A swap stays if it comes before all those that an edge joins it with.
        meets = loose.join(named.select(F.col("node").alias("other"), F.col("swap").alias("swap2"), F.col("u").alias("u2")), "other").join(named, "node").where("swap != swap2")
        beaten = meets.where(F.struct("u2", "swap2") < F.struct("u", "swap")).select("swap").distinct()
        taken = checkpointed(better.join(beaten, "swap", "left_anti"), "taken")
        to = moved.join(taken.select("swap"), "swap", "left_semi").select("node", "to_x", "to_y", "to_z")
        places = checkpointed(places.join(to, "node", "left").select("node", *[F.coalesce(f"to_{k}", k).alias(k) for k in "xyz"], group, "movable"), "places")
        row = taken.agg(F.count("*").alias("n"), F.coalesce(F.sum("change"), F.lit(0)).alias("change")).first()
        cost += row["change"]
        steps.append((turn, moved.count() // 2, better.count(), row["n"], cost))
    trajectory = spark.createDataFrame([(*s[:4], s[4] / 1e6, 1 - s[4] / start if start else 0.0) for s in steps], "round int, proposed long, improving long, accepted long, cost double, reduction double")
    return places, trajectory
