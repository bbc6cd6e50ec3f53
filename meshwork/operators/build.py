"""Building a graph: labels, aggregation, positions, compartments, majority classes and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregate_edges(connections: DataFrame) -> DataFrame:
    """Sum of weights and number of connections of each (src, dst)."""
    return connections.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_connections"))


def combine_edges(*partials: DataFrame) -> DataFrame:
    """Merge of partial aggregates."""
    every = partials[0]
    for other in partials[1:]:
        every = every.unionByName(other)
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n_connections").alias("n_connections"))


def edges_with_totals(edges: DataFrame, fraction: float) -> DataFrame:
    """Edges that carry at least ``fraction`` of ``total``, their target's input. Loops and weak edges count in it, then go."""
    total = F.sum("weight").over(Window.partitionBy("dst"))  # not a join, which would make the edges twice
    shared = edges.where("dst is not null").withColumn("total", total)
    return shared.where((F.col("src") != F.col("dst")) & (F.col("weight") / F.col("total") >= fraction))


def build_graph(edges: DataFrame, fraction: float) -> DataFrame:
    """``edges_with_totals`` with the share of the target's input in place of the total."""
    return edges_with_totals(edges, fraction).select(*edges.columns, (F.col("weight") / F.col("total")).alias("input_fraction"))


def threshold_sweep(edges: DataFrame, fractions: list[float]) -> DataFrame:
    """Edges and weight left at each threshold, in one pass."""
    kept = build_graph(edges, 0.0)
    return (
        kept.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
        .where("input_fraction >= fraction")
        .groupBy("fraction")
        .agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    )


def majority_superclass(rows: DataFrame, by: str = "cell_type") -> DataFrame:
    """The commonest superclass of each group (ties: first by name; null is 'unannotated') with its share."""
    counts = rows.withColumn("superclass", F.coalesce("superclass", F.lit("unannotated"))).groupBy(by, "superclass").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "superclass")))
    ranked = ranked.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return ranked.where("nth = 1").select(by, "superclass", F.col("n").alias("members"), "share")


def node_positions(bodies: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Position of each node: the mean of its bodies' positions if at least ``least_share`` have one, else the
    weighted mean of their second positions (column weight); with the mean distance to the mean as spread."""
    has = F.col("x").isNotNull()
    mean = bodies.groupBy(F.col("node").alias("_node")).agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    away = bodies.join(mean, F.col("node") == F.col("_node"))
    away = away.withColumn("off", F.sqrt(sum(((F.col(k) - F.col(f"m{k}")) * (F.col(k) - F.col(f"m{k}")) for k in "xyz"), F.lit(0.0))))
    sums = away.groupBy("node").agg(
        F.count("*").alias("n_bodies"), F.count_if(has).alias("n_placed"), F.avg("off").alias("spread"), *[F.avg(k).alias(k) for k in "xyz"],
        *[(F.sum(F.col(f"{k}2") * F.col("weight")) / F.sum("weight")).alias(f"{k}2") for k in "xyz"],
    )
    own = F.col("n_placed") / F.col("n_bodies") >= least_share
    return sums.select(
        "node", "n_bodies", "n_placed", F.when(own, "body").otherwise("weighted").alias("position_source"), F.when(own, F.col("spread")).alias("spread"),
        *[F.when(own, F.col(k)).otherwise(F.col(f"{k}2")).alias(k) for k in "xyz"],
    )


def node_compartments(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Majority compartment of every node from (node, compartment, n): a half each or nothing is null."""
    wide = counts.where(F.col("compartment").isin("brain", "vnc")).groupBy("node").pivot("compartment", ["brain", "vnc"]).sum("n")
    every = nodes.select("node").distinct().join(wide, "node", "left").fillna(0, ["brain", "vnc"])
    share = F.col("brain") / F.nullif(F.col("brain") + F.col("vnc"), F.lit(0))
    return every.select("node", "brain", "vnc", share.alias("brain_share"), F.when(share > 0.5, "brain").when(share < 0.5, "vnc").alias("compartment"))


def summarize_nodes(bodies: DataFrame) -> DataFrame:
    """The node table: identity, majority class and role, position and compartment, one row per node."""
    classes = majority_superclass(bodies, "node").select("node", "superclass")
    role = bodies.groupBy("node").agg(F.min("cell_type").alias("cell_type"), F.min("side").alias("side"), F.max_by("role", F.struct(F.when(F.col("role") == "none", 0).otherwise(1), "role")).alias("role"))
    counts = bodies.groupBy("node", "compartment").agg(F.sum("weight").alias("n"))
    return role.join(classes, "node").join(node_positions(bodies), "node").join(node_compartments(counts, bodies).select("node", "brain_share", "compartment"), "node")


def connective_sets(bodies: DataFrame) -> DataFrame:
    """Sorted distinct types of each role but 'none'."""
    return bodies.where("role != 'none'").groupBy("role").agg(F.sort_array(F.collect_set("cell_type")).alias("types"))


def coverage(bodies: DataFrame) -> DataFrame:
    """By superclass: bodies, those with a position, types, and types with a placed body."""
    placed = F.col("x").isNotNull()
    return bodies.groupBy("superclass").agg(
        F.count("*").alias("bodies"), F.count_if(placed).alias("placed"), F.countDistinct("cell_type").alias("types"), F.countDistinct(F.when(placed, F.col("cell_type"))).alias("placed_types")
    )


def unlabelled(connections: DataFrame, labels: DataFrame) -> DataFrame:
    """Endpoints without a label, as one count per end; a complete graph has none."""
    found = connections.join(labels.select(F.col("body").alias("pre"), F.lit(1).alias("a")), "pre", "left").join(labels.select(F.col("body").alias("post"), F.lit(1).alias("b")), "post", "left")
    return found.agg(F.count_if(F.col("a").isNull()).alias("unlabelled_pre"), F.count_if(F.col("b").isNull()).alias("unlabelled_post"), F.count("*").alias("connections"))


def extent(points: DataFrame) -> DataFrame:
    """Span of each axis and whether it is plausible (100 to 2000, the longest at least 700)."""
    spans = points.agg(*[(F.max(k) - F.min(k)).alias(f"span_{k}") for k in "xyz"])
    inside = sum((F.when(F.col(f"span_{k}").between(100, 2000), 1).otherwise(0) for k in "xyz"), F.lit(0)) == 3
    return spans.withColumn("plausible", inside & (F.greatest("span_x", "span_y", "span_z") >= 700))


def checked(frame: DataFrame, condition, message: str) -> DataFrame:
    """``frame``, which fails when it is read if a row breaks the condition."""
    return frame.where(F.coalesce(condition, F.lit(False)) | F.raise_error(F.lit(message)).isNotNull())


def joined_once(sample: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """``sample`` left-joined with measurements, at most one a key on either side: a second one stops the query."""
    fine = F.col("times") == 1
    once = lambda frame: checked(frame.groupBy(key).agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in frame.columns if c != key]), fine, f"{key} is not unique").drop("times")
    return once(sample).join(once(measured), key, "left")
