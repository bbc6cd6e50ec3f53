"""Communities of weighted undirected graphs by levels of local moves and contraction, for many seeds at once.

A seed is a column of every table, so all seeds share the rounds. In a round a random half of the nodes go to the neighbouring
community with the greatest gain of modularity; when a level has settled, its communities become the nodes of the next,
smaller graph. A level that doesn't raise a seed's modularity is its last and isn't taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.expressions import draw
from meshwork.sources.sinks import checkpointed

#: Rounds of a level, levels: each halves the nodes at least, or ends.
ROUNDS, LEVELS = 12, 40
#: Gains are compared in units of this share of the graph's wire, so that equal ones are equal.
DECIMALS = 12


def modularity(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """(communities, modularity) of (node, community) on an undirected graph (one, two, wire)."""
    q = _modularity(_both(graph.withColumn("seed", F.lit(0))), parts.withColumn("seed", F.lit(0)))
    return q.select("communities", "modularity")


def _both(graph: DataFrame) -> DataFrame:
    """(seed, node, other, wire): each pair from either end; a loop counts twice, in one row."""
    pairs = graph.where("one != two")
    rows = pairs.select("seed", F.col("one").alias("node"), F.col("two").alias("other"), "wire").unionByName(pairs.select("seed", F.col("two").alias("node"), F.col("one").alias("other"), "wire"))
    return rows.unionByName(graph.where("one = two").select("seed", F.col("one").alias("node"), F.col("two").alias("other"), (2 * F.col("wire")).alias("wire")))


def _modularity(both: DataFrame, parts: DataFrame) -> DataFrame:
    placed = both.join(parts, ["seed", "node"]).join(parts.select("seed", F.col("node").alias("other"), F.col("community").alias("other_community")), ["seed", "other"])
    per = placed.groupBy("seed", "community").agg(F.sum("wire").alias("all"), F.sum(F.when(F.col("community") == F.col("other_community"), F.col("wire")).otherwise(0.0)).alias("inside"))
    whole = both.groupBy("seed").agg(F.sum("wire").alias("m2"))
    return per.join(whole, "seed").groupBy("seed").agg(F.count("*").alias("communities"), F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("all") / F.col("m2"), 2)).alias("modularity"))


def _settled(both: DataFrame, level: int, seed: int) -> DataFrame:
    """(seed, node, community) after local moves from single nodes."""
    strength = checkpointed(both.groupBy("seed", "node").agg(F.sum("wire").alias("k")), "strength")
    total = strength.groupBy("seed").agg(F.sum("k").alias("m2"))
    parts = strength.select("seed", "node", F.col("node").alias("community"))
    steps = both.where("node != other")
    for r in range(ROUNDS):
        size = parts.join(strength, ["seed", "node"]).groupBy("seed", "community").agg(F.sum("k").alias("tot"))
        to = steps.join(parts.select("seed", F.col("node").alias("other"), "community"), ["seed", "other"]).groupBy("seed", "node", "community").agg(F.sum("wire").alias("w"))
        stay = parts.join(to, ["seed", "node", "community"], "left_anti").withColumn("w", F.lit(0.0))
        options = to.unionByName(stay).join(size, ["seed", "community"]).join(strength, ["seed", "node"]).join(parts.withColumnRenamed("community", "own"), ["seed", "node"]).join(total, "seed")
        same = F.col("community") == F.col("own")
        less = F.when(same, F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        gain = F.round((F.col("w") - less * F.col("k") / F.col("m2")) / F.col("m2"), DECIMALS)
        rank = F.struct(gain.alias("gain"), same.alias("same"), draw(seed, "tie", F.col("seed"), F.col("community")).alias("u"), "community")
        best = options.groupBy("seed", "node", "own").agg(F.max(rank).alias("b"))
        goes = (F.col("b.community") != F.col("own")) & (draw(seed, level, r, F.col("seed"), F.col("node")) < 0.5)
        best = checkpointed(best.select("seed", "node", F.when(goes, F.col("b.community")).otherwise(F.col("own")).alias("community"), (F.col("b.community") != F.col("own")).alias("open")), "moves")
        parts = best.select("seed", "node", "community")
        if best.where("open").isEmpty():
            break
    return parts


def partitions_by_seed(graph: DataFrame, seeds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """((seed, node, community), (seed, communities, modularity)) of an undirected graph (one, two, wire) for ``seeds`` seeds.

    Nodes are strings; a community is named by its least node. Pairs that occur several times add up. No pairs: no rows.
    """
    spark = graph.sparkSession
    names = graph.select(F.least("one", "two").cast("string").alias("one"), F.greatest("one", "two").cast("string").alias("two"), F.col("wire").cast("double").alias("wire"))
    pairs = names.groupBy("one", "two").agg(F.sum("wire").alias("wire"))
    now = checkpointed(pairs.join(spark.range(seeds).select(F.col("id").cast("int").alias("seed"))), "level")  # a graph a seed, as many as asked for
    both = checkpointed(_both(now), "both")
    whole = both
    home = checkpointed(both.select("seed", "node").distinct().withColumn("community", F.col("node")), "home")
    score = checkpointed(_modularity(both, home), "score")
    done = None
    for level in range(LEVELS):
        parts = _settled(both, level, seed)
        # A node of this level is a community of the last one.
        moved = home.withColumnRenamed("community", "old").join(parts.withColumnRenamed("node", "old"), ["seed", "old"]).select("seed", "node", "community")
        better = checkpointed(_modularity(whole, moved).join(score.select("seed", F.col("modularity").alias("before")), "seed").where("modularity > before + 1e-12").drop("before"), "better")
        lasts = home.join(better.select("seed"), "seed", "left_anti")
        done = lasts if done is None else done.unionByName(lasts)
        if better.isEmpty():
            break
        home = checkpointed(moved.join(better.select("seed"), "seed", "left_semi"), "home")
        old = score.join(better.select("seed"), "seed", "left_anti")
        score = checkpointed(better.unionByName(old), "score")
        at = lambda end: parts.select("seed", F.col("node").alias(end), F.col("community").alias(f"{end}_to"))
        joined = now.join(better.select("seed"), "seed", "left_semi").join(at("one"), ["seed", "one"]).join(at("two"), ["seed", "two"])
        now = checkpointed(joined.groupBy("seed", F.least("one_to", "two_to").alias("one"), F.greatest("one_to", "two_to").alias("two")).agg(F.sum("wire").alias("wire")), "level")
        both = checkpointed(_both(now), "both")
    least = done.groupBy("seed", "community").agg(F.min("node").alias("name"))
    return checkpointed(done.join(least, ["seed", "community"]).select("seed", "node", F.col("name").alias("community")), "communities"), score


def communities(graph: DataFrame, seed: int = 1) -> DataFrame:
    """(node, community) of one seed."""
    return partitions_by_seed(graph, 1, seed)[0].select("node", "community")


def stable_partition(graph: DataFrame, seeds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """((node, community), tally) of the partition that most seeds agree on, the one of the least seed among equals.

    ``tally`` is one row: seeds, distinct_partitions, seeds_agreeing, communities, modularity. Whole partitions are told
    apart by a sum of 64-bit hashes of their (node, community), so no partition is gathered anywhere.
    """
    parts, score = partitions_by_seed(graph, seeds, seed)
    digest = parts.groupBy("seed").agg(F.sum(F.xxhash64("node", "community").cast("decimal(38,0)")).alias("digest"))
    tally = digest.groupBy("digest").agg(F.count("*").alias("agree"), F.min("seed").alias("seed"))
    best = checkpointed(tally.agg(F.max(F.struct("agree", (-F.col("seed")).alias("down"))).alias("b"), F.count("*").alias("distinct_partitions"), F.sum("agree").alias("seeds")).where("b is not null"), "tally")
    one = best.select((-F.col("b.down")).alias("seed"), "seeds", "distinct_partitions", F.col("b.agree").alias("seeds_agreeing"))
    return parts.join(one.select("seed"), "seed", "left_semi").select("node", "community"), one.join(score, "seed").select("seeds", "distinct_partitions", "seeds_agreeing", "communities", "modularity")
