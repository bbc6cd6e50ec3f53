"""Graph operators as rounds of joins over edge tables; no graph is held by one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.expressions import distance, draw
from meshwork.operators import edges as E
from meshwork.operators.analytic import quantiles, running, with_quantiles
from meshwork.operators.flow import max_flow
from meshwork.sources.graph_views import with_ends
from meshwork.sources.sinks import checkpointed

#: Edges of a range in which rewiring looks for partners.
PAIRED = 4096


def search_levels(edges: DataFrame, roots: DataFrame, directed: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Breadth-first search from every root at once, to the end: (*by, root, node, level), the root at level 0.

    A round joins the frontier with the edges and drops nodes already reached; each level is a table of its own.
    ``roots`` has node. Searches in several graphs run together: ``by`` are columns of both tables that tell them apart.
    """
    steps = edges.select(*by, "src", "dst").distinct()
    if not directed:
        steps = steps.unionByName(steps.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    frontier = checkpointed(roots.select(*by, F.col("node").alias("root"), "node", F.lit(0).alias("level")).distinct(), "level")
    reached = frontier
    while not frontier.isEmpty():
        found = frontier.select(*by, "root", F.col("node").alias("src"), "level").join(steps, [*by, "src"]).groupBy(*by, "root", F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level"))
        frontier = checkpointed(found.join(reached.select(*by, "root", "node"), [*by, "root", "node"], "left_anti"), "level")
        reached = reached.unionByName(frontier)
    return reached


def reachable_pairs(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (source, target) with a directed path and their share of all pairs (0 if there are none)."""
    levels = search_levels(edges, sources)
    hits = levels.join(targets.select("node"), "node", "left_semi").where("root != node").agg(F.count("*").alias("pairs"))
    sizes = sources.agg(F.count("*").alias("s")).join(targets.agg(F.count("*").alias("t")))
    return hits.join(sizes).select("pairs", F.coalesce(F.col("pairs") / F.nullif(F.col("s") * F.col("t"), F.lit(0)), F.lit(0.0)).alias("reachability"))


def unreachable_from(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes without a path from any source."""
    start = sources.select(F.lit("any").alias("root"), "node")
    steps = edges.select("src", "dst")
    reached = checkpointed(start.select("node").distinct())
    frontier = reached
    while not frontier.isEmpty():
        frontier = checkpointed(frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti"))
        reached = checkpointed(reached.unionByName(frontier))
    return nodes.select("node").join(reached, "node", "left_anti")


def efficiency(levels: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """Mean of 1 / distance from the roots to all other nodes; unreached is 0. ``n_nodes`` has n."""
    sums = levels.agg(F.sum(F.when(F.col("level") > 0, 1 / F.col("level")).otherwise(0.0)).alias("s"), F.countDistinct("root").alias("roots"))
    return sums.join(n_nodes).select("roots", (F.col("s") / (F.col("roots") * (F.col("n") - 1))).alias("efficiency"))


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable whatever the direction; isolated nodes are their own."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = checkpointed(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        lower = label.join(near, label["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        # Jump: take the label of the label, which halves the remaining distance.
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = checkpointed(lower.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "was"))
        if moved.where("component != was").isEmpty():
            return moved.select("node", "component")
        label = moved.select("node", "component")


def largest_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return weak_components(edges, nodes).groupBy("component").agg(F.count("*").alias("size")).agg(F.max("size").alias("largest"), F.count("*").alias("components"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b), a < b."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles, degree) of the undirected simple graph. Edges point from lower to higher degree, so a hub's
    pairs of neighbours are few."""
    pairs = undirected(edges)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    d = degree.select(F.struct("degree", "node").alias("d"), "node")
    ranked = pairs.join(d.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    out = ranked.select(F.when(F.col("da") < F.col("db"), F.col("a")).otherwise(F.col("b")).alias("low"), F.when(F.col("da") < F.col("db"), F.col("b")).otherwise(F.col("a")).alias("high"))
    wedges = out.select("low", F.col("high").alias("x")).join(out.select("low", F.col("high").alias("y")), "low").where("x < y")
    closed = wedges.join(pairs, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    per = closed.select(F.explode(F.array("low", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return degree.join(per, "node", "left").fillna(0, ["triangles"]).select("node", "triangles", "degree")


def clustering(edges: DataFrame) -> DataFrame:
    """Global transitivity and mean local clustering (nodes of degree under 2 count 0) over nodes with an edge."""
    t = triangles(edges)
    wedges = F.col("degree") * (F.col("degree") - 1) / 2
    local = F.when(F.col("degree") >= 2, F.col("triangles") / wedges).otherwise(0.0)
    return t.agg(F.count("*").alias("nodes"), (F.sum("triangles") / 3).cast("long").alias("triangles"), (F.sum("triangles") / F.nullif(F.sum(wedges), F.lit(0.0))).alias("transitivity"), F.avg(local).alias("mean_clustering"))


def edge_betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest-path betweenness of edges from the given sources, exact when those are all nodes.

    Path counts go forward and dependencies backward level by level, for all sources at once, as joins.
    """
    steps = edges.select("src", "dst").distinct()
    levels = search_levels(edges, sources)
    depth = levels.agg(F.max("level").alias("d")).first()["d"] or 0
    at = lambda name: levels.select("root", F.col("node").alias(name), F.col("level").alias(f"{name}_level"))
    tree = checkpointed(at("src").join(steps, "src").join(at("dst"), ["root", "dst"]).where("dst_level = src_level + 1").select("root", "src", "dst", "dst_level"))
    paths = levels.where("level = 0").select("root", "node", F.lit(1.0).alias("sigma"))
    parts = [paths]
    for level in range(1, depth + 1):
        here = tree.where(F.col("dst_level") == level).join(parts[-1].withColumnRenamed("node", "src"), ["root", "src"])
        parts.append(checkpointed(here.groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))))
    result, below = None, None
    for level in range(depth, 0, -1):
        here = tree.where(F.col("dst_level") == level).join(parts[level - 1].select("root", F.col("node").alias("src"), F.col("sigma").alias("s")), ["root", "src"])
        here = here.join(parts[level].select("root", F.col("node").alias("dst"), F.col("sigma").alias("t")), ["root", "dst"])
        share = F.lit(1.0) if below is None else 1 + F.coalesce("delta", F.lit(0.0))
        here = here if below is None else here.join(below, ["root", "dst"], "left")
        flow = checkpointed(here.select("root", "src", "dst", (F.col("s") / F.col("t") * share).alias("flow")))
        below = flow.groupBy("root", F.col("src").alias("dst")).agg(F.sum("flow").alias("delta"))
        result = flow if result is None else result.unionByName(flow)
    if result is None:
        return steps.select("src", "dst", F.lit(0.0).alias("betweenness"))
    sums = result.groupBy("src", "dst").agg(F.sum("flow").alias("betweenness"))
    return steps.join(sums, ["src", "dst"], "left").fillna(0.0)


def rewired(edges: DataFrame, seed: int, by: tuple[str, ...] = (), rounds: int | None = None, settled: float = 0.97, undirected: bool = False) -> DataFrame:
    """Degree-preserving randomisation: each round pairs edges at random (inside the groups ``by``, such as draws and layers) and
    swaps targets where the graph stays simple; then each source's weights are dealt anew over its new edges.

    Rounds end after ``rounds``, or, without it, when a round leaves at least the share ``settled`` of the given edges that
    were left before it: then edges are as often given ones as chance makes them. All groups share the rounds; each has its own
    draws. Neighbours in a random order are partners; the order is cut into ranges of about PAIRED edges, so no window is long.
    ``undirected`` pairs are turned at random before they swap ends, stay simple as unordered pairs, and come without weights.
    """
    pair = (lambda x, y: (F.least(x, y), F.greatest(x, y))) if undirected else (lambda x, y: (F.col(x), F.col(y)))
    ends = lambda x, y: [c.alias(n) for c, n in zip(pair(x, y), ("src", "dst"), strict=True)]
    given = checkpointed(edges.select(*by, *ends("src", "dst")), "given")
    now, before, k = given, given.count(), 0
    ranges = max(1, -(-before // PAIRED))
    keys = [F.col(c) for c in (*by, "src", "dst")]
    while rounds is None or k < rounds:
        keyed = now.withColumn("u", draw(seed, k, *keys)).withColumn("bucket", F.floor(F.col("u") * ranges))
        w = Window.partitionBy(*by, "bucket").orderBy("u", "src", "dst")
        nth = keyed.withColumn("i", F.row_number().over(w) - 1).withColumn("pair", F.expr("i div 2")).select(*by, "bucket", "pair", (F.col("i") % 2).alias("which"), "src", "dst")
        if undirected:
            turn = draw(seed, "turn", k, *keys) < 0.5
            nth = nth.select(*by, "bucket", "pair", "which", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"))
        one, two = nth.where("which = 0"), nth.where("which = 1")
        pairs = one.select(*by, "bucket", "pair", F.col("src").alias("a"), F.col("dst").alias("b")).join(two.select(*by, "bucket", "pair", F.col("src").alias("c"), F.col("dst").alias("d")), [*by, "bucket", "pair"])
        wanted = checkpointed(pairs.where("a != d and c != b and a != c and b != d").select(*by, "a", "b", "c", "d"), "swaps")
        new = wanted.select(*by, "a", "b", "c", "d", F.explode(F.array(F.struct(*ends("a", "d")), F.struct(*ends("c", "b")))).alias("e"))
        new = new.select(*by, "a", "b", "c", "d", "e.src", "e.dst")
        times = new.groupBy(*by, "src", "dst").agg(F.count("*").alias("same"))
        clash = new.join(now.withColumn("old", F.lit(1)), [*by, "src", "dst"], "left").join(times, [*by, "src", "dst"])
        good = checkpointed(clash.groupBy(*by, "a", "b", "c", "d").agg(F.max("old").alias("old"), F.max("same").alias("same")).where("old is null and same = 1").select(*by, "a", "b", "c", "d"), "swaps")
        at = lambda x, y, g=good: g.select(*by, *ends(x, y))
        now = checkpointed(now.join(at("a", "b").unionByName(at("c", "d")), [*by, "src", "dst"], "left_anti").unionByName(at("a", "d")).unionByName(at("c", "b")), "rewired")
        k += 1
        if rounds is None:
            left = now.join(given, [*by, "src", "dst"], "left_semi").count()
            if left >= settled * before:
                break
            before = left
    if undirected:
        return now
    old = edges.withColumn("i", F.row_number().over(Window.partitionBy(*by, "src").orderBy(draw(seed, "w", *keys), "dst"))).select(*by, "src", "i", "weight")
    fresh = now.withColumn("i", F.row_number().over(Window.partitionBy(*by, "src").orderBy("dst")))
    return fresh.join(old, [*by, "src", "i"]).select(*by, "src", "dst", "weight")


def redealt(graph: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The same pairs (*by, one, two) with their wires dealt anew inside each group."""
    rows, keys = graph.withColumn("single", F.lit(1)), [F.col(c) for c in by]
    pair = (F.col("one"), F.col("two"))
    named = running(rows, "single", *keys, *pair).select(*by, "nth", "one", "two")
    dealt = running(rows, "single", *keys, draw(seed, *keys, *pair), *pair).select("nth", "wire")
    return named.join(dealt, "nth").drop("nth")


def network_metrics(graph: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each undirected weighted graph (*by, one, two, wire): mean local clustering and the same weighted by wire (a
    closed pair counts with its two wires' mean over the node's), and mean path length in steps and by cost, the
    greatest wire over the edge's; means of paths are over pairs with one. Graphs share the rounds of the searches."""
    b = list(by)
    both = checkpointed(graph.select(*b, F.col("one").alias("node"), F.col("two").alias("other"), "wire").unionByName(graph.select(*b, F.col("two").alias("node"), F.col("one").alias("other"), "wire")), "both")
    per = both.groupBy(*b, "node").agg(F.count("*").alias("k"), F.sum("wire").alias("s"))
    wedge = both.select(*b, "node", F.col("other").alias("x"), F.col("wire").alias("wx")).join(both.select(*b, "node", F.col("other").alias("y"), F.col("wire").alias("wy")), [*b, "node"]).where("x < y")
    closed = wedge.join(both.select(*b, F.col("node").alias("x"), F.col("other").alias("y")), [*b, "x", "y"]).groupBy(*b, "node").agg(F.count("*").alias("t"), F.sum(F.col("wx") + F.col("wy")).alias("w"))
    local = per.join(closed, [*b, "node"], "left").fillna(0, ["t", "w"])
    k = F.col("k")
    clustering = local.groupBy(*b).agg(F.count("*").alias("nodes"), F.avg(F.when(k >= 2, 2 * F.col("t") / (k * (k - 1))).otherwise(0.0)).alias("clustering"), F.avg(F.when(k >= 2, F.col("w") / (F.col("s") * (k - 1))).otherwise(0.0)).alias("weighted_clustering"))
    steps = search_levels(both.select(*b, F.col("node").alias("src"), F.col("other").alias("dst")), per.select(*b, "node"), by=by).where("level > 0").groupBy(*b).agg(F.avg("level").alias("path"))
    most = both.groupBy(*b).agg(F.max("wire").alias("most"))
    priced = both.join(most, b) if b else both.join(most)
    costs = path_costs(priced.select(*b, "node", "other", (F.col("most") / F.col("wire")).alias("cost")), by).groupBy(*b).agg(F.avg("cost").alias("weighted_path"))
    return clustering.join(steps, b).join(costs, b) if b else clustering.join(steps).join(costs)


def small_world(graph: DataFrame, draws: int, seed: int) -> DataFrame:
    """(null, metric, real, null_mean, null_sd, low, high, ratio, z, p) of an undirected graph (one, two, wire) against
    ``draws`` graphs rewired with their wires dealt anew, and ``draws`` with the same pairs and wires dealt anew; p is
    two-sided. Rows ``sigma`` and ``weighted_sigma`` have the ratio of the clustering's over the path's ratio in ``ratio``."""
    spark = graph.sparkSession
    numbers = spark.range(draws).select(F.col("id").cast("int").alias("draw"))
    many = checkpointed(graph.join(numbers), "many")  # a graph a draw, as many as asked for
    turned = rewired(many.select("draw", F.col("one").alias("src"), F.col("two").alias("dst")), seed, ("draw",), undirected=True)
    # The wires of a draw, in a random order, go to its new pairs in theirs.
    wires = running(many.withColumn("single", F.lit(1)), "single", F.col("draw"), draw(seed, "wire", F.col("draw"), F.col("one"), F.col("two")), F.col("one"), F.col("two")).select("nth", "wire")
    turned = running(turned.withColumn("single", F.lit(1)), "single", F.col("draw"), F.col("src"), F.col("dst")).select("nth", "draw", F.col("src").alias("one"), F.col("dst").alias("two")).join(wires, "nth").drop("nth")
    nulls = turned.withColumn("null", F.lit("rewired")).unionByName(redealt(many, seed + 2, ("draw",)).withColumn("null", F.lit("weights shuffled")))
    nulls = checkpointed(nulls, "nulls")
    names = ["clustering", "path", "weighted_clustering", "weighted_path"]
    tall = lambda frame, *keys: frame.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("m")).select(*keys, "m.*")
    real = tall(network_metrics(graph)).withColumnRenamed("value", "real")
    drawn = checkpointed(tall(network_metrics(nulls, ("null", "draw")), "null", "draw").join(real, "metric"), "drawn")
    sums = drawn.groupBy("null", "metric", "real").agg(F.count("*").alias("n"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), F.count_if(F.col("value") >= F.col("real")).alias("above"), F.count_if(F.col("value") <= F.col("real")).alias("below"))
    sums = with_quantiles(sums, drawn, "value", {"low": 0.025, "high": 0.975}, "null", "metric")
    p = F.least(F.lit(1.0), 2 * (1 + F.least("above", "below")) / (1 + F.col("n")))
    ratio = F.col("real") / F.nullif(F.col("null_mean"), F.lit(0.0))
    rows = checkpointed(sums.select("null", "metric", "real", "null_mean", "null_sd", "low", "high", ratio.alias("ratio"), F.when(F.col("null_sd") > 0, (F.col("real") - F.col("null_mean")) / F.col("null_sd")).alias("z"), p.alias("p")), "small-world")
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("ratio")))
    for prefix in ("", "weighted_"):
        none = [F.lit(None).cast("double").alias(c) for c in ("real", "null_mean", "null_sd", "low", "high")]
        sigma = rows.groupBy("null").agg((pick(f"{prefix}clustering") / pick(f"{prefix}path")).alias("ratio"))
        rows = rows.unionByName(sigma.select("null", F.lit(f"{prefix}sigma").alias("metric"), *none, "ratio", F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p")))
    return rows


def path_costs(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, root, node, cost) of the cheapest paths between all pairs by (*by, node, other, cost): rounds in which every pair whose
    cost fell is carried one step further. All pairs are the feature."""
    b = list(by)
    best = checkpointed(steps.groupBy(*b, F.col("node").alias("root"), F.col("other").alias("node")).agg(F.min("cost").alias("cost")), "costs")
    fresh = best
    while not fresh.isEmpty():
        longer = fresh.join(steps.select(*b, "node", "other", F.col("cost").alias("more")), [*b, "node"]).where("root != other").groupBy(*b, "root", F.col("other").alias("node")).agg(F.min(F.col("cost") + F.col("more")).alias("found"))
        joined = checkpointed(best.join(longer, [*b, "root", "node"], "full_outer").withColumn("fell", F.coalesce(F.col("found") < F.col("cost") * (1 - 1e-12), F.col("cost").isNull())), "costs")
        fresh = joined.where("fell").select(*b, "root", "node", F.col("found").alias("cost"))
        best = joined.select(*b, "root", "node", F.when(F.col("fell"), F.col("found")).otherwise(F.col("cost")).alias("cost"))
    return best


def properties(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(property, value) of a directed graph over ``nodes`` (node, x, y, z, role, compartment, superclass): edges, spread and
    maximum of in- and out-degree, total and median length, share across compartments, reciprocity, transitivity, flow and
    reachable pairs from sensory to motor nodes, crossing edges, routes between rich nodes."""
    measured = checkpointed(with_ends(edges.select("src", "dst"), nodes, ["x", "y", "z", "role", "compartment"]).withColumn("length", distance("src_", "dst_")), "measured")
    d = E.degrees(measured, nodes)
    s, t = (nodes.where(F.col("superclass") == c).select("node") for c in ("sensory", "motor"))
    rich = E.rich_mask(measured, nodes, 0.1)
    other = ~F.coalesce(F.col("src_compartment").eqNullSafe(F.col("dst_compartment")), F.lit(False))
    parts = [
        d.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in ("in_degree", "out_degree") for f, n in ((F.stddev_pop, "sd"), (F.max, "max"))]),
        measured.agg(F.count("*").cast("double").alias("edges"), E.wire().alias("total_cost"), F.avg(other.cast("int")).alias("cross_compartment"), F.count_if(E.crossing()).cast("double").alias("crossing_edges")),
        E.reciprocity(measured).select("reciprocity"), clustering(measured).select("transitivity"), max_flow(measured.select("src", "dst"), s, t).select(F.col("flow").cast("double").alias("flow")),
        reachable_pairs(measured, s, t).select(F.col("pairs").cast("double").alias("pairs")), E.route_counts(measured, rich).agg(F.coalesce(F.sum("routes"), F.lit(0)).cast("double").alias("rich_routes")),
    ]
    parts.append(quantiles(measured, "length", {"median_length": 0.5}))
    rows = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).alias("value")) for c in p.columns])).alias("r")).select("r.*") for p in parts]
    return reduce(DataFrame.unionByName, rows)


def removal_curve(edges: DataFrame, nodes: DataFrame, cuts: DataFrame, sources: DataFrame) -> DataFrame:
    """(schedule, share, cut, largest, efficiency): largest component and efficiency after the first ``cut`` edges of a
    schedule are gone. ``edges`` has schedule, nth, src, dst; ``cuts`` has schedule, share, cut.

    Every cut is a graph of its own in the same tables, so all of them share the rounds of one search.
    """
    by = ("schedule", "share")
    left = checkpointed(edges.join(cuts, "schedule").where("nth > cut").select(*by, "src", "dst"), "left")
    many = cuts.select(*by)
    n = nodes.agg(F.count("*").alias("n"))
    levels = checkpointed(search_levels(left, many.join(sources.select("node").distinct()), by=by), "levels")
    near = levels.groupBy(*by).agg(F.sum(F.when(F.col("level") > 0, 1 / F.col("level")).otherwise(0.0)).alias("s"), F.countDistinct("root").alias("roots")).join(F.broadcast(n))
    named = lambda c: F.concat_ws("\u0001", "schedule", F.col("share").cast("string"), c)
    parts = weak_components(left.select(named("src").alias("src"), named("dst").alias("dst")), many.join(nodes.select("node")).select(named("node").alias("node")))
    first = lambda i: F.split("component", "\u0001")[i]
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).groupBy(first(0).alias("schedule"), first(1).cast("double").alias("share")).agg(F.max("size").alias("largest"))
    return cuts.join(sizes, list(by)).join(near, list(by)).select("schedule", "share", "cut", "largest", (F.col("s") / (F.col("roots") * (F.col("n") - 1))).alias("efficiency"))
