"""Measures of edges and nodes: lengths, degrees, wire, masks, layers, routes, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.expressions import distance
from meshwork.operators.analytic import quantiles, running, selected_quantiles, with_quantiles
from meshwork.sources.sinks import checkpointed


def edge_groups(edges: DataFrame) -> DataFrame:
    """One row per edge and group it is in: all, brain, vnc (both ends), between (one end in each), crossing (via a connective node)."""
    s, d = F.coalesce("src_compartment", F.lit("?")), F.coalesce("dst_compartment", F.lit("?"))
    groups = F.array_compact(
        F.array(
            F.lit("all"),
            F.when((s == "brain") & (d == "brain"), "brain"),
            F.when((s == "vnc") & (d == "vnc"), "vnc"),
            F.when(((s == "brain") & (d == "vnc")) | ((s == "vnc") & (d == "brain")), "between"),
            F.when(crossing(), "crossing"),
        )
    )
    return edges.withColumn("edge_group", F.explode(groups))


def crossing() -> Column:
    """Edges that cross the neck: descending role and vnc end, or ascending role and brain end, either way."""
    s, d, sc, dc = (F.coalesce(c, F.lit("?")) for c in ("src_role", "dst_role", "src_compartment", "dst_compartment"))
    return ((s == "descending") & (d == "none") & (dc == "vnc")) | ((d == "descending") & (s == "none") & (sc == "vnc")) | ((s == "ascending") & (d == "none") & (dc == "brain")) | ((d == "ascending") & (s == "none") & (sc == "brain"))


def incident() -> Column:
    return (F.col("src_role") != "none") | (F.col("dst_role") != "none")


def layer() -> Column:
    """Typed layer: brain to descending, descending to vnc, vnc to ascending, ascending to brain; null for others."""
    s, d, sc, dc = (F.coalesce(c, F.lit("?")) for c in ("src_role", "dst_role", "src_compartment", "dst_compartment"))
    return (
        F.when((s == "none") & (sc == "brain") & (d == "descending"), "brain-descending")
        .when((s == "descending") & (d == "none") & (dc == "vnc"), "descending-vnc")
        .when((s == "none") & (sc == "vnc") & (d == "ascending"), "vnc-ascending")
        .when((s == "ascending") & (d == "none") & (dc == "brain"), "ascending-brain")
    )


def node_sets(nodes: DataFrame) -> DataFrame:
    """Boolean masks of nodes."""
    c, plain = F.coalesce("compartment", F.lit("?")), F.col("role") == "none"
    return nodes.select(
        "node", (plain & (c == "brain")).alias("in_brain"), (plain & (c == "vnc")).alias("in_vnc"), (F.col("role") == "descending").alias("descending"),
        (F.col("role") == "ascending").alias("ascending"), (~plain).alias("connective"),
    )


def sensory_motor(nodes: DataFrame) -> DataFrame:
    """Nodes of the sensory and motor classes by compartment."""
    kind = F.when(F.col("superclass").isin("sensory"), "sensory").when(F.col("superclass").isin("motor"), "motor")
    return nodes.withColumn("set", F.concat_ws("-", kind, "compartment")).where(kind.isNotNull() & F.col("compartment").isNotNull()).groupBy("set").agg(F.count("*").alias("members"), F.min("node").alias("first_node"))


def wire(length: str = "length") -> Column:
    """Sum of lengths in whole millionths, so that it doesn't depend on the order of addition."""
    return F.sum(F.round(F.col(length) * 1_000_000).cast("long")) / 1_000_000


def length_summary(edges: DataFrame, *by: str) -> DataFrame:
    """Edges, total, mean, median, 90th and 99th percentile and greatest of the lengths, by group."""
    kept = checkpointed(edges.select(*by, "length"), "lengths")
    sums = kept.groupBy(*by).agg(F.count("*").alias("edges"), wire().alias("total"), (wire() / F.count("*")).alias("mean"), F.max("length").alias("longest"))
    return with_quantiles(sums, kept, "length", {"median": 0.5, "p90": 0.9, "p99": 0.99}, *by).select(*by, "edges", "total", "mean", "median", "p90", "p99", "longest")


def cost(edges: DataFrame) -> DataFrame:
    """Total length, and total length times weight."""
    return edges.agg(wire().alias("wire"), (F.sum(F.round(F.col("length") * F.col("weight") * 1_000_000).cast("decimal(38,0)")).cast("double") / 1_000_000).alias("weighted_wire"))


def cost_shares(edges: DataFrame) -> DataFrame:
    """Overlapping groups: edges, share of edges, share of wire, mean length."""
    sums = edge_groups(edges).groupBy("edge_group").agg(F.count("*").alias("edges"), wire().alias("wire"))
    whole = sums.where("edge_group = 'all'").select(F.col("edges").alias("e"), F.col("wire").alias("w"))
    return sums.join(F.broadcast(whole)).select("edge_group", "edges", (F.col("edges") / F.col("e")).alias("edge_share"), (F.col("wire") / F.col("w")).alias("wire_share"), (F.col("wire") / F.col("edges")).alias("mean_length"))


def ends(edges: DataFrame, *carry: str) -> DataFrame:
    """Two rows per edge: node, the other end, and ``carry``."""
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    return edges.select(F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("e"), *carry).select("e.node", "e.other", *carry)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In, out and total degree of every node, 0 where isolated."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"))
    return nodes.select("node").join(counts, "node", "left").fillna(0).select("node", "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("degree"))


def degree_and_wire(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    sums = ends(edges, "length").groupBy("node").agg(F.count("*").alias("degree"), wire().alias("wire"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("wire", F.lit(0.0)).alias("wire"))


def partner_richness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree among nodes without a connective role; 0 for the others."""
    return degrees(edges.where(~incident()), nodes).select("node", F.col("degree").alias("richness"))


def quantile_threshold(members: DataFrame, value: str, top: float) -> DataFrame:
    """Least value of the top fraction (linear quantile)."""
    return quantiles(members, value, {"threshold": 1 - top})


def rich_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, side, richness of the nodes without a role whose compartment is brain or vnc (their ``side``)."""
    members = nodes.where((F.col("role") == "none") & F.col("compartment").isin("brain", "vnc")).select("node", F.col("compartment").alias("side"))
    return partner_richness(edges, nodes).join(members, "node").select("node", "side", "richness")


def rich_mask(edges: DataFrame, nodes: DataFrame, top: float) -> DataFrame:
    """node, rich: at least the quantile of richness among the members of the node's own compartment; others aren't rich."""
    members = checkpointed(rich_members(edges, nodes), "members")
    least = quantiles(members, "richness", {"threshold": 1 - top}, "side")
    rich = members.join(least, "side").where("richness >= threshold").select("node", F.lit(True).alias("rich"))
    return nodes.select("node").join(rich, "node", "left").select("node", F.coalesce("rich", F.lit(False)).alias("rich"))


def layered(edges: DataFrame, rich: DataFrame) -> DataFrame:
    """Edges of the four layers with the hub (their connective end) and whether the partner is rich."""
    kept = edges.withColumn("layer", layer()).where("layer is not null")
    hub_is_dst = F.col("layer").isin("brain-descending", "vnc-ascending")
    kept = kept.select("layer", F.when(hub_is_dst, F.col("dst")).otherwise(F.col("src")).alias("hub"), F.when(hub_is_dst, F.col("src")).otherwise(F.col("dst")).alias("node"))
    return kept.join(rich.hint("shuffle_hash"), "node").withColumnRenamed("node", "partner")


def rich_edge_fraction(edges: DataFrame, rich: DataFrame) -> DataFrame:
    return layered(edges, rich).groupBy("layer").agg(F.count("*").alias("edges"), F.avg(F.col("rich").cast("int")).alias("rich_share"))


def route_counts(edges: DataFrame, rich: DataFrame) -> DataFrame:
    """Two-step routes between rich nodes through each role: per hub, rich inputs times rich outputs. Paths aren't listed."""
    per = layered(edges, rich).where("rich").groupBy("hub").agg(
        F.count_if(F.col("layer").isin("brain-descending", "vnc-ascending")).alias("ins"), F.count_if(F.col("layer").isin("descending-vnc", "ascending-brain")).alias("outs"),
        F.min(F.when(F.col("layer").contains("descending"), "descending").otherwise("ascending")).alias("role"),
    )
    return per.groupBy("role").agg(F.count("*").alias("hubs"), F.sum(F.col("ins") * F.col("outs")).alias("routes"))


def rich_at(edges: DataFrame, nodes: DataFrame, tops: list[float]) -> DataFrame:
    """(node, rich): the places in ``tops`` of the fractions at which a node is rich in its compartment; others have no row."""
    rich = checkpointed(rich_members(edges, nodes), "members")
    cuts = quantiles(rich, "richness", {f"t{i}": 1 - t for i, t in enumerate(tops)}, "side").select("side", F.posexplode(F.array(*[f"t{i}" for i in range(len(tops))])).alias("i", "cut"))
    return rich.join(cuts, "side").where("richness >= cut").groupBy("node").agg(F.collect_list("i").alias("rich"))  # an entry a fraction


def routes_by(layered_edges: DataFrame, rich: DataFrame, by: str, *also: str) -> DataFrame:
    """(by, *also, i, role, routes): two-step routes between rich nodes through each role, in each graph of the column ``by``
    and at each fraction of ``rich_at``; role ``total`` is both. ``layered_edges`` has by, layer, src, dst and the columns
    ``also``, which tell graphs apart too, each with its own rows of ``rich``. Paths aren't listed."""
    into = F.col("layer").isin("brain-descending", "vnc-ascending")
    kept = layered_edges.select(by, *also, "layer", F.when(into, F.col("dst")).otherwise(F.col("src")).alias("hub"), F.when(into, F.col("src")).otherwise(F.col("dst")).alias("node"), into.cast("int").alias("into"))
    flagged = kept.join(rich, ["node", *also]).withColumn("i", F.explode("rich"))
    role = F.when(F.col("layer").contains("descending"), "descending").otherwise("ascending")
    per = flagged.groupBy(by, *also, "i", "hub", role.alias("role")).agg((F.sum("into") * F.sum(1 - F.col("into"))).alias("routes"))
    each = per.groupBy(by, *also, "i", "role").agg(F.sum("routes").alias("routes"))
    return each.unionByName(each.groupBy(by, *also, "i").agg(F.sum("routes").alias("routes")).select(by, *also, "i", F.lit("total").alias("role"), "routes"))


def route_threshold_curve(edges: DataFrame, nodes: DataFrame, tops: list[float]) -> DataFrame:
    """Routes at several rich fractions, one pass over the edges; fractions are taken inside each compartment."""
    typed = edges.withColumn("layer", layer()).where("layer is not null").select(F.lit(0).alias("graph"), "layer", "src", "dst")
    at = F.array(*[F.lit(t) for t in tops])
    return routes_by(typed, rich_at(edges, nodes, tops), "graph").where("role = 'total'").select(at[F.col("i")].alias("top_fraction"), "routes")


def rich_club(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every degree k: nodes and edges above it and their density, from two histograms and reverse running sums."""
    degree = degrees(edges, nodes).select("node", "degree")
    of_nodes = degree.groupBy(F.col("degree").alias("k")).agg(F.count("*").alias("n"))
    least = edges.select("src", "dst").join(degree.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    of_edges = least.groupBy(F.least("a", "b").alias("k")).agg(F.count("*").alias("e"))
    # Above a degree that no node has, the next one counts: only degrees that occur take part in the running sums.
    seen = of_nodes.join(of_edges, "k", "left").withColumn("e", F.coalesce("e", F.lit(0))).withColumn("one", F.col("n"))
    ran = running(seen, "n", -F.col("k")).select("k", F.col("upto").alias("n_from"), "n", "e")
    ran = running(ran, "e", -F.col("k")).select("k", "n_from", "n", F.col("upto").alias("e_from"), F.lag("k").over(Window.orderBy("k")).alias("below"))  # a row per degree that occurs
    # From the degree below up to k - 1, the nodes and edges above are those from k on; from the greatest on there are none.
    # Isolated nodes are below no degree: their own, 0, opens no span.
    spans = ran.where("k > 0").select(F.explode(F.sequence(F.coalesce("below", F.lit(0)).cast("long"), F.col("k") - 1)).alias("k"), F.col("n_from").alias("nodes_above"), F.col("e_from").alias("edges_above"))
    last = degree.agg(F.max("degree").cast("long").alias("k")).select("k", F.lit(0).cast("long").alias("nodes_above"), F.lit(0).cast("long").alias("edges_above")).where("k is not null")
    sums = spans.unionByName(last)
    n = F.col("nodes_above")
    return sums.withColumn("phi", F.when(n >= 2, F.col("edges_above") / (n * (n - 1))))


def rich_club_curves(edges: DataFrame, by: str) -> DataFrame:
    """(by, k, nodes_above, phi) of each graph of the column ``by``: as ``rich_club``, for 0 and the degrees that occur in it.
    Windows are over the degrees of a graph."""
    both = edges.select(by, F.explode(F.array("src", "dst")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("degree"))
    both = checkpointed(both, "degrees")
    of_nodes = both.groupBy(by, F.col("degree").alias("k")).agg(F.count("*").alias("n"))
    ends = edges.select(by, "src", "dst").join(both.select(by, F.col("node").alias("src"), F.col("degree").alias("a")), [by, "src"]).join(both.select(by, F.col("node").alias("dst"), F.col("degree").alias("b")), [by, "dst"])
    of_edges = ends.groupBy(by, F.least("a", "b").alias("k")).agg(F.count("*").alias("e"))
    down = Window.partitionBy(by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sums = of_nodes.join(of_edges, [by, "k"], "left").select(by, "k", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n"), F.coalesce(F.sum("e").over(down), F.lit(0)).alias("e"))
    least = both.select(by).distinct().join(edges.groupBy(by).agg(F.count("*").alias("e")), by).join(both.groupBy(by).agg(F.count("*").alias("n")), by).select(by, F.lit(0).cast("long").alias("k"), "n", "e")
    phi = F.when(F.col("n") >= 2, F.col("e") / (F.col("n") * (F.col("n") - 1)))
    return sums.unionByName(least).select(by, "k", F.col("n").alias("nodes_above"), phi.alias("phi"))


def long_range(edges: DataFrame, least: float) -> DataFrame:
    """Long edges inside one compartment: count, share to the other side, share within a type."""
    kept = edges.where((F.col("length") >= least) & (F.col("src_compartment") == F.col("dst_compartment")))
    return kept.agg(F.count("*").alias("edges"), F.avg((F.col("src_side") != F.col("dst_side")).cast("int")).alias("other_side_share"), F.avg((F.col("src_cell_type") == F.col("dst_cell_type")).cast("int")).alias("same_type_share"))


def ownership(edges: DataFrame) -> DataFrame:
    """By superclass: edges that touch it (once each), their wire and its share, mean and median length. Shares overlap. ``edges``
    is read several times: a table, not what is still to be made."""
    touched = edges.select("length", F.explode(F.array_distinct(F.array("src_superclass", "dst_superclass"))).alias("superclass"))
    sums = touched.groupBy("superclass").agg(F.count("*").alias("edges"), wire().alias("wire"))
    sums = with_quantiles(sums, touched, "length", {"median": 0.5}, "superclass", made=selected_quantiles)
    whole = edges.agg(wire().alias("all_wire"))
    return sums.join(F.broadcast(whole)).select("superclass", "edges", "wire", (F.col("wire") / F.col("all_wire")).alias("wire_share"), (F.col("wire") / F.col("edges")).alias("mean"), "median")


def crossing_edges_by_node(edges: DataFrame) -> DataFrame:
    """Crossing edges of each connective node: count, wire (its price) and mean length."""
    hub = F.when(F.col("src_role") != "none", F.col("src")).otherwise(F.col("dst"))
    return edges.where(crossing()).groupBy(hub.alias("node")).agg(F.count("*").alias("crossing_edges"), wire().alias("price"), (wire() / F.count("*")).alias("mean_length"))


def without_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edge anti-selection; nodes are kept elsewhere."""
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")


def partner_distance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distance of each node to the mean position of its partners, counted per edge; null without partners."""
    where = nodes.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    mean = ends(edges).join(where, "other").groupBy("node").agg(*[F.avg(f"o{k}").alias(f"partner_{k}") for k in "xyz"])
    return nodes.select("node", *[F.col(k).alias(f"own_{k}") for k in "xyz"]).join(mean, "node", "left").select("node", distance("own_", "partner_").alias("partner_distance"))


def distance_to_centroid(nodes: DataFrame, *scope: str) -> DataFrame:
    """Distance of each node to the mean position of its scope; means are added up before they are sent, a row a scope."""
    means = nodes.groupBy(*scope).agg(*[F.avg(k).alias(f"c_{k}") for k in "xyz"])
    own = nodes.select("node", *scope, *[F.col(k).alias(f"n_{k}") for k in "xyz"])
    if scope:
        means = means.withColumnsRenamed({c: f"_of_{c}" for c in scope})
        placed = own.join(means, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in scope])
    else:
        placed = own.join(means)
    return placed.select("node", *scope, distance("n_", "c_").alias("to_centroid"))


def crosstab(nodes: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return nodes.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of edges whose reverse exists."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return edges.select("src", "dst").join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.count("back").alias("returned"), (F.count("back") / F.count("*")).alias("reciprocity"))
