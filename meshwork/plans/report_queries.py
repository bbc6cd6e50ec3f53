"""Queries of read-back, checks, small tables, flow scenarios and nulls over rewired or emptied graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import expressions as X
from meshwork.operators import analytic as A
from meshwork.operators import build
from meshwork.operators import communities as C
from meshwork.operators import edges as E
from meshwork.operators import flow
from meshwork.operators import graph as G
from meshwork.operators import link_model as M
from meshwork.operators import regions as R
from meshwork.operators import robustness
from meshwork.operators import sampling as S
from meshwork.operators import stats as T
from meshwork.operators import swaps as W
from meshwork.operators import trades
from meshwork.plans.analysis_queries import _coarse_nodes, _regions
from meshwork.plans.graph_queries import rounded
from meshwork.plans.oracle_views import BASE
from meshwork.sources import graph_views as V
from meshwork.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Files


@query("select body, kind, cell_type, side, superclass from (select body, kind, cell_type, case when key % 2 = 0 then 'L' else 'R' end side, superclass from b)")
def chunked_bodies(spark, folder):
    """Bodies written in chunks by kind and read back, whatever their folders."""
    at = _folder(spark, "chunks")
    V.bodies(spark, folder).write.partitionBy("kind").parquet(at)
    V.bodies(spark, folder).where("false").drop("kind").write.parquet(f"{at}/kind=none")
    return spark.read.parquet(at).select("body", "kind", "cell_type", "side", "superclass")


@query("select node, x, null::varchar missing from (select node, round(x, 3) x from nodes)")
def picked_columns(spark, folder):
    """JSON lines written and read back; columns that are not there are null."""
    at = _folder(spark, "rows")
    sinks.write_json(V.fine_nodes(spark, folder).select("node", F.round("x", 3).alias("x")), at)
    return sinks.picked(spark.read.schema("node string, x double").json(at), ["node", "x", "missing"])


@query("select kind, count(*) n from b group by 1 union all select 'region', count(*) from region", True)
def site_document(spark, folder):
    """Result tables as one JSON document, read back by path."""
    by_kind = V.bodies(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
    regions = V.read(spark, folder, "region").agg(F.lit("region").alias("kind"), F.count("*").alias("n"))
    doc = sinks.document(kinds=by_kind, regions=regions)
    rows = doc.select(F.explode(F.concat(*[F.from_json(c, "array<struct<kind:string,n:bigint>>") for c in ("kinds", "regions")])).alias("r"))
    return rows.select("r.kind", "r.n")


@query("select 'kinds.' || kind path, n::varchar here, (n + 1)::varchar there from (select kind, count(*) n from b group by 1) where kind = 'P' union all select 'only', null, 'x'", True)
def document_differences(spark, folder):
    """V2, V3: paths at which two nested documents differ beyond a tolerance."""
    counts = V.bodies(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
    entry = lambda n: F.to_json(F.named_struct(F.lit("kinds"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", n))))))  # noqa: E731  one row a kind
    one = counts.agg(entry(F.col("n").cast("double")).alias("d"))
    two = counts.agg(entry((F.col("n") * (1 + 1e-9) + F.when(F.col("kind") == "P", 1).otherwise(0)).cast("double")).alias("d"))
    extra = spark.createDataFrame([("only", "x")], "path string, value string")
    # Counts are whole: a relative tolerance would let one more of a million pass.
    found = sinks.differences(sinks.leaves(one, "d"), sinks.leaves(two, "d").unionByName(extra), relative=0.0, absolute=0.5)
    whole = lambda c: F.coalesce(F.expr(f"cast(cast(round(try_cast({c} as double)) as bigint) as string)"), F.col(c))
    return found.select("path", whole("here").alias("here"), whole("there").alias("there"))


# Names, wordings, checks


@query("""select name, case when name like '%(L)%' then 'L' when name like '%(R)%' then 'R' end side, nullif(regexp_extract(name, 'T[123]', 0), '') segment from (select distinct superclass || 'T' || (key % 5) || '(' || side || ')' as name from nodes)""")
def name_parts(spark, folder):
    """The side at a name's end and the first segment in it."""
    names = V.bodies(spark, folder).select(F.concat("superclass", F.lit("T"), F.col("key") % 5, F.lit("("), "side", F.lit(")")).alias("name")).distinct()
    return names.select("name", X.split_side(F.col("name"))[1].alias("side"), X.segment(F.col("name")).alias("segment"))


@query("""select k, case when p is null then 'n/a' when p <= 1 / 101.0::double then '<= 0.0099' else printf('%.4f', p) end wording, case when abs(rho) < 0.1 then 'flat' when rho > 0 then 'rising' else 'falling' end direction
 from (select r_regionkey k, case when r_regionkey < 4 then (r_regionkey::double * r_regionkey) / 20 + 0.001 end p, (r_regionkey - 2)::double / 15 rho from region)""")
def worded_results(spark, folder):
    """P-values and correlations in words."""
    k = F.col("r_regionkey")
    rows = V.read(spark, folder, "region").select(k.alias("k"), F.when(k < 4, (k.cast("double") * k) / 20 + 0.001).alias("p"), ((k - 2).cast("double") / 15).alias("rho"))
    return rows.select("k", X.format_p(F.col("p"), 100).alias("wording"), X.direction(F.col("rho")).alias("direction"))


@query("select node, round(x, 6) x, round(y, 6) y, round(z, 6) z from nodes where isfinite(x) and isfinite(y) and isfinite(z)")
def finite_positions(spark, folder):
    """Positions, where a row that isn't finite stops the query."""
    n = V.fine_nodes(spark, folder)
    fine = sum(((F.abs(k) < float("inf")).cast("int") for k in "xyz"), F.lit(0)) == 3
    return rounded(build.checked(n.select("node", "x", "y", "z"), fine, "a position is missing or not finite"))


@query("select node, superclass, cable from (select n.node, n.superclass, n.key, round(sum(w) / 10.0::double, 6) cable from nodes n join conn on pre = n.node group by 1, 2, 3) where superclass <> 'sensory' or key % 3 = 0")
def sampled_with_cable(spark, folder):
    """A sample joined 1:1 with its measurements; members without one are dropped, one with two is an error."""
    n = V.fine_nodes(spark, folder)
    sample = n.where((F.col("superclass") != "sensory") | (F.col("key") % 3 == 0)).select("node", "superclass")
    cable = V.connections(spark, folder).groupBy(F.col("pre").alias("node")).agg((F.sum("weight") / 10.0).alias("cable"))
    return rounded(build.joined_once(sample, cable, "node").where("cable is not null"))


@query("select src, dst, s.superclass src_superclass, d.superclass dst_superclass, round(s.x - d.x, 6) dx from edges join nodes s on s.node = src join nodes d on d.node = dst")
def edge_ends(spark, folder):
    """Attributes of both ends of each edge."""
    e = V.with_ends(V.fine_edges(spark, folder), V.fine_nodes(spark, folder), ["superclass", "x"])
    return rounded(e.select("src", "dst", "src_superclass", "dst_superclass", (F.col("src_x") - F.col("dst_x")).alias("dx")))


@query("select count(*) priced, count(n.node) found, count(*) - count(n.node) missing from (select distinct case when src_role <> 'none' then src else dst end node from crossed where crossing) p left join nodes n on n.node = p.node")
def indexed_nodes(spark, folder):
    """Table keys looked up among the nodes, and how many are missing."""
    priced = E.crossing_edges_by_node(V.edge_lengths(spark, folder)).select("node")
    known = V.fine_nodes(spark, folder).select("node", F.lit(True).alias("known"))
    return priced.join(known, "node", "left").agg(F.count("*").alias("priced"), F.count("known").alias("found"), F.count_if(F.col("known").isNull()).alias("missing"))


# Small tables


CABLE = """seg as (select conv_id, sum(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z))) * 0.008 cable, count(*) segments from (select conv_id, turn, p.* from conversations join pos p on p.vec_id = (conv_id * 7 + turn) % (select count(*) from embeddings)) a
 join (select conv_id cc, turn tt, p.* from conversations join pos p on p.vec_id = (conv_id * 7 + turn) % (select count(*) from embeddings)) c on cc = conv_id and tt = turn - 1 group by 1)"""


@query(f", {CABLE} select case when segments > 3 then 'long' else 'short' end as class, count(*) n, round(quantile_cont(cable, 0.5), 5) median_cable, round(quantile_cont(segments, 0.5), 5) median_segments, round(quantile_cont(cable / segments, 0.5), 5) median_ratio from seg group by 1")
def cable_by_class(spark, folder):
    """Cable, its reach and their ratio by class."""
    from meshwork.plans.graph_queries import cable_length

    c = cable_length(spark, folder).withColumn("class", F.when(F.col("segments") > 3, "long").otherwise("short"))
    c = sinks.checkpointed(c.select("class", "cable", "segments", (F.col("cable") / F.col("segments")).alias("ratio")), "cables")
    found = c.groupBy("class").agg(F.count("*").alias("n"))
    for value in ("cable", "segments", "ratio"):
        found = A.with_quantiles(found, c, value, {f"median_{value}": 0.5}, "class")
    return rounded(found, 5)


@query()
def partner_test(spark, folder):
    """Distance of nodes to the mean of their partners against that to partners drawn anew, forty draws, in each scope."""
    e, n = V.fine_edges(spark, folder), V.fine_nodes(spark, folder)
    return rounded(S.partner_test(e, n, SCOPES, 40)[0])


@query()
def most_extreme_partners(spark, folder):
    """The twelve nodes whose distance to their partners is furthest from their own draws, in deviations."""
    e, n = V.fine_edges(spark, folder), V.fine_nodes(spark, folder)
    return rounded(S.partner_test(e, n, SCOPES, 40)[1].where("z is not null").orderBy(F.abs("z").desc(), "node").limit(12).select("node", "partner_distance", "null_mean", "null_sd", "z"))


@query()
def greedy_swaps(spark, folder):
    """The cost of the graph while nodes of a compartment exchange places wherever that shortens it, round by round."""
    e, n = V.fine_edges(spark, folder), V.fine_nodes(spark, folder).withColumn("movable", F.col("kind") != "P")
    return W.greedy_swaps(e, n.withColumn("group", F.coalesce("compartment", F.lit("unclassified"))), "group", 12, S.SEED)[1]


#: Scopes of the partner test, as conditions on nodes.
SCOPES = {"all": "true", "brain": "compartment = 'brain'", "vnc": "compartment = 'vnc'", "connective": "role != 'none'"}


@query("select superclass, node, round((degree - mean) / sd, 6) z from (select n.superclass, n.node, degree, avg(degree) over (partition by n.superclass) mean, stddev_samp(degree) over (partition by n.superclass) sd from nodes n join deg on deg.node = n.node) where sd > 0 order by abs((degree - mean) / sd) desc, node limit 12")
def most_extreme(spark, folder):
    """The twelve nodes whose degree is furthest from its class in deviations."""
    d = E.degrees(V.fine_edges(spark, folder), V.fine_nodes(spark, folder)).join(V.fine_nodes(spark, folder).select("node", "superclass"), "node")
    per = d.groupBy("superclass").agg(F.avg("degree").alias("mean"), F.stddev_samp("degree").alias("sd")).where("sd > 0")
    z = (F.col("degree") - F.col("mean")) / F.col("sd")
    return rounded(d.join(F.broadcast(per), "superclass").withColumn("z", z).orderBy(F.abs("z").desc(), "node").limit(12).select("superclass", "node", "z"))


@query("select role, count(*) nodes, count(*) filter (compartment = 'brain') brain, count(*) filter (compartment = 'vnc') vnc, round(avg(degree), 6) mean_degree, list_sort(list(distinct superclass)) members from nodes n join deg on deg.node = n.node group by 1")
def group_table(spark, folder):
    """A45's columns, of given groups: size, compartments, mean degree, sorted members."""
    n = V.fine_nodes(spark, folder).join(E.degrees(V.fine_edges(spark, folder), V.fine_nodes(spark, folder)), "node")
    return rounded(R.group_table(n, "role", "degree", "superclass"))


@query()
def community_table(spark, folder):
    """Communities of the region graph with the mean and sum of strength, compartments and members."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    atlas = R.atlas(e, n).select("region", "compartment").join(R.region_strength(e).select("region", "strength"), "region")
    parts = C.communities(R.region_graph(e)).withColumnRenamed("node", "region")
    return R.group_table(atlas.join(parts, "region"), "community", "strength", "region")


@query()
def betweenness_by_length(spark, folder):
    """Median betweenness of edges by quartile of length, on the coarse graph."""
    e = V.with_ends(V.coarse_edges(spark, folder), _coarse_nodes(spark, folder), ["x", "y", "z"]).withColumn("length", X.distance("src_", "dst_"))
    found = G.edge_betweenness(e, _coarse_nodes(spark, folder).select("node")).join(e.select("src", "dst", "length"), ["src", "dst"]).where("length is not null")
    binned = sinks.checkpointed(A.quantile_bins(sinks.checkpointed(found, "betweenness"), "length", 4).select((F.col("bin") + 1).alias("quartile"), "betweenness"), "quartiles")
    return A.with_quantiles(binned.groupBy("quartile").agg(F.count("*").alias("edges")), binned, "betweenness", {"median": 0.5}, "quartile")


# Flow


def _connective(spark, folder):
    """Coarse edges with length, micro, crossing and incident; the pairs of sets that flow goes between."""
    n = _coarse_nodes(spark, folder)
    e = V.with_ends(V.coarse_edges(spark, folder), n, ["x", "y", "z", "role", "compartment"]).withColumn("length", F.coalesce(X.distance("src_", "dst_"), F.lit(0.0)))
    e = sinks.checkpointed(A.with_micro(e).select("src", "dst", "length", "micro", "src_role", "dst_role", E.crossing().alias("crossing"), E.incident().alias("incident")), "connective")
    s, m, brain, vnc = F.col("superclass") == "sensory", F.col("superclass") == "motor", F.col("compartment") == "brain", F.col("compartment") == "vnc"
    sets = [("flow", s, m), ("flow_brain_to_vnc", s & brain, m & vnc), ("flow_vnc_to_brain", s & vnc, m & brain)]
    ends = None
    for name, sources, targets in sets:
        one = n.where(sources).select(F.lit(name).alias("metric"), "node", F.lit(True).alias("is_source")).unionByName(n.where(targets).select(F.lit(name).alias("metric"), "node", F.lit(False).alias("is_source")))
        ends = one if ends is None else ends.unionByName(one)
    return e, sinks.checkpointed(ends, "ends")


@query()
def flow_values(spark, folder):
    """Maximum flow between sensory and motor sets, of the whole graph, without crossing and without incident edges."""
    e, ends = _connective(spark, folder)
    gone = F.array(F.when(F.col("crossing"), F.lit("without crossing")), F.when(F.col("incident"), F.lit("without incident")))
    return flow.values_after(e, ends, e.select("src", "dst", F.explode(F.array_compact(gone)).alias("scenario")))


@query()
def connective_value(spark, folder):
    """Flow that is lost with the crossing edges against that with equally many, and equally long, random
    other edges, fifty draws each, and with the longest other edges of the same length."""
    e, ends = _connective(spark, folder)
    real = e.where("crossing").agg(F.count("*").alias("n"), F.sum("micro").alias("micro")).first()
    others = e.where("not incident").select("src", "dst", "micro")
    removed = None
    for family, cut, value in (("count", real["n"], None), ("cost", real["micro"] or 0, "micro")):
        one = S.removal_draws(others, 50, F.lit(cut), value, seed=S.SEED + len(family)).withColumn("scenario", F.concat(F.lit(family + "-"), "draw_id")).drop("draw_id")
        removed = one if removed is None else removed.unionByName(one)
    longest = A.take_until(A.running(others, "micro", -F.col("micro"), F.col("src"), F.col("dst")), f"{real['micro'] or 0}L").select("src", "dst", F.lit("longest").alias("scenario"))
    removed = removed.unionByName(e.where("crossing").select("src", "dst", F.lit("real").alias("scenario"))).unionByName(longest)
    flows = sinks.checkpointed(flow.values_after(e, ends, sinks.checkpointed(removed, "removed")), "flows")
    intact = flows.where("scenario = 'intact'").select("metric", F.col("flow").alias("intact"))
    lost = flows.join(F.broadcast(intact), "metric").select("metric", "scenario", (F.col("intact") - F.col("flow")).alias("lost"))
    null = lost.where("scenario like '%-%'").withColumn("family", F.substring_index("scenario", "-", 1))
    real = lost.where("scenario in ('real', 'longest')").groupBy("metric").agg(F.max(F.when(F.col("scenario") == "real", F.col("lost"))).alias("real"), F.max(F.when(F.col("scenario") == "longest", F.col("lost"))).alias("lost_with_longest"))
    found = null.join(real, "metric").groupBy("family", "metric", "real", "lost_with_longest").agg(F.count("*").alias("draws"), F.avg("lost").alias("null_mean"), F.stddev_samp("lost").alias("null_sd"), F.count_if(F.col("lost") >= F.col("real")).alias("above"))
    return rounded(found.select("family", "metric", "real", "lost_with_longest", "draws", "null_mean", "null_sd", (F.col("real") / F.nullif(F.col("null_mean"), F.lit(0.0))).alias("ratio"), ((1 + F.col("above")) / (1 + F.col("draws"))).alias("p")))


@query()
def connective_price(spark, folder):
    """Each connective node's crossing edges, their price, the flow lost without them, value and value a length."""
    e, ends = _connective(spark, folder)
    own = e.where("crossing").withColumn("scenario", F.when(F.col("src_role") != "none", F.col("src")).otherwise(F.col("dst")))
    removed = sinks.checkpointed(own.select("scenario", "src", "dst"), "removed")
    flows = sinks.checkpointed(flow.values_after(e, ends, removed), "flows")
    intact = flows.where("scenario = 'intact'").select("metric", F.col("flow").alias("intact"))
    lost = flows.where("scenario != 'intact'").join(F.broadcast(intact), "metric").groupBy("scenario").pivot("metric", ["flow", "flow_brain_to_vnc", "flow_vnc_to_brain"]).agg(F.first(F.col("intact") - F.col("flow")))
    names = {c: f"lost_{c}" for c in ("flow", "flow_brain_to_vnc", "flow_vnc_to_brain")}
    role = own.groupBy("scenario").agg(F.max(F.when(F.col("src_role") != "none", F.col("src_role")).otherwise(F.col("dst_role"))).alias("direction"), F.count("*").alias("edges"), (F.sum("micro") / 1_000_000).alias("price"))
    found = role.join(lost.withColumnsRenamed(names), "scenario").withColumn("value", F.when(F.col("direction") == "descending", F.col("lost_flow_brain_to_vnc")).otherwise(F.col("lost_flow_vnc_to_brain")))
    return rounded(found.withColumn("value_per_length", F.col("value") * 1000 / F.nullif(F.col("price"), F.lit(0.0))).withColumnRenamed("scenario", "node"))


# Nulls


@query()
def inner_placement(spark, folder):
    """Each region's inner wire against placements dealt anew among its members, twenty draws."""
    return rounded(S.inner_placement_null(V.edge_lengths(spark, folder), V.fine_nodes(spark, folder), "region", 20, least_edges=10), 4)


@query()
def enrichment(spark, folder):
    """Rich partners of connective nodes against partners drawn anew, a thousand draws."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    rich = sinks.checkpointed(E.rich_mask(e, n, 0.1), "rich")
    layers = sinks.checkpointed(E.layered(e, rich).select("layer", "hub", "rich"), "layers")
    side = F.when(F.col("layer").isin("brain-descending", "ascending-brain"), "brain").otherwise("vnc")
    partners = n.where("role = 'none' and compartment is not null").join(rich, "node").groupBy(F.col("compartment").alias("side")).agg(F.count("*").alias("eligible"), F.count_if("rich").alias("rich"))
    degrees = layers.groupBy("layer", "hub").agg(F.count("*").alias("degree")).withColumn("side", side).join(F.broadcast(partners), "side").select(F.col("hub").alias("node"), "layer", "degree", "rich", "eligible")
    whole = layers.agg(F.avg(F.col("rich").cast("int")).alias("real"))
    null = S.enrichment_null(degrees.where("degree <= eligible"), 1000)
    return rounded(S.summarized(null, "share", whole).select("real", "draws", "null_mean", "null_sd", "ratio", "p_upper"))


@query()
def rich_club_regime(spark, folder):
    """Rich-club densities of the coarse graph over their means in a hundred rewired graphs, whether they are
    above all of them (the regime), and the least degree k* from which one is."""
    e = V.coarse_edges(spark, folder).select("src", "dst", "weight")
    many = sinks.checkpointed(e.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100)))), "many")
    real = E.rich_club_curves(e.withColumn("draw", F.lit(0)), "draw").select("k", "nodes_above", F.col("phi").alias("real"))
    null = E.rich_club_curves(G.rewired(many, S.SEED, ("draw",)), "draw")  # rewiring keeps degrees, so the same ones occur
    per = null.groupBy("k").agg(F.avg("phi").alias("null_mean"), F.min("phi").alias("null_min"), F.max("phi").alias("null_max"), F.count("phi").alias("draws"))
    found = sinks.checkpointed(real.join(per, "k").where("real is not null").withColumn("regime", F.col("real") > F.col("null_max")), "regime")
    star = found.agg(F.min(F.when(F.col("regime"), F.col("k"))).alias("k_star"))  # one row
    over = lambda c: F.col(c) / F.nullif(F.col("null_mean"), F.lit(0.0))
    return rounded(found.join(F.broadcast(star)).select("k", "nodes_above", "real", "null_mean", "draws", over("real").alias("normalised"), over("null_min").alias("null_low"), over("null_max").alias("null_high"), "regime", "k_star"))


@query()
def layer_route_null(spark, folder):
    """Routes through connective nodes by role and rich fraction against those in fifty graphs whose four
    layers are rewired one by one; seven fractions, all draws in one set of rounds."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    tops = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.5]
    layers = sinks.checkpointed(e.withColumn("layer", E.layer()).where("layer is not null").select("src", "dst", "layer"), "layers")
    rich = sinks.checkpointed(E.rich_at(e, n, tops), "rich")
    routes = sinks.checkpointed(trades.route_nulls(layers, rich, tops, 50, S.SEED), "routes")
    real = routes.where("draw = 0").select("i", "role", F.col("routes").alias("real"))
    null = real.join(spark.range(1, 51).select(F.col("id").cast("int").alias("draw"))).join(routes, ["draw", "i", "role"], "left").withColumn("routes", F.coalesce("routes", F.lit(0)))  # a row a draw, fraction and role
    sums = null.groupBy("i", "role", "real").agg(F.count("*").alias("draws"), F.avg("routes").alias("null_mean"), F.stddev_samp("routes").alias("null_sd"), F.count_if(F.col("routes") >= F.col("real")).alias("above"))
    at = F.array(*[F.lit(t) for t in tops])
    z = F.when(F.col("null_sd") > 0, (F.col("real") - F.col("null_mean")) / F.col("null_sd"))
    return rounded(sums.select(at[F.col("i")].alias("top_fraction"), "role", "real", "draws", "null_mean", "null_sd", (F.col("real") / F.nullif(F.col("null_mean"), F.lit(0.0))).alias("ratio"), z.alias("z"), ((1 + F.col("above")) / (1 + F.col("draws"))).alias("p")))


@query()
def small_world(spark, folder):
    """Clustering and mean path length, plain and by wire, of the area graph against forty rewired and forty
    reweighted ones, with the ratios of ratios."""
    return rounded(G.small_world(_regions(spark, folder)[1], 40, S.SEED))


@query()
def graph_properties(spark, folder):
    """Structural properties of the coarse graph."""
    return rounded(G.properties(V.coarse_edges(spark, folder).select("src", "dst"), _coarse_nodes(spark, folder)))


@query()
def model_comparison(spark, folder):
    """Properties of the coarse graph against graphs drawn from two fitted models, two draws each."""
    e, n = V.coarse_edges(spark, folder).select("src", "dst", "weight"), _coarse_nodes(spark, folder)
    return rounded(M.compared(e, n, ["distance", "degree"], 2, S.SEED))


@query("select fraction, edges, round(wire, 4) wire, routes from (select f fraction, count(*) edges, sum(micro) / 1000000 wire from (select m.micro, f from mm m, (values (0.01::double), (0.02::double), (0.05::double)) v(f) where input_fraction >= f) group by 1) join (select f2, sum(i * o)::bigint routes from (select f2, hub, count(*) filter (layer in ('brain-descending', 'vnc-ascending')) i, count(*) filter (layer in ('descending-vnc', 'ascending-brain')) o from (select l.layer, case when l.layer in ('brain-descending', 'vnc-ascending') then dst else src end hub, f2 from lay0 l, (values (0.01::double), (0.02::double), (0.05::double)) w(f2) where l.layer is not null and input_fraction >= f2) group by 1, 2) group by 1) on f2 = fraction")
def threshold_report(spark, folder):
    """Edges, wire and routes of the graph at stricter input thresholds."""
    e = V.edge_lengths(spark, folder)
    many = e.withColumn("fraction", F.explode(F.array(F.lit(0.01), F.lit(0.02), F.lit(0.05)))).where("input_fraction >= fraction")
    sums = many.groupBy("fraction").agg(F.count("*").alias("edges"), E.wire().alias("wire"))
    hubs = many.withColumn("layer", E.layer()).where("layer is not null").withColumn("into", F.col("layer").isin("brain-descending", "vnc-ascending"))
    per = hubs.groupBy("fraction", F.when(F.col("into"), F.col("dst")).otherwise(F.col("src")).alias("hub")).agg((F.count_if("into") * F.count_if(~F.col("into"))).alias("routes"))
    return sums.join(per.groupBy("fraction").agg(F.sum("routes").alias("routes")), "fraction").withColumn("wire", F.round("wire", 4))


@query()
def threshold_verdicts(spark, folder):
    """Whether placement, routes and hubs hold at three input thresholds, forty draws of each null."""
    return rounded(robustness.threshold_verdicts(V.edge_lengths(spark, folder), V.fine_nodes(spark, folder), [0.01, 0.02, 0.05], 40, 40))


@query("select 'edges' what, count(*)::double a, round(sum(micro) / 1000000, 4) b from mm union all select 'rich', count(*) filter (rich), 0 from rich")
def concentration(spark, folder):
    """C3's and C6's first lines in one table: edges with their wire, rich nodes."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    one = e.agg(F.lit("edges").alias("what"), F.count("*").cast("double").alias("a"), F.round(E.wire(), 4).alias("b"))
    two = E.rich_mask(e, n, 0.1).agg(F.lit("rich").alias("what"), F.count_if("rich").cast("double").alias("a"), F.lit(0.0).alias("b"))
    return one.unionByName(two)
