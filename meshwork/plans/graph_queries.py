"""Queries of graph building, lengths, regions, layers and concentration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import expressions as X
from meshwork.operators import build, edges as E, regions
from meshwork.operators import analytic as A
from meshwork.plans.oracle_views import BASE
from meshwork.sources import graph_views as V
from meshwork.sources import sinks
from meshwork.sources.sinks import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c, kind in frame.dtypes if kind == "double"})


SPAN = "count(*) edges, round(sum(micro) / 1000000, 6) total, round(sum(micro) / 1000000 / count(*), 6) mean, round(quantile_cont(length, 0.5), 6) median, round(quantile_cont(length, 0.9), 6) p90, round(quantile_cont(length, 0.99), 6) p99, round(max(length), 6) longest"


@query(f"select edge_group, {SPAN} from grouped group by 1")
def length_by_group(spark, folder):
    """Lengths by overlapping compartment group."""
    return rounded(E.length_summary(E.edge_groups(V.edge_lengths(spark, folder)), "edge_group"))


@query("""select side, count(*) n from (select case when soma in ('L','R','M') then soma when root in ('L','R') then root else 'unknown' end side from
 (select case c_nationkey % 4 when 0 then 'L' when 1 then 'R' when 2 then 'M' end soma, case c_custkey % 3 when 0 then 'L' when 1 then 'R' end root from customer)) group by 1""")
def body_sides(spark, folder):
    """P1, A40."""
    k = F.col("c_nationkey") % 4
    soma = F.when(k == 0, "L").when(k == 1, "R").when(k == 2, "M")
    root = F.when(F.col("c_custkey") % 3 == 0, "L").when(F.col("c_custkey") % 3 == 1, "R")
    return V.read(spark, folder, "customer").select(soma.alias("soma"), root.alias("root")).groupBy(X.side("soma", "root").alias("side")).agg(F.count("*").alias("n"))


@query("select vec_id, round(embedding[1]::double * 0.008, 9) x, round(embedding[2]::double * 0.008, 9) y, round(embedding[3]::double * 0.008, 9) z, round(vec_id * 8 / 1000, 6) um from embeddings")
def soma_columns(spark, folder):
    """P3, P4."""
    e = V.read(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("loc"))
    return e.select("vec_id", *[F.round(c, 9).alias(k) for c, k in zip(X.point("loc"), "xyz", strict=True)], F.round(X.voxels_to_micrometers(F.col("vec_id")), 6).alias("um"))


@query("select src, dst, weight, n_connections from craw")
def aggregate_edges(spark, folder):
    """P2, J1, A1."""
    return V.coarse_edges(spark, folder, None).select("src", "dst", "weight", "n_connections")


@query("select src, dst, weight, n_connections from fraw")
def combine_edges(spark, folder):
    """Partial aggregates of even and odd sources, merged."""
    c = V.connections(spark, folder).select(F.col("pre").alias("src"), F.col("post").alias("dst"), "weight")
    even = F.pmod(F.hash("src"), F.lit(2)) == 0
    return build.combine_edges(build.aggregate_edges(c.where(even)), build.aggregate_edges(c.where(~even)))


@query("select src, dst, weight, round(input_fraction, 9) input_fraction from cedges")
def input_threshold(spark, folder):
    """A5, W1, S7."""
    return V.coarse_edges(spark, folder).select("src", "dst", "weight", F.round("input_fraction", 9).alias("input_fraction"))


@query("select fraction, count(*) edges, sum(weight)::bigint weight from ffrac, (values (0.005::double), (0.01::double), (0.02::double), (0.05::double)) t(fraction) where src <> dst and input_fraction >= fraction group by 1")
def threshold_sweep(spark, folder):
    """N26's sweep."""
    raw = V.connections(spark, folder).select(F.col("pre").alias("src"), F.col("post").alias("dst"), "weight")
    return build.threshold_sweep(build.aggregate_edges(raw), [0.005, 0.01, 0.02, 0.05])


@query("""select cell_type, superclass, members, round(share, 6) share from (select cell_type, superclass, n members, n / sum(n) over (partition by cell_type) share,
 row_number() over (partition by cell_type order by n desc, superclass) k from (select cell_type, coalesce(superclass, 'unannotated') superclass, count(*) n from nodes group by 1, 2)) where k = 1""")
def majority_superclass(spark, folder):
    """A6, W2."""
    return rounded(build.majority_superclass(V.bodies(spark, folder)))


POSITION = """(select node, count(*) n_bodies, count(x) n_placed, avg(x) ax, avg(y) ay, avg(z) az, sum(x2 * w) / sum(w) wx, sum(y2 * w) / sum(w) wy, sum(z2 * w) / sum(w) wz from (select *, 1 + key % 7 w from cb) group by 1)"""
SPREAD = """(select node, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) spread from (select *, avg(x) over p mx, avg(y) over p my, avg(z) over p mz from cb window p as (partition by node)) group by 1)"""


@query(f"""select p.node, n_bodies, n_placed, case when n_placed / n_bodies >= 0.5 then 'body' else 'weighted' end position_source, case when n_placed / n_bodies >= 0.5 then round(spread, 6) end spread,
 round(case when n_placed / n_bodies >= 0.5 then ax else wx end, 6) x, round(case when n_placed / n_bodies >= 0.5 then ay else wy end, 6) y, round(case when n_placed / n_bodies >= 0.5 then az else wz end, 6) z
 from {POSITION} p join {SPREAD} s on s.node = p.node""")
def node_positions(spark, folder):
    """A3, J2, J3."""
    return rounded(build.node_positions(V.coarse_bodies(spark, folder).withColumn("weight", 1 + F.col("key") % 7)))


@query("""select node, coalesce(sum(w) filter (compartment = 'brain'), 0)::bigint brain, coalesce(sum(w) filter (compartment = 'vnc'), 0)::bigint vnc,
 round(coalesce(sum(w) filter (compartment = 'brain'), 0) / nullif(sum(w) filter (compartment is not null), 0), 6) brain_share,
 case when 2 * coalesce(sum(w) filter (compartment = 'brain'), 0) > sum(w) filter (compartment is not null) then 'brain' when 2 * coalesce(sum(w) filter (compartment = 'brain'), 0) < sum(w) filter (compartment is not null) then 'vnc' end compartment
 from (select *, 1 + key % 7 w from cb) group by 1""")
def node_compartments(spark, folder):
    """A4."""
    b = V.coarse_bodies(spark, folder)
    counts = b.groupBy("node", "compartment").agg(F.sum(1 + F.col("key") % 7).alias("n"))
    return rounded(build.node_compartments(counts, b))


@query(f"""select p.node, cell_type, side, role, superclass, n_bodies, case when n_placed / n_bodies >= 0.5 then 'body' else 'weighted' end position_source, compartment from {POSITION} p join
 (select node, min(cell_type) cell_type, min(side) side, max((case role when 'none' then 0 else 1 end, role)) r, r[2] role from cb group by 1) r on r.node = p.node join
 (select node, superclass from (select node, superclass, row_number() over (partition by node order by count(*) desc, superclass) k from cb group by 1, 2) where k = 1) s on s.node = p.node join
 (select node, case when 2 * coalesce(sum(w) filter (compartment = 'brain'), 0) > sum(w) filter (compartment is not null) then 'brain' when 2 * coalesce(sum(w) filter (compartment = 'brain'), 0) < sum(w) filter (compartment is not null) then 'vnc' end compartment
 from (select *, 1 + key % 7 w from cb) group by 1) q on q.node = p.node""".replace("max((case role when 'none' then 0 else 1 end, role)) r, r[2] role", "arg_max(role, (case role when 'none' then 0 else 1 end)::varchar || role) role"))
def summarize_nodes(spark, folder):
    """C1, J4, P8."""
    n = build.summarize_nodes(V.coarse_bodies(spark, folder).withColumn("weight", 1 + F.col("key") % 7))
    return n.select("node", "cell_type", "side", "role", "superclass", "n_bodies", "position_source", "compartment")


@query("select role, list_sort(list(distinct cell_type)) types from nodes where role <> 'none' group by 1")
def connective_sets(spark, folder):
    """A7, S8."""
    return build.connective_sets(V.bodies(spark, folder))


@query("select superclass, count(*) bodies, count(x) placed, count(distinct cell_type) types, count(distinct case when x is not null then cell_type end) placed_types from cb group by 1")
def coverage(spark, folder):
    """A8, S2."""
    return build.coverage(V.coarse_bodies(spark, folder))


@query("select count(*) filter (a.body is null) unlabelled_pre, count(*) filter (c.body is null) unlabelled_post, count(*) connections from conn left join (select * from label where body like 'P%') a on a.body = pre left join label c on c.body = post")
def unlabelled_ends(spark, folder):
    """J1's completeness check, against labels of parts only on one side."""
    labels = V.bodies(spark, folder).select("body")
    c = V.connections(spark, folder)
    a = c.join(labels.where("body like 'P%'").select(F.col("body").alias("pre"), F.lit(1).alias("a")), "pre", "left").join(labels.select(F.col("body").alias("post"), F.lit(1).alias("b")), "post", "left")
    return a.agg(F.count_if(F.col("a").isNull()).alias("unlabelled_pre"), F.count_if(F.col("b").isNull()).alias("unlabelled_post"), F.count("*").alias("connections"))


@query("select round(max(x) - min(x), 6) span_x, round(max(y) - min(y), 6) span_y, round(max(z) - min(z), 6) span_z, (max(x) - min(x) between 100 and 2000) and (max(y) - min(y) between 100 and 2000) and (max(z) - min(z) between 100 and 2000) and greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) >= 700 plausible from nodes")
def physical_extent(spark, folder):
    """P5."""
    return rounded(build.extent(V.fine_nodes(spark, folder)))


@query("""select 'union' op, count(*) n from (select src node from edges union select dst from edges) union all select 'except', count(*) from (select node from nodes except (select src from edges union select dst from edges))
 union all select 'intersect', count(*) from (select src from edges intersect select dst from edges)
 union all select 'symmetric', count(*) from (select a.n from (select distinct src n from edges) a full join (select distinct dst n from edges) c on a.n = c.n where a.n is null or c.n is null)""")
def set_operations(spark, folder):
    """U2 to U5, J17."""
    e, n = V.fine_edges(spark, folder), V.fine_nodes(spark, folder).select("node")
    src, dst = e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node"))
    a, b = src.distinct().withColumn("a", F.lit(1)), dst.distinct().withColumn("b", F.lit(1))
    ops = {"union": src.union(dst).distinct(), "except": n.subtract(src.union(dst)), "intersect": src.intersect(dst), "symmetric": a.join(b, "node", "full_outer").where("a is null or b is null")}
    out = None
    for name, frame in ops.items():
        one = frame.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select round(sum(micro) / 1000000, 4) wire, round(sum(round(length * weight * 1000000)::hugeint)::double / 1000000, 3) weighted_wire from mm")
def wiring_cost(spark, folder):
    """A9."""
    return E.cost(V.edge_lengths(spark, folder)).select(F.round("wire", 4).alias("wire"), F.round("weighted_wire", 3).alias("weighted_wire"))


@query("""select g.edge_group, edges, round(edges / (select count(*) from mm), 6) edge_share, round(w / (select sum(micro) from mm), 6) wire_share, round(w / 1000000 / edges, 6) mean_length
 from (select edge_group, count(*) edges, sum(micro) w from grouped group by 1) g""")
def cost_shares(spark, folder):
    """A19."""
    return rounded(E.cost_shares(V.edge_lengths(spark, folder)))


@query("select node, compartment, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 6) to_centroid from (select *, avg(x) over p mx, avg(y) over p my, avg(z) over p mz from nodes window p as (partition by compartment))")
def distance_to_centroid(spark, folder):
    """P7."""
    return rounded(E.distance_to_centroid(V.fine_nodes(spark, folder), "compartment"))


@query("""select floor(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) / 20)::bigint bin,
 case when coalesce(a.compartment, 'none') = coalesce(c.compartment, 'none') then coalesce(a.compartment, 'none') else 'cross' end category, count(*) pairs from nodes a join nodes c on a.node <> c.node group by 1, 2""")
def pair_histogram(spark, folder):
    """J8, A16."""
    return regions.pair_histogram(V.fine_nodes(spark, folder), 20.0)


@query("""select floor(length / 20)::bigint bin, case when coalesce(src_compartment, 'none') = coalesce(dst_compartment, 'none') then coalesce(src_compartment, 'none') else 'cross' end category, count(*) edges from mm group by 1, 2""")
def edge_histogram(spark, folder):
    """A16's edges."""
    return regions.edge_histogram(V.edge_lengths(spark, folder), 20.0)


CURVE = """(select p.bin * 20.0::double bin_start, pairs, coalesce(edges, 0) edges, coalesce(edges, 0) / pairs probability from (select floor(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) / 20)::bigint bin, count(*) pairs
 from nodes a join nodes c on a.node <> c.node group by 1) p left join (select floor(length / 20)::bigint bin, count(*) edges from mm group by 1) e on e.bin = p.bin where pairs >= 1000)"""


def _curve(spark, folder):
    n, e = V.fine_nodes(spark, folder), V.edge_lengths(spark, folder)
    return regions.connection_probability(regions.pair_histogram(n, 20.0), regions.edge_histogram(e, 20.0), 20.0, 1000)


@query(f"select bin_start, pairs, edges, round(probability, 9) probability from {CURVE}")
def connection_probability(spark, folder):
    """A17, X4."""
    return rounded(_curve(spark, folder), 9)


@query(f"select arg_min(bin_start, (probability, bin_start)) least_bin, round(min(probability), 9) least, max(bin_start) last_bin, round(arg_max(probability, bin_start), 9) last from {CURVE}")
def probability_minima(spark, folder):
    """A17's minima."""
    return rounded(regions.probability_minima(_curve(spark, folder)), 9)


NEAR = """(select node, r.region, sqrt((n.x - r.x) * (n.x - r.x) + (n.y - r.y) * (n.y - r.y) + (n.z - r.z) * (n.z - r.z)) d from nodes n, (select region, avg(x) x, avg(y) y, avg(z) z from pos group by 1) r)"""


@query(f"select node, arg_min(region, d) region, round(min(d), 6) region_distance from {NEAR} group by 1")
def nearest_region(spark, folder):
    """J9."""
    surface = regions.region_centroids(V.positions(spark, folder))
    return rounded(regions.nearest_region(V.fine_nodes(spark, folder), surface))


@query("""select m.region, members, m.compartment, edges_incident, edges_internal, round(w / 2 / 1000000, 5) wire, round(w / 2 / (select sum(micro) from mm), 6) wire_share from
 (select region, count(*) members, case when avg((coalesce(compartment, '?') = 'vnc')::int) >= 0.5 then 'vnc' else 'brain' end compartment from nodes group by 1) m left join
 (select region, count(*) edges_incident, (sum(i) / 2)::bigint edges_internal, sum(micro) w from (select src_region region, micro, (src_region = dst_region)::int i from mm union all select dst_region, micro, (src_region = dst_region)::int from mm) group by 1) s on s.region = m.region""")
def region_atlas(spark, folder):
    """A27, C2, T1."""
    found = regions.atlas(V.edge_lengths(spark, folder), V.fine_nodes(spark, folder))
    return found.withColumns({"wire": F.round("wire", 5), "wire_share": F.round("wire_share", 6)})


@query("select least(src_region, dst_region) one, greatest(src_region, dst_region) two, round(sum(micro) / 1000000, 6) wire, count(*) edges from mm where src_region <> dst_region group by 1, 2 order by sum(micro) desc, 1, 2 limit 40")
def ranked_region_pairs(spark, folder):
    """A28, A29, T2."""
    return rounded(regions.ranked_pairs(V.edge_lengths(spark, folder)))


@query("""select region, round(sum(case when region <> o then micro else 0 end) / 1000000, 3) strength, round(sum(case when region = o then micro else 0 end) / 1000000, 3) internal, count(distinct o) filter (region <> o) partners,
 round(sum(case when region <> o then micro else 0 end) / (select 2 * sum(micro) from mm where src_region <> dst_region), 6) strength_share
 from (select src_region region, dst_region o, micro from mm union all select dst_region, src_region, micro from mm where src_region <> dst_region) group by 1""")
def region_strength(spark, folder):
    """A30, J15's sums."""
    s = regions.region_strength(V.edge_lengths(spark, folder))
    return s.withColumns({"strength": F.round("strength", 3), "internal": F.round("internal", 3), "strength_share": F.round("strength_share", 6)})


@query("select count(*) edges, round(sum(micro) / 1000000, 5) wire, count(*) filter (src_region = dst_region) edges_inside, round(sum(micro) filter (src_region = dst_region) / 1000000, 5) wire_inside from mm")
def atlas_totals(spark, folder):
    """A31."""
    return rounded(regions.atlas_totals(V.edge_lengths(spark, folder)), 5)


@query("""select a.region, round(a.w / 2000000, 4) here, round(s.w / 1000000, 4) there from (select region, sum(micro) w from (select src_region region, micro from mm union all select dst_region, micro from mm) group by 1) a
 full join (select region, sum(w) w from (select src_region region, micro * case when src_region = dst_region then 1 else 0.5 end w from mm where src_region <> 3 or dst_region <> 3 union all select dst_region, micro * 0.5 from mm where src_region <> dst_region) group by 1) s on s.region = a.region
 where a.region is null or s.region is null or abs(a.w / 2 - s.w) > 1e-6 * greatest(a.w / 2, s.w)""")
def atlas_agreement(spark, folder):
    """The atlas' wire against internal + strength / 2 of a saved table of every region, which lacks the inner edges of one;
    that region alone is reported."""
    e = V.edge_lengths(spark, folder)
    atlas = regions.atlas(e, V.fine_nodes(spark, folder)).where("wire is not null")
    strength = regions.region_strength(e.where("src_region != 3 or dst_region != 3")).select("region", (F.col("internal") + F.col("strength") / 2).alias("wire"))
    at = f"{sinks.shared_folder(spark)}/strength-{uuid.uuid4().hex}"
    sinks.write_parquet(strength, at)
    return rounded(regions.agreement(atlas, spark.read.parquet(at), "region", "wire"), 4)


@query("""select region, count(*) types, round(quantile_cont(d, 0.5), 6) median_distance from (select node, arg_min(r, struct_pack(d := d, r := r)) region, min(d) d from
 (select node, p.region r, sqrt((n.x2 - p.x) * (n.x2 - p.x) + (n.y2 - p.y) * (n.y2 - p.y) + (n.z2 - p.z) * (n.z2 - p.z)) d from nodes n, pos p) group by 1) group by 1""")
def region_surfaces(spark, folder):
    """Nodes whose second place is nearest to a region's surface points, and their median distance to it."""
    points = V.fine_nodes(spark, folder).where("x2 is not null").select("node", *[F.col(f"{k}2").alias(k) for k in "xyz"])
    found = checkpointed(regions.nearest_region(points, V.positions(spark, folder).select("region", "x", "y", "z")).select("region", "region_distance"), "assigned")
    sums = found.groupBy("region").agg(F.count("*").alias("types"))
    return rounded(A.with_quantiles(sums, found, "region_distance", {"median_distance": 0.5}, "region"))


SIDED = """sided as (select case when region >= 8 then region::varchar when region = 7 then side || '7(' || side || ')' else region || '(' || side || ')' end as name, w from (select src_region region, src_side side, micro / 2 w from mm union all select dst_region, dst_side, micro / 2 from mm)),
 named as (select name, nullif(regexp_extract(name, '^(.*)\\(([LR])\\)$', 1), '') stem, nullif(regexp_extract(name, '^(.*)\\(([LR])\\)$', 2), '') side, sum(w) / 1000000 w from sided group by 1),
 placed as (select *, case when stem is null then 'midline' when count(*) over (partition by stem) = 2 then 'paired' else 'unpaired' end kind from named)"""


def _sided(spark, folder):
    """(name, stem, side, value): wire by region and side; two regions have no sides, one has other names on either."""
    e = V.edge_lengths(spark, folder, extra=("side", "cell_type"))
    half = e.select(F.explode(F.array(F.struct(F.col("src_region").alias("region"), F.col("src_side").alias("side")), F.struct(F.col("dst_region").alias("region"), F.col("dst_side").alias("side")))).alias("a"), "length").select("a.*", "length")
    name = F.when(F.col("region") >= 8, F.col("region").cast("string")).when(F.col("region") == 7, F.concat("side", F.lit("7("), "side", F.lit(")"))).otherwise(F.concat(F.col("region").cast("string"), F.lit("("), "side", F.lit(")")))
    sums = half.groupBy("region", "side").agg(F.sum(V.micro(F.col("length"))).alias("micro"))  # before they are named: a row each, not an edge's
    wires = sums.groupBy(name.alias("name")).agg((F.sum("micro") / 1_000_000 / 2).alias("value"))
    stem, side = X.split_side(F.col("name"))
    return wires.withColumns({"stem": stem, "side": side})


@query(f", {SIDED} select kind, count(*) regions, round(sum(w), 4) wire, round(sum(w) / (select sum(w) from placed), 6) wire_share from placed group by 1")
def symmetry_budget(spark, folder):
    """Wire of the regions that have a sibling, of those without sides, and of sides without a sibling."""
    sided = checkpointed(_sided(spark, folder), "sided")
    return regions.budgets(sided).withColumns({"wire": F.round("wire", 4), "wire_share": F.round("wire_share", 6)})


@query(f""", {SIDED} select stem, round(l, 4) left_wire, round(r, 4) right_wire, round(ln(l / r), 6) log_ratio from (select stem, max(w) filter (side = 'L') l, max(w) filter (side = 'R') r from placed where kind = 'paired' group by 1)""")
def symmetry_pairs(spark, folder):
    """Wire of both sides of each region and the logarithm of their ratio."""
    pairs = regions.sibling_pairs(_sided(spark, folder).where("stem is not null")).where("left_value is not null and right_value is not null")
    return rounded(pairs.select("stem", F.round("left_value", 4).alias("left_wire"), F.round("right_value", 4).alias("right_wire"), F.ln(F.col("left_value") / F.col("right_value")).alias("log_ratio")))


@query("select count(*) edges, round(avg((src_side <> dst_side)::int), 6) other_side_share, round(avg((src_cell_type = dst_cell_type)::int), 6) same_type_share from mm where length >= 300 and src_compartment = dst_compartment")
def long_range_edges(spark, folder):
    """A18."""
    return rounded(E.long_range(V.edge_lengths(spark, folder, extra=("side", "cell_type")), 300.0))


@query("select floor(x / 100)::bigint gx, floor(y / 100)::bigint gy, floor(z / 100)::bigint gz, count(*) points, round(avg(x), 6) x, round(avg(y), 6) y, round(avg(z), 6) z from pos group by 1, 2, 3")
def grid_simplified(spark, folder):
    """A41."""
    return rounded(regions.grid_simplified(V.positions(spark, folder), 100.0))


@query("select least(39, floor((length - lo) / (hi - lo) * 40))::bigint bin, count(*) n from mm, (select min(length) lo, max(length) hi from mm) group by 1")
def length_histogram(spark, folder):
    """A42."""
    return regions.equal_width_histogram(V.edge_lengths(spark, folder), "length")


@query("select node, round_even((x - lo) / (hi - lo) * 65535, 0)::int q from nodes, (select min(x) lo, max(x) hi from nodes)")
def quantized_positions(spark, folder):
    """P9, S16's values."""
    n = V.fine_nodes(spark, folder)
    span = n.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return n.join(F.broadcast(span)).select("node", X.quantize(F.col("x"), F.col("lo"), F.col("hi")).alias("q"))


@query("select node, round(0.6 * x + 0.8 * z, 6) u, round(-(1.0 * y), 6) v from nodes")
def rotated_view(spark, folder):
    """P14."""
    return rounded(regions.rotated(V.fine_nodes(spark, folder), [[0.6, 0.0, 0.8], [0.0, 1.0, 0.0]]))


@query("""select 'in_brain' mask, count(*) filter (role = 'none' and compartment = 'brain') n from nodes union all select 'in_vnc', count(*) filter (role = 'none' and compartment = 'vnc') from nodes
 union all select 'descending', count(*) filter (role = 'descending') from nodes union all select 'ascending', count(*) filter (role = 'ascending') from nodes union all select 'connective', count(*) filter (role <> 'none') from nodes""")
def node_masks(spark, folder):
    """P15, P22."""
    masks = ["in_brain", "in_vnc", "descending", "ascending", "connective"]
    sets = E.node_sets(V.fine_nodes(spark, folder)).agg(*[F.count_if(F.col(m)).alias(m) for m in masks])
    return sets.select(F.expr(f"stack({len(masks)}, " + ", ".join(f"'{m}', {m}" for m in masks) + ") as (mask, n)"))


@query("select superclass || '-' || compartment as set, count(*) members, min(node) first_node from nodes where superclass in ('sensory', 'motor') and compartment is not null group by 1")
def sensory_motor_sets(spark, folder):
    """P16, P25."""
    return E.sensory_motor(V.fine_nodes(spark, folder))


@query("select layer, count(*) edges, round(avg(rich::int), 6) rich_share from lay join rich on rich.node = partner group by 1")
def layer_rich_share(spark, folder):
    """P17, A12, A13, N23."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    return rounded(E.rich_edge_fraction(e, E.rich_mask(e, n, 0.1)))


@query("""select case when r like '%descending%' then 'descending' else 'ascending' end role, count(*) hubs, sum(i * o)::bigint routes from (select hub, min(layer) r, count(*) filter (layer in ('brain-descending', 'vnc-ascending')) i,
 count(*) filter (layer in ('descending-vnc', 'ascending-brain')) o from lay join rich on rich.node = partner where rich group by 1) group by 1""".replace("min(layer) r", "min(case when layer like '%descending%' then 'descending' else 'ascending' end) r"))
def route_counts(spark, folder):
    """J13, A14."""
    e, n = V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)
    return E.route_counts(e, E.rich_mask(e, n, 0.1))


@query("""select top_fraction, sum(i * o)::bigint routes from (select top_fraction, hub, count(*) filter (layer in ('brain-descending', 'vnc-ascending')) i, count(*) filter (layer in ('descending-vnc', 'ascending-brain')) o
 from lay join rich on rich.node = partner join (select side, unnest([0.01::double, 0.02::double, 0.05::double, 0.1::double, 0.15::double, 0.2::double, 0.5::double]) top_fraction, unnest(quantile_cont(richness, [0.99, 0.98, 0.95, 0.9, 0.85, 0.8, 0.5])) cut from rich0 where member group by 1) q on q.side = rich.side where member and richness >= cut group by 1, 2) group by 1""")
def route_threshold_curve(spark, folder):
    """N24."""
    return E.route_threshold_curve(V.edge_lengths(spark, folder), V.fine_nodes(spark, folder), [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.5])


@query("""select k, na nodes_above, ea edges_above, case when na >= 2 then round(ea / (na * (na - 1)), 9) end phi from (select k, (select count(*) from deg where degree > k) na, (select count(*) from (select least(a.degree, c.degree) d from edges join deg a on a.node = src join deg c on c.node = dst) where d > k) ea
 from (select unnest(range(0, (select max(degree) + 1 from deg))) k))""")
def rich_club_coefficient(spark, folder):
    """A15, W4."""
    return rounded(E.rich_club(V.fine_edges(spark, folder), V.fine_nodes(spark, folder)), 9).withColumns({"nodes_above": F.col("nodes_above").cast("long"), "edges_above": F.col("edges_above").cast("long")})


@query("select crossing, count(*) edges, count(*) filter (src_role <> 'none' or dst_role <> 'none') incident from crossed group by 1")
def neck_crossing(spark, folder):
    """P18, P19."""
    return V.edge_lengths(spark, folder).groupBy(E.crossing().alias("crossing")).agg(F.count("*").alias("edges"), F.count_if(E.incident()).alias("incident"))


@query("select count(*) edges, sum(weight)::bigint weight from crossed where not crossing")
def graph_without_crossing(spark, folder):
    """P21, J10."""
    e = V.edge_lengths(spark, folder)
    return E.without_edges(e, e.where(E.crossing())).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query("select node, out_degree, in_degree, degree from deg")
def node_degrees(spark, folder):
    """A10."""
    return E.degrees(V.fine_edges(spark, folder), V.fine_nodes(spark, folder)).select("node", *[F.col(c).cast("long").alias(c) for c in ("out_degree", "in_degree", "degree")])


@query("select n.node, coalesce(d, 0) degree, round(coalesce(w, 0) / 1000000, 6) wire from nodes n left join (select node, count(*) d, sum(micro) w from en group by 1) e on e.node = n.node")
def degree_and_wire(spark, folder):
    """A11."""
    return rounded(E.degree_and_wire(V.edge_lengths(spark, folder), V.fine_nodes(spark, folder)))


@query("""select superclass, count(*) edges, round(sum(micro) / 1000000, 3) wire, round(sum(micro) / (select sum(micro) from mm), 6) wire_share, round(sum(micro) / 1000000 / count(*), 6) mean, round(quantile_cont(length, 0.5), 6) median
 from (select src_superclass superclass, micro, length from mm union all select dst_superclass, micro, length from mm where src_superclass <> dst_superclass) group by 1""")
def class_ownership(spark, folder):
    """A21, P20."""
    o = E.ownership(V.edge_lengths(spark, folder))
    return rounded(o.withColumn("wire", F.round("wire", 3)))


@query("select case when src_role <> 'none' then src else dst end node, count(*) crossing_edges, round(sum(micro) / 1000000, 6) price, round(sum(micro) / 1000000 / count(*) + 1e-9, 6) mean_length from crossed where crossing group by 1")
def crossing_price(spark, folder):
    """A36, A37's price, A38, T6."""
    found = E.crossing_edges_by_node(V.edge_lengths(spark, folder))
    return rounded(found.withColumn("mean_length", F.col("mean_length") + 1e-9))  # halves of a millionth go up in SQL too


@query("""select n.node, round(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)), 6) partner_distance from nodes n left join
 (select en.node, avg(o.x) px, avg(o.y) py, avg(o.z) pz from en join nodes o on o.node = other group by 1) p on p.node = n.node""")
def partner_distance(spark, folder):
    """A33."""
    return rounded(E.partner_distance(V.fine_edges(spark, folder), V.fine_nodes(spark, folder)))


@query("select role, count(*) filter (compartment = 'brain') brain, count(*) filter (compartment = 'vnc') vnc, count(*) filter (compartment is null) unclassified from nodes group by 1")
def role_by_compartment(spark, folder):
    """A39, P22."""
    n = V.fine_nodes(spark, folder).withColumn("compartment", F.coalesce("compartment", F.lit("unclassified")))
    return E.crosstab(n, "role", "compartment", ["brain", "vnc", "unclassified"])


@query("select count(*) edges, count(r.src) returned, round(count(r.src) / count(*), 6) reciprocity from cedges e left join cedges r on r.src = e.dst and r.dst = e.src")
def reciprocity(spark, folder):
    """J11, G10."""
    return rounded(E.reciprocity(V.coarse_edges(spark, folder)))


@query("""select stem, any_value(v) filter (side = 'L') left_value, any_value(v) filter (side = 'R') right_value from (select cell_type stem, side, count(*) v from nodes group by 1, 2) group by 1""")
def sibling_pairs(spark, folder):
    """Sides of names like S3(L)."""
    names = V.bodies(spark, folder).groupBy(F.concat("cell_type", F.lit("("), "side", F.lit(")")).alias("name")).agg(F.count("*").alias("value"))
    stem, side = X.split_side(F.col("name"))
    return regions.sibling_pairs(names.withColumns({"stem": stem, "side": side}))


@query("""select stem, round(ln(l / r), 6) log_ratio, l + r total from (select stem, any_value(v) filter (side = 'L') l, any_value(v) filter (side = 'R') r from (select cell_type stem, side, count(*) v from nodes group by 1, 2) group by 1) where l is not null and r is not null""")
def pair_asymmetry(spark, folder):
    """A32, P12."""
    pairs = sibling_pairs(spark, folder).where("left_value is not null and right_value is not null")
    return rounded(pairs.select("stem", F.ln(F.col("left_value") / F.col("right_value")).alias("log_ratio"), (F.col("left_value") + F.col("right_value")).alias("total")))


@query("""select conv_id, round(sum(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z))) * 0.008, 6) cable, count(*) segments from (select conv_id, turn, p.* from conversations join pos p on p.vec_id = (conv_id * 7 + turn) % (select count(*) from embeddings)) a
 join (select conv_id cc, turn tt, p.* from conversations join pos p on p.vec_id = (conv_id * 7 + turn) % (select count(*) from embeddings)) c on cc = conv_id and tt = turn - 1 group by 1""")
def cable_length(spark, folder):
    """Turns as a skeleton whose link is the turn before."""
    pos = V.positions(spark, folder)
    n = pos.agg(F.count("*").alias("n_vec"))
    rows = V.read(spark, folder, "conversations").select("conv_id", "turn").join(F.broadcast(n)).withColumn("vec_id", F.expr("(conv_id * 7 + turn) % n_vec")).join(pos, "vec_id")
    a = rows.select("conv_id", "turn", *[F.col(k).alias(f"a_{k}") for k in "xyz"])
    b = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), *[F.col(k).alias(f"b_{k}") for k in "xyz"])
    found = a.join(b, ["conv_id", "turn"]).withColumn("segment", X.distance("a_", "b_"))
    return rounded(found.groupBy("conv_id").agg((F.sum("segment") * 0.008).alias("cable"), F.count("*").alias("segments")))
