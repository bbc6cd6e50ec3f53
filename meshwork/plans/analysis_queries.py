"""Queries of order, sampling, nulls, statistics, graph search and link models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import expressions as X
from meshwork.operators import analytic as A
from meshwork.operators import build
from meshwork.operators import communities as C
from meshwork.operators import edges as E
from meshwork.operators import graph as G
from meshwork.operators import link_model as M
from meshwork.operators import regions as R
from meshwork.operators import sampling as S
from meshwork.operators import stats as T
from meshwork.plans.graph_queries import rounded
from meshwork.plans.oracle_views import BASE, draw
from meshwork.sources import graph_views as V
from meshwork.sources.sinks import checkpointed, formatted, markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = S.SEED


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


SHORT = "row_number() over (order by micro, src, dst) nth, sum(micro) over (order by micro, src, dst rows unbounded preceding) upto, count(*) over () n, sum(micro) over () total"
LONG = SHORT.replace("order by micro", "order by micro desc")


@query(f"""select nth, round(nth / n, 6) edge_share, round(upto / total, 6) wire_share from (select {SHORT} from mm) where (nth - 1) % greatest(1, n // 400) = 0 or nth = n""")
def lorenz_curve(spark, folder):
    """A22, W3, W10."""
    return rounded(A.lorenz(V.edge_lengths(spark, folder)))


@query(f"select max(n) n, round(1 - 2 / max(n) * (sum(upto / total) - (min(upto) / max(total) + 1) / 2), 6) gini from (select {SHORT} from mm)")
def gini(spark, folder):
    """A22."""
    return rounded(A.gini(V.edge_lengths(spark, folder)))


@query(f"select share, nth, round(upto / total, 6) wire_share from (select {LONG} from mm), (values (0.01::double), (0.05::double), (0.1::double), (0.25::double), (0.5::double)) v(share) where nth = greatest(1, floor(share * n)::bigint)")
def top_shares(spark, folder):
    """A22's top shares, T5."""
    return rounded(A.top_shares(V.edge_lengths(spark, folder), [0.01, 0.05, 0.1, 0.25, 0.5]))


DECILE = "(select *, len(list_filter(q[2:10], lambda e: e <= length)) bin from mm, (select quantile_cont(length, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) q from mm))"


@query(f"""select bin, count(*) edges, round(min(length), 6) shortest, round(max(length), 6) longest, round(sum(micro) / 1000000, 5) wire, sum(weight)::bigint weight, round(quantile_cont(weight, 0.5), 6) median_weight,
 round(sum(weight) / (sum(micro) / 1000000), 6) density, round(sum(weight) / (sum(micro) / 1000000) / (select sum(weight) / (sum(micro) / 1000000) from mm), 6) ratio from {DECILE} group by 1""")
def length_deciles(spark, folder):
    """A23, A24, N22."""
    t = A.decile_table(V.edge_lengths(spark, folder))
    return rounded(t.withColumn("wire", F.round("wire", 5)))


@query("""select bin, count(*) n, round(quantile_cont(degree, 0.5), 6) median_value, round(quantile_cont(c, 0.5), 6) median_other from (select *, len(list_filter(q[2:10], lambda e: e <= degree)) bin from
 (select deg.node, degree, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) c from deg join (select *, avg(x) over () mx, avg(y) over () my, avg(z) over () mz from nodes) p on p.node = deg.node),
 (select quantile_cont(degree, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) q from deg)) group by 1""")
def degree_bins(spark, folder):
    """A25, C4."""
    n = V.fine_nodes(spark, folder)
    both = E.degrees(V.fine_edges(spark, folder), n).join(E.distance_to_centroid(n), "node")
    return rounded(A.binned_medians(both.select("node", F.col("degree").cast("double").alias("degree"), "to_centroid"), "degree", "to_centroid"))


TAKE = "(select *, total * 0.05 t from (select src, dst, micro, {order} from mm))"


@query(f"select count(*) edges, sum(micro)::bigint micro from {TAKE.format(order=LONG)} where upto <= t or (upto - micro <= t and upto > t and abs(upto - t) < abs(t - (upto - micro)))")
def longest_until_cost(spark, folder):
    """Longest edges until 5 % of the wire."""
    kept = A.take_until(A.longest_first(V.edge_lengths(spark, folder)), "total * 0.05D")
    return kept.agg(F.count("*").alias("edges"), F.sum("micro").alias("micro"))


@query(f"select share, case when share <= 0 then 0 else coalesce(min(nth) filter (upto >= share * total), max(n)) end::bigint cut from (select {LONG} from mm), (values (0.0::double), (0.1::double), (0.25::double), (0.5::double), (0.9::double)) v(share) group by 1")
def cut_counts(spark, folder):
    """W7."""
    c = A.cut_counts(A.longest_first(V.edge_lengths(spark, folder)), [0.0, 0.1, 0.25, 0.5, 0.9])
    return c.select("share", F.col("cut").cast("long").alias("cut"))


CURVES = "(select src_superclass as name, bin::double wire_removed, count(*) v0, 1000.0 / (1 + bin) + count(*) % 7 value from (select src_superclass, floor(length / 100)::bigint bin from mm) group by 1, bin)"


def _curves(spark, folder):
    e = V.edge_lengths(spark, folder).groupBy(F.col("src_superclass").alias("name"), F.floor(F.col("length") / 100).alias("bin")).agg(F.count("*").alias("m"))
    return e.select("name", F.col("bin").cast("double").alias("wire_removed"), (F.lit(1000.0) / (1 + F.col("bin")) + F.col("m") % 7).alias("value"))


@query(f"""select name, round(arg_min(case when value = nv then wire_removed else wire_removed + (value - 150) / (value - nv) * (nw - wire_removed) end, wire_removed), 6) wire_at_level
 from (select *, lead(wire_removed) over w nw, lead(value) over w nv from {CURVES} window w as (partition by name order by wire_removed)) where nv <= 150 and value >= 150 group by 1""")
def level_crossing(spark, folder):
    """W8."""
    return rounded(A.level_crossing(_curves(spark, folder), 150.0))


@query(f"select name, wire_removed, round(value / first_value(value) over (partition by name order by wire_removed), 6) share from {CURVES}")
def baseline_share(spark, folder):
    """W9."""
    return rounded(A.baseline_share(_curves(spark, folder)).select("name", "wire_removed", "share"))


@query(f"select wire_removed, count(*) repeats, round(avg(value), 6) mean, round(stddev_samp(value), 6) sd from {CURVES} group by 1")
def pooled_curve(spark, folder):
    """A43."""
    pooled = A.pooled(_curves(spark, folder).withColumn("name", F.lit("all")))
    return rounded(pooled.select("wire_removed", "repeats", "mean", "sd"))


@query("""select d.node, role, degree, rank() over (partition by role order by degree desc) as rank, round(percent_rank() over (partition by role order by degree), 6) share_below from deg d join nodes n on n.node = d.node where role <> 'none'""")
def rank_among_peers(spark, folder):
    """W11."""
    n = V.fine_nodes(spark, folder)
    d = E.degrees(V.fine_edges(spark, folder), n).join(n.select("node", "role"), "node").where("role != 'none'")
    return rounded(A.rank_among(d, "degree", "role").select("node", "role", F.col("degree").cast("long").alias("degree"), "rank", "share_below"))


@query("""select node, round(price / 1000000, 6) price from (select case when src_role <> 'none' then src else dst end node, sum(micro) price from crossed where crossing group by 1) order by price desc, node limit 15""")
def dearest_nodes(spark, folder):
    """T6, T7, T3."""
    p = E.crossing_edges_by_node(V.edge_lengths(spark, folder))
    return rounded(p.select("node", "price").orderBy(F.desc("price"), "node").limit(15))


@query("select node, instr(lower(node), 'p1') as place from nodes where instr(lower(node), 'p1') > 0 order by 2, length(node), node limit 8")
def name_suggestions(spark, folder):
    """T9."""
    return A.suggestions(V.bodies(spark, folder).withColumnRenamed("body", "node"), "P1").withColumn("place", F.col("place").cast("long"))


@query("select min(node) node, 1 how from cb where cell_type = 'S3' union all select min(node), 0 from cb where node = 'P12|L'")
def resolved_names(spark, folder):
    """T10."""
    n = V.coarse_bodies(spark, folder).select("node", "cell_type").distinct()
    return A.resolved(n, "s-3").unionByName(A.resolved(n, "p 12 L"))


@query("select node, role, degree from (select d.node, role, degree from deg d join nodes n on n.node = d.node where role = 'descending' and d.node like '%7%')")
def filtered_table(spark, folder):
    """T8, T11."""
    n = V.fine_nodes(spark, folder)
    d = E.degrees(V.fine_edges(spark, folder), n).join(n.select("node", "role"), "node")
    return A.filtered(d, "descending", "7", "degree").select("node", "role", F.col("degree").cast("long").alias("degree"))


@query("select arg_min(x, (abs(x - 100), x)) nearest from (select round(x, 6) x from pos)")
def nearest_value(spark, folder):
    """X8."""
    return A.nearest_index(V.positions(spark, folder).select(F.round("x", 6).alias("x")), "x", 100.0)


@query(f"select node, superclass from (select node, superclass, row_number() over (partition by superclass order by {draw(str(SEED), 'node')}, node) k from nodes) where k <= 20")
def stratified_sample(spark, folder):
    """R1, R8, C12."""
    n = V.bodies(spark, folder).select(F.col("body").alias("node"), "superclass")
    return S.stratified(n, "superclass", "node", 20)


@query(f"select src, dst from edges order by {draw(str(SEED), 'src', 'dst')}, src, dst limit 300")
def count_matched_sample(spark, folder):
    """R2, R5, R6."""
    return S.count_matched(V.fine_edges(spark, folder).select("src", "dst"), 300, "src", "dst")


RANDOM = f"row_number() over (order by {draw(str(SEED), 'src', 'dst')}, src, dst) nth, sum(micro) over (order by {draw(str(SEED), 'src', 'dst')}, src, dst rows unbounded preceding) upto, sum(micro) over () total"


@query(f"select count(*) edges, sum(micro)::bigint micro from {TAKE.format(order=RANDOM)} where upto <= t or (upto - micro <= t and upto > t and abs(upto - t) < abs(t - (upto - micro)))")
def cost_matched_sample(spark, folder):
    """R3, W6."""
    return S.cost_matched(V.edge_lengths(spark, folder).select("src", "dst", "length"), "total * 0.05D").agg(F.count("*").alias("edges"), F.sum("micro").alias("micro"))


def _at(which: str) -> str:
    return f"floor({draw(str(SEED), repr(which), 'id')} * (select count(*) from nodes))::bigint"


NEGATIVE = f"""(select src, dst from (select s.node src, d.node dst, min(id) id from (select id, {_at('a')} a, {_at('b')} b from range(4100) t(id)) t
 join (select node, row_number() over (order by {draw(str(SEED), 'node')}, node) - 1 i from nodes) s on s.i = a join (select node, row_number() over (order by {draw(str(SEED), 'node')}, node) - 1 i from nodes) d on d.i = b
 where a <> b group by 1, 2) q where (src, dst) not in (select (src, dst) from edges) order by id limit 2000)"""


@query(f"select src, dst from {NEGATIVE}")
def sampled_non_edges(spark, folder):
    """R4, J10."""
    return S.non_edges(V.fine_edges(spark, folder), V.bodies(spark, folder).withColumnRenamed("body", "node"), 2000)


PLACED = f"""placed as (select a.i, n.node, p.x, p.y, p.z from (select i, node, compartment, row_number() over (partition by i, coalesce(compartment, '?') order by node) k from nodes, range(1, 21) t(i)) a join nodes n on n.node = a.node
 join (select i, compartment, x, y, z, row_number() over (partition by i, coalesce(compartment, '?') order by {draw(str(SEED), 'i', 'node')}, node) k from nodes, range(1, 21) t(i)) p on p.i = a.i and p.k = a.k and coalesce(p.compartment, '?') = coalesce(a.compartment, '?')),
 nulls as (select i draw_id, sum(round(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) * 1000000)::bigint) / 1000000 wire from edges join placed a on a.node = src join placed c on c.node = dst using sample 0 group by 1)""".replace("join placed c on c.node = dst using sample 0", "join placed c on c.node = dst and c.i = a.i").replace("select i draw_id", "select a.i draw_id")


@query(f", {PLACED} select draw_id, round(wire, 4) wire from nulls")
def placement_null(spark, folder):
    """N1, N2, N27 within compartments, twenty draws (the operator's default is a thousand)."""
    n = V.fine_nodes(spark, folder).withColumn("compartment", F.coalesce("compartment", F.lit("?")))
    return rounded(S.placement_null(V.fine_edges(spark, folder), n, 20, "compartment"), 4)


@query(f""", {PLACED} select round(real, 4) as real, count(*) draws, round(avg(wire), 4) null_mean, round(stddev_samp(wire), 4) null_sd, round(real / avg(wire), 6) ratio, round((1 + count(*) filter (wire <= real)) / (count(*) + 1), 6) p_lower,
 round((1 + count(*) filter (wire >= real)) / (count(*) + 1), 6) p_upper from nulls, (select sum(micro) / 1000000 real from mm) group by real""")
def placement_summary(spark, folder):
    """N4 to N7, N12."""
    n = V.fine_nodes(spark, folder).withColumn("compartment", F.coalesce("compartment", F.lit("?")))
    real = V.edge_lengths(spark, folder).agg(E.wire().alias("real"))
    s = S.summarized(S.placement_null(V.fine_edges(spark, folder), n, 20, "compartment"), "wire", real)
    return s.select(*[F.round(c, 4).alias(c) for c in ("real", "null_mean", "null_sd")], "draws", *[F.round(c, 6).alias(c) for c in ("ratio", "p_lower", "p_upper")])


PAIRS = "(select stem, l, r from (select cell_type stem, count(*) filter (side = 'L') l, count(*) filter (side = 'R') r from nodes group by 1) where l > 0 and r > 0)"


def _pairs(spark, folder):
    b = V.bodies(spark, folder).groupBy(F.col("cell_type").alias("stem")).agg(F.count_if(F.col("side") == "L").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    return b.where("l > 0 and r > 0")


@query(f"select i draw_id, round(avg(ln(l / r) * case when {draw(str(SEED), 'i', 'stem')} < 0.5 then 1 else -1 end), 9) mean from {PAIRS}, range(1, 101) t(i) group by 1")
def sign_flip_null(spark, folder):
    """N10, C5."""
    p = _pairs(spark, folder).withColumn("log_ratio", F.ln(F.col("l") / F.col("r")))
    return rounded(S.sign_flip_null(p, "log_ratio", "stem", 100), 9)


@query(f"""select a.i draw_id, round(avg(abs(ln(l / r))), 9) asymmetry from (select i, l, row_number() over (partition by i order by stem) k from {PAIRS}, range(1, 101) t(i)) a
 join (select i, r, row_number() over (partition by i order by {draw(str(SEED), 'i', 'stem')}, stem) k from {PAIRS}, range(1, 101) t(i)) c on c.i = a.i and c.k = a.k group by 1""")
def repairing_null(spark, folder):
    """N11."""
    return rounded(S.repairing_null(_pairs(spark, folder), "l", "r", "stem", 100), 9)


NUMBERED = f"(select node, x, y, z, row_number() over (order by {draw(str(SEED), 'node')}, node) - 1 i, count(*) over () n from nodes)"


@query(f"""select draw_id, round(avg(sqrt((ox - mx) * (ox - mx) + (oy - my) * (oy - my) + (oz - mz) * (oz - mz))), 6) mean from (select draw_id, s.node, any_value(s.ox) ox, any_value(s.oy) oy, any_value(s.oz) oz, avg(p.x) mx, avg(p.y) my, avg(p.z) mz
 from (select t.d draw_id, en.node, o.x ox, o.y oy, o.z oz, floor({draw(str(SEED), 't.d', 'en.node', 'en.other')} * (o.n - 1))::bigint k, o.i self from en join {NUMBERED} o on o.node = en.node, range(1, 4) t(d)) s
 join {NUMBERED} p on p.i = case when k >= self then k + 1 else k end group by 1, 2) group by 1""")
def random_partner_null(spark, folder):
    """N9."""
    return rounded(S.random_partner_null(V.fine_edges(spark, folder), V.fine_nodes(spark, folder), 3))


def rank_sql(v: str) -> str:
    return f"rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0"


@query(f"select count(*) n, round(corr(a, c), 6) rho from (select {rank_sql('micro')} a, {rank_sql('weight')} c from mm)")
def spearman_length_weight(spark, folder):
    """W5, N14."""
    e = A.with_micro(V.edge_lengths(spark, folder))
    return rounded(T.spearman(e, "micro", "weight"))


@query("select count(*) n, round(corr(log10(length), log10(weight)), 6) r from mm where length > 0 and weight > 0")
def pearson_length_weight(spark, folder):
    """N15."""
    return rounded(T.pearson_log10(V.edge_lengths(spark, folder), "length", "weight"))


@query(f"""select n, round((ab - ag * bg) / sqrt((1 - ag * ag) * (1 - bg * bg)), 6) rho from (select count(*) n, corr(a, c) ab, corr(a, g) ag, corr(c, g) bg from (select {rank_sql('micro')} a, {rank_sql('weight')} c, {rank_sql('n_connections')} g from mm))""")
def partial_spearman(spark, folder):
    """N16."""
    return rounded(T.partial_spearman(A.with_micro(V.edge_lengths(spark, folder)), "micro", "weight", "n_connections"))


@query(f"""select n1, n2, rs - n1 * (n1 + 1) / 2 u, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) z from
 (select count(*) filter (crossing)::double n1, count(*) filter (not crossing)::double n2, sum(r) filter (crossing) rs, (select sum(m * m * m - m)::double from (select count(*) m from crossed group by micro)) ties from (select crossing, {rank_sql('micro')} r from crossed))""")
def mann_whitney_crossing(spark, folder):
    """N17."""
    e = A.with_micro(V.edge_lengths(spark, folder)).withColumn("crossing", E.crossing())
    return rounded(T.mann_whitney(e, "micro", "crossing"))


@query("""select count(*) filter (h and c) row_and_column, count(*) filter (h and not c) row_only, count(*) filter (not h and c) column_only, count(*) filter (not h and not c) neither,
 round(count(*) filter (h and c) * count(*) filter (not h and not c) / nullif(count(*) filter (h and not c) * count(*) filter (not h and c), 0), 6) odds_ratio from (select degree >= (select quantile_cont(degree, 0.9) from deg) h, role <> 'none' c from deg join nodes n on n.node = deg.node)""")
def hub_membership(spark, folder):
    """N18's table."""
    return rounded(T.contingency(_hubs(spark, folder), "hub", "connective"))


def _hubs(spark, folder):
    n = V.fine_nodes(spark, folder)
    d = E.degrees(V.fine_edges(spark, folder), n).join(n.select("node", "role"), "node")
    cut = A.quantiles(d, "degree", {"cut": 0.9})  # one row
    return d.join(F.broadcast(cut)).select((F.col("degree") >= F.col("cut")).alias("hub"), (F.col("role") != "none").alias("connective"), "degree", "role")


@query()
def hub_fisher(spark, folder):
    """Exact one-sided test (its tail is a function of the table)."""
    return T.fisher(_hubs(spark, folder), "hub", "connective")


@query("""select round(max(abs(a / ta - c / tc)), 9) ks from (select sum(a) over o a, sum(c) over o c, sum(a) over () ta, sum(c) over () tc from (select degree, count(*) filter (role <> 'none') a, count(*) filter (role = 'none') c from deg join nodes n on n.node = deg.node group by 1) window o as (order by degree))""")
def ks_degrees(spark, folder):
    """N19."""
    h = _hubs(spark, folder)
    return rounded(T.ks_distance(h, "degree", "connective"), 9)


@query("select count(*) tail, round(1 + count(*) / sum(ln(length / 300)), 6) alpha from mm where length >= 300")
def power_law_tail(spark, folder):
    """N21's estimator."""
    return rounded(T.power_law(V.edge_lengths(spark, folder), "length", 300.0).select("tail", "alpha"))


@query()
def power_law_cutoff(spark, folder):
    """N21's scan."""
    return T.power_law_scan(V.edge_lengths(spark, folder), "length")


@query()
def tail_comparison(spark, folder):
    """The power-law tail of the rounded lengths against lognormal, exponential and truncated power-law tails, by the
    normalised ratio of their likelihoods."""
    return rounded(T.tail_comparison(V.edge_lengths(spark, folder), "length"), 5)


@query()
def correlation_tests(spark, folder):
    """P-values of the rank correlations and of the rank-sum test of crossing edges, longer than others."""
    e = checkpointed(A.with_micro(V.edge_lengths(spark, folder)).select("micro", "weight", "n_connections", E.crossing().alias("crossing")), "tests")
    plain, partial, ranks = T.spearman(e, "micro", "weight"), T.partial_spearman(e, "micro", "weight", "n_connections"), T.mann_whitney(e, "micro", "crossing")
    p = T.t_p_value("rho", "n")
    one = lambda p: F.when(F.col("rho") > 0, p / 2).otherwise(1 - p / 2)
    rows = plain.select(F.lit("spearman two-sided").alias("test"), "n", F.col("rho").alias("statistic"), p.alias("p"))
    rows = rows.unionByName(plain.select(F.lit("spearman above 0").alias("test"), "n", F.col("rho").alias("statistic"), one(p).alias("p")))
    rows = rows.unionByName(partial.select(F.lit("partial spearman above 0").alias("test"), "n", F.col("rho").alias("statistic"), one(T.t_p_value("rho", F.col("n") - 1)).alias("p")))
    return rows.unionByName(ranks.select(F.lit("crossing edges longer").alias("test"), (F.col("n1") + F.col("n2")).cast("long").alias("n"), F.col("z").alias("statistic"), T.normal_tail("z").alias("p")))


@query()
def exponential_decay(spark, folder):
    """N20."""
    n, e = V.fine_nodes(spark, folder), V.edge_lengths(spark, folder)
    return T.exponential_fit(R.connection_probability(R.pair_histogram(n, 20.0), R.edge_histogram(e, 20.0), 20.0, 1000), "bin_start", "probability")


@query("""select s.items, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) ari, round((ln(n) + hi / n + ln(n) + hj / n - ln(n) - hij / n) / ((ln(n) + hi / n + ln(n) + hj / n) / 2), 6) nmi from
 (select sum(m)::bigint items, sum(m)::double n, sum(m * (m - 1) / 2) ij, -sum(m * ln(m)) hij from (select count(*) m from nodes where compartment is not null group by region, compartment)) s,
 (select sum(m * (m - 1) / 2) i, -sum(m * ln(m)) hi from (select count(*) m from nodes where compartment is not null group by region)), (select sum(m * (m - 1) / 2) j, -sum(m * ln(m)) hj from (select count(*) m from nodes where compartment is not null group by compartment))""")
def region_compartment_agreement(spark, folder):
    """G14."""
    return rounded(T.partition_agreement(V.fine_nodes(spark, folder), "region", "compartment"))


LEVELS = """lv as (select node root, node, 0 level from (select distinct node from cb where kind = 'S') union select root, e.dst, level + 1 from lv join cedges e on e.src = lv.node where level < (select count(distinct node) from cb)),
 best as (select root, node, min(level) level from lv group by 1, 2)"""


@V.built_once
def _coarse_nodes(spark, folder):
    return build.summarize_nodes(V.coarse_bodies(spark, folder).withColumn("weight", 1 + F.col("key") % 7))


def _roots(spark, folder):
    return V.coarse_bodies(spark, folder).where("kind = 'S'").select("node").distinct()


@query(f", {LEVELS} select level, count(*) n from best group by 1")
def search_levels(spark, folder):
    """G8's search: nodes by level from all supplier nodes."""
    return G.search_levels(V.coarse_edges(spark, folder), _roots(spark, folder)).groupBy(F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


@query(f""", {LEVELS} select count(*) pairs, round(count(*) / ((select count(distinct node) from cb where kind = 'S') * (select count(distinct node) from cb where kind = 'C')), 6) reachability from best where root <> node and node in (select node from cb where kind = 'C')""")
def reachable_pairs(spark, folder):
    """G1, G2."""
    targets = V.coarse_bodies(spark, folder).where("kind = 'C'").select("node").distinct()
    return rounded(G.reachable_pairs(V.coarse_edges(spark, folder), _roots(spark, folder), targets))


@query(""", r as (select 'P11|L' node union select e.dst from r join cedges e on e.src = r.node where e.weight % 7 = 0) select node from (select distinct node from cb) where node not in (select node from r)""")
def unreachable_nodes(spark, folder):
    """G4, in the graph of edges whose weight is a multiple of seven."""
    start = spark.createDataFrame([("P11|L",)], "node string")
    return G.unreachable_from(V.coarse_edges(spark, folder).where("weight % 7 = 0"), V.coarse_bodies(spark, folder).select("node").distinct(), start)


@query(f", {LEVELS} select (select count(distinct node) from cb where kind = 'S') roots, round(sum(case when level > 0 then 1.0 / level else 0 end) / ((select count(distinct node) from cb where kind = 'S') * ((select count(distinct node) from cb) - 1)), 6) efficiency from best")
def sampled_efficiency(spark, folder):
    """G8."""
    levels = G.search_levels(V.coarse_edges(spark, folder), _roots(spark, folder))
    n = V.coarse_bodies(spark, folder).select("node").distinct().agg(F.count("*").alias("n"))
    return rounded(G.efficiency(levels, n))


@query(""", un as (select src a, dst c from cedges union select dst, src from cedges), wr as (select distinct node root, node from cb union select root, c from wr join un on a = wr.node),
 cp as (select root, min(node) component from wr group by 1) select max(n) largest, count(*) components from (select component, count(*) n from cp group by 1)""")
def largest_component(spark, folder):
    """G7."""
    return G.largest_component(V.coarse_edges(spark, folder), V.coarse_bodies(spark, folder).select("node").distinct())


UND = "und as (select distinct least(src, dst) a, greatest(src, dst) c from cedges)"


@query(f""", {UND}, d as (select node, count(*) degree from (select a node from und union all select c from und) group by 1), tri as (select p.a x, p.c y, q.c z from und p join und q on q.a = p.c join und r on r.a = p.a and r.c = q.c),
 t as (select node, count(*) t from (select x node from tri union all select y from tri union all select z from tri) group by 1)
 select count(*) nodes, (sum(coalesce(t, 0)) / 3)::bigint triangles, round(sum(coalesce(t, 0)) / sum(degree * (degree - 1) / 2), 6) transitivity, round(avg(case when degree >= 2 then coalesce(t, 0) / (degree * (degree - 1) / 2) else 0 end), 6) mean_clustering from d left join t on t.node = d.node""")
def clustering(spark, folder):
    """G9, G12's clustering."""
    return rounded(G.clustering(V.coarse_edges(spark, folder)))


@query()
def edge_betweenness(spark, folder):
    """Exact, from all nodes of the coarse view."""
    nodes = V.coarse_bodies(spark, folder).select("node").distinct()
    return G.edge_betweenness(V.coarse_edges(spark, folder), nodes)


@query()
def rewired_graph(spark, folder):
    """G15, G16."""
    return G.rewired(V.coarse_edges(spark, folder).select("src", "dst", "weight"), SEED)


def _regions(spark, folder):
    """Pairs of areas, and the graph of those with more edges than by chance. Edges are read once and added up, not kept."""
    pairs = checkpointed(R.region_pairs(R.areas(V.edge_lengths(spark, folder))), "area-pairs")
    return pairs, checkpointed(R.graph_of_pairs(pairs, dense=False), "area-graph")


@query()
def stable_communities(spark, folder):
    """How many of a hundred seeds agree on the commonest partition of the area graph, and its modularity."""
    return rounded(C.stable_partition(_regions(spark, folder)[1], 100, SEED)[1])


@query()
def region_communities(spark, folder):
    """The partition that most of a hundred seeds agree on."""
    pairs, graph = _regions(spark, folder)
    parts, _ = C.stable_partition(graph, 100, SEED)
    return parts.join(R.strength_of_pairs(pairs).select(F.col("region").alias("node"), "strength"), "node").groupBy("community").agg(F.count("*").alias("regions"), F.sum("strength").alias("strength"), F.sort_array(F.collect_list("node")).alias("members"))


#: Shares of the wire that schedules remove; the curves are compared at REFERENCE.
SHARES, REFERENCE, REPEATS = [k / 40 for k in range(16)] + [0.5, 0.6], 0.25, 5


def _removals(spark, folder):
    """(curve points of the three schedules, edges with micro): longest and shortest first at SHARES of the wire; random orders
    at the counts of edges that longest first removes, as means over REPEATS orders."""
    nodes = _coarse_nodes(spark, folder)
    e = V.with_ends(V.coarse_edges(spark, folder), nodes, ["x", "y", "z"]).withColumn("length", F.coalesce(X.distance("src_", "dst_"), F.lit(0.0)))
    e = checkpointed(A.with_micro(e).select("src", "dst", "micro"), "lengths")
    key = (F.col("src"), F.col("dst"))
    longest = checkpointed(A.running(e, "micro", -F.col("micro"), *key), "schedule")
    shortest = longest.withColumns({"nth": F.col("rows") + 1 - F.col("nth"), "upto": F.col("total") - F.col("upto") + F.col("micro")})  # the same order backwards
    orders = {"longest": longest, "shortest": shortest, **{f"random {i}": checkpointed(A.running(e, "micro", X.draw(S.SEED, i, *key), *key), "schedule") for i in range(REPEATS)}}
    ran = cuts = counts = None
    for name, one in orders.items():
        if not name.startswith("random"):
            c = checkpointed(A.cut_counts(one, SHARES), "cuts")
            counts = c if name == "longest" else counts
        c = (counts if name.startswith("random") else c).select(F.lit(name).alias("schedule"), "share", "cut")
        one = one.select(F.lit(name).alias("schedule"), "nth", "src", "dst", "micro", "upto", "total", "rows")
        ran, cuts = (one, c) if ran is None else (ran.unionByName(one), cuts.unionByName(c))
    cuts = checkpointed(cuts, "cuts")
    points = G.removal_curve(ran, nodes.select("node"), cuts, _roots(spark, folder))
    gone = cuts.join(ran.select("schedule", "nth", "upto"), ["schedule"]).where("nth = cut").select("schedule", "share", F.col("upto").alias("gone"))
    whole = e.agg(F.sum("micro").alias("wire"), F.count("*").alias("edges"))  # one row
    points = points.join(gone, ["schedule", "share"], "left").join(F.broadcast(whole)).join(F.broadcast(nodes.agg(F.count("*").alias("nodes"))))
    first = points.where("cut = 0").groupBy("schedule").agg(F.max("efficiency").alias("base"))
    points = points.join(first, "schedule")
    named = F.when(F.col("schedule").startswith("random"), "random").otherwise(F.col("schedule"))
    wire = F.coalesce("gone", F.lit(0)) / 1_000_000
    values = {"wire_removed": wire, "wire_share": F.coalesce("gone", F.lit(0)) / F.col("wire"), "largest": F.col("largest"), "largest_share": F.col("largest") / F.col("nodes"), "efficiency": F.col("efficiency"), "efficiency_share": F.col("efficiency") / F.nullif(F.col("base"), F.lit(0.0))}
    pooled = points.select(named.alias("schedule"), "share", "cut", (F.col("cut") / F.col("edges")).alias("edge_share"), *[v.cast("double").alias(k) for k, v in values.items()])
    return checkpointed(pooled.groupBy("schedule", "share", "cut", "edge_share").agg(F.count("*").alias("repeats"), *[f for k in values for f in (F.avg(k).alias(k), F.stddev_samp(k).alias(f"{k}_sd"))]), "points")


@query()
def removal_curve(spark, folder):
    """What is left of the coarse graph when its edges go longest first, shortest first, and, as many of them,
    in random order: largest component and efficiency, their shares of the whole and deviations over the random orders."""
    return rounded(_removals(spark, folder))


@query()
def removal_comparison(spark, folder):
    """Each schedule at the reference share, the share of the wire at which it has halved the efficiency, and the
    efficiency that it loses for a million units of wire; the halving shares of longest and shortest first as a ratio."""
    points = _removals(spark, folder)
    half = A.level_crossing(points.select(F.col("schedule").alias("name"), F.col("wire_share").alias("wire_removed"), F.col("efficiency_share").alias("value")), 0.5).withColumnRenamed("name", "schedule")
    at = points.where(F.abs(F.col("share") - REFERENCE) < 1e-9).select("schedule", "wire_removed", "largest_share", "efficiency_share")
    found = at.join(half, "schedule", "left").withColumn("lost_per_million", (1 - F.col("efficiency_share")) / F.nullif(F.col("wire_removed") / 1e6, F.lit(0.0)))
    pick = lambda s: F.max(F.when(F.col("schedule") == s, F.col("wire_at_level")))
    return rounded(found.join(F.broadcast(half.agg((pick("longest") / pick("shortest")).alias("halving_ratio")))))


FEATURES = f"""f as (select n.node, x, y, z, coalesce(compartment, 'none') c, superclass s, ln(1 + out_degree) lo, ln(1 + in_degree) li from nodes n join deg on deg.node = n.node),
 neg as (select * from {NEGATIVE}), pairs as (select src, dst, 1.0 y from edges union all select src, dst, 0.0 from neg),
 design as (select p.y label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) d, a.c = b.c same, a.s || '>' || b.s pair, a.lo, b.li from pairs p join f a on a.node = src join f b on b.node = dst)"""


def _design(spark, folder):
    n, e = V.fine_nodes(spark, folder), V.fine_edges(spark, folder)
    return M.pair_design(M.stacked(e, S.non_edges(e, n, 2000)), M.node_features(n, e))


@query(f", {FEATURES} select label::double label, pair class_pair, count(*) pairs, round(avg(d / 100), 6) near, round(avg(ln(d + 1)), 6) log_near, round(avg(same::int), 6) same_compartment, round(avg(lo), 6) log_out, round(avg(li), 6) log_in from design group by 1, 2")
def pair_design(spark, folder):
    """M1, M2, U6, with 2,000 non-edges, which SQL repeats."""
    d = _design(spark, folder).groupBy("label", "class_pair").agg(F.count("*").alias("pairs"), *[F.avg(c).alias(c) for c in ("near", "log_near", "same_compartment", "log_out", "log_in")])
    return rounded(d)


@query()
def link_models(spark, folder):
    """M3 to M5, M9: four nested models of the coarse graph with five non-edges an edge; AUC in the sample and over five folds."""
    e, n = V.coarse_edges(spark, folder), _coarse_nodes(spark, folder)
    design = checkpointed(M.encoded(M.sampled_design(e, n, S.SEED)))
    out = None
    for name, columns in M.MODELS.items():
        scored = checkpointed(M.fit(design, columns)[1].select("p", "label"))
        one = M.fit_statistics(scored, len(columns)).join(M.auc(scored)).join(M.cross_validated(design, columns, 5, S.SEED).withColumnRenamed("auc", "held_out_auc")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


LOGITS = "(select a.node src, b.node dst, 1.5 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 50 logit from (select node, avg(x2) x, avg(y2) y, avg(z2) z from cb group by 1) a, (select node, avg(x2) x, avg(y2) y, avg(z2) z from cb group by 1) b where a.node <> b.node)"


def _logits(spark, folder):
    n = V.coarse_bodies(spark, folder).groupBy("node").agg(*[F.avg(f"{k}2").alias(k) for k in "xyz"])
    return R.all_pairs(n, ["x", "y", "z"]).select("src", "dst", (1.5 - X.distance("src_", "dst_") / 50).alias("logit"))


@query(f"select floor(logit / 0.05)::bigint bin, count(*) n from {LOGITS} group by 1")
def logit_histogram(spark, folder):
    """M8's histogram, of logits by distance with given coefficients, which SQL can repeat; ``model_logits`` has fitted ones."""
    return M.logit_histogram(_logits(spark, folder), 0.05)


@query(f"select src, dst from {LOGITS} where {draw('7', 'src', 'dst')} < 1 / (1 + exp(-(logit - 0.5)))")
def sampled_graph(spark, folder):
    """R7, P13."""
    return M.sampled_graph(_logits(spark, folder), -0.5, 7)


@query()
def model_logits(spark, folder):
    """M3, M6 to M8: for two models of the coarse graph fitted on its edges and five non-edges each, the intercept after the
    case-control correction, the shift with which all pairs expect as many edges as there are, and what they expect."""
    return M.calibrated(V.coarse_edges(spark, folder), _coarse_nodes(spark, folder), ["distance", "degree"], S.SEED)


@query("""select 'loops' as check, count(*) n from edges where src = dst union all select 'duplicates', count(*) from (select src, dst from edges group by 1, 2 having count(*) > 1) union all select 'unknown ends', count(*) from edges where src not in (select node from nodes)
 union all select 'pairs', abs((select count(*) * (count(*) - 1) from nodes) - (select count(*) from nodes a join nodes c on a.node <> c.node)) union all select 'weak', count(*) from edges where input_fraction < 0.01""")
def data_checks(spark, folder):
    """V1: violations of the graph's invariants."""
    e, n = V.fine_edges(spark, folder), V.fine_nodes(spark, folder)
    size = n.agg((F.count("*") * (F.count("*") - 1)).alias("want"))
    pairs = R.pair_histogram(n, 20.0).agg(F.sum("pairs").alias("have")).join(size).select(F.lit("pairs").alias("check"), F.abs(F.col("want") - F.col("have")).alias("n"))
    count = lambda name, frame: frame.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    return (
        count("loops", e.where("src = dst")).unionByName(count("duplicates", e.groupBy("src", "dst").count().where("count > 1")))
        .unionByName(count("unknown ends", e.join(n.select(F.col("node").alias("src")), "src", "left_anti"))).unionByName(pairs).unionByName(count("weak", e.where("input_fraction < 0.01")))
    )


@query("select 'wire' kpi, round(sum(micro) / 1000000, 3) value from mm union all select 'crossing share of edges', round(avg(crossing::int), 6) from crossed union all select 'crossing share of wire', round(sum(micro) filter (crossing) / sum(micro), 6) from crossed union all select 'top tenth share', round(max(upto / total), 6) from (select %s from mm) where nth = floor(0.1 * n)::bigint" % LONG)
def headline(spark, folder):
    """Key figures in one table."""
    e = V.edge_lengths(spark, folder)
    m = A.with_micro(e).withColumn("crossing", E.crossing())
    kpi = lambda name, frame: frame.select(F.lit(name).alias("kpi"), F.col("value"))
    share = (F.sum(F.when(F.col("crossing"), F.col("micro")).otherwise(0)) / F.sum("micro")).alias("value")
    return rounded(
        kpi("wire", m.agg(F.round(F.sum("micro") / 1_000_000, 3).alias("value"))).unionByName(kpi("crossing share of edges", m.agg(F.avg(F.col("crossing").cast("int")).alias("value"))))
        .unionByName(kpi("crossing share of wire", m.agg(share))).unionByName(kpi("top tenth share", A.top_shares(e, [0.1]).select(F.col("wire_share").alias("value"))))
    )


@query("select '| ' || superclass || ' | ' || count(*) || ' |' line from nodes group by superclass")
def markdown_report(spark, folder):
    """S14, S11's formats, A40."""
    return markdown(V.bodies(spark, folder).groupBy("superclass").agg(F.count("*").alias("n")))


@query("select node, printf('%.2f', x) x, printf('%.3f', y) y from nodes")
def formatted_rows(spark, folder):
    """S11."""
    return formatted(V.fine_nodes(spark, folder).select("node", "x", "y"), {"x": "%.2f", "y": "%.3f"})


@query("select stem, count(*) filter (region % 2 = 0) in_even, count(distinct region % 2) > 1 as split from (select cell_type stem, side, min(region) region from nodes group by 1, 2) group by 1 having count(*) = 2")
def mirrored_pairs(spark, folder):
    """Stems on both sides and whether their groups differ."""
    per = V.fine_nodes(spark, folder).groupBy(F.col("cell_type").alias("stem"), "side").agg(F.min("region").alias("region"))
    return per.groupBy("stem").agg(F.count_if(F.col("region") % 2 == 0).alias("in_even"), (F.countDistinct(F.col("region") % 2) > 1).alias("split"), F.count("*").alias("sides")).where("sides = 2").drop("sides")
