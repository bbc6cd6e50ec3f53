"""Operators on small tables with results worked out by hand or by brute force."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshwork.functions import expressions as X
from meshwork.functions import tails
from meshwork.operators import analytic as A
from meshwork.operators import build
from meshwork.operators import communities as C
from meshwork.operators import edges as E
from meshwork.operators import graph as G
from meshwork.operators import regions as R
from meshwork.operators import sampling as S
from meshwork.operators import stats as T
from meshwork.sources.sinks import checkpointed, document, formatted, given_back, markdown


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, length double, weight long")


@pytest.fixture(scope="module")
def lengths(spark):
    return edge_table(spark, [(f"s{i}", f"d{i}", float(i), i) for i in range(1, 101)])


def test_sides_and_labels(spark):
    values = ["L", "R", "M", "left", "", None]
    rows = [(s, r) for s in values for r in values]
    got = [r[0] for r in spark.createDataFrame(rows, "soma string, root string").coalesce(1).select(X.side("soma", "root")).collect()]
    assert got == [s if s in ("L", "R", "M") else r if r in ("L", "R") else "unknown" for s, r in rows]
    p = spark.createDataFrame([([1000.0, 2000.0, 125000.0],), (None,)], "loc array<double>").select(*X.point("loc")).collect()
    assert [round(v, 9) for v in p[0]] == [8, 16, 1000] and tuple(p[1]) == (None, None, None)
    names = spark.createDataFrame([("LP(L)",), ("CB",), ("T2(R)",)], "name string").select(*X.split_side(F.col("name")), X.segment(F.col("name"))).collect()
    assert [tuple(r) for r in names] == [("LP", "L", None), (None, None, None), ("T2", "R", "T2")]


def test_quantize_rounds_half_to_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (-3.0,), (99.0,)], "v double").select(X.quantize(F.col("v"), F.lit(0.0), F.lit(10.0), 10)).collect()
    assert [r[0] for r in got] == [0, 2, 0, 10]
    assert spark.range(1).select(X.quantize(F.lit(3.0), F.lit(3.0), F.lit(3.0))).first()[0] == 0


def test_aggregate_and_threshold(spark):
    c = spark.createDataFrame([("A", "B", 5), ("A", "B", 7), ("A", "A", 9)], "src string, dst string, weight long")
    assert {tuple(r) for r in build.aggregate_edges(c).collect()} == {("A", "B", 12, 2), ("A", "A", 9, 1)}
    half = build.aggregate_edges(c.limit(0))
    assert build.combine_edges(build.aggregate_edges(c), half).count() == 2
    e = spark.createDataFrame([("A", "B", 95, 1), ("B", "B", 5, 1), ("B", "C", 5, 1), ("C", "C", 95, 1), ("A", "C", 4, 1)], "src string, dst string, weight long, n_connections long")
    assert {(r["src"], r["dst"]) for r in build.build_graph(e, 0.048).collect()} == {("A", "B"), ("B", "C")}


def test_majority_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([("t", "b"), ("t", "a"), ("u", None), ("u", None), ("u", "z")], "cell_type string, superclass string")
    got = {r["cell_type"]: (r["superclass"], r["members"], r["share"]) for r in build.majority_superclass(rows).collect()}
    assert got == {"t": ("a", 1, 0.5), "u": ("unannotated", 2, pytest.approx(2 / 3))}


def test_positions_and_compartments(spark):
    b = spark.createDataFrame(
        [("A", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1), ("A", 10.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1), ("M", None, None, None, 5.0, 0.0, 0.0, 1), ("M", None, None, None, 10.0, 0.0, 0.0, 1), ("M", 1.0, 1.0, 1.0, 7.5, 0.0, 0.0, 2)],
        "node string, x double, y double, z double, x2 double, y2 double, z2 double, weight long",
    )
    got = {r["node"]: r for r in build.node_positions(b).collect()}
    assert (got["A"]["x"], got["A"]["spread"], got["A"]["position_source"]) == (5, 5, "body")
    assert (got["M"]["x"], got["M"]["spread"], got["M"]["position_source"]) == (7.5, None, "weighted")
    counts = spark.createDataFrame([("A", "brain", 60), ("A", "vnc", 30), ("B", "brain", 5), ("B", "vnc", 5), ("C", None, 9)], "node string, compartment string, n long")
    assert {r["node"]: r["compartment"] for r in build.node_compartments(counts, counts).collect()} == {"A": "brain", "B": None, "C": None}


def test_lengths_and_summary(spark, lengths):
    r = random.Random(21)
    points = {k: tuple(r.randint(-50, 50) for _ in range(3)) for k in "abcde"}
    rows = [(a, b, r.randint(1, 9)) for a in points for b in points if a < b]
    n = spark.createDataFrame([(k, *map(float, v)) for k, v in points.items()], "node string, x double, y double, z double")
    from meshwork.sources.graph_views import with_ends

    e = with_ends(spark.createDataFrame(rows, "src string, dst string, weight long"), n, ["x", "y", "z"]).withColumn("length", X.distance("src_", "dst_"))
    lengths_of = [math.dist(points[a], points[b]) for a, b, _ in rows]
    assert sorted(x["length"] for x in e.collect()) == pytest.approx(sorted(lengths_of))
    assert tuple(E.cost(e).first()) == pytest.approx((sum(lengths_of), sum(d * w for d, (*_, w) in zip(lengths_of, rows))), abs=1e-4)
    s = E.length_summary(lengths.withColumn("g", F.lit(1)), "g").first()
    assert (s["mean"], s["median"], s["p90"], s["p99"], s["longest"]) == (50.5, 50.5, pytest.approx(90.1), pytest.approx(99.01), 100)


def test_degree_and_wire(spark):
    e = edge_table(spark, [("0", "1", 3.0, 1), ("1", "2", 4.0, 1), ("0", "2", 5.0, 1)])
    n = spark.createDataFrame([(str(i),) for i in range(4)], "node string")
    assert {tuple(r) for r in E.degree_and_wire(e, n).collect()} == {("0", 2, 8.0), ("1", 2, 7.0), ("2", 2, 9.0), ("3", 0, 0.0)}
    far = n.withColumns({"x": F.when(F.col("node") == "3", 1.0).otherwise(F.col("node").cast("double") * 8), "y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r[0]: r[1] for r in E.partner_distance(e, far).collect()}
    assert got["3"] is None and got["0"] == 12 and got["1"] == 0


def test_concentration(spark, lengths):
    ten = edge_table(spark, [(f"a{i}", "b", 9.0, 1) for i in range(10)] + [(f"c{i}", "b", 1.0, 1) for i in range(90)])
    got = {r["share"]: r["wire_share"] for r in A.top_shares(ten, [0.01, 0.05, 0.1, 0.25, 0.5]).collect()}
    assert got == {0.01: 9 / 180, 0.05: 45 / 180, 0.1: 0.5, 0.25: 105 / 180, 0.5: 130 / 180}
    equal = edge_table(spark, [(f"a{i}", "b", 2.0, 1) for i in range(20)])
    assert A.gini(equal).first()["gini"] == pytest.approx(1 / 400)
    upto = A.running(A.with_micro(lengths), "micro", F.col("micro"), F.col("src")).orderBy("nth").collect()
    assert [r["nth"] for r in upto] == list(range(1, 101)) and [r["upto"] for r in upto] == [k * (k + 1) // 2 * 10**6 for k in range(1, 101)]


def test_quantile_bins_and_deciles(spark, lengths):
    got = A.binned_medians(lengths.withColumn("other", F.col("length")), "length", "other").orderBy("bin").collect()
    assert [(r["n"], r["median_value"]) for r in got] == [(10, 5.5 + 10 * b) for b in range(10)]
    same = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    assert {r["bin"]: r["count"] for r in A.quantile_bins(same, "v", 10).groupBy("bin").count().collect()} == {8: 9, 9: 1} or A.quantile_bins(same, "v", 10).groupBy("bin").count().count() <= 2
    rows = [(f"a{i}", "b", 1.0, 5) for i in range(10)] + [(f"c{i}", "b", 10.0, 5) for i in range(10)]
    table = A.decile_table(edge_table(spark, rows), 2).orderBy("shortest").collect()
    assert [r["density"] for r in table] == [5.0, 0.5]


def test_take_until(spark):
    r = random.Random(17)
    values = [r.randint(1, 30) for _ in range(25)]
    ran = checkpointed(A.running(A.with_micro(edge_table(spark, [(str(i), "b", float(v), 1) for i, v in enumerate(values)])), "micro", F.col("src").cast("long"), F.col("dst")))
    sums = [sum(values[:k]) for k in range(26)]
    for target in [0, sums[1] - 0.5, sums[7], sums[7] + 0.25, sums[12] + values[12] * 0.5, sums[12] + values[12] * 0.75, sums[25] + 4]:
        within = max(k for k in range(26) if sums[k] <= target)
        more = within < 25 and sums[within + 1] - target < target - sums[within]
        assert A.take_until(ran, f"{round(target * 10**6)}L").count() == within + more


def test_cuts_and_levels(spark):
    r = random.Random(18)
    values = sorted((r.randint(1, 40) for _ in range(23)), reverse=True)
    ran = A.longest_first(edge_table(spark, [(str(i), "b", float(v), 1) for i, v in enumerate(values)]))
    shares = [0.0, 0.013, 0.2, 0.55, 0.77, 0.999, 1.0]
    want = {s: next(k for k in range(24) if sum(values[:k]) >= s * sum(values)) for s in shares}
    assert {x["share"]: x["cut"] for x in A.cut_counts(ran, shares).collect()} == want
    at, curve = [0.0, 0.11, 0.3, 0.62, 0.8], [2.5, 2.0, 2.0, 0.9, 0.1]
    frame = spark.createDataFrame([("one", x, y) for x, y in zip(at, curve)], "name string, wire_removed double, value double")
    for level in (2.2, 1.3, 0.4):
        i = next(i for i in range(4) if curve[i] >= level >= curve[i + 1])
        assert A.level_crossing(frame, level).first()["wire_at_level"] == pytest.approx(at[i] + (curve[i] - level) / (curve[i] - curve[i + 1]) * (at[i + 1] - at[i]))
    assert A.level_crossing(frame, 0.05).count() == 0
    assert [x["share"] for x in A.baseline_share(frame).orderBy("wire_removed").collect()] == pytest.approx([y / 2.5 for y in curve])


def test_routes_and_rich_club(spark):
    n = spark.createDataFrame([("a", "none", "brain"), ("b", "none", "brain"), ("h", "descending", None), ("v", "none", "vnc"), ("w", "none", "vnc")], "node string, role string, compartment string")
    from meshwork.sources.graph_views import with_ends

    raw = edge_table(spark, [("a", "h", 1.0, 1), ("b", "h", 1.0, 1), ("h", "v", 1.0, 1), ("h", "w", 1.0, 1), ("a", "b", 1.0, 1)])
    e = with_ends(raw, n, ["role", "compartment"])
    rich = n.select("node", F.col("node").isin("a", "b", "v").alias("rich"))
    assert tuple(E.route_counts(e, rich).first()) == ("descending", 1, 2)
    assert e.where(E.crossing()).count() == 2
    edges = [(str(a), str(b)) for a in range(12) for b in range(12) if a != b and (a * b) % 5 < 2]
    frame = spark.createDataFrame(edges, "src string, dst string")
    degree = {str(k): sum(str(k) in x for x in edges) for k in range(12)}
    for r in E.rich_club(frame, spark.createDataFrame([(str(k),) for k in range(12)], "node string")).collect():
        above = {k for k, d in degree.items() if d > r["k"]}
        inside = sum(a in above and b in above for a, b in edges)
        assert (r["nodes_above"], r["edges_above"]) == (len(above), inside)
        assert r["phi"] == (pytest.approx(inside / (len(above) * (len(above) - 1))) if len(above) > 1 else None)


def test_rich_club_with_isolated_nodes(spark):
    """Nodes without an edge are in no span and add no row below 0."""
    nodes = spark.createDataFrame([(k,) for k in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    got = sorted((r["k"], r["nodes_above"], r["edges_above"]) for r in E.rich_club(edges, nodes).collect())
    assert got == [(0, 3, 3), (1, 3, 3), (2, 0, 0)]
    assert [(r["k"], r["nodes_above"]) for r in E.rich_club(edges.where("false"), nodes).collect()] == [(0, 0)]
    assert not E.rich_club(edges.where("false"), nodes.where("false")).collect()


def test_pair_histogram_counts_every_pair(spark):
    r = random.Random(1)
    n = spark.createDataFrame([(str(i), r.random() * 100, r.random() * 100, 0.0, "brain" if i < 25 else "vnc") for i in range(40)], "node string, x double, y double, z double, compartment string")
    got = {x[0]: x[1] for x in R.pair_histogram(n, 20.0).groupBy("category").agg(F.sum("pairs")).collect()}
    assert got == {"brain": 600, "vnc": 210, "cross": 750}


def test_pair_histogram_of_shared_places(spark):
    """Nodes of one place, and without one, against all pairs; only points meet, and no side of the join is broadcast."""
    r = random.Random(5)
    spots = [tuple(r.random() * 100 for _ in range(3)) for _ in range(12)] + [(None, 1.0, 1.0)]
    rows = [(str(i), *r.choice(spots), r.choice(["brain", "vnc", None])) for i in range(150)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0]:
                at = None if a[1] is None or b[1] is None else int(math.dist(a[1:4], b[1:4]) // 20)
                key = (at, (a[4] or "none") if a[4] == b[4] else "cross")
                want[key] = want.get(key, 0) + 1
    n = spark.createDataFrame(rows, "node string, x double, y double, z double, compartment string")
    assert {(x["bin"], x["category"]): x["pairs"] for x in R.pair_histogram(n, 20.0).collect()} == want
    plan = R.all_pairs(checkpointed(n, "n"), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nulls_and_p_values(spark):
    null = spark.createDataFrame([(0.3,), (0.2,), (0.1,), (0.1,)], "v double")
    p = lambda real: S.summarized(null, "v", spark.createDataFrame([(real,)], "real double")).first()["p_lower"]
    assert [p(0.1), p(0.05), p(0.25)] == [3 / 5, 1 / 5, 4 / 5]
    n = spark.createDataFrame([(str(i), float(i), 0.0, 0.0, i % 2) for i in range(20)], "node string, x double, y double, z double, g int").withColumn("draw_id", F.lit(1))
    moved = S.permutation(n, F.col("draw_id"), "g").collect()
    assert sorted(r["x"] for r in moved) == [float(i) for i in range(20)] and all(int(r["x"]) % 2 == r["g"] for r in moved)
    strata = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, s int")
    one = S.stratified(strata, "s", "k", 5)
    assert {r[1] for r in one.groupBy("s").count().collect()} == {5} and sorted(one.collect()) == sorted(S.stratified(strata.orderBy(F.desc("k")), "s", "k", 5).collect())


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0, 2.0, True), (2.0, 1.0, False), (2.0, 3.0, True), (4.0, 4.0, False)], "a double, b double, g boolean")
    ranks = {(r["a"], r["b"]): r["rank_a"] for r in A.average_ranks(rows, "a").collect()}
    assert ranks[2.0, 1.0] == ranks[2.0, 3.0] == 2.5
    assert T.spearman(rows, "a", "b").first()["rho"] == pytest.approx(0.6324555)
    u = T.mann_whitney(rows, "a", "g").first()
    assert (u["n1"], u["n2"], u["u"]) == (2, 2, 0.5)
    assert T.ks_distance(rows, "b", "g").first()["ks"] == 0.5
    parts = spark.createDataFrame([("0", "x")] * 3 + [("1", "y")] * 3, "p string, q string")
    assert tuple(T.partition_agreement(parts, "p", "q").first()) == (6, pytest.approx(1.0), pytest.approx(1.0))
    hubs = spark.createDataFrame([(i >= 90, i in (1, 2, 3, 95, 96, 97)) for i in range(100)], "h boolean, c boolean")
    f = T.fisher(hubs, "h", "c").first()
    assert f["odds_ratio"] == pytest.approx(3 * 87 / (7 * 3)) and f["p"] == pytest.approx(tails.hypergeometric_upper(3, 100, 6, 10))


def test_tails():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in [(0, 10, 0.1), (3, 40, 0.05), (30, 40, 0.7), (39, 40, 0.99)]:
        assert tails.binomial_cdf(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.normal_upper(1.96) == pytest.approx(0.0249979, abs=1e-6)
    assert tails.hypergeometric_upper(0, 50, 5, 10) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def ring(spark):
    """Two triangles with a bridge, directed, and an isolated node."""
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    return checkpointed(spark.createDataFrame(rows, "src string, dst string")), spark.createDataFrame([(x,) for x in "abcdefz"], "node string")


def test_searches(spark, ring):
    e, n = ring
    levels = {(r[0], r[1]): r[2] for r in G.search_levels(e, n.where("node = 'a'")).collect()}
    assert levels == {("a", x): k for k, x in enumerate("abcdef")}
    assert G.unreachable_from(e, n, n.where("node = 'd'")).count() == 4
    assert tuple(G.reachable_pairs(e, n.where("node in ('a', 'd')"), n.where("node in ('b', 'f')")).first()) == (3, 0.75)
    assert tuple(G.largest_component(e, n).first()) == (6, 2)
    path = spark.createDataFrame([("x", "y"), ("y", "w"), ("x", "w")], "src string, dst string").where("not (src = 'x' and dst = 'w')")
    eff = G.efficiency(G.search_levels(path, spark.createDataFrame([("x",)], "node string")), spark.createDataFrame([(3,)], "n long")).first()
    assert eff["efficiency"] == pytest.approx((1 + 0.5) / 2)


def test_clustering_and_communities(spark, ring):
    e, _ = ring
    c = G.clustering(e).first()
    assert c["triangles"] == 2 and c["mean_clustering"] == pytest.approx((1 + 1 + 1 / 3 + 1 / 3 + 1 + 1) / 6) and c["transitivity"] == pytest.approx(6 / 10)
    graph = G.undirected(e).select(F.col("a").alias("one"), F.col("b").alias("two"), F.lit(1.0).alias("wire"))
    parts = {r["node"]: r["community"] for r in C.communities(graph).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    m = C.modularity(graph, spark.createDataFrame(list(parts.items()), "node string, community string")).first()
    assert tuple(m) == (2, pytest.approx(2 * (6 / 14 - 0.25)))


def test_edge_betweenness(spark, ring):
    e, n = ring
    edges = [tuple(r) for r in e.collect()]
    want = dict.fromkeys(edges, 0.0)
    for s in "abcdef":
        dist, order, sigma = {s: 0}, [s], {s: 1.0}
        for v in order:
            for a, b in edges:
                if a == v:
                    if b not in dist:
                        dist[b] = dist[v] + 1
                        order.append(b)
                    if dist[b] == dist[v] + 1:
                        sigma[b] = sigma.get(b, 0) + sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for a, b in edges:
                if b == v and a in dist and dist[a] + 1 == dist[v]:
                    share = sigma[a] / sigma[v] * (1 + delta[v])
                    want[a, b] += share
                    delta[a] += share
    got = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(e, n).collect()}
    assert got == pytest.approx(want)


def test_rewiring_keeps_degrees(spark):
    r = random.Random(2)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(200)}
    rows = [(str(a), str(b), a + b + 1) for a, b in pairs if a != b]
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    new = [tuple(x) for x in G.rewired(e, 7).collect()]
    assert len({x[:2] for x in new}) == len(new) == len(rows) and all(a != b for a, b, _ in new)
    for i in (0, 1):
        assert sorted(x[i] for x in new) == sorted(x[i] for x in rows)
    assert sorted((a, w) for a, _, w in new) == sorted((a, w) for a, _, w in rows)
    assert len({x[:2] for x in new} - {x[:2] for x in rows}) > 0.5 * len(rows)


def test_reports(spark):
    frame = spark.createDataFrame([("a", 1.256, None)], "k string, v double, w string")
    assert markdown(frame).first()[0] == "| a | 1.256 |  |"
    assert formatted(frame, {"v": "%.2f"}).first()["v"] == "1.26"
    assert document(one=frame.select("k"), two=frame.select("v")).first()["one"] == '[{"k":"a"}]'
    with pytest.raises(Exception, match="broken"):
        build.checked(frame, F.col("v") > 2, "broken").collect()


def test_views_shuffle_connections_once(spark, tmp_path):
    """Edges of the views against plain ones, and their plans: no edge is sorted to be joined, connections are shuffled once."""
    from meshwork.sources import graph_views as V

    folder = "/root/testdata/sf0.001"
    raw = build.aggregate_edges(V.connections(spark, folder).toDF("src", "dst", "weight"))
    total = raw.groupBy("dst").agg(F.sum("weight").alias("all"))
    want = raw.join(total, "dst").where("src != dst and weight / all >= 0.01")
    assert sorted(map(tuple, V.fine_edges(spark, folder).select("src", "dst", "weight", "n_connections").collect())) == sorted(map(tuple, want.select("src", "dst", "weight", "n_connections").collect()))
    plain = V.with_ends(V.fine_edges(spark, folder), V.fine_nodes(spark, folder), ["x", "role", "region"])
    columns = ["src", "dst", "input_fraction", "src_x", "dst_x", "src_role", "dst_role", "src_region", "dst_region"]
    assert sorted(map(tuple, V.measured_edges(spark, folder).select(*columns).collect()), key=repr) == sorted(map(tuple, plain.select(*columns).collect()), key=repr)
    plan = V.fine_edges.__wrapped__(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "SortMergeJoin" not in plan  # lines, orders, connections


def test_measured_edges_travel_as_numbers(spark):
    """No text and no place of an end is shuffled with the edges; all columns of both ends are those of the nodes."""
    from meshwork.sources import graph_views as V

    folder, kept = "/root/testdata/sf0.001", ["compartment", "role", "superclass", "x", "y", "z", "region", "side", "cell_type"]
    found = V.measured_edges.__wrapped__(spark, folder, extra=("side", "cell_type"))

    def exchanges(plan):
        children = plan.children()
        below = [plan.inputPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [children.apply(i) for i in range(children.size())]
        return ([plan] if plan.nodeName() == "Exchange" else []) + [e for child in below for e in exchanges(child)]

    moved = [{e.output().apply(i).name(): e.output().apply(i).dataType().typeName() for i in range(e.output().size())} for e in exchanges(found._jdf.queryExecution().executedPlan())]
    edges = [m for m in moved if {"src", "dst"} <= set(m)]
    assert edges and all(set(m.values()) <= {"long", "integer", "byte"} for m in edges)
    columns = ["src", "dst", "weight", "input_fraction", *[f"{end}_{c}" for end in ("src", "dst") for c in kept]]
    want = V.with_ends(V.fine_edges(spark, folder), V.fine_nodes(spark, folder), kept).select(*columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_edges_are_shuffled_once_by_source(spark):
    """However large a table the planner would send, places of edges are looked up where the edges are; the table of edges is numbers."""
    from meshwork.sources import graph_views as V

    folder, name = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = V.measured_edges.__wrapped__(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("Exchange hashpartitioning(src#") == 2 and "vec_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert {k for _, k in V._measured(spark, folder, 0.01).dtypes} <= {"bigint", "int", "double"}
    assert V.edge_lengths(spark, folder).columns == [c for c in V.measured_edges(spark, folder).columns if c[4:] not in ("x", "y", "z")]


def test_written_tables_leave_no_shuffles(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, name = tracker.shuffleStatuses().size(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    table = checkpointed(spark.range(100).repartition(5).groupBy((F.col("id") % 9).alias("k")).count())
    assert table.count() == 9 and tracker.shuffleStatuses().size() <= before + 1  # that of the count
    assert spark.conf.get(name) == was
    files = table.inputFiles()
    given_back(table)
    assert not any(Path(f.removeprefix("file:")).exists() for f in (x.replace("///", "/") for x in files))
    assert spark.read.parquet(files[0].rsplit("/", 1)[0]).count() == 0


def test_area_graphs_keep_no_edges(spark, monkeypatch):
    """What is written for the area graph has a row a pair; strengths and the graph are those of the edges."""
    from meshwork.plans import analysis_queries as Q
    from meshwork.sources import graph_views as V

    folder, written = "/root/testdata/sf0.001", []
    edges = R.areas(V.edge_lengths(spark, folder))
    monkeypatch.setattr(Q, "checkpointed", lambda frame, name: written.append(checkpointed(frame, name)) or written[-1])
    pairs, graph = Q._regions(spark, folder)
    areas = pairs.select("one").union(pairs.select("two")).distinct().count()
    assert written and all(t.count() <= areas * (areas + 1) // 2 for t in written) and pairs.count() < edges.count()
    rows = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert rows(graph) == rows(R.region_graph(edges, dense=False)) and rows(R.strength_of_pairs(pairs)) == rows(R.region_strength(edges))


def test_pair_histogram_meets_places_once(spark, monkeypatch):
    """In blocks of three places, with odd coordinates, against all pairs as Spark makes them; each unordered pair of places is made once."""
    r = random.Random(11)
    odd = [(None, 1.0, 1.0), (None, None, None), (float("nan"), 1.0, 1.0), (float("inf"), 0.0, 0.0), (1e30, 0.0, 0.0), (3e7, 0.0, 0.0)]
    spots = [tuple(r.random() * 100 for _ in range(3)) for _ in range(14)] + odd
    rows = [(str(i), *spots[i % len(spots)], r.choice(["brain", "vnc", None])) for i in range(130)] + [(None, 1.0, 1.0, 1.0, "brain")]
    n = spark.createDataFrame(rows, "node string, x double, y double, z double, compartment string")
    monkeypatch.setattr(R, "PLACES", (2, 3))
    kind = F.when(F.col("src_c") == F.col("dst_c"), F.col("src_c")).otherwise("cross")
    pairs = R.all_pairs(n.where("node is not null").withColumn("c", F.coalesce("compartment", F.lit("none"))), ["x", "y", "z", "c"])
    want = pairs.groupBy(F.floor(X.distance("src_", "dst_") / 20.0).alias("bin"), kind.alias("category")).agg(F.count("*").alias("pairs"))
    got = R.pair_histogram(n, 20.0)
    assert sorted(map(tuple, got.select("bin", "category", "pairs").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
