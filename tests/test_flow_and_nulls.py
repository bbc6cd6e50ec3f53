"""Flow, paths, nulls, removal and document checks against brute force on small graphs."""

from __future__ import annotations

import itertools
import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshwork.operators import build, flow
from meshwork.operators import communities as C
from meshwork.operators import edges as E
from meshwork.operators import graph as G
from meshwork.operators import link_model as M
from meshwork.operators import regions as R
from meshwork.operators import robustness
from meshwork.operators import sampling as S
from meshwork.operators import swaps as W
from meshwork.sources import sinks


def brute_flow(edges, sources, targets):
    """Augmenting paths one at a time."""
    room = {}
    for a, b in edges:
        if a != b:
            room[a, b] = room.get((a, b), 0) + 1
            room.setdefault((b, a), 0)
    total = 0
    while True:
        came, queue = dict.fromkeys(sources), list(sources)
        for v in queue:
            for (a, b), c in room.items():
                if a == v and c > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        end = next((t for t in targets if t in came), None)
        if end is None:
            return total
        while came[end] is not None:
            room[came[end], end] -= 1
            room[end, came[end]] += 1
            end = came[end]
        total += 1


def test_max_flow(spark):
    r = random.Random(3)
    cases = {"none": ([("p", "q"), ("q", "p")], ["u"], ["v"]), "straight": ([("u", "v")] * 4 + [("u", "u")], ["u"], ["v"])}
    for i in range(6):
        edges = [(f"n{r.randrange(8 + i)}", f"n{r.randrange(8 + i)}") for _ in range(20 + 4 * i)]
        cases[f"random {i}"] = (edges, ["n0", "n1"][: 1 + i % 2], ["n6", "n7"])
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    e = table([(k, a, b) for k, (edges, *_) in cases.items() for a, b in edges], ("case", "src", "dst"))
    s, t = (table([(k, n) for k, c in cases.items() for n in c[i]], ("case", "node")) for i in (1, 2))
    got = {r["case"]: r["flow"] for r in flow.max_flow(e, s, t, ("case",)).collect()}
    assert got == {k: brute_flow(*c) for k, c in cases.items()} and max(got.values()) > 3
    with pytest.raises(ValueError, match="share a node"):
        flow.max_flow(e, s, s, ("case",))


def test_flow_after_removals(spark):
    """Each scenario against augmenting paths on its own graph; two pairs of sets, arcs removed once and more than once."""
    r = random.Random(8)
    edges = [(f"n{a}", f"n{b}") for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(70))]
    edges += [("n0", "n12")] * 2 + [("n3", "n4"), ("n4", "n3"), ("n3", "n4")]
    sets = {"one": (["n0", "n1"], ["n12", "n13"]), "two": (["n5"], ["n0", "n9"])}
    removed = {"nothing there": [("n0", "zz")], "loop": [("n2", "n2")], "all": edges, "twice": [("n0", "n12")] * 2, "thrice": [("n0", "n12")] * 3}
    for i in range(14):
        removed[f"draw {i}"] = r.sample(edges, 2 + 3 * i)
    removed["a target's"] = [e for e in edges if e[1] == "n13"]
    removed["a source's"] = [e for e in edges if e[0] == "n1"]
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    e = table([(k, *x) for k in sets for x in edges], ("metric", "src", "dst"))
    s, t = (table([(k, n) for k, c in sets.items() for n in c[i]], ("metric", "node")) for i in (0, 1))
    gone = table([(k, *x) for k, xs in removed.items() for x in xs], ("scenario", "src", "dst"))
    got = {(x["scenario"], x["metric"]): x["flow"] for x in flow.after_removals(flow.preflow(e, s, t, ("metric",)), gone).collect()}
    want = {}
    for name, xs in removed.items():
        left = list(edges)
        for x in xs:
            if x in left:
                left.remove(x)
        want |= {(name, k): brute_flow(left, *c) for k, c in sets.items()}
    assert got == want and len(set(want.values())) > 3
    alone = flow.after_removals(flow.preflow(e.where("metric = 'one'").drop("metric"), s.where("metric = 'one'"), t.where("metric = 'one'")), gone)
    assert {x["scenario"]: x["flow"] for x in alone.collect()} == {k: v for (k, m), v in want.items() if m == "one"}


def test_greedy_swaps(spark):
    r = random.Random(12)
    nodes = [(f"n{i:02}", *(r.uniform(0, 100) for _ in range(3)), "abc"[i % 3] if i else None, i % 5 != 4) for i in range(60)] + [("lost", None, 1.0, 1.0, "a", True)]
    edges = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(180)] + [("n01", "lost"), ("n01", "n04"), ("n04", "n01")]
    cost = lambda at: sum(round(math.dist(at[a], at[b]) * 1e6) for a, b in edges if a != b and "lost" not in (a, b)) / 1e6
    frame = spark.createDataFrame(nodes, "node string, x double, y double, z double, side string, movable boolean").repartition(3)
    places, steps = W.greedy_swaps(spark.createDataFrame(edges, "src string, dst string"), frame, "side", 6, 3)
    steps = steps.orderBy("round").collect()
    after = {p["node"]: (p["x"], p["y"], p["z"]) for p in places.collect()}
    before = {n[0]: n[1:4] for n in nodes}
    assert steps[0]["cost"] == pytest.approx(cost(before), abs=1e-3) and steps[-1]["cost"] == pytest.approx(cost(after), abs=1e-3)  # changes add up exactly
    assert all(b["cost"] < a["cost"] or b["accepted"] == 0 for a, b in zip(steps, steps[1:])) and steps[-1]["reduction"] > 0.05
    assert all(x["accepted"] <= x["improving"] <= x["proposed"] for x in steps)
    for g in ("a", "b", "c"):
        of = [n[0] for n in nodes if n[4] == g and n[5] and n[0] != "lost"]
        assert sorted(after[n] for n in of) == sorted(before[n] for n in of)
    assert all(after[n[0]] == n[1:4] for n in nodes if not n[5] or n[4] is None or n[0] == "lost")
    assert W.greedy_swaps(spark.createDataFrame([], "src string, dst string"), frame, "side", 1, 3)[1].count() == 2


def test_stable_partition(spark):
    """Planted blocks are found by most seeds; modularity is that of plain sums and no node's own move raises it."""
    r = random.Random(7)
    blocks = {f"v{i:02}": i % 4 for i in range(32)}
    pairs = [(a, b, 5.0 if blocks[a] == blocks[b] else 0.4) for a, b in itertools.combinations(blocks, 2) if r.random() < (0.8 if blocks[a] == blocks[b] else 0.3)]
    graph = spark.createDataFrame(pairs, "one string, two string, wire double")
    parts, tally = C.stable_partition(graph, 6, 1)
    found = {x["node"]: x["community"] for x in parts.collect()}
    assert all((found[a] == found[b]) == (blocks[a] == blocks[b]) for a, b in itertools.combinations(blocks, 2)) and all(found[v] == f"v{k:02}" for v, k in blocks.items())
    t = tally.first()
    assert t["seeds"] == 6 and t["seeds_agreeing"] >= 3 and t["distinct_partitions"] <= 4 and t["communities"] == 4
    m2 = 2 * sum(w for *_, w in pairs)

    def q(of):
        all_, inside = {}, 0
        for a, b, w in pairs:
            all_[of[a]] = all_.get(of[a], 0) + w
            all_[of[b]] = all_.get(of[b], 0) + w
            inside += 2 * w * (of[a] == of[b])
        return inside / m2 - sum((x / m2) ** 2 for x in all_.values())

    assert t["modularity"] == pytest.approx(q(found)) and tuple(C.modularity(graph, parts).first()) == (4, pytest.approx(q(found)))
    ring = [(f"r{i:02}", f"r{(i + 1) % 24:02}", 1.0) for i in range(24)]  # many levels, several best partitions
    each, score = C.partitions_by_seed(spark.createDataFrame(ring, "one string, two string, wire double"), 5, 2)
    assert each.count() == 5 * 24 and all(x["modularity"] > 0.55 for x in score.collect())
    parts, tally = C.stable_partition(graph.limit(0), 3, 1)
    assert parts.count() == tally.count() == 0


def test_partner_test(spark):
    r = random.Random(2)
    at = {f"n{i}": tuple(r.uniform(0, 10) + 100 * (i % 2) for _ in range(3)) for i in range(24)}
    nodes = spark.createDataFrame([(k, *v, "even" if int(k[1:]) % 2 == 0 else "odd") for k, v in at.items()] + [("lone", 0.0, 0.0, 0.0, "odd"), ("nowhere", None, None, None, "odd")], "node string, x double, y double, z double, kind string")
    edges = [(a, b) for a in at for b in at if a != b and (int(a[1:]) - int(b[1:])) % 2 == 0 and r.random() < 0.3] + [("n0", "nowhere")]
    scopes, per = S.partner_test(spark.createDataFrame(edges, "src string, dst string"), nodes, {"all": "true", "odd": "kind = 'odd'"}, 60, batch=25)
    got = {x["node"]: x for x in per.collect()}
    near = {k: [b for a, b in edges if a == k and b in at] + [a for a, b in edges if b == k] for k in at}
    for k, others in near.items():
        if others:
            mean = [sum(at[o][d] for o in others) / len(others) for d in range(3)]
            assert got[k]["partner_distance"] == pytest.approx(math.dist(at[k], mean))
    assert "lone" not in got and "nowhere" not in got
    close = [x["z"] for x in got.values() if x["z"] is not None]
    assert sum(z < 0 for z in close) > 0.9 * len(close)  # partners are on the own side, drawn ones on both
    rows = {x["scope"]: x for x in scopes.collect()}
    assert set(rows) == {"all", "odd"} and all(x["draws"] == 60 and x["ratio"] < 0.5 and x["p_lower"] == pytest.approx(1 / 61) for x in rows.values())
    assert rows["all"]["real"] == pytest.approx(sum(x["partner_distance"] for x in got.values()) / len(got))
    assert rows["all"]["null_mean"] == pytest.approx(sum(x["null_mean"] for x in got.values()) / len(got))


def test_small_world(spark):
    r = random.Random(4)
    pairs = {(min(i, j), max(i, j)) for i in range(20) for j in ((i + 1) % 20, (i + 2) % 20)} | {(1, 11), (4, 15)}
    graph = spark.createDataFrame([(f"a{a:02}", f"a{b:02}", float(r.randint(1, 9))) for a, b in pairs], "one string, two string, wire double")
    rows = {(x["null"], x["metric"]): x for x in G.small_world(graph, 8, 3).collect()}
    assert len(rows) == 12
    assert rows["rewired", "clustering"]["ratio"] > 1.5 and rows["rewired", "sigma"]["ratio"] == pytest.approx(rows["rewired", "clustering"]["ratio"] / rows["rewired", "path"]["ratio"])
    same = rows["weights shuffled", "clustering"]
    assert same["null_sd"] == pytest.approx(0, abs=1e-12) and same["ratio"] == pytest.approx(1) and same["p"] == 1.0
    assert rows["weights shuffled", "weighted_path"]["null_sd"] > 0 and rows["rewired", "path"]["low"] <= rows["rewired", "path"]["null_mean"] <= rows["rewired", "path"]["high"]
    real = G.network_metrics(graph).first()
    assert real["path"] == pytest.approx(rows["rewired", "path"]["real"])
    turned = G.rewired(graph.select("one", "two", F.lit(1).alias("k")).withColumnsRenamed({"one": "src", "two": "dst"}), 5, ("k",), undirected=True).collect()
    count = lambda es: sorted((sum(n in e for e in es)) for n in {x for e in es for x in e})
    new = [(x["src"], x["dst"]) for x in turned]
    assert all(a < b for a, b in new) and len(set(new)) == len(pairs) and count(new) == count([(f"a{a:02}", f"a{b:02}") for a, b in pairs])


def test_routes_of_several_graphs(spark):
    """Rich nodes by compartment, of different richness, and routes of each graph, by counting."""
    r = random.Random(6)
    rank = {f"b{i}": ("none", "brain") for i in range(12)} | {f"v{i}": ("none", "vnc") for i in range(12)} | {f"d{i}": ("descending", None) for i in range(4)} | {f"a{i}": ("ascending", "brain") for i in range(4)}
    names = list(rank)
    edges = {(a, b) for a in names for b in names if a != b and r.random() < (0.5 if a[0] == b[0] == "b" else 0.25)}
    nodes = spark.createDataFrame([(k, *v) for k, v in rank.items()], "node string, role string, compartment string")
    from meshwork.sources.graph_views import with_ends

    measured = with_ends(spark.createDataFrame(sorted(edges), "src string, dst string"), nodes, ["role", "compartment"])
    richness = {k: sum(k in e and all(rank[x][0] == "none" for x in e) for e in edges) for k in names}
    import numpy as np

    for top in (0.1, 0.3):
        cut = {s: np.quantile([richness[k] for k in names if rank[k] == ("none", s)], 1 - top) for s in ("brain", "vnc")}
        assert cut["brain"] != cut["vnc"]
        rich = {k for k in names if rank[k][0] == "none" and richness[k] >= cut[rank[k][1]]}
        assert {x["node"] for x in E.rich_mask(measured, nodes, top).where("rich").collect()} == rich
        want = {}
        for role, (one, two) in {"descending": ("brain", "vnc"), "ascending": ("vnc", "brain")}.items():
            hubs = [k for k in names if rank[k][0] == role]
            want[role] = sum(sum((p, h) in edges for p in rich if rank[p][1] == one) * sum((h, p) in edges for p in rich if rank[p][1] == two) for h in hubs)
        got = {x["role"]: x["routes"] for x in E.routes_by(measured.withColumn("layer", E.layer()).where("layer is not null").select(F.lit(0).alias("graph"), "layer", "src", "dst"), E.rich_at(measured, nodes, [top]), "graph").collect()}
        assert {k: got.get(k, 0) for k in want} == want and got["total"] == sum(want.values()) > 0


def test_threshold_verdicts(spark):
    """Each fraction's row equals that fraction's graph done alone, by the single-graph operators and by counting."""
    from meshwork.sources.graph_views import with_ends

    r = random.Random(16)
    rank = {f"b{i}": ("none", "brain") for i in range(14)} | {f"v{i}": ("none", "vnc") for i in range(14)} | {f"d{i}": ("descending", None) for i in range(4)} | {f"a{i}": ("ascending", "brain") for i in range(4)} | {"x": ("none", None)}
    at = {k: tuple(r.random() * 9 + 20 * (k[0] == "v") for _ in "xyz") for k in rank}
    near = lambda a, b: math.dist(at[a], at[b]) < 14
    rows = [(a, b, r.choice([0.01, 0.03, 0.2])) for a in rank for b in rank if "x" not in (a, b) and a != b and r.random() < (0.95 if rank[a][0] != rank[b][0] else 0.35 if near(a, b) else 0.05)]
    nodes = spark.createDataFrame([(k, *v, *at[k]) for k, v in rank.items()], "node string, role string, compartment string, x double, y double, z double")
    e = spark.createDataFrame(rows, "src string, dst string, input_fraction double")
    measured = with_ends(e, nodes, ["role", "compartment", "x", "y", "z"]).withColumn("length", F.sqrt(sum((F.col(f"src_{k}") - F.col(f"dst_{k}")) ** 2 for k in "xyz")))
    got = {(x["fraction"], x["finding"]): x for x in robustness.threshold_verdicts(measured, nodes, [0.1, 0.01, 0.5], 25, 12, 0.3, seed=5).collect()}
    assert {k[1] for k in got} == {"placement", "hubs", "routes total", "routes descending", "routes ascending"} and len(got) == 15
    for f in (0.01, 0.1):
        part = measured.where(F.col("input_fraction") >= f)
        kept = [x for x in rows if x[2] >= f]
        one, null = got[f, "placement"], [x["wire"] for x in S.placement_null(part, nodes, 25, seed=5).collect()]
        assert one["real"] == pytest.approx(sum(math.dist(at[a], at[b]) for a, b, _ in kept), abs=1e-3) and one["null_mean"] == pytest.approx(sum(null) / 25)
        assert one["p"] == pytest.approx((1 + sum(x <= one["real"] for x in null)) / 26) and one["holds"] == (one["p"] < 0.05 and min(null) > one["real"])
        want = {x["role"]: x["routes"] for x in E.route_counts(part, E.rich_mask(part, nodes, 0.3)).collect()}
        assert {k: got[f, f"routes {k}"]["real"] for k in want} == want and got[f, "routes total"]["real"] == sum(want.values()) > 0
        degree = {k: sum(k in x[:2] for x in kept) for k in rank}
        cut = sorted(degree.values())
        place = 0.9 * (len(cut) - 1)
        cut = cut[int(place)] + (place - int(place)) * (cut[math.ceil(place)] - cut[int(place)])
        t = [[sum((degree[k] >= cut) == h and (rank[k][0] != "none") == c for k in rank) for c in (True, False)] for h in (True, False)]
        (a, b), (c, d) = t
        p = sum(math.comb(a + c, i) * math.comb(b + d, a + b - i) for i in range(a, min(a + c, a + b) + 1)) / math.comb(len(rank), a + b)
        hubs = got[f, "hubs"]
        assert hubs["p"] == pytest.approx(p) and hubs["holds"] == (a * d > b * c and p < 0.05) and (hubs["real"] == pytest.approx(a * d / (b * c)) if b * c else hubs["real"] is None)
    assert got[0.01, "placement"]["holds"] and got[0.01, "hubs"]["holds"]
    assert not any(got[0.5, k]["holds"] for k in ("placement", "hubs", "routes total", "routes descending")) and got[0.5, "placement"]["real"] == 0 == got[0.5, "routes total"]["real"]


def test_paths_and_metrics(spark):
    r = random.Random(5)
    pairs = [(a, b, float(r.randint(1, 9))) for a, b in itertools.combinations("abcdef", 2) if r.random() < 0.6]
    graph = spark.createDataFrame(pairs, "one string, two string, wire double")
    nodes = sorted({x for p in pairs for x in p[:2]})
    cost = {(a, b): math.inf for a in nodes for b in nodes}
    most = max(w for *_, w in pairs)
    step = dict.fromkeys(cost, math.inf)
    for a, b, w in pairs:
        cost[a, b] = cost[b, a] = most / w
        step[a, b] = step[b, a] = 1
    for k, a, b in itertools.product(nodes, repeat=3):
        for d in (cost, step):
            d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    wire = {(a, b): w for a, b, w in pairs} | {(b, a): w for a, b, w in pairs}
    plain, weighted = [], []
    for v in nodes:
        near = [u for u in nodes if (v, u) in wire]
        closed = [(x, y) for x, y in itertools.combinations(near, 2) if (x, y) in wire]
        k = len(near)
        plain.append(2 * len(closed) / (k * (k - 1)) if k > 1 else 0)
        weighted.append(sum(wire[v, x] + wire[v, y] for x, y in closed) / (sum(wire[v, u] for u in near) * (k - 1)) if k > 1 else 0)
    mean = lambda d: (lambda x: sum(x) / len(x))([c for (a, b), c in d.items() if a != b and c < math.inf])
    got = G.network_metrics(graph).first()
    want = (len(nodes), sum(plain) / len(nodes), sum(weighted) / len(nodes), mean(step), mean(cost))
    assert tuple(got) == pytest.approx(want)
    dealt = G.redealt(graph, 4).collect()
    assert sorted((x["one"], x["two"]) for x in dealt) == sorted(p[:2] for p in pairs) and sorted(x["wire"] for x in dealt) == sorted(p[2] for p in pairs)


def test_rewiring_inside_layers(spark):
    r = random.Random(2)
    rows = sorted({(f"{k}{r.randrange(12)}", f"{k}t{r.randrange(12)}", k) for k in "pq" for _ in range(60)})
    e = spark.createDataFrame([(*x, 1) for x in rows], "src string, dst string, layer string, weight long")
    new = [tuple(x) for x in G.rewired(e, 1, ("layer",), rounds=3).select("src", "dst", "layer").collect()]
    assert all(a[0] == b[0] == k for a, b, k in new) and len(set(new)) == len(rows) and set(new) != set(rows)
    for i in (0, 1):
        assert sorted(x[i] for x in new) == sorted(x[i] for x in rows)


def test_removal_curve(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "f")]
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    ran = spark.createDataFrame([("one", i + 1, a, b) for i, (a, b) in enumerate(rows)] + [("two", 5 - i, a, b) for i, (a, b) in enumerate(rows)], "schedule string, nth int, src string, dst string")
    cuts = spark.createDataFrame([("one", 0.0, 0), ("one", 0.5, 2), ("two", 0.5, 2), ("two", 1.0, 5)], "schedule string, share double, cut int")
    got = {(r["schedule"], r["share"]): (r["largest"], round(r["efficiency"], 6)) for r in G.removal_curve(ran, nodes, cuts, nodes.where("node in ('a', 'e')")).collect()}
    # a reaches b, d in one and c in two steps, e reaches f in one; means over 2 roots and 5 other nodes
    assert got == {("one", 0.0): (4, 0.35), ("one", 0.5): (3, 0.2), ("two", 0.5): (4, round((1 + 1 / 2 + 1 / 3) / 10, 6)), ("two", 1.0): (1, 0.0)}


def test_nulls(spark):
    r = random.Random(9)
    nodes = spark.createDataFrame([(f"n{i}", "ab"[i % 2], *(r.random() for _ in range(3))) for i in range(30)], "node string, region string, x double, y double, z double")
    many = nodes.withColumn("draw_id", F.explode(F.array(F.lit(1), F.lit(2))))
    placed = S.permutation(many, F.col("draw_id"), "region").collect()
    home = {(x["region"], x["x"]) for x in nodes.collect()}
    assert len(placed) == 60 and all((p["region"], p["x"]) in home for p in placed) and len({(p["draw_id"], p["x"]) for p in placed}) == 60
    edges = [(f"n{a}", f"n{b}") for a, b in itertools.permutations(range(30), 2) if r.random() < 0.3]
    measured = spark.createDataFrame(edges, "src string, dst string").join(nodes.selectExpr("node src", "region src_region", "x ax", "y ay", "z az"), "src").join(nodes.selectExpr("node dst", "region dst_region", "x bx", "y by", "z bz"), "dst")
    measured = measured.withColumn("length", F.expr("sqrt((ax-bx)*(ax-bx)+(ay-by)*(ay-by)+(az-bz)*(az-bz))"))
    got = {x["region"]: x for x in S.inner_placement_null(measured, nodes, "region", 60, least_edges=1).collect()}
    assert set(got) == {"a", "b"} and all(abs(x["ratio"] - 1) < 0.1 and abs(x["z"]) < 4 and x["members"] == 15 for x in got.values())
    assert not S.inner_placement_null(measured, nodes, "region", 3, least_members=16).collect()
    dense = spark.createDataFrame(edges, "src string, dst string")
    free = 30 * 29 - len(edges)
    found = {tuple(x) for x in S.non_edges(dense, nodes, free).collect()}
    assert len(found) == free and not found & set(edges) and all(a != b for a, b in found)
    with pytest.raises(ValueError, match="no edges"):
        S.non_edges(dense, nodes, free + 1)
    cut = S.removal_draws(dense, 3, F.lit(7)).groupBy("draw_id").count().collect()
    assert {x["count"] for x in cut} == {7} and len(cut) == 3


def test_enrichment_has_the_hypergeometric_mean(spark):
    rows = [("h1", "in", 10, 20, 100), ("h2", "in", 5, 20, 100), ("h2", "out", 8, 50, 60)]
    frame = spark.createDataFrame(rows, "node string, layer string, degree long, rich long, eligible long")
    null = [x["share"] for x in S.enrichment_null(frame, 2000).collect()]
    want = sum(d * k / n for *_, d, k, n in rows) / sum(x[2] for x in rows)
    assert len(null) == 2000 and sum(null) / 2000 == pytest.approx(want, rel=0.02)
    assert sorted(null) == sorted(x["share"] for x in S.enrichment_null(frame.repartition(3), 2000).collect())


def test_samples_of_counted_places(spark):
    """Samples of n rows and of n non-edges are the first by draw, whatever the partitions; too many asked is all or an error."""
    rows = [(f"s{i % 23}", f"t{i // 23}", i) for i in range(300)]
    table = spark.createDataFrame(rows, "src string, dst string, nth int")
    keyed = table.withColumn("u", S.draw(4, F.col("src"), F.col("dst"))).collect()
    want = {(x["src"], x["dst"]) for x in sorted(keyed, key=lambda x: (x["u"], x["src"], x["dst"]))[:120]}
    for parts in (1, 7):
        got = S.count_matched(table.repartition(parts), 120, "src", "dst", seed=4)
        assert got.columns == table.columns and {(x["src"], x["dst"]) for x in got.collect()} == want
    assert S.count_matched(table, 1000, "src", "dst").count() == 300 and S.count_matched(table, 0, "src", "dst").count() == 0
    names = [f"k{i:02}" for i in range(12)]
    nodes = spark.createDataFrame([(k,) for k in names], "node string")
    edges = {(a, b) for a in names for b in names if a != b and (ord(a[2]) + ord(b[1])) % 3}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    free = 12 * 11 - len(edges)
    for n in (5, free):
        found = [tuple(x) for x in S.non_edges(frame, nodes, n, 8).collect()]
        assert len(found) == len(set(found)) == n and not edges & set(found) and all(a != b for a, b in found)
    with pytest.raises(ValueError, match="asked"):
        S.non_edges(frame, nodes, free + 1, 8)


def test_shift_and_nearest(spark):
    r = random.Random(1)
    logits = [r.gauss(-1, 2) for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in logits], "logit double")
    shift = M.solved_shift(M.logit_histogram(frame), 120.0)
    assert sum(1 / (1 + math.exp(-(x + shift))) for x in logits) == pytest.approx(120, abs=0.2)
    surface = [(i, *(r.uniform(0, 50) for _ in range(3))) for i in range(80)]
    points = [(f"n{i}", *(r.uniform(-30, 90) for _ in range(3))) for i in range(60)] + [("far", 900.0, 0.0, -700.0), ("unknown", None, 1.0, 1.0)]
    got = {x["node"]: (x["region"], round(x["region_distance"], 9)) for x in R.nearest_region(spark.createDataFrame(points, "node string, x double, y double, z double"), spark.createDataFrame(surface, "region int, x double, y double, z double")).collect()}
    dist = lambda p, s: math.dist(p[1:], s[1:])
    want = {p[0]: min((dist(p, s), s[0]) for s in surface) for p in points if p[1] is not None}
    assert got == {k: (region, round(d, 9)) for k, (d, region) in want.items()}
    pairs = R.all_pairs(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "node string, k int"), ["k"]).collect()
    assert sorted((x["src"], x["dst"], x["src_k"], x["dst_k"]) for x in pairs) == sorted((a, b, i, j) for (a, i), (b, j) in itertools.permutations([("a", 1), ("b", 2), ("c", 3)], 2))


def test_documents(spark):
    one = spark.createDataFrame([("a", "1.0"), ("b.c", "x"), ("gone", "2")], "path string, value string")
    two = spark.createDataFrame([("a", "1.0000000001"), ("b.c", "y"), ("new", "3")], "path string, value string")
    assert {x["path"] for x in sinks.differences(one, two).collect()} == {"b.c", "gone", "new"}
    with pytest.raises(ValueError, match="more than"):
        sinks.document(limit=2, many=spark.range(3))
    twice = spark.createDataFrame([("k", 1), ("k", 2)], "key string, v int")
    with pytest.raises(Exception, match="not unique"):
        build.joined_once(twice.select("key").distinct(), twice, "key").collect()


def test_document_differences_of_large_counts(spark, tmp_path):
    """One part more is a difference, however many parts there are."""
    from meshwork.plans.report_queries import document_differences

    few = {"nation": "id n_nationkey, 0L n_regionkey", "supplier": "id s_suppkey, id s_nationkey", "customer": "id c_custkey, id c_nationkey"}
    for name, columns in few.items():
        spark.range(3).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(1_300_000).selectExpr("id p_partkey", "'Brand#11' p_brand", "'A' p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(x) for x in document_differences(spark, str(tmp_path)).collect()}
    assert got == {("kinds.P", "1300000", "1300001"), ("only", None, "x")}


def test_placement_null_shuffles_no_row_a_draw(spark):
    """Wires of dealt places against a permutation worked out row by row; the draws of an edge are made after the last shuffle of
    edges, so the plan shuffles only edges, nodes and partial sums."""
    r = random.Random(8)
    spots = [tuple(r.uniform(0, 50) for _ in range(3)) for _ in range(6)] + [(None, 1.0, 2.0)]
    rows = [(f"n{i:02}", *r.choice(spots), "ab"[i % 2]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node string, x double, y double, z double, g string")
    edges = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(120)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    many = nodes.withColumn("draw_id", F.explode(F.sequence(F.lit(1), F.lit(4))))
    at = {(x["draw_id"], x["node"]): (x["x"], x["y"], x["z"]) for x in S.permutation(many, F.col("draw_id"), "g", seed=3).collect()}
    far = lambda p, q: round(math.dist(p, q) * 1e6) if None not in (*p, *q) else 0
    null = S.placement_null(frame, nodes, 4, "g", seed=3)
    assert {x["draw_id"]: x["wire"] for x in null.collect()} == {d: pytest.approx(sum(far(at[d, a], at[d, b]) for a, b in edges) / 1e6) for d in range(1, 5)}
    plan = null._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "draw_id" not in plan[plan.index("Generate posexplode") :]


def test_partner_draws_are_not_shuffled(spark, monkeypatch):
    """Partners drawn anew are added up where their node is; nodes of one place share a run of numbers."""
    plans = []

    def watched(frame, name="table", checkpointed=S.checkpointed):
        if name == "drawn":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return checkpointed(frame, name)

    monkeypatch.setattr(S, "checkpointed", watched)
    nodes = spark.createDataFrame([(f"n{i:02}", float(i % 3), 0.0, 0.0) for i in range(30)], "node string, x double, y double, z double")
    edges = spark.createDataFrame([("n00", f"n{i:02}") for i in range(1, 30)], "src string, dst string")
    per = {x["node"]: x for x in S.partner_test(edges, nodes, {"all": "true"}, 400, batch=400)[1].collect()}
    assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0][: plans[0].index("Generate")]
    # n00 is at 0; of the 29 other nodes 9 are there, 10 at 1 and 10 at 2. n01 has one partner and is at 1: 19 others are 1 away.
    assert per["n00"]["null_mean"] == pytest.approx(30 / 29, abs=0.05) and per["n01"]["null_mean"] == pytest.approx(20 / 29, abs=0.1)


def test_traded_graphs(spark):
    """Trades keep degrees and simple graphs, leave groups apart, cross blocks, and bring up all graphs of the degrees alike."""
    from collections import Counter

    from meshwork.operators import trades

    # Targets 0 to 2 under three sources, one each in group p (6 graphs), two each in q (6 graphs too).
    rows = [("p", f"s{i}", i) for i in range(3)] + [("q", f"s{i}", j) for i in range(3) for j in range(3) if i != j]
    small = trades.traded(spark.createDataFrame(rows, "k string, src string, dst long"), 600, 4, ("k",)).collect()
    for k, size in (("p", 1), ("q", 2)):
        lists = sorted((x["src"], x["ends"]) for x in small if x["k"] == k)
        graphs = [tuple(tuple(sorted(ends[d * size : (d + 1) * size])) for _, ends in lists) for d in range(601)]
        assert graphs[0] == tuple(tuple(sorted(r[2] for r in rows if r[:2] == (k, s))) for s, _ in lists)
        times = Counter(graphs[1:])
        assert len(times) == 6 and all(60 < n < 140 for n in times.values())
    # Sources outnumber a block.
    r, was = random.Random(3), trades.BLOCK
    wide = sorted({(f"s{r.randrange(40):02}", r.randrange(60)) for _ in range(500)})
    trades.BLOCK = 64
    try:
        got = trades.traded(spark.createDataFrame(wide, "src string, dst int"), 4, 1).collect()
    finally:
        trades.BLOCK = was
    for d in range(5):
        edges = [(x["src"], t) for x in got for t in x["ends"][d * len(x["ends"]) // 5 : (d + 1) * len(x["ends"]) // 5]]
        assert len(set(edges)) == len(wide) and all(Counter(e[i] for e in edges) == Counter(e[i] for e in wide) for i in (0, 1))
        assert set(edges) == set(wide) if not d else len(set(edges) & set(wide)) < len(wide) / 2
    assert not trades.traded(spark.createDataFrame([], "src string, dst int"), 3, 1).collect()


def test_route_nulls(spark):
    """Routes of the given graph are those of ``routes_by``; those of the draws come from graphs of the same degrees."""
    from meshwork.operators import trades

    r = random.Random(8)
    rows = [(g, layer, a, b) for g in (1, 2) for layer, one, two in (("brain-descending", "b", "d"), ("descending-vnc", "d", "v"), ("vnc-ascending", "v", "a"), ("ascending-brain", "a", "b")) for a in (f"{one}{i}" for i in range(8)) for b in (f"{two}{i}" for i in range(8)) if r.random() < 0.4]
    layers = spark.createDataFrame(rows, "g int, layer string, src string, dst string")
    rich = {(g, f"{k}{i}"): [x for x in (0, 1) if i < (5, 2)[x]] for g in (1, 2) for k in "bv" for i in range(8)}
    rich = spark.createDataFrame([(g, n, at) for (g, n), at in rich.items() if at], "g int, node string, rich array<int>")
    got = {(x["g"], x["draw"], x["i"], x["role"]): x["routes"] for x in trades.route_nulls(layers, rich, [0.5, 0.2], 30, 2, ("g",)).collect()}
    want = {(x["g"], 0, x["i"], x["role"]): x["routes"] for x in E.routes_by(layers.withColumn("draw", F.lit(0)), rich, "draw", "g").collect()}
    assert len(want) == 12 and {k: v for k, v in got.items() if k[1] == 0} == want
    assert len(got) == 12 * 31 and all(len({got[g, d, 0, "total"] for d in range(1, 31)}) > 5 for g in (1, 2))
    assert all(got[g, d, i, "total"] == got[g, d, i, "descending"] + got[g, d, i, "ascending"] for g in (1, 2) for d in range(31) for i in (0, 1))


def test_bucketed(spark):
    """A join on the bucket column shuffles the other table alone."""
    rows = spark.range(40).select((F.col("id") % 7).cast("string").alias("node"), "id")
    table = sinks.bucketed(rows, "node")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    joined = table.join(rows.select("node", F.col("id").alias("other")).hint("merge"), "node")
    assert joined.count() == sum(sum(i % 7 == k for i in range(40)) ** 2 for k in range(7))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_draws_in_stretches_give_their_tables_back(spark, monkeypatch):
    """Placements and rewired layers come in stretches of draws; what a stretch writes on the way is gone when it ends."""
    from meshwork.operators import trades

    folder = Path(sinks.shared_folder(spark).removeprefix("file:").replace("///", "/"))
    full = lambda: {p.parent.name for p in folder.glob("*/*.parquet") if p.stat().st_size and pq.read_metadata(p).num_rows}
    r = random.Random(9)
    nodes = spark.createDataFrame([(f"n{i:02}", *(r.uniform(0, 50) for _ in "xyz")) for i in range(30)], "node string, x double, y double, z double")
    edges = spark.createDataFrame([(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}", i % 2) for i in range(80)], "src string, dst string, level int")
    want = sorted(map(tuple, S.placement_null(edges, nodes, 20, by=("level",)).collect()))
    layers = spark.createDataFrame([(layer, f"{one}{i}", f"{two}{j}") for layer, one, two in (("brain-descending", "b", "d"), ("descending-vnc", "d", "v")) for i in range(9) for j in range(9) if r.random() < 0.5], "layer string, src string, dst string")
    rich = spark.createDataFrame([(f"{k}{i}", [0]) for k in "bv" for i in range(4)], "node string, rich array<int>")
    real = E.routes_by(layers.withColumn("draw", F.lit(0)), rich, "draw").where("role = 'total'").first()["routes"]
    monkeypatch.setattr(S, "CELLS", 1)
    monkeypatch.setattr(trades, "CELLS", 1)
    before = full()
    assert sorted(map(tuple, S.placement_null(edges, nodes, 20, by=("level",)).collect())) == want
    got = {x["draw"]: x["routes"] for x in trades.route_nulls(layers, rich, [0.5], 10, 3).where("role = 'total'").collect()}
    assert set(got) == set(range(11)) and got[0] == real and len(set(got.values())) > 3
    assert not {n.rsplit("-", 1)[0] for n in full() - before} & {"traded", "lists", "counts", "placed", "sizes"}
