"""Power-law cutoffs and exponential fits against plain searches."""

from __future__ import annotations

import math
import random

import pytest

from meshwork.operators import stats as T


def test_power_law_scan(spark):
    r = random.Random(4)
    values = [r.uniform(1, 20) for _ in range(300)] + [20 * (1 - r.random()) ** (-1 / 1.6) for _ in range(400)]
    rounded = sorted(float(math.floor(v + 0.5)) for v in values)
    best = None
    for cut in sorted(set(rounded)):
        tail = [v for v in rounded if v >= cut]
        logs = sum(math.log(v / cut) for v in tail)
        if len(tail) < 50 or logs <= 0:
            continue
        alpha = 1 + len(tail) / logs
        ks = max(abs(sum(x <= v for x in tail) / len(tail) - (1 - (v / cut) ** (1 - alpha))) for v in set(tail))
        if best is None or (ks, cut) < best[:2]:
            best = ks, cut, alpha, len(tail)
    got = T.power_law_scan(spark.createDataFrame([(v,) for v in values], "length double"), "length").first()
    assert (got["ks"], got["cut"], got["alpha"], got["tail"]) == pytest.approx(best)
    with pytest.raises(ValueError, match="distinct"):
        T.power_law_scan(spark.createDataFrame([(float(i),) for i in range(40)], "length double"), "length", most=10)


def test_exponential_fit(spark):
    r = random.Random(6)
    exact = [(20.0 * k, 0.3 * math.exp(-20.0 * k / 76)) for k in range(40)]
    got = T.exponential_fit(spark.createDataFrame(exact, "x double, y double"), "x", "y").first()
    assert tuple(got) == pytest.approx((0.3, 76.0))
    noisy = [(x, max(y + r.gauss(0, 0.01), -1)) for x, y in exact]
    a, scale = T.exponential_fit(spark.createDataFrame(noisy, "x double, y double"), "x", "y").first()
    loss = lambda a, s: sum((y - a * math.exp(-x / s)) ** 2 for x, y in noisy if y > 0)
    assert all(loss(a, scale) <= loss(a * p, scale * q) for p in (0.999, 1, 1.001) for q in (0.999, 1, 1.001))
    assert T.exponential_fit(spark.createDataFrame([(1.0, -1.0)], "x double, y double"), "x", "y").count() == 0


def test_tail_comparison(spark):
    """Against numeric integration of each density and a plain search of its parameters."""
    import numpy as np

    from meshwork.functions import likelihoods

    r = random.Random(11)
    xs = np.array([max(30.0, round(30 * math.exp(abs(r.gauss(0, 0.9))))) for _ in range(800)])
    got = {row["alternative"]: row for row in T.tail_comparison(spark.createDataFrame([(float(x),) for x in xs], "length double"), "length", 30.0).collect()}
    x = xs / 30
    y = np.log(x)
    alpha = 1 + 1 / y.mean()
    power = math.log(alpha - 1) - alpha * y
    found = {"lognormal": likelihoods.lognormal(y.mean(), (y * y).mean()), "exponential": likelihoods.exponential(x.mean()), "truncated_power_law": likelihoods.truncated_power_law(y.mean(), x.mean(), alpha)}
    u = np.linspace(0, 60, 2_000_001)
    for name, c in found.items():
        density = lambda y, c=c: c[0] + c[1] * y + c[2] * y * y + c[3] * np.exp(np.minimum(y, 300))
        assert abs(np.trapezoid(np.exp(density(u) + u), u) - 1) < 1e-6, name  # a density in x
        like = density(y)
        for k in (1, 2, 3):  # no neighbour is likelier, when it is made a density
            for off in (-1e-3, 1e-3):
                if c[k]:
                    near = c.copy()
                    near[k] *= 1 + off
                    raw = lambda y, n=near: n[1] * y + n[2] * y * y + n[3] * np.exp(np.minimum(y, 300))
                    total = math.log(np.trapezoid(np.exp(raw(u) + u), u))
                    assert (raw(y) - total).sum() <= like.sum() + 1e-7, (name, k)
        d = power - like
        ratio = d.sum() / math.sqrt(len(d) * d.var())
        p = math.erfc(math.sqrt(abs(d.sum()))) if name == "truncated_power_law" else math.erfc(abs(ratio) / math.sqrt(2))
        assert (got[name]["ratio"], got[name]["p"], got[name]["tail"]) == (pytest.approx(ratio, rel=1e-6), pytest.approx(p, rel=1e-5, abs=1e-12), 800)
    assert T.tail_comparison(spark.createDataFrame([], "length double"), "length").count() == 0
    assert T.tail_comparison(spark.createDataFrame([(3.0,)] * 90, "length double"), "length", 3.0).count() == 0


def test_quantiles_and_ranks(spark):
    """Against numpy and plain counting, with a value that most rows have, nulls and a group of one."""
    import numpy as np
    from pyspark.sql import functions as F

    from meshwork.operators import analytic as A

    r = random.Random(3)
    rows = [(g, None if r.random() < 0.05 else (0.0 if r.random() < 0.4 else round(r.gauss(0, 5), 3))) for g in ["a", "b", None, "c"] for _ in range(157)] + [("one", 4.5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"low": 0.0, "third": 1 / 3, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {row["g"]: tuple(row)[1:] for row in A.quantiles(frame, "v", wanted, "g").collect()}
    assert set(got) == {"a", "b", None, "c", "one"}
    for g, found in got.items():
        assert found == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], list(wanted.values())))
    assert tuple(A.quantiles(frame, "v", wanted).first()) == pytest.approx(np.quantile([v for _, v in rows if v is not None], list(wanted.values())))
    assert A.quantiles(frame.limit(0), "v", wanted).first()["median"] is None
    sums = A.with_quantiles(frame.groupBy("g").agg(F.count("*").alias("n")), frame, "v", {"median": 0.5}, "g").collect()
    assert {x["g"]: x["median"] for x in sums} == {"none": None} | {g: pytest.approx(f[2]) for g, f in got.items()}
    for x in A.rank_among(frame, "v", "g").collect():
        peers = [v for h, v in rows if h == x["g"] and v is not None]
        if x["v"] is None:
            assert x["rank"] is None
        else:
            assert x["rank"] == 1 + sum(v > x["v"] for v in peers) and x["share_below"] == pytest.approx(sum(v < x["v"] for v in peers) / max(len(peers) - 1, 1))


def test_selected_quantiles(spark, monkeypatch):
    """Against numpy, with nulls, groups of one value, infinite values and NaN; only rows near a wanted place are counted."""
    import numpy as np
    from pyspark.sql import functions as F

    from meshwork.operators import analytic as A

    r = random.Random(4)
    rows = [(g, None if r.random() < 0.05 else r.gauss(0, 5)) for g in ("a", None) for _ in range(3000)] + [("one", 4.5), ("none", None)]
    rows += [("same", 2.0)] * 5 + [("wide", v) for v in (1.0, 2.0, 7.0, float("inf"))] + [("nan", v) for v in (3.0, 1.0, float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"low": 0.0, "third": 1 / 3, "median": 0.5, "high": 0.75}
    met, plain = [], A.cumulative
    monkeypatch.setattr(A, "cumulative", lambda f, *a: met.append(f.count()) or plain(f, *a))
    got = {row["g"]: tuple(row)[1:] for row in A.selected_quantiles(frame, "v", wanted, "g").collect()}
    assert set(got) == {"a", None, "one", "same", "wide", "nan"} and met[0] < 100
    for g in ("a", None, "one", "same"):
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], list(wanted.values())))
    assert got["wide"][:3] == pytest.approx((1.0, 2.0, 4.5)) and got["nan"][2] == 3.0
    finite = frame.where("g is null or g = 'a'")
    assert tuple(A.selected_quantiles(finite, "v", wanted).first()) == tuple(A.quantiles(finite, "v", wanted).first())
    assert A.selected_quantiles(frame.limit(0), "v", wanted).first()["median"] is None
    sums = A.with_quantiles(frame.groupBy("g").agg(F.count("*").alias("n")), frame, "v", {"median": 0.5}, "g", made=A.selected_quantiles).collect()
    assert {x["g"]: x["median"] for x in sums if x["g"] in ("none", "one")} == {"none": None, "one": 4.5}


def test_one_sided_and_two_sided_p(spark):
    from pyspark.sql import functions as F

    grid = [i * 1e-3 for i in range(-60_000, 60_001)]
    for rho, n in ((0.3, 12), (-0.7, 5), (0.05, 40)):
        df = n - 2
        t = rho * math.sqrt(df / (1 - rho * rho))
        density = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        outside = 1 - sum(density(x) for x in grid if abs(x) <= abs(t)) * 1e-3
        got = spark.range(1).select(T.t_p_value(F.lit(rho), F.lit(n)).alias("p"), T.normal_tail(F.lit(1.5)).alias("z")).first()
        assert got["p"] == pytest.approx(outside, abs=2e-3) and got["z"] == pytest.approx(0.0668072, abs=1e-6)
