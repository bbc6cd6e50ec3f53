"""Classical statistics as aggregates; tails come from small result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from meshwork.functions import likelihoods, tails
from meshwork.operators.analytic import average_ranks, running
from meshwork.sources.sinks import checkpointed


@F.pandas_udf(DoubleType())
def t_p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation; for result rows."""

    def one(r: float, m: int) -> float | None:
        if r != r or m < 3:
            return None
        return 0.0 if abs(r) >= 1 else tails.t_two_sided(r * ((m - 2) / (1 - r * r)) ** 0.5, m - 2)

    return pd.Series([one(r, m) for r, m in zip(rho, n)])


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(tails.normal_upper)


@F.pandas_udf(DoubleType())
def fisher_tail(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([tails.hypergeometric_upper(*map(int, row)) for row in zip(k, total, marked, drawn)])


def spearman(frame: DataFrame, a: str, b: str) -> DataFrame:
    """n and rank correlation, ties sharing their mean rank; rows with a null are left out."""
    ranked = average_ranks(checkpointed(frame.select(a, b).dropna()), a, b)
    return ranked.agg(F.count("*").alias("n"), F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def pearson_log10(frame: DataFrame, a: str, b: str) -> DataFrame:
    """n and correlation of log10 of positive values."""
    kept = frame.where((F.col(a) > 0) & (F.col(b) > 0))
    return kept.agg(F.count("*").alias("n"), F.corr(F.log10(a), F.log10(b)).alias("r"))


def partial_spearman(frame: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """Rank correlation of a and b after ranks of ``given`` are regressed out of both."""
    ranked = average_ranks(checkpointed(frame.select(a, b, given).dropna()), a, b, given)
    c = ranked.agg(F.count("*").alias("n"), F.corr(f"rank_{a}", f"rank_{b}").alias("ab"), F.corr(f"rank_{a}", f"rank_{given}").alias("ag"), F.corr(f"rank_{b}", f"rank_{given}").alias("bg"))
    return c.select("n", ((F.col("ab") - F.col("ag") * F.col("bg")) / F.sqrt((1 - F.col("ag") * F.col("ag")) * (1 - F.col("bg") * F.col("bg")))).alias("rho"))


def mann_whitney(frame: DataFrame, value: str, group: str) -> DataFrame:
    """U of rows with the group true against the others, and its tie-corrected normal score."""
    counts = checkpointed(frame.groupBy(value).agg(F.count("*").alias("m"), F.count_if(F.col(group)).alias("g")))
    ran = running(counts, "m", F.col(value)).withColumn("r", F.col("upto") - (F.col("m") - 1) / 2)
    sums = ran.agg(F.sum("g").cast("double").alias("n1"), F.sum(F.col("m") - F.col("g")).cast("double").alias("n2"), F.sum(F.col("r") * F.col("g")).alias("rank_sum"), F.sum((F.col("m") * F.col("m") * F.col("m") - F.col("m")).cast("double")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return sums.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / sd).alias("z"))


def contingency(frame: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of a 2 x 2 table of booleans and the sample odds ratio (null if a product is 0)."""
    r, c = F.col(row), F.col(column)
    t = frame.agg(F.count_if(r & c).alias("row_and_column"), F.count_if(r & ~c).alias("row_only"), F.count_if(~r & c).alias("column_only"), F.count_if(~r & ~c).alias("neither"))
    return t.withColumn("odds_ratio", (F.col("row_and_column") * F.col("neither")) / F.nullif((F.col("row_only") * F.col("column_only")).cast("double"), F.lit(0.0)))


def fisher(frame: DataFrame, row: str, column: str) -> DataFrame:
    """One-sided exact test of a 2 x 2 table."""
    t = contingency(frame, row, column)
    total = F.col("row_and_column") + F.col("row_only") + F.col("column_only") + F.col("neither")
    return t.withColumn("p", fisher_tail("row_and_column", total, F.col("row_and_column") + F.col("column_only"), F.col("row_and_column") + F.col("row_only")))


def ks_distance(frame: DataFrame, value: str, group: str) -> DataFrame:
    """Greatest distance of the two groups' distribution functions, from counts of distinct values."""
    counts = checkpointed(frame.groupBy(value).agg(F.count_if(F.col(group)).alias("_a"), F.count_if(~F.col(group)).alias("_b")))
    ran = running(counts, "_a", F.col(value)).select(value, "_b", F.col("upto").alias("ua"), F.col("total").alias("ta"))
    ran = running(ran, "_b", F.col(value))
    return ran.agg(F.max(F.abs(F.col("ua") / F.col("ta") - F.col("upto") / F.col("total"))).alias("ks"))


def power_law(lengths: DataFrame, value: str, least: float) -> DataFrame:
    """Maximum-likelihood exponent of a continuous power law above ``least``, and log-likelihoods of it and an exponential tail."""
    kept = lengths.where(F.col(value) >= least)
    s = kept.agg(F.count("*").alias("tail"), F.sum(F.ln(F.col(value) / least)).alias("logs"), F.avg(F.col(value) - least).alias("over"))
    alpha = 1 + F.col("tail") / F.col("logs")
    return s.select(
        "tail", alpha.alias("alpha"), (F.col("tail") * F.ln((alpha - 1) / F.lit(least)) - alpha * F.col("logs")).alias("loglik_power"), (-F.col("tail") * (F.ln("over") + 1)).alias("loglik_exponential")
    )


def power_law_scan(lengths: DataFrame, value: str, least_tail: int = 50, most: int = 20_000) -> DataFrame:
    """The cutoff whose power-law tail has the least KS distance, of all distinct values of rounded data, with its exponent.

    Rounded lengths have few distinct values, whatever the number of rows: their counts (``most`` at most, or it is an
    error) are scanned in the driver.
    """
    counts = lengths.select(F.round(value).alias("v")).where("v > 0").groupBy("v").agg(F.count("*").alias("m"))
    rows = _bounded(counts, most).sort_values("v")
    v, m = rows["v"].to_numpy(float), rows["m"].to_numpy(float)
    found = []
    for i in range(len(v)):
        x, n = v[i:] / v[i], m[i:]
        tail, logs = n.sum(), (n * np.log(x)).sum()
        if tail >= least_tail and logs > 0:
            alpha = 1 + tail / logs
            found.append((float(np.abs(np.cumsum(n) / tail - (1 - x ** (1 - alpha))).max()), float(v[i]), float(alpha), int(tail)))
    best = [(cut, alpha, tail, ks) for ks, cut, alpha, tail in sorted(found)[:1]]
    return lengths.sparkSession.createDataFrame(best, "cut double, alpha double, tail long, ks double")


def _bounded(frame: DataFrame, most: int) -> pd.DataFrame:
    rows = frame.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values")
    return rows


def tail_comparison(lengths: DataFrame, value: str, least: float | None = None) -> DataFrame:
    """(alternative, cut, tail, ratio, p) of the power-law tail of rounded data against three others: log-likelihood ratio
    over its deviation (above 0: the power law fits better) and its two-sided p. The truncated power law has the power law
    in it, so its p is that of twice the ratio under chi-squared of one degree.

    ``least`` is the cutoff; without it, that of ``power_law_scan``. All four likelihoods are linear in ln x, (ln x)^2 and x,
    so one aggregate of their moments has all that fits, ratios and deviations need. No tail of two rows: no rows.
    """
    if least is None:
        cut = power_law_scan(lengths, value).first()
        if cut is None:
            return lengths.sparkSession.createDataFrame([], TAIL_SCHEMA)
        least = cut["cut"]
    x = F.round(value) / F.lit(float(least))
    tail = lengths.select(x.alias("x"), F.ln(x).alias("y")).where("x >= 1")
    terms = {f"y{i}x{j}": F.pow("y", F.lit(i)) * F.pow("x", F.lit(j)) for i in range(5) for j in range(3) if i + 2 * j <= 4}
    m = tail.agg(F.count("*").alias("n"), *[F.avg(t).alias(name) for name, t in terms.items()]).first().asDict()
    n = m.pop("n")
    if n < 2 or m["y1x0"] <= 0:
        return lengths.sparkSession.createDataFrame([], TAIL_SCHEMA)
    alpha = 1 + 1 / m["y1x0"]
    power = np.array([math.log(alpha - 1), -alpha, 0.0, 0.0])
    rows = []
    for name, other in (("lognormal", likelihoods.lognormal(m["y1x0"], m["y2x0"])), ("exponential", likelihoods.exponential(m["y0x1"])), ("truncated_power_law", likelihoods.truncated_power_law(m["y1x0"], m["y0x1"], alpha))):
        d = power - other  # in 1, y, y^2 and x
        of = [(0, 0), (1, 0), (2, 0), (0, 1)]
        mean = sum(c * m[f"y{i}x{j}"] for c, (i, j) in zip(d, of, strict=True))
        square = sum(a * b * m[f"y{i + k}x{j + l}"] for a, (i, j) in zip(d, of, strict=True) for b, (k, l) in zip(d, of, strict=True))
        spread = math.sqrt(max(square - mean * mean, 0.0) * n)
        ratio = n * mean / spread if spread > 0 else 0.0
        p = math.erfc(math.sqrt(abs(n * mean))) if name == "truncated_power_law" else math.erfc(abs(ratio) / math.sqrt(2))
        rows.append((name, float(least), n, float(ratio), float(p)))
    return lengths.sparkSession.createDataFrame(rows, TAIL_SCHEMA)


TAIL_SCHEMA = "alternative string, cut double, tail long, ratio double, p double"


def exponential_fit(curve: DataFrame, x: str, y: str, most: int = 20_000) -> DataFrame:
    """a exp(-x / lambda) by least squares from (greatest y, 100), positives only: damped Gauss-Newton steps in the driver
    over the bins of a curve (``most`` at most, or it is an error)."""
    rows = _bounded(curve.where(F.col(y) > 0).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), most)
    at, value = rows["x"].to_numpy(), rows["y"].to_numpy()
    if len(rows) < 2:
        return curve.sparkSession.createDataFrame([], "a double, lambda double")
    a, scale, damping = value.max(), 100.0, 1e-3
    off = lambda a, scale: value - a * np.exp(-at / scale)
    for _ in range(200):
        e = np.exp(-at / scale)
        j = np.stack([e, a * e * at / scale**2], axis=1)
        normal = j.T @ j
        step = np.linalg.lstsq(normal + damping * np.diag(np.diag(normal)), j.T @ off(a, scale), rcond=None)[0]
        if scale + step[1] > 0 and (off(a + step[0], scale + step[1]) ** 2).sum() <= (off(a, scale) ** 2).sum():
            a, scale, damping = a + step[0], scale + step[1], damping / 10
            if np.abs(step / np.array([a, scale])).max() < 1e-12:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return curve.sparkSession.createDataFrame([(float(a), float(scale))], "a double, lambda double")


def partition_agreement(frame: DataFrame, one: str, two: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic) of two labellings; null with fewer than two items."""
    cells = frame.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(one, two).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    a = cells.groupBy(one).agg(F.sum("n").alias("n"))
    b = cells.groupBy(two).agg(F.sum("n").alias("n"))
    entropy = F.sum(-F.col("n") * F.ln("n"))
    x = cells.agg(pairs("n").alias("ij"), F.sum("n").cast("double").alias("total"), entropy.alias("hij"))
    y, z = a.agg(pairs("n").alias("i"), entropy.alias("hi")), b.agg(pairs("n").alias("j"), entropy.alias("hj"))
    t = x.join(F.broadcast(y)).join(F.broadcast(z))
    n = F.col("total")
    expected = F.col("i") * F.col("j") / (n * (n - 1) / 2)
    most = (F.col("i") + F.col("j")) / 2
    h = lambda c: F.ln(n) + F.col(c) / n
    ari = F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0)))
    nmi = F.when(h("hi") + h("hj") == 0, 1.0).otherwise((h("hi") + h("hj") - h("hij")) / F.nullif((h("hi") + h("hj")) / 2, F.lit(0.0)))
    return t.select(n.cast("long").alias("items"), F.when(n >= 2, ari).alias("ari"), F.when(n >= 2, nmi).alias("nmi"))
