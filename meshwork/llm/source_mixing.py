"""Mixing sources to target weights with soft domain memberships. DataFrame functions only.

A classifier fitted on a labelled table gives each document a posterior over domains. Documents get nonnegative rates
so that expected domain totals of tokens, sum(rate * tokens * posterior), match targets in least squares. The problem
has a variable per document but only as many residuals as domains: a projected-gradient step needs the domain totals
(one aggregate over all documents) and then changes each rate by a combination of the document's own posterior. A rate
follows from the posterior alone, so the steps run over distinct posteriors with their tokens, not over documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.staging import staged

#: Labelled documents that the classifier is fitted on at most, cells of its token table, decimals of a posterior.
FIT_DOCS, CELLS, DECIMALS = 4000, 4096, 5
#: The projected gradient (root mean square a token) at which steps end, steps after which it is an error that they
#: haven't, and steps between written rates.
CLOSE, STEPS, WRITE_EVERY = 1e-6, 2000, 10
TARGETS = {"clean": 0.93, "low": 0.06, "toxic": 0.01}
SEED = 20


def domain_of_labels() -> Column:
    """The domain of a row of labels; null where a label is."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def _cells(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(CELLS)))


def fitted(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """Log prior of each domain and its log weights by cell, from at most FIT_DOCS labelled documents.

    A document with several labels takes the smallest domain name. Cells' counts are smoothed by 1; a domain without
    labels has a prior of half a document.
    """
    known = labels.select(F.col("id").alias("known"), domain_of_labels().alias("domain")).where(F.col("domain").isin(domains) & F.col("known").isNotNull())
    known = known.groupBy("known").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("known", F.lit(SEED)), "known").limit(FIT_DOCS)
    found = docs.select("id", "text").join(F.broadcast(known), F.col("id") == F.col("known")).select("domain", _cells(F.col("text")).alias("cells"))
    found = staged(found, "mixing-fit")
    per = {r["domain"]: r["n"] for r in found.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = np.ones((len(domains), CELLS))
    for r in found.select("domain", F.explode("cells").alias("cell")).groupBy("domain", "cell").agg(F.count("*").alias("n")).collect():
        counts[domains.index(r["domain"]), r["cell"]] += r["n"]  # domains x CELLS rows at most
    share = [per.get(d, 0) + 0.5 for d in domains]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return [math.log(s / sum(share)) for s in share], logs.tolist()


def with_posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], text_col: str) -> DataFrame:
    """``docs`` with mix_n (words) and mix_p (array of posteriors of naive Bayes, rounded to DECIMALS, the first being what
    the others leave of 1). A text without words has the prior."""
    prior, logs = model
    weights = [F.split(F.lit(",".join(f"{x - y:.9f}" for x, y in zip(row, logs[0], strict=True))), ",").cast("array<double>") for row in logs[1:]]

    def evidence(w: Column) -> Column:
        return F.aggregate("mix_cells", F.lit(0.0), lambda total, c: total + w[c])

    scores = F.array(F.lit(prior[0]), *[F.lit(p) + evidence(w) for p, w in zip(prior[1:], weights, strict=True)])
    out = docs.withColumn("mix_cells", _cells(F.col(text_col))).withColumn("mix_n", F.size("mix_cells").cast("long"))
    out = out.withColumn("mix_s", scores).withColumn("mix_s", F.transform("mix_s", lambda s: F.exp(s - F.array_max("mix_s"))))
    total = F.aggregate("mix_s", F.lit(0.0), lambda a, s: a + s)
    others = F.transform(F.slice("mix_s", 2, max(len(prior) - 1, 1)), lambda s: F.round(s / total, DECIMALS))
    return out.withColumn("mix_p", F.concat(F.array(F.lit(1.0) - F.aggregate(others, F.lit(0.0), lambda a, x: a + x)), others)).drop("mix_s", "mix_cells")


def advanced(steps: list[list[float]], start: Column) -> Column:
    """The rate x and the point y of the next step, after ``steps`` from ``start``. A step is the change a domain and its
    momentum: the new rate is y less the change by the document's posteriors, not below 0, and y goes beyond it."""
    if not steps:
        return start

    def following(at: Column, taken: Column) -> Column:
        x = _projected(at["y"], [taken[i] for i in range(len(steps[0]) - 1)])
        return F.struct(x.alias("x"), (x + taken[len(steps[0]) - 1] * (x - at["x"])).alias("y"))

    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), start, following)


def _projected(point: Column, change: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), point - sum((F.col("mix_p")[d] * c for d, c in enumerate(change)), F.lit(0.0)))


def _one() -> Column:
    return F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))


def solved(members: DataFrame, targets: list[float]) -> list[list[float]]:
    """The projected-gradient steps from rate 1 to the least-squares optimum. ``members`` has mix_n and mix_p, a row for
    each posterior.

    ``targets`` are weights; the total is such that the heaviest domain keeps its tokens. Residuals are measured in
    the inverse of the domains' second moments, in which the unprojected problem takes one step. Steps are accelerated
    by momentum, which starts again when it points uphill, and go on until the projected gradient is CLOSE to zero.
    """
    d = len(targets)
    p = lambda i: F.col("mix_p")[i]
    moments = members.agg(*[F.sum(F.col("mix_n") * p(i) * p(j)).alias(f"m{i}_{j}") for i in range(d) for j in range(d)], *[F.sum(F.col("mix_n") * p(i)).alias(f"t{i}") for i in range(d)]).first()
    before = now = np.array([moments[f"t{i}"] or 0.0 for i in range(d)])
    tokens = now.sum()
    if not tokens:
        return []
    heaviest = int(np.argmax(targets))
    wanted = np.array(targets) / targets[heaviest] * now[heaviest]
    second = np.array([[moments[f"m{i}_{j}"] or 0.0 for j in range(d)] for i in range(d)])
    inverse = np.linalg.pinv(second, rcond=1e-9, hermitian=True)
    steps: list[list[float]] = []
    current, start, written = members, _one(), 0
    pace, ahead = 1.0, now  # ahead: the totals at y
    for _ in range(STEPS):
        change = (inverse @ (ahead - wanted)).tolist()
        at = current.select("mix_n", "mix_p", advanced(steps[written:], start).alias("s"))
        at = at.select("mix_n", "mix_p", F.col("s.x").alias("x"), F.col("s.y").alias("y"), _projected(F.col("s.y"), [F.lit(c) for c in change]).alias("r"))
        n, move = F.col("mix_n"), F.col("y") - F.col("r")
        sums = at.agg(*[F.sum(F.col("r") * n * p(i)).alias(f"t{i}") for i in range(d)], F.sum(n * move * move).alias("gradient"), F.sum(n * move * (F.col("r") - F.col("x"))).alias("uphill")).first()
        before, now = now, np.array([sums[f"t{i}"] for i in range(d)])
        if sums["uphill"] > 0:
            pace = 1.0
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / following, following
        steps.append([*change, momentum])
        if math.sqrt(sums["gradient"] / tokens) < CLOSE:
            return steps
        ahead = now + momentum * (now - before)
        if len(steps) - written == WRITE_EVERY:
            current = staged(current.select("mix_n", "mix_p", advanced(steps[written:], start).alias("s")), "mixing-rates")
            start, written = F.col("s"), len(steps)
    raise ArithmeticError(f"no optimum of the rates after {STEPS} steps")


def rates(steps: list[list[float]]) -> Column:
    return advanced(steps, _one())["x"]


def copies(id_col: str) -> Column:
    """The rate rounded to a whole number by the id's own draw, so that its expectation is the rate."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("mix_rate") + draw).cast("int")


def _weighed(rows: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``rows`` (id, text and other columns of the caller) with mix_n, mix_p, mix_rate and mix_copies (how often a mixture
    takes the document; 0: not at all), and without the text unless it is in another column."""
    domains = sorted(targets)
    model = fitted(rows, labels, domains)
    found = staged(with_posteriors(rows, model, "text").drop("text"), "mixing-posteriors")
    members = found.where("mix_n > 0").groupBy("mix_p").agg(F.sum("mix_n").alias("mix_n"))
    steps = solved(staged(members, "mixing-members"), [targets[d] for d in domains])
    return found.withColumn("mix_rate", rates(steps)).withColumn("mix_copies", copies("id"))


def decisions(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, a posterior p_<domain> for each domain, rate, copies.

    Words are runs outside white space. A null or empty text has no tokens, the prior as posterior, and so a rate but
    no part in the totals. Repeated rows have equal decisions and count each in the totals. Rows with null labels
    aren't used for fitting; without labels all documents have one posterior. Targets that can't be met are met in
    least squares. Empty table: no rows. Other columns are ignored.
    """
    domains = sorted(targets or TARGETS)
    labels = labels.withColumn("id", F.col(id_col))
    found = _weighed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels, targets or TARGETS)
    return found.select(F.col("id").alias(id_col), F.col("mix_n").alias("n_tokens"), *[F.col("mix_p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its copies say; all its columns, whatever their names.

    Nulls, empty texts, repeats and empty tables are as in ``decisions``: a row without words is taken once or not at
    all by the rate of the prior; rows that repeat an id and a text are taken equally often.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _weighed(rows, labels.withColumn("id", F.col(id_col)), targets or TARGETS)
    # An outer explode, as a filter on the copies would be pushed below and repeat the rate's expression.
    some = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies")))
    return found.select("row", F.explode_outer(some).alias("mix_copy")).where("mix_copy is not null").select("row.*")
