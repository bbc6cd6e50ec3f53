"""Link models: which ordered pairs of nodes are edges, by distance, compartment, class and degree (MLlib)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.expressions import distance, draw, sigmoid
from meshwork.operators.analytic import running
from meshwork.operators.edges import degrees
from meshwork.operators.graph import properties
from meshwork.operators.regions import all_pairs
from meshwork.operators.sampling import non_edges
from meshwork.sources.sinks import checkpointed

#: Nested models by the columns they use.
MODELS = {
    "distance": ["near", "log_near"],
    "compartment": ["near", "log_near", "same_compartment"],
    "class": ["near", "log_near", "same_compartment", "pair"],
    "degree": ["near", "log_near", "same_compartment", "pair", "log_out", "log_in"],
}


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    return nodes.join(d, "node").select(
        "node", "x", "y", "z", F.coalesce("compartment", F.lit("none")).alias("compartment"), "superclass", F.log1p("out_degree").alias("log_out"), F.log1p("in_degree").alias("log_in")
    )


def pair_design(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(src, dst, …) with distance / 100, ln(distance + 1), same compartment, class pair and degrees."""
    one = features.select(F.col("node").alias("src"), *[F.col(k).alias(f"a_{k}") for k in "xyz"], F.col("compartment").alias("a_c"), F.col("superclass").alias("a_s"), "log_out")
    two = features.select(F.col("node").alias("dst"), *[F.col(k).alias(f"b_{k}") for k in "xyz"], F.col("compartment").alias("b_c"), F.col("superclass").alias("b_s"), "log_in")
    d = distance("a_", "b_")
    return pairs.join(one, "src").join(two, "dst").select(
        *pairs.columns, (d / 100).alias("near"), F.log1p(d).alias("log_near"), (F.col("a_c") == F.col("b_c")).cast("double").alias("same_compartment"), F.concat_ws(">", "a_s", "b_s").alias("class_pair"), "log_out", "log_in"
    )


def stacked(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("label")).unionByName(negatives.select("src", "dst", F.lit(0.0).alias("label")))


def encoders(design: DataFrame):
    """Models that make class_index and pair from class_pair; classes that the design lacks are one more class."""
    index = StringIndexer(inputCol="class_pair", outputCol="class_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(design)
    return index, OneHotEncoder(inputCol="class_index", outputCol="pair", dropLast=False).fit(index.transform(design))


def encoded(design: DataFrame) -> DataFrame:
    index, hot = encoders(design)
    return hot.transform(index.transform(design))


def fit(design: DataFrame, columns: list[str], strength: float = 1.0):
    """L2-regularised logistic regression, intercept free. ``design`` is encoded; returns the model and scored rows."""
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(design)
    n = ready.count()
    model = LogisticRegression(regParam=1.0 / (strength * n), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-6).fit(ready)
    if model.summary.totalIterations >= 2000:
        raise RuntimeError("the fit has not converged")
    return model, model.transform(ready).withColumn("p", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")


def fit_statistics(scored: DataFrame, columns: int) -> DataFrame:
    """Log-likelihood (p clipped), McFadden's pseudo R2 and AIC with an intercept."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    s = scored.agg(F.sum(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p)).alias("loglik"), F.avg("label").alias("m"), F.count("*").alias("n"))
    null = F.col("n") * (F.col("m") * F.ln("m") + (1 - F.col("m")) * F.ln(1 - F.col("m")))
    return s.select("n", "loglik", (1 - F.col("loglik") / null).alias("pseudo_r2"), (2 * F.lit(columns + 1) - 2 * F.col("loglik")).alias("aic"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by average ranks."""
    counts = checkpointed(scored.groupBy("p").agg(F.count("*").alias("m"), F.sum("label").alias("g")))
    ran = running(counts, "m", F.col("p")).withColumn("r", F.col("upto") - (F.col("m") - 1) / 2)
    s = ran.agg(F.sum(F.col("r") * F.col("g")).alias("r"), F.sum("g").alias("n1"), F.sum(F.col("m") - F.col("g")).alias("n0"))
    return s.select(((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def folds(frame: DataFrame, k: int, seed: int) -> DataFrame:
    """Fold 0..k-1 of each row; the rows of a label, in a random order, go to the folds in turn, so each fold has its share."""
    order = running(frame.withColumn("_one", F.lit(1)), "_one", F.col("label"), draw(seed, F.col("src"), F.col("dst")), F.col("src"), F.col("dst"))
    return order.withColumn("fold", (F.col("nth") % k).cast("int")).select(*frame.columns, "fold")


def cross_validated(design: DataFrame, columns: list[str], k: int, seed: int) -> DataFrame:
    """Mean held-out AUC over k folds."""
    parts = checkpointed(folds(design, k, seed), "folds")
    out = None
    for f in range(k):
        model, _ = fit(parts.where(F.col("fold") != f), columns)
        held = model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(parts.where(F.col("fold") == f))).withColumn("p", vector_to_array("probability")[1])
        one = auc(held.select("p", "label"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("auc").alias("auc"))


def corrected_intercept(intercept: float, sampled: int, non_edges: int) -> float:
    """Case-control correction for sampled negatives."""
    return intercept + math.log(sampled / non_edges)


def logit_histogram(logits: DataFrame, width: float = 0.002) -> DataFrame:
    return logits.groupBy(F.floor(F.col("logit") / width).alias("bin")).agg(F.count("*").alias("n"))


def solved_shift(histogram: DataFrame, expected: float, width: float = 0.002) -> float:
    """The shift at which the logistic sum over the histogram is the expected number of edges. The histogram is of bounded
    length (logits are clipped by their range over ``width``); it is bisected in the driver."""
    rows = histogram.select("bin", "n").toPandas()
    centre, n = (rows["bin"].to_numpy() + 0.5) * width, rows["n"].to_numpy(float)
    low, high = -50.0, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (n / (1 + np.exp(-(centre + middle)))).sum() < expected else (low, middle)
    return (low + high) / 2


def sampled_design(edges: DataFrame, nodes: DataFrame, seed: int, per_edge: int = 5) -> DataFrame:
    """The pair design of all edges and ``per_edge`` non-edges for each (all of them, if there are fewer)."""
    n, m = nodes.count(), edges.count()
    return pair_design(stacked(edges, non_edges(edges, nodes, min(per_edge * m, n * (n - 1) - m), seed)), node_features(nodes, edges))


def calibrated(edges: DataFrame, nodes: DataFrame, models: list[str], seed: int, per_edge: int = 5, width: float = 0.002) -> DataFrame:
    """For each model: its intercept corrected for the sampled non-edges, the shift that makes all pairs expect as many edges
    as there are, and the number expected with it."""
    n, m = nodes.count(), edges.count()
    rows = []
    for name in models:
        shift, logits, intercept = _model_logits(edges, nodes, name, seed, per_edge, width)
        expected = logits.agg(F.sum(sigmoid(F.col("logit") + F.lit(shift)))).first()[0]
        rows.append((name, corrected_intercept(intercept, min(per_edge * m, n * (n - 1) - m), n * (n - 1) - m), shift, m, expected))
    return nodes.sparkSession.createDataFrame(rows, "model string, intercept double, shift double, edges long, expected double")


def _model_logits(edges: DataFrame, nodes: DataFrame, name: str, seed: int, per_edge: int = 5, width: float = 0.002) -> tuple[float, DataFrame, float]:
    """(shift, logits of all pairs by the fitted model, its intercept)."""
    n, m = nodes.count(), edges.count()
    features = node_features(nodes, edges)
    design = sampled_design(edges, nodes, seed, per_edge)
    index, hot = encoders(design)
    model, _ = fit(hot.transform(index.transform(design)), MODELS[name])
    pairs = pair_design(all_pairs(nodes, []).select("src", "dst"), features)
    every = model.transform(VectorAssembler(inputCols=MODELS[name], outputCol="features").transform(hot.transform(index.transform(pairs))))
    logits = checkpointed(every.select("src", "dst", vector_to_array("rawPrediction")[1].alias("logit")), "logits")
    return solved_shift(logit_histogram(logits, width), float(m), width), logits, float(model.intercept)


def sampled_graph(logits: DataFrame, shift: float, seed: int) -> DataFrame:
    """Edges drawn independently with their own chance."""
    return logits.where(draw(seed, F.col("src"), F.col("dst")) < sigmoid(F.col("logit") + F.lit(shift))).select("src", "dst")


def compared(edges: DataFrame, nodes: DataFrame, models: list[str], draws: int, seed: int) -> DataFrame:
    """(model, property, real, draws, mean, low, high, reproduced): properties of graphs drawn from each fitted model, and
    whether the real one is inside their central 95 percent."""
    out = None
    for name in models:
        shift, logits, _ = _model_logits(edges, nodes, name, seed)
        for i in range(draws):
            one = properties(checkpointed(sampled_graph(logits, shift, seed + 1 + i), "drawn"), nodes).select(F.lit(name).alias("model"), F.lit(i).alias("draw"), "property", "value")
            out = one if out is None else out.unionByName(one)
    real = properties(edges, nodes).select("property", F.col("value").alias("real"))
    per = out.groupBy("model", "property").agg(F.count("*").alias("draws"), F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    return per.join(real, "property").select("model", "property", "real", "draws", "mean", "low", "high", F.col("real").between(F.col("low"), F.col("high")).alias("reproduced"))
