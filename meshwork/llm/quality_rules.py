"""Quality rules with risk-controlled thresholds.

Counts are taken of every whole text in Arrow batches. Each rule is a ratio and a ladder of cutoffs from lenient to
strict; a policy is a rung of every rule. In each stratum, labelled good documents that pass the base rules are the
holdout: the exact binomial test asks whether a policy's chance of rejecting a good document can be over ``risk``.

A stratum's policies form a path from lenient to strict that doesn't depend on its own holdout: it ends at the rungs
that the good documents of the other strata bear, and steps towards them. Policies are tested in the order of the path
until one fails, which keeps the stratum's error without a further correction; the error is split over the strata
(Bonferroni). With probability 1 - ``error`` no stratum's chance of falsely rejecting a good document is over ``risk``.
A stratum without a passing policy rejects nothing beyond the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshwork.functions.tails import binomial_cdf
from meshwork.llm.staging import staged
from meshwork.llm.text_arrays import LINE_BYTES, PLACE, SPACE, U64, WORD_EXACT, mix, run_hashes, slices, word_bounds

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Rule: the ratio (all are bad when high) and its rungs, lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.05]),
    "lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "capitals": ("n_upper / word_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "marks": ("n_marks / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "length": ("word_chars / n_words", [60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0]),
}


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out

    def per_text(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    starts, _, text = word_bounds(data, offsets)
    space = SPACE[data]
    out[:, 0] = np.bincount(text, minlength=n)
    out[:, 1] = per_text(~space & ((data & 0xC0) != 0x80))
    out[:, 2] = per_text(SYMBOLS[data])
    out[:, 6] = per_text((data >= 65) & (data <= 90))
    out[:, 7] = per_text((data == 33) | (data == 63))

    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    breaks = data == 10
    begin = np.unique(np.concatenate([first, np.flatnonzero(breaks)]))  # a line takes its leading break, at a text's start none
    own = np.searchsorted(offsets, begin, "right") - 1
    visible = np.add.reduceat(~space, begin) > 0
    values = LINE_BYTES.copy()
    values[10] = 0
    skip = begin + breaks[begin]  # the place of the line's first byte, so equal lines hash alike
    with np.errstate(over="ignore"):
        hashes = mix(run_hashes_at(data, begin, skip, values) + own.astype(U64) * PLACE[9])
    hashes, own = hashes[visible], own[visible]
    out[:, 5] = np.bincount(own, minlength=n)
    _, once = np.unique(hashes, return_index=True)
    later = np.ones(len(hashes), bool)
    later[once] = False
    out[:, 3] = np.bincount(own[later], minlength=n)

    words = run_hashes(data, starts, WORD_EXACT)
    if len(words) >= WINDOW:
        m = len(words) - WINDOW + 1
        with np.errstate(over="ignore"):
            total = text[:m].astype(U64) * PLACE[20]
            for k in range(WINDOW):
                total += words[k : m + k] * PLACE[k]
        whole = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
        _, back, seen = np.unique(mix(total[whole]), return_inverse=True, return_counts=True)
        again = whole[seen[back] > 1]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[again] += 1
        edge[again + WINDOW] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        out[:, 4] = np.bincount(text[covered], minlength=n)
    return out


def run_hashes_at(data: np.ndarray, begin: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the runs that begin at ``begin``, with places counted from ``first``."""
    from meshwork.llm.text_arrays import powers

    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values[data] * up[:-1], begin) * down[first])


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with COUNTS (long). Null text counts as empty."""
    others = [c for c in docs.columns if c not in {text_col, *COUNTS}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others))
            found = [text_counts(data, offsets) for _, data, offsets in slices(texts)]
            rows = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
            columns = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rows[:, i]) for i in range(len(COUNTS))], names=[*others, *COUNTS])

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = StructType([*kept.schema, *(StructField(c, LongType()) for c in COUNTS)])
    return docs.select(*kept.columns, text_col).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rungs_passed(rule: str):
    """How many of the rule's cutoffs the document is above."""
    ratio, ladder = RULES[rule]
    value = F.expr(f"{ratio.split(' / ')[0]} / cast(nullif({ratio.split(' / ')[1]}, 0) as double)")
    return sum((F.when(value > c, 1).otherwise(0) for c in ladder), F.lit(0))


STEPS = len(RULES["symbols"][1])


def first_step(rungs: str, end: str):
    """The first step of a path to rung ``end`` at which a document above ``rungs`` of a rule's cutoffs is rejected; the
    strict cutoffs are the low ones, so rung r rejects what is above STEPS - r + 1 of them or more."""
    needed = STEPS + 1 - F.col(rungs)
    return F.when(needed <= F.col(end), F.floor((needed - 1) * STEPS / F.col(end)) + 1).otherwise(STEPS + 1).cast("int")


def tuned(own: pd.DataFrame, totals: pd.DataFrame, risk: float) -> dict[str, int]:
    """The rung of each rule that good documents of the other strata bear: their rejected share is its part of half the
    risk at most. Without other strata, the strictest. ``own`` and ``totals`` count good documents by rule and rungs."""
    ends = {}
    for rule in RULES:
        n = np.zeros(STEPS + 1)
        for frame, sign in ((totals, 1), (own, -1)):
            of = frame[frame["rule"] == rule]
            np.add.at(n, of["rungs"].to_numpy(np.int64), sign * of["n"].to_numpy(np.float64))
        wrong = np.cumsum(n[::-1])[:STEPS]  # of rungs 1, 2, ...
        ends[rule] = int((wrong <= risk / 2 / len(RULES) * n.sum()).sum())
    return ends


def certified(wrong: dict[int, int], n: int, strata: int, risk: float, error: float) -> int:
    """The last step of the path that passes the exact binomial test with all before it; ``wrong`` counts the ``n`` good
    documents by the first step that rejects them."""
    so_far = 0
    for step in range(1, STEPS + 1):
        so_far += wrong.get(step, 0)
        if binomial_cdf(so_far, n, risk) > error / strata:
            return step - 1
    return STEPS


def _cutoffs(features: DataFrame, good: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, n_good, step, cut_<rule>): the certified step and the rung of each rule (0: none) of each stratum."""
    # The test needs independent draws: a text counts once, however many copies of it there are.
    holdout = features.where(~F.col("base_failed")).join(good, features["id"] == good["good_id"], "left_semi")
    holdout = holdout.select("stratum", "copy", *[f"rungs_{r}" for r in RULES]).dropDuplicates(["stratum", "copy"])
    # At most one row per stratum, rule and rung; their sums over strata are a few dozen rows.
    stack = f"stack({len(RULES)}, " + ", ".join(f"'{r}', rungs_{r}" for r in RULES) + ") as (rule, rungs)"
    by_rule = staged(holdout.select("stratum", F.expr(stack)).groupBy("stratum", "rule", "rungs").agg(F.count("*").alias("n")), "quality-holdout")
    totals = by_rule.groupBy("rule", "rungs").agg(F.sum("n").alias("n")).toPandas()
    strata = max(1, by_rule.select("stratum").distinct().count())

    def path(group: pd.DataFrame) -> pd.DataFrame:
        ends = tuned(group, totals, risk)
        return pd.DataFrame([{"stratum": group["stratum"].iloc[0], **{f"end_{r}": e for r, e in ends.items()}}])

    ends = by_rule.groupBy("stratum").applyInPandas(path, "stratum string, " + ", ".join(f"end_{r} int" for r in RULES))
    first = F.least(*[first_step(f"rungs_{r}", f"end_{r}") for r in RULES])
    at = ["stratum", *(f"end_{r}" for r in RULES)]
    counts = holdout.join(ends, "stratum").groupBy(*at, first.alias("first")).agg(F.count("*").alias("n"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        step = certified(dict(zip(group["first"], group["n"], strict=True)), n, strata, risk, error)
        return pd.DataFrame([{"stratum": group["stratum"].iloc[0], "n_good": n, "step": step, **{f"cut_{r}": -(-step * int(group[f"end_{r}"].iloc[0]) // STEPS) for r in RULES}}])

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, n_good long, step int, " + ", ".join(f"cut_{r} int" for r in RULES))


def _features(docs: DataFrame, labels: DataFrame, stratum_col: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id, stratum, copy, COUNTS, base_failed, rungs), and the ids of good documents; ``copy`` is the text's digest."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\u0000null")).alias("stratum"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    features = counted(rows, "text").withColumn("base_failed", base_failed()).withColumns({f"rungs_{r}": rungs_passed(r) for r in RULES})
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("good_id")).agg(F.min("quality").alias("good")).where("good = 1")
    return staged(features, "quality-counts"), good


def cutoffs(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """What ``judged`` applies: stratum (null: \\0null), n_good (different texts in its holdout), step and, for each rule, the cutoff above
    which a ratio rejects (null: the rule rejects nothing). Strata without good documents have no row."""
    found = _cutoffs(*_features(docs, labels, stratum_col, id_col, text_col), risk, error)
    rungs = [F.get(F.array(*map(F.lit, ladder)), F.col(f"cut_{r}") - 1).alias(r) for r, (_, ladder) in RULES.items()]
    return found.select("stratum", "n_good", "step", *rungs)


def judged(
    docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = 0.02, error: float = 0.05
) -> DataFrame:
    """Verdict on each document: ``docs`` without the text, with COUNTS, base_failed, rejected_by and kept.

    ``labels`` has the id and ``quality`` (0/1): a document is good if all its labels that aren't null are 1; null
    ids and unlabelled documents aren't in the holdout. A null stratum is a stratum of its own. A text that is null,
    empty or has no word fails the base. Repeated rows are judged alike; rows of a stratum with equal texts are one in the holdout. Whole texts count, of any length. Empty tables
    give no rows; without labels only the base rules reject. Columns of ``docs`` with the names of results (in any case)
    are replaced.
    """
    features, good = _features(docs, labels, stratum_col, id_col, text_col)
    verdict = features.join(F.broadcast(_cutoffs(features, good, risk, error)), "stratum", "left")  # a row per stratum
    hit = F.filter(F.array(*[F.when((F.col(f"cut_{r}") > 0) & (F.col(f"rungs_{r}") >= STEPS + 1 - F.col(f"cut_{r}")), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    added = {c.lower() for c in (*COUNTS, "base_failed", "rejected_by", "kept")}
    return (
        verdict.withColumn("rejected_by", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(hit))
        .withColumn("kept", F.size("rejected_by") == 0)
        .select(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col and c.lower() not in added], *COUNTS, "base_failed", "rejected_by", "kept")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Rows equal in id and text fare alike; null ids are judged by row too.

    A null or empty text is never kept, an empty table has no rows, and all columns stay, whatever their names.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    digest = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    found = judged(docs.select(id_col, text_col, options.get("stratum_col", "lang"), digest.alias("text_digest")), labels, **options)
    bad = found.where(~F.col("kept")).select(F.col(id_col).alias("bad_id"), F.col("text_digest").alias("bad_digest")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (digest == bad["bad_digest"]), "left_anti")
