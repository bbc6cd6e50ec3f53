"""Maximum flow of unit edges, for many graphs at once, as rounds of joins.

Every scenario (columns ``by``) is a set of rows of the same tables, so scenarios share the rounds and no graph is held
by one task. Excess starts on the heads of the sources' edges and is pushed along shortest residual paths towards the
targets: a phase measures each node's residual distance to the targets and then moves excess level by level. Distances
never fall, and excess that can't reach a target any more stays; what has arrived is the flow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.sources.sinks import checkpointed


@dataclass
class Preflow:
    """A greatest preflow: what has been pushed can't be pushed further, and what a node could not pass on stays with it.

    ``first`` (src, dst, room) are the arcs out of sources, ``arcs`` (src, dst, room) the others, ``residual`` (src, dst, room) what they
    have left with the reverse of what they carry, ``excess`` (node, excess) what stays, ``arrived`` (node, excess) what has
    reached the targets; all have the columns ``by``, whose values ``graphs`` has.
    """

    by: list[str]
    sources: DataFrame
    targets: DataFrame
    first: DataFrame
    arcs: DataFrame
    residual: DataFrame
    excess: DataFrame
    arrived: DataFrame
    graphs: DataFrame | None


def max_flow(edges: DataFrame, sources: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, flow): the most edge-disjoint paths from any source to any target of each scenario.

    ``edges`` has by, src, dst, an edge each (repeats are more capacity, loops don't count); ``sources`` and ``targets``
    have by and node. Scenarios of ``edges`` without a source or target have flow 0. A node in both sets is an error.
    """
    b = list(by)
    flow = preflow(edges, sources, targets, by).arrived.groupBy(*b).agg(F.sum("excess").alias("flow"))
    if not b:
        return flow.agg(F.coalesce(F.sum("flow"), F.lit(0)).alias("flow"))
    return edges.select(*b).distinct().join(flow, b, "left").select(*b, F.coalesce("flow", F.lit(0)).alias("flow"))


def preflow(edges: DataFrame, sources: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> Preflow:
    """The greatest preflow of each scenario; its ``arrived`` adds up to the flow of ``max_flow``, which has the arguments."""
    b = list(by)
    sources, targets = (checkpointed(s.select(*b, "node").distinct(), "ends") for s in (sources, targets))
    if not sources.join(targets, [*b, "node"], "left_semi").isEmpty():
        raise ValueError("sources and targets share a node")
    into, out = sources.withColumnRenamed("node", "dst"), targets.withColumnRenamed("node", "src")
    arcs = edges.where("src != dst").groupBy(*b, "src", "dst").agg(F.count("*").cast("long").alias("room"))
    arcs = checkpointed(arcs.join(into, [*b, "dst"], "left_anti").join(out, [*b, "src"], "left_anti"), "arcs")
    first = checkpointed(arcs.join(sources.withColumnRenamed("node", "src"), [*b, "src"], "left_semi"), "first")
    excess = checkpointed(first.groupBy(*b, F.col("dst").alias("node")).agg(F.sum("room").alias("excess")), "excess")
    arcs = residual = checkpointed(arcs.join(sources.withColumnRenamed("node", "src"), [*b, "src"], "left_anti"), "residual")
    arrived = excess.join(targets, [*b, "node"], "left_semi")
    excess = excess.join(targets, [*b, "node"], "left_anti")
    while True:
        levels, depth = _levels(residual, targets, b)
        active = checkpointed(excess.join(levels, [*b, "node"], "left").withColumn("height", F.coalesce("height", F.lit(-1))), "active")
        highest = active.where("height > 0").agg(F.max("height")).first()[0]
        if highest is None:
            break
        admissible = residual.join(levels.select(*b, F.col("node").alias("src"), F.col("height").alias("from")), [*b, "src"])
        admissible = admissible.join(levels.select(*b, F.col("node").alias("dst"), F.col("height").alias("to")), [*b, "dst"])
        admissible = checkpointed(admissible.where("from = to + 1").select(*b, "src", "dst", "from", "room"), "admissible")
        pushes, came = None, active.select(*b, "node", "excess")
        for height in range(highest, 0, -1):
            upto = F.sum("room").over(Window.partitionBy(*b, "src").orderBy("dst"))
            here = admissible.where(F.col("from") == height).withColumn("upto", upto).join(came.withColumnRenamed("node", "src"), [*b, "src"])
            pushed = here.select(*b, "src", "dst", F.greatest(F.lit(0), F.least("room", F.col("excess") - (F.col("upto") - F.col("room")))).alias("pushed")).where("pushed > 0")
            pushed = checkpointed(pushed, "pushed")
            pushes = pushed if pushes is None else pushes.unionByName(pushed)
            gone = pushed.select(*b, F.col("src").alias("node"), (-F.col("pushed")).alias("excess"))
            made = pushed.select(*b, F.col("dst").alias("node"), F.col("pushed").alias("excess"))
            came = came.unionByName(gone).unionByName(made).groupBy(*b, "node").agg(F.sum("excess").alias("excess")).where("excess > 0")
        came = checkpointed(came, "excess")
        arrived = arrived.unionByName(came.join(targets, [*b, "node"], "left_semi"))
        excess = came.join(targets, [*b, "node"], "left_anti")
        moved = pushes.select(*b, "src", "dst", (-F.col("pushed")).alias("room")).unionByName(pushes.select(*b, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("pushed").alias("room")))
        back = moved.join(out, [*b, "src"], "left_anti")  # nothing comes back from a target
        residual = checkpointed(residual.unionByName(back).groupBy(*b, "src", "dst").agg(F.sum("room").alias("room")).where("room > 0"), "residual")
    return Preflow(b, sources, targets, first, arcs, residual, excess, checkpointed(arrived, "arrived"), checkpointed(edges.select(*b).distinct(), "graphs") if b else None)


def _levels(residual: DataFrame, targets: DataFrame, b: list[str]) -> tuple[DataFrame, int]:
    """(*by, node, height): residual distance to the targets of the nodes that can reach one, and the greatest."""
    back = residual.select(*b, F.col("dst").alias("node"), F.col("src").alias("next"))
    frontier, height = targets.withColumn("height", F.lit(0)), 0
    reached = frontier
    while True:
        height += 1
        found = frontier.join(back, [*b, "node"]).select(*b, F.col("next").alias("node")).distinct().join(reached.select(*b, "node"), [*b, "node"], "left_anti")
        frontier = checkpointed(found.withColumn("height", F.lit(height)), "heights")
        if frontier.isEmpty():
            return reached, height - 1
        reached = reached.unionByName(frontier)


def values_after(edges: DataFrame, ends: DataFrame, removed: DataFrame) -> DataFrame:
    """(scenario, metric, flow) of the graph (src, dst) without the edges of each scenario of ``removed`` (scenario, src, dst),
    and of scenario ``intact``; ``ends`` as in ``values``. The graph is solved once, scenarios are changes of it."""
    metrics = [r["metric"] for r in ends.select("metric").distinct().orderBy("metric").collect()]  # a few pairs of sets
    many = edges.select("src", "dst", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    base = preflow(many, *(ends.where(side).select("metric", "node") for side in ("is_source", "not is_source")), ("metric",))
    flow = base.arrived.groupBy("metric").agg(F.sum("excess").alias("flow"))
    intact = base.graphs.join(flow, "metric", "left").select(F.lit("intact").alias("scenario"), "metric", F.coalesce("flow", F.lit(0)).cast("long").alias("flow"))
    return after_removals(base, removed).select("scenario", "metric", "flow").unionByName(intact)


def values(edges: DataFrame, ends: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, metric, flow) between the sets of ``ends`` (metric, node, is_source); every scenario has the same sets."""
    metrics = [r["metric"] for r in ends.select("metric").distinct().orderBy("metric").collect()]  # a few pairs of sets
    many = edges.select(*by, "src", "dst", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    scenarios = edges.select(*by).distinct() if by else None
    of = lambda side: (ends.where(side).select("metric", "node") if scenarios is None else scenarios.join(ends.where(side).select("metric", "node")))
    return max_flow(many, of("is_source"), of("not is_source"), (*by, "metric"))


def after_removals(base: Preflow, removed: DataFrame) -> DataFrame:
    """(scenario, *by, flow) of the graph of ``base`` without the edges of each scenario of ``removed`` (scenario, src, dst).

    No scenario is solved anew or holds a copy of the graph. Each is kept as differences from the base: what its removed
    arcs carried goes back to their tails, what lay beyond them is cancelled towards the targets, and then only the
    excess that can reach a target again is pushed, over the base's residual arcs and the scenario's changes of them. A
    repeated row of ``removed`` takes one more edge of that arc; edges that the base lacks or has no more of don't
    count. A scenario in which nothing that is removed carries flow has the base's flow.
    """
    b = base.by
    key = ["scenario", *b]
    scenarios = checkpointed(removed.select("scenario").distinct(), "scenarios")
    gone = removed.where("src != dst").groupBy("scenario", "src", "dst").agg(F.count("*").alias("gone"))
    from_source = gone.join(base.first, ["src", "dst"]).select(*key, "src", "dst", F.least("gone", "room").alias("gone"))
    inner = gone.join(base.arcs.withColumnRenamed("room", "cap"), ["src", "dst"]).join(base.residual, [*b, "src", "dst"], "left")
    # Of an arc of ``cap`` edges ``cap - room`` carry flow; ``over`` of them go.
    cut = F.least("gone", "cap")
    over = F.greatest(F.lit(0), F.col("cap") - F.coalesce("room", F.lit(0)) - (F.col("cap") - cut))
    inner = checkpointed(inner.select(*key, "src", "dst", cut.alias("gone"), over.cast("long").alias("over")), "removed")
    change = _changes(key, [inner.select(*key, "src", "dst", (F.col("over") - F.col("gone")).alias("delta")), inner.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("over")).alias("delta"))])
    extra = checkpointed(inner.where("over > 0").groupBy(*key, F.col("src").alias("node")).agg(F.sum("over").alias("delta")), "extra")
    lacking = from_source.select(*key, F.col("dst").alias("node"), F.col("gone").alias("need")).unionByName(inner.where("over > 0").select(*key, F.col("dst").alias("node"), F.col("over").alias("need")))
    lacking = checkpointed(lacking.groupBy(*key, "node").agg(F.sum("need").cast("long").alias("need")), "lacking")
    touched = checkpointed(lacking.select(*key).distinct(), "touched")
    arrived = None
    less = checkpointed(inner.select(*key, "src", "dst", "gone"), "gone")

    while not lacking.isEmpty():  # cancel what is missing, a step further towards the targets each time
        lost = lacking.join(base.targets, [*b, "node"], "left_semi").select(*key, (-F.col("need")).alias("delta"))
        arrived = lost if arrived is None else arrived.unionByName(lost)
        here = lacking.join(base.targets, [*b, "node"], "left_anti").join(base.excess, [*b, "node"], "left").join(extra, [*key, "node"], "left")
        here = checkpointed(here.select(*key, "node", "need", F.least("need", F.coalesce("excess", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("own")), "lacking")
        extra = checkpointed(extra.unionByName(here.select(*key, "node", (-F.col("own")).alias("delta"))).groupBy(*key, "node").agg(F.sum("delta").alias("delta")), "extra")
        rest = here.where("need > own").select(*key, F.col("node").alias("src"), (F.col("need") - F.col("own")).alias("need"))
        out = rest.join(base.arcs.withColumnRenamed("room", "cap"), [*b, "src"]).join(base.residual, [*b, "src", "dst"], "left").join(change, [*key, "src", "dst"], "left").join(less, [*key, "src", "dst"], "left")
        carried = F.col("cap") - F.coalesce("gone", F.lit(0)) - F.coalesce("room", F.lit(0)) - F.coalesce("delta", F.lit(0))
        out = out.withColumn("carried", carried).where("carried > 0")
        taken = checkpointed(_dealt(out, key, "carried", "need").select(*key, "src", "dst", "part"), "cancelled")
        change = _changes(key, [change, taken.select(*key, "src", "dst", F.col("part").alias("delta")), taken.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("part")).alias("delta"))])
        lacking = checkpointed(taken.groupBy(*key, F.col("dst").alias("node")).agg(F.sum("part").alias("need")), "lacking")

    while not touched.isEmpty():
        heights = _changed_levels(base, change, touched, key)
        active = heights.join(base.excess, [*b, "node"], "left").join(extra, [*key, "node"], "left")
        active = checkpointed(active.withColumn("excess", F.coalesce("excess", F.lit(0)) + F.coalesce("delta", F.lit(0))).where("height > 0 and excess > 0").select(*key, "node", "height", "excess"), "active")
        highest = active.agg(F.max("height")).first()[0]
        if highest is None:
            break
        touched = checkpointed(active.select(*key).distinct(), "touched")
        pushes, came = None, active.select(*key, "node", "excess")
        for height in range(highest, 0, -1):
            tails = heights.where(F.col("height") == height).select(*key, F.col("node").alias("src")).join(came.withColumnRenamed("node", "src"), [*key, "src"])
            heads = heights.where(F.col("height") == height - 1).select(*key, F.col("node").alias("dst"))
            ahead = _changed_arcs(base, change, tails, key, "src").join(heads, [*key, "dst"], "left_semi")
            pushed = checkpointed(_dealt(ahead, key, "room", "excess").select(*key, "src", "dst", "part"), "pushed")
            pushes = pushed if pushes is None else pushes.unionByName(pushed)
            moved = pushed.select(*key, F.col("src").alias("node"), (-F.col("part")).alias("excess")).unionByName(pushed.select(*key, F.col("dst").alias("node"), F.col("part").alias("excess")))
            came = came.unionByName(moved).groupBy(*key, "node").agg(F.sum("excess").alias("excess")).where("excess > 0")
        moved = checkpointed(pushes.select(*key, F.col("src").alias("node"), (-F.col("part")).alias("delta")).unionByName(pushes.select(*key, F.col("dst").alias("node"), F.col("part").alias("delta"))), "moved")
        gain = moved.join(base.targets, [*b, "node"], "left_semi").select(*key, "delta")
        arrived = gain if arrived is None else arrived.unionByName(gain)
        extra = checkpointed(extra.unionByName(moved.join(base.targets, [*b, "node"], "left_anti")).groupBy(*key, "node").agg(F.sum("delta").alias("delta")), "extra")
        back = pushes.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("part").alias("delta")).join(base.targets.withColumnRenamed("node", "src"), [*b, "src"], "left_anti")
        change = _changes(key, [change, pushes.select(*key, "src", "dst", (-F.col("part")).alias("delta")), back])

    flow = base.arrived.groupBy(*b).agg(F.sum("excess").alias("flow"))
    whole = scenarios.join(base.graphs).join(flow, b, "left") if b else scenarios.join(flow.agg(F.coalesce(F.sum("flow"), F.lit(0)).alias("flow")))  # a row a scenario and graph
    changed = None if arrived is None else arrived.groupBy(*key).agg(F.sum("delta").alias("delta"))
    whole = whole.withColumn("delta", F.lit(0)) if changed is None else whole.join(changed, key, "left")
    return whole.select(*key, (F.coalesce("flow", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast("long").alias("flow"))


def _changes(key: list[str], parts: list[DataFrame]) -> DataFrame:
    """(key, src, dst, delta): the sum of changes of residual arcs; those that cancel out are gone."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return checkpointed(every.groupBy(*key, "src", "dst").agg(F.sum("delta").cast("long").alias("delta")).where("delta != 0"), "changes")


def _dealt(arcs: DataFrame, key: list[str], room: str, amount: str) -> DataFrame:
    """``arcs`` with ``part``: the amount of their tail dealt to them in the order of heads, at most ``room`` each."""
    upto = F.sum(room).over(Window.partitionBy(*key, "src").orderBy("dst"))
    part = F.greatest(F.lit(0), F.least(F.col(room), F.col(amount) - (upto - F.col(room))))
    return arcs.withColumn("part", part.cast("long")).where("part > 0")


def _changed_arcs(base: Preflow, change: DataFrame, ends: DataFrame, key: list[str], end: str) -> DataFrame:
    """Residual arcs at ``ends`` (key, end, ...): the base's as the scenario has changed them, and those that it has anew."""
    b, others = base.by, [c for c in ends.columns if c not in key]
    old = ends.join(base.residual, [*b, end]).join(change, [*key, "src", "dst"], "left").select(*key, "src", "dst", *[c for c in others if c != end], (F.col("room") + F.coalesce("delta", F.lit(0))).alias("room"))
    new = ends.join(change, [*key, end]).join(base.residual.select(*b, "src", "dst"), [*b, "src", "dst"], "left_anti").select(*key, "src", "dst", *[c for c in others if c != end], F.col("delta").alias("room"))
    return old.unionByName(new).where("room > 0")


def _changed_levels(base: Preflow, change: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, height): residual distance to the targets in each touched scenario."""
    frontier = checkpointed(touched.join(base.targets, base.by) if base.by else touched.join(base.targets), "heights").select(*key, "node", F.lit(0).alias("height"))
    reached, height = frontier, 0
    while True:
        height += 1
        found = _changed_arcs(base, change, frontier.select(*key, F.col("node").alias("dst")), key, "dst").select(*key, F.col("src").alias("node")).distinct()
        frontier = checkpointed(found.join(reached.select(*key, "node"), [*key, "node"], "left_anti").withColumn("height", F.lit(height)), "heights")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
