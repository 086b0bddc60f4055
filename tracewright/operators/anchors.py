"""Local anchors of retention-time drift, nearest in RT and injection order, and what they predict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_of, median
from ..functions.tables import written
from .joins import k_nearest

#: The window in minutes and injections, the anchors that cover a place, and the most that predict.
RT_WINDOW, ORDER_WINDOW, LEAST, MOST = 4.0, 25.0, 3, 8
#: Sides of grid cells, in windows, at which all anchors of a window are looked for step by step.
FINE = (1 / 64, 1 / 16, 1 / 4, 1.0)

_ANCHOR = ("anchor", "anchor_rt", "anchor_order", "delta")


def _near(probes: DataFrame, anchors: DataFrame, size: float) -> DataFrame:
    """Probes with the anchors in the cells around their own: none within `size` windows in either direction is left out."""
    cell = lambda c: F.floor(F.col(c) / (size * 1.001))  # a little wider than what must not be missed
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    asked = probes.select("*", around("x").alias("_cx")).select("*", around("y").alias("_cy"))
    known = anchors.select(cell("ax").alias("_cx"), cell("ay").alias("_cy"), *_ANCHOR, "ax", "ay")
    minutes, orders = F.abs(F.col("rt") - F.col("anchor_rt")), F.abs(F.col("injection_order") - F.col("anchor_order"))
    return asked.hint("merge").join(known.hint("merge"), ["_cx", "_cy"]).where(F.col("probe") != F.col("anchor")).withColumns({"distance": minutes / RT_WINDOW + orders / ORDER_WINDOW, "_in": (minutes <= RT_WINDOW) & (orders <= ORDER_WINDOW)}).drop("_cx", "_cy")


def local_anchors(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, tier, rank, anchor, anchor_rt, anchor_order, delta, distance, in_window) of each probe's local anchors.

    anchors: (anchor, compound, rt, injection_order, delta), all known and anchor unique. probes: (probe, compound, rt, injection_order); those
    without an RT or order have no anchors, and one is never its own (of the same name). Tiers, by the first that holds:
    compound, the MOST anchors of the probe's compound nearest in injection order, if there are two; window, of the anchors within both
    windows the MOST nearest, if there are LEAST; nearest, the LEAST nearest of all. Distances are in windows, RT's and order's added; ties go to
    the smaller name.

    Probes are looked for in grid cells, first in small ones: a probe whose MOST anchors lie within a cell's side is done. Those without enough
    anchors in their window look on in cells that grow fourfold, until their LEAST nearest lie within a side.
    """
    anchors = written(anchors.select(F.col("anchor").alias("anchor"), "compound", F.col("rt").alias("anchor_rt"), F.col("injection_order").alias("anchor_order"), "delta", (F.col("rt") / RT_WINDOW).alias("ax"), (F.col("injection_order") / ORDER_WINDOW).alias("ay")))
    probes = written(probes.where("rt IS NOT NULL AND injection_order IS NOT NULL").select("probe", "compound", "rt", "injection_order", (F.col("rt") / RT_WINDOW).alias("x"), (F.col("injection_order") / ORDER_WINDOW).alias("y")))
    none = lambda t: F.lit(None).cast(t)
    # Both sides as one table, in which a probe and an anchor of one name are two rows.
    both = probes.where("compound IS NOT NULL").select(F.col("probe").alias("name"), "compound", F.col("injection_order").cast("long").alias("order"), none("double").alias("rt"), none("double").alias("delta"), F.lit(True).alias("asks")).unionByName(
        anchors.where("compound IS NOT NULL").select(F.col("anchor").alias("name"), "compound", F.col("anchor_order").cast("long").alias("order"), F.col("anchor_rt").alias("rt"), "delta", F.lit(False).alias("asks"))
    )
    same = k_nearest(both, ~F.col("asks"), F.col("asks"), ["compound"], "order", "name", MOST, ["rt", "delta"])
    held = same.withColumn("_n", F.count("*").over(W.partitionBy("compound", "name"))).where("_n >= 2")
    own = held.select(F.col("name").alias("probe"), "rank", "anchor", F.col("anchor_rt"), F.col("anchor_order"), F.col("anchor_delta").alias("delta")).join(probes.select("probe", "rt", "injection_order").hint("merge"), "probe")
    minutes, orders = F.abs(F.col("rt") - F.col("anchor_rt")), F.abs(F.col("injection_order") - F.col("anchor_order"))
    out = ["probe", "tier", "rank", *_ANCHOR, "distance", "in_window"]
    done = [written(own.select("probe", F.lit("compound").alias("tier"), "rank", *_ANCHOR, (minutes / RT_WINDOW + orders / ORDER_WINDOW).alias("distance"), ((minutes <= RT_WINDOW) & (orders <= ORDER_WINDOW)).alias("in_window")))]
    rest = written(probes.join(done[0].select("probe").distinct(), "probe", "left_anti"))

    def first(near: DataFrame, k: int, tier: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("probe").orderBy("distance", "anchor"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", F.lit(tier).alias("tier"), "rank", *_ANCHOR, "distance", F.col("_in").alias("in_window"))

    def settle(found: DataFrame, enough: Column) -> None:
        nonlocal rest
        good = found.groupBy("probe").agg(enough.alias("_ok")).where("_ok").select("probe")
        done.append(written(found.join(good, "probe")))
        rest = written(rest.join(done[-1].select("probe").distinct(), "probe", "left_anti"))

    for size in FINE:
        found = written(first(_near(rest, anchors, size).where("_in"), MOST, "window"))
        settle(found, F.count("*") >= LEAST if size == 1 else F.count_if(F.col("distance") <= size) >= MOST)
    ends = anchors.agg(*[f(c) for c in ("ax", "ay") for f in (F.min, F.max)]).first()
    edge = rest.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    size = FINE[-1]
    if ends[0] is not None:
        reach = lambda i: max(ends[i + 1], edge[i + 1]) - min(ends[i], edge[i])
        while not rest.isEmpty():
            size *= 4
            whole = size >= max(reach(0), reach(2))
            settle(written(first(_near(rest, anchors, size), LEAST, "nearest")), F.lit(True) if whole else F.count_if(F.col("distance") <= size) >= LEAST)
            if whole:
                break
    return reduce(DataFrame.unionByName, [d.select(*out) for d in done])


def local_drift(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, tier, predicted, uncertainty, residual_p95, anchors, coverage, scope, position) of every probe.

    predicted: the mean of its local anchors' deltas, weighted by 1 / (0.25 + minutes) and 1 / (1 + injections / 10); uncertainty and
    residual_p95: the median and 95th percentile of their distances to it. coverage: incomplete (no RT or injection order), unsupported (no
    anchors), extrapolated (outside the anchors' RTs or orders), covered (LEAST of the local ones in both windows) or sparse. scope and position:
    where the RT lies on the anchors' range, in percent.
    """
    near = local_anchors(anchors, probes).join(probes.select("probe", "rt", "injection_order").hint("merge"), "probe")
    weight = 1 / (0.25 + F.abs(F.col("rt") - F.col("anchor_rt"))) / (1 + F.abs(F.col("injection_order") - F.col("anchor_order")) / 10)
    guess = near.withColumn("_w", weight).withColumn("predicted", F.sum(F.col("_w") * F.col("delta")).over(W.partitionBy("probe")) / F.sum("_w").over(W.partitionBy("probe")))
    off = F.abs(F.col("delta") - F.col("predicted"))
    found = guess.groupBy("probe", "tier", "predicted").agg(median(off).alias("uncertainty"), F.percentile(off, 0.95).alias("residual_p95"), F.count("*").alias("anchors"), F.count_if("in_window").alias("_window"))
    range_ = anchors.agg(F.min("rt").alias("_r0"), F.max("rt").alias("_r1"), F.min("injection_order").alias("_o0"), F.max("injection_order").alias("_o1"))
    rows = probes.select("probe", "rt", "injection_order").join(found.hint("merge"), "probe", "left").join(F.broadcast(range_))  # one row
    rt, order = F.col("rt"), F.col("injection_order")
    beyond = (rt < F.col("_r0")) | (rt > F.col("_r1")) | (order < F.col("_o0")) | (order > F.col("_o1"))
    coverage = first_of(
        (F.col("_r0").isNull(), "unsupported"), (rt.isNull() | order.isNull(), "incomplete"), (F.col("predicted").isNull(), "unsupported"), (beyond, "extrapolated"), (F.col("_window") >= LEAST, "covered"), otherwise="sparse"
    )
    wide = F.col("_r1") - F.col("_r0") > 1e-9 * F.greatest(F.abs("_r0"), F.abs("_r1"))
    scope = first_of((F.col("_r0").isNull(), "no_rt_anchors"), (rt.isNull(), "not_assessable"), (~wide, "single_anchor_rt"), (rt < F.col("_r0"), "before_anchor_range"), (rt > F.col("_r1"), "after_anchor_range"), otherwise="inside_anchor_range")
    position = F.when(wide, 100 * (rt - F.col("_r0")) / (F.col("_r1") - F.col("_r0")))
    return rows.select("probe", "tier", "predicted", "uncertainty", "residual_p95", F.coalesce("anchors", F.lit(0).cast("long")).alias("anchors"), coverage.alias("coverage"), scope.alias("scope"), position.alias("position"))
