"""Operators over ordered traces in long form: (trace_id, idx, rt, intensity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered() -> WindowSpec:
    """A trace's points in order."""
    return W.partitionBy("trace_id").orderBy("idx")


def upto() -> WindowSpec:
    """A trace's points up to each one."""
    return ordered().rowsBetween(W.unboundedPreceding, 0)


def backwards() -> WindowSpec:
    """A trace's points after each one, as a running window from the end, which costs no more than one from the start."""
    return W.partitionBy("trace_id").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)


def whole_trace() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def trapezoid(traces: DataFrame, value: str = "intensity", keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Area under each trace in value times seconds; rt is in minutes."""
    order = W.partitionBy(*keys).orderBy("idx")
    part = (F.col("rt") - F.lag("rt").over(order)) * (F.col(value) + F.lag(value).over(order)) / 2
    return traces.select(*keys, part.alias("_part")).groupBy(*keys).agg((F.coalesce(F.sum("_part"), F.lit(0.0)) * 60).alias("area"))


def residual_mad(traces: DataFrame) -> DataFrame:
    """Median, median absolute deviation and noise floor (3 x 1.4826 x MAD) of each trace, in two passes."""
    centre = traces.groupBy("trace_id").agg(F.percentile("intensity", 0.5).alias("median"), F.count("*").alias("n"))
    off = traces.join(centre, "trace_id").select("trace_id", "median", "n", F.abs(F.col("intensity") - F.col("median")).alias("_off"))
    return off.groupBy("trace_id", "median", "n").agg(F.percentile("_off", 0.5).alias("mad")).withColumn("noise_floor", F.col("mad") * 3 * 1.4826)


def area_uncertainty(traces: DataFrame) -> DataFrame:
    """MAD times the median scan period in seconds times the square root of the number of points."""
    period = traces.select("trace_id", ((F.col("rt") - F.lag("rt").over(ordered())) * 60).alias("_p")).groupBy("trace_id").agg(F.percentile("_p", 0.5).alias("period_sec"))
    return residual_mad(traces).join(period, "trace_id").select("trace_id", (F.col("mad") * F.col("period_sec") * F.sqrt("n")).alias("uncertainty"))


def weighted_neighbours(traces: DataFrame, weights: list[float], edge: str) -> DataFrame:
    """Smoothed values: a weighted sum of a point's neighbours; beyond an end they count as 0 ("zero") or as the end ("nearest")."""
    half = len(weights) // 2
    first, last = F.first("intensity").over(whole_trace()), F.last("intensity").over(whole_trace())
    at = lambda k: F.lag("intensity", -k).over(ordered()) if k else F.col("intensity")
    beyond = lambda k: F.lit(0.0) if edge == "zero" else (first if k < 0 else last)
    terms = [F.coalesce(at(k), beyond(k)) * w for k, w in zip(range(-half, half + 1), weights, strict=True)]
    return traces.withColumn("smoothed", sum(terms[1:], terms[0]))


def gaussian_weights(window: int, sigma: float) -> list[float]:
    """Normalised weights of a Gaussian over an odd window."""
    import math

    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-(window // 2), window // 2 + 1)]
    return [w / sum(raw) for w in raw]


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights with which a least-squares polynomial over the window gives its middle value."""
    import numpy as np

    x = np.arange(-(window // 2), window // 2 + 1)
    return [float(w) for w in np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]]


def marked_maxima(traces: DataFrame) -> DataFrame:
    """(trace_id, idx, rt, intensity, is_peak) of all points; local_maxima() says which are peaks. Windows over one dealing of the traces, which are never
    joined with themselves: a task holds two sorts of its points, whatever the number of rules."""
    value, down = F.col("intensity"), W.partitionBy("trace_id").orderBy(F.desc("idx"))
    after, before = F.lag("intensity").over(down), F.lead("intensity").over(down)
    # Where a run of equal values ends: the place, and 1 if it is above the value beyond, 0 if there is none, else 2; a number takes less of a sort than a struct.
    side = lambda other: F.when(F.coalesce(value != other, F.lit(True)), F.col("idx").cast("long") * 4 + F.when(other.isNull(), 0).when(value > other, 1).otherwise(2))
    # A run carries its last point along from the end of the trace, and then its first one from the start, in which order the points stay.
    ends = traces.select("trace_id", "idx", "rt", "intensity", side(before).alias("_first"), side(after).alias("_last"))
    right = ends.withColumn("_last", F.last("_last", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    run = right.withColumn("_first", F.last("_first", ignorenulls=True).over(upto()))
    l, r, v, w = F.shiftright("_first", 2), F.shiftright("_last", 2), F.col("_first").bitwiseAND(F.lit(3)), F.col("_last").bitwiseAND(F.lit(3))
    # A plateau at an end is no peak; a single end point above its neighbour is.
    edge = (l == r) & (((v == 0) & (w == 1)) | ((w == 0) & (v == 1)))
    found = run.withColumn("_peak", (F.col("idx") == F.floor((l + r) / 2)) & (((v == 1) & (w == 1)) | edge)).drop("_first", "_last")
    whole = W.partitionBy("trace_id")
    told = found.withColumns({"_any": F.max("_peak").over(whole), "_top": F.min(F.struct((-value).alias("minus"), "idx")).over(whole)})
    return told.select("trace_id", "idx", "rt", "intensity", (F.col("_peak") | (~F.col("_any") & (F.col("idx") == F.col("_top.idx")))).alias("is_peak"))


def local_maxima(traces: DataFrame) -> DataFrame:
    """(trace_id, idx, rt, intensity) of local peaks: strict maxima, the lower middle of plateaus, ends above their neighbour; without any of
    these the first maximum of the trace."""
    return marked_maxima(traces).where("is_peak").drop("is_peak")


def thresholds(traces: DataFrame, fraction: float) -> DataFrame:
    """A trace's lowest value plus a fraction of its range."""
    low, high = F.min("intensity"), F.max("intensity")
    return traces.groupBy("trace_id").agg((low + (high - low) * fraction).alias("threshold"))


def threshold_bounds(traces: DataFrame, peaks: DataFrame, levels: DataFrame) -> DataFrame:
    """(trace_id, idx, left, right): around each peak, the first and last point of the unbroken run above the level (right is exclusive)."""
    marked = traces.join(levels, "trace_id").select("trace_id", "idx", (F.col("intensity") <= F.col("threshold")).alias("_below"))
    near = marked.select(
        "trace_id", "idx",
        F.max(F.when(F.col("_below"), F.col("idx"))).over(ordered().rowsBetween(W.unboundedPreceding, -1)).alias("_lo"),
        F.min(F.when(F.col("_below"), F.col("idx"))).over(backwards()).alias("_hi"),
        F.max("idx").over(W.partitionBy("trace_id")).alias("_end"),
    )
    return peaks.select("trace_id", "idx").join(near, ["trace_id", "idx"]).select(
        "trace_id", "idx", F.coalesce(F.col("_lo") + 1, F.lit(0)).cast("int").alias("left"), F.coalesce("_hi", F.col("_end") + 1).cast("int").alias("right")
    )


def valley_splits(traces: DataFrame, peaks: DataFrame, min_gap: float, min_ratio: float) -> DataFrame:
    """Consecutive peaks of each trace with the valley between them and whether they are split there."""
    by = W.partitionBy("trace_id").orderBy("idx")
    pairs = peaks.select(
        "trace_id", F.lag("idx").over(by).alias("left_peak"), F.col("idx").alias("right_peak"), F.lag("rt").over(by).alias("_lrt"), F.col("rt").alias("_rrt"), F.lag("intensity").over(by).alias("_li"), F.col("intensity").alias("_ri")
    ).where("left_peak IS NOT NULL")
    # Points belong to the last peak up to them; between two peaks there is a lower point than either.
    marked = traces.select("trace_id", "idx", "intensity").join(peaks.select("trace_id", "idx", F.col("idx").alias("_peak")), ["trace_id", "idx"], "left")
    lowest = marked.withColumn("left_peak", F.last("_peak", ignorenulls=True).over(upto())).groupBy("trace_id", "left_peak").agg(F.min(F.struct("intensity", "idx")).alias("_v"))
    found = pairs.join(lowest, ["trace_id", "left_peak"])
    depth = F.col("_v.intensity")
    split = (F.col("_rrt") - F.col("_lrt") >= min_gap) & ((depth <= 0) | ((F.col("_li") / depth >= min_ratio) & (F.col("_ri") / depth >= min_ratio)))
    return found.select("trace_id", "left_peak", "right_peak", F.col("_v.idx").alias("valley"), F.coalesce(split, F.lit(False)).alias("split"))


def regions(traces: DataFrame, fraction: float, min_gap: float, min_ratio: float) -> DataFrame:
    """(trace_id, region, left, right): the trace cut at split valleys, from the first peak's threshold bound to the last one's; right is exclusive."""
    value, whole = F.col("intensity"), W.partitionBy("trace_id")
    low, high = F.min("intensity").over(whole), F.max("intensity").over(whole)
    levelled = marked_maxima(traces).withColumn("_below", value <= low + (high - low) * fraction)
    # Points belong to the last peak up to them, those before the first peak to none; all of this is one dealing of the traces.
    owned = levelled.withColumn("peak", F.last(F.when(F.col("is_peak"), F.col("idx")), ignorenulls=True).over(upto()))
    parts = owned.groupBy("trace_id", "peak").agg(
        F.min(F.struct("intensity", "idx")).alias("v"), F.max(F.when(F.col("is_peak"), F.struct("idx", "rt", "intensity"))).alias("p"), F.max(F.when(F.col("_below"), F.col("idx"))).alias("low"),
        F.coalesce(F.min(F.when(F.col("_below") & ~F.col("is_peak"), F.col("idx"))), F.max("idx") + 1).alias("stop"),
    )
    by = W.partitionBy("trace_id").orderBy(F.asc_nulls_first("peak"))
    met = parts.withColumn("_b", F.lag(F.struct("peak", "p", "v", "low")).over(by)).withColumn("_last", F.last("stop").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    depth, a, z = F.col("_b.v.intensity"), F.col("_b.p"), F.col("p")
    split = (z["rt"] - a["rt"] >= min_gap) & ((depth <= 0) | ((a["intensity"] / depth >= min_ratio) & (z["intensity"] / depth >= min_ratio)))
    cut = F.when(F.coalesce(split, F.lit(False)), F.col("_b.v.idx"))
    begins = met.where("peak IS NOT NULL").withColumns({"_cut": cut, "_opens": F.col("_b.peak").isNull()}).where("_opens OR _cut IS NOT NULL")
    left = F.when(F.col("_opens"), F.coalesce(F.col("_b.low") + 1, F.lit(0))).otherwise(F.least(F.col("_cut") + 1, F.col("peak")))
    right = F.coalesce(F.lead("_cut").over(by) + 1, F.col("_last"))
    return begins.select("trace_id", F.row_number().over(by).cast("int").alias("region"), left.cast("int").alias("left"), right.cast("int").alias("right"))


def inside(traces: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("trace_id", "region")) -> DataFrame:
    """Points with the interval [left, right) that holds them. Intervals of a trace don't overlap, so a point's is the last one that begins
    up to it, which a running window carries along."""
    own = [k for k in keys if k != "trace_id"]
    carried = F.struct(*own, "left", "right")
    # Intervals are rows of their own before their first point, so that traces are dealt once and not joined point by point.
    starts = intervals.select("trace_id", F.col("left").alias("idx"), carried.alias("_interval"), F.lit(0).alias("_point"))
    both = traces.withColumn("_point", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy("trace_id").orderBy("idx", "_point").rowsBetween(W.unboundedPreceding, 0)
    marked = both.withColumn("_interval", F.last("_interval", ignorenulls=True).over(order))
    return marked.where((F.col("_point") == 1) & (F.col("idx") < F.col("_interval.right"))).select(*traces.columns, *[F.col(f"_interval.{k}").alias(k) for k in (*own, "left", "right")])


def apexes(traces: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("trace_id", "region")) -> DataFrame:
    """The first maximum inside each interval [left, right); intervals of a trace don't overlap."""
    return inside(traces, intervals, keys).groupBy(*keys, "left", "right").agg(F.min(F.struct((-F.col("intensity")).alias("minus"), "idx", "rt")).alias("_a"), F.count("*").alias("scans")).select(
        *keys, "left", "right", "scans", F.col("_a.idx").alias("apex_idx"), F.col("_a.rt").alias("apex_rt"), (-F.col("_a.minus")).alias("apex_intensity")
    )


def continuity(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """1 less the share of sign changes among steps of at least 5 % of the dynamic range; null under five points, 0 without a range."""
    by = W.partitionBy(*keys).orderBy("idx")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = F.greatest(F.first("intensity").over(whole), F.last("intensity").over(whole))
    steps = points.select(*keys, "idx", (F.col("intensity") - F.lag("intensity").over(by)).alias("_step"), (F.max("intensity").over(whole) - edge).alias("_range"), F.count("*").over(whole).alias("_n"))
    signs = steps.withColumn("_s", F.when(F.abs("_step") >= F.col("_range") * 0.05, F.signum("_step")))
    told = signs.withColumn("_was", F.last("_s", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    facts = told.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_range").alias("_range"), F.count("_s").alias("_k"), F.count_if(F.col("_s") != F.col("_was")).alias("_changes"))
    score = F.when(F.coalesce("_k", F.lit(0)) <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_changes") / F.greatest(F.lit(1), F.col("_k") - 1)))
    return facts.select(*keys, F.when(F.col("_n") < 5, None).when(F.col("_range") <= 0, 0.0).otherwise(score).alias("continuity"))


def jaggedness(traces: DataFrame) -> DataFrame:
    """Sum of absolute second differences over range and length, with its severity."""
    second = F.abs(F.col("intensity") - 2 * F.lag("intensity", 1).over(ordered()) + F.lag("intensity", 2).over(ordered()))
    facts = traces.select("trace_id", "intensity", second.alias("_d")).groupBy("trace_id").agg(F.sum("_d").alias("_d"), (F.max("intensity") - F.min("intensity")).alias("_span"), F.count("*").alias("_n"))
    jag = F.when((F.col("_n") < 3) | (F.col("_span") <= 0), 0.0).otherwise(F.col("_d") / (F.col("_span") * F.col("_n")))
    return facts.select("trace_id", jag.alias("jaggedness"), F.when(jag > 0.5, 2).when(jag > 0.3, 1).otherwise(0).alias("severity"))


def crossings(traces: DataFrame, peaks: DataFrame, levels: DataFrame, block: int = 64, inclusive: bool = False) -> DataFrame:
    """(trace_id, idx, left, right): the last point before each peak and the first one after it that lie below the peak's level, or on it if
    inclusive; null where there is none. levels: (trace_id, idx, level), of the peaks.

    Points are summed up as blocks with their least intensity. Each peak looks for the nearest block that goes below its level, and then
    for the point in that block, so that it meets the blocks of its trace and the points of at most four of them.
    """
    blocks = traces.groupBy("trace_id", F.floor(F.col("idx") / block).alias("block")).agg(F.min("intensity").alias("least"))
    wanted = peaks.select("trace_id", "idx").join(levels, ["trace_id", "idx"]).withColumn("own", F.floor(F.col("idx") / block))
    sign = "<=" if inclusive else "<"
    low = wanted.join(blocks, "trace_id").where(f"least {sign} level")
    near = low.groupBy("trace_id", "idx", "level", "own").agg(
        F.max(F.when(F.col("block") < F.col("own"), F.col("block"))).alias("_l"), F.min(F.when(F.col("block") > F.col("own"), F.col("block"))).alias("_r")
    )
    sought = near.select("trace_id", "idx", "level", F.explode(F.array_distinct(F.array_compact(F.array("_l", "own", "_r")))).alias("block"))
    points = traces.select("trace_id", F.floor(F.col("idx") / block).alias("block"), F.col("idx").alias("_i"), F.col("intensity").alias("_v"))
    hit = sought.join(points, ["trace_id", "block"]).where(f"_v {sign} level")
    side = lambda c: F.when(c, F.col("_i"))
    found = hit.groupBy("trace_id", "idx").agg(F.max(side(F.col("_i") < F.col("idx"))).alias("left"), F.min(side(F.col("_i") > F.col("idx"))).alias("right"))
    return wanted.select("trace_id", "idx").join(found, ["trace_id", "idx"], "left")


def half_height(traces: DataFrame, peaks: DataFrame) -> DataFrame:
    """Half-height interval of each peak: its bounds, width in minutes and the ratio of its sides."""
    ends = traces.groupBy("trace_id").agg(F.max("idx").alias("_end"))
    found = crossings(traces, peaks, peaks.select("trace_id", "idx", (F.col("intensity") / 2).alias("level"))).withColumnsRenamed({"left": "_l", "right": "_r"})
    found = found.join(ends, "trace_id").join(peaks.select("trace_id", "idx", F.col("rt").alias("_rt")), ["trace_id", "idx"])
    left, right = F.coalesce(F.col("_l") + 1, F.lit(0)), F.coalesce(F.col("_r") - 1, F.col("_end"))
    at = lambda k: traces.select("trace_id", F.col("idx").alias(k), F.col("rt").alias(f"{k}_rt"))
    placed = found.select("trace_id", "idx", "_rt", left.alias("left"), right.alias("right")).join(at("left"), ["trace_id", "left"]).join(at("right"), ["trace_id", "right"])
    a, b = F.col("_rt") - F.col("left_rt"), F.col("right_rt") - F.col("_rt")
    return placed.select("trace_id", "idx", F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"), (F.col("right_rt") - F.col("left_rt")).alias("fwhm"), F.when(a > 0, b / a).alias("half_width_ratio"))


def selected(candidates: DataFrame, preferred: Column, tolerance: float) -> DataFrame:
    """One candidate for each trace: the strongest of those near the preferred RT, or without any the strongest; ties go to the earlier apex."""
    far = (F.abs(F.col("apex_rt") - preferred) > tolerance).cast("int")
    by = W.partitionBy("trace_id").orderBy(far, F.desc("apex_intensity"), "apex_idx")
    return candidates.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def gap_islands(rows: DataFrame, keys: list[str], value: str, gap: float, tie: str) -> DataFrame:
    """`island`, numbered from 1: a new one starts where a value lies more than `gap` above the one before.

    Values are cut into buckets, in which islands are counted, and then the buckets' ends alone are put in order for each key: no task sorts all
    of a key's rows.
    """
    wide = rows.withColumn("_bucket", F.floor(F.col(value) / (64.0 * gap)))
    by = W.partitionBy(*keys, "_bucket").orderBy(value, tie)
    new = F.when(F.row_number().over(by) > 1, F.coalesce((F.col(value) - F.lag(value).over(by) > gap).cast("int"), F.lit(1))).otherwise(0)
    marked = wide.withColumn("_new", new).withColumn("_in", F.sum("_new").over(by))
    ends = marked.groupBy(*keys, "_bucket").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_new").alias("_n"))
    along = W.partitionBy(*keys).orderBy("_bucket")
    opens = F.coalesce((F.col("_low") - F.lag("_high").over(along) > gap).cast("int"), F.lit(1))
    counted = ends.withColumn("_opens", opens).withColumn("_base", F.sum(F.col("_opens") + F.col("_n")).over(along) - F.col("_n"))
    other = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_base")
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return marked.join(other, same).select(*rows.columns, (F.col("_base") + F.col("_in")).cast("int").alias("island"))
