"""The quality of peaks on their traces: signal to noise, width, sharpness, zigzag, tailing and margin, in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, finite, first_of

#: The limits of support, and the factors that make deviations comparable to a standard deviation.
LEAST_POINTS, LEAST_INSIDE, LEAST_FEATURES = 5, 3, 4
LEAST_SIGNAL, MOST_ZIGZAG, LEAST_SHARPNESS = 3.0, 0.6, 0.1
MAD_FACTOR, STEP_FACTOR = 1.4826, 0.7413
FEATURES = ("signal_to_noise", "fwhm_sec", "sharpness", "zigzag", "tailing_ratio", "boundary_margin_ratio")
EMPTY = (
    "no_raw_trace_vector",
    "insufficient_raw_trace_vector_points",
    "cell_boundary_missing_for_peak_quality_vector",
    "cell_boundary_invalid_for_peak_quality_vector",
    "insufficient_boundary_vector_points",
)


def _middle(values: Column) -> Column:
    """The median of an array."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _heights(points: Column | str) -> Column:
    return F.transform(points, lambda p: p["intensity"])


def _crossing(below: Column, step: int) -> Column:
    """Where the trace passes the half height between a point at or below it and its neighbour towards the apex."""
    other = F.get("points", below["at"] + step)
    rise = other["intensity"] - below["intensity"]
    return F.when(rise == 0, below["rt"]).otherwise(below["rt"] + (other["rt"] - below["rt"]) * (F.col("half") - below["intensity"]) / rise)


def _sign_changes() -> Column:
    """The share of inner steps, equal neighbours aside, at which the trace turns."""
    values = _heights("inside")
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size("inside") - 1), lambda i: F.get(values, i) - F.get(values, i - 1)), lambda d: d != 0)

    def share(own: Column) -> Column:
        turns = F.size(F.filter(F.sequence(F.lit(1), F.size(own) - 1), lambda i: (F.get(own, i) > 0) != (F.get(own, i - 1) > 0)))
        return F.when(F.size(own) < 2, 0.0).otherwise(turns / (F.size(own) - 1))

    return F.transform(F.array(steps), share)[0]  # names the steps, which are used four times


def quality_vectors(traces: DataFrame, cells: DataFrame) -> DataFrame:
    """The columns of cells and status, reason, points, inside, the six features (null where they can't be had) and feature_count.

    traces: (trace_id, rt, intensity); points that aren't finite don't count, and equal RTs go by intensity. cells: (trace_id, start_rt, end_rt
    and others); a cell's inside are its trace's points between its ends. Baseline and noise are the median and the scaled median deviation of
    the points outside, if there are three, else of all; where that is 0, of the steps between points. The width at half height above the baseline
    is taken on the whole trace. Without enough points or a valid boundary the status is not_available, with one of five reasons and no features;
    under four features it is inconclusive; else supportive, or partial_support with what speaks against it.
    """
    fine = finite(F.col("rt")) & finite(F.col("intensity"))
    point = F.when(fine, F.struct("rt", "intensity"))
    held = traces.groupBy("trace_id").agg(F.array_sort(F.collect_list(point)).alias("_p"))
    held = held.select("trace_id", F.transform("_p", lambda p, i: F.struct(i.alias("at"), p["rt"].alias("rt"), p["intensity"].alias("intensity"))).alias("points"))
    own = cells.columns
    rows = cells.join(held, "trace_id", "left").withColumn("points", F.coalesce("points", F.expr("CAST(array() AS array<struct<at: int, rt: double, intensity: double>>)")))
    n, m = F.size("points"), F.size("inside")
    within = lambda p: (p["rt"] >= F.col("start_rt")) & (p["rt"] <= F.col("end_rt"))
    rows = rows.withColumn("inside", F.filter("points", within)).withColumn("outside", F.filter("points", lambda p: ~within(p)))
    reason = first_of(
        (n == 0, EMPTY[0]), (n < LEAST_POINTS, EMPTY[1]), (F.col("start_rt").isNull() | F.col("end_rt").isNull(), EMPTY[2]),
        (F.col("end_rt") <= F.col("start_rt"), EMPTY[3]), (m < LEAST_INSIDE, EMPTY[4]),
    )
    rows = rows.withColumn("_empty", reason)
    usable = F.col("_empty").isNull()

    values = F.when(F.size("outside") >= 3, _heights("outside")).otherwise(_heights("points"))
    rows = rows.withColumn("_values", F.when(usable, values)).withColumn("base", _middle(F.col("_values")))
    spread = _middle(F.transform("_values", lambda v: F.abs(v - F.col("base")))) * MAD_FACTOR
    heights = _heights("points")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get(heights, i) - F.get(heights, i - 1)))
    rows = rows.withColumn("_spread", spread).withColumn("noise", F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(F.when(usable, _middle(steps) * STEP_FACTOR)))
    top = F.array_max(_heights("inside"))
    rows = rows.withColumn("top", F.when(usable, top)).withColumn("apex", F.get(F.filter("inside", lambda p: p["intensity"] == F.col("top")), F.lit(0)))
    rows = rows.withColumn("half", F.when(F.col("top") > F.col("base"), F.col("base") + (F.col("top") - F.col("base")) / 2))
    low = lambda side: F.filter("points", lambda p: side(p["at"], F.col("apex.at")) & (p["intensity"] <= F.col("half")))
    rows = rows.withColumn("_left", F.element_at(F.when(F.size(low(lambda a, b: a < b)) > 0, low(lambda a, b: a < b)), -1)).withColumn("_right", F.get(low(lambda a, b: a > b), F.lit(0)))
    rows = rows.withColumn("left_rt", _crossing(F.col("_left"), 1)).withColumn("right_rt", _crossing(F.col("_right"), -1))
    wide = F.col("right_rt") > F.col("left_rt")
    before, after = F.greatest(F.lit(0.0), F.col("apex.rt") - F.col("left_rt")), F.greatest(F.lit(0.0), F.col("right_rt") - F.col("apex.rt"))
    edge = F.greatest(F.get("inside", F.lit(0))["intensity"], F.element_at("inside", -1)["intensity"])
    outer = F.array_max(_heights("outside"))
    rows = rows.withColumns({
        "signal_to_noise": F.when(F.col("noise") > 0, F.greatest(F.lit(0.0), F.col("top") - F.col("base")) / F.col("noise")),
        "fwhm_sec": F.when(wide, (F.col("right_rt") - F.col("left_rt")) * 60),
        "sharpness": F.when(usable & (F.col("top") > 0), clamp((F.col("top") - edge) / F.col("top"), 0.0, 1.0)),
        "zigzag": F.when(usable & (m >= 4), _sign_changes()),
        "tailing_ratio": F.when(wide & (before > 0), after / before),
        "boundary_margin_ratio": F.when(usable & (outer > 0), F.col("top") / outer),
    })
    count = sum((F.col(c).isNotNull().cast("int") for c in FEATURES), F.lit(0))
    against = F.array_compact(F.array(
        F.when(F.col("signal_to_noise") < LEAST_SIGNAL, "low_signal_to_noise_proxy"), F.when(F.col("fwhm_sec").isNull(), "fwhm_unavailable"),
        F.when(F.col("sharpness") < LEAST_SHARPNESS, "low_peak_sharpness"), F.when(F.col("zigzag") > MOST_ZIGZAG, "high_local_zigzag"),
    ))
    status = first_of((~usable, "not_available"), (count < LEAST_FEATURES, "inconclusive"), (F.size(against) > 0, "partial_support"), otherwise="supportive")
    why = first_of(
        (~usable, F.col("_empty")), (count < LEAST_FEATURES, "raw_trace_peak_quality_vector_incomplete"),
        (F.size(against) > 0, F.concat(F.lit("raw_trace_peak_quality_vector_partial_"), F.array_join(against, "_"))), otherwise="raw_trace_peak_quality_vector_supportive",
    )
    inside = F.when(F.col("_empty").isNull() | (F.col("_empty") == EMPTY[4]), m).otherwise(0)
    return rows.select(*own, status.alias("status"), why.alias("reason"), n.alias("points"), inside.alias("inside"), *FEATURES, count.alias("feature_count"))
