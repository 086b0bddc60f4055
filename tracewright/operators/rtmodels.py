"""Retention-time models of samples, fitted to anchors: shifts, lines and monotone piecewise lines, in array functions.

A sample's anchors, one for each label, are one array in a row. Every choice of anchors, all of them or all but one, is tried there, so that
nothing is joined and a sample's rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POINT = "label", "observed", "reference"


def _total(points: Column, value) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + value(p))


def _line(points: Column) -> Column:
    """The least-squares line observed = slope * reference + intercept, null where references don't differ or the slope is 0."""
    n = F.size(points)
    mean = lambda f: _total(points, lambda p: p[f]) / n
    means = F.struct(mean("reference").alias("x"), mean("observed").alias("y"))

    def fitted(m: Column) -> Column:
        across = _total(points, lambda p: (p["reference"] - m["x"]) * (p["observed"] - m["y"]))
        spread = _total(points, lambda p: (p["reference"] - m["x"]) * (p["reference"] - m["x"]))
        slope = F.when(spread > 0, across / spread)
        return F.when(F.abs(slope) >= 1e-9, F.struct(slope.alias("slope"), (m["y"] - slope * m["x"]).alias("intercept")))

    # One-element transforms name a value that is used more than once.
    return F.when(n > 0, F.transform(F.array(means), fitted)[0])


def _off(points: Column, slope: Column, intercept: Column) -> Column:
    """How far the anchors lie from their references on the line's scale, in order of size."""
    return F.array_sort(F.transform(points, lambda p: F.abs((p["observed"] - intercept) / slope - p["reference"])))


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    at = lambda k: F.get(ordered, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def normalised_rt(rt: Column) -> Column:
    """A sample's RT on the reference's scale, by its model: between the two knots that enclose it, beyond the knots by the outermost two, without
    knots by the line."""
    last = F.size("knots") - 1
    before = F.size(F.filter("knots", lambda k: k["observed"] < rt))
    right = F.greatest(F.lit(1), F.least(before, last))
    a, b = F.get("knots", right - 1), F.get("knots", right)
    wide = b["observed"] - a["observed"]
    between = F.when(F.abs(wide) < 1e-12, a["reference"]).otherwise(a["reference"] + (rt - a["observed"]) / wide * (b["reference"] - a["reference"]))
    return F.when(F.size("knots") >= 2, between).otherwise((rt - F.col("intercept")) / F.col("slope"))


def fit_rt_models(
    anchors: DataFrame, model: str = "auto", residual_max: float = 0.5, slope_min: float = 0.8, slope_max: float = 1.2, sample: str = "sample_name"
) -> DataFrame:
    """(sample, model_type, anchors, excluded, slope, intercept, knots, median_residual, max_residual, points) by sample.

    anchors: (sample, label, rt, reference); rows with a null among these don't count, and of a label's rows the one with the latest RT does.
    Of more than three anchors one may be left out: of all choices whose line has a slope within the bounds and no residual over residual_max,
    the one with most anchors, then the smallest median residual, then the slope nearest to 1, then the first in order of references; where
    none is left, all anchors are used. One anchor gives a shift. From three on, anchors whose RTs rise with their references are the knots of a
    piecewise line; where they don't, `auto` gives a line and `piecewise` no model. `affine` gives lines. Samples without a model have no row.
    points: every anchor with its normalised RT, its residual and whether it was used.
    """
    if model not in ("auto", "piecewise", "affine"):
        raise ValueError(f"unknown model {model!r}")
    rows = anchors.where(f"`{sample}` IS NOT NULL AND label IS NOT NULL AND rt IS NOT NULL AND reference IS NOT NULL")
    one = rows.groupBy(sample, "label").agg(F.max(F.struct("rt", "reference")).alias("p"))
    order = F.struct(F.col("p.reference").alias("reference"), "label", F.col("p.rt").alias("observed"))
    own = one.groupBy(sample).agg(F.sort_array(F.collect_list(order)).alias("all"))

    # Choices: number 0 is all anchors, number k leaves out the k-th.
    drops = F.when(F.size("all") > 3, F.sequence(F.lit(0), F.size("all"))).otherwise(F.array(F.lit(0)))
    sets = F.transform(drops, lambda k: F.struct(k.alias("k"), F.filter("all", lambda p, i: i + 1 != k).alias("points")))
    lines = F.transform(sets, lambda s: F.struct(s["k"].alias("k"), s["points"].alias("points"), _line(s["points"]).alias("line")))
    judged = F.transform(lines, lambda s: F.struct(s["k"].alias("k"), s["line"].alias("line"), _off(s["points"], s["line"]["slope"], s["line"]["intercept"]).alias("off")))
    fine = F.filter(judged, lambda s: s["line"]["slope"].between(slope_min, slope_max) & (F.element_at(s["off"], -1) <= residual_max))
    ranked = F.array_sort(
        F.transform(fine, lambda s: F.struct((s["k"] > 0).alias("fewer"), F.round(_middle(s["off"]), 12).alias("median"), F.round(F.abs(s["line"]["slope"] - 1), 12).alias("from_one"), s["k"].alias("k")))
    )
    best = F.when(F.size("all") > 3, F.coalesce(F.get(ranked, 0)["k"], F.lit(0))).otherwise(0)
    chosen = own.withColumn("_k", best).withColumn("used", F.filter("all", lambda p, i: i + 1 != F.col("_k")))

    rises = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("used") - 1)), lambda i: F.coalesce(F.get("used", i)["observed"] > F.get("used", i - 1)["observed"], F.lit(True)))
    first = F.get("used", F.lit(0))
    single = F.struct(F.lit(1.0).alias("slope"), (first["observed"] - first["reference"]).alias("intercept"))
    fitted = chosen.withColumn("line", F.when(F.size("used") == 1, single).otherwise(_line(F.col("used")))).withColumn("_rises", (F.size("used") >= 3) & rises)
    kind = F.when(F.size("used") == 1, "shift").when(F.col("_rises") & F.lit(model != "affine"), "piecewise").when((F.size("used") < 3) | F.lit(model != "piecewise"), "affine")
    knots = F.when(F.col("model_type") == "piecewise", F.transform("used", lambda p: F.struct(p["observed"].alias("observed"), p["reference"].alias("reference"))))
    made = fitted.where("line IS NOT NULL").withColumn("model_type", kind).where("model_type IS NOT NULL").select(
        sample,
        "model_type",
        F.size("used").alias("anchors"),
        (F.size("all") - F.size("used")).alias("excluded"),
        F.col("line.slope").alias("slope"),
        F.col("line.intercept").alias("intercept"),
        F.coalesce(knots, F.expr("CAST(array() AS array<struct<observed: double, reference: double>>)")).alias("knots"),
        "all",
        "_k",
    )
    told = F.transform("all", lambda p, i: F.struct(*[p[c].alias(c) for c in _POINT], normalised_rt(p["observed"]).alias("normalised"), (i + 1 != F.col("_k")).alias("used")))
    shown = made.withColumn("points", F.transform(told, lambda p: p.withField("residual", p["normalised"] - p["reference"])))
    off = F.array_sort(F.transform(F.filter("points", lambda p: p["used"]), lambda p: F.abs(p["residual"])))
    return shown.withColumn("_off", off).select(
        sample, "model_type", "anchors", "excluded", "slope", "intercept", "knots", _middle(F.col("_off")).alias("median_residual"), F.element_at("_off", -1).alias("max_residual"), "points"
    )
