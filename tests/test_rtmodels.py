"""Retention-time models against a plain version on random anchors, and their edges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracewright.operators.rtmodels import fit_rt_models, normalised_rt

SCHEMA = "sample_name string, label string, rt double, reference double"


def line(points):
    x, y = statistics.fmean(p[2] for p in points), statistics.fmean(p[1] for p in points)
    spread = sum((p[2] - x) ** 2 for p in points)
    slope = sum((p[2] - x) * (p[1] - y) for p in points) / spread if spread > 0 else 0.0
    return (slope, y - slope * x) if abs(slope) >= 1e-9 else None


def plain(anchors, model="auto", residual_max=0.5, low=0.8, high=1.2):
    """label -> (rt, reference); gives (model_type, used labels, slope, intercept, knots) or None."""
    points = sorted(((label, *p) for label, p in anchors.items()), key=lambda p: (p[2], p[0]))
    used = points
    if len(points) > 3:
        fits = []
        for subset in [points, *[[p for p in points if p is not q] for q in points]]:
            own = line(subset)
            if own and low <= own[0] <= high:
                off = [abs((p[1] - own[1]) / own[0] - p[2]) for p in subset]
                if max(off) <= residual_max:
                    fits.append((-len(subset), round(statistics.median(off), 12), round(abs(own[0] - 1), 12), len(fits), subset))
        used = min(fits)[4] if fits else points
    if len(used) == 1:
        return "shift", used, 1.0, used[0][1] - used[0][2], []
    own = line(used)
    if own is None:
        return None
    rising = all(a[1] < b[1] for a, b in zip(used, used[1:], strict=False))
    if len(used) >= 3 and model != "affine" and rising:
        return "piecewise", used, *own, [(p[1], p[2]) for p in used]
    if len(used) >= 3 and model == "piecewise":
        return None
    return "affine", used, *own, []


def applied(rt, slope, intercept, knots):
    if not knots:
        return (rt - intercept) / slope
    k = next((i for i in range(1, len(knots)) if rt <= knots[i][0]), len(knots) - 1)
    (a, ra), (b, rb) = knots[k - 1], knots[k]
    return ra + (rt - a) / (b - a) * (rb - ra)


@pytest.mark.parametrize("model", ["auto", "piecewise", "affine"])
def test_equals_every_choice_tried(spark, model):
    rnd = random.Random(7)
    samples = {}
    for s in range(120):
        n = rnd.randrange(1, 9)
        references = [rnd.uniform(1, 20) for _ in range(n)] if s % 9 else [5.0] * n
        samples[f"s{s}"] = {f"L{k}": (r * rnd.choice([1, 1, 1.05]) + rnd.uniform(-0.3, 0.3) + (rnd.random() < 0.1) * 3, r) for k, r in enumerate(references)}
    rows = [(s, label, *p) for s, own in samples.items() for label, p in own.items()]
    odd = [("s0", "L0", samples["s0"]["L0"][0] - 1, 1.0), ("s1", None, 1.0, 1.0), ("s1", "x", None, 1.0), ("s1", "y", 1.0, None), (None, "L0", 1.0, 1.0)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    models = fit_rt_models(frame, model, 0.4)
    asked = [0.0, 1.0, 5.0, 9.5, 30.0]
    got = {r.sample_name: r for r in models.withColumn("answers", F.array(*[normalised_rt(F.lit(x)) for x in asked])).collect()}
    kinds = set()
    for s, own in samples.items():
        expected = plain(own, model, 0.4)
        if expected is None:
            assert s not in got
            continue
        kind, used, slope, intercept, knots = expected
        r = got.pop(s)
        kinds.add(kind)
        assert (r.model_type, r.anchors, r.excluded, len(r.knots)) == (kind, len(used), len(own) - len(used), len(knots)), s
        assert (r.slope, r.intercept) == pytest.approx((slope, intercept))
        assert r.answers == pytest.approx([applied(x, slope, intercept, knots) for x in asked])
        off = [abs(applied(p[1], slope, intercept, knots) - p[2]) for p in used]
        assert (r.median_residual, r.max_residual) == pytest.approx((statistics.median(off), max(off)), abs=1e-9)
        assert {p.label for p in r.points if p.used} == {p[0] for p in used} and len(r.points) == len(own)
    assert not got and ("piecewise" in kinds) == (model != "affine")


def test_an_outlier_is_left_out_and_falling_anchors_give_no_knots(spark):
    rows = [("a", f"L{k}", k + 0.1 + 5 * (k == 2), float(k)) for k in range(1, 6)]
    rows += [("b", "L1", 1.0, 1.0), ("b", "L2", 3.0, 2.0), ("b", "L3", 2.5, 3.0)]
    got = {r.sample_name: r for r in fit_rt_models(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["a"].model_type, got["a"].excluded, [k.reference for k in got["a"].knots]) == ("piecewise", 1, [1.0, 3.0, 4.0, 5.0])
    assert {p.label: p.used for p in got["a"].points}["L2"] is False
    assert (got["b"].model_type, list(got["b"].knots)) == ("affine", [])
    assert fit_rt_models(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        fit_rt_models(spark.createDataFrame([], SCHEMA), "spline")
