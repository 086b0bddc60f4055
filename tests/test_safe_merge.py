"""Safe merges of adjacent intervals: each rule on its own, and areas integrated anew."""

import numpy as np
import pytest

from tracewright.operators import peaks as P

BOUNDARY = "trace_id int, region int, boundary_id string, is_interval boolean, selected boolean, left int, right int, rt_left double, apex_rt double, rt_right double, area double, scans int, score int"


def area(v, a, z):
    return float(sum((v[i] + v[i - 1]) / 2 * 3 for i in range(a + 1, z)))  # points lie 3 s apart


def outcome(spark, v, intervals, extra=()):
    """intervals: (left, right, apex, score), the first one selected."""
    rows = [(1, k + 1, f"{k}", True, k == 0, a, z, a / 20, apex / 20, (z - 1) / 20, area(v, a, z), z - a, score) for k, (a, z, apex, score) in enumerate(intervals)]
    rows += [(1, r, f"x{k}", False, r == 1, a, z, a / 20, apex / 20, (z - 1) / 20, area(v, a, z), z - a, score) for k, (r, a, z, apex, score) in enumerate(extra)]
    points = spark.createDataFrame([(1, i, i / 20, float(x)) for i, x in enumerate(v)], "trace_id int, idx int, rt double, intensity double")
    return P.safe_merge(points, spark.createDataFrame(rows, BOUNDARY)).first()


def test_adjacent_intervals_merge(spark):
    v = np.concatenate([np.linspace(0, 100, 11), np.linspace(90, 4, 10), [3, 6, 3, 1, 0]])
    r = outcome(spark, v, [(0, 21, 10, 60), (21, 25, 22, 60)])
    assert (r.verdict, r.outcome, r.reason, r.left, r.right, r.scans, r.intervals, r.gap) == ("merge_suggested", "promoted", "eligible", 0, 25, 25, 2, 0.05)
    assert r.area == pytest.approx(area(v, 0, 25)) and r.area_ratio == pytest.approx(area(v, 0, 25) / area(v, 0, 21))
    assert r.area > area(v, 0, 21) + area(v, 21, 25)  # the gap between them counts, too


def test_what_is_no_adjacent_merge(spark):
    v = np.concatenate([np.linspace(0, 100, 11), np.linspace(90, 4, 10), [3, 6, 3, 1, 0]])
    near = [(0, 21, 10, 60), (21, 25, 22, 60)]
    # The selected one is small and its neighbour large: the gain in area isn't small.
    r = outcome(spark, v, near[::-1])
    assert (r.outcome, r.verdict, r.left, r.right) == ("kept", "split_supported", 21, 25)
    # The widest boundary of the selected candidate covers its neighbour's apex.
    r = outcome(spark, v, [(0, 8, 5, 50), (9, 21, 10, 40)], [(1, 0, 21, 5, 55)])
    assert (r.verdict, r.outcome, r.reason, r.left, r.right) == ("merge_suggested", "rejected", "unsupported_merge_suggestion_source", 0, 8)
    # A single interval stays as it is.
    r = outcome(spark, v, near[:1], [(1, 0, 15, 10, 30)])
    assert (r.verdict, r.outcome, r.reason, r.left, r.right, r.area_ratio) == ("current_supported", "kept", "", 0, 21, None)


def test_limits(spark):
    v = np.full(40, 10.0)
    near = lambda right: [(0, 20, 5, 60), (right, right + 3, right + 1, 60)]
    assert outcome(spark, v, near(20)).outcome == "promoted"
    # A point between both makes the gap too wide.
    assert outcome(spark, v, near(21)).verdict == "split_supported"
    # High ends on both sides of the gap: the intervals gain little, the envelope much.
    v[19:21] = 50.0
    r = outcome(spark, v, near(20))
    assert (r.verdict, r.outcome, r.reason, r.right, r.area) == ("merge_suggested", "rejected", "promoted_area_ratio_outside_safe_merge_range", 20, pytest.approx(area(v, 0, 20)))


def test_the_largest_apex_must_be_the_selected_one(spark):
    """The selected candidate has no interval of its own; its neighbours' merge has another apex."""
    v = np.full(60, 10.0)
    rows = [(1, 1, "s", False, True, 0, 35, 0.0, 0.5, 1.7, area(v, 0, 35), 35, 60), (1, 2, "a", True, False, 0, 28, 0.0, 0.7, 1.35, area(v, 0, 28), 28, 60), (1, 3, "b", True, False, 28, 38, 1.4, 1.5, 1.85, area(v, 28, 38), 10, 60)]
    points = spark.createDataFrame([(1, i, i / 20, float(x)) for i, x in enumerate(v)], "trace_id int, idx int, rt double, intensity double")
    r = P.safe_merge(points, spark.createDataFrame(rows, BOUNDARY)).first()
    assert (r.verdict, r.outcome, r.reason, r.left, r.right) == ("merge_suggested", "rejected", "apex_delta_exceeds_safe_merge_max", 0, 35)
