"""Peak quality vectors against a plain version on random traces."""

import random
from statistics import median

import pytest

from tracewright.operators import peakquality as Q


def plain(points, start, end):
    """(status, reason, points, inside, six features)."""
    none = lambda why, n=0, m=0: ("not_available", why, n, m, *[None] * 6)
    points = sorted(p for p in points if all(x is not None and abs(x) < float("inf") for x in p))
    inside = [i for i, p in enumerate(points) if start is not None and end is not None and start <= p[0] <= end]
    for holds, why, m in (
        (not points, Q.EMPTY[0], 0), (len(points) < 5, Q.EMPTY[1], 0), (start is None or end is None, Q.EMPTY[2], 0), (start is not None and end is not None and end <= start, Q.EMPTY[3], 0), (len(inside) < 3, Q.EMPTY[4], len(inside)),
    ):
        if holds:
            return none(why, len(points), m)
    v = [p[1] for p in points]
    outside = [x for i, x in enumerate(v) if i not in inside]
    apex = max(inside, key=lambda i: (v[i], -i))
    values = outside if len(outside) >= 3 else v
    base = median(values)
    noise = median(abs(x - base) for x in values) * 1.4826 or median(abs(a - b) for a, b in zip(v, v[1:], strict=False)) * 0.7413
    ends = {}
    half = base + (v[apex] - base) / 2
    for step in (-1, 1):
        i = apex + step
        while v[apex] > base and 0 <= i < len(v):
            if v[i] <= half:
                a, b = points[i], points[i - step]
                ends[step] = a[0] + (b[0] - a[0]) * ((half - a[1]) / (b[1] - a[1]) if b[1] != a[1] else 0)
                break
            i += step
    wide = len(ends) == 2 and ends[1] > ends[-1]
    own = [v[i] for i in inside]
    turns = [b - a for a, b in zip(own, own[1:], strict=False) if a != b]
    features = (
        max(0.0, v[apex] - base) / noise if noise > 0 else None,
        (ends[1] - ends[-1]) * 60 if wide else None,
        max(0.0, min(1.0, (v[apex] - max(own[0], own[-1])) / v[apex])) if v[apex] > 0 else None,
        (sum((a > 0) != (b > 0) for a, b in zip(turns, turns[1:], strict=False)) / (len(turns) - 1) if len(turns) > 1 else 0.0) if len(own) >= 4 else None,
        max(0.0, ends[1] - points[apex][0]) / (points[apex][0] - ends[-1]) if wide and points[apex][0] > ends[-1] else None,
        v[apex] / max(outside) if outside and max(outside) > 0 else None,
    )
    if sum(f is not None for f in features) < 4:
        return "inconclusive", "raw_trace_peak_quality_vector_incomplete", len(v), len(inside), *features
    against = [n for n, bad in zip(
        ("low_signal_to_noise_proxy", "fwhm_unavailable", "low_peak_sharpness", "high_local_zigzag"),
        (features[0] is not None and features[0] < 3, features[1] is None, features[2] is not None and features[2] < 0.1, features[3] is not None and features[3] > 0.6), strict=True,
    ) if bad]
    return ("partial_support", "raw_trace_peak_quality_vector_partial_" + "_".join(against)) + (len(v), len(inside), *features) if against else ("supportive", "raw_trace_peak_quality_vector_supportive", len(v), len(inside), *features)


def test_equals_plain_version(spark):
    rnd = random.Random(6)
    traces, cells = {}, []
    for t in range(150):
        n = rnd.choice([0, 3, 5, 8, 20, 40])
        top = rnd.uniform(0, n / 10)
        traces[t] = [(i / 10, rnd.choice([float(rnd.randrange(4)), 100 / (1 + (8 * (i / 10 - top)) ** 2) + rnd.random()])) for i in range(n)]
        if n and t % 10 == 0:
            traces[t] += [(None, 1.0), (0.3, float("nan")), (0.35, float("inf"))]
        cells += [(t, k, a if rnd.random() < 0.9 else None, a + rnd.choice([-0.1, 0.2, 0.5, 2.0])) for k, a in enumerate([rnd.uniform(0, 2), top - 0.3])]
    cells.append((999, 0, 0.0, 1.0))
    traces[999] = []
    points = spark.createDataFrame([(t, *p) for t, own in traces.items() for p in own], "trace_id int, rt double, intensity double").repartition(4)
    got = Q.quality_vectors(points, spark.createDataFrame(cells, "trace_id int, k int, start_rt double, end_rt double")).collect()
    assert len(got) == len(cells)
    seen = set()
    for r in got:
        expected = plain(traces[r.trace_id], r.start_rt, r.end_rt)
        assert (r.status, r.reason, r.points, r.inside) == expected[:4], r
        for c, x in zip(Q.FEATURES, expected[4:], strict=True):
            assert r[c] == (None if x is None else pytest.approx(x)), (c, r)
        assert r.feature_count == sum(x is not None for x in expected[4:])
        seen.add(r.reason if r.status == "not_available" else r.status)
    assert seen == {*Q.EMPTY, "inconclusive", "partial_support", "supportive"}
