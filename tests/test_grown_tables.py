"""Steps that must not grow faster than their tables, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import evidence, joins, models, rules
from tracewright.operators import peaks as P
from tracewright.operators import traces as T


def static_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_copied_sides_are_not_broadcast(spark):
    left = spark.range(50).selectExpr("id AS a", "id / 7e0 AS x", "id % 3 AS g")
    right = spark.range(50).selectExpr("id AS b", "id / 5e0 AS y", "id % 3 AS g")
    near = joins.band_join(left, right, "x", "y", 0.5, ["g"], F.abs(F.col("x") - F.col("y")) <= 0.5)
    assert "Broadcast" not in static_plan(near)
    got = {(r.a, r.b) for r in near.collect()}
    assert got == {(a, b) for a in range(50) for b in range(50) if a % 3 == b % 3 and abs(a / 7 - b / 5) <= 0.5}
    rows = spark.range(90).selectExpr("concat('n', id) AS name", "id AS o", "id % 2 AS g", "id % 3 = 0 AS fixed", "id * 1e0 AS rt")
    assert "Broadcast" not in static_plan(joins.k_nearest(rows, F.col("fixed"), F.lit(True), ["g"], "o", "name", 3, ["rt"]))


def test_traces_are_not_shuffled(spark):
    rnd = random.Random(4)
    scans = [(f"S{n % 2}", n, n / 10) for n in range(60)]
    points = [(s, n, rt, 100 + rnd.randrange(4) * 0.001, float(rnd.randrange(1, 9))) for s, n, rt in scans for _ in range(3)]
    requests = [(f"T{k}", f"S{k % 3}", 100 + k % 4 * 0.001, k / 4, k / 4 + 1.5, 15.0) for k in range(20)]
    tables = (
        spark.createDataFrame(points, "sample string, scan_number int, rt double, mz double, intensity double"), spark.createDataFrame(scans, "sample string, scan_number int, rt double"),
        spark.createDataFrame(requests, "label string, sample string, mz double, rt_min double, rt_max double, ppm_tol double"),
    )
    for how, f in (("max", max), ("sum", sum)):
        frame = joins.extract_traces(*tables, how)
        after = static_plan(frame).split("Generate")[0]
        assert "Exchange" not in after and "Sort" not in after
        expected = []
        for label, sample, mz, lo, hi, ppm in requests:
            for s, n, rt in scans:
                if s == sample and lo <= rt <= hi:
                    held = [i for ps, pn, _, m, i in points if ps == s and pn == n and mz * (1 - ppm / 1e6) <= m <= mz * (1 + ppm / 1e6)]
                    expected.append((label, sample, n, rt, f(held) if held else 0.0))
        assert sorted(map(tuple, frame.collect())) == sorted(expected) and expected


def test_requests_are_dealt_and_points_of_other_minutes_stay(spark):
    """Requests of a few samples aren't made in a task for each sample, points out of all windows aren't shuffled, and zeros aren't rounded."""
    points = spark.range(4_000).selectExpr("concat('S', id % 2) AS sample", "CAST(id AS INT) AS scan_number", "id / 10e0 AS rt", "100 + (id % 5) * 0.001e0 AS mz", "id / 7e0 AS intensity")
    scans = points.select("sample", "scan_number", "rt")
    requests = spark.range(60).selectExpr("concat('T', id) AS label", "concat('S', id % 3) AS sample", "100 + (id % 5) * 0.001e0 AS mz", "id % 4 / 1e0 AS rt_min", "id % 4 + 1.5e0 AS rt_max", "15e0 AS ppm_tol")
    frame = joins.extract_traces(points, scans, requests, "sum", 2)
    plan = static_plan(frame)
    assert "round" not in plan.split("Generate")[0].lower()
    binned = [x for x in plan.splitlines() if "Exchange hashpartitioning(sample#" in x and "_bin#" in x]
    assert binned and "BroadcastHashJoin" in plan.split(binned[0])[1].split("Exchange")[0]
    held = points.collect()
    expected = []
    for r in requests.collect():
        for s in held:
            if s["sample"] == r["sample"] and r.rt_min <= s.rt <= r.rt_max:
                expected.append((r.label, r["sample"], s.scan_number, s.rt, round(s.intensity, 2) if r.mz * (1 - 15e-6) <= s.mz <= r.mz * (1 + 15e-6) else 0.0))
    assert sorted(map(tuple, frame.collect())) == sorted(expected) and expected


def plain_loess(rows, share=0.3, fewest=5):
    out = {}
    for name, key, x, y in rows:
        own = [r for r in rows if r[1] == key]
        k = max(-int(-len(own) * share // 1), fewest)
        near = sorted(((abs(r[2] - x), r[0], r[2], r[3]) for r in own if r[0] != name))[:k]
        if not near:
            continue
        far = near[-1][0]
        w = [((1 - (d / far) ** 3) ** 3 if far else 1.0) for d, *_ in near]
        sw, sx, sy = sum(w), sum(a * r[2] for a, r in zip(w, near)), sum(a * r[3] for a, r in zip(w, near))
        sxx, sxy = sum(a * r[2] ** 2 for a, r in zip(w, near)), sum(a * r[2] * r[3] for a, r in zip(w, near))
        if sw <= 0:
            continue
        det = sw * sxx - sx * sx
        b = (sw * sxy - sx * sy) / det if abs(det) > 1e-9 else None
        out[name, key] = sy / sw if b is None else (sy - b * sx) / sw + b * x
    return out


def test_loess_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(models, "LOESS_PLACES", 8)
    rnd = random.Random(2)
    rows = [(f"s{n:03}", k, x, rnd.randrange(100) / 7) for k, n_rows, orders in (("a", 60, 300), ("b", 60, 4), ("c", 1, 9), ("d", 2, 9), ("e", 9, 1), ("f", 40, 12)) for n in range(n_rows) for x in [rnd.randrange(orders)]]
    frame = spark.createDataFrame(rows, "sample string, label string, o int, rt double")
    got = {(r.sample, r.label): r.reference for r in models.loess(frame, "label", "sample", "o", "rt").collect()}
    expected = plain_loess(rows)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())
    plan = static_plan(models.loess(frame, "label", "sample", "o", "rt"))
    assert "o_name" not in plan


def test_applicability_is_dealt_over_the_cores(spark):
    samples = spark.createDataFrame([("Tumor_RNA_1",), ("QC_2",), ("Program-R-N-A_3",)], "sample_name string").coalesce(1)
    targets = spark.createDataFrame([("T1", "all"), ("T2", "rna_containing"), ("T3", "plasma"), ("T4", None), ("T5", "")], "label string, sample_applicability string").coalesce(1)
    frame = rules.applicability(samples, targets)
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    single = samples.crossJoin(targets).select("sample_name", "label", rules.exclusion_reason(F.col("sample_applicability"), F.col("sample_name")).alias("reason"))
    assert sorted(map(str, frame.collect())) == sorted(map(str, single.collect()))


def test_equal_peaks_are_audited_once(spark):
    """Many peaks that ask for the same give what each gives alone."""
    rnd = random.Random(5)
    scans = [("S0", n, n / 10, 200.0 + n % 3, None if n % 7 else "bad") for n in range(60)]
    ions = [("S0", n, 80 + rnd.randrange(6) * 0.001, float(rnd.randrange(1, 50))) for n in range(60) for _ in range(3)]
    kinds = [("S0", 1.0, 200.0), ("S0", 3.3, 201.0), ("S0", None, 200.0), ("S1", 1.0, 200.0), ("S0", 90.0, 202.0)]
    s = spark.createDataFrame(scans, "sample string, scan_number int, rt double, precursor_mz double, parse_error string")
    i = spark.createDataFrame(ions, "sample string, scan_number int, mz double, intensity double")

    def audit(copies):
        peaks = [(f"{k}|{c}", *kind) for k, kind in enumerate(kinds) for c in range(copies)]
        expected = [(p[0], name, mz) for p in peaks for name, mz in (("a", 80.0005), ("b", 80.004))]
        found = evidence.product_ion_audit(
            spark.createDataFrame(peaks, "peak_id string, sample string, apex_rt double, precursor_mz double"), s, i, spark.createDataFrame(expected, "peak_id string, product string, product_mz double")
        )
        return {r.peak_id: tuple(r)[1:] for r in found.collect()}

    one, many = audit(1), audit(40)
    assert len(many) == 40 * len(kinds) and all(v == one[k.split("|")[0] + "|0"] for k, v in many.items())
    assert {v[-1] for v in one.values()} >= {"hcd_supported", "no_ms2_trigger"}


def test_nearest_anchors_are_not_copied_to_numbers(spark, monkeypatch):
    """Arrays of a few anchors give what comparing all gives, and no window sorts copies of the rows."""
    monkeypatch.setattr(joins, "ANCHORS", 5)
    rnd = random.Random(8)
    rows = [(f"n{i:03}", f"c{rnd.randrange(2)}", rnd.randrange(10**6), rnd.random() < 0.3, rnd.random()) for i in range(200)]
    found = joins.k_nearest(spark.createDataFrame(rows, "name string, c string, o int, known boolean, rt double"), F.col("known"), F.lit(True), ["c"], "o", "name", 3, ["rt"])
    assert "Window" not in static_plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r["name"], []).append((r["rank"], r.anchor, r.anchor_o, r.anchor_rt))
    for name, c, o, _, _ in rows:
        near = sorted((abs(o - p), n, p, rt) for n, d, p, a, rt in rows if a and d == c and n != name)[:3]
        assert sorted(got.get(name, [])) == [(k + 1, n, p, rt) for k, (_, n, p, rt) in enumerate(near)]


def test_maxima_take_no_join(spark):
    traces = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS trace_id", "CAST(floor(id / 2) AS INT) AS idx", "id / 9e0 AS rt", "CAST((id * id) % 7 AS DOUBLE) AS intensity")
    assert "Join" not in static_plan(T.local_maxima(traces))


def test_neighbours_over_minutes(spark):
    rnd = random.Random(9)
    scans = [(f"S{k % 2}", k, round(rnd.random() * 60, 1)) for k in range(60)]
    frame = joins._neighbours(spark.createDataFrame(scans, "sample string, scan_number int, rt double"))
    assert "hashpartitioning(sample#" not in static_plan(frame).split("Window")[0]
    got = {(r["sample"], r.scan_number): (r["_before"], r["_after"]) for r in frame.collect()}
    for s in ("S0", "S1"):
        own = sorted((rt, n) for x, n, rt in scans if x == s)
        for k, (_, n) in enumerate(own):
            assert got[s, n] == (own[k - 1][0] if k else None, own[k + 1][0] if k + 1 < len(own) else None)


def test_curves_and_prominences_take_no_call_for_each_group(spark):
    traces = spark.range(400).selectExpr("CAST(id % 7 AS INT) AS trace_id", "CAST(floor(id / 7) AS INT) AS idx", "floor(id / 7) / 20e0 AS rt", "CAST((id * id) % 11 AS DOUBLE) AS intensity")
    apexes = spark.range(21).selectExpr("CAST(id % 7 AS INT) AS trace_id", "CAST(floor(id / 7) AS INT) AS region", "0.3e0 + floor(id / 7) AS apex_rt")
    curves = P.apex_curves(traces, apexes)
    assert "FlatMapGroups" not in static_plan(curves) and "FlatMapGroups" not in static_plan(P.prominences(traces))
    points = {}
    for r in traces.collect():
        points.setdefault(r.trace_id, []).append((r.rt, r.intensity))
    got = {(r.trace_id, r.region): r.curve for r in curves.collect()}
    assert len(got) == 21
    for a in apexes.collect():
        rt, v = np.array(sorted(points[a.trace_id])).T
        assert np.allclose(np.array(got[a.trace_id, a.region], float), P.own_max_curve(rt, v, a.apex_rt), equal_nan=True)


def test_regions_and_candidates_deal_traces_once(spark):
    rnd = random.Random(9)
    rows = [(t, i, i / 20, float(rnd.choice([0, 0, 1, 2, 3, 20, 40, 40, 90]))) for t in range(25) for i in range(rnd.randrange(1, 60))]
    traces = spark.createDataFrame(rows, "trace_id int, idx int, rt double, intensity double").repartition(3)
    frame = T.regions(traces, 0.1, 0.12, 1.7)
    assert static_plan(frame).count("Exchange hashpartitioning") == 1 and "Join" not in static_plan(frame)
    peaks = T.local_maxima(traces)
    bounds = {(r.trace_id, r.idx): r for r in T.threshold_bounds(traces, peaks, T.thresholds(traces, 0.1)).collect()}
    splits = sorted(map(tuple, T.valley_splits(traces, peaks, 0.12, 1.7).where("split").select("trace_id", "right_peak", "valley").collect()))
    expected = []
    for t in {r[0] for r in rows}:
        own = sorted(k[1] for k in bounds if k[0] == t)
        cuts = [(z, v) for k, z, v in splits if k == t]
        lefts = [bounds[t, own[0]].left, *(min(v + 1, z) for z, v in cuts)]
        rights = [*(v + 1 for _, v in cuts), bounds[t, own[-1]].right]
        expected += [(t, n + 1, a, z) for n, (a, z) in enumerate(zip(lefts, rights, strict=True))]
    assert sorted(map(tuple, frame.collect())) == sorted(expected) and len(expected) > 60
    held = T.inside(traces, frame)
    assert static_plan(T.inside(traces, frame)).count("Join") == 0
    want = sorted((t, n, i) for t, n, a, z in expected for u, i, *_ in rows if t == u and a <= i < z)
    assert sorted((r.trace_id, r.region, r.idx) for r in held.collect()) == want


def test_maxima_and_regions_sort_traces_twice(spark):
    traces = spark.createDataFrame([(1, i, i / 20, float(i % 3)) for i in range(9)], "trace_id int, idx int, rt double, intensity double")
    plan = static_plan(T.marked_maxima(traces))
    assert plan.count("Sort [") == 2
    owned = T.marked_maxima(traces).withColumn("peak", F.last(F.when(F.col("is_peak"), F.col("idx")), ignorenulls=True).over(T.upto()))
    assert static_plan(owned).count("Sort [") == 2
