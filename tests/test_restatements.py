"""Operators without an oracle against plain restatements; readers and sinks on small files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import grouping, joins, models, peaks, traces
from tracewright.sources import readers, sinks

TRACE = "trace_id int, idx int, rt double, intensity double"


@pytest.fixture(scope="module")
def waves(spark):
    """Traces with peaks, plateaus and ties; one is flat, one short."""
    rnd = random.Random(4)
    rows = []
    for t in range(8):
        n = rnd.randrange(20, 260)
        value = 10.0
        for i in range(n):
            value = max(0.0, value + rnd.choice([-9, -4, 0, 0, 5, 9]))
            rows.append((t, i, i / 20, float(value)))
    rows += [(20, i, i / 20, 5.0) for i in range(9)] + [(21, 0, 0.0, 3.0), (21, 1, 0.05, 4.0)]
    return rows


def by_trace(rows):
    out = {}
    for t, i, rt, v in rows:
        out.setdefault(t, []).append((i, rt, v))
    return out


def test_crossings(spark, waves):
    frame = spark.createDataFrame(waves, TRACE)
    rnd = random.Random(5)
    wanted = {(t, i): rnd.choice([v / 2, v, v - 3.0]) for t, i, _, v in waves if i % 3 == 0}
    levels = spark.createDataFrame([(*k, v) for k, v in wanted.items()], "trace_id int, idx int, level double")
    held = by_trace(waves)
    for block in (4, 64):
        for inclusive in (False, True):
            below = (lambda v, x: v <= x) if inclusive else (lambda v, x: v < x)  # noqa: B023
            got = {(r.trace_id, r.idx): (r.left, r.right) for r in traces.crossings(frame, levels.select("trace_id", "idx"), levels, block, inclusive).collect()}
            for (t, i), x in wanted.items():
                left = [j for j, _, v in held[t] if j < i and below(v, x)]
                right = [j for j, _, v in held[t] if j > i and below(v, x)]
                assert got[t, i] == (max(left, default=None), min(right, default=None))


def test_suppressed_keeps_the_highest_first(spark, waves):
    found = traces.local_maxima(spark.createDataFrame(waves, TRACE))
    expected = set()
    for t, own in by_trace([(r.trace_id, r.idx, r.rt, r.intensity) for r in found.collect()]).items():
        kept = []
        for i, rt, _ in sorted(own, key=lambda p: (-p[2], p[0])):
            if all(abs(rt - k) >= 0.25 for k in kept):
                kept.append(rt)
                expected.add((t, i))
    assert {(r.trace_id, r.idx) for r in grouping.suppressed(found, 0.25).collect()} == expected


def test_weighted_intervals_are_the_best_of_all_choices(spark):
    rnd = random.Random(6)
    rows = [(k % 5, a, a + rnd.randrange(1, 7), float(rnd.randrange(1, 20))) for k in range(40) for a in [rnd.randrange(20)]]
    got = grouping.weighted_intervals(spark.createDataFrame(rows, "trace_id int, left int, right int, score double"), ["trace_id"]).collect()
    for t in range(5):
        own = [r[1:] for r in rows if r[0] == t]
        best = 0.0
        for mask in range(1 << len(own)):
            chosen = sorted(own[i] for i in range(len(own)) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(c[2] for c in chosen))
        mine = sorted((r.left, r.right, r.score) for r in got if r.trace_id == t)
        assert sum(c[2] for c in mine) == best and all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))


def test_baseline_of_many_traces_and_its_refusals(spark, waves):
    got = {(r.trace_id, r.idx): r.baseline for r in models.correct_baseline(spark.createDataFrame(waves, TRACE).repartition(3), 1e3, cells=300).collect()}
    for t, own in by_trace(waves).items():
        v = np.array([x[2] for x in own])
        if len(v) < 3:
            expected = v
        else:
            d, w = np.diff(np.eye(len(v)), 2, axis=0), np.ones(len(v))
            for _ in range(10):
                expected = np.linalg.solve(np.diag(w) + 1e3 * d.T @ d, w * v)
                w = np.where(v > expected, 0.01, 0.99)
        assert np.allclose([got[t, i] for i in range(len(v))], expected, atol=1e-6)
    for bad in ({"smoothness": 0.0}, {"asymmetry": 1.0}, {"rounds": 0}):
        with pytest.raises(ValueError):
            models.asls(np.ones(5), **bad)
    with pytest.raises(ValueError, match="finite"):
        models.asls(np.array([1.0, np.nan, 2.0]))


def test_shapes_and_medoids(spark, waves):
    frame = spark.createDataFrame(waves, TRACE)
    vectors = {}
    for t, own in by_trace(waves).items():
        rt, v = (np.array([x[k] for x in own]) for k in (1, 2))
        s = np.interp(np.linspace(rt[0], rt[-1], 25), rt, v)
        s = s - s.min()
        vectors[t] = s / np.linalg.norm(s) if np.linalg.norm(s) else s
    shapes = models.shape_vectors(frame)
    assert all(np.allclose(r.vector, vectors[r.trace_id]) for r in shapes.collect())
    got = {r.family: (r.trace_id, r.similarity) for r in models.medoids(shapes.withColumn("family", F.col("trace_id") % 2)).collect()}
    for f in (0, 1):
        own = [t for t in vectors if t % 2 == f]
        mean = {t: np.mean([vectors[t] @ vectors[o] for o in own if o != t]) for t in own}
        best = min(own, key=lambda t: (-round(mean[t], 9), t))
        assert got[f][0] == best and got[f][1] == pytest.approx(mean[best])


def test_morphology_area(spark, waves):
    """TRC-02: the area of the smoothed residual, as the query composes it."""
    corrected = models.correct_baseline(spark.createDataFrame(waves, TRACE)).select("trace_id", "idx", "rt", F.col("residual").alias("intensity"))
    smooth = traces.weighted_neighbours(corrected, traces.gaussian_weights(15, 2.5), "zero").select("trace_id", "idx", "rt", F.col("smoothed").alias("intensity"))
    got = {r.trace_id: r.area for r in traces.trapezoid(smooth).collect()}
    weight = np.exp(-0.5 * (np.arange(-7, 8) / 2.5) ** 2)
    for t, own in by_trace(waves).items():
        v = np.array([x[2] for x in own])
        s = np.convolve(np.pad(np.maximum(v - models.asls(v), 0), 7), weight / weight.sum(), "valid")
        assert got[t] == pytest.approx(float(np.trapezoid(s, [x[1] for x in own])) * 60, abs=1e-6)


def test_complete_link_groups(spark):
    rnd = random.Random(7)
    owners = [(i, f"S{rnd.randrange(6)}", "t", 300.0 + rnd.randrange(9) / 1e3, rnd.randrange(9) / 10, rnd.randrange(100)) for i in range(40)]
    edges = {(a, b): float(rnd.randrange(60)) for a in range(40) for b in range(a + 1, 40) if owners[a][1] != owners[b][1] and rnd.random() < 0.3}
    groups, expected = [], {}
    for o in sorted(owners, key=lambda o: (o[2], o[3], o[4], o[1], -o[5], o[0])):
        fits = []
        for k, g in enumerate(groups):
            d = [edges.get((min(o[0], m[0]), max(o[0], m[0]))) for m in g]
            if None not in d and o[1] not in {m[1] for m in g}:
                fits.append((max(d), k))
        g = groups[min(fits)[1]] if fits else groups.append([]) or groups[-1]
        g.append(o)
        expected[o[0]] = g[0][0]
    frame = spark.createDataFrame(owners, "owner_id long, sample string, tag string, precursor_mz double, apex_rt double, evidence_score int").repartition(5)
    links = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a long, b long, distance double")
    assert {r.owner_id: r.group_id for r in grouping.complete_link(frame, links).collect()} == expected


def test_shared_peaks_merge_one_after_the_other(spark):
    rnd = random.Random(8)
    names = ["candidate_id", "sample", "tag", "precursor_mz", "product_mz", "loss_da", "start_rt", "end_rt", "seed_min", "seed_max", "intensity", "events", "loss_ppm"]
    rows = []
    for i in range(120):
        at = rnd.randrange(60) / 10
        mz = 300.0 + rnd.choice([0, 0.003, 0.005, 2])
        rows.append((i, f"S{i % 2}", f"t{rnd.randrange(2)}", mz, mz - 116.0, 116.0, at - 0.2, at + 0.2, at - 0.1, at + 0.1, float(rnd.randrange(5)), 1, float(rnd.randrange(3))))
    near = lambda a, b, ppm: abs(a - b) / b * 1e6 <= ppm
    held = []
    for r in (dict(zip(names, r)) for r in rows):
        for g in held:
            if (
                g["sample"] == r["sample"] and g["tag"] == r["tag"] and near(g["precursor_mz"], r["precursor_mz"], 10) and near(g["product_mz"], r["product_mz"], 20) and max(g["start_rt"], r["start_rt"]) <= min(g["end_rt"], r["end_rt"])
                and g["seed_min"] <= r["end_rt"] and g["seed_max"] >= r["start_rt"] and r["seed_min"] <= g["end_rt"] and r["seed_max"] >= g["start_rt"]
            ):
                first = min((g, r), key=lambda x: (-x["intensity"], x["loss_ppm"], x["seed_min"], x["candidate_id"]))
                g |= {k: first[k] for k in names} | {"group": g["group"], "n": g["n"] + 1, "events": g["events"] + 1, "seed_min": min(g["seed_min"], r["seed_min"]), "seed_max": max(g["seed_max"], r["seed_max"]), "intensity": max(g["intensity"], r["intensity"])}
                break
        else:
            held.append(r | {"group": r["candidate_id"], "n": 1})
    frame = spark.createDataFrame(rows, "candidate_id long, sample string, tag string, precursor_mz double, product_mz double, loss_da double, start_rt double, end_rt double, seed_min double, seed_max double, intensity double, events long, loss_ppm double")
    got = grouping.shared_peaks(frame.repartition(6), 10.0, 20.0, 10.0).collect()
    assert sorted((r.group_id, r.sample, r.candidates, r.representative, r.events, r.intensity) for r in got) == sorted((g["group"], g["sample"], g["n"], g["candidate_id"], g["events"], g["intensity"]) for g in held)
    assert len(got) < 110


def test_detection_statuses_and_recovery(spark):
    bump = lambda at, top: [max(0.0, top - 6.0 * abs(i - at)) for i in range(60)]
    two = [a + b for a, b in zip(bump(15, 100.0), bump(45, 15.0))]
    rows = [(t, i, i / 20, v) for t, vs in ((1, two), (2, [0.0] * 30), (3, [1.0, 2.0]), (4, two), (5, [3.0] * 30)) for i, v in enumerate(vs)]
    wanted = spark.createDataFrame([(1, 2.25), (4, 0.8)], "trace_id int, preferred_rt double")
    got = {r.trace_id: r for r in peaks.detect_peaks(spark.createDataFrame(rows, TRACE), wanted).collect()}
    assert {t: r.status for t, r in got.items()} == {1: "OK", 2: "NO_SIGNAL", 3: "WINDOW_TOO_SHORT", 4: "OK", 5: "PEAK_NOT_FOUND"}
    assert (got[4].source, got[4].apex_idx) == ("local_minimum", 15)
    assert (got[1].source, got[1].apex_idx) == ("preferred_rt_recovery", 45) and got[1].area > 0


def test_shape_similarity(spark):
    rnd = np.random.default_rng(9)
    a, b = rnd.normal(0, 1, 30), rnd.normal(0, 1, 30)
    b[3] = np.nan
    frame = spark.createDataFrame([(a.tolist(), b.tolist()), (a.tolist(), a.tolist()), (a.tolist(), [1.0] * 30)], "a array<double>, b array<double>")
    got = [r.s for r in frame.select(peaks.shape_similarity("a", "b").alias("s")).collect()]
    fine = ~np.isnan(b)
    assert got[0] == pytest.approx(np.corrcoef(a[fine], b[fine])[0, 1]) and got[1] == pytest.approx(1) and got[2] is None
    curve = peaks.own_max_curve(np.arange(40) / 40, np.exp(-0.5 * ((np.arange(40) - 20) / 4.0) ** 2), 0.5)
    assert np.nanmax(curve) == pytest.approx(1, abs=1e-3) and abs(int(np.nanargmax(curve)) - 87) <= 1
    assert np.isnan(peaks.own_max_curve(np.array([0.0, 1.0]), np.array([1.0, 1.0]), 0.5)).all()


def test_nearest_anchors_and_total_order(spark):
    rnd = random.Random(10)
    rows = [(f"n{i:03}", f"c{rnd.randrange(3)}", rnd.randrange(10**6), rnd.random() < 0.4) for i in range(150)]
    frame = spark.createDataFrame(rows, "name string, c string, o int, known boolean").repartition(4)
    got = {}
    for r in joins.k_nearest(frame, F.col("known"), F.lit(True), ["c"], "o", "name", 4, [], width=50_000).collect():
        got.setdefault(r["name"], []).append((r["rank"], r.anchor))
    for name, c, o, _ in rows:
        near = sorted((abs(o - p), n) for n, d, p, a in rows if a and d == c and n != name)[:4]
        assert sorted(got.get(name, [])) == [(k + 1, n) for k, (_, n) in enumerate(near)]
    order = joins.total_order(frame, [F.col("o"), F.col("name")], "at").collect()
    assert [r["name"] for r in sorted(order, key=lambda r: r["at"])] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(r["at"] for r in order) == list(range(1, 151))


def test_append_survives_a_retry_and_equal_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    runs = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 2), ("r2", 1), ("r3", 9)], "run string, v int")
    assert {r.run: r.appended for r in sinks.append_new_runs(runs, log).collect()} == {"r1": True, "r2": False, "r3": True}
    # The ledger of a batch is lost in a crash after its rows were written; the batch comes again.
    more = spark.createDataFrame([("r4", 5), ("r4", 6)], "run string, v int")
    sinks.append_new_runs(more, log)
    kept = spark.read.parquet(f"{log}/fingerprints").where("run <> 'r4'").collect()
    spark.createDataFrame(kept).write.mode("overwrite").parquet(f"{log}/other")
    spark.read.parquet(f"{log}/other").write.mode("overwrite").parquet(f"{log}/fingerprints")
    assert [r.appended for r in sinks.append_new_runs(more, log).collect()] == [True]
    assert [r.appended for r in sinks.append_new_runs(more, log).collect()] == [False]
    assert sorted((r.run, r.v) for r in spark.read.parquet(f"{log}/rows").collect()) == [("r1", 1), ("r1", 2), ("r3", 9), ("r4", 5), ("r4", 6)]


def test_more_readers_and_sinks(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    samples = write("s.csv", "sample_name,role,batch,injection_order,excluded\nA.raw,qc,1,3,false\nB,study,1,,true\n")
    assert sorted((r.sample_name, r.injection_order) for r in readers.read_sample_metadata(spark, samples).collect()) == [("A.raw", 3), ("B", None)]
    with pytest.raises(readers.ContractError, match="alias"):
        readers.read_sample_metadata(spark, write("s2.csv", "sample_name,role\nA.raw,qc\nA,qc\n"))
    priors = spark.createDataFrame([("h", "t", "p", 0.1, False), ("h", "u", "p", 0.2, True), ("x", "t", "p", 0.3, None)], "config_hash string, target string, pair string, delta double, blocked boolean")
    assert [r.delta for r in readers.rt_priors(priors, "h").collect()] == [0.1]
    with pytest.raises(readers.ContractError, match="prior"):
        readers.rt_priors(priors.union(priors), "h")
    (tmp_path / "t.json").write_text(json.dumps({"family_id": "F1", "traces": [{"sample": "S", "rt": [1.0, 2.0], "intensity": [5.0, 6.0]}]}))
    nested = spark.read.schema("family_id string, traces array<struct<sample string, rt array<double>, intensity array<double>>>").json(str(tmp_path / "t.json"))
    assert [tuple(r) for r in readers.traces_of(nested).orderBy("idx").collect()] == [("F1", "S", 0, 1.0, 5.0), ("F1", "S", 1, 2.0, 6.0)]
    batch = readers.read_discovery_batch(spark, write("b.csv", "sample_stem,candidate_csv,raw_file,review_csv\nA,x/a.csv,,\nB,/abs/b.csv,r.raw,q.csv\n")).orderBy("sample_stem").collect()
    assert [(r.candidate_csv, r.review_csv) for r in batch] == [(f"{tmp_path}/x/a.csv", None), ("/abs/b.csv", f"{tmp_path}/q.csv")]
    with pytest.raises(readers.ContractError, match="candidate_csv"):
        readers.read_discovery_batch(spark, write("b2.csv", "sample_stem,candidate_csv\nA,\n"))
    head = "Tag Category,Tag No.,Tag Name,Tag Parameters (Da or m/z),Mass Tolerance (ppm),Intensity Cutoff (height)\n"
    got = readers.read_tag_profiles(spark, write("p.csv", head + "1,1,dR,116.0474,20,100\n2,2,p,50.1,20,1\n")).collect()
    assert [tuple(r) for r in got] == [("1", "dR", 116.0474, 20.0, 100.0)]
    with pytest.raises(readers.ContractError, match="category"):
        readers.read_tag_profiles(spark, write("p2.csv", head + "3,1,dR,116.0474,20,100\n"))
    library = str(tmp_path / "library")
    priors.write.parquet(library)
    assert sinks.write_pending_priors(priors.limit(1), library) == f"{library}.pending"
    assert spark.read.parquet(library).count() == 3 and spark.read.parquet(f"{library}.pending").count() == 1
    families = spark.createDataFrame([("F1", "t", "=x", 300.0, 5.0, 2, 1, 4)], "family_id string, tag string, evidence string, center_mz double, center_rt double, detected long, rescued long, cell_count long")
    run = sinks.write_alignment(families, spark.createDataFrame([("F1", "S", 2.5)], "family_id string, sample string, area double"), str(tmp_path / "out"))
    assert run and sinks.read_published(spark, str(tmp_path / "out"), "review").first().evidence == "'=x"
    assert sinks.read_published(spark, str(tmp_path / "out"), "matrix").first().area == "2.5000"
