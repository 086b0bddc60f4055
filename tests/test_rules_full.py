"""All fourteen family flags and the classes of backfill dependency, each by a row that has it."""

from pyspark.sql import functions as F

from tracewright.operators import rules as R


def test_dependency_and_flags(spark):
    rows = [  # name, evidence, primary, detected, rescued, duplicates, ambiguous, cells, weak, signal
        ("extreme", "x", "other", 2, 7, 0, 0, 10, False, False), ("weak", "x", "other", 3, 6, 0, 0, 10, True, True), ("tolerated", "x", "other", 3, 6, 0, 0, 10, False, True), ("strong", "x", "other", 3, 6, 0, 0, 10, False, False),
        ("unknown", "x", "other", 3, 6, 0, 0, 10, None, None), ("enough", "x", "other", 4, 6, 0, 0, 10, True, True), ("none", "x", "other", 0, 9, 0, 0, 10, True, True), ("single", "single_sample_local_owner", "single_sample_local_owner", 1, 0, 0, 0, 10, None, None),
        ("anchored", "pre_backfill_identity_consolidation_loser;winner=A", "anchored_family", 1, 0, 1, 1, 10, None, None), ("doubles", "primary_family_consolidation_loser", "other", 0, 0, 2, 0, 10, None, None),
        ("unclear", "x", "other", 0, 0, 0, 2, 10, None, None),
    ]
    frame = spark.createDataFrame(rows, "name string, evidence string, primary_evidence string, detected int, rescued int, duplicates int, ambiguous int, cells int, weak boolean, signal boolean")
    rests = R.backfill_dependency(F.lit(True), *[F.col(c) for c in ("detected", "rescued", "cells", "weak", "signal")])
    got = {r.name: list(r.f) for r in frame.withColumn("dependency", rests).withColumn("f", R.row_flags()).collect()}
    assert got == {
        "extreme": ["rescue_heavy", "high_backfill_dependency"],
        "weak": ["rescue_heavy", "weak_seed_backfill_dependency"],
        "tolerated": ["rescue_heavy", "weak_seed_tolerated"],
        "strong": ["rescue_heavy"],
        "unknown": ["rescue_heavy"],
        "enough": ["rescue_heavy"],
        "none": ["rescue_only"],
        "single": ["single_sample_local_owner", "single_detected_seed"],
        "anchored": ["single_detected_seed", "family_consolidation_loser", "anchored_single_detected", "duplicate_claim_pressure", "ambiguous_ms1_owner_pressure"],
        "doubles": ["family_consolidation_loser", "duplicate_claim_pressure", "duplicate_only"],
        "unclear": ["ambiguous_ms1_owner_pressure", "ambiguous_only", "zero_present"],
    }


def test_local_noise_and_window(spark):
    import random

    import numpy as np

    from tracewright.operators import models

    rnd = random.Random(5)
    traces = {t: [rnd.random() * 4 + (h if 9 <= i <= 11 else 0) for i in range(30)] for t, h in enumerate([0, 3, 6, 9, 40, 100])}
    traces |= {6: [1.0, 9.0, 1.0, 1.0], 7: [1.0] * 12, 8: [1.0] * 6 + [float("nan")]}
    frame = spark.createDataFrame([(t, i, i / 20, x) for t, v in traces.items() for i, x in enumerate(v)], "trace_id int, idx int, rt double, intensity double").repartition(3)
    apexes = spark.createDataFrame([(t, 10 if len(v) > 10 else 1) for t, v in traces.items()] + [(0, 99)], "trace_id int, apex_idx int")
    clean, dirty = (R.local_noise_severity(F.col("usable"), F.col("noise"), F.col("ratio"), d) for d in (False, True))
    got = {(r.trace_id, r.apex_idx): (r.clean, r.dirty) for r in models.local_signal_to_noise(frame, apexes).select("trace_id", "apex_idx", clean.alias("clean"), dirty.alias("dirty")).collect()}
    seen = set()
    for (t, i), severity in got.items():
        v = np.array(traces[t])
        if len(v) < 5 or not np.isfinite(v).all() or i >= len(v):
            assert severity == (2, 2)
            continue
        off = v - models.asls(v)
        noise = np.median(np.abs(off - np.median(off)))
        ratio = off[i] / noise if noise > 0 else np.inf
        assert severity == tuple(2 if ratio < hard else 1 if ratio < soft else 0 for hard, soft in ((2.0, 3.0), (1.3, 2.0))), t
        seen.add(severity[0])
    assert len(got) == 10 and {0, 1} <= seen
    rows = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (None, 0.0, 2.0), (1.0, None, 2.0), (float("nan"), 0.0, 2.0), (2.0, 0.0, 2.0)], "x double, a double, b double")
    assert [r.o for r in rows.select(R.outside_window(F.col("x"), F.col("a"), F.col("b")).alias("o")).collect()] == [False, True, True, True, True, False]
