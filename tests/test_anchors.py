"""Local anchors in three tiers against a plain version that looks at all anchors."""

import random

from tracewright.operators import anchors as A


def plain(anchors, probe):
    name, compound, rt, order = probe
    if rt is None or order is None:
        return []
    rows = [(abs(rt - a[2]) / 4 + abs(order - a[3]) / 25, abs(rt - a[2]) <= 4 and abs(order - a[3]) <= 25, *a) for a in anchors if a[0] != name]
    same = [r for r in rows if compound is not None and r[3] == compound]
    if len(same) >= 2:
        return [("compound", r[2]) for r in sorted(same, key=lambda r: (abs(r[5] - order), r[2]))[:8]]
    near = [r for r in rows if r[1]]
    if len(near) >= 3:
        return [("window", r[2]) for r in sorted(near, key=lambda r: (r[0], r[2]))[:8]]
    return [("nearest", r[2]) for r in sorted(rows, key=lambda r: (r[0], r[2]))[:3]]


def test_three_tiers(spark):
    rnd = random.Random(11)
    anchors = [(f"a{k}", rnd.choice(["x", "y", "z", None]), rnd.choice([rnd.uniform(0, 2), rnd.uniform(0, 60)]), rnd.choice([rnd.randrange(30), rnd.randrange(3000)]), rnd.gauss(0, 0.1)) for k in range(300)]
    anchors += [("lone", "once", 3.0, 5, 0.2)]
    probes = [(f"p{k}", rnd.choice(["x", "once", "none", None, None, None]), rnd.choice([rnd.uniform(0, 2), rnd.uniform(-20, 100), None]), rnd.choice([rnd.randrange(30), rnd.randrange(-500, 6000)])) for k in range(250)]
    probes += [(a[0], a[1], a[2], a[3]) for a in anchors[:40]] + [("nowhere", "x", 1.0, None)]
    a = spark.createDataFrame(anchors, "anchor string, compound string, rt double, injection_order int, delta double").repartition(3)
    p = spark.createDataFrame(probes, "probe string, compound string, rt double, injection_order int").repartition(3)
    got = {}
    for r in A.local_anchors(a, p).orderBy("probe", "rank").collect():
        got.setdefault(r.probe, []).append((r.tier, r.anchor))
    expected = {q[0]: plain(anchors, q) for q in probes}
    assert {k: v for k, v in expected.items() if v} == got
    assert {t for v in got.values() for t, _ in v} == {"compound", "window", "nearest"}
    coverage = {r.probe: r.coverage for r in A.local_drift(a, p).collect()}
    assert coverage["nowhere"] == "incomplete" and set(coverage.values()) == {"incomplete", "extrapolated", "covered", "sparse"}


def test_without_anchors(spark):
    a = spark.createDataFrame([], "anchor string, compound string, rt double, injection_order int, delta double")
    p = spark.createDataFrame([("p", "x", 1.0, 1), ("q", None, None, 2)], "probe string, compound string, rt double, injection_order int")
    assert A.local_anchors(a, p).count() == 0
    assert {r.probe: (r.coverage, r.scope) for r in A.local_drift(a, p).collect()} == {"p": ("unsupported", "no_rt_anchors"), "q": ("unsupported", "no_rt_anchors")}
