"""Name matches and discovery seeds against plain versions."""

import math
import random
import re

import pytest

from tracewright.operators import evidence, seeds


def plain_score(a, b):
    bc = lambda s: (re.search(r"(?i)BC\d+", s) or [""])[0].upper()
    kind = lambda s: next((k for k in ("tumor", "normal", "benign", "qc") if k in s.lower()), "")
    number = lambda s: (re.search(r"(?i)QC[_\s*]*(\d+)", s) or ["", ""])[1]
    words = lambda s: {t for t in re.sub(r"[_\-\s]+", " ", s.lower().strip()).split() if len(t) >= 2}
    if bc(a) and bc(b):
        if bc(a) != bc(b):
            return 0.0
        return float(kind(a) == kind(b)) if kind(a) and kind(b) else 0.8
    if kind(a) == kind(b) == "qc" and number(a) and number(b):
        return float(number(a) == number(b))
    return len(words(a) & words(b)) / len(words(a)) if words(a) else 0.0


def test_names_match_above_the_threshold_only(spark):
    rnd = random.Random(3)
    part = lambda: rnd.choice(["BC12", "bc7", "BC12 ", "QC 1", "QC_2", "qc*1", "tumor", "Normal", "run", "alpha", "beta", "gamma", "x", "s1", "s2", "Benign"])
    names = sorted({rnd.choice([" ", "_", "-"]).join(part() for _ in range(rnd.randrange(1, 6))) for _ in range(150)}) + ["", "!"]
    files = sorted({rnd.choice([" ", "_", "-"]).join(part() for _ in range(rnd.randrange(1, 6))) for _ in range(120)}) + [""]
    a = spark.createDataFrame([(n,) for n in [*names, *names[:9], None]], "n string").repartition(3)
    b = spark.createDataFrame([(f,) for f in [*files, None]], "f string").repartition(2)
    got = {r.name: (r.file, r.score) for r in evidence.name_matches(a, b, "n", "f").collect()}
    expected = {}
    for n in names:
        score, file = min((-plain_score(n, f), f) for f in files)
        expected[n] = (file, pytest.approx(-score)) if -score >= 0.75 else ("", None)
    assert got == expected and sum(v[0] == "" for v in expected.values()) > 5 and sum(v[0] != "" for v in expected.values()) > 20


def test_hot_words_do_not_multiply(spark):
    a = spark.range(4_000).selectExpr("concat('qc sample run ', id) AS n")
    b = spark.range(4_000).selectExpr("concat('qc_sample_run_', id, '_x1') AS f")
    found = evidence.name_matches(a, b, "n", "f")
    assert found.where("file <> ''").count() == 4_000


def plain_seeds(scan, tags, limits):
    """scan: (precursor, [(mz, intensity)])."""
    precursor, ions = scan
    base = max((x for _, x in ions if math.isfinite(x)), default=0.0)
    ions = [(i, m, x) for i, (m, x) in enumerate(ions) if math.isfinite(m) and math.isfinite(x)]
    out = set()
    for tag, loss in tags:
        expected = precursor - loss
        if expected <= 0 or base <= 0:
            continue
        high = [(i, m, x) for i, m, x in ions if x >= base * limits.least_share]
        near = [i for i, m, _ in high if abs(m - expected) / expected * 1e6 <= max(limits.product_ppm, limits.loss_ppm * loss / expected)]
        found = [(abs(precursor - m - loss) / loss * 1e6, -x, i, precursor, m, "scan_precursor") for i, m, x in high if i in near and abs(precursor - m - loss) / loss * 1e6 <= limits.loss_ppm + 1e-9]
        found = [min(found)] if found else []
        found += [(0.0, -x, i, m + loss, m, "product_plus_neutral_loss") for i, m, x in high if i not in near and abs(precursor - (m + loss)) <= limits.precursor_da]
        best = {}
        for f in sorted(found):
            best.setdefault((round(f[3] * 1e6), round(f[4] * 1e6)), f)
        out |= {(tag, f[2], round(f[3], 6), f[5]) for f in best.values()}
    return out


def test_direct_and_inferred_seeds(spark):
    rnd = random.Random(4)
    tags = [("dR", 116.0474), ("R", 132.0423), ("none", 0.0)]
    scans = {}
    for s in range(80):
        precursor = rnd.choice([250.0, 300.0, 120.0])
        ions = []
        for _ in range(rnd.randrange(12)):
            mz = precursor - rnd.choice([116.0474, 132.0423]) + rnd.choice([0, 0.0005, 0.001, 0.0021, 0.5, -1.2, 1.7, -0.0004])
            ions.append((mz, rnd.choice([1.0, 5.0, 100.0, 100.0, 20.0])))
        if ions:
            ions += [ions[0], (float("nan"), 500.0), (150.0, float("inf"))]
        scans[s] = (precursor, ions)
    rows = [("S", s, s / 10, p, i, m, x) for s, (p, ions) in scans.items() for i, (m, x) in enumerate(ions)]
    products = spark.createDataFrame(rows, "sample string, scan_number int, rt double, precursor_mz double, ion int, mz double, intensity double").repartition(3)
    limits = seeds.SeedLimits(loss_ppm=10.0, product_ppm=8.0, least_share=0.02)
    got = {}
    for r in seeds.discovery_seeds(products, spark.createDataFrame(tags, "tag string, loss_da double"), limits).collect():
        got.setdefault(r.scan_number, set()).add((r.tag, r.ion, round(r.precursor_mz, 6), r.mz_basis))
    expected = {s: plain_seeds(v, tags[:2], limits) for s, v in scans.items()}
    assert got == {s: v for s, v in expected.items() if v}
    assert {x[3] for v in got.values() for x in v} == {"scan_precursor", "product_plus_neutral_loss"}
