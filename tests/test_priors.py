"""Rolling medians in ranges with overlap, and the chain of priors, against plain versions."""

import random
from statistics import median

from tracewright.operators import priors


def test_rolling_median_over_range_ends(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice("ab"), rnd.choice([rnd.randrange(-700, 700), rnd.randrange(40), None]), rnd.choice([None, rnd.random(), rnd.random()])) for k in range(500)]
    frame = spark.createDataFrame(rows, "k int, g string, o int, v double").repartition(5)
    got = {r.k: r.m for r in priors.rolling_median(frame, ["g"], "o", "v", 5, "m").collect()}
    expected = {}
    for k, g, o, _ in rows:
        near = [v for _, h, p, v in rows if o is not None and h == g and p is not None and abs(p - o) <= 5 and v is not None]
        expected[k] = median(near) if len(near) >= 3 else None
    assert got == expected and any(v is not None for v in got.values())


def test_chain_of_priors(spark):
    targets = spark.createDataFrame([("I", True, ""), ("J", True, ""), ("A", False, "I"), ("B", False, "J"), ("C", False, None)], "label string, is_istd boolean, istd_pair string")
    samples = spark.createDataFrame([(f"s{k}", k if k < 5 else None) for k in range(6)], "sample string, injection_order int")
    standards = spark.createDataFrame([(f"s{k}", "I", 5.0 + k / 10) for k in range(6)] + [("s0", "J", 9.0)], "sample string, label string, rt double")
    library = spark.createDataFrame(
        [("I", "ISTD", 5.5, 0.2, None, None), ("J", "ISTD", 8.5, 0.3, None, None), ("A", "analyte", None, None, 0.4, 0.1), ("B", "analyte", None, None, -0.5, 0.2), ("A", "ISTD", 1.0, 1.0, None, None)],
        "label string, role string, median_abs_rt double, sigma_abs_rt double, median_delta_rt double, sigma_delta_rt double",
    )
    got = {(r["sample"], r.label): (r.rt_prior and round(r.rt_prior, 6), r.rt_prior_sigma, r.prior_source, r.prefer_prior) for r in priors.rt_priors(targets, samples, standards, library, 2).collect()}
    assert len(got) == 30
    assert got["s0", "I"] == (5.1, None, "rolling_median", False) and got["s2", "I"] == (5.2, None, "rolling_median", False)
    assert got["s5", "I"] == (5.5, 0.2, "library_abs", False)  # without an injection order
    assert got["s0", "J"] == (8.5, 0.3, "library_abs", False)
    assert got["s5", "A"] == (5.9, 0.1, "delta_rt_library", True)
    assert got["s0", "B"] == (8.5, 0.2, "delta_rt_library", True) and got["s1", "B"] == (None, None, "", False) and got["s0", "C"] == (None, None, "", False)
