"""Greedy rules on families against plain versions that hold everything, in any order of the input."""

import random
from statistics import median

import pytest

from tracewright.operators import families as FM
from tracewright.operators.traces import gap_islands

CELLS = "family_id string, sample string, status string, area double, apex_rt double, start_rt double, end_rt double, rt_delta_sec double, scan_support double, trace_quality string"
FAMILIES = "family_id string, tag string, center_mz double, center_rt double, product_mz double, loss_da double, has_anchor boolean, review_only boolean, event_members int, event_clusters int, signature string"
ppm = lambda a, b: abs(a - b) / abs(a) * 1e6


def made(seed, n=60, samples=6):
    rnd = random.Random(seed)
    families, cells = [], []
    for k in range(n):
        mz = 200 + rnd.randrange(4) + rnd.randrange(8) * 0.0006
        families.append((f"F{k:03}", f"t{rnd.randrange(2)}", mz, 5 + rnd.randrange(3) * 0.02, 100 + rnd.randrange(2) * 0.0008, 116.0474, rnd.random() < 0.3, rnd.random() < 0.5, rnd.randrange(4), rnd.randrange(3), rnd.choice([None, "x", "y"])))
        for s in range(samples):
            status = rnd.choice(["detected", "detected", "rescued", "absent", "unchecked", None])
            if status:
                apex = 5 + rnd.randrange(5) * 0.012
                width = rnd.choice([0.0, 0.05, 0.1])
                area = rnd.choice([None, float("nan"), 10.0, 20.0, 30.0])
                cells.append((f"F{k:03}", f"S{s}", status, area, apex, apex - width, apex + width, rnd.choice([None, -3.0, 1.0]), rnd.choice([None, 0.5]), rnd.choice([None, "clean", "weak", "poor"])))
    return families, cells


def by_name(schema, rows):
    names = [f.split()[0] for f in schema.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def frames(spark, seed, families, cells):
    rnd = random.Random(seed)
    return spark.createDataFrame(rnd.sample(families, len(families)), FAMILIES).repartition(4), spark.createDataFrame(rnd.sample(cells, len(cells)), CELLS).repartition(5)


def plain_claims(families, cells):
    known = {f["family_id"]: f for f in families}
    live = [c for c in cells if c["status"] in FM.PRESENT and c["area"] is not None and c["area"] == c["area"]]
    detected = lambda f: sum(c["family_id"] == f and c["status"] == "detected" for c in cells)

    def key(c):
        f = known[c["family_id"]]
        delta = float("inf") if c["rt_delta_sec"] is None else abs(c["rt_delta_sec"])
        return (f["review_only"], -detected(c["family_id"]), -f["event_members"], -f["event_clusters"], c["status"] != "detected", delta, c["family_id"])

    def lost(group):
        best = [c for c in group if not known[c["family_id"]]["review_only"]]
        winner = min(best, key=key)["family_id"] if best else None
        return {(c["family_id"], c["sample"]): winner for c in group if c["family_id"] != winner}

    def fits(a, b):
        width = min(a["end_rt"] - a["start_rt"], b["end_rt"] - b["start_rt"])
        shared = min(a["end_rt"], b["end_rt"]) - max(a["start_rt"], b["start_rt"])
        return ppm(known[a["family_id"]]["center_mz"], known[b["family_id"]]["center_mz"]) <= 5 and abs(a["apex_rt"] - b["apex_rt"]) * 60 <= 2 and width > 0 and shared > 0 and shared / width >= 0.5

    out = {}
    for sample in {c["sample"] for c in live}:
        own = [c for c in live if c["sample"] == sample]
        equal = {}
        for c in own:
            equal.setdefault((round(c["apex_rt"], 8), round(c["start_rt"], 8), round(c["end_rt"], 8), c["area"]), []).append(c)
        exact = {k: ("exact", w) for g in equal.values() if len(g) > 1 for k, w in lost(g).items()}
        groups = []
        for c in sorted((c for c in own if (c["family_id"], sample) not in exact), key=lambda c: (known[c["family_id"]]["center_mz"], c["apex_rt"], c["family_id"])):
            ok = [g for g in groups if all(fits(c, m) for m in g)]
            mzs = lambda g: [known[m["family_id"]]["center_mz"] for m in g]
            if ok:
                min(ok, key=lambda g: (*min(map(key, g)), min(mzs(g)), max(mzs(g)))).append(c)
            else:
                groups.append([c])
        out |= exact | {k: ("near", w) for g in groups if len(g) > 1 for k, w in lost(g).items()}
    rows = [(c["family_id"], c["sample"], c["status"], *out.get((c["family_id"], c["sample"]), (None, None))) for c in live]
    state = lambda phase, w: "kept" if phase is None else "review_only_duplicate" if w is None else "duplicate"
    return sorted((f, s, status, state(phase, w), phase or "", w or "") for f, s, status, phase, w in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_claims(spark, seed):
    families, cells = made(seed)
    got = FM.claims(frames(spark, seed, families, cells)[1], frames(spark, seed, families, cells)[0]).collect()
    expected = plain_claims(by_name(FAMILIES, families), by_name(CELLS, cells))
    assert sorted((r.family_id, r["sample"], r.original_status, r.state, r.phase or "", r.winner or "") for r in got) == expected
    assert {e[3] for e in expected} == {"kept", "duplicate", "review_only_duplicate"} and {e[4] for e in expected} == {"", "exact", "near"}


def test_claims_do_not_bridge(spark):
    """B is near A and C, which aren't near each other: C keeps its peak."""
    family = lambda k, mz: (k, "t", mz, 5.0, 100.0, 116.0, False, False, 1, 1, None)
    cell = lambda k: (k, "S", "detected", 1.0 + ord(k), 5.0, 4.9, 5.1, 0.0, None, None)
    rows, cells = frames(spark, 1, [family("A", 300.0), family("B", 300.0012), family("C", 300.0024)], [cell(k) for k in "ABC"])
    assert {r.family_id: (r.state, r.winner) for r in FM.claims(cells, rows).collect()} == {"A": ("kept", None), "B": ("duplicate", "A"), "C": ("kept", None)}


LIMITS = FM.FoldLimits(detected_overlap=0.5, shared_detected=2, detected_jaccard=0.3, present_overlap=0.5)


def plain_folds(families, cells, limits):
    having = lambda f, *kinds: {c["sample"] for c in cells if c["family_id"] == f["family_id"] and c["status"] in kinds}

    def fits(a, b):
        d, e, p, q = having(a, "detected"), having(b, "detected"), having(a, *FM.PRESENT), having(b, *FM.PRESENT)
        least, most = min(len(d), len(e)), min(len(p), len(q))
        return (
            ppm(a["center_mz"], b["center_mz"]) <= limits.ppm and abs(a["center_rt"] - b["center_rt"]) * 60 <= limits.rt_sec + 1e-9 and ppm(a["product_mz"], b["product_mz"]) <= limits.product_ppm
            and not (a["signature"] and b["signature"] and a["signature"] != b["signature"]) and a["tag"] == b["tag"] and least and most
            and len(d & e) / least >= limits.detected_overlap and len(d & e) >= limits.shared_detected and len(d & e) / len(d | e) >= limits.detected_jaccard and len(p & q) / most >= limits.present_overlap
        )

    groups, used = [], set()
    order = sorted(families, key=lambda f: (f["tag"], f["center_mz"], f["center_rt"], f["family_id"]))
    for seed in order:  # every seed looks at all families that are left
        if seed["family_id"] in used:
            continue
        group = [seed]
        for f in order:
            if f is not seed and f["family_id"] not in used and order.index(f) > order.index(seed) and all(fits(f, m) for m in group):
                group.append(f)
                used.add(f["family_id"])
        used.add(seed["family_id"])
        groups.append(group)
    count = lambda f, *kinds: sum(c["family_id"] == f["family_id"] and c["status"] in kinds for c in cells)
    rank = lambda f: (not f["has_anchor"], -count(f, "detected"), -count(f, *FM.PRESENT), count(f, "unchecked"), count(f, "absent"), f["center_mz"], f["center_rt"], f["family_id"])
    return [(min(g, key=rank), g) for g in groups]


@pytest.mark.parametrize("seed", [3, 4])
def test_folding_and_gap_fill(spark, seed):
    families, cells = made(seed, 80)
    rows, own = frames(spark, seed, families, cells)
    found = FM.folds(rows, own, LIMITS)
    known, held = by_name(FAMILIES, families), by_name(CELLS, cells)
    groups = plain_folds(known, held, LIMITS)
    assert any(len(g) > 2 for _, g in groups)
    assert {r.family_id: (r.primary, r.size) for r in found.collect()} == {f["family_id"]: (p["family_id"], len(g)) for p, g in groups for f in g}
    quality = {"clean": 0, "weak": 1, "poor": 2}
    expected = {}
    for p, g in groups:
        for s in sorted({c["sample"] for c in held}):
            here = [c for c in held if c["sample"] == s and c["family_id"] in {f["family_id"] for f in g}]
            mine = next((c for c in here if c["family_id"] == p["family_id"]), None)
            others = [c for c in here if c is not mine and c["status"] in FM.PRESENT]
            if mine and mine["status"] in FM.PRESENT or not others:
                if mine:
                    expected[p["family_id"], s] = (None, mine["status"])
                continue
            area = lambda c: c["area"] if c["area"] is not None and c["area"] > 0 else 0.0
            delta = lambda c: float("inf") if c["rt_delta_sec"] is None else abs(c["rt_delta_sec"])
            support = lambda c: -1.0 if c["scan_support"] is None else c["scan_support"]
            best = min(others, key=lambda c: (c["status"] != "detected", -support(c), quality.get(c["trace_quality"], 3), delta(c), -area(c), c["family_id"]))
            expected[p["family_id"], s] = (best["family_id"], best["status"])
    got = {(r.family_id, r["sample"]): (r.filled_from, r.status) for r in FM.folded_cells(found, own).collect()}
    assert got == expected
    assert any(v[0] for v in got.values())


def plain_merges(families, samples, limits):
    def fits(a, b):
        return (
            a["tag"] == b["tag"] and ppm(a["center_mz"], b["center_mz"]) <= limits.ppm and abs(a["center_rt"] - b["center_rt"]) * 60 <= limits.rt_sec and ppm(a["product_mz"], b["product_mz"]) <= limits.product_ppm
            and not samples[a["family_id"]] & samples[b["family_id"]] and not b["review_only"]
        )

    groups = []
    for f in sorted(families, key=lambda f: (f["tag"], f["center_mz"], f["center_rt"], f["product_mz"], f["loss_da"], f["family_id"])):
        ok = [] if f["review_only"] else [g for g in groups if all(fits(f, m) for m in g)]
        if ok:
            min(ok, key=lambda g: (min(ppm(f["center_mz"], m["center_mz"]) for m in g), min(abs(f["center_rt"] - m["center_rt"]) for m in g), g[0]["family_id"])).append(f)
        else:
            groups.append([f])
    return groups


@pytest.mark.parametrize("seed", [5, 6])
def test_merging_of_disjoint_samples(spark, seed):
    families, cells = made(seed, 60, 9)
    cells = [c for c in cells if c[2] == "detected" and random.Random(c[0] + c[1]).random() < 0.4]
    rows, own = frames(spark, seed, families, cells)
    known = by_name(FAMILIES, families)
    samples = {f["family_id"]: {c[1] for c in cells if c[0] == f["family_id"]} for f in known}
    limits = FM.MergeLimits(ppm=12.0, rt_sec=2.0, product_ppm=5.0)
    found = FM.consolidated(rows, own, limits)
    got = {r.family_id: r for r in found.collect()}
    groups = plain_merges(known, samples, limits)
    assert sum(len(g) > 1 for g in groups) > 3 and len(got) == len(known)
    for g in groups:
        middle = median(f["center_rt"] for f in g)
        first = min(g, key=lambda f: (-len(samples[f["family_id"]]), not f["has_anchor"], abs(f["center_rt"] - middle), f["family_id"]))
        for f in g:
            r = got[f["family_id"]]
            assert (r.winner, r.family_count) == (first["family_id"], len(g))
            assert r.state == ("alone" if len(g) == 1 else "winner" if f is first else "loser")
        if len(g) > 1:
            r = got[first["family_id"]]
            assert (r.center_mz, r.center_rt, r.owner_count, r.has_anchor, r.review_only) == (median(f["center_mz"] for f in g), middle, sum(len(samples[f["family_id"]]) for f in g), any(f["has_anchor"] for f in g), False)
            ends = sorted({(f["center_rt"], f["center_mz"]) for f in g})
            assert [(s.rt, s.mz) for s in r.seeds] == ([ends[0], ends[-1]] if len(ends) > 1 else ends)
    moved, cells_ = FM.recentred(found, own)
    mean = lambda f: [c[4] for c in cells if c[0] == f]
    for r in moved.collect():
        rts = mean(r.family_id)
        assert r.center_rt == pytest.approx(sum(rts) / len(rts) if r.state == "winner" and rts else got[r.family_id].center_rt)
    winners = {f for f, r in got.items() if r.state == "winner"}
    for r in cells_.collect():
        if r.family_id in winners:
            rts = mean(r.family_id)
            assert r.rt_delta_sec == pytest.approx((r.apex_rt - sum(rts) / len(rts)) * 60)


def test_islands_equal_one_pass(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.choice([rnd.uniform(0, 3), rnd.randrange(3) * 1.0])) for k in range(400)]
    expected = {}
    for key in ("a", "b", None):
        own, island, last = sorted((v, k) for k, g, v in rows if g == key), 0, None
        for v, k in own:
            island += last is None or v - last > 0.02
            last, expected[k] = v, island
    frame = spark.createDataFrame(rows, "k int, g string, v double").repartition(6)
    assert {r.k: r.island for r in gap_islands(frame, ["g"], "v", 0.02, "k").collect()} == {k: int(i) for k, i in expected.items()}
