"""Savitzky-Golay smoothing and resolver, and wavelet ridges, against plain versions."""

import random

import numpy as np
import pytest

from tracewright.operators import peaks as P
from tracewright.operators import proposals as PR

SCHEMA = "trace_id int, idx int, rt double, intensity double"


def made(seed, n=12):
    rnd = random.Random(seed)
    out = {}
    for t in range(n):
        size = rnd.choice([3, 6, 7, 15, 40, 60])
        bumps = [(rnd.uniform(0, size), rnd.uniform(2, 5), rnd.uniform(50, 500)) for _ in range(rnd.randrange(4))]
        out[t] = np.array([sum(h * np.exp(-(((i - c) / w) ** 2) / 2) for c, w, h in bumps) + rnd.random() * 5 for i in range(size)])
    out[n] = np.zeros(20)
    out[n + 1] = np.concatenate([np.full(4, 9.0), np.linspace(8, 1, 12)])
    return out


def frame(spark, traces):
    return spark.createDataFrame([(t, i, i / 20, float(x)) for t, v in traces.items() for i, x in enumerate(v)], SCHEMA).repartition(3)


def smooth(v, window, order):
    half, n = window // 2, len(v)
    out = []
    for i in range(n):
        start = min(max(0, i - half), n - window)
        own = np.arange(start, start + window)
        out.append(np.polyval(np.polyfit(own - i, v[own], order), 0))
    return np.array(out)


def test_savgol_fits_polynomials_to_the_ends(spark):
    traces = made(1)
    got = {(r.trace_id, r.idx): r.smoothed for r in PR.savgol(frame(spark, traces), 7, 3).collect()}
    for t, v in traces.items():
        expected = smooth(v, 7, 3) if len(v) >= 7 else [None] * len(v)
        assert [got[t, i] for i in range(len(v))] == [x if x is None else pytest.approx(x, abs=1e-6) for x in expected]
    with pytest.raises(ValueError, match="odd"):
        PR.polynomial_fit(6, 3)


def plain_savgol_peaks(v, window=7, order=3, share=0.1, relative=0.95):
    """(apex, left, right, prominence) of peaks that are prominent enough."""
    if len(v) < window:
        return []
    s = smooth(v, window, order)
    if s.max() <= 0:
        return []
    off = v - s
    least = max(s.max() * share, 3 * 1.4826 * np.median(np.abs(off - np.median(off))))
    out = []
    for i in range(1, len(s) - 1):
        if not (s[i] > s[i - 1] and s[i] > s[i + 1]):
            continue
        lo = i
        while lo >= 0 and s[lo] <= s[i]:
            lo -= 1
        hi = i
        while hi < len(s) and s[hi] <= s[i]:
            hi += 1
        prominence = s[i] - max(s[lo + 1 : i + 1].min(), s[i:hi].min())
        if prominence < least:
            continue
        level = s[i] - prominence * relative
        a = max(k for k in range(lo + 1, i + 1) if s[k] <= level)
        z = min(k for k in range(i, hi) if s[k] <= level)
        left = a + ((level - s[a]) / (s[a + 1] - s[a]) if s[a] < level else 0)
        right = z - ((level - s[z]) / (s[z - 1] - s[z]) if s[z] < level else 0)
        out.append((i, max(0, int(np.floor(left))), min(len(s), int(np.ceil(right)) + 1), prominence))
    return out


def test_savgol_resolver(spark):
    traces = made(2, 20)
    config = P.ResolverConfig(smooth_window=7)
    rows = PR.resolve_savgol(frame(spark, traces), config).collect()
    count = 0
    for t, v in traces.items():
        own = sorted((r for r in rows if r.trace_id == t), key=lambda r: r.region)
        expected = plain_savgol_peaks(v)
        assert [(r.apex_idx, r.left, r.right) for r in own] == [e[:3] for e in expected]
        assert [r.prominence for r in own] == pytest.approx([e[3] for e in expected])
        assert [(r.apex_intensity, r.scans, r.region) for r in own] == [(pytest.approx(v[e[1] : e[2]].max()), e[2] - e[1], k + 1) for k, e in enumerate(expected)]
        count += len(own)
    assert count >= 15
    chosen = {r.trace_id: r for r in P.detect_peaks(frame(spark, traces), config=config, resolver="savgol").collect()}
    for t, v in traces.items():
        status = "WINDOW_TOO_SHORT" if len(v) < 7 else "NO_SIGNAL" if v.max() <= 0 else "OK" if plain_savgol_peaks(v) else "PEAK_NOT_FOUND"
        assert chosen[t].status == status, t
        if status == "OK":
            best = max(plain_savgol_peaks(v), key=lambda e: (v[e[1] : e[2]].max(), -e[0]))
            assert (chosen[t].apex_idx, chosen[t].source) == (best[0], "savgol")
    with pytest.raises(ValueError, match="unknown resolver"):
        P.detect_peaks(frame(spark, traces), resolver="spline")


def plain_ridges(v, widths):
    """Ridge lines by loops, each maximum looking at all open lines."""
    n = len(v)
    rows = []
    for w in widths:
        m = int(min(10 * w, n))
        wave = [2 / (np.sqrt(3 * w) * np.pi**0.25) * (1 - ((k - (m - 1) / 2) / w) ** 2) * np.exp(-(((k - (m - 1) / 2) / w) ** 2) / 2) for k in range(m)]
        rows.append([sum(v[j] * wave[i + (m - 1) // 2 - j] for j in range(n) if 0 <= i + (m - 1) // 2 - j < m) for i in range(n)])
    lines, gone = [], []
    for r in range(len(widths) - 1, -1, -1):
        open_ = [line for line in lines if line not in gone]
        at_start = [line[-1][1] for line in open_]
        for c in range(1, n - 1):
            if not (rows[r][c] > rows[r][c - 1] and rows[r][c] > rows[r][c + 1]):
                continue
            near = sorted((abs(e - c), k) for k, e in enumerate(at_start))
            if near and near[0][0] <= widths[r] / 4 and open_[near[0][1]][-1][0] != r:
                open_[near[0][1]].append((r, c))
            else:
                lines.append([(r, c)])
        gone += [line for line in lines if line not in gone and line[-1][0] - r > widths[0]]
    return rows, lines


def test_wavelet_ridges():
    for seed in range(4):
        v = made(seed, 4)[seed]
        if len(v) < 15:
            continue
        widths = PR.widths_of(np.arange(len(v)) / 20, PR.WaveletConfig())
        strength = PR.transform(v, widths)
        rows, lines = plain_ridges(v, widths.tolist())
        assert np.allclose(strength, rows, atol=1e-9)
        assert sorted(map(sorted, PR.ridges(strength, widths))) == sorted(map(sorted, lines))


def test_wavelet_candidates_and_boundaries(spark):
    bump = lambda c, w, h: [h * np.exp(-(((i - c) / w) ** 2) / 2) for i in range(80)]
    rnd = np.random.default_rng(1)
    traces = {1: np.array(bump(20, 2, 300)) + bump(55, 4, 400) + rnd.random(80), 2: rnd.random(80) * 4, 3: np.zeros(30), 4: np.array([1.0, 5.0])}
    table = frame(spark, traces)
    got = sorted((r.trace_id, r.apex_idx) for r in PR.wavelet_candidates(table).collect())
    assert got == [(1, 20), (1, 55)]
    found = P.resolve(table)
    scaled = PR.with_scales(found, PR.wavelet_candidates(table))
    rows = P.boundary_hypotheses(table, scaled).where("array_contains(sources, 'cwt_width')").collect()
    scales = {r.region: r.wavelet_scale for r in scaled.collect() if r.wavelet_scale}
    assert len(rows) == 2 and all(r.right - r.left == round(scales[r.region]) and r.left == r.apex_idx - round(scales[r.region]) // 2 for r in rows)
    plain = P.boundary_hypotheses(table, found)
    assert plain.where("array_contains(sources, 'cwt_width')").count() == 0
