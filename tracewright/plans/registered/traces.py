"""Queries of ordered traces (AGG-01 to 03, WIN)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...operators import peaks as P
from ...operators import traces as T
from ..catalog import query

_R6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query("agg01_trapezoid_area", """
WITH d AS (SELECT trace_id, (rt - lag(rt) OVER w) * (intensity + lag(intensity) OVER w) / 2 AS part FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY idx))
SELECT trace_id, round(coalesce(sum(part), 0) * 60, 4) AS area FROM d GROUP BY trace_id""")  # fmt: skip
def agg01(b):
    return T.trapezoid(b.traces).select("trace_id", F.round("area", 4).alias("area"))


_MAD = """m AS (SELECT trace_id, median(intensity) AS md, count(*) AS n FROM traces GROUP BY trace_id),
o AS (SELECT trace_id, md, n, median(abs(intensity - md)) AS mad FROM traces JOIN m USING (trace_id) GROUP BY ALL)"""


@query("agg02_median_mad", f"WITH {_MAD} SELECT trace_id, round(md, 6) AS median, n, round(mad, 6) AS mad, round(mad * 3 * 1.4826e0, 6) AS noise_floor FROM o")
def agg02(b):
    return T.residual_mad(b.traces).select("trace_id", _R6("median"), "n", _R6("mad"), _R6("noise_floor"))


@query("agg03_area_uncertainty", f"""
WITH {_MAD}, p AS (SELECT trace_id, (rt - lag(rt) OVER (PARTITION BY trace_id ORDER BY idx)) * 60 AS p FROM traces), q AS (SELECT trace_id, median(p) AS p FROM p GROUP BY trace_id)
SELECT trace_id, round(mad * p * sqrt(n), 6) AS uncertainty FROM o JOIN q USING (trace_id)""")  # fmt: skip
def agg03(b):
    return T.area_uncertainty(b.traces).select("trace_id", _R6("uncertainty"))


def _neighbours(weights, edge):
    half = len(weights) // 2
    beyond = lambda k: "0e0" if edge == "zero" else ("f" if k < 0 else "z")
    at = lambda k: f"lag(intensity, {-k}) OVER w" if k < 0 else f"lead(intensity, {k}) OVER w" if k else "intensity"
    terms = " + ".join(f"coalesce({at(k)}, {beyond(k)}) * {w!r}{'' if 'e' in repr(w) else 'e0'}" for k, w in zip(range(-half, half + 1), weights, strict=True))
    ends = "first_value(intensity) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""WITH e AS (SELECT *, {ends} AS f, {ends.replace("first", "last")} AS z FROM traces)
SELECT trace_id, idx, round({terms}, 6) AS smoothed FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY idx)"""


_SAVGOL, _GAUSS = T.savgol_weights(7, 3), T.gaussian_weights(15, 2.5)


@query("win05_savgol_interior", _neighbours(_SAVGOL, "nearest"))
def win05(b):
    return T.weighted_neighbours(b.traces, _SAVGOL, "nearest").select("trace_id", "idx", _R6("smoothed"))


@query("win06_gaussian_zero_edges", _neighbours(_GAUSS, "zero"))
def win06a(b):
    return T.weighted_neighbours(b.traces, _GAUSS, "zero").select("trace_id", "idx", _R6("smoothed"))


@query("win06_gaussian_nearest_edges", _neighbours(_GAUSS, "nearest"))
def win06b(b):
    return T.weighted_neighbours(b.traces, _GAUSS, "nearest").select("trace_id", "idx", _R6("smoothed"))


_PEAKS = """g AS (SELECT *, CASE WHEN intensity <> lag(intensity) OVER (PARTITION BY trace_id ORDER BY idx) THEN 1 WHEN idx = 0 THEN 1 ELSE 0 END AS c FROM traces),
h AS (SELECT *, sum(c) OVER (PARTITION BY trace_id ORDER BY idx) AS run FROM g), r AS (SELECT trace_id, run, min(idx) AS l, max(idx) AS r, min(intensity) AS v FROM h GROUP BY trace_id, run),
s AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM r WINDOW w AS (PARTITION BY trace_id ORDER BY run)),
p1 AS (SELECT trace_id, CAST((l + r) // 2 AS INT) AS idx FROM s WHERE a IS NOT NULL AND z IS NOT NULL AND v > a AND v > z OR l = r AND (a IS NULL AND v > z OR z IS NULL AND v > a)),
tp AS (SELECT trace_id, arg_min(idx, (-intensity, idx)) AS idx FROM traces GROUP BY trace_id),
pk AS (SELECT trace_id, idx, rt, intensity FROM traces JOIN (SELECT * FROM p1 UNION ALL SELECT * FROM tp WHERE trace_id NOT IN (SELECT trace_id FROM p1)) x USING (trace_id, idx))"""


@query("win07_local_maxima", f"WITH {_PEAKS} SELECT trace_id, idx, rt, intensity FROM pk")
def win07(b):
    return T.local_maxima(b.traces)


_BOUNDS = f"""{_PEAKS}, th AS (SELECT trace_id, min(intensity) + (max(intensity) - min(intensity)) * 0.1e0 AS t FROM traces GROUP BY trace_id),
mk AS (SELECT trace_id, idx, intensity <= t AS below FROM traces JOIN th USING (trace_id)),
bd AS (SELECT pk.trace_id, pk.idx, CAST(coalesce((SELECT max(m.idx) FROM mk m WHERE m.trace_id = pk.trace_id AND m.idx < pk.idx AND m.below) + 1, 0) AS INT) AS "left",
  CAST(coalesce((SELECT min(m.idx) FROM mk m WHERE m.trace_id = pk.trace_id AND m.idx > pk.idx AND m.below), (SELECT max(m.idx) + 1 FROM mk m WHERE m.trace_id = pk.trace_id)) AS INT) AS "right" FROM pk)"""


@query("win09_threshold_bounds", f'WITH {_BOUNDS} SELECT trace_id, idx, "left", "right" FROM bd')
def win09(b):
    peaks = T.local_maxima(b.traces)
    return T.threshold_bounds(b.traces, peaks, T.thresholds(b.traces, 0.1))


_SPLITS = f"""{_BOUNDS}, pp AS (SELECT trace_id, lag(idx) OVER w AS lp, idx AS rp, lag(rt) OVER w AS lrt, rt AS rrt, lag(intensity) OVER w AS li, intensity AS ri FROM pk WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
vv AS (SELECT pp.trace_id, lp, rp, lrt, rrt, li, ri, arg_min(t.idx, (t.intensity, t.idx)) AS valley, min(t.intensity) AS depth FROM pp JOIN traces t ON t.trace_id = pp.trace_id AND t.idx BETWEEN lp AND rp WHERE lp IS NOT NULL GROUP BY ALL),
sp AS (SELECT trace_id, lp AS left_peak, rp AS right_peak, valley, coalesce(rrt - lrt >= 0.12e0 AND (depth <= 0 OR li / depth >= 1.7e0 AND ri / depth >= 1.7e0), FALSE) AS split FROM vv)"""


@query("win10_valley_splits", f"WITH {_SPLITS} SELECT trace_id, left_peak, right_peak, valley, split FROM sp")
def win10(b):
    return T.valley_splits(b.traces, T.local_maxima(b.traces), 0.12, 1.7)


_REGIONS = f"""{_SPLITS}, en AS (SELECT trace_id, arg_min("left", idx) AS f, arg_max("right", idx) AS z FROM bd GROUP BY trace_id), ct AS (SELECT * FROM sp WHERE split),
st AS (SELECT trace_id, f AS l, -1 AS pos FROM en UNION ALL SELECT trace_id, least(valley + 1, right_peak), right_peak FROM ct),
rg AS (SELECT s.trace_id, s.n AS region, s.l AS l, coalesce(c.valley + 1, en.z) AS r FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS n FROM st) s
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY right_peak) AS n FROM ct) c ON c.trace_id = s.trace_id AND c.n = s.n JOIN en ON en.trace_id = s.trace_id),
ap AS (SELECT rg.trace_id, region, l, r, count(*) AS scans, arg_min(idx, (-intensity, idx)) AS apex_idx, arg_min(rt, (-intensity, idx)) AS apex_rt, max(intensity) AS apex_intensity FROM rg JOIN traces t ON t.trace_id = rg.trace_id AND idx >= l AND idx < r GROUP BY ALL)"""


def _regions(b):
    return T.regions(b.traces, 0.1, 0.12, 1.7)


@query("win10_regions", f'WITH {_REGIONS} SELECT trace_id, region, l AS "left", r AS "right" FROM rg')
def win10r(b):
    return _regions(b)


@query("win14_raw_apex", f'WITH {_REGIONS} SELECT trace_id, region, l AS "left", r AS "right", scans, apex_idx, apex_rt, apex_intensity FROM ap')
def win14(b):
    return T.apexes(b.traces, _regions(b))


def _in_regions(b):
    return T.inside(b.traces, _regions(b))


_CONT = """ins AS (SELECT rg.trace_id, region, idx, intensity FROM rg JOIN traces t ON t.trace_id = rg.trace_id AND idx >= l AND idx < r),
dd AS (SELECT trace_id, region, idx, intensity - lag(intensity) OVER w AS step, max(intensity) OVER p - greatest(arg_min(intensity, idx) OVER p, arg_max(intensity, idx) OVER p) AS rng, count(*) OVER p AS n FROM ins
  WINDOW w AS (PARTITION BY trace_id, region ORDER BY idx), p AS (PARTITION BY trace_id, region)),
sg AS (SELECT trace_id, region, sign(step) AS s, lag(sign(step)) OVER (PARTITION BY trace_id, region ORDER BY idx) AS was FROM dd WHERE abs(step) >= rng * 0.05e0),
kk AS (SELECT trace_id, region, count(*) AS k, count(*) FILTER (WHERE s <> was) AS ch FROM sg GROUP BY ALL),
co AS (SELECT trace_id, region, CASE WHEN n < 5 THEN NULL WHEN rng <= 0 THEN 0e0 WHEN coalesce(k, 0) <= 2 THEN 1e0 ELSE greatest(0e0, 1 - CAST(ch AS DOUBLE) / greatest(1, k - 1)) END AS continuity
  FROM (SELECT trace_id, region, max(n) AS n, max(rng) AS rng FROM dd GROUP BY ALL) LEFT JOIN kk USING (trace_id, region))"""


@query("win12_trace_continuity", f"WITH {_REGIONS}, {_CONT} SELECT trace_id, region, round(continuity, 6) AS continuity FROM co")
def win12(b):
    return T.continuity(_in_regions(b), ("trace_id", "region")).select("trace_id", "region", _R6("continuity"))


@query("win11_local_minimum_resolver", f"""
WITH {_REGIONS}, {_CONT}, mx AS (SELECT trace_id, max(intensity) AS top, count(*) AS points FROM traces GROUP BY trace_id),
cd AS (SELECT ap.*, (SELECT rt FROM traces t WHERE t.trace_id = ap.trace_id AND t.idx = r - 1) - (SELECT rt FROM traces t WHERE t.trace_id = ap.trace_id AND t.idx = l) AS minutes,
  greatest((SELECT intensity FROM traces t WHERE t.trace_id = ap.trace_id AND t.idx = r - 1), (SELECT intensity FROM traces t WHERE t.trace_id = ap.trace_id AND t.idx = l)) AS edge, top, points, continuity
  FROM ap JOIN mx USING (trace_id) JOIN co USING (trace_id, region))
SELECT trace_id, region, apex_idx, apex_intensity, scans, round(minutes, 6) AS minutes, round(greatest(0, apex_intensity - edge), 6) AS prominence,
  concat_ws(';', CASE WHEN l = 0 OR r = points THEN 'edge_clipped' END, CASE WHEN scans < 5 THEN 'low_scan_support' END, CASE WHEN minutes < 0.15 - 1e-9 THEN 'too_short' END, CASE WHEN minutes > 2 + 1e-9 THEN 'too_broad' END,
    CASE WHEN edge > 0 AND apex_intensity / edge < 1.7 THEN 'poor_edge_recovery' END, CASE WHEN continuity < 0.5 THEN 'low_trace_continuity' END) AS flags
FROM cd WHERE scans >= 2 AND minutes > 0 AND apex_intensity >= 20 AND apex_intensity >= top * 0.05""")  # fmt: skip
def win11(b):
    return P.resolve(b.traces).select("trace_id", "region", "apex_idx", "apex_intensity", "scans", F.round("minutes", 6).alias("minutes"), F.round("prominence", 6).alias("prominence"), F.array_join("flags", ";").alias("flags"))


@query("win13_jaggedness", """
WITH d AS (SELECT trace_id, intensity, abs(intensity - 2 * lag(intensity, 1) OVER w + lag(intensity, 2) OVER w) AS d FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
j AS (SELECT trace_id, CASE WHEN count(*) < 3 OR max(intensity) <= min(intensity) THEN 0 ELSE sum(d) / ((max(intensity) - min(intensity)) * count(*)) END AS j FROM d GROUP BY trace_id)
SELECT trace_id, round(j, 6) AS jaggedness, CASE WHEN j > 0.5 THEN 2 WHEN j > 0.3 THEN 1 ELSE 0 END AS severity FROM j""")  # fmt: skip
def win13(b):
    return T.jaggedness(b.traces).select("trace_id", _R6("jaggedness"), "severity")


@query("win22_candidate_selection", f"""
WITH {_REGIONS}, rk AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY abs(apex_rt - 1.5e0) > 0.35, apex_intensity DESC, apex_idx) AS n FROM ap)
SELECT trace_id, region, apex_idx, apex_rt, apex_intensity FROM rk WHERE n = 1""")  # fmt: skip
def win22(b):
    return T.selected(T.apexes(b.traces, _regions(b)), F.lit(1.5), 0.35).select("trace_id", "region", "apex_idx", "apex_rt", "apex_intensity")


@query("win26_scan_support", f"WITH {_REGIONS} SELECT trace_id, region, least(1e0, scans / 10e0) AS support FROM ap")
def win26(b):
    return T.apexes(b.traces, _regions(b)).select("trace_id", "region", F.least(F.lit(1.0), F.col("scans") / 10).alias("support"))


@query("win29_half_height_shape", f"""
WITH {_PEAKS}, lv AS (SELECT pk.trace_id, pk.idx, pk.rt AS prt, coalesce((SELECT max(t.idx) FROM traces t WHERE t.trace_id = pk.trace_id AND t.idx < pk.idx AND t.intensity < pk.intensity / 2) + 1, 0) AS l,
  coalesce((SELECT min(t.idx) FROM traces t WHERE t.trace_id = pk.trace_id AND t.idx > pk.idx AND t.intensity < pk.intensity / 2) - 1, (SELECT max(t.idx) FROM traces t WHERE t.trace_id = pk.trace_id)) AS r FROM pk)
SELECT lv.trace_id, lv.idx, CAST(l AS INT) AS "left", CAST(r AS INT) AS "right", round(b.rt - a.rt, 6) AS fwhm, round(CASE WHEN prt - a.rt > 0 THEN (b.rt - prt) / (prt - a.rt) END, 6) AS half_width_ratio
FROM lv JOIN traces a ON a.trace_id = lv.trace_id AND a.idx = l JOIN traces b ON b.trace_id = lv.trace_id AND b.idx = r""")  # fmt: skip
def win29(b):
    return T.half_height(b.traces, T.local_maxima(b.traces)).select("trace_id", "idx", "left", "right", _R6("fwhm"), _R6("half_width_ratio"))


@query("win19_gap_mode_windows", """
WITH k AS (SELECT family_id, sample, apex_rt, CASE WHEN apex_rt - lag(apex_rt) OVER w > 0.035e0 THEN 1 WHEN lag(apex_rt) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM cells WHERE status = 'detected' WINDOW w AS (PARTITION BY family_id ORDER BY apex_rt, sample)),
i AS (SELECT *, sum(c) OVER (PARTITION BY family_id ORDER BY apex_rt, sample) AS mode FROM k),
m AS (SELECT family_id, CAST(mode AS INT) AS mode, count(*) AS n, list_sort(list(apex_rt))[len(list(apex_rt)) // 2 + 1] AS md, min(apex_rt) AS lo, max(apex_rt) AS hi FROM i GROUP BY ALL)
SELECT family_id, mode, n, round(md, 6) AS median_rt, round(coalesce((md + lag(md) OVER w) / 2, lo - 0.2e0), 6) AS start_rt, round(coalesce((md + lead(md) OVER w) / 2, hi + 0.2e0), 6) AS end_rt FROM m WINDOW w AS (PARTITION BY family_id ORDER BY mode)""")  # fmt: skip
def win19(b):
    rows = T.gap_islands(b.cells.where("status = 'detected'"), ["family_id"], "apex_rt", 0.035, "sample").withColumnRenamed("island", "mode")
    upper = F.element_at(F.sort_array(F.collect_list("apex_rt")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    modes = rows.groupBy("family_id", "mode").agg(F.count("*").alias("n"), upper.alias("md"), F.min("apex_rt").alias("lo"), F.max("apex_rt").alias("hi"))
    by = W.partitionBy("family_id").orderBy("mode")
    return modes.select(
        "family_id", "mode", "n", _R6("md", "median_rt"), F.round(F.coalesce((F.col("md") + F.lag("md").over(by)) / 2, F.col("lo") - 0.2), 6).alias("start_rt"),
        F.round(F.coalesce((F.col("md") + F.lead("md").over(by)) / 2, F.col("hi") + 0.2), 6).alias("end_rt"),
    )
