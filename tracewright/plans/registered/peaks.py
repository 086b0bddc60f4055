"""Queries of peaks: detection, recovery, prominence, boundaries, segments, region verdicts, shapes (TRC-03, 04, WIN-08, 15, 17, 23, FLT-27, 32, UDF-01, 05)."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.tables import written
from ...operators import models as M
from ...operators import peakquality as Q
from ...operators import peaks as P
from ...operators import proposals as PR
from ...operators import rules as R
from ...operators import traces as T
from ..catalog import query
from .traces import _CONT, _PEAKS, _REGIONS

_R6 = lambda c, n=None: F.round(c, 6).alias(n or c)
_AT = lambda value, place, row="ap": f"(SELECT {value} FROM traces t WHERE t.trace_id = {row}.trace_id AND t.idx = {place})"


def _candidates_sql(name, least, share):
    return f"""{name} AS (SELECT ap.*, {_AT('rt', 'r - 1')} - {_AT('rt', 'l')} AS minutes FROM ap JOIN tm USING (trace_id) WHERE scans >= 2 AND r - 1 > l AND apex_intensity >= {least}e0 AND apex_intensity >= top * {share}e0)"""


# The regions once more with nearly no valleys, under names of their own.
_TAIL = re.sub(r"\b(sp|en|ct|st|rg|ap)\b", r"\g<1>2", _REGIONS[_REGIONS.index("sp AS") :]).replace("1.7e0", "1.05e0")
_PREFERRED = "wp AS (SELECT DISTINCT trace_id, trace_id % 7 / 2e0 + 0.3e0 AS preferred_rt FROM traces WHERE trace_id % 3 <> 0)"
_DETECT = f"""{_REGIONS}, {_TAIL}, tm AS (SELECT trace_id, max(intensity) AS top, count(*) AS points FROM traces GROUP BY trace_id), {_PREFERRED}, {_candidates_sql("cd", 20, 0.05)},
{_candidates_sql("rx", 10, 0.0125).replace("ap.", "ap2.").replace("FROM ap JOIN", "FROM ap2 JOIN")},
ch AS (SELECT * FROM (SELECT cd.*, coalesce(abs(apex_rt - preferred_rt) <= 0.35e0, FALSE) AS near, row_number() OVER (PARTITION BY cd.trace_id ORDER BY coalesce(abs(apex_rt - preferred_rt) <= 0.35e0, FALSE) DESC, apex_intensity DESC, apex_idx) AS n FROM cd JOIN tm USING (trace_id) LEFT JOIN wp USING (trace_id) WHERE points >= 3 AND top > 0) x WHERE n = 1),
rc AS (SELECT * FROM (SELECT rx.*, abs(apex_rt - preferred_rt) AS off, row_number() OVER (PARTITION BY rx.trace_id ORDER BY abs(apex_rt - preferred_rt), region) AS n, max(apex_intensity) OVER (PARTITION BY rx.trace_id) AS tp FROM rx JOIN wp USING (trace_id) JOIN tm USING (trace_id) WHERE points >= 3 AND top > 0 AND trace_id NOT IN (SELECT trace_id FROM ch WHERE near)) x
  WHERE n = 1 AND off <= 0.35e0 AND apex_intensity >= tp * 0.03e0),
be AS (SELECT trace_id, l, r, scans, apex_idx, apex_rt, apex_intensity, 'local_minimum' AS source FROM ch WHERE trace_id NOT IN (SELECT trace_id FROM rc) UNION ALL SELECT trace_id, l, r, scans, apex_idx, apex_rt, apex_intensity, 'preferred_rt_recovery' FROM rc)"""


def _preferred(b):
    return b.traces.where("trace_id % 3 <> 0").select("trace_id").distinct().withColumn("preferred_rt", F.col("trace_id") % 7 / 2 + 0.3)


@query("trc03_detect_peaks", f"""
WITH {_DETECT}, ar AS (SELECT trace_id, sum(part) * 60 AS area FROM (SELECT t.trace_id, (rt - lag(rt) OVER w) * (intensity + lag(intensity) OVER w) / 2 AS part FROM traces t JOIN be ON be.trace_id = t.trace_id AND t.idx >= l AND t.idx < r WINDOW w AS (PARTITION BY t.trace_id ORDER BY idx)) x GROUP BY trace_id)
SELECT tm.trace_id, CASE WHEN points < 3 THEN 'WINDOW_TOO_SHORT' WHEN top <= 0 THEN 'NO_SIGNAL' WHEN apex_idx IS NULL THEN 'PEAK_NOT_FOUND' ELSE 'OK' END AS status, source, l AS "left", r AS "right", scans, apex_idx, apex_rt, apex_intensity, round(area, 4) AS area
FROM tm LEFT JOIN be USING (trace_id) LEFT JOIN ar USING (trace_id)""")  # fmt: skip
def trc03(b):
    return P.detect_peaks(b.traces, _preferred(b)).select("trace_id", "status", "source", "left", "right", "scans", "apex_idx", "apex_rt", "apex_intensity", F.round("area", 4).alias("area"))


@query("win23_preferred_rt_recovery", f"WITH {_DETECT} SELECT trace_id, region, apex_idx, round(off, 6) AS off FROM rc")
def win23(b):
    traces = written(b.traces)
    facts = traces.groupBy("trace_id").agg(F.count("*").alias("n"), F.max("intensity").alias("top")).where("n >= 3 AND top > 0")
    wanted = _preferred(b).join(facts, "trace_id", "left_semi")
    wanted = written(wanted)
    settled = P.resolve(traces).join(wanted, "trace_id").where(F.abs(F.col("apex_rt") - F.col("preferred_rt")) <= 0.35).select("trace_id").distinct()
    asked = written(wanted.join(settled, "trace_id", "left_anti"))
    relaxed = P.resolve(traces.join(asked, "trace_id", "left_semi"), P.PROFILES["relaxed"]).join(asked, "trace_id")
    return P.recovered(relaxed).select("trace_id", "region", "apex_idx", F.round(F.abs(F.col("apex_rt") - F.col("preferred_rt")), 6).alias("off"))


@query("udf01_pluggable_resolver", f"""
WITH {_PEAKS}, k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY intensity DESC, idx) AS n FROM pk WHERE intensity >= 30e0), tm AS (SELECT trace_id, max(intensity) AS top, count(*) AS points FROM traces GROUP BY trace_id)
SELECT tm.trace_id, CASE WHEN points < 3 THEN 'WINDOW_TOO_SHORT' WHEN top <= 0 THEN 'NO_SIGNAL' WHEN k.idx IS NULL THEN 'PEAK_NOT_FOUND' ELSE 'OK' END AS status, k.idx AS apex_idx FROM tm LEFT JOIN (SELECT * FROM k WHERE n = 1) k ON k.trace_id = tm.trace_id AND points >= 3 AND top > 0""")  # fmt: skip
def udf01(b):
    """Detection with a resolver of the caller's own: every local maximum of at least 30, as wide as its scan."""

    def maxima(traces, config):
        rows = T.local_maxima(traces).where("intensity >= 30")
        by = W.partitionBy("trace_id").orderBy("idx")
        return rows.select("trace_id", F.row_number().over(by).alias("region"), F.col("idx").alias("left"), (F.col("idx") + 1).alias("right"), F.lit(1).cast("long").alias("scans"), F.col("idx").alias("apex_idx"), F.col("rt").alias("apex_rt"), F.col("intensity").alias("apex_intensity"), F.lit(0.0).alias("minutes"), F.lit(0.0).alias("prominence"), F.array().cast("array<string>").alias("flags"))

    return P.detect_peaks(b.traces, resolver=maxima).select("trace_id", "status", "apex_idx")


@query("udf05_named_profiles", f"WITH {_REGIONS}, tm AS (SELECT trace_id, max(intensity) AS top FROM traces GROUP BY trace_id), {_candidates_sql('cd', 20, 0.05)} SELECT 'default' AS profile, trace_id, count(*) AS candidates FROM cd GROUP BY trace_id")
def udf05(b):
    name = "default"
    return P.resolve(b.traces, P.PROFILES[name]).groupBy("trace_id").agg(F.count("*").alias("candidates")).select(F.lit(name).alias("profile"), "trace_id", "candidates")


@query("win08_prominence_width", f"""
WITH {_PEAKS}, nb AS (SELECT trace_id, idx, intensity AS v, coalesce((SELECT max(t.idx) FROM traces t WHERE t.trace_id = pk.trace_id AND t.idx < pk.idx AND t.intensity > pk.intensity), -1) AS lo,
  coalesce((SELECT min(t.idx) FROM traces t WHERE t.trace_id = pk.trace_id AND t.idx > pk.idx AND t.intensity > pk.intensity), (SELECT max(t.idx) + 1 FROM traces t WHERE t.trace_id = pk.trace_id)) AS hi FROM pk),
pm AS (SELECT *, v - greatest((SELECT min(t.intensity) FROM traces t WHERE t.trace_id = nb.trace_id AND t.idx > lo AND t.idx <= nb.idx), (SELECT min(t.intensity) FROM traces t WHERE t.trace_id = nb.trace_id AND t.idx >= nb.idx AND t.idx < hi)) AS p FROM nb),
lv AS (SELECT *, (SELECT max(t.idx) FROM traces t WHERE t.trace_id = pm.trace_id AND t.idx > lo AND t.idx <= pm.idx AND t.intensity <= v - p * 0.5e0) AS a, (SELECT min(t.idx) FROM traces t WHERE t.trace_id = pm.trace_id AND t.idx >= pm.idx AND t.idx < hi AND t.intensity <= v - p * 0.5e0) AS z FROM pm),
ip AS (SELECT lv.trace_id, lv.idx, p, a + CASE WHEN x.intensity < v - p * 0.5e0 THEN (v - p * 0.5e0 - x.intensity) / ((SELECT intensity FROM traces t WHERE t.trace_id = lv.trace_id AND t.idx = a + 1) - x.intensity) ELSE 0 END AS li,
  z - CASE WHEN y.intensity < v - p * 0.5e0 THEN (v - p * 0.5e0 - y.intensity) / ((SELECT intensity FROM traces t WHERE t.trace_id = lv.trace_id AND t.idx = z - 1) - y.intensity) ELSE 0 END AS ri FROM lv JOIN traces x ON x.trace_id = lv.trace_id AND x.idx = a JOIN traces y ON y.trace_id = lv.trace_id AND y.idx = z)
SELECT trace_id, idx, round(p, 6) AS prominence, round(li, 6) AS left_ip, round(ri, 6) AS right_ip FROM ip""")  # fmt: skip
def win08(b):
    return P.prominences(b.traces).select("trace_id", "idx", _R6("prominence"), _R6("left_ip"), _R6("right_ip"))


_LEFT_OF = lambda level: f"coalesce((SELECT max(t.idx) FROM traces t WHERE t.trace_id = eg.trace_id AND t.idx < eg.apex_idx AND t.intensity <= {level}), 0)"
_RIGHT_OF = lambda level: f"coalesce((SELECT min(t.idx) + 1 FROM traces t WHERE t.trace_id = eg.trace_id AND t.idx > eg.apex_idx AND t.intensity <= {level}), n)"
_BOUNDARY = f"""{_REGIONS}, tm AS (SELECT trace_id, max(intensity) AS top, count(*) AS n FROM traces GROUP BY trace_id), {_candidates_sql("cd", 20, 0.05)},
eg AS (SELECT cd.*, greatest({_AT('intensity', 'l', 'cd')}, {_AT('intensity', 'r - 1', 'cd')}) AS edge, n FROM cd JOIN tm USING (trace_id)),
stp AS (SELECT trace_id, idx, intensity <= lag(intensity) OVER w AS up, intensity <= lead(intensity) OVER w AS down FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
bh AS (SELECT trace_id, region, apex_idx, l, r, 0 AS k, 'candidate_interval' AS src, n FROM eg
  UNION ALL SELECT trace_id, region, apex_idx, {_LEFT_OF("edge + (apex_intensity - edge) * 0.5e0")}, {_RIGHT_OF("edge + (apex_intensity - edge) * 0.5e0")}, 1, 'half_height', n FROM eg WHERE apex_intensity > edge
  UNION ALL SELECT trace_id, region, apex_idx, {_LEFT_OF("edge + (apex_intensity - edge) * 0.05e0")}, {_RIGHT_OF("edge + (apex_intensity - edge) * 0.05e0")}, 2, 'baseline_return', n FROM eg WHERE apex_intensity > edge
  UNION ALL SELECT trace_id, region, apex_idx, coalesce((SELECT max(s.idx) FROM stp s WHERE s.trace_id = eg.trace_id AND s.idx <= apex_idx AND s.up), 0), coalesce((SELECT min(s.idx) + 1 FROM stp s WHERE s.trace_id = eg.trace_id AND s.idx >= apex_idx AND s.down), n), 3, 'derivative_zero_crossing', n FROM eg),
bv AS (SELECT trace_id, region, apex_idx, k, src, n, greatest(0, least(l, n - 2)) AS l, greatest(greatest(0, least(l, n - 2)) + 2, least(r, n)) AS r FROM bh),
bm AS (SELECT trace_id, region, apex_idx, l, r, string_agg(src, ';' ORDER BY k) AS sources FROM bv GROUP BY ALL),
cu AS (SELECT trace_id, idx, rt, intensity, sum(coalesce(part, 0)) OVER (PARTITION BY trace_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS area FROM (SELECT *, (rt - lag(rt) OVER w) * (intensity + lag(intensity) OVER w) / 2 * 60 AS part FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY idx)) x),
bs AS (SELECT bm.trace_id, region, apex_idx, l, r, sources, a.rt AS rt_left, z.rt AS rt_right, z.rt - a.rt AS width, z.area - a.area AS area, r - l AS scans, greatest(a.intensity, z.intensity) AS edge FROM bm JOIN cu a ON a.trace_id = bm.trace_id AND a.idx = l JOIN cu z ON z.trace_id = bm.trace_id AND z.idx = r - 1)"""


@query("win15_boundary_hypotheses", f'WITH {_BOUNDARY} SELECT trace_id, region, l AS "left", r AS "right", sources, round(width, 6) AS width, round(area, 3) AS area, scans FROM bs')
def win15(b):
    rows = P.boundary_hypotheses(b.traces, P.resolve(b.traces))
    return rows.select("trace_id", "region", "left", "right", F.array_join("sources", ";").alias("sources"), _R6("width"), F.round("area", 3).alias("area"), "scans")


_SCORED = f"""{_BOUNDARY}, {_CONT}, bc AS (SELECT bs.*, ap.apex_intensity, ap.apex_rt, contains(sources, 'candidate_interval') AS own, (ap.apex_intensity - edge) / ap.apex_intensity AS baseline, continuity, max(width) FILTER (WHERE contains(sources, 'candidate_interval')) OVER (PARTITION BY bs.trace_id, bs.region) AS ref
  FROM bs JOIN ap ON ap.trace_id = bs.trace_id AND ap.region = bs.region JOIN co ON co.trace_id = bs.trace_id AND co.region = bs.region),
sc AS (SELECT *, CAST(least(100, greatest(0, 50 + CASE WHEN baseline >= 0.5 THEN 20 WHEN baseline >= 0.2 THEN 5 ELSE -20 END + CASE WHEN continuity IS NULL THEN 0 WHEN continuity >= 0.75 THEN 15 ELSE -15 END + CASE WHEN scans >= 5 THEN 10 WHEN scans >= 3 THEN 5 ELSE -15 END
  + CASE WHEN ref <= 0 THEN 0 WHEN width / ref BETWEEN 0.5 AND 1.5 THEN 5 WHEN width / ref < 0.25 OR width / ref > 2 THEN -10 ELSE 0 END)) AS INT) AS score,
  concat_ws(';', CASE WHEN own THEN 'candidate_interval' END, CASE WHEN baseline >= 0.5 THEN 'baseline_supported' WHEN baseline >= 0.2 THEN 'baseline_partial' END, CASE WHEN continuity >= 0.75 THEN 'trace_continuity_ok' END, CASE WHEN scans >= 5 THEN 'scan_support_ok' WHEN scans >= 3 THEN 'scan_support_minimal' END,
    CASE WHEN ref > 0 AND width / ref BETWEEN 0.5 AND 1.5 THEN 'width_near_candidate' END) AS support,
  concat_ws(';', CASE WHEN baseline < 0.2 THEN 'low_baseline_signal' END, CASE WHEN continuity IS NULL THEN 'trace_continuity_unavailable' WHEN continuity < 0.75 THEN 'low_trace_continuity' END, CASE WHEN scans < 3 THEN 'low_scan_support' END,
    CASE WHEN ref <= 0 THEN 'width_reference_unavailable' WHEN width / ref BETWEEN 0.5 AND 1.5 THEN NULL WHEN width / ref < 0.25 OR width / ref > 2 THEN 'width_extreme' ELSE 'width_shifted' END) AS concerns FROM bc)"""


def _scored(b):
    traces = written(b.traces)
    found = written(P.resolved(traces))
    rows = P.boundary_hypotheses(traces, found.drop("continuity")).join(found.select("trace_id", "region", "apex_rt", "apex_intensity", "continuity"), ["trace_id", "region"])
    at = lambda k, shift: traces.select("trace_id", (F.col("idx") + shift).alias(k), F.col("intensity").alias(f"_{k}"))
    rows = rows.join(at("left", 0), ["trace_id", "left"]).join(at("right", 1), ["trace_id", "right"])
    own = F.array_contains("sources", "candidate_interval")
    reference = F.max(F.when(own, F.col("width"))).over(W.partitionBy("trace_id", "region"))
    rows = rows.withColumns({"is_interval": own, "reference": reference, "baseline": (F.col("apex_intensity") - F.greatest("_left", "_right")) / F.col("apex_intensity")})
    score = P.boundary_score(F.col("baseline"), F.col("continuity"), F.col("scans"), F.col("width"), F.col("reference"), F.col("is_interval"))
    return rows.select("trace_id", "region", "left", "right", "sources", "is_interval", "rt_left", "apex_rt", "rt_right", "apex_intensity", "area", "scans", *[c.alias(n) for n, c in score.items()])


@query("flt27_boundary_score", f'WITH {_SCORED} SELECT trace_id, region, l AS "left", r AS "right", score, support, concerns FROM sc')
def flt27(b):
    return _scored(b).select("trace_id", "region", "left", "right", "score", F.array_join("support", ";").alias("support"), F.array_join("concerns", ";").alias("concerns"))


_BEST = lambda where: f"arg_max(struct_pack(region, bid, rt_left, rt_right, area, scans, score), (score, area3, own, bid)) FILTER (WHERE {where})"


@query("flt32_region_verdicts", f"""
WITH {_SCORED}, se AS (SELECT trace_id, arg_min(region, (-apex_intensity, region)) AS sel FROM cd GROUP BY trace_id), bd2 AS (SELECT sc.*, round(area, 3) AS area3, sc.region || '|' || l || '|' || r AS bid, sel = sc.region AS selected FROM sc JOIN se USING (trace_id)),
cr AS (SELECT trace_id, coalesce({_BEST("selected AND own")}, {_BEST("selected")}) AS c FROM bd2 GROUP BY trace_id), j AS (SELECT bd2.*, c, CASE WHEN c.area <= 0 THEN 1e300 ELSE round(area3 / round(c.area, 3), 5) END AS ratio FROM bd2 JOIN cr USING (trace_id)),
fa AS (SELECT trace_id, c, count(*) AS n, {_BEST("scans >= 3 AND region = c.region AND bid <> c.bid AND score >= c.score AND ratio >= 1.5")} AS w, max(score) FILTER (WHERE region <> c.region AND scans >= 3) AS nb, max(score) AS top, count(*) FILTER (WHERE own AND scans >= 3) AS k, sum(score) FILTER (WHERE own AND scans >= 3) AS total, sum(area3) FILTER (WHERE own AND scans >= 3) AS area FROM j GROUP BY trace_id, c),
gp AS (SELECT trace_id, round(greatest(coalesce(max(g), 0), 0), 5) AS gap FROM (SELECT trace_id, rt_left - lag(rt_right) OVER (PARTITION BY trace_id ORDER BY rt_left, bid) AS g FROM bd2 WHERE own AND scans >= 3) x GROUP BY trace_id)
SELECT fa.trace_id, CASE WHEN c IS NULL THEN 'skipped_no_candidate' WHEN c.scans < 3 THEN 'skipped_low_scan_support' ELSE 'evaluated' END AS status,
  CASE WHEN c IS NULL OR c.scans < 3 OR n = 1 THEN 'insufficient_evidence' WHEN EXISTS (SELECT 1 FROM j WHERE j.trace_id = fa.trace_id AND j.region <> fa.c.region AND j.apex_rt BETWEEN fa.w.rt_left AND fa.w.rt_right) THEN 'merge_suggested'
  WHEN k >= 2 AND gap <= 0.08e0 AND CASE WHEN c.area <= 0 THEN 1e300 ELSE round(area / round(c.area, 3), 5) END <= 1.2 THEN 'merge_suggested' WHEN k >= 2 AND total >= top + 20 THEN 'split_supported' WHEN nb >= c.score + 15 THEN 'neighbor_apex_preferred' WHEN w IS NOT NULL THEN 'wider_boundary_preferred' ELSE 'current_supported' END AS verdict
FROM fa LEFT JOIN gp USING (trace_id)""")  # fmt: skip
def flt32(b):
    return P.region_verdicts(_marked(b)).select("trace_id", "status", "verdict")


def _marked(b):
    """Scored boundaries, those of the strongest candidate selected."""
    rows = written(_scored(b))  # with a row at least for each candidate
    first = rows.groupBy("trace_id").agg(F.min(F.struct(-F.col("apex_intensity"), F.col("region")))["region"].alias("_sel"))
    return rows.join(first, "trace_id").withColumns({"selected": F.col("region") == F.col("_sel"), "boundary_id": F.concat_ws("|", "region", "left", "right"), "area": F.round("area", 3)})


@query("trc03_safe_merge")
def trc03_safe_merge(b):
    rows = P.safe_merge(b.traces, _marked(b))
    return rows.select("trace_id", "verdict", "outcome", "reason", "left", "right", _R6("rt_left"), _R6("rt_right"), "scans", F.round("area", 3).alias("area"), _R6("area_ratio"), "intervals", "gap")


_SMOOTH15 = T.gaussian_weights(15, 2.5)
_SM = " + ".join(f"coalesce(lag(residual, {7 - i}) OVER w, 0e0) * {w!r}e0" if i < 7 else f"residual * {w!r}e0" if i == 7 else f"coalesce(lead(residual, {i - 7}) OVER w, 0e0) * {w!r}e0" for i, w in enumerate(_SMOOTH15))


@query("win17_segments", f"""
WITH rs AS (SELECT trace_id, idx, rt, intensity - min(intensity) OVER (PARTITION BY trace_id) AS residual, count(*) OVER (PARTITION BY trace_id) AS n FROM traces), sm AS (SELECT trace_id, idx, rt, residual, CASE WHEN n < 15 THEN residual ELSE {re.sub(r"e-([0-9]+)e0", r"e-\1", _SM)} END AS intensity, n FROM rs WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
{_PEAKS.replace("traces", "sm")}, tp2 AS (SELECT trace_id, max(intensity) AS top, max(n) AS n FROM sm GROUP BY trace_id HAVING max(n) >= 3 AND max(intensity) > 0),
sd AS (SELECT pk.*, n, greatest(1e0, intensity * 0.02e0) AS thr, row_number() OVER w AS segment, lag(idx) OVER w AS pi, lead(idx) OVER w AS ni, lag(intensity) OVER w AS pv, lead(intensity) OVER w AS nv FROM pk JOIN tp2 USING (trace_id) WHERE intensity >= greatest(5e0, top * 0.05e0) WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
vl AS (SELECT sd.*, (SELECT arg_min(t.idx, (t.intensity, t.idx)) FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx BETWEEN pi AND sd.idx) AS lv, (SELECT min(t.intensity) FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx BETWEEN pi AND sd.idx) AS lvv,
  (SELECT arg_min(t.idx, (t.intensity, t.idx)) FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx BETWEEN sd.idx AND ni) AS rv, (SELECT min(t.intensity) FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx BETWEEN sd.idx AND ni) AS rvv,
  coalesce((SELECT max(t.idx) + 1 FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx < sd.idx AND t.intensity <= thr), 0) AS l0, coalesce((SELECT min(t.idx) FROM sm t WHERE t.trace_id = sd.trace_id AND t.idx > sd.idx AND t.intensity <= thr), n) AS r0 FROM sd),
ed AS (SELECT *, greatest(l0, coalesce(lv, 0)) AS l, greatest(greatest(l0, coalesce(lv, 0)) + 1, least(r0, coalesce(rv + 1, n))) AS r, coalesce(lvv / least(intensity, pv) <= 0.3, FALSE) OR coalesce(rvv / least(intensity, nv) <= 0.3, FALSE) AS cut, coalesce(lvv / least(intensity, pv) > 0.3, FALSE) OR coalesce(rvv / least(intensity, nv) > 0.3, FALSE) AS shoulder FROM vl)
SELECT trace_id, segment, idx AS apex_idx, round(intensity, 6) AS height, CAST(l AS INT) AS "left", CAST(r AS INT) AS "right", CASE WHEN r - l < 3 THEN 'low_scan_segment' WHEN shoulder THEN 'shoulder_candidate' WHEN cut THEN 'separate_peak' ELSE 'isolated_peak' END AS kind,
  CASE WHEN r - l < 3 THEN 'segment_too_few_scans' WHEN shoulder THEN 'shoulder_overlap_review' WHEN cut THEN 'baseline_valley_split' ELSE 'baseline_return' END AS stop FROM ed""")  # fmt: skip
def win17(b):
    lowest = F.min("intensity").over(W.partitionBy("trace_id"))
    residual = b.traces.select("trace_id", "idx", "rt", (F.col("intensity") - lowest).alias("intensity"))
    return P.segments(residual).select("trace_id", "segment", "apex_idx", F.round("height", 6).alias("height"), "left", "right", "kind", "stop")


@query("trc04_shape_similarity")
def trc04(b):
    """Each candidate's shape beside that of its trace's strongest candidate."""
    found = written(P.resolve(b.traces))
    curves = P.apex_curves(b.traces, found).join(found.select("trace_id", "region", "apex_intensity"), ["trace_id", "region"])
    by = W.partitionBy("trace_id").orderBy(F.desc("apex_intensity"), "region")
    rows = curves.withColumn("reference", F.first("curve").over(by))
    return rows.select("trace_id", "region", F.round(P.shape_similarity("curve", "reference"), 6).alias("similarity"))


_QUALITY_CELLS = """qc AS (
  SELECT trace_id, k, CASE WHEN (trace_id + k) % 11 <> 0 THEN (trace_id % 7) * 0.3e0 + k END AS start_rt, (trace_id % 7) * 0.3e0 + k + (trace_id % 5 - k) * 0.35e0 AS end_rt
  FROM (SELECT DISTINCT trace_id FROM traces UNION ALL SELECT max(trace_id) + 1 FROM traces) t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) c
)"""


@query("flt34_peak_quality_vectors", f"""
WITH {_QUALITY_CELLS}, p AS (
  SELECT trace_id, rt, intensity, row_number() OVER w AS pos, abs(intensity - lag(intensity) OVER w) AS step FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY rt, intensity)
), j AS (
  SELECT qc.*, pos, rt, intensity, step, coalesce(rt BETWEEN start_rt AND end_rt, FALSE) AS within FROM qc LEFT JOIN p USING (trace_id)
), f AS (
  SELECT trace_id, k, count(pos) AS points, count(*) FILTER (WHERE within) AS m, max(intensity) FILTER (WHERE within) AS top, max(intensity) FILTER (WHERE NOT within) AS outer_top,
    arg_min(intensity, pos) FILTER (WHERE within) AS first_in, arg_max(intensity, pos) FILTER (WHERE within) AS last_in, median(step) * 0.7413e0 AS steps,
    CASE WHEN count(pos) = 0 THEN 'no_raw_trace_vector' WHEN count(pos) < 5 THEN 'insufficient_raw_trace_vector_points' WHEN any_value(start_rt) IS NULL THEN 'cell_boundary_missing_for_peak_quality_vector'
      WHEN any_value(end_rt) <= any_value(start_rt) THEN 'cell_boundary_invalid_for_peak_quality_vector' WHEN count(*) FILTER (WHERE within) < 3 THEN 'insufficient_boundary_vector_points' END AS empty
  FROM j GROUP BY trace_id, k
), v AS (
  SELECT j.*, f.* EXCLUDE (trace_id, k) FROM j JOIN f USING (trace_id, k) WHERE empty IS NULL
), b AS (
  SELECT trace_id, k, median(intensity) AS base FROM v WHERE NOT within OR points - m < 3 GROUP BY ALL
), d AS (
  SELECT trace_id, k, base, median(abs(intensity - base)) * 1.4826e0 AS spread FROM v JOIN b USING (trace_id, k) WHERE NOT within OR points - m < 3 GROUP BY ALL
), a AS (
  SELECT trace_id, k, min(pos) FILTER (WHERE within AND intensity = top) AS apex FROM v GROUP BY ALL
), h AS (
  SELECT d.*, apex, top, outer_top, CASE WHEN top > base THEN base + (top - base) / 2 END AS half, CASE WHEN spread > 0 THEN spread ELSE steps END AS noise
  FROM d JOIN a USING (trace_id, k) JOIN f USING (trace_id, k)
), c AS (
  SELECT trace_id, k, max(pos) FILTER (WHERE pos < apex AND intensity <= half) AS lo, min(pos) FILTER (WHERE pos > apex AND intensity <= half) AS hi FROM v JOIN h USING (trace_id, k) GROUP BY ALL
), x AS (
  SELECT c.trace_id, c.k, top_p.rt AS apex_rt, CASE WHEN l2.intensity = l1.intensity THEN l1.rt ELSE l1.rt + (l2.rt - l1.rt) * (half - l1.intensity) / (l2.intensity - l1.intensity) END AS left_rt,
    CASE WHEN r2.intensity = r1.intensity THEN r1.rt ELSE r1.rt + (r2.rt - r1.rt) * (half - r1.intensity) / (r2.intensity - r1.intensity) END AS right_rt
  FROM c JOIN h USING (trace_id, k) LEFT JOIN p l1 ON l1.trace_id = c.trace_id AND l1.pos = lo LEFT JOIN p l2 ON l2.trace_id = c.trace_id AND l2.pos = lo + 1
    LEFT JOIN p r1 ON r1.trace_id = c.trace_id AND r1.pos = hi LEFT JOIN p r2 ON r2.trace_id = c.trace_id AND r2.pos = hi - 1 LEFT JOIN p top_p ON top_p.trace_id = c.trace_id AND top_p.pos = apex
), s1 AS (
  SELECT trace_id, k, pos, intensity - lag(intensity) OVER (PARTITION BY trace_id, k ORDER BY pos) AS delta FROM v WHERE within
), s2 AS (
  SELECT trace_id, k, (delta > 0) <> (lag(delta) OVER (PARTITION BY trace_id, k ORDER BY pos) > 0) AS turn FROM s1 WHERE delta <> 0
), z AS (
  SELECT trace_id, k, count(*) FILTER (WHERE turn) / CAST(count(turn) AS DOUBLE) AS turns, count(turn) AS n FROM s2 GROUP BY ALL
), e AS (
  SELECT f.trace_id, f.k, empty, points, CASE WHEN empty IS NULL OR empty LIKE '%boundary_vector_points' THEN m ELSE 0 END AS inside,
    CASE WHEN noise > 0 THEN greatest(0, h.top - base) / noise END AS signal_to_noise, CASE WHEN right_rt > left_rt THEN (right_rt - left_rt) * 60 END AS fwhm_sec,
    CASE WHEN empty IS NULL AND f.top > 0 THEN greatest(0, least(1, (f.top - greatest(first_in, last_in)) / f.top)) END AS sharpness,
    CASE WHEN empty IS NULL AND m >= 4 THEN CASE WHEN coalesce(z.n, 0) < 1 THEN 0 ELSE turns END END AS zigzag,
    CASE WHEN right_rt > left_rt AND apex_rt > left_rt THEN greatest(0, right_rt - apex_rt) / (apex_rt - left_rt) END AS tailing_ratio,
    CASE WHEN empty IS NULL AND f.outer_top > 0 THEN f.top / f.outer_top END AS boundary_margin_ratio
  FROM f LEFT JOIN h USING (trace_id, k) LEFT JOIN x USING (trace_id, k) LEFT JOIN z USING (trace_id, k)
), n AS (
  SELECT *, (signal_to_noise IS NOT NULL)::INT + (fwhm_sec IS NOT NULL)::INT + (sharpness IS NOT NULL)::INT + (zigzag IS NOT NULL)::INT + (tailing_ratio IS NOT NULL)::INT + (boundary_margin_ratio IS NOT NULL)::INT AS feature_count,
    concat_ws('_', CASE WHEN signal_to_noise < 3 THEN 'low_signal_to_noise_proxy' END, CASE WHEN fwhm_sec IS NULL THEN 'fwhm_unavailable' END, CASE WHEN sharpness < 0.1 THEN 'low_peak_sharpness' END, CASE WHEN zigzag > 0.6 THEN 'high_local_zigzag' END) AS against
  FROM e
)
SELECT trace_id, k, CASE WHEN empty IS NOT NULL THEN 'not_available' WHEN feature_count < 4 THEN 'inconclusive' WHEN against <> '' THEN 'partial_support' ELSE 'supportive' END AS status,
  CASE WHEN empty IS NOT NULL THEN empty WHEN feature_count < 4 THEN 'raw_trace_peak_quality_vector_incomplete' WHEN against <> '' THEN 'raw_trace_peak_quality_vector_partial_' || against ELSE 'raw_trace_peak_quality_vector_supportive' END AS reason,
  points, inside, round(signal_to_noise, 6) AS signal_to_noise, round(fwhm_sec, 4) AS fwhm_sec, round(sharpness, 6) AS sharpness, round(zigzag, 6) AS zigzag, round(tailing_ratio, 5) AS tailing_ratio,
  round(boundary_margin_ratio, 6) AS boundary_margin_ratio, feature_count
FROM n""")  # fmt: skip
def flt34(b):
    """Two cells on each trace, some of them without a start, turned round or beyond it, and two of a trace that doesn't exist."""
    traces = b.traces
    ids = traces.select("trace_id").distinct().unionByName(traces.agg((F.max("trace_id") + 1).alias("trace_id")))
    cells = ids.select("trace_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    start = (F.col("trace_id") % 7) * 0.3 + F.col("k")
    cells = cells.withColumns({"start_rt": F.when((F.col("trace_id") + F.col("k")) % 11 != 0, start), "end_rt": start + (F.col("trace_id") % 5 - F.col("k")) * 0.35})
    found = Q.quality_vectors(traces, cells)
    return found.select(
        "trace_id", "k", "status", "reason", "points", "inside", _R6("signal_to_noise"), F.round("fwhm_sec", 4).alias("fwhm_sec"), _R6("sharpness"), _R6("zigzag"), F.round("tailing_ratio", 5).alias("tailing_ratio"),
        _R6("boundary_margin_ratio"), "feature_count",
    )


_FIT = PR.polynomial_fit(7, 3)
_ROWS = "[" + ", ".join("[" + ", ".join(f"{w!r}" for w in row) + "]" for row in _FIT) + "]"


@query("win05_savgol", f"""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM traces), p AS (SELECT *, CASE WHEN idx < 3 THEN idx WHEN idx >= n - 3 THEN idx - n + 7 ELSE 3 END AS place FROM n)
SELECT p.trace_id, p.idx, CASE WHEN any_value(p.n) >= 7 THEN round(sum(t.intensity * {_ROWS}[p.place + 1][t.idx - p.idx + p.place + 1]), 6) END AS smoothed
FROM p JOIN traces t ON t.trace_id = p.trace_id AND t.idx BETWEEN p.idx - p.place AND p.idx - p.place + 6 GROUP BY p.trace_id, p.idx""")  # fmt: skip
def win05_edges(b):
    return PR.savgol(b.traces, 7, 3).select("trace_id", "idx", _R6("smoothed"))


@query("trc03_savgol_detection")
def trc03_savgol(b):
    config = P.ResolverConfig(smooth_window=7)
    return P.detect_peaks(b.traces, config=config, resolver="savgol").select("trace_id", "status", "source", "left", "right", "apex_idx", F.round("area", 3).alias("area"))


@query("win15_wavelet_boundaries")
def win15_wavelet(b):
    found = written(P.resolve(b.traces))
    rows = P.boundary_hypotheses(b.traces, PR.with_scales(found, PR.wavelet_candidates(b.traces)))
    return rows.select("trace_id", "region", "left", "right", F.array_join("sources", ";").alias("sources"), _R6("width"), F.round("area", 3).alias("area"), "scans")


@query("flt18_noise_and_window")
def flt18_noise(b):
    """The severities that need a trace: local signal to noise at its highest point, in clean and dirty matrices, and whether that lies outside a window."""
    top = F.min_by(F.struct("idx", "rt"), F.struct(-F.col("intensity"), F.col("idx"))).alias("a")
    apexes = b.traces.groupBy("trace_id").agg(top).select("trace_id", F.col("a.idx").alias("apex_idx"), F.col("a.rt").alias("apex_rt"))
    found = M.local_signal_to_noise(b.traces, apexes).join(apexes.select("trace_id", "apex_rt"), "trace_id")
    parts = (F.col("usable"), F.col("noise"), F.col("ratio"))
    low = (F.col("trace_id") % 5) * 0.4
    return found.select(
        "trace_id", "apex_idx", F.round("ratio", 5).alias("ratio"), R.local_noise_severity(*parts).alias("local_sn"), R.local_noise_severity(*parts, dirty=True).alias("local_sn_dirty"),
        R.outside_window(F.col("apex_rt"), low, low + 1.5).alias("outside_window"),
    )
