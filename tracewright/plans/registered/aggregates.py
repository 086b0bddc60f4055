"""Queries of aggregations (AGG), rolling windows (WIN-01 to 04, 25, 27, 28), sorts and set operations (SRT, SET)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...operators import priors as PRI
from ...operators import joins as J
from ...operators import models as M
from ...operators import rules as R
from ..catalog import query
from .joins import _NEAR, near_families, paired
from .rules import _ACCEPTED, _QUALITY, compound_medians, quality_cells

def _ok():
    return R.accepted_detection(F.col("rt"), F.col("area"), F.col("confidence"), F.col("nl"))



@query("agg04_target_summary", f"""
SELECT label, count(*) AS n, count(*) FILTER (WHERE {_ACCEPTED}) AS detected, round(100e0 * count(*) FILTER (WHERE {_ACCEPTED}) / count(*), 4) AS pct, round(median(area) FILTER (WHERE {_ACCEPTED}), 4) AS median_area,
  round(avg(rt) FILTER (WHERE {_ACCEPTED}), 6) AS mean_rt, count(*) FILTER (WHERE nl = 'OK') AS nl_ok, count(*) FILTER (WHERE nl = 'NL_FAIL') AS nl_fail, count(*) FILTER (WHERE confidence = 'HIGH') AS high, count(*) FILTER (WHERE confidence = 'VERY_LOW') AS very_low FROM results GROUP BY label""")  # fmt: skip
def agg04(b):
    n = lambda c: F.count_if(c)
    return b.results.withColumn("ok", _ok()).groupBy("label").agg(
        F.count("*").alias("n"), n(F.col("ok")).alias("detected"), F.round(100 * n(F.col("ok")) / F.count("*"), 4).alias("pct"), F.round(F.percentile(F.when(F.col("ok"), F.col("area")), 0.5), 4).alias("median_area"),
        F.round(F.avg(F.when(F.col("ok"), F.col("rt"))), 6).alias("mean_rt"), n(F.col("nl") == "OK").alias("nl_ok"), n(F.col("nl") == "NL_FAIL").alias("nl_fail"),
        n(F.col("confidence") == "HIGH").alias("high"), n(F.col("confidence") == "VERY_LOW").alias("very_low"),
    )


@query("agg05_review_metrics", f"""
SELECT coalesce(label, '(all)') AS label, count(*) AS n, count(*) FILTER (WHERE flags <> '') AS flagged, round(CAST(count(*) FILTER (WHERE flags <> '') AS DOUBLE) / count(*), 6) AS flag_rate, count(*) FILTER (WHERE confidence IN ('LOW', 'VERY_LOW')) AS low FROM results GROUP BY ROLLUP (label)""")  # fmt: skip
def agg05(b):
    flagged = F.count_if(F.col("flags") != "")
    return b.results.rollup("label").agg(F.count("*").alias("n"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("flag_rate"), F.count_if(F.col("confidence").isin("LOW", "VERY_LOW")).alias("low")).withColumn("label", F.coalesce("label", F.lit("(all)")))


@query("agg06_heatmap_state", f"SELECT label, sample, CASE WHEN rt IS NULL THEN 'missing' WHEN NOT {_ACCEPTED} THEN 'rejected' WHEN flags <> '' THEN 'flagged' ELSE 'clean' END AS state FROM results")
def agg06(b):
    state = F.when(F.col("rt").isNull(), "missing").when(~_ok(), "rejected").when(F.col("flags") != "", "flagged").otherwise("clean")
    return b.results.select("label", "sample", state.alias("state"))


@query("agg07_family_status", """
SELECT family_id, count(*) AS cells, count(*) FILTER (WHERE status = 'detected') AS detected, count(*) FILTER (WHERE status = 'rescued') AS rescued, count(*) FILTER (WHERE status = 'absent') AS absent,
  round(CAST(count(*) FILTER (WHERE status IN ('detected', 'rescued')) AS DOUBLE) / count(*), 6) AS present_rate FROM cells GROUP BY family_id""")  # fmt: skip
def agg07(b):
    n = lambda *k: F.count_if(F.col("status").isin(*k))
    return b.cells.groupBy("family_id").agg(F.count("*").alias("cells"), n("detected").alias("detected"), n("rescued").alias("rescued"), n("absent").alias("absent"), F.round(n("detected", "rescued") / F.count("*"), 6).alias("present_rate"))


@query("agg08_leave_one_out_range", """
WITH p AS (SELECT r.sample, r.label, r.area / i.area AS ratio FROM results r JOIN results i ON i.sample = r.sample AND i.label = r.istd_pair AND i.is_istd WHERE NOT r.is_istd AND r.area / i.area IS NOT NULL),
m AS (SELECT a.sample, a.label, a.ratio, count(*) AS refs, median(b.ratio) AS md FROM p a JOIN p b ON a.label = b.label AND a.sample <> b.sample GROUP BY ALL),
d AS (SELECT m.sample, m.label, m.ratio, refs, md, median(abs(b.ratio - md)) AS mad FROM m JOIN p b ON m.label = b.label AND m.sample <> b.sample GROUP BY ALL)
SELECT sample, label, refs, round(md - 3 * 1.4826e0 * mad, 6) AS low, round(md + 3 * 1.4826e0 * mad, 6) AS high, ratio BETWEEN md - 3 * 1.4826e0 * mad AND md + 3 * 1.4826e0 * mad AS inside FROM d WHERE refs >= 3""")  # fmt: skip
def agg08(b):
    rows = paired(b).where("ratio IS NOT NULL").select("sample", "label", "ratio")
    other = rows.select("label", F.col("sample").alias("o_sample"), F.col("ratio").alias("o_ratio"))
    both = rows.join(other, "label").where("sample <> o_sample")
    md = both.groupBy("sample", "label").agg(F.count("*").alias("refs"), F.percentile("o_ratio", 0.5).alias("md"))
    mad = both.join(md, ["sample", "label"]).groupBy("sample", "label", "ratio", "refs", "md").agg(F.percentile(F.abs(F.col("o_ratio") - F.col("md")), 0.5).alias("mad"))
    low, high = F.col("md") - 3 * 1.4826 * F.col("mad"), F.col("md") + 3 * 1.4826 * F.col("mad")
    return mad.where("refs >= 3").select("sample", "label", "refs", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.col("ratio").between(low, high).alias("inside"))


@query("agg10_sample_drift", """
SELECT sample, round(coalesce(median(rt - (rt_min + rt_max) / 2) FILTER (WHERE r.is_istd), 0), 6) AS drift FROM results r JOIN targets USING (label) GROUP BY sample""")  # fmt: skip
def agg10(b):
    rows = b.results.drop("is_istd").join(b.targets.select("label", "is_istd", "rt_min", "rt_max"), "label")
    off = F.when(F.col("is_istd"), F.col("rt") - (F.col("rt_min") + F.col("rt_max")) / 2)
    return rows.groupBy("sample").agg(F.round(F.coalesce(F.percentile(off, 0.5), F.lit(0.0)), 6).alias("drift"))


@query("agg11_drift_lookup", """
WITH r AS (SELECT label, median(rt) AS ref FROM standards WHERE role = 'qc' GROUP BY label) SELECT sample_name, round(median(rt - ref), 6) AS delta, min(injection_order) AS injection_order, count(DISTINCT injection_order) > 1 AS conflict FROM standards JOIN r USING (label) GROUP BY sample_name""")  # fmt: skip
def agg11(b):
    reference = b.standards.where("role = 'qc'").groupBy("label").agg(F.percentile("rt", 0.5).alias("ref"))
    rows = b.standards.join(reference, "label")
    return rows.groupBy("sample_name").agg(F.round(F.percentile(F.col("rt") - F.col("ref"), 0.5), 6).alias("delta"), F.min("injection_order").alias("injection_order"), (F.count_distinct("injection_order") > 1).alias("conflict"))


@query("agg12_group_centre", "SELECT tag, CAST(floor(precursor_mz) AS BIGINT) AS bin, count(*) AS n, round(avg(precursor_mz), 6) AS mz, round(avg(apex_rt), 6) AS rt, round(avg(product_mz), 6) AS product, round(avg(observed_loss), 6) AS loss FROM owners GROUP BY ALL")
def agg12(b):
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return b.owners.groupBy("tag", F.floor("precursor_mz").alias("bin")).agg(F.count("*").alias("n"), r("precursor_mz", "mz"), r("apex_rt", "rt"), r("product_mz", "product"), r("observed_loss", "loss"))


@query("agg13_seed_group_summary", """
SELECT sample, tag, precursor_mz, min(rt) AS rt_min, max(rt) AS rt_max, count(*) AS n, arg_min(seed_id, (-intensity, loss_error_ppm, rt, scan_number, seed_id)) AS best_seed, CASE WHEN count(DISTINCT mz_basis) > 1 THEN 'mixed' ELSE min(mz_basis) END AS basis FROM seeds GROUP BY sample, tag, precursor_mz""")  # fmt: skip
def agg13(b):
    rank = F.struct(-F.col("intensity"), F.col("loss_error_ppm"), F.col("rt"), F.col("scan_number"), F.col("seed_id"))
    return b.seeds.groupBy("sample", "tag", "precursor_mz").agg(
        F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.count("*").alias("n"), F.min_by("seed_id", rank).alias("best_seed"), F.when(F.min("mz_basis") != F.max("mz_basis"), "mixed").otherwise(F.min("mz_basis")).alias("basis")
    )


@query("agg14_product_trace_summary", """
WITH k AS (SELECT sample, tag, rt, scan_number, max(intensity) AS i FROM seeds GROUP BY ALL), d AS (SELECT *, (rt - lag(rt) OVER w) * (i + lag(i) OVER w) / 2 AS part FROM k WINDOW w AS (PARTITION BY sample, tag ORDER BY rt, scan_number))
SELECT sample, tag, arg_min(rt, (-i, rt)) AS apex_rt, max(i) AS apex, round(coalesce(sum(part), 0) * 60, 2) AS area, count(*) AS points, CASE WHEN count(*) >= 500 AND max(i) >= 100000 THEN 'strong' WHEN count(*) >= 500 THEN 'moderate' ELSE 'weak' END AS strength FROM d GROUP BY sample, tag""")  # fmt: skip
def agg14(b):
    points = b.seeds.groupBy("sample", "tag", "rt", "scan_number").agg(F.max("intensity").alias("i"))
    by = W.partitionBy("sample", "tag").orderBy("rt", "scan_number")
    part = (F.col("rt") - F.lag("rt").over(by)) * (F.col("i") + F.lag("i").over(by)) / 2
    n, top = F.count("*"), F.max("i")
    return points.withColumn("part", part).groupBy("sample", "tag").agg(
        F.min_by("rt", F.struct(-F.col("i"), F.col("rt"))).alias("apex_rt"), top.alias("apex"), F.round(F.coalesce(F.sum("part"), F.lit(0.0)) * 60, 2).alias("area"), n.alias("points"),
        F.when((n >= 500) & (top >= 100000), "strong").when(n >= 500, "moderate").otherwise("weak").alias("strength"),
    )


_PAIRED_AREAS = """pa AS (SELECT a.family_id, a.sample, log10(a.area) AS x, log10(o.area) AS y FROM cells a JOIN cells o ON o.sample = a.sample AND o.family_id = 'F' || (CAST(substr(a.family_id, 2) AS BIGINT) + 1) WHERE a.area > 0 AND o.area > 0)"""


def _paired_areas(b):
    other = b.cells.where("area > 0").select(F.concat(F.lit("F"), (F.substring("family_id", 2, 9).cast("long") - 1).cast("string")).alias("family_id"), "sample", F.log10("area").alias("y"))
    return b.cells.where("area > 0").select("family_id", "sample", F.log10("area").alias("x")).join(other, ["family_id", "sample"])


@query("agg15_pearson_spearman", f"""
WITH {_PAIRED_AREAS}, r AS (SELECT *, rank() OVER (PARTITION BY family_id ORDER BY x) + (count(*) OVER (PARTITION BY family_id, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY family_id ORDER BY y) + (count(*) OVER (PARTITION BY family_id, y) - 1) / 2e0 AS ry FROM pa)
SELECT family_id, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY family_id HAVING count(*) >= 3""")  # fmt: skip
def agg15(b):
    rank = lambda c: F.rank().over(W.partitionBy("family_id").orderBy(c)) + (F.count("*").over(W.partitionBy("family_id", c)) - 1) / 2
    ranked = _paired_areas(b).withColumns({"rx": rank("x"), "ry": rank("y")})
    return ranked.groupBy("family_id").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman")).where("n >= 3")


@query("agg16_percentiles", """
WITH r AS (SELECT family_id, area, row_number() OVER (PARTITION BY family_id ORDER BY area) AS k, count(*) OVER (PARTITION BY family_id) AS n FROM cells WHERE area IS NOT NULL)
SELECT family_id, round(quantile_cont(area, 0.95), 4) AS p95_linear, max(area) FILTER (WHERE k = CAST(ceil(n * 0.95e0) AS BIGINT)) AS p95_nearest FROM r GROUP BY family_id""")  # fmt: skip
def agg16(b):
    by = W.partitionBy("family_id")
    ranked = b.cells.where("area IS NOT NULL").select("family_id", "area", F.row_number().over(by.orderBy("area")).alias("k"), F.count("*").over(by).alias("n"))
    return ranked.groupBy("family_id").agg(F.round(F.percentile("area", 0.95), 4).alias("p95_linear"), F.max(F.when(F.col("k") == F.ceil(F.col("n") * 0.95), F.col("area"))).alias("p95_nearest"))


@query("agg18_match_summary", f"""
WITH {_NEAR}, s AS (SELECT count(*) AS pairs, median(ppm) AS md, quantile_cont(rt_sec, 0.95) AS p95, avg(jaccard) AS jac FROM np)
SELECT metric, round(value, 6) AS value, CASE WHEN value <= ok THEN 'OK' WHEN value <= warn THEN 'WARN' ELSE 'BLOCK' END AS status FROM (SELECT 'median_ppm' AS metric, md AS value, 5 AS ok, 15 AS warn FROM s UNION ALL SELECT 'p95_rt_sec', p95, 5, 10 FROM s UNION ALL SELECT 'mean_jaccard', jac, 1, 2 FROM s UNION ALL SELECT 'pairs', pairs, 100, 200 FROM s)""")  # fmt: skip
def agg18(b):
    limits = b.spark.createDataFrame([("median_ppm", 5.0, 15.0), ("p95_rt_sec", 5.0, 10.0), ("mean_jaccard", 1.0, 2.0), ("pairs", 100.0, 200.0)], "metric string, ok double, warn double")
    one = near_families(b).agg(F.percentile("ppm", 0.5).alias("median_ppm"), F.percentile("rt_sec", 0.95).alias("p95_rt_sec"), F.avg("jaccard").alias("mean_jaccard"), F.count("*").cast("double").alias("pairs"))
    rows = one.unpivot([], one.columns, "metric", "value").join(limits, "metric")
    return rows.select("metric", F.round("value", 6).alias("value"), F.when(F.col("value") <= F.col("ok"), "OK").when(F.col("value") <= F.col("warn"), "WARN").otherwise("BLOCK").alias("status"))


@query("agg19_grouping_sets", """
SELECT compound, status, CAST(grouping(compound) * 2 + grouping(status) AS BIGINT) AS level, count(*) AS n FROM trends GROUP BY GROUPING SETS ((compound), (status), (compound, status), ())""")  # fmt: skip
def agg19(b):
    c, s = F.col("compound"), F.col("status")
    return b.trends.groupingSets([[c], [s], [c, s], []], c, s).agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("compound", "status", "level", "n")


@query("agg20_keep_best_distinct", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY round(precursor_mz, 4), round(mz, 4), sample ORDER BY intensity DESC, scan_number, ion) AS n FROM products) SELECT sample, scan_number, ion, intensity FROM k WHERE n = 1""")  # fmt: skip
def agg20(b):
    by = W.partitionBy(F.round("precursor_mz", 4), F.round("mz", 4), "sample").orderBy(F.desc("intensity"), "scan_number", "ion")
    return b.products.withColumn("n", F.row_number().over(by)).where("n = 1").select("sample", "scan_number", "ion", "intensity")


_ISSUES = f"""iq AS (SELECT sample, label, 1 AS priority, 'NL_FAIL' AS issue, 'loss missing' AS evidence FROM results WHERE nl = 'NL_FAIL' UNION ALL SELECT sample, label, 2, 'NO_SIGNAL', 'no peak' FROM results WHERE rt IS NULL
UNION ALL SELECT sample, label, 3, 'LOW_CONFIDENCE', 'confidence ' || confidence FROM results WHERE confidence IN ('LOW', 'VERY_LOW') UNION ALL SELECT sample, label, 4, 'FLAGGED', flags FROM results WHERE flags <> '')"""


def issues(b):
    """Diagnostic rows of results: one for each issue that a result has."""
    issue = lambda c, p, n, e: F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(n).alias("issue"), e.alias("evidence")))
    found = F.array_compact(F.array(
        issue(F.col("nl") == "NL_FAIL", 1, "NL_FAIL", F.lit("loss missing")), issue(F.col("rt").isNull(), 2, "NO_SIGNAL", F.lit("no peak")),
        issue(F.col("confidence").isin("LOW", "VERY_LOW"), 3, "LOW_CONFIDENCE", F.concat(F.lit("confidence "), "confidence")), issue(F.col("flags") != "", 4, "FLAGGED", F.col("flags")),
    ))
    return b.results.select("sample", "label", F.inline(found))


@query("flt26_diagnostic_rows", f"WITH {_ISSUES} SELECT sample, label, priority, issue, evidence FROM iq")
def flt26(b):
    return issues(b)


@query("agg21_review_queue", f"""
WITH {_ISSUES} SELECT sample, label, arg_min(issue, priority) AS issue, min(priority) AS priority, count(*) AS n, string_agg(evidence, '; ' ORDER BY priority) AS evidence FROM iq GROUP BY sample, label""")  # fmt: skip
def agg21(b):
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", "evidence"))), lambda x: x["evidence"]), "; ")
    return issues(b).groupBy("sample", "label").agg(F.min_by("issue", "priority").alias("issue"), F.min("priority").alias("priority"), F.count("*").alias("n"), text.alias("evidence"))


@query("agg22_benchmark_gate", f"""
WITH s AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE {_ACCEPTED}) AS d, median(abs(rt - (rt_min + rt_max) / 2)) AS off FROM results JOIN targets USING (label) GROUP BY label)
SELECT label, round(CAST(d AS DOUBLE) / n, 6) AS coverage, round(off, 6) AS rt_off, concat_ws(';', CASE WHEN d < 0.8 * n THEN 'coverage' END, CASE WHEN off > 1 THEN 'rt' END) AS failures, CASE WHEN d < 0.4 * n OR off > 5 THEN 'FAIL' WHEN d < 0.8 * n OR off > 1 THEN 'WARN' ELSE 'PASS' END AS gate FROM s""")  # fmt: skip
def agg22(b):
    from ...functions.columns import flags

    rows = b.results.join(b.targets.select("label", "rt_min", "rt_max"), "label")
    s = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(_ok()).alias("d"), F.percentile(F.abs(F.col("rt") - (F.col("rt_min") + F.col("rt_max")) / 2), 0.5).alias("off"))
    few, far = F.col("d") < 0.8 * F.col("n"), F.col("off") > 1
    gate = F.when((F.col("d") < 0.4 * F.col("n")) | (F.col("off") > 5), "FAIL").when(few | far, "WARN").otherwise("PASS")
    return s.select("label", F.round(F.col("d") / F.col("n"), 6).alias("coverage"), F.round("off", 6).alias("rt_off"), F.array_join(flags((few, "coverage"), (far, "rt")), ";").alias("failures"), gate.alias("gate"))


@query("agg25_gate_sensitivity", """
WITH g AS (SELECT sample, label, list_filter(['confidence', 'nl', 'area', 'flags'], lambda x: CASE x WHEN 'confidence' THEN confidence IN ('LOW', 'VERY_LOW') WHEN 'nl' THEN nl IN ('NL_FAIL', 'NO_MS2') WHEN 'area' THEN area < 60000 ELSE flags <> '' END) AS gates FROM results)
SELECT gate, count(*) AS hits, count(*) FILTER (WHERE len(gates) = 1) AS sole FROM g, unnest(gates) AS t(gate) GROUP BY gate""")  # fmt: skip
def agg25(b):
    from ...functions.columns import flags

    gates = flags((F.col("confidence").isin("LOW", "VERY_LOW"), "confidence"), (F.col("nl").isin("NL_FAIL", "NO_MS2"), "nl"), (F.col("area") < 60000, "area"), (F.col("flags") != "", "flags"))
    rows = b.results.select(gates.alias("gates")).select(F.explode("gates").alias("gate"), F.size("gates").alias("k"))
    return rows.groupBy("gate").agg(F.count("*").alias("hits"), F.count_if(F.col("k") == 1).alias("sole"))


@query("agg26_guardrail_metrics", f"""
WITH {_QUALITY} SELECT metric, n FROM (SELECT count(*) AS cells, count(*) FILTER (WHERE quality = 'detected_quantifiable') AS detected, count(*) FILTER (WHERE quality = 'rescue_quantifiable') AS rescued, count(*) FILTER (WHERE quality = 'review_rescue') AS review, count(*) FILTER (WHERE quality = 'invalid') AS invalid FROM c)
UNPIVOT (n FOR metric IN (cells, detected, rescued, review, invalid))""")  # fmt: skip
def agg26(b):
    n = lambda k: F.count_if(F.col("quality") == k)
    one = quality_cells(b).agg(F.count("*").alias("cells"), n("detected_quantifiable").alias("detected"), n("rescue_quantifiable").alias("rescued"), n("review_rescue").alias("review"), n("invalid").alias("invalid"))
    return one.unpivot([], one.columns, "metric", "n")


@query("agg27_stage_timing", "SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS samples, round(sum(value), 4) AS total, max(value) AS longest FROM events GROUP BY event_type")
def agg27(b):
    return b.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("samples"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("longest"))


@query("agg28_blast_radius", f"""
WITH {_QUALITY}, o AS (SELECT family_id, sample, status, quality, CASE WHEN quality = 'review_rescue' AND reason = 'rt_outside_max' THEN 'rescue_quantifiable' ELSE quality END AS changed FROM c)
SELECT coalesce(status, '(all)') AS status, coalesce(changed, '(all)') AS decision, count(*) AS n, count(*) FILTER (WHERE quality <> changed) AS touched FROM o GROUP BY CUBE (status, changed)""")  # fmt: skip
def agg28(b):
    changed = F.when((F.col("quality") == "review_rescue") & (F.col("reason") == "rt_outside_max"), "rescue_quantifiable").otherwise(F.col("quality"))
    rows = quality_cells(b).withColumn("decision", changed).withColumn("moved", F.col("quality") != F.col("decision"))
    return rows.cube("status", "decision").agg(F.count("*").alias("n"), F.count_if("moved").alias("touched")).select(F.coalesce("status", F.lit("(all)")).alias("status"), F.coalesce("decision", F.lit("(all)")).alias("decision"), "n", "touched")


@query("agg29_rt_band_summary", "SELECT CAST(floor(apex_rt / 2) AS BIGINT) AS band, count(DISTINCT family_id) AS families, round(max(apex_rt) - min(apex_rt), 6) AS spread, round(median(apex_rt), 6) AS md FROM cells GROUP BY band")
def agg29(b):
    return b.cells.groupBy(F.floor(F.col("apex_rt") / 2).alias("band")).agg(F.count_distinct("family_id").alias("families"), F.round(F.max("apex_rt") - F.min("apex_rt"), 6).alias("spread"), F.round(F.percentile("apex_rt", 0.5), 6).alias("md"))


@query("agg30_backfill_classes", """
WITH n AS (SELECT family_id, count(*) FILTER (WHERE status = 'detected') AS d, count(*) FILTER (WHERE status = 'rescued') AS r, count(*) AS k FROM cells GROUP BY family_id)
SELECT family_id, CASE WHEN d = 0 AND r > 0 THEN 'rescue_only' WHEN d + r < 0.3 * k THEN 'low_coverage' WHEN r > d THEN 'rescue_heavy' ELSE 'supported' END AS class FROM n""")  # fmt: skip
def agg30(b):
    n = b.cells.groupBy("family_id").agg(F.count_if(F.col("status") == "detected").alias("d"), F.count_if(F.col("status") == "rescued").alias("r"), F.count("*").alias("k"))
    d, r = F.col("d"), F.col("r")
    return n.select("family_id", F.when((d == 0) & (r > 0), "rescue_only").when(d + r < 0.3 * F.col("k"), "low_coverage").when(r > d, "rescue_heavy").otherwise("supported").alias("class"))


@query("win01_rolling_median", """
SELECT sample_name, label, CASE WHEN injection_order IS NOT NULL AND count(*) OVER w >= 3 THEN round(median(rt) OVER w, 6) END AS rolling FROM standards WHERE injection_order IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY injection_order RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING)
UNION ALL SELECT sample_name, label, NULL FROM standards WHERE injection_order IS NULL""")  # fmt: skip
def win01(b):
    return rolling(b).select("sample_name", "label", F.round("rolling", 6).alias("rolling"))


def rolling(b, width: int = 40):
    """Median RT of a standard over the injections within `width` of a sample's own; null without an order or under three values."""
    return PRI.rolling_median(b.standards, ["label"], "injection_order", "rt", width, "rolling")


@query("udf04_rt_priors", """
WITH sm AS (SELECT sample, CASE WHEN CAST(substr(sample, 2) AS INT) % 7 <> 6 THEN CAST(substr(sample, 2) AS INT) END AS o FROM (SELECT DISTINCT sample FROM results) s),
sd AS (SELECT sample, label, rt FROM results WHERE is_istd AND rt IS NOT NULL),
lb AS (SELECT label, CASE WHEN length(label) % 2 = 0 THEN (rt_min + rt_max) / 2 END AS abs_rt, 0.1e0 AS abs_sigma, CASE WHEN length(label) <> 3 THEN rt_min / 10 END AS delta, 0.05e0 AS delta_sigma FROM targets),
gr AS (SELECT sm.sample, o, t.label, is_istd, istd_pair, abs_rt, abs_sigma, delta, delta_sigma FROM sm CROSS JOIN targets t JOIN lb ON lb.label = t.label),
ro AS (SELECT gr.sample, gr.label, median(sd.rt) AS rolling FROM gr JOIN sm m ON m.o BETWEEN gr.o - 3 AND gr.o + 3 JOIN sd ON sd.sample = m.sample AND sd.label = gr.label WHERE gr.is_istd GROUP BY ALL HAVING count(*) >= 3)
SELECT gr.sample, gr.label, round(CASE WHEN is_istd THEN coalesce(rolling, abs_rt) ELSE sd.rt + delta END, 6) AS rt_prior, CASE WHEN is_istd THEN CASE WHEN rolling IS NULL AND abs_rt IS NOT NULL THEN abs_sigma END WHEN sd.rt + delta IS NOT NULL THEN delta_sigma END AS rt_prior_sigma,
  CASE WHEN is_istd THEN CASE WHEN rolling IS NOT NULL THEN 'rolling_median' WHEN abs_rt IS NOT NULL THEN 'library_abs' ELSE '' END WHEN sd.rt + delta IS NOT NULL THEN 'delta_rt_library' ELSE '' END AS prior_source, NOT is_istd AND sd.rt + delta IS NOT NULL AS prefer_prior
FROM gr LEFT JOIN ro ON ro.sample = gr.sample AND ro.label = gr.label LEFT JOIN sd ON sd.sample = gr.sample AND sd.label = gr.istd_pair AND NOT is_istd""")  # fmt: skip
def udf04(b):
    """Priors of all targets in all samples: standards by their neighbours' RTs or the library, others by their pair's RT."""
    number = F.substring("sample", 2, 9).cast("int")
    samples = b.results.select("sample").distinct().withColumn("injection_order", F.when(number % 7 != 6, number))
    size = F.length("label")
    known = b.targets.select(
        "label", F.explode(F.array(F.lit("ISTD"), F.lit("analyte"))).alias("role"), F.when(size % 2 == 0, (F.col("rt_min") + F.col("rt_max")) / 2).alias("median_abs_rt"), F.lit(0.1).alias("sigma_abs_rt"),
        F.when(size != 3, F.col("rt_min") / 10).alias("median_delta_rt"), F.lit(0.05).alias("sigma_delta_rt"),
    )
    found = PRI.rt_priors(b.targets, samples, b.results.where("is_istd").select("sample", "label", "rt"), known, 3)
    return found.withColumn("rt_prior", F.round("rt_prior", 6))


@query("win03_anchor_reference", """
WITH w AS (SELECT sample_name, label, median(rt) OVER w AS r, count(*) OVER w AS n FROM standards WHERE injection_order IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY injection_order RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING)),
o AS (SELECT label, median(rt) AS md FROM standards GROUP BY label)
SELECT s.sample_name, s.label, round(CASE WHEN n >= 3 THEN r END, 6) AS injection_local, round(md, 6) AS observed FROM standards s JOIN o USING (label) JOIN w USING (sample_name, label) WHERE n >= 3""")  # fmt: skip
def win03(b):
    observed = b.standards.groupBy("label").agg(F.percentile("rt", 0.5).alias("md"))
    return rolling(b).where("rolling IS NOT NULL").join(observed, "label").select("sample_name", "label", F.round("rolling", 6).alias("injection_local"), F.round("md", 6).alias("observed"))


@query("win04_drift_evidence", """
WITH w AS (SELECT sample_name, label, rt, median(rt) OVER w AS r, count(*) OVER w AS n FROM standards WHERE injection_order IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY injection_order RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING))
SELECT sample_name, label, round(rt - r, 6) AS delta, dense_rank() OVER (ORDER BY label) AS trend_id FROM w WHERE n >= 3""")  # fmt: skip
def win04(b):
    # Labels are few, so that their ranks are joined rather than computed over all rows.
    labels = b.standards.select("label").distinct().withColumn("trend_id", F.dense_rank().over(W.orderBy("label")).cast("long"))
    return rolling(b).where("rolling IS NOT NULL").join(labels, "label").select("sample_name", "label", F.round(F.col("rt") - F.col("rolling"), 6).alias("delta"), "trend_id")


@query("win02_loess_reference", """
WITH s AS (SELECT sample_name, label, injection_order AS x, rt FROM standards WHERE injection_order IS NOT NULL), n AS (SELECT label, greatest(CAST(ceil(count(*) * 0.3e0) AS BIGINT), 5, 3) AS k FROM s GROUP BY label),
d AS (SELECT a.sample_name, a.label, a.x AS x0, b.x, b.rt, abs(b.x - a.x) AS dist, row_number() OVER (PARTITION BY a.sample_name, a.label ORDER BY abs(b.x - a.x), b.sample_name) AS r, k FROM s a JOIN s b ON a.label = b.label AND a.sample_name <> b.sample_name JOIN n ON n.label = a.label),
m AS (SELECT *, max(dist) OVER (PARTITION BY sample_name, label) AS far FROM d WHERE r <= k), w AS (SELECT *, CASE WHEN far > 0 THEN pow(1 - pow(dist / CAST(far AS DOUBLE), 3), 3) ELSE 1 END AS w FROM m),
t AS (SELECT sample_name, label, x0, sum(w) AS sw, sum(w * x) AS sx, sum(w * rt) AS sy, sum(w * x * x) AS sxx, sum(w * x * rt) AS sxy FROM w GROUP BY ALL)
SELECT sample_name, label, round(CASE WHEN abs(sw * sxx - sx * sx) > 1e-9 THEN (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw + (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * x0 ELSE sy / sw END, 5) AS reference FROM t WHERE sw > 0""")  # fmt: skip
def win02(b):
    """A local line through the nearest injections of other samples, with tricube weights."""
    return M.loess(b.standards, "label", "sample_name", "injection_order", "rt").select("sample_name", "label", F.round("reference", 5).alias("reference"))


@query("win25_keep_best_rescue", """
WITH k AS (SELECT family_id, status, sample, area, row_number() OVER (PARTITION BY family_id ORDER BY status <> 'rescued', area DESC NULLS LAST, abs(rt_delta_sec) NULLS LAST, apex_rt, sample) AS n FROM cells WHERE status IN ('rescued', 'unchecked', 'absent')) SELECT family_id, sample, status, n = 1 AS selected FROM k""")  # fmt: skip
def win25(b):
    by = W.partitionBy("family_id").orderBy(F.col("status") != "rescued", F.col("area").desc_nulls_last(), F.abs("rt_delta_sec").asc_nulls_last(), "apex_rt", "sample")
    return b.cells.where(F.col("status").isin("rescued", "unchecked", "absent")).select("family_id", "sample", "status", (F.row_number().over(by) == 1).alias("selected"))


@query("win27_injection_column_order", "SELECT sample_name, CAST(row_number() OVER (ORDER BY injection_order NULLS LAST, sample_name) AS INT) AS position FROM samples")
def win27(b):
    return J.total_order(b.samples, [F.col("injection_order").asc_nulls_last(), F.col("sample_name")], "position").select("sample_name", "position")


@query("win28_trend_medians", """
WITH m AS (SELECT label, CASE WHEN count(*) FILTER (WHERE role = 'qc') >= 3 THEN median(rt) FILTER (WHERE role = 'qc') ELSE median(rt) END AS md FROM standards GROUP BY label) SELECT sample_name, label, round(rt - md, 6) AS delta FROM standards JOIN m USING (label)""")  # fmt: skip
def win28(b):
    qc = F.when(F.col("role") == "qc", F.col("rt"))
    md = b.standards.groupBy("label").agg(F.when(F.count(qc) >= 3, F.percentile(qc, 0.5)).otherwise(F.percentile("rt", 0.5)).alias("md"))
    return b.standards.join(md, "label").select("sample_name", "label", F.round(F.col("rt") - F.col("md"), 6).alias("delta"))


@query("win30_pattern_coherence", """
SELECT family_id, sample, round((end_rt - start_rt) - avg(end_rt - start_rt) OVER (PARTITION BY family_id), 6) AS vs_family, round(rt_delta_sec - avg(rt_delta_sec) OVER (PARTITION BY sample), 6) AS vs_sample FROM cells WHERE status = 'detected'""")  # fmt: skip
def win30(b):
    width = F.col("end_rt") - F.col("start_rt")
    return b.cells.where("status = 'detected'").select("family_id", "sample", F.round(width - F.avg(width).over(W.partitionBy("family_id")), 6).alias("vs_family"), F.round(F.col("rt_delta_sec") - F.avg("rt_delta_sec").over(W.partitionBy("sample")), 6).alias("vs_sample"))


@query("srt02_worst_observations", """
WITH m AS (SELECT compound, median(apex_rt) AS md, median(area) AS ma FROM trends WHERE status = 'detected' GROUP BY compound) SELECT compound, arg_min(sample_name, (-abs(apex_rt - md), sample_name)) AS worst_rt, arg_min(sample_name, (-abs(log2(area / ma)), sample_name)) FILTER (WHERE area IS NOT NULL) AS worst_area
FROM trends JOIN m USING (compound) WHERE status = 'detected' AND apex_rt IS NOT NULL GROUP BY compound""")  # fmt: skip
def srt02(b):
    detected = b.trends.where("status = 'detected'")
    md = detected.groupBy("compound").agg(F.percentile("apex_rt", 0.5).alias("md"), F.percentile("area", 0.5).alias("ma"))
    rows = detected.where("apex_rt IS NOT NULL").join(md, "compound")
    worst = lambda off, fine=F.lit(True): F.min(F.when(fine, F.struct((-off).alias("o"), F.col("sample_name").alias("s"))))["s"]
    return rows.groupBy("compound").agg(worst(F.abs(F.col("apex_rt") - F.col("md"))).alias("worst_rt"), worst(F.abs(F.log2(F.col("area") / F.col("ma"))), F.col("area").isNotNull()).alias("worst_area"))


@query("srt03_total_order", "SELECT family_id, CAST(row_number() OVER (ORDER BY tag, center_mz, center_rt NULLS LAST, family_id) AS INT) AS rank FROM families")
def srt03(b):
    return J.total_order(b.families, [F.col("tag"), F.col("center_mz"), F.col("center_rt").asc_nulls_last(), F.col("family_id")], "rank").select("family_id", "rank")


@query("srt04_category_order", "SELECT candidate_id, CASE upper(trace_quality) WHEN 'GOOD' THEN 1 WHEN 'CLEAN' THEN 2 WHEN 'FAIR' THEN 3 ELSE 0 END AS rank FROM candidates")
def srt04(b):
    return b.candidates.select("candidate_id", F.array_position(F.array(*map(F.lit, ("GOOD", "CLEAN", "FAIR"))), F.upper("trace_quality")).cast("int").alias("rank"))


@query("set01_union_families", "SELECT family_id, tag, CAST(NULL AS BOOLEAN) AS review_only FROM families WHERE has_anchor UNION ALL SELECT family_id || '-R', tag, TRUE FROM families WHERE NOT has_anchor")
def set01(b):
    clean = b.families.where("has_anchor").select("family_id", "tag")
    review = b.families.where("NOT has_anchor").select(F.concat("family_id", F.lit("-R")).alias("family_id"), "tag", F.lit(True).alias("review_only"))
    return clean.unionByName(review, allowMissingColumns=True)


@query("set02_tag_combination", """
WITH m AS (SELECT sample, CAST(floor(precursor_mz) AS BIGINT) AS bin, list_sort(list(DISTINCT tag)) AS matched FROM owners WHERE tag <> '' GROUP BY ALL)
SELECT sample, bin, array_to_string(matched, ';') AS tags, list_has_all(matched, ['tag0', 'tag1']) AS complete FROM m""")  # fmt: skip
def set02(b):
    m = b.owners.where("tag <> ''").groupBy("sample", F.floor("precursor_mz").alias("bin")).agg(F.sort_array(F.collect_set("tag")).alias("matched"))
    return m.select("sample", "bin", F.array_join("matched", ";").alias("tags"), (F.size(F.array_except(F.array(F.lit("tag0"), F.lit("tag1")), "matched")) == 0).alias("complete"))


@query("set03_sample_scope", "SELECT sample FROM cells INTERSECT SELECT sample FROM owners")
def set03(b):
    return b.cells.select("sample").intersect(b.owners.select("sample"))


@query("set04_except", "SELECT family_id, sample FROM cells EXCEPT SELECT family_id, sample FROM cells WHERE status IN ('detected', 'rescued')")
def set04(b):
    return b.cells.select("family_id", "sample").exceptAll(b.cells.where(F.col("status").isin("detected", "rescued")).select("family_id", "sample"))


@query("set05_merge_evidence", """
WITH u AS (SELECT family_id, sample, area, 1 AS src FROM cells WHERE status = 'detected' UNION ALL SELECT family_id, sample, area, 2 FROM cells WHERE status IN ('rescued', 'detected') UNION ALL SELECT family_id, sample, 0, 3 FROM cells),
k AS (SELECT *, row_number() OVER (PARTITION BY family_id, sample ORDER BY area IS NULL, src) AS n FROM u) SELECT family_id, sample, area, src FROM k WHERE n = 1""")  # fmt: skip
def set05(b):
    part = lambda rows, k, area="area": rows.select("family_id", "sample", F.col(area) if area == "area" else F.lit(0.0).alias("area"), F.lit(k).alias("src"))
    union = part(b.cells.where("status = 'detected'"), 1).unionByName(part(b.cells.where(F.col("status").isin("rescued", "detected")), 2)).unionByName(part(b.cells, 3, ""))
    by = W.partitionBy("family_id", "sample").orderBy(F.col("area").isNull(), "src")
    return union.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")
