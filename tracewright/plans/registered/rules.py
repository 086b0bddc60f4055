"""Queries of row classifications (FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import ppm_distance, within_ppm
from ...operators import rules as R
from ..catalog import query

_JOINED = "FROM owners a JOIN owners b ON a.owner_id + 1000 = b.owner_id"


def _pairs(b):
    side = lambda k, shift: b.owners.select((F.col("owner_id") + shift).alias("key"), F.col("owner_id").alias(f"{k}_id"), F.col("precursor_mz").alias(f"{k}_mz"), F.col("product_mz").alias(f"{k}_product"))
    return side("a", 1000).join(side("b", 0), "key")


@query("flt01_within_ppm", f"SELECT a.owner_id AS a_id, b.owner_id AS b_id, abs(a.precursor_mz - b.precursor_mz) / abs(b.precursor_mz) * 1e6 <= 10 AS within {_JOINED}")
def flt01(b):
    return _pairs(b).select("a_id", "b_id", within_ppm(F.col("a_mz"), F.col("b_mz"), 10.0).alias("within"))


@query("flt02_ppm", f"SELECT a.owner_id AS a_id, b.owner_id AS b_id, round(abs(a.product_mz - b.product_mz) / greatest(abs(a.product_mz), 1e-12) * 1e6, 6) AS ppm {_JOINED}")
def flt02(b):
    return _pairs(b).select("a_id", "b_id", F.round(ppm_distance(F.col("a_product"), F.col("b_product")), 6).alias("ppm"))


@query("flt03_crop_by_rt", "SELECT trace_id, idx, rt, intensity FROM traces WHERE rt BETWEEN 0.5 AND 1.75")
def flt03(b):
    return R.crop_by_rt(b.traces, 1.75, 0.5)


@query("flt04_target_applicability", """
WITH j AS (SELECT sample_name, label, sample_applicability AS k, contains(regexp_replace(lower(sample_name), '[^a-z0-9]', '', 'g'), 'rna') AS rna FROM samples, targets)
SELECT sample_name, label, CASE WHEN k = 'all' OR k = 'rna_containing' AND rna THEN NULL ELSE 'target_sample_applicability:' || k END AS reason FROM j""")  # fmt: skip
def flt04(b):
    return R.applicability(b.samples, b.targets)


@query("flt05_sample_group", r"""
SELECT sample_name, CASE WHEN regexp_matches(sample_name, '(?i)(^|[^A-Za-z0-9])QC([\s_-]*\d+)?($|[^A-Za-z0-9])') THEN 'QC' WHEN starts_with(upper(sample_name), 'TUMOR') THEN 'Tumor'
  WHEN starts_with(upper(sample_name), 'NORMAL') THEN 'Normal' WHEN starts_with(upper(sample_name), 'BENIGNFAT') THEN 'Benignfat' ELSE 'Other' END AS grp FROM samples""")  # fmt: skip
def flt05(b):
    return b.samples.select("sample_name", R.sample_group(F.col("sample_name")).alias("grp"))


_ACCEPTED = "coalesce(rt IS NOT NULL AND area > 0 AND confidence <> 'VERY_LOW' AND (CASE WHEN nl = 'NO_MS2' THEN FALSE WHEN nl = 'NL_FAIL' THEN FALSE ELSE nl IN ('', 'OK') OR starts_with(nl, 'WARN_') END), FALSE)"


@query("flt07_accepted_detection", f"SELECT sample, label, {_ACCEPTED} AS accepted FROM results")
def flt07(b):
    return b.results.select("sample", "label", R.accepted_detection(F.col("rt"), F.col("area"), F.col("confidence"), F.col("nl")).alias("accepted"))


@query("flt08_loss_status", """
WITH m AS (SELECT sample, scan_number, count(*) FILTER (WHERE abs(precursor_mz - mz - 116.0474e0) < 1) AS matched,
  min(abs(precursor_mz - mz - 116.0474e0) / 116.0474e0 * 1e6) FILTER (WHERE abs(precursor_mz - mz - 116.0474e0) < 1) AS best FROM products GROUP BY ALL)
SELECT sample, scan_number, CASE WHEN matched = 0 THEN 'NO_MS2' WHEN best IS NULL OR best > 20 THEN 'NL_FAIL' WHEN best > 10 THEN 'WARN' ELSE 'OK' END AS status FROM m""")  # fmt: skip
def flt08(b):
    gap = F.abs(F.col("precursor_mz") - F.col("mz") - 116.0474)
    by_scan = b.products.groupBy("sample", "scan_number").agg(F.count_if(gap < 1).alias("matched"), F.min(F.when(gap < 1, gap / 116.0474 * 1e6)).alias("best"))
    return by_scan.select("sample", "scan_number", R.loss_status(F.col("matched"), F.col("best"), 10.0, 20.0).alias("status"))


_QUALITY = """q AS (
SELECT *, area > 0 AS valid, height IS NOT NULL AND apex_rt IS NOT NULL AS complete, coalesce(abs(rt_delta_sec) > 60, TRUE) AS far FROM cells
), c AS (
SELECT family_id, sample, status, area AS raw_area, CASE WHEN status = 'detected' AND valid THEN 'detected_quantifiable' WHEN status = 'detected' OR status = 'rescued' AND coalesce(valid, FALSE) = FALSE THEN 'invalid'
  WHEN status = 'rescued' AND (NOT complete OR far) THEN 'review_rescue' WHEN status = 'rescued' THEN 'rescue_quantifiable' WHEN status = 'duplicate_assigned' THEN 'duplicate_loser'
  WHEN status = 'ambiguous_ms1_owner' THEN 'ambiguous_owner' WHEN status IN ('absent', 'unchecked') THEN 'blank' ELSE 'invalid' END AS quality,
  CASE WHEN status = 'detected' AND valid THEN '' WHEN status = 'detected' OR status = 'rescued' AND coalesce(valid, FALSE) = FALSE THEN 'invalid_area' WHEN status = 'rescued' AND NOT complete THEN 'incomplete_peak'
  WHEN status = 'rescued' AND far THEN 'rt_outside_max' WHEN status = 'rescued' THEN '' WHEN status = 'duplicate_assigned' THEN 'duplicate_loser' WHEN status IN ('ambiguous_ms1_owner', 'absent', 'unchecked') THEN status
  ELSE 'unsupported_status:' || status END AS reason,
  CASE WHEN status = 'detected' AND valid OR status = 'rescued' AND valid AND complete AND NOT far THEN area END AS area FROM q
)"""


def quality_cells(b):
    quality, area, reason = R.cell_quality(60.0)
    return b.cells.select("family_id", "sample", "status", quality.alias("quality"), area.alias("area"), reason.alias("reason"))


@query("flt09_cell_quality", f"WITH {_QUALITY} SELECT family_id, sample, status, quality, area, reason FROM c")
def flt09(b):
    return quality_cells(b)


@query("flt10_production_cells", f"""
WITH {_QUALITY}, j AS (SELECT c.*, has_anchor AS inc FROM c JOIN families USING (family_id))
SELECT family_id, sample, CASE WHEN quality = 'detected_quantifiable' AND inc THEN 'detected' WHEN quality = 'rescue_quantifiable' AND inc THEN 'accepted_rescue'
  WHEN quality IN ('rescue_quantifiable', 'review_rescue') THEN 'review_rescue' WHEN quality = 'invalid' AND status = 'rescued' THEN 'rejected_rescue' ELSE 'blank' END AS production,
  CASE WHEN quality IN ('detected_quantifiable', 'rescue_quantifiable') AND inc THEN area END AS value,
  CASE WHEN quality IN ('detected_quantifiable', 'rescue_quantifiable') THEN CASE WHEN inc THEN '' ELSE 'missing_row_identity_support' END ELSE reason END AS blank_reason FROM j""")  # fmt: skip
def flt10(b):
    cells = quality_cells(b).join(b.families.select("family_id", "has_anchor"), "family_id")
    production, value, blank = R.production_decision(F.col("quality"), F.col("reason"), F.col("status"), F.col("area"), F.col("has_anchor"))
    return cells.select("family_id", "sample", production.alias("production"), value.alias("value"), blank.alias("blank_reason"))


_COUNTS = f"""{_QUALITY}, n AS (
SELECT family_id, count(*) FILTER (WHERE quality = 'detected_quantifiable') AS detected, count(*) FILTER (WHERE quality = 'rescue_quantifiable') AS rescued,
  count(*) FILTER (WHERE quality = 'duplicate_loser') AS duplicates, count(*) FILTER (WHERE quality = 'ambiguous_owner') AS ambiguous, count(*) AS cell_count FROM c GROUP BY family_id
), f AS (
SELECT n.*, evidence, tag, CASE WHEN evidence = 'single_sample_local_owner' THEN evidence WHEN starts_with(evidence, 'owner_complete_link') THEN 'owner_complete_link' WHEN starts_with(evidence, 'owner_identity') THEN 'owner_identity'
  WHEN starts_with(evidence, 'cid_nl_only') THEN 'cid_nl_only' WHEN detected >= 2 THEN 'multi_sample_detected' WHEN detected = 1 AND has_anchor THEN 'anchored_family' WHEN evidence <> '' THEN evidence ELSE 'none' END AS primary_evidence
FROM n JOIN families USING (family_id)
)"""


def family_counts(b):
    is_ = lambda k: F.count_if(F.col("quality") == k)
    counts = quality_cells(b).groupBy("family_id").agg(
        is_("detected_quantifiable").alias("detected"), is_("rescue_quantifiable").alias("rescued"), is_("duplicate_loser").alias("duplicates"), is_("ambiguous_owner").alias("ambiguous"), F.count("*").alias("cell_count")
    )
    joined = counts.join(b.families.select("family_id", "evidence", "has_anchor", "tag"), "family_id")
    return joined.withColumn("primary_evidence", R.primary_evidence(F.col("evidence"), F.col("detected"), F.col("has_anchor")))


# Cells that aren't quantifiable don't count here, so that some families rest on rescued cells; families without an anchor have weak seeds.
@query("flt11_family_flags", f"""
WITH {_COUNTS}, g AS (
  SELECT f.*, CASE WHEN evidence = 'folded' THEN 'folded;primary_family_consolidation_loser;winner=F0' ELSE evidence END AS ev, rescued / CAST(detected + rescued AS DOUBLE) AS share, tag <> 'tag0' AND detected > 0 AS open, has_anchor
  FROM f JOIN (SELECT family_id, has_anchor FROM families) x USING (family_id)
), h AS (
  SELECT *, CASE WHEN open AND detected <= 2 AND share >= 0.70 THEN 'extreme' WHEN open AND detected <= 3 AND share >= 0.60 THEN CASE WHEN has_anchor THEN 'tolerated' ELSE 'weak' END END AS rests FROM g
)
SELECT family_id, primary_evidence, concat_ws(';', CASE WHEN primary_evidence = 'single_sample_local_owner' THEN 'single_sample_local_owner' END, CASE WHEN detected = 1 THEN 'single_detected_seed' END,
  CASE WHEN contains(ev, 'primary_family_consolidation_loser') THEN 'family_consolidation_loser' END,
  CASE WHEN primary_evidence = 'anchored_family' AND detected = 1 THEN 'anchored_single_detected' END, CASE WHEN rescued > detected AND detected > 0 THEN 'rescue_heavy' END,
  CASE WHEN rests = 'extreme' THEN 'high_backfill_dependency' END, CASE WHEN rests = 'weak' THEN 'weak_seed_backfill_dependency' END, CASE WHEN rests = 'tolerated' THEN 'weak_seed_tolerated' END,
  CASE WHEN detected = 0 AND rescued > 0 THEN 'rescue_only' END,
  CASE WHEN duplicates > 0 THEN 'duplicate_claim_pressure' END, CASE WHEN detected = 0 AND duplicates > 0 AND rescued = 0 THEN 'duplicate_only' END, CASE WHEN ambiguous > 0 THEN 'ambiguous_ms1_owner_pressure' END,
  CASE WHEN detected = 0 AND ambiguous > 0 AND rescued = 0 THEN 'ambiguous_only' END, CASE WHEN detected = 0 AND rescued = 0 AND duplicates = 0 THEN 'zero_present' END) AS flags FROM h""")  # fmt: skip
def flt11(b):
    evidence = F.when(F.col("evidence") == "folded", "folded;primary_family_consolidation_loser;winner=F0").otherwise(F.col("evidence"))
    rests = R.backfill_dependency(F.col("tag") != "tag0", F.col("detected"), F.col("rescued"), F.col("detected") + F.col("rescued"), ~F.col("has_anchor"), F.lit(True))
    rows = family_counts(b).withColumns({"evidence": evidence, "dependency": rests})
    return rows.select("family_id", "primary_evidence", F.array_join(R.row_flags(), ";").alias("flags"))


@query("flt13_backfill_dependency", f"""
WITH {_COUNTS} SELECT family_id, detected, rescued, CASE WHEN tag <> 'tag1' OR detected = 0 OR cell_count = 0 THEN NULL WHEN detected <= 2 AND CAST(rescued AS DOUBLE) / cell_count >= 0.70 THEN 'extreme_backfill_dependency'
  WHEN detected <= 3 AND CAST(rescued AS DOUBLE) / cell_count >= 0.60 THEN 'weak_seed_backfill_dependency' END AS dependency FROM f""")  # fmt: skip
def flt13(b):
    share = F.col("rescued") / F.col("cell_count")
    open_ = (F.col("tag") == "tag1") & (F.col("detected") > 0)
    kind = F.when(open_ & (F.col("detected") <= 2) & (share >= 0.70), "extreme_backfill_dependency").when(open_ & (F.col("detected") <= 3) & (share >= 0.60), "weak_seed_backfill_dependency")
    return family_counts(b).select("family_id", "detected", "rescued", kind.alias("dependency"))


@query("flt15_candidate_state", """
WITH k AS (SELECT *, coalesce(abs(ms1_seed_delta_min) <= 0.1 + 1e-9, FALSE) AS near FROM candidates)
SELECT candidate_id, CASE WHEN NOT ms1_peak_found THEN 'review_only_orphan_nl' WHEN mz_basis IN ('product_plus_neutral_loss', 'mixed') THEN 'ms1_feature_nl_rescued' ELSE 'ms1_feature_nl_supported' END AS state,
  CASE WHEN seed_event_count >= 2 AND ms1_peak_found AND near THEN 'HIGH' WHEN ms1_peak_found THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN NOT ms1_peak_found THEN 'strict MS2 NL seed; MS1 peak missing' WHEN seed_event_count >= 2 AND near THEN 'strong MS2 NL seed group; MS1 peak found near seed RT'
    WHEN seed_event_count >= 2 AND ms1_seed_delta_min IS NOT NULL THEN 'MS1 peak offset from seed RT' ELSE 'single MS2 NL seed; MS1 peak found' END AS reason FROM k""")  # fmt: skip
def flt15(b):
    found, events, delta = F.col("ms1_peak_found"), F.col("seed_event_count"), F.col("ms1_seed_delta_min")
    priority, reason = R.review_priority(events, found, delta, 0.1)
    return b.candidates.select("candidate_id", R.candidate_state(found, F.col("mz_basis")).alias("state"), priority.alias("priority"), reason.alias("reason"))


@query("flt16_discovery_evidence", """
WITH k AS (SELECT *, abs(ms1_seed_delta_min) AS d, CASE WHEN scan_support IS NOT NULL THEN scan_support >= 0.8 ELSE upper(trace_quality) IN ('GOOD', 'CLEAN') END AS high,
  CASE WHEN scan_support IS NOT NULL THEN scan_support <= 0.2 ELSE upper(trace_quality) IN ('POOR', 'MISSING') END AS low FROM candidates),
s AS (SELECT *, CAST(least(100, greatest(0, CASE WHEN ms1_peak_found THEN 25 ELSE 5 END + least(25, seed_event_count * 8) + CASE WHEN d <= 0.05 THEN 15 WHEN d <= 0.2 THEN 10 WHEN d <= 0.4 THEN 5 ELSE 0 END
  + CASE WHEN product_max_intensity >= 100000 THEN 10 WHEN product_max_intensity >= 10000 THEN 5 ELSE 0 END + CASE WHEN ms1_area >= 1000000 THEN 10 WHEN ms1_area >= 100000 THEN 5 ELSE 0 END
  + CASE WHEN high AND (scan_support IS NOT NULL OR ms1_peak_found) THEN 5 WHEN ms1_peak_found AND low THEN -10 ELSE 0 END)) AS INT) AS score FROM k)
SELECT candidate_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'E' END AS tier,
  CASE WHEN seed_event_count >= 3 OR seed_event_count >= 2 AND product_max_intensity >= 10000 OR product_max_intensity >= 100000 THEN 'strong' WHEN seed_event_count >= 2 OR product_max_intensity >= 10000 THEN 'moderate' ELSE 'weak' END AS ms2_support,
  CASE WHEN NOT ms1_peak_found OR ms1_area IS NULL THEN 'missing' WHEN ms1_area >= 10000000 AND high THEN 'strong' WHEN ms1_area >= 1000000 OR high AND NOT low THEN 'moderate' ELSE 'weak' END AS ms1_support,
  CASE WHEN d IS NULL THEN 'missing' WHEN d <= 0.05 THEN 'aligned' WHEN d <= 0.2 THEN 'near' ELSE 'shifted' END AS rt_alignment FROM s""")  # fmt: skip
def flt16(b):
    return b.candidates.select("candidate_id", *[c.alias(n) for n, c in R.discovery_evidence().items()])


@query("flt17_capped_score", """
WITH k AS (SELECT sample, label, 50 + CASE WHEN nl = 'OK' THEN 20 ELSE 0 END + CASE WHEN area > 50000 THEN 15 ELSE 0 END - CASE WHEN nl = 'NL_FAIL' THEN 30 ELSE 0 END - CASE WHEN rt IS NULL THEN 25 ELSE 0 END AS raw, flags LIKE '%too_broad%' AS cap FROM results),
r AS (SELECT *, CASE WHEN raw >= 80 THEN 1 WHEN raw >= 60 THEN 2 WHEN raw >= 40 THEN 3 ELSE 4 END AS rank FROM k)
SELECT sample, label, raw AS raw_score, ['HIGH', 'MEDIUM', 'LOW', 'VERY_LOW'][rank] AS score_confidence, ['HIGH', 'MEDIUM', 'LOW', 'VERY_LOW'][CASE WHEN cap THEN greatest(rank, 3) ELSE rank END] AS confidence FROM r""")  # fmt: skip
def flt17(b):
    signal = lambda c, label, points: F.when(c, F.struct(F.lit(label).alias("label"), F.lit(points).alias("points")))
    positive = F.array_compact(F.array(signal(F.col("nl") == "OK", "nl_match", 20), signal(F.col("area") > 50000, "large_area", 15)))
    negative = F.array_compact(F.array(signal(F.col("nl") == "NL_FAIL", "nl_fail", 30), signal(F.col("rt").isNull(), "no_rt", 25)))
    caps = F.array_compact(F.array(F.when(F.col("flags").contains("too_broad"), F.lit("LOW"))))
    return b.results.select("sample", "label", *[c.alias(n) for n, c in R.capped_score(positive, negative, caps).items()])


@query("flt18_severities", """
WITH k AS (SELECT r.sample, r.label, r.rt, fwhm, t.rt_min, t.rt_max, nl, rt_min + 1e0 AS prior FROM results r JOIN targets t USING (label)),
s AS (SELECT sample, label, CASE WHEN fwhm * 5 < 0.3 OR fwhm * 5 > 3 THEN 2 WHEN fwhm * 5 < 0.5 OR fwhm * 5 > 2 THEN 1 ELSE 0 END AS symmetry,
  CASE WHEN nl IN ('OK') THEN 0 WHEN nl IN ('NO_MS2', '') THEN 1 ELSE 2 END AS nl_support,
  CASE WHEN rt IS NULL THEN 2 WHEN abs(rt - prior) >= 1 - 1e-12 THEN 2 WHEN abs(rt - prior) >= 0.2 - 1e-12 THEN 1 ELSE 0 END AS rt_prior,
  CASE WHEN rt IS NULL THEN 2 WHEN least(rt - rt_min, rt_max - rt) / (rt_max - rt_min) < 0.01 THEN 2 WHEN least(rt - rt_min, rt_max - rt) / (rt_max - rt_min) < 0.1 THEN 1 ELSE 0 END AS centrality,
  CASE WHEN fwhm / 0.25e0 < 0.3 OR fwhm / 0.25e0 > 3 THEN 2 WHEN fwhm / 0.25e0 < 0.5 OR fwhm / 0.25e0 > 2 THEN 1 ELSE 0 END AS width FROM k)
SELECT *, CASE WHEN symmetry + nl_support + rt_prior + centrality + width = 0 THEN 'HIGH' WHEN symmetry + nl_support + rt_prior + centrality + width <= 2 THEN 'MEDIUM' WHEN symmetry + nl_support + rt_prior + centrality + width <= 4 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence FROM s""")  # fmt: skip
def flt18(b):
    rows = b.results.join(b.targets.select("label", "rt_min", "rt_max"), "label")
    rt = F.col("rt")
    graded = rows.select(
        "sample", "label", R.symmetry_severity(F.col("fwhm") * 5).alias("symmetry"), R.loss_severity(~F.col("nl").isin("NO_MS2", ""), F.col("nl") == "OK").alias("nl_support"),
        R.prior_severity(rt, F.col("rt_min") + 1.0, F.lit(None).cast("double")).alias("rt_prior"), R.centrality_severity(rt, F.col("rt_min"), F.col("rt_max")).alias("centrality"),
        R.width_severity(F.col("fwhm") / 0.25).alias("width"),
    )
    return graded.withColumn("confidence", R.total_confidence(sum((F.col(c) for c in ("nl_support", "rt_prior", "centrality", "width")), F.col("symmetry"))))


@query("flt19_quality_penalties", """
WITH k AS (SELECT sample, label, list_filter(string_split(flags, ';'), lambda x: x <> '') AS f FROM results),
n AS (SELECT *, len(list_filter(f, lambda x: x IN ('low_scan_support', 'low_trace_continuity', 'poor_edge_recovery'))) AS soft FROM k)
SELECT sample, label, CAST(least(2, len(f) - soft) AS INT) AS hard_penalty, least(0.5, soft * 0.25) :: DOUBLE AS soft_penalty, list_contains(f, 'low_scan_support') OR soft >= 2 AS caps FROM n""")  # fmt: skip
def flt19(b):
    names = F.filter(F.split("flags", ";"), lambda x: x != "")
    return b.results.select("sample", "label", *[c.alias(n) for n, c in R.quality_penalties(names).items()])


_MEDIANS = """m AS (SELECT compound, CASE WHEN count(*) >= 3 THEN median(apex_rt) END AS median_rt, CASE WHEN count(*) >= 3 THEN median(area) END AS median_area, CASE WHEN count(*) >= 3 THEN median(width) END AS median_width
FROM trends WHERE status = 'detected' AND apex_rt IS NOT NULL AND area IS NOT NULL AND width IS NOT NULL GROUP BY compound)"""


def compound_medians(b):
    """Median RT, area and width of each compound's detected rows, null where there are fewer than three."""
    rows = b.trends.where("status = 'detected' AND apex_rt IS NOT NULL AND area IS NOT NULL AND width IS NOT NULL")
    return rows.groupBy("compound").agg(*[F.when(F.count("*") >= 3, F.percentile(c, 0.5)).alias(f"median_{n}") for c, n in (("apex_rt", "rt"), ("area", "area"), ("width", "width"))])


@query("agg09_compound_medians", f"WITH {_MEDIANS} SELECT compound, round(median_rt, 6) AS median_rt, round(median_area, 4) AS median_area, round(median_width, 6) AS median_width FROM m")
def agg09(b):
    return compound_medians(b).select("compound", F.round("median_rt", 6).alias("median_rt"), F.round("median_area", 4).alias("median_area"), F.round("median_width", 6).alias("median_width"))


@query("flt29_trend_review", f"""
WITH {_MEDIANS}, k AS (SELECT t.*, median_rt, apex_rt - median_rt AS d, CASE WHEN median_area > 0 AND area > 0 THEN log2(area / median_area) END AS a, CASE WHEN median_width > 0 THEN width / median_width END AS w,
  abs(rt_delta_to_reference) > 0.5 AS pr, width_ratio_to_reference < 0.5 OR width_ratio_to_reference > 1.75 AS pw FROM trends t LEFT JOIN m USING (compound))
SELECT sample_name, compound, concat_ws(';', CASE WHEN pr THEN 'PRIOR_RT_SHIFT' END, CASE WHEN pw THEN 'PRIOR_WIDTH_SHIFT' END) AS prior_flags,
  concat_ws(';', CASE WHEN abs(d) > 0.2 THEN 'BATCH_RT_OUTLIER' END, CASE WHEN a < -1 THEN 'BATCH_AREA_DROP' END, CASE WHEN a > 1 THEN 'BATCH_AREA_RISE' END, CASE WHEN w < 0.6 OR w > 1.6 THEN 'BATCH_WIDTH_OUTLIER' END) AS batch_flags,
  CASE WHEN status <> 'detected' THEN 'not_detected_or_error' WHEN median_rt IS NULL THEN 'identity_evidence_insufficient' WHEN abs(d) > 0.2 AND injection_order IS NOT NULL THEN 'rt_drift_review' WHEN a < -1 OR a > 1 THEN 'sensitivity_trend_review'
    WHEN w < 0.6 OR w > 1.6 THEN 'width_definition_review' WHEN pr THEN 'prior_reference_mismatch' WHEN pw THEN 'width_definition_review' ELSE 'stable_ms1_trend' END AS bucket FROM k""")  # fmt: skip
def flt29(b):
    rows = b.trends.join(compound_medians(b), "compound", "left")
    return rows.select("sample_name", "compound", *[c.alias(n) for n, c in R.trend_review(F.lit(3)).items()])
