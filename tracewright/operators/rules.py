"""Row classifications: columns computed from a row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, finite, first_of, flags, token_key


def crop_by_rt(trace: DataFrame, low: float, high: float) -> DataFrame:
    """Points with rt between the bounds, both included; reversed bounds are swapped."""
    return trace.where(F.col("rt").between(min(low, high), max(low, high)))


def exclusion_reason(applicability: Column, sample: Column) -> Column:
    """Null where a target applies to a sample, else why it doesn't."""
    return _reason(applicability, holds_rna(sample))


def holds_rna(sample: Column) -> Column:
    return token_key(sample).contains("rna")


def _reason(applicability: Column, rna: Column) -> Column:
    kind = F.when(F.coalesce(applicability, F.lit("")) == "", "all").otherwise(applicability)
    fits = (kind == "all") | ((kind == "rna_containing") & rna)
    return F.when(~fits, F.concat(F.lit("target_sample_applicability:"), kind))


def applicability(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_name, label, reason) of all pairs, see exclusion_reason().

    Names are judged before they are paired, and targets are dealt over the session's cores, however few files hold them.
    """
    judged = samples.select("sample_name", holds_rna(F.col("sample_name")).alias("_rna"))
    dealt = targets.select("label", "sample_applicability").repartition(4 * targets.sparkSession.sparkContext.defaultParallelism)
    return dealt.crossJoin(F.broadcast(judged)).select("sample_name", "label", _reason(F.col("sample_applicability"), F.col("_rna")).alias("reason"))


def sample_group(name: Column) -> Column:
    """QC where the name has QC as a token of its own, perhaps numbered; else by the name's start."""
    up = F.upper(name)
    return first_of(
        (name.rlike(r"(?i)(^|[^A-Za-z0-9])QC([\s_-]*\d+)?($|[^A-Za-z0-9])"), "QC"), (up.startswith("TUMOR"), "Tumor"), (up.startswith("NORMAL"), "Normal"), (up.startswith("BENIGNFAT"), "Benignfat"),
        otherwise="Other",
    )


def accepted_detection(rt: Column, area: Column, confidence: Column, nl: Column, count_no_ms2: bool = False) -> Column:
    """Whether a result counts as a detection."""
    token = F.coalesce(nl, F.lit(""))
    loss = first_of((token == "NO_MS2", count_no_ms2), (token == "NL_FAIL", False), otherwise=token.isin("", "OK") | token.startswith("WARN_"))
    return F.coalesce(rt.isNotNull() & (area > 0) & (confidence != "VERY_LOW") & loss, F.lit(False))


def loss_status(matched: Column, best_ppm: Column, warn: float, most: float) -> Column:
    """Neutral-loss status from the number of matching scans and their best error."""
    return first_of((matched == 0, "NO_MS2"), (best_ppm.isNull() | (best_ppm > most), "NL_FAIL"), (best_ppm > warn, "WARN"), otherwise="OK")


def cell_quality(max_rt_sec: float) -> tuple[Column, Column, Column]:
    """(quality, area, reason) of an aligned cell."""
    status, area = F.col("status"), F.col("area")
    valid = finite(area) & (area > 0)
    complete = finite(F.col("apex_rt")) & finite(F.col("height")) & finite(F.col("start_rt")) & finite(F.col("end_rt"))
    far = F.coalesce(F.abs("rt_delta_sec") > max_rt_sec, F.lit(True))
    detected, rescued = status == "detected", status == "rescued"
    rules = [
        (detected & valid, "detected_quantifiable", ""), (detected, "invalid", "invalid_area"), (rescued & ~valid, "invalid", "invalid_area"),
        (rescued & ~complete, "review_rescue", "incomplete_peak"), (rescued & far, "review_rescue", "rt_outside_max"), (rescued, "rescue_quantifiable", ""),
        (status == "duplicate_assigned", "duplicate_loser", "duplicate_loser"), (status == "ambiguous_ms1_owner", "ambiguous_owner", "ambiguous_ms1_owner"),
        (status == "absent", "blank", "absent"), (status == "unchecked", "blank", "unchecked"),
    ]
    quality = first_of(*[(c, q) for c, q, _ in rules], otherwise="invalid")
    reason = first_of(*[(c, r) for c, _, r in rules], otherwise=F.concat(F.lit("unsupported_status:"), status))
    return quality, F.when((detected & valid) | (rescued & valid & complete & ~far), area), reason


def production_decision(quality: Column, reason: Column, status: Column, area: Column, include: Column) -> tuple[Column, Column, Column]:
    """(production status, value, blank reason) of a cell of known quality in a family that is, or isn't, in the primary matrix."""
    detected, rescue = quality == "detected_quantifiable", quality == "rescue_quantifiable"
    written = (detected | rescue) & include
    production = first_of(
        (detected & include, "detected"), (rescue & include, "accepted_rescue"), (rescue | (quality == "review_rescue"), "review_rescue"),
        ((quality == "invalid") & (status == "rescued"), "rejected_rescue"), otherwise="blank",
    )
    blank = first_of((written, ""), (detected | rescue, "missing_row_identity_support"), otherwise=reason)
    return production, F.when(written, area), blank


def candidate_state(found: Column, basis: Column) -> Column:
    rescued = basis.isin("product_plus_neutral_loss", "mixed")
    return first_of((~found, "review_only_orphan_nl"), (rescued, "ms1_feature_nl_rescued"), otherwise="ms1_feature_nl_supported")


def review_priority(events: Column, found: Column, delta: Column, padding: float) -> tuple[Column, Column]:
    """(priority, reason) of a discovery candidate."""
    near = F.coalesce(F.abs(delta) <= padding + 1e-9, F.lit(False))
    several = events >= 2
    priority = first_of((several & found & near, "HIGH"), (found, "MEDIUM"), otherwise="LOW")
    reason = first_of(
        (~found, "strict MS2 NL seed; MS1 peak missing"), (several & near, "strong MS2 NL seed group; MS1 peak found near seed RT"),
        (several & delta.isNotNull(), "MS1 peak offset from seed RT"), otherwise="single MS2 NL seed; MS1 peak found",
    )
    return priority, reason


#: Weights and thresholds of the discovery score (fixed values).
DISCOVERY = {
    "ms1_peak_present": 25, "ms1_peak_absent": 5, "seed_event_per": 8, "seed_event_max": 25, "rt_aligned": 15, "rt_near": 10, "rt_shifted": 5,
    "product_high": 10, "product_medium": 5, "area_high": 10, "area_medium": 5, "scan_high": 5, "scan_low": -10,
    "rt_aligned_max": 0.05, "rt_near_max": 0.20, "rt_shifted_max": 0.40, "product_high_min": 100_000.0, "product_medium_min": 10_000.0,
    "area_high_min": 1_000_000.0, "area_medium_min": 100_000.0, "strong_area_min": 10_000_000.0, "moderate_area_min": 1_000_000.0, "scan_high_min": 0.8, "scan_low_max": 0.2,
}


def discovery_evidence(p: dict = DISCOVERY) -> dict[str, Column]:
    """score, tier and the support classes of discovery candidates; profiles replace values of p."""
    found, events, delta = F.col("ms1_peak_found"), F.col("seed_event_count"), F.abs("ms1_seed_delta_min")
    product, area, support, quality = F.col("product_max_intensity"), F.col("ms1_area"), F.col("scan_support"), F.upper("trace_quality")
    # Without a support score the named trace quality speaks.
    high = F.when(support.isNotNull(), support >= p["scan_high_min"]).otherwise(quality.isin("GOOD", "CLEAN"))
    low = F.when(support.isNotNull(), support <= p["scan_low_max"]).otherwise(quality.isin("POOR", "MISSING"))
    counts_high = high & (support.isNotNull() | found)
    parts = [
        F.when(found, p["ms1_peak_present"]).otherwise(p["ms1_peak_absent"]),
        F.least(F.lit(p["seed_event_max"]), F.greatest(F.lit(0), events) * p["seed_event_per"]),
        first_of((delta <= p["rt_aligned_max"], p["rt_aligned"]), (delta <= p["rt_near_max"], p["rt_near"]), (delta <= p["rt_shifted_max"], p["rt_shifted"]), otherwise=0),
        first_of((product >= p["product_high_min"], p["product_high"]), (product >= p["product_medium_min"], p["product_medium"]), otherwise=0),
        first_of((area >= p["area_high_min"], p["area_high"]), (area >= p["area_medium_min"], p["area_medium"]), otherwise=0),
        first_of((counts_high, p["scan_high"]), (found & low, p["scan_low"]), otherwise=0),
    ]
    total = clamp(sum(parts[1:], parts[0]), 0, 100)
    medium = product >= p["product_medium_min"]
    strong = product >= p["product_high_min"]
    ms2 = first_of(((events >= 3) | ((events >= 2) & medium) | strong, "strong"), ((events >= 2) | medium, "moderate"), otherwise="weak")
    ms1 = first_of(
        (~found | area.isNull(), "missing"), ((area >= p["strong_area_min"]) & high, "strong"), ((area >= p["moderate_area_min"]) | (high & ~low), "moderate"), otherwise="weak"
    )
    aligned = first_of((delta.isNull(), "missing"), (delta <= p["rt_aligned_max"], "aligned"), (delta <= p["rt_near_max"], "near"), otherwise="shifted")
    tier = first_of((total >= 80, "A"), (total >= 60, "B"), (total >= 40, "C"), (total >= 20, "D"), otherwise="E")
    return {"score": total.cast("int"), "tier": tier, "ms2_support": ms2, "ms1_support": ms1, "rt_alignment": aligned}


CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "VERY_LOW")


def confidence_of(score: Column) -> Column:
    return first_of((score >= 80, "HIGH"), (score >= 60, "MEDIUM"), (score >= 40, "LOW"), otherwise="VERY_LOW")


def capped_score(positive: Column, negative: Column, caps: Column, base: int = 50) -> dict[str, Column]:
    """Score and confidences from arrays of (label, points) and of the lowest confidences that caps allow; the worst cap wins."""
    points = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + s["points"])
    raw = F.lit(base) + points(positive) - points(negative)
    own = confidence_of(raw)
    rank = lambda c: F.array_position(F.array(*map(F.lit, CONFIDENCES)), c)
    worst = F.array_max(F.concat(F.array(rank(own)), F.transform(caps, rank)))
    return {"raw_score": raw, "score_confidence": own, "confidence": F.get(F.array(*map(F.lit, CONFIDENCES)), (worst - 1).cast("int"))}


def graded(x: Column, hard: Column, soft: Column) -> Column:
    """2 for hard, 1 for soft, else 0."""
    return first_of((hard, 2), (soft, 1), otherwise=0)


def symmetry_severity(ratio: Column) -> Column:
    return graded(ratio, ~finite(ratio) | (ratio < 0.3) | (ratio > 3.0), (ratio < 0.5) | (ratio > 2.0))


def noise_severity(ratio: Column, dirty: bool = False) -> Column:
    hard, soft = (1.3, 2.0) if dirty else (2.0, 3.0)
    return graded(ratio, ratio < hard, ratio < soft)


def loss_severity(ms2: Column, match: Column) -> Column:
    return first_of((ms2 & match, 0), (ms2, 2), otherwise=1)


def prior_severity(observed: Column, prior: Column, sigma: Column) -> Column:
    """By standard deviations where they are known, else by minutes."""
    reached = lambda x, at: x >= at - 1e-12
    off = F.abs(observed - prior)
    by_sigma = graded(off, reached(off / sigma, 5.0), reached(off / sigma, 2.0))
    by_minutes = graded(off, reached(off, 1.0), reached(off, 0.2))
    return first_of((prior.isNull(), 0), (~finite(observed) | ~finite(prior), 2), (finite(sigma) & (sigma > 0), by_sigma), otherwise=by_minutes)


def centrality_severity(observed: Column, low: Column, high: Column) -> Column:
    edge = F.least(observed - low, high - observed) / (high - low)
    return first_of((~finite(observed) | (high - low <= 0), 2), (edge < 0.01, 2), (edge < 0.10, 1), otherwise=0)


def width_severity(ratio: Column) -> Column:
    return first_of((ratio.isNull(), 0), otherwise=graded(ratio, ~finite(ratio) | (ratio < 0.3) | (ratio > 3.0), (ratio < 0.5) | (ratio > 2.0)))


def local_noise_severity(usable: Column, noise: Column, ratio: Column, dirty: bool = False) -> Column:
    """0, 1 or 2 from an apex's local signal to noise: 2 where it can't be had, 0 on a trace without noise."""
    return first_of((~usable, 2), (noise <= 0, 0), otherwise=noise_severity(ratio, dirty))


def outside_window(observed: Column, low: Column, high: Column) -> Column:
    """Whether an RT lies outside its window, or any of the three isn't a finite number."""
    return ~(finite(observed) & finite(low) & finite(high)) | F.coalesce((observed < low) | (observed > high), F.lit(True))


def total_confidence(total: Column) -> Column:
    return first_of((total == 0, "HIGH"), (total <= 2, "MEDIUM"), (total <= 4, "LOW"), otherwise="VERY_LOW")


#: Flags that lower a candidate's rank only softly, and the older names that they stand for (fixed values).
SOFT_FLAGS = ("low_scan_support", "low_trace_continuity", "poor_edge_recovery")
SUPERSEDED = {"low_scan_support": "low_scan_count", "poor_edge_recovery": "low_top_edge_ratio"}


def quality_penalties(names: Column) -> dict[str, Column]:
    """Hard penalty (at most 2), soft selection penalty (0.25 each, at most 0.5) and whether a trace flag caps the confidence."""
    own = F.array_distinct(names)
    soft = F.size(F.filter(own, lambda x: x.isin(*SOFT_FLAGS)))
    old = F.array_compact(F.array(*[F.when(F.array_contains(own, new), F.lit(was)) for new, was in SUPERSEDED.items()]))
    hard = F.size(F.filter(own, lambda x: ~x.isin(*SOFT_FLAGS) & ~F.array_contains(old, x)))
    return {"hard_penalty": F.least(F.lit(2), hard), "soft_penalty": F.least(F.lit(0.5), soft * 0.25), "caps": F.array_contains(own, "low_scan_support") | (soft >= 2)}


def trend_review(median_count: Column) -> dict[str, Column]:
    """Flags and review bucket of a standard's row from its batch medians (null medians: too few rows)."""
    rt, width = F.col("apex_rt") - F.col("median_rt"), F.when(F.col("median_width") > 0, F.col("width") / F.col("median_width"))
    area = F.when((F.col("median_area") > 0) & (F.col("area") > 0), F.log2(F.col("area") / F.col("median_area")))
    prior_rt, prior_width = F.abs("rt_delta_to_reference") > 0.50, (F.col("width_ratio_to_reference") < 0.50) | (F.col("width_ratio_to_reference") > 1.75)
    moved, dropped, rose, wide = F.abs(rt) > 0.20, area < -1.0, area > 1.0, (width < 0.60) | (width > 1.60)
    bucket = first_of(
        (F.col("status") != "detected", "not_detected_or_error"), (F.col("median_rt").isNull(), "identity_evidence_insufficient"), (moved & F.col("injection_order").isNotNull(), "rt_drift_review"),
        (dropped | rose, "sensitivity_trend_review"), (wide, "width_definition_review"), (prior_rt, "prior_reference_mismatch"), (prior_width, "width_definition_review"), otherwise="stable_ms1_trend",
    )
    return {
        "prior_flags": F.array_join(flags((prior_rt, "PRIOR_RT_SHIFT"), (prior_width, "PRIOR_WIDTH_SHIFT")), ";"),
        "batch_flags": F.array_join(flags((moved, "BATCH_RT_OUTLIER"), (dropped, "BATCH_AREA_DROP"), (rose, "BATCH_AREA_RISE"), (wide, "BATCH_WIDTH_OUTLIER")), ";"),
        "bucket": bucket,
    }


def backfill_dependency(applies: Column, detected: Column, rescued: Column, cells: Column, weak: Column, signal: Column) -> Column:
    """How far a family rests on backfill: extreme (at most 2 detected cells, 70 % of its cells rescued), or weak_seed (3 and 60 %) if its seeds are
    weak, tolerated if they only show signs of it; else null. applies: whether the family's tag asks for the check."""
    share = rescued / cells
    asked = applies & (detected > 0) & (cells > 0)
    few = asked & (detected <= 3) & (share >= 0.60)
    return first_of(
        (asked & (detected <= 2) & (share >= 0.70), "extreme_backfill_dependency"), (few & F.coalesce(weak, F.lit(False)), "weak_seed_backfill_dependency"), (few & F.coalesce(signal, F.lit(False)), "weak_seed_tolerated")
    )


def row_flags() -> Column:
    """Names of what is notable in a family's counts, in the order of the contract (evidence, detected, rescued, duplicates, ambiguous,
    primary_evidence, dependency)."""
    q, r, d, a, kind, rests = (F.col(c) for c in ("detected", "rescued", "duplicates", "ambiguous", "primary_evidence", "dependency"))
    loser = F.col("evidence").contains("primary_family_consolidation_loser") | F.col("evidence").contains("pre_backfill_identity_consolidation_loser")
    return flags(
        (kind == "single_sample_local_owner", "single_sample_local_owner"), (q == 1, "single_detected_seed"), (loser, "family_consolidation_loser"), ((kind == "anchored_family") & (q == 1), "anchored_single_detected"),
        ((r > q) & (q > 0), "rescue_heavy"), (rests == "extreme_backfill_dependency", "high_backfill_dependency"), (rests == "weak_seed_backfill_dependency", "weak_seed_backfill_dependency"),
        (rests == "weak_seed_tolerated", "weak_seed_tolerated"), ((q == 0) & (r > 0), "rescue_only"), (d > 0, "duplicate_claim_pressure"), ((q == 0) & (d > 0) & (r == 0), "duplicate_only"),
        (a > 0, "ambiguous_ms1_owner_pressure"), ((q == 0) & (a > 0) & (r == 0), "ambiguous_only"), ((q == 0) & (r == 0) & (d == 0), "zero_present"),
    )


def primary_evidence(evidence: Column, detected: Column, anchored: Column) -> Column:
    starts = [(evidence.startswith(k), k) for k in ("owner_complete_link", "owner_identity", "cid_nl_only")]
    return first_of(
        (evidence == "single_sample_local_owner", "single_sample_local_owner"), *starts, (detected >= 2, "multi_sample_detected"), ((detected == 1) & anchored, "anchored_family"),
        (evidence != "", evidence), otherwise="none",
    )
