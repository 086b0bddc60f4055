"""Evidence of peaks: typed facts to decisions, one shape for evidence of three kinds, product ions, reliability, names and seed gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, first_of, flags
from ..functions.tables import written
from .joins import band_join

#: Quality flags that weigh little, concerns about the peak itself, and sources that need other evidence beside them.
SOFT_FLAGS = ("low_trace_continuity", "poor_edge_recovery")
HARD_CONCERNS = ("hard_quality_flag", "low_scan_support", "rt_centrality_poor", "shape_poor")
RT_CONCERNS = ("rt_prior_far", "rt_prior_borderline", "rt_centrality_poor", "rt_centrality_borderline")
SHAPE_CONCERNS = ("shape_poor", "shape_borderline", "noise_shape_poor", "noise_shape_borderline", "low_scan_support", "low_trace_continuity", "poor_edge_recovery", "hard_quality_flag")
CWT, SEGMENT = "centwave_cwt", "chrom_peak_segment"


def decision_semantics(
    support: Column, concerns: Column, sources: Column, quality: Column, caps: Column, ms2_present: Column, nl_match: Column, raw_score: Column, confidence: Column, reason: Column, rejection: Column, count_no_ms2: bool = False
) -> dict[str, Column]:
    """The decision on a candidate from labels of its evidence: arrays of the reasons for it, against it, for review, for not counting it, for
    excluding it and of ambiguity; the decision class; and the confidence and the reason's text that follow.

    support, concerns, sources, quality, caps: arrays of labels, not null. ms2_present, nl_match and raw_score may be null: unknown.
    """
    has = lambda labels, *names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    hard = F.size(F.array_except(quality, F.array(*[F.lit(n) for n in SOFT_FLAGS]))) > 0
    shape = has(support, "shape_clean", "cwt_same_apex_support", "chrom_peak_segment_context") | has(sources, CWT, SEGMENT)
    coherent = has(support, "local_sn_strong") & (has(support, "trace_clean") | ~hard) & shape
    local_conflict = hard | has(concerns, *HARD_CONCERNS)
    missing = F.coalesce(~ms2_present, F.lit(False)) | has(concerns, "no_ms2")
    failed = F.coalesce(~nl_match, F.lit(False)) | has(concerns, "nl_fail")
    dropout = failed & coherent & ~local_conflict & ~missing & F.coalesce(raw_score >= 0, F.lit(True))
    clean = coherent & ~local_conflict
    aligned, rt_support = has(support, "strict_nl_ok", "nl_match"), has(support, "rt_prior_close", "paired_istd_aligned", "paired_istd_rt_close")
    ratio, cwt, segment = has(support, "paired_area_ratio_plausible"), has(sources, CWT) | has(support, "cwt_same_apex_support"), has(sources, SEGMENT)
    supports = flags(
        (clean, "ms1_coherent"), (aligned, "candidate_aligned_ms2_nl"), (rt_support, "role_aware_rt_support"), (ratio, "paired_area_ratio_support"), (cwt, "cwt_boundary_morphology_context"), (segment, "chrom_peak_segment_context")
    )
    off_rt, anchor = has(caps, "rt_window_cap") | has(concerns, *RT_CONCERNS), has(caps, "anchor_mismatch_cap") | has(concerns, "anchor_mismatch")
    trace_caps = has(caps, "trace_quality_cap", "hard_quality_flag_cap")
    conflicts = flags(
        (local_conflict, "hard_local_quality_conflict"), (failed & ~dropout, "candidate_aligned_ms2_nl_conflict"), (off_rt, "targeted_rt_conflict"), (anchor, "anchor_conflict"),
        (trace_caps | has(concerns, *SHAPE_CONCERNS), "trace_morphology_conflict"), (hard, "hard_quality_flag_conflict"),
    )
    alone = F.size(supports) == 1
    base_reviews = [
        (missing | has(caps, "no_ms2_cap"), "missing_ms2_not_observed"), (dropout, "plausible_nl_dropout_review"), (off_rt, "targeted_rt_review"), (trace_caps, "trace_morphology_review"), (anchor, "paired_istd_rt_review"),
        (cwt & alone, "cwt_requires_correlated_evidence"), (segment & alone, "chrom_peak_segment_requires_correlated_evidence"),
    ]
    no_ms2, mismatch = has(caps, "no_ms2_cap") & ~F.lit(count_no_ms2), has(caps, "anchor_mismatch_cap") & ~aligned
    hard_caps = has(caps, "zero_area_cap", "hard_quality_flag_cap")
    rescued = has(caps, "nl_fail_cap") & dropout & clean & rt_support & ratio & ~hard_caps & ~no_ms2 & ~mismatch
    review_only = (F.upper(F.trim(confidence)) == "VERY_LOW") | F.lower(reason).contains("review only")
    legacy = review_only & (~has(caps, "no_ms2_cap") | F.lit(not count_no_ms2) | (F.size(F.array_except(caps, F.array(F.lit("no_ms2_cap")))) > 0))
    not_counted = flags(*[(c & ~rescued, n) for c, n in (
        (no_ms2, "missing_ms2_policy_not_counted"), (no_ms2, "missing_ms2_compatibility_cap"), (mismatch, "paired_istd_rt_mismatch_policy"), (mismatch, "paired_istd_rt_mismatch_cap"),
        (legacy & ((~no_ms2 & ~mismatch) | hard_caps), "legacy_review_only_projection"), (legacy & has(caps, "zero_area_cap"), "zero_area_compatibility_cap"),
        (legacy & has(caps, "hard_quality_flag_cap"), "hard_quality_flag_compatibility_cap"), (legacy & has(caps, "anchor_mismatch_cap"), "anchor_mismatch_compatibility_cap"),
    )])
    exclusions = flags((has(concerns, "wrong_identity", "physically_implausible"), "explicit_identity_exclusion"), (has(caps, "explicit_exclusion_cap"), "explicit_exclusion_cap"))
    ambiguities = flags((F.lower(F.concat_ws(" ", reason, rejection)).contains("ambiguous") | has(concerns, "unresolved_tie"), "ambiguous_evidence"))
    some = lambda x: F.size(x) > 0
    nothing = ~some(supports) & ~some(conflicts) & ~some(flags(*base_reviews)) & ~some(not_counted) & ~some(exclusions) & ~some(ambiguities)
    reviews = flags(*base_reviews, (nothing, "insufficient_typed_evidence"))
    decision = first_of((some(exclusions), "excluded"), (some(ambiguities), "ambiguous"), (some(not_counted), "not_counted"), (some(conflicts) | some(reviews), "review"), otherwise="accepted")
    projected = first_of((decision.isin("excluded", "not_counted", "ambiguous"), "VERY_LOW"), (some(conflicts), "LOW"), (some(reviews), "MEDIUM"), (decision == "accepted", "HIGH"), otherwise="LOW")
    details = F.concat(supports, conflicts, reviews, not_counted, exclusions, ambiguities)
    text = F.concat(F.lit("decision: "), decision, F.when(some(details), F.concat(F.lit("; evidence: "), F.array_join(details, "; "))).otherwise(""))
    return {
        "decision": decision, "support_reasons": supports, "conflict_reasons": conflicts, "review_reasons": reviews, "not_counted_reasons": not_counted, "exclusion_reasons": exclusions, "ambiguity_reasons": ambiguities,
        "projected_confidence": projected, "projected_reason": text,
    }


#: The columns of common evidence and their types.
COMMON = {
    "source": "string", "source_id": "string", "provenance": "string", "ms1_peak_found": "boolean", "ms1_apex_rt_min": "double", "ms1_area": "double", "ms1_height": "double", "rt_delta_min": "double", "trace_quality": "string",
    "scan_support_score": "double", "neutral_loss_tag": "string", "neutral_loss_error_ppm": "double", "seed_event_count": "int", "ms2_present": "boolean", "nl_match": "boolean", "confidence": "string", "evidence_score": "int", "reason": "string",
}


def common_evidence(frame: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Rows of one kind in the shape that all kinds share: unnamed columns are null, or empty where they are text."""
    empty = lambda n: F.lit("" if COMMON[n] == "string" else None).cast(COMMON[n])
    given = {"source": F.lit(source)} | columns
    return frame.select(*[(F.coalesce(given[n].cast(t), empty(n)) if n in given and t == "string" else given[n].cast(t) if n in given else empty(n)).alias(n) for n, t in COMMON.items()])


def canonical_labels() -> tuple[Column, Column]:
    """Labels that speak for and against common evidence."""
    positive = F.coalesce(finite(F.col("ms1_area")) & (F.col("ms1_area") > 0), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    support = flags((yes("ms1_peak_found"), "ms1_peak"), (positive, "positive_area"), (yes("ms2_present"), "ms2_present"), (yes("nl_match"), "nl_match"), (F.coalesce(F.col("seed_event_count") >= 2, F.lit(False)), "multi_seed"), (F.col("scan_support_score").isNotNull(), "scan_support"))
    concern = flags((no("ms1_peak_found"), "missing_ms1_peak"), (yes("ms1_peak_found") & ~positive, "non_positive_area"), (no("nl_match"), "nl_fail"), ((F.col("trace_quality") != "") & (F.col("trace_quality") != "clean"), "trace_quality_review"), (F.col("provenance").isin("rescued", "owner_backfill"), "backfill_provenance"))
    return support, concern


def product_ion_audit(peaks: DataFrame, scans: DataFrame, ions: DataFrame, expected: DataFrame, window: float = 0.2, ppm: float = 20.0, diagnostic_ppm: float = 60.0, least_ratio: float = 0.01, precursor_da: float = 1.6) -> DataFrame:
    """(peak_id, triggers, errors, matched, best_ppm, status): whether MS2 scans near a peak hold its expected product ions; if none near it does,
    all scans of its sample are asked. Peaks that ask for the same are looked up once, and ions come as one row for a scan.

    peaks: peak_id, sample, apex_rt, precursor_mz; scans: sample, scan_number, rt, precursor_mz, parse_error; ions: sample, scan_number, mz, intensity;
    expected: peak_id, product, product_mz.
    """
    sets = expected.groupBy("peak_id").agg(F.array_sort(F.collect_list(F.struct("product", "product_mz"))).alias("_products"))
    none = F.array().cast(sets.schema["_products"].dataType)
    wanted = written(peaks.select("peak_id", "sample", "apex_rt", F.col("precursor_mz").alias("want_mz")).join(sets.hint("merge"), "peak_id", "left").withColumn("_products", F.coalesce("_products", none)))
    unread = scans.where("parse_error IS NOT NULL")
    fits, inside = F.abs(F.col("precursor_mz") - F.col("want_mz")) <= precursor_da, F.abs(F.col("rt") - F.col("apex_rt")) <= window
    spectra = ions.groupBy("sample", "scan_number").agg(F.collect_list(F.struct("mz", "intensity")).alias("_ions"), F.max("intensity").alias("_base"))
    read = written(scans.where("parse_error IS NULL").select("sample", "scan_number", "rt", "precursor_mz").join(spectra.hint("merge"), ["sample", "scan_number"], "left"))

    def alike(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Peaks that ask for the same: one row of them, numbered."""
        return written(rows.select(*keys, "_products").distinct().withColumn("_class", F.monotonically_increasing_id()))

    def judged(classes: DataFrame, triggers: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Counts and the best match of each class's triggers."""
        near = F.array_min(F.transform("_ions", lambda i: F.struct(F.abs(i["mz"] - F.col("_p.product_mz")).alias("off"), i["mz"].alias("ion_mz"), i["intensity"].alias("intensity"))))
        held = triggers.select("_class", "_ions", "_base", F.posexplode_outer("_products").alias("_place", "_p")).select("_class", "_place", "_base", F.col("_p.product_mz").alias("_mz"), near.alias("_i"))
        off = F.col("_i.off") / F.col("_mz") * 1e6
        known = held.select("_class", "_place", F.when(off <= diagnostic_ppm, off).alias("ppm"), (F.col("_i.intensity") / F.col("_base")).alias("ratio"))
        good = F.coalesce((F.col("ppm") <= ppm) & (F.col("ratio") >= least_ratio), F.lit(False))
        one = known.groupBy("_class", "_place").agg(F.count("*").alias("n"), F.max(good).alias("good"), F.min("ppm").alias("ppm"))
        product = F.when(F.col("good"), F.get(F.col("_products"), F.col("_place")).getField("product"))
        best = one.join(classes.hint("merge"), "_class").groupBy("_class", *keys, "_products").agg(F.max("n").alias(f"{name}_triggers"), F.count_distinct(product).alias(f"{name}_matched"), F.min("ppm").alias(f"{name}_ppm"))
        return best.drop("_class")

    placed = ["sample", "apex_rt", "want_mz"]
    close = alike(wanted.where("apex_rt IS NOT NULL"), placed)
    here = judged(close, band_join(read, close, "rt", "apex_rt", window, ["sample"], inside & fits), placed, "near")
    near = written(wanted.join(here.hint("merge"), [*placed, "_products"], "left"))
    blind = close.select("sample", "apex_rt").distinct()
    errors = band_join(blind, unread.select("sample", F.col("rt").alias("error_rt")), "apex_rt", "error_rt", window, ["sample"], F.abs(F.col("error_rt") - F.col("apex_rt")) <= window).groupBy("sample", "apex_rt").agg(F.count("*").alias("errors"))
    open_ = alike(near.where("coalesce(near_matched, 0) = 0"), ["sample", "want_mz"])
    anywhere = judged(open_, band_join(read, open_, "precursor_mz", "want_mz", precursor_da, ["sample"], fits), ["sample", "want_mz"], "any")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = near.join(errors, ["sample", "apex_rt"], "left").join(anywhere.hint("merge"), ["sample", "want_mz", "_products"], "left")
    back = (n("near_matched") == 0) & (n("any_matched") > 0)
    side = lambda c: F.when(back, F.col(f"any_{c}")).otherwise(F.col(f"near_{c}"))
    triggers, matched, best = n(side("triggers")), n(side("matched")), side("ppm")
    status = first_of((triggers == 0, F.when(n("errors") > 0, "ms2_parse_error").otherwise("no_ms2_trigger")), (matched > 0, "hcd_supported"), (best.isNotNull(), "hcd_partial"), otherwise="no_product_match")
    return rows.select("peak_id", triggers.alias("triggers"), n("errors").alias("errors"), matched.alias("matched"), best.alias("best_ppm"), back.alias("outside_window"), status.alias("status"))


def reliability(confidence: Column, loss: Column, area: Column, rt: Column, quality: Column, median_area: Column, coherent: Column, weak_share: float = 0.05) -> tuple[Column, Column]:
    """(state, risks) of a targeted row: negative without a peak, else eligible as a benchmark, for review though positive, or for review.

    quality: array of flags; coherent: whether the evidence makes a missing neutral loss plausible."""
    hard = F.size(F.array_except(quality, F.array(*[F.lit(n) for n in SOFT_FLAGS]))) > 0
    fail = loss == "NL_FAIL"
    risks = flags(
        (confidence.isin("LOW", "VERY_LOW"), "low_confidence"), (fail & coherent, "plausible_nl_dropout"), (fail & ~coherent, "hard_nl_conflict"), (loss == "NO_MS2", "no_ms2"), (hard, "quality_flags"),
        (F.coalesce(area < median_area * weak_share, F.lit(False)), "weak_area_rank"),
    )
    none = rt.isNull() | area.isNull() | (area <= 0)
    positive = F.size(F.array_except(risks, F.array(F.lit("plausible_nl_dropout"), F.lit("weak_area_rank")))) == 0
    state = first_of((none, "targeted_negative"), (F.size(risks) == 0, "benchmark_eligible"), (positive, "targeted_review_positive"), otherwise="targeted_review")
    return state, F.when(none, F.array(F.lit("no_usable_peak"))).otherwise(risks)


def _name_parts(name: Column) -> list[Column]:
    low = F.lower(name)
    kind = first_of(*[(low.contains(k), k) for k in ("tumor", "normal", "benign", "qc")], otherwise="")
    tokens = F.array_distinct(F.filter(F.split(F.regexp_replace(F.trim(low), r"[_\-\s]+", " "), " "), lambda t: F.length(t) >= 2))
    return [F.upper(F.regexp_extract(name, r"(?i)(BC\d+)", 1)).alias("bc"), kind.alias("kind"), F.regexp_extract(name, r"(?i)QC[_\s*]*(\d+)", 1).alias("qc"), tokens.alias("tokens")]


def name_matches(names: DataFrame, files: DataFrame, name: str, file: str, least: float = 0.75) -> DataFrame:
    """(name, file, score) of every distinct injection name: its best file, or an empty file and no score if none reaches `least`.

    Where both have a BC number, these must agree, and the kinds (tumor, normal, benign, qc) where both have one: 1, or 0.8 without a kind. Else
    two QC names with numbers agree or don't. Else the score is the share of the name's words that the file has. Ties go to the smaller file
    name; null names and files don't count.

    Files that are alike in what counts are one row, of the smallest name. Words are met by the rarest of a name only: of n words at least
    `least` * n must be shared, so that one of its n - ceil(least * n) + 1 rarest is among them. Names whose words a file has all are told first,
    by their rarest word alone; only the others look for less.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    left = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().select("name", *_name_parts(F.col("name")))
    right = files.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), *_name_parts(F.col(file)))
    asked = left.select("bc", "kind", "qc", F.array_sort("tokens").alias("tokens"), "name")
    by_bc = right.where("bc <> ''").groupBy(F.col("bc").alias("f_bc"), F.col("kind").alias("f_kind")).agg(F.min("file").alias("file"))
    agree = F.when((F.col("kind") == "") | (F.col("f_kind") == ""), 0.8).otherwise((F.col("kind") == F.col("f_kind")).cast("double"))
    bc = asked.join(by_bc, F.col("bc") == F.col("f_bc")).select("name", "file", agree.alias("score"))
    one_bc = lambda other: (F.col("bc") == "") | ~F.col(other)
    by_qc = right.where("kind = 'qc' AND qc <> ''").groupBy(F.col("qc").alias("f_qc"), (F.col("bc") != "").alias("f_has_bc")).agg(F.min("file").alias("file"))
    qc = asked.where("kind = 'qc'").join(by_qc, F.col("qc") == F.col("f_qc")).where(one_bc("f_has_bc")).select("name", "file", F.lit(1.0).alias("score"))

    own = right.select(F.array_sort("tokens").alias("f_tokens"), (F.col("bc") != "").alias("f_has_bc"), ((F.col("kind") == "qc") & (F.col("qc") != "")).alias("f_numbered"), "file")
    alike = written(own.where(F.size("f_tokens") > 0).groupBy("f_tokens", "f_has_bc", "f_numbered").agg(F.min("file").alias("file")))
    held = alike.select("f_tokens", "f_has_bc", "f_numbered", "file", F.explode("f_tokens").alias("_word"))
    often = held.groupBy("_word").agg(F.count("*").alias("_often"))
    group = ["tokens", "has_bc", "numbered"]
    mine = written(asked.where(F.size("tokens") > 0).groupBy("tokens", (F.col("bc") != "").alias("has_bc"), ((F.col("kind") == "qc") & (F.col("qc") != "")).alias("numbered")).agg(F.collect_list("name").alias("names")))
    words = mine.select(*group, F.explode("tokens").alias("_word")).join(often, "_word", "left").withColumn("_often", F.coalesce("_often", F.lit(0)))
    rare = written(words.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("_often", "_word"))))
    n = F.size("tokens")
    open_ = ~(F.col("has_bc") & F.col("f_has_bc")) & ~(F.col("numbered") & F.col("f_numbered"))
    share = (F.size(F.array_intersect("tokens", "f_tokens")) / n).alias("score")
    first = lambda: F.min_by(F.struct("file", "score"), F.struct((-F.col("score")).alias("minus"), F.col("file"))).alias("b")

    def reached(asking: DataFrame, share_least: float) -> DataFrame:
        met = asking.where(F.col("_n") <= n - F.ceil(n * share_least - 1e-9) + 1).join(held, "_word").dropDuplicates([*group, "f_tokens", "f_has_bc", "f_numbered"])
        return written(met.where(open_).select(*group, "file", share).where(F.col("score") >= share_least - 1e-9).groupBy(*group).agg(first()))

    whole = reached(rare, 1.0)
    best = whole.unionByName(reached(rare.join(whole.select(*group), group, "left_anti"), least)) if least < 1 else whole
    shared = best.join(mine, group).select(F.explode("names").alias("name"), "b.file", "b.score")
    every = bc.unionByName(qc).unionByName(shared).where(F.col("score") >= least)
    return left.select("name").join(every.groupBy("name").agg(first()), "name", "left").select("name", F.coalesce("b.file", F.lit("")).alias("file"), F.col("b.score").alias("score"))


def seed_reject_reason(
    complete: Column, mode_supported: Column, joined: Column, has_fragments: Column, identity_matches: Column, pre_backfill: Column, owner: Column, assignment: Column, duplicate: Column, finite_peak: Column, seed_inside: Column, scan_support: Column, least_support: float = 0.2
) -> Column:
    """Why a candidate can't seed a coherent row, empty if it can: the first of twelve reasons that holds. A missing scan support isn't one."""
    allowed = assignment.isin("primary", "supporting", "ambiguous", "unresolved")
    return first_of(
        (~complete, "missing_request_identity_constraint"), (~mode_supported, "unsupported_fragment_observation_mode"), (~joined, "missing_discovery_candidate_join"), (~has_fragments, "missing_diagnostic_fragment_evidence"),
        (~identity_matches, "request_candidate_identity_mismatch"), (~pre_backfill, "backfill_only_evidence"), (~owner, "no_quantifiable_owner"), (~allowed, "ambiguous_owner"), (assignment == "unresolved", "no_quantifiable_owner"),
        (assignment == "ambiguous", "ambiguous_owner"), (duplicate, "duplicate_loser"), (~finite_peak, "nonfinite_peak"), (~seed_inside, "seed_rt_outside_owner_peak"), (F.coalesce(~finite(scan_support) | (scan_support < least_support), F.lit(False)) & scan_support.isNotNull(), "low_ms1_scan_support"),
        otherwise="",
    )
