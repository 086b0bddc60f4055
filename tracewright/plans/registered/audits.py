"""Queries of decisions, evidence joins and audits over finished tables (more of FLT, JON, AGG, WIN, GRP, IDC, TRC)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.columns import finite, first_of, flags, ppm_distance
from ...operators import joins as J
from ...operators import rules as R
from ...operators import traces as T
from ...operators.graph import components
from ..catalog import query
from .groups import _MATRIX, matrix
from .joins import _EDGES, _NEAR, near_families
from .rules import _ACCEPTED, _COUNTS, _QUALITY, family_counts, quality_cells
from .traces import _REGIONS, _SPLITS, _regions


@query("flt06_qc_file_class", """
WITH p AS (SELECT page_id, string_split(lower(regexp_replace(url, '^[a-z]+://', '')), '/') AS s FROM pages)
SELECT page_id, CASE WHEN len(list_filter(s, lambda x: contains(x, 'en'))) > 0 THEN 'standard' WHEN starts_with(s[-1], '8') THEN 'mix' WHEN contains(s[-1], '1') THEN 'blank' ELSE 'other' END AS kind FROM p""")  # fmt: skip
def flt06(b):
    """A file's class by the folders of its path and the start of its name."""
    parts = F.split(F.lower(F.regexp_replace("url", "^[a-z]+://", "")), "/")
    stem = F.element_at("s", -1)
    kind = first_of((F.exists("s", lambda x: x.contains("en")), "standard"), (stem.startswith("8"), "mix"), (stem.contains("1"), "blank"), otherwise="other")
    return b.pages.select("page_id", parts.alias("s")).select("page_id", kind.alias("kind"))


_IDENTITY = """CASE WHEN detected = 0 AND rescued = 0 THEN 'audit|none|no_support' WHEN primary_evidence = 'single_sample_local_owner' AND detected <= 1 THEN 'audit|low|single_sample' WHEN detected >= 2 AND primary_evidence IN ('owner_complete_link', 'owner_identity', 'multi_sample_detected') THEN 'production|high|' || primary_evidence
  WHEN detected >= 1 AND rescued > detected THEN 'provisional|low|rescue_heavy' WHEN detected >= 1 THEN 'provisional|medium|' || primary_evidence ELSE 'audit|low|rescue_only' END"""


@query("flt12_family_identity", f"WITH {_COUNTS} SELECT family_id, {_IDENTITY} AS decision FROM f")
def flt12(b):
    """Production, provisional or audit, with confidence and reason; the first rule that holds decides."""
    d, r, kind = F.col("detected"), F.col("rescued"), F.col("primary_evidence")
    known = kind.isin("owner_complete_link", "owner_identity", "multi_sample_detected")
    decision = first_of(
        ((d == 0) & (r == 0), "audit|none|no_support"), ((kind == "single_sample_local_owner") & (d <= 1), "audit|low|single_sample"), ((d >= 2) & known, F.concat(F.lit("production|high|"), kind)),
        ((d >= 1) & (r > d), "provisional|low|rescue_heavy"), (d >= 1, F.concat(F.lit("provisional|medium|"), kind)), otherwise="audit|low|rescue_only",
    )
    return family_counts(b).select("family_id", decision.alias("decision"))


@query("flt14_backfill_promotion", f"""
WITH {_COUNTS} SELECT family_id, CASE WHEN rescued = 0 THEN 'not_applicable' WHEN ambiguous > 0 THEN 'blocked:interference' WHEN detected + rescued < 0.3 * cell_count THEN 'blocked:coverage' WHEN detected = 0 THEN 'blocked:identity' ELSE 'supported' END AS promotion FROM f""")  # fmt: skip
def flt14(b):
    d, r = F.col("detected"), F.col("rescued")
    rule = first_of((r == 0, "not_applicable"), (F.col("ambiguous") > 0, "blocked:interference"), (d + r < 0.3 * F.col("cell_count"), "blocked:coverage"), (d == 0, "blocked:identity"), otherwise="supported")
    return family_counts(b).select("family_id", rule.alias("promotion"))


@query("flt22_product_projection", f"""
SELECT sample, label, CASE WHEN t.sample_applicability = 'plasma' THEN 'excluded' WHEN flags LIKE '%too_broad%' AND nl = 'NL_FAIL' THEN 'ambiguous' WHEN r.rt IS NULL AND r.is_istd THEN 'istd_dropout' WHEN r.rt IS NULL THEN 'missing' WHEN NOT {_ACCEPTED} THEN 'not_counted' WHEN flags <> '' THEN 'flagged' ELSE 'clean' END AS state
FROM results r JOIN (SELECT label, sample_applicability FROM targets) t USING (label)""")  # fmt: skip
def flt22(b):
    """The state of a result: the first of excluded, ambiguous, dropped out, missing, not counted, flagged and clean that holds."""
    ok = R.accepted_detection(F.col("rt"), F.col("area"), F.col("confidence"), F.col("nl"))
    state = first_of(
        (F.col("sample_applicability") == "plasma", "excluded"), (F.col("flags").contains("too_broad") & (F.col("nl") == "NL_FAIL"), "ambiguous"), (F.col("rt").isNull() & F.col("is_istd"), "istd_dropout"),
        (F.col("rt").isNull(), "missing"), (~ok, "not_counted"), (F.col("flags") != "", "flagged"), otherwise="clean",
    )
    return b.results.join(b.targets.select("label", "sample_applicability"), "label").select("sample", "label", state.alias("state"))


@query("flt23_primary_area", "SELECT family_id, sample, CASE WHEN height IS NOT NULL AND area > 0 THEN area END AS value, CASE WHEN height IS NOT NULL AND area > 0 THEN '' ELSE 'missing_ms1_morphology_area' END AS reason FROM cells")
def flt23(b):
    """An area only from an approved integration, else the reason why there is none."""
    fine = F.col("height").isNotNull() & finite(F.col("area")) & (F.col("area") > 0)
    return b.cells.select("family_id", "sample", F.when(fine, F.col("area")).alias("value"), F.when(fine, "").otherwise("missing_ms1_morphology_area").alias("reason"))


@query("flt24_backfill_scope", f"""
WITH {_COUNTS} SELECT family_id, detected >= 2 AND primary_evidence <> 'cid_nl_only' AS selected, CASE WHEN detected >= 2 AND primary_evidence <> 'cid_nl_only' THEN '' WHEN detected < 2 THEN 'too_few_detected' ELSE 'identity_cannot_change' END AS skipped FROM f""")  # fmt: skip
def flt24(b):
    """Families to fill, and the ledger of those that were skipped."""
    rows = family_counts(b).select("family_id", "detected", "primary_evidence")
    chosen = rows.where((F.col("detected") >= 2) & (F.col("primary_evidence") != "cid_nl_only")).select("family_id")
    ledger = rows.join(chosen, "family_id", "left_anti").select("family_id", F.lit(False).alias("selected"), F.when(F.col("detected") < 2, "too_few_detected").otherwise("identity_cannot_change").alias("skipped"))
    return chosen.select("family_id", F.lit(True).alias("selected"), F.lit("").alias("skipped")).unionByName(ledger)


@query("flt25_anchor_mismatch", """
SELECT r.sample, r.label, round(abs(r.rt - i.rt), 6) AS off, CASE WHEN abs(r.rt - i.rt) > 0.5 THEN 'VERY_LOW' ELSE r.confidence END AS confidence, CASE WHEN abs(r.rt - i.rt) > 0.5 THEN 'ANCHOR_RT_MISMATCH' WHEN abs(r.rt - i.rt) > 0.25 THEN 'ANCHOR_RT_NEAR_LIMIT' ELSE '' END AS diagnostic
FROM results r JOIN results i ON i.sample = r.sample AND i.label = r.istd_pair WHERE r.rt IS NOT NULL AND i.rt IS NOT NULL""")  # fmt: skip
def flt25(b):
    """Results far from their standard's RT fall to the lowest confidence."""
    istd = b.results.where("is_istd AND rt IS NOT NULL").select("sample", F.col("label").alias("istd_pair"), F.col("rt").alias("i_rt"))
    off = F.abs(F.col("rt") - F.col("i_rt"))
    rows = b.results.where("rt IS NOT NULL").join(istd, ["sample", "istd_pair"])
    return rows.select("sample", "label", F.round(off, 6).alias("off"), F.when(off > 0.5, "VERY_LOW").otherwise(F.col("confidence")).alias("confidence"), F.when(off > 0.5, "ANCHOR_RT_MISMATCH").when(off > 0.25, "ANCHOR_RT_NEAR_LIMIT").otherwise("").alias("diagnostic"))


@query("flt28_production_gate", f"""
WITH {_COUNTS}, g AS (SELECT CASE WHEN detected >= 3 AND duplicates = 0 AND ambiguous = 0 THEN 'candidate' WHEN detected >= 3 THEN 'blocked' ELSE 'review' END AS gate FROM f) SELECT gate, count(*) AS n FROM g GROUP BY gate""")  # fmt: skip
def flt28(b):
    d = F.col("detected") >= 3
    gate = F.when(d & (F.col("duplicates") == 0) & (F.col("ambiguous") == 0), "candidate").when(d, "blocked").otherwise("review")
    return family_counts(b).groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


_SLOPES = """sl AS (SELECT label, regr_slope(rt, injection_order) FILTER (WHERE role = 'qc') AS clean, regr_slope(rt, injection_order) FILTER (WHERE role = 'study') AS bio, count(injection_order) FILTER (WHERE role = 'qc') AS nc, count(injection_order) FILTER (WHERE role = 'study') AS nb FROM standards GROUP BY label),
dr AS (SELECT *, CASE WHEN clean IS NULL OR bio IS NULL THEN 'incomplete' WHEN abs(bio) < 1e-5 AND abs(clean) < 1e-5 THEN 'both_flat' WHEN abs(clean) < 1e-5 THEN 'bio_drift_clean_flat' WHEN abs(bio) < 1e-5 THEN 'bio_flat_clean_drift' WHEN sign(bio) = sign(clean) THEN 'same_direction' ELSE 'opposite_direction' END AS direction FROM sl)"""


@query("flt30_drift_transfer", f"""
WITH {_SLOPES} SELECT label, direction, CASE WHEN nb < 3 THEN 'insufficient_biological_istd' WHEN nc < 3 THEN 'insufficient_clean_standard' WHEN direction IN ('opposite_direction', 'bio_drift_clean_flat', 'bio_flat_clean_drift') THEN 'transfer_not_supported' WHEN direction = 'both_flat' THEN 'transfer_supported'
  WHEN abs(bio) / abs(clean) BETWEEN 0.67 AND 1.5 THEN 'transfer_supported' ELSE 'direction_supported_magnitude_shifted' END AS status FROM dr""")  # fmt: skip
def flt30(b):
    """Whether drift seen in clean standards carries over to biological samples."""
    side = lambda k: (F.when(F.col("role") == k, F.col("rt")), F.when(F.col("role") == k, F.col("injection_order").cast("double")))
    s = b.standards.groupBy("label").agg(*[e for k, n in (("qc", "clean"), ("study", "bio")) for e in (F.regr_slope(*side(k)).alias(n), F.count(side(k)[1]).alias(f"n_{n}"))])
    bio, clean = F.col("bio"), F.col("clean")
    flat_b, flat_c = F.abs(bio) < 1e-5, F.abs(clean) < 1e-5
    direction = first_of((clean.isNull() | bio.isNull(), "incomplete"), (flat_b & flat_c, "both_flat"), (flat_c, "bio_drift_clean_flat"), (flat_b, "bio_flat_clean_drift"), (F.signum(bio) == F.signum(clean), "same_direction"), otherwise="opposite_direction")
    k = s.withColumn("direction", direction)
    status = first_of(
        (F.col("n_bio") < 3, "insufficient_biological_istd"), (F.col("n_clean") < 3, "insufficient_clean_standard"), (F.col("direction").isin("opposite_direction", "bio_drift_clean_flat", "bio_flat_clean_drift"), "transfer_not_supported"),
        (F.col("direction") == "both_flat", "transfer_supported"), ((F.abs(bio) / F.abs(clean)).between(0.67, 1.5), "transfer_supported"), otherwise="direction_supported_magnitude_shifted",
    )
    return k.select("label", "direction", status.alias("status"))


@query("flt31_maturity_gate", """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'detected') AS d, count(*) FILTER (WHERE injection_order IS NOT NULL) AS o FROM trends)
SELECT 2 AS level, concat_ws(';', CASE WHEN d < 0.9 * n THEN 'detection' END) AS blockers FROM s UNION ALL SELECT 3, concat_ws(';', CASE WHEN d < 0.9 * n THEN 'detection' END, CASE WHEN o < 0.95 * n THEN 'order' END) FROM s UNION ALL SELECT 4, concat_ws(';', CASE WHEN n < 1000 THEN 'rows' END) FROM s""")  # fmt: skip
def flt31(b):
    """Go or no-go for each level, with what blocks it."""
    one = b.trends.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "detected").alias("d"), F.count_if(F.col("injection_order").isNotNull()).alias("o"))
    few, unordered, small = (F.col("d") < 0.9 * F.col("n"), "detection"), (F.col("o") < 0.95 * F.col("n"), "order"), (F.col("n") < 1000, "rows")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.array_join(flags(*rules), ";").alias("blockers")) for k, rules in ((2, (few,)), (3, (few, unordered)), (4, (small,)))])
    return one.select(F.inline(levels))


@query("flt36_pair_rt_relation", """
WITH p AS (SELECT r.sample, r.label, r.rt - i.rt AS delta FROM results r JOIN results i ON i.sample = r.sample AND i.label = r.istd_pair WHERE r.rt IS NOT NULL AND i.rt IS NOT NULL), c AS (SELECT label, median(delta) AS ref FROM p GROUP BY label)
SELECT label, count(*) AS n, count(*) FILTER (WHERE abs(delta - ref) > 1) AS proposed, count(*) FILTER (WHERE abs(delta - ref) > 3) AS blocked FROM p JOIN c USING (label) GROUP BY label""")  # fmt: skip
def flt36(b):
    istd = b.results.where("is_istd AND rt IS NOT NULL").select("sample", F.col("label").alias("istd_pair"), F.col("rt").alias("i_rt"))
    pairs = b.results.where("rt IS NOT NULL").join(istd, ["sample", "istd_pair"]).select("label", (F.col("rt") - F.col("i_rt")).alias("delta"))
    off = F.abs(F.col("delta") - F.col("ref"))
    return pairs.join(pairs.groupBy("label").agg(F.percentile("delta", 0.5).alias("ref")), "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if(off > 1).alias("proposed"), F.count_if(off > 3).alias("blocked"))


@query("jon10_one_to_one_match")
def jon10(b):
    """Families of two matrices matched one to one, the closest pairs first."""
    left, right = b.families.where("has_anchor"), b.families.where("NOT has_anchor")
    left = left.select(F.col("family_id").alias("a"), F.lit(0).alias("one"), F.col("center_mz").alias("a_mz"), F.col("center_rt").alias("a_rt"))
    right = right.select(F.col("family_id").alias("b"), F.lit(0).alias("one"), F.col("center_mz").alias("b_mz"), F.col("center_rt").alias("b_rt"))
    ppm, rt = ppm_distance(F.col("a_mz"), F.col("b_mz")), F.abs(F.col("a_rt") - F.col("b_rt"))
    edges = J.ppm_join(left, right, "a_mz", "b_mz", 20.0, ["one"], (ppm <= 20) & (rt <= 0.5)).withColumn("score", F.greatest(ppm / 20, rt / 0.5))
    return J.one_to_one(edges, "a", "b", ["score", "a", "b"]).select("a", "b", F.round("score", 6).alias("score"))


@query("jon13_evidence_projection", f"""
WITH {_QUALITY}, e1 AS (SELECT family_id, sample FROM cells WHERE rt_delta_sec BETWEEN -30 AND 30), e2 AS (SELECT family_id, sample FROM cells WHERE area > 60000)
SELECT c.family_id, c.sample, concat_ws(';', nullif(c.reason, ''), CASE WHEN e1.sample IS NOT NULL THEN 'rt_pattern' END, CASE WHEN e2.sample IS NOT NULL THEN 'area_pattern' END) AS reasons FROM c
LEFT JOIN e1 ON e1.family_id = c.family_id AND e1.sample = c.sample LEFT JOIN e2 ON e2.family_id = c.family_id AND e2.sample = c.sample""")  # fmt: skip
def jon13(b):
    """Authorised evidence rows copied to their cells, as tokens after the cell's own reason."""
    part = lambda where, n: b.cells.where(where).select("family_id", "sample", F.lit(n).alias(n))
    rows = quality_cells(b).join(part("rt_delta_sec BETWEEN -30 AND 30", "rt_pattern"), ["family_id", "sample"], "left").join(part("area > 60000", "area_pattern"), ["family_id", "sample"], "left")
    return rows.select("family_id", "sample", F.concat_ws(";", F.nullif("reason", F.lit("")), "rt_pattern", "area_pattern").alias("reasons"))


@query("jon22_seed_lookup", """
SELECT c.candidate_id, coalesce(a.evidence_score, s.best) AS score, CASE WHEN a.owner_id IS NOT NULL THEN 'id' WHEN s.best IS NOT NULL THEN 'sample_tag' ELSE 'missing' END AS via FROM candidates c LEFT JOIN (SELECT * FROM owners WHERE NOT identity_conflict AND tag <> '') a ON a.owner_id = c.candidate_id
LEFT JOIN (SELECT sample, tag, max(evidence_score) AS best FROM owners WHERE tag <> 'tag3' GROUP BY ALL) s ON s.sample = c.sample AND s.tag = c.tag""")  # fmt: skip
def jon22(b):
    """A candidate's seed by its id, else by sample and tag."""
    by_id = b.owners.where("NOT identity_conflict AND tag <> ''").select(F.col("owner_id").alias("candidate_id"), F.col("evidence_score").alias("own"))
    by_tag = b.owners.where("tag <> 'tag3'").groupBy("sample", "tag").agg(F.max("evidence_score").alias("best"))
    rows = b.candidates.select("candidate_id", "sample", "tag").join(by_id, "candidate_id", "left").join(by_tag, ["sample", "tag"], "left")
    return rows.select("candidate_id", F.coalesce("own", "best").alias("score"), F.when(F.col("own").isNotNull(), "id").when(F.col("best").isNotNull(), "sample_tag").otherwise("missing").alias("via"))


@query("jon26_label_match", """
WITH m AS (SELECT r.sample, r.label, count(c.family_id) AS n FROM results r LEFT JOIN cells c ON c.sample = r.sample AND c.status = 'detected' AND abs(c.apex_rt - r.rt) <= 0.004e0 GROUP BY ALL) SELECT sample, label, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'single' ELSE 'ambiguous' END AS match FROM m""")  # fmt: skip
def jon26(b):
    truth = b.results.select("sample", "label", F.col("rt").alias("want"))
    cells = b.cells.where("status = 'detected'").select("sample", "family_id", "apex_rt")
    near = J.band_join(truth.where("want IS NOT NULL"), cells, "want", "apex_rt", 0.005, ["sample"], F.abs(F.col("apex_rt") - F.col("want")) <= 0.004).groupBy("sample", "label").agg(F.count("*").alias("n"))
    return truth.select("sample", "label").join(near, ["sample", "label"], "left").select("sample", "label", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "single").otherwise("ambiguous").alias("match"))


@query("jon28_rt_drift_policy", """
WITH a AS (SELECT family_id, sample, rt_delta_sec AS v FROM cells WHERE status = 'detected'), n AS (SELECT family_id, sample, rt_delta_sec / 2 AS v FROM cells WHERE area > 30000), t AS (SELECT sample, avg(rt_delta_sec) AS v FROM cells GROUP BY sample)
SELECT c.family_id, c.sample, CASE WHEN a.v IS NOT NULL THEN 'owner_edge' WHEN n.v IS NOT NULL THEN 'rt_normalisation' WHEN t.v IS NOT NULL THEN 'anchor_trend' ELSE 'none' END AS source, round(coalesce(a.v, n.v, t.v), 5) AS drift_sec FROM cells c LEFT JOIN a ON a.family_id = c.family_id AND a.sample = c.sample LEFT JOIN n ON n.family_id = c.family_id AND n.sample = c.sample LEFT JOIN t ON t.sample = c.sample""")  # fmt: skip
def jon28(b):
    """The first of three sources of drift that a cell has."""
    keys = ["family_id", "sample"]
    a = b.cells.where("status = 'detected'").select(*keys, F.col("rt_delta_sec").alias("a"))
    n = b.cells.where("area > 30000").select(*keys, (F.col("rt_delta_sec") / 2).alias("n"))
    t = b.cells.groupBy("sample").agg(F.avg("rt_delta_sec").alias("t"))
    rows = b.cells.select(*keys).join(a, keys, "left").join(n, keys, "left").join(t, "sample", "left")
    source = first_of((F.col("a").isNotNull(), "owner_edge"), (F.col("n").isNotNull(), "rt_normalisation"), (F.col("t").isNotNull(), "anchor_trend"), otherwise="none")
    return rows.select(*keys, source.alias("source"), F.round(F.coalesce("a", "n", "t"), 5).alias("drift_sec"))


@query("agg23_score_parameters", """
WITH t AS (SELECT sample, label, area FROM results WHERE is_istd AND area IS NOT NULL), g AS (SELECT 1 AS p, 0.95e0 AS f UNION ALL SELECT 2, 0.8e0 UNION ALL SELECT 3, 1.3e0), e AS (SELECT p, t.sample, t.label, CASE WHEN r.confidence <> 'VERY_LOW' THEN abs(r.area * f - t.area) / t.area END AS err FROM t CROSS JOIN g LEFT JOIN results r ON r.sample = t.sample AND r.label = t.label)
SELECT p AS param_set, count(*) FILTER (WHERE err IS NULL) AS missing, round(median(err), 6) AS median_error, count(*) FILTER (WHERE err <= 0.1) AS within10, count(*) FILTER (WHERE err <= 0.25) AS within25 FROM e GROUP BY p""")  # fmt: skip
def agg23(b):
    """Each parameter set's peaks against the truth."""
    truth = b.results.where("is_istd AND area IS NOT NULL").select("sample", "label", F.col("area").alias("true_area"))
    grid = F.broadcast(b.spark.createDataFrame([(1, 0.95), (2, 0.8), (3, 1.3)], "param_set int, f double"))
    found = b.results.where("confidence <> 'VERY_LOW'").select("sample", "label", "area")
    rows = truth.crossJoin(grid).join(found, ["sample", "label"], "left").withColumn("err", F.abs(F.col("area") * F.col("f") - F.col("true_area")) / F.col("true_area"))
    return rows.groupBy("param_set").agg(F.count_if(F.col("err").isNull()).alias("missing"), F.round(F.percentile("err", 0.5), 6).alias("median_error"), F.count_if(F.col("err") <= 0.1).alias("within10"), F.count_if(F.col("err") <= 0.25).alias("within25"))


@query("agg24_selection_risk", f"""
WITH {_REGIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY apex_intensity DESC, region) AS n FROM ap)
SELECT trace_id, max(region) FILTER (WHERE n = 1) AS selected, arg_min(region, (-apex_intensity, region)) FILTER (WHERE n > 1) AS challenger, round(max(apex_intensity) FILTER (WHERE n > 1) / max(apex_intensity), 6) AS ratio FROM k GROUP BY trace_id""")  # fmt: skip
def agg24(b):
    """The selected candidate of each trace and its strongest rejected challenger."""
    by = W.partitionBy("trace_id").orderBy(F.desc("apex_intensity"), "region")
    rows = T.apexes(b.traces, _regions(b)).withColumn("n", F.row_number().over(by))
    rest = F.col("n") > 1
    return rows.groupBy("trace_id").agg(
        F.max(F.when(~rest, F.col("region"))).alias("selected"), F.min(F.when(rest, F.struct(-F.col("apex_intensity"), F.col("region"))))["region"].alias("challenger"),
        F.round(F.max(F.when(rest, F.col("apex_intensity"))) / F.max("apex_intensity"), 6).alias("ratio"),
    )


@query("agg31_region_summary", f"WITH {_REGIONS} SELECT trace_id, count(*) AS regions, min(l) AS first_left, max(r) AS last_right, sum(scans) AS scans FROM ap GROUP BY trace_id")
def agg31(b):
    return T.apexes(b.traces, _regions(b)).groupBy("trace_id").agg(F.count("*").alias("regions"), F.min("left").alias("first_left"), F.max("right").alias("last_right"), F.sum("scans").alias("scans"))


@query("win16_baseline_return", f"""
WITH {_REGIONS}, tp1 AS (SELECT trace_id, arg_min(idx, (-intensity, idx)) AS apex, max(intensity) AS top FROM traces GROUP BY trace_id), lw AS (SELECT t.trace_id, idx, apex, intensity < top * 0.1e0 AS below FROM traces t JOIN tp1 USING (trace_id)),
tw AS (SELECT *, below AND coalesce(lag(below) OVER w, FALSE) AS both_left, below AND coalesce(lead(below) OVER w, FALSE) AS both_right FROM lw WINDOW w AS (PARTITION BY trace_id ORDER BY idx))
SELECT trace_id, apex, coalesce(max(idx) FILTER (WHERE both_left AND idx < apex) + 1, 0) AS "left", coalesce(min(idx) FILTER (WHERE both_right AND idx > apex) - 1, max(idx)) AS "right" FROM tw GROUP BY trace_id, apex""")  # fmt: skip
def win16(b):
    """The highest peak's bounds: outwards to two points in a row below a tenth of it; single low points are bridged."""
    top = b.traces.groupBy("trace_id").agg(F.min_by("idx", F.struct(-F.col("intensity"), F.col("idx"))).alias("apex"), F.max("intensity").alias("top"))
    rows = b.traces.join(top, "trace_id").withColumn("below", F.col("intensity") < F.col("top") * 0.1)
    by = T.ordered()
    rows = rows.withColumn("l2", F.col("below") & F.coalesce(F.lag("below").over(by), F.lit(False))).withColumn("r2", F.col("below") & F.coalesce(F.lead("below").over(by), F.lit(False)))
    i = F.col("idx")
    return rows.groupBy("trace_id", "apex").agg(
        F.coalesce(F.max(F.when(F.col("l2") & (i < F.col("apex")), i)) + 1, F.lit(0)).alias("left"), F.coalesce(F.min(F.when(F.col("r2") & (i > F.col("apex")), i)) - 1, F.max(i)).alias("right")
    )


@query("win18_rt_mode_gaps", """
WITH k AS (SELECT family_id, sample, apex_rt, apex_rt - lag(apex_rt) OVER w AS gap FROM cells WHERE status = 'detected' WINDOW w AS (PARTITION BY family_id ORDER BY apex_rt, sample)), t AS (SELECT family_id, median(gap) AS typical FROM k GROUP BY family_id)
SELECT family_id, sample, CAST(sum(CASE WHEN gap > 0.05e0 OR gap >= 0.02e0 AND gap >= 3 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY family_id ORDER BY apex_rt, sample) AS BIGINT) AS mode FROM k JOIN t USING (family_id)""")  # fmt: skip
def win18(b):
    """RT modes: a hard gap, or a soft one of three times the typical gap, starts the next."""
    by = W.partitionBy("family_id").orderBy("apex_rt", "sample")
    rows = b.cells.where("status = 'detected'").select("family_id", "sample", "apex_rt", (F.col("apex_rt") - F.lag("apex_rt").over(by)).alias("gap"))
    rows = rows.join(rows.groupBy("family_id").agg(F.percentile("gap", 0.5).alias("typical")), "family_id")
    new = (F.col("gap") > 0.05) | ((F.col("gap") >= 0.02) & (F.col("gap") >= 3 * F.col("typical")))
    return rows.select("family_id", "sample", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(by).alias("mode"))


@query("win24_merge_by_apex", f"""
WITH {_REGIONS}, hp AS (SELECT trace_id, idx AS hidx, rt AS hrt FROM pk WHERE intensity > 50) SELECT ap.trace_id, region, CASE WHEN count(hp.hidx) > 0 THEN 'local_minimum;threshold' ELSE 'local_minimum' END AS sources FROM ap LEFT JOIN hp ON hp.trace_id = ap.trace_id AND abs(hrt - apex_rt) <= 0.06e0 GROUP BY ap.trace_id, region""")  # fmt: skip
def win24(b):
    """Candidates that a second proposal nearly shares the apex with carry both sources."""
    mine = T.apexes(b.traces, _regions(b)).select("trace_id", "region", "apex_rt")
    other = T.local_maxima(b.traces).where("intensity > 50").select("trace_id", F.col("rt").alias("o_rt"))
    shared = J.band_join(mine, other, "apex_rt", "o_rt", 0.25, ["trace_id"], F.abs(F.col("o_rt") - F.col("apex_rt")) <= 0.06).select("trace_id", "region").distinct().withColumn("hit", F.lit(True))
    return mine.join(shared, ["trace_id", "region"], "left").select("trace_id", "region", F.when(F.col("hit"), "local_minimum;threshold").otherwise("local_minimum").alias("sources"))


@query("grp10_primary_consolidation", f"""
WITH RECURSIVE {_NEAR}, fe AS (SELECT left_id AS a, right_id AS b FROM np WHERE shared >= 3 AND overlap >= 0.4), f2 AS (SELECT a, b FROM fe UNION ALL SELECT b, a FROM fe), fr AS (SELECT a, b FROM f2 UNION SELECT fr.a, f2.b FROM fr JOIN f2 ON fr.b = f2.a), cp AS (SELECT a AS family_id, least(a, min(b)) AS comp FROM fr GROUP BY a),
sz AS (SELECT family_id, count(*) FILTER (WHERE status IN ('detected', 'rescued')) AS present, count(*) FILTER (WHERE status = 'detected') AS detected FROM cells GROUP BY family_id)
SELECT family_id, first_value(family_id) OVER (PARTITION BY comp ORDER BY present DESC, detected DESC, family_id) AS winner FROM cp JOIN sz USING (family_id)""")  # fmt: skip
def grp10(b):
    """Families of a component keep the one with the most present, then detected, cells."""
    pairs = near_families(b).where("shared >= 3 AND overlap >= 0.4").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    found = components(pairs).withColumnRenamed("node", "family_id")
    size = b.cells.groupBy("family_id").agg(F.count_if(F.col("status").isin("detected", "rescued")).alias("present"), F.count_if(F.col("status") == "detected").alias("detected"))
    by = W.partitionBy("component").orderBy(F.desc("present"), F.desc("detected"), "family_id")
    return found.join(size, "family_id").select("family_id", F.first("family_id").over(by).alias("winner"))


@query("grp11_recentre", "SELECT family_id, round(coalesce(avg(apex_rt) FILTER (WHERE status IN ('detected', 'rescued')), min(center_rt)), 6) AS centre FROM families LEFT JOIN cells USING (family_id) GROUP BY family_id")
def grp11(b):
    rt = F.when(F.col("status").isin("detected", "rescued"), F.col("apex_rt"))
    return b.families.select("family_id", "center_rt").join(b.cells.select("family_id", "status", "apex_rt"), "family_id", "left").groupBy("family_id").agg(F.round(F.coalesce(F.avg(rt), F.min("center_rt")), 6).alias("centre"))


@query("idc01_match_candidates", """
SELECT f.family_id, o.owner_id, CASE WHEN abs(o.product_mz - f.product_mz) / f.product_mz * 1e6 <= 20 AND abs(o.observed_loss - f.loss_da) / f.loss_da * 1e6 <= 5 THEN 'complete' WHEN abs(o.product_mz - f.product_mz) / f.product_mz * 1e6 <= 20 THEN 'loss_differs' ELSE 'product_differs' END AS match
FROM families f JOIN owners o ON o.tag = f.tag AND abs(o.precursor_mz - f.center_mz) / greatest(abs(o.precursor_mz), 1e-12) * 1e6 <= 20""")  # fmt: skip
def idc01(b):
    near = J.ppm_join(b.families.select("family_id", "tag", "center_mz", F.col("product_mz").alias("f_product"), "loss_da"), b.owners.select("owner_id", "tag", "precursor_mz", "product_mz", "observed_loss"), "center_mz", "precursor_mz", 20.0, ["tag"], ppm_distance(F.col("precursor_mz"), F.col("center_mz")) <= 20)
    product = F.abs(F.col("product_mz") - F.col("f_product")) / F.col("f_product") * 1e6 <= 20
    loss = F.abs(F.col("observed_loss") - F.col("loss_da")) / F.col("loss_da") * 1e6 <= 5
    return near.select("family_id", "owner_id", F.when(product & loss, "complete").when(product, "loss_differs").otherwise("product_differs").alias("match"))


@query("idc10_bundle_comparison", f"""
WITH {_MATRIX}, v AS (SELECT mx.family_id, mx.sample, mx.status, CASE WHEN c.rt_delta_sec > 60 THEN 'absent' ELSE mx.status END AS other FROM mx LEFT JOIN cells c ON c.family_id = mx.family_id AND c.sample = mx.sample)
SELECT count(*) AS cells, count(*) FILTER (WHERE status <> other) AS changed, CASE WHEN count(*) FILTER (WHERE status <> other) <= 0.2 * count(*) THEN 'accepted' ELSE 'rejected' END AS verdict FROM v""")  # fmt: skip
def idc10(b):
    rows = matrix(b).select("family_id", "sample", "status").join(b.cells.select("family_id", "sample", "rt_delta_sec"), ["family_id", "sample"], "left")
    changed = F.count_if(F.coalesce((F.col("rt_delta_sec") > 60) & (F.col("status") != "absent"), F.lit(False)))
    return rows.agg(F.count("*").alias("cells"), changed.alias("changed"), F.when(changed <= 0.2 * F.count("*"), "accepted").otherwise("rejected").alias("verdict"))


@query("trc10_resolver_comparison", f"""
WITH {_SPLITS}, a AS (SELECT trace_id, count(*) FILTER (WHERE split) AS n FROM sp GROUP BY trace_id), b AS (SELECT trace_id, count(*) FILTER (WHERE depth <= 0 OR li / depth >= 3e0 AND ri / depth >= 3e0) AS n FROM vv GROUP BY trace_id)
SELECT trace_id, a.n AS splits, b.n AS strict_splits, a.n <> b.n AS differs FROM a JOIN b USING (trace_id)""")  # fmt: skip
def trc10(b):
    """Splits of every trace under two settings."""
    peaks = T.local_maxima(b.traces)
    count = lambda gap, ratio, n: T.valley_splits(b.traces, peaks, gap, ratio).groupBy("trace_id").agg(F.count_if("split").alias(n))
    rows = count(0.12, 1.7, "splits").join(count(0.0, 3.0, "strict_splits"), "trace_id")
    return rows.withColumn("differs", F.col("splits") != F.col("strict_splits"))


@query("mtx08_rt_corrected_preview", f"""
WITH {_MATRIX}, s AS (SELECT sample, median(rt_delta_sec) AS shift, count(rt_delta_sec) AS n FROM cells GROUP BY sample) SELECT mx.family_id, mx.sample, round(c.apex_rt - shift / 60, 6) AS corrected, CASE WHEN c.apex_rt IS NULL THEN 'no_peak' WHEN n < 20 THEN 'blocked' ELSE 'shadow' END AS status
FROM mx LEFT JOIN cells c ON c.family_id = mx.family_id AND c.sample = mx.sample JOIN s ON s.sample = mx.sample""")  # fmt: skip
def mtx08(b):
    shift = b.cells.groupBy("sample").agg(F.percentile("rt_delta_sec", 0.5).alias("shift"), F.count("rt_delta_sec").alias("n"))
    rows = matrix(b).select("family_id", "sample").join(b.cells.select("family_id", "sample", "apex_rt"), ["family_id", "sample"], "left").join(shift, "sample")
    return rows.select("family_id", "sample", F.round(F.col("apex_rt") - F.col("shift") / 60, 6).alias("corrected"), F.when(F.col("apex_rt").isNull(), "no_peak").when(F.col("n") < 20, "blocked").otherwise("shadow").alias("status"))
