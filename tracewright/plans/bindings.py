"""Domain views of the test tables, in SQL that Spark and DuckDB read alike.

Each view has the shape of one of the engine's inputs (points, traces, targets, owners, cells, trends), so that operators run on tables
whose size follows the test tables' scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # Trace points: one trace for each user, a point for each event.
    "traces": """
SELECT CAST(user_id AS INT) AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20e0 AS rt, value AS intensity FROM {events}""",
    # MS1 centroids of scans.
    "points": """
SELECT concat('S', l_suppkey % 10) AS sample, CAST(l_orderkey AS INT) AS scan_number, l_orderkey / 1000e0 AS rt,
  100e0 + l_partkey / 10e0 AS mz, l_extendedprice AS intensity FROM {lineitem}""",
    "scans": "SELECT DISTINCT sample, scan_number, rt FROM {points}",
    # MS2 scans, of which some could not be read, and their product ions.
    "ms2_scans": """
SELECT concat('S', o_custkey % 10) AS sample, CAST(o_orderkey AS INT) AS scan_number, o_orderkey / 1000e0 AS rt,
  CASE WHEN o_orderkey % 19 <> 0 THEN 220e0 + (o_custkey % 200) / 4e0 END AS precursor_mz,
  CASE WHEN o_orderkey % 19 = 0 THEN 'unreadable scan' END AS parse_error FROM {orders}""",
    "products": """
SELECT s.sample, s.scan_number, s.rt, s.precursor_mz, l_linenumber AS ion,
  s.precursor_mz - 116.0474e0 + (l_partkey % 9 - 4) * 0.0006e0 + CASE WHEN l_partkey % 4 = 0 THEN 0e0 ELSE 3e0 * (l_partkey % 4) END AS mz,
  l_extendedprice AS intensity FROM {lineitem} JOIN {ms2_scans} s ON l_orderkey = s.scan_number WHERE s.parse_error IS NULL""",
    # Targets with windows, internal standards and pairs.
    "targets": """
SELECT concat('T', p_partkey) AS label, 100e0 + p_partkey / 10e0 + 0.0004e0 AS mz, p_size / 8e0 AS rt_min, p_size / 8e0 + 2e0 AS rt_max, 20e0 AS ppm_tol,
  p_partkey % 80 = 0 AS is_istd, CASE WHEN p_partkey % 80 <> 0 THEN concat('T', p_partkey - p_partkey % 80) ELSE '' END AS istd_pair,
  CASE p_partkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'rna_containing' ELSE 'plasma' END AS sample_applicability,
  CASE WHEN p_partkey % 120 <> 40 THEN 116.0474e0 END AS neutral_loss_da
FROM {part}""",
    "neutral_tags": "SELECT 'dR' AS tag, 116.0474e0 AS loss_da, 1 AS tag_rank UNION ALL SELECT 'MeR', 119.0474e0, 2 UNION ALL SELECT 'R', 122.0474e0, 3",
    # Samples with roles and injection orders.
    "samples": """
SELECT concat(CASE s_suppkey % 6 WHEN 0 THEN 'QC_' WHEN 1 THEN 'Tumor_RNA_' WHEN 2 THEN 'normal' WHEN 3 THEN 'BenignFat_' WHEN 4 THEN 'Blank QC' ELSE 'Program-R-N-A_' END, s_suppkey) AS sample_name,
  CASE WHEN s_suppkey % 10 <> 9 THEN CAST((s_suppkey * 37) % 10007 AS INT) END AS injection_order,
  CASE WHEN s_suppkey % 6 IN (0, 4) THEN 'qc' ELSE 'study' END AS role, CAST(s_nationkey % 4 AS INT) AS batch, s_suppkey % 17 = 0 AS excluded FROM {supplier}""",
    # Retention times of standards by sample.
    "standards": """
SELECT sample_name, label, injection_order, 4e0 + k + ((s_suppkey * 13 + k * 7) % 23) / 100e0 AS rt, role FROM (
  SELECT s_suppkey, sample_name, injection_order, role FROM {samples} JOIN {supplier} ON s_suppkey = CAST(regexp_replace(sample_name, '^.*[^0-9]', '') AS BIGINT)
) q JOIN (SELECT n_nationkey AS k, concat('ISTD', n_nationkey) AS label FROM {nation} WHERE n_nationkey < 5) t ON (s_suppkey + k) % 7 <> 0""",
    # Results of targets in samples.
    "results": """
SELECT sample, label, is_istd, istd_pair, CASE WHEN g.u % 13 <> 0 THEN rt0 END AS rt, CASE WHEN g.u % 13 <> 0 THEN area0 END AS area,
  CASE WHEN u % 10 < 6 THEN 'HIGH' WHEN u % 10 < 8 THEN 'MEDIUM' WHEN u % 10 < 9 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence,
  CASE WHEN u % 7 < 3 THEN 'OK' WHEN u % 7 = 3 THEN 'NO_MS2' WHEN u % 7 = 4 THEN 'NL_FAIL' WHEN u % 7 = 5 THEN 'WARN_5' ELSE '' END AS nl, 0.1e0 + v / 100e0 AS fwhm,
  CASE WHEN v % 5 = 0 THEN 'low_scan_support;too_broad' WHEN v % 5 = 1 THEN 'low_trace_continuity' ELSE '' END AS flags
FROM (
  SELECT concat('S', l_suppkey % 20) AS sample, concat('T', l_partkey) AS label, min(l_quantity) / 8e0 + min(l_linenumber) / 50e0 AS rt0,
    max(l_extendedprice) AS area0, min(l_partkey * 7 + l_orderkey) % 100 AS u, max(l_orderkey) % 50 AS v
  FROM {lineitem} GROUP BY l_suppkey % 20, l_partkey
) g JOIN (SELECT label, is_istd, istd_pair FROM {targets}) t USING (label)""",
    # Peaks of single samples that a cross-sample alignment links.
    "owners": """
SELECT o_orderkey AS owner_id, concat('S', o_custkey % 12) AS sample, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE concat('tag', o_orderkey % 5) END AS tag,
  200e0 + (o_orderkey % 1000) / 2e0 + (o_custkey % 5) * 0.001e0 AS precursor_mz, 2e0 + (o_orderkey % 1000) / 50e0 + (o_custkey % 9) * 0.12e0 AS apex_rt,
  83.9526e0 + (o_orderkey % 1000) / 2e0 + (o_custkey % 7) * 0.001e0 AS product_mz, 116.0474e0 + (o_custkey % 3) * 0.0004e0 AS observed_loss,
  o_totalprice AS area, CAST(o_custkey % 101 AS INT) AS evidence_score, CAST(1 + o_custkey % 4 AS INT) AS seed_event_count, o_custkey % 29 = 0 AS identity_conflict FROM {orders}""",
    # Candidates of discovery.
    "candidates": """
SELECT o_orderkey AS candidate_id, concat('S', o_custkey % 12) AS sample, concat('tag', o_orderkey % 4) AS tag, o_custkey % 5 <> 0 AS ms1_peak_found,
  CAST(1 + o_orderkey % 4 AS INT) AS seed_event_count, CASE WHEN o_custkey % 6 <> 0 THEN (o_custkey % 60 - 30) / 100e0 END AS ms1_seed_delta_min,
  o_totalprice AS product_max_intensity, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice * 40 END AS ms1_area,
  CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 11) / 10e0 END AS scan_support, CASE o_custkey % 4 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'poor' WHEN 2 THEN 'clean' ELSE 'fair' END AS trace_quality,
  CASE o_orderkey % 3 WHEN 0 THEN 'scan_precursor' WHEN 1 THEN 'product_plus_neutral_loss' ELSE 'mixed' END AS mz_basis FROM {orders}""",
    # MS2 events that seed features.
    "seeds": """
SELECT l_orderkey * 10 + l_linenumber AS seed_id, concat('S', l_suppkey % 10) AS sample, concat('tag', l_partkey % 3) AS tag, l_orderkey / 1000e0 AS rt, CAST(l_orderkey AS INT) AS scan_number,
  300e0 + (l_partkey % 50) AS precursor_mz, 183.9526e0 + (l_partkey % 50) AS product_mz, 116.0474e0 AS loss_da, l_extendedprice AS intensity, l_discount * 100 AS loss_error_ppm,
  CASE WHEN l_linenumber % 3 = 0 THEN 'product_plus_neutral_loss' ELSE 'scan_precursor' END AS mz_basis FROM {lineitem}""",
    # Families of aligned features, of which four in a row nearly coincide, and their cells. Five parts make a family.
    "cells": """
SELECT concat('F', f) AS family_id, concat('S', s) AS sample, CASE WHEN v < 9 THEN 'detected' WHEN v < 13 THEN 'rescued' WHEN v < 15 THEN 'absent' WHEN v < 16 THEN 'unchecked' WHEN v < 17 THEN 'duplicate_assigned' WHEN v < 18 THEN 'ambiguous_ms1_owner' ELSE 'odd' END AS status,
  CASE WHEN v % 8 <> 7 THEN area END AS area, 2e0 + (f % 300) / 20e0 + dt / 500e0 AS apex_rt, CASE WHEN v <> 11 THEN area / 30 END AS height,
  2e0 + (f % 300) / 20e0 + dt / 500e0 - 0.1e0 AS start_rt, 2e0 + (f % 300) / 20e0 + dt / 500e0 + 0.15e0 AS end_rt, CASE WHEN v <> 12 THEN dt * 3e0 - 90e0 END AS rt_delta_sec
FROM (SELECT CAST(floor(l_partkey / 5e0) AS INT) AS f, l_suppkey % 25 AS s, max(l_extendedprice) AS area, min(l_orderkey) % 20 AS v, max(l_orderkey) % 60 AS dt FROM {lineitem} GROUP BY CAST(floor(l_partkey / 5e0) AS INT), l_suppkey % 25) g""",
    "families": """
SELECT concat('F', f) AS family_id, concat('tag', g % 4) AS tag, 200e0 + g % 4999 / 10e0 + f % 4 * 0.0006e0 AS center_mz, 2e0 + g * 8 % 401 / 10e0 + f % 4 * 0.02e0 AS center_rt,
  83.9526e0 + g % 4999 / 10e0 + f % 3 * 0.0003e0 AS product_mz, 116.0474e0 AS loss_da,
  CASE f % 6 WHEN 0 THEN 'single_sample_local_owner' WHEN 1 THEN 'owner_complete_link:3' WHEN 2 THEN 'owner_identity' WHEN 3 THEN 'cid_nl_only' WHEN 4 THEN '' ELSE 'folded' END AS evidence, f % 2 = 0 AS has_anchor
FROM (SELECT DISTINCT CAST(floor(l_partkey / 5e0) AS INT) AS f, CAST(floor(l_partkey / 20e0) AS INT) AS g FROM {lineitem}) x""",
    # Standards of an instrument's runs over injections.
    "trends": """
SELECT concat('R', o_orderkey) AS sample_name, concat('C', o_custkey % 6) AS compound, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey AS INT) END AS injection_order,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'not_detected' ELSE 'detected' END AS status,
  CASE WHEN o_custkey % 11 <> 0 THEN 5e0 + o_custkey % 6 + (o_orderkey % 97) / 200e0 END AS apex_rt, CASE WHEN o_custkey % 13 <> 0 THEN o_totalprice END AS area, 0.1e0 + (o_orderkey % 31) / 100e0 AS width,
  CASE WHEN o_custkey % 4 <> 0 THEN (o_orderkey % 140 - 70) / 100e0 END AS rt_delta_to_reference, CASE WHEN o_custkey % 5 <> 0 THEN (o_orderkey % 25) / 10e0 END AS width_ratio_to_reference FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text))})


def as_ctes(sql: str) -> str:
    """The SQL with the views that it names put before it as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\w+", text)):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    bare = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = ",\n".join(f"{n} AS ({bare(VIEWS[n])})" for n in order)
    sql = sql.strip()
    if not ctes:
        return sql
    for start in ("WITH RECURSIVE", "WITH"):
        if sql.startswith(start):
            return f"{start} {ctes},\n{sql[len(start) :]}"
    return f"WITH {ctes}\n{sql}"
