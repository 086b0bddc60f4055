"""Peaks of traces: the local-minimum resolver, detection with recovery near a preferred RT, segments, boundaries and shapes.

Traces are in long form: (trace_id, idx, rt, intensity), idx from 0 without gaps. Candidates, a few rows for each trace, are read many times
and so are written tables; the traces themselves are read as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_of, flags
from ..functions.tables import by_runs, written
from . import traces as T


@dataclass(frozen=True)
class ResolverConfig:
    """Settings of the local-minimum resolver; the names of the fields say what they limit."""

    threshold_fraction: float = 0.1
    min_gap: float = 0.12
    min_ratio: float = 1.7
    least_scans: int = 2
    good_scans: int = 5
    min_minutes: float = 0.15
    max_minutes: float = 2.0
    min_height: float = 20.0
    min_relative: float = 0.05
    min_continuity: float = 0.5
    # The Savitzky-Golay resolver's own.
    smooth_window: int = 15
    smooth_order: int = 3
    min_prominence_ratio: float = 0.1
    relative_height: float = 0.95

    def relaxed(self) -> ResolverConfig:
        """What recovery near a preferred RT uses: a quarter of the relative and half of the absolute height, nearly no valleys, longer peaks."""
        return replace(self, min_relative=max(0.01, self.min_relative * 0.25), min_height=max(5.0, self.min_height * 0.5), min_ratio=min(self.min_ratio, 1.05), max_minutes=self.max_minutes * 1.5, min_prominence_ratio=max(0.01, self.min_prominence_ratio * 0.25))


#: Settings by name, for callers that choose one by its name.
PROFILES = {"default": ResolverConfig(), "relaxed": ResolverConfig().relaxed(), "strict": ResolverConfig(min_ratio=3.0, min_relative=0.1)}

#: Limits of merges: the gap between intervals in minutes, the gain in area, and the distance of apexes in minutes.
MERGE_GAP, MERGE_RATIO, MERGE_APEX = 0.08, 1.2, 0.03

Resolver = Callable[[DataFrame, ResolverConfig], DataFrame]


def resolve(traces: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Candidates of the local-minimum resolver: (trace_id, region, left, right, scans, apex_idx, apex_rt, apex_intensity, minutes, prominence,
    flags). A trace is cut at valleys; regions that are too low or too narrow go, and weak ones carry flags."""
    return resolved(traces, config).drop("continuity")


def resolved(traces: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Candidates of resolve() with the continuity of their points."""
    points = T.inside(traces, written(T.regions(traces, config.threshold_fraction, config.min_gap, config.min_ratio)))
    at = lambda f: f(F.struct("idx", "rt", "intensity"))
    rows = points.groupBy("trace_id", "region", "left", "right").agg(F.min(F.struct((-F.col("intensity")).alias("minus"), "idx", "rt")).alias("_a"), F.count("*").alias("scans"), at(F.min).alias("_l"), at(F.max).alias("_r"))
    rows = rows.select(
        "trace_id", "region", "left", "right", "scans", F.col("_a.idx").alias("apex_idx"), F.col("_a.rt").alias("apex_rt"), (-F.col("_a.minus")).alias("apex_intensity"),
        *[F.col(f"_{k[0]}.{c}").alias(f"_{k}_{n}") for k in ("left", "right") for c, n in (("rt", "rt"), ("intensity", "i"))],
    )
    rows = rows.join(T.continuity(points, ("trace_id", "region")), ["trace_id", "region"])
    rows = rows.join(traces.groupBy("trace_id").agg(F.max("intensity").alias("_top"), F.count("*").alias("_points")), "trace_id")
    minutes, edge, apex = F.col("_right_rt") - F.col("_left_rt"), F.greatest("_left_i", "_right_i"), F.col("apex_intensity")
    names = flags(
        ((F.col("left") == 0) | (F.col("right") == F.col("_points")), "edge_clipped"), (F.col("scans") < config.good_scans, "low_scan_support"), (minutes < config.min_minutes - 1e-9, "too_short"),
        (minutes > config.max_minutes + 1e-9, "too_broad"), ((edge > 0) & (apex / edge < config.min_ratio), "poor_edge_recovery"), (F.col("continuity") < config.min_continuity, "low_trace_continuity"),
    )
    kept = rows.where((F.col("scans") >= config.least_scans) & (minutes > 0) & (apex >= config.min_height) & (apex >= F.col("_top") * config.min_relative))
    own = ["trace_id", "region", "left", "right", "scans", "apex_idx", "apex_rt", "apex_intensity"]
    return kept.select(*own, minutes.alias("minutes"), F.greatest(F.lit(0.0), apex - edge).alias("prominence"), names.alias("flags"), "continuity")


def recovered(candidates: DataFrame, most: float = 0.35, least_share: float = 0.03) -> DataFrame:
    """Of relaxed candidates with a preferred_rt, the one nearest to it, if it is near enough and not too weak beside the trace's strongest."""
    own = W.partitionBy("trace_id")
    off = F.abs(F.col("apex_rt") - F.col("preferred_rt"))
    ranked = candidates.withColumns({"_off": off, "_n": F.row_number().over(own.orderBy(off, "region")), "_top": F.max("apex_intensity").over(own)})
    return ranked.where((F.col("_n") == 1) & (F.col("_off") <= most) & (F.col("apex_intensity") >= F.col("_top") * least_share)).drop("_off", "_n", "_top")


def detect_peaks(traces: DataFrame, preferred: DataFrame | None = None, config: ResolverConfig = ResolverConfig(), resolver: Resolver | str = "local_minimum", tolerance: float = 0.35) -> DataFrame:
    """A row for each trace: its status, the chosen peak, its area in counts times seconds, its flags and where it came from.

    preferred: (trace_id, preferred_rt). The strongest candidate near the preferred RT is chosen, without one there the strongest of all.
    Where the choice is missing or far from the preferred RT, the resolver runs once more with relaxed settings and may recover a peak there.
    resolver: local_minimum, savgol, or any function that gives the columns of resolve(). Statuses: OK, WINDOW_TOO_SHORT (under three points, or under savgol's window), NO_SIGNAL and
    PEAK_NOT_FOUND; without OK the peak's columns are null.
    """
    least, name = 3, "local_minimum" if resolver is resolve else resolver if isinstance(resolver, str) else getattr(resolver, "__name__", "resolver")
    if isinstance(resolver, str):
        if resolver not in ("local_minimum", "savgol"):
            raise ValueError(f"unknown resolver {resolver!r}")
        if resolver == "savgol":
            from .proposals import resolve_savgol

            least, resolver = max(3, config.smooth_window), resolve_savgol
        else:
            resolver = resolve
    facts = traces.groupBy("trace_id").agg(F.count("*").alias("_points"), F.max("intensity").alias("_top"))
    wanted = (facts.select("trace_id").withColumn("preferred_rt", F.lit(None).cast("double")) if preferred is None else preferred.select("trace_id", "preferred_rt"))
    facts = written(facts)
    usable = facts.where((F.col("_points") >= least) & (F.col("_top") > 0)).select("trace_id")
    own = traces.join(usable, "trace_id", "left_semi")
    candidates = written(resolver(own, config).join(wanted, "trace_id", "left"))
    near = F.coalesce(F.abs(F.col("apex_rt") - F.col("preferred_rt")) <= tolerance, F.lit(False))
    first = W.partitionBy("trace_id").orderBy((~near).cast("int"), F.desc("apex_intensity"), "apex_idx")
    chosen = candidates.withColumn("_near", near).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    asked = written(usable.join(wanted.where("preferred_rt IS NOT NULL"), "trace_id").join(chosen.where("_near").select("trace_id"), "trace_id", "left_anti"))
    relaxed = resolver(own.join(asked.select("trace_id"), "trace_id", "left_semi"), config.relaxed()).join(asked, "trace_id")
    back = written(recovered(relaxed, tolerance))
    columns = ["trace_id", "left", "right", "scans", "apex_idx", "apex_rt", "apex_intensity", "flags"]
    kept = chosen.join(back.select("trace_id"), "trace_id", "left_anti").select(*columns, F.lit(name).alias("source"))
    best = written(kept.unionByName(back.select(*columns, F.lit("preferred_rt_recovery").alias("source"))))
    area = T.trapezoid(T.inside(own, best.select("trace_id", "left", "right"), ("trace_id",)))
    status = first_of((F.col("_points") < least, "WINDOW_TOO_SHORT"), (F.col("_top") <= 0, "NO_SIGNAL"), (F.col("apex_idx").isNull(), "PEAK_NOT_FOUND"), otherwise="OK")
    return facts.join(best, "trace_id", "left").join(area, "trace_id", "left").select("trace_id", status.alias("status"), "source", *columns[1:], "area")


def prominences(traces: DataFrame, relative_height: float = 0.5) -> DataFrame:
    """(trace_id, idx, prominence, left_ip, right_ip, left, right) of local maxima: how far a peak rises above the higher of the lowest points
    on its way to a higher point on either side, and its width at a share of that below its top, interpolated and as whole points.

    A pass over a trace with a stack finds both ways for all its points; a trace is solved by one task."""

    def towards(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the last one before it that is higher (-1 if none), and the least value after that one."""
        before, least = np.empty(len(v), int), np.empty(len(v))
        stack: list[int] = []
        for i, x in enumerate(v.tolist()):
            low = x
            while stack and v[stack[-1]] <= x:
                low = min(low, least[stack.pop()])
            before[i], least[i] = stack[-1] if stack else -1, low
            stack.append(i)
        return before, least

    def solve(own: dict[str, np.ndarray]) -> list[tuple]:
        v = own["intensity"].astype(float)
        n, at = len(v), np.flatnonzero(own["is_peak"].astype(bool))
        before, low_left = towards(v)
        after, low_right = (x[::-1] for x in towards(v[::-1]))
        rows = []
        for p in at.tolist():
            prominence = v[p] - max(low_left[p], low_right[p])
            level = v[p] - prominence * relative_height
            left = before[p] + 1 + int(np.flatnonzero(v[before[p] + 1 : p + 1] <= level)[-1])
            right = p + int(np.flatnonzero(v[p : n - 1 - after[p]] <= level)[0])
            a = left + ((level - v[left]) / (v[left + 1] - v[left]) if v[left] < level else 0.0)
            z = right - ((level - v[right]) / (v[right - 1] - v[right]) if v[right] < level else 0.0)
            bounds = (max(0, int(np.floor(a))), min(n, int(np.ceil(z)) + 1)) if z > a else (p, min(n, p + 1))
            rows.append((own["trace_id"][0], p, prominence, a, z, *bounds))
        return rows

    marked = T.marked_maxima(traces).drop("rt")
    return by_runs(marked, ["trace_id"], "idx", solve, "trace_id int, idx int, prominence double, left_ip double, right_ip double, left int, right int")


def _running_area(traces: DataFrame) -> DataFrame:
    """(trace_id, idx, rt, intensity, area): the trapezoid area in value times seconds from the trace's start up to each point."""
    part = (F.col("rt") - F.lag("rt").over(T.ordered())) * (F.col("intensity") + F.lag("intensity").over(T.ordered())) / 2 * 60
    return traces.select("trace_id", "idx", "rt", "intensity", F.coalesce(part, F.lit(0.0)).alias("_p")).withColumn("area", F.sum("_p").over(T.upto())).drop("_p")


def _at(frame: DataFrame, place: str, *names: str) -> DataFrame:
    """Columns of the point at a place, named after both."""
    return frame.select("trace_id", F.col("idx").alias(place), *[F.col(n).alias(f"{place}_{n}") for n in names])


def boundary_hypotheses(traces: DataFrame, candidates: DataFrame) -> DataFrame:
    """(trace_id, region, apex_idx, left, right, sources, rt_left, rt_right, width, area, scans): ways to bound each candidate's peak, equal ones
    merged with the names of their sources: its own interval, half of its height above its edges, a twentieth of it, the unbroken descent on both
    sides and, where candidates have a wavelet_scale, as many points around the apex. right is exclusive. candidates: columns of resolve()."""
    size = traces.groupBy("trace_id").agg(F.count("*").alias("_n"))
    candidates = written(candidates)
    cut = candidates.select("trace_id", "region", "apex_idx", "left", (F.col("right") - 1).alias("last"), "apex_intensity")
    edged = cut.join(_at(traces, "left", "intensity"), ["trace_id", "left"]).join(_at(traces, "last", "intensity"), ["trace_id", "last"]).withColumn("_edge", F.greatest("left_intensity", "last_intensity"))
    edged = written(edged)

    def threshold(fraction: float, name: str, order: int) -> DataFrame:
        level = F.col("_edge") + (F.col("apex_intensity") - F.col("_edge")) * fraction
        levels = edged.where("apex_intensity > _edge").select("trace_id", F.col("apex_idx").alias("idx"), level.alias("level"))
        found = T.crossings(traces, levels.select("trace_id", "idx"), levels, inclusive=True).withColumnsRenamed({"idx": "apex_idx", "left": "_l", "right": "_r"})
        return edged.select("trace_id", "region", "apex_idx").join(found, ["trace_id", "apex_idx"]).join(size, "trace_id").select(
            "trace_id", "region", "apex_idx", F.coalesce("_l", F.lit(0)).alias("_left"), F.coalesce(F.col("_r") + 1, F.col("_n")).alias("_right"), F.struct(F.lit(order).alias("k"), F.lit(name).alias("name")).alias("_source")
        )

    value, by = F.col("intensity"), T.ordered()
    broken = traces.select("trace_id", "idx", (value <= F.lag("intensity").over(by)).alias("_up"), (value <= F.lead("intensity").over(by)).alias("_down"))
    start = F.last(F.when(F.col("_up"), F.col("idx")), ignorenulls=True).over(T.upto())
    stop = F.last(F.when(F.col("_down"), F.col("idx")), ignorenulls=True).over(W.partitionBy("trace_id").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0))
    slopes = broken.select("trace_id", F.col("idx").alias("apex_idx"), start.alias("_l"), stop.alias("_r"))
    descent = edged.select("trace_id", "region", "apex_idx").join(slopes, ["trace_id", "apex_idx"]).join(size, "trace_id").select(
        "trace_id", "region", "apex_idx", F.coalesce("_l", F.lit(0)).alias("_left"), F.coalesce(F.col("_r") + 1, F.col("_n")).alias("_right"), F.struct(F.lit(3).alias("k"), F.lit("derivative_zero_crossing").alias("name")).alias("_source")
    )
    own = candidates.select("trace_id", "region", "apex_idx", F.col("left").alias("_left"), F.col("right").alias("_right"), F.struct(F.lit(0).alias("k"), F.lit("candidate_interval").alias("name")).alias("_source"))
    every = own.unionByName(threshold(0.5, "half_height", 1)).unionByName(threshold(0.05, "baseline_return", 2)).unionByName(descent)
    if "wavelet_scale" in candidates.columns:
        points = F.greatest(F.lit(2), F.bround("wavelet_scale").cast("int"))
        start = F.col("apex_idx") - F.floor(points / 2).cast("int")
        source = F.struct(F.lit(4).alias("k"), F.lit("cwt_width").alias("name")).alias("_source")
        every = every.unionByName(candidates.where("wavelet_scale > 0").select("trace_id", "region", "apex_idx", start.alias("_left"), (start + points).alias("_right"), source))
    every = every.join(size, "trace_id")
    left = F.greatest(F.lit(0), F.least(F.col("_left"), F.col("_n") - 2))
    bounded = every.withColumn("left", left.cast("int")).withColumn("right", F.greatest(F.col("left") + 2, F.least(F.col("_right"), F.col("_n"))).cast("int"))
    merged = bounded.groupBy("trace_id", "region", "apex_idx", "left", "right").agg(F.array_sort(F.collect_list("_source"))["name"].alias("sources"))
    running = _running_area(traces)
    placed = merged.withColumn("last", F.col("right") - 1).join(_at(running, "left", "rt", "area"), ["trace_id", "left"]).join(_at(running, "last", "rt", "area"), ["trace_id", "last"])
    return placed.select(
        "trace_id", "region", "apex_idx", "left", "right", "sources", F.col("left_rt").alias("rt_left"), F.col("last_rt").alias("rt_right"), (F.col("last_rt") - F.col("left_rt")).alias("width"),
        (F.col("last_area") - F.col("left_area")).alias("area"), (F.col("right") - F.col("left")).alias("scans"),
    )


def boundary_score(baseline: Column, continuity: Column, scans: Column, width: Column, reference_width: Column, is_interval: Column) -> dict[str, Column]:
    """0 to 100 from the share of signal above the baseline, the trace's continuity, the scans and the width beside the candidate's own, with the
    labels that speak for and against the boundary."""
    known = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    ratio = F.when(reference_width > 0, width / reference_width)
    graded = [
        (first_of((~known(baseline), 0), (baseline >= 0.5, 20), (baseline >= 0.2, 5), otherwise=-20), first_of((~known(baseline), "baseline_unavailable"), (baseline >= 0.5, "baseline_supported"), (baseline >= 0.2, "baseline_partial"), otherwise="low_baseline_signal")),
        (first_of((~known(continuity), 0), (continuity >= 0.75, 15), otherwise=-15), first_of((~known(continuity), "trace_continuity_unavailable"), (continuity >= 0.75, "trace_continuity_ok"), otherwise="low_trace_continuity")),
        (first_of((scans >= 5, 10), (scans >= 3, 5), otherwise=-15), first_of((scans >= 5, "scan_support_ok"), (scans >= 3, "scan_support_minimal"), otherwise="low_scan_support")),
        (first_of((ratio.isNull(), 0), (ratio.between(0.5, 1.5), 5), ((ratio < 0.25) | (ratio > 2.0), -10), otherwise=0), first_of((ratio.isNull(), "width_reference_unavailable"), (ratio.between(0.5, 1.5), "width_near_candidate"), ((ratio < 0.25) | (ratio > 2.0), "width_extreme"), otherwise="width_shifted")),
    ]
    total = sum((points for points, _ in graded), F.lit(50))
    return {
        "score": F.least(F.lit(100), F.greatest(F.lit(0), total)),
        "support": F.array_compact(F.array(F.when(is_interval, F.lit("candidate_interval")), *[F.when(p > 0, label) for p, label in graded])),
        "concerns": F.array_compact(F.array(*[F.when(p <= 0, label) for p, label in graded])),
    }


def _region_facts(boundaries: DataFrame, least_scans: int, envelope: bool = False) -> DataFrame:
    """region_verdicts() with what it rests on: the current boundary c, source (how a merge is suggested), the supported intervals' number _k and
    widest gap _gap and, with envelope, their outermost _left and _right and the apex of the largest, _apex."""
    key = F.struct("score", "area", F.col("is_interval").cast("int").alias("own"), "boundary_id")
    best = lambda c: F.max(F.when(c, F.struct(key.alias("key"), "region", "boundary_id", "rt_left", "rt_right", "area", "scans", "score", *(["apex_rt", "left", "right"] if envelope else []))))
    boundaries = written(boundaries)
    current = boundaries.groupBy("trace_id").agg(F.coalesce(best(F.col("selected") & F.col("is_interval")), best(F.col("selected"))).alias("c"))
    rows = written(boundaries.join(current, "trace_id"))
    c = lambda n: F.col(f"c.{n}")
    enough = F.col("scans") >= least_scans
    ratio = F.when(c("area") <= 0, F.lit(float("inf"))).otherwise(F.round(F.col("area") / c("area"), 5))
    wide = enough & (F.col("region") == c("region")) & (F.col("boundary_id") != c("boundary_id")) & (F.col("score") >= c("score")) & (ratio >= 1.5)
    gap = F.col("rt_left") - F.lag("rt_right").over(W.partitionBy("trace_id").orderBy("rt_left", "boundary_id"))
    supported = F.col("is_interval") & enough
    gaps = boundaries.where(supported).select("trace_id", gap.alias("gap")).groupBy("trace_id").agg(F.round(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)), 5).alias("_gap"))
    facts = rows.groupBy("trace_id", "c").agg(
        F.count("*").alias("_n"), best(wide).alias("w"), F.max(F.when((F.col("region") != c("region")) & enough, F.col("score"))).alias("_neighbour"), F.max("score").alias("_top"),
        F.count_if(supported).alias("_k"), F.sum(F.when(supported, F.col("score"))).alias("_total"), F.sum(F.when(supported, F.col("area"))).alias("_area"),
        *([F.min(F.when(supported, F.col("left"))).alias("_left"), F.max(F.when(supported, F.col("right"))).alias("_right"), F.max_by("apex_rt", F.when(supported, F.struct("area", -F.col("rt_left")))).alias("_apex")] if envelope else []),
    )
    covered = rows.join(facts.select("trace_id", "w"), "trace_id").where((F.col("region") != c("region")) & F.col("apex_rt").between(F.col("w.rt_left"), F.col("w.rt_right"))).select("trace_id").distinct().withColumn("_covers", F.lit(True))
    whole = facts.join(gaps, "trace_id", "left").join(covered, "trace_id", "left")
    several = F.col("_k") >= 2
    gain = F.when(c("area") <= 0, F.lit(float("inf"))).otherwise(F.round(F.col("_area") / c("area"), 5))
    verdict = first_of(
        (F.col("c").isNull() | (c("scans") < least_scans) | (F.col("_n") == 1), "insufficient_evidence"), (F.col("_covers"), "merge_suggested"), (several & (F.col("_gap") <= MERGE_GAP) & (gain <= MERGE_RATIO), "merge_suggested"),
        (several & (F.col("_total") >= F.col("_top") + 20), "split_supported"), (F.col("_neighbour") >= c("score") + 15, "neighbor_apex_preferred"), (F.col("w").isNotNull(), "wider_boundary_preferred"), otherwise="current_supported",
    )
    status = first_of((F.col("c").isNull(), "skipped_no_candidate"), (c("scans") < least_scans, "skipped_low_scan_support"), otherwise="evaluated")
    suggested = F.when(F.col("verdict") == "merge_suggested", F.when(F.col("_covers"), "same_apex_wider_boundary_merge").otherwise("adjacent_wis_local_minimum_merge"))
    return whole.withColumn("status", status).withColumn("verdict", verdict).withColumn("source", suggested)


def region_verdicts(boundaries: DataFrame, least_scans: int = 3) -> DataFrame:
    """(trace_id, status, verdict): what the scored boundaries of a trace say about its selected candidate, by the first rule that holds: another
    boundary of it covers neighbours, adjacent intervals merge, several intervals beat it, a neighbour beats it, a wider boundary of it does.

    boundaries: trace_id, region, boundary_id, is_interval, selected, rt_left, apex_rt, rt_right, area, scans, score. Intervals of candidates
    don't overlap, so all with enough scans are the supported ones."""
    return _region_facts(boundaries, least_scans).select("trace_id", "status", "verdict")


def safe_merge(traces: DataFrame, boundaries: DataFrame, least_scans: int = 3) -> DataFrame:
    """(trace_id, verdict, outcome, reason, left, right, rt_left, rt_right, scans, area, area_ratio, intervals, gap): each trace's selected boundary,
    widened to the envelope of its adjacent intervals where the evidence allows it.

    boundaries: as for region_verdicts(), with left and right (exclusive). Only a suggested merge of adjacent intervals is eligible, if the gaps
    between them are small and the largest interval's apex is the selected one's, within MERGE_APEX. Then the envelope is integrated anew; its
    area must be 1 to MERGE_RATIO times the selected one's. outcome: promoted, rejected (a merge was suggested; reason says why not) or kept.
    """
    facts = _region_facts(boundaries, least_scans, envelope=True).where("c IS NOT NULL")
    running = _running_area(traces)
    rows = facts.withColumn("_last", F.col("_right") - 1).join(_at(running, "_left", "rt", "area"), ["trace_id", "_left"], "left").join(_at(running, "_last", "rt", "area"), ["trace_id", "_last"], "left")
    area = F.col("_last_area") - F.col("_left_area")
    ratio = F.when(F.col("c.area") > 0, area / F.col("c.area")).otherwise(float("inf"))
    apart = F.abs(F.col("c.apex_rt") - F.col("_apex")) > MERGE_APEX
    asked = F.col("verdict") == "merge_suggested"
    reason = first_of(
        (~asked, ""), (F.col("source") != "adjacent_wis_local_minimum_merge", "unsupported_merge_suggestion_source"), (F.col("_gap") > MERGE_GAP, "gap_exceeds_safe_merge_max"),
        (apart, "apex_delta_exceeds_safe_merge_max"), (~ratio.between(1.0, MERGE_RATIO), "promoted_area_ratio_outside_safe_merge_range"), otherwise="eligible",
    )
    told = rows.withColumn("reason", reason).withColumn("outcome", first_of((~asked, "kept"), (F.col("reason") == "eligible", "promoted"), otherwise="rejected"))
    taken = F.col("outcome") == "promoted"
    pick = lambda new, old: F.when(taken, new).otherwise(F.col(f"c.{old}")).alias(old)
    return told.select(
        "trace_id", "verdict", "outcome", "reason", pick(F.col("_left"), "left"), pick(F.col("_right"), "right"), pick(F.col("_left_rt"), "rt_left"), pick(F.col("_last_rt"), "rt_right"),
        F.when(taken, F.col("_right") - F.col("_left")).otherwise(F.col("c.scans")).alias("scans"), pick(area, "area"), F.when(taken, ratio).alias("area_ratio"),
        F.when(taken, F.col("_k")).alias("intervals"), F.when(taken, F.col("_gap")).alias("gap"),
    )


def segments(traces: DataFrame, least_scans: int = 3, least_apex: float = 5.0, apex_share: float = 0.05, return_share: float = 0.02, return_least: float = 1.0, clear_valley: float = 0.3) -> DataFrame:
    """(trace_id, segment, apex_idx, apex_rt, height, left, right, kind, stop, area): chromatographic peak segments of baseline-corrected traces.

    Apexes are local maxima of the smoothed trace (Gaussian over 15 points; shorter traces stay as they are). A segment ends where the smoothed
    trace returns to the baseline, or at the valley to the next apex; right is exclusive. The area is that of the trace itself."""
    size = F.count("*").over(W.partitionBy("trace_id"))
    smooth = T.weighted_neighbours(traces, T.gaussian_weights(15, 2.5), "zero").withColumn("_n", size)
    smooth = smooth.select("trace_id", "idx", "rt", F.when(F.col("_n") < 15, F.col("intensity")).otherwise(F.col("smoothed")).alias("intensity"))
    smooth = written(smooth)
    tops = smooth.groupBy("trace_id").agg(F.max("intensity").alias("_top"), F.count("*").alias("_n"))
    usable = tops.where((F.col("_n") >= least_scans) & (F.col("_top") > 0))
    seeds = written(T.local_maxima(smooth).join(usable, "trace_id").where(F.col("intensity") >= F.greatest(F.lit(least_apex), F.col("_top") * apex_share)).select("trace_id", "idx", "rt", "intensity", "_n"))
    levels = seeds.select("trace_id", "idx", F.greatest(F.lit(return_least), F.col("intensity") * return_share).alias("level"))
    ends = T.crossings(smooth, seeds, levels, inclusive=True).withColumnsRenamed({"left": "_l", "right": "_r"})
    valleys = T.valley_splits(smooth, seeds, 0.0, 0.0).select("trace_id", "left_peak", "right_peak", "valley").join(smooth.select("trace_id", F.col("idx").alias("valley"), F.col("intensity").alias("_v")), ["trace_id", "valley"])
    by = W.partitionBy("trace_id").orderBy("idx")
    numbered = seeds.withColumns({"segment": F.row_number().over(by), "_before": F.lag("intensity").over(by), "_after": F.lead("intensity").over(by)})
    left = valleys.select("trace_id", F.col("right_peak").alias("idx"), F.col("valley").alias("_lv"), F.col("_v").alias("_lvv"))
    right = valleys.select("trace_id", F.col("left_peak").alias("idx"), F.col("valley").alias("_rv"), F.col("_v").alias("_rvv"))
    rows = numbered.join(ends, ["trace_id", "idx"]).join(left, ["trace_id", "idx"], "left").join(right, ["trace_id", "idx"], "left")
    clear = lambda v, other: F.when(F.col(v).isNotNull(), F.col(v) / F.least("intensity", other) <= clear_valley)
    split, over = clear("_lvv", "_before"), clear("_rvv", "_after")
    rows = rows.withColumn("left", F.greatest(F.coalesce(F.col("_l") + 1, F.lit(0)), F.coalesce("_lv", F.lit(0))).cast("int"))
    rows = rows.withColumn("right", F.greatest(F.col("left") + 1, F.least(F.coalesce("_r", "_n"), F.coalesce(F.col("_rv") + 1, F.col("_n")))).cast("int"))
    shoulder, cut = F.coalesce(~split, F.lit(False)) | F.coalesce(~over, F.lit(False)), F.coalesce(split, F.lit(False)) | F.coalesce(over, F.lit(False))
    few = F.col("right") - F.col("left") < least_scans
    kind = first_of((few, "low_scan_segment"), (shoulder, "shoulder_candidate"), (cut, "separate_peak"), otherwise="isolated_peak")
    stop = first_of((few, "segment_too_few_scans"), (shoulder, "shoulder_overlap_review"), (cut, "baseline_valley_split"), otherwise="baseline_return")
    running = _running_area(traces)
    placed = rows.withColumn("last", F.col("right") - 1).join(_at(running, "left", "area"), ["trace_id", "left"]).join(_at(running, "last", "area"), ["trace_id", "last"])
    return placed.select("trace_id", "segment", F.col("idx").alias("apex_idx"), F.col("rt").alias("apex_rt"), F.col("intensity").alias("height"), "left", "right", kind.alias("kind"), stop.alias("stop"), (F.col("last_area") - F.col("left_area")).alias("area"))


def own_max_curve(rt: np.ndarray, intensity: np.ndarray, apex: float, half_window: float = 0.35, grid: int = 175, points: int = 15) -> np.ndarray:
    """A trace around an apex on an even grid, smoothed and over its own maximum; NaN where it has no points, everywhere if it has under three."""
    x = np.linspace(-half_window, half_window, grid)
    fine = np.isfinite(rt) & np.isfinite(intensity) & (np.abs(rt - apex) <= half_window)
    t, v = rt[fine] - apex, intensity[fine]
    if len(t) < 3:
        return np.full(grid, np.nan)
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    window = min(points, len(v)) - (min(points, len(v)) + 1) % 2
    if window >= 3:
        off = np.arange(window) - window // 2
        weight = np.exp(-0.5 * (off / (window / 6.0)) ** 2)
        v = np.convolve(np.pad(v, window // 2, mode="edge"), weight / weight.sum(), mode="valid")
    if v.max() <= 0:
        return np.full(grid, np.nan)
    return np.interp(x, t, v / v.max(), left=np.nan, right=np.nan)


def apex_curves(traces: DataFrame, apexes: DataFrame, half_window: float = 0.35, grid: int = 175) -> DataFrame:
    """(trace_id, region, curve): own_max_curve() around each apex (trace_id, region, apex_rt). Only points near an apex are sent to it."""

    def solve(own: dict[str, np.ndarray]) -> list[tuple]:
        curve = own_max_curve(own["rt"].astype(float), own["intensity"].astype(float), float(own["apex_rt"][0]), half_window, grid)
        return [(own["trace_id"][0], own["region"][0], curve.tolist())]

    from .joins import band_join

    wanted = apexes.select("trace_id", "region", "apex_rt")
    near = band_join(wanted, traces.select("trace_id", "rt", "intensity"), "apex_rt", "rt", half_window * 1.01, ["trace_id"], F.abs(F.col("rt") - F.col("apex_rt")) <= half_window)
    return by_runs(near, ["trace_id", "region"], "rt", solve, "trace_id int, region int, curve array<double>")


def shape_similarity(a: str, b: str, least: int = 5) -> Column:
    """Pearson's correlation of two curves over the places where both have values; null under `least` of them or without variation."""
    both = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    total = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda s, x: s + x)
    n = F.size(both).cast("double")
    sx, sy, sxx, syy, sxy = (total(f) for f in (lambda p: p["x"], lambda p: p["y"], lambda p: p["x"] * p["x"], lambda p: p["y"] * p["y"], lambda p: p["x"] * p["y"]))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= least) & (vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(vx * vy))
