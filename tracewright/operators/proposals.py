"""Further ways to propose peaks: a Savitzky-Golay resolver, and ridges of a continuous wavelet transform."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written
from . import peaks as P
from . import traces as T


# --- Savitzky-Golay


def polynomial_fit(window: int, order: int) -> list[list[float]]:
    """Row k: the weights of a window's values that give the k-th value of their least-squares polynomial."""
    if window % 2 != 1 or not 0 <= order < window:
        raise ValueError("the window must be odd and the order below it")
    x = np.arange(window) - window // 2
    powers = np.vander(x, order + 1, increasing=True).astype(float)
    return (powers @ np.linalg.pinv(powers)).tolist()


def savgol(traces: DataFrame, window: int, order: int) -> DataFrame:
    """`smoothed`: the value of the polynomial through the window around each point; within half a window of an end, of the one through the first
    or last window. Null in traces shorter than the window."""
    fit, half = polynomial_fit(window, order), window // 2
    along, back = T.whole_trace(), W.partitionBy("trace_id").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = F.array(*[F.array(*[F.lit(w) for w in row]) for row in fit])

    def fitted(place: Column, value) -> Column:
        terms = [F.get(F.get(table, place), F.lit(j)) * value(j) for j in range(window)]
        return sum(terms[1:], terms[0])

    size = F.count("*").over(W.partitionBy("trace_id"))
    held = traces.withColumn("_n", size).withColumn("_first", F.when(F.col("idx") < half, F.array(*[F.nth_value("intensity", j + 1).over(along) for j in range(window)])))
    held = held.withColumn("_last", F.when(F.col("idx") >= F.col("_n") - half, F.array(*[F.nth_value("intensity", window - j).over(back) for j in range(window)])))
    middle = sum((F.lag("intensity", half - j).over(T.ordered()) * fit[half][j] for j in range(1, window)), F.lag("intensity", half).over(T.ordered()) * fit[half][0])
    start = fitted(F.col("idx").cast("int"), lambda j: F.get("_first", F.lit(j)))
    stop = fitted((F.col("idx") - F.col("_n") + window).cast("int"), lambda j: F.get("_last", F.lit(j)))
    value = F.when(F.col("_n") < window, F.lit(None)).when(F.col("idx") < half, start).when(F.col("idx") >= F.col("_n") - half, stop).otherwise(middle)
    return held.withColumn("smoothed", value).select(*traces.columns, "smoothed")


def resolve_savgol(traces: DataFrame, config: P.ResolverConfig = P.ResolverConfig()) -> DataFrame:
    """Candidates like those of resolve(), from maxima of the smoothed trace whose prominence reaches a share of its highest value and three
    times the noise of what smoothing takes away. They are as wide as the smoothed peak at the relative height; apex_idx is the smoothed apex and
    apex_intensity the highest value between the bounds. Traces shorter than the window have none."""
    smooth = written(savgol(traces, config.smooth_window, config.smooth_order).where("smoothed IS NOT NULL"))
    noise = T.residual_mad(smooth.select("trace_id", "idx", "rt", (F.col("intensity") - F.col("smoothed")).alias("intensity"))).select("trace_id", "noise_floor")
    tops = smooth.groupBy("trace_id").agg(F.max("smoothed").alias("_top"), F.max("idx").alias("_last"), F.min_by("idx", "idx").alias("_0"))
    limits = tops.join(noise, "trace_id").where("_top > 0").select("trace_id", "_last", F.greatest(F.col("_top") * config.min_prominence_ratio, "noise_floor").alias("_least"))
    shape = smooth.select("trace_id", "idx", "rt", F.col("smoothed").alias("intensity"))
    found = P.prominences(shape, config.relative_height).join(limits, "trace_id").where("prominence >= _least AND idx > 0 AND idx < _last AND prominence > 0")
    by = W.partitionBy("trace_id").orderBy("idx")
    # The first value of a trace that only falls is the fallback of local_maxima(), and a plateau at an end is no peak.
    regions = written(found.select("trace_id", F.row_number().over(by).alias("region"), F.col("idx").alias("apex_idx"), "left", "right", "prominence"))
    raw = T.inside(traces, regions.select("trace_id", "region", "left", "right")).groupBy("trace_id", "region").agg(F.max("intensity").alias("apex_intensity"))
    at = lambda k, shift: traces.select("trace_id", (F.col("idx") + shift).alias(k), F.col("rt").alias(f"_{k}_rt"))
    rows = regions.join(raw, ["trace_id", "region"]).join(at("left", 0), ["trace_id", "left"]).join(at("right", 1), ["trace_id", "right"])
    rows = rows.join(traces.select("trace_id", F.col("idx").alias("apex_idx"), F.col("rt").alias("apex_rt")), ["trace_id", "apex_idx"])
    return rows.select(
        "trace_id", "region", "left", "right", (F.col("right") - F.col("left")).cast("long").alias("scans"), "apex_idx", "apex_rt", "apex_intensity",
        (F.col("_right_rt") - F.col("_left_rt")).alias("minutes"), "prominence", F.array().cast("array<string>").alias("flags"),
    )


# --- Wavelets


@dataclass(frozen=True)
class WaveletConfig:
    """Least scans of a peak, which set the smallest width and the least length of a ridge; longest peak in minutes; least signal to noise."""

    least_scans: int = 5
    max_minutes: float = 2.0
    min_snr: float = 1.0


def ricker(points: int, width: float) -> np.ndarray:
    """The second derivative of a Gaussian, with energy 1, at so many points around its middle."""
    x = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - x**2) * np.exp(-(x**2) / 2)


def widths_of(rt: np.ndarray, config: WaveletConfig) -> np.ndarray:
    """The widths, in points, that a peak of the trace may have."""
    steps = np.diff(rt)
    steps = steps[steps > 0]
    if not len(steps):
        return np.zeros(0, int)
    least = max(1, config.least_scans // 2)
    most = min(max(least, int(np.ceil(config.max_minutes / np.median(steps)))), max(least, len(rt) // 2))
    return np.arange(least, most + 1)


def transform(v: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Row by width: the trace's product with the wavelet at each point; beyond the ends the trace is 0."""
    return np.stack([np.convolve(v, ricker(int(min(10 * w, len(v))), w), mode="same") for w in widths])


def ridges(strength: np.ndarray, widths: np.ndarray) -> list[list[tuple[int, int]]]:
    """Lines of maxima through the widths, as (width number, point), from the widest down. A line goes on at the nearest maximum within a quarter of
    the width, and ends after more widths without one than the smallest width has points; maxima that no line takes begin one."""
    tops = (strength[:, 1:-1] > strength[:, :-2]) & (strength[:, 1:-1] > strength[:, 2:])
    done: list[list[tuple[int, int]]] = []
    live: list[list[tuple[int, int]]] = []
    for row in range(len(widths) - 1, -1, -1):
        own = np.flatnonzero(tops[row]) + 1
        ends = np.array([line[-1][1] for line in live])
        fresh = []
        for c in own.tolist():
            k = int(np.argmin(np.abs(ends - c))) if len(ends) else -1
            if k >= 0 and abs(int(ends[k]) - c) <= widths[row] / 4 and live[k][-1][0] != row:
                live[k].append((row, c))
            else:
                fresh.append([(row, c)])
        live += fresh
        kept = [line for line in live if line[-1][0] - row <= widths[0]]
        done += [line for line in live if line[-1][0] - row > widths[0]]
        live = kept
    return done + live


def ridge_peaks(rt: np.ndarray, v: np.ndarray, config: WaveletConfig) -> tuple[np.ndarray, np.ndarray]:
    """The points at which ridges of sufficient length and strength end, and the widths."""
    widths = widths_of(rt, config)
    if len(v) < max(config.least_scans, 3) or not len(widths) or v.max() <= 0:
        return np.zeros(0, int), widths
    strength = transform(v, widths)
    least = max(1, min(len(widths), config.least_scans) // 2)
    reach = int(np.ceil(len(v) / 20))
    found = set()
    for line in ridges(strength, widths):
        row, c = line[-1]
        near = strength[0, max(0, c - reach // 2) : c + reach // 2 + reach % 2]
        noise = np.percentile(near, 10)
        if len(line) >= least and abs(strength[row, c] / noise if noise else np.inf) >= config.min_snr:
            found.add(c)
    return np.array(sorted(found), int), widths


def wavelet_peaks(traces: DataFrame, config: WaveletConfig = WaveletConfig()) -> DataFrame:
    """(trace_id, idx, widths): points where ridges of the trace's wavelet transform end, and the least and greatest width tried. One task solves a
    trace."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        found, widths = ridge_peaks(own.rt.to_numpy(float), own.intensity.to_numpy(float), config)
        return pd.DataFrame({"trace_id": own.trace_id.iloc[0], "idx": own.idx.to_numpy()[found], "least": int(widths.min(initial=1)), "most": int(widths.max(initial=1))})

    return traces.select("trace_id", "idx", "rt", "intensity").groupBy("trace_id").applyInPandas(solve, "trace_id int, idx int, least int, most int")


def wavelet_candidates(traces: DataFrame, config: WaveletConfig = WaveletConfig(), resolver: P.ResolverConfig = P.ResolverConfig()) -> DataFrame:
    """(trace_id, apex_idx, apex_rt, apex_intensity, left, right, scale): a candidate for each ridge, at the local maximum next to its end (within the
    smallest width), as wide as that peak at the relative height; scale is the width next to its points. Low ones go."""
    ends = wavelet_peaks(traces, config)
    tops = written(P.prominences(traces, resolver.relative_height).select("trace_id", F.col("idx").alias("apex_idx"), "left", "right"))
    off = F.abs(F.col("apex_idx") - F.col("idx"))
    near = ends.join(tops, "trace_id").where(off <= F.col("least")).groupBy("trace_id", "idx").agg(F.min_by(F.struct("apex_idx", "left", "right", "least", "most"), F.struct(off, F.col("apex_idx"))).alias("c"))
    one = near.select("trace_id", "c.*").distinct()
    height = traces.groupBy("trace_id").agg(F.max("intensity").alias("_top"))
    rows = one.join(traces.select("trace_id", F.col("idx").alias("apex_idx"), F.col("rt").alias("apex_rt"), F.col("intensity").alias("apex_intensity")), ["trace_id", "apex_idx"]).join(height, "trace_id")
    kept = rows.where((F.col("right") > F.col("left")) & (F.col("apex_intensity") >= resolver.min_height) & (F.col("apex_intensity") >= F.col("_top") * resolver.min_relative))
    scale = F.greatest("least", F.least("most", F.col("right") - F.col("left"))).cast("double")
    return kept.select("trace_id", "apex_idx", "apex_rt", "apex_intensity", "left", "right", scale.alias("scale"))


def with_scales(candidates: DataFrame, proposals: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Candidates with the scale of the nearest wavelet candidate whose apex lies within the tolerance, else null: what boundary_hypotheses() takes as
    a further source."""
    off = F.abs(F.col("apex_rt") - F.col("_rt"))
    near = candidates.select("trace_id", "region", "apex_rt").join(proposals.select("trace_id", F.col("apex_rt").alias("_rt"), "scale"), "trace_id").where(off <= tolerance)
    best = near.groupBy("trace_id", "region").agg(F.min_by("scale", F.struct(off, F.col("_rt"))).alias("wavelet_scale"))
    return candidates.join(best, ["trace_id", "region"], "left")
