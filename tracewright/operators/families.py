"""Order-dependent rules on families of aligned features: claims on peaks, folding of near duplicates, and merging before backfill.

Each rule takes rows in order of their m/z and puts one into a group only if it is compatible with every member, so that a chain of near rows
doesn't bridge its ends. Rows are cut into islands between m/z gaps wider than the tolerance; an island's rows stream by in one partition, and
only groups that the m/z hasn't left behind are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .traces import gap_islands

PRESENT = ("detected", "rescued")
Row = dict[str, Any]


def _ppm(left: float, right: float) -> float:
    return abs(left - right) / max(abs(left), 1e-12) * 1e6


def _known(value: Any) -> Any:
    """The value, None for the NaN that pandas has for null."""
    return None if value is None or value != value else value


def _streamed(rows: DataFrame, keys: list[str], mz: str, ppm: float, order: list[str], rule: Callable[[], Any], schema: str, tie: str) -> DataFrame:
    """Rows of each key in m/z islands, in order, through rule().take(row); rule().close() ends an island. Both give result rows."""
    step = ppm / 1e6 * 1.001
    cut = gap_islands(rows.withColumn("_log", F.log(mz)), keys, "_log", step, tie).drop("_log")
    own = [*keys, "island"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, state = None, rule()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in own)
                if key != island:
                    out += state.close()
                    island, state = key, rule()
                out += state.take(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if out := state.close():
            yield pd.DataFrame(out, columns=names)

    return cut.repartition(*own).sortWithinPartitions(*own, *order).mapInPandas(run, schema)


# --- Claims


@dataclass
class _Claim:
    """A group of claims that are all compatible, and the key of its best one."""

    members: list[Row] = field(default_factory=list)
    low: float = 0.0
    high: float = 0.0
    best: tuple = ()

    def add(self, row: Row) -> None:
        mz = row["center_mz"]
        self.low, self.high = (min(self.low, mz), max(self.high, mz)) if self.members else (mz, mz)
        self.members.append(row)
        self.best = min(self.best, row["_order"]) if self.best else row["_order"]


class _Claims:
    """Claims of a sample in order of m/z: each joins the compatible group with the best claim, or starts one."""

    def __init__(self, ppm: float, apex_sec: float, overlap: float) -> None:
        self.ppm, self.apex_sec, self.overlap, self.open = ppm, apex_sec, overlap, []

    def fits(self, a: Row, b: Row) -> bool:
        if _ppm(a["center_mz"], b["center_mz"]) > self.ppm or abs(a["apex_rt"] - b["apex_rt"]) * 60 > self.apex_sec:
            return False
        narrow = min(a["end_rt"] - a["start_rt"], b["end_rt"] - b["start_rt"])
        shared = min(a["end_rt"], b["end_rt"]) - max(a["start_rt"], b["start_rt"])
        return narrow > 0 and shared > 0 and shared / narrow >= self.overlap

    def take(self, row: Row) -> list[tuple]:
        delta = _known(row["rt_delta_sec"])
        row["_order"] = (
            row["review_only"], -row["detected"], -row["event_members"], -row["event_clusters"], row["status"] != "detected", float("inf") if delta is None else abs(delta), row["family_id"]
        )
        mz = row["center_mz"]
        past = [g for g in self.open if mz > g.high and _ppm(g.high, mz) > self.ppm]
        self.open = [g for g in self.open if not any(g is p for p in past)]
        fits = [g for g in self.open if all(self.fits(row, m) for m in g.members)]
        if fits:
            group = min(fits, key=lambda g: (*g.best, g.low, g.high))
        else:
            self.open.append(group := _Claim())
        group.add(row)
        return [x for g in past for x in self.told(g)]

    def close(self) -> list[tuple]:
        return [x for g in self.open for x in self.told(g)]

    @staticmethod
    def told(group: _Claim) -> list[tuple]:
        if len(group.members) < 2:
            return []
        live = [m for m in group.members if not m["review_only"]]
        winner = min(live, key=lambda m: m["_order"])["family_id"] if live else None
        return [(m["family_id"], m["sample"], winner) for m in group.members if m["family_id"] != winner]


def claims(cells: DataFrame, families: DataFrame, ppm: float = 5.0, apex_sec: float = 2.0, overlap: float = 0.5) -> DataFrame:
    """(family_id, sample, original_status, state, phase, winner) of every cell that claims a peak.

    cells: family_id, sample, status, area, apex_rt, start_rt, end_rt, rt_delta_sec; present ones with a finite area and peak claim it. families:
    family_id, center_mz, review_only, event_members, event_clusters; an id or sample pair must be unique.
    First, equal rounded peaks of a sample compete; then what is left competes in groups of which every two are within ppm, apex_sec and share
    at least `overlap` of the narrower window. A group's winner is no review-only family, and has most detected cells, event members and event
    clusters, then a detected cell, the smallest RT delta and the smallest id; all others become duplicates. Without any but review-only
    families, all become duplicates without a winner. state: kept, duplicate or review_only_duplicate; phase: exact, near or null.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    peak = ["area", "apex_rt", "start_rt", "end_rt"]
    fine = F.col("status").isin(*PRESENT)
    for c in peak:
        fine = fine & number(c)
    live = cells.where(fine).select("family_id", "sample", "status", "rt_delta_sec", *[F.col(c).cast("double").alias(c) for c in peak])
    detected = cells.groupBy("family_id").agg(F.count_if(F.col("status") == "detected").alias("detected"))
    rows = live.join(families.select("family_id", "center_mz", "review_only", "event_members", "event_clusters"), "family_id").join(detected, "family_id")
    key = ["sample", *[F.bround(c, 8) for c in ("apex_rt", "start_rt", "end_rt")], F.bround("area", 6)]
    order = F.struct(
        (-F.col("detected")).alias("a"), (-F.col("event_members")).alias("b"), (-F.col("event_clusters")).alias("c"), (F.col("status") != "detected").alias("d"),
        F.coalesce(F.abs("rt_delta_sec"), F.lit(float("inf"))).alias("e"), F.col("family_id").alias("family_id"),
    )
    same = W.partitionBy(*key)
    first = rows.select("*", F.count("*").over(same).alias("_n"), F.min(F.when(~F.col("review_only"), order)).over(same)["family_id"].alias("_winner"))
    lost = (F.col("_n") > 1) & ~F.col("family_id").eqNullSafe(F.col("_winner"))
    exact = first.where(lost).select("family_id", "sample", F.col("_winner").alias("winner"), F.lit("exact").alias("phase"))
    kind = families.schema["family_id"].dataType.simpleString()
    left = first.where(~lost).drop("_n", "_winner")
    near = _streamed(
        left, ["sample"], "center_mz", ppm, ["center_mz", "apex_rt", "family_id"], lambda: _Claims(ppm, apex_sec, overlap), f"family_id {kind}, sample string, winner {kind}", "family_id"
    ).withColumn("phase", F.lit("near"))
    state = F.when(F.col("phase").isNull(), "kept").when(F.col("winner").isNull(), "review_only_duplicate").otherwise("duplicate")
    told = live.join(exact.unionByName(near), ["family_id", "sample"], "left")
    return told.select("family_id", "sample", F.col("status").alias("original_status"), state.alias("state"), "phase", "winner")


# --- Folding


def _shares(a: set, b: set) -> tuple[int, float, float]:
    """Shared members, their share of the smaller set, and of the union."""
    shared = len(a & b)
    least, union = min(len(a), len(b)), len(a | b)
    return shared, shared / least if least else 0.0, shared / union if union else 0.0


@dataclass(frozen=True)
class FoldLimits:
    """How near families must be to fold."""

    ppm: float = 5.0
    rt_sec: float = 2.0
    product_ppm: float = 10.0
    loss_ppm: float = 10.0
    detected_overlap: float = 0.8
    shared_detected: int = 3
    detected_jaccard: float = 0.6
    present_overlap: float = 0.8


class _Folds:
    """Families of a tag in order of m/z: each joins the first group whose members it is all compatible with, or starts one."""

    def __init__(self, limits: FoldLimits) -> None:
        self.limits, self.open = limits, []

    def fits(self, a: Row, b: Row) -> bool:
        limits, slack = self.limits, 1e-9
        if abs(a["center_rt"] - b["center_rt"]) * 60 > limits.rt_sec + slack or _ppm(a["center_mz"], b["center_mz"]) > limits.ppm + slack:
            return False
        if _ppm(a["product_mz"], b["product_mz"]) > limits.product_ppm + slack or _ppm(a["loss_da"], b["loss_da"]) > limits.loss_ppm + slack:
            return False
        if a["signature"] is not None and b["signature"] is not None and a["signature"] != b["signature"]:
            return False
        shared, overlap, jaccard = _shares(a["detected"], b["detected"])
        if overlap < limits.detected_overlap or shared < limits.shared_detected or jaccard < limits.detected_jaccard:
            return False
        return _shares(a["present"], b["present"])[1] >= limits.present_overlap

    def take(self, row: Row) -> list[tuple]:
        row["detected"], row["present"], row["signature"] = set(row["detected"]), set(row["present"]), _known(row["signature"])
        past = [g for g in self.open if _ppm(row["center_mz"], g[0]["center_mz"]) > self.limits.ppm + 1e-9]
        self.open = [g for g in self.open if not any(g is p for p in past)]
        group = next((g for g in self.open if all(self.fits(row, m) for m in g)), None)
        if group is None:
            self.open.append(group := [])
        group.append(row)
        return [x for g in past for x in self.told(g)]

    def close(self) -> list[tuple]:
        return [x for g in self.open for x in self.told(g)]

    @staticmethod
    def told(group: list[Row]) -> list[tuple]:
        rank = lambda f: (not f["has_anchor"], -len(f["detected"]), -len(f["present"]), f["unchecked"], f["absent"], f["center_mz"], f["center_rt"], f["family_id"])
        first = min(group, key=rank)
        out = []
        for f in group:
            shared, _, jaccard = _shares(first["detected"], f["detected"])
            out.append((f["family_id"], first["family_id"], len(group), _ppm(first["center_mz"], f["center_mz"]), abs(first["center_rt"] - f["center_rt"]) * 60, shared, jaccard))
        return out


def folds(families: DataFrame, cells: DataFrame, limits: FoldLimits = FoldLimits()) -> DataFrame:  # noqa: B008
    """(family_id, primary, size, ppm, rt_sec, shared_detected, detected_jaccard): the primary of each family's group and how near it is to it.

    families: family_id, tag, center_mz, center_rt, product_mz, loss_da, has_anchor and, optionally, signature, which must not differ where both
    have one. In order of m/z, RT and id a family joins the first group of its tag of which every member is within the limits. Primary is the
    one with an anchor, most detected and present cells, fewest unchecked and absent ones, then the smallest m/z, RT and id.
    """
    status = F.col("status")
    held = cells.groupBy("family_id").agg(
        F.collect_set(F.when(status == "detected", F.col("sample"))).alias("detected"),
        F.collect_set(F.when(status.isin(*PRESENT), F.col("sample"))).alias("present"),
        F.count_if(status == "unchecked").alias("unchecked"),
        F.count_if(status == "absent").alias("absent"),
    )  # at most one for each sample of a run
    signature = F.col("signature") if "signature" in families.columns else F.lit(None).cast("string").alias("signature")
    rows = families.select("family_id", "tag", "center_mz", "center_rt", "product_mz", "loss_da", "has_anchor", signature).join(held, "family_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("detected", "present")} | {c: F.coalesce(c, F.lit(0)) for c in ("unchecked", "absent")})
    kind = families.schema["family_id"].dataType.simpleString()
    schema = f"family_id {kind}, primary {kind}, size int, ppm double, rt_sec double, shared_detected int, detected_jaccard double"
    return _streamed(rows, ["tag"], "center_mz", limits.ppm, ["center_mz", "center_rt", "family_id"], lambda: _Folds(limits), schema, "family_id")


def _cell_order() -> Column:
    """A secondary's cells: detected first, then by scan support, trace quality, RT delta, area and family."""
    quality = F.when(F.col("trace_quality") == "clean", 0).when(F.col("trace_quality") == "weak", 1).when(F.col("trace_quality") == "poor", 2).otherwise(3)
    return F.struct(
        (F.col("status") != "detected").alias("a"),
        (-F.coalesce("scan_support", F.lit(-1.0))).alias("b"),
        quality.alias("c"),
        F.coalesce(F.abs("rt_delta_sec"), F.lit(float("inf"))).alias("d"),
        F.when((F.col("area") > 0) & ~F.isnan("area"), -F.col("area")).otherwise(0.0).alias("e"),
        F.col("family_id").alias("family_id"),
    )


def folded_cells(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(family_id, sample, filled_from and the cells' other columns): a primary's cells; where it isn't present, the best present cell of its
    secondaries. cells may hold scan_support and trace_quality."""
    more = {c: F.lit(None).cast(t) for c, t in (("scan_support", "double"), ("trace_quality", "string")) if c not in cells.columns}
    rows = cells.withColumns(more).join(found.select("family_id", "primary"), "family_id")
    own, present = F.col("family_id") == F.col("primary"), F.col("status").isin(*PRESENT)
    rank = F.struct(F.when(own & present, 0).when(present, 1).otherwise(2).alias("rank"), _cell_order().alias("order"))
    best = rows.where(own | present).withColumn("_cell", F.struct(*[F.col(c) for c in cells.columns if c not in ("sample",)])).groupBy("primary", "sample").agg(F.min_by("_cell", rank).alias("c"))
    filled = F.when(F.col("c.family_id") != F.col("primary"), F.col("c.family_id")).alias("filled_from")
    return best.select(F.col("primary").alias("family_id"), "sample", filled, *[F.col("c")[c].alias(c) for c in cells.columns if c not in ("family_id", "sample")])


# --- Merging before backfill


@dataclass(frozen=True)
class MergeLimits:
    """How near families of disjoint samples must be to merge."""

    ppm: float = 50.0
    rt_sec: float = 180.0
    product_ppm: float = 20.0
    loss_ppm: float = 20.0


class _Merges:
    """Families of a tag in order of m/z: each joins the nearest group that it is compatible with, or starts one."""

    def __init__(self, limits: MergeLimits) -> None:
        self.limits, self.open = limits, []

    def fits(self, a: Row, b: Row) -> bool:
        limits = self.limits
        return (
            _ppm(a["center_mz"], b["center_mz"]) <= limits.ppm
            and abs(a["center_rt"] - b["center_rt"]) * 60 <= limits.rt_sec
            and _ppm(a["product_mz"], b["product_mz"]) <= limits.product_ppm
            and _ppm(a["loss_da"], b["loss_da"]) <= limits.loss_ppm
            and a["samples"].isdisjoint(b["samples"])
        )

    def take(self, row: Row) -> list[tuple]:
        row["samples"] = set(row["samples"])
        if row["review_only"]:
            return self.told([row])
        past = [g for g in self.open if _ppm(row["center_mz"], g[0]["center_mz"]) > self.limits.ppm]
        self.open = [g for g in self.open if not any(g is p for p in past)]
        near = lambda g: (min(_ppm(row["center_mz"], m["center_mz"]) for m in g), min(abs(row["center_rt"] - m["center_rt"]) for m in g), g[0]["family_id"])
        fits = [g for g in self.open if all(self.fits(row, m) for m in g)]
        if fits:
            min(fits, key=near).append(row)
        else:
            self.open.append([row])
        return [x for g in past for x in self.told(g)]

    def close(self) -> list[tuple]:
        return [x for g in self.open for x in self.told(g)]

    @staticmethod
    def told(group: list[Row]) -> list[tuple]:
        if len(group) == 1:
            f = group[0]
            return [(f["family_id"], f["family_id"], "alone", 1, f["owners"], f["center_mz"], f["center_rt"], f["product_mz"], f["loss_da"], f["has_anchor"], f["review_only"], [])]
        middle = median(f["center_rt"] for f in group)
        winner = min(group, key=lambda f: (-f["owners"], not f["has_anchor"], abs(f["center_rt"] - middle), f["family_id"]))["family_id"]
        centres = sorted({(f["center_rt"], f["center_mz"]) for f in group})
        seeds = [{"mz": mz, "rt": rt} for rt, mz in ([centres[0], centres[-1]] if len(centres) > 1 else centres)]
        values = [median(f[c] for f in group) for c in ("center_mz", "center_rt", "product_mz", "loss_da")]
        out = []
        for f in group:
            if f["family_id"] == winner:
                out.append((winner, winner, "winner", len(group), sum(m["owners"] for m in group), *values, any(m["has_anchor"] for m in group), False, seeds))
            else:
                out.append((f["family_id"], winner, "loser", len(group), f["owners"], f["center_mz"], f["center_rt"], f["product_mz"], f["loss_da"], f["has_anchor"], True, []))
        return out


def consolidated(families: DataFrame, owners: DataFrame, limits: MergeLimits = MergeLimits()) -> DataFrame:  # noqa: B008
    """(family_id, winner, state, family_count, owner_count, center_mz, center_rt, product_mz, loss_da, has_anchor, review_only, seeds) by family.

    families: family_id, tag, center_mz, center_rt, product_mz, loss_da, has_anchor, review_only; owners: (family_id, sample) of the peaks that
    make a family up. In order of m/z, RT, product, loss and id, a family joins the group, nearest in m/z and then RT, of which every member
    is within the limits and has none of its samples; review-only ones stay alone. Winner is the one with most owners, an anchor, the centre
    next to the group's median RT and the smallest id. It takes the medians, all owners, and the first and last centre by RT as seeds for
    backfill; the others become review-only.
    """
    held = owners.groupBy("family_id").agg(F.collect_set(F.col("sample").cast("string")).alias("samples"), F.count("*").alias("owners"))
    rows = families.select("family_id", "tag", "center_mz", "center_rt", "product_mz", "loss_da", "has_anchor", "review_only").join(held, "family_id", "left")
    rows = rows.withColumns({"samples": F.coalesce("samples", F.array().cast("array<string>")), "owners": F.coalesce("owners", F.lit(0))})
    kind = families.schema["family_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} double" for c in ("center_mz", "center_rt", "product_mz", "loss_da"))
    schema = f"family_id {kind}, winner {kind}, state string, family_count int, owner_count long, {numbers}, has_anchor boolean, review_only boolean, seeds array<struct<mz:double,rt:double>>"
    return _streamed(rows, ["tag"], "center_mz", limits.ppm, ["center_mz", "center_rt", "product_mz", "loss_da", "family_id"], lambda: _Merges(limits), schema, "family_id")


def recentred(found: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """consolidated() with the winners' centre at the mean RT of their present cells, where they have any, and the cells (family_id, sample,
    apex_rt, rt_delta_sec, status) with their RT deltas, in seconds, from these centres."""
    present = F.when(F.col("status").isin(*PRESENT), F.col("apex_rt"))
    means = cells.groupBy("family_id").agg(F.avg(present).alias("_mean"))
    centres = found.where("state = 'winner'").select("family_id").join(means, "family_id").where("_mean IS NOT NULL")
    rows = found.join(centres, "family_id", "left").withColumn("center_rt", F.coalesce("_mean", "center_rt")).drop("_mean")
    moved = cells.join(centres, "family_id", "left")
    delta = F.when(F.col("_mean").isNotNull() & F.col("apex_rt").isNotNull(), (F.col("apex_rt") - F.col("_mean")) * 60).otherwise(F.col("rt_delta_sec"))
    return rows, moved.withColumn("rt_delta_sec", delta).drop("_mean")
