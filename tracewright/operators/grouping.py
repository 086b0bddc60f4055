"""Order-dependent grouping.

The rules assign rows in a fixed order to the first group that takes them, so they are no equivalence relations. Data are cut where no
group can cross: into islands between gaps that are wider than the rule allows, or into the components of the pairs that may share a group.
Each island is then grouped by the rule itself. Where gaps never open, an island is long; then its rows stream by, and only the groups that may
still take rows are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite
from . import edges as ED
from .graph import components
from .traces import gap_islands


class _Group:
    """A group of seeds: its first row's id, its last RT, and the least and greatest value of each compared column."""

    __slots__ = ("name", "last", "low", "high")

    def __init__(self, name: int, rt: float, values: tuple[float, ...]) -> None:
        self.name, self.last, self.low, self.high = name, rt, values, values

    def fits(self, values: tuple[float, ...], ppm: float) -> bool:
        # The relative difference to a member grows away from the value, so that the outermost members decide.
        return all(m > 0 and abs(v - m) / m * 1e6 <= ppm for ends in (self.low, self.high) for v, m in zip(values, ends, strict=True))

    def take(self, rt: float, values: tuple[float, ...]) -> None:
        self.last, self.low, self.high = rt, tuple(map(min, self.low, values)), tuple(map(max, self.high, values))


def group_seeds(seeds: DataFrame, gap: float, ppm: float) -> DataFrame:
    """(seed_id, group_id): seeds of one sample and tag join the first group whose last RT is within the gap and whose members all fit in m/z,
    product and loss, else start one, named by its first seed.

    Rows of an island lie in one partition in the order of their RT, so that a group whose last RT is further back than the gap is closed;
    only open ones are held.
    """
    step = ppm / 1e6 * 1.001
    kind = seeds.schema["seed_id"].dataType.simpleString()
    # Neighbours in m/z that are further apart than the tolerance share no group; the logarithm makes the tolerance one width.
    by_mz = gap_islands(seeds.withColumn("_log", F.log("precursor_mz")), ["sample", "tag"], "_log", step, "seed_id").withColumnRenamed("island", "_mz")
    rows = gap_islands(by_mz, ["sample", "tag", "_mz"], "rt", gap, "seed_id").withColumnRenamed("island", "_rt")
    keys, compared = ["sample", "tag", "_mz", "_rt"], ["precursor_mz", "product_mz", "loss_da"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, groups = None, []
        for batch in batches:
            names = []
            columns = [batch[c].tolist() for c in (*keys, "seed_id", "rt", *compared)]
            for *own, seed, rt, mz, product, loss in zip(*columns, strict=True):
                if own != island:
                    island, groups = own, []
                groups = [g for g in groups if rt - g.last <= gap]
                values = (mz, product, loss)
                group = next((g for g in groups if g.fits(values, ppm)), None)
                if group is None:
                    groups.append(group := _Group(seed, rt, values))
                group.take(rt, values)
                names.append(group.name)
            yield pd.DataFrame({"seed_id": batch["seed_id"], "group_id": names})

    placed = rows.select(*keys, "seed_id", "rt", "scan_number", *compared).repartition(*keys).sortWithinPartitions(*keys, "rt", "scan_number", "precursor_mz", "seed_id")
    return placed.mapInPandas(place, f"seed_id {kind}, group_id {kind}")


def shared_peaks(candidates: DataFrame, mz_ppm: float, product_ppm: float, loss_ppm: float) -> DataFrame:
    """(group_id, sample, candidates, representative, events, seed_min, seed_max, intensity): candidates of a sample merged one after the other, in
    the order of their ids, into the first merged one that shares their MS1 peak.

    Two share a peak if their m/z and, with one tag, their products and losses are near, their peaks overlap and the seeds of each touch the
    other's peak. A merged candidate spans the seeds of both; the stronger product (then the smaller loss error, earlier seed, smaller id) represents
    it. Candidates without peak bounds stay alone. Only candidates whose peaks chain by overlap, within one m/z island, can merge: these
    islands are placed in one partition each and stream by.

    candidates: candidate_id, sample, tag, precursor_mz, product_mz, loss_da, start_rt, end_rt, seed_min, seed_max, intensity, events, loss_ppm.
    """
    step = mz_ppm / 1e6 * 1.001
    by_mz = gap_islands(candidates.withColumn("_log", F.log("precursor_mz")), ["sample"], "_log", step, "candidate_id").withColumnRenamed("island", "_mz")
    own = W.partitionBy("sample", "_mz").orderBy("start_rt", "candidate_id")
    reach = F.max("end_rt").over(own.rowsBetween(W.unboundedPreceding, -1))
    cut = by_mz.withColumn("_new", F.coalesce((F.col("start_rt") > reach).cast("int"), F.lit(1)))
    rows = cut.withColumn("_rt", F.sum("_new").over(own))
    names = ["candidate_id", "tag", "precursor_mz", "product_mz", "loss_da", "start_rt", "end_rt", "seed_min", "seed_max", "intensity", "events", "loss_ppm"]
    within = lambda a, b, ppm: b > 0 and abs(a - b) / abs(b) * 1e6 <= ppm
    touches = lambda a, b: a["seed_min"] <= b["end_rt"] and a["seed_max"] >= b["start_rt"]

    def shares(a: dict, b: dict) -> bool:
        near = within(a["precursor_mz"], b["precursor_mz"], mz_ppm) and max(a["start_rt"], b["start_rt"]) <= min(a["end_rt"], b["end_rt"]) and touches(a, b) and touches(b, a)
        return near and a["tag"] == b["tag"] and within(a["product_mz"], b["product_mz"], product_ppm) and within(a["loss_da"], b["loss_da"], loss_ppm)

    def merged(a: dict, b: dict) -> dict:
        first = min((a, b), key=lambda x: (-x["intensity"], abs(x["loss_ppm"]), x["seed_min"], x["candidate_id"]))
        return first | {
            "group": a["group"], "n": a["n"] + 1, "events": a["events"] + b["events"], "seed_min": min(a["seed_min"], b["seed_min"]), "seed_max": max(a["seed_max"], b["seed_max"]), "intensity": max(a["intensity"], b["intensity"]),
        }

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, held, closed = None, [], []

        def told(groups: list[dict]) -> pd.DataFrame:
            rows = [(g["group"], g["sample"], g["n"], g["candidate_id"], g["events"], g["seed_min"], g["seed_max"], g["intensity"]) for g in groups]
            return pd.DataFrame(rows, columns=["group_id", "sample", "candidates", "representative", "events", "seed_min", "seed_max", "intensity"])

        for batch in batches:
            for row in batch.to_dict("records"):
                key = (row["sample"], row["_mz"], row["_rt"])
                if key != island:
                    closed += held
                    island, held = key, []
                row |= {"group": row["candidate_id"], "n": 1}
                bounded = row["start_rt"] is not None and row["start_rt"] <= row["end_rt"]
                at = next((k for k, g in enumerate(held) if shares(g, row)), None) if bounded else None
                if at is None:
                    held.append(row)
                else:
                    held[at] = merged(held[at], row)
            if closed:
                yield told(closed)
                closed = []
        if held:
            yield told(held)

    kind = candidates.schema["candidate_id"].dataType.simpleString()
    placed = rows.select("sample", "_mz", "_rt", *names).repartition("sample", "_mz", "_rt").sortWithinPartitions("sample", "_mz", "_rt", "candidate_id")
    return placed.mapInPandas(place, f"group_id {kind}, sample string, candidates long, representative {kind}, events long, seed_min double, seed_max double, intensity double")


def complete_link(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner_id, group_id): owners in order join the group to all of whose members they have a strong edge, with no second owner of a
    sample; among several the one with the smallest worst distance. Owners without an edge are groups of their own.

    owners: owner_id, sample and columns of the order (tag, precursor_mz, apex_rt, evidence_score); edges: strong ones (a, b, distance).
    """
    linked = components(edges.select("a", "b")).withColumnRenamed("node", "owner_id")
    both = edges.select(F.col("a").alias("owner_id"), F.col("b").alias("other"), "distance").unionByName(edges.select(F.col("b").alias("owner_id"), F.col("a").alias("other"), "distance"))
    near = both.groupBy("owner_id").agg(F.collect_list("other").alias("others"), F.collect_list("distance").alias("distances"))  # at most an owner's strong edges
    rows = owners.join(linked, "owner_id").join(near, "owner_id").select("component", "owner_id", "sample", "tag", "precursor_mz", "apex_rt", "evidence_score", "others", "distances")

    def place(own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(_s=-own.evidence_score).sort_values(["tag", "precursor_mz", "apex_rt", "sample", "_s", "owner_id"])
        groups: list[tuple[list[int], set[str]]] = []
        out = []
        for r in own.itertuples():
            links = dict(zip(r.others, r.distances, strict=True))
            fits = [(max(links[m] for m in members), k) for k, (members, samples) in enumerate(groups) if r.sample not in samples and all(m in links for m in members)]
            if fits:
                k = min(fits)[1]
            else:
                groups.append(([], set()))
                k = len(groups) - 1
            groups[k][0].append(r.owner_id)
            groups[k][1].add(r.sample)
            out.append((r.owner_id, groups[k][0][0]))
        return pd.DataFrame(out, columns=["owner_id", "group_id"])

    grouped = rows.groupBy("component").applyInPandas(place, "owner_id long, group_id long")
    alone = owners.join(linked, "owner_id", "left_anti").select("owner_id", F.col("owner_id").alias("group_id"))
    return grouped.unionByName(alone)


#: Tolerances are those of owner_edges(); its strong edges are at most a minute long.
_LINK_PPM, _LINK_SEC = {"precursor_mz": ED.PRECURSOR_PPM, "product_mz": ED.PRODUCT_PPM, "observed_loss": ED.LOSS_PPM}, 60.0


class _Links:
    """Groups of complete links that may still take owners: for each its least and greatest values, its members' samples and kinds of support.

    What a tolerance allows beside a value is an interval, so that the outermost members decide. A distance in parts per million is relative to the
    smaller owner_id; where that matters (`unclear`), all members are looked at.
    """

    def __init__(self) -> None:
        self.n, self.names, self.members = 0, np.zeros(64, np.int64), []
        self.low, self.high = ({c: np.full(64, np.nan) for c in (*_LINK_PPM, "apex_rt")} for _ in range(2))
        self.kinds, self.samples = np.zeros((64, 9), bool), {}

    def _grow(self) -> None:
        more = lambda a: np.concatenate([a, np.zeros_like(a)])
        self.names, self.kinds = more(self.names), more(self.kinds)
        self.low, self.high = ({c: more(v) for c, v in side.items()} for side in (self.low, self.high))
        self.samples = {s: more(v) for s, v in self.samples.items()}

    def drop(self, mz: float) -> None:
        """Forgets the groups that m/z, which rises, has left behind."""
        gone = self.low["precursor_mz"][: self.n] * (1 + 1.01e-6 * _LINK_PPM["precursor_mz"]) < mz
        if 4 * gone.sum() < self.n + 64:  # moving the rest costs as much as looking at them
            return
        kept, size = np.flatnonzero(~gone), len(self.names)
        moved = lambda a: np.concatenate([a[kept], np.zeros((size - len(kept), *a.shape[1:]), a.dtype)])
        self.names, self.kinds, self.n = moved(self.names), moved(self.kinds), len(kept)
        self.low, self.high = ({c: moved(v) for c, v in side.items()} for side in (self.low, self.high))
        self.samples = {s: moved(v) for s, v in self.samples.items()}
        self.members = [self.members[k] for k in kept.tolist()]

    @np.errstate(invalid="ignore")
    def candidates(self, sample: str | None, values: dict[str, float], refused: np.ndarray) -> tuple[list[int], list[bool]]:
        """The groups that may take such an owner, the nearest and then the oldest first, and whether the order of ids matters."""
        n = self.n
        rt = np.maximum(np.abs(self.low["apex_rt"][:n] - values["apex_rt"]), np.abs(self.high["apex_rt"][:n] - values["apex_rt"])) * 60
        at = (rt <= _LINK_SEC) & ~self.kinds[:n, refused].any(1)
        if sample in self.samples:
            at &= ~self.samples[sample][:n]
        at = np.flatnonzero(at)
        unclear = np.zeros(len(at), bool)
        fits = np.ones(len(at), bool)
        for c, most in _LINK_PPM.items():
            for side in (self.low, self.high):
                given = ~np.isnan(side[c][at]) & (values[c] == values[c])  # an absent value is out of no tolerance, an infinite one out of any
                one, two = (given & ~(x <= most) for x in (ED._ppm(side[c][at], values[c]), ED._ppm(np.float64(values[c]), side[c][at])))
                fits &= ~(one & two)
                unclear |= one != two
        at, unclear = at[fits], unclear[fits]
        order = np.argsort(rt[at], kind="stable")
        return at[order].tolist(), unclear[order].tolist()

    def near(self, k: int, owner: int, values: dict[str, float]) -> bool:
        """Whether the owner is within the tolerances of all members."""
        for other, *theirs in self.members[k]:
            for (c, most), v in zip(_LINK_PPM.items(), theirs, strict=True):
                a, b = (v, values[c]) if other < owner else (values[c], v)
                if a == a and b == b and not abs(a - b) / max(abs(a), 1e-12) * 1e6 <= most:
                    return False
        return True

    def take(self, k: int | None, owner: int, sample: str | None, values: dict[str, float], kind: int) -> int:
        """Puts the owner into the group, or a new one, and returns the group's name."""
        if k is None:
            k, self.n = self.n, self.n + 1
            if k == len(self.names):
                self._grow()
            self.names[k] = owner
            self.members.append([])
            for c, v in values.items():
                self.low[c][k] = self.high[c][k] = v
        for c, v in values.items():
            self.low[c][k], self.high[c][k] = np.fmin(self.low[c][k], v), np.fmax(self.high[c][k], v)
        self.kinds[k, kind] = True
        self.samples.setdefault(sample, np.zeros(len(self.names), bool))[k] = True
        self.members[k].append((owner, *(values[c] for c in _LINK_PPM)))
        return int(self.names[k])


def _refused_kinds() -> np.ndarray:
    """For each kind of support (3 x events enough, + score enough; 0 no, 1 absent, 2 yes) the kinds with which it makes no strong edge: in neither
    number has one enough and the other one enough or none."""
    both = lambda x, y: x + y >= 3
    return np.array([[not (both(a // 3, b // 3) or both(a % 3, b % 3)) for b in range(9)] for a in range(9)])


def linked_owners(owners: DataFrame) -> DataFrame:
    """(owner_id, group_id): complete_link() of owners by the strong edges of owner_edges(), without making an edge.

    Owners of a tag are cut into islands of m/z and of RT that no strong edge crosses. An island streams by in the rule's order; a task holds the groups
    that m/z hasn't left behind. Owners alike in all that the edges read look for groups once.
    """
    numbers = ["precursor_mz", "apex_rt", "product_mz", "observed_loss"]
    able = (F.col("tag") != "") & ~F.coalesce("identity_conflict", F.lit(False)) & finite(F.col("precursor_mz")) & (F.col("precursor_mz") > 0) & finite(F.col("apex_rt"))
    enough = lambda c, least: F.when(F.col(c).isNull(), 1).when(F.col(c) >= least, 2).otherwise(0)
    marked = owners.withColumns({"_able": F.coalesce(able, F.lit(False)), "_kind": enough("seed_event_count", 2) * 3 + enough("evidence_score", 60)})
    told = lambda c: F.when(F.isnan(c), float("inf")).otherwise(F.col(c)).alias(c)  # noqa: E731 (pandas has one NaN for absent and undefined)
    own = marked.where("_able").select("owner_id", "sample", "tag", *[told(c) for c in numbers], F.col("evidence_score").cast("double").alias("evidence_score"), "_kind")
    by_mz = gap_islands(own.withColumn("_log", F.log("precursor_mz")), ["tag"], "_log", ED.PRECURSOR_PPM / 1e6 * 1.001, "owner_id").withColumnRenamed("island", "_mz")
    rows = gap_islands(by_mz, ["tag", "_mz"], "apex_rt", _LINK_SEC / 60 * 1.001, "owner_id").withColumnRenamed("island", "_rt")
    keys, refused = ["tag", "_mz", "_rt"], _refused_kinds()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, block, groups, known, taken = None, None, _Links(), {}, set()
        for batch in batches:
            names = []
            parts = [batch[c].tolist() for c in (*keys, "owner_id", "sample", "_kind")] + [batch[c].to_numpy(float, na_value=np.nan).tolist() for c in numbers]
            for *at, owner, sample, kind, mz, rt, product, loss in zip(*parts, strict=True):
                if at != island:
                    island, block, groups = at, None, _Links()
                if block != (mz, rt, sample):  # within a block, groups only drop out, as all of its owners are of one sample
                    if block is None or block[0] != mz:
                        groups.drop(mz)
                    block, known, taken = (mz, rt, sample), {}, set()
                values = {"precursor_mz": mz, "apex_rt": rt, "product_mz": product, "observed_loss": loss}
                like = (kind, *("" if v != v else v for v in (product, loss)))
                if like not in known:
                    known[like] = [0, *groups.candidates(sample, values, refused[kind])]
                start, ranked, unclear = found = known[like]
                while start < len(ranked) and ranked[start] in taken:
                    start += 1
                found[0] = start
                k = next((ranked[i] for i in range(start, len(ranked)) if ranked[i] not in taken and (not unclear[i] or groups.near(ranked[i], owner, values))), None)
                if k is not None:
                    taken.add(k)
                names.append(groups.take(k, owner, sample, values, kind))
            yield pd.DataFrame({"owner_id": batch["owner_id"], "group_id": names})

    ranked = F.when(~F.isnan("evidence_score"), -F.col("evidence_score"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "precursor_mz", "apex_rt", F.asc_nulls_last("sample"), ranked.asc_nulls_last(), "owner_id")
    grouped = placed.select(*keys, "owner_id", "sample", "_kind", *numbers).mapInPandas(place, "owner_id long, group_id long")
    return grouped.unionByName(marked.where("NOT _able").select(F.col("owner_id").cast("long").alias("owner_id"), F.col("owner_id").cast("long").alias("group_id")))


def exact_claims(cells: DataFrame) -> DataFrame:
    """Cells of a sample with equal rounded peaks compete: the first by detected, area and family wins, the others become duplicates."""
    key = ["sample", *[F.bround(c, 6) for c in ("apex_rt", "start_rt", "end_rt", "area")]]
    order = [F.col("status") != "detected", F.col("area").desc(), F.col("family_id")]
    own = W.partitionBy(*key)
    live = cells.where(F.col("status").isin("detected", "rescued") & F.col("area").isNotNull())
    return live.select("family_id", "sample", F.row_number().over(own.orderBy(*order)).alias("place"), F.first("family_id").over(own.orderBy(*order)).alias("winner"), F.count("*").over(own).alias("claims"))


def suppressed(peaks: DataFrame, gap: float) -> DataFrame:
    """Peaks that stay when, from the highest down, those closer than the gap to a kept one are dropped; one trace is a group."""

    def keep(own: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        rows = []
        for r in own.sort_values(["intensity", "idx"], ascending=[False, True]).itertuples():
            if all(abs(r.rt - k) >= gap for k in kept):
                kept.append(r.rt)
                rows.append((r.trace_id, r.idx, r.rt, r.intensity))
        return pd.DataFrame(rows, columns=["trace_id", "idx", "rt", "intensity"])

    return peaks.select("trace_id", "idx", "rt", "intensity").groupBy("trace_id").applyInPandas(keep, "trace_id int, idx int, rt double, intensity double")


def weighted_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Non-overlapping intervals (left, right, score) of each group with the highest total score; ties go to fewer, then earlier ones."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in intervals.schema.fields)

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["right", "left"], kind="stable").reset_index(drop=True)
        best: list[tuple[tuple, list[int]]] = [((0.0, 0, ()), [])]
        ends = own["right"].tolist()
        for i, r in enumerate(own.itertuples()):
            before = sum(1 for e in ends[:i] if e <= r.left)
            total, chosen = best[before]
            take = ((total[0] + r.score, total[1] - 1, (*total[2], -r.left)), [*chosen, i])
            best.append(max(best[-1], take, key=lambda x: x[0]))
        return own.loc[best[-1][1]]

    return intervals.groupBy(*keys).applyInPandas(choose, schema)
