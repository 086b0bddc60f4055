"""Joins: bands of m/z or time, nearest rows, and comparisons of tables.

Sides that are copied to several keys are merged with the other side by hints: Spark's estimates don't know of the copies, and would have
broadcast them through the driver.

A band join never compares all pairs: one side's values go to buckets as wide as the largest tolerance, the other side is copied to a
bucket and its two neighbours, and the exact predicate follows the equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written


#: Anchors of one array in k_nearest().
ANCHORS = 256


def band_join(left: DataFrame, right: DataFrame, left_value: str | Column, right_value: str | Column, width: float, on: list[str], where: Column, how: str = "inner") -> DataFrame:
    """Rows of equal `on` columns whose values lie within `width`, and for which `where` holds. how: inner, left_semi or left_anti.

    Both sides' other columns must have different names. width: at least the largest tolerance.
    """
    bucket = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / width)
    near = right.withColumn("_bucket", F.explode(F.sequence(bucket(right_value) - 1, bucket(right_value) + 1)))
    marked = left.withColumn("_bucket", bucket(left_value))
    condition = [marked[c] == near[c] for c in [*on, "_bucket"]]
    whole = condition[0]
    for c in condition[1:]:
        whole = whole & c
    joined = marked.join(near.hint("merge"), whole & where, how)  # copies make it larger than Spark expects: never broadcast
    if how != "inner":
        return joined.drop("_bucket")
    return joined.drop(*[near[c] for c in [*on, "_bucket"]]).drop("_bucket")


def ppm_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float, on: list[str], where: Column, how: str = "inner") -> DataFrame:
    """A band join of values above 0 whose relative difference, to either of them, is at most so many parts per million.

    Buckets are as wide as the tolerance on the scale of logarithms, on which it is the same everywhere. `where` tells how the difference is taken.
    """
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    return band_join(left, right, log(left_mz), log(right_mz), ppm / 1e6 * 1.01, on, where, how)


def _hits(points: DataFrame, requests: DataFrame) -> DataFrame:
    """Points within each distinct request's m/z tolerance and window, named by the request. Both sides meet in bins of 100 ppm.

    Requests go to their bins first and become distinct there; points of minutes that no window of their sample has aren't dealt out.
    """
    low, high = F.col("mz") * (1 - F.col("ppm_tol") / 1e6), F.col("mz") * (1 + F.col("ppm_tol") / 1e6)
    bin_ = lambda c: F.floor(F.log(c) * 1e4)  # noqa: E731 (a request lies in one or two bins at usual tolerances)
    asked = requests.select(F.col("sample").alias("_s"), low.alias("_low"), high.alias("_high"), "rt_min", "rt_max", F.xxhash64(*_SHAPE).alias("_request"))
    wanted = asked.withColumn("_bin", F.explode(F.sequence(bin_("_low"), bin_("_high")))).repartition("_s", "_bin").distinct()
    binned = _asked_minutes(points.where("mz > 0"), requests).withColumn("_bin", bin_("mz"))
    inside = F.col("mz").between(F.col("_low"), F.col("_high")) & F.col("rt").between(F.col("rt_min"), F.col("rt_max"))
    return binned.join(wanted.hint("merge"), (F.col("sample") == F.col("_s")) & (binned["_bin"] == wanted["_bin"]) & inside)


_SHAPE = ["sample", "mz", "rt_min", "rt_max", "ppm_tol"]
_WINDOW = ["sample", "rt_min", "rt_max"]


def _minutes(requests: DataFrame) -> DataFrame:
    """The distinct windows of samples, a row for each minute of a window."""
    return requests.select(*_WINDOW).distinct().select(F.col("sample").alias("_s"), "rt_min", "rt_max", F.explode(F.sequence(F.floor("rt_min"), F.floor("rt_max"))).alias("_minute"))


def _asked_minutes(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of minutes that some window of their sample has. A sample's minutes are few, so that rows stay where they are."""
    minutes = _minutes(requests).select("_s", "_minute").distinct()
    return rows.join(F.broadcast(minutes), (F.col("sample") == F.col("_s")) & (F.floor("rt") == F.col("_minute")), "left_semi")


def _scans_in(scans: DataFrame, requests: DataFrame) -> DataFrame:
    """Scans of each distinct window of a sample. A window is copied to each of its minutes, so that scans meet windows of their minute only."""
    timed = _minutes(requests)
    own = (F.col("sample") == F.col("_s")) & (F.floor("rt") == F.col("_minute")) & F.col("rt").between(F.col("rt_min"), F.col("rt_max"))
    return _asked_minutes(scans, requests).join(timed, own).select(*_WINDOW, "scan_number", "rt")


def extract_traces(points: DataFrame, scans: DataFrame, requests: DataFrame, how: str = "max", digits: int | None = None) -> DataFrame:
    """(label, sample, scan_number, rt, intensity): for every request and scan in its window, the max or sum of the points within ppm.

    requests: (label, sample, mz, rt_min, rt_max, ppm_tol); scans without a point give 0. Points of equal requests are looked for once, and
    scans of equal windows, too. Intensities are rounded to so many digits before scans without a point are filled in.
    """
    value = F.max("intensity") if how == "max" else F.sum("intensity")
    value = value if digits is None else F.round(value, digits)
    found = _hits(points, requests).groupBy("_request", "scan_number").agg(value.alias("intensity"))
    # Only requests and points are shuffled. A request's points meet an array of its window's scans, and the trace comes out of both at the end.
    held = found.where("scan_number IS NOT NULL").groupBy("_request").agg(F.map_from_entries(F.collect_list(F.struct("scan_number", "intensity"))).alias("_found"))
    windows = _scans_in(scans, requests).groupBy(*_WINDOW).agg(F.collect_list(F.struct("scan_number", "rt")).alias("_scans"))
    asked = requests.select("label", *_WINDOW, F.xxhash64(*_SHAPE).alias("_request")).join(held.hint("merge"), "_request", "left").join(windows, _WINDOW)
    filled = asked.select("label", "sample", "_found", F.explode("_scans").alias("_scan"))
    return filled.select("label", "sample", "_scan.scan_number", "_scan.rt", F.coalesce(F.element_at("_found", F.col("_scan.scan_number")), F.lit(0.0)).alias("intensity"))


def _neighbours(scans: DataFrame) -> DataFrame:
    """Each scan with the RTs before and after it in its sample. Scans are put in order by minute, and then the minutes' ends alone."""
    timed = scans.select("sample", "scan_number", "rt", F.floor("rt").alias("_minute"))
    ends, along = timed.groupBy("sample", "_minute").agg(F.min("rt").alias("_low"), F.max("rt").alias("_high")), W.partitionBy("sample").orderBy("_minute")
    around = ends.select("sample", "_minute", F.lag("_high").over(along).alias("_was"), F.lead("_low").over(along).alias("_next"))
    by = W.partitionBy("sample", "_minute").orderBy("rt", "scan_number")
    own = timed.withColumns({"_before": F.lag("rt").over(by), "_after": F.lead("rt").over(by)}).join(around.hint("merge"), ["sample", "_minute"])
    return own.select("sample", "scan_number", F.coalesce("_before", "_was").alias("_before"), F.coalesce("_after", "_next").alias("_after"))


def trace_areas(points: DataFrame, scans: DataFrame, requests: DataFrame) -> DataFrame:
    """(label, sample, area): the trapezoid area, in intensity times seconds, of each request's trace, which isn't built.

    A scan without a point adds nothing, and one with a point adds its intensity times half of the way to its neighbouring scans, as far as they
    lie in the window. Requests without a scan in their window give no row.
    """
    placed = _neighbours(scans)
    found = _hits(points, requests).groupBy("_request", "sample", "scan_number", "rt", "rt_min", "rt_max").agg(F.max("intensity").alias("intensity"))
    way = F.when(F.col("_before") >= F.col("rt_min"), F.col("rt") - F.col("_before")).otherwise(0.0) + F.when(F.col("_after") <= F.col("rt_max"), F.col("_after") - F.col("rt")).otherwise(0.0)
    areas = found.join(placed, ["sample", "scan_number"]).groupBy("_request").agg((F.sum(F.col("intensity") * way) / 2 * 60).alias("area"))
    seen = _scans_in(scans, requests).select(*_WINDOW).distinct()
    asked = requests.select("label", *_WINDOW, F.xxhash64(*_SHAPE).alias("_request")).join(seen, _WINDOW, "left_semi")
    return asked.join(areas, "_request", "left").select("label", "sample", F.coalesce("area", F.lit(0.0)).alias("area"))


def table_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows that were added, removed or changed, with the names of the changed columns; numbers may differ by the tolerance."""
    old, new = (t.select(*keys, *[F.col(v).alias(f"{v}_{k}") for v in values], F.lit(True).alias(f"_in_{k}")) for t, k in ((before, "before"), (after, "after")))
    numeric = {v for v in values if before.schema[v].dataType.typeName() in ("double", "float", "integer", "long")}

    def differs(v: str) -> Column:
        a, b = F.col(f"{v}_before"), F.col(f"{v}_after")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if v in numeric else a.eqNullSafe(b)
        return F.when(~same, F.lit(v))

    changed = F.array_compact(F.array(*[differs(v) for v in values]))
    kind = F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "removed").otherwise("changed")
    both = old.join(new, keys, "full_outer").withColumn("change", kind).withColumn("columns", changed)
    return both.where((F.col("change") != "changed") | (F.size("columns") > 0)).drop("_in_before", "_in_after")


def numbered(rows: DataFrame, keys: list[str], order: str, tie: list[Column], name: str, width: int, counted: Column | None = None) -> DataFrame:
    """Numbers the rows of each key by an integer column and ties, from 1; with `counted`, a row gets the number of such rows up to itself.

    Numbers within ranges of `width` are added to the counts of the ranges before, so that no task sorts all rows of a key.
    """
    one = F.lit(1) if counted is None else F.coalesce(counted, F.lit(False)).cast("int")
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(one).alias("_n"))
    before = totals.select(*keys, "_range", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(one).over(W.partitionBy(*keys, "_range").orderBy(order, *tie).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(before, [*keys, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def k_nearest(rows: DataFrame, is_anchor: Column, is_probe: Column, keys: list[str], order: str, name: str, k: int, carried: list[str], width: int = 4096) -> DataFrame:
    """The k anchors nearest to each probe by an integer column, with `anchor`, their name, `anchor_*`, the carried columns, and their `rank`.

    Anchors are numbered by their order and lie in arrays of ANCHORS numbers, with the k + 1 on either side; a probe meets the array around its own place
    and takes what it needs of it, so that no row is copied to several numbers. Ties go to the smaller name; a row isn't its own anchor. Anchors of
    one order and key, at most, are expected to be fewer than k on a side.
    """
    known = rows.withColumns({"_a": F.coalesce(is_anchor, F.lit(False)), "_p": F.coalesce(is_probe, F.lit(False))}).where("_a OR _p")
    placed = written(numbered(known, keys, order, [F.col(name)], "_at", width, F.col("_a")))
    shown = [F.col(name).alias("anchor"), F.col(order).alias(f"anchor_{order}"), *[F.col(c).alias(f"anchor_{c}") for c in carried]]
    block = lambda off=0: F.floor((F.col("_at") + off) / ANCHORS)
    copied = placed.where("_a").select(*keys, F.explode(F.sequence(block(-k - 1), block(k + 1))).alias("_block"), F.struct(F.col("_at").alias("number"), *shown).alias("_anchor"))
    arrays = copied.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_anchor")).alias("_near"))
    near = placed.where("_p").withColumn("_block", block()).join(arrays.hint("merge"), [*keys, "_block"])
    first = F.col("_near")[0]["number"]
    start, stop = F.greatest(F.col("_at") - k - 1 - first, F.lit(0)).cast("int"), (F.col("_at") + k + 1 - first).cast("int")
    others = F.filter(F.slice("_near", start + 1, F.greatest(stop - start + 1, F.lit(0))), lambda a: F.col(name) != a["anchor"])
    off = lambda a: F.struct(F.abs(F.col(order) - a[f"anchor_{order}"]).alias("off"), *[a[c].alias(c) for c in ("anchor", f"anchor_{order}", *[f"anchor_{c}" for c in carried])])
    kept = F.slice(F.sort_array(F.transform(others, off)), 1, k)
    found = near.withColumn("_kept", kept).drop("_a", "_p", "_at", "_block", "_near").select("*", F.posexplode("_kept").alias("_pos", "_one")).drop("_kept")
    return found.select("*", "_one.*", (F.col("_pos") + 1).alias("rank")).drop("_pos", "_one", "off")


def total_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers all rows in a strict order, from 1: rows are dealt by range, numbered within their range, and the ranges before are added."""
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # a row for each partition
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(before, "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def one_to_one(edges: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The greedy matching that takes edges in the given strict order and skips those with a used end.

    Every round takes all edges that come first for both of their ends and drops the other edges of these ends, until no edge is left;
    that gives what taking them one by one would.
    """
    rank = F.struct(*order)
    left, taken = edges.select(a, b, *[c for c in order if c not in (a, b)]), None
    while True:
        left = written(left)
        best = left.withColumns({"_a": F.min(rank).over(W.partitionBy(a)), "_b": F.min(rank).over(W.partitionBy(b)), "_own": rank}).where("_own = _a AND _own = _b").drop("_a", "_b", "_own")
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti")
