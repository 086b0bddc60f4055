"""Prior retention times of targets in samples: what scoring and detection expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_of, median


def rolling_median(rows: DataFrame, keys: list[str], order: str, value: str, width: int, name: str, least: int = 3) -> DataFrame:
    """The rows with `name`: the median of the values of a key within `width` of the row's order, an integer; null without an order, or under `least`
    values. Orders are cut into ranges, each with copies of what lies within `width` of its ends, so that no task sorts all of a key's rows."""
    span = 64 * max(1, width)
    at = lambda shift: F.floor((F.col(order) + shift) / span)
    placed = rows.where(F.col(order).isNotNull()).withColumn("_part", F.explode(F.array_distinct(F.array(at(-width), at(0), at(width)))))
    frame = W.partitionBy(*keys, "_part").orderBy(F.col(order).cast("long")).rangeBetween(-width, width)
    found = placed.withColumn(name, F.when(F.count(value).over(frame) >= least, median(value).over(frame)))
    none = rows.where(F.col(order).isNull()).withColumn(name, F.lit(None).cast("double"))
    return found.where(F.col("_part") == at(0)).drop("_part").unionByName(none)


def rt_priors(targets: DataFrame, samples: DataFrame, standards: DataFrame, library: DataFrame, width: int) -> DataFrame:
    """(sample, label, rt_prior, rt_prior_sigma, prior_source, prefer_prior) of every target in every sample.

    targets: label, is_istd, istd_pair; samples: sample, injection_order; standards: sample, label, rt, the standards' RTs where found; library:
    label, role (ISTD or analyte), median_abs_rt, sigma_abs_rt, median_delta_rt, sigma_delta_rt, each (label, role) once.
    A standard's prior is the median of its RTs over the injections within `width`, at least three (rolling_median), else the library's RT
    (library_abs). Another target's is its pair's RT in the sample and the library's delta (delta_rt_library), and is preferred among ties then.
    Without these it is null, with an empty source. detect_peaks() takes it as the preferred RT.
    """
    found = standards.where("rt IS NOT NULL").select("sample", F.col("label").alias("_std"), F.col("rt").alias("_std_rt"))
    own = targets.where("is_istd").select("label").join(library.where("role = 'ISTD'").select("label", "median_abs_rt", "sigma_abs_rt"), "label", "left")
    # Each standard in each sample is a row of the result.
    every = samples.select("sample", "injection_order").crossJoin(own).join(found.withColumnRenamed("_std", "label"), ["sample", "label"], "left")
    rolled = rolling_median(every, ["label"], "injection_order", "_std_rt", width, "_rolling")
    local, known = F.col("_rolling").isNotNull(), F.col("median_abs_rt").isNotNull()
    istd = rolled.select(
        "sample", "label", F.coalesce("_rolling", "median_abs_rt").alias("rt_prior"), F.when(~local & known, F.col("sigma_abs_rt")).alias("rt_prior_sigma"),
        first_of((local, "rolling_median"), (known, "library_abs"), otherwise="").alias("prior_source"), F.lit(False).alias("prefer_prior"),
    )
    rest = targets.where("NOT is_istd").select("label", "istd_pair").join(library.where("role = 'analyte'").select("label", "median_delta_rt", "sigma_delta_rt"), "label", "left")
    paired = samples.select("sample").crossJoin(rest).join(found, (found["sample"] == samples["sample"]) & (F.col("istd_pair") == F.col("_std")), "left").drop(found["sample"])
    prior = F.col("_std_rt") + F.col("median_delta_rt")
    has = prior.isNotNull()
    analytes = paired.select("sample", "label", prior.alias("rt_prior"), F.when(has, F.col("sigma_delta_rt")).alias("rt_prior_sigma"), F.when(has, "delta_rt_library").otherwise("").alias("prior_source"), has.alias("prefer_prior"))
    return istd.unionByName(analytes)
