"""Seeds of discovery: product ions of MS2 scans that tell of a neutral loss."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeedLimits:
    """Error of the loss and width of the product window in ppm, how far a scan's precursor may be off its middle in Da, and the least intensity as
    a share of the scan's highest."""

    loss_ppm: float = 20.0
    product_ppm: float = 20.0
    precursor_da: float = 1.6
    least_share: float = 0.01


def discovery_seeds(products: DataFrame, tags: DataFrame, limits: SeedLimits = SeedLimits()) -> DataFrame:
    """(sample, scan_number, rt, tag, ion, precursor_mz, product_mz, intensity, loss_da, loss_ppm, mz_basis, scan_precursor_mz) of all seeds.

    products: sample, scan_number, rt, precursor_mz, ion, mz, intensity; tags: tag, loss_da, a short list. For each scan and tag, of the ions in
    the window around the scan's precursor less the loss, the one with the smallest error, if it is small enough (then the most intense, the first)
    gives a seed with the scan's precursor. Every other ion outside that window from which the loss leads to a precursor within precursor_da
    of the scan's gives one with the precursor so inferred. Of seeds of equal m/z (to a millionth) the one with the smaller error stays. Ions that
    are not finite, and scans without signal, give none.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    scan = ["sample", "scan_number"]
    base = F.max(F.when(fine("intensity"), F.col("intensity"))).over(W.partitionBy(*scan))
    ions = products.withColumn("_base", base).where(fine("mz") & fine("intensity") & fine("precursor_mz") & (F.col("_base") > 0) & (F.col("intensity") >= F.col("_base") * limits.least_share))
    # Tags are as few as a method knows losses; each ion meets them all.
    rows = ions.crossJoin(F.broadcast(tags.where("loss_da > 0").select("tag", F.col("loss_da").alias("_loss"))))
    expected = F.col("precursor_mz") - F.col("_loss")
    window = F.greatest(F.lit(limits.product_ppm), limits.loss_ppm * F.col("_loss") / expected)
    inside = F.abs(F.col("mz") - expected) / expected * 1e6 <= window
    inferred = F.col("mz") + F.col("_loss")
    off = F.abs(F.col("precursor_mz") - F.col("mz") - F.col("_loss")) / F.col("_loss") * 1e6
    near = (F.abs(F.col("precursor_mz") - inferred) <= limits.precursor_da) & (inferred > 0)
    told = rows.where(expected > 0).withColumns({"_direct": inside, "_off": off}).where(F.col("_direct") & (F.col("_off") <= limits.loss_ppm + 1e-9) | ~F.col("_direct") & near)
    seeds = told.select(
        *scan, "rt", "tag", "ion", F.when(F.col("_direct"), F.col("precursor_mz")).otherwise(inferred).alias("precursor_mz"), F.col("mz").alias("product_mz"), "intensity",
        F.when(F.col("_direct"), F.col("precursor_mz") - F.col("mz")).otherwise(F.col("_loss")).alias("loss_da"), F.when(F.col("_direct"), F.col("_off")).otherwise(0.0).alias("loss_ppm"),
        F.when(F.col("_direct"), "scan_precursor").otherwise("product_plus_neutral_loss").alias("mz_basis"), F.col("precursor_mz").alias("scan_precursor_mz"),
    )
    rank = lambda *keys: F.row_number().over(W.partitionBy(*scan, "tag", *keys).orderBy("loss_ppm", F.desc("intensity"), "ion"))
    one = seeds.withColumn("_n", rank("mz_basis")).where("_n = 1 OR mz_basis <> 'scan_precursor'")
    return one.withColumn("_n", rank(F.round(F.col("precursor_mz") * 1e6), F.round(F.col("product_mz") * 1e6))).where("_n = 1").drop("_n")
