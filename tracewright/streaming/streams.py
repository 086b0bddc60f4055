"""Batch operators run as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_new_runs


def append_stream(runs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the runs of a stream whose content isn't stored yet; the refusal has no time bound, as fingerprints stay in a table."""
    return runs.writeStream.foreachBatch(lambda batch, _: append_new_runs(batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seed_stream(products: DataFrame, tags: DataFrame, ppm: float, intensity_share: float) -> DataFrame:
    """Neutral-loss seeds of scans as they arrive: stateless, as a scan's ions come in one row. products: sample, scan_number, rt, ts,
    precursor_mz and ions, an array of (mz, intensity)."""
    base = F.array_max(F.transform("ions", lambda x: x["intensity"]))
    ions = products.select("sample", "scan_number", "rt", "ts", "precursor_mz", base.alias("base"), F.explode("ions").alias("ion")).where(F.col("ion.intensity") >= F.col("base") * intensity_share)
    loss = F.col("precursor_mz") - F.col("ion.mz")
    seeds = ions.crossJoin(F.broadcast(tags)).withColumn("loss_ppm", F.abs(loss - F.col("loss_da")) / F.col("loss_da") * 1e6)
    return seeds.where(F.col("loss_ppm") <= ppm).select("sample", "scan_number", "rt", "ts", "tag", "precursor_mz", F.col("ion.mz").alias("product_mz"), F.col("ion.intensity").alias("intensity"), "loss_ppm")


def seed_sessions(seeds: DataFrame, gap: str, delay: str) -> DataFrame:
    """Groups of seeds of one sample and tag whose times are no further apart than the gap. RT stands as event time in `ts`."""
    return seeds.withWatermark("ts", delay).groupBy("sample", "tag", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("intensity").alias("top"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"))


def trend_flags_stream(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Rows of standards as they arrive, against medians of a batch: a stream-static join; late rows are judged anew by the next batch."""
    joined = rows.join(medians, "compound", "left")
    off = F.col("apex_rt") - F.col("median_rt")
    return joined.withColumn("rt_outlier", F.coalesce(F.abs(off) > 0.20, F.lit(False)))
