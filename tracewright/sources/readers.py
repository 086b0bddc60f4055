"""Readers of the engine's inputs, and their checks. Text files are read with an explicit schema; rows that break a rule raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGETS = (
    "label string, mz double, rt_min double, rt_max double, ppm_tol double, neutral_loss_da double, nl_ppm_warn double, nl_ppm_max double, is_istd boolean, istd_pair string, sample_applicability string"
)
SAMPLES = "sample_name string, role string, batch string, injection_order int, excluded boolean"


class ContractError(ValueError):
    """An input breaks a rule of its contract."""


def require(frame: DataFrame, broken: Column, what: str, show: str) -> DataFrame:
    """The frame, if no row breaks the rule; else an error that shows some of them."""
    bad = [str(r[0]) for r in frame.where(broken).select(show).limit(5).collect()]
    if bad:
        raise ContractError(f"{what}: {', '.join(bad)}")
    return frame


def require_unique(frame: DataFrame, keys: list[str], what: str) -> DataFrame:
    doubled = frame.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if doubled:
        raise ContractError(f"{what}: {', '.join(str(tuple(r)[:-1]) for r in doubled)}")
    return frame


def read_table(spark: SparkSession, path: str, ddl: str, required: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A delimited text file with a header (a byte order mark is skipped); the header must hold the required columns."""
    schema = T.StructType.fromDDL(ddl)
    header = spark.read.option("sep", sep).option("header", True).csv(path)
    names = [c.lstrip("﻿") for c in header.columns]
    if missing := [c for c in (required or schema.names) if c not in names]:
        raise ContractError(f"{path} lacks {', '.join(missing)}")
    renamed = header.toDF(*names)
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return renamed.select(*[blank(f.name).try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """The target list: labels are unique, windows and tolerances positive, the neutral-loss columns all or none, and pairs exist."""
    rows = read_table(spark, path, TARGETS, ["label", "mz", "rt_min", "rt_max", "ppm_tol"])
    require(rows, F.col("label").isNull() | F.col("mz").isNull() | (F.col("mz") <= 0), "label or m/z missing", "label")
    require(rows, F.col("rt_min").isNull() | F.col("rt_max").isNull() | (F.col("rt_min") >= F.col("rt_max")), "RT window not above 0", "label")
    require(rows, F.col("ppm_tol").isNull() | (F.col("ppm_tol") <= 0), "tolerance not above 0", "label")
    loss = [F.col(c).isNull().cast("int") for c in ("neutral_loss_da", "nl_ppm_warn", "nl_ppm_max")]
    require(rows, ~(loss[0] + loss[1] + loss[2]).isin(0, 3), "neutral loss incomplete", "label")
    require_unique(rows, ["label"], "label not unique")
    dangling = rows.where(F.coalesce("istd_pair", F.lit("")) != "").join(rows.select(F.col("label").alias("istd_pair")), "istd_pair", "left_anti")
    require(dangling, F.lit(True), "paired standard missing", "label")
    return rows


def read_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Samples with roles; names and their stems must be unique together."""
    rows = require_unique(read_table(spark, path, SAMPLES, ["sample_name"]), ["sample_name"], "sample not unique")
    stem = F.regexp_replace("sample_name", r"\.[A-Za-z]+$", "")
    names = rows.select(F.col("sample_name").alias("own"), F.explode(F.array_distinct(F.array("sample_name", stem))).alias("alias"))
    return require_unique(names, ["alias"], "alias not unique") and rows


def injection_orders(samples: DataFrame) -> DataFrame:
    """(alias, injection_order) of names and stems; an alias with two orders is an error."""
    stem = F.regexp_replace("sample_name", r"\.[A-Za-z]+$", "")
    rows = samples.where("injection_order IS NOT NULL").select(F.explode(F.array_distinct(F.array("sample_name", stem))).alias("alias"), "injection_order").distinct()
    return require_unique(rows, ["alias"], "conflicting injection orders") and rows


def scan_points(scans: DataFrame) -> DataFrame:
    """MS1 centroids in long form; scans of other levels, or with arrays of different lengths, are skipped."""
    fine = (F.col("ms_order") == 1) & (F.size("masses") == F.size("intensities"))
    zipped = F.arrays_zip("masses", "intensities")
    return scans.where(fine).select("sample", "scan_number", "rt", F.posexplode(zipped).alias("idx", "_x")).select("sample", "scan_number", "rt", "idx", F.col("_x.masses").alias("mz"), F.col("_x.intensities").alias("intensity"))


def ms2_events(scans: DataFrame, rt_min: float, rt_max: float) -> DataFrame:
    """MS2 scans in an RT window with their base peak; unreadable ones stay, without a scan."""
    return scans.where((F.col("ms_order") == 2) & F.col("rt").between(rt_min, rt_max)).select("sample", "scan_number", "rt", "precursor_mz", F.array_max("intensities").alias("base_peak"), "parse_error")


def melt(wide: DataFrame, ids: list[str], name: str = "sample", value: str = "area") -> DataFrame:
    """A wide matrix as (ids, sample, value) rows."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], name, value)


def rt_priors(priors: DataFrame, config_hash: str) -> DataFrame:
    """Reference deltas of one configuration, without blocked ones; a (target, pair) may occur once."""
    return require_unique(priors.where((F.col("config_hash") == config_hash) & ~F.coalesce("blocked", F.lit(False))), ["target", "pair"], "prior not unique")


def traces_of(json_traces: DataFrame) -> DataFrame:
    """Overlay traces, nested as arrays for each family, in long form."""
    rows = json_traces.select("family_id", F.explode("traces").alias("t")).select("family_id", F.col("t.sample").alias("sample"), F.posexplode(F.arrays_zip("t.rt", "t.intensity")).alias("idx", "x"))
    return rows.select("family_id", "sample", "idx", F.col("x.rt").alias("rt"), F.col("x.intensity").alias("intensity"))


BATCH = "sample_stem string, candidate_csv string, raw_file string, review_csv string"


def read_discovery_batch(spark: SparkSession, path: str) -> DataFrame:
    """The index of a discovery batch: a sample and the place of its candidates in each row, both required; relative places are those beside the index."""
    rows = read_table(spark, path, BATCH, ["sample_stem", "candidate_csv"])
    require(rows, F.col("sample_stem").isNull(), "sample_stem is required", "candidate_csv")
    require(rows, F.col("candidate_csv").isNull(), "candidate_csv is required", "sample_stem")
    require_unique(rows, ["sample_stem"], "sample not unique")
    beside = path.rsplit("/", 1)[0]
    placed = lambda c: F.when(F.col(c).rlike(r"^(/|[a-z0-9]+:)"), F.col(c)).otherwise(F.concat(F.lit(f"{beside}/"), F.col(c))).alias(c)
    return rows.select("sample_stem", placed("candidate_csv"), "raw_file", placed("review_csv"))


PROFILES = "`Tag Category` string, `Tag No.` string, `Tag Name` string, `Tag Parameters (Da or m/z)` double, `Mass Tolerance (ppm)` double, `Intensity Cutoff (height)` double"


def read_tag_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(tag_id, tag, loss_da, ppm, least_intensity) of the neutral losses of a tag list (category 1); product tags (category 2) are left out, and
    other categories and incomplete rows raise."""
    rows = read_table(spark, path, PROFILES)
    require(rows, ~F.coalesce(F.col("Tag Category").isin("1", "2"), F.lit(False)), "unsupported tag category", "`Tag No.`")
    own = rows.where(F.col("Tag Category") == "1")
    names = {"Tag No.": "tag_id", "Tag Name": "tag", "Tag Parameters (Da or m/z)": "loss_da", "Mass Tolerance (ppm)": "ppm", "Intensity Cutoff (height)": "least_intensity"}
    require(own, sum((F.col(f"`{c}`").isNull().cast("int") for c in names), F.lit(0)) > 0, "tag row incomplete", "`Tag No.`")
    return own.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
