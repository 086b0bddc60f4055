"""Writers: publication of several tables at once, idempotent appends, and text-safe columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_safe(x: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def number_text(x: Column, digits: int = 4) -> Column:
    """A number with a fixed count of decimals, empty for null and what isn't finite."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fine, F.format_string(f"%.{digits}f", x.cast("double"))).otherwise("")


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes all tables under a run id and then, last, its row in the manifest; readers see a run only once it is complete."""
    run = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}/run={run}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run, sorted(tables))], "run string, tables array<string>").withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")
    return run


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The latest complete run of a table."""
    run = spark.read.parquet(f"{folder}/_manifest").where(F.array_contains("tables", name)).orderBy(F.desc("published"), "run").first().run
    return spark.read.parquet(f"{folder}/{name}/run={run}")


def fingerprint(frame: DataFrame) -> DataFrame:
    """Each run's SHA-256 over its rows' digests in order. frame: a column `run` and any others."""
    row = F.sha2(F.to_json(F.struct(*[c for c in sorted(frame.columns) if c != "run"])), 256)
    # Digests are summed in blocks before the last digest, so that a long run isn't one list.
    blocks = frame.select("run", row.alias("_d")).groupBy("run", F.substring("_d", 1, 2).alias("_b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), ""), 256).alias("_d"))
    return blocks.groupBy("run").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("_b", "_d"))), ""), 256).alias("fingerprint"))


def append_new_runs(frame: DataFrame, folder: str) -> DataFrame:
    """Stores the runs whose content isn't there yet, and returns (run, fingerprint, appended) of all of them.

    A run's rows lie in a folder named by its fingerprint, which is overwritten as a whole, and the fingerprint's row in the ledger follows.
    A batch that is written once more after a crash thus changes nothing; of equal runs within a batch, the first by name is stored.
    """
    spark = frame.sparkSession
    own = fingerprint(frame)
    try:
        known = spark.read.parquet(f"{folder}/fingerprints")
    except Exception as e:  # the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "run string, fingerprint string")
    first = F.row_number().over(W.partitionBy("fingerprint").orderBy("run")) == 1
    marked = own.join(known.select("fingerprint").distinct().withColumn("_known", F.lit(True)), "fingerprint", "left")
    verdict = marked.withColumn("appended", F.col("_known").isNull() & first).select("run", "fingerprint", "appended")
    rows = verdict.collect()  # one row for each run of a batch
    fresh = [(r.run, r.fingerprint) for r in rows if r.appended]
    if fresh:
        named = spark.createDataFrame(fresh, "run string, fingerprint string")
        stored = frame.join(named, "run").withColumn("content", F.col("fingerprint")).drop("fingerprint")
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content").parquet(f"{folder}/rows")
        named.coalesce(1).write.mode("append").parquet(f"{folder}/fingerprints")
    return spark.createDataFrame([tuple(r) for r in rows], verdict.schema)


def alignment_review(families: DataFrame) -> DataFrame:
    """The review table of aligned families, as text and counts. families: family_id, tag, evidence, center_mz, center_rt, detected, rescued, cell_count."""
    others = F.col("cell_count") - F.col("detected") - F.col("rescued")
    return families.select("family_id", "tag", number_text(F.col("center_mz")).alias("mz"), number_text(F.col("center_rt")).alias("rt"), "detected", "rescued", others.alias("others"), text_safe(F.col("evidence")).alias("evidence"))


def write_alignment(families: DataFrame, matrix: DataFrame, folder: str) -> str:
    """Publishes the review table and the matrix (family_id, sample, area) together; returns the run's id."""
    return publish({"review": alignment_review(families), "matrix": matrix.select("family_id", "sample", number_text(F.col("area")).alias("area"))}, folder)


def owner_assignments(rows: DataFrame) -> DataFrame:
    """The table of candidates and the owners that they were assigned to, with ids and reasons as safe text."""
    text = lambda c: text_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    return rows.select("candidate_id", text("owner_id"), "assignment_status", text("reason"))


def write_pending_priors(entries: DataFrame, library: str) -> str:
    """Writes proposed rows of a prior library beside it, in place of earlier proposals; the library itself stays as it is."""
    path = f"{library.rstrip('/')}.pending"
    entries.write.mode("overwrite").parquet(path)
    return path


def wide(rows: DataFrame, keys: list[str], name: str, value: str, most: int = 5000) -> DataFrame:
    """A row for each key and a column for each value of `name`, in order. More than `most` of these raise, as columns are held in every row's schema;
    rows without a name make no column."""
    found = [r[0] for r in rows.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {name}")
    return rows.groupBy(*keys).pivot(name, found).agg(F.max(value)) if found else rows.select(*keys).distinct()
