"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null, and so equal to no fold, for null ids."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text", most_labels: int = 1000) -> pd.DataFrame:
    """Columns text and label: about `per_label` rows of each label, chosen by a hash of the id, with texts of at most `max_bytes`.

    labels: ids and labels to choose from; rows whose label is null don't count. More than `most_labels` labels raise, so that the driver
    receives at most 2 * per_label * most_labels rows. The rows' order is fixed by the ids' hashes.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    counts = known.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not counts:
        return pd.DataFrame({"text": pd.Series([], dtype=str), "label": pd.Series([], dtype=object)})
    place = (F.xxhash64("_id") % (1 << 31)).cast("double") / float(1 << 31)
    wanted = F.lit(False)
    for row in counts:
        wanted = wanted | ((F.col("_label") == row[0]) & (F.abs(place) < per_label / row[1]))
    chosen = known.where(wanted).orderBy(F.xxhash64("_id"), "_label").limit(2 * per_label * len(counts))
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").where(F.octet_length("_text") <= max_bytes)
    found = picked.orderBy(F.xxhash64("_id"), "_text").select("_text", "_label").toPandas()
    return found.rename(columns={"_text": "text", "_label": "label"})
