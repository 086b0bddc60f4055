"""Tables that cut a frame's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session has none, as in local tests, one is made on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(frame: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder, so that lost executors never cause them to be computed again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def by_runs(rows: DataFrame, keys: list[str], order: str, solve: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """The rows that `solve` makes of each key's columns, in order. Sorted keys stream through a task, which holds a batch and one key: for many small
    keys this takes a fraction of what a call of pandas for each one does."""
    names = [part.split()[0] for part in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def told(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            columns = {c: frame[c].to_numpy() for c in frame.columns}
            made = [r for a, z in zip(starts[:-1], starts[1:]) for r in solve({c: v[a:z] for c, v in columns.items()})]
            return pd.DataFrame(made, columns=names)

        def starts_of(frame: pd.DataFrame) -> np.ndarray:
            own = frame[keys]
            return np.flatnonzero((own != own.shift()).any(axis=1).to_numpy())

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if len(held) > 1 and (batch[keys].iloc[-1] == held[0][keys].iloc[-1]).all():
                continue  # one key goes on
            frame = pd.concat(held, ignore_index=True)
            starts = starts_of(frame)
            if len(starts) > 1:
                yield told(frame, starts)
            held = [frame.iloc[starts[-1] :]]
        if held:
            frame = pd.concat(held, ignore_index=True)
            yield told(frame, np.append(starts_of(frame), len(frame)))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(stream, schema)
