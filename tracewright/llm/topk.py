"""Exact top-k search by vector-approximation files.

Every component x becomes floor(256 * x). Equal vectors are one class, of which the k + 1 smallest ids can matter, so that copies never
multiply the work. The approximation file holds, instead of components, the number of a cell in each dimension. Cells are quantiles of the
dimension within a block of vectors, narrow at both ends, so that an extreme component makes its own cell wide and no other; every block
keeps its cells' least and greatest components. They give a lower and an upper bound of a query's inner product with any vector in them.

1. First scan: blocks of queries go through parts of the file, a part being some blocks one after the other, and keep a running k + 1 best
   lower bounds for each query. The best of all parts give each query a bound that its k-th score reaches for certain.
2. Second scan: a class stays a candidate of a query only if its upper bound reaches that bound.
   Classes whose bounds are equal need no reading to tie; of those only the ones with the smallest ids stay.
3. Read: a query's first k + 1 candidates by upper bound are read exactly; their last score is a better certain bound. The others are read
   only if their upper bound reaches it.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as queries nor as candidates, nor do
rows with a null id; vectors of different lengths are compared only with their own length; a query's candidates are all other rows, also
those of its own id; an id on several rows is a candidate with each and, as a query, has a ranking for each; ties go to the smaller id; a
query with fewer than k candidates gets all; further columns are ignored, whatever their names; empty tables give no rows. Components and
scores are longs; a component or a score that doesn't fit one raises. Bounds are doubles, widened by what rounding may take from them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written

#: Vectors in a block of the file, blocks in a part, queries in a block, bits of a cell's number, and parts into which hot groups are dealt.
BLOCK, PART, QUERIES, BITS, SALTS = 4096, 4, 512, 5, 32
#: Vectors in the outermost cells of a dimension, at either end.
TAILS = (1, 4, 16)


def _integers(vector: str) -> Column:
    """floor(256 * x) of each component, null if the vector takes no part."""
    doubles = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    large = lambda x: F.abs(x) * 256 >= F.lit(2.0**63)
    whole = F.transform(doubles, lambda x: F.when(large(x), F.raise_error(F.lit("a component doesn't fit a long"))).otherwise(F.floor(x * 256)))
    return F.when(F.col(vector).isNotNull() & ~F.exists(doubles, bad), whole)


def _smallest(frame: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column) -> DataFrame:
    """The first k rows of each key, first within salted parts and then of what is left."""
    salted = frame.withColumn("_salt", salt)
    for part in ([*keys, "_salt"], keys):
        salted = salted.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    return salted.drop("_salt")


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, high): each component's cell, and the least and greatest component of each cell by dimension."""
    n = len(vectors)
    ends = np.minimum(np.cumsum((0, *TAILS)), n // 2)
    inner = np.linspace(ends[-1], n - ends[-1], (1 << BITS) - 2 * len(TAILS) + 1)
    start = np.unique(np.concatenate([ends, np.round(inner), n - ends]).astype(int))
    order = np.argsort(vectors, axis=0, kind="stable")
    ranked = np.take_along_axis(vectors, order, 0)
    cells = np.empty(vectors.shape, np.uint8)
    np.put_along_axis(cells, order, (np.searchsorted(start, np.arange(n), "right") - 1).astype(np.uint8)[:, None], 0)
    return cells, ranked[start[:-1]], ranked[start[1:] - 1]


def _stacked(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _block(table: pa.Table) -> pa.Table:
    """A block of the file from its vectors."""
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    cells, low, high = cells_of(_stacked(table.column("vector"), dim))
    arrays = {c: table.column(c).to_pylist() for c in ("class", "first")} | {"low": low.ravel(), "high": high.ravel()}
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())} | {k: pa.array([v], pa.list_(pa.int64())) for k, v in arrays.items()})


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [query, vector] of inner products. Where doubles round, the bounds are moved by what that can amount to; sums of
    integers below 2 ** 53 are exact."""
    dim = queries.shape[1]
    least, most = (x[cells, np.arange(dim)].astype(np.float64).T for x in (low, high))
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    widest = np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64))).max(0, initial=0.0)
    most_of_all = np.abs(q) @ widest
    slack = np.where(most_of_all < 2.0**52, 0.0, most_of_all * ((4 * dim + 16) * 2.0**-53))[:, None]
    return up @ least + down @ most - slack, up @ most + down @ least + slack


def _scanned(asked: pa.Table, file_: pa.Table, k: int, final: bool) -> pa.Table:
    """One block of queries against a part of the file: the k best lower bounds of each, or finally what reaches a query's certain bound.

    Where both bounds of a class are equal, they are its score, and of such classes that tie only the k with the smallest ids can matter: so
    a query whose scores all tie keeps k candidates of a part, not all.
    """
    out: list[tuple[np.ndarray, ...]] = []
    if asked.num_rows and file_.num_rows:
        dim = asked.column("dim")[0].as_py()
        name, q = asked.column("query").to_numpy(), _stacked(asked.column("vector"), dim)
        best = np.full((len(q), k), -np.inf)
        certain = asked.column("certain").to_numpy()
        for row in range(file_.num_rows):
            get = lambda c: file_.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            own = get("class")
            cells = np.frombuffer(file_.column("cells")[row].as_py(), np.uint8).reshape(len(own), dim)
            low, high = (get(c).reshape(-1, dim) if dim else np.zeros((1, 0), np.int64) for c in ("low", "high"))
            lower, upper = bounds(q, cells, low, high)
            if final:
                at, to = np.nonzero(upper >= certain[:, None])
                out.append((name[at], own[to], upper[at, to], lower[at, to] == upper[at, to], get("first")[to]))
            else:
                best = -np.partition(-np.concatenate([best, lower], 1), k - 1, axis=1)[:, :k]
        if not final:
            at, to = np.nonzero(best > -np.inf)
            out.append((name[at], np.zeros(len(at), np.int64), best[at, to]))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    if final and out:
        joined = [x[_not_tied(*joined, k=k)] for x in joined]
    return pa.table({"query": pa.array(joined[0], pa.int64()), "class": pa.array(joined[1], pa.int64()), "bound": pa.array(joined[2], pa.float64())})


def _not_tied(query: np.ndarray, _: np.ndarray, score: np.ndarray, known: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which candidates stay: of those whose score is known, the k with the smallest ids for each query and score."""
    order = np.lexsort((first, score, query, ~known))
    query, score, known = query[order], score[order], known[order]
    new = np.append(True, (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (known[1:] != known[:-1]))[: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[~known | (place < k)]


def _scan(asked: DataFrame, file_: DataFrame, blocks: int, query_blocks: int, k: int, final: bool) -> DataFrame:
    """(query, class, bound) of all blocks of queries and all parts of the file. asked: query, dim, vector, certain."""
    parts = max(1, -(-blocks // PART))
    dealt = asked.select("query", "dim", "vector", "certain", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    copied = file_.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("own"), F.pmod("block", F.lit(parts)).alias("part"))
    key = ["dim", "own", "part"]
    scan = partial(_scanned, k=k, final=final)
    return dealt.groupBy(*key).cogroup(copied.groupBy(*key)).applyInArrow(lambda a, b: scan(a, b), "query long, class long, bound double")


def _product(safe: bool) -> Column:
    """The inner product of _q and _v; unless it is safe, one that doesn't fit a long raises."""
    if safe:
        return F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    tried = F.aggregate(F.zip_with("_q", "_v", F.try_multiply), F.lit(0).cast("long"), F.try_add)
    return F.coalesce(tried, F.raise_error(F.lit("a score doesn't fit a long")).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with the other rows."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), _integers(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id IS NOT NULL AND vector IS NOT NULL")
    rows = written(own.select("id", "is_query", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # over a written table
    held = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.max("is_query").alias("asked"), F.min("id").alias("first"))
    classes = written(held.select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "vector", F.size("vector").alias("dim"), "asked", "first"))
    kept = _smallest(rows.select("id", "h1", "h2"), ["h1", "h2"], [F.col("id")], k + 1, spread)
    members = written(kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("class", "h1", "h2", "ids"))
    facts = classes.agg(F.count("*"), F.count_if("asked"), F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.max("dim")).first()
    largest = max(-(facts[2] or 0), facts[3] or 0)
    product = _product((facts[4] or 0) * largest * largest < 2**63)
    blocks, query_blocks = max(1, -(-facts[0] // BLOCK)), max(1, -(-facts[1] // QUERIES))

    block = F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)).cast("int").alias("block")
    file_ = written(classes.select("dim", block, "class", "first", "vector").groupBy("dim", "block").applyInArrow(_block, "dim int, block int, cells binary, class array<long>, first array<long>, low array<long>, high array<long>"))
    asked = classes.where("asked").select(F.col("class").alias("query"), "dim", "vector")
    # A query's class may be among its candidates and count once less, so k + 1 classes are looked for.
    lower = _scan(asked.withColumn("certain", F.lit(0.0)), file_, blocks, query_blocks, k + 1, False)
    least = _smallest(lower.select("query", "bound"), ["query"], [F.desc("bound")], k + 1, F.pmod(F.xxhash64("bound"), F.lit(SALTS))).groupBy("query").agg(F.min("bound").alias("bound"), F.count("*").alias("n"))
    certain = F.when(F.col("n") == k + 1, F.col("bound")).otherwise(F.lit(float("-inf")))
    ready = written(asked.join(least, "query").select("query", "dim", "vector", certain.alias("certain")))
    left = written(_scan(ready, file_, blocks, query_blocks, k + 1, True).withColumnRenamed("bound", "upper"))

    def read(wanted: DataFrame) -> DataFrame:
        exact = wanted.join(classes.select("class", F.col("vector").alias("_v")), "class").join(asked.select("query", F.col("vector").alias("_q")), "query")
        return exact.select("query", "class", product.alias("score"))

    first = written(_smallest(left.select("query", "class", "upper"), ["query"], [F.desc("upper"), F.col("class")], k + 1, F.pmod(F.xxhash64("class"), F.lit(SALTS))))
    sure = written(read(first))
    bound = sure.groupBy("query").agg(F.min("score").alias("certain"))
    others = left.join(bound, "query").where(F.col("upper") >= F.col("certain")).join(first.select("query", "class"), ["query", "class"], "left_anti")
    scored = sure.unionByName(read(others.select("query", "class")))

    # Ids of the classes: all of a class have one score, so a query class needs k + 1 rows over its classes.
    shown = scored.join(members.select("class", "ids"), "class").select("query", "score", (F.col("class") == F.col("query")).alias("own"), F.explode("ids").alias("vec_id"))
    near = _smallest(shown, ["query"], [F.desc("score"), F.col("vec_id")], k + 1, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    answer = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "own"))).alias("near"))
    # The rows of a hot class are dealt over salts, with the class's answer copied to each.
    salted = answer.join(members.select(F.col("class").alias("query"), "h1", "h2"), "query").select("h1", "h2", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    askers = rows.where("is_query").select(F.col("id").alias("query_id"), "h1", "h2", spread.alias("_salt"))
    both = askers.join(salted, ["h1", "h2", "_salt"])
    # The query's own row goes, once.
    place = F.array_position(F.transform("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")
    rest = F.when(F.col("_p") > 0, F.concat(F.slice("near", 1, F.col("_p") - 1), F.slice("near", F.col("_p") + 1, k + 1))).otherwise(F.col("near"))
    found = both.select("query_id", "near", place.alias("_p")).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("_at", "_x"))
    return found.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.minus")).alias("score"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS u FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.u, c.u), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n AND len(c.u) = len(q.u)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
