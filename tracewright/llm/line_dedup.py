"""Line deduplication by overlapping windows of three lines, in DataFrame functions only.

Texts are cut at line feeds. Every three consecutive lines that aren't blank are a window, hashed to 128 bits. A window that occurs more
than once anywhere keeps its first occurrence, by document key and place; the lines of all later ones, with the blank lines between them,
are covered. Covered places merge into runs, and a text keeps what lies between its runs.

Defined results: a document's key is its id (null first) and the hash of its text, so that equal rows get equal results and none of them
is the later one; null texts stay null, with 0 lines; texts of fewer than three lines that aren't blank are kept whole; a text of which
every line is covered becomes empty; overlapping repeats inside a text keep the first occurrence's lines. Further columns pass through,
whatever their names, but a clash with the new columns n_lines and n_removed raises. Very long texts are cut like others; their windows are
an array of the row. Empty tables give no rows.

Only hashes and places are shuffled by window; their first occurrences are found by partial aggregates, and the join back to all
occurrences is a plain equi-join, whose hot windows Spark splits. Texts are shuffled once, by document key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 3
BLANK = " \t\r\x0b\x0c"
_NEW = ("n_lines", "n_removed")


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th")]


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, first, last, h1, h2) of every window: the places of its first and last line, and its hash."""
    solid = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda s: F.trim(s["line"], F.lit(BLANK)) != "",
    )
    lines = docs.where(F.col(text).isNotNull()).select(*_key(doc_id, text), solid.alias("_lines")).where(F.size("_lines") >= WINDOW)
    at = lambda i, k: F.get("_lines", i + k)

    def window(i: Column) -> Column:
        held = [at(i, k)["line"] for k in range(WINDOW)]
        return F.struct(
            at(i, 0)["at"].alias("first"), at(i, WINDOW - 1)["at"].alias("last"), F.xxhash64(*held).alias("h1"), F.xxhash64(F.lit(1), *held).alias("h2")
        )

    return lines.select("_id", "_th", F.inline(F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), window)))


def covered_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, runs): the merged runs of places that later occurrences cover, in order."""
    found = windows(docs, doc_id, text)
    place = F.struct("_id", "_th", "first")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("_home"), F.max(place).alias("_other")).where(~F.col("_home").eqNullSafe(F.col("_other")))
    later = found.join(repeated.select("h1", "h2", "_home"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("_home"))).select("_id", "_th", "first", "last").distinct()
    order = W.partitionBy("_id", "_th").orderBy("first")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = later.select("*", (F.coalesce(before, F.lit(-2)) + 1 < F.col("first")).cast("int").alias("_new"))
    numbered = starts.select("*", F.sum("_new").over(order).alias("_run"))
    merged = numbered.groupBy("_id", "_th", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with covered lines removed from their texts, and n_lines and n_removed, the lines before and those removed."""
    if clash := set(_NEW) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    runs = covered_runs(docs, doc_id, text)
    # The input's columns travel as one, so that their names meet none of the names here.
    keyed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"))
    joined = keyed.join(runs.withColumnsRenamed({"_id": "_rid", "_th": "_rth"}), (F.col("_th") == F.col("_rth")) & F.col("_id").eqNullSafe(F.col("_rid")), "left")
    whole = F.col("_row").getField(text)
    lines, count = F.split(whole, "\n", -1), F.size("runs")

    def kept(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["last"] + 1)
        end = F.when(k == count, F.size("_lines")).otherwise(F.get("runs", k)["first"])
        return F.slice("_lines", start + 1, end - start)

    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1))
    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), count), kept)), "\n")
    cut = joined.select("*", F.when(F.col("runs").isNotNull(), lines).alias("_lines"))
    return cut.select(
        *[F.when(F.col("runs").isNull(), whole).otherwise(rest).alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns],
        # Lines are the line feeds and one more.
        F.coalesce(F.octet_length(whole) - F.octet_length(F.translate(whole, "\n", "")) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(i)
), s AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(pos, 2) OVER w AS last
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM s WHERE last IS NOT NULL
), gone AS (
  SELECT DISTINCT r.doc_id, p.pos FROM r, unnest(range(r.pos, r.last + 1)) AS p(pos) WHERE n > 1
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(kept.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
