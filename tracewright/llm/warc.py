"""Merkle fixity audit of WARC replicas.

Records lie in files at ordered offsets. A leaf hashes a record's bytes; a node hashes its children's hashes, in order, with the range of
offsets that they span, up to a root for each file. Two replicas of a file agree if their roots do. Where they don't, the audit compares
the children of mismatching nodes only, level by level, down to the records that differ.

Defined results: records are ordered by page id, then by url and content (nulls first), so equal rows lie side by side; records without
an id go to files of their own, numbered below 0 by the hash of their content; null urls and contents are empty; a file that one replica
lacks has every record `missing` (from the second) or `extra` (in the second only). Further columns of pages are ignored, whatever their
names. Very long contents are hashed whole. Empty tables give no rows.

A file holds about a fixed number of records, more only if ids repeat or are missing: records without an id share UNNUMBERED files. A node has
a fixed number of children. Only mismatching files and branches are joined with their children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written

#: Ids in a file, children of a node, and files for records without an id.
PER_FILE, FANOUT, UNNUMBERED = 256, 16, 1024


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(file_id, ordinal, page_id, offset, length, sha256) of the WARC record of each page."""
    made = pages.select(
        F.coalesce(F.floor(F.col("page_id") / PER_FILE), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(UNNUMBERED))).cast("long").alias("file_id"),
        F.col("page_id").cast("long").alias("page_id"), "url", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("_record"),
    )
    hashed = made.select("file_id", "page_id", "url", F.octet_length("_record").cast("long").alias("length"), F.sha2("_record", 256).alias("sha256"))
    order = W.partitionBy("file_id").orderBy("page_id", "url", "sha256")
    return hashed.select(
        "file_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "page_id",
        F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "sha256",
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes of (file_id, at, hash, start, end)."""
    grouped = nodes.groupBy("file_id", F.floor(F.col("at") / FANOUT).alias("at")).agg(
        F.sort_array(F.collect_list(F.struct(nodes["at"].alias("own"), "hash"))).alias("_own"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    text = F.concat(F.array_join(F.transform("_own", lambda x: x["hash"]), ","), F.lit("|"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return grouped.select("file_id", "at", F.sha2(text, 256).alias("hash"), "start", "end")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of nodes (file_id, at, hash, start, end), the leaves first and roots last, of records as records() gives them."""
    level = leaves.select("file_id", F.col("ordinal").alias("at"), F.col("sha256").alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    levels, most = [level], leaves.agg(F.max("ordinal")).first()[0] or 0
    while most > 0 or len(levels) == 1:
        levels.append(_parents(levels[-1]))
        most //= FANOUT
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of either replica with its status: ok, corrupt, missing or extra, and the roots of its file in both.

    first, second: records as records() gives them. Branches whose hashes agree aren't descended; their records are ok.
    """
    first, second = written(first), written(second)
    a, b = tree(first), tree(second)
    height = max(len(a), len(b))
    a, b = ([*t, *[t[-1]] * (height - len(t))] for t in (a, b))
    # A replica's tree may lack upper levels where the other has more records; then the file's root stands for them.
    roots = a[-1].select("file_id", F.col("hash").alias("root_a")).join(b[-1].select("file_id", F.col("hash").alias("root_b")), "file_id", "full_outer")
    roots = written(roots)
    open_ = roots.where(~F.col("root_a").eqNullSafe(F.col("root_b"))).select("file_id", F.lit(0).cast("long").alias("at"))
    for up, down in zip(a[-2::-1], b[-2::-1], strict=True):
        pair = [t.select("file_id", "at", F.col("hash").alias(n), F.floor(F.col("at") / FANOUT).alias("_up")) for t, n in ((up, "_a"), (down, "_b"))]
        under = [t.join(open_.withColumnRenamed("at", "_up"), ["file_id", "_up"], "left_semi").drop("_up") for t in pair]
        open_ = under[0].join(under[1], ["file_id", "at"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file_id", "at")
    names = ["page_id", "offset", "length", "sha256"]
    both = first.join(second.select("file_id", "ordinal", *[F.col(n).alias(f"_{n}") for n in names]), ["file_id", "ordinal"], "full_outer")
    flagged = both.join(open_.select("file_id", F.col("at").alias("ordinal"), F.lit(True).alias("_open")), ["file_id", "ordinal"], "left").join(roots, "file_id", "left")
    status = (
        F.when(F.col("_open").isNull(), "ok").when(F.col("_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("corrupt")
    )
    return flagged.select(
        "file_id", "ordinal", *[F.coalesce(n, f"_{n}").alias(n) for n in names[:3]], F.col("sha256").alias("sha256_a"), F.col("_sha256").alias("sha256_b"), status.alias("status"), "root_a", "root_b"
    )


def _drawn(key: str, starts: tuple[str, ...]) -> Column:
    """Whether the SHA-256 of the key as text begins with one of `starts`."""
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, len(starts[0])).isin(*starts)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with the first character of about one in a hundred overwritten, for drills."""
    hit = _drawn("page_id", ("07", "3c", "9e")) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))


def truncated(replica: DataFrame) -> DataFrame:
    """Records of a replica of which some files, about one in five, lost their tail, for drills."""
    return replica.where(~(_drawn("file_id", ("2", "7", "c")) & (F.col("ordinal") >= 200)))


# Two levels above the leaves, as files of 17 to 256 records have.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a,
    CASE WHEN substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) IN ('07', '3c', '9e') AND length(html) > 0 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END AS b
  FROM pages
), t AS (
  SELECT page_id, url, side, body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
    || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, url, 'a' AS side, a AS body FROM p UNION ALL SELECT page_id, url, 'b', b FROM p)
), r AS (
  SELECT side, CAST(floor(page_id / 256.0) AS BIGINT) AS file_id, page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256, url FROM t
), n AS (
  SELECT side, file_id, page_id, length, sha256, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal,
    CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM r WINDOW w AS (PARTITION BY side, file_id ORDER BY page_id, url, sha256)
), k AS (
  SELECT * FROM n WHERE side = 'a' OR ordinal < 200 OR substr(sha256(CAST(file_id AS VARCHAR)), 1, 1) NOT IN ('2', '7', 'c')
), u AS (
  SELECT side, file_id, ordinal // 16 AS pos, min("offset") AS s, max("offset" + length) AS e,
    sha256(string_agg(sha256, ',' ORDER BY ordinal) || '|' || min("offset") || '-' || max("offset" + length)) AS hash
  FROM k GROUP BY ALL
), o AS (
  SELECT side, file_id, sha256(string_agg(hash, ',' ORDER BY pos) || '|' || min(s) || '-' || max(e)) AS root FROM u GROUP BY ALL
), a AS (SELECT * FROM k WHERE side = 'a'), b AS (SELECT * FROM k WHERE side = 'b')
SELECT a.file_id, a.ordinal, a.page_id, a."offset", a.length, a.sha256 AS sha256_a, b.sha256 AS sha256_b,
  CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 <> b.sha256 THEN 'corrupt' ELSE 'ok' END AS status, x.root AS root_a, y.root AS root_b
FROM a LEFT JOIN b ON a.file_id = b.file_id AND a.ordinal = b.ordinal
LEFT JOIN o x ON x.side = 'a' AND x.file_id = a.file_id LEFT JOIN o y ON y.side = 'b' AND y.file_id = a.file_id
"""
