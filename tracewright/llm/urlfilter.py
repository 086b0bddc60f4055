"""URL filters: rules on hosts and paths, found by hashes of host suffixes and path prefixes, in DataFrame functions only.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it, and whose path starts with the rule's. Every URL is
expanded into expressions, a suffix of its host (cut at dots) and a prefix of its path (cut after slashes). Rules are looked up by the first
four bytes of their expression's SHA-256 digest, then the full digest must be equal and the rest of the rule's path, behind its last slash,
must follow in the URL's. URLs are only expanded as deep as the deepest rule goes; deeper expressions can't be one's.

Of the rules that fit a URL the longest wins, by host and path together; then the longer host, then `block` before `allow`. Where none fits,
the verdict is `default`.

Defined results: a null URL, or one without "://", has an empty host and path, which no rule fits; hosts are lower-cased from A to Z, in
rules too, and otherwise taken as they stand, with ports and user names; an empty path starts with no rule's "/"; dots at either end of a
host make empty labels; rules with a null column, an empty host, a host holding "/", "?" or "#", or another verdict than allow and block
raise; repeated rules count once. Rows are never merged: repeated ids and URLs give a row each. Further columns of the input pass through
`judged`; a clash with a new column's name raises. Empty tables give no rows, and an empty rule table leaves the default everywhere.

Only distinct URLs are expanded, so that hot ones cost once; digests stand for URLs in shuffles. The decisions go back to the rows by a join
on the digest, whose hot URLs (at least `HOT` rows, hence at most one of `HOT` rows' count of them) are dealt over `SALTS` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES, HOT, SALTS = 4, 20_000, 64
NEW = ("host", "path", "rule", "verdict")

#: The rules that op13_url_filters is given.
CONTRACT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] | list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of rules spelled out in code."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _lower(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """The host, lower-cased from A to Z, and the path of a URL; both empty where it has no "://"."""
    whole = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(whole, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, "/", ""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def prepared(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rest, rank) by rule; rank holds what precedence asks, the text host + path and the verdict."""
    host, path, verdict = _lower(F.col("host")), F.col("path"), F.col("verdict")
    fine = (host != "") & ~host.rlike("[/?#]") & path.isNotNull() & verdict.isin("allow", "block")
    known = rules.select(
        F.when(F.coalesce(fine, F.lit(False)), host).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.to_json(F.struct("host", "path", "verdict"))))).alias("host"),
        path.alias("path"),
        verdict.alias("verdict"),
    ).distinct()
    deep = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "(?s)^.*/", 0)).otherwise("")
    text = F.concat("host", "path")
    digest = _digest(F.concat("host", "base"))
    rank = F.struct(
        F.length(text).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("verdict") == "block").alias("blocks"),
        text.alias("rule"),
        F.col("verdict").alias("verdict"),
    )
    return known.withColumn("base", deep).select(
        "host", "base", F.substring(digest, 1, PREFIX_BYTES).alias("prefix"), digest.alias("digest"), F.expr("substring(path, length(base) + 1)").alias("rest"), rank.alias("rank")
    )


def expressions(urls: DataFrame, labels: int, slashes: int, host: str = "host", path: str = "path") -> DataFrame:
    """A row by URL, host suffix of at most `labels` labels and path prefix of at most `slashes` slashes: adds suffix and base."""
    parts = F.split(F.col(host), "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    depth = F.least(_slashes(F.col(path)), F.lit(slashes))
    cut = F.expr(f"transform(sequence(0, _depth), k -> if(k = 0, '', concat(substring_index(`{path}`, '/', k), '/')))")
    by_host = urls.where(F.col(host) != "").select("*", depth.alias("_depth"), F.explode(suffixes).alias("suffix"))
    return by_host.select("*", F.explode(cut).alias("base")).drop("_depth")


def decisions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n, rank) of the URLs (key, host, path, n) that some rule fits, and of hot ones; rank is the winning rule's, see prepared()."""
    known = prepared(rules)
    deepest = known.agg(F.max(F.size(F.split("host", "\\.", -1))), F.max(_slashes(F.col("base")))).first()
    if deepest is None or deepest[0] is None:
        return urls.where(F.col("n") >= HOT).select("key", "n", F.lit(None).cast(known.schema["rank"].dataType).alias("rank"))
    digest = _digest(F.concat("suffix", "base"))
    asked = expressions(urls, deepest[0], deepest[1]).select("key", "n", "path", "base", digest.alias("asked")).withColumn("asked_prefix", F.substring("asked", 1, PREFIX_BYTES))
    found = asked.join(known.select("prefix", "digest", "rest", "rank"), F.col("asked_prefix") == F.col("prefix"))
    sure = found.where((F.col("asked") == F.col("digest")) & F.expr("startswith(substring(path, length(base) + 1), rest)"))
    hot = urls.where(F.col("n") >= HOT).select("key", "n", F.lit(None).alias("rank"))
    return sure.select("key", "n", "rank").unionByName(hot).groupBy("key").agg(F.max("n").alias("n"), F.max("rank").alias("rank"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The input's columns, and host, path, rule (its host and path, null where none fits) and verdict."""
    if clash := set(NEW) & {c.lower() for c in pages.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    host, path = host_and_path(url)
    rows = pages.select(F.struct("*").alias("_row"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("key", _digest(F.concat("host", "path")))  # a path is empty or starts with the slash that no host holds
    made = written(decisions(rows.groupBy("key", "host", "path").agg(F.count("*").alias("n")), rules))
    hot = made.where(F.col("n") >= HOT).select(F.col("key").alias("_hot"))
    dealt = rows.join(hot, F.col("key") == F.col("_hot"), "left").withColumn("salt", F.when(F.col("_hot").isNull(), 0).otherwise((F.col("_at") % SALTS).cast("int")))
    salts = F.when(F.col("n") >= HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    back = made.select(F.col("key").alias("_key"), "rank", F.explode(salts).alias("_salt"))
    joined = dealt.join(back, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in pages.columns], "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT n, max({'size': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': rverdict}) AS best
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (n)
"""
