"""URL filters against a plain version over all rules, and their defined results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import urlfilter

RULES = [*urlfilter.CONTRACT_RULES, ("net", "", "allow"), ("deep.a.b.example.org", "/x/y/z.html", "block"), ("Example.ORG", "/x/y", "block"), ("example.org", "/x/y", "allow"), ("org", "/x/", "allow")]
URLS = [
    None, "", "no scheme/en/", "http://", "http:///en/", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://www.example.com/en", "http://notexample.com/en/",
    "http://a.net/es/?q#f", "http://net/fr/x", "http://a.net#/es/", "http://a.net?x=/es/", "http://x.deep.a.b.example.org/x/y/z.html5?u", "http://example.org/x/yy", "http://example.org/x/z",
    "http://.com/", "http://com./", "http://user@b.com:80/", "x://a.com/\nb/", "a://b://c.com/", "http://É.com/É/", "http://" + "a." * 3000 + "com/" + "en/" * 3000, "http://a.com",
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    best = max([(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)], default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def lowered(rules):
    return [(h.lower(), p, v) for h, p, v in rules]


@pytest.mark.parametrize("rules", [RULES, list(urlfilter.CONTRACT_RULES), []])
def test_equals_all_rules_tried(spark, rules, monkeypatch):
    monkeypatch.setattr(urlfilter, "HOT", 50)
    rnd = random.Random(3)
    some = ["".join(rnd.choice(["http", "://", "a.", "example.", "www.", "com", "net", "org", "/", "/en/", "/es/", "/x/", "y", "?", "#"]) for _ in range(9)) for _ in range(400)]
    rows = list(enumerate(URLS + some + ["http://a.net/es/"] * 200 + ["nothing"] * 100)) + [(None, "http://a.net/fr/"), (3, "http://a.com/")]
    table = spark.createDataFrame(rows, "id long, url string").repartition(5)
    got = urlfilter.judged(table, urlfilter.rule_table(spark, rules)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    expected = [(i, u, *plain(u, lowered(rules))) for i, u in rows]
    assert sorted([tuple(r) for r in got], key=key) == sorted(expected, key=key)


def test_tables(spark):
    rules = urlfilter.rule_table(spark, RULES)
    empty = spark.createDataFrame([], "page_id long, url string, _row int, key int, salt int, _at int")
    assert urlfilter.judged(empty, rules).columns == ["page_id", "url", "_row", "key", "salt", "_at", *urlfilter.NEW]
    clashing = spark.createDataFrame([(1, "http://a.net/es/", 5, 6)], "page_id long, url string, key int, n int")
    assert [tuple(r) for r in urlfilter.judged(clashing, rules).collect()] == [(1, "http://a.net/es/", 5, 6, "a.net", "/es/", "net/es/", "block")]
    with pytest.raises(ValueError, match="host"):
        urlfilter.judged(clashing.withColumn("HOST", F.lit(1)), rules)
    for bad in [(None, "/", "block"), ("", "/", "block"), ("a/b", "/", "allow"), ("a", None, "allow"), ("a", "/", "maybe")]:
        with pytest.raises(Exception, match="not a rule"):
            urlfilter.judged(clashing, urlfilter.rule_table(spark, [bad])).collect()


def test_no_python_in_the_plan(spark):
    frame = urlfilter.judged(spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string"), urlfilter.rule_table(spark, RULES))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
