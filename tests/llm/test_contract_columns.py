"""The columns of registered queries that their contracts fix."""

import hashlib
import re

import duckdb

from tracewright.llm import pii, queries, urlfilter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """(start, kind, end) of the fixed patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_pii_counts_are_those_of_the_fixed_patterns(spark, tmp_path):
    texts = [
        None, "", "write to jane dot doe at mail dot com about it", "the host 203[.]0[.]113[.]76 was seen", "call (020) 555-0143 after five", "pay with 4111.1111.1111.1111 today",
        "a@b.c and sam (at) example (dot) org", "1.2.3.4.5.6.7.8 and 256.1.1.1", "+44 20 5550 0101, +1", "4111 1111-1111 1111", "\u00e9 x@y.z\n10.0.0.7",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    assert sum(r.n_added for r in got.values()) > 0
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        for k, kind in enumerate(pii.KINDS):
            assert got[i][f"n_{kind}"] == sum(b[1] == k for b in base), (text, kind)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base).encode()).hexdigest()


def test_url_verdicts_have_the_columns_and_rows_of_their_sql(spark, tmp_path):
    urls = [None, "", "http://a.net/es/1", "https://EXAMPLE.com/en/", "http://www.example.com/en/?q", "no scheme", "http://a.com", "http://a.net/es/1"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_url_filters(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = con.execute(urlfilter.ORACLE)
        assert got.columns == [c[0] for c in wanted.description]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted.fetchall()))
