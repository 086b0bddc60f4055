"""Periodic runs against a plain version that tries every period at every word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import periodic


def plain_stretches(words):
    """(start, stop, period) of every longest stretch of at least two smallest periods."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        at = 0
        while at + p < n:
            if words[at] != words[at + p]:
                at += 1
                continue
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end - at >= p and not any(all(words[i] == words[i + d] for i in range(at, end + p - d)) for d in range(1, p)):
                found[at, end + p] = p
            at = end + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def random_words(rnd, size):
    words = []
    while len(words) < size:
        part = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 5, 7, 8, 12, 20]))]
        words += part * rnd.choice([1, 1, 2, 3, 7])
    return words[: rnd.randrange(size + 1)]


def test_stretches_equal_every_period_tried():
    rnd = random.Random(4)
    texts = [random_words(rnd, 70) for _ in range(120)] + [[], ["a"], ["a"] * 64, list("ab" * 20), list("abaab" * 9)]
    row, start, stop, period = periodic.stretches([np.array([ord(w) for w in t], np.int64) for t in texts])
    got = sorted(zip(row.tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True))
    assert got == sorted((i, *f) for i, t in enumerate(texts) for f in plain_stretches(t))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 130, 300, 1000])
def test_tiles_hold_any_two_periods(monkeypatch, n):
    monkeypatch.setattr(periodic, "TILE", 64)
    monkeypatch.setattr(periodic, "LOW", 4)
    held = periodic.tiles(n)
    for p in range(1, n // 2 + 1):
        own = [(a, b) for a, b, low, high in held if low <= p and (high is None or p < 2 * high)]
        assert all(any(a <= at and at + 2 * p <= b for a, b in own) for at in range(n - 2 * p + 1)), p


def expected(rows, planted):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if planted and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = sorted((s, p, e - s) for s, e, p in plain_stretches(words) if e - s >= 12)
        gone = {k for s, p, size in runs for k in range(s + p, s + size)}
        best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
        text = "".join(f"{s},{size},{p}\n" for s, p, size in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        first = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
        out.append((i, len(runs), *first, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


ODD = [None, "", " \n\t ", "x", "a " * 100, "\x1c a\x85a\xa0a " * 12, "é è " * 20, "tab\tand\x0btwo\x0c ends\r\n" * 9, "same same same same same same same same same same same same", " ".join("ab" * 6), " ".join("ab" * 5)]


@pytest.mark.parametrize("planted", [True, False])
def test_documents(spark, planted):
    rnd = random.Random(8)
    rows = [*enumerate(ODD + [" ".join(random_words(rnd, 90)) for _ in range(150)]), (None, "a b " * 9), (None, None), (4, "a " * 100), (4, "b c d " * 30)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    found = periodic.collapsed(periodic.with_planted_runs(docs) if planted else docs)
    assert found.columns == ["doc_id", "text", "key", *periodic.NEW]
    assert order(map(tuple, periodic.digests(found).collect())) == order(expected(rows, planted))


def test_tiles_stitched(monkeypatch):
    """Tiles solved one by one and their fragments merged as the shuffle does, against whole documents."""
    monkeypatch.setattr(periodic, "TILE", 64)
    monkeypatch.setattr(periodic, "LOW", 4)
    rnd = random.Random(1)
    for case in range(30):
        part = [rnd.choice("abcd") for _ in range(rnd.choice([1, 3, 9, 17, 40, 70]))]
        words = random_words(rnd, 150) + part * rnd.choice([2, 3, 9]) + part[: len(part) // 2] + random_words(rnd, 150)
        ids = np.array([ord(w) for w in words], np.int64)
        fragments = set()
        for a, b, low, high in periodic.tiles(len(ids)):
            _, start, stop, period = periodic.stretches([ids[a:b]], low, high)
            fragments |= set(zip(period.tolist(), (start + a).tolist(), (stop + a).tolist(), strict=True))
        merged = []
        for p, s, e in sorted(fragments):
            if merged and merged[-1][0] == p and s + p <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([p, s, e])
        assert sorted((s, e, p) for p, s, e in merged) == plain_stretches(words), case


def test_long_documents_in_spark(spark):
    rnd = random.Random(2)
    free = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    part, small = free(21_000), free(3)
    words = free(1000) + part * 3 + free(50_000) + small * 30_000 + free(500) + ["z"] * 11 + free(1) + ["y"] * 12
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(free(70_000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapsed(docs).collect()}
    at = 1000 + 63_000 + 50_000
    assert [tuple(r) for r in got[1].runs] == [(1000, 21_000, 63_000), (at, 3, 90_000), (at + 90_512, 1, 12)]
    assert got[1].collapsed.split(" ") == words[:22_000] + words[64_000 : at + 3] + words[at + 90_000 : at + 90_513]
    assert got[2].n_runs == 0 and got[2].collapsed == docs.where("doc_id = 2").first().text


def test_tables(spark):
    assert periodic.collapsed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="start"):
        periodic.collapsed(spark.createDataFrame([], "doc_id long, text string, START int"))
