"""Defined results of the training-data operators, against brute force on small inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import arrowtext, bpe, decontam, jaccard_join, langid, line_dedup, pii, quality, topk, toxicity, warc
from tracewright.operators.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [None, "", " \n\t ", "x", "é", "a" * 5000, LONG, "same text here now", "same text here now", "naïve 日本語 \U0001f600 mixed\r\nlines\n\n", "tab\tand  two  spaces ", "1234567890 " * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(ODD)] + [(None, "no id but text", "en", "s", 1), (7, "same text here now", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- Byte-level BPE


def test_bpe_is_tiktoken(spark, odd):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})
    got = bpe.decode(bpe.encode(odd, PATH, PATTERN, offsets=True), PATH, text=True).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r.text or ""
        assert r.ids == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.decoded_text == text
        assert len(r.starts) == len(r.ids) and all(0 <= s < len(text) for s in r.starts) and r.starts == sorted(r.starts)
    assert bpe.digests(empty(spark), PATH, PATTERN).count() == 0


def test_bpe_random_texts_and_split_characters(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab '\n\t  .1é日\U0001f600'sll\x85 \xa0​٣Ⅷ") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    encode = bpe._encoder(PATH, PATTERN)
    for t in texts:
        assert np.frombuffer(b"".join(encode(bpe._cuts(t))), np.int32).tolist() == own.encode_ordinary(t), repr(t)
    ids = own.encode_ordinary("\U0001f9ff")
    cut = spark.createDataFrame([(1, ids[:1]), (2, None)], "k int, ids array<int>")
    rows = {r.k: r for r in bpe.decode(cut, PATH, text=True).collect()}
    assert rows[1].decoded_text == own.decode_bytes(ids[:1]).decode("utf-8", "replace") and bytes(rows[2].decoded) == b""
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), PATH).collect()
    with pytest.raises(ValueError, match="already has"):
        bpe.encode(cut.withColumn("text", F.lit("x")), PATH, PATTERN)


# --- N-gram Jaccard join


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_finds_all_components(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(1, 60))] for _ in range(25)]
    passage = [rnd.choice(words) for _ in range(12)]
    rows = []
    for k in range(240):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if k % 3 == 0:
            t += passage
        rows.append((k, " ".join(t).title() if k % 5 == 0 else "\n".join(t)))
    # A chain of neighbours that link while its ends don't.
    chain = [f"c{i}" for i in range(70)]
    rows += [(1000 + k, " ".join(chain[k : k + 60])) for k in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.linked(frame, jaccard_join.JoinConfig(width=width, percent=percent)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, width, percent)


def test_join_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jaccard_join.linked(odd.withColumn("class", F.lit(1)).withColumn("th", F.lit(2))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    assert jaccard_join.linked(empty(spark)).count() == 0


def test_longer_prefixes_where_shingles_are_frequent():
    config = jaccard_join.JoinConfig()
    assert jaccard_join.prefix_length(100, np.zeros(0), 100, config) == (1, 16)
    least, length = jaccard_join.prefix_length(100, np.arange(1, 101.0), 0, config)
    assert least > 1 and length == 100 - 85 + least


# --- Line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for a in range(len(solid) - 2):
            key = tuple(lines[k] for k in solid[a : a + 3])
            if key in seen:
                gone |= set(range(solid[a], solid[a + 2] + 1))
            seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup(spark):
    rnd = random.Random(2)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(rnd.randrange(12)))) for k in range(60)] + [(100, "z\nz\nz\nz\nz")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute_lines(rows)
    assert {r.doc_id: r.text for r in got.collect()}[100].count("z") in (0, 1)


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and {r.n_lines for r in got if r.text is None} == {0}
    twins = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(twins).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="already has"):
        line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit(1)))


# --- Decontamination


def test_decontamination(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.randrange(15, 50))) for k in range(30)] + [(77, None), (78, "")]
    docs = [(k, text(rnd.randrange(5, 300))) for k in range(80)]
    planted = {}
    for k in range(30):
        w = docs[k][1].split()
        own = items[k][1].split()
        if k % 3 == 1:  # a paraphrase: every sixth word replaced
            own = [rnd.choice(words) if i % 6 == 5 else x for i, x in enumerate(own)]
        at = rnd.randrange(len(w) + 1)
        docs[k] = (k, " ".join(w[:at] + own + w[at:]))
        planted[k] = k
    docs += [(900, None), (901, ""), (902, LONG + " " + items[3][1]), (None, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("item_id", F.lit("clash"))
    got = decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == {*planted.items(), (902, 3), (None, 4)}
    assert decontam.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_items_in_most_rows(spark):
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hot, short = " ".join(f"hot{i}" for i in range(30)), "one two three four five"
    docs = [(k, f"{text(20)} {hot} {text(10)}" if k % 10 else text(60)) for k in range(200)] + [(1000 + k, f"{short} " * 40) for k in range(20)] + [(2000, f"{text(200)} {short} {text(200)}")]
    items = spark.createDataFrame([(1, hot), (2, short), (3, text(25))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {*((k, 1) for k in range(200) if k % 10), *((1000 + k, 2) for k in range(20)), (2000, 2)}


@pytest.mark.parametrize("item", [" ".join(f"w{i}" for i in range(30)), "one two three", "word", "same same same same", " ".join(f"w{i}" for i in range(1500))])
def test_decontamination_of_tables_of_copies(spark, item):
    docs = spark.createDataFrame([(k, item) for k in range(5)] + [(9, "other")], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(k, 1, 1.0) for k in range(5)]
    assert all(0 < r.cosine <= 1 for r in got)


def test_decontamination_leaves_texts_with_an_items_common_words(spark):
    rnd = random.Random(13)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(900)]
    plain = lambda n: " ".join(rnd.choice(["the", "of", "to", "and", "that", "is", "was"] if rnd.random() < 0.5 else words) for _ in range(n))
    item = "the heatou ononat to to the anor shheed eronnten onnt thin ndonsh of is the was that of"
    near = "to to the erheed inthou of is the ndst was that of"
    docs = spark.createDataFrame([(k, f"{plain(40)} {near} {plain(40)}") for k in range(100)] + [(500, f"{plain(40)} {item} {plain(40)}")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [500]


def test_lcs_by_bits():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam._lcs(decontam._places(a), b, len(a)) == table[-1][-1]


# --- Classifiers


def labelled(spark, n=400, seed=0):
    rnd = random.Random(seed)
    plain = ["lamp", "river", "green", "walk", "paper", "cloud", "table", "stone"]
    docs, labels = [], []
    for k in range(n):
        t = [rnd.choice(plain) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randrange(10, 80))]
        toxic, good = k % 4 == 0, k % 3 != 0
        for _ in range(3 if toxic else 0):
            t.insert(rnd.randrange(len(t)), rnd.choice(["moronic", "idiots", "stupidly"]))
        if not good:
            t = [f"{x}###" for x in t]
        docs.append((k, " ".join(t), "en" if k % 2 else "xx", None, None))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_subwords(spark, odd):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, toxicity.ToxicityConfig(per_label=150))
    probe = spark.createDataFrame([(1, "lamp river moronnic green walk idiotts paper"), (2, "lamp river green walk paper cloud")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] > 0.5 > got[2]
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    again = toxicity.fit(docs, labels, toxicity.ToxicityConfig(per_label=150))
    assert np.array_equal(model.margin, again.margin)
    one = toxicity.fit(docs, labels.where("toxic = 0"), toxicity.ToxicityConfig(per_label=50))
    assert all(r.score < 0.01 for r in toxicity.score(probe, one).collect())
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


def test_toxic_window_of_a_long_text(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, toxicity.ToxicityConfig(per_label=150))
    long = "lamp river green " * 20_000
    probe = spark.createDataFrame([(1, long), (2, long[:60_000] + "idiots moronic stupidly " * 30 + long[60_000:])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] < 0.5 < got[2]


def test_quality(spark, odd):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"), quality.QualityConfig(per_label=150))
    held = quality.score(docs.where("doc_id % 5 = 0"), model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.9
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and len({r.score for r in scores if not r.text}) == 1
    none = quality.fit(docs, labels.where("quality = 1"), quality.QualityConfig(per_label=50))
    assert all(r.score > 0.99 for r in quality.score(odd, none).collect())
    with pytest.raises(ValueError, match="already has"):
        quality.score(odd.withColumn("score", F.lit(1)), model)


def test_language_id(spark, odd):
    rnd = random.Random(8)
    parts = {"aa": ["tho", "ing", "wer", "ste"], "bb": ["ção", "nho", "lha", "gem"], "cc": ["szcz", "prze", "owy", "iej"]}
    rows = [(k, " ".join("".join(rnd.choice(parts[lang]) for _ in range(2)) for _ in range(rnd.randrange(8, 90))), lang, None, None) for k in range(360) for lang in [list(parts)[k % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, docs.where("doc_id % 4 <> 2"), langid.LangIdConfig(per_label=80, epochs=6))
    held = langid.predict(docs.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    for text, expected in ((None, ("und", 0.0)), ("", ("und", 0.0)), ("1234567890 " * 50, ("und", 0.0))):
        assert next(v for k, v in got.items() if k[1] == text) == expected
    assert all(langid.UNKNOWN == r.lang_pred for r in langid.predict(odd, None).collect())
    assert langid.fit(empty(spark), empty(spark)) is None


# --- Top-k


def test_topk_is_exact(spark):
    rnd = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rnd.normal(0, 0.6, (300, 7)))]
    rows = [(i, rows[4][1] if i % 4 == 1 else v, 0) for i, v, _ in rows]  # copies tie
    rows += [(900, None, 0), (901, [1.0, None] + [0.0] * 5, 0), (902, [float("nan")] * 7, 0), (903, [float("inf")] * 7, 0), (None, [0.1] * 7, 0), (50, rows[50][1], 0), (1000, [0.5, 0.5], 0), (1001, [0.25, -0.5], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect()
    fine = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for n, (q, own) in enumerate(fine):
        if q % 50 == 0:
            near = sorted((-int(own @ v), i) for m, (i, v) in enumerate(fine) if m != n and len(v) == len(own))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)
    assert topk.top_k(frame.where("vec_id < 0"), F.col("vec_id") % 50 == 0, 5).count() == 0


# --- PII


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark, odd):
    rnd = random.Random(10)
    for _ in range(5000):
        t = "".join(rnd.choice("01 .-+@a()9%é") for _ in range(rnd.randrange(50)))
        assert pii.base_spans(t) == brute_base(t), repr(t)
    texts = ["mail anna [at] corp [dot] com or call (030) 555-9912", "host 10[.]2[.]3[.]4 seen", "a@b.co and 4111 1111 1111 1111", "plain words, at home, dot. (aside) [1] 2024"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(frame).collect()}
    assert got == {0: [("email", "anna [at] corp [dot] com"), ("phone", "(030) 555-9912")], 1: [("ip", "10[.]2[.]3[.]4")], 2: [("email", "a@b.co"), ("card", "4111 1111 1111 1111")], 3: []}
    for r in pii.find_pii(odd).collect():
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.base] == brute_base(r.text or "")
        assert {(s.kind, s.start, s.end) for s in r.base} <= {(s.kind, s.start, s.end) for s in r.spans}
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_finds_each_form_as_a_whole_text(spark):
    forms = [(m[2], m[1]) for line in pii.LABELLED.splitlines() for m in pii._MARK.finditer(line)]
    inside = ["so write to Jane Dot Doe AT mail DOT com about the order", "we met at noon. later he was at home at last with the dot on it", "at the station. we dot the map and go at once"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in forms] + inside)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(frame, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(forms))] == [[(kind, 0, len(t))] for t, kind in forms]
    assert [got[len(forms) + i] for i in range(3)] == [[("email", 12, 40)], [], []]


# --- WARC


def test_fixity_audit(spark):
    pages = [(k, f"http://x/{k}", f"<p>{k}</p>") for k in range(600)] + [(None, None, "orphan"), (5, None, None)]
    kind = "page_id long, url string, html string"
    first = warc.records(spark.createDataFrame(pages, kind).repartition(3))
    changed = [(k, u, "<p>bad</p>" if k == 300 else h) for k, u, h in pages]
    second = warc.records(spark.createDataFrame(changed, kind)).where("NOT (file_id = 2 AND ordinal > 80) AND file_id >= 0")
    got = warc.audit(first, second).collect()
    status = collections.Counter(r.status for r in got)
    assert len(got) == len(pages) and status["corrupt"] == 1 and status["missing"] == 600 - 2 * 256 - 81 + 1
    assert [r.page_id for r in got if r.status == "corrupt"] == [300]
    assert all(r.root_a == r.root_b for r in got if r.file_id == 0)
    one = next(r for r in first.collect() if r.page_id == 7)
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://x/7\r\nContent-Type: text/html\r\nContent-Length: 8\r\n\r\n<p>7</p>\r\n\r\n"
    assert one.sha256 == hashlib.sha256(text.encode()).hexdigest() and one.length == len(text)
    none = warc.records(spark.createDataFrame([], kind))
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(none, first).collect()} == {"extra"}


# --- Helpers


def test_pieces_and_words_cover_all_bytes():
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab é\n日") for _ in range(rnd.randrange(60))) for _ in range(200)] + [None]
    data, offsets = arrowtext.utf8(pa.array(texts)[3:])
    out = collections.defaultdict(bytes)
    for rows, raw, ends in arrowtext.pieces(data, offsets, 16):
        for k, r in enumerate(rows):
            out[int(r)] += raw[ends[k] : ends[k + 1]].tobytes()
    assert [out[i].decode() for i in range(len(texts) - 3)] == [t or "" for t in texts[3:]]
    start, end, row = arrowtext.words(data, offsets)
    got = collections.defaultdict(list)
    for s, e, r in zip(start, end, row):
        got[int(r)].append(data[s:e].tobytes())
    assert [got[i] for i in range(len(texts) - 3)] == [(t or "").encode().split() for t in texts[3:]]


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "a\nb\nc")]
    names = ["_lines", "_rid", "_rth", "_id", "_th", "runs", "_row", "first", "h1"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert {k: r.text for k, r in got.items()} == {None: "a\nb\nc", 1: "", 2: "d"}
    assert all(r[n] == n for r in got.values() for n in names)


def test_a_long_run_is_one_word(spark):
    raw = np.frombuffer(b"x1" * 400_000, np.uint8)
    assert arrowtext.long_word_hash(raw, 1000) == arrowtext.word_hashes(raw, np.array([0]), np.array([len(raw)]))
    run = "ab" * 200_000
    rows = [(1, f"a b c {run}"), (2, f"a b c {run} d"), (3, run), (4, f"A B\tC {run}\n"), (5, f"{run} {run[:-1]} x")]
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)


def test_join_where_shingles_share_slots_and_lists_are_long(spark, monkeypatch):
    for name, value in (("SLOT_BITS", 9), ("FREQUENT", 4), ("DEALT", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(20, 60))] for _ in range(12)]
    rows = []
    for k in range(200):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((k, " ".join(t)))
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)


def test_more_labels_than_allowed_raise(spark):
    from tracewright.llm.samples import labelled_sample

    docs = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(70)], "doc_id long, text string, lang string")
    assert set(labelled_sample(docs, docs, "lang", 5, 100).label) == {f"l{k}" for k in range(70)}
    with pytest.raises(ValueError, match="more than 69 labels"):
        labelled_sample(docs, docs, "lang", 5, 100, most_labels=69)


def test_fixity_of_long_contents_and_clashing_columns(spark):
    pages = [(1, "u", "x" * 3_000_000), (2, None, None), (2, None, None), (300, "v", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("file_id", "ordinal", "sha256", "offset", "_record", "length")})
    got = warc.records(frame).collect()
    assert len(got) == 4 and max(r.length for r in got) > 3_000_000
    assert {r.status for r in warc.audit(warc.records(frame), warc.records(frame.repartition(3))).collect()} == {"ok"}
