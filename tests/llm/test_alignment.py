"""Cross-tokenizer alignment against a plain version: whole texts encoded at once, byte ranges compared, documents counted in dictionaries."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "x", "\n", " \n\t ", "a ▁ b", "▁", "<|endoftext|> and <s> </s><unk>", "tab\tand  two  spaces ", "é 日本語 \U0001f600 mixed\r\nlines\n\n", "a\x1c b\x85 c\xa0 d e",
    "don't we'll I'M", "0123456789 " * 40, "a" * 3000, "word " * 4000, "\x00 nul ﻿ bom", "ﬁ ligature ½ ①", "same text", "same text",
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(A)
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=B)
    table = {c: b for b, c in enumerate(alignment.byte_characters())}
    a_bytes = lambda i: bytes(table[c] for c in a_library.id_to_token(i))

    def b_bytes(i):
        piece = b_library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_library.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes(x)) for x in a]).tolist(), np.cumsum([len(b_bytes(x)) for x in b]).tolist()
        links, groups, j = [], [], 0
        for k, end in enumerate(ends_a):
            start = ends_a[k - 1] if k else 0
            while ends_b[j] <= start:
                j += 1
            m = j
            while m < len(b) and (ends_b[m - 1] if m else 0) < end:
                links.append((a[k], b[m]))
                m += 1
        at_a = at_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ka, kb = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append(",".join(map(str, a[at_a:ka])) + "|" + ",".join(map(str, b[at_b:kb])))
            at_a, at_b = ka, kb
        docs.append((i, a, b, groups, links))
    count, times = collections.Counter(p for d in docs for p in set(d[4])), collections.Counter(p for d in docs for p in d[4])
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = [
        (i, len(a), len(b), len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, ls in docs
    ]
    return out, {(*p, n, times[p], n == most[p[0]]) for p, n in count.items()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("links", [alignment.CHUNK_LINKS, 300])
def test_equals_whole_texts(spark, links, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    rnd = random.Random(5)
    words = [a + b for a in ("un", "multi", "re", "", "zu") for b in ("believable", "token", "izer", "日本", "Straße", "naïve", "12345", "'s", "...", "\n", "\t", " ")]
    texts = ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(200)]
    rows = [*enumerate(texts), (None, "no id but text"), (3, "same text"), (19, "same text")]
    # Functions sent to workers carry the module's name only, so the smaller bound is tested in this process.
    if links == 300:
        made = list(alignment._index_batches(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})]), A, B))
        frame = spark.createDataFrame(pa.Table.from_batches(made))
        index = alignment.Index(frame.where("kind = 0"), frame.where("kind = 1"))
        assert frame.where("kind = 1").select("chunk").distinct().count() > 20
    else:
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, pair string").repartition(3)
        index = alignment.indexed(docs, A, B)
        got = alignment.aligned(docs, A, B).collect()
        assert order(map(tuple, got)) == order(plain(rows)[0])
    expected, counts = plain(rows)
    assert {tuple(r)[1:] for r in alignment.pair_counts(index).collect()} == counts
    back = index.docs.join(alignment.scores(index), ["chunk", "place"], "left").fillna(0, ["n_best", "count_sum"])
    assert order(map(tuple, back.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == order(expected)


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(2)
    places = [np.sort(rnd.choice(65536, n, replace=False)) for n in (1, 4095, 4096, 4097, 65536, 2)]
    keys, n, bits = alignment.containers(np.repeat(np.arange(6), [len(p) for p in places]), np.concatenate(places))
    assert keys.tolist() == list(range(6)) and n.tolist() == [len(p) for p in places]
    assert max(len(b) for b in bits.to_pylist()) == 8192
    back, sizes = alignment.places_of(bits)
    assert sizes.tolist() == n.tolist() and (back == np.concatenate(places)).all()
    assert all(len(x) == 0 for x in alignment.places_of(pa.array([], pa.binary())))


def test_empty_table(spark):
    got = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
