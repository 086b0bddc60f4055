"""Recall of the decontamination operator, with its production settings, against exact cosines and brute-force containment."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontam

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark):
    """The given documents and items, and documents with paraphrases of items: words replaced, dropped and put in."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rnd = random.Random(1)
    prose = [w for _, t in docs for w in (t or "").split()[:200]]
    for k in range(60):
        own = []
        for w in rnd.choice(items)[1].split():
            luck = rnd.random()
            own += [] if luck < 0.08 else [rnd.choice(prose)] if luck < 0.25 else [w, rnd.choice(prose)] if luck < 0.33 else [w]
        around = [[rnd.choice(prose) for _ in range(rnd.randrange(80))] for _ in range(2)]
        docs.append((10**6 + k, " ".join(around[0] + own + around[1])))
    return docs, items


def hashes(text):
    return np.concatenate([np.zeros(0, np.uint64), *(h for _, h in decontam._hashed(pa.array([text], pa.string())))])


def test_recall(spark, tables):
    docs, items = tables
    config = decontam.DecontamConfig()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    source = frame.select(F.col("text").alias("_text"))
    idf = decontam.inverse_frequency(source, "_text", config)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), config).collect()}
    # The rule itself, on every window of every document that shares enough words with an item.
    known = [(i, hashes(t)) for i, t in items]
    block = decontam._Block([i for i, _ in items], [t for _, t in items], np.zeros(0, int), np.zeros((0, 1), np.float32), idf, config)
    bags = [Counter(h.tolist()) for _, h in known]
    expected = set()
    for d, t in docs:
        own = hashes(t or "")
        whole = Counter(own.tolist())
        for k, (i, h) in enumerate(known):
            if sum((bags[k] & whole).values()) < min(config.paraphrased, config.copied) * len(h):
                continue
            for at in range(0, len(own), config.block):
                lo, hi = max(0, at - len(h)), at + 2 * config.block + len(h)
                part = own[lo:hi].tolist()
                if sum((bags[k] & Counter(part)).values()) >= config.paraphrased * len(h) and block.check(part, k)[2]:
                    expected.add((d, i))
                    break
    found = len(expected & got) / len(expected)
    planted = sum(d >= 10**6 for d, _ in expected)
    assert planted >= 40 and found >= 0.9, (found, planted, len(expected))


def test_candidates_against_exact_cosines(spark, tables):
    docs, items = tables
    config = decontam.DecontamConfig()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    idf = decontam.inverse_frequency(frame, "text", config)
    texts = [t for _, t in items]
    rows = spark.createDataFrame([(t, True) for t in texts] + [(t, False) for _, t in docs if t][:200], "text string, is_item boolean").repartition(4)
    features, matrix = decontam.latent_basis(rows, len(texts), idf, config)
    block = decontam._Block(list(range(len(texts))), texts, features, matrix, idf, config)
    feature = lambda h: (h >> np.uint64(64 - config.bits)).astype(int)

    def vector(f):
        own, n = np.unique(f, return_counts=True)
        w = n * idf[own]
        return dict(zip(own.tolist(), (w / np.sqrt((w * w).sum())).tolist(), strict=True))

    vectors = [vector(feature(hashes(t))) for t in texts]
    hit = total = 0
    for _, t in docs:
        own = hashes(t or "")
        if not len(own):
            continue
        first, _, item, _ = block.candidates(np.zeros(len(own), int), own)
        found = set(zip(first.tolist(), item.tolist(), strict=True))
        f = feature(own)
        for at in range(0, len(own), config.block):
            window = vector(f[at : at + 2 * config.block])
            for i, v in enumerate(vectors):
                if sum(x * v.get(w, 0.0) for w, x in window.items()) >= config.cosine * 1.05:
                    total += 1
                    hit += (at, i) in found
    assert total > 200 and hit / total >= 0.9, (hit, total)
