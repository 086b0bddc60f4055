"""Scores of the three classifiers against plain restatements of their models."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import arrowtext, langid, quality, toxicity

TEXTS = ["Plain words, here", "", "a", "  two  spaces\tand\nlines ", "Ünïcödé 日本語 text", "x" * 300, "word " * 3000, "same", "same", "end of it"]


def table(texts):
    return arrowtext.utf8(pa.array(texts, pa.string()))


def buckets(text, config):
    """The buckets of a text's n-grams, each hashed by itself in Python integers."""
    out, top = [], (1 << 64) - 1
    code = lambda c: int(arrowtext.mix(np.array([ord(c)], np.uint64))[0])
    for word in "".join(" " if c in " \t\n\v\f\r " else c for c in text.lower()).split(" "):
        marked = f" {word} "
        for n in config.sizes:
            for i in range(len(marked) - n + 1):
                gram = marked[i : i + n]
                if word and not (gram[0] == gram[-1] == " "):
                    h = 0
                    for c in gram:
                        h = (h * 0x9FB21C651E98DF25 + code(c)) & top
                    out.append(int(arrowtext.mix(np.array([(h + n) & top], np.uint64))[0]) >> (64 - config.bits))
    return out


def test_toxicity_is_the_mean_margin_of_all_ngrams():
    config = toxicity.ToxicityConfig(bits=12)
    rnd = np.random.default_rng(1)
    model = toxicity.ToxicityModel(config, rnd.normal(0, 1, 1 << 12).astype(np.float32), -0.3)
    texts = [t for t in TEXTS if len(t) < 6000]
    got = toxicity.log_odds(model, *table(texts))
    for t, odds in zip(texts, got, strict=True):
        own = buckets(t, config)
        expected = -0.3 + (float(np.mean(model.margin[own], dtype=float)) if own else 0.0)
        assert odds == pytest.approx(expected, abs=1e-5), repr(t[:20])


def test_toxicity_of_a_long_text_is_that_of_its_worst_window():
    config = toxicity.ToxicityConfig(bits=12, window_bytes=200)
    model = toxicity.ToxicityModel(config, np.random.default_rng(2).normal(0, 1, 1 << 12).astype(np.float32), 0.1)
    text = " ".join(random.Random(3).choice(["lamp", "river", "stone", "ünder"]) for _ in range(400))
    data, offsets = table([text])
    windows = list(toxicity._windows(data, offsets, 200))
    assert windows[0][1] == 0 and windows[-1][2] == len(data) and all(b - a < 260 for _, a, b in windows) and {row for row, _, _ in windows} == {0}
    assert all(p[1] < q[1] < p[2] < q[2] for p, q in zip(windows, windows[1:], strict=False))
    parts = [bytes(data[a:b]).decode() for _, a, b in windows]
    assert toxicity.log_odds(model, data, offsets)[0] == pytest.approx(max(toxicity.log_odds(model, *table([p]))[0] for p in parts), abs=1e-5)


def test_toxicity_does_not_jump_with_the_size_of_a_text():
    """Word by word, from under one window to over three, the score changes by no more than some words may change an average."""
    config = toxicity.ToxicityConfig(bits=12, window_bytes=400)
    model = toxicity.ToxicityModel(config, np.random.default_rng(2).normal(0, 1, 1 << 12).astype(np.float32), 0.1)
    rnd = random.Random(6)
    words = [rnd.choice(["lamp", "river", "stone", "ünder", "glass"]) for _ in range(260)]
    texts = [" ".join(words[:n]) for n in range(40, 260)]
    scores = toxicity.log_odds(model, *table(texts))
    assert np.abs(np.diff(scores)).max() < 0.2 * np.ptp(toxicity.log_odds(model, *table(words)))


def test_quality_evidence_and_calibration():
    import zstandard

    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["green", "river", "stone", "cloud"]) for _ in range(60)) for _ in range(80)]
    bad = [" ".join(rnd.choice(["###", "x1", "$$$", "buy"]) for _ in range(60)) for _ in range(80)]
    model = quality.train(good + bad, [1] * 80 + [0] * 80, 0.5, quality.QualityConfig())
    sizes = quality._Sizes(model.good, model.bad, model.config)
    for t in [*good[:3], *bad[:3], "other words", "y" * 5000]:
        raw = t.encode()
        total = []
        for content in (model.good, model.bad):
            press = zstandard.ZstdCompressor(level=model.config.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            total.append(sum(len(press.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)))
        assert sizes.evidence(memoryview(raw)) == pytest.approx((total[1] - total[0]) / sum(total))
    # The logistic curve is where the gradient of the weighted likelihood, with its ridge, is 0.
    x, y = np.array([0.3, 0.1, -0.2, 0.05, -0.4, 0.2]), np.array([1.0, 1, 0, 0, 0, 1])
    weight = np.array([1.0, 2, 1, 1, 0.5, 1])
    slope, offset = quality._calibrate(x, y, weight)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * x + b)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5 * weight.sum() * (1e-3 * x.std() ** 2 * a * a + 1e-6 * b * b)

    best = loss(slope, offset)
    assert all(loss(slope + d, offset + e) >= best - 1e-9 for d in (-0.1, 0, 0.1) for e in (-0.01, 0, 0.01))


def test_language_scores_are_those_of_the_network():
    rnd = np.random.default_rng(5)
    config = langid.LangIdConfig(window=24)
    total = config.filters * len(config.widths)
    filters = rnd.normal(0, 0.5, (4, 256, total))
    for i, w in enumerate(config.widths):
        filters[w:, :, i * config.filters : (i + 1) * config.filters] = 0
    filters[:, 0] = 0
    model = langid.LangIdModel(config, ("aa", "bb", "cc"), filters.astype(np.float32), rnd.normal(0, 0.1, total), rnd.normal(0, 0.5, (total, 3)), rnd.normal(0, 0.1, 3))
    texts = [t[:200] for t in TEXTS]
    names, score = langid._Predictor(model).predict(pa.array([*texts, None], pa.string()))
    for t, name, own in zip([*texts, None], names, score, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (name, own) == ("und", 0.0)
            continue
        raw = t.encode()
        log, held = np.zeros(3), 0
        for at in range(0, len(raw), config.window):
            part = raw[at : at + config.window]
            padded = part + bytes(config.window - len(part))
            best = np.max([[sum(filters[k, padded[p + k], f] for k in range(4)) for f in range(total)] for p in range(config.window - 3)], axis=0)
            logit = np.maximum(best + model.bias, 0) @ model.dense + model.dense_bias
            log += (logit - np.log(np.exp(logit).sum())) * len(part)
            held += len(part)
        prob = np.exp(log / held)
        prob /= prob.sum()
        # The tables' weights are rounded to 16 bits.
        assert own == pytest.approx(prob.max(), abs=2e-3)
        assert name == model.labels[int(prob.argmax())] or np.sort(prob)[-1] - np.sort(prob)[-2] < 4e-3


def test_clashing_names_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "green river"), (1, "green river"), (1, "green river"), (2, None)], "doc_id long, text string")
    models = [
        (toxicity.score, toxicity.ToxicityModel(toxicity.ToxicityConfig(bits=8), np.ones(256, np.float32), 0.0), ["score"]),
        (quality.score, quality.train([], [], 0.5, quality.QualityConfig()), ["score", "evidence"]),
        (langid.predict, None, ["lang_pred", "score"]),
    ]
    for apply, model, new in models:
        got = apply(docs, model).collect()
        assert len(got) == 4 and len({tuple(r[n] for n in new) for r in got if r.text}) == 1
        assert apply(docs.where("doc_id > 9"), model).count() == 0
        for n in new:
            with pytest.raises(ValueError, match="already has"):
                apply(docs.withColumn(n, F.lit(1)), model)
