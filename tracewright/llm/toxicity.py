"""Toxicity scores: subword vectors averaged into a linear softmax, both trained together in numpy.

A text is the bag of the character n-grams of its lower-cased words, each word with a mark on either side, hashed into a fixed number of
buckets. Every bucket has a vector; a text's vector is the average of its n-grams' vectors, and a softmax over it gives the two classes.
Misspellings and unseen forms of a word share most of its n-grams and so its vectors. Buckets seen in few training texts stay at zero,
so that what was never learned has no say.

As the softmax is linear, a bucket's vector counts only through its margin between the two classes: prediction adds up one number for
each n-gram, in one pass over the characters. A text's log odds are those of its most toxic window, so that an insult isn't averaged away by
a long text around it; windows overlap by half, and a text of up to a window is one. What is learned from is one window each, too.

Defined results: null and empty texts, and texts without words, have an empty bag and get the score of the softmax's offset alone; with
one label missing from what may be learned, every text gets that label's share (0 without labels); equal texts, and so repeated rows, get
equal scores; labels other than 0 and 1, or null, and rows with a null id are not learned from; very long texts are scored whole, window by
window; further columns pass through, and a clash with `score` raises; empty tables give no rows. Ids, sources, languages and labels of
scored rows are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import IS_SPACE, mix, utf8
from .samples import labelled_sample


@dataclass(frozen=True)
class ToxicityConfig:
    """per_label: rows of each label, at most, that training reads; max_bytes: longer texts aren't trained on."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 19
    dimensions: int = 4
    per_label: int = 2000
    max_bytes: int = 8000
    min_texts: int = 4
    gain: float = 60.0
    epochs: int = 8
    batch: int = 32
    rate: float = 0.4
    decay: float = 1e-5
    window_bytes: int = 8000
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    config: ToxicityConfig
    margin: np.ndarray  # by bucket: what an n-gram adds to the log odds, times the length of the bag
    offset: float


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of the rows as code points, every row after a space and the last one before one; where rows begin."""
    raw = memoryview(np.ascontiguousarray(data))
    texts = [bytes(raw[a:b]).decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    joined = " " + " ".join(texts) + " "
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts


def bags(data: np.ndarray, offsets: np.ndarray, config: ToxicityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all n-grams, for one n-gram size after the other; n-grams don't cross white space."""
    chars, starts = _characters(data, offsets)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13)) | (chars == 0xA0)
    code = mix(np.where(space, np.uint32(32), chars).astype(np.uint64))
    gaps = np.concatenate([[0], np.cumsum(space)])
    row = np.searchsorted(starts, np.arange(len(chars)), "right") - 1
    shift = np.uint64(64 - config.bits)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(code), np.uint64)
        for n in range(1, max(config.sizes) + 1):
            if len(code) < n:
                return
            rolled = rolled[: len(code) - n + 1] * np.uint64(0x9FB21C651E98DF25) + code[n - 1 :]
            if n in config.sizes:
                # White space may only be the first or the last character, and not both.
                inner = gaps[n - 1 : len(gaps) - 1] - gaps[1 : len(gaps) - n + 1]
                fine = (inner == 0) & ~(space[: len(rolled)] & space[n - 1 :])
                yield (mix(rolled[fine] + np.uint64(n)) >> shift).astype(np.int64), row[: len(rolled)][fine]


def train(texts: list[str], labels: list[int], config: ToxicityConfig) -> ToxicityModel:
    """Adagrad on the cross-entropy, over batches of texts; the buckets' vectors and the softmax share every step."""
    size = 1 << config.bits
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(config, np.zeros(size, np.float32), 30.0 if share == 1 else -30.0)
    random = np.random.default_rng(config.seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    lengths, seen = [], np.zeros(size, np.int32)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, count = np.unique(np.concatenate([np.zeros(0, np.int64), *(b for b, _ in bags(raw, np.array([0, len(raw)]), config))]), return_counts=True)
        seen[ids] += 1
        rows.append((ids.astype(np.int32), count.astype(np.float32)))
        lengths.append(max(1.0, float(count.sum())))
    keep = seen >= config.min_texts
    slot = np.cumsum(keep) - 1
    n = int(keep.sum())
    rows = [(slot[i[k]].astype(np.int32), c[k]) for i, c in rows for k in [keep[i]]]
    vectors = random.normal(0, 0.05, (n, config.dimensions)).astype(np.float32)
    dense = random.normal(0, 0.3, (config.dimensions, 2)).astype(np.float32)
    offset = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    sums = [np.full(a.shape, 1e-6, np.float32) for a in (vectors, dense, offset)]
    for epoch in range(config.epochs):
        order = random.permutation(len(rows))
        rate = config.rate * (1 - epoch / config.epochs)
        for at in range(0, len(order), config.batch):
            batch = order[at : at + config.batch]
            ids = np.concatenate([rows[i][0] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            weight = np.concatenate([rows[i][1] * (config.gain / lengths[i]) for i in batch])
            hidden = np.stack([np.bincount(owner, vectors[ids, k] * weight, len(batch)) for k in range(config.dimensions)], 1)
            logit = hidden @ dense + offset
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(batch)), y[batch]] -= 1
            prob /= len(batch)
            back = prob @ dense.T
            used, place = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(place, back[owner, k] * weight, len(used)) for k in range(config.dimensions)], 1).astype(np.float32)
            g += config.decay * vectors[used]
            sums[0][used] += g * g
            vectors[used] -= rate * g / np.sqrt(sums[0][used])
            for own, grad, total in ((dense, hidden.T @ prob, sums[1]), (offset, prob.sum(0), sums[2])):
                total += grad * grad
                own -= rate * grad / np.sqrt(total)
    margin = np.zeros(size, np.float32)
    margin[keep] = (vectors @ (dense[:, 1] - dense[:, 0])) * config.gain
    return ToxicityModel(config, margin, float(offset[1] - offset[0]))


def _windows(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(row, from, to) of each row's windows: the whole row or, if it is longer than `size`, overlapping windows of about that size, evenly spaced
    by at most half of it, from its start to its end. They begin and end at separators, where one is near, and split no character.

    A row that grows beyond a window gets two that are nearly all of it, so that its score changes no more than its text does.
    """

    def placed(lo: int, hi: int, at: int) -> int:
        near = np.flatnonzero(IS_SPACE[data[max(lo, at - size // 8) : at]]) if lo < at < hi else ()
        if len(near):
            return max(lo, at - size // 8) + int(near[-1]) + 1
        while lo < at < hi and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        more = max(0, -(-(hi - lo - size) // (size // 2)))
        for k in range(more + 1):
            start = lo + (hi - lo - size) * k // more if more else lo
            yield row, placed(lo, hi, start), placed(lo, hi, start + size) if k < more else hi


def log_odds(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each row's log odds of label 1: those of its most toxic window."""
    out = np.full(len(offsets) - 1, -np.inf)

    def solve(block: list[tuple[int, int, int]]) -> None:
        ends = np.cumsum([0, *(b - a for _, a, b in block)])
        total, count = np.zeros(len(block)), np.zeros(len(block))
        for bucket, row in bags(np.concatenate([data[a:b] for _, a, b in block]), ends, model.config):
            total += np.bincount(row, model.margin[bucket], len(block))
            count += np.bincount(row, minlength=len(block))
        np.maximum.at(out, [row for row, _, _ in block], model.offset + total / np.maximum(count, 1))

    block: list[tuple[int, int, int]] = []
    held = 0
    for own in _windows(data, offsets, model.config.window_bytes):
        block.append(own)
        held += own[2] - own[1]
        if held > 1 << 19:
            solve(block)
            block, held = [], 0
    if block:
        solve(block)
    return out


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fits on a sample of `labels` (ids and labels 0 or 1), bounded by the config; the offset is set to the share of label 1 in all of them."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows = labelled_sample(docs, usable, label, config.per_label, config.max_bytes, doc_id, text)
    y = [int(v) for v in rows.label]
    model = train(list(rows.text), y, config)
    if len(set(y)) < 2:
        return model
    there, own = (np.clip(x, 1e-4, 1 - 1e-4) for x in (share, float(np.mean(y))))
    return ToxicityModel(config, model.margin, model.offset + float(np.log(there / (1 - there)) - np.log(own / (1 - own))))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, the probability of label 1. keep: the columns to keep, all by default."""
    kept = docs.columns if keep is None else keep
    if "score" in {c.lower() for c in kept}:
        raise ValueError("the input already has score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as its buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = log_odds(sent.value, *utf8(batch.column(text)))
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in kept} | {"score": pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())})

    source = docs.select(*dict.fromkeys([*kept, text]))
    return source.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())]))
