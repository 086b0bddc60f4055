"""Language ID by a byte convolutional network: filters of several widths, max pooling and a softmax, trained in numpy.

A text's bytes are cut into windows of a fixed length, the last one filled up with zero bytes, so that whole texts of any length are read
in equal batches. Every filter is a table of a weight for each byte at each of its places; a filter's response at a place is the sum of
its weights for the bytes there. The strongest response in the window (max pooling, then ReLU) goes to a softmax over the languages. A
text's class scores are the windows' log probabilities, averaged by the bytes they hold.

For prediction the weights of bytes 0-1 and of bytes 2-3 of each filter are added up beforehand into two tables of 65,536 rows in int16, so
that a place costs two table reads for all filters together.

Defined results: null texts and texts without a letter are `und` with score 0; empty tables give no rows; if there is nothing to learn
from, every text with a letter is `und` with score 0; equal texts, and so repeated rows, get equal predictions; ties go to the first language
by name; very long texts are read whole, window by window; further columns pass through, and a clash with `lang_pred` or `score` raises. Ids,
sources and languages of the scored rows are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import spans, utf8
from .samples import labelled_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdConfig:
    """per_label: rows of each language, at most, that training reads; max_bytes: longer texts aren't trained on, others in all their windows."""

    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    per_label: int = 500
    max_bytes: int = 2000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class LangIdModel:
    config: LangIdConfig
    labels: tuple[str, ...]
    filters: np.ndarray  # [place 0-3, byte, filter]; weights beyond a filter's width are 0
    bias: np.ndarray
    dense: np.ndarray  # [filter, label]
    dense_bias: np.ndarray


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each row, with the row of each and how many bytes it holds."""
    size = np.diff(offsets)
    count = -(-size // length)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) * length, np.uint8)
    for lo, hi, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (first * length).tolist(), strict=True):
        out[at : at + hi - lo] = data[lo:hi]
    row = np.repeat(np.arange(len(size)), count)
    held = np.minimum(length, size[row] - (np.arange(len(row)) - first[row]) * length)
    return out.reshape(-1, length), row, held


def _responses(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """[window, place, filter]; places at which four bytes remain."""
    places = x.shape[1] - 3
    return sum(filters[k][x[:, k : k + places]] for k in range(4))


def train(texts: list[str], labels: list[str], config: LangIdConfig) -> LangIdModel:
    """Adam on the cross-entropy of the windows' labels; the gradient of a pooled response goes to the bytes of the strongest place."""
    random = np.random.default_rng(config.seed)
    names = tuple(sorted(set(labels)))
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            continue
        win, _, _ = _windows(raw, np.array([0, len(raw)]), config.window)
        # A short start of a window is seen as well, as short texts are made of it.
        for w in win.copy():
            if random.random() < 0.25:
                w[int(random.integers(12, config.window)) :] = 0
            xs.append(w)
            ys.append(names.index(label))
    x, y = np.array(xs), np.array(ys)
    n, total = len(names), config.filters * len(config.widths)
    mask = np.zeros((4, 1, total), np.float32)
    for i, w in enumerate(config.widths):
        mask[:w, :, i * config.filters : (i + 1) * config.filters] = 1
    p = {
        "filters": random.normal(0, 0.3, (4, 256, total)).astype(np.float32) * mask,
        "bias": np.zeros(total, np.float32),
        "dense": random.normal(0, 0.3, (total, n)).astype(np.float32),
        "dense_bias": np.zeros(n, np.float32),
    }
    p["filters"][:, 0] = 0  # the filling
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, cols = 0, np.arange(total)
    for _ in range(config.epochs):
        order = random.permutation(len(x))
        for at in range(0, len(order), config.batch):
            rows = order[at : at + config.batch]
            bx, by, size = x[rows], y[rows], len(rows)
            got = _responses(bx, p["filters"])
            best = got.argmax(1)  # [window, filter]
            pooled = np.take_along_axis(got, best[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            logit = hidden @ p["dense"] + p["dense_bias"]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(size), by] -= 1
            prob /= size
            back = (prob @ p["dense"].T) * (pooled > 0)
            g = {"dense": hidden.T @ prob, "dense_bias": prob.sum(0), "bias": back.sum(0), "filters": np.zeros_like(p["filters"])}
            for k in range(4):
                np.add.at(g["filters"][k], (np.take_along_axis(bx, best + k, 1), np.broadcast_to(cols, best.shape)), back)
            g["filters"] *= mask
            g["filters"][:, 0] = 0
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= config.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return LangIdModel(config, names, p["filters"], p["bias"], p["dense"], p["dense_bias"])


class _Predictor:
    def __init__(self, model: LangIdModel) -> None:
        import regex

        self.model, self.letter = model, regex.compile(r"\p{L}")
        f = model.filters
        front, back = ((f[k][:, None] + f[k + 1][None]).reshape(65536, -1) for k in (0, 2))
        self.scale = 16000 / max(1e-6, np.abs(front).max(), np.abs(back).max())
        self.front, self.back = (np.round(t * self.scale).astype(np.int16) for t in (front, back))

    def log_probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[row, label]: the windows' log probabilities, averaged by the bytes they hold."""
        m, out, weight = self.model, np.zeros((len(offsets) - 1, len(self.model.labels))), np.zeros(len(offsets) - 1)
        length = m.config.window
        x, row, held = _windows(data, offsets, length)
        for at in range(0, len(x), 1024):
            w = x[at : at + 1024]
            pair = w[:, :-1].astype(np.uint16) * np.uint16(256) + w[:, 1:]
            got = self.front[pair[:, : length - 3]]
            got += self.back[pair[:, 2:]]
            hidden = np.maximum(got.max(1) / self.scale + m.bias, 0)
            logit = hidden @ m.dense + m.dense_bias
            top = logit.max(1, keepdims=True)
            log = logit - top - np.log(np.exp(logit - top).sum(1, keepdims=True))
            np.add.at(out, row[at : at + 1024], log * held[at : at + 1024, None])
            np.add.at(weight, row[at : at + 1024], held[at : at + 1024])
        return out / np.maximum(weight, 1)[:, None]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = utf8(column)
        scores = []
        for a, b in spans(offsets):
            lo = offsets[a]
            log = self.log_probability(data[lo : offsets[b]], offsets[a : b + 1] - lo)
            scores.append(np.exp(log - log.max(1, keepdims=True)))
        prob = np.concatenate(scores) if scores else np.zeros((0, len(self.model.labels)))
        prob /= prob.sum(1, keepdims=True)
        names = [self.model.labels[k] for k in prob.argmax(1)]
        score = prob.max(1)
        for i, t in enumerate(column.to_pylist()):
            if t is None or not self.letter.search(t):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score


def fit(docs: DataFrame, labelled: DataFrame, config: LangIdConfig = LangIdConfig(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LangIdModel | None:
    """Trains on a sample of `labelled` (ids and languages), bounded by the config; None if there is none."""
    rows = labelled_sample(docs, labelled, lang, config.per_label, config.max_bytes, doc_id, text)
    rows = rows[rows.text.str.len() > 0]
    return train(list(rows.text), list(rows.label), config) if len(rows) else None


def predict(docs: DataFrame, model: LangIdModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score. keep: the columns to keep, all by default."""
    kept = docs.columns if keep is None else keep
    if clash := {"lang_pred", "score"} & set(kept):
        raise ValueError(f"the input already has {sorted(clash)}")
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _Predictor(model)
        for batch in batches:
            names, score = predictor.predict(batch.column(text))
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in kept} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    source = docs.select(*dict.fromkeys([*kept, text]))
    fields = [*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields))
