"""Quality scores by compression: zstandard dictionaries of good and of bad text, and the calibrated difference of compressed sizes.

A text is cut into pieces of a fixed number of bytes and every piece is compressed with either dictionary. With G and B for the sums of
the sizes, the evidence is (B - G) / (B + G): above 0, the text looks more like the good examples. A logistic curve over the evidence,
fitted on labelled texts that the dictionaries haven't seen and weighted to the labels' own shares, turns it into a probability.

Defined results: null and empty texts have evidence 0 and get the share of good labels; if one label is missing from what may be learned,
every text gets the share of good labels (0.5 without labels); equal texts, and so repeated rows, get equal scores; labels other than 0 and 1,
or null, and rows with a null id are not learned from; very long texts are scored whole, piece by piece; further columns pass through, and a
clash with `score` or `evidence` raises; empty tables give no rows. Ids, sources, languages and labels of the scored rows are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import utf8
from .samples import labelled_sample


@dataclass(frozen=True)
class QualityConfig:
    """per_label: rows of each label, at most, that fitting reads; max_bytes: longer texts aren't fitted on."""

    per_label: int = 1500
    max_bytes: int = 20_000
    dictionary_bytes: int = 112_640
    piece_bytes: int = 1024
    level: int = 3
    dictionary_share: float = 0.6
    threshold: float = 0.7


@dataclass(frozen=True)
class QualityModel:
    config: QualityConfig
    good: bytes
    bad: bytes
    slope: float
    offset: float


class _Sizes:
    """Evidence of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, config: QualityConfig) -> None:
        import zstandard

        self.step, self.compress = config.piece_bytes, []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=config.level)
            self.compress.append(zstandard.ZstdCompressor(level=config.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def evidence(self, raw: memoryview) -> float:
        good, bad = (sum(len(c(raw[i : i + self.step])) for i in range(0, len(raw), self.step)) for c in self.compress)
        return (bad - good) / (bad + good) if len(raw) else 0.0


def _dictionary(texts: list[bytes], config: QualityConfig) -> bytes:
    """A trained dictionary or, if the texts are too few to train one, their ends."""
    import zstandard

    parts = [t[i : i + config.piece_bytes] for t in texts for i in range(0, len(t), config.piece_bytes)]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, parts, level=config.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-config.dictionary_bytes :].ljust(8, b" ")


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of y on x, by Newton steps; a small ridge keeps the slope finite."""
    a = np.stack([x, np.ones_like(x)], 1)
    scale = max(1e-9, float(x.std()))
    ridge = np.diag([1e-3 * scale**2, 1e-6]) * weight.sum()
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: list[int], share_good: float, config: QualityConfig) -> QualityModel:
    """Dictionaries from the first part of each label's texts, calibration on the others."""
    raw = [t.encode() for t in texts]
    kinds = [[r for r, l in zip(raw, labels, strict=True) if l == k] for k in (0, 1)]
    flat = min(max(share_good, 1e-3), 1 - 1e-3)
    none = QualityModel(config, b"", b"", 0.0, float(np.log(flat / (1 - flat))))
    if min(map(len, kinds)) < 2:
        return none
    cut = [max(1, min(len(k) - 1, int(len(k) * config.dictionary_share))) for k in kinds]
    bad, good = (_dictionary(k[:c], config) for k, c in zip(kinds, cut, strict=True))
    sizes = _Sizes(good, bad, config)
    x = [np.array([sizes.evidence(memoryview(r)) for r in k[c:]]) for k, c in zip(kinds, cut, strict=True)]
    y = np.repeat([0.0, 1.0], [len(x[0]), len(x[1])])
    weight = np.repeat([(1 - flat) / len(x[0]), flat / len(x[1])], [len(x[0]), len(x[1])]) * len(y)
    return QualityModel(config, good, bad, *_calibrate(np.concatenate(x), y, weight))


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Fits on a sample of `labels` (ids and labels 0 or 1), bounded by the config; the share of good ones is counted over all of them."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows = labelled_sample(docs, usable, label, config.per_label, config.max_bytes, doc_id, text)
    return train(list(rows.text), [int(x) for x in rows.label], 0.5 if share is None else share, config)


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score and evidence. keep: the columns to keep, all by default."""
    kept = docs.columns if keep is None else keep
    if clash := {"score", "evidence"} & set(kept):
        raise ValueError(f"the input already has {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.good, model.bad, model.config) if model.good else None
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            view = memoryview(np.ascontiguousarray(data))
            ends = offsets.tolist()
            x = np.array([sizes.evidence(view[a:b]) if sizes else 0.0 for a, b in zip(ends[:-1], ends[1:], strict=True)], float)
            y = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in kept} | {"score": pa.array(y, pa.float64()), "evidence": pa.array(x, pa.float64())})

    source = docs.select(*dict.fromkeys([*kept, text]))
    fields = [*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields))
