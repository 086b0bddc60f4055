"""Benchmark decontamination by latent semantic retrieval.

1. Counts: how often every hashed word occurs in all documents gives its inverse frequency, smoothed so that no word's weight is zero.
2. Fit: the TF-IDF rows of all documents and of all benchmark items are two matrices, whose leading right singular vectors a distributed
   randomised SVD finds: a Gaussian start, power steps of which each multiplies all rows in Spark and adds up the products by word, and an
   orthonormal basis after each on the driver, which holds only (hashed words) x (components). No document is left out or drawn; each is
   a row. Items are fitted in blocks of at most as many items as there are components. A block's basis spans its items' vectors, all of
   them, and the documents' leading ones, so that a projection keeps every product with an item.
3. Search: every document's words are cut into passages of BLOCK words, and windows of two neighbouring passages are projected. An item is
   a candidate if the cosine, with the norms before the projection, reaches a bound, or, whatever its words weigh, if a run of `run` of
   its words (all of them, if they are fewer) begins in the window.
4. Check: the longest common subsequence of the item's words and the document's words around the candidate windows. An item counts as
   contained if the subsequence holds a set share of its words, or a lower share together with the item's answer, its last words, for
   paraphrases; a common subsequence must then hold the lower share of the item's weight, too, as words like "of the" alone say nothing.

Words are runs of letters and digits, with A-Z in lower case. Defined results: null and empty texts contain nothing; items without words
are contained nowhere; null ids are kept as they are; equal texts get equal results, and repeated rows repeated results; an item that
occurs twice in a document gives one row, for the place with the longest subsequence, the first one among equals; very long texts are read
whole, in parts that begin with the words before them in which an item may begin; empty tables give no rows. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written
from .arrowtext import lower_ascii, pieces, utf8, word_hashes, words

#: Everything but letters and digits separates words here; bytes of other characters than ASCII's count as letters.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class DecontamConfig:
    """fit_weight: of passages of other texts, if latent_basis() is given any beside the items. document_components: of the documents' own basis."""

    bits: int = 16
    components: int = 256
    document_components: int = 32
    power_steps: int = 2
    fit_weight: float = 0.1
    block: int = 12
    cosine: float = 0.2
    copied: float = 0.6
    paraphrased: float = 0.4
    answer: float = 0.75
    fewest: int = 8
    run: int = 8
    items_at_once: int = 2048
    seed: int = 5


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, word hash) of consecutive words, for some rows, or a part of a row, after the other."""
    data, offsets = utf8(column)
    for rows, raw, ends in pieces(data, offsets):
        raw = lower_ascii(raw)
        start, end, row = words(raw, ends, GAP)
        yield rows[row], word_hashes(raw, start, end)


def document_rows(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(features, counts, ends): the hashed words of documents with their numbers, many documents in a row; ends has where each stops.

    Numbers are as wide as they must be, see _told(). A text of more than BLOCK_BYTES comes in parts that count as documents.
    """
    kind = np.min_scalar_type((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes in _hashed(batch.column(0)):
                if len(row):
                    key, n = np.unique((row - row[0]).astype(np.uint64) << np.uint64(bits) | hashes >> np.uint64(64 - bits), return_counts=True)
                    key = key.astype(np.int64)
                    ends = np.append(np.flatnonzero(np.diff(key >> bits)) + 1, len(key))
                    parts = {"features": (key & ((1 << bits) - 1)).astype(kind), "counts": n.astype(np.min_scalar_type(n.max())), "ends": ends.astype(np.uint32)}
                    yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

    return docs.select(text).mapInArrow(run, "features binary, counts binary, ends binary")


def _told(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, counts and ends of each row of document_rows()."""
    for features, counts, ends in zip(*(batch.column(c).to_pylist() for c in ("features", "counts", "ends")), strict=True):
        own = np.frombuffer(features, np.min_scalar_type((1 << bits) - 1))
        yield own, np.frombuffer(counts, f"u{len(counts) // len(own)}"), np.frombuffer(ends, np.uint32).astype(int)


def word_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(feature, n): how often words with each hashed number occur in all documents. rows: see document_rows()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for features, counts, _ in _told(batch, bits):
                total += np.bincount(features, counts, 1 << bits).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def inverse_frequency(docs: DataFrame, text: str, config: DecontamConfig) -> np.ndarray:
    """The weight of each hashed word: log(1 + words / occurrences), which is above 0 even where one word is the whole table."""
    return _weights(document_rows(docs, text, config.bits), config)


def _weights(rows: DataFrame, config: DecontamConfig) -> np.ndarray:
    n = np.zeros(1 << config.bits)
    for row in word_counts(rows, config.bits).toLocalIterator():
        n[row.feature] = row.n
    total = max(1.0, n.sum())
    return np.log1p(total / np.maximum(n, 1)).astype(np.float32)


def _sparse_rows(column: pa.Array, idf: np.ndarray, config: DecontamConfig, block: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit-length TF-IDF rows (features, weights) of whole texts, or of each passage of 2 * block words."""
    held: dict[int, list[np.ndarray]] = {}
    for row, hashes in _hashed(column):
        for r in np.unique(row):
            held.setdefault(int(r), []).append((hashes[row == r] >> np.uint64(64 - config.bits)).astype(np.int64))
    for parts in held.values():
        own = np.concatenate(parts)
        step = len(own) if block is None else 2 * block
        for at in range(0, len(own), max(1, step)):
            f, n = np.unique(own[at : at + step], return_counts=True)
            w = n * idf[f]
            norm = float(np.sqrt((w * w).sum()))
            if norm:
                yield f[w > 0], (w[w > 0] / norm).astype(np.float32)


def _multiplied(rows: DataFrame, idf: np.ndarray, basis: tuple[np.ndarray, np.ndarray] | int, config: DecontamConfig) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of AᵀA·basis, where A has a TF-IDF row for each item and fitted passage; the products are added up in Spark.

    basis: features and their rows, or the width of a Gaussian matrix, of which every task draws the rows that it needs from seeds by feature.
    """
    size = 1 << config.bits
    shared = rows.sparkSession.sparkContext.broadcast((basis, idf))  # at most (hashed words) x (components)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, idf = shared.value
        sums: dict[int, np.ndarray] = {}
        slot = np.full(size, -1)
        if not isinstance(start, int):
            known, matrix = start
            slot[known] = np.arange(len(known))
        for batch in batches:
            for is_item in (True, False):
                chosen = batch.filter(batch.column("is_item") if is_item else pc.invert(batch.column("is_item")))
                scale = 1.0 if is_item else config.fit_weight**2
                for f, w in _sparse_rows(chosen.column("text"), idf, config, None if is_item else config.block):
                    if isinstance(start, int):
                        held = np.stack([np.random.default_rng((config.seed, one)).standard_normal(start, np.float32) for one in f.tolist()])
                        y = (w[:, None] * held).sum(0) * scale
                    else:
                        s = slot[f]
                        y = (w[s >= 0, None] * matrix[s[s >= 0]]).sum(0) * scale
                    for one, weight in zip(f.tolist(), w.tolist(), strict=True):
                        if one in sums:
                            sums[one] += np.float32(weight) * y
                        else:
                            sums[one] = np.float32(weight) * y
        own = np.array(sorted(sums), int)
        yield from _parts(own, np.array([sums[f] for f in own.tolist()], np.float32))

    out = _added(rows.mapInArrow(product, _PARTS))
    shared.unpersist()
    return out


#: Features as int32 and their rows as float32, in bytes, which Spark hands on as they are.
_PARTS = "part int, features binary, values binary"
#: Hashed words of a part of a product.
CHUNK = 2048


def _parts(features: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A product's rows by ranges of ascending features."""
    for part in np.unique(features // CHUNK).tolist():
        own = features // CHUNK == part
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "features": [features[own].astype(np.int32).tobytes()], "values": [values[own].astype(np.float32).tobytes()]}, pa.schema([("part", pa.int32()), ("features", pa.binary()), ("values", pa.binary())]))


def _added(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of the tasks' products, added up in Spark."""

    def added(table: pa.Table) -> pa.Table:
        sums, seen, first = None, np.zeros(CHUNK, bool), table.column("part")[0].as_py() * CHUNK
        for features, grid in _grids(table):
            sums = np.zeros((CHUNK, grid.shape[1]), np.float32) if sums is None else sums
            sums[features - first] += grid
            seen[features - first] = True
        return pa.table({"features": [(np.flatnonzero(seen) + first).astype(np.int32).tobytes()], "values": [sums[seen].tobytes()]}, pa.schema([("features", pa.binary()), ("values", pa.binary())]))

    found = list(_grids(parts.groupBy("part").applyInArrow(added, "features binary, values binary").toArrow()))
    if not found:
        return np.zeros(0, int), np.zeros((0, 1), np.float32)
    return np.concatenate([features for features, _ in found]).astype(int), np.concatenate([grid for _, grid in found])


def _grids(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for features, values in zip(table.column("features"), table.column("values"), strict=True):
        own = np.frombuffer(features.as_py(), np.int32)
        yield own, np.frombuffer(values.as_py(), np.float32).reshape(len(own), -1)


def _orthonormal(product: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, which are few; only what rounding makes goes, so that nearly equal items keep what tells them apart."""
    own, mixed = np.linalg.qr(product)
    turn, value, _ = np.linalg.svd(mixed)
    return own @ turn[:, : len(value)][:, value > 1e-5 * max(1e-30, float(value.max(initial=0)))]


def latent_basis(rows: DataFrame, n_items: int, idf: np.ndarray, config: DecontamConfig) -> tuple[np.ndarray, np.ndarray]:
    """Features and their rows in the leading right singular vectors of the TF-IDF matrix of `rows` (text, is_item)."""
    basis: tuple[np.ndarray, np.ndarray] | int = min(config.components, n_items + 32)
    for _ in range(config.power_steps + 1):
        features, product = _multiplied(rows, idf, basis, config)
        if not len(features):
            return features, product
        basis = features, _orthonormal(product)
    return basis


#: Documents whose rows are multiplied at once, so that a core's cache holds them.
ROWS = 32


def _document_product(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of AᵀA·basis, where A has a unit-length TF-IDF row for each document; the products are added up in Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((basis, idf))  # (hashed words) x (document components)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, idf = shared.value
        sums, seen, slot = np.zeros_like(matrix), np.zeros(len(matrix), bool), np.zeros(len(matrix), int)
        for batch in batches:
            for features, counts, ends in _told(batch, bits):
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                weight = counts * idf[features]
                weight /= np.sqrt(np.bincount(row, weight * weight)).astype(np.float32)[row]
                for lo in range(0, len(ends), ROWS):
                    own = slice(ends[lo - 1] if lo else 0, ends[min(lo + ROWS, len(ends)) - 1])
                    held = np.zeros(len(matrix), bool)
                    held[features[own]] = True
                    known = np.flatnonzero(held)
                    slot[known] = np.arange(len(known))
                    grid = np.zeros((min(ROWS, len(ends) - lo), len(known)), np.float32)
                    grid[row[own] - lo, slot[features[own]]] = weight[own]
                    sums[known] += grid.T @ (grid @ matrix[known])
                    seen |= held
        yield from _parts(np.flatnonzero(seen), sums[seen])

    # A product is as large whatever it adds up: a bounded number of tasks bounds what is sent and added.
    out = _added(rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(product, _PARTS))
    shared.unpersist()
    return out


def document_basis(rows: DataFrame, idf: np.ndarray, config: DecontamConfig) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix of all documents, a row for each hashed word. rows: see document_rows()."""
    size = 1 << config.bits
    basis = np.random.default_rng(config.seed).standard_normal((size, config.document_components), np.float32)
    for _ in range(config.power_steps + 1):
        features, product = _document_product(rows, idf, basis, config.bits)
        own = _orthonormal(product) if len(features) else product[:, :0]
        basis = np.zeros((size, own.shape[1]), np.float32)
        basis[features] = own
        if not own.shape[1]:
            break
    return basis


def joint_basis(features: np.ndarray, items: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Rows of the given features in an orthonormal basis of what the items' and the documents' bases span together. Other rows of the items' are zero."""
    both = items.T @ documents[features]
    value, vector = np.linalg.eigh(np.block([[np.eye(len(both)), both], [both.T, np.eye(both.shape[1])]]).astype(np.float64))
    kept = value > 1e-5  # directions that both have, but for rounding
    return np.hstack([items, documents[features]]) @ (vector[:, kept] / np.sqrt(value[kept])).astype(np.float32)


def _lcs(pattern: dict[int, int], words_: list[int], n: int) -> int:
    """Length of the longest common subsequence, by bits: pattern has the places of each of the item's n words."""
    full = (1 << n) - 1
    row = full
    for places in filter(None, map(pattern.get, words_)):  # other words change nothing
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return n - bin(row).count("1")


def _heaviest(item: list[int], weights: list[float], words_: list[int]) -> float:
    """Weight of the heaviest common subsequence."""
    found, best = np.array(words_, np.uint64), np.zeros(len(words_) + 1)
    for h, w in zip(item, weights, strict=True):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(found == np.uint64(h), best[:-1] + w, 0)))
    return float(best[-1])


def _places(hashes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, h in enumerate(hashes):
        out[h] = out.get(h, 0) | (1 << i)
    return out


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on, without the last n - 1 words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Runs:
    """The runs of n words of some items; a table of bits answers for most other words."""

    BITS = 22

    def __init__(self, n: int, items: list[tuple[int, np.ndarray]]) -> None:
        self.n = n
        keys = [np.unique(_runs(h, n)) for _, h in items]
        key, item = np.concatenate(keys), np.repeat([i for i, _ in items], [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.key >> np.uint64(64 - self.BITS)] = True

    def find(self, row: np.ndarray, hashes: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of the runs within rows. known: the words' runs by length, which blocks of items share."""
        if self.n not in known:
            known[self.n] = _runs(hashes, self.n)
        key = known[self.n]
        at = np.flatnonzero(self.seen[key >> np.uint64(64 - self.BITS)])
        at = at[row[at] == row[at + self.n - 1]]
        lo, hi = (np.searchsorted(self.key, key[at], side) for side in ("left", "right"))
        many = hi - lo
        where = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[where]


class _Block:
    """Items of a block: their vectors in the block's basis and what the check needs."""

    def __init__(self, ids: list, texts: list[str], features: np.ndarray, matrix: np.ndarray, idf: np.ndarray, config: DecontamConfig) -> None:
        self.config, self.idf, self.ids = config, idf, ids
        self.slot = np.full(1 << config.bits, -1, np.int32)
        self.slot[features] = np.arange(len(features))
        self.matrix = matrix
        self.weighted = matrix * idf[features, None]
        self.hashes: list[list[int]] = [[] for _ in texts]
        for row, h in _hashed(pa.array(texts, pa.string())):
            for r, x in zip(row.tolist(), h.tolist(), strict=True):
                self.hashes[r].append(x)
        self.places = [_places(h) for h in self.hashes]
        self.weights = [idf[(np.array(h, np.uint64) >> np.uint64(64 - config.bits)).astype(np.int64)].tolist() for h in self.hashes]
        self.tails = [h[-max(4, len(h) // 4) :] for h in self.hashes]
        self.tail_places = [_places(t) for t in self.tails]
        runs: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, h in enumerate(self.hashes):
            if h:
                runs.setdefault(min(len(h), config.run), []).append((i, np.array(h, np.uint64)))
        self.runs = [_Runs(n, own) for n, own in runs.items()]
        self.vectors = np.zeros((len(texts), matrix.shape[1]), np.float32)
        for i, h in enumerate(self.hashes):
            if h:
                f, n = np.unique((np.array(h, np.uint64) >> np.uint64(64 - config.bits)).astype(np.int64), return_counts=True)
                w = n * idf[f]
                norm = float(np.sqrt((w * w).sum()))
                s = self.slot[f]
                if norm:
                    self.vectors[i] = (w[s >= 0, None] * matrix[s[s >= 0]]).sum(0) / norm
        # Places of the words of items of at most 64 words, by hashed word; the last column is for words that no item holds.
        self.sizes = np.array([len(h) for h in self.hashes], int)
        self.bounded = (self.sizes > 0) & (self.sizes <= 64)
        self.cover = np.zeros((len(texts), len(features) + 1), np.uint64)
        for i in np.flatnonzero(self.bounded).tolist():
            s = self.slot[(np.array(self.hashes[i], np.uint64) >> np.uint64(64 - config.bits)).astype(np.int64)]
            self.bounded[i] = (s >= 0).all()
            np.bitwise_or.at(self.cover[i], s, np.uint64(1) << np.arange(len(s), dtype=np.uint64))
        # What an occurrence of a word can add to any item's projected product with a window, at most.
        self.most = np.zeros(1 << config.bits, np.float32)
        self.most[features] = idf[features] * (matrix @ self.vectors.T).max(1, initial=0.0)

    def candidates(self, row: np.ndarray, hashes: np.ndarray, known: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, item, cosine) of candidate windows; words are numbered in the given order, and rows are ascending."""
        c = self.config
        known = {} if known is None else known
        f = (hashes >> np.uint64(64 - c.bits)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        inside = (np.arange(len(row)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(row)]])))) // c.block
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
        block = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        w = self.idf[f]
        norm2 = np.bincount(block, w * w)
        owner = row[begin]
        joined = np.concatenate([owner[1:] == owner[:-1], [False]])
        norm2[:-1] += norm2[1:] * joined[:-1]
        end = np.concatenate([begin[1:], [len(row)]])
        stop = end.copy()
        stop[:-1] = np.where(joined[:-1], end[1:], end[:-1])
        norm = np.sqrt(norm2)
        # Windows whose words can't add up to the bound for any item aren't projected.
        reach = np.add.reduceat(self.most[f], begin)
        reach[:-1] += reach[1:] * joined[:-1]
        hopeful = reach >= c.cosine * norm * (1 - 1e-4)
        exact = [r.find(row, hashes, known) for r in self.runs]
        runs = np.unique(np.concatenate([np.zeros(0, np.int64), *(block[first] for first, _ in exact)]))
        hopeful[runs] = True
        wanted = hopeful.copy()
        wanted[1:] |= hopeful[:-1] & joined[:-1]
        use = np.flatnonzero(wanted[block] & (self.slot[f] >= 0))
        latent = np.zeros((len(begin), self.matrix.shape[1]), np.float32)
        if len(use):
            own = block[use]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            slot = self.slot[f[use]]
            many = np.diff(at, append=len(use))
            for lo in range(0, len(at), 128):  # what a core's cache holds
                # The passages' first words, then their second ones, and so on; passages with more words come first.
                order = lo + np.argsort(-many[lo : lo + 128], kind="stable")
                rows = self.weighted[slot[at[order]]]
                for k in range(1, many[order[0]]):
                    left = np.count_nonzero(many[order] > k)
                    rows[:left] += self.weighted[slot[at[order[:left]] + k]]
                latent[own[at[order]]] = rows
        latent[:-1] += latent[1:] * joined[:-1, None]
        # No cosine can reach the bound if the projection is shorter.
        live = np.flatnonzero(hopeful & (norm > 0))
        live = live[(latent[live] ** 2).sum(1) >= (c.cosine * norm[live]) ** 2]
        score = latent[live] @ self.vectors.T / norm[live, None]
        at, item = np.nonzero(score >= c.cosine)
        width = len(self.ids)
        pair = live[at] * width + item
        if any(len(first) for first, _ in exact):
            pair = np.unique(np.concatenate([pair, *(block[first] * width + i for first, i in exact)]))
        at, item = pair // width, pair % width
        cosine = np.empty(len(pair))
        for lo in range(0, len(pair), 2048):
            own = slice(lo, lo + 2048)
            cosine[own] = (latent[at[own]] * self.vectors[item[own]]).sum(1) / norm[at[own]]
        return begin[at], stop[at], item, cosine

    def bounds(self, f: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """At least the subsequence length of each item and the words from lo to hi, whose hashes f has: hashed words are equal where words are."""
        out, width = self.sizes[item], hi - lo
        some = np.flatnonzero(self.bounded[item] & (width <= 512))  # Longer stretches are few.
        some = some[np.argsort(width[some], kind="stable")]
        slot = np.append(self.slot[f], -1)
        for at in range(0, len(some), 256):
            own = some[at : at + 256]
            place = lo[own] + np.arange(width[own[-1]])[:, None]
            row = np.full(len(own), ~np.uint64(0))
            for places in self.cover[item[own], slot[np.where(place < hi[own], place, len(f))]]:
                hit = row & places
                row = (row + hit) | (row - hit)
            out[own] = np.bitwise_count(~row)
        return out

    def check(self, words_: list[int], item: int) -> tuple[int, float, bool]:
        """Subsequence length, its share of the item's words, and whether the item is contained."""
        c, n = self.config, len(self.hashes[item])
        length = _lcs(self.places[item], words_, n)
        share = length / n
        if share >= c.copied:
            return length, share, True
        tail = len(self.tails[item])
        if share < c.paraphrased or length < c.fewest or _lcs(self.tail_places[item], words_, tail) < c.answer * tail:
            return length, share, False
        return length, share, _heaviest(self.hashes[item], self.weights[item], words_) >= c.paraphrased * sum(self.weights[item])


_FOUND = "item long, first_word long, end_word long, cosine double, lcs long, coverage double"


def _hits(batch: pa.RecordBatch, blocks: list[_Block]) -> Iterator[tuple[int, object, int, int, float, int, float]]:
    """(row, item id, first word, end word, cosine, lcs, coverage) of the items that rows contain, the best place of each."""
    best: dict[tuple[int, object], tuple] = {}
    before: dict[int, int] = {}
    # A long row comes in parts; each begins with the words before it in which an item may begin.
    most = 2 * max((len(h) for b in blocks for h in b.hashes), default=0) + 4 * blocks[0].config.block
    tail_row, tail = -1, np.zeros(0, np.uint64)
    for row, hashes in _hashed(batch.column("_text")):
        if not len(row):
            continue
        if row[0] == tail_row:
            before[tail_row] = before.get(tail_row, 0) - len(tail)
            row, hashes = np.concatenate([np.full(len(tail), tail_row), row]), np.concatenate([tail, hashes])
        known: dict[int, np.ndarray] = {}
        for block in blocks:
            first, end, item, cosine = block.candidates(row, hashes, known)
            order = np.lexsort((first, item, row[first]))
            owner = row[first[order]]
            left, right = (np.searchsorted(row, owner, side) for side in ("left", "right"))
            first, end, item, cosine, owner, left, right = (x.tolist() for x in (first[order], end[order], item[order], cosine[order], owner, left, right))
            spots, at = [], 0
            while at < len(owner):
                r, i, lo, hi, top, begin, stop = owner[at], item[at], first[at], end[at], cosine[at], left[at], right[at]
                n = len(block.hashes[i])
                at += 1
                while at < len(owner) and item[at] == i and owner[at] == r and first[at] <= hi + n:
                    hi, top = max(hi, end[at]), max(top, cosine[at])
                    at += 1
                spots.append((i, max(lo - n, begin), min(hi + n, stop), r, top, begin))
            if not spots:
                continue
            where = np.array([spot[:3] for spot in spots], int).T
            likely = block.bounds((hashes >> np.uint64(64 - block.config.bits)).astype(np.int64), *where) / block.sizes[where[0]] >= min(block.config.copied, block.config.paraphrased)
            for k in np.flatnonzero(likely).tolist():
                i, lo, hi, r, top, begin = spots[k]
                length, share, contained = block.check(hashes[lo:hi].tolist(), i)
                if contained:
                    start = lo - begin + before.get(r, 0)
                    own = (r, block.ids[i])
                    if own not in best or best[own][4] < length:
                        best[own] = (start, start + hi - lo, min(1.0, top), 0, length, share)
        last = int(row[-1])
        words_of_last = int((row == last).sum())
        before[last] = before.get(last, 0) + words_of_last
        tail_row, tail = last, hashes[len(hashes) - min(most, words_of_last) :]
    for (r, i), (start, end, cosine, _, length, share) in best.items():
        yield r, i, start, end, cosine, length, share


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, words and figures of the place."""
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    told = written(document_rows(source, "_text", config.bits))
    idf = _weights(told, config)
    n_items = items.count()
    documents = document_basis(told, idf, config) if n_items else None
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    item_kind = benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("item_id", item_kind), *T._parse_datatype_string(_FOUND).fields[1:]])
    rounds = max(1, -(-n_items // config.items_at_once))
    out = spark.createDataFrame([], schema)
    for number in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == number)
        known = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[1], str(x[0])))
        blocks = []
        for at in range(0, len(known), config.components):
            own = known[at : at + config.components]
            rows = spark.createDataFrame([(t, True) for _, t in own], "text string, is_item boolean").repartition(spark.sparkContext.defaultParallelism)
            features, matrix = latent_basis(rows, len(own), idf, config)
            if len(features):
                matrix = joint_basis(features, matrix, documents)
                # The documents' words that no item holds aren't projected, so that their rows aren't sent.
                held = np.zeros(1 << config.bits, bool)
                for _, h in _hashed(pa.array([t for _, t in own], pa.string())):
                    held[(h >> np.uint64(64 - config.bits)).astype(np.int64)] = True
                blocks.append(([i for i, _ in own], [t for _, t in own], features[held[features]], matrix[held[features]]))
        if not blocks:
            continue
        shared = spark.sparkContext.broadcast((blocks, idf))  # at most items_at_once items and their bases

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, weights = shared.value
            ready = [_Block(*b, weights, config) for b in own]
            arrow = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            for batch in batches:
                found = list(_hits(batch, ready))
                columns = list(zip(*found, strict=True)) if found else [[]] * 7
                values = {doc_id: batch.column("_id").take(pa.array(columns[0], pa.int64())), "item_id": pa.array(columns[1], from_type)}
                values |= {n: pa.array(v, t) for n, v, t in zip(schema.names[2:], columns[2:], arrow, strict=True)}
                yield pa.RecordBatch.from_pydict(values)

        from pyspark.sql.pandas.types import to_arrow_type

        from_type = to_arrow_type(item_kind)
        out = out.unionByName(source.mapInArrow(run, schema))
    return out
