"""Periodic runs: stretches of consecutive words that repeat with a period, found by tiles whose size follows the period.

Words are what lies between bytes 0x20 and 0x09 to 0x0D. A run is a stretch with smallest period q (words q apart are identical) of at least
max(`LEAST`, 2 * q) words that no neighbouring word extends keeping period q. Collapsing a text drops of each run what follows its first q
words.

Periods are dealt by octaves [P, 2 * P). A document is exploded into tiles that overlap by 4 * P words, so that any two periods in a row lie
within a tile: all octaves up to `LOW` share tiles of `TILE` words, each further octave has tiles of its own of 8 * P words; a document of up
to `TILE` words is one tile for all octaves. A tile is solved by itself. A run of period p in [P, 2 * P) covers some multiple b of P and b + p.
The forward and backward Z-functions of the boundary b at p, how far the words from b and from b + p on agree, and those before them, give its
extent. They are taken only at those p where the half period behind or before b agrees, which a Z-value of p / 2 on either side asks, by binary
lifting over prefix hashes, for all boundaries of many documents at once. Extents are then compared word by word; if any is wrong, the tile is
solved again with another hash. Periods that aren't the smallest are dropped: by Fine and Wilf's theorem a smaller one divides p.

Fragments, the runs of tiles, are shuffled by document and period, and stitched: those of one run overlap by at least p words, those of
different runs of a period don't. Rows are dealt by document and period, so a document's fragments spread as far as its periods do.

Defined results: null, empty and blank texts have no words and no runs, and collapse to the empty text; a document's key is its id with its text,
so equal rows get equal results, and null ids are as good as others; texts of any length are whole; of runs that tie in length the one that
starts first is the longest, then the one with the smaller period; overlapping runs each drop their own words. Further columns of the input
don't reach the result of `runs`; `collapsed` passes them on, and a clash with a new column's name raises. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written

#: The fewest words of a run; words of a common tile and the longest octave solved in it; words that a task solves at a time.
LEAST, TILE, LOW, BATCH_WORDS = 12, 1 << 16, 1 << 12, 1 << 18
NEW = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")
SEPARATORS = "[\\x20\\x09-\\x0D]+"

_MODULI = (2147483647, 2147483629)
_FRAGMENT = "key binary, start long, stop long, period long"
_PARTS = _FRAGMENT + ", low int, high int, words binary"


# --- Inside a tile


@lru_cache(maxsize=8)
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** i modulo the modulus, for i up to n."""
    out = np.ones(1, np.int64)
    step = base % modulus
    while len(out) <= n:
        out = np.concatenate([out, out * step % modulus])
        step = step * step % modulus
    return out[: n + 1]


@lru_cache(maxsize=2)
def _least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to n."""
    out = np.arange(n + 1)
    for r in range(2, int(n**0.5) + 1):
        if out[r] == r:
            own = out[r * r :: r]
            own[own == np.arange(r * r, n + 1, r)] = r
    return out


class _Hashes:
    """Prefix hashes of words modulo two primes; says whether stretches p apart are equal."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rnd = np.random.default_rng(seed)
        self.n, self.sums, self.powers = len(words), [], []
        size = 1 << max(12, int(self.n).bit_length())
        for modulus in _MODULI:
            powers = _powers(int(rnd.integers(1 << 20, modulus)), modulus, size)
            mixed = (words.astype(np.uint64) + np.uint64(rnd.integers(1, 1 << 62))) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            values = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % modulus
            self.sums.append(np.concatenate([[0], np.cumsum(values * powers[: self.n] % modulus)]) % modulus)
            self.powers.append(powers)

    def equal(self, at: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from `at` on are those from `at` + `apart` on; both must lie inside."""
        out = np.ones(len(at), bool)
        for sums, powers, modulus in zip(self.sums, self.powers, _MODULI, strict=True):
            own = (sums[at + size] - sums[at]) % modulus * powers[apart] % modulus
            out &= own == (sums[at + apart + size] - sums[at + apart]) % modulus
        return out

    def windows(self, n: int, size: int) -> np.ndarray:
        """A number for each stretch of `size` words of the first n, the same for equal stretches."""
        sums, powers, modulus = self.sums[0], self.powers[0], _MODULI[0]
        return (sums[size : n + 1] - sums[: n + 1 - size]) % modulus * powers[n - size :: -1][: n + 1 - size] % modulus


def _grown(equal, room: np.ndarray) -> np.ndarray:
    """The greatest size up to `room` for which equal(rows, size so far, step) holds all along, by binary lifting."""
    size = np.zeros(len(room), np.int64)
    step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
    while step:
        rows = np.flatnonzero(size + step <= room)
        if len(rows):
            size[rows[equal(rows, size[rows], step)]] += step
        step //= 2
    return size


def _octave(hashes: _Hashes, n: int, low: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of the longest stretches of at least two periods with smallest period in [low, 2 * low), among the first n words.
    room: no stretch is longer."""
    half = max(1, low // 2)
    known = hashes.windows(n, half)
    rows = -(-(n + 1) // low) + 1
    ahead = np.full(rows * low, -1, np.int64)
    ahead[: len(known)] = known
    behind = np.full(rows * low, -2, np.int64)
    behind[half : half + len(known)] = known
    ahead, behind = ahead.reshape(rows, low), behind.reshape(rows, low)
    found = (ahead[1:] == ahead[:-1, :1]) & (ahead[1:] >= 0) | (behind[1:] == behind[:-1, :1]) & (behind[1:] >= 0)
    k, j = np.nonzero(found)
    b, p = k * low, low + j
    fits = b + p <= n
    b, p = b[fits], p[fits]
    forward = _grown(lambda r, f, s: hashes.equal(b[r] + f, p[r], np.full(len(r), s)), np.minimum(n - b - p, room))
    backward = _grown(lambda r, g, s: hashes.equal(b[r] - g - s, p[r], np.full(len(r), s)), np.minimum(b, room))
    long = forward + backward >= p
    start, stop, p = (b - backward)[long], (b + p + forward)[long], p[long]
    _, first = np.unique(p * (n + 1) + start, return_index=True)
    start, stop, p = start[first], stop[first], p[first]
    smallest = np.ones(len(p), bool)
    factors, rest = _least_factors(1 << max(10, int(2 * low).bit_length())), p.copy()
    while (rest > 1).any():
        rows = np.flatnonzero((rest > 1) & smallest)
        shorter = p[rows] // factors[rest[rows]]
        smallest[rows[hashes.equal(start[rows], shorter, 2 * p[rows] - shorter)]] = False
        rest = np.where(rest > 1, rest // factors[rest], 1)
    return start[smallest], stop[smallest], p[smallest]


def _sound(words: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> bool:
    """Whether the stretches have their periods and end where they must, word by word."""
    for s, e, p in zip(start.tolist(), stop.tolist(), period.tolist(), strict=True):
        if not np.array_equal(words[s : e - p], words[s + p : e]) or (s and words[s - 1] == words[s - 1 + p]) or (e < len(words) and words[e] == words[e - p]):
            return False
    return True


def stretches(texts: list[np.ndarray], low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, period) of every longest stretch of at least two periods in the texts, arrays of word numbers below 2 ** 40.

    low, high: the first and last octave, powers of two; up to half of each text by default.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(size + 1)  # each text is followed by a word of its own, so that no stretch goes over
    gaps = (1 << 40) + np.arange(len(order))
    words = np.concatenate([np.zeros(0, np.int64), *[x for i, g in zip(order, gaps, strict=True) for x in (texts[i], [g])]]).astype(np.int64)
    for seed in count(1):
        hashes, found, p = _Hashes(words, seed), [], low
        while len(size) and 2 * p <= size[0] and (high is None or p <= high):
            n = int(ends[np.searchsorted(-size, -2 * p, "right") - 1])
            found.append(_octave(hashes, n, p, int(size[0])))
            p *= 2
        start, stop, period = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(3))
        if _sound(words, start, stop, period):
            break
    at = np.searchsorted(ends, start, "right")
    begin = ends[at] - size[at] - 1 if len(at) else at
    return np.array(order, np.int64)[at], start - begin, stop - begin, period


# --- Over documents


def tiles(n: int) -> list[tuple[int, int, int, int | None]]:
    """(from, to, first octave, last octave) of the tiles of a document of n words."""
    if n <= TILE:
        return [(0, n, 1, None)]
    out, low, high, size = [], 1, LOW, TILE
    while 2 * low <= n:
        if size >= n:
            out.append((0, n, low, None))
            break
        step = size - 4 * high
        out += [(at, min(n, at + size), low, high) for at in range(0, max(1, n - 4 * high), step)]
        low = high = 2 * high
        size = max(TILE, 8 * high)
    return out


def _fragments(keys: list[bytes], offsets: list[int], row: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> dict[str, pa.Array]:
    moved = np.array(offsets, np.int64)[row] if len(row) else np.zeros(0, np.int64)
    return {"key": pa.array([keys[i] for i in row.tolist()], pa.binary()), "start": pa.array(start + moved), "stop": pa.array(stop + moved), "period": pa.array(period)}


def _parts(known: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([known.get(f, pa.nulls(n, kinds[t])) for f, t in fields], [f for f, _ in fields])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the documents that are one tile, and the tiles of the others."""
    keys: list[bytes] = []
    texts: list[np.ndarray] = []
    held = 0

    def solved() -> pa.RecordBatch:
        row, start, stop, period = stretches(texts)
        long = stop - start >= np.maximum(LEAST, 2 * period)
        return _parts(_fragments(keys, [0] * len(keys), row[long], start[long], stop[long], period[long]), int(long.sum()))

    for batch in batches:
        numbers = defaultdict(count().__next__)
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            words = (text.as_py() or "").encode().split()  # bytes are split at the six separators exactly
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            if len(ids) > TILE:
                for at, end, low, high in tiles(len(ids)):
                    part = {"low": [low], "high": [high or 0], "start": [at], "stop": [end], "period": [len(ids)]}
                    known = {k: pa.array(v, pa.int32() if k in ("low", "high") else pa.int64()) for k, v in part.items()}
                    yield _parts(known | {"key": pa.array([key.as_py()], pa.binary()), "words": pa.array([ids[at:end].astype(np.int32).tobytes()], pa.binary())}, 1)
            elif len(ids) >= LEAST:
                keys.append(key.as_py())
                texts.append(ids)
                held += len(ids)
                if held > BATCH_WORDS:
                    yield solved()
                    keys, texts, held = [], [], 0
    yield solved()


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments of tiles. At a tile's own ends, short ones may be parts of longer ones; elsewhere they go."""
    for batch in batches:
        for tile in batch.to_pylist():
            n = tile["stop"] - tile["start"]
            row, start, stop, period = stretches([np.frombuffer(tile["words"], np.int32)], tile["low"], tile["high"] or None)
            cut = (start == 0) & (tile["start"] > 0) | (stop == n) & (tile["stop"] < tile["period"])
            kept = cut | (stop - start >= LEAST)
            found = _fragments([tile["key"]], [tile["start"]], row[kept], start[kept], stop[kept], period[kept])
            yield pa.RecordBatch.from_pydict(found)


def _key(doc_id: str, text: str) -> Column:
    own = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(own, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))).alias("key")


def _stitched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, start, stop, period) of every run."""
    cut = written(docs.select(_key(doc_id, text), F.col(text).alias("text")).mapInArrow(_cut_batches, _PARTS))
    own = cut.where("words is null").select("key", "start", "stop", "period")
    dealt = cut.where("words is not null").repartition("key", "start", "low").mapInArrow(_solve_batches, _FRAGMENT)
    found = own.unionByName(dealt).groupBy("key", "period", "start").agg(F.max("stop").alias("stop"))
    order = W.partitionBy("key", "period").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.select("*", F.coalesce(F.col("start") + F.col("period") > before, F.lit(True)).cast("int").alias("_new"))
    numbered = marked.select("*", F.sum("_new").over(order).alias("_run"))
    merged = numbered.groupBy("key", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(LEAST), 2 * F.col("period"))).drop("_run")


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_runs, best, runs, dropped) of every document with runs: best (length, start, period), runs by start and period, and the
    stretches (from, to) of dropped words, apart and in order."""
    found = _stitched(docs, doc_id, text).withColumn("from", F.col("start") + F.col("period"))
    before = F.coalesce(F.max("stop").over(W.partitionBy("key").orderBy("from", "stop", "period").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = F.when(F.col("stop") > before, F.struct(F.greatest("from", before).alias("from"), F.col("stop").alias("to")))
    length = F.col("stop") - F.col("start")
    best = F.max(F.struct(length.alias("length"), (-F.col("start")).alias("before"), (-F.col("period")).alias("short")))
    made = found.select("*", more.alias("more")).groupBy("key").agg(
        F.count("*").alias("n_runs"),
        best.alias("_best"),
        F.sort_array(F.collect_list(F.struct("start", "period", length.alias("length")))).alias("runs"),
        F.sort_array(F.collect_list("more")).alias("dropped"),
    )
    return made.select(
        "key", "n_runs", F.struct(F.col("_best.length").alias("length"), (-F.col("_best.before")).alias("start"), (-F.col("_best.short")).alias("period")).alias("best"), "runs", "dropped"
    )


def words_of(text: Column) -> Column:
    """The words of a text, none of a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), lambda w: w != "")


def collapsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns with n_runs, the longest run's start, length, period and exponent_milli (null without runs), runs (start, period,
    length), and collapsed, the words that no run drops, joined by spaces."""
    if clash := set(NEW) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    found = runs(docs, doc_id, text).withColumnRenamed("key", "_key").withColumnRenamed("runs", "_runs")
    rows = docs.select(F.struct("*").alias("_row"), _key(doc_id, text))
    joined = rows.join(found, F.col("key") == F.col("_key"), "left").select("*", words_of(F.col("_row").getField(text)).alias("_words"))
    gaps = F.size("dropped")

    def kept(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("dropped", k - 1)["to"]).cast("int")
        end = F.when(k == gaps, F.size("_words")).otherwise(F.get("dropped", k)["from"]).cast("int")
        return F.slice("_words", start + 1, end - start)

    rest = F.when(F.col("dropped").isNull(), F.col("_words")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), gaps), kept)))
    best = lambda c: F.col("best").getField(c)
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"),
        *[best(c).alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best("length") / best("period")).alias("exponent_milli"),
        F.coalesce("_runs", F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")).alias("runs"),
        F.array_join(rest, " ").alias("collapsed"),
    )


# --- What the query works on


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, a tenth of them (by the crc32 of the id) with their words from some place on replaced by repetitions of the first of these."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    known = docs.select(F.struct("*").alias("_row"), h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, words_of(F.col(text))).alias("_words"))
    n = F.nullif(F.array_size("_words"), F.lit(0))
    at = known.select("*", (F.col("_g") % n).cast("int").alias("_a")).select("*", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int").alias("_p"))
    again = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    own = F.col("_row").getField(text)
    changed = F.when(F.col("_p").isNotNull(), F.array_join(again, " ")).otherwise(own)
    return at.select(*[changed.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """collapsed() with its runs and text as SHA-256 digests."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        doc_id, "n_runs", "start", "length", "period", "exponent_milli", F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
