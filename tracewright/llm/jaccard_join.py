"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct shingles (word n-grams) of its text. Two documents link if their sets' Jaccard similarity reaches the
threshold. The join rests on prefixes of a global order of the shingles. If sets x and y link, they share at least o(x) = ceil(t * |x|) and
o(y) shingles, so for every l their prefixes of |x| - o(x) + l and |y| - o(y) + l shingles share at least l. Every document picks the l of
its own prefix by the estimated cost of its candidates: a longer prefix reads more of the frequent shingles' lists, but asks candidates to
share more. A pair must share the smaller l of the two.

1. Counts: how often shingles occur in all documents, in slots of a hash; the most frequent ones, a bounded list, come last in the order,
   by frequency; the others come first, by hash.
2. Sets: each text's size, prefix, last place in the order, and a fingerprint of its set. Equal sets are one class and are joined as one.
3. Lists: the classes that share a prefix shingle. A list's centre is the class with the smallest share of rare shingles, which in a group
   of near copies lies nearest to the original. First only centres are compared with their lists, and links make components.
4. Then the remaining pairs, those of different components, are counted in all lists. A pair stays if it shares enough shingles and could,
   with all that lies beyond the prefix, still reach the threshold. No pair of different components is left out, so the components are
   exact, although a large group of near copies is never expanded into its pairs. Only lists with several components take part; their
   entries meet by list and range of sizes, and a long list's are dealt over as many tasks as its length asks for.
5. Verification compares the whole sets of a pair.

What a frequent shingle's list needs to know of itself, its centre and its main component, is broadcast, as frequent shingles are a bounded
list. Of equal texts, one row's is shuffled to where it is verified.

Defined results: null texts, and texts without words, have an empty set and link with nothing; with fewer words than a shingle has, the
whole sequence is one shingle; null ids take part, but a component's id is its smallest id that isn't null; equal rows are one class;
further columns are ignored, whatever their names; empty tables give no rows; very long texts are read whole, in parts. Hashes of 64 bits
stand for words, shingles, rows and classes: among n of them the odds that two different ones count as one are below n * n / 2**65. Frequent
shingles are named by the slots in which they are counted; those of one set that share a slot are numbered, so that none is counted once less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators.graph import components
from .arrowtext import BLOCK_BYTES, long_word_hash, lower_ascii, mix, pieces, shingle_hashes, spans, utf8, word_hashes, words

#: Slots of a bucket of counts (as bits), occurrences that make a shingle frequent at least, and the bound of the list of frequent ones.
SLOT_BITS, FREQUENT, MOST_FREQUENT = 22, 32, 200_000
#: Shingles that a task counts at a time, those of a bucket about, how often it tells of one, and a bucket's entries of lists about.
FLUSH, BUCKET, TOLD, ENTRIES = 1 << 20, 1 << 19, 64, 1 << 17
ESCAPE = 32767
#: Bits that number the shingles of a set in one slot, classes that a task remembers, entries of a list that a
#: task pairs with all of it, and pairs of a centre that are verified together.
SAME_BITS, SEEN, DEALT, PAIRS = 11, 1 << 20, 4096, 128


@dataclass(frozen=True)
class JoinConfig:
    """Link if 100 * intersection >= percent * union; verify_cost: a verification in terms of reading a list's entry."""

    width: int = 4
    percent: int = 85
    lengths: tuple[int, ...] = (1, 2, 4, 8, 16)
    verify_cost: float = 16.0


def word_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    data, offsets = utf8(column)
    for a, b in spans(offsets):
        lo = offsets[a]
        held, owner = [], []
        for rows, raw, ends in pieces(data[lo : offsets[b]], offsets[a : b + 1] - lo, whole=True):
            raw = lower_ascii(raw)
            if len(rows) == 1 and len(raw) > BLOCK_BYTES:  # a word
                held.append(long_word_hash(raw))
                owner.append(rows)
                continue
            start, end, row = words(raw, ends)
            held.append(word_hashes(raw, start, end))
            owner.append(rows[row])
        hashes, row = np.concatenate(held), np.concatenate(owner)
        shingles = shingle_hashes(hashes, width)
        first = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            s, e = int(first[i]), int(first[i + 1])
            if e - s < width:
                yield a + i, shingle_hashes(hashes[s:e], width)
            else:
                yield a + i, np.unique(shingles[s : e - width + 1])


def _buckets(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted keys by bucket: steps from one slot to the next, of 16 bits, with ESCAPE for as many slots without a key."""
    bucket = keys >> SLOT_BITS
    slot = keys & ((1 << SLOT_BITS) - 1)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for own, s in zip(bucket[np.concatenate([[0], cut])].tolist(), np.split(slot, cut), strict=True):
        step = np.diff(s, prepend=0)
        skips = step // ESCAPE
        out = np.full(len(s) + int(skips.sum()), ESCAPE, np.int16)
        out[np.cumsum(skips + 1) - 1] = step - skips * ESCAPE
        yield own, out


def frequent_shingles(docs: DataFrame, text: str, config: JoinConfig) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the most frequent shingles in ascending order, their ranks by frequency, and the keys' bits.

    At most MOST_FREQUENT; a key is the slot in which a shingle is counted, so that rare shingles may count as frequent, which costs time only.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 5 / BUCKET)))))
    shift = np.uint64(64 - bits - SLOT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> shift).astype(np.int64)
            # A key is told of TOLD times at most, which is enough to be frequent.
            if len(keys) > TOLD:
                keys = keys[np.concatenate([np.ones(TOLD, bool), keys[TOLD:] != keys[:-TOLD]])]
            rows = list(_buckets(keys))
            ends = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int64()), "steps": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s for _, s in rows])))})

        for batch in batches:
            for _, own in word_sets(batch.column(0), config.width):
                if len(own):
                    held.append(own)
                    total += len(own)
                if total >= FLUSH:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sums = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in table.to_batches():
            lists = batch.column("steps")
            steps, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())
            at = np.cumsum(steps)
            before = np.concatenate([[0], at])[np.concatenate([[0], ends[:-1]])]
            at -= np.repeat(before, np.diff(ends, prepend=0))
            sums += np.bincount(at[steps != ESCAPE], minlength=1 << SLOT_BITS).astype(np.int32)
        seen = np.flatnonzero(sums >= FREQUENT)
        return pa.table({"key": pa.array((bucket << SLOT_BITS) + seen, pa.int64()), "n": pa.array(sums[seen], pa.int64())})

    found = written(docs.select(text).mapInArrow(count, "bucket long, steps array<short>").groupBy("bucket").applyInArrow(add, "key long, n long"))
    bounds = [FREQUENT << k for k in range(32)]
    counts = found.agg(*[F.count_if(F.col("n") >= b) for b in bounds]).first()
    bound = next((b for b, c in zip(bounds, counts, strict=True) if c <= MOST_FREQUENT), bounds[-1])
    kept = found.where(F.col("n") >= bound).toPandas().sort_values("key")
    keys, n = kept.key.to_numpy(np.int64), kept.n.to_numpy(np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys, rank, bits + SLOT_BITS


def prefix_length(n: int, frequency: np.ndarray, rare: int, config: JoinConfig) -> tuple[int, int]:
    """(l, prefix length) of a set of n shingles, of which `rare` come first and then frequent ones with these costs of reading a list."""
    need = -(-config.percent * n // 100)
    if n - need + 1 <= rare or not len(frequency):
        return 1, n - need + 1
    reads = np.concatenate([[0.0], np.cumsum(frequency)])
    best = None
    for least in config.lengths:
        if least > need:
            break
        length = n - need + least
        cost = rare + reads[max(0, length - rare)]
        estimate = cost + config.verify_cost * cost / least
        if best is None or estimate < best[0]:
            best = (estimate, least, length)
    return best[1], best[2]


_SET_FIELDS = "doc_id long, th long, class long, n int, length int, rare int, least int, last long, light array<long>, heavy array<int>"


def sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int], config: JoinConfig) -> DataFrame:
    """Each document's class, set size and prefix; of documents of one class in a task, only the first has a prefix. docs: doc_id, th, text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bits = shared.value
        shift, known = np.uint64(64 - bits), np.zeros(1 << 24, bool)
        known[keys & 0xFFFFFF] = True
        seen: set[int] = set()
        for batch in batches:
            n_rows = batch.num_rows
            out = {k: np.zeros(n_rows, t) for k, t in (("class", np.int64), ("n", np.int32), ("length", np.int32), ("rare", np.int32), ("least", np.int32), ("last", np.int64))}
            light, heavy = [None] * n_rows, [None] * n_rows
            for i, own in word_sets(batch.column("text"), config.width):
                n = len(own)
                if not n:
                    continue
                name = int(mix(own).sum(dtype=np.uint64).astype(np.int64))  # a sum, so that the order doesn't matter; it wraps around
                out["class"][i], out["n"][i] = name, n
                if name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                key = (own >> shift).astype(np.int64)
                maybe = np.flatnonzero(known[key & 0xFFFFFF])
                at = np.minimum(np.searchsorted(keys, key[maybe]), max(0, len(keys) - 1))
                hit = keys[at] == key[maybe] if len(keys) else np.zeros(0, bool)
                rank = np.sort(ranks[at[hit]]) if len(keys) else np.zeros(0, np.int64)
                same = np.arange(len(rank)) - np.searchsorted(rank, rank)
                place = rank << SAME_BITS | np.minimum(same, (1 << SAME_BITS) - 1)
                rare = n - len(place)
                least, length = prefix_length(n, rank + 1.0, rare, config)
                first = own if rare == n else np.delete(own, maybe[hit])
                light[i] = first[: min(length, rare)].view(np.int64)
                heavy[i] = place[: max(0, length - rare)].astype(np.int32)
                out["length"][i], out["rare"][i], out["least"][i] = length, rare, least
                out["last"][i] = int(first[length - 1] >> np.uint64(2)) if length <= rare else (1 << 62) | int(place[length - rare - 1])
            columns = {"doc_id": batch.column("doc_id"), "th": batch.column("th")} | {k: pa.array(v) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns | {"light": pa.array(light, pa.list_(pa.int64())), "heavy": pa.array(heavy, pa.list_(pa.int32()))})

    return docs.mapInArrow(run, _SET_FIELDS)


def light_lists(found: DataFrame) -> DataFrame:
    """(classes, sizes) of the classes that share a rare prefix shingle, in order of their shares of rare shingles. found: sets()."""
    total = found.agg(F.sum(F.size("light"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / ENTRIES)))))
    mask = np.uint64((1 << bits) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("light")).to_numpy(zero_copy_only=False)
            token = batch.column("light").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(token):
                continue
            bucket = (token & mask).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]).astype(np.int32)
            lists = {"tokens": token[order].view(np.int64)} | {k: np.repeat(batch.column(k).to_numpy(), size)[order] for k in ("class", "n", "rare")}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[order][cut[:-1]])} | {k: pa.ListArray.from_arrays(cut, pa.array(v)) for k, v in lists.items()})

    def lists(table: pa.Table) -> pa.Table:
        token, name, n, rare = (table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in ("tokens", "class", "n", "rare"))
        order = np.lexsort((name, rare / n, token))
        token, name, n = token[order], name[order], n[order]
        # The same class may come from several tasks.
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (name[1:] == name[:-1])])
        token, name, n = token[~same], name[~same], n[~same]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([start, [len(token)]]))
        several = np.repeat(size >= 2, size)
        ends = np.concatenate([[0], np.cumsum(size[size >= 2])]).astype(np.int32)
        return pa.table({"classes": pa.ListArray.from_arrays(ends, pa.array(name[several])), "sizes": pa.ListArray.from_arrays(ends, pa.array(n[several]))})

    dealt = found.where("size(light) > 0").select("class", "n", "rare", "light").mapInArrow(deal, "bucket long, tokens array<long>, class array<long>, n array<int>, rare array<int>")
    return dealt.groupBy("bucket").applyInArrow(lists, "classes array<long>, sizes array<int>")


def _near_sizes(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _possible(pairs: DataFrame, facts: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs (a, b, shared) that may still link: shared counts prefix shingles, of which frequent ones may come on top (see `extra`)."""
    side = lambda k: facts.select(F.col("class").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "length", "least", "last", "deep")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.col("shared") + F.col("extra") * F.least("deep_a", "deep_b")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(config.percent) / F.lit(100 + config.percent) - F.lit(1e-9))
    # Beyond the prefix that ends first, no more can be shared than that set still holds.
    beyond = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("length_a")).otherwise(F.col("n_b") - F.col("length_b"))
    return both.where((shared >= F.least("least_a", "least_b")) & (shared + beyond >= need) & _near_sizes(F.col("n_a"), F.col("n_b"), config.percent)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs (a, b) whose whole sets link. texts: (class, text). Each a is sent to as many groups as its pairs need, each b to its a's."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_groups")).cast("int").alias("part"))
    centres = groups.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("part"))
    sent = dealt.unionByName(centres).join(texts.withColumnRenamed("class", "b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in ("a", "b"))
            keep = []
            for i, s in word_sets(batch.column("text"), config.width):
                if a[i] == b[i]:
                    centre, own = a[i], s
                elif centre != a[i]:
                    raise ValueError("a centre's text is missing")
                else:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= config.percent * (len(own) + len(s) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    placed = sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    return placed.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _texts(source: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text) of classes (class, th)."""
    return source.select("th", "text").join(classes, "th").dropDuplicates(["class"]).select("class", "text")


def linked(docs: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    # `th` names a row, so that equal texts of different rows aren't sent to one task.
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("th"), F.col(text).alias("text"))
    found = written(sets(source, frequent_shingles(source, "text", config), config))
    full = found.where("light IS NOT NULL")
    # `deep`: frequent shingles in the prefix.
    facts = written(full.groupBy("class").agg(*[F.min(c).alias(c) for c in ("th", "n", "length", "rare", "least", "last")], F.min(F.size("heavy")).alias("deep")))
    lists = written(light_lists(full).select(F.monotonically_increasing_id().alias("list"), "classes", "sizes"))

    need = F.ceil(F.col("n") * config.percent / 100)
    # A set that shares frequent shingles only has enough of them.
    apt = written(full.where((F.size("heavy") > 0) & (F.col("n") - F.col("rare") >= need)).select("class", "n", "rare", "heavy").dropDuplicates(["class"]))
    few = apt.select("class", "n", "rare", F.explode(F.slice("heavy", 1, 4)).alias("shingle"))
    centre = F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), F.col("class").alias("a"), F.col("n").alias("n_a"))).alias("c")
    centres = few.groupBy("shingle").agg(centre).select("shingle", "c.a", "c.n_a")  # at most MOST_FREQUENT rows
    stars = few.join(F.broadcast(centres), "shingle").where((F.col("a") != F.col("class")) & _near_sizes(F.col("n"), F.col("n_a"), config.percent)).select("a", F.col("class").alias("b"))
    stars = stars.distinct().select("a", "b", F.lit(1 << 30).alias("shared"), F.lit(0).alias("extra"))
    rest = F.expr("filter(transform(classes, (c, i) -> struct(c AS b, sizes[i] AS n)), (x, i) -> i > 0 AND least(x.n, sizes[0]) * 100 >= greatest(x.n, sizes[0]) * %d)" % config.percent)
    spokes = lists.select(F.col("classes")[0].alias("a"), F.explode(rest).alias("x")).groupBy("a", "x.b").agg(F.count("*").alias("shared")).select("a", "b", "shared", F.lit(1).alias("extra"))
    near = written(_possible(spokes.unionByName(stars), facts, config).distinct())

    def with_text(pairs: DataFrame) -> DataFrame:
        return facts.select("class", "th").join(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct(), "class")

    texts = written(_texts(source, with_text(near)))
    links = written(verified(near, texts, config))
    owner = components(links)

    own = written(facts.select("class", "n", "rare").join(owner.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "rare", F.coalesce("component", "class").alias("component")))
    # Pairs of different components in the lists of rare shingles.
    placed = written(lists.select("list", F.explode("classes").alias("class")).join(own, "class").select("list", "class", "component", "n"))
    several = placed.groupBy("list").agg(F.min("component").alias("_least"), F.max("component").alias("_most"), F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).where("_least <> _most").select("list", "parts")
    entries = placed.join(several, "list").withColumn("range", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / config.percent))))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    one = entries.select("list", "range", part.alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("class", "component", "n")])
    # Sizes within the threshold lie in the same range or in a neighbouring one.
    every = entries.select("list", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range"), "parts", *[F.col(c).alias(f"{c}_b") for c in ("class", "component", "n")])
    every = every.select("list", "range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class_b", "component_b", "n_b")
    cross = one.join(every, ["list", "range", "part"]).where((F.col("class_a") < F.col("class_b")) & (F.col("component_a") != F.col("component_b")) & _near_sizes(F.col("n_a"), F.col("n_b"), config.percent))
    rare_pairs = cross.groupBy(F.col("class_a").alias("a"), F.col("class_b").alias("b")).agg(F.count("*").alias("shared")).select("a", "b", "shared", F.lit(1).alias("extra"))
    # And in those of frequent shingles, for pairs that share no rare one: what isn't in a list's main component, against all of the list.
    deep = written(apt.select("class", "heavy", F.explode("heavy").alias("shingle")).join(own, "class"))
    by_part = deep.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    main = by_part.groupBy("shingle").agg(F.max(F.struct("m", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("shingle", F.col("x.component").alias("main"))
    deep = deep.join(F.broadcast(main), "shingle").withColumn("h", F.col("n") - F.col("rare"))  # at most MOST_FREQUENT rows, times what shares a slot
    left, right = (deep.select("shingle", F.col("class").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "h", "component", "main", "heavy")]) for k in "ab")
    enough = F.least("h_a", "h_b") * (100 + config.percent) >= (F.col("n_a") + F.col("n_b")) * config.percent
    # A pair comes from the first shingle that both prefixes hold only, and not once for each.
    both = F.array_intersect("heavy_a", "heavy_b")
    matched = left.where("component_a <> main_a").join(right, "shingle").where((F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main_b")) | (F.col("a") < F.col("b"))) & enough & _near_sizes(F.col("n_a"), F.col("n_b"), config.percent) & (F.array_min(both) == F.col("shingle")))
    deep_pairs = matched.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.size(both).cast("long").alias("shared"), F.lit(0).alias("extra")).distinct()
    others = written(_possible(rare_pairs, facts, config).unionByName(_possible(deep_pairs, facts, config)).distinct())
    if not others.isEmpty():
        missing = with_text(others).join(texts.select("class"), "class", "left_anti")
        more = texts.unionByName(_texts(source, missing))
        links = written(links.unionByName(verified(others, more, config)))
        owner = components(links)

    first = found.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = written(first.join(owner.withColumnRenamed("node", "class"), "class", "left").select("class", "first", F.coalesce("component", "class").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "component").select("class", "component_id")
    some = found.where("n > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class").join(by_class, "class").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(found.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
