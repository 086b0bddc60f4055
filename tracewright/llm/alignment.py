"""Alignment of two tokenizers over a corpus, counted by inverted pair bitmaps.

A text with a space before it is encoded by a byte-level BPE (A) and by a sentencepiece model (B, which adds the space itself). Where tokens
of both end at the same byte, a group ends. An A and a B token are linked where their bytes overlap. For each pair of ids the corpus gives
the number of documents that hold it linked, and of its links.

Texts are cut before spaces between characters that aren't white space. Neither tokenizer has a token across such a place (checked for B's
vocabulary when it is loaded), so each distinct cut of some megabytes of texts is encoded and aligned once, and a text is the row of its cuts.

Pairs are counted by bitmaps. Each task numbers its documents in chunks of at most `CHUNK_DOCS` documents and about `CHUNK_LINKS` pairs; a
chunk has, for each pair, a compressed bitmap of the documents that hold it, into which the bitmaps of batches are merged by OR, and bitmaps
of multiplicity planes: bit j of a document's links less one. A bitmap is its documents' places as 16-bit numbers or, if these would take more,
one bit for each place. Different chunks hold different documents, so the popcounts of a pair's chunks add up to its document count, and
those of its planes, weighted by 2^j, to its links. For scores the chunks' bitmaps meet the counts and go back to their chunk, whose
documents add up what each of their postings returns.

Defined results: null and empty texts, and texts whose joined tokens of A or B differ from the text with its space (as where the text holds
U+2581), have no tokens, no links and no group text; every row is a document of its own, whatever its id, so equal texts count as often as
they occur; of counts that tie for an A id's highest, all are best. Tables are written once, so that a document's number never changes when
an executor is lost. Documents of any length are whole. Empty tables give no rows. The result has an id and numbers only, so no names clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .bpe import byte_characters

CHUNK_DOCS, CHUNK_LINKS = 1 << 16, 2_000_000
#: Characters of texts whose distinct cuts are aligned together, and of cuts that are encoded as one text.
TAKEN, BLOCK = 12 << 20, 1 << 17
#: A pair is one number, A's id times this plus B's.
B_IDS = 1 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_INDEX = "kind int, doc_id long, chunk long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, plane int, n int, bits binary"
_EMPTY = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Cuts:
    """Aligned cuts: counts by cut, the texts of their groups, and all pairs in a row, of which those of cut k begin at starts[k]. Cuts that
    aren't fine, as a tokenizer doesn't give their bytes back, have none."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    starts: np.ndarray
    fine: np.ndarray


class _Bytes:
    """The bytes of a vocabulary's tokens, all in a row."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids in a row, and where each id's end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.raw[np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)], ends


#: The pattern by which byte-level BPE of this family cuts texts; a fixed value of the format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A function from texts to ids, special tokens being plain text, and each id's bytes, of a byte-level BPE in a tokenizers file.

    Where the n-th merge makes the n-th id behind the single bytes, ids are ranks, and tiktoken gives the same ids several times faster than
    the tokenizers library, which does it otherwise.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    own = [b""] * (max([*vocab.values(), *special]) + 1)
    for token, i in vocab.items():
        own[i] = token.encode() if i in special else bytes(back[c] for c in token)
    for i, token in special.items():
        own[i] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    cut = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    ranked = [i for i in range(256 + len(pairs)) if i not in special] == list(range(256 + len(pairs))) and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
    if plain and ranked:
        import tiktoken

        ranks = {own[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, own
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids, own


class Aligner:
    """Encodes and aligns cuts by both tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self._encode_a, a_bytes = byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > B_IDS:
            raise ValueError(f"more than {B_IDS} pieces")
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} goes over a space between words")
        self.a_bytes, self.b_bytes = _Bytes(a_bytes), _Bytes(b_bytes)
        self.space = self.b.piece_to_id("▁")
        # Each id's decimal text with the mark behind it: a token's that isn't the last of its side of a group, and the last one's.
        self.a_shown = [f"{i}{mark}" for mark in ",|" for i in range(len(a_bytes))]
        self.b_shown = [f"{i}{mark}" for mark in ",;" for i in range(len(b_bytes))]

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a text that starts with a space."""
        return np.array(self._encode_a(text), np.int64), np.array(self.b.encode(text[1:], num_threads=1) or [self.space], np.int64)

    def _gives_back(self, a: np.ndarray, b: np.ndarray, raw: np.ndarray) -> bool:
        return all(np.array_equal(own.of(ids)[0], raw) for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def align(self, cuts: list[str]) -> Cuts:
        """Cuts that start with one space and end in no white space are encoded many at a time, as they stand side by side."""
        size = np.fromiter(map(len, map(str.encode, cuts)), np.int64)
        fine = np.ones(len(cuts), bool)
        a_parts, b_parts = [], []
        block: list[int] = []
        held = 0

        def encode(rows: list[int]) -> None:
            text = "".join([cuts[k] for k in rows])
            a, b = self._encoded(text)
            if self._gives_back(a, b, np.frombuffer(text.encode(), np.uint8)):
                a_parts.append(a)
                b_parts.append(b)
            elif len(rows) > 1:
                for k in rows:
                    encode([k])
            else:
                fine[rows[0]] = False

        order: list[int] = []
        alone: list[int] = []
        for k, cut in enumerate(cuts):
            if len(cut) < 2 or cut[1].isspace() or cut[-1].isspace() or "▁" in cut:
                alone.append(k)
                continue
            block.append(k)
            order.append(k)
            held += len(cut)
            if held > BLOCK:
                encode(block)
                block, held = [], 0
        for rows in (block, *[[k] for k in alone]):
            if rows:
                encode(rows)
        order += alone
        return self._aligned(np.array(order, np.int64), size, fine, np.concatenate([_EMPTY, *a_parts]), np.concatenate([_EMPTY, *b_parts]))

    def _aligned(self, order: np.ndarray, size: np.ndarray, fine: np.ndarray, a: np.ndarray, b: np.ndarray) -> Cuts:
        """order: the cuts as their tokens a and b stand in a row, those that aren't fine without tokens."""
        ends = np.cumsum(np.where(fine, size, 0)[order])
        a_ends, b_ends = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        first = np.append(True, both[1:] != both[:-1])[: len(both)]
        places = both[first]  # each link ends where a token of either ends
        common = np.append(both[1:] == both[:-1], False)[: len(both)][first]
        a_at, b_at = np.searchsorted(a_ends, places), np.searchsorted(b_ends, places)
        pairs = a[a_at] * B_IDS + b[b_at]
        within = lambda stops: np.diff(np.searchsorted(stops, ends, "right"), prepend=0)
        groups = places[common]
        # Groups' texts: A's ids and then B's ids of each.
        a_group, b_group = np.searchsorted(groups, a_ends), np.searchsorted(groups, b_ends)
        a_last, b_last = np.isin(a_ends, groups, assume_unique=True), np.isin(b_ends, groups, assume_unique=True)
        shown = [self.a_shown[i] for i in (a + a_last * len(self.a_bytes.size)).tolist()] + [self.b_shown[i] for i in (b + b_last * len(self.b_bytes.size)).tolist()]
        turn = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        shown = [shown[i] for i in turn.tolist()]
        n_a, n_b, n_groups, n_links = within(a_ends), within(b_ends), within(groups), within(places)
        stops = np.cumsum(n_a + n_b).tolist()
        texts = ["".join(shown[lo:hi])[:-1] for lo, hi in zip([0, *stops], stops)]  # noqa: B905
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Cuts(n_a[back], n_b[back], n_groups[back], [texts[k] for k in back.tolist()], pairs, (np.cumsum(n_links) - n_links)[back], fine)


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def cuts_of(text: str) -> list[str]:
    """The text with a space before it, cut where no token of either tokenizer goes over."""
    if not text:
        return []
    first, *rest = _CUT.split(" " + text)
    # The space before the text is itself such a place's space, but nothing is before it.
    return [first, *[" " + x for x in rest]]


def containers(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(key, popcount, bitmap) of each key of entries that are sorted by key and place and differ."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.diff(starts, append=len(keys))
    dense = n >= CHUNK_DOCS // 16
    size = np.where(dense, CHUNK_DOCS // 8, 2 * n)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    sparse = np.repeat(~dense, n)
    at = np.repeat(ends[:-1] - 2 * starts, n) + 2 * np.arange(len(keys))
    low = places.astype(np.uint16)
    out[at[sparse]], out[at[sparse] + 1] = low[sparse] & 255, low[sparse] >> 8
    for k in np.flatnonzero(dense):
        bits = np.zeros(CHUNK_DOCS, bool)
        bits[places[starts[k] : starts[k] + n[k]]] = True
        out[ends[k] : ends[k + 1]] = np.packbits(bits, bitorder="little")
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    return keys[starts], n, raw


def places_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all bitmaps in a row, and how many each has."""
    size = np.array(pc.binary_length(bits).to_numpy(zero_copy_only=False), np.int64)
    raw = np.frombuffer(b"".join(bits.to_pylist()), np.uint8)
    ends = np.cumsum(size)
    full = size == CHUNK_DOCS // 8
    n, found = size // 2, {}
    for k in np.flatnonzero(full):
        found[k] = np.flatnonzero(np.unpackbits(raw[ends[k] - size[k] : ends[k]], bitorder="little"))
        n[k] = len(found[k])
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    sparse = raw[np.repeat(~full, size)]
    out[np.repeat(~full, n)] = sparse.view("<u2") if len(sparse) else 0
    for k, own in found.items():
        out[first[k] : first[k] + n[k]] = own
    return out, n


def _rows(count: int, **known: pa.Array) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([known[f].cast(kinds[t]) if f in known else pa.nulls(count, kinds[t]) for f, t in fields], [f for f, _ in fields])


class _Chunk:
    """The bitmaps of a chunk under construction: pairs by place, with their multiplicity."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.size, self.parts = number, 0, 0, []

    def add(self, pairs: np.ndarray, places: np.ndarray) -> None:
        """Pairs as often as they are linked."""
        for some in np.array_split(np.arange(len(pairs)), max(1, len(pairs) // CHUNK_LINKS)):
            keys, times = np.unique(pairs[some] << 16 | places[some], return_counts=True)
            self.parts.append((keys, times))
            self.size += len(keys)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The rows of its bitmaps: those of batches merged, and the planes cut out of the multiplicities."""
        if not self.size:
            return
        keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        times = np.bincount(back, np.concatenate([t for _, t in self.parts])).astype(np.int64) - 1
        planes = [(-1, np.ones(len(keys), bool))] + [(j, times >> j & 1 == 1) for j in range(int(times.max()).bit_length())]
        for plane, own in planes:
            pair, n, bits = containers(keys[own] >> 16, keys[own] & 0xFFFF)
            for at in range(0, len(pair), 50_000):
                part = slice(at, at + 50_000)
                m = len(pair[part])
                yield _rows(
                    m, kind=pa.array(np.ones(m, np.int32)), chunk=pa.array(np.full(m, self.number)), pair=pa.array(pair[part]),
                    plane=pa.array(np.full(m, plane, np.int32)), n=pa.array(n[part]), bits=bits[part],
                )


def _index_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(a_path, b_path)
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    chunk = _Chunk(first)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at, end in _ranges(texts):
            numbers = defaultdict(count().__next__)
            own = [np.fromiter(map(numbers.__getitem__, cuts_of(t or "")), np.int64) for t in texts[at:end]]
            known = aligner.align(list(numbers))
            n_links = known.n_a + known.n_b - known.n_groups  # a link ends with a token of A, of B, or of both
            out = {k: [] for k in ("place", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            pairs: list[np.ndarray] = []
            places: list[int] = []
            waiting = 0
            for ks in own:
                if chunk.docs == CHUNK_DOCS or chunk.size + waiting > CHUNK_LINKS:
                    chunk.add(*_linked(pairs, places))
                    yield from chunk.close()
                    chunk, pairs, places, waiting = _Chunk(chunk.number + 1), [], [], 0
                if not known.fine[ks].all():
                    ks = ks[:0]
                size = n_links[ks]
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                out["chunk"].append(chunk.number)
                out["place"].append(chunk.docs)
                out["n_a"].append(int(known.n_a[ks].sum()))
                out["n_b"].append(int(known.n_b[ks].sum()))
                out["n_groups"].append(int(known.n_groups[ks].sum()))
                out["n_links"].append(total)
                out["groups_sha256"].append(hashlib.sha256(";".join([known.groups[k] for k in ks.tolist()]).encode()).hexdigest() if len(ks) else "")
                pairs.append(known.pairs[np.arange(total) + np.repeat(known.starts[ks] - (ends - size), size)])
                places.append(chunk.docs)
                waiting += total
                chunk.docs += 1
            chunk.add(*_linked(pairs, places))
            n = end - at
            yield _rows(n, kind=pa.array(np.zeros(n, np.int32)), doc_id=batch.column("doc_id").slice(at, n), **{k: pa.array(v) for k, v in out.items()})
    yield from chunk.close()


def _ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `TAKEN` characters together, or of one longer text."""
    at, held = 0, 0
    for end, t in enumerate(texts):
        held += len(t or "")
        if held > TAKEN and end > at:
            yield at, end
            at, held = end, len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _linked(pairs: list[np.ndarray], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([_EMPTY, *pairs]), np.repeat(np.array(places, np.int64), [len(p) for p in pairs])


@dataclass(frozen=True)
class Index:
    """docs: a row by document (doc_id, chunk, place, n_a, n_b, n_groups, n_links, groups_sha256). bitmaps: (chunk, pair, plane, n, bits),
    plane -1 for the documents that hold the pair, j for bit j of their links less one; n is the popcount."""

    docs: DataFrame
    bitmaps: DataFrame


def indexed(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Aligns every document and writes the index to the shared folder."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = written(source.mapInArrow(lambda b: _index_batches(b, a_path, b_path), _INDEX))
    return Index(
        made.where("kind = 0").select("doc_id", "chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"),
        made.where("kind = 1").select("chunk", "pair", "plane", "n", "bits"),
    )


def pair_counts(index: Index) -> DataFrame:
    """(a, b, documents, links, best) by linked pair: in how many documents, how often, and whether no pair of its A id is in more."""
    weight = F.expr("shiftleft(1L, greatest(plane, 0))")  # the documents' own plane counts one for each
    counts = index.bitmaps.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("documents"), F.sum(F.col("n") * weight).alias("links"))
    named = counts.select("pair", F.floor(F.col("pair") / B_IDS).cast("int").alias("a"), (F.col("pair") % B_IDS).cast("int").alias("b"), "documents", "links")
    highest = named.groupBy("a").agg(F.max("documents").alias("_most"))
    return named.join(highest, "a").select("pair", "a", "b", "documents", "links", (F.col("documents") == F.col("_most")).alias("best"))


def _returned(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's bitmaps with their pairs' counts: what each document's postings return."""
    n_best, total = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
    for batch in batches:
        places, n = places_of(batch.column("bits"))
        plane = batch.column("plane").to_numpy()
        weight = np.where(plane < 0, 1, np.int64(1) << np.maximum(plane, 0).astype(np.int64))
        np.add.at(total, places, np.repeat(weight * batch.column("documents").to_numpy(), n))
        np.add.at(n_best, places, np.repeat(weight * batch.column("best").to_numpy(zero_copy_only=False).astype(np.int64), n))
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({
        "chunk": pa.array(np.full(len(own), key[0].as_py())), "place": pa.array(own.astype(np.int32)), "n_best": pa.array(n_best[own]), "count_sum": pa.array(total[own])
    })


def scores(index: Index) -> DataFrame:
    """(chunk, place, n_best, count_sum) of every document with links: how many of them are best pairs', and the sum of their pairs' counts.

    Pairs are as many as both vocabularies allow, too many to send to each executor, so that their join is a sorted one at any size.
    """
    known = written(pair_counts(index).select("pair", "documents", "best"))
    joined = index.bitmaps.join(known.hint("merge"), "pair").select("chunk", "plane", "bits", "documents", "best")
    return joined.groupBy("chunk").applyInArrow(_returned, "chunk long, place int, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its counts of tokens, groups and links, its links' scores and the digest of its groups' ids."""
    index = indexed(docs, a_path, b_path, doc_id, text)
    known = index.docs.join(scores(index), ["chunk", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return known.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
