"""Byte-level BPE encoding and decoding with the ranks of a tiktoken file, by the tokenizers library over Arrow batches.

The library's model works on characters that stand for bytes, and wants merges where the file has ranks. Both follow from the ranks: the
merges are recovered by splitting every token at lower ranks, and the byte table maps printable bytes to themselves and the others to
characters from U+0100 on. Texts are cut before spaces, where no match of the pattern can span, and every distinct cut is encoded once for
a batch, each match of the pattern separately; the whole text's ids are the joined ids of its cuts.

Defined results: a null text is empty and has no ids; equal texts have equal ids; an id outside the vocabulary or null ids among ids raise
in decode(); null id lists decode to empty bytes; texts decode with U+FFFD for bytes that aren't UTF-8 (a character split by a cut of the
ids), and `decoded` keeps the exact bytes. Other columns pass through unchanged; a clash with a new column's name raises.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a result batch, bytes of distinct cuts and their ids that a task remembers before it forgets them all, and characters of one.
ROWS, REMEMBERED, LONGEST = 512, 24 << 20, 256

# Where a cut before a space could fall inside a match: white space on both sides, or before the end of the text.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a tiktoken file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of several bytes, in order of rank: what merging by lower ranks leaves of it."""
    rank = {t: i for i, t in enumerate(tokens)}
    none = len(tokens)
    out = []
    for own, token in enumerate(tokens):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((rank.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best >= own:
                raise ValueError(f"rank {own} can't be made of lower ranks")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((parts[0], parts[1]))
    return out


#: Joins pieces in one call of the library; as a lone surrogate it is in no text, and its bytes stand for themselves in no token.
_MARK = "\udfff"


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian int32 bytes; every distinct match of the pattern is encoded once for a call."""
    import regex
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokens, table = read_ranks(path), byte_characters()
    shown = lambda b: "".join(table[x] for x in b)
    model = models.BPE(
        vocab={shown(t): i for i, t in enumerate(tokens)},
        merges=[(shown(a), shown(b)) for a, b in merges_of(tokens)],
        ignore_merges=True,
        cache_capacity=0,
    )
    library, match, to_shown = Tokenizer(model), regex.compile(pattern), dict(enumerate(table))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no byte is shown as white space, so only the marks are
    mark = shown(_MARK.encode("utf-8", "surrogatepass"))

    def encode(texts: list[str]) -> list[bytes]:
        found = [match.findall(t) for t in texts]
        own = list(dict.fromkeys(p for ps in found for p in ps))
        ids: dict[str, bytes] = {}
        for at in range(0, len(own), 20_000):
            part = own[at : at + 20_000]
            joined = _MARK.join(part).encode("utf-8", "surrogatepass").decode("latin-1").translate(to_shown).replace(mark, " ")
            got = library.encode(joined, add_special_tokens=False)
            raw = np.array(got.ids, np.int32).tobytes()
            ends = (4 * (np.flatnonzero(np.diff(np.array(got.word_ids), append=-1)) + 1)).tolist()
            ids.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        return [ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for ps in found]

    return encode


def _cuts(text: str) -> list[str]:
    """The text, cut before spaces; no match of the pattern spans a cut."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return [text]
    first, *rest = text.split(" ")
    out = [first] if first else []
    out += [f" {x}" for x in rest]
    return out


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, kept: list[str], offsets: bool) -> Iterator[pa.RecordBatch]:
    encode, memo, starts, held = _encoder(path, pattern), {}, _lengths(path), 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [x or "" for x in part.column(text).to_pylist()]
            cuts = [_cuts(t) for t in texts]
            if held > REMEMBERED:
                memo.clear()
                held = 0
            new = list({c for cs in cuts for c in cs if c not in memo})
            memo.update(zip(new, encode(new), strict=True))
            ids = [np.frombuffer(b"".join([memo[c] for c in cs]), np.int32) for cs in cuts]
            for c in new:
                if len(c) > LONGEST:
                    del memo[c]
                else:
                    held += 2 * len(c) + len(memo[c])
            out = {n: part.column(n) for n in kept}
            out["ids"] = _lists(ids)
            if offsets:
                out["starts"] = _lists([_char_starts(t, starts[x]) for t, x in zip(texts, ids, strict=True)])
            yield pa.RecordBatch.from_pydict(out)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def _char_starts(text: str, lengths: np.ndarray) -> np.ndarray:
    """The character in which each token's first byte lies."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[np.cumsum(lengths) - lengths].astype(np.int32)


@lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    return np.array([len(t) for t in read_ranks(path)], np.int64)


def _fields(frame: DataFrame, *new: T.StructField) -> T.StructType:
    if clash := {f.name for f in new} & set(frame.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    return T.StructType([*frame.schema.fields, *new])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, offsets: bool = False) -> DataFrame:
    """Adds `ids`, and with offsets `starts`, the character offset of each token. keep: the columns to keep, all by default."""
    kept = docs.columns if keep is None else keep
    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField("ids", ints), *([T.StructField("starts", ints)] if offsets else [])]
    source = docs.select(*dict.fromkeys([*kept, text]))
    return source.mapInArrow(lambda b: _encode_batches(b, path, pattern, text, kept, offsets), _fields(docs.select(*kept), *new))


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, each one's start and length: the byte characters' table read backwards."""
    back = {c: b for b, c in enumerate(byte_characters())}
    shown = ["".join(byte_characters()[x] for x in t) for t in read_ranks(path)]
    tokens = [bytes(back[c] for c in s) for s in shown]
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids in a row, and where each id's bytes end."""
    raw, start, size = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
        raise ValueError("an id is outside the vocabulary")
    own = size[ids]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return raw[np.arange(total) + np.repeat(start[ids] - (ends - own), own)], ends


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str, text: bool) -> Iterator[pa.RecordBatch]:
    table = _table(path)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column(ids)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.drop_null().flatten()
            if flat.null_count:
                raise ValueError("null among the ids")
            raw, ends = decode_ids(flat.to_numpy(zero_copy_only=False), table)
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(raw)])
            out = {n: part.column(n) for n in part.schema.names} | {"decoded": data}
            if text:
                out["decoded_text"] = pa.array([b.decode("utf-8", "replace") for b in data.to_pylist()], pa.string())
            yield pa.RecordBatch.from_pydict(out)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: bool = False) -> DataFrame:
    """Adds `decoded`, the bytes of the ids, and with text `decoded_text`, the same as text."""
    new = [T.StructField("decoded", T.BinaryType()), *([T.StructField("decoded_text", T.StringType())] if text else [])]
    return frame.mapInArrow(lambda b: _decode_batches(b, path, ids, text), _fields(frame, *new))


def coded(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one Python worker: the kept columns, ids and decoded."""
    kept = docs.columns if keep is None else keep
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode_batches(_encode_batches(batches, path, pattern, text, kept, False), path, "ids", False)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, _fields(docs.select(*kept), *new))


def with_digests(frame: DataFrame) -> DataFrame:
    """Adds the number of ids, and SHA-256 digests of the ids joined by commas and of the decoded bytes."""
    return frame.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    })


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, and the digests of with_digests()."""
    return with_digests(coded(docs, path, pattern, text, [doc_id])).select(doc_id, "n_tokens", "ids_sha256", "decoded_sha256")
