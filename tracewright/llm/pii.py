"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that finds what they miss.

The patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check and phone numbers with a plus sign.
The field reads every word of every text as two shapes: a fine one (runs of digits by length, runs of letters, other characters as they
are; "at" and "dot" stay) and a coarse one (which kinds of characters the word holds). It has weights for the fine shapes of a word and of
two neighbours on either side, for its coarse shape, and for pairs of labels. It is trained on the labelled table of this module by gradient
steps on the exact likelihood, and decoded by Viterbi over batches of word sequences in numpy. It adds addresses spelled with "at" and
"dot", addresses with bracketed dots, phone numbers without a plus sign and card numbers with other separators. What it labels must still
hold what its kind needs (parts up to 255, Luhn's check, a number's length); spans that overlap base spans of any kind are left out.

Viterbi runs over whole texts. In the middle of a long stretch of plain words (letters only) its labelling is known beforehand: reach()
derives from the trained weights how many plain words on either side force a word's label to be O whatever lies beyond them. Sequences are
cut at such words, which gives the labelling of the uncut sequence exactly; a model for which no such number exists is refused.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive; spans are ordered by start, then by
kind as in KINDS; equal texts, and so repeated rows, get equal spans; of labellings with equal scores the one with the earlier labels wins;
further columns pass through; a clash with a new column's name raises; empty tables give no rows. Very long texts and words cost time in
proportion to their length and memory to the longest text's words.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import spans as row_spans
from .arrowtext import utf8

KINDS = ("email", "ip", "card", "phone")
#: Bytes of text that are decoded together, words of a batch of sequences with their filling,
#: steps whose scores are looked up together, and words whose shapes a task remembers.
BLOCK, CELLS, STEPS, REMEMBERED = 1 << 20, 1 << 16, 1 << 12, 300_000

Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, leftmost and without overlaps for each kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# The labelled table: invented sentences in which {kind|words} marks a span. Names, hosts, numbers and cards are those set aside for
# documentation and tests, or made up here; none is taken from a table that the operator is run on.
LABELLED = """
write to {email|jane dot doe at mail dot com} about the order
you can reach {email|sam (at) example (dot) org} or ask here
contact {email|info [at] shop [dot] net} for details
send it to {email|k.lee at host dot io} today please
mail {email|anna [at] post.example.com} before noon
my address is {email|tom_r (at) site.org} and that is all
please ask {email|office{at}firm{dot}com} again
reach me under {email|peter dot may at web dot example dot net} at any hour
write {email|desk at example dot com} or come by
ask {email|mary_ann at example dot org} for the key
send a note to {email|b2b at firm dot example} and wait
it went to {email|lost.found@example.org} last week
write to {email|jane[at]mail[dot]com} about the order
you can reach {email|sam(at)example(dot)org} or ask here
send it to {email|tom_r(at)site.org} today please
mail {email|info[at]post.example.com} before noon
contact {email|k.lee[at]firm[dot]co[dot]example} for details
ask {email|mary-ann(at)web.example.net} for the key
note {email|b2b{at}host.example} and wait
please ask {email|desk<at>shop<dot>org} again
under {email|anna.b{at}mail{dot}example{dot}org} at any hour
see note[a] and table[b] or list(c) below
f(x) and g(y) are given by h(x)y(z)w at once
mail {email|a_b@mail.example.com} about the lamp
meet us at the station dot the map and go
we met at noon and left at night
he was at home at last with the dot on it
at seven the doors open and at nine they close
look at the dot at the end of the line
there is a dot at the top and one at the foot
call {phone|(020) 555-0143} after five
phone {phone|555-010-0199} or come by
tel {phone|(415) 555 0132} is the desk
ring {phone|030 555 01 77 12} in the morning
the office {phone|0044 20 5550 0177} is open
fax {phone|020-555-0188} and wait
number {phone|555.010.0123} works too
write or call {phone|(212) 555-0199} any time
call {phone|020 555 0166} now
call {phone|+44 20 5550 0101} from abroad
dial {phone|+1 (212) 555-0147} or write
mail {email|x [at] y [dot] com} or call {phone|(030) 555-0112}
the host {ip|203[.]0[.]113[.]76} was seen
traffic from {ip|10(.)0(.)0(.)7} to the gateway
block {ip|192[.]0[.]2[.]20} and log it
the log names {ip|198{.}51{.}100{.}4} twice
seen at {ip|198.51.100.23} and gone
from {ip|192.0.2.146} to the router
pay with {card|4111.1111.1111.1111} today
card {card|5555_5555_5555_4444} is old
the number {card|4012/8888/8888/1881} was read out
charge {card|4111  1111  1111  1111} for it
use {card|5555 5555 5555 4444} for the fee
card {card|4012888888881881} was lost
pay by {card|4111-1111-1111-1111} at the desk
they billed {card|6011111111111117} twice in a week
{card|5105105105105100} then {card|4012888888881881} were refused
it was put on {card|5105105105105100} by mistake
version 2.0 was released in 2004 with 35 fixes
licensed under the terms of version 3.1, see below.
see sections 3.2 and 4.1 (page 17) for more
the year 1998 and 12 of 40 rows were kept
key = "c0ffee12ab34cd56ef7890ab12cd34ef56ab78cd" in the file
on 2021-03-04 at 10:15 we had 1200 users
from 03.11.2019 to 07.02.2020 it was shut
on 2019.11.03 and 11/03/2019 they met
about 3,500 of 12,000 (29%) came back
room 101 on floor 7 at the end
chapter (3) of part [2] is short
item 12-34 and lot 7/8 are sold
from 1914 to 1918 and from 1939 to 1945
scores of 3-1, 2-2 and 0-4 at home
version 1.2.3 follows 1.2.2 and 1.1
a total of 1,204,331 at 12.5 each
plain words follow one another here and there
nothing to see in this line at all
the cat | the dog | the cow and more
sums*** and&&& the%%% rest###
call me later or write a letter
it was (as they say) a good day
"""

_MARK = re.compile(r"\{(" + "|".join(KINDS) + r")\|(.*?)\}(?= |$)")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_WORD = re.compile(r"\S+")
#: Marks that may follow a word in a sentence.
MARKS = ".,;:!?\"'"


def shape(word: str) -> str:
    """The fine shape: runs of up to 3 digits as `n`, longer ones by length, and runs of letters as `a`; "at" and "dot" stay, as words
    and in brackets."""
    word = word.rstrip(MARKS)
    low = word.lower()
    if low.strip("([{<)]}>") in ("at", "dot"):
        return low

    def run(m: re.Match) -> str:
        n = len(m[0])
        if not m[0][0].isdigit():
            bracketed = m[0].lower() in ("at", "dot") and word[m.start() - 1 : m.start()] in tuple("([{<") and word[m.end() : m.end() + 1] in tuple(")]}>")
            return m[0].lower() if bracketed else "a"
        return "n" if n <= 3 else f"<{n if n == 4 else 7 if n <= 7 else 11 if n <= 11 else 19 if n <= 19 else 20}>"

    return _RUN.sub(run, word)


def outline(fine: str) -> str:
    """The coarse shape: what a fine shape begins with, and the kinds of characters that it holds."""
    kinds = re.sub(r"<[0-9]+>|n", "0", fine) if fine not in ("at", "dot") else fine
    return kinds[:1] + "|" + "".join(sorted(set(kinds)))


def _joined_lines() -> list[str]:
    """Sentences with an address in one word, for names, brackets and hosts of several forms."""
    out = []
    for k, (name, (a, z)) in enumerate(itertools.product(("mia", "mia.k", "mia_k", "mia-k", "mia7", "m_7"), ("[]", "()", "{}", "<>"))):
        for host in ("shop.example", f"shop{a}dot{z}example", "web.shop.example", f"web{a}dot{z}shop{a}dot{z}example"):
            out.append(f"{('write to', 'ask', 'mail')[k % 3]} {{email|{name}{a}at{z}{host}}} {('before noon', 'and wait', 'about it')[k % 3]}")
    return out


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the labelled sentences, and of each span as a text of its own; labels are O, or B- or I- with a kind."""
    out = []
    lines = [*LABELLED.strip().splitlines(), *_joined_lines()]
    for line in [*lines, *(m[0] for line in lines for m in _MARK.finditer(line))]:
        words, labels, at = [], [], 0
        for m in [*_MARK.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)].split()
            words += plain
            labels += ["O"] * len(plain)
            if m:
                inside = m[2].split()
                words += inside
                labels += [f"{'I' if i else 'B'}-{m[1]}" for i in range(len(inside))]
                at = m.end()
        out.append((words, labels))
    return out


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SIDE = 2  # neighbours on either side whose shapes count
UNKNOWN, OUTSIDE, PLAIN = 0, 1, 2  # numbers of shapes; the others follow


@dataclass(frozen=True)
class CrfModel:
    shapes: dict[str, int]
    outlines: dict[str, int]
    near: np.ndarray  # [place from -SIDE to SIDE, fine shape, label]
    coarse: np.ndarray  # [coarse shape, label]
    pairs: np.ndarray  # [label, next label]

    def number(self, word: str) -> tuple[int, int]:
        """The numbers of a word's fine and coarse shapes."""
        fine = shape(word)
        return self.shapes.get(fine, UNKNOWN), self.outlines.get(outline(fine), UNKNOWN)


def _padded(rows: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """[sequence, word, (fine, coarse)], filled with OUTSIDE, SIDE of them on either side; and the sequences' lengths."""
    size = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(size.max()) + 2 * SIDE, 2), OUTSIDE, np.int64)
    for i, r in enumerate(rows):
        out[i, SIDE : SIDE + len(r)] = r
    return out, size


def _emissions(near: np.ndarray, coarse: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[sequence, word, label] of padded shapes."""
    length = x.shape[1] - 2 * SIDE
    return coarse[x[:, SIDE : SIDE + length, 1]] + sum(near[k][x[:, k : k + length, 0]] for k in range(2 * SIDE + 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def likelihood(weights: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, tuple[np.ndarray, ...]]:
    """The log-likelihood of labels y, by forward and backward sums over all labellings, and its gradient by (near, coarse, pairs)."""
    near, coarse, pairs = weights
    n, length, k = len(x), x.shape[1] - 2 * SIDE, len(pairs)
    live = np.arange(length)[None] < size[:, None]
    e = _emissions(near, coarse, x)
    forward, backward = np.zeros((n, length, k)), np.zeros((n, length, k))
    forward[:, 0] = e[:, 0]
    for t in range(1, length):
        forward[:, t] = _log_sum(forward[:, t - 1][:, :, None] + pairs[None], 1) + e[:, t]
    for t in range(length - 2, -1, -1):
        ahead = _log_sum(pairs[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t + 1 < size)[:, None], ahead, 0.0)
    total = _log_sum(forward[np.arange(n), size - 1], 1)
    gold = np.eye(k)[np.where(live, y, 0)] * live[..., None]
    gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    prob = np.exp(forward + backward - total[:, None, None]) * live[..., None]
    joint = forward[:, :-1, :, None] + pairs + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
    expected = (np.exp(np.minimum(joint, 0)) * live[:, 1:, None, None]).sum((0, 1))
    gap = gold - prob
    g_near, g_coarse = np.zeros_like(near), np.zeros_like(coarse)
    for place in range(2 * SIDE + 1):
        np.add.at(g_near[place], x[:, place : place + length, 0], gap)
    np.add.at(g_coarse, x[:, SIDE : SIDE + length, 1], gap)
    value = float((gold * e).sum() + (gold_pairs * pairs).sum() - total.sum())
    return value, (g_near, g_coarse, gold_pairs - expected)


def train(table: list[tuple[list[str], list[str]]], steps: int = 250, rate: float = 0.1, ridge: float = 0.001) -> CrfModel:
    """Adam on the log-likelihood of (words, labels), with a ridge."""
    fine = sorted({shape(w) for words, _ in table for w in words} - {"a"})
    shapes = {"a": PLAIN} | {s: PLAIN + 1 + i for i, s in enumerate(fine)}
    outlines = {s: PLAIN + i for i, s in enumerate(sorted({outline(s) for s in shapes}))}
    model = CrfModel(shapes, outlines, *[np.zeros(s) for s in ((2 * SIDE + 1, len(shapes) + 2, len(LABELS)), (len(outlines) + 2, len(LABELS)), (len(LABELS),) * 2)])
    x, size = _padded([[model.number(w) for w in words] for words, _ in table])
    y = np.zeros((len(table), int(size.max())), np.int64)
    for i, (_, labels) in enumerate(table):
        y[i, : len(labels)] = [LABELS.index(v) for v in labels]
    weights, n = (model.near, model.coarse, model.pairs), len(table)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in weights]
    for step in range(1, steps + 1):
        _, gradient = likelihood(weights, x, size, y)
        for own, g, (m, v) in zip(weights, gradient, moments, strict=True):
            g = g / n - ridge * own
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            own += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # A shape that was never seen speaks for no label.
    model.near[:, UNKNOWN] = np.minimum(model.near[:, PLAIN], 0)
    model.coarse[UNKNOWN] = 0
    reach(model)
    return model


def reach(model: CrfModel, most: int = 64) -> int:
    """So many plain words on either side of a plain word make its label O in the best labelling, whatever lies beyond them.

    With labels i and j fixed at both ends, the best labelling that has O in the middle must beat every other one, for all i and j; that is
    a comparison of powers of the matrix of steps between plain words, with maxima for sums.
    """
    emission = model.near[:, PLAIN].sum(0) + model.coarse[model.outlines[outline("a")]]
    step = model.pairs + emission[None]
    best = lambda a, b: (a[:, :, None] + b[None]).max(1)
    left, right = step, model.pairs
    for k in range(1, most + 1):
        left, right = best(left, step), best(step, right)  # k plain words before the middle one, and k after it
        through = left[:, :, None] + right[None]
        if (through[:, 0] > through[:, 1:].max(1) + 1e-6).all():
            # The neighbours' shapes count for the words at the ends.
            return k + SIDE
    raise ValueError("plain words must not be labelled")


def viterbi(model: CrfModel, numbers: list[np.ndarray], cut: int | None = None) -> list[np.ndarray]:
    """The best labelling of each sequence of (fine, coarse) numbers; cut: what reach() gives, or None to cut nowhere."""
    gap = np.full((SIDE, 2), OUTSIDE)
    x = np.concatenate([gap, *(part for own in numbers for part in (own.reshape(-1, 2), gap))])
    size = np.array([len(own) for own in numbers], np.int64)
    begin = np.cumsum(size + SIDE) - size
    label = np.zeros(len(x), np.int8)
    open_ = np.zeros(len(x), bool)
    if cut is None:
        open_[:] = x[:, 0] != OUTSIDE
    else:
        odd = np.concatenate([[0], np.cumsum(x[:, 0] != PLAIN)])
        at = np.arange(len(x))
        lo, hi = np.maximum(at - cut, 0), np.minimum(at + cut + 1, len(x))
        open_[:] = (x[:, 0] != OUTSIDE) & (odd[hi] - odd[lo] > 0)
    edge = np.diff(np.concatenate([[0], open_.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    order = np.argsort(stop - start, kind="stable")
    at = 0
    while at < len(order):
        # Sequences of nearly one length together, so that a batch has a bounded number of cells or one sequence.
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * (stop[order[upto]] - start[order[upto]]) <= CELLS:
            upto += 1
        chosen = order[at:upto]
        at = upto
        s, n = start[chosen], stop[chosen] - start[chosen]
        longest = int(n[-1])
        ahead, behind = x[s - 1, 0] != OUTSIDE, x[np.minimum(s + n, len(x) - 1), 0] != OUTSIDE  # next to a word that is O
        back = np.zeros((longest, len(s), len(model.pairs)), np.int8)

        def emissions(t: int, upto: int, s: np.ndarray = s) -> np.ndarray:
            """[word, sequence, label]"""
            p = np.minimum(s[None] + np.arange(t, upto)[:, None], len(x) - 1 - SIDE)
            return model.coarse[x[p, 1]] + sum(model.near[k][x[p + k - SIDE, 0]] for k in range(2 * SIDE + 1))

        ahead_of = np.ascontiguousarray(model.pairs.T)[None]  # [label, label before]
        for first in range(0, longest, STEPS):
            held = emissions(first, min(longest, first + STEPS))
            for t in range(first, first + len(held)):
                if not t:
                    score = held[0] + ahead[:, None] * model.pairs[0]
                    continue
                way = score[:, None, :] + ahead_of
                back[t] = way.argmax(2)
                score = np.where((t < n)[:, None], way.max(2) + held[t - first], score)
        own = (score + behind[:, None] * model.pairs[:, 0]).argmax(1)
        every = np.arange(len(s))
        for t in range(longest - 1, -1, -1):
            inside = t < n
            label[s[inside] + t] = own[inside]
            if t:
                own = np.where(inside, back[t, every, own], own)
    return [label[b : b + n] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


_AT, _DOT = (re.compile(rf"\s*[\[({{<]?\b{w}\b[\])}}>]?\s*", re.IGNORECASE) for w in ("at", "dot"))
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*")


def _valid(kind: int, text: str) -> bool:
    """What a labelled span must hold to be of its kind."""
    digits = _digits(text)
    if kind == 0:  # with "at" and "dot" as the signs they stand for, it must read as an address
        return bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        parts = _NOT_DIGITS.split(text)
        return len(parts) == 4 and all(p and _byte(p) for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


class _Numbers(dict):
    """The numbers of words' shapes, packed in one integer each; long words aren't remembered."""

    def __init__(self, model: CrfModel) -> None:
        super().__init__()
        self.model, self.plain = model, model.number("a")

    def __missing__(self, word: str) -> int:
        bare = word.rstrip(MARKS)
        # Letters only is the most frequent shape, and told without taking the word apart.
        fine, coarse = self.plain if bare.isalpha() and bare.lower() not in ("at", "dot") else self.model.number(word)
        if len(word) <= 64:
            self[word] = fine << 16 | coarse
        return fine << 16 | coarse


class Finder:
    """Finds spans with a model; remembers the shapes of words."""

    def __init__(self, model: CrfModel) -> None:
        self.model, self.cut, self.known = model, reach(model), _Numbers(model)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        packed = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 16, packed & 0xFFFF], 1)

    def field_spans(self, texts: list[str]) -> list[list[Span]]:
        """Each text's spans as the field labels them, without those that lack what their kind needs."""
        labels = viterbi(self.model, [self._numbers(t.split()) for t in texts], self.cut)
        out: list[list[Span]] = [[] for _ in texts]
        for i, own in enumerate(labels):
            if not own.any():
                continue
            words = [m.span() for m in _WORD.finditer(texts[i])]
            begins = np.flatnonzero((own > 0) & ((own % 2 == 1) | (np.concatenate([[0], own[:-1]]) != own) & (np.concatenate([[0], own[:-1]]) != own - 1)))
            for at in begins.tolist():
                kind, end = (int(own[at]) - 1) // 2, at + 1
                while end < len(own) and own[end] == 2 * kind + 2:
                    end += 1
                s, e = words[at][0], words[end - 1][1]
                e = s + len(texts[i][s:e].rstrip(MARKS))
                if _valid(kind, texts[i][s:e]):
                    out[i].append((s, kind, e))
        return out

    def find(self, texts: list[str], numeric: list[bool]) -> tuple[list[list[Span]], list[list[Span]]]:
        """Base spans, and all spans, of each text. numeric: whether a text holds a digit or @, without which no base span is."""
        base = [base_spans(t) if n else [] for t, n in zip(texts, numeric, strict=True)]
        every = []
        for own, found in zip(base, self.field_spans(texts), strict=True):
            kept, end = list(own), -1
            for s in found:
                if s[0] >= end and not any(b[0] < s[2] and s[0] < b[2] for b in own):
                    kept.append(s)
                    end = s[2]
            every.append(sorted(kept))
        return base, every


_NUMERIC = np.zeros(256, bool)
_NUMERIC[[*b"0123456789@"]] = True

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_NEW = [T.StructField("base", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))]
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, model: CrfModel | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds base and spans, arrays of (kind, start, end). keep: the columns to keep, all by default."""
    kept = docs.columns if keep is None else keep
    if clash := {"base", "spans"} & set(kept):
        raise ValueError(f"the input already has {sorted(clash)}")
    model = model or train(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            base, spans = [], []
            for a, b in row_spans(offsets, BLOCK):
                hits = np.concatenate([[0], np.cumsum(_NUMERIC[data[offsets[a] : offsets[b]]], dtype=np.int64)])[offsets[a : b + 1] - offsets[a]]
                own, every = finder.find([t or "" for t in batch.column(text).slice(a, b - a).to_pylist()], (hits[1:] > hits[:-1]).tolist())
                base += own
                spans += every
            shown = [pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in r] for r in col], _ARROW) for col in (base, spans)]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in kept} | {"base": shown[0], "spans": shown[1]})

    source = docs.select(*dict.fromkeys([*kept, text]))
    return source.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *_NEW]))


def joined(spans: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
