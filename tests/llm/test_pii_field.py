"""The random field of the personal-data operator against enumeration of all labellings."""

import itertools
import random

import numpy as np
import pytest

from tracewright.llm import pii

SENTENCES = [("call (020) 555-0143 now", "O B-phone I-phone O"), ("jane at mail", "B-email I-email I-email"), ("plain words", "O O"), ("at 4.4", "O B-card")]
TABLE = [(t.split(), y.split()) for t, y in SENTENCES]


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_table())


def random_model(seed):
    rnd = np.random.default_rng(seed)
    shapes, outlines = {"a": 2, "n": 3, "at": 4}, {pii.outline("a"): 2, pii.outline("n"): 3, pii.outline("at"): 4}
    k = len(pii.LABELS)
    return pii.CrfModel(shapes, outlines, rnd.normal(0, 1, (5, 5, k)), rnd.normal(0, 1, (5, k)), rnd.normal(0, 1, (k, k)))


def total(model, numbers, labels):
    x = np.concatenate([np.full((2, 2), pii.OUTSIDE), numbers, np.full((2, 2), pii.OUTSIDE)])
    out = 0.0
    for t, y in enumerate(labels):
        out += model.coarse[x[t + 2, 1], y] + sum(model.near[k, x[t + k, 0], y] for k in range(5))
        out += model.pairs[labels[t - 1], y] if t else 0
    return out


def test_viterbi_is_the_best_of_all_labellings():
    rnd = np.random.default_rng(1)
    model = random_model(2)
    rows = [rnd.choice([0, 2, 3, 4], (n, 1)).repeat(2, 1) for n in (1, 2, 3, 4, 4, 3)]
    for own, got in zip(rows, pii.viterbi(model, rows), strict=True):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(own)), key=lambda y: total(model, own, y))
        assert tuple(got) == best


def test_likelihood_sums_over_all_labellings_and_its_gradient():
    model = random_model(3)
    names = [[model.number(w) for w in words] for words, _ in TABLE]
    x, size = pii._padded(names)
    y = np.zeros((len(TABLE), int(size.max())), int)
    for i, (_, labels) in enumerate(TABLE):
        y[i, : len(labels)] = [pii.LABELS.index(v) for v in labels]
    weights = (model.near, model.coarse, model.pairs)
    value, gradient = pii.likelihood(weights, x, size, y)
    expected = 0.0
    for row, (words, labels) in zip(names, TABLE, strict=True):
        own = np.array(row)
        every = [total(model, own, p) for p in itertools.product(range(len(pii.LABELS)), repeat=len(words))]
        expected += total(model, own, [pii.LABELS.index(v) for v in labels]) - np.log(np.exp(every).sum())
    assert value == pytest.approx(expected)
    rnd = random.Random(4)
    for w, g in zip(weights, gradient, strict=True):
        for _ in range(40):
            at = tuple(rnd.randrange(n) for n in w.shape)
            w[at] += 1e-5
            up = pii.likelihood(weights, x, size, y)[0]
            w[at] -= 2e-5
            down = pii.likelihood(weights, x, size, y)[0]
            w[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_cut_sequences_are_labelled_as_uncut_ones(model):
    rnd = random.Random(5)
    numbers = [n for words, _ in pii.labelled_table() for n in [model.number(w) for w in words]]
    plain = model.number("word")
    rows = []
    for _ in range(200):
        own = []
        while len(own) < 120:
            own += [plain] * rnd.randrange(40) + [rnd.choice(numbers) for _ in range(rnd.randrange(8))]
        rows.append(np.array(own))
    whole, cut = pii.viterbi(model, rows), pii.viterbi(model, rows, pii.reach(model))
    assert sum(int(a.any()) for a in whole) > 100
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_a_field_that_labels_plain_words_is_refused():
    with pytest.raises(ValueError, match="plain words"):
        pii.train([(["some", "words"], ["B-email", "I-email"]), (["more"], ["B-email"])])


def test_forms_that_training_has_not_seen(model):
    find = pii.Finder(model).find
    for text, expected in [
        ("maria dot lopez at uni dot edu", [("email", "maria dot lopez at uni dot edu")]),
        ("ask kim_p [at] lab [dot] example [dot] org, please", [("email", "kim_p [at] lab [dot] example [dot] org")]),
        ("nodes 172[.]16[.]254[.]1, up", [("ip", "172[.]16[.]254[.]1")]),
        ("x" * 100 + " call 0171 555 0123 soon", [("phone", "0171 555 0123")]),
        # Two cards in a row are one match of the base pattern, which drops it.
        ("paid with 4111111111111111 5555555555554444 there", None),
        ("look at the dot at the end, version 1.2.3 of 12.05.2021", []),
        ("on " + "plain " * 5000 + "at home", []),
    ]:
        _, (got,) = find([text], [True])
        shown = [(pii.KINDS[k], text[s:e]) for s, k, e in got]
        if text.startswith("paid"):
            assert {s for _, s in shown} <= {"4111111111111111", "5555555555554444"} and shown
        else:
            assert shown == expected
    assert find(["", " \n "], [False, False]) == ([[], []], [[], []])


def test_labelled_table_is_independent_of_the_documents():
    documents = pytest.importorskip("pyarrow.parquet")
    try:
        texts = documents.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    except FileNotFoundError:
        pytest.skip("no test tables here")
    held = "\n".join(t for t in texts if t)
    numeric = {w for words, _ in pii.labelled_table() for w in words if sum(c.isdigit() for c in w) >= 6}
    assert numeric and not [w for w in numeric if w in held]


@pytest.mark.parametrize("middle", ["", "verylongname" * 10])
@pytest.mark.parametrize("form", ["carla{m}[at]office[dot]net", "h.moss{m}(at)garden.org", "x_1{m}(at)lake(dot)com", "nora{m}{{at}}hill{{dot}}example{{dot}}org", "ben{m}<at>port.example.com", "PAUL{m}[AT]STONE[DOT]COM"])
def test_joined_forms_are_found_at_any_length(model, form, middle):
    word = form.format(m=middle)
    text = f"please write to {word} before friday"
    (spans,) = pii.Finder(model).field_spans([text])
    assert [(text[s[0] : s[2]], pii.KINDS[s[1]]) for s in spans] == [(word, "email")]


def test_brackets_alone_are_no_address(model):
    texts = ["read item[c] and page(d) of it", "the sum f(a)b(c)d is small", "look(at)this now", "we met(at)noon and left", "x" * 80 + "[at] nothing here"]
    assert pii.Finder(model).field_spans(texts) == [[]] * len(texts)
