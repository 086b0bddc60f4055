"""The fit of op4_decontamination rests on all items and no sample of documents."""

import numpy as np
import pyarrow as pa

from tracewright.llm import decontam


def test_basis_does_not_depend_on_a_sample_of_documents(spark, monkeypatch):
    """What is fitted is every item, whatever the documents are, and a projection keeps each item whole."""
    fitted = []
    plain = decontam.latent_basis

    def basis(rows, n_items, idf, config):
        features, matrix = plain(rows, n_items, idf, config)
        fitted.append(([r.text for r in rows.collect()], features, matrix, idf))
        return features, matrix

    monkeypatch.setattr(decontam, "latent_basis", basis)
    items = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(20))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"d{(k * 5 + j) % 61}" for j in range(40))) for k in range(50)], "doc_id long, text string")
    config = decontam.DecontamConfig()
    decontam.contaminated(docs, items, config).collect()
    (texts, features, matrix, idf), = fitted
    assert sorted(texts) == sorted(r.text for r in items.collect())
    slot = {f: i for i, f in enumerate(features.tolist())}
    for f, w in decontam._sparse_rows(pa.array(texts, pa.string()), idf, config, None):
        projected = (w[:, None] * matrix[[slot[one] for one in f.tolist()]]).sum(0)
        assert abs(float(np.linalg.norm(projected)) - 1) < 1e-2


def test_words_outside_an_item_cost_the_check_next_to_nothing():
    import random
    import time

    def plain(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
            best = row
        return best[-1]

    rnd = random.Random(2)
    for _ in range(60):
        item, found = ([rnd.randrange(12) for _ in range(rnd.randrange(1, 40))] for _ in range(2))
        assert decontam._lcs(decontam._places([x for x in item if x < 9]), found, max(1, sum(x < 9 for x in item))) == plain([x for x in item if x < 9], found)
    item = list(range(20_000))
    places, took = decontam._places(item), []
    for found in (item, [-1 - x for x in item]):
        start = time.process_time()
        decontam._lcs(places, found, len(item))
        took.append(time.process_time() - start)
    assert took[1] * 3 < took[0]


def test_basis_holds_all_documents(spark, monkeypatch):
    """Every document is a row of the fit: what only a few of many documents speak of lies in the joint basis, beside all items."""
    joined = []
    plain = decontam.joint_basis

    def joint(features, items, documents):
        matrix = plain(features, items, documents)
        joined.append((features, items, documents, matrix))
        return matrix

    monkeypatch.setattr(decontam, "joint_basis", joint)
    texts = [" ".join(f"t{k % 20 if k < 4_000 else 20 + k % 5}w{j}" for j in range(9)) for k in range(4_050)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(k, " ".join(f"t{k}w{j}" for j in range(9)) + f" own{k} new{k}") for k in (1, 24)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(k, 1) for k in range(1, 4_000, 20)} | {(k, 24) for k in range(4_004, 4_050, 5)}
    (features, own, documents, matrix), = joined
    idf = decontam.inverse_frequency(docs, "text", decontam.DecontamConfig())
    for f, w in decontam._sparse_rows(pa.array(texts[:20] + texts[-5:], pa.string()), idf, decontam.DecontamConfig(), None):
        assert abs(np.linalg.norm(w @ documents[f]) - 1) < 1e-2
    assert np.allclose(documents.T @ documents, np.eye(documents.shape[1]), atol=1e-3)
    assert matrix.shape[1] == own.shape[1] + documents.shape[1]  # both items hold words that no document has
    assert np.allclose(matrix @ (matrix.T @ own), own, atol=1e-3)


def test_nearly_equal_items_lie_in_the_basis(spark):
    texts = [" ".join(f"c{j}" for j in range(60)) + f" own{k}" for k in range(220)]
    idf = np.ones(1 << 16, np.float32)
    config = decontam.DecontamConfig()
    features, matrix = decontam.latent_basis(spark.createDataFrame([(t, True) for t in texts], "text string, is_item boolean").repartition(3), len(texts), idf, config)
    slot = {f: i for i, f in enumerate(features.tolist())}
    for f, w in decontam._sparse_rows(pa.array(texts, pa.string()), idf, config, None):
        assert abs(np.linalg.norm(w @ matrix[[slot[one] for one in f.tolist()]]) - 1) < 1e-3


def test_long_and_empty_documents_are_rows(spark):
    docs = spark.createDataFrame([("a b a",), (None,), ("",), ("b " * 200_000,)], "text string").coalesce(1)
    rows = [r for batch in decontam.document_rows(docs, "text", 16).toArrow().to_batches() for r in decontam._told(batch, 16)]
    assert sum(int(counts.sum()) for _, counts, _ in rows) == 200_003 and sum(len(ends) for *_, ends in rows) >= 3
    assert all(len(features) == len(counts) == ends[-1] for features, counts, ends in rows)
