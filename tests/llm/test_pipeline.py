"""The pipeline's stages against plain restatements."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tracewright.llm import pipeline  # noqa: E402
from tracewright.functions.tables import written  # noqa: E402


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(3)
    parts = {"en": ["tho", "ing", "wer", "ste", "ough", "nd"], "fr": ["eux", "oir", "ent", "ille", "que", "ais"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(4))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    docs = [(k, "\n".join(text(lang, 12) for _ in range(5)), lang, f"s{k % 3}") for k in range(120) for lang in [("en", "fr")[k % 2]]]
    docs += [(500, docs[0][1], "en", "copy"), (501, None, "en", "x"), (502, "12345 !!!", None, "x"), (503, docs[2][1].replace("\n", " ") + " tail", "en", "near")]
    items = [(k, text("en", 30)) for k in range(8)]
    docs += [(600, docs[4][1].split("\n")[0] + " " + items[3][1] + " " + text("en", 20), "en", "leak")]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    gone = {"language_id": {501, 502}, "line_dedup": {500}, "jaccard_join": {503}, "decontamination": {600}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        assert docs.columns == columns
        ids -= gone[name]
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).join(docs.select("doc_id", F.sha2("text", 256).alias("own")), "doc_id").collect()
    assert len(last) == len(ids) and all(r.decoded_sha256 == r.own and r.n_tokens == len(r.ids) for r in last)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in last}


def test_empty_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = written(stage(spark, none, folder))
    assert pipeline.tokenize(spark, none, folder).count() == 0


def test_near_duplicates_without_ids_and_with_clashing_columns(spark):
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words[:60])
    rows = [(None, text, 1), (None, text + " tail", 2), (7, text, 3), (7, text, 3), (5, text + " end", 4), (None, " ".join(words[100:150]), 5), (None, " ".join(words[100:150]) + " x", 6), (9, "", 7), (9, None, 8), (None, "", 9), (3, "other words here now too", 1), (3, "another text of this id now", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int").withColumns({c: F.lit(1) for c in ("_key", "component_id", "class", "th")})
    for empty in (False, True):
        frame = docs.where("doc_id = -1") if empty else docs
        got = pipeline.dedup_near(spark, frame, "")
        assert got.columns == docs.columns
        if empty:
            assert got.count() == 0
            continue
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert sorted(k for k in kept if k[0] is not None and k[1]) == [(3, "another text of this id now"), (3, "other words here now too"), (5, text + " end")]
        # Of the linked texts without an id one stays, and texts without words stay.
        assert len([k for k in kept if k[0] is None and k[1]]) == 1
        assert sorted((k[0] is None, k[1] is None) for k in kept if not k[1]) == [(False, False), (False, True), (True, False)]


def test_decontamination_keeps_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"_key": F.lit("own"), "_KEY_": F.lit(2), "item_id": F.lit(3)})
    got = pipeline.decontaminate(spark, docs, folder)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r._key for r in rows} == {"own"} and 600 not in {r.doc_id for r in rows} and len(rows) == docs.count() - 1
