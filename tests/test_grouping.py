"""Order-dependent rules against plain restatements, and against shuffled and repartitioned inputs."""

import random

import numpy as np
import pytest

from tracewright.operators import edges, grouping, joins, models, traces
from tracewright.operators.graph import components
from tracewright.sources import readers, sinks
from tracewright.streaming import streams


def test_group_seeds_is_first_fit(spark):
    rnd = random.Random(3)
    rows = [(i, "S", "t", round(rnd.uniform(0, 2), 3), i, 300.0 + rnd.choice([0, 0.002, 0.009, 1]), 184.0, 116.0) for i in range(150)]
    names = ["seed_id", "sample", "tag", "rt", "scan_number", "precursor_mz", "product_mz", "loss_da"]
    groups, expected = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0])):
        fits = [g for g in groups if r[3] - g[-1][3] <= 0.03 and all(abs(r[5] - m[5]) / m[5] * 1e6 <= 20 for m in g)]
        g = fits[0] if fits else groups.append([]) or groups[-1]
        g.append(r)
        expected[r[0]] = g[0][0]
    for parts in (1, 7):
        shuffled = spark.createDataFrame(rnd.sample(rows, len(rows)), names).repartition(parts)
        assert {r.seed_id: r.group_id for r in grouping.group_seeds(shuffled, 0.03, 20.0).collect()} == expected


def test_complete_link_does_not_bridge(spark):
    owners = spark.createDataFrame([(i, f"S{i}", "t", 300.0 + i / 1e4, 5.0, 50) for i in range(4)], "owner_id long, sample string, tag string, precursor_mz double, apex_rt double, evidence_score int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "a long, b long, distance double")
    assert {r.owner_id: r.group_id for r in grouping.complete_link(owners, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_to_one_is_greedy(spark):
    rnd = random.Random(5)
    rows = [(f"a{rnd.randrange(12)}", f"b{rnd.randrange(12)}", rnd.random()) for _ in range(60)]
    rows = list({(a, b): (a, b, s) for a, b, s in rows}.values())
    used, expected = set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            expected.add((a, b))
    got = joins.one_to_one(spark.createDataFrame(rows, "a string, b string, s double"), "a", "b", ["s", "a", "b"])
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_weighted_intervals(spark):
    rows = [(1, 0, 5, 3.0), (1, 4, 9, 4.0), (1, 5, 8, 2.0), (1, 9, 12, 1.0)]
    got = grouping.weighted_intervals(spark.createDataFrame(rows, "trace_id int, left int, right int, score double"), ["trace_id"]).collect()
    assert sorted((r.left, r.right) for r in got) == [(0, 5), (5, 8), (9, 12)]


def test_asls_solves_the_dense_system():
    rnd = np.random.default_rng(1)
    v = rnd.normal(10, 3, 40)
    d = np.diff(np.eye(40), 2, axis=0)
    w = np.ones(40)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 1e3 * d.T @ d, w * v)
        w = np.where(v > z, 0.01, 0.99)
    assert np.allclose(models.asls(v, 1e3), z, atol=1e-7)
    assert list(models.asls(np.array([1.0, 2.0]))) == [1.0, 2.0]


def test_local_maxima_edges(spark):
    rows = [(1, i, i / 20, float(v)) for i, v in enumerate([3, 1, 2, 2, 1, 4])] + [(2, i, i / 20, 5.0) for i in range(3)]
    frame = spark.createDataFrame(rows, "trace_id int, idx int, rt double, intensity double")
    assert sorted((r.trace_id, r.idx) for r in traces.local_maxima(frame).collect()) == [(1, 0), (1, 2), (1, 5), (2, 0)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,mz,rt_min,rt_max,ppm_tol,is_istd,istd_pair\nA,100.5,1,2,20,true,\nB,101,1,3,20,false,A\n")
    assert readers.read_targets(spark, str(tmp_path / "t.csv")).count() == 2
    for bad, what in (("A,100.5,1,2,20,true,\nA,1,1,2,3,true,", "unique"), ("A,1,3,2,20,true,", "window"), ("B,1,1,2,20,false,Z", "standard")):
        (tmp_path / "bad.csv").write_text(f"label,mz,rt_min,rt_max,ppm_tol,is_istd,istd_pair\n{bad}\n")
        with pytest.raises(readers.ContractError, match=what):
            readers.read_targets(spark, str(tmp_path / "bad.csv"))
    table = spark.createDataFrame([(1, "x")], "k int, v string")
    folder = str(tmp_path / "out")
    sinks.publish({"a": table, "b": table}, folder)
    assert sinks.read_published(spark, folder, "a").count() == 1
    runs = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run string, v int")
    log = str(tmp_path / "log")
    assert {r.run: r.appended for r in sinks.append_new_runs(runs, log).collect()} == {"r1": True, "r2": True}
    again = spark.createDataFrame([("r9", 2), ("r9", 1), ("r3", 4)], "run string, v int")
    assert {r.run: r.appended for r in sinks.append_new_runs(again, log).collect()} == {"r9": False, "r3": True}
    assert spark.read.parquet(f"{log}/rows").count() == 4


def test_append_stream_refuses_duplicates(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(2):
        spark.createDataFrame([(f"r{k}", 1), (f"r{k}", 2)], "run string, v int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("run string, v int").option("maxFilesPerTrigger", 10).parquet(source)
        streams.append_stream(stream, log, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{log}/rows").count() == 2


def test_seed_sessions(spark, tmp_path):
    rows = [("S", 1, 1.0, "2024-01-01 00:00:00", 300.0, [(183.9526, 10.0), (50.0, 9.0)]), ("S", 2, 1.1, "2024-01-01 00:00:05", 300.0, [(183.9526, 20.0)]), ("S", 3, 3.0, "2024-01-01 00:10:00", 300.0, [(183.9526, 5.0)])]
    kind = "sample string, scan_number int, rt double, ts string, precursor_mz double, ions array<struct<mz double, intensity double>>"
    spark.createDataFrame(rows, kind).selectExpr("* EXCEPT (ts)", "CAST(ts AS TIMESTAMP) AS ts").write.parquet(str(tmp_path / "in"))
    tags = spark.createDataFrame([("dR", 116.0474)], "tag string, loss_da double")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seeds = streams.seed_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tags, 20.0, 0.5)
    query = streams.seed_sessions(seeds, "30 seconds", "1 minute").writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.top) for r in spark.table("sessions").collect()) == [(1, 5.0), (2, 20.0)]


def test_linked_owners_are_complete_links_of_strong_edges(spark, monkeypatch):
    rnd = random.Random(11)
    some = lambda v: None if rnd.random() < 0.05 else v
    rows = [
        (
            i, some(f"S{rnd.randrange(5)}"), rnd.choice(["a", "b", "b", "", None]), some(rnd.choice([200.0, 200.002, 200.004, 200.004, 300.0, -1.0])), some(rnd.choice([1.0, 1.3, 1.9, 2.0, 2.3, 9.0, float("nan")])),
            some(rnd.choice([100.0, 100.001, 100.002, 100.002, 0.0, -5.0, float("inf")])), some(rnd.choice([116.0474, 116.0478, 116.0482])), some(rnd.choice([10, 60, 61, 90])), some(rnd.randrange(1, 5)), some(rnd.random() < 0.05),
        )
        for i in rnd.sample(range(4000), 900)
    ]
    schema = "owner_id long, sample string, tag string, precursor_mz double, apex_rt double, product_mz double, observed_loss double, evidence_score int, seed_event_count int, identity_conflict boolean"
    owners = spark.createDataFrame(rows, schema)
    strong = edges.owner_edges(owners).where("decision = 'strong_edge'").selectExpr("left_id AS a", "right_id AS b", "rt_sec AS distance")
    expected = {r.owner_id: r.group_id for r in grouping.complete_link(owners, strong).collect()}
    monkeypatch.setattr(edges, "owner_edges", None)
    for parts in (1, 6):
        got = [(r.owner_id, r.group_id) for r in grouping.linked_owners(owners.repartition(parts)).collect()]
        assert len(got) == len(rows) and dict(got) == expected
    assert len(set(expected.values())) < len(rows) - 50


def test_complete_link_query_makes_no_pairs(spark, monkeypatch):
    from types import SimpleNamespace

    from tracewright.plans.registered import groups

    monkeypatch.setattr(edges, "owner_edges", None)
    row = "id AS owner_id, concat('S', id % 3) AS sample, 't' AS tag, 300e0 AS precursor_mz, 5e0 AS apex_rt, 180e0 AS product_mz, 116e0 AS observed_loss, 90 AS evidence_score, 3 AS seed_event_count, false AS identity_conflict"
    got = {r.owner_id: r.group_id for r in groups.grp05(SimpleNamespace(owners=spark.sql(f"SELECT {row} FROM range(9000)"))).collect()}
    assert got == {i: i // 3 * 3 for i in range(9000)}
