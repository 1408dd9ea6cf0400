"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sablewatch.llm import ann


def exact(ids, x, asked, k):
    out = {}
    x = x / np.linalg.norm(x, axis=1)[:, None]
    for q in asked:
        s = x @ x[ids.index(q)]
        out[q] = sorted((-s[i], v) for i, v in enumerate(ids) if v != q)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((600, 16)), rng.standard_normal((4, 16)).repeat(50, 0) + 0.05 * rng.standard_normal((200, 16))])
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, node string")
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want, hits = exact(list(range(800)), x, range(0, 800, 50), 5), 0
    assert set(got) == set(want)
    for q, best in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len({v for _, v in best} & {v for v, _ in got[q].values()})
        scores = [got[q][k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
        for v, s in got[q].values():
            assert abs(s - x[q] @ x[v] / np.linalg.norm(x[q]) / np.linalg.norm(x[v])) < 1e-12
    assert hits >= 0.9 * 5 * len(want)


def test_recall_in_a_tight_group(spark):
    """A third of the rows differ by far less than a hundredth of their largest component."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.standard_normal((800, 16)), rng.standard_normal(16) + 1e-4 * rng.standard_normal((400, 16))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    asked = list(range(800, 1200, 16))
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id >= 800 and vec_id % 16 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(list(range(1200)), x.astype(float), asked, 5)
    assert sum(len({v for _, v in want[q]} & got[q]) for q in asked) >= 0.9 * 5 * len(asked)


def test_walk_goes_on_to_the_end(spark):
    """Along a thin ring of many nodes a walk from pivots on one side needs more than a few steps."""
    n, step = 3000, 2 * np.pi / 3000
    x = np.array([[np.cos(i * step), np.sin(i * step)] for i in range(n)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    nodes = rows.selectExpr("vec_id as node", "embedding as vec")
    units = ann._unit(nodes, 8)
    ring = spark.createDataFrame([(i, (i + d) % n, float(np.cos(d * step))) for i in range(n) for d in (-1, 1)], ann.EDGE)
    pivots = {r.node for r in units.orderBy(F.xxhash64("node"), "node").limit(1).collect()}
    saved = ann.PIVOTS, ann.PIVOTS_A_ROOT, ann.BEAM
    ann.PIVOTS, ann.PIVOTS_A_ROOT, ann.BEAM = 1, 0, 4
    try:
        far = (next(iter(pivots)) + 30) % n
        beam = ann.greedy_search(units.where(F.col("node") == far).withColumnRenamed("node", "q"), ann.Vectors(units), ring)
        assert far in {r.v for r in beam.collect()}
    finally:
        ann.PIVOTS, ann.PIVOTS_A_ROOT, ann.BEAM = saved


def test_joined_and_broadcast_vectors_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 8)))], "vec_id bigint, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0")
    one = {tuple(r) for r in ann.nearest(rows, asked).collect()}
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in ann.nearest(rows, asked).collect()} == one


def test_pairs_meet_once(spark):
    """A later round only tries pairs of which an edge is new."""
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)))], "node bigint, vec array<double>")
    vectors = ann.Vectors(ann._unit(nodes, 8))
    edges = ann._best(ann._first_lists(vectors.units, 0).withColumn("new", F.lit(False)))
    members, _ = ann._members(edges, 0)
    assert ann._proposals(members, edges, vectors).count() == 0
    some = edges.withColumn("new", F.col("u") == 7)
    members, marked = ann._members(some, 0)
    assert marked.where("active").count() == ann.SAMPLE
    around = {r.u for r in members.where("active").collect()}
    assert 7 in around and len(around) <= 1 + ann.SAMPLE


def test_very_large_components_and_other_dimensions(spark):
    data = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, -1.0]), (3, [1.0, 1.0, 1.0]), (4, [5.0]), (5, [2e200, 1e200])]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(rows, rows).collect()}
    assert {i for p in got for i in p} == {0, 1, 2, 5}
    for (q, v), s in got.items():
        a, b = (np.array(data[i][1]) / max(np.abs(data[i][1])) for i in (q, v))
        assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_copies_ties_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [1.0, 0.0]) for i in (0, 9, 8, 7, 6, 5, 4, 3)] + [(50, [0.0, 1.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])]
    bad = [(60, None), (61, [0.0, 0.0]), (62, [nan, 1.0]), (63, [inf, 1.0]), (64, [None, 1.0]), (None, [1.0, 2.0]), (65, [])]
    rows = spark.createDataFrame(data + bad, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(rows, rows.where("vec_id in (0, 50, 60, 61)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, k + 1, v) for k, v in enumerate([3, 4, 5, 6, 7])] + [(50, k + 1, v) for k, v in enumerate([51, 0, 3, 4, 5])]
    none = rows.where("vec_id < 0")
    assert ann.nearest(none, none).count() == 0
    one = rows.where("vec_id = 51")
    assert ann.nearest(one, one).count() == 0


def test_rounds_and_walk_shuffle_packed_ids(spark, monkeypatch):
    """Rounds and steps hand on a few rows of bytes a task instead of a row for each pair, and leave no shuffle files."""
    rng = np.random.default_rng(11)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))], "node bigint, vec array<double>")
    units = ann._unit(nodes, 8)
    edges = ann._best(ann._first_lists(units, 0).withColumn("new", F.lit(True)))
    for vectors in (ann.Vectors(units), ann.Vectors(units, most=0)):
        members, marked = ann._members(edges, 0, vectors.parts)
        assert members.count() > 10 * 600 > 100 * marked.select(F.spark_partition_id()).distinct().count()
        proposed = ann._proposals(members, edges, vectors, packed=True)
        assert proposed.count() <= len(vectors.parts) ** 2 and proposed.agg(F.sum("n")).first()[0] > 600


def test_many_queries_walk_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))], "vec_id bigint, embedding array<double>")
    asked = rows.where("vec_id % 10 = 0")
    one = {tuple(r) for r in ann.nearest(rows, asked).collect()}
    monkeypatch.setattr(ann, "QUERY_BYTES", 1000)  # three turns
    assert len(one) == 200 and {tuple(r) for r in ann.nearest(rows, asked).collect()} == one


def test_parcels_keep_every_row(spark):
    labels = ann._labels(spark, 7)
    assert len(set(labels.tolist())) == 7
    rows = spark.range(1000).selectExpr("id as u", "id * 3 as v", "id / 7 as s", "id % 2 = 0 as new")
    parcels = ann._delivered(ann._packed(rows, labels), labels).withColumn("task", F.spark_partition_id())
    assert parcels.groupBy("part").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    assert parcels.select("task").distinct().count() == 7
    got = ann._opened(parcels.drop("task").toArrow().to_batches(), ("i8", "i8", "f8", "?"))[0]
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(tuple(r) for r in rows.collect())
