"""Quality scores against a plain version, and accuracy on held-out documents."""

import math
import zlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from sablewatch.llm import ftrl, queries


def plain_features(text):
    tokens = ftrl._TOKEN.findall(text or "")
    word = [zlib.crc32(t.lower().encode()) for t in tokens]
    shape = [zlib.crc32(ftrl._shape(t).encode(), 7) for t in tokens]
    shape = [s + (i > 0 and word[i] == word[i - 1]) for i, s in enumerate(shape)]
    step, mix, full = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
    grams = [(w, 1) for w in word] + [(a * step + b, 2) for a, b in zip(word, word[1:])] + [(s, 3) for s in shape]
    grams += [(a * step + b, 4) for a, b in zip(shape, shape[1:])] + [((a * step + b) * step + c, 5) for a, b, c in zip(shape, shape[1:], shape[2:])]
    out = {}
    for h, kind in grams:
        h = (h + kind) * step & full
        h = (h ^ (h >> 29)) * mix & full
        h = (h >> 40) % ftrl.FEATURES
        out[h] = out.get(h, 0) + 1
    size = math.sqrt(sum(v * v for v in out.values()))
    return {h: v / size for h, v in out.items()}


def plain_model(shards, passes):
    """Dictionaries instead of arrays: z and n by feature, None for the constant."""
    z, n = {}, {}

    def weight(z, n, h, l1):
        v = z.get(h, 0.0)
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((ftrl.BETA + math.sqrt(n.get(h, 0.0))) / ftrl.ALPHA + ftrl.L2)

    def guess(z, n, x):
        s = weight(z, n, None, 0.0) + sum(weight(z, n, h, ftrl.L1) * v for h, v in x.items())
        return 1 / (1 + math.exp(-s))

    for _ in range(passes):
        changes = []
        for rows in shards:
            own_z, own_n = dict(z), dict(n)
            for x, y in rows:
                wrong = guess(own_z, own_n, x) - y
                old = [(h, v, weight(own_z, own_n, h, 0.0 if h is None else ftrl.L1)) for h, v in [*x.items(), (None, 1.0)]]
                for h, v, w in old:
                    g, before = wrong * v, own_n.get(h, 0.0)
                    own_n[h] = before + g * g
                    own_z[h] = own_z.get(h, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / ftrl.ALPHA * w
            changes.append((own_z, own_n))
        for state, k in ((z, 0), (n, 1)):
            for h in {h for c in changes for h in c[k]}:
                base = state.get(h, 0.0)
                state[h] = base + sum(c[k].get(h, base) - base for c in changes) / len(shards)
    return lambda x: guess(z, n, x)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


def test_scores_against_the_plain_version(spark, make_docs, odd_texts):
    texts = [*odd_texts, *[f"good words of text {i}, told well." for i in range(20)], *[f"BAD!! {i} BAD!! ###" for i in range(15)]]
    docs = make_docs([(i, t, "en") for i, t in enumerate(texts)] * 2)
    marks = {i: int(not (t or "").startswith("BAD")) for i, t in enumerate(texts) if i % 5}
    marked = labels(spark, [*marks.items(), (1, None), (2, 7), (9999, 1), (None, 0)])
    sample, share = ftrl.labelled_sample(docs, marked)
    assert share == {0: 1.0, 1: 1.0}
    picked = sample.select("at", "label", "text", F.pmod(F.xxhash64(F.lit(1), "at"), F.lit(3)).alias("shard")).orderBy("at").collect()
    assert sorted((r.text, r.label) for r in picked) == sorted({(texts[i] or "", y) for i, y in marks.items()})
    shards = [[(plain_features(r.text), r.label) for r in picked if r.shard == s] for s in range(3)]
    guess = plain_model(shards, 2)
    got = ftrl.score(docs, ftrl.train(sample, share, shards=3, passes=2)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.score == pytest.approx(guess(plain_features(texts[r.doc_id])), abs=1e-9)
        assert r.predicted == (r.score >= ftrl.GOOD)


def test_bounded_sample_keeps_the_classes_shares(spark, make_docs):
    docs = make_docs([(i, f"text {i} {'good' if i % 4 else 'bad'}", "en") for i in range(2000)])
    marked = labels(spark, [(i, int(i % 4 > 0)) for i in range(2000)])
    sample, share = ftrl.labelled_sample(docs, marked, each=100)
    assert share == {0: 0.2, 1: pytest.approx(100 / 1500)}
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert 60 < n[0] < 140 and 60 < n[1] < 140
    whole = ftrl.train(*ftrl.labelled_sample(docs, marked))
    part = ftrl.train(sample, share)
    for model in (whole, part):
        r = {x.doc_id: x for x in ftrl.score(docs, model).collect()}
        assert all(r[i].predicted == int(i % 4 > 0) for i in range(2000))


def test_shards_learn_side_by_side_and_one_state_reaches_the_driver(spark, make_docs, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    docs = make_docs([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**7, 8_000)), "en") for i in range(64)])
    sample, share = ftrl.labelled_sample(docs, labels(spark, [(i, i % 2) for i in range(64)]))
    frame, sizes = type(docs), []
    collect = frame.collect

    class Seen(ftrl.Learner):
        def __init__(self, z, n):
            super().__init__(z, n)
            (tmp_path / str(TaskContext.get().partitionId())).touch()

    def measured(self):
        rows = collect(self)
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(ftrl, "Learner", Seen)
    monkeypatch.setattr(frame, "collect", measured)
    ftrl.train(sample, share, shards=8, passes=1)
    assert len(list(tmp_path.iterdir())) == 8
    assert 0 < max(sizes) <= 16 * (ftrl.FEATURES + 1)


def test_one_class_none_and_no_rows(spark, make_docs):
    docs = make_docs(["one", "two", None])
    for marks, want in (([(0, 1), (1, 1)], 0.99), ([(0, 0)], 0.01), ([], 0.5)):
        got = ftrl.score(docs, ftrl.train(*ftrl.labelled_sample(docs, labels(spark, marks)))).collect()
        assert [r.score for r in got] == [pytest.approx(want)] * 3
    none = docs.where(F.lit(False))
    assert ftrl.score(none, ftrl.train(*ftrl.labelled_sample(none, labels(spark, [(0, 1)])))).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_ftrl_quality(spark, sf)
    marked = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(marked, "doc_id").collect()
    good, bad = [np.array([r.score for r in rows if r.quality == q]) for q in (1, 0)]
    assert len(bad) > 50 and (good[:, None] > bad).mean() > 0.99
    assert (good >= ftrl.GOOD).mean() > 0.99 and (bad < ftrl.GOOD).mean() > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
