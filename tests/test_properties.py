"""Operators against brute force on small random data, hot groups included."""

import bisect
import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sablewatch.fixtures.views import view
from sablewatch.operators import analytics, cases, casetext, enrich, graph, similarity

BASE = dt.datetime(2024, 1, 1)


def random_alerts(n, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0  # a third of all rows share most fields
        def field(name, size):
            return None if rnd.random() < 0.1 else "" if rnd.random() < 0.05 else f"{name}{0 if hot else rnd.randrange(size)}"
        title = " ".join(rnd.sample(["Suspicious", "activity:", "cmd", "powershell", "x", "y"], rnd.randrange(0, 5)))
        rows.append((f"a{i:04d}", field("h", 3), field("r", 2), field("s", 3), field("d", 3), field("o", 2), title))
    return rows


def score(a, b):
    total = 0
    for i, weight in ((1, 30), (2, 20), (3, 15), (4, 15), (5, 10)):
        if a[i] and a[i] == b[i]:
            total += weight
    x, y = set(a[6].lower().split()), set(b[6].lower().split())
    if x and y:
        total += 10 * len(x & y) / len(x | y)
    return round(total, 6)


SCHEMA = "alert_id string, process_hash string, detection_rule string, source_ip string, destination_ip string, hostname string, title string"


def test_related_counts_against_all_pairs(spark):
    rows = random_alerts(240)
    rows[0] = (*rows[0][:6], "activity: cmd one two three four five six seven eight nine")  # long, so listed under many tokens
    expected = {}
    for a in rows:
        scores = [score(a, b) for b in rows if b is not a]
        same = [b[0] for b in rows if b is a or score(a, b) >= 92]
        expected[a[0]] = (min(same), sum(s >= 92 for s in scores), sum(70 <= s < 92 for s in scores), len(rows) - 1)
    counts = similarity.related_counts(spark.createDataFrame(rows, SCHEMA))
    assert {r.alert_id: (r.cluster, r.duplicates, r.related, r.total_compared) for r in counts.collect()} == expected


def near_by_hand(group):
    out = {}
    for t, _, _ in group:
        a, half, fifth, ids = set(t.split()), 0, 0, []
        for u, n, first in group:
            b = set(u.split())
            shared, union = len(a & b), len(a | b)
            if 5 * shared >= union:
                ids.append(first)
                fifth += n * (u != t)
            half += n * (u != t and 2 * shared >= union)
        out[t] = (half, fifth, min(ids))
    return out


def titles_of(spark, groups):
    rows = [(combo, "k", t.replace(" ", similarity._SEP), n, first, t.split()) for combo, group in groups.items() for t, n, first in group]
    return spark.createDataFrame(rows, "combo string, key string, title string, n_title long, first_id string, tokens array<string>")


def test_titles_counted_without_pairs(spark):
    """Short and long titles, subsets of each other, some tokens in nearly all: sums equal all pairs."""
    rnd = random.Random(8)
    groups = {}
    for combo in ("hrsdo", "hrs"):
        seen = set()
        while len(seen) < 160:
            size = rnd.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20])
            seen.add(" ".join(sorted({"t0" if rnd.random() < 0.3 else f"t{int(rnd.paretovariate(0.6)) % 60}" for _ in range(size)})))
        groups[combo] = [(t, rnd.randrange(1, 4), f"a{rnd.randrange(10**6):06d}") for t in sorted(seen)]
    got = {}
    for r in similarity._near_titles(titles_of(spark, groups)).collect():
        got[r.combo, r.title.replace(similarity._SEP, " ")] = (r.n_half, r.n_fifth, r.near_id)
    for combo, group in groups.items():
        for t, (half, fifth, near) in near_by_hand(group).items():
            row = got.get((combo, t), (0, 0, None))
            assert row[0] == half
            if combo == "hrsdo":
                first = next(f for u, _, f in group if u == t)
                assert row[1] == fifth and min(first, row[2] or first) == near


def test_one_token_shared_by_all_titles_of_a_group(spark):
    """Each of 100,000 titles is a fifth like all others; no pair is ever made."""
    n = 100_000
    ids = spark.range(n)
    titles = ids.select(
        F.lit("hrsdo").alias("combo"), F.lit("k").alias("key"), F.concat(F.lit("hot" + similarity._SEP), F.col("id")).alias("title"), F.lit(1).cast("long").alias("n_title"),
        F.lpad(F.col("id").cast("string"), 9, "0").alias("first_id"), F.array(F.lit("hot"), F.col("id").cast("string")).alias("tokens"),
    )
    out = similarity._near_titles(titles).agg(F.count(F.lit(1)), F.min("n_fifth"), F.max("n_fifth"), F.max("n_half"), F.max("near_id")).first()
    assert tuple(out) == (n, n - 1, n - 1, 0, "000000000")


def test_similar_to_against_all_pairs(spark):
    rows = random_alerts(150, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    queries = rows[:20]
    got = {(r.query_id, r.alert_id): (round(r.similarity * 100, 4), r.kind) for r in similarity.similar_to(spark.createDataFrame(queries, SCHEMA), df).collect()}
    expected = {}
    for a in queries:
        for b in rows:
            if a is not b and score(a, b) >= 70:
                expected[a[0], b[0]] = (round(score(a, b), 4), "duplicate" if score(a, b) >= 92 else "related")
    assert got.keys() == expected.keys()
    for pair, (value, kind) in expected.items():
        assert abs(got[pair][0] - value) < 1e-3 and got[pair][1] == kind


def test_anchored_groups_hold_every_pair_decided_by_equality(spark):
    rows = random_alerts(120, seed=5)
    members = defaultdict(set)
    for r in similarity.anchored_scores(spark.createDataFrame(rows, SCHEMA)).collect():
        members[r.combo, r.anchor_id] |= {r.anchor_id, r.alert_id}
        assert r.similarity >= 0.7
    profile = {}
    for r in rows:
        key = tuple(x or None for x in r[1:6]) + (tuple(sorted(set(r[6].lower().split()))),)
        profile.setdefault(key, r)
    reps = list(profile.values())
    for i, a in enumerate(reps):
        for b in reps[:i]:
            same_title = set(a[6].lower().split()) == set(b[6].lower().split())
            base = score((0, *a[1:6], ""), (0, *b[1:6], ""))
            if base >= 70 or (base >= 60 and same_title and a[6].strip()):
                assert any({a[0], b[0]} <= group for group in members.values()), (a, b)


def sent_by_brute_force(rows, minutes=15):
    gap, last, sent = dt.timedelta(minutes=minutes), {}, set()
    for key, at, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            sent.add((key, ident))
    return sent


def cooldown_rows(n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randrange(20)}", BASE + dt.timedelta(seconds=rnd.randrange(3 * 86400)), f"i{i:05d}") for i in range(n)]
    return rows + [("edge", BASE, "e0"), ("edge", BASE + dt.timedelta(minutes=15), "e1"), ("edge", BASE + dt.timedelta(minutes=30, microseconds=-1), "e2"), ("edge", BASE, "e00")]


def test_cooldown_against_brute_force(spark):
    rows = cooldown_rows()
    df = spark.createDataFrame(rows, "key string, at timestamp, id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # groups span many batches
    try:
        for fan_out in (2, 5, 64):
            got = {(r["key"], r["id"]) for r in analytics.cooldown(df, F.col("key"), "at", "id", fan_out=fan_out).collect()}
            assert got == sent_by_brute_force(rows), fan_out
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    odd = spark.createDataFrame([(None, BASE, "x"), ("k", None, "y"), ("", BASE, "z"), ("", BASE, None)], df.schema)
    assert [(r["key"], r["id"]) for r in analytics.cooldown(odd, F.col("key"), "at", "id").collect()] == [("", "z")]
    assert analytics.cooldown(odd.where("key = 'k'"), F.col("key"), "at", "id").count() == 0


def test_cooldown_of_one_hot_key_stays_in_steps(spark):
    """A key with nearly all alerts: stretches keep a few steps, and every level has many groups."""
    rnd = random.Random(4)
    gap, times = 15 * 60_000_000, sorted(rnd.randrange(9 * 86_400_000_000) for _ in range(60_000))
    steps = analytics._Steps(0, gap)
    for i in range(0, len(times), 997):
        chunk = np.array(times[i:i + 997], np.int64)
        steps.see(chunk, chunk)
        assert len(steps.upto) <= 1 + sum(t < gap for t in times)
    assert len(steps.upto) < 5  # chains from all entries have met
    last, ready = None, -1
    for t in times:
        if t >= ready:
            last, ready = t, t + gap
    assert steps.last[0] == last
    rows = [("hot", BASE + dt.timedelta(microseconds=t), str(t)) for t in times[:6000]] + [("k", BASE, "0")]
    df = spark.createDataFrame(rows, "key string, at timestamp, id string")
    assert {(r["key"], r["id"]) for r in analytics.cooldown(df, F.col("key"), "at", "id", fan_out=4).collect()} == sent_by_brute_force(rows)


def test_anomalies_against_running_moments(spark):
    rnd = random.Random(2)
    rows = [("flat" if i % 5 == 0 else "m", BASE + dt.timedelta(minutes=37 * i), i, 1e6 if i % 5 == 0 else round(1e6 + rnd.gauss(0, 1) + (50 if i == 77 else 0), 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "metric string, observed_at timestamp, seq long, value double")
    got = {r.seq: r for r in analytics.anomalies(df, slice_seconds=7200).collect()}
    got24 = {r.seq: r for r in analytics.anomalies_in_window(df, hours=5).collect()}
    for name in ("flat", "m"):
        series = [r for r in rows if r[0] == name]
        for i, (_, at, seq, value) in enumerate(series):
            prior = [r[3] for r in series[:i]]
            near = [r[3] for r in series[:i] if int((at - r[1]).total_seconds()) <= 5 * 3600]
            for seen, row in ((prior, got[seq]), (near, got24[seq])):
                assert row.n == len(seen)
                if not seen:
                    assert row.reason == "no_baseline"
                    continue
                std = float(np.std(seen, ddof=1)) if len(seen) > 1 else 0.0
                if std == 0:
                    assert row.reason == "zero_variance" and row.is_anomaly == (value != seen[0])
                else:
                    assert math.isclose(row.std, std, rel_tol=1e-6)
                    assert row.is_anomaly == (abs(value - np.mean(seen)) / std > 2.1)


def test_frames_of_one_hot_metric(spark):
    """Nine tenths of the rows in one metric and many in one second: groups hold seconds, not rows."""
    rnd = random.Random(6)
    seconds = sorted({rnd.randrange(40 * 3600) for _ in range(700)})
    rows = [("hot" if rnd.random() < 0.9 else "m", BASE + dt.timedelta(seconds=rnd.choice(seconds), milliseconds=rnd.randrange(1000)), i, float(rnd.randrange(5))) for i in range(3000)]
    rows += [("hot", BASE + dt.timedelta(hours=3, milliseconds=i % 1000), 3000 + i, 2.0) for i in range(3000)]
    rows += [("hot", BASE + dt.timedelta(hours=3 + h), 6000 + h, v) for h, v in ((1, None), (2, float("nan")), (24, 1.0))]
    df = spark.createDataFrame(rows, "metric string, observed_at timestamp, seq long, value double")
    entries = analytics._edge_entries(analytics._cells(analytics._numbers_only(df)), 24)
    assert entries.groupBy("metric", "at").count().agg(F.max("count")).first()[0] <= 2 * len(seconds) // 10
    for hours in (1, 2, 24):
        got = {r.seq: r for r in analytics.anomalies_in_window(df, hours=hours).collect()}
        assert len(got) == len(rows)
        by = defaultdict(list)
        for metric, at, seq, value in rows:
            sec = int((at - BASE).total_seconds())
            by[metric].append((sec, seq, value if value is not None and value == value else None))
        for own in by.values():
            own.sort()
            at = np.array([r[0] for r in own])
            for sec, seq, _ in own[::7]:
                lo, hi = np.searchsorted(at, [sec - hours * 3600, sec])
                near = [r[2] for r in own[lo:hi] if r[2] is not None]
                assert got[seq].n == len(near)
                if len(near) > 1:
                    assert math.isclose(got[seq].mean, np.mean(near), abs_tol=1e-9) and math.isclose(got[seq].std, np.std(near, ddof=1), abs_tol=1e-9)


def test_nearest_cases_both_ways_equal_brute_force(spark, sf):
    stored = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("case_id"), "embedding")
    data = {r.case_id: np.array(r.embedding, dtype="float64") for r in stored.collect()}
    queries = stored.filter("case_id % 50 = 0").withColumnRenamed("case_id", "query_id")
    for metric in ("l2", "cosine"):
        expected = {}
        for q in (i for i in data if i % 50 == 0):
            def distance(v, a=data[q]):
                return 1 - a @ v / np.linalg.norm(a) / np.linalg.norm(v) if metric == "cosine" else np.sqrt(((a - v) ** 2).sum())
            expected[q] = [i for _, i in sorted((distance(v), i) for i, v in data.items())[:4]]
        for limit in (100, 3):
            found = defaultdict(list)
            for r in cases.nearest_cases(stored, queries, k=4, metric=metric, max_queries=limit).orderBy("query_id", "rank").collect():
                found[r.query_id].append(r.case_id)
            assert {q: ids[1:] for q, ids in found.items()} == {q: ids[1:] for q, ids in expected.items()}


def text_scores(stored, asked):
    """All pairs by hand: {query: [(-score, case)]}."""
    words = {t: re.findall(r"[^\W_]+", t.lower()) for _, t in stored + asked if t is not None}
    df = Counter(w for _, t in stored if t is not None for w in set(words[t]))
    total = sum(t is not None for _, t in stored)

    def vector(t):
        v = {w: (1 + math.log(n)) * (math.log((1 + total) / (1 + df[w])) + 1) for w, n in Counter(words[t]).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {t: vector(t) for t in words}
    out = {}
    for q, t in asked:
        scores = [] if t is None else [(-round(sum(x * vectors[c].get(w, 0) for w, x in vectors[t].items()), 9), i) for i, c in stored if c is not None]
        out[q] = sorted(s for s in scores if s[0] < 0)
    return out


def test_cases_by_text_against_all_pairs(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 25))) for _ in range(400)]
    stored = [(i, rnd.choice(texts[:250])) for i in range(600)] + [(600 + i, "Hot text, same for a third") for i in range(300)]
    stored += [(900, None), (901, ""), (902, " .,! "), (903, "long " * 20000 + "tail"), (904, "é Ünïted 日本")]
    asked = [(i, t) for i, t in enumerate(texts[150:])] + [(1000, None), (1001, ""), (1002, "unheard-of"), (1003, "hot HOT text"), (1004, "ünïted tail")] * 2
    cases_df = spark.createDataFrame(stored, "case_id long, text string")
    index = casetext.CaseIndex(cases_df, k=3)
    got = defaultdict(list)
    for r in index.search(spark.createDataFrame(asked, "query_id long, text string")).collect():
        got[r.query_id].append((r["rank"], -r.score, r.case_id))
    expected = text_scores(stored, asked)
    for q, best in expected.items():
        copies = 2 if q >= 1000 else 1
        assert sorted(got.get(q, [])) == sorted([(k + 1, *s) for k, s in enumerate(best[:3])] * copies), q
    # Most of the pairs that share a word are left out.
    plain = spark.createDataFrame([(q, t) for q, t in asked if t], "query_id long, text string")
    weights = casetext._weighed(casetext._words(casetext._classes(plain, F.col("text"))), index.frequencies, index.cases).withColumnRenamed("cls", "q")
    floor = weights.select("q").distinct().withColumn("floor", F.lit(0.8))
    sharing = weights.join(index.postings.select("word", "cls"), "word").select("q", "cls").distinct().count()
    assert index._partial(weights, floor).count() < sharing / 2
    none = cases_df.where("case_id < 0")
    assert casetext.top_cases_by_text(none, plain).count() == 0
    assert index.search(plain.where("query_id < 0")).count() == 0


def test_case_append_keeps_first_or_latest(spark):
    schema = "case_id string, content string, stored_at int"
    corpus = spark.createDataFrame([("a", "old", 1)], schema)
    new = spark.createDataFrame([("a", "new", 2), ("b", "two", 3), ("b", "one", 2)], schema)
    assert {r.case_id: r.content for r in cases.append_cases(corpus, new).collect()} == {"a": "old", "b": "one"}
    assert {r.case_id: r.content for r in cases.append_cases(corpus, new, keep="latest").collect()} == {"a": "new", "b": "two"}


def test_edges_need_both_ends(spark):
    nodes = spark.createDataFrame([("User", "u"), ("Asset", "a")], "node_type string, node_id string")
    schema = "src_type string, src_id string, rel string, dst_type string, dst_id string, prop string, val string, written_at int, seq int"
    writes = spark.createDataFrame([("User", "u", "ACCESSED", "Asset", "a", "p", "1", 1, 1), ("User", "u", "ACCESSED", "Asset", "a", "p", "2", 2, 1), ("User", "u", "ACCESSED", "Asset", "gone", "p", "1", 1, 1)], schema)
    rows = graph.upsert_edges(writes, nodes).collect()
    assert [(r.dst_id, r.props) for r in rows] == [("a", {"p": "2"})]


def test_enrichment_keeps_every_event(spark, sf):
    events = view(spark, sf, "sec_events")
    steps = enrich.default_enrichment(view(spark, sf, "assets"), view(spark, sf, "users"), view(spark, sf, "geo_ranges"))
    out = steps.apply(events).select("event_id")
    assert out.count() == events.count() == out.distinct().count()
    assets = view(spark, sf, "assets")
    assert enrich.unenriched(events, assets).count() + enrich.enriched_only(events, assets).count() == events.count()


def test_flattened_ranges_against_every_address(spark):
    """Nested, crossing, equal, repeated and broken ranges; a third of them share one block."""
    rnd = random.Random(12)
    base, rows = 185 << 24, [(0, (1 << 32) - 1, "all"), (5, 4, "broken"), (None, 9, "broken"), (-9, -1, "below"), (1 << 33, 1 << 34, "above"), (-5, 70_000, "low"), ((1 << 32) - 9, (1 << 32) + 99, "high")]
    for i in range(250):
        start = base + rnd.randrange(3 * 65536) if i % 3 else base + rnd.randrange(300)
        rows.append((start, start + int(rnd.paretovariate(0.5)) % 150_000, f"g{rnd.randrange(40)}"))
    rows += rows[-30:] + [(*r[:2], "other") for r in rows[-20:]]
    ranges = spark.createDataFrame(rows, "start_ip long, end_ip long, country string")
    flat = sorted((r.lo, r.hi, r.geo.country) for r in enrich.disjoint_ranges(ranges).where(F.col("block").between(base >> 16, (base >> 16) + 5)).collect())
    assert all(a[1] < b[0] for a, b in zip(flat, flat[1:])) and flat[0][0] == base and flat[-1][1] == base + 6 * 65536 - 1
    starts = [f[0] for f in flat]
    for n in [base + rnd.randrange(6 * 65536) for _ in range(2000)] + [base, base + 65535, base + 65536]:
        best = min((e - s, s, c) for s, e, c in rows if s is not None and s <= n <= e)
        lo, hi, country = flat[bisect.bisect_right(starts, n) - 1]
        assert lo <= n <= hi and country == best[2]
    edge = {r.lo: r.geo.country for r in enrich.disjoint_ranges(ranges).where("block in (0, 1, 65535)").collect()}
    assert edge[0] == "low" and edge[70_001] == "all" and edge[(1 << 32) - 9] == "high"


def test_both_geo_lookups_agree(spark, sf):
    events = view(spark, sf, "sec_events").select("event_id", "source_ip", "destination_ip")
    ranges = view(spark, sf, "geo_ranges").unionByName(
        spark.createDataFrame([(134744064, 134744319, "narrow", "AS0")], "start_ip long, end_ip long, country string, asn string")
    )
    one, other = enrich.with_geo(events, ranges).select(events.columns + ["source_ip_geo", "destination_ip_geo"]), enrich.with_geo_by_block(events, ranges)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_feed_agrees_with_built_in_rules(spark, sf):
    events = view(spark, sf, "sec_events")
    feed = enrich.built_in_feed(spark)
    out = enrich.with_feed(events, feed, {"ip": ["source_ip", "destination_ip"], "hash": ["process_hash", "file_hash"]})
    wrong = F.lit(False)
    for name, rule in (("source_ip", enrich.bad_ip), ("destination_ip", enrich.bad_ip), ("process_hash", enrich.bad_hash), ("file_hash", enrich.bad_hash)):
        wrong = wrong | (F.col(f"{name}_hit").isNotNull() != rule(F.col(name)))
    assert out.filter(wrong).count() == 0
