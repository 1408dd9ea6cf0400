"""Line dedup, language, fingerprints, near dedup, pseudonyms, secrets and the pipeline."""

import hashlib
import math
import random
import re
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sablewatch.llm import language, lines, near, phrases, pii


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def cleaned(texts, least):
    docs = [(t or "").split("\n") for t in texts]
    held = {}
    for i, own in enumerate(docs):
        for line in own:
            held.setdefault(key(line), set()).add(i)
    gone = {k for k, d in held.items() if k and len(d) >= least}
    return {i: ([x for x in own if key(x) not in gone], len(own)) for i, own in enumerate(docs)}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_lines_like_brute_force(make_docs, odd_texts, broadcast_bytes):
    texts = [*odd_texts, *[f"HEAD {i % 3}\nbody {i}\n  footer \r\nÄpfel" for i in range(12)], *["äpfel\nHead 1"] * 3]
    got = lines.drop_frequent_lines(make_docs(texts), 4, broadcast_bytes)
    expected = cleaned(texts, 4)
    assert got.columns[:-3] == make_docs([]).columns
    for r in got.collect():
        kept, n = expected[r.doc_id]
        assert (r["__kept"], r["__lines"], r["__dropped"]) == ("\n".join(kept), n, n - len(kept))
    assert lines.drop_frequent_lines(make_docs([]), 4, broadcast_bytes).count() == 0


def test_line_index_is_reversible(spark, make_docs):
    base = make_docs([f"common\nown {i}\nrare {i % 3}" for i in range(9)])
    more = make_docs([(100 + i, f"common\nnew {i}\nrare 0") for i in range(5)])
    from sablewatch.session import materialised

    before = materialised(lines.references(base), "t")
    filters = materialised(lines.build_filters(before, 4), "t")
    after = materialised(lines.changed(before, more, 1), "t")
    grown = materialised(lines.update_filters(filters, before, after, 4), "t")
    back = materialised(lines.changed(after, more, -1), "t")
    shrunk = materialised(lines.update_filters(grown, after, back, 4), "t")

    def members(filters):
        probe = lines.Probe([(r.shard, r.buckets, bytes(r.cells)) for r in filters.collect()])
        words = ["common", "rare 0", "rare 1", "own 3", "new 2"]
        return dict(zip(words, probe([lines.digest(w.encode()) for w in words]).tolist()))

    assert members(filters) == {"common": True, "rare 0": False, "rare 1": False, "own 3": False, "new 2": False}
    assert members(grown) == {"common": True, "rare 0": True, "rare 1": False, "own 3": False, "new 2": False}
    assert members(shrunk) == members(filters)
    as_set = lambda df: {(bytes(r.key), r.refs) for r in df.collect()}
    assert as_set(back) == as_set(before)
    assert next(r["__kept"] for r in lines.clean(more, after, grown, 4).collect() if r.doc_id == 100) == "new 0"


def test_cuckoo_filter_grows_and_keeps_its_keys():
    keys = [lines.digest(str(i).encode()) for i in range(500)]
    made = lines._filter_of(keys, 4)
    probe = lines.Probe([(s, made.buckets, made.cells.tobytes()) for s in range(lines.SHARDS)])
    assert probe(keys).all() and not probe([lines.digest(b"other%d" % i) for i in range(500)]).any()
    for k in keys[:250]:
        made.delete(k)
    probe = lines.Probe([(s, made.buckets, made.cells.tobytes()) for s in range(lines.SHARDS)])
    assert not probe(keys[:250]).any() and probe(keys[250:]).all()


def test_suffix_automaton_pieces():
    text, query = "abracadabra", "abrxcadab"
    root, n, i = language.suffix_automaton(text), 0, 0
    while i < len(query):
        j = i + 1
        while j < len(query) and query[i : j + 1] in text:
            j += 1
        n, i = n + 1, j
    assert language.pieces(query, root) == n == 3


def test_language(make_docs, odd_texts):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "vier", "acht"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    train, test = make_docs(rows[:20]), make_docs([*rows[20:], (90, None), (91, "12 34!"), (92, ""), (92, "")])
    sample = language.training_text(train)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(test, sample).collect()]
    assert {(i, p) for i, p, _ in got} == {(i, lang) for i, _, lang in rows[20:]} | {(90, "und"), (91, "und"), (92, "und")}
    assert len(got) == 24 and all(0 <= s <= 1 for _, _, s in got)
    assert language.predict(test, {}).where("lang_pred <> 'und'").count() == 0
    kept = language.stage(test)
    assert kept.columns == test.columns and {r.doc_id for r in kept.collect()} == set(range(20, 40))


def words_of(seed):
    rng = random.Random(seed)
    own = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(own[:100] if rng.random() < 0.6 else own) for _ in range(n))


def plain_predict(text, sample):
    """Longest matches by searching the training text; normalised pieces."""
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " " if text and re.search(r"[^\W\d_]", text) else ""
    if not letters:
        return "und"

    def needed(x, known):
        n = i = 0
        while i < len(x):
            j = i + 1
            while j < len(x) and x[i : j + 1] in known:
                j += 1
            n, i = n + 1, j
        return n

    def own_rate(known):
        words, cost, size = known.split(), 0, 0
        m = max(1, len(words) // 32)
        parts = [" ".join(words[i : i + m]) + " " for i in range(0, len(words), m)]
        for f in range(min(4, len(parts))):
            held = "".join(parts[f::4])
            cost, size = cost + needed(held, "\n".join(p for i, p in enumerate(parts) if i % 4 != f)), size + len(held)
        return cost / size * (1 - 1 / math.sqrt(1 + cost))

    return min((needed(letters, known) / own_rate(known), lang) for lang, known in sample.items())[1]


def test_languages_of_few_texts_and_of_none(make_docs, odd_texts):
    """Languages over one alphabet: one with 150 texts, one with very few; letters at random are in neither."""
    a, b, rng = words_of(1), words_of(2), random.Random(3)
    test = make_docs([(i, x(80), "") for i, x in enumerate([a, b] * 25)])
    for few in (1, 3):
        sample = language.training_text(make_docs([(i, a(70), "a") for i in range(150)] + [(900 + i, b(70), "b") for i in range(few)]))
        got = {r.doc_id: r.lang_pred for r in language.predict(test, sample).collect()}
        assert sum(got[i] == "ab"[i % 2] for i in range(50)) >= 48
    texts = [*odd_texts, *[a(n) for n in (1, 5, 3000)], *[b(n) for n in (2, 9, 40)]]
    got = {r.doc_id: r.lang_pred for r in language.predict(make_docs(texts), sample).collect()}
    assert got == {i: plain_predict(t, sample) for i, t in enumerate(texts)}
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=600)) for _ in range(20)]
    mixed = make_docs([(i, a(60), "a") for i in range(100)] + [(200 + i, b(60), "b") for i in range(100)] + [(400 + i, t, None) for i, t in enumerate(noise)])
    assert {r.doc_id for r in language.stage(mixed).collect()} == {*range(100), *range(200, 300)}


def test_too_many_languages_fail(make_docs, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.training_text(make_docs([(i, "text", f"l{i}") for i in range(3)]))


def test_training_text_of_copies_and_headers(spark):
    """A language of few texts in many copies is learnt whole, and bodies behind one long header."""
    copies = spark.range(60000).select(F.concat(F.lit("copied words "), (F.col("id") % 3 + 7).cast("string"), F.lit(" stay")).alias("text"), F.lit("aa").alias("lang"))
    body = F.concat(F.lit("licence header " * 40), F.expr("repeat(concat('corpo', char(97 + id % 20), ' '), 200)"))
    headed = spark.range(60).select(body.alias("text"), F.lit("bb").alias("lang"))
    got = language.training_text(copies.unionByName(headed))
    assert got["aa"].split("\n") == ["copied words stay "] * 3
    assert got["bb"].count("corpo") > got["bb"].count("header")


def test_fingerprints_like_brute_force(make_docs, odd_texts):
    texts = [*odd_texts, *[f"text number {i} about nothing much" * (1 + i % 4) for i in range(30)]]
    got = {r.doc_id: r for r in phrases.compare_edited(make_docs(texts).repartition(5)).collect()}
    assert len(got) == len(texts)
    order = sorted(got, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1]):
        own, other = texts[i] or "", texts[nxt] or ""
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        r, sig = got[i], lambda t: phrases.both(t, None)[0]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (phrases.fingerprint(own), phrases.fingerprint(edited))
        assert (r.near_edited, r.near_next) == (phrases.likeness(sig(own), sig(edited)), phrases.likeness(sig(own), sig(other)))
    alone = phrases.compare_edited(make_docs([(5, "abcdef")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0
    assert phrases.compare_edited(make_docs([])).count() == 0


def test_likeness_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, (1 << 64) - 1, size=1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    assert abs(phrases.likeness(phrases.signature(a), phrases.signature(b)) - 1 / 3) < 0.15


def sentences(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_near_classes(make_docs):
    rng = random.Random(2)
    base, hot = sentences(rng, 300), sentences(rng, 400)
    near_copies = []
    for i in range(40):
        words = hot.split()
        words[rng.randrange(400)] = f"changed{i}"
        near_copies.append(" ".join(words))
    rows = [
        (1, base), (2, base), (3, base + " one more"), (3, base + " one more"), (4, sentences(rng, 300)), (5, None), (6, ""), (7, "..."),
        (8, "three short words"), (9, "Three short WORDS!"), (10, "three short word"), *[(100 + i, t) for i, t in enumerate(near_copies)],
        (None, base),
    ]
    docs = make_docs(rows)
    classes = {r.doc_id: r.class_doc for r in near.near_classes(docs).collect()}
    expected = {1: 1, 2: 1, 3: 1, None: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10} | {100 + i: 100 for i in range(40)}
    assert classes == expected
    kept = near.stage(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10, 100]
    assert near.stage(make_docs([])).count() == 0


def test_near_words(odd_texts):
    """Words do not depend on the texts beside them, and are those of plain Python."""
    marks = string.punctuation + "«»„“”‘’…–—¿¡"
    for text, got in zip(odd_texts, near.word_hashes(pa.array(odd_texts)), strict=True):
        assert near.word_hashes(pa.array([text], pa.string()))[0].tolist() == got.tolist()
        if "İ" not in (text or ""):  # lower case of one letter is one letter here
            words = [w for w in (w.strip(marks) for w in (text or "").lower().split()) if w]
            assert got.tolist() == [near.word_hashes(pa.array([w]))[0][0] for w in words]
    many = [f"{a}{b}" for a in ("", "a", "ab", "b", "ba", "1", "é") for b in range(3000)]
    assert len(set(near.word_hashes(pa.array([" ".join(many)]))[0].tolist())) == len(set(many))


def test_near_pairs_of_crowded_buckets(make_docs):
    """Texts alike by a common part, far below the threshold, hide pairs that reach it."""
    import numpy as np

    rng = random.Random(6)
    common, texts = sentences(rng, 180), []
    for _ in range(100):
        own = sentences(rng, 18).split()
        edited = own[:-12] + sentences(rng, 12).split()
        texts += [common + " " + " ".join(own), common + " " + " ".join(edited)]
    rng.shuffle(texts)
    words, df = near.word_hashes(pa.array(texts)), np.zeros(1 << near.BUCKET_BITS, np.int64)
    for own in words:
        df[np.unique(near.buckets(near.shingles(own)[0]))] += 1
    idf = near.idf_table(df, len(texts))
    weighed = [near.weights(own, idf) for own in words]
    expected = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near.weighted_jaccard(weighed[i], weighed[j]) >= near.SIMILARITY:
                expected[i] = j
    assert sum(e != i for i, e in enumerate(expected)) == 100
    assert [r.class_doc for r in near.near_classes(make_docs(texts)).orderBy("doc_id").collect()] == expected


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(make_docs):
    values = [
        "4111111111111111", "4111 1111 1111 1111", "+1 (212) 555-0188", "212-555-0188", "10.0.0.254", "2024-02-29", "29.02.2024",
        "02/29/2024", "31/12/1999", "123-45-6789", "Ann.Lee_9@mail.example.com", "a@b.co",
    ]
    plain = ["4111111111111112", "666-45-6789", "2024-02-30", "1850-01-01", "1.2.3.4.5", "version 3.14", "@ home", None, "", "123456"]
    docs = make_docs([*[f"x {v}, then {v} again" for v in values], *plain, "no data " * 5000 + "10.0.0.254"])
    got = [(r.text, r["__found"]) for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    for v, (text, n) in zip(values, got):
        first, second = re.fullmatch(r"x (.*), then (.*) again", text).groups()
        assert n == 2 and first == second != v and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", first))) == re.sub(
            "[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", v))
        ) or "." in v and "@" not in v and n == 2 and first == second != v
    assert luhn(re.sub(r"\D", "", got[0][0].split(",")[0])) and got[0][0].split(",")[0][2:] == re.sub(" ", "", got[1][0].split(",")[0][2:])
    assert [t for t, _ in got[len(values) : -1]] == plain
    assert got[-1][1] == 1 and got[-1][0].startswith("no data ") and got[-1][0].split()[-1] == got[4][0].split()[1][:-1]
    assert pii.stage(docs, "k").columns == docs.columns and pii.stage(make_docs([]), "k").count() == 0
    assert pii.pseudonymise(docs, "k2").first().text != got[0][0]


def test_pseudonyms_are_a_permutation(spark):
    two = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    out = {r[0] for r in two.select(F.expr(pii.digits("d", "'t'", "k"))).collect()}
    assert out == {f"{i:02}" for i in range(100)}
    odd = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert odd.select(F.expr(pii.digits("d", "'t'", "k")).alias("x")).distinct().count() == 1000


def test_all_dates_keep_apart(spark):
    """Every date from 1900 to 2099 in each notation: as many different results, again of that notation."""
    days = spark.range(73_049).select(F.expr("date_add(date'1900-01-01', cast(id as int))").alias("t"))
    forms = {"yyyy-MM-dd": None, "dd.MM.yyyy": None, "MM/dd/yyyy": None, "dd/MM/yyyy": 12}
    values = None
    for form, after in forms.items():
        own = (days.where(F.dayofmonth("t") > after) if after else days).select(F.date_format("t", form).alias("v"), F.lit(form).alias("form"))
        values = own if values is None else values.unionByName(own)
    out = values.select("form", "v", F.expr(pii.pseudonym("v", "k")).alias("x"))
    rows = out.groupBy("form").agg(
        F.count_distinct("v").alias("n"), F.count_distinct("x").alias("different"),
        F.count_if(F.try_to_timestamp("x", F.col("form")).isNull()).alias("broken"), F.count_if(F.col("v") == F.col("x")).alias("same"),
    ).collect()
    assert {r.form: (r.n, r.different, r.broken) for r in rows} == {f: ((44_249 if a else 73_049),) * 2 + (0,) for f, a in forms.items()}
    assert all(r.same < 20 for r in rows)
    # The two readings of strings with slashes share no result.
    assert out.where("form like '%/%'").select("x").distinct().count() == 117_298


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == names and 0 < after.count() <= docs.count()
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_components_of_any_links(spark, monkeypatch):
    import numpy as np

    from sablewatch.session import materialised

    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    written = []
    monkeypatch.setattr(near, "materialised", lambda df, purpose: written.append(purpose) or materialised(df, purpose))

    def least(links):
        root = {n: n for ab in links for n in ab}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return {n: r for n, r in root.items() if n != r}

    def edges(links):
        return spark.createDataFrame(links, "a long, b long")

    assert {r.node: r.root for r in near.components(edges(pairs)).collect()} == least(pairs)
    roots = near.components(edges(pairs[:40]))
    got = near.merged(roots, edges(pairs[40:])).collect()
    assert len(got) == len(least(pairs)) and {r.node: r.root for r in got} == least(pairs)
    # Stars are recognised at once.
    written.clear()
    assert near.components(edges([(1, n) for n in range(2, 30)] + [(40, 41)])).count() == 29 and len(written) == 1
    assert near.components(edges([(1, 2)]).limit(0)).count() == 0
