"""Secret scans against candidates and features in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sablewatch.llm import secrets


def plain_candidates(text):
    """(candidate, announced, left, right) by a scan from left to right."""
    run = r"(?:[^\W\d_]|[0-9_+/-])"
    found = re.compile(rf"(?<!{run})(?:([A-Za-z][A-Za-z0-9_-]*+[ ]{{0,2}}+[:=][ ]{{0,2}}+[\"']?)([^\s\"']{{8,}}+)|({run}{{16,}}+={{0,2}}))")
    out, matches = [], list(found.finditer(text or ""))
    for k, m in enumerate(matches):
        left = text[matches[k - 1].end() if k else 0:m.start()][-40:]
        right = text[m.end():matches[k + 1].start() if k + 1 < len(matches) else len(text)][:40]
        key, value = m[1] or "", m[2] or m[3]
        told = bool(re.search(f"(?i)({secrets.TELLING})", key))
        values = [value] if told or not key else re.findall(rf"{run}{{16,}}={{0,2}}", value)
        out += [(v, told, left if told or not key else (left + key)[-40:], right) for v in values]
    return out


def plain_shape(c, source, words):
    n, low = len(c), c.lower()
    kinds = ["a" if x.isascii() and x.islower() else "A" if x.isascii() and x.isupper() else "0" if x.isascii() and x.isdigit() else "l" if x.isalpha() else "-" for x in c]
    changes = sum(a != b and not (a == "l") and not (a == "-" and b not in "aA0l") for a, b in zip(kinds, kinds[1:]))
    inside = {i + k for i in range(n) for size in range(3, 9) if low[i:i + size] in words and i + size <= n for k in range(size)}
    return {
        "length": n, "changes": changes / n, "digits": sum(x in "0123456789" for x in c) / n, "capitals": sum(x.isupper() for x in c) / n,
        "hex_only": float(bool(re.fullmatch("[0-9a-fA-F]+", c))), "distinct": len(set(c)) / n, "covered": len(inside) / n,
        "vowels": sum(x in "aeiouAEIOU" for x in c) / n, "path_depth": source.count("/") + 1,
        "test_path": float(bool(re.search("test|example|fixture|sample|mock", source.lower()))),
    }


def rows():
    rng = random.Random(4)
    secret = lambda: "".join(rng.choices("abcdef0123456789", k=24))
    texts = [f"some words password={secret()} and more" for _ in range(40)] + ["an " + "wordlike" * 3 + " here" for _ in range(40)]
    texts += ["key AKIA" + "".join(rng.choices("ABCDEFGHIJ234567", k=16)) + " here" for _ in range(10)]
    texts += [
        None, "", "short", "api_key : \"Zx81!uu,#tail\" x", "url=https://example.com/abcdefghijklmnopqrst/z?q=abcdefghijklmnopqr1234== end", "token=",
        "a=" * 30, "Secret: short7 x", "x" * 5000, "words " * 20000 + "passwd:" + secret(), "Überlangeswortohneende_ÄÖ-9 wordlike", "AUTH='" + secret() + "' password=" + secret(),
        "password=" + "wordlike" * 3,
    ]
    return texts


def test_candidates_and_shapes_like_plain_python(make_docs):
    texts = rows() * 2
    docs = make_docs(texts)
    found = secrets.candidates(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, {})[r.n] = (r.candidate, r.announced, r.left, r.right)
    for i, t in enumerate(texts):
        assert [got.get(i, {})[n] for n in sorted(got.get(i, {}))] == plain_candidates(t), t
    held = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())):
            held[w] = held.get(w, 0) + 1
    words = {w for w, n in held.items() if n >= 2 and 3 <= len(w) <= 8}
    assert {r.word for r in secrets.dictionary(docs, share=0.0).collect()} == words
    for r in secrets.features(found, secrets.dictionary(docs, share=0.0)).collect():
        want = plain_shape(r.candidate, "a/b.txt", words)
        assert {k: r[f"f_{k}"] for k in want} == pytest.approx(want), r.candidate
        assert not any("password" in w for w in r.words_left + r.words_right)


def test_scan(make_docs):
    docs = make_docs(rows())
    got = {}
    for r in secrets.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.candidate)
    # Announced values and providers' keys; not the words, announced or not.
    assert set(range(40)) <= set(got) and not set(range(40, 80)) & set(got) and set(range(80, 90)) <= set(got)
    texts = rows()
    assert all(len(got[i]) == texts[i].count("password=") + texts[i].count("AUTH=") for i in range(90, len(texts)) if "AUTH=" in (texts[i] or ""))
    assert secrets.scan(make_docs([])).count() == secrets.scan(make_docs([None, ""])).count() == 0
    again = secrets.scan(make_docs([(i % 3, t) for i, t in enumerate(texts)] * 2))
    assert again.count() > 0


def test_labels_decide_and_one_class_keeps_the_sure_ones(make_docs):
    docs = make_docs(rows())
    found = secrets.candidates(docs).select("doc_id", "n").withColumn("label", F.col("doc_id").between(40, 79).cast("int"))
    assert {r.doc_id for r in secrets.scan(docs, found).collect()} >= set(range(40, 90))  # providers' keys are certain
    alike = make_docs([f"password={i:020x}" for i in range(30)])
    assert secrets.scan(alike).count() == 30
    assert secrets.scan(make_docs(["an " + "wordlike" * 3] * 9)).count() == 0


def test_held_out_findings(make_docs):
    """Trained on half of the labelled findings, judged on the others, whose keys say nothing."""
    rng = random.Random(9)
    letters, text, truth = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", [], []
    syllables = ["tion", "ber", "lich", "the", "ing", "con", "pre", "ment"]
    for i in range(400):
        secret = rng.random() < 0.3
        value = "".join(rng.choices(letters, k=rng.randrange(18, 40))) if secret else "".join(rng.choices(syllables, k=rng.randrange(5, 9)))
        text.append(f"{' '.join(rng.choices(syllables, k=8))} {value} {' '.join(rng.choices(syllables, k=8))}")
        truth.append(secret)
    docs = make_docs(text)
    labelled = secrets.candidates(docs).where("doc_id < 200").select("doc_id", "n").collect()
    marks = docs.sparkSession.createDataFrame([(r.doc_id, r.n, int(truth[r.doc_id])) for r in labelled], "doc_id long, n int, label int")
    got = {r.doc_id for r in secrets.scan(docs, marks).collect()}
    held = range(200, 400)
    right = sum(truth[i] for i in held if i in got)
    assert right >= 0.95 * sum(truth[i] for i in held) and right >= 0.95 * len(got & set(held))
