"""Automaton BPE, token counts and packing against the tokenizers library."""

import hashlib
import struct
import weakref
import zlib

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sablewatch.llm import bpe, packing, token_counts
from sablewatch.llm.automaton import Automaton
from sablewatch.llm.base import per_worker

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def codec():
    with open(WORD, encoding="utf-8") as f:
        return bpe.Codec(f.read()), Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeth '’s\n_²", max_size=60))
def test_automaton_agrees_with_the_library(codec, text):
    own, library = codec
    ids = own.encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids == packed(expected)
    assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


#: Letters and digits of Unicode 16 and 17, marks and a composite newer than the library's NFC, older marks.
NEWER = [
    "\U00013460", "\U00016130", "\U00010d50", "\U00016ea0", "\ua7cb", "\u1c89", "\u1abf", "\u0898",
    "\U00011935\U00011930", "\U00011938", "\u0301", "\u0323", "\u05b0", "\u064b",
]


@pytest.fixture(scope="module")
def byte_encoder():
    with open(BYTE, encoding="utf-8") as f:
        return packing.ByteEncoder(f.read()), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@example(":\U00013460")
@given(st.lists(st.sampled_from([*NEWER, "a", ":", " ", "Σ", "é", "1", "'s"]), max_size=12).map("".join))
def test_characters_on_which_unicode_versions_differ(codec, byte_encoder, text):
    own, library = codec
    expected = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == packed(expected)
    own, library = byte_encoder
    assert own(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_newer_characters_in_a_table(make_docs):
    texts, library = [":\U00013460", "a\U00016130 \U00010d50b", "x\u0323\u1abf\u0345"], Tokenizer.from_file(WORD)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    docs = make_docs(texts)
    assert {r.doc_id: bytes(r.ids) for r in bpe.encode(docs, WORD).collect()} == dict(enumerate(map(packed, expected)))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORD).collect()} == dict(enumerate(map(len, expected)))


def merged(word, merges):
    parts = list(word)
    while True:
        found = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=12), st.text("abc", min_size=1, max_size=14))
def test_automaton_of_random_merges(picks, word):
    tokens, merges = ["a", "b", "c"], []
    for p in picks:
        pair = (tokens[p % len(tokens)], tokens[p // 7 % len(tokens)])
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    vocab = {t: i for i, t in enumerate(tokens)}
    ids = Automaton(vocab, merges).encode_word(word.encode())
    assert [tokens[i] for i in ids] == merged(word, merges)


def test_encode_and_count_odd_texts(make_docs, odd_texts):
    docs, library = make_docs(odd_texts), Tokenizer.from_file(WORD)
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(odd_texts)}
    for r in bpe.encode(docs, WORD).collect():
        assert bytes(r.ids) == packed(expected[r.doc_id]) and r.n_tokens == len(expected[r.doc_id])
        assert r.decoded == library.decode(expected[r.doc_id], skip_special_tokens=False)
    counted = token_counts.count_tokens(docs, WORD).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted} == {
        i: (len((t or "").encode()), len(expected[i]), len(expected[i]) > 2048) for i, t in enumerate(odd_texts)
    }


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(BYTE)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    docs, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length])) == r.ids_crc32
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(ids)
    for i, own in docs.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (n, at)
            at += length
        assert at == len(ids[i]) and (len(own) == 1 or at > capacity)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(map(len, ids.values())) // capacity)


def test_packing_places_every_token_once(make_docs, odd_texts):
    texts = [*odd_texts, *["word " * (n % 300) for n in range(400)]]
    used, bound = check_packing(packing.pack(make_docs(texts).repartition(20), BYTE).collect(), texts, 1024)
    assert used <= bound + 2


def test_packing_of_pieces_that_cannot_share(make_docs):
    texts = ["word " * 600] * 60
    used, _ = check_packing(packing.pack(make_docs(texts).repartition(12), BYTE).collect(), texts, 1024)
    assert used == 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_fills_bins(sizes):
    bins = packing.best_fit(sizes, 50)
    fill = {}
    for b, s in zip(bins, sizes):
        fill[b] = fill.get(b, 0) + s
    assert all(f <= 50 for f in fill.values())
    assert len(fill) <= max(1, 11 / 9 * -(-sum(sizes) // 50) + 3 + sum(s > 25 for s in sizes)) if sizes else not fill


def test_empty_tables(make_docs):
    none = make_docs([])
    assert bpe.encode(none, WORD).count() == token_counts.count_tokens(none, WORD).count() == packing.pack(none, BYTE).count() == 0


def test_digest_of_ids_is_that_of_the_bytes(make_docs):
    from pyspark.sql import functions as F

    row = bpe.encode(make_docs(["hello world"]), WORD).select(F.sha2("ids", 256).alias("h"), "ids").first()
    assert row.h == hashlib.sha256(bytes(row.ids)).hexdigest()


class Model:
    pass


def test_a_worker_holds_the_last_value_only():
    kept = per_worker("first operator", 1, Model)
    assert per_worker("first operator", 1, Model) is kept
    gone = weakref.ref(kept)
    del kept
    per_worker("second operator", 1, Model)
    assert gone() is None


def test_ids_kept_by_a_worker_are_bounded(byte_encoder, monkeypatch):
    own, library = byte_encoder
    monkeypatch.setattr(packing, "WORD_CACHE", 20)
    own.words.clear()
    long = "ab" * 5000
    for text in (long, " ".join(f"word{chr(97 + i % 26) * i}" for i in range(200)), long):
        assert own(text) == packed(library.encode(text, add_special_tokens=False).ids)
        assert len(own.words) <= 20 and all(len(w) <= packing.CACHED_CHARS for w in own.words)
