"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import json
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import per_worker, slices, texts_of
from sablewatch.llm.pretokens import Cutter, byte_symbols

#: Documents (in expectation) whose pre-tokens fill the broadcast table, its entries, and the
#: entries one task may offer for it. They bound the table; counts do not depend on them.
SAMPLE_DOCS, TABLE_WORDS, TASK_WORDS = 1_000, 50_000, 2_000
#: Lengths a worker keeps besides the table before it forgets them.
WORKER_WORDS = 500_000

COUNTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])


class Lengths(dict):
    """Pre-token -> number of tokens. The broadcast table first, then what misses added."""

    def __init__(self, frequent: dict[str, int], encode) -> None:
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.frequent) + WORKER_WORDS:
            self.clear()
            self.update(self.frequent)
        n = self[word] = self.encode(word)
        return n


def _encoder(tokenizer_json: str):
    """The library's own model on one pre-token -> number of tokens."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    shown = dict(enumerate(byte_symbols()))
    return lambda word: len(model.tokenize(word.encode().decode("latin-1").translate(shown)))


def _cutter(tokenizer_json: str) -> Cutter:
    added = json.loads(tokenizer_json).get("added_tokens", [])
    return Cutter(True, {t["content"]: t["id"] for t in added}, tokenizer_json)


def frequent_lengths(docs: DataFrame, tokenizer_json: str) -> dict[str, int]:
    """The most frequent pre-tokens of a random sample of documents, with their lengths."""
    total = docs.count()
    if not total:
        return {}

    def run(batches):
        cutter, seen = _cutter(tokenizer_json), Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                for _, words in cutter.chunks(text):
                    seen.update(words)
            if len(seen) > WORKER_WORDS:
                seen = Counter(dict(seen.most_common(TASK_WORDS)))
        top = seen.most_common(TASK_WORDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE_DOCS / total), seed=7)
    seen: Counter = Counter()
    for row in sample.mapInArrow(run, "word string, n bigint").toLocalIterator():
        seen[row.word] += row.n
        if len(seen) > 4 * TABLE_WORDS:
            seen = Counter(dict(seen.most_common(TABLE_WORDS)))
    encode = _encoder(tokenizer_json)
    return {word: encode(word) for word, _ in seen.most_common(TABLE_WORDS)}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``docs`` needs doc_id and text; ``tokenizer`` is the path of a lower-casing word-BPE file.
    Counts are the library's for the whole text without added special tokens; the strings of
    special tokens inside a text count as those tokens. A null or empty text has 0 tokens.
    Repeated rows stay repeated; other columns are not looked at; an empty table gives no row.

    The table of frequent lengths is bounded (TABLE_WORDS) and broadcast; a miss is encoded once
    by a worker and kept in its bounded cache. No pre-token is shuffled.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    run_id = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(docs, spec)))

    def run(batches):
        def build():
            spec, frequent = shared.value
            return _cutter(spec), Lengths(frequent, _encoder(spec))

        cutter, lengths = per_worker("lengths", run_id, build)
        get = lengths.__getitem__
        for batch in slices(batches):
            texts = texts_of(batch)
            counts = [
                sum(1 if added is not None else sum(map(get, words)) for added, words in cutter.chunks(t))
                for t in texts
            ]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=COUNTED.fieldNames()
            )

    return docs.mapInArrow(run, COUNTED).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
