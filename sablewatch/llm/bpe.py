"""BPE encoding and decoding by a tokenization automaton (see ``automaton``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sablewatch.llm.automaton import compiled
from sablewatch.llm.base import per_worker, slices, texts_of
from sablewatch.llm.pretokens import Cutter

#: Words whose ids a worker keeps; beyond that it starts anew.
WORD_CACHE = 400_000

ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
])


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, filled by the automaton."""

    def __init__(self, automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        ids = self[word] = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        return ids


class Codec:
    """Encodes and decodes whole texts by a tokenizer file's text (lower-casing word BPE)."""

    def __init__(self, tokenizer_json: str) -> None:
        self.automaton, added = compiled(tokenizer_json)
        self.automaton.labels |= {i: s for s, i in added.items()}
        self.cutter = Cutter(True, added, tokenizer_json)
        self.words = WordIds(self.automaton)

    def encode(self, text: str) -> bytes:
        out, get = [], self.words.__getitem__
        for added, words in self.cutter.chunks(text):
            out += [added.to_bytes(4, "little")] if added is not None else map(get, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(self.automaton.decode(np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from the ids.

    ``docs`` needs doc_id and text; ``tokenizer`` is the path of a lower-casing word-BPE file,
    read on the driver and broadcast (its size is the vocabulary's, whatever the data's). A null
    text counts as empty and gives no ids; repeated rows give repeated rows; any other columns
    are not looked at. A text is encoded word by word, however long; state of the automaton
    that grew with the words is dropped at fixed sizes, which changes no result.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = per_worker("codec", spec.value, lambda: Codec(spec.value))
        for batch in slices(batches):
            ids = [codec.encode(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([codec.decode(x) for x in ids], pa.string())],
                names=ENCODED.fieldNames(),
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, ENCODED)
