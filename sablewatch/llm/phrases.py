"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the shortest piece that is not yet a phrase.
The hashes of the phrase set fall into BINS bins by their leading bits; each bin's least hash
gives 16 bits of the fingerprint, and an empty bin borrows from the next one that is not.
The share of equal bins estimates the phrase sets' Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import slices
from sablewatch.session import materialised

BINS = 128
_SHIFT = np.uint64(64 - 7)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    size = len(_powers[0])
    if size < n:
        size = max(n, 2 * size, 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for i, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Hashes:
    """Hash of any piece of one text, from running sums of a polynomial modulo 2**64."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        power, self.inverse = _power_tables(len(points) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * power[: len(points)], dtype=np.uint64)])

    def __call__(self, ends: list[int], starts: list[int]) -> np.ndarray:
        i, j = np.array(starts, np.int64), np.array(ends, np.int64)
        h = (self.sums[j] - self.sums[i]) * self.inverse[i]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def parse(text: str, at: int, stop: int, node: dict, begin: int, root: dict, undo: list | None):
    """Parses text[at:stop] on; returns starts and ends of new phrases, the open place and begin."""
    starts, ends = [], []
    for i in range(at, stop):
        c = text[i]
        nxt = node.get(c)
        if nxt is None:
            node[c] = {}
            if undo is not None:
                undo.append((node, c))
            starts.append(begin)
            begin = i + 1
            ends.append(begin)
            node = root
        else:
            node = nxt
    return starts, ends, node, begin


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS 16-bit values of a phrase set; all ones for the empty set."""
    if not len(hashes):
        return np.full(BINS, 0xFFFF, np.uint16)
    order = np.sort(hashes)
    edges = np.arange(BINS, dtype=np.uint64) << _SHIFT
    first = np.searchsorted(order, edges)
    inside = np.minimum(first, len(order) - 1)
    full = (first < len(order)) & ((order[inside] >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    values = (order[inside] & np.uint64(0xFFFF)).astype(np.int64)
    have = np.flatnonzero(full)
    source = have[np.searchsorted(have, np.arange(BINS)) % len(have)]
    distance = (source - np.arange(BINS)) % BINS
    return ((values[source] + distance * 0x3D4D) & 0xFFFF).astype(np.uint16)


def packed(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / BINS


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u2").astype(np.uint16)


def both(text: str, following: str | None):
    """Signatures of the text and of its edited text, and the latter.

    They share their first two thirds, which are parsed once; without ``following`` only the
    text's own signature is made.
    """
    n = len(text)
    cut = n - n // 3
    root: dict = {}
    s0, e0, node, begin = parse(text, 0, cut, root, 0, root, None)
    undo: list = []
    s1, e1, _, _ = parse(text, cut, n, node, begin, root, undo)
    own = signature(Hashes(text)(e0 + e1, s0 + s1))
    if following is None:
        return own, None, None
    for place, c in reversed(undo):
        del place[c]
    edited = text[:cut] + following[: n // 3]
    s2, e2, _, _ = parse(edited, cut, len(edited), node, begin, root, None)
    return own, signature(Hashes(edited)(e0 + e2, s0 + s2)), edited


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text; null counts as empty."""
    return packed(both(text or "", None)[0]).hex()


ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
])
#: The written rows hold digests as bytes; they become text in the result.
BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")
RAW = [T.StructField(f.name, T.BinaryType()) if f.name in BYTES else f for f in ROWS.fields]
EDGES = T.StructType([*RAW, T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])


def _row(doc_id, text: str, following: str, next_sig: np.ndarray | None = None):
    own, changed, edited = both(text, following)
    digest = hashlib.sha256(edited.encode()).digest()
    return [doc_id, len(text), digest, packed(own), packed(changed), likeness(own, changed), None], own


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema.fields, strict=True)], names=schema.fieldNames())


def _along(batches):
    """Rows of one sorted partition; each needs the one after it. The partition's first and last
    rows keep their texts, as their neighbours lie in other partitions."""
    part = TaskContext.get().partitionId()
    before, sig, held, first = None, None, [], True
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if before is not None:
                row, own = _row(*before, text)
                if held:
                    held[-1][6] = likeness(sig, own)
                    yield _batch(held, EDGES)
                held, sig = [[*row, part, first, False, before[1] if first else None]], own
                first = False
            before = (doc_id, text)
    if before is None:
        return
    own = both(before[1], None)[0]
    if held:
        held[-1][6] = likeness(sig, own)
    held.append([before[0], len(before[1]), None, packed(own), None, None, None, part, first, True, before[1]])
    yield _batch(held, EDGES)


def _across(batches):
    """Last rows of partitions, completed with the first row of the next partition."""
    for batch in slices(batches):
        rows = []
        for doc_id, text, next_text, next_print in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row, own = _row(doc_id, text, next_text)
            row[6] = likeness(own, unpacked(next_print))
            rows.append(row)
        yield _batch(rows, T.StructType(RAW))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    ``docs`` needs doc_id and text. In descending order of doc_id (null ids last, equal ids by
    text) each document's last third is replaced by the start of the next one's text; the last
    is followed by the first. Texts move once, to be sorted; at the seams of the sorted
    partitions two rows of each are matched afterwards.

    A null text counts as empty; empty texts have the fingerprint of no phrase and are alike.
    Repeated rows are rows of their own; other columns are not looked at; no rows give no rows.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    done = materialised(rows.repartitionByRange(*order[:1]).sortWithinPartitions(*order).mapInArrow(_along, EDGES), "phrases")
    parts = done.where("first").select("part")  # one row of each partition
    ring = parts.select(
        "part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("before")
    )
    heads = done.where("first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")).join(ring, "part")
    tails = done.where("last").select("doc_id", "text", F.col("part").alias("before"))
    seams = tails.join(heads.drop("part"), "before").select("doc_id", "text", "next_text", "next_print").mapInArrow(_across, T.StructType(RAW))
    rows = done.where("not last").select(*ROWS.fieldNames()).unionByName(seams)
    return rows.select(*[F.lower(F.hex(c)).alias(c) if c in BYTES else F.col(c) for c in ROWS.fieldNames()])
