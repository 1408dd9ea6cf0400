"""Reversible line dedup: exact reference counts of lines, and cuckoo filters over them.

A line's key is the line without blanks at its ends, A-Z lower-cased; it is known by a 128-bit
hash. The reference table holds the number of documents of every key. A key belongs to the
filter of its shard while at least ``min_docs`` documents hold it, so inserting or deleting
documents changes counts, and the filters only where a count crosses that number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import per_worker, slices, texts_of
from sablewatch.session import materialised

#: Fixed by the definition of a key.
BLANKS = b" \t\n\x0b\x0c\r"
#: Shards of the filters; filters up to this many bytes are broadcast, larger ones are not.
SHARDS, BROADCAST_BYTES = 64, 64 << 20
SLOTS, KICKS = 4, 500

KEYS = "doc_id bigint, key binary"
FILTER = "shard int, buckets int, cells binary"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower touches A-Z only


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id and each key of the document once; the empty key is left out."""

    def run(batches):
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                own = {key_of(line) for line in text.encode().split(b"\n")}
                own.discard(b"")
                ids += [doc_id] * len(own)
                keys += map(digest, own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, KEYS)


def references(docs: DataFrame) -> DataFrame:
    """key, refs: in how many documents (different doc_ids; null is one) a key is found."""
    return line_keys(docs).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("refs"))


def changed(refs: DataFrame, docs: DataFrame, sign: int) -> DataFrame:
    """The reference table after inserting (1) or deleting (-1) whole documents."""
    delta = references(docs).withColumn("refs", F.col("refs") * F.lit(sign))
    return refs.unionByName(delta).groupBy("key").agg(F.sum("refs").alias("refs")).where("refs > 0")


def shard_of(key):
    return (F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int") % SHARDS).alias("shard")


class Cuckoo:
    """Cuckoo filter of 32-bit fingerprints, SLOTS to a bucket; deletion is exact for what was
    inserted. ``insert`` tells whether there was room."""

    def __init__(self, buckets: int, cells: bytes | None = None) -> None:
        self.buckets = buckets
        self.cells = np.zeros(buckets * SLOTS, "<u4") if cells is None else np.frombuffer(cells, "<u4").copy()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:12], "big") or 1
        first = int.from_bytes(key[1:8], "big") % self.buckets
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x9E3779B1 & 0xFFFFFFFF) % self.buckets)

    def insert(self, key: bytes) -> bool:
        mark, *places = self._places(key)
        for bucket in places:
            for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.cells[cell]:
                    self.cells[cell] = mark
                    return True
        bucket = places[mark & 1]
        for turn in range(KICKS):
            cell = bucket * SLOTS + (mark >> 5 ^ turn) % SLOTS
            mark, self.cells[cell] = int(self.cells[cell]), mark
            bucket = self._other(bucket, mark)
            for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.cells[cell]:
                    self.cells[cell] = mark
                    return True
        return False

    def delete(self, key: bytes) -> None:
        mark, *places = self._places(key)
        for bucket in places:
            for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[cell] == mark:
                    self.cells[cell] = 0
                    return


def _filter_of(keys: list[bytes], buckets: int) -> Cuckoo:
    """A filter with these keys; the number of buckets doubles until they fit."""
    while True:
        made = Cuckoo(buckets)
        if all(map(made.insert, keys)):
            return made
        buckets *= 2


def _size_for(n: int) -> int:
    return 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))


def _row(shard: int, made: Cuckoo) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "cells": [made.cells.tobytes()]})


def build_filters(refs: DataFrame, min_docs: int) -> DataFrame:
    """One filter per shard over the keys with at least ``min_docs`` documents."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        own = sorted(map(bytes, keys["key"]))
        return _row(int(keys["shard"].iloc[0]), _filter_of(own, _size_for(len(own))))

    return refs.where(F.col("refs") >= min_docs).select(shard_of("key"), "key").groupBy("shard").applyInPandas(build, FILTER)


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    """The filters after the reference table went from ``before`` to ``after``.

    Keys whose count crossed ``min_docs`` are inserted or deleted; a filter without room is made
    anew, larger, from the exact table.
    """
    old = before.where(F.col("refs") >= min_docs).select("key", F.lit(True).alias("was"))
    new = after.where(F.col("refs") >= min_docs).select("key", F.lit(True).alias("now"))
    keys = old.join(new, "key", "full").select(shard_of("key"), "key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))

    def update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int((left if len(left) else right)["shard"].iloc[0])
        made = Cuckoo(int(left["buckets"].iloc[0]), bytes(left["cells"].iloc[0])) if len(left) else Cuckoo(4)
        for key in right.loc[right["was"] & ~right["now"], "key"]:
            made.delete(bytes(key))
        if not all(made.insert(bytes(k)) for k in right.loc[right["now"] & ~right["was"], "key"]):
            made = _filter_of(sorted(map(bytes, right.loc[right["now"], "key"])), made.buckets * 2)
        return _row(shard, made)

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, FILTER)


class Probe:
    """All shards' filters in one array, asked for many keys at once."""

    def __init__(self, rows: list[tuple[int, int, bytes]], never: frozenset[bytes] = frozenset()) -> None:
        self.never = never
        self.buckets = np.ones(SHARDS, np.uint64)
        self.start = np.zeros(SHARDS, np.int64)
        cells, at = [np.zeros(SLOTS, "<u4")], 1
        for shard, buckets, raw in rows:
            self.buckets[shard], self.start[shard] = buckets, at
            cells.append(np.frombuffer(raw, "<u4"))
            at += buckets
        self.cells = np.concatenate(cells).reshape(-1, SLOTS)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        shard = raw[:, 0] % SHARDS
        buckets, start = self.buckets[shard], self.start[shard]
        head = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64) & np.uint64((1 << 56) - 1)
        mark = np.ascontiguousarray(raw[:, 8:12]).view(">u4").ravel().astype(np.uint64)
        mark[mark == 0] = 1
        first = head % buckets
        other = first ^ ((mark * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) % buckets)
        found = np.zeros(len(keys), bool)
        for bucket in (first, other):
            found |= (self.cells[start + bucket.astype(np.int64)] == mark[:, None].astype("<u4")).any(axis=1)
        if self.never:
            for i in np.flatnonzero(found):
                found[i] = keys[i] not in self.never
        return found


def _cleaned(batches, drop, at: int, out):
    """Texts without the lines whose keys ``drop`` tells, with line counts."""
    for batch in slices(batches):
        texts = [t.encode() for t in texts_of(batch)]
        lines = [t.split(b"\n") for t in texts]
        keys = [key_of(x) for own in lines for x in own]
        full = [i for i, k in enumerate(keys) if k]
        gone = np.zeros(len(keys), bool)
        gone[full] = drop(batch, [digest(keys[i]) for i in full], [len(own) for own in lines], full)
        kept, dropped, start = [], [], 0
        for text, own in zip(texts, lines, strict=True):
            flags = gone[start : start + len(own)]
            start += len(own)
            n = int(flags.sum())
            dropped.append(n)
            kept.append((text if not n else b"\n".join(x for x, f in zip(own, flags, strict=True) if not f)).decode())
        yield out(batch, kept, [len(own) for own in lines], dropped)


CLEAN_COLUMNS = ("__kept", "__lines", "__dropped")


def clean(docs: DataFrame, refs: DataFrame, filters: DataFrame, min_docs: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with __kept (text without frequent lines), __lines and __dropped.

    ``docs`` must be among the documents ``refs`` counts. Filters of at most ``broadcast_bytes``
    go to every worker; with them go the keys of the exact table that a filter reports wrongly (of
    about one in half a billion), so the result is exact. Larger filters stay where they are:
    line keys are joined with the exact table, hot keys split by adaptive execution.
    """
    spark = docs.sparkSession
    fields = [f for f in docs.schema.fields if f.name not in CLEAN_COLUMNS]
    docs = docs.select(*[f"`{f.name}`" for f in fields])
    schema = T.StructType([*fields, T.StructField("__kept", T.StringType()), T.StructField("__lines", T.LongType()), T.StructField("__dropped", T.LongType())])
    names = schema.fieldNames()

    def out(batch, kept, n_lines, dropped):
        own = [batch.column(i) for i in range(len(fields))]
        return pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    size = filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = [(r.shard, r.buckets, bytes(r.cells)) for r in filters.toLocalIterator()]
        shared = spark.sparkContext.broadcast(rows)

        def wrong(batches):
            probe = Probe(shared.value)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, f in zip(keys, probe(keys), strict=True) if f], pa.binary())], names=["key"])

        rare = refs.where(F.col("refs") < min_docs).select("key")
        never = frozenset(bytes(r.key) for r in rare.mapInArrow(wrong, "key binary").toLocalIterator()) if rows else frozenset()
        exact = spark.sparkContext.broadcast((rows, never))

        def run(batches):
            probe = Probe(*exact.value)
            yield from _cleaned(batches, lambda batch, keys, lens, full: probe(keys), 0, out)

        return docs.mapInArrow(run, schema)

    frequent = refs.where(F.col("refs") >= min_docs).select("key")
    hits = line_keys(docs).distinct().join(frequent, "key").groupBy("doc_id").agg(F.collect_list("key").alias("__hits"))
    hits = hits.withColumnRenamed("doc_id", "__doc")
    joined = docs.join(hits, F.expr("cast(doc_id as bigint) <=> __doc"), "left").drop("__doc")

    def run_joined(batches):
        def drop(batch, keys, lens, full):
            sets = [set(h or ()) for h in batch.column(len(fields)).to_pylist()]
            owner = np.repeat(np.arange(len(lens)), lens)[full]
            return np.fromiter((k in sets[o] for k, o in zip(keys, owner, strict=True)), bool, len(keys))

        yield from _cleaned(batches, drop, 0, out)

    return joined.mapInArrow(run_joined, schema)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Line dedup of a whole table: counts, filters, then ``clean``.

    Null or empty texts have one empty line, which is never dropped; so are lines of blanks only.
    Rows of one doc_id count as one document but are cleaned each; extra columns stay; an empty
    table gives no rows.
    """
    refs = materialised(references(docs), "line-refs")
    filters = materialised(build_filters(refs, min_docs), "line-filters")
    return clean(docs, refs, filters, min_docs, broadcast_bytes)


def stage(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The documents with frequent lines gone from their texts; a null text stays null."""
    done = drop_frequent_lines(docs, min_docs)
    new = {"text": F.when(F.col("__dropped") > 0, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__dropped") > 0, F.length("__kept").cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
