"""Hierarchical residual packing of tokenized documents into sequences."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import per_worker, slices, texts_of
from sablewatch.llm.pretokens import Cutter, byte_symbols
from sablewatch.session import shared_dir

#: A bin with at most this many free places is emitted; the others go to the next round.
SLACK = 2
#: Partitions whose underfull bins meet in one task of the next round, and the most rows a
#: task may get then; with more rows, more tasks take part.
FAN_IN, TASK_ROWS = 8, 200_000
#: Pre-tokens whose ids a worker keeps: so many, of at most so many characters each.
WORD_CACHE, CACHED_CHARS = 100_000, 64

PLACED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("full", T.BooleanType()),
])


class ByteIds(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str) -> None:
        from tiktoken import Encoding

        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must follow the order of the merges")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        self.piece = Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.piece(word.encode()), "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = ids
        return ids


class ByteEncoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Merging is done by a faster library on the same vocabulary; the strings of added tokens
    inside a text become those tokens, as the first library has it.
    """

    def __init__(self, tokenizer_json: str) -> None:
        self.words = ByteIds(tokenizer_json)
        self.cutter = Cutter(False, self.words.added, tokenizer_json)

    def __call__(self, text: str) -> bytes:
        out, get = [], self.words.__getitem__
        for added, words in self.cutter.chunks(text):
            out += [added.to_bytes(4, "little")] if added is not None else map(get, words)
        return b"".join(out)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item by best fit, largest first. Bins by free space, in a bit set."""
    bin_of, free, waiting = [0] * len(sizes), 0, [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = free >> size
        if fits:
            space = (fits & -fits).bit_length() - 1 + size
            at = waiting[space].pop()
            if not waiting[space]:
                free &= ~(1 << space)
        else:
            space, at, used = capacity, used, used + 1
        bin_of[i] = at
        if space > size:
            if not waiting[space - size]:
                free |= 1 << (space - size)
            waiting[space - size].append(at)
    return bin_of


def _numbered(bins: list[int], rows: list[tuple], first: int, capacity: int):
    """Rows (doc_id, piece, start, length, crc) with sequence, offset and whether it is full."""
    at: dict[int, int] = {}
    offsets = []
    for b, row in zip(bins, rows, strict=True):
        offsets.append(at.get(b, 0))
        at[b] = offsets[-1] + row[3]
    return [(*row, first + b, o, at[b] >= capacity - SLACK) for b, row, o in zip(bins, rows, offsets, strict=True)]


def _emit(rows: list[tuple]):
    for i in range(0, len(rows), 20_000):
        cols = list(zip(*rows[i : i + 20_000], strict=True))
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=PLACED.fieldNames())


def _first_id(level: int) -> int:
    return level << 56 | TaskContext.get().partitionId() << 28


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenizes documents, cuts long ones and packs what each partition holds (round 0)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = per_worker("bytes", spec.value, lambda: ByteEncoder(spec.value))
        rows = []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:  # the first piece takes the remainder, the others are full
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
        bins = best_fit([r[3] for r in rows], capacity)
        yield from _emit(_numbered(bins, rows, _first_id(0), capacity))

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, PLACED)


def _merge(level: int, capacity: int):
    """One task of a later round: underfull bins as items, and those still underfull opened."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        got = sorted(zip(*(table.column(c).to_pylist() for c in PLACED.fieldNames()[:7]), strict=True), key=lambda r: (r[5], r[6]))
        members: dict[int, list[tuple]] = {}
        for r in got:
            members.setdefault(r[5], []).append(r[:5])
        groups = list(members.values())
        whole = best_fit([sum(r[3] for r in g) for g in groups], capacity)
        fill: dict[int, int] = {}
        for b, g in zip(whole, groups, strict=True):
            fill[b] = fill.get(b, 0) + sum(r[3] for r in g)
        rows, bins, loose = [], [], []
        for b, g in zip(whole, groups, strict=True):
            if fill[b] >= capacity - SLACK:
                rows += g
                bins += [b] * len(g)
            else:
                loose += g
        opened = best_fit([r[3] for r in loose], capacity)
        if len(set(opened)) <= sum(f < capacity - SLACK for f in fill.values()):
            rows, bins = rows + loose, bins + [len(groups) + b for b in opened]
        else:
            rows = [r for g in groups for r in g]
            bins = [b for b, g in zip(whole, groups, strict=True) for _ in g]
        yield from _emit(_numbered(bins, rows, _first_id(level), capacity))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Places every document's tokens, ended by ``end_id``, in sequences of at most ``capacity``.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Only documents longer than ``capacity`` are cut. Round 0 packs each input partition by best
    fit and keeps bins with at most SLACK free places; in later rounds the underfull bins of
    FAN_IN partitions meet, first as items, then opened. Rounds end with one task, or when a
    round over bounded tasks saves less than a hundredth of the bins. A task holds piece numbers,
    never ids, and at most about TASK_ROWS rows. Each round is a written table, so a lost
    executor repeats tasks of one round only.

    A null text counts as empty: its piece is the end id alone. Repeated rows are packed each for
    itself; null doc_ids stay null; other columns are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    first = pieces(docs, tokenizer, end_id, capacity)
    parts = first.rdd.getNumPartitions()
    base = shared_dir(spark, "packing")
    done, level, before = [], 0, None
    placed = _written(spark, first, f"{base}/0")
    while True:
        rest = placed.where(~F.col("full"))
        rows, bins = rest.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        few = rows <= TASK_ROWS and parts <= 1
        if not rows or few or (before is not None and parts >= before[1] and bins > 0.99 * before[0]):
            return _union([*done, placed]).drop("full")
        before = (bins, parts)
        done.append(placed.where("full"))
        level += 1
        parts = max(-(-parts // FAN_IN), -(-rows // TASK_ROWS))
        source = F.expr(f"(sequence_id >> 28) & {(1 << 28) - 1}")  # the task that filled the bin
        group = F.floor(source / FAN_IN) if parts < before[1] else F.xxhash64("sequence_id", F.lit(level))
        dealt = rest.repartitionById(parts, F.pmod(group, F.lit(parts)).cast("int"))
        placed = _written(spark, dealt.mapInArrow(_merge(level, capacity), PLACED), f"{base}/{level}")


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(PLACED).parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
