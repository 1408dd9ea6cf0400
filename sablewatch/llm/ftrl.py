"""Quality scores by a hashed word n-gram logistic regression, learnt with follow-the-regularised-leader updates.

A text becomes counts of hashed n-grams of its words and of its words' shapes. Each shard of the
labelled sample runs proximal updates from a common state; the shards' changes are averaged by
feature after each pass. A score is one sparse dot product.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.base import per_worker, slices, texts_of
from sablewatch.session import materialised

#: Hashed features (a power of two); words and shapes share them.
FEATURES = 1 << 18
#: The bounded sample: about so many different labelled texts of each class, by their hash.
LABELLED = 20_000
#: Shards learn side by side; passes over the sample.
SHARDS, PASSES = 8, 6
#: Partitions for shards: the least number at which the hashes of 0 to 7 lie apart. Places of the state that are averaged together.
SPREAD, SLICE = 22, 1 << 14
#: Learning rate and its offset, absolute and square penalty of the updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1
#: From this score on a text is predicted to be good.
GOOD = 0.7
WORD_CACHE = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _shape(token: str) -> str:
    """Coarse form of a token: letter case, digits, or the sign itself (runs shortened)."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    return "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "a"


class Tokens(dict):
    """Token -> hashes of its lower-cased form and of its shape."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= WORD_CACHE:
            self.clear()
        pair = self[token] = (crc32(token.lower().encode()), crc32(_shape(token).encode(), 7))
        return pair


def _bins(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(40)) & np.uint64(FEATURES - 1)


def counts_of(text: str, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of a whole text: words, word pairs, and up to three shapes in a row, a
    shape telling too whether the word repeats the one before."""
    pairs = [tokens[t] for t in _TOKEN.findall(text)]
    if not pairs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    both = np.array(pairs, np.uint64)
    word, shape = both[:, 0], both[:, 1].copy()
    shape[1:] += (word[1:] == word[:-1]).astype(np.uint64)
    two, twice = word[:-1] * _STEP + word[1:], shape[:-1] * _STEP + shape[1:]
    found = np.concatenate([
        _bins(word, 1), _bins(two, 2), _bins(shape, 3), _bins(twice, 4), _bins(twice[:-1] * _STEP + shape[2:], 5),
    ])
    return np.unique(found.astype(np.int32), return_counts=True)


def unit(n: np.ndarray) -> np.ndarray:
    return n / math.sqrt(float(n @ n)) if len(n) else n.astype(float)


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and the constant added to each dot product."""

    weights: np.ndarray
    constant: float

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.constant + float(self.weights[at] @ value)))))


def weights_of(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
    """Weights a state stands for: zero while the leader's slope is within the absolute penalty."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


class Learner:
    """Proximal state; the last place belongs to the constant, which has no absolute penalty."""

    def __init__(self, z: np.ndarray, n: np.ndarray) -> None:
        self.z, self.n = z.copy(), n.copy()

    def see(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, w0 = weights_of(z, n), weights_of(self.z[-1:], self.n[-1:], 0.0)
        wrong = Model(w, float(w0[0])).score(slice(None), value) - label
        for place, slope, old, weight in ((at, wrong * value, n, w), (slice(-1, None), np.array([wrong]), self.n[-1:].copy(), w0)):
            new = old + slope * slope
            self.z[place] += slope - (np.sqrt(new) - np.sqrt(old)) / ALPHA * weight
            self.n[place] = new


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int = LABELLED) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample ``(at, label, text)`` of the different labelled texts, and each class's
    share in it. Needs doc_id and text; doc_id and quality.

    All texts of a class are taken where there are at most ``each``, otherwise about ``each`` by
    their hash. Labels other than 0 and 1 do not count; a text with both labels counts as 0.
    A null text is an empty one.
    """
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    own = materialised(texts.select("doc_id", "at").join(marked, "doc_id").groupBy("at").agg(F.min("label").alias("label")), "quality-labels")
    share = {r.label: min(1.0, each / r.n) for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0.0)
    for label, part in share.items():
        limit = F.when(F.col("label") == label, part).otherwise(limit)
    chosen = own.where(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < limit * (1 << 30))
    # At most about 2 x each rows of 12 bytes, by the shares.
    sample = texts.join(F.broadcast(chosen), "at").groupBy("at", "label").agg(F.min("text").alias("text"))
    return sample, share


def _vectors(batches):
    tokens = per_worker("quality-tokens", WORD_CACHE, Tokens)
    for batch in slices(batches):
        found = [counts_of(t, tokens) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
            names=["at", "label", "bins", "counts"],
        )


def _changes(shard: int, learner: Learner, z: np.ndarray, n: np.ndarray):
    """What a shard changed, a row for each slice of the state: a bit for each place, and the changed places' differences."""
    changed = (learner.z != z) | (learner.n != n)
    for i in range(0, len(z), SLICE):
        own = changed[i : i + SLICE]
        if own.any():
            dz, dn = ((a[i : i + SLICE] - b[i : i + SLICE])[own] for a, b in ((learner.z, z), (learner.n, n)))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([i // SLICE], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "places": pa.array([np.packbits(own).tobytes()]), "dz": pa.array([dz.tobytes()]), "dn": pa.array([dn.tobytes()]),
            })


def _one_pass(state):
    """What each shard's rows, in the order of their hashes, change in the common state. A shard's rows follow each other."""

    def run(batches):
        z, n = state.value
        at, learner = None, None
        for batch in batches:
            for shard, label, bins, counts in zip(*(batch.column(c) for c in ("shard", "label", "bins", "counts"))):
                if shard.as_py() != at:
                    if learner is not None:
                        yield from _changes(at, learner, z, n)
                    at, learner = shard.as_py(), Learner(z, n)
                learner.see(bins.values.to_numpy(), unit(counts.values.to_numpy().astype(np.int64)), label.as_py())
        if learner is not None:
            yield from _changes(at, learner, z, n)

    return run


def _averaged(state, shards: int):
    """A slice of the next common state from all shards' changes."""

    def run(key, rows):
        at = key[0].as_py()
        z, n = (a[at * SLICE : (at + 1) * SLICE].copy() for a in state.value)
        for row in rows.sort_by("shard").to_pylist():
            places = np.unpackbits(np.frombuffer(row["places"], np.uint8), count=len(z)).astype(bool)
            z[places] += np.frombuffer(row["dz"]) / shards
            n[places] += np.frombuffer(row["dn"]) / shards
        return pa.table({"slice": pa.array([at], pa.int32()), "z": pa.array([z.tobytes()]), "n": pa.array([n.tobytes()])})

    return run


def train(sample: DataFrame, share: dict[int, float], shards: int = SHARDS, passes: int = PASSES) -> Model:
    """The model of a bounded sample. ``share`` undoes in the constant that the classes were
    sampled unequally. With one class only the weights are zero and all score 0.99 or 0.01;
    without labels all score 0.5."""
    if len(share) < 2:
        known = next(iter(share), None)
        return Model(np.zeros(FEATURES), 0.0 if known is None else math.log(99) * (1 if known else -1))
    spark = sample.sparkSession
    vectors = sample.select("at", "label", "text").mapInArrow(_vectors, "at long, label int, bins array<int>, counts array<int>")
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "at"), F.lit(shards)).cast("int"))
    # Dealt out and sorted once: a pass reads each shard where it lies, side by side with the others.
    dealt = vectors.repartition(SPREAD, "shard").sortWithinPartitions("shard", "at").persist(StorageLevel.DISK_ONLY)
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for _ in range(passes):
        state = spark.sparkContext.broadcast((z, n))
        changes = dealt.mapInArrow(_one_pass(state), "slice int, shard int, places binary, dz binary, dn binary")
        # Averaged slices of the one state reach the driver, FEATURES + 1 places in all, whatever the shards or the input.
        new = changes.groupBy("slice").applyInArrow(_averaged(state, shards), "slice int, z binary, n binary").collect()
        z, n = z.copy(), n.copy()
        for r in new:
            part = slice(r.slice * SLICE, (r.slice + 1) * SLICE)
            z[part], n[part] = np.frombuffer(r.z), np.frombuffer(r.n)
        state.destroy()
    dealt.unpersist()
    constant = float(weights_of(z[-1:], n[-1:], 0.0)[0]) - math.log(share[1]) + math.log(share[0])
    return Model(weights_of(z[:-1], n[:-1]), constant)


def score(docs: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of at least ``good``) of whole texts.

    Null, empty and blank texts have no n-grams and score what the constant says. Repeated rows
    stay; columns other than doc_id and text are not looked at; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens = per_worker("quality-tokens", WORD_CACHE, Tokens)
        for batch in slices(batches):
            found = (counts_of(t, tokens) for t in texts_of(batch))
            got = np.array([shared.value.score(at, unit(n)) for at, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got, pa.float64()), pa.array((got >= good).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
