"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

A shingle is five words (a shorter text is one shingle); words are runs without white space,
lower-cased, without punctuation at their ends. A shingle weighs its count times
1 + ln(1 + N / df) / ln(1 + N), where N counts documents with words and df is the exact number
of them in the shingle's bucket, one of 2**BUCKET_BITS. So the table of weights has a fixed size,
boilerplate weighs little, and equal texts have equal weights.

Equal word sequences become one class first. Improved consistent weighted sampling gives BANDS x
ROWS samples of each class; classes that agree on a band are compared with the least of the
bucket, exactly, by weighted Jaccard similarity. Links make components. Buckets that still hold
several components are settled exactly, over the shingles that two texts of such buckets hold: in the
order of rising frequency, similar texts first meet where the rest of both still weighs enough. There
each text is compared with one hub after another while that finds links, then every two texts
of different components. Before any text is read, a pair must pass two bounds of what both can have in
common: the lesser rest, and the sum over CLASSES classes of shingles of the lesser weight. So pairs
are excluded by proof, never by a cap.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.base import per_worker, slices
from sablewatch.session import materialised

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 13, 3
BUCKET_BITS, POOL_BITS = 18, 16
#: Classes of shingles whose weights bound what two texts share; slack for rounding in bounds.
CLASSES, SLACK = 32, 1e-5
#: Marks that do not count at the ends of a word; words hashed at once.
MARKS, SLICE = string.punctuation + "«»„“”‘’…–—¿¡", 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Random factors of byte values in the hash of a word.
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string, a sum of products over its bytes and their places; 0 for an empty one."""
    offsets = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)
    at = offsets[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes, out = np.diff(at), np.zeros(len(words), np.uint64)
    if at[-1] > at[0]:
        data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
        place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], sizes)
        factor = _mix(np.arange(1, sizes.max() + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
        some = sizes > 0
        out[some] = _mix(np.add.reduceat(_BYTES[data] * factor[place], (at[:-1] - at[0])[some])) | np.uint64(1)
    return out


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text; none of a null text."""
    # Blank ends go first: a text of blanks alone would be split into a blank word.
    tokens = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    words = pc.utf8_trim(tokens.flatten(), characters=MARKS)
    h = np.concatenate([np.zeros(0, np.uint64), *[hashes(words.slice(i, SLICE)) for i in range(0, len(words), SLICE)]])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
    return [own[own != 0] for own in (h[i:j] for i, j in zip(at[:-1], at[1:], strict=True))]


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles, ascending, and their counts."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(WORDS, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = h * _ODD + words[j : j + len(h)]
    return np.unique(_mix(h), return_counts=True)


def buckets(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """df of each bucket over all documents, and the number of documents with words."""

    def run(batches):
        df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in slices(batches):
            for words in word_hashes(batch.column(0)):
                own = buckets(shingles(words)[0])
                n += bool(len(own))
                df[own[np.diff(own, prepend=-1) != 0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *df[at]], pa.int64())], names=["bucket", "n"])

    total = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BUCKET_BITS, np.int64)
    at, n = total["bucket"].to_numpy(), total["n"].to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    n = max(1, n)
    return (1 + np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype(np.float32)


def weights(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, count = shingles(words)
    return s, count.astype(np.float32) * idf[buckets(s)]


def class_sums(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of each class of shingles."""
    return np.bincount((shingle & shingle.dtype.type(CLASSES - 1)).astype(np.intp), weight, CLASSES).astype(np.float32)


def weighted_jaccard(a, b) -> float:
    (sa, wa), (sb, wb) = a, b
    _, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    return low / max(float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - low, 1e-12)


class Sampler:
    """Improved consistent weighted sampling. A shingle's Gamma and uniform variates of sample k
    come from a pool, at a place hashed from both; a sample is the hash of (shingle, t)."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.odd = rng.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of samples for each segment that begins at ``starts``."""
        ln_w = np.log(weight)
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            mixed = shingle * odd
            at = (mixed >> np.uint64(64 - POOL_BITS)).astype(np.intp)
            t = np.floor(ln_w * self.inverse[at] + self.beta[at])
            ln_a = self.ln_c[at] - self.r[at] * (t - self.beta[at] + np.float32(1))
            bits = ln_a.view(np.int32)
            order = (bits ^ ((bits >> 31) | np.int32(-(1 << 31)))).view(np.uint32)
            low = (mixed ^ (t.astype(np.int64).view(np.uint64) * _ODD)) & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | low, starts) & np.uint64(0xFFFFFFFF)
        return out


SIGNED = "doc_id bigint, text_key bigint, node binary, bands array<bigint>, total double, sums array<float>"


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, text_key (hash of the text), node (hash of the words, null without words), bands,
    total weight and its class sums."""

    def run(batches):
        sampler = per_worker("sampler", 0, Sampler)
        table = idf.value
        for batch in slices(batches, 64):
            nodes, parts, sizes, totals, sums = [], [], [], [], []
            for words in word_hashes(batch.column(1)):
                nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                totals.append(None)
                sums.append(None)
                if len(words):
                    parts.append(weights(words, table))
                    sizes.append(len(parts[-1][0]))
                    totals[-1] = float(parts[-1][1].sum(dtype=np.float64))
                    sums[-1] = class_sums(*parts[-1])
            bands = iter(())
            if parts:
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.intp)
                got = sampler(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), starts)
                key = np.zeros((len(parts), BANDS), np.uint64)
                for j in range(ROWS):
                    key = _mix(key * _ODD + got[:, j::ROWS] + np.uint64(1))
                bands = iter(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()),
                 pa.array([None if n is None else next(bands) for n in nodes], pa.list_(pa.int64())),
                 pa.array(totals, pa.float64()), pa.array(sums, pa.list_(pa.float32()))],
                names=["doc_id", "text_key", "node", "bands", "total", "sums"],
            )

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches ``similarity``."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        last, own = None, None
        for batch in slices(batches, 64):
            ids, keep = batch.column(0).to_pylist(), []
            new = [i for i, a in enumerate(ids) if a != (ids[i - 1] if i else last)]
            firsts = dict(zip(new, word_hashes(batch.column(2).take(pa.array(new, pa.int32()))), strict=True))
            for i, words in enumerate(word_hashes(batch.column(3))):
                if i in firsts:
                    own = weights(firsts[i], idf.value)
                keep.append(weighted_jaccard(own, weights(words, idf.value)) >= similarity)
            last = ids[-1]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def sketches(members: DataFrame, idf) -> DataFrame:
    """node, total, shingle, weight of rows (node, text): every shingle of a text with its weight."""

    def run(batches):
        for batch in slices(batches, 64):
            own = [weights(words, idf.value) for words in word_hashes(batch.column(1))]
            if own:
                rows = pa.array(np.repeat(np.arange(len(own)), [len(s) for s, _ in own]))
                totals = pa.array([float(w.sum(dtype=np.float64)) for _, w in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), totals.take(rows), pa.array(np.concatenate([s for s, _ in own]).view(np.int64)), pa.array(np.concatenate([w for _, w in own]))],
                    names=["node", "total", "shingle", "weight"],
                )

    return members.select("node", "text").mapInArrow(run, "node binary, total double, shingle bigint, weight float")


def prefixes(crowd: DataFrame, similarity: float) -> DataFrame:
    """node, shingle, rest, total, sums: where similar texts of ``crowd`` can meet for the first time.

    Only shingles that two texts of the crowd hold count, the rarest first; ``rest`` is their weight
    from a shingle on. Texts that first meet there have at most the lesser rest in common, and similar
    ones at least ``similarity`` of each one's total; so a list ends where the rest falls below that. A
    text too full of shingles of its own has no list, and no partner. ``sums`` are the weights by class.
    """
    common = crowd.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = crowd.join(common, "shingle").groupBy("node", "total").agg(F.collect_list(F.struct("df", "shingle", "weight")).alias("held"))

    def run(batches):
        for batch in slices(batches, 64):
            at, found, rests, sums = [], [], [], []
            for i, (total, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                df, s, w = (own.values.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                order = np.lexsort((s, df))
                s, w = s[order], w[order].astype(np.float64)
                rest = np.cumsum(w[::-1])[::-1]
                n = int((rest >= (similarity - SLACK) * total).sum())
                if n:
                    at.append(np.full(n, i))
                    found.append(s[:n])
                    rests.append(rest[:n])
                    sums += [class_sums(s, w).tolist()] * n
            if at:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(np.concatenate(found)), pa.array(np.concatenate(rests)), batch.column(1).take(rows),
                     pa.array(sums, pa.list_(pa.float32()))],
                    names=["node", "shingle", "rest", "total", "sums"],
                )

    return held.mapInArrow(run, "node binary, shingle bigint, rest double, total double, sums array<float>")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _able(common: str, a: str, b: str, similarity: float) -> str:
    """SQL: texts of weights ``a`` and ``b`` with at most ``common`` in common may be similar."""
    return f"{common} * {1 + similarity} >= {similarity - SLACK} * ({a} + {b})"


def _overlap(a: str, b: str) -> str:
    """SQL: what class sums ``a`` and ``b`` allow two texts to have in common at most."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(least(x, y) as double)), 0D, (x, y) -> x + y)"


def able(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose class sums do not exclude the similarity; ``nodes``: node, total, sums."""
    both = pairs
    for end in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(end), F.col("total").alias(f"total_{end}"), F.col("sums").alias(f"sums_{end}")), end)
    return both.where(_able(_overlap("sums_a", "sums_b"), "total_a", "total_b", similarity)).select("a", "b")


def crowded_links(members: DataFrame, roots: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The roots after buckets (``members``: key, node) that hold several components
    are settled: no pair of different components of a bucket that is similar stays apart."""
    crowded = _rooted(members, roots).groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r <> q").select("key")
    nodes = members.join(crowded, "key").select("node").distinct()
    crowd = materialised(sketches(texts.join(nodes, "node"), idf), "near-crowd")
    listed = materialised(prefixes(crowd, similarity), "near-prefixes")

    def passing(a, b):
        rests = _able(f"least({a}.rest, {b}.rest)", f"{a}.total", f"{b}.total", similarity)
        return f"{rests} and {_able(_overlap(f'{a}.sums', f'{b}.sums'), f'{a}.total', f'{b}.total', similarity)}"

    # First each text with one of its shingle: the least edited one, then others as long as links are found.
    turn = 0
    while True:
        own = _rooted(listed, roots)
        rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("rest") / F.col("total")
        hub = own.groupBy("shingle").agg(
            F.max(F.struct(rank.alias("rank"), "node", "root", "rest", "total", "sums")).alias("x"), F.min("root").alias("r"), F.max("root").alias("q")
        ).where("r <> q").select("shingle", "x")
        star = own.alias("y").join(hub, "shingle").where(f"y.root <> x.root and {passing('x', 'y')}")
        star = star.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        fresh = materialised(verified(star, texts, idf, similarity), "near-links")
        if fresh.isEmpty():
            break
        roots, turn = merged(roots, fresh), turn + 1

    # Then every pair of different components that the bounds leave.
    own = materialised(_rooted(listed, roots), "near-prefixes")
    pairs = own.alias("x").join(own.alias("y"), F.expr(f"x.shingle = y.shingle and x.root < y.root and {passing('x', 'y')}"))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    fresh = materialised(verified(pairs, texts, idf, similarity), "near-links")
    return roots if fresh.isEmpty() else merged(roots, fresh)


def tangled(edges: DataFrame) -> bool:
    """Whether ``edges`` (a < b) are more than stars around least nodes: a b has two a, or is one."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").agg(F.count(F.lit(1))).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component, itself left out) by alternating large and small stars."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges = materialised(edges.distinct(), "near-edges")
    while tangled(edges):
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select("m", "b").where("m <> b")
        down = large.select(F.greatest("m", "b").alias("a"), F.least("m", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a")
        small = small.select(F.col("m").alias("a"), "b").where("a <> b").unionByName(floor.select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = materialised(small.distinct(), "near-edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: only the roots that these join are looked at again."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = _rooted(ends.withColumnRenamed(end, "node"), roots).withColumnRenamed("root", end).drop("node")
    over = components(ends)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return materialised(moved.unionByName(over), "near-roots")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, class_doc, class_key: each row's class, named by its least (doc_id, text).

    ``docs`` needs doc_id and text; other columns are not looked at. Texts without a word (null,
    empty, punctuation) are classes of their own, named by themselves. Rows with equal doc_id and
    text are one document. Null doc_ids come last when a class is named. An empty table gives no
    rows. Texts of any length are compared whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(df, n))
    signed = materialised(signatures(docs, idf), "near-signatures")

    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = materialised(signed.where("node is not null").groupBy("node").agg(F.min(name).alias("name"), *[F.first(c).alias(c) for c in ("bands", "total", "sums")]), "near-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialised(keyed.join(shared.select("key", "a"), "key").select("key", F.col("node").alias("b"), "a"), "near-members")
    pairs = able(members.where("a <> b").select("a", "b").distinct(), nodes, similarity)

    # Whole texts only of classes that meet another one, one row for each.
    wanted = members.select(F.col("b").alias("node")).distinct().join(nodes.select("node", "name"), "node")
    texts = materialised(
        docs.join(wanted.select("node", F.col("name.doc_id").alias("id"), F.col("name.text_key").alias("tk")), F.expr("doc_id <=> id and text_key <=> tk"))
        .select("node", "text").dropDuplicates(["node"]), "near-texts",
    )
    roots = components(verified(pairs, texts, idf, similarity))

    roots = crowded_links(members.select("key", F.col("b").alias("node")), roots, texts, idf, similarity)

    named = _rooted(nodes.select("node", "name"), roots)
    first = named.groupBy("root").agg(F.min("name").alias("first"))
    by_node = named.join(first, "root").select("node", "first")
    return signed.select("doc_id", "text_key", "node").join(by_node, "node", "left").select(
        "doc_id", "text_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc"),
        F.when(F.col("node").isNull(), F.col("text_key")).otherwise(F.col("first.text_key")).alias("class_key"),
    )


def stage(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the least (doc_id, text); all columns stay."""
    classes = materialised(near_classes(docs, similarity), "near-classes")
    gone = classes.where("not (doc_id <=> class_doc and text_key <=> class_key)").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    kept = keyed.join(gone, F.expr("cast(doc_id as bigint) <=> __id and __text_key <=> __key"), "left_anti")
    repeated = classes.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "__text_key"])
    return kept.select(*[f"`{c}`" for c in docs.columns])
