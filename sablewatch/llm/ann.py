"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node, so copies cost nothing and cannot crowd a neighbour list. The graph
starts from blocks of nodes that lie together in a few random orders. In each round the neighbours of
a node, both ways, propose each other (neighbours of neighbours) where at least one of the two edges is new:
a pair that met is not tried again, so rounds get cheaper. Lists keep the best, until few edges
are new. A query starts at its best pivots, of which a larger table has more, and walks the graph, a
bounded beam of the best nodes at a time, until all nodes of its beam have been expanded; what it
found is scored exactly.

Rounds and walk shuffle ids, packed: what goes from one task to the nodes of another is one row of bytes, and
is sorted and merged by numpy there. Vectors are broadcast to the rounds up to a checked size; beyond it they come
to the nodes that ask for them. In the walk queries travel, and are scored where the vectors lie.

Neighbour lists, reverse lists, blocks, pivots and beams have fixed lengths, as the method has
it; every node is in the graph.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import per_worker, slices
from sablewatch.session import delete, materialised, shared_dir, shuffles_dropped

NEIGHBOURS, REVERSE, ORDERS, BLOCK = 24, 16, 4, 128
#: New edges of a node, each way, that take part in one round; the others wait for the next.
SAMPLE = 12
BEAM, EXPAND = 320, 64
#: The beam is for so many nodes; it grows with the fourth root of their number beyond that.
BEAM_NODES = 10_000
#: All unit vectors are broadcast if they take at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Rounds end when a smaller share of the graph's edges is new.
STILL = 0.001
#: Pivots at least, and for each square root of the number of nodes.
PIVOTS, PIVOTS_A_ROOT = 1024, 4

#: Vectors of queries that walk together, at most; more queries walk in turns.
QUERY_BYTES = 32 << 20
#: Vectors that meet in a task at most, from which follows the number of parts nodes lie in; parts of a small table.
PART_BYTES, PARTS = 32 << 20, 12

EDGE = "u bigint, v bigint, s double"
#: ``n`` rows for one part, column after column.
PARCEL = "part int, kind int, n int, payload binary"


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id, vec, key: rows with an id and a finite vector that is not zero."""
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    bad = "exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))"

    def keyed(batches):
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            keys = [hashlib.sha256(flat[a:b].tobytes()).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "vec", "key"])

    return (
        rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))
        .where(f"vec_id is not null and vec is not null and not {bad} and exists(vec, x -> x <> 0)")
        .mapInArrow(keyed, "vec_id bigint, vec array<double>, key binary")
    )


def _dimension(usable: DataFrame) -> int:
    """The commonest dimension, of equally common ones the least; 0 without rows."""
    most = usable.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return most.dim if most else 0


def _replaced(new: DataFrame, name: str, old: list[str]) -> DataFrame:
    """``new`` written to the shared folder; the generation written before it is deleted."""
    spark = new.sparkSession
    path = shared_dir(spark, name)
    new.write.parquet(path)
    for gone in old:
        delete(spark, gone)
    old[:] = [path]
    return spark.read.schema(new.schema).parquet(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _shuffled(u: np.ndarray, v: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each pair, by which equal ones are put in order."""
    return _mixed(_mixed(u.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)) ^ v.astype(np.uint64))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _ranks(groups: tuple, order: tuple) -> np.ndarray:
    """Place of each row in its group by the keys of ``order``, from 0."""
    at = np.lexsort((*order[::-1], *groups[::-1]))
    first = _changes(*[g[at] for g in groups])
    here = np.arange(len(at))
    out = np.empty(len(at), np.int64)
    out[at] = here - np.maximum.accumulate(np.where(first, here, 0))
    return out


def _merged(u: np.ndarray, v: np.ndarray, merges: list[tuple[np.ndarray, np.ufunc]]) -> list[np.ndarray]:
    """u, v and the merged columns, one row for each pair, in order."""
    at = np.lexsort((v, u))
    u, v = u[at], v[at]
    first = np.flatnonzero(_changes(u, v))
    return [u[first], v[first], *[f.reduceat(x[at], first) if len(first) else x for x, f in merges]]


def _labels(spark: SparkSession, parts: int) -> np.ndarray:
    """A number for each part, such that Spark's hash sends each to a task of its own."""
    ids = spark.range(0, 24 * parts + 64, 1, 1).select("id", F.expr(f"pmod(hash(cast(id as int)), {parts})").alias("at"))
    found = {r["at"]: r["id"] for r in ids.groupBy("at").agg(F.min("id").alias("id")).collect()}
    return np.array([found.get(i, i) for i in range(parts)], np.int32)


def _parcels(parts: np.ndarray, to: np.ndarray, *columns: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of columns packed for the parts in which the nodes ``to`` lie."""
    part = (_mixed(to) >> np.uint64(8)) % np.uint64(len(parts))
    at = np.argsort(part, kind="stable")
    part, columns = part[at], [c[at] for c in columns]
    cuts = [*np.flatnonzero(_changes(part)), len(part)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([parts[int(part[a])] for a, _ in spans], pa.int32()), pa.array([kind] * len(spans), pa.int32()), pa.array([b - a for a, b in spans], pa.int32()),
         pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in spans], pa.binary())], names=["part", "kind", "n", "payload"])


def _opened(batches, *kinds: tuple) -> list[list[np.ndarray]]:
    """The columns, of the given types, of all parcels of each kind."""
    found = [[[np.empty(0, t)] for t in types] for types in kinds]
    for batch in batches:
        for kind, n, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            raw, at = payload.as_buffer(), 0
            for column, t in zip(found[kind], kinds[kind], strict=True):
                column.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
    return [[np.concatenate(c) for c in columns] for columns in found]


def _rows(batches, rows: int = 1 << 16):
    """Batches joined to larger ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _packed(rows: DataFrame, parts: np.ndarray, by: int = 0, kind: int = 0) -> DataFrame:
    """The rows, of numbers and truth values, as parcels for the parts of column ``by``."""

    def run(batches):
        for batch in _rows(batches):
            columns = _columns(batch)
            yield _parcels(parts, columns[by], *columns, kind=kind)

    return rows.mapInArrow(run, PARCEL)


def _delivered(parcels: DataFrame, parts: np.ndarray) -> DataFrame:
    return parcels.repartition(len(parts), "part")


def _parts(rows: DataFrame) -> np.ndarray:
    """Parts where nothing is known of the table."""
    return _labels(rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dots(a: np.ndarray) -> np.ndarray:
    return a @ a.T


def _unpacked(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from bytes: the width of a component, then components."""
    kind = f"<f{raw[0][0]}" if raw else "<f8"
    return _normed(np.frombuffer(b"".join(r[1:] for r in raw), kind).reshape(len(raw), -1))


def _normed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column: pa.Array) -> np.ndarray:
    return _unpacked(column.to_pylist())


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "s"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: DataFrame, width: int) -> DataFrame:
    """node, unit: the components as floats of ``width`` bytes, for the graph and the walk. Four
    are exact where the table holds floats; doubles are scaled to at most 1. One dimension is expected."""

    def run(batches):
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            x = (x if width == 4 else x / np.abs(x).max(axis=1, keepdims=True)).astype(f"<f{width}")
            out = [bytes([width]) + row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "unit"])

    return rows.select("node", "vec").mapInArrow(run, "node bigint, unit binary")


def _width(rows: DataFrame) -> int:
    return 4 if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else 8


def _first_lists(units: DataFrame, order: int) -> DataFrame:
    """Best neighbours inside blocks of nodes next to each other in one random order."""

    def place(batches):
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            planes = np.random.default_rng(order).standard_normal((13, x.shape[1]))
            got = x @ planes.T
            bits = (got[:, :12] > 0) @ (1 << np.arange(12))
            at = bits.astype(np.float64) + 1 / (1 + np.exp(-got[:, 12]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.float64())], names=["node", "unit", "at"])

    def blocks(batches):
        for batch in slices(batches, BLOCK):
            if batch.num_rows < 2:
                continue
            ids, s = np.array(batch.column(0).to_pylist()), _dots(_vectors(batch.column(1)))
            np.fill_diagonal(s, -2)
            k = min(NEIGHBOURS, len(ids) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield _edges(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    placed = units.mapInArrow(place, "node bigint, unit binary, at double")
    return placed.repartitionByRange("at").sortWithinPartitions("at", "node").mapInArrow(blocks, EDGE)


def _best(edges: DataFrame, n: int = NEIGHBOURS, parts: np.ndarray | None = None, more: DataFrame | None = None) -> DataFrame:
    """The best ``n`` of each u; ``new`` (an edge not known before) holds if it does for all equal edges.
    ``more`` are edges that come as parcels."""
    parts = _parts(edges) if parts is None else parts

    def run(batches):
        [(u, v, s, new)] = _opened(batches, ("i8", "i8", "f8", "?"))
        u, v, s, new = _merged(u, v, [(s, np.maximum), (new, np.logical_and)])
        kept = _ranks((u,), (-s, _shuffled(u, v), v)) < n
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (u, v, s, new)], names=["u", "v", "s", "new"])

    sent = _packed(edges.select("u", "v", "s", "new"), parts)
    return _delivered(sent if more is None else sent.unionByName(more), parts).mapInArrow(run, f"{EDGE}, new boolean")


class Vectors:
    """Unit vectors by node: in every worker where they are few, else joined to the rows that need them."""

    def __init__(self, units: DataFrame, most: int | None = None) -> None:
        self.units, self.shared, self.token = units, None, uuid.uuid4().hex
        length = F.length("unit")
        size, self.nodes, widest, self.width = units.agg(
            F.coalesce(F.sum(length + 8), F.lit(0)), F.count(F.lit(1)), F.max(length), F.max(F.expr("int(conv(hex(substring(unit, 1, 1)), 16, 10))"))
        ).first()
        #: Bytes of the components of a vector, and parts in which the nodes lie: neighbours of a part's nodes
        #: are at most so many vectors as a task may hold.
        self.bytes = (widest or 1) - 1
        shared = 0 < size <= (BROADCAST_BYTES if most is None else most)
        most_nodes = max(64, PART_BYTES // ((2 * NEIGHBOURS + SAMPLE) * (32 + (0 if shared else self.bytes))))
        self.parts = _labels(units.sparkSession, max(1, min(PARTS, self.nodes // 256), -(-self.nodes // most_nodes)))
        if shared:
            rows = units.orderBy("node").collect()
            self.shared = units.sparkSession.sparkContext.broadcast((np.array([r.node for r in rows]), [bytes(r.unit) for r in rows]))

    def parcels(self, kind: int, parts: np.ndarray | None = None) -> DataFrame:
        """node and the components of its vector, for the part it lies in."""
        parts, size = self.parts if parts is None else parts, self.bytes

        def run(batches):
            for batch in _rows(batches, 4096):
                raw = np.frombuffer(b"".join(r[1:] for r in batch.column(1).to_pylist()), f"V{size}")
                nodes = batch.column(0).to_numpy()
                yield _parcels(parts, nodes, nodes, raw, kind=kind)

        return self.units.select("node", "unit").mapInArrow(run, PARCEL)

    def reader(self):
        """A function of (nodes, components of their vectors) to a matrix of unit vectors; made once in a task."""
        if self.shared is None:
            kind = f"<f{self.width}"
            return lambda nodes, raw: _normed(raw.view(kind).reshape(len(raw), -1))
        ids, raw = self.shared.value
        known = per_worker("unit vectors", self.token, lambda: _unpacked(raw))
        return lambda nodes, _: known[np.searchsorted(ids, nodes)]

    def __getstate__(self):
        return {"shared": self.shared, "token": self.token, "width": self.width}


def _members(edges: DataFrame, salt: int, parts: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """u, v, active: who meets in a round around each node that has an active edge, and the edges with ``active``, whether
    a new edge takes part. A node others list very often takes part in a bounded number of them."""
    parts = _parts(edges) if parts is None else parts

    def opened(batches):
        [(u, v, s, new)] = _opened(batches, ("i8", "i8", "f8", "?"))
        return u, v, s, new, new & (_ranks((u, new), (_shuffled(u, v, salt), v)) < SAMPLE)

    def mark(batches):
        u, v, s, new, active = opened(batches)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u, v, s, new, active)], names=["u", "v", "s", "new", "active"])

    def both_ways(batches):
        u, v, _, new, active = opened(batches)
        used = ~new | active
        u, v, active = u[used], v[used], active[used]
        yield _parcels(parts, u, u, v, active, kind=0)
        yield _parcels(parts, v, v, u, active, kind=1)

    def meet(batches):
        (u, v, active), (to, back, stirs) = _opened(batches, ("i8", "i8", "?"), ("i8", "i8", "?"))
        few = _ranks((to, stirs), (_shuffled(to, back, salt), back)) < np.where(stirs, SAMPLE, REVERSE)
        u, v, active = _merged(np.concatenate([u, to[few]]), np.concatenate([v, back[few]]), [(np.concatenate([active, stirs[few]]), np.logical_or)])
        first = _changes(u)
        stirred = np.logical_or.reduceat(active, np.flatnonzero(first))[np.cumsum(first) - 1] if len(u) else active
        yield pa.RecordBatch.from_arrays([pa.array(c[stirred]) for c in (u, v, active)], names=["u", "v", "active"])

    lists = _delivered(_packed(edges.select("u", "v", "s", "new"), parts), parts)
    marked = lists.mapInArrow(mark, f"{EDGE}, new boolean, active boolean")
    return _delivered(lists.mapInArrow(both_ways, PARCEL), parts).mapInArrow(meet, "u bigint, v bigint, active boolean"), marked


def _proposals(members: DataFrame, edges: DataFrame, vectors: Vectors, packed: bool = False) -> DataFrame:
    """u, v, s, or parcels of new edges: around every node its members propose each other where one edge is active and the pair is better than
    the worst of a full list. The nodes ask their members for that worst, and for vectors where those are not broadcast."""
    parts, joined = vectors.parts, vectors.shared is None
    raw = f"V{vectors.bytes if joined else 1}"

    def answer(batches):
        (u, v, active), (node, s), (at, units) = _opened(batches, ("i8", "i8", "?"), ("i8", "f8"), ("i8", raw))
        order = np.lexsort((s, node))
        node, s = node[order], s[order]
        first = np.flatnonzero(_changes(node))
        full = np.diff(np.append(first, len(node))) >= NEIGHBOURS
        node, worst = np.append(node[first], np.iinfo(np.int64).max), np.append(np.where(full, s[first], -2.0), -2.0)
        place = np.searchsorted(node, v)
        worst = np.where(node[place] == v, worst[place], -2.0)
        order = np.argsort(at)
        at, units = at[order], units[order]
        for a in range(0, len(u), 1 << 16):
            span = slice(a, a + (1 << 16))
            own = units[np.searchsorted(at, v[span])] if joined else np.zeros(len(u[span]), "V1")
            yield _parcels(parts, u[span], u[span], v[span], active[span], worst[span], own)

    def propose(batches):
        [(u, v, active, worst, units)] = _opened(batches, ("i8", "i8", "?", "f8", raw))
        read, order = vectors.reader(), np.lexsort((v, u))
        v, active, worst, units = v[order], active[order], worst[order], units[order]
        starts = np.flatnonzero(_changes(u[order]))
        sizes, found = np.diff(np.append(starts, len(u))), []
        for a in range(0, len(starts), 64):
            n = sizes[a : a + 64]
            places = np.arange(n.max())
            at, held = starts[a : a + 64, None] + places, places < n[:, None]
            at[~held] = starts[a]
            x = read(v[at.ravel()], units[at.ravel()]).reshape(*at.shape, -1)
            s, stirs = x @ x.transpose(0, 2, 1), active[at] & held
            tried = (stirs[:, :, None] | stirs[:, None]) & held[:, :, None] & held[:, None] & (s > worst[at][:, :, None])
            tried[:, places, places] = False
            hits = np.flatnonzero(tried)
            pair, width, near = hits // len(places), len(places), v[at].ravel()
            found.append((near[pair], near[pair // width * width + hits % width], s.ravel()[hits]))
        if found:
            u, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
            # Pairs that met around several nodes of this task go on once.
            u, v, s = _merged(u, v, [(s, np.maximum)])
            yield _parcels(parts, u, u, v, s, np.ones(len(u), bool)) if packed else _edges(u, v, s)

    asked = _packed(members.select("u", "v", "active"), parts, by=1).unionByName(_packed(edges.select("u", "s"), parts, kind=1))
    if joined:
        asked = asked.unionByName(vectors.parcels(2))
    answers = _delivered(asked, parts).mapInArrow(answer, PARCEL)
    return _delivered(answers, parts).mapInArrow(propose, PARCEL if packed else EDGE)


def build_graph(vectors: Vectors, still: float = STILL) -> DataFrame:
    """u, v, s: at most NEIGHBOURS best known neighbours of every node; rounds go on until the
    share of new edges is at most ``still``. Lists only improve, and what met does not meet again, so they end."""
    edges, written = _first_lists(vectors.units, 0), []
    for order in range(1, ORDERS):
        edges = edges.unionByName(_first_lists(vectors.units, order))
    edges = _replaced(_best(edges.withColumn("new", F.lit(True)), parts=vectors.parts), "nn-edges", written)
    salt = 0
    while True:
        members, marked = _members(edges, salt, vectors.parts)
        known = marked.select("u", "v", "s", (F.col("new") & ~F.col("active")).alias("new"))
        fresh = _proposals(members, edges, vectors, packed=True)
        edges = _replaced(_best(known, parts=vectors.parts, more=fresh), "nn-edges", written)
        total, new = edges.agg(F.count(F.lit(1)), F.count(F.when(F.col("new"), 1))).first()
        salt += 1
        if new <= still * total:
            return edges.select("u", "v", "s")


def _both_ways(edges: DataFrame) -> DataFrame:
    """u, v: neighbour lists joined by at most REVERSE nodes that list u themselves."""
    order = Window.partitionBy("u").orderBy("k", "v")
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.xxhash64("u", "v").alias("k"))
    back = back.withColumn("n", F.row_number().over(order)).where(F.col("n") <= REVERSE).select("u", "v")
    return edges.select("u", "v").unionByName(back).distinct()


def greedy_search(queries: DataFrame, vectors: Vectors, edges: DataFrame) -> DataFrame:
    """q, v: the beam of every query (q, unit) when all its nodes have been expanded."""
    units = vectors.units
    spark, n = units.sparkSession, vectors.nodes
    wanted, width = max(PIVOTS, int(PIVOTS_A_ROOT * n**0.5)), int(BEAM * max(1.0, n / BEAM_NODES) ** 0.25)
    pivots = units.orderBy(F.xxhash64("node"), "node").limit(wanted).collect() if n else []
    if not pivots:
        return units.select(F.col("node").alias("q"), F.col("node").alias("v"))
    shared = spark.sparkContext.broadcast(([r.node for r in pivots], [bytes(r.unit) for r in pivots]))

    def enter(batches):
        ids = np.array(shared.value[0])
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            own, at, s = _vectors(batch.column(1)), np.zeros((batch.num_rows, 0), np.int64), np.zeros((batch.num_rows, 0))
            for start in range(0, len(ids), PIVOTS):
                block = own @ _unpacked(shared.value[1][start : start + PIVOTS]).T
                s = np.hstack([s, block])
                at = np.hstack([at, np.broadcast_to(np.arange(start, start + block.shape[1]), block.shape)])
                k = min(width, s.shape[1])
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s, at = np.take_along_axis(s, best, 1), np.take_along_axis(at, best, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(batch.column(0).to_pylist()), s.shape[1]), pa.int64()), pa.array(ids[at].ravel(), pa.int64()),
                 pa.array(s.ravel(), pa.float64())], names=["q", "v", "s"])

    size, asked = queries.agg(F.coalesce(F.sum(F.length("unit")), F.lit(0)), F.count(F.lit(1))).first()
    turns, found, near = max(1, -(-size // QUERY_BYTES)), None, NEIGHBOURS + REVERSE
    # A task holds the lists and vectors of its nodes, and the pairs of query and node of a step.
    held = n * (3 * vectors.bytes + 16 * near) + -(-asked // turns) * EXPAND * near * 24
    parts = _labels(spark, max(1, min(PARTS, n // 256), -(-held // PART_BYTES)))
    adjacent = materialised(_packed(_both_ways(edges), parts, kind=1), "nn-adjacent")
    placed = materialised(vectors.parcels(1, parts), "nn-placed")
    for turn in range(turns):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(turns)) == turn) if turns > 1 else queries
        beam = _walked(some, some.select("q", "unit").mapInArrow(enter, "q bigint, v bigint, s double"), vectors, parts, adjacent, placed, width)
        found = beam if found is None else found.unionByName(beam)
    return found


def _walked(
    queries: DataFrame, entries: DataFrame, vectors: Vectors, parts: np.ndarray, adjacent: DataFrame, placed: DataFrame, width: int
) -> DataFrame:
    """q, v: the beams of queries that walk together from their entries, when all their nodes have been expanded.

    In a step a query sends the nodes it expands, with the score a node must reach to enter its beam, to where
    their neighbours are listed; from there the neighbours' ids go to where their vectors lie, and
    scores that are good enough come back.
    """
    spark, size, kind = queries.sparkSession, vectors.bytes, f"<f{vectors.width}"
    rows = queries.select("q", "unit").orderBy("q").collect()
    token, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((np.array([r.q for r in rows], np.int64), [bytes(r.unit) for r in rows]))
    state = ("i8", "i8", "f8", "?")

    def front(batches):
        for batch in batches:
            q, v, s, is_open = _opened([batch], (), state)[1]
            first = np.flatnonzero(_changes(q))  # a query's rows lie together, best first
            n = np.diff(np.append(first, len(q)))
            least = np.repeat(np.where(n >= width, s[first + n - 1], -2.0), n)
            going = is_open & (_ranks((q, is_open), (-s, _shuffled(q, v), v)) < EXPAND)
            yield _parcels(parts, v[going], v[going], np.searchsorted(shared.value[0], q[going]).astype(np.int32), least[going])

    def spread(batches):
        (u, q, least), (node, near) = _opened(batches, ("i8", "i4", "f8"), ("i8", "i8"))
        order = np.argsort(node, kind="stable")
        node, near = node[order], near[order]
        for a in range(0, len(u), 1 << 14):
            at, wanted, bound = u[a : a + (1 << 14)], q[a : a + (1 << 14)], least[a : a + (1 << 14)]
            low, n = np.searchsorted(node, at), np.searchsorted(node, at, "right") - np.searchsorted(node, at)
            v = near[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            wanted, v, bound = _merged(np.repeat(wanted, n), v, [(np.repeat(bound, n), np.maximum)])
            yield _parcels(parts, v, v, wanted, bound)

    def score(batches):
        (v, q, least), (node, units) = _opened(batches, ("i8", "i4", "f8"), ("i8", f"V{size}"))
        ids, raw = shared.value
        asked = per_worker("query vectors", token, lambda: _unpacked(raw))
        order = np.argsort(node)
        node, own = node[order], _normed(units[order].view(kind).reshape(len(node), -1)) if len(node) else units
        q, v, least = _merged(q, v, [(least, np.maximum)])
        for a in range(0, len(v), 1 << 15):
            wanted, at, bound = q[a : a + (1 << 15)], v[a : a + (1 << 15)], least[a : a + (1 << 15)]
            s = np.einsum("ij,ij->i", asked[wanted], own[np.searchsorted(node, at)])
            enters = s >= bound
            yield _parcels(parts, ids[wanted[enters]], ids[wanted[enters]], at[enters], s[enters])

    def merge(batches):
        (q, v, s), (known_q, known_v, known_s, is_open) = _opened(batches, ("i8", "i8", "f8"), state)
        # What was expanded before in this step is the front's: the best open ones.
        going = is_open & (_ranks((known_q, is_open), (-known_s, _shuffled(known_q, known_v), known_v)) < EXPAND)
        once = [np.concatenate(x) for x in ((known_q, q), (known_v, v), (known_s, s), (is_open & ~going, np.ones(len(q), bool)))]
        q, v, s, is_open = _merged(once[0], once[1], [(once[2], np.maximum), (once[3], np.logical_and)])
        yield kept(q, v, s, is_open)

    def start(batches):
        q, v, s = _opened(batches, ("i8", "i8", "f8"))[0]
        yield kept(q, v, s, np.ones(len(q), bool))

    def kept(q, v, s, is_open):
        order = np.lexsort((v, _shuffled(q, v), -s, q))
        q, v, s, is_open = (x[order] for x in (q, v, s, is_open))
        best = _ranks((q,), (np.arange(len(q)),)) < width
        q, v, s, is_open = (x[best] for x in (q, v, s, is_open))
        batch = _parcels(parts, q, q, v, s, is_open, kind=1)
        left = [int(np.frombuffer(p.as_buffer(), "?", n, 24 * n).sum()) for n, p in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
        return batch.append_column("open", pa.array(left, pa.int64()))

    def plain(batches):
        for batch in batches:
            q, v, _, _ = _opened([batch], (), state)[1]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v)], names=["q", "v"])

    written: list[str] = []
    names = ["part", "kind", "n", "payload"]
    beam = _replaced(_delivered(_packed(entries, parts), parts).mapInArrow(start, f"{PARCEL}, open bigint"), "nn-beam", written)
    while beam.agg(F.sum("open")).first()[0]:
        fronts = beam.where("open > 0").select(names).mapInArrow(front, PARCEL)
        met = _delivered(fronts.unionByName(adjacent), parts).mapInArrow(spread, PARCEL)
        scored = _delivered(met.unionByName(placed), parts).mapInArrow(score, PARCEL)
        merged = _delivered(scored.unionByName(beam.select(names)), parts).mapInArrow(merge, f"{PARCEL}, open bigint")
        beam = _replaced(merged, "nn-beam", written)
    return beam.select(names).mapInArrow(plain, "q bigint, v bigint")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every query, not itself.

    Both tables have vec_id and embedding. Null, zero and not finite vectors, those of another dimension than
    the commonest of ``rows`` (of equal ones the least) and rows without an id take no part; repeated rows
    count once; ties go to the smaller vec_id;
    other columns are not looked at; empty tables give no rows. Scores are cosines of the
    original vectors in double precision.
    """
    with shuffles_dropped(rows.sparkSession):
        return _nearest(rows, queries, k)


def _nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    usable = materialised(_usable(rows), "nn-rows")
    of_dimension = F.size("vec") == _dimension(usable)
    usable = usable.where(of_dimension)
    order = Window.partitionBy("key").orderBy("vec_id")
    copies = usable.select("key", "vec_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    nodes = materialised(usable.groupBy("key").agg(F.min("vec_id").alias("node"), F.first("vec").alias("vec")), "nn-nodes")
    units = materialised(_unit(nodes, _width(rows)), "nn-units")
    asked = materialised(_usable(queries).where(of_dimension).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "node"), "nn-asked")
    starts = materialised(_unit(asked, _width(queries)).withColumnRenamed("node", "q"), "nn-starts")
    vectors = Vectors(units)
    found = greedy_search(starts, vectors, build_graph(vectors))

    def exact(batches):
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            # Scaled first: squares of very large or small components leave the range.
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (_matrix(batch.column(2)), _matrix(batch.column(3))))
            xy, xx, yy = (np.einsum("ij,ij->i", a, b) for a, b in ((x, y), (x, x), (y, y)))
            out = xy / (np.sqrt(xx) * np.sqrt(yy))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["query_id", "node", "score"])

    pairs = found.join(nodes.select(F.col("node").alias("v"), "vec"), "v").join(asked.select(F.col("node").alias("q"), F.col("vec").alias("own")), "q")
    scored = pairs.select("q", "v", "own", "vec").mapInArrow(exact, "query_id bigint, node bigint, score double")
    members = nodes.select("node", "key").join(copies, "key").select("node", "vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        scored.join(members, "node").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
