"""Repair of conversations by divide and conquer over four states.

Roles in order must read ``(s?(ua)+)?`` by their initials: nothing yet, after s, after u, after a.
A row is one symbol of a small alphabet; for each state before it and each state after it the
symbol has a cheapest edit. A stretch of rows composes to the same kind of table, so a table stands
for a row, a block of rows or a whole run of blocks. Forward and backward cost vectors meet in
the middle of a stretch, the cheapest crossing (of equal ones that with the least audit) is kept,
and both halves go on alone: memory is linear in the rows, however long a conversation is.

Which audit is least can be told from the left halves alone. From a given state each edit leads to
one state only, and what is inserted before a row belongs to that row, so left audits end with
the edit of the same row: none is the beginning of another. Vectors therefore carry, next to the
costs, the order of their four audits instead of the audits.
"""

from __future__ import annotations

import hashlib
from collections import deque, namedtuple
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.session import materialised

#: Rows of a block; a conversation's blocks are solved side by side.
BLOCK = 4096

# --- fixed values: edit costs, the roles' automaton, what counts as a blank -----------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: state -> the state each initial leads to
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state -> state after one inserted or changed role (user or assistant)
TURN = (2, 2, 3, 2)
#: cheapest inserts that end a conversation in a state
ENDING = ("", "II", "I", "")
BLANKS, STOPS = " \t\n\x0b\f\r", (".", "!", "?")
ROLES = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
# --------------------------------------------------------------------------------------

STATES = range(4)
FAR = 1 << 60

#: Symbols of a row: "d" must go; otherwise its role's initial ("x" for any other role), upper
#: case where the text is truncated.
SYMBOLS = "dsuaxSUAX"


def remembered(fn, most: int = 1 << 16):
    """The function with its results kept; travels to workers by value, unlike the library's caches."""
    known: dict = {}

    def call(*args):
        got = known.get(args)
        if got is None:
            if len(known) >= most:
                known.clear()
            got = known[args] = fn(*args)
        return got

    return call


def _edits(symbol: str):
    """(state before, state after, cost, audit) of each edit of one row with its inserts before."""
    for p in STATES:
        state = p
        for inserts in range(3):
            cost, audit = INSERT * inserts, "I" * inserts
            yield p, state, cost + DELETE, audit + "D"
            if symbol != "d":
                extra = TRUNCATED if symbol.isupper() else 0
                if symbol.lower() in MOVES[state]:
                    yield p, MOVES[state][symbol.lower()], cost + KEEP + extra, audit + "K"
                yield p, TURN[state], cost + REROLE + extra, audit + "R"
            state = TURN[state]


@remembered
def _row(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p, s, cost, audit in _edits(symbol):
        best[p, s] = min(best.get((p, s), (FAR, "")), (cost, audit))
    return best


@remembered
def row_table(symbol: str) -> tuple:
    """Per state before: costs to each state after, and the order of their audits."""
    best, table = _row(symbol), []
    for p in STATES:
        costs = tuple(best.get((p, s), (FAR, ""))[0] for s in STATES)
        order = sorted(STATES, key=lambda s: (best.get((p, s), (FAR, "~"))[1], s))
        table.append((costs, tuple(order.index(s) for s in STATES)))
    return tuple(table)


@remembered
def extended(vector: tuple, table: tuple) -> tuple:
    """The vector (costs, order of audits) after one more table, costs from their least on.

    Between different states before, the order there decides; within one, that of the table.
    """
    costs, order = vector
    found = []
    for s in STATES:
        found.append(min((costs[p] + table[p][0][s], order[p], table[p][1][s]) for p in STATES))
    rank = sorted(STATES, key=lambda s: (found[s][0] >= FAR, found[s][1:], s))
    return tuple(min(f[0], FAR) for f in found), tuple(rank.index(s) for s in STATES)


@remembered
def _preceded(costs: tuple, table: tuple) -> tuple:
    """Costs to the end of a stretch with one more table before it."""
    return tuple(min(min(table[p][0][s] + costs[s] for s in STATES), FAR) for p in STATES)


def _shift(costs: tuple) -> tuple[int, tuple]:
    """A vector's least cost and the vector from there on; few different ones remain, so steps are remembered."""
    least = min(costs)
    return least, tuple(c if c >= FAR else c - least for c in costs)


def _start(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in STATES), tuple(STATES)


def forward(tables, state: int) -> tuple[int, tuple]:
    """Least cost, and the vector from it on, of all ways from a state through the tables."""
    base, vector = 0, _start(state)
    for table in tables:
        costs, order = extended(vector, table)
        more, costs = _shift(costs)
        base, vector = base + more, (costs, order)
    return base, vector


def backward(tables, ends: tuple) -> tuple:
    """Costs from each state through the tables, given those behind them; the least is 0."""
    _, costs = _shift(ends)
    for table in reversed(tables):
        _, costs = _shift(_preceded(costs, table))
    return costs


def composed(tables) -> tuple:
    """The table of a stretch."""
    out = []
    for p in STATES:
        base, (costs, order) = forward(tables, p)
        out.append((tuple(c if c >= FAR else c + base for c in costs), order))
    return tuple(out)


def crossings(tables, state: int, ends: tuple) -> list[int]:
    """The state behind each table on the cheapest, then audit-least way from ``state`` to an end.

    ``ends`` are the costs behind the last table by state; equal sums go to the least audit.
    """
    out = [0] * len(tables)
    work = [(0, len(tables), state, ends)]
    while work:
        lo, hi, before, after = work.pop()
        if hi - lo == 0:
            continue
        mid = (lo + hi + 1) // 2
        _, (costs, order) = forward(tables[lo:mid], before)
        rest = backward(tables[mid:hi], after)
        met = min(STATES, key=lambda s: (min(costs[s] + rest[s], FAR), order[s]))
        out[mid - 1] = met
        if mid - lo > 1:
            # The way now ends in the crossing: the left half is solved to it exactly.
            work.append((lo, mid - 1, before, _preceded(_start(met)[0], tables[mid - 1])))
        work.append((mid, hi, met, after))
    return out


def closing() -> tuple:
    """Costs of ending a conversation by state."""
    return tuple(INSERT * len(e) for e in ENDING)


def audit_of(symbols: str, state: int, end: int) -> str:
    """The cheapest, of equal ones the least, edits of a block between two states."""
    states = crossings([row_table(s) for s in symbols], state, _start(end)[0])
    return "".join(_row(c)[p, s][1] for c, p, s in zip(symbols, [state, *states], states))


# --- rows ---------------------------------------------------------------------------


def _plain(conversations: DataFrame, *more) -> DataFrame:
    spaces = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(*[F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")], *spaces, *more)


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form ``repair`` takes: nulls in role and text as one space."""
    return _plain(conversations, F.lit(1).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows left by the fixed damage, which the crc32 of ``conv_id:turn`` chooses (nulls as one
    space): dropped, emptied, without stops, twice, or said by the user."""
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.col("kind")
    return _plain(conversations, (F.crc32(spelled.cast("binary")) % 20).alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_KEY = ["conv_id", "turn", "role", "digest"]


def _symbols(rows: DataFrame) -> DataFrame:
    """One row for all copies: key, their number, whether the text is blank, its symbol and initial."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.left("role", F.lit(1))
    narrow = (
        rows.select(
            "conv_id", "turn", "role", F.md5("text").alias("digest"), "copies", (last == "").alias("blank"),
            (~last.isin(*STOPS)).alias("open"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        )
        .groupBy(*_KEY).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("blank", "open", "initial")])
    )
    # A text's first turn: nulls come first, which an order of (is not null, turn) says.
    seen = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = ~F.col("first").getField("turn").eqNullSafe(F.col("turn"))
    symbol = F.when(F.col("blank") | again, "d").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    return narrow.join(seen, same).select(*_KEY, "copies", "blank", symbol.alias("symbol"), "initial")


_BLOCK_FIELDS = (
    "conv_id long, turn long, role string, digest string, part int, number long, symbols string, table array<long>, blank long, "
    "duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
)


class _Block:
    """Symbols and counts of consecutive rows of one conversation."""

    def __init__(self, row) -> None:
        self.key = row.conv_id, row.turn, row.role, row.digest
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head, self.tail, self.low, self.high = row.initial, "", None, None

    def add(self, row, symbol: str) -> None:
        self.symbols.append(symbol)
        if row.blank:
            self.blank += 1
        elif symbol == "d":
            self.duplicate += 1
        elif symbol.isupper():
            self.truncated += 1
        self.illegal += bool(self.tail) and self.tail + row.initial not in LEGAL
        self.tail = row.initial
        if row.turn is not None and row.turn != self.high:
            self.turns += 1
            self.low, self.high = row.turn if self.low is None else self.low, row.turn

    def record(self, part: int, number: int) -> tuple:
        table = [x for costs, order in composed([row_table(s) for s in self.symbols]) for x in (*costs, *order)]
        return (
            *self.key, part, number, "".join(self.symbols), table, self.blank, self.duplicate, self.truncated, self.illegal,
            self.head, self.tail, self.low, self.high, self.turns,
        )


def _rows(batches):
    for batch in batches:
        make = namedtuple("Row", batch.schema.names)._make
        yield from map(make, zip(*(c.to_pylist() for c in batch.columns)))


def _batches(rows, fields: str, size: int = 500):
    """Tuples packed into record batches of the named fields."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _cut(block: int):
    """Sorted rows to blocks; a block ends with its conversation, its task, or when it is full."""

    def blocks(batches):
        part, number, own = TaskContext.get().partitionId(), 0, None
        for row in _rows(batches):
            for k in range(row.copies):
                if own is not None and (len(own.symbols) >= block or row.conv_id != own.key[0]):
                    yield own.record(part, number)
                    own, number = None, number + 1
                own = own or _Block(row)
                own.add(row, "d" if k else row.symbol)
        if own is not None:
            yield own.record(part, number)

    return lambda batches: _batches(blocks(batches), _BLOCK_FIELDS)


def _meet(batches):
    """States at the borders of each conversation's blocks."""

    def borders():
        for _, own in groupby(_rows(batches), key=lambda r: r.conv_id):
            own = list(own)  # a table of 32 numbers for each 4096 rows
            tables = [tuple((tuple(r.table[i:i + 4]), tuple(r.table[i + 4:i + 8])) for i in range(0, 32, 8)) for r in own]
            ends = crossings(tables, 0, closing())
            for r, before, after in zip(own, [0, *ends], ends):
                yield r.part, r.number, before, after

    return _batches(borders(), _BORDERS, 5000)


_BORDERS = "part int, number long, before int, after int"


_COUNTS = "blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
_PIECES = f"conv_id long, turn long, role string, digest string, part int, number long, audit string, {_COUNTS}"


def _solve(batches):
    """Blocks with their borders to audits; short blocks repeat, so their audits are remembered."""
    short = remembered(audit_of)

    def pieces():
        for r in _rows(batches):
            solve = short if len(r.symbols) <= 32 else audit_of
            yield (r.conv_id, r.turn, r.role, r.digest, r.part, r.number, solve(r.symbols, r.before, r.after), r.blank, r.duplicate, r.truncated, r.illegal, r.head, r.tail, r.low, r.high, r.turns)

    return _batches(pieces(), _PIECES)


class _Repair:
    """One conversation's result, made as its sorted pieces and rows pass by."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.audit, self.pending, self.state = conv_id, [], deque(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.tail, self.low, self.high, self.hash, self.lines = "", None, None, hashlib.sha256(), 0

    def piece(self, r) -> None:
        self.audit.append(r.audit)
        self.pending.append(iter(r.audit))
        self.blank, self.duplicate, self.truncated = self.blank + r.blank, self.duplicate + r.duplicate, self.truncated + r.truncated
        self.illegal += r.illegal + (bool(self.tail) and self.tail + r.head not in LEGAL)
        self.tail = r.tail
        if r.low is not None:
            self.turns += r.turns - (r.low == self.high)
            self.low, self.high = r.low if self.low is None else self.low, r.high

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def _turn(self, text: str) -> None:
        self.state = TURN[self.state]
        self._line(ROLES[self.state], text)

    def row(self, r) -> None:
        truncated = r.text.rstrip(BLANKS)[-1:] not in STOPS
        for _ in range(r.copies):
            edit = "I"
            while edit == "I":
                while (edit := next(self.pending[0], None)) is None:
                    self.pending.popleft()
                if edit == "I":
                    self.cost += INSERT
                    self._turn("")
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += TRUNCATED * truncated
            if edit == "R":
                self.cost += REROLE
                self._turn(r.text)
            else:
                self.state = MOVES[self.state][r.role[0]]
                self._line(r.role, r.text)

    def record(self) -> tuple:
        self.audit.append(ENDING[self.state])
        for _ in ENDING[self.state]:
            self.cost += INSERT
            self._turn("")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair(batches):
    """Per conversation a marker, then each block's audit before its first row, then the rows."""

    def done():
        for conv_id, own in groupby(_rows(batches), key=lambda r: r.conv_id):
            repair = _Repair(conv_id)
            for r in own:
                if r.audit is not None:
                    repair.piece(r)
                elif r.text is not None:
                    repair.row(r)
            yield repair.record()

    return _batches(done(), REPAIRED)


def repair(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of ``conversations`` its faults, cheapest edits and the digest of what they leave.

    ``rows`` has conv_id, turn, role, text and copies (``damaged`` or ``undamaged``); no nulls but
    in conv_id and turn. Rows go by turn, nulls first; equal turns by role and the text's md5,
    copies together. A role whose initial is not s, u or a (empty ones too) can be changed or
    deleted, not kept. A null conv_id is a conversation of its own; one without rows gets zeros, an
    empty audit and the digest of nothing; no conversations give no rows. Other columns are not
    looked at.

    Rows are cut into blocks along their order, so a conversation may span any number of tasks; of each block
    only a table of 32 numbers meets the others of its conversation. The audit is one value of a row and the
    digest runs over all texts in order: only that last step is one task per conversation, as a stream.
    """
    in_order = ["conv_id", "turn", "role", "digest"]
    blocks = materialised(_symbols(rows).repartitionByRange(*in_order).sortWithinPartitions(*in_order).mapInArrow(_cut(block), _BLOCK_FIELDS), "dialogue-blocks")
    borders = (
        blocks.select("conv_id", "part", "number", "table").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
        .mapInArrow(_meet, _BORDERS)
    )
    pieces = blocks.drop("table").join(borders, ["part", "number"]).mapInArrow(_solve, _PIECES)
    marker = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    texts = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.lit(2).alias("kind"), "text", "copies")
    everything = pieces.withColumn("kind", F.lit(1)).unionByName(texts, allowMissingColumns=True).unionByName(marker, allowMissingColumns=True)
    # A marker has a null turn and role, a null turn's piece has a role: nulls first keeps it in front.
    order = ["conv_id", "turn", "role", "digest", "kind", "part", "number"]
    return everything.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair, REPAIRED)
