"""Conversation repair against all edits written out, and against a plain pass over small tables."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from sablewatch.llm import dialogue as d

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, digest string, kind string"


def every_repair(rows):
    """(cost, audit, lines) of every edit of (role, text, must go, truncated) rows with up to two inserts in a gap."""
    legal = re.compile(r"(s?(ua)+)?")
    said = ("user", "assistant")
    gaps = [g for n in range(3) for g in itertools.product(said, repeat=n)]

    def go(i, cost, audit, lines):
        for gap in gaps:
            c, a, ls = cost + 2 * len(gap), audit + "I" * len(gap), lines + [(r, "") for r in gap]
            if i == len(rows):
                if legal.fullmatch("".join(r[:1] or "?" for r, _ in ls)):
                    yield c, a, ls
                continue
            role, text, gone, cut = rows[i]
            yield from go(i + 1, c + 3, a + "D", ls)
            if not gone:
                yield from go(i + 1, c + cut, a + "K", [*ls, (role, text)])
                for r in said:
                    yield from go(i + 1, c + 2 + cut, a + "R", [*ls, (r, text)])

    return min(go(0, 0, "", []), key=lambda x: x[:2])


def step_by_step(rows):
    """The same for longer lists: cheapest and least way to each state, row by row."""
    best = {0: (0, "", "")}
    for role, text, gone, cut in rows:
        new = {}
        for p, (cost, audit, out) in best.items():
            state = p
            for n in range(3):
                ways = [("D", 3, state, "")]
                if not gone:
                    after = d.MOVES[state].get(role[:1])
                    if after is not None:
                        ways.append(("K", cut, after, f"{role}:{text}\n"))
                    ways.append(("R", 2 + cut, d.TURN[state], f"{d.ROLES[d.TURN[state]]}:{text}\n"))
                for edit, more, s, line in ways:
                    way = (cost + 2 * n + more, audit + "I" * n + edit, out + line)
                    new[s] = min(new.get(s, way), way)
                state = d.TURN[state]
                out += f"{d.ROLES[state]}:\n"
        best = new
    done = []
    for s, (cost, audit, out) in best.items():
        more = {0: "", 3: "", 2: "assistant:\n", 1: "user:\nassistant:\n"}[s]
        done.append((cost + 2 * more.count("\n"), audit + "I" * more.count("\n"), out + more))
    return min(done)


def plain(rows, harm, solve):
    """The whole result from Python tuples (conv_id, turn, role, text)."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if harm else 9
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    result = []
    for c, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            blank, again = not last, bool(last) and (role, text) in seen
            cut = bool(last) and not again and last not in ".!?"
            seen.add((role, text))
            counts = [counts[0] + blank, counts[1] + again, counts[2] + cut, 0]
            judged.append((role, text, blank or again, cut))
        counts[3] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, said = solve(judged)
        if not isinstance(said, str):
            said = "".join(f"{r}:{t}\n" for r, t in said)
        result.append((c, gaps, *counts, cost, audit, hashlib.sha256(said[:-1].encode()).hexdigest()))
    return sorted(result, key=lambda r: (r[0] is not None, r[0] or 0))


def solved(rows, made, **more):
    got = d.repair(made, rows, **more).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def test_steps_are_the_best_of_all_edits():
    rng = random.Random(4)
    for n in (0, 1, 2, 2, 3, 3, 3):
        for _ in range(12 if n < 3 else 4):
            rows = []
            for i in range(n):
                gone, cut = rng.random() < 0.25, rng.random() < 0.3
                rows.append((rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", gone, cut and not gone))
            cost, audit, lines = every_repair(rows)
            assert step_by_step(rows) == (cost, audit, "".join(f"{r}:{t}\n" for r, t in lines))


def test_halves_and_blocks_agree_with_steps():
    rng = random.Random(5)
    names = {"s": "s", "u": "u", "a": "a", "x": "x"}
    for n in (0, 1, 2, 3, 5, 8, 13, 40):
        for _ in range(60):
            symbols = "".join(rng.choice(d.SYMBOLS) for _ in range(n))
            want = step_by_step([(names.get(c.lower(), "u"), "", c == "d", c.isupper()) for c in symbols])[1]
            for size in (1, 2, 7, n or 1):
                parts = [symbols[i:i + size] for i in range(0, n, size)]
                ends = d.crossings([d.composed([d.row_table(c) for c in p]) for p in parts], 0, d.closing())
                audit = "".join(d.audit_of(p, a, b) for p, a, b in zip(parts, [0, *ends], ends))
                assert audit + d.ENDING[ends[-1] if ends else 0] == want


def odd_rows():
    rng = random.Random(6)
    rows = [(1, t, r, f"Line {t}.") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(2, t, r, x) for t, r, x in [(0, "assistant", "Hi."), (0, "assistant", "Hi."), (3, "user", None), (None, None, "late"), (9, "", "é!\n\t "), (9, "tool", "?")]]
    rows += [(None, 0, "user", "who"), (None, None, "assistant", "me.\x0c"), (5, None, None, None), (6, 0, "user", "long. " * 20000)]
    rows += [(7, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Same.", "Same", " ", f"n{t}!", f"n{t}"])) for t in range(300)]
    rows += [(8, 4, "user", "Copy.")] * 150 + [(8, 5, "assistant", "Fine.")]
    rows += [(c, 0, "user", "Gone.") for c in range(1000, 1100)]  # some lose their only row
    return rows


def test_small_tables_in_full(spark):
    rows = odd_rows()
    made = table(spark, rows).repartition(5)
    assert solved(made, d.undamaged(made)) == plain(rows, False, step_by_step)
    want = plain(rows, True, step_by_step)
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in want)
    assert solved(made, d.damaged(made)) == want
    # One conversation over many blocks and tasks is the same conversation.
    assert solved(made, d.damaged(made), block=3) == want


def test_no_rows(spark):
    none = table(spark, odd_rows()).where(F.lit(False))
    assert solved(none, d.damaged(none)) == []
