import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import duckdb
import pytest
from compare import check

from shoebox.llm import repair
from shoebox.llm.repair import repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        name = " " if conv is None else str(conv)
        kind = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(name, turn, "user" if kind == 4 else role, text, copy) for copy in range(2 if kind == 3 else 1) if kind]
    return sorted(out, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3], r[4]))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text, _ in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by best-first search over whole edit sequences, pruned by (row, roles so far modulo the grammar)."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        free = "a" if state == "u" else "u"
        word = {"u": "user", "a": "assistant"}[free]
        heappush(heap, (cost + 2, audit + "I", at, free, (*lines, f"{word}:")))
        if at < len(rows):
            role, text, fault = rows[at][2], rows[at][3], faults[at]
            heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if fault in (None, "truncated"):
                extra = fault == "truncated"
                heappush(heap, (cost + 2 + extra, audit + "R", at + 1, free, (*lines, f"{word}:{text}")))
                first = role[:1]
                if first == free or (first == "s" and state == ""):
                    heappush(heap, (cost + extra, audit + "K", at + 1, first, (*lines, f"{role}:{text}")))


def by_definition(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = hurt([r for r in rows if r[0] == conv])
        faults = faults_of(own)
        cost, audit, text = cheapest(own, faults)
        turns = [r[1] for r in own if r[1] is not None]
        first = [r[2][:1] for r in own]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def talks(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", ""], ["tool", "other"]])
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(["Yes.", "no", " ", "A? ", f"word {rng.random()}.", f"cut {rng.random()}"])))
    return rows


@pytest.mark.parametrize("chunk, passes, fan", [(4, 8, 256), (1, 8, 2), (3, 1, 2), (2, 0, 3), (100, 8, 256)])
def test_equals_searching_all_edits(spark, chunk, passes, fan):
    rows = talks(chunk, 25, 24)
    assert rows_of(repair_conversations(spark.createDataFrame(rows, SCHEMA), chunk, passes, fan)) == by_definition(rows)


def test_a_long_conversation_without_convergence(spark):
    rows = [(7, i, "tool" if i < 180 else "user", f"t{i}." if i % 3 else "") for i in range(200)]
    got = rows_of(repair_conversations(spark.createDataFrame(rows, SCHEMA), 4, 3, 4))
    assert got == by_definition(rows)


def test_rank_convergence_ends_a_rerun_early():
    chunk, ran = repair.np.array([3, 6] * 50), []
    step = repair.step_back
    repair.step_back = lambda s, v: ran.append(len(s)) or step(s, v)
    try:
        old, new = repair.END, repair.np.array([4, 4, 0, 2])
        got = repair.fix_up(chunk, old, new)
    finally:
        repair.step_back = step
    assert (got == repair.run_back([chunk], new[None])[0][0]).all() and len(ran) < 2 * len(chunk)


def test_odd_rows_and_sql(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, "assistant", "b!"), (1, 3, "Assistant", "b!"), (1, 3, "assistant", "b!"),
        (2, 0, "user", "x" * 30_000), (2, 1, "assistant", "naïve 東京 😀. "), (2, 9, "assistant", "é?\x0b\t"), (3, 0, "", "."), (3, 1, "s", "s."), (3, 2, "u", "line\nline."), (4, 0, "user", ""),
        *[(i, t, r, "fine.") for i in range(10, 40) for t, r in enumerate(("system", "user", "assistant"))], *[(50 + i, 0, "user", "one.") for i in range(150)],
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(repair_conversations(frame.selectExpr("*", "1 pos", "'x' symbol", "2 conv", "'y' plan")))
    assert got == by_definition(rows) and any(r[7] == "" and r[6] == 0 for r in got)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert check(con, repair.check_sql(), repair_conversations(frame)) is None
    assert repair_conversations(frame.limit(0)).collect() == []


def test_long_conversations_are_ordered_in_slices(spark, monkeypatch):
    rows = talks(9, 3, 60)
    whole = repair.Sequence
    monkeypatch.setattr(repair, "Sequence", lambda *a: whole(*a, bound=10))
    assert rows_of(repair_conversations(spark.createDataFrame(rows, SCHEMA))) == by_definition(rows)
