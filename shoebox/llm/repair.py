"""Repair of conversations by the cheapest edits, by a Viterbi search whose chunks run in parallel until their ranks converge.

The roles of a sound conversation read ``(s?(ua)+)?``; an automaton of four states accepts them. Editing a row is a step of a
min-plus product, and the cost of finishing from each state before a row is the product of all later steps. A conversation is
cut into chunks, each a string of symbols, and the costs run backward through all chunks at once:

1. every chunk starts from a guess, the costs of a conversation that ends there; only the last chunk's is right;
2. in fix-up passes a chunk takes its successor's vector. If that differs from the one it used by a constant only, all its own
   costs are right but for the constant. Otherwise it runs again until its vectors differ from its former ones by a constant;
3. when no chunk has anything to fix, every chunk has right costs but for a constant, which no decision depends on.
   Products that do not lose rank (a long run of foreign roles) would hand a vector on by one chunk a pass; after ``PASSES``
   passes what is unsettled is settled by composing the chunks' matrices in groups of ``FAN``.

Each chunk then traces the ASCII-least cheapest edits from each of the four states it may be entered in; composing the chunks' exits
gives the state it is entered in. No step holds a conversation: groups have at most ``CHUNK`` rows or ``FAN`` chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import map_arrow, materialize
from shoebox.llm.sql_parts import CRC_TABLE, crc32_of
from shoebox.operators.distributed import Sequence
from shoebox.session import materialize_counted

CHUNK = 4  # rows; short, so that a conversation of a few turns is worked on in parallel already
PASSES = 8
FAN = 256
KINDS = 20  # of damage; the first five do something
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 20  # no way
# a symbol is a role (s, u, a, other) times a fault (none, truncated, must go)
SYMBOLS = "abcdefghijkl"
NEXT = (USER, USER, ASSISTANT, USER)  # where the one role goes that may be inserted, or given to a row, in each state
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of (..., 4, 4) with (..., 4, 4)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Per symbol the costs from state to state over one row with what is inserted before it; and the costs of ending."""
    insert = np.full((4, 4), FAR)
    np.fill_diagonal(insert, 0)
    for state, to in enumerate(NEXT):
        insert[state, to] = INSERT
    insert = _product(insert, insert)
    rows = np.full((len(SYMBOLS), 4, 4), FAR)
    for symbol in range(len(SYMBOLS)):
        role, fault = divmod(symbol, 3)
        for state in range(4):
            rows[symbol, state, state] = DELETE
            if fault < 2:
                for to, cost in ((NEXT[state], REROLE), (KEPT.get((state, role), state), 0 if (state, role) in KEPT else FAR)):
                    rows[symbol, state, to] = min(rows[symbol, state, to], cost + fault)
    end = np.array([0, FAR, FAR, 0])
    return _product(insert, rows), (insert + end).min(axis=1)


STEPS, END = _steps()


def step_back(symbols: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(n, 4) costs before rows from (n, 4) costs after them, less their least."""
    out = (STEPS[symbols] + vectors[:, None, :]).min(axis=2)
    return out - out.min(axis=1, keepdims=True)


def run_back(chunks: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray]:
    """Per chunk its (rows + 1, 4) vectors, backward from its end; all chunks step together."""
    n = np.array([len(c) for c in chunks])
    out = [np.empty((k + 1, 4), dtype=np.int64) for k in n]
    vectors = ends.copy()
    for o, v in zip(out, vectors, strict=True):
        o[-1] = v
    for back in range(1, int(n.max(initial=0)) + 1):
        live = np.flatnonzero(n >= back)
        vectors[live] = step_back(np.array([chunks[i][-back] for i in live]), vectors[live])
        for i in live:
            out[i][-1 - back] = vectors[i]
    return out


def fix_up(chunk: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The chunk's start vector when it ends in ``new`` and not in ``old``: both run until they differ by a constant only,
    for then the former start stands.
    """
    old, new = old[None], new[None]
    for at in range(len(chunk) - 1, -1, -1):
        old, new = step_back(chunk[at : at + 1], old), step_back(chunk[at : at + 1], new)
        if (old == new).all():
            return run_back([chunk[:at]], old)[0][0]
    return new[0]


def trace(chunk: np.ndarray, vectors: np.ndarray, state: int, last: bool) -> tuple[str, int, int]:
    """(plan, state left, cost) of the least cheapest edits of a chunk entered in ``state``.

    A plan has a field per row: letters u and a for inserted rows, then K, D, or U and A for a row given that role. The
    last chunk's has one field more, for what is inserted at the end.
    """
    fields, cost = [], 0
    for at, symbol in enumerate(chunk):
        role, fault = divmod(int(symbol), 3)
        here, after, field = vectors[at], vectors[at + 1], ""
        # vectors are less their least: what the step itself costs at least
        base = int((STEPS[symbol] + after).min())
        while True:
            want = int(here[state]) + base
            if DELETE + after[state] == want:
                field, cost = field + "D", cost + DELETE
                break
            if INSERT + here[NEXT[state]] == here[state]:
                state, cost = NEXT[state], cost + INSERT
                field += "ua"[state - USER]
                continue
            kept = KEPT.get((state, role))
            if kept is not None and fault < 2 and fault + after[kept] == want:
                field, state, cost = field + "K", kept, cost + fault
            else:
                state, cost = NEXT[state], cost + REROLE + fault
                field += "UA"[state - USER]
            break
        fields.append(field)
    if last:
        field = ""
        while END[state]:
            state, cost = NEXT[state], cost + INSERT
            field += "ua"[state - USER]
        fields.append(field)
    return "|".join(fields), state, cost


def _symbols(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s.encode(), dtype=np.uint8) - ord(SYMBOLS[0]) for s in column.to_pylist()]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.int64).reshape(len(column), -1)


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values).reshape(len(values), -1).tolist(), pa.list_(pa.int32()))


def settled(chunks: DataFrame, passes: int = PASSES, fan: int = FAN) -> DataFrame:
    """``chunks`` (conv, chunk, symbols, last) with ``end``: the costs after each chunk, right but for a constant."""
    schema = "conv string, chunk bigint, symbols string, last boolean, end array<int>, start array<int>"

    def guess(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            vectors = run_back(_symbols(rows["symbols"]), np.tile(END, (len(rows), 1)))
            yield rows.append_column("end", _ints(np.tile(END, (len(rows), 1)))).append_column("start", _ints([v[0] for v in vectors]))

    def fix(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            starts = [fix_up(*x) for x in zip(_symbols(rows["symbols"]), _vectors(rows["end"]), _vectors(rows["after"]), strict=True)]
            yield rows.select(["conv", "chunk", "symbols", "last"]).append_column("end", rows["after"].combine_chunks()).append_column("start", _ints(starts))

    now = map_arrow(chunks.select("conv", "chunk", "symbols", "last"), guess, schema)
    for _ in range(passes):
        now = materialize(now, "repair-pass")
        after = now.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("after"))
        met = now.join(after, ["conv", "chunk"], "left").withColumn("fix", F.coalesce(F.col("after") != F.col("end"), F.lit(False)))
        met, seen = materialize_counted(met, "llm-repair-met", fixes=F.count_if("fix"))
        if not seen["fixes"]:
            return now.drop("start")
        now = met.filter("not fix").select(now.columns).unionByName(map_arrow(met.filter("fix").drop("fix"), fix, schema))
    now = materialize(now.drop("start"), "repair-unsettled")

    def matrices(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            columns = [run_back_exact(c) for c in _symbols(rows["symbols"])]
            yield pa.table({"conv": rows["conv"], "at": rows["chunk"], "matrix": _ints(columns)})

    whole = map_arrow(now, matrices, "conv string, at bigint, matrix array<int>")
    ends = carried(whole, END.tolist(), fan, backward=True).select("conv", F.col("at").alias("chunk"), F.col("vector").alias("end"))
    return now.drop("end").join(ends, ["conv", "chunk"])


def run_back_exact(chunk: np.ndarray) -> np.ndarray:
    """The product of a chunk's steps, less its least entry."""
    out = STEPS[chunk[-1]]
    for symbol in chunk[-2::-1]:
        out = _product(STEPS[symbol], out)
        out = out - out.min()
    return out


def carried(items: DataFrame, first: list[int], fan: int = FAN, backward: bool = False) -> DataFrame:
    """(conv, at, vector): the min-plus vector that reaches each of ``items`` (conv, at, matrix) when ``first`` enters the sequence of a
    conversation. Items are composed in groups of ``fan``, groups of groups and so on; then the vectors come down the same way.
    Backward, a matrix leads from the costs after an item to those before it, and ``first`` enters behind the last.
    """

    def ordered(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.array([m["matrix"] for m in group], dtype=np.int64).reshape(-1, 4, 4)[:: -1 if backward else 1] for group in column.to_pylist()]

    def compose(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            out = []
            for group in ordered(rows["members"]):
                whole = group[0]
                for matrix in group[1:]:
                    whole = _product(matrix, whole) if backward else _product(whole, matrix)
                    whole = np.minimum(whole - whole.min(), FAR)
                out.append(whole)
            yield pa.table({"conv": rows["conv"], "at": rows["at"], "matrix": _ints(out)})

    def down(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            out = {"conv": [], "at": [], "vector": []}
            for conv, members, group, vector in zip(rows["conv"].to_pylist(), rows["members"].to_pylist(), ordered(rows["members"]), _vectors(rows["vector"]), strict=True):
                for member, matrix in zip(members[:: -1 if backward else 1], group, strict=True):
                    out["conv"].append(conv)
                    out["at"].append(member["at"])
                    out["vector"].append(vector.tolist())
                    vector = (matrix + vector).min(axis=1) if backward else (matrix + vector[:, None]).min(axis=0)
                    vector = np.minimum(vector - vector.min(), FAR)
            yield pa.table({"conv": pa.array(out["conv"], "string"), "at": pa.array(out["at"], "int64"), "vector": pa.array(out["vector"], pa.list_(pa.int32()))})

    levels, current = [], items
    while True:
        current, seen = materialize_counted(current, "llm-repair-level", most=F.max("at"))
        if not seen["most"]:
            break
        members = F.array_sort(F.collect_list(F.struct("at", "matrix"))).alias("members")
        levels.append(materialize(current.groupBy("conv", F.floor(F.col("at") / fan).alias("at")).agg(members), "repair-groups"))
        current = map_arrow(levels[-1], compose, "conv string, at bigint, matrix array<int>")
    vectors = current.select("conv", "at", F.lit(first).cast("array<int>").alias("vector"))
    for groups in reversed(levels):
        vectors = map_arrow(groups.join(vectors, ["conv", "at"]), down, "conv string, at bigint, vector array<int>")
    return vectors


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy): ``rows`` (conv_id, turn, role, text) after the damage that the checksum of conversation and turn
    deals. Nulls are one space, but for the turn itself.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % KINDS
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select(
        conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).filter("kind <> 0")
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, copy) in order, with ``pos`` from 1, ``before`` (the previous role's initial), ``fault`` and ``symbol``."""
    rows = materialize(rows.withColumns({"initial": F.left("role", F.lit(1)), "one": F.lit(1).cast("bigint")}), "repair-rows")
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "copy"))]
    rows = Sequence(rows, ["conv"], order, "repair-order").running_sum("one", "pos").previous("initial").result().drop("one").withColumnRenamed("prev_initial", "before")
    rows = materialize(rows, "repair-ordered")
    first = rows.groupBy("conv", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    tail = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(tail == "", "blank").when(F.col("first").isNull(), "duplicate").when(~tail.isin(".", "!", "?"), "truncated")
    rows = rows.join(first, ["conv", "pos"], "left").withColumn("fault", fault).drop("first")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    gone = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    return rows.withColumn("symbol", F.substring(F.lit(SYMBOLS), role * 3 + gone + 1, F.lit(1)))


def plans(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES, fan: int = FAN) -> DataFrame:
    """(conv, chunk, plan, cost) from ``rows`` (conv, pos, symbol): the least cheapest edits, chunk by chunk."""
    cut = rows.groupBy("conv", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("rows"))
    cut = cut.select("conv", "chunk", F.array_join("rows.symbol", "").alias("symbols"))
    last = cut.groupBy("conv").agg(F.max("chunk").alias("chunk")).withColumn("last", F.lit(True))
    cut = materialize(cut.join(last, ["conv", "chunk"], "left").withColumn("last", F.coalesce("last", F.lit(False))), "repair-chunks")

    def traced(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            chunks = _symbols(rows["symbols"])
            found = [[trace(c, v, s, last) for s in range(4)] for c, v, last in zip(chunks, run_back(chunks, _vectors(rows["end"])), rows["last"].to_pylist(), strict=True)]
            exits = np.full((len(found), 4, 4), FAR)
            for i, four in enumerate(found):
                exits[i, range(4), [to for _, to, _ in four]] = 0
            yield pa.table({
                "conv": rows["conv"], "chunk": rows["chunk"], "matrix": _ints(exits),
                "plans": pa.array([[p for p, _, _ in four] for four in found], pa.list_(pa.string())), "costs": _ints([[c for _, _, c in four] for four in found]),
            })

    found = materialize(map_arrow(settled(cut, passes, fan), traced, "conv string, chunk bigint, matrix array<int>, plans array<string>, costs array<int>"), "repair-traced")
    entered = carried(found.select("conv", F.col("chunk").alias("at"), "matrix"), [0, FAR, FAR, FAR], fan)
    entered = entered.select("conv", F.col("at").alias("chunk"), F.array_position("vector", F.lit(0)).cast("int").alias("state"))
    return found.join(entered, ["conv", "chunk"]).select("conv", "chunk", F.element_at("plans", F.col("state")).alias("plan"), F.element_at("costs", F.col("state")).cast("bigint").alias("cost"))


def repaired(rows: DataFrame, planned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, pos, lines): what stands in a repaired conversation for each of ``rows`` (conv, pos, role, text), each line ended by a
    newline; nothing for deleted rows. ``pos`` one behind the last is what was inserted at the end.
    """
    fields = planned.select("conv", "chunk", F.posexplode(F.split("plan", "[|]")).alias("at", "field")).select("conv", (F.col("chunk") * chunk + F.col("at") + 1).alias("pos"), "field")
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace("field", "[^ua]", ""), "u", "user:\n"), "a", "assistant:\n")
    do = F.right("field", F.lit(1))
    role = F.when(do == "K", F.col("role")).when(do == "U", "user").when(do == "A", "assistant")
    own = F.coalesce(F.concat(role, F.lit(":"), "text", F.lit("\n")), F.lit(""))
    return fields.join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left").select("conv", "pos", F.concat(new, own).alias("lines")).filter("lines <> ''")


def hashed(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines of each conversation in order. A hash runs through its text byte by byte, so each conversation
    streams through one task; nothing but the hash's state is held.
    """

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        conv, state = None, None
        for rows in slices:
            done = []
            for name, text in zip(rows["conv"].to_pylist(), rows["lines"].to_pylist(), strict=True):
                if name != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text[:-1].encode("utf-8", "surrogatepass"))
            yield pa.table({"conv": pa.array([c for c, _ in done], "string"), "sha256": pa.array([s for _, s in done], "string")})
        if state is not None:
            yield pa.table({"conv": pa.array([conv], "string"), "sha256": pa.array([state.hexdigest()], "string")})

    return map_arrow(lines.repartition("conv").sortWithinPartitions("conv", "pos"), run, "conv string, sha256 string")


def repair_conversations(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``rows`` (conv_id, turn,
    role, text), after the damage of ``damage``.

    Rows are taken by turn (nulls first; equal turns by role, then text). A null conv_id is a conversation; a null role or text
    is one space, so such a text is blank and such a role is foreign. A role counts by its first letter; an empty one is foreign.
    Repeated rows are rows; a conversation that has lost all its rows has zeros and empty text; an empty table
    gives no rows; other columns are ignored. The audit of a conversation is one string, as its result is one row.
    """
    ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = materialize(marked(damage(rows)), "repair-marked")
    planned = materialize(plans(found.select("conv", "pos", "symbol"), chunk, passes, fan), "repair-plans")
    pair = F.concat("before", "initial")
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = found.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    facts = found.groupBy("conv").agg(
        count("blank"), count("duplicate"), count("truncated"), F.count_if(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal")
    )
    edits = planned.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "plan"))), lambda x: F.translate(x["plan"], "uaUA|", "IIRR")), "").alias("audit")
    )
    sums = hashed(repaired(found, planned, chunk))
    out = ids.join(turns, "conv", "left").join(facts, "conv", "left").join(edits, "conv", "left").join(sums, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def check_sql() -> str:
    """The same for DuckDB: a recursion along the rows that keeps, per state, the least (cost, audit) with its text."""
    white = "\\x20\\x09-\\x0D"

    def more(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"case when {state} is not null then {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'body': {state}.body || {line}}} end"

    def insert(state: str, role: str) -> str:
        return more(state, str(INSERT), "I", f"'{role}:' || chr(10)")

    def opened(source: str, keep: str) -> str:
        """The states of ``source`` (s0, s1, u, a) after insertions."""
        return f"""
            select {keep}, s0, s1, u1 u, least(a, {insert("u1", "assistant")}) a
            from (select *, least(u, {insert("s0", "user")}, {insert("s1", "user")}, {insert("a", "user")}) u1 from {source})"""

    trunc = "(fault is not distinct from 'truncated')::int"
    free = "fault is distinct from 'blank' and fault is distinct from 'duplicate'"
    keep = lambda state, initial: f"case when {free} and initial = '{initial}' then {more(state, trunc, 'K', 'role || chr(58) || text || chr(10)')} end"
    rerole = lambda state, role: f"case when {free} then {more(state, f'{REROLE} + {trunc}', 'R', f"'{role}:' || text || chr(10)")} end"
    delete = lambda state: more(state, str(DELETE), "D")
    to_user = ", ".join(f"{keep(s, 'u')}, {rerole(s, 'user')}" for s in ("s0", "s1", "a"))
    return f"""
        with recursive {CRC_TABLE},
        filled as (
            select coalesce(conv_id::varchar, ' ') conv, turn, coalesce(role, ' ') role, coalesce(text, ' ') as text,
                   encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) k
            from conversations),
        dealt as (select *, {crc32_of("k")} % {KINDS} kind from filled cross join crc),
        hurt as (
            select conv, turn, case when kind = 4 then 'user' else role end role, unnest(case when kind = 3 then [0, 1] else [0] end) copy,
                   case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
            from dealt where kind <> 0),
        placed as (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) pos from hurt),
        tailed as (
            select *, substr(role, 1, 1) initial, lag(substr(role, 1, 1)) over (partition by conv order by pos) before,
                   row_number() over (partition by conv, role, text order by pos) again, right(regexp_replace(text, '[{white}]+$', ''), 1) tail
            from placed),
        found as (
            select *, case when tail = '' then 'blank' when again > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' end fault
            from tailed),
        ways as (
            select distinct conv, 0::bigint pos, {{'cost': 0, 'audit': '', 'body': ''}} s0, null::struct(cost integer, audit varchar, body varchar) s1,
                   null::struct(cost integer, audit varchar, body varchar) u, null::struct(cost integer, audit varchar, body varchar) a
            from found
            union all
            select conv, pos, {delete("s0")}, least({delete("s1")}, {keep("s0", "s")}), least({delete("u")}, {to_user}),
                   least({delete("a")}, {keep("u", "a")}, {rerole("u", "assistant")})
            from (
                select o.conv, f.pos, s0, s1, u, a, f.role, f.initial, f.text, f.fault
                from ({opened("ways", "conv, pos")}) o join found f on f.conv = o.conv and f.pos = o.pos + 1)),
        ends as (
            select conv, least(s0, a) best
            from ({opened("(select * from ways qualify row_number() over (partition by conv order by pos desc) = 1)", "conv")})),
        facts as (
            select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank,
                   count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
                   count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal
            from found group by conv)
        select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
               coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(best.cost, 0)::bigint as cost,
               coalesce(best.audit, '') audit, sha256(coalesce(substr(best.body, 1, length(best.body) - 1), '')) repaired_sha256
        from (select distinct conv_id, coalesce(conv_id::varchar, ' ') conv from conversations)
             left join facts using (conv) left join ends using (conv)"""
