r"""Conversation structure repair: cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Rows of a conversation in the order of ``turn`` (nulls first; equal turns by role, the text's first characters
and a hash of the text) form the edit lattice: node (i, state) stands for i rows consumed and an output that is
empty (0) or ends in a system (1), user (2) or assistant (3) message.  Edges are the edits of EDITS with their
costs.  ``cheapest`` runs Dijkstra from both ends: a forward and a reverse heap advance by turns until no
cheaper or equal path can be left, which settles every crossing of equal cost; the least concatenated audit
of these crossings is taken.  Of two equally cheap paths between the same nodes neither audit begins with the
other (they would differ in insertions only, which cost), so least parts give least wholes.

Scale: rows are range-partitioned by (conversation, turn, ...) and sorted, texts shuffled once, so that one
conversation that holds a third of all rows spreads over partitions.  Conversations of at most ``BLOCK`` rows
inside a partition are finished there.  The first and last one of a partition and longer ones stay open: their
rows get a position, repeats are found by a minimum for each (conversation, role, text), each block of rows
gives a 4 x 4 table of cheapest ways from entry to exit state, and tables are joined ``FAN`` at a time until one
is left.  The SHA-256 of a repaired conversation can't be computed in parts: its rows are streamed in order
through one hash, holding one batch of rows at a time.  A conversation's audit is one value of the result.

Defined cases: a null or missing role or text is one space; a null conv_id is a conversation like others; null
turns come first and don't count for gaps; equal rows are repeats; an empty role has an empty initial;
conversations whose rows all have ``times`` 0 get zeros, an empty audit and the hash of nothing; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.llm.common import staged

#: Edits with their initials and costs; a truncated row that stays costs 3 more.
EDITS = {"keep": ("K", 0), "rerole": ("R", 3), "delete": ("D", 4), "insert": ("I", 3)}
TRUNCATED = 3
#: Rows of a conversation that are worked on at once, and tables that are joined at once.
BLOCK, FAN = 512, 64

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that follows when a user or assistant message is put next, and those that it may come from.
_NEXT = (USER, USER, ASSISTANT, USER)
_FROM = tuple(tuple(p for p in range(4) if _NEXT[p] == q) for q in range(4))
#: States before and after a kept row, by its code.
_KEPT = {"s": ((EMPTY, SYSTEM),), "u": ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
_LEGAL = ("su", "ua", "au")
_WS = " \t\n\v\f\r"
_NO_WAY = (1 << 60, "")


def code_of(fault: str, role: str) -> str:
    """One character for a row: d must be deleted; else the role's initial (x for others), upper-case if the
    text is truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return c.upper() if fault == "truncated" else c


def local_fault(text: str) -> str:
    """The fault that a text has by itself."""
    bare = text.rstrip(_WS)
    return "blank" if not bare else "" if bare[-1] in ".!?" else "truncated"


def _edges(codes: str, i: int, q: int, back: bool) -> list:
    """(node, cost, initial) of the edges out of (back: into) a node."""
    (keep, free), (rerole, r), (delete, d), (insert, n) = EDITS.values()
    to = _FROM[q] if back else (_NEXT[q],)
    out = [((i, p), n, insert) for p in to]
    at = i - 1 if back else i
    if 0 <= at < len(codes):
        j = at if back else i + 1
        out.append(((j, q), d, delete))
        c = codes[at]
        if c != "d":
            more = TRUNCATED if c.isupper() else 0
            out += [((j, p), r + more, rerole) for p in to]
            ways = _KEPT.get(c.lower(), ())
            out += [((j, a if back else b), free + more, keep) for a, b in ways if (b if back else a) == q]
    return out


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, enter: int = EMPTY, leave: tuple = (EMPTY, ASSISTANT)) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits of rows with these codes, or None if there are none."""
    n = len(codes)
    ahead, behind = {(0, enter): (0, "")}, {(n, q): (0, "") for q in leave}
    # equal costs: nodes in the order of their rows, as free edges lead to the next row
    fore, rear = [(0, 0, enter)], [(0, -n, q) for q in leave]
    done: tuple[set, set] = (set(), set())
    best = _NO_WAY[0]
    while fore and rear and fore[0][0] + rear[0][0] <= best:
        back = rear[0][0] < fore[0][0]
        heap, mine, other = (rear, behind, ahead) if back else (fore, ahead, behind)
        _, i, q = heappop(heap)
        node = (abs(i), q)
        if node in done[back]:
            continue
        done[back].add(node)
        cost, audit = mine[node]
        if node in other:
            best = min(best, cost + other[node][0])
        for to, price, edit in _edges(codes, *node, back):
            label = (cost + price, edit + audit if back else audit + edit)
            if label < mine.get(to, _NO_WAY):
                if label[0] < mine.get(to, _NO_WAY)[0]:
                    heappush(heap, (label[0], -to[0] if back else to[0], to[1]))
                mine[to] = label
    crossings = [(f[0] + behind[x][0], f[1] + behind[x][1]) for x, f in ahead.items() if x in behind]
    return min(crossings, default=None)


class Replay:
    """Applies an audit to rows in order and yields the repaired (role, text) pairs."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _put(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._put(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._put(), text
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text


class _Hash:
    """SHA-256 of ``role:text`` lines that come one by one."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False


# --- damage ---------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows damaged by crc32 of ``conv_id:turn`` modulo 20.  times: how
    many equal rows stand next to each other, 0 for a row that is dropped."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *_filled(), (F.crc32(name.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def _filled() -> list:
    return [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]


# --- conversations that end inside a partition --------------------------------------------------------------

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RUN_TYPES = {"conv_id": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string(), "turns": _TURNS,
              "pos": pa.int64(), "block": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "times": pa.int32()}
_RUN_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
               "turns array<struct<role: string, text: string>>, pos long, block long, turn long, role string, text string, times int")


def _closed(rows: list, with_turns: bool) -> dict:
    """The result of a conversation whose rows (turn, role, text, times) are all there."""
    seen: set = set()
    every = [(turn, role, text) for turn, role, text, times in rows for _ in range(times)]
    codes, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in every:
        fault = local_fault(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        faults[fault] += 1
        codes.append(code_of(fault, role))
    turns = {t for t, _, _ in every if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(every, every[1:]))
    cost, audit = cheapest("".join(codes))
    replay, sha, kept = Replay(audit), _Hash(), []
    for _, role, text in every:
        kept += replay.row(role, text)
    kept += replay.inserted()
    for role, text in kept:
        sha.add(role, text)
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
            "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha.sha.hexdigest(),
            "turns": [{"role": r, "text": t} for r, t in kept] if with_turns else None}


def _runs(with_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36  # positions rise with the partition
        state = {"id": None, "rows": [], "open": True, "pos": base, "block": base, "n": 0}
        out: list[dict] = []

        def spill() -> None:
            for turn, role, text, times in state["rows"]:
                if state["n"] % BLOCK == 0:
                    state["block"] = state["pos"]
                out.append({"conv_id": state["id"], "pos": state["pos"], "block": state["block"], "turn": turn, "role": role, "text": text, "times": times})
                state["pos"] += 1
                state["n"] += 1
            state["rows"] = []

        def close() -> None:
            if state["open"]:
                spill()
            elif state["rows"]:
                out.append({"conv_id": state["id"], **_closed(state["rows"], with_turns)})
            state.update(rows=[], open=False, n=0)

        first = True
        for batch in batches:
            ids, *columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "times"))
            for at, row in zip(ids, zip(*columns)):
                if first or at != state["id"]:
                    if not first:
                        close()
                    first = False
                    state["id"] = at
                state["rows"].append(row)
                if len(state["rows"]) >= BLOCK:
                    state["open"] = True
                    spill()
            if out:
                yield _batch(out)
                out.clear()
        state["open"] = True
        spill()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], t) for c, t in _RUN_TYPES.items()], names=list(_RUN_TYPES))


# --- conversations cut by a partition's end, and long ones ---------------------------------------------------

_TABLE = ("conv_id long, block long, n_turns long, first_turn long, last_turn long, first_role string, last_role string, "
          "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>")


def _joined(left: dict, right: dict) -> dict:
    """The table of two neighbouring blocks."""
    out = {k: left[k] + right[k] for k in ("n_turns", "blank", "duplicate", "truncated", "illegal")}
    if left["last_turn"] is not None and left["last_turn"] == right["first_turn"]:
        out["n_turns"] -= 1
    if left["last_role"] is not None and right["first_role"] is not None:
        out["illegal"] += left["last_role"] + right["first_role"] not in _LEGAL
    for a, b in (("first_turn", "last_turn"), ("first_role", "last_role")):
        out[a] = left[a] if left[a] is not None else right[a]
        out[b] = right[b] if right[b] is not None else left[b]
    out["costs"], out["audits"] = [], []
    for p in range(4):
        for q in range(4):
            ways = [(left["costs"][4 * p + m] + right["costs"][4 * m + q], left["audits"][4 * p + m] + right["audits"][4 * m + q])
                    for m in range(4) if left["costs"][4 * p + m] >= 0 and right["costs"][4 * m + q] >= 0]
            cost, audit = min(ways, default=(-1, ""))
            out["costs"].append(cost)
            out["audits"].append(audit)
    return out


_TABLE_TYPES = pa.schema([*((c, pa.int64()) for c in ("conv_id", "block", "n_turns", "first_turn", "last_turn")), ("first_role", pa.string()), ("last_role", pa.string()),
                          *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _first_table(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
    codes, faults, roles, illegal = [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, [], 0
    for r in rows:
        for k in range(r["times"]):
            fault = "duplicate" if r["bare"] != "blank" and (k or not r["fresh"]) else r["bare"]
            faults[fault] += 1
            codes.append(code_of(fault, r["initial"]))
            illegal += bool(roles) and roles[-1] + r["initial"] not in _LEGAL
            roles.append(r["initial"])
    turns = sorted({r["turn"] for r in rows if r["times"] and r["turn"] is not None})
    ways = [cheapest("".join(codes), p, (q,)) or (-1, "") for p in range(4) for q in range(4)]
    table = {"conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "n_turns": len(turns), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
             "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None,
             "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"], "illegal": illegal,
             "costs": [c for c, _ in ways], "audits": [a for _, a in ways]}
    return pa.Table.from_pylist([table], schema=_TABLE_TYPES)


def _next_table(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    return pa.Table.from_pylist([{**rows[0], **reduce(_joined, rows)}], schema=_TABLE_TYPES)


def _tables(opened: DataFrame) -> DataFrame:
    """One table for each open conversation."""
    key = ["conv_id", "role", "digest"]
    rows = opened.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    fresh = rows.where("times > 0").groupBy(*key).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    bare = F.when(tail == "", "blank").when(tail.rlike("[.!?]"), "").otherwise("truncated")
    narrow = rows.select("conv_id", "block", "pos", "turn", "times", F.substring("role", 1, 1).alias("initial"), bare.alias("bare"))
    narrow = narrow.join(fresh, "pos", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    tables = staged(narrow.groupBy("block").applyInArrow(_first_table, _TABLE), "repair-tables")
    while True:
        along = Window.partitionBy("conv_id").orderBy("block")
        numbers = tables.select("block", (F.row_number().over(along) - 1).alias("number"))
        most = numbers.agg(F.max("number")).first()[0]
        if not most:
            return tables
        parts = tables.join(numbers, "block").withColumn("part", F.floor(F.col("number") / FAN))
        tables = staged(parts.groupBy("conv_id", "part").applyInArrow(_next_table, _TABLE), "repair-tables")


def _streamed(with_turns: bool):
    """Rows of each conversation behind one row with its audit: the hash of the repaired conversation, or its
    turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"replay": None}
        out: list[dict] = []

        def put(pairs) -> None:
            for role, text in pairs:
                if with_turns:
                    out.append({"conv_id": state["id"], "pos": state["n"], "role": role, "text": text})
                    state["n"] += 1
                else:
                    state["sha"].add(role, text)

        def end() -> None:
            if state["replay"] is not None:
                put(state["replay"].inserted())
                if not with_turns:
                    out.append({"conv_id": state["id"], "repaired_sha256": state["sha"].sha.hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if r["audit"] is not None:
                    end()
                    state = {"id": r["conv_id"], "replay": Replay(r["audit"]), "sha": _Hash(), "n": 0}
                    continue
                for _ in range(r["times"]):
                    put(state["replay"].row(r["role"], r["text"]))
            if out:
                yield _batch(out)
                out.clear()
        end()
        if out:
            yield _batch(out)

    return run


def _open_results(opened: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    """(result rows of the open conversations without hash, what their streams give)."""
    costs, audits = F.col("costs"), F.col("audits")
    ways = F.array(*(F.struct(costs[q].alias("cost"), audits[q].alias("audit")) for q in (EMPTY, ASSISTANT)))
    best = F.array_min(F.filter(ways, lambda w: w["cost"] >= 0))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    done = _tables(opened).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))
    heads = done.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("times", "int"))))
    rows = heads.unionByName(opened.where("times > 0").select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text", "times"))
    streams = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_streamed(with_turns), _RUN_SCHEMA)
    return done, streams


def _split(rows: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    """Staged (closed, open) rows of all conversations."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *_filled(), times.cast("int").alias("times"))
    rows = rows.withColumns({"start": F.substring("text", 1, 64), "h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "start", "h", "row"]  # equal rows may part at "row"
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "times")
    runs = staged(runs.mapInArrow(_runs(with_turns), _RUN_SCHEMA), "repair-runs")
    return runs.where("pos is null"), runs.where("pos is not null")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text and, if rows stand for several or no
    equal ones, times): gaps, faults, illegal neighbours, cost, audit, hash of the repaired conversation."""
    closed, opened = _split(rows, False)
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    done, hashes = _open_results(opened, False)
    hashes = hashes.select(F.col("conv_id").alias("hash_id"), "repaired_sha256")
    late = done.join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_id")))
    return closed.select(*columns).unionByName(late.select(*columns))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the messages of the repaired conversations, pos from 0."""
    closed, opened = _split(rows, True)
    early = closed.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", F.col("pos").cast("long"), "t.role", "t.text")
    return early.unionByName(_open_results(opened, True)[1].select("conv_id", "pos", "role", "text"))


# --- SQL ----------------------------------------------------------------------------------------------------
# A label is eight digits of cost and the audit, so that the least string is the cheapest and least audit.

def _sql_add(label: str, cost, edit: str) -> str:
    return f"(case when {label} is null then null else printf('%08d', cast(substr({label}, 1, 8) as int) + {cost}) || substr({label}, 9) || '{edit}' end)"


def _sql_oracle() -> str:
    names = ("e", "s", "u", "a")
    more = "(case when f = 't' then 3 else 0 end)"
    after = dict.fromkeys(names, "")
    for q in names:
        ways = [_sql_add(q, 4, "D")]
        if q == "s":
            ways.append(f"(case when f not in ('b', 'd') and r = 's' then {_sql_add('e', more, 'K')} end)")
        if q == "u":
            ways += [f"(case when f not in ('b', 'd') then {_sql_add(p, '3 + ' + more, 'R')} end)" for p in "esa"]
            ways += [f"(case when f not in ('b', 'd') and r = 'u' then {_sql_add(p, more, 'K')} end)" for p in "esa"]
        if q == "a":
            ways += [f"(case when f not in ('b', 'd') then {_sql_add('u', '3 + ' + more, 'R')} end)"]
            ways += [f"(case when f not in ('b', 'd') and r = 'a' then {_sql_add('u', more, 'K')} end)"]
        after[q] = f"list_min([{', '.join(ways)}])"
    put_u = "list_min([u, " + ", ".join(_sql_add(p, 3, "I") for p in "esa") + "])"
    put_a = "list_min([a, " + ", ".join([_sql_add("u", 3, "I"), *(_sql_add(p, 6, "II") for p in "es")]) + "])"
    crc_bit = "xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)"
    return rf"""
with recursive crc_steps(i, k, c) as (
  select i, 0, i from range(256) t(i) union all select i, k + 1, {crc_bit} from crc_steps where k < 8
), crc_table as (select list(c order by i) as t from crc_steps where k = 8),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as bytes
  from conversations
), kinds as (
  select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) % 20 as kind
  from named, crc_table
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from kinds
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail from damaged
), faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when tail not in ('.', '!', '?') then 't' else '' end as f, substr(role, 1, 1) as r,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before, count(*) over (partition by conv_id) as n
  from numbered
), steps as (
  select distinct conv_id, 0::bigint as i, '00000000' as e, null::varchar as s, '00000003I' as u, '00000006II' as a from faults
  union all
  select conv_id, i, e, s, u, {put_a} as a from (
    select conv_id, i, e, s, {put_u} as u, a from (
      select p.conv_id, p.i + 1 as i, {after['e']} as e, {after['s']} as s, {after['u']} as u, {after['a']} as a
      from steps p join faults q on p.conv_id is not distinct from q.conv_id and q.i = p.i + 1))
), ends as (
  select p.conv_id, least(e, a) as label from steps p join (select distinct conv_id, n from faults) q on p.conv_id is not distinct from q.conv_id and p.i = q.n
), walk as (
  select conv_id, 1 as place, 0::bigint as i, '' as state, substr(label, 9) as audit, []::varchar[] as lines from ends
  union all
  select w.conv_id, place + 1, case when edit = 'I' then w.i else w.i + 1 end,
    case when edit = 'D' then state when edit = 'K' then q.r when state = 'u' then 'a' else 'u' end, audit,
    case when edit = 'D' then lines when edit = 'K' then list_append(lines, q.role || ':' || q.text)
      else list_append(lines, case when state = 'u' then 'assistant:' else 'user:' end || case when edit = 'R' then q.text else '' end) end
  from (select *, substr(audit, place, 1) as edit from walk where place <= length(audit)) w
  left join faults q on w.conv_id is not distinct from q.conv_id and q.i = w.i + 1
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate,
    count(*) filter (f = 't') as truncated, count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
), results as (
  select c.*, cast(substr(label, 1, 8) as bigint) as cost, substr(label, 9) as audit, sha256(array_to_string(w.lines, chr(10))) as repaired_sha256
  from counts c join ends e on c.conv_id is not distinct from e.conv_id
  join walk w on c.conv_id is not distinct from w.conv_id and w.place = length(w.audit) + 1
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join results r on o.conv_id is not distinct from r.conv_id
"""


ORACLE = _sql_oracle()
