"""Conversation repair against a plain table over rows and states, and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sessionsift.llm import convrepair, queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def slow(codes):
    """(cost, audit) by a table over rows and endings; '' and s, u, a are the endings."""
    def insertions(now):
        for _ in range(3):
            for e, (cost, audit) in list(now.items()):
                to = "a" if e == "u" else "u"
                now[to] = min(now.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return now

    now = insertions({"": (0, "")})
    for c in codes:
        after = {}
        for e, (cost, audit) in now.items():
            put = "a" if e == "u" else "u"
            ways = [(e, 4, "D")]
            if c != "d":
                more = 3 if c.isupper() else 0
                ways.append((put, 3 + more, "R"))
                if c.lower() == put or (c.lower() == "s" and e == ""):
                    ways.append((c.lower(), more, "K"))
            for to, price, edit in ways:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, audit + edit))
        now = insertions(after)
    return min(now[e] for e in ("", "a") if e in now)


def repaired(rows):
    """The contract, row by row, for one conversation's damaged rows in order."""
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else c.upper() if fault == "truncated" else c
    cost, audit = slow(codes)
    out, last, left = [], "", list(rows)
    for edit in audit:
        row = left.pop(0) if edit != "I" else (None, "", "")
        put = "assistant" if last == "u" else "user"
        if edit != "D":
            role = row[1] if edit == "K" else put
            out.append(f"{role}:{row[2]}")
            last = role[0]
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows, damaged=True):
    done = damage(rows) if damaged else rows
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return {c: repaired([r[1:] for r in sorted((r for r in done if r[0] == c), key=order)]) for c in {r[0] for r in rows}}


def got(df):
    rows = df.collect()
    assert df.columns == COLUMNS and len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_cheapest_against_a_table():
    rng = random.Random(1)
    for _ in range(3000):
        codes = "".join(rng.choice("sua" if rng.random() < 0.6 else "suaSUAxXd") for _ in range(rng.randrange(14)))
        assert convrepair.cheapest(codes) == slow(codes), codes


def test_cheapest_against_all_edits():
    def every(codes):
        best = None
        for n_inserts in range(4):
            for edits in itertools.product("KRD", repeat=len(codes)):
                for places in itertools.combinations_with_replacement(range(len(codes) + 1), n_inserts):
                    audit = "".join("I" * places.count(i) + (edits[i] if i < len(codes) else "") for i in range(len(codes) + 1))
                    ends, cost, left = "", 0, list(codes)
                    for e in audit:
                        c = left.pop(0) if e != "I" else ""
                        put = "a" if ends[-1:] == "u" else "u"
                        if e == "D":
                            cost += 4
                            continue
                        if c == "d":
                            break
                        cost += (0 if e == "K" else 3) + (3 if c.isupper() else 0)
                        ends += c.lower() if e == "K" else put
                    else:
                        if re.fullmatch("(s?(ua)+)?", ends):
                            best = min(best or (10**9, ""), (cost, audit))
        return best

    for codes in map("".join, itertools.chain.from_iterable(itertools.product("suAxd", repeat=n) for n in range(4))):
        assert convrepair.cheapest(codes) == every(codes), codes


def test_blocks_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        parts = ["".join(rng.choice("suaSUAxd") for _ in range(rng.randrange(5))) for _ in range(4)]
        tables = [{"n_turns": 0, "first_turn": None, "last_turn": None, "first_role": None, "last_role": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                   "costs": [(convrepair.cheapest(p, a, (b,)) or (-1, ""))[0] for a in range(4) for b in range(4)],
                   "audits": [(convrepair.cheapest(p, a, (b,)) or (-1, ""))[1] for a in range(4) for b in range(4)]} for p in parts]
        whole = convrepair._joined(convrepair._joined(tables[0], tables[1]), convrepair._joined(tables[2], tables[3]))
        assert min((whole["costs"][q], whole["audits"][q]) for q in (0, 3) if whole["costs"][q] >= 0) == slow("".join(parts))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, "/root/testdata/sf0.01")) == expected(rows)


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(3) for c in ("pos", "block", "kind", "start", "h", "cost", "audit")})


def test_edges(spark):
    big = 2**62 + 1
    rows = [(None, 1, "user", "no id."), (None, big, "assistant", None), (1, None, None, "null turn."), (1, None, "user", "null turn"), (1, 3, "", "empty role."),
            (2, 0, "tool", "a result?"), (2, 1, "user", " \t\n"), (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 1, "user", "same."), (4, 5, "assistant", "x" * 300_000),
            (5, -7, "system", "rules!\n "), (5, 7, "Été", "\U0001f600"), (big, 0, "user", "Hi. ")]
    for damaged in (False, True):
        df = table(spark, rows).repartition(3)
        out = convrepair.repair(convrepair.damaged(df) if damaged else df)
        want = expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], damaged)
        assert got(out) == want
    none = table(spark, rows).limit(0)
    assert convrepair.repair(convrepair.damaged(none)).count() == 0 and convrepair.repaired_turns(none).count() == 0


def test_conversation_without_rows_left(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = convrepair.damaged(spark.createDataFrame([(gone, 0, "user", "hello.")], "conv_id long, turn long, role string, text string"))
    assert got(convrepair.repair(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("length", [40_000])
def test_one_conversation_with_a_third_of_all_rows(spark, length):
    rng = random.Random(3)
    texts = ["ok.", "well", " ", "yes!", "so?"]
    rows = [(5, t if t % 97 else None, rng.choice(["user", "assistant", "user", "assistant", "tool", "system"]), rng.choice(texts) + (str(t) + "." if t % 3 else "")) for t in range(length)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}.") for c in range(10, 10 + length // 4) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    out = got(convrepair.repair(df))
    assert out == expected_fast(rows)


def expected_fast(rows):
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    return {c: v for part in of.values() for c, v in expected(part, False).items()}


def test_turns_give_the_hash(spark):
    rows = [(c, t, ("user", "assistant", "tool")[(c + t) % 3], f"turn {t} of {c}" + "." * (t % 2)) for c in range(40) for t in range(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = {}
    for r in sorted(convrepair.repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["pos"])):
        mine = lines.setdefault(r["conv_id"], [])
        assert r["pos"] == len(mine)
        mine.append(f"{r['role']}:{r['text']}")
    for c, r in got(convrepair.repair(df)).items():
        assert r[-1] == hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest()
