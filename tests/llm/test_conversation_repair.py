"""Repaired conversations against a search over all edits, and against SQL."""

import hashlib
import heapq
import os
import random
import re
import zlib

import duckdb
import pytest

from paperloom.llm.conversation_repair import Lazy, as_turns, damage, repair
from paperloom.llm.queries import OP12

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain(rows):
    """{conv: report} by a shortest-path search over whole edit strings."""
    convs = {}
    for conv, turn, role, text in rows:
        turns = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        turns += [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        ini = [t[1][:1] for t in turns]
        numbers = [t[0] for t in turns if t[0] is not None]
        cost, audit, done = cheapest(turns, faults)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def cheapest(turns, faults):
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, at, roles, done = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if at == len(turns) and GRAMMAR.match(roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, done
        if not re.match(r"s?(ua)*u?\Z", roles):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + role[0], (*done, role + ":")))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, done))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + (role[:1] or "?"), (*done, role + ":" + text)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + new[0], (*done, new + ":" + text)))
    return best


def made(seed, n=60):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Über"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, r.choice(["Yes.", "No", "ok!", "", " \n", None, "Hm ", "ends. ", "a. ", "b", "Größe?"])))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return made(7)


def reports(df):
    got = df.where("kind = 'report'").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len(got) == len({r["conv"] for r in got})
    return {r["conv"]: tuple(r)[1:] for r in got}


def test_repair_against_all_edits(spark, conversations):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(5)
    assert reports(repair(damage(df), with_turns=False)) == plain(conversations)


@pytest.mark.parametrize("source", ["made", "sf0.01"])
def test_repair_against_sql(spark, conversations, source):
    c = duckdb.connect()
    path = f"/root/testdata/{source}/conversations.parquet"
    if source == "made":
        c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", conversations)
        df = spark.createDataFrame(conversations, SCHEMA)
    elif os.path.exists(path):
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        df = spark.read.parquet(path)
    else:
        pytest.skip("no test tables")
    assert reports(repair(damage(df), with_turns=False)) == {r[0]: tuple(r[1:]) for r in c.execute(OP12).fetchall()}


def test_repaired_turns(spark, conversations):
    df = repair(as_turns(spark.createDataFrame(conversations, SCHEMA)))
    rows = df.collect()
    hashes = reports(df)
    for conv in hashes:
        turns = sorted((r for r in rows if r["kind"] == "turn" and r["conv"] == conv), key=lambda r: r["place"])
        assert [r["place"] for r in turns] == list(range(len(turns))) and GRAMMAR.match("".join(r["role"][0] for r in turns))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == hashes[conv][-1]


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"Text {i}.") for i in range(30_000)] + [(1, 40_000, "user", "x." * 500_000)] + [(2, 0, "user", "Same.")] * 5_000
    got = reports(repair(as_turns(spark.createDataFrame(rows, SCHEMA))))
    assert got[1][0] == 10_000 and got[1][5] == 30_006  # 9,999 pairs of user turns, the first turn and the last three
    assert got[2] == (0, 0, 4_999, 0, 4_999, 4 * 4_999 + 3, "K" + "D" * 4_999 + "I", hashlib.sha256(b"user:Same.\nassistant:").hexdigest())


def test_states_are_few():
    lazy, r = Lazy(), random.Random(1)
    for _ in range(3_000):
        lazy.solve(bytes(r.randrange(16) for _ in range(20)))
    assert len(lazy.vectors) < 64


def test_no_conversations(spark):
    assert repair(damage(spark.createDataFrame([], SCHEMA))).count() == 0
    wide = spark.createDataFrame([(1, 2, "user", "Hi.", 5, 6)], "`conv.id` string, turn int, role string, text string, part int, symbol int")
    assert [(r["conv"], r["audit"]) for r in repair(as_turns(wide, conv="conv.id"), with_turns=False).collect()] == [("1", "KI")]
