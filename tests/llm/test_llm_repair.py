import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, repair
from tallyloom.llm.oracle import CONVERSATION_REPAIR

LEGAL = re.compile(r"(s?(ua)+)?")
ROLES = ["user", "assistant", "system", "tool", "", "user", "assistant"]
TEXTS = ["Yes.", "Go on", "", " \n", "No! ", "What?\x0b", "a.b", "Yes.", None]


def judged(rows):
    """Rows with their faults, in order."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, out = set(), []
    for t, r, x in rows:
        bare = x.strip(" \t\n\x0b\x0c\r")
        out.append((t, r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((r, x))
    return out


def brute(rows):
    """All audits by length of rows taken, pruned by cost only: (cost, audit, repaired)."""
    answer = (10**9, "")
    queue = [(0, "", "", 0, ())]
    done = {}
    import heapq

    while queue:
        cost, audit, roles, i, said = heapq.heappop(queue)
        state = (roles[-1:] if roles != "s" else "s0", i)
        if state in done:
            continue
        done[state] = True
        if i == len(rows) and LEGAL.fullmatch(roles):
            answer = (cost, audit, said)
            break
        step = lambda c, e, r, j, s: heapq.heappush(queue, (cost + c, audit + e, roles + r, j, said + s))  # noqa: B023, E731
        fits = lambda r: any(LEGAL.fullmatch(roles + r + more) for more in ("", "a", "ua"))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if fits(role[0]):
                step(5, "I", role[0], i, (f"{role}:",))
        if i < len(rows):
            _, role, text, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            step(2, "D", "", i + 1, ())
            if fault in (None, "truncated"):
                if role[:1] in ("s", "u", "a") and role and fits(role[0]):
                    step(more, "K", role[0], i + 1, (f"{role}:{text}",))
                for to in ("user", "assistant"):
                    if fits(to[0]):
                        step(1 + more, "R", to[0], i + 1, (f"{to}:{text}",))
    return answer


def summary(rows):
    rows = judged(rows)
    turns = {t for t, *_ in rows if t is not None}
    n = lambda f: sum(r[3] == f for r in rows)
    cost, audit, said = brute(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_repair_against_all_audits(spark):
    rng = random.Random(11)
    said = {c: [(rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(1, 8))] for c in range(250)}
    said[None] = [(0, "assistant", "Hi."), (0, None, "x."), (1, "user", "Hi.")]
    rows = [(c, *r) for c, rs in said.items() for r in rs]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit("mine"), "n": F.lit(9), "behind": F.lit("x")})
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.summaries(repair.edits(turns), turns).collect()}
    assert got == {c: summary(rs) for c, rs in said.items()}
    kept = {}
    for r in repair.repaired(turns).orderBy("seq").collect():
        kept[r["conv_id"]] = kept.get(r["conv_id"], "") + r["role"][:1]
    assert all(LEGAL.fullmatch(v) for v in kept.values())


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else "user", f"Really? {c}. Oh!") for c in (-3, 0, 7, 123456789) for t in range(30)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fate:
            row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            want += [row] * (2 if fate == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_and_empty_conversations(spark):
    """A conversation of many rows, one of a single text said a thousand times, one without rows, no conversation at all."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(5000)] + [(2, t // 500, "user", "Same.") for t in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    every = turns.unionByName(spark.createDataFrame([(3, 0, "user", "gone")], turns.schema))
    got = {r["conv_id"]: r for r in repair.summaries(repair.edits(turns), every).collect()}
    assert got[2]["duplicate"] == 999 and got[2]["audit"] == "D" * 1000 and got[2]["cost"] == 2000 and got[2]["illegal"] == 999
    assert len(got[1]["audit"]) == 5000 and got[1]["cost"] == sum({"D": 2, "R": 1, "K": 0, "I": 5}[e] for e in got[1]["audit"])
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.summaries(repair.edits(turns.where("false")), turns.where("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the supplied tables are not here")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = queries.op11_conversation_repair(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(CONVERSATION_REPAIR).fetchall())
