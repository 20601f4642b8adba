"""Conversation repair against exhaustive search, a plain dynamic program, and the table's own rules."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from conftest import SF

from hearthlore.llm import conversations as conv

PATTERN = re.compile("(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """The least cost and its first initials, over all edits with up to two turns inserted in each place."""
    faults, best = faults_of(rows), None
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in faults]
    for edits in itertools.product(*choices):
        for between in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "".join(between[0]), "I" * len(between[0]), 2 * len(between[0])
            for (_, role, _), f, e, more in zip(rows, faults, edits, between[1:]):
                roles += ("" if e == "D" else (role[:1] or "-") if e == "K" else e) + "".join(more)
                audit += (e if e in "DK" else "R") + "I" * len(more)
                cost += (3 if e == "D" else (f == "truncated") + 2 * (e in "ua")) + 2 * len(more)
            if (best is None or (cost, audit) < best) and PATTERN.fullmatch(roles):
                best = cost, audit
    return best


def program(rows):
    """The same by going forward with the best cost and initials of each state."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "")}

    def put(to, q, cost, audit):
        if q not in to or (cost, audit) < to[q]:
            to[q] = cost, audit

    def inserted(now):
        for _ in range(3):
            for q, (c, a) in list(now.items()):
                put(now, 3 if q == 2 else 2, c + 2, a + "I")
        return now

    for (_, role, _), fault in zip(rows, faults_of(rows)):
        now = {}
        for q, (c, a) in inserted(best).items():
            put(now, q, c + 3, a + "D")
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if q in step.get(role[:1], {}):
                    put(now, step[role[:1]][q], c, a + "K")
                put(now, 3 if q == 2 else 2, c + 2, a + "R")
        best = now
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def report(rows):
    """What the operator has to say of one conversation's rows in order."""
    faults = faults_of(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = program(rows)
    out, state, it = [], "", iter(rows)
    for e in audit:
        row = None if e == "I" else next(it)
        if e != "D":
            state = row[1][:1] if e == "K" else "a" if state == "u" else "u"
            out.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + (row[2] if row else ""))
    assert PATTERN.fullmatch("".join(x[:1] for x in out))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def damage(rows):
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range((1, 1, 1, 2)[k] - (k == 0) if k < 4 else 1):
            yield i, (turn, "user" if k == 4 else role, text)


def want(rows):
    by = {i: [] for i, *_ in rows}
    for i, row in damage(rows):
        by[i].append(row)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return sorted(((i, *report(sorted(own, key=order))) for i, own in by.items()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", "", "u"]


def random_rows(rng, n):
    return [(k, rng.choice(ROLES[:3] if rng.random() < 0.9 else ROLES), rng.choice(["Yes.", "no", "", " \n", "A b?", f"t{k}.", f"t{k}"])) for k in range(n)]


def test_cheapest_edits():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        rows = random_rows(rng, n)
        assert program(rows) == exhaustive(rows), rows
    for _ in range(1500):
        rows = random_rows(rng, rng.randrange(1, 40))
        kinds = [conv.kind_of(("", "blank", "duplicate", "truncated").index(f), r) for (_, r, _), f in zip(rows, faults_of(rows))]
        price = conv.auction(kinds)
        assert (price[0], conv.trace(kinds, price)[0]) == program(rows), rows
        arcs = conv._all_arcs(kinds, True)
        assert all(price[v] <= cost + price[v + far] for v, a in enumerate(arcs) for _, cost, far in a)  # the prices are a dual solution


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = conv.op13_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(con.sql(conv.OP13_SQL).fetchall(), key=str) == want(rows)


def test_sql_on_edges():
    import pandas as pd

    rows = edge_rows()
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"], dtype="object"))
    con.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM frame")
    assert sorted(con.sql(conv.OP13_SQL).fetchall(), key=str) == want(rows)


def edge_rows():
    rng = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", None), (1, None, "assistant", "x."), (1, None, "assistant", "x."), (1, -4, None, "y"), (2, 9, "user", "z" * 100_000 + "."), (3, 2**62, "system", "Be. ")]
    for i in range(10, 60):
        rows += [(i, rng.choice([None, *range(12)]), *r[1:]) for r in random_rows(rng, rng.randrange(1, 14))]
    return rows + rows[20:40]


@pytest.mark.parametrize("long", [256, 7, 1])
def test_edges_and_chunks(spark, monkeypatch, long):
    """Nulls, repeated rows, ties, long texts, clashing names; the same however the conversations are cut."""
    monkeypatch.setattr(conv, "LONG", long)
    rows = edge_rows()
    frame = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA + ", pos int, conv string, gone boolean").repartition(5)
    assert sorted(map(tuple, conv.repair_reports(conv.damaged(frame)).collect()), key=str) == want(rows)


def test_one_long_conversation(spark, monkeypatch):
    """Half of all rows are one conversation, most of its rows repeat a text; and one of which every row is gone."""
    monkeypatch.setattr(conv, "LONG", 32)
    rng = random.Random(8)
    gone = next(k for k in range(1000) if zlib.crc32(f"9:{k}".encode()) % 20 == 0)
    rows = [(5, k, *r[1:]) for k, r in enumerate(random_rows(rng, 900))] + [(9, gone, "user", "x")] * 40
    rows += [(100 + k % 90, *r) for k, r in enumerate(random_rows(rng, 400))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = conv.repair_reports(conv.damaged(frame))
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)
    turns = sorted((r.turn, r.role, r.text) for r in conv.repaired_turns(conv.damaged(frame)).where("conv_id = 5").collect())
    assert [t for t, _, _ in turns] == list(range(len(turns)))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest()
    assert digest == got.where("conv_id = 5").collect()[0].repaired_sha256
    assert conv.repair_reports(conv.damaged(frame.limit(0))).collect() == []
    undamaged = conv.repair_reports(conv.as_rows(spark.createDataFrame([(1, 0, "user", "Hi?"), (1, 1, "assistant", "Yes.")], SCHEMA))).collect()
    assert [(r.cost, r.audit) for r in undamaged] == [(0, "KK")]
