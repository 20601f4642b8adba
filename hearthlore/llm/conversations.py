"""Operator 13: conversations repaired at least cost, by an auction for the shortest path.

A conversation's rows are the columns of a lattice; what has been given out so far (nothing, a
system turn, or a last turn of user or assistant) are its four states. Deleting, keeping or
reroling a row leads to the next column, inserting an empty turn to another state of the same
one. Every node has a price, at most the cost of the way that is left; from a start a path is
extended along the arc with the least cost and price, or, where the node's own price is below
that, the price is raised and the path contracted by one node, until the path ends. The prices
are then a dual solution: every arc of every cheapest path is tight (its node's price is its
cost and its head's price), so the cheapest edits whose initials come first are found by
following tight arcs in order of their initials. Prices begin with what each row costs at
least, so paths seldom go back far. All costs are whole, and no cycle is free.

Conversations of up to LONG rows and LONG_BYTES bytes are solved alone, each in one go. A longer
one is cut into chunks of LONG rows: each chunk is priced for each state that it may end in, a
scan over these sixteen numbers a chunk gives the cost of what follows each chunk, then each
chunk is solved for each state that it may begin with, and a second scan picks one of these. So
no task holds a long conversation; but its digest is one hash of its whole text, which a task
takes row by row.

Defined results: a null role or text is one space, and so is a null identifier or turn in the
hash that damages rows; a null identifier is a conversation of its own; rows of equal turn are
ordered by role and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, map_rows, placed, written
from .manifest import crc32_sql

LONG, LONG_BYTES = 256, 4 << 20
SPACES = " \t\n\v\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: A price that no way to an end has.
NEVER = 1 << 40
#: States: nothing yet, behind a system turn, behind a user's, behind an assistant's; and where each initial leads.
STATES, USER, ASSISTANT = range(4), 2, 3
_LEADS = {"s": {0: 1}, "u": {0: USER, 1: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
_INITIALS = list(_LEADS)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: States in which a conversation may end, at no cost.
ENDS = (0, NEVER, NEVER, 0)


def given(state: int) -> int:
    """The state behind the turn that fits: an assistant's behind a user's, else a user's."""
    return ASSISTANT if state == USER else USER


def _arcs(fault: int, initial: str, state: int) -> list[tuple[str, int, int]]:
    """Initial, cost and how far the head is (four nodes a column), in order of the initials."""
    own = fault == TRUNCATED
    out = [("D", 3, 4), ("I", 2, given(state) - state)]
    if fault in (SOUND, TRUNCATED):
        if state in _LEADS[initial]:
            out.append(("K", own, 4 + _LEADS[initial][state] - state))
        out.append(("R", 2 + own, 4 + given(state) - state))
    return out


#: By kind of row (four times its fault, and its role's initial), then by state.
ARCS = [[_arcs(fault, initial, state) for state in STATES] for fault in range(4) for initial in _INITIALS]
_LEAST = [(0, 3, 3, 1)[kind // 4] for kind in range(16)]


def kind_of(fault: int, role: str) -> int:
    """A row's place in ARCS."""
    return 4 * fault + _INITIALS.index(role[:1] if role[:1] in "sua" else "")


def _all_arcs(kinds: list[int], inserts: bool) -> list[list[tuple[str, int, int]]]:
    """The arcs of all nodes; behind the last row only turns can be inserted, and only where the conversation ends (``inserts``)."""
    return [a for k in kinds for a in ARCS[k]] + [[("I", 2, given(s) - s)] if inserts else [] for s in STATES]


def auction(kinds: list[int], ends: tuple[int, ...] = ENDS, inserts: bool = True, starts: Iterable[int] = (0,)) -> list[int]:
    """Prices of all nodes, at which the cheapest ways from ``starts`` to the ends are tight; NEVER where there is none.

    ``ends`` has what it costs to end in each state behind the last row.
    """
    arcs, last = _all_arcs(kinds, inserts), 4 * len(kinds)
    rest = min(ends)
    price = [rest] * (last + 4)
    for at in range(last - 4, -1, -4):
        price[at : at + 4] = [price[at + 4] + _LEAST[kinds[at // 4]]] * 4
    # a way costs at most the deletion of all rows, a turn or two, and an end
    most = max([3 * len(kinds) + 8 + x for x in ends if x < NEVER], default=-1)
    for start in starts:
        path = [start]
        while True:
            v = path[-1]
            best, head = (ends[v - last], None) if v >= last else (NEVER, None)
            for _, cost, far in arcs[v]:
                if cost + price[v + far] < best:
                    best, head = cost + price[v + far], v + far
            best = best if best <= most else NEVER
            if price[v] < best:
                price[v] = best
                if len(path) > 1:
                    path.pop()
            elif best == NEVER:
                if len(path) == 1:
                    break
                path.pop()
            elif head is None:
                break
            else:
                path.append(head)
    return price


def trace(kinds: list[int], price: list[int], ends: tuple[int, ...] = ENDS, inserts: bool = True, start: int = 0) -> tuple[str, int]:
    """The initials that come first of all cheapest ways from ``start``, and the state at their end."""
    arcs, last = _all_arcs(kinds, inserts), 4 * len(kinds)
    path, labels, dead = [start], [], set()
    while True:
        v = path[-1]
        if v >= last and price[v] == ends[v - last]:
            return "".join(labels), v - last
        for label, cost, far in arcs[v]:
            if price[v] == cost + price[v + far] and v + far not in dead:
                path.append(v + far)
                labels.append(label)
                break
        else:  # a price below the true cost made an arc tight that leads nowhere
            dead.add(path.pop())
            labels.pop()


Row = tuple[int | None, str, str, int, str | None]  # turn, role, text, fault, and the edits from here on


def walk(rows: Iterable[Row]) -> Generator[tuple[str, str], None, tuple]:
    """The repaired turns of a conversation, one after the other; returns its counts, cost and edits."""
    counts, illegal, cost, state, before = [0] * 4, 0, 0, 0, None
    first = newest = None
    turns, audit, labels = 0, [], iter("")
    for turn, role, text, fault, edits in rows:
        counts[fault] += 1
        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        if turn is not None and turn != newest:
            first, newest, turns = turn if first is None else first, turn, turns + 1
        if edits is not None:
            labels = iter(edits)
            audit.append(edits)
        for label in labels:
            if label == "I":
                state, cost = given(state), cost + 2
                yield NAMES[state], ""
                continue
            if label == "D":
                cost += 3
            else:
                cost += (fault == TRUNCATED) + 2 * (label == "R")
                state = given(state) if label == "R" else _LEADS[role[:1]][state]
                yield (role if label == "K" else NAMES[state]), text
            break
    for _ in labels:  # what is inserted behind the last row
        state, cost = given(state), cost + 2
        yield NAMES[state], ""
    gaps = newest - first + 1 - turns if turns else 0
    return gaps, *counts[1:], illegal, cost, "".join(audit)


def solved(rows: list[tuple]) -> list[Row]:
    """A conversation's rows (turn, role, text, blank, cut) in order, with their faults and, at the first, the edits."""
    seen, out, kinds = set(), [], []
    for turn, role, text, blank, cut in rows:
        fault = BLANK if blank else DUPLICATE if (role, text) in seen else TRUNCATED if cut else SOUND
        seen.add((role, text))
        kinds.append(kind_of(fault, role))
        out.append((turn, role, text, fault, None))
    if out:
        out[0] = (*out[0][:4], trace(kinds, auction(kinds))[0])
    return out


def as_rows(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, gone`` of a table of turns; nothing is ``gone``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(False).alias("gone"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``as_rows`` with some rows gone, emptied, without marks, repeated or of a user, by a hash of identifier and turn."""
    rows = as_rows(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("k", F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.expr("CASE WHEN k < 2 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END")
    rows = rows.withColumns({"gone": F.col("k") == 0, "text": text, "role": F.expr("CASE WHEN k = 4 THEN 'user' ELSE role END")})
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def _with_marks(rows: DataFrame) -> DataFrame:
    end = F.rtrim("text", F.lit(SPACES))
    return rows.select("conv", "turn", "role", "text", "gone", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short conversations and, if there are any, those of long ones that aren't gone."""
    sizes = rows.groupBy("conv").agg(F.count_if(~F.col("gone")).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where(f"n > {LONG} OR bytes > {LONG_BYTES}").select(F.col("conv").alias("long_conv")), "long")
    n = long.count()
    if not n:
        return rows, None
    long = F.broadcast(long) if n <= BASES else long  # identifiers alone
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi").where("NOT gone").drop("gone")


def _short_walks(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, walk(solved([(turn, role, text, blank, cut) for _, turn, role, text, gone, blank, cut in own if not gone]))


def _long_rows(rows: DataFrame) -> DataFrame:
    """``conv, pos, turn, role, text, fault, edits`` of long conversations, written."""
    ranked = written(placed(rows, "conv", ["turn", "role", "text"]), "placed")
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # a text's first place is a key of one row, however often the text is repeated
    firsts = ranked.groupBy(F.col("conv").alias("c"), same.alias("same")).agg(F.min("pos").alias("p")).drop("same")
    at = lambda c, p: F.col("conv").eqNullSafe(F.col(c)) & (F.col("pos") == F.col(p))
    fault = F.expr(f"CASE WHEN blank THEN {BLANK} WHEN p IS NULL THEN {DUPLICATE} WHEN cut THEN {TRUNCATED} ELSE {SOUND} END")
    ranked = written(ranked.join(firsts, at("c", "p"), "left").withColumn("fault", fault).drop("c", "p", "blank", "cut"), "faults")
    initial = F.substring("role", 1, 1)
    kind = 4 * F.col("fault") + F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    chunks = ranked.groupBy("conv", "n", F.expr(f"pos div {LONG}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("kind")))).alias("k"))
    chunks = chunks.select("conv", "chunk", F.expr(f"(chunk + 1) * {LONG} >= n").alias("last"), F.col("k.kind").alias("kinds"))

    def costs(batch: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chunk, last, kinds in batch:
            by_end = [auction(kinds, tuple(0 if s == end else NEVER for s in STATES), last, STATES)[:4] for end in STATES]
            yield conv, chunk, last, kinds, [c for prices in by_end for c in prices]

    priced = written(map_rows(chunks, "conv long, chunk long, last boolean, kinds array<int>, costs array<long>", costs), "priced")

    def behind(batch: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(batch, key=lambda r: r[0]):
            ends = ENDS
            for _, chunk, by_end in own:  # the last one first
                yield conv, chunk, list(ends)
                ends = tuple(min(NEVER, *(by_end[4 * end + start] + ends[end] for end in STATES)) for start in STATES)

    scanned = priced.select("conv", "chunk", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    ends = map_rows(scanned, "c long, p long, ends array<long>", behind)

    def solve(batch: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chunk, last, kinds, ends in batch:
            price = auction(kinds, tuple(ends), last, STATES)
            ways = [trace(kinds, price, tuple(ends), last, s) if price[s] < NEVER else ("", -1) for s in STATES]
            yield conv, chunk, [a for a, _ in ways], [s for _, s in ways]

    ready = priced.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("p"))).select("conv", "chunk", "last", "kinds", "ends")
    ways = map_rows(ready, "conv long, chunk long, edits array<string>, leads array<int>", solve)

    def picked(batch: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(batch, key=lambda r: r[0]):
            state = 0
            for _, chunk, edits, leads in own:
                yield conv, chunk * LONG, edits[state]
                state = leads[state]

    edits = map_rows(ways.repartition("conv").sortWithinPartitions("conv", "chunk"), "c long, p long, edits string", picked)
    return ranked.join(edits, at("c", "p"), "left").select("conv", "pos", "turn", "role", "text", "fault", "edits")


def _long_walks(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, walk(r[2:] for r in own)


def _reports(walks: Iterator[tuple]) -> Iterator[tuple]:
    for conv, turns in walks:
        digest, joint = hashlib.sha256(), b""
        while True:
            try:
                role, text = next(turns)
            except StopIteration as end:
                yield conv, *end.value, digest.hexdigest()
                break
            digest.update(joint + f"{role}:{text}".encode())
            joint = b"\n"


def _turns(walks: Iterator[tuple]) -> Iterator[tuple]:
    for conv, turns in walks:
        for place, (role, text) in enumerate(turns):
            yield conv, place, role, text


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _run(rows: DataFrame, schema: str, each) -> DataFrame:
    short, long = _split(_with_marks(rows))
    short = short.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = map_rows(short, schema, lambda batch: each(_short_walks(batch)))
    if long is None:
        return out
    ordered = _long_rows(long).repartition("conv").sortWithinPartitions("conv", "pos")
    return out.unionByName(map_rows(ordered, schema, lambda batch: each(_long_walks(batch))))


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``as_rows``: faults, cost, the edits' initials and the digest of the repaired turns."""
    return _run(rows, REPORT, _reports)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: ``conv_id, turn, role, text``, turns numbered from 0."""
    return _run(rows, "conv_id long, turn long, role string, text string", _turns)


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule, then repaired."""
    return repair_reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _reach(state: str, cost: str, label: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 'r': {state}.r || {line}}}"


def _step_sql(to: int) -> str:
    """The best way to a state behind a row, from those (t0 to t3) before it."""
    name = NAMES.get(to)
    ways = [_reach(f"t{to}", "3", "D", "''")]
    for initial, leads in _LEADS.items():
        for q in (q for q, at in leads.items() if at == to):
            never = f"CASE WHEN must OR left(role, 1) <> '{initial}' THEN {NEVER} ELSE cut END"
            ways.append(_reach(f"t{q}", never, "K", "chr(10) || role || ':' || text"))
    if name:
        ways += [_reach(f"t{q}", f"CASE WHEN must THEN {NEVER} ELSE 2 + cut END", "R", f"chr(10) || '{name}:' || text") for q in STATES if given(q) == to]
    return f"list_min([{', '.join(ways)}])"


def _inserted_sql(to: int, before: str) -> str:
    ways = [f"{before}{to}"] + [_reach(f"{before}{q}", "2", "I", f"chr(10) || '{NAMES[to]}:'") for q in STATES if given(q) == to]
    return f"list_min([{', '.join(ways)}])"


_START = "{'c': %d::BIGINT, 'a': '', 'r': ''}"

#: One recursion step a row, with the best cost, edits and turns of each state.
OP13_SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), rows AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS twice, CAST(bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS BIGINT) AS cut,
    bare = '' OR nth > 1 AS must, coalesce(before || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE twice) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM faults GROUP BY conv_id
), way AS (
  SELECT conv_id, 0::BIGINT AS i, {_START % 0} AS s0, {_START % NEVER} AS s1, {_START % NEVER} AS s2, {_START % NEVER} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {", ".join(map(_step_sql, STATES))} FROM (
    SELECT conv_id, i, role, text, must, cut, s0 AS t0, s1 AS t1, t2, {_inserted_sql(ASSISTANT, "t").replace("t3,", "s3,", 1)} AS t3
    FROM (SELECT w.conv_id, f.i, role, text, must, cut, s0, s1, s3, {_inserted_sql(USER, "s")} AS t2 FROM way w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))
), ended AS (
  SELECT conv_id, i, list_min([s0, {_inserted_sql(ASSISTANT, "t").replace("t3,", "s3,", 1)}]) AS best FROM (SELECT *, {_inserted_sql(USER, "s")} AS t2 FROM way)
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.n
"""
