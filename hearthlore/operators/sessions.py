"""Session logs: what each line means, and transcripts.

A session is ordered by time and turn. In the plain forms it is one group of a window; Spark
sorts and spills it outside memory limits, and only the transcript holds a session's text in one
row. ``replay_any`` and ``transcript_pieces`` take sessions of any length over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import written
from .scan import chunk, ranged, running, with_parts

QUIT = ["/quit", "/exit", "quit", "exit"]


def turn_kind(player: Column) -> Column:
    """``quit``, ``state_command``, ``show``, ``blank`` or ``turn``, by the whole line."""
    line = F.lower(strip(player))
    return F.when(line == "", "blank").when(line.isin(QUIT), "quit").when(line == "/state", "state_command").when(line == "/show", "show").otherwise("turn")


def session_replay(turns: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``state`` (in force when the line is read) to ``session_id, ts, turn_id, player, start_state``.

    The line behind a state command is the state whatever it says, so in a run of such
    commands every second one is a state; without a starting state the first line is one.
    Lines behind a quit are ``ignored``.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "turn_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = turns.withColumn("line", strip(F.coalesce("player", F.lit("")))).withColumn("said", turn_kind(F.col("line"))).withColumn("n", F.row_number().over(w))
    is_state = F.col("said") == "state_command"
    df = df.withColumn("other", F.max(F.when(~is_state, F.col("n")).otherwise(0)).over(upto))
    shifted = (F.col("other") == 0) & F.col("start_state").isNull()
    odd = (F.col("n") - F.col("other")) % 2 == 1
    df = df.withColumn("active", is_state & F.when(shifted, ~odd).otherwise(odd))
    first = (F.col("n") == 1) & F.col("start_state").isNull()
    df = df.withColumn("taken", first | F.coalesce(F.lag("active").over(w), F.lit(False)))
    df = df.withColumn("closed", F.coalesce(F.max(F.when(~F.col("taken") & (F.col("said") == "quit"), 1).otherwise(0)).over(before), F.lit(0)) > 0)
    state = F.coalesce(F.last(F.when(F.col("taken") & ~F.col("closed"), F.col("line")), ignorenulls=True).over(before), F.col("start_state"))
    kind = F.when(F.col("closed"), "ignored").when(F.col("taken"), "state").otherwise(F.col("said"))
    return df.withColumn("state", state).withColumn("kind", kind).drop("line", "said", "n", "other", "active", "taken", "closed")


def transcript_render(log: DataFrame) -> DataFrame:
    """``session_id, transcript`` from ``session_id, ts, turn_id, player, text`` and ``state``: the state, then questions and answers."""
    entry = F.concat(F.lit("YOU: "), strip(F.col("player")), F.lit("\n\nNPC: "), F.col("text"), F.lit("\n\n"))
    parts = log.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "turn_id", entry.alias("entry")))).alias("entries"), F.min_by("state", F.struct("ts", "turn_id")).alias("state")
    )
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "")
    return parts.select("session_id", F.concat(F.lit("SYSTEM: NPC state locked: "), "state", F.lit("\n\n"), body).alias("transcript"))


def _chunk_marks(df: DataFrame, w, entering: str, first_taken: Column) -> dict[str, Column]:
    """Whether a line of a chunk switches to a state, is taken as one, and quits, where the chunk is entered in one way."""
    odd = (F.col("n") - F.col("other")) % 2 == 1
    active = (F.col("said") == "state_command") & F.when((F.col("other") == 0) & first_taken, ~odd).otherwise(odd)
    taken = ((F.col("n") == 1) & first_taken) | F.coalesce(F.lag(active).over(w), F.lit(False))
    return {f"active_{entering}": active, f"taken_{entering}": taken, f"quit_{entering}": ~taken & (F.col("said") == "quit")}


#: How a chunk of a session may be entered: a line is a turn, is a state, or is ignored.
TURN, STATE, CLOSED = "turn", "state", "closed"


def replay_any(turns: DataFrame) -> DataFrame:
    """``session_replay`` for sessions of any length: a parallel scan of its three modes.

    Rows are ranged by session and order, and what a partition has of a session is a chunk. Each
    chunk is read for both modes in which it can be entered open (a turn comes, or a state does):
    the mode at its end and the last state taken. These two answers a chunk are composed from
    chunk to chunk, as many as the session's partitions, and then each chunk is replayed from its
    own mode and state. ``start_state`` is the same in all rows of a session.
    """
    order = ["ts", "turn_id"]
    lines = turns.withColumn("line", strip(F.coalesce("player", F.lit("")))).withColumn("said", turn_kind(F.col("line")))
    rows, w = ranged(lines, "session_id", order), chunk("session_id", order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("other", F.max(F.when(F.col("said") != "state_command", F.col("n")).otherwise(0)).over(upto))
    for mode in (TURN, STATE):
        rows = rows.withColumns(_chunk_marks(rows, w, mode, F.lit(mode == STATE)))
        rows = rows.withColumn(f"closed_{mode}", F.coalesce(F.bool_or(f"quit_{mode}").over(before), F.lit(False)))
    ways = {m: (F.expr(f"CASE WHEN bool_or(quit_{m}) THEN '{CLOSED}' WHEN max_by(active_{m}, n) THEN '{STATE}' ELSE '{TURN}' END"), F.expr(f"max_by(line, n) FILTER (WHERE taken_{m} AND NOT closed_{m})")) for m in (TURN, STATE)}
    chunks = rows.groupBy("session_id", "part").agg(F.min_by("start_state", "n").alias("begun"), *(c.alias(f"{name}_{m}") for m, cs in ways.items() for name, c in zip(("to", "text"), cs)))
    steps = chunks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", *[c for c in chunks.columns if c not in ("session_id", "part")]))).alias("steps"))
    composed = f"""aggregate(steps,
      named_struct('mode', CASE WHEN steps[0].begun IS NULL THEN '{STATE}' ELSE '{TURN}' END, 'text', steps[0].begun, 'out', CAST(array() AS array<struct<part:int,mode:string,text:string>>)),
      (a, x) -> named_struct(
        'mode', CASE a.mode WHEN '{TURN}' THEN x.to_{TURN} WHEN '{STATE}' THEN x.to_{STATE} ELSE a.mode END,
        'text', coalesce(CASE a.mode WHEN '{TURN}' THEN x.text_{TURN} WHEN '{STATE}' THEN x.text_{STATE} END, a.text),
        'out', concat(a.out, array(named_struct('part', x.part, 'mode', a.mode, 'text', a.text)))),
      a -> a.out)"""
    entries = steps.select("session_id", F.expr(f"inline({composed})")).withColumnsRenamed({"mode": "entered", "text": "entered_with"})
    rows = with_parts(rows, entries, "session_id")
    by_mode = lambda c: F.expr(f"CASE entered WHEN '{TURN}' THEN {c}_{TURN} WHEN '{STATE}' THEN {c}_{STATE} END")
    rows = rows.withColumns({"taken": F.coalesce(by_mode("taken"), F.lit(False)), "ended": F.coalesce(by_mode("closed"), F.lit(True))})
    state = F.coalesce(F.last(F.when(F.col("taken") & ~F.col("ended"), F.col("line")), ignorenulls=True).over(before), F.col("entered_with"))
    kind = F.when(F.col("ended"), "ignored").when(F.col("taken"), "state").otherwise(F.col("said"))
    return rows.withColumns({"state": state, "kind": kind}).select(*turns.columns, "state", "kind")


def transcript_pieces(log: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``session_id, piece, text``: ``transcript_render`` cut into pieces of ``size`` characters, the last one of a session shorter.

    Where an entry stands is the running total of the lengths before it, so a session of any
    length is rendered by several tasks, and no row is longer than ``size``.
    """
    if size < 1:
        raise ValueError("a piece has at least one character")
    entry = F.concat(F.lit("YOU: "), strip(F.col("player")), F.lit("\n\nNPC: "), F.col("text"), F.lit("\n\n"))
    told = written(log.select("session_id", F.lit(1).alias("place"), "ts", "turn_id", "state", entry.alias("entry")), "entries")
    head = F.concat(F.lit("SYSTEM: NPC state locked: "), F.min_by("state", F.struct("ts", "turn_id")), F.lit("\n\n"))
    heads = told.groupBy("session_id").agg(head.alias("entry")).withColumn("place", F.lit(0)).where("entry IS NOT NULL")  # without a state there is no transcript
    rows = heads.unionByName(told.drop("state").where("entry <> ''"), allowMissingColumns=True)
    order = ["place", "ts", "turn_id"]
    rows = running(ranged(rows, "session_id", order), "session_id", order, at=F.length("entry"))
    cuts = F.explode(F.expr(f"sequence(at div {size}, (at + length(entry) - 1) div {size})"))
    parts = rows.select("session_id", "at", "entry", cuts.alias("piece"))
    parts = parts.select("session_id", "piece", "at", F.expr(f"substring(entry, CAST(greatest(piece * {size} - at, 0) + 1 AS INT), CAST((piece + 1) * {size} - greatest(at, piece * {size}) AS INT))").alias("part"))
    joined = parts.groupBy("session_id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    whole = joined.select("session_id", "piece", F.array_join("parts.part", "").alias("text"))
    return whole.join(heads.select(F.col("session_id").alias("of")), F.col("session_id").eqNullSafe(F.col("of")), "left_semi")


def write_transcripts(pieces: DataFrame, path: str) -> None:
    """Pieces as files in which each session's follow one another."""
    pieces.repartitionByRange("session_id", "piece").sortWithinPartitions("session_id", "piece").write.parquet(path)
