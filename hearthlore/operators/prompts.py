"""Token sequences as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

BOS, EOS, STATE, PLAYER, SAY = "<BOS>", "<EOS>", "<STATE>", "<PLAYER>", "<SAY>"


def encode_content(text: Column, tokenizer: Callable[[], Callable[[str], list[str]]] | None = None) -> Column:
    """Tokens of a cleaned text behind one leading space; words, where no tokenizer is plugged in.

    ``tokenizer`` is called once a Python worker and returns a function of a text; a null text has no tokens.
    """
    content = F.concat(F.lit(" "), clean(text.cast("string")))
    if tokenizer is None:
        return F.regexp_extract_all(content, F.lit(r"( ?[^ ]+)"), F.lit(1))

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = tokenizer()
        for texts in batches:
            yield pd.Series([None if t is None else list(tokens(t)) for t in texts], dtype="object")

    return encode(content)


def prompt_pack(df: DataFrame, max_len: int = 128, max_state: int = 40, state: str = "state_tokens", player: str = "player_tokens") -> DataFrame:
    """Adds ``prompt`` (begin, head of the state, tail of the player, say) and the two trim flags."""
    if max_len < 3 or max_state < 1:
        raise ValueError("a prompt needs room for its markers")
    room = max_len - 2
    s, p = F.concat(F.array(F.lit(STATE)), F.col(state)), F.concat(F.array(F.lit(PLAYER)), F.col(player))
    df = df.withColumn("s", F.slice(s, 1, min(max_state, room))).withColumn("p", p).withColumn("left", F.lit(room) - F.size("s"))
    keep = F.least(F.size("p"), F.col("left"))
    tail = F.slice("p", F.size("p") - keep + 1, keep)
    return (
        df.withColumn("prompt", F.concat(F.array(F.lit(BOS)), "s", tail, F.array(F.lit(SAY))))
        .withColumn("state_trimmed", F.size(s) > max_state)
        .withColumn("player_trimmed", F.size("p") > F.col("left"))
        .drop("s", "p", "left")
    )


def completion_clip(df: DataFrame, prompt_tokens: Column, max_len: int = 128, max_new: int = 32, completion: str = "completion") -> DataFrame:
    """Adds ``clipped`` and ``stop``: the end token inside the cap, else the cap's reason, else the input's end."""
    room = F.lit(max_len) - prompt_tokens + 1
    cap = F.greatest(F.least(F.lit(max_new), room), F.lit(0))
    c = F.col(completion)
    end = F.array_position(c, EOS)
    stop = (
        F.when((end > 0) & (end <= cap), "EOS").when(F.size(c) < cap, "input_exhausted").when(room <= max_new, "context_limit_after_token").otherwise("max_new_tokens")
    )
    keep = F.when((end > 0) & (end <= cap), end - 1).otherwise(F.least(F.size(c), cap))
    return df.withColumn("clipped", F.slice(c, F.lit(1), keep.cast("int"))).withColumn("stop", stop)
