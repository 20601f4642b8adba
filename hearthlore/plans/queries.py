"""One query an operator, over the given tables or what Spark derives from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, facts, persona, rules, text
from ..operators import artifacts, evaluate, prompts, retrieval, rulebook, sampling, sessions
from ..session import table
from ..sources import fixtures
from ..streaming import turns as streams

SEED = 5042
#: Characters of a transcript's piece.
PIECE = 1000


def _docs(spark, d):
    return table(spark, d, "documents")


def _states(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.npc_profile(spark, d)
    return p.select("npc_id", text.state_render(*(F.col(c) for c in ("name", "role", "home", "facts"))).alias("state"))


def _features(spark, d):
    return answers.state_features(_states(spark, d))


def _joined(spark, d):
    return answers.turns_with_states(fixtures.turns(spark, d), _states(spark, d))


def _on_docs(name: str, f) -> callable:
    return lambda spark, d: _docs(spark, d).select("doc_id", f(F.col("text")).alias(name))


def _on_features(**cols):
    return lambda spark, d: _features(spark, d).select("npc_id", *[c().alias(n) for n, c in cols.items()])


def _on_turns(seed: int | None = None, **cols) -> callable:
    def run(spark, d):
        df = _joined(spark, d).withColumn("pick", answers.pick_number(F.col("turn_id"), seed))
        df = df.withColumn("fact", facts.relevant_fact(F.col("facts"), F.col("fact_norms"), F.col("q")))
        return df.select("turn_id", *[c().alias(n) for n, c in cols.items()])

    return run


def _claims(*cols: str) -> callable:
    return lambda spark, d: persona.with_claims(_joined(spark, d)).select("turn_id", *cols)


def _joined_text(c: str) -> Column:
    return F.array_join(c, "|")


def _pairs(c: Column) -> Column:
    show = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["label"], show(p["value"]), show(p["quantity"]))), "|")


def persona_columns(c: Column) -> list[Column]:
    return [c[x].alias(x) for x in ("name", "profession", "home")]


def _words_of_parts(f):
    return lambda spark, d: table(spark, d, "part").select("p_partkey", f(F.col("p_name")).alias("v"))


def _profile(**cols):
    return lambda spark, d: fixtures.npc_profile(spark, d).select("npc_id", *[c().alias(n) for n, c in cols.items()])


def fact_table(spark, d):
    long = _features(spark, d).select("npc_id", F.posexplode(F.arrays_zip("facts", "fact_norms")).alias("idx", "f"))
    n = F.col("f.fact_norms")
    return long.select("npc_id", "idx", F.col("f.facts").alias("fact"), n.alias("norm"), F.array_join(F.array_remove(F.split(n, " "), ""), "|").alias("words"))


def manifest(spark, d):
    return artifacts.manifest_scan(fixtures.manifest_lines(spark, d))


def _digests(spark, d):
    return artifacts.content_digests(fixtures.given(spark, d, fixtures.ARTIFACT, "documents"))


def declared_checkpoint(spark, d):
    """The checkpoints of bundles whose manifests are JSON texts, some of them broken."""
    files = fixtures.given(spark, d, fixtures.MODEL_FILES, "documents").drop("declared_path")
    manifests = fixtures.given(spark, d, fixtures.MANIFEST_JSON, "documents")
    return artifacts.checkpoint_select(files.join(artifacts.declared_paths(manifests), "bundle", "left"))


def word_tokenizer():
    """A stand-in for a tokenizer: words with the space before them."""
    return re.compile(" ?[^ ]+").findall


def _scores(spark, d):
    return fixtures.given(spark, d, fixtures.SCORES, "lineitem")


def _generation(spark, d):
    return fixtures.given(spark, d, fixtures.GENERATION, "events")


def grounded(spark, d, seed=None, fallback=True):
    return answers.grounded(_joined(spark, d), seed, fallback).select("turn_id", "text", "rule")


def respond(spark, d, raw_model: bool = False):
    """Generation records with the grounded text; ``raw_model`` leaves the model's text as it is."""
    answered = answers.grounded(_joined(spark, d)).select("turn_id", "text", "rule", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    text_of = F.col("raw_text") if raw_model else F.col("text")
    out = _generation(spark, d).join(answered, "turn_id").withColumn("text", text_of)
    return out.select("turn_id", "tokens", "stop", "text", "raw_text", (F.col("text") != F.col("raw_text")).alias("grounded_applied"))


def _cases(spark, d):
    """A keyword case a character: who and what it says it is, and what it must not claim."""
    p = fixtures.npc_profile(spark, d)
    return p.select(
        F.col("npc_id").alias("name"), F.array(F.lower("name"), F.lower("role")).alias("required_all"),
        F.when(F.col("home") != "", F.array("home", F.lit("coppers"))).alias("required_any"), F.array(F.lit("I am Mara"), F.lit("know not")).alias("forbidden"),
    )


def scored(spark, d):
    outputs = answers.grounded(_joined(spark, d)).select("turn_id", F.col("npc_id").alias("name"), "text")
    return evaluate.score_cases(outputs, _cases(spark, d))


def suite_summary(spark, d):
    return evaluate.suite_summary(scored(spark, d).join(_generation(spark, d), "turn_id")).select(
        "passed", "total", F.round("rate", 6).alias("rate"), "tokens", F.round("tokens_per_second", 6).alias("tokens_per_second"), "exit_code"
    )


def _token_turn(spark, d):
    """Word arrays from whole documents: a state's, a player's (a third each) and a completion's (the rest)."""
    words = _docs(spark, d).select("doc_id", F.array_remove(F.split(text.clean(F.col("text")), " "), "").alias("w"))
    end = F.col("doc_id") % 60
    third = F.floor(F.size("w") / 3).cast("int")
    c = F.slice("w", 2 * third + 1, F.size("w"))
    c = F.when(end.between(1, 50), F.transform(c, lambda x, i: F.when(i + 1 == end, prompts.EOS).otherwise(x))).otherwise(c)
    return words.select(F.col("doc_id").alias("turn_id"), F.slice("w", F.lit(1), third).alias("state_tokens"), F.slice("w", third + 1, third).alias("player_tokens"), c.alias("completion"))


def _packed(spark, d):
    return prompts.prompt_pack(_token_turn(spark, d))


def clipped(spark, d):
    return prompts.completion_clip(_packed(spark, d), F.size("prompt")).select("turn_id", F.size("clipped").alias("tokens"), F.array_join("clipped", " ").alias("clipped"), "stop")


def _session_log(spark, d):
    start = _states(spark, d).select("npc_id", F.col("state").alias("start"))
    return fixtures.turns(spark, d).join(start, "npc_id", "left").withColumn("start_state", F.when(F.col("session_id") % 3 != 0, F.col("start")))


def replayed(spark, d):
    return sessions.session_replay(_session_log(spark, d))


def _log(spark, d):
    answered = answers.grounded(_joined(spark, d)).where(sessions.turn_kind(F.col("player")) == "turn")
    return answered.where("state IS NOT NULL").select("session_id", "ts", "turn_id", "player", "text", "state")


def transcripts(spark, d):
    return sessions.transcript_render(_log(spark, d))


def ruled(spark, d):
    """The answers and gates of the rule table for all turns."""
    states = _states(spark, d).select("npc_id", text.norm(F.col("state")).alias("s"))
    turns = fixtures.turns(spark, d).select("turn_id", "npc_id", text.norm(F.col("player")).alias("q")).join(states, "npc_id", "left")
    found = rulebook.rule_answers(turns, rulebook.Rulebook(rulebook.fixed_rules(spark)), rulebook.ANSWERING + rulebook.GATES)
    return found.select("turn_id", *rulebook.ANSWERING, *(F.col(g).isNotNull().alias(g) for g in rulebook.GATES))


def retrieved(spark, d):
    """The relevant facts of all turns by the inverted index."""
    turns = fixtures.turns(spark, d).select("turn_id", "npc_id", text.norm(F.col("player")).alias("q"))
    return retrieval.retrieve(turns, fact_table(spark, d).select("npc_id", "idx", "fact", "norm")).select("turn_id", F.col("fact").alias("v"))


def markers(spark, d):
    """Words of questions that no document's source or language names and no part name has."""
    asked = fixtures.turns(spark, d).select(F.explode(F.split(text.norm(F.col("player")), " ")).alias("token")).where("token <> ''").distinct()
    known = table(spark, d, "part").select(F.explode(F.split(text.norm(F.col("p_name")), " ")).alias("token"))
    return artifacts.marker_check(asked, known.union(_features(spark, d).select(F.explode(F.split("s", " ")))).distinct())


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


Q, S, NF, PAIRS, TEXT = (lambda n=n: F.col(n) for n in ("q", "s", "nf", "pairs", "text"))  # made when a session exists


def queries() -> dict:
    """By name, functions of a session and a folder of tables."""
    return {
        "a1_manifest_scan": manifest,
        "a2_integrity_verify": lambda s, d: artifacts.integrity_verify(manifest(s, d), _digests(s, d)),
        "a2_integrity_summary": lambda s, d: artifacts.integrity_summary(manifest(s, d), _digests(s, d)),
        "a3_bundle_discover": lambda s, d: artifacts.bundle_discover(fixtures.given(s, d, fixtures.LISTING, "documents")),
        "a4_checkpoint_select": lambda s, d: artifacts.checkpoint_select(fixtures.given(s, d, fixtures.MODEL_FILES, "documents")),
        "a4_declared_checkpoint": declared_checkpoint,
        "a4_tokenizer_select": lambda s, d: artifacts.tokenizer_select(fixtures.given(s, d, fixtures.MODEL_FILES, "documents")),
        "b1_clean_text": _on_docs("v", text.clean),
        "b2_norm_text": _on_docs("v", text.norm),
        "b3_normalize_prompt_text": lambda s, d: fixtures.turns(s, d).select("turn_id", text.clean(F.col("raw_text").cast("string")).alias("v")),
        "b4_state_sentences": lambda s, d: _docs(s, d).select("doc_id", text.sentences(TEXT()).alias("p")).select("doc_id", F.size("p").alias("n"), _joined_text("p").alias("v")),
        "b5_fact_sentences": _on_features(n=lambda: F.size("facts"), v=lambda: _joined_text("facts")),
        "b6_fact_table": fact_table,
        "b7_number_value": _on_docs("v", lambda c: text.number_value(text.norm(c))),
        "b8_article": _profile(v=lambda: text.article(F.col("role")), w=lambda: text.article(F.col("home"))),
        "b9_role_with_article": _profile(v=lambda: text.role_with_article(F.col("role")), w=lambda: text.role_with_article(F.concat(F.lit("The "), F.col("role")))),
        "b10_state_render": _states,
        "b11_capitalize": _words_of_parts(text.capitalize),
        "b12_singularize": lambda s, d: table(s, d, "part").select("p_partkey", text.singularize(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "ies").when(F.col("p_size") % 3 == 1, "s").otherwise(""))).alias("v")),
        "b13_lead_in_strip": lambda s, d: fact_table(s, d).select("npc_id", "idx", text.lead_in_strip(F.concat(F.when(F.col("npc_id") % 2 == 0, "The State says ").otherwise(""), F.col("fact"))).alias("v")),
        "b14_persona_extract": lambda s, d: _states(s, d).select("npc_id", *persona_columns(persona.persona(F.when(F.col("npc_id") % 5 == 0, F.regexp_replace("state", "You are an? ", "You keep a ")).otherwise(F.col("state"))))),
        "b15_persona_fallback": lambda s, d: _states(s, d).select("npc_id", *persona_columns(persona.persona_fallback(F.regexp_replace("state", r"\. [^.]*costs .*$", "")))),
        "c1_model_first_route": lambda s, d: fixtures.turns(s, d).select("turn_id", answers.model_first(text.norm(F.col("player"))).alias("v")),
        "c2_fact_trigger": lambda s, d: fixtures.turns(s, d).select("turn_id", answers.fact_trigger(text.norm(F.col("player"))).alias("v")),
        "c3_numeric_gate": lambda s, d: fixtures.turns(s, d).select("turn_id", answers.numeric_gate(text.norm(F.col("player"))).alias("v")),
        "c4_turn_filter": lambda s, d: fixtures.turns(s, d).select("turn_id", sessions.turn_kind(F.col("player")).alias("kind")),
        "d1_social_answer": _on_turns(v=lambda: answers.social_answer(Q())),
        "d2_practical_answer": _on_turns(v=lambda: answers.practical_answer(F.col("practical"), Q(), S(), F.col("fact"))),
        "d3_capability_answer": _on_turns(v=lambda: answers.capability_answer(Q(), S())),
        "d4_world_answer": lambda s, d: _docs(s, d).select("doc_id", answers.world_answer(text.norm(F.concat(F.when(F.col("doc_id") % 4 == 0, "The traveler needs food and rest. ").when(F.col("doc_id") % 4 == 1, "A monster blocks the ore tunnel! ").otherwise(""), TEXT()))).alias("v")),
        "d5_uncertainty_answer": _on_features(v=lambda: F.col("uncertain")),
        "d6_price_pairs": _on_features(v=lambda: _pairs(PAIRS())),
        "d7_cheapest_item": _on_turns(v=lambda: facts.cheapest_item(PAIRS(), Q())),
        "d8_affordability": _on_turns(v=lambda: facts.affordability(PAIRS(), NF(), Q())),
        "d9_unit_price": _on_turns(v=lambda: facts.unit_price(PAIRS(), Q())),
        "d10_first_price": _on_turns(v=lambda: facts.first_price(PAIRS())),
        "d11_numeric_answer": _on_turns(v=lambda: facts.numeric_answer(F.col("price_lines"), Q(), F.col("fact"))),
        "d12_profession_check": _on_turns(v=lambda: answers.profession_check(Q(), "say", F.col("pick"))),
        "d13_trade_answer": _on_turns(v=lambda: answers.trade_answer(Q(), "say", F.col("pick"))),
        "d14_name_answer": _on_turns(v=lambda: answers.name_answer(Q(), "say", F.col("pick"))),
        "d15_identity_answer": _on_turns(v=lambda: answers.identity_answer(Q(), "who", "say", F.col("pick"))),
        "d16_variant_choice": _on_turns(SEED, v=lambda: F.col("pick") % 5, w=lambda: answers.name_answer(Q(), "say", F.col("pick"))),
        "e1_relevant_fact": _on_turns(v=lambda: F.col("fact")),
        "d1_rule_table": ruled,
        "e1_fact_index": retrieved,
        "e2_greedy_pick": lambda s, d: sampling.greedy_pick(_scores(s, d)),
        "e3_temperature_softmax": lambda s, d: sampling.temperature_softmax(_scores(s, d), 0.7).select("row_id", "item_id", r6("p")),
        "e4_nucleus_filter": lambda s, d: sampling.nucleus_filter(_scores(s, d), 0.9).select("row_id", "item_id", "rank", r6("p")),
        "e5_categorical_draw": lambda s, d: sampling.categorical_draw(_scores(s, d), SEED, 0.9),
        "e3_softmax_any": lambda s, d: sampling.softmax_any(_scores(s, d), 0.7).select("row_id", "item_id", r6("p")),
        "e4_nucleus_any": lambda s, d: sampling.nucleus_any(_scores(s, d), 0.9).select("row_id", "item_id", "rank", r6("p")),
        "e5_draw_any": lambda s, d: sampling.draw_any(_scores(s, d), SEED, 0.9),
        "f1_claim_name": _claims("claim_name"),
        "f2_claim_self": _claims("claim_self"),
        "f3_claim_trade": _claims("claim_trade"),
        "f4_claim_title": _claims("claim_title"),
        "f5_claim_home": _claims("wrong_home"),
        "f6_persona_consistency": lambda s, d: persona.with_claims(_joined(s, d)).select("turn_id", persona.repaired().alias("v")),
        "f7_persona_audit": _claims("wrong_name", "wrong_profession", "wrong_home"),
        "g1_grounded_response": grounded,
        "g1_grounded_response_seeded": lambda s, d: grounded(s, d, SEED),
        "g2_respond": respond,
        "g2_respond_raw_model": lambda s, d: respond(s, d, True),
        "g3_respond_no_fallback": lambda s, d: grounded(s, d, fallback=False),
        "g4_marker_check": markers,
        "h1_score_case": lambda s, d: scored(s, d).select("turn_id", "passed"),
        "h2_score_reasons": lambda s, d: scored(s, d).select("turn_id", "reasons"),
        "h3_suite_summary": suite_summary,
        "h4_throughput": lambda s, d: evaluate.throughput(_generation(s, d)).select("turn_id", r6("tokens_per_second"), r6("latency_ms")),
        "h5_trim_warning": lambda s, d: evaluate.trim_warning(_generation(s, d)).select("turn_id", "state_trimmed", "player_trimmed"),
        "i1_encode_content": lambda s, d: _docs(s, d).select("doc_id", prompts.encode_content(TEXT()).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("v")),
        "i1_plugged_tokenizer": lambda s, d: _docs(s, d).select("doc_id", prompts.encode_content(TEXT(), word_tokenizer).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("v")),
        "i2_prompt_pack": lambda s, d: _packed(s, d).select("turn_id", F.size("prompt").alias("n"), F.array_join("prompt", " ").alias("v")),
        "i3_prompt_trim_flags": lambda s, d: _packed(s, d).select("turn_id", "state_trimmed", "player_trimmed"),
        "i4_completion_clip": clipped,
        "s1_session_replay": lambda s, d: replayed(s, d).select("session_id", "turn_id", "kind", "state"),
        "s1_replay_any": lambda s, d: sessions.replay_any(_session_log(s, d)).select("session_id", "turn_id", "kind", "state"),
        "s2_transcript_render": transcripts,
        "s2_transcript_pieces": lambda s, d: sessions.transcript_pieces(_log(s, d), PIECE),
        "s3_respond_stream": streams.respond_stream_query,
        "g2_respond_late_text": streams.late_text_query,
        "s4_session_state_stream": streams.session_stream_query,
        "j1_fallback_hook": streams.fallback_hook_query,
    }
