"""Edge strings, the twelve prompts, and plans."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hearthlore.functions import answers, facts, persona, rules, text
from hearthlore.operators import artifacts, evaluate, prompts, sampling, sessions
from hearthlore.sources import digests, files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0].y


def test_text(spark):
    assert one(spark, "Ünï don’t I'm 3-x", text.norm) == "n don t i'm 3 x"
    assert one(spark, "  a b\x1cc \x85", text.clean) == "a b c"
    for raw, n in (("twenty one", 1), ("five or two", 2), ("has 12 or two", 12), ("none", None)):
        assert one(spark, raw, lambda c: text.number_value(text.norm(c))) == n
    for raw, s in (("pies", "py"), ("loaf", "loaf"), ("boots", "boot")):
        assert one(spark, raw, text.singularize) == s
    assert [one(spark, r, text.article) for r in ("archer", "Owl", "baker", "")] == ["an", "an", "a", "an"]
    assert one(spark, "bIG oX", text.capitalize) == "Big ox"
    assert one(spark, "You know the gate is shut.", text.lead_in_strip) == "the gate is shut."


def test_norm_follows_case_folding(spark):
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c),) for c in points], "x string").select("x", text.norm(F.col("x")).alias("y")).collect()
    fold = lambda t: " ".join(re.sub(r"[^a-z0-9']+", " ", t.casefold()).split())
    assert [r.x for r in rows if r.y != fold(r.x)] == []


def test_persona(spark):
    get = lambda s: tuple(one(spark, s, persona.persona))
    assert get("Your name is A. You are from Yew.") == ("A", "from Yew", None)
    assert get("Your name is A. You are the guard.") == ("A", "the guard", None)
    assert get("Your name is A. You are a baker from Yew; quiet.") == ("A", "baker from Yew; quiet", None)
    assert get("Your name is Talia. You keep a small inn in Britain.") == ("Talia", "small inn", "Britain")
    assert one(spark, "Hello.", persona.persona) is None
    assert tuple(one(spark, "Your name is A. You are an elf near Yew", persona.persona_fallback)) == ("A", "elf", "Yew")


def test_facts(spark):
    assert one(spark, "Only one sentence.", lambda c: F.size(text.fact_sentences(text.sentences(c)))) == 0
    pairs = lambda n: [tuple(p) for p in one(spark, n, facts.price_pairs)]
    assert pairs("bread costs five coppers cheese costs twelve coppers") == [("bread", 5, None), ("cheese", 12, None)]
    assert pairs("two pies cost eight coppers") == [("pies", 8, 2)]
    asked = lambda q: one(spark, q, answers.asked_trade)
    assert [asked(q) for q in ("are you an archer", "are you there", "you are", "who is it")] == ["n archer", "re", "re", None]


def repair(spark, state, raw):
    df = spark.createDataFrame([(state, raw)], "state string, raw_text string").withColumn("persona", persona.persona(F.col("state")))
    return persona.with_claims(df).select(persona.repaired().alias("y")).collect()[0].y


def test_repair(spark):
    mira = "Your name is Mira. You are a baker from Yew."
    assert repair(spark, mira, "I am Mara, a fisher from Cove.") == "I am Mira, a baker from Yew."
    assert repair(spark, mira, "i am  mara") == "i am mara"
    assert repair(spark, mira, "Mira the Weaver works here.") == "I am Mira, a baker from Yew."
    assert repair(spark, "No persona.", "I am  Mara") == "I am Mara"
    assert repair(spark, "Your name is M (x. You are a baker.", "Call me M.") == "I am M (x, a baker."


# The twelve prompts and what has to answer them.
PROMPTS = [
    ("Your name is Elara. You are a weaver from Yew.", "Tell me plainly, who art thou?", "identity", "I am Elara, a weaver from Yew."),
    ("Your name is Corin. You are a mason from Trinsic.", "What town dost thou call home?", "model_first", "raw"),
    ("Your name is Nessa. You are a baker from Britain.", "Art thou Mara the fisherwoman from Cove?", "identity", "Nay. I am a baker."),
    ("Your name is Talia. You keep a small inn in Britain.", "I've but a few coppers. What cheap fare could fill me?", "fallback", "raw"),
    ("Your name is Alden. You are an experienced farmer near Vesper.", "Rain is coming fast. Should the cut hay remain in the field?", "fallback", "raw"),
    ("Your name is Pip. You are a cooper from Moonglow. Bread costs seven coppers today.", "How many coppers for a loaf today?", "numeric", "Bread costs 7 coppers."),
    ("Your name is Polly. You are a shopkeeper from Minoc. You have never travelled far and do not know distant roads.", "How do I reach Serpent Isle?", "uncertainty", "I know not; I cannot say."),
    ("Your name is Polly. You are a shopkeeper from Minoc. Road to Serpent Isle: take the east road to the ferry at dawn.", "How do I reach Serpent Isle?", "fallback", "raw"),
    ("Your name is Brina. You are a brewer from Cove. You are cheerful today.", "How fare thee this morning?", "fallback", "raw"),
    ("Your name is Toren. You are a baker from Moonglow. You watch the town quietly.", "What sounds greet thee when morning breaks?", "fact", "You watch the town quietly."),
    ("Your name is Garrick. You earn thy living at the forge in Minoc.", "My blade caught a stone and took a nick near the point. Is it worth mending?", "numeric", "You earn thy living at the forge in Minoc."),
    ("Your name is Mira. You are a tanner from Jhelom.", "I could have sworn thou wert from Yew.", "fallback", "raw"),
]


def test_prompts(spark):
    states = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PROMPTS)] + [(98, None)], "npc_id long, state string")
    turns = spark.createDataFrame([(i, i, p[1], "raw") for i, p in enumerate(PROMPTS)] + [(97, 97, "Who are you?", "raw"), (98, 98, None, None)], "turn_id long, npc_id long, player string, raw_text string")
    got = {r.turn_id: (r.rule, r.text) for r in answers.grounded(answers.turns_with_states(turns, states)).collect()}
    assert got == {i: p[2:] for i, p in enumerate(PROMPTS)} | {97: ("fallback", "raw"), 98: ("fallback", "")}


def test_prompt_arrays(spark):
    df = spark.createDataFrame([(["s"] * 60, ["p"] * 120, ["c"] * 50), ([], [], []), (["s"], ["p"], ["c", "<EOS>", "d"])], "state_tokens array<string>, player_tokens array<string>, completion array<string>")
    a, b, c = prompts.prompt_pack(df).collect()
    assert (len(a.prompt), a.prompt[:2], a.prompt.count("s"), a.prompt.count("p"), a.state_trimmed, a.player_trimmed) == (128, ["<BOS>", "<STATE>"], 39, 86, True, True)
    assert b.prompt == ["<BOS>", "<STATE>", "<PLAYER>", "<SAY>"] and not b.player_trimmed
    clip = prompts.completion_clip(df, F.lit(120)).collect()
    assert [(len(r.clipped), r.stop) for r in clip] == [(9, "context_limit_after_token"), (0, "input_exhausted"), (1, "EOS")]
    with pytest.raises(ValueError):
        prompts.prompt_pack(df, max_len=2)


def test_sampling(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, -5.0), (2, 9, 0.0)], "row_id long, item_id long, logit double")
    assert sorted(map(tuple, sampling.greedy_pick(s).collect())) == [(1, 1), (2, 9)]
    assert sorted((r.row_id, r.item_id) for r in sampling.nucleus_filter(s, 0.6).collect()) == [(1, 1), (2, 9)]
    assert sum(r.p for r in sampling.temperature_softmax(s, 0.5).collect()) == pytest.approx(2)
    assert {r.item_id for r in sampling.categorical_draw(s, 7, 0.999).collect()} <= {1, 2, 9}
    with pytest.raises(ValueError):
        sampling.temperature_softmax(s, 0)


def test_scores(spark):
    cases = spark.createDataFrame([("a", ["x y"], ["b"], None), ("c", None, None, ["no"])], "name string, required_any array<string>, required_all array<string>, forbidden array<string>")
    out = spark.createDataFrame([("a", "B!", 4, 2.0), ("c", "well", 1, 0.0)], "name string, text string, tokens int, seconds double")
    got = {r.name: (r.passed, r.reasons) for r in evaluate.score_cases(out, cases).collect()}
    assert got == {"a": (False, "missing any of: x y"), "c": (True, "")}
    assert tuple(evaluate.suite_summary(evaluate.score_cases(out, cases)).collect()[0]) == (1, 2, 50.0, 5, 2.5, 2)


LOGS = [
    ["/state", "/state", "hi", "/state", "/quit", "x", "/quit", "/state", "y"],
    ["/state", "/state", "/state", "S", "a", "", "/SHOW"],
    ["first", "/state", "", "q", "EXIT", "after"],
]


def walk(lines, state):
    expecting, closed, out = state is None, False, []
    for line in lines:
        now = state
        if closed:
            kind = "ignored"
        elif expecting:
            kind, state, expecting = "state", line, False
        else:
            low = line.lower()
            kind = "quit" if low in ("/quit", "/exit", "quit", "exit") else "state_command" if low == "/state" else "show" if low == "/show" else "turn" if line else "blank"
            closed, expecting = kind == "quit", kind == "state_command"
        out.append((kind, now))
    return out


@pytest.mark.parametrize("start", [None, "S0"])
def test_sessions(spark, start):
    rows = [(s, t, t, line, start) for s, log in enumerate(LOGS) for t, line in enumerate(log)]
    df = spark.createDataFrame(rows, "session_id long, ts long, turn_id long, player string, start_state string")
    got = {(r.session_id, r.turn_id): (r.kind, r.state) for r in sessions.session_replay(df).collect()}
    assert got == {(s, t): x for s, log in enumerate(LOGS) for t, x in enumerate(walk(log, start))}


def test_files(spark, tmp_path):
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "a.pt").write_bytes(b"abc")
    (tmp_path / "sums.txt").write_text("AB  x\n\nbad\n")
    (tmp_path / "meta.json").write_text('{"a": {"b": 1}}')
    assert {r.path: bytes(r.content) for r in files.artifacts(spark, str(tmp_path)).collect()}["model/a.pt"] == b"abc"
    assert {r.path: r.length for r in files.listing(spark, str(tmp_path)).collect()}["model/a.pt"] == 3
    assert sorted(r.value for r in files.manifest_text(spark, str(tmp_path / "sums.txt")).collect()) == ["", "AB  x", "bad"]
    assert files.metadata(spark, str(tmp_path / "meta.json")).collect()[0].a.b == 1


def test_bundle_of_real_files(spark, tmp_path):
    """From files on disk to verified rows, the bundle's root, and the checkpoint that its manifest names."""
    root = tmp_path / "outer" / "release"
    (root / "model").mkdir(parents=True)
    (root / "tokenizer").mkdir()
    (root / "model" / "own.pt").write_bytes(b"weights")
    (root / "model" / "final.pt").write_bytes(b"other")
    (root / "tokenizer" / "tokenizer.json").write_text("{}")
    (root / "manifest.json").write_text('{"production_checkpoint_archive_path":\n "model/own.pt"}')
    sums = [hashlib.sha256(b"weights").hexdigest() + "  model/own.pt", hashlib.sha256(b"x").hexdigest().upper() + "  model/final.pt", "ab  gone.pt", "bad", " "]
    (root / "SUMS").write_text("\n".join(sums))
    manifest = artifacts.manifest_scan(files.manifest_text(spark, str(root / "SUMS")))
    found = files.artifacts(spark, str(root))
    sums = digests.file_digests(spark, str(root), piece_bytes=3)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, artifacts.content_digests(found).collect()))
    assert sorted(map(tuple, artifacts.integrity_verify(manifest, sums).collect())) == [("gone.pt", "MISSING"), ("model/final.pt", "FAIL"), ("model/own.pt", "OK")]
    assert artifacts.integrity_summary(manifest, sums).collect()[0].passed is False
    listing = files.listing(spark, str(tmp_path)).select(F.lit("start").alias("start"), "path")
    assert [(r.root, r.status) for r in artifacts.bundle_discover(listing).collect()] == [("outer/release", "grandchild")]
    text_of = found.where("path = 'manifest.json'").select(F.lit("b").alias("bundle"), F.decode("content", "UTF-8").alias("manifest"))
    for declared, want in ((artifacts.declared_paths(text_of), ("model/own.pt", "declared")), (artifacts.declared_paths(text_of.withColumn("manifest", F.lit("{broken"))), ("model/final.pt", "preferred"))):
        rows = files.listing(spark, str(root)).select(F.lit("b").alias("bundle"), "path", F.lit(None).cast("string").alias("override_path")).join(declared, "bundle")
        assert [(r.path, r.how) for r in artifacts.checkpoint_select(rows).collect()] == [want]


def test_encode_content_with_a_tokenizer(spark):
    df = spark.createDataFrame([("ab  c",), (None,), ("",)], "t string")
    got = df.select(prompts.encode_content(F.col("t"), lambda: list).alias("x")).collect()
    assert [r.x for r in got] == [[" ", "a", "b", " ", "c"], None, [" "]]


def test_no_python_on_the_rule_path(spark):
    from hearthlore.plans import queries

    plan = queries.grounded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rule_tables_are_whole():
    assert len(rules.OCCUPATIONS) == 31 and len(rules.NUMBER_WORDS) == 21 and len(rules.STOP_WORDS) == 24 and len(rules.NAME_PHRASES) == 32
    assert [len(x) for x in (rules.HOME_PHRASES, rules.WARES_PHRASES, rules.WARES_WORDS, rules.TRADE_PHRASES, rules.PLACE_TERMS, rules.TIME_TERMS)] == [19, 13, 11, 23, 16, 11]
