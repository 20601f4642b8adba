"""What each rule and each phrase has to give, written out: nothing here is taken from the rule module."""

import pytest
from pyspark.sql import functions as F

from hearthlore.functions import answers, facts, persona, text

# An utterance or a state for each rule, and the answer that the rule has to give.
SOCIAL = {
    "Hello!": "Hail, friend. What brings thee here?", "hi, you": "Hail, friend. What brings thee here?", "Hey...": "Hail, friend. What brings thee here?",
    "Hail thee": "Hail, friend. What brings thee here?", "GREETINGS": "Hail, friend. What brings thee here?",
    "Do have a good day": "Aye, and to thee as well. Safe roads.", "Good day.": "Aye, and to thee as well. Safe roads.", "Good morrow!": "Aye, and to thee as well. Safe roads.",
    "I thank thee": "You are welcome, friend.", "Now fare thee well": "Farewell, and safe roads, friend.", "Farewell": "Farewell, and safe roads, friend.", "Well, goodbye": "Farewell, and safe roads, friend.",
    "Such a rotten day": "I am sorry. I hope tomorrow is better.", "A fine morning, no?": "Aye, a fair morning indeed.", "That was rude": "Forgiven, friend.", "So sorry": "Forgiven, friend.",
    "I did not understand": "I shall say it plain and simple.", "The bank is packed": "Aye, the bank is busy today.", "Oh, the moongate is busy": "Travelers gather at the busy moongate.",
    "On the road all day": "Rest and food should serve you well.", "A cheap room?": "Aye, I have a cheap room tonight.", "Is a room cheap?": "Aye, I have a cheap room tonight.",
    "hailstorms": None, "oh hello": None, "a good day": None, "good evening": None, "a room": None,
}
PRACTICAL = {
    "The wet leather hangs.": "Nay. Dry wet leather slowly away from strong heat.", "The cut hay lies.": "Nay. Bring the hay under cover before the rain.",
    "Hay is out, rain is near.": "Nay. Bring the hay under cover before the rain.", "Grain and hay.": "Nay. Bring the hay under cover before the rain.", "The dough waits.": "Let the dough rest and rise.",
    "A wall crack grows.": "Clear the crack before repairing the wall.", "A bargain, not witnessed.": "Write it, date it, and have it witnessed.", "A frightened flock.": "Calm the flock and give it space.",
    "The flock needs calm.": "Calm the flock and give it space.", "A clean bandage is here.": "Cover the washed cut with a clean bandage.", "One leaking cask.": "Repair the leaking cask with a new hoop.",
    "The monsters block it.": "Nay. Stop and leave the unsafe tunnel.", "The roof is cracking.": "Nay. Stop and leave the unsafe tunnel.", "It has a small nick.": "Aye. Repair and grind the blade smooth.",
    "A shallow cut.": "Wash the shallow cut with clean water first.", "There is road grit.": "Wash the shallow cut with clean water first.", "The door drags.": "Check the hinge first.",
    "The stew is too thin.": "Simmer it to reduce and thicken it.", "The field is waterlogged.": "Nay. Drain the wet field and wait before sowing.", "A burnt loaf.": "Nay. Water cannot save the burnt loaf.",
    "The wall crack and the dough.": "Let the dough rest and rise.", "A bargain.": None, "Hay.": None, "The leather is wet.": None,
}
WORLD = {
    "They wear matching blue cloaks.": "Aye. Matching blue cloaks are good guild work for a weaver.", "A bard is playing outside the bank.": "Aye. The busy bank gives the bard an audience for tips.",
    "The guild has hung its colors.": "The guild's colors show its presence above those houses.", "A ship needs casks for water and provisions.": "The casks should hold water and provisions.",
    "A mage asks for a quiet room to study.": "A quiet room away from the common room suits the mage.", "The traveler needs food and rest.": "The traveler needs food and rest.",
    "Adventurers crowd the bank.": "Adventurers crowd the bank after a dungeon run.", "Travelers gather at the moongate.": "Travelers gather at the moongate at sunrise.",
    "A monster blocks the ore tunnel.": "The monster must be cleared from the ore tunnel.", "A beast has frightened the flock.": "The frightened flock needs calming.", "A quiet room.": None,
}
UNCERTAINTY = {
    "You have no information.": "I know not; I cannot say.", "You do not know.": "I know not; I cannot say.", "You never met her.": "I know her not; we have never met.",
    "You have never visited Cove.": "I know not that road well enough to advise thee.", "You have never travelled.": "I know not that road well enough to advise thee.",
    "You never met her and have never visited her; you do not know.": "I know not; I cannot say.", "You never met her, never visited.": "I know her not; we have never met.", "You know it.": None,
}
CAKE = {
    ("Can you make a cake?", "You are a baker."): "Aye. I can bake a simple cake, if thou hast the coin and ingredients.", ("A cake, could you?", "You bake."): "Aye. I can bake a simple cake, if thou hast the coin and ingredients.",
    ("Do you know how to make a cake?", "You are a cook."): "I know not whether I can bake cakes; that is not my stated trade.", ("A cake!", "You are a baker."): None, ("Can you bake?", "You are a baker."): None,
}
ASKING = {("What shall I pack?", "A dungeon is near."): "Pack bread and water for the dungeon.", ("What shall I pack?", "A road is near."): None, ("What?", "A dungeon is near."): None}
GATES = {
    "home": """where are you from; where do you live; where is your home; where do you call home; what town do you call home; what is your hometown; which town is home; where do you hail from;
        where dost thou dwell; where is thy home; what place is home; what place do you call home; where's home; where is home; where are you based; where do you reside; what city are you from;
        what village are you from; what land are you from; where they live; which is based here; what did they reside in; where to dwell; which hail; what home""",
    "wares": """what do you sell; what are you selling; what wares; what goods; what do you have for sale; what is for sale; what are your wares; what do you carry; what is in stock; what can i buy;
        what can i purchase; show me your wares; what have you got; i sell; selling; wares; goods; sale; stock; buy; purchase; carry; offer; available""",
    "neither": "hello; who are you; where is the gate; home sweet home; live well; how much is it; what is thy trade; what hour is it",
    "fact": "who; whose; where; which; when; route; road; what does it; what should i; what is it; what lies there; what room; what must i; who gathers",
    "no fact": "what did it; tell me; how far; why; a gate",
    "numbers": "how much; price; cost; copper; afford; pay; cheaper; worth",
    "no numbers": "how many; cheap; coin; gold",
}
NAMES = """what is your name; what's your name; what is thy name; what's thy name; tell me your name; tell me thy name; may i know your name; what should i call you; what can i call you; what do i call you;
    what name do you go by; what name dost thou go by; by what name; who are you; who're you; who art thou; who are thee; who might you be; who do i speak with; who am i speaking to; who stands before me; who is this;
    who be you; who be thee; identify yourself; introduce yourself; how are you called; what are you called; what do folk call you; and your name; so and you are here; see you are here; what are you"""
TRADES = """what is your trade; what's your trade; what is thy trade; what is your craft; what's your craft; what is thy craft; what is your profession; what's your profession; what is your occupation;
    what's your occupation; what is your job; what work do you do; what kind of work; what sort of work; what line of work; what is your line of work; what line of work are you in; what's your line of work;
    what do you do for a living; what do you do; what do you do around here; what work; what is it you do"""
WHERE = "where; which way; which road; route; gate; road; ferry; ship; moongate"
PLACES = "road; gate; ferry; ship; moongate; market; bank; shrine; bridge; dock; mill; room; shelf; pantry; cabinet; workbench"
WHEN, TIMES = "when; what time; what hour", "dawn; sunrise; noon; dusk; sunset; midnight; morning; evening; nightfall; bell; tomorrow"
PRICE = "how much; price; cost; copper; afford; pay"
STOPS = "what where when which who is are the a an do does can i me my to of how much tell please thou thy"
TRADED = "alchemist archer baker baron blacksmith brewer carpenter cook cooper farmer ferrymaster fisher fisherman guard healer innkeeper knight mage mason merchant miner noble sailor scribe shepherd shopkeeper stablemaster tamer tailor weaver wizard"
TOWNS = "Britain; Cove; Jhelom; Minoc; Moonglow; Serpent Isle; Skara Brae; Trinsic; Vesper; Yew"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
SAFE = "a an the well fine sorry glad happy from in at here there"
# End of the fixed values.


def items(block):
    return [" ".join(x.split()) for x in block.split(";")]


def asked(spark, rows, column):
    """The column's values over rows of a question and a state."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, state string")
    df = df.withColumn("q", text.norm(F.col("question"))).withColumn("s", text.norm(F.col("state")))
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_answers_of_each_rule(spark):
    q, s = F.col("q"), F.col("s")
    for table, column, row in (
        (SOCIAL, answers.social_answer(q), lambda k: (k, "")), (PRACTICAL, answers.practical_state(s), lambda k: ("", k)), (WORLD, answers.world_answer(s), lambda k: ("", k)),
        (UNCERTAINTY, answers.uncertainty_answer(s), lambda k: ("", k)), (CAKE, answers.capability_answer(q, s), lambda k: k),
        (ASKING, answers.practical_answer(answers.practical_state(s), q, s, F.lit("the fact")), lambda k: k),
    ):
        assert dict(zip(table, asked(spark, map(row, table), column))) == table
    antidote = answers.practical_answer(F.lit(None).cast("string"), q, s, F.lit("the fact"))
    assert asked(spark, [("Where is it?", "The antidote."), ("The antidote?", "An antidote."), ("Help!", "An antidote."), ("Where?", "A potion.")], antidote) == ["the fact", "the fact", None, None]


@pytest.mark.parametrize("name, gate", [("home", "model_first"), ("wares", "model_first"), ("fact", "fact_trigger"), ("numbers", "numeric_gate")])
def test_gates_open_for_each_phrase(spark, name, gate):
    column = getattr(answers, gate)(F.col("q"))
    shut = {"home": "neither", "wares": "neither", "fact": "no fact", "numbers": "no numbers"}[name]
    phrases = items(GATES[name])
    assert [p for p, v in zip(phrases, asked(spark, [(f"Pray, {p}?", "") for p in phrases], column)) if not v] == []
    assert not any(asked(spark, [(p, "") for p in items(GATES[shut])], column))


def test_identity_for_each_phrase(spark):
    state = "Your name is Mira. You are an elf from Yew."
    table = spark.createDataFrame([(1, state)], "npc_id long, state string")

    def said(questions):
        turns = spark.createDataFrame([(i, 1, x) for i, x in enumerate(questions)], "turn_id long, npc_id long, player string")
        df = answers.turns_with_states(turns, table).select("turn_id", answers.identity_answer(F.col("q"), "who", "say", F.lit(0)).alias("v"))
        return [r.v for r in df.orderBy("turn_id").collect()]

    names, trades = items(NAMES), items(TRADES)
    assert [x for x, v in zip(names, said(names)) if v != "I am Mira, an elf from Yew."] == []
    assert [x for x, v in zip(trades, said([f"Well, {x}?" for x in trades])) if v != "I work as an elf in Yew."] == []
    assert said(["Are you an elf?", "Art thou a cook?", "be you the elf", "You are an elf, right?", "the weather"]) == ["Aye. I am an elf.", "Nay. I am an elf.", "Aye. I am an elf.", "Aye. I am an elf.", None]


def best(spark, rows):
    column = facts.relevant_fact(F.array(F.lit("first"), F.lit("second")), F.array(F.lit("zzz"), F.col("s")), F.col("q"))
    return asked(spark, rows, column)


def test_what_makes_a_fact_relevant(spark):
    pairs = [(w, p) for block, terms in ((WHERE, PLACES), (WHEN, TIMES)) for w in items(block) for p in items(terms)]
    pairs += [(p, "coppers") for p in items(PRICE)]
    assert set(best(spark, [(f"{a} xx", f"{b} yy") for a, b in pairs])) == {"second"}
    assert set(best(spark, [("xx", f"{b} yy") for _, b in pairs])) == {"first"}
    assert set(best(spark, [(w, f"{w} yy") for w in STOPS.split() if w not in ("where", "when", "how", "much")])) == {"first"}
    assert set(best(spark, [(w, f"{w} yy") for w in ("bread", "copper", "your", "you", "it", "this")])) == {"second"}


def test_claims_for_each_word(spark):
    state = "Your name is Mira. You are a nomad from Luna."
    rows = [(i, state, x) for i, x in enumerate(
        [f"I work as a {t} here." for t in TRADED.split()] + [f"I came from {t.lower()}." for t in items(TOWNS)] + [f"I am {w} friend." for w in SAFE.split()] + [f"I am {w}." for w in ("no one", "nobody", "nothing", "anyone", "Bob")] + ["I am Mira.", "I work as a nomad."]
    )]
    df = spark.createDataFrame(rows, "i int, state string, raw_text string").withColumn("persona", persona.persona(F.col("state")))
    got = [r for r in persona.with_claims(df).select("i", "wrong_name", "wrong_profession", "wrong_home").orderBy("i").collect()]
    at = 0
    for n, flag in ((31, "wrong_profession"), (10, "wrong_home"), (13, None), (5, "wrong_name"), (2, None)):
        for r in got[at : at + n]:
            assert [f for f in ("wrong_name", "wrong_profession", "wrong_home") if r[f]] == ([flag] if flag else []), rows[r.i]
        at += n
    assert at == len(rows)


def test_numbers_by_word(spark):
    values = asked(spark, [(w, "") for w in NUMBERS.split()] + [("twenty five", ""), ("a dozen", ""), ("17 or 3", "")], text.number_value(F.col("q")))
    assert values == [*range(21), 5, None, 17]
