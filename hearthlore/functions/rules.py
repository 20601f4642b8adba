"""Rule tables: fixed words, phrases and answers, and rules over them.

A condition is a list of alternatives; an alternative is a tuple of tests that must all
hold. A test is ``side:phrase`` (the normalized text of that side contains the phrase),
``side=phrase`` (equals) or ``side~regex`` (matches); the sides are ``q``, the question,
and ``s``, the state.
"""

# Words, phrases and answers that results depend on, in their given order.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
STOP_WORDS = "what where when which who is are the a an do does can i me my to of how much tell please thou thy".split()
WHERE_PHRASES = ["where", "which way", "which road", "route", "gate", "road", "ferry", "ship", "moongate"]
PLACE_TERMS = "road gate ferry ship moongate market bank shrine bridge dock mill room shelf pantry cabinet workbench".split()
WHEN_PHRASES = ["when", "what time", "what hour"]
TIME_TERMS = "dawn sunrise noon dusk sunset midnight morning evening nightfall bell tomorrow".split()
PRICE_PHRASES = ["how much", "price", "cost", "copper", "afford", "pay"]
NUMERIC_GATE = ["how much", "price", "cost", "copper", "afford", "pay", "cheaper", "worth"]
FACT_TRIGGERS = [
    "who", "whose", "where", "which", "when", "route", "road", "what does", "what should", "what is", "what lies", "what room", "what must", "who gathers",
]
HOME_PHRASES = [
    "where are you from", "where do you live", "where is your home", "where do you call home", "what town do you call home", "what is your hometown",
    "which town is home", "where do you hail from", "where dost thou dwell", "where is thy home", "what place is home", "what place do you call home",
    "where's home", "where is home", "where are you based", "where do you reside", "what city are you from", "what village are you from", "what land are you from",
]
HOME_ASKS, HOME_WORDS = ["where", "which", "what"], ["home", "live", "based", "reside", "dwell", "hail"]
WARES_PHRASES = [
    "what do you sell", "what are you selling", "what wares", "what goods", "what do you have for sale", "what is for sale", "what are your wares",
    "what do you carry", "what is in stock", "what can i buy", "what can i purchase", "show me your wares", "what have you got",
]
WARES_WORDS = "sell selling wares goods sale stock buy purchase carry offer available".split()
NAME_PHRASES = [
    "what is your name", "what's your name", "what is thy name", "what's thy name", "tell me your name", "tell me thy name", "may i know your name",
    "what should i call you", "what can i call you", "what do i call you", "what name do you go by", "what name dost thou go by", "by what name",
    "who are you", "who're you", "who art thou", "who are thee", "who might you be", "who do i speak with", "who am i speaking to", "who stands before me",
    "who is this", "who be you", "who be thee", "identify yourself", "introduce yourself", "how are you called", "what are you called",
    "what do folk call you", "and you are", "and your name", "you are",
]
NAME_FOLLOW_UPS = ["what are you", "you are", "and you are", "and your name"]
TRADE_PHRASES = [
    "what is your trade", "what's your trade", "what is thy trade", "what is your craft", "what's your craft", "what is thy craft", "what is your profession",
    "what's your profession", "what is your occupation", "what's your occupation", "what is your job", "what work do you do", "what kind of work",
    "what sort of work", "what line of work", "what is your line of work", "what line of work are you in", "what's your line of work",
    "what do you do for a living", "what do you do", "what do you do around here", "what work", "what is it you do",
]
TRADE_WARES = ["sell", "wares", "goods", "for sale"]
OCCUPATIONS = (
    "alchemist archer baker baron blacksmith brewer carpenter cook cooper farmer ferrymaster fisher fisherman guard healer innkeeper knight mage mason merchant "
    "miner noble sailor scribe shepherd shopkeeper stablemaster tamer tailor weaver wizard"
).split()
KNOWN_PLACES = ["britain", "cove", "jhelom", "minoc", "moonglow", "serpent isle", "skara brae", "trinsic", "vesper", "yew"]
NOBODY = ["no", "nobody", "nothing", "anyone"]
SAFE_FIRST_WORDS = "a an the well fine sorry glad happy from in at here there".split()
# A release's own file name goes before these; it is a parameter of the selection.
PREFERRED_MODELS = ["model/v9_base_finetune.pt", "model/v9_grounded.pt", "model/best_balanced.pt", "model/best_phase3.pt", "model/final.pt"]
TOKENIZER_PATH = "tokenizer/tokenizer.json"

SOCIAL = [
    ([("q~^(hello|hi|hey|hail|greetings)\\b",)], "Hail, friend. What brings thee here?"),
    ([("q:have a good day",), ("q=good day",), ("q=good morrow",)], "Aye, and to thee as well. Safe roads."),
    ([("q:thank",)], "You are welcome, friend."),
    ([("q:fare thee well",), ("q:farewell",), ("q:goodbye",)], "Farewell, and safe roads, friend."),
    ([("q:rotten day",)], "I am sorry. I hope tomorrow is better."),
    ([("q:fine morning",)], "Aye, a fair morning indeed."),
    ([("q:rude",), ("q:sorry",)], "Forgiven, friend."),
    ([("q:did not understand",)], "I shall say it plain and simple."),
    ([("q:bank is packed",)], "Aye, the bank is busy today."),
    ([("q:moongate is busy",)], "Travelers gather at the busy moongate."),
    ([("q:road all day",)], "Rest and food should serve you well."),
    ([("q:cheap room",), ("q:cheap", "q:room")], "Aye, I have a cheap room tonight."),
]
PRACTICAL = [
    ([("s:wet leather",)], "Nay. Dry wet leather slowly away from strong heat."),
    ([("s:cut hay",), ("s:hay", "s:rain")], "Nay. Bring the hay under cover before the rain."),
    ([("s:dough",)], "Let the dough rest and rise."),
    ([("s:wall crack",)], "Clear the crack before repairing the wall."),
    ([("s:bargain", "s:witnessed")], "Write it, date it, and have it witnessed."),
    ([("s:frightened flock",), ("s:flock needs calm",)], "Calm the flock and give it space."),
    ([("s:clean bandage",)], "Cover the washed cut with a clean bandage."),
    ([("s:leaking cask",)], "Repair the leaking cask with a new hoop."),
    ([("s:monsters block",), ("s:roof is cracking",)], "Nay. Stop and leave the unsafe tunnel."),
    ([("s:small nick",)], "Aye. Repair and grind the blade smooth."),
    ([("s:shallow cut",), ("s:road grit",)], "Wash the shallow cut with clean water first."),
    ([("s:door drags",)], "Check the hinge first."),
    ([("s:stew is too thin",)], "Simmer it to reduce and thicken it."),
    ([("s:field is waterlogged",)], "Nay. Drain the wet field and wait before sowing."),
    ([("s:burnt loaf",)], "Nay. Water cannot save the burnt loaf."),
    ([("q:pack", "s:dungeon")], "Pack bread and water for the dungeon."),
]
ANTIDOTE = [("s:antidote", "q:where"), ("s:antidote", "q:antidote")]
CAKE = [("q:cake", "q:can you"), ("q:cake", "q:could you"), ("q:cake", "q:do you know how")]
CAKE_BAKER = [("s:baker",), ("s:bake",)]
CAKE_AYE = "Aye. I can bake a simple cake, if thou hast the coin and ingredients."
CAKE_NAY = "I know not whether I can bake cakes; that is not my stated trade."
WORLD = [
    ([("s:matching blue cloaks",)], "Aye. Matching blue cloaks are good guild work for a weaver."),
    ([("s:bard is playing outside the bank",)], "Aye. The busy bank gives the bard an audience for tips."),
    ([("s:has hung its colors",)], "The guild's colors show its presence above those houses."),
    ([("s:needs casks for water and provisions",)], "The casks should hold water and provisions."),
    ([("s:quiet room to study",)], "A quiet room away from the common room suits the mage."),
    ([("s:traveler needs food and rest",)], "The traveler needs food and rest."),
    ([("s:adventurers crowd the bank",)], "Adventurers crowd the bank after a dungeon run."),
    ([("s:travelers gather at the moongate",)], "Travelers gather at the moongate at sunrise."),
    ([("s:monster blocks the ore tunnel",)], "The monster must be cleared from the ore tunnel."),
    ([("s:beast has frightened the flock",)], "The frightened flock needs calming."),
]
UNCERTAINTY = [
    ([("s:no information",), ("s:do not know",)], "I know not; I cannot say."),
    ([("s:never met",)], "I know her not; we have never met."),
    ([("s:never visited",), ("s:never travelled",)], "I know not that road well enough to advise thee."),
]
TWO_PIES, ONE_PIE, ONE_PIE_ANSWER = "two pies cost eight", "one pie", "One pie is worth four coppers."
MORE, BREAD_FIVE, CHEESE_TWELVE, MORE_ANSWER = "how much more", "bread costs five", "cheese costs twelve", "Cheese is seven coppers more than bread."
UNKNOWN = "I know not."
# Variants; the names in braces are columns (art: the article, from_home and in_home: with their word, or empty).
AYE_TRADE = ["Aye. I am {art} {trade}.", "Aye, {trade} is my trade.", "Indeed. I work as {art} {trade}."]
NAY_TRADE = ["Nay. I am {art} {trade}.", "Nay, my trade is {art} {trade}.", "That is not my trade; I am {art} {trade}."]
BREWER_WARES = ["I sell ale and brewed drinks.", "Ale and other brewed drinks are my wares."]
BAKER_WARES = ["I sell bread and pies.", "Fresh bread and sweet pies are my wares.", "Bread and pies, fresh from my oven."]
TRADE_ANSWERS = [
    "I work as {art} {trade}{in_home}.", "My trade is that of {art} {trade}; I am {name}{from_home}.",
    "I earn my keep as {art} {trade}{from_home}.", "{Trade} is my craft; I am {name}.",
]
NAME_ANSWERS = [
    "I am {name}, {art} {trade}{from_home}.", "{name} is my name; I work as {art} {trade}{from_home}.", "Call me {name}. I am {art} {trade}{from_home}.",
    "My name is {name}; I earn my keep as {art} {trade}{from_home}.", "You speak with {name}, {art} {trade}{from_home}.",
]
# End of the fixed values.
