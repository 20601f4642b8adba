"""DuckDB SQL for the queries, written over the same fixtures and fixed values."""

from __future__ import annotations

from ..functions import rules
from ..functions.text import FOLDS
from ..sources import fixtures as fx
from .queries import PIECE, SEED

WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def clean(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}', ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}|{WS}$', '', 'g')"


def norm(e: str) -> str:
    for a, b in FOLDS.items():
        e = f"replace({e}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9'']+', ' ', 'g'))"


def sentences(e: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({e}, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1)), lambda x: {clean('x')}), lambda x: x <> '')"


def any_in(e: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(p)})" for p in phrases) + ")"


def number(n: str) -> str:
    words = ", ".join(f"CASE WHEN regexp_matches({n}, '\\b{w}\\b') THEN {v} END" for v, w in enumerate(rules.NUMBER_WORDS))
    digits = f"regexp_extract({n}, '\\b(\\d+)\\b', 1)"
    return f"CASE WHEN {digits} <> '' THEN TRY_CAST({digits} AS BIGINT) ELSE CAST(coalesce({words}) AS BIGINT) END"


def article(e: str) -> str:
    return f"CASE WHEN lower(substr({e}, 1, 1)) IN ('a', 'e', 'i', 'o', 'u', '') THEN 'an' ELSE 'a' END"


def role(e: str) -> str:
    return f"CASE WHEN regexp_matches(lower({e}), '^(a|an|the) ') THEN {e} WHEN lower(substr({e}, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' || {e} ELSE 'a ' || {e} END"


def cap(e: str) -> str:
    return f"(upper(substr({e}, 1, 1)) || lower(substr({e}, 2)))"


def singular(e: str) -> str:
    return f"CASE WHEN ends_with({e}, 'ies') THEN left({e}, length({e}) - 3) || 'y' WHEN ends_with({e}, 's') THEN left({e}, length({e}) - 1) ELSE {e} END"


def lead(e: str) -> str:
    return f"regexp_replace({e}, '^(you know |the state says )', '', 'i')"


def test(t: str) -> str:
    side, how, what = t[0], t[1], lit(t[2:])
    return f"contains({side}, {what})" if how == ":" else f"{side} = {what}" if how == "=" else f"regexp_matches({side}, {what})"


def holds(cond) -> str:
    return "(" + " OR ".join("(" + " AND ".join(map(test, alt)) + ")" for alt in cond) + ")"


def first_rule(table) -> str:
    return "CASE " + " ".join(f"WHEN {holds(c)} THEN {lit(a)}" for c, a in table) + " END"


def persona(e: str) -> str:
    def by(verb: str, near: str) -> str:
        p = lit(rf"(?i)Your name is ([^.]+)\.\s*You {verb} (?:a |an )?(.+?)(?:\s+(?:{near})\s+([^.;]+))?\.")
        g = [f"nullif({clean(f'regexp_extract({e}, {p}, {i})')}, '')" for i in (1, 2, 3)]
        return f"CASE WHEN regexp_matches({e}, {p}) THEN {{'name': {g[0]}, 'profession': {g[1]}, 'home': {g[2]}}} END"

    return f"coalesce({by('are', 'from|in|near')}, {by('keep', 'in')})"


def persona_open(e: str) -> str:
    p = lit(r"(?i)Your name is ([^.]+)\. You are (?:a |an )?([^.]+)")
    r = f"trim(regexp_extract({e}, {p}, 2))"
    at = lit(r"(?i)^(.*?)\s+(?:from|in|near)\s+(.*)$")
    first = f"CASE WHEN regexp_matches({r}, {at}) THEN regexp_extract({r}, {at}, 1) ELSE {r} END"
    return f"CASE WHEN regexp_matches({e}, {p}) THEN {{'name': nullif({clean(f'regexp_extract({e}, {p}, 1)')}, ''), 'profession': {clean(first)}, 'home': nullif({clean(f'regexp_extract({r}, {at}, 2)')}, '')}} END"


STATE_CTE = f"""
profile AS ({fx.PROFILE}),
states AS (SELECT npc_id, array_to_string(list_filter([
   CASE WHEN {strip('name')} <> '' THEN 'Your name is ' || {strip('name')} || '.' END,
   CASE WHEN {strip('role')} <> '' AND {strip('home')} <> '' THEN 'You are ' || {role(strip('role'))} || ' from ' || {strip('home')} || '.'
        WHEN {strip('role')} <> '' THEN 'You are ' || {role(strip('role'))} || '.' WHEN {strip('home')} <> '' THEN 'You are from ' || {strip('home')} || '.' END,
   CASE WHEN {clean('facts')} <> '' THEN CASE WHEN regexp_matches({clean('facts')}, '[.!?]$') THEN {clean('facts')} ELSE {clean('facts')} || '.' END END], lambda x: x IS NOT NULL), ' ') AS state FROM profile)
"""

PRICE = "([a-z][a-z ]*?) {} (\\w+) coppers"


def _pairs() -> str:
    costs, has = lit(PRICE.format("costs?")), lit(PRICE.format("is"))
    w = f"split_part(trim(z[1]), ' ', 1)"
    pos = f"list_position({lst(rules.NUMBER_WORDS)}, {w})"
    cost = f"{{'label': CASE WHEN {pos} IS NOT NULL AND {pos} > 0 THEN trim(substr(trim(z[1]), length({w}) + 1)) ELSE trim(z[1]) END, 'value': {number('z[2]')}, 'quantity': CASE WHEN {pos} > 0 THEN CAST({pos} - 1 AS BIGINT) END}}"
    plain = f"{{'label': trim(z[1]), 'value': {number('z[2]')}, 'quantity': CAST(NULL AS BIGINT)}}"
    zipped = lambda p: f"list_zip(regexp_extract_all(nf, {p}, 1), regexp_extract_all(nf, {p}, 2))"
    return f"list_concat(list_transform({zipped(costs)}, lambda z: {cost}), list_transform({zipped(has)}, lambda z: {plain}))"


FEATURES = f"""
{STATE_CTE},
f0 AS (SELECT *, {norm('state')} AS s, {sentences('state')} AS parts, {persona('state')} AS persona FROM states),
f1 AS (SELECT *, list_filter(parts[2:], lambda x: NOT starts_with({norm('x')}, 'you are ') AND NOT starts_with({norm('x')}, 'you keep ')) AS facts, coalesce(persona, {persona_open('state')}) AS who FROM f0),
f2 AS (SELECT *, list_transform(facts, lambda x: {norm('x')}) AS fact_norms, {norm("array_to_string(facts, ' ')")} AS nf FROM f1),
features AS (SELECT *, {_pairs()} AS pairs, {first_rule(rules.WORLD)} AS world, {first_rule(rules.UNCERTAINTY)} AS uncertain FROM f2)
"""


def _fact() -> str:
    score = (
        f"len(list_intersect(list_filter(list_distinct(string_split(q, ' ')), lambda w: w <> '' AND NOT list_contains({lst(rules.STOP_WORDS)}, w)), string_split(f, ' ')))"
        f" + CASE WHEN {any_in('q', rules.WHERE_PHRASES)} AND {any_in('f', rules.PLACE_TERMS)} THEN 3 ELSE 0 END"
        f" + CASE WHEN {any_in('q', rules.WHEN_PHRASES)} AND {any_in('f', rules.TIME_TERMS)} THEN 3 ELSE 0 END"
        f" + CASE WHEN {any_in('q', rules.PRICE_PHRASES)} AND contains(f, 'copper') THEN 4 ELSE 0 END"
    )
    best = f"list_max(list_transform(fact_norms, lambda f, i: {{'score': {score}, 'at': -i}}))"
    return f"CASE WHEN len(facts) > 0 THEN CASE WHEN {best}.score > 0 THEN facts[-({best}.at)] ELSE facts[1] END END"


def pick(seed) -> str:
    return "CAST(0 AS BIGINT)" if seed is None else f"CAST('0x' || substr(md5('{seed}' || CAST(turn_id AS VARCHAR)), 1, 8) AS BIGINT)"


def turns(seed=None, fallback: bool = True) -> str:
    said = "coalesce(raw_text, '')" if fallback else lit(rules.UNKNOWN)
    return f"""
{FEATURES},
turn AS ({fx.TURN}),
j0 AS (SELECT t.*, features.* EXCLUDE (npc_id), {norm('t.player')} AS q FROM turn t LEFT JOIN features ON t.npc_id = features.npc_id),
j AS (SELECT *, {_fact()} AS fact, {pick(seed)} AS pick, {clean(said)} AS raw FROM j0)
"""


def coppers(label: str, verb: str, value: str) -> str:
    return f"({label} || '{verb}' || CAST({value} AS VARCHAR) || ' coppers.')"


FIRST = "list_filter(pairs, lambda p: p.value IS NOT NULL)[1]"
MANY = "list_filter(pairs, lambda p: p.quantity > 1 AND p.value IS NOT NULL)[1]"
HAVE = number("nullif(regexp_extract(nf, 'have (\\w+)', 1), '')")
CHEAP = "list_min(list_transform(list_filter(pairs, lambda p: p.value IS NOT NULL), lambda p, i: {'value': p.value, 'i': i, 'label': p.label}))"
D7 = f"CASE WHEN contains(q, 'which is cheaper') THEN {coppers(cap(CHEAP + '.label'), ' is cheaper; it costs ', CHEAP + '.value')} END"
D8 = (
    f"CASE WHEN (contains(q, 'afford') OR contains(q, 'pay')) AND {FIRST}.value IS NOT NULL AND ({HAVE}) IS NOT NULL THEN CASE WHEN ({HAVE}) >= {FIRST}.value "
    f"THEN 'Aye. ' || CAST(({HAVE}) AS VARCHAR) || ' coppers is enough for the ' || CAST({FIRST}.value AS VARCHAR) || '-copper price.' "
    f"ELSE 'Nay. ' || CAST(({HAVE}) AS VARCHAR) || ' coppers is not enough for the ' || CAST({FIRST}.value AS VARCHAR) || '-copper price.' END END"
)
D9 = f"CASE WHEN contains(q, 'one') OR contains(q, 'single') THEN 'One ' || {coppers(singular(MANY + '.label'), ' costs ', f'{MANY}.value // {MANY}.quantity')} END"
D10 = coppers(cap(FIRST + ".label"), " costs ", FIRST + ".value")
D1, D2 = first_rule(rules.SOCIAL), f"coalesce({first_rule(rules.PRACTICAL)}, CASE WHEN {holds(rules.ANTIDOTE)} THEN fact END)"
D3 = f"CASE WHEN {holds(rules.CAKE)} THEN CASE WHEN {holds(rules.CAKE_BAKER)} THEN {lit(rules.CAKE_AYE)} ELSE {lit(rules.CAKE_NAY)} END END"
D11 = (
    f"CASE WHEN {any_in('q', rules.NUMERIC_GATE)} THEN coalesce(CASE WHEN contains(nf, {lit(rules.TWO_PIES)}) AND contains(q, {lit(rules.ONE_PIE)}) THEN {lit(rules.ONE_PIE_ANSWER)} END, "
    f"CASE WHEN contains(q, {lit(rules.MORE)}) AND contains(nf, {lit(rules.BREAD_FIVE)}) AND contains(nf, {lit(rules.CHEESE_TWELVE)}) THEN {lit(rules.MORE_ANSWER)} END, {D7}, {D8}, {D9}, {D10}, fact) END"
)
MODEL_FIRST = f"({any_in('q', rules.HOME_PHRASES)} OR ({any_in('q', rules.HOME_ASKS)} AND {any_in('q', rules.HOME_WORDS)}) OR {any_in('q', rules.WARES_PHRASES)} OR {any_in('q', rules.WARES_WORDS)})"


def variant(templates) -> str:
    fill = {
        "{name}": "who.name", "{trade}": "who.profession", "{Trade}": cap("who.profession"), "{art}": article("who.profession"),
        "{from_home}": "coalesce(' from ' || who.home, '')", "{in_home}": "coalesce(' in ' || who.home, '')",
    }

    def phrase(t: str) -> str:
        e = lit(t)
        for k, v in fill.items():
            e = f"replace({e}, '{k}', {v})" if k in t else e
        return e

    return "CASE " + " ".join(f"WHEN pick % {len(templates)} = {i} THEN {phrase(t)}" for i, t in enumerate(templates)) + " END"


_ASK = [
    lit(r"^(?:and\s+)?(?:are you|art thou|be you)\s+(?:a|an|the)?\s*(.+?)\s*[?!.]?$"),
    lit(r"^(?:and\s+)?(?:you are|you're|you)\s+(?:a|an|the)?\s*(.+?)(?:\s+right)?\s*[?!.]?$"),
]
ASKED = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(q, {p}, 1)), '')" for p in _ASK) + ")"
TRADE = norm("who.profession")
D12 = f"CASE WHEN {ASKED} NOT IN ('you', 'there') THEN CASE WHEN contains({TRADE}, {ASKED}) OR contains({ASKED}, {TRADE}) THEN {variant(rules.AYE_TRADE)} ELSE {variant(rules.NAY_TRADE)} END END"
D13 = (
    f"CASE WHEN {any_in('q', rules.TRADE_PHRASES)} THEN CASE WHEN {any_in('q', rules.TRADE_WARES)} AND contains({TRADE}, 'brewer') THEN {variant(rules.BREWER_WARES)} "
    f"WHEN {any_in('q', rules.TRADE_WARES)} AND contains({TRADE}, 'baker') THEN {variant(rules.BAKER_WARES)} ELSE {variant(rules.TRADE_ANSWERS)} END END"
)
D14 = f"CASE WHEN list_contains({lst(rules.NAME_FOLLOW_UPS)}, q) OR {any_in('q', rules.NAME_PHRASES)} THEN {variant(rules.NAME_ANSWERS)} END"
D15 = f"CASE WHEN who IS NOT NULL THEN coalesce({D12}, {D13}, {D14}) END"

OCC = lst(rules.OCCUPATIONS)


def has_trade(e: str) -> str:
    return f"list_has_any(string_split({e}, ' '), {OCC})"


def claims() -> str:
    named = lit(r"(?i)\b(?:my name is|call me|i am called|i'm called)\s+([^,.!?;]+)")
    said = lit(r"\bI(?: am|'m)\s+([^,.!?;]+)")
    work = lit(r"(?i)\b(?:i(?: am|'m)|my trade is|i work as|i serve as)\s+(?:a |an |the )?([^,.!?;]+)")
    home = lit(r"(?i)\b(?:from|live in|dwell in|hail from|come from|home is|i am in|i'm in)\s+([A-Za-z][A-Za-z' -]*)")
    title = r"'(?i)\b' || regexp_escape(persona.name) || '\s+the\s+([a-z][a-z -]+)'"
    g = lambda p: f"regexp_extract(raw, {p}, 1)"
    places = " OR ".join(f"contains({norm('x')}, {lit(p)})" for p in rules.KNOWN_PLACES)
    return f"""
k0 AS (SELECT *, {norm(g(named))} AS k_name, {norm(g(said))} AS k_said, {norm(g(work))} AS k_work, {norm(g(title))} AS k_title, {g(named)} <> '' AS has_name, {g(said)} <> '' AS has_said,
  {norm('persona.name')} AS own, {norm('persona.profession')} AS trade, {norm("coalesce(persona.home, '')")} AS place FROM j),
k1 AS (SELECT *, persona IS NOT NULL AND coalesce(has_name AND split_part(k_name, ' ', 1) <> own, FALSE) AS claim_name,
  persona IS NOT NULL AND coalesce(has_said AND (list_contains({lst(rules.NOBODY)}, split_part(k_said, ' ', 1)) OR (NOT list_contains({lst(rules.SAFE_FIRST_WORDS)}, split_part(k_said, ' ', 1)) AND split_part(k_said, ' ', 1) <> own AND NOT {has_trade('k_said')})), FALSE) AS claim_self,
  persona IS NOT NULL AND coalesce({has_trade('k_work')} AND NOT contains(k_work, trade), FALSE) AS claim_trade,
  CASE WHEN persona IS NOT NULL AND {has_trade('k_title')} THEN NOT contains(k_title, trade) END AS claim_title,
  persona IS NOT NULL AND coalesce(place <> '' AND len(list_filter(regexp_extract_all(raw, {home}, 1), lambda x: ({places} OR regexp_matches(x, '[A-Z]')) AND NOT contains({norm('x')}, place))) > 0, FALSE) AS wrong_home FROM k0),
k2 AS (SELECT *, claim_name OR claim_self AS wrong_name, coalesce(claim_title, claim_trade) AS wrong_profession FROM k1),
k AS (SELECT *, CASE WHEN wrong_name OR wrong_profession OR wrong_home THEN 'I am ' || persona.name || ', ' || {article('persona.profession')} || ' ' || persona.profession || coalesce(' from ' || persona.home, '') || '.' ELSE raw END AS repaired FROM k2)
"""


def grounded(seed=None, fallback: bool = True) -> str:
    steps = {
        "social": D1, "practical": D2, "capability": D3, "world": "world", "uncertainty": "uncertain", "numeric": D11, "identity": D15,
        "fact": f"CASE WHEN {any_in('q', rules.FACT_TRIGGERS)} THEN {lead('fact')} END",
    }
    cols = ", ".join(f"nullif({e}, '') AS a_{n}" for n, e in steps.items())
    first = "WHEN model_first THEN 'model_first'" if fallback else ""
    return f"""
{turns(seed, fallback)}, {claims()},
a0 AS (SELECT *, {cols}, {MODEL_FIRST} AS model_first FROM k),
a1 AS (SELECT *, CASE {first} {' '.join(f"WHEN a_{n} IS NOT NULL THEN '{n}'" for n in steps)} ELSE 'fallback' END AS rule FROM a0),
a AS (SELECT *, CASE rule {' '.join(f"WHEN '{n}' THEN a_{n}" for n in steps)} ELSE repaired END AS text FROM a1)
"""


CASES = """cases AS (SELECT npc_id AS name, [lower(name), lower(role)] AS required_all, CASE WHEN home <> '' THEN [home, 'coppers'] ELSE [] END AS required_any, ['I am Mara', 'know not'] AS forbidden FROM profile)"""
_INSIDE = f"contains(t, {norm('x')})"
SCORED = f"""
{grounded()}, {CASES},
c0 AS (SELECT a.turn_id, {norm('a.text')} AS t, cases.* FROM a JOIN cases ON a.npc_id = cases.name),
c1 AS (SELECT *, len(required_any) > 0 AND len(list_filter(required_any, lambda x: {_INSIDE})) = 0 AS no_any, list_filter(required_all, lambda x: NOT {_INSIDE}) AS missing, list_filter(forbidden, lambda x: {_INSIDE}) AS hits FROM c0),
c AS (SELECT *, concat_ws('; ', CASE WHEN no_any THEN 'missing any of: ' || array_to_string(required_any, ', ') END, CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END, CASE WHEN len(hits) > 0 THEN 'forbidden: ' || array_to_string(hits, ', ') END) AS reasons FROM c1)
"""
GEN = f"generation AS ({fx.GENERATION})"
SOFT = "p0 AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY row_id)) / {t}) AS e FROM ({scores})), p1 AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM p0)"
NUCLEUS = (
    SOFT.format(t="1.0", scores=fx.SCORES)
    + ", p2 AS (SELECT *, round(sum(p) OVER w, 9) AS cum, CAST(row_number() OVER w AS INTEGER) AS rank FROM p1 WINDOW w AS (PARTITION BY row_id ORDER BY p DESC, item_id ROWS UNBOUNDED PRECEDING)), "
    "p3 AS (SELECT row_id, item_id, rank, p / sum(p) OVER (PARTITION BY row_id) AS p FROM p2 WHERE cum <= 0.9 OR rank = 1)"
)
WORDS = f"words AS (SELECT doc_id, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS w FROM documents)"
TOKENS = f"""{WORDS},
tt AS (SELECT doc_id AS turn_id, list_concat(['<STATE>'], w[1:len(w) // 3]) AS st, list_concat(['<PLAYER>'], w[len(w) // 3 + 1:2 * (len(w) // 3)]) AS pl,
  CASE WHEN doc_id % 60 BETWEEN 1 AND 50 THEN list_transform(w[2 * (len(w) // 3) + 1:], lambda x, i: CASE WHEN i = doc_id % 60 THEN '<EOS>' ELSE x END) ELSE w[2 * (len(w) // 3) + 1:] END AS completion FROM words),
pk AS (SELECT *, st[1:40] AS ks, 126 - len(st[1:40]) AS room FROM tt),
packed AS (SELECT *, list_concat(list_concat(['<BOS>'], ks), list_concat(pl[greatest(len(pl) - room, 0) + 1:], ['<SAY>'])) AS prompt, len(st) > 40 AS state_trimmed, len(pl) > room AS player_trimmed FROM pk),
cl AS (SELECT *, 128 - len(prompt) + 1 AS left_over, least(32, 128 - len(prompt) + 1) AS cap, coalesce(list_position(completion, '<EOS>'), 0) AS e FROM packed),
cut AS (SELECT *, CASE WHEN e > 0 AND e <= cap THEN 'EOS' WHEN len(completion) < cap THEN 'input_exhausted' WHEN left_over <= 32 THEN 'context_limit_after_token' ELSE 'max_new_tokens' END AS stop,
  completion[1:CASE WHEN e > 0 AND e <= cap THEN e - 1 ELSE least(len(completion), cap) END] AS clipped FROM cl)"""

KIND = "CASE WHEN {l} = '' THEN 'blank' WHEN lower({l}) IN ('/quit', '/exit', 'quit', 'exit') THEN 'quit' WHEN lower({l}) = '/state' THEN 'state_command' WHEN lower({l}) = '/show' THEN 'show' ELSE 'turn' END"
# A recursive walk over each session's lines, unlike the windows of the operator.
REPLAY = f"""
{STATE_CTE}, turn AS ({fx.TURN}),
log AS (SELECT t.session_id, t.turn_id, {strip("coalesce(t.player, '')")} AS line, CASE WHEN t.session_id % 3 <> 0 THEN states.state END AS start_state,
   row_number() OVER (PARTITION BY t.session_id ORDER BY t.ts, t.turn_id) AS n FROM turn t LEFT JOIN states ON t.npc_id = states.npc_id),
walk AS (
  SELECT session_id, turn_id, n, CASE WHEN start_state IS NULL THEN 'state' ELSE {KIND.format(l='line')} END AS kind, start_state AS state,
    CASE WHEN start_state IS NULL THEN line ELSE start_state END AS next_state, start_state IS NOT NULL AND lower(line) = '/state' AS expecting, start_state IS NOT NULL AND lower(line) IN ('/quit', '/exit', 'quit', 'exit') AS closed
  FROM log WHERE n = 1
  UNION ALL
  SELECT l.session_id, l.turn_id, l.n, CASE WHEN w.closed THEN 'ignored' WHEN w.expecting THEN 'state' ELSE {KIND.format(l='l.line')} END, w.next_state,
    CASE WHEN w.expecting AND NOT w.closed THEN l.line ELSE w.next_state END, NOT w.closed AND NOT w.expecting AND lower(l.line) = '/state', w.closed OR (NOT w.expecting AND lower(l.line) IN ('/quit', '/exit', 'quit', 'exit'))
  FROM walk w JOIN log l ON l.session_id = w.session_id AND l.n = w.n + 1
)
"""
MANIFEST = f"""
m0 AS (SELECT {strip('value')} AS v FROM ({fx.MANIFEST.format(sha="sha256(text)", sha_x="sha256(text || 'x')")})),
m AS (SELECT lower(nullif(regexp_extract(v, '^(\\S+)\\s+(.+)$', 1), '')) AS digest, nullif(regexp_extract(v, '^(\\S+)\\s+(.+)$', 2), '') AS rel, NOT regexp_matches(v, '^(\\S+)\\s+(.+)$') AS malformed FROM m0 WHERE v <> ''),
st AS (SELECT m.rel, CASE WHEN a.path IS NULL THEN 'MISSING' WHEN sha256(a.content) = m.digest THEN 'OK' ELSE 'FAIL' END AS status FROM m LEFT JOIN ({fx.ARTIFACT}) a ON m.rel = a.path WHERE NOT m.malformed)
"""


def per_turn(seed=None, **cols: str) -> str:
    return f"WITH {turns(seed)} SELECT turn_id, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM j"


def per_claim(*cols: str) -> str:
    return f"WITH {turns()}, {claims()} SELECT turn_id, {', '.join(cols)} FROM k"


def per_npc(**cols: str) -> str:
    return f"WITH {FEATURES} SELECT npc_id, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM features"


def simple_turn(**cols: str) -> str:
    return f"SELECT turn_id, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM (SELECT *, {norm('player')} AS q FROM ({fx.TURN}))"


def oracle_sql() -> dict[str, str]:
    """By query name, the equivalent SQL; streams are held against their batch form."""
    show = "coalesce(CAST({} AS VARCHAR), '-')"
    d16 = f"{D14}"
    rec = "WITH RECURSIVE "
    answers = lambda seed=None, fallback=True: f"WITH {grounded(seed, fallback)} SELECT turn_id, text, rule FROM a"
    respond = lambda t: f"WITH {grounded()}, {GEN} SELECT g.turn_id, g.tokens, g.stop, {t} AS text, coalesce(a.raw_text, '') AS raw_text, {t} <> coalesce(a.raw_text, '') AS grounded_applied FROM generation g JOIN a ON g.turn_id = a.turn_id"
    model_free = "CASE WHEN length(player) < 15 THEN 'I work as a cook, ' || split_part(player, ' ', 1) ELSE 'Aye, ' || split_part(player, ' ', 1) || '  it is.' END"
    hook = answers().replace(clean("coalesce(raw_text, '')"), clean(model_free))
    parts = lambda p: f"SELECT npc_id, {p}.name AS name, {p}.profession AS profession, {p}.home AS home"
    keep = "CASE WHEN npc_id % 5 = 0 THEN regexp_replace(state, 'You are an? ', 'You keep a ', 'g') ELSE state END"
    world_text = "CASE WHEN doc_id % 4 = 0 THEN 'The traveler needs food and rest. ' WHEN doc_id % 4 = 1 THEN 'A monster blocks the ore tunnel! ' ELSE '' END || text"
    found = {
        "a1_manifest_scan": f"WITH {MANIFEST} SELECT digest, rel, malformed FROM m",
        "a2_integrity_verify": f"WITH {MANIFEST} SELECT rel, status FROM st",
        "a2_integrity_summary": f"WITH {MANIFEST} SELECT *, n_fail + n_missing + n_malformed = 0 AS passed FROM (SELECT count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'MISSING') AS n_missing, (SELECT count(*) FROM m WHERE malformed) AS n_malformed FROM st)",
        "a3_bundle_discover": f"""WITH l AS ({fx.LISTING}),
          d AS (SELECT start, string_split(path, '/') AS p, unnest([0, 1, 2]) AS depth FROM l),
          r AS (SELECT start, depth, array_to_string(p[1:depth], '/') AS root, bool_or(p[depth + 1] = 'model' AND len(p) > depth + 1) AS m, bool_or(array_to_string(p[depth + 1:], '/') = 'tokenizer/tokenizer.json') AS t FROM d WHERE len(p) > depth GROUP BY ALL),
          n AS (SELECT start, depth, count(*) AS n, min(root) AS root FROM r WHERE m AND t GROUP BY ALL),
          s AS (SELECT l.start, any_value(n0.n) AS n0, any_value(n1.n) AS n1, any_value(n1.root) AS r1, any_value(n2.n) AS n2, any_value(n2.root) AS r2 FROM l LEFT JOIN n n0 ON n0.start = l.start AND n0.depth = 0 LEFT JOIN n n1 ON n1.start = l.start AND n1.depth = 1 LEFT JOIN n n2 ON n2.start = l.start AND n2.depth = 2 GROUP BY l.start)
          SELECT start, CASE WHEN n0 > 0 THEN '' WHEN n1 = 1 THEN r1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN r2 END AS root, CASE WHEN n0 > 0 THEN 'self' WHEN n1 = 1 THEN 'child' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'grandchild' ELSE 'not_found' END AS status FROM s""",
        "a4_checkpoint_select": f"""WITH f AS ({fx.MODEL_FILES}), b AS (SELECT bundle, list(path) AS files, max(override_path) AS o, max(declared_path) AS d FROM f GROUP BY bundle),
          c AS (SELECT *, list_filter({lst(rules.PREFERRED_MODELS)}, lambda x: list_contains(files, x)) AS p, list_distinct(list_filter(files, lambda x: regexp_matches(x, '^model/[^/]+\\.pt$'))) AS pts FROM b)
          SELECT bundle, CASE WHEN o IS NOT NULL THEN CASE WHEN list_contains(files, o) THEN o END WHEN list_contains(files, d) THEN d WHEN len(p) > 0 THEN p[1] WHEN len(pts) = 1 THEN pts[1] END AS path,
            CASE WHEN o IS NOT NULL THEN CASE WHEN list_contains(files, o) THEN 'override' ELSE 'override_missing' END WHEN list_contains(files, d) THEN 'declared' WHEN len(p) > 0 THEN 'preferred' WHEN len(pts) = 1 THEN 'only' ELSE 'ambiguous' END AS how FROM c""",
        "a4_declared_checkpoint": f"""WITH j AS ({fx.MANIFEST_JSON}), f AS (SELECT m.bundle, path, override_path, CASE WHEN json_valid(manifest) THEN nullif(json_extract_string(manifest, '$.production_checkpoint_archive_path'), '') END AS declared_path FROM ({fx.MODEL_FILES}) m LEFT JOIN j ON j.bundle = m.bundle), b AS (SELECT bundle, list(path) AS files, max(override_path) AS o, max(declared_path) AS d FROM f GROUP BY bundle),
          c AS (SELECT *, list_filter({lst(rules.PREFERRED_MODELS)}, lambda x: list_contains(files, x)) AS p, list_distinct(list_filter(files, lambda x: regexp_matches(x, '^model/[^/]+\\.pt$'))) AS pts FROM b)
          SELECT bundle, CASE WHEN o IS NOT NULL THEN CASE WHEN list_contains(files, o) THEN o END WHEN list_contains(files, d) THEN d WHEN len(p) > 0 THEN p[1] WHEN len(pts) = 1 THEN pts[1] END AS path,
            CASE WHEN o IS NOT NULL THEN CASE WHEN list_contains(files, o) THEN 'override' ELSE 'override_missing' END WHEN list_contains(files, d) THEN 'declared' WHEN len(p) > 0 THEN 'preferred' WHEN len(pts) = 1 THEN 'only' ELSE 'ambiguous' END AS how FROM c""",
        "a4_tokenizer_select": f"SELECT bundle, max(CASE WHEN path = 'tokenizer/tokenizer.json' THEN path END) AS path FROM ({fx.MODEL_FILES}) GROUP BY bundle",
        "b1_clean_text": f"SELECT doc_id, {clean('text')} AS v FROM documents",
        "b2_norm_text": f"SELECT doc_id, {norm('text')} AS v FROM documents",
        "b3_normalize_prompt_text": f"SELECT turn_id, {clean('raw_text')} AS v FROM ({fx.TURN})",
        "b4_state_sentences": f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n, array_to_string(p, '|') AS v FROM (SELECT doc_id, {sentences('text')} AS p FROM documents)",
        "b5_fact_sentences": per_npc(n="CAST(len(facts) AS INTEGER)", v="array_to_string(facts, '|')"),
        "b6_fact_table": f"WITH {FEATURES}, l AS (SELECT npc_id, unnest(list_zip(facts, fact_norms, range(len(facts)))) AS z FROM features) SELECT npc_id, CAST(z[3] AS INTEGER) AS idx, z[1] AS fact, z[2] AS norm, array_to_string(list_filter(string_split(z[2], ' '), lambda x: x <> ''), '|') AS words FROM l",
        "b7_number_value": f"SELECT doc_id, {number('n')} AS v FROM (SELECT doc_id, {norm('text')} AS n FROM documents)",
        "b8_article": f"SELECT npc_id, {article('role')} AS v, {article('home')} AS w FROM ({fx.PROFILE})",
        "b9_role_with_article": f"SELECT npc_id, {role('role')} AS v, 'The ' || role AS w FROM ({fx.PROFILE})",
        "b10_state_render": f"WITH {STATE_CTE} SELECT npc_id, state FROM states",
        "b11_capitalize": f"SELECT p_partkey, {cap('p_name')} AS v FROM part",
        "b12_singularize": f"SELECT p_partkey, {singular('n')} AS v FROM (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN 'ies' WHEN 1 THEN 's' ELSE '' END AS n FROM part)",
        "b13_lead_in_strip": f"WITH {FEATURES}, l AS (SELECT npc_id, unnest(list_zip(facts, range(len(facts)))) AS z FROM features) SELECT npc_id, CAST(z[2] AS INTEGER) AS idx, {lead('''(CASE WHEN npc_id % 2 = 0 THEN 'The State says ' ELSE '' END || z[1])''')} AS v FROM l",
        "b14_persona_extract": f"WITH {STATE_CTE}, x AS (SELECT npc_id, {persona(f'({keep})')} AS p FROM states) {parts('p')} FROM x",
        "b15_persona_fallback": rf"WITH {STATE_CTE}, x AS (SELECT npc_id, regexp_replace(state, '\. [^.]*costs .*$', '') AS state FROM states), y AS (SELECT npc_id, {persona_open('state')} AS p FROM x) {parts('p')} FROM y",
        "c1_model_first_route": simple_turn(v=MODEL_FIRST),
        "c2_fact_trigger": simple_turn(v=any_in("q", rules.FACT_TRIGGERS)),
        "c3_numeric_gate": simple_turn(v=any_in("q", rules.NUMERIC_GATE)),
        "c4_turn_filter": simple_turn(kind=KIND.format(l=strip("player"))),
        "d1_social_answer": per_turn(v=D1),
        "d2_practical_answer": per_turn(v=D2),
        "d3_capability_answer": per_turn(v=D3),
        "d4_world_answer": f"SELECT doc_id, {first_rule(rules.WORLD)} AS v FROM (SELECT doc_id, {norm('(' + world_text + ')')} AS s FROM documents)",
        "d5_uncertainty_answer": per_npc(v="uncertain"),
        "d6_price_pairs": per_npc(v=f"array_to_string(list_transform(pairs, lambda p: p.label || ':' || {show.format('p.value')} || ':' || {show.format('p.quantity')}), '|')"),
        "d7_cheapest_item": per_turn(v=D7),
        "d8_affordability": per_turn(v=D8),
        "d9_unit_price": per_turn(v=D9),
        "d10_first_price": per_turn(v=D10),
        "d11_numeric_answer": per_turn(v=D11),
        "d12_profession_check": per_turn(v=D12),
        "d13_trade_answer": per_turn(v=D13),
        "d14_name_answer": per_turn(v=D14),
        "d15_identity_answer": per_turn(v=D15),
        "d16_variant_choice": per_turn(SEED, v="pick % 5", w=d16),
        "e1_relevant_fact": per_turn(v="fact"),
        "e2_greedy_pick": f"SELECT row_id, item_id FROM ({fx.SCORES}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, item_id) = 1",
        "e3_temperature_softmax": f"WITH {SOFT.format(t='0.7', scores=fx.SCORES)} SELECT row_id, item_id, round(p, 6) AS p FROM p1",
        "e4_nucleus_filter": f"WITH {NUCLEUS} SELECT row_id, item_id, rank, round(p, 6) AS p FROM p3",
        "e5_categorical_draw": f"""WITH {NUCLEUS}, u AS (SELECT *, round(sum(p) OVER (PARTITION BY row_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 9) AS cum, CAST(CAST('0x' || substr(md5('{SEED}:' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM p3)
          SELECT row_id, coalesce(arg_min(item_id, CASE WHEN cum >= u THEN rank END), arg_max(item_id, rank)) AS item_id FROM u GROUP BY row_id""",
        "f1_claim_name": per_claim("claim_name"),
        "f2_claim_self": per_claim("claim_self"),
        "f3_claim_trade": per_claim("claim_trade"),
        "f4_claim_title": per_claim("claim_title"),
        "f5_claim_home": per_claim("wrong_home"),
        "f6_persona_consistency": f"WITH {turns()}, {claims()} SELECT turn_id, repaired AS v FROM k",
        "f7_persona_audit": per_claim("wrong_name", "wrong_profession", "wrong_home"),
        "g1_grounded_response": answers(),
        "g1_grounded_response_seeded": answers(SEED),
        "g2_respond": respond("a.text"),
        "g2_respond_raw_model": respond("coalesce(a.raw_text, '')"),
        "g2_respond_late_text": f"WITH {grounded()} SELECT turn_id, text, coalesce(raw_text, '') AS raw_text, rule, text <> coalesce(raw_text, '') AS grounded_applied FROM a",
        "g3_respond_no_fallback": answers(None, False),
        "g4_marker_check": f"WITH {STATE_CTE}, turn AS ({fx.TURN}) SELECT DISTINCT token FROM (SELECT unnest(string_split({norm('player')}, ' ')) AS token FROM turn) WHERE token <> '' AND token NOT IN (SELECT unnest(string_split({norm('p_name')}, ' ')) FROM part) AND token NOT IN (SELECT unnest(string_split({norm('state')}, ' ')) FROM states)",
        "h1_score_case": f"WITH {SCORED} SELECT turn_id, reasons = '' AS passed FROM c",
        "h2_score_reasons": f"WITH {SCORED} SELECT turn_id, reasons FROM c",
        "h3_suite_summary": f"WITH {SCORED}, {GEN} SELECT count(*) FILTER (reasons = '') AS passed, count(*) AS total, round(100.0 * count(*) FILTER (reasons = '') / count(*), 6) AS rate, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / sum(seconds), 6) AS tokens_per_second, CASE WHEN count(*) FILTER (reasons = '') = count(*) THEN 0 ELSE 2 END AS exit_code FROM c JOIN generation g ON g.turn_id = c.turn_id",
        "h4_throughput": f"WITH {GEN} SELECT turn_id, round(CASE WHEN seconds > 0 THEN tokens / seconds ELSE 0 END, 6) AS tokens_per_second, round(seconds * 1000, 6) AS latency_ms FROM generation",
        "h5_trim_warning": f"WITH {GEN} SELECT turn_id, state_trimmed, player_trimmed FROM generation WHERE state_trimmed OR player_trimmed",
        "i1_encode_content": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, '|')) AS v FROM (SELECT doc_id, regexp_extract_all(' ' || {clean('text')}, ' ?[^ ]+') AS t FROM documents)",
        "i1_plugged_tokenizer": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, '|')) AS v FROM (SELECT doc_id, regexp_extract_all(' ' || {clean('text')}, ' ?[^ ]+') AS t FROM documents)",
        "i2_prompt_pack": f"WITH {TOKENS} SELECT turn_id, CAST(len(prompt) AS INTEGER) AS n, array_to_string(prompt, ' ') AS v FROM packed",
        "i3_prompt_trim_flags": f"WITH {TOKENS} SELECT turn_id, state_trimmed, player_trimmed FROM packed",
        "i4_completion_clip": f"WITH {TOKENS} SELECT turn_id, CAST(len(clipped) AS INTEGER) AS tokens, array_to_string(clipped, ' ') AS clipped, stop FROM cut",
        "s1_session_replay": rec + REPLAY + " SELECT session_id, turn_id, kind, state FROM walk",
        "s4_session_state_stream": rec + REPLAY + " SELECT session_id, turn_id, kind, state FROM walk",
        "s2_transcript_render": f"WITH {grounded()} SELECT session_id, 'SYSTEM: NPC state locked: ' || arg_min(state, {{'ts': ts, 'turn_id': turn_id}}) || chr(10) || chr(10) || string_agg('YOU: ' || {strip('player')} || chr(10) || chr(10) || 'NPC: ' || text || chr(10) || chr(10), '' ORDER BY ts, turn_id) AS transcript FROM a WHERE state IS NOT NULL AND {KIND.format(l=strip('player'))} = 'turn' GROUP BY session_id",
        "s3_respond_stream": answers(),
        "j1_fallback_hook": hook,
    }
    found["d1_rule_table"] = per_turn(
        social=D1, practical=first_rule(rules.PRACTICAL), capability=D3, world="world", uncertainty="uncertain", antidote=f"coalesce({holds(rules.ANTIDOTE)}, false)",
        model_first=MODEL_FIRST, fact_trigger=any_in("q", rules.FACT_TRIGGERS), numeric_gate=any_in("q", rules.NUMERIC_GATE),
    )
    for same, plain in (("e1_fact_index", "e1_relevant_fact"), ("s1_replay_any", "s1_session_replay"), ("e3_softmax_any", "e3_temperature_softmax"), ("e4_nucleus_any", "e4_nucleus_filter"), ("e5_draw_any", "e5_categorical_draw")):
        found[same] = found[plain]
    found["s2_transcript_pieces"] = f"SELECT session_id, piece, substr(transcript, piece * {PIECE} + 1, {PIECE}) AS text FROM (SELECT session_id, transcript, unnest(range((length(transcript) + {PIECE} - 1) // {PIECE})) AS piece FROM ({found['s2_transcript_render']}))"
    return found
