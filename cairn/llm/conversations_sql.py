"""SQL of the repair of damaged conversations: one recursion over the rows, with the least label of each state.

A label is a string: cost in nine digits, the audit, a character 1, the repaired text; so the least string is the least cost, then the least audit.
"""

from __future__ import annotations

_AUDIT, _TEXT = "split_part({0}[11:], chr(1), 1)", "substr({0}, strpos({0}, chr(1)) + 1)"


def _with(label: str, cost: str, edit: str, turn: str | None = None) -> str:
    """The label after one more edit; ``turn`` is the role and text that it leaves."""
    text = _TEXT.format(label)
    more = f"{text} || CASE WHEN {text} = '' THEN '' ELSE chr(10) END || {turn}" if turn else text
    return f"(lpad(CAST(CAST({label}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '|' || {_AUDIT.format(label)} || '{edit}' || chr(1) || {more})"


def _least(*labels: str) -> str:
    return f"least({', '.join(labels)})"


def _inserted(source: str) -> str:
    """All states of ``source`` with empty turns inserted: at most two in a row help."""
    user = lambda x: _with(x, "2", "I", "'user:'")
    one = f"SELECT * EXCLUDE (u), {_least('u', user('e'), user('s'), user('a'))} u FROM ({source})"
    two = f"SELECT * EXCLUDE (a), {_least('a', _with('u', '2', 'I', chr(39) + 'assistant:' + chr(39)))} a FROM ({one})"
    return f"SELECT * EXCLUDE (u), {_least('u', user('a'))} u FROM ({two})"


def _row() -> str:
    """The states after the next row of each conversation."""
    kept, worse = "f.role || ':' || f.text", "CAST(f.truncated AS BIGINT)"
    keep = lambda x, initial: f"CASE WHEN NOT f.must AND f.initial = '{initial}' THEN {_with('l.' + x, worse, 'K', kept)} END"
    change = lambda x, role: f"CASE WHEN NOT f.must THEN {_with('l.' + x, f'2 + {worse}', 'R', f'{chr(39)}{role}:{chr(39)} || f.text')} END"
    gone = {x: _with(f"l.{x}", "3", "D") for x in "esua"}
    states = {"e": gone["e"], "s": _least(gone["s"], keep("e", "s")), "u": _least(gone["u"], *(keep(x, "u") for x in "esa"), *(change(x, "user") for x in "esa")), "a": _least(gone["a"], keep("u", "a"), change("u", "assistant"))}
    return "SELECT l.conv_id, l.g, l.i + 1 i, " + ", ".join(f"{v} {k}" for k, v in states.items()) + " FROM l JOIN f ON f.g = l.g AND f.i = l.i + 1"


REPAIR = f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) c FROM range(256) r(i))),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') w, coalesce(CAST(conv_id AS VARCHAR), '') g FROM conversations),
m AS (SELECT conv_id, g, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(w, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), CAST(4294967295 AS BIGINT)) % 20 d FROM k, crc),
r AS (SELECT conv_id, g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text, unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) cp FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, cp) i, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) z, left(role, 1) initial FROM r),
h AS (SELECT *, z = '' blank, z <> '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 again, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial pair FROM o),
f AS (SELECT *, blank OR again must, NOT blank AND NOT again AND z NOT IN ('.', '!', '?') truncated FROM h),
l AS ({_inserted("SELECT DISTINCT conv_id, g, CAST(0 AS BIGINT) i, '000000000|' || chr(1) e, CAST(NULL AS VARCHAR) s, CAST(NULL AS VARCHAR) u, CAST(NULL AS VARCHAR) a FROM k")} UNION ALL {_inserted(_row())}),
n AS (SELECT conv_id, g, arg_max(least(e, a), i) best FROM (SELECT conv_id, g, i, e, a FROM l) GROUP BY 1, 2),
c AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) gaps, count(*) FILTER (blank) blank, count(*) FILTER (again) again, count(*) FILTER (truncated) truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY 1)
SELECT n.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(again, 0) "duplicate", coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, CAST(best[1:9] AS BIGINT) "cost", {_AUDIT.format('best')} audit, sha256({_TEXT.format('best')}) repaired_sha256 FROM n LEFT JOIN c ON c.g = n.g"""
