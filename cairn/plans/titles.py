"""Queries over lines of documents as headlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import headlines, text
from cairn.operators.headlines import DROP, NEXT, Correction, Judgement, Lexicon, Rule
from cairn.plans.core import query
from cairn.sources import tables

#: Rules over words of the given tables' invented prose, one of each kind.
WORDS = {"armed_conflict": ["hehely", "thatin"], "attack": ["oránt", "für"], "earthquake": ["inoran", "erin$"], "flood": ["thth", "thble"], "unrest": ["rewh", "ñta"]}
MARKS = {"noise": ["ononst"], "explosion": ["thre", "tion"], "intent": ["thed", "und"], "protest": ["erer", "mit"], "military": ["orre"], "judicial": ["thea$"], "escalation": ["was"], "first": ["the", "der"], "analysis": ["thes"]}
LEXICON = Lexicon(WORDS, MARKS, patterns={"question": r"^(?:the|der)\b[^?]*\?"}, views={"first": headlines.View("", 3)})
RULES = Judgement(
    veto=Rule("noise", has=("noise",)),
    corrections=(
        Correction(Rule("explosion", of=("attack",), has=("explosion",), lacks=("intent",)), ((Rule("drop", has=("military",)), DROP), (Rule("other"), NEXT), (Rule("harm", has=("protest|analysis",)), "infrastructure")), skip=("attack", "crime")),
        Correction(Rule("protest", of=("armed_conflict",), has=("protest",), lacks=("military",)), ((Rule("all"), "unrest"),), also="flood"),
    ),
    reasons=(Rule("judicial", has=("judicial",), lacks=("protest",)), Rule("no impact", of=("earthquake",), lacks=("explosion", "military"))),
    contexts=(Rule("question", has=("question",)), Rule("opening", of=("attack", "flood"), has=("first",)), Rule("analysis", of=("unrest", "infrastructure"), has=("analysis",))),
    severity=(("armed_conflict", 2), ("attack", 2), ("earthquake", 2), ("flood", 1), ("unrest", 1), ("infrastructure", 1)),
    escalation=Rule("escalation", has=("escalation",)),
)


def _has(words: list[str], t: str = "t") -> str:
    """The word rule as a regular expression: a word begins at a word's start; short ones and those with $ end at a word's end."""
    edge = "[^\\p{L}\\p{N}_]"
    plain = {"oránt": "orant", "für": "fur", "ñta": "nta"}
    words = [plain.get(w, w) for w in words]
    return f"regexp_matches({t}, '(^|{edge})({'|'.join(w.rstrip('$') + (f'($|{edge})' if w[-1] == '$' or len(w) <= 4 else '') for w in words)})')"


DEAD = "(?i)(\\d{1,5})\\s*(?:people\\s+|personnes\\s+|personas\\s+|pessoas\\s+|persone\\s+|menschen\\s+)?(?:dead|killed|die[ds]?|morts?|tués?|muertos|fallecidos|mortos|morti|tote|todesopfer|ölü)"
KILLS = "(?i)(?:kill(?:s|ed|ing)?|tue(?:nt)?|mata(?:m|n)?|uccide|fait|deja|dejan|t[öo]tet)\\s+(?:at least\\s+|au moins\\s+|al menos\\s+|pelo menos\\s+|almeno\\s+|mindestens\\s+)?(\\d{1,5})"


@query(f"""WITH l AS (SELECT doc_id, CAST(line_no AS INT) line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, trim(regexp_replace(lower(strip_accents(line)), '\\s+', ' ', 'g')) t FROM l), v AS (SELECT *, array_to_string(string_split(t, ' ')[1:3], ' ') t3 FROM f),
h AS (SELECT doc_id, line_no, line, {', '.join(f'{_has(w)} c_{c}' for c, w in WORDS.items())}, {', '.join(f'{_has(w, "t3" if g == "first" else "t")} g_{g}' for g, w in MARKS.items())}, regexp_matches(t, '^(?:the|der)\\b[^?]*\\?') g_question FROM v),
a AS (SELECT *, CASE WHEN g_noise THEN NULL {' '.join(f"WHEN c_{c} THEN '{c}'" for c in WORDS)} END c0, CASE WHEN c_armed_conflict THEN 'armed_conflict' WHEN c_earthquake THEN 'earthquake' WHEN c_flood THEN 'flood' WHEN c_unrest THEN 'unrest' END other FROM h),
b AS (SELECT *, CASE WHEN c0 = 'attack' AND g_explosion AND NOT g_intent THEN CASE WHEN g_military THEN NULL WHEN other IS NOT NULL THEN other WHEN g_protest OR g_analysis THEN 'infrastructure' ELSE c0 END ELSE c0 END c1 FROM a),
c AS (SELECT *, CASE WHEN c1 = 'armed_conflict' AND g_protest AND NOT g_military AND c_flood THEN 'unrest' ELSE c1 END category FROM b),
d AS (SELECT *, CASE WHEN category IS NULL THEN NULL WHEN g_judicial AND NOT g_protest THEN 'judicial' WHEN category = 'earthquake' AND NOT g_explosion AND NOT g_military THEN 'no impact' END reason,
  CASE WHEN category IS NULL THEN NULL WHEN g_question THEN 'question' WHEN category IN ('attack', 'flood') AND g_first THEN 'opening' WHEN category IN ('unrest', 'infrastructure') AND g_analysis THEN 'analysis' END context,
  list_max(list_transform(list_concat(regexp_extract_all(line, '{DEAD}', 1), regexp_extract_all(line, '{KILLS}', 1)), lambda x: CAST(x AS INT))) deaths FROM c)
SELECT doc_id, line_no, category, reason, context, CASE WHEN category IS NOT NULL AND reason IS NULL THEN CAST(least(4, greatest(CASE WHEN category IN ('armed_conflict', 'attack', 'earthquake') THEN 2 ELSE 1 END + CAST(g_escalation AS INT), CASE WHEN deaths >= 50 THEN 4 WHEN deaths >= 10 THEN 3 WHEN deaths >= 1 THEN 2 ELSE 0 END)) AS INT) END severity,
  category IS NOT NULL AND reason IS NULL AND context IS NULL AS "event" FROM d""")
def judged_titles(spark, d):
    lines = tables.document_lines(spark, d).select(F.col("id").alias("doc_id"), "line_no", "title")
    return headlines.judged(lines, LEXICON, RULES).select("doc_id", "line_no", "category", "reason", "context", "severity", "event")


def _votes(lang: str) -> str:
    words = text.LANGUAGE_HINTS[lang].split()
    sets = [", ".join(f"'{w}'" for w in words if (len(w) > 3) == far) for far in (False, True)]
    marks = f" + 2 * least(2, len(regexp_extract_all(low, '[{text.LETTER_HINTS[lang]}]')))" if lang in text.LETTER_HINTS else ""
    return f"len(list_filter(w, lambda x: list_contains([{sets[0]}], x))) + 2 * len(list_filter(w, lambda x: list_contains(CAST([{sets[1]}] AS VARCHAR[]), x))){marks} {lang}_"


@query(f"""WITH t AS (SELECT lang, lower(text) low, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') w FROM documents), v AS (SELECT lang, w, {', '.join(map(_votes, text.LANGUAGE_HINTS))} FROM t),
r AS (SELECT lang, w, list_reverse_sort([{', '.join(f'{k}_' for k in text.LANGUAGE_HINTS)}]) s, CASE greatest({', '.join(f'{k}_' for k in text.LANGUAGE_HINTS)}) {' '.join(f"WHEN {k}_ THEN '{k}'" for k in text.LANGUAGE_HINTS)} END best FROM v)
SELECT lang, CASE WHEN len(w) >= 3 AND s[1] >= 2 AND s[1] > s[2] THEN best END guess, count(*) n FROM r GROUP BY 1, 2""")
def guessed_languages(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("lang", text.guess_language("text").alias("guess")).count().withColumnRenamed("count", "n")
