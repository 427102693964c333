"""Headlines judged by rules that are data: one pass of an automaton finds all word groups, and column expressions decide.

A ``Lexicon`` holds named groups of words (and patterns). Its automaton is built once, broadcast with the task, and goes over each folded
text once, however many words there are; vocabularies of any size come from a table of the caller's (``Lexicon.of_table``). What was found stands in two columns: ``found`` (categories by priority)
and ``hits`` (all groups). A ``Judgement`` is an ordered set of rules over these: vetoes, corrections of the category, reasons against
an incident, reasons for mere context. They become ``when`` chains, so what decides can be read in the plan.

Words match as follows. A word begins where a word begins, and ends where a word ends if it has up to four letters or a ``$``; else it
is a root. In scripts without spaces it may stand anywhere. Hebrew and Arabic words may carry the letters that these scripts write before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.folding import ARABIC, ARABIC_ARTICLES, ARABIC_LETTERS, HEBREW, HEBREW_LETTERS, NO_SPACES, folded

#: What a correction may do instead of naming a category.
DROP, NEXT = "", "next"


def fold_one(text: str) -> str:
    return folded(pa.array([text], pa.string()))[0].as_py()


def _word_character(c: str) -> bool:
    return c.isalnum() or c == "_"


@dataclass(frozen=True)
class View:
    """The text that a group looks at: without the matches of a pattern, and of the first words alone."""

    without: str = ""
    words: int = 0


@dataclass
class Lexicon:
    """Groups of words: ``categories`` in priority order, other ``groups``, ``patterns`` (regular expressions over folded text); ``views`` by
    group; ``rewrites`` of the folded text before all else."""

    categories: dict[str, list[str]]
    groups: dict[str, list[str]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    rewrites: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of_table(words: DataFrame, priority: list[str], most: int = 200_000, **more) -> Lexicon:
        """From a table (grp, word); categories are the groups that ``priority`` names. More than ``most`` rows aren't a vocabulary."""
        rows = words.select("grp", "word").where("word IS NOT NULL").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} words")
        groups: dict[str, list[str]] = {}
        for r in sorted(rows):
            groups.setdefault(r.grp, []).append(r.word)
        return Lexicon({c: groups.pop(c, []) for c in priority}, groups, **more)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a lexicon. It is built once per worker from the lexicon that comes with the task."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.order = lexicon, list(lexicon.categories)
        by_word: dict[str, dict[str, bool]] = {}
        for group, words in (lexicon.categories | lexicon.groups).items():
            for raw in words:
                # a space at the end stays out, as folding trims it
                word = fold_one(raw)
                bare = word.rstrip("$")
                if bare:
                    whole = not NO_SPACES.search(bare) and (word != bare or len(bare) <= 4)
                    by_word.setdefault(bare, {})
                    by_word[bare][group] = by_word[bare].get(group, True) and whole  # a root finds all that the whole word finds
        self.automaton = ahocorasick.Automaton()
        for word, groups in by_word.items():
            script = 2 if NO_SPACES.search(word) else 1 if HEBREW.search(word) or ARABIC.search(word) else 0
            self.automaton.add_word(word, (len(word), script, tuple(g for g, w in groups.items() if not w), tuple(g for g, w in groups.items() if w)))
        if by_word:
            self.automaton.make_automaton()
        self.patterns = {g: re.compile(p) for g, p in lexicon.patterns.items()}
        self.rewrites = [(re.compile(p), to) for p, to in lexicon.rewrites]
        self.views = {v: re.compile(v.without) if v.without else None for v in set(lexicon.views.values())}

    @staticmethod
    def _begins(text: str, at: int, script: int) -> bool:
        """Whether a word may begin here."""
        if script == 2 or not at or not _word_character(text[at - 1]):
            return True
        if script == 0:
            return False
        for n in (1, 2):
            if at >= n and all(c in HEBREW_LETTERS for c in text[at - n : at]) and (at == n or not _word_character(text[at - n - 1])):
                return True
        for article in ARABIC_ARTICLES:
            for letter in ARABIC_LETTERS:
                before = letter + article
                i = at - len(before)
                if before and i >= 0 and text.startswith(before, i) and (not i or not _word_character(text[i - 1])):
                    return True
        return False

    def words_in(self, text: str) -> set[str]:
        """Groups with a word in the folded text."""
        out: set[str] = set()
        if len(self.automaton):
            for last, (length, script, roots, whole) in self.automaton.iter(text):
                ends = last + 1 == len(text) or not _word_character(text[last + 1])
                if (roots or ends) and self._begins(text, last + 1 - length, script):
                    out.update(roots)
                    if ends:
                        out.update(whole)
        return out

    def rewritten(self, text: str) -> str:
        for pattern, to in self.rewrites:
            text = pattern.sub(to, text)
        return text

    def hits(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """Categories by priority, categories of the text without the view ``rest``, and all other groups, of a folded text."""
        found = self.words_in(text)
        found.update(g for g, p in self.patterns.items() if p.search(text))
        rest = found
        for view, pattern in self.views.items():
            part = pattern.sub(" ", text) if pattern else text
            if view.words:
                part = " ".join(part.split()[: view.words])
            if part == text:
                continue
            names = {g for g, v in self.lexicon.views.items() if v == view}
            seen = self.words_in(part) | {g for g in names & set(self.patterns) if self.patterns[g].search(part)}
            if "rest" in names:
                rest = seen
            found = (found - names) | (seen & names)
        return [c for c in self.order if c in found], [c for c in self.order if c in rest], sorted(found - set(self.order))


def with_hits(titles: DataFrame, lexicon: Lexicon, text: str = "title") -> DataFrame:
    """``titles`` with folded, found, rest (arrays of categories) and hits (array of groups). Missing texts have no hits; all columns are kept."""
    columns = titles.columns
    if clash := {"folded", "found", "rest", "hits"} & {c.lower() for c in columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    words = T.ArrayType(T.StringType())
    schema = T.StructType([*titles.schema.fields, T.StructField("folded", T.StringType()), *(T.StructField(c, words) for c in ("found", "rest", "hits"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            plain = folded(batch.column(columns.index(text)).cast(pa.string()))
            if matcher.rewrites:
                plain = pa.array([None if t is None else matcher.rewritten(t) for t in plain.to_pylist()], pa.string())
            rows = [matcher.hits(t) if t else ([], [], []) for t in plain.to_pylist()]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, plain, *lists], [*columns, "folded", "found", "rest", "hits"])

    return titles.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Holds for categories ``of`` (none: all) if every entry of ``has`` and none of ``lacks`` is among the hits; an entry ``a|b`` is either."""

    name: str
    of: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()

    def holds(self, category: Column, hits: Column) -> Column:
        test = category.isin(*self.of) if self.of else F.lit(True)
        for entry in self.has:
            test &= F.arrays_overlap(hits, F.array(*map(F.lit, entry.split("|"))))
        for entry in self.lacks:
            test &= ~F.arrays_overlap(hits, F.array(*map(F.lit, entry.split("|"))))
        return test


@dataclass(frozen=True)
class Correction:
    """Where ``when`` holds, the first branch that holds says what the category becomes: a name, DROP, or NEXT (the next category found
    that isn't in ``skip``; the branch holds only if there is one); ``also``: a category that must have been found besides. Without a branch that holds it stays."""

    when: Rule
    branches: tuple[tuple[Rule, str], ...]
    skip: tuple[str, ...] = ()
    also: str = ""


@dataclass(frozen=True)
class Judgement:
    """All rules, in the order in which they are asked."""

    veto: Rule
    corrections: tuple[Correction, ...] = ()
    reasons: tuple[Rule, ...] = ()
    contexts: tuple[Rule, ...] = ()
    severity: tuple[tuple[str, int], ...] = ()
    escalation: Rule | None = None
    #: Deaths from which the severity is at least so much.
    deaths: tuple[tuple[int, int], ...] = ((50, 4), (10, 3), (1, 2))


def first_name(rules: tuple[Rule, ...], category: Column, hits: Column) -> Column:
    """The name of the first rule that holds, else null."""
    return F.coalesce(*(F.when(r.holds(category, hits), F.lit(r.name)) for r in rules), F.lit(None).cast("string"))


def _asked(rules: Judgement) -> set[str]:
    """Groups that a rule names."""
    every = [rules.veto, *rules.reasons, *rules.contexts, *([rules.escalation] if rules.escalation else []), *(r for c in rules.corrections for r in (c.when, *(b for b, _ in c.branches)))]
    return {g for r in every for entry in (*r.has, *r.lacks) for g in entry.split("|")}


def _corrected(c: Correction) -> Column:
    category, hits = F.col("category"), F.col("_hits")
    others = F.filter("rest", lambda x: ~x.isin(*(c.skip or c.when.of)))
    to = {DROP: F.lit(None).cast("string"), NEXT: F.try_element_at(others, F.lit(1))}
    branch = F.when(F.lit(False), category)
    for rule, name in c.branches:
        test = rule.holds(category, hits)
        branch = branch.when(test & (F.size(others) > 0) if name == NEXT else test, to.get(name, F.lit(name)))
    holds = c.when.holds(category, hits)
    if c.also:
        holds &= F.array_contains("found", c.also)
    return F.when(holds, branch.otherwise(category)).otherwise(category)


def judged(titles: DataFrame, lexicon: Lexicon, rules: Judgement, text: str = "title") -> DataFrame:
    """``titles`` with category, severity, reason, context, toll, event and the columns of ``with_hits``.

    The category is the first that was found, unless a veto holds, as corrections leave it. Numbers of the text count as groups: ``toll``
    (any dead or hurt), ``heavy toll`` (3 dead or 5 in all), ``notable toll`` (2 or 3), ``magnitude``, ``weak magnitude`` (under 5). A row with a reason is no
    incident; one with a context is no event. Rows without a category have neither; texts that are missing or empty have no category.
    """
    from cairn.functions.exprs import magnitudes
    from cairn.operators.text import casualty_toll, death_count

    x = with_hits(titles, lexicon, text)
    dead, all_hurt, strongest = casualty_toll("folded", dead_only=True), casualty_toll("folded"), F.array_max(magnitudes("folded"))
    x = x.withColumn("toll", F.when(F.col("folded").isNull(), 0).otherwise(all_hurt)).withColumn("_dead", dead).withColumn("_strongest", strongest)
    marks = [("toll", F.col("toll") > 0), ("heavy toll", (F.col("_dead") >= 3) | (F.col("toll") >= 5)), ("notable toll", (F.col("_dead") >= 2) | (F.col("toll") >= 3)), ("magnitude", F.col("_strongest").isNotNull()), ("weak magnitude", F.col("_strongest") < 5)]
    with_marks = lambda some: F.concat("hits", F.array_compact(F.array(*(F.when(test, name) for name, test in some)))) if some else F.col("hits")
    # rules read the numbers that they name, so that a text is searched for the others only if the caller takes toll or hits
    x = x.withColumns({"_hits": with_marks([m for m in marks if m[0] in _asked(rules)]), "hits": with_marks(marks)})
    x = x.withColumn("category", F.when(~rules.veto.holds(F.lit(""), F.col("_hits")), F.try_element_at("found", F.lit(1))))
    for c in rules.corrections:
        x = x.withColumn("category", _corrected(c))
    category, hits = F.col("category"), F.col("_hits")
    x = x.withColumn("reason", F.when(category.isNotNull(), first_name(rules.reasons, category, hits))).withColumn("context", F.when(category.isNotNull(), first_name(rules.contexts, category, hits)))
    base = F.create_map(*(F.lit(v) for kv in rules.severity for v in kv))[category] if rules.severity else F.lit(1)
    more = rules.escalation.holds(category, hits).cast("int") if rules.escalation else F.lit(0)
    incident = category.isNotNull() & F.col("reason").isNull()
    x = x.withColumn("_deaths", F.when(incident, death_count(text)) if rules.deaths else F.lit(None).cast("int"))
    deaths = F.col("_deaths")
    least = reduce(lambda w, s: w.when(deaths >= s[0], s[1]), rules.deaths[1:], F.when(deaths >= rules.deaths[0][0], rules.deaths[0][1])).otherwise(0) if rules.deaths else F.lit(0)
    x = x.withColumn("severity", F.when(incident, F.least(F.lit(4), F.greatest(F.coalesce(base, F.lit(1)) + more, least))))
    return x.withColumn("event", category.isNotNull() & F.col("reason").isNull() & F.col("context").isNull()).drop("_dead", "_strongest", "_hits", "_deaths")


def code_noise(articles: DataFrame, lexicon: Lexicon, rules: Judgement, physical: tuple[str, ...], soft: tuple[str, ...], text: str = "headline") -> DataFrame:
    """``articles`` with ``noise``: why the headline speaks against the code that a machine gave the article, else null.

    Without a headline nothing speaks against it. A headline with no category is off topic unless a group of ``physical`` is hit; so is one under
    the veto. Reasons count if ``soft`` names them, contexts always.
    """
    x = judged(articles, lexicon, rules, text).withColumn("_veto", rules.veto.holds(F.lit(""), F.col("hits")))
    off = F.when(F.size("found") == 0, F.when(~F.arrays_overlap("hits", F.array(*map(F.lit, physical))), "off topic")).otherwise(F.when(F.col("_veto"), "off topic"))
    category = F.try_element_at("found", F.lit(1))
    reason = first_name(rules.reasons, category, F.col("hits"))
    told = F.when((F.size("found") > 0) & ~F.col("_veto"), F.coalesce(F.when(reason.isin(*soft), reason), first_name(rules.contexts, category, F.col("hits"))))
    return x.select(*articles.columns, F.when(F.trim(F.col(text)) != "", F.coalesce(off, told)).alias("noise"))


def seed_rules() -> tuple[Lexicon, Judgement]:
    """A small lexicon in English with all kinds of rules; callers pass fuller vocabularies as data."""
    return Lexicon(SEED_CATEGORIES, SEED_GROUPS, SEED_PATTERNS, SEED_VIEWS, SEED_REWRITES), SEED_RULES


#: Categories in priority order, with a few words each; the severity that each begins with.
SEED_CATEGORIES = {
    "terrorism": ["terror", "jihad", "suicide bomb"], "armed_conflict": ["airstrike", "shelling", "offensive", "clashes", "missile"], "attack": ["attack", "bomb", "bombs", "bombing", "explos", "blast", "gunmen", "shooting", "kidnap"], "earthquake": ["earthquake", "quake$", "aftershock"],
    "cyclone": ["cyclone", "hurricane", "typhoon"], "flood": ["flood", "inondation"], "volcano": ["volcan", "eruption"], "wildfire": ["wildfire", "forest fire"], "landslide": ["landslide", "mudslide"], "health": ["outbreak", "cholera", "ebola"], "political": ["coup", "martial law"],
    "unrest": ["protest", "riot", "riots", "strike$", "unrest"], "cyber": ["cyber", "ransomware", "data breach"], "infrastructure": ["blackout", "power outage", "derail", "plane crash"], "crime": ["murder", "robbery", "gang"], "storm": ["storm"], "extreme_temp": ["heatwave", "cold wave"], "drought": ["drought"], "diplomatic": ["summit", "embassy", "election"],
}
SEED_SEVERITY = (("terrorism", 3), ("armed_conflict", 2), ("attack", 2), ("political", 1), ("unrest", 1), ("crime", 1), ("cyber", 1), ("infrastructure", 1), ("health", 2), ("earthquake", 2), ("cyclone", 2), ("flood", 2), ("volcano", 2), ("wildfire", 1), ("landslide", 2), ("storm", 1), ("extreme_temp", 1), ("drought", 1), ("diplomatic", 1))
NATURAL = ("earthquake", "cyclone", "flood", "volcano", "wildfire", "landslide", "storm", "extreme_temp", "drought")
VIOLENT = ("attack", "terrorism", "armed_conflict", "crime")
SEED_GROUPS = {
    "noise": ["movie", "film", "football", "concert", "anniversary", "recipe", "heart attack"], "escalation": ["massacre", "state of emergency", "martial law", "coup"], "lightning": ["lightning"], "explosion": ["explos", "blast"], "intent": ["bomb", "bombing", "grenade", "planted"], "generic": ["attack"], "firework": ["firework"],
    "accident": ["gas leak", "accident"], "target": ["checkpoint", "market", "police station", "bus$"], "violence": ["kill", "dead", "shot", "wounded", "gunfire"], "industrial": ["factory", "refinery", "pipeline"], "cyber hint": ["password", "ransomware", "hackers"], "protest": ["protest", "rally"], "civil": ["students", "blockade"],
    "military": ["army", "troops", "soldiers"], "armed group": ["rebels", "militia"], "protesters": ["protesters", "students", "demonstrators"], "mine protest": ["mining", "miners"], "refusal": ["protest", "refuse"], "victory": ["landslide victory", "landslide win"], "strike by force": ["forces strike", "drones strike", "missiles strike"],
    "police clash": ["clashes with police", "tear gas"], "vote violence": ["gunfire", "set on fire", "torched"], "judicial": ["sentenced", "trial", "court", "convicted"], "mobilisation": ["protest", "march", "rally"], "retrospective": ["years after", "lessons from", "project", "study"], "quake impact": ["dead", "killed", "damage", "collapse", "tsunami", "strong"],
    "private": ["suicide", "domestic"], "public crime": ["gunmen", "mass", "gang"], "aftermath": ["funeral", "mourn", "vigil"], "animal": ["dog attack", "shark"], "threat": ["threaten", "threat"], "mass": ["mass", "dozens"], "specific": ["gunmen", "kidnap", "stabbing", "hijack"], "place": ["school", "church", "market", "village", "embassy"],
    "arrest": ["arrest", "detained", "jailed"], "first arrest": ["arrest", "detained", "jailed"], "fresh": ["killed", "kills", "dead", "wounded"], "foiled": ["foiled", "thwarted", "plot"], "reaction": ["condemn", "calls for", "denies", "vows"], "analysis": ["analysis", "explained", "why it"], "prevention": ["drill", "prepare", "rebuild", "funding"], "military news": ["deployment", "unveil", "budget"],
}
SEED_PATTERNS = {"metaphor": r"terrori[sz]e[sd]? (?:the )?(?:fans|rivals|opponents)", "poster flood": r"\b(?:posters|tourists|fans|thousands|students) (?:\w+ )?flood", "question": r"^(?:why|how|who|what)\b[^?]*\?"}
SEED_VIEWS = {"private": View(r"suicide[ -]?(?:bomb\w*|attack\w*|blast)"), "arrest": View(r"(?:taken|rushed) to (?:the )?hospital"), "first arrest": View("", 6), "rest": View(r"terrori[sz]e[sd]? (?:the )?(?:fans|rivals|opponents)")}
SEED_REWRITES = ((r"seizures? of (?:weapons|drugs)", "confiscated"),)
_ALL = Rule("otherwise")
SEED_RULES = Judgement(
    veto=Rule("noise", has=("noise",)),
    corrections=(
        Correction(Rule("lightning", of=("armed_conflict", "attack"), has=("lightning",)), ((_ALL, "storm"),)),
        Correction(Rule("violence at the polls", of=("diplomatic",), has=("vote violence",)), ((_ALL, "unrest"),)),
        Correction(Rule("explosion without intent", of=("attack",), has=("explosion",), lacks=("intent|generic",)), ((Rule("firework", has=("firework",)), DROP), (_ALL, NEXT), (Rule("target", has=("target",), lacks=("accident",)), "attack"), (Rule("harm", has=("violence|toll|accident|industrial",)), "infrastructure"), (_ALL, DROP)), skip=("attack", "crime")),
        Correction(Rule("stolen data", of=("attack", "crime"), has=("cyber hint",), lacks=("violence",)), ((_ALL, "cyber"),)),
        Correction(Rule("protest, not war", of=("armed_conflict",), has=("protest",), lacks=("military|armed group",)), ((_ALL, "unrest"),), also="unrest"),
        Correction(Rule("civil unrest", of=("armed_conflict",), has=("civil",), lacks=("military|armed group",)), ((_ALL, "unrest"),)),
        Correction(Rule("people flood", of=("flood",), has=("poster flood",)), ((Rule("people", has=("protesters",)), "unrest"), (_ALL, DROP))),
        Correction(Rule("against a mine", of=("volcano",), has=("mine protest",)), ((Rule("against", has=("refusal",)), "unrest"), (_ALL, DROP))),
        Correction(Rule("victory", of=("landslide",), has=("victory",)), ((_ALL, DROP),)),
        Correction(Rule("terror of words", of=("terrorism",), has=("metaphor",)), ((_ALL, NEXT), (_ALL, DROP)), skip=("terrorism",)),
        Correction(Rule("strike by forces", of=("unrest",), has=("strike by force",), lacks=("protest",)), ((_ALL, "armed_conflict"),)),
        Correction(Rule("clash with police", of=("armed_conflict",), has=("police clash",), lacks=("military|armed group|strike by force",)), ((_ALL, "unrest"),)),
    ),
    reasons=(
        Rule("retrospective or project", of=NATURAL, has=("retrospective",)),
        Rule("weak quake", of=("earthquake",), has=("weak magnitude",)),
        Rule("quake without impact", of=("earthquake",), lacks=("magnitude", "quake impact")),
        Rule("domestic accident", of=("infrastructure",), has=("explosion",), lacks=("heavy toll|industrial|target",)),
        Rule("judicial", has=("judicial",), lacks=("mobilisation",)),
        Rule("private", of=tuple(c for c in SEED_CATEGORIES if c not in ("armed_conflict", "terrorism")), has=("private",), lacks=("public crime",)),
        Rule("private", of=("crime",), lacks=("public crime",)),
        Rule("aftermath", of=("attack", "crime", "terrorism"), has=("aftermath",), lacks=("mobilisation",)),
        Rule("animal", of=("attack", "crime"), has=("animal",)),
        Rule("accident", of=("attack", "crime"), has=("firework",)),
        Rule("threat", of=("attack", "crime"), has=("threat",), lacks=("toll|mass",)),
        Rule("off topic", of=("attack", "crime"), lacks=("armed group|mass|violence|specific",)),
        Rule("minor crime", of=("attack", "crime"), lacks=("armed group|mass|heavy toll|notable toll|place|target",)),
    ),
    contexts=(
        Rule("political signal", of=("diplomatic",)),
        Rule("analysis", of=tuple(c for c in SEED_CATEGORIES if c != "unrest"), has=("question",)),
        Rule("analysis", has=("analysis",)),
        Rule("prevention", of=(*NATURAL, "health"), has=("prevention",)),
        Rule("foiled", of=(*VIOLENT, "political", "cyber"), has=("foiled",), lacks=("fresh|explosion",)),
        Rule("foiled", of=("terrorism",), has=("foiled",)),
        Rule("arrest", of=(*VIOLENT, "political", "cyber"), has=("first arrest",), lacks=("mobilisation",)),
        Rule("arrest", of=(*VIOLENT, "political", "cyber"), has=("arrest",), lacks=("fresh|mobilisation",)),
        Rule("statement", of=(*VIOLENT, "political", "cyber"), has=("reaction",), lacks=("toll|fresh",)),
        Rule("military news", of=("armed_conflict", "terrorism", "attack"), has=("military news",), lacks=("fresh",)),
    ),
    severity=SEED_SEVERITY,
    escalation=Rule("escalation", has=("escalation",)),
)
