"""Where a headline's fact is: countries in order of mention, cities by n-grams, and the decision between them.

Countries come from a trie over the words of all their names: at each word the longest name is taken, overlaps go to the one on the left,
and a window after the name and the quotations around it tell who acts and what is only said. Cities are an equi-join of n-grams with a gazetteer of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import fold
from cairn.functions.folding import ARABIC, ARABIC_ARTICLES, HEBREW, HEBREW_LETTERS, NO_SPACES, folded
from cairn.operators.headlines import fold_one

#: Verbs of an attack after a country that is its author; prepositions of place, and those that are strong evidence; words after a
#: name that make it another name; verbs that make a capital its government; population from which a city is known everywhere, and below which a name needs a preposition.
ACTS = r"(?:'s)?\s*(?:\w+\s+){0,1}(?:hits?|strikes?|struck|bombs?|bombed|attacks?|attacked|shells?|pounds?|launch(?:es|ed)?|fires?|fired|targets?|targeted|frappe\w*|bombarde\w*|attaque\w*|ataca\w*|bombardea\w*|golpea\w*|forces? (?:attack|strike|hit|launch|shell))\b"
STRONG = "in at on over near outside en a au dans pres em no na cerca im bei nel nella".split()
PREPOSITIONS = [*STRONG, *"from of de du d to vers para por nach von aus di da sur sobre around across around".split()]
SUFFIXES = "park county street avenue road university district square airport hills heights".split()
SPEECH = "says said dit warns urges calls condemns denies announces accuses vows met dice".split()
BIG, SMALL = 1_000_000, 150_000
QUOTED = re.compile('"[^"]{3,200}"|“[^”]{3,200}”|«[^»]{3,200}»|„[^“”]{3,200}[“”]')
WORD = re.compile(r"[\w'’-]+")
MENTIONS = "array<struct<country:string,start:int,actor:boolean,quoted:boolean>>"


class Countries:
    """The trie of country names."""

    def __init__(self, names: dict[str, str], acts: str = ACTS) -> None:
        self.acts, self.trie, self.inside = re.compile(acts), {}, []
        for name, country in sorted(names.items()):
            key = fold_one(name)
            if NO_SPACES.search(key):
                self.inside.append((key, country))
                continue
            node = self.trie
            for word in WORD.findall(key):
                node = node.setdefault(word, {})
            if node is not self.trie:
                node.setdefault(None, country)

    @staticmethod
    def _bare(word: str) -> list[str]:
        """What a word may be without the letters that its script writes before names, or an English possessive."""
        if word.endswith("'s"):
            return [word[:-2]]
        if ARABIC.search(word):
            return [word[1:]] * (word[0] in "وفبل" and len(word) > 4) + [ARABIC_ARTICLES[1] + word[2:]] * word.startswith(ARABIC_ARTICLES[2])
        if HEBREW.search(word):
            return [word[k:] for k in (1, 2) if len(word) > k + 2 and all(c in HEBREW_LETTERS for c in word[:k])]
        return []

    def mentions(self, text: str) -> list[dict]:
        """Countries of a folded text in order."""
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        found = []
        for i, (start, end, word) in enumerate(words):
            node, best = self.trie, None
            for _, to, w in words[i:]:
                node = node.get(w)
                if node is None:
                    break
                if None in node:
                    best = (to, node[None])
            if best is None:
                best = next(((end, self.trie[w][None]) for w in self._bare(word) if None in self.trie.get(w, ())), None)
            if best:
                found.append((start, *best))
        for key, country in self.inside:
            found += [(m.start(), m.end(), country) for m in re.finditer(re.escape(key), text)]
        quotes = [m.span() for m in QUOTED.finditer(text)]
        out, covered = [], -1
        for start, end, country in sorted(found, key=lambda f: (f[0], -f[1])):
            if start >= covered:
                out.append({"country": country, "start": start, "actor": bool(self.acts.match(text[end : end + 40])), "quoted": any(a <= start < b for a, b in quotes)})
                covered = end
        return out


def country_mentions(titles: DataFrame, aliases: DataFrame, text: str = "title", most: int = 100_000) -> DataFrame:
    """``titles`` with ``mentions``: countries of aliases(alias, country) in order, each with its place in the folded text, whether it is the author of an
    attack, and whether it is inside a quotation. Missing titles have none. More than ``most`` aliases aren't names of countries."""
    rows = aliases.where("alias IS NOT NULL").select("alias", "country").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} aliases")
    names = {r.alias: r.country for r in sorted(rows, key=lambda r: (r.alias, r.country), reverse=True)}

    @F.arrow_udf(MENTIONS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Countries(names)
        kind = pa.list_(pa.struct([("country", pa.string()), ("start", pa.int32()), ("actor", pa.bool_()), ("quoted", pa.bool_())]))
        for batch in batches:
            yield pa.array([trie.mentions(t) if t else [] for t in folded(batch).to_pylist()], kind)

    return titles.withColumn("mentions", run(F.col(text)))


def cited_country(mentions: Column | str) -> Column:
    """The first mention that is neither quoted nor an author; else the first that isn't quoted; else the first."""
    m = F.col(mentions) if isinstance(mentions, str) else mentions
    outside = F.filter(m, lambda x: ~x["quoted"])
    outside = F.when(F.size(outside) > 0, outside).otherwise(m)
    place = F.filter(outside, lambda x: ~x["actor"])
    return F.try_element_at(F.when(F.size(place) > 0, place).otherwise(outside), F.lit(1))


def _grams(titles: DataFrame, most: int = 3) -> DataFrame:
    """id, gram, size, i, prev, nxt: n-grams of folded words that don't begin with a small letter in the title."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)[\w-]+"), F.lit(0))
    x = titles.select("id", words(fold("title")).alias("t"), words(F.col("title")).alias("raw"))
    spot = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("t")), lambda i: i + n <= F.size("t")), lambda i: F.struct(F.array_join(F.slice("t", i + 1, n), " ").alias("gram"), F.lit(n).alias("size"), i.alias("i"), F.coalesce(F.get("t", i - 1), F.lit("")).alias("prev"), F.coalesce(F.get("t", i + n), F.lit("")).alias("nxt"), F.left(F.coalesce(F.get("raw", i), F.lit("")), F.lit(1)).alias("first")))
    x = x.select("id", F.explode(F.concat(*(spot(n) for n in range(1, most + 1)))).alias("g")).select("id", "g.*")
    return x.where(~((F.col("first") == F.lower("first")) & (F.col("first") != F.upper("first")))).where(~F.col("nxt").isin(SUFFIXES)).drop("first")


def city_of(grams: DataFrame, gazetteer: DataFrame, on: list[str]) -> DataFrame:
    """id, c: the best city of grams(id, gram, ..., bare, prep) in gazetteer(country, gram, place, lat, lon, population, capital).

    A capital counts after a preposition of place or where ``bare`` holds, and never before a verb of speech; a small town needs a preposition in languages
    that use one (``prep``). Cities that aren't capitals come first, then the most populous."""
    placed = F.col("prev").isin(PREPOSITIONS)
    ok = F.when(F.col("capital"), ~F.col("nxt").isin(SPEECH) & (F.col("bare") | placed)).otherwise(~(F.col("prep") & (F.col("population") < SMALL) & ~placed))
    hits = grams.join(gazetteer, on).where(ok)
    city = F.struct("country", "place", "lat", "lon", "population", "gram", "prev")
    return hits.groupBy("id").agg(F.max_by(city, F.struct((~F.col("capital")).alias("a"), "population", "place", "size", (-F.col("i")).alias("b"))).alias("c"))


def locate_titles(titles: DataFrame, aliases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id, country, place, lat, lon, precision of titles(id, title, hint, and maybe natural, prep).

    The country is the one that is cited (not the author of an attack, not in a quotation, if there is another), else the feed's ``hint``. A big city
    abroad wins over it if the country cited is only the author, or the city stands before it after a strong preposition, or no country is cited and
    the country of the feed has no such city, has it as a small namesake, or the preposition speaks for the big one. Else a city of the country is the place.
    Without a country a big city of one country alone decides. ``natural``: hazards, for which a capital is a place; ``prep``: the language
    puts prepositions before places. Titles without any have nulls.
    """
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in titles.columns else F.lit(default)
    x = country_mentions(titles.select("id", "title", "hint", flag("natural", False).alias("natural"), flag("prep", True).alias("prep")), aliases)
    x = x.withColumn("m", cited_country("mentions")).select("id", "title", "natural", "prep", F.col("m.country").alias("cited"), F.coalesce("m.actor", F.lit(False)).alias("actor"), F.col("m.start").alias("at"), F.coalesce("m.country", "hint").alias("iso"))
    names = gazetteer.select("country", fold("name").alias("gram"), "place", "lat", "lon", "population", F.coalesce("capital", F.lit(False)).alias("capital"))
    one = names.groupBy("country", "gram").agg(F.max_by(F.struct("place", "lat", "lon", "population", "capital"), F.struct("population", "place")).alias("g")).select("country", "gram", "g.*")
    big = one.where(F.col("population") >= BIG)
    alone = big.groupBy("gram").agg(F.count("*").alias("n")).where("n = 1").select("gram")
    grams = _grams(x).join(x.select("id", "iso", "natural", "actor", "prep"), "id")
    local = city_of(grams.withColumn("bare", F.col("natural")).withColumn("country", F.col("iso")), one, ["country", "gram"]).withColumnRenamed("c", "l")
    known = city_of(grams.withColumn("bare", F.col("natural") | (F.col("actor") & F.col("iso").isNotNull())).drop("country"), big.join(alone, "gram"), ["gram"]).withColumnRenamed("c", "b")
    y = x.join(local, "id", "left").join(known, "id", "left")
    abroad = F.col("b").isNotNull() & (F.col("b.country") != F.col("iso"))
    strong = F.col("b.prev").isin(STRONG) & ~F.coalesce(F.col("l.prev").isin(STRONG), F.lit(False))
    namesake = F.col("l").isNotNull() & (F.col("l.gram") == F.col("b.gram")) & ((fold("l.place") != F.col("b.gram")) | (F.col("b.population") >= 20 * F.greatest(F.col("l.population"), F.lit(1))))
    before = F.col("at").isNull() | (F.instr(fold("title"), F.col("b.gram")) - 1 < F.col("at"))
    wins = abroad & F.when(F.col("cited").isNotNull(), F.col("actor") | (strong & before)).otherwise(F.col("l").isNull() | namesake | strong)
    city = F.when(F.col("iso").isNull() | F.coalesce(wins, F.lit(False)), F.col("b")).otherwise(F.col("l"))
    return y.withColumn("c", city).select("id", F.coalesce("c.country", "iso").alias("country"), F.col("c.place").alias("place"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"), F.when(F.col("c").isNotNull(), "city").when(F.col("iso").isNotNull(), "country").alias("precision"))
