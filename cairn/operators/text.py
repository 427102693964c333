"""Titles, links, mentions, languages and search over text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import col, fold

#: Words that raise each category, in priority order, a seed of the full vocabulary that callers pass as data.
SEED_RULES = (("terrorism", r"\b(terror|suicide bomb|jihad)"), ("armed_conflict", r"\b(airstrike|shelling|offensive|ceasefire)"), ("attack", r"\b(attack|gunm[ae]n|explosion|bomb|shot dead)"), ("unrest", r"\b(protest|riot|strike|clashes)"), ("earthquake", r"\b(earthquake|magnitude)"), ("flood", r"\b(flood|inondation)"), ("health", r"\b(outbreak|cholera|ebola)"), ("cyber", r"\b(cyber|ransomware)"))
NOISE = r"\b(movie|film|match|football|anniversary|recipe)\b"
LANGUAGE_HINTS = {
    "en": "the of and to in is that was with for from says after over", "fr": "le la les de des et un une est dans pour avec sur qui", "de": "der die das und ist ein zu den mit von nach bei auf", "es": "el los las de que y en un una con por para del",
    "pt": "o os as de que e em um uma com por para do da nao", "it": "il lo gli di che e in un una con per del della", "tr": "ve bir bu icin ile de da olarak", "id": "yang dan di ke dari untuk dengan pada", "pl": "i w na z do nie sie jest od", "nl": "de het een van en in op met voor",
}
#: Letters that speak for a language.
LETTER_HINTS = {"fr": "èêùœ", "de": "äöüß", "es": "ñ¿¡", "pt": "ãõ", "tr": "ğış", "pl": "ąęłńśźż"}
#: Scripts in the order in which they are asked; where a script has several languages, letters that only one of them has.
SCRIPTS = (
    ("he", r"[\x{0590}-\x{05FF}]"), ("ur", r"[ٹڈڑںےۓ]"), ("fa", r"[پچژگکی]"), ("ar", r"[\x{0600}-\x{06FF}]"), ("uk", r"[іїєґІЇЄҐ]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("th", r"[\x{0E00}-\x{0E7F}]"), ("ja", r"[\x{3040}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7AF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("am", r"[\x{1200}-\x{137F}]"), ("bn", r"[\x{0980}-\x{09FF}]"), ("hi", r"[\x{0900}-\x{097F}]"), ("el", r"[\x{0370}-\x{03FF}]"), ("ka", r"[\x{10A0}-\x{10FF}]"), ("hy", r"[\x{0530}-\x{058F}]"), ("ta", r"[\x{0B80}-\x{0BFF}]"), ("my", r"[\x{1000}-\x{109F}]"), ("km", r"[\x{1780}-\x{17FF}]"),
)


def classify(title: Column | str, rules=SEED_RULES, noise: str = NOISE) -> Column:
    """The first category whose pattern the folded title has, unless it is noise."""
    t = fold(title)
    return F.when(~t.rlike(noise), F.coalesce(*(F.when(t.rlike(p), c) for c, p in rules)))


#: Numbers in words; words for dead, for dead or hurt, and for what a number counts instead (ages and times).
NUMBER_WORDS = {
    "one": 1, "un": 1, "una": 1, "uno": 1, "une": 1, "um": 1, "uma": 1, "two": 2, "deux": 2, "dos": 2, "duas": 2, "dois": 2, "due": 2, "zwei": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12, "dozens": 24, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8,
    "neuf": 9, "dix": 10, "dizaine": 10, "dizaines": 20, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "decena": 10, "decenas": 20, "quatro": 4, "sete": 7, "oito": 8, "dez": 10, "tre": 3, "quattro": 4, "cinque": 5, "drei": 3, "vier": 4, "funf": 5, "sechs": 6, "zehn": 10,
}
DEAD = "dead|killed|die[ds]?|morts?|tues?|muertos?|muertas?|muertes|mueren|murieron|fallecid[oa]s|asesinad[oa]s|mortos?|morrem|morti|tote|olu"
HURT = "dead|killed|die|morts?|tues?|blesses?|muertos?|muertas?|muertes|fallecid[oa]s?|heridos?|heridas?|lesionad[oa]s?|mortos?|feridos?|morti|feriti|tote|verletzte|olu|yarali|people|personnes|personas|pessoas|persone|menschen|victims?|victimes?|victimas?|injured|wounded|casualties"
NOT_COUNTED = r"(?!\s*-?\s*(?:year|yr|ans?\b|anos|ano\b|jahr|yas|month|mois|meses))"
KILLS = r"(?:kill(?:s|ed|ing)?|tue(?:nt)?|mata(?:m|n)?|uccide|totet)\s+(?:at least\s+|au moins\s+|al menos\s+|pelo menos\s+|almeno\s+|mindestens\s+)?(\d{1,5})"
LEAVES = KILLS.replace("uccide|", "uccide|fait|deja|dejan|").replace("totet", "t[öo]tet")
DEATHS = r"(\d{1,5})\s*(?:people\s+|personnes\s+|personas\s+|pessoas\s+|persone\s+|menschen\s+)?(?:dead|killed|die[ds]?|morts?|tués?|muertos|fallecidos|mortos|morti|tote|todesopfer|ölü)"


def _counted(found: Column) -> Column:
    """Numbers of an array of digits and number words; years count as none."""
    words = F.create_map(*(F.lit(v) for kv in NUMBER_WORDS.items() for v in kv))
    number = lambda x: F.coalesce(x.try_cast("int"), F.try_element_at(words, x), F.lit(0))
    return F.transform(found, lambda x: F.when(number(x).between(1900, 2100), 0).otherwise(number(x)))


def casualty_toll(folded: Column | str, dead_only: bool = False) -> Column:
    """The highest toll in a folded text: dead, or dead and hurt added up; digits and number words; 0 without one.

    A number counts if up to three words later a word for victims follows. Ages and years don't count.
    """
    t = col(folded)
    every = lambda p: F.regexp_extract_all(t, F.lit("(?Ui)" + p), F.lit(1))
    victims = _counted(every(r"(?<!\w)(\d{1,4}|" + "|".join(NUMBER_WORDS) + r")(?!\w)" + NOT_COUNTED + r"(?:\W+\w+){0,3}?\W+(?:" + (DEAD if dead_only else HURT) + ")"))
    named = _counted(F.concat(every(r"(?:toll|bilan|saldo|balance)\D{0,25}?(\d{1,4})"), every(KILLS)))
    best = F.coalesce(F.array_max(F.concat(victims, named)), F.lit(0))
    if dead_only:
        return best
    both = t.rlike(r"(?U)(?:muert[oa]s?|killed|dead|mort|tue)\W+(?:\w+\W+){0,2}?(?:herid[oa]s?|lesionad[oa]s?|injured|wounded|blesse)")
    return F.greatest(best, F.aggregate(victims, F.lit(0), lambda a, b: a + b), F.when(both, 2).otherwise(0))


def death_count(title: Column | str) -> Column:
    """The highest number of dead that a title states in digits; null without one."""
    found = F.concat(*(F.regexp_extract_all(col(title), F.lit("(?Ui)" + p), F.lit(1)) for p in (DEATHS, LEAVES)))
    return F.when(col(title).rlike(r"(?U)\d"), F.array_max(F.transform(found, lambda x: x.cast("int"))))


def toll(title: Column | str) -> Column:
    """``casualty_toll`` of a title."""
    return F.coalesce(casualty_toll(fold(title)), F.lit(0))


def title_severity(title: Column | str, base: Column | int = 2) -> Column:
    """The category's base, 3 from ten deaths on, 4 from fifty."""
    n = toll(title)
    return F.when(n >= 50, 4).when(n >= 10, F.greatest(F.lit(3), F.lit(base) if isinstance(base, int) else base)).otherwise(base)


def guess_language(text: Column | str, hints: dict[str, str] = LANGUAGE_HINTS, letters: dict[str, str] = LETTER_HINTS) -> Column:
    """By script first, else by votes: a stop word counts 1, 2 beyond three letters; each of at most two letters of a language counts 2.

    A strict winner with two votes in a text of three words or more; null otherwise. Languages are data: pass more of them as ``hints``.
    """
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 (what f gets is computed once a row, however often it is read)
    hinted = sorted({w for ws in hints.values() for w in ws.split()})
    counted = lambda found, k, n: F.size(F.filter(found, lambda w: w.isin([x for x in hints[k].split() if (len(x) > 3) == (n == 2)]))) * n
    marks = lambda kept, k: F.least(F.lit(2), F.regexp_count(kept, F.lit(f"[{letters[k]}]"))) * 2 if k in letters else F.lit(0)
    ranked = lambda found, kept: F.sort_array(F.array(*(F.struct((counted(found, k, 1) + counted(found, k, 2) + marks(kept, k)).alias("n"), F.lit(k).alias("lang")) for k in hints)), asc=False)
    winner = lambda r: F.when((r[0]["n"] >= 2) & (r[0]["n"] > r[1]["n"]), r[0]["lang"])
    # all passes but these two go over the few words and letters that hints know
    found = lambda words: F.filter(words, lambda w: w.isin(hinted))
    kept = lambda low: F.regexp_replace(low, f"[^{''.join(letters.values())}]+", "") if letters else F.lit("")
    # an empty word can only be the first or the last
    vote = lambda words, low: F.when(F.size(words) - F.size(F.filter(F.array(words[0], F.element_at(words, -1)), lambda w: w == "")) >= 3, once(found(words), lambda f: once(kept(low), lambda m: once(ranked(f, m), winner))))
    voted = once(F.lower(col(text)), lambda low: once(F.split(low, r"[^\p{L}]+"), lambda words: vote(words, low)))
    scripts = [(k, p) for k, p in SCRIPTS]
    arabic, cyrillic = dict(SCRIPTS)["ar"], dict(SCRIPTS)["ru"]
    test = lambda k, p: col(text).rlike(p) & (col(text).rlike(arabic) if k in ("ur", "fa") else col(text).rlike(cyrillic) if k == "uk" else F.lit(True))
    some = col(text).rlike("[" + "".join(p[1:-1] for _, p in scripts) + "]")
    by_script = reduce(lambda w, s: w.when(test(*s), s[0]), scripts[1:], F.when(test(*scripts[0]), scripts[0][0]))
    return F.coalesce(F.when(some, by_script), voted)


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, title: og:title in either attribute order, else <title>, without a site suffix; null outside 15 .. 300 characters."""
    h = F.col("html")
    og = [F.regexp_extract(h, p, 1) for p in (r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", r"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+property=[\"']og:title[\"']", r"(?is)<title[^>]*>([^<]*)</title>")]
    raw = F.coalesce(*(F.when(F.length(x) > 0, x) for x in og))
    text = F.trim(F.regexp_replace(unescape(raw), r"\s+", " "))
    text = F.regexp_replace(text, r"\s[|–—]\s.*$", "")
    return pages.select("page_id", F.when(F.length(text).between(15, 300), text).alias("title"))


def unescape(text: Column) -> Column:
    """The commonest character references; & last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def snippet(html: Column | str, title: Column | str | None = None, most: int = 300) -> Column:
    """Text of an HTML fragment: tags gone, references read, one space, a repeated title removed from the front, cut."""
    t = F.trim(F.regexp_replace(unescape(F.regexp_replace(col(html), r"(?s)<[^>]*>", " ")), r"\s+", " "))
    if title is not None:
        t = F.when(t.startswith(col(title)), F.trim(F.substr(t, F.length(col(title)) + 1))).otherwise(t)
    return F.substring(t, 1, most)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, link: targets of all anchors in page order; relative ones are joined to the page's host."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']+)"), 1)
    x = pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    return x.select("page_id", "pos", F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.concat(base, F.lit("/"), "href")).alias("link"))


def feed_links(pages: DataFrame) -> DataFrame:
    """page_id, link of announced feeds (rel=alternate of a feed type), comment feeds left out."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), 0)
    x = pages.select("page_id", "url", F.explode(tags).alias("tag")).where(F.col("tag").rlike(r"(?i)application/(rss|atom)\+xml") & F.col("tag").rlike("(?i)alternate") & ~F.col("tag").rlike("(?i)comment"))
    href = F.regexp_extract("tag", r"(?i)href=[\"']([^\"']+)", 1)
    return x.select("page_id", F.when(href.rlike("^[a-z]+://"), href).otherwise(F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.when(href.startswith("/"), "").otherwise("/"), href)).alias("link"))


def _in(values: list[str]):
    return lambda w: w.isin(values)


def _grams(n: int) -> Column:
    at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.concat_ws(" ", *(F.get("w", i + k) for k in range(n))).alias("gram")))


def ngrams(titles: DataFrame, most: int = 3, least: int = 1) -> DataFrame:
    """id, pos, n, gram: folded word n-grams of ``least`` to ``most`` words."""
    x = titles.withColumn("w", F.split(fold("title"), r"[^\p{L}\p{N}]+"))
    # an empty word can only be the first or the last
    first = F.when(F.col("w")[0] == "", 1).otherwise(0)
    x = x.withColumn("w", F.slice("w", first + 1, F.greatest(F.lit(0), F.size("w") - first - F.when(F.element_at("w", -1) == "", 1).otherwise(0))))
    grams = [_grams(n) for n in range(least, most + 1)]
    return x.select("id", F.explode(F.concat(*grams) if len(grams) > 1 else grams[0]).alias("g")).select("id", "g.*")


def mentions(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, country, pos of alias mentions in order; of overlapping ones the earliest, then the longest is kept (a fold, as each is held against the last kept)."""
    hit = ngrams(titles).join(aliases.select(F.col("alias").alias("gram"), "country"), "gram")
    m = F.array_sort(F.collect_list(F.struct("pos", F.negative("n").alias("n"), "country")))
    folded = F.aggregate(m, F.array().cast("array<struct<pos:int,n:int,country:string>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["pos"] >= F.element_at(acc, -1)["pos"] - F.element_at(acc, -1)["n"]), F.concat(acc, F.array(x))).otherwise(acc))
    return hit.groupBy("id").agg(m.alias("m")).select("id", F.explode(F.aggregate(F.col("m"), F.array().cast("array<struct<pos:int,n:int,country:string>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["pos"] >= F.element_at(acc, -1)["pos"] - F.element_at(acc, -1)["n"]), F.concat(acc, F.array(x))).otherwise(acc))).alias("k")).select("id", "k.country", "k.pos")


def find_city(titles: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id, place, lat, lon: the most populous city of the title's country that it names, longer names first."""
    x = ngrams(titles).join(titles.select("id", "country"), "id").join(gazetteer.withColumnRenamed("name", "gram"), ["country", "gram"])
    return x.groupBy("id").agg(F.max_by(F.struct("place", "lat", "lon"), F.struct("n", "population", "place")).alias("p")).select("id", "p.*")


def tag_reports(reports: DataFrame, aliases: DataFrame, themes: dict[str, str], most: int = 8) -> DataFrame:
    """id, countries (first ``most`` by place in the text), themes whose pattern the text has."""
    c = mentions(reports, aliases).groupBy("id", "country").agg(F.min("pos").alias("pos"))
    c = c.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "country"))), lambda s: s["country"]), 1, most).alias("countries"))
    t = F.array_compact(F.array(*(F.when(fold("title").rlike(p), k) for k, p in themes.items())))
    return reports.select("id", t.alias("themes")).join(c, "id", "left")


def match_admin(names: DataFrame, units: DataFrame) -> DataFrame:
    """id, unit, tier: exact name, same without spaces, one the start of the other, then similarity of .8; per country, best tier first."""
    u = units.select("country", "unit", fold("unit").alias("un"))
    x = names.select("id", "country", fold("name").alias("nn")).join(u, "country")
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    near = 1 - F.levenshtein("nn", "un") / F.greatest(F.length("nn"), F.length("un"))
    tier = F.when(F.col("nn") == F.col("un"), 1).when(bare("nn") == bare("un"), 2).when(F.col("un").startswith(F.col("nn")) | F.col("nn").startswith(F.col("un")), 3).when(near >= 0.8, 4)
    x = x.withColumn("tier", tier).withColumn("near", near).where("tier IS NOT NULL")
    return x.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("tier", F.desc("near"), "unit"))).where("r = 1").select("id", "unit", "tier")


def search(query: str, **frames: tuple[DataFrame, str, str]) -> DataFrame:
    """kind, key, text over any (frame, key column, text column): accent-folded contains; cities by prefix."""
    q = fold(F.lit(query))
    out = None
    for kind, (df, key, text) in frames.items():
        hit = fold(text).startswith(q) if kind == "city" else fold(text).contains(q)
        part = df.where(hit).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out
