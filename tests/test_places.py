"""Countries and cities of headlines."""

from __future__ import annotations

import random

from cairn.operators import places
from pyspark.sql import functions as F

ALIASES = [("Russia", "RU"), ("Ukraine", "UA"), ("South Sudan", "SS"), ("Sudan", "SD"), ("Saudi Arabia", "SA"), ("الأردن", "JO"), ("以色列", "IL"), ("ישראל", "IL"), ("United States", "US"), ("Israel", "IL"), ("Mali", "ML"), ("Côte d'Ivoire", "CI")]
CITIES = [("UA", "kyiv", "Kyiv", 50.45, 30.52, 2_900_000, True), ("US", "paris", "Paris", 33.66, -95.55, 25_000, False), ("FR", "paris", "Paris", 48.85, 2.35, 2_100_000, True), ("SA", "riyadh", "Riyadh", 24.7, 46.7, 7_600_000, True), ("IN", "hyderabad", "Hyderabad", 17.4, 78.5, 6_800_000, False), ("ML", "gao", "Gao", 16.2, 0.0, 86_000, False), ("ML", "bamako", "Bamako", 12.6, -8.0, 2_400_000, True), ("JP", "tokyo", "Tokyo", 35.7, 139.7, 13_000_000, True), ("FR", "nice", "Nice", 43.7, 7.2, 340_000, False), ("US", "monterey", "Monterey", 36.6, -121.9, 300_000, False)]


def test_mentions():
    c = places.Countries(dict(ALIASES))
    say = lambda t: [(m["country"], m["actor"], m["quoted"]) for m in c.mentions(places.fold_one(t))]
    assert say("Russia hits central Kyiv, Ukraine") == [("RU", True, False), ("UA", False, False)]
    assert say("South Sudan and Sudan") == [("SS", False, False), ("SD", False, False)]
    assert say('Minister: “Mali is safe” after Israel\'s forces strike') == [("ML", False, True), ("IL", True, False)]
    assert say("انفجار والأردن") == [("JO", False, False)] and say("פיגוע בישראל") == [("IL", False, False)] and say("以色列外长") == [("IL", False, False)]
    assert say("Cote d'Ivoire") == [("CI", False, False)] and say("") == [] and places.Countries({}).mentions("mali") == []


def test_mentions_equal_all_ngrams():
    names = {"a b": "1", "b": "2", "b c d": "3", "d": "4", "a": "5", "c d": "6"}
    c, rng = places.Countries(names), random.Random(3)
    for _ in range(2000):
        words = [rng.choice("abcde") for _ in range(rng.randrange(9))]
        want, i = [], 0
        # at each word the longest name; a name that begins inside one that was taken is left out
        taken = -1
        for i in range(len(words)):
            hit = max((n for n in range(1, 4) if " ".join(words[i : i + n]) in names and i + n <= len(words)), default=0)
            if hit and i > taken:
                want.append(names[" ".join(words[i : i + hit])])
                taken = i + hit - 1
        assert [m["country"] for m in c.mentions(" ".join(words))] == want


CASES = [
    ("Russia hits central Kyiv", None, ("UA", "Kyiv", "city")), ("Terror investigation after shooting near Paris", "US", ("FR", "Paris", "city")), ("Hyderabad man killed in Riyadh airport attack", "IN", ("IN", "Hyderabad", "city")), ("Blast in Gao, Mali", "FR", ("ML", "Gao", "city")),
    ("Fire in Tokyo", None, ("JP", "Tokyo", "city")), ("Tokyo says talks go on", None, (None, None, None)), ("Riot in Gao", "ML", ("ML", "Gao", "city")), ("Have a nice day", "FR", ("FR", None, "country")), ("Shooting in Monterey Park", "US", ("US", None, "country")), ("Bamako warns of attacks", "ML", ("ML", None, "country")), ("No place", None, (None, None, None)), (None, "ML", ("ML", None, "country")), ("Protest in Bamako", "ML", ("ML", "Bamako", "city")), ("Strikes reported in Kyiv as Russia talks", None, ("UA", "Kyiv", "city")),
]


def test_location(spark):
    t = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "id long, title string, hint string")
    a = spark.createDataFrame(ALIASES, "alias string, country string")
    g = spark.createDataFrame(CITIES, "country string, name string, place string, lat double, lon double, population long, capital boolean")
    got = {r.id: (r.country, r.place, r.precision) for r in places.locate_titles(t, a, g).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == [(c[0], c[2]) for c in CASES]
    natural = places.locate_titles(t.where("id = 9").withColumn("title", F.lit("Bamako floods")).withColumn("natural", F.lit(True)), a, g).first()
    assert (natural.place, natural.precision) == ("Bamako", "city")
    assert places.locate_titles(t.limit(0), a, g).count() == 0
