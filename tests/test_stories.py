"""Stories against plain Python over all pairs; groups of more copies than any token limit."""

from __future__ import annotations

import datetime as dt
import math
import random

from cairn.functions.exprs import STORY_STOP
from cairn.operators import duplicates, graph, merging
from pyspark.sql import functions as F
from tests.test_operators import ev, incident

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rin", "lon", "mas")]


def titles(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            w = rnd.choice(out).split()
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            w = w[: rnd.randrange(1, len(w) + 1)] if rnd.random() < 0.2 else w + [rnd.choice(WORDS)] * rnd.randrange(2)
        else:
            w = [rnd.choice(WORDS) for _ in range(rnd.randrange(1, 15))]
        out.append(" ".join(w))
    return out


def tokens(title):
    return list(dict.fromkeys([w for w in title.lower().split() if len(w) >= 3 and w not in STORY_STOP][:14]))


def jac(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


def by_text(x, y):
    return min(len(x), len(y)) >= 4 and jac(x, y) >= 0.8 or min(len(x), len(y)) >= 8 and x[:8] == y[:8]


def components(nodes, linked):
    home = {n: n for n in nodes}

    def root(n):
        while home[n] != n:
            n = home[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                a_, b_ = sorted((root(a), root(b)))
                home[b_] = a_
    return {n: root(n) for n in nodes}


def component_of(links, nodes):
    got = {r.node: r.component for r in graph.connected(links).collect()}
    return {n: got.get(n, n) for n in nodes}


def test_similar_titles_are_all_found(spark):
    texts = titles(150, 1) + [None, "", "the and of"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    toks = {i: tokens(t or "") for i, t in enumerate(texts)}
    got = merging.similar_titles(rows)
    first = {}
    for i, t in toks.items():
        first.setdefault(tuple(t), i)
    lists = sorted(i for t, i in first.items() if len(t) >= 4)
    want = {(a, b) for a in lists for b in lists if a < b and jac(toks[a], toks[b]) >= 0.8}
    assert {(r.a, r.b) for r in got.where("rule = 'jaccard'").collect()} == want and len(want) > 10
    equal = {(first[tuple(t)], i) for i, t in toks.items() if len(t) >= 4 and first[tuple(t)] != i}
    assert {(r.a, r.b) for r in got.where("rule = 'equal'").collect()} == equal and equal
    assert component_of(got, list(toks)) == components(list(toks), lambda a, b: by_text(toks[a], toks[b]))
    assert merging.similar_titles(rows.limit(0)).count() == 0


def test_copies_beyond_any_token_limit_are_linked(spark):
    x = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "storm sinks three boats near northern harbour").otherwise("storm sinks three boats near northern harbour today").alias("title"))
    links = merging.similar_titles(x)
    assert links.count() == 399 and set(component_of(links, range(400)).values()) == {0}


def test_story_links_join_what_all_pairs_join(spark):
    texts = titles(80, 2)
    rnd = random.Random(3)
    # places far apart, so that the rules on text alone decide
    data = [ev(i, rnd.randrange(1, 900), lat=-60.0 + i, lon=0.0, place=f"p{i}", country=f"C{i}") for i in range(len(texts))]
    x = incident(spark, data).join(spark.createDataFrame(list(enumerate(texts)), "id long, title string"), "id")
    at = {r.id: r.date.timestamp() for r in x.select("id", "date").collect()}
    toks = {i: tokens(t) for i, t in enumerate(texts)}
    want = components(list(toks), lambda a, b: abs(at[a] - at[b]) <= 120 * 3600 and by_text(toks[a], toks[b]))
    assert component_of(merging.story_links(x), list(toks)) == want and len(set(want.values())) < len(want)


def plain_near(a, b, km):
    if a["place"].lower() == b["place"].lower() and a["place"]:
        return True
    far = {"country", "region"} & {a["precision"], b["precision"]}
    return None not in (a["lat"], b["lat"]) and haversine((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= (3 * km if far else km)


def haversine(p, q):
    la, lo, lb, ob = map(math.radians, (*p, *q))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def plain_fact(a, b, idf, rare):
    groups = [*merging.COMPATIBLE, (a["category"],)]
    if a["country"] is None or a["country"] != b["country"] or "earthquake" in (a["category"], b["category"]) or not any(a["category"] in g and b["category"] in g for g in groups):
        return False
    places = set(duplicates.GEO_WORDS) | {w for r in (a, b) for w in r["place"].lower().split()}
    hours = abs((a["date"] - b["date"]).total_seconds()) / 3600
    sa, sb = set(a["toks"]), set(b["toks"])
    common = (sa & sb) - places
    if hours <= 36 and common & set(merging.TARGETS) and len(common) >= 2 and plain_near(a, b, 60):
        return True
    if hours > 72 or sum(idf[w] >= rare for w in common) < 2:
        return False
    return sum(idf[w] for w in common) / sum(idf[w] for w in sa | sb) >= 0.3 and plain_near(a, b, 150)


def test_fact_links_join_what_all_pairs_join(spark):
    rnd = random.Random(11)
    vocabulary = ["church", "market", "bridge", "gunmen", "fire", "blast", "north", "karak", "amman", *WORDS]
    rows = []
    for i in range(260):
        w = [rnd.choice(vocabulary[:9] if rnd.random() < 0.5 else vocabulary) for _ in range(rnd.randrange(2, 7))]
        place = rnd.choice(["karak", "Amman", "amman", "", "Zarqa"])
        spot = {"karak": (31.2, 35.7), "amman": (31.95, 35.9), "": (33.0, 36.5), "zarqa": (32.07, 36.1)}[place.lower()]
        spot = spot if rnd.random() < 0.7 else (spot[0] + rnd.uniform(0, 1), spot[1])
        rows.append({"id": i, "title": " ".join(w), "date": dt.datetime(2026, 1, 1) + dt.timedelta(hours=rnd.choice([rnd.randrange(0, 400), 36 * rnd.randrange(0, 10)])), "country": rnd.choice(["JO", "JO", "SY", None]), "category": rnd.choice(["attack", "crime", "flood", "storm", "earthquake", "health"]), "lat": spot[0] if rnd.random() < 0.95 else None, "lon": spot[1], "place": place, "precision": rnd.choice(["city", "city", "region", None])})
    x = spark.createDataFrame(rows, "id long, title string, date timestamp, country string, category string, lat double, lon double, place string, precision string")
    for r in rows:
        r["toks"] = tokens(r["title"])
    df = {}
    for r in rows:
        for w in set(r["toks"]):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((len(rows) + 1) / (n + 0.5)) for w, n in df.items()}
    want = components(range(len(rows)), lambda a, b: plain_fact(rows[a], rows[b], idf, math.log((len(rows) + 1) / 5.5)))
    assert component_of(merging.fact_links(x), range(len(rows))) == want and 20 < len(set(want.values())) < 250


def test_place_words_are_no_evidence(spark):
    at = dt.datetime(2026, 10, 23)
    rows = [(1, "West Bank attack wounds 5 Israelis as Netanyahu cancels events", "PS", "West Bank", 31.9, 35.2, "country", at), (2, "West Bank Olive Harvest Under Attack as Israeli Settlers Target Palestinian Farmers", "PS", "West Bank", 31.9, 35.2, "country", at), (3, "One Killed, Eight Injured in Attack on Saudi Arabia's King Fahd Airport", "SA", "Dammam", 26.47, 49.80, "city", at), (4, "Indian among 2 killed in attack on Dammam airport, 2 other Indians injured", "SA", "Dammam, Ash Sharqiyah", 26.43, 50.10, "city", at - dt.timedelta(hours=13))]
    x = spark.createDataFrame([(*r, "attack") for r in rows], "id long, title string, country string, place string, lat double, lon double, precision string, date timestamp, category string")
    assert {(r.a, r.b) for r in merging.fact_links(x).collect()} == {(3, 4)}


def test_similar_titles_shuffle_token_lists_twice(spark):
    """Long lists with few links: what is exchanged is mostly the lists, once to find the first of each and once for the pairs."""
    rnd = random.Random(9)
    told = [" ".join(rnd.sample(WORDS, 14)) for _ in range(400)]
    told += told[:40] + [" ".join(t.split()[:13]) for t in told[40:80]] + [" ".join([*t.split()[:8], *rnd.sample(WORDS, 4)]) for t in told[80:100]]
    x = spark.createDataFrame(list(enumerate(told)), "id long, title string").repartition(4).localCheckpoint()
    got = merging.similar_titles(x)
    got.collect()
    nodes, lists = [got._jdf.queryExecution().executedPlan()], set()
    while nodes:
        n = nodes.pop()
        kind = n.getClass().getSimpleName()
        if kind in ("AdaptiveSparkPlanExec",):
            nodes.append(n.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(n.plan())
            continue
        if kind in ("ShuffleExchangeExec", "BroadcastExchangeExec") and "array<string>" in n.schema().simpleString():
            lists.add((kind, n.id()) if kind == "ShuffleExchangeExec" and n.metrics().apply("shuffleRecordsWritten").value() >= 300 else (kind, 0))
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    assert not any(k == "BroadcastExchangeExec" for k, _ in lists)
    assert len([i for k, i in lists if i]) <= 1
    assert {r.rule for r in got.collect()} == {"equal", "start", "jaccard"}
