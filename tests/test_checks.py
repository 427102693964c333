"""Each check of the catalogue against one failing fixture."""

from __future__ import annotations

from cairn.operators import checks

NOW = "2026-09-30 12:00:00"
TREND = "scope string, trend_id string, family string, also array<string>, texts array<struct<key:string,fr:string,en:string>>, drivers array<string>, likelihood int, impact_business int, impact_travel int, horizon string, momentum int, confidence string, sectors array<string>, signals array<struct<fr:string,en:string,src:array<string>,d:string>>, watch array<string>, reviewed string, live array<string>, links array<string>"
SOURCE = "id string, t string, pub string, url string, kind string, rel string"
DRIVER = "id string, family string, indicators array<array<string>>"
SCOPE = "scope string, type string, bbox array<double>, countries array<string>, parent string, reviewed string"
SIGNAL = {"fr": "f", "en": "e", "src": ["s1", "s2"], "d": "2026-05"}
GOOD = {
    "trend": {"scope": "sahel", "trend_id": "t1", "family": "security", "also": ["social"], "texts": [{"key": k, "fr": "f", "en": "e"} for k in checks.TEXTS], "drivers": ["d1"], "likelihood": 3, "impact_business": 3, "impact_travel": 2, "horizon": "3m", "momentum": 0, "confidence": "high", "sectors": ["mining"], "signals": [SIGNAL], "watch": ["w"], "reviewed": None, "live": ["attack"], "links": ["t1"]},
    "source": {"id": "s1", "t": "T", "pub": "P1", "url": "https://x", "kind": "report", "rel": "A"}, "driver": {"id": "d1", "family": "security", "indicators": [["s1"], ["s2"]]}, "scope": {"scope": "ML", "type": "country", "bbox": None, "countries": None, "parent": "sahel", "reviewed": None},
}
CASES = {
    **{f"source without {c}": ("source", {c: ""}) for c in ("t", "pub", "url", "kind", "rel")}, "link isn't secure": ("source", {"url": "http://x"}), "unknown grade": ("source", {"rel": "Z"}), "driver of unknown family": ("driver", {"family": "zzz"}), "driver with unknown source": ("driver", {"indicators": [["s9"]]}),
    "unknown type": ("scope", {"type": "planet"}), "region without box": ("scope", {"type": "region", "bbox": [1.0]}), "country not in its region": ("scope", {"scope": "TD"}), "unknown parent region": ("scope", {"parent": "nowhere"}), "country in two regions": ("scope", {"scope": "r2", "type": "region", "bbox": [0.0] * 4, "countries": ["ML"], "parent": None}),
    **{f"text {k} not in both languages": ("trend", {"texts": [{"key": x, "fr": "f", "en": "e" if x != k else " "} for x in checks.TEXTS]}) for k in checks.TEXTS}, "no driver": ("trend", {"drivers": []}), "likelihood off the scale": ("trend", {"likelihood": 6}), "impact on business off the scale": ("trend", {"impact_business": None}), "impact on travel off the scale": ("trend", {"impact_travel": 0}),
    "unknown horizon": ("trend", {"horizon": "soon"}), "momentum off the scale": ("trend", {"momentum": 2}), "unknown confidence": ("trend", {"confidence": None}), "no signal": ("trend", {"signals": []}), "signal not in both languages": ("trend", {"signals": [SIGNAL, SIGNAL | {"en": None}]}), "signal without source": ("trend", {"signals": [SIGNAL, SIGNAL | {"src": []}]}),
    "signal with unreadable date": ("trend", {"signals": [SIGNAL | {"d": "May"}]}), "signal in the future": ("trend", {"signals": [SIGNAL | {"d": "2027"}]}), "no warning indicator": ("trend", {"watch": None}), "no review date": ("trend", {"scope": "late"}), "review in the future": ("trend", {"reviewed": "2026-12-01"}), "too few sources": ("trend", {"signals": [SIGNAL | {"src": ["s1"]}]}),
    "too few publishers": ("trend", {"signals": [SIGNAL | {"src": ["s1", "s3"]}]}), "too many sources of low grade": ("trend", {"signals": [SIGNAL | {"src": ["s1", "s4", "s5"]}]}), "trend id twice": ("trend", {}), "unknown family": ("trend", {"family": None}), "unknown second family": ("trend", {"also": ["zzz"]}), "unknown driver": ("trend", {"drivers": ["d1", "d9"]}), "unknown sector": ("trend", {"sectors": ["zzz"]}),
    "signal with unknown source": ("trend", {"signals": [SIGNAL | {"src": ["s1", "s2", "s9"]}]}), "unknown incident category": ("trend", {"live": ["party"]}), "link to unknown trend": ("trend", {"links": ["t9"]}),
}


def rows_of(kind=None, change=None, mark=""):
    """One set, with ``change`` in one row; ids carry a mark, so that many sets can stand in one table."""
    rows = {k: [dict(v)] for k, v in GOOD.items()}
    rows["source"] += [GOOD["source"] | {"id": i, "pub": p, "rel": r} for i, p, r in (("s2", "P2", "B"), ("s3", "P1", "A"), ("s4", "P3", "D"), ("s5", "P4", "E"))]
    rows["scope"] += [{"scope": "sahel", "type": "region", "bbox": [0.0, 1.0, 2.0, 3.0], "countries": ["ML"], "parent": None, "reviewed": "2026-08-01"}, {"scope": "late", "type": "region", "bbox": [0.0] * 4, "countries": [], "parent": None, "reviewed": None}]
    if kind:
        changed = rows[kind][0] | change
        rows[kind] = rows[kind] + [changed] if not change or change.get("scope") == "r2" else [changed, *rows[kind][1:]]
    own = {"id", "scope", "trend_id", "drivers", "links", "src", "indicators", "parent", "countries"}

    def marked(k, v):
        if isinstance(v, dict):
            return {x: marked(x, y) for x, y in v.items()}
        if isinstance(v, list):
            return [marked(k, x) for x in v]
        return mark + v if k in own and isinstance(v, str) else v

    return {k: [{c: marked(c, v) for c, v in r.items()} for r in rs] for k, rs in rows.items()}


def frames(spark, *sets):
    make = lambda k, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema_fields(schema)) for rows in sets for r in rows[k]], schema)
    known = spark.createDataFrame([("family", "security"), ("family", "social"), ("sector", "mining"), ("grade", "A"), ("grade", "B"), ("grade", "D"), ("grade", "E"), ("category", "attack")], "kind string, id string")
    return make("trend", TREND), make("source", SOURCE), make("driver", DRIVER), make("scope", SCOPE), known


def schema_fields(schema):
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def test_good_set_and_size(spark):
    assert checks.violations(*frames(spark, rows_of()), NOW).count() == 0
    assert len(CASES) >= 40 and sum(map(len, checks.row_checks(NOW).values())) + sum(map(len, checks.REFERENCES.values())) + 1 == len(CASES)


def test_every_check_fails_where_it_should(spark):
    names = list(CASES)
    sets = [rows_of(*CASES[n], mark=f"{i:02d}~") for i, n in enumerate(names)]
    got = {n: set() for n in names}
    for r in checks.violations(*frames(spark, *sets), NOW).collect():
        got[names[int(r.name[:2])]].add(r.check)
    assert not [n for n, found in got.items() if n not in found]
    # what else a fixture breaks follows from it
    follows = {"unknown parent region", "country not in its region", "too few sources", "too few publishers", "unknown grade", "no review date", "trend id twice", "country in two regions", "region without box", "unknown type"}
    assert all(found - {n} <= follows for n, found in got.items()), {n: f - {n} - follows for n, f in got.items() if f - {n} - follows}


def test_details(spark):
    (r,) = checks.violations(*frames(spark, rows_of("trend", {"drivers": ["d1", "d9"]})), NOW).collect()
    assert (r.kind, r.name, r.check, r.detail) == ("trend", "sahel/t1", "unknown driver", "d9")
