"""Distance and containment joins. Cells turn them into equi-joins: a side is put into every cell that it can reach."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import haversine_km, segment_km

#: Kilometres of a degree of latitude, at least.
DEGREE_KM = 111.0


def cell(lat, lon, degrees: float = 1.0):
    return F.struct(F.floor(F.col(lat) / degrees).cast("int").alias("y"), F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / degrees).cast("int").alias("x"))


def reach_cells(lat: str, lon: str, radius_km: str, degrees: float = 1.0):
    """All cells that a circle can touch, across the date line and the poles too."""
    r = F.col(radius_km) / DEGREE_KM
    south, north = F.greatest(F.col(lat) - r, F.lit(-90.0)), F.least(F.col(lat) + r, F.lit(90.0))
    widest = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north)))))
    wide = F.when(widest * 180 <= r, 180.0).otherwise(F.least(F.lit(180.0), F.try_divide(r, widest) * 1.05))
    n = int(360 / degrees)
    ys = F.sequence(F.floor(south / degrees).cast("int"), F.floor(north / degrees).cast("int"))
    x0, x1 = F.floor((F.col(lon) + 180 - wide) / degrees).cast("int"), F.floor((F.col(lon) + 180 + wide) / degrees).cast("int")
    xs = F.array_distinct(F.transform(F.sequence(x0, F.least(x1, x0 + n)), lambda x: F.pmod(x, F.lit(n)).cast("int")))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def within_radius(points: DataFrame, targets: DataFrame, degrees: float = 1.0) -> DataFrame:
    """points(lat, lon, ...) with each target(site_lat, site_lon, radius_km, ...) whose circle they are in, and ``km``."""
    t = targets.withColumn("_cell", F.explode(reach_cells("site_lat", "site_lon", "radius_km", degrees)))
    p = points.withColumn("_cell", cell("lat", "lon", degrees))
    km = haversine_km("lat", "lon", "site_lat", "site_lon")
    return p.join(t, "_cell").withColumn("km", km).where("km <= radius_km").drop("_cell")


def place_pairs(points: DataFrame, targets: DataFrame, degrees: float = 1.0) -> DataFrame:
    """lat, lon, site_lat, site_lon, radius_km, km: ``within_radius`` between the different positions and circles only, however many rows are at each."""
    return within_radius(points.select("lat", "lon").distinct(), targets.select("site_lat", "site_lon", "radius_km").distinct(), degrees)


#: Rows of a bunch.
BUNCH = 1000


def bunched(rows: DataFrame, keys: list[str], order: str, most: int = BUNCH) -> DataFrame:
    """A row per ``keys`` and ``_n`` (0, 1, ...): ``rows`` are structs of the other columns, at most ``most`` in a row, so that what the keys decide is decided once for them."""
    rest = [c for c in rows.columns if c not in keys]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", F.floor((n - 1) / most)).groupBy(*keys, "_n").agg(F.collect_list(F.struct(*rest)).alias("rows"))


#: What names a circle.
CIRCLE = ["site_lat", "site_lon", "radius_km"]


def site_alerts(incidents: DataFrame, sites: DataFrame) -> DataFrame:
    """Incidents within a site's radius at its severity or above; low confidence is left out.

    Distances are taken between positions; the rows, which are as many as the result needs, come by plain equality and aren't shuffled."""
    x = incidents.where("confidence <> 'low'").select("id", "lat", "lon", "severity")
    near = place_pairs(x, sites).withColumn("km", F.round("km", 3)).join(sites.select(*CIRCLE, "site", "min_severity"), CIRCLE).select("lat", "lon", "site", "min_severity", "km")
    return x.join(near, ["lat", "lon"]).where("severity >= min_severity").select("id", "site", "severity", "km")


def nearest_site(incidents: DataFrame, sites: DataFrame) -> DataFrame:
    """Of the sites that have an incident in their radius, the nearest; found once for a position."""
    named = sites.groupBy(*CIRCLE).agg(F.min("site").alias("site"))
    near = place_pairs(incidents, sites).join(named, CIRCLE).withColumn("at", F.struct(F.round("km", 6).alias("km6"), "site"))
    best = near.groupBy("lat", "lon").agg(F.min("at").alias("at"), F.min("km").alias("km"))
    x = incidents.select("id", "lat", "lon").join(best, ["lat", "lon"])
    return x.groupBy("id").agg(F.min("at").alias("at"), F.min("km").alias("km")).select("id", "at.site", F.round("km", 3).alias("km"))


def corridor_alerts(incidents: DataFrame, segments: DataFrame) -> DataFrame:
    """Least distance of incidents to corridors(name, a_lat, a_lon, b_lat, b_lon, buffer_km) within the buffer.

    A segment is put into the cells of points along it, no further apart than half its buffer. Distances are taken between different positions and segments, and the
    least of a name once for all incidents that were seen at the same positions. Names and distances of such positions are bunched: an incident meets bunches,
    and the result's rows are unfolded from them, neither joined nor shuffled one by one."""
    line = ["a_lat", "a_lon", "b_lat", "b_lon", "buffer_km"]
    x = incidents.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon")))).alias("at")).where("size(at) > 0")
    spots = x.select("at").distinct().select("at", F.explode("at").alias("p")).select("at", "p.lat", "p.lon", cell("p.lat", "p.lon").alias("_cell"))
    length = haversine_km("a_lat", "a_lon", "b_lat", "b_lon")
    steps = F.greatest(F.lit(1), F.ceil(length / (F.col("buffer_km") / 2))).cast("int")
    at = segments.select(*line).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), steps))).withColumn("_f", F.col("_i") / steps)
    at = at.withColumn("site_lat", F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("_f")).withColumn("site_lon", F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("_f")).withColumn("radius_km", F.col("buffer_km") * 1.5)
    cells = at.withColumn("_cell", F.explode(reach_cells("site_lat", "site_lon", "radius_km"))).select(*line, "_cell").distinct()
    near = spots.join(cells, "_cell").withColumn("km", segment_km("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")).where("km <= buffer_km").groupBy("at", *line).agg(F.min("km").alias("km"))
    least = near.join(segments.select("name", *line), line).groupBy("at", "name").agg(F.round(F.min("km"), 3).alias("km"))
    named = [F.xxhash64("at").alias("h"), F.xxhash64(F.lit(1), "at").alias("g")]  # 128 bits stand for the positions: arrays are dear to sort by
    return x.select("id", *named).join(bunched(least.select(*named, "name", "km"), ["h", "g"], "name").hint("merge"), ["h", "g"]).select("id", F.explode("rows").alias("r")).select("id", "r.name", "r.km")


def edges(polygons: DataFrame) -> DataFrame:
    """unit, ax, ay, bx, by per edge of unit(unit, iso, rings array<array<struct<x,y>>>); rings need not be closed."""
    ring = polygons.select("unit", F.explode("rings").alias("r"))
    closed = F.arrays_zip(F.col("r").alias("p"), F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)).alias("q"))
    return ring.select("unit", F.explode(closed).alias("e")).select("unit", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))


def locate(points: DataFrame, polygons: DataFrame, key: str | None = None) -> DataFrame:
    """id, unit: the polygon (even-odd rule, so rings inside are holes) that holds a point; the least unit of several.

    Points meet the polygons of their 1-degree cell, and of their ``key`` if one is given; crossings are counted over the edges."""
    flat = polygons.withColumn("_all", F.flatten("rings"))
    box = {f: F.floor(g(F.col("_all")[c])).cast("int") for f, g, c in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))}
    own = ["unit"] + ([key] if key else [])
    cells = flat.select(*own, F.explode(F.sequence(box["x0"], box["x1"])).alias("cx"), *(v.alias(k) for k, v in box.items() if k[0] == "y")).select(*own, "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    p = points.select("id", "lat", "lon", *([key] if key else []), F.floor("lon").cast("int").alias("cx"), F.floor("lat").cast("int").alias("cy"))
    near = p.join(cells, ["cx", "cy"] + ([key] if key else [])).select("id", "lat", "lon", "unit")
    e = near.join(edges(polygons), "unit")
    crosses = ((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))) & (F.col("lon") < F.col("ax") + F.try_divide((F.col("lat") - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("by") - F.col("ay")))
    inside = e.groupBy("id", "unit").agg(F.count_if(crosses).alias("n")).where("n % 2 = 1")
    return inside.groupBy("id").agg(F.min("unit").alias("unit"))


def locate_nudged(points: DataFrame, polygons: DataFrame, most: float = 0.25) -> DataFrame:
    """``locate``, and for points outside everything sixteen probes around them, the nearest ring of probes first."""
    probes = [(0.0, 0.0)] + [(round(d * y, 4), round(d * x, 4)) for d in (most / 2, most) for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y]
    p = points.select(F.col("id").alias("_id"), "lat", "lon", F.posexplode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in probes))).alias("rank", "d"))
    p = p.select(F.struct("_id", "rank").alias("id"), (F.col("lat") + F.col("d.dy")).alias("lat"), (F.col("lon") + F.col("d.dx")).alias("lon"))
    return locate(p, polygons).select("id._id", "id.rank", "unit").groupBy(F.col("_id").alias("id")).agg(F.min_by("unit", "rank").alias("unit"), F.min("rank").alias("probe"))


def ring_measures(polygons: DataFrame) -> DataFrame:
    """unit, area (absolute, of the first ring), centroid and bounding box."""
    r = polygons.select("unit", F.col("rings")[0].alias("r"))
    nxt = F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1))
    pairs = r.withColumn("z", F.arrays_zip(F.col("r").alias("p"), nxt.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    add = lambda f: F.aggregate("z", F.lit(0.0), lambda s, e: s + f(e))
    x = pairs.withColumn("a2", add(cross)).withColumn("cx", add(lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e))).withColumn("cy", add(lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e)))
    ends = lambda g, c: g(F.col("r")[c])
    return x.select("unit", F.abs(F.col("a2") / 2).alias("area"), F.try_divide("cx", 3 * F.col("a2")).alias("lon"), F.try_divide("cy", 3 * F.col("a2")).alias("lat"), ends(F.array_min, "x").alias("x0"), ends(F.array_min, "y").alias("y0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"))


def city_activity(incidents: DataFrame, cities: DataFrame, now: str) -> DataFrame:
    """Incidents around each city (site columns plus city, country): counts of 90 and 30 days, severe ones, and the share of the country's.

    Incidents are counted by position first, positions by circle, and circles by city."""
    fresh = F.col("date") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 30 DAY")
    counts = ("n90", "n30", "severe", "points")
    at = incidents.groupBy("lat", "lon").agg(F.count("*").alias("n90"), F.count_if(fresh).alias("n30"), F.count_if(F.col("severity") >= 3).alias("severe"), F.sum(F.col("severity").cast("long")).alias("points"))
    around = within_radius(at, cities.select(*CIRCLE).distinct()).groupBy(*CIRCLE).agg(*(F.sum(c).alias(c) for c in counts))
    per = cities.select("country", "city", *CIRCLE).join(around, CIRCLE).groupBy("country", "city").agg(*(F.sum(c).alias(c) for c in counts))
    return per.withColumn("share", F.round(F.col("n90") / F.sum("n90").over(Window.partitionBy("country")), 3)).withColumn("level", F.when(F.col("points") >= 200, 4).when(F.col("points") >= 80, 3).when(F.col("points") >= 20, 2).otherwise(1))


def nearest_in_country(cities: DataFrame, airports: DataFrame, most_km: float = 80) -> DataFrame:
    """city, airport, km: the nearest airport of the same country within a distance.

    Different positions of cities meet different positions of airports in the cells that the distance reaches."""
    there = next(n for n in (1.0, 2.0, 5.0, 10.0, 30.0, 360.0) if n * DEGREE_KM >= most_km or n == 360.0)
    spot = ["country", "site_lat", "site_lon"]
    a = airports.groupBy("country", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).agg(F.min("airport").alias("airport")).withColumn("_cell", cell("a_lat", "a_lon", there))
    c = cities.select(*spot).distinct().withColumn("_km", F.lit(float(most_km))).withColumn("_cell", F.explode(reach_cells("site_lat", "site_lon", "_km", there)))
    x = c.join(a, ["country", "_cell"]).withColumn("km", haversine_km("site_lat", "site_lon", "a_lat", "a_lon")).where(F.col("km") <= most_km)
    best = x.groupBy(*spot).agg(F.min(F.struct(F.round("km", 6).alias("km6"), "airport")).alias("at"), F.min("km").alias("km"))
    y = cities.select("city", *spot).join(best, spot).groupBy("country", "city").agg(F.min("at").alias("at"), F.min("km").alias("km"))
    return y.select("country", "city", "at.airport", F.round("km", 3).alias("km"))


def unit_region(units: DataFrame, regions: DataFrame, slack: float = 8.0) -> DataFrame:
    """unit, region_id: the country's region unless the centroid is over ``slack`` degrees outside its box, else the first region whose box holds it."""
    home = regions.select(F.explode("countries").alias("country"), F.col("region_id").alias("home"), F.struct("x0", "y0", "x1", "y1").alias("h"))
    far = (F.col("lon") < F.col("h.x0") - slack) | (F.col("lon") > F.col("h.x1") + slack) | (F.col("lat") < F.col("h.y0") - slack) | (F.col("lat") > F.col("h.y1") + slack)
    u = units.join(home, "country", "left").withColumn("far", F.coalesce(far, F.lit(True)))
    boxes = regions.select("region_id", "rank", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    other = u.where("far").join(boxes, F.col("lon").between(F.col("bx0"), F.col("bx1")) & F.col("lat").between(F.col("by0"), F.col("by1"))).groupBy("unit").agg(F.min_by("region_id", "rank").alias("other"))
    return u.join(other, "unit", "left").select("unit", F.when(~F.col("far"), F.col("home")).otherwise(F.coalesce("other", "home")).alias("region_id"))


def tagged_aircraft(aircraft: DataFrame, zones: DataFrame) -> DataFrame:
    """Emergency kind by squawk, and the zone that a position is in."""
    kind = F.when(F.col("squawk") == "7500", "hijack").when(F.col("squawk") == "7600", "radio").when(F.col("squawk") == "7700", "emergency")
    zone = within_radius(aircraft.select("hex", "lat", "lon"), zones).groupBy("hex").agg(F.min_by("site", "km").alias("zone"))
    return aircraft.withColumn("alert", kind).join(zone, "hex", "left").where("alert IS NOT NULL OR zone IS NOT NULL OR mil")


def inner_points(polygons: DataFrame) -> DataFrame:
    """unit, lon, lat: a point inside each polygon (even-odd over all its rings).

    The centroid of the largest ring, if it is inside; else the middle of the widest chord that the line of its latitude has in the polygon, so
    bent shapes and holes get a point that they hold. Rings without area give the mean of their points."""
    shut = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    sides = lambda r: F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("q"))
    total = lambda zs, f: F.aggregate(zs, F.lit(0.0), lambda s, e: s + f(e))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    x = polygons.select("unit", F.filter(F.transform("rings", shut), lambda r: F.size(r) > 0).alias("rings")).where(F.size("rings") > 0)
    x = x.withColumn("all", F.flatten(F.transform("rings", sides)))
    x = x.withColumn("big", F.element_at(F.array_sort(F.transform("rings", lambda r: F.struct((-F.abs(total(sides(r), cross))).alias("a"), r.alias("r")))), 1)["r"])
    z, a = sides(F.col("big")), total(sides(F.col("big")), cross) / 2
    mean = lambda c: total(z, lambda e: e["p"][c]) / F.size("big")
    middle = lambda c: F.when(F.abs(a) < 1e-9, mean(c)).otherwise(total(z, lambda e: (e["p"][c] + e["q"][c]) * cross(e)) / (6 * a))
    x = x.withColumn("cx", middle("x")).withColumn("cy", middle("y"))
    cuts = F.array_sort(F.transform(F.filter("all", lambda e: (e["p"]["y"] > F.col("cy")) != (e["q"]["y"] > F.col("cy"))), lambda e: e["p"]["x"] + (F.col("cy") - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"])))
    x = x.withColumn("cuts", cuts)
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("cuts") - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size("cuts"))), lambda i: F.struct((F.get("cuts", i) - F.get("cuts", i + 1)).alias("w"), F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))
    x = x.withColumn("spans", spans)
    inside = F.exists("spans", lambda s: (s["a"] < F.col("cx")) & (F.col("cx") < s["b"]))
    widest = F.array_min("spans")
    return x.select("unit", F.when(inside | (F.size("spans") == 0), F.col("cx")).otherwise((widest["a"] + widest["b"]) / 2).alias("lon"), F.col("cy").alias("lat"))


def kept_points(arc: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """An arc without the points that lie within ``tolerance`` of it; its ends and its farthest point always stay. Either direction keeps the same points."""
    if len(arc) < 3:
        return arc
    turned = arc[0] > arc[-1] or (arc[0] == arc[-1] and arc[1] > arc[-2])
    line = arc[::-1] if turned else arc
    keep, todo, first = {0, len(line) - 1}, [(0, len(line) - 1)], True
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = line[i], line[j]
        dx, dy = bx - ax, by - ay
        norm = math.hypot(dx, dy)
        far = [abs(dy * (x - ax) - dx * (y - ay)) / norm if norm else math.hypot(x - ax, y - ay) for x, y in line[i + 1 : j]]
        if far and (max(far) > tolerance or first):
            k = i + 1 + far.index(max(far))
            keep.add(k)
            todo += [(i, k), (k, j)]
            # a closed arc keeps the farthest point of each half too, so that it stays a ring
            if first and line[0] == line[-1]:
                for p, q in ((0, k), (k, len(line) - 1)):
                    if q - p > 1:
                        (ax, ay), (bx, by) = line[p], line[q]
                        keep.add(max(range(p + 1, q), key=lambda n: (abs((by - ay) * (line[n][0] - ax) - (bx - ax) * (line[n][1] - ay)), -n)))
        first = False
    out = [line[k] for k in sorted(keep)]
    return out[::-1] if turned else out


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """``polygons(unit, rings)`` with fewer points: none that is dropped lies further than ``tolerance`` from the new border, and neighbours still share theirs.

    Rings are cut where more than two borders meet; what is between two such points is one arc for all polygons that share it, and an arc keeps the same points
    in either direction. A ring without such a point is one closed arc from its least point. Work is by ring; points meet by their coordinates."""
    ring = polygons.select("unit", F.posexplode("rings").alias("ring", "r"))
    ring = ring.withColumn("r", F.when(F.element_at("r", 1) == F.element_at("r", -1), F.slice("r", 1, F.size("r") - 1)).otherwise(F.col("r"))).where(F.size("r") > 0)
    spot = ring.select("unit", "ring", F.posexplode("r").alias("at", "p"), F.size("r").alias("n"), "r")
    spot = spot.select("unit", "ring", "at", "p", F.array(F.get("r", F.pmod(F.col("at") - 1, "n")), F.get("r", F.pmod(F.col("at") + 1, "n"))).alias("next"))
    meets = spot.groupBy("p").agg((F.size(F.array_distinct(F.flatten(F.collect_set("next")))) > 2).alias("meets"))
    rings = spot.join(meets, "p").groupBy("unit", "ring").agg(F.array_sort(F.collect_list(F.struct("at", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "meets"))).alias("r"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf["r"]:
                points = [(p["x"], p["y"]) for p in r]
                ends = [k for k, p in enumerate(r) if p["meets"]] or [points.index(min(points))]
                made = []
                for k, i in enumerate(ends):
                    j = ends[(k + 1) % len(ends)]
                    arc = points[i : j + 1] if j > i else points[i:] + points[: j + 1]
                    made += kept_points(arc, tolerance)[:-1]
                out.append([{"x": x, "y": y} for x, y in made])
            yield pdf[["unit", "ring"]].assign(r=out)

    unit = polygons.schema["unit"].dataType.simpleString()
    made = rings.mapInPandas(run, f"unit {unit}, ring int, r array<struct<x:double,y:double>>")
    return made.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ring", "r"))).alias("s")).select("unit", F.transform("s", lambda s: s["r"]).alias("rings"))
