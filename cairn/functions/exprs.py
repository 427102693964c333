"""Scalar rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.folding import table_fold

EARTH_KM = 6371.0
#: Fixed values of the risk model: points by severity, weights by confidence, factor of machine-coded rows, saturation, thresholds.
SEVERITY_POINTS = {1: 1, 2: 3, 3: 8, 4: 20}
CONFIDENCE_WEIGHTS = {"low": 0.3, "medium": 0.6, "high": 1.0}
AUTO_WEIGHT = 0.5
SATURATION = 150
THRESHOLDS = (0.15, 0.35, 0.55, 0.75)
RISK_WEIGHTS = {"advisories": 0.6, "security": 0.3, "hazards": 0.1}
SECURITY_GROUPS = ("security", "political")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ladder(value: Column | str, steps: list[tuple[float, int]], default) -> Column:
    """The result of the first step whose bound the value reaches; steps go from high to low."""
    return reduce(lambda w, s: w.when(col(value) >= s[0], s[1]), steps[1:], F.when(col(value) >= steps[0][0], steps[0][1])).otherwise(default)


def lookup(key: Column | str, values: dict, default) -> Column:
    """A small fixed map as a when chain; unknown and null keys give the default."""
    items = list(values.items())
    return reduce(lambda w, kv: w.when(col(key) == kv[0], kv[1]), items[1:], F.when(col(key) == items[0][0], items[0][1])).otherwise(default)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def segment_km(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Distance from a point to a segment on the plane tangent at the point; the foot is clamped to the segment."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(col, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    k = F.cos(F.radians(lat))
    ax, ay, bx, by = (a_lon - lon) * k, a_lat - lat, (b_lon - lon) * k, b_lat - lat
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * dx + ay * dy), length))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)) * F.radians(F.lit(1.0)) * EARTH_KM


def event_weight(severity="severity", confidence="confidence", is_auto="is_auto") -> Column:
    """Points of the severity, times the confidence, halved for machine-coded rows."""
    return lookup(severity, SEVERITY_POINTS, 1) * lookup(F.coalesce(col(confidence), F.lit("high")), CONFIDENCE_WEIGHTS, 1.0) * F.when(col(is_auto), AUTO_WEIGHT).otherwise(1.0)


def activity(points: Column | str, saturation: float = SATURATION) -> Column:
    """Log-saturated 0 .. 1."""
    p = F.coalesce(col(points), F.lit(0.0))
    return F.least(F.lit(1.0), F.log1p(p) / F.log1p(F.lit(float(saturation))))


def level_of(score: Column | str, thresholds=THRESHOLDS) -> Column:
    """1 plus the number of thresholds reached."""
    return F.lit(1) + sum((col(score) >= t).cast("int") for t in thresholds)


def severity_of_deaths(deaths, steps=((25, 4), (5, 3), (1, 2))) -> Column:
    return ladder(deaths, list(steps), 1)


def month_of(ts) -> Column:
    return F.trunc(col(ts).cast("date"), "month")


def month_index(date) -> Column:
    return F.year(date) * 12 + F.month(date)


def fold(text: Column | str) -> Column:
    """Lower case without accents, in the JVM; ``folding.exact_fold`` also reads what folds to several characters."""
    return table_fold(text)


#: Words that are no evidence of a story.
STORY_STOP = (
    "the and for with from after amid over into near this that than are was were has have its their "
    "dans pour avec apres contre des les une sur par aux est ont qui que del las los por con tras para "
    "una uno que sus der die das und mit von den dem nach bei des della delle degli per con nel dai "
    "says said say dit selon segun news live direct video photos"
).split()


def story_tokens(text: Column | str, most: int = 14, stop: list[str] = STORY_STOP) -> Column:
    """The first distinct words of three letters or more that aren't among ``stop``."""
    words = F.split(fold(text), "[^a-z]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    return F.array_distinct(F.slice(kept, F.lit(1), F.lit(most)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def domain(url: Column | str) -> Column:
    """The host of a URL without www, m, amp or edition in front."""
    host = F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^(www|m|amp|edition)\.", "")


def _number(found: Column) -> Column:
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def magnitude(text: Column | str) -> Column:
    """The first number from 1 on that follows M, mag or magnitude, if any."""
    return _number(F.nullif(F.regexp_extract(col(text), r"(?i)\b(?:m|mag(?:nitude)?)\s*([1-9](?:\.\d)?)\b", 1), F.lit("")))


#: How headlines write a magnitude, before and after the number.
QUAKE_WORDS = "magnitud[eo]?|magnitudo|mag|mw|ml|m|sismo|seisme|earthquake|quake|terremoto|temblor|deprem"


def magnitudes(folded: Column | str) -> Column:
    """All magnitudes of a folded text, as numbers."""
    t = col(folded)
    ways = (r"(\d[.,]\d)\s*(?:m|sr|richter|bal)(?!\w)", rf"(?<!\w)(?:{QUAKE_WORDS})\.?\s*(?:de\s*|of\s*|:\s*)?(\d(?:[.,]\d)?)(?!\d)", r"(?<![\d.,])(\d(?:[.,]\d)?)\s*(?:de\s+|-)?(?:magnitud[eo]?|richter)")
    return F.transform(F.concat(*(F.regexp_extract_all(t, F.lit("(?U)" + w), F.lit(1)) for w in ways)), _number)


def score_grid(likelihood, impacts) -> Column:
    """Likelihood times the highest impact."""
    return col(likelihood) * (F.greatest(*map(col, impacts)) if len(impacts) > 1 else col(impacts[0]))


def review_due(horizon, reviewed, now) -> Column:
    """Days since the review exceed what the horizon allows: 30, 60 or 120 days."""
    return F.datediff(F.lit(now).cast("date"), col(reviewed)) > lookup(horizon, {"short": 30, "medium": 60, "long": 120}, 60)


def hijri_day_number(year, month, day) -> Column:
    """Julian day number of an arithmetic Hijri date (epoch 1,948,440; leap years by the 30-year rule)."""
    y, m, d = map(col, (year, month, day))
    return d + F.ceil((m - 1) * 29.5) + (y - 1) * 354 + F.floor((3 + 11 * y) / 30) + F.lit(1948439)


def hijri_to_date(year, month, day) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (hijri_day_number(year, month, day) - 2440588).cast("int"))
