from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cairn.operators import scoring


def test_scored(spark):
    day = lambda d: dt.datetime(2026, 9, d)
    t = spark.createDataFrame([(1, "Bomb explosion in market", day(1)), (2, "BOMB explosion in market", day(2)), (3, "Flood hits town", day(3)), (4, "Protest downtown", day(1)), (5, "Nice weather", day(9))], "id long, title string, date timestamp")
    none = spark.createDataFrame([], "key long, score double")
    got = {r.id: r for r in scoring.scored(t, none, lambda xs: [float(len(x)) for x in xs], 2).collect()}
    assert got[1].score == got[2].score == 24.0 and got[3].score == 15.0 and got[4].score is None and got[5].score is None
    cache = spark.createDataFrame([(got[3].key, 0.5)], "key long, score double")
    again = {r.id: r.score for r in scoring.scored(t, cache, lambda xs: [1.0] * len(xs), 9).collect()}
    assert again == {1: 1.0, 2: 1.0, 3: 0.5, 4: 1.0, 5: None}


def test_budget_and_rotation(spark):
    assert scoring.daily_budget(300, 0, 1) == 10 and scoring.daily_budget(300, 400, 3) == 0
    o = spark.range(5).select(F.concat(F.lit("o"), "id").alias("outlet"))
    assert sorted(r.outlet for r in scoring.ranked_feeds(o, 4, 2).collect()) == ["o0", "o4"]
