from datetime import datetime, timedelta, timezone

import numpy as np

from skeinlake.operators.instants import fit_mixture, normalise

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def ms(*parts, offset=0, extra=0):
    return (datetime(*parts, tzinfo=timezone.utc) - EPOCH) // timedelta(milliseconds=1) - offset * 60_000 + extra


CASES = [
    ("2024-02-29 14:40:46 Asia/Tokyo", "Europe/Berlin", ms(2024, 2, 29, 14, 40, 46, offset=540)),
    ("2014:12:15 22:41:05", "America/New_York", ms(2014, 12, 15, 22, 41, 5, offset=-300)),
    ("2020:06:15 12:43:25.96+10:00", None, ms(2020, 6, 15, 12, 43, 25, offset=600, extra=960)),
    ("2015-09-03T21:02:13.112933315Z", None, ms(2015, 9, 3, 21, 2, 13, extra=112)),
    ("  2019-12-06t12:28:51z ", "Asia/Tokyo", ms(2019, 12, 6, 12, 28, 51)),
    ("2022-02-18T13:06-03:30", None, ms(2022, 2, 18, 13, 6, offset=-210)),
    ("2014-06-13 22:59:05 −04:00", None, ms(2014, 6, 13, 22, 59, 5, offset=-240)),
    ("2021-09-15 12:53:29 UTC+02:00", None, ms(2021, 9, 15, 12, 53, 29, offset=120)),
    ("2017-08-03T12:07:35+01:00[Europe/Lisbon]", None, ms(2017, 8, 3, 12, 7, 35, offset=60)),
    ("13.02.2021 06:50:08", None, ms(2021, 2, 13, 6, 50, 8)),
    ("Wed, 24 Aug 2020 16:07:58 +0545", None, ms(2020, 8, 24, 16, 7, 58, offset=345)),
    ("Jul 14, 2024 5:42:52 AM", None, ms(2024, 7, 14, 5, 42, 52)),
    ("Jul 14, 2024 12:00:01 pm", None, ms(2024, 7, 14, 12, 0, 1)),
    ("20241125T093833Z", "Asia/Tokyo", ms(2024, 11, 25, 9, 38, 33)),
    ("20151024192916", "Europe/Berlin", ms(2015, 10, 24, 19, 29, 16, offset=120)),
    ("1571988506", "Asia/Tokyo", 1571988506000),
    ("1504652601103.6601", None, 1504652601103),
    ("1679793797439698", None, 1679793797439),
    # Twice: the first occurrence. Never: the offset before the jump.
    ("2015-11-01 01:30:00", "America/New_York", ms(2015, 11, 1, 1, 30, offset=-240)),
    ("2021-03-14 02:30:00", "America/New_York", ms(2021, 3, 14, 2, 30, offset=-300)),
    ("2017-09-28 18:36:11 America/Los_Angeles", None, ms(2017, 9, 28, 18, 36, 11, offset=-420)),
    *[(x, None, None) for x in ("2021-02-30T10:00:00Z", "2018-04-05T25:10:00Z", "0000:00:00 00:00:00", "n/a", "", "   ", None, "25:61", "2020-01-01", "x" * 100_000, "2020-01-01 00:00:00 Nowhere/City", "99999999999999999999")],
    ("2020-01-01 00:00:00", "Not/AZone", None),
]


def test_cases(spark):
    schema = "n int, takenAt string, tz string, source string, status string, _row string, readings int"
    rows = spark.createDataFrame([(i, v, z, "s", "own", "r", 1) for i, (v, z, _) in enumerate(CASES)], schema)
    got = {r["n"]: r for r in normalise(rows, "takenAt", "tz", "source").collect()}
    assert len(got) == len(CASES)
    for i, (value, zone, want) in enumerate(CASES):
        assert got[i]["instantMs"] == want, (value, zone)
        assert got[i]["status"] == ("single" if want is not None else "none")
        assert got[i]["_row"] == "r" and got[i]["readings"] == 1


def test_mixture_settles_or_marks_ambiguity(spark):
    clear = [("us", f"{m:02d}/{d:02d}/2020 10:00:00") for m, d in [(1, 25), (3, 30), (5, 17), (7, 28), (9, 19)] * 4]
    rows = [*clear, ("us", "02/03/2020 10:00:00"), ("alone", "02/03/2020 10:00:00"), (None, "02/03/2020 10:00:00")]
    df = spark.createDataFrame([(s, v, None) for s, v in rows], "source string, v string, tz string")
    got = {(r["source"], r["v"]): r for r in normalise(df, "v", "tz", "source").collect()}
    assert got["us", "02/03/2020 10:00:00"]["instantMs"] == ms(2020, 2, 3, 10)
    assert got["us", "02/03/2020 10:00:00"]["status"] == "resolved"
    for s in ("alone", None):
        assert got[s, "02/03/2020 10:00:00"]["status"] == "ambiguous" and got[s, "02/03/2020 10:00:00"]["instantMs"] is None


def test_fit_is_a_fixed_point():
    post = fit_mixture([["a"], ["a", "b"]], np.array([90.0, 10.0]))
    assert post[0][0] == 1 and post[1][0] > 0.95 and abs(post[1].sum() - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "v string, tz string, source string")
    assert normalise(df, "v", "tz", "source").count() == 0
