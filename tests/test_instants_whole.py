"""Readings of the same instant, and readings that rules set aside."""

from test_instants import ms

from skeinlake.operators.instants import normalise


def test_readings_of_one_instant_count_together(spark):
    df = spark.createDataFrame([("05/05/2021 10:00:00", None, "s"), ("02/03/2020 10:00:00", None, "s")], "v string, tz string, source string")
    got = {r["v"]: r for r in normalise(df, "v", "tz", "source").collect()}
    assert got["05/05/2021 10:00:00"]["instantMs"] == ms(2021, 5, 5, 10) and got["05/05/2021 10:00:00"]["status"] == "resolved"
    assert got["02/03/2020 10:00:00"]["status"] == "ambiguous" and got["02/03/2020 10:00:00"]["instantMs"] is None


def test_rules_dominate_the_mixture(spark):
    """Month first in a source's dotted dates, and digits that are also a count, are set aside whatever the mixture says."""
    values = ["05.17.2021 10:00:00"] * 30 + ["03.04.2021 10:00:00", "2013021000194477"]
    df = spark.createDataFrame([(i, v, None, "s") for i, v in enumerate(values)], "n int, v string, tz string, source string")
    got = {r["v"]: (r["instantMs"], r["status"]) for r in normalise(df, "v", "tz", "source").collect()}
    assert got["05.17.2021 10:00:00"] == (None, "none")
    assert got["03.04.2021 10:00:00"] == (ms(2021, 4, 3, 10), "resolved")
    assert got["2013021000194477"] == (2013021000194, "resolved")


def test_times_after_the_recording_are_unlikely(spark):
    df = spark.createDataFrame([("02/03/2020 10:00:00", None, "s", "2020-02-20 00:00:00")], "v string, tz string, source string, by string")
    assert normalise(df, "v", "tz", "source").head()["status"] == "ambiguous"
    got = normalise(df, "v", "tz", "source", not_after="by").head()
    assert (got["instantMs"], got["status"]) == (ms(2020, 2, 3, 10), "resolved")
