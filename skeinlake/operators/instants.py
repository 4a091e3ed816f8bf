"""Timestamps in many notations, precisions and zones as one instant in epoch milliseconds.

Every value is read under each notation it is valid in. Values with several readings are
settled by expectation-maximisation over a mixture of notations per source: each value contributes
the likelihood of each of its readings, their posteriors add up to the notations' weights, and the
weights give the posteriors again until they settle. A reading is chosen where its posterior
reaches ``confidence``; otherwise the value is marked ambiguous and gets no instant.

A reading's likelihood is that of the notation for the text (1 where nothing is laid down,
``DOMINATED`` where a rule prefers another reading), times ``LATE`` if the instant lies after the
time by which the value is known to have existed. What a rule declares impossible competes as a
reading of its own, ``nothing``.

Fixed readings: a zone or offset in the text wins over the row's zone, which wins over UTC; a
wall time that occurs twice is its first occurrence and one that never occurs is read with the
offset before the jump; fractions are cut to the millisecond; bare numbers are seconds,
milliseconds or microseconds, whichever falls into the years 2000 to 2035, else calendar
digits; dotted dates have the day first. Slashed dates may be either way round.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.plans.staging import Workspace

#: White space other than U+0020 that separates like it, and dashes written for minus.
SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\t\r\n"
DASHES = "\u2212\u2010\u2011\u2012\u2013"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = "(" + "|".join(MONTHS) + ")[a-z]*\\.?"
_DAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\\s+)?"
_TIME = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?\\s*([ap]m\\b)?"
_OFFSET = "z|(?:utc|gmt)?\\s*[+-]\\d{1,2}(?::?\\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)*"
_ZONE = f"(?:\\s*({_OFFSET}))?(?:\\s*\\[([^\\]|]+)\\])?"

#: Notation -> pattern and the order of year|month|day|hour|minute|second|fraction|am-pm|zone|bracketed zone.
GRAMMAR: dict[str, tuple[str, str]] = {
    "year_first": (f"^(\\d{{4}})([-:/])(\\d{{1,2}})\\2(\\d{{1,2}})(?:t|\\s+){_TIME}{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    "dotted": (f"^(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})[t, ]+{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "slashed": (f"^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})[t, ]+{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "day_month": (f"^{_DAY}(\\d{{1,2}})[ -]{_MONTH}[ -](\\d{{4}})[, ]+{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "month_day": (f"^{_DAY}{_MONTH}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}}),?\\s+{_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    "digits": ("^(\\d{4})(\\d{2})(\\d{2})(\\d{2})(\\d{2})(\\d{2})?(\\d{1,9})?$", "$1|$2|$3|$4|$5|$6|$7|||"),
    "basic": (f"^(\\d{{4}})(\\d{{2}})(\\d{{2}})t(\\d{{2}})(\\d{{2}})(?:(\\d{{2}})(?:[.,](\\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
}

#: Units of bare numbers: how many make a second.
UNITS = {"seconds": 1, "milliseconds": 1_000, "microseconds": 1_000_000}
#: Likelihood of a reading that a rule sets aside, and of one that lies after the value was recorded.
DOMINATED, LATE = 1e-12, 1e-3
#: First second of 2000 and first second after 2035.
WINDOW = (946_684_800, 2_082_758_400)


def zone_ids(spark: SparkSession) -> list[str]:
    """Names of the time zones that the JVM knows (a fixed list of about 600)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _epoch_ms(wall: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp taken as UTC; no session setting matters."""
    t = F.col(wall)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return ((days * 24 + F.hour(t)) * 60 + F.minute(t)) * 60_000 + F.second(t).cast("bigint") * 1000


def _try_int(column: Column) -> Column:
    return F.when(column != "", column).try_cast("int")


def _readings(rows: DataFrame, zones: list[str], month: str, day: str, suffix: str) -> DataFrame:
    """Adds ``ms{suffix}``: the instant of the calendar fields, null if there is none."""
    noon = F.when(F.col("_ap") == "", F.col("_h"))
    noon = noon.when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "pm", 12).otherwise(0))
    in_range = noon.between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59) & F.col("_y").between(1, 9999)
    wall = F.when(in_range, F.try_make_timestamp_ntz(F.col("_y"), F.col(month), F.col(day), noon, F.col("_mi"), F.col("_s")))
    utc = F.when(F.col("_zone").isin(zones), F.convert_timezone(F.col("_zone"), F.lit("UTC"), F.col("_wall")))
    return (
        rows.withColumn("_wall", wall)
        .withColumn("_utc", F.when(F.col("_off").isNotNull(), F.col("_wall")).otherwise(utc))
        .withColumn(f"ms{suffix}", _epoch_ms("_utc") + F.col("_ms") - F.coalesce("_off", F.lit(0)) * 60_000)
        .drop("_wall", "_utc")
    )


def readings(rows: DataFrame, value: str, zone: str) -> DataFrame:
    """Adds ``readings``: array of (notation, ms, prior), the instants that ``value`` may denote; empty if none.

    Dotted dates may also have the month first, and numbers that count since 1970 may be calendar
    digits, both dominated by the rules that set these readings aside.
    """
    zones = zone_ids(rows.sparkSession)
    plain = F.trim(F.translate(F.col(value), SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES)))
    shape, found = F.lit(None).cast("string"), rows.withColumn("_v", plain)
    for name, (pattern, order) in reversed(GRAMMAR.items()):
        pattern = f"(?i){pattern}"
        shape = F.when(F.col("_v").rlike(pattern), F.concat(F.lit(f"{name}|"), F.regexp_replace("_v", pattern, order))).otherwise(shape)
    found = found.withColumn("_p", F.split(shape, "\\|", -1))
    part = lambda i: F.try_element_at("_p", F.lit(i + 1))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    text_zone = F.when(part(9) != "", part(9)).otherwise(F.when(part(10) != "", F.trim(part(10))))
    own_zone = F.when(F.trim(F.col(zone)) != "", F.trim(F.col(zone))).otherwise(F.lit("UTC"))
    named = F.coalesce(text_zone, own_zone)
    clock = "(?i)^(?:utc|gmt)?\\s*([+-])(\\d{1,2}):?(\\d{2})?$"
    sign = F.when(F.regexp_extract("_zone", clock, 1) == "-", -1).otherwise(1)
    hours, minutes = F.regexp_extract("_zone", clock, 2).try_cast("int"), F.coalesce(_try_int(F.regexp_extract("_zone", clock, 3)), F.lit(0))
    found = (
        found.withColumns(
            {
                "_y": _try_int(part(1)),
                "_mo": F.coalesce(_try_int(F.when(part(2).rlike("^\\d"), part(2))), F.try_element_at(months, F.lower(part(2)))),
                "_d": _try_int(part(3)),
                "_h": _try_int(part(4)),
                "_mi": _try_int(part(5)),
                "_s": F.coalesce(_try_int(part(6)), F.lit(0)),
                "_ms": F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int"),
                "_ap": F.lower(part(8)),
                "_zone": F.when(F.lower(named).isin("z", "utc", "gmt"), F.lit("UTC")).otherwise(named),
            }
        )
        .withColumn("_off", F.when((hours <= 18) & (minutes <= 59), sign * (hours * 60 + minutes)))
        .withColumn("_n", F.when(F.col("_v").rlike("^\\d{1,18}(\\.\\d+)?$"), F.split("_v", "\\.")))
    )
    found = _readings(found, zones, "_mo", "_d", "1")
    found = _readings(found.withColumn("_swap", F.when(part(0).isin("slashed", "dotted"), F.col("_mo"))), zones, "_d", "_swap", "2")

    number, cut = F.col("_n")[0].try_cast("bigint"), F.rpad(F.coalesce(F.try_element_at("_n", F.lit(2)), F.lit("")), 3, "0")
    counted = []
    for unit, per_second in UNITS.items():
        inside = (number >= WINDOW[0] * per_second) & (number < WINDOW[1] * per_second)
        ms = number * 1000 + F.substring(cut, 1, 3).cast("bigint") if per_second == 1 else F.floor(number / (per_second // 1000)).cast("bigint")
        counted.append(F.struct(F.lit(unit).alias("notation"), F.when(inside, ms).alias("ms"), F.lit(1.0).alias("prior")))
    found = found.withColumn("_count", F.filter(F.array(*counted), lambda x: x["ms"].isNotNull()))
    dotted, slashed = part(0) == "dotted", part(0) == "slashed"
    first = F.when(dotted | slashed, F.concat(part(0), F.lit("_day_first"))).otherwise(part(0))
    second = F.concat(part(0), F.lit("_month_first"))
    set_aside = F.when(F.size("_count") > 0, F.lit(DOMINATED)).otherwise(1.0)
    written = [
        F.struct(first.alias("notation"), F.col("ms1").alias("ms"), set_aside.alias("prior")),
        F.struct(second.alias("notation"), F.col("ms2").alias("ms"), F.when(dotted, F.lit(DOMINATED)).otherwise(1.0).alias("prior")),
    ]
    found = found.withColumn("_written", F.filter(F.array(*written), lambda x: x["ms"].isNotNull()))
    # Where only a dominated reading is valid, the rule says that the text denotes nothing.
    nothing = F.array(F.struct(F.lit("nothing").alias("notation"), F.lit(None).cast("bigint").alias("ms"), F.lit(1.0).alias("prior")))
    every = F.concat("_count", "_written")
    every = F.when(F.exists(every, lambda x: x["prior"] < 1) & ~F.exists(every, lambda x: x["prior"] == 1), F.concat(every, nothing)).otherwise(every)
    chosen = F.when(F.col("_v").isNull(), F.array().cast("array<struct<notation:string,ms:bigint,prior:double>>")).otherwise(every)
    return found.select(*rows.columns, chosen.alias("readings"))


def fit_mixture(sets: list[list], counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9, prior: float = 0.5) -> list[np.ndarray]:
    """Posterior of each reading of each set, by expectation-maximisation from equal weights.

    ``counts`` values have the readings of the set, given as notation or (notation, likelihood);
    ``prior`` is added to each notation's expected count.
    """
    sets = [[r if isinstance(r, tuple) else (r, 1.0) for r in s] for s in sets]
    names = sorted({n for s in sets for n, _ in s})
    at = {n: i for i, n in enumerate(names)}
    likely = np.zeros((len(sets), len(names)))
    for i, s in enumerate(sets):
        for n, p in s:
            likely[i, at[n]] += p
    weights = np.full(len(names), 1 / max(1, len(names)))
    for _ in range(rounds):
        share = likely * weights
        share /= share.sum(axis=1, keepdims=True)
        now = counts @ share + prior
        now /= now.sum()
        done = np.abs(now - weights).max() < tolerance
        weights = now
        if done:
            break
    out = []
    for s in sets:
        own = np.array([p * weights[at[n]] for n, p in s])
        out.append(own / own.sum())
    return out


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    sets = [[(r["notation"], float(r["p"])) for r in s] for s in group["likely"]]
    posterior = fit_mixture(sets, group["n"].to_numpy(dtype=float))
    return pd.DataFrame({"source": group["source"], "likely": group["likely"], "posterior": [p.tolist() for p in posterior]})


LIKELY = "array<struct<notation:string,p:double>>"


def normalise(rows: DataFrame, value: str, zone: str, source: str, confidence: float = 0.9, fit_on: DataFrame | None = None, not_after: str | None = None) -> DataFrame:
    """Adds instantMs, notation, posterior and status to each row.

    ``status`` is single (one reading), resolved (several, settled by the source's mixture),
    ambiguous (several, none reaching ``confidence``; no instant) or none (no reading, or none that
    the rules allow: null, blank, placeholder, impossible date or time, unknown zone). Readings of
    the same instant count together. ``not_after`` names a timestamp by which the value existed.
    Rows without source share one mixture. The mixtures are fitted on ``fit_on`` if given,
    which must hold the values of ``rows`` under the same column names. Columns of the input named like the added ones are replaced.
    """
    work = Workspace(rows.sparkSession, "instants")
    added = ["instantMs", "notation", "posterior", "status"]
    named = [F.col(value).cast("string").alias("_value"), F.col(zone).cast("string").alias("_tz"), F.col(source).cast("string").alias("_source")]
    named.append((F.lit(None).cast("bigint") if not_after is None else F.unix_millis(F.col(not_after).cast("timestamp"))).alias("_by"))

    def read_of(packed: DataFrame, name: str) -> DataFrame:
        read = readings(packed, "_value", "_tz")
        late = lambda r: F.when(r["ms"] > F.col("_by"), F.lit(LATE)).otherwise(1.0)
        likely = F.transform("readings", lambda r: F.struct(r["notation"].alias("notation"), (r["prior"] * late(r)).alias("p")))
        # One likelihood alone says the same as another, so that single readings make one set.
        likely = F.when(F.size("readings") > 1, likely).otherwise(F.transform("readings", lambda r: F.struct(r["notation"].alias("notation"), F.lit(1.0).alias("p"))))
        return work.save(read.withColumn("_set", likely).drop("_value", "_tz", "_by"), name)

    # The input travels as one struct, so that none of its names can clash with those used here.
    read = read_of(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *named), "read")
    fit = read if fit_on is None else read_of(fit_on.select(*named), "fit")
    # One row per source and set of readings: what the mixtures are fitted on doesn't grow with repeated values.
    sets = fit.where(F.size("_set") > 0).groupBy(F.coalesce("_source", F.lit("")).alias("source"), F.col("_set").alias("likely")).agg(F.count("*").alias("n"))
    fitted = sets.groupBy("source").applyInPandas(_fit, f"source string, likely {LIKELY}, posterior array<double>")
    joined = read.join(
        fitted.withColumnsRenamed({"source": "_fit_source", "likely": "_fit_set", "posterior": "_posterior"}),
        (F.coalesce("_source", F.lit("")) == F.col("_fit_source")) & (F.col("_set") == F.col("_fit_set")),
        "left",
    )
    together = lambda r: F.aggregate(F.zip_with("readings", "_posterior", lambda x, p: F.when(x["ms"].eqNullSafe(r["ms"]), p).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    ranked = F.transform("readings", lambda r, i: F.struct(together(r).alias("sum"), F.get("_posterior", i).alias("own"), (-i).alias("place")))
    joined = joined.withColumn("_top", F.when(F.col("_posterior").isNotNull(), F.array_max(ranked)))
    joined = joined.withColumn("_best", F.col("_top.sum")).withColumn("_at", 1 - F.col("_top.place"))
    joined = joined.withColumn("_chosen", F.when(F.col("_best") >= confidence, F.try_element_at("readings", F.col("_at"))))
    none = (F.size("_set") == 0) | (F.col("_chosen.notation") == "nothing")
    status = F.when(none, "none").when(F.size("_set") == 1, "single").when(F.col("_best") >= confidence, "resolved").otherwise("ambiguous")
    shown = joined.withColumn("_status", status)
    return shown.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c not in added],
        F.col("_chosen.ms").alias("instantMs"),
        F.col("_chosen.notation").alias("notation"),
        F.col("_best").alias("posterior"),
        F.col("_status").alias("status"),
    )
