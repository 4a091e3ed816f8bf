"""One surviving record for each group of duplicates, put together from consistent bundles.

Fields that depend on each other form a bundle (a time and its zone, a width and its height) and
are taken from one candidate together. For each group a branch-and-bound search chooses one
candidate per bundle so that the total loss of trust is least under functional dependencies
between bundles: where ``Dependency("a", "b")`` holds, the chosen values of a and b must occur
together in a candidate, unless no candidate that has the chosen value of a offers a usable b.

Before the search, options that cannot be in a best choice are dropped in SQL: among candidates
with equal values of a bundle only the one first in the bundle's order is kept, and values that
occur together are passed as distinct pairs. A bundle without dependencies keeps one option, so
without dependencies a group of any size becomes a short list before it reaches a single task; a
bundle in dependencies keeps one for each of its different values. The search cuts off a branch
once its cost and the least that the bundles left can add, given what was chosen, reach the best
cost; bundles are few, as they come from a record's fields.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.text import strip
from skeinlake.operators import instants
from skeinlake.plans.staging import Workspace


@dataclass(frozen=True)
class Bundle:
    """``usable`` and ``order`` are SQL over a candidate's columns; three integers, the least is preferred.

    ``value`` is a string that stands for the bundle in dependencies.
    """

    name: str
    usable: str
    order: tuple[str, str, str]
    value: str = "cast(null as string)"


@dataclass(frozen=True)
class Dependency:
    determinant: str
    dependent: str


def _options(candidates: DataFrame, bundles: list[Bundle], dependencies: list[Dependency]) -> DataFrame:
    """One row per group: its options as bundle, order, value, and the pairs of values that occur together."""
    linked = {n for d in dependencies for n in (d.determinant, d.dependent)}
    by_name = {b.name: b for b in bundles}
    each = []
    for b in bundles:
        order = F.struct(*[F.expr(o).cast("bigint").alias(f"k{i}") for i, o in enumerate(b.order)], F.col("candidate"))
        own = F.expr(b.value) if b.name in linked else F.lit(None)
        each.append(F.struct(F.lit(b.name).alias("bundle"), F.coalesce(F.expr(b.usable), F.lit(False)).alias("usable"), order.alias("order"), own.cast("string").alias("value")))
    rows = candidates.select("grp", F.inline(F.array(*each))).where("usable")
    best = rows.groupBy("grp", "bundle", "value").agg(F.min("order").alias("order"))
    options = best.groupBy("grp").agg(F.collect_list(F.struct("bundle", "order", "value")).alias("options"))
    if not dependencies:
        return options.withColumn("pairs", F.array().cast("array<struct<rule:int,a:string,b:string>>"))
    value = lambda n: F.when(F.expr(by_name[n].usable), F.expr(by_name[n].value)).cast("string")
    together = F.array(*[F.struct(F.lit(i).alias("rule"), value(d.determinant).alias("a"), value(d.dependent).alias("b")) for i, d in enumerate(dependencies)])
    pairs = candidates.select("grp", F.inline(together)).where("a is not null and b is not null").distinct()
    return options.join(pairs.groupBy("grp").agg(F.collect_list(F.struct("rule", "a", "b")).alias("pairs")), "grp", "left")


def search(options: dict[str, list[tuple[tuple, str, dict]]], dependencies: list[Dependency], pairs: dict[Dependency, dict[str, set]] | None = None) -> dict[str, str]:
    """Bundle -> candidate with the least sum of ranks, the first in bundle and rank order among equals.

    ``options``: for each bundle its (order, candidate, values) in any order; ``pairs``: values
    that occur together, taken from the options' values if not given. If the dependencies leave a
    bundle no option, it is left out of the result rather than the whole group.
    """
    names = sorted(options)
    ranked = {n: sorted(options[n], key=lambda o: o[0]) for n in names}
    allowed: dict[Dependency, dict[str | None, set]] = pairs or {}
    for d in dependencies if pairs is None else ():
        own = allowed.setdefault(d, {})
        for n in names:
            for _, _, values in ranked[n]:
                if values.get(d.determinant) is not None and values.get(d.dependent) is not None:
                    own.setdefault(values[d.determinant], set()).add(values[d.dependent])
    skip = 1 + sum(len(o) for o in ranked.values())
    best_cost, best = math.inf, {}

    def fits(name: str, values: dict, chosen: dict[str, dict]) -> bool:
        """Whether a bundle's values go with those chosen."""
        for d, own in allowed.items():
            first = values if d.determinant == name else chosen.get(d.determinant)
            then = values if d.dependent == name else chosen.get(d.dependent)
            if first is None or then is None or name not in (d.determinant, d.dependent):
                continue
            together = own.get(first.get(d.determinant))
            if together and then.get(d.dependent) not in together:
                return False
        return True

    def least(name: str, chosen: dict[str, dict]) -> int:
        """The least that a bundle can still cost."""
        return next((rank for rank, (_, _, values) in enumerate(ranked[name]) if fits(name, values, chosen)), skip)

    def descend(i: int, cost: int, picked: dict[str, str], chosen: dict[str, dict]) -> None:
        nonlocal best_cost, best
        if cost >= best_cost or cost + sum(least(n, chosen) for n in names[i:]) >= best_cost:
            return
        if i == len(names):
            best_cost, best = cost, dict(picked)
            return
        name = names[i]
        for rank, (_, candidate, values) in enumerate(ranked[name]):
            if cost + rank >= best_cost:
                break
            if fits(name, values, chosen):
                picked[name], chosen[name] = candidate, values
                descend(i + 1, cost + rank, picked, chosen)
                del picked[name], chosen[name]
        if dependencies:
            descend(i + 1, cost + skip, picked, chosen)

    descend(0, 0, {}, {})
    return best


def choose(candidates: DataFrame, bundles: list[Bundle], dependencies: list[Dependency] = ()) -> DataFrame:
    """group, bundle, candidate: the chosen candidate of each bundle.

    ``candidates`` has columns grp and candidate (strings) and those the bundles name. No row for
    a bundle of which no candidate has a usable value. A candidate repeated in a group counts once.
    """
    rules = list(dependencies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for group, options, pairs in zip(batch["grp"], batch["options"], batch["pairs"]):
                by: dict[str, list] = {}
                for o in options:
                    order = o["order"]
                    key = (order["k0"], order["k1"], order["k2"], order["candidate"])
                    by.setdefault(o["bundle"], []).append((key, order["candidate"], {o["bundle"]: o["value"]}))
                allowed: dict[Dependency, dict[str, set]] = {d: {} for d in rules}
                for p in pairs if pairs is not None else ():
                    allowed[rules[p["rule"]]].setdefault(p["a"], set()).add(p["b"])
                rows += [(group, bundle, candidate) for bundle, candidate in search(by, rules, allowed).items()]
            yield pd.DataFrame(rows, columns=["grp", "bundle", "candidate"])

    return _options(candidates, bundles, rules).mapInPandas(run, "grp string, bundle string, candidate string")


# Media: trusted extractors first, then the later extraction, then the smaller id.
TRUST = ("untrusted", "-extracted")
MEDIA_BUNDLES = [
    Bundle("size", "size > 0", ("0", "0", "-size")),
    Bundle("takenAt", "taken", ("0", *TRUST)),
    Bundle("cameraModel", "camera", ("0", *TRUST)),
    Bundle("width", "wide", ("0", *TRUST)),
    Bundle("record", "n_usable > 0", ("-n_usable", *TRUST)),
]

#: Whole bundles of a media's fields: a time with its zone, a width with its height, a type with its kind.
RECORD_BUNDLES = [
    Bundle("camera", "cameraModel <> ''", ("0", *TRUST), "cameraModel"),
    Bundle("kind", "kind <> ''", ("0", *TRUST), "kind"),
    Bundle("mimeType", "mimeType <> ''", ("0", *TRUST), "mimeType"),
    Bundle("picture", "width > 0 and height > 0", ("0", "-width * height", "-extracted"), "concat(width, 'x', height)"),
    Bundle("time", "takenAt <> ''", ("0", *TRUST)),
]
#: A camera makes pictures of its sizes, and a type belongs to a kind.
RECORD_RULES = [Dependency("camera", "picture"), Dependency("kind", "mimeType")]


def current_metadata(metadata: DataFrame, fields: list[str]) -> DataFrame:
    """mediaId, extractedAt and fields of the row with the latest extractedAt of each media; equal ones by their fields' order."""
    rows = metadata.where("mediaId is not null").groupBy("mediaId").agg(F.max(F.struct("extractedAt", *fields)).alias("m"))
    return rows.select("mediaId", "m.*")


def _candidates(quarantine: DataFrame, work: Workspace) -> DataFrame:
    """grp, candidate: the trimmed, distinct ids of all rows of an item."""
    listed = quarantine.where("quarantineId is not null").select(F.col("quarantineId").alias("grp"), F.explode("candidateMediaIds").alias("id"))
    return work.save(listed.select("grp", strip("id").alias("candidate")).where("candidate <> ''").distinct(), "listed")


def _with_trust(metadata: DataFrame) -> DataFrame:
    """``metadata`` with ``extractor`` in place of raw: what complete JSON names."""
    return metadata.withColumn("extractor", F.try_variant_get(F.try_parse_json("raw"), "$.extractor", "string")).drop("raw")


#: Trust as SQL over a metadata row with ``extractor``; a row without a time of extraction comes last.
_UNTRUSTED = "case when extractor in ('exiftool', 'ffprobe') then 0 else 1 end as untrusted"
_EXTRACTED = f"coalesce(unix_micros(cast(extractedAt as timestamp)), {-(2**62)}) as extracted"


def media_survivors(quarantine: DataFrame, media: DataFrame, metadata: DataFrame) -> DataFrame:
    """quarantineId, fieldName, mediaId: who supplies each field of each item's surviving record.

    Candidates are the trimmed, distinct ids of all rows of an item that exist in media.
    """
    work = Workspace(quarantine.sparkSession, "survivors")
    listed = _candidates(quarantine, work)
    wanted = listed.select(F.col("candidate").alias("mediaId")).distinct()
    known = media.where("mediaId is not null").join(wanted, "mediaId", "left_semi").groupBy("mediaId").agg(F.max("size").alias("size"))
    latest = _with_trust(current_metadata(metadata.join(wanted, "mediaId", "left_semi"), ["takenAt", "tzName", "cameraModel", "width", "raw"]))
    # Fitted on all metadata, so that a value is settled as where the whole table is normalised.
    timed = instants.normalise(latest, "takenAt", "tzName", "cameraModel", fit_on=metadata, not_after="extractedAt")
    facts = timed.select(
        "mediaId",
        F.expr(_UNTRUSTED),
        F.expr(_EXTRACTED),
        F.col("instantMs").isNotNull().alias("taken"),
        (strip("cameraModel") != "").alias("camera"),
        (F.col("width") > 0).alias("wide"),
    )
    whole = known.join(facts, "mediaId", "left").select(
        F.col("mediaId").alias("candidate"),
        "size",
        F.coalesce("untrusted", F.lit(1)).alias("untrusted"),
        F.coalesce("extracted", F.lit(-(2**62))).alias("extracted"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("taken", "camera", "wide")],
    )
    usable = sum((F.coalesce(F.expr(b.usable), F.lit(False)).cast("int") for b in MEDIA_BUNDLES[:4]), F.lit(0))
    rows = listed.join(whole.withColumn("n_usable", usable), "candidate")
    return choose(rows, MEDIA_BUNDLES).select(F.col("grp").alias("quarantineId"), F.col("bundle").alias("fieldName"), F.col("candidate").alias("mediaId"))


def consistent_records(quarantine: DataFrame, metadata: DataFrame) -> DataFrame:
    """quarantineId, bundle, mediaId: who supplies each bundle of ``RECORD_BUNDLES`` of each item's record under ``RECORD_RULES``.

    Candidates are the trimmed, distinct ids of an item that have metadata, of which the current
    row counts. The largest picture is preferred, else trust; text counts trimmed. No row where no
    candidate has a usable value, or only such as the rules exclude.
    """
    work = Workspace(quarantine.sparkSession, "records")
    listed = _candidates(quarantine, work)
    wanted = listed.select(F.col("candidate").alias("mediaId")).distinct()
    fields = ["takenAt", "kind", "cameraModel", "mimeType", "width", "height", "raw"]
    latest = _with_trust(current_metadata(metadata.join(wanted, "mediaId", "left_semi"), fields))
    texts = {c: strip(c) for c in ("takenAt", "kind", "cameraModel", "mimeType")}
    facts = latest.select(F.col("mediaId").alias("candidate"), F.expr(_UNTRUSTED), F.expr(_EXTRACTED), F.col("width").cast("bigint"), F.col("height").cast("bigint"), *[c.alias(n) for n, c in texts.items()])
    chosen = choose(listed.join(facts, "candidate"), RECORD_BUNDLES, RECORD_RULES)
    return chosen.select(F.col("grp").alias("quarantineId"), "bundle", F.col("candidate").alias("mediaId"))
