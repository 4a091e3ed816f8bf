"""The catalog's multi-step operators: scan, ingest, near-duplicate classification, review, details, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.plans.running import running


def scan_diff(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, sourceEntryId, outcome: new, changed, unchanged or missing, of a source's listing against its entries.

    A known file has changed if size or mtime differ. Entries that are missing already aren't
    reported again.
    """
    known = catalog.select("path", "sourceEntryId", F.col("size").alias("csize"), F.col("mtimeMs").alias("cmtime"), "state")
    both = listing.withColumn("seen", F.lit(True)).join(known, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("csize")) & F.col("mtimeMs").eqNullSafe(F.col("cmtime"))
    outcome = F.when(F.col("seen").isNull(), F.when(~F.col("state").eqNullSafe("missing"), "missing"))
    outcome = outcome.when(F.col("sourceEntryId").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select("path", "sourceEntryId", outcome.alias("outcome")).where("outcome is not null")


def exact_dedup(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """entry, sha256, imported, original: the first entry of each digest by ``rank`` is imported unless the digest exists.

    ``incoming`` has entry, sha256 and a unique rank; ``existing`` has sha256 and mediaId. Entries
    without digest are left out.
    """
    rows = incoming.where("sha256 is not null")
    first = rows.groupBy("sha256").agg(F.min_by("entry", "rank").alias("first"))
    known = existing.where("sha256 is not null").groupBy("sha256").agg(F.min("mediaId").alias("mediaId"))
    joined = rows.join(first, "sha256").join(known, "sha256", "left")
    imported = F.col("mediaId").isNull() & (F.col("entry") == F.col("first"))
    return joined.select("entry", "sha256", imported.alias("imported"), F.when(~imported, F.coalesce("mediaId", "first")).alias("original"))


def near_pairs(items: DataFrame, most: int) -> DataFrame:
    """entry, mediaId, candidate, candidateEntry, distance, rank: pairs that share a head key or the first 4 hex digits of their hashes.

    ``items``: entry, mediaId, head, phash (valid or null), state, rank (bucket order). Where the
    entry has a hash, a candidate needs one within ``most`` bits; where it has none, candidates
    count unmeasured (distance null). Only active candidates count. Pairs are the operator's
    result for a blocked bucket; what a bucket must compare is limited by the distance filter.
    """
    rows = items.select("*", S.code_of_hex("phash").alias("code"), F.substring("phash", 1, 4).alias("block"))
    left = rows.select("entry", "mediaId", "head", "code", "block")
    right = rows.where("state = 'active'").select(
        F.col("entry").alias("candidateEntry"), F.col("mediaId").alias("candidate"), F.col("head").alias("chead"), F.col("code").alias("ccode"), F.col("block").alias("cblock"), "rank"
    )
    bits = S.hamming_codes(F.col("code"), F.col("ccode"))
    ok = (F.col("entry") != F.col("candidateEntry")) & (F.col("code").isNull() | (bits <= most))
    by_head = left.join(right, (F.col("head") == F.col("chead")) & ok).withColumn("way", F.lit(0))
    by_hash = left.join(right, (F.col("block") == F.col("cblock")) & ok).withColumn("way", F.lit(1))
    both = by_head.unionByName(by_hash).withColumn("distance", bits)
    return both.groupBy("entry", "mediaId", "candidate", "candidateEntry").agg(F.first("distance").alias("distance"), F.min(F.struct("way", "rank")).alias("rank"))


def blocked_entries(items: DataFrame) -> DataFrame:
    """entry of items of which another active item with the same head key or hash block is in review (``quarantined``)."""
    rows = items.select("entry", "head", F.substring("phash", 1, 4).alias("block"))
    held = items.where("state = 'active' and quarantined").select(F.col("entry").alias("other"), F.col("head").alias("ohead"), F.substring("phash", 1, 4).alias("oblock"))
    # Two different ones are enough to tell for any entry, itself one of them or not.
    least = lambda key: held.where(f"{key} is not null").groupBy(key).agg(F.min("other").alias("least"), F.max("other").alias("most"))
    other = (F.col("least") != F.col("entry")) | (F.col("most") != F.col("entry"))
    by_head = rows.join(least("ohead"), (F.col("head") == F.col("ohead")) & other, "left_semi")
    by_hash = rows.join(least("oblock"), (F.col("block") == F.col("oblock")) & other, "left_semi")
    return by_head.select("entry").unionByName(by_hash.select("entry")).distinct()


def classify_near(items: DataFrame, strong: int = 4, probable: int = 10) -> DataFrame:
    """entry, outcome (strong or quarantine), mediaId, distance, candidateMediaIds for each entry with candidates.

    strong: the candidate with the least distance within ``strong``, the first in bucket order among
    equals. Otherwise all candidates after the entry's own media go to review. This is the decision
    from a fixed state; decisions of one entry don't affect another.
    """
    pairs = near_pairs(items, max(strong, probable))
    close = F.col("distance") <= strong
    out = pairs.groupBy("entry", "mediaId").agg(
        F.min_by(F.struct("candidate", "distance"), F.when(close, F.struct("distance", "rank", "candidate"))).alias("best"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("ordered"),
    )
    found = F.col("best").isNotNull()
    listed = F.array_distinct(F.concat(F.array("mediaId"), F.col("ordered")))
    return out.select(
        "entry",
        F.when(found, "strong").otherwise("quarantine").alias("outcome"),
        F.col("best.candidate").alias("mediaId"),
        F.col("best.distance").alias("distance"),
        F.when(~found, listed).alias("candidateMediaIds"),
    ).where((F.col("outcome") == "strong") | (F.size("candidateMediaIds") > 1))


def decide(items: DataFrame, commands: DataFrame) -> DataFrame:
    """quarantineId, applied, error of accept and reject commands (quarantineId, action, mediaId) on pending items.

    Accepting needs one of the item's candidates. Of several commands the first by ``at`` applies.
    """
    first = commands.groupBy("quarantineId").agg(F.min_by(F.struct("action", "mediaId"), "at").alias("c"))
    rows = first.join(items.select("quarantineId", "status", "candidateMediaIds"), "quarantineId", "left")
    error = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", "not_pending")
    error = error.when((F.col("c.action") == "accept") & ~F.coalesce(F.array_contains("candidateMediaIds", F.col("c.mediaId")), F.lit(False)), "not_a_candidate")
    return rows.select("quarantineId", error.isNull().alias("applied"), error.alias("error"))


def entry_detail(entries: DataFrame, ingest: DataFrame, media: DataFrame, metadata: DataFrame, quarantine: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with ingest status, media, metadata, review item and their links as a list."""
    own = links.groupBy("sourceEntryId").agg(F.array_sort(F.collect_list(F.struct("level", F.col("mediaId").alias("linkedMediaId")))).alias("links"))
    rows = entries.join(ingest, "sourceEntryId", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    rows = rows.join(media.select("sourceEntryId", F.col("mediaId").alias("ownMediaId"), "sha256"), "sourceEntryId", "left")
    rows = rows.join(metadata.select(F.col("mediaId").alias("ownMediaId"), F.col("kind").alias("mediaKind"), "mimeType"), "ownMediaId", "left")
    rows = rows.join(quarantine.select("sourceEntryId", "quarantineId"), "sourceEntryId", "left")
    return rows.join(own, "sourceEntryId", "left")


def media_detail(media: DataFrame, metadata: DataFrame, links: DataFrame) -> DataFrame:
    own = links.groupBy("mediaId").agg(F.array_sort(F.collect_list(F.struct("level", "sourceEntryId"))).alias("links"))
    return media.join(metadata, "mediaId", "left").join(own, "mediaId", "left")


def missing_members(albums: DataFrame, media: DataFrame) -> DataFrame:
    """albumId, mediaId of album members without a media row."""
    members = albums.select("albumId", F.explode("mediaIds").alias("mediaId"))
    return members.join(media.select("mediaId"), "mediaId", "left_anti").select("albumId", "mediaId").distinct()


def derived_plan(metadata: DataFrame, present: DataFrame) -> DataFrame:
    """mediaId, asset that is to be made: a thumb of photos and a poster of videos, without those present."""
    asset = F.when(F.col("kind") == "photo", "thumb").when(F.col("kind") == "video", "poster")
    wanted = metadata.select("mediaId", asset.alias("asset")).where("mediaId is not null and asset is not null").distinct()
    return wanted.join(present, ["mediaId", "asset"], "left_anti")


def new_contents(digests: DataFrame, stored: DataFrame) -> DataFrame:
    """sha256, path of contents that aren't stored yet, once each."""
    rows = digests.select("sha256").where("sha256 is not null").distinct().join(stored.select("sha256"), "sha256", "left_anti")
    return rows.select("sha256", S.content_path("sha256").alias("path"))


def served_types(media: DataFrame, metadata: DataFrame, entries: DataFrame) -> DataFrame:
    """mediaId, mimeType a file is served with: that of its metadata, else by extension."""
    rows = media.select("mediaId", "sourceEntryId").join(metadata.select("mediaId", F.col("mimeType").alias("own")), "mediaId", "left")
    rows = rows.join(entries.select("sourceEntryId", "path"), "sourceEntryId", "left")
    return rows.select("mediaId", F.coalesce("own", S.served_mime("path")).alias("mimeType"))


def allowed_roots(sources: DataFrame, roots: list[str]) -> DataFrame:
    """Sources whose path is one of the roots or below it; no roots allow all."""
    if not roots:
        return sources
    test = F.lit(False)
    for root in roots:
        plain = root.rstrip("/")
        test |= (F.col("path") == plain) | F.col("path").startswith(plain + "/")
    return sources.where(test)


def metrics(counts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row with the number of rows of each table, of those a condition holds for where one is given."""
    out = None
    for name, (table, condition) in counts.items():
        one = table.agg((F.count("*") if condition is None else F.count_if(condition)).alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def latency_stats(samples: DataFrame, group: str, value: str) -> DataFrame:
    """min, p50, p95, max, avg by group; a percentile is the sorted value at floor(n * rank), the last at most.

    Equal values are counted first, and places are running totals over ranges, so that no task
    needs a whole group.
    """
    rows = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("grp"), F.col(value).alias("v"))
    counts = rows.groupBy("grp", "v").agg(F.count("*").alias("c"))
    placed = running(counts, "grp", ["v"], "c", "sum", "upto")
    totals = counts.groupBy("grp").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s")).withColumnRenamed("grp", "g")
    ranked = placed.join(totals, F.col("grp").eqNullSafe(F.col("g")))

    def at(rank: float) -> Column:
        place = F.least(F.floor(F.col("n") * rank), F.col("n") - 1)
        return F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("c")), F.col("v")))

    out = ranked.groupBy("grp").agg(F.min("v").alias("min_v"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("max_v"), (F.first("s") / F.first("n")).alias("avg_v"))
    return out.withColumnRenamed("grp", group)


def budget_violations(stats: DataFrame, group: str, p95: float, avg: float) -> DataFrame:
    """name, violation where a latency exceeds its budget."""
    over = F.array(
        F.when(F.col("p95") > p95, F.format_string(f"p95 %.2f > {p95:.2f}", "p95")),
        F.when(F.col("avg_v") > avg, F.format_string(f"avg %.2f > {avg:.2f}", "avg_v")),
    )
    return stats.select(F.col(group).alias("name"), F.explode(over).alias("violation")).where("violation is not null")


def runnable(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running"))


def without_active(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (kind, payload as JSON text) for which no queued or running job has the same kind and canonical payload."""
    key = lambda d: d.withColumn("_key", F.coalesce(S.canonical_json("payload"), F.lit("null")))
    active = key(runnable(jobs)).select("kind", "_key")
    return key(requests).join(active, ["kind", "_key"], "left_anti").drop("_key")


def next_step(attempts: Column, most: Column, has_handler: Column) -> Column:
    """What follows a failed attempt: failed without handler or attempts left, else retry."""
    return F.when(~has_handler, "failed").when(attempts >= most, "failed").otherwise("retry")


def running_at_once(trace: DataFrame) -> DataFrame:
    """kind, most: the greatest number of jobs of a kind that ran at the same time in a trace (kind, at, change of +1 or -1).

    Ends count before starts of the same moment.
    """
    steps = trace.groupBy("kind", "at", "change").agg(F.sum("change").alias("step"))
    return running(steps, "kind", ["at", "change"], "step", "sum", "now").groupBy("kind").agg(F.max("now").alias("most"))
