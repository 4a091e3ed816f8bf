"""Checking each new batch for duplicates against everything accepted before.

The accepted media are kept in segments, one for each batch: a table of digests in hash buckets
and shards of the perceptual codes. A new batch is joined with the digest buckets it touches and
searched in the shards by exact distance. What the history doesn't match gets shards of its own,
in which rounds settle what the batch repeats of itself. What is accepted becomes the batch's
segment; once ``fan_in`` segments of one level exist, they are compacted into one of the next
level, so that the number of segments grows with the logarithm of the number of batches.

Codes are placed once for each of ``radius + 1`` slices of their bits, in the shard of about
``capacity`` codes that the slice's value hashes to: two codes within the radius are equal in one
slice at least, so a search visits ``radius + 1`` shards of a segment however many there are,
compares only the codes that are equal in the slice, and misses nothing. Shards that a frequent
slice value overfills are split, and many queries of one shard are searched in blocks.

A manifest names the segments and the batches they hold; publishing the next one is the commit, so
a batch is added whole or not at all, and any later session opens the index where it was left.
Media with the same digest and code behave alike, so searches and decisions work on the different
signatures of a batch, and copies are joined at the end.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions.text import strip
from skeinlake.llm import slices, small_batch
from skeinlake.plans.sizing import power_of_two
from skeinlake.plans.staging import Workspace, delete, list_names, publish_text, read_text

SHARD = "segment int, family int, part int, codes binary, owners binary"
SHARD_COLUMNS = [c.split()[0] for c in SHARD.split(", ")]
KEY = ["segment", "family", "part"]
ACCEPTED = "node string, sha string, code long, bucket int"
MATCHES = "batch int, sha string, code long, accepted string, kind string"
#: Taken from the rank of a signature that is accepted while a batch is being decided, so that it comes before any other.
KEPT = 1 << 62
#: Accepted media per digest bucket of a segment, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 1_000_000, 1 << 16
#: Bytes that a code takes in a shard, and of shards that are sent to all executors rather than joined.
CODE_BYTES, SENT_BYTES = 8, 32 << 20
#: Signatures of a batch that one task decides; larger batches are decided in rounds of joins.
SMALL_BATCH = 1 << 17
#: Pairs found that are handed on at once.
FOUND = 1 << 20


def media_signatures(media: DataFrame, metadata: DataFrame) -> DataFrame:
    """mediaId, batch, sha, code: a media's first batch, valid digest and valid perceptual code.

    The digest counts trimmed, in any letter case, with exactly 64 hex digits; the code is read from
    the current metadata's raw if that is complete JSON, with exactly 16 hex digits. Of several
    rows of a media the one in the first batch counts. Rows without mediaId or batch are left out.
    """
    sha = F.lower(strip("sha256"))
    first = media.where("mediaId is not null and batchNo is not null").groupBy("mediaId").agg(
        F.min("batchNo").alias("batch"), F.min_by(F.when(sha.rlike("^[0-9a-f]{64}\\z"), sha), "batchNo").alias("sha")
    )
    latest = metadata.where("mediaId is not null").groupBy("mediaId").agg(F.max(F.struct("extractedAt", "raw")).alias("m"))
    text = F.lower(strip(F.try_variant_get(F.try_parse_json("m.raw"), "$.perceptualHash", "string")))
    code = F.when(text.rlike("^[0-9a-f]{16}\\z"), F.conv(text, 16, -10).cast("bigint"))
    return first.join(latest.select("mediaId", code.alias("code")), "mediaId", "left")


def _buckets(accepted: int) -> int:
    return min(MOST_BUCKETS, power_of_two(accepted / PER_BUCKET))


@dataclass(frozen=True)
class Layout:
    """Where the codes of a segment lie: in ``parts`` shards for each of ``families`` slices of their bits."""

    segment: int
    families: int
    parts: int

    @classmethod
    def of(cls, segment: int, count: int, capacity: int, radius: int) -> Layout:
        return cls(segment, radius + 1, max(1, math.ceil(count / capacity)))

    def _part(self, code: Column, family: int) -> Column:
        low, high = slices.cuts(self.families)[family : family + 2]
        piece = F.shiftrightunsigned(F.shiftleft(code, 64 - high), 64 - high + low)
        return F.pmod(F.xxhash64(piece, F.lit(family)), F.lit(self.parts)).cast("int")

    def placed(self, code: Column) -> Column:
        """Array of the shards that hold a code, and that a search for it visits."""
        at = lambda f: F.struct(F.lit(self.segment).alias("segment"), F.lit(f).alias("family"), self._part(code, f).alias("part"))
        return F.array(*[at(f) for f in range(self.families)])


def _build_shard(families: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["code"].to_numpy(dtype=np.int64).view(np.uint64)
        order = slices.by_cell(codes, key[1], families)
        owners = rows["owner"].to_numpy(dtype=np.int64)[order].astype("<i8").tobytes() if "owner" in rows else None
        return pd.DataFrame({"segment": [key[0]], "family": [key[1]], "part": [key[2]], "codes": [codes[order].astype("<u8").tobytes()], "owners": [owners]})

    return run


def build_segment(codes: DataFrame, layout: Layout, capacity: int) -> DataFrame:
    """Shards of at most about ``capacity`` of the distinct codes (columns code and, if they have any, owner)."""
    placed = codes.select("*", F.inline(layout.placed(F.col("code"))))
    if layout.parts == 1:
        placed = placed.withColumn("sub", F.lit(0))
    else:
        sizes = placed.groupBy(*KEY).agg(F.ceil(F.count("*") / F.lit(2 * capacity)).alias("subs"))
        placed = placed.join(sizes, KEY).withColumn("sub", F.pmod(F.xxhash64("code", F.lit(3)), F.col("subs")))
    return placed.groupBy(*KEY, "sub").applyInPandas(_build_shard(layout.families), SHARD)


def _search_rows(radius: int, families: dict[int, int], least_owner: bool):
    """Searches query blocks joined with shards; all hits, or the least owner of the other codes that each query hits."""

    def found(shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asked = np.asarray(shard.asked, dtype=np.int64)
        codes = np.frombuffer(shard.codes, dtype="<u8")
        pairs = slices.near(asked.view(np.uint64), codes, int(shard.family), families[int(shard.segment)], radius)
        if not least_owner:
            for q, n in pairs:
                yield asked[q], codes[n].view(np.int64)
            return
        owners, none = np.frombuffer(shard.owners, dtype="<i8"), np.iinfo(np.int64).max
        least = np.full(len(asked), none)
        for q, n in pairs:
            other = asked[q] != codes[n].view(np.int64)
            np.minimum.at(least, q[other], owners[n[other]])
        q = np.flatnonzero(least < none)
        yield asked[q], least[q]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for shard in batch.itertuples(index=False):
                for pair in found(shard):
                    held.append(pair)
                    size += len(pair[0])
                    if size >= FOUND:
                        yield pd.DataFrame({"code": np.concatenate([p[0] for p in held]), "hit": np.concatenate([p[1] for p in held])})
                        held, size = [], 0
            if size:
                yield pd.DataFrame({"code": np.concatenate([p[0] for p in held]), "hit": np.concatenate([p[1] for p in held])})

    return run


def search_shards(shards: DataFrame, layouts: list[Layout], held: int, queries: DataFrame, count: int, radius: int, least_owner: bool = False, block: int = 16384) -> DataFrame:
    """code, hit: the different codes of ``shards`` within ``radius`` of each of the about ``count`` distinct ``queries`` codes.

    Blocks of queries meet the shards they visit; the shards, which have ``held`` codes at most, are
    sent to the blocks if that is less than ``SENT_BYTES``, else both are joined by shard. With
    ``least_owner``, hit is the least owner of the other codes that a query hits in a shard, one
    row for each query and shard in which it hits any.
    """
    routed = queries.select("code", F.inline(F.flatten(F.array(*[layout.placed(F.col("code")) for layout in layouts]))))
    if count > block:
        sizes = routed.groupBy(*KEY).agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
        routed = routed.join(sizes, KEY).withColumn("block", F.pmod(F.xxhash64("code", F.lit(2)), F.col("blocks")))
    else:
        routed = routed.withColumn("block", F.lit(0))
    blocks = routed.groupBy(*KEY, "block").agg(F.collect_list("code").alias("asked"))
    size = (2 if least_owner else 1) * CODE_BYTES * held * (radius + 1)
    rows = blocks.join(F.broadcast(shards) if size <= SENT_BYTES else shards, KEY).select("segment", "family", "asked", "codes", "owners")
    return rows.mapInPandas(_search_rows(radius, {layout.segment: layout.families for layout in layouts}, least_owner), "code long, hit long")


@dataclass
class Segment:
    """``codes`` is an upper bound; ``folder`` holds its accepted media by digest bucket and, if it has codes, its shards."""

    segment: int
    level: int
    codes: int
    accepted: int
    buckets: int
    folder: str
    families: int = 1
    parts: int = 0

    def layout(self) -> Layout:
        return Layout(self.segment, self.families, self.parts)


@dataclass
class Manifest:
    version: int = 0
    next_segment: int = 0
    batches: list[int] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    #: batch -> folders of its matches
    matches: dict[str, list[str]] = field(default_factory=dict)


class HistoryIndex:
    """The accepted media under ``root``: their digests, and their codes in shards by slices of their bits."""

    def __init__(self, spark: SparkSession, root: str, radius: int = 4, capacity: int = 8192, fan_in: int = 4):
        self.spark, self.root, self.radius, self.capacity, self.fan_in = spark, root, radius, capacity, fan_in
        self.work = Workspace(spark, "history-work")

    def manifest(self) -> Manifest:
        names = [n for n in list_names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return Manifest()
        held = json.loads(read_text(self.spark, f"{self.root}/manifest/{names[-1]}"))
        return Manifest(**held | {"segments": [Segment(**s) for s in held["segments"]]})

    def _shards(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(*[f"{s.folder}/shards" for s in segments])

    def _accepted(self, segments: list[Segment], touched: list[int] | None = None) -> DataFrame:
        """Accepted media of the segments, from the digest buckets that ``touched`` (numbers modulo a power of two) fall into."""
        paths = []
        for s in segments:
            own = range(s.buckets) if touched is None else sorted({t % s.buckets for t in touched})
            there = set(list_names(self.spark, f"{s.folder}/accepted"))
            paths += [f"{s.folder}/accepted/bucket={b}" for b in own if f"bucket={b}" in there]
        if not paths:
            return self.spark.createDataFrame([], ACCEPTED).drop("bucket")
        return self.spark.read.schema(ACCEPTED.rpartition(", ")[0]).parquet(*paths)

    def recall(self) -> DataFrame:
        """segment, family, part, codes, recall of each shard. Codes within the radius are equal in a slice, and those are all compared: nothing is missed."""
        held = [s for s in self.manifest().segments if s.parts]
        if not held:
            return self.spark.createDataFrame([], "segment int, family int, part int, codes bigint, recall double")
        return self._shards(held).select(*KEY, (F.length("codes") / 8).cast("bigint").alias("codes"), F.lit(1.0).alias("recall"))

    def matches(self) -> DataFrame:
        """batch, sha, code, accepted, kind: what the signatures of each batch repeat."""
        paths = [p for own in self.manifest().matches.values() for p in own]
        return self.spark.read.schema(MATCHES).parquet(*paths) if paths else self.spark.createDataFrame([], MATCHES)

    def add(self, batch: int, media: DataFrame) -> None:
        """Accept what is new in a batch (node, sha, code) and store its matches, as one commit.

        ``node`` identifies a media and orders the batch; those of later batches must be greater.
        A match joins a signature of the batch with an accepted node of an earlier batch or of this
        one; a media repeats those that come before it. Raises ValueError if the batch is in the
        index and FileExistsError if another writer commits first; the index then stays as it was.
        """
        before = self.manifest()
        if batch in before.batches:
            raise ValueError(f"batch {batch} is in the index")
        attempt = f"{self.root}/segments/{before.version + 1:08d}-{uuid.uuid4().hex}"
        name, radius = f"batch{batch}", self.radius
        signatures = media.groupBy("sha", "code").agg(F.min("node").alias("node")).where("sha is not null or code is not null")
        signatures = self.work.save(signatures, f"{name}_signatures")
        slot = F.pmod(F.xxhash64("sha"), F.lit(MOST_BUCKETS)).cast("int")
        most = max([1, *(s.buckets for s in before.segments)])
        n = signatures.agg(
            F.count("*").alias("signatures"), F.count("code").alias("codes"), F.collect_set(F.when(F.col("sha").isNotNull(), slot % most)).alias("touched")
        ).head()
        codes = signatures.where("code is not null").select("code").distinct()
        found, known = [], None
        if before.segments and n["signatures"]:
            matched = self._lookup(signatures, codes, n["codes"], before.segments, n["touched"])
            self._save(matched, batch, f"{attempt}/matches-history")
            found.append(f"{attempt}/matches-history")
            known = self.spark.read.schema(MATCHES).parquet(found[0]).select(F.col("sha").alias("s"), F.col("code").alias("c")).distinct()
        repeats = None if known is None else F.col("sha").eqNullSafe(F.col("s")) & F.col("code").eqNullSafe(F.col("c"))

        segment = Segment(before.next_segment, 0, n["codes"], n["signatures"], _buckets(n["signatures"]), attempt)
        if n["codes"]:
            layout = Layout.of(segment.segment, n["codes"], self.capacity, radius)
            segment.families, segment.parts = layout.families, layout.parts
        if n["signatures"] <= SMALL_BATCH:
            fresh = F.lit(True) if known is None else F.col("found").isNull()
            asked = signatures if known is None else signatures.join(known.withColumn("found", F.lit(True)), repeats, "left")
            asked = asked.select("node", "sha", F.coalesce("code", F.lit(0)).alias("code"), F.col("code").isNotNull().alias("coded"), fresh.alias("fresh"))
            decided = self.work.save(asked.coalesce(1).mapInPandas(small_batch.decide(radius), small_batch.OUT), f"{name}_decided")
            kept, own = decided.where("kind = 'kept'").select(F.col("accepted").alias("node"), "sha", "code"), decided.where("kind <> 'kept'")
        else:
            new = signatures if known is None else signatures.join(known, repeats, "left_anti")
            # Numbered in the order of the nodes: ids increase within a sorted partition and from one to the next.
            new = self.work.save(new.orderBy("node").withColumn("rank", F.monotonically_increasing_id()), f"{name}_new")
            kept, own = self._decide(new, segment.layout(), n["codes"], name), None
        self._keep(kept, segment)
        if segment.parts:
            self._store(build_segment(kept.where("code is not null").select("code"), segment.layout(), self.capacity), segment)
        self._save(own or self._lookup(signatures, codes, n["codes"], [segment], None), batch, f"{attempt}/matches-own")
        found.append(f"{attempt}/matches-own")

        after = Manifest(before.version + 1, before.next_segment + 1, [*before.batches, batch], [*before.segments, segment], before.matches | {str(batch): found})
        gone = self._compact(after)
        publish_text(self.spark, f"{self.root}/manifest/{after.version:08d}.json", json.dumps(asdict(after)))
        for s in gone:
            for part in ("shards", "accepted"):
                delete(self.spark, f"{s.folder}/{part}")
        for part in (n for n in list_names(self.spark, self.work.root) if n.startswith(f"{name}_")):
            self.work.drop(part)

    def _save(self, matches: DataFrame, batch: int, path: str) -> None:
        matches.select(F.lit(batch).alias("batch"), "sha", "code", "accepted", "kind").write.option("compression", "zstd").parquet(path)

    def _lookup(self, signatures: DataFrame, codes: DataFrame, count: int, segments: list[Segment], touched: list[int] | None) -> DataFrame:
        """sha, code, accepted, kind: accepted media of the segments that match a signature."""
        same = self._accepted(segments, touched).where("sha is not null").select("sha", F.col("node").alias("accepted"))
        found = signatures.where("sha is not null").join(same, "sha").select("sha", "code", "accepted", F.lit("exact").alias("kind"))
        held = [s for s in segments if s.parts]
        if held and count:
            hits = search_shards(self._shards(held), [s.layout() for s in held], sum(s.codes for s in held), codes, count, self.radius)
            owners = self._accepted(segments).where("code is not null").select(F.col("code").alias("hit"), F.col("sha").alias("other"), F.col("node").alias("accepted"))
            # A pair that is equal by digest is exact only. An accepted signature is matched by its own copies.
            near = signatures.join(hits.join(owners, "hit"), "code").where("sha is null or other is null or sha <> other")
            found = found.unionByName(near.select("sha", "code", "accepted", F.lit("near").alias("kind")))
        return found

    def _store(self, shards: DataFrame, segment: Segment) -> None:
        shards.write.option("compression", "zstd").parquet(f"{segment.folder}/shards")

    def _keep(self, kept: DataFrame, segment: Segment) -> None:
        bucket = F.pmod(F.xxhash64("sha"), F.lit(segment.buckets)).cast("int")
        kept.select("node", "sha", "code", bucket.alias("bucket")).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{segment.folder}/accepted")

    def _decide(self, new: DataFrame, layout: Layout, count: int, name: str) -> DataFrame:
        """node, sha, code that a pass over ``new`` in node order accepts.

        In each round a signature is accepted if it comes first among the undecided ones it conflicts
        with, and rejected if it conflicts with an accepted one. Searches return the least owner of
        the hits only, so what a round moves is one row a signature, however alike they are. Codes
        without another one nearby are searched for once; those accepted matter to the next round
        only, which rejects all that conflict with them.
        """
        state = new.select("sha", "code", "node", "rank", F.lit(None).cast("boolean").alias("kept"), F.lit(True).alias("crowded"))
        accepted: list[DataFrame] = []
        turn = 0
        while True:
            undecided = state.where("kept is null")
            running = state.where("kept is null or kept").withColumn("owner", F.when(F.col("kept"), F.col("rank") - KEPT).otherwise(F.col("rank")))
            by_sha = running.where("sha is not null").groupBy("sha").agg(F.min("owner").alias("same"))
            by_code = running.where("code is not null").groupBy("code").agg(F.min("owner").alias("owner"), F.max("crowded").alias("crowded"))
            rivals = undecided.drop("crowded").join(by_sha, "sha", "left").join(by_code.select("code", "owner"), "code", "left")
            if layout.parts:
                shards = build_segment(by_code.where("crowded").select("code", "owner"), layout, self.capacity)
                asked = undecided.where("code is not null and crowded").select("code").distinct()
                near = search_shards(shards, [layout], count, asked, count, self.radius, least_owner=True).groupBy("code").agg(F.min("hit").alias("near"))
                rivals = rivals.join(near, "code", "left")
            else:
                rivals = rivals.withColumn("near", F.lit(None).cast("bigint"))
            rivals = rivals.select("sha", "code", "node", "rank", F.least("same", "owner", "near").alias("first"), F.col("near").isNotNull().alias("crowded"))
            rivals = self.work.save(rivals, f"{name}_rivals{turn}")
            leaders = rivals.where("first = rank").select(F.col("rank").alias("leader"))
            marked = rivals.join(leaders, F.col("first") == F.col("leader"), "left")
            verdict = F.when(F.col("first") == F.col("rank"), True).when((F.col("first") < 0) | F.col("leader").isNotNull(), False)
            state = self.work.save(marked.select("sha", "code", "node", "rank", verdict.alias("kept"), "crowded"), f"{name}_state{turn}")
            accepted.append(state.where("kept").select("node", "sha", "code"))
            if state.where("kept is null").isEmpty():
                return reduce(DataFrame.unionByName, accepted)
            turn += 1

    def _compact(self, after: Manifest) -> list[Segment]:
        """Merges the segments of a level once there are ``fan_in`` of them, into one of the next level with accepted codes only; returns those replaced."""
        gone: list[Segment] = []
        while True:
            by: dict[int, list[Segment]] = {}
            for s in after.segments:
                by.setdefault(s.level, []).append(s)
            full = next((own for own in by.values() if len(own) >= self.fan_in), None)
            if full is None:
                return gone
            accepted = self._accepted(full)
            n = accepted.agg(F.count("*").alias("accepted"), F.count("code").alias("codes")).head()
            folder = f"{self.root}/segments/{after.version:08d}-{uuid.uuid4().hex}"
            merged = Segment(after.next_segment, full[0].level + 1, n["codes"], n["accepted"], _buckets(n["accepted"]), folder)
            self._keep(accepted, merged)
            if n["codes"]:
                layout = Layout.of(merged.segment, n["codes"], self.capacity, self.radius)
                merged.families, merged.parts = layout.families, layout.parts
                self._store(build_segment(accepted.where("code is not null").select("code"), layout, self.capacity), merged)
            after.segments = [s for s in after.segments if s not in full] + [merged]
            after.next_segment += 1
            gone += full


def repeated_media(media: DataFrame, metadata: DataFrame, radius: int = 4, capacity: int = 8192, fan_in: int = 4) -> DataFrame:
    """mediaIdA, mediaIdB, matchKind of all batches in order: media not accepted and the accepted they match.

    The batches are added to an empty index one by one. Media without valid digest and code match
    nothing. Empty tables give no rows.
    """
    spark = media.sparkSession
    work = Workspace(spark, "history")
    order = F.concat(F.lpad((F.col("batch").cast("bigint") + 2**31).cast("string"), 10, "0"), F.lit("|"), F.col("mediaId"))
    known = media_signatures(media, metadata).where("sha is not null or code is not null").withColumn("node", order)
    known = work.save(known.sortWithinPartitions("batch"), "media")  # row groups hold few batches
    index = HistoryIndex(spark, work.path("index"), radius, capacity, fan_in)
    for batch in sorted(r[0] for r in known.select("batch").distinct().collect()):  # one row a batch
        index.add(batch, known.where(F.col("batch") == batch).select("node", "sha", "code"))
    matches = index.matches().withColumnsRenamed({"batch": "b", "sha": "s", "code": "c"})
    same = (F.col("batch") == F.col("b")) & F.col("sha").eqNullSafe(F.col("s")) & F.col("code").eqNullSafe(F.col("c")) & (F.col("accepted") < F.col("node"))
    pairs = known.join(matches, same).select("mediaId", F.expr("substr(accepted, 12)").alias("other"), F.col("kind").alias("matchKind"))
    return pairs.select(F.least("mediaId", "other").alias("mediaIdA"), F.greatest("mediaId", "other").alias("mediaIdB"), "matchKind").distinct()
