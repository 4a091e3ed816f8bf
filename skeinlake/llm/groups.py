"""Connected groups of pairwise links by Boruvka rounds.

In every round each component selects its smallest outgoing edge and hooks onto the component at
the other end. Edges are ordered by (smaller label, greater label), so the selected edges form
trees apart from pairs that selected the same edge, of which the smaller becomes the root. Trees
collapse by pointer doubling, edges are relabelled and deduplicated, and rounds end when none is
left. At least half of the components that have edges vanish in each round, and a round touches
only those.

Labels are 64-bit hashes of the members; they are checked to be free of collisions before use.
Every intermediate result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.text import strip
from skeinlake.plans.staging import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root for the nodes of ``edges`` (columns u, v of bigint) that are linked with another; self-loops may occur.

    Each round handles only what still has edges. Where its components go is stored once, and the
    rounds' maps, each at most half of the one before, are put together at the end.
    """
    current = work.save(_ordered(edges), "edges0")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        turn = len(maps)
        parents = _collapse(_hook(current), work, turn)
        ends = current.join(parents.select(F.col("c").alias("u"), F.col("p").alias("pu")), "u").join(
            parents.select(F.col("c").alias("v"), F.col("p").alias("pv")), "v"
        )
        current = work.save(_ordered(ends.select(F.col("pu").alias("u"), F.col("pv").alias("v"))), f"edges{turn + 1}")
        work.drop(f"edges{turn}")
        maps.append(parents)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    whole = maps[-1]
    for parents in reversed(maps[:-1]):
        later = whole.select(F.col("c").alias("p"), F.col("p").alias("root"))
        whole = parents.join(later, "p", "left").select("c", F.coalesce("root", "p").alias("p"))
    return whole.select(F.col("c").alias("node"), F.col("p").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges with the smaller label first, without self-loops and repetitions."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """c, p: each component and the one at the other end of its smallest edge; a root is its own parent."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("c"), F.struct("u", "v").alias("e"))
    # The least edge in two plain minima, which are combined before they are shuffled.
    first = ends.groupBy("c").agg(
        F.min(F.when(F.col("e.u") < F.col("c"), F.col("e.u"))).alias("below"),
        F.min(F.when(F.col("e.u") == F.col("c"), F.col("e.v"))).alias("above"),
    )
    chosen = first.select("c", F.coalesce("below", "above").alias("p"))
    back = chosen.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    both = chosen.join(back, "p")
    mutual = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
    return both.select("c", F.when(mutual, F.col("c")).otherwise(F.col("p")).alias("p"))


def _collapse(parents: DataFrame, work: Workspace, turn: int) -> DataFrame:
    """Parents after pointer doubling: every component points at the root of its tree.

    Components that reached their root stay where they were stored; only the others go on.
    """
    step = work.save(parents.withColumn("moved", F.lit(True)), f"parents{turn}_0")
    settled: DataFrame | None = None
    count = 0
    while True:
        live = step.where("moved").select("c", "p")
        every = live if settled is None else live.unionByName(settled)
        up = every.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        count += 1
        step = work.save(live.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), f"parents{turn}_{count}")
        done = step.where("not moved").select("c", "p")
        settled = done if settled is None else settled.unionByName(done)
        if step.where("moved").isEmpty():
            return settled


def groups(pairs: DataFrame) -> DataFrame:
    """scope, memberId, groupId: members linked directly or through others inside their scope.

    ``pairs`` has columns scope, a, b of strings. Rows with a null tie nothing; a pair of equal
    members makes a group of one. groupId is the smallest member of the group.
    """
    work = Workspace(pairs.sparkSession, "groups")
    named = work.save(pairs.select("scope", "a", "b").where("scope is not null and a is not null and b is not null").distinct(), "pairs")
    members = named.select("scope", F.explode(F.array("a", "b")).alias("memberId")).distinct()
    seed = 0
    while True:
        hashed = work.save(members.select("scope", "memberId", F.xxhash64(F.lit(seed), "scope", "memberId").alias("node")), f"members{seed}")
        if hashed.groupBy("node").count().where("count > 1").isEmpty():
            break
        work.drop(f"members{seed}")
        seed += 1
    edges = named.select(F.xxhash64(F.lit(seed), "scope", "a").alias("u"), F.xxhash64(F.lit(seed), "scope", "b").alias("v"))
    found = components(edges, work)
    labelled = hashed.join(found, "node", "left").select("scope", "memberId", F.coalesce("root", "node").alias("root"))
    labelled = work.save(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("memberId").alias("groupId"))
    return labelled.join(least, "root").select("scope", "memberId", "groupId")


#: Levels in order; each includes the ones before it.
LEVELS = ("exact", "strong", "probable")


def link_pairs(links: DataFrame, media: DataFrame) -> DataFrame:
    """scope (level), a, b: pairs tied at each level, own entries of linked media included.

    Level is read trimmed in lower case. A media and its own entry are tied if either is in a link
    of that selection.
    """
    read = links.select(F.lower(strip("level")).alias("level"), F.col("mediaId").alias("a"), F.col("sourceEntryId").alias("b"))
    read = read.where(F.col("level").isin(*LEVELS) & F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    included = F.create_map(*[x for i, level in enumerate(LEVELS) for x in (F.lit(level), F.array(*[F.lit(w) for w in LEVELS[i:]]))])
    tied = read.select(F.explode(F.try_element_at(included, F.col("level"))).alias("scope"), "a", "b").distinct()
    own = media.select(F.col("mediaId").alias("a"), F.col("sourceEntryId").alias("b")).where("a is not null and b is not null").distinct()
    by_media = tied.select("scope", "a").distinct().join(own, "a").select("scope", "a", "b")
    by_entry = tied.select("scope", "b").distinct().join(own, "b").select("scope", "a", "b")
    return tied.unionByName(by_media).unionByName(by_entry)


def link_groups(links: DataFrame, media: DataFrame) -> DataFrame:
    """level, memberId, groupId of every media and entry tied at each level."""
    return groups(link_pairs(links, media)).withColumnRenamed("scope", "level")
