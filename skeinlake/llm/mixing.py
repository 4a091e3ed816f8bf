"""Mixing sources to target shares by balanced sampling with the cube method.

Each source needs an expected number of copies per document; its whole part is taken for every
document, its fraction is the probability of one more. The flight phase moves the probabilities of
a few documents at a time along a direction that leaves the number of documents and the number of
tokens unchanged, until one of them is 0 or 1. A source's documents fly in blocks; what stays
fractional in a block (at most as many as there are constraints) flies again with that of other
blocks until one block is left, and only its few last probabilities are landed by giving up the
constraints one after the other.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.text import strip
from skeinlake.plans.staging import Workspace

#: Where the vocabulary files lie on the driver, the one that is counted with, and the most bytes that are sent to the executors.
TOKENIZER_FOLDER, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
MOST_VOCABULARY = 64 << 20
#: Fixed value: the pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, key: str, text: str, source: str, folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> DataFrame:
    """id, source (trimmed, lower case), tokens of each row with id, text and source.

    The driver reads the vocabulary, of at most ``MOST_VOCABULARY`` bytes, and sends it to the executors.
    """
    with open(f"{folder}/{name}", "rb") as file:
        vocabulary = file.read(MOST_VOCABULARY + 1)
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"{name} is larger than a vocabulary may be")
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    rows = documents.select(F.col(key).alias("id"), F.lower(strip(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.where("id is not null and text is not null and source <> ''")
    return rows.mapInPandas(run, f"id {documents.schema[key].dataType.simpleString()}, source string, tokens long")


def fly(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator, constraints: int = 2) -> np.ndarray:
    """Probabilities after a flight that keeps their sum and, with two constraints, their sum weighted by tokens.

    At most ``constraints`` of the result lie strictly between 0 and 1.
    """
    p = p.astype(float).copy()
    scale = max(1.0, float(np.abs(tokens).max())) if len(tokens) else 1.0
    x = tokens / scale
    eps = 1e-9
    waiting = iter(np.nonzero((p > eps) & (p < 1 - eps))[0].tolist())
    held: list[int] = []
    draws = iter(())
    while True:
        while len(held) <= constraints and (nxt := next(waiting, None)) is not None:
            held.append(nxt)
        if len(held) <= constraints:
            return p
        if constraints == 2:
            a, b, c = (x[i] for i in held)
            u = [b - c, c - a, a - b]
            if max(map(abs, u)) < 1e-12:  # equal sizes: any direction that keeps the sum
                u = [1.0, -1.0, 0.0]
        else:
            u = [1.0, -1.0] if constraints else [1.0]
        up = down = math.inf
        for i, v in zip(held, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, v in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        held = [i for i in held if eps < p[i] < 1 - eps]


def land(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each: the constraints are given up one by one, the number of documents last."""
    for constraints in (2, 1, 0):
        p = fly(p, tokens, rng, constraints)
    return np.round(p)


def _flight(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        rng = np.random.default_rng([seed, level, zlib.crc32(str(key[0]).encode()), int(key[1])])
        p, tokens = rows["p"].to_numpy(dtype=float), rows["tokens"].to_numpy(dtype=float)
        return rows.assign(p=(land if last else fly)(p, tokens, rng)).drop(columns=["block", "at"])

    return run


def balanced_extras(documents: DataFrame, work: Workspace, seed: int, block: int = 4096) -> DataFrame:
    """id, source, tokens, p with p 0 or 1, from documents with probabilities p."""
    decided, level = [], 0
    now = work.save(documents.select("id", "source", "tokens", "p"), "flight0")
    kind = documents.schema["id"].dataType.simpleString()
    while True:
        most = now.groupBy("source").count().agg(F.max("count")).first()[0]
        if not most:
            break
        blocks = math.ceil(most / block)
        placed = now.withColumns({"at": F.xxhash64("id", F.lit(seed + level)), "block": F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), F.lit(blocks)).cast("int")})
        flown = placed.groupBy("source", "block").applyInPandas(_flight(seed, level, blocks == 1), f"id {kind}, source string, tokens long, p double")
        flown = work.save(flown, f"flight{level + 1}")
        decided.append(flown.where("p <= 1e-9 or p >= 1 - 1e-9").withColumn("p", F.round("p")))
        if blocks == 1:
            break
        now = flown.where("p > 1e-9 and p < 1 - 1e-9")
        level += 1
    out = decided[0] if decided else now
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 7, folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, tokens, copies with copies of at least 1) and the report of its shares.

    ``targets`` (source, weight, max_repeats) is a short list read by the driver: repeated sources
    are added up, the smallest max_repeats counts, weights and repeats not above 0 leave a source
    out. Weights are shares of their sum. ``total`` is the wanted size in tokens; without it, the
    largest size at which every source that has documents meets its share within its repeats. A
    source that can't supply its share gives all it may, and the report shows by how much it
    falls short. Documents of sources that aren't listed, or without id, text or source, are left out.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "mixing")
    counted = work.save(token_counts(documents, key, text, source, folder, name), "counted")
    wanted = targets.select(F.lower(strip("source")).alias("source"), "weight", "max_repeats").where("weight > 0 and max_repeats > 0 and source <> ''")
    wanted = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("repeats"))
    held = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    plan = wanted.join(held, "source", "left").toPandas().fillna({"documents": 0, "tokens": 0}).sort_values("source")
    plan["wanted_share"] = plan["weight"] / plan["weight"].sum()
    has = plan["tokens"] > 0
    if total is None:
        total = float((plan["repeats"] * plan["tokens"] / plan["wanted_share"])[has].min()) if has.any() else 0.0
    plan["per_document"] = np.where(has, np.minimum(plan["repeats"], total * plan["wanted_share"] / plan["tokens"].where(has, 1)), 0.0)
    rates = spark.createDataFrame([(r.source, float(r.per_document)) for r in plan.itertuples()], "source string, rate double")

    rows = counted.join(rates, "source").withColumn("whole", F.floor(F.col("rate") + 1e-9))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    extras = balanced_extras(rows.where("p > 1e-9"), work, seed)
    chosen = extras.where("p = 1").select("id", "source", "tokens", F.lit(1).cast("bigint").alias("copies"))
    base = rows.where("whole > 0").select("id", "source", "tokens", F.col("whole").alias("copies"))
    mixed = work.save(base.unionByName(chosen).groupBy("id", "source", "tokens").agg(F.sum("copies").alias("copies")), "mix")

    shares = spark.createDataFrame(
        [(r.source, float(r.wanted_share), int(r.repeats), int(r.documents), int(r.tokens)) for r in plan.itertuples()],
        "source string, wanted_share double, max_repeats int, documents long, available_tokens long",
    )
    taken = mixed.groupBy("source").agg(F.count("*").alias("documents_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    everything = taken.agg(F.sum("tokens_used")).first()[0] or 0
    report = shares.join(taken, "source", "left").fillna(0, ["documents_used", "most_copies", "tokens_used"])
    share = F.col("tokens_used") / F.lit(float(everything)) if everything else F.lit(0.0)
    return mixed, report.withColumn("actual_share", share)
