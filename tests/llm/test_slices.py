"""Comparing codes by slices of their bits, and batches decided in one task or in rounds."""

import time

import brute
import numpy as np
import pytest
import test_corpus as corpus

from skeinlake.llm import history_index, slices


def test_slices_miss_nothing_and_repeat_nothing():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    codes[:1500] = codes[0] ^ (codes[:1500] & np.uint64(0xFFFF))  # crowded cells
    codes = np.unique(codes)
    queries = codes[rng.integers(0, len(codes), 1000)]
    for _ in range(5):
        queries ^= np.uint64(1) << rng.integers(0, 64, len(queries)).astype(np.uint64)
    got = []
    for family in range(5):
        held = codes[slices.by_cell(codes, family, 5)]
        got += [(int(queries[i]), int(held[j])) for q, n in slices.near(queries, held, family, 5, 4) for i, j in zip(q, n)]
    near = np.bitwise_count(queries[:, None] ^ codes[None, :]) <= 4
    assert sorted(got) == sorted((int(queries[i]), int(codes[j])) for i, j in zip(*np.nonzero(near)))
    with pytest.raises(ValueError):
        next(slices.near(queries, codes, 0, 4, 4))


@pytest.mark.parametrize(("capacity", "small", "sent"), [(8192, 0, 1 << 25), (16, 0, 0), (16, 60, 1 << 25)])
def test_rounds_of_joins(spark, capacity, small, sent, monkeypatch):
    """All batches decided in rounds, and only the larger of them."""
    monkeypatch.setattr(history_index, "SMALL_BATCH", small)
    monkeypatch.setattr(history_index, "SENT_BYTES", sent)
    media, meta = corpus.history(2, 300)
    got = history_index.repeated_media(spark.createDataFrame(media, corpus.MEDIA), spark.createDataFrame(meta, corpus.META), capacity=capacity, fan_in=2)
    assert corpus.tuples(got) == brute.p2(*corpus.named(media, meta))


def test_batches_of_forty_thousand_codes(spark, tmp_path):
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(-(2**63), 2**63, 40_000, dtype=np.int64))
    index = history_index.HistoryIndex(spark, str(tmp_path))
    began = time.time()
    for batch, own in ((0, codes), (1, codes ^ (1 << rng.integers(0, 63, len(codes))))):
        index.add(batch, spark.createDataFrame([(f"{batch}|{i:06d}", None, int(c)) for i, c in enumerate(own)], corpus.BATCH))
    took = time.time() - began
    assert {r["accepted"] for r in index.matches().where("batch = 1").collect()} == {f"0|{i:06d}" for i in range(len(codes))}
    assert took < 60
