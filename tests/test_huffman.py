"""Huffman codes of any alphabet against a plain heap."""

import heapq
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaloom.operators import delta, huffman


def plain_bits(counts):
    """Total bits: every merge adds a bit to all below it."""
    heap = list(counts)
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_codes_are_best_and_free_of_prefixes(counts):
    code = huffman.Code(list(enumerate(counts)))
    assert sorted(code.bits) == list(range(len(counts)))
    assert sum(n * len(code.bits[v]) for v, n in enumerate(counts)) == plain_bits(counts)
    held = sorted(code.bits.values())
    assert not any(b.startswith(a) for a, b in zip(held, held[1:]))
    if len(counts) > 1:
        assert sum(2.0 ** -len(b) for b in held) == 1


def test_lengths_of_steep_counts():
    fib = [1, 1]
    while len(fib) < 60:
        fib.append(fib[-1] + fib[-2])
    code = huffman.Code(list(enumerate(fib)))
    assert max(map(len, code.bits.values())) == 59 and sum(n * len(code.bits[v]) for v, n in enumerate(fib)) == plain_bits(fib)


@pytest.mark.parametrize("most,held", [(1 << 16, 1 << 20), (10, 512)])
def test_streams_come_back(spark, monkeypatch, most, held):
    monkeypatch.setattr(huffman, "MOST_SYMBOLS", most)
    monkeypatch.setattr(delta, "BITS", held)
    rng = np.random.default_rng(1)
    values = np.minimum(rng.geometric(0.03, 4000), 300) * 7 - 50
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(4000) % 3, "pos": np.arange(4000), "v": values}))
    code = huffman.fit(df, "v")
    assert code.long == (most == 10)
    back = huffman.unpack(huffman.pack(df, "g", "pos", "v", code), "g", code).collect()
    assert sorted((r.g, r.pos, r.value) for r in back) == sorted((i % 3, i // 3, int(v)) for i, v in enumerate(values))
    assert huffman.total_bits(df, "v", code).first().total_bits == plain_bits(Counter(values.tolist()).values())
    assert huffman.decode(huffman.encode(df, "v", code), code).where("v = decoded").count() == 4000


def test_a_million_symbols(spark):
    df = spark.range(1_500_000).select(F.expr("case when id < 1000000 then id else pmod(id, 1000) * (1 + pmod(id, 3)) end").alias("v"))
    code = huffman.fit(df, "v")
    counts = Counter((np.where((i := np.arange(1_500_000)) < 1_000_000, i, i % 1000 * (1 + i % 3))).tolist())
    assert code.long and len(counts) == 1_000_000
    assert huffman.total_bits(df, "v", code).first().total_bits == plain_bits(counts.values())
    assert code.table.agg(F.count_distinct("code"), F.count("*"), F.count_distinct("index")).first() == (1_000_000,) * 3
