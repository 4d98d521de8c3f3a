"""Delta codes of keys beyond 32 bits."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quantaloom.operators import compressors, delta


def both_ways(spark, rows):
    gaps = delta.gaps(spark.createDataFrame(rows, "group long, key long"))
    return [sorted((r.group, r.pos, r.key) for r in back.collect()) for back in (delta.decode(delta.encode(gaps)), delta.decode_bytes(delta.encode_bytes(gaps)))]


def true(rows):
    by = {}
    for g, k in sorted(rows):
        by.setdefault(g, []).append(k)
    return sorted((g, i, k) for g, ks in by.items() for i, k in enumerate(ks))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 2), st.one_of(st.integers(0, 2**62), st.integers(2**40, 2**40 + 99), st.integers(-(2**62), 2**33))), min_size=1, max_size=60))
def test_any_keys_come_back(spark, rows):
    rows = list(rows)
    assert both_ways(spark, rows) == [true(rows)] * 2


def test_edges_of_32_bits(spark):
    rows = [(0, k) for k in (5, 2**33 + 7, 2**33 + 9)] + [(1, k) for k in (2**32 - 1, 2**32, 2**33 - 1, 2**33, 2**33 + 2**32 - 1, 2**62)] + [(2, -(2**63)), (2, 2**63 - 1)]
    assert both_ways(spark, rows) == [true(rows)] * 2


@pytest.mark.parametrize("intervals,flag", [(1, "none"), (2, "fixed"), (2, "unary"), (4, "fixed"), (8, "unary"), (16, "fixed"), (16, "unary")])
def test_packing_in_pieces(monkeypatch, intervals, flag):
    rng = np.random.default_rng(intervals)
    gap = np.minimum((2.0 ** rng.uniform(0, 32, 5000)).astype(np.int64), 2**32 - 1)
    bits = np.array([int(g).bit_length() for g in gap])
    payload = np.packbits(delta._bits(*delta._codes(gap, bits, intervals, flag))).tobytes()
    plain = "".join(f"{int(v):0{n}b}" for v, n in zip(*delta._codes(gap, bits, intervals, flag)) if n)
    assert payload == int(plain.ljust(-(-len(plain) // 8) * 8, "0"), 2).to_bytes(-(-len(plain) // 8), "big")
    for held in (256, 1 << 20):
        monkeypatch.setattr(delta, "BITS", held)
        assert (delta.unpacked(payload, len(gap), intervals, flag) == gap).all()


def test_gaps_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="32 bits"):
        delta._codes(np.array([1 << 32]), np.array([33]), 2, "fixed")


def test_sparse_vectors_with_long_keys(spark):
    rng = np.random.default_rng(3)
    keys = sorted({int(k) for k in rng.integers(0, 2**62, 300)} | {2**62 + i for i in range(50)})
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(keys, rng.normal(size=len(keys)))], "key long, value double")
    assert sorted(r.key for r in compressors.compress_sparse(df, bins=32).decompress().collect()) == keys
