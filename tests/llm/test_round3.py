"""Whitening, ranked search and packing against plain versions, and their awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantaloom.llm import lexical, packing, queries, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- 11

@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from(["full", "low", "tied", "ones", "diagonal", "none"]))
def test_leading(n, seed, kind):
    rng = np.random.default_rng(seed)
    b = rng.standard_normal((n, n if kind == "full" else max(1, n // 3)))
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = {"full": b @ b.T, "low": b @ b.T, "tied": q @ np.diag(np.arange(n) // 3 * 1.0) @ q.T, "ones": np.ones((n, n)), "diagonal": np.diag(np.arange(n) * 1.0), "none": np.zeros((n, n))}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, min(n, 8))
    true = np.linalg.eigvalsh(a)[::-1][: len(values)]
    size = max(1.0, np.abs(a).max())
    assert np.abs(values - true).max() < 1e-12 * size * n
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size * n
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    d, e = np.array([2.0, 1.0, 3.0, 0.5]), np.array([1.0, 0.5, 0.25])
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-2, 5, 50)
    assert whitening.below(d, e, at).tolist() == [(true < x).sum() for x in at]


def plain_whitening(rows, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return n, [int(((n * row - s) ** 2).sum()) for row in x], e[::-1][:k], centred @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), np.trace(cov)


def test_whitening_registered(spark):
    found = queries.QUERIES["op11_whitening"](spark, SF).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, values, white, trace = plain_whitening(rows)
    assert len(found) == n * 32 and (found["n"] == n).all()
    by = found.sort_values(["vec_id", "component"])
    mine = by["whitened"].to_numpy().reshape(n, 32)
    assert by["deviation"].to_numpy().reshape(n, 32)[:, 0].tolist() == deviation
    assert np.allclose(by["explained"].to_numpy().reshape(n, 32)[0], values / trace, rtol=1e-9)
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-7
    assert np.abs(mine.T @ mine / n - np.eye(32)).max() < 1e-9
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_whitening_awkward(spark):
    rng = random.Random(3)
    good = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)]
    rows = [(i, v) for i, v in enumerate(good)] + [(1, good[1]), (None, good[2]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1e300, 0.0, 0.0])]
    rows += [(60, [1.0, 2.0]), (61, [1.0, 2.5])] + [(70, [3.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened double, n int, d string").repartition(3)
    found = whitening.whitened_components(df).toPandas()
    assert len(found[found["n"] == 22]) == 22 * 3  # whole list of three entries, a repeated row and one without an id too
    assert len(found[found["n"] == 2]) == 2  # of two dimensions only one varies
    assert not set(found["vec_id"].dropna()) & {50, 51, 52, 53, 54, 55, 70}
    assert found["identity_error"].max() < 1e-9
    assert whitening.whitened_components(df.where("false")).count() == 0


def test_deviation_beyond_64_bits():
    f = whitening.Fit(10**6, [3 * 10**6 + 1, 5])
    x = np.array([[4, 1], [10**7, 2]], np.int64)
    n, s = 10**6, [3 * 10**6 + 1, 5]
    true = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    assert f.deviation(x) == [v if v < 2**63 else None for v in true] and f.deviation(x)[1] is None


# ---------------------------------------------------------------- 12

def plain_ranking(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term.findall((text or "").translate(low))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranking_against_plain(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 300)
    rng = random.Random(2)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]
    pick = lambda n: " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "...!"), (3, docs[3][1]), (None, docs[5][1]), (2003, pick(20_000))]
    items = [(i, pick(rng.randint(1, 15))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere else"), (103, words[0]), (4, items_text := pick(5)), (4, items_text)]
    frame = spark.createDataFrame([(i, t, 1, "x", 9) for i, t in docs], "doc_id long, text string, score int, terms string, item_id int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    mine = lambda **a: sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.rank(frame, asked, **a).collect()), key=str)
    true = plain_ranking(docs, items)
    assert mine() == true
    assert mine(item_bytes=200) == true  # several groups of items
    assert lexical.rank(frame.where("false"), asked).count() == 0 and lexical.rank(frame, asked.where("false")).count() == 0


def test_pair_bounds_hold_and_tighten():
    rng = np.random.default_rng(4)
    doc, term = np.divmod(np.unique(rng.integers(0, 2000 * 8, 4000)), 8)
    impact = rng.integers(1, 1000, len(doc)) * (term + 1)
    terms = list(range(8))
    pairs = lexical.pairs_of(terms, np.bincount(term, minlength=8).tolist())
    index = lexical.Index(doc, term, impact, set(pairs))
    full = np.bincount(doc, impact, minlength=2000).astype(int)
    for pair, (both, joint) in index.joint.items():
        own = [int(impact[(term == t) & (doc == d)].sum()) for d in both for t in pair]
        assert joint == max((a + b for a, b in zip(own[::2], own[1::2])), default=0)
        assert index.bound(pair) <= index.most[pair[0]] + index.most[pair[1]]
    units = index.units(terms, pairs)
    assert sorted(t for _, own in units for t in own) == terms
    assert full.max() <= sum(b for b, _ in units) <= sum(index.most.values())
    assert sum(b for b, _ in units) < sum(index.most.values())  # some pairs never are at their best together
    for least in (0, 500, 3000, int(np.sort(full)[-10]), int(full.max()), int(full.max()) + 1):
        docs, scores = lexical.search(index, terms, pairs, least)
        good = np.flatnonzero(full >= max(1, least))
        assert docs.tolist() == good.tolist() and scores.tolist() == full[good].tolist()


# ---------------------------------------------------------------- 13

def plain_pieces(docs, capacity):
    t, out = Tokenizer.from_file(PATH), []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=str)


def check_packing(found, docs, capacity, slack=1.02):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == plain_pieces(docs, capacity)
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in found)
    least = max(-(-total // capacity), sum(r["length"] > capacity // 2 for r in found))
    assert len(held) <= least * slack + 1


def test_packing_awkward(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    extra = [(900, "it's we're 'll x' '' don't <|endoftext|> <| a<|startoftext|>b"), (901, "a\x1cb \x1f c"), (902, "ΑΣ ς Σ İ ﬁ é Å １２3 ²"), (903, "  lead, and trail... 12,345 ")]
    frame = docs.select("doc_id", "text", "size", "comp").unionByName(spark.createDataFrame([(i, t, "s", 1) for i, t in extra], "doc_id long, text string, size string, comp int"))
    for capacity in (2048, 16):
        check_packing(packing.pack(frame, PATH, capacity=capacity).collect(), rows + extra, capacity, 1.1)
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_packing_registered(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    one, two = (sorted(map(tuple, queries.QUERIES["op13_packing"](spark, SF).collect())) for _ in range(2))
    assert one == two
    check_packing(queries.QUERIES["op13_packing"](spark, SF).collect(), docs, 2048)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=30), st.integers(0, 12))
def test_configurations(histogram, rounds):
    lengths, counts = np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64)
    found = packing.configurations(lengths, counts, 60, rounds)
    used = np.zeros(len(lengths), int)
    for config, n in found:
        assert n > 0 and sum(int(lengths[i]) * c for i, c in config.items()) <= 60
        for i, c in config.items():
            used[i] += c * n
    assert (used == counts).all()


def test_knapsack_finds_the_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths, most = rng.permutation(np.arange(1, 13))[:5], rng.integers(1, 4, 5)
        value = rng.random(5)
        best = {0: 0.0}
        for copies in np.ndindex(*(most + 1)):
            size = int((np.array(copies) * lengths).sum())
            best[size] = max(best.get(size, 0.0), float((np.array(copies) * value).sum()))
        rooms = np.arange(31)
        found = packing.Knapsack(value, most, lengths, 30).best(rooms)
        assert (found <= most).all() and (found @ lengths <= rooms).all()
        for room in rooms.tolist():
            assert abs(float(found[room] @ value) - max(v for s, v in best.items() if s <= room)) < 1e-9


@pytest.mark.parametrize("capacity", [2048])
def test_program_carries_large_histograms(capacity):
    rng = np.random.default_rng(1)
    drawn = np.minimum(rng.exponential(500, 2_000_000).astype(int) + 1, capacity)
    counts = np.bincount(drawn, minlength=capacity + 1)
    lengths = np.flatnonzero(counts)
    found = packing.configurations(lengths, counts[lengths], capacity)
    assert sum(n for _, n in found) <= 1.001 * max(-(-int(drawn.sum()) // capacity), int((drawn > capacity // 2).sum()))
    assert len(packing.runs(lengths, found)) < 100_000  # the plan doesn't grow with rows
