import numpy as np
import pytest

from quantaloom.llm import near_vectors, permutation_index
from quantaloom.llm.components import components, extended
from quantaloom.llm.hnsw import Graph


def odd_vectors(spark, seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = np.concatenate([centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.15, rng.normal(size=(n, dim))])
    rows = [(i, [float(v) for v in x[i]], int(i % 3), 5, "k") for i in range(len(x))]
    rows += [(2000 + i, rows[0][1], 0, 5, "k") for i in range(40)]  # copies
    bad = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), []]
    rows += [(3000 + i, b, 0, 5, "k") for i, b in enumerate(bad)]
    rows += [(3100, rows[0][1], None, 5, "k"), (None, rows[0][1], 0, 5, "k"), (3101, [1.0, 2.0], 0, 5, "k")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int, id string").repartition(4)


def test_near_vectors(spark):
    rows, df = odd_vectors(spark)
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i, *_ in ok}
    for a, (i, v, lab) in enumerate(ok):
        for j, w, other in ok[a + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)])
            if low != root[i]:
                root[i], changed = low, True
    assert len(got) == len(rows)
    for i, _, *_ in rows:
        r = got[i]
        assert (r.n_links, r.component_id) == ((len(links[i]), root[i]) if i in links else (0, i))
        assert r.kept == (i is None or r.component_id == i)


def test_no_vectors(spark):
    _, df = odd_vectors(spark, n=5)
    assert near_vectors.near_vectors(df.where("false")).count() == 0
    assert permutation_index.search(df.where("false"), df).count() == 0
    assert permutation_index.search(df, df.where("false")).count() == 0


def test_shards_meet(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARD", 40)
    rows, df = odd_vectors(spark, seed=2, n=120)
    few = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()}
    monkeypatch.setattr(near_vectors, "SHARD", 100_000)
    assert few == {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()}


def test_many_shards_and_a_hot_group(spark, monkeypatch):
    """A label with most rows, in many shards, with a large group of near copies across them, against brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x[100:500] = x[0] + rng.normal(size=(400, 24)) * 0.12
    labels = [0 if i < 600 else 1 for i in range(700)]
    monkeypatch.setattr(near_vectors, "SHARD", 60)
    monkeypatch.setattr(near_vectors, "BEAM", 8)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(700)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    assert got == {i: int(near[i].sum()) - 1 for i in range(700)}


def test_audits_leave_out_self_matches():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    g = Graph(x / np.linalg.norm(x, axis=1)[:, None])
    own = np.arange(20)
    good, links = near_vectors.passes(g, g.x[own], own, 0.93, 32)
    exact = (g.x[own] @ g.x.T >= 0.93).sum() - 20
    assert good and links == exact
    assert near_vectors.passes(g, g.x[own], np.full(20, -1), 0.93, 32)[1] == exact + 20


def test_graph_finds_all_of_a_dense_group():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32))
    x[300:700] = x[0] + rng.normal(size=(400, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Graph(x)
    r, c = g.within(x, 0.93, 32)
    assert len(r) == int((x @ x.T >= 0.93).sum())
    one = Graph(x[:1])
    assert one.within(x[:1], 0.9, 32)[0].tolist() == [0]


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1), (None, 2)], {}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}), ([(9, 3), (3, 9), (7, 8), (8, 3), (20, 21)], {3: 3, 9: 3, 7: 3, 8: 3, 20: 20, 21: 20}), ([(0, i) for i in range(1, 200)], {i: 0 for i in range(200)})])
@pytest.mark.parametrize("small", [0, 16_384])
def test_components(spark, edges, want, small, monkeypatch):
    monkeypatch.setattr("quantaloom.llm.components.SMALL", small)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in components(df).collect()} == want


def test_extended_components(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first, more = [(1, 2), (2, 3), (7, 8), (20, 21)], [(3, 8), (30, 31), (21, 40), (5, 5)]
    known = components(frame(first))
    assert {r.id: r.component for r in extended(known, frame(more)).collect()} == {r.id: r.component for r in components(frame(first + more)).collect()}
    assert sorted(map(tuple, extended(known, frame([])).collect())) == sorted(map(tuple, known.collect()))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in rng.normal(size=5 if i % 3 else 9)]) for i in range(90)] + [(200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id % 20 = 0"), k=4, recall=1.0).collect()
    want = set()
    for i, v in rows:
        if i % 20 == 0:
            best = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:4]
            want |= {(i, k + 1, j) for k, (_, j) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want


def test_permutation_index(spark):
    rows, df = odd_vectors(spark, seed=3, n=400)
    got = permutation_index.search(df, df.where("vec_id % 20 = 0"), k=20).collect()
    ok = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i, v in ok:
        if i % 20:
            continue
        best = sorted(((-float(v @ w), j) for j, w in ok if j != i and len(w) == len(v)))[:20]
        mine = sorted(by[i])
        assert [m[0] for m in mine] == list(range(1, 21)) and [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        assert all(s == pytest.approx(float(v @ dict(ok)[j])) for _, j, s in mine)
        hit += len({j for _, j in best} & {j for _, j, _ in mine})
        total += 20
    assert hit / total >= 0.9 and len(by) == sum(i % 20 == 0 for i, _ in ok)


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]


def test_permutation_index_of_many_blocks_and_a_hot_group(spark, monkeypatch):
    """Queries go to every block, and a large group of equal and near rows is dealt over blocks, against brute force."""
    monkeypatch.setattr(permutation_index, "BLOCK", 90)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 12))
    x[200:500] = x[1]
    x[500:620] = x[1] + rng.normal(size=(120, 12)) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(900)], "vec_id long, embedding array<double>")
    got = {}
    for r in permutation_index.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    found = 0
    for q, own in got.items():
        own = sorted(own)
        score = {j: float(np.dot(x[q], x[j])) for j in range(900) if j != q}
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(abs(score[j] - s) < 1e-9 for _, j, s in own)
        assert [(-round(s, 9), j) for _, j, s in own] == sorted((-round(s, 9), j) for _, j, s in own)
        least = sorted(score.values())[-20]
        found += sum(s >= least - 1e-9 for _, _, s in own)
    assert found >= 0.9 * 20 * len(got)


def test_models_are_learned_in_a_task(spark):
    from quantaloom.llm.common import learned

    df = spark.range(1000).selectExpr("id", "cast(id as string) as t").repartition(7)
    assert learned(df, lambda t: (len(t), sum(t.column("id").to_pylist()), t.schema.names)) == (1000, 499_500, ["id", "t"])
    assert learned(df.where("false"), lambda t: (len(t), t.schema.names)) == (0, ["id", "t"])
