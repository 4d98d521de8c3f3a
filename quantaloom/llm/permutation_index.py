"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded seeded sample of the vectors. Each vector is represented by its nearest pivots in order; inverted
files list, for each pivot, the vectors that have it among theirs, with its place. A query goes to the files of its own
nearest pivots, vectors are ranked by Spearman's footrule between the two orders (with a fixed place for a pivot that
one of them lacks), and the best are ranked again by the exact inner product in double precision.

Largest inner product is nearest distance once every vector gets one more component that brings it to the largest norm;
pivots and permutations use those.

Rows are dealt to blocks by a hash of their id, each with its own inverted files, so that no block holds a group of
copies, and each block sees every query (a stated query set against all rows, in blocks). Within a block equal vectors
are posted once and expanded to their smallest ids. How many vectors are ranked again is no fixed number: an audit takes
queries by the smallest hashes of their ids, up to AUDIT of them, compares with brute force over all rows, and doubles
the share until recall passes; at a share of 1 the search is exact.

Vectors of each length are an index of their own.

Defined results
  vectors that are null, zero, or hold null or non-finite components: take no part. A query is compared with vectors of
  its length; one with none of them has no rows.
  null ids: take no part. Repeated ids: candidates of their own, never of a query with that id; the query is asked once, by the
  least of its vectors.
  ties: the smaller id. Fewer candidates than k: all. Empty table or no queries: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

PIVOTS, PLACES = 96, 24
#: Rows of a block, about; queries that go to a block at a time.
BLOCK, CHUNK = 4096, 256
#: Queries of the audit, the recall it asks for, and the first share of a block that is ranked again.
AUDIT, RECALL, FIRST_SHARE = 64, 0.97, 0.1


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) with clean vectors only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).where("size(v) > 0")


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """One more component that brings each row to the largest norm."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, largest**2 - (x * x).sum(1)))[:, None]])


def permutations(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (ties: the earlier pivot)."""
    far = (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :places]


class Files:
    """Pivot inverted files of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, largest: float, places: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")  # ids of each distinct vector, ascending
        counts = np.bincount(inverse.ravel(), minlength=len(self.x))
        self.ids, self.at = ids[by], np.concatenate([[0], np.cumsum(counts)])
        self.places = places
        perm = permutations(lifted(self.x, largest), pivots, places)
        flat = perm.ravel()
        listed = np.argsort(flat, kind="stable")
        self.member, self.place = listed // places, listed % places
        self.file = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(pivots)))])

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Distance of each distinct vector from an order; a missing pivot counts as the place behind the last."""
        saved = np.zeros(len(self.x), np.int32)
        for q, pivot in enumerate(perm.tolist()):
            post = slice(self.file[pivot], self.file[pivot + 1])
            place = self.place[post]
            saved[self.member[post]] += (2 * self.places - q - place - np.abs(q - place)).astype(np.int32)
        return self.places * (self.places + 1) - saved

    def search(self, own: int, q: np.ndarray, perm: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's nearest k found, without the query's own id."""
        n = len(self.x)
        take = min(n, max(2 * k, int(np.ceil(share * n))))
        chosen = np.arange(n) if take == n else np.sort(np.argpartition(self.footrule(perm), take - 1)[:take])
        # Summed place by place, not by a matrix product, so that a score doesn't depend on the block.
        score = np.einsum("ij,j->i", self.x[chosen], q)
        if len(chosen) > k + 1:
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            chosen, score = chosen[score >= least], score[score >= least]
        ids, scores = [], []
        for c, s in zip(chosen.tolist(), score.tolist(), strict=True):
            mine = self.ids[self.at[c] : min(self.at[c + 1], self.at[c] + k + 1)]
            if own in mine:
                mine = self.ids[self.at[c] : self.at[c + 1]]
                mine = mine[mine != own][:k]
            ids.append(mine[:k])
            scores.append(np.full(len(ids[-1]), s))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0)
        i, s = np.concatenate(ids), np.concatenate(scores)
        best = np.lexsort((i, -s))[:k]
        return i[best], s[best]


FOUND = "query_id long, vec_id long, score double"


class Searcher:
    """What a task needs to build a block's files and ask them."""

    def __init__(self, pivots: np.ndarray, largest: float, k: int, share: float, places: int):
        self.pivots, self.largest, self.k, self.share, self.places = pivots, largest, k, share, places

    def build(self, rows: pd.DataFrame) -> Files:
        return Files(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.float64), self.pivots, self.largest, self.places)

    def ask(self, files: Files, queries: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(queries["v"].to_numpy()).astype(np.float64)
        perms = permutations(lifted(x, self.largest), self.pivots, self.places)
        out = [files.search(own, q, p, self.k, self.share) for own, q, p in zip(queries["id"].tolist(), x, perms, strict=True)]
        return pd.DataFrame({"query_id": np.repeat(queries["id"].to_numpy(), [len(i) for i, _ in out]), "vec_id": np.concatenate([i for i, _ in out]), "score": np.concatenate([s for _, s in out])})

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by block, its vectors before its queries; a task holds one block."""
        now, rows, files = None, [], None
        for batch in batches:
            for (block, side), part in batch.groupby(["block", "side"], sort=True):
                if block != now:
                    now, rows, files = block, [], None
                if side == 0:
                    rows.append(part)
                    continue
                if files is None and rows:
                    files, rows = self.build(pd.concat(rows, ignore_index=True)), []
                for k in range(0, len(part) if files else 0, CHUNK):
                    yield self.ask(files, part.iloc[k : k + CHUNK])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", seed: int = 11, pivots: int = PIVOTS, places: int = PLACES, recall: float = RECALL, first_share: float = FIRST_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` among ``vectors``."""
    asked = usable(queries, id, vector).groupBy("id").agg(F.min("v").alias("v"))
    clean = usable(vectors, id, vector)
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).orderBy("d").collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in lengths:  # one, as a rule
        of = lambda df, d=r["d"]: df.where(F.size("v") == d)
        part = _search(of(clean), of(asked), r["n"], float(np.sqrt(r["norm2"])), k, seed, pivots, places, recall, first_share)
        if part is not None:
            out = part if len(lengths) == 1 else out.unionByName(part)
    return out


def _search(clean: DataFrame, asked: DataFrame, n: int, largest: float, k: int, seed: int, pivots: int, places: int, recall: float, first_share: float) -> DataFrame | None:
    """The same for n clean vectors (id, v) of one length; nothing without queries."""
    sample = clean.orderBy(F.xxhash64(F.lit(seed), "v"), "id").select("v").limit(4 * pivots).toPandas()["v"]  # bounded
    points = np.unique(np.stack(sample.to_numpy()).astype(np.float64), axis=0)
    points = points[np.random.default_rng(seed).permutation(len(points))[:pivots]]
    points, places = lifted(points, largest), min(places, len(points))
    blocks = max(1, -(-n // BLOCK))
    posted = clean.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def found(asking: DataFrame, share: float) -> DataFrame:
        sent = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        both = posted.select("block", F.lit(0).alias("side"), "id", "v").unionByName(sent.select("block", F.lit(1).alias("side"), "id", "v"))
        dealt = both.repartition("block").sortWithinPartitions("block", "side")
        return dealt.mapInPandas(Searcher(points, largest, k, share, places), FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    audit = cut(asked.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(AUDIT))
    truth = {(r["query_id"], r["rank"]): r["score"] for r in top(found(audit, 1.0)).collect()}  # AUDIT times k rows
    if not truth:
        return None
    share = first_share
    while share < 1:
        got: dict[int, list[float]] = {}
        for r in top(found(audit, share)).collect():
            got.setdefault(r["query_id"], []).append(r["score"])
        worst = {q: min(s for (p, _), s in truth.items() if p == q) for q, _ in truth}
        if sum(sum(s >= worst[q] for s in v) for q, v in got.items()) >= recall * len(truth):
            break
        share = min(1.0, share * 2)
    return top(found(asked, share))
