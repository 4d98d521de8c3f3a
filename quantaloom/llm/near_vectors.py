"""Near duplicates among embeddings with the same label, by navigable small-world graphs.

Equal vectors of a label form a class that is searched once. Classes of a label are dealt to shards by a hash, so that
a label with a third of all rows is many shards; a shard gets a graph of its own. Every class is searched for in every
shard of its label (each pair of shards once). Before it answers, a shard takes an audit: queries are compared with an exact scan, and the beam is doubled until
recall passes (a beam of a quarter of the graph is an exact scan itself); a query whose whole beam lies within the threshold is asked again with a wider beam, so that there is no cap on partners. Found pairs
are verified by cosine in double precision. A task gives, for each class, its number of links and the root of its
union, never all pairs; these edges are united by connected components.

The audit takes members in a seeded order, without each one's match with itself, until LEAST_LINKS true links have been
compared or all members. Queries that come from other shards are audited as well: AUDIT_ASKED of each batch of them.

Defined results
  vectors that are null, zero, or hold null or non-finite components, null labels, null ids: linked with nothing.
  vectors of a label with different lengths: linked only with those of their length. Repeated ids: a row each, a copy
  counts as another vector. Similarity of exactly the threshold links. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, roots
from .hnsw import Graph

#: Classes of a shard, about; first beam; members that an audit takes at a time, and the links that it wants to compare;
#: audited queries of a batch from other shards; the recall that audits must reach.
SHARD, BEAM, AUDIT, LEAST_LINKS, AUDIT_ASKED, RECALL = 4096, 32, 64, 200, 16, 0.999
#: The graph compares in single precision: it keeps pairs from so far below the threshold.
MARGIN = 1e-4


def passes(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[bool, int]:
    """Whether a beam finds the links of these queries, and how many there are; own: the node that a query is itself, or -1."""
    r, c = np.nonzero(q @ graph.x.T >= least)
    exact = {(x, y) for x, y in zip(r.tolist(), c.tolist(), strict=True) if own[x] != y}
    r, c = graph.within(q, least, beam)
    return len(exact & set(zip(r.tolist(), c.tolist(), strict=True))) >= RECALL * len(exact), len(exact)


def audited_beam(graph: Graph, least: float, beam: int = BEAM, seed: int = 9) -> int:
    """The first beam at which the links of the audited members are found."""
    order, compared = np.random.default_rng(seed).permutation(len(graph.x)), 0
    for k in range(0, len(order), AUDIT):
        own = order[k : k + AUDIT]
        while 4 * beam < len(graph.x):
            good, links = passes(graph, graph.x[own], own, least, beam)
            if good:
                break
            beam *= 2
        else:
            return beam
        compared += links
        if compared >= LEAST_LINKS:
            return beam
    return beam


class _Shard:
    """Members of one shard, their graph, and the links found so far."""

    def __init__(self, rows: pd.DataFrame, least: float):
        rows = rows.sort_values("id", kind="stable")
        self.least, self.ids, self.n = least, rows["id"].to_numpy(), rows["n"].to_numpy()
        self.v = np.stack(rows["v"].to_numpy()).astype(np.float64)
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.graph = Graph(self.v / self.norm[:, None])
        self.beam = audited_beam(self.graph, least - MARGIN)
        r, c = self._links(self.v, self.norm)
        a, b = np.minimum(r, c), np.maximum(r, c)  # found from either side
        pair = np.unique(a[a != b].astype(np.int64) * len(self.ids) + b[a != b])
        self.own = pair // len(self.ids), pair % len(self.ids)

    def _links(self, v: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c = self.graph.within(v / norm[:, None], self.least - MARGIN, self.beam)
        good = [np.einsum("ij,ij->i", v[r[k : k + 20_000]], self.v[c[k : k + 20_000]]) / (norm[r[k : k + 20_000]] * self.norm[c[k : k + 20_000]]) >= self.least for k in range(0, len(r), 20_000)]
        keep = np.concatenate(good) if good else np.zeros(0, bool)
        return r[keep], c[keep]

    def inside(self) -> pd.DataFrame:
        return self._summed(self.ids, self.n, *self.own)

    def asked(self, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.float64)
        norm = np.sqrt((v * v).sum(1))
        some = np.random.default_rng(len(v)).permutation(len(v))[:AUDIT_ASKED]
        q = (v[some] / norm[some, None]).astype(np.float32)
        while 4 * self.beam < len(self.ids) and not passes(self.graph, q, np.full(len(q), -1), self.least - MARGIN, self.beam)[0]:
            self.beam *= 2  # for what comes after as well
        r, c = self._links(v, norm)
        return self._summed(np.concatenate([self.ids, rows["id"].to_numpy()]), np.concatenate([self.n, rows["n"].to_numpy()]), c, r + len(self.ids))

    @staticmethod
    def _summed(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        links = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[roots(len(ids), a, b)][some]})


def _search(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, members, shard = None, [], None

        def built():
            nonlocal members, shard
            if shard is None and members:
                shard, members = _Shard(pd.concat(members, ignore_index=True), least), []
                yield shard.inside()

        for batch in batches:
            for key, part in batch.groupby(["label", "d", "shard", "side"], sort=True):
                if key[:3] != now:
                    yield from built()
                    now, members, shard = key[:3], [], None
                if key[3] == 0:
                    members.append(part)
                    continue
                yield from built()
                if shard:
                    yield shard.asked(part)
        yield from built()

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``."""
    v = F.col(vector).cast("array<double>")
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumns({"k1": F.when(F.col("fit"), F.xxhash64("v")), "k2": F.when(F.col("fit"), F.xxhash64(F.lit(1), F.reverse("v")))})
    equal = ["label", "k1", "k2"]
    classes = cut(rows.where("fit").groupBy(*equal).agg(F.min("id").alias("class"), F.count("*").alias("n"), F.first("v").alias("v")))
    # Only a count for each label and length, met in a join whose hot labels are split.
    shards = classes.groupBy("label", F.size("v").alias("d")).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = classes.select(F.col("class").alias("id"), "label", "n", "v", F.size("v").alias("d")).join(shards, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    members = dealt.select("label", "d", "shard", F.lit(0).alias("side"), "id", "n", "v")
    asking = dealt.where("shard > 0").select("label", "d", F.explode(F.sequence(F.lit(0), F.col("shard") - 1)).alias("shard"), F.lit(1).alias("side"), "id", "n", "v")
    sent = members.unionByName(asking).repartition("label", "d", "shard").sortWithinPartitions("label", "d", "shard", "side")
    found = cut(sent.mapInPandas(_search(least), "id long, links long, root long"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    known = classes.select(*equal, "class", "n").join(links, "class", "left").join(comp.withColumnRenamed("id", "class"), "class", "left")
    known = known.select(*equal, F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("id", *equal).join(known, equal, "left")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
