"""N-gram Jaccard join by signature trees.

A document's set is its distinct five-word shingles; two documents link when the Jaccard similarity of their sets is
at least the threshold. The steps:

1. Sets. Each whole text becomes its set (64-bit hashes). Documents with equal sets form a class, which one document
   stands for; classes carry their size, a bitmap with one bit for each token's hash, and their SKETCH lowest hashes.
2. Routes. A class goes to one route for each sketch token; tokens of one class only are dropped. Two sets of similarity
   s share none of their 16 lowest hashes with a chance below (1 - s) ** 16 (2e-10 at 0.75); like a collision of the
   hashes, that and the like in step 5 is all here that is left to chance. Each row carries its class's smaller tokens,
   and two classes are compared in the route of the smallest token they share, and in no other one.
3. Signature trees. In a route, classes are sorted by size and put under nodes that hold OR-combined bitmaps, size
   ranges and the least number of bits that a member needs. Two trees (or one with itself) are traversed together; a
   pair of nodes is pruned if their sizes can't fit or their common bits are fewer than any linked pair must have.
   |A xor B| <= (|A| + |B|)(1 - t)/(1 + t) for linked sets, and bitmaps differ in no more bits than sets do, so no
   linked pair is pruned. Lest bitmaps of large sets be full, those take the tokens whose hashes end in r zero bits,
   where r grows with the logarithm of the size; the bound is then widened by 7 standard deviations (5 for each of the two). A class has bitmaps
   for its own r and the next one, so that sets on both sides of a step can be compared.
4. Verification. What leaves the traversal is not pairs but the classes that have any pair left, so no more rows than
   came in. Their whole sets meet in the route once more; the same traversal gives the pairs, each is counted exactly
   unless its ends are in one component of the route already, and only edges that join two components go on: fewer than
   the route has classes.
5. Hot tokens, those of more than BLOCK classes. Classes with such a token among their 16 go by their 48 lowest hashes as
   well, since a pair that shares a rarer token is compared there. Hot tokens are counted first; then one pass makes the
   rows by token of all classes, 16 or 48 each, however many of them have a hot one. Whoever has at most a third hot tokens among the 48
   needs no more: a linked pair shares 17 or more of the 48 lowest of its union but with a chance below 1e-9. The rest,
   mostly copies of one passage or one large group of near copies, meets in hot routes: by bands of size (linked sets
   are of one band or of neighbours), and in blocks of BLOCK classes, or fewer if their sets are large. First each block is compared with itself; blocks
   are drawn anew for each of two tokens, so a dense group of any size becomes one component by work in proportion to
   it. Only then do all hot tokens make routes, those that more than the largest component of all has, and blocks meet
   blocks where a route has several components; its largest one is not compared with itself.
6. Components. Edges are united in Spark.

Defined results
  null or empty text, or no words: n_shingles 0, linked with nothing, component its own id.
  fewer words than the width: the whole sequence is the one shingle. Copies: one class, one component.
  null id: the row stays and gets the component of its class, null if it has none. Repeated ids: a row each; texts of
  one id that aren't near each other belong to components of their own, which may have the same least id.
  empty table: no rows. Extra columns: ignored. Very long texts: whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components, extended
from .shingles import shingle_sets

#: Lowest hashes of a set that make its routes; and those of a class with hot tokens.
SKETCH, DEEP = 16, 48
#: Bits of each of a class's two bitmaps; children of a node.
BITS, FAN = 1024, 8
#: Sets of up to twice this size are taken whole by the first bitmap.
FULL = 350
#: Classes of a route, or of a block of a hot one; hot routes of a class before blocks meet blocks, and classes of those.
BLOCK, FIRST_ROUTES, WIDE = 512, 2, 2048
#: Node pairs that are compared at a time; rows, and bytes of sets, of whole routes that are held at a time.
FRONTIER, ROWS, SET_BYTES = 4096, 4096, 8 << 20
#: Ids that are broadcast, at most (8 bytes each), to pick texts; more are met in a shuffled join.
BROADCAST_IDS = 1_000_000


def rate_of(n: np.ndarray) -> np.ndarray:
    """r of a set's own bitmap."""
    return np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / FULL))).astype(np.int64)


def bitmaps(s: np.ndarray) -> bytes:
    """The bitmap of even r, then that of odd r."""
    bits, own = np.zeros((2, BITS), bool), int(rate_of(np.array(len(s))))
    for r in (own, own + 1):
        kept = s[(s & np.uint64((1 << r) - 1)) == 0] if r else s
        bits[r & 1, (kept >> np.uint64(40)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits).tobytes()


def slack_of(n: np.ndarray, r, t: float) -> np.ndarray:
    """Bits by which a set of size n may differ from a linked one, its half of the bound."""
    mean = n * (1 - t) / (1 + t) / 2.0**r
    return mean + np.where(np.asarray(r) > 0, 5 * np.sqrt(mean) + 2, 0)


def _class_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sketch, bitmap = [], [], [], []
        for s in shingle_sets(batch.column(1), width):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketch.append(s[:DEEP].view(np.int64))
            bitmap.append(bitmaps(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bitmap, pa.binary())],
            ["id", "key", "n", "digest", "sketch", "bitmap"],
        )


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, set) of classes (text, digest, id), for rows whose text has the wanted digest."""
    for batch in batches:
        ids, sets = [], []
        for i, d, s in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(0), width), strict=True):
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                ids.append(i)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "tokens"])


class Tree:
    """Levels of nodes over classes sorted by size: level 0 are the classes themselves."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, slack: np.ndarray):
        self.levels = [(n, n, bits, np.bitwise_count(bits).sum(1) - slack, comp)]
        while len(self.levels[-1][0]) > 1:
            low, high, b, need, c = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            one = np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)
            self.levels.append(
                (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(need, at), np.where(one, c[at], -1))
            )  # -1: members of several components

    def children(self, level: int, i: np.ndarray) -> np.ndarray:
        return np.minimum(i[:, None] * FAN + np.arange(FAN), len(self.levels[level - 1][0]))


def traverse(x: Tree, y: Tree, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of class pairs (of x, of y) in different components that may link. x may be y."""
    same = x is y
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack += [(a, b, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
            continue
        low, high, bits, need, comp = x.levels[a]
        low2, high2, bits2, need2, comp2 = y.levels[b]
        fit = (low[i] * t <= high2[j] + 1e-9) & (low2[j] * t <= high[i] + 1e-9) & ((comp[i] != comp2[j]) | (comp[i] < 0))
        i, j = i[fit], j[fit]
        fit = 2 * np.bitwise_count(bits[i] & bits2[j]).sum(1) >= need[i] + need2[j] - 1e-6
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        if a == b == 0:
            yield i, j
            continue
        down, down2 = a > 0 and a >= b, b > 0 and b >= a
        ci = x.children(a, i) if down else i[:, None]
        cj = y.children(b, j) if down2 else j[:, None]
        i, j = np.repeat(ci, cj.shape[1], 1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
        a, b = a - down, b - down2
        fit = (i < len(x.levels[a][0])) & (j < len(y.levels[b][0]))
        if same:
            fit &= i < j if a == 0 else i <= j
        stack.append((a, b, i[fit], j[fit]))


def _searched(route: dict, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the route's pairs that may link: trees for each r, over the classes that have a bitmap for it."""
    order = np.argsort(route["n"], kind="stable")
    own, two = rate_of(route["n"]), route["side"].any()
    for r in np.unique(own).tolist():
        has = order[(own[order] == r) | (own[order] == r - 1)]
        sides = [has[route["side"][has] == k] for k in (0, 1)] if two else [has]
        if not all(map(len, sides)):
            continue
        trees = [Tree(route["n"][k], route["bits"][k, r & 1], route["comp"][k], slack_of(route["n"][k], r, t)) for k in sides]
        for i, j in traverse(trees[0], trees[-1], t):
            i, j = sides[0][i], sides[-1][j]
            mine = np.maximum(own[i], own[j]) == r  # pairs of two smaller sets come with the r before
            yield i[mine], j[mine]


def _columns(table: pa.Table) -> dict:
    """Rows of whole routes as arrays; ``below`` is padded with zeros."""
    table = table.combine_chunks()
    one = lambda name: table.column(name).chunk(0) if table.column(name).num_chunks else pa.array([], table.column(name).type)
    col = {k: one(k).to_numpy(zero_copy_only=False) for k in table.column_names if k not in ("bitmap", "below", "tokens")}
    if "bitmap" in table.column_names:
        col["bits"] = np.frombuffer(b"".join(one("bitmap").to_pylist()), np.uint64).reshape(table.num_rows, 2, BITS // 64)
    if "tokens" in table.column_names:
        col["sets"] = [np.frombuffer(v.as_buffer(), np.uint64) for v in one("tokens")]
    size = one("below").value_lengths().to_numpy(zero_copy_only=False)
    col["below"] = np.zeros((table.num_rows, int(size.max(initial=0))), np.int64)
    col["below"][np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = one("below").flatten().to_numpy(zero_copy_only=False)
    return col


def _edges_of(table: pa.Table) -> np.ndarray:
    """Rows at which a new route begins, and the number of rows."""
    token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
    return np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1, [len(token)]])


def _whole_routes(batches: Iterator[pa.RecordBatch], most: int, weigh) -> Iterator[pa.Table]:
    """Tables of whole routes of about this weight; a partition is sorted by (token, part), and a route has two blocks at most."""
    held, weight = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        weight += weigh(batch)
        if weight >= most:
            table = pa.Table.from_batches(held)
            last = int(_edges_of(table)[-2])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            weight = sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held)


def _apart(below: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows have none of the tokens in common that other routes answer for."""
    hit = np.zeros(len(i), bool)
    for a in range(0, len(i), FRONTIER):
        x, y = below[i[a : a + FRONTIER]], below[j[a : a + FRONTIER]]
        for k in range(x.shape[1]):
            hit[a : a + FRONTIER] |= ((y == x[:, k, None]) & (x[:, k, None] != 0)).any(1)
    return ~hit


def _may_link(route: dict, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Rows' pairs that the traversal wouldn't prune either, without trees: for routes of few classes."""
    n, own = route["n"], rate_of(route["n"])
    fit = (n[i] * t <= n[j] + 1e-9) & (n[j] * t <= n[i] + 1e-9) & (np.abs(own[i] - own[j]) < 2) & (route["comp"][i] != route["comp"][j])
    at = np.flatnonzero(fit)
    x, y = i[at], j[at]
    r = np.maximum(own[x], own[y])
    differ = np.bitwise_count(route["bits"][x, r & 1] ^ route["bits"][y, r & 1]).sum(1)
    fit[at] = differ <= slack_of(n[x], r, t) + slack_of(n[y], r, t) + 1e-6
    return fit


def _survivors(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows, less size and bitmap, of the classes that may link with another one of their route and are compared there."""
    for table in _whole_routes(batches, ROWS, lambda b: b.num_rows):
        col, edge = _columns(table), _edges_of(table)
        keep, size = np.zeros(table.num_rows, bool), np.diff(edge)
        small = (size <= FAN) & (np.add.reduceat(col["side"], edge[:-1]) == 0)
        for m in range(2, FAN + 1):
            first = edge[:-1][small & (size == m)]
            x, y = np.triu_indices(m, 1)
            i, j = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
            fit = _may_link(col, i, j, t)
            i, j = i[fit], j[fit]
            fit = _apart(col["below"], i, j)
            keep[i[fit]] = keep[j[fit]] = True
        for k in np.flatnonzero(~small & (size > 1)).tolist():
            rows = slice(edge[k], edge[k + 1])
            route = {name: v[rows] for name, v in col.items()}
            if route["comp"].min() == route["comp"].max():
                continue
            for i, j in _searched(route, t):
                new = ~(keep[rows][i] & keep[rows][j])
                i, j = i[new], j[new]
                fit = _apart(route["below"], i, j)
                keep[edge[k] + i[fit]] = keep[edge[k] + j[fit]] = True
        yield from table.drop_columns(["n", "bitmap"]).filter(pa.array(keep)).combine_chunks().to_batches()


class _Exact:
    """Sizes of intersections of one set with some others, by places in the vocabulary of the route."""

    def __init__(self, sets: list[np.ndarray]):
        self.edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        vocabulary, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(vocabulary), bool)

    def common(self, i: int, js: np.ndarray) -> np.ndarray:
        own = self.flat[self.edge[i] : self.edge[i + 1]]
        self.mark[own] = True
        parts = [self.flat[self.edge[j] : self.edge[j + 1]] for j in js.tolist()]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        out = np.add.reduceat(self.mark[np.concatenate(parts)].astype(np.int64), first)
        self.mark[own] = False
        return out


def _joining(route: dict, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (ids) that join two components of the route, which are those it came with and grow as it goes."""
    sets, t, m = route["sets"], num / den, len(route["id"])
    if m <= FAN and not route["side"].any():
        i, j = np.triu_indices(m, 1)
        fit = (route["n"][i] * t <= route["n"][j] + 1e-9) & (route["n"][j] * t <= route["n"][i] + 1e-9)
        found = [(i[fit], j[fit])]
    else:
        route["bits"] = np.frombuffer(b"".join(map(bitmaps, sets)), np.uint64).reshape(m, 2, BITS // 64)
        found = list(_searched(route, t))
    if not found:
        return
    i, j = (np.concatenate(side) for side in zip(*found, strict=True))
    fit = _apart(route["below"], i, j)
    order = np.flatnonzero(fit)[np.lexsort((j[fit], i[fit]))]
    i, j = i[order], j[order]
    if not len(i):
        return
    root, exact = np.unique(route["comp"], return_inverse=True)[1], _Exact(sets)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        one, some = int(i[a]), j[a:b]
        some = some[root[some] != root[one]]
        if not len(some):
            continue
        common = exact.common(one, some)
        for other in some[den * common >= num * (len(sets[one]) + route["n"][some] - common)].tolist():
            if root[one] != root[other]:
                root[root == root[other]] = root[one]
                yield int(route["id"][one]), int(route["id"][other])


def _edges(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for table in _whole_routes(batches, SET_BYTES, lambda b: b.nbytes):
        col, edge = _columns(table), _edges_of(table)
        col["n"], found = np.array([len(s) for s in col["sets"]], np.int64), []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                found += _joining({name: v[a:b] for name, v in col.items()}, num, den)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; linked: den * |A and B| >= num * |A or B|."""
    found = _grouped(docs, num, den, width, id, text, F.lit(None).cast("string"))
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _holding(column: Column, wanted: DataFrame) -> Column:
    """Whether an array of tokens has one of the table's; true, where that is too long to be sent to all tasks."""
    n = wanted.count()
    if not n or n > BROADCAST_IDS:
        return F.lit(n > 0)
    sent = wanted.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["token"].to_numpy(np.int64)))

    @F.pandas_udf("boolean")
    def holds(held: pd.Series) -> pd.Series:
        flat, size = np.concatenate([np.zeros(0, np.int64), *held]), held.map(len).to_numpy(np.int64)
        hit = sent.value[np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)] == flat
        return pd.Series(np.bincount(np.repeat(np.arange(len(size)), size), hit, len(size)) > 0)

    return holds(column)


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(id, own, hot, own2, hot2) of classes that share a token: those of the SKETCH lowest that 2 to BLOCK classes have, and those that more have.

    own2 and hot2 are the same of the DEEP lowest among the classes that have a hot token, and empty for others. One pass
    makes the rows of both: SKETCH of a class, DEEP of one with a hot token.
    """
    lowest = F.slice("sketch", 1, SKETCH)
    hot = cut(classes.select(F.explode(lowest).alias("token")).groupBy("token").count().where(F.col("count") > BLOCK).select("token"))
    taken = F.when(F.col("deep"), F.col("sketch")).otherwise(lowest)
    tokens = classes.withColumn("deep", _holding(lowest, hot)).select("id", "deep", F.posexplode(taken).alias("place", "token"))
    tokens = tokens.select("id", "token", (F.col("deep").cast("int") + (F.col("place") >= SKETCH).cast("int")).alias("kind"))  # 0, 1: of the SKETCH lowest; 1, 2: of a class with a hot token
    early, deep = F.col("kind") < 2, F.col("kind") > 0
    counts = tokens.groupBy("token").agg(F.count_if(early).alias("c"), F.count_if(deep).alias("c2")).where("c > 1 or c2 > 1")
    some = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("token"))))
    two = lambda c: (F.col(c) > 1) & (F.col(c) <= BLOCK)
    found = tokens.join(counts, "token").where((early & (F.col("c") > 1)) | (deep & (F.col("c2") > 1)))
    return found.groupBy("id").agg(some(early & two("c")).alias("own"), some(early & (F.col("c") > BLOCK)).alias("hot"), some(deep & two("c2")).alias("own2"), some(deep & (F.col("c2") > BLOCK)).alias("hot2"))


def _among(column: str, wanted: DataFrame) -> Column:
    """Those of an array of tokens that the table has; all of them, where it is too long to be sent to all tasks."""
    if wanted.count() > BROADCAST_IDS:
        return F.col(column)
    tokens = np.sort(wanted.toPandas()["token"].to_numpy(np.int64))
    sent = wanted.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("array<long>")
    def kept(held: pd.Series) -> pd.Series:
        return held.map(lambda v: np.asarray(v, np.int64)[np.isin(v, sent.value, assume_unique=True)])

    return kept(column)


def _grouped(docs: DataFrame, num: int, den: int, width: int, id: str, text: str, key: Column) -> DataFrame:
    """(id, key, n, group, component_id) for every row: the number of its component, and the least id in it.

    Classes go by numbers of their own, not by ids: an id that is repeated with other texts links nothing.
    """
    small_batches(docs.sparkSession)
    t = num / den
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    keyed = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), key.alias("key"))
    rows = cut(keyed.mapInArrow(lambda it: _class_rows(it, width), "id long, key string, n long, digest binary, sketch array<long>, bitmap binary"))
    full = rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min_by(F.struct(F.col("id").alias("doc"), "n", "bitmap", "sketch"), "id").alias("r")).select("digest", "r.*")
    full = cut(full.withColumn("id", F.monotonically_increasing_id()))  # classes and their numbers stay from here on
    classes = full.select("id", "doc", "digest")

    def linked(routes: DataFrame) -> DataFrame:
        """Edges (a, b) between classes of the same route (token, part)."""
        dealt = lambda df: df.repartition("token", "part").sortWithinPartitions("token", "part")
        kept = cut(dealt(routes).mapInArrow(lambda it: _survivors(it, t), "id long, comp long, below array<long>, token long, part long, side int"))
        ids = cut(kept.select("id").distinct().join(classes, "id"))
        near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = texts.join(near, "doc").select("text", "digest", "id").mapInArrow(lambda it: _set_rows(it, width), "id long, tokens binary")  # a repeated id repeats edges, no more
        return cut(dealt(kept.join(cut(sets), "id")).mapInArrow(lambda it: _edges(it, num, den), "a long, b long"))

    members = full.join(cut(_shared_tokens(full)), "id")
    row = ["id", F.col("id").alias("comp"), "n", "bitmap"]
    smaller = lambda tokens: F.filter(tokens, lambda x: x < F.col("token"))
    flat = lambda df, under, part: df.select("id", "comp", "n", "bitmap", under.alias("below"), "token", part.cast("long").alias("part"), F.col("side") if "side" in df.columns else F.lit(0).alias("side"))
    routes = flat(members.select(*row, "own", F.explode("own").alias("token")), smaller("own"), F.lit(-1))
    step = 1 / t * (1 + 1e-9)  # of sizes from one band to the next
    room = lambda classes: F.greatest(F.lit(classes // 16), F.least(F.lit(classes), F.floor(classes * FULL / F.pow(F.lit(step), F.col("band") + 1))))  # noqa: E731  fewer large sets to a block

    def banded(df: DataFrame, tokens: Column) -> DataFrame:
        """Rows by (token, band): a class is in its own band, and with smaller classes of the band before that it may link with."""
        rows = df.withColumn("token", F.explode(tokens)).withColumn("of", F.floor(F.log("n") / float(np.log(step))))
        tops = rows.groupBy("token", F.col("of").alias("band")).agg(F.max("n").alias("top"))
        both = rows.withColumn("band", F.explode(F.array("of", F.col("of") - 1))).join(tops, ["token", "band"])
        return both.where((F.col("of") == F.col("band")) | (F.col("n") * t <= F.col("top") + 1e-9)).drop("of", "top")

    deep = cut(members.where(F.size("hot") > 0))
    hot = None
    if not deep.isEmpty():
        routes = routes.union(flat(deep.select(*row, "own", "own2", F.explode("own2").alias("token")), F.concat("own", smaller("own2")), F.lit(-2)))
        hot = cut(deep.where(3 * F.size("hot2") > F.size("sketch")).select(*row, "own", F.array_sort("hot").alias("hot")))
        first = banded(hot, F.slice("hot", 1, FIRST_ROUTES))
        size = first.groupBy("token", "band").count().withColumn("blocks", F.ceil(F.col("count") / room(BLOCK)))
        mine = F.pmod(F.xxhash64("id", "token"), F.col("blocks"))
        routes = routes.union(flat(first.join(size, ["token", "band"]), F.col("own"), (F.col("band") + 1) * 2**40 + mine))
    comp = cut(components(linked(routes)))
    if hot is not None:
        now = cut(hot.drop("comp").join(comp.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        largest = now.groupBy("comp").count().agg(F.max_by("comp", F.struct("count", "comp"))).first()[0]
        # Routes that only the largest component has are left out before rows are made of them.
        wanted = cut(now.where(F.col("comp") != largest).select(F.explode("hot").alias("token")).distinct()) if largest is not None else None
        if wanted is not None and not wanted.isEmpty():
            now = banded(now.withColumn("meet", _among("hot", wanted)), F.col("meet"))
            held = now.groupBy("token", "band", "comp").agg(F.count("*").alias("c")).groupBy("token", "band").agg(F.max_by("comp", "c").alias("main"), F.max("c").alias("in_main"), F.sum("c").alias("c"))
            held = cut(held.where("in_main < c").withColumns({"others": F.ceil((F.col("c") - F.col("in_main")) / room(WIDE)), "mains": F.ceil(F.col("in_main") / room(WIDE))}))
            is_main = F.col("comp") == F.col("main")
            place = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))) + F.when(is_main, F.col("others")).otherwise(0)
            meets = F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(is_main, 0).otherwise(F.col("mains")) - 1)
            met = now.join(held, ["token", "band"]).withColumn("mine", place).withColumn("o", F.explode(meets)).withColumn("side", (F.col("mine") > F.col("o")).cast("int"))
            pair = F.least("mine", "o") * (F.col("others") + F.col("mains")) + F.greatest("mine", "o")
            comp = cut(extended(comp, linked(flat(met, F.concat("own", smaller("hot")), (F.col("band") + 1) * 2**40 + pair))))
    comp = None if comp.isEmpty() else comp

    known = classes.select("digest", "id", "doc")
    if comp is not None:
        joined = known.join(comp, "id")
        least = joined.groupBy("component").agg(F.min("doc").alias("least"))
        linked = joined.join(least, "component").select("id", F.col("component").alias("group"), F.col("least").alias("component_id"))
        known = known.join(linked, "id", "left")
    else:
        known = known.withColumns({"group": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    known = known.select("digest", F.coalesce("group", "id").alias("group"), F.coalesce("component_id", "doc").alias("component_id"))
    return rows.select("id", "key", "n", "digest").join(known, "digest", "left").select("id", "key", "n", "group", "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", num: int = 75, den: int = 100, width: int = 5) -> DataFrame:
    """``docs`` without those that another document of their component stands for (the one with the least id).

    Rows without words or id stay. Rows that repeat an id and a text count as one document. An id that is repeated with
    other texts is a document with each of them: such rows are decided one by one, and of several texts of the least id
    the one with the least digest stands for their component.
    """
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))
    found = cut(_grouped(docs, num, den, width, id, text, digest).where("id is not null").select(F.col("id").alias("id_"), F.col("key").alias("key_"), "n", "group", "component_id"))
    near = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    gone = found.where("n > 0 and id_ <> component_id").select("id_").distinct()
    again = found.groupBy("id_").count().where("count > 1").select("id_")
    if again.isEmpty():
        return docs.join(near(gone), F.col(id) == F.col("id_"), "left_anti")
    again = near(cut(again))
    once = docs.join(again, F.col(id) == F.col("id_"), "left_anti").join(near(gone), F.col(id) == F.col("id_"), "left_anti")
    rows = found.join(again, "id_", "left_semi")
    first = rows.where("n > 0 and id_ = component_id").groupBy("group", "id_").agg(F.min("key_").alias("key_")).select("id_", "key_")
    stay = rows.where("n = 0").select("id_", "key_").union(first).distinct()
    more = docs.join(again, F.col(id) == F.col("id_"), "left_semi").join(stay, (F.col(id) == F.col("id_")) & (digest == F.col("key_")), "left_semi")
    return once.unionByName(more.dropDuplicates([id, text]))
