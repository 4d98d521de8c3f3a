"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). Source quotas follow from weights, and
stop at ``most`` times the source's own size. A flow network sends each pattern's words to the quotas of its sources;
the k-th repetition of a pattern costs k - 1 a word, so that repetition is spread as evenly as the quotas allow. Then a
seeded order decides which documents of a pattern get one repetition more than the others.

Texts are read once, to count words. The rest works on narrow rows: sums by pattern, sums by (pattern, bucket of the
seeded hash), and an ordering within the one bucket of each pattern at which its share ends. No group is sorted whole,
so a source with a third of all rows is no harder than others. The driver gets one row for each pattern and source.

Defined results
  null text: size 0, taken 0. Null source: a source of its own, last in order. Null or repeated ids: a row each; equal
  rows are interchangeable. The document at the end of a share may be taken in part. Empty table: no rows.
  A source of size 0 has target 0. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a pattern that share a bucket of the seeded order, about.
BUCKET_ROWS = 20_000
#: Patterns whose plan is broadcast, at most; more are met in a shuffled join.
BROADCAST_PATTERNS = 100_000


def quotas(sizes: dict, weights: dict, most: float) -> dict:
    """Targets that share the total by weight; none above ``most`` times its source's size."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        share = left
        for s in full:
            out[s] = float(most * sizes[s])
            share -= out[s]
            open_.discard(s)
        left = share
    return out


def whole_numbers(targets: dict) -> dict:
    """Rounded targets that keep the rounded total (largest remainders first)."""
    base = {s: int(t) for s, t in targets.items()}
    lack = round(sum(targets.values())) - sum(base.values())
    for s in sorted(targets, key=lambda s: base[s] - targets[s])[: max(0, lack)]:
        base[s] += 1
    return base


def min_cost_flow(supply: list[int], member: list[list[int]], quota: list[int], most: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources: as much as quotas take, at least cost.

    The network: start, patterns, quotas, sink; only the repetition arcs from the start to a pattern cost anything, the
    k-th of them k - 1 a word. An augmenting path leaves the start by one of them and never comes back there, so its cost
    is that arc's: shortest paths come in the order of k. Level by level, then, the next repetition is opened and the flow
    is brought to its maximum by blocking flows, which works for tens of thousands of patterns.
    """
    n, m = len(supply), len(quota)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    holders: list[set[int]] = [set() for _ in range(m)]  # patterns that send to a quota
    left, room = [0] * n, list(quota)
    for _ in range(most):
        left = [x + s for x, s in zip(left, supply, strict=True)]
        while True:
            # Layers: patterns with words left, quotas, patterns that could send elsewhere, and so on up to a quota with room.
            at_p, at_q = {i: 0 for i in range(n) if left[i]}, {}
            front, depth, end = list(at_p), 0, None
            while front and end is None:
                reached = []
                for i in front:
                    for j in member[i]:
                        if j not in at_q:
                            at_q[j] = depth + 1
                            reached.append(j)
                if any(room[j] for j in reached):
                    end = depth + 1
                front = []
                if end is None:
                    for j in reached:
                        for i in holders[j]:
                            if i not in at_p:
                                at_p[i] = depth + 2
                                front.append(i)
                depth += 2
            if end is None:
                break
            back = {j: [i for i in holders[j] if at_p.get(i) == d + 1] for j, d in at_q.items() if d < end}
            onward = {i: [j for j in reversed(member[i]) if at_q.get(j) == d + 1] for i, d in at_p.items()}
            for first in [i for i, d in at_p.items() if d == 0]:
                path: list[int] = [first]  # pattern, quota, pattern, ..
                while path and left[first]:
                    i = path[-1]
                    if not onward[i]:  # a dead end: the quota before it loses this way
                        path.pop()
                        if path:
                            back[path.pop()].pop()
                        continue
                    j = onward[i][-1]
                    if at_q[j] == end:
                        if not room[j]:
                            onward[i].pop()
                            continue
                        path.append(j)
                        sent = min([left[first], room[j], *(flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2))])
                        left[first] -= sent
                        room[j] -= sent
                        for k in range(0, len(path), 2):
                            flow[path[k]][path[k + 1]] = flow[path[k]].get(path[k + 1], 0) + sent
                            holders[path[k + 1]].add(path[k])
                        for k in range(1, len(path) - 1, 2):
                            flow[path[k + 1]][path[k]] -= sent
                            if not flow[path[k + 1]][path[k]]:
                                holders[path[k]].discard(path[k + 1])
                        path = path[:1]
                        continue
                    while back[j] and not flow[back[j][-1]].get(j):
                        back[j].pop()
                    if back[j]:
                        path += [j, back[j][-1]]
                    else:
                        onward[i].pop()
    return flow


def cycling_weights(sources: list) -> dict:
    """1, 2, 3, 1, .. by code point, null last."""
    return {s: 1 + i % 3 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def _measured(docs: DataFrame, sources, id: str, text: str, seed: int) -> DataFrame:
    """``docs`` as a struct, with size, sources and the seeded hash."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("id"), size.alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "size"))


def _decided(docs: DataFrame, sources, id: str, text: str, weights: Callable[[list], dict], most: int, seed: int, whole_rows: bool) -> tuple[DataFrame, DataFrame]:
    """(id, size, sources, taken) of every row of ``docs``, or (row, ..) with the whole row, and the source table."""
    spark = docs.sparkSession
    full = _measured(docs, sources, id, text, seed)
    narrow = cut(full.drop("row"))
    patterns = narrow.groupBy("sources").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    names = sorted({s for p in patterns for s in p["sources"]}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for p in patterns:
        for s in p["sources"]:
            sizes[s] += p["size"]
    # Overlapping sources hold some words twice; the words to share out are those there are.
    total, held = sum(p["size"] for p in patterns), sum(sizes.values())
    scale = total / held if held else 1.0
    target = quotas({s: v * scale for s, v in sizes.items()}, weights(names), most / scale)
    whole = whole_numbers(target)
    index = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([p["size"] for p in patterns], [[index[s] for s in p["sources"]] for p in patterns], [whole[s] for s in names], most)

    plan = [(p["sources"], *(divmod(sum(sent.values()), p["size"]) if p["size"] else (0, 0))) for p, sent in zip(patterns, flow, strict=True)]
    largest = max([p["rows"] for p in patterns], default=0)
    buckets = 1 << max(10, (largest // BUCKET_ROWS).bit_length())
    names_of = T.StructField("sources_", T.ArrayType(T.StringType()))
    numbers = lambda *n: [T.StructField(k, T.LongType()) for k in n]
    match = F.col("sources").eqNullSafe(F.col("sources_"))
    near = F.broadcast if len(patterns) <= BROADCAST_PATTERNS else (lambda df: df)
    planned = near(spark.createDataFrame(plan, T.StructType([names_of, *numbers("passes", "rest")])))

    def with_plan(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets))).join(planned, match).drop("sources_")

    # Where each pattern's share ends: the bucket in which the running sum passes ``rest``.
    sums = with_plan(narrow).groupBy("sources", "rest", "bucket").agg(F.sum("size").alias("words"))
    edge = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sources").orderBy("bucket"))).where("upto > rest and upto - words <= rest")
    edges = [(r["sources"], r["bucket"], r["before"]) for r in edge.select("sources", "bucket", (F.col("upto") - F.col("words")).alias("before")).collect()]
    ends = near(spark.createDataFrame(edges, T.StructType([names_of, *numbers("edge", "before")])))
    rows = with_plan(full if whole_rows else narrow).join(ends, match, "left").drop("sources_")
    outside = rows.where("edge is null or bucket <> edge").withColumn("more", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    inside = rows.where("bucket = edge").withColumn("past", F.sum("size").over(Window.partitionBy("sources", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)))
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce("past", F.lit(0))))).drop("past")
    taken = outside.unionByName(inside).select("row" if whole_rows else "id", "size", "sources", (F.col("passes") * F.col("size") + F.col("more")).cast("long").alias("taken"))
    table = spark.createDataFrame([(s, sizes[s], target[s]) for s in names], "source string, source_size long, target double")
    return taken, F.broadcast(table) if len(names) <= BROADCAST_PATTERNS else table


def mix(docs: DataFrame, sources=None, id: str = "doc_id", text: str = "text", weights: Callable[[list], dict] = cycling_weights, most: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((id, size, sources, taken) of every row, (source, source_size, target))."""
    sources = F.array("source") if sources is None else sources
    taken, table = _decided(docs, sources, id, text, weights, most, seed, False)
    return taken.withColumnRenamed("id", id), table


def mixed(docs: DataFrame, sources=None, id: str = "doc_id", text: str = "text", weights: Callable[[list], dict] = cycling_weights, most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, to the nearest whole number of times."""
    taken, _ = _decided(docs, F.array("source") if sources is None else sources, id, text, weights, most, seed, True)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return taken.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
