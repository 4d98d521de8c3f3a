"""Ranked lexical search by MaxScore with bounds of term pairs.

One pass over whole texts keeps, of each document, its length and the query terms it holds with their counts; document
frequencies and totals are Spark aggregates. An index is then built for each shard of documents, inside a task: postings
of each term with exact integer impacts, the largest impact of a term, and for pairs of terms of a query the list of
documents that hold both with the largest joint impact. A query bounds a pair by what a document can gain from either
term alone or from both together, which is never more than the sum of two maxima and is less where the pair's documents
are few or poor. Pairs are chosen by what they tighten. The terms and pairs whose bounds together stay below the worst
score kept are not used to find documents; they are looked up for those found by others, as long as these can still win.
Bounds only skip what can't be among the first, so the ranking is exact.

Each task passes on as many documents an item as are asked for, and the first of these are ranked. Items are worked on in
groups whose texts have at most ``ITEM_BYTES``, so what is broadcast is bounded however many items there are.

Defined results
  Null and empty texts: no terms; such documents aren't found, such items find nothing. Documents without an id are
  ranked like others, after those with one among equal scores. Repeated rows, of documents or items, count and are
  answered each on its own. Equal scores: by ascending id. Fewer documents than asked for: all above 0. Empty tables:
  no rows. Extra columns are ignored. Long texts are read whole, a row at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Bytes of item texts in a group; postings of a shard, about.
ITEM_BYTES, SHARD = 16 << 20, 2_000_000
#: Letters, digits and all that isn't ASCII; only A-Z lower-cased. On UTF-8 bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(raw.lower())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- one pass over documents

def _held(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    get = vocabulary.get
    for batch in batches:
        texts, ids = batch.column(1).cast(pa.large_binary()), batch.column(0)
        size, terms, counts, kept, held = [], [], [], [], 0
        for i in range(len(texts)):
            found = terms_of(texts[i].as_py())
            own = Counter(map(get, found))
            own.pop(None, None)
            size.append(len(found))
            terms.append(list(own))
            counts.append(list(own.values()))
            kept.append(i)
            held += len(own)
            if held > 1 << 18 or i + 1 == len(texts):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])
                size, terms, counts, kept, held = [], [], [], [], 0


def held_terms(docs: DataFrame, vocabulary: dict[bytes, int], id: str, text: str) -> DataFrame:
    """(id, n terms with repeats, terms array<int> of the vocabulary, counts) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _held(it, sent.value), "id long, n long, terms array<int>, counts array<long>")


# ---------------------------------------------------------------- an index of one shard

class Index:
    """Postings of a shard's documents, which are in order of id, with maxima of terms and of pairs."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, pairs: set[tuple[int, int]]):
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.start = dict(zip(self.terms.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True), strict=True))
        self.most = dict(zip(self.terms.tolist(), np.maximum.reduceat(self.impact, starts).tolist() if len(starts) else [], strict=True))
        self.joint = {p: self._meet(*p) for p in pairs if p[0] in self.start and p[1] in self.start}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[t]
        return self.doc[a:b], self.impact[a:b]

    def of(self, t: int, docs: np.ndarray) -> np.ndarray:
        """Impacts of a term in these documents, 0 where it doesn't occur."""
        own, impact = self.postings(t)
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impact[at], 0)

    def _meet(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """(documents that hold both, their largest joint impact or 0)."""
        if self.start[a][1] - self.start[a][0] > self.start[b][1] - self.start[b][0]:
            a, b = b, a
        docs, impact = self.postings(a)
        other = self.of(b, docs)
        both = other > 0
        return docs[both], int((impact + other)[both].max(initial=0))

    def bound(self, pair: tuple[int, int]) -> int:
        return max(self.most[pair[0]], self.most[pair[1]], self.joint[pair][1])

    def units(self, terms: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms): pairs that tighten most, each term once, and the terms that are left."""
        here = [t for t in terms if t in self.start and self.most[t] > 0]
        gain = [(self.most[a] + self.most[b] - self.bound((a, b)), a, b) for a, b in pairs if (a, b) in self.joint]
        free, out = set(here), []
        for g, a, b in sorted(gain, reverse=True):
            if g > 0 and a in free and b in free:
                free -= {a, b}
                out.append((self.bound((a, b)), (a, b)))
        return out + [(self.most[t], (t,)) for t in here if t in free]


def search(index: Index, terms: list[int], pairs: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that score at least ``least``, and at least 1; exact scores."""
    least = max(least, 1)
    units = index.units(terms, pairs)
    length = lambda u: sum(index.start[t][1] - index.start[t][0] for t in u[1])
    units.sort(key=lambda u: u[0] / length(u))
    skipped = room = 0
    while skipped < len(units) and room + units[skipped][0] < least:
        room += units[skipped][0]
        skipped += 1
    if skipped == len(units):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [index.postings(t) for _, own in units[skipped:] for t in own]
    docs, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    score = np.zeros(len(docs), np.int64)
    np.add.at(score, place, np.concatenate([p[1] for p in parts]))
    for bound, own in sorted(units[:skipped], reverse=True):
        good = score + room >= least
        docs, score = docs[good], score[good]
        for t in own:
            score = score + index.of(t, docs)
        room -= bound
    good = score >= least
    return docs[good], score[good]


# ---------------------------------------------------------------- all shards

def _ranked(batches: Iterator[pa.RecordBatch], plan: tuple) -> Iterator[pa.RecordBatch]:
    """The best documents of each item over this task's shards: (item, id, score)."""
    weights, queries, n_docs, n_terms, k = plan
    pairs = {p for _, own in queries for p in own}
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]  # ids, scores; best first

    def run(parts: list[tuple]) -> None:
        ids = np.concatenate([p[0] for p in parts])
        size, many = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        term, count = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids = ids[order]
        if int(size.max(initial=0)) * 90 * n_docs < 1 << 63:
            m = 100 - 90 + (90 * size * n_docs) // n_terms
        else:
            m = np.array([100 - 90 + (90 * s * n_docs) // n_terms for s in size.tolist()])
        doc = np.repeat(np.arange(len(size)), many)
        impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
        index = Index(place[doc], term, impact, pairs)
        for q, (terms, own) in enumerate(queries):
            held, scores = best[q]
            docs, found = search(index, terms, own, int(scores[-1]) if len(scores) == k else 0)
            if len(docs):
                held, scores = np.concatenate([held, ids[docs]]), np.concatenate([scores, found])
                first = np.lexsort((held, -scores))[:k]
                best[q] = held[first], scores[first]

    parts, postings = [], 0
    for batch in batches:
        terms, counts = batch.column(2), batch.column(3)
        parts.append((batch.column(0).fill_null(_NO_ID).to_numpy(), batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), counts.flatten().to_numpy()))
        postings += len(parts[-1][3])
        if postings > SHARD:
            run(parts)
            parts, postings = [], 0
    if parts:
        run(parts)
    item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
    if len(item):
        ids = np.concatenate([b[0] for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(np.concatenate([b[1] for b in best]))], ["item", "id", "score"])


def pairs_of(terms: list[int], df: list[int]) -> list[tuple[int, int]]:
    """Pairs whose intersections are listed: in order of frequency, each term with the next two."""
    order = sorted(terms, key=lambda t: (-df[t], t))
    return [tuple(sorted((order[i], order[j]))) for i in range(len(order)) for j in (i + 1, i + 2) if j < len(order)]


def _group(docs: DataFrame, items: list[str | None], k: int, id: str, text: str) -> DataFrame:
    """(item: place in the list, id, score, rank)."""
    spark = docs.sparkSession
    found = [list(dict.fromkeys(terms_of(t))) for t in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in found for t in own}))}
    held = cut(held_terms(docs, vocabulary, id, text))
    total = held.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = [0] * len(vocabulary)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row for each term of these items
        df[r["t"]] = r["n"]
    weights = np.array([weight(total["n"], d) for d in df], np.int64)
    queries = [(own := [vocabulary[t] for t in terms], pairs_of([t for t in own if df[t]], df)) for terms in found]
    sent = spark.sparkContext.broadcast((weights, queries, total["n"], total["l"], k))
    best = held.where(F.size("terms") > 0).mapInArrow(lambda it: _ranked(it, sent.value), "item int, id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, id, score): each item's k documents of the highest score."""
    own = items.select(F.col(item).alias("item_"), F.col(item_text).alias("text_"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text_")), F.lit(0)).alias("b")).first()["b"]
    groups, out = 1 + size // item_bytes, None
    for g in range(groups):
        part = own.where(F.pmod(F.xxhash64("item_", "text_"), F.lit(groups)) == g) if groups > 1 else own
        rows = part.collect()  # texts of about ITEM_BYTES
        names = docs.sparkSession.createDataFrame([(i, r["item_"]) for i, r in enumerate(rows)], f"item int, item_ {items.schema[item].dataType.simpleString()}")
        found = _group(docs, [r["text_"] for r in rows], k, id, text)
        found = found.join(F.broadcast(names), "item").select(F.col("item_").alias(item), "rank", F.col("id").alias(id), "score")  # a row for each item of the group
        out = found if out is None else out.unionByName(found)
    return out
