"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Every whole text is scanned once. Base spans come from three fixed patterns. Further candidates are runs of at least
LEAST letters, digits and + / _ -, or what base spans leave of them; of each the encoding is inferred (hex, base32,
base36, base62, base64, or, without letters or without digits, what these can still hold), and tests are run
under it: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs about the middle of the alphabet, and lag-one
serial correlation. A candidate that uniformity, runs and correlation don't speak against still has to be unlike
ordinary words: its p-value is the chance of so even a spread of symbols in a string of its length and encoding whose
letters have the frequencies of prose (digits alone: those of leading digits). Benjamini-Hochberg thresholds over all
candidates of the corpus, one for each encoding and class of lengths, bound the share of ordinary strings among the
spans that are added.

The corpus-wide part is a histogram of p-values of fixed size; texts and candidates never leave the executors.

Defined results
  null or empty text: no spans, the digest of nothing. Repeated rows and ids: a row each. Null id: kept as null.
  Added spans never overlap base spans; parts of a run beside them that are shorter than LEAST aren't tested.
  Digits alone are tested and counted, but up to 31 of them can hardly be told from plain numbers (32 are a base span);
  letters of one case alone need about 80. Empty table: no rows. Extra columns: ignored. Very long texts: whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import CodePoints, byte_class, merged, runs
from .common import cut, small_batches
from .shingles import text_chunks

#: Kinds of spans in their order, and the base patterns (over bytes, so letters are ASCII only).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (("hex", DIGITS + b"abcdef"), ("HEX", DIGITS + b"ABCDEF"), ("base32", UPPER + b"234567"), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + b"+/"), ("base64url", UPPER + LOWER + DIGITS + b"-_"))
#: Of runs without letters or without digits, which have strata of their own: ordinary words don't dilute those of the above.
ALONE = (("digits", DIGITS), ("digits and signs", DIGITS + b"+/-_"), ("a to f", b"abcdef"), ("A to F", b"ABCDEF"), ("lower", LOWER), ("UPPER", UPPER), ("letters", UPPER + LOWER), ("letters64", UPPER + LOWER + b"+/"), ("letters64url", UPPER + LOWER + b"-_"), ("letters and signs", UPPER + LOWER + b"+/-_"))
HEX_CLASS, TOKEN_CLASS = byte_class(DIGITS + b"abcdef"), byte_class(DIGITS + LOWER + UPPER + b"+/_-")
_ALPHABETS = [byte_class(a) for _, a in ENCODINGS + ALONE]
_INDEX = []
for _, _a in ENCODINGS + ALONE:
    _t = np.zeros(256, np.int64)
    _t[list(_a)] = np.arange(len(_a))
    _INDEX.append(_t)
#: Shortest candidate; length classes start here. Below 20 symbols prose and random strings overlap too much.
LEAST, LENGTH_CLASSES = 20, (20, 28, 40, 64, 128)
#: Sums of squared and cubed letter frequencies of prose, and of its letters a to f only (for hex); of leading digits by
#: Benford's law (for digits alone).
PROSE, PROSE_HEX, LEADING = (0.066, 0.0055), (0.26, 0.085), (0.165, 0.037)
_ORDINARY = [PROSE_HEX if len(a) in (6, 16) else LEADING if a in (DIGITS, DIGITS + b"+/-_") else PROSE for _, a in ENCODINGS + ALONE]
#: The share of false discoveries; the two-sided level of the tests.
FALSE_SHARE, LEVEL_Z = 0.01, 3.3
#: p-values are kept as -log10 in steps of 1 / STEPS, up to MOST_BIN.
STEPS, MOST_BIN = 4, 400


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: bytes) -> tuple[int, float, float, float, float]:
    """(encoding, z of chi-squared under uniformity, z of runs, z of serial correlation, p-value under prose)."""
    raw = np.frombuffer(token, np.uint8)
    places = range(len(ENCODINGS)) if _mixed(token) else range(len(ENCODINGS), len(_ALPHABETS))
    enc = next((i for i in places if _ALPHABETS[i][raw].all()), places[-1])
    k, n = int(_ALPHABETS[enc].sum()), len(raw)
    x = _INDEX[enc][raw]
    counts = np.bincount(x, minlength=k).astype(float)
    chi = k / n * float((counts**2).sum()) - n
    uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    two, three = _ORDINARY[enc]
    prose_mean = k + k * (n - 1) * two - n
    prose_sd = k * math.sqrt(2 * two**2 + 4 * (three - two**2) * (n - 1))
    p = _normal_tail((prose_mean - chi) / prose_sd)
    high = x >= k / 2
    ones = int(high.sum())
    zeros = n - ones
    if ones and zeros:
        mean = 2 * ones * zeros / n + 1
        sd = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        run_z = (1 + int((high[1:] != high[:-1]).sum()) - mean) / sd
    else:
        run_z = math.inf
    d = x - x.mean()
    scale = float((d * d).sum())
    serial = math.sqrt(n) * float((d[1:] * d[:-1]).sum()) / scale if scale else math.inf
    return enc, uniform, run_z, serial, p


def _mixed(token: bytes) -> bool:
    """Letters (or _) and digits both."""
    return any(48 <= c < 58 for c in token) and any(c >= 65 for c in token)


def _outside(runs_: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of runs that lie outside disjoint spans and are long enough to be tested; both lists are in order."""
    k = 0
    for a, b in runs_:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at = k
        while at < len(taken) and taken[at][0] < b:
            if taken[at][0] - a >= LEAST:
                yield a, taken[at][0]
            a = max(a, taken[at][1])
            at += 1
        if b - a >= LEAST:
            yield a, b


def scan_text(raw: np.ndarray, at: int, end: int, base_hex: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> tuple[list, list]:
    """(base spans, candidates) of one text in bytes from its start: (kind, start, end), (start, end, stratum, bin)."""
    base, found = [(2, a, b) for a, b in base_hex], []
    text = raw[at:end].tobytes()
    if b"=" in text or b":" in text:
        base += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        base += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for a, b in _outside(tokens, merged([(s, e) for _, s, e in base])):
        enc, uniform, run_z, serial, p = battery(text[a:b])
        passes = abs(run_z) <= LEVEL_Z and abs(serial) <= LEVEL_Z and uniform <= LEVEL_Z
        length = sum(b - a >= x for x in LENGTH_CLASSES) - 1
        level = min(MOST_BIN, int(-math.log10(max(p, 1e-300)) * STEPS))
        found.append((a, b, enc * len(LENGTH_CLASSES) + length, level if passes else 0))
    return base, found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    tried = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("level", pa.int32())])
    for batch in batches:
        base_rows, tried_rows = [], []
        for _, raw, offsets in text_chunks(batch.column(1)):
            points = CodePoints(raw)
            hexes, tokens = [list(zip(*(x.tolist() for x in runs(raw, offsets, c, n)), strict=True)) for c, n in ((HEX_CLASS, HEX_LEAST), (TOKEN_CLASS, LEAST))]
            h = t = 0
            for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                mine: list[list] = [[], []]
                while h < len(hexes) and hexes[h][0] < end:
                    mine[0].append((hexes[h][0] - at, hexes[h][1] - at))
                    h += 1
                while t < len(tokens) and tokens[t][0] < end:
                    mine[1].append((tokens[t][0] - at, tokens[t][1] - at))
                    t += 1
                base, found = scan_text(raw, at, end, *mine)
                point = lambda b, at=at: int(points(at, at + b))
                base_rows.append([{"start": point(a), "kind": kind, "end": point(b)} for kind, a, b in base])
                tried_rows.append([{"start": point(a), "end": point(b), "stratum": s, "level": v} for a, b, s, v in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_rows, pa.list_(span)), pa.array(tried_rows, pa.list_(tried))], ["id", "base", "tried"])


def thresholds(histogram: list[tuple[int, int, int]], share: float = FALSE_SHARE) -> dict[int, int]:
    """The least level of each stratum that Benjamini-Hochberg admits, from (stratum, level, count)."""
    out = {}
    for stratum in {s for s, _, _ in histogram}:
        levels = sorted(((v, c) for s, v, c in histogram if s == stratum), reverse=True)
        total, above = sum(c for _, c in levels), 0
        for level, count in levels:
            above += count
            if level and 10.0 ** (-level / STEPS) <= share * above / total:
                out[stratum] = level
    return out


SPAN = "array<struct<start:long,kind:int,end:long>>"
SCANNED = f"id long, base {SPAN}, tried array<struct<start:long,end:long,stratum:int,level:int>>"


def _scanned(docs: DataFrame, id: Column, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(id.cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scan, SCANNED)


def limits_of(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Thresholds from the corpus-wide histogram: strata times levels rows, at most."""
    return thresholds([tuple(r) for r in scanned.select(F.explode("tried").alias("t")).groupBy("t.stratum", "t.level").count().collect()], share)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end) in code points, sorted; kind is a place in KINDS."""
    rows = cut(_scanned(docs, F.col(id), text))
    limits = limits_of(rows, share)
    spans = F.col("base")
    if limits:
        least = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
        good = F.filter("tried", lambda t: (t["level"] > 0) & (t["level"] >= F.coalesce(F.try_element_at(least, t["stratum"]), F.lit(MOST_BIN + 1))))
        spans = F.concat("base", F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).cast("int").alias("kind"), t["end"].alias("end"))))
    return rows.select(F.col("id").alias(id), F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = scan(docs, id, text)
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)  # noqa: E731  a second parameter would be the place in the array
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return rows.select(id, *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def blank(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with these spans, which may overlap, replaced by a mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", share: float = FALSE_SHARE, length: str | None = None) -> DataFrame:
    """``docs`` with a mark for each span; clean rows stay as they are. ``length``: a column that holds the text's length.

    Thresholds come from a first pass over all texts; the second scans again and rewrites, so nothing is joined.
    """
    limits = limits_of(_scanned(docs, F.lit(0), text), share)
    place, counted = docs.columns.index(text), docs.columns.index(length) if length else -1

    def run(batches):
        for batch in batches:
            found = next(_scan(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(place)], ["id", "text"])])))
            if not batch.num_rows:
                yield batch
                continue
            texts = batch.column(place).to_pylist()
            sizes = batch.column(counted).to_pylist() if length else []
            for i, (base, tried) in enumerate(zip(found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True)):
                spans = [(s["start"], s["end"]) for s in base] + [(t["start"], t["end"]) for t in tried if t["level"] and t["level"] >= limits.get(t["stratum"], MOST_BIN + 1)]
                if spans:
                    texts[i] = blank(texts[i], spans, mark)
                    sizes[i:i + 1] = [len(texts[i])] if length else []
            columns = list(batch.columns)
            if length:
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
