"""Personal data: fixed patterns, and spans decoded by a character-level BiLSTM-CRF.

The tagger (lstm_crf.py) is trained in a task from labelled spans: stretches of a bounded sample of texts with their
base spans, and with examples put in: spans of the patterns' forms, of forms that the patterns miss (spelt-out
addresses, numbers without a plus sign in groups, other separators), and look-alikes that are no personal data
(versions, prices, dates, codes). The stretches are drawn from whole texts, so what that task gets is bounded
whatever the length of texts. The tagger then reads every character of every text in overlapping windows. Where windows
overlap, their scores are averaged by place, each with less weight towards its end, and one Viterbi pass over the whole
text decides every character.

A decoded span is added if it is clear of base spans, stands alone, and its numbers fit its kind as the base kinds ask
(parts of at most 255, a card's check digit, the count of a phone's digits); its form is the tagger's to judge. Base
spans always stay.

Defined results
  null or empty text: no spans, the digest of nothing. Repeated and null ids: a row each. Very long texts: whole, in
  windows. Empty table: no rows. Extra columns: ignored. No text to learn from: spans of the patterns' own examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import CONTINUATION, CodePoints, merged
from .common import learned, small_batches
from .lstm_crf import SHARED, STEP, WINDOW, Tagger
from .shingles import text_chunks

#: Kinds in their order, and the base patterns over bytes.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(rb"[A-Za-z0-9._%+-]+\Z")
# A match never begins within a run of digits, as it would have begun where the run does.
IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
#: Texts of the training sample; stretches of each, and their characters before and behind the training window; windows
#: made from them; steps of training; characters of a training window. Added spans are at least so long.
SAMPLE, STRETCHES, AROUND, WINDOWS, STEPS, LENGTH = 400, 16, 200, 6000, 450, 72
LEAST = {"email": 6, "ip": 7, "card": 13, "phone": 9}


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: bytes) -> list[tuple[int, int]]:
    """Matches from left to right. Each sign @ is tried with all of the local part before it, so time is linear."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[text[start - 1]]:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find(b"@", max(at + 1, done))
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b"."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(b" ", b"").replace(b"-", b"") if m.end() - m.start() <= 40 else b""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if b"+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(48 <= c < 58 for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- training

def _digits(rng, shape: str) -> str:
    return "".join(str(rng.integers(10)) if c == "#" else c for c in shape)


def _card(rng) -> str:
    body = _digits(rng, str(rng.choice(["4", "5", "34", "6"])) + "#" * int(rng.choice([11, 13, 14, 14, 14])))
    last = next(d for d in "0123456789" if luhn((body + d).encode()))
    sep, step = str(rng.choice(["", " ", "-", ".", "  "], p=[0.25, 0.25, 0.25, 0.15, 0.1])), int(rng.choice([4, 4, 4, 5]))
    return sep.join((body + last)[i : i + step] for i in range(0, len(body) + 1, step))


def _email(rng, a: str, b: str, c: str) -> str:
    at = str(rng.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "<at>", " <at> ", "(AT)"]))
    dot = str(rng.choice([".", ".", "(dot)", " (dot) ", "[dot]", " [dot] ", "<dot>", "(DOT)"])) if at != "@" else "."
    local = str(rng.choice([f"{a}.{b}", f"{a}_{b}", f"{a}{rng.integers(100)}", a, f"{a}-{b}"]))
    return f"{local}{at}{c}{dot}{rng.choice(['com', 'org', 'net', 'de', 'info', 'co'])}"


def _phone(rng) -> str:
    groups = [0]
    while not 9 <= sum(groups) <= 13:
        groups = [int(rng.integers(2, 7)) for _ in range(int(rng.integers(2, 6)))]
    seps = ["", *([str(rng.choice([" ", "-", ".", "/"]))] * (len(groups) - 1))]
    if rng.random() < 0.3:
        seps[1] = str(rng.choice([" ", "-", "/", "."]))
    parts = [_digits(rng, "#" * g) for g in groups]
    if rng.random() < 0.3:
        k = int(rng.integers(2))
        parts[k] = f"({parts[k]})"
    return str(rng.choice(["+", "", "00", "1-"], p=[0.3, 0.55, 0.1, 0.05])) + "".join(s + p for s, p in zip(seps, parts, strict=True))


def _example(rng, words: np.ndarray) -> tuple[int, str]:
    """(kind, text) of a span; kind -1: something that only looks like one."""
    a, b, c = (str(rng.choice(words)).lower() for _ in range(3))
    kind = int(rng.integers(-2, 4))
    if kind == 0:
        return 0, _email(rng, a, b, c)
    if kind == 1:
        return 1, str(rng.choice([".", ".", "[.]", "(.)", " . ", "-dot-"])).join(str(rng.integers(256)) for _ in range(4))
    if kind == 2:
        return 2, _card(rng)
    if kind == 3:
        return 3, _phone(rng)
    looks = [f"{a}: {b}", "v#.#.#", "##.##", "$#,###.##", "####-##-##", "##:##", "#####", f"{a}-{b}-{c}", f"www.{a}.com/{b}", "###", f"{a}@", "########", f"(#) {b}", "#.#", "1,234,567", "a1b2c3d4e5f6"]
    looks += [f"{a} at {b}", f"{a} at {b}. {c}", f"{a}.{b}", f"@{a}", f"{a} (at {b}) {c}", f"{a} ({b}) {c}", f"{a} [{b}] {c}.", "####-##-##T##:##:##", "##/##/####", "####, ####, ####", "# + # = ##", "[##]", "##.##.####", "#.#.#.#.#.#", "### ###", f"{a}[##]", f"##-{a}-####", "##,###,###,###", "id ############", "no. ################"]
    return -1, _digits(rng, str(rng.choice(looks)))


def stretches_of(text: str, n: int = STRETCHES, seed: int = 0) -> list[tuple[str, int]]:
    """(stretch, place of the training window in it), drawn from all of a text."""
    rng, out = np.random.default_rng(seed), []
    for at in rng.integers(max(1, len(text) - LENGTH + 1), size=n).tolist():
        begin = max(0, at - AROUND)
        out.append((text[begin : at + LENGTH + AROUND], at - begin))
    return out


def training_windows(stretches: list[tuple[str, int]], n: int = WINDOWS, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tags) of windows: stretches of texts with their base spans, and with examples put into some."""
    rng = np.random.default_rng(seed)
    stretches = [s for s in stretches if len(s[0]) > 20] or [("plain words stand here, one after the other, and nothing else is said.", 0)]
    words = np.array(sorted({w for s, _ in stretches for w in re.findall(r"[A-Za-z]{2,10}", s)}) or ["name", "site", "mail"])
    x, y = np.full((n, LENGTH), 256, np.int64), np.zeros((n, LENGTH), np.int64)
    for i in range(n):
        t, at = stretches[int(rng.integers(len(stretches)))]
        if i % 3:
            around = t[at : at + LENGTH]
            kind, example = _example(rng, words)
            cut = int(rng.integers(len(around) + 1))
            gap = str(rng.choice([" ", " ", "\n", ": ", " (", ""], p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))
            behind = str(rng.choice([" ", ". ", ", ", "\n", ")"]))
            piece = around[:cut] + gap + example + behind + around[cut:]
            shift = int(rng.integers(max(1, len(piece) - LENGTH + 1)))
            spans = [(kind, cut + len(gap), cut + len(gap) + len(example))] if kind >= 0 else []
            spans += [(k, a, b) for k, a, b in _char_spans(piece) if not any(s < b and a < e for _, s, e in spans)]
            piece, spans = piece[shift : shift + LENGTH], [(k, a - shift, b - shift) for k, a, b in spans]
        else:
            spans = [(k, a - at, b - at) for k, a, b in _char_spans(t)]
            piece = t[at : at + LENGTH]
        lead = np.frombuffer(piece.encode(), np.uint8)
        lead = lead[~CONTINUATION[lead]]
        x[i, : len(lead)] = lead
        for k, a, b in spans:
            if b > 0 and a < len(lead):
                y[i, max(0, a) : min(b, len(lead))] = k + 1
    return x, y


def _char_spans(text: str) -> list[tuple[int, int, int]]:
    raw = text.encode()
    if len(raw) == len(text):
        return base_spans(raw)
    points = CodePoints(np.frombuffer(raw, np.uint8))
    return [(k, int(points(0, a)), int(points(0, b))) for k, a, b in base_spans(raw)]


def train(stretches: list[tuple[str, int]], steps: int = STEPS, seed: int = 6, batch: int = 128) -> Tagger:
    x, y = training_windows(stretches, seed=seed)
    rng, tagger, moments = np.random.default_rng(seed), Tagger(len(KINDS) + 1), {}
    for k in range(steps):
        some = rng.integers(0, len(x), batch)
        tagger.step(x[some], y[some], moments, 0.02 * (1 - 0.9 * k / steps))
    return tagger


def _drawn(docs: DataFrame, most: int, seed: int, id: str, text: str) -> DataFrame:
    """(h, stretch, at) of the ``most`` different rows with the smallest seeded hashes, ``STRETCHES`` of each."""
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.lit(seed), id, text).alias("h"), F.col(text).alias("text"))
    share = min(1.0, (most + 8 * most**0.5 + 20) / max(1, docs.count()))  # enough rows but with a chance below 1e-14
    some = rows.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, *s) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in stretches_of(t, seed=h & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], ["h", "stretch", "at"])

    small_batches(docs.sparkSession)
    drawn = some.mapInArrow(run, "h long, stretch string, at int").groupBy("h").agg(F.slice(F.array_sort(F.collect_set(F.struct("stretch", "at"))), 1, STRETCHES).alias("s"))
    return drawn.orderBy("h").limit(most).select("h", F.explode("s").alias("s")).select("h", "s.stretch", F.col("s.at").cast("long").alias("at"))


def _in_order(drawn: pa.Table) -> list[tuple[str, int]]:
    return [(x["stretch"], x["at"]) for x in drawn.sort_by([("h", "ascending"), ("stretch", "ascending"), ("at", "ascending")]).to_pylist()]


def sample_stretches(docs: DataFrame, most: int = SAMPLE, seed: int = 17, id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Stretches of a bounded sample of whole texts."""
    return learned(_drawn(docs, most, seed, id, text), _in_order)


def _trained(drawn: pa.Table) -> Tagger:
    return train(_in_order(drawn))


def fit(docs: DataFrame, most: int = SAMPLE, seed: int = 17, id: str = "doc_id", text: str = "text") -> Tagger:
    """The tagger is trained in a task."""
    return learned(_drawn(docs, most, seed, id, text), _trained)


# ---------------------------------------------------------------- decoding

def of_digits(kind: int, span: str) -> int:
    """Cards and phones are told apart by the check digit, whichever of them the tagger takes a number for."""
    if kind < 2:
        return kind
    digits = "".join(c for c in span if c in "0123456789")
    return 2 if 13 <= len(digits) <= 19 and luhn(digits.encode()) else 3


def plausible(kind: int, before: str, span: str, after: str) -> bool:
    """Whether a decoded span stands alone, and its numbers are such as its kind has."""
    if len(span) < LEAST[KINDS[kind]] or before.isalnum() or after.isalnum():
        return False
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits.encode())
    if kind == 3:
        return 9 <= len(digits) <= 15
    return not all(c.isalnum() or c in " .,;:!?-_\n" for c in span)  # words alone are no address


def window_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, text) of every window over texts of so many characters that lie one after the other."""
    n = np.maximum(0, -(-np.maximum(0, counts - WINDOW) // STEP)) + (counts > 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP, text


def averaged_scores(tagger: Tagger, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores (tag but 0, character) over those of tag 0 of texts one after the other, averaged over their windows."""
    first, text = window_table(np.diff(at))
    begin, end = at[:-1][text], at[1:][text]
    padded = np.concatenate([chars, [256]])
    total = np.zeros((tagger.tags - 1, len(chars)), np.float32)
    ramp = np.arange(1, SHARED + 1, dtype=np.float32) / (SHARED + 1)  # with its mirror image it makes one
    for k in range(0, len(first), 2048):
        f, b, e = first[k : k + 2048], begin[k : k + 2048], end[k : k + 2048]
        place = f[:, None] + np.arange(WINDOW)
        place = np.where(place < e[:, None], place, len(chars))
        scores = np.ascontiguousarray(tagger.scores(padded[place]).transpose(2, 1, 0))
        scores[f > b, :, :SHARED] *= ramp
        scores[f + WINDOW < e, :, -SHARED:] *= ramp[::-1]
        for window, start, size in zip(scores, f.tolist(), np.minimum(WINDOW, e - f).tolist(), strict=True):
            total[:, start : start + size] += window[:, :size]
    return total


def decode_chunk(tagger: Tagger, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The tag of every character (code point) of a chunk of texts: one Viterbi pass over each whole text."""
    lead = ~CONTINUATION[raw]
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    return tagger.paths(averaged_scores(tagger, raw[lead].astype(np.int64), at), at)


def spans_of(tagger: Tagger, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each text in code points: (kind, start, end)."""
    tags, points = decode_chunk(tagger, raw, offsets), CodePoints(raw)
    points(0, 0)
    row = points.total[offsets]
    edge = np.zeros(len(tags) + 1, bool)
    edge[row] = True
    new = np.flatnonzero((tags != np.concatenate([[0], tags[:-1]])) | edge[:-1])
    end = np.concatenate([new[1:], [len(tags)]]) if len(new) else new
    keep = tags[new] > 0
    new, end, kind = new[keep], end[keep], tags[new[keep]] - 1
    text = np.searchsorted(row, new, "right") - 1
    k = 0
    maybe = (raw == 64) | ((raw >= 48) & (raw < 58))
    has = np.concatenate([[0], np.cumsum(maybe)])[offsets]
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        base = []
        if has[i + 1] > has[i]:  # every pattern needs a digit or @
            base = [(q, int(points(a, a + s)), int(points(a, a + e))) for q, s, e in base_spans(raw[a:b].tobytes())]
        added, decoded, taken, place = [], None, merged([(x, y) for _, x, y in base]), 0
        while k < len(new) and text[k] == i:
            s, e, q = int(new[k] - row[i]), int(end[k] - row[i]), int(kind[k])
            while place < len(taken) and taken[place][1] <= s:
                place += 1
            if e - s >= LEAST[KINDS[q]] and not (place < len(taken) and taken[place][0] < e):
                if decoded is None:
                    decoded = raw[a:b].tobytes().decode()
                while s < e and not (decoded[s].isalnum() or decoded[s] in "+(["):  # blanks and stops at the ends
                    s += 1
                while s < e and not (decoded[e - 1].isalnum() or decoded[e - 1] in ")]"):
                    e -= 1
                q = of_digits(q, decoded[s:e])
                if plausible(q, decoded[max(0, s - 1) : s], decoded[s:e], decoded[e : e + 1]):
                    added.append((q, s, e))
            k += 1
        yield base, added


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))


def find(docs: DataFrame, tagger: Tagger, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): every span with its kind, place in code points, text, and whether a pattern found it."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("pattern", pa.bool_())]))
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for begin, raw, offsets in text_chunks(batch.column(1)):
                for i, (base, added) in enumerate(spans_of(sent.value, raw, offsets)):
                    t = texts[begin + i] or ""
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b], "pattern": p} for p, spans in ((True, base), (False, added)) for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "spans"])

    return _rows(docs, id, text).mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long,text:string,pattern:boolean>>").withColumnRenamed("id", id)


def find_digests(docs: DataFrame, tagger: Tagger, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and the digest of base spans, all spans joined, and how many they are, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, n_all = [], [], [], []
            for _, raw, offsets in text_chunks(batch.column(1)):
                for base, added in spans_of(sent.value, raw, offsets):
                    counts.append([sum(k == q for k, _, _ in base) for q in range(4)])
                    digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(sorted(base + added)))
                    n_all.append(len(base) + len(added))
            table = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, q]) for q in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(n_all, pa.int64())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return _rows(docs, id, text).mapInArrow(run, schema).withColumnRenamed("id", id)
