"""BPE encoding and decoding with a pair occurrence index.

The vocabulary file is a ``tokenizers`` JSON of the word-end kind: NFC, white space, lower case, a split into words,
bytes as symbols, and a mark on the last symbol of each word. Its path is a parameter.

In a task, texts are cut at white space, and each distinct piece is encoded once. The symbols of all new words lie in
one array with links to their neighbours. An index maps each mergeable pair to all its positions; ranks that are
present wait in a heap. The lowest rank is taken, applied to all its positions at once, and the pairs that arise are
added to their lists. A merged symbol only takes part in later merges, so ascending order over all words gives what
merging word by word gives.

Memory: at most ``TEXT`` characters of buffered text (or one row) and ``PIECES`` known pieces a task.

Defined results
  null text: empty. Empty: no tokens, digests of nothing. Strings of special tokens in a text become their ids, as the
  library does by default. Repeated rows and ids: a row each. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TEXT, PIECES = 4_000_000, 200_000
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(pattern)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + WORD_END] for s in symbols], np.int32)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.left, self.right, self.made = left, right, np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(left << 20 | right)
        self.keys, self.ranks = (left << 20 | right)[order], order
        self.text = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = token
        self.bytes = [t.encode() for t in self.text]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        n = len(sym)
        # Links; position n is a stop that matches nothing.
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[ends - size] = n
        sym = np.append(sym, np.int32(-1))
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions on their ranks' lists."""
            r = self.rank(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(r)]
            else:
                bounds = [0, 1]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rank = int(r[a])
                if rank in index:
                    index[rank].append(at[a:b])
                else:
                    index[rank] = [at[a:b]]
                    heapq.heappush(active, rank)

        add(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            after = nxt[at]
            good = (sym[at] == a) & (sym[after] == b)  # the pair may be gone by now
            at, after = at[good], after[good]
            if not len(at):
                continue
            if a == b:  # of overlapping pairs the first counts
                at, taken, keep = np.unique(at), set(), []
                for p in at.tolist():
                    if p not in taken:
                        keep.append(p)
                        taken.add(int(nxt[p]))
                at = np.array(keep, np.int32)
                after = nxt[at]
            sym[at] = self.made[rank]
            sym[after] = -1
            beyond = nxt[after]
            nxt[at] = beyond
            inside = beyond < n
            prv[beyond[inside]] = at[inside]
            before = prv[at]
            fresh = np.concatenate([at[inside], before[before < n]])
            if len(fresh):
                add(np.unique(fresh) if a == b else fresh)
        kept = sym[:n] >= 0
        return sym[:n][kept], np.add.reduceat(kept, ends - size).astype(np.int64) if n else np.zeros(0, np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normal(piece: str) -> str:
    """NFC, then lower case character by character (a final sigma is no special case)."""
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


#: White space to Python, but not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_PIECE = regex.compile(rf"(?:\S|[{SEPARATORS}])+")


def split(text: str) -> list[str]:
    return _PIECE.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class Encoder:
    """Pieces between white space and their ids, filled from batch to batch."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.decoded: list[bytes] = []

    def cut(self, text: str) -> list[str]:
        if "<|" not in text or not self.vocab.find_special.search(text):
            return split(text)
        out: list[str] = []
        for i, part in enumerate(self.vocab.find_special.split(text)):
            out += [" " + part] if i % 2 else split(part)  # a piece with a space can't be ordinary text
        return out

    def learn(self, rows: list[list[str]]) -> None:
        """Encode the pieces of these rows that aren't known."""
        fresh = list({p: None for row in rows for p in row if p not in self.pieces})
        if not fresh:
            return
        words: dict[str, int] = {}
        parts: list[list[str]] = []
        for p in fresh:
            if p[0] == " ":
                part = [p]
            elif p.isascii():
                low = p.lower()
                part = [low] if low.isalpha() else self.vocab.split.findall(low)
            else:
                part = self.vocab.split.findall(normal(p))
            parts.append(part)
            for w in part:
                if w not in words:
                    words[w] = len(words)
        plain = [w for w in words if w[0] != " "]
        ids, sizes = self.vocab.encode_words(plain)
        ends = np.cumsum(sizes)
        found = {w: ids[e - s : e].tolist() for w, e, s in zip(plain, ends.tolist(), sizes.tolist(), strict=True)}
        found |= {w: [self.vocab.special[w[1:]]] for w in words if w[0] == " "}
        text, flat, size = self.vocab.bytes, [], []
        for p, part in zip(fresh, parts, strict=True):
            self.pieces[p] = len(self.decoded)
            own = found[part[0]] if len(part) == 1 else [i for w in part for i in found[w]]
            flat += own
            size.append(len(own))
            self.decoded.append(b" ".join([text[i] for i in own]))
        new = np.array(size, np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(new) - new])
        self.size = np.concatenate([self.size, new])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def ids(self, row: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, piece numbers) of a row of known pieces."""
        piece = np.fromiter(map(self.pieces.__getitem__, row), np.int64, len(row))
        size = self.size[piece]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[piece] - ends + size, size)], piece


def _buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most TEXT characters, or one row."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            if texts and held + len(t) > TEXT:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


def _rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, Encoder, Iterator[list[str]]]]:
    encoder = Encoder(vocabulary(path))
    for ids, texts in _buffered(batches):
        if len(encoder.pieces) > PIECES:
            encoder.reset()
        step = max(1, len(texts) // 16)
        fresh: dict[str, None] = {}
        for t in texts:  # new pieces only; the rows are cut again below, so that they needn't all be held
            fresh |= dict.fromkeys(p for p in encoder.cut(t) if p not in encoder.pieces)
        encoder.learn([list(fresh)])
        del fresh
        for k in range(0, len(texts), step):
            yield ids[k : k + step], encoder, map(encoder.cut, texts[k : k + step])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for ids, encoder, rows in _rows(batches, path):
        n, one, two = [], [], []
        for row in rows:
            tokens, piece = encoder.ids(row)
            n.append(len(tokens))
            one.append(hashlib.sha256(tokens.astype("<u4").tobytes()).hexdigest())
            two.append(hashlib.sha256(b" ".join(map(encoder.decoded.__getitem__, piece.tolist()))).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for ids, encoder, rows in _rows(batches, path):
        for i, row in zip(ids, rows, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([encoder.ids(row)[0]], pa.list_(pa.int32()))], ["id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    text = vocabulary(path).text
    for batch in batches:
        out = [" ".join([text[i] for i in row or ()]) for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "decoded"])


def _texts_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _texts_of(docs, id, text).mapInArrow(lambda it: _ids(it, path), "id long, ids array<int>").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded) of every row of ids; tokens are joined by a space, as a tokenizer without a decoder does."""
    small_batches(encoded.sparkSession)
    return encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(lambda it: _texts(it, path), "id long, decoded string").withColumnRenamed("id", id)


def encode_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _texts_of(docs, id, text).mapInArrow(lambda it: _digests(it, path), schema).withColumnRenamed("id", id)
