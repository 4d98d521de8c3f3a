import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from brute_force import jaccard_truth
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantaloom.llm import bpe, gru, mixing, ngram_jaccard, pii, queries, secret_scan, toxicity
from quantaloom.llm.shingles import words

PATH = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- 10

def test_jaccard(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sizes, roots = jaccard_truth([r for r in rows if r[0] is not None])
    got = ngram_jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], roots[r.doc_id])


def test_jaccard_in_blocks(spark, monkeypatch):
    """A large group of near copies, cut into many blocks."""
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    sizes, roots = jaccard_truth(rows)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], roots[i]) for i, _ in rows}


@pytest.mark.parametrize(("block", "fan", "rows_held"), [(8, 8, 8192), (20, 2, 16), (512, 8, 8192)])
def test_groups_of_many_sizes(spark, monkeypatch, block, fan, rows_held):
    """Passages that many texts share, large and small groups, and pairs just below and just above the threshold."""
    rng = random.Random(21)
    w = lambda n: [str(rng.randrange(10**7)) for _ in range(n)]
    texts, passage = [], w(60)
    for own in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 30):  # tails of their own: 56 shingles in common
        texts += [passage + w(own) for _ in range(9)]
        texts += [w(own) + passage for _ in range(3)]
    for size in (2, 3, 9, 40, 90):
        base = w(90)
        for k in range(size):
            one = list(base)
            for at in rng.sample(range(90), k % 5):
                one[at] = str(rng.randrange(10**7))
            texts.append(one + w(k % 3) if k % 7 else one[: 90 - k % 30])
    for common in range(70, 81):  # at 0.75 exactly, and a shingle more or less
        base = w(104)
        texts += [base, base[: common + 4]]
    texts += [w(3), w(3), ["a", "b"], ["A", "b"], [], w(400), passage * 3, passage[:50]]
    rows = [(7 * i + 1, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    for name, value in (("BLOCK", block), ("FAN", fan), ("ROWS", rows_held), ("SET_BYTES", rows_held * 4096)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    sizes, roots = jaccard_truth(rows)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], roots[i]) for i, _ in rows}


def test_rows_stay_in_proportion():
    """A dense group whose members all fall short of the threshold gives no more rows than it has, and no edges."""
    rng = random.Random(2)
    base = [str(rng.randrange(10**7)) for _ in range(200)]
    texts = []
    for _ in range(150):
        one = list(base)
        for at in rng.sample(range(200), 5):
            one[at] = str(rng.randrange(10**7))
        texts.append(" ".join(one))
    sets = list(ngram_jaccard.shingle_sets(pa.array(texts)))
    n = len(sets)
    narrow = {"id": pa.array(range(n), pa.int64()), "comp": pa.array(range(n), pa.int64()), "below": pa.array([[]] * n, pa.list_(pa.int64())), "token": pa.array([1] * n, pa.int64()), "part": pa.array([-1] * n, pa.int64()), "side": pa.array([0] * n, pa.int32())}
    wide = narrow | {"n": pa.array([len(x) for x in sets], pa.int64()), "bitmap": pa.array([ngram_jaccard.bitmaps(x) for x in sets], pa.binary())}
    kept = list(ngram_jaccard._survivors(iter([pa.RecordBatch.from_pydict(wide)]), 0.75))
    assert sum(b.num_rows for b in kept) <= n
    linked = {(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    edges = list(ngram_jaccard._edges(iter([pa.RecordBatch.from_pydict(narrow | {"tokens": pa.array([x.tobytes() for x in sets], pa.binary())})]), 75, 100))
    assert sum(b.num_rows for b in edges) < n
    assert all((max(a, b), min(a, b)) in linked for e in edges for a, b in zip(*(c.to_pylist() for c in e.columns), strict=True))


def rows_made(spark, since: int, of: str) -> dict[str, int]:
    """Output rows of the Generate nodes over this column in executions after the given one, by description."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows = spark._jsparkSession.sharedState().statusStore(), {}
    known = store.executionsList()
    for i in (known.apply(k).executionId() for k in range(known.size())):
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size()) if i > since):
            if node.name() == "Generate" and of in node.desc():
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows[m.accumulatorId()] = re.sub(r"#\d+L?", "", node.desc()), int(values.apply(m.accumulatorId()).replace(",", ""))
    out = collections.Counter()
    for desc, n in rows.values():
        out[desc] += n
    return out


def last_execution(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    known = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((known.apply(k).executionId() for k in range(known.size())), default=-1)


def passages(times: int):
    """One passage that more than 16 texts have, ten that so many have at five times the size only, near copies, and texts with nothing in common."""
    rng = random.Random(4)
    w = lambda n: [str(rng.randrange(10**7)) for _ in range(n)]
    texts = [w(70) for _ in range(100 * times)]
    for n in (20, *[10] * 10):
        passage = w(30)
        texts += [passage + w(40) for _ in range(n * times)]
        texts.append([*texts[-1], "end"])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_rows_by_token_grow_with_the_input(spark, monkeypatch):
    """Tokens that become hot as the input grows don't make a step of their own that grows faster."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    made = []
    for times in (1, 5):
        rows, since = passages(times), last_execution(spark)
        sizes, roots = jaccard_truth(rows)
        got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], roots[i]) for i, _ in rows}
        made.append(rows_made(spark, since, "sketch"))
    small, large = made
    assert small and set(small) == set(large) and all(large[k] < 10 * small[k] for k in small), made


def test_too_many_hot_tokens_to_send(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", 0)
    rows = passages(1)
    sizes, roots = jaccard_truth(rows)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], roots[i]) for i, _ in rows}


def test_large_sets_link(spark):
    rng = random.Random(8)
    w = [str(rng.randrange(10**7)) for _ in range(6000)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:5200])), (2, " ".join(w[:4400])), (3, " ".join(w[3000:] + [str(rng.randrange(10**7)) for _ in range(3000)]))]
    sizes, roots = jaccard_truth(rows)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


def test_jaccard_query_and_one_of_each(spark, docs, empty):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sizes, roots = jaccard_truth(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op10_ngram_jaccard"](spark, d).collect()} == {i: (sizes[i], roots[i]) for i, _ in rows}
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    kept = ngram_jaccard.one_of_each(docs).collect()
    _, roots = jaccard_truth([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r for r in roots.values()})
    assert kept[0].__fields__ == docs.columns and any(r.doc_id is None for r in kept)


def test_repeated_ids_with_other_texts(spark):
    """Rows are decided one by one: an id's other text neither takes a group away nor links two groups."""
    rng = random.Random(12)
    one, two, three = ([str(rng.randrange(10**6)) for _ in range(60)] for _ in range(3))
    text = lambda w, end="": " ".join([*w, end]).strip()
    rows = [(5, text(one)), (7, text(one, "x")), (5, text(two)), (3, text(two)), (9, text(two, "y")), (7, ""), (7, None), (8, text(three)), (8, text(three, "z")), (8, text(three)), (None, text(one))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_jaccard.jaccard_components(df)
    assert sorted((r.doc_id, r.component_id) for r in got.where("n_shingles > 0 and doc_id is not null").collect()) == [(3, 3), (5, 3), (5, 5), (7, 5), (8, 8), (8, 8), (8, 8), (9, 3)]
    kept = [(r.doc_id, r.text) for r in ngram_jaccard.one_of_each(df).collect()]
    third = min((text(three), text(three, "z")), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(kept, key=str) == sorted([(5, text(one)), (3, text(two)), (7, ""), (7, None), (8, third), (None, text(one))], key=str)


# ---------------------------------------------------------------- 8

def test_bpe_equals_the_library(spark, docs, empty):
    tok = Tokenizer.from_file(PATH)
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["<|endoftext|>a<|startoftext|> b<|END", "aaaaaaaaaaa !!!!!! 123 it's WE'LL", "ΣΑΣ İ ǅ", "\x1d x\x1ey\u2028z\u0085", "e\u0301 \u0301e"])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    texts = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = sorted((str(i), len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for (i, _), e in zip(texts, tok.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True))
    got = bpe.encode_digests(rows, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert back == {i: tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in texts if (i or 0) >= 100}
    assert bpe.encode_digests(empty, PATH).count() == 0


def test_bpe_small_buffers(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    texts = [f"word{i} and others {i % 7} times" for i in range(60)]
    monkeypatch.setattr(bpe, "TEXT", 100)
    monkeypatch.setattr(bpe, "PIECES", 10)
    out = list(bpe._ids(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["id", "text"])]), PATH))
    assert [b.column(1)[0].as_py() for b in out] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


# ---------------------------------------------------------------- 7, 9

def base7(x):
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    s = [(m.start(), 0, m.end()) for m in a.finditer(x) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{u}:{v}" for u, k, v in sorted(s))


def base9(x):
    s = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    s += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(q) <= 255 for q in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        g = re.sub("[ -]", "", m[0])
        if 13 <= len(g) <= 19 and pii.luhn(g.encode()):
            s.append((2, m.start(), m.end()))
    s += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{u}:{v}" for k, u, v in sorted(s))


HEX = "0123456789abcdef" * 2
SPANS = ["é password='abcdEFGH12' API_KEY: 1234567 apikey=12345678", f"AKIAABCDEFGHIJKL12 {HEX}0 AKIA {HEX[:31]}", "token=token=abcdefgh", "ſecret=abcdefghi to\u212aen=abcdefgh", f"secret : \"{HEX}\"", f"{HEX}é{HEX}",
         "a@b.c é x.y+z@d-e.f.g @ @@ a@b a@b..c x@y.zé", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.255 9" * 2, "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000", "+1 (234) 567-8901 +12 +1234567890123456 +49.30.123456é", "a" * 5000 + "@" + "b.c" + "1" * 4000]


def frame(spark, docs):
    return docs.select("doc_id", "text", "id", "size").unionByName(spark.createDataFrame([(100 + i, t, 0, "s") for i, t in enumerate(SPANS)], "doc_id long, text string, id int, size string"))


def test_secret_base_spans(spark, docs, empty):
    rows = frame(spark, docs)
    got = secret_scan.scan_digests(rows).collect()
    texts = [(str(r.doc_id), hashlib.sha256(base7(r.text or "").encode()).hexdigest()) for r in rows.collect()]
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted(texts)
    assert all(set(filter(None, base7(dict(enumerate(SPANS, 100)).get(r.doc_id) or "").split(","))) <= set(r.spans.split(",")) for r in got)
    assert secret_scan.scan_digests(empty).count() == 0


def test_secret_counts(spark, docs):
    rows = frame(spark, docs)
    more = [f"{HEX} token=abcdefgh {HEX} secret:12345678", "AKIAABCDEFGHIJKL AKIAABCDEFGHIJKL passwd=abcdefgh"]
    rows = rows.unionByName(spark.createDataFrame([(200 + i, t, 0, "s") for i, t in enumerate(more)], rows.schema))
    kinds = ("assign", "access", "hex")
    want = [(str(r.doc_id), *(sum(s.startswith(f"{k}:") for s in base7(r.text or "").split(",")) for k in kinds)) for r in rows.collect()]
    got = [(str(r.doc_id), r.n_assign, r.n_access, r.n_hex) for r in secret_scan.scan_digests(rows).collect()]
    assert sorted(got) == sorted(want) and ("200", 2, 0, 2) in got and ("201", 1, 2, 0) in got


def test_battery_in_plain_words():
    rng = random.Random(40)
    for _ in range(200):
        letters = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdeABCDE0123456789+/"])
        token = "0a" + "".join(rng.choice(letters) for _ in range(rng.randrange(20, 90)))
        enc, uniform, run_z, serial, _ = secret_scan.battery(token.encode())
        alphabet = (secret_scan.ENCODINGS + secret_scan.ALONE)[enc][1].decode()
        assert set(token) <= set(alphabet)
        assert not any(set(token) <= set(a.decode()) for _, a in secret_scan.ENCODINGS[:enc])
        n, k = len(token), len(alphabet)
        chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
        assert uniform == pytest.approx((chi - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5)
        x = [alphabet.index(c) for c in token]
        high = [v >= k / 2 for v in x]
        one, zero = sum(high), n - sum(high)
        count = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * one * zero / n
        var = 2 * one * zero * (2 * one * zero - n) / (n * n * (n - 1))
        assert run_z == pytest.approx((count - mean) / var**0.5) if one and zero and var > 0 else run_z >= 0
        d = [v - sum(x) / n for v in x]
        assert serial == pytest.approx(n**0.5 * sum(a * b for a, b in zip(d, d[1:])) / sum(a * a for a in d))


def test_thresholds_are_benjamini_hochberg():
    rng = random.Random(41)
    for _ in range(50):
        tested = [(rng.randrange(3), min(40, int(rng.expovariate(0.15)))) for _ in range(rng.randrange(1, 300))]
        got = secret_scan.thresholds([(s, v, c) for (s, v), c in collections.Counter(tested).items()])
        for stratum in range(3):
            p = sorted(10.0 ** (-v / secret_scan.STEPS) for s, v in tested if s == stratum)
            k = max((i for i in range(1, len(p) + 1) if p[i - 1] <= secret_scan.FALSE_SHARE * i / len(p) and p[i - 1] < 1), default=0)
            found = sum(s == stratum and v >= got.get(stratum, 10**9) for s, v in tested)
            assert found == k


def test_long_texts_with_many_spans_are_linear():
    text = ("token=abcdefgh12 " + HEX + "g" * 30 + " ") * 3000
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(raw)])
    hexes, tokens = [list(zip(*(x.tolist() for x in secret_scan.runs(raw, offsets, c, n)), strict=True)) for c, n in ((secret_scan.HEX_CLASS, 32), (secret_scan.TOKEN_CLASS, 20))]
    began = time.perf_counter()
    base, found = secret_scan.scan_text(raw, 0, len(raw), hexes, tokens)
    assert len(base) == 6000 and len(found) == 3000 and time.perf_counter() - began < 5


def test_random_strings_are_found(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    plain = ["internationalization2024overview", "2024-01-02-notes-from-the-meeting-room", "some/path/to/file/version2/index/of/things", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"]
    df = spark.createDataFrame([(i, f"so {t} ends") for i, t in enumerate(found + plain * 15)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan_digests(df).collect()}
    assert sum(got[i] == "random:3:43" for i in range(60)) >= 50
    assert not any(got[i] for i in range(60, 120))


def test_random_strings_of_one_kind_are_found(spark):
    """Runs without digits are tested too; words, paths and plain numbers stay."""
    rng = random.Random(6)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters, n in ((upper, 80), (upper.lower(), 80), (upper + upper.lower(), 40), (upper + upper.lower() + "+/", 40), (upper + upper.lower() + "-_", 40)):
        found = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(60)]
        plain = ["donaudampfschifffahrtsgesellschaft", "some/path/to/the/file/in/the/index/of/things", "the-notes-from-the-meeting-in-the-small-room", "the_notes_from_the_meeting_in_the_small_room", "10000000000000000000000000100", "z" * 60, "-" * 80, "InternationalizationOfTheApplicationSettings"]
        df = spark.createDataFrame([(i, f"so {t} ends") for i, t in enumerate(found + plain * 8)], "doc_id long, text string")
        got = {r.doc_id: r.spans for r in secret_scan.scan_digests(df).collect()}
        assert sum(got[i] == f"random:3:{3 + n}" for i in range(60)) >= 50, letters
        assert not any(got[i] for i in range(60, len(got))), letters


def test_digits_alone_are_counted():
    """Too short to be told from plain numbers, but tested, and in the histogram; from 32 digits on they are base spans."""
    raw = np.frombuffer(b"so 8301947265830194726519 ends", np.uint8)
    (start, end, stratum, level), = secret_scan.scan_text(raw, 0, len(raw), [], [(3, 25)])[1]
    assert (start, end, level > 0) == (3, 25, True) and stratum // len(secret_scan.LENGTH_CLASSES) == len(secret_scan.ENCODINGS)


def test_random_rest_beside_base_spans(spark):
    """What a base span leaves of a longer run is tested on its own."""
    rng = random.Random(7)
    letters = "GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789"
    rest = ["g" + "".join(rng.choice(letters) for _ in range(38)) + "g" for _ in range(60)]
    df = spark.createDataFrame([(i, f"so {x}{HEX}{y} ends", 0) for i, (x, y) in enumerate(zip(rest, reversed(rest), strict=True))], "doc_id long, text string, n_chars long")
    got = [r.spans for r in secret_scan.scan_digests(df).collect()]
    assert sum(s == "random:3:43,hex:43:75,random:75:115" for s in got) >= 45
    assert sum(r.text == "so [SECRET][SECRET][SECRET] ends" and r.n_chars == len(r.text) for r in secret_scan.redact(df, length="n_chars").collect()) >= 45


def test_redact(spark, docs, empty):
    df = docs.select("doc_id", "text", "n_chars", "size").unionByName(spark.createDataFrame([(200, "é token=abcdefgh12 end", 22, "s")], docs.select("doc_id", "text", "n_chars", "size").schema))
    got = {(r.doc_id, r.text): r for r in secret_scan.redact(df, length="n_chars").collect()}
    assert (200, "é [SECRET] end") in got and got[200, "é [SECRET] end"].n_chars == 14
    assert {k for k in got if k[0] != 200} == {(r.doc_id, r.text) for r in docs.collect()}
    assert secret_scan.redact(empty).columns == empty.columns and secret_scan.redact(empty).count() == 0


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ba", "kolem", "lino", "merrick"]) for _ in range(80)) for _ in range(20)]
    return pii.train([s for i, t in enumerate(texts) for s in pii.stretches_of(t, seed=i)], steps=60)


def test_pii(spark, docs, empty, tagger):
    rows = frame(spark, docs)
    got = {(str(r.doc_id), r.base_sha256, r.spans) for r in pii.find_digests(rows, tagger).collect()}
    want = {(str(r.doc_id), hashlib.sha256(base9(r.text or "").encode()).hexdigest(), base9(r.text or "")) for r in rows.collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want}
    for i, digest, base in want:
        spans = next(g[2] for g in got if g[:2] == (i, digest))
        assert set(filter(None, base.split(","))) <= set(spans.split(","))
    one = next(r for r in pii.find(rows, tagger).collect() if r.doc_id == 106)
    assert [s.text for s in one.spans if s.pattern] == ["a@b.c", "x.y+z@d-e.f.g", "x@y.z"]
    assert pii.find_digests(empty, tagger).count() == 0


def test_stretches_come_from_whole_texts(spark, docs):
    long = "".join(f"{i:07d} " for i in range(20_000))
    found = pii.stretches_of(long, n=400, seed=1)
    assert all(len(s) <= pii.LENGTH + 2 * pii.AROUND and 0 <= at <= pii.AROUND for s, at in found)
    first = sorted(int(re.search(r"[0-9]{7}", s)[0]) for s, _ in found)
    assert first[0] < 1000 and first[-1] > 19_000
    drawn = pii.sample_stretches(docs)
    assert drawn == pii.sample_stretches(docs.repartition(5)) and max(len(s) for s, _ in drawn) <= pii.LENGTH + 2 * pii.AROUND
    assert len(pii.sample_stretches(docs, most=3)) <= 3 * pii.STRETCHES
    assert pii.sample_stretches(docs.where("false")) == []


#: Forms of which the examples of the training have none.
UNSEEN = {
    "email": ["kari.holm{at}sundal.no", "jo_petersen[at]mailbox(dot)eu", "mo-17 (at) site [dot] io", "per.berg@ fjord.no", "ann.lee <at> corp<dot>com"],
    "ip": ["192 .168 .4 .77", "172[.]16(.)254[.]1", "10 . 20 . 30 . 40"],
    "card": ["3782 822463 10005", "4111  1111  1111  1111", "5555.5555.5555.4444", "6011/1111/1111/1117"],
    "phone": ["212.555.0187", "(030) 901820 11", "089/636-48018", "00 44 20 7946 0958", "555 01 88 99 12", "1-800-555-01999"],
}
PLAIN = ["version 2.14.7", "on 2024-03-18 at 17:45", "1,250,000 of 3,400,000", "chapter (12) of 40", "kolem at lino. merrick", "room 1204-b", "ratio 3.5 to 1.25", "item #4471", "see a.b.c and d.e", "the @lino account", "9 x 12 x 40", "pages 110-118, 220"]


def test_added_spans_measured(spark):
    """What the network adds, on texts of its own corpus with forms that neither patterns nor training examples have."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.fit(corpus)
    rng = random.Random(31)
    prose_ = [t for t in (r.text for r in corpus.select("text").collect()) if t and len(t) > 600 and not re.search("[0-9@]", t)]
    texts, truth = [], []
    for kind, form in [(k, f) for k, fs in UNSEEN.items() for f in fs for _ in range(12)] + [(None, f) for f in PLAIN for _ in range(12)]:
        words_ = rng.choice(prose_).split()[:70]
        at = rng.randrange(len(words_) + 1)
        left = " ".join(words_[:at])
        begin = len(left) + bool(left)
        texts.append(" ".join([*words_[:at], form, *words_[at:]]))
        truth.append((kind, begin, begin + len(form)))
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).collect()
    spans = {r.doc_id: r.spans for r in found}
    hits, wanted, right, added = dict.fromkeys(UNSEEN, 0), dict.fromkeys(UNSEEN, 0), 0, 0
    for i, (kind, a, b) in enumerate(truth):
        over = [s for s in spans[i] if min(b, s.end) - max(a, s.start) >= 0.7 * (b - a)]
        if kind:
            wanted[kind] += 1
            hits[kind] += any(s.kind == kind for s in over)
        for s in spans[i]:
            if not s.pattern:
                added += 1
                right += kind is not None and s in over
    recall, precision = sum(hits.values()) / sum(wanted.values()), right / max(1, added)
    print("recall", {k: round(hits[k] / wanted[k], 2) for k in hits}, round(recall, 2), "precision", round(precision, 2), "added", added)
    assert recall >= 0.6 and precision >= 0.9


def plain_path(tagger, chars):
    """One Viterbi pass over a whole text, place by place, on scores averaged over its windows."""
    n, trans = len(chars), tagger.p["T"].astype(float)
    total, weight, first = np.zeros((n, tagger.tags)), np.zeros(n), 0
    while True:
        own = np.full(pii.WINDOW, 256)
        own[: len(chars[first : first + pii.WINDOW])] = chars[first : first + pii.WINDOW]
        w = np.ones(pii.WINDOW)
        if first:
            w[: pii.SHARED] = np.arange(1, pii.SHARED + 1) / (pii.SHARED + 1)
        if first + pii.WINDOW < n:
            w[-pii.SHARED :] = np.arange(pii.SHARED, 0, -1) / (pii.SHARED + 1)
        e, held = tagger.emissions(own[:, None])[:, 0], min(pii.WINDOW, n - first)
        total[first : first + held] += (w[:, None] * e)[:held]
        weight[first : first + held] += w[:held]
        if first + pii.WINDOW >= n:
            break
        first += pii.STEP
    assert np.abs(weight - 1).max() < 1e-6  # every character is read, in one window or two
    best, back = total[0], []
    for t in range(1, n):
        given = best[:, None] + trans
        back.append(given.argmax(0))
        best = given.max(0) + total[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_windows_are_reconciled_over_whole_texts(tagger):
    rng = random.Random(8)
    long = " ".join(rng.choice(["kolem", "lino", "+4420712345678", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "é", "77777777"]) for _ in range(900))
    texts = ["", "a", "+", long, long[:255], long[:256], long[:257], long[:480], long[:481], "9" * 3000, "merrick lino " * 60, "x@y.z"]
    raw = [t.encode() for t in texts]
    tags = pii.decode_chunk(tagger, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    at = 0
    for t, r in zip(texts, raw):
        chars = np.array([b for b in r if b & 0xC0 != 0x80])
        assert tags[at : at + len(t)].tolist() == (plain_path(tagger, chars) if len(t) else [])
        at += len(t)
    assert at == len(tags) and len(set(tags.tolist())) > 2


def test_paths_of_any_scores():
    """Blocks, runs and bounds against the plain pass, with scores near nought, where little is certain."""
    from quantaloom.llm import lstm_crf

    rng = np.random.default_rng(5)
    for k in range(12):
        tagger = lstm_crf.Tagger(4)
        tagger.p["T"] = (rng.normal(size=(4, 4)) * (1 + k % 3)).astype(np.float32)
        sizes = rng.integers(0, 160, 12)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        d = (rng.normal(size=(offsets[-1], 4)) * 2 - (k % 4)).astype(np.float32)
        d[:, 0] = 0
        found = tagger.paths(np.ascontiguousarray(d[:, 1:].T), offsets)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if a == b:
                continue
            best, back, trans = d[a].astype(float), [], tagger.p["T"].astype(float)
            for t in range(a + 1, b):
                given = best[:, None] + trans
                back.append(given.argmax(0))
                best = given.max(0) + d[t]
            path = [int(best.argmax())]
            for x in reversed(back):
                path.append(int(x[path[-1]]))
            assert found[a:b].tolist() == path[::-1]


def test_tagger_learns_and_decodes_the_best_path():
    from quantaloom.llm.lstm_crf import Tagger

    t = Tagger(3)
    t.p["T"] = np.random.default_rng(1).normal(size=(3, 3)).astype(np.float32)
    x = np.random.default_rng(2).integers(0, 256, (5, 6))
    e = t.emissions(np.ascontiguousarray(x.T))
    import itertools

    for k, path in enumerate(t.decode(x)):
        score = lambda p: sum(e[i, k, p[i]] for i in range(6)) + sum(t.p["T"][p[i], p[i + 1]] for i in range(5))  # noqa: E731, B023
        assert score(path) == pytest.approx(max(map(score, itertools.product(range(3), repeat=6))), rel=1e-4)
    wide, tall = t._direction(np.ascontiguousarray(x.T), "f", None), t._read(np.ascontiguousarray(x.T, dtype=np.intp), "f")
    assert np.allclose(wide, tall.transpose(0, 2, 1), atol=1e-5)


def test_crf_gradient():
    from quantaloom.llm.lstm_crf import Tagger

    t, rng = Tagger(3), np.random.default_rng(3)
    x, y = rng.integers(0, 5, (4, 7)), rng.integers(0, 3, (7, 4))
    keep = {}
    loss, d_e, d_t = t._crf(t.emissions(np.ascontiguousarray(x.T), keep), y)
    grad = {}
    for k, side in enumerate("fb"):
        t._back(d_e @ t.p["O"][k * 8 : (k + 1) * 8].T, side, keep["steps"][k], np.ascontiguousarray(x.T), grad)
    for name, at in (("T", (1, 2)), ("Uf", (3, 9)), ("Wb", (2, 5)), ("E", (3, 4))):
        was, h = t.p[name][at], 1e-2
        t.p[name][at] = was + h
        up = t._crf(t.emissions(np.ascontiguousarray(x.T)), y)[0]
        t.p[name][at] = was - h
        down = t._crf(t.emissions(np.ascontiguousarray(x.T)), y)[0]
        t.p[name][at] = was
        assert (d_t if name == "T" else grad[name])[at] == pytest.approx((up - down) / 2 / h, abs=2e-3)


# ---------------------------------------------------------------- 5

def toxic_rows(n=240, seed=6):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(["ba", "kolem", "lino", "merrick", "tun", "shida"]) + rng.choice(["", "da", "no"]) for _ in range(rng.randrange(20, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grubby", "Vilest,", "scoundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = toxic_rows()
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, known, F.col("id") % 4 != 3)
    fresh, truth = toxic_rows(seed=77)
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string"), net).collect()}
    right = sum((got[i] >= 0.3) == bool(y) for i, y in truth)
    assert right / len(truth) >= 0.95
    scored = toxicity.score(docs, net).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    left = toxicity.reject(docs, net)
    assert left.columns == docs.columns and left.count() == sum(r.score < 0.3 for r in scored)
    assert toxicity.score(empty, net).count() == 0 and toxicity.reject(empty, net).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    ones = spark.createDataFrame([(5, 1), (8, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.5 for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect())


def test_long_texts_count_to_the_end(spark):
    rows, labels = toxic_rows()
    net = toxicity.train(pa.array([t for _, t in rows]), np.array([y for _, y in labels], np.float32))
    clean = " ".join(["kolem lino tunda"] * 3000)
    got = [float(s) for s in np.concatenate(list(net.scores(pa.array([clean, clean + " grubby scoundrel vilest", None, ""]))))]
    assert got[0] < 0.3 <= got[1] and got[2] == got[3]


def plain_score(net, text):
    """One word, one window, one step at a time."""
    p, n = net.p, gru.STATE
    sig = lambda v: 1 / (1 + np.exp(-v))
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    best = -np.inf
    for a in range(0, max(1, len(found) - gru.WINDOW + gru.STRIDE), gru.STRIDE):
        inputs = []
        for w in found[a : a + gru.WINDOW]:
            raw = np.frombuffer(w, np.uint8)
            h = int(words(raw, np.array([0, len(raw)]))[0][0])
            grams = {k: gru.gram_hashes(raw, k).tolist() for k in range(2, 8)}
            inner = [p["G"][grams[k][i] % gru.GRAMS] for k in gru.INNER for i in range(len(w) - k + 1)]
            start = [p["G"][(grams[k][0] >> 32) % gru.GRAMS] for k in gru.START if len(w) >= k]
            spelt = (np.mean(inner, axis=0) if inner else 0) + (np.mean(start, axis=0) if start else np.zeros(gru.CHAR_DIM))
            inputs.append(np.concatenate([p["E"][1 + h % gru.WORDS], spelt]) @ p["W"] + p["b"])
        states = np.zeros((len(inputs), 2 * n))
        for side, u in enumerate((p["Uf"], p["Ub"])):
            h = np.zeros(n)
            for t in range(len(inputs)) if side == 0 else reversed(range(len(inputs))):
                g, hu = inputs[t][side * 3 * n : (side + 1) * 3 * n], h @ u
                z, r = sig(g[:n] + hu[:n]), sig(g[n : 2 * n] + hu[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + r * hu[2 * n :]) + z * h
                states[t, side * n : (side + 1) * n] = h
        if inputs:
            weight = np.exp(states @ p["a"][:, 0])
            logit = float((weight / weight.sum()) @ states @ p["o"][:, 0] + p["c"][0])
        else:
            logit = float(p["c"][0])
        best = max(best, logit)
    return float(sig(net.scale * best + net.shift))


def test_scores_equal_a_plain_loop(spark, docs):
    rows, labels = toxic_rows()
    net = toxicity.train(pa.array([t for _, t in rows]), np.array([y for _, y in labels], np.float32), turns=2)
    texts = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3000] + rows[:8]
    got = list(np.concatenate(list(net.scores(pa.array([t for _, t in texts], pa.string())))))
    assert got == pytest.approx([plain_score(net, t) for _, t in texts], abs=1e-4)


def test_toxicity_query_by_language(spark):
    """Held-out recall of the registered query by language, beside that of the counts the network starts from."""
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op5_toxicity"](spark, d)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").join(known.select("doc_id", "toxic"), "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and ((rows.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    held = rows[rows.held_out & rows.toxic.notna()]
    y, s = held.toxic.to_numpy(), held.score.to_numpy()
    assert toxicity.caught(s, y, 0.9) >= 0.93 and toxicity.caught(s, y, 0.99) >= 0.88
    assert (held[held.toxic == 0].predicted == 0).mean() >= 0.98
    recall = held[held.toxic == 1].groupby("lang").predicted.mean()
    assert (recall >= 0.7).all(), recall

    texts, labels = toxicity.labelled_sample(docs, known, ~queries.held_out(F.col("id")))
    sample = toxicity._Sample(texts)
    by_word = toxicity.word_evidence(sample, labels)[0]
    whole = docs.select("doc_id", "text").toPandas().set_index("doc_id").text[held.doc_id]
    other = toxicity._Sample(pa.array(whole.tolist(), pa.string()))
    counts = np.maximum.reduceat(np.maximum(0, by_word[other.rows])[other.kind], other.first[:-1])  # the strongest word of each text
    assert toxicity.caught(s, y, 0.99) > toxicity.caught(counts, y, 0.99)


def test_labelled_sample_awkward(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a a"), (4, "x " * 3000), (None, "n"), (5, "left out by the other side")]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(3, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(df, known, F.lit(True))
    assert texts.to_pylist() == [None, "", "a a", "x " * 3000] and y.tolist() == [1, 0, 1, 0]
    assert 0 < len(toxicity.labelled_sample(df, known, F.lit(True), most=2)[1]) <= 2


# ---------------------------------------------------------------- 6

def test_mix(spark, docs, empty):
    taken, table = mixing.mix(docs)
    rows, target = taken.collect(), {r.source: r for r in table.collect()}
    again = mixing.mix(docs.repartition(5))[0].collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.sources))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = {(r.doc_id, r.text) : len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert sorted(r.size for r in rows) == sorted(sizes[r.doc_id, r.text] for r in docs.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by[r.sources[0]] = by.get(r.sources[0], 0) + r.taken
    assert set(by) == set(target) == {"src0", "src1", "src2", None}
    for s, t in by.items():
        assert abs(t - target[s].target) <= 1
    assert sum(t.target for t in target.values()) == pytest.approx(sum(r.size for r in rows))
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed(empty).count() == 0
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns


def test_quotas():
    assert mixing.quotas({"a": 10, "b": 100}, {"a": 1, "b": 1}, 3) == {"a": 30.0, "b": 80.0}
    assert mixing.quotas({}, {}, 3) == {}
    assert mixing.quotas({"a": 0, "b": 5}, {"a": 1, "b": 2}, 3) == {"a": 0.0, "b": 5.0}


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, in_ array<string>")
    taken, table = mixing.mix(df, F.col("in_"), weights=lambda names: {"a": 3, "b": 1})
    assert taken.agg(F.sum("taken")).first()[0] == pytest.approx(900, abs=2)
    assert {r.source: r.source_size for r in table.collect()} == {"a": 600, "b": 600}
    flow = mixing.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [20, 15], 3)
    assert [sum(sent.get(j, 0) for sent in flow) for j in (0, 1)] == [20, 15]
    assert [sum(sent.values()) for sent in flow] in ([10, 20, 5], [10, 15, 10], [15, 15, 5], [10, 16, 9])


def repetition_cost(sent, size):
    return sum(max(0, min(sent, (k + 1) * size) - k * size) * k for k in range(3))


def plain_optimum(supply, member, quota, most):
    """(words, -cost) of the best way to fill quotas, by trying all, a pattern at a time."""
    from functools import cache

    @cache
    def best(i, room):
        if i == len(supply):
            return 0, 0
        ways = [()]
        for j in member[i]:
            ways = [(*w, x) for w in ways for x in range(min(room[j], most * supply[i] - sum(w)) + 1)]
        out = (-1, 0)
        for w in ways:
            left = list(room)
            for j, x in zip(member[i], w, strict=True):
                left[j] -= x
            words, cost = best(i + 1, tuple(left))
            out = max(out, (words + sum(w), cost - repetition_cost(sum(w), supply[i])))
        return out

    return best(0, tuple(quota))


def test_flow_is_the_plain_optimum():
    rng = random.Random(14)
    for _ in range(150):
        m, n = rng.randrange(1, 4), rng.randrange(1, 5)
        supply, quota = [rng.randrange(0, 4) for _ in range(n)], [rng.randrange(0, 7) for _ in range(m)]
        member = [sorted(rng.sample(range(m), rng.randrange(1, m + 1))) for _ in range(n)]
        flow = mixing.min_cost_flow(supply, member, quota, 3)
        assert all(set(sent) <= set(js) and min(sent.values(), default=0) >= 0 and sum(sent.values()) <= 3 * s for sent, js, s in zip(flow, member, supply, strict=True))
        assert all(sum(sent.get(j, 0) for sent in flow) <= q for j, q in enumerate(quota))
        got = sum(sum(sent.values()) for sent in flow), -sum(repetition_cost(sum(sent.values()), s) for sent, s in zip(flow, supply, strict=True))
        assert got == plain_optimum(supply, member, quota, 3)


def test_flow_with_many_patterns():
    rng = random.Random(15)
    n, m = 50_000, 60
    supply, member = [rng.randrange(1, 200) for _ in range(n)], [sorted(rng.sample(range(m), rng.randrange(1, 6))) for _ in range(n)]
    total = sum(supply)
    quota = [total * (1 + j % 3) // (2 * m) for j in range(m)]
    flow = mixing.min_cost_flow(supply, member, quota, 3)
    sent = [0] * m
    for f, s in zip(flow, supply, strict=True):
        assert sum(f.values()) <= 3 * s
        for j, x in f.items():
            sent[j] += x
    assert sent == quota
