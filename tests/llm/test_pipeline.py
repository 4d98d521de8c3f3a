"""The pipeline, stage by stage, against plain versions of its decisions on the stage's own input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute_force import jaccard_truth
from tokenizers import Tokenizer

import corpus_pipeline
from quantaloom.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def blanked(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = kept["toxicity"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(whole, queries.toxicity_network(spark, whole, SF)).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < toxicity.THRESHOLD}

    before, after = kept["ngram_jaccard"]
    _, roots = jaccard_truth([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(roots.values()))

    before, after = kept["secret_scan"]
    text = {r.doc_id: r for r in after}
    assert all(text[r.doc_id].text == blanked(r.text) and text[r.doc_id].n_chars == (r.n_chars if blanked(r.text) == r.text else len(blanked(r.text))) for r in before)

    before, after = kept["mixing"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
    per = Counter()
    for r in before:
        per[r.source] += size[r.doc_id]
    target = mixing.quotas(dict(per), mixing.cycling_weights(list(per)), 3)
    taken, largest = Counter(), Counter()
    for r in after:
        taken[r.source] += size[r.doc_id]
    for r in before:
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in per)
    assert max(Counter(r.doc_id for r in after).values()) <= 3

    before, after = kept["bpe"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, hashlib.sha256(np.array(tok.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in before)
    assert Counter((r.doc_id, r.ids_sha256) for r in after) == want

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, after))


def test_stages_on_awkward_rows(spark, docs, empty):
    """Nulls, repeats, very long texts, clashing columns; and no rows at all."""
    now, none = docs, empty
    for name, stage in corpus_pipeline.STAGES:
        before = now.count()
        now, none = stage(spark, now, SF).cache(), stage(spark, none, SF)
        assert none.count() == 0
        if name == "bpe":
            assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and now.count() == before
        else:
            assert now.columns == docs.columns and none.columns == docs.columns and now.count() > 0


#: The columns that each query's contract begins with; op1, op2, op5 and op10 are run by tests of their own.
COLUMNS = {
    "op3_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op4_permutation_index": ["query_id", "rank", "vec_id", "score"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if not name.startswith("op4"):
        source = "embeddings" if name.startswith("op3") else "documents"
        assert found.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    else:
        ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
        assert found.count() == 20 * sum(i % 20 == 0 for i in ids)
    if name.startswith("op6"):
        rows = found.collect()
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        by = Counter()
        for r in rows:
            by[r.target, r.source_size] += r.taken  # sources of one weight share a target
        assert all(abs(t - n) <= 1 for (t, _), n in by.items())
