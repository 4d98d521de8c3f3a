"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, lexical, mixing, near_vectors, ngram_jaccard, packing, permutation_index, pii, secret_scan, toxicity, url_filter, whitening

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- 1 URL filters

#: The rules of the contract.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The rules of the registered SQL, which is kept as it was: it blocks net/de/, where the contract allows it (REPLY_r03.md, F2).
_SQL_RULES = tuple((h, p, "block" if (h, p) == ("net", "/de/") else a) for h, p, a in URL_RULES)

_OP1_SQL = """
WITH rules(rh, rp, action) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS rid, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT p.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
""".format(rules=", ".join(str(r) for r in _SQL_RULES))


@query("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


# ---------------------------------------------------------------- 2 chat formatting

PROBE = "</s>[INST] ok [/INST]"


def _guarded_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


_OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}', 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}', 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
  CAST(3 + sum(8 + length({_guarded_sql('role')}) + 8 + CASE WHEN role = 'user' THEN 15 ELSE 0 END + length({_guarded_sql('text')}) + 4) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op2_chat_format", _OP2_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.format_digests(rows.unionByName(probe))


# ---------------------------------------------------------------- 3 near vectors

@query("op3_near_vectors")
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 4 permutation index

@query("op4_permutation_index")
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(rows, rows.where("vec_id % 20 = 0"))


# ---------------------------------------------------------------- 5 toxicity

def held_out(id):
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def toxicity_network(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("id")))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_network(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 6 mixing

@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, sources = mixing.mix(table(spark, sf_dir, "documents"))
    rows = taken.withColumn("source_", F.col("sources")[0]).join(sources, F.col("source_").eqNullSafe(F.col("source")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


# ---------------------------------------------------------------- 7 secret scans

@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 8 BPE

def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), word_bpe_path())


# ---------------------------------------------------------------- 9 personal data

@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_digests(docs, pii.fit(docs))


# ---------------------------------------------------------------- 10 n-gram Jaccard join

@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 11 whitening

@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# ---------------------------------------------------------------- 12 ranked lexical search

_OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS ts FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n, sum(len(ts))::HUGEINT AS l FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, ts, 100 - 90 + (90 * len(ts)::HUGEINT * n) // l AS m FROM d, g WHERE len(ts) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(m)::BIGINT AS m, t, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(ts) AS t FROM m) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS t FROM benchmark WHERE text IS NOT NULL)),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
""".format(term=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@query("op12_ranked_search", _OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---------------------------------------------------------------- 13 packing

@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())
