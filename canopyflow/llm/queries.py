"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from canopyflow.llm import chunk_dedup, embedding_dedup, lexical, packing, phrases, quality, sequences, simhash, sp_backend, suffix_dedup, token_counts, topk, urlfilter
from canopyflow.llm.common import stored
from canopyflow.session import shared_dir

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), byte_bpe(), limit=512)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_url_filter", f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, split_part(split_part(rest, '#', 1), '?', 1) AS hp FROM u),
w AS (SELECT page_id, translate(split_part(hp, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(hp, length(split_part(hp, '/', 1)) + 1) AS path FROM v),
rules(rule, verdict) AS (VALUES {', '.join(map(str, RULES))}),
x AS (SELECT *, (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule FROM w)
SELECT page_id, host, path, rule, coalesce((SELECT r.verdict FROM rules r WHERE r.rule = x.rule), 'allow') AS verdict FROM x""")
def op2(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), [urlfilter.Rule(*r) for r in RULES])


@query("op3_arrow_sequences")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/canopyflow/sequences-{uuid.uuid4().hex}"
    sequences.write_sequences(docs, folder, byte_bpe(), end_id=0)
    read = sequences.read_documents(spark, folder, docs.schema["doc_id"].dataType)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3, seed=42)


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, space, threshold=0.7)


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    coded = sp_backend.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "rebuilt", "round_trip")


@query("op7_embedding_near_dedup")
def op7(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), limit=0.98)


@query("op8_suffix_array_dedup")
def op8(spark, sf_dir):
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_exact_top_k", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op9(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, query_step=50)


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    capacity = packing.Capacity(tokens=1024, documents=1024, attention=1024 * 1024)
    pieces = packing.cut(table(spark, sf_dir, "documents"), byte_bpe(), end_id=2, longest=capacity.longest)
    return packing.place(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), capacity)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_exact_dedup", f"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op13(spark, sf_dir):
    return chunk_dedup.exact_copies(table(spark, sf_dir, "documents"))


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@query("op12_ranked_search", f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // total AS m FROM size, corpus),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50""")
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query("op11_collocations", f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
  regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(2, 4) s(m), range(1, 4) t(i)
  WHERE m < words AND i + m - 1 <= words GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, 4) t(k) WHERE k < words) c
  JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y),
best AS (SELECT lang, phrase, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS b FROM cuts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score
  FROM kept JOIN n USING (lang))
SELECT * FROM r WHERE rank <= 2000""")
def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
