"""Queries over the driver's tables, one or more per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.vectors import norm, normalized
from skein.operators import chunking, dead_letters, dedup, embed, ingest, ivf, limits, metrics, queue, validate, vector
from skein.operators.cache import EmbeddingCache
from skein.operators.workers import SharedQueue
from skein.plans.chunk_sql import chunks_sql
from skein.plans.standins import CHUNKS_SQL, DOC_STATUS, NOW, TASKS_SQL, line_chunks, requests, task_documents, tasks
from skein.schema import BackoffConfig, BreakerConfig, ChunkConfig, LimiterConfig
from skein.session import Scratch, new_root, removed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def now():
    return F.lit(NOW).cast("timestamp")


# DuckDB's regular expressions know no look-behind and no Unicode white space class.
STRIP_SQL = r"regexp_replace(regexp_replace({}, '^[\s\x{{85}}\x{{a0}}]+', ''), '[\s\x{{85}}\x{{a0}}]+$', '')"
UNPRINTABLE_SQL = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{ad}]"


def strip_sql(c: str) -> str:
    return STRIP_SQL.format(c)


CLEAN_SQL = f"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\n\\n+', chr(1), 'g'), chr(1)), lambda p: {strip_sql(f"regexp_replace(regexp_replace(p, '[ \\t]+', ' ', 'g'), '{UNPRINTABLE_SQL}', '', 'g')")}), lambda p: p <> ''), chr(10) || chr(10))"
TOKENS_SQL = "greatest(1, length({}) // 4)"
WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{85}\\x{a0}]+'), lambda w: w <> ''))"


# Vectors


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(greatest(0, least(1, s)), 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS s FROM embeddings, q)
WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return vector.top_k(vectors, first[0] if first else [], 10, 0.2, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS INT) AS rank
FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e, LATERAL (SELECT round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s)) WHERE rank <= 5""")
def vector_topk_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.top_k_batch(vectors, asked, 5, digits=9).withColumn("similarity", F.round("similarity", 6))


def _index(vectors: DataFrame) -> ivf.InvertedFile:
    return ivf.InvertedFile(vectors.sparkSession, new_root(vectors.sparkSession)).build(vectors.select("vec_id", "embedding"))


@query(ORACLES["vector_topk_batch"])
def ivf_topk_batch(spark, sf_dir):
    """The same nearest vectors from a stored index, which is built for the query and gone after it."""
    vectors = table(spark, sf_dir, "embeddings")
    index = _index(vectors)
    found = index.search_batch(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)
    index.drop()
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1)
SELECT vec_id, round(greatest(0, least(1, s)), 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS s FROM embeddings, q WHERE vec_id % 7 <> 2)
WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10""")
def ivf_changed(spark, sf_dir):
    """One search in an index that was built of some vectors, given the others, and lost some."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id = 1").select("embedding").first()
    index = _index(vectors.where("vec_id % 10 <> 3"))
    index.insert(vectors.where("vec_id % 10 = 3"))
    index.delete(vectors.where("vec_id % 7 = 2"))
    scratch = Scratch(spark)
    found = scratch.write(index.search(asked[0] if asked else [], 10, 0.1).select("vec_id", F.round("similarity", 6).alias("similarity")), "result")
    scratch.close(keep="result")
    index.drop()
    return found


ASKED = "what does the engine compute"
ASKED_VECTOR = embed.HashProvider().embed([ASKED], "m")[0]


@query(f"""SELECT vec_id, label, round(greatest(0, least(1, s)), 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({ASKED_VECTOR} AS DOUBLE[])) AS s FROM embeddings)
WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10""")
def text_search(spark, sf_dir):
    found = vector.search_text(table(spark, sf_dir, "embeddings"), ASKED, "m", embed.HashProvider(), 10, 0.1, "vec_id", keep=["label"])
    return found.withColumn("score", F.round("score", 6))


@query("SELECT count(vec_id) AS n FROM embeddings")
def vector_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("vec_id").alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def vector_by_chunk(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("vec_id", "label")


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
round(embedding[1]::DOUBLE * 3 / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 9), 6) AS first FROM embeddings""")
def vector_normalize(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(normalized(tripled)[0], 6).alias("first"))


@query("""SELECT vec_id, label + CASE WHEN vec_id % 10 = 0 THEN 100 ELSE 0 END AS label, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE vec_id % 7 <> 3""")
def vector_update_delete(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.create_map(F.lit("version"), F.lit("old")).alias("attributes"))
    changes = stored.where("vec_id % 10 = 0").select("vec_id", "embedding", F.create_map(F.lit("version"), F.lit("new")).alias("attributes"))
    kept = vector.deleted(vector.updated(stored, changes, "vec_id"), stored.where("vec_id % 7 = 3"), "vec_id")
    return kept.select("vec_id", (F.col("label") + F.when(F.element_at("attributes", "version") == "new", 100).otherwise(0)).alias("label"), F.element_at("attributes", "version").alias("version"))


# Embedding, cost and cache

MODEL = "CASE doc_id % 4 WHEN 0 THEN 'text-embedding-3-large' WHEN 1 THEN 'text-embedding-3-small' WHEN 2 THEN 'text-embedding-ada-002' ELSE 'other' END"
PRICE_SQL = f"CASE {MODEL} WHEN 'text-embedding-3-large' THEN 0.13 WHEN 'text-embedding-3-small' THEN 0.02 ELSE 0.10 END"
DIMENSION_SQL = f"CASE {MODEL} WHEN 'text-embedding-3-large' THEN 3072 ELSE 1536 END"
EXPIRES_SQL = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 10)"


def _requests(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text", F.expr(MODEL).alias("model"))


def _cache(spark, sf_dir) -> DataFrame:
    expires = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("doc_id") % 10).cast("int"))
    return _requests(spark, sf_dir).where("doc_id % 2 = 0").select(X.sha256(F.col("text")).alias("text_hash"), "model", F.array(F.lit(1.0)).alias("embedding"), expires.alias("expires_at"))


def _cache_now():
    return F.lit("2024-01-05").cast("timestamp")


@query(f"SELECT doc_id, CAST({TOKENS_SQL.format('text')} AS INT) AS tokens, {DIMENSION_SQL} AS dimension, round({TOKENS_SQL.format('text')} / 1e6 * {PRICE_SQL}, 9) AS cost FROM documents")
def embed_tokens_cost(spark, sf_dir):
    tokens = X.token_estimate(F.col("text"))
    return _requests(spark, sf_dir).select("doc_id", tokens.alias("tokens"), embed.dimension_of(F.col("model")).alias("dimension"), F.round(embed.cost(tokens, F.col("model")), 9).alias("cost"))


@query(f"SELECT count(*) AS embeddings, CAST(sum(t) AS BIGINT) AS tokens, round(sum(c), 8) AS cost, round(sum(c) / count(*), 6) AS mean_cost FROM (SELECT {TOKENS_SQL.format('text')} AS t, {TOKENS_SQL.format('text')} / 1e6 * {PRICE_SQL} AS c FROM documents)")
def embed_metrics(spark, sf_dir):
    tokens = X.token_estimate(F.col("text"))
    return embed.totals(_requests(spark, sf_dir).select(tokens.alias("tokens_used"), embed.cost(tokens, F.col("model")).alias("cost_usd")))


CACHE_SQL = f"""r AS (SELECT doc_id, sha256(text) AS h, {MODEL} AS model FROM documents),
live AS (SELECT DISTINCT sha256(text) AS h, {MODEL} AS model FROM documents WHERE doc_id % 2 = 0 AND {EXPIRES_SQL} > TIMESTAMP '2024-01-05 00:00:00')"""


@query(f"WITH {CACHE_SQL} SELECT doc_id, 'embedding:' || r.h AS cache_key, live.h IS NOT NULL AS hit FROM r LEFT JOIN live USING (h, model)")
def cache_split(spark, sf_dir):
    found = embed.looked_up(_requests(spark, sf_dir), _cache(spark, sf_dir), _cache_now())
    return found.select("doc_id", embed.cache_key(F.col("text")).alias("cache_key"), "hit")


@query(f"WITH {CACHE_SQL} SELECT count(live.h) AS hits, count(*) - count(live.h) AS misses, round(count(live.h) / count(*), 9) AS hit_rate FROM r LEFT JOIN live USING (h, model)")
def cache_stats(spark, sf_dir):
    found = embed.looked_up(_requests(spark, sf_dir), _cache(spark, sf_dir), _cache_now())
    return embed.cache_stats(found).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"""WITH {CACHE_SQL} SELECT doc_id, live.h IS NOT NULL AS hit, CAST(CASE WHEN live.h IS NOT NULL THEN 1 WHEN r.h IS NOT NULL THEN 64 END AS INT) AS dimension,
CASE WHEN r.h IS NOT NULL THEN CAST(1 AS DOUBLE) END AS norm FROM r LEFT JOIN live USING (h, model)""")
def embed_documents(spark, sf_dir):
    """Requests with their vectors from the cache or the provider. What a provider gives is no SQL: tests compare the vectors
    with direct calls, SQL their sizes and lengths."""
    filled, _ = embed.cached_embed(_requests(spark, sf_dir), _cache(spark, sf_dir), _cache_now(), embed.HashProvider)
    return filled.select("doc_id", "hit", F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 6).alias("norm"))


#: Entries of even documents in the base; those of every fifth put in later, with other times; those of every seventh taken out.
LATER_SQL = "TIMESTAMP '2024-01-04 00:00:00' + INTERVAL 1 DAY * (doc_id % 3)"


@query(f"""WITH k AS (SELECT doc_id, sha256(text) AS h, {MODEL} AS model FROM documents),
base AS (SELECT h, model, max({EXPIRES_SQL}) AS e FROM k WHERE doc_id % 2 = 0 AND h IS NOT NULL GROUP BY ALL), later AS (SELECT h, model, max({LATER_SQL}) AS e FROM k WHERE doc_id % 5 = 0 AND h IS NOT NULL GROUP BY ALL),
gone AS (SELECT DISTINCT h, model FROM k WHERE doc_id % 7 = 0), live AS (SELECT h, model FROM base FULL JOIN later USING (h, model) ANTI JOIN gone USING (h, model) WHERE coalesce(later.e, base.e) > TIMESTAMP '2024-01-05 00:00:00')
SELECT doc_id, live.h IS NOT NULL AS hit FROM k LEFT JOIN live USING (h, model)""")
def cache_changed(spark, sf_dir):
    """A cache that was filled, added to and evicted from, each time by a delta; then all documents are looked up."""
    cache = EmbeddingCache(spark, new_root(spark), 16)
    asked = _requests(spark, sf_dir)
    entries = asked.where("text IS NOT NULL").select("doc_id", X.sha256(F.col("text")).alias("text_hash"), "model", F.array(F.lit(1.0)).alias("embedding"))
    base = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("doc_id") % 10).cast("int"))
    later = F.lit("2024-01-04").cast("timestamp") + F.make_dt_interval(days=(F.col("doc_id") % 3).cast("int"))
    cache.put(entries.where("doc_id % 2 = 0").withColumn("expires_at", base))
    cache.put(entries.where("doc_id % 5 = 0").withColumn("expires_at", later))
    cache.evict(entries.where("doc_id % 7 = 0").select("text_hash", "model").distinct())
    scratch = Scratch(spark)
    found = scratch.write(cache.looked_up(asked, _cache_now()).select("doc_id", "hit"), "result")
    scratch.close(keep="result")
    removed(spark, cache.ledger.root)
    return found


# Ingestion


@query("SELECT doc_id, sha256(coalesce(nullif(text, ''), source)) AS content_hash FROM documents")
def doc_content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ingest.content_hash(F.col("text"), F.col("source")).alias("content_hash"))


KIND = "CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' ELSE 'url' END"


@query(f"SELECT doc_id AS document_id, CASE WHEN {KIND} = 'pdf' THEN 'parse_pdf' ELSE 'chunk_document' END AS task_type, 'pending' AS status, CAST(doc_id % 10 AS INT) AS priority, 0 AS attempt_count FROM documents")
def ingest_accept(spark, sf_dir):
    asked = docs(spark, sf_dir).selectExpr("doc_id AS id", "source AS source_uri", "text AS content", f"{KIND} AS document_type", "CAST(doc_id % 10 AS INT) AS priority")
    return ingest.accept(asked)[1].drop("attributes")


@query(f"""SELECT doc_id AS document_id, source AS source_uri, {KIND} AS document_type, sha256(text) AS content_hash FROM documents""")
def ingest_attributes(spark, sf_dir):
    asked = docs(spark, sf_dir).selectExpr("doc_id AS id", "source AS source_uri", "text AS content", f"{KIND} AS document_type", "0 AS priority")
    a = F.col("attributes")
    return ingest.accept(asked)[1].select("document_id", a["source_uri"].alias("source_uri"), a["document_type"].alias("document_type"), X.sha256(F.try_element_at(a, F.lit("content"))).alias("content_hash"))


def _turns(spark, sf_dir) -> DataFrame:
    """Turns as the chunks of their conversation."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), X.token_estimate(F.col("text")).alias("tokens"), F.lit("").alias("context"), X.sha256(F.col("text")).alias("content_hash"))


def _turn_documents(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("chunking").alias("status"))


TURN_ID_SQL = "sha256(conv_id || '/' || turn)"


@query(f"SELECT {TURN_ID_SQL} AS id, conv_id AS document_id, turn AS chunk_index, sha256(text) AS content_hash, 'pending' AS status, CAST({TOKENS_SQL.format('text')} AS INT) AS tokens, CAST(length(text) AS INT) AS end_char FROM conversations")
def chunk_insert(spark, sf_dir):
    rows, _, _ = ingest.chunks_accepted(_turn_documents(spark, sf_dir), _turns(spark, sf_dir), now())
    return rows.select("id", "document_id", "chunk_index", "content_hash", "status", "tokens", F.col("attributes.end_char").alias("end_char"))


@query(f"SELECT conv_id AS document_id, 'embed_chunk' AS task_type, 'pending' AS status, 0 AS priority, {TURN_ID_SQL} AS chunk_id FROM conversations")
def chunk_enqueue(spark, sf_dir):
    _, made, _ = ingest.chunks_accepted(_turn_documents(spark, sf_dir), _turns(spark, sf_dir), now())
    return made.select("document_id", "task_type", "status", "priority", F.col("attributes")["chunk_id"].alias("chunk_id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT conv_id FROM conversations) THEN 'embedding' ELSE 'chunking' END AS status FROM documents")
def chunk_document_status(spark, sf_dir):
    return ingest.chunks_accepted(_turn_documents(spark, sf_dir), _turns(spark, sf_dir), now())[2].select("id", "status")


@query("""SELECT source, content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, source, sha256(coalesce(nullif(text, ''), source)) AS content_hash FROM documents) GROUP BY ALL""")
def doc_dedup_first(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", "source", ingest.content_hash(F.col("text"), F.col("source")).alias("content_hash"))
    return ingest.first_of_key(keyed, ["source", "content_hash"], ["doc_id"])


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN (doc_id % 13) - 1 < 0 OR (doc_id % 13) - 1 > 10 THEN 'priority_range' END,
CASE WHEN {KIND} = 'text' AND {strip_sql('text')} = '' THEN 'text_without_content' END, CASE WHEN {KIND} = 'url' AND doc_id % 2 = 0 THEN 'url_scheme' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents""")
def ingest_validate(spark, sf_dir):
    uri = F.concat(F.when(F.col("doc_id") % 2 == 0, "ftp://").otherwise("https://"), F.col("source"))
    found = ingest.problems(uri, F.col("text"), F.col("doc_id") % 13 - 1, F.expr(KIND))
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("problems"))


@query(f"""SELECT conv_id AS doc, count(*) AS pages, sha256(coalesce(string_agg(CASE WHEN {strip_sql('t')} <> '' THEN t END, chr(10) || chr(10) ORDER BY turn), '')) AS text_hash FROM
(SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' WHEN {strip_sql('text')} = '' THEN '[Image-only page ' || (turn + 1) || ']' ELSE text END AS t FROM conversations) GROUP BY conv_id""")
def page_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_num"), "text", (F.col("turn") % 5 != 4).alias("success"))
    joined = ingest.joined_pages(ingest.page_texts(turns))
    return joined.select("doc", "pages", X.sha256(F.col("text")).alias("text_hash"))


@query("SELECT doc_id, lang AS lang, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS source FROM documents")
def attributes_merge(spark, sf_dir):
    left = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    right = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    both = ingest.merged_attributes(left, right)
    return docs(spark, sf_dir).select("doc_id", both["lang"].alias("lang"), both["source"].alias("source"))


# Text and chunks


@query(f"SELECT doc_id, length(c) AS n_clean, sha256(c) AS clean_hash FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)")
def doc_clean_text(spark, sf_dir):
    c = X.clean(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("n_clean"), X.sha256(F.col("c")).alias("clean_hash"))


@query(f"SELECT doc_id, CAST({TOKENS_SQL.format('text')} AS INT) AS tokens FROM documents")
def doc_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


CHUNKS_OF_DOCUMENTS_SQL = chunks_sql(CLEAN_SQL, strip_sql, TOKENS_SQL)


@query(CHUNKS_OF_DOCUMENTS_SQL)
def chunk_documents(spark, sf_dir):
    """Every chunk of every document."""
    return chunking.chunk(docs(spark, sf_dir))


SENTENCES_SQL = rf"list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '')"
PACKS_SQL = f"""CASE WHEN c = '' THEN [] WHEN length(c) <= 1024 THEN [c] ELSE list_reduce(list_transform({SENTENCES_SQL}, lambda s: [s]),
lambda acc, s: CASE WHEN length(acc[-1]) + 1 + length(s[1]) <= 1024 THEN list_concat(acc[:-2], [acc[-1] || ' ' || s[1]]) ELSE list_concat(acc, s) END) END"""


@query(f"""SELECT doc_id, CAST(i - 1 AS INT) AS pack_index, length(p) AS n_chars, sha256(p) AS pack_hash FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
FROM (SELECT doc_id, {PACKS_SQL} AS ps FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)))""")
def chunk_sentence_pack(spark, sf_dir):
    # The cleaned text has many uses, so Catalyst leaves it in a projection of its own.
    cleaned = docs(spark, sf_dir).select("doc_id", X.clean(F.col("text")).alias("c"))
    packed = cleaned.select("doc_id", chunking.sentence_packs(F.col("c"), 1024).alias("packs"))
    return packed.select("doc_id", F.posexplode_outer("packs").alias("pack_index", "p")).where(F.col("p").isNotNull()).select("doc_id", "pack_index", F.length("p").cast("long").alias("n_chars"), X.sha256(F.col("p")).alias("pack_hash"))


@query(f"""SELECT doc_id, 0 AS chunk_index, sha256(c) AS content_hash, CAST(length(c) AS INT) AS end_char, CAST({TOKENS_SQL.format('c')} AS INT) AS tokens, '' AS context
FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents) WHERE length(c) BETWEEN 50 AND 1024""")
def chunk_single(spark, sf_dir):
    """Documents that fit into one chunk are that chunk: all are chunked, and those are compared."""
    fitting = docs(spark, sf_dir).where(F.length(X.clean(F.col("text"))).between(50, 1024)).select("doc_id")
    return chunking.chunk(docs(spark, sf_dir)).join(fitting, "doc_id", "left_semi").select("doc_id", "chunk_index", "content_hash", "end_char", "tokens", "context")


@query(f"SELECT doc_id, doc_id AS page_num, chunk_index, length(content) AS n_chars, right(content, 100) AS ending FROM ({CHUNKS_OF_DOCUMENTS_SQL})")
def chunk_pages(spark, sf_dir):
    """Texts as pages under their number."""
    chunks = chunking.chunk(docs(spark, sf_dir), with_page=True)
    return chunks.select("doc_id", "page_num", "chunk_index", F.length("content").cast("long").alias("n_chars"), F.right("content", F.lit(100)).alias("ending"))


@query("""SELECT conv_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_index, sha256(concat_ws(' ', '...' || right(lag(text) OVER w, 100), left(lead(text) OVER w, 100) || '...')) AS context_hash
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""")
def chunk_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("chunks"))
    rows = turns.select("conv_id", F.posexplode(chunking.with_context(F.col("chunks"))).alias("chunk_index", "c"))
    return rows.select("conv_id", "chunk_index", X.sha256(F.col("c.context")).alias("context_hash"))


@query(f"SELECT doc_id, CASE WHEN {strip_sql('text')} = '' THEN 'blank' ELSE 'no_chunks' END AS reason FROM (SELECT doc_id, text, {CLEAN_SQL} AS c FROM documents) WHERE length(c) < 50")
def chunk_rejected(spark, sf_dir):
    return chunking.without_chunks(docs(spark, sf_dir))


# Validation and duplicates

VALID_SQL = f"""v AS (SELECT doc_id, t, {TOKENS_SQL.format('t')} AS tokens, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}} .,!?;:\\n\\t-]', '', 'g')) / length(t) AS ratio FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents))"""
TRUNCATED_SQL = """(t <> '' AND NOT list_contains(['.','!','?',':','…','"',')',']','}','—'], right(t, 1)))"""


@query(f"""WITH {VALID_SQL} SELECT doc_id, is_valid, issues, CAST(tokens AS INT) AS token_count FROM (SELECT doc_id, tokens, issues = '' AS is_valid, issues FROM (SELECT doc_id, tokens, array_to_string(list_filter([CASE WHEN tokens < 10 THEN 'too_few_tokens' END,
CASE WHEN tokens > 2048 THEN 'too_many_tokens' END, CASE WHEN length(t) < 50 THEN 'too_few_chars' END, CASE WHEN length(t) > 8192 THEN 'too_many_chars' END, CASE WHEN coalesce(ratio < 0.5, true) THEN 'low_content_quality' END,
CASE WHEN {TRUNCATED_SQL} THEN 'truncated_content' END], lambda x: x IS NOT NULL), ',') AS issues FROM v))""")
def validate_issues(spark, sf_dir):
    return validate.validated(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "is_valid", F.array_join("issues", ",").alias("issues"), "token_count")


@query(f"""WITH {VALID_SQL} SELECT doc_id, round(greatest(0, least(1, CASE WHEN tokens < 20 THEN tokens / 20 WHEN tokens > 1024 THEN 1024 / tokens ELSE 1.0 END * CASE WHEN ratio < 0.7 THEN ratio / 0.7 ELSE 1.0 END
* CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 1.0 END)), 6) AS quality_score FROM v""")
def validate_quality(spark, sf_dir):
    scored = validate.validated(docs(spark, sf_dir).select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("dup")), duplicate_col="dup")
    return scored.select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query(f"""WITH {VALID_SQL}, o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
SELECT place AS "index", sha256(text) AS text_hash FROM o JOIN v USING (doc_id) WHERE tokens BETWEEN 10 AND 2048 AND length(t) BETWEEN 50 AND 8192 AND ratio >= 0.5 AND NOT {TRUNCATED_SQL}""")
def validate_filter(spark, sf_dir):
    checked = validate.validated(docs(spark, sf_dir).select("doc_id", "text"))
    return validate.valid_only(checked, "doc_id").select("index", X.sha256(F.col("text")).alias("text_hash"))


REASONS_SQL = """list_filter([CASE WHEN tokens < 10 THEN 'Token count ' || tokens || ' < minimum 10' END, CASE WHEN tokens > 2048 THEN 'Token count ' || tokens || ' > maximum 2048' END,
CASE WHEN length(t) < 50 THEN 'Character count ' || length(t) || ' < minimum 50' END, CASE WHEN length(t) > 8192 THEN 'Character count ' || length(t) || ' > maximum 8192' END,
CASE WHEN coalesce(ratio < 0.5, true) THEN 'Low ratio of meaningful content' END, CASE WHEN """ + TRUNCATED_SQL + """ THEN 'Content appears truncated' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {VALID_SQL} SELECT doc_id, array_to_string({REASONS_SQL}, ';') AS reasons FROM v")
def validate_reasons(spark, sf_dir):
    return validate.validated(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"SELECT doc_id, {TRUNCATED_SQL} AS truncated FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents)")
def truncated_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", validate.truncated(X.strip(F.col("text"))).alias("truncated"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_of, min(doc_id) OVER (PARTITION BY k) < doc_id AS is_duplicate FROM (SELECT doc_id, sha256(lower({strip_sql('text')})) AS k FROM documents)")
def exact_dup(spark, sf_dir):
    return dedup.exact_duplicates(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "first_of", "is_duplicate")


NEAR_SQL = f"""s AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word FROM s),
p AS (SELECT a.doc_id AS later, b.doc_id AS earlier, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.doc_id > b.doc_id AND least(a.n, b.n) > 0.9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id)"""


@query(f"WITH {NEAR_SQL} SELECT later, earlier, round(shared / (na + nb - shared), 6) AS similarity FROM p WHERE shared / (na + nb - shared) > 0.9")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "0.9").withColumn("similarity", F.round("similarity", 6))


LEADERS_SQL = f"""WITH {NEAR_SQL.replace('0.9 *', '0.95 *')}, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower({strip_sql('text')}))) AS f FROM documents),
e AS (SELECT later, earlier FROM p WHERE shared / (na + nb - shared) > 0.95 UNION SELECT doc_id, f FROM k WHERE f < doc_id),
x AS (SELECT doc_id, list_prepend(doc_id, list_filter(list(earlier), lambda n: n IS NOT NULL)) AS row_ FROM documents LEFT JOIN e ON later = doc_id GROUP BY doc_id),
kept AS (SELECT list_reduce(list(row_ ORDER BY doc_id), lambda acc, row_: CASE WHEN list_has_any(acc, row_[2:]) THEN acc ELSE list_append(acc, row_[1]) END, CAST([] AS BIGINT[])) AS ids FROM x)
SELECT doc_id, NOT list_contains(ids, doc_id) AS is_duplicate FROM documents, kept"""


@query(LEADERS_SQL)
def leader_dedup(spark, sf_dir):
    """Which documents an earlier kept one makes duplicates: a sequential rule."""
    return dedup.leaders(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "is_duplicate")


@query(LEADERS_SQL)
def leader_dedup_seen(spark, sf_dir):
    """The same decisions in two calls: the second knows what the first one kept. Texts are split into words once for both."""
    every = dedup.word_sets(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    middle = every.agg(F.expr("(min(doc_id) + max(doc_id)) div 2")).first()[0]
    first, second = every.where(F.col("doc_id") <= middle), every.where(F.col("doc_id") > middle)
    found = dedup.leaders(first, "doc_id", text_col=None)
    kept = found.where(~F.col("is_duplicate")).drop("is_duplicate")
    return found.unionByName(dedup.leaders(second, "doc_id", text_col=None, seen=kept)).select("doc_id", "is_duplicate")


# Queue

OPEN_SQL = "status IN ('pending', 'retrying') AND attempt_count < max_attempts"


@query(f"WITH {TASKS_SQL} SELECT id, priority FROM tasks WHERE {OPEN_SQL} ORDER BY priority DESC, created_at, id LIMIT 100")
def task_dequeue(spark, sf_dir):
    return queue.next_tasks(tasks(spark, sf_dir), 100).select("id", "priority")


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN r <= 4 THEN 'pdf' WHEN r <= 12 THEN 'embed' ELSE 'chunk' END AS worker_id FROM (SELECT id, row_number() OVER (ORDER BY priority DESC, created_at, id) AS r FROM tasks WHERE {OPEN_SQL}) WHERE r <= 14")
def task_claim_multi(spark, sf_dir):
    return queue.dealt(tasks(spark, sf_dir), [("pdf", 4), ("embed", 8), ("chunk", 2)])


@query(f"""WITH {TASKS_SQL}, c AS (SELECT id FROM tasks WHERE {OPEN_SQL} AND task_type IN ('parse_pdf', 'embed_chunk') ORDER BY priority DESC, created_at, id LIMIT 50)
SELECT t.id, CASE WHEN c.id IS NULL THEN status ELSE 'processing' END AS status, attempt_count + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS attempt_count FROM tasks t LEFT JOIN c USING (id)""")
def task_claimed(spark, sf_dir):
    state = tasks(spark, sf_dir)
    chosen = queue.next_tasks(state, 50, ("parse_pdf", "embed_chunk"))
    return queue.claimed(state, chosen, F.lit("w1"), now()).select("id", "status", "attempt_count")


@query(f"""WITH {TASKS_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN CASE WHEN attempt_count < max_attempts THEN 'retrying' ELSE 'failed' END ELSE status END AS status, CASE WHEN id % 7 = 0 THEN 'boom' END AS error_message FROM tasks""")
def task_mark_failed(spark, sf_dir):
    state = tasks(spark, sf_dir)
    return queue.failed(state, state.where("id % 7 = 0").select("id", F.lit("boom").alias("error")), now()).select("id", "status", "error_message")


@query(f"""WITH {TASKS_SQL}, f AS (SELECT DISTINCT document_id FROM tasks WHERE id % 7 = 0 AND attempt_count >= max_attempts)
SELECT c_custkey AS id, CASE WHEN f.document_id IS NULL THEN {DOC_STATUS} ELSE 'failed' END AS status FROM customer LEFT JOIN f ON c_custkey = f.document_id""")
def task_failed_documents(spark, sf_dir):
    state = tasks(spark, sf_dir)
    errors = state.where("id % 7 = 0").select("id", F.lit("boom").alias("error"))
    return queue.failed_documents(task_documents(spark, sf_dir), state, errors).select("id", "status")


@query(f"""WITH {TASKS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'ok' END AS result FROM tasks""")
def task_mark_done(spark, sf_dir):
    state = tasks(spark, sf_dir)
    done = state.where("id % 3 = 0").select("id", F.create_map(F.lit("result"), F.lit("ok")).alias("attributes"))
    return queue.finished(state, done, now()).select("id", "status", F.try_element_at("attributes", F.lit("result")).alias("result"))


@query(f"""WITH {TASKS_SQL} SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 6 = 1 THEN 'failed' WHEN id % 6 = 0 THEN 'done' ELSE status END AS status FROM tasks) GROUP BY 1""")
def task_batch_marks(spark, sf_dir):
    state = tasks(spark, sf_dir)
    after = queue.marked(state, state.where("id % 6 = 0"), "done", now())
    return queue.marked(after, state.where("id % 6 = 1"), "failed", now(), "stopped").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND THEN 'pending' ELSE status END AS status FROM tasks")
def task_reset_stuck(spark, sf_dir):
    return queue.unstuck(tasks(spark, sf_dir), now()).select("id", "status")


@query(f"""WITH {TASKS_SQL}, b AS (SELECT 'task' AS kind, status FROM tasks UNION ALL SELECT 'document', {DOC_STATUS} FROM customer)
SELECT kind, status, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT kind, 'total', count(*) FROM b GROUP BY kind""")
def task_queue_status(spark, sf_dir):
    return queue.counts(tasks(spark, sf_dir), task_documents(spark, sf_dir))


@query(f"""WITH {TASKS_SQL} SELECT id, CASE WHEN document_id = 7 THEN 'pending' ELSE status END AS status, attempt_count, flagged AND document_id <> 7 AS flagged FROM tasks""")
def task_retry_document(spark, sf_dir):
    after = queue.retried(tasks(spark, sf_dir), F.lit(7), now())
    return after.select("id", "status", "attempt_count", F.map_contains_key("attributes", "dlq").alias("flagged"))


@query(f"WITH {TASKS_SQL} SELECT id, status = 'failed' AND attempt_count < max_attempts AS is_retryable, status = 'pending' AND attempt_count < max_attempts AS can_be_claimed FROM tasks")
def task_predicates(spark, sf_dir):
    c = [F.col(x) for x in ("status", "attempt_count", "max_attempts")]
    return tasks(spark, sf_dir).select("id", queue.retryable(*c).alias("is_retryable"), queue.fresh(*c).alias("can_be_claimed"))


@query(f"WITH {TASKS_SQL} SELECT task_type, count_if(id % 3 = 0) AS completed, count_if(id % 3 <> 0 AND attempt_count < 3) AS retried, count_if(id % 3 <> 0 AND attempt_count >= 3) AS failed FROM tasks GROUP BY 1")
def task_outcomes(spark, sf_dir):
    return queue.outcomes(tasks(spark, sf_dir).withColumn("succeeded", F.col("id") % 3 == 0))


@query(f"""WITH {TASKS_SQL} SELECT id, CASE WHEN task_type = 'parse_pdf' THEN CASE WHEN id % 8 = 0 THEN 'bad file' END WHEN task_type = 'embed_chunk' THEN NULL ELSE 'No handler for ' || task_type END AS error FROM tasks""")
def task_dispatch(spark, sf_dir):
    handlers = {
        "parse_pdf": lambda t: t.select("id", F.when(F.col("id") % 8 == 0, "bad file").alias("error")),
        "embed_chunk": lambda t: t.select("id", F.lit(None).cast("string").alias("error")),
    }
    return queue.dispatched(tasks(spark, sf_dir), handlers)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def doc_list_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return queue.listed(rows, 20, 40, "P").select("id")


@query(f"""WITH {CHUNKS_SQL} SELECT o_orderkey AS id, count(document_id) AS chunk_count, count_if(coalesce(embedded, false)) AS embedding_count,
round(CASE WHEN count(document_id) = 0 THEN 0.0 ELSE count_if(coalesce(embedded, false)) / count(document_id) * 100 END, 6) AS progress FROM orders LEFT JOIN chunks ON o_orderkey = document_id GROUP BY 1""")
def doc_progress(spark, sf_dir):
    chunks, embeddings = line_chunks(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return queue.progress(orders, chunks, embeddings).withColumn("progress", F.round("progress", 6))


@query(f"WITH {CHUNKS_SQL} SELECT document_id, CASE WHEN bool_and(status = 'done') THEN 'done' ELSE 'embedding' END AS status FROM chunks GROUP BY 1")
def doc_completion(spark, sf_dir):
    return queue.completion(line_chunks(spark, sf_dir)[0])


@query(f"""WITH {CACHE_SQL}, h AS (SELECT round(count(live.h) / count(*), 9) AS hit_rate FROM r LEFT JOIN live USING (h, model)),
d AS (SELECT count(*) AS embeddings, CAST(sum(t) AS BIGINT) AS tokens, round(sum(c), 8) AS cost, round(sum(c) / count(*), 6) AS mean_cost FROM (SELECT {TOKENS_SQL.format('text')} AS t, {TOKENS_SQL.format('text')} / 1e6 * {PRICE_SQL} AS c FROM documents))
SELECT *, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS cached, (SELECT count(*) FROM embeddings) AS stored FROM d, h""")
def engine_stats(spark, sf_dir):
    tokens = X.token_estimate(F.col("text"))
    made = embed.totals(_requests(spark, sf_dir).select(tokens.alias("tokens_used"), embed.cost(tokens, F.col("model")).alias("cost_usd")))
    looked = embed.cache_stats(embed.looked_up(_requests(spark, sf_dir), _cache(spark, sf_dir), _cache_now())).select(F.round("hit_rate", 9).alias("hit_rate"))
    cached = _cache(spark, sf_dir).agg(F.count("*").alias("cached"))
    stored = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("stored"))
    # Each side is one row.
    return made.join(F.broadcast(looked)).join(F.broadcast(cached)).join(F.broadcast(stored))


@query(f"""WITH {TASKS_SQL} SELECT document_id, count(*) AS n, count_if(status = 'pending') AS pending FROM (SELECT document_id, status FROM tasks UNION ALL SELECT c_custkey, 'pending' FROM customer) GROUP BY 1""")
def task_enqueue(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10**9).alias("id"), F.col("c_custkey").alias("document_id"), F.lit("chunk_document").alias("task_type"))
    after = queue.enqueued(tasks(spark, sf_dir), new, now())
    return after.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))


@query(f"WITH {TASKS_SQL} SELECT id, status FROM tasks WHERE document_id = 7 AND status IN ('failed', 'pending') UNION ALL SELECT id, status FROM tasks WHERE id = 1")
def task_lookup(spark, sf_dir):
    state = tasks(spark, sf_dir)
    own = queue.tasks_of(state, F.lit(7), "failed").unionByName(queue.tasks_of(state, F.lit(7), "pending"))
    return own.unionByName(queue.task(state, F.lit(1))).select("id", "status")


@query(f"""WITH {CHUNKS_SQL} SELECT o_orderkey AS id, o_orderstatus AS status, count(document_id) AS chunk_count, count_if(coalesce(embedded, false)) AS embedding_count FROM orders LEFT JOIN chunks ON o_orderkey = document_id WHERE o_orderkey = 1 GROUP BY ALL""")
def doc_status(spark, sf_dir):
    chunks, embeddings = line_chunks(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return queue.document_status(orders, chunks, embeddings, F.lit(1)).select("id", "status", "chunk_count", "embedding_count")


@query(f"""WITH {TASKS_SQL}, w AS (SELECT 'w' || id % 3 AS worker_id, status FROM tasks) SELECT worker_id, CAST(room AS INT) AS room, count_if(status = 'processing') AS assigned, count_if(status = 'done') AS completed, count_if(status = 'failed') AS failed,
greatest(room - count_if(status = 'processing'), 0) AS free FROM (VALUES ('w0', 4), ('w1', 100000), ('w2', 2)) p(worker_id, room) JOIN w USING (worker_id) GROUP BY worker_id, room""")
def task_coordinator(spark, sf_dir):
    held = tasks(spark, sf_dir).withColumn("worker_id", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")))
    return queue.coordinator(held, [("w0", 4), ("w1", 100_000), ("w2", 2)])


# Dead letters

DUE_SQL = "status = 'failed' AND attempt_count >= 3 AND NOT flagged"


@query(f"WITH {TASKS_SQL} SELECT id AS task_id, document_id, task_type, attempt_count FROM tasks WHERE {DUE_SQL}")
def dlq_scan(spark, sf_dir):
    return dead_letters.moved(tasks(spark, sf_dir), now())[1].select("task_id", "document_id", "task_type", "attempt_count")


@query(f"WITH {TASKS_SQL} SELECT id, strftime(updated_at, '%Y-%m-%d') AS updated FROM tasks WHERE status = 'failed' AND (flagged OR attempt_count >= 3)")
def dlq_list(spark, sf_dir):
    after, _ = dead_letters.moved(tasks(spark, sf_dir), now())
    return dead_letters.listed(after).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"WITH {TASKS_SQL} SELECT count_if(status = 'failed') AS failed, count_if(status = 'failed' AND flagged) AS flagged FROM tasks")
def dlq_counts(spark, sf_dir):
    return dead_letters.counts(tasks(spark, sf_dir))


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN status = 'failed' AND flagged THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND flagged THEN 0 ELSE attempt_count END AS attempt_count FROM tasks")
def dlq_replay(spark, sf_dir):
    return dead_letters.replayed_all(tasks(spark, sf_dir), now()).select("id", "status", "attempt_count")


@query(f"""WITH {TASKS_SQL}, n AS (SELECT CAST(id AS VARCHAR) AS item, CAST(NULL AS BIGINT) AS n FROM tasks WHERE status = 'failed' AND flagged ORDER BY updated_at DESC, id LIMIT 10)
SELECT status AS item, count(*) AS n FROM tasks GROUP BY 1 UNION ALL SELECT * FROM n""")
def error_report(spark, sf_dir):
    by, newest = dead_letters.report(tasks(spark, sf_dir))
    return by.select(F.col("status").alias("item"), "n").unionByName(newest.select(F.col("id").cast("string").alias("item"), F.lit(None).cast("long").alias("n")))


CLAIMS_SQL = f"""{TASKS_SQL}, open AS (SELECT * FROM tasks WHERE status IN ('pending', 'retrying') AND attempt_count < max_attempts),
a AS (SELECT *, 'a' AS worker FROM open ORDER BY priority DESC, created_at, id LIMIT 30), b AS (SELECT *, 'b' AS worker FROM open WHERE task_type = 'embed_chunk' AND id NOT IN (SELECT id FROM a) ORDER BY priority DESC, created_at, id LIMIT 30),
held AS (SELECT *, attempt_count + 1 AS tries, id % 3 = 0 AS bad FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""


@query(f"""WITH {CLAIMS_SQL} SELECT 'task' AS kind, id, worker, CASE WHEN NOT bad THEN 'processing' WHEN tries < max_attempts THEN 'retrying' ELSE 'failed' END AS status FROM held
UNION ALL SELECT DISTINCT 'document', document_id, NULL, 'failed' FROM held JOIN customer ON c_custkey = document_id WHERE bad AND tries >= max_attempts""")
def queue_claims(spark, sf_dir):
    """Two workers claim tasks of one queue; some fail, and their documents with them."""
    state, documents = tasks(spark, sf_dir), task_documents(spark, sf_dir)
    kinds = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for df in (state, documents)]
    q = SharedQueue(spark, new_root(spark), *kinds)
    q.put(state, documents)
    q.claim("a", 30, now())
    q.claim("b", 30, now(), ("embed_chunk",))
    q.fail(q.tasks().where("worker_id IS NOT NULL AND id % 3 = 0").select("id", F.lit("boom").alias("error")), now())
    held = q.tasks().where("worker_id IS NOT NULL").select(F.lit("task").alias("kind"), "id", F.col("worker_id").alias("worker"), "status")
    out = q.documents().where("error_message = 'boom'").select(F.lit("document").alias("kind"), "id", F.lit(None).cast("string").alias("worker"), "status")
    scratch = Scratch(spark)
    found = scratch.write(held.unionByName(out), "result")
    scratch.close(keep="result")
    removed(spark, q.ledger.root)
    return found


@query(f"WITH {TASKS_SQL} SELECT id, attempt_count + 1 AS attempt_count, attempt_count + 1 >= max_attempts AS to_dlq FROM tasks WHERE id % 9 = 0")
def error_handled(spark, sf_dir):
    state = tasks(spark, sf_dir)
    errors = state.where("id % 9 = 0").select("id", F.lit("ValueError").alias("type"), F.lit("boom").alias("message"))
    return dead_letters.after_error(state, errors, now()).select("id", "attempt_count", "to_dlq")


# Limits


def _up(column: str, digits: int, nudge: float = 1e-7):
    """Rounded so that a value halfway goes up, in Spark's whole units as in SQL's doubles."""
    return F.round(F.col(column) + nudge, digits)


@query("""SELECT event_id AS id, n, n <= 1 AS allowed FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS INT) AS n FROM events)""")
def ratelimit_tumbling(spark, sf_dir):
    return limits.tumbling(requests(spark, sf_dir), 1, 3600).select("id", "n", "allowed")


#: Calls in the order of each client, for recursion from one to the next.
CALLS_SQL = "calls AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) / 1e6 AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query(f"""WITH RECURSIVE {CALLS_SQL}, s AS (SELECT key, id, r, t AS began, 1 AS n FROM calls WHERE r = 1 UNION ALL
SELECT c.key, c.id, c.r, CASE WHEN c.t - s.began >= 86400 THEN c.t ELSE s.began END, CASE WHEN c.t - s.began >= 86400 THEN 1 ELSE s.n + 1 END FROM s JOIN calls c ON c.key = s.key AND c.r = s.r + 1)
SELECT key, id, n <= 1 AS allowed FROM s""")
def ratelimit_anchored(spark, sf_dir):
    """A window begins where the last one's end was passed."""
    return limits.anchored(requests(spark, sf_dir), 1, 86_400.0)


@query(f"""WITH RECURSIVE {CALLS_SQL}, s AS (SELECT key, id, r, t, CAST(id % 7 + 1 AS DOUBLE) AS wanted, CAST(8 AS DOUBLE) AS had FROM calls WHERE r = 1 UNION ALL
SELECT c.key, c.id, c.r, c.t, CAST(c.id % 7 + 1 AS DOUBLE), least(8, CASE WHEN s.had >= s.wanted THEN s.had - s.wanted ELSE s.had END + greatest(0, c.t - s.t) * (1 / CAST(86400 AS DOUBLE))) FROM s JOIN calls c ON c.key = s.key AND c.r = s.r + 1)
SELECT key, id, had >= wanted AS taken, CASE WHEN had >= wanted THEN 0.0 WHEN wanted <= 8 THEN round((wanted - had) / (1 / CAST(86400 AS DOUBLE)) + 1e-7, 3) END AS wait_seconds, round(CASE WHEN had >= wanted THEN had - wanted ELSE had END + 1e-12, 6) AS "left" FROM s""")
def token_bucket(spark, sf_dir):
    asked = requests(spark, sf_dir).withColumn("tokens", F.pmod("id", F.lit(7)) + 1)
    taken = limits.token_bucket(asked, LimiterConfig(burst=8), rate=1 / 86_400)
    return taken.withColumns({"wait_seconds": _up("wait_seconds", 3), "left": _up("left", 6, 1e-12)})


@query("""SELECT id, CASE WHEN w <= 300 THEN round(w, 6) END AS wait_seconds FROM (SELECT event_id AS id, greatest(0, (event_id % 97 * 100 - event_id % 7) / 25.0::DOUBLE) AS w FROM events)""")
def token_wait(spark, sf_dir):
    wait = limits.waiting((F.col("id") % 7).cast("double"), (F.col("id") % 97 * 100).cast("double"), 25.0)
    return requests(spark, sf_dir).select("id", F.round(wait, 6).alias("wait_seconds"))


#: Event types as providers, their limits by the length of the name.
PROVIDER_LIMITS = {"requests_per_minute": "1 + length(provider) % 2", "tokens_per_minute": "1 + length(provider) % 3", "burst": "20 + 5 * length(provider)"}
ACQUIRED_SQL = f"""calls AS (SELECT event_id AS id, coalesce(event_type, 'none') AS provider, epoch_us(ts) AS t, CAST(event_id % 40 + 1 AS DOUBLE) AS wanted, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events),
configs AS (SELECT provider, least({PROVIDER_LIMITS["requests_per_minute"]}, {PROVIDER_LIMITS["tokens_per_minute"]}) / 60::DOUBLE AS rate, CAST({PROVIDER_LIMITS["burst"]} AS DOUBLE) AS most FROM (SELECT DISTINCT provider FROM calls)),
s AS (SELECT provider, id, r, t, wanted, rate, most, most AS had FROM calls JOIN configs USING (provider) WHERE r = 1 UNION ALL
SELECT s.provider, c.id, c.r, c.t, c.wanted, s.rate, s.most, least(s.most, CASE WHEN s.had >= s.wanted THEN s.had - s.wanted ELSE s.had END + greatest(0, c.t - s.t) / 1e6 * s.rate) FROM s JOIN calls c ON c.provider = s.provider AND c.r = s.r + 1),
acquired AS (SELECT provider, id, r, had >= wanted AS taken, CASE WHEN had >= wanted THEN 0.0 WHEN wanted <= most THEN (wanted - had) / rate END AS wait_seconds, CASE WHEN had >= wanted THEN had - wanted ELSE had END AS tokens, most FROM s)"""


def _acquired(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    calls = requests(spark, sf_dir).select("id", "ts", F.coalesce("event_type", F.lit("none")).alias("provider"), (F.col("id") % 40 + 1).alias("tokens"))
    providers = calls.select("provider").distinct().select("provider", *(F.expr(e).alias(c) for c, e in PROVIDER_LIMITS.items()))
    return limits.provider_acquired(calls, providers), providers


@query(f"WITH RECURSIVE {ACQUIRED_SQL} SELECT provider, id, taken, round(wait_seconds + 1e-7, 3) AS wait_seconds, round(tokens + 1e-9, 6) AS tokens FROM acquired")
def provider_limits(spark, sf_dir):
    """A few providers have all calls: each one's calls are split over ranges."""
    found, _ = _acquired(spark, sf_dir)
    return found.select(F.col("key").alias("provider"), "id", "taken", _up("wait_seconds", 3).alias("wait_seconds"), _up("left", 6, 1e-9).alias("tokens"))


@query(f"""WITH RECURSIVE {ACQUIRED_SQL} SELECT provider, count(*) AS calls, count_if(taken) AS taken, round(arg_max(tokens, r) + 1e-9, 6) AS tokens, max(most) AS capacity, round(arg_max(tokens, r) / max(most) + 1e-9, 6) AS share FROM acquired GROUP BY provider""")
def provider_status(spark, sf_dir):
    found, providers = _acquired(spark, sf_dir)
    return limits.provider_status(found, providers).withColumns({"tokens": _up("tokens", 6, 1e-9), "share": _up("share", 6, 1e-9)})


def breaker_sql(source: str, ok: str, config: dict[str, str]) -> str:
    """From one call to the next: the state before it (an open breaker that has waited is half open), then what the call makes of it."""
    waited = f"s.state = 'open' AND c.t - s.opened >= {config['recovery_seconds']}"
    return f"""SELECT key, id, r, adm AS admitted,
CASE WHEN NOT adm THEN st WHEN st = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN su + 1 >= most_su THEN 'closed' ELSE st END WHEN NOT ok AND fa + 1 >= most_fa THEN 'open' ELSE 'closed' END AS state,
CASE WHEN NOT adm THEN fa WHEN NOT ok THEN fa + 1 WHEN st = 'half_open' AND su + 1 < most_su THEN fa ELSE 0 END AS failures,
CASE WHEN NOT adm OR NOT ok THEN su WHEN st = 'half_open' AND su + 1 >= most_su THEN 0 ELSE su + 1 END AS successes,
CASE WHEN adm AND NOT ok AND (st = 'half_open' OR fa + 1 >= most_fa) THEN t ELSE op END AS opened,
CASE WHEN NOT adm OR st <> 'half_open' THEN tr WHEN ok AND su + 1 >= most_su THEN 0 ELSE tr + 1 END AS trials
FROM (SELECT *, st = 'closed' OR st = 'half_open' AND tr < most_tr AS adm FROM (SELECT c.key, c.id, c.r, c.t, {ok} AS ok, {config["failures"]} AS most_fa, {config["successes"]} AS most_su, {config["trials"]} AS most_tr,
CASE WHEN {waited} THEN 'half_open' ELSE s.state END AS st, s.failures AS fa, s.opened AS op,
CASE WHEN {waited} THEN 0 ELSE s.successes END AS su, CASE WHEN {waited} THEN 0 ELSE s.trials END AS tr FROM {source}))"""


def breakers_sql(calls: str, ok: str, config: dict[str, str]) -> str:
    first = "calls c, (SELECT 'closed' AS state, 0 AS failures, 0 AS successes, CAST(0 AS DOUBLE) AS opened, 0 AS trials) s WHERE c.r = 1"
    after = "s JOIN calls c ON c.key = s.key AND c.r = s.r + 1"
    return f"WITH RECURSIVE {calls}, s AS ({breaker_sql(first, ok, config)} UNION ALL {breaker_sql(after, ok, config)}) SELECT key, id, admitted, state FROM s"


@query(breakers_sql(CALLS_SQL, "c.event_type <> 'error'", {"failures": "2", "recovery_seconds": "86400", "trials": "3", "successes": "2"}))
def circuit_breaker(spark, sf_dir):
    return limits.circuit_breaker(requests(spark, sf_dir), BreakerConfig(failures=2, recovery_seconds=86_400.0), key="client")


#: Event types as names; those that are registered have breakers by the length of the name.
REGISTERED = {"failures": "1 + length({0}) % 3", "recovery_seconds": "3600.0 * length({0})", "trials": "3", "successes": "1 + length({0}) % 2"}
REGISTERED_SQL = {k: f"CASE WHEN length(c.key) > 4 THEN {v.format('c.key')} ELSE {d} END" for (k, v), d in zip(REGISTERED.items(), (5, 60, 3, 2), strict=True)}
NAMED_SQL = "calls AS (SELECT event_id AS id, coalesce(event_type, 'none') AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)"


@query(breakers_sql(NAMED_SQL, "c.id % 8 NOT IN (0, 1, 2)", REGISTERED_SQL))
def breaker_registry(spark, sf_dir):
    """A few names have all calls: each one's calls are split over ranges."""
    calls = requests(spark, sf_dir).select("id", "ts", F.coalesce("event_type", F.lit("none")).alias("name"), (F.col("id") % 8 > 2).alias("succeeded"))
    registry = calls.select("name").distinct().where("length(name) > 4").select("name", *(F.expr(v.format("name")).alias(k) for k, v in REGISTERED.items()))
    return limits.circuit_breaker(calls, registry=registry)


@query("""SELECT o_orderkey AS id, a AS attempt, least(pow(2.0, a), 300.0) AS exponential, least(1.0 * (a + 1), 300.0) AS linear, 1.0::DOUBLE AS fixed, strftime(o_orderdate + INTERVAL 1 SECOND * CAST(least(pow(2.0, a), 300.0) AS INT), '%Y-%m-%d %H:%M:%S') AS not_before
FROM (SELECT *, CAST(o_orderkey % 12 AS INT) AS a FROM orders)""")
def backoff_schedule(spark, sf_dir):
    """Tasks with the waits that their attempts call for, and the time before which they aren't tried again."""
    c, a = BackoffConfig(), F.col("attempt")
    tried = tasks(spark, sf_dir).select("id", (F.col("id") % 12).cast("int").alias("attempt"), "updated_at")
    delay = limits.exponential(a, c)
    after = F.date_format(limits.not_before(F.col("updated_at"), delay), "yyyy-MM-dd HH:mm:ss")
    return tried.select("id", "attempt", delay.alias("exponential"), limits.linear(a, c).alias("linear"), limits.fixed(c).alias("fixed"), after.alias("not_before"))


# Metrics


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS endpoint, event_type = 'error' AS failed, count(*) AS n, round(sum(abs(value / 20)), 4) AS total FROM events GROUP BY ALL")
def metrics_counters(spark, sf_dir):
    labelled = requests(spark, sf_dir).select(metrics.label(F.col("event_type"), ("view", "click"), "other").alias("endpoint"), (F.col("event_type") == "error").alias("failed"), "seconds")
    return metrics.counters(labelled, ["endpoint", "failed"], "seconds").withColumn("total", F.round("total", 4))


@query("""SELECT event_type, le, count_if(abs(value / 20) <= le) AS n FROM events, (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.5, 1.0, 5.0, 'inf'::DOUBLE]) AS le) WHERE value IS NOT NULL GROUP BY ALL""")
def metrics_histogram(spark, sf_dir):
    return metrics.histogram(requests(spark, sf_dir), ["event_type"], "seconds", metrics.BOUNDS["http"])


QUANTILE_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Of a label's cumulative counts ns at bounds ls: the first that reaches the share, then a straight line between its bounds.
QUANTILE_SQL = "CASE WHEN ns[-1] > 0 THEN CASE WHEN i{0} = len(ns) THEN ls[-2] ELSE (CASE WHEN i{0} = 1 THEN 0 ELSE ls[i{0} - 1] END) + (ls[i{0}] - (CASE WHEN i{0} = 1 THEN 0 ELSE ls[i{0} - 1] END)) * ({1} * ns[-1] - (CASE WHEN i{0} = 1 THEN 0 ELSE ns[i{0} - 1] END)) / (ns[i{0}] - (CASE WHEN i{0} = 1 THEN 0 ELSE ns[i{0} - 1] END)) END END"


@query(f"""SELECT event_type, {", ".join(f"round({QUANTILE_SQL.format(k, q)}, 6) AS {k}" for k, q in QUANTILE_SHARES.items())}
FROM (SELECT *, {", ".join(f"list_position(list_transform(ns, lambda n: n >= {q} * ns[-1]), true) AS i{k}" for k, q in QUANTILE_SHARES.items())} FROM
(SELECT event_type, list(n ORDER BY le) AS ns, list(le ORDER BY le) AS ls FROM (SELECT event_type, le, count_if(abs(value / 20) <= le) AS n FROM events, (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.5, 1.0, 5.0, 'inf'::DOUBLE]) AS le) WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1))""")
def metrics_histogram_quantile(spark, sf_dir):
    counted = metrics.histogram(requests(spark, sf_dir), ["event_type"], "seconds", metrics.BOUNDS["http"])
    found = metrics.histogram_quantile(counted, ["event_type"], QUANTILE_SHARES)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in QUANTILE_SHARES))


@query("""WITH r AS (SELECT w AS step_at, count_if(event_type = 'error') / count(*) > 0.2 AS bad FROM (SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE - INTERVAL 1 MINUTE * unnest(range(0, 5)) + INTERVAL 4 MINUTE AS w FROM events) GROUP BY 1),
i AS (SELECT step_at, step_at - INTERVAL 1 MINUTE * row_number() OVER (ORDER BY step_at) AS island FROM r WHERE bad)
SELECT 'high_error_rate' AS alert, strftime(min(step_at), '%Y-%m-%d %H:%M:%S') AS pending_at, CASE WHEN max(step_at) >= min(step_at) + INTERVAL 2 MINUTE THEN strftime(min(step_at) + INTERVAL 2 MINUTE, '%Y-%m-%d %H:%M:%S') END AS firing_at,
strftime(max(step_at) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS steps FROM i GROUP BY island""")
def metrics_alerts(spark, sf_dir):
    """Shares of errors in five minutes above a fifth, evaluated each minute, that last for two."""
    rates = metrics.sliding_rate(requests(spark, sf_dir), F.col("event_type") == "error")
    seen = rates.select(F.lit("high_error_rate").alias("alert"), (F.col("start") + F.expr("INTERVAL 5 MINUTES")).alias("at"), (F.col("error_ratio") > 0.2).alias("bad"))
    found = metrics.alerts(seen, ["alert"], F.col("bad"), step=60, hold=120)
    return found.select("alert", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("pending_at", "firing_at", "ended_at")), "steps")


@query(f"""WITH h AS (SELECT event_type, le, i, count_if(abs(value / 20) <= le) AS n FROM events, (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.5, 1.0, 5.0, 'inf'::DOUBLE]) AS le, unnest(range(1, 8)) AS i) WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT event_type, count(*) AS n, round(sum(abs(value / 20)), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT 0 AS place, '# HELP request_seconds Seconds of a request' AS line UNION ALL SELECT 1, '# TYPE request_seconds histogram'
UNION ALL SELECT 2, 'request_seconds_bucket{{event_type="' || event_type || '",le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END || '"}} ' || n FROM h
UNION ALL SELECT 2, 'request_seconds_sum{{event_type="' || event_type || '"}} ' || CAST(total AS VARCHAR) FROM t UNION ALL SELECT 2, 'request_seconds_count{{event_type="' || event_type || '"}} ' || n FROM t""")
def metrics_histogram_text(spark, sf_dir):
    events = requests(spark, sf_dir)
    counted = metrics.histogram(events, ["event_type"], "seconds", metrics.BOUNDS["http"])
    sums = metrics.histogram_sums(events, ["event_type"], "seconds").withColumn("total", F.round("total", 4))
    lines = metrics.histogram_lines(counted, sums, "request_seconds", ["event_type"])
    return metrics.family(lines, "request_seconds", "histogram", "Seconds of a request")


@query("SELECT event_type, arg_max(abs(value / 20), (ts, abs(value / 20))) AS value FROM events GROUP BY 1")
def metrics_gauge(spark, sf_dir):
    return metrics.gauges(requests(spark, sf_dir), ["event_type"], "seconds", "ts")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count_if(event_type = 'error') AS errors, round(count(*) / 300, 9) AS per_second, round(count_if(event_type = 'error') / count(*), 9) AS error_ratio
FROM (SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * unnest(range(0, 5)) AS w FROM events) GROUP BY 1""")
def metrics_sliding_rate(spark, sf_dir):
    rates = metrics.sliding_rate(requests(spark, sf_dir), F.col("event_type") == "error")
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "errors", F.round("per_second", 9).alias("per_second"), F.round("error_ratio", 9).alias("error_ratio"))


@query("""SELECT event_type, len(v) AS n, v[least(len(v) // 2, len(v) - 1) + 1] AS p50, v[least(CAST(floor(len(v) * 0.95) AS BIGINT), len(v) - 1) + 1] AS p95, v[least(CAST(floor(len(v) * 0.99) AS BIGINT), len(v) - 1) + 1] AS p99
FROM (SELECT event_type, list_sort(list(abs(value / 20))) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def latency_nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(requests(spark, sf_dir), ["event_type"], "seconds", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT client, CASE WHEN bool_and(s = 'healthy') THEN 'healthy' WHEN bool_or(s = 'unhealthy') THEN 'unhealthy' ELSE 'degraded' END AS status
FROM (SELECT user_id AS client, CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'signup' THEN 'degraded' ELSE 'healthy' END AS s FROM events) GROUP BY 1""")
def health_rollup(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "signup", "degraded").otherwise("healthy")
    return metrics.health(requests(spark, sf_dir).select("client", status.alias("status")), ["client"])


@query("""SELECT event_id AS id, CASE WHEN code >= 500 THEN 'server_error' WHEN code >= 400 THEN 'client_error' END AS error FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS code FROM events)""")
def metrics_responses(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return metrics.responses(requests(spark, sf_dir), code).select("id", "error")


@query("""SELECT 'events{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf_dir):
    return metrics.exposition(metrics.counters(requests(spark, sf_dir), ["event_type"]), "events", ["event_type"], "n")


def chunks_of_documents(spark: SparkSession, sf_dir: str, config: ChunkConfig | None = None) -> DataFrame:
    """The flagship: documents, chunked and checked."""
    chunks = chunking.chunk(docs(spark, sf_dir), config)
    checked = validate.validated(chunks, text_col="content")
    return checked.select("doc_id", "chunk_index", "start_char", "end_char", "tokens", "is_valid", F.round("quality_score", 6).alias("quality_score"), "content_hash")
