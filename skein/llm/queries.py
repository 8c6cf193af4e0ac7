"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, embedding_dedup, fingerprints, html_extract, language_id, near_dedup, packing, release, sentencepiece_codec, suffix_dedup, toxicity, url_filter, whitening
from skein.llm.common import held_out
from skein.session import table

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
TOXIC_AT = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(5, 0)))
    return language_id.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece_codec.codec(table(spark, sf_dir, "documents"), f.read())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: Sizes of the groups that long conversations are summed in.
REPLAY = {"level": release.LEVEL, "seconds": release.SECONDS}


def replayed(turns: DataFrame) -> DataFrame:
    """Turns under faults by hash; the text's CRC-32 counts in the state."""
    distance, plan = release.by_hash("conv_id", "turn")
    weight = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return release.replay(turns, "conv_id", "turn", distance, plan, weight, reach=4, **REPLAY)


def op11_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's bytes by a table of 256 entries; crc.t is that table."""
    byte = f"(instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 2, 1)) - 1"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: Turn after turn by recursion; `done` holds the time of delivery of each turn so far, or null.
OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, w) - 1 AS p, w, h0 % 5 AS d, h1 % 101 < 50 AS faulty, h2 % 101 AS repair, fails FROM
(SELECT conv_id, turn, {_crc32_sql("coalesce(text, '')")} AS w, {", ".join(_crc32_sql(f"('{k}:' || conv_id || ':' || turn)") + f" AS h{k}" for k in range(3))},
[{", ".join(_crc32_sql(f"('{k}:' || conv_id || ':' || turn)") + " % 3 = 0" for k in range(3, 9))}] AS fails FROM conversations, crc)),
s AS (SELECT conv_id, CAST(-1 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS first_at, CAST(NULL AS BIGINT) AS last_at, CAST(NULL AS BIGINT) AS w, CAST([] AS BIGINT[]) AS done FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT conv_id, p, turn, CASE WHEN blocked THEN 'blocked' WHEN k IS NULL THEN 'dead' ELSE 'delivered' END, CASE WHEN blocked THEN 0 ELSE coalesce(k, 6) END, CASE WHEN NOT blocked THEN began END,
CASE WHEN NOT blocked THEN began + 10 * (CAST(pow(2, coalesce(k, 6) - 1) AS BIGINT) - 1) END, w, list_append(done, CASE WHEN NOT blocked AND k IS NOT NULL THEN began + 10 * (CAST(pow(2, k - 1) AS BIGINT) - 1) END)
FROM (SELECT *, CAST(list_filter([1, 2, 3, 4, 5, 6], lambda a: NOT faulty OR began + 10 * (CAST(pow(2, a - 1) AS BIGINT) - 1) >= 7 * p + repair AND NOT fails[a])[1] AS INT) AS k FROM
(SELECT t.*, s.done, child AND s.done[t.p - t.d + 1] IS NULL AS blocked, CASE WHEN child THEN greatest(7 * t.p, s.done[t.p - t.d + 1]) ELSE 7 * t.p END AS began
FROM s JOIN (SELECT *, d > 0 AND d <= p AS child FROM t) t ON t.conv_id = s.conv_id AND t.p = s.p + 1)))
SELECT conv_id, turn, status, attempts, first_at, last_at, CASE WHEN status = 'delivered' THEN no END AS release_no, CASE WHEN status = 'delivered' THEN CAST(sum(no * w) OVER (PARTITION BY conv_id, status ORDER BY no) AS BIGINT) END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn, p) AS no FROM s WHERE p >= 0)"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


#: Pairs of unit vectors, then the smallest vec_id of those reachable along links.
OP12_SQL = """WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    ops = (op1_toxicity, op2_ann, op3_suffix_dedup, op4_url_filter, op5_language_id, op6_sentencepiece, op7_fingerprints, op8_near_dedup, op9_packing, op10_html_extraction, op11_release, op12_embedding_dedup, op13_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op11_release": OP11_SQL, "op12_embedding_dedup": OP12_SQL}
