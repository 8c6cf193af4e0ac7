"""Accepting documents: validation, content hash, first task, duplicates, attributes, pages to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import sha256, strip

#: Longest uri and content, largest priority.
MAX_URI, MAX_CONTENT, MAX_PRIORITY = 2048, 1_000_000, 10


def content_hash(content: Column, uri: Column) -> Column:
    """Hash of the content, of the uri where there is none."""
    return sha256(F.coalesce(F.nullif(content, F.lit("")), uri))


def problems(uri: Column, content: Column, priority: Column, kind: Column) -> Column:
    """Names of the rules that a request breaks."""
    length = F.length(F.coalesce(uri, F.lit("")))
    checks = [
        ("source_uri_length", (length < 1) | (length > MAX_URI)),
        ("content_length", F.length(F.coalesce(content, F.lit(""))) > MAX_CONTENT),
        ("priority_range", (priority < 0) | (priority > MAX_PRIORITY)),
        ("text_without_content", (kind == "text") & (strip(F.coalesce(content, F.lit(""))) == "")),
        ("url_scheme", (kind == "url") & ~F.coalesce(uri.startswith("http://") | uri.startswith("https://"), F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(broken, name) for name, broken in checks)))


def _task_attributes() -> Column:
    named = F.map_from_arrays(F.array(F.lit("source_uri"), F.lit("document_type"), F.lit("content")), F.array("source_uri", "document_type", "content"))
    return F.map_filter(named, lambda k, v: (k != "content") | (F.coalesce(v, F.lit("")) != ""))


def accept(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, first tasks) of requests(id, source_uri, content, document_type, priority). A task's attributes are where
    the document comes from, its type and its content, if there is any."""
    documents = requests.select("id", "source_uri", content_hash(F.col("content"), F.col("source_uri")).alias("content_hash"), "document_type", F.lit("pending").alias("status"))
    kind = F.when(F.col("document_type") == "pdf", "parse_pdf").otherwise("chunk_document")
    tasks = requests.select(F.col("id").alias("document_id"), kind.alias("task_type"), F.lit("pending").alias("status"), "priority", F.lit(0).alias("attempt_count"), _task_attributes().alias("attributes"))
    return documents, tasks


def chunks_accepted(documents: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk rows, embed_chunk tasks, documents) of chunking.chunk()'s rows, which name a document by doc_id.

    A chunk's id is a hash of its document and place, so a repeated run gives the same rows; each chunk is a pending row and
    a task of priority 0 that names it. A document that has chunks goes to embedding, whatever it was.
    """
    id_ = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    attributes = F.struct(F.col("start_char"), F.col("end_char"), F.col("page_num") if "page_num" in chunks.columns else F.lit(None).cast("int").alias("page_num"), F.col("context"))
    rows = chunks.select(id_.alias("id"), F.col("doc_id").alias("document_id"), "chunk_index", "content", "content_hash", F.lit("pending").alias("status"), "tokens", attributes.alias("attributes"), now.alias("created_at"), now.alias("updated_at"))
    tasks = rows.select(
        "document_id", F.lit("embed_chunk").alias("task_type"), F.lit("pending").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("attempt_count"), F.create_map(F.lit("chunk_id"), F.col("id")).alias("attributes")
    )
    chunked = rows.groupBy(F.col("document_id").alias("id")).agg(F.lit(True).alias("_chunked"))
    moved = documents.join(chunked, "id", "left").withColumn("status", F.when(F.col("_chunked"), "embedding").otherwise(F.col("status"))).select(*documents.columns)
    return rows, tasks, moved


def first_of_key(documents: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation, so that a hot key is combined before it is shuffled."""
    rest = [c for c in documents.columns if c not in key]
    ranked = F.struct(*order, *(c for c in rest if c not in order))
    return documents.groupBy(*key).agg(F.min(ranked).alias("first")).select(*key, *(F.col(f"first.{c}") for c in rest))


def unseen(documents: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    return documents.join(existing.select(*key), key, "left_anti")


def merged_attributes(left: Column, right: Column) -> Column:
    """Both maps' entries; the right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def page_texts(pages: DataFrame, skip_failed: bool = False) -> DataFrame:
    """Pages(doc, page_num, text, success) with a mark in place of blank text."""
    shown = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.format_string("[Image-only page %d]", F.col("page_num") + 1)).otherwise(F.col("text"))
    kept = pages.where("success") if skip_failed else pages
    return kept.withColumn("text", F.when(F.col("success"), shown).otherwise(F.lit("")))


def joined_pages(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text, pages): non-blank pages in page order, parted by a blank line."""
    listed = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("page_num", "text"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("pages"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
