"""Loading documents: files, pages over HTTP, PDF documents through a parser interface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import strip
from skein.session import ensure_importable


def local_path(uri: Column) -> Column:
    """The path of a file uri or a bare path; an error for any other scheme."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.url_decode(F.replace(F.regexp_replace(uri, r"^file://(localhost)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(scheme == "file", path).when(scheme == "", uri).otherwise(F.raise_error(F.concat(F.lit("unsupported scheme: "), scheme)))


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, length) of files as bytes; a missing path raises."""
    return spark.read.format("binaryFile").load(paths).select("path", "content", "length")


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of UTF-8 files, one row each."""
    return files(spark, paths).select("path", F.decode("content", "UTF-8").alias("text"))


def inline_or(content: Column, loaded: Column) -> Column:
    """Content given with the request wins over what the source holds."""
    return F.coalesce(F.nullif(content, F.lit("")), loaded)


class Fetcher(Protocol):
    def get(self, url: str) -> str: ...


class UrlFetcher:
    """Follows redirects; a status outside 200 to 299 raises."""

    def __init__(self, timeout: float = 30.0):
        self.timeout = timeout

    def get(self, url: str) -> str:
        from urllib.request import urlopen

        with urlopen(url, timeout=self.timeout) as reply:
            return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


def fetched(urls: DataFrame, fetcher: Callable[[], Fetcher], url_col: str = "url") -> DataFrame:
    """(url, body, error) of each row: the raw body, or what went wrong."""
    ensure_importable(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = fetcher()
        for batch in batches:
            bodies, errors = [], []
            for url in batch["url"].to_pylist():
                try:
                    body, error = it.get(url), None
                except Exception as e:  # any failure of a source is a row
                    body, error = None, f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch["url"], pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["url", "body", "error"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, body string, error string")


class Page(NamedTuple):
    page_num: int
    text: str
    success: bool
    error: str | None = None


class Parsed(NamedTuple):
    pages: list[Page]
    title: str | None = None
    author: str | None = None
    created: str | None = None
    encrypted: bool = False


class PdfParser(Protocol):
    def parse(self, raw: bytes) -> Parsed: ...


class PypdfParser:
    """The parser of the optional package pypdf. A page that fails is kept as a failed page."""

    def parse(self, raw: bytes) -> Parsed:
        import io

        from pypdf import PdfReader

        reader = PdfReader(io.BytesIO(raw))
        pages = []
        for i, page in enumerate(reader.pages):
            try:
                pages.append(Page(i, page.extract_text() or "", True))
            except Exception as e:
                pages.append(Page(i, "", False, str(e)))
        info = reader.metadata or {}
        of = lambda k: (str(info[k]).strip() or None) if info.get(k) else None
        return Parsed(pages, of("/Title"), of("/Author"), of("/CreationDate"), reader.is_encrypted)


PARSED = "path string, filename string, file_size_bytes long, content_hash string, num_pages int, title string, author string, creation_date string, encrypted boolean, error string, pages array<struct<page_num:int,text:string,success:boolean,error:string>>"


def parsed(documents: DataFrame, parser: Callable[[], PdfParser] = PypdfParser) -> DataFrame:
    """One row per row of documents(path, content, length): metadata, pages, and the error of a file that can't be read."""
    ensure_importable(documents.sparkSession)

    def run(batches):
        it = parser()
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(raw or b"")
                base = (path, path.rsplit("/", 1)[-1], len(raw), hashlib.sha256(raw).hexdigest())
                try:
                    if not raw:
                        raise ValueError("empty file")
                    got = it.parse(raw)
                    rows.append((*base, len(got.pages), got.title, got.author, got.created, got.encrypted, None, [p._asdict() for p in got.pages]))
                except Exception as e:
                    rows.append((*base, 0, None, None, None, None, f"{type(e).__name__}: {e}", []))
            import pandas as pd

            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return documents.select("path", "content").mapInPandas(run, PARSED)


def pages(documents: DataFrame, skip_failed: bool = False) -> DataFrame:
    """(path, page_num, text, success): one row per page of parsed documents, blank text marked."""
    return shown(documents.select("path", F.explode("pages").alias("p")).select("path", "p.page_num", "p.text", "p.success"), skip_failed)


def shown(rows: DataFrame, skip_failed: bool = False) -> DataFrame:
    """Rows of pages with the texts that stand for blank and failed ones."""
    marked = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.format_string("[Image-only page %d]", F.col("page_num") + 1)).otherwise(F.col("text"))
    rows = rows.withColumn("text", F.when(F.col("success"), marked).otherwise(F.lit("")))
    return rows.where("success") if skip_failed else rows
