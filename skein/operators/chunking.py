"""Documents to chunks along paragraphs and sentences. Each document is chunked where its row is: no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf

from skein.functions.text import clean, sha256, strip
from skein.schema import ChunkConfig
from skein.session import ensure_importable, sliced

#: What parts a text, and what joins the parts again, from coarse to fine.
LEVELS = ((re.compile(r"\n\n+"), "\n\n"), (re.compile(r"(?<=[.!?])\s+"), " "))
#: A space after this share of the size is taken as the place to cut.
LATE = 0.7
PIECE = "text string, start_char int, end_char int, tokens int"


def parts(text: str, size: int) -> Iterator[str]:
    """Greedy packing: units are joined while they fit; one that doesn't fit is taken apart at the next level."""
    held = ""

    def fit(unit: str, level: int) -> Iterator[str]:
        nonlocal held
        joined = f"{held}{LEVELS[level][1]}{unit}".strip()
        if len(joined) <= size:
            held = joined
            return
        if held:
            yield held
        held = unit
        if level + 1 < len(LEVELS):
            held = ""
            yield from units(unit, level + 1)

    def units(whole: str, level: int) -> Iterator[str]:
        for unit in LEVELS[level][0].split(whole):
            if unit := unit.strip():
                yield from fit(unit, level)

    yield from units(text, 0)
    if held:
        yield held


def hard_cuts(text: str, size: int) -> Iterator[str]:
    """Pieces of at most size, cut at a late space if there is one. The rest of the text is never copied."""
    start, end = 0, len(text)
    while end - start > size:
        space = text.rfind(" ", start, start + size)
        at = space if space - start > size * LATE else start + size
        if piece := text[start:at].strip():
            yield piece
        start = at
        while start < len(text) and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
    if start < end:
        yield text[start:end]


def pieces(text: str, config: ChunkConfig) -> list[list]:
    """[text, start, end, tokens] of each chunk. Places count the chunks' own lengths; tokens are those before a merge."""
    out: list[list] = []
    at = 0
    for part in parts(text, config.size):
        start, at = at, at + len(part)
        if len(part) < config.least:
            # Too short for itself: it goes to the chunk before if that has room, else it is dropped.
            if out and len(out[-1][0]) + len(part) < config.size:
                out[-1][0] += "\n\n" + part
                out[-1][2] = at
            continue
        cut = list(hard_cuts(part, config.size)) if len(part) > config.size else [part]
        for i, piece in enumerate(cut):
            out.append([piece, start, at if i == len(cut) - 1 else start + len(piece), max(1, len(piece) // 4)])
            start += len(piece) + 1
    return out


def pieces_of(text: Column, config: ChunkConfig) -> Column:
    """Array of chunks of a cleaned text."""

    kind = pa.list_(pa.struct([("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("tokens", pa.int32())]))

    @arrow_udf(f"array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            yield pa.array([[tuple(p) for p in pieces(t, config)] if t and t.strip() else [] for t in texts.to_pylist()], kind)

    return run(text)


def with_context(chunks: Column, width: int = 100) -> Column:
    """Adds what comes before and after: the neighbours' ends in dots, parted by a space."""
    return F.transform(
        chunks,
        lambda c, i: c.withField(
            "context",
            F.concat_ws(
                " ",
                F.when(i > 0, F.concat(F.lit("..."), F.right(F.get(chunks, i - 1)["text"], F.lit(width)))),
                F.when(i < F.size(chunks) - 1, F.concat(F.left(F.get(chunks, i + 1)["text"], F.lit(width)), F.lit("..."))),
            ),
        ),
    )


def chunk(docs: DataFrame, config: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text", with_page: bool = False) -> DataFrame:
    """One row per chunk: id, chunk_index, content, start_char, end_char, tokens, context, content_hash.

    Documents that are null or blank, or have no chunk, give no rows (see without_chunks). with_page adds page_num, the
    document's id: for texts that are pages, keyed by their number.
    """
    config = config or ChunkConfig()
    ensure_importable(docs.sparkSession)
    found = docs.select(id_col, pieces_of(clean(F.col(text_col)), config).alias("chunks"))
    found = found.select(id_col, F.slice(with_context(F.col("chunks")), 1, config.most_chunks).alias("chunks"))
    # An inner explode makes the optimizer work chunks out once more, to drop empty arrays below it.
    rows = found.select(id_col, F.posexplode_outer("chunks").alias("chunk_index", "c")).where(F.col("chunk_index").isNotNull())
    page = [F.col(id_col).alias("page_num")] * with_page
    return rows.select(id_col, "chunk_index", F.col("c.text").alias("content"), "c.start_char", "c.end_char", "c.tokens", "c.context", sha256(F.col("c.text")).alias("content_hash"), *page)


def without_chunks(docs: DataFrame, config: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, reason) of documents that give no chunk."""
    config = config or ChunkConfig()
    ensure_importable(docs.sparkSession)
    blank = strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    none = F.size(pieces_of(clean(F.col(text_col)), config)) == 0
    return docs.select(id_col, F.when(blank, "blank").when(none, "no_chunks").alias("reason")).where("reason is not null")


def sentence_packs(text: Column, size: int) -> Column:
    """The greedy packing of one paragraph's sentences, as an array: the same fold by built-in functions alone."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    # A sentence and what is held are stripped already.
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s))
        emitted = F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
        fits = F.length(joined) <= size
        return F.struct(F.when(fits, acc["done"]).otherwise(emitted).alias("done"), F.when(fits, joined).otherwise(s).alias("held"))

    packed = F.aggregate(sentences, empty, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))
    return F.when(F.length(text) <= size, F.filter(F.array(text), lambda t: t != "")).otherwise(packed)


def register(spark: SparkSession, config: ChunkConfig | None = None) -> None:
    """SQL: lateral chunk_text(text)."""
    settings = config or ChunkConfig()

    @udtf(returnType=f"chunk_index int, {PIECE}")
    class ChunkText:
        def eval(self, text: str):
            for i, piece in enumerate(pieces(text or "", settings)):
                yield (i, *piece)

    ensure_importable(spark)
    spark.udtf.register("chunk_text", ChunkText)
