"""Quality checks and scores of chunks, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import sha256, strip, token_estimate
from skein.schema import QualityConfig
from skein.session import Scratch

#: Characters that end a finished text, and those besides letters and digits that carry meaning.
ENDINGS = ".!?:…\")]}—"
MEANINGFUL = r"[^\p{L}\p{N} .,!?;:\n\t-]"


def meaningful_ratio(text: Column) -> Column:
    """Share of letters, digits, blanks and common punctuation; null for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, MEANINGFUL, "")) / F.length(text))


def truncated(text: Column) -> Column:
    """A text, stripped, that doesn't end as a finished one does."""
    return (text != "") & ~F.right(text, F.lit(1)).isin(*ENDINGS)


def duplicate_key(text: Column) -> Column:
    """Hash under which texts count as the same: stripped and lower-cased."""
    return sha256(F.lower(strip(text)))


def text_hash(text: Column) -> Column:
    """Hash of the stripped text in its own case."""
    return sha256(strip(text))


def checks(text: Column, duplicate: Column, config: QualityConfig) -> list[tuple[str, Column, Column]]:
    """(issue, whether it holds, reason) of a stripped text, in order."""
    tokens, chars, ratio = token_estimate(text), F.length(text), meaningful_ratio(text)
    return [
        ("too_few_tokens", tokens < config.tokens[0], F.format_string(f"Token count %d < minimum {config.tokens[0]}", tokens)),
        ("too_many_tokens", tokens > config.tokens[1], F.format_string(f"Token count %d > maximum {config.tokens[1]}", tokens)),
        ("too_few_chars", chars < config.chars[0], F.format_string(f"Character count %d < minimum {config.chars[0]}", chars)),
        ("too_many_chars", chars > config.chars[1], F.format_string(f"Character count %d > maximum {config.chars[1]}", chars)),
        ("low_content_quality", F.coalesce(ratio < config.meaningful, F.lit(True)), F.lit("Low ratio of meaningful content")),
        ("truncated_content", truncated(text), F.lit("Content appears truncated")),
        ("duplicate", duplicate, F.lit("Duplicate content detected")),
    ]


def quality_score(text: Column, duplicate: Column, config: QualityConfig) -> Column:
    """1, scaled down for lengths outside the ideal range, for little meaningful content and for duplicates."""
    tokens = token_estimate(text)
    low, high = max(2 * config.tokens[0], 10), min(config.tokens[1], 1024)
    length = F.when(tokens < low, tokens / low).when(tokens > high, F.lit(high) / tokens).otherwise(F.lit(1.0))
    ratio = meaningful_ratio(text)
    content = F.when(ratio < 0.7, ratio / 0.7).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), length * content * F.when(duplicate, F.lit(0.3)).otherwise(F.lit(1.0))))


def validated(chunks: DataFrame, config: QualityConfig | None = None, text_col: str = "text", duplicate_col: str | None = None) -> DataFrame:
    """Adds issues, reasons, is_valid, token_count, quality_score and is_duplicate. A null text is empty.

    duplicate_col names a boolean column, such as that of the leader filter; without it nothing is a duplicate.
    """
    config = config or QualityConfig()
    # In a projection of its own, the text is stripped once and not once for each use.
    names = chunks.columns
    chunks, text = chunks.withColumn("_stripped", strip(F.coalesce(F.col(text_col), F.lit("")))), F.col("_stripped")
    duplicate = F.col(duplicate_col) if duplicate_col else F.lit(False)
    found = checks(text, duplicate, config)
    issues = F.array_compact(F.array(*(F.when(holds, name) for name, holds, _ in found)))
    reasons = F.array_compact(F.array(*(F.when(holds, reason) for _, holds, reason in found)))
    return chunks.select(
        *names,
        issues.alias("issues"),
        reasons.alias("reasons"),
        (F.size(issues) == 0).alias("is_valid"),
        token_estimate(text).alias("token_count"),
        quality_score(text, duplicate, config).alias("quality_score"),
        duplicate.alias("is_duplicate"),
    )


def valid_only(checked: DataFrame, seq: str, text_col: str = "text") -> DataFrame:
    """(index, text) of the valid rows of validated(), index being the row's place in order of seq, from 0.

    Places are counted over all rows in two steps, a count per range of seq and a running number within it, so no task
    sees all rows. Duplicates must have been found over all rows before, as invalid texts count as seen too.
    """
    spark = checked.sparkSession
    scratch = Scratch(spark)
    try:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ranged = scratch.write(checked.select(F.col(seq).alias("_seq"), F.col(text_col).alias("text"), "is_valid").repartitionByRange(parts, "_seq").withColumn("_part", F.spark_partition_id()), "ranged")
        counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        # As many rows as there are partitions.
        before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_seq")) - 1
        numbered = ranged.withColumn("_place", place).where("is_valid").join(F.broadcast(before), "_part")
        return scratch.write(numbered.select((F.col("_before") + F.col("_place")).alias("index"), "text"), "result")
    finally:
        scratch.close(keep="result")
