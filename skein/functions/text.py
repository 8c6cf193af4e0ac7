"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at either end, in linear time: each run of white space is looked at once."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def printable(c: Column) -> Column:
    """Without control and separator characters other than space and line feed."""
    return F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n]]", "")


def paragraphs(c: Column) -> Column:
    """Non-empty stripped parts between blank lines."""
    return F.filter(F.transform(F.split(c, r"\n\n+"), strip), lambda p: p != "")


def clean(c: Column) -> Column:
    """Blanks collapsed, unprintable characters dropped, paragraphs stripped and parted by one blank line."""
    tidy = F.transform(F.split(c, r"\n\n+"), lambda p: strip(printable(F.regexp_replace(p, r"[ \t]+", " "))))
    return F.array_join(F.filter(tidy, lambda p: p != ""), "\n\n")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def token_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))
