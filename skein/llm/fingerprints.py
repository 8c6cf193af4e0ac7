"""Document fingerprints from improbable features: byte windows whose entropy is rare in the corpus are chosen and put
into chained Bloom filters, whose bit overlap, less what chance gives, is the likeness of two texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.common import map_batches, mix64
from skein.llm.suffix_dedup import rolling, sliding
from skein.session import ensure_importable


class Scale(NamedTuple):
    """Bytes of a feature, windows that compete with each other, and how many contests a feature must win."""

    window: int
    contest: int
    wins: int


#: Every text has features of the second scale, texts of at least LONG bytes also of the first. Two texts are compared at the
#: longest scale that both have, so any two have one in common.
SCALES, LONG = (Scale(64, 64, 16), Scale(16, 8, 2)), 1024
#: Bytes of the features of texts that are too short for a contest: all their windows count.
TINY = 4
#: Steps of entropy from none to the most that a window can have.
STEPS = 1024
FILTER_BITS, HASHES, FILTER_FEATURES = 2048, 5, 160
#: c * log2(c) in 2 ** -24 units, so that running sums are exact.
TERMS = np.array([0] + [round(c * np.log2(c) * 2**24) for c in range(1, SCALES[0].window + 1)], np.int64)


def entropies(data: np.ndarray, window: int) -> np.ndarray:
    """Step of the byte entropy of each window, from running counts of the byte that leaves and the one that enters."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, window):
        same = (data[:-k] == data[k:]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    out = np.empty(n, np.int64)
    _, counts = np.unique(data[:window], return_counts=True)
    out[0] = TERMS[counts].sum()
    # The window from i + 1: byte i leaves with after[i] equals behind it, byte i + window enters with its equals before it.
    leaves = TERMS[after[: n - 1]] - TERMS[after[: n - 1] + 1]
    enters = TERMS[before[window:] + 1] - TERMS[before[window:]]
    out[1:] = out[0] + np.cumsum(leaves + enters)
    most = TERMS[window]
    return (most - out) * (STEPS - 1) // most


#: By scale, the Bloom filters as rows of bytes and how many features each holds.
Digest = dict[int, tuple[np.ndarray, np.ndarray]]


def text_of(digest: Digest) -> str:
    """By scale its number of filters, their numbers of features and the filters, as base64; empty without features."""
    parts = [bytes([i]) + len(f).to_bytes(4, "little") + n.astype("<u2").tobytes() + f.tobytes() for i, (f, n) in sorted(digest.items())]
    return base64.b64encode(b"".join(parts)).decode()


def wanted(size: int, scale: int) -> bool:
    return size >= LONG if scale == 0 else size > 0


#: Bytes of texts that are gone through at once, so that what is made of them stays small.
TOGETHER = 1 << 19


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """ranks[scale, step]: place of an entropy step, rarest first."""
    out: list[Digest] = [{} for _ in texts]
    for start, stop in batches_of(texts):
        for i, scale in enumerate(SCALES):
            at = [k for k in range(start, stop) if wanted(len(texts[k]), i)]
            for k, found in zip(at, _filters([texts[k] for k in at], ranks[i], scale), strict=True):
                out[k][i] = found
    return out


def _features(texts: list[bytes], ranks: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the chosen windows, in order of the texts and, in a text, of their places.

    The texts are gone through end to end; contests that reach over an end don't count.
    """
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    reach = scale.window + scale.contest - 1
    tiny = [(k, texts[k][i : i + TINY]) for k in np.flatnonzero(np.diff(ends, prepend=0) < reach).tolist() for i in range(max(1, len(texts[k]) - TINY + 1))]
    short = np.array([k for k, _ in tiny], np.int64)
    alone = mix64(np.frombuffer(b"".join(hashlib.sha256(x).digest()[:8] for _, x in tiny), np.uint64))
    if len(set(short.tolist())) == len(texts):
        return _distinct(short, alone)
    place = ranks[entropies(data, scale.window)]
    # The first of the rarest windows wins each contest.
    winner = sliding((place << np.int64(40)) | np.arange(len(place)), scale.contest) & np.int64((1 << 40) - 1)
    inside = np.ones(len(winner), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - reach + 1) : end] = False
    at, wins = np.unique(winner[inside], return_counts=True)
    text = np.searchsorted(ends, at, side="right")
    good = wins >= scale.wins
    # A text without a clear winner keeps all that won at all.
    has = np.zeros(len(texts), bool)
    has[text[good]] = True
    good |= ~has[text]
    at, text = at[good], text[good]
    return _distinct(np.concatenate([text, short]), np.concatenate([rolling(data, scale.window, at), alone]))


def _distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of a text once, in order of the texts and, in a text, of their first places."""
    order = np.lexsort((np.arange(len(value)), value, text))
    first = np.ones(len(order), bool)
    first[1:] = (text[order][1:] != text[order][:-1]) | (value[order][1:] != value[order][:-1])
    kept = np.sort(order[first])
    kept = kept[np.argsort(text[kept], kind="stable")]
    return text[kept], value[kept]


def _filters(texts: list[bytes], ranks: np.ndarray, scale: Scale) -> list[tuple[np.ndarray, np.ndarray]]:
    if not texts:
        return []
    text, value = _features(texts, ranks, scale)
    count = np.bincount(text, minlength=len(texts))
    rows = -(-count // FILTER_FEATURES)
    base = np.cumsum(rows) - rows
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    row = base[text] + nth // FILTER_FEATURES
    bits = np.zeros((int(rows.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        bits[row, ((value >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    filters, sizes = np.packbits(bits, axis=1), np.bincount(row, minlength=len(bits))
    return [(filters[i : i + n], sizes[i : i + n]) for i, n in zip(base.tolist(), rows.tolist(), strict=True)]


def likeness(a: Digest, b: Digest) -> float:
    """At the longest scale that both have, the mean over the filters of the digest with fewer of the best overlap with the
    other's. 1 for two empty digests, 0 for an empty and another one.

    An overlap is (common bits - those expected by chance) over (the smaller number of bits - chance), at least 0.
    """
    if not a or not b:
        return float(not a and not b)
    i = min(a.keys() & b.keys())
    (few, sizes), (many, _) = (a[i], b[i]) if len(a[i][1]) <= len(b[i][1]) else (b[i], a[i])
    bits = np.bitwise_count(many).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, size in zip(few, sizes.tolist(), strict=True):
        own = int(np.bitwise_count(row).sum(dtype=np.int64))
        chance = own * bits / FILTER_BITS
        overlap = (np.bitwise_count(many & row).sum(axis=1, dtype=np.int64) - chance) / np.maximum(np.minimum(own, bits) - chance, 1e-9)
        total += size * min(max(float(overlap.max()), 0.0), 1.0)
    return total / int(sizes.sum())


def rarity(docs: DataFrame) -> np.ndarray:
    """By scale, the place of each entropy step by its number of windows in all texts of that scale, rarest first,
    ties to the lower step."""

    def count(batch):
        total = np.zeros((len(SCALES), STEPS), np.int64)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        for start, stop in batches_of(texts):
            for i, scale in enumerate(SCALES):
                part = [t for t in texts[start:stop] if wanted(len(t), i)]
                if sum(map(len, part)) >= scale.window:
                    steps = entropies(np.frombuffer(b"".join(part), np.uint8), scale.window)
                    inside = np.ones(len(steps), bool)
                    for end in np.cumsum([len(t) for t in part])[:-1].tolist():
                        inside[max(0, end - scale.window + 1) : end] = False
                    total[i] += np.bincount(steps[inside], minlength=STEPS)
        scale, step = np.nonzero(total)
        return {"scale": scale, "step": step, "n": total[scale, step]}

    counted = {r[:2]: r[2] for r in map_batches(docs.select("text"), count, "scale int, step int, n long").groupBy("scale", "step").agg(F.sum("n")).collect()}
    ranks = np.empty((len(SCALES), STEPS), np.int64)
    for i, row in enumerate(ranks):
        row[sorted(range(STEPS), key=lambda s: (counted.get((i, s), 0), s))] = np.arange(STEPS)
    return ranks


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, bytes_each: int) -> list[int]:
    """First ids of ranges with about as many rows each; their number follows the bytes of text, up to 50,000, beyond which a
    task goes through more bytes, batch by batch, in the same memory."""
    rows, size = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = min(max(1, size // bytes_each), max(1, rows), 50_000)
    if parts == 1:
        return []
    return sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)))


def fingerprint(docs: DataFrame, bytes_each: int = 16 << 20) -> DataFrame:
    """Digest of every text and of its edited text, beside the digest of the next document in order of doc_id.

    One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; an empty text has an empty digest, like only another empty one. The
    last document is followed by the first, a single one by itself. Rows with a null doc_id come last, rows with the
    same doc_id in order of their texts. Other columns are ignored; no rows give no rows.

    Texts are dealt once into ranges of doc_id; each range also gets a copy of the first document after it.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    last = (1 << 63) - 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(rarity(docs))
    bounds = _ranges(docs, bytes_each)
    cut = cut.withColumn("part", _place(F.col("key"), [int(x) for x in bounds]))
    firsts = sorted((r["part"], r["first"]) for r in cut.groupBy("part").agg(F.min("key").alias("first")).collect())
    parts = [p for p, _ in firsts]
    # The first document of each range goes to the range before it as well; that of the first range to the last.
    lead = {first: parts[i - 1] for i, (_, first) in enumerate(firsts)}
    if lead:
        table = spark.createDataFrame([(int(k), int(v)) for k, v in lead.items()], "key long, to int")
        heads = cut.join(F.broadcast(table), "key")
        one = heads.groupBy("key", "to").agg(F.min("text").alias("text")).select("key", F.lit(None).cast(id_type).alias("doc_id"), "text", F.col("to").alias("part"), F.lit(True).alias("after"))
        cut = cut.withColumn("after", F.lit(False)).unionByName(one)
    else:
        cut = cut.withColumn("after", F.lit(False))
    cut = cut.repartitionById(max(1, len(bounds) + 1), F.col("part").cast("int")).sortWithinPartitions("part", "after", "key", "text")
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda t: t.encode("utf-8", "surrogatepass")
        last: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("part", "after", "doc_id", "text")), strict=True))
            rows = last + [(*r, d) for r, d in zip(rows, digests([raw(r[3]) for r in rows], ranks.value), strict=True)]
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[1]]
            assert all(x[0] == y[0] for x, y in pairs), "a range without its following document"
            news = [raw(edited(x[3], y[3])) for x, y in pairs]
            out = []
            for (x, y), new, d in zip(pairs, news, digests(news, ranks.value), strict=True):
                out.append((x[2], len(x[3]), hashlib.sha256(new).hexdigest(), text_of(x[4]), text_of(d), likeness(x[4], d), likeness(x[4], y[4])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            last = rows[-1:]

    return cut.select("part", "after", "doc_id", "text").mapInArrow(run, schema)


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above key, by bisection over a literal array."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    edges = F.lit(bounds).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))]).cast("array<int>")
    ahead = lambda low, step: (low + step <= n) & (F.element_at(edges, F.least(low + step, F.lit(n))) <= key)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(ahead(low, step), low + step).otherwise(low))
