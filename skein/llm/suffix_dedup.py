"""Repeated passages by prefix-free parsing.

Rolling-hash triggers cut texts into phrases that overlap by one byte less than a match, so that every match lies in
one phrase and phrases part the corpus into its dictionary and its parse. The dictionary holds each phrase once; the
parse says which documents hold a phrase, of which the smallest owns it: a larger document loses the phrase. What is left
of the dictionary is cut again, at the least trigger of each string of a match's length, into short runs of suffixes.
The runs around one trigger meet in one place, where their suffixes are sorted by their first bytes: a part of the
corpus order, as strings that begin alike have the same least trigger. Each class of equal suffixes has its smallest
document from the parse.

Since phrases overlap by so much, the order of the parse would only order suffixes of one class among themselves,
which no result depends on; so of the parse only the documents of each phrase are kept, not its suffix array.

Whole phrases are equal if their 128-bit BLAKE2b digests are; suffixes are compared byte by byte. Rolling hashes only cut
texts and tell where suffixes may be alike: a collision costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
from functools import cache, cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.common import mix64
from skein.session import Scratch, ensure_importable

#: Bytes that a trigger looks at, and the share of positions that start a phrase (one in PHRASE).
TRIGGER, PHRASE = 24, 128
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15


@cache
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n at least; those of blocks of usual size are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size, out = -(-n // (1 << 18)) << 18, []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, np.uint64(base))
        p[0] = 1
        out.append(np.cumprod(p))
    if size <= 1 << 22:
        _POWERS[:] = out
    return out[0], out[1]


def rolling(data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each stretch of length bytes, or of those that start at `at`, from one prefix sum."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    if at is not None:
        return mix64((sums[at + length] - sums[at]) * down[at])
    return mix64((sums[length:] - sums[:n]) * down[:n])


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over each window of width values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


class Block(NamedTuple):
    """Texts of several documents end to end. ends: where each ends; ids: their numbers."""

    data: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], ids: list[int]) -> Block:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64), np.asarray(ids, np.int64))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def owner(self) -> np.ndarray:
        """Which document holds each byte."""
        return np.repeat(np.arange(len(self.ends)), self.ends - self.starts)

    def valid(self, length: int) -> np.ndarray:
        """Where a string of length bytes fits into its document."""
        out = np.ones(len(self.data), bool)
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            out[max(start, end - length + 1) : end] = False
        return out


class Parse(NamedTuple):
    """Phrases of a block: where each starts, the start of the next, the end with overlap, and its document."""

    start: np.ndarray
    stop: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    triggers: np.ndarray


def parse(block: Block, length: int) -> Parse:
    n = len(block.data)
    triggers = rolling(block.data, TRIGGER)
    triggers[~block.valid(TRIGGER)[: len(triggers)]] = NEVER
    cut = np.zeros(n, bool)
    cut[: len(triggers)] = triggers & np.uint64(PHRASE - 1) == 0
    starts = block.starts
    cut[starts[block.ends > starts]] = True
    start = np.flatnonzero(cut)
    doc = np.searchsorted(block.ends, start, side="right")
    stop = np.minimum(np.append(start[1:], n), block.ends[doc]) if len(start) else start
    return Parse(start, stop, np.minimum(stop + length - 1, block.ends[doc]) if len(start) else start, doc, triggers)


def shared_triggers(found: Parse, active: np.ndarray, length: int) -> np.ndarray:
    """The places of triggers that are least in an active window of length bytes."""
    width = length - TRIGGER + 1
    least = sliding(found.triggers, width)
    masked = np.where(active[: len(least)], least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    seen = sliding(np.concatenate([edge, masked, edge]), width, np.maximum)[: len(found.triggers)]
    return np.flatnonzero((seen == found.triggers) & (found.triggers != NEVER) & (seen != 0))


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data at `at` in order of their first length bytes, and where a new prefix of that length begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = []
    for i in range(0, length, 8):
        take = min(8, length - i)
        word = np.zeros((len(at), 8), np.uint8)
        word[:, :take] = view[at + i][:, :take]
        words.append(word.view(">u8").ravel().astype(np.uint64))
    order = np.lexsort(words[::-1])
    new = np.zeros(len(at), bool)
    for word in words:
        sorted_word = word[order]
        new[1:] |= sorted_word[1:] != sorted_word[:-1]
    new[:1] = True
    return order, new


#: What a cell holds for each of its phrases: a digest and the smallest document, in full or as a distance.
KEY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
NEAR_KEY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u4")])
ROUNDS = ("phrase", "trigger", "suffix")


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cells_of(bucket: np.ndarray):
    """(bucket, slice) of each run of equal numbers."""
    if len(bucket):
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        yield from ((int(bucket[i]), slice(int(i), int(j))) for i, j in zip(edges[:-1], edges[1:], strict=True))


class Keys(NamedTuple):
    """Distinct keys of a block in order of (bucket, a, b), the smallest document of each, and each item's key."""

    bucket: np.ndarray
    rows: np.ndarray
    shared: np.ndarray
    of_item: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, doc: np.ndarray, buckets: int) -> Keys:
        """doc ascends, as documents do within a block."""
        order = np.argsort(a, kind="stable")
        a_, b_ = a[order], b[order]
        if ((a_[1:] == a_[:-1]) & (b_[1:] != b_[:-1])).any():
            order = np.lexsort((b, a))
            a_, b_ = a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (a_[1:] != a_[:-1]) | (b_[1:] != b_[:-1])
        first = np.flatnonzero(new)
        rows = np.empty(len(first), KEY)
        rows["a"], rows["b"], rows["doc"] = a_[first], b_[first], doc[order][first]
        most = np.maximum.reduceat(doc[order], first) if len(first) else doc[:0]
        of_item = np.empty(len(order), np.int64)
        of_item[order] = np.cumsum(new) - 1
        return cls(bucket_of(rows["a"], buckets), rows, rows["doc"] != most, of_item)

    def sent(self, trigger: bool):
        """(bucket, bytes, keys) of each cell. For triggers the low halves, as the bucket tells most of the rest, and which
        keys several documents of the block share. Else digests and documents, these as distances from the smallest
        where 32 bits hold them."""
        for bucket, part in cells_of(self.bucket):
            rows = self.rows[part]
            if trigger:
                yield bucket, rows["a"].astype("<u4").tobytes() + np.packbits(self.shared[part]).tobytes(), len(rows)
                continue
            base = rows["doc"].min()
            far = int(rows["doc"].max()) - int(base) >= 1 << 32
            out = np.empty(len(rows), KEY if far else NEAR_KEY)
            out["a"], out["b"] = rows["a"], rows["b"]
            out["doc"] = rows["doc"] if far else rows["doc"] - base
            yield bucket, bytes([far]) + base.tobytes() + out.tobytes(), len(rows)


class Runs(NamedTuple):
    """Distinct runs of suffixes of a block in order of their bucket: the bytes that hold them and the smallest document;
    each occurrence's run, first suffix and number of suffixes."""

    bucket: np.ndarray
    strings: list[bytes]
    doc: np.ndarray
    of_item: np.ndarray
    start: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, start: np.ndarray, least: np.ndarray, doc_of, length: int, buckets: int) -> Runs:
        """start: suffixes, ascending; least: the least trigger of each. Suffixes next to each other with the same least
        trigger make a run."""
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(start) != 1) | (least[1:] != least[:-1])
        at = np.flatnonzero(new)
        first, count = start[at], np.diff(np.append(at, len(start)))
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)], np.int64)
        bucket, doc = np.zeros(len(seen), np.int64), np.full(len(seen), LAST_ID)
        bucket[number] = bucket_of(mix64(least[at]), buckets)
        np.minimum.at(doc, number, doc_of(first))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        strings = list(seen)
        return cls(bucket[order], [strings[i] for i in order.tolist()], doc[order], place[number], first, count)

    def kept(self) -> bytes:
        """All but the strings, for the round that gets the answers."""
        sizes = np.array([len(self.doc), len(self.start)], "<i8")
        many = np.array([len(x) for x in self.strings], "<u4")
        return b"".join(x.tobytes() for x in (sizes, self.bucket.astype("<i8"), self.doc.astype("<i8"), many, self.of_item.astype("<u4"), self.start.astype("<u4"), self.count.astype("<u4")))

    @staticmethod
    def from_kept(raw: bytes) -> tuple[np.ndarray, ...]:
        """bucket, doc and size of each distinct run; number, start and count of each occurrence."""
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at, out = 16, []
        for kind, size in (("<i8", n), ("<i8", n), ("<u4", n), ("<u4", m), ("<u4", m), ("<u4", m)):
            out.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
            at += size * np.dtype(kind).itemsize
        return tuple(out)

    def sent(self):
        """(bucket, bytes, runs) of each cell: sizes, documents, strings."""
        for bucket, part in cells_of(self.bucket):
            strings = self.strings[part]
            yield bucket, np.array([len(x) for x in strings], "<u4").tobytes() + self.doc[part].astype("<i8").tobytes() + b"".join(strings), len(strings)


class State:
    """A block with the answers of the rounds so far; works out what it asks in the next round, or what to remove.

    What a later round needs too goes with the answers, under a number below 0, so that it isn't worked out again.
    """

    def __init__(self, block: Block, length: int, buckets: int, answers: dict[str, dict[int, bytes]]):
        self.block, self.length, self.buckets, self.answers = block, length, buckets, answers
        self.valid = block.valid(length)

    @cached_property
    def parse(self) -> Parse:
        return parse(self.block, self.length)

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The documents that hold these bytes."""
        return self.block.ids[np.searchsorted(self.block.ends, at, side="right")]

    def answer(self, name: str, bucket: np.ndarray, bits: np.ndarray | None = None) -> np.ndarray:
        """The bits of all cells in order; bits: how many each key has, if not one."""
        out = []
        for number, part in cells_of(bucket):
            n = part.stop - part.start if bits is None else int(bits[part].sum())
            out.append(np.unpackbits(np.frombuffer(self.answers[name][number], np.uint8), count=n).astype(bool))
        return np.concatenate(out) if out else np.zeros(0, bool)

    def kept(self, name: str) -> bytes:
        """What the block itself sent in a round for later ones."""
        return next(x for number, x in self.answers[name].items() if number < 0)

    def phrase_keys(self) -> Keys:
        p, raw = self.parse, memoryview(self.block.data.tobytes())
        digests = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(p.start.tolist(), p.end.tolist(), strict=True)])
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        return Keys.of(both[:, 0], both[:, 1], self.block.ids[p.doc], self.buckets)

    def repeated(self) -> np.ndarray:
        """Which bytes start a string that lies in a phrase which a smaller document has too."""
        keys = self.phrase_keys()
        phrases = self.answer("phrase", keys.bucket)[keys.of_item] | (keys.rows["doc"][keys.of_item] < self.block.ids[self.parse.doc])
        edge = np.zeros(len(self.block.data) + 1, np.int32)
        np.add.at(edge, self.parse.start[phrases], 1)
        np.add.at(edge, self.parse.stop[phrases], -1)
        return self.valid & (np.cumsum(edge)[:-1] > 0)

    def removed(self) -> np.ndarray:
        """repeated(), as the round of triggers kept it."""
        return np.unpackbits(np.frombuffer(self.kept("trigger"), np.uint8), count=len(self.block.data)).astype(bool)

    def trigger_keys(self, removed: np.ndarray) -> tuple[Keys, np.ndarray]:
        """Keys of the triggers that are least in a string still looked for, and where they are."""
        at = shared_triggers(self.parse, self.valid & ~removed, self.length)
        # Least triggers are small numbers: mixed again, they spread over all buckets.
        a = mix64(self.parse.triggers[at])
        return Keys.of(a, np.zeros(len(a), np.uint64), self.ids(at), self.buckets), at

    def suffix_runs(self) -> Runs:
        """Runs of the suffixes that may be shared: their least trigger is one that another document has."""
        removed = self.removed()
        keys, at = self.trigger_keys(removed)
        known = self.answer("trigger", keys.bucket)[keys.of_item]
        # The lowest bit tells triggers that nobody else has; of two that differ in it alone the other wins.
        marked = self.parse.triggers | np.uint64(1)
        marked[at[known]] &= ~np.uint64(1)
        least = sliding(marked, self.length - TRIGGER + 1)
        n = len(least)
        start = np.flatnonzero(self.valid[:n] & ~removed[:n] & (least & np.uint64(1) == 0))
        return Runs.of(self.block.data, start, least[start], self.ids, self.length, self.buckets)

    def asked(self, name: str):
        """(bucket, bytes, keys) of each cell, and what later rounds need under -1."""
        if name == "phrase":
            yield from self.phrase_keys().sent(False)
        elif name == "trigger":
            removed = self.repeated()
            yield -1, np.packbits(removed).tobytes(), 0
            yield from self.trigger_keys(removed)[0].sent(True)
        else:
            runs = self.suffix_runs()
            yield -1, runs.kept(), 0
            yield from runs.sent()

    def covered(self) -> np.ndarray:
        """Which bytes go."""
        removed = self.removed()
        bucket, doc, size, of_item, start, count = Runs.from_kept(self.kept("suffix"))
        if len(start):
            many = size - self.length + 1
            bits, first = self.answer("suffix", bucket, many), np.cumsum(many) - many
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            later = bits[np.repeat(first[of_item], count) + inner] | np.repeat(doc[of_item] < self.ids(start), count)
            removed[(np.repeat(start, count) + inner)[later]] = True
        edge = np.zeros(len(removed) + 1, np.int32)
        edge[:-1] += removed
        edge[self.length :] -= removed[: len(removed) + 1 - self.length] if len(removed) >= self.length else 0
        return np.cumsum(edge)[:-1] > 0


def _parted(bits: np.ndarray, sizes) -> list[bytes]:
    edges = np.cumsum([0, *sizes])
    return [np.packbits(bits[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]


def judge_phrases(cells: list[bytes], sizes: list[int]) -> list[bytes]:
    """Bits for each cell of a bucket: a smaller document has the phrase too."""
    parts = []
    for cell in cells:
        rows = np.frombuffer(cell, KEY if cell[0] else NEAR_KEY, offset=9).astype(KEY)
        if not cell[0]:
            rows["doc"] += np.frombuffer(cell, "<i8", 1, 1)[0]
        parts.append(rows)
    rows = np.concatenate(parts)
    order = np.lexsort((rows["b"], rows["a"]))
    a, b, doc = rows["a"][order], rows["b"][order], rows["doc"][order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    out = np.empty(len(order), bool)
    out[order] = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(a))))
    return _parted(out, sizes)


def judge_triggers(cells: list[bytes], sizes: list[int]) -> list[bytes]:
    """Bits for each cell of a bucket: another document may have the trigger too."""
    a = np.concatenate([np.frombuffer(c, "<u4", n) for c, n in zip(cells, sizes, strict=True)])
    inner = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8, offset=4 * n), count=n).astype(bool) for c, n in zip(cells, sizes, strict=True)])
    order = np.argsort(a, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
    many = np.diff(np.append(first, len(a)))
    out = np.empty(len(a), bool)
    out[order] = np.repeat((many > 1) | np.bitwise_or.reduceat(inner[order], first), many)
    return _parted(out, sizes)


def judge_suffixes(cells: list[bytes], sizes: list[int], length: int) -> list[bytes]:
    """Bits for each cell of a bucket, one per suffix of its runs: a smaller document has the suffix's first bytes too.

    The bucket's dictionary has each run once, with its smallest document; all its suffixes are sorted by these bytes.
    """
    size = [np.frombuffer(c, "<u4", n).astype(np.int64) for c, n in zip(cells, sizes, strict=True)]
    doc = np.concatenate([np.frombuffer(c, "<i8", n, 4 * n) for c, n in zip(cells, sizes, strict=True)])
    seen: dict[bytes, int] = {}
    number = []
    for cell, n, s in zip(cells, sizes, size, strict=True):
        ends = (12 * n + np.cumsum(s)).tolist()
        number += [seen.setdefault(cell[i:j], len(seen)) for i, j in zip([12 * n, *ends[:-1]], ends, strict=True)]
    run, own = np.array(number, np.int64), np.full(len(seen), LAST_ID)
    np.minimum.at(own, run, doc)
    sizes_ = np.array([len(x) for x in seen], np.int64)
    many = sizes_ - length + 1
    base = np.cumsum(many) - many
    start = np.repeat(np.cumsum(sizes_) - sizes_ - base, many) + np.arange(many.sum())
    order, new = suffix_order(np.frombuffer(b"".join(seen), np.uint8), start, length)
    first = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(np.repeat(own, many)[order], first), np.diff(np.append(first, len(order))))
    # Each occurrence of a run against its suffixes' classes.
    count = many[run]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out = np.repeat(doc, count) > least[np.repeat(base[run], count) + inner]
    return _parted(out, [int((x - length + 1).sum()) for x in size])


#: Work on a block takes some 150 bytes of memory per byte.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 8 << 20
LAST_ID = (1 << 63) - 1


def remove_repeats(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), with_text: bool = False, max_files: int = 20_000) -> DataFrame:
    """Remove each byte covered by a string of length bytes that also starts in a document with a smaller doc_id.

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with with_text also kept_text (the
    kept bytes, less parts of characters that were cut through); and the columns named in carry. A null text is
    empty. Rows with the same doc_id never remove from one another; a null doc_id counts as larger than any other.
    Texts shorter than length lose nothing. Other columns are ignored; no rows give no rows.

    Texts are dealt into blocks of about 1 MB once, kept in at most max_files files, which is the number of tasks. Rows
    that repeat id and text are one within a block and spread over blocks by their partition. Three rounds follow, in
    each of which blocks ask what they hold, each thing once with its smallest document, and get bits back: phrases (a
    block drops those of smaller documents), triggers (it keeps suffixes near triggers that others have), and runs of
    suffixes. The result is written to the shared folder; all else that the job wrote there is deleted.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(8, -(-total // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).alias("block")
    cut = docs.select(block, "doc_id", "text", *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    try:
        texts = scratch.write_bucketed(cut, min(blocks, max_files), "block")
        texts_only = texts.select("block", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text").groupBy("block")
        answers = None
        for name in ROUNDS:
            asked = _ask(texts_only, answers, name, length, buckets)
            got = scratch.write(asked.groupBy("bucket").applyInArrow(_judge(name, length), "block long, round string, bucket long, bits binary"), name)
            answers = got if answers is None else answers.unionByName(got)
        out = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string")])
        if with_text:
            out.add("kept_text", "string")
        for c in carry:
            out.add(docs.schema[c])
        result = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(length, buckets, carry, with_text, out), out)
        result = scratch.write(result, "result")
    finally:
        scratch.close(keep="result")
    return result


def _state(texts: pa.Table, answers: pa.Table | None, length: int, buckets: int) -> tuple[State, list[int]]:
    """The block's distinct rows with the answers to it, and each row's number among them."""
    got: dict[str, dict[int, bytes]] = {x: {} for x in ROUNDS}
    if answers is not None:
        for name, bucket, bits in zip(*(answers[c].to_pylist() for c in ("round", "bucket", "bits")), strict=True):
            got[name][bucket] = bits
    rows = [(LAST_ID if i is None else i, t) for i, t in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True)]
    number = {row: n for n, row in enumerate(sorted(set(rows), key=lambda row: row[0]))}
    of_row = [number[row] for row in rows]
    return State(Block.of([t for _, t in number], [i for i, _ in number]), length, buckets, got), of_row


def _ask(texts, answers: DataFrame | None, name: str, length: int, buckets: int) -> DataFrame:
    schema = T._parse_datatype_string("block long, bucket long, keys binary, n long")
    arrow = to_arrow_schema(schema)

    def cells(left: pa.Table, right: pa.Table | None) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        block = left["block"][0].as_py()
        # What a block keeps for itself passes through a bucket of its own.
        rows = [(block, bucket if bucket >= 0 else -1 - block, keys, n) for bucket, keys, n in _state(left, right, length, buckets)[0].asked(name)]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    if answers is None:
        return texts.applyInArrow(lambda left: cells(left, None), schema)
    return texts.cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: cells(left, right), schema)


def _judge(name: str, length: int):
    def run(table: pa.Table) -> pa.Table:
        cells, sizes = table["keys"].to_pylist(), table["n"].to_pylist()
        bits = cells if table["bucket"][0].as_py() < 0 else judge_phrases(cells, sizes) if name == "phrase" else judge_triggers(cells, sizes) if name == "trigger" else judge_suffixes(cells, sizes, length)
        return pa.table({"block": table["block"], "round": pa.array([name] * len(bits)), "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def _finish(length: int, buckets: int, carry: tuple[str, ...], with_text: bool, out: T.StructType):
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        state, of_row = _state(left, right, length, buckets)
        covered, block = state.covered(), state.block
        found: dict[str, list] = {"n_bytes": (block.ends - block.starts).tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
        for start, end in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            gone = covered[start:end]
            kept = block.data[start:end][~gone].tobytes()
            found["n_removed"].append(int(gone.sum()))
            found["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(gone) and gone[0])))
            found["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                found["kept_text"].append(kept.decode("utf-8", "ignore"))
        columns = [left["doc_id"], *([x[i] for i in of_row] for x in found.values() if x), *(left[f"carry_{i}"] for i in range(len(carry)))]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run
